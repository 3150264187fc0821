"""Models from outside: classifiers of texts and language models. Each is a function passed in; none is shipped.

A classifier maps a list of texts to one dict of named probabilities each; a client maps a prompt to a reply. Both
are called in Arrow batches in the workers, where a factory makes them once.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.functions.text import trimmed, word_count, words
from filingloom.operators.scores import reply_score

Classifier = Callable[[list[str]], list[dict[str, float]]]
Client = Callable[[str], str]
LEAST_CHARACTERS = 50


class Busy(Exception):
    """Raised by a client that is over its rate."""


def text_sentiment(df: DataFrame, keys: list[str], text: str, factory: Callable[[], Classifier], size: int = 510, stride: int = 460, most: int = 50) -> DataFrame:
    """``(keys, positive, negative, neutral, compound, chunks)`` of each text, the mean of its windows weighted by their words.

    Keys identify a text. Texts of under 50 characters, blank and null ones are a third of each and 0, with no
    chunks. Names are taken from the classifier, never from positions.
    """

    @F.pandas_udf("positive double, negative double, neutral double")
    def classify(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()
        for s in parts:
            yield pd.DataFrame([{n: float(p.get(n, 0.0)) for n in ("positive", "negative", "neutral")} for p in model(s.tolist())], columns=["positive", "negative", "neutral"])

    long = F.length(trimmed(F.coalesce(text, F.lit("")))) >= LEAST_CHARACTERS
    w = df.select(*keys, F.when(long, words(F.col(text))).alias("_w"))
    starts = F.slice(F.sequence(F.lit(0), F.greatest(F.size("_w"), F.lit(1)) - 1, F.lit(stride)), 1, most)
    parts = F.when(F.col("_w").isNotNull(), F.transform(starts, lambda s: F.array_join(F.slice("_w", s + 1, size), " ")))
    rows = w.where("_w is not null").select(*keys, F.explode(parts).alias("_part"))
    scored = rows.withColumn("_n", word_count(F.col("_part"))).withColumn("_p", classify("_part"))
    mean = lambda n: F.try_divide(F.sum(F.col(f"_p.{n}") * F.col("_n")), F.sum("_n")).alias(n)
    found = scored.groupBy(*keys).agg(mean("positive"), mean("negative"), mean("neutral"), F.count("*").alias("chunks"))
    out = df.select(*keys).distinct().join(found, keys, "left").na.fill(0, ["chunks"])
    third = {n: F.coalesce(n, F.lit(1 / 3)) for n in ("positive", "negative", "neutral")}
    return out.withColumns(third).withColumn("compound", F.col("positive") - F.col("negative"))


def ask(df: DataFrame, prompt: str, reply: str, factory: Callable[[], Client], tries: int = 3, wait: float = 2.0) -> DataFrame:
    """Adds a model's reply to each prompt; after ``Busy`` it waits twice as long each time; other errors, and null prompts, give null."""

    def one(client: Client, text: str | None) -> str | None:
        for i in range(tries):
            if text is None:
                return None
            try:
                return client(text)
            except Busy:
                if i + 1 < tries:
                    time.sleep(wait * 2**i)
            except Exception:
                return None
        return None

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = factory()
        for s in parts:
            yield pd.Series([one(client, t) for t in s], dtype=object)

    return df.withColumn(reply, run(prompt))


def outlook_scores(df: DataFrame, item_7: str, item_1a: str, factory: Callable[[], Client]) -> DataFrame:
    """Adds ``outlook STRUCT<outlook, confidence, score>`` from a model that sees 2,000 characters of item 7 and 1,000 of item 1A."""
    head = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    prompt = F.concat(F.lit("Outlook of this filing as JSON.\nDiscussion:\n"), head(item_7, 2000), F.lit("\nRisks:\n"), head(item_1a, 1000))
    return ask(df.withColumn("_prompt", prompt), "_prompt", "_reply", factory).withColumn("outlook", reply_score(F.coalesce("_reply", F.lit("")))).drop("_prompt", "_reply")


def softmax(scores: list[float]) -> list[float]:
    """Probabilities of raw scores; for classifiers that give those."""
    top = max(scores, default=0.0)
    powers = [math.exp(x - top) for x in scores]
    return [p / sum(powers) for p in powers]


def provider(wanted: str, available: dict[str, Callable[[], Client] | None]) -> tuple[str, Callable[[], Client]] | None:
    """The client factory of a named provider, or with ``auto`` of the first that is there, in the order given; None without any."""
    names = list(available) if wanted.lower() == "auto" else [wanted.lower()]
    return next(((n, available[n]) for n in names if available.get(n) is not None), None)


def anomaly_notes(df: DataFrame, ticker: str, kind: str, title: str, description: str, contexts: str, factory: Callable[[], Client] | None) -> DataFrame:
    """Adds ``explanation``: two or three sentences of a model on each anomaly; a fixed sentence where it fails, null without a model."""
    if factory is None:
        return df.withColumn("explanation", F.lit(None).cast("string"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    said = F.concat(
        F.lit("An anomaly of type "), text(kind), F.lit(" was found in a filing of "), text(ticker), F.lit(".\nTitle: "), text(title), F.lit("\nDescription: "), text(description),
        F.lit("\nContext: "), F.coalesce(F.array_join(contexts, "; "), F.lit("")), F.lit("\nSay in two or three sentences why it matters."),
    )
    return ask(df.withColumn("_prompt", said), "_prompt", "explanation", factory).withColumn("explanation", F.coalesce(F.trim("explanation"), F.lit("LLM analysis unavailable."))).drop("_prompt")
