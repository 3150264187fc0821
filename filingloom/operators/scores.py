"""Scores of sections and filings, their blend, and the signal they give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lower bounds of the signals, section weights, and what a model's reply is worth.
SIGNALS = [(0.5, "STRONG_BUY"), (0.2, "BUY"), (-0.2, "HOLD"), (-0.5, "SELL")]
SECTION_WEIGHTS = {"item_1a": 0.25, "item_7": 0.60, "item_8": 0.15}
OUTLOOKS = {"very_bullish": 1.0, "bullish": 0.4, "neutral": 0.0, "bearish": -0.4, "very_bearish": -1.0}
CONFIDENCES = {"high": 0.6, "medium": 0.5, "low": 0.25}


def signal(score: Column) -> Column:
    """The signal of a score, bounds closed below; null and NaN have none."""
    low = F.when(score.isNull() | F.isnan(score), F.lit(None).cast("string"))
    for bound, name in SIGNALS:
        low = low.when(score >= bound, name)
    return low.otherwise("STRONG_SELL")


def weight_of(section: Column, weights: dict[str, float] = SECTION_WEIGHTS, other: float = 1 / 3) -> Column:
    found = reduce(lambda c, kv: c.when(section == kv[0], kv[1]), weights.items(), F.when(F.lit(False), 0.0))
    return found.otherwise(other)


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def clamp(c: Column, bound: float = 1.0) -> Column:
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), c))


def blend(df: DataFrame, components: dict[str, float]) -> DataFrame:
    """Adds ``score``, ``components_agree`` and one ``<name>_part`` for each component.

    The weights are shared out anew among the components that aren't null; if theirs are all 0, evenly. Without
    any component everything is null.
    """
    names = list(components)
    given = {n: F.when(F.col(n).isNotNull(), F.lit(w)).otherwise(0.0) for n, w in components.items()}
    total = sum((given[n] for n in names[1:]), given[names[0]])
    here = sum((F.col(n).isNotNull().cast("int") for n in names[1:]), F.col(names[0]).isNotNull().cast("int"))
    parts = {}
    for n in names:
        share = F.when(total > 0, given[n] / total).otherwise(F.try_divide(F.col(n).isNotNull().cast("double"), here))
        parts[f"{n}_part"] = F.when(F.col(n).isNotNull(), clamp(F.col(n)) * share)
    score = sum((F.coalesce(parts[f"{n}_part"], F.lit(0.0)) for n in names[1:]), F.coalesce(parts[f"{names[0]}_part"], F.lit(0.0)))
    present = F.filter(F.array(*names), lambda x: x.isNotNull())
    agree = F.forall(present, lambda x: x > 0) | F.forall(present, lambda x: x < 0) | F.forall(present, lambda x: x == 0)
    return df.withColumns({**parts, "score": F.when(here > 0, clamp(score)), "components_agree": F.when(here > 0, agree)})


def reply_score(reply: Column) -> Column:
    """``STRUCT<outlook, confidence, score>`` of a model's JSON reply, code fences aside; ``parse_error`` and 0 if it can't be read."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(reply), "^```[a-z]*\\s*", ""), "\\s*```$", "")
    read = F.from_json(bare, "outlook string, confidence string, key_factors array<string>, one_line_summary string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    lookup = lambda c, table, other: reduce(lambda a, kv: a.when(c == kv[0], kv[1]), table.items(), F.when(F.lit(False), 0.0)).otherwise(other)
    good = read["_bad"].isNull() & read["outlook"].isNotNull()
    value = F.round(lookup(F.lower(read["outlook"]), OUTLOOKS, 0.0) * lookup(F.lower(read["confidence"]), CONFIDENCES, 0.4), 4)
    return F.struct(F.when(good, read["outlook"]).otherwise("parse_error").alias("outlook"), read["confidence"].alias("confidence"), F.when(good, value).otherwise(0.0).alias("score"))
