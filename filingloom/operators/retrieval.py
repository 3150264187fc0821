"""Vector and keyword top-k, fusion, question expansion and answers' context."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from filingloom.functions.dictionary import FOLLOW_UPS, SYNONYMS
from filingloom.functions.text import words
from filingloom.operators.nearest import best_vectors
from filingloom.operators.wordsets import best_texts
from filingloom.sources.tables import spread, written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.greatest(F.sqrt(dot(a, a)), F.lit(1e-10))


#: Rows, and bytes, of a query block; a block is broadcast to the scan of the other side.
BLOCK_ROWS, BLOCK_BYTES = 2_000, 32 << 20


def _in_blocks(queries: DataFrame, best: Callable[[DataFrame], DataFrame], rank: Callable[[DataFrame], DataFrame], rows: int = BLOCK_ROWS) -> DataFrame:
    """``best`` of a stated query set of any size: each block of about ``rows`` queries (fewer, if they are long) is broadcast and met with the whole other side.

    A block is a scan of its own that keeps only its best rows, and is written before the next one starts; a single block is one
    scan, without writing. No plan holds a join without a bound on one of its sides.
    """
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*queries.columns)))), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size.n // rows), -(-size.b // BLOCK_BYTES))
    if blocks == 1:
        return rank(best(F.broadcast(queries)))
    queries = written(queries.withColumn("_block", F.pmod(F.xxhash64("q_key"), F.lit(blocks))))
    parts = [written(rank(best(F.broadcast(queries.where(F.col("_block") == b).drop("_block"))))) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def cosine_topk(queries: DataFrame, index: DataFrame, key: str, vector: str, k: int = 5, same: str | None = None, rows: int = BLOCK_ROWS) -> DataFrame:
    """``(q_key, key, similarity, rank)``: for each query row the ``k`` most similar index rows with a similarity above 0, itself left out.

    Exact. The queries are a stated set, met in blocks of ``rows``; the rank limit works in each task before anything is moved.
    ``same`` names a column that has to agree; queries and index are then joined on it if there are many queries. Without it all pairs
    are met, in Arrow batches; ``key`` must be of a type that Arrow sorts as Spark does (whole numbers, strings, dates).
    """
    if same:
        q = queries.select(F.col(key).alias("q_key"), F.col(vector).alias("_q"), norm(F.col(vector)).alias("_qn"), F.col(same).alias("_qs"))
        x = index.select(F.col(key), F.col(vector).alias("_x"), norm(F.col(vector)).alias("_xn"), F.col(same).alias("_xs"))
        on = (F.col("q_key") != F.col(key)) & (F.col("_qs") == F.col("_xs"))
        pairs = lambda part: x.join(part, on).select("q_key", key, (dot(F.col("_q"), F.col("_x")) / (F.col("_qn") * F.col("_xn"))).alias("similarity")).where("similarity > 0")
    else:
        numbers = F.col(vector).cast("array<double>")
        q = queries.select(F.col(key).alias("q_key"), numbers.alias("_q")).where("q_key is not null")
        x = spread(index.select(F.col(key).alias("_key"), numbers.alias("_x")).where("_key is not null"), "_key")
        kind = StructType([StructField("q_key", q.schema["q_key"].dataType), StructField("_key", x.schema["_key"].dataType), StructField("similarity", DoubleType())])

        def pairs(part: DataFrame) -> DataFrame:
            block = part.toArrow().combine_chunks()
            keys, vectors = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in block.columns)
            return x.mapInArrow(lambda batches: best_vectors(batches, keys, vectors, k), kind).withColumnRenamed("_key", key)

    return _in_blocks(q, pairs, lambda d: top(d, "q_key", "similarity", key, k), rows)


def top(df: DataFrame, group: str, by: str, tie: str, k: int) -> DataFrame:
    """The ``k`` best of each group; a rank limit over a window, which Spark applies before and after the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc(by), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Different sets of words, and their bytes, that are sent to one scan of the texts; more are further scans.
SET_ROWS, SET_BYTES = 50_000, 8 << 20


def keyword_topk(queries: DataFrame, docs: DataFrame, q_key: str, question: str, key: str, text: str, k: int = 5, rows: int = SET_ROWS) -> DataFrame:
    """``(q_key, key, share, rank)``: texts by the share of the question's distinct tokens that they hold as substrings, above 0.

    Questions of the same tokens are one set, answered once. Sets are met with the texts in blocks of about ``rows``; a block is one scan, in
    which each text is looked through once for the words of all sets, and each task keeps the ``k`` best texts of a set. ``q_key`` may be
    a struct; ``key`` must be a type that Python orders as Spark does (whole numbers, strings, dates).
    """
    q = queries.select(F.col(q_key).alias("q_key"), F.array_sort(F.array_distinct(words(F.lower(question)))).alias("_w")).where(F.size("_w") > 0)
    d = docs.select(F.col(key).alias("_key"), F.lower(text).alias("_t")).where("_t is not null")
    # written, for a set must keep its number
    sets = written(q.select("_w").distinct().withColumn("_set", F.monotonically_increasing_id()))
    size = sets.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json("_w"))), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size.n // rows), -(-size.b // SET_BYTES))
    kind = StructType([StructField("_set", LongType()), StructField("_key", d.schema["_key"].dataType), StructField("_hits", IntegerType())])

    def best(block: int) -> DataFrame:
        mine = [(r["_set"], r["_w"]) for r in sets.where(F.pmod(F.xxhash64("_set"), F.lit(blocks)) == block).collect()]
        return top(d.mapInArrow(lambda batches: best_texts(batches, mine, k), kind), "_set", "_hits", "_key", k).drop("rank")

    found = best(0) if blocks == 1 else reduce(DataFrame.unionByName, [written(best(b)) for b in range(blocks)])
    hits = found.join(sets, "_set").join(q, "_w").select("q_key", F.col("_key").alias(key), (F.col("_hits") / F.size("_w")).alias("share"))
    return top(hits, "q_key", "share", key, k)


def expanded_topk(queries: DataFrame, docs: DataFrame, q_key: str, question: str, key: str, text: str, k: int = 5, most: int = 3) -> DataFrame:
    """``(q_key, key, share, rank)`` over up to ``most`` variations of each question: twice ``k`` texts of each, fused by the best share."""
    v = queries.select(q_key, F.posexplode(expansions(F.col(question), most=most)).alias("_n", "_v")).select(F.struct(F.col(q_key).alias("q"), F.col("_n").alias("n")).alias("_k"), "_v")
    found = keyword_topk(v, docs, "_k", "_v", key, text, 2 * k).select(F.col("q_key.q").alias("q_key"), key, "share")
    return fuse(found, "q_key", [key], "share", k)


def fallback(first: DataFrame, second: DataFrame, group: str) -> DataFrame:
    """Rows of ``first``, and of ``second`` for the groups that ``first`` hasn't any of."""
    return first.unionByName(second.join(first.select(group).distinct(), group, "left_anti"))


def fuse(parts: DataFrame, group: str, keys: list[str], score: str, k: int) -> DataFrame:
    """Results of several variations of one question: the best score of each key, then the ``k`` best keys."""
    best = parts.groupBy(group, *keys).agg(F.max(score).alias(score))
    return top(best, group, score, keys[0], k)


def rerank(pairs: DataFrame, group: str, question: str, text: str, tie: str, scorer: Callable[[pd.Series, pd.Series], pd.Series], k: int) -> DataFrame:
    """Orders candidates by a pair scorer, in Arrow batches; ``scorer`` is loaded once a worker."""

    @F.pandas_udf("double")
    def score(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in it:
            yield scorer(a, b)

    return top(pairs.withColumn("rerank_score", score(question, text)), group, "rerank_score", tie, k)


def embed(df: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]], chars: int = 1000) -> DataFrame:
    """Adds ``embedding`` from a model over the first ``chars`` characters (what the model reads), in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series(model(s.fillna("").str.slice(0, chars).tolist()))

    return df.withColumn("embedding", run(text))


def expansions(question: Column, synonyms: dict[str, list[str]] = SYNONYMS, most: int = 3) -> Column:
    """The question and what it becomes when, for each key, the first synonym in it is replaced by each other one; at most ``most``."""
    made = [F.array(question)]
    for terms in synonyms.values():
        arm = F.when(F.lit(False), F.array(question))
        for t in terms:
            others = F.array(*[F.regexp_replace(question, f"(?i)\\Q{t}\\E", o) for o in terms if o.lower() != t.lower()])
            arm = arm.when(F.contains(F.lower(question), F.lit(t.lower())), others)
        made.append(arm.otherwise(F.expr("cast(array() as array<string>)")))
    return F.slice(F.array_distinct(F.concat(*made)), 1, most)


def is_follow_up(question: Column) -> Column:
    """Whether a question starts with a word that points back; as a prefix."""
    return F.trim(F.lower(question)).rlike("^(" + "|".join(FOLLOW_UPS) + ")")


def with_history(turns: DataFrame, conversation: str, turn: str, text: str, role: str | None = None) -> DataFrame:
    """Adds the last question before and the expanded question: the one before put in front of a follow-up.

    With ``role``, turns are of ``user`` and ``assistant``, and only the user's count as questions.
    """
    w = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    asked = F.col(text) if role is None else F.when(F.col(role) == "user", F.col(text))
    before = F.last(asked, ignorenulls=True).over(w)
    return turns.withColumn("before", before).withColumn("expanded", F.when(is_follow_up(F.col(text)) & F.col("before").isNotNull(), F.concat_ws(" ", "before", text)).otherwise(F.col(text)))


# How turns are labelled, what stands between excerpts, and what is said without any.
ROLES = {"user": "User", "assistant": "Assistant"}
BETWEEN = "\n\n---\n\n"
NOTHING = "No relevant information found in the indexed filings."


def history_window(turns: DataFrame, conversation: str, turn: str, text: str, most: int = 10, chars: int = 200, role: str | None = None) -> DataFrame:
    """The last turns of each conversation in one line each, cut to ``chars`` characters, with the speaker if ``role`` is named."""
    w = Window.partitionBy(conversation).orderBy(F.desc(turn))
    kept = turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    said = F.substring(text, 1, chars)
    if role is not None:
        said = F.concat(F.when(F.col(role) == "user", ROLES["user"]).otherwise(ROLES["assistant"]), F.lit(": "), said)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(turn, said.alias("t")))), lambda x: x["t"])
    return kept.groupBy(conversation).agg(F.array_join(lines, "\n").alias("history"), F.count("*").alias("turns"))


def _joined(results: DataFrame, group: str, order: str, part: Column, most: int, between: str, name: str) -> DataFrame:
    rows = results.where(F.col(order) <= most).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p")))).alias("_p"))
    return rows.select(group, F.array_join(F.transform("_p", lambda x: x["p"]), between).alias(name))


def answer_context(results: DataFrame, group: str, order: str, head: Column, text: str, most: int = 5, chars: int = 600) -> DataFrame:
    """One text for each question out of its best results: a bracketed head and the first characters of each."""
    return _joined(results, group, order, F.concat(F.lit("["), head, F.lit("]\n"), F.substring(text, 1, chars)), most, BETWEEN, "context")


def excerpts(results: DataFrame, group: str, order: str, head: Column, text: str, most: int = 3, chars: int = 500) -> DataFrame:
    """``(group, excerpts)``: the answer where no model is at hand, the first results under their heads."""
    return _joined(results, group, order, F.concat(F.lit("**"), head, F.lit(":**\n"), F.substring(text, 1, chars), F.lit("\n")), most, "\n", "excerpts")


def answers(questions: DataFrame, results: DataFrame, q_key: str, question: str, head: Column, text: str, score: str, factory: Callable | None = None, history: str | None = None) -> DataFrame:
    """``(q_key, answer, method, sources)`` of every question: the whole way from retrieved ``results (q_key, rank, ...)`` to an answer.

    Each question has its context put to a model (``factory`` makes the client; ``history`` names a column with the turns before);
    without a model, or if it fails, the answer is excerpts; without any result it is a fixed sentence. ``method`` is model,
    excerpts or nothing, and ``sources`` are the heads with their scores, best first.
    """
    from filingloom.operators.models import ask

    found = answer_context(results, q_key, "rank", head, text).join(excerpts(results, q_key, "rank", head, text), q_key)
    source = F.struct("rank", head.alias("source"), F.round(score, 4).alias("score"))
    sources = results.groupBy(q_key).agg(F.transform(F.array_sort(F.collect_list(source)), lambda s: F.struct(s["source"], s["score"])).alias("sources"))
    out = questions.join(found, q_key, "left").join(sources, q_key, "left")
    said = F.lit("") if history is None else F.when(F.length(history) > 0, F.concat(F.lit("Conversation context:\n"), F.col(history), F.lit("\n\n"))).otherwise("")
    prompt = F.when(F.col("context").isNotNull(), F.concat(F.coalesce(said, F.lit("")), F.lit("Excerpts:\n"), F.col("context"), F.lit("\n\nQuestion: "), F.coalesce(question, F.lit("")), F.lit("\n\nAnswer:")))
    out = out.withColumn("_prompt", prompt)
    out = ask(out, "_prompt", "_reply", factory) if factory is not None else out.withColumn("_reply", F.lit(None).cast("string"))
    method = F.when(F.col("context").isNull(), "nothing").when(F.col("_reply").isNotNull(), "model").otherwise("excerpts")
    answer = F.coalesce("_reply", F.concat(F.lit("Based on the filings:\n\n"), F.col("excerpts")), F.lit(NOTHING))
    return out.select(q_key, answer.alias("answer"), method.alias("method"), F.coalesce("sources", F.expr("cast(array() as array<struct<source:string,score:double>>)")).alias("sources"))


def company_search(companies: DataFrame, needle: str, limit: int = 10) -> DataFrame:
    """Companies with the text in name or ticker: the exact ticker first, then shorter names, then by ticker."""
    n = needle.strip().lower()
    hit = F.contains(F.lower("company_name"), F.lit(n)) | F.contains(F.lower("ticker"), F.lit(n))
    return companies.where(hit).orderBy(F.lower("ticker") != n, F.length("company_name"), "ticker").limit(limit)


def company_lookup(df: DataFrame, ticker: str, details: DataFrame, cached: DataFrame) -> DataFrame:
    """Adds ``company_name`` of each row's ticker, whatever its case or spaces: from the detail records, else from cached names, else null.

    ``details`` and ``cached`` have ``ticker`` and ``company_name``; of several names of a ticker the first in order counts.
    """
    names = lambda d, c: d.where("company_name is not null").groupBy(F.upper(F.trim("ticker")).alias("_t")).agg(F.min("company_name").alias(c))
    out = df.withColumn("_t", F.upper(F.trim(ticker))).join(names(details, "_d"), "_t", "left").join(names(cached, "_c"), "_t", "left")
    return out.select(*[F.col(c) for c in df.columns], F.coalesce("_d", "_c").alias("company_name"))


def engine_status(documents: DataFrame, text: str, vectors: DataFrame, turns: DataFrame) -> DataFrame:
    """``(documents, with_text, vectors, turns, indexed)``: what a retrieval engine has at hand, one row."""
    count = lambda d, n: d.agg(F.count("*").alias(n))
    d = documents.agg(F.count("*").alias("documents"), F.count_if(F.coalesce(F.col(text), F.lit("")) != "").alias("with_text"))
    return d.crossJoin(count(vectors, "vectors")).crossJoin(count(turns, "turns")).withColumn("indexed", F.col("with_text") > 0)
