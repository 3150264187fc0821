"""Retrieval chunks: paragraphs folded into overlapping pieces, and windows of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.functions.text import paragraphs, trimmed, word_count, words


def fold(parts: Column, size: int = 500, overlap: int = 50, least: int = 100) -> Column:
    """Chunks of paragraphs, greedily filled to ``size`` words.

    A full chunk is closed and the next one begins with its last paragraph, or with that paragraph's last
    ``overlap`` words if it is longer. What is left at the end is kept from ``least`` words on; a paragraph over
    ``size`` is never cut.
    """
    none = "cast(array() as array<struct<p:string,n:int>>)"
    empty = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.expr(none).alias("cur"), F.lit(0).alias("wc"))
    text = lambda cur: F.array_join(F.transform(cur, lambda x: x["p"]), "\n\n")
    counted = F.transform(parts, lambda p: F.struct(p.alias("p"), word_count(p).alias("n")))

    def merge(acc: Column, p: Column) -> Column:
        last = F.element_at(acc["cur"], -1)
        seed = F.when(last["n"] <= overlap, last).otherwise(F.struct(F.array_join(F.slice(words(last["p"]), -overlap, overlap), " ").alias("p"), F.lit(overlap).alias("n")))
        full = (acc["wc"] + p["n"] > size) & (F.size(acc["cur"]) > 0)
        closed = F.struct(F.concat(acc["done"], F.array(text(acc["cur"]))).alias("done"), F.array(seed, p).alias("cur"), (F.least(last["n"], F.lit(overlap)) + p["n"]).alias("wc"))
        open_ = F.struct(acc["done"].alias("done"), F.concat(acc["cur"], F.array(p)).alias("cur"), (acc["wc"] + p["n"]).alias("wc"))
        return F.when(full, closed).otherwise(open_)

    finish = lambda end: F.when(end["wc"] >= least, F.concat(end["done"], F.array(text(end["cur"])))).otherwise(end["done"])
    return F.aggregate(counted, empty, merge, finish)


def chunk_rows(df: DataFrame, keys: list[str], text: str, size: int = 500, overlap: int = 50, least: int = 100) -> DataFrame:
    """``(keys, chunk_id, chunk, word_count)``; chunk_id counts from 0 in each text."""
    out = df.select(*keys, F.posexplode(fold(paragraphs(F.col(text)), size, overlap, least)).alias("chunk_id", "chunk"))
    return out.withColumn("word_count", word_count(F.col("chunk")))


def chunk_summary(chunks: DataFrame, *dims: str) -> DataFrame:
    """Chunks and mean words in all and by each dimension, as grouping sets of one aggregate."""
    total = [F.count("*").alias("chunks"), F.sum("word_count").alias("words"), F.avg("word_count").alias("mean_words")]
    return chunks.groupingSets([[], *[[F.col(d)] for d in dims]], *[F.col(d) for d in dims]).agg(*total, *[F.grouping(d).alias(f"all_{d}") for d in dims])


def numbered_paragraphs(df: DataFrame, keys: list[str], text: str, least: int = 20) -> DataFrame:
    """Paragraphs of at least ``least`` words; their number counts the short and empty ones too."""
    parts = F.transform(F.split(F.col(text), r"\n\s*\n"), trimmed)
    out = df.select(*keys, F.posexplode(parts).alias("chunk_id", "paragraph")).withColumn("word_count", word_count(F.col("paragraph")))
    return out.where(F.col("word_count") >= least)


def token_windows(df: DataFrame, keys: list[str], text: str, size: int = 510, stride: int = 460, most: int = 50) -> DataFrame:
    """Windows of ``size`` words every ``stride`` words, at most ``most`` of a text: the input size of a classifier."""
    w = df.select(*keys, words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.slice(F.sequence(F.lit(0), F.size("w") - 1, F.lit(stride)), 1, most)
    rows = w.select(*keys, F.posexplode(F.transform(starts, lambda s: F.slice("w", s + 1, size))).alias("window_no", "tokens"))
    return rows.select(*keys, "window_no", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("window_text"))
