"""Keyword counts and scores. The dictionary is a list of ``(group, term, polarity)``; polarity is bear or bull."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Dictionary = list[tuple[str, str, str]]


def group_counts(low: Column, dictionary: Dictionary) -> Column:
    """``ARRAY<STRUCT<grp, polarity, n>>`` of a lower-case text, one element a group, without a join or a row for each term."""
    groups: dict[tuple[str, str], list[str]] = {}
    for g, t, p in dictionary:
        groups.setdefault((g, p), []).append(t)
    # one small expression over a constant array: an expression for each term would outgrow what the JVM compiles
    table = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(p).alias("polarity"), F.array(*[F.lit(t.lower()) for t in ts]).alias("terms")) for (g, p), ts in groups.items()])
    text = F.coalesce(low, F.lit(""))
    mentions = lambda t: ((F.length(text) - F.length(F.replace(text, t, F.lit("")))) / F.length(t)).cast("int")
    return F.transform(table, lambda g: F.struct(g["grp"].alias("grp"), g["polarity"].alias("polarity"), F.aggregate(g["terms"], F.lit(0), lambda a, t: a + mentions(t)).alias("n")))


def sizes(dictionary: Dictionary) -> dict[str, int]:
    return {p: len({g for g, _, q in dictionary if q == p}) for p in ("bear", "bull")}


def absolute_score(bear: Column, bull: Column, dictionary: Dictionary, scale: float = 0.5) -> Column:
    """``scale * (bull - bear) / (bull + bear)`` of the mean mentions of a group of each polarity; 0 if there are none."""
    n = sizes(dictionary)
    b, u = bear / n["bear"], bull / n["bull"]
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(scale) * (u - b), u + b), F.lit(0.0))))


def polarity_total(counts: Column, polarity: str) -> Column:
    return F.aggregate(F.filter(counts, lambda x: x["polarity"] == polarity), F.lit(0), lambda a, x: a + x["n"])


def active_groups(counts: Column, polarity: str) -> Column:
    """How many groups of a polarity are mentioned at all."""
    return F.size(F.filter(counts, lambda x: (x["polarity"] == polarity) & (x["n"] > 0)))


def top_groups(counts: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """The ``k`` most mentioned groups of each key that are mentioned at all; ties by name."""
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "grp")
    return counts.where("n > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def deltas(counts: DataFrame, entity: str, order: str, include_future: bool = True) -> DataFrame:
    """``delta`` of each group against the mean of the entity's other dates (``include_future``) or its earlier ones.

    Rows of ``counts`` are one a (entity, order, grp). A mean of 0 with mentions now gives 1; 0 and 0 gives null.
    ``history`` is the number of other dates.
    """
    every = Window.partitionBy(entity, "grp")
    past = every.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if include_future:
        total, history = F.sum("n").over(every) - F.col("n"), F.count("*").over(every) - 1
    else:
        total, history = F.coalesce(F.sum("n").over(past), F.lit(0)), F.count("*").over(past)
    df = counts.withColumn("history", history).withColumn("mean", F.try_divide(total, F.col("history")))
    delta = F.when((F.col("mean") == 0) & (F.col("n") > 0), 1.0).when(F.col("mean") > 0, (F.col("n") - F.col("mean")) / F.col("mean"))
    return df.withColumn("delta", delta)


def delta_signals(df: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """The ``k`` groups of each key that moved most, as ``(keys, grp, type, delta, rank)``; ties by name. Rows as ``deltas`` gives them."""
    risk = F.when(F.col("polarity") == "bear", "risk").otherwise("opportunity")
    move = F.when(F.col("delta") > 0.5, "increase").when(F.col("delta") < -0.3, "decrease")
    d = df.select(*keys, "grp", F.concat_ws("_", risk, move).alias("type"), F.round("delta", 6).alias("delta"), move.alias("_m")).where("_m is not null")
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs("delta")), "grp")
    return d.drop("_m").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def delta_score(df: DataFrame, keys: list[str], scale: float = 0.6) -> DataFrame:
    """Score of each key from group deltas: a rise above .5 counts for its polarity (up to 3), a fall below -.3 for the other (up to 2)."""
    up, down = F.least(F.col("delta"), F.lit(3.0)), F.least(F.abs("delta"), F.lit(2.0))
    push = F.when(F.col("delta") > 0.5, up).when(F.col("delta") < -0.3, -down).otherwise(0.0)
    bear, bull = F.col("polarity") == "bear", F.col("polarity") == "bull"
    bears = F.sum(F.when(bear & (push > 0), push).when(bull & (push < 0), -push).otherwise(0.0))
    bulls = F.sum(F.when(bull & (push > 0), push).when(bear & (push < 0), -push).otherwise(0.0))
    out = df.groupBy(*keys).agg(F.max("history").alias("history"), bears.alias("bear"), bulls.alias("bull"))
    return out.withColumn("score", F.coalesce(F.try_divide(scale * (F.col("bull") - F.col("bear")), F.col("bull") + F.col("bear")), F.lit(0.0)))


def dispatched_score(df: DataFrame, keys: list[str], dictionary: Dictionary, least_history: int = 2) -> DataFrame:
    """``history, mode, score`` of each key: by group deltas from ``least_history`` other dates on, else absolute. Rows as ``deltas`` gives them."""
    mentions = lambda p: F.coalesce(F.sum(F.when(F.col("polarity") == p, F.col("n"))), F.lit(0))
    plain = df.groupBy(*keys).agg(absolute_score(mentions("bear"), mentions("bull"), dictionary).alias("absolute"))
    known = F.col("history") >= least_history
    both = delta_score(df, keys).join(plain, keys)
    return both.select(*keys, "history", F.when(known, "delta").otherwise("absolute").alias("mode"), F.when(known, F.col("score")).otherwise(F.col("absolute")).alias("score"))


def anomalies(counts: DataFrame, entity: str, order: str, spike: float = 3.0, most: int = 5, least_history: int = 3) -> DataFrame:
    """Emergence, spike and decline of a group against the mean of all earlier dates, if there are at least ``least_history``.

    A group that has vanished altogether isn't reported.
    """
    df = deltas(counts, entity, order, include_future=False).where(F.col("history") >= least_history)
    ratio = F.try_divide(F.col("n"), F.col("mean"))
    kind = F.when((F.col("mean") == 0) & (F.col("n") > 0), "emergence").when(ratio >= spike, "spike").when((ratio > 0) & (ratio <= 1 / spike), "decline")
    df = df.withColumn("type", kind).where("type is not null")
    return df.withColumn("severity", F.when((F.col("type") != "decline") & (F.col("n") >= most), "high").otherwise("medium"))
