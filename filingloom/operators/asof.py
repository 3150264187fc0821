"""Forward as-of join, returns and outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingloom.sources.tables import planned_bytes


def daily_last(df: DataFrame, entity: str, ts: str, value: str, tie: str) -> DataFrame:
    """``(entity, d, close)``: the last value of each day."""
    return df.groupBy(entity, F.to_date(ts).alias("d")).agg(F.max_by(value, F.struct(ts, tie)).alias("close"))


def largest_entity(entity: str, *tables: DataFrame) -> int:
    """Rows of the entity that has most of them in all tables."""
    rows = reduce(DataFrame.unionByName, [t.select(F.col(entity).alias("_e")) for t in tables])
    return rows.where("_e is not null").groupBy("_e").count().agg(F.max("count")).first()[0] or 0


#: Rows of one entity up to which they are sorted in one task, and bytes of both tables up to which nothing need be counted.
ONE_TASK, SURELY_SMALL = 2_000_000, 64 << 20


def forward_asof(targets: DataFrame, series: DataFrame, entity: str, at: str, day: str, value: str, found_day: str, found: str, span: str = "yyyyMM", one_task: int = ONE_TASK) -> DataFrame:
    """Adds to each target the first value of its entity on or after ``at``; null after the last one or without ``at``.

    Union and window, one shuffle and one sort: no range join. If an entity has over ``one_task`` rows, its rows aren't sorted in one
    task: they are keyed by entity and month, and what isn't found in a month is taken from the first value of
    the entity's next month that has one, out of a table of one row an entity and month. ``series`` has one row an entity and day.
    Entities are counted unless both tables are small as planned.
    """
    keep = [F.col(c).alias(f"_keep_{c}") for c in targets.columns]
    left = targets.select(F.col(entity).alias("_e"), F.col(at).cast("date").alias("_t"), F.lit(1).alias("_k"), *keep)
    right = series.select(F.col(entity).alias("_e"), F.col(day).cast("date").alias("_t"), F.lit(0).alias("_k"), F.col(day).cast("date").alias("_d"), F.col(value).cast("double").alias("_v"))
    both = left.unionByName(right, allowMissingColumns=True)
    hot = one_task < ONE_TASK or planned_bytes(targets) + planned_bytes(series) > SURELY_SMALL
    hot = hot and largest_entity(entity, targets, series) > one_task
    follow = F.last(F.when(F.col("_d").isNotNull(), F.struct("_d", "_v")), ignorenulls=True)
    order = (F.desc("_t"), F.col("_k"))
    if not hot:
        w = Window.partitionBy("_e").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        # rows without entity or day are spread, and find nothing
        lost = F.col("_e").isNull() | F.col("_t").isNull()
        out = both.where(~lost).withColumn("_got", follow.over(w)).where("_k = 1")
        alone = left.where(lost).withColumn("_got", F.lit(None).cast("struct<_d:date,_v:double>"))
        out = out.select(*[c for c in left.columns], "_got").unionByName(alone)
    else:
        both = both.withColumn("_m", F.date_format("_t", span))
        w = Window.partitionBy("_e", "_m").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        inside = both.withColumn("_f", follow.over(w)).where("_k = 1")
        months = both.groupBy("_e", "_m").agg(F.min(F.when(F.col("_d").isNotNull(), F.struct("_d", "_v"))).alias("_first"))
        after = Window.partitionBy("_e").orderBy("_m").rowsBetween(1, Window.unboundedFollowing)
        months = months.select(F.col("_e").alias("_e2"), F.col("_m").alias("_m2"), F.first("_first", ignorenulls=True).over(after).alias("_next"))
        out = inside.join(months, (F.col("_e") == F.col("_e2")) & (F.col("_m") == F.col("_m2")), "left").withColumn("_got", F.coalesce("_f", "_next"))
    return out.select(*[F.col(f"_keep_{c}").alias(c) for c in targets.columns], F.col("_got._d").alias(found_day), F.col("_got._v").alias(found))


def change(base: Column, future: Column) -> Column:
    """Relative change; null if the base is null or 0."""
    return F.try_divide(future - base, base)


def direction(change: Column, flat: float = 0.02) -> Column:
    return F.when(change.isNull(), "unknown").when(change > flat, "up").when(change < -flat, "down").otherwise("flat")


def returns(events: DataFrame, series: DataFrame, entity: str, at: str, windows: list[int]) -> DataFrame:
    """Each event with each window of calendar days: value at the event, value after the window, change, direction."""
    based = forward_asof(events, series, entity, at, "d", "close", "base_day", "base")
    spread = based.withColumn("window_days", F.explode(F.array(*[F.lit(w) for w in windows]))).withColumn("due", F.date_add(at, F.col("window_days")))
    out = forward_asof(spread, series, entity, "due", "d", "close", "future_day", "future")
    return out.withColumn("ret", change(F.col("base"), F.col("future"))).withColumn("direction", direction(F.col("ret")))
