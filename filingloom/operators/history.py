"""Operators over the filings of an entity in order of their dates. Rows are one a filing unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingloom.functions.text import title_case

SECTIONS = ("item_1a", "item_7", "item_8")


def previous_in(df: DataFrame, run: str, order: list[str], value: Column, alias: str) -> DataFrame:
    """Adds the value of the row before, by ``order``, within ``run``.

    A run may be long, so it isn't sorted in one task: rows are sorted within (run, month), and the first row of
    a month takes the last value of the month before it that has rows, from a table of one row a run and month.
    """
    month = F.date_format(order[0], "yyyyMM")
    rows = df.withColumn("_m", month).withColumn("_v", value)
    w = Window.partitionBy(run, "_m").orderBy(*order)
    inner = rows.withColumn("_p", F.lag("_v").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    ends = rows.groupBy(run, "_m").agg(F.max_by("_v", F.struct(*order)).alias("_e"))
    ends = ends.select(F.col(run).alias("_run"), F.col("_m").alias("_month"), F.lag("_e").over(Window.partitionBy(run).orderBy("_m")).alias("_e"))
    joined = inner.join(ends, F.col("_first") & (F.col(run) == F.col("_run")) & (F.col("_m") == F.col("_month")), "left")
    return joined.withColumn(alias, F.when(F.col("_first"), F.col("_e")).otherwise(F.col("_p"))).drop("_m", "_v", "_p", "_first", "_run", "_month", "_e")


def positions(df: DataFrame, entity: str, *order: str) -> DataFrame:
    """Adds ``at``, the place of a row among its entity's rows from 0 by ``order``, and ``of``, how many there are.

    Rows are sorted within (entity, month) only; the rows of earlier months are counted over one row an entity and month.
    """
    rows = df.withColumn("_m", F.date_format(order[0], "yyyyMM"))
    months = rows.groupBy(entity, "_m").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(entity)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    months = months.select(F.col(entity).alias("_e"), F.col("_m").alias("_mm"), before.alias("_before"), F.sum("_n").over(w).alias("of"))
    inner = rows.withColumn("_i", F.row_number().over(Window.partitionBy(entity, "_m").orderBy(*order)))
    out = inner.join(months, (F.col(entity) == F.col("_e")) & F.col("_m").eqNullSafe(F.col("_mm")))
    return out.withColumn("at", F.col("_before") + F.col("_i") - 1).drop("_m", "_e", "_mm", "_before", "_i")


def newest(df: DataFrame, entity: str, *order: str, k: int) -> DataFrame:
    """The ``k`` newest rows of each entity with ``nth`` from 1, and ``of``, how many rows the entity has.

    The rank limit works before the shuffle too, so of a hot entity only ``k`` rows of each task are moved; rows are counted apart.
    """
    w = Window.partitionBy(entity).orderBy(*[F.desc(o) for o in order])
    top = df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)
    return top.join(df.groupBy(entity).agg(F.count("*").alias("of")), entity)


def latest(df: DataFrame, entity: str, *order: str) -> DataFrame:
    """The newest row of each entity; the rows are reduced before the shuffle, a hot entity too."""
    row = F.struct(*df.columns)
    return df.groupBy(entity).agg(F.max_by(row, F.struct(*order)).alias("_r")).select("_r.*")


def shifts(sections: DataFrame, entity: str, filing: list[str], threshold: float = 0.15) -> DataFrame:
    """Changes of a section's score of at least ``threshold`` from one filing of the entity to the next.

    Rows are one a (filing, section). Each filing is linked to the one before and the sections are joined over that, so a
    section that the filing before lacks has no change; ``lag`` by section would jump over that filing.
    """
    keys = [entity, *filing]
    links = previous_in(sections.select(*keys).distinct(), entity, filing, F.struct(*filing), "_back").where("_back is not null")
    old = sections.select(F.col(entity), *[F.col(c).alias(f"_{c}") for c in filing], "section", F.col("score").alias("before"))
    now = sections.join(links.select(*keys, *[F.col(f"_back.{c}").alias(f"_{c}") for c in filing]), keys)
    delta = F.col("score") - F.col("before")
    out = now.join(old, [entity, *[f"_{c}" for c in filing], "section"]).drop(*[f"_{c}" for c in filing]).withColumn("delta", delta).where(F.abs(delta) >= threshold)
    return out.withColumn("severity", F.when(F.abs("delta") >= 2 * threshold, "high").otherwise("medium")).withColumn("direction", F.when(F.col("delta") > 0, "positive").otherwise("negative"))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(2)


def year_over_year(df: DataFrame, entity: str, *order: str, blended: str | None = None) -> DataFrame:
    """Each filing against the entity's filing before: overall, each section's score (missing ones as 0), words, signal.

    With ``blended``, the name of a second score, its change too, if both filings have it.
    """
    filled = df.withColumns({s: F.coalesce(s, F.lit(0.0)) for s in SECTIONS})
    kept = ("overall", *SECTIONS, "words", *([blended] if blended else []))
    y = previous_in(filled, entity, list(order), F.struct(*kept, "signal"), "_b").where("_b is not null")
    return y.withColumns({**{f"{c}_delta": F.col(c) - F.col(f"_b.{c}") for c in kept}, "signal_changed": F.col("signal") != F.col("_b.signal")}).drop("_b")


def trend(df: DataFrame, entity: str, *order: str, flat: float = 0.05) -> DataFrame:
    """Mean of the older and the newer half of an entity's filings, the newer being larger if they are odd in number."""
    old = F.col("at") < F.floor(F.col("of") / 2)
    out = positions(df, entity, *order).groupBy(entity).agg(F.avg(F.when(old, F.col("overall"))).alias("older"), F.avg(F.when(~old, F.col("overall"))).alias("newer"), F.count("*").alias("filings"))
    gap = F.round(F.col("newer") - F.col("older"), 9)  # means of the same numbers in another order
    return out.withColumn("trend", F.when(gap > flat, "improving").when(gap < -flat, "deteriorating").otherwise("stable"))


def extremes(df: DataFrame, entity: str, *order: str) -> DataFrame:
    """Mean, least, greatest and range of the overall score, and the dates of the greatest rise and fall (the first of ties)."""
    d = previous_in(df, entity, list(order), F.struct("overall"), "_b").withColumn("_d", F.col("overall") - F.col("_b.overall"))
    early = -F.datediff(order[0], F.lit("1900-01-01"))
    rise = F.when(F.max("_d") > 0, F.max("_d"))
    fall = F.when(F.min("_d") < 0, F.min("_d"))
    return d.groupBy(entity).agg(
        F.avg("overall").alias("mean"), F.min("overall").alias("least"), F.max("overall").alias("greatest"), (F.max("overall") - F.min("overall")).alias("range"),
        rise.alias("rise"), fall.alias("fall"), F.max_by(order[0], F.when(F.col("_d") > 0, F.struct("_d", early.alias("i")))).alias("rise_date"),
        F.max_by(order[0], F.when(F.col("_d") < 0, F.struct((-F.col("_d")).alias("d"), early.alias("i")))).alias("fall_date"),
    )


def word_change(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Change in per cent from the first to the last number of words that isn't 0."""
    when = F.when(F.col("words") > 0, F.struct(*order))
    out = df.groupBy(*keys).agg(F.min_by("words", when).alias("first_words"), F.max_by("words", when).alias("last_words"), F.count("*").alias("filings"))
    return out.withColumn("change_pct", F.try_divide((F.col("last_words") - F.col("first_words")) * 100.0, F.col("first_words")))


def of_year_or_latest(df: DataFrame, entity: str, date: str, year: int, *tie: str) -> DataFrame:
    """The entity's last filing of the year, or its newest where it has none that year."""
    row = F.struct(*df.columns)
    return df.groupBy(entity).agg(F.max_by(row, F.struct(F.year(date) == year, F.col(date), *tie)).alias("_r")).select("_r.*")


def shown(anomalies: DataFrame, most: int = 3, chars: int = 400) -> DataFrame:
    """``title, category, severity, severity_reason, explanation, contexts`` of anomaly rows for display, older fields standing in for missing ones.

    Rows may lack any of the columns ``title keyword category type severity severity_reason explanation contexts``. Contexts
    of over ``chars`` characters are cut and end in dots.
    """
    kind = lambda c: "array<string>" if c == "contexts" else "string"
    a = {c: (F.col(c) if c in anomalies.columns else F.lit(None)).cast(kind(c)) for c in ("title", "keyword", "category", "type", "severity", "severity_reason", "explanation", "contexts")}
    filled = lambda c: F.when(c != "", c)
    severity = F.coalesce(filled(a["severity"]), F.lit("medium"))
    kept = [c for c in anomalies.columns if c not in a]
    cut = F.transform(F.slice(F.filter(F.coalesce(a["contexts"], F.expr("cast(array() as array<string>)")), lambda x: x.isNotNull()), 1, most), lambda x: F.when(F.length(x) > chars, F.concat(F.substring(x, 1, chars), F.lit("..."))).otherwise(x))
    return anomalies.select(
        *kept,
        F.coalesce(filled(a["title"]), filled(title_case(a["keyword"])), F.lit("Anomaly Detected")).alias("title"),
        F.coalesce(filled(a["category"]), filled(title_case(a["type"])), F.lit("General")).alias("category"),
        severity.alias("severity"),
        F.coalesce(filled(a["severity_reason"]), F.concat(F.lit("Severity: "), severity)).alias("severity_reason"),
        F.coalesce(filled(a["explanation"]), F.lit("No additional context available.")).alias("explanation"),
        cut.alias("contexts"),
    )
