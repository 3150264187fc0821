"""How far filings have come through parse, sections, sentiment and ensemble, as DataFrames instead of files on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = ("parse", "sections", "sentiment", "ensemble")


def filing_status(filings: DataFrame, text: str, sections: DataFrame, sentiment: DataFrame, ensemble: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, parsed, sections, sentiment, ensemble, success, message)`` of every filing.

    Without a text a filing has failed at parsing; each later step needs the one before, but the ensemble may be missing: a
    filing has succeeded once it has sentiment.
    """
    parsed = filings.groupBy(*keys).agg(F.max((F.coalesce(F.col(text), F.lit("")) != "").cast("int")).cast("boolean").alias("parsed"))
    has = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    out = parsed.join(has(sections, "_s"), keys, "left").join(has(sentiment, "_f"), keys, "left").join(has(ensemble, "_e"), keys, "left").na.fill(False, ["_s", "_f", "_e"])
    cut = F.col("parsed") & F.col("_s")
    out = out.select(*keys, "parsed", cut.alias("sections"), (cut & F.col("_f")).alias("sentiment"), (cut & F.col("_f") & F.col("_e")).alias("ensemble"))
    return out.withColumn("success", F.col("sentiment")).withColumn("message", completed(*[F.col(c) for c in ("parsed", "sections", "sentiment", "ensemble")]))


def completed(*steps: Column) -> Column:
    named = F.concat_ws(", ", *[F.when(c, F.lit(n)) for c, n in zip(steps, STEPS)])
    return F.when(steps[0], F.concat(F.lit("Completed: "), named)).otherwise("Pipeline failed at parsing")


def company_status(status: DataFrame, company: str) -> DataFrame:
    """``(company, processed, failed, total, success, message)``: a company has succeeded if any of its filings has."""
    out = status.groupBy(company).agg(F.count_if("success").alias("processed"), F.count_if(~F.col("success")).alias("failed"), F.count("*").alias("total"))
    said = F.format_string("Processed %d/%d filings", "processed", "total")
    return out.withColumn("success", F.col("processed") > 0).withColumn("message", said)
