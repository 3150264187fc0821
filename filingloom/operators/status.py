"""Stages, increments and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage_status(stages: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One row a key with one flag for each stage that has it: a tagged union and one aggregate instead of full outer joins."""
    tagged = reduce(DataFrame.unionByName, [df.select(*keys, F.lit(name).alias("stage")).distinct() for name, df in stages.items()])
    return tagged.groupBy(*keys).agg(*[F.max((F.col("stage") == name).cast("int")).cast("boolean").alias(f"has_{name}") for name in stages])


def not_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What has no row in ``done``; rows with a null key are never done."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Of each key the row with the greatest version; reduced before the shuffle."""
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*both.columns), F.struct(*version)).alias("_r")).select("_r.*")


def add_to_list(listed: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return listed.unionByName(new.join(listed.select(key), key, "left_anti").dropDuplicates([key]))


def remove_from_list(listed: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return listed.join(gone.select(key).distinct(), key, "left_anti")


def identity_hash(*parts: Column, length: int = 32) -> Column:
    """The first characters of the SHA-256 of the parts joined by colons; null parts are empty."""
    return F.substring(F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def sector_of(df: DataFrame, companies: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Adds ``sector``, ``Other`` where a ticker has none."""
    dim = companies.select(F.col("ticker").alias("_t"), F.col("sector"))
    return df.join(dim, F.col(ticker) == F.col("_t"), "left").drop("_t").withColumn("sector", F.coalesce("sector", F.lit("Other")))
