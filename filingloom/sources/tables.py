"""Table readers shared by every query."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table of a data directory, pruned to ``columns`` if any are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: A table of at most so many bytes may be dealt out to all cores: the shuffle that costs is as small.
SPREAD_BYTES = 1 << 30


def planned_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a table's size, without running anything; joins are overestimated."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A small scan in fewer partitions than there are cores, dealt out to all of them (by ``keys``, if any); every other table is left as it is.

    For work on whole texts over a table of one small file, which is one task otherwise. Tables of over
    ``SPREAD_BYTES`` are never shuffled by it, however many cores there are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if planned_bytes(df) > SPREAD_BYTES or df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables, as named in ``spark.checkpoint.dir``.

    Only on a local master, where every task sees the same disk, may it be unset; a folder of the machine is made then.
    On a cluster that would be another folder on each executor, so it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="filingloom-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint (never a local one): lost executors lose no data."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage with a Parquet table in the shared checkpoint folder, of which later steps read single columns.

    The table is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row, from 0, by ``order``: rows are sorted by ranges, and only the sizes of the ranges are added up."""
    rows = written(df.orderBy(*order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    # one row a range
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_0"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_p", (before - F.col("_0")).alias("_0"))
    return rows.join(F.broadcast(starts), "_p").withColumn(name, F.col("_i") + F.col("_0")).drop("_p", "_i", "_0")


#: Rows, and bytes, that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, with a broadcast hint if it has at most ``rows`` rows and ``BROADCAST_BYTES`` bytes; else as it is, to be shuffled."""
    fixed = all(t in ("boolean", "int", "bigint", "double", "float", "date", "timestamp", "timestamp_ntz") for _, t in df.dtypes)
    size = F.lit(0) if fixed else F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))), F.lit(0))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), size.alias("b")).first()
    return F.broadcast(df) if found.n <= rows and found.b <= BROADCAST_BYTES else df


def section_key(column: Column | str) -> Column:
    """Canonical section key: lower case, letters and digits only, a leading ``item`` dropped, then ``item_`` put before.

    ``Item 1A``, ``ITEM_1A``, ``1a`` and ``item1a`` all become ``item_1a``; null stays null.
    """
    c = F.col(column) if isinstance(column, str) else column
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", ""), "^item", "")
    return F.concat(F.lit("item_"), bare)
