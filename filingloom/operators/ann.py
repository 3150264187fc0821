"""Approximate nearest vectors: an inverted file over cosine clusters.

Centroids are fitted on a bounded sample; every row is indexed under its nearest one. A query looks into the ``probes`` clusters whose
centroids are nearest to it and compares itself exactly with what is there. Queries are a stated set and are sent to the index in blocks, so
the index isn't moved, however many rows a cluster holds. :func:`recall` measures against the exact search.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.operators.retrieval import BLOCK_ROWS, _in_blocks, dot, norm, top

#: Rows that centroids are fitted on at most; nothing else is sampled.
FIT_ROWS = 20_000


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector that has a direction, which is added as ``_f``; null, empty and zero vectors are near nothing."""
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0) & (dot(F.col(vector), F.col(vector)) > 0)
    return df.where(usable).withColumn("_f", array_to_vector(F.col(vector).cast("array<double>")))


def fit(index: DataFrame, vector: str, clusters: int = 64, rows: int = FIT_ROWS, seed: int = 3) -> KMeansModel | None:
    """Centroids by cosine distance on a sample of about ``rows`` rows (all, if there are no more); None without any vector."""
    usable = _vectors(index, vector).select("_f")
    count = usable.count()
    if not count:
        return None
    sample = usable if count <= rows else usable.sample(min(1.0, rows / count), seed)
    return KMeans(k=max(2, min(clusters, count)), featuresCol="_f", predictionCol="_cluster", distanceMeasure="cosine", seed=seed, maxIter=10).fit(sample) if count > 1 else None


def assign(index: DataFrame, vector: str, model: KMeansModel) -> DataFrame:
    """Every usable row with ``_cluster``; a projection, nothing is moved."""
    return model.transform(_vectors(index, vector)).drop("_f")


def ann_topk(queries: DataFrame, index: DataFrame, key: str, vector: str, k: int = 5, probes: int = 16, clusters: int = 64, model: KMeansModel | None = None, rows: int = BLOCK_ROWS) -> DataFrame:
    """``(q_key, key, similarity, rank)``: for each query row up to ``k`` near index rows with a similarity above 0, itself left out.

    Of rows as similar the smaller key comes first. Queries and rows without a direction give nothing; an empty index gives
    an empty result; other columns are ignored. With ``probes`` equal to the number of clusters it is exact.
    """
    spark = index.sparkSession
    model = model or fit(index, vector, clusters)
    if model is None:
        return index.select(F.lit(None).cast(index.schema[key].dataType).alias("q_key"), key, F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "_cluster int, _c array<double>")
    x = assign(index, vector, model).select(key, F.col(vector).alias("_x"), norm(F.col(vector)).alias("_xn"), "_cluster")
    q = _vectors(queries, vector).select(F.col(key).alias("q_key"), F.col(vector).alias("_q"), norm(F.col(vector)).alias("_qn"))

    def pairs(block: DataFrame) -> DataFrame:
        near = block.crossJoin(F.broadcast(centres)).withColumn("_s", dot(F.col("_q"), F.col("_c")) / norm(F.col("_c")))
        probed = top(near, "q_key", "_s", "_cluster", probes).select("q_key", "_q", "_qn", "_cluster")
        met = x.join(F.broadcast(probed), "_cluster").where(F.col("q_key") != F.col(key))
        return met.select("q_key", key, (dot(F.col("_q"), F.col("_x")) / (F.col("_qn") * F.col("_xn"))).alias("similarity")).where("similarity > 0")

    return _in_blocks(q, pairs, lambda d: top(d, "q_key", "similarity", key, k), rows)


def recall(found: DataFrame, exact: DataFrame, key: str) -> float:
    """Share of the exact results that were found; 1 if there are none."""
    keys = exact.select("q_key", key)
    total = keys.count()
    return keys.join(found.select("q_key", key), ["q_key", key], "left_semi").count() / total if total else 1.0
