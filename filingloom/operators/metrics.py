"""Metrics over signals and outcomes, and grid searches over them. Rows have ``signal``, ``score``, ``ret`` and ``direction``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def side(signal: Column) -> Column:
    """1 for buying, -1 for selling, 0 for anything else."""
    return F.when(signal.isin("BUY", "STRONG_BUY"), 1).when(signal.isin("SELL", "STRONG_SELL"), -1).otherwise(0)


def move(direction: Column) -> Column:
    return F.when(direction == "up", 1).when(direction == "down", -1).when(direction == "flat", 0)


def share(hits: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(hits, total), F.lit(0.0))


def _marked(df: DataFrame) -> DataFrame:
    return df.withColumns({"s": side(F.col("signal")), "m": move(F.col("direction"))})


def summary(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Total, scorable, hit rate, directional accuracy, mean return and Sharpe ratio, of all rows or by ``keys``."""
    d = _marked(df)
    known, firm = F.col("m").isNotNull(), (F.col("s") != 0) & (F.col("m") != 0)
    excess = F.avg("ret") - 0.05 / 4
    sd = F.stddev_samp("ret")
    sharpe = F.when(F.count("ret") >= 2, excess / F.when(sd > 0, sd).otherwise(0.001) * 2)
    own = [
        F.count("*").alias("total"),
        F.count_if(known).alias("scorable"),
        share(F.count_if(known & (F.col("s") == F.col("m"))), F.count_if(known)).alias("hit_rate"),
        share(F.count_if(firm & (F.col("s") == F.col("m"))), F.count_if(firm)).alias("directional_accuracy"),
        F.avg("ret").alias("avg_return"),
        sharpe.alias("sharpe"),
    ]
    return d.groupBy(*(keys or [])).agg(*own)


def precision_by_signal(df: DataFrame) -> DataFrame:
    d = _marked(df).where("m is not null")
    return d.groupBy("signal").agg(F.count_if(F.col("s") == F.col("m")).alias("correct"), F.count("*").alias("total"), share(F.count_if(F.col("s") == F.col("m")), F.count("*")).alias("precision"))


def return_by_signal(df: DataFrame) -> DataFrame:
    return df.where("ret is not null").groupBy("signal").agg(F.avg("ret").alias("avg_ret"), F.min("ret").alias("min_ret"), F.max("ret").alias("max_ret"), F.count("*").alias("n"))


def confusion(df: DataFrame) -> DataFrame:
    """All nine cells of predicted against actual, zero-filled; any other label counts as neutral."""
    spark = df.sparkSession
    name = lambda c: F.when(c == 1, "bullish").when(c == -1, "bearish").otherwise("neutral")
    d = _marked(df).where("m is not null").groupBy(name(F.col("s")).alias("predicted"), name(F.col("m")).alias("actual")).agg(F.count("*").alias("n"))
    labels = spark.range(0, 1, 1, 1).select(F.explode(F.array(*[F.lit(x) for x in ("bearish", "bullish", "neutral")])).alias("predicted"))
    cells = labels.crossJoin(F.broadcast(labels.withColumnRenamed("predicted", "actual")))
    return cells.join(d, ["predicted", "actual"], "left").na.fill(0, ["n"])


def worst_misses(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    return _marked(df).where("s * m = -1").orderBy(F.desc(F.abs("ret")), key).limit(k).drop("s", "m")


def better_of(a: Column, b: Column, name_a: str, name_b: str) -> Column:
    return F.when(a > b, name_a).when(b > a, name_b).otherwise("Tie")


# ---- grids: a fixed number of cells, so they may be broadcast whatever the rows ---------------------------------


def threshold_cells(spark: SparkSession) -> DataFrame:
    """64 cells of (sell, buy) thresholds in twentieths, numbered with sell as the outer loop."""
    i, j = F.floor(F.col("id") / 8), F.col("id") % 8
    return spark.range(0, 64, 1, 1).select(F.col("id").cast("int").alias("cell"), ((i - 8) * 5 / 100.0).alias("sell"), ((j + 1) * 5 / 100.0).alias("buy"))


def weight_cells(spark: SparkSession) -> DataFrame:
    """171 cells of three weights of at least .05 that add up to 1, numbered with the first as the outer loop."""
    a, b = F.floor(F.col("id") / 19) + 1, F.col("id") % 19 + 1
    before = (a - 1) * 19 - (a - 1) * a / 2  # 19 - k cells for each smaller first weight k
    rows = spark.range(0, 361, 1, 1).select(a.alias("a"), b.alias("b"), (before + b - 1).cast("int").alias("cell")).where("a + b < 20")
    return rows.select("cell", (F.col("a") / 20.0).alias("w1"), (F.col("b") / 20.0).alias("w2"), ((20 - F.col("a") - F.col("b")) / 20.0).alias("w3"))


def _graded(cells: DataFrame, counted: DataFrame) -> DataFrame:
    """``cell, ..., hits, total, accuracy`` of every cell out of ``(cell, hits, total)`` of those that have any."""
    out = cells.join(F.broadcast(counted), "cell", "left").na.fill(0, ["hits", "total"])
    return out.withColumn("accuracy", share(F.col("hits"), F.col("total")))


def best_cell(cells: DataFrame, rows: DataFrame, components: list[str], score: Column, low: float, high: float) -> DataFrame:
    """Directional accuracy of every cell of weights: equal rows are counted first, then each is scored once for each cell."""
    rows = rows.where("m <> 0").groupBy(*components, "m").agg(F.count("*").alias("_n"))
    d = rows.crossJoin(F.broadcast(cells)).withColumn("x", score)
    s = F.when(F.col("x") >= high, 1).when(F.col("x") < low, -1).otherwise(0)
    d = d.withColumn("s", s).where("s <> 0").groupBy("cell").agg(F.sum(F.when(F.col("s") == F.col("m"), F.col("_n")).otherwise(0)).alias("hits"), F.sum("_n").alias("total"))
    return _graded(cells, d)


def threshold_grid(df: DataFrame) -> DataFrame:
    """Directional accuracy of every pair of thresholds. Rows are counted by move and by how many of the 16 thresholds the score reaches; only those counts meet the cells."""
    cells = threshold_cells(df.sparkSession)
    bounds = [(i - 8) * 5 / 100.0 for i in range(8)] + [(j + 1) * 5 / 100.0 for j in range(8)]
    reached = sum(((F.col("score") >= b).cast("int") for b in bounds), F.lit(0))
    counts = _marked(df).where("score is not null and m <> 0").groupBy(reached.alias("_b"), "m").agg(F.count("*").alias("_n"))
    sell, buy = F.floor(F.col("cell") / 8), F.col("cell") % 8
    side_of = F.when(F.col("_b") > 8 + buy, 1).when(F.col("_b") <= sell, -1)
    # at most 34 rows of counts
    d = cells.crossJoin(F.broadcast(counts)).withColumn("s", side_of).where("s is not null")
    return _graded(cells, d.groupBy("cell").agg(F.sum(F.when(F.col("s") == F.col("m"), F.col("_n")).otherwise(0)).alias("hits"), F.sum("_n").alias("total")))


def weight_grid(df: DataFrame, components: list[str], low: float = -0.2, high: float = 0.2) -> DataFrame:
    """Cells of weights over three component scores; rows that lack one are left out."""
    rows = reduce(lambda d, c: d.where(F.col(c).isNotNull()), components, df).withColumn("m", move(F.col("direction"))).select(*components, "m")
    score = sum((F.col(c) * F.col(w) for c, w in zip(components[1:], ("w2", "w3"))), F.col(components[0]) * F.col("w1"))
    return best_cell(weight_cells(df.sparkSession), rows, components, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)), low, high)


def section_weight_grid(df: DataFrame, sections: list[str], low: float = -0.2, high: float = 0.2) -> DataFrame:
    """Cells of weights over the scores of three sections, one column a section; the weights of the sections a row has are shared out anew.

    A row without any of them scores 0. Rows should be those of the model whose sections are weighted.
    """
    rows = df.withColumn("m", move(F.col("direction"))).select(*sections, "m")
    weights = list(zip(sections, ("w1", "w2", "w3")))
    value = sum((F.coalesce(F.col(c) * F.col(w), F.lit(0.0)) for c, w in weights), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), F.col(w)).otherwise(0.0) for c, w in weights), F.lit(0.0))
    return best_cell(weight_cells(df.sparkSession), rows, sections, F.coalesce(F.try_divide(value, weight), F.lit(0.0)), low, high)


def first_best(grid: DataFrame) -> DataFrame:
    """The first cell with the highest accuracy above 0; none if no cell is above 0."""
    return grid.where("accuracy > 0").orderBy(F.desc("accuracy"), "cell").limit(1)


#: Rows below which a grid has nothing to say.
LEAST_POINTS = 5


def recommend(grid: DataFrame, name: str, original: DataFrame, least: float = 0.01) -> DataFrame:
    """``grid, data_points, best_cell, accuracy, original, improvement, adopt`` of one grid, always one row.

    ``original`` has one row ``(data_points, original)``. Below ``LEAST_POINTS`` rows, or if no cell is above 0, there is no
    best cell; it is adopted only if it is better than the original by more than ``least``.
    """
    best = F.broadcast(first_best(grid).select(F.col("cell").alias("best_cell"), "accuracy"))
    out = original.join(best, F.col("data_points") >= LEAST_POINTS, "left").withColumn("improvement", F.col("accuracy") - F.col("original"))
    return out.select(F.lit(name).alias("grid"), "data_points", "best_cell", "accuracy", "original", "improvement", F.coalesce(F.col("improvement") > least, F.lit(False)).alias("adopt"))


def original_accuracy(df: DataFrame) -> DataFrame:
    """``(data_points, original)``: how many rows there are and the directional accuracy of the signals as they are."""
    d = _marked(df)
    firm = (F.col("s") != 0) & (F.col("m") != 0)
    return d.agg(F.count("*").alias("data_points"), share(F.count_if(firm & (F.col("s") == F.col("m"))), F.count_if(firm)).alias("original"))


def with_fallback(first: DataFrame, second: DataFrame, entity: str) -> DataFrame:
    """The rows of ``first``, and of ``second`` for the entities that ``first`` hasn't any of."""
    return first.unionByName(second.join(first.select(entity).distinct(), entity, "left_anti"), allowMissingColumns=True)
