"""Parameter grids: combinations with images, scores, ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What rows of a grid are ranked by, the largest first; a minus sign turns a key round.
RANKING = ("score", "avg_instance_f1", "avg_boundary_iou", "avg_mask_iou", "avg_recall", "avg_precision", "-avg_over_split", "-count_gap")
TIE = 1e-9


def grid(spark: SparkSession, parameters: Mapping[str, Sequence[float]]) -> DataFrame:
    """Each combination of the parameters' values: one row of arrays, exploded one after the other."""
    row = spark.range(1).select(*[F.array(*[F.lit(float(v)) for v in values]).alias(name) for name, values in parameters.items()])
    return reduce(lambda df, name: df.withColumn(name, F.explode(name)), parameters, row)


def with_grid(df: DataFrame, combos: DataFrame) -> DataFrame:
    """Each row with each combination; the grid is a few hundred rows, whatever df is."""
    return df.crossJoin(F.broadcast(combos))


def score_grid(metrics: DataFrame, parameters: Sequence[str], score: Column, averages: Mapping[str, Column]) -> DataFrame:
    """(parameters..., score, score_std, n_images, avg_...): means and population deviation over images."""
    return metrics.groupBy(*parameters).agg(F.avg(score).alias("score"), F.stddev_pop(score).alias("score_std"), F.count("*").alias("n_images"), *[F.avg(c).alias(f"avg_{n}") for n, c in averages.items()])


def ranked(rows: DataFrame, keys: Sequence[str] = RANKING, then: Sequence[str] = ()) -> DataFrame:
    """rows in ranking order; what is equal in all keys goes by the parameters named in `then`."""
    return rows.orderBy(*[F.col(k[1:]).asc() if k.startswith("-") else F.col(k).desc() for k in keys], *then)


def best(rows: DataFrame, keys: Sequence[str] = RANKING, then: Sequence[str] = (), k: int = 1) -> DataFrame:
    return ranked(rows, keys, then).limit(k)


def ties(rows: DataFrame, score: str = "score") -> DataFrame:
    """One row: the best score and the number of rows that have it."""
    top = rows.agg(F.max(score).alias("best"))
    return rows.join(F.broadcast(top)).groupBy("best").agg(F.count_if(F.abs(F.col(score) - F.col("best")) < TIE).alias("n_ties"))
