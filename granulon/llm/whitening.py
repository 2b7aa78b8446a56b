"""Whitening of embeddings by the eigenvectors of their covariance.

Entries are put on a grid of whole numbers, so that sums, means and squared distances are exact. Every
different vector counts once. Rows are centred before they are multiplied: n*x - S is a whole number,
and its quotient by n is the only rounding. The covariance is the Gramian matrix of the centred rows
(RowMatrix), which needs one d x d matrix a task and on the driver, whatever the number of rows; its
eigenvectors are found on the driver and sent to the tasks that whiten.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulon.llm.common import shared_folder

#: An entry c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Grid values are below this, so that doubles and sums of a batch hold them exactly.
LARGEST = 2**40
#: Components whose variance is below this share of the largest one are rounding errors of none.
LEAST_SHARE = 1e-12


@dataclass(frozen=True)
class Model:
    """What whitening needs: n different vectors, their sums by dimension, components in columns."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n*x - S of each row, exact: as 64-bit integers where these hold it, or else as Python's."""
        sums = np.array(self.sums, object)
        # |n*x - S| <= n * |x| + |S|, and the products by themselves have to fit too.
        top = self.n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in self.sums), default=0)
        return x * self.n - sums.astype(np.int64) if top < 2**63 else x.astype(object) * self.n - sums

    def deviation(self, centred: np.ndarray) -> np.ndarray:
        """The sum of squares of each row of n*x - S, exact; beyond a long it is an error."""
        top = int(np.abs(centred).max(initial=0))
        if top * top * centred.shape[1] >= 2**63:
            wide = (centred.astype(object) ** 2).sum(axis=1)
            if max(wide, default=0) >= 2**63:
                raise OverflowError("a squared distance passes 64 bits")
            return wide.astype(np.int64)
        return (centred * centred).sum(axis=1).astype(np.int64)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ (self.components / np.sqrt(self.variances))


def on_grid(df: DataFrame, vector_col: str, out: str = "x") -> DataFrame:
    """The rows whose vector and entries are all there and finite, with the grid's whole numbers in `out`."""
    finite = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df.where(F.col(vector_col).isNotNull()).where(finite).withColumn(out, F.transform(vector_col, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + SHIFT))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    if any(len(r) != width for r in rows):
        raise ValueError(f"a vector of another length than {width}")
    x = np.stack(rows.to_numpy()).astype(np.int64) if len(rows) else np.empty((0, width), np.int64)
    if np.abs(x).max(initial=0) >= LARGEST:
        raise OverflowError(f"a grid value of {LARGEST} or more")
    return x


def _sums(vectors: DataFrame, width: int) -> tuple[int, tuple[int, ...]]:
    """The number of vectors and their exact sums by dimension: a partial sum a batch, added up as decimals."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(width, object)
        for batch in batches:
            n, total = n + len(batch), total + _matrix(batch["x"], width).sum(axis=0).astype(object)
        yield pd.DataFrame({"d": range(-1, width), "s": [str(s) for s in (n, *total)]})

    found = vectors.select("x").mapInPandas(run, "d int, s string").groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect()  # a row a dimension
    by = {r[0]: int(r[1]) for r in found}
    return by.get(-1, 0), tuple(by.get(d, 0) for d in range(width))


def _gramian(rows: DataFrame) -> np.ndarray:
    """The sum of outer products of the rows' array `r`."""
    vectors = MLUtils.convertVectorColumnsToML(rows, "r") if dict(rows.dtypes)["r"] == "vector" else rows.select(array_to_vector("r").alias("r"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "r")).computeGramianMatrix().toArray()


def _mapped(vectors: DataFrame, width: int, make) -> DataFrame:
    """make(matrix of a batch) as an array column `r`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"r": list(make(_matrix(batch["x"], width)))})

    return vectors.select("x").mapInPandas(run, "r array<double>")


def fit(vectors: DataFrame, most: int = 16) -> Model | None:
    """The model of a table of different grid vectors `x`, read three times, so it should be stored; None without rows."""
    first = vectors.select(F.size("x")).first()
    if first is None:
        return None
    width = first[0]
    n, sums = _sums(vectors, width)
    plain = Model(n, sums, np.empty((width, 0)), np.empty(0), 0.0)
    if not width:
        return plain
    covariance = _gramian(_mapped(vectors, width, lambda x: (plain.centred(x) / n).astype(np.float64))) / n
    values, columns = np.linalg.eigh(covariance)
    trace = float(np.trace(covariance))
    order = [k for k in range(width - 1, -1, -1) if values[k] > LEAST_SHARE * max(values[-1], 0.0)][:most]
    return Model(n, sums, columns[:, order], values[order], trace)


def identity_error(vectors: DataFrame, model: Model) -> float:
    """The largest absolute entry of the covariance of the whitened vectors, less the identity; measured on all of them."""
    if not len(model.variances):
        return 0.0
    width, k = len(model.sums), len(model.variances)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(k)
        for batch in batches:
            total += model.whitened(model.centred(_matrix(batch["x"], width))).sum(axis=0)
        yield pd.DataFrame({"d": range(k), "s": total})

    found = vectors.select("x").mapInPandas(run, "d int, s double").groupBy("d").agg(F.sum("s")).collect()  # a row a component
    mean = np.array([s for _, s in sorted(tuple(r) for r in found)]) / model.n
    gramian = _gramian(_mapped(vectors, width, lambda x: model.whitened(model.centred(x)) - mean))
    return float(np.abs(gramian / model.n - np.eye(k)).max())


def transform(rows: DataFrame, model: Model, id_col: str = "vec_id") -> DataFrame:
    """(id, deviation, whitened array) of each row with grid vectors `x`."""
    kind = rows.schema[id_col].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(model)  # d x 16 numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            centred = model.centred(_matrix(batch["x"], len(model.sums)))
            yield pd.DataFrame({id_col: batch[id_col], "deviation": model.deviation(centred), "whitened": list(model.whitened(centred))})

    return rows.select(id_col, "x").mapInPandas(run, f"`{id_col}` {kind}, deviation bigint, whitened array<double>")


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 16, folder: str | None = None) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each row and each of `most` components.

    Rows whose vector is null, or holds a null or an entry that isn't finite, are dropped. Repeated vectors count once
    in the fit and have rows of their own in the result; null ids stay. A table without other vectors than one has no
    components, so no rows, and so has an empty one. Components without variance are left out. Vectors of several
    lengths are an error. Other columns are left out. The different vectors are written in `folder`, or a new one
    beneath the shared one.
    """
    spark: SparkSession = df.sparkSession
    # A column of ours can't clash: only the id and the vector are kept.
    kind = df.schema[id_col].dataType.simpleString()
    rows = on_grid(df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vector_col}`").alias("v")), "v").select("_id", "x")
    folder = folder or f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    rows.select("x").distinct().write.parquet(folder)
    vectors = spark.read.parquet(folder)
    model = fit(vectors, most)
    if model is None or not len(model.variances):
        return spark.createDataFrame([], f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    error = identity_error(vectors, model)
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.variances])
    each = transform(rows, model, "_id").select("_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select(
        F.col("_id").alias(id_col), (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("k") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
