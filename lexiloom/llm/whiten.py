"""Whitened embeddings: exact centring, a distributed Gram matrix, a local eigendecomposition.

An entry c becomes the integer floor(1024 c) + 100000. With n vectors and the sums S of each dimension, n x - S is a
vector's deviation from the mean in exact integers; it is divided by n once, so rows are centred before anything is
multiplied. The covariance is MLlib's RowMatrix.computeGramianMatrix over those rows, divided by n: every task adds
up its own dims x dims triangle, and triangles are merged in a tree. The driver holds that one matrix and its
eigenvectors, never rows. The leading components go to the tasks with the function that projects (mapInPandas), and
a second Gram matrix over the projections measures how far their covariance is from the identity.

Defined results: vectors that are null or hold a null or an entry that isn't finite are left out; so are vectors
shorter than the longest one, which lack entries as if they held nulls. Repeated vec_ids and null ones stay, each row
for itself. Entries whose 1024-fold passes 2**62 count as that bound. `deviation` is exact, and null where it
doesn't fit in a long. Directions without variance (equal vectors, one vector) have whitened and explained 0 and
no part in the identity error. No remaining vector, or vectors without entries, give an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import textkernel as K
from lexiloom.llm.checkpoints import cut, discard
from lexiloom.session import ship

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
LIMIT = 1 << 62
RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Model:
    """What fit() learns: counts and sums of the fit list, and unit eigenvectors by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray  # all eigenvalues
    axes: np.ndarray  # a row for each component

    @property
    def live(self) -> np.ndarray:
        """Whether a component has any variance, beyond rounding."""
        return self.values[: len(self.axes)] > len(self.sums) * np.finfo(float).eps * max(self.values[0], 0.0)

    @property
    def projection(self) -> np.ndarray:
        """dims x components: from centred rows to whitened ones."""
        scale = np.where(self.live, np.sqrt(np.where(self.live, self.values[: len(self.axes)], 1.0)), np.inf)
        return (self.axes / scale[:, None]).T

    @property
    def explained(self) -> np.ndarray:
        total = self.values.sum()
        return np.where(self.live, self.values[: len(self.axes)] / total if total > 0 else 0.0, 0.0)


def grid(rows: DataFrame) -> DataFrame:
    """vec_id and x, the integers of every vector that has entries and only finite ones."""
    entries = F.col("embedding").cast("array<double>")
    finite = ~F.exists("c", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    as_long = F.transform("c", lambda v: F.floor(F.least(F.greatest(v * SCALE, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("bigint") + OFFSET)
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), entries.alias("c")).where(F.col("c").isNotNull() & (F.size("c") > 0) & finite).select("vec_id", as_long.alias("x"))


def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The integers of a batch, a row for each vector."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def column_sums(points: DataFrame, dims: int) -> tuple[int, tuple[int, ...]]:
    """Number of vectors and the exact sum of each dimension; a task sends one row for each dimension and batch."""

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = matrix(batch, dims)
            if not len(x):
                continue
            wide = max(abs(int(x.max())), abs(int(x.min()))) * len(x) >= LIMIT
            total = (x.astype(object) if wide else x).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str(t) for t in total]), pa.array([len(x)] * dims, pa.int64())], ["pos", "total", "n"])

    parts = points.select("x").mapInArrow(add, "pos int, total string, n bigint")
    found = parts.groupBy("pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).orderBy("pos").collect()  # a row a dimension
    return (int(found[0].n), tuple(int(r.total) for r in found)) if found else (0, ())


def off_mean(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n x - S, exact: as int64 where that holds every step, else as Python integers."""
    far = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    if n * far + max(map(abs, sums)) < LIMIT:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squares(off: np.ndarray) -> list[int | None]:
    """Exact sums of squares of each row; None beyond a long."""
    far = int(np.abs(off).max()) if off.size else 0
    if off.dtype != object and far * far * max(off.shape[1], 1) < 1 << 63:
        return (off * off).sum(axis=1).tolist()
    return [s if (s := sum(int(v) * int(v) for v in row)) < 1 << 63 else None for row in off]


def centred(points: DataFrame, n: int, sums: tuple[int, ...]) -> DataFrame:
    """vec_id, deviation and y: (n x - S) / n, rounded once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.begin()
        for batch in it:
            off = off_mean(matrix(batch, len(sums)), n, sums)
            y = (off / n).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(squares(off), pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * len(sums), pa.int32()), pa.array(y.ravel()))], ["vec_id", "deviation", "y"])

    return points.mapInArrow(run, "vec_id bigint, deviation bigint, y array<double>")


def gram(rows: DataFrame, column: str) -> np.ndarray:
    """Y'Y of the rows' arrays."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def fit(rows: DataFrame, n: int, sums: tuple[int, ...], components: int = COMPONENTS) -> Model:
    """The model of centred() rows. Each axis points to where its largest entry is positive."""
    values, vectors = np.linalg.eigh(gram(rows, "y") / n)
    axes = vectors.T[::-1][:components]
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return Model(n, sums, np.maximum(values[::-1], 0.0), axes)


def whiten(rows: DataFrame, model: Model) -> DataFrame:
    """centred() rows with w in place of y: the projection on each component over the root of its eigenvalue."""
    by = model.projection

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            w = np.stack(part["y"].to_numpy()) @ by if len(part) else np.zeros((0, by.shape[1]))
            yield pd.DataFrame({"vec_id": part["vec_id"], "deviation": part["deviation"].astype("Int64"), "w": list(w)})

    return rows.mapInPandas(run, "vec_id bigint, deviation bigint, w array<double>")


def identity_error(rows: DataFrame, model: Model) -> float:
    """Largest absolute entry of the covariance of whiten() rows minus the identity, over components with variance."""
    live = np.flatnonzero(model.live)
    if not len(live):
        return 0.0
    means = rows.agg(*(F.avg(F.element_at("w", int(i) + 1)).alias(f"m{i}") for i in live)).first()
    off = rows.select(F.array(*(F.element_at("w", int(i) + 1) - F.lit(float(m)) for i, m in zip(live, means, strict=True))).alias("w"))
    return float(np.abs(gram(off, "w") / model.n - np.eye(len(live))).max())


def query(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    spark = ship(rows.sparkSession)
    points = grid(rows)
    dims = points.agg(F.max(F.size("x"))).first()[0]
    if not dims:
        return spark.createDataFrame([], RESULT)
    points = points.where(F.size("x") == dims)
    n, sums = column_sums(points, dims)
    near = cut(centred(points, n, sums), "centred")
    model = fit(near, n, sums, components)
    done = cut(whiten(near, model), "whitened")
    discard(near)
    error = identity_error(done, model)
    share = F.array(*(F.lit(float(v)) for v in model.explained))
    each = done.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return each.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", F.get(share, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))
