"""Whitening of embeddings: components from MLlib's SVD of centred rows, with the divisor n.

Entries become whole numbers, so sums and deviations are exact. Centred rows n * x - S are whole numbers too; divided by
n they are the rows of a distributed matrix whose right singular vectors are the covariance's eigenvectors, and a
singular value s stands for the variance s * s / n. The total variance isn't read off the singular values but summed
from the exact deviations, so shares of variance hold whether all components are taken or some.

The rows are read anew in each pass and never written; what comes to the driver has as many numbers as a vector has
entries, or components times entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallkeeper.llm.common import small_batches

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
FULL = 2000  # up to so many entries all singular vectors are computed, which is exact; beyond, the first ones only
LEAST = 1e-6  # smaller singular values, as a share of the largest, are rounding
LARGEST = 1.7976931348623157e308
WHOLE = 2**63


@dataclass(frozen=True)
class Model:
    """n vectors with exact sums per entry; components as columns, largest variance first, and the total variance."""

    n: int
    size: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total: float


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id and vec of the rows whose vector is there and has finite entries only. Other columns are ignored."""
    kept = F.forall("vec", lambda v: F.coalesce(v.between(-LARGEST, LARGEST), F.lit(False)))
    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec is not null").where(kept)


def whole(vec: pa.Array, size: int) -> np.ndarray:
    """The rows x = floor(SCALE * entry) + SHIFT."""
    x = np.floor(vec.flatten().to_numpy(zero_copy_only=False) * SCALE)
    if len(x) and np.abs(x).max() >= 2.0**62:
        raise OverflowError("an entry is too large for a whole number of 64 bits")
    return x.astype(np.int64).reshape(-1, size) + SHIFT


def _each(rows: DataFrame, schema: str, make: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(make(batch), names)

    return small_batches(rows).mapInArrow(run, schema)


def _totals(rows: DataFrame, size: int, values: Callable[[pa.RecordBatch], np.ndarray], numbers: int, kind: str) -> np.ndarray:
    """Sums of the columns of values(batch), added up per task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            own = values(batch)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(numbers), pa.int32()), pa.array(total)], ["k", "v"])

    sums = small_batches(rows).mapInArrow(run, f"k int, v {kind}").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(numbers, np.int64 if kind == "long" else np.float64)
    for r in sums:
        out[r["k"]] = r["v"]
    return out


def _deviations(d: np.ndarray) -> pa.Array:
    """Sums of squares of whole rows, exact: in 64 bits where these suffice, else in Python's integers."""
    top = float(np.abs(d).max()) if d.size else 0.0
    if d.shape[1] * top * top < WHOLE / 2:
        return pa.array((d * d).sum(axis=1)).cast(pa.decimal128(38, 0))
    wide = d.astype(object)
    return pa.array([int(v) for v in (wide * wide).sum(axis=1)], pa.decimal128(38, 0))


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS) -> Model | None:
    """The components of all usable vectors of the commonest length (of lengths as common, the largest), None without
    any. There are `most` at most, fewer if vectors are shorter or vary in fewer directions: a direction with less than
    LEAST squared of the largest variance has none. A component's largest entry by size is positive."""
    rows = usable(vectors, id_col, vec_col)
    found = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if not found or not found["size"]:
        return None
    size, n = found["size"], found["count"]
    rows = rows.where(F.size("vec") == size)
    top = int(rows.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v))))).first()[0] * SCALE) + SHIFT + 1
    if 2 * n * top >= WHOLE:
        raise OverflowError("n times an entry is too large for a whole number of 64 bits")
    sums = _totals(rows, size, lambda b: whole(b.column("vec"), size).sum(axis=0), size, "long")
    spread = _each(rows, "deviation decimal(38,0)", lambda b: [_deviations(n * whole(b.column("vec"), size) - sums)]).agg(F.sum("deviation")).first()[0]
    if not spread:
        return Model(n, size, sums, np.zeros((size, 0)), np.zeros(0), 0.0)

    def centred(b: pa.RecordBatch) -> list[pa.Array]:
        d = (n * whole(b.column("vec"), size) - sums) / n
        return [pa.ListArray.from_arrays(np.arange(0, d.size + 1, size, dtype=np.int32), pa.array(d.ravel()))]

    matrix = _each(rows, "row array<double>", centred).select(array_to_vector("row").alias("row"))
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(matrix, "row"), n, size).computeSVD(size if size <= FULL else min(most, size), computeU=False, rCond=LEAST)
    variances = (svd.s.toArray() ** 2 / n)[:most]
    components = svd.V.toArray()[:, : len(variances)]
    signs = np.sign(components[np.abs(components).argmax(axis=0), np.arange(len(variances))])
    return Model(n, size, sums, components * signs, variances, float(Fraction(int(spread), n**3)))


def _projected(model: Model, x: np.ndarray) -> np.ndarray:
    return ((model.n * x - model.sums) / model.n) @ model.components / np.sqrt(model.variances)


def whiten(vectors: DataFrame, model: Model | None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id_col, deviation (decimal, exact: the squared distance from the mean, times n squared), whitened (array of one
    number per component).

    Rows that are null, hold null or non-finite entries or are of another length than the model's have no result; all
    others have one each, repeated ones and those without an id too. An empty table gives no rows."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, deviation decimal(38,0), whitened array<double>"
    if model is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    rows = usable(vectors, id_col, vec_col).where(F.size("vec") == model.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = whole(b.column("vec"), model.size)
            y = _projected(model, x)
            k = y.shape[1]
            lists = pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * k, pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), _deviations(model.n * x - model.sums), lists], ["id", "deviation", "whitened"])

    return small_batches(rows).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def identity_error(vectors: DataFrame, model: Model | None, id_col: str = "vec_id", vec_col: str = "embedding") -> float | None:
    """The largest entry by size of the whitened vectors' covariance (divisor n, centred first) minus the identity."""
    if model is None or not len(model.variances):
        return None
    rows, k = usable(vectors, id_col, vec_col).where(F.size("vec") == model.size), len(model.variances)
    mean = _totals(rows, model.size, lambda b: _projected(model, whole(b.column("vec"), model.size)).sum(axis=0), k, "double") / model.n

    def products(b: pa.RecordBatch) -> np.ndarray:
        y = _projected(model, whole(b.column("vec"), model.size)) - mean
        return (y.T @ y).ravel()

    return float(np.abs(_totals(rows, model.size, products, k * k, "double").reshape(k, k) / model.n - np.eye(k)).max())
