"""Whitening of embeddings by the covariance of their distinct values.

Entries become whole numbers first, so that means, centred rows and deviations
are exact. The covariance is RowMatrix's Gramian of the centred rows; its
eigenvectors are found on the driver, from a matrix of the vectors' size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import Scratch

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Longest vectors; their covariance is a local matrix of at most 128 MiB.
MOST_DIMENSIONS = 4096
#: Entries beyond it have no exact whole number.
_MOST = 2.0**52
#: An eigenvalue below this share of the largest one, times the dimensions, is rounding.
_EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Whitening:
    """A fit: n distinct vectors with sums by dimension; a column of ``components`` for each eigenvalue."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """id and x, floor(scale * entry) + offset of each entry, for the vectors that take part.

    Null and empty vectors take no part, nor those with null or non-finite
    entries. Entries whose multiple is beyond 2^52 have no exact whole number
    and raise an error.
    """
    v = F.col(vector_col).cast("array<double>")
    sound = (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    message = F.lit(f"an entry is too large for whole numbers at a scale of {scale}")
    x = F.transform(v, lambda c: F.when(F.abs(c * scale) < F.lit(_MOST), F.floor(c * scale).cast("long") + offset).otherwise(F.raise_error(message).cast("long")))
    return rows.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))


def _one_length(rows: DataFrame) -> DataFrame:
    """The rows whose vector has the most frequent length, of several the least."""
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths and lengths.d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {lengths.d} dimensions; the covariance is a local matrix, of at most {MOST_DIMENSIONS}")
    return rows.where(F.size("x") == (lengths.d if lengths else 0))


def _totals(fit_list: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and exact sums by dimension; each task gives one row per dimension, and these are summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                part = _matrix(batch.column(0)).sum(0)
                n, sums = n + batch.num_rows, part if sums is None else sums + part
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums), pa.int64()), pa.array(sums, pa.int64())], names=["i", "n", "s"])

    # Beyond 2^63 the sums raise, as they do in any ANSI session.
    parts = fit_list.select("x").mapInArrow(run, "i int, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    rows = parts.orderBy("i").collect()
    if not rows:
        return 0, np.empty(0, np.int64)
    if max(abs(int(r.s)) for r in rows) >= 1 << 62:
        raise OverflowError("sums by dimension do not fit a long")
    return rows[0].n, np.array([int(r.s) for r in rows], np.int64)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def centred(x: str, n: int, sums: np.ndarray) -> Column:
    """x - S / n of each entry: n * x - S is exact, and divided once."""
    s = F.array(*[F.lit(int(v)).cast("long") for v in sums])
    return F.zip_with(x, s, lambda a, b: (a * F.lit(n).cast("long") - b).cast("double") / F.lit(float(n)))


def gramian(rows: DataFrame, column: str) -> np.ndarray:
    """The sum of outer products of an array column, summed up in the executors as a tree."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors in ``x``; None if there are none.

    Components whose eigenvalue is nothing but rounding are kept, and whiten to
    null: there the vectors do not vary.
    """
    with Scratch(rows.sparkSession) as tables:
        # Distinct values meet by the whole vector; equal ones are combined before the shuffle.
        fit_list = tables.write(rows.select("x").distinct())
        n, sums = _totals(fit_list)
        if not n:
            return None
        cov = gramian(fit_list.select(centred("x", n, sums).alias("c")), "c") / n
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        found = Whitening(n, sums, vectors[:, ::-1][:, :components], values[::-1][:components], float(np.trace(cov)))
        sound = int(_sound(found).sum())
        error = None
        if sound:
            white = whiten(fit_list.withColumn("id", F.lit(0).cast("long")), found).select(F.slice("whitened", 1, sound).alias("w"))
            error = float(np.abs(gramian(white, "w") / n - np.eye(sound)).max())
        return Whitening(n, sums, found.components, found.eigenvalues, found.trace, error)


def _sound(fitted: Whitening) -> np.ndarray:
    return fitted.eigenvalues > max(fitted.eigenvalues[0], 0.0) * len(fitted.sums) * _EPS


def whiten(rows: DataFrame, fitted: Whitening) -> DataFrame:
    """id, deviation and whitened (an array, a place per component) for each row of id and x.

    deviation, the sum of (n * x - S)^2 over dimensions, is exact; it raises
    beyond 2^63. The fit is broadcast: a vector of sums and a matrix of the
    vectors' size times the components, whatever the number of rows.
    """
    sound = _sound(fitted)
    w = np.where(sound, fitted.components / np.sqrt(np.where(sound, fitted.eigenvalues, 1.0)), np.nan)
    shared = rows.sparkSession.sparkContext.broadcast((fitted.n, fitted.sums, w))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, w = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            far = np.stack(pdf.x.to_list()) * n - sums
            if int(np.abs(far).max()) ** 2 * far.shape[1] < 1 << 63:
                deviation = (far * far).sum(1)
            else:
                deviation = (far.astype(object) ** 2).sum(1)
                if max(deviation) >= 1 << 63:
                    raise OverflowError("a deviation does not fit a long")
            white = far / float(n) @ w
            yield pd.DataFrame({"id": pdf.id, "deviation": deviation.astype(np.int64), "whitened": [[None if math.isnan(v) else v for v in r] for r in white.tolist()]})

    return rows.select("id", "x").mapInPandas(run, "id long, deviation long, whitened array<double>")


def whitened_embeddings(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """A row per vector that takes part and component, by falling eigenvalue from 1.

    id, component, n, deviation, whitened (the vector less the mean of the
    distinct ones, projected and divided by the root of the eigenvalue),
    explained (the eigenvalue's share of the trace; null if nothing varies) and
    identity_error (how far the covariance of the distinct whitened vectors is
    from the identity). Vectors of another length than the most frequent one
    (of several the least) take no part, see also whole_vectors(). Repeated and
    null ids stay rows of their own; equal vectors count once in the fit. Other
    columns are ignored. Without a vector the result is empty.
    """
    x = _one_length(whole_vectors(rows, id_col, vector_col, scale, offset))
    fitted = fit(x, components)
    kinds = f"`{id_col}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None:
        return rows.sparkSession.createDataFrame([], kinds)
    share = [float(max(e, 0.0) / fitted.trace) if fitted.trace > 0 else None for e in fitted.eigenvalues]
    shares = F.array(*[F.lit(s).cast("double") for s in share])
    each = whiten(x, fitted).select("id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return each.select(
        F.col("id").alias(id_col),
        (F.col("i") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("i")).alias("explained"),
        F.lit(fitted.identity_error).cast("double").alias("identity_error"),
    )
