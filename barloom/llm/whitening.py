"""Whitening of embeddings by MLlib's singular value decomposition of the centred, distributed rows.

Entries become whole numbers ``floor(SCALE * c) + SHIFT``. The fit list has each distinct vector x once; n is its
length and S the sum in each dimension. Centred rows ``(n x - S) / n`` are exact up to one rounding, as ``n x - S`` is a
whole number. ``RowMatrix.computeSVD`` of them is asked for all dimensions, so that it decomposes the Gramian (which it sums
over the rows by a tree of tasks) with LAPACK to double precision; its iterative way would stop at 1e-10. A singular
value s gives the eigenvalue ``s^2 / n`` of the covariance. The total variance doesn't come from there, but from the
exact deviations ``sum (n x - S)^2`` of all rows, summed as decimals, over ``n^3``.

What reaches the driver is bounded by the dimension: sums, the Gramian, the components and their covariance.

Defined cases: vectors that are null or hold null or non-finite entries are dropped; shorter vectors count as filled
up with entries of 0; entries beyond ``MOST`` are held there; repeated rows count once in the fit and are all
returned; components without variance (of copies of one vector, or beyond the rank) are not returned, so a table of one
distinct vector, of empty vectors or of none gives no row; a deviation beyond a long is null. Other columns, vec_id
included, may hold anything; vec_id is returned as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tidy, materialize
from .pivot_search import usable

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
MOST = 1 << 40
RANK = 1e-7  # singular values below this share of the largest are rounding of the Gramian


def _whole(dim: int) -> Column:
    entry = lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE), F.lit(MOST)), F.lit(-MOST)) + F.lit(SHIFT)
    x = F.transform("embedding", entry)
    return F.concat(x, F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(dim) - F.size(x)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """``n x - S`` and each row's sum of its squares, exact: in 64 bits where they fit, else in Python's numbers."""
    total = np.array(sums, object)
    far = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums), default=0)
    if far < 1 << 62:
        off = n * x - total.astype("i8")
        most = int(np.abs(off).max(initial=0))
        if most * most * max(1, len(sums)) < 1 << 62:
            return off.astype("f8"), (off * off).sum(1).tolist()
        off = off.astype(object)
    else:
        off = n * x.astype(object) - total
    return off.astype("f8"), [sum(v * v for v in map(int, row)) for row in off]


def _sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum in each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            n += len(x)
            total = [a + b for a, b in zip(total, x.sum(0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dim + 1), pa.int32()), pa.array([str(v) for v in (*total, n)])], ["d", "part"]
        )

    parts = fit.select("x").mapInArrow(partial, "d int, part string")
    rows = parts.groupBy("d").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("v")).orderBy("d").collect()  # one a dimension
    return int(rows[-1]["v"]), [int(r["v"]) for r in rows[:-1]]


def _centred(fit: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """Each row's centred vector and its deviation."""
    dim = len(sums)

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, dev = deviations(_matrix(batch.column(0), dim), n, sums)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, off.size + 1, dim, dtype="i4")), pa.array((off / n).ravel()))
            yield pa.RecordBatch.from_arrays([rows, pa.array([str(v) for v in dev])], ["centred", "dev"])

    return fit.select("x").mapInArrow(centre, "centred array<double>, dev string")


def _identity_error(centred: DataFrame, n: int, shape: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = shape.shape[1]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, total = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = _matrix(batch.column(0), shape.shape[0]) @ shape
            gram += w.T @ w
            total += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k + k), pa.int32()), pa.array(np.concatenate([gram.ravel(), total]))], ["at", "v"])

    parts = centred.select("centred").mapInArrow(products, "at int, v double")
    rows = parts.groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()  # a few hundred numbers
    v = np.array([r["v"] for r in rows]) / n
    gram, mean = v[: k * k].reshape(k, k), v[k * k :]
    return float(np.abs(gram - np.outer(mean, mean) - np.eye(k)).max())


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` of every usable row and component."""
    spark = table.sparkSession
    kind = table.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    with Tidy() as tidy:
        good = table.where(usable("embedding")).select("vec_id", "embedding")
        dim = good.agg(F.max(F.size("embedding"))).first()[0] or 0
        if not dim:
            return spark.createDataFrame([], schema)
        x = good.select("vec_id", _whole(dim).alias("x"))
        fit = materialize(x.select("x").distinct(), "whitening-fit")  # copies meet before the shuffle
        n, sums = _sums(fit, dim)
        centred = materialize(_centred(fit, n, sums), "whitening-centred")
        spread = int(centred.agg(F.sum(F.col("dev").cast("decimal(38,0)"))).first()[0])
        if not spread:
            return spark.createDataFrame([], schema)
        vectors = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("centred").alias("v")), "v")
        svd = RowMatrix(vectors).computeSVD(dim, computeU=False, rCond=RANK)
        k = min(components, len(svd.s))
        eigen = np.array(svd.s.toArray()[:k]) ** 2 / n
        axes = svd.V.toArray()[:, :k]
        axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])
        variance = spread / n**3
        shape, explained = axes / np.sqrt(eigen), eigen / variance
        error = _identity_error(centred, n, shape)

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                off, dev = deviations(_matrix(batch.column(1), dim), n, sums)
                rows = np.repeat(np.arange(len(off)), k)
                fits = [v if v < 1 << 63 else None for v in dev]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), len(off))),
                     pa.array(np.full(len(rows), n, "i8")), pa.array(fits, pa.int64()).take(pa.array(rows)),
                     pa.array(((off / n) @ shape).ravel()), pa.array(np.tile(explained, len(off))), pa.array(np.full(len(rows), error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

        out = x.mapInArrow(project, schema)
    return out
