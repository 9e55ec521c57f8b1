"""Exact top-k search by inner product over a pivot-distance index.

Components become ``floor(SCALE * x)``. As ``2 q.y = |q|^2 + |y|^2 - |q - y|^2``, a vector far from the query scores
low, and the triangle inequality bounds the distance from below: for a pivot p,
``|q - y| >= | |q - p| - |y - p| |``.

Every vector is keyed by its nearest pivot and its distance to it, range-sorted by that key and packed into blocks of
up to ``BLOCK`` vectors. Equal slices of a pivot's distances are its annuli; of each the least and largest distance
and the largest norm are known. There are ``PIVOTS * ANNULI`` annuli at most, whatever the table's size, so their
summary is the one thing that reaches the driver and every task. A query takes annuli in order of their bounds, a
few at first and more in each round, and stops when the next bound is below its k-th best score. Pivots are a bounded
sample of distinct vectors; they decide how much is skipped, never what is found.

Queries that lie together travel as one chunk and meet a block in one matrix product, by an equality join on
(annulus, slot). An annulus with many blocks has many slots, so that a vector in a third of all rows is spread.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as
filled up with zeros, so empty ones score 0; a row is never its own match, but a row with the same vec_id is
another row; rows with a null vec_id are no queries of the default kind, and come last among ties; equal vec_ids
tie in the table's order. Scores are exact; beyond a long they are held at its ends. An empty table gives no row.
Only vec_id and embedding are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tidy, batch_rows, discard, is_empty, materialize, shuffle_width

SCALE, TOP = 256, 5
#: Bounds of the index: pivots, annuli a pivot, vectors a block, queries a chunk, numbers in any of their matrices.
PIVOTS, ANNULI, BLOCK, CHUNK, NUMBERS = 256, 64, 1024, 512, 1 << 20
#: Annuli that a query has visited after each round.
FIRST_VISIT, MORE = 2, 8
BLOCKS_A_SLOT = 4
VECTORS_A_BATCH, BLOCKS_A_BATCH = 2048, 16
_EXACT = 2.0**53
LEAST = -(1 << 63)
_SLACK = 1e-9  # of the squared norms: far above rounding, far below a step of the score
_INTEGERS = (("i2", 2.0**15), ("i4", 2.0**31))


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    plain = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col(vector).isNotNull() & F.forall(F.col(vector).cast("array<double>"), plain)


def pack(matrix: np.ndarray) -> bytes:
    """A matrix of whole numbers in the least width that holds them, which the first byte names."""
    most = float(np.abs(matrix).max(initial=0.0))
    for code, (kind, limit) in enumerate(_INTEGERS):
        if most < limit:
            return bytes([code]) + matrix.astype(kind).tobytes()
    return bytes([len(_INTEGERS)]) + matrix.astype("f8").tobytes()


def unpack(data: bytes, dim: int) -> np.ndarray:
    kind = (*(k for k, _ in _INTEGERS), "f8")[data[0]]
    flat = np.frombuffer(data, kind, offset=1).astype("f8")
    return flat.reshape(-1, dim) if dim else np.zeros((0, 0))


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of doubles as rows of ``dim`` numbers, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths(), "i8")
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < size[:, None]] = np.asarray(column.flatten(), "f8")
    return out


@dataclass
class PivotIndex:
    """Blocks of keyed vectors, and the bounded summary of the annuli."""

    blocks: DataFrame
    dim: int
    pivots: np.ndarray
    annuli: np.ndarray  # a row each: pivot, annulus, least distance, largest distance, largest squared norm, slots


def _pivots(vectors: DataFrame, count: int, dim: int) -> np.ndarray:
    """``count`` distinct vectors, those with the least hashes."""
    hashed = vectors.withColumn("h", F.xxhash64("embedding"))
    least = hashed.select("h").distinct().orderBy("h").limit(count)
    chosen = hashed.join(F.broadcast(least), "h").groupBy("h").agg(F.min("embedding").alias("embedding")).orderBy("h")
    rows = [r["embedding"] for r in chosen.collect()]  # at most PIVOTS
    out = np.zeros((len(rows), dim))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return np.floor(SCALE * out)


def build_index(table: DataFrame, is_query: Column) -> PivotIndex:
    """The index of ``table(vec_id, embedding)``; ``is_query`` marks the rows that search() asks for."""
    vectors = (
        table.where(usable("embedding"))
        .select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    )
    about = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    n, dim = about["n"], about["dim"] or 0
    size = max(1, min(BLOCK, NUMBERS // max(1, dim)))
    wanted = min(PIVOTS, max(1, NUMBERS // max(1, dim)), max(1, int(np.sqrt(n / size))))
    pivots = _pivots(vectors, wanted, dim)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = (pivots**2).sum(1)
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                y = np.floor(SCALE * matrix_of(part.column(1), dim))
                near = np.argmin(norms - 2 * (y @ pivots.T), axis=1)
                r = np.sqrt(((y - pivots[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(near, pa.int32()), pa.array(r),
                     pa.array((y**2).sum(1)), pa.array([pack(row[None]) for row in y], pa.binary())],
                    ["vec_id", "asks", "row", "pivot", "r", "norm", "data"],
                )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def block() -> pa.RecordBatch:
            held.sort(key=lambda v: (v["vec_id"] is None, v["vec_id"], v["row"]))
            y = np.concatenate([unpack(v["data"], dim) for v in held]) if dim else np.zeros((len(held), 0))
            out = {
                "pivot": held[0]["pivot"], "lo": min(v["r"] for v in held), "hi": max(v["r"] for v in held),
                "norm": max(v["norm"] for v in held), "ids": [v["vec_id"] for v in held],
                "rows": [v["row"] for v in held], "asks": [v["asks"] for v in held], "data": pack(y),
            }
            held.clear()
            return pa.RecordBatch.from_pylist([out], schema=kind)

        kind = pa.schema([
            ("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("norm", pa.float64()),
            ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("asks", pa.list_(pa.bool_())), ("data", pa.binary()),
        ])
        for batch in batches:
            for vector in batch.to_pylist():
                if held and (vector["pivot"] != held[0]["pivot"] or len(held) == size):
                    yield block()
                held.append(vector)
        if held:
            yield block()

    rows = vectors.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        keyed, "vec_id long, asks boolean, row long, pivot int, r double, norm double, data binary"
    )
    # The row is part of the key: copies of one vector have equal distances, and are still dealt to many tasks.
    rows = rows.repartitionByRange(shuffle_width(table.sparkSession), "pivot", "r", "row").sortWithinPartitions("pivot", "r", "row")
    blocks = rows.mapInArrow(
        packed, "pivot int, lo double, hi double, norm double, ids array<long>, rows array<long>, asks array<boolean>, data binary"
    )
    blocks = materialize(blocks.withColumn("block", F.monotonically_increasing_id()), "pivot-blocks")
    reach = blocks.groupBy("pivot").agg(F.min("lo").alias("first"), F.max("lo").alias("last"))  # a row a pivot
    share = F.when(F.col("last") > F.col("first"), (F.col("lo") - F.col("first")) / (F.col("last") - F.col("first"))).otherwise(0.0)
    blocks = blocks.join(F.broadcast(reach), "pivot").withColumn("annulus", F.least(F.floor(share * ANNULI), F.lit(ANNULI - 1)).cast("int"))
    summary = blocks.groupBy("pivot", "annulus").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("norm").alias("norm"),
        F.ceil(F.count("*") / BLOCKS_A_SLOT).cast("double").alias("slots"),
    )
    slots = summary.select("pivot", "annulus", "slots")
    blocks = blocks.join(F.broadcast(slots), ["pivot", "annulus"]).withColumn("slot", F.pmod(F.xxhash64("block"), F.col("slots").cast("long")))
    found = summary.orderBy("pivot", "annulus").collect()  # at most PIVOTS * ANNULI
    return PivotIndex(blocks.drop("first", "last", "slots"), dim, pivots, np.array([tuple(r) for r in found], "f8").reshape(-1, 6))


def _chunks(index: PivotIndex) -> DataFrame:
    """``(chunk, qrows, qids, data)``: the queries of neighbouring blocks."""
    dim, limit = index.dim, max(1, min(CHUNK, NUMBERS // max(1, index.dim)))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[int] = []
        ids: list[int] = []
        parts: list[np.ndarray] = []
        last = None

        def chunk() -> pa.RecordBatch:
            out = [pa.array([x], t) for x, t in ((rows[:], pa.list_(pa.int64())), (ids[:], pa.list_(pa.int64())), (pack(np.concatenate(parts)), pa.binary()))]
            for x in (rows, ids, parts):
                x.clear()
            return pa.RecordBatch.from_arrays(out, ["qrows", "qids", "data"])

        for batch in batches:
            for b in batch.to_pylist():
                asks = np.array(b["asks"], bool)
                if rows and (b["pivot"] != last or len(rows) + int(asks.sum()) > limit):
                    yield chunk()
                last, which = b["pivot"], np.flatnonzero(asks)
                y = unpack(b["data"], dim) if dim else np.zeros((len(asks), 0))
                for at in range(0, len(which), limit):
                    some = which[at : at + limit]
                    if rows and len(rows) + len(some) > limit:
                        yield chunk()
                    rows += [b["rows"][i] for i in some]
                    ids += [b["ids"][i] for i in some]
                    parts.append(y[some])
        if rows:
            yield chunk()

    asking = index.blocks.where(F.exists("asks", lambda x: x)).select("pivot", "asks", "rows", "ids", "data")
    return asking.mapInArrow(gathered, "qrows array<long>, qids array<long>, data binary")


def _bounds(q: np.ndarray, pivots: np.ndarray, annuli: np.ndarray) -> np.ndarray:
    """No vector of an annulus (column) scores higher with the query (row)."""
    own = (q**2).sum(1)
    away = np.sqrt(np.maximum(own[:, None] + (pivots**2).sum(1) - 2 * (q @ pivots.T), 0.0))
    d = away[:, annuli[:, 0].astype("i8")]
    lo, hi, norm = annuli[:, 2], annuli[:, 3], annuli[:, 4]
    total = own[:, None] + norm
    # The rounding of |q - p| is largest where it is nearly 0: its square errs by about 1e-16 of the norms.
    gap = np.maximum(0.0, np.maximum(lo - d, d - hi) - 1e-7 * np.sqrt(total))
    return (total - gap**2) / 2 + _SLACK * total + 1e-6


def _asked(index: PivotIndex, chunks: DataFrame, begin: int, end: int) -> DataFrame:
    """A row for each chunk and slot of an annulus that one of its queries visits in this round."""
    dim, pivots, annuli = index.dim, index.pivots, index.annuli

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([
            ("pivot", pa.int32()), ("annulus", pa.int32()), ("slot", pa.int64()), ("chunk", pa.int64()),
            ("qrows", pa.list_(pa.int64())), ("qids", pa.list_(pa.int64())), ("taus", pa.list_(pa.int64())), ("queries", pa.binary()),
        ])
        for batch in batches:
            for c in batch.to_pylist():
                q = unpack(c["data"], dim) if dim else np.zeros((len(c["qrows"]), 0))
                tau_of = {t["qrow"]: t["tau"] for t in c["known"] or []}
                tau = np.array([tau_of.get(r, LEAST) for r in c["qrows"]], "i8")
                wanted = np.zeros((len(q), len(annuli)), bool)
                for at in range(0, len(q), 64):
                    some = slice(at, at + 64)
                    bound = _bounds(q[some], pivots, annuli)
                    order = np.argsort(-bound, axis=1, kind="stable")[:, begin:end]
                    fits = np.take_along_axis(bound, order, 1) >= tau[some, None]
                    np.put_along_axis(wanted[some], order, fits, 1)
                for a in np.flatnonzero(wanted.any(0)):
                    mine = np.flatnonzero(wanted[:, a])
                    row = {
                        "pivot": int(annuli[a, 0]), "annulus": int(annuli[a, 1]), "chunk": c["chunk"], "qrows": [c["qrows"][i] for i in mine],
                        "qids": [c["qids"][i] for i in mine], "taus": tau[mine].tolist(), "queries": pack(q[mine]),
                    }
                    for slot in range(int(annuli[a, 5])):
                        yield pa.RecordBatch.from_pylist([row | {"slot": slot}], schema=kind)

    return chunks.mapInArrow(
        pairs, "pivot int, annulus int, slot long, chunk long, qrows array<long>, qids array<long>, taus array<long>, queries binary"
    )


def _exact_scores(q: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers that a double can't hold."""
    whole = lambda m: [[int(x) for x in row] for row in m]
    right, ends = whole(y), (LEAST, -LEAST - 1)
    return np.array([[min(max(sum(a * b for a, b in zip(u, v, strict=True)), ends[0]), ends[1]) for v in right] for u in whole(q)], "i8")


def best_in_block(q: np.ndarray, qrows: np.ndarray, tau: np.ndarray, y: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, place and score of each query's ``k`` best in a block whose rows are in the order of ties."""
    fits = np.sqrt((q**2).sum(1).max(initial=0) * (y**2).sum(1).max(initial=0)) < _EXACT / 4
    s = (q @ y.T).astype("i8") if fits else _exact_scores(q, y)
    ok = (qrows[:, None] != rows[None, :]) & (s >= tau[:, None])
    s = np.where(ok, s, LEAST)
    if s.shape[1] > k:
        cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        ok &= s >= cut[:, None]
    i, j = np.nonzero(ok)
    score = s[i, j]
    order = np.lexsort((j, ~score, i))  # ~ turns the order round, without overflow
    i, j, score = i[order], j[order], score[order]
    first = np.searchsorted(i, i)
    kept = np.arange(len(i)) - first < k
    return i[kept], j[kept], score[kept]


def _matches(index: PivotIndex, asked: DataFrame, k: int) -> DataFrame:
    dim = index.dim

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                m = batch.slice(at, 1).to_pydict()
                qrows, rows = np.array(m["qrows"][0], "i8"), np.array(m["rows"][0], "i8")
                q, y = (unpack(m[c][0], dim) if dim else np.zeros((n, 0)) for c, n in (("queries", len(qrows)), ("data", len(rows))))
                i, j, score = best_in_block(q, qrows, np.array(m["taus"][0], "i8"), y, rows, k)
                ids, qids = m["ids"][0], m["qids"][0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), m["chunk"][0], "i8")), pa.array(qrows[i]), pa.array([qids[x] for x in i], pa.int64()),
                     pa.array([ids[x] for x in j], pa.int64()), pa.array(rows[j]), pa.array(score)],
                    ["chunk", "qrow", "query_id", "vec_id", "row", "score"],
                )

    blocks = index.blocks.select("pivot", "annulus", "slot", "ids", "rows", "data")
    joined = asked.join(blocks, ["pivot", "annulus", "slot"]).select("chunk", "qrows", "qids", "taus", "queries", "ids", "rows", "data")
    return joined.mapInArrow(scored, "chunk long, qrow long, query_id long, vec_id long, row long, score long")


def search(index: PivotIndex, k: int = TOP) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best of all other rows for every row that asks."""
    chunks = materialize(_chunks(index).withColumn("chunk", F.monotonically_increasing_id()), "query-chunks")
    spark, best, begin, end = chunks.sparkSession, None, 0, FIRST_VISIT
    order = W.partitionBy("qrow").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    while begin < len(index.annuli):
        now = chunks.withColumn("known", F.lit(None).cast("array<struct<qrow:long,tau:long>>"))
        if best is not None:
            known = best.where(F.col("rank") == k).groupBy("chunk").agg(  # at most CHUNK a chunk
                F.collect_list(F.struct("qrow", F.col("score").alias("tau"))).alias("known")
            )
            now = chunks.join(known, "chunk", "left")
        asked = materialize(_asked(index, now, begin, end), "asked")
        if is_empty(asked):
            discard(asked)
            break
        found = _matches(index, asked, k)
        found = found if best is None else found.unionByName(best.drop("rank"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        after = materialize(ranked, "best")
        for gone in (asked, best):
            if gone is not None:
                discard(gone)
        best, begin, end = after, end, end * MORE
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def top_matches(table: DataFrame, k: int = TOP, is_query: Column | None = None) -> DataFrame:
    """The ``k`` highest inner products of every query row (by default: vec_id divisible by 50) with all other rows."""
    with Tidy() as tidy, batch_rows(table.sparkSession, VECTORS_A_BATCH):
        index = build_index(table, F.col("vec_id") % 50 == 0 if is_query is None else is_query)
        with batch_rows(table.sparkSession, BLOCKS_A_BATCH):
            out = materialize(search(index, k), "top-matches")
        tidy.keep(out)
    return out
