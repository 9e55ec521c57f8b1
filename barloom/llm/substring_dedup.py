"""Substring deduplication over a log-structured index of fingerprints.

A window is ``WINDOW`` consecutive words. Of the ``ANCHOR``-word sequences in a window the one with the
least hash is its anchor, so equal windows have equal anchors at equal places; neighbouring windows that
share an anchor make one *stretch*, and there is a stretch for about eight words. The index keeps a row per
distinct stretch: its anchor's fingerprint ``a``, a digest ``c`` of all its words, and where it came first.
``a`` mixes 64-bit hashes of the words; ``c`` verifies a match, as it is another hash of the words' own bytes and shares
nothing with ``a``: stretches that agree in both are taken to be equal. Windows are verified in the same way.
Rows are written as immutable runs, bucketed and sorted by ``(a, c)``.

A new batch becomes a run of its own and is merge-joined with the older runs. A stretch whose ``(a, c)``
came before repeats whole. A new stretch that shares only its anchor with others may repeat in part: such
stretches are read again from the texts and compared window by window. Runs are compacted by merging them
when there are ``FANOUT`` of them. Texts are known by batch and doc_id, so that batches may use the same ids.

Before a shuffle each Arrow batch keeps one row per stretch and marks the others as repeats, so that a passage in
a third of all documents costs a row per batch; the joins and sums that follow are split or pre-aggregated.

Defined cases: words are separated by ASCII white space; null texts and texts under a window have no
windows; overlapping repeats within a document count; earlier means earlier batch, then smaller doc_id, then
earlier start. Rows of one batch with a repeated or null doc_id are separate documents, null first and in the
table's order; a doc_id that an earlier batch had is another document. An empty table gives an empty result. Only doc_id and text are looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, is_empty, materialize, release, shuffle_width

WINDOW, ANCHOR, FANOUT = 20, 6, 4
_SPREAD = WINDOW - ANCHOR + 1  # anchors to choose from in a window; a stretch has as many windows at most
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 16  # bytes that are hashed at once; longer words are hashed by themselves
_OF_BYTE = np.random.default_rng(20).integers(0, 1 << 64, 256, "u8")


_POWERS = [np.ones(1, "u8"), np.ones(1, "u8")]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 4096) * 2
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, "u8")
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype="u8")
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(text: bytes, at: np.ndarray) -> np.ndarray:
    """A hash of each word of a text whose words begin at ``at`` (but for its last place, one after the end) and end a byte
    before the next begins. Sums of byte values times powers, so that all words of a chunk are hashed together."""
    out = np.zeros(len(at) - 1, "u8")
    data, first = np.frombuffer(text, "u1"), 0
    while first < len(out):
        last = max(first + 1, int(np.searchsorted(at, at[first] + _CHUNK, side="right")) - 1)
        begin, end = at[first:last] - at[first], at[first + 1 : last + 1] - 1 - at[first]
        if end[-1] > _CHUNK:
            out[first] = _long_word(text[at[first] : at[first + 1] - 1])
        else:
            power, inverse = _powers(_CHUNK + 1)
            total = np.zeros(end[-1] + 1, "u8")
            np.cumsum(_OF_BYTE[data[at[first] : at[first] + end[-1]]] * power[: end[-1]], out=total[1:])
            out[first:last] = _mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype("u8"))
        first = last
    return out


def _long_word(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, 7)


class Words:
    """The words of a text with hashes of any range of them."""

    def __init__(self, text: str | None):
        self.words = (text or "").encode("utf-8", "surrogatepass").split()
        self.n = len(self.words)
        if self.n >= WINDOW:
            joined = b" ".join(self.words)
            self.bytes, self.at = memoryview(joined), np.zeros(self.n + 1, "i8")
            self.at[1:-1] = np.flatnonzero(np.frombuffer(joined, "u1") == 32) + 1
            self.at[-1] = len(joined) + 1
            own = _word_hashes(joined, self.at)
            power, self.inverse = _powers(self.n + 1)
            self.sums = np.zeros(self.n + 1, "u8")
            np.cumsum(own * power[: self.n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """A hash of the words from ``start`` to before ``stop``, from the words' hashes."""
        return _mix((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def digests(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Another hash of the same, from their bytes."""
        import xxhash

        text, digest = self.bytes, xxhash.xxh3_64_intdigest
        return np.fromiter((digest(text[i:j]) for i, j in zip(self.at[start].tolist(), (self.at[stop] - 1).tolist(), strict=True)), "u8", len(start))

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """a, c, first window and number of windows of every stretch."""
        if self.n < WINDOW:
            none = np.zeros(0, "u8")
            return none, none, none.astype("i8"), none.astype("i8")
        at = np.arange(self.n - ANCHOR + 1)
        grams = self.ranges(at, at + ANCHOR)
        # The least hash of each window, the leftmost of equals: 32 bits of hash over 32 bits of place.
        least = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype("u8")
        span = 1
        while span * 2 <= _SPREAD:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        rest = _SPREAD - span
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        anchor = (least & np.uint64(0xFFFFFFFF)).astype("i8")
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        count = np.diff(first, append=len(anchor))
        where = anchor[first]
        digest = self.digests(first, first + count - 1 + WINDOW)
        digest = _mix(digest ^ _mix((where - first).astype("u8") * np.uint64(64) + count.astype("u8")))
        return grams[where], digest, first, count


def _stretches(docs: DataFrame) -> DataFrame:
    """``(a, c, doc_id, at, local)``: at is 16 times the first window plus the number of windows less one.

    Rows with ``local`` repeat a stretch of the same Arrow batch; they get random keys and travel alone.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a, c, first, count = Words(text.as_py()).stretches()
                parts.append((a, c, np.full(len(a), doc_id, "i8"), first * 16 + count - 1))
            a, c, ids, at = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, "i8")] * 4
            order = np.lexsort((at, ids, c, a))
            a, c, ids, at = a[order], c[order], ids[order], at[order]
            local = np.zeros(len(a), bool)
            local[1:] = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
            a[local] = _mix(ids[local].astype("u8") ^ _mix(at[local].astype("u8")))
            c[local] = 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view("i8")), pa.array(c.view("i8")), pa.array(ids), pa.array(at), pa.array(local)],
                ["a", "c", "doc_id", "at", "local"],
            )

    return docs.select("doc_id", "text").mapInArrow(found, "a long, c long, doc_id long, at long, local boolean")


def _windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(h, v, batch, doc_id, start)``: both hashes of every window of the wanted stretches (batch, doc_id, ats)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            ids, numbers = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            for doc_id, text, ats, number in zip(ids, batch.column(1), batch.column(2), numbers, strict=True):
                words = Words(text.as_py())
                at = ats.values.to_numpy(zero_copy_only=False)
                start = np.concatenate([np.arange(x >> 4, (x >> 4) + (x & 15) + 1) for x in at.tolist()])
                for col, x in zip(cols, (words.ranges(start, start + WINDOW).view("i8"),
                                         words.digests(start, start + WINDOW).view("i8"), np.full(len(start), number, "i8"),
                                         np.full(len(start), doc_id, "i8"), start), strict=True):
                    col.append(x)
            arrays = [pa.array(np.concatenate(c) if c else np.zeros(0, "i8"), pa.int64()) for c in cols]
            yield pa.RecordBatch.from_arrays(arrays, ["h", "v", "batch", "doc_id", "start"])

    joined = docs.join(wanted, ["batch", "doc_id"]).select("doc_id", "text", "ats", "batch")
    return joined.mapInArrow(found, "h long, v long, batch long, doc_id long, start long")


class FingerprintIndex:
    """Runs of stretches, and the texts that they came from, in the order of their batches."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.name = name or f"substring_index_{uuid.uuid4().hex}"
        self.buckets = buckets or shuffle_width(spark)
        self.runs: list[str] = []
        self.texts: DataFrame | None = None
        self.batches = 0

    def drop(self) -> None:
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        self.runs = []

    def _write(self, rows: DataFrame) -> str:
        run = f"{self.name}_{uuid.uuid4().hex[:8]}"
        (
            rows.write.bucketBy(self.buckets, "a", "c").sortBy("a", "c")
            .option("compression", "zstd").saveAsTable(run)
        )
        return run

    def compact(self) -> None:
        """Merge all runs into one; equal stretches keep their earliest place. Sorted runs are merge-joined."""
        while len(self.runs) > 1:
            old, new = self.runs[:2]
            a, b = self.spark.table(old).where("first").alias("a"), self.spark.table(new).where("first").alias("b")
            both = a.hint("merge").join(b, ["a", "c"], "full_outer")
            pick = F.when(F.col("a.batch").isNotNull(), F.col("a.batch")).otherwise(F.col("b.batch"))
            merged = both.select(
                "a", "c", F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"), F.coalesce("a.at", "b.at").alias("at"),
                F.lit(True).alias("first"), pick.alias("batch"),
            )
            run = self._write(merged)
            for gone in (old, new):
                self.spark.sql(f"DROP TABLE {gone}")
            self.runs[:2] = [run]

    def add(self, docs: DataFrame) -> DataFrame:
        """Index ``docs(doc_id, text)``, unique non-null doc_ids; ``(doc_id, at)`` of what came before.

        ``at`` stands for windows from at // 16 on, at % 16 more than one.
        """
        spark, number = self.spark, self.batches
        same = W.partitionBy("a", "c")
        rows = _stretches(docs).repartition(self.buckets, "a", "c")
        earliest = F.min(F.struct("doc_id", "at")).over(same)
        run = self._write(
            rows.withColumn("first", ~F.col("local") & (F.struct("doc_id", "at") == earliest))
            .select("a", "c", "doc_id", "at", "first", F.lit(number).alias("batch"))
        )
        release(spark)
        new = spark.table(run)
        repeats = [new.where("not first").select("doc_id", "at")]
        fresh = new.where("first")
        for old in self.runs:
            known = spark.table(old).where("first").select("a", "c")
            repeats.append(fresh.hint("merge").join(known, ["a", "c"], "left_semi").select("doc_id", "at"))
            fresh = fresh.hint("merge").join(known, ["a", "c"], "left_anti")
        repeats = [materialize(x, "repeats") for x in repeats]
        # Stretches that share an anchor but not all words, at least one of them new.
        firsts = fresh
        for old in self.runs:
            firsts = firsts.unionByName(spark.table(old).where("first"))
        shared = (
            firsts.groupBy("a").agg(F.count("*").alias("n"), F.max("batch").alias("last"))
            .where((F.col("n") > 1) & (F.col("last") == number)).select("a")
        )
        shared = materialize(shared, "shared")
        release(spark)
        unsure = materialize(firsts.join(shared, "a", "left_semi").select(F.col("batch").cast("long"), "doc_id", "at"), "unsure")
        release(spark)
        texts = docs.select("doc_id", "text", F.lit(number).cast("long").alias("batch"))
        texts = texts if self.texts is None else self.texts.unionByName(texts)
        if not is_empty(unsure):
            wanted = unsure.groupBy("batch", "doc_id").agg(F.collect_list("at").alias("ats"))
            windows = materialize(_windows(texts, wanted), "windows")
            release(spark)
            place = F.struct("batch", "doc_id", "start")
            firsts = windows.groupBy("h", "v").agg(F.min(place).alias("top"), F.count("*").alias("n")).where("n > 1").select("h", "v", "top")
            mine = windows.where(F.col("batch") == number) if number else windows
            part = mine.join(firsts, ["h", "v"]).where(place != F.col("top")).select("doc_id", (F.col("start") * 16).alias("at"))
            repeats.append(materialize(part, "parts"))
            discard(windows)
            release(spark)
        self.runs.append(run)
        self.texts, self.batches = texts, number + 1
        if len(self.runs) >= self.fanout:
            self.compact()
        out = repeats[0]
        for more in repeats[1:]:
            out = out.unionByName(more)
        return out


def keep_words(words: list[bytes], ats: list[int]) -> list[bytes]:
    """``words`` without those that the windows ``ats`` cover."""
    edges = np.zeros(len(words) + 1, "i8")
    at = np.array(ats, "i8")
    np.add.at(edges, at >> 4, 1)
    np.add.at(edges, (at >> 4) + (at & 15) + WINDOW, -1)
    kept = np.cumsum(edges[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist(), strict=True) if k]


def _removed(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` of every document; kept is its words joined by one space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for text, ats in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                left = keep_words(words, ats.as_py()) if ats.is_valid else words
                n.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    lists = repeats.groupBy("doc_id").agg(F.collect_list("at").alias("ats"))
    joined = docs.select("doc_id", "text").join(lists, "doc_id", "left").select("doc_id", "text", "ats")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, index: FingerprintIndex | None = None, batches: int = 2) -> DataFrame:
    """Every document without the words that a repeated window covers.

    Without an index a passing one is filled in ``batches`` steps by doc_id, the later merged with the earlier.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    ids = docs.select("doc_id")
    odd = ids.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    renamed = None
    if not is_empty(odd):
        # Stand-in ids in order of doc_id: a sort's partitions are in order, and so are these ids.
        placed = docs.withColumn("row", F.monotonically_increasing_id()).orderBy("doc_id", "row").drop("row")
        renamed = materialize(placed.withColumn("key", F.monotonically_increasing_id()), "renamed")
        docs = renamed.select(F.col("key").alias("doc_id"), "text")
    own = index is None
    index = index or FingerprintIndex(spark)
    if own and batches > 1:
        cuts = [i / batches for i in range(1, batches)]
        bounds = docs.select("doc_id").approxQuantile("doc_id", cuts, 0.01)
        edges = [None, *[int(b) for b in bounds], None]
        parts = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            part = docs if lo is None else docs.where(F.col("doc_id") > lo)
            parts.append(part if hi is None else part.where(F.col("doc_id") <= hi))
    else:
        parts = [docs]
    repeats = None
    try:
        for part in parts:
            found = index.add(part)
            repeats = found if repeats is None else repeats.unionByName(found)
    finally:
        if own:
            index.drop()
    out = _removed(docs, repeats)
    if renamed is not None:
        back = renamed.select("key", F.col("doc_id").alias("own_id"))
        out = out.join(back, out["doc_id"] == back["key"]).select(
            F.col("own_id").alias("doc_id"), "n_words", "n_removed", "kept"
        )
    return out

