"""Ranked lexical search by block-max pruning.

Documents are cut into blocks of consecutive rows, ``BLOCK_DOCS`` or ``BLOCK_WORDS`` at most. A block holds its
documents' term counts (the forward index, a column of postings in order of the block's own terms) and, for each of
its terms, the largest impact that the term has in one of its documents. An item's bound for a block sums weight
times maximum over the item's terms, so no document of the block scores higher.

Each item's blocks are sorted by bound. The first few are scored whole and give a threshold, the item's k-th best
score; then more, and at last all whose bound reaches the threshold. A block with a lower bound can't hold a result, nor
one that ties.

Blocks, maxima, weights and bounds are Spark tables that grow with the corpus; they meet by equality joins on the
term, the item or the block. The terms of the items are broadcast only when they are counted as few
(``BROADCAST_TERMS``); otherwise the joins shuffle. Jobs for one block are dealt out in buckets of about
``ITEMS_A_BUCKET`` items.

Terms are the maximal runs of letters, digits and non-ASCII characters, only A-Z lower-cased. With N documents that
have terms, L terms in them, n terms in a document, tf and df as usual: the weight is
``floor(1000 ln((2N+2)/(2df+1)))``, m is ``10 + 90nN div L``, the impact is ``10^9 tf div (1000 tf + 8m)``.

Defined cases: null and termless texts are no documents; items without a term that the corpus has give no row; each row
of either table counts, also with repeated or null ids (null after other ids among ties, equal ids in the table's order);
long texts make blocks of their own; empty tables give no row. Only doc_id, item_id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tidy, batch_rows, discard, materialize, sliced

TOP = 10
BLOCK_DOCS, BLOCK_WORDS = 128, 1 << 18
#: Blocks of each item that are scored in the rounds before the last.
ROUNDS = (4, 64)
BROADCAST_TERMS, ITEMS_A_BUCKET = 100_000, 256
ROWS_A_BATCH = 512  # of documents, so that Arrow batches stay small
BLOCKS_A_BATCH = 32  # a block is 128 documents, so a reader's 4,096 rows would be half a million

_SEPARATOR = bytes(range(0x00, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
_PLAIN = bytes(0x20 if b in _SEPARATOR else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: all separators are ASCII, so its bytes can be looked at alone."""
    return text.translate(_PLAIN).split()


class _Numbered(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for text in batch.column(column).cast(pa.binary()):
        yield text.as_py() or b""


def _blocks(docs: DataFrame) -> DataFrame:
    """A row a block: its documents, their lengths, its terms, and each term's postings from ``starts`` on."""
    kind = pa.schema([
        ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())),
        ("starts", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())),
    ])

    def block(ids: list, words: list[list[bytes]]) -> pa.RecordBatch:
        number, lengths = _Numbered(), np.fromiter(map(len, words), "i8", len(words))
        term = np.fromiter((number[w] for doc in words for w in doc), "i8", int(lengths.sum()))
        place = np.repeat(np.arange(len(words)), lengths)
        both, tf = np.unique(term * len(words) + place, return_counts=True)
        starts = np.searchsorted(both, np.arange(len(number) + 1) * len(words))
        row = [ids, lengths, list(number), starts, both % len(words), tf]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, kind, strict=True)], schema=kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        words: list[list[bytes]] = []
        held = 0
        for whole in batches:
            for batch in sliced([whole], 256):
                for doc_id, text in zip(batch.column(0).to_pylist(), _texts(batch, 1), strict=True):
                    found = terms_of(text)
                    if not found:
                        continue
                    if words and (len(words) == BLOCK_DOCS or held + len(found) > BLOCK_WORDS):
                        yield block(ids, words)
                        ids, words, held = [], [], 0
                    ids.append(doc_id)
                    words.append(found)
                    held += len(found)
        if words:
            yield block(ids, words)

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        cut, "ids array<long>, lengths array<long>, terms array<binary>, starts array<int>, places array<int>, tfs array<int>"
    )
    return rows.withColumn("block", F.monotonically_increasing_id())


def impacts(tf: np.ndarray, place: np.ndarray, lengths: list[int], n_docs: int, n_terms: int) -> np.ndarray:
    m = np.array([10 + 90 * n * n_docs // n_terms for n in lengths], "i8")
    tf = tf.astype("i8")
    return 1_000_000_000 * tf // (1000 * tf + 8 * m[place])


@dataclass
class BlockMaxIndex:
    """``blocks`` is the forward index; ``maxima(block, k, term, df, peak)`` has a row for each term of a block."""

    blocks: DataFrame
    maxima: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame) -> BlockMaxIndex:
    blocks = materialize(_blocks(docs), "lexical-blocks")
    total = blocks.select(
        F.size("ids").alias("d"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("t")
    ).agg(F.sum("d").alias("d"), F.sum("t").alias("t")).first()
    n_docs, n_terms = total["d"] or 0, total["t"] or 0

    def peaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced([whole], 1):
                starts, places, tfs = (batch.column(i).flatten().to_numpy() for i in (3, 4, 5))
                value = impacts(tfs, places, batch.column(1).flatten().to_pylist(), n_docs, n_terms)
                k = len(starts) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, batch.column(0)[0].as_py(), "i8")), pa.array(np.arange(k, dtype="i4")), batch.column(2).flatten(),
                     pa.array(np.diff(starts).astype("i8")), pa.array(np.maximum.reduceat(value, starts[:-1]))],
                    ["block", "k", "term", "df", "peak"],
                )

    maxima = blocks.select("block", "lengths", "terms", "starts", "places", "tfs").mapInArrow(
        peaks, "block long, k int, term binary, df long, peak long"
    )
    with batch_rows(docs.sparkSession, BLOCKS_A_BATCH, files=True):
        maxima = materialize(maxima, "lexical-maxima")
    return BlockMaxIndex(blocks, maxima, n_docs, n_terms)


def _item_terms(items: DataFrame) -> DataFrame:
    """``(item, item_id, term)``: each item's terms once; item is a number of its row."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced([whole], 256):
                terms = [sorted(set(terms_of(t))) for t in _texts(batch, 2)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.binary()))], ["item", "item_id", "terms"]
                )

    numbered = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    kind = items.schema["item_id"].dataType.simpleString()
    split = numbered.mapInArrow(found, f"item long, item_id {kind}, terms array<binary>")
    return split.select("item", "item_id", F.explode("terms").alias("term"))


def _scored(index: BlockMaxIndex, jobs: DataFrame, k: int) -> DataFrame:
    """``(item, doc_id, block, place, score)``: of each job (an item and a block) the ``k`` best documents."""
    n_docs, n_terms = index.n_docs, index.n_terms

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced([whole], 1):
                ids = batch.column(1).flatten().to_pylist()
                starts, places, tfs = (batch.column(i).flatten().to_numpy() for i in (3, 4, 5))
                value = impacts(tfs, places, batch.column(2).flatten().to_pylist(), n_docs, n_terms)
                cols: list[list[np.ndarray]] = [[], [], []]
                for job in batch.column(6)[0].as_py():
                    asks = np.array(job["asks"], "i8")
                    term, weight = asks >> 32, asks & 0xFFFFFFFF
                    count = starts[term + 1] - starts[term]
                    at = np.repeat(starts[term] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                    total = np.zeros(len(ids), "i8")
                    np.add.at(total, places[at], np.repeat(weight, count) * value[at])
                    good = np.flatnonzero(total >= max(1, job["tau"] or 0))
                    if len(good) > k:  # equal scores in order of ids, null last
                        good = np.array(sorted(good.tolist(), key=lambda d: (-total[d], ids[d] is None, ids[d] or 0, d))[:k])
                    for col, x in zip(cols, (np.full(len(good), job["item"]), good, total[good]), strict=True):
                        col.append(x)
                item, place, found = (np.concatenate(c).astype("i8") for c in cols)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item), pa.array([ids[p] for p in place], pa.int64()), pa.array(np.full(len(item), batch.column(0)[0].as_py(), "i8")),
                     pa.array(place), pa.array(found)],
                    ["item", "doc_id", "block", "place", "score"],
                )

    joined = index.blocks.join(jobs, "block").select("block", "ids", "lengths", "starts", "places", "tfs", "jobs")
    return joined.mapInArrow(score, "item long, doc_id long, block long, place long, score long")


def search(index: BlockMaxIndex, items: DataFrame, k: int = TOP) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` highest-scoring documents of every item."""
    spark = items.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    terms = materialize(_item_terms(items), "item-terms")
    about = terms.agg(F.count("*").alias("n"), F.countDistinct("item").alias("items")).first()
    if not about["n"] or not index.n_terms:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    few = F.broadcast if about["n"] <= BROADCAST_TERMS else lambda df: df
    near = materialize(index.maxima.join(few(terms.select("term").distinct()), "term"), "item-maxima")
    ratio = F.lit(2.0 * index.n_docs + 2.0) / (2.0 * F.col("df") + 1.0)
    weights = near.groupBy("term").agg(F.sum("df").alias("df")).select(
        "term", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("w")
    )
    weighted = materialize(terms.join(few(weights), "term").select("item", "term", "w"), "item-weights")
    # An ask is a term's place in the block and its weight, in one number.
    pairs = near.join(few(weighted), "term").groupBy("item", "block").agg(
        F.sum(F.col("w") * F.col("peak")).alias("bound"),
        F.collect_list(F.shiftleft(F.col("k").cast("long"), 32) + F.col("w")).alias("asks"),
    )
    pairs = materialize(pairs.where("bound > 0"), "item-bounds")
    by_bound = W.partitionBy("item").orderBy(F.desc("bound"), "block")
    leading = pairs.select("item", "block", "bound").withColumn("nth", F.row_number().over(by_bound)).where(F.col("nth") <= max(ROUNDS))
    leading = materialize(leading.select("item", "block", "nth"), "leading-blocks")
    buckets = -(-about["items"] // ITEMS_A_BUCKET)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "block", "place")
    best, begin = None, 0
    for end in (*ROUNDS, None):
        if end is None:
            now = pairs.join(leading, ["item", "block"], "left_anti")
        else:
            now = pairs.join(leading.where((F.col("nth") > begin) & (F.col("nth") <= end)), ["item", "block"]).drop("nth")
            begin = end
        tau = F.lit(None).cast("long")
        if best is not None:
            least = best.where(F.col("rank") == k).select("item", F.col("score").alias("tau"))
            now = now.join(least, "item", "left").where("tau is null or bound >= tau")
            tau = F.col("tau")
        jobs = now.groupBy("block", F.pmod(F.xxhash64("item"), F.lit(buckets)).alias("bucket")).agg(
            F.collect_list(F.struct("item", tau.alias("tau"), "asks")).alias("jobs")
        )
        found = _scored(index, jobs.select("block", "jobs"), k)
        found = found if best is None else found.unionByName(best.drop("rank"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        with batch_rows(spark, BLOCKS_A_BATCH, files=True):
            after = materialize(ranked, "best-documents")
        if best is not None:
            discard(best)
        best = after
    named = terms.select("item", "item_id").distinct()
    return best.join(few(named), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Search of ``docs(doc_id, text)`` for every row of ``items(item_id, text)``, by an index that goes afterwards."""
    with Tidy() as tidy, batch_rows(docs.sparkSession, ROWS_A_BATCH):
        out = materialize(search(build_index(docs), items, k), "ranked-documents")
        tidy.keep(out)
    return out
