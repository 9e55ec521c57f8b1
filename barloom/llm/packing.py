"""Best-fit packing of tokenized documents into sequences, improved by swap-based local search.

Tokens are counted once where the texts are read; only a row a piece moves on. Pieces are dealt at
random into shards of a fixed number of pieces, and each shard is packed by itself: best-fit decreasing,
then a local search that moves documents and exchanges them one-for-one or two-for-one between underfull
bins, raising the sum of squared fills until the least filled bins are empty. A shard wastes less than
its last bins, so the number of sequences keeps its distance to the bound at every size of the corpus.

Defined cases: a null text counts as empty and has only the end token; longer documents are cut so that
all pieces but the first are full; equal lengths and repeated rows are separate pieces; an empty table
gives an empty result. Only doc_id and text are looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

CAPACITY, END_ID, SHARD_PIECES, DONORS = 1024, 2, 4096, 4
DEFAULT_TOKENIZER = "byte_bpe_50k.tiktoken"
#: The vocabulary's added token and its id. A text that holds it gets that id, as by the contract's call.
ADDED_TOKENS = {"<|endoftext|>": 50256}
#: Fixed value: how byte-level BPE cuts a text into words before merging, in possessive form.
SPLIT_PATTERN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
)

_ENCODERS: dict = {}


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """The ids of ``byte_bpe_50k.json``, by the same vocabulary as ranks, which encodes faster."""
    if path not in _ENCODERS:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding(
            "byte_bpe", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens=ADDED_TOKENS
        )
    return _ENCODERS[path]


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                     with_ids: bool = False) -> DataFrame:
    """A row per piece, in document order: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    path = path or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or "", allowed_special="all"), end_id], dtype="<u4")
                n = len(ids)
                first = n % capacity or capacity
                for piece, stop in enumerate(range(first, n + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    part = ids[start:stop]
                    row = (doc_id, piece, start, stop - start, zlib.crc32(part), part.tolist() if with_ids else None)
                    for col, value in zip(cols, row, strict=True):
                        col.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)][: 5 + with_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


class _Bins:
    """Bins of one shard: best fit by a bit mask of free space, then local search."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        by_free: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask = 0
        for i in sorted(range(len(self.lengths)), key=lambda i: -self.lengths[i]):
            size = self.lengths[i]
            room = mask >> size
            if room:
                free = size + (room & -room).bit_length() - 1
                b = by_free[free].pop()
                if not by_free[free]:
                    mask &= ~(1 << free)
            else:
                b, free = len(self.items), self.capacity
                self.items.append([])
                self.fill.append(0)
            self.items[b].append(i)
            self.fill[b] += size
            left = free - size
            if left:
                by_free[left].append(b)
                mask |= 1 << left

    def _improve(self, donor: int, others: list[int]) -> bool:
        """One exchange that lowers the donor's fill and raises a fuller bin's by as much: squared fill grows."""
        lengths, cap = self.lengths, self.capacity
        best, best_gain = None, 0
        for x in sorted(self.items[donor], key=lambda i: -lengths[i]):
            a = lengths[x]
            for b in others:
                free = cap - self.fill[b]
                if not free or self.fill[b] < self.fill[donor]:
                    continue
                if free >= a:
                    back: tuple[int, ...] = ()
                    gain = a
                    if gain > best_gain:
                        best, best_gain = (x, b, back), gain
                    continue
                inside = sorted((lengths[i], i) for i in self.items[b])
                for size, i in inside:
                    if 0 < a - size <= free and a - size > best_gain:
                        best, best_gain = (x, b, (i,)), a - size
                lo, hi = 0, len(inside) - 1
                while lo < hi:  # the two whose sum leaves the largest gain that fits
                    gain = a - inside[lo][0] - inside[hi][0]
                    if gain > free:
                        lo += 1
                        continue
                    if gain > best_gain:
                        best, best_gain = (x, b, (inside[lo][1], inside[hi][1])), gain
                    hi -= 1
            if best:
                break
        if not best:
            return False
        x, b, back = best
        self.items[donor].remove(x)
        self.items[b].append(x)
        for i in back:
            self.items[b].remove(i)
            self.items[donor].append(i)
        self.fill[donor] -= best_gain
        self.fill[b] += best_gain
        return True

    def search(self) -> None:
        """Empty the least filled bins until the bound is met or no exchange is left for ``DONORS`` of them."""
        least = -(-sum(self.lengths) // self.capacity)
        live = [b for b in range(len(self.items)) if self.items[b]]
        stuck: set[int] = set()
        while len(live) > least and len(stuck) < DONORS:
            donor = min((b for b in live if b not in stuck), key=lambda b: self.fill[b], default=None)
            if donor is None:
                break
            others = sorted(
                (b for b in live if b != donor and self.fill[b] < self.capacity), key=lambda b: -self.fill[b]
            )
            while self.items[donor] and self._improve(donor, others):
                pass
            if self.items[donor]:
                stuck.add(donor)  # the next least filled bin may still empty
            else:
                live.remove(donor)

    def packed(self) -> list[list[int]]:
        return [b for b in self.items if b]


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Positions of ``lengths`` by bin; every length is at most ``capacity``."""
    bins = _Bins(lengths, capacity)
    bins.best_fit()
    bins.search()
    return bins.packed()


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset. Full pieces are sequences of their own and don't move."""
    held = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    open_pieces = held.where(F.col("length") < capacity)
    shards = max(1, round(open_pieces.count() / shard_pieces))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", ignore_index=True)
        lengths = group["length"].tolist()
        seq, offset = np.zeros(len(group), "int64"), np.zeros(len(group), "int64")
        base = int(group["shard"].iloc[0]) << 32
        for number, items in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in sorted(items):
                seq[i], offset[i] = base + number, at
                at += lengths[i]
        return group.drop(columns=["row", "shard"]).assign(sequence_id=seq, offset=offset)

    cols = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    packed = (
        open_pieces.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(pack, f"{schema}, sequence_id long, offset long")
    )
    full = held.where(F.col("length") >= capacity).select(
        *cols, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                   with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack ``docs``; see the module for the defined cases."""
    return pack_pieces(tokenized_pieces(docs, path, capacity, end_id, with_ids), capacity)
