"""SimHash near-deduplication by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments: of two fingerprints that differ in three bits or fewer,
one segment differs in at most one. Equal segments meet by an equality join on the segment; segments that
differ in one bit meet by an equality join on the segment with that bit deleted, those with the bit clear
on one side and those with it set on the other, so that each pair is met in one place. Whole fingerprints
are then compared inside the join.

Copies cost nothing: only distinct fingerprints are joined. Segments that more than ``HOT`` distinct
fingerprints share are first contracted: fingerprints that reach a common value by changing at most one
bit each (two bits apart or less) are linked as a star around the smallest, and the joins then leave out
pairs whose ends are in one star component already. Pairs of two crowded segments meet by the segment and a
piece of the other half, which differs by three bits at most as well: no key holds a crowd on both sides.

Defined cases: a null or wordless text has fingerprint zero and links like any other; fewer words than a
shingle make one shingle; repeated rows are rows with equal fingerprints; a null doc_id is never the
smallest; an empty table gives an empty result. Only doc_id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tidy, connected_components, fresh_names, is_empty, materialize

SHINGLE_WORDS, RADIUS, SEED, HOT = 3, 3, 42, 64


def text_fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash of a text over its word shingles, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - words_per_shingle + 1
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(joined, SEED)
    sizes = np.fromiter(map(len, words), "int64", len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    ends = ends[words_per_shingle - 1 :].tolist()
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), "<u8", n)
    ones = np.zeros(64, "int64")
    for at in range(0, n, 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view("u1").reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype="uint32")
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)``, fp as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter(
                (text_fingerprint(t.as_py(), words_per_shingle) for t in batch.column(1)), "u8", batch.num_rows
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view("i8"))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(hashed, "doc_id long, fp long")


def _segments(fps: DataFrame) -> DataFrame:
    """Both 32-bit segments of every fingerprint."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)
    both = F.array(
        F.struct(F.lit(0).cast("long").alias("seg"), high.alias("value")),
        F.struct(F.lit(1).cast("long").alias("seg"), low.alias("value")),
    )
    return fps.select("*", F.explode(both).alias("s")).select(*fps.columns, "s.seg", "s.value")


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _stars(fps: DataFrame) -> DataFrame:
    """Edges that link fingerprints two bits apart or less, as stars: at most 65 rows each, no pairs."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    reach = materialize(
        fps.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("value")), "reach"
    )
    centres = reach.groupBy("value").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1")
    return reach.join(centres, "value").select("u", F.col("fp").alias("v")).where("u <> v").distinct()


def _far_enough(radius: int) -> Column:
    """Sides a and b of a join are near and not in one star already."""
    return (_apart(F.col("a.fp"), F.col("b.fp")) <= radius) & (F.col("a.group") != F.col("b.group"))


def _met(a: DataFrame, b: DataFrame, radius: int, ordered: bool) -> DataFrame:
    """Pairs ``(u, v)`` of ``a(fp, group, key)`` and ``b(fp, group, key)`` with equal keys that are near."""
    a, b = a.alias("a"), b.alias("b")
    on = (F.col("a.key") == F.col("b.key")) & _far_enough(radius)
    if ordered:
        on = on & (F.col("a.fp") < F.col("b.fp"))
    return a.join(b, on).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def _deleted(rows: DataFrame, side: int) -> DataFrame:
    """A row for each bit of the segment that is ``side``, with the segment's key without that bit."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(31)))
    wild = rows.select("*", bit.alias("bit")).withColumn("mask", F.expr("shiftleft(1L, bit)"))
    has = F.col("value").bitwiseAND(F.col("mask"))
    key = F.col("seg") * (1 << 40) + (F.col("bit") + 1).cast("long") * (1 << 33) + F.col("value") - has
    return wild.where((has != 0) if side else (has == 0)).withColumn("key", key)


def _other(rows: DataFrame) -> Column:
    """The half of the fingerprint that isn't the row's segment."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)
    return F.when(F.col("seg") == 0, low).otherwise(high)


def _thirds(rows: DataFrame) -> DataFrame:
    """Keys with each of three pieces of the other half: two bits apart there leave one piece equal."""
    half = _other(rows)
    pieces = [F.shiftrightunsigned(half, at).bitwiseAND((1 << n) - 1) for at, n in ((0, 11), (11, 11), (22, 10))]
    keys = F.array(*[F.xxhash64("key", F.lit(i), p) for i, p in enumerate(pieces)])
    return rows.select("fp", "group", F.explode(keys).alias("key"))


def _wild_halves(rows: DataFrame, side: int) -> DataFrame:
    """Keys with each 16-bit piece of the other half, whole and without one bit: three bits apart there leave
    one piece at most one bit apart. Side 0 meets side 1 where the bit differs."""
    half, keys = _other(rows), []
    for i in range(2):
        piece = F.shiftrightunsigned(half, 16 * i).bitwiseAND(0xFFFF)
        keys.append(F.xxhash64("key", F.lit(-1 - i), piece))
        for bit in range(16):
            has = F.shiftrightunsigned(piece, bit).bitwiseAND(1)
            keys.append(F.xxhash64("key", F.lit(16 * i + bit), piece - has * (1 << bit), has if side == 0 else 1 - has))
    return rows.select("fp", "group", F.explode(F.array(*keys)).alias("key"))


def links(fps: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Edges ``(u, v)`` over the distinct fingerprints ``fps(fp)`` whose components are those of all links.

    Two segments find every pair up to three bits apart; ``radius`` may be smaller.
    """
    with Tidy() as tidy:
        if not 0 <= radius <= 3:
            raise ValueError("two segments with one deletion find pairs up to three bits apart")
        segments = materialize(_segments(fps), "segments")
        crowded = segments.groupBy("seg", "value").count().where(F.col("count") > hot).select("seg", "value")
        crowded = materialize(crowded, "crowded")
        packed = not is_empty(crowded)
        stars = None
        rows = segments.withColumn("group", F.col("fp"))
        if packed:
            if radius >= 2:
                crowd = materialize(segments.join(crowded, ["seg", "value"], "left_semi").select("fp").distinct(), "crowd")
                stars = materialize(_stars(crowd), "stars")
                roots = materialize(connected_components(stars), "roots")
                rows = segments.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
                    "fp", "seg", "value", F.coalesce("root", "fp").alias("group")
                )
            marked = crowded.withColumn("full", F.lit(True))
            rows = rows.join(marked, ["seg", "value"], "left").withColumn("full", F.coalesce("full", F.lit(False)))
            rows = materialize(rows, "grouped")
        # Two crowded segments meet by further keys, so that no key holds a crowd on both sides.
        whole = rows.withColumn("key", F.col("seg") * (1 << 40) + F.col("value"))
        clear, filled = _deleted(rows, 0), _deleted(rows, 1)
        plain = lambda df, full=False: (df.where(F.col("full") == full) if packed else df).select("fp", "group", "key")
        found = [_met(plain(whole), plain(whole), radius, True)]
        if not packed:
            found.append(_met(plain(clear), plain(filled), radius, False))
        else:
            every = filled.select("fp", "group", "key")
            found.append(_met(plain(clear), every, radius, False))
            found.append(_met(plain(clear, True), plain(filled), radius, False))
            dense, lack, have = (df.where("full") for df in (whole, clear, filled))
            found.append(_met(_wild_halves(dense, 0), _wild_halves(dense, 1), radius, False))
            found.append(_met(_thirds(lack), _thirds(have), radius, False))
            if stars is not None:
                found.append(stars)
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        out = materialize(out.distinct(), "links")
        tidy.keep(out)
        return out


def near_duplicate_groups(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest doc_id reachable over links of near fingerprints."""
    with Tidy() as tidy:
        rows = materialize(fingerprints(docs, words_per_shingle), "fingerprints")
        distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
        roots = materialize(connected_components(links(distinct.select("fp"), radius)), "components")
        rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "first_id", F.coalesce("root", "fp").alias("root")
        )
        rooted = materialize(rooted, "rooted")
        least = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
        named = materialize(rooted.join(least, "root").select("fp", "component_id"), "named")
        tidy.keep(rows, named)
        return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group, with all their columns.

    Rows with a null doc_id stay. Rows that repeat a staying doc_id stay as well if their texts are in one
    group; exact copies are exact_dedup's matter.
    """
    groups = near_duplicate_groups(docs, words_per_shingle, radius)
    return without_losers(docs, groups)


def without_losers(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` without the doc_ids that are never the component_id of ``groups(doc_id, component_id)``."""
    (gone_id,) = fresh_names(docs, "gone_id")
    gone = materialize(
        groups.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
        .where("not stays").select(F.col("doc_id").alias(gone_id)),
        "gone",
    )
    return docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")
