"""The pipeline's near-duplicate stage: five-word shingles at a Jaccard similarity of 0.8 or more.

Texts with one set of shingles are one node. A set's MinHash signature is cut into ``BANDS`` bands of ``ROWS``
values, and sets with an equal band are candidates: a pair at exactly 0.8 shares no band with a chance of
(1 - 0.8**6)**32, about six in 100,000, and a nearer pair with less. Candidates are verified by their exact
Jaccard similarity. What ``simhash`` links (three-word shingles, three bits) stays linked.

These links contract first; then members of bands that more than ``HOT`` sets share are verified against a few of
them. The candidates then leave out pairs whose ends are in one component already, so that a group of copies isn't
expanded into all its pairs, and pairs that a sketch rules out. The sketch is the parity of a set's hashes by slot:
each shingle that only one of two sets has flips one of ``SLOTS`` bits, so the bits that differ are at most as many
as such shingles, and the bound is exact: no pair at 0.8 is lost. It tells sets of up to about 1,500 shingles apart;
pairs of longer ones are verified without it.

Defined cases: a null or wordless text has the empty set and is a copy of the others; fewer words than a shingle
make one shingle; letters A-Z alone are folded; rows with a null doc_id stay and are never the smallest; an
empty table gives an empty result. Only doc_id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tidy, connected_components, discard, is_empty, materialize, sliced
from .simhash import HOT, SEED, links, text_fingerprint, without_losers

SHINGLE_WORDS, SIMILARITY, BANDS, ROWS, CENTRES, SLOTS = 5, (4, 5), 32, 6, 3, 1024
HELD_SETS = 256

_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), "u8")
_TIMES, _MASK = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def shingle_hashes(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct XXH64 values of a text's word shingles, sorted."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - words_per_shingle + 1
    if n <= 1:
        return np.array([digest(joined, SEED)], "u8")
    sizes = np.fromiter(map(len, words), "int64", len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    ends = ends[words_per_shingle - 1 :].tolist()
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), "u8", n))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band of the MinHash signature; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, "i8")
    least = np.full(BANDS * ROWS, np.iinfo("u8").max, "u8")
    for at in range(0, len(hashes), 512):
        np.minimum(least, ((hashes[at : at + 512] ^ _MASK) * _TIMES).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype="u8")
    for column in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys ^ _mixed(column))
    return keys.view("i8")


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The parity of the hashes in each of ``SLOTS`` slots, as longs."""
    odd = np.bincount((hashes >> np.uint64(20)).astype("i8") % SLOTS, minlength=SLOTS) & 1
    return np.packbits(odd.astype("u1"), bitorder="little").view("<i8")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of distinct hashes reach the similarity; two empty sets do."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILARITY[1] >= (len(a) + len(b) - both) * SIMILARITY[0]


def _text_key(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _signed(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, fp, node, n, bands, sketch)``: key stands for the text, node for its shingle set of size n."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in sliced(batches):
            fps, nodes, sizes, bands, sketches = [], [], [], [], []
            for text in batch.column(2):
                text = text.as_py()
                hashes = shingle_hashes(text)
                fps.append(text_fingerprint(text))
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                sizes.append(len(hashes))
                bands.append(band_keys(hashes))
                sketches.append(sketch(hashes))
            lists = [
                pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x) if x else np.zeros(0, "i8"))
                )
                for x in (bands, sketches)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(fps, "u8").view("i8")),
                 pa.array(np.array(nodes, "u8").view("i8")), pa.array(sizes, pa.int64()), *lists],
                ["doc_id", "key", "fp", "node", "n", "bands", "sketch"],
            )

    chosen = docs.select(F.col("doc_id").cast("long"), _text_key(F.col("text")).alias("key"), "text")
    return chosen.mapInArrow(signed, "doc_id long, key long, fp long, node long, n long, bands array<long>, sketch array<long>")


def _texts(docs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, text)``: one text of ``docs`` for each of ``nodes(node)``."""
    keys = sets.select("node", "key").join(nodes, "node", "left_semi")
    texts = docs.select(_text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(keys, "key").groupBy("node").agg(F.first("text").alias("text"))


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The candidates ``pairs(u, v)`` that reach the similarity, by their texts in ``docs``."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # the hubs of stars come again and again
        for batch in sliced(batches):
            good = []
            for v, a, b in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if v not in held:
                    if len(held) >= HELD_SETS:
                        held.clear()
                    held[v] = shingle_hashes(b.as_py())
                good.append(similar(shingle_hashes(a.as_py()), held[v]))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    # Each side's texts are written, so the joins know their size and broadcast what is small, pairs or hubs.
    sides = [
        materialize(_texts(docs, sets, pairs.select(F.col(x).alias("node")).distinct()), "texts").select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
        for x in "uv"
    ]
    joined = pairs.join(sides[0], "u").join(sides[1], "v").select("u", "v", "text_u", "text_v")
    return materialize(joined.mapInArrow(checked, "u long, v long"), "verified")


def _possible(n: str, m: str, a: str, b: str):
    """Sets that neither their sizes ``n`` and ``m`` nor their sketches ``a`` and ``b`` keep from the similarity."""
    least, most = F.least(n, m), F.greatest(n, m)
    differ = F.lit(0)
    for i in range(SLOTS // 64):
        differ = differ + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    # At least 4/5 alike: at most a ninth of both sets' elements is in one of them only.
    share = SIMILARITY[1] - SIMILARITY[0], SIMILARITY[1] + SIMILARITY[0]
    return (least * SIMILARITY[1] >= most * SIMILARITY[0]) & (differ * share[1] <= (F.col(n) + F.col(m)) * share[0])


def similar_links(sets: DataFrame, docs: DataFrame, known: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges ``(u, v)`` over ``sets(node, key, n, bands, sketch)``: with the edges ``known``, the components of all candidates.

    ``docs`` have the texts. Pairs that ``known`` connects already aren't verified again.
    """
    banded = sets.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(banded.join(shared, "band"), "bands")
    facts = sets.select("node", "n", "sketch")
    crowd = members.where(F.col("size") > hot)
    edges, roots = known, materialize(connected_components(known), "roots")
    if not is_empty(crowd):
        # The members of a crowded band are verified against ``CENTRES`` of them, one a member for each place.
        centres = [F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(CENTRES)]
        chosen = crowd.groupBy("band").agg(F.array(*centres).alias("centres"))
        stars = crowd.join(chosen, "band").select(F.col("node").alias("u"), F.posexplode("centres").alias("place", "v"))
        pairs = stars.where("u <> v").distinct()
        for end in "uv":
            pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
            own = facts.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}"))
            pairs = pairs.join(own, end)
        apart = F.coalesce("root_u", "u") != F.coalesce("root_v", "v")
        pairs = pairs.where(apart & _possible("n_u", "n_v", "sketch_u", "sketch_v")).groupBy("u", "place").agg(F.min("v").alias("v"))
        pairs = materialize(pairs.select("u", "v").distinct(), "star-pairs")
        edges = edges.unionByName(_verified(pairs, docs, sets))
        roots = materialize(connected_components(edges), "roots")
    grouped = members.join(roots, "node", "left").select("node", "band", F.coalesce("root", "node").alias("group"))
    grouped = materialize(grouped, "grouped")
    split = grouped.groupBy("band").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high")
    facing = materialize(grouped.join(split.select("band"), "band", "left_semi").join(facts, "node"), "facing")
    a, b = facing.alias("a"), facing.alias("b")
    pairs = a.join(
        b,
        (F.col("a.band") == F.col("b.band")) & (F.col("a.node") < F.col("b.node"))
        & (F.col("a.group") != F.col("b.group")) & _possible("a.n", "b.n", "a.sketch", "b.sketch"),
    ).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
    pairs = materialize(pairs, "candidates")
    out = materialize(_verified(pairs, docs, sets).unionByName(edges), "similar")
    for done in (members, grouped, facing, pairs):
        discard(done)
    return out


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, component_id)``: the smallest doc_id reachable over similar sets and near fingerprints."""
    with Tidy() as tidy:
        rows = materialize(_signed(docs), "signed")
        sets = materialize(
            rows.groupBy("node").agg(
                F.min("doc_id").alias("first_id"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("bands").alias("bands"),
                F.first("sketch").alias("sketch"),
            ),
            "sets",
        )
        prints = materialize(rows.select("fp", "node").distinct(), "prints")
        named = materialize(prints.groupBy("fp").agg(F.min("node").alias("node")), "named")
        same = prints.join(named.withColumnRenamed("node", "least"), "fp").where("node <> least")
        near = links(named.select("fp"))
        for end in "uv":
            near = near.withColumnRenamed(end, "fp").join(named, "fp").drop("fp").withColumnRenamed("node", end)
        known = near.select("u", "v").unionByName(same.select(F.col("node").alias("u"), F.col("least").alias("v")))
        edges = similar_links(sets, docs, materialize(known, "known"))
        roots = materialize(connected_components(edges), "components")
        rooted = materialize(
            sets.select("node", "first_id").join(roots, "node", "left")
            .select("node", "first_id", F.coalesce("root", "node").alias("root")),
            "rooted",
        )
        least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
        ids = materialize(rooted.join(least, "root").select("node", "component_id"), "ids")
        out = materialize(rows.select("doc_id", "node").join(ids, "node").select("doc_id", "component_id"), "groups")
        tidy.keep(out)
        return out


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group, with all their columns.

    Rows with a null doc_id stay. Rows that repeat a staying doc_id stay as well if their texts are in one
    group; exact copies are exact_dedup's matter.
    """
    return without_losers(docs, near_copy_groups(docs))
