"""Finding cropped or edited copies of images by local descriptors.

Each image is looked at in several scales. Corners are local maxima of the structure tensor's least
eigenvalue; the patch around a corner is turned by the direction of its intensity centroid and described
by 128 comparisons of point pairs. Descriptors meet in Hamming tables, one for each of four words of 32 bits: an
equality join of the words of all pictures with those of the queries, as they are and with each bit turned. Two
descriptors ``MAX_DISTANCE`` = 7 bits apart have a word that differs in one bit at most, so the tables
find what a comparison of all pairs would. The pairs of points that agree vote for a shift and a scale of the
whole image, and an image is a match if enough of them agree on one.

Images with equal pixels are one class, and only one of a class is described and joined, so that a
picture with a third of all rows costs no more than any other. Words that many points share are split by the
adaptive skew join.

Defined cases: a null or malformed image has no descriptors and matches nothing; images without corners
match nothing but their own class; equal votes go to the smaller query. An empty table gives an empty
result. Only media_id and image are looked at. Images are binary PGM (P5), a media column that needs no
decoder; ``render`` makes them from vectors, as the tables have no pictures: a vector's numbers weigh fixed
textures, so that near vectors give like pictures.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tidy, materialize, release, sliced

SCALES = (1.0, 0.7, 0.5)
PATCH, TABLES, BITS = 7, 4, 128
MAX_DISTANCE, MIN_VOTES, BIN = 2 * TABLES - 1, 5, 4
OCTAVES = ((6, 1.0), (12, 1.0), (24, 0.7))
_PICK = np.random.default_rng(20)
_PLACES = np.clip(_PICK.normal(0, PATCH / 1.8, (BITS, 3)), -PATCH + 1, PATCH - 1)
#: Point pairs of the binary tests. Both points lie across the patch's direction, so that the gradient that
#: gives the direction doesn't decide the test.
_PAIRS = np.stack([_PLACES[:, 0], _PLACES[:, 1], _PLACES[:, 0], _PLACES[:, 2]], axis=1)


@lru_cache
def _textures(length: int) -> list[np.ndarray]:
    """For each octave the random grids that a vector of ``length`` numbers weighs."""
    rng = np.random.default_rng(length)
    return [rng.normal(0, 1, ((cells + 1) ** 2, length)).astype("f4") for cells, _ in OCTAVES]


def render(vector: list[float] | None, side: int = 64) -> bytes | None:
    """A picture of cloudy texture in three octaves that a vector determines, as PGM."""
    if vector is None or not len(vector):
        return None
    values = np.nan_to_num(np.asarray(vector, "f4"), posinf=0, neginf=0)
    values = values / max(float(np.linalg.norm(values)), 1e-9)  # bounded, so that no picture is all black or white
    picture = np.zeros((side, side))
    for (cells, weight), basis in zip(OCTAVES, _textures(len(values)), strict=True):
        grid = (basis @ values).reshape(cells + 1, cells + 1)
        at = np.arange(side) * cells / side
        i, f = at.astype(int), at % 1
        f = f * f * (3 - 2 * f)
        rows = grid[i] * (1 - f[:, None]) + grid[i + 1] * f[:, None]
        picture += weight * (rows[:, i] * (1 - f) + rows[:, i + 1] * f)
    return encode_pgm(128 + 45 * picture)


def encode_pgm(picture: np.ndarray) -> bytes:
    h, w = picture.shape
    return f"P5 {w} {h} 255\n".encode() + np.clip(np.rint(picture), 0, 255).astype("u1").tobytes()


def decode_pgm(data: bytes | None) -> np.ndarray | None:
    try:
        head, pixels = bytes(data or b"").split(b"\n", 1)
        kind, w, h, top = head.split()
        if kind != b"P5" or int(top) != 255:
            return None
        return np.frombuffer(pixels, "u1", int(w) * int(h)).reshape(int(h), int(w)).astype("f4")
    except ValueError:
        return None


def edited(data: bytes | None, keep: float = 0.8, gain: float = 0.9, lift: float = 8.0) -> bytes | None:
    """A crop from the lower right with changed contrast and brightness: an edited copy to search with."""
    picture = decode_pgm(data)
    if picture is None:
        return None
    h, w = picture.shape
    top, left = int(h * (1 - keep)), int(w * (1 - keep))
    return encode_pgm(picture[top:, left:] * gain + lift)


def _blur(p: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, int(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    p = np.pad(p, r, mode="edge")
    p = sum(w * p[i : i + p.shape[0] - 2 * r] for i, w in enumerate(k))
    return sum(w * p[:, i : i + p.shape[1] - 2 * r] for i, w in enumerate(k))


def _scaled(p: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return p
    p = _blur(p, 0.5 / scale)
    h, w = max(1, int(p.shape[0] * scale)), max(1, int(p.shape[1] * scale))
    y, x = np.minimum((np.arange(h) + 0.5) / scale, p.shape[0] - 1), np.minimum((np.arange(w) + 0.5) / scale, p.shape[1] - 1)
    return p[y.astype(int)][:, x.astype(int)]


def describe(picture: np.ndarray | None) -> list[tuple[float, float, float, np.ndarray]]:
    """(x, y, scale, 16 bytes) for every corner in every scale; x and y are in the picture's own pixels."""
    out: list = []
    for scale in SCALES if picture is not None else ():
        p = _scaled(picture, scale)
        if min(p.shape) < 2 * PATCH + 4:
            continue
        smooth = _blur(p, 0.7)
        gy, gx = np.gradient(smooth)
        xx, yy, xy = _blur(gx * gx, 1.2), _blur(gy * gy, 1.2), _blur(gx * gy, 1.2)
        least = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy**2)
        around = np.pad(least, 2, constant_values=-1)
        top = np.max([around[i : i + p.shape[0], j : j + p.shape[1]] for i in range(5) for j in range(5)], axis=0)
        edge = PATCH + 1
        ok = (least >= top) & (least > 15)
        ok[:edge] = ok[-edge:] = False
        ok[:, :edge] = ok[:, -edge:] = False
        ys, xs = np.nonzero(ok)
        if not len(ys):
            continue
        r = np.arange(-PATCH, PATCH + 1)
        disc = (r[:, None] ** 2 + r[None] ** 2) <= PATCH**2
        patch = smooth[ys[:, None, None] + r[:, None], xs[:, None, None] + r[None]] * disc
        angle = np.arctan2((patch * r[:, None]).sum((1, 2)), (patch * r[None]).sum((1, 2)))
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]

        def sample(px: np.ndarray, py: np.ndarray, p=smooth, ys=ys, xs=xs, cos=cos, sin=sin) -> np.ndarray:
            x = np.clip(np.rint(xs[:, None] + cos * px - sin * py), 0, p.shape[1] - 1).astype(int)
            y = np.clip(np.rint(ys[:, None] + sin * px + cos * py), 0, p.shape[0] - 1).astype(int)
            return p[y, x]

        bits = sample(_PAIRS[:, 0], _PAIRS[:, 1]) < sample(_PAIRS[:, 2], _PAIRS[:, 3])
        codes = np.packbits(bits, axis=1)
        out += [((x + 0.5) / scale, (y + 0.5) / scale, scale, c) for x, y, c in zip(xs, ys, codes, strict=True)]
    return out


POINT_SCHEMA = "media_id long, x float, y float, scale float, high long, low long"


def local_descriptors(images: DataFrame) -> DataFrame:
    """A row per corner of ``images(media_id, image)``."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            ids, points = [], []
            for media_id, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = describe(decode_pgm(image.as_py()))
                ids += [media_id] * len(found)
                points += found
            codes = np.array([p[3] for p in points], "u1").reshape(-1, 16).copy().view("<i8")
            places = [pa.array(np.array([p[i] for p in points], "f4")) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *places, pa.array(codes[:, 0]), pa.array(codes[:, 1])],
                ["media_id", "x", "y", "scale", "high", "low"],
            )

    return images.select("media_id", "image").mapInArrow(described, POINT_SCHEMA)


def _word(number: int, side: str = "") -> Column:
    """One of the words of a descriptor."""
    bits = BITS // TABLES
    half, place = ("high", "low")[number * bits // 64], number * bits % 64
    return F.shiftrightunsigned(F.col(side + half), place).bitwiseAND((1 << bits) - 1)


def _table(points: DataFrame, number: int, turned: bool) -> DataFrame:
    """A row for one word of each descriptor; ``turned``: and for each bit of it turned."""
    word, bits = _word(number), BITS // TABLES
    keys = [word, *[word.bitwiseXOR(F.lit(1 << b)) for b in range(bits)]] if turned else [word]
    return points.select("*", F.explode(F.array(*keys)).alias("word"))


def match_points(queries: DataFrame, points: DataFrame, max_distance: int = MAX_DISTANCE, min_votes: int = MIN_VOTES) -> DataFrame:
    """``(query_id, media_id, votes)`` of pictures that enough points place at one shift and scale.

    The tables are joined one after the other, and what each shuffled is let go, so that the disk holds one of them.
    """
    if max_distance > MAX_DISTANCE:
        raise ValueError(f"the tables find points up to {MAX_DISTANCE} bits apart")
    apart = F.bit_count(F.col("q.high").bitwiseXOR(F.col("p.high"))) + F.bit_count(
        F.col("q.low").bitwiseXOR(F.col("p.low"))
    )
    ratio = F.col("q.scale") / F.col("p.scale")
    votes = None
    for number in range(TABLES):
        q, p = _table(queries, number, turned=True).alias("q"), _table(points, number, turned=False).alias("p")
        on = (F.col("q.word") == F.col("p.word")) & (apart <= max_distance)
        for earlier in range(number):  # a pair is met once, in the first table that it shares
            on = on & (F.bit_count(_word(earlier, "q.").bitwiseXOR(_word(earlier, "p."))) > 1)
        pairs = q.join(p, on)
        vote = materialize(
            pairs.select(
                F.col("q.media_id").alias("query_id"), F.col("p.media_id").alias("media_id"),
                F.round(F.log2(ratio) * 2).cast("int").alias("zoom"),
                F.round((F.col("p.x") - F.col("q.x") * ratio) / BIN).cast("int").alias("dx"),
                F.round((F.col("p.y") - F.col("q.y") * ratio) / BIN).cast("int").alias("dy"),
                F.xxhash64("q.x", "q.y", "q.scale").alias("point"),
            ),
            "votes",
        )
        release(queries.sparkSession)
        votes = vote if votes is None else votes.unionByName(vote)
    agreed = votes.groupBy("query_id", "media_id", "zoom", "dx", "dy").agg(F.count_distinct("point").alias("votes"))
    return agreed.groupBy("query_id", "media_id").agg(F.max("votes").alias("votes")).where(F.col("votes") >= min_votes)


def find_copies(media: DataFrame, query_every: int = 20) -> DataFrame:
    """A row per picture: its class, and the edited queries that its class matches.

    Queries are edited copies of every picture whose media_id is divisible by ``query_every``; all
    pictures are searched. Classes are pictures with equal pixels, named by their smallest media_id.
    """
    with Tidy() as tidy:
        rows = materialize(
            media.select(F.col("media_id").cast("long"), "image", F.sha2(F.coalesce("image", F.lit(b"")), 256).alias("digest")), "media"
        )
        classes = rows.groupBy("digest").agg(
            F.min("media_id").alias("class_id"), F.max(F.col("media_id") % query_every == 0).alias("asked"),
            F.min_by("image", "media_id").alias("image"),
        )
        classes = materialize(classes, "classes")
        pictures = classes.select(F.col("class_id").alias("media_id"), "image")
        points = materialize(local_descriptors(pictures), "points")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 256):
                images = [edited(x.as_py()) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.binary())], ["media_id", "image"])

        asked = classes.where("asked").select(F.col("class_id").alias("media_id"), "image")
        queries = materialize(local_descriptors(asked.mapInArrow(cut, "media_id long, image binary")), "query-points")
        matches = materialize(match_points(queries, points), "matches")
        best = matches.groupBy("media_id").agg(
            F.count("*").alias("n_links"), F.max_by("query_id", F.struct("votes", -F.col("query_id"))).alias("best_query"),
            F.max("votes").alias("best_votes"),
        )
        named = classes.select("digest", "class_id").join(best, F.col("class_id") == F.col("media_id"), "left").select(
            "digest", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "best_query", "best_votes"
        )
        named = materialize(named, "named")
        tidy.keep(rows, named)
        return rows.select("media_id", "digest").join(named, "digest").drop("digest")


def rendered_vectors(vectors: DataFrame) -> DataFrame:
    """``(media_id, image)`` from ``vectors(vec_id, embedding)``."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            images = [render(v.as_py()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.binary())], ["media_id", "image"])

    chosen = vectors.select(F.col("vec_id").cast("long"), "embedding")
    return chosen.mapInArrow(drawn, "media_id long, image binary")
