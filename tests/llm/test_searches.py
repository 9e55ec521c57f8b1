"""Top-k search, lexical search and whitening against brute force, on the small tables and on awkward rows."""

import collections
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import lexical_search, pivot_search, whitening
from barloom.llm.queries import ORACLE, QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, row long, chunk string, Pivot int, score double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 5, None, 2, 0.5) for i, v in rows], VECTORS)


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def padded(rows, scale, shift=0):
    dim = max((len(v) for _, v in rows), default=0)
    single = [[float(np.float32(x)) for x in v] for _, v in rows]
    return [[math.floor(scale * x) + shift for x in v] + [shift] * (dim - len(v)) for v in single]


def brute_top(rows, k, asks):
    rows = [r for r in rows if good(r[1])]
    y = padded(rows, 256)
    out = []
    for i, (query, _) in enumerate(rows):
        if query is not None and asks(query):
            found = [(-sum(a * b for a, b in zip(y[i], y[j], strict=True)), v is None, v or 0, j, v) for j, (v, _) in enumerate(rows) if j != i]
            out += [(query, n, f[4], -f[0]) for n, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def got_top(df, k, asks):
    return sorted(map(tuple, pivot_search.top_matches(df, k, asks).collect()), key=str)


AWKWARD_VECTORS = [
    (0, [1.0, 2.0, 0.5]), (0, [1.0, 2.0, 0.5]), (50, [-1.0]), (100, []), (150, None), (200, [float("nan"), 1.0]), (250, [None, 1.0]),
    (300, [float("inf")]), (None, [1.0, 2.0, 0.5]), (None, [9.0, 0.0, 0.0]), (-50, [0.0, -3.0, 0.25]), (7, [1.0, 2.0, 0.5]), (3, [0.0] * 5),
]


def test_top_k_awkward(spark):
    df = vectors(spark, AWKWARD_VECTORS).coalesce(1)
    assert got_top(df, 5, None) == brute_top(AWKWARD_VECTORS, 5, lambda i: i % 50 == 0)
    for rows in ([], [(0, [])]):
        assert pivot_search.top_matches(vectors(spark, rows)).collect() == []


def test_top_k_beyond_doubles(spark):
    rows = [(0, [3e7, 1.0]), (1, [3e7, 1.5]), (2, [3e7, 1.25]), (3, [3e18, 1.0]), (4, [-3e18, 1.0])]
    got = {(q, v): s for q, _, v, s in got_top(vectors(spark, rows), 5, F.col("vec_id") == 0)}
    y = padded(rows, 256)
    for (_, v), score in got.items():
        exact = sum(a * b for a, b in zip(y[0], y[v], strict=True))
        assert score == min(max(exact, -(1 << 63)), (1 << 63) - 1)
    assert len(got) == 4


@pytest.mark.parametrize(("k", "block", "chunk"), [(1, 4, 3), (5, 16, 2), (30, 1024, 512)])
def test_top_k_by_force(spark, monkeypatch, k, block, chunk):
    monkeypatch.setattr(pivot_search, "BLOCK", block)
    monkeypatch.setattr(pivot_search, "CHUNK", chunk)
    monkeypatch.setattr(pivot_search, "ANNULI", 7)
    rng = np.random.default_rng(k)
    hubs = rng.normal(size=(6, 8)) * [[1], [1], [1], [5], [0.1], [1]]
    made = [hubs[i % 6] + rng.normal(size=8) * 0.05 for i in range(300)] + [hubs[0]] * 150  # a third are one vector
    rows = [(int(i), np.float32(v).tolist()) for i, v in zip(rng.permutation(450), made, strict=True)]
    assert got_top(vectors(spark, rows), k, F.col("vec_id") % 9 == 0) == brute_top(rows, k, lambda i: i % 9 == 0)


def test_top_k_stops_early(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "BLOCK", 8)
    rng = np.random.default_rng(4)
    hubs = rng.normal(size=(20, 6))
    hubs *= 10 / np.linalg.norm(hubs, axis=1, keepdims=True)
    rows = [(i, np.float32(hubs[i % 20] + rng.normal(size=6) * 0.01).tolist()) for i in range(800)]
    seen = []
    real = pivot_search._asked
    monkeypatch.setattr(pivot_search, "_asked", lambda index, *a: seen.append((len(index.annuli), real(index, *a).select(F.explode("qrows")).count())) or real(index, *a))
    got = got_top(vectors(spark, rows), 5, F.col("vec_id") % 50 == 0)
    assert got == brute_top(rows, 5, lambda i: i % 50 == 0)
    assert sum(n for _, n in seen) < 0.7 * 16 * seen[0][0]  # of the visits that 16 queries could make


def test_bounds_hold():
    rng = np.random.default_rng(1)
    y, q, p = (np.floor(rng.normal(size=(n, 5)) * s) for n, s in ((200, 900), (30, 700), (3, 800)))
    r = np.sqrt(((y[:, None] - p) ** 2).sum(2))
    for j in range(3):
        annulus = np.array([[j, 0, r[:, j].min(), r[:, j].max(), (y**2).sum(1).max(), 1]])
        assert (pivot_search._bounds(q, p, annulus)[:, 0] >= (q @ y.T).max(1)).all()
        own = pivot_search._bounds(p[j : j + 1], p, np.array([[j, 0, r[0, j], r[0, j], (y[0] ** 2).sum(), 1]]))
        assert own[0, 0] >= p[j] @ y[0]


# lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_rank(docs, items, k):
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    docs = [(d, c) for d, t in docs if (c := collections.Counter(split(t)))]
    total = sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for at, (d, c) in enumerate(docs):
            m = 10 + 90 * sum(c.values()) * len(docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(split(text)) if t in c
            )
            if score > 0:
                found.append((-score, d is None, d or 0, at, d))
        out += [(item, n, f[4], -f[0]) for n, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


DOCS = "doc_id long, text string, block long, terms string, Item int"
ITEMS = "item_id long, text string, term string, rank int"


def ranked(spark, docs, items, k=10):
    left = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in docs], DOCS).coalesce(1)
    right = spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS)
    return sorted(map(tuple, lexical_search.rank_documents(left, right, k).collect()), key=str)


AWKWARD_DOCS = [
    (1, None), (2, ""), (3, " .,!\n"), (4, "Word word WORD"), (5, "word"), (5, "word"), (None, "word"), (None, "word other"),
    (6, "ÀB àb ß 😀x"), (7, "x1y2 " * 30000 + "needle"), (8, "a@b a_b a`b"), (9, "needle needle other"), (0, "word"),
]
AWKWARD_ITEMS = [
    (1, "WORD"), (1, "WORD"), (2, None), (3, ""), (4, "absent"), (None, "needle x1y2"), (5, "Àb àB 😀X"), (6, "a b a b"), (7, "word " * 20000),
]


@pytest.mark.parametrize("block", [1, 3, 128])
def test_lexical_awkward(spark, monkeypatch, block):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block)
    assert ranked(spark, AWKWARD_DOCS, AWKWARD_ITEMS) == brute_rank(AWKWARD_DOCS, AWKWARD_ITEMS, 10)
    assert ranked(spark, [], AWKWARD_ITEMS) == ranked(spark, AWKWARD_DOCS, []) == ranked(spark, [(1, None)], AWKWARD_ITEMS) == []


@pytest.mark.parametrize("rounds", [(1,), (2, 5)])
def test_lexical_by_force(spark, monkeypatch, rounds):
    for name, value in (("BLOCK_DOCS", 4), ("ROUNDS", rounds), ("ITEMS_A_BUCKET", 3), ("BROADCAST_TERMS", 0)):
        monkeypatch.setattr(lexical_search, name, value)
    rng = np.random.default_rng(7)
    some = lambda n: " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % 400)
    docs = [(int(i), some(int(rng.integers(1, 60)))) for i in rng.permutation(400)] + [(i, "w1 w2 w3") for i in range(400, 600)]
    items = [(i, some(int(rng.integers(1, 20)))) for i in range(12)] + [(12, "w1 w2 w3")]
    assert ranked(spark, docs, items, 7) == brute_rank(docs, items, 7)


def test_lexical_skips_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 2)
    monkeypatch.setattr(lexical_search, "ROUNDS", (5,))
    docs = [(i, f"common filler u{i}") for i in range(300)] + [(300 + i, f"rare gem u{i}") for i in range(12)]
    seen = []
    real = lexical_search._scored
    monkeypatch.setattr(lexical_search, "_scored", lambda index, jobs, k: seen.append(jobs.count()) or real(index, jobs, k))
    assert ranked(spark, docs, [(1, "common rare gem")]) == brute_rank(docs, [(1, "common rare gem")], 10)
    assert sum(seen) < 20  # of 156 blocks


# whitening


def brute_whitening(rows):
    rows = [r for r in rows if good(r[1])]
    x = np.array(padded(rows, 64, 1_000_000), object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), object)
    n, sums = len(fit), fit.sum(0)
    off = (n * fit - sums).astype("f8") / n
    e, v = np.linalg.eigh(off.T @ off / n)
    e, v = e[::-1], v[:, ::-1]
    dev = [int(sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))) for row in x.tolist()]
    return [r[0] for r in rows], n, dev, (n * x - sums).astype("f8") / n, e, v


def held_against_force(df, rows):
    ids, n, dev, off, e, v = brute_whitening(rows)
    k = min(16, int((e > e[0] * 1e-12).sum()))
    got = sorted(whitening.whiten(df).collect(), key=str)
    assert len(got) == len(rows_of := [r for r in rows if good(r[1])]) * k and len(rows_of) == len(ids)
    want = off @ (v[:, :k] / np.sqrt(e[:k]))
    table = collections.defaultdict(list)
    for r in got:
        table[r["component"]].append((str(r["vec_id"]), r["deviation"], r["whitened"]))
        assert r["n"] == n and r["identity_error"] <= 1e-4
        assert math.isclose(r["explained"], e[r["component"] - 1] / e.sum(), rel_tol=1e-6)
    for c, found in table.items():
        both = [sorted((str(i), d, w * sign) for i, d, w in zip(ids, dev, want[:, c - 1], strict=True)) for sign in (1, -1)]
        found.sort()
        assert [f[:2] for f in found] == [b[:2] for b in both[0]]
        gap = [np.abs(np.array([f[2] for f in found]) - np.array([b[2] for b in side])).max() for side in both]
        assert min(gap) < 1e-6


def test_whitening_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    held_against_force(df, [(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_whitening_awkward(spark):
    rng = np.random.default_rng(3)
    rows = [(i, np.float32(rng.normal(size=5) * [3, 2, 1, 1, 0.5]).tolist()) for i in range(60)]
    rows += [(100, rows[0][1]), (100, rows[0][1]), (None, rows[1][1]), (101, [1.0]), (102, []), (103, None), (104, [None] * 5), (105, [math.nan] * 5)]
    held_against_force(vectors(spark, rows), rows)
    flat = [(i, [float(i % 7), 2.0 * (i % 7), 1.0]) for i in range(20)]  # one dimension of variance
    assert {r["component"] for r in whitening.whiten(vectors(spark, flat)).collect()} == {1}
    for few in ([], [(1, None)], [(1, [])], [(1, [2.0]), (2, [2.0])]):
        assert whitening.whiten(vectors(spark, few)).collect() == []


def test_deviations_are_exact():
    sums = [3 * 10**15, 5]
    x = np.array([[10**15, 1], [10**15 + 10**10, 3]])
    off, dev = whitening.deviations(x, 3, sums)
    assert dev == [0 + 4, 9 * 10**20 + 16] and off[1, 1] == 4.0


@pytest.mark.parametrize("name", ["op11_exact_top_k", "op12_lexical_search"])
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    cur = con.execute(f"select {', '.join(got.columns)} from ({ORACLE[name]})")
    assert sorted(map(tuple, got.collect())) == sorted(cur.fetchall())
