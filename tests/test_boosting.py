"""The booster against a plain one, in one task and in blocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import boosting
from barloom.operators.boosting import BoosterConfig, fit_booster

FEATURES = ["a", "b", "c", "d"]
CFG = BoosterConfig(trees=12, rate=0.1, leaves=6, depth=3, min_rows=5, bins=16, stop_rounds=4)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 4)).round(2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=700) * 0.7 > 0).astype(float)
    return x, y, rng.uniform(0.5, 1.5, 700), np.arange(700) >= 550


@pytest.fixture(scope="module")
def frame(spark, data):
    x, y, w, watch = data
    rows = [(*map(float, x[i]), float(y[i]), float(w[i]), bool(watch[i]), i) for i in range(len(x))]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, label double, weight double, watch boolean, id long").repartition(3)


def plain_boosting(x, y, w, watch, keys, edges, cfg):
    """A tree at a time, a leaf at a time, a cut at a time."""
    fit = ~watch
    share = (w[fit] * y[fit]).sum() / w[fit].sum()
    margin = np.full(len(y), math.log(share / (1 - share)))
    trees, best = [], (-1.0, 0)

    def split_of(rows, columns, g, h):
        top, total_g, total_h = None, g[rows].sum(), h[rows].sum()
        for f in columns:
            for cut, edge in enumerate(edges[f]):
                left = rows[x[rows, f] <= edge]
                right = rows[x[rows, f] > edge]
                if min(len(left), len(right)) < cfg.min_rows:
                    continue
                gain = g[left].sum() ** 2 / (h[left].sum() + cfg.l2) + g[right].sum() ** 2 / (h[right].sum() + cfg.l2) - total_g**2 / (total_h + cfg.l2)
                if gain > 1e-12 and (top is None or gain > top[0] + 1e-9):
                    top = (gain, f, cut, left, right)
        return top

    for number in range(cfg.trees + 1):
        if number:
            up, down = margin[watch & (y == 1)], margin[watch & (y == 0)]
            auc = ((up[:, None] > down).mean() + (up[:, None] == down).mean() / 2).item()
            if auc > best[0]:
                best = (auc, number)
            elif number - best[1] >= cfg.stop_rounds:
                break
        if number == cfg.trees:
            break
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        columns = boosting.drawn_columns(x.shape[1], cfg, number)
        rows = np.flatnonzero(fit & boosting.drawn(keys, cfg, number))
        leaves = [(rows, np.arange(len(y)), 0, split_of(rows, columns, g, h))]
        cuts = []
        while len(leaves) < cfg.leaves:
            able = [i for i, leaf in enumerate(leaves) if leaf[3] and leaf[2] < cfg.depth]
            if not able:
                break
            chosen = max(able, key=lambda i: leaves[i][3][0])
            _, members, depth, (gain, f, cut, left, right) = leaves.pop(chosen)
            cuts.append((f, cut))
            for drawn, side in ((left, members[x[members, f] <= edges[f][cut]]), (right, members[x[members, f] > edges[f][cut]])):
                leaves.append((drawn, side, depth + 1, split_of(drawn, columns, g, h)))
        trees.append(cuts)
        for drawn, members, _, _ in leaves:
            margin[members] += -g[drawn].sum() / (h[drawn].sum() + cfg.l2) * cfg.rate
    return trees[: best[1]], best[0]


def cuts_of(forest):
    return [sorted((f, c) for f, c in zip(t.feature, t.cut, strict=True) if f >= 0) for t in forest.trees]


@pytest.fixture(scope="module")
def forest(frame):
    return fit_booster(frame, FEATURES, CFG, "watch", ("id",))


def test_equals_plain_boosting(spark, data, frame, forest):
    x, y, w, watch = data
    keys = np.array([r[0] for r in frame.select("id", F.xxhash64("id").alias("k")).orderBy("id").select("k").collect()], "i8").view("u8")
    trees, auc = plain_boosting(x, y, w, watch, keys, forest.edges, CFG)
    assert cuts_of(forest) == [sorted((int(f), c) for f, c in t) for t in trees]
    assert abs(forest.auc - auc) < 0.002  # scores of one cell tie


def test_blocks_give_the_same(frame, forest, monkeypatch):
    for name, value in (("LOCAL_ROWS", 0), ("BLOCK_ROWS", 100), ("STORE_EVERY", 3)):
        monkeypatch.setattr(boosting, name, value)
    spread = fit_booster(frame, FEATURES, CFG, "watch", ("id",))
    assert cuts_of(spread) == cuts_of(forest) and spread.described() == forest.described()


def test_scores_and_storage(data, frame, forest):
    x, y, _, watch = data
    p = 1 / (1 + np.exp(-forest.margins(x)))
    assert ((p[watch & (y == 1)][:, None] > p[watch & (y == 0)]).mean()) > 0.8
    again = boosting.Forest.from_json(forest.to_json())
    got = frame.select("id", again.probability().alias("p")).orderBy("id").collect()
    assert max(abs(r["p"] - q) for r, q in zip(got, p, strict=True)) < 1e-12
    hollow = frame.limit(1).select(*[F.lit(None).cast("double").alias(f) for f in FEATURES]).select(again.probability().alias("p"))
    assert 0 < hollow.first()["p"] < 1


def test_leaf_wise_growth_takes_the_best_leaves(forest):
    assert all(1 < sum(f < 0 for f in t.feature) <= CFG.leaves for t in forest.trees)


def test_nothing_to_learn(frame):
    flat = frame.select(*[F.lit(1.0).alias(f) for f in FEATURES], "label", "weight", "watch", "id")
    assert fit_booster(flat, FEATURES, CFG, "watch").trees == []
    with pytest.raises(ValueError):
        fit_booster(frame.withColumn("label", F.lit(1.0)), FEATURES, CFG, "watch")


def test_auc_counts():
    counts = np.zeros((2, boosting.AUC_CELLS))
    counts[0, [1, 5]], counts[1, [5, 9]] = 1, 1
    assert boosting.auc_of(counts) == (1 + 0.5 + 2) / 4
    assert boosting.auc_of(np.zeros((2, boosting.AUC_CELLS))) is None
