"""Leaf-wise boosted trees on histograms, for two classes.

Features are cut into at most ``bins`` ranges at quantiles, and rows are packed into blocks of range codes. A level of a
tree is one grouped aggregate: each task sums gradients, hessians and counts by (node, feature, code) over its blocks,
the sums of a node meet in one group, and only its best split reaches the driver. As a node's split doesn't depend on
its siblings', all nodes of a level are split together, and best-first growth picks afterwards the splits of most
gain until there are ``leaves`` leaves.

A model is judged after each tree by the AUC of the rows that it watches, and keeps the trees up to the best one when
``stop_rounds`` more don't do better. The watched rows' scores are counted in ``AUC_CELLS`` equal cells between the
least and the largest score that the trees can give, and scores of one cell tie.

Rows are drawn for each tree by a hash of (seed, tree, row key), so that the draw doesn't depend on partitions. A fit of
up to ``LOCAL_ROWS`` rows runs in one task by the same code, as jobs for single levels would outlast it; a larger one is
spread over blocks and stores the rows' scores every ``STORE_EVERY`` trees. Null and NaN features go right.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

LOCAL_ROWS, BLOCK_ROWS, STORE_EVERY, AUC_CELLS = 200_000, 32_768, 16, 1 << 14
MIN_HESSIAN = 1e-3
_WATCH = -1  # in place of a node: the counts of watched scores


@dataclass(frozen=True)
class BoosterConfig:
    trees: int = 400
    rate: float = 0.03
    leaves: int = 15
    depth: int = 4
    min_rows: int = 30
    row_share: float = 0.8
    column_share: float = 0.8
    l2: float = 1.0
    bins: int = 255
    stop_rounds: int = 50
    seed: int = 42


@dataclass
class Tree:
    """Nodes in order of creation. A leaf has feature -1; a row goes left where its code is at most the cut."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def add(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, value)):
            column.append(x)
        return len(self.feature) - 1

    def nodes(self, goes_left: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], n: int) -> np.ndarray:
        """The leaf of each of ``n`` rows; ``goes_left(rows, feature, cut)`` tells the sides."""
        feature, cut = np.array(self.feature), np.array(self.cut)
        sides = np.array([self.right, self.left])
        at = np.zeros(n, "i8")
        while True:
            moving = np.flatnonzero(feature[at] >= 0)
            if not len(moving):
                return at
            own = at[moving]
            at[moving] = sides[goes_left(moving, feature[own], cut[own]).astype("i8"), own]


@dataclass
class Forest:
    """What a fit has learned: edges of the ranges, the score without trees, and the trees."""

    features: list[str]
    edges: list[list[float]]
    base: float
    trees: list[Tree] = field(default_factory=list)
    auc: float | None = None

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log odds of rows of plain feature values."""
        total = np.full(len(x), self.base)
        for tree in self.trees:
            bound = np.array([self.edges[f][c] if f >= 0 else 0.0 for f, c in zip(tree.feature, tree.cut, strict=True)])
            cuts = Tree(tree.feature, list(range(len(bound))), tree.left, tree.right, tree.value)
            at = cuts.nodes(lambda rows, f, node, bound=bound: x[rows, f] <= bound[node], len(x))
            total += np.array(tree.value)[at]
        return total

    def probability(self) -> Column:
        """The probability of the up class as a column of Arrow batches."""
        forest = self

        @F.pandas_udf("double")
        def p(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy("f8", na_value=np.nan) for c in columns])
            return pd.Series(1 / (1 + np.exp(-forest.margins(x))))

        return p(*[F.col(f).cast("double") for f in self.features])

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Forest:
        own = json.loads(text)
        return Forest(**own | {"trees": [Tree(**t) for t in own["trees"]]})

    def described(self) -> str:
        """What was learned, but for the last digits, which depend on the order of sums."""
        rounded = [[t.feature, t.cut, [float(f"{v:.9g}") for v in t.value]] for t in self.trees]
        return json.dumps([self.features, self.edges, float(f"{self.base:.9g}"), rounded])


@dataclass
class Block:
    """Rows as arrays. ``margin`` has the trees from the first to ``applied``."""

    codes: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    key: np.ndarray
    watch: np.ndarray
    margin: np.ndarray
    applied: int = 0

    def advance(self, trees: list[Tree]) -> None:
        for tree in trees[self.applied :]:
            self.margin = self.margin + np.array(tree.value)[self.leaf(tree)]
        self.applied = len(trees)

    def leaf(self, tree: Tree) -> np.ndarray:
        return tree.nodes(lambda rows, f, cut: self.codes[rows, f] <= cut, len(self.label))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(key: np.ndarray, cfg: BoosterConfig, tree: int) -> np.ndarray:
    """Which rows the tree is grown on."""
    salt = _mixed(np.array([cfg.seed * 1_000_003 + tree + 1], "u8"))
    return (_mixed(key.astype("u8") ^ salt) >> np.uint64(11)).astype("f8") / 2.0**53 < cfg.row_share


def drawn_columns(n: int, cfg: BoosterConfig, tree: int) -> np.ndarray:
    """Which features the tree may use, in order."""
    take = max(1, min(n, int(cfg.column_share * n + 0.5)))
    order = np.argsort(_mixed(np.arange(1, n + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15) ^ _mixed(np.array([cfg.seed * 7 + tree], "u8"))))
    return np.sort(order[:take])


def histograms(block: Block, tree: Tree, level: list[int], columns: np.ndarray, number: int, cfg: BoosterConfig, cells: int) -> dict[int, np.ndarray]:
    """For each node of the level its sums of gradients, hessians and rows by column and code."""
    used = np.flatnonzero(~block.watch & drawn(block.key, cfg, number))
    at = block.leaf(tree)[used]
    place = np.full(len(tree.feature), -1)
    place[level] = np.arange(len(level))
    inside = place[at] >= 0
    used, at = used[inside], place[at[inside]]
    p = 1 / (1 + np.exp(-block.margin[used]))
    g, h = block.weight[used] * (p - block.label[used]), block.weight[used] * p * (1 - p)
    out = np.zeros((len(level), 3, len(columns), cells))
    for i, f in enumerate(columns):
        slot = at * cells + block.codes[used, f]
        for j, w in enumerate((g, h, None)):
            out[:, j, i] = np.bincount(slot, w, len(level) * cells).reshape(len(level), cells)
    return {node: out[i] for i, node in enumerate(level)}


def best_split(sums: np.ndarray, cfg: BoosterConfig) -> tuple[float, int, int, list[float]] | None:
    """Gain, place of the column, cut, and (G, H, n) of both sides; the first of equal gains."""
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    total = sums[:, :1].sum(2)[:, :, None]
    right = total - left
    worth = lambda s: s[0] ** 2 / (s[1] + cfg.l2)
    gain = worth(left) + worth(right) - worth(total)
    fits = (np.minimum(left[2], right[2]) >= cfg.min_rows) & (np.minimum(left[1], right[1]) >= MIN_HESSIAN) & (gain > 1e-12)
    if not fits.any():
        return None
    gain = np.where(fits, np.round(gain, 9), -np.inf)
    column, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[column, cut]), int(column), int(cut), [*left[:, column, cut].tolist(), *right[:, column, cut].tolist()]


def watched_counts(block: Block, trees: list[Tree], base: float) -> np.ndarray:
    """Watched rows of each class by cell of their score."""
    low = base + sum(min(t.value) for t in trees)
    high = base + sum(max(t.value) for t in trees)
    some = block.watch
    cell = ((block.margin[some] - low) / max(high - low, 1e-300) * (AUC_CELLS - 1)).clip(0, AUC_CELLS - 1).astype("i8")
    return np.stack([np.bincount(cell[block.label[some] == y], minlength=AUC_CELLS) for y in (0, 1)]).astype("f8")


def auc_of(counts: np.ndarray) -> float | None:
    """The chance that a row of the up class is scored above one of the other, ties by half."""
    below = np.cumsum(counts[0]) - counts[0]
    pairs = counts[0].sum() * counts[1].sum()
    return float((counts[1] * (below + counts[0] / 2)).sum() / pairs) if pairs else None


#: Gives, for nodes of a growing tree, their best splits; at _WATCH the counts of watched scores, where asked for.
Level = Callable[[list[Tree], Tree, list[int], np.ndarray, int, bool], dict]


def grow(level_of: Level, trees: list[Tree], columns: np.ndarray, number: int, cfg: BoosterConfig, ask: bool) -> tuple[Tree | None, np.ndarray | None]:
    """The next tree, None where nothing can be split, and the watched counts before it."""
    whole, splits, level, counts = Tree(), {}, [0], None
    for depth in range(cfg.depth):
        found = level_of(trees, whole, level, columns, number, ask and not depth)
        counts = found.pop(_WATCH, counts)
        level = []
        for node in sorted(found):
            gain, column, cut, sums = found[node]
            whole.feature[node], whole.cut[node] = int(columns[column]), cut
            for side, at in (("left", 0), ("right", 3)):
                child = whole.add(-sums[at] / (sums[at + 1] + cfg.l2) * cfg.rate)
                getattr(whole, side)[node] = child
                if sums[at + 2] >= 2 * cfg.min_rows:
                    level.append(child)
            splits[node] = gain
        if not level:
            break
    if not splits:
        return None, counts
    # Best first: of the leaves that can be split, the one of most gain, until there are enough.
    tree, leaves = Tree(), 1
    queue = [(-splits[0], 0, 0)]
    while queue and leaves < cfg.leaves:
        _, node, own = heapq.heappop(queue)
        tree.feature[own], tree.cut[own] = whole.feature[node], whole.cut[node]
        for side in ("left", "right"):
            child = getattr(whole, side)[node]
            getattr(tree, side)[own] = new = tree.add(whole.value[child])
            if child in splits:
                heapq.heappush(queue, (-splits[child], child, new))
        leaves += 1
    return tree, counts


def boost(level_of: Level, forest: Forest, cfg: BoosterConfig, watching: bool, store: Callable[[list[Tree]], None] = lambda trees: None) -> Forest:
    """Trees until there are enough, none can be grown, or the watched AUC hasn't risen for a while."""
    trees: list[Tree] = []
    best, best_at = None, 0
    for number in range(cfg.trees + watching):  # a last round only judges
        columns = drawn_columns(len(forest.features), cfg, number)
        tree, counts = grow(level_of, trees, columns, number, cfg, watching and number > 0)
        if counts is not None:
            auc = auc_of(counts)
            if auc is not None and (best is None or auc > best):
                best, best_at = auc, len(trees)
            elif len(trees) - best_at >= cfg.stop_rounds:
                break
        if tree is None or number == cfg.trees:
            break
        trees.append(tree)
        store(trees)
    return Forest(forest.features, forest.edges, forest.base, trees[:best_at] if best is not None else trees, best)


def codes_of(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """The range of each value: how many edges are below it. NaN is above all."""
    out = np.zeros(x.shape, "u1")
    for f, own in enumerate(edges):
        out[:, f] = np.searchsorted(np.array(own), x[:, f], side="left")
    return out


def _blocks(batches: Iterator[pa.RecordBatch], forest: Forest, rows: int) -> Iterator[Block]:
    """Batches of (key, label, weight, watch, features...) as blocks, in order of the key inside each."""

    def made() -> Block:
        whole = pa.Table.from_batches(held)
        order = np.argsort(whole.column(0).to_numpy(), kind="stable")
        cols = [whole.column(i).to_numpy(zero_copy_only=False)[order] for i in range(whole.num_columns)]
        x = np.column_stack([c.astype("f8") for c in cols[4:]])
        return Block(codes_of(x, forest.edges), cols[1].astype("f8"), cols[2].astype("f8"), cols[0].view("u8"), cols[3].astype(bool), np.full(len(x), forest.base))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            if sum(b.num_rows for b in held) >= rows:
                yield made()
                held.clear()
    if held and sum(b.num_rows for b in held):
        yield made()


def _found(sums: dict[int, np.ndarray], cfg: BoosterConfig) -> dict:
    return {n: split for n, s in sums.items() if (split := best_split(s, cfg)) is not None}


def _fit_in_one_task(rows: DataFrame, forest: Forest, cfg: BoosterConfig, watching: bool) -> Forest:
    cells = max(map(len, forest.edges)) + 1

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, forest, LOCAL_ROWS * 2):

            def level_of(trees: list[Tree], tree: Tree, level: list[int], columns: np.ndarray, number: int, ask: bool, block: Block = block) -> dict:
                block.advance(trees)
                counts = {_WATCH: watched_counts(block, trees, forest.base)} if ask else {}
                return _found(histograms(block, tree, level, columns, number, cfg, cells), cfg) | counts

            learned = boost(level_of, forest, cfg, watching)
            yield pa.RecordBatch.from_arrays([pa.array([learned.to_json()])], ["forest"])

    found = rows.coalesce(1).mapInArrow(fit, "forest string").collect()  # one row
    return Forest.from_json(found[0]["forest"])


_BLOCK = pa.schema([
    ("codes", pa.binary()), ("label", pa.binary()), ("weight", pa.binary()), ("key", pa.binary()), ("watch", pa.binary()),
    ("margin", pa.binary()), ("applied", pa.int32()),
])
_KINDS = (("codes", "u1"), ("label", "f8"), ("weight", "f8"), ("key", "u8"), ("watch", "?"), ("margin", "f8"))
_BLOCK_COLUMNS = ", ".join(f"{name} binary" for name, _ in _KINDS) + ", applied int"


def _packed(block: Block) -> pa.RecordBatch:
    row = {name: getattr(block, name).astype(kind).tobytes() for name, kind in _KINDS} | {"applied": block.applied}
    return pa.RecordBatch.from_pylist([row], schema=_BLOCK)


def _unpacked(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            parts = {name: np.frombuffer(row[name], kind) for name, kind in _KINDS}
            yield Block(**parts | {"codes": parts["codes"].reshape(-1, features)}, applied=row["applied"])


def _fit_in_blocks(rows: DataFrame, forest: Forest, cfg: BoosterConfig, watching: bool) -> Forest:
    cells, width = max(map(len, forest.edges)) + 1, len(forest.features)
    pack = lambda batches: map(_packed, _blocks(batches, forest, BLOCK_ROWS))
    state = {"blocks": written(rows.mapInArrow(pack, _BLOCK_COLUMNS), "boost")}

    def store(trees: list[Tree]) -> None:
        if len(trees) % STORE_EVERY == 0:

            def advanced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for block in _unpacked(batches, width):
                    block.advance(trees)
                    yield _packed(block)

            state["blocks"] = written(state["blocks"].mapInArrow(advanced, _BLOCK_COLUMNS), "boost")

    def level_of(trees: list[Tree], tree: Tree, level: list[int], columns: np.ndarray, number: int, ask: bool) -> dict:
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for block in _unpacked(batches, width):
                block.advance(trees)
                own = histograms(block, tree, level, columns, number, cfg, cells)
                if ask:
                    own[_WATCH] = watched_counts(block, trees, forest.base)
                total = {k: total[k] + v if k in total else v for k, v in own.items()}
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["node", "sums"])

        def chosen(table: pa.Table) -> pa.Table:
            node = table.column("node")[0].as_py()
            flat = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
            if node == _WATCH:
                result = flat.tolist()
            else:
                result = best_split(flat.reshape(3, len(columns), cells), cfg)
            return pa.table({"node": pa.array([node], pa.int32()), "found": pa.array([json.dumps(result)])})

        parts = state["blocks"].mapInArrow(summed, "node int, sums binary")
        found = parts.groupBy("node").applyInArrow(chosen, "node int, found string").collect()  # a row a node of the level
        out = {r["node"]: json.loads(r["found"]) for r in found}
        counts = {_WATCH: np.array(out.pop(_WATCH)).reshape(2, -1)} if _WATCH in out else {}
        return {n: tuple(x) for n, x in out.items() if x is not None} | counts

    return boost(level_of, forest, cfg, watching, store)


def fit_booster(rows: DataFrame, features: list[str], cfg: BoosterConfig | None = None, watch: str | None = None, keys: tuple[str, ...] = (), label: str = "label", weight: str | None = "weight") -> Forest:
    """A forest learned from the rows that ``watch`` doesn't mark, stopped by those that it does.

    ``keys`` name a row; without them its features do.
    """
    cfg = cfg or BoosterConfig()
    marked = F.col(watch) if watch else F.lit(False)
    own = rows.select(
        F.xxhash64(*(keys or features)).alias("key"), F.col(label).cast("double").alias("label"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"), marked.alias("watch"),
        *[F.col(f).cast("double").alias(f) for f in features],
    )
    steps = F.array(*[F.lit(i / cfg.bins) for i in range(1, cfg.bins)])
    fit = F.when(~F.col("watch"), F.lit(1))
    plain = lambda f: F.when(~F.col("watch") & ~F.isnan(f), F.col(f))
    about = own.agg(
        F.count("*").alias("n"), F.count_if("watch").alias("watched"), F.sum(fit * F.col("weight")).alias("w"),
        F.sum(fit * F.col("weight") * F.col("label")).alias("up"),
        *[F.percentile_approx(plain(f), steps, 10_000).alias(f"_edges_{i}") for i, f in enumerate(features)],
    ).first()
    share = about["up"] / about["w"] if about["w"] else 0.5
    if not 0 < share < 1:
        raise ValueError("one class only")
    edges = [sorted(set(about[f"_edges_{i}"] or [])) for i in range(len(features))]
    forest = Forest(list(features), [[float(e) for e in own_edges] for own_edges in edges], math.log(share / (1 - share)))
    way = _fit_in_one_task if about["n"] <= LOCAL_ROWS else _fit_in_blocks
    return way(own, forest, cfg, bool(about["watched"]))
