"""Parameter grids, sweeps, walk-forward splits and their summaries.

Every (split, combination, symbol) is a group of one replay stage. Choosing the best combination of a split
is a grouped maximum, and scoring the chosen ones out of sample is a second stage over their join.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .basket import BasketConfig, align, replay_basket
from .indicators import by_symbol
from .metrics import equity_stats, run_metrics
from .replay import ReplayConfig, equity_curve, fills, replay
from .strategies import BuyAndHold, make_strategy

MAX_COMBINATIONS = 200
OVERFIT = 0.5


def expand_grid(grid: dict[str, list], most: int = MAX_COMBINATIONS) -> list[dict[str, Any]]:
    """All combinations, keys sorted, last key fastest."""
    if any(not v for v in grid.values()):
        raise ValueError("a parameter has no values")
    size = 1
    for v in grid.values():
        size *= len(v)
    if size > most:
        raise ValueError(f"{size} combinations are more than {most}")
    keys = sorted(grid)
    return [dict(zip(keys, values, strict=True)) for values in itertools.product(*(grid[k] for k in keys))]


def grid_frame(spark: SparkSession, grid: dict[str, list]) -> DataFrame:
    combos = [(i, json.dumps(c, sort_keys=True)) for i, c in enumerate(expand_grid(grid))]
    return spark.createDataFrame(combos, "combo int, params string")


def with_grid(rows: DataFrame, grid: dict[str, list]) -> DataFrame:
    """Each row once for every combination; the grid is as large as its parameters make it, whatever the rows."""
    combos = F.array(*[F.struct(F.lit(i).alias("combo"), F.lit(json.dumps(c, sort_keys=True)).alias("params")) for i, c in enumerate(expand_grid(grid))])
    return rows.withColumn("_combo", F.explode(combos)).select(*rows.columns, "_combo.*")


def generate_splits(n: int, train: int = 504, test: int = 126, step: int = 126, anchored: bool = True) -> list[tuple[int, int, int, int]]:
    """(train_start, train_end, test_start, test_end) in half-open bar positions; the last test may be short."""
    if min(train, test, step) < 1:
        raise ValueError("windows and step are one bar at least")
    out, end = [], train
    while end < n:
        out.append((0 if anchored else end - train, end, end, min(end + test, n)))
        end += step
    return out


def splits_frame(bars: DataFrame, train: int = 504, test: int = 126, step: int = 126, anchored: bool = True) -> DataFrame:
    """The splits of every symbol's bars: generated from counts, so nothing but counts is looked at."""
    counts = bars.groupBy("symbol").agg(F.count("*").cast("int").alias("n"))
    ends = F.explode(F.when(F.col("n") > train, F.sequence(F.lit(train), F.col("n") - 1, F.lit(step))))
    rows = counts.withColumn("train_end", ends)
    return rows.select(
        "symbol", ((F.col("train_end") - train) / step).cast("int").alias("split"),
        F.lit(0).alias("train_start") if anchored else (F.col("train_end") - train).alias("train_start"),
        "train_end", F.least(F.col("train_end") + test, F.col("n")).alias("test_end"),
    )


def decide_all(frame: DataFrame, name: str, combos: list[dict]) -> DataFrame:
    """``frame`` once for each combination, with ``combo`` and the decision columns of its strategy.

    All decisions are columns of one pass over the frame, which are then exploded.
    """
    wide, alternatives, names = frame, [], []
    for i, params in enumerate(combos):
        wide = make_strategy(name, params).apply(wide)
        names = [c for c in ("signal", "reason", "adverse", "score") if c in wide.columns and c not in frame.columns]
        for c in names:
            wide = wide.withColumnRenamed(c, f"_{c}_{i}")
        alternatives.append(F.struct(F.lit(i).alias("combo"), *[F.col(f"_{c}_{i}").alias(c) for c in names]))
    return wide.select(*frame.columns, F.explode(F.array(*alternatives)).alias("_alt")).select(*frame.columns, "_alt.*")


def _scored(decided: DataFrame, cfg: ReplayConfig, keys: tuple[str, ...]) -> DataFrame:
    """Measures of every run of a frame with decisions."""
    run = tuple(k for k in keys if k != "symbol")
    events = replay(decided, Decided(), cfg, run)
    return run_metrics(equity_curve(events, run), fills(events, run), cfg.initial_capital, (*run, "symbol"))


class Decided:
    """A frame that has its signals already."""

    def apply(self, frame: DataFrame) -> DataFrame:
        return frame


def run_sweep(frame: DataFrame, name: str, grid: dict[str, list], cfg: ReplayConfig | None = None) -> DataFrame:
    """Every combination once over each symbol's whole frame."""
    return _scored(decide_all(frame, name, expand_grid(grid)), cfg or ReplayConfig(), ("combo", "symbol"))


def best_combination(scored: DataFrame, objective: str = "sharpe", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The combination with the largest objective, then total return, then smallest number."""
    order = F.struct(F.col(objective), F.col("total_return_pct"), -F.col("combo"))
    return scored.groupBy(*keys).agg(
        F.max_by("combo", order).alias("combo"), F.max_by(objective, order).alias("in_sample"),
        F.max_by("total_return_pct", order).alias("in_sample_return"),
    )


def walk_forward(frame: DataFrame, name: str, grid: dict[str, list], splits: DataFrame, cfg: ReplayConfig | None = None, objective: str = "sharpe") -> DataFrame:
    """For each symbol and split the combination chosen in sample and its out-of-sample score beside buy and hold's."""
    cfg, combos = cfg or ReplayConfig(), expand_grid(grid)
    indexed = frame.withColumn("bar_idx", F.row_number().over(by_symbol()) - 1)
    splits = splits.select("symbol", "split", "train_start", "train_end", "test_end")
    placed = indexed.join(F.broadcast(splits) if _few(splits) else splits, "symbol").where(
        "bar_idx >= train_start and bar_idx < test_end"
    ).withColumn("tested", F.col("bar_idx") >= F.col("train_end"))
    placed = written(placed.select(*frame.columns, "split", "tested"), "placed")
    # One replay stage: all combinations in and out of sample, and buy and hold (combination -1) out of sample.
    decided = decide_all(placed, name, combos)
    held = BuyAndHold().apply(placed.where("tested")).withColumn("combo", F.lit(-1))
    decided = decided.unionByName(held, allowMissingColumns=True)
    measured = _scored(decided, cfg, ("tested", "split", "combo", "symbol"))
    measured = written(measured.select("tested", "split", "combo", "symbol", objective, "total_return_pct", "num_trades"), "measured")
    chosen = best_combination(measured.where("not tested"), objective, ("symbol", "split"))
    out = measured.where("tested").select(
        "symbol", "split", "combo", F.col(objective).alias("out_sample"), F.col("total_return_pct").alias("out_sample_return"),
        "num_trades",
    )
    base = measured.where("combo = -1").select(
        "symbol", "split", F.col(objective).alias("baseline"), F.col("total_return_pct").alias("baseline_return")
    )
    return chosen.join(out, ["symbol", "split", "combo"]).join(base, ["symbol", "split"]).withColumn(
        "beats", F.col("out_sample_return") > F.col("baseline_return")
    )


def _few(splits: DataFrame, most: int = 10_000) -> bool:
    return splits.limit(most + 1).count() <= most


def basket_sweep(frame: DataFrame, name: str, grid: dict[str, list], cfg: BasketConfig | None = None) -> DataFrame:
    """Every combination over the basket, beside a control without shared cash.

    The control gives each symbol an equal part of the capital and adds the equity curves up.
    """
    cfg, combos = cfg or BasketConfig(), expand_grid(grid)
    decided = decide_all(frame, name, combos)
    shared = replay_basket(decided, Decided(), cfg, ("combo",))
    curve = shared.where("kind = 'equity'").select("combo", "ts", "equity", "position_value")
    aligned = align(decided, ("combo",))
    count = aligned.select("symbol").distinct().count()
    alone = ReplayConfig(
        cfg.initial_capital / max(1, count), cfg.fee_bps, cfg.slippage_bps, cfg.max_position_pct, cfg.target_vol, cfg.vol_lookback,
        cfg.stop_loss_pct, cfg.take_profit_pct, cfg.max_drawdown_cutoff_pct,
    )
    parts = equity_curve(replay(aligned, Decided(), alone, ("combo",)), ("combo",))
    summed = parts.groupBy("combo", "ts").agg(F.sum("equity").alias("equity"), F.sum("position_value").alias("position_value"))
    both = curve.withColumn("arm", F.lit("basket")).unionByName(summed.withColumn("arm", F.lit("control")))
    return equity_stats(both, cfg.initial_capital, ("arm", "combo"))


def summarize(scored: DataFrame, value: str = "out_sample", baseline: str | None = "baseline", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Best, median and worst score, share above the baseline (null without one), and signs of overfitting."""
    order = F.struct(F.col("in_sample"), -F.col("split"))
    v = F.col(value)
    selected_in, selected_out = F.max_by("in_sample", order), F.max_by(value, order)
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max(v).alias("best"), F.median(v).alias("median"), F.min(v).alias("worst"),
        (F.avg((v > F.col(baseline)).cast("double")) if baseline else F.lit(None).cast("double")).alias("share_beating"),
        (selected_in - selected_out).alias("gap"),
        ((selected_in > 0) & (selected_out < OVERFIT * selected_in)).alias("overfit"),
    )


def purged_split_rows(panel: DataFrame, splits: list[tuple[int, int, int, int]], embargo: int = 5) -> DataFrame:
    """Train and test rows of a panel for splits over its distinct dates.

    A training row goes if its label ends at or after the test's start (purged), or if it was decided in the
    ``embargo`` dates before it (embargoed). ``splits`` are date positions, a few numbers each.
    """
    from .features import date_positions

    spark = panel.sparkSession
    dates = date_positions(panel)
    windows = spark.createDataFrame(
        [(i, *s) for i, s in enumerate(splits)], "split int, train_start int, train_end int, test_start int, test_end int"
    )
    start = dates.withColumnsRenamed({"decision_ts": "test_start_ts", "pos": "test_start"})
    early = dates.withColumnsRenamed({"decision_ts": "embargo_ts", "pos": "embargo_pos"})
    windows = windows.join(start, "test_start").withColumn(
        "embargo_pos", F.greatest(F.lit(0), F.col("test_start") - embargo)
    ).join(early, "embargo_pos")
    placed = panel.join(dates, "decision_ts").join(
        windows, (F.col("pos") >= F.col("train_start")) & (F.col("pos") < F.col("test_end"))
    )
    is_test = F.col("pos") >= F.col("test_start")
    role = (
        F.when(is_test, "test").when(F.col("label_end_ts") >= F.col("test_start_ts"), "purged")
        .when((F.lit(embargo) > 0) & (F.col("decision_ts") >= F.col("embargo_ts")), "embargoed").otherwise("train")
    )
    return placed.where(is_test | (F.col("pos") < F.col("train_end"))).withColumn("role", role)


def split_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split", "role").agg(F.count("*").alias("n"))


def time_folds(panel: DataFrame, fractions: tuple[float, ...] = (0.6, 0.2, 0.2)) -> DataFrame:
    """Panel rows with their fold by date, each but the last purged against the next one's start."""
    from .features import date_positions

    dates = date_positions(panel)
    total = dates.agg(F.count("*").alias("dates"))
    done, fold = 0.0, F.lit(len(fractions) - 1)
    bounds = []
    for f in fractions[:-1]:
        done += f
        bounds.append(done)
    for i in reversed(range(len(bounds))):
        fold = F.when(F.col("pos") < F.bround(F.col("dates") * bounds[i]), i).otherwise(fold)
    placed = dates.crossJoin(total).withColumn("fold", fold)
    starts = placed.groupBy((F.col("fold") - 1).alias("fold")).agg(F.min("decision_ts").alias("next_start"))
    rows = panel.join(placed.select("decision_ts", "fold"), "decision_ts").join(starts, "fold", "left")
    return rows.where(F.col("next_start").isNull() | (F.col("label_end_ts") < F.col("next_start"))).drop("next_start")


def inner_validation(panel: DataFrame, share: float = 0.3, embargo: int = 5) -> DataFrame:
    """The last share of dates as validation, the rest purged and embargoed against it."""
    n = panel.select("decision_ts").distinct().count()
    held = round(n * share)
    return purged_split_rows(panel, [(0, n - held, n - held, n)], embargo)


def to_json_config(cfg: ReplayConfig) -> str:
    return json.dumps(asdict(cfg), sort_keys=True)
