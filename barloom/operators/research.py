"""Judging a learned strategy: purged walk-forward against baselines and random ensembles, and news ablation.

Splits are a handful, and each trains one distributed model; what is replayed is grouped by split, arm and
run, so all arms of all splits spread over the cluster.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_folder, written
from ..functions.stats import expected_max_column, moments, psr_column
from .basket import BasketConfig, align, combined_curve, replay_basket
from .evaluation import Decided, generate_splits, purged_split_rows
from .features import FEATURES, date_positions, learnable, panel
from .learning import TrainingConfig, TrainingError, default_trials, each_split, logistic_stages, train_model
from .metrics import bar_returns, by_symbol, equity_stats, round_trips, run_metrics, turnover
from .replay import ReplayConfig, equity_curve, fills, monte_carlo, replay
from .significance import ensemble_percentile, overfitting_probability, paired_test, verdict
from .strategies import BuyAndHold, Classifier, TrendFollowing

RUN = ("split", "arm")
CAVEATS = (
    "Fills are simulated at daily opens with fixed fees and slippage; no order moves a price, whatever its size.",
    "What a larger sum under management would earn is not estimated.",
)
SAMPLED_RUNS = 4


@dataclass(frozen=True)
class WalkForwardConfig:
    train_dates: int = 504
    test_dates: int = 126
    step_dates: int = 126
    runs: int = 200
    seed: int = 42
    min_hold: int = 5
    trials: int | None = None
    blocks: int = 16
    replay: ReplayConfig = ReplayConfig()
    training: TrainingConfig = TrainingConfig()

    def __post_init__(self) -> None:
        if self.step_dates < self.test_dates:
            raise ValueError("test windows may not overlap: the step is at least the test window")


@dataclass
class WalkForwardResult:
    """Everything as frames: per split and arm, per bar, and one verdict row."""

    scores: DataFrame
    bars: DataFrame
    judged: DataFrame
    skipped: list[tuple[int, str]]


def _windows(rows: DataFrame, splits: list[tuple[int, int, int, int]]) -> DataFrame:
    """First and last test date of each split."""
    dates = date_positions(rows)
    spark = rows.sparkSession
    bounds = spark.createDataFrame([(i, s[2], s[3] - 1) for i, s in enumerate(splits)], "split int, a int, z int")
    first = dates.withColumnsRenamed({"pos": "a", "decision_ts": "first_ts"})
    last = dates.withColumnsRenamed({"pos": "z", "decision_ts": "last_ts"})
    return bounds.join(first, "a").join(last, "z").select("split", "first_ts", "last_ts")


def _oos(frame: DataFrame, windows: DataFrame) -> DataFrame:
    """Bars of each split's test window, both ends included."""
    return frame.join(windows, (F.col("ts") >= F.col("first_ts")) & (F.col("ts") <= F.col("last_ts"))).drop("first_ts", "last_ts")


@dataclass
class Trained:
    """What is replayed: purged rows, test bars, their scores by trained arm, and signals of the arms without training."""

    purged: DataFrame
    tests: DataFrame
    scored: DataFrame
    signals: DataFrame
    splits: list[int]
    skipped: list[tuple[int, str]]


def _trained(featured: DataFrame, cfg: WalkForwardConfig, features: list[str], learners: dict[str, TrainingConfig]) -> Trained:
    """Train ``learners`` for each split and score its test bars; each split's scores are written by themselves."""
    spark = featured.sparkSession
    featured = written(featured, "featured")
    rows = written(learnable(panel(featured, cfg.training.horizon, features=features), features), "panel")
    n = rows.select("decision_ts").distinct().count()
    splits = generate_splits(n, cfg.train_dates, cfg.test_dates, cfg.step_dates)
    if not splits:
        raise TrainingError(f"{n} dates make no split")
    purged = written(purged_split_rows(rows, splits, cfg.training.horizon), "purged", "split")
    tests = written(_oos(featured, _windows(rows, splits)), "tests", "split")
    folder = shared_folder(spark, "scores")
    def train(split: int) -> None:
        own = purged.where((F.col("split") == split) & (F.col("role") == "train"))
        frame = tests.where(F.col("split") == split)
        models = {arm: train_model(own, learner, features) for arm, learner in learners.items()}
        for arm, model in models.items():
            scored = model.score(frame).select(
                "symbol", "ts", "p_up", F.lit(model.enter).alias("enter"), F.lit(model.leave).alias("leave")
            )
            scored.write.parquet(f"{folder}/split={split}/arm={arm}")

    skipped = each_split(list(range(len(splits))), train)
    if len(skipped) == len(splits):
        raise TrainingError("no split could be trained: " + "; ".join(why for _, why in skipped))
    scores = spark.read.option("basePath", folder).schema(
        "symbol string, ts timestamp_ntz, p_up double, enter double, leave double, split int, arm string"
    ).parquet(f"{folder}/split=*")
    done = tests.where(~F.col("split").isin([s for s, _ in skipped])) if skipped else tests
    keep = [c for c in ("symbol", "ts", "open", "high", "low", "close", "volume", "split") if c in done.columns]
    scored = done.select(*keep).join(scores, ["split", "symbol", "ts"])
    bars = done.select(*keep)
    signals = TrendFollowing().apply(done).select(*keep, "signal", "reason").withColumn("arm", F.lit("rule"))
    signals = signals.unionByName(BuyAndHold().apply(bars).withColumn("arm", F.lit("buy_and_hold")))
    gone = {split for split, _ in skipped}
    return Trained(purged, done, scored, signals, [i for i in range(len(splits)) if i not in gone], skipped)


def ml_walk_forward(featured: DataFrame, symbol: str, cfg: WalkForwardConfig | None = None, features: list[str] | None = None) -> WalkForwardResult:
    """Train on all symbols, replay ``symbol``: model, three baselines and random runs, then the verdict."""
    cfg, features = cfg or WalkForwardConfig(), features or FEATURES
    learners = {"model": cfg.training, "logistic": replace(cfg.training, estimator=logistic_stages)}
    trained = _trained(featured, cfg, features, learners)
    purged, tests, skipped = trained.purged, trained.tests, trained.skipped
    own = lambda frame, strategy: replay(frame.where(F.col("symbol") == symbol), strategy, cfg.replay, RUN)
    events = written(own(trained.scored, Classifier(min_hold=cfg.min_hold)).unionByName(own(trained.signals, Decided())), "events")
    keys = (*RUN, "symbol")
    curve, filled = equity_curve(events, RUN), fills(events, RUN)
    scores = run_metrics(curve, filled, cfg.replay.initial_capital, keys).join(turnover(filled, curve, keys), list(keys), "left")
    scores = written(scores, "measures")
    exposure = scores.where("arm = 'model'").select("split", (F.col("exposure_pct") / 100).alias("p_long"))
    frames = tests.where(F.col("symbol") == symbol).join(exposure, "split")
    random = written(monte_carlo(frames, cfg.runs, 0.5, cfg.min_hold, cfg.seed, cfg.replay, ("split",)), "random")
    # Per bar: the arms, and a few random runs as further configurations.
    bars = written(bar_returns(curve, keys), "returns")
    sampled = equity_curve(random.where(F.col("run") < SAMPLED_RUNS), ("split", "run"))
    random_bars = bar_returns(sampled, ("split", "run", "symbol")).withColumn("arm", F.concat(F.lit("random-"), F.col("run").cast("string")))
    every = bars.unionByName(random_bars.drop("run"))
    performance = every.select(
        F.col("arm").alias("config"), (F.col("split").cast("long") * 1_000_000 + F.col("obs_idx")).alias("obs_idx"), "ret"
    )
    pbo = written(overfitting_probability(written(performance, "performance"), cfg.blocks), "pbo")
    returns = lambda df: df.select("symbol", "split", F.col("total_return_pct").alias("return_pct"))
    ends = random.where("kind = 'equity'").groupBy("split", "run", "symbol").agg(F.max_by("equity", "ts").alias("e"))
    start = cfg.replay.initial_capital
    mc = ensemble_percentile(
        ends.select("symbol", "split", "run", ((F.col("e") - start) / start * 100).alias("return_pct")),
        returns(scores.where("arm = 'model'")),
    )
    judged = written(_judge(bars, scores, purged, pbo, written(mc, "percentile"), symbol, cfg), "judged")
    return WalkForwardResult(scores, bars, judged, skipped)


def _judge(bars: DataFrame, scores: DataFrame, purged: DataFrame, pbo: DataFrame, mc: DataFrame, symbol: str, cfg: WalkForwardConfig) -> DataFrame:
    model = bars.where("arm = 'model'")
    whole = model.agg(*moments("ret"))
    by_split = model.groupBy("split").agg(*moments("ret")).agg(F.var_samp("sharpe").alias("var_splits"))
    tested = purged.where((F.col("role") == "test") & (F.col("symbol") == symbol))
    unique = tested.dropDuplicates(["decision_ts"]).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("n_eff"))
    grown = lambda arm: F.product(F.when(F.col("arm") == arm, 1 + F.col("total_return_pct") / 100).otherwise(1.0)) - 1
    totals = scores.agg(
        *[grown(a).alias(a) for a in ("model", "buy_and_hold", "rule", "logistic")],
        F.sum(F.when(F.col("arm") == "model", F.col("num_trades"))).alias("n_oos_trades"),
        F.avg(F.when(F.col("arm") == "model", F.col("turnover"))).alias("turnover"),
    )
    # One-row frames.
    one = whole.crossJoin(by_split).crossJoin(unique).crossJoin(totals).crossJoin(pbo.select("pbo")).crossJoin(mc.select(F.col("percentile").alias("mc_percentile")))
    sampling = (1 + 0.5 * F.col("sharpe") ** 2) / F.greatest(F.lit(1.0), F.col("n_eff"))
    one = one.withColumn("var_trial", F.greatest(F.coalesce("var_splits", F.lit(0.0)), sampling))
    one = one.withColumn("expected", expected_max_column(F.lit(cfg.trials or default_trials()), F.col("var_trial")))
    one = one.withColumn("deflated_sharpe", psr_column("sharpe", "expected", F.bround("n_eff"), "skew", "kurtosis"))
    for arm in ("buy_and_hold", "rule", "logistic"):
        one = one.withColumn(f"beats_{arm}", F.col("model") > F.col(arm))
    return verdict(one.withColumn("symbol", F.lit(symbol)))


@dataclass
class BasketEvaluation:
    """Measures by split and arm, the combined curves, one judged row, what each symbol brought, and what to keep in mind."""

    scores: DataFrame
    curves: DataFrame
    judged: DataFrame
    by_symbol: DataFrame
    skipped: list[tuple[int, str]]
    caveats: tuple[str, ...] = CAVEATS


def basket_walk_forward(featured: DataFrame, cfg: WalkForwardConfig | None = None, basket: BasketConfig | None = None, features: list[str] | None = None) -> BasketEvaluation:
    """A model trained for each split, its basket out of sample, and three baselines at equal cost.

    ``rule`` is the same basket on trend signals. ``buy_and_hold`` and ``single_position`` (the model without an allocator) run
    every symbol by itself on an equal share of the capital; their curves are summed over the union of the calendars. Symbols
    with fewer than two bars in a window sit it out, and windows with fewer than two common bars are skipped.
    """
    cfg, basket, features = cfg or WalkForwardConfig(), basket or BasketConfig(), features or FEATURES
    trained = _trained(featured, cfg, features, {"model": cfg.training})
    present = trained.tests.groupBy("split", "symbol").agg(F.count("*").alias("_bars")).where("_bars >= 2").drop("_bars")
    common = align(trained.tests.join(present, ["split", "symbol"], "left_semi"), ("split",)).groupBy("split").agg(F.count_distinct("ts").alias("_common"))
    kept = written(present.join(common.where("_common >= 2"), "split", "left_semi"), "present")
    usable = {r["split"] for r in kept.select("split").distinct().collect()}
    skipped = trained.skipped + [(i, "fewer than two common bars") for i in trained.splits if i not in usable]
    only = lambda df, arm: df.where(F.col("arm") == arm).join(kept, ["split", "symbol"], "left_semi")
    decide = Classifier(min_hold=cfg.min_hold)
    together = replay_basket(only(trained.scored, "model"), decide, basket, RUN).unionByName(replay_basket(only(trained.signals, "rule"), Decided(), basket, RUN))
    # The share of the capital depends on how many symbols a split has, so it is a number for each such count.
    sizes = kept.groupBy("split").agg(F.count("*").alias("_n"))
    apart = None
    for n in sorted(r["_n"] for r in sizes.select("_n").distinct().collect()) or [1]:  # symbols of a basket: a few values
        own = replace(cfg.replay, initial_capital=basket.initial_capital / n, **_shared(basket))
        those = sizes.where(F.col("_n") == n)
        single = only(trained.scored, "model").join(those, "split", "left_semi").withColumn("arm", F.lit("single_position"))
        held = only(trained.signals, "buy_and_hold").join(those, "split", "left_semi")
        part = replay(single, decide, own, RUN).unionByName(replay(held, Decided(), own, RUN))
        apart = part if apart is None else apart.unionByName(part)
    together, apart = written(together, "basket"), written(apart, "single")
    curve = together.where("kind = 'equity'").select(*RUN, "ts", "equity", "cash", "position_value").unionByName(
        combined_curve(apart.where("kind = 'equity'"), RUN)
    )
    curve = written(curve, "curves")
    filled = written(fills(together, RUN).unionByName(fills(apart, RUN)), "fills")
    stats = equity_stats(curve, basket.initial_capital, RUN)
    trips = written(round_trips(filled, (*RUN, "symbol")), "trips")
    pooled = trips.groupBy(*RUN).agg(F.count("*").alias("num_trades"))
    scores = stats.join(pooled, list(RUN), "left").join(turnover(filled, curve, RUN), list(RUN), "left").fillna(0, ["num_trades"])
    scores = written(scores, "measures")
    brought = by_symbol(trips.where("arm = 'model'"), basket.initial_capital)
    every = featured.select("symbol").distinct().join(brought, "symbol", "left").fillna(0).fillna(0.0)
    return BasketEvaluation(scores, curve, _judge_basket(trained.purged, usable, scores, curve, cfg), every, skipped)


def _shared(basket: BasketConfig) -> dict:
    """The settings of a basket that a single symbol's replay has too."""
    names = set(ReplayConfig.__dataclass_fields__) & set(BasketConfig.__dataclass_fields__) - {"initial_capital"}
    return {n: getattr(basket, n) for n in names}


def _judge_basket(purged: DataFrame, usable: set[int], scores: DataFrame, curve: DataFrame, cfg: WalkForwardConfig) -> DataFrame:
    """One row: moments and deflated Sharpe of the model's bars, compounded returns, and the baselines that it beats."""
    model = bar_returns(curve.where("arm = 'model'"), RUN)
    whole = model.agg(*moments("ret"))
    by_split = model.groupBy("split").agg(*moments("ret")).agg(F.var_samp("sharpe").alias("var_splits"))
    tested = purged.where((F.col("role") == "test") & F.col("split").isin(sorted(usable)))
    unique = tested.dropDuplicates(["symbol", "decision_ts"]).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("n_eff"))
    grown = lambda arm: F.product(F.when(F.col("arm") == arm, 1 + F.col("total_return_pct") / 100).otherwise(1.0)) - 1
    arms = ("model", "rule", "buy_and_hold", "single_position")
    own = F.max(F.when(F.col("arm") == "model", F.col("total_return_pct"))).over(W.partitionBy("split"))
    totals = scores.withColumn("_model", own).agg(
        F.count_distinct("split").alias("n_splits"), *[grown(a).alias(a) for a in arms],
        *[F.count_if((F.col("arm") == a) & (F.col("_model") > F.col("total_return_pct"))).alias(f"splits_beating_{a}") for a in arms[1:]],
        F.sum(F.when(F.col("arm") == "model", F.col("num_trades"))).alias("n_oos_trades"),
        F.avg(F.when(F.col("arm") == "model", F.col("turnover"))).alias("turnover"),
    )
    one = whole.crossJoin(by_split).crossJoin(unique).crossJoin(totals)  # one-row frames
    sampling = (1 + 0.5 * F.col("sharpe") ** 2) / F.greatest(F.lit(1.0), F.col("n_eff"))
    one = one.withColumn("var_trial", F.greatest(F.coalesce("var_splits", F.lit(0.0)), sampling))
    one = one.withColumn("expected", expected_max_column(F.lit(cfg.trials or default_trials()), F.col("var_trial")))
    one = one.withColumn("deflated_sharpe", psr_column("sharpe", "expected", F.bround("n_eff"), "skew", "kurtosis"))
    some = F.col("n_splits") > 0
    one = one.withColumns({f"beats_{a}": some & (F.col("model") > F.col(a)) for a in arms[1:]})
    return written(one.withColumn("beats_all", F.col("beats_rule") & F.col("beats_buy_and_hold") & F.col("beats_single_position")), "judged")


def paired_bars(price: DataFrame, news: DataFrame) -> DataFrame:
    """The model's bars of both arms of an ablation, where both have them: (split, obs_idx, price, news)."""
    side = lambda df, name: df.where("arm = 'model'").select("split", "obs_idx", F.col("ret").alias(name))
    return side(price, "price").join(side(news, "news"), ["split", "obs_idx"])


def news_ablation(price_frame: DataFrame, news_frame: DataFrame, symbol: str, cost_usd: float, configs_tried: int = 1, cfg: WalkForwardConfig | None = None, news_features: list[str] | None = None, resamples: int = 2000) -> DataFrame:
    """Does news add anything: both arms on the same splits, cost spread over the bars, paired test on the difference."""
    if configs_tried < 1:
        raise ValueError("the news arm tried one configuration at least")
    from .news import NEWS_FEATURES

    cfg = cfg or WalkForwardConfig()
    base = cfg.trials or default_trials()
    arms = [(price_frame, cfg, FEATURES), (news_frame, replace(cfg, trials=base * configs_tried), FEATURES + (news_features or NEWS_FEATURES))]
    judge = inheritable_thread_target(price_frame.sparkSession)(lambda arm: ml_walk_forward(arm[0], symbol, arm[1], arm[2]))
    with ThreadPoolExecutor(len(arms)) as pool:  # each arm is many small jobs, which fill the cluster's gaps together
        price, news = pool.map(judge, arms)
    pairs = written(paired_bars(price.bars, news.bars), "pairs")
    drag = F.lit(cost_usd / cfg.replay.initial_capital / max(1, pairs.count()))
    order = (F.col("split").cast("long") * 1_000_000 + F.col("obs_idx")).alias("obs_idx")
    diffs = pairs.select(F.lit(symbol).alias("pair"), order, (F.col("news") - drag - F.col("price")).alias("diff"))
    tested = paired_test(diffs, base * configs_tried, resamples, seed=cfg.seed)
    trades = lambda r, name: r.judged.select(F.col("n_oos_trades").alias(f"{name}_trades"), F.col("verdict").alias(f"{name}_verdict"))
    out = tested.crossJoin(trades(price, "price")).crossJoin(trades(news, "news"))
    return out.withColumn("cost_per_trade", F.when(F.col("news_trades") > 0, F.lit(cost_usd) / F.col("news_trades")))
