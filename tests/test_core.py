"""Hand-made cases whose answers are known."""

import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest

from barloom.functions import annotate, money, stats
from barloom.operators import basket, evaluation, features, learning, metrics, news, paper, quality, replay, significance
from barloom.operators.strategies import Classifier, MeanReversion, StrategyError, describe_strategies, make_strategy
from barloom.sources import bars as bar_src
from barloom.sources import news as news_src
from barloom.sources import tables

BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def made(spark, closes, opens=None, symbol="A", signals=None):
    opens = opens or closes
    rows = [
        (symbol, datetime(2024, 1, 1) + timedelta(days=i), float(o), float(max(o, c) + 1), float(min(o, c) - 1), float(c), 1000.0)
        for i, (o, c) in enumerate(zip(opens, closes, strict=True))
    ]
    df = spark.createDataFrame(rows, BAR)
    if signals is not None:
        from pyspark.sql import functions as F

        idx = bar_src.with_bar_index(df)
        df = idx.withColumns({"signal": F.element_at(F.array(*map(F.lit, signals)), F.col("bar_idx") + 1), "reason": F.lit("r")})
    return df


class Given:
    def apply(self, frame):
        return frame


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_fill_happens_at_next_open(spark):
    frame = made(spark, [100, 102, 104, 106], [100, 101, 103, 105], signals=[1, 0, 0, 0])
    cfg = replay.ReplayConfig(initial_capital=1000, fee_bps=0, slippage_bps=0, max_position_pct=1.0)
    events = replay.replay(frame, Given(), cfg)
    f = rows(replay.fills(events).orderBy("seq"))
    assert [(x["side"], x["price"]) for x in f] == [("BUY", 101), ("SELL", 106)]
    assert f[1]["reason"] == replay.FORCED
    assert f[1]["cash_after"] == pytest.approx(1000 * 106 / 101)


def test_stop_wins_over_target_and_over_signal(spark):
    assert replay.level_hit(100, 94, 0.05, 0.01) == "stop-loss"
    assert replay.level_hit(100, 102, 0.05, 0.01) == "take-profit"
    assert replay.level_hit(math.nan, 94, 0.05, None) is None
    frame = made(spark, [100, 100, 90, 90, 90], signals=[1, 0, 1, 0, 0])
    f = rows(replay.fills(replay.replay(frame, Given(), replay.ReplayConfig(stop_loss_pct=0.05))).orderBy("seq"))
    assert [x["reason"] for x in f] == ["r", "stop-loss"]


def test_halt_is_for_good(spark):
    frame = made(spark, [100, 100, 50, 50, 50, 50], signals=[1, 0, 0, 1, 1, 0])
    events = replay.replay(frame, Given(), replay.ReplayConfig(max_drawdown_cutoff_pct=0.2))
    assert [x["reason"] for x in rows(replay.fills(events).orderBy("seq"))] == ["r", "drawdown limit reached"]
    assert rows(replay.halts(events))[0]["halt_ts"] == datetime(2024, 1, 3)


def test_sizing_before_full_lookback_buys_nothing(spark):
    frame = made(spark, [100, 101, 102, 103], signals=[1, 1, 1, 0])
    assert rows(replay.fills(replay.replay(frame, Given(), replay.ReplayConfig(target_vol=0.1)))) == []


def test_classifier_holds_its_minimum(spark):
    from pyspark.sql import functions as F

    frame = made(spark, [100] * 7).withColumn("p_up", F.lit(0.4))
    frame = frame.withColumn("p_up", F.when(F.col("ts") == F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz"), 0.9).otherwise(0.4))
    f = rows(replay.fills(replay.replay(frame, Classifier(0.6, 0.5, 3))).orderBy("seq"))
    assert [x["ts"].day for x in f] == [2, 5]


def test_basket_budget_and_ranking():
    cfg = basket.BasketConfig(max_open_positions=2, gross_exposure_cap=1.0)
    looks = {
        "A": basket.Look(10, 1, "a", 0.6, 0.1), "B": basket.Look(10, 1, "b", 0.0, 0.9),
        "C": basket.Look(10, 1, "c", 0.6, 0.5), "D": basket.Look(10, 1, "d", 0.6, 0.1),
    }
    orders, tripped = basket.decide_orders(basket.Book(1000, peak=1000), looks, {s: 10.0 for s in looks}, cfg)
    assert not tripped and orders == [("BUY", "C", 600.0, "c"), ("BUY", "A", 400.0, "a")]
    book = basket.Book(0, {"A": (10, 10.0)}, peak=1000)
    orders, tripped = basket.decide_orders(book, looks, {s: 5.0 for s in looks}, basket.BasketConfig(max_drawdown_cutoff_pct=0.5))
    assert tripped and orders == [("SELL", "A", 0.0, basket.HALT)]


def test_basket_replay_shares_cash(spark):
    frame = made(spark, [100] * 5, signals=[1, 0, 0, 0, 0]).unionByName(made(spark, [50] * 5, symbol="B", signals=[1, 0, 0, 0, 0]))
    frame = frame.unionByName(made(spark, [50] * 4, symbol="B", signals=[1, 0, 0, 0]).limit(0))
    cfg = basket.BasketConfig(initial_capital=1000, fee_bps=0, slippage_bps=0, max_position_pct=0.6)
    f = rows(replay.fills(basket.replay_basket(frame, Given(), cfg)).orderBy("seq"))
    assert [(x["symbol"], x["side"], round(x["gross_value"], 6)) for x in f] == [
        ("A", "BUY", 600), ("B", "BUY", 400), ("A", "SELL", 600), ("B", "SELL", 400)
    ]


def test_drawdown_and_trips(spark):
    curve = spark.createDataFrame(
        [("A", datetime(2024, 1, i + 1), float(v), 0.0, 0.0) for i, v in enumerate([100, 120, 90, 130])],
        "symbol string, ts timestamp_ntz, equity double, cash double, position_value double",
    )
    assert rows(metrics.equity_stats(curve, 100.0))[0]["max_drawdown_pct"] == pytest.approx(25)
    fills = spark.createDataFrame(
        [("A", 0, datetime(2024, 1, 1), "BUY", 1000.0, 10.0, "x"), ("A", 1, datetime(2024, 1, 3), "SELL", 1100.0, 11.0, "y")],
        "symbol string, seq int, ts timestamp_ntz, side string, gross_value double, fee double, reason string",
    )
    trip = rows(metrics.round_trips(fills))[0]
    assert (trip["pnl"], trip["holding_days"]) == (79, 2)
    assert rows(metrics.round_trip_stats(metrics.round_trips(fills)))[0]["profit_factor"] == math.inf


def test_quality_counts_each_error(spark):
    good = made(spark, [100, 101, 102, 103, 104])
    assert rows(quality.check_bars(good))[0]["passes"]
    bad = spark.createDataFrame(
        [("A", datetime(2024, 1, 1), -1.0, 2.0, 3.0, 9.0, -5.0), ("A", datetime(2024, 1, 1), None, 2.0, 1.0, 1.5, 1.0)], BAR
    )
    r = rows(quality.check_bars(bad))[0]
    assert (r["passes"], r["duplicate_ts"], r["null_values"], r["negative_volume"], r["high_below_low"]) == (False, 1, 1, 1, 1)
    assert (r["price_not_positive"], r["open_outside"], r["close_outside"]) == (1, 1, 1)
    with pytest.raises(ValueError, match="missing columns"):
        quality.check_bars(good.drop("close"))


def test_csv_errors_name_the_count(spark, tmp_path):
    (tmp_path / "X.csv").write_text("timestamp,open,high,low,close,volume\n2024-01-01,1,2,0.5,1,10\n2024-01-01,1,2,0.5,1,10\nbad,1,2,x,1,1\n")
    with pytest.raises(bar_src.SourceError, match="1 unreadable values in timestamp; 1 unreadable values in low"):
        bar_src.load_ohlcv_csv(spark, str(tmp_path / "X.csv"))
    (tmp_path / "Y.csv").write_text("timestamp,open,high,low,close,volume\n2024-01-01,1,2,0.5,1,10\n2024-01-01,1,2,0.5,1,10\n")
    assert bar_src.OfflineProvider(spark, str(tmp_path)).fetch_daily("Y", date(2024, 1, 1), date(2024, 1, 1)).count() == 1
    with pytest.raises(bar_src.SourceError):
        bar_src.OfflineProvider(spark, str(tmp_path)).fetch_daily("../Y", date(2024, 1, 1), date(2024, 1, 1))
    with pytest.raises(bar_src.SourceError, match="no such file"):
        bar_src.load_ohlcv_csv(spark, str(tmp_path / "none.csv"))
    assert news_src.OfflineNewsProvider(spark, str(tmp_path)).fetch_news("Z", date(2024, 1, 1), date(2024, 1, 2)).count() == 0


def test_labels_match_the_next_open(spark):
    frame = made(spark, [200 - i for i in range(20)], [100 + i for i in range(20)])
    got = rows(features.add_weights(features.add_labels(frame, 2), 2).orderBy("ts"))
    assert all(r["label"] == 1 for r in got[:17]) and all(r["label"] is None for r in got[17:])
    assert got[0]["fwd_return"] == pytest.approx(103 / 101 - 1)
    alive = [sum(1 for i in range(17) if i + 1 <= p <= i + 3) for p in range(20)]
    assert got[5]["weight"] == pytest.approx(np.mean([1 / alive[p] for p in range(6, 9)]))


def test_news_never_arrives_early(spark):
    b = made(spark, [100.0] * 8)
    utc = "symbol string, item_id string, published_at timestamp, first_seen_at timestamp, sentiment double, relevance double"
    seen = [datetime(2024, 1, 2, 20, 59, 59), datetime(2024, 1, 2, 21, 0, 0), datetime(2024, 1, 2, 21, 0, 1), datetime(2024, 2, 1)]
    ann = spark.createDataFrame([("A", str(i), datetime(2024, 1, 1), t, 1.0, 0.9) for i, t in enumerate(seen)], utc)
    got = {r["item_id"]: r["bar_idx"] for r in rows(news.arrivals(b, ann))}
    assert got == {"0": 2, "1": 2, "2": 3}  # the session of 2 January closes at 21:00 UTC and decides for the bar after
    f = rows(news.add_news_features(b, ann).orderBy("ts"))
    assert [r["n_news"] for r in f] == [0, 0, 2, 1, 0, 0, 0, 0] and f[0]["n_days_since"] == 1.0


def test_grid_and_splits():
    assert evaluation.expand_grid({"b": [1, 2], "a": [3]}) == [{"a": 3, "b": 1}, {"a": 3, "b": 2}]
    assert evaluation.expand_grid({}) == [{}]
    with pytest.raises(ValueError):
        evaluation.expand_grid({"a": []})
    with pytest.raises(ValueError):
        evaluation.expand_grid({"a": list(range(201))})
    assert evaluation.generate_splits(25, 10, 10, 10) == [(0, 10, 10, 20), (0, 20, 20, 25)]
    assert evaluation.generate_splits(25, 10, 10, 10, anchored=False)[1] == (10, 20, 20, 25)


def test_strategy_registry():
    assert make_strategy().rsi_sell_high == 80
    assert make_strategy("mean_reversion", {"entry_std": 3.0}) == MeanReversion(3.0)
    for bad in (("nope", {}), ("mean_reversion", {"x": 1}), ("mean_reversion", {"entry_std": 1.0, "exit_std": 2.0})):
        with pytest.raises(StrategyError):
            make_strategy(*bad)
    assert {d["name"] for d in describe_strategies()} >= {"trend_following", "mean_reversion", "event_overlay", "ml_classifier"}


def test_statistics():
    assert stats.probabilistic_sharpe(0.1, 0.0, 101, 0.0, 3.0) == pytest.approx(stats.NORMAL.cdf(1 / math.sqrt(1 + 0.5 * 0.01)))
    assert math.isnan(stats.probabilistic_sharpe(0.1, 0, 1, 0, 3)) and stats.expected_max_sharpe(1, 1) == 0
    assert stats.expected_max_sharpe(1000, 0.01) > stats.expected_max_sharpe(10, 0.01) > 0


def test_overfitting_extremes(spark):
    rng = np.random.default_rng(0)
    good = [(c, t, float(rng.normal(0.01 * (c == "c0"), 0.001))) for c in ("c0", "c1", "c2") for t in range(64)]
    df = spark.createDataFrame(good, "config string, obs_idx int, ret double")
    r = rows(significance.overfitting_probability(df, 8))[0]
    assert (r["pbo"], r["n_combinations"]) == (0.0, 70)


def test_paired_bootstrap_is_seeded(spark):
    df = spark.createDataFrame([("p", i, 0.01 + 0.001 * (i % 3)) for i in range(50)], "pair string, obs_idx int, diff double")
    a, b = (rows(significance.paired_test(df, 10, 50))[0] for _ in range(2))
    assert a == b and a["p_value"] == 0 and a["beats"]


def test_bootstrap_draws(spark, monkeypatch):
    from barloom.operators import significance as sig

    rng = random.Random(4)
    values = [rng.gauss(0.02, 1) for _ in range(90)]
    df = spark.createDataFrame([("p", i, v) for i, v in enumerate(values)], "pair string, obs_idx int, diff double").repartition(4)

    def sequential(resamples, block, seed):
        count = 0
        for r in range(resamples):
            at, total = 0, 0.0
            for t in range(len(values)):
                starts = t == 0 or sig.draw(seed, r, t, 0) < int(sig.PRIME / block)
                at = sig.draw(seed, r, t, 1) % len(values) if starts else (at + 1) % len(values)
                total += values[at]
            count += total <= 0
        return count / resamples

    for size in (7, 50):
        monkeypatch.setattr(sig, "RESAMPLES_A_TASK", size)
        got = sig.bootstrap_p_values(df, 120, 5.0, 3).first()
        assert got["p_value"] == sequential(120, 5.0, 3) and got["n"] == 90
    assert sig.bootstrap_p_values(df.limit(1), 10).first()["p_value"] is None
    # The draws look even: a fifth of the steps starts a block, places are spread.
    t = np.arange(20_000, dtype="i8")
    assert abs((sig.draw(1, 5, t, 0) < sig.PRIME // 5).mean() - 0.2) < 0.01
    assert abs(np.bincount(sig.draw(1, 5, t, 1) % 10, minlength=10) - 2000).max() < 200


def test_verdict_order(spark):
    nan, yes = math.nan, (True, True, True)
    cases = [
        ((9, 0.99, 0.1, 0.99, *yes), "inconclusive"), ((10, 0.99, 0.1, 0.99, *yes), "pass"),  # the fewest round trips
        ((50, nan, 0.1, 0.99, *yes), "inconclusive"), ((50, None, 0.1, 0.99, *yes), "inconclusive"),
        ((50, 0.99, nan, 0.99, *yes), "inconclusive"), ((50, 0.99, 0.1, None, *yes), "inconclusive"),
        ((50, 0.95, 0.5, 0.95, *yes), "pass"), ((50, 0.949, 0.5, 0.95, *yes), "fail"), ((50, 0.95, 0.501, 0.95, *yes), "fail"),
        ((50, 0.95, 0.5, 0.949, *yes), "fail"), ((50, 0.99, 0.1, 0.99, False, True, True), "fail"),
        ((50, 0.99, 0.1, 0.99, True, False, True), "fail"), ((50, 0.99, 0.1, 0.99, True, True, False), "fail"),
    ]
    df = spark.createDataFrame(
        [(i, *c) for i, (c, _) in enumerate(cases)],
        "i int, n_oos_trades int, deflated_sharpe double, pbo double, mc_percentile double, beats_buy_and_hold boolean, beats_rule boolean, beats_logistic boolean",
    )
    got = significance.verdict(df).orderBy("i").collect()
    assert [r["verdict"] for r in got] == [v for _, v in cases]
    assert got[0]["reasons"] == ["only 9 round trips out of sample, 10 needed"]
    assert got[8]["reasons"][-1] == "not met: pbo 0.501, needed at most 0.5" and len(got[8]["reasons"]) == 6


def test_money(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(100.0, "Buy"), (100.0, "sell")], "p double, side string")
    assert [r[0] for r in df.select(money.slipped(F.col("p"), F.col("side"), 10)).collect()] == pytest.approx([100.1, 99.9])
    with pytest.raises(Exception, match="unknown side"):
        df.select(money.slipped(F.col("p"), F.lit("x"), 10)).collect()
    use = spark.createDataFrame([("small", 1_000_000, 0), ("medium", 0, 1_000_000)], "model string, input_tokens long, output_tokens long")
    assert [r["cost_usd"] for r in rows(money.metered_cost(use))] == [0.5, 7.5]
    with pytest.raises(Exception, match="no rates"):
        money.metered_cost(use.withColumn("model", F.lit("x"))).collect()


def test_parse_annotation(spark):
    from pyspark.sql import functions as F

    good = '{"sentiment": 3, "relevance": "0.5", "event_type": "macro", "rationale": "r"}'
    df = spark.createDataFrame([(good,), (good.replace("macro", "x"),), ("{}",), ("no",)], "t string")
    got = [r[0] for r in df.select(annotate.parse_annotation(F.col("t"))).collect()]
    assert got[0]["sentiment"] == 1.0 and got[1:] == [None, None, None]


def test_table_upserts(spark, tmp_path):
    t = tables.Table(spark, str(tmp_path / "t"), ["k"], ["part"])
    frame = lambda data: spark.createDataFrame(data, "k int, v string, part string")
    t.upsert(frame([(1, "a", "x"), (2, "b", "y")]))
    assert t.upsert(frame([(1, "c", "x"), (3, "d", "x")])) == 2
    assert {(r.k, r.v) for r in t.read().collect()} == {(1, "c"), (2, "b"), (3, "d")}
    assert tables.sanitize({"a": math.inf, "b": [math.nan, -math.inf, 1.5]}) == {"a": 1e9, "b": [0.0, 0.0, 1.5]}


def test_broker_is_idempotent():
    b = paper.SimulatedBroker(cash=1000, fill_share=0.5)
    first = b.submit("dep1-2024-01-02-A-BUY", "A", "BUY", 10, 50.0)
    assert b.submit("dep1-2024-01-02-A-BUY", "A", "BUY", 10, 50.0) is first and len(b.fills) == 1
    assert (first["status"], first["filled_quantity"], b.cash, b.positions["A"]) == ("canceled", 5, 750, (5, 50.0))
    assert b.submit("x", "B", "SELL", 1, 5.0)["status"] == "rejected"
    assert paper.skip_reason(True, False, True, False) == "global kill switch" and paper.skip_reason(True, False, False, True) is None


def test_training_needs_two_classes(spark):
    panel = spark.createDataFrame(
        [(datetime(2024, 1, 1) + timedelta(days=i), "A", datetime(2024, 1, 2) + timedelta(days=i), 1.0, 0.1, 1.0, float(i)) for i in range(40)],
        "decision_ts timestamp_ntz, symbol string, label_end_ts timestamp_ntz, label double, fwd_return double, weight double, f double",
    )
    with pytest.raises(learning.TrainingError):
        learning.train_model(panel, features=["f"])
    with pytest.raises(learning.VersionError):
        learning.check_version({"feature_version": "v0"})
    assert learning.default_trials() == 16_896
