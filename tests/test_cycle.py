"""The daily cycle, strategies by symbol, annotation batches and training choices, on hand-made frames."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.functions import annotate
from barloom.operators import basket, cycle, learning, paper, replay
from barloom.operators.strategies import BuyAndHold, Classifier, Flat, MeanReversion, PerSymbol, StrategyError

START = datetime(2024, 1, 1)


def rows(df):
    return [r.asDict() for r in df.collect()]


def bars(spark, symbols=("A", "B"), n=8, **more):
    data = [(s, START + timedelta(days=i), 100.0 + 0.5 * i, 101.0, 99.0, 100.0, 1000.0) for s in symbols for i in range(n)]
    return spark.createDataFrame(data, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


@pytest.fixture
def store(spark, tmp_path):
    return cycle.CycleStore(spark, str(tmp_path / "cycle"))


def test_cycle_fills_and_slippage(spark, store):
    frame, broker = bars(spark), paper.SimulatedBroker(cash=10_000.0)
    own = cycle.Deployment(1, ("A", "B"), BuyAndHold(), 10_000.0, basket.BasketConfig(max_position_pct=0.4, initial_capital=10_000.0))
    result, after = cycle.run_cycle(store, broker, own, frame, "2024-01-05")
    assert (result.orders, result.fills, result.reconciliations, result.skipped, after.halted) == (2, 2, 0, None, False)
    # 40 % of 10,000 at a close of 100 is 40 shares; the open of the fifth bar is 102, the modeled price.
    assert {(r["symbol"], r["quantity"], r["price"], r["slippage_delta"]) for r in rows(store.fills.read())} == {("A", 40.0, 102.0, 0.0), ("B", 40.0, 102.0, 0.0)}
    assert {(r["status"], r["filled_quantity"]) for r in rows(store.orders.read())} == {("filled", 40.0)}
    snap = rows(store.snapshots.read())
    assert len(snap) == 1 and (snap[0]["cash"], snap[0]["equity"]) == (10_000 - 80 * 102.0, 10_000 - 80 * 2.0)
    # Again: nothing is bought or written twice.
    again, _ = cycle.run_cycle(store, broker, own, frame, "2024-01-05")
    assert (again.fills, len(broker.fills)) == (2, 2) and store.fills.read().count() == 2 and store.positions.read().count() == 2
    assert store.snapshots.read().count() == 1
    # Held and full: a day later there is nothing to order, and the next day's rows stand beside the first's.
    later, _ = cycle.run_cycle(store, broker, own, frame, "2024-01-06")
    assert later.orders == 0 and store.snapshots.read().count() == 2 and store.positions.read().count() == 4


def test_cycle_guards_and_divergences(spark, store):
    frame, broker = bars(spark), paper.SimulatedBroker(cash=10_000.0, fill_share=0.5, reject=frozenset("B"), positions={"Z": (3.0, 5.0)})
    own = cycle.Deployment(2, ("A", "B"), BuyAndHold(), 10_000.0, basket.BasketConfig(max_position_pct=0.4))
    skipped = [
        cycle.submit_pass(store, broker, own, frame, "2024-01-05", kill_switch=True)[0].skipped,
        cycle.submit_pass(store, broker, cycle.replace(own, enabled=False), frame, "2024-01-05")[0].skipped,
        cycle.submit_pass(store, broker, cycle.replace(own, halted=True), frame, "2024-01-05")[0].skipped,
        cycle.submit_pass(store, broker, own, frame, "2024-01-05", market_open=False)[0].skipped,
        cycle.submit_pass(store, broker, own, frame.where("false"), "2024-01-05")[0].skipped,
    ]
    assert skipped == ["global kill switch", "disabled", "halted", "market closed", "no data"] and not broker.orders
    result, _ = cycle.run_cycle(store, broker, own, frame, "2024-01-05")
    kinds = {(r["kind"], r["symbol"]) for r in rows(store.divergences.read())}
    assert kinds == {("partial_fill", "A"), ("reject", "B"), ("unexpected_position", "Z")} and result.reconciliations == 3


def test_cycle_halts(spark, store):
    frame = bars(spark).withColumn("close", F.when(F.col("ts") >= START + timedelta(days=4), 50.0).otherwise(F.col("close")))
    broker = paper.SimulatedBroker(cash=10_000.0)
    own = cycle.Deployment(3, ("A", "B"), BuyAndHold(), 10_000.0, basket.BasketConfig(max_position_pct=0.4, max_drawdown_cutoff_pct=0.2))
    _, own = cycle.run_cycle(store, broker, own, frame, "2024-01-03")
    result, own = cycle.run_cycle(store, broker, own, frame, "2024-01-06")
    assert result.halted and own.halted and not broker.positions
    assert cycle.submit_pass(store, broker, own, frame, "2024-01-07")[0].skipped == "halted"
    shown = rows(cycle.expected_and_live(own, frame, store))[0]
    assert shown["live_n"] == 2 and shown["expected_n"] == 8 and shown["expected_final_equity"] > 10_000  # opens kept rising


def test_strategies_by_symbol(spark):
    frame = bars(spark, ("A", "B", "C")).withColumns({"sma_20": F.lit(120.0), "std_20": F.lit(1.0), "p_up": F.lit(0.9)})
    mapped = PerSymbol({"A": BuyAndHold(), "B": Flat(), "C": Classifier(0.5, 0.4, 1)})
    for strategy in (mapped, PerSymbol(lambda s: mapped.source[s])):
        got = {r["symbol"] for r in rows(replay.fills(replay.replay(frame, strategy)))}
        assert got == {"A", "C"}
    with pytest.raises(StrategyError, match="no strategy for C"):
        replay.replay(frame, PerSymbol({"A": Flat(), "B": Flat()}))
    both = replay.fills(basket.replay_basket(frame, PerSymbol({"A": BuyAndHold(), "B": Flat(), "C": MeanReversion()}), basket.BasketConfig(max_position_pct=0.3)))
    assert {r["symbol"] for r in rows(both)} == {"A", "C"}


def test_annotation_batches(spark, tmp_path):
    news = spark.createDataFrame([("2", "aaaaaaaa", "h", "b"), ("1", "aaaaaaaa", "h1", "b1"), ("3", "bbbbbbbb", "h", "b")], "item_id string, content_hash string, headline string, body string")
    client = annotate.StubAnnotator(spark, str(tmp_path / "batches"), polls=2)
    wanted = annotate.annotation_requests(news, None, 1)
    assert [(r["content_hash"], r["headline"]) for r in rows(wanted)] == [("aaaaaaaa", "h1")]
    batch = client.submit(wanted)
    assert client.collect(batch) is None and client.collect(batch) is None
    found = client.collect(batch)
    assert [r["content_hash"] for r in rows(found)] == ["aaaaaaaa"]
    assert [r["content_hash"] for r in rows(annotate.annotation_requests(news, found))] == ["bbbbbbbb"]
    assert annotate.annotation_requests(news, found, prompt_version="v2").count() == 2
    with pytest.raises(KeyError):
        client.collect("none")


@pytest.fixture(scope="module")
def panel(spark):
    import random

    rng = random.Random(1)
    data = []
    for i in range(300):
        x = rng.gauss(0, 1)
        label = float(x + rng.gauss(0, 0.5) > 0)
        day = START + timedelta(days=i)
        data.append((day, "S", day + timedelta(days=1), day + timedelta(days=6), label, 0.02 * (2 * label - 1), 0.5, x))
    return spark.createDataFrame(data, "decision_ts timestamp_ntz, symbol string, label_start_ts timestamp_ntz, label_end_ts timestamp_ntz, label double, fwd_return double, weight double, f double")


@pytest.mark.parametrize(
    "more", [{"calibration": "isotonic"}, {"calibration": "sigmoid"}, {"calibration": "none"}, {"estimator": learning.logistic_stages}, {"stop_early": False}]
)
def test_training_choices(spark, panel, tmp_path, more):
    cfg = learning.TrainingConfig(trees=5, depth=2, min_selected=5, **more)
    model = learning.train_model(panel, cfg, ["f"])
    assert model.metadata["calibrated"] == (None if more.get("calibration") == "none" else more.get("calibration", "isotonic"))
    scored = model.score(panel, "p")
    assert rows(learning.diagnostics(scored.withColumn("split", F.lit(0))))[0]["auc"] > 0.85
    assert scored.columns == [*panel.columns, "p"] and scored.where("p < 0 or p > 1 or p is null").count() == 0
    name = learning.save_model(model, str(tmp_path))
    assert learning.train_model(panel, cfg, ["f"]).id == model.id
    again = learning.load_model(spark, str(tmp_path), name).score(panel, "q").join(scored, "decision_ts")
    assert again.where("abs(p - q) > 1e-9").count() == 0


def test_registry_refuses_changed_models(spark, panel, tmp_path):
    model = learning.train_model(panel, learning.TrainingConfig(trees=4, depth=2, min_selected=5), ["f"])
    name = learning.save_model(model, str(tmp_path), {"run": "7", "bars": "made up"})
    listed = rows(learning.list_models(spark, str(tmp_path)))[0]
    assert listed["model_id"] == name and listed["provenance"] == {"run": "7", "bars": "made up"} and len(listed["artifact_sha256"]) == 64
    assert learning.load_model(spark, str(tmp_path), name).provenance["run"] == "7"
    forest = next(p for p in (tmp_path / name / "forest").iterdir() if p.name.startswith("part-") and p.stat().st_size)
    kept = forest.read_text()
    forest.write_text(kept.replace("0", "1", 1))
    (forest.parent / f".{forest.name}.crc").unlink(missing_ok=True)
    with pytest.raises(learning.IntegrityError):
        learning.load_model(spark, str(tmp_path), name)
    forest.write_text(kept)
    assert learning.load_model(spark, str(tmp_path), name).id == name
    (tmp_path / name / "forest" / "more").write_text("x")
    with pytest.raises(learning.IntegrityError):
        learning.load_model(spark, str(tmp_path), name)
    meta = next(p for p in (tmp_path / name / "metadata").iterdir() if p.name.startswith("part-") and p.stat().st_size)
    (tmp_path / name / "forest" / "more").unlink()
    meta.write_text(meta.read_text().replace('"enter": 0', '"enter": 9'))
    (meta.parent / f".{meta.name}.crc").unlink(missing_ok=True)
    with pytest.raises(learning.IntegrityError):
        learning.load_model(spark, str(tmp_path), name)


def test_training_end(panel):
    kept = learning.train_until(panel, "2024-03-01")
    assert kept.count() == 61 and learning.train_until(panel).count() == 300
    with pytest.raises(learning.TrainingError):
        learning.train_until(panel, "2020-01-01")
    with pytest.raises(learning.TrainingError):
        learning.TrainingConfig(calibration="other")


def test_version_gate():
    both = learning.component_versions(["f_rsi", "n_decayed"])
    assert both == {"price": "v1", "news": "v1"} and learning.component_versions(["f_rsi"]) == {"price": "v1"}
    learning.check_version({"versions": both})
    for wrong in ({"price": "v0"}, {"price": "v1", "news": "v0"}, {"price": "v1", "other": "v1"}):
        with pytest.raises(learning.VersionError):
            learning.check_version({"versions": wrong})
