"""Recurrences over blocks against the plain recursion, and how the work is spread."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import recurrence
from barloom.operators.indicators import add_indicators
from barloom.operators.recurrence import blocks_back, linear_scan, number_bars

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def series(sizes, seed=1):
    rng = random.Random(seed)
    out = []
    for symbol, n in sizes.items():
        day = datetime(2001, 1, 5)
        for _ in range(n):
            day += timedelta(days=rng.choice([1, 1, 1, 2, 40]))
            x = 100 + rng.gauss(0, 5)
            out.append((symbol, day, x, x + 1, x - 1, x, float(rng.randint(1, 99))))
    return out


def plain(rows, a, b):
    y, out = 0.0, {}
    for i, r in enumerate(sorted(rows, key=lambda r: r[1])):
        y = a * y + b(i, r)
        out[r[1]] = y
    return out


@pytest.mark.parametrize(("block", "fold"), [(1, False), (3, False), (256, False), (7, True)])
def test_scan_is_the_recursion(spark, monkeypatch, block, fold):
    monkeypatch.setattr(recurrence, "BLOCK", block)
    rows = series({"A": 400, "B": 1, "C": 37, None: 5})
    numbered = number_bars(spark.createDataFrame(rows, BARS).repartition(5), "close")
    steps = {"slow": (0.95, F.col("close")), "fast": (0.1, F.col("close") - 100)}
    got = linear_scan(numbered, steps, fold).collect()
    assert len(got) == len(rows)
    for symbol in ("A", "B", "C", None):
        mine = [r for r in rows if r[0] == symbol]
        slow, fast = plain(mine, 0.95, lambda i, r: r[5]), plain(mine, 0.1, lambda i, r: r[5] - 100)
        ordered = sorted((r for r in got if r["symbol"] == symbol), key=lambda r: r["ts"])
        assert [r["_pos"] for r in ordered] == list(range(len(mine)))
        closes = [r["close"] for r in ordered]
        assert [r["_before_close"] for r in ordered] == [None, *closes[:-1]]
        for r in ordered:
            assert math.isclose(r["slow"], slow[r["ts"]], rel_tol=1e-11) and math.isclose(r["fast"], fast[r["ts"]], rel_tol=1e-9, abs_tol=1e-9)


def test_factors_are_bounded(spark):
    numbered = number_bars(spark.createDataFrame(series({"A": 3}), BARS))
    for a in (0.0, 0.01, 1.0):
        with pytest.raises(ValueError):
            linear_scan(numbered, {"y": (a, F.col("close"))})
    assert 0.99 ** (blocks_back(0.99) * recurrence.BLOCK - recurrence.BLOCK) == 0.0 or blocks_back(0.99) > 280


def test_a_symbol_is_split(spark, monkeypatch):
    monkeypatch.setattr(recurrence, "BLOCK", 16)
    frame = spark.createDataFrame(series({"A": 500}), BARS)
    plan = add_indicators(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    spread = number_bars(frame).select("_block").distinct().count()
    assert spread == -(-500 // 16)
    assert "hashpartitioning(symbol" in plan and "_block" in plan
