"""Registered walk-forward queries take the operators' defaults."""

from barloom.operators.evaluation import splits_frame
from barloom.operators.research import WalkForwardConfig
from barloom.plans import catalog


def test_registered_settings(monkeypatch, spark, sf_dir):
    assert catalog.FULL == WalkForwardConfig()
    assert (catalog.FULL.runs, catalog.FULL.blocks) == (200, 16)
    seen = []
    monkeypatch.setattr(catalog.evaluation, "walk_forward", lambda frame, name, grid, splits: seen.append(splits) or frame)
    catalog.QUERIES["v04_walk_forward"](spark, sf_dir)
    got = sorted(map(tuple, seen[0].collect()))
    assert got == sorted(map(tuple, splits_frame(catalog.bands(spark, sf_dir)).collect()))
