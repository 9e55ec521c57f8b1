"""Snapshot tables: versions, crashes between data and manifest, writers at once, deliveries that come again."""

import pytest

from barloom.functions import annotate
from barloom.sources.snapshots import Conflict, SnapshotTable
from barloom.sources.tables import Table, one_per_key

ROWS = "k int, v string, day string"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def held(table, version=None):
    return sorted((r.k, r.v, r.day) for r in table.read(version).collect())


@pytest.mark.parametrize("by", [(), ("day",)])
def test_versions(spark, tmp_path, by):
    t = SnapshotTable(spark, str(tmp_path / "t"), ["k"], by)
    assert not t.exists() and t.manifest() is None
    with pytest.raises(ValueError):
        t.read()
    assert t.upsert(frame(spark, [(1, "a", "x"), (2, "b", "y/ü"), (5, "n", None)])) == 3
    t.upsert(frame(spark, [(1, "c", "x"), (3, "d", "x"), (5, "o", None)]))
    assert held(t) == [(1, "c", "x"), (2, "b", "y/ü"), (3, "d", "x"), (5, "o", None)]
    assert len(held(t, 0)) == 3 and (1, "a", "x") in held(t, 0)
    t.insert_new(frame(spark, [(1, "z", "x"), (4, "e", "w")]))
    assert (1, "c", "x") in held(t) and (4, "e", "w") in held(t) and t.manifest()["version"] == 2
    if by:
        first, last = t.manifest(0)["parts"], t.manifest()["parts"]
        assert [p for p in first if first[p] == last[p]] == [p for p in first if "=y" in p]  # the untouched day keeps its folder
    t.upsert(frame(spark, []))
    assert len(held(t)) == 5


def test_a_crash_before_publishing_changes_nothing(spark, tmp_path, monkeypatch):
    t = SnapshotTable(spark, str(tmp_path / "t"), ["k"], ["day"])
    t.upsert(frame(spark, [(1, "a", "x")]))

    def die(manifest):
        raise RuntimeError("lost")

    monkeypatch.setattr(t, "_publish", die)
    with pytest.raises(RuntimeError):
        t.upsert(frame(spark, [(1, "b", "x"), (2, "b", "y")]), ("w", 0))
    monkeypatch.undo()
    again = SnapshotTable(spark, str(tmp_path / "t"), ["k"], ["day"])
    assert held(again) == [(1, "a", "x")]
    assert again.clean_up() == 1 and held(again) == [(1, "a", "x")]
    again.upsert(frame(spark, [(1, "b", "x"), (2, "b", "y")]), ("w", 0))
    assert held(again) == [(1, "b", "x"), (2, "b", "y")]


def test_batches_count_once(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), ["k"], ["day"])
    t.upsert(frame(spark, [(1, "a", "x")]), ("w", 0))
    t.upsert(frame(spark, [(1, "b", "x")]), ("w", 1))
    t.upsert(frame(spark, [(1, "a", "x")]), ("w", 0))
    assert held(t) == [(1, "b", "x")] and t.manifest()["version"] == 1
    t.upsert(frame(spark, [(1, "c", "x")]), ("other", 0))
    assert held(t) == [(1, "c", "x")]


def test_two_writers(spark, tmp_path, monkeypatch):
    a, b = (SnapshotTable(spark, str(tmp_path / "t"), ["k"], ["day"]) for _ in range(2))
    a.upsert(frame(spark, [(1, "a", "x")]))
    real, tries = a._publish, []

    def late(manifest):
        tries.append(manifest["version"])
        if len(tries) == 1:
            b.upsert(frame(spark, [(2, "b", "x")]))  # is first
        return real(manifest)

    monkeypatch.setattr(a, "_publish", late)
    a.upsert(frame(spark, [(3, "c", "x")]))
    assert tries == [1, 2] and held(b) == [(1, "a", "x"), (2, "b", "x"), (3, "c", "x")]
    monkeypatch.setattr(a, "_publish", lambda manifest: False)
    with pytest.raises(Conflict):
        a.upsert(frame(spark, [(3, "d", "x")]))


def test_replace_and_clean_up(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), ["k"], ["day"], keep=1)
    t.replace(frame(spark, [(1, "a", "x")]), {"day": "x"})
    t.append(frame(spark, [(2, "b", "y")]))
    t.replace(frame(spark, [(3, "c", "x")]), {"day": "x"})
    assert held(t) == [(2, "b", "y"), (3, "c", "x")]
    t.replace(frame(spark, []), {"day": "x"})
    assert held(t) == [(2, "b", "y")]
    t.clean_up()
    assert held(t) == [(2, "b", "y")] and len(t._versions()) == 1


def test_of_new_rows_with_one_key_the_least_is_inserted(spark, tmp_path):
    rows = [(1, "b", "x"), (1, "a", "z"), (1, "a", "y"), (2, None, "x"), (2, "c", "x"), (None, "n", "x"), (None, "m", "x")]
    for i in range(3):
        given = frame(spark, rows[i:] + rows[:i]).repartition(3)
        assert {(r.k, r.v, r.day) for r in one_per_key(given, ["k"]).collect()} == {(1, "a", "y"), (2, None, "x"), (None, "m", "x")}
    assert one_per_key(frame(spark, rows).select("k"), ["k"]).count() == 3
    plain = Table(spark, str(tmp_path / "plain"), ["k"])
    plain.insert_new(frame(spark, rows))
    plain.insert_new(frame(spark, [(1, "0", "0"), (3, "z", "x"), (3, "y", "x")]))
    assert {(r.k, r.v) for r in plain.read().where("k is not null").collect()} == {(1, "a"), (2, None), (3, "y")}


def test_waiting_ends():
    class Never:
        def collect(self, batch):
            return None

    with pytest.raises(TimeoutError):
        annotate.wait_for(Never(), "b", every=0.01, at_most=0.05)
