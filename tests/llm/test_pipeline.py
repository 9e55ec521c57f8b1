"""The pipeline's stages against brute force, and the registered SQL against DuckDB."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
import corpus_pipeline
from barloom.llm.queries import ORACLE, QUERIES

from .test_near_copies import kept_by_force
from .test_operators import check_packing


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        from barloom.llm.common import materialize

        docs = materialize(stage(spark, docs, sf_dir), "stage")
        out.append(docs.collect())
    return out


def test_language_stage_keeps_clean_documents(stages):
    before, after = {r["doc_id"] for r in stages[0]}, {r["doc_id"] for r in stages[1]}
    assert after <= before
    letters = {r["doc_id"] for r in stages[0] if r["text"] and any(map(str.isalpha, r["text"]))}
    assert after <= letters and len(after) >= 0.98 * len(letters)


def test_exact_stage(stages):
    last = {}
    for r in stages[1]:
        key = (r["text"] or "").encode().lower()
        last[key] = max(last.get(key, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(last.values())


def test_near_stage(stages):
    # The stage's own setting, five words and 0.8, beside the three-bit links that it keeps.
    assert sorted(r["doc_id"] for r in stages[3]) == kept_by_force({r["doc_id"]: r["text"] for r in stages[2]})


def test_mix_stage(stages):
    have = {r["doc_id"]: r for r in stages[3]}
    words = {i: len((r["text"] or "").split()) for i, r in have.items()}
    for r in stages[4]:
        assert have[r["doc_id"]]["text"].startswith(r["text"])
    taken = sum(len(r["text"].split()) for r in stages[4])
    assert abs(taken - 1.5 * sum(words.values())) < 100


def test_pack_stage(stages):
    from collections import Counter

    copies = Counter(r["doc_id"] for r in stages[4])
    once = [(r["doc_id"], r["text"]) for r in stages[4] if copies[r["doc_id"]] == 1]
    alone = {i for i, _ in once}
    seqs = {r["sequence_id"] for r in stages[5]}
    total = sum(r["length"] for r in stages[5])
    assert len(seqs) <= -(-total // 1024) * 1.02 + 1
    got = [r.asDict() for r in stages[5] if r["doc_id"] in alone]
    for r in got:  # offsets are held against whole sequences below
        r["sequence_id"], r["offset"] = (r["doc_id"], r["piece"]), 0
    check_packing(once, got)
    by_seq = {}
    for r in stages[5]:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length


def test_columns(stages):
    names = stages[0][0].asDict().keys()
    assert all(x[0].asDict().keys() == names for x in stages[1:5])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLE[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = lambda x: x[cols].sort_values(cols, ignore_index=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


def test_registered():
    names = __spark_entry__.queries()
    assert [n for n in range(1, 14) if not any(x.startswith(f"op{n}_") for x in names)] == []
    assert "pipeline" in names
