"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from barloom.llm import near_copies

from .test_operators import WORD, LOWER, slow_fingerprint


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_force(texts):
    sets, fps = {i: shingles(t) for i, t in texts.items()}, {i: slow_fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both * 5 >= (len(sets[a]) + len(sets[b]) - both) * 4 or (fps[a] ^ fps[b]).bit_count() <= 3:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return sorted({find(i) for i in texts})


def test_stage_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect())
    assert got == kept_by_force({r["doc_id"]: r["text"] for r in docs.collect()})


@pytest.mark.parametrize("hot", [2, 64])
def test_edited_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(near_copies.similar_links, "__defaults__", (hot,))
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = {}
    for base in range(12):
        words = [word() for _ in range(200)]
        for copy in range(8):
            edited = list(words)
            for at in rng.sample(range(200), copy):
                edited[at] = word()
            texts[base * 10 + copy] = " ".join(edited)
    docs = spark.createDataFrame([*texts.items(), (None, texts[0])], "doc_id long, text string")
    got = [r["doc_id"] for r in near_copies.drop_near_copies(docs).collect()]
    assert sorted(i for i in got if i is not None) == kept_by_force(texts)
    assert got.count(None) == 1
    assert near_copies.drop_near_copies(docs.where("false")).count() == 0


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(3)
    for size in (5, 150, 2000):
        for gone in (0, 1, 7, size // 3):
            a = rng.integers(0, 1 << 63, size, "u8")
            b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, gone, "u8")])
            x, y = (near_copies.sketch(s).view("u8") for s in (a, b))
            differ = int(np.bitwise_count(x ^ y).sum())
            assert differ <= 2 * gone and (size > 150 or gone > 7 or differ >= 2 * gone - 4)
