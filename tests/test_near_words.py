"""Buckets of random hyperplanes against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import vectors
from corpusloom.plans import vectors as plans


def all_pairs(df, least):
    words: dict = {}
    dims: dict = {}
    for r in df.collect():
        words.setdefault(r.word, {})[dims.setdefault(r.dim, len(dims))] = r.w
    names = sorted(words)
    x = np.zeros((len(names), len(dims)))
    for i, n in enumerate(names):
        for d, w in words[n].items():
            x[i, d] = w
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    return {(names[i], names[j]): s[i, j] for i, j in zip(*np.nonzero(s >= least - 1e-12), strict=True) if i != j}


@pytest.mark.parametrize("least", [0.7, 0.8])
def test_recall_of_given_words(spark, least):
    df = plans.letter_pairs(spark, "/root/testdata/sf0.001").persist()
    want = all_pairs(df, least)
    got = {(r.word, r.other): r.sim for r in vectors.near_words(df, least).collect()}
    assert got.keys() <= want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in got)
    assert len(got) >= 0.9 * len(want) > 100
    df.unpersist()


def test_hot_buckets_are_dealt_to_parts(spark, monkeypatch):
    """A third of the words have one vector and meet in one bucket: its parts meet, and each pair is found once."""
    monkeypatch.setattr(vectors, "BUCKET", 8)
    rows = [(f"h{i:03}", "x", 1.0) for i in range(100)] + [(f"w{i:03}", f"d{i}", 1.0) for i in range(200)] + [("none", "x", 0.0)]
    df = spark.createDataFrame(rows, "word string, dim string, w double").repartition(4)
    got = vectors.near_words(df, 0.95)
    assert got.count() == got.distinct().count() == 100 * 99
    assert got.filter(F.col("word") == "none").count() == 0


def test_more_words_make_finer_buckets(spark):
    df = spark.createDataFrame([("a", "x", 1.0)], "word string, dim string, w double")
    sizes = [vectors.hyperplane_buckets(df, 0.9, n)[1:] for n in (10, 10_000, 10_000_000)]
    assert [b for b, _ in sizes] == sorted(b for b, _ in sizes)
    for bits, bands in sizes:
        agree = (1 - np.arccos(0.9) / np.pi) ** bits
        assert 1 - (1 - agree) ** bands >= vectors.RECALL
        assert 10_000_000 / 2 ** sizes[-1][0] <= vectors.BUCKET


def test_no_words(spark):
    assert vectors.near_words(spark.createDataFrame([], "word string, dim string, w double")).collect() == []


def test_pairs_are_compared_where_they_meet(spark, monkeypatch):
    """Parts of a few words lose no pair, and pairs are made by no join."""
    monkeypatch.setattr(vectors, "PART", 16)
    rows = [(f"h{i:03}", "x", 1.0) for i in range(100)] + [(f"w{i:03}", f"d{i}", 1.0) for i in range(50)]
    got = vectors.near_words(spark.createDataFrame(rows, "word string, dim string, w double"), 0.95)
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.word, r.other) for r in got.collect()} == {(f"h{i:03}", f"h{j:03}") for i in range(100) for j in range(100) if i != j}
