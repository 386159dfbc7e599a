"""Inversions, sign tests, greedy alignment and common subsequences against brute force."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ordered, rules, vectors


def tau(rows):
    signs = [np.sign((c - a) * (d - b)) for k, (a, b) in enumerate(rows) for c, d in rows[k + 1 :]]
    return sum(signs) / len(signs)


def test_count_inversions():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 200):
        order, value = np.sort(r.integers(0, 4, n)), r.integers(-5, 6, n) / 2
        want = [sum(order[j] == order[i] and value[j] > value[i] for j in range(i)) for i in range(n)]
        assert ordered.count_inversions(order, value).tolist() == want


@pytest.mark.parametrize(("size", "ranges"), [(4096, 128), (40, 8), (9, 16)])
def test_kendall_equals_all_pairs(spark, monkeypatch, size, ranges):
    """Groups from one row to 400, values of which one is in a third of all rows, in either column; a null group is one."""
    monkeypatch.setattr(ordered, "ROWS", size)
    monkeypatch.setattr(ordered, "RANGES", ranges)
    r = random.Random(2)
    groups = {"x": 400, "y": 120, "z": 1, "w": 2, None: 60, **{f"s{i}": 5 for i in range(30)}}
    one = lambda: r.choice([0.0, r.gauss(0, 1), round(r.random(), 1)])
    rows = [(g, one(), one()) for g, n in groups.items() for _ in range(n)]
    got = {x.g: x.tau for x in ordered.kendall(spark.createDataFrame([*rows, ("x", None, 1.0), ("z", 1.0, None)], "g string, a double, b double").repartition(5), "g").collect()}
    want = {g: tau([(a, b) for h, a, b in rows if h == g]) for g, n in groups.items() if n > 1}
    assert got.keys() == want.keys()
    assert all(got[g] == pytest.approx(want[g], abs=1e-9) for g in want)


def test_kendall_of_a_large_group(spark):
    """A million rows in one group, a third of them equal in a: no pairs are made."""
    rows = spark.range(1_000_000).select(F.lit(1).alias("g"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.rand(1) * 100).alias("a"), F.rand(2).alias("b"))
    start = time.time()
    got = ordered.kendall(rows, "g").first().tau
    assert abs(got) < 0.01
    assert time.time() - start < 120


def test_kendall_of_nothing(spark):
    assert ordered.kendall(spark.createDataFrame([], "g string, a double, b double"), "g").collect() == []


def test_randomisation_equals_brute_force(spark):
    r = random.Random(3)
    rows = [(i, r.random(), r.random()) for i in range(40)] + [(40, None, 1.0)]
    gap = np.array([0.0 if a is None else a - b for _, a, b in rows])
    signs = np.array([ordered._signs(1, i, 300) for i, _, _ in rows])
    sums = np.abs((gap[:, None] * signs).sum(axis=0))
    want = ((sums >= abs(gap.sum()) - 1e-12).sum() + 1) / 301
    got = ordered.randomisation_test(spark.createDataFrame(rows, "sent long, a double, b double").repartition(7), 300).first()
    assert (got.difference, got.p) == (pytest.approx(abs(gap.sum())), want)
    assert abs(signs.mean()) < 0.03
    assert ordered.randomisation_test(spark.createDataFrame([], "sent long, a double, b double"), 10).collect() == []


def test_greedy_alignment_equals_the_greedy_order(spark):
    r = random.Random(4)
    rows = [(g, f"l{r.randrange(6)}", f"r{r.randrange(6)}", r.choice([0.005, 0.2, 0.2, 0.5, r.random()])) for g in range(40) for _ in range(r.randrange(0, 20))]
    want = []
    for g in range(40):
        left, right = set(), set()
        for s, a, b in sorted((-s, a, b) for h, a, b, s in rows if h == g and s > 0.01):
            if a not in left and b not in right:
                left.add(a)
                right.add(b)
                want.append((g, a, b, -s))
    got = rules.greedy_align(spark.createDataFrame([*rows, (1, None, "r", 0.9), (2, "l", "r", None)], "rule_id long, lhs string, rhs string, score double"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_chain_of_rivals(spark):
    """Each pair meets a better one but the first: rounds go along the chain, and the result is the greedy one."""
    rows = [(1, i, i + k, 1.0 - i / 50 - k / 100) for i in range(12) for k in (0, 1)]
    got = rules.greedy_align(spark.createDataFrame(rows, "rule_id long, lhs long, rhs long, score double"))
    assert sorted((x.lhs, x.rhs) for x in got.collect()) == [(i, i) for i in range(12)]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_places_are_a_longest_common_subsequence():
    r = random.Random(5)
    for _ in range(600):
        a, b = ([r.choice("abc"[: r.randrange(1, 4)]) for _ in range(r.randrange(0, 14))] for _ in range(2))
        found = vectors.common_places(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))
        assert len(found) == lcs(a, b)


def test_pieces_put_both_sides_back_together(spark):
    r = random.Random(6)
    rows = [(i, [r.choice("ab") for _ in range(r.randrange(9))], [r.choice("ab") for _ in range(r.randrange(9))]) for i in range(60)] + [(60, None, ["a"]), (61, None, None)]
    got: dict = {}
    for x in vectors.difference_pieces(spark.createDataFrame(rows, "id long, left array<string>, right array<string>")).collect():
        got.setdefault(x.id, []).append((x.left, x.right))
    for i, a, b in rows:
        a, b = a or [], b or []
        pieces = got.get(i, [])
        assert sum(len(x) for x, _ in pieces) == len(a) - lcs(a, b)
        assert sum(len(y) for _, y in pieces) == len(b) - lcs(a, b)


def test_long_sides_take_little_time():
    r = random.Random(7)
    a, b = ([str(r.randrange(50)) for _ in range(4000)] for _ in range(2))
    start = time.time()
    assert len(vectors.common_places(a, b)) > 500
    assert time.time() - start < 5
