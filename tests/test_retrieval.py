"""Token and phrase retrieval, and most probable truths, against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval, rules, softlogic


def token_rows(seed, n, name):
    """Ids with tokens, most of them with common ones, some repeated, some null."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        for _ in range(r.randrange(0, 6)):
            rows.append((i, r.choice(["the", "of", "and", f"w{r.randrange(40)}", f"x{r.randrange(400)}"])))
    return [*rows, *rows[:5], (n, None)], f"{name} long, token string"


@pytest.mark.parametrize(("common", "part"), [(10_000, 4096), (50, 7), (0, 3)])
def test_token_pairs_equal_brute_force(spark, monkeypatch, common, part):
    monkeypatch.setattr(retrieval, "COMMON_PAIRS", common)
    monkeypatch.setattr(retrieval, "PART", part)
    q, qs = token_rows(1, 80, "pair_id")
    r, rs = token_rows(2, 60, "rule_id")
    want = sorted({(a, b) for a, s in q for b, t in r if s == t and s is not None})
    assert sorted(map(tuple, rules.match_any_token(spark.createDataFrame(q, qs), spark.createDataFrame(r, rs)).collect())) == want


def test_common_tokens_make_each_pair_once_and_are_dealt_out(spark, monkeypatch):
    """A third of all rows have one token: no two parts of it make more than their share of the pairs."""
    monkeypatch.setattr(retrieval, "PART", 32)
    q = spark.range(300).select(F.col("id").alias("pair_id"), F.explode(F.array(F.lit("the"), F.lit("of"), F.concat(F.lit("w"), F.col("id").cast("string")))).alias("token"))
    r = q.withColumnRenamed("pair_id", "rule_id")
    assert [t for t, _, _ in retrieval.common_tokens(q, r)] == ["of", "the"]
    pairs = retrieval.token_pairs(q, r)
    assert pairs.count() == pairs.distinct().count() == 90_000
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan


def test_no_tokens(spark):
    q, r = spark.createDataFrame([], "pair_id long, token string"), spark.createDataFrame([(1, "a")], "rule_id long, token string")
    assert retrieval.token_pairs(q, r).collect() == []


def test_phrase_places_equal_brute_force(spark):
    r = random.Random(3)
    texts = [(i % 50, [r.choice("aaabbcd") for _ in range(r.randrange(0, 12))]) for i in range(60)] + [(99, None)]
    phrases = [(i, [r.choice("aabbcde") for _ in range(r.randrange(0, 5))]) for i in range(40)] + [(0, ["a", "b"]), (0, ["a", "b"]), (98, None)]
    got = retrieval.phrase_places(spark.createDataFrame(texts, "pair_id long, tokens array<string>"), spark.createDataFrame(phrases, "rule_id long, tokens array<string>"))
    seen = {(i, tuple(p)) for i, p in phrases if p}
    want = sorted((i, k, at) for i, t in texts if t for k, p in seen for at in range(len(t)) if tuple(t[at : at + len(p)]) == p)
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 300
    after = retrieval.phrase_places(spark.createDataFrame(texts, "pair_id long, tokens array<string>"), spark.createDataFrame(phrases, "rule_id long, tokens array<string>"), not_after="c")
    kept = sorted((i, k, at) for i, t in texts if t for k, p in seen for at in range(len(t)) if tuple(t[at : at + len(p)]) == p and (at == 0 or t[at - 1] != "c"))
    assert sorted(map(tuple, after.collect())) == kept


def test_phrase_pair_scores(spark):
    texts = spark.createDataFrame([(1, ["a", "red", "car"]), (2, ["some", "red", "car"])], "pair_id long, tokens array<string>")
    hyps = spark.createDataFrame([(1, ["blue", "bus"]), (2, ["blue", "bus"])], "pair_id long, tokens array<string>")
    phrases = spark.createDataFrame([(7, ["red", "car"], [1.0, 0.0]), (8, ["blue", "bus"], [1.0, 1.0]), (9, ["bus"], [0.0, -1.0])], "rule_id long, tokens array<string>, vec array<double>")
    got = sorted((r.pair_id, r.lhs_id, r.rhs_id, round(r.score, 6)) for r in rules.phrase_pair_scores(texts, hyps, phrases).collect())
    assert got == [(1, 7, 8, 0.707107), (1, 7, 9, 0.0)]


def least_cost(terms, costs, n):
    """A hinge loss is least at a point where n of its edges and bounds meet: all such points are tried."""
    planes = [([terms.get((r, j), 0.0) for j in range(n)], c) for r, (_, c) in enumerate(costs)]
    planes += [([float(i == j) for i in range(n)], -b) for j in range(n) for b in (0.0, 1.0)]
    cost = lambda z: sum(w * max(0.0, c + sum(terms.get((r, j), 0.0) * z[j] for j in range(n))) for r, (w, c) in enumerate(costs))
    best = np.inf
    for chosen in itertools.combinations(planes, n):
        a, b = np.array([x for x, _ in chosen]), -np.array([c for _, c in chosen])
        if abs(np.linalg.det(a)) > 1e-9:
            z = np.linalg.solve(a, b)
            if (z > -1e-9).all() and (z < 1 + 1e-9).all():
                best = min(best, cost(z))
    return best, cost


@pytest.mark.parametrize("seed", [1, 2])
def test_map_inference_proves_the_least_cost(spark, seed):
    r = random.Random(seed)
    n = 3
    terms = {(k, j): r.choice([-1.0, 1.0, 0.5]) for k in range(9) for j in r.sample(range(n), 2)}
    costs = [(r.random() * 3, r.uniform(-1, 1)) for _ in range(9)] + [(2.0, 0.25), (1.0, -0.5)]  # the last have no terms
    best, cost = least_cost(terms, costs, n)
    rows = [(k, j, c / 2) for (k, j), c in terms.items() for _ in (0, 1)] + [(77, 0, 1.0), (0, None, 1.0)]
    got = softlogic.map_inference(spark.createDataFrame(rows, "rule long, atom long, coefficient double"), spark.createDataFrame([(k, *x) for k, x in enumerate(costs)], "rule long, weight double, constant double"), tolerance=0.01).collect()
    z = [x.truth for x in sorted(got, key=lambda x: x.atom)]
    assert len(z) == n
    assert cost(z) == pytest.approx(got[0].cost, abs=1e-6)
    assert got[0].bound - 1e-9 <= best <= got[0].cost + 1e-9
    assert got[0].cost - got[0].bound <= 0.01 * max(1.0, got[0].cost)


def test_map_inference_of_nothing_and_errors(spark):
    terms = spark.createDataFrame([], "rule long, atom long, coefficient double")
    costs = spark.createDataFrame([(1, 1.0, 2.0)], "rule long, weight double, constant double")
    assert softlogic.map_inference(terms, costs).collect() == []
    one = spark.createDataFrame([(1, 1, 1.0), (2, 1, -1.0)], terms.schema)
    both = spark.createDataFrame([(1, 1.0, -0.3), (2, 0.7, 0.6)], costs.schema)
    with pytest.raises(RuntimeError, match="not within"):
        softlogic.map_inference(one, both, rounds=1, every=1, tolerance=1e-9)
    with pytest.raises(ValueError, match="below 0"):
        softlogic.map_inference(one, spark.createDataFrame([(1, -1.0, 0.0)], costs.schema))
