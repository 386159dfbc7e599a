"""Fitted models and samples by value: conditions of optimality, brute force, held-out rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import features, graph, softlogic
from corpusloom.sources import readers

COLUMNS = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    """Two columns of unlike spread; ``y`` and ``c`` follow them but for a tenth of the rows."""
    r = random.Random(1)
    out = []
    for i in range(600):
        a, b = r.gauss(3, 10), r.gauss(0, 0.5)
        c = 0 if a < -2 else 1 if b < 0 else 2
        if r.random() < 0.1:
            c = r.randrange(3)
        out.append((i, a, b, float(c == 2), float(c)))
    return spark.createDataFrame(out, "id long, a double, b double, y double, c double").persist()


def table(df):
    t = df.orderBy("id").toPandas()
    return t[COLUMNS].to_numpy(), t["y"].to_numpy(), t["c"].to_numpy()


def test_logistic_is_where_the_loss_is_flat(rows):
    """The gradient of the weighted, regularised loss over scaled columns is 0 at the fitted model."""
    x, y, _ = table(rows)
    model = features.logistic(rows, COLUMNS, "y")
    weight = np.where(y == 1, len(y) / y.sum(), len(y) / (len(y) - y.sum()))
    weight /= weight.sum()
    p = 1 / (1 + np.exp(-(x @ model.coefficients.toArray() + model.intercept)))
    mean = (weight[:, None] * x).sum(axis=0)
    scale = np.sqrt((weight[:, None] * (x - mean) ** 2).sum(axis=0))
    slope = ((weight * (p - y))[:, None] * x).sum(axis=0) / scale + 1e-4 * model.coefficients.toArray() * scale
    assert abs((weight * (p - y)).sum()) < 1e-3
    assert np.abs(slope).max() < 2e-3


def test_svm_is_no_worse_than_its_neighbours(rows):
    x, y, _ = table(rows)
    model = features.svm(rows, COLUMNS, "y")
    scale = x.std(axis=0, ddof=1)
    w, b = model.coefficients.toArray(), model.intercept
    loss = lambda w, b: np.maximum(0, 1 - (2 * y - 1) * (x @ w + b)).mean() + 1e-3 / 2 * ((w * scale) ** 2).sum()
    r = np.random.default_rng(2)
    near = [loss(w + r.normal(0, 0.05, 2) / scale, b + r.normal(0, 0.05)) for _ in range(200)]
    assert loss(w, b) <= min(near) + 5e-3


def test_one_vs_rest_takes_the_surest_class(rows):
    x, _, c = table(rows)
    model = features.one_vs_rest(rows, COLUMNS, "c")
    margins = np.stack([x @ m.coefficients.toArray() + m.intercept for m in model.models], axis=1)
    got = model.transform(features.assemble(rows, COLUMNS)).orderBy("id").toPandas()["prediction"].to_numpy()
    assert (got == margins.argmax(axis=1)).all()
    assert (got == c).mean() > 0.75


def test_reduced_dimensions_are_the_first_directions(rows):
    x, _, _ = table(rows)
    got = np.array([list(v) for v in features.reduce_dimensions(rows, COLUMNS, 2).orderBy("id").toPandas()["reduced"]])
    _, directions = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(np.abs(got), np.abs(x @ directions[:, ::-1]), atol=1e-6)


def test_linear_regression_is_least_squares(rows):
    x, _, c = table(rows)
    model = features.linear_regression(rows, COLUMNS, "c")
    want = np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]), c, rcond=None)[0]
    assert np.allclose([*model.coefficients, model.intercept], want, atol=1e-6)


def test_cross_validation_predicts_rows_from_other_folds(rows):
    """Each row is predicted once, by a mean over rows that are in none of its fold."""
    got = features.cross_validate(rows.select("id", "a"), "id", 5, lambda train, test: test.crossJoin(train.agg(F.avg("a").alias("m"), F.count("*").alias("n")))).collect()
    a = {r.id: r.a for r in rows.collect()}
    assert sorted(r.id for r in got) == sorted(a)
    for fold in range(5):
        inside = [r for r in got if r.fold == fold]
        others = [v for i, v in a.items() if i not in {r.id for r in inside}]
        assert all(r.n == len(others) and r.m == pytest.approx(sum(others) / len(others)) for r in inside)


def test_learned_similarity_ranks_held_out_pairs(rows):
    model = softlogic.learn_external_function(rows.filter("id % 2 = 0"), COLUMNS, "y")
    held = model.transform(rows.filter("id % 2 = 1")).select("y", "prediction").toPandas()
    x, y, _ = table(rows.filter("id % 2 = 1"))
    assert (held["prediction"] == held["y"]).mean() > 0.8
    assert np.mean(y == y.max()) < 0.7


def coin(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def test_snowball_equals_its_steps(spark):
    r = random.Random(3)
    edges = sorted({tuple(sorted(r.sample(range(60), 2))) for _ in range(110)})
    k, size, p = 3, 12, 0.6
    order = sorted(range(60), key=lambda n: (coin(0, n), n))[:k]
    part = {n: i for i, n in enumerate(order)}
    front = dict(part)
    for i in range(20):
        small = {q for q in range(k) if sum(v == q for v in part.values()) < size}
        new: dict = {}
        for a, b in [*edges, *((b, a) for a, b in edges)]:
            if front.get(a) in small and a in front and b not in part and coin(i, a, b) % 1_000_000 < int(p * 1_000_000):
                new[b] = min(new.get(b, k), front[a])
        part |= new
        front = new
        if not new:
            break
    nodes = spark.range(60).withColumnRenamed("id", "node")
    got = graph.split_snowball(nodes, spark.createDataFrame(edges, "src long, dst long"), k, size, p)
    assert {x.node: x.part for x in got.collect()} == part
    assert len(part) > 2 * k


def test_formats_of_lines_and_dims(spark):
    lines = ["w\t1\t2.5", "w\tx\t2", "w\ta\t1\tb\t2", "w\t1", "w", "w\t1e3\tinf", "w\tx\ty\tz"]
    got = [r.f for r in spark.createDataFrame([(x,) for x in [*lines, None]], "value string").select(readers.vector_format(F.col("value")).alias("f")).collect()]
    assert got[:-2] == [readers.detect_vector_format(x) for x in lines[:-1]]
    assert got[-2:] == ["interleaved", None]
    dims = spark.createDataFrame([(f"d{i % 37:02}",) for i in range(200)], "dim string")
    assert sorted((r.dim, r["index"]) for r in readers.dim_index(dims.repartition(5)).collect()) == [(f"d{i:02}", i) for i in range(37)]
