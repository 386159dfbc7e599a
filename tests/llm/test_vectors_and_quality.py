"""Vector codes, hard negatives and quality rules against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import hard_negatives, integer_vectors, quality_rules, registry, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, row string"


def integers(rows):
    kept = [(i, tuple(math.floor(256 * x) for x in v), label) for i, v, label, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    return kept


def embeddings(seed, n, dims):
    """Random rows, many of them alike, repeated or broken, with columns that the operators use as names themselves."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        v = [r.choice([np.float32(r.gauss(0, 0.3)).item(), 0.25, -0.5]) for _ in range(dims)] if r.random() < 0.8 else [0.125] * dims
        if r.random() < 0.04:
            v[r.randrange(dims)] = r.choice([None, math.nan, math.inf, -math.inf])
        label = None if r.random() < 0.05 else r.choice([-3, 0, 0, 0, 1, 9])
        rows.append((i if r.random() < 0.9 else r.randrange(200), None if r.random() < 0.04 else v, label, "x"))
    return rows


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted(integers(rows), key=lambda x: (x[0], x[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            ds = [[sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)) for e in books[p]] for p in range(parts)]
            out.append([(d.index(min(d)), min(d)) for d in ds])
        return out

    for _ in range(rounds):
        chosen = assign()
        for p, e in itertools.product(range(parts), range(len(books[0]))):
            own = [c[p] for c, a in zip(cut, chosen, strict=True) if a[p][0] == e]
            if own:
                books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    errors: Counter = Counter()
    out = []
    for (i, _, label), a in zip(kept, assign(), strict=True):
        errors[label] += sum(d for _, d in a)
        out.append((i, "".join(f"{e:02x}" for e, _ in a), sum(d for _, d in a), label))
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted((i, code, error, errors[label], digest) for i, code, error, label in out)


def written(spark, tmp_path, name, df):
    df.coalesce(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize(("seed", "n", "dims"), [(1, 300, 64), (2, 40, 16), (3, 150, 48)])
def test_codes_equal_brute_force(spark, tmp_path, seed, n, dims):
    rows = embeddings(seed, n, dims)
    got = vector_codes.query(spark, written(spark, tmp_path, "embeddings", spark.createDataFrame(rows, VECTORS)))
    assert sorted(map(tuple, got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())) == brute_codes(rows)


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_hard_negatives"])
def test_vector_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    got = registry.queries()[name](spark, sf_dir)
    done = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in done.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(done.fetchall())


def test_boxes_leave_no_nearest_entry_out():
    r = np.random.default_rng(5)
    for _ in range(300):
        part = r.integers(-20, 20, size=(r.integers(1, 30), 3)) // r.integers(1, 8)
        book = r.integers(-20, 20, size=(12, 3)) // r.integers(1, 8)
        every = ((part[:, None] - book) ** 2).sum(axis=2)
        short = vector_codes._shortlist(part.min(axis=0), part.max(axis=0), book)
        chosen, error = vector_codes._nearest(part, book[short])
        assert (short[chosen] == every.argmin(axis=1)).all()
        assert (error == every.min(axis=1)).all()


def test_the_curve_goes_through_neighbours():
    """Places in a row on the curve are next to each other in the grid, and each has one place."""
    at = np.array(list(itertools.product(range(8), repeat=2))) - (1 << 14)
    place = vector_codes.hilbert(at)
    step = np.abs(np.diff(at[np.argsort(place)], axis=0)).sum(axis=1)
    assert len(set(place.tolist())) == 64
    assert (step == 1).all()


def test_blocks_shorten_the_lists():
    """Sorted parts lie in small boxes: most entries are ruled out for a block as a whole."""
    v = np.random.default_rng(6).normal(0, 32, size=(20000, 4)).astype(np.int64)
    book, v = v[:64], v[np.argsort(vector_codes.hilbert(v))]
    left = [len(vector_codes._shortlist(v[i : i + 128].min(axis=0), v[i : i + 128].max(axis=0), book)) for i in range(0, len(v), 128)]
    assert np.mean(left) < 40


def test_codes_of_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    rows, books = vector_codes.encode(empty)
    assert rows.collect() == []
    assert books.size == 0
    odd = [(5, [1.0] * 16, 1, ""), (None, [0.5] * 16, None, ""), (3, [0.5] * 32, 1, ""), (4, [], 1, ""), (5, [1.0] * 16, 1, ""), (6, [1e30] * 16, 1, ""), (7, [1.0] * 15, 1, "")]
    rows, books = vector_codes.encode(spark.createDataFrame(odd, VECTORS))
    assert [r.vec_id for r in rows.collect()] == [3]  # its length is the common one
    rows, books = vector_codes.encode(spark.createDataFrame([r for r in odd if r[0] != 3], VECTORS))
    assert sorted((str(r.vec_id), r.code, r.error) for r in rows.collect()) == [("5", "00" * 16, 0), ("5", "00" * 16, 0), ("None", "02" * 16, 0)]


def brute_negatives(rows):
    kept = []
    for i, v, label in integers(rows):
        if label is not None:
            kept.append((i, v, int(math.fmod(label + 1, 10)) if i % 7 == 0 else label))
    out = []
    for a, (i, v, label) in enumerate(kept):
        if i % 100 == 0:
            scored = sorted((-sum(map(int.__mul__, v, w)), j, b, of) for b, (j, w, of) in enumerate(kept) if b != a)
            for s, j, *_ in [x for x in scored if x[3] == label][:5]:
                inside = [x for x in scored if x[3] != label and 30 * -s <= 100 * -x[0] <= 90 * -s]
                out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(inside[:10])]
    return sorted(out)


@pytest.mark.parametrize(("seed", "n", "dims"), [(1, 700, 8), (2, 500, 3), (3, 1000, 2), (4, 20, 4)])
def test_negatives_equal_brute_force(spark, seed, n, dims):
    rows = embeddings(seed, n, dims)
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS))
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_negatives_in_chunks_and_small_trees(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CHUNK", 4)
    monkeypatch.setattr(hard_negatives, "TREE", 2)
    rows = [(i * 50, v, label, x) for i, v, label, x in embeddings(6, 60, 6)]
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS))
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows) != []


def test_bounds_hold_and_spare_scores():
    """No bound is ever on the wrong side, and near anchors make most scores needless."""
    r = np.random.default_rng(7)
    centre = r.normal(size=(1, 64))
    anchors = np.floor(256 * (centre + 0.02 * r.normal(size=(50, 64)))).astype(np.int64)
    vectors = np.floor(256 * r.normal(size=(2000, 64)) / 8).astype(np.int64)
    tree = hard_negatives.spanning_tree(np.arange(50), np.zeros(50, dtype=np.int64), anchors)
    assert sorted(tree.rows.tolist()) == list(range(50))
    seen = 0

    def wanted(i, low, high):
        true = vectors @ tree.vectors[i]
        assert ((low <= true) & (true <= high)).all()
        return (high >= np.sort(true)[-5]) if i else np.ones(len(low), dtype=bool)

    for i, at, score in hard_negatives._scan(tree, vectors, wanted):
        assert (score == vectors[at] @ tree.vectors[i]).all()
        seen += len(at) if i else 0
    assert seen < 0.3 * 49 * 2000


def test_large_components_are_exact(spark):
    rows = [(100, [400000.0, 3.0], 1, ""), (1, [400000.0, 2.9], 1, ""), (2, [250000.0, 3.1], 2, ""), (3, [250000.0, 3.2], 2, "")]
    assert sorted(map(tuple, hard_negatives.mine(spark.createDataFrame(rows, VECTORS)).collect())) == brute_negatives(rows) != []


def test_negatives_of_odd_tables(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).collect() == []
    null_id = [(100, [1.0, 0.0], 1, ""), (None, [1.0, 0.0], 1, ""), (2, [0.5, 0.0], 2, ""), (None, [0.5, 0.0], 2, ""), (3, None, 2, ""), (5, [0.5], 2, "")]
    got = [tuple(r) for r in hard_negatives.mine(spark.createDataFrame(null_id, VECTORS)).orderBy("rank").collect()]
    assert got == [(100, None, 1, 2, 65536, 32768), (100, None, 2, None, 65536, 32768)]


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts_equal_brute_force():
    r = random.Random(8)
    texts = ["", " ", "\n\n", "a a a a", "é b c #*|<>", "a\x0bb\x1cc", "x", "\n a \n a \n", "😀😀 😀"]
    texts += ["".join(r.choice("ab \n\t\r#é") for _ in range(r.randrange(120))) for _ in range(300)]
    got = quality_rules.counts(pa.array(texts, pa.large_string()))
    assert list(zip(*(x.tolist() for x in got), strict=True)) == [brute_counts(t) for t in texts]


def test_n_grams_stay_within_texts():
    r = random.Random(9)
    texts = ["".join(r.choice("abé😀") for _ in range(r.randrange(9))) for _ in range(200)]
    bucket, n = quality_rules.buckets(pa.array(texts, pa.large_string()))
    alone = [quality_rules.buckets(pa.array([t], pa.large_string())) for t in texts]
    assert n.tolist() == [max(len(t) - 3, 0) for t in texts]
    assert bucket.tolist() == [x for b, _ in alone for x in b.tolist()]


def brute_scores(rows, good):
    """Mean log ratios in millionths, from counts by dictionary."""
    grams = [quality_rules.buckets(pa.array([t or ""], pa.large_string()))[0].tolist() for _, t in rows]
    every = Counter(g for x in grams for g in x)
    own = Counter(g for (i, _), x in zip(rows, grams, strict=True) for g in x if i in good)
    a, b = sum(every.values()), sum(own.values())
    ratio = {g: round(1e6 * math.log((own[g] + 50 * b / a) / ((every[g] + 50) * (b / a)))) if b else 0 for g in every}
    return [sum(ratio[g] for g in x) / len(x) / 1e6 if x else 0.0 for x in grams]


def test_verdicts_equal_brute_force(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(quality_rules, "SLICE", 5000)
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    documents += [(900001, None), (900002, ""), (None, "ab cd " * 60), (900003, "\n".join(f"w{i} ###" for i in range(90))), documents[0]]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    labels += [(None, 1), (900001, 1), (900003, None), (labels[0][0], 0), (labels[1][0], labels[1][1])]
    good = {i for i, q in labels if q == 1 and i is not None} - {i for i, q in labels if q == 0}
    df = spark.createDataFrame([(*x, 0, 0.5) for x in documents], "doc_id long, text string, n_words int, score double")
    got = quality_rules.judge(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    want = []
    for (i, text), score in zip(documents, brute_scores(documents, good), strict=True):
        n = brute_counts(text)
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        want.append((i, *n, failed, round(score, 9), not failed and score >= -0.05))
    assert sorted(((*r[:7], round(r[7], 9), r[8]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_verdicts_on_rows_without_a_label(spark):
    """Trained on the quality of some documents, the rules find those of others."""
    base = "/root/testdata/sf0.1"
    documents = spark.read.parquet(f"{base}/documents.parquet")
    labels = spark.read.parquet(f"{base}/labels.parquet")
    got = quality_rules.judge(documents, labels.where("doc_id % 2 = 0"))
    held = got.join(labels.where("doc_id % 2 = 1 and quality is not null"), "doc_id").where("not base_failed").groupBy("quality", "kept").count()
    found = {(r.quality, r.kept): r["count"] for r in held.collect()}
    assert found.get((1, False), 0) == 0
    assert found.get((0, True), 0) <= 0.02 * found[0, False]


def test_verdicts_of_empty_tables(spark):
    documents = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.judge(documents, labels).collect() == []
    one = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    r = quality_rules.judge(one, labels).first()
    assert (r.n_words, r.score, r.kept) == (60, 0.0, True)


def test_usable_vectors(spark):
    rows = [(1, [0.1, -0.1], 1, ""), (2, None, 1, ""), (3, [0.1, None], 1, ""), (4, [math.nan, 0.0], 1, "")]
    got = integer_vectors.numbered(spark.createDataFrame(rows, VECTORS)).collect()
    assert [(r.vec_id, r.v) for r in got] == [(1, [25, -26])]
