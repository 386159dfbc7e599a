"""Queries' work grows with their tables: no intermediate table of all pairs, no work in one task."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import time

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import similarity, text
from corpusloom.operators import corpus, evaluate, features, graph, nearest, ordered, qa, rules, softlogic, thesaurus
from corpusloom.plans import features as feature_plans
from corpusloom.plans import corpus as corpus_plans
from corpusloom.plans import qa as qa_plans
from corpusloom.plans import rules as rule_plans
from corpusloom.plans import softlogic as soft_plans


def rows_of(df, digits=9):
    return sorted(tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_embed_proximity_by_each_questions_own_pairs(spark):
    context = spark.createDataFrame([("a", i, t) for i, t in enumerate("red cat bluebird rod car".split())] + [("b", i, t) for i, t in enumerate("cab greenish".split())], "qid string, place int, token string")
    question = spark.createDataFrame([("a", 0, "rest"), ("a", 1, "car"), ("b", 0, "cap")], "qid string, place int, token string")
    entities = spark.createDataFrame([("a", "bluebird"), ("b", "greenish")], "qid string, entity string")
    every = spark.createDataFrame([("red", "rest", 0.5), ("cat", "car", 0.5), ("car", "car", 1.0), ("cab", "cap", 0.5), ("cab", "car", 0.5)], "token string, other string, sim double")
    own = every.join(question.select("qid", F.col("token").alias("other")), "other").select("qid", "token", "other", "sim")
    want = [("a", "bluebird", round(0.5 / 3 + 0.5 / 2 + 1 / 3, 9)), ("b", "greenish", 0.25)]
    assert rows_of(qa.embed_proximity(context, question, every, entities)) == want
    assert rows_of(qa.embed_proximity(context, question, own, entities)) == want


def test_achievable_bound_without_a_yes_is_null(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0)], "features string, label int")
    assert [tuple(r) for r in rules.achievable_bound(rows).collect()] == [(2 / 3, None, None, None)]


def test_similar_kinds_of_all_lengths(spark, sf_dir):
    """Kinds of parts of unlike length are a little alike."""
    n = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_type").distinct().count()
    rows = {(r.e1, r.e2): r.truth for r in soft_plans.similar(spark, sf_dir).collect()}
    assert len(rows) == n * n
    assert {(len(a) == len(b), a == b): t for (a, b), t in rows.items()} == {(True, True): 1.0, (True, False): 0.5, (False, False): 0.1}


def test_lexical_pairs_look_in_words_of_both_sides(spark, sf_dir):
    """Words out of the vocabulary stand on either side, and relations are those of all words."""
    pairs, words, relations = feature_plans.types(spark, sf_dir)
    known = {r.word for r in words.collect()}
    rows = pairs.collect()
    assert {r.lhs in known for r in rows} == {r.rhs in known for r in rows} == {True, False}
    n = len({w for r in rows for w in r})
    assert relations.count() == n * n


def test_ngrams_are_worked_out_once_a_text(spark):
    """20,000 words take time in proportion, also where the words come from a regular expression."""
    words = [f"w{i % 977}" for i in range(20_000)]
    rows = spark.createDataFrame([(" ".join(words),)], "text string").select(F.split("text", "[^a-z0-9]+").alias("w"), "text").select(text.word_ngrams(F.filter(F.split("text", "[^a-z0-9]+"), lambda w: w != ""), 3).alias("g"))
    start = time.time()
    assert rows.first().g == [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    assert time.time() - start < 20
    nulls = spark.createDataFrame([(["a", None, "b"],), ([None, None, "b", "c"],), ([],), (None,)], "w array<string>")
    assert [r.g for r in nulls.select(text.word_ngrams(F.col("w"), 3).alias("g")).collect()] == [["a b"], ["b", "b c"], [], None]
    assert nulls.select(similarity.ngram_jaccard(F.col("w"), F.col("w"), 1).alias("j")).first().j == 1.0


@pytest.mark.parametrize("measure, least", [("jaccard", 0.3), ("js", -0.5)])
def test_similar_in_chunks_and_for_asked_objects(spark, monkeypatch, measure, least):
    """Chunks of a few objects lose no pair, and those asked for meet all others."""
    monkeypatch.setattr(nearest, "CHUNK", 15)
    rows = [(i, f"w{(i * j * j + 3 * j) % 31}", 0.5 + (i + j) % 4) for i in range(40) for j in range(1, 9)]
    w = spark.createDataFrame(rows, "obj long, attr string, w double").groupBy("obj", "attr").agg(F.max("w").alias("w"))
    want = thesaurus.similarity(w, measure).filter(F.col("score") >= least)
    assert rows_of(nearest.similar(w, measure, least)) == rows_of(want)
    assert rows_of(nearest.similar(w, measure, least, F.col("obj") % 5 == 0)) == rows_of(want.filter("obj1 % 5 = 0"))
    assert 10 < want.count() < 1560


def test_pairs_that_meet_are_not_shuffled(spark):
    """400 objects share all they have: 79,800 pairs meet, and no exchange carries pairs."""
    w = spark.createDataFrame([(i, f"w{j}", 1.0) for i in range(400) for j in range(3)], "obj long, attr string, w double")
    found = nearest.similar(w, "jaccard", 0.5)
    assert found.count() == 400 * 399
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_paths_by_levels_are_the_first_by_names(spark):
    """Against whole paths on a random graph: equals by names, ends out of reach or too far, and no path carried in a level."""
    r = random.Random(5)
    edges = [("g", f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(50)] + [("g", f"z{i}", f"z{i + 1}") for i in range(9)] + [("h", "a", None)]
    df = spark.createDataFrame(edges, "graph string, src string, dst string")
    near = collections.defaultdict(set)
    for _, a, b in edges[:-1]:
        near[a].add(b)
        near[b].add(a)
    starts, want = ["n1", "n7", "z0"], {}
    for s in starts:
        paths, now = {s: (s,)}, {s: (s,)}
        for _ in range(6):
            new = {}
            for n, p in now.items():
                for m in near[n] - set(paths):
                    new[m] = min(new.get(m, (*p, m)), (*p, m))
            paths, now = paths | new, new
        want[s] = paths
    begun = spark.createDataFrame([("g", s) for s in starts], "graph string, start string")
    assert {(x.start, x.node): tuple(x.path) for x in graph.shortest_paths(df, begun, 6).collect()} == {(s, n): p for s in starts for n, p in want[s].items()}
    pairs = [(s, n) for s in starts for n in ["n3", "n12", "n30", "z5", "z9", s]]
    got = graph.shortest_path(df, spark.createDataFrame([("g", *p) for p in pairs], "graph string, a string, b string"), 6)
    assert {(x.a, x.b): tuple(x.path) for x in got.collect()} == {(s, n): want[s][n] for s, n in pairs if n in want[s]}
    order = {s: {n: i + 1 for i, n in enumerate(sorted(p, key=lambda n: (len(p[n]), p[n])))} for s, p in want.items()}  # noqa: B023
    assert {(x.start, x.node): x.place for x in graph.bfs_order(df, begun, 6).collect()} == {(s, n): i for s, p in order.items() for n, i in p.items()}
    assert all("path" not in level.columns for level in graph._levels(df, begun, 6))


def test_a_start_stops_at_its_targets(spark):
    chain = spark.createDataFrame([("g", f"z{i}", f"z{i + 1}") for i in range(9)], "graph string, src string, dst string")
    asked = spark.createDataFrame([("g", "z0", "z2")], "graph string, start string, node string")
    assert len(graph._levels(chain, asked.select("graph", "start"), 20, asked)) == 3


def test_equal_groups_of_verbs_are_made_once(spark):
    rows = [(v, 10 * (v % 3) + n) for v in range(30) for n in (v % 2, 2)] + [(99, 99), (98, None)]
    df = spark.createDataFrame(rows, "verb long, node long")
    members, groups = graph.verb_groups(df)
    assert groups.select("class").distinct().count() == 4
    by_verb, by_node = collections.defaultdict(set), collections.defaultdict(set)
    for v, n in rows:
        by_verb[v].add(n)
        by_node[n].add(v)
    want = {(v, m) for v, ns in by_verb.items() for n in ns - {None} for u in by_node[n] for m in by_verb[u]}
    assert {tuple(r) for r in graph.verb_based_split(df).collect()} == want
    assert {r["class"] for r in members.filter("verb < 30").collect()} == {0, 1, 2}


def test_pairs_of_verbs_are_no_rows(spark, monkeypatch):
    """600 verbs in three hundreds that share a node each, two of which a last verb joins: no table has more rows than the arguments."""
    rows = [(v, n) for v in range(600) for n in (v // 200 + 1000, v)] + [(600, 1000), (600, 1001)]
    df = spark.createDataFrame(rows, "verb long, node long")
    sizes, written = [], graph.written
    monkeypatch.setattr(graph, "written", lambda x: (y := written(x), sizes.append(y.count()))[0])
    for rounds in (1, 2):
        sizes.clear()
        groups = {v: {n for u, n in rows if u == v} for v in range(601)}
        by_node = collections.defaultdict(set)
        for v, n in rows:
            by_node[n].add(v)
        for _ in range(rounds):
            groups = {v: {m for u in set().union(*(by_node[n] for n in ns)) for m in (u // 200 + 1000, u) if u < 600} | ({1000, 1001} if 600 in set().union(*(by_node[n] for n in ns)) else set()) for v, ns in groups.items()}
        members, made = graph.verb_groups(df, rounds)
        by_class = collections.defaultdict(set)
        for r in made.collect():
            by_class[r["class"]].add(r.node)
        assert {r.verb: by_class[r["class"]] for r in members.collect()} == groups
        assert max(sizes[:-1]) <= len(rows)


def test_word_proximity_makes_no_pairs_of_places(spark):
    """A word that a context repeats 3,000 times, asked for 200 times: 1.8 billion pairs of places."""
    context = spark.createDataFrame([("q", i, "a" if i % 2 else "b") for i in range(6000)], "qid string, place int, token string")
    question = spark.createDataFrame([("q", i, "a", 7) for i in range(201)], "qid string, place int, token string, hole int")
    entities = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "absent"), ("r", "a")], "qid string, entity string")
    start = time.time()
    got = rows_of(qa.word_proximity(context, question, entities))
    assert time.time() - start < 60
    even = sum(i % 2 == 1 for i in range(201) if i != 7)
    assert got == [("q", "a", even + (200 - even) / 2), ("q", "absent", 0.0), ("q", "b", even / 2 + 200 - even), ("r", "a", 0.0)]


def test_only_constants_with_new_predicates_go_on(spark, monkeypatch):
    """A chain of ten: constants without a new predicate are in no later round."""
    rounds = []
    monkeypatch.setattr(softlogic, "written", lambda df: rounds.append(df.localCheckpoint()) or rounds[-1])
    sets = spark.createDataFrame([("p0", 1), ("p1", 1), ("p0", 2), ("p2", 3), (None, 4)], "pred string, const long")
    imp = spark.createDataFrame([(k, f"p{k - j}", f"p{k}") for k in range(2, 10) for j in (1, 2)], "rule long, lhs string, rhs string")
    got = {tuple(r) for r in softlogic.propagate_constants(sets, imp).collect()}
    assert got == {(f"p{k}", 1) for k in range(10)} | {("p0", 2), ("p2", 3), (None, 4)}
    assert all({r.const for r in x.collect()} <= {1} for x in rounds[1:])


def test_alignment_takes_questions_in_batches(spark):
    """No job for each entity: questions are solved where their links meet. Ties, gains by giving up, and equal names."""
    r = random.Random(3)
    rows = [(q, f"e{e}", f"t{x}", float(r.randint(0, 3))) for q in range(300) for e in range(4) for x in range(4) if r.random() < 0.8]
    links = spark.createDataFrame(rows, "qid long, entity string, target string, weight double")
    got = rules.search_alignment(links)
    assert "MapInArrow" in plan_of(got)
    for x in got.collect():
        w = {(e, t): v for q, e, t, v in rows if q == x.qid}
        best = max(sum(w.get((f"e{e}", f"t{t}"), 0.0) for e, t in enumerate(order)) for order in itertools.permutations(range(4)))
        chosen = [tuple(c.split("=")) for c in x.choice.split(",") if c]
        assert x.weight == best == sum(w[c] for c in chosen) and len({t for _, t in chosen}) == len({e for e, _ in chosen}) == len(chosen)


def test_augmented_tokens_are_not_multiplied(spark):
    tokens = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "id long, place int, token string")
    synonyms = spark.createDataFrame([("a", f"s{i}") for i in range(50)] + [("b", "x"), ("b", None)], "word string, synonym string")
    vocabulary = spark.createDataFrame([(f"s{i}",) for i in range(49)], "word string")
    got = rules.paraphrase_augment(tokens, synonyms, vocabulary)
    assert "max_by" not in plan_of(got)
    best = max((int(hashlib.md5(f"0:1:0:s{i}".encode()).hexdigest()[:8], 16), f"s{i}") for i in range(49))[1]
    assert {tuple(r) for r in got.collect()} == {(1, f"{best} b"), (2, "c")}


def test_class_weights_shuffle_no_rows(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 2).alias("y"))
    got = features.with_class_weights(rows, "y")
    assert {(r.y, r.weight) for r in got.collect()} == {(0, 2.0), (1, 2.0)} and got.count() == 1000
    plan = plan_of(features.with_class_weights(rows.join(rows.select("id"), "id"), "y"))
    assert "Exchange hashpartitioning(y" not in plan.split("BroadcastExchange")[0]


def test_window_features_shuffle_nothing(spark):
    rows = spark.createDataFrame([(1, ["a", "b", None], ["x", "y", "z"]), (2, [], []), (3, None, None)], "sentence long, words array<string>, tags array<string>")
    got = corpus.window_features(rows)
    assert "Exchange" not in plan_of(got)
    e = corpus.SENTINEL
    assert [tuple(r) for r in got.collect()] == [(1, 0, e, e, "a", "b", None, e, f"{e}:{e}"), (1, 1, e, "a", "b", None, e, "x", f"{e}:x"), (1, 2, "a", "b", None, e, e, "y", "x:y")]


def test_outer_grounding_looks_at_candidates_facts_only(spark):
    facts = spark.createDataFrame([(f"a{i}", f"b{j}", (i * j % 7) / 7) for i in range(9) for j in range(9)], "a1 string, a2 string, truth double").withColumn("part", F.lit(0))
    got = softlogic.ground_outer({"p": facts}, [softlogic.Atom("p", ("X", "Y"))])
    assert "LeftSemi" in plan_of(got) and got.count() == 4


def test_ranks_in_ranges(spark, monkeypatch):
    """Against windows over whole groups: ties, nulls, a null group, values of which one is frequent; no window is by group only."""
    monkeypatch.setattr(ordered, "ROWS", 20)
    r = random.Random(4)
    one = lambda: r.choice([0.0, None, r.gauss(0, 1), round(r.random(), 1)])
    rows = spark.createDataFrame([(g, one(), one()) for g, n in (("x", 300), (None, 90), ("y", 7)) for _ in range(n)], "g string, a double, b double")
    w = lambda c: W.partitionBy("g").orderBy(c)
    rank = lambda c: F.rank().over(w(c)) + (F.count("*").over(W.partitionBy("g", c)) - 1) / 2.0
    want = rows.select("g", rank("a").alias("a"), rank("b").alias("b")).groupBy("g").agg(F.corr("a", "b").alias("rho"))
    got = evaluate.spearman(rows, "g")
    assert {x.g: round(x.rho, 9) for x in got.collect()} == {x.g: round(x.rho, 9) for x in want.collect()}
    assert "rank(" not in plan_of(got)


def test_a_large_groups_rows_are_dealt(spark, monkeypatch):
    """One group of 2,000 rows: it meets its bounds under many keys."""
    monkeypatch.setattr(ordered, "ROWS", 100)
    rows = spark.range(2000).select(F.lit("x").alias("g"), F.col("id").cast("double").alias("a"), (F.col("id") * 7 % 1009).cast("double").alias("b"))
    met = ordered.with_ranges(rows, spark.createDataFrame([("x", 2000)], "g string, n long"), {"bounds": F.col("a")})
    assert met.count() == 2000 and met.filter("bounds is null").count() == 0
    assert "salt" in plan_of(met)
