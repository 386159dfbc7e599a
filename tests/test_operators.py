"""Hand-made cases: quirks in both modes, edges, and loops against plain Python."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import logic as L
from corpusloom.functions import similarity as M
from corpusloom.functions import text as X
from corpusloom.operators import corpus, evaluate, features, graph, keyed, ordered, qa, rules, softlogic, thesaurus, vectors
from corpusloom.sources import readers, writers


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_text_functions(spark):
    s = F.lit
    assert one(spark, X.tokenize_simple(s("I can't, John's."))).c0 == ["I", "ca", "n't", ",", "John", "'s", "."]
    assert one(spark, X.char_trigrams(s("ab"), compat=True)).c0 == ["ab", "ab"]
    assert one(spark, X.char_trigrams(s("ab"))).c0 == ["ab"]
    assert one(spark, X.char_trigrams(s("abcd"))).c0 == ["ab", "abc", "bcd"]
    assert one(spark, X.affixes(s("abc"), compat=True)).c0.suffixes == ["c", "cb", "cba"]
    assert tuple(one(spark, X.word_pos_index(s("well-known-a-7"))).c0) == ("well-known", "a", 7)
    assert tuple(one(spark, X.word_pos_index(s("nothing"))).c0) == (None, None, None)
    assert one(spark, X.contains_phrase(s("a big dog"), s("big dog"))).c0 and not one(spark, X.contains_phrase(s("a bigdog"), s("dog"))).c0
    assert one(spark, X.word_ngrams(F.array(s("a")), 2)).c0 == []
    assert one(spark, X.filter_stopwords(F.array(s("the"), s("x"), s("x")))).c0 == ["x", "x"]
    assert tuple(one(spark, X.polarity_signature(s("+/-"))).c0) == ("+", "-")


def test_similarity_edges(spark):
    s = F.lit
    assert one(spark, M.levenshtein_sim(s(""), s(""))).c0 == 1.0
    assert one(spark, M.substring_sim(s("AB"), s("xaby"))).c0 == 0.5
    assert one(spark, M.cosine(F.array(s(0.0)), F.array(s(1.0)))).c0 == 0.0
    assert one(spark, M.array_jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))).c0 == 0.0
    assert one(spark, M.positive_cosine(F.array(s(1.0), s(-1.0)), F.array(s(1.0), s(1.0)))).c0 == pytest.approx(0.5)
    assert one(spark, L.log_add(s(None).cast("double"), s(1.0))).c0 == 1.0
    assert one(spark, L.luk_and(s(0.7), s(0.6))).c0 == pytest.approx(0.3)


def test_thesaurus_against_outer_join(spark):
    r = random.Random(1)
    rows = [(f"o{o}", f"a{a}", "t", r.randint(1, 9)) for o in range(6) for a in range(8) if r.random() < 0.6]
    table = spark.createDataFrame(rows, "obj string, attr string, type string, f long")
    w = table.withColumn("w", F.col("f").cast("double"))
    sums = thesaurus.pair_sums(w)
    got = {(x.obj1, x.obj2): x for x in sums.select("obj1", "obj2", *(e.alias(n) for n, e in thesaurus.measures().items())).collect()}
    vec = defaultdict(dict)
    for o, a, _, f in rows:
        vec[o][a] = f
    for a, b in itertools.permutations(vec, 2):
        x, y = vec[a], vec[b]
        if not set(x) & set(y):
            assert (a, b) not in got
            continue
        keys = set(x) | set(y)
        p = [x.get(k, 0) for k in keys]
        q = [y.get(k, 0) for k in keys]
        g = got[a, b]
        assert g.jaccard == pytest.approx(sum(map(min, p, q)) / sum(map(max, p, q)))
        assert g.manhattan == pytest.approx(-sum(abs(i - j) for i, j in zip(p, q)))
        assert g.euclidean == pytest.approx(-math.dist(p, q))
        assert got[b, a].cosine == pytest.approx(g.cosine)
        p, q = [i / sum(p) for i in p], [j / sum(q) for j in q]
        h = lambda v: sum(-i * math.log2(i) for i in v if i)
        assert g.js == pytest.approx(-(h([(i + j) / 2 for i, j in zip(p, q)]) - (h(p) + h(q)) / 2))
        assert g.skew == pytest.approx(-sum(j * math.log2(j / (0.99 * i + 0.01 * j)) for i, j in zip(p, q) if j))


def test_ranks_share_places(spark):
    scores = spark.createDataFrame([("a", "b", 3.0), ("a", "c", 2.0), ("a", "d", 2.0), ("a", "e", 1.0)], "obj1 string, obj2 string, score double")
    asked = spark.createDataFrame([("a", x) for x in "bcdez"], "obj1 string, obj2 string")
    assert {r.obj2: r["rank"] for r in thesaurus.neighbour_rank(scores, asked).collect()} == {"b": 1, "c": 2, "d": 2, "e": 4, "z": 0}


def test_pseudo_object_rejects_unknown_attributes(spark):
    table = spark.createDataFrame([("a", "x", "t", 1.0)], "obj string, attr string, type string, f double")
    bad = spark.createDataFrame([("n", "y", "t", 1.0)], table.schema)
    with pytest.raises(Exception, match="unknown attribute"):
        thesaurus.pseudo_object(table, bad).collect()


def test_closure_depths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(6, 0)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "src long")
    reach = lambda d, **k: {(r.dst, r.depth) for r in graph.closure(start, edges, d, **k).collect()}
    assert reach(0) == set()
    assert reach(0, compat=True) == {(1, 1)}
    assert reach(2) == {(1, 1), (2, 2)}
    assert reach(None) == {(i, i) for i in range(1, 7)} | {(0, 7)}


def test_components_and_paths(spark):
    r = random.Random(2)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    got = {x.node: x.component for x in graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent}
    edges = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c"), ("g", "a", "d"), ("g", "d", "c"), ("g", "c", "e")], "graph string, src string, dst string")
    pairs = spark.createDataFrame([("g", "a", "e"), ("g", "e", "a")], "graph string, a string, b string")
    assert {(x.a, tuple(x.path)) for x in graph.shortest_path(edges, pairs).collect()} == {("a", ("a", "b", "c", "e")), ("e", ("e", "c", "b", "a"))}
    order = graph.bfs_order(edges, spark.createDataFrame([("g", "a")], "graph string, start string"))
    assert [x.node for x in order.orderBy("place").collect()] == ["a", "b", "d", "c", "e"]


def test_snowball_parts_are_disjoint(spark):
    edges = spark.createDataFrame([(i, (i * 7 + 1) % 50) for i in range(50)], "src long, dst long")
    nodes = spark.range(50).withColumnRenamed("id", "node")
    rows = graph.split_snowball(nodes, edges, 2, 10, 0.9).collect()
    assert len(rows) == len({r.node for r in rows}) and {r.part for r in rows} == {0, 1}
    grown = graph.split_random(nodes, edges, 3).collect()
    assert len(grown) == len({r.node for r in grown})


def test_soft_logic_loops(spark):
    sets = spark.createDataFrame([("p", 1), ("p", 2), ("q", 2)], "pred string, const long")
    imp = spark.createDataFrame([(1, "p", "r"), (1, "q", "r"), (2, "r", "s")], "rule long, lhs string, rhs string")
    assert {(x.pred, x.const) for x in softlogic.propagate_constants(sets, imp).collect()} == {("p", 1), ("p", 2), ("q", 2), ("r", 2), ("s", 2)}
    # x wants to be at least 0.8 with weight 1 and at most 0.2 with weight 3: it sits at 0.2.
    terms = spark.createDataFrame([("hi", "x", -1.0), ("lo", "x", 1.0)], "rule string, atom string, coefficient double")
    costs = spark.createDataFrame([("hi", 1.0, 0.8), ("lo", 3.0, -0.2)], "rule string, weight double, constant double")
    assert softlogic.map_inference(terms, costs, rounds=60).first().truth == pytest.approx(0.2, abs=0.02)
    learnt = softlogic.learn_weights({"a": 1.0}, lambda w: {"a": 3.0}, {"a": 0.0}, steps=2, rate=0.5)
    assert learnt == {"a": 1.5}


def test_set_comparison_of_empty_sets(spark):
    a = spark.createDataFrame([(1, "x", 1.0)], "id long, element string, degree double")
    b = spark.createDataFrame([(2, "x", 1.0)], a.schema)
    same = spark.createDataFrame([("x", "x", 1.0)], "e1 string, e2 string, truth double")
    assert {r.score for r in softlogic.set_comparison(a, b, same, "equality").collect()} == {0.0}
    assert {r.score for r in softlogic.set_comparison(a, b, same, "overlap").collect()} == {1.0}


def test_order_atoms():
    body = [softlogic.Atom("p", ("A", "B")), softlogic.Atom("q", (softlogic.Const(1), "B")), softlogic.Atom("r", ("B", "C"))]
    assert [a.predicate for a in softlogic.order_atoms(body)] == ["q", "p", "r"]


def test_atoms_must_share_a_variable(spark):
    facts = spark.createDataFrame([(1, 1.0)], "a1 long, truth double")
    with pytest.raises(ValueError, match="shares no variable"):
        softlogic.ground_inner({"p": facts, "q": facts}, [softlogic.Atom("p", ("A",)), softlogic.Atom("q", ("B",))])


def test_composition(spark):
    vec = spark.createDataFrame([("a", "x", 2.0), ("b", "x", 3.0), ("b", "y", 1.0)], "word string, dim string, w double")
    text = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "id long, word string")
    table = lambda df: {r.dim: r.w for r in df.collect()}
    assert table(vectors.compose_add(text, vec)) == {"x": 5.0, "y": 1.0}
    assert table(vectors.compose_add(text, vec, distinct=False)) == {"x": 7.0, "y": 1.0}
    assert table(vectors.compose_mul(text, vec)) == {"x": 6.0}
    none = text.filter("false")
    ids = spark.createDataFrame([(1,)], "id long")
    assert vectors.pair_cosine(vectors.compose_add(none, vec), vectors.compose_add(none, vec), ids, 1.0).first().score == 1.0
    assert vectors.pair_cosine(vectors.compose_add(text, vec), vectors.compose_add(none, vec), ids, 1.0).first().score == 0.0
    diff = vectors.difference_pieces(spark.createDataFrame([(1, ["a", "b", "c"], ["a", "x", "c", "d"])], "id long, left array<string>, right array<string>"))
    assert [(r.left, r.right) for r in diff.collect()] == [(["b"], ["x"]), ([], ["d"])]


def test_alignments(spark):
    cand = spark.createDataFrame([(1, "a", "x", 0.9), (1, "a", "y", 0.8), (1, "b", "x", 0.85), (1, "b", "y", 0.005)], "rule_id long, lhs string, rhs string, score double")
    assert {(r.lhs, r.rhs) for r in rules.greedy_align(cand).collect()} == {("a", "x")}
    best = rules.search_alignment(cand.select(F.col("rule_id").alias("qid"), F.col("lhs").alias("entity"), F.col("rhs").alias("target"), F.col("score").alias("weight"))).first()
    assert best.choice == "a=y,b=x" and best.weight == pytest.approx(1.65)


def test_search_alignment_is_exact(spark):
    r = random.Random(5)
    rows = [(q, f"e{e}", f"t{x}", float(r.randint(-2, 9))) for q in range(40) for e in range(r.randint(1, 4)) for x in range(5) if r.random() < 0.7]
    # Many entities that want the same few targets: a search that keeps only some states would lose here.
    rows += [(99, f"e{e:02}", f"t{x}", 1.0 + (x == e % 7)) for e in range(60) for x in range(7)]
    got = {x.qid: x for x in rules.search_alignment(spark.createDataFrame(rows, "qid long, entity string, target string, weight double")).collect()}
    assert got.pop(99).weight == 14.0
    for q, x in got.items():
        weight = {(e, t): w for p, e, t, w in rows if p == q}
        names, targets = sorted({e for e, _ in weight}), sorted({t for _, t in weight})
        best = max(sum(max(0.0, weight.get((e, t), 0.0)) for e, t in zip(names, order, strict=False)) for order in itertools.permutations([*targets, *[None] * len(names)], len(names)))
        chosen = [tuple(c.split("=")) for c in x.choice.split(",") if c]
        assert len({t for _, t in chosen}) == len({e for e, _ in chosen}) == len(chosen)
        assert x.weight == best == sum(weight[c] for c in chosen)


def test_search_alignment_of_nulls_and_nothing(spark):
    schema = "qid long, entity string, target string, weight double"
    assert rules.search_alignment(spark.createDataFrame([], schema)).count() == 0
    got = rules.search_alignment(spark.createDataFrame([(1, "a", "x", None), (2, None, "x", 1.0), (3, "a", "x", 0.5), (3, "a", "x", 0.7)], schema))
    assert {(x.qid, x.weight, x.choice) for x in got.collect()} == {(1, 0.0, ""), (2, 0.0, ""), (3, 0.7, "a=x")}


def test_close_world_keeps_to_a_problem(spark):
    domain = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "problem long, entity string")
    facts = spark.createDataFrame([(1, "a", "b", 0.9)], "problem long, a1 string, a2 string, truth double")
    got = softlogic.close_world(facts, domain, 2, spark.createDataFrame([("b",)], "a1 string"))
    assert sorted((x.problem, x.a1, x.a2) for x in got.collect()) == [(1, "a", "a"), (2, "a", "a")]


def test_blocked_pairs_are_those_that_share_a_blocked_attribute(spark):
    r = random.Random(2)
    rows = [(f"o{o}", f"a{a}", float(r.randint(1, 9))) for o in range(8) for a in range(6) if r.random() < 0.6]
    w = spark.createDataFrame(rows, "obj string, attr string, w double")
    block = w.filter("attr in ('a0', 'a1')").filter("obj <> 'o3'")
    keys = {(o, a) for o, a, _ in rows if a in ("a0", "a1") and o != "o3"}
    want = {(o, p) for o, a in keys for p, b in keys if a == b and o != p}
    for left in (None, spark.createDataFrame([("o1",), ("o2",)], "obj string")):
        every = {(x.obj1, x.obj2): x for x in thesaurus.pair_sums(w, left).collect()}
        got = {(x.obj1, x.obj2): x for x in thesaurus.pair_sums(w, left, block).collect()}
        assert got.keys() == {x for x in want if x in every}
        assert all(x.dot == pytest.approx(every[k].dot) and x.shared == every[k].shared for k, x in got.items())


def test_ngrams_and_idf_of_nulls_and_short_arrays(spark):
    docs = spark.createDataFrame([(["a", "b", "a", "b"],), (["a"],), ([],), (None,)], "w array<string>")
    assert {(x.gram, x.n) for x in corpus.ngram_counts(docs, "w", 2).collect()} == {("a b", 2), ("b a", 1)}
    assert {(x.gram, x.n) for x in corpus.ngram_counts(docs, "w", 1).collect()} == {("a", 3), ("b", 2)}
    assert {(x.token, x.df, round(x.idf, 6)) for x in corpus.idf(docs, "w").collect()} == {("a", 2, 0.0), ("b", 1, 0.693147)}


def test_named_rules_and_pairs_of_lines(spark, tmp_path):
    (tmp_path / "rules.tsv").write_text("lhs\trhs\tw\na\tb\t0.5\nc\td\tnone\n")
    got = readers.read_named_rules(spark, str(tmp_path / "rules.tsv"), ["w"])
    assert {tuple(x) for x in got.collect()} == {("a", "b", 0.5), ("c", "d", None)} and got.columns == ["lhs", "rhs", "w"]
    (tmp_path / "pairs.tsv").write_text('1\tA "man" sits.\tA man\n\nx\tb\tc\n')
    assert {tuple(x) for x in readers.read_pairs(spark, str(tmp_path / "pairs.tsv")).collect()} == {(1, 'A "man" sits.', "A man"), (None, "b", "c")}


def test_evaluation_quirks(spark):
    base = spark.createDataFrame([(1, 1.0), (2, 0.0)], "k long, value double")
    got = spark.createDataFrame([(2, 1.0)], "k long, value double")
    assert {r.kind for r in evaluate.list_errors(got, base, "k").collect()} == {"false positive", "false negative"}
    assert {r.kind for r in evaluate.list_errors(got, base, "k", compat=True).collect()} == {"false positive"}
    same = spark.createDataFrame([(i, 1.0, 1.0) for i in range(5)], "sent long, a double, b double")
    assert ordered.randomisation_test(same, 50).first().p == 1.0
    tags = spark.createDataFrame([(1, 0, "B-X", "B-Y"), (1, 1, "I-X", "I-Y"), (1, 2, "B-X", "B-X")], "sent long, pos long, gold string, pred string")
    total = evaluate.chunk_eval(tags).filter("type = ''").first()
    assert (total.gold, total.guessed, total.correct) == (2, 2, 1)


def test_qa_ties(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, False), (1, "b", 1.0, True)], "qid long, entity string, score double, right boolean")
    assert qa.pick_answer(rows).first().entity == "a"
    assert qa.pick_answer(rows, compat=True).first().entity == "b"


def test_keyed(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate("abxcd")], "k long, i long, v string")
    runs = keyed.split_runs(rows, "k", "i", F.col("v") == "x").collect()
    assert [(r.v, r.run) for r in sorted(runs, key=lambda r: r.i)] == [("a", 0), ("b", 0), ("c", 1), ("d", 1)]
    with pytest.raises(Exception, match="no partner"):
        keyed.zip_safe(rows.select("i"), rows.select("i", "v").filter("i < 3"), "i").collect()
    assert [r.rows for r in keyed.partition_n(rows, F.lit(1), 3).orderBy("group").collect()] == [0, 5, 0]


def test_counts_and_features(spark):
    assert corpus.distribute(spark.range(10), "id", 3).groupBy("bucket").count().count() == 3
    out = one(spark, features.bin_feature(F.lit(float("nan")), 1.0), features.bin_feature(F.lit(1.0), 1.0), features.bin_feature(F.lit(0.05), 1.0))
    assert sum(out.c0) == 0 and out.c1[10] == 1 and out.c2[0] == 1
    with pytest.raises(Exception, match="row counts differ"):
        a = spark.createDataFrame([(1, [1.0])], "id long, features array<double>")
        features.concat_feature_sets([a, a.withColumn("id", F.lit(2).cast("long"))]).collect()


def test_sources_and_sinks(spark, tmp_path):
    assert readers.detect_vector_format("w\t1\t2") == "dense"
    assert readers.detect_vector_format("w\td\t2") == "sparse"
    assert readers.detect_vector_format("w\td\t2\te\t3") == "interleaved"
    (tmp_path / "v").write_text("w\td\t2\te\t3\n")
    assert {(r.dim, r.w) for r in readers.read_vectors(spark, str(tmp_path / "v")).collect()} == {("d", 2.0), ("e", 3.0)}
    (tmp_path / "p").write_text("1\tA man.\tA dog.\n")
    assert readers.read_pairs(spark, str(tmp_path / "p")).first().hyp == "A dog."
    (tmp_path / "d").write_text('<doc id="1" title="T">\nbody\n</doc>\n<doc id="2" title="U">\nmore\n</doc>\n')
    assert [r.text for r in readers.read_doc_dump(spark, str(tmp_path / "d")).orderBy("id").collect()] == ["T.\nbody", "U.\nmore"]
    (tmp_path / "r").write_text("3 dog eats\n")
    assert readers.read_relation_counts(spark, str(tmp_path / "r")).first().f == 3
    (tmp_path / "n").write_text("lhsText\tw\na\t0.5\nb\tx\n")
    assert [r.w for r in readers.read_named_rules(spark, str(tmp_path / "n"), ["w"]).orderBy("lhsText").collect()] == [0.5, None]
    (tmp_path / "u").write_text("1\ta\tb\t0.5\n")
    assert readers.read_rules(spark, str(tmp_path / "u")).first().score == 0.5
    rows = spark.createDataFrame([(1.0, "yes"), (2.0, "no")], "x double, y string")
    writers.write_arff(rows, str(tmp_path / "arff"), "r", ["x"], "y", ["yes", "no"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "arff")).collect()]
    assert lines[:4] == ["@RELATION r", "@ATTRIBUTE x NUMERIC", "@ATTRIBUTE y {yes,no}", "@DATA"] and len(lines) == 6
    writers.write_hash_partitioned(spark.createDataFrame([("a",), ("b",)], "title string"), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2
    writers.append_report(rows, str(tmp_path / "e"), "x")
    writers.append_report(rows, str(tmp_path / "e"), "y")
    assert spark.read.parquet(str(tmp_path / "e")).count() == 4
    gold = spark.createDataFrame([(1, 1.0)], "pair_id long, gold double")
    writers.write_scores(gold.withColumnRenamed("gold", "score"), gold, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).columns == ["pair_id", "score", "gold"]
    writers.write_submission(*(spark.createDataFrame([(1, "x")], "instance long, prediction string") for _ in range(2)), str(tmp_path / "b"))
    assert spark.read.csv(str(tmp_path / "b"), sep="\t", header=True).columns == ["instance", "entailment", "relatedness"]
    with pytest.raises(Exception, match="unknown label"):
        rows.select(readers.map_labels(F.col("y"), {"yes": "ENTAILMENT"})).collect()


def test_rare_words_are_counted_by_task_first(spark, monkeypatch):
    """Words are shuffled once a task, not at each place; null ids and repeated rows count as any other."""
    rows = [(None if k == 7 else k // 2, [f"w{k * j % 97}" for j in range(k % 40)] + ["the"] * 30 + ([None] if k % 5 == 0 else [])) for k in range(120)] + [(1, None), (2, [])]
    table = spark.createDataFrame(rows, "id long, words array<string>").repartition(3)
    n = Counter(w for _, words in rows for w in words or () if w)
    want = Counter((i, w) for i, words in rows for w in words or () if w and n[w] < 40)
    for held in (corpus.HELD_WORDS, 3):
        monkeypatch.setattr(corpus, "HELD_WORDS", held)
        found = corpus.rare_word_switch(table, 40)
        assert want and Counter((x.id, x.word) for x in found.collect()) == want
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
