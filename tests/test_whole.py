"""Queries over whole tables and texts that have no SQL, against brute force."""

from __future__ import annotations

import collections
import math
import re

import pytest

from corpusloom import plans


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    return lambda name: plans.queries()[name](spark, sf_dir).collect()


@pytest.fixture(scope="module")
def sales(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("year(l_shipdate) as y", "l_orderkey as o", "l_suppkey as s", "l_partkey as p").collect()


@pytest.fixture(scope="module")
def pairs(spark, sf_dir):
    """conv_id, turn, text_a, text_b of every user turn with the assistant turn after it."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    after = {(x.conv_id, x.turn): x.text for x in rows if x.role == "assistant"}
    assert len(after) == sum(x.role == "assistant" for x in rows)
    return [(x.conv_id, x.turn, x.text, after[x.conv_id, x.turn + 1]) for x in rows if x.role == "user" and (x.conv_id, x.turn + 1) in after]


def words(text):
    return [w for w in re.split("[^a-z]+", text.lower()) if w]


# Graphs and vectors


def reach(edges, start):
    steps, now = {start: 0}, [start]
    while now:
        new = {b for a in now for b in edges[a] if b not in steps}
        steps |= {b: steps[now[0]] + 1 for b in new}
        now = list(new)
    return steps


def test_paths_over_all_sales(run, sales):
    graphs = collections.defaultdict(lambda: collections.defaultdict(set))
    for x in sales:
        graphs[x.y][f"o{x.o}"].add(f"s{x.s}")
        graphs[x.y][f"s{x.s}"].add(f"o{x.o}")
    ends = {y: (min(n for n in g if n[0] == "s"), max(n for n in g if n[0] == "s")) for y, g in graphs.items()}
    steps = {y: reach(g, ends[y][0]) for y, g in graphs.items()}
    assert {(x.graph, x.a, x.b, x.length) for x in run("G05_shortest_path")} == {(y, a, b, steps[y][b]) for y, (a, b) in ends.items() if steps[y].get(b, 99) <= 20}
    assert {(x.graph, x.start, x.reached) for x in run("G06_bfs_order")} == {(y, ends[y][0], sum(n <= 20 for n in steps[y].values())) for y in graphs}


def test_components_and_groups_over_all_sales(run, sales):
    edges, by_verb, by_node = (collections.defaultdict(set) for _ in range(3))
    for x in sales:
        edges[f"o{x.o}"].add(f"p{x.p}")
        edges[f"p{x.p}"].add(f"o{x.o}")
        by_verb[x.s].add(x.p)
        by_node[x.p].add(x.s)
    want = {}
    for n in sorted(edges):
        if n not in want:
            want |= dict.fromkeys(reach(edges, n), n)
    assert {x.node: x.component for x in run("G07_connected_components")} == want
    assert {x.verb: x.n for x in run("G11_verb_based_split")} == {v: len({p for n in ps for u in by_node[n] for p in by_verb[u]}) for v, ps in by_verb.items()}


def test_products_over_all_words(spark, sf_dir, run, pairs):
    known = {w for x in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect() for w in words(x.text)}
    want = {}
    for conv, turn, text, _ in pairs:
        vectors = [collections.Counter(w) for w in set(words(text)) & known]
        for c in set.intersection(*map(set, vectors)) if vectors else ():
            want[conv * 100 + turn, c] = sum(math.log(v[c]) for v in vectors)
    got = {(x.id, x.dim): x.w for x in run("V02_compose_mul")}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-5 for k in want)


# Questions


def test_answers_from_whole_texts(run, pairs):
    scores, features, bow, embed = {}, {}, {}, collections.Counter()
    asked = [(f"{c}-{t}", words(a), words(b)) for c, t, a, b in pairs]
    counts = collections.Counter(w for _, _, a in asked for w in a)
    for qid, q, a in asked:
        places = collections.defaultdict(list)
        for i, w in enumerate(a):
            places[w].append(i)
        entities, names = set(a), {w for w in a if len(w) > 5}
        for e in entities:
            scores[qid, e] = sum(max(1 / (1 + abs(x - y - 1 + i)) for x in places[e] for y in places[w]) for i, w in enumerate(q) if i != 1 and w in places)
            beside = lambda off: int(any(0 <= x + off < len(a) and 1 + off < len(q) and a[x + off] == q[1 + off] for x in places[e]))  # noqa: B023, E731
            features[qid, e] = (True, e in q[:1] + q[2:], len(places[e]), places[e][0], beside(-1), beside(1))
        best = []
        for k in range(0, len(a), 8):
            inside = a[k : k + 8]
            shared, held = set(inside) & set(q), [w for w in inside if w in entities]
            if shared and held:
                best.append((-round(sum(counts.total() / counts[w] for w in shared), 9), k, held[0]))
        if best:
            bow[qid] = min(best)[2]
        at = [i for i, w in enumerate(a) if w in names]
        for i, w in enumerate(a):
            if w not in names:
                sim = sum(1.0 if w == o else 0.5 for o in set(q) if o[:2] == w[:2])
                for spot in ([max(x for x in at if x < i)] if at and at[0] < i else []) + ([min(x for x in at if x > i)] if at and at[-1] > i else []):
                    if sim:
                        embed[qid, a[spot]] += sim / (1 + abs(spot - i))
    close = lambda got, want: set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert len(asked) > 0 and max(len(a) for _, _, a in asked) > 40
    assert close({(x.qid, x.entity): x.score for x in run("Q01_word_proximity")}, scores)
    assert close({(x.qid, x.entity): x.score for x in run("Q02_embed_proximity")}, embed)
    assert {x.qid: x.entity for x in run("Q03_bow_overlap")} == bow
    assert {(x.qid, x.entity): (x["exists"], x.in_question, x.frequency, x["first"], x.left, x.right) for x in run("Q04_candidate_features")} == features
    named = collections.defaultdict(list)
    for qid, e in scores:
        named[qid].append(e)
    order = {qid: sorted(es, key=lambda e: (-round(scores[qid, e], 6), e)) for qid, es in named.items()}
    right = {qid: min(es, key=lambda e: (len(e), e)) for qid, es in named.items()}
    compat = {qid: min(es, key=lambda e: (-round(scores[qid, e], 6), e != right[qid], e)) for qid, es in named.items()}
    assert {x.qid: x.entity for x in run("Q05_pick_answer")} == {k: v[0] for k, v in order.items()}
    assert {x.qid: x.entity for x in run("Q05_pick_answer_compat")} == compat
    ranks = collections.Counter(order[k].index(right[k]) + 1 for k in order)
    assert {x["rank"]: x.n for x in run("Q06_answer_rank")} == ranks
    assert abs(run("Q07_qa_accuracy")[0].accuracy - ranks[1] / len(order)) < 1e-5


# Texts


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similarities_of_whole_texts(spark, tmp_path):
    long = "the answer is in the last words of a long text, "
    given = [(long + "here", long + "there"), ("größer als é🙂", "grosser als e🙂, ja"), (long, "so: " + long + "!"), ("", ""), ("abc", ""), (long + "xyz", long[::-1]), ("日本語のテキスト" * 5, "日本語のテキスト" * 4)]
    rows = [(k, t, role, x[t]) for k, x in enumerate(given) for t, role in enumerate(("user", "assistant"))]
    rows += [(90 + k, t + 2, role, x[t]) for k, x in enumerate(given) for t, role in enumerate(("user", "assistant"))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name, column: {(x.conv_id, x.turn): x[column] for x in plans.queries()[name](spark, str(tmp_path)).collect()}
    n, v, sub, chars = {}, {}, {}, {}
    for key, (a, b) in [((k, 0), x) for k, x in enumerate(given)] + [((90 + k, 2), x) for k, x in enumerate(given)]:
        n[key] = distance(a, b)
        sim = 1 - n[key] / max(len(a), len(b)) if a or b else 1
        v[key] = round(sim if sim > 0.2 else 0, 6)
        short, other = sorted((a.lower(), b.lower()), key=len)
        sub[key] = round(len(short) / len(other) if other and short in other else float(not other), 6)
        jac = min(0.99, len(set(a) & set(b)) / len(set(a) | set(b))) if a or b else 0
        chars[key] = round(jac if min(len(a), len(b)) >= 5 and jac > 0.5 else 0, 6)
    assert run("M01_edit_distance", "n") == n
    assert run("M02_levenshtein_sim", "v") == v
    assert run("M03_substring_sim", "v") == sub
    assert run("M05_charset_sim", "v") == chars


# Rules


def test_rules_over_all_tokens_and_whole_phrases(spark, tmp_path):
    phrase = "we go to the old mill by the river at noon"
    given = [("we go", f"and {phrase} said he"), ("the cat sat", "we go to the old mill by"), (f"some {phrase}", f"x {phrase}"), ("to be", "a dog"), ("", "mill")]
    rows = [(k, t, role, x[t]) for k, x in enumerate(given) for t, role in enumerate(("user", "assistant"))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    items = [(0, phrase), (1, "A dog!"), (2, "the"), (3, "mill by"), (4, "go to the"), (5, "to the old mill by the"), (6, "..."), (7, "we go")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, [1.0, float(i)]) for i in range(8)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda name: plans.queries()[name](spark, str(tmp_path)).collect()
    hits = lambda column, parity: {(100 * k, i // 2) for k, x in enumerate(given) for i, t in items if i % 2 == parity and set(words(x[column])) & set(words(t))}
    inside = lambda text, t: bool(words(t)) and any(words(text)[i : i + len(words(t))] == words(t) for i in range(len(words(text))))
    assert {tuple(x) for x in run("R01_match_any_token")} == hits(0, 0)
    assert {(x.pair_id, x.rule_id) for x in run("R02_match_both_sides")} == hits(0, 0) & hits(1, 1)
    assert {(x.pair_id, x.rule_id) for x in run("R03_match_exact_phrase")} == {(100 * k, i) for k, x in enumerate(given) for i, t in items if inside(x[1], t)}

    def found(text, item):
        """A run of two of the item's words stands in the text, not right after "some"."""
        w, v = words(text), words(item)
        return any(w[p : p + 2] == v[q : q + 2] and (p == 0 or w[p - 1] != "some") for q in range(len(v) - 1) for p in range(len(w) - 1))

    want = {(100 * k, i, j) for k, x in enumerate(given) for i, t in items for j, u in items if i != j and found(x[0], t) and found(x[1], u)}
    got = {(x.pair_id, x.lhs_id, x.rhs_id) for x in run("R06_phrase_pair_scores")}
    assert got == want and (200, 5, 0) in got and (0, 7, 0) in got and not any(x[:2] == (200, 7) for x in got)
