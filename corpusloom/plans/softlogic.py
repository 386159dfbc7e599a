"""Soft-logic queries: orders, suppliers and nations as predicates, discounts as truths."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.logic import log_odds
from corpusloom.operators import softlogic as P
from corpusloom.operators.softlogic import Atom, Const
from corpusloom.plans.inputs import r6, table


def rnd(df):
    return df.select(*(r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def preds(s, d):
    """sells(supplier, part), lives(supplier, nation), wants(nation, part)."""
    li, su = table(s, d, "lineitem"), table(s, d, "supplier")
    sells = li.groupBy("l_suppkey", "l_partkey").agg(F.least(F.lit(1.0), F.max("l_discount") * 8).alias("t"))
    lives = su.select("s_suppkey", "s_nationkey", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s_acctbal") / 10000)).alias("t"))
    want = li.join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    wants = want.groupBy("c_nationkey", "l_partkey").agg(F.least(F.lit(1.0), F.sum("l_tax") * 4).alias("t"))
    t = lambda df, a, b: P.predicate_table(df, [a, b], "t")
    return {"sells": t(sells, "l_suppkey", "l_partkey"), "lives": t(lives, "s_suppkey", "s_nationkey"), "wants": t(wants, "c_nationkey", "l_partkey")}


_P = """sells AS (SELECT l_suppkey AS a1, l_partkey AS a2, least(1.0, max(l_discount) * 8) AS truth FROM lineitem GROUP BY 1, 2),
lives AS (SELECT s_suppkey AS a1, s_nationkey AS a2, least(1.0, greatest(0.0, s_acctbal / 10000)) AS truth FROM supplier),
wants AS (SELECT c_nationkey AS a1, l_partkey AS a2, least(1.0, sum(l_tax) * 4) AS truth FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""

BODY = [Atom("sells", ("S", "X")), Atom("lives", ("S", "N")), Atom("wants", ("N", "X"))]
_G = f"WITH {_P}, g AS (SELECT s.a1 AS S, s.a2 AS X, l.a2 AS N, s.truth AS truth1, l.truth AS truth2, w.truth AS truth3 FROM sells s JOIN lives l ON l.a1 = s.a1 JOIN wants w ON w.a1 = l.a2 AND w.a2 = s.a2)"
_G6 = "round(truth1, 6) AS truth1, round(truth2, 6) AS truth2, round(truth3, 6) AS truth3"


def grounded(s, d):
    return P.ground_inner(preds(s, d), BODY)


def parts(s, d):
    li = table(s, d, "lineitem")
    return P.predicate_table(li, ["l_orderkey", "l_partkey"], "l_discount").withColumn("part", (F.col("a1") % 4).cast("int"))


def soft_sets(s, d):
    """Two soft sets for each nation: sold and wanted part kinds."""
    pa = table(s, d, "part").select(F.col("p_partkey").alias("a2"), F.col("p_type"))
    p = preds(s, d)
    sold = p["sells"].join(p["lives"].select("a1", F.col("a2").alias("id")), "a1").join(pa, "a2")
    want = p["wants"].withColumnRenamed("a1", "id").join(pa, "a2")
    return P.set_term(sold, ["id"], "p_type", F.col("truth") / 100), P.set_term(want, ["id"], "p_type", F.col("truth") / 10)


def similar(s, d):
    t = table(s, d, "part").select("p_type").distinct()
    return t.select(F.col("p_type").alias("e1")).crossJoin(t.select(F.col("p_type").alias("e2"))).withColumn("truth", F.when(F.col("e1") == F.col("e2"), 1.0).when(F.length("e1") == F.length("e2"), 0.5).otherwise(0.1))  # kinds of parts are few


_SETS = f"""WITH {_P}, sa AS (SELECT l.a2 AS id, p_type AS e, sum(s.truth / 100) AS d FROM sells s JOIN lives l ON l.a1 = s.a1 JOIN part ON p_partkey = s.a2 GROUP BY 1, 2), sb AS (SELECT w.a1 AS id, p_type AS e, sum(truth / 10) AS d FROM wants w JOIN part ON p_partkey = w.a2 GROUP BY 1, 2),
ty AS (SELECT DISTINCT p_type AS t FROM part), si AS (SELECT a.t AS e1, b.t AS e2, CASE WHEN a.t = b.t THEN 1.0 WHEN length(a.t) = length(b.t) THEN 0.5 ELSE 0.1 END::DOUBLE AS truth FROM ty a, ty b),
sm AS (SELECT a.id, sum(least(a.d, b.d) * truth) AS m, sum(a.d * b.d * truth) AS x, sum(truth) AS t, count(*) AS n FROM sa a JOIN si ON e1 = a.e JOIN sb b ON b.id = a.id AND b.e = e2 GROUP BY 1),
z AS (SELECT id, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2, coalesce(m, 0) AS m, coalesce(x, 0) AS x, coalesce(t, 0) AS t, coalesce(n, 0) AS n FROM (SELECT id FROM sa UNION SELECT id FROM sb) LEFT JOIN (SELECT id, sum(d) AS s1 FROM sa GROUP BY 1) USING (id) LEFT JOIN (SELECT id, sum(d) AS s2 FROM sb GROUP BY 1) USING (id) LEFT JOIN sm USING (id))"""


def _set(kind, sql, **options):
    return (lambda s, d: rnd(P.set_comparison(*soft_sets(s, d), similar(s, d), kind, **options))), f"{_SETS} SELECT id::INT AS id, round({sql}, 6) AS score FROM z" + (" WHERE s1 > 0 AND s2 > 0 AND n * 0.002 >= 0.01" if "factor" in options else "")


def _distances(s, d):
    g = P.rule_distance(grounded(s, d).withColumn("head", F.col("truth2") * F.col("truth3") / 4), 3, "head")
    return g.select(F.concat(F.lit("r"), (F.col("N") % 5).cast("string")).alias("rule"), ((F.col("N") % 3) + 0.5).alias("weight"), "distance")


_DS = _G + ", ds AS (SELECT 'r' || (N % 5) AS rule, N % 3 + 0.5 AS weight, greatest(0, truth1 + truth2 + truth3 - 2 - truth2 * truth3 / 4) AS distance FROM g)"


def _constants(s, d):
    """Predicates are nations with the parts their suppliers sell."""
    x = table(s, d, "lineitem").join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sets = x.select(F.col("s_nationkey").alias("pred"), F.col("l_partkey").alias("const")).distinct()
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("k"))
    imp = n.filter("k >= 2").select(F.col("k").alias("rule"), F.explode(F.array(F.col("k") - 1, F.col("k") - 2)).alias("lhs"), F.col("k").alias("rhs"))
    return sets, imp


def _activate(s, d):
    """Truth flows from large customers' nations over supplier trade, halved by each step."""
    e = _trade(s, d)
    start = e.filter("a1 = 0")

    def step(delta, i):
        onward = e.select(F.col("a1").alias("a2"), F.col("a2").alias("to"), F.col("truth").alias("t"))
        return delta.join(onward, "a2").groupBy("a1", F.col("to").alias("a2")).agg(F.max(F.col("truth") * F.col("t") * 0.5).alias("truth"))

    return P.activate_to_fixpoint(start, step, 0.05)


def _trade(s, d):
    """Two nations trade in earnest as far as their mean discount is off the usual one."""
    x = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return x.groupBy(F.col("s_nationkey").alias("a1"), F.col("c_nationkey").alias("a2")).agg(F.least(F.lit(1.0), 200 * F.abs(F.avg(F.col("l_discount").cast("double")) - 0.05)).alias("truth"))


_T = "t AS (SELECT s_nationkey AS a1, c_nationkey AS a2, least(1.0, 200 * abs(avg(l_discount::DOUBLE) - 0.05))::DOUBLE AS truth FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"


def _regional(s, d):
    """Trade with the region of its seller, a problem of its own."""
    seller = table(s, d, "nation").select(F.col("n_nationkey").alias("a1"), F.col("n_regionkey").alias("problem"))
    return _trade(s, d).filter("truth > 0.3").join(seller, "a1")


def _domain(s, d):
    return table(s, d, "nation").select(F.col("n_regionkey").alias("problem"), F.col("n_nationkey").alias("entity"))


def _asked(s, d):
    """For each line item whether its seller's nation trades with the one its part's number names."""
    x = table(s, d, "lineitem").join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return x.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("n_regionkey").alias("problem"), F.col("n_nationkey").alias("a1"), (F.col("l_partkey") % 25).alias("a2"))


def _inference(s, d):
    """One open atom for each nation: it wants parts as far as trade says, and most want little."""
    t = _trade(s, d).filter("a1 <> a2 and truth > 0.2")
    rule = F.concat_ws(":", "a1", "a2")
    flows = t.select(rule.alias("rule"), F.explode(F.array(F.struct(F.col("a1").alias("atom"), F.lit(1.0).alias("coefficient")), F.struct(F.col("a2").alias("atom"), F.lit(-1.0).alias("coefficient")))).alias("x")).select("rule", "x.*")
    weights = t.select(rule.alias("rule"), F.lit(1.0).alias("weight"), (F.col("truth") - 1).alias("constant"))
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("atom"))
    low = n.select(F.concat(F.lit("low"), "atom").alias("rule"), "atom", F.lit(1.0).alias("coefficient"))
    high = n.filter("atom % 5 = 0").select(F.concat(F.lit("high"), "atom").alias("rule"), "atom", F.lit(-1.0).alias("coefficient"))
    terms = flows.unionByName(low).unionByName(high)
    rules = weights.unionByName(low.select("rule", F.lit(2.0).alias("weight"), F.lit(0.0).alias("constant"))).unionByName(high.select("rule", F.lit(5.0).alias("weight"), F.lit(0.9).alias("constant")))
    return P.map_inference(terms, rules, tolerance=0.005)


def _learn(s, d):
    li = table(s, d, "lineitem").select("l_quantity", "l_discount", "l_tax", (F.col("l_quantity") > 25).cast("double").alias("y"))
    model = P.learn_external_function(li, ["l_quantity", "l_discount", "l_tax"], "y")
    return model.transform(li).select("y", "prediction").groupBy("y", "prediction").agg(F.count("*").alias("n"))


def _weights(s, d):
    """Rule weights moved by three rounds against thresholds of the truth."""
    got = {r["rule"]: float(r["derivative"]) for r in P.total_incompatibility(_distances(s, d)).select("rule", "derivative").collect()}  # five rules
    learnt = P.learn_weights({r: x / 2 for r, x in got.items()}, lambda w: {r: got[r] / (1 + w[r]) for r in w}, dict.fromkeys(got, 0.5), steps=3, rate=0.01)
    return s.createDataFrame(sorted(learnt.items()), "rule string, weight double")


QUERIES = {
    "P01_predicate_table": (lambda s, d: P.predicate_table(table(s, d, "nation"), ["n_nationkey", "n_regionkey"]), "SELECT n_nationkey AS a1, n_regionkey AS a2, 1.0::DOUBLE AS truth, 0 AS part FROM nation"),
    "P02_visible": (lambda s, d: P.drop_partition(P.visible(parts(s, d), [0, 1], 2), 1).groupBy("part").agg(F.count("*").alias("n")), "SELECT (l_orderkey % 4)::INT AS part, count(*) AS n FROM lineitem WHERE l_orderkey % 4 IN (0, 2) GROUP BY 1"),
    "P03_get_facts": (lambda s, d: P.get_facts(parts(s, d), {1: 17}), "SELECT l_partkey AS a2, l_discount AS truth FROM lineitem WHERE l_orderkey = 17"),
    "P04_atom_lookup": (
        lambda s, d: rnd(P.atom_lookup(table(s, d, "supplier").select(F.col("s_suppkey").alias("a1")).withColumn("a2", (F.col("a1") * 7).cast("long")), preds(s, d)["sells"], closed=True)),
        f"WITH {_P} SELECT s_suppkey AS a1, s_suppkey * 7 AS a2, round(coalesce(truth, 0), 6) AS truth, CASE WHEN truth IS NULL THEN 'default' ELSE 'fact' END AS state FROM supplier LEFT JOIN sells ON a1 = s_suppkey AND a2 = s_suppkey * 7",
    ),
    "P05_facts_with": (
        lambda s, d: rnd(P.facts_with({k: v for k, v in preds(s, d).items() if k != "wants"}, 7)),
        f"WITH {_P}, u AS (SELECT 'sells' AS predicate, 1 AS position, a1 = 7 AS ok, truth, a1 || ',' || a2 AS args FROM sells UNION ALL SELECT 'sells', 2, a2 = 7, truth, a1 || ',' || a2 FROM sells UNION ALL SELECT 'lives', 1, a1 = 7, truth, a1 || ',' || a2 FROM lives UNION ALL SELECT 'lives', 2, a2 = 7, truth, a1 || ',' || a2 FROM lives) SELECT predicate, position, round(truth, 6) AS truth, args FROM u WHERE ok",
    ),
    "P06_ground_inner": (lambda s, d: rnd(grounded(s, d)), f"{_G} SELECT S, X, N, {_G6} FROM g"),
    "P06_ground_inner_constant": (lambda s, d: P.distinct_groundings(P.ground_inner(preds(s, d), [Atom("sells", ("S", "X")), Atom("lives", ("S", Const(3)))]), ["X"]), f"WITH {_P} SELECT DISTINCT s.a2 AS X FROM sells s JOIN lives l ON l.a1 = s.a1 WHERE l.a2 = 3"),
    "P07_ground_outer": (
        lambda s, d: rnd(P.ground_outer(preds(s, d), BODY)),
        f"""WITH {_P}, cs AS (SELECT a1 AS S FROM (SELECT a1, truth FROM sells UNION ALL SELECT a1, truth FROM lives) GROUP BY 1 ORDER BY round(sum(truth), 9) DESC, a1 LIMIT 2), cx AS (SELECT a2 AS X FROM (SELECT a2, truth FROM sells UNION ALL SELECT a2, truth FROM wants) GROUP BY 1 ORDER BY round(sum(truth), 9) DESC, a2 LIMIT 2),
cn AS (SELECT a AS N FROM (SELECT a2 AS a, truth FROM lives UNION ALL SELECT a1, truth FROM wants) GROUP BY 1 ORDER BY round(sum(truth), 9) DESC, a LIMIT 2)
SELECT S, X, N, round(coalesce(s.truth, 0), 6) AS truth1, round(coalesce(l.truth, 0), 6) AS truth2, round(coalesce(w.truth, 0), 6) AS truth3 FROM cs CROSS JOIN cx CROSS JOIN cn LEFT JOIN sells s ON s.a1 = S AND s.a2 = X LEFT JOIN lives l ON l.a1 = S AND l.a2 = N LEFT JOIN wants w ON w.a1 = N AND w.a2 = X""",
    ),
    "P08_anchor_outer": (lambda s, d: rnd(P.anchor_outer(preds(s, d), BODY)), f"WITH {_P} SELECT s.a1 AS S, s.a2 AS X, l.a2 AS N, round(s.truth, 6) AS truth1, round(l.truth, 6) AS truth2, round(w.truth, 6) AS truth3 FROM sells s LEFT JOIN lives l ON l.a1 = s.a1 LEFT JOIN wants w ON w.a1 = l.a2 AND w.a2 = s.a2"),
    "P09_order_atoms": (
        lambda s, d: rnd(P.ground_inner(preds(s, d), P.order_atoms([Atom("wants", ("N", "X")), Atom("sells", ("S", "X")), Atom("lives", ("S", Const(3)))]))),
        f"WITH {_P} SELECT s.a1 AS S, s.a2 AS X, w.a1 AS N, round(l.truth, 6) AS truth1, round(s.truth, 6) AS truth2, round(w.truth, 6) AS truth3 FROM lives l JOIN sells s ON s.a1 = l.a1 JOIN wants w ON w.a2 = s.a2 WHERE l.a2 = 3",
    ),
    "P10_null_count": (lambda s, d: P.null_count(P.anchor_outer(preds(s, d), BODY), 3), "SELECT 0 AS null_count"),
    "P11_bind_variables": (lambda s, d: rnd(P.bind_variables(grounded(s, d), {"N": 4})), f"{_G} SELECT S, X, N, {_G6} FROM g WHERE N = 4"),
    "P12_entity_domain": (lambda s, d: P.entity_domain({"lives": (preds(s, d)["lives"], [2]), "wants": (preds(s, d)["wants"], [1])}), f"WITH {_P} SELECT a2 AS entity FROM lives UNION SELECT a1 FROM wants"),
    "P13_external_function_filter": (lambda s, d: rnd(P.external_function_filter(grounded(s, d), lambda a, b: a % 10 - b % 10, "S", "X")), f"{_G} SELECT S, X, N, {_G6} FROM g WHERE S % 10 - X % 10 > 0"),
    "P14_rule_distance": (lambda s, d: rnd(_distances(s, d)), _DS + " SELECT rule, weight::DOUBLE AS weight, round(distance, 6) + 0.0 AS distance FROM ds"),
    "P15_rule_distance_avg": (
        lambda s, d: rnd(P.rule_distance_avg(grounded(s, d).withColumn("head", F.col("truth2") / 2), [2, 1, 0], "head", 1.0, 2.0, 1.0).select("S", "X", "N", "distance")),
        f"{_G} SELECT S, X, N, round(greatest(0, truth1 * 0.25 + truth2 * 0.5 + truth3 * 0.25 - truth2 / 2), 6) + 0.0 AS distance FROM g",
    ),
    "P16_total_incompatibility": (lambda s, d: rnd(P.total_incompatibility(_distances(s, d))), _DS + " SELECT rule, round(sum(weight * distance), 6) AS incompatibility, round(sum(distance), 6) AS derivative, count(*) AS groundings FROM ds GROUP BY 1"),
    "P17_prior": (lambda s, d: rnd(P.prior(preds(s, d)["wants"], ["a1", "a2"], 0.3, 0.1)), f"WITH {_P} SELECT round(sum(0.3 * abs(truth - 0.1)), 6) AS penalty FROM wants"),
    "P18_functional_constraint": (lambda s, d: rnd(P.functional_constraint(preds(s, d)["wants"], "partial_inverse_functional")), f"WITH {_P} SELECT a2 AS key, round(sum(truth), 6) AS total, round(sum(truth) - 1, 6) AS violation FROM wants GROUP BY 1 HAVING sum(truth) - 1 > 1e-9"),
    "P19_set_union": (lambda s, d: rnd(P.set_union(*soft_sets(s, d))), _SETS + " SELECT id::INT AS id, e AS element, round(sum(d), 6) AS degree FROM (SELECT * FROM sa UNION ALL SELECT * FROM sb) GROUP BY 1, 2"),
    "P20_set_equality": _set("equality", "coalesce(m / nullif(greatest(s1, s2), 0), 0)"),
    "P21_set_overlap": _set("overlap", "CASE WHEN s1 = 0 OR s2 = 0 THEN 1 ELSE least(1, m / least(s1, s2)) END"),
    "P22_set_constant_overlap": _set("constant_overlap", "least(1, coalesce(m / nullif(greatest(s1, s2) * 0.1, 0), 0))"),
    "P23_set_cross_equality": _set("cross_equality", "coalesce(x / nullif(s1 * s2, 0), 0)"),
    "P24_set_average": _set("average", "coalesce(m / nullif(s1, 0), 0)"),
    "P25_set_min": _set("min", "t"),
    "P25_evid_set_min": _set("evid_min", "least(1, t)"),
    "P26_enough_support": _set("equality", "coalesce(m / nullif(greatest(s1, s2), 0), 0)", factor=0.002),
    "P27_close_world": (
        lambda s, d: P.close_world(_regional(s, d), _domain(s, d), 2, table(s, d, "region").select(F.col("r_regionkey").alias("a1"))),
        f"WITH {_T} SELECT x.n_regionkey AS problem, x.n_nationkey AS a1, y.n_nationkey AS a2, 0.0::DOUBLE AS truth FROM nation x JOIN nation y USING (n_regionkey) WHERE x.n_nationkey > 4 AND NOT EXISTS (SELECT 1 FROM t WHERE truth > 0.3 AND t.a1 = x.n_nationkey AND t.a2 = y.n_nationkey)",
    ),
    "P27_closed_lookup": (
        lambda s, d: rnd(P.closed_lookup(_asked(s, d), _regional(s, d), _domain(s, d), 2, table(s, d, "region").select(F.col("r_regionkey").alias("a1")))),
        f"""WITH {_T}, f AS (SELECT n_regionkey AS problem, a1, a2, truth FROM t JOIN nation ON n_nationkey = a1 WHERE truth > 0.3),
a AS (SELECT l_orderkey, l_linenumber, l_suppkey, n_regionkey AS problem, n_nationkey AS a1, l_partkey % 25 AS a2 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT l_orderkey, l_linenumber, l_suppkey, a.problem, a.a1, a.a2, round(coalesce(f.truth, CASE WHEN a.a1 > 4 AND n.n_nationkey IS NOT NULL THEN 0.0 END), 6) AS truth FROM a LEFT JOIN f ON f.a1 = a.a1 AND f.a2 = a.a2 AND f.problem = a.problem LEFT JOIN nation n ON n.n_regionkey = a.problem AND n.n_nationkey = a.a2""",
    ),
    "P27_closed_counts": (
        lambda s, d: P.closed_counts(_regional(s, d), _domain(s, d), 2, table(s, d, "region").select(F.col("r_regionkey").alias("a1"))),
        f"WITH {_T} SELECT x.n_regionkey AS problem, count(*) FILTER (x.n_nationkey > 4 AND NOT EXISTS (SELECT 1 FROM t WHERE truth > 0.3 AND t.a1 = x.n_nationkey AND t.a2 = y.n_nationkey)) AS negative FROM nation x JOIN nation y USING (n_regionkey) GROUP BY 1",
    ),
    "P28_propagate_constants": (
        lambda s, d: P.propagate_constants(*_constants(s, d)),
        # Nation k takes what k - 1 and k - 2 share, so one walk over the nations closes the sets.
        f"""WITH RECURSIVE own AS (SELECT n_nationkey AS k, coalesce(c, []) AS c FROM nation LEFT JOIN (SELECT s_nationkey, list(DISTINCT l_partkey) AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) ON s_nationkey = n_nationkey),
walk AS (SELECT y.k, x.c AS before, y.c AS now FROM own x JOIN own y ON x.k = 0 AND y.k = 1 UNION ALL SELECT own.k, now, list_distinct(list_concat(own.c, list_intersect(before, now))) FROM walk JOIN own ON own.k = walk.k + 1)
SELECT k AS pred, unnest(now) AS const FROM walk UNION ALL SELECT k, unnest(c) FROM own WHERE k = 0""",
    ),
    "P29_activate_to_fixpoint": (
        lambda s, d: rnd(_activate(s, d)),
        # A step halves at least, so no atom is active after the fifth round.
        f"WITH {_T}, r0 AS (SELECT a1, a2, truth FROM t WHERE a1 = 0 AND truth >= 0.05), "
        + ", ".join(f"n{i} AS (SELECT {'q' if i > 1 else 'r0'}.a1, t.a2, max({'q' if i > 1 else 'r0'}.truth * t.truth * 0.5) AS truth FROM {f'n{i - 1} q' if i > 1 else 'r0'} JOIN t ON t.a1 = {'q' if i > 1 else 'r0'}.a2 GROUP BY 1, 2 HAVING max({'q' if i > 1 else 'r0'}.truth * t.truth * 0.5) >= 0.05 AND t.a2 NOT IN (SELECT a2 FROM r{i - 1})), r{i} AS (SELECT * FROM r{i - 1} UNION ALL SELECT * FROM n{i})" for i in range(1, 6))
        + " SELECT a1, a2, round(truth, 6) AS truth FROM r5",
    ),
    "P30_map_inference": (lambda s, d: rnd(_inference(s, d)), None),
    "P31_learn_weights": (
        lambda s, d: rnd(_weights(s, d)),
        _DS
        + ", d0 AS (SELECT rule, round(sum(distance), 9) AS x, 0.5::DOUBLE AS w0 FROM ds GROUP BY 1), d1 AS (SELECT *, least(100, greatest(0, w0 + 0.01 * (x / (1 + w0) - x / 2))) AS w1 FROM d0), d2 AS (SELECT *, least(100, greatest(0, w1 + 0.01 * (x / (1 + w1) - x / 2))) AS w2 FROM d1), d3 AS (SELECT *, least(100, greatest(0, w2 + 0.01 * (x / (1 + w2) - x / 2))) AS w3 FROM d2) SELECT rule, round((w1 + w2 + w3) / 3, 6) + 0.0 AS weight FROM d3",
    ),
    "P32_entailment_answer": (
        lambda s, d: P.entailment_answer(table(s, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id")), table(s, d, "lineitem").filter("l_tax > 0.05").select(F.col("l_partkey").alias("id"), F.col("l_discount").alias("truth"))),
        "SELECT p_name AS name, max(coalesce(l_discount, 0)) AS truth FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_tax > 0.05 GROUP BY 1",
    ),
    "P33_clause_true_counts": (lambda s, d: P.clause_true_counts(grounded(s, d).select(F.col("N").alias("clause"), F.col("truth3").alias("truth"))), _G + " SELECT N AS clause, count(*) AS n FROM g WHERE truth3 >= 0.5 GROUP BY 1"),
    "P34_learn_external_function": (_learn, None),
    "P35_query_stats": (lambda s, d: rnd(P.query_stats(table(s, d, "lineitem").agg(F.sum("l_tax").alias("t"), F.max("l_linenumber").alias("m")), ["t", "m"], single=True)), "SELECT round(sum(l_tax), 6) AS t, max(l_linenumber)::DOUBLE AS m FROM lineitem"),
    "P36_weight_to_log_odds": (lambda s, d: rnd(preds(s, d)["wants"].select("a1", "a2", log_odds(F.col("truth")).alias("w"))), f"WITH {_P}, c AS (SELECT a1, a2, least(1 - 1e-9, greatest(1e-9, truth)) AS p FROM wants) SELECT a1, a2, round(ln(p / (1 - p)), 6) + 0.0 AS w FROM c"),
}
