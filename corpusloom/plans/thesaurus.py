"""Thesaurus queries: objects are part brands, attributes nations of suppliers and ordered quantities."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import thesaurus as T
from corpusloom.operators.loops import cut
from corpusloom.plans.inputs import RELATIONS_SQL, r6, relations, table

COUNTS_SQL = (
    RELATIONS_SQL
    + """,
tot AS (SELECT sum(f)::DOUBLE AS n, count(DISTINCT obj)::DOUBLE AS nobj, count(DISTINCT attr)::DOUBLE AS nattr FROM rel),
cnt AS (SELECT rel.*, f::DOUBLE AS x, (sum(f) OVER (PARTITION BY obj))::DOUBLE AS fo, (count(*) OVER (PARTITION BY obj))::DOUBLE AS no, (sum(f) OVER (PARTITION BY attr, type))::DOUBLE AS fa,
  (count(*) OVER (PARTITION BY attr, type))::DOUBLE AS na, (sum(f) OVER (PARTITION BY obj, type))::DOUBLE AS fot, (sum(f) OVER (PARTITION BY type))::DOUBLE AS ft, n, nobj, nattr FROM rel, tot)"""
)

_MI = "log2((x / n) / ((fo / n) * (fa / n)))"
_TT = "((x / n - (fo / n) * (fa / n)) / sqrt((fo / n) * (fa / n)))"
_TERM = "(CASE WHEN {k} > 0 THEN {k} * ln({k} * n / ({r} * {c})) ELSE 0 END)"
WEIGHT_SQL = {
    "identity": "1.0",
    "zero": "0.0",
    "freq": "x",
    "relfreq": "x / fo",
    "chi2": "n * pow(x * (n - fo - fa + x) - (fo - x) * (fa - x), 2) / (fo * fa * (n - fo) * (n - fa))",
    "lr": "2 * (" + " + ".join(_TERM.format(k=k, r=r, c=c) for k, r, c in (("x", "fo", "fa"), ("(fo - x)", "fo", "(n - fa)"), ("(fa - x)", "(n - fo)", "fa"), ("(n - fo - fa + x)", "(n - fo)", "(n - fa)"))) + ")",
    "lin98b": "greatest(0, ln(x * ft / (fa * fot)))",
    "lin98c": "greatest(0, -ln(na / nobj))",
    "dice": "2 * x / (fo + fa)",
    "dicelog": "2 * x / (fo + fa) * log2(x + 1)",
    "grefenstette": "log2(x + 1) / log2(na + 1)",
    "mi": _MI,
    "milog": f"{_MI} * log2(x + 1)",
    "micut": f"greatest(0, {_MI})",
    "micutlog": f"greatest(0, {_MI} * log2(x + 1))",
    "ttest": _TT,
    "ttestlog": f"{_TT} * log2(x + 1)",
    "ttestcut": f"greatest(0, {_TT})",
    "ttestcutlog": f"greatest(0, {_TT} * log2(x + 1))",
    "tfidf": "x / na",
    "tfidf2": "log2(x + 1) / log2(1 + nattr / na)",
}

WEIGHED_SQL = f"WITH {COUNTS_SQL}, wt AS (SELECT obj, attr, type, f, na, {WEIGHT_SQL['ttestcut']} AS w FROM cnt), pos AS (SELECT * FROM wt WHERE w > 0), nrm AS (SELECT obj, sqrt(sum(w * w)) AS norm, sum(w) AS total, count(*)::DOUBLE AS n FROM pos GROUP BY obj)"
_P, _Q = "(a.w / x.total)", "(b.w / y.total)"
_ENT = "(CASE WHEN {0} > 0 THEN {0} * log2({0}) ELSE 0 END)"
SUMS_SQL = (
    WEIGHED_SQL
    + f""", s AS (SELECT a.obj AS obj1, b.obj AS obj2, sum(a.w * b.w) AS dot, sum(least(a.w, b.w)) AS le, sum(a.w + b.w) AS bo, sum(abs(a.w - b.w)) AS gap, count(*)::DOUBLE AS sh,
  sum({_ENT.format(_P)} + {_ENT.format(_Q)} - 2 * {_ENT.format(f'(({_P} + {_Q}) / 2)')}) AS js, sum({_P}) AS p, sum({_Q}) AS q,
  sum({_Q} * log2({_Q} / (0.99 * {_P} + 0.01 * {_Q}))) AS skew,
  any_value(x.norm) AS norm1, any_value(x.total) AS t1, any_value(x.n) AS n1, any_value(y.norm) AS norm2, any_value(y.total) AS t2, any_value(y.n) AS n2
  FROM pos a JOIN pos b ON a.attr = b.attr AND a.obj <> b.obj JOIN nrm x ON x.obj = a.obj JOIN nrm y ON y.obj = b.obj GROUP BY 1, 2)"""
)
MEASURE_SQL = {
    "cosine": "dot / (norm1 * norm2)",
    "bincosine": "sh / sqrt(n1 * n2)",
    "dice": "2 * dot / (t1 + t2)",
    "dice2": "2 * le / (t1 + t2)",
    "bindice": "2 * sh / (n1 + n2)",
    "jaccard": "le / (t1 + t2 - le)",
    "jaccard2": "dot / (norm1 * norm1 + norm2 * norm2 - dot)",
    "binjaccard": "sh / (n1 + n2 - sh)",
    "lin": "bo / (t1 + t2)",
    "lin2": "2 * le / (t1 + t2)",
    "manhattan": "-(gap + t1 + t2 - bo)",
    "euclidean": "-sqrt(greatest(0, norm1 * norm1 + norm2 * norm2 - 2 * dot))",
    "js": "-(js / 2 + (1 - p) / 2 + (1 - q) / 2)",
    "skew": "-(skew + (1 - q) * log2(100))",
}


def weighed(spark, sf):
    return cut(T.optimise(T.weigh(T.relation_counts(relations(spark, sf)))))


def _weights(*names):
    def query(spark, sf):
        counts = T.relation_counts(relations(spark, sf))
        return counts.select("obj", "attr", *(r6(T.association(n)).alias(n) for n in names))

    sql = f"WITH {COUNTS_SQL} SELECT obj, attr, " + ", ".join(f"round({WEIGHT_SQL[n]}, 6) + 0.0 AS {n}" for n in names) + " FROM cnt"
    return query, sql


def _measure(*names):
    def query(spark, sf):
        sums = T.pair_sums(weighed(spark, sf))
        return sums.select("obj1", "obj2", *(r6(T.measures()[n]).alias(n) for n in names))

    return query, SUMS_SQL + " SELECT obj1, obj2, " + ", ".join(f"round({MEASURE_SQL[n]}, 6) + 0.0 AS {n}" for n in names) + " FROM s"


_SCORES_SQL = SUMS_SQL + f", sc AS (SELECT obj1, obj2, {MEASURE_SQL['jaccard']} AS score FROM s)"
_PLACE = "row_number() OVER (PARTITION BY obj1 ORDER BY score DESC, obj2)"


def scores(spark, sf):
    return T.similarity(weighed(spark, sf), "jaccard")


def _rounded(df, *columns):
    return df.withColumns({c: r6(F.col(c)) for c in columns})


def t2(spark, sf):
    nation, supplier = table(spark, sf, "nation"), table(spark, sf, "supplier")
    part, li = table(spark, sf, "part"), table(spark, sf, "lineitem")
    rows = li.join(part, li.l_partkey == part.p_partkey).join(supplier, li.l_suppkey == supplier.s_suppkey).join(nation, supplier.s_nationkey == nation.n_nationkey)
    tuples = rows.select(F.col("p_type").alias("w1"), F.when(F.col("p_size") % 2 == 0, "NN").otherwise("VB").alias("t1"), F.col("l_returnflag").alias("rel"), F.col("n_name").alias("w2"), F.when(F.col("n_regionkey") < 3, "NNS").otherwise("JJ").alias("t2"))
    return T.relations_from_tuples(tuples, skipped_words=("ECONOMY",), skipped_relations=("N",))


_T2_SQL = """WITH t AS (SELECT p_type AS w1, p_size % 2 = 0 AS a, l_returnflag AS rel, n_name AS w2, n_regionkey < 3 AS b FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  WHERE p_type <> 'ECONOMY' AND l_returnflag <> 'N'),
u AS (SELECT w1 AS obj, rel || ':' || w2 AS attr, rel AS type FROM t WHERE a UNION ALL SELECT w2, rel || '^-1:' || w1, rel || '^-1' FROM t WHERE b)
SELECT obj, attr, type, count(*) AS f FROM u GROUP BY 1, 2, 3"""


def _objects(spark, sf, op):
    rel = relations(spark, sf)
    side = lambda n: rel.filter(F.col("obj") == f"Brand#{n}")
    return op(side(3), side(7))


_AB_SQL = f"WITH {RELATIONS_SQL}, a AS (SELECT * FROM rel WHERE obj = 'Brand#3'), b AS (SELECT * FROM rel WHERE obj = 'Brand#7')"

QUERIES = {
    "T01_relation_counts": (
        lambda s, d: T.relation_counts(relations(s, d)).select("obj", "attr", "type", "f", "fo", "no", "fa", "na", "fot", "ft", "ftotal", "nobj"),
        f"WITH {COUNTS_SQL} SELECT obj, attr, type, f, fo::BIGINT AS fo, no::BIGINT AS no, fa::BIGINT AS fa, na::BIGINT AS na, fot::BIGINT AS fot, ft::BIGINT AS ft, n::BIGINT AS ftotal, nobj::BIGINT AS nobj FROM cnt",
    ),
    "T02_relations_from_tuples": (t2, _T2_SQL),
    "T03_cutoff_objects": (lambda s, d: T.cutoff_objects(relations(s, d), 4800), f"WITH {RELATIONS_SQL} SELECT * FROM rel WHERE obj IN (SELECT obj FROM rel GROUP BY obj HAVING sum(f) >= 4800)"),
    "T03_cutoff_report": (
        lambda s, d: T.cutoff_report(relations(s, d), 4800),
        f"WITH {RELATIONS_SQL}, o AS (SELECT obj, sum(f) AS n, count(*) AS k FROM rel GROUP BY obj) SELECT count(*) FILTER (n < 4800) AS dropped_objects, coalesce(sum(k) FILTER (n < 4800), 0)::BIGINT AS dropped_relations FROM o",
    ),
    "T04_optimise": (lambda s, d: _rounded(weighed(s, d).select("obj", "attr", "w"), "w"), WEIGHED_SQL + " SELECT obj, attr, round(w, 6) AS w FROM pos"),
    "T05_weights_frequency": _weights("identity", "zero", "freq", "relfreq"),
    "T06_weight_chi2": _weights("chi2"),
    "T07_weight_lr": _weights("lr"),
    "T08_weight_lin98b": _weights("lin98b"),
    "T09_weight_lin98c": _weights("lin98c"),
    "T10_weights_dice": _weights("dice", "dicelog", "grefenstette"),
    "T11_weights_mi": _weights("mi", "milog", "micut", "micutlog"),
    "T12_weights_ttest": _weights("ttest", "ttestlog", "ttestcut", "ttestcutlog"),
    "T13_relweight": (lambda s, d: _rounded(T.relweight(weighed(s, d)).select("obj", "attr", "w"), "w"), WEIGHED_SQL + " SELECT obj, attr, round(w / sum(w) OVER (PARTITION BY obj), 6) AS w FROM pos"),
    "T14_weights_tfidf": _weights("tfidf", "tfidf2"),
    "T15_object_norms": (lambda s, d: _rounded(T.object_norms(weighed(s, d)), "norm", "total"), WEIGHED_SQL + " SELECT obj, round(norm, 6) AS norm, round(total, 6) AS total, n::BIGINT AS n FROM nrm"),
    "T16_cosine": _measure("cosine"),
    "T17_bincosine": _measure("bincosine"),
    "T18_dice": _measure("dice", "dice2"),
    "T19_bindice": _measure("bindice"),
    "T20_jaccard": _measure("jaccard"),
    "T21_jaccard2": _measure("jaccard2"),
    "T22_binjaccard": _measure("binjaccard"),
    "T23_lin": _measure("lin", "lin2"),
    "T24_manhattan_euclidean": _measure("manhattan", "euclidean"),
    "T25_js_skew": _measure("js", "skew"),
    "T26_pearson": (
        lambda s, d: _rounded(T.pearson(weighed(s, d)), "score"),
        SUMS_SQL + ", dim AS (SELECT count(DISTINCT attr)::DOUBLE AS k FROM pos) SELECT obj1, obj2, round((k * dot - t1 * t2) / (sqrt(k * norm1 * norm1 - t1 * t1) * sqrt(k * norm2 * norm2 - t2 * t2)), 6) + 0.0 AS score FROM s, dim",
    ),
    "T27_neighbours": (lambda s, d: _rounded(T.neighbours(scores(s, d), 10), "score"), _SCORES_SQL + f" SELECT obj1, obj2, round(score, 6) AS score, {_PLACE}::INT AS place FROM sc WHERE score <> 0 QUALIFY {_PLACE} <= 10"),
    "T27_neighbours_excluding": (
        lambda s, d: _rounded(T.neighbours(scores(s, d), 5, relations(s, d).select("obj").filter("obj like '%1'").distinct()), "score"),
        _SCORES_SQL + f" SELECT obj1, obj2, round(score, 6) AS score, {_PLACE}::INT AS place FROM sc WHERE score <> 0 AND obj2 NOT LIKE '%1' QUALIFY {_PLACE} <= 5",
    ),
    "T28_all_neighbours": (lambda s, d: _rounded(T.neighbours(scores(s, d), 50), "score"), _SCORES_SQL + f" SELECT obj1, obj2, round(score, 6) AS score, {_PLACE}::INT AS place FROM sc WHERE score <> 0 QUALIFY {_PLACE} <= 50"),
    "T29_best_neighbour": (lambda s, d: _rounded(T.best_neighbour(scores(s, d)), "score"), _SCORES_SQL + f" SELECT obj1, obj2, round(score, 6) AS score FROM sc WHERE score > 0 QUALIFY {_PLACE} = 1"),
    "T30_neighbour_rank": (
        lambda s, d: T.neighbour_rank(scores(s, d), scores(s, d).select("obj1", "obj2").filter("obj1 < obj2")),
        _SCORES_SQL + " SELECT obj1, obj2, rank::INT AS rank FROM (SELECT obj1, obj2, rank() OVER (PARTITION BY obj1 ORDER BY score DESC) AS rank FROM sc WHERE score <> 0) WHERE obj1 < obj2",
    ),
    "T31_canonical_attributes": (
        lambda s, d: _rounded(T.canonical_attributes(weighed(s, d), 5, 5, 10_000, ("nation",)), "w"),
        WEIGHED_SQL + " SELECT obj, attr, round(w, 6) AS w, row_number() OVER (PARTITION BY obj ORDER BY w DESC, attr)::INT AS place FROM pos WHERE f >= 5 AND na <= 10000 AND type = 'nation' QUALIFY place <= 5",
    ),
    "T31_blocked_similarity": (
        lambda s, d: _rounded(T.similarity(w := weighed(s, d), "jaccard", blocking=T.canonical_attributes(w, 3)), "score"),
        _SCORES_SQL
        + ", can AS (SELECT obj, attr FROM pos WHERE f >= 5 AND na <= 10000 QUALIFY row_number() OVER (PARTITION BY obj ORDER BY w DESC, attr) <= 3), al AS (SELECT DISTINCT a.obj AS o1, b.obj AS o2 FROM can a JOIN can b USING (attr)) SELECT obj1, obj2, round(score, 6) AS score FROM sc JOIN al ON o1 = obj1 AND o2 = obj2",
    ),
    "T32_explain_pair": (lambda s, d: _rounded(T.explain_pair(weighed(s, d), "Brand#3", "Brand#7"), "w1", "w2"), WEIGHED_SQL + " SELECT a.attr, round(a.w, 6) AS w1, round(b.w, 6) AS w2 FROM pos a JOIN pos b USING (attr) WHERE a.obj = 'Brand#3' AND b.obj = 'Brand#7'"),
    "T33_top_relations": (lambda s, d: _rounded(T.top_relations(weighed(s, d), 5), "w"), WEIGHED_SQL + " SELECT obj, attr, round(w, 6) AS w, row_number() OVER (PARTITION BY obj ORDER BY w DESC, attr)::INT AS place FROM pos WHERE f > 2 QUALIFY place <= 5"),
    "T34_describe_object": (lambda s, d: T.describe(relations(s, d), "obj"), f"WITH {RELATIONS_SQL} SELECT obj, sum(f)::BIGINT AS freq, count(*) AS nrelations, max(f) AS maxrelation FROM rel GROUP BY obj"),
    "T34_describe_attribute": (lambda s, d: T.describe(relations(s, d), "attr"), f"WITH {RELATIONS_SQL} SELECT attr, sum(f)::BIGINT AS freq, count(*) AS nrelations, max(f) AS maxrelation FROM rel GROUP BY attr"),
    "T34_describe_type": (lambda s, d: T.describe(relations(s, d), "type"), f"WITH {RELATIONS_SQL} SELECT type, sum(f)::BIGINT AS freq, count(*) AS nrelations, max(f) AS maxrelation FROM rel GROUP BY type"),
    "T35_object_sum": (lambda s, d: _objects(s, d, lambda a, b: T.object_sum(a, b, "ab", 2.0, 0.5)), _AB_SQL + " SELECT 'ab' AS obj, attr, type, sum(f) AS f FROM (SELECT attr, type, f * 2.0::DOUBLE AS f FROM a UNION ALL SELECT attr, type, f * 0.5::DOUBLE FROM b) GROUP BY attr, type"),
    "T36_object_diff": (lambda s, d: _objects(s, d, lambda a, b: T.object_diff(a, b, "ab", 2.0, 1.0)), _AB_SQL + " SELECT 'ab' AS obj, a.attr, a.type, a.f * 2.0::DOUBLE - coalesce(b.f, 0) AS f FROM a LEFT JOIN b USING (attr, type) WHERE a.f * 2.0::DOUBLE - coalesce(b.f, 0) > 0"),
    "T37_object_intersect": (lambda s, d: _objects(s, d, lambda a, b: T.object_intersect(a, b, "ab")), _AB_SQL + " SELECT 'ab' AS obj, attr, type, a.f + b.f AS f FROM a JOIN b USING (attr, type)"),
    "T38_object_split": (
        lambda s, d: T.object_split(relations(s, d), "Brand#3", 0.25, "Brand#3b"),
        f"WITH {RELATIONS_SQL} SELECT obj, attr, type, f::DOUBLE AS f FROM rel WHERE obj <> 'Brand#3' UNION ALL SELECT obj, attr, type, f * 0.75::DOUBLE FROM rel WHERE obj = 'Brand#3' UNION ALL SELECT 'Brand#3b', attr, type, f * 0.25::DOUBLE FROM rel WHERE obj = 'Brand#3'",
    ),
    "T38_pseudo_object": (
        lambda s, d: T.pseudo_object(r := relations(s, d), r.filter("obj = 'Brand#3'").select(F.lit("new").alias("obj"), "attr", "type", "f")),
        f"WITH {RELATIONS_SQL} SELECT obj, attr, type, f::DOUBLE AS f FROM rel UNION ALL SELECT 'new', attr, type, f FROM rel WHERE obj = 'Brand#3'",
    ),
}
