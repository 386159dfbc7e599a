"""Features and models over line items, vectors and labelled texts."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from corpusloom.operators import features as X
from corpusloom.plans.inputs import letters, r6, table


def rnd(df):
    return df.select(*(r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def li(s, d):
    return table(s, d, "lineitem")


def labelled(s, d):
    x = li(s, d).select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", (F.col("l_quantity") + F.col("l_discount") * 100 > 30).cast("double").alias("y"))
    return x.withColumn("c", F.when(F.col("l_quantity") < 17, 0.0).when(F.col("l_quantity") < 34, 1.0).otherwise(2.0))


_COLS = ["l_quantity", "l_discount", "l_tax"]


def hits(model, s, d, label="y"):
    return model.transform(X.assemble(labelled(s, d), _COLS)).groupBy(label, "prediction").agg(F.count("*").alias("n"))


def types(s, d):
    p = table(s, d, "part")
    pairs = p.select(F.element_at(F.split("p_name", " "), 1).alias("lhs"), F.element_at(F.split("p_name", " "), 2).alias("rhs")).distinct()
    words = p.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    rel = words.select(F.col("word").alias("lhs")).crossJoin(words.select(F.col("word").alias("rhs"))).withColumn("relation", F.when(F.length("lhs") < F.length("rhs"), "hypernym").when(F.length("lhs") > F.length("rhs"), "hyponym").otherwise("synonym"))
    return pairs, words.filter("length(word) > 3"), rel


def arrays(s, d):
    o = li(s, d).groupBy("l_orderkey").agg(F.sort_array(F.collect_set((F.col("l_suppkey") % 7).cast("string"))).alias("lhs"), F.sort_array(F.collect_set((F.col("l_partkey") % 7).cast("string"))).alias("rhs"))
    return o


_AR = "ar AS (SELECT l_orderkey, list(DISTINCT (l_suppkey % 7)::VARCHAR) AS l, list(DISTINCT (l_partkey % 7)::VARCHAR) AS r FROM lineitem GROUP BY 1)"


def rows(s, d):
    return li(s, d).select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("feature")).distinct()


def chain(s, d):
    """Two label columns for each supplier with made scores, and the pairs seen."""
    a = li(s, d).groupBy(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("label")).agg((F.count("*") / 1000.0).alias("score"))
    b = li(s, d).groupBy(F.col("l_suppkey").alias("id"), F.col("l_linestatus").alias("label")).agg((F.count("*") / 1000.0).alias("score"))
    allowed = li(s, d).filter("l_returnflag <> 'R' or l_linestatus = 'F'").select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).distinct()
    return [a, b], [allowed]


def _ensemble(s, d):
    """Features by order, first half of the orders to train, second to test."""
    x = li(s, d).groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("a"), F.sum("l_extendedprice").alias("y"))
    half = x.agg(F.percentile("l_orderkey", F.lit(0.5)).alias("h")).first()["h"] or 0
    model = X.linear_regression(x.filter(F.col("l_orderkey") <= half), ["q", "a"], "y")
    return model.transform(X.assemble(x.filter(F.col("l_orderkey") > half), ["q", "a"])).agg(F.corr("prediction", "y").alias("r")).select(F.round("r", 4).alias("r"))


def _cross(s, d):
    def fit(train, test):
        return X.logistic(train, _COLS, "y").transform(X.assemble(test, _COLS)).select("l_orderkey", "y", "prediction")

    return X.cross_validate(labelled(s, d), "l_orderkey", 2, fit).groupBy("fold").agg(F.count("*").alias("n"))


def vecs(s, d, parity):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1 + parity * 3, 3), lambda x: x.cast("double")).alias("features"))


QUERIES = {
    "F01_bin_feature": (
        lambda s, d: li(s, d).select("l_orderkey", "l_linenumber", "l_suppkey", X.bin_feature(F.col("l_quantity"), 50.0).alias("f")).select("l_orderkey", "l_linenumber", "l_suppkey", (F.array_position("f", 1.0) - 1).cast("int").alias("bin")),
        "SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_quantity = 50 THEN 10 ELSE floor(l_quantity / 5) END::INT AS bin FROM lineitem",
    ),
    "F02_pair_pooling": (lambda s, d: rnd(X.pair_pooling(li(s, d), "l_orderkey", ["l_discount", "l_tax"])), "SELECT l_orderkey, max(l_discount) AS max_l_discount, min(l_discount) AS min_l_discount, round(avg(l_discount), 6) AS avg_l_discount, max(l_tax) AS max_l_tax, min(l_tax) AS min_l_tax, round(avg(l_tax), 6) AS avg_l_tax FROM lineitem GROUP BY 1"),
    "F03_lexical_pair_features": (
        lambda s, d: X.lexical_pair_features(*types(s, d)),
        "SELECT DISTINCT split_part(p_name, ' ', 1) AS lhs, split_part(p_name, ' ', 2) AS rhs, (lhs = rhs)::INT AS same, (length(lhs) <= 3)::INT AS oov_lhs, (length(rhs) <= 3)::INT AS oov_rhs, (length(lhs) = length(rhs))::INT AS synonym, (length(lhs) < length(rhs))::INT AS hypernym, (length(lhs) > length(rhs))::INT AS hyponym, 0 AS antonym FROM part",
    ),
    "F04_path_features": (
        lambda s, d: arrays(s, d).select("l_orderkey", F.array_join(F.transform(X.path_features(F.col("lhs"), F.col("rhs"), ["1", "5"]), lambda x: x.cast("string")), "").alias("f")),
        f"WITH {_AR}, b AS (SELECT l_orderkey, list_contains(l, '1')::INT AS a1, list_contains(l, '5')::INT AS a5, list_contains(r, '1')::INT AS b1, list_contains(r, '5')::INT AS b5 FROM ar) SELECT l_orderkey, concat(a1, a5, b1, b5, a1 * b1, a5 * b5, a1 * (1 - b1), a5 * (1 - b5), b1 * (1 - a1), b5 * (1 - a5)) AS f FROM b",
    ),
    "F05_rule_feature_vector": (
        lambda s, d: rnd(X.rule_feature_vector(arrays(s, d)).select("l_orderkey", *(F.get("features", F.lit(i)).alias(f"f{i}") for i in range(8)))),
        f"WITH {_AR}, b AS (SELECT l_orderkey, len(l)::DOUBLE AS x, len(r)::DOUBLE AS y, len(list_intersect(l, r))::DOUBLE AS z FROM ar) SELECT l_orderkey, x AS f0, y AS f1, z AS f2, x - z AS f3, y - z AS f4, round(z / x, 6) AS f5, round(z / y, 6) AS f6, round(least(x, y) / greatest(x, y), 6) AS f7 FROM b",
    ),
    "F06_text_features": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(F.sort_array(X.text_features(F.split("p_name", " "), F.create_map(F.lit("red"), F.lit("7")))), ",").alias("f")),
        "WITH p AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part), g AS (SELECT p_partkey, list_distinct(list_concat(list_transform(w, lambda x: 'w:' || x), ['b:' || p_name], flatten(list_transform(w, lambda x: list_transform(range(2, greatest(3, length(x)) + 1), lambda e: 'c:' || substr(x, greatest(1, e - 2), least(3, e))))), CASE WHEN list_contains(w, 'red') THEN ['k:7'] ELSE [] END)) AS f FROM p) SELECT p_partkey, array_to_string(list_sort(f), ',') AS f FROM g",
    ),
    "F07_drop_rare_features": (lambda s, d: X.drop_rare_features(rows(s, d), 560).groupBy("id").agg(F.count("*").alias("n")), "WITH r AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS f FROM lineitem) SELECT id, count(*) AS n FROM r WHERE f IN (SELECT f FROM r GROUP BY 1 HAVING count(*) > 560) GROUP BY 1"),
    "F08_class_weights": (lambda s, d: rnd(X.with_class_weights(labelled(s, d), "y").groupBy("y").agg(F.max("weight").alias("weight"))), "WITH x AS (SELECT (l_quantity + l_discount * 100 > 30)::INT::DOUBLE AS y FROM lineitem) SELECT y, round((SELECT count(*) FROM x)::DOUBLE / count(*), 6) AS weight FROM x GROUP BY 1"),
    "F08_logistic": (lambda s, d: hits(X.logistic(labelled(s, d), _COLS, "y"), s, d), None),
    "F09_one_vs_rest": (lambda s, d: hits(X.one_vs_rest(labelled(s, d), _COLS, "c"), s, d, "c"), None),
    "F10_svm": (lambda s, d: hits(X.svm(labelled(s, d), _COLS, "y"), s, d), None),
    "F11_reduce_dimensions": (
        lambda s, d: X.reduce_dimensions(labelled(s, d), _COLS, 2).select("l_orderkey", F.round(F.abs(vector_to_array("reduced")[0]), 3).alias("first")),
        # The first direction of the covariances, by repeated multiplication.
        """WITH RECURSIVE c AS (SELECT var_pop(l_quantity) AS xx, var_pop(l_discount) AS yy, var_pop(l_tax) AS zz, covar_pop(l_quantity, l_discount) AS xy, covar_pop(l_quantity, l_tax) AS xz, covar_pop(l_discount, l_tax) AS yz FROM lineitem),
p AS (SELECT 0 AS i, 1.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z UNION ALL
  SELECT i + 1, a / n, b / n, d / n FROM (SELECT i, a, b, d, sqrt(a * a + b * b + d * d) AS n FROM (SELECT i, xx * x + xy * y + xz * z AS a, xy * x + yy * y + yz * z AS b, xz * x + yz * y + zz * z AS d FROM p, c WHERE i < 60))),
v AS (SELECT x, y, z FROM p WHERE i = 60)
SELECT l_orderkey, round(abs(l_quantity * x + l_discount * y + l_tax * z), 3) AS first FROM lineitem, v""",
    ),
    "F12_scaled": (lambda s, d: rnd(X.scaled(li(s, d).select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), ["l_quantity"])), "SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 6) + 0.0 AS z_l_quantity FROM lineitem"),
    "F13_concat_feature_sets": (lambda s, d: rnd(X.concat_feature_sets([vecs(s, d, 0), vecs(s, d, 1)]).select("id", F.size("features").alias("n"), F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("total"))), "SELECT vec_id AS id, 6 AS n, round(list_sum(list_transform(embedding[1:6], lambda x: x::DOUBLE)), 6) + 0.0 AS total FROM embeddings"),
    "F14_chain_decode": (
        lambda s, d: rnd(X.chain_decode(*chain(s, d), 4).select("id", F.array_join("labels", ">").alias("labels"), "score")),
        "WITH a AS (SELECT l_suppkey AS id, l_returnflag AS a, count(*) / 1000.0::DOUBLE AS s FROM lineitem GROUP BY 1, 2), b AS (SELECT l_suppkey AS id, l_linestatus AS b, count(*) / 1000.0::DOUBLE AS t FROM lineitem GROUP BY 1, 2), al AS (SELECT DISTINCT l_returnflag AS a, l_linestatus AS b FROM lineitem WHERE l_returnflag <> 'R' OR l_linestatus = 'F') SELECT id, a || '>' || b AS labels, round(s * t, 6) AS score FROM a JOIN b USING (id) JOIN al USING (a, b) QUALIFY row_number() OVER (PARTITION BY id ORDER BY s * t DESC, a, b) = 1",
    ),
    "F15_range_of_features": (lambda s, d: rnd(X.range_of_features(vecs(s, d, 0))), "SELECT i::INT - 1 AS index, round(min(embedding[i]::DOUBLE), 6) AS min, round(max(embedding[i]::DOUBLE), 6) AS max FROM embeddings, (SELECT unnest([1, 2, 3]) AS i) GROUP BY 1"),
    "F16_similarity_regressors": (
        lambda s, d: rnd(X.similarity_regressors([li(s, d).groupBy(F.col("l_orderkey").alias("id")).agg(F.avg(c).alias("value")) for c in ("l_tax", "l_discount")] + [table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))], ["tax", "discount", "price"])),
        "SELECT o_orderkey AS id, round(coalesce(t, 0), 6) AS tax, round(coalesce(c, 0), 6) AS discount, round(o_totalprice, 6) AS price FROM orders LEFT JOIN (SELECT l_orderkey, avg(l_tax) AS t, avg(l_discount) AS c FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
    ),
    "E21_regression_ensemble": (
        _ensemble,
        # Two slopes by the normal equations; a constant doesn't change a correlation.
        """WITH x AS (SELECT l_orderkey AS k, sum(l_quantity)::DOUBLE AS q, avg(l_discount)::DOUBLE AS a, sum(l_extendedprice)::DOUBLE AS y FROM lineitem GROUP BY 1), h AS (SELECT quantile_cont(k, 0.5) AS h FROM x),
m AS (SELECT covar_pop(q, y) AS qy, covar_pop(a, y) AS ay, covar_pop(q, a) AS qa, var_pop(q) AS qq, var_pop(a) AS aa FROM x, h WHERE k <= h)
SELECT round(corr((qy * aa - ay * qa) * q + (ay * qq - qy * qa) * a, y), 4) AS r FROM x, h, m WHERE k > h""",
    ),
    "E23_cross_validate": (_cross, "SELECT (('0x' || substr(md5('0:' || l_orderkey), 1, 8))::BIGINT % 2)::INT AS fold, count(*) AS n FROM lineitem GROUP BY 1"),
}
