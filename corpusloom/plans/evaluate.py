"""Evaluation queries: scores from discounts and quantities, gold from flags and labels."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators import evaluate as E
from corpusloom.operators import ordered as O
from corpusloom.plans.inputs import r6, table


def rnd(df):
    """All double columns rounded."""
    return df.select(*(r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def scored(s, d):
    """id, score (negative: error), gold in 0, 0.5, 1."""
    li = table(s, d, "lineitem")
    gold = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "R", 0.5).otherwise(0.0)
    return li.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 7, -1.0).otherwise(F.round(F.col("l_quantity") / 50, 6)).alias("score"), gold.alias("gold"))


_SC = "sc AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN -1.0 ELSE round(l_quantity / 50, 6) END AS score, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 0.5 ELSE 0.0 END AS gold FROM lineitem)"


def classed(s, d):
    return table(s, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("gold"), F.when(F.col("l_discount") < 0.03, "A").when(F.col("l_discount") < 0.06, "N").otherwise("R").alias("pred"))


_CL = "cl AS (SELECT l_orderkey, l_returnflag AS gold, CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.06 THEN 'N' ELSE 'R' END AS pred FROM lineitem)"


def _sides(s, d):
    o = table(s, d, "orders")
    base = o.filter("o_orderkey % 3 <> 0").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("value"))
    got = o.filter("o_orderkey % 4 <> 0").select("o_orderkey", F.when(F.col("o_totalprice") > 200000, 1.0).otherwise(0.25).alias("value"))
    return got, base


_SD = "ba AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS g FROM orders WHERE o_orderkey % 3 <> 0), re AS (SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.25 END AS v FROM orders WHERE o_orderkey % 4 <> 0)"
_CNT = "count(*) FILTER (coalesce(g, 0) >= 0.5 AND coalesce(v, 0) >= 0.5) AS tp, count(*) FILTER (coalesce(g, 0) < 0.5 AND coalesce(v, 0) >= 0.5) AS fp, count(*) FILTER (coalesce(g, 0) < 0.5 AND coalesce(v, 0) < 0.5) AS tn, count(*) FILTER (coalesce(g, 0) >= 0.5 AND coalesce(v, 0) < 0.5) AS fn"


def ranked(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))


def tags(s, d):
    """Tags from line items: an order is a sentence."""
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("sent"), "l_quantity", "l_tax", "l_discount", "l_returnflag", "l_extendedprice", "l_linenumber", "l_partkey")
    pos = F.row_number().over(W.partitionBy("sent").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_tax", "l_discount")) - 1
    mark = lambda c, kind: F.when(c < 0.02, "O").when(c < 0.045, F.concat(F.lit("B-"), kind)).otherwise(F.concat(F.lit("I-"), kind))
    return li.select("sent", pos.alias("pos"), mark(F.col("l_discount"), F.col("l_returnflag")).alias("gold"), mark(F.when(F.col("l_tax") > 0.06, 0.0).otherwise(F.col("l_discount")), F.col("l_returnflag")).alias("pred"))


_TG = """tg AS (SELECT l_orderkey AS sent, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity, l_tax, l_discount) - 1 AS pos,
  CASE WHEN l_discount < 0.02 THEN 'O' WHEN l_discount < 0.045 THEN 'B-' || l_returnflag ELSE 'I-' || l_returnflag END AS gold,
  CASE WHEN l_tax > 0.06 OR l_discount < 0.02 THEN 'O' WHEN l_discount < 0.045 THEN 'B-' || l_returnflag ELSE 'I-' || l_returnflag END AS pred FROM lineitem)"""


def _chunks_sql(column, name):
    return f"""{name}0 AS (SELECT sent, pos, split_part({column}, '-', 1) AS k, split_part({column}, '-', 2) AS type FROM tg),
{name}1 AS (SELECT *, coalesce(lag(k) OVER w, 'O') AS k0, coalesce(lag(type) OVER w, '') AS t0 FROM {name}0 WINDOW w AS (PARTITION BY sent ORDER BY pos)),
{name}2 AS (SELECT *, sum((k = 'B' OR k0 IN ('O', 'E') OR type <> t0)::INT) OVER (PARTITION BY sent ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c FROM {name}1 WHERE k <> 'O'),
{name} AS (SELECT sent, min(pos) AS a, max(pos) AS b, arg_min(type, pos) AS type FROM {name}2 GROUP BY sent, c)"""


_PRF = "coalesce(correct::DOUBLE / nullif(guessed, 0), 0) AS precision, coalesce(correct::DOUBLE / nullif(gold, 0), 0) AS recall, coalesce(2.0 * correct / nullif(gold + guessed, 0), 0) AS f1"
_PRF6 = "round(coalesce(correct::DOUBLE / nullif(guessed, 0), 0), 6) AS precision, round(coalesce(correct::DOUBLE / nullif(gold, 0), 0), 6) AS recall, round(coalesce(2.0::DOUBLE * correct / nullif(gold + guessed, 0), 0), 6) AS f1"


def deps(s, d):
    li = table(s, d, "lineitem")
    row = li.select(F.col("l_orderkey").alias("sent"), F.col("l_returnflag").alias("rel"), F.col("l_linenumber").alias("slot"), F.col("l_suppkey").alias("arg"), "l_tax", "l_discount")
    gold = row.filter("l_tax > 0.02").select("sent", "rel", "slot", "arg")
    pred = row.filter("l_discount > 0.02").select("sent", "rel", "slot", "arg")
    return gold, pred, row.filter("slot = 1").select("slot").distinct()


_DP = "go AS (SELECT DISTINCT l_orderkey AS sent, l_returnflag AS rel, l_linenumber AS slot, l_suppkey AS arg, 1 AS g FROM lineitem WHERE l_tax > 0.02 AND l_linenumber <> 1), pr AS (SELECT DISTINCT l_orderkey AS sent, l_returnflag AS rel, l_linenumber AS slot, l_suppkey AS arg, 1 AS p FROM lineitem WHERE l_discount > 0.02 AND l_linenumber <> 1), bo AS (SELECT * FROM go FULL JOIN pr USING (sent, rel, slot, arg))"


def sentences(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("sent")).agg(F.avg("l_discount").alias("a"), F.avg(F.col("l_tax") * 1.25).alias("b"))


def _kbest(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_suppkey").alias("gold"), F.collect_set(F.when(F.col("l_discount") > 0.03, F.col("l_suppkey"))).alias("candidates"))


def _sweep(s, d):
    x = scored(s, d)
    return E.threshold_sweep(x.filter("l_orderkey % 2 = 0"), x.filter("l_orderkey % 2 = 1"))


_SW = f"""WITH {_SC}, th AS (SELECT range AS t, 0.2::DOUBLE + range * 0.001::DOUBLE AS threshold FROM range(301)),
z AS (SELECT l_orderkey % 2 AS h, CASE WHEN score < 0.2 THEN -1 ELSE least(300, floor((score::DOUBLE - 0.2::DOUBLE) / 0.001::DOUBLE + 1e-9)) END AS c, gold >= 0.5 AS pos FROM sc WHERE score >= 0),
a AS (SELECT t, any_value(threshold) AS threshold, avg(((c >= t) = pos)::INT) FILTER (h = 0) AS tr, avg(((c >= t) = pos)::INT) FILTER (h = 1) AS te FROM th, z GROUP BY t)
SELECT round(threshold, 6) AS threshold, round(tr, 6) AS train_accuracy, round(te, 6) AS test_accuracy, (SELECT round(avg((score >= 0)::INT), 6) FROM sc WHERE l_orderkey % 2 = 1) AS coverage FROM a ORDER BY tr DESC, t LIMIT 1"""


def _methods(s, d):
    return classed(s, d).select(F.concat(F.lit("m"), (F.col("l_orderkey") % 4).cast("string")).alias("method"), "gold", "pred")


def _quant(s, d):
    li = table(s, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("group"), F.col("l_quantity").alias("weight"), (F.col("l_suppkey") % 13).cast("double").alias("gold"))


def _clf(s, d):
    """Labels against a text rule."""
    docs, lab = table(s, d, "documents"), table(s, d, "labels")
    return docs.join(lab, "doc_id").select("doc_id", "quality", "toxic", F.when(F.col("text").rlike("clown|moron"), 1).otherwise(0).alias("p_toxic"), F.when(F.length("text") > 300, 1).otherwise(0).alias("p_quality"))


QUERIES = {
    "E01_rmse": (lambda s, d: rnd(E.rmse(scored(s, d))), f"WITH {_SC} SELECT round(sqrt(avg(pow((score - gold)::DOUBLE, 2))), 6) AS rmse FROM sc WHERE score >= 0"),
    "E02_nearest_gold_accuracy": (
        lambda s, d: rnd(E.nearest_gold_accuracy(scored(s, d))),
        f"WITH {_SC}, n AS (SELECT score, gold, CASE WHEN abs(score::DOUBLE) <= abs(score::DOUBLE - 0.5) AND abs(score::DOUBLE) <= abs(score::DOUBLE - 1) THEN 0 WHEN abs(score::DOUBLE - 0.5) <= abs(score::DOUBLE - 1) THEN 0.5 ELSE 1 END AS near FROM sc) SELECT round(avg((near = gold)::INT) FILTER (score >= 0), 6) AS accuracy, count(*) FILTER (score < 0) AS errors FROM n",
    ),
    "E03_confusion": (lambda s, d: E.confusion(classed(s, d)), f"WITH {_CL} SELECT gold, pred, count(*) AS n FROM cl GROUP BY 1, 2"),
    "E03_one_vs_rest": (
        lambda s, d: rnd(E.one_vs_rest(classed(s, d))),
        f"WITH {_CL}, x AS (SELECT c AS class, count(*) FILTER (gold = c AND pred = c) AS tp, count(*) FILTER (gold <> c AND pred = c) AS fp, count(*) FILTER (gold = c AND pred <> c) AS fn FROM cl, (SELECT DISTINCT gold AS c FROM cl) GROUP BY c) SELECT class, tp, fp, fn, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM x",
    ),
    "E04_confusion_counts": (lambda s, d: E.confusion_counts(*_sides(s, d), "o_orderkey"), f"WITH {_SD} SELECT {_CNT} FROM ba LEFT JOIN re USING (o_orderkey)"),
    "E05_confusion_counts_bounded": (lambda s, d: E.confusion_counts_bounded(*_sides(s, d), "o_orderkey", 1_000_000), f"WITH {_SD}, c AS (SELECT {_CNT} FROM ba FULL JOIN re USING (o_orderkey)) SELECT tp, fp, 1000000 - tp - fp - fn AS tn, fn FROM c"),
    "E06_class_scores": (
        lambda s, d: rnd(E.class_scores(E.confusion_counts(*_sides(s, d), "o_orderkey"))),
        f"WITH {_SD}, c AS (SELECT {_CNT} FROM ba LEFT JOIN re USING (o_orderkey)) SELECT round(tp::DOUBLE / (tp + fp), 6) AS precision_positive, round(tp::DOUBLE / (tp + fn), 6) AS recall_positive, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1_positive, round(tn::DOUBLE / (tn + fn), 6) AS precision_negative, round(tn::DOUBLE / (tn + fp), 6) AS recall_negative, round(2.0::DOUBLE * tn / (2 * tn + fp + fn), 6) AS f1_negative, round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 6) AS accuracy FROM c",
    ),
    "E07_list_errors": (
        lambda s, d: rnd(E.list_errors(*_sides(s, d), "o_orderkey")),
        f"WITH {_SD}, b AS (SELECT o_orderkey, g, coalesce(v, 0) AS v FROM ba LEFT JOIN re USING (o_orderkey)) SELECT o_orderkey, CASE WHEN v >= 0.5 THEN 'false positive' ELSE 'false negative' END AS kind, round((v - g)::DOUBLE, 6) AS difference FROM b WHERE (v >= 0.5) <> (g >= 0.5)",
    ),
    "E08_values_agree": (
        lambda s, d: table(s, d, "lineitem").select(
            "l_orderkey", "l_linenumber",
            E.values_agree(F.col("l_discount"), F.col("l_tax"), "threshold", 0.045).alias("t"),
            E.values_agree(F.col("l_discount"), F.col("l_tax"), "absolute", 0.0251).alias("a"),
            E.values_agree(F.array("l_discount", "l_tax"), F.array("l_tax", F.lit(0.0)), "manhattan", 0.0551).alias("m"),
            E.values_agree(F.array("l_discount", "l_tax"), F.array("l_tax", F.lit(0.0)), "euclidean", 0.0451).alias("e"),
        ),
        "SELECT l_orderkey, l_linenumber, (l_discount >= 0.045) = (l_tax >= 0.045) AS t, abs(l_discount - l_tax) <= 0.0251 AS a, abs(l_discount - l_tax) + l_tax <= 0.0551 AS m, sqrt(pow(l_discount - l_tax, 2) + l_tax * l_tax) <= 0.0451 AS e FROM lineitem",
    ),
    "E09_kendall": (
        lambda s, d: rnd(O.kendall(ranked(s, d), "g")),
        "WITH x AS (SELECT l_orderkey AS g, l_quantity AS a, l_extendedprice AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_extendedprice) AS i FROM lineitem) SELECT x.g, round(avg(sign((y.a - x.a) * (y.b - x.b))), 6) + 0.0 AS tau FROM x JOIN x y ON x.g = y.g AND x.i < y.i GROUP BY 1",
    ),
    "E09_spearman": (
        lambda s, d: rnd(E.spearman(ranked(s, d).withColumn("g", F.col("g") % 50), "g")),
        "WITH x AS (SELECT l_orderkey % 50 AS g, l_quantity AS a, l_extendedprice AS b FROM lineitem), r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY g ORDER BY b) + (count(*) OVER (PARTITION BY g, b) - 1) / 2.0::DOUBLE AS rb FROM x) SELECT g, round(corr(ra, rb), 6) + 0.0 AS rho FROM r GROUP BY g",
    ),
    "E10_best_by": (lambda s, d: E.best_by(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey"), "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1"),
    "E10_outside_bounds": (lambda s, d: E.within_bounds(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 1e5, 3e5, inside=False), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice NOT BETWEEN 1e5 AND 3e5"),
    "E11_threshold_sweep": (lambda s, d: rnd(_sweep(s, d)), _SW),
    "E12_confidence_weighted_score": (
        lambda s, d: rnd(E.confidence_weighted_score(table(s, d, "orders").select((F.col("o_custkey") % 40).alias("g"), "o_orderkey", (F.col("o_totalprice") - 200000).alias("margin"), (F.col("o_orderstatus") == "F").alias("correct")), "g", "o_orderkey")),
        "WITH x AS (SELECT o_custkey % 40 AS g, sum((o_orderstatus = 'F')::INT) OVER w / row_number() OVER w AS p FROM orders WINDOW w AS (PARTITION BY o_custkey % 40 ORDER BY abs(o_totalprice - 200000) DESC, o_orderkey ROWS UNBOUNDED PRECEDING)) SELECT g, round(avg(p), 6) AS score FROM x GROUP BY g",
    ),
    "E13_chunk_eval": (
        lambda s, d: rnd(E.chunk_eval(tags(s, d))),
        f"WITH {_TG}, {_chunks_sql('gold', 'cg')}, {_chunks_sql('pred', 'cp')}, j AS (SELECT sent, a, b, type, g, p FROM (SELECT *, 1 AS g FROM cg) FULL JOIN (SELECT *, 1 AS p FROM cp) USING (sent, a, b, type)), u AS (SELECT * FROM j UNION ALL SELECT sent, a, b, '', g, p FROM j), c AS (SELECT type, count(g) AS gold, count(p) AS guessed, count(*) FILTER (g = 1 AND p = 1) AS correct FROM u GROUP BY type) SELECT type, gold, guessed, correct, {_PRF6} FROM c",
    ),
    "E14_tag_accuracy": (lambda s, d: rnd(E.tag_accuracy(tags(s, d))), f"WITH {_TG}, b AS (SELECT sent, count(*) FILTER (gold = pred) AS r, count(*) AS n FROM tg GROUP BY 1) SELECT round(sum(r)::DOUBLE / sum(n), 6) AS token_accuracy, round(avg((r = n)::INT), 6) AS sentence_accuracy FROM b"),
    "E15_kbest_oracle": (lambda s, d: rnd(E.kbest_oracle(_kbest(s, d))), "WITH k AS (SELECT max(l_suppkey) AS gold, coalesce(list(DISTINCT l_suppkey) FILTER (l_discount > 0.03), []) AS c FROM lineitem GROUP BY l_orderkey) SELECT round(avg(list_contains(c, gold)::INT), 6) AS oracle, round(avg(len(c)), 6) AS mean_size FROM k"),
    "E16_dependency_scores": (lambda s, d: rnd(E.dependency_scores(*deps(s, d)[:2], ["sent", "rel", "slot", "arg"], "rel", deps(s, d)[2])), f"WITH {_DP}, c AS (SELECT rel, count(g) AS gold, count(p) AS guessed, count(*) FILTER (g = 1 AND p = 1) AS correct FROM bo GROUP BY rel) SELECT rel, gold, guessed, correct, {_PRF6} FROM c"),
    "E16_dependency_scores_unlabelled": (
        lambda s, d: rnd(E.dependency_scores(*deps(s, d)[:2], ["sent", "arg"])),
        "WITH g AS (SELECT DISTINCT l_orderkey AS s, l_suppkey AS a, 1 AS g FROM lineitem WHERE l_tax > 0.02), p AS (SELECT DISTINCT l_orderkey AS s, l_suppkey AS a, 1 AS p FROM lineitem WHERE l_discount > 0.02), c AS (SELECT count(g) AS gold, count(p) AS guessed, count(*) FILTER (g = 1 AND p = 1) AS correct FROM g FULL JOIN p USING (s, a)) SELECT gold, guessed, correct, " + _PRF6 + " FROM c",
    ),
    "E17_distance_buckets": (lambda s, d: E.distance_buckets(table(s, d, "lineitem"), "l_quantity").groupBy("bucket").agg(F.count("*").alias("n")), "SELECT (ceil(l_quantity / 5) * 5)::INT AS bucket, count(*) AS n FROM lineitem GROUP BY 1"),
    "E18_randomisation_test": (
        lambda s, d: rnd(O.randomisation_test(sentences(s, d), 100)),
        # Bit i of a sentence's md5, highest first, is its sign in iteration i.
        """WITH se AS (SELECT l_orderkey AS sent, avg(l_discount) - avg(l_tax * 1.25) AS gap, md5('1:' || l_orderkey || ':0') AS h FROM lineitem GROUP BY 1),
it AS (SELECT i, abs(sum(gap * (2 * ((('0x' || substr(h, i // 4 + 1, 1))::INT >> (3 - i % 4)::INT) & 1) - 1))) AS s FROM se, (SELECT unnest(range(100)) AS i) GROUP BY 1),
ob AS (SELECT abs(sum(gap)) AS difference FROM se)
SELECT round(difference, 6) AS difference, round((count(*) FILTER (s >= difference - 1e-12) + 1) / 101.0::DOUBLE, 6) AS p FROM it, ob GROUP BY difference""",
    ),
    "E09_kendall_large_groups": (
        lambda s, d: rnd(O.kendall(ranked(s, d).withColumn("g", F.col("g") % 5), "g")),
        # Ranks within a group by the second value; an earlier row with a higher rank is a discordant pair.
        """WITH x AS (SELECT l_orderkey % 5 AS g, l_quantity AS a, l_extendedprice AS b FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY a, b) AS i FROM x),
t AS (SELECT g, count(*)::DOUBLE AS n FROM x GROUP BY 1), ta AS (SELECT g, sum(c * (c - 1) / 2) AS t FROM (SELECT g, count(*)::DOUBLE AS c FROM x GROUP BY g, a) GROUP BY 1),
tb AS (SELECT g, sum(c * (c - 1) / 2) AS t FROM (SELECT g, count(*)::DOUBLE AS c FROM x GROUP BY g, b) GROUP BY 1), tab AS (SELECT g, sum(c * (c - 1) / 2) AS t FROM (SELECT g, count(*)::DOUBLE AS c FROM x GROUP BY g, a, b) GROUP BY 1),
d AS (SELECT p.g, count(*)::DOUBLE AS d FROM o p JOIN o q ON p.g = q.g AND p.i < q.i AND p.b > q.b GROUP BY 1)
SELECT g, round((n * (n - 1) / 2 - ta.t - tb.t + tab.t - 2 * coalesce(d, 0)) / (n * (n - 1) / 2), 6) + 0.0 AS tau FROM t JOIN ta USING (g) JOIN tb USING (g) JOIN tab USING (g) LEFT JOIN d USING (g)""",
    ),
    "E19_accuracy_by_method": (
        lambda s, d: rnd(E.accuracy_by_method(_methods(s, d))),
        f"WITH {_CL} SELECT 'm' || (l_orderkey % 4) AS method, count(*) AS n, round(avg((gold = pred)::INT), 6) AS accuracy FROM cl GROUP BY 1 UNION ALL SELECT 'majority', sum(n)::BIGINT, round(max(n)::DOUBLE / sum(n), 6) FROM (SELECT count(*) AS n FROM cl GROUP BY gold)",
    ),
    "E20_correlation": (lambda s, d: rnd(E.correlation(table(s, d, "lineitem"), "l_quantity", "l_extendedprice")), "SELECT round(corr(l_quantity, l_extendedprice), 6) + 0.0 AS r FROM lineitem"),
    "E22_group_quantile_smoothing": (
        lambda s, d: rnd(E.group_quantile_smoothing(_quant(s, d), [0.25, 0.5, 0.9])),
        "WITH g AS (SELECT l_suppkey, (l_suppkey % 13)::DOUBLE AS gold, unnest([0.25, 0.5, 0.9])::DOUBLE AS q, unnest(quantile_cont(l_quantity, [0.25, 0.5, 0.9])) AS v FROM lineitem GROUP BY l_suppkey) SELECT q, round(corr(v, gold), 6) + 0.0 AS r FROM g GROUP BY q",
    ),
    "E23_folds": (lambda s, d: table(s, d, "orders").select(E.fold_column("o_orderkey", 10).alias("fold")).groupBy("fold").agg(F.count("*").alias("n")), "SELECT (('0x' || substr(md5('0:' || o_orderkey), 1, 8))::BIGINT % 10)::INT AS fold, count(*) AS n FROM orders GROUP BY 1"),
    "E24_joint_label_accuracy": (
        lambda s, d: rnd(E.joint_label_accuracy(_clf(s, d), [("toxic", "p_toxic"), ("quality", "p_quality")])),
        "SELECT round(avg((toxic = regexp_matches(text, 'clown|moron')::INT AND quality = (length(text) > 300)::INT)::INT), 6) AS accuracy FROM documents JOIN labels USING (doc_id)",
    ),
    "E25_average": (lambda s, d: rnd(E.average(table(s, d, "lineitem"), "l_discount")), "SELECT round(avg(l_discount), 6) AS average FROM lineitem"),
}
