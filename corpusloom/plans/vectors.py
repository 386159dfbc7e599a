"""Vector composition: words are document tokens, a word's vector counts its letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import corpus as C
from corpusloom.operators import vectors as V
from corpusloom.plans.inputs import PAIRS_SQL, letters, pairs, r6, table, tokens

_W = "list_filter(string_split_regex(lower({}), '[^a-z]+'), lambda w: w <> '')"


def sides(s, d):
    """id, left, right: the words of sentence pairs."""
    p = pairs(s, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), letters(F.col("text_a")).alias("left"), letters(F.col("text_b")).alias("right"))
    return p


def long_sides(s, d):
    p = sides(s, d)
    return p.select("id", F.lit("left").alias("side"), F.explode("left").alias("word")).unionByName(p.select("id", F.lit("right").alias("side"), F.explode("right").alias("word")))


def rules(s, d):
    return long_sides(s, d).withColumn("side", F.when(F.col("side") == "left", "lhs").otherwise("rhs"))


def vectors(s, d):
    """(word, dim, w): how often a letter stands in the word."""
    t = table(s, d, "conversations").select(F.explode(letters(F.col("text"))).alias("word")).distinct()
    return t.select("word", F.explode(F.filter(F.split("word", ""), lambda c: c != "")).alias("dim")).groupBy("word", "dim").agg(F.count("*").cast("double").alias("w"))


def letter_pairs(s, d):
    """(word, dim, w): how often two letters stand next to each other in the word, its ends included."""
    t = table(s, d, "conversations").select(F.explode(letters(F.col("text"))).alias("word")).distinct().withColumn("x", F.concat(F.lit("^"), "word", F.lit("$")))
    pairs_ = t.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("x") - 1), lambda i: F.substring("x", i, F.lit(2)))).alias("dim"))
    return pairs_.groupBy("word", "dim").agg(F.count("*").cast("double").alias("w"))


_BASE = f"""WITH {PAIRS_SQL}, p AS (SELECT conv_id * 100 + turn AS id, {_W.format('text_a')} AS l, {_W.format('text_b')} AS r FROM pairs),
sd AS (SELECT id, 'left' AS side, unnest(l) AS word FROM p UNION ALL SELECT id, 'right', unnest(r) FROM p),
vw AS (SELECT DISTINCT unnest({_W.format('text')}) AS word FROM conversations),
ve AS (SELECT word, dim, count(*)::DOUBLE AS w FROM (SELECT word, unnest(string_split(word, '')) AS dim FROM vw) GROUP BY 1, 2)"""


def _cos(a, b, both="0"):
    return f"""dt AS (SELECT a.id, sum(a.w * b.w) AS dot FROM {a} a JOIN {b} b USING (id, dim) GROUP BY 1), na AS (SELECT id, sqrt(sum(w * w)) AS n FROM {a} GROUP BY 1), nb AS (SELECT id, sqrt(sum(w * w)) AS n FROM {b} GROUP BY 1)
SELECT i.id, round(CASE WHEN na.n IS NULL AND nb.n IS NULL THEN {both} ELSE coalesce(dot / nullif(na.n * nb.n, 0), 0) END, 6) + 0.0 AS score FROM (SELECT DISTINCT id FROM sd) i LEFT JOIN dt USING (id) LEFT JOIN na USING (id) LEFT JOIN nb USING (id)"""


_ADD = ", {n} AS (SELECT id, dim, sum(w) AS w FROM (SELECT DISTINCT id, word FROM sd WHERE side = '{s}') JOIN ve USING (word) GROUP BY 1, 2)"
_ADDALL = ", {n} AS (SELECT id, dim, sum(w) AS w FROM (SELECT id, word FROM sd WHERE side = '{s}') JOIN ve USING (word) GROUP BY 1, 2)"
_LR = _ADD.format(n="ca", s="left") + _ADD.format(n="cb", s="right")


def rnd(df):
    return df.select(*(r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def left(s, d):
    return long_sides(s, d).filter("side = 'left'")


def grams(s, d):
    """Words and word pairs joined by nothing: pairs have vectors if their joined form is a word."""
    from corpusloom.functions.text import word_ngrams

    p = sides(s, d)
    one = p.select("id", F.lit(1).alias("n"), F.explode("left").alias("word"))
    two = p.select("id", F.lit(2).alias("n"), F.explode(word_ngrams(F.col("left"), 2)).alias("word")).withColumn("word", F.replace("word", F.lit(" "), F.lit("")))
    return one.unionByName(two)


def rule_scores(s, d):
    """Scored rules: customers' segments by nation and balance."""
    return table(s, d, "customer").select(F.col("c_nationkey").alias("lhs"), F.col("c_custkey").alias("rhs"), F.round(F.col("c_acctbal") / 1000).alias("score"))


_RS = "rs AS (SELECT c_nationkey AS lhs, c_custkey AS rhs, round(c_acctbal / 1000) AS score FROM customer)"


def idf(s, d):
    return C.idf(table(s, d, "conversations").select(letters(F.col("text")).alias("w")), "w")


_IDF = f", it AS (SELECT conv_id * 100 + turn AS d, unnest({_W.format('text')}) AS token FROM conversations), idf AS (SELECT token, ln((SELECT count(DISTINCT d) FROM it)::DOUBLE / count(DISTINCT d)) AS idf FROM it GROUP BY 1)"
_DIFF = ", df AS (SELECT id, CASE WHEN count(*) FILTER (side = 'left') > count(*) FILTER (side = 'right') THEN 'left' ELSE 'right' END AS side, word, abs(count(*) FILTER (side = 'left') - count(*) FILTER (side = 'right')) AS n FROM sd GROUP BY id, word HAVING n <> 0)"

QUERIES = {
    "S08_restrict_vectors": (lambda s, d: V.restrict(vectors(s, d), table(s, d, "benchmark").select(F.explode(letters(F.col("text"))).alias("word"))), _BASE + f" SELECT word, dim, w FROM ve WHERE word IN (SELECT unnest({_W.format('text')}) FROM benchmark)"),
    "S09_unit_vectors": (lambda s, d: rnd(V.unit(vectors(s, d))), _BASE + " SELECT word, dim, round(w / sqrt(sum(w * w) OVER (PARTITION BY word)), 6) AS w FROM ve"),
    "S10_lookup_or_zero": (
        lambda s, d: rnd(V.lookup_or_zero(table(s, d, "events").select((F.col("event_id") % 900).alias("word"), "event_id"), table(s, d, "embeddings").select(F.col("vec_id").alias("word"), F.transform("embedding", lambda x: x.cast("double")).alias("vec")), 64).select("event_id", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"))),
        "SELECT event_id, round(coalesce(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 0), 6) + 0.0 AS total FROM events LEFT JOIN embeddings ON vec_id = event_id % 900",
    ),
    "M10_idf_best_match": (
        lambda s, d: rnd(V.context_idf_match(left(s, d), long_sides(s, d).filter("side = 'right'"), idf(s, d))),
        _BASE
        + _IDF
        + ", x AS (SELECT DISTINCT id, side, word FROM sd), m AS (SELECT a.id, a.side, sum(CASE WHEN b.word IS NULL THEN 0 ELSE 12 END * coalesce(idf, 0)) / nullif(sum(coalesce(idf, 0)), 0) AS s FROM x a LEFT JOIN x b ON a.id = b.id AND a.word = b.word AND a.side <> b.side LEFT JOIN idf ON token = a.word GROUP BY 1, 2) SELECT id, round(coalesce(sum(s) / 2, 0), 6) + 0.0 AS score FROM m GROUP BY id",
    ),
    "V01_compose_add": (lambda s, d: rnd(V.compose_add(left(s, d), vectors(s, d))), _BASE + _LR + " SELECT id, dim, round(w, 6) AS w FROM ca"),
    "V02_compose_mul": (
        lambda s, d: V.compose_mul(left(s, d), vectors(s, d)).select("id", "dim", r6(F.ln("w")).alias("w")),
        _BASE
        + ", x AS (SELECT DISTINCT id, word FROM sd WHERE side = 'left' AND word IN (SELECT word FROM ve)), k AS (SELECT id, count(*) AS n FROM x GROUP BY 1) SELECT id, dim, round(sum(ln(w)), 6) + 0.0 AS w FROM x JOIN ve USING (word) JOIN k USING (id) GROUP BY id, dim HAVING count(*) = any_value(n)",
    ),
    "V03_compose_ngrams": (
        lambda s, d: rnd(V.compose_ngrams(grams(s, d), vectors(s, d), 0.3)),
        _BASE
        + ", g AS (SELECT id, 1 AS n, unnest(l) AS word FROM p UNION ALL SELECT id, 2, l[i] || l[i + 1] FROM (SELECT id, l, unnest(range(1, len(l))) AS i FROM p)), h AS (SELECT *, max(n) OVER (PARTITION BY id) AS m FROM g) SELECT id, dim, round(sum(w * CASE WHEN n = 1 THEN pow(0.7::DOUBLE, m - 1) ELSE 0.3::DOUBLE * pow(0.7::DOUBLE, m - n) END), 6) AS w FROM h JOIN ve USING (word) GROUP BY 1, 2",
    ),
    "V04_compose_all_words": (
        lambda s, d: rnd(V.pair_cosine(V.compose_add(left(s, d), v := vectors(s, d), distinct=False), V.compose_add(long_sides(s, d).filter("side = 'right'"), v, distinct=False), long_sides(s, d), 1.0)),
        _BASE + _ADDALL.format(n="ca", s="left") + _ADDALL.format(n="cb", s="right") + ", " + _cos("ca", "cb", "1"),
    ),
    "V05_compose_max": (lambda s, d: rnd(V.compose_max(left(s, d), vectors(s, d))), _BASE + " SELECT id, dim, max(w) AS w FROM (SELECT id, word FROM sd WHERE side = 'left') JOIN ve USING (word) GROUP BY 1, 2"),
    "V06_weight_by_word_and_context": (
        lambda s, d: rnd(V.weight_by_word_and_context(rules(s, d), long_sides(s, d).select("id", "word"), vectors(s, d))),
        _BASE
        + _LR
        + ", cc AS (SELECT id, dim, sum(w) AS w FROM (SELECT DISTINCT id, word FROM sd) JOIN ve USING (word) GROUP BY 1, 2), r1 AS (WITH "
        + _cos("ca", "cb").replace("round(", "(").replace(", 6) + 0.0 AS score", ") AS score")
        + "), r2 AS (WITH "
        + _cos("cc", "cb").replace("round(", "(").replace(", 6) + 0.0 AS score", ") AS score")
        + ") SELECT id, round((r1.score + r2.score) / 2, 6) AS score FROM r1 JOIN r2 USING (id)",
    ),
    "V07_weight_rules": (lambda s, d: rnd(V.weight_rules(rules(s, d), vectors(s, d))), _BASE + _LR + ", " + _cos("ca", "cb")),
    "V08_weight_all_word_pairs": (
        lambda s, d: rnd(V.weight_all_word_pairs(rules(s, d), vectors(s, d))),
        _BASE
        + ", u AS (SELECT word, dim, w / sqrt(sum(w * w) OVER (PARTITION BY word)) AS w FROM ve), n AS (SELECT id, side, count(*) AS n FROM sd GROUP BY 1, 2), m AS (SELECT id, side, dim, sum(w) / any_value(n) AS w FROM sd JOIN u USING (word) JOIN n USING (id, side) GROUP BY 1, 2, 3) SELECT i.id, round(coalesce(sum(a.w * b.w), 0), 6) AS score FROM (SELECT DISTINCT id FROM sd) i LEFT JOIN m a ON a.id = i.id AND a.side = 'left' LEFT JOIN m b ON b.id = i.id AND b.side = 'right' AND a.dim = b.dim GROUP BY 1",
    ),
    "V09_same_lemma_hard": (
        lambda s, d: V.same_lemma_hard(rule_scores(s, d).withColumn("weight", F.col("score"))).filter("lhs < 5").select("lhs", "rhs", F.col("weight").cast("string").alias("weight")),
        f"WITH {_RS} SELECT lhs, rhs, CASE WHEN lhs = rhs THEN 'Infinity' WHEN score = 0 THEN '0.0' ELSE score::VARCHAR END AS weight FROM rs WHERE lhs < 5",
    ),
    "V10_weight_by_rank": (lambda s, d: rnd(V.weight_by_rank(rule_scores(s, d)).select("lhs", "rhs", "weight")), f"WITH {_RS}, k AS (SELECT *, 1.0::DOUBLE / rank() OVER (PARTITION BY lhs ORDER BY score DESC) AS i FROM rs) SELECT lhs, rhs, round(i / sum(i) OVER (PARTITION BY lhs), 6) AS weight FROM k"),
    "V11_top_rule": (lambda s, d: V.top_rule(rule_scores(s, d)).select("lhs", "rhs"), f"WITH {_RS} SELECT lhs, rhs FROM rs QUALIFY row_number() OVER (PARTITION BY lhs ORDER BY score DESC, rhs) = 1"),
    "V12_uniform_hard": (lambda s, d: V.uniform_hard(rule_scores(s, d)).select("lhs", "rhs", "weight"), f"WITH {_RS} SELECT lhs, rhs, NULL::DOUBLE AS weight FROM rs"),
    "V13_token_difference": (lambda s, d: V.token_difference(long_sides(s, d)), _BASE + _DIFF + " SELECT id, side, word, n FROM df"),
    "V13_difference_pieces": (
        lambda s, d: V.difference_pieces(sides(s, d)).groupBy("id").agg(F.sum(F.size("left")).alias("l"), F.sum(F.size("right")).alias("r")),
        # What a longest common subsequence leaves: its length by diagonals of the table of prefixes.
        _BASE
        + """, z AS (SELECT id, l, r, len(l) AS n, len(r) AS m FROM p)
SELECT id, (n - c)::BIGINT AS l, (m - c)::BIGINT AS r FROM (
  WITH RECURSIVE w AS (SELECT id, l, r, n, m, 0 AS k, list_transform(range(n + 1), lambda i: 0) AS two, list_transform(range(n + 1), lambda i: 0) AS one FROM z
    UNION ALL SELECT id, l, r, n, m, k + 1, one, list_transform(range(n + 1), lambda i: CASE WHEN i < 1 OR k + 1 - i < 1 OR k + 1 - i > m THEN 0 WHEN l[i] = r[k + 1 - i] THEN two[i] + 1 ELSE greatest(one[i], one[i + 1]) END) FROM w WHERE k < n + m)
  SELECT id, n, m, one[n + 1] AS c FROM w WHERE k = n + m) WHERE n > c OR m > c""",
    ),
    "V14_difference_cosine": (
        lambda s, d: rnd(V.difference_cosine(long_sides(s, d), vectors(s, d))),
        _BASE + _DIFF + ", ca AS (SELECT id, dim, sum(w * n) AS w FROM df JOIN ve USING (word) WHERE side = 'left' GROUP BY 1, 2), cb AS (SELECT id, dim, sum(w * n) AS w FROM df JOIN ve USING (word) WHERE side = 'right' GROUP BY 1, 2), " + _cos("ca", "cb", "1"),
    ),
    "V15_keyword_counts": (
        lambda s, d: V.keyword_counts(sides(s, d)),
        _BASE + " SELECT id, " + ", ".join(f"len(list_filter(list_concat(l, r), lambda t: t = '{k}'))::INT AS n_{k}" for k in V.KEYWORDS) + " FROM p",
    ),
}
