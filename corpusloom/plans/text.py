"""Text and similarity functions over documents, sentence pairs and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import logic as L
from corpusloom.functions import similarity as M
from corpusloom.functions import text as X
from corpusloom.operators.corpus import lemmatize
from corpusloom.operators.rules import polarity_lookup
from corpusloom.plans.inputs import PAIRS_SQL, WORDS_SQL, letters, pairs, r6, table



def docs(s, d):
    return table(s, d, "documents").select("doc_id", "lang", "source", "text")


def toks(s, d):
    return docs(s, d).select("doc_id", letters(F.col("text")).alias("w"))


_TOKS = f"t AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents)"
_SPLIT = "list_filter(string_split_regex({}, '\\s+'), lambda x: x <> '')"


def words_table(s, d):
    return docs(s, d).select(F.explode(letters(F.col("text"))).alias("word")).distinct()


_WT = f"wt AS (SELECT DISTINCT unnest({WORDS_SQL}) AS word FROM documents)"


def x6(s, d):
    exceptions = words_table(s, d).filter("length(word) = 4").select(F.col("word").alias("form"), F.substring("word", 1, 3).alias("lemma"))
    tok = docs(s, d).select("doc_id", F.posexplode(letters(F.col("text"))).alias("place", "token"))
    return lemmatize(tok, exceptions).groupBy("lemma").agg(F.count("*").alias("n"))


_X6 = f"""WITH {_WT}, {_TOKS}, tok AS (SELECT unnest(w) AS token FROM t),
l AS (SELECT CASE WHEN length(token) = 4 THEN substr(token, 1, 3) WHEN token LIKE '%sses' THEN left(token, -2) WHEN token LIKE '%ies' AND length(token) > 4 THEN left(token, -3) || 'y' WHEN token LIKE '%ing' AND length(token) > 5 THEN left(token, -3)
  WHEN token LIKE '%ed' AND length(token) > 4 THEN left(token, -2) WHEN token LIKE '%s' AND token NOT LIKE '%ss' AND length(token) > 3 THEN left(token, -1) ELSE token END AS lemma FROM tok)
SELECT lemma, count(*) AS n FROM l GROUP BY lemma"""


def vecs(s, d):
    e = table(s, d, "embeddings")
    a = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("b"))
    return a.join(b, "id")


_V = "v AS (SELECT x.vec_id AS id, list_transform(x.embedding, lambda z: z::DOUBLE) AS a, list_transform(y.embedding, lambda z: z::DOUBLE) AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)"


def sp(s, d):
    return pairs(s, d).select("conv_id", "turn", F.col("text_a").alias("a"), F.col("text_b").alias("b"))


_SP = f"{PAIRS_SQL}, p AS (SELECT conv_id, turn, text_a AS a, text_b AS b FROM pairs)"
_JAC = "coalesce(len(list_intersect({0}, {1}))::DOUBLE / nullif(len(list_distinct(list_concat({0}, {1}))), 0), 0)"
_SIMPLE = "replace(replace(replace(replace(text, '.', ' . '), ',', ' , '), 'n''t', ' n''t'), '''s', ' ''s')"
_CHARS = "list_distinct(string_split({0}, ''))"
_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"


def m4(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", F.concat_ws(":", "l_linenumber", F.col("l_quantity").cast("int")).alias("p"))
    v = li.groupBy("l_orderkey").agg(F.max_by("p", F.col("p")).alias("p1"), F.min_by("p", F.col("p")).alias("p2"))
    v = v.select("l_orderkey", F.concat_ws(" ", "p1", F.lit("90:3")).alias("a"), F.concat_ws(" ", "p2", F.lit("90:3")).alias("b"))
    return v.select("l_orderkey", r6(M.sparse_cosine(M.sparse_vector(F.col("a")), M.sparse_vector(F.col("b")))).alias("sim"))


_M4 = """WITH v AS (SELECT l_orderkey, max(l_linenumber || ':' || l_quantity::INT) AS p1, min(l_linenumber || ':' || l_quantity::INT) AS p2 FROM lineitem GROUP BY 1),
k AS (SELECT l_orderkey, split_part(p1, ':', 1) AS i, split_part(p1, ':', 2)::DOUBLE AS x, split_part(p2, ':', 1) AS j, split_part(p2, ':', 2)::DOUBLE AS y FROM v),
c AS (SELECT l_orderkey, (9 + CASE WHEN i = j THEN x * y ELSE 0 END) / (sqrt(x * x + 9) * sqrt(y * y + 9)) AS c FROM k)
SELECT l_orderkey, round(CASE WHEN c > 0.4 THEN c ELSE 0 END, 6) AS sim FROM c"""


def m11(s, d):
    w = {"syn": ([0.5] * 64, [1.0] * 64, 0.1), "hyper": ([-0.3] * 64, [0.2] * 64, 0.0), "mero": ([0.1] * 64, [-0.4] * 64, -0.2), "none": ([0.0] * 64, [0.3] * 64, 0.4)}
    return vecs(s, d).select("id", r6(M.entailment_probability(F.col("a"), F.col("b"), w)).alias("p"))


_M11 = f"""WITH {_V}, u AS (SELECT id, list_transform(range(1, 65), lambda i: a[i] / sqrt(list_sum(list_transform(a, lambda x: x * x))) - b[i] / sqrt(list_sum(list_transform(b, lambda x: x * x)))) AS d FROM v),
z AS (SELECT id, list_sum(d) AS l, list_sum(list_transform(d, lambda x: x * x)) AS q FROM u),
r AS (SELECT id, 1 / (1 + exp(-(0.5 * l + q + 0.1))) AS s1, 1 / (1 + exp(-(-0.3 * l + 0.2 * q))) AS s2, 1 / (1 + exp(-(0.1 * l - 0.4 * q - 0.2))) AS s3, 1 / (1 + exp(-(0.3 * q + 0.4))) AS s4 FROM z)
SELECT id, round((s1 + s2 + s3) / (s1 + s2 + s3 + s4), 6) AS p FROM r"""

_DISC = "l_discount * 5"


def li(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", L.clamp(F.col("l_discount") * 5).alias("p"), L.clamp(F.col("l_tax") * 10).alias("q"))


_LI = "x AS (SELECT l_orderkey, l_linenumber, least(1, greatest(0, l_discount * 5)) AS p, least(1, greatest(0, l_tax * 10)) AS q FROM lineitem)"

QUERIES = {
    "X01_tokenize_simple": (
        lambda s, d: docs(s, d).select("doc_id", X.tokenize_simple(F.col("text")).alias("tokens")).select("doc_id", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("h")),
        f"WITH t AS (SELECT doc_id, {_SPLIT.format(_SIMPLE)} AS w FROM documents) SELECT doc_id, len(w)::INT AS n, md5(array_to_string(w, ' ')) AS h FROM t",
    ),
    "X02_tokenize_punct": (
        lambda s, d: docs(s, d).select("doc_id", X.tokenize_punct(F.col("text")).alias("tokens")).select("doc_id", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("h")),
        "WITH t AS (SELECT doc_id, " + _SPLIT.format("regexp_replace(text, '([?!()\";|\\[\\].,''])', ' \\1 ', 'g')") + " AS w FROM documents) SELECT doc_id, len(w)::INT AS n, md5(array_to_string(w, ' ')) AS h FROM t",
    ),
    "X03_tokenize_language": (
        lambda s, d: docs(s, d).filter("lang = 'de'").select("doc_id", X.tokenize_language(F.col("lang"), F.col("text")).alias("tokens")).select("doc_id", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("h")),
        "WITH t AS (SELECT doc_id, " + _SPLIT.format("regexp_replace(text, '([.,;:!?()\"])', ' \\1 ', 'g')") + " AS w FROM documents WHERE lang = 'de') SELECT doc_id, len(w)::INT AS n, md5(array_to_string(w, ' ')) AS h FROM t",
    ),
    "X04_filter_stopwords": (
        lambda s, d: toks(s, d).select("doc_id", F.size(X.filter_stopwords(F.col("w"))).alias("n")),
        f"WITH {_TOKS} SELECT doc_id, len(list_filter(w, lambda x: NOT list_contains({_STOP}, x)))::INT AS n FROM t",
    ),
    "X05_clean_query": (lambda s, d: toks(s, d).select("doc_id", F.size(X.clean_query(F.col("w"), ["the", "of"])).alias("n")), f"WITH {_TOKS} SELECT doc_id, len(list_distinct(list_filter(w, lambda x: length(x) > 1 AND x NOT IN ('the', 'of'))))::INT AS n FROM t"),
    "X06_lemmatize": (x6, _X6),
    "X07_word_pos_index": (
        lambda s, d: table(s, d, "part").select("p_partkey", X.word_pos_index(F.concat_ws("-", "p_brand", "p_type", "p_size")).alias("x")).select("p_partkey", "x.word", "x.pos", "x.index"),
        "SELECT p_partkey, p_brand AS word, p_type AS pos, p_size AS index FROM part",
    ),
    "X08_clean_name": (
        lambda s, d: docs(s, d).select("doc_id", F.md5(X.clean_name(F.col("text")).cast("binary")).alias("h")),
        "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[''\"]', ' ', 'g'), '[^A-Za-z0-9_ ]', '_', 'g')) AS h FROM documents",
    ),
    "X09_strip_transparent_nouns": (
        lambda s, d: table(s, d, "part").select("p_partkey", X.strip_transparent_nouns(F.concat(F.lit("a piece of "), F.col("p_name"), F.lit(" can of paint"))).alias("t")),
        "SELECT p_partkey, 'a ' || p_name || ' paint' AS t FROM part",
    ),
    "X10_contains_phrase": (
        lambda s, d: pairs(s, d).select("conv_id", "turn", X.contains_phrase(F.col("text_b"), F.lit("the thti")).alias("a"), X.contains_phrase(F.col("text_b"), F.lit("the")).alias("b")),
        f"WITH {PAIRS_SQL}, q AS (SELECT *, '#' || array_to_string({_SPLIT.format('text_b')}, '#') || '#' AS f FROM pairs) SELECT conv_id, turn, contains(f, '#the#thti#') AS a, contains(f, '#the#') AS b FROM q",
    ),
    "X11_is_intelligible": (lambda s, d: docs(s, d).select("doc_id", X.is_intelligible(F.col("text")).alias("ok")), "SELECT doc_id, regexp_full_match(text, '[\\x00-\\x7F]*') AND len(" + _SPLIT.format("text") + ") >= 3 AS ok FROM documents"),
    "X12_word_ngrams": (
        lambda s, d: toks(s, d).select(F.explode(X.word_ngrams(F.col("w"), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"),
        f"WITH {_TOKS}, g AS (SELECT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM t)) SELECT gram, count(*) AS n FROM g GROUP BY gram HAVING n > 1",
    ),
    "X13_char_trigrams": (
        lambda s, d: words_table(s, d).select("word", F.array_join(X.char_trigrams(F.col("word"), compat=True), "|").alias("g")),
        f"WITH {_WT} SELECT word, array_to_string(list_transform(range(2, greatest(3, length(word)) + 1), lambda e: substr(word, greatest(1, e - 2), least(3, e))), '|') AS g FROM wt",
    ),
    "X14_affixes": (
        lambda s, d: words_table(s, d).select("word", X.affixes(F.col("word")).alias("a")).select("word", F.array_join("a.prefixes", "|").alias("p"), F.array_join("a.suffixes", "|").alias("q")),
        f"WITH {_WT} SELECT word, array_to_string(list_transform(range(1, least(4, length(word)) + 1), lambda n: left(word, n)), '|') AS p, array_to_string(list_transform(range(1, least(4, length(word)) + 1), lambda n: right(word, n)), '|') AS q FROM wt",
    ),
    "X15_shape": (
        lambda s, d: table(s, d, "part").select("p_partkey", X.shape(F.col("p_brand")).alias("x"), X.shape(F.col("p_name")).alias("y")).select("p_partkey", F.col("x.upper").alias("u"), F.col("x.hyphen").alias("h"), F.col("x.digit").alias("g"), F.col("y.upper").alias("v")),
        "SELECT p_partkey, regexp_matches(p_brand, '[A-Z]') AS u, contains(p_brand, '-') AS h, regexp_matches(p_brand, '[0-9]') AS g, regexp_matches(p_name, '[A-Z]') AS v FROM part",
    ),
    "X16_unescape_backslash": (lambda s, d: table(s, d, "events").select("event_id", X.unescape_backslash(F.replace("props", F.lit('"'), F.lit('\\"'))).alias("p")), "SELECT event_id, props AS p FROM events"),
    "X17_expand_annotations": (
        lambda s, d: table(s, d, "part")
        .select("p_partkey", F.explode(X.expand_annotations(F.array(F.concat(F.lit("@"), F.col("p_type"), F.lit("|I-PER")), F.concat("p_brand", F.lit("|O")), F.col("p_type")))).alias("x"))
        .select("p_partkey", "x.*"),
        "SELECT p_partkey, '@' || p_type AS word, 'I-PER' AS tag, true AS placeholder FROM part UNION ALL SELECT p_partkey, p_brand, 'O', false FROM part UNION ALL SELECT p_partkey, p_type, 'O', false FROM part",
    ),
    "X18_logistic_log_odds": (
        lambda s, d: li(s, d).select("l_orderkey", "l_linenumber", r6(L.logistic(F.col("p"))).alias("a"), r6(L.log_odds(F.col("p"))).alias("b")),
        f"WITH {_LI} SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-p)), 6) AS a, round(ln(least(1 - 1e-9, greatest(1e-9, p)) / (1 - least(1 - 1e-9, greatest(1e-9, p)))), 6) + 0.0 AS b FROM x",
    ),
    "X19_tnorms": (
        lambda s, d: li(s, d).select(
            "l_orderkey",
            "l_linenumber",
            *(r6(f(F.col("p"), F.col("q"))).alias(n) for n, f in (("la", L.luk_and), ("lo", L.luk_or), ("ga", L.goedel_and), ("go", L.goedel_or), ("pa", L.product_and), ("po", L.product_or))),
            r6(L.negation(F.col("p"))).alias("n"),
            r6(L.luk_all(F.array("p", "q"))).alias("all2"),
        ),
        f"WITH {_LI} SELECT l_orderkey, l_linenumber, round(greatest(0, p + q - 1), 6) AS la, round(least(1, p + q), 6) AS lo, round(least(p, q), 6) AS ga, round(greatest(p, q), 6) AS go, round(p * q, 6) AS pa, round(1 - (1 - p) * (1 - q), 6) AS po, round(1 - p, 6) AS n, round(greatest(0, p + q - 1), 6) AS all2 FROM x",
    ),
    "X20_log_space": (
        lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.ln("l_quantity")).alias("v")).select("l_orderkey", r6(L.log_sum_exp(F.col("v"))).alias("s"), r6(L.log_add(F.array_max("v"), F.array_min("v"))).alias("t")),
        "SELECT l_orderkey, round(ln(sum(l_quantity)), 6) AS s, round(ln(max(l_quantity) + min(l_quantity)), 6) AS t FROM lineitem GROUP BY 1",
    ),
    "X21_polarity_lookup": (
        lambda s, d: polarity_lookup(
            table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("lemma"), F.lit("n").alias("pos"), F.array(F.lower("p_brand"), F.col("p_name")).alias("relations")),
            table(s, d, "part").select(F.col("p_type").alias("lemma"), F.lit("n").alias("pos"), F.array(F.lit("brand#1")).alias("required"), F.lit("+/-").alias("signature")).distinct(),
        ),
        "SELECT p_partkey AS id, p_type AS lemma, 'n' AS pos, CASE WHEN lower(p_brand) LIKE 'brand#1%' THEN '+' END AS positive, CASE WHEN lower(p_brand) LIKE 'brand#1%' THEN '-' END AS negative FROM part",
    ),
    # SQL's levenshtein counts bytes.
    "M01_edit_distance": (lambda s, d: pairs(s, d).select("conv_id", "turn", M.edit_distance(F.col("text_a"), F.col("text_b")).alias("n")), None),
    "M02_levenshtein_sim": (lambda s, d: pairs(s, d).select("conv_id", "turn", r6(M.levenshtein_sim(F.col("text_a"), F.col("text_b"), 0.2)).alias("v")), None),
    "M03_substring_sim": (
        lambda s, d: pairs(s, d).select("conv_id", "turn", r6(M.substring_sim(F.col("text_a"), F.col("text_b"))).alias("v")),
        f"WITH {PAIRS_SQL}, q AS (SELECT conv_id, turn, lower(text_a) AS x, lower(text_b) AS y FROM pairs), z AS (SELECT conv_id, turn, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS a, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS b FROM q) SELECT conv_id, turn, round(CASE WHEN contains(b, a) THEN length(a)::DOUBLE / length(b) ELSE 0 END, 6) AS v FROM z",
    ),
    "M04_sparse_cosine": (m4, _M4),
    "M05_charset_sim": (
        lambda s, d: sp(s, d).select("conv_id", "turn", r6(M.charset_sim(F.col("a"), F.col("b"))).alias("v")),
        f"WITH {_SP}, q AS (SELECT conv_id, turn, a, b, least(0.99, {_JAC.format(_CHARS.format('a'), _CHARS.format('b'))}) AS v FROM p) SELECT conv_id, turn, round(CASE WHEN length(a) >= 5 AND length(b) >= 5 AND v > 0.5 THEN v ELSE 0 END, 6) AS v FROM q",
    ),
    "M06_ngram_jaccard": (
        lambda s, d: pairs(s, d).select("conv_id", "turn", letters(F.col("text_a")).alias("a"), letters(F.col("text_b")).alias("b")).select("conv_id", "turn", *(r6(M.ngram_jaccard(F.col("a"), F.col("b"), n)).alias(f"j{n}") for n in (1, 2))),
        f"WITH {PAIRS_SQL}, q AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text_a), '[^a-z]+'), lambda x: x <> '' AND NOT list_contains({_STOP}, x)) AS a, list_filter(string_split_regex(lower(text_b), '[^a-z]+'), lambda x: x <> '' AND NOT list_contains({_STOP}, x)) AS b FROM pairs), "
        f"g AS (SELECT *, list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]) AS a2, list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1]) AS b2 FROM q) SELECT conv_id, turn, round({_JAC.format('list_distinct(a)', 'list_distinct(b)')}, 6) AS j1, round({_JAC.format('list_distinct(a2)', 'list_distinct(b2)')}, 6) AS j2 FROM g",
    ),
    "M07_norm_cosine_euclid": (
        lambda s, d: vecs(s, d).select("id", r6(M.norm2(F.col("a"))).alias("n"), r6(M.cosine(F.col("a"), F.col("b"))).alias("c"), r6(M.euclid(F.col("a"), F.col("b"))).alias("e"), r6(M.norm2(M.normalise(F.col("a")))).alias("u")),
        f"WITH {_V} SELECT id, round(sqrt(list_sum(list_transform(a, lambda x: x * x))), 6) AS n, round(list_cosine_similarity(a, b), 6) + 0.0 AS c, round(list_distance(a, b), 6) AS e, 1.0::DOUBLE AS u FROM v",
    ),
    "M08_positive_cosine": (
        lambda s, d: vecs(s, d).select("id", r6(M.positive_cosine(F.col("a"), F.col("b"))).alias("c")),
        f"WITH {_V} SELECT id, round(list_sum(list_transform(range(1, 65), lambda i: greatest(0, a[i] * b[i]))) / sqrt(list_sum(list_transform(a, lambda x: x * x)) * list_sum(list_transform(b, lambda x: x * x))), 6) AS c FROM v",
    ),
    "M09_cosine_nan": (
        lambda s, d: vecs(s, d).select("id", r6(M.cosine_nan(F.when(F.col("id") % 10 == 0, F.transform("a", lambda x: x * 0)).otherwise(F.col("a")), F.col("b"))).alias("c")),
        f"WITH {_V} SELECT id, CASE WHEN id % 10 = 0 THEN -1 ELSE round(list_cosine_similarity(a, b), 6) + 0.0 END AS c FROM v",
    ),
    "M11_entailment_probability": (m11, _M11),
    "M12_functional_predicates": (
        lambda s, d: (n := table(s, d, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("r"))).join(n.select(F.col("a").alias("b"), "r"), "r").filter(L.functional("non_symmetric", F.col("a"), F.col("b"))).select("a", "b"),
        "SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y USING (n_regionkey) WHERE x.n_nationkey < y.n_nationkey",
    ),
}
