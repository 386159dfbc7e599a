"""Corpus counts and keyed helpers over documents, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import corpus as C
from corpusloom.operators import keyed as H
from corpusloom.plans.inputs import TOKENS_SQL, WORDS_SQL, letters, r6, table, tokens

_TK = f"WITH {TOKENS_SQL}"


def tagged(s, d):
    """Words with a tag: the document's language."""
    return tokens(s, d).select(F.col("token").alias("word"), F.col("lang").alias("tag"))


def orders(s, d):
    return table(s, d, "orders").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_totalprice", "o_orderstatus")


def items(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


def _arrays(s, d, status):
    return orders(s, d).filter(F.col("o_orderstatus") == status).groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("v"))


def numbered(s, d):
    return items(s, d).select("l_orderkey", F.struct("l_linenumber", "l_quantity").alias("x")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x.l_linenumber")).alias("v"))


_ARR = "(SELECT o_custkey, list(o_orderkey) AS v FROM orders WHERE o_orderstatus = '{}' GROUP BY 1)"

def _tagged(s, d):
    """Words with their first letters as tags."""
    words = table(s, d, "documents").select(F.col("doc_id").alias("sentence"), letters(F.col("text")).alias("words"))
    return words.withColumn("tags", F.transform("words", lambda w: F.substring(w, 1, 1)))



def rare_words(docs, cutoff):
    """How many rare words each document with a word has."""
    rare = C.rare_word_switch(docs.select(F.col("doc_id").alias("id"), letters(F.col("text")).alias("words")), cutoff)
    none = docs.filter(F.lower("text").rlike("[a-z]")).select("doc_id", F.lit(0).alias("n"))
    return none.unionByName(rare.select(F.col("id").alias("doc_id"), F.lit(1).alias("n"))).groupBy("doc_id").agg(F.sum("n").alias("rare"))


QUERIES = {
    "C01_lexicon": (lambda s, d: C.lexicon(tokens(s, d)), _TK + " SELECT token, count(*) AS n FROM tokens GROUP BY token"),
    "C02_ngram_counts": (
        lambda s, d: C.ngram_counts(table(s, d, "documents").select(letters(F.col("text")).alias("w")), "w", 2),
        f"WITH t AS (SELECT {WORDS_SQL} AS w FROM documents), g AS (SELECT w[i] || ' ' || w[i + 1] AS gram FROM (SELECT w, unnest(range(1, len(w))) AS i FROM t)) SELECT gram, count(*) AS n FROM g GROUP BY gram",
    ),
    "C03_relation_label_counts": (
        lambda s, d: C.relation_label_counts(items(s, d).select(F.col("l_orderkey").alias("sentence"), F.concat_ws("_", "l_returnflag", "l_linenumber").alias("label"))),
        "SELECT l_returnflag AS label, count(*) AS n, count(DISTINCT l_orderkey) AS sentences FROM lineitem GROUP BY 1",
    ),
    "C04_merge_counts": (
        lambda s, d: C.merge_counts(*(tokens(s, d).filter(F.col("lang") == x).groupBy(F.col("token").alias("value")).agg(F.count("*").alias("n")) for x in ("en", "de"))),
        _TK + " SELECT token AS value, count(*)::BIGINT AS n FROM tokens WHERE lang IN ('en', 'de') GROUP BY 1",
    ),
    "C05_count_features": (
        lambda s, d: C.count_features(tokens(s, d).select(F.col("lang").alias("type"), F.col("token").alias("value")), 20, ("en", "fr")),
        _TK + " SELECT lang AS type, token AS value, count(*) AS n FROM tokens WHERE lang IN ('en', 'fr') GROUP BY 1, 2 HAVING n > 20",
    ),
    "C06_tag_dictionary": (
        lambda s, d: C.tag_dictionary(tagged(s, d), 50).select("word", F.array_join("tags", ",").alias("tags")),
        _TK
        + ", c AS (SELECT token, lang, count(*) AS n, sum(count(*)) OVER (PARTITION BY token) AS k FROM tokens GROUP BY 1, 2), p AS (SELECT CASE WHEN k > 50 THEN token ELSE '*other_words*' END AS word, lang, sum(n) AS n FROM c GROUP BY 1, 2) SELECT word, string_agg(lang, ',' ORDER BY n DESC, lang) AS tags FROM p GROUP BY 1",
    ),
    "C07_most_frequent_tag": (
        lambda s, d: C.most_frequent_tag(tagged(s, d)),
        _TK + " SELECT token AS word, lang AS tag FROM (SELECT token, lang, count(*) AS n FROM tokens GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY token ORDER BY n DESC, lang) = 1",
    ),
    "C08_idf": (
        lambda s, d: C.idf(table(s, d, "documents").select(letters(F.col("text")).alias("w")), "w").select("token", "df", r6(F.col("idf")).alias("idf")),
        _TK + ", n AS (SELECT count(DISTINCT doc_id) AS docs FROM tokens) SELECT token, count(DISTINCT doc_id) AS df, round(ln(any_value(docs)::DOUBLE / count(DISTINCT doc_id)), 6) + 0.0 AS idf FROM tokens, n GROUP BY 1",
    ),
    "C09_novel_terms": (
        lambda s, d: C.novel_terms(tokens(s, d).select(F.col("lang").alias("class"), "token"), table(s, d, "benchmark").select(F.explode(letters(F.col("text"))).alias("token"))).select("class", "token", "n", "place"),
        _TK
        + f", k AS (SELECT DISTINCT unnest({WORDS_SQL}) AS token FROM benchmark), c AS (SELECT lang, token, count(*) AS n FROM tokens WHERE token NOT IN (SELECT token FROM k) GROUP BY 1, 2) SELECT lang AS class, token, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token)::INT AS place FROM c QUALIFY place <= 15",
    ),
    "C10_feature_counts": (
        lambda s, d: C.feature_counts(tokens(s, d).select(F.lit("w").alias("type"), F.col("token").alias("attr"), F.col("lang").alias("klass")), 30, {"x": 5}, {"the": 1}),
        _TK + ", c AS (SELECT token, lang, count(*) AS n FROM tokens GROUP BY 1, 2) SELECT 'w' AS type, token AS attr, lang AS klass, n FROM c QUALIFY sum(n) OVER (PARTITION BY token) >= CASE WHEN token = 'the' THEN 1 ELSE 30 END",
    ),
    "C11_context_table": (
        lambda s, d: C.context_table(items(s, d).select(F.col("l_orderkey").alias("context"), F.col("l_returnflag").alias("klass"), F.col("l_linenumber").alias("id"))).select("klass", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"), "n"),
        "WITH c AS (SELECT l_orderkey, l_returnflag AS klass, string_agg(l_linenumber::VARCHAR, ' ' ORDER BY l_linenumber) AS ids FROM lineitem GROUP BY 1, 2) SELECT klass, ids, count(*) AS n FROM c GROUP BY 1, 2",
    ),
    "C12_dense_ids": (
        lambda s, d: C.dense_ids(tokens(s, d).groupBy(F.col("token").alias("value")).agg(F.count("*").alias("n"))),
        _TK + " SELECT token AS value, n, row_number() OVER (ORDER BY n DESC, token) AS id FROM (SELECT token, count(*) AS n FROM tokens GROUP BY 1)",
    ),
    "C13_window_features": (
        lambda s, d: C.window_features(_tagged(s, d)),
        _TK
        + f", a AS (SELECT doc_id AS sentence, place, token AS word, left(token, 1) AS tag FROM tokens) SELECT sentence, place, lag(word, 2, '{C.SENTINEL}') OVER w AS wm2, lag(word, 1, '{C.SENTINEL}') OVER w AS wm1, word AS w0, lead(word, 1, '{C.SENTINEL}') OVER w AS w1, lead(word, 2, '{C.SENTINEL}') OVER w AS w2, lag(tag, 1, '{C.SENTINEL}') OVER w AS tm1, lag(tag, 2, '{C.SENTINEL}') OVER w || ':' || lag(tag, 1, '{C.SENTINEL}') OVER w AS tm2m1 FROM a WINDOW w AS (PARTITION BY sentence ORDER BY place)",
    ),
    "C14_rare_word_switch": (lambda s, d: rare_words(table(s, d, "documents"), 5), _TK + ", c AS (SELECT token, count(*) AS n FROM tokens GROUP BY 1) SELECT doc_id, count(*) FILTER (n < 5) AS rare FROM tokens JOIN c USING (token) GROUP BY 1"),
    "C15_distribute": (lambda s, d: C.distribute(orders(s, d).select("o_orderkey"), "o_orderkey", 7), "SELECT o_orderkey, floor(o_orderkey * 7 / (SELECT count(*) FROM orders))::INT AS bucket FROM orders"),
    "C16_batch_lines": (
        lambda s, d: C.batch_lines(table(s, d, "nation").select((F.col("n_nationkey") + 1).alias("id"), F.col("n_name").alias("line")), 4).select(F.col("key").cast("long").alias("key"), "lines"),
        "SELECT ((n_nationkey // 4) * 4 + 1)::BIGINT AS key, string_agg(n_name, chr(9) ORDER BY n_nationkey) AS lines FROM nation GROUP BY 1",
    ),
    "C17_cluster_map": (
        lambda s, d: C.cluster_map(tokens(s, d).select(F.col("token").alias("word"), "doc_id"), tokens(s, d).groupBy(F.col("token").alias("word")).agg(F.count("*").alias("n")).withColumn("cluster", F.length("word")), 10).groupBy("cluster").agg(F.count("*").alias("n")),
        _TK + ", c AS (SELECT token, count(*) AS n FROM tokens GROUP BY 1 HAVING n >= 10) SELECT length(token)::INT AS cluster, sum(n)::BIGINT AS n FROM c GROUP BY 1",
    ),
    "C18_open_class_tags": (
        lambda s, d: C.open_class_tags(table(s, d, "part").groupBy(F.col("p_brand").alias("tag"), F.col("p_type").alias("pos")).agg(F.count("*").alias("n")), ("ECONOMY", "PROMO"), 10),
        "SELECT DISTINCT p_brand AS tag FROM part WHERE p_type NOT IN ('ECONOMY', 'PROMO') GROUP BY p_brand, p_type HAVING count(*) >= 10",
    ),
    "C19_accepted_entity_types": (lambda s, d: C.accepted_entity_types(table(s, d, "events").select("event_id", F.col("event_type").alias("type")), ("click", "error")), "SELECT event_id, event_type AS type FROM events WHERE event_type IN ('click', 'error')"),
    "H01_count_compare": (lambda s, d: H.count_compare(items(s, d), ["l_orderkey"], F.col("l_quantity") > 25, 2), "SELECT l_orderkey, sign(count(*) FILTER (l_quantity > 25) - 2)::INT AS \"order\" FROM lineitem GROUP BY 1"),
    "H02_sum_and_average": (lambda s, d: H.sum_and_average(items(s, d), ["l_returnflag"], F.col("l_quantity")).select("l_returnflag", r6(F.col("sum")).alias("sum"), r6(F.col("avg")).alias("avg")), "SELECT l_returnflag, round(sum(l_quantity), 6) AS sum, round(avg(l_quantity), 6) AS avg FROM lineitem GROUP BY 1"),
    "H03_map_to": (lambda s, d: H.map_to(items(s, d), "l_orderkey", half=F.col("l_quantity") / 2, flag=F.lower("l_returnflag")), "SELECT l_orderkey, l_quantity / 2 AS half, lower(l_returnflag) AS flag FROM lineitem"),
    "H04_sliding_pairs": (lambda s, d: H.sliding_pairs(orders(s, d), "o_custkey", "o_orderkey", "o_orderkey"), "SELECT * FROM (SELECT o_custkey, o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE b IS NOT NULL"),
    "H05_group_values": (lambda s, d: H.group_values(orders(s, d), "o_custkey", "o_orderkey").select("o_custkey", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("v")), "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS v FROM orders GROUP BY 1"),
    "H06_counts": (lambda s, d: H.counts(items(s, d), "l_returnflag", "l_linenumber"), "SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "H07_merge_by_key": (
        lambda s, d: H.merge_by_key(_arrays(s, d, "F"), _arrays(s, d, "O"), "o_custkey", "v").select("o_custkey", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("v")),
        "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS v FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1",
    ),
    "H07_sum_by_key": (lambda s, d: H.sum_by_key(*(orders(s, d).filter(F.col("o_orderstatus") == x).groupBy("o_custkey").agg(F.count("*").alias("v")) for x in "FO"), "o_custkey", "v"), "SELECT o_custkey, count(*) AS v FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1"),
    "H08_ungroup": (lambda s, d: H.ungroup(_arrays(s, d, "F"), "o_custkey", "v"), "SELECT o_custkey, o_orderkey AS value FROM orders WHERE o_orderstatus = 'F'"),
    "H09_take_sub": (
        lambda s, d: H.take_sub(numbered(s, d).select(F.floor(F.col("l_orderkey") / 10).alias("k"), "l_orderkey", "v"), "k", "l_orderkey", "v", 12).select("k", "l_orderkey", F.size("v").alias("n")),
        "WITH o AS (SELECT l_orderkey // 10 AS k, l_orderkey, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY k ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o) SELECT k, l_orderkey, least(12 - before, n)::INT AS n FROM b WHERE before < 12",
    ),
    "H10_shuffled": (lambda s, d: H.shuffled(orders(s, d).select("o_orderkey"), 3, "o_orderkey"), "SELECT o_orderkey, ('0x' || substr(md5('3:' || o_orderkey), 1, 8))::BIGINT AS place FROM orders"),
    "H11_split_runs": (
        lambda s, d: H.split_runs(items(s, d), "l_orderkey", "l_linenumber", F.col("l_returnflag") == "R").groupBy("l_orderkey", "run").agg(F.count("*").alias("n")),
        "WITH r AS (SELECT *, sum((l_returnflag = 'R')::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM lineitem) SELECT l_orderkey, run::BIGINT AS run, count(*) AS n FROM r WHERE l_returnflag <> 'R' GROUP BY 1, 2",
    ),
    "H12_split_at": (lambda s, d: H.split_at(orders(s, d).select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3), "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3 AS first FROM orders"),
    "H12_drop_right_while": (
        lambda s, d: H.drop_right_while(orders(s, d).select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey", F.col("o_orderstatus") == "F"),
        "WITH x AS (SELECT o_custkey, o_orderkey, o_orderstatus, max(o_orderkey) FILTER (o_orderstatus <> 'F') OVER (PARTITION BY o_custkey) AS stop FROM orders) SELECT o_custkey, o_orderkey, o_orderstatus FROM x WHERE o_orderkey <= stop",
    ),
    "H13_zip_safe": (lambda s, d: H.zip_safe(orders(s, d).select("o_orderkey", "day"), orders(s, d).select("o_orderkey", "o_orderstatus"), "o_orderkey"), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus FROM orders"),
    "H14_normalise": (lambda s, d: H.normalise(items(s, d).select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_quantity").select("l_orderkey", "l_linenumber", r6(F.col("share")).alias("share")), "SELECT l_orderkey, l_linenumber, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem"),
    "H15_partition_n": (lambda s, d: H.partition_n(orders(s, d).filter("o_orderkey % 9 <> 4"), F.col("o_orderkey") % 9, 9), "SELECT range AS \"group\", count(o_orderkey) AS rows FROM range(9) LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 4) ON o_orderkey % 9 = range GROUP BY 1"),
    "H16_history": (
        lambda s, d: H.history(orders(s, d).select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", "o_orderkey", 4, 2).select("o_orderkey", F.array_join(F.transform("history", lambda x: x.cast("string")), ",").alias("h")),
        "WITH x AS (SELECT o_orderkey, lag(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) SELECT o_orderkey, concat_ws(',', o_orderkey::VARCHAR, p::VARCHAR) AS h FROM x",
    ),
    "H17_range_string": (
        lambda s, d: H.range_string(items(s, d), "l_orderkey", "l_linenumber"),
        "WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), y AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM x), z AS (SELECT l_orderkey, g, min(l_linenumber) AS a, max(l_linenumber) AS b FROM y GROUP BY 1, 2) SELECT l_orderkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM z GROUP BY 1",
    ),
}
