"""Parsers and sinks over lines that Spark makes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import thesaurus as T
from corpusloom.plans.inputs import RELATIONS_SQL, r6, relations, table
from corpusloom.plans.thesaurus import QUERIES as THESAURUS
from corpusloom.sources import readers as S
from corpusloom.sources import writers as K


def rnd(df):
    return df.select(*(r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def line(s, d, *columns, t="lineitem", sep="\t"):
    return table(s, d, t).select(F.concat_ws(sep, *(F.col(c).cast("string") if isinstance(c, str) else c for c in columns)).alias("value"))


def orders(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("pair_id"), "o_orderstatus", "o_totalprice")


def _vec(kind):
    if kind == "dense":
        return lambda s, d: rnd(S.parse_vectors(line(s, d, "p_name", "p_size", "p_partkey", t="part"), kind))
    if kind == "sparse":
        return lambda s, d: rnd(S.parse_vectors(line(s, d, "p_name", "p_brand", "p_size", t="part"), kind))
    return lambda s, d: rnd(S.parse_vectors(line(s, d, "p_name", "p_brand", "p_size", F.lit(""), "p_type", "p_partkey", t="part"), kind))


def _dump(s, d):
    docs = table(s, d, "documents").select(F.format_string('id="%d" title="T%s">\n%s\n</doc>\n', "doc_id", F.col("source"), F.replace("text", F.lit("<"), F.lit(" "))).alias("value"))
    return S.parse_doc_dump(docs)


_D = "dd AS (SELECT doc_id::VARCHAR AS id, 'T' || source AS title FROM documents)"


def _questions(s, d):
    n = table(s, d, "nation")
    text = F.format_string("t%d\n\n@entity1 met @entity2 in %s\n\n@placeholder met @entity2\n\n@entity1\n\n@entity1:N%d\n@entity2:R:%d", "n_nationkey", F.col("n_name"), F.col("n_nationkey"), F.col("n_regionkey"))
    q = S.parse_questions(n.select(text.alias("value")))
    return q.select("title", S.deanonymise(F.col("context"), F.col("entities")).alias("context"), "question", "answer", F.size("entities").alias("n"))


QUERIES = {
    "S01_read_pairs": (lambda s, d: S.parse_pairs(line(s, d, "o_orderkey", "o_orderstatus", "o_orderpriority", t="orders")), "SELECT o_orderkey AS pair_id, o_orderstatus AS text, o_orderpriority AS hyp FROM orders"),
    "S02_attach_gold": (lambda s, d: S.attach_gold(orders(s, d), orders(s, d).select("pair_id", (F.col("o_totalprice") > 1e5).alias("gold"))), "SELECT o_orderkey AS pair_id, o_orderstatus, o_totalprice, o_totalprice > 1e5 AS gold FROM orders"),
    "S03_map_labels": (lambda s, d: orders(s, d).select("pair_id", S.map_labels(F.col("o_orderstatus"), {"F": "CONTRADICTION", "O": "ENTAILMENT", "P": "NEUTRAL"}).alias("label")), "SELECT o_orderkey AS pair_id, CASE o_orderstatus WHEN 'F' THEN 'CONTRADICTION' WHEN 'O' THEN 'ENTAILMENT' ELSE 'NEUTRAL' END AS label FROM orders"),
    "S04_dense_vectors": (_vec("dense"), "SELECT p_name AS word, '0' AS dim, p_size::DOUBLE AS w FROM part UNION ALL SELECT p_name, '1', p_partkey::DOUBLE FROM part"),
    "S05_sparse_vectors": (_vec("sparse"), "SELECT p_name AS word, p_brand AS dim, p_size::DOUBLE AS w FROM part"),
    "S05_dim_index": (lambda s, d: S.dim_index(_vec("sparse")(s, d)), "SELECT dim, (row_number() OVER (ORDER BY dim) - 1)::INT AS index FROM (SELECT DISTINCT p_brand AS dim FROM part)"),
    "S06_interleaved_vectors": (_vec("interleaved"), "SELECT p_name AS word, p_brand AS dim, p_size::DOUBLE AS w FROM part UNION ALL SELECT p_name, p_type, p_partkey::DOUBLE FROM part"),
    "S07_detect_vector_format": (
        lambda s, d: line(s, d, "p_name", "p_brand", "p_size", t="part").unionByName(line(s, d, "p_name", "p_size", "p_retailprice", t="part")).groupBy(S.vector_format(F.col("value")).alias("format")).agg(F.count("*").alias("n")),
        "SELECT 'sparse' AS format, count(*) AS n FROM part UNION ALL SELECT 'dense', count(*) FROM part",
    ),
    "S11_read_named_rules": (
        lambda s, d: S.parse_named_rules(line(s, d, "p_partkey", "p_size", "p_brand", t="part").unionByName(table(s, d, "part").select(F.lit("p_partkey\tw\tgsw").alias("value")).distinct()), "p_partkey\tw\tgsw", ["p_partkey", "w", "gsw"]),
        "SELECT p_partkey::DOUBLE AS p_partkey, p_size::DOUBLE AS w, NULL::DOUBLE AS gsw FROM part",
    ),
    "S12_parse_delimited": (
        lambda s, d: S.int_column(S.parse_delimited(table(s, d, "part").select(F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("// "), "p_name")).when(F.col("p_size") % 5 == 1, F.col("p_name")).otherwise(F.concat_ws(";", "p_name", "p_partkey")).alias("value")), ";", 2)[0], 1),
        "SELECT p_partkey::INT AS value FROM part WHERE p_size % 5 > 1",
    ),
    "S12_rejected_lines": (
        lambda s, d: S.parse_delimited(table(s, d, "part").select(F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("// "), "p_name")).when(F.col("p_size") % 5 == 1, F.col("p_name")).otherwise(F.concat_ws(";", "p_name", "p_partkey")).alias("value")), ";", 2)[1],
        "SELECT p_name AS value FROM part WHERE p_size % 5 = 1",
    ),
    "S13_load_facts": (lambda s, d: S.load_facts(table(s, d, "lineitem").withColumn("t", (F.col("l_discount") * 12).cast("string")), ["l_orderkey", "l_partkey"], "t")[1].groupBy("a1").agg(F.count("*").alias("n")), "SELECT l_orderkey AS a1, count(*) AS n FROM lineitem WHERE l_discount * 12 > 1 GROUP BY 1"),
    "S14_route_facts": (
        lambda s, d: S.route_facts(table(s, d, "part").select(F.split(F.concat_ws(",", "p_type", "p_brand", F.when(F.col("p_size") > 25, F.col("p_name"))), ",").alias("fields")), 0, {"ECONOMY": 1, "PROMO": 2}).groupBy("predicate").agg(F.count("*").alias("n")),
        "SELECT p_type AS predicate, count(*) AS n FROM part WHERE (p_type = 'ECONOMY' AND p_size <= 25) OR (p_type = 'PROMO' AND p_size > 25) GROUP BY 1",
    ),
    "S15_facts_from_wide": (lambda s, d: S.facts_from_wide(table(s, d, "part").select("p_partkey", "p_brand", "p_type"), "p_partkey"), "SELECT 'p_brand' AS predicate, p_partkey AS id, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_partkey, p_type FROM part"),
    "S16_facts_from_matrix": (lambda s, d: S.facts_from_matrix(table(s, d, "part").select("p_partkey", "p_size", "p_type"), "p_partkey"), "SELECT p_partkey AS a1, 'p_size' AS a2, p_size::DOUBLE AS truth FROM part"),
    "S17_facts_from_entity_matrix": (lambda s, d: S.facts_from_entity_matrix(table(s, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") > 9, F.col("p_type")).otherwise(" ").alias("p_type")), "p_partkey"), "SELECT p_partkey AS row, 'p_brand' AS col, p_brand AS cell FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part WHERE p_size > 9"),
    "S18_read_graph": (
        lambda s, d: S.read_graph(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("s").alias("type")).filter("id % 3 = 0"), table(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_suppkey") % 12).alias("dst"), F.col("l_returnflag").alias("label")).distinct())[1],
        "SELECT DISTINCT l_suppkey AS src, l_suppkey % 12 AS dst, l_returnflag AS label FROM lineitem WHERE l_suppkey % 3 = 0",
    ),
    "S18_read_graph_create": (
        lambda s, d: S.read_graph(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("s").alias("type")).filter("id % 3 = 0"), table(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_suppkey") % 12).alias("dst"), F.col("l_returnflag").alias("label")).distinct(), create=True)[0],
        "SELECT s_suppkey AS id, 's' AS type FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT x, NULL FROM (SELECT l_suppkey AS x FROM lineitem UNION SELECT l_suppkey % 12 FROM lineitem) WHERE x NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)",
    ),
    "S19_parse_model_spec": (
        lambda s, d: S.parse_model_spec(table(s, d, "nation").select(F.when(F.col("n_nationkey") == 0, "predicate, lives, 2").when(F.col("n_nationkey") == 1, "rule, a >> b").otherwise(F.concat_ws(", ", F.lit("data"), F.lit("lives"), "n_nationkey", "n_regionkey")).alias("value"))).select("kind", "name", F.array_join("args", "|").alias("args")),
        "SELECT 'data' AS kind, 'lives' AS name, n_nationkey || '|' || n_regionkey AS args FROM nation WHERE n_nationkey > 1 UNION ALL SELECT 'predicate', 'lives', '2' FROM nation WHERE n_nationkey = 0",
    ),
    "S20_doc_dump": (lambda s, d: _dump(s, d).select("id", "title", F.startswith("text", F.concat("title", F.lit(".\n"))).alias("ok")), f"WITH {_D} SELECT id, title, true AS ok FROM dd"),
    "S21_filter_docs_by_title": (lambda s, d: S.filter_docs_by_title(_dump(s, d), table(s, d, "documents").filter("source like '%1'").select(F.concat(F.lit("T"), "source").alias("title"))).select("id", "title"), f"WITH {_D} SELECT id, title FROM dd WHERE title LIKE '%1'"),
    "S22_questions": (_questions, "SELECT 't' || n_nationkey AS title, 'N' || n_nationkey || ' met R:' || n_regionkey || ' in ' || n_name AS context, '@placeholder met @entity2' AS question, '@entity1' AS answer, 2 AS n FROM nation"),
    "S23_merge_common_counts": (
        lambda s, d: S.merge_common_counts(r := relations(s, d), r.filter("obj = 'Brand#3' and type = 'nation'").withColumn("f", F.lit(1).cast("long"))),
        f"WITH {RELATIONS_SQL} SELECT obj, attr, type, f FROM rel WHERE obj <> 'Brand#3' UNION ALL SELECT obj, attr, type, 1 FROM rel WHERE obj = 'Brand#3' AND type = 'nation'",
    ),
    "S24_attribute_totals": (
        lambda s, d: S.with_given_totals(T.relation_counts(r := relations(s, d)), r.filter("attr like 'n%'").select("attr").distinct().withColumn("fa", F.lit(9).cast("long")).withColumn("na", F.lit(3).cast("long"))).select("obj", "attr", "fa", "na"),
        f"WITH {RELATIONS_SQL} SELECT obj, attr, CASE WHEN attr LIKE 'n%' THEN 9 ELSE sum(f) OVER (PARTITION BY attr, type) END::BIGINT AS fa, CASE WHEN attr LIKE 'n%' THEN 3 ELSE count(*) OVER (PARTITION BY attr, type) END AS na FROM rel",
    ),
    "S25_parse_features": (
        lambda s, d: rnd(S.parse_features(table(s, d, "part").select(F.format_string("%d qid:%d 1:%d.5 4:2 #%s", "p_size", F.col("p_partkey"), F.col("p_size"), F.col("p_name")).alias("value"))).select("label", "qid", F.element_at("features", 1).alias("f1"), F.element_at("features", 4).alias("f4"), "name")),
        "SELECT p_size::DOUBLE AS label, p_partkey AS qid, p_size + 0.5::DOUBLE AS f1, 2.0::DOUBLE AS f4, p_name AS name FROM part",
    ),
    "S26_parse_scores": (
        lambda s, d: rnd(S.parse_scores(table(s, d, "nation").select(F.format_string("[%d.5,1 %d,2]", "n_nationkey", F.col("n_regionkey")).alias("value"))).groupBy("place", "parse").agg(F.sum("score").alias("score"))),
        "SELECT 0 AS place, 0 AS parse, sum(n_nationkey + 0.5::DOUBLE) AS score FROM nation UNION ALL SELECT 0, 1, count(*)::DOUBLE FROM nation UNION ALL SELECT 1, 0, sum(n_regionkey)::DOUBLE FROM nation UNION ALL SELECT 1, 1, 2.0 * count(*)::DOUBLE FROM nation",
    ),
    "S27_parse_predictions": (
        lambda s, d: S.parse_predictions(table(s, d, "part").select(F.col("p_partkey").alias("n"), F.when(F.col("p_partkey") == 7, " inst# actual").otherwise(F.concat_ws("  ", "p_type", "p_brand")).alias("value"))).select("n", F.element_at("fields", 2).alias("second")),
        "SELECT p_partkey AS n, p_brand AS second FROM part WHERE p_partkey > 7",
    ),
    "S28_select_range": (lambda s, d: S.select_range(orders(s, d), "pair_id", "4-6,9,100-").select("pair_id"), "SELECT o_orderkey AS pair_id FROM orders WHERE o_orderkey BETWEEN 4 AND 6 OR o_orderkey = 9 OR o_orderkey >= 100"),
    "S29_batch_range": (lambda s, d: S.batch_range(orders(s, d).select("pair_id"), "pair_id", 40), "SELECT o_orderkey AS pair_id, (floor((o_orderkey - 1) / 40.0) + 1)::BIGINT AS batch FROM orders"),
    "S30_filter_pairs_by_id": (lambda s, d: S.filter_pairs_by_id(orders(s, d), [3, 5, 8]), "SELECT o_orderkey AS pair_id, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey IN (3, 5, 8)"),
    "K01_write_scores": (
        lambda s, d: K.scores(table(s, d, "orders").select(F.col("o_orderkey").alias("pair_id"), F.col("o_totalprice").alias("prediction")), table(s, d, "orders").select(F.col("o_orderkey").alias("pair_id"), F.col("o_orderstatus").alias("gold"))),
        "SELECT o_orderkey AS pair_id, o_totalprice AS prediction, o_orderstatus AS gold FROM orders",
    ),
    "K02_arff_lines": (
        lambda s, d: K.arff_lines(table(s, d, "nation"), "nations", ["n_nationkey"], "n_regionkey").select("line"),
        "SELECT n_nationkey || ',' || n_regionkey AS line FROM nation UNION ALL SELECT unnest(['@RELATION nations', '@ATTRIBUTE n_nationkey NUMERIC', '@ATTRIBUTE n_regionkey NUMERIC', '@DATA'])",
    ),
    "K03_submission": (
        lambda s, d: K.submission(*(table(s, d, "orders").select(F.col("o_orderkey").alias("instance"), F.col(c).alias("prediction"), "o_orderpriority") for c in ("o_orderstatus", "o_totalprice"))),
        "SELECT o_orderkey AS instance, o_orderstatus AS entailment, o_totalprice AS relatedness FROM orders",
    ),
    "K04_title_digit": (lambda s, d: K.with_title_digit(table(s, d, "pages").select("page_id", F.col("url").alias("title"))), "SELECT page_id, url AS title, left(md5(url), 1) AS digit FROM pages"),
    "K05_numbered_questions": (lambda s, d: K.numbered_questions(table(s, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey"), "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS counter FROM orders"),
    "K06_qid_feature_line": (
        lambda s, d: table(s, d, "part").select("p_partkey", K.qid_feature_line(F.col("p_size"), F.col("p_partkey"), F.array(F.lit(0), F.col("p_size"), F.lit(3)), F.col("p_name")).alias("line")),
        "SELECT p_partkey, p_size || ' qid:' || p_partkey || ' 2:' || p_size || ' 3:3 #' || p_name AS line FROM part WHERE p_size <> 0",
    ),
    "K07_thesaurus_entries": (
        lambda s, d: THESAURUS["T27_neighbours"][0](s, d).transform(lambda n: K.thesaurus_entries(n, T.describe(relations(s, d), "obj").select("obj", "freq"))).select("obj", "freq", F.array_join(F.transform("entries", lambda e: e["neighbour"]), ",").alias("entries")),
        f"SELECT obj1 AS obj, any_value(freq) AS freq, string_agg(obj2, ',' ORDER BY place) AS entries FROM ({THESAURUS['T27_neighbours'][1]}) JOIN ({THESAURUS['T34_describe_object'][1]}) ON obj = obj1 GROUP BY 1",
    ),
    "K08_experiment_report": (lambda s, d: K.experiment_report(table(s, d, "region"), "run").drop("at"), "SELECT r_regionkey, r_name, 'run' AS experiment FROM region"),
    "K09_graphviz": (
        lambda s, d: K.graphviz(table(s, d, "nation").select(F.col("n_regionkey").alias("graph"), F.col("n_name").alias("src"), F.col("n_regionkey").cast("string").alias("dst"), F.lit("in").alias("label")), "graph"),
        "SELECT n_regionkey AS graph, 'digraph {' || chr(10) || string_agg('  \"' || n_name || '\" -> \"' || n_regionkey || '\" [label=\"in\"];', chr(10) ORDER BY n_name) || chr(10) || '}' AS text FROM nation GROUP BY 1",
    ),
}
