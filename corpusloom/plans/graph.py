"""Graph queries: the hierarchy of regions, nations and customers; parts sold by suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import graph as G
from corpusloom.plans.inputs import table


def edges(s, d):
    """region -> nation -> supplier and customer -> order."""
    n, c, o, u = (table(s, d, t) for t in ("nation", "customer", "orders", "supplier"))
    e = n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    e = e.unionByName(c.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst")))
    e = e.unionByName(u.select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst")))
    return e.unionByName(o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))).withColumn("ptr", F.lit("hyponym"))


_E = "e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"


def regions(s, d):
    return table(s, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("src"))


def _closure(depth):
    bound = "" if depth is None else f" AND depth < {depth}"
    sql = f"WITH RECURSIVE {_E}, c AS (SELECT src, dst, 1 AS depth FROM e WHERE src LIKE 'r%' UNION ALL SELECT c.src, e.dst, depth + 1 FROM c JOIN e ON e.src = c.dst{bound}) SELECT src, dst, depth FROM c"
    return (lambda s, d: G.closure(regions(s, d), edges(s, d).select("src", "dst"), depth)), sql


def synset_word(s, d):
    """Parts as words, their brands as synsets."""
    p = table(s, d, "part")
    return p.select("p_name", "p_brand", "p_type").distinct().select(F.col("p_name").alias("word"), F.when(F.col("p_type") == "ECONOMY", "a").when(F.col("p_type") == "PROMO", "r").otherwise("n").alias("pos"), F.col("p_brand").alias("synset")).distinct()


_SW = "sw AS (SELECT DISTINCT p_name AS word, CASE p_type WHEN 'ECONOMY' THEN 'a' WHEN 'PROMO' THEN 'r' ELSE 'n' END AS pos, p_brand AS synset FROM part)"


def words(s, d):
    return synset_word(s, d).select("word").distinct().crossJoin(s.range(3).select(F.element_at(F.array(F.lit("a"), F.lit("n"), F.lit("x")), (F.col("id") + 1).cast("int")).alias("pos")))


_WD = "wd AS (SELECT DISTINCT word, p AS pos FROM sw, (SELECT unnest(['a', 'n', 'x']) AS p))"
_SS = "ss AS (SELECT wd.word, wd.pos, synset FROM wd JOIN sw ON sw.word = wd.word AND ((wd.pos = 'a' AND sw.pos IN ('a', 'r')) OR (wd.pos = 'n' AND sw.pos = 'n')))"


def brand_edges(s, d):
    b = synset_word(s, d).select(F.regexp_extract("synset", "(\\d+)", 1).cast("int").alias("k")).distinct()
    name = lambda c: F.concat(F.lit("Brand#"), c.cast("string"))
    down = b.filter("k > 1").select(name(F.col("k")).alias("src"), name(F.floor(F.col("k") / 2)).alias("dst"), F.lit("hypernym").alias("ptr"))
    return down.unionByName(b.filter("k % 2 = 0").select(name(F.col("k")).alias("src"), name(F.col("k") + 1).alias("dst"), F.lit("antonym").alias("ptr")))


_BE = "bk AS (SELECT DISTINCT regexp_extract(synset, '(\\d+)', 1)::INT AS k FROM sw), be AS (SELECT 'Brand#' || k AS src, 'Brand#' || (k // 2) AS dst, 'hypernym' AS ptr FROM bk WHERE k > 1 UNION ALL SELECT 'Brand#' || k, 'Brand#' || (k + 1), 'antonym' FROM bk WHERE k % 2 = 0)"


def _lemmas(relation):
    query = lambda s, d: G.expand_lemmas(words(s, d), synset_word(s, d), brand_edges(s, d), relation)
    if relation == "synonym":
        reach = "re AS (SELECT word, pos, synset FROM ss)"
    elif relation == "antonym":
        reach = "re AS (SELECT word, pos, dst AS synset FROM ss JOIN be ON src = synset AND ptr = 'antonym')"
    else:
        reach = "cl AS (SELECT src, dst FROM be WHERE ptr = 'hypernym' UNION SELECT cl.src, be.dst FROM cl JOIN be ON be.src = cl.dst AND be.ptr = 'hypernym'), re AS (SELECT word, pos, dst AS synset FROM ss JOIN cl ON src = synset)"
    return query, f"WITH RECURSIVE {_SW}, {_WD}, {_SS}, {_BE}, {reach} SELECT DISTINCT re.word, re.pos, sw.word AS lemma FROM re JOIN sw ON sw.synset = re.synset WHERE sw.word <> re.word"


def bipartite(s, d):
    """A graph for each shipping year: orders and suppliers."""
    li = table(s, d, "lineitem")
    return li.select(F.year("l_shipdate").alias("graph"), F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()


def starts(s, d):
    return bipartite(s, d).groupBy("graph").agg(F.min("dst").alias("start"))


def _pairs(s, d):
    b = bipartite(s, d)
    return b.groupBy("graph").agg(F.min("dst").alias("a"), F.max("dst").alias("b"))


def links(s, d):
    li = table(s, d, "lineitem")
    return li.select(F.concat(F.lit("o"), "l_orderkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"))


def vertices(s, d):
    e = edges(s, d)
    return e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def _group_sizes(s, d):
    """Sizes are of a class of equal groups; its verbs have them."""
    members, groups = G.verb_groups(arguments(s, d))
    return members.join(groups.groupBy("class").agg(F.count("*").alias("n")), "class").select("verb", "n")


def arguments(s, d):
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("verb"), F.col("l_partkey").alias("node")).distinct()


QUERIES = {
    "G01_synsets": (lambda s, d: G.synsets(words(s, d), synset_word(s, d)).distinct(), f"WITH {_SW}, {_WD}, {_SS} SELECT DISTINCT word, pos, synset FROM ss"),
    "G02_neighbours": (lambda s, d: G.neighbours(regions(s, d), edges(s, d), "hyponym"), f"WITH {_E} SELECT src, dst FROM e WHERE src LIKE 'r%'"),
    "G03_closure_1": _closure(1),
    "G03_closure_2": _closure(2),
    "G03_closure_all": _closure(None),
    "G04_synonyms": _lemmas("synonym"),
    "G04_antonyms": _lemmas("antonym"),
    "G04_hypernyms": _lemmas("hypernym"),
    # To the operators' own depth; SQL's recursion is too slow for these.
    "G05_shortest_path": (lambda s, d: G.shortest_path(bipartite(s, d), _pairs(s, d)).select("graph", "a", "b", (F.size("path") - 1).alias("length")), None),
    "G06_bfs_order": (lambda s, d: G.bfs_order(bipartite(s, d), starts(s, d)).groupBy("graph", "start").agg(F.max("place").alias("reached")), None),
    "G07_connected_components": (lambda s, d: G.connected_components(links(s, d)), None),
    "G08_split_random": (
        lambda s, d: G.split_random(vertices(s, d), edges(s, d), 4, 0.01),
        # The hierarchy is a tree of four levels below its regions: no path has more than eight edges.
        f"WITH RECURSIVE {_E}, both_ways AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), v AS (SELECT DISTINCT unnest([src, dst]) AS node FROM e), g AS (SELECT node, (('0x' || substr(md5('1:' || node), 1, 8))::BIGINT % 4)::INT AS part, 0 AS depth FROM v WHERE ('0x' || substr(md5('0:' || node), 1, 8))::BIGINT % 1000000 < 10000 UNION SELECT dst, part, depth + 1 FROM g JOIN both_ways ON src = node WHERE depth < 8) SELECT node, part FROM g QUALIFY row_number() OVER (PARTITION BY node ORDER BY depth, part) = 1",
    ),
    "G09_split_snowball": (lambda s, d: G.split_snowball(vertices(s, d), edges(s, d), 3, 40, 0.5), None),
    "G10_induced_relations": (lambda s, d: G.induced_relations(edges(s, d).select("src", "dst"), vertices(s, d).filter("node not like '%7'")), f"WITH {_E} SELECT src, dst FROM e WHERE src NOT LIKE '%7' AND dst NOT LIKE '%7'"),
    "G11_verb_based_split": (
        _group_sizes,
        "WITH a AS (SELECT DISTINCT l_suppkey AS verb, l_partkey AS node FROM lineitem), v AS (SELECT DISTINCT x.verb AS g, y.verb FROM a x JOIN a y USING (node)) SELECT g AS verb, count(DISTINCT node) AS n FROM v JOIN a USING (verb) GROUP BY 1",
    ),
    "G12_group_children": (
        lambda s, d: G.group_children(table(s, d, "customer").select(F.col("c_nationkey").alias("head"), F.col("c_mktsegment").alias("label"), F.col("c_custkey").alias("child"))).select("head", F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["label"], c["child"])), ",").alias("children")),
        "SELECT c_nationkey AS head, string_agg(c_mktsegment || ':' || c_custkey, ',' ORDER BY c_mktsegment, c_custkey) AS children FROM customer GROUP BY 1",
    ),
}
