"""What queries share: the given tables and tables derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column) -> Column:
    """Rounded to six digits, without a negative zero: sums of floats differ in the last ones by order."""
    return F.round(x, 6) + F.lit(0.0)


#: Words of documents, lower-cased, letters only.
WORDS_SQL = "list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '')"


def letters(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z]+"), "")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, place, token of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(letters(F.col("text"))).alias("place", "token"))


TOKENS_SQL = f"tokens AS (SELECT doc_id, lang, source, unnest(range(len(w)))::INT AS place, unnest(w) AS token FROM (SELECT *, {WORDS_SQL} AS w FROM documents))"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence pairs: a user turn and the assistant turn after it."""
    c = table(spark, sf_dir, "conversations")
    a = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("text_a"))
    b = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text_b"))
    return a.join(b, ["conv_id", "turn"])


PAIRS_SQL = "pairs AS (SELECT a.conv_id, a.turn, a.text AS text_a, b.text AS text_b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects (brands) with attributes (ship mode and supplier's nation) of ordered parts."""
    li, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    joined = li.join(part, li.l_partkey == part.p_partkey).join(supplier, li.l_suppkey == supplier.s_suppkey)
    long = joined.select(
        F.col("p_brand").alias("obj"),
        F.explode(F.array(F.struct(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("attr"), F.lit("nation").alias("type")), F.struct(F.concat(F.lit("q"), F.col("l_quantity").cast("int").cast("string")).alias("attr"), F.lit("quantity").alias("type")))).alias("x"),
    )
    return long.groupBy("obj", "x.attr", "x.type").agg(F.count("*").alias("f"))


RELATIONS_SQL = """rel AS (SELECT obj, attr, type, count(*) AS f FROM (
  SELECT p_brand AS obj, 'n' || s_nationkey::VARCHAR AS attr, 'nation' AS type FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL SELECT p_brand, 'q' || l_quantity::INT::VARCHAR, 'quantity' FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1, 2, 3)"""
