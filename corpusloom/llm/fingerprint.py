"""Document fingerprints: one-permutation MinHash in Spark expressions only.

Each shingle of five words is hashed once. The top seven bits of the hash name one of 128 bins
and the smallest hash of a bin stands for it: hashes are sorted once, and the first of each bin
is kept. An empty bin borrows from a filled one, chosen by a hash of the two bins' numbers, so
that any two texts with the same filled bins choose alike (optimal densification). Of every bin
the low eight bits are stored, as two hex digits. Likeness is the share of equal bins, corrected
for those that are equal by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, table

SHINGLE_WORDS = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 8


def _bin(hash_: Column) -> Column:
    """Of a signed hash by its signed order, so that sorting runs through the bins."""
    return F.shiftright(hash_, 64 - BIN_BITS).cast("int")


def fingerprint(text: Column) -> Column:
    """256 hex digits: two for each bin.

    Words are what ASCII white space parts, lower-cased; texts of fewer than five words are one
    shingle. Null and empty texts and those without words have the fingerprint of the empty
    sequence. Equal texts have equal fingerprints.
    """
    words = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def of_words(w: Column) -> Column:
        last = F.greatest(F.lit(0), F.size(w) - SHINGLE_WORDS)
        hashes = F.sort_array(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(w, i + 1, SHINGLE_WORDS))))
        return _let(hashes, firsts)

    def firsts(h: Column) -> Column:
        return _let(F.filter(h, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(h, i - 1)))), dense)

    def dense(kept: Column) -> Column:
        """kept: the smallest hash of each filled bin."""
        numbers = F.transform(kept, lambda x: _bin(x) + BINS // 2)
        filled = F.map_from_arrays(numbers, kept)
        return _let(F.struct(numbers.alias("numbers"), filled.alias("filled")), bins)

    def bins(f: Column) -> Column:
        def borrowed(j: Column) -> Column:
            donor = F.array_min(F.transform(f["numbers"], lambda b: F.struct(F.xxhash64(j, b).alias("order"), b.alias("bin"))))["bin"]
            return F.element_at(f["filled"], donor)

        value = lambda j: F.coalesce(F.try_element_at(f["filled"], j), borrowed(j))
        digits = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.lpad(F.hex(value(j).bitwiseAND((1 << LOW_BITS) - 1)), LOW_BITS // 4, "0"))
        return F.lower(F.array_join(digits, ""))

    return _let(words, of_words)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints, 0 to 1."""
    digits = LOW_BITS // 4
    equal = F.aggregate(
        F.sequence(F.lit(1), F.lit(BINS * digits), F.lit(digits)),
        F.lit(0),
        lambda n, i: n + F.when(F.substr(a, i, F.lit(digits)) == F.substr(b, i, F.lit(digits)), 1).otherwise(0),
    )
    chance = 2.0**-LOW_BITS
    share = (equal / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), share))


def next_ids(ids: DataFrame) -> DataFrame:
    """doc_id and next_id: the next smaller distinct id; the largest after the smallest.

    Ids are dealt out by range and looked at within their ranges; only each range's ends, a row
    a partition, are put in order together.
    """
    placed = cut(ids.select("doc_id").filter("doc_id is not null").distinct().repartitionByRange("doc_id").withColumn("range", F.spark_partition_id()))
    ends = placed.groupBy("range").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    within = placed.selectExpr("doc_id", "lag(doc_id) over (partition by range order by doc_id) as next_id")
    across = ends.selectExpr("low as doc_id", "coalesce(lag(high) over (order by low), max(high) over ()) as end_id")
    return within.join(across, "doc_id", "left").select("doc_id", F.coalesce("next_id", "end_id").alias("next_id"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint against that of its edited text and of the next document.

    The edited text ends, for its last third, in the start of the next document by descending
    doc_id; after the last comes the first. Of rows that share an id the one whose text has the
    smallest hash is the next document. Rows without doc_id have no next document: theirs is the
    empty text. Other columns than doc_id and text are not read.
    """
    printed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("print", fingerprint(F.col("text")))
    own = printed.filter("doc_id is not null")
    sizes = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.floor(F.length("text") / 3).alias("third"), F.xxhash64("text").alias("mark"))
    of_id = sizes.filter("doc_id is not null").groupBy("doc_id").agg(F.max("third").alias("third"), F.min("mark").alias("mark"))
    wanted = next_ids(sizes).join(of_id.select("doc_id", "third"), "doc_id").select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for_id"), "third")
    starts = (
        own.join(wanted.join(of_id.select("doc_id", "mark"), "doc_id"), "doc_id")
        .filter(F.xxhash64("text").bitwiseXOR(F.col("mark")) == 0)  # not a key of the join, so that both uses of the texts share one shuffle by id
        .select(F.col("for_id").alias("doc_id"), F.substr("text", F.lit(1), F.col("third").cast("int")).alias("start"), F.col("print").alias("next_print"))
        .groupBy("doc_id")
        .agg(F.first("start").alias("start"), F.first("next_print").alias("next_print"))
    )
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - third), F.substr(F.coalesce("start", F.lit("")), F.lit(1), third))
    nameless = printed.filter("doc_id is null").select("*", F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("next_print"))
    both = own.join(starts, "doc_id", "left").unionByName(nameless).select("doc_id", F.length("text").cast("long").alias("n_chars"), "print", "next_print", edited.alias("edited"))
    done = both.withColumn("edited_print", fingerprint(F.col("edited")))
    nothing = fingerprint(F.lit(""))
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("print").alias("fingerprint"),
        F.col("edited_print").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.coalesce("next_print", nothing)).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))
