"""Readers. Files have no order in Spark: where a line's place matters it is a column from the start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.corpus import dense_ids


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = False, sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, sep=sep, schema=schema, header=header, quote="")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return parse_pairs(spark.read.text(path))


def parse_pairs(lines: DataFrame) -> DataFrame:
    """pair_id, text, hyp of tab-separated ``lines(value)`` with the id in front; an id that is no number is null."""
    return _fields(lines, "pair_id long, text string, hyp string")


def _fields(lines: DataFrame, schema: str) -> DataFrame:
    return lines.filter(F.trim("value") != "").select(F.from_csv("value", F.lit(schema), {"sep": "\t", "quote": ""}).alias("x")).select("x.*")


def attach_gold(pairs: DataFrame, gold: DataFrame, key: str = "pair_id") -> DataFrame:
    """Pairs with their gold row; an id that one side lacks is an error."""
    from corpusloom.operators.keyed import zip_safe

    return zip_safe(pairs, gold, key)


def map_labels(label: Column, names: dict[float, str]) -> Column:
    """A label's name; an unknown label is an error."""
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    found = F.try_element_at(known, label)
    return F.when(label.isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown label "), label.cast("string"))).cast("string"))


def parse_vectors(lines: DataFrame, kind: str) -> DataFrame:
    """(word, dim, w) of ``lines(value)``: dense (word and values), sparse (word, dim, value) or interleaved (word, then names and values)."""
    parts = F.split("value", "\t")
    rest = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.trim(x) != "")
    if kind == "sparse":
        return lines.select(parts[0].alias("word"), parts[1].alias("dim"), parts[2].cast("double").alias("w"))
    if kind == "dense":
        return lines.select(parts[0].alias("word"), F.posexplode(rest).alias("i", "v")).select("word", F.col("i").cast("string").alias("dim"), F.col("v").cast("double").alias("w"))
    paired = F.transform(F.sequence(F.lit(0), (F.size(rest) / 2).cast("int") - 1), lambda i: F.struct(F.get(rest, i * 2).alias("dim"), F.get(rest, i * 2 + 1).cast("double").alias("w")))
    return lines.filter(F.size(rest) > 1).select(parts[0].alias("word"), F.explode(paired).alias("x")).select("word", "x.dim", "x.w")


def vector_format(line: Column) -> Column:
    """What detect_vector_format says, of each line where it is; null for a null."""
    fields = F.split(F.rtrim(line), "\t")
    rest = F.slice(fields, F.lit(2), F.size(fields))
    number = lambda x: F.trim(x).try_cast("double").isNotNull()
    return F.when(F.forall(rest, number), "dense").when(F.size(fields) == 3, "sparse").when(line.isNotNull(), "interleaved")


def detect_vector_format(first_line: str) -> str:
    """dense if all fields after the word are numbers, sparse if there are three fields, else interleaved."""

    def number(x: str) -> bool:
        try:
            float(x)
        except ValueError:
            return False
        return True

    fields = first_line.rstrip("\n").split("\t")
    if all(map(number, fields[1:])):
        return "dense"
    return "sparse" if len(fields) == 3 else "interleaved"


def read_vectors(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(word, dim, w); the format is told by the first line unless given."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    first = lines.first()
    return parse_vectors(lines, kind or detect_vector_format(first["value"] if first else ""))


def dim_index(vectors: DataFrame) -> DataFrame:
    """(dim, index): dims of a vector table numbered from 0 by name, within ranges of names."""
    ids = dense_ids(vectors.select(F.col("dim").alias("value")).distinct().withColumn("n", F.lit(1).cast("long")))
    return ids.select(F.col("value").alias("dim"), (F.col("id") - 1).cast("int").alias("index"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, "rule_id string, lhs string, rhs string, score double")


def read_named_rules(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """Rules with a header line; the named columns become doubles, null where they aren't numbers."""
    lines = spark.read.text(path)
    header = lines.filter(F.trim("value") != "").first()
    return parse_named_rules(lines, header["value"], numbers)


def parse_named_rules(lines: DataFrame, header: str, numbers: list[str]) -> DataFrame:
    """Columns named by the ``header`` line, which is itself left out, of tab-separated ``lines(value)``."""
    raw = _fields(lines.filter(F.col("value") != header), ", ".join(f"`{c}` string" for c in header.split("\t")))
    return raw.withColumns({c: F.col(c).try_cast("double") for c in numbers})


def parse_delimited(lines: DataFrame, delimiter: str, length: int) -> tuple[DataFrame, DataFrame]:
    """Fields of lines that have ``length`` of them, and the rejected lines; blanks and ``//`` comments are neither."""
    kept = lines.filter((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("//")))
    split = kept.withColumn("fields", F.split("value", delimiter))
    return split.filter(F.size("fields") == length).select("fields"), split.filter(F.size("fields") != length).select("value")


def int_column(fields: DataFrame, position: int) -> DataFrame:
    return fields.select(F.get("fields", F.lit(position)).try_cast("int").alias("value"))


def load_facts(rows: DataFrame, args: list[str], truth: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Facts with truth (1 by default), and the rows whose truth isn't in [0, 1]."""
    t = F.col(truth).try_cast("double") if truth else F.lit(1.0)
    out = rows.select(*(F.col(c).alias(f"a{i}") for i, c in enumerate(args, 1)), t.alias("truth"))
    good = F.coalesce(F.col("truth").between(0.0, 1.0), F.lit(False))
    return out.filter(good), out.filter(~good)


def route_facts(fields: DataFrame, position: int, arities: dict[str, int]) -> DataFrame:
    """(predicate, args) of rows that name a known predicate and have its arguments; others are skipped."""
    known = F.create_map(*(F.lit(x) for kv in arities.items() for x in kv))
    name = F.get("fields", F.lit(position))
    args = F.filter("fields", lambda x, i: i != position)
    return fields.select(name.alias("predicate"), args.alias("args")).filter(F.size("args") == F.try_element_at(known, F.col("predicate")))


def facts_from_wide(rows: DataFrame, identity: str) -> DataFrame:
    """(predicate, id, value): column names are predicates; nulls give no fact."""
    names = [c for c in rows.columns if c != identity]
    return rows.select(identity, *(F.col(c).cast("string") for c in names)).unpivot(identity, names, "predicate", "value").filter("value is not null").select("predicate", F.col(identity).alias("id"), "value")


def facts_from_matrix(rows: DataFrame, identity: str) -> DataFrame:
    """(a1, a2, truth): cells that are numbers."""
    return facts_from_wide(rows, identity).select(F.col("id").alias("a1"), F.col("predicate").alias("a2"), F.col("value").try_cast("double").alias("truth")).filter("truth is not null")


def facts_from_entity_matrix(rows: DataFrame, identity: str) -> DataFrame:
    """(row, col, cell): cells that aren't blank."""
    return facts_from_wide(rows, identity).filter(F.trim("value") != "").select(F.col("id").alias("row"), F.col("predicate").alias("col"), F.col("value").alias("cell"))


def read_graph(entities: DataFrame, relations: DataFrame, create: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vertices ``(id, type)`` and edges ``(src, dst, label)``: edges between known ends, or ends added without a type."""
    if not create:
        ids = entities.select("id").distinct()
        inside = relations.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return entities, inside.select("src", "dst", "label")
    ends = relations.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(entities.select("id"), "id", "left_anti")
    return entities.select("id", "type").unionByName(ends.withColumn("type", F.lit(None).cast("string"))), relations.select("src", "dst", "label")


def parse_model_spec(lines: DataFrame) -> DataFrame:
    """(kind, name, args) of lines ``kind, name, args...``: predicate, prior, constraint and data."""
    fields = F.transform(F.split("value", ","), lambda x: F.trim(x))
    return lines.select(F.lower(fields[0]).alias("kind"), F.get(fields, F.lit(1)).alias("name"), F.slice(fields, F.lit(3), F.size(fields)).alias("args")).filter(F.col("kind").isin("predicate", "prior", "constraint", "data"))


def read_doc_dump(spark: SparkSession, path: str) -> DataFrame:
    """id, title, text of ``<doc id=".." title="..">`` blocks; a record is one block."""
    return parse_doc_dump(spark.read.option("lineSep", "<doc ").text(path))


def parse_doc_dump(records: DataFrame) -> DataFrame:
    head = F.regexp_extract("value", "^([^>]*)>", 1)
    body = F.regexp_extract("value", "(?s)^[^>]*>(.*?)</doc>", 1)
    out = records.filter(F.contains("value", F.lit("</doc>"))).select(F.regexp_extract(head, 'id="([^"]*)"', 1).alias("id"), F.regexp_extract(head, 'title="([^"]*)"', 1).alias("title"), body.alias("body"))
    return out.select("id", "title", F.concat(F.col("title"), F.lit(".\n"), F.regexp_replace("body", "^\\s+|\\s+$", "")).alias("text"))


def filter_docs_by_title(docs: DataFrame, titles: DataFrame) -> DataFrame:
    return docs.join(titles.select("title").distinct(), "title", "left_semi")


def parse_questions(files: DataFrame) -> DataFrame:
    """title, context, question, answer, entities (id, name) of files (value) in blocks parted by a blank line."""
    b = F.split(F.col("value"), "\n\n")
    entities = F.transform(F.filter(F.split(F.get(b, F.lit(4)), "\n"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.substring_index(x, ":", 1).alias("id"), F.regexp_replace(x, "^[^:]*:", "").alias("name")))
    return files.select(*(F.get(b, F.lit(i)).alias(n) for i, n in enumerate(("title", "context", "question", "answer"))), entities.alias("entities"))


def deanonymise(text: Column, entities: Column) -> Column:
    """Entity ids in a text replaced by their names, whole tokens only."""
    return F.trim(F.aggregate(entities, F.concat(F.lit(" "), text, F.lit(" ")), lambda t, e: F.replace(t, F.concat(F.lit(" "), e["id"], F.lit(" ")), F.concat(F.lit(" "), e["name"], F.lit(" ")))))


def read_relation_counts(spark: SparkSession, path: str) -> DataFrame:
    """(f, obj, attr) of space-separated lines."""
    return read_tsv(spark, path, "f long, obj string, attr string", sep=" ")


def merge_common_counts(counts: DataFrame, common: DataFrame) -> DataFrame:
    """Counts of ``common`` take the place of those of the same objects."""
    return counts.join(common.select("obj").distinct(), "obj", "left_anti").unionByName(common)


def with_given_totals(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """relation_counts with the attribute totals ``(attr, fa, na)`` of a file instead of its own."""
    given = totals.select("attr", F.col("fa").alias("given_fa"), F.col("na").alias("given_na"))
    return counts.join(given, "attr", "left").withColumn("fa", F.coalesce("given_fa", "fa")).withColumn("na", F.coalesce("given_na", "na")).drop("given_fa", "given_na")


def parse_features(lines: DataFrame) -> DataFrame:
    """label, qid, features (map of int to double), name of ``label qid:n i:v ... #name`` lines."""
    body, name = F.substring_index("value", "#", 1), F.regexp_extract("value", "#(.*)$", 1)
    parts = F.filter(F.split(F.trim(body), "\\s+"), lambda x: x != "")
    pairs = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda p: ~F.startswith(p, F.lit("qid:")))
    entries = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, ":", 1).cast("int"), F.substring_index(p, ":", -1).cast("double"))))
    return lines.select(parts[0].cast("double").alias("label"), F.nullif(F.regexp_extract(body, "qid:(\\d+)", 1), F.lit("")).cast("long").alias("qid"), entries.alias("features"), F.nullif(F.trim(name), F.lit("")).alias("name"))


def parse_scores(lines: DataFrame) -> DataFrame:
    """place, parse, score of bracketed lines such as ``[0.1,0.2 0.3,0.4]``: rows by space, parses by comma."""
    bare = F.regexp_replace("value", "[\\[\\]]", "")
    rows = lines.select(F.posexplode(F.split(F.trim(bare), "\\s+")).alias("place", "row"))
    return rows.select("place", F.posexplode(F.split("row", ",")).alias("parse", "score")).withColumn("score", F.col("score").cast("double"))


def parse_predictions(lines: DataFrame, marker: str = "inst#") -> DataFrame:
    """fields of ``lines(n, value)`` after the first with the marker."""
    start = lines.filter(F.contains("value", F.lit(marker))).agg(F.min("n").alias("start"))
    return lines.crossJoin(F.broadcast(start)).filter("n > start").filter(F.trim("value") != "").select("n", F.split(F.trim("value"), "\\s+").alias("fields"))  # one row


def select_range(rows: DataFrame, identity: str, ranges: str) -> DataFrame:
    """Rows with an id in ranges such as ``4-6,9`` or ``7-``."""
    keep = F.lit(False)
    for part in filter(None, ranges.split(",")):
        low, dash, high = part.partition("-")
        c = F.col(identity)
        keep = keep | ((c == int(low)) if not dash else (c >= int(low)) if not high else c.between(int(low), int(high)))
    return rows.filter(keep)


def batch_range(rows: DataFrame, identity: str, step: int) -> DataFrame:
    """Rows with ``batch``: ids from (i - 1) * step + 1 to i * step are batch i."""
    return rows.withColumn("batch", F.floor((F.col(identity) - 1) / step) + 1)


def filter_pairs_by_id(pairs: DataFrame, ids: list[int], identity: str = "pair_id") -> DataFrame:
    return pairs.filter(F.col(identity).isin(ids))
