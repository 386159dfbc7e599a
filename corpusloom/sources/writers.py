"""Writers. A sink that must be one file with a first line is told so; others stay partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scores(predictions: DataFrame, gold: DataFrame, key: str = "pair_id") -> DataFrame:
    """Predictions beside their gold values; a pair that one side lacks has none."""
    return predictions.join(gold, key)


def write_scores(predictions: DataFrame, gold: DataFrame, path: str, key: str = "pair_id") -> None:
    scores(predictions, gold, key).write.mode("overwrite").parquet(path)


def arff_lines(rows: DataFrame, relation: str, numeric: list[str], label: str, classes: list[str] | None = None) -> DataFrame:
    """place, line: a header, then the rows; a regression label is numeric, a class label is listed."""
    kind = "{" + ",".join(classes) + "}" if classes else "NUMERIC"
    head = [f"@RELATION {relation}", *(f"@ATTRIBUTE {c} NUMERIC" for c in numeric), f"@ATTRIBUTE {label} {kind}", "@DATA"]
    header = rows.sparkSession.createDataFrame(list(enumerate(head)), "place long, line string")
    data = rows.select(F.lit(len(head)).cast("long").alias("place"), F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in [*numeric, label])).alias("line"))
    return header.unionByName(data)


def write_arff(rows: DataFrame, path: str, relation: str, numeric: list[str], label: str, classes: list[str] | None = None) -> None:
    """One file, as the format asks for its header in front."""
    arff_lines(rows, relation, numeric, label, classes).orderBy("place").coalesce(1).select("line").write.mode("overwrite").text(path)


def submission(rte: DataFrame, sts: DataFrame, key: str = "instance") -> DataFrame:
    """Both predictions by instance without text columns."""
    return rte.select(key, F.col("prediction").alias("entailment")).join(sts.select(key, F.col("prediction").alias("relatedness")), key)


def write_submission(rte: DataFrame, sts: DataFrame, path: str, key: str = "instance") -> None:
    submission(rte, sts, key).write.mode("overwrite").csv(path, sep="\t", header=True)


def with_title_digit(docs: DataFrame) -> DataFrame:
    """``digit``: the first hex digit of the title's md5."""
    return docs.withColumn("digit", F.substring(F.md5(F.col("title").cast("binary")), 1, 1))


def write_hash_partitioned(docs: DataFrame, path: str) -> None:
    with_title_digit(docs).write.mode("overwrite").partitionBy("digit").parquet(path)


def numbered_questions(questions: DataFrame, doc: str, order: str) -> DataFrame:
    """Questions with a counter from 1 in each document."""
    return questions.withColumn("counter", F.row_number().over(W.partitionBy(doc).orderBy(order)))


def qid_feature_line(label: Column, qid: Column, features: Column, name: Column) -> Column:
    """``label qid:n i:v ... #name`` with features (an array) counted from 1, zeros left out."""
    pairs = F.filter(F.transform(features, lambda v, i: F.when(v != 0, F.concat_ws(":", (i + 1).cast("string"), v.cast("string")))), lambda x: x.isNotNull())
    return F.concat_ws(" ", label.cast("string"), F.concat(F.lit("qid:"), qid.cast("string")), F.array_join(pairs, " "), F.concat(F.lit("#"), name))


def thesaurus_entries(neighbours: DataFrame, frequencies: DataFrame) -> DataFrame:
    """obj, freq, entries (neighbour, score) in order."""
    lists = neighbours.groupBy("obj1").agg(F.sort_array(F.collect_list(F.struct("place", F.col("obj2").alias("neighbour"), "score"))).alias("entries"))
    return lists.join(frequencies, F.col("obj1") == F.col("obj")).select("obj", "freq", F.transform("entries", lambda e: F.struct(e["neighbour"].alias("neighbour"), e["score"].alias("score"))).alias("entries"))


def experiment_report(results: DataFrame, experiment: str) -> DataFrame:
    return results.withColumn("experiment", F.lit(experiment)).withColumn("at", F.current_timestamp())


def append_report(results: DataFrame, path: str, experiment: str) -> None:
    experiment_report(results, experiment).write.mode("append").parquet(path)


def graphviz(edges: DataFrame, graph: str) -> DataFrame:
    """graph, text: a digraph of labelled edges ``(graph, src, dst, label)``, edges sorted."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    line = F.concat(F.lit("  "), quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(" [label="), quoted("label"), F.lit("];"))
    return edges.groupBy(graph).agg(F.concat(F.lit("digraph {\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n"), F.lit("\n}")).alias("text"))
