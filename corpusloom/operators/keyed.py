"""Keyed-collection helpers as table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.logic import coin


def count_compare(rows: DataFrame, keys: list[str], condition: Column, n: int) -> DataFrame:
    """keys, order: -1, 0 or 1 as fewer, as many or more than n rows meet the condition."""
    return rows.groupBy(*keys).agg(F.signum(F.count_if(condition) - n).cast("int").alias("order"))


def sum_and_average(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(value).alias("sum"), F.avg(value).alias("avg"))


def map_to(rows: DataFrame, key: str, **columns: Column) -> DataFrame:
    """The key with new columns beside it."""
    return rows.select(key, *(c.alias(n) for n, c in columns.items()))


def sliding_pairs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, a, b: neighbours by order."""
    after = F.lead(value).over(W.partitionBy(key).orderBy(order))
    exists = F.lead(F.lit(True)).over(W.partitionBy(key).orderBy(order))
    return rows.select(key, F.col(value).alias("a"), after.alias("b"), exists.alias("exists")).filter("exists").drop("exists")


def group_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, values: sorted arrays. For bounded groups."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("values"))


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def merge_by_key(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Two tables of arrays by key as one, arrays sorted together."""
    return a.unionByName(b).groupBy(key).agg(F.sort_array(F.flatten(F.collect_list(value))).alias(value))


def sum_by_key(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    return a.unionByName(b).groupBy(key).agg(F.sum(value).alias(value))


def ungroup(rows: DataFrame, key: str, values: str) -> DataFrame:
    return rows.select(key, F.explode(values).alias("value"))


def take_sub(rows: DataFrame, key: str, order: str, values: str, n: int) -> DataFrame:
    """Of a key's arrays in order the first n elements in all; the last array is cut."""
    before = F.coalesce(F.sum(F.size(values)).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(n) - F.col("before")
    return rows.withColumn("before", before).filter(left > 0).withColumn(values, F.slice(values, F.lit(1), F.least(left.cast("int"), F.size(values)))).drop("before")


def shuffled(rows: DataFrame, seed: int, *identity: str) -> DataFrame:
    """All rows with ``place``: a repeatable random number; sorted by it."""
    return rows.withColumn("place", coin(seed, *identity)).orderBy("place", *identity)


def split_runs(rows: DataFrame, key: str, order: str, delimiter: Column) -> DataFrame:
    """Rows but the delimiters, with the number of their run."""
    run = F.sum(delimiter.cast("int")).over(W.partitionBy(key).orderBy(order))
    return rows.withColumn("run", run).filter(~delimiter)


def split_at(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Rows with ``first``: whether they are among a key's first n."""
    return rows.withColumn("first", F.row_number().over(W.partitionBy(key).orderBy(order)) <= n)


def drop_right_while(rows: DataFrame, key: str, order: str, condition: Column) -> DataFrame:
    """A key's rows up to the last that doesn't meet the condition."""
    stop = F.max(F.when(~condition, F.col(order))).over(W.partitionBy(key))
    return rows.withColumn("stop", stop).filter(F.col(order) <= F.col("stop")).drop("stop")


def zip_safe(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Join one to one by key; a key that one side lacks is an error."""
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), key, "full")
    checked = F.when(F.col("in_a") & F.col("in_b"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no partner for "), F.col(key).cast("string"))).cast(dict(both.dtypes)[key]))
    return both.withColumn(key, checked).drop("in_a", "in_b")


def normalise(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``share``: the value over the sum of its key; null where that is 0."""
    return rows.withColumn("share", F.col(value) / F.nullif(F.sum(value).over(W.partitionBy(key)), F.lit(0)))


def partition_n(rows: DataFrame, group: Column, n: int) -> DataFrame:
    """Counts of groups 0 to n - 1, empty ones too."""
    sizes = rows.groupBy(group.cast("long").alias("id")).agg(F.count("*").alias("rows"))
    return rows.sparkSession.range(n).join(sizes, "id", "left").select(F.col("id").alias("group"), F.coalesce("rows", F.lit(0)).alias("rows"))


def history(rows: DataFrame, key: str, order: str, value: str, length: int, lag: int) -> DataFrame:
    """``history``: every lag-th of the last ``length`` values, the newest first."""
    recent = F.reverse(F.collect_list(value).over(W.partitionBy(key).orderBy(order).rowsBetween(-(length - 1), 0)))
    return rows.withColumn("history", F.filter(recent, lambda v, i: i % lag == 0))


def range_string(ids: DataFrame, key: str, value: str) -> DataFrame:
    """Runs of consecutive numbers such as ``4-6,9``."""
    rows = ids.select(key, value).distinct()
    island = F.col(value) - F.row_number().over(W.partitionBy(key).orderBy(value))
    runs = rows.withColumn("island", island).groupBy(key, "island").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    text = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws("-", "low", "high"))
    return runs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", text.alias("t")))), lambda x: x["t"]), ",").alias("ranges"))
