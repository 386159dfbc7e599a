"""What iterative operators share."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.lru_cache(maxsize=1)
def _test_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-checkpoints-")


def _shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or _test_folder())
    return folder or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder of ``spark.checkpoint.dir``; on one machine a temporary one where that is unset."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a table: a fraction of the bytes, and Spark knows its size when it plans a join.

    Shuffle files of what was written before and is no longer needed go.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def semi_naive(start: DataFrame, step: Callable[[DataFrame, int], DataFrame], keys: list[str], max_rounds: int = 50) -> DataFrame:
    """Rows from ``start`` on until ``step`` of the newest gives no row with new keys.

    ``step(delta, round)`` has start's columns; of rows with equal keys in a round one stays.
    """
    total = delta = cut(start.dropDuplicates(keys))
    for i in range(1, max_rounds + 1):
        delta = cut(step(delta, i).dropDuplicates(keys).join(total, keys, "left_anti"))
        if delta.isEmpty():
            return total
        total = total.unionByName(delta)
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")


def dealt(rows: DataFrame, key: str, own_parts: Column, other_parts: Column, own: str, other: str) -> DataFrame:
    """``rows`` of one side of a join, where each part of it meets each part of the other side.

    A row is in one of ``own_parts`` by its key, and there once for each of ``other_parts``; joined on both part columns as
    well, rows of a hot key meet in as many tasks as there are pairs of parts, each pair of rows once.
    """
    return rows.withColumn(own, F.pmod(F.xxhash64(key), own_parts).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), other_parts.cast("int") - 1)))
