"""Helpers that several operators share: reading tables, hash folds, cutting lineage."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; null for a null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def hash_fraction(column: str, seed: int) -> Column:
    """A repeatable number in [0, 1) from the column's value."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(1 << 30)) / F.lit(float(1 << 30))


@functools.lru_cache(maxsize=1)
def _local_checkpoint_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-checkpoints-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Where that is unset a temporary folder stands in for it on one machine (tests); elsewhere it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or _local_checkpoint_folder())
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as a checkpoint and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: like ``cut``, with columns packed, so a fraction of the bytes."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(spark: SparkSession) -> None:
    """Have shuffle files deleted that nothing refers to any more, such as those behind a table ``written``.

    Spark does so when the driver's garbage is next collected, which by itself may be half an hour later.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
