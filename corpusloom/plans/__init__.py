"""Queries over the given tables, one or more for each operator, with their SQL.

A module's QUERIES maps a name to (query, SQL or None). Names begin with the inventory's id.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("text", "thesaurus", "nearest", "corpus", "evaluate", "vectors", "graph", "softlogic", "rules", "qa", "features", "tables")


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(f"corpusloom.plans.{name}").QUERIES
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all().items() if s}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest objects of each by Jaccard over ttestcut weights."""
    return queries()["T27_neighbours"](spark, sf_dir)
