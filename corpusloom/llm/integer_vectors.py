"""Vectors of floats as vectors of integers, which operators can sum and compare exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut

#: Components become floor(SCALE * x), and may be LIMIT at most, so that sums of up to 256 products fit 64 bits.
SCALE, LIMIT = 256, 1 << 27


def integers(vector: Column) -> Column:
    """floor(SCALE * x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))


def usable(vector: Column) -> Column:
    """True for a vector with components that are all finite and no larger than a product of two has room for."""
    within = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < LIMIT // SCALE, F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & within


def numbered(rows: DataFrame, multiple: int = 1) -> DataFrame:
    """Usable rows of (vec_id, label, embedding) as row, vec_id, label, v, where ``row`` numbers them.

    All vectors have the length of that of the smallest vec_id (a null one comes last), which is a multiple of
    ``multiple``; rows with another length, and with an empty vector, count as rows without a vector. Repeated rows
    stay apart. They are in a checkpoint, so that a row has the same number whenever it is read.
    """
    kept = rows.select("vec_id", "label", "embedding").where(usable(F.col("embedding")) & (F.size("embedding") % multiple == 0))
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").select(F.size("embedding")).head()
    kept = kept.where(F.size("embedding") == (first[0] if first else 0))
    return cut(kept.select("vec_id", "label", integers(F.col("embedding")).alias("v"))).select(F.monotonically_increasing_id().alias("row"), "*")


def matrix(vectors: pa.Array) -> np.ndarray:
    """A row of 64-bit integers for each vector, which are as long as each other."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(vectors), -1)
