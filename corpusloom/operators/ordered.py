"""Order statistics of groups of any size: inversions by range buckets, sign tests by sums of vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.loops import cut

#: Rows of a group for each of its ranges, and ranges at most.
ROWS, RANGES = 4096, 128
#: Keys that a large group is dealt to where its rows meet its bounds.
SALTS = 64
#: Rows of a task in steps that keep every row.
TASK_ROWS = 2**18


def count_inversions(order: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each element how many earlier ones of the same ``order`` have a larger value; ``order`` rises."""
    rank = np.unique(value, return_inverse=True)[1].astype(np.int64)
    base = np.unique(order, return_inverse=True)[1].astype(np.int64)
    bits = int(rank.max(initial=0)).bit_length()
    key, found = base << bits | rank, np.zeros(len(value), dtype=np.int64)
    at = np.arange(len(value))
    for bit in range(bits - 1, -1, -1):
        # Elements with the same higher bits stand together, in their first order.
        head = key[at] >> bit + 1
        one = key[at] >> bit & 1
        ones = np.cumsum(one)
        start = np.flatnonzero(np.append(True, np.diff(head) != 0))
        before = np.repeat(ones[start] - one[start], np.diff(np.append(start, len(at))))
        found[at[one == 0]] += (ones - before)[one == 0]
        at = at[np.argsort(key[at] >> bit, kind="stable")]
    return found


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    """Where another group or range begins; the first row is one."""
    g, k = batch.column("g").dictionary_encode().indices.to_numpy(), batch.column("k").to_numpy()
    return np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (k[1:] != k[:-1])))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (g, k, wide, b, q) sorted by g and k the inversions of each (g, k), and those of rows with the same q."""
    held: list[pa.RecordBatch] = []

    def whole(rows: pa.Table) -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.concat_arrays(rows.column(c).chunks) for c in rows.column_names], rows.column_names)
        b, q, start = rows.column("b").to_numpy(), rows.column("q").to_numpy(), _starts(rows)
        run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(b))))
        by_q = np.lexsort((np.arange(len(b)), q, run))
        same = count_inversions(run[by_q] * (int(q.max(initial=0)) + 1) + q[by_q], b[by_q])
        every = count_inversions(run, b)
        one = rows.take(pa.array(start))
        return pa.RecordBatch.from_arrays([one.column("g"), one.column("wide"), pa.array(np.add.reduceat(every, start)), pa.array(np.add.reduceat(same, start))], names=["g", "wide", "m", "m_same"])

    for batch in batches:
        if batch.num_rows:
            last = int(_starts(batch)[-1])
            if last or (held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in ("g", "k"))):
                ready = [*held, batch.slice(0, last)] if not held or last else held
                done = pa.Table.from_batches([x for x in ready if x.num_rows])
                if done.num_rows:
                    yield whole(done)
                held = [batch.slice(last)]
            else:
                held.append(batch)
    if held:
        yield whole(pa.Table.from_batches(held))


def _inversions(rows: DataFrame, tasks: int) -> DataFrame:
    """(g, wide, m, m_same) of each (g, k) of rows (g, k, wide, a, b, q)."""
    sorted_ = rows.select("g", "k", "wide", "a", "b", "q").repartition(tasks, "g", "k").sortWithinPartitions("g", "k", "a", "b").select("g", "k", "wide", "b", "q")
    return sorted_.mapInArrow(_counted, "g string, wide boolean, m long, m_same long")


def group_key(group: str) -> Column:
    """A group's name as text, which no group lacks."""
    return F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))


def _meet(rows: DataFrame, large: DataFrame, columns: list[str], how: str) -> DataFrame:
    """``rows`` with what ``large`` has on their group ``g``, a row for each large one, whose rows are dealt to SALTS keys by ``columns``."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return rows.withColumn("salt", F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")).join(large.select("*", salts), ["g", "salt"], how).drop("salt")


def with_ranges(rows: DataFrame, sizes: DataFrame, ranged: dict[str, Column]) -> DataFrame:
    """``rows(g, ...)`` with an array of bounds for each of ``ranged``, null in groups of at most ROWS rows: values that part theirs evenly.

    ``ranged`` maps the names of the arrays to numbers. sizes(g, n).
    """
    shares = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
    columns = [c for c in rows.columns if c != "g"]
    wide = _meet(rows, sizes.filter(F.col("n") > ROWS).select("g", "n"), columns, "inner").groupBy("g")
    wide = wide.agg(F.first("n").alias("n"), *(F.percentile_approx(c, shares).alias(name) for name, c in ranged.items()))
    step = F.greatest(F.lit(1), F.floor(F.lit(RANGES * ROWS) / F.col("n"))).cast("int")
    bounds = wide.select("g", *(F.array_distinct(F.filter(name, lambda _, i: i % step == step - 1)).alias(name) for name in ranged))
    return _meet(rows, bounds, columns, "left")


def within(value: Column, bounds: str) -> Column:
    """Odd for a value that is a bound, which has a range of its own, even between two."""
    b = F.coalesce(F.col(bounds), F.array().cast("array<double>"))
    return (F.size(F.filter(b, lambda x: x < value)) + F.size(F.filter(b, lambda x: x <= value))).cast("long")


def kendall(rows: DataFrame, group: str) -> DataFrame:
    """(group, tau) of ``rows(group, a, b)``: the mean over pairs of rows of the sign of their two differences' product.

    Pairs that are equal in a or in b count 0; groups of one row are left out, and so are rows with a null in a or b.
    Discordant pairs are inversions of b in the order of (a, b). A group is cut into ranges of a and ranges of b, none of
    more than about ROWS rows but in the largest groups, and one for each frequent value, which has no inversions. Pairs
    that differ in both ranges follow from sums over the grid of counts; pairs in one range of a, and in one of b, are
    counted within tasks, and those in both only once. No pairs are made, and no task gets a large group whole.
    """
    numbers = rows.select(F.col(group).alias("own"), group_key(group).alias("g"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")).dropna(subset=["a", "b"])
    names = cut(numbers.groupBy("g").agg(F.first("own").alias("own"), F.count("*").alias("n")).filter("n > 1"))
    x = with_ranges(numbers.select("g", "a", "b"), names, {"ba": F.col("a"), "bb": F.col("b")})
    x = cut(x.select("g", "a", "b", F.coalesce(F.size("ba") + F.size("bb") > 0, F.lit(False)).alias("wide"), within(F.col("a"), "ba").alias("k"), within(F.col("b"), "bb").alias("q")))

    # Steps that keep every row have as many tasks as keep to TASK_ROWS rows or so.
    tasks = 1 + (names.agg(F.sum("n")).first()[0] or 0) // TASK_ROWS
    cells = cut(x.filter("wide").groupBy("g", "k", "q").agg(F.count("*").alias("n")))
    ends = cells.groupBy("g").agg(F.max("k").alias("mk"), F.max("q").alias("mq"))
    grid = ends.select("g", "mq", F.explode(F.sequence(F.lit(0).cast("long"), "mk")).alias("k")).select("g", "k", F.explode(F.sequence(F.lit(0).cast("long"), "mq")).alias("q"))
    full = grid.join(cells, ["g", "k", "q"], "left").fillna(0, ["n"])
    earlier = F.sum("n").over(W.partitionBy("g", "q").orderBy("k").rowsBetween(W.unboundedPreceding, -1))
    above = F.sum("earlier").over(W.partitionBy("g", "k").orderBy(F.desc("q")).rowsBetween(W.unboundedPreceding, -1))
    crossed = full.withColumn("earlier", F.coalesce(earlier, F.lit(0))).withColumn("above", F.coalesce(above, F.lit(0)))
    crossed = crossed.groupBy("g").agg(F.sum(F.col("n") * F.col("above")).alias("d"))

    # Where a group has one range of each, pairs within it are all that there are.
    in_a = _inversions(x.filter("k % 2 = 0"), tasks).select("g", F.when(F.col("wide"), F.col("m") - F.col("m_same")).otherwise(F.col("m")).alias("d"))
    in_b = _inversions(x.filter("wide and q % 2 = 0").withColumn("k", F.col("q")).withColumn("q", F.lit(0).cast("long")), tasks).select("g", F.col("m").alias("d"))
    discordant = in_a.unionByName(in_b).unionByName(crossed).groupBy("g").agg(F.sum("d").alias("d"))

    two = lambda *by: x.groupBy("g", *by).agg(F.count("*").alias("c")).groupBy("g").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("t_" + "".join(by)))
    same = x.repartition(tasks, "g", "a", "b").groupBy("g", "a", "b").agg(F.count("*").alias("c")).groupBy("g").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("t_ab"))
    whole = names.join(two("a"), "g").join(two("b"), "g").join(same, "g").join(discordant, "g", "left")
    every = F.col("n") * (F.col("n") - 1) / 2
    return whole.select(F.col("own").alias(group), ((every - F.col("t_a") - F.col("t_b") + F.col("t_ab") - 2 * F.coalesce("d", F.lit(0))) / every).alias("tau"))


def _signs(seed: int, sent: object, iterations: int) -> np.ndarray:
    """1 or -1 for each iteration: bits of the md5 of seed, sentence and number of 128 iterations, highest first."""
    raw = b"".join(hashlib.md5(f"{seed}:{sent}:{k}".encode()).digest() for k in range(-(-iterations // 128)))
    return 2 * np.unpackbits(np.frombuffer(raw, dtype=np.uint8))[:iterations].astype(np.int8) - 1


def randomisation_test(sentences: DataFrame, iterations: int = 10_000, seed: int = 1) -> DataFrame:
    """(difference, p) of ``sentences(sent, a, b)``: how often swapping systems by sentence gives as large a gap.

    A task sums its sentences' gaps, each with its sign in every iteration, in one vector; vectors are added by iteration.
    Sentences are told apart by their text form; rows with a null gap count as no gap. Without a sentence there is no row.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gap, n = np.zeros(iterations), 0.0, 0
        for batch in batches:
            for sent, own in zip(batch.column("sent").to_pylist(), batch.column("gap").to_pylist(), strict=True):
                gap, n = gap + own, n + 1
                total += own * _signs(seed, sent, iterations)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([list(total)], pa.list_(pa.float64())), pa.array([gap])], names=["total", "gap"])

    gaps = sentences.select(F.col("sent").cast("string").alias("sent"), F.coalesce(F.col("a").cast("double") - F.col("b").cast("double"), F.lit(0.0)).alias("gap"))
    vectors = cut(gaps.mapInArrow(summed, "total array<double>, gap double"))
    observed = vectors.agg(F.abs(F.sum("gap")).alias("difference")).filter("difference is not null")
    sums = vectors.select(F.posexplode("total").alias("i", "s")).groupBy("i").agg(F.abs(F.sum("s")).alias("s"))
    return sums.crossJoin(F.broadcast(observed)).groupBy("difference").agg(((F.count_if(F.col("s") >= F.col("difference") - 1e-12) + 1) / (F.count("*") + 1)).alias("p"))
