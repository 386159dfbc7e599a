"""SimHash near-duplicates with bit-sliced comparison.

A text becomes a 64-bit fingerprint. Distinct fingerprints, not documents, are compared:
exact copies cost one row. Fingerprints within ``RADIUS`` bits agree on two of six bit groups,
so each is dealt to the 15 pairs of groups and compared within the rows that share a key.
Comparison is bit-sliced: the 64 bits stand as planes of machine words, one lane a fingerprint;
carry-save counters add up differing planes for many queries and lanes at a time. A block is one
query against the 64 lanes of a word: once all of these have passed the radius it is given up, and
only the blocks left are gone on with. Rows compared with themselves are compared above the
diagonal. What is found comes as a spanning forest, so a group of near copies gives as many rows
as members and not all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, table
from corpusloom.llm.components import components

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Bit groups as (lowest bit, width); RADIUS differing bits leave two groups alike.
GROUPS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Rows of a key that one task compares with one another; keys with more are split.
BLOCK = 4096
#: Rows of small keys that are compared in one go.
TILE = 512
#: Blocks of 64 lanes that are compared at once, and the bits after which those beyond the radius are given up.
STEP_CELLS, LOOKS = 1 << 15, (19, 27, 35, 43, 51)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash; 0 for a null or a text without words."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint_udf():
    """A column function: text to the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        prints = np.array([fingerprint(t) for t in texts.to_pylist()], dtype=np.uint64)
        return pa.array(prints.view(np.int64))

    return run


def planes(prints: np.ndarray) -> np.ndarray:
    """Fingerprints as 64 rows of lane words; lanes past the end are filled up with zeros."""
    n = -(-len(prints) // 64) * 64
    padded = np.zeros(n, dtype=np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _beyond(low: np.ndarray, mid: np.ndarray, high: np.ndarray, over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count, three bits and an overflow, is larger than ``radius``, bit by bit from the top."""
    more, same = over.copy(), ~over
    for counter, place in ((high, 4), (mid, 2), (low, 1)):
        if radius & place:
            same &= counter
        else:
            more |= same & counter
            same &= ~counter
    return more


def near(queries: np.ndarray, lanes: np.ndarray, radius: int = RADIUS, own: bool = False, left: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (query, lane) at ``radius`` or fewer differing bits, at most 7, some queries at a time.

    With ``own`` the queries are the lanes, and each pair comes once, the smaller index first.
    ``left`` gets how many blocks there were, and how many were left after each look.
    """
    if not len(queries) or not len(lanes):
        return
    sliced = planes(lanes)
    words = np.arange(sliced.shape[1])
    step = max(1, STEP_CELLS // sliced.shape[1])
    for q0 in range(0, len(queries), step):
        block = queries[q0 : q0 + step]
        rows = np.arange(q0, q0 + len(block))
        query, word = np.nonzero(words[None, :] * 64 + 63 > rows[:, None]) if own else np.divmod(np.arange(len(block) * len(words)), len(words))
        flips = [np.where((block >> np.uint64(bit)) & np.uint64(1), _ONES, np.uint64(0)) for bit in range(64)]
        count = [np.zeros(len(query), dtype=np.uint64) for _ in range(4)]
        # Lanes that don't count are over from the start: those past the end, and those up to the diagonal.
        if len(lanes) % 64:
            count[3][word == words[-1]] = _ONES << np.uint64(len(lanes) % 64)
        if own:
            on = word == rows[query] // 64
            count[3][on] |= _ONES >> (np.uint64(63) - (rows[query[on]] % 64).astype(np.uint64))
        looks = [len(query)]
        for bit in range(64):
            carry = flips[bit][query] ^ sliced[bit][word]
            for counter in count[:3]:
                carry, counter[:] = counter & carry, counter ^ carry
            count[3] |= carry
            if bit in LOOKS:
                alive = _beyond(*count, radius) != _ONES
                query, word, count = query[alive], word[alive], [c[alive] for c in count]
                looks.append(len(query))
        if left is not None:
            left[:] = looks if not left else [a + b for a, b in zip(left, looks, strict=True)]
        hit = ~_beyond(*count, radius)
        bits = np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cell, lane = np.nonzero(bits)
        yield query[cell] + q0, word[cell] * 64 + lane


def _block_links(left: np.ndarray, right: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``left``, or between it and ``right``; no print is on both sides."""
    prints = left if right is None else np.concatenate([left, right])
    tree = np.arange(len(prints))
    found = []
    for query, lane in near(left, left if right is None else right, own=right is None):
        lane = lane if right is None else lane + len(left)
        edges = [*np.flatnonzero(np.diff(query, prepend=-1)).tolist(), len(query)]
        for start, end in itertools.pairwise(edges):
            q, others = query[start], lane[start:end]
            others = others[tree[others] != tree[q]]
            if len(others):
                roots, first = np.unique(tree[others], return_index=True)
                found += [(int(prints[q]), int(prints[x])) for x in others[first]]
                tree[np.isin(tree, roots)] = tree[q]
    return np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64).tolist()


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, side, print) sorted by place: links within each place, or between its two sides."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    waiting: list[np.ndarray] = []
    held = 0
    part = {0: [], 1: []}
    at = None

    def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], schema=schema)

    def tile() -> list[tuple[int, int]]:
        nonlocal waiting, held
        rows = np.unique(np.concatenate(waiting)) if waiting else np.empty(0, dtype=np.uint64)
        waiting, held = [], 0
        return _block_links(rows)

    def done() -> list[tuple[int, int]]:
        nonlocal part, held
        left, right = (np.concatenate(part[s]) if part[s] else np.empty(0, dtype=np.uint64) for s in (0, 1))
        part = {0: [], 1: []}
        if len(right):
            return _block_links(left, right)
        if len(left) < 2:
            return []
        if len(left) > TILE:
            return _block_links(left)
        waiting.append(left)
        held += len(left)
        return tile() if held >= TILE else []

    for batch in batches:
        place, side = batch.column("place").to_numpy(), batch.column("side").to_numpy()
        prints = batch.column("print").to_numpy().view(np.uint64)
        edges = np.flatnonzero(np.diff(place)) + 1
        for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(place)], strict=True):
            if start == stop:
                continue
            if place[start] != at:
                pairs = done()
                if pairs:
                    yield out(pairs)
                at = place[start]
            sides, rows = side[start:stop], prints[start:stop].copy()
            for s in (0, 1):
                if (sides == s).any():
                    part[s].append(rows[sides == s])
    pairs = done() + tile()
    if pairs:
        yield out(pairs)


def link_fingerprints(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct ``print`` values within RADIUS bits.

    Keys with over ``block`` rows are split by hash into parts, and each pair of parts is a
    place of its own: more tasks, no larger ones, and no pair is left out.
    """
    keys = [
        F.struct(
            F.lit(i).alias("t"),
            *(F.shiftrightunsigned(F.col("print"), GROUPS[g][0]).bitwiseAND((1 << GROUPS[g][1]) - 1).alias(name) for g, name in zip(pair, ("x", "y"), strict=True)),
        )
        for i, pair in enumerate(itertools.combinations(range(len(GROUPS)), 2))
    ]
    dealt = prints.select("print", F.explode(F.array(*keys)).alias("k")).select("print", (F.col("k.t") * (1 << 22) + F.col("k.x") * (1 << 11) + F.col("k.y")).alias("key"))
    sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    parts = F.ceil(F.col("n") / F.lit(float(block))).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(7), "print"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    placed = (
        dealt.join(sizes, "key")
        .withColumn("parts", parts)
        .withColumn("mine", mine)
        .withColumn("other", other)
        .select(
            "print",
            F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"),
            F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("place"),
        )
    )
    return placed.repartition("place").sortWithinPartitions("place").mapInArrow(_links, "a long, b long")


def simhash_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and link like any other. component_id is the
    smallest doc_id that is reachable; rows without doc_id are linked too, and a component of
    such rows alone has a null. Repeated rows each give a row. Other columns are not read.
    """
    prints = cut(docs.select("doc_id", fingerprint_udf()(F.col("text")).alias("print")))
    distinct = cut(prints.groupBy("print").agg(F.min("doc_id").alias("first_id")))
    # A node is a fingerprint with its smallest doc_id before it, nulls last, so that the least node of a component names it.
    node = F.struct(F.col("first_id").isNull().alias("nameless"), "first_id", "print")
    nodes = distinct.select("print", node.alias("node"))
    edges = link_fingerprints(distinct.select("print"))
    for side in ("a", "b"):
        edges = edges.join(nodes.select(F.col("print").alias(side), F.col("node").alias(f"{side}_node")), side)
    joined = components(edges.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    named = joined.select("node.print", F.col("component.first_id").alias("component_id"), F.lit(True).alias("linked"))
    # Written first, so that Spark can split the rows of a fingerprint that many documents have.
    of_print = cut(distinct.join(named, "print", "left").select("print", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id")))
    return prints.join(of_print, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with the smallest doc_id of their component; of repeated ids one row stays.

    Rows without a doc_id stay only if no row of their component has one, one a fingerprint.
    """
    found = cut(simhash_components(docs))
    ids = found.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(ids, "doc_id", "left_semi")
    if docs.select("doc_id").filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id"])
    if found.filter("doc_id is null and component_id is null").limit(1).count():
        nameless = docs.filter("doc_id is null")
        loose = found.filter("doc_id is null and component_id is null").select("fingerprint").distinct()
        own = F.lower(F.lpad(F.hex(fingerprint_udf()(F.col("text"))), 16, "0"))
        lone = nameless.withColumn("__print", own).join(loose.withColumnRenamed("fingerprint", "__print"), "__print", "left_semi")
        kept = kept.unionByName(lone.dropDuplicates(["__print"]).drop("__print"))
    return kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
