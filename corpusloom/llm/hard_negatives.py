"""Hard negatives by bounds along spanning trees of anchors.

Anchors go out in chunks of a fixed size, cut into trees: in each, a least spanning tree by distance.
A task goes over its candidates block by block and down each tree. A candidate's score at a child is
its score at the parent, or the bounds of that, plus or minus the edge's distance times the
candidate's norm (Cauchy and Schwarz); only candidates whose bounds overlap what the child still
looks for are scored again, exactly in integers. That is, for positives, all from the worst score of
the best so far, and for negatives the windows, from the worst of the best so far too. A task returns
its best for each anchor, and the best of these are found by anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, table
from corpusloom.llm.integer_vectors import matrix, numbered

EVERY, POSITIVES, NEGATIVES = 100, 5, 10
#: A negative's score is LOW to HIGH hundredths of the positive's.
LOW, HIGH = 30, 90
#: Anchors that a pass over the candidates takes along (about; 16 MB at 64 components), and anchors of a tree.
CHUNK, TREE = 16_384, 256
#: Candidates that a task scores at a time.
BLOCK = 2048
#: Sums of integers below this are exact in floats, whose products are the quicker ones.
EXACT = 1 << 53
#: Share of the norms' product that floats may be wrong by.
SLIP = 1e-9
LAST = np.iinfo(np.int64).max

SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Tree:
    """Anchors in an order in which parents come first; the first has parent -1."""

    rows: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    parents: list[int]
    edges: np.ndarray


def spanning_tree(rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Tree:
    """The least spanning tree of a few anchors, grown from the first one by the nearest anchor outside it."""
    v = vectors.astype(float)
    square = (v * v).sum(axis=1)
    order, parents, edges = [0], [-1], [0.0]
    nearest, parent = np.full(len(v), np.inf), np.zeros(len(v), dtype=np.int64)
    outside = np.ones(len(v), dtype=bool)
    outside[0] = False
    while len(order) < len(v):
        distance = square + square[order[-1]] - 2 * (v @ v[order[-1]])
        nearer = outside & (distance < nearest)
        nearest[nearer], parent[nearer] = distance[nearer], len(order) - 1
        at = int(np.where(outside, nearest, np.inf).argmin())
        edges.append(float(np.sqrt(((v[at] - v[order[parent[at]]]) ** 2).sum())))
        parents.append(int(parent[at]))
        order.append(at)
        outside[at] = False
    return Tree(rows[order], labels[order], vectors[order], np.sqrt(square[order]), parents, np.array(edges))


def _scan(tree: Tree, vectors: np.ndarray, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Down the tree, each anchor's place, the candidates that ``wanted`` picks by their bounds, and their scores."""
    largest = max(int(np.abs(vectors).max(initial=0)), int(np.abs(tree.vectors).max(initial=0)))
    kind = np.float64 if largest * largest * vectors.shape[1] < EXACT else np.int64
    exact, anchors = vectors.astype(kind), tree.vectors.astype(kind)
    floats = vectors.astype(float)
    norms = np.sqrt((floats * floats).sum(axis=1))
    low = np.empty((len(anchors), len(vectors)))
    high = np.empty_like(low)
    for i, parent in enumerate(tree.parents):
        reach = tree.norms[i] * norms
        if parent < 0:
            low[i], high[i] = -reach * (1 + SLIP) - 1, reach * (1 + SLIP) + 1
        else:
            slack = tree.edges[i] * norms * (1 + SLIP) + SLIP * (reach + tree.norms[parent] * norms) + 1
            low[i], high[i] = low[parent] - slack, high[parent] + slack
        at = np.flatnonzero(wanted(i, low[i], high[i]))
        if len(at):
            score = (exact[at] @ anchors[i]).astype(np.int64)
            low[i, at] = high[i, at] = score
            yield i, at, score


class _Best:
    """The first ``size`` of (score, id, row), by score descending and id ascending; a null id is LAST."""

    def __init__(self, size: int) -> None:
        self.size, self.found = size, np.empty((0, 3), dtype=np.int64)

    def worst(self) -> float:
        return float(self.found[-1, 0]) if len(self.found) == self.size else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(score) > 8 * self.size:
            least = np.partition(score, -self.size)[-self.size]
            kept = score >= least
            score, ids, rows = score[kept], ids[kept], rows[kept]
        found = np.concatenate([self.found, np.stack([score, ids, rows], axis=1)])
        self.found = found[np.lexsort((found[:, 2], found[:, 1], -found[:, 0]))[: self.size]]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            ids = part.column("vec_id").fill_null(LAST).to_numpy(zero_copy_only=False)
            yield part.column("row").to_numpy(), ids, part.column("label").to_numpy(), matrix(part.column("v"))


def _sent(anchor: list, of: list, best: list[_Best]) -> pa.RecordBatch:
    """Rows (anchor, of, score, vec_id) of what each has found."""
    counts = [len(b.found) for b in best]
    found = np.concatenate([np.empty((0, 3), dtype=np.int64), *(b.found for b in best)])
    ids = pa.array(found[:, 1], mask=found[:, 1] == LAST)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(x, dtype=np.int64), counts)) for x in (anchor, of)] + [pa.array(found[:, 0]), ids], names=["anchor", "of", "score", "vec_id"])


FOUND = "anchor long, of long, score long, vec_id long"


def _positives(trees: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[_Best(POSITIVES) for _ in tree.rows] for tree in trees.value]
        for rows, ids, labels, vectors in _candidates(batches):
            for tree, own in zip(trees.value, best, strict=True):

                def wanted(i: int, low: np.ndarray, high: np.ndarray, tree: Tree = tree, own: list = own) -> np.ndarray:
                    return (labels == tree.labels[i]) & (rows != tree.rows[i]) & (high >= own[i].worst())

                for i, at, score in _scan(tree, vectors, wanted):
                    own[i].add(score, ids[at], rows[at])
        anchors = [row for tree in trees.value for row in tree.rows]
        yield _sent(anchors, [0] * len(anchors), [b for own in best for b in own])

    return positives


def _negatives(trees: Broadcast, scores: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``scores``: of each anchor's row its positives' scores that have a window."""

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked = [[[(s, -(-LOW * s // 100), HIGH * s // 100, _Best(NEGATIVES)) for s in scores.value.get(int(row), ())] for row in tree.rows] for tree in trees.value]
        for rows, ids, labels, vectors in _candidates(batches):
            for tree, own in zip(trees.value, looked, strict=True):

                def wanted(i: int, low: np.ndarray, high: np.ndarray, tree: Tree = tree, own: list = own) -> np.ndarray:
                    overlaps = np.zeros(len(low), dtype=bool)
                    for _, least, most, best in own[i]:
                        overlaps |= (high >= max(least, best.worst())) & (low <= most)
                    return overlaps & (labels != tree.labels[i])

                for i, at, score in _scan(tree, vectors, wanted):
                    for _, least, most, best in own[i]:
                        inside = (score >= max(least, best.worst())) & (score <= most)
                        if inside.any():
                            best.add(score[inside], ids[at[inside]], rows[at[inside]])
        flat = [(row, s, best) for tree, own in zip(trees.value, looked, strict=True) for row, windows in zip(tree.rows, own, strict=True) for s, _, _, best in windows]
        yield _sent([x[0] for x in flat], [x[1] for x in flat], [x[2] for x in flat])

    return negatives


def _first(found: DataFrame, size: int) -> DataFrame:
    """The best of what tasks have found, numbered from 1."""
    order = Window.partitionBy("anchor", "of").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def mine(vectors: DataFrame) -> DataFrame:
    """Hard negatives of (vec_id, label, embedding); all columns of SCHEMA.

    Rows with a null label or without a usable vector (null, empty, null or non-finite components, components beyond
    2 ** 19, another length than that of the smallest vec_id) take no part. A row with a null vec_id is a candidate and
    no anchor; among equal scores it comes last. Repeated rows are rows of their own: each is the others' positive, and
    each anchor among them has its own result. An anchor without a positive, or whose positives score below 0, has no
    row. Other columns are ignored.
    """
    spark = vectors.sparkSession
    of = F.col("label").cast("long")
    labelled = vectors.where("label is not null").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (of + 1) % 10).otherwise(of).alias("label"), "embedding")
    kept = numbered(labelled)
    anchors = cut(kept.where(F.col("vec_id") % EVERY == 0))
    chunks = -(-anchors.count() // CHUNK)
    done = spark.createDataFrame([], SCHEMA)
    for k in range(chunks):
        own = anchors.where(F.pmod(F.xxhash64("row"), F.lit(chunks)) == k)
        rows = own.orderBy("label", "row").select("row", "label", "v").toArrow()  # one chunk: about CHUNK rows
        v = matrix(rows.column("v").combine_chunks()) if rows.num_rows else np.empty((0, 0), dtype=np.int64)
        ids, labels = (rows.column(x).to_numpy() for x in ("row", "label"))
        trees = spark.sparkContext.broadcast([spanning_tree(ids[i : i + TREE], labels[i : i + TREE], v[i : i + TREE]) for i in range(0, len(ids), TREE)])
        positives = cut(_first(kept.mapInArrow(_positives(trees), FOUND), POSITIVES))
        windows: dict[int, set[int]] = {}
        for r in positives.where("score >= 0").select("anchor", "score").distinct().collect():  # POSITIVES for each anchor of the chunk
            windows.setdefault(r.anchor, set()).add(r.score)
        scores = spark.sparkContext.broadcast({row: sorted(x) for row, x in windows.items()})
        negatives = _first(kept.mapInArrow(_negatives(trees, scores), FOUND), NEGATIVES)
        pairs = positives.select("anchor", F.col("score").alias("of"), F.col("vec_id").alias("positive_id"))
        named = own.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        found = negatives.join(pairs, ["anchor", "of"]).join(named, "anchor")
        columns = ("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("of").alias("positive_score"), F.col("score").alias("negative_score"))
        done = done.union(cut(found.select(*columns)))
        scores.unpersist()
        trees.unpersist()
    return done


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all ``embeddings``."""
    return mine(table(spark, sf_dir, "embeddings"))


SQL = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (SELECT a.r AS anchor, a.vec_id AS anchor_id, c.r, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM kept a, kept c WHERE a.vec_id % {EVERY} = 0 AND a.r <> c.r),
positives AS (SELECT anchor, anchor_id, r AS positive, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= {POSITIVES}),
ranked AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor, positive ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scored USING (anchor, anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT * FROM ranked WHERE rank <= {NEGATIVES}"""
