"""Codes of vectors: each part of a vector names the nearest entry of its codebook.

The parts of a position are sorted along a Hilbert curve and cut into flat blocks, which keep the box
that holds their parts (least and largest components) and the parts' sum, and are written once. In a
round, the least and the largest distances from a block's box to the entries leave a shortlist: those
that may be nearest to some point of the box. Where it has one entry, the block's sum
goes to that as a whole; otherwise exact integer distances to the few entries decide for each part.
A task returns one row for each entry that it has met, so that a round moves ``parts * entries`` rows
a task, and the codebooks, of a fixed size, are all that the driver sees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, table
from corpusloom.llm.integer_vectors import matrix, numbered

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Parts of a block.
BLOCK = 128
#: Of longer parts the Hilbert curve goes through the first components only: it decides what is stored together, no result.
CURVE_DIMS = 8

SCHEMA = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def hilbert(points: np.ndarray) -> np.ndarray:
    """Each point's place on a Hilbert curve; components beyond the curve's grid count as on its edge."""
    points = points[:, :CURVE_DIMS]
    dims = points.shape[1]
    bits = min(15, 62 // dims)
    x = (np.clip(points, -(1 << bits - 1), (1 << bits - 1) - 1) + (1 << bits - 1)).T.copy()
    for level in range(bits - 1, 0, -1):
        side, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            upper = x[i] & side != 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(len(points), dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    place = np.zeros(len(points), dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            place = place << 1 | x[i] >> bit & 1
    return place


def _placed(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (row, v) a row for each part: its position, its place on the curve, and itself."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v"))
                v = v.reshape(len(v), parts, -1)
                for position in range(parts):
                    part = v[:, position]
                    raw = part.astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), position, dtype=np.int32)), pa.array(hilbert(part)), batch.column("row"), pa.array([x.tobytes() for x in raw], pa.binary())], names=["position", "place", "row", "part"])

    return placed


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted parts the blocks of up to BLOCK of a position, with boxes and sums."""
    for batch in batches:
        position = batch.column("position").to_numpy()
        rows = batch.column("row").to_numpy()
        raw = batch.column("part").to_pylist()
        edges = np.flatnonzero(np.append(True, np.diff(position) != 0)) if len(position) else position
        out: list = []
        for start, end in zip(edges, np.append(edges[1:], len(position)), strict=True):
            for at in range(start, end, BLOCK):
                to = min(at + BLOCK, end)
                part = np.frombuffer(b"".join(raw[at:to]), dtype=np.int32).reshape(to - at, -1)
                box = [part.min(axis=0), part.max(axis=0), part.sum(axis=0, dtype=np.int64)]
                out.append((int(position[at]), *(x.tobytes() for x in (*box, part, rows[at:to].astype(np.int64)))))
        names = ["position", "low", "high", "total", "parts", "rows"]
        kinds = [pa.int32(), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kinds[i]) for i in range(len(names))], names=names)


BLOCK_SCHEMA = "position int, low binary, high binary, total binary, parts binary, rows binary"


def _shortlist(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The entries, ascending, that may be nearest to a point of the box (ties included).

    An entry goes if its least distance to the box exceeds another's largest one, or if the one with the least
    largest distance is nearer to all corners: the difference of two squared distances is linear.
    """
    near = np.maximum(np.maximum(low - book, book - high), 0)
    far = np.maximum(np.abs(book - low), np.abs(book - high))
    most = (far * far).sum(axis=1)
    short = np.flatnonzero((near * near).sum(axis=1) <= most.min())
    rival, others = book[most.argmin()], book[short]
    slope = 2 * (others - rival)
    ahead = np.where(slope > 0, slope * high, slope * low).sum(axis=1) + (rival * rival).sum() - (others * others).sum(axis=1)
    return short[ahead >= 0]


def _nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each part the nearest of a few entries, the first of equal ones, and its squared distance."""
    best = np.full(len(part), -1, dtype=np.int64)
    least = np.zeros(len(part), dtype=np.int64)
    for k, entry in enumerate(book):
        apart = part - entry
        distance = np.einsum("ij,ij->i", apart, apart)
        nearer = (distance < least) | (best < 0)
        best[nearer], least[nearer] = k, distance[nearer]
    return best, least


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    kinds = (np.int32, np.int32, np.int64, np.int32, np.int64)
    for position, *raw in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
        yield position, [np.frombuffer(x, dtype=kind).astype(np.int64) for x, kind in zip(raw, kinds, strict=True)]


def _summed(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From blocks the count and the componentwise sum of the parts that each entry is nearest to."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(books.shape[:2], dtype=np.int64)
        total = np.zeros(books.shape, dtype=np.int64)
        for batch in batches:
            for position, (low, high, whole, parts, rows) in _blocks(batch):
                short = _shortlist(low, high, books[position])
                if len(short) == 1:
                    count[position, short[0]] += len(rows)
                    total[position, short[0]] += whole
                else:
                    part = parts.reshape(len(rows), -1)
                    chosen = short[_nearest(part, books[position][short])[0]]
                    count[position] += np.bincount(chosen, minlength=books.shape[1])
                    np.add.at(total[position], chosen, part)
        position, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(position, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[position, entry]), pa.array(list(total[position, entry]), pa.list_(pa.int64()))], names=["position", "entry", "n", "total"])

    return summed


def _coded(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From blocks each part's entry, in its place of a code of two longs, and squared distance."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list = [[], [], [], []]
            for position, (low, high, _, parts, rows) in _blocks(batch):
                short = _shortlist(low, high, books[position])
                chosen, error = _nearest(parts.reshape(len(rows), -1), books[position][short])
                placed = short[chosen] << 8 * (7 - position % 8)
                for column, values in zip(found, (rows, placed * (position < 8), placed * (position >= 8), error), strict=True):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, dtype=np.int64), *x])) for x in found], names=["row", "first", "second", "error"])

    return coded


def encode(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Codes of (vec_id, label, embedding) as vec_id, label, code, error, and the codebooks (part, entry, component).

    Rows without a usable vector (null, empty, null or non-finite components, components beyond 2 ** 19, a length that
    is no multiple of PARTS or not the common one) are left out. A null vec_id stays, after all others where the
    codebooks' first entries are chosen; repeated rows are coded each. Fewer than ENTRIES rows make as many entries.
    Without a row the codebooks are empty. Other columns are ignored.
    """
    kept = numbered(vectors, PARTS)
    first = [r.v for r in kept.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(ENTRIES).collect()]
    if not first:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.empty((PARTS, 0, 0), dtype=np.int64)
    books = np.array(first, dtype=np.int64).reshape(len(first), PARTS, -1).swapaxes(0, 1).copy()
    placed = kept.select("row", "v").mapInArrow(_placed(PARTS), "position int, place long, row long, part binary")
    # The row is part of the range, so that parts that many vectors share are dealt to many tasks.
    blocks = cut(placed.repartitionByRange("position", "place", "row").sortWithinPartitions("position", "place", "row").mapInArrow(_blocked, BLOCK_SCHEMA))
    for _ in range(ROUNDS):
        sums = blocks.mapInArrow(_summed(books), "position int, entry int, n long, total array<long>")
        dims = range(books.shape[2])
        merged = sums.groupBy("position", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"t{i}") for i in dims))
        for r in merged.collect():  # at most PARTS * ENTRIES rows
            books[r.position, r.entry] = [r[f"t{i}"] // r.n for i in dims]
    coded = blocks.mapInArrow(_coded(books), "row long, first long, second long, error long")
    whole = coded.groupBy("row").agg(*(F.sum(x).alias(x) for x in ("first", "second", "error")))
    digits = F.lower(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in ("first", "second"))))
    return kept.drop("v").join(whole, "row").select("vec_id", "label", digits.alias("code"), "error"), books


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all ``embeddings``; errors are also summed over equal labels, nulls together."""
    codes, books = encode(table(spark, sf_dir, "embeddings"))
    codes = cut(codes)
    labels = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(labels, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Rounds as chained tables of parts (of four components) and entries."""
    names = "abcd"
    apart = " + ".join(f"(x.{n} - e.{n}) * (x.{n} - e.{n})" for n in names)
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT r, p, {', '.join(f'v[4 * p + {i + 1}] AS {n}' for i, n in enumerate(names))} FROM kept, (SELECT unnest(range({PARTS})) AS p))",
        f"e0 AS MATERIALIZED (SELECT p, i, {', '.join(names)} FROM parts JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM kept QUALIFY i < {ENTRIES}) USING (r))",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT x.r, x.p, {', '.join(f'any_value(x.{n}) AS {n}' for n in names)}, min(({apart}) * {ENTRIES} + e.i) AS m FROM parts x JOIN e{k} e USING (p) GROUP BY x.r, x.p)")
        if k < ROUNDS:
            floors = ", ".join(f"coalesce(floor(s.{n} / s.n)::BIGINT, e.{n}) AS {n}" for n in names)
            steps.append(f"e{k + 1} AS MATERIALIZED (SELECT e.p, e.i, {floors} FROM e{k} e LEFT JOIN (SELECT p, m % {ENTRIES} AS i, count(*) AS n, {', '.join(f'sum({n}) AS {n}' for n in names)} FROM a{k} GROUP BY 1, 2) s USING (p, i))")
    steps.append(f"coded AS (SELECT r, string_agg(printf('%02x', (m % {ENTRIES})::BIGINT), '' ORDER BY p) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY r)")
    steps.append(f"books AS (SELECT sha256(string_agg({" || ',' || ".join(f'{n}::VARCHAR' for n in names)}, ',' ORDER BY p, i)) AS codebooks_sha256 FROM e{ROUNDS})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), books"


SQL = _sql()
