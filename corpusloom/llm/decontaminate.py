"""Benchmark decontamination by the q-gram lemma, with banded alignment as proof.

A passage of m characters with at most e edits keeps most of its q-grams, and all of these lie
on diagonals no further apart than e. Of each benchmark passage every ``step``-th q-gram is
indexed; one edit spoils at most ceil(q / step) of them. Passages under SPARSE_FROM characters
have all their q-grams indexed, and shorter ones where needed, so that the bound is positive for
the whole budget of every length. Hits of a document are counted in overlapping bands of
diagonals, each q-gram of the passage once. Neighbouring bands that meet the passage's bound
become one region, whose diagonals are then aligned with the passage; the alignment stops as soon
as the budget is spent.

Benchmark passages are the stated query set. They are looked at in blocks of bounded size, and
each block is sent to all tasks; documents are never shuffled for the search.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, table

Q = 8
STEP = 4
#: Edits allowed, as a share of a passage's characters.
EDIT_RATE = 0.1
#: Longer items are searched for in passages of this many characters.
PASSAGE = 256
#: From this length on every STEP-th q-gram is enough for the whole budget.
SPARSE_FROM = 40
#: Characters of passages that are searched for at once: the bound of what is broadcast.
BLOCK_CHARS = 4_000_000

_SLOTS = 1 << 22


def normalise(text: str) -> tuple[str, np.ndarray]:
    """Lower-cased text with runs of white space as one space, and each character's old place."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    low = _fold()[points]
    space = low == 32
    kept = ~(space & np.concatenate(([True], space[:-1])))
    places = np.flatnonzero(kept)
    row = low[kept]
    if len(row) and row[-1] == 32:
        row, places = row[:-1], places[:-1]
    return row.astype("<u4").tobytes().decode("utf-32-le"), places


@functools.lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Each code point's lower case, if that is one code point, and 32 for white space."""
    fold = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isspace():
            fold[i] = 32
        elif len(low := c.lower()) == 1:
            fold[i] = ord(low)
    return fold


def _codes(text: str, q: int) -> np.ndarray:
    """A 64-bit code of the q-gram at each position."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    n = len(points) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    code = np.full(n, q, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(q):
            code = code * np.uint64(0x9E3779B97F4A7C15) + points[i : i + n]
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        code ^= code >> np.uint64(32)
    return code


def budget_of(chars: int) -> int:
    """Edits allowed in a passage of so many characters."""
    return int(chars * EDIT_RATE)


def grams_of(chars: int) -> tuple[int, int]:
    """Size of the q-grams of a passage, and the step between those that are indexed."""
    return (Q, STEP) if chars >= SPARSE_FROM else (min(Q, chars // (budget_of(chars) + 1)), 1)


class Passages:
    """Indexed q-grams of benchmark passages: for each size of q-grams sorted codes with postings."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, self.texts = [], []
        for item, text in items:
            text, _ = normalise(text or "")
            last = max(0, len(text) - PASSAGE)
            for at in sorted({*range(0, last, PASSAGE // 2), last}) if text else ():
                self.items.append(item)
                self.texts.append(text[at : at + PASSAGE])
        self.budgets = [budget_of(len(t)) for t in self.texts]
        sizes = [grams_of(len(t)) for t in self.texts]
        needed = []
        by_size: dict[int, list] = {}
        for n, (text, (q, step)) in enumerate(zip(self.texts, sizes, strict=True)):
            codes = _codes(text, q)[::step]
            needed.append(len(codes) - self.budgets[n] * math.ceil(q / step))
            by_size.setdefault(q, []).append((codes, np.full(len(codes), n), np.arange(len(codes)) * step))
        self.needed = np.array(needed, dtype=np.int64)
        assert not needed or min(needed) > 0
        #: Bands are wider than any budget, so two neighbours hold any alignment.
        self.width = max(8, max(self.budgets, default=0) + 1)
        self.index = {q: _Index(*map(np.concatenate, zip(*parts, strict=True))) for q, parts in sorted(by_size.items())}

    def regions(self, text: str) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Passages with the ranges of diagonals of ``text`` that meet the passage's bound of shared q-grams, by passage."""
        for q, index in self.index.items():
            codes = _codes(text, q)
            slots, at = index.hits(codes)
            if not len(slots):
                continue
            # Which of a passage's q-grams stand in the text at all; few passages have enough.
            present = np.unique(slots)
            owner, place, slot = index.postings(present)
            counts = np.bincount(owner, minlength=len(self.needed))
            likely = counts >= self.needed
            kept = likely[owner]
            owner, place, slot = owner[kept], place[kept], slot[kept]
            if not len(owner):
                continue
            order = np.argsort(slots, kind="stable")
            slots, at = slots[order], at[order]
            first, last = np.searchsorted(slots, slot), np.searchsorted(slots, slot, "right")
            edges = np.flatnonzero(np.append(True, np.diff(owner) != 0))
            for start, end in zip(edges.tolist(), [*edges[1:].tolist(), len(owner)], strict=True):
                p = int(owner[start])
                counts = np.zeros(len(text) // self.width + PASSAGE // self.width + 4, dtype=np.int32)
                for k in range(start, end):
                    # Band b holds diagonals [b * width, (b + 2) * width); each hit is in two, each q-gram counts once a band.
                    hit = np.zeros(len(counts) + 1, dtype=bool)
                    hit[(at[first[k] : last[k]] - place[k] + PASSAGE) // self.width] = True
                    counts += hit[:-1] | hit[1:]
                met = np.flatnonzero(counts >= self.needed[p])
                if len(met):
                    runs = np.split(met, np.flatnonzero(np.diff(met) > 1) + 1)
                    yield p, [(int(r[0]) * self.width - PASSAGE, (int(r[-1]) + 2) * self.width - PASSAGE) for r in runs]


class _Index:
    """Postings (owner, place) of codes; a bitmap tells at once that a code is none of them."""

    def __init__(self, codes: np.ndarray, owner: np.ndarray, place: np.ndarray):
        order = np.argsort(codes, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.codes, self.first, self.count = np.unique(codes[order], return_index=True, return_counts=True)
        self.present = np.zeros(_SLOTS, dtype=bool)
        self.present[(self.codes & np.uint64(_SLOTS - 1)).astype(np.int64)] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the index's codes stand in ``codes``, and where."""
        at = np.flatnonzero(self.present[(codes & np.uint64(_SLOTS - 1)).astype(np.int64)])
        slots = np.searchsorted(self.codes, codes[at])
        slots[slots == len(self.codes)] = 0
        real = self.codes[slots] == codes[at]
        return slots[real], at[real]

    def postings(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, place, slot) of all postings of the slots, by owner and place."""
        n = self.count[slots]
        post = np.repeat(self.first[slots] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        owner, place, slot = self.owner[post], self.place[post], np.repeat(slots, n)
        order = np.lexsort((place, owner))
        return owner[order], place[order], slot[order]


def align(passage: str, text: str, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of ``passage`` in ``text`` on the diagonals around [low, high).

    A cell of the dynamic program stands on the diagonal of its place in ``text`` less that in
    ``passage``; only diagonals within ``budget`` of the given ones are worked out, and it ends when
    no cell is within the budget.
    """
    m = len(passage)
    first, last = max(low - budget, -m), min(high + budget, len(text) + 1)
    left, right = max(0, first), min(len(text), last + m)
    exact = text.find(passage, left, right)
    if exact >= 0:
        return 0, exact, exact + m
    if not budget or last <= first:
        return None
    # Letters outside the text equal none; a path that has left it can't come back.
    letters = np.full(last - first + m, 0xFFFFFFFF, dtype=np.uint32)
    letters[left - first : right - first] = np.frombuffer(text[left:right].encode("utf-32-le"), dtype="<u4")
    diagonals = np.arange(first, last)
    width, one, far = len(diagonals), 1 << 32, 1 << 60
    # The edits in the upper half of a number, the start in the lower: the least has the fewest edits, then the first start.
    cell = np.where((diagonals >= 0) & (diagonals <= len(text)), diagonals, far)
    steps = np.arange(width) * one
    for i, c in enumerate(passage, 1):
        across = cell + (letters[i - 1 : i - 1 + width] != ord(c)).astype(np.int64) * one
        across[:-1] = np.minimum(across[:-1], cell[1:] + one)
        # A step to the right costs one: the least of (cell - position) so far, plus the position.
        cell = np.minimum.accumulate(across - steps) + steps
        if cell.min() >= (budget + 1) * one:
            return None
    cell[diagonals + m > len(text)] = far
    end = int(cell.argmin())
    edits, start = divmod(int(cell[end]), one)
    return (edits, start, int(diagonals[end]) + m) if edits <= budget else None


def search(passages: Passages, text: str | None, one: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(item, start, end, edits, chars) of the best proven place of each item, or of ``one`` only, in the old text's code points.

    Of an item's passages the first with the fewest edits counts; later ones are only looked at for fewer.
    """
    if not text or not passages.texts:
        return []
    low, places = normalise(text)
    best: dict[int, tuple[int, int, int, int, int]] = {}
    for p, ranges in passages.regions(low):
        item, passage = passages.items[p], passages.texts[p]
        for a, b in ranges:
            budget = min(passages.budgets[p], best[item][3] - 1) if item in best else passages.budgets[p]
            if budget < 0:
                break
            found = align(passage, low, a, b, budget)
            if found and found[2] > found[1]:
                edits, start, end = found
                best[item] = (item, int(places[start]), int(places[end - 1]) + 1, edits, len(passage))
                if one:
                    return [best[item]]
    return list(best.values())


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in lists of at most BLOCK_CHARS characters, or one item."""
    block, chars = [], 0
    for row in benchmark.select("item_id", "text").filter("text is not null").toLocalIterator():
        if block and chars + len(row["text"]) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((row["item_id"], row["text"]))
        chars += len(row["text"])
    if block:
        yield block


def _matches(spark: SparkSession, items: list[tuple[int, str]], one: bool = False):
    shared = spark.sparkContext.broadcast(Passages(items))

    @F.arrow_udf("array<struct<item_id: long, start: int, end: int, edits: int, similarity: double>>")
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32()), ("similarity", pa.float64())]))
        return pa.array([[{"item_id": i, "start": s, "end": e, "edits": d, "similarity": 1 - d / n} for i, s, e, d, n in search(shared.value, t, one)] for t in texts.to_pylist()], kind)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, edits, similarity: where documents hold benchmark passages.

    One row for each row of ``docs`` and item with a proven passage, the one with fewest edits.
    Edits are up to EDIT_RATE of a passage's characters, whatever its length, and an item of a few
    characters matches wherever these stand. Null and empty texts on either side match nothing;
    items of the same id are one item. Other columns than doc_id, item_id and the texts are not read.
    """
    spark = docs.sparkSession
    out = None
    for items in _blocks(benchmark):
        rows = docs.select("doc_id", F.explode(_matches(spark, items)(F.col("text"))).alias("m")).select("doc_id", "m.*")
        out = rows if out is None else out.unionByName(rows)
    return docs.select("doc_id").limit(0).selectExpr("doc_id", "cast(null as long) item_id", "cast(null as int) start", "cast(null as int) end", "cast(null as int) edits", "cast(null as double) similarity") if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark passage, in all their columns.

    Each block of items has a job of its own, so that a task holds the index of one block; what is left after it is written.
    Null and empty texts hold none; repeated rows stay or go together.
    """
    for k, items in enumerate(_blocks(benchmark)):
        docs = docs if k == 0 else cut(docs)
        docs = docs.filter(F.size(_matches(docs.sparkSession, items, one=True)(F.col("text"))) == 0)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
