"""Quality rules: counts of words and repeats, and a likelihood ratio of hashed n-grams.

Two multinomials over buckets of hashed character n-grams are counted, one from all documents and one
from trusted ones. A text's score is the mean over its n-grams of the log of the second's over the
first's probability, so that it doesn't depend on the length. Both are smoothed by the same share of
PRIOR counts a bucket, so that n-grams the corpus hardly holds speak for neither. Ratios are whole
millionths: sums don't depend on their order, and each document's verdict is the same in every run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

#: Characters of an n-gram; 2 ** BUCKET_BITS buckets; counts by which a bucket is smoothed.
GRAM, BUCKET_BITS, PRIOR = 4, 18, 50
#: At most so many trusted documents, those of the least hashes of their ids, are counted as the target.
MAX_TRUSTED = 20_000
#: Texts with a lower mean log ratio go.
THRESHOLD = -0.05
UNIT = 1_000_000
#: A text passes the base rules with so many words, of which at most REPEATED hundredths are in repeated windows.
MIN_WORDS, WINDOW, REPEATED = 50, 3, 50
#: Texts are worked on together up to so many bytes.
SLICE = 2_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True

COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts (null: empty) of a batch, some at a time; a longer text comes alone."""
    texts = batch.column("text").fill_null("")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // SLICE if len(size) else size
    edges = np.append(np.flatnonzero(np.append(True, np.diff(part) != 0)), len(part)) if len(part) else [0]
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        yield batch.column("doc_id").slice(start, end - start), pa.array(texts.slice(start, end - start).to_pylist(), pa.large_string())


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values."""
    whole = np.add.reduceat(np.append(values, values.dtype.type(0)), starts, dtype=np.int64) if len(starts) else starts
    return np.where(starts < ends, whole, 0)


def _bounds(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(counts)
    return ends - counts, ends


def _windows(ids: np.ndarray) -> np.ndarray:
    """A number for each three ids in a row, the same for the same ids only."""
    base = int(ids.max(initial=0)) + 1
    if base**WINDOW < 1 << 63:
        return (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    pairs = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1].astype(np.int64)
    return pairs[:-1] * base + ids[2:]


def _again(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values their text holds twice or more, and which it has held before."""
    order = np.argsort(values, kind="stable")
    same = (values[order][1:] == values[order][:-1]) & (text[order][1:] == text[order][:-1])
    repeated, later = np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=bool)
    later[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    return repeated | later, later


def counts(texts: pa.Array) -> list[np.ndarray]:
    """Of each text n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    starts, ends = _bounds(size)
    raw = np.frombuffer("".join(texts.to_pylist()).encode(), dtype=np.uint8)
    chars = ~_SPACE[raw] & (raw & 0xC0 != 0x80)

    split = pc.split_pattern_regex(texts, r"[ \t-\r]+")
    words = split.flatten()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    there = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    ids, text = words.dictionary_encode().indices.to_numpy().astype(np.int64)[there], text[there]
    n_words = np.bincount(text, minlength=len(texts))
    covered = np.zeros(len(ids), dtype=bool)
    if len(ids) >= WINDOW:
        inside = np.flatnonzero(text[2:] == text[:-2])
        at = inside[_again(_windows(ids)[inside], text[inside])[0]]
        for i in range(WINDOW):
            covered[at + i] = True

    lines = pc.split_pattern(texts, "\n")
    line = lines.flatten()
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    full = pc.match_substring_regex(line, r"[^ \t-\r]").to_numpy(zero_copy_only=False)
    ids, of = line.dictionary_encode().indices.to_numpy().astype(np.int64)[full], of[full]
    dup_lines = np.bincount(of[_again(ids, of)[1]], minlength=len(texts))
    word_starts, word_ends = _bounds(n_words)
    return [n_words, _sums(chars, starts, ends), _sums(_SYMBOL[raw], starts, ends), dup_lines, _sums(covered, word_starts, word_ends)]


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of the texts, one text after the other, and how many each text has."""
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    value = np.zeros(max(len(points) - GRAM + 1, 0), dtype=np.uint64)
    for i in range(GRAM if len(value) else 0):
        value = (value + points[i : i + len(value)]) * _MIX
        value ^= value >> np.uint64(29)
    n = np.maximum(size - GRAM + 1, 0)
    inside = np.ones(len(value), dtype=bool)
    ends = np.cumsum(size)
    for i in range(1, GRAM):  # n-grams that go on into the next text
        over = ends - i
        inside[over[(over >= 0) & (over < len(value)) & (over >= ends - size)]] = False
    return (value[inside] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), n


def _counted(trusted: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From texts each bucket's count in all of them and in trusted ones."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros((2, 1 << BUCKET_BITS), dtype=np.int64)
        for batch in batches:
            for ids, texts in _slices(batch):
                bucket, n = buckets(texts)
                raw += np.bincount(bucket, minlength=len(raw))
                own = pc.is_in(ids.cast(pa.int64()), pa.array(trusted)).to_numpy(zero_copy_only=False)
                target += np.bincount(bucket[np.repeat(own, n)], minlength=len(raw))
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "n", "trusted"])

    return counted


def ratios(n: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of its smoothed shares of trusted and of all n-grams, in millionths; 0 without either."""
    every, own = n.sum(), trusted.sum()
    if not every or not own:
        return np.zeros(len(n), dtype=np.int64)
    share = own / every
    return np.round(UNIT * np.log((trusted + PRIOR * share) / ((n + PRIOR) * share))).astype(np.int64)


def _judged(ratio: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _slices(batch):
                bucket, n = buckets(texts)
                total = _sums(ratio[bucket], *_bounds(n))
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(x.astype(np.int64)) for x in (*counts(texts), total, n))], schema=_SCHEMA)

    return judged


_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in COUNTS.split(", ")] + [("total", pa.int64()), ("n_grams", pa.int64())])


def trusted_ids(labels: DataFrame) -> np.ndarray:
    """Documents with quality 1 and no other, sorted; of more than MAX_TRUSTED those of the least hashes."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("most")).where("least = 1 and most = 1")
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRUSTED).select(F.col("doc_id").cast("long")).toArrow()
    return np.sort(chosen.column(0).to_numpy().astype(np.int64))


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, score (mean log ratio; 0 for texts of under GRAM characters) and kept of every document.

    ``documents`` has doc_id and text, ``labels`` doc_id and quality; other columns are ignored. A null text is empty; a
    null doc_id is no trusted one; repeated rows are counted and returned each. Without a trusted document all scores
    are 0 and the base rules decide. All documents are read twice; nothing but bucket counts is shuffled.
    """
    texts = documents.select("doc_id", "text")
    counted = texts.mapInArrow(_counted(trusted_ids(labels)), "bucket int, n long, trusted long")
    merged = counted.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("trusted").alias("trusted")).toArrow()  # 2 ** BUCKET_BITS rows at most
    n, trusted = np.zeros((2, 1 << BUCKET_BITS), dtype=np.int64)
    at = merged.column("bucket").to_numpy()
    n[at], trusted[at] = merged.column("n").to_numpy(), merged.column("trusted").to_numpy()
    sent = documents.sparkSession.sparkContext.broadcast(ratios(n, trusted))
    rows = texts.mapInArrow(lambda batches: _judged(sent.value)(batches), COUNTS + ", total long, n_grams long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    enough = F.col("total") >= F.lit(round(THRESHOLD * UNIT)) * F.col("n_grams")
    score = F.when(F.col("n_grams") > 0, F.col("total") / F.col("n_grams") / UNIT).otherwise(0.0)
    return rows.select(*[x.split()[0] for x in COUNTS.split(", ")], failed.alias("base_failed"), score.alias("score"), (~failed & enough).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on all ``documents``."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
