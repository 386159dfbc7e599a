"""Substring dedup by MinHash banding of paragraphs.

Shared passages start and end anywhere in a line, so lines don't line up between documents. Both
kinds of paragraph therefore start at anchors: of any so many places in a row the one with the least
hash of its word and the word after.

Runs are WORDS words and start at one of any SPAN places. WORDS + SPAN - 1 = 25 words in a row that
two documents share have a whole run in common. They are compared as wholes only. A shorter text,
of one word even, is one run.

Passages are LENGTH words and start at one of any REACH places; a shorter text of at least a shingle
is one passage. One changed word anywhere in a passage leaves a Jaccard similarity of 0.8 of its
five-word shingles. They are compared by BANDS MinHash bands of ROWS values, tuned for recall (at
similarity 0.8 a pair shares one with probability 0.98). Passages of one text that overlap all but a
few words are compared where the text is read, and those that are linked so make a chain. Passages
that share a band with one they weren't compared with so, and whose bitmaps don't rule it out, are
compared by exact Jaccard similarity of shingle sets, within tasks that return a spanning forest of
links.

Equal runs are classes, and so are the components of links between passages. Of a class the first
paragraph by document and place stays: what is to go never includes a word of a first run, and of a
first passage only runs that stay whole elsewhere. A class must span documents: what only repeats within one is no reason to remove it. Runs that go and stand in
the same order in one text that holds their first places are one stretch with what lies between
them, as long as the words between are few enough for a word edit similarity of 0.8: so a changed
word, and the short ends beside it that hold no run, go with the copy around them.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import free, table, written
from corpusloom.llm.components import components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Words of a run, and places in a row of which one starts a run.
WORDS, SPAN = 16, 10
#: Words of a passage, and places in a row of which one starts a passage.
LENGTH, REACH = 50, 36
#: Of passages at similarity 0.8, 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.983 share a band, of those at 0.9 0.999.
BANDS, ROWS = 4, 2
#: Paragraphs that share a band are compared all with all up to here; beyond, within finer groups that lose no pair.
ALL_PAIRS = 64
#: Up to here they are compared as plain sets, which is quicker than arrays.
FEW = 12
#: Marks of a band that are compared in one task; those of larger bands are dealt to parts, and each two parts meet.
BLOCK = 4096
#: Passages of a text that each start at most so many words after the one before make a group, of so many at most, and are compared where the text is read.
GAP, GROUP = 10, 8
#: Rows of a band whose bitmaps are compared all with all up to here; beyond, those count as near that have a part in common.
BITMAPS = 1024
#: Rows of a band that a task holds to look for near ones; of a larger band all rows count as near.
HELD = 1 << 20

#: Texts are worked on together up to so many characters; words are hashed by so many at a time.
SLICE_CHARS, PIECE = 300_000, 50_000
#: Longer words have a hash of their own kind.
LONG = 4096

_SHINGLES = LENGTH - SHINGLE_WORDS + 1
#: Sets that reach SIMILARITY differ in fewer shingles than this, so of this many parts one is left untouched.
_PARTS = 2 * (_SHINGLES - int(np.ceil(SIMILARITY / (1 + SIMILARITY) * 2 * _SHINGLES))) + 1
#: The bit of a bitmap's second column from where on a passage's number of shingles stands.
_COUNT = 58
#: Passages of one text that start so few words apart may still be similar.
_SHIFT = int(_SHINGLES * (1 - SIMILARITY) / (1 + SIMILARITY))
_SEEDS = np.random.default_rng(8).integers(1, 1 << 63, size=(BANDS * ROWS, 2), dtype=np.uint64) | np.uint64(1)
_WEIGHTS = np.random.default_rng(9).integers(1, 1 << 63, size=LENGTH, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a number, and of its inverse modulo 2 ** 64."""
    both = []
    for base in (int(_MIX), pow(int(_MIX), -1, 1 << 64)):
        row = np.full(n, base, dtype=np.uint64)
        row[0] = 1
        both.append(np.cumprod(row))
    return both[0], both[1]


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word, from sums of its bytes times powers of a number, for many words at once."""
    out = [np.empty(0, dtype=np.uint64)]
    for i in range(0, len(words), PIECE):
        piece = words[i : i + PIECE]
        raw = np.frombuffer(" ".join(piece).encode(), dtype=np.uint8)
        ends = np.append(np.flatnonzero(raw == 32), len(raw))
        long = {k: w for k, w in enumerate(piece) if len(w) > LONG} if np.diff(ends, prepend=-1).max() > LONG else {}
        if long:
            raw = np.frombuffer(" ".join(["" if k in long else w for k, w in enumerate(piece)]).encode(), dtype=np.uint8)
            ends = np.append(np.flatnonzero(raw == 32), len(raw))
        starts = np.append(0, ends[:-1] + 1)
        powers, inverse = _powers(1 << len(raw).bit_length())
        sums = np.append(np.uint64(0), np.cumsum(raw * powers[: len(raw)]))
        hashes = _mix(_mix((sums[ends] - sums[starts]) * inverse[starts]) + (ends - starts).astype(np.uint64))
        for k, w in long.items():
            hashes[k] = xxhash.xxh64_intdigest(w)
        out.append(hashes)
    return np.concatenate(out)


def _least(value: np.ndarray, text: np.ndarray, span: int) -> np.ndarray:
    """The places of the least of ``span`` values in a row, the first of equal ones.

    ``text`` has the text of each value; of a text with fewer values their least counts.
    """
    at, least, width = np.arange(len(value)), value, 1
    edges = np.flatnonzero(np.append(True, np.diff(text) != 0)) if len(text) else text
    sizes = np.diff(np.append(edges, len(text)))
    while width < span and len(at):
        step = min(width, span - width)
        less = least[step:] < least[:-step]
        at, least = np.where(less, at[step:], at[:-step]), np.minimum(least[step:], least[:-step])
        width += step
    chosen = np.zeros(len(value), dtype=bool)
    chosen[at[text[: len(at)] == text[span - 1 :]]] = True
    for edge, size in zip(edges[sizes < span].tolist(), sizes[sizes < span].tolist(), strict=True):
        chosen[edge + value[edge : edge + size].argmin()] = True
    return np.flatnonzero(chosen)


def _thinned(at: np.ndarray, marks: np.ndarray, text: np.ndarray, span: int) -> np.ndarray:
    """Which of the places stay: words that go round have the same least place over and over; one in ``span`` is enough."""
    if not (marks[1:] == marks[:-1]).any():
        return np.ones(len(at), dtype=bool)
    chain = np.append(True, (np.diff(marks) != 0) | (np.diff(at) >= span) | (np.diff(text) != 0))
    step = (at - at[chain][np.cumsum(chain) - 1]) // span
    return chain | np.append(True, np.diff(step) != 0)


Paragraphs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
Span = tuple[int, int, int]
Place = tuple[int, int, int, bool, int, int]


def _paragraphs(words: np.ndarray, counts: np.ndarray, length: int, span: int, fewest: int) -> Paragraphs:
    """Of texts with ``counts`` words, one after the other in ``words``, the paragraphs of ``length`` words.

    Each one's text, where in ``words`` it starts, its mark (a hash of its words in order) and its words.
    """
    first = np.cumsum(counts) - counts
    places = np.maximum(counts - length + 1, 0)
    text = np.repeat(np.arange(len(counts)), places)
    place = np.arange(len(text)) + np.repeat(first - np.cumsum(places) + places, places)
    rank = _mix(words[place] * _MIX + words[place + 1]) if len(place) else np.empty(0, dtype=np.uint64)
    anchors = _least(rank, text, span)
    text, start = text[anchors], place[anchors]
    mark = _mix((words[start[:, None] + np.arange(length)] * _WEIGHTS[:length]).sum(axis=1) + np.uint64(length))
    if len(mark):
        kept = _thinned(start, mark, text, span)
        text, start, mark = text[kept], start[kept], mark[kept]
    short = np.flatnonzero((counts >= fewest) & (counts < length))
    whole = np.array([_mix(np.array([(words[first[i] : first[i] + counts[i]] * _WEIGHTS[: counts[i]]).sum() + np.uint64(counts[i])]))[0] for i in short], dtype=np.uint64)
    text = np.append(text, short)
    return text, np.append(start, first[short]), np.append(mark, whole), np.minimum(counts, length)[text]


def runs(words: np.ndarray, counts: np.ndarray) -> Paragraphs:
    """The runs; their marks are even."""
    text, start, mark, size = _paragraphs(words, counts, WORDS, SPAN, 1)
    return text, start, mark & ~np.uint64(1), size


def passages(words: np.ndarray, counts: np.ndarray) -> Paragraphs:
    """The passages; their marks are odd."""
    text, start, mark, size = _paragraphs(words, counts, LENGTH, REACH, SHINGLE_WORDS)
    return text, start, mark | np.uint64(1), size


def shingles(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of shingle hashes for each passage; those of one with few words end in repeats of the last."""
    m = len(words) - SHINGLE_WORDS + 1
    value = np.zeros(max(m, 0), dtype=np.uint64)
    for i in range(SHINGLE_WORDS if m > 0 else 0):
        value = value * _MIX + words[i : i + m]
    return _mix(value)[starts[:, None] + np.minimum(np.arange(_SHINGLES), sizes[:, None] - SHINGLE_WORDS)]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list[tuple[int, str]], np.ndarray, np.ndarray]]:
    """Rows (doc_id, text), the hashes of all their lower-cased words, and how many each has; some texts at a time."""
    rows: list = []
    words: list = []
    counts: list = []
    chars = 0
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
        own = text.lower().split()
        if own:
            rows.append((doc_id, text))
            counts.append(len(own))
            words += own
            chars += len(text)
            if chars >= SLICE_CHARS:
                yield rows, word_hashes(words), np.array(counts)
                rows, words, counts, chars = [], [], [], 0
    if rows:
        yield rows, word_hashes(words), np.array(counts)


def bands_of(sets: np.ndarray) -> np.ndarray:
    """A row of BANDS band values for each row of shingle hashes; what a value leaves when divided by BANDS tells which band it is of."""
    across = np.ascontiguousarray(sets.T)
    least = np.stack([_mix(across * a + b).min(axis=0) for a, b in _SEEDS], axis=1)
    band = np.zeros((len(sets), BANDS), dtype=np.uint64)
    for i in range(ROWS):
        band = _mix(band * _MIX + least[:, i * BANDS : (i + 1) * BANDS] + np.arange(BANDS, dtype=np.uint64))
    return band & ~np.uint64(BANDS - 1) | np.arange(BANDS, dtype=np.uint64)


def bitmaps(sets: np.ndarray) -> np.ndarray:
    """122 bits for each row of shingle hashes, those its shingles name, and how many these are, as two columns: a shingle more or less changes one bit at most."""
    at = sets % np.uint64(64 + _COUNT)
    bit, upper = np.uint64(1) << (at & np.uint64(63)), at > 63
    low, high = (np.bitwise_or.reduce(np.where(upper == x, bit, np.uint64(0)), axis=1) for x in (False, True))
    return np.stack([low, high | _different(sets).astype(np.uint64) << np.uint64(_COUNT)], axis=1)


def _different(sets: np.ndarray) -> np.ndarray:
    """How many different hashes each row has."""
    return (np.diff(np.sort(sets, axis=1), axis=1) != 0).sum(axis=1) + 1


def _reach(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of shingle hashes reach SIMILARITY with the row at the same place in the other array."""
    own, either = _different(a) + _different(b), _different(np.concatenate([a, b], axis=1))
    return own - either >= SIMILARITY * either


def groups_of(text: np.ndarray, start: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each passage the number of its group, and a hash of the marks that its group has, 0 if it is alone."""
    number = np.cumsum(np.append(True, (np.diff(text) != 0) | (np.diff(start) > GAP))[: len(text)])
    number = number * len(text) + (np.arange(len(text)) - np.searchsorted(number, number)) // GROUP
    _, first, which, size = np.unique(number, return_index=True, return_inverse=True, return_counts=True)
    names = _mix(np.add.reduceat(_mix(mark * _MIX), first)) if len(mark) else mark
    return which, np.where(size > 1, names, np.uint64(0))[which]


def chains(text: np.ndarray, start: np.ndarray, which: np.ndarray, at: np.ndarray, marks: np.ndarray, sets: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """For each of the marks the smallest of its chain, or 0 if it has none.

    A chain is what links connect between similar passages that share a band and are of one group, or start at most _SHIFT
    words apart in one text. ``text``, ``start``, ``which`` (its group) and ``at`` (which of the marks it has) are of the passages, in order.
    """
    pairs = [np.empty((2, 0), dtype=np.int64)]
    for k in range(1, max(_SHIFT + 1, GROUP)):
        close = np.flatnonzero((text[k:] == text[:-k]) & ((start[k:] - start[:-k] <= _SHIFT) | (which[k:] == which[:-k])) & (at[k:] != at[:-k]))
        pairs.append(np.stack([at[close], at[close + k]]))
    pairs = np.concatenate(pairs, axis=1)
    pairs = pairs[:, (bands[pairs[0]] == bands[pairs[1]]).any(axis=1)]
    reach = [_reach(sets[x[0]], sets[x[1]]) for x in np.split(pairs, range(PIECE, pairs.shape[1], PIECE), axis=1)]
    a, b = pairs[:, np.concatenate(reach)]
    least = np.arange(len(marks))
    while (least[a] != least[b]).any():
        low = np.minimum(least[a], least[b])
        for x in (a, b):
            np.minimum.at(least, least[x], low)
        least = least[least]
    out = np.zeros(len(marks), dtype=np.uint64)
    linked = np.unique(np.append(a, b))
    out[linked] = marks[least[linked]]
    return out


def _sets(batch: pa.RecordBatch, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of a batch's passages that are among ``asked``, each once, and their shingles."""
    marks, sets = [np.empty(0, dtype=np.uint64)], [np.empty((0, _SHINGLES), dtype=np.uint64)]
    for _, words, counts in _slices(batch):
        _, start, mark, size = passages(words, counts)
        among = np.isin(mark, asked)
        mark, first = np.unique(mark[among], return_index=True)
        marks.append(mark)
        sets.append(shingles(words, start[among][first], size[among][first]))
    different, first = np.unique(np.concatenate(marks), return_index=True)
    return different, np.concatenate(sets)[first]


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, mark, bits, more, group, chain), each once a batch: copies are few before they are shuffled."""
    for batch in batches:
        found = []
        with np.errstate(over="ignore"):
            for _, words, counts in _slices(batch):
                text, start, mark, size = passages(words, counts)
                marks, first, at = np.unique(mark, return_index=True, return_inverse=True)
                sets = shingles(words, start[first], size[first])
                bands = bands_of(sets)
                which, group = groups_of(text, start, mark)
                chain = chains(text, start, which, at, marks, sets, bands)
                found.append(np.column_stack([mark, group, chain[at], np.column_stack([bitmaps(sets), bands])[at]]))
        if found:
            rows = np.concatenate(found)
            rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
            rows = rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))[: len(rows)]].view(np.int64)
            mark, group, chain, bits, more = (np.tile(rows[:, i], BANDS) for i in range(5))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (rows[:, 5:].T.ravel(), mark, bits, more, group, chain)], names=["band", "mark", "bits", "more", "group", "chain"])


def near_in_band(bands: np.ndarray, marks: np.ndarray, bits: np.ndarray, more: np.ndarray, groups: np.ndarray, chains: np.ndarray) -> np.ndarray:
    """Which rows, sorted by band and mark, may be similar to another mark of their band, of another group and chain; no such pair is lost.

    Their bitmaps differ in no more bits than similar sets of their sizes in shingles, so in fewer than there are parts, and one part is equal.
    """
    fresh = np.append(True, (np.diff(bands) != 0) | (np.diff(marks) != 0) | (np.diff(groups) != 0) | (np.diff(chains) != 0))
    rows = np.flatnonzero(fresh)
    _, sizes = np.unique(bands[rows], return_counts=True)
    size = np.repeat(sizes, sizes)
    near = np.zeros(len(rows), dtype=bool)
    own, mark, low, high, group, chain = (x[rows].view(np.uint64) for x in (bands, marks, bits, more, groups, chains))
    count, high = (high >> np.uint64(_COUNT)).astype(np.int64), high & np.uint64((1 << _COUNT) - 1)
    at = np.flatnonzero((size > 1) & (size <= BITMAPS))
    for k in range(1, BITMAPS):
        at = at[at < len(rows) - k]
        at = at[own[at] == own[at + k]]
        if not len(at):
            break
        other = at + k
        apart = (mark[at] != mark[other]) & ((group[at] != group[other]) | (group[at] == 0)) & ((chain[at] != chain[other]) | (chain[at] == 0))
        differ = np.bitwise_count(low[at] ^ low[other]) + np.bitwise_count(high[at] ^ high[other])
        found = apart & (differ * (1 + SIMILARITY) <= (count[at] + count[other]) * (1 - SIMILARITY) + 1e-6)
        near[at[found]] = near[other[found]] = True
    many = np.flatnonzero(size > BITMAPS)
    with np.errstate(over="ignore"):
        for part in range(_PARTS if len(many) else 0):
            mask = np.uint64(sum(1 << i for i in range(64) if i % _PARTS == part))
            key = _mix(own[many] + _mix((low[many] & mask) * _MIX))
            order = np.argsort(key)
            same = np.diff(key[order]) == 0
            near[many[order[1:][same]]] = near[many[order[:-1][same]]] = True
    return rows[near]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, mark, bits, more, group, chain), sorted by all but the bitmaps: (band, mark) of those near another of their band, and (mark, chain) of chains.

    Columns ``more``, ``group`` and ``chain`` may be missing.
    """
    held, passed = np.empty((6, 0), dtype=np.int64), None
    full = np.uint64(_SHINGLES << _COUNT).view(np.int64)

    def pack(rows: np.ndarray) -> pa.RecordBatch:
        rows = rows[:, np.append(True, np.diff(rows[:2], axis=1).any(axis=0))[: rows.shape[1]]]
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.nulls(rows.shape[1], pa.int64())], names=["band", "mark", "chain"])

    for batch in (b for b in batches if b.num_rows):
        come = np.stack([batch.column(c).to_numpy() if c in batch.schema.names else np.full(batch.num_rows, full if c == "more" else 0) for c in ("band", "mark", "bits", "more", "group", "chain")])
        # A passage stands in all bands; its chain is told once.
        chained = come[:, (come[5] != 0) & (come[0] % BANDS == 0)]
        chained = chained[:, np.append(True, np.diff(chained[[1, 5]], axis=1).any(axis=0))[: chained.shape[1]]]
        if chained.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.nulls(chained.shape[1], pa.int64()), pa.array(chained[1]), pa.array(chained[5])], names=["band", "mark", "chain"])
        rows = np.concatenate([held, come], axis=1)
        last = int(np.searchsorted(rows[0], rows[0, -1]))
        # A band that was too large to hold goes on.
        first = int(np.searchsorted(rows[0, :last], passed, "right")) if passed is not None and rows[0, 0] == passed else 0
        if first:
            yield pack(rows[:, :first])
        if first < last:
            yield pack(rows[:, first:last][:, near_in_band(*rows[:, first:last])])
        held = rows[:, last:]
        if held.shape[1] > HELD or held[0, 0] == passed:
            yield pack(held)
            held, passed = held[:, :0], rows[0, -1]
    if held.shape[1]:
        yield pack(held[:, near_in_band(*held)])


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, asked) as (band, mark, codes), of the (band, mark) asked; codes are the shingles' hashes, 32 bits of each."""
    for batch in batches:
        asked = pa.compute.list_flatten(batch.column("asked"))
        band, mark = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("band", "mark"))
        with np.errstate(over="ignore"):
            marks, sets = _sets(batch, mark.view(np.uint64))
        marks = marks.view(np.int64)
        order = np.argsort(marks)
        at = order[np.minimum(np.searchsorted(marks[order], mark), len(marks) - 1)] if len(marks) else np.empty(0, dtype=np.int64)
        if len(marks):
            found = marks[at] == mark
            codes = [x.tobytes() for x in (sets >> np.uint64(32)).astype("<u4")]
            yield pa.RecordBatch.from_arrays([pa.array(band[found]), pa.array(mark[found]), pa.array([codes[i] for i in at[found].tolist()], pa.binary())], names=["band", "mark", "codes"])


def _both(words: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    """Runs and passages: text, start, mark and words."""
    with np.errstate(over="ignore"):
        return (np.append(a, b) for a, b in zip(runs(words, counts), passages(words, counts), strict=True))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mark, doc_id) of runs and passages."""
    for batch in batches:
        for rows, words, counts in _slices(batch):
            text, _, mark, _ = _both(words, counts)
            yield pa.RecordBatch.from_arrays([pa.array(mark.view(np.int64)), pa.array(np.array([i for i, _ in rows], dtype=np.int64)[text])], names=["mark", "doc_id"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text_crc, start, words, mark) of runs and passages; start and words count words."""
    for batch in batches:
        for rows, words, counts in _slices(batch):
            text, start, mark, size = _both(words, counts)
            ids, crcs = (np.array(x, dtype=np.int64) for x in ([i for i, _ in rows], [zlib.crc32(t.encode()) for _, t in rows]))
            columns = ids[text], crcs[text], (start - (np.cumsum(counts) - counts)[text]).astype(np.int32), size.astype(np.int32), mark.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "text_crc", "start", "words", "mark"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, mark, codes) sorted by band: a spanning forest of the links within each band."""
    at, held = None, {}

    def pack(pairs: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])

    for batch in (b for b in batches if b.num_rows):
        out: list = []
        bands, marks, codes = batch.column("band").to_numpy(), batch.column("mark"), batch.column("codes")
        starts = np.concatenate(([0], np.flatnonzero(np.diff(bands)) + 1))
        sizes = np.diff(np.append(starts, len(bands)))
        # A band of one paragraph has nothing to compare, unless the batch before or after goes on with it.
        shared = sizes > 1
        shared[[0, -1]] = True
        for start, size in zip(starts[shared].tolist(), sizes[shared].tolist(), strict=True):
            if bands[start] != at:
                if len(held) > 1:
                    out += similar(held)
                at, held = bands[start], {}
            held.update(zip(marks.slice(start, size).to_pylist(), codes.slice(start, size).to_pylist(), strict=True))
        if out:
            yield pack(out)
    if len(held) > 1:
        yield pack(similar(held))


def similar(held: dict[int, bytes]) -> list[tuple[int, int]]:
    """Links of marks whose shingle sets reach SIMILARITY, as a spanning forest.

    A mark's value has all shingles' hashes, of four bytes each: two sets count as sharing one shingle
    too many with odds of one in two million.
    """
    if len(held) <= FEW:
        return _similar_few(held)
    marks = np.fromiter(held, dtype=np.int64, count=len(held))
    codes = np.sort(np.frombuffer(b"".join(held.values()), dtype="<u4").astype(np.int64).reshape(len(marks), _SHINGLES), axis=1)
    first = np.concatenate([np.ones((len(marks), 1), dtype=bool), np.diff(codes, axis=1) != 0], axis=1)
    if len(marks) <= ALL_PAIRS:
        groups = [np.arange(len(marks))]
    else:
        groups = []
        for c in range(_PARTS):
            key = np.where((codes % _PARTS == c) & first, codes, 0)
            _, which = np.unique((np.sort(key, axis=1) * (np.arange(_SHINGLES) * 2 + 0x5851F42D4C957F2D)).sum(axis=1), return_inverse=True)
            order = np.argsort(which, kind="stable")
            groups += [g for g in np.split(order, np.flatnonzero(np.diff(which[order])) + 1) if len(g) > 1]
    found: list[tuple[int, int]] = []
    linked = np.arange(len(marks))  # the first of the items that are linked so far
    for g in groups:
        for n, i in enumerate(g[:-1]):
            rest = g[n + 1 :]
            rest = rest[linked[rest] != linked[i]]
            if not len(rest):
                continue
            own, there, fresh = codes[i][first[i]], codes[rest], first[rest]
            shared = (np.isin(there, own) & fresh).sum(axis=1)
            for j in rest[shared >= SIMILARITY * (len(own) + fresh.sum(axis=1) - shared)]:
                if linked[j] != linked[i]:
                    linked[linked == linked[j]] = linked[i]
                    found.append((int(marks[i]), int(marks[j])))
    return found


def _similar_few(held: dict[int, bytes]) -> list[tuple[int, int]]:
    """The same for a few marks, most bands' case, without arrays."""
    marks = list(held)
    sets = [{c[i : i + len(c) // _SHINGLES] for i in range(0, len(c), len(c) // _SHINGLES)} for c in held.values()]
    found, linked = [], list(range(len(marks)))
    for i, own in enumerate(sets):
        for j in range(i + 1, len(sets)):
            if linked[i] != linked[j]:
                shared = len(own & sets[j])
                if shared >= SIMILARITY * (len(own) + len(sets[j]) - shared):
                    found.append((marks[i], marks[j]))
                    gone = linked[j]
                    linked = [linked[i] if x == gone else x for x in linked]
    return found


def placed(met: DataFrame, block: int = BLOCK) -> DataFrame:
    """``met(band, mark)`` as (band, mark): of bands with over ``block`` rows a key for each two parts, so that each two marks meet."""
    parts = met.groupBy("band").agg(F.ceil(F.count("*") / F.lit(float(block))).cast("int").alias("parts")).filter("parts > 1")
    dealt = met.join(parts, "band", "left").withColumn("mine", F.pmod(F.xxhash64(F.lit(7), "mark"), F.coalesce("parts", F.lit(1))).cast("int"))
    other = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("mine")))
    key = F.when(F.col("parts").isNull(), F.col("band")).otherwise(F.xxhash64("band", F.least("mine", "other"), F.greatest("mine", "other")))
    return dealt.withColumn("other", F.explode(other)).select(key.alias("band"), "mark")


def met_in_bands(docs: DataFrame) -> DataFrame:
    """``(band, mark, chain)``: of passages that share a band with one that may be similar, without a chain; and of those in a chain, without a band."""
    bands = docs.mapInArrow(_bands, "band long, mark long, bits long, more long, group long, chain long")
    return bands.repartition("band").sortWithinPartitions("band", "mark", "group", "chain").mapInArrow(_met, "band long, mark long, chain long")


def links(docs: DataFrame, met: DataFrame, sites: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between marks of passages that share a band in ``met(band, mark, chain)`` and are similar, and those of chains.

    ``sites(mark, doc_id)`` names a document that holds each with a band, of which the shingles are read.
    """
    asked = placed(met.filter("band is not null").select("band", "mark")).join(sites, "mark").groupBy("doc_id").agg(F.collect_list(F.struct("band", "mark")).alias("asked"))
    codes = docs.join(asked, "doc_id").mapInArrow(_codes, "band long, mark long, codes binary")
    compared = codes.repartition("band").sortWithinPartitions("band").mapInArrow(_compare, "a long, b long")
    return compared.unionByName(met.filter("chain is not null").select(F.col("mark").alias("a"), F.col("chain").alias("b")))


def repeated(docs: DataFrame) -> DataFrame:
    """Where documents hold a paragraph that stands in another document too.

    doc_id, text_crc (the CRC32 of the row's text, which tells rows of one id apart), start_word and
    end_word (of the text's words by white space, end exclusive), class_id (the smallest of the
    row's classes; a class is named by the hash of one of its paragraphs), removed. Rows with removed
    false are first places, by doc_id and start, of classes, and what overlaps these; touching ones are
    one row. First runs stay whole; of first passages those runs go that stand whole elsewhere. Rows
    with removed true are the other places, and the few words between those of one stretch, less the
    first ones, and less the few words at either end of a passage by which it can be shifted and still
    be similar, so that words around it stay with their text. A document whose repeats all lie within
    first places has no such row. Rows without doc_id, null texts and those without a word hold no
    paragraph. Rows that share an id are one document; repeated rows count once. Other columns are not
    read.
    """
    docs = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    passage = F.col("mark").bitwiseAND(1) == 1
    met = written(met_in_bands(docs))
    free(docs.sparkSession)
    # Combined before the shuffle: a paragraph with a third of all places is a row a task here.
    held = docs.mapInArrow(_marks, "mark long, doc_id long").groupBy("mark").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    near = met.groupBy("mark").agg(F.bool_or(F.col("band").isNotNull()).alias("met"))
    several = F.col("low") != F.col("high")
    shared = written(held.join(near.hint("shuffle_hash"), "mark", "left").filter(several & (~passage | F.col("met").isNotNull()) | passage & F.col("met")).select("mark", F.col("low").alias("doc_id")))
    free(docs.sparkSession)
    # A chain of which no mark stands in another document or is near one that isn't of it makes no class that spans documents.
    chained, known = met.filter("chain is not null"), shared.filter(passage)
    reached = chained.join(known, "mark").select("chain").distinct()
    linked = written(links(docs, met.filter("band is not null").unionByName(chained.join(reached, "chain", "left_semi")), known))
    free(docs.sparkSession)
    joined = components(linked)
    # The few marks are hashed, so that the many places aren't sorted. What many places are joined with is written first, so that Spark can split a hot paragraph's or class's rows.
    named = written(joined.select(F.col("node").alias("mark"), F.col("component").alias("class_id")).unionByName(shared.filter(~passage).select("mark", F.col("mark").alias("class_id"))))
    free(docs.sparkSession)
    places = docs.mapInArrow(_places, "doc_id long, text_crc long, start int, words int, mark long")
    classed = written(places.join(named.hint("shuffle_hash"), "mark").select("doc_id", "text_crc", "start", "words", "class_id"))
    free(docs.sparkSession)
    at = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("text_crc"))
    firsts = classed.groupBy("class_id", "doc_id").agg(F.min(at).alias("at"))
    ends = firsts.groupBy("class_id").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min_by("at", "doc_id").alias("first"))
    classes = written(ends.filter("low <> high").select("class_id", F.col("low").alias("first_doc"), F.col("first").alias("first_at")))
    free(docs.sparkSession)
    first_start, first_crc = F.shiftright("first_at", 32), F.col("first_at").bitwiseAND(0xFFFFFFFF)
    # Paragraphs that overlap may be of one class; in its first document those that overlap the first place stay with it.
    same_text = (F.col("doc_id") == F.col("first_doc")) & (F.col("text_crc") == first_crc)
    removed = ~(same_text & (F.col("start") < first_start + F.col("words")))
    there, ahead = F.xxhash64("first_doc", first_crc).alias("there"), (F.col("start") - first_start).cast("int").alias("ahead")
    return _spans(classed.join(classes, "class_id").select("doc_id", "text_crc", "start", "words", "class_id", removed.alias("removed"), there, ahead))


def stretches(places: list[Place]) -> list[Span]:
    """Removed runs (start, end, class, removed, there, ahead) of a text as (start, end, class).

    Runs whose first places stand in the same order in the text ``there``, each so many words
    ``ahead``, are joined with the words between them as long as these, here or there, are so few that
    the stretch and its counterpart have a word edit similarity of SIMILARITY or more.
    """
    out: list[list[int]] = []
    now = None  # start, end, class; the other text, where it starts and ends there; words that differ at most
    for start, end, name, _, there, ahead in sorted(places):
        low, high = start - ahead, end - ahead
        if now and now[3] == there:
            here, beyond = start - now[1], low - now[5]
            edits = now[6] + (max(here, beyond) if here > 0 or here != beyond else 0)
            if here == beyond <= 0 or min(here, beyond) >= 0 and edits <= (1 - SIMILARITY) * min(end - now[0], high - now[4]):
                now[1], now[2], now[5], now[6] = max(now[1], end), min(now[2], name), max(now[5], high), edits
                continue
        now = [start, end, name, there, low, high, 0]
        out.append(now)
    return [(a, b, c) for a, b, c, *_ in out]


def runs_of(places: list[Place]) -> list[tuple[int, int, int, bool]]:
    """Places (start, end, class, removed, there, ahead) of a text as spans: what stays, and what goes.

    First runs stay whole. Runs that go are equal to one of these, so they go from first passages too; all
    else that goes leaves out first passages.
    """
    equal = [p for p in places if p[3] and not p[2] & 1]
    first = _union([p[:3] for p in places if not p[3] and not p[2] & 1])
    kept = _union([p[:3] for p in places if not p[3]])
    gone = _less(_union([p[:3] for p in equal]), first)
    rest = _less(_union(_trimmed([p[:3] for p in places if p[3] and p[2] & 1]) + stretches(equal)), kept)
    return sorted([(*x, False) for x in _less(kept, gone)] + [(*x, True) for x in _union(gone + rest)])


def _less(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Spans (start, end, class) less those taken; both are sorted and don't overlap."""
    out, k = [], 0
    for start, end, name in spans:
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        for a, b, _ in itertools.takewhile(lambda x: x[0] < end, itertools.islice(taken, k, None)):
            if a > start:
                out.append((start, a, name))
            start = max(start, b)
        if start < end:
            out.append((start, end, name))
    return out


def _trimmed(spans: list[Span]) -> list[Span]:
    """Removed passages (start, end, class) of a text less the words that may be the text's own.

    Passages that are shifted by a few words are similar still, so as many at either end may be; and those of a
    class that overlap may be similar to one another only, so what they share counts. Whole texts have no end to trim.
    """
    out: list[list[int]] = []
    for start, end, name in sorted(spans, key=lambda x: (x[2], x[0], x[1])):
        if out and out[-1][2] == name and start < out[-1][1]:
            out[-1][:2] = max(out[-1][0], start), min(out[-1][1], end)
        else:
            out.append([start, end, name])
    whole = {x for x in spans if x[1] - x[0] < LENGTH}
    out = [x if tuple(x) in whole else [x[0] + _SHIFT, x[1] - _SHIFT, x[2]] for x in out]
    return [(a, b, c) for a, b, c in out if a < b]


def _union(spans: list[Span]) -> list[Span]:
    """Spans (start, end, class) sorted, with those that overlap or touch as one, by the smallest class."""
    out: list[Span] = []
    for start, end, name in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end), min(out[-1][2], name)
        else:
            out.append((start, end, name))
    return out


def _spans(hits: DataFrame) -> DataFrame:
    """The runs of each text; a task holds the places of one text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, last = None, [], None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_crc", "start", "words", "class_id", "removed", "there", "ahead")), strict=True):
                if row[:2] != now:
                    out += [(*now, *r) for r in runs_of(held)] if held else []
                    now, held = row[:2], []
                if row != last:
                    held.append((row[2], row[2] + row[3], *row[4:]))
                    last = row
            yield pack(out)
        if held:
            yield pack([(*now, *r) for r in runs_of(held)])

    def pack(rows: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "text_crc", "start_word", "end_word", "class_id", "removed"])

    ordered = hits.repartition("doc_id").sortWithinPartitions("doc_id", "text_crc", "start", "words", "class_id")
    return ordered.mapInArrow(run, "doc_id long, text_crc long, start_word int, end_word int, class_id long, removed boolean")


def remove_repeated(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with repeated passages, but for their first places, cut out of ``text``."""
    spans = repeated(docs).filter("removed").groupBy("doc_id", F.col("text_crc").alias("__crc")).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("__spans"))

    @F.arrow_udf("string")
    def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, cuts in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if text and cuts:
                words, parts, at = [m.span() for m in re.finditer(r"\S+", text)], [], 0
                for c in cuts:
                    parts.append(text[at : words[c["start_word"]][0]])
                    at = words[c["end_word"] - 1][1]
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pa.array(out, pa.string())

    names = docs.columns
    marked = docs.withColumn("__crc", F.crc32(F.col("text").cast("binary")))
    return marked.join(spans, ["doc_id", "__crc"], "left").withColumn("text", without(F.col("text"), F.col("__spans"))).select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents"))
