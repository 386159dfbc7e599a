"""SentencePiece BPE encoding by a table of each prefix's last token, and decoding.

In byte-pair encoding the encoding of every prefix of a word ends in one definite token. The
table of these is filled from left to right: an Aho-Corasick automaton gives the tokens that
end at a position, and the one whose predecessor (the last token of the prefix before it) forms
a compatible pair is stored. A pair is compatible if encoding its joined string gives the pair
back; that is tested by undoing both tokens' merges from the latest to the earliest and asking
whether a merge across the border would have come first. The ids are then read backwards.

No piece of the model has a space sign after another character, so a text is cut before each
run of space signs, and at characters that are no piece; words are remembered in a bounded
table. Spark partitions the texts; a task holds the model's tables (about 10 MB).
"""

from __future__ import annotations

import functools
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

SPACE = "▁"
#: Words remembered by a worker, and the longest word that is.
CACHE_WORDS, CACHE_CHARS = 300_000, 48

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message: ints, 4 or 8 bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def default_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


class Model:
    """The pieces of a BPE model file, and encoding and decoding with them."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        scores, kinds, self.dummy_prefix = [], [], True
        for number, value in _fields(data):
            if number == 1:
                piece = {k: v for k, v in _fields(value)}
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = {k: v for k, v in _fields(value)}
                if trainer.get(3, 1) != 2:
                    raise NotImplementedError("the model is not of type BPE")
            elif number == 3:
                rules = {k: v for k, v in _fields(value)}
                self.dummy_prefix = bool(rules.get(3, 1))
                if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
                    raise NotImplementedError("only models that leave texts as they are, but for space signs, are read")
        if USER_DEFINED in kinds or UNUSED in kinds:
            raise NotImplementedError("user-defined and unused pieces are not read")
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == BYTE}
        self.unknown = kinds.index(UNKNOWN)
        self.begin, self.end = self.pieces.index("<s>"), self.pieces.index("</s>")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == NORMAL}
        order = sorted(self.ids, key=lambda p: (-scores[self.ids[p]], self.ids[p]))
        self.rank = {p: n for n, p in enumerate(order)}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise NotImplementedError("a piece has a space sign after another character")
        self.chars = {p for p in self.ids if len(p) == 1}
        self.halves: dict[str, tuple[str, str]] = {}
        for p in order:
            if len(p) > 1 and (halves := self._last_merge(p)):
                self.halves[p] = halves
        late = [p for p, (a, b) in self.halves.items() if self.rank[p] < max((self.rank[x] for x in (a, b) if len(x) > 1), default=-1)]
        self.in_order = not late
        automaton = ahocorasick.Automaton()
        for p in [*self.chars, *self.halves]:
            automaton.add_word(p, p)
        automaton.make_automaton()
        self.automaton = automaton
        breaks = "".join(re.escape(c) for c in "\n\r\t" if c not in self.chars)
        self.cut = re.compile(f"[{breaks}]|{SPACE}+[^{SPACE}{breaks}]*|[^{SPACE}{breaks}]+" if breaks else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        plain = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for value, i in self.bytes.items():
            plain[i] = bytes([value])
        for i, k in enumerate(kinds):
            if k == CONTROL:
                plain[i] = b""
        plain[self.unknown] = " ⁇ ".encode()
        self.plain = plain
        self._compatible = functools.lru_cache(maxsize=200_000)(self._pair_stays)
        self.words = _Words(self)

    def merges(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merge the best pair, the leftmost of equals, until none is a piece; and the last merge."""
        parts, last = list(text), None
        while True:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                return parts, last
            i = best[1]
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        if any(c not in self.chars for c in piece):
            return None
        parts, last = self.merges(piece)
        return last if len(parts) == 1 else None

    def _pair_stays(self, left: str, right: str) -> bool:
        if not self.in_order:
            return self.merges(left + right)[0] == [left, right]
        rank, halves = self.rank, self.halves
        until, strict = None, False
        while True:
            across = rank.get(left + right)
            if across is not None and (until is None or across < until or (across == until and not strict)):
                return False
            a = rank[left] if left in halves else -1
            b = rank[right] if right in halves else -1
            if a < 0 and b < 0:
                return True
            if b >= a:  # the right one was merged later; a merge across it of equal rank stands further left
                until, strict, right = b, False, halves[right][0]
            else:
                until, strict, left = a, True, halves[left][1]

    def _known(self, word: str) -> list[int]:
        """Ids of a word whose characters are all pieces."""
        last: list[str | None] = [None] * (len(word) + 1)
        stays, at = self._compatible, 0
        for end, piece in self.automaton.iter(word):
            if end >= at:  # no token is stored for this prefix yet
                start = end + 1 - len(piece)
                if not start or stays(last[start], piece):
                    at = end + 1
                    last[at] = piece
        ids, at = [], len(word)
        while at:
            piece = last[at]
            ids.append(self.ids[piece])
            at -= len(piece)
        return ids[::-1]

    def word(self, word: str) -> bytes:
        """Ids of a word as little-endian 32-bit integers; characters that are no piece give bytes."""
        if self.chars.issuperset(word):
            ids = self._known(word)
        else:
            ids, start = [], 0
            for i, c in enumerate(word):
                if c not in self.chars:
                    if start < i:
                        ids += self._known(word[start:i])
                    ids += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]
                    start = i + 1
            if start < len(word):
                ids += self._known(word[start:])
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """All ids with begin and end as little-endian unsigned 32-bit integers."""
        spaced = text.replace(" ", SPACE)
        if spaced and self.dummy_prefix:
            spaced = SPACE + spaced
        body = b"".join(map(self.words.__getitem__, self.cut.findall(spaced)))
        return struct.pack("<I", self.begin) + body + struct.pack("<I", self.end)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; a byte that is part of no character becomes U+FFFD."""
        plain = self.plain
        body = [i for i in ids if plain[i]]
        out = b"".join([plain[i] for i in body])
        if body and self.dummy_prefix and self.pieces[body[0]].startswith(SPACE):
            out = out[1:]
        try:
            return out.decode()
        except UnicodeDecodeError:
            return _lenient(out)


def _lenient(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


class _Words(dict):
    """Encoded words; emptied when full."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> bytes:
        ids = self.model.word(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


_loaded: dict[int, Model] = {}


def _model(data: bytes) -> Model:
    key = hash(data)
    if key not in _loaded:
        _loaded[key] = Model(data)
    return _loaded[key]


def tokenize(spark: SparkSession, text: Column, model: bytes | None = None) -> Column:
    """A struct of ``ids`` (binary: little-endian unsigned 32-bit, begin and end included) and ``decoded``.

    Equals the sentencepiece library without sampling. Null and empty texts give begin and end
    only, and an empty decoded text. ``model`` is a model file's bytes; the public 32k BPE model
    if none is given.
    """
    shared = spark.sparkContext.broadcast(model or default_model())

    @F.arrow_udf("struct<ids: binary, decoded: string>")
    def run(texts: pa.Array) -> pa.Array:
        m = _model(shared.value)
        packed = [m.encode(t or "") for t in texts.to_pylist()]
        decoded = [m.decode(np.frombuffer(p, dtype="<u4").tolist()) for p in packed]
        return pa.StructArray.from_arrays([pa.array(packed, pa.binary()), pa.array(decoded, pa.string())], ["ids", "decoded"])

    return run(text)


def unpack(ids: Column) -> Column:
    """Packed ids as an array of ints."""

    @F.arrow_udf("array<int>")
    def run(packed: pa.Array) -> pa.Array:
        return pa.array([None if p is None else np.frombuffer(p, dtype="<u4").astype(np.int32) for p in packed.to_pylist()], pa.list_(pa.int32()))

    return run(ids)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``docs``; other columns are not read."""
    done = docs.select("doc_id", tokenize(docs.sparkSession, F.col("text")).alias("t"))
    return done.select("doc_id", (F.octet_length("t.ids") / 4).cast("long").alias("n_tokens"), F.sha2(F.col("t.ids"), 256).alias("ids_sha256"), F.sha2(F.col("t.decoded").cast("binary"), 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
