"""Secret scans: keyword prefilter, anchored patterns near hits, checksums inside the secrets.

An Aho-Corasick automaton finds keywords in one pass over the lower-cased text. Only at its hits
is a pattern matched, anchored at the hit. What carries its own proof is then checked: the CRC32
at the end of a token, or a web token's encoded header. Runs of hex digits have no keyword and
are found by their own pattern.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

#: Base kinds first, in the order that breaks ties; the others are the method's own.
KINDS = ("assign", "access", "hex", "token_crc", "web_token", "private_key", "api_key")

_LETTERS = {w: "".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token", "api", "key")}
_ASSIGN = re.compile(
    f"(?:{_LETTERS['password']}|{_LETTERS['passwd']}|{_LETTERS['secret']}|{_LETTERS['token']}|{_LETTERS['api']}_?{_LETTERS['key']})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN_CRC = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_WEB_RUN = re.compile(r"[A-Za-z0-9_-]+")
_WEB_TOKEN = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
_PRIVATE_KEY = re.compile(r"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----[A-Za-z0-9+/=\s]+-----END \1-----")
_API_KEY = re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])|[sr]k_live_[A-Za-z0-9]{24,}|xox[abprs]-[A-Za-z0-9-]{10,}")

_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_suffix(body: str) -> str:
    """The CRC32 of a token's body as six base-62 digits."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _DIGITS[digit] + out
    return out


def _crc_holds(m: re.Match) -> bool:
    return crc_suffix(m[1]) == m[2]


def _header_holds(m: re.Match) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (ValueError, RecursionError):  # nested deeper than any header
        return False
    return isinstance(head, dict) and "alg" in head


#: Lower-case keyword: (kind, pattern, test).
_RULES = {
    **{w: ("assign", _ASSIGN, lambda m: len(m[1]) >= 6) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")},
    "akia": ("access", _ACCESS, lambda m: len(m[0]) >= 20),
    **{f"{w}_": ("token_crc", _TOKEN_CRC, _crc_holds) for w in ("ghp", "gho", "ghu", "ghs", "ghr", "npm")},
    "eyj": ("web_token", _WEB_TOKEN, _header_holds),
    "-----begin ": ("private_key", _PRIVATE_KEY, lambda m: True),
    **{w: ("api_key", _API_KEY, lambda m: True) for w in ("aiza", "sk_live_", "rk_live_", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")},
}


@functools.lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word in _RULES:
        a.add_word(word, (len(word), *_RULES[word]))
    a.make_automaton()
    return a


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by start, then kind; leftmost without overlap within a kind."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # this one letter grows when it is lower-cased
        low = text.replace("İ", "i").lower()
    hits = sorted(((end + 1 - size, kind, pattern, test) for end, (size, kind, pattern, test) in _automaton().iter(low)), key=lambda h: h[0])
    return _anchored(text, hits)


def _anchored(text: str, hits: list) -> list[tuple[str, int, int]]:
    free = dict.fromkeys(KINDS, 0)
    spans = []
    for start, kind, pattern, test in hits:
        if start < free[kind]:
            continue
        if m := pattern.match(text, start):
            free[kind] = m.end()  # a match that fails its test still takes its place
            if test(m):
                spans.append((kind, start, m.end()))
        elif kind == "web_token" and (run := _WEB_RUN.match(text, start)):
            free[kind] = run.end()  # what follows the run is the same for every hit in it
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(text: Column) -> Column:
    """An array of structs (kind, start, end), by start, then kind; empty for null and empty texts."""

    @F.arrow_udf("array<struct<kind: string, start: int, end: int>>")
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for t in texts.to_pylist()], kind)

    return run(text)


def redact(text: Column, mask: str = "[SECRET]") -> Column:
    """The text with each secret, overlapping ones together, replaced; null stays null."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            spans = find(t)
            if spans:
                parts, at = [], 0
                for _, start, end in spans:
                    if start >= at:
                        parts += [t[at:start], mask]
                    at = max(at, end)
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pa.array(out, pa.string())

    return run(text)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """Counts and spans of each row of ``docs``; other columns than doc_id and text are not read."""
    found = docs.select("doc_id", scan(F.col("text")).alias("s"))
    base = F.filter("s", lambda s: s["kind"].isin(*KINDS[:3]))
    number = lambda kind: F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, KINDS[:3]), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("s")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
