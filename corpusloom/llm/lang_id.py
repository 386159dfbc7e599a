"""Language identification of mixed texts by expectation-maximisation.

Character bigrams and trigrams of labelled texts give each language's n-gram likelihoods. A
document is a mixture: each word comes from one language with the likelihood of its n-grams.
Expectation-maximisation estimates the languages' proportions; languages then enter by
proportion as long as the likelihood, less a price for each language, grows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import fold, hash_fraction, table

BUCKETS = 1 << 16
#: Labelled texts of each language that are learned from, about; picked by a hash of the id.
TEXTS_PER_LANGUAGE = 1000
SMOOTHING = 0.2
ROUNDS = 8
#: Price of a further language, times the logarithm of the number of words.
PRICE = 3.0
#: Longer words are cut, as scripts without spaces have none.
WORD_LETTERS = 24
UNDETERMINED = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each letter's bigram and trigram (letters by 2), and where words start."""
    none = np.empty((0, 2), dtype=np.int64), np.empty(0, dtype=np.int64)
    if not text:
        return none
    points = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4").astype(np.int64)
    letter = _letters()[points]
    if not letter.any():
        return none
    # One zero stands for any run of other characters.
    kept = letter | np.concatenate(([True], letter[:-1]))
    row = np.concatenate(([0], np.where(letter, points, 0)[kept], [0]))
    at = np.flatnonzero(row)
    two = row[at - 1] * 0x9E3779B1 + row[at] * 0x85EBCA77
    three = (two * 0xC2B2AE3D + row[at + 1] * 0x27D4EB2F + 0x165667B1) & 0xFFFFFFFFFFFF
    two &= 0xFFFFFFFFFFFF
    both = np.stack([two ^ (two >> 23), three ^ (three >> 19)], axis=1) & (BUCKETS // 2 - 1)
    both[:, 1] += BUCKETS // 2
    first = row[at - 1] == 0
    starts = np.flatnonzero(first)
    place = np.arange(len(at)) - starts[np.cumsum(first) - 1]
    return both, np.flatnonzero(place % WORD_LETTERS == 0)


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: languages by buckets."""
        self.languages = languages
        scores = np.log(counts + SMOOTHING)
        half = BUCKETS // 2
        for part in (slice(0, half), slice(half, BUCKETS)):
            scores[:, part] -= np.log((counts[:, part] + SMOOTHING).sum(axis=1, keepdims=True))
        self.scores = np.ascontiguousarray(scores.T.astype(np.float32))

    def mixture(self, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
        """The main language, its proportion before selection, and the selected set with proportions."""
        found, starts = grams(text)
        if not len(found) or not self.languages:
            return UNDETERMINED, 0.0, []
        logs = self.scores[found[:, 0]] + self.scores[found[:, 1]]
        words = np.add.reduceat(logs, starts, axis=0).astype(np.float64)
        top = words.max(axis=1, keepdims=True)
        likely = np.exp(words - top)
        shares, _ = _fit(likely)
        order = np.argsort(-shares, kind="stable")
        best, best_shares, best_value = order[:1], np.ones(1), float(np.log(np.maximum(likely[:, order[0]], 1e-300)).sum())
        price = PRICE * np.log(len(words) + 1)
        for k in range(2, len(order) + 1):
            some, value = _fit(likely[:, order[:k]])
            value -= price * (k - 1)
            if value <= best_value:
                break
            best, best_shares, best_value = order[:k], some, value
        chosen = sorted(((self.languages[i], float(s)) for i, s in zip(best, best_shares, strict=True)), key=lambda x: -x[1])
        main = chosen[0][0]
        return main, float(min(1.0, max(0.0, shares[self.languages.index(main)]))), chosen


def _fit(likely: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the columns and the log-likelihood under them."""
    shares = np.full(likely.shape[1], 1 / likely.shape[1])
    for _ in range(ROUNDS):
        whole = likely @ shares
        shares = shares * (likely.T @ (1 / np.maximum(whole, 1e-300))) / len(likely)
        shares /= shares.sum()
    return shares, float(np.log(np.maximum(likely @ shares, 1e-300)).sum())


def train(labelled: DataFrame, texts_per_language: int = TEXTS_PER_LANGUAGE) -> Model:
    """Learn from ``labelled(doc_id, text, lang)``; null texts, langs and ids are left out.

    The model has one column a language: 65,536 counts each, whatever the number of texts.
    """
    rows = labelled.select("doc_id", "text", "lang").filter("doc_id is not null and text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)))
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, texts_per_language / n))))
    sample = rows.filter(hash_fraction("doc_id", 11) < F.element_at(share, F.col("lang"))).repartition(8, "doc_id")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                found, _ = grams(text)
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, dtype=np.int64)
                sums[lang] += np.bincount(found.ravel(), minlength=BUCKETS)
        for lang, n in sums.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(n[used], pa.int64())], names=["lang", "bucket", "n"])

    counts = np.zeros((len(languages), BUCKETS))
    place = {lang: i for i, lang in enumerate(languages)}
    summed = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts[summed["lang"].map(place).to_numpy(dtype=np.int64), summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return Model(languages, counts)


def identify(spark: SparkSession, text: Column, model: Model) -> Column:
    """A struct of lang_pred, score and mixture (an array of lang and share).

    lang_pred is ``und`` and score 0 for null texts and those without a letter.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, mixture: array<struct<lang: string, share: double>>>")
    def run(texts: pa.Array) -> pa.Array:
        found = [shared.value.mixture(t) for t in texts.to_pylist()]
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([[{"lang": a, "share": s} for a, s in f[2]] for f in found], kind)],
            ["lang_pred", "score", "mixture"],
        )

    return run(text)


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: those with an id outside the held-out fold."""
    return docs.filter(fold("doc_id", 4) != 2)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and mixture of each row of ``docs``.

    Rows without doc_id are not held out and not learned from. Other columns than doc_id, text
    and lang are not read.
    """
    model = train(learnable(docs))
    found = docs.select("doc_id", identify(docs.sparkSession, F.col("text"), model).alias("f"))
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "f.lang_pred", "f.score", "f.mixture")


def keep_identified(docs: DataFrame, min_share: float = 0.4) -> DataFrame:
    """Rows of ``docs`` with a language that holds at least ``min_share`` of the text."""
    found = identify(docs.sparkSession, F.col("text"), train(learnable(docs)))
    names = docs.columns
    return docs.withColumn("__language", found).filter((F.col("__language.lang_pred") != UNDETERMINED) & (F.col("__language.score") >= min_share)).select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents")).drop("mixture")
