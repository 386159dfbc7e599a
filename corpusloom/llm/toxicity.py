"""Toxicity by weak supervision.

Voters look at a text: one for each lexicon entry (words, and word beginnings that stand for
inflected forms), and patterns such as several different entries, dense entries or shouting.
The lexicon itself comes from the labelled texts. A generative label model takes the votes and
the annotators' marks, one voter among the others, as noisy views of a hidden class:
expectation-maximisation estimates how often each voter fires in either class. Voters whose firing
the class doesn't explain are then linked in a forest, and the model has a factor for each linked
pair: a voter fires with a probability for each class and each vote of the one it hangs on. A
linear classifier is trained on the posterior labels and scores every text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import fold, hash_fraction, table

#: Labelled texts that are learned from, about; picked by a hash of the id, one text an id.
MAX_LABELLED = 12_000
#: In how many contexts of toxic texts, and how many for each such text, a lexicon entry must stand. A lexicon
#: so has at most the contexts of a toxic text, on average, by 1 / MIN_SHARE entries, whatever the input.
MIN_TEXTS, MIN_SHARE = 4, 0.01
#: Letters of a word's beginning that stand for its forms.
STEM_LETTERS = 5
#: How often an annotator is right, before the model has estimated it.
ANNOTATOR_ACCURACY = 0.97
#: Voters are linked if what the class leaves of them correlates more than LINKED; at first, as marks err too, more than COPIED.
LINKED, COPIED = 0.1, 0.4

_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"\b[^\W\d_a-z]{3,}\b[^\w\s]*!")


def entries_of(text: str | None) -> list[tuple[str, str]]:
    """Words and, with a star, beginnings of longer words, each with the word after, in order."""
    out = []
    words = _WORD.findall((text or "").lower())
    for w, after in zip(words, [*words[1:], ""], strict=False):
        out.append((w, after))
        if len(w) > STEM_LETTERS:
            out.append((w[:STEM_LETTERS] + "*", after))
    return out


class Model:
    """A lexicon and the weights of the linear classifier over its features."""

    def __init__(self, lexicon: list[str], weights: np.ndarray, base: float):
        self.lexicon = {w: i for i, w in enumerate(lexicon)}
        self.weights, self.base = weights, base

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.base)
        rows = np.stack([features(t, self.lexicon) for t in texts]) if texts else np.empty((0, len(self.weights) - 1))
        return _sigmoid(rows @ self.weights[1:] + self.weights[0])


N_PATTERNS = 10


def features(text: str | None, lexicon: dict[str, int]) -> np.ndarray:
    """Patterns first, then the logarithm of one plus the count of each entry."""
    out = np.zeros(N_PATTERNS + len(lexicon), dtype=np.float32)
    words = _WORD.findall((text or "").lower())
    hits = 0
    different = set()
    get = lexicon.get
    for w in words:
        i = get(w)
        if i is None and len(w) > STEM_LETTERS:
            i = get(w[:STEM_LETTERS] + "*")
        if i is not None:
            hits += 1
            different.add(w)
            out[N_PATTERNS + i] += 1
    out[N_PATTERNS:] = np.log1p(out[N_PATTERNS:])
    dense = hits / max(1, len(words))
    out[:N_PATTERNS] = (
        hits >= 1,
        hits >= 2,
        hits >= 3,
        len(different) >= 2,
        len(different) >= 4,
        dense >= 0.01,
        dense >= 0.03,
        np.log1p(hits),
        min(1.0, dense * 10),
        bool(text) and bool(_SHOUT.search(text)),
    )
    return out


def votes(rows: np.ndarray) -> np.ndarray:
    """Which voters fire: patterns but the two measures, and entries."""
    keep = [i for i in range(rows.shape[1]) if i not in (7, 8)]
    return rows[:, keep] > 0


def label_model(fired: np.ndarray, marks: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the positive class for each row of votes and annotators' marks, and each voter's accuracy, the annotators' last.

    Each voter hangs on one other voter at most, so the votes' probability given the class is a
    product of one factor for each voter.
    """
    x = np.concatenate([fired, marks[:, None] > 0], axis=1).astype(np.float64)
    n = len(x)
    post = np.where(marks > 0, ANNOTATOR_ACCURACY, 1 - ANNOTATOR_ACCURACY)
    for least in (COPIED, LINKED):  # first by the marks, then by what the model makes of them
        parent = _forest(_rest(x, post), least)
        above = np.where(parent >= 0, x[:, parent], 0.0)
        for _ in range(rounds):
            logit = np.full(n, np.log(np.clip(post.mean(), 1e-4, 1 - 1e-4)) - np.log(np.clip(1 - post.mean(), 1e-4, 1)))
            for sign, weight in ((1, post), (-1, 1 - post)):
                for vote, held in ((1, above), (0, 1 - above)):
                    total = weight @ held
                    rate = (weight @ (x * held) + 0.5) / (total + 1)
                    logit += sign * ((x * held) @ np.log(rate) + ((1 - x) * held) @ np.log(1 - rate))
            new = _sigmoid(logit)
            moved = np.abs(new - post).max()
            post = new
            if moved < 1e-4:
                break
    return post, (post @ x + (1 - post) @ (1 - x)) / n


def _rest(x: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Correlations of the voters that the class leaves unexplained."""
    p1, p0 = (post @ x + 0.5) / (post.sum() + 1), ((1 - post) @ x + 0.5) / ((1 - post).sum() + 1)
    rest = x - (post[:, None] * p1 + (1 - post)[:, None] * p0)
    rest /= np.sqrt((rest**2).mean(axis=0)) + 1e-9
    return np.abs(rest.T @ rest / len(x))


def _forest(strength: np.ndarray, least: float = LINKED) -> np.ndarray:
    """For each voter the one it hangs on, or -1: a spanning forest of the strongest links over ``least``; annotators are linked with none."""
    k = len(strength)
    parent, free, best, link = np.full(k, -1), np.ones(k, dtype=bool), np.full(k, -1.0), np.full(k, -1)
    free[-1] = False
    while free.any():
        i = int(np.where(free, best, -2).argmax())
        parent[i] = link[i] if best[i] > least else -1
        free[i] = False
        closer = strength[i] > best
        best[closer], link[closer] = strength[i][closer], i
    return parent


def fit_linear(rows: np.ndarray, target: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression on soft labels by Newton steps; the first weight is the base."""
    x = np.concatenate([np.ones((len(rows), 1)), rows.astype(np.float64)], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        grad = x.T @ (p - target) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), grad)
        size = np.abs(step).max()
        w -= step * min(1.0, 5 / max(size, 1e-9))
        if size < 1e-5:
            break
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from texts with a label; an id with several labels counts as toxic if one says so.

    The sample's bound holds whatever the tables' sizes: ids are picked by hash, at a rate from
    the number of labels, and of rows that share an id the least text counts. Without labels of
    both classes every score is the toxic share.
    """
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(fold("doc_id", 5) != 0)
    n, share = marks.agg(F.count("*"), F.avg("toxic")).first()
    if not n or share in (0, 1):
        return Model([], None, float(share or 0))
    sample = marks.filter(hash_fraction("doc_id", 5) < min(1.0, max_labelled / n))
    one_text = docs.select("doc_id", "text").join(sample.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    texts = one_text.join(sample, "doc_id").select("doc_id", "text", "toxic")

    def contexts(batches):
        for batch in batches:
            found = {(w, after, mark) for text, mark in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True) for w, after in entries_of(text)}
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))], names=["entry", "after", "toxic"])

    size, positive = texts.agg(F.count("*"), F.sum("toxic")).first()
    if not size or not positive or positive == size:
        return Model([], None, float(share))
    # An entry counts once for each word that follows it: copies of a text add nothing.
    once = texts.mapInArrow(contexts, "entry string, after string, toxic int").groupBy("entry", "after").agg(F.max("toxic").alias("toxic"))
    counted = once.groupBy("entry").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).filter(F.col("t") >= max(MIN_TEXTS, MIN_SHARE * positive))
    rate = positive / size
    odds = F.log((F.col("t") + 0.5) / (F.col("n") - F.col("t") + 0.5)) - float(np.log(rate / (1 - rate)))
    # Seldom in clean texts: a toxic share far above the usual one, by more than chance.
    best = counted.withColumn("odds", odds).filter(F.col("odds") > 2.5).select("entry").collect()
    lexicon = sorted(r["entry"] for r in best)
    place = {w: i for i, w in enumerate(lexicon)}
    width = N_PATTERNS + len(lexicon)

    def measure(batches):
        for batch in batches:
            rows = [features(t, place).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column("toxic")], names=["row", "toxic"])

    learnt = texts.mapInArrow(measure, "row binary, toxic int").toPandas()
    rows = np.stack([np.frombuffer(r, dtype=np.float32) for r in learnt["row"]]).reshape(-1, width)
    post, _ = label_model(votes(rows), learnt["toxic"].to_numpy())
    return Model(lexicon, fit_linear(rows, post), rate)


def toxicity(spark: SparkSession, text: Column, model: Model) -> Column:
    """The score of a text, 0 to 1; null and empty texts get the score of a text without words."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(texts.to_pylist()), pa.float64())

    return run(text)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``.

    Rows without doc_id are not held out and not learned from. Repeated rows each give a row.
    Other columns than doc_id, text and toxic are not read.
    """
    model = train(docs, labels)
    out = docs.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), toxicity(docs.sparkSession, F.col("text"), model).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
