"""Cloze question answering: candidate scores, answers, ranks."""

from __future__ import annotations

import collections

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType


def _nearest_sums(batches):
    """For each question the entities' sums over its words of the nearest 1 / (1 + distance), by sorted search."""
    for batch in batches:
        qids, entities, scores = [], [], []
        for qid, context, question, named in zip(*(batch.column(c) for c in ("qid", "context", "question", "named")), strict=True):
            tokens = np.array([x["token"] for x in context.as_py()], object)
            place = np.array([x["place"] for x in context.as_py()], np.int64)
            at = collections.defaultdict(list)
            for i, token in enumerate(tokens):
                at[token].append(i)
            names = [x["entity"] for x in named.as_py()]
            held = [place[at[n]] if n in at else place[:0] for n in names]
            spots, starts = np.concatenate([*held, place[:0]]), np.cumsum([0, *map(len, held)])
            there = np.flatnonzero(np.diff(starts))
            total, lost = np.zeros(len(there)), np.zeros(len(there))
            best: dict = {}
            for i, token, hole in sorted({(x["place"], x["token"], x["hole"]) for x in question.as_py()}):
                if token in at and len(there):
                    goals = np.sort(place[at[token]]) + hole - i
                    k = np.searchsorted(goals, spots)
                    gap = np.minimum(np.abs(spots - goals[np.minimum(k, len(goals) - 1)]), np.abs(spots - goals[np.maximum(k - 1, 0)]))
                    near = 1 / (1 + np.minimum.reduceat(gap, starts[there]))
                    best[i] = np.maximum(best[i], near) if i in best else near
            for near in best.values():  # terms are at most 1; what a sum loses is kept, so that the order hardly counts
                now = total + near
                lost += np.where(total >= near, (total - now) + near, (near - now) + total)
                total = now
            qids += [qid] * len(names)
            entities += names
            scores.append(np.zeros(len(names)))
            scores[-1][there] = total + lost
        yield pa.RecordBatch.from_arrays([pa.array([q.as_py() for q in qids], batch.schema.field("qid").type), pa.array(entities, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]))], ["qid", "entity", "score"])


def word_proximity(context: DataFrame, question: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, entity, score): over question words the sum of the nearest 1 / (1 + abs(ie - iw - ip + i)).

    context(qid, place, token), question(qid, place, token, hole) with the placeholder's place as
    ``hole``, entities(qid, entity) are tokens of the context. A question is a row with its words, so pairs of places
    are never made: the nearest of a word's sorted places is looked up for each of an entity's.
    """
    listed = lambda df, name, *columns: df.filter("qid is not null").groupBy("qid").agg(F.collect_list(F.struct(*columns)).alias(name))
    named = entities.groupBy("qid").agg(F.array_sort(F.collect_set(F.struct("entity"))).alias("named"))
    words = listed(question.filter("place <> hole and token is not null"), "question", "place", "token", "hole")
    rows = named.join(listed(context.filter("token is not null and place is not null"), "context", "place", "token"), "qid", "left").join(words, "qid", "left")
    rows = rows.select("qid", "named", *(F.coalesce(c, F.array()).alias(c) for c in ("context", "question")))
    return rows.mapInArrow(_nearest_sums, StructType([entities.schema["qid"], StructField("entity", StringType()), StructField("score", DoubleType())]))


def embed_proximity(context: DataFrame, question: DataFrame, similar: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, entity, score): context words similar to question words vote for the nearest entity before and after.

    A vote is the similarity over one plus the distance; a position that is the entity itself doesn't vote. ``similar`` is
    (token, other, sim) for all questions, or (qid, token, other, sim) with what each question needs, where words have
    so many others that a list for all is too long.
    """
    marks = context.join(entities.select("qid", F.col("entity").alias("token"), F.lit(True).alias("is_entity")).distinct(), ["qid", "token"], "left")
    w = W.partitionBy("qid").orderBy("place")
    here = F.when(F.col("is_entity"), F.struct("place", "token"))
    rows = marks.withColumn("prior", F.last(here, True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("next", F.first(here, True).over(w.rowsBetween(1, W.unboundedFollowing))).filter("is_entity is null")
    asked = question.select("qid", F.col("token").alias("other")).distinct()
    near = similar.join(asked, ["qid", "other"], "left_semi") if "qid" in similar.columns else asked.join(similar, "other")
    voting = rows.join(near.groupBy("qid", "token").agg(F.sum("sim").alias("sim")), ["qid", "token"])
    both = voting.select("qid", "place", "sim", F.explode(F.array("prior", "next")).alias("e")).filter("e is not null")
    return both.groupBy("qid", F.col("e.token").alias("entity")).agg(F.sum(F.col("sim") / (1 + F.abs(F.col("e.place") - F.col("place")))).alias("score"))


def bow_overlap(sentences: DataFrame, question: DataFrame, counts: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, entity): the first entity of the sentence with the largest sum of N / freq over shared words.

    sentences(qid, sentence, place, token); counts(token, n). Of equal sentences the first counts.
    """
    total = counts.agg(F.sum("n").alias("total"))
    shared = sentences.select("qid", "sentence", "token").distinct().join(question.select("qid", "token").distinct(), ["qid", "token"])
    scored = shared.join(counts, "token").crossJoin(F.broadcast(total)).groupBy("qid", "sentence").agg(F.sum(F.col("total") / F.col("n")).alias("s"))  # one row
    held = sentences.join(entities.select("qid", F.col("entity").alias("token")), ["qid", "token"]).groupBy("qid", "sentence").agg(F.min_by("token", "place").alias("entity"))
    return scored.join(held, ["qid", "sentence"]).groupBy("qid").agg(F.min(F.struct((-F.round("s", 9)).alias("k"), "sentence", "entity")).alias("m")).select("qid", "m.entity")


def candidate_features(context: Column, question: Column, entity: Column) -> Column:
    """exists, in_question, frequency, first (-1 if none), left and right hits of the words beside the placeholder, at most 1."""
    places = F.filter(F.transform(context, lambda t, i: F.when(t == entity, i)), lambda i: i.isNotNull())
    hole = F.array_position(question, "@placeholder").cast("int") - 1
    beside = lambda places, off: F.exists(places, lambda p: F.get(context, p + off) == F.get(question, hole + off))
    features = lambda places: F.struct(
        F.array_contains(context, entity).alias("exists"),
        F.array_contains(question, entity).alias("in_question"),
        F.size(places).alias("frequency"),
        F.coalesce(F.get(places, F.lit(0)), F.lit(-1)).alias("first"),
        F.coalesce(beside(places, -1), F.lit(False)).cast("int").alias("left"),
        F.coalesce(beside(places, 1), F.lit(False)).cast("int").alias("right"),
    )
    return F.get(F.transform(F.array(places), features), F.lit(0))  # places are worked out once


def pick_answer(scores: DataFrame, compat: bool = False) -> DataFrame:
    """(qid, entity): the best score, of equals the first by name; ``compat`` lets the right answer win ties."""
    order = [F.desc("score"), *([F.desc("right")] if compat else []), F.col("entity")]
    return scores.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(*order))).filter("place = 1").select("qid", "entity")


def answer_rank(scores: DataFrame) -> DataFrame:
    """(rank, n): how often the right candidate of ``scores(qid, entity, score, right)`` stands at each rank."""
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "entity"))
    return scores.withColumn("rank", place).filter("right").groupBy("rank").agg(F.count("*").alias("n"))


def qa_accuracy(answers: DataFrame, gold: DataFrame) -> DataFrame:
    return gold.join(answers.select("qid", F.col("entity").alias("got")), "qid", "left").agg(F.avg(F.coalesce((F.col("got") == F.col("entity")).cast("double"), F.lit(0.0))).alias("accuracy"))
