"""Question-answer queries: an order's suppliers as a context, a customer's as entities."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators import qa as Q
from corpusloom.operators import vectors as V
from corpusloom.plans.inputs import PAIRS_SQL, letters, pairs, r6
from corpusloom.plans.vectors import letter_pairs


def rnd(df):
    return df.select(*(r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def convs(s, d):
    """User turns as questions with the second word hidden, the assistant's turns after them as contexts."""
    return pairs(s, d).select(F.concat_ws("-", "conv_id", "turn").alias("qid"), letters(F.col("text_a")).alias("q"), letters(F.col("text_b")).alias("a"))

_W = "list_filter(string_split_regex(lower({}), '[^a-z]+'), lambda w: w <> '')"
_C = f"""{PAIRS_SQL}, cv AS (SELECT * FROM (SELECT conv_id || '-' || turn AS qid, {_W.format('text_a')} AS q, {_W.format('text_b')} AS a FROM pairs)),
cx AS (SELECT qid, unnest(range(len(a))) AS place, unnest(a) AS token FROM cv), qu AS (SELECT qid, unnest(range(len(q))) AS place, unnest(q) AS token, 1 AS hole FROM cv), en AS (SELECT DISTINCT qid, token AS entity FROM cx)"""


def parts(s, d):
    c = convs(s, d)
    context = c.select("qid", F.posexplode("a").alias("place", "token"))
    question = c.select("qid", F.posexplode("q").alias("place", "token")).withColumn("hole", F.lit(1))
    return context, question, context.select("qid", F.col("token").alias("entity")).distinct()


_PROX = f"WITH {_C}, iw AS (SELECT qu.qid, qu.place AS i, cx.place AS w FROM qu JOIN cx USING (qid, token) WHERE qu.place <> 1), ie AS (SELECT en.qid, entity, place AS e FROM en JOIN cx ON cx.qid = en.qid AND token = entity), b AS (SELECT qid, entity, i, max(1.0::DOUBLE / (1 + abs(e - w - 1 + i))) AS s FROM ie JOIN iw USING (qid) GROUP BY 1, 2, 3), sc AS (SELECT en.qid, en.entity, coalesce(sum(s), 0) AS score FROM en LEFT JOIN b USING (qid, entity) GROUP BY 1, 2)"


def scores(s, d):
    return rnd(Q.word_proximity(*parts(s, d)))


def judged(s, d):
    x = scores(s, d)
    return x.withColumn("right", F.row_number().over(W.partitionBy("qid").orderBy(F.length("entity"), "entity")) == 1)


_JD = _PROX + ", jd AS (SELECT qid, entity, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY length(entity), entity) = 1 AS ok FROM sc)"


def _embed(s, d):
    """Entities are names: here words of more than five letters, as a context word that is none is what scores are about."""
    context, question, entities = parts(s, d)
    entities = entities.filter("length(entity) > 5")
    words = lambda df, name: df.select("qid", F.col("token").alias(name), F.substring("token", 1, 2).alias("start")).distinct()
    same = F.when(F.col("token") == F.col("other"), 1.0).otherwise(0.5)
    similar = words(context, "token").join(words(question, "other"), ["qid", "start"]).select("qid", "token", "other", same.alias("sim"))
    return rnd(Q.embed_proximity(context, question, similar, entities))


def _near(s, d):
    """Words are near by their pairs of letters; each is near itself."""
    context, question, entities = parts(s, d)
    near = V.near_words(letter_pairs(s, d), 0.9).select(F.col("word").alias("token"), "other", "sim")
    same = context.select("token").distinct().select("token", F.col("token").alias("other"), F.lit(1.0).alias("sim"))
    return rnd(Q.embed_proximity(context, question, near.unionByName(same), entities.filter("length(entity) > 5")))


def _bow(s, d):
    context, question, entities = parts(s, d)
    sentences = context.withColumn("sentence", F.floor(F.col("place") / 8))
    return Q.bow_overlap(sentences, question, context.groupBy("token").agg(F.count("*").alias("n")), entities)


def _features(s, d):
    c = convs(s, d).withColumn("h", F.transform("q", lambda t, i: F.when(i == 1, "@placeholder").otherwise(t)))
    named = c.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("a"))).alias("entities"))  # words stay in their question's row
    return c.join(named, "qid").select("qid", "a", "h", F.explode("entities").alias("entity")).select("qid", "entity", Q.candidate_features(F.col("a"), F.col("h"), F.col("entity")).alias("f")).select("qid", "entity", "f.*")


def _accuracy(s, d):
    return rnd(Q.qa_accuracy(Q.pick_answer(scores(s, d)), judged(s, d).filter("right").select("qid", "entity")))


QUERIES = {
    "Q01_word_proximity": (scores, _PROX + " SELECT qid, entity, round(score, 6) AS score FROM sc"),
    "Q02_embed_proximity": (
        _embed,
        f"""WITH {_C}, mk AS (SELECT cx.*, en.entity IS NOT NULL AS e FROM cx LEFT JOIN en ON en.qid = cx.qid AND entity = token AND length(token) > 5), nb AS (SELECT *, last_value(CASE WHEN e THEN place END IGNORE NULLS) OVER (PARTITION BY qid ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value(CASE WHEN e THEN place END IGNORE NULLS) OVER (PARTITION BY qid ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM mk),
vt AS (SELECT nb.qid, nb.place, p, n, CASE WHEN nb.token = o.token THEN 1.0 ELSE 0.5 END::DOUBLE AS sim FROM nb JOIN (SELECT DISTINCT qid, token FROM qu) o ON o.qid = nb.qid AND left(o.token, 2) = left(nb.token, 2) WHERE NOT e),
u AS (SELECT qid, place, p AS spot, sim FROM vt WHERE p IS NOT NULL UNION ALL SELECT qid, place, n, sim FROM vt WHERE n IS NOT NULL) SELECT u.qid, token AS entity, round(sum(sim / (1 + abs(spot - u.place))), 6) AS score FROM u JOIN cx ON cx.qid = u.qid AND cx.place = spot GROUP BY 1, 2""",
    ),
    "Q02_embed_proximity_near_words": (_near, None),
    "Q03_bow_overlap": (
        _bow,
        f"WITH {_C}, ct AS (SELECT token, count(*) AS n FROM cx GROUP BY 1), st AS (SELECT *, place // 8 AS sentence FROM cx), sh AS (SELECT DISTINCT st.qid, sentence, token FROM st JOIN qu USING (qid, token)), ss AS (SELECT qid, sentence, sum((SELECT sum(n) FROM ct) / n::DOUBLE) AS s FROM sh JOIN ct USING (token) GROUP BY 1, 2), he AS (SELECT st.qid, sentence, arg_min(token, place) AS entity FROM st JOIN en ON en.qid = st.qid AND entity = token GROUP BY 1, 2) SELECT qid, entity FROM ss JOIN he USING (qid, sentence) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, sentence) = 1",
    ),
    "Q04_candidate_features": (
        _features,
        f"WITH {_C} SELECT en.qid, entity, list_contains(a, entity) AS \"exists\", list_contains(list_transform(q, lambda t, i: CASE WHEN i = 2 THEN '@placeholder' ELSE t END), entity) AS in_question, len(list_filter(a, lambda t: t = entity))::INT AS frequency, (list_position(a, entity) - 1)::INT AS first, (len(list_filter(range(1, len(a) + 1), lambda i: a[i] = entity AND i > 1 AND a[i - 1] = q[1])) > 0)::INT AS left, (len(list_filter(range(1, len(a) + 1), lambda i: a[i] = entity AND i < len(a) AND a[i + 1] = q[3])) > 0)::INT AS right FROM en JOIN cv USING (qid)",
    ),
    "Q05_pick_answer": (lambda s, d: Q.pick_answer(scores(s, d)), _JD + " SELECT qid, entity FROM jd QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, entity) = 1"),
    "Q05_pick_answer_compat": (lambda s, d: Q.pick_answer(judged(s, d), compat=True), _JD + " SELECT qid, entity FROM jd QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, ok DESC, entity) = 1"),
    "Q06_answer_rank": (lambda s, d: Q.answer_rank(judged(s, d)), _JD + ", k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, entity)::INT AS rank FROM jd) SELECT rank, count(*) AS n FROM k WHERE ok GROUP BY 1"),
    "Q07_qa_accuracy": (_accuracy, _JD + ", k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, entity) = 1 AS best FROM jd) SELECT round(avg(best::INT), 6) AS accuracy FROM k WHERE ok"),
}
