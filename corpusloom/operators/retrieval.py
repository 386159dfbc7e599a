"""Rules for texts: by any shared token, and by phrases at their places.

Tokens are of two kinds. The few that make most pairs are common: each row keeps the set of its
common tokens as a bitmap, rows meet in blocks, and a pair counts at the first token that both
bitmaps have, so that it is made once and needs no comparison with other pairs. All other tokens are
looked up by an equi-join, less the pairs that the bitmaps have already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.loops import cut, dealt

#: A token is common if its rows would make more pairs; at most BITS tokens are, those of the most pairs.
COMMON_PAIRS, BITS = 10_000, 63
#: Rows of a token on one side that meet those of the other in one task.
PART = 4096


def _parts(count: Column) -> Column:
    return F.ceil(count / PART)


def common_tokens(queries: DataFrame, rules: DataFrame) -> list[tuple[str, int, int]]:
    """The common tokens with how many queries and rules have them, the most pairs first; BITS at most."""
    counts = queries.groupBy("token").agg(F.count("*").alias("nq")).join(rules.groupBy("token").agg(F.count("*").alias("nr")), "token")
    many = counts.withColumn("pairs", F.col("nq") * F.col("nr")).filter(F.col("pairs") > COMMON_PAIRS)
    return [(r.token, r.nq, r.nr) for r in many.orderBy(F.desc("pairs"), "token").limit(BITS).collect()]


def _masks(rows: DataFrame, key: str, bit: Column, name: str) -> DataFrame:
    """A bitmap of the common tokens of each row that has any."""
    return rows.select(key, bit.alias("bit")).filter("bit is not null").groupBy(key).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias(name))


def token_pairs(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """All (pair_id, rule_id) where ``queries(pair_id, token)`` and ``rules(rule_id, token)`` share a token, each once.

    A null token is in nothing. Repeated rows are as one.
    """
    q = cut(queries.select("pair_id", "token").dropna(subset=["token"]).distinct())
    r = cut(rules.select("rule_id", "token").dropna(subset=["token"]).distinct())
    common = common_tokens(q, r)
    if not common:
        return _rare_pairs(q, r).distinct()
    named = {t: i for i, (t, _, _) in enumerate(common)}
    bit = F.create_map(*(x for t, i in named.items() for x in (F.lit(t), F.lit(i))))[F.col("token")]
    mq, mr = cut(_masks(q, "pair_id", bit, "mq")), cut(_masks(r, "rule_id", bit, "mr"))
    sizes = F.create_map(*(x for i, (_, nq, nr) in enumerate(common) for x in (F.lit(i), F.struct(F.lit(nq).alias("nq"), F.lit(nr).alias("nr")))))[F.col("bit")]
    bits = lambda mask: F.explode(F.filter(F.array(*map(F.lit, range(len(common)))), lambda b: F.call_function("getbit", F.col(mask), b) == 1)).alias("bit")
    pq, pr = _parts(sizes["nq"]), _parts(sizes["nr"])
    left = dealt(mq.select("pair_id", "mq", bits("mq")), "pair_id", pq, pr, "i", "j")
    right = dealt(mr.select("rule_id", "mr", bits("mr")), "rule_id", pr, pq, "j", "i")
    first = F.expr("(mq & mr & (shiftleft(1L, bit) - 1)) = 0")
    shared = left.join(right, ["bit", "i", "j"]).filter(first).select("pair_id", "rule_id")
    rare = _rare_pairs(q.filter(bit.isNull()).join(mq, "pair_id", "left"), r.filter(bit.isNull()).join(mr, "rule_id", "left"), F.coalesce(F.expr("(mq & mr) = 0"), F.lit(True)))
    return shared.unionByName(rare.distinct())


def _rare_pairs(q: DataFrame, r: DataFrame, new: Column | None = None) -> DataFrame:
    """Pairs of rows with the same token, once for each; a token of many rows meets in pairs of parts."""
    counts = q.groupBy("token").agg(F.count("*").alias("nq")).join(r.groupBy("token").agg(F.count("*").alias("nr")), "token")
    pq, pr = _parts(F.col("nq")), _parts(F.col("nr"))
    left = dealt(q.join(counts, "token"), "pair_id", pq, pr, "i", "j").drop("nq", "nr")
    right = dealt(r.join(counts, "token"), "rule_id", pr, pq, "j", "i").drop("nq", "nr")
    met = left.join(right, ["token", "i", "j"])
    return (met if new is None else met.filter(new)).select("pair_id", "rule_id")


def _placed(rows: DataFrame, key: str, number: str, place: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``(key, tokens)`` under a number each, and their tokens at their places."""
    numbered = cut(rows.select(key, "tokens").filter("size(tokens) > 0")).withColumn(number, F.monotonically_increasing_id())
    return numbered.select(number, key), numbered.select(number, F.size("tokens").alias("size"), F.posexplode("tokens").alias(place, "token"))


def phrase_places(texts: DataFrame, phrases: DataFrame, not_after: str | None = None) -> DataFrame:
    """(pair_id, rule_id, place) where the phrase ``(rule_id, tokens)`` starts in ``texts(pair_id, tokens)``.

    A positional index: each phrase's rarest token meets the texts' tokens; place less offset is where the phrase would
    start. There the second rarest token must stand, then all others. Of ``not_after`` a phrase right after that word
    doesn't count. An id may have several texts or phrases; empty and null ones are nowhere.
    """
    names, words = _placed(texts, "pair_id", "line", "place")
    rules, wanted = _placed(phrases.select("rule_id", "tokens").distinct(), "rule_id", "phrase", "offset")
    words = words.select("line", "place", "token")
    seen = words.groupBy("token").agg(F.count("*").alias("seen"))
    known = wanted.join(seen, "token").groupBy("phrase", "size").agg(F.array_sort(F.collect_list(F.struct("seen", "offset", "token"))).alias("t")).filter(F.size("t") == F.col("size"))
    known = cut(known.select("phrase", "size", F.posexplode("t").alias("rank", "x")).select("phrase", "size", "rank", "x.offset", "x.token"))
    first = known.filter("rank = 0").join(words, "token").select("line", "phrase", "size", (F.col("place") - F.col("offset")).alias("start")).filter("start >= 0")

    def stand(found: DataFrame, tokens: DataFrame) -> DataFrame:
        """Of starts the tokens that stand where they must."""
        return found.join(tokens.select("phrase", "offset", "token"), "phrase").withColumn("place", F.col("start") + F.col("offset")).join(words, ["line", "place", "token"])

    second = cut(stand(first.filter("size > 1"), known.filter("rank = 1")).select("line", "phrase", "size", "start"))
    rest = stand(second.filter("size > 2"), known.filter("rank > 1")).groupBy("line", "phrase", "size", "start").agg(F.count("*").alias("n")).filter("n = size - 2")
    columns = ("line", "phrase", "start")
    found = first.filter("size = 1").select(*columns).unionByName(second.filter("size = 2").select(*columns)).unionByName(rest.select(*columns))
    if not_after is not None:
        after = words.filter(F.col("token") == not_after).select("line", (F.col("place") + 1).alias("start"))
        found = found.join(after, ["line", "start"], "left_anti")
    return found.join(names, "line").join(rules, "phrase").select("pair_id", "rule_id", F.col("start").alias("place"))
