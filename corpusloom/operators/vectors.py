"""Word vectors in long form ``(word, dim, w)``: composition and rule weights."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corpusloom.operators.loops import cut, written


def restrict(vectors: DataFrame, words: DataFrame) -> DataFrame:
    """Vectors of ``words(word)``, or of their lower-cased forms."""
    wanted = words.select(F.explode(F.array("word", F.lower("word"))).alias("word")).distinct()
    return vectors.join(wanted, "word", "left_semi")


def unit(vectors: DataFrame) -> DataFrame:
    """Vectors over their lengths; zero vectors stay."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("word")))
    return vectors.withColumn("w", F.coalesce(F.col("w") / F.nullif(norm, F.lit(0.0)), F.col("w")))


def lookup_or_zero(words: DataFrame, dense: DataFrame, size: int) -> DataFrame:
    """``words(word)`` with ``vec`` of ``dense(word, vec)``; a zero vector if missing."""
    return words.join(dense, "word", "left").withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0), size)))


def compose_add(texts: DataFrame, vectors: DataFrame, distinct: bool = True) -> DataFrame:
    """(id, dim, w): the sum of the vectors of ``texts(id, word)``, each different word once unless said otherwise.

    An id without any vector has no rows, which is the zero vector.
    """
    rows = texts.select("id", "word")
    return (rows.distinct() if distinct else rows).join(vectors, "word").groupBy("id", "dim").agg(F.sum("w").alias("w"))


def compose_mul(texts: DataFrame, vectors: DataFrame, distinct: bool = True) -> DataFrame:
    """(id, dim, w): the product over the words that have a vector; dims that one of them lacks are 0 and left out."""
    rows = texts.select("id", "word")
    rows = (rows.distinct() if distinct else rows).join(vectors.select("word").distinct(), "word", "left_semi")
    sizes = rows.groupBy("id").agg(F.count("*").alias("n"))
    return rows.join(vectors, "word").groupBy("id", "dim").agg(F.product("w").alias("w"), F.count("*").alias("k")).join(sizes, "id").filter("k = n").select("id", "dim", "w")


def compose_max(texts: DataFrame, vectors: DataFrame) -> DataFrame:
    return texts.select("id", "word").join(vectors, "word").groupBy("id", "dim").agg(F.max("w").alias("w"))


def compose_ngrams(grams: DataFrame, vectors: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(id, dim, w) of ``grams(id, n, word)``: v = alpha * sum of n-gram vectors + (1 - alpha) * v for growing n.

    In closed form the n-grams weigh alpha (1 - alpha)^(N - n), and the words (1 - alpha)^(N - 1).
    """
    last = F.max("n").over(W.partitionBy("id"))
    share = F.when(F.col("n") == 1, F.pow(F.lit(1 - alpha), F.col("last") - 1)).otherwise(alpha * F.pow(F.lit(1 - alpha), F.col("last") - F.col("n")))
    return grams.withColumn("last", last).withColumn("share", share).join(vectors, "word").groupBy("id", "dim").agg(F.sum(F.col("share") * F.col("w")).alias("w"))


def pair_cosine(left: DataFrame, right: DataFrame, ids: DataFrame, empty_both: float = 0.0) -> DataFrame:
    """(id, score): cosine of two composed vectors; 0 if one is missing, ``empty_both`` if both are."""
    dot = left.join(right.withColumnRenamed("w", "v"), ["id", "dim"]).groupBy("id").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    norm = lambda df, name: df.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(name))
    rows = ids.select("id").distinct().join(dot, "id", "left").join(norm(left, "a"), "id", "left").join(norm(right, "b"), "id", "left")
    both = F.col("a").isNull() & F.col("b").isNull()
    return rows.select("id", F.when(both, empty_both).otherwise(F.coalesce(F.col("dot") / F.nullif(F.col("a") * F.col("b"), F.lit(0.0)), F.lit(0.0))).alias("score"))


def weight_rules(rules: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, score): cosine of the summed words of ``rules(id, side, word)``'s sides lhs and rhs."""
    side = lambda s: compose_add(rules.filter(F.col("side") == s), vectors)
    return pair_cosine(side("lhs"), side("rhs"), rules)


def weight_by_word_and_context(rules: DataFrame, context: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, score): mean of the rule's weight and of the cosine of its context ``(id, word)`` with its right side."""
    by_words = weight_rules(rules, vectors)
    by_context = pair_cosine(compose_add(context, vectors), compose_add(rules.filter("side = 'rhs'"), vectors), rules).withColumnRenamed("score", "context_score")
    return by_words.join(by_context, "id").select("id", ((F.col("score") + F.col("context_score")) / 2).alias("score"))


def weight_all_word_pairs(rules: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, score): mean cosine over all pairs of a left and a right word; a missing vector gives 0.

    The mean over the cross product is the dot product of the sides' mean unit vectors.
    """
    units = unit(vectors)

    def mean(s: str) -> DataFrame:
        rows = rules.filter(F.col("side") == s).select("id", "word")
        sizes = rows.groupBy("id").agg(F.count("*").alias("n"))
        return rows.join(units, "word").groupBy("id", "dim").agg(F.sum("w").alias("w")).join(sizes, "id").select("id", "dim", (F.col("w") / F.col("n")).alias("w"))

    dot = mean("lhs").join(mean("rhs").withColumnRenamed("w", "v"), ["id", "dim"]).groupBy("id").agg(F.sum(F.col("w") * F.col("v")).alias("score"))
    return rules.select("id").distinct().join(dot, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def same_lemma_hard(rules: DataFrame) -> DataFrame:
    """Rules with equal sides weigh infinity."""
    return rules.withColumn("weight", F.when(F.col("lhs") == F.col("rhs"), float("inf")).otherwise(F.col("weight")))


def weight_by_rank(rules: DataFrame) -> DataFrame:
    """One over the competition rank by falling score within a left side, normalised to sum 1."""
    inverse = 1 / F.rank().over(W.partitionBy("lhs").orderBy(F.desc("score")))
    return rules.withColumn("inverse", inverse).withColumn("weight", F.col("inverse") / F.sum("inverse").over(W.partitionBy("lhs"))).drop("inverse")


def top_rule(rules: DataFrame) -> DataFrame:
    """The best rule of each left side, of equals the first right side."""
    return rules.withColumn("place", F.row_number().over(W.partitionBy("lhs").orderBy(F.desc("score"), "rhs"))).filter("place = 1").drop("place")


def uniform_hard(rules: DataFrame) -> DataFrame:
    return rules.withColumn("weight", F.lit(None).cast("double"))


def token_difference(pairs: DataFrame) -> DataFrame:
    """(id, side, word, n): tokens of ``pairs(id, side, word)`` that the other side has fewer of."""
    counts = pairs.groupBy("id", "word").agg(F.count_if(F.col("side") == "left").alias("l"), F.count_if(F.col("side") == "right").alias("r"))
    return counts.filter("l <> r").select("id", F.when(F.col("l") > F.col("r"), "left").otherwise("right").alias("side"), "word", F.abs(F.col("l") - F.col("r")).alias("n"))


def common_places(left: list, right: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in order.

    Bit-parallel: a bit for each place of the right side is 0 where the length of the best common subsequence with the
    left side so far grows, and an integer's carry moves all of a row at once (Hyyro 2004). Going back from both
    ends, a left token without its own growth is skipped first.
    """
    a, b = (0, 0), (len(left), len(right))
    while a[0] < b[0] and a[1] < b[1] and left[a[0]] == right[a[1]]:
        a = a[0] + 1, a[1] + 1
    while a[0] < b[0] and a[1] < b[1] and left[b[0] - 1] == right[b[1] - 1]:
        b = b[0] - 1, b[1] - 1
    middle, width = right[a[1] : b[1]], b[1] - a[1]
    places: dict = {}
    for j, token in enumerate(middle):
        places[token] = places.get(token, 0) | 1 << j
    full = (1 << width) - 1
    row, rows = full, [full]
    for token in left[a[0] : b[0]]:
        hit = row & places.get(token, 0)
        row = (row + hit | row - hit) & full
        rows.append(row)
    i, j, found = b[0] - a[0], width, []
    while i and j:
        if not rows[i] >> j - 1 & 1 and rows[i - 1] >> j - 1 & 1:  # grows here, and didn't a row before: a match
            i, j = i - 1, j - 1
            found.append((a[0] + i, a[1] + j))
        elif rows[i] >> j - 1 & 1:
            j -= 1
        else:
            i -= 1
    return [(k, k) for k in range(a[0])] + found[::-1] + [(b[0] + k, b[1] + k) for k in range(len(left) - b[0])]


def difference_pieces(pairs: DataFrame) -> DataFrame:
    """(id, left, right): what stands between the tokens of a longest common subsequence of ``pairs(id, left, right)``, in order.

    A piece with tokens on one side only is an insertion or a deletion. A null array is empty; equal ones have no piece.
    Ordered alignment of one pair needs its tokens together: a pair is a row.
    """

    @F.arrow_udf("array<struct<left: array<string>, right: array<string>>>")
    def pieces(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True):
            a, b = a or [], b or []
            own, i, j = [], 0, 0
            for x, y in [*common_places(a, b), (len(a), len(b))]:
                if i < x or j < y:
                    own.append({"left": a[i:x], "right": b[j:y]})
                i, j = x + 1, y + 1
            out.append(own)
        words = pa.list_(pa.string())
        return pa.array(out, pa.list_(pa.struct([("left", words), ("right", words)])))

    return pairs.select("id", F.explode(pieces("left", "right")).alias("p")).select("id", "p.left", "p.right")


#: near_words: words a bucket holds on average, the share of near pairs that meet in one, and words of a part of a large bucket.
BUCKET, RECALL, PART = 256, 0.97, 8192


def hyperplane_buckets(vectors: DataFrame, least: float, words: int, seed: int = 0) -> tuple[DataFrame, int, int]:
    """(word, v, sketch, band, bucket) of ``vectors(word, dim, w)``, the bits of a bucket, and the number of bands.

    A bit tells on which side of a random hyperplane a vector lies, whose coefficient for a dim is 1 or -1 by a hash. Two
    vectors with cosine ``least`` agree in a bit with probability 1 - angle / pi. A bucket has as many bits as spread
    ``words`` over buckets of BUCKET, and there are as many bands as let RECALL of such pairs share one. ``v`` is the vector.
    """
    bits = max(1, math.ceil(math.log2(max(2.0, words / BUCKET))))
    agree = (1 - math.acos(min(1.0, least)) / math.pi) ** bits
    bands = max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - agree))) if agree < 1 else 1
    whole = vectors.groupBy("word").agg(F.collect_list(F.struct("dim", F.col("w").cast("double").alias("w"))).alias("v"))
    side = lambda band, bit: F.aggregate("v", F.lit(0.0), lambda s, x: s + F.when(F.pmod(F.xxhash64(F.lit(seed), x["dim"], band, bit), F.lit(2)) == 0, x["w"]).otherwise(-x["w"])) > 0
    bucket = lambda band, n: F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0).cast("long"), lambda s, bit: F.shiftleft(s, 1).bitwiseOR(side(band, bit).cast("long")))
    sketched = written(whole.select("word", "v", bucket(F.lit(-1), 64).alias("sketch"), F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda band: bucket(band, bits)).alias("buckets")))
    return sketched.select("word", "v", "sketch", F.posexplode("buckets").alias("band", "bucket")), bits, bands


def _near_in_parts(least: float, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (band, bucket, i, j, part, word, sketch, dims, ws) sorted by the first four, near pairs of each such group.

    Where i and j differ, rows of part i meet those of part j. Vectors have length 1.
    """

    def met(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        column = lambda c: group.column(c).combine_chunks()
        sketch, part = column("sketch").to_numpy().view(np.uint64), column("part").to_numpy()
        dims, ws = column("dims"), column("ws").flatten().to_numpy()
        codes = dims.flatten().dictionary_encode()
        code, width = codes.indices.to_numpy(), max(1, len(codes.dictionary))
        size = np.diff(dims.offsets.to_numpy())
        start = np.append(0, np.cumsum(size))
        n, step = len(part), max(1, 4_000_000 // max(width, len(part)))
        found: list[tuple] = []
        for low in range(0, n, step):
            high = min(n, low + step)
            here, late = sketch[low:high, None], np.arange(low, n)
            alike = np.bitwise_count(here ^ sketch[None, low:]) <= most
            alike &= np.arange(low, high)[:, None] < late
            if group.column("i")[0] != group.column("j")[0]:
                alike &= part[low:high, None] != part[None, low:]
            a, b = np.nonzero(alike)
            b += low
            dense = np.zeros((high - low, width))
            dense[np.repeat(np.arange(high - low), size[low:high]), code[start[low] : start[high]]] = ws[start[low] : start[high]]
            for cut_ in range(0, len(a), 200_000):
                x, y = a[cut_ : cut_ + 200_000], b[cut_ : cut_ + 200_000]
                ends = np.cumsum(size[y])
                at = np.repeat(start[y] - np.append(0, ends[:-1]), size[y]) + np.arange(ends[-1])
                sim = np.add.reduceat(dense[np.repeat(x, size[y]), code[at]] * ws[at], np.append(0, ends[:-1]))
                near = sim >= least - 1e-12
                found.append((x[near] + low, y[near], sim[near]))
        first, second, sims = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        word = column("word")
        return pa.table([word.take(pa.array(first)), word.take(pa.array(second)), pa.array(sims.astype(float))], ["word", "other", "sim"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_tables([*held, pa.Table.from_batches([batch])])
            keys = [rows.column(c).to_numpy() for c in ("band", "bucket", "i", "j")]
            starts = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))
            for low, high in zip(starts[:-1], starts[1:], strict=True):
                yield from met(rows.slice(low, high - low)).to_batches()
            held = [rows.slice(starts[-1])]
        if held:
            yield from met(held[0]).to_batches()

    return pairs


def near_words(vectors: DataFrame, least: float = 0.8, seed: int = 0) -> DataFrame:
    """(word, other, sim): pairs of different words whose vectors ``(word, dim, w)`` have a cosine of ``least`` or more.

    Words meet in buckets of random hyperplanes; a pair whose sketches of 64 more differ in more bits than 2.5 standard
    deviations over what ``least`` lets expect is left out, all others are compared exactly. RECALL is about how many of the
    pairs at ``least`` are found, and nearer ones are found more often. Words take their vectors with them, so that pairs are compared
    where they meet and only near ones are written. Of a bucket with many words parts meet, so that no task compares more
    than two parts. Words without a vector are near none.
    """
    rows = written(vectors.filter("w <> 0").groupBy("word", "dim").agg(F.sum("w").alias("w")))
    words = rows.select("word").distinct().count()
    keyed, _, _ = hyperplane_buckets(rows, least, words, seed)
    # One row for over PART of the others.
    large = keyed.groupBy("band", "bucket").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).filter("parts > 1")
    parted = keyed.join(F.broadcast(large), ["band", "bucket"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    parted = parted.select("band", "bucket", "word", "sketch", F.col("v.dim").alias("dims"), "v", length.alias("length"), F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"), "parts")
    dealt_ = parted.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt_ = dealt_.select("band", "bucket", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part", "word", "sketch", "dims", F.transform("v", lambda x: x["w"] / F.col("length")).alias("ws"))
    turn = math.acos(min(1.0, least)) / math.pi
    most = math.ceil(64 * turn + 2.5 * math.sqrt(64 * turn * (1 - turn)))
    grouped = dealt_.repartition("band", "bucket", "i", "j").sortWithinPartitions("band", "bucket", "i", "j")
    kind = vectors.schema["word"].dataType
    met = grouped.mapInArrow(_near_in_parts(least, most), StructType([StructField("word", kind), StructField("other", kind), StructField("sim", DoubleType())]))
    near = met.select(F.least("word", "other").alias("word"), F.greatest("word", "other").alias("other"), "sim").groupBy("word", "other").agg(F.max("sim").alias("sim"))
    return near.select(F.explode(F.array(F.struct("word", "other", "sim"), F.struct(F.col("other").alias("word"), F.col("word").alias("other"), "sim"))).alias("p")).select("p.*")


def difference_cosine(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, score): cosine of the composed differing tokens of both sides; two empty differences give 1."""
    diff = token_difference(pairs)
    repeated = diff.select("id", "side", F.explode(F.array_repeat("word", F.col("n").cast("int"))).alias("word"))
    side = lambda s: compose_add(repeated.filter(F.col("side") == s), vectors, distinct=False)
    return pair_cosine(side("left"), side("right"), pairs, empty_both=1.0)


#: Function words whose counts tell sentence pairs apart.
KEYWORDS = "no not all some none nobody and or if a the every each any".split()


def keyword_counts(pairs: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """A column for each keyword: its count in both token arrays of ``pairs(id, left, right)``."""
    count = lambda k: F.size(F.filter(F.concat("left", "right"), lambda t: t == k)).alias(f"n_{k}")
    return pairs.select("id", *map(count, keywords or KEYWORDS))


def context_idf_match(left: DataFrame, right: DataFrame, idf: DataFrame, similar: DataFrame | None = None, diff_only: bool = False, same: float = 12.0) -> DataFrame:
    """(id, score) of ``left(id, word)`` and ``right(id, word)``: each word's best match, weighted by idf, averaged both ways.

    Equal words match with ``same``, others by ``similar(word, other, sim)``; ``diff_only`` leaves
    words out that both sides have.
    """

    def one_way(a: DataFrame, b: DataFrame) -> DataFrame:
        a = a.select("id", "word").distinct()
        b = b.select("id", F.col("word").alias("other")).distinct()
        exact = a.join(b, (a["id"] == b["id"]) & (a["word"] == b["other"])).select(a["id"], "word", F.lit(same).alias("sim"))
        rows = exact
        if similar is not None:
            near = a.join(similar, "word").join(b, ["id", "other"]).filter("word <> other").select("id", "word", "sim")
            rows = near.unionByName(exact)
        best = rows.groupBy("id", "word").agg(F.max("sim").alias("sim"))
        base = a.join(exact.select("id", "word"), ["id", "word"], "left_anti") if diff_only else a
        scored = base.join(best, ["id", "word"], "left").join(idf.select("token", "idf"), F.col("word") == F.col("token"), "left")
        weight = F.coalesce("idf", F.lit(0.0))
        return scored.groupBy("id").agg((F.sum(F.coalesce("sim", F.lit(0.0)) * weight) / F.nullif(F.sum(weight), F.lit(0.0))).alias("s"))

    both = one_way(left, right).unionByName(one_way(right, left))
    return both.groupBy("id").agg(F.coalesce(F.sum("s") / 2, F.lit(0.0)).alias("score"))
