"""Distributional thesaurus: association weights, similarity measures, neighbours.

A relation table is ``(obj, attr, type, f)``: objects with attributes of a type and a count.
Weights are expressions over the counts and their totals; measures join objects on shared
attributes. What a measure needs of attributes that only one object has follows from the
objects' totals, so no outer join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def relation_counts(rows: DataFrame) -> DataFrame:
    """Counts of each (obj, attr, type) with the totals that the weights use.

    fo, no: total and number of different attributes of the object; fa, na of the attribute;
    fot, fat of the object and of the attribute with the type; ft of the type; ftotal, nobj overall.
    """
    f = rows.groupBy("obj", "attr", "type").agg(F.sum("f").alias("f"))
    total = f.agg(F.sum("f").alias("ftotal"), F.countDistinct("obj").alias("nobj"), F.countDistinct("attr").alias("nattr"))
    by = lambda keys, s, n: f.groupBy(*keys).agg(F.sum("f").alias(s), F.count("*").alias(n))
    return (
        f.join(by(["obj"], "fo", "no"), "obj")
        .join(by(["attr", "type"], "fa", "na"), ["attr", "type"])
        .join(by(["obj", "type"], "fot", "not_"), ["obj", "type"])
        .join(by(["type"], "ft", "nt"), "type")
        .crossJoin(F.broadcast(total))  # one row
    )


def relations_from_tuples(tuples: DataFrame, nouns: tuple[str, ...] = ("NN", "NNS"), skipped_words: tuple[str, ...] = ("be",), skipped_relations: tuple[str, ...] = (), inverse: str = "^-1") -> DataFrame:
    """(obj, attr, type, f) from ``tuples(w1, t1, rel, w2, t2)``: the relation as it is if word 1 is a noun, inverted if word 2 is."""
    kept = tuples.filter(~F.col("w1").isin(*skipped_words) & ~F.col("w2").isin(*skipped_words) & F.col("w1").rlike("\\p{L}") & F.col("w2").rlike("\\p{L}"))
    kept = kept.filter(~F.col("rel").isin(*skipped_relations)) if skipped_relations else kept
    forward = kept.filter(F.col("t1").isin(*nouns)).select(F.col("w1").alias("obj"), F.concat_ws(":", "rel", "w2").alias("attr"), F.col("rel").alias("type"))
    backward = kept.filter(F.col("t2").isin(*nouns)).select(F.col("w2").alias("obj"), F.concat_ws(":", F.concat("rel", F.lit(inverse)), "w1").alias("attr"), F.concat("rel", F.lit(inverse)).alias("type"))
    return forward.unionByName(backward).groupBy("obj", "attr", "type").agg(F.count("*").alias("f"))


def cutoff_objects(relations: DataFrame, least: int = 5) -> DataFrame:
    """Relations of objects with a total of at least ``least``."""
    big = relations.groupBy("obj").agg(F.sum("f").alias("n")).filter(F.col("n") >= least).select("obj")
    return relations.join(big, "obj", "left_semi")


def cutoff_report(relations: DataFrame, least: int = 5) -> DataFrame:
    """How many objects and relations the cutoff drops."""
    by = relations.groupBy("obj").agg(F.sum("f").alias("n"), F.count("*").alias("k"))
    return by.agg(F.count_if(F.col("n") < least).alias("dropped_objects"), F.coalesce(F.sum(F.when(F.col("n") < least, F.col("k"))), F.lit(0)).alias("dropped_relations"))


def optimise(weighted: DataFrame) -> DataFrame:
    """Relations with a positive weight, of objects whose norm isn't 0."""
    return weighted.filter("w > 0")


def _log2(x: Column) -> Column:
    return F.log(2.0, x)


def _association() -> dict[str, Column]:
    f, fo, fa, n = (F.col(c).cast("double") for c in ("f", "fo", "fa", "ftotal"))
    fot, ft, na, nobj = (F.col(c).cast("double") for c in ("fot", "ft", "na", "nobj"))
    p, po, pa = f / n, fo / n, fa / n
    mi = _log2(p / (po * pa))
    ttest = (p - po * pa) / F.sqrt(po * pa)
    log = _log2(f + 1)
    a, b, c = f, fo - f, fa - f
    d = n - fo - fa + f
    term = lambda k, row, column: F.when(k > 0, k * F.ln(k * n / (row * column))).otherwise(0.0)
    return {
        "identity": F.lit(1.0),
        "zero": F.lit(0.0),
        "freq": f,
        "relfreq": f / fo,
        "chi2": F.when((fo < n) & (fa < n), n * F.pow(a * d - b * c, F.lit(2.0)) / (fo * fa * (n - fo) * (n - fa))).otherwise(0.0),
        "lr": 2 * (term(a, fo, fa) + term(b, fo, n - fa) + term(c, n - fo, fa) + term(d, n - fo, n - fa)),
        "lin98b": F.greatest(F.lit(0.0), F.ln(f * ft / (fa * fot))),
        "lin98c": F.greatest(F.lit(0.0), -F.ln(na / nobj)),
        "dice": 2 * f / (fo + fa),
        "dicelog": 2 * f / (fo + fa) * log,
        "grefenstette": log / _log2(na + 1),
        "mi": mi,
        "milog": mi * log,
        "micut": F.greatest(F.lit(0.0), mi),
        "micutlog": F.greatest(F.lit(0.0), mi * log),
        "ttest": ttest,
        "ttestlog": ttest * log,
        "ttestcut": F.greatest(F.lit(0.0), ttest),
        "ttestcutlog": F.greatest(F.lit(0.0), ttest * log),
        "tfidf": f / na,
        "tfidf2": log / _log2(1 + F.col("nattr") / na),
    }


WEIGHTS = tuple(k for k in ("identity zero freq relfreq chi2 lr lin98b lin98c dice dicelog grefenstette mi milog micut micutlog ttest ttestlog ttestcut ttestcutlog tfidf tfidf2".split()))


def association(weight: str) -> Column:
    """A weight as an expression over the columns of relation_counts."""
    return _association()[weight]


def weigh(counts: DataFrame, weight: str = "ttestcut") -> DataFrame:
    """``counts`` (of relation_counts) with the weight ``w``."""
    return counts.withColumn("w", association(weight))


def relweight(weighted: DataFrame) -> DataFrame:
    """Each weight over its object's total weight."""
    return weighted.withColumn("w", F.coalesce(F.col("w") / F.nullif(F.sum("w").over(W.partitionBy("obj")), F.lit(0.0)), F.lit(0.0)))


def object_norms(weighted: DataFrame) -> DataFrame:
    """obj, norm (L2), total, n of the weights."""
    return weighted.groupBy("obj").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("w").alias("total"), F.count("*").alias("n"))


def _entropy(x: Column) -> Column:
    return F.when(x > 0, x * _log2(x)).otherwise(0.0)


def pair_sums(weighted: DataFrame, left: DataFrame | None = None, blocking: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """For each ordered pair of objects with a shared attribute the sums that the measures use.

    ``left(obj)`` restricts the first objects; ``blocking(obj, attr)`` lets only pairs through
    that share one of its attributes (see canonical_attributes), ``allowed(obj1, obj2)`` only its own.
    """
    norms = object_norms(weighted)
    rows = weighted.select("obj", "attr", "w").join(norms, "obj")
    a = rows if left is None else rows.join(left.select("obj"), "obj", "left_semi")
    a = a.select(*(F.col(c).alias(f"{c}1") if c != "attr" else F.col(c) for c in rows.columns))
    b = rows.select(*(F.col(c).alias(f"{c}2") if c != "attr" else F.col(c) for c in rows.columns))
    if allowed is not None:
        pairs = allowed.select("obj1", "obj2").join(a, "obj1").join(b, ["obj2", "attr"])
    elif blocking is None:
        pairs = a.join(b, "attr").filter("obj1 <> obj2")
    else:  # the allowed pairs first, so that a common attribute outside the blocking makes none
        keys = blocking.select("obj", "attr").distinct()
        firsts = keys if left is None else keys.join(left.select("obj"), "obj", "left_semi")
        allowed = firsts.select(F.col("obj").alias("obj1"), "attr").join(keys.select(F.col("obj").alias("obj2"), "attr"), "attr").filter("obj1 <> obj2").select("obj1", "obj2").distinct()
        pairs = allowed.join(a, "obj1").join(b, ["obj2", "attr"])
    x, y = F.col("w1"), F.col("w2")
    p, q = x / F.col("total1"), y / F.col("total2")
    mixed = (p + q) / 2
    sums = {
        "dot": x * y,
        "least": F.least(x, y),
        "both": x + y,
        "gap": F.abs(x - y),
        "shared": F.lit(1),
        "js": _entropy(p) + _entropy(q) - 2 * _entropy(mixed),
        "p": p,
        "q": q,
        "skew": F.when(q > 0, q * _log2(q / (0.99 * p + 0.01 * q))).otherwise(0.0),
    }
    keep = [F.first(c).alias(c) for c in ("norm1", "total1", "n1", "norm2", "total2", "n2")]
    return pairs.groupBy("obj1", "obj2").agg(*(F.sum(e).alias(k) for k, e in sums.items()), *keep)


def measures(compat: bool = False) -> dict[str, Column]:
    """Measures over the columns of pair_sums; pairs without a shared attribute have none.

    ``compat`` gives bincosine as num / (num + denom) and jaccard2 with unsquared norms.
    """
    c = F.col
    sq1, sq2 = c("norm1") * c("norm1"), c("norm2") * c("norm2")
    s = c("total1") + c("total2")
    n = c("n1") + c("n2")
    bin_den = F.sqrt(c("n1") * c("n2"))
    return {
        "cosine": c("dot") / F.nullif(c("norm1") * c("norm2"), F.lit(0.0)),
        "bincosine": c("shared") / (c("shared") + bin_den) if compat else c("shared") / bin_den,
        "dice": 2 * c("dot") / F.nullif(s, F.lit(0.0)),
        "dice2": 2 * c("least") / F.nullif(s, F.lit(0.0)),
        "bindice": 2 * c("shared") / n,
        "jaccard": c("least") / F.nullif(s - c("least"), F.lit(0.0)),
        "jaccard2": c("dot") / F.nullif((c("norm1") + c("norm2") if compat else sq1 + sq2) - c("dot"), F.lit(0.0)),
        "binjaccard": c("shared") / (n - c("shared")),
        "lin": c("both") / F.nullif(s, F.lit(0.0)),
        "lin2": 2 * c("least") / F.nullif(s, F.lit(0.0)),
        "manhattan": -(c("gap") + s - c("both")),
        "euclidean": -F.sqrt(F.greatest(F.lit(0.0), sq1 + sq2 - 2 * c("dot"))),
        "js": -(c("js") / 2 + (1 - c("p")) / 2 + (1 - c("q")) / 2),
        "skew": -(c("skew") + (1 - c("q")) * _log2(F.lit(100.0))),
    }


def pearson(weighted: DataFrame, dimensions: int | None = None) -> DataFrame:
    """Pearson correlation of two objects' weights over all attributes: (obj1, obj2, score)."""
    n = F.lit(float(dimensions)) if dimensions else F.col("dims")
    sums = pair_sums(weighted)
    dims = weighted.agg(F.countDistinct("attr").cast("double").alias("dims"))
    c = F.col
    top = n * c("dot") - c("total1") * c("total2")
    low = F.sqrt(n * c("norm1") * c("norm1") - c("total1") * c("total1")) * F.sqrt(n * c("norm2") * c("norm2") - c("total2") * c("total2"))
    return sums.crossJoin(F.broadcast(dims)).select("obj1", "obj2", (top / F.nullif(low, F.lit(0.0))).alias("score"))


def similarity(weighted: DataFrame, measure: str = "jaccard", left: DataFrame | None = None, blocking: DataFrame | None = None, compat: bool = False) -> DataFrame:
    return pair_sums(weighted, left, blocking).select("obj1", "obj2", measures(compat)[measure].alias("score"))


def neighbours(scores: DataFrame, k: int = 10, excluded: DataFrame | None = None) -> DataFrame:
    """The k best nonzero neighbours of each object by score, then name; ``excluded(obj)`` are none."""
    rows = scores.filter("score <> 0")
    if excluded is not None:
        rows = rows.join(excluded.select(F.col("obj").alias("obj2")), "obj2", "left_anti")
    place = F.row_number().over(W.partitionBy("obj1").orderBy(F.desc("score"), "obj2"))
    return rows.withColumn("place", place).filter(F.col("place") <= k).select("obj1", "obj2", "score", "place")


def best_neighbour(scores: DataFrame) -> DataFrame:
    """The best neighbour with a score above 0."""
    return neighbours(scores.filter("score > 0"), 1).drop("place")


def neighbour_rank(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Competition rank of ``pairs(obj1, obj2)`` among the first object's neighbours; 0 if absent."""
    ranked = scores.filter("score <> 0").withColumn("rank", F.rank().over(W.partitionBy("obj1").orderBy(F.desc("score"))))
    return pairs.join(ranked.select("obj1", "obj2", "rank"), ["obj1", "obj2"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))


def canonical_attributes(weighted: DataFrame, size: int = 100, least: int = 5, most_objects: int = 10_000, types: tuple[str, ...] | None = None) -> DataFrame:
    """The strongest attributes of each object, of those that aren't too rare or too common."""
    rows = weighted.filter((F.col("f") >= least) & (F.col("na") <= most_objects))
    rows = rows.filter(F.col("type").isin(*types)) if types else rows
    place = F.row_number().over(W.partitionBy("obj").orderBy(F.desc("w"), "attr"))
    return rows.withColumn("place", place).filter(F.col("place") <= size).select("obj", "attr", "w", "place")


def explain_pair(weighted: DataFrame, a, b) -> DataFrame:
    """Attributes that objects a and b share with both weights."""
    side = lambda o, name: weighted.filter(F.col("obj") == o).select("attr", F.col("w").alias(name))
    return side(a, "w1").join(side(b, "w2"), "attr")


def top_relations(weighted: DataFrame, k: int = 10, over: int = 2) -> DataFrame:
    """The k strongest relations of each object with a count above ``over``."""
    place = F.row_number().over(W.partitionBy("obj").orderBy(F.desc("w"), "attr"))
    return weighted.filter(F.col("f") > over).withColumn("place", place).filter(F.col("place") <= k).select("obj", "attr", "w", "place")


def describe(relations: DataFrame, key: str) -> DataFrame:
    """freq, nrelations, maxrelation by obj, attr or type."""
    return relations.groupBy(key).agg(F.sum("f").alias("freq"), F.count("*").alias("nrelations"), F.max("f").alias("maxrelation"))


def object_scale(relations: DataFrame, c: float, name=None) -> DataFrame:
    out = relations.withColumn("f", F.col("f") * c)
    return out if name is None else out.withColumn("obj", F.lit(name))


def object_sum(a: DataFrame, b: DataFrame, name, c1: float = 1.0, c2: float = 1.0) -> DataFrame:
    """One object with the attributes of both, counts scaled and summed."""
    return object_scale(a, c1, name).unionByName(object_scale(b, c2, name)).groupBy("obj", "attr", "type").agg(F.sum("f").alias("f"))


def object_diff(a: DataFrame, b: DataFrame, name, c1: float = 1.0, c2: float = 1.0) -> DataFrame:
    """c1 f1 - c2 f2 where above 0; attributes of b alone drop out."""
    other = b.groupBy("attr", "type").agg(F.sum("f").alias("g"))
    left = a.groupBy("attr", "type").agg(F.sum("f").alias("f"))
    return left.join(other, ["attr", "type"], "left").select(F.lit(name).alias("obj"), "attr", "type", (F.col("f") * c1 - F.coalesce("g", F.lit(0)) * c2).alias("f")).filter("f > 0")


def object_intersect(a: DataFrame, b: DataFrame, name) -> DataFrame:
    other = b.groupBy("attr", "type").agg(F.sum("f").alias("g"))
    left = a.groupBy("attr", "type").agg(F.sum("f").alias("f"))
    return left.join(other, ["attr", "type"]).select(F.lit(name).alias("obj"), "attr", "type", (F.col("f") + F.col("g")).alias("f"))


def object_split(relations: DataFrame, obj, share: float, name) -> DataFrame:
    """A share of an object's counts goes to a new object."""
    mine = relations.filter(F.col("obj") == obj)
    return relations.filter(F.col("obj") != obj).unionByName(object_scale(mine, 1 - share)).unionByName(object_scale(mine, share, name))


def pseudo_object(relations: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows(obj, attr, type, f)`` joined to the table; an attribute the table doesn't know is an error."""
    known = relations.select("attr", "type").distinct().withColumn("known", F.lit(True))
    checked = rows.join(known, ["attr", "type"], "left").withColumn("f", F.when(F.col("known"), F.col("f")).otherwise(F.raise_error(F.concat(F.lit("unknown attribute "), F.col("attr"))).cast("double")))
    return relations.unionByName(checked.select(*relations.columns))
