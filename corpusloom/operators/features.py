"""Features and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import char_trigrams, word_ngrams
from corpusloom.operators.evaluate import fold_column


def bin_feature(value: Column, largest: float, bins: int = 10) -> Column:
    """A one-hot array of half-open bins up to ``largest`` and a flag for exactly that; all zero for 0, NaN and infinity."""
    fine = value.isNotNull() & ~F.isnan(value) & (value != 0) & (F.abs(value) < float("inf"))
    index = F.when(~fine, -1).when(value == largest, bins).when((value >= 0) & (value < largest), F.floor(value / (largest / bins)).cast("int")).otherwise(-1)
    return F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: (i == index).cast("double"))


def pair_pooling(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """max, min and avg of each value over a key's aligned pairs."""
    return rows.groupBy(key).agg(*(f(v).alias(f"{n}_{v}") for v in values for n, f in (("max", F.max), ("min", F.min), ("avg", F.avg))))


def lexical_pair_features(pairs: DataFrame, words: DataFrame, relations: DataFrame) -> DataFrame:
    """``pairs(lhs, rhs)`` with flags: same, oov on either side, and each relation."""
    known = words.select("word").distinct().withColumn("k", F.lit(True))
    rel = relations.groupBy("lhs", "rhs").agg(*(F.max((F.col("relation") == r).cast("int")).alias(r) for r in ("synonym", "hypernym", "hyponym", "antonym")))
    rows = pairs.join(rel, ["lhs", "rhs"], "left").join(known.select(F.col("word").alias("lhs"), F.col("k").alias("kl")), "lhs", "left").join(known.select(F.col("word").alias("rhs"), F.col("k").alias("kr")), "rhs", "left")
    flag = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(*pairs.columns, (F.col("lhs") == F.col("rhs")).cast("int").alias("same"), F.col("kl").isNull().cast("int").alias("oov_lhs"), F.col("kr").isNull().cast("int").alias("oov_rhs"), *(flag(F.col(r)).alias(r) for r in ("synonym", "hypernym", "hyponym", "antonym")))


def path_features(lhs: Column, rhs: Column, steps: list[str]) -> Column:
    """For each step of a fixed list: on the left, on the right, on both, only left, only right."""
    one = lambda arr, s: F.array_contains(arr, s).cast("int")
    groups = (lhs, rhs, F.array_intersect(lhs, rhs), F.array_except(lhs, rhs), F.array_except(rhs, lhs))
    return F.flatten(F.array(*(F.array(*(one(g, s) for s in steps)) for g in groups)))


def rule_feature_vector(rows: DataFrame) -> DataFrame:
    """``rows(lhs, rhs)`` token arrays with counts, overlaps and ratios as ``features``."""
    l, r = F.size("lhs"), F.size("rhs")  # noqa: E741
    both = F.size(F.array_intersect("lhs", "rhs"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    cols = (l, r, both, F.size(F.array_except("lhs", "rhs")), F.size(F.array_except("rhs", "lhs")), ratio(both, l), ratio(both, r), ratio(F.least(l, r), F.greatest(l, r)))
    return rows.withColumn("features", F.array(*(c.cast("double") for c in cols)))


def text_features(tokens: Column, clusters: Column | None = None) -> Column:
    """Different features: w: words, b: bigrams, c: character trigrams, k: clusters of the words (a map)."""
    tag = lambda t, a: F.transform(a, lambda x: F.concat(F.lit(t), x))
    parts = [tag("w:", tokens), tag("b:", word_ngrams(tokens, 2)), tag("c:", F.flatten(F.transform(tokens, lambda t: char_trigrams(t))))]
    if clusters is not None:
        parts.append(tag("k:", F.filter(F.transform(tokens, lambda t: F.try_element_at(clusters, t)), lambda c: c.isNotNull())))
    return F.array_distinct(F.concat(*parts))


def drop_rare_features(rows: DataFrame, least: int) -> DataFrame:
    """``rows(id, feature)`` whose feature stands in more than ``least`` rows."""
    often = rows.groupBy("feature").agg(F.count("*").alias("n")).filter(F.col("n") > least).select("feature")
    return rows.join(often, "feature", "left_semi")


def with_class_weights(rows: DataFrame, label: str) -> DataFrame:
    """``weight``: all rows over the rows of the class."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("k"))
    total = sizes.agg(F.sum("k").alias("total"))
    return rows.join(F.broadcast(sizes), label).crossJoin(F.broadcast(total)).withColumn("weight", F.col("total") / F.col("k")).drop("k", "total")  # a row for each class, one row


def assemble(rows: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(rows)


def logistic(rows: DataFrame, columns: list[str], label: str, balanced: bool = True):
    """A logistic model of ``columns``, classes balanced if asked for."""
    from pyspark.ml.classification import LogisticRegression

    data = assemble(with_class_weights(rows, label) if balanced else rows.withColumn("weight", F.lit(1.0)), columns)
    return LogisticRegression(labelCol=label, weightCol="weight", maxIter=50, regParam=1e-4).fit(data)


def one_vs_rest(rows: DataFrame, columns: list[str], label: str):
    from pyspark.ml.classification import LogisticRegression, OneVsRest

    return OneVsRest(classifier=LogisticRegression(maxIter=20, regParam=1e-4), labelCol=label).fit(assemble(rows, columns))


def svm(rows: DataFrame, columns: list[str], label: str):
    from pyspark.ml.classification import LinearSVC

    return LinearSVC(labelCol=label, maxIter=30, regParam=1e-3).fit(assemble(rows, columns))


def linear_regression(rows: DataFrame, columns: list[str], label: str):
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(labelCol=label, solver="normal").fit(assemble(rows, columns))


def reduce_dimensions(rows: DataFrame, columns: list[str], k: int):
    from pyspark.ml.feature import PCA

    data = assemble(rows, columns)
    return PCA(k=k, inputCol="features", outputCol="reduced").fit(data).transform(data)


def scaled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with mean 0 and standard deviation 1; 0 for constant ones."""
    stats = rows.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    joined = rows.crossJoin(F.broadcast(stats))  # one row
    return joined.select(*rows.columns, *(F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)), F.lit(0.0)).alias(f"z_{c}") for c in columns))


def concat_feature_sets(sets: list[DataFrame]) -> DataFrame:
    """(id, features) of several runs; an id that one lacks is an error."""
    out = sets[0].withColumnRenamed("features", "f0")
    for i, s in enumerate(sets[1:], 1):
        out = out.join(s.withColumnRenamed("features", f"f{i}"), "id", "full")
    missing = F.exists(F.array(*(F.col(f"f{i}").isNull() for i in range(len(sets)))), lambda x: x)
    return out.select("id", F.when(missing, F.raise_error(F.lit("row counts differ"))).otherwise(F.concat(*(f"f{i}" for i in range(len(sets))))).cast("array<double>").alias("features"))


def chain_decode(scores: list[DataFrame], constraints: list[DataFrame], beam: int = 3) -> DataFrame:
    """(id, labels, score): the best chain of labels, each allowed after the one before, beam by beam.

    scores[i](id, label, score) in [0, 1]; constraints[i](a, b) are allowed pairs of columns i and i + 1;
    a pair that isn't allowed scores 0.
    """
    state = scores[0].select("id", F.array("label").alias("labels"), F.col("label").alias("last"), "score")
    for nxt, allowed in zip(scores[1:], constraints, strict=True):
        rows = state.join(nxt.select("id", F.col("label").alias("b"), F.col("score").alias("s")), "id").join(allowed.select(F.col("a").alias("last"), "b", F.lit(1.0).alias("ok")), ["last", "b"], "left")
        rows = rows.select("id", F.concat("labels", F.array("b")).alias("labels"), F.col("b").alias("last"), (F.col("score") * F.col("s") * F.coalesce("ok", F.lit(0.0))).alias("score"))
        state = rows.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "labels"))).filter(F.col("place") <= beam).drop("place")
    return state.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "labels"))).filter("place = 1").select("id", "labels", "score")


def range_of_features(rows: DataFrame) -> DataFrame:
    """index, min, max of ``rows(features)`` arrays."""
    return rows.select(F.posexplode("features").alias("index", "v")).groupBy("index").agg(F.min("v").alias("min"), F.max("v").alias("max"))


def similarity_regressors(tables: list[DataFrame], names: list[str]) -> DataFrame:
    """Metric tables ``(id, value)`` side by side; a missing metric is 0."""
    out = tables[0].withColumnRenamed("value", names[0])
    for t, n in zip(tables[1:], names[1:], strict=True):
        out = out.join(t.withColumnRenamed("value", n), "id", "full")
    return out.na.fill(0.0, names)


def cross_validate(rows: DataFrame, identity: str, folds: int, fit_predict, seed: int = 0) -> DataFrame:
    """Predictions for every row, each from a model fitted on the other folds. ``fit_predict(train, test)``."""
    fold, out = fold_column(identity, folds, seed), None
    for k in range(folds):
        got = fit_predict(rows.filter(fold != k), rows.filter(fold == k)).withColumn("fold", F.lit(k))
        out = got if out is None else out.unionByName(got)
    return out
