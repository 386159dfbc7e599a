"""Evaluation: errors, confusion, precision and recall, rankings, chunks, significance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from corpusloom.functions.logic import coin
from corpusloom.operators.loops import written
from corpusloom.operators.ordered import group_key, with_ranges, within


def _ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def _prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [_ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def rmse(rows: DataFrame) -> DataFrame:
    """Of ``rows(score, gold)``; negative scores are errors and left out."""
    return rows.filter("score >= 0").agg(F.sqrt(F.avg(F.pow(F.col("score") - F.col("gold"), F.lit(2.0)))).alias("rmse"))


def nearest_gold_accuracy(rows: DataFrame) -> DataFrame:
    """accuracy, errors: a score counts as the gold label next to it, the smaller of equals.

    Labels are few: their different values are one array for all rows.
    """
    labels = rows.agg(F.sort_array(F.collect_set("gold")).alias("labels"))
    near = F.array_min(F.transform("labels", lambda g: F.struct(F.abs(F.col("score") - g).alias("d"), g.alias("g"))))["g"]
    return rows.crossJoin(F.broadcast(labels)).agg(F.avg(F.when(F.col("score") >= 0, (near == F.col("gold")).cast("double"))).alias("accuracy"), F.count_if(F.col("score") < 0).alias("errors"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("gold", "pred").agg(F.count("*").alias("n"))


def one_vs_rest(rows: DataFrame) -> DataFrame:
    """class, tp, fp, fn, precision, recall, f1 of ``rows(gold, pred)``."""
    each = rows.select(F.explode(F.array_distinct(F.array("gold", "pred"))).alias("class"), "gold", "pred")
    c = lambda a, b: F.count_if(a & b)
    is_gold, is_pred = F.col("gold") == F.col("class"), F.col("pred") == F.col("class")
    return each.groupBy("class").agg(c(is_gold, is_pred).alias("tp"), c(~is_gold, is_pred).alias("fp"), c(is_gold, ~is_pred).alias("fn")).select("*", *_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def confusion_counts(result: DataFrame, baseline: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """tp, fp, tn, fn over the baseline's rows ``(key, value)``; a missing result is 0."""
    both = baseline.select(key, F.col("value").alias("gold")).join(result.select(key, F.col("value").alias("got")), key, "left")
    return _counts(both, threshold)


def confusion_counts_bounded(result: DataFrame, baseline: DataFrame, key: str, max_atoms: int, threshold: float = 0.5) -> DataFrame:
    """As confusion_counts over both sides' rows; true negatives are the rest of ``max_atoms``."""
    both = baseline.select(key, F.col("value").alias("gold")).join(result.select(key, F.col("value").alias("got")), key, "full")
    return _counts(both, threshold).withColumn("tn", F.lit(max_atoms) - F.col("tp") - F.col("fp") - F.col("fn"))


def _counts(both: DataFrame, threshold: float) -> DataFrame:
    gold, got = (F.coalesce(c, F.lit(0.0)) >= threshold for c in ("gold", "got"))
    return both.agg(*(F.count_if(x).alias(n) for n, x in (("tp", gold & got), ("fp", ~gold & got), ("tn", ~gold & ~got), ("fn", gold & ~got))))


def class_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 of both classes and accuracy from tp, fp, tn, fn; 0 where undefined."""
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    names = lambda cols, s: [c.alias(f"{n}_{s}") for c, n in zip(cols, ("precision", "recall", "f1"), strict=True)]
    return counts.select(*names(_prf(tp, fp, fn), "positive"), *names(_prf(tn, fn, fp), "negative"), _ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"))


def list_errors(result: DataFrame, baseline: DataFrame, key: str, threshold: float = 0.5, compat: bool = False) -> DataFrame:
    """key, kind, difference of false positives and negatives; ``compat`` lists no negatives."""
    both = baseline.select(key, F.col("value").alias("gold")).join(result.select(key, F.col("value").alias("got")), key, "left")
    got = F.coalesce("got", F.lit(0.0))
    kind = F.when((got >= threshold) & (F.col("gold") < threshold), "false positive").when((got < threshold) & (F.col("gold") >= threshold), F.lit(None) if compat else "false negative")
    return both.select(key, kind.alias("kind"), (got - F.col("gold")).alias("difference")).filter("kind is not null")


def values_agree(a: Column, b: Column, kind: str, tolerance: float) -> Column:
    """threshold: on the same side of the tolerance; absolute; manhattan and euclidean over arrays."""
    if kind == "threshold":
        return (a >= tolerance) == (b >= tolerance)
    if kind == "absolute":
        return F.abs(a - b) <= tolerance
    gaps = F.zip_with(a, b, lambda x, y: x - y)
    if kind == "manhattan":
        return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + F.abs(x)) <= tolerance
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)) <= tolerance


def spearman(rows: DataFrame, group: str) -> DataFrame:
    """group, rho: correlation of average ranks.

    Ranks follow from counts of a group's different values, which are cut into ranges, so that no task sorts a large group.
    """
    x = rows.select(F.col(group).alias("own"), group_key(group).alias("g"), "a", "b")
    for c in ("a", "b"):
        values = written(x.groupBy("g", F.col(c).alias("v")).agg(F.count("*").alias("times")))
        number = F.col("v").cast("double") if isinstance(x.schema[c].dataType, NumericType) else F.lit(None).cast("double")
        ranged = with_ranges(values, values.groupBy("g").agg(F.count("*").alias("n")), {"bounds": number})
        ranged = ranged.select("g", "v", "times", F.greatest(F.lit(0), within(number, "bounds")).alias("k"))
        before = lambda w: F.coalesce(F.sum("times").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        lower = ranged.groupBy("g", "k").agg(F.sum("times").alias("times")).select("g", "k", before(W.partitionBy("g").orderBy("k")).alias("lower"))
        placed = ranged.withColumn("place", before(W.partitionBy("g", "k").orderBy("v"))).join(lower, ["g", "k"])
        ranks = placed.select(F.col("g").alias("h"), "v", (F.col("lower") + F.col("place") + (F.col("times") + 1) / 2.0).alias(f"r{c}"))
        x = x.join(ranks, (F.col("g") == F.col("h")) & F.col(c).eqNullSafe(F.col("v"))).drop("h", "v")
    return x.groupBy("g").agg(F.first("own").alias("own"), F.corr("ra", "rb").alias("rho")).select(F.col("own").alias(group), "rho")


def best_by(rows: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """The row with the largest value for each key, then the smallest tie."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(value), tie))).filter("place = 1").drop("place")


def within_bounds(rows: DataFrame, value: str, low: float, high: float, inside: bool = True) -> DataFrame:
    inside_ = F.col(value).between(low, high)
    return rows.filter(inside_ if inside else ~inside_)


def threshold_sweep(train: DataFrame, test: DataFrame, low: float = 0.2, high: float = 0.5, step: float = 0.001) -> DataFrame:
    """threshold, train_accuracy, test_accuracy, coverage: the best threshold on ``train(score, gold)``.

    Thresholds are a fixed grid. Scores are counted by grid cell, so rows aren't multiplied.
    """
    steps = round((high - low) / step)
    cell = F.when(F.col("score") < low, -1).otherwise(F.least(F.lit(steps), F.floor((F.col("score") - low) / step + 1e-9)))
    counted = lambda df: df.filter("score >= 0").groupBy(cell.cast("int").alias("cell")).agg(F.count_if(F.col("gold") >= 0.5).alias("pos"), F.count_if(F.col("gold") < 0.5).alias("neg"))

    def accuracies(df: DataFrame, name: str) -> DataFrame:
        grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("t"))
        cells = F.broadcast(counted(df))  # steps + 2 rows at most
        right = F.sum(F.when(F.col("cell") >= F.col("t"), F.col("pos")).otherwise(F.col("neg")))
        return grid.join(cells, F.lit(True)).groupBy("t").agg((right / F.sum(F.col("pos") + F.col("neg"))).alias(name))

    both = accuracies(train, "train_accuracy").join(accuracies(test, "test_accuracy"), "t").withColumn("threshold", F.lit(low) + F.col("t") * step)
    coverage = test.agg(F.avg((F.col("score") >= 0).cast("double")).alias("coverage"))
    return both.orderBy(F.desc("train_accuracy"), "t").limit(1).select("threshold", "train_accuracy", "test_accuracy").crossJoin(F.broadcast(coverage))


def confidence_weighted_score(rows: DataFrame, group: str, identity: str) -> DataFrame:
    """group, score: mean over ranks, by falling margin, of the precision up to the rank.

    rows(group, identity, margin, correct).
    """
    w = W.partitionBy(group).orderBy(F.desc(F.abs("margin")), identity)
    at = F.sum(F.col("correct").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)) / F.row_number().over(w)
    return rows.withColumn("p", at).groupBy(group).agg(F.avg("p").alias("score"))


def chunks(tags: DataFrame, column: str) -> DataFrame:
    """sent, start, end, type of the chunks in B/I/E/O tags ``(sent, pos, column)``."""
    w = W.partitionBy("sent").orderBy("pos")
    kind, type_ = F.substring_index(column, "-", 1), F.when(F.col(column).contains("-"), F.substring_index(F.col(column), "-", -1)).otherwise("")
    rows = tags.select("sent", "pos", kind.alias("k"), type_.alias("type"))
    rows = rows.withColumns({"k0": F.coalesce(F.lag("k").over(w), F.lit("O")), "t0": F.coalesce(F.lag("type").over(w), F.lit(""))})
    starts = (F.col("k") != "O") & ((F.col("k") == "B") | F.col("k0").isin("O", "E") | (F.col("type") != F.col("t0")))
    marked = rows.filter("k <> 'O'").withColumn("starts", starts.cast("int"))
    marked = marked.withColumn("chunk", F.sum("starts").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("sent", "chunk").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.first("type").alias("type")).drop("chunk")


def chunk_eval(tags: DataFrame) -> DataFrame:
    """type ('' for all), gold, guessed, correct, precision, recall, f1 of ``tags(sent, pos, gold, pred)``.

    A chunk is right if place and type agree.
    """
    gold, pred = chunks(tags, "gold").withColumn("g", F.lit(1)), chunks(tags, "pred").withColumn("p", F.lit(1))
    both = gold.join(pred, ["sent", "start", "end", "type"], "full")
    each = both.select(F.explode(F.array(F.lit(""), F.col("type"))).alias("type"), F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))
    sums = each.groupBy("type").agg(F.sum("g").alias("gold"), F.sum("p").alias("guessed"), F.sum(F.col("g") * F.col("p")).alias("correct"))
    c = F.col("correct")
    return sums.select("*", *_prf(c, F.col("guessed") - c, F.col("gold") - c))


def tag_accuracy(tags: DataFrame) -> DataFrame:
    """token_accuracy and sentence_accuracy of ``tags(sent, gold, pred)``."""
    by = tags.groupBy("sent").agg(F.count_if(F.col("gold") == F.col("pred")).alias("right"), F.count("*").alias("n"))
    return by.agg((F.sum("right") / F.sum("n")).alias("token_accuracy"), F.avg((F.col("right") == F.col("n")).cast("double")).alias("sentence_accuracy"))


def kbest_oracle(rows: DataFrame) -> DataFrame:
    """oracle accuracy and mean list size of ``rows(gold, candidates)``."""
    return rows.agg(F.avg(F.array_contains("candidates", F.col("gold")).cast("double")).alias("oracle"), F.avg(F.size("candidates")).alias("mean_size"))


def dependency_scores(gold: DataFrame, pred: DataFrame, keys: list[str], by: str | None = None, ignored: DataFrame | None = None) -> DataFrame:
    """correct, gold, guessed, precision, recall, f1 of dependency rows that agree in ``keys``; by a column if given."""
    if ignored is not None:
        gold, pred = (d.join(ignored, ignored.columns, "left_anti") for d in (gold, pred))
    cols = list(dict.fromkeys([*keys, *([by] if by else [])]))
    both = gold.select(*cols).distinct().withColumn("g", F.lit(1)).join(pred.select(*cols).distinct().withColumn("p", F.lit(1)), cols, "full")
    sums = both.groupBy(*([by] if by else [])).agg(F.count("g").alias("gold"), F.count("p").alias("guessed"), F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("correct"))
    c = F.col("correct")
    return sums.select("*", *_prf(c, F.col("guessed") - c, F.col("gold") - c))


def distance_buckets(rows: DataFrame, distance: str, size: int = 5) -> DataFrame:
    """Rows with ``bucket``: the distance rounded up to a multiple of size."""
    return rows.withColumn("bucket", (F.ceil(F.col(distance) / size) * size).cast("int"))


def accuracy_by_method(rows: DataFrame) -> DataFrame:
    """method, n, accuracy of ``rows(method, gold, pred)``, and the majority class of all as ``majority``."""
    top = rows.groupBy("gold").agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("rate"))
    each = rows.groupBy("method").agg(F.count("*").alias("n"), F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("accuracy"))
    base = rows.agg(F.count("*").alias("n")).crossJoin(F.broadcast(top)).select(F.lit("majority").alias("method"), "n", F.col("rate").alias("accuracy"))
    return each.unionByName(base)


def correlation(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.agg(F.corr(a, b).alias("r"))


def group_quantile_smoothing(groups: DataFrame, quantiles: list[float]) -> DataFrame:
    """q, r: for each quantile the correlation of a group's weight quantile with its gold value, best first.

    groups(group, weight, gold).
    """
    each = groups.groupBy("group").agg(F.percentile("weight", F.array(*map(F.lit, quantiles))).alias("qs"), F.first("gold").alias("gold"))
    long = each.select("gold", F.posexplode("qs").alias("i", "value"))
    q = F.element_at(F.array(*map(F.lit, quantiles)), F.col("i") + 1)
    return long.groupBy(q.alias("q")).agg(F.corr("value", "gold").alias("r")).orderBy(F.desc("r"), "q")


def fold_column(identity: str, folds: int, seed: int = 0) -> Column:
    """A repeatable fold number for each id."""
    return (coin(seed, identity) % folds).cast("int")


def joint_label_accuracy(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Share of rows in which all label columns agree."""
    same = F.lit(True)
    for a, b in pairs:
        same = same & F.col(a).eqNullSafe(F.col(b))
    return rows.agg(F.avg(same.cast("double")).alias("accuracy"))


def average(rows: DataFrame, value: str) -> DataFrame:
    return rows.agg(F.avg(value).alias("average"))
