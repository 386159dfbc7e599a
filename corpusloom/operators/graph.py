"""Lexical and entity graphs: neighbours, closures, paths, components, splits."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.logic import coin
from corpusloom.operators.loops import cut, semi_naive, written

#: Parts of speech of a network by the letters that queries use.
POS = {"n": ("n",), "v": ("v",), "a": ("a", "r"), "r": ("r",)}


def synsets(words: DataFrame, synset_word: DataFrame) -> DataFrame:
    """``words(word, pos)`` with their synsets; ``a`` takes adverbs in, an unknown pos has none."""
    table = F.create_map(*(x for k, v in POS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    asked = words.select("word", "pos", F.explode(F.try_element_at(table, F.col("pos"))).alias("p"))
    return asked.join(synset_word.select("word", F.col("pos").alias("p"), "synset"), ["word", "p"]).drop("p")


def neighbours(nodes: DataFrame, edges: DataFrame, ptr: str) -> DataFrame:
    """(src, dst) one edge of kind ``ptr`` from ``nodes(src)``."""
    return nodes.join(edges.filter(F.col("ptr") == ptr).select("src", "dst"), "src")


def closure(nodes: DataFrame, edges: DataFrame, depth: int | None = None, compat: bool = False) -> DataFrame:
    """(src, dst, depth): what ``nodes(src)`` reach over ``edges(src, dst)`` in 1 to ``depth`` steps, at the least.

    None is no bound. Depth 0 gives nothing; with ``compat`` one level, as the first step is taken before the test.
    """
    if compat and depth == 0:
        depth = 1
    first = nodes.join(edges.select("src", "dst"), "src").select("src", "dst", F.lit(1).alias("depth"))
    if depth == 0:
        return first.filter(F.lit(False))
    onward = edges.select(F.col("src").alias("dst"), F.col("dst").alias("to"))

    def step(delta: DataFrame, i: int) -> DataFrame:
        new = delta.join(onward, "dst").select("src", F.col("to").alias("dst"), F.lit(i + 1).alias("depth"))
        return new if depth is None or i < depth else new.filter(F.lit(False))

    return semi_naive(first, step, ["src", "dst"], max_rounds=1000)


def expand_lemmas(words: DataFrame, synset_word: DataFrame, edges: DataFrame, relation: str, depth: int = 20) -> DataFrame:
    """(word, pos, lemma): words of the same synset (synonym), or of those a relation reaches; antonyms one step away."""
    own = synsets(words, synset_word)
    if relation == "synonym":
        found = own
    elif relation == "antonym":
        found = own.join(neighbours(own.select(F.col("synset").alias("src")).distinct(), edges, "antonym"), F.col("synset") == F.col("src")).select("word", "pos", F.col("dst").alias("synset"))
    else:
        reach = closure(own.select(F.col("synset").alias("src")).distinct(), edges.filter(F.col("ptr") == relation), depth)
        found = own.join(reach, F.col("synset") == F.col("src")).select("word", "pos", F.col("dst").alias("synset"))
    names = synset_word.select("synset", F.col("word").alias("lemma"))
    return found.join(names, "synset").filter("lemma <> word").select("word", "pos", "lemma").distinct()


_KEYS = ["graph", "start", "node"]


def _levels(edges: DataFrame, starts: DataFrame, max_length: int, targets: DataFrame | None = None) -> list[DataFrame]:
    """For each depth from 0 on the nodes first reached there: (graph, start, node, m, pm, depth).

    ``m`` grows with a start's paths, which are compared by names, and ``pm`` is the m of the node before, so no path is
    carried along. Neighbours of a level lie in it, the one before or the one after: only these are compared. A start
    grows until ``targets(graph, start, node)`` of it are reached; without targets to the end.
    """
    edges = written(edges.select("graph", "src", "dst").filter("src is not null and dst is not null").distinct())
    first = starts.select("graph", "start").distinct().select("graph", "start", F.col("start").alias("node"))
    now = written(first.select(*_KEYS, F.monotonically_increasing_id().alias("m"), F.lit(None).cast("long").alias("pm"), F.lit(0).alias("depth")))
    out = [now]
    while len(out) <= max_length:
        here = now.select("graph", "start", F.col("node").alias("at"), "m")
        if targets is not None:
            targets = cut(targets.join(now.select(*_KEYS), _KEYS, "left_anti"))
            here = here.join(targets.select("graph", "start").distinct(), ["graph", "start"], "left_semi")
        step = lambda a, b: here.join(edges.select("graph", F.col(a).alias("at"), F.col(b).alias("node")), ["graph", "at"])  # noqa: B023, E731
        new = step("src", "dst").unionByName(step("dst", "src")).groupBy(*_KEYS).agg(F.min("m").alias("pm"))
        for known in out[-2:]:
            new = new.join(known.select(*_KEYS), _KEYS, "left_anti")
        ordered = new.orderBy("graph", "start", "pm", "node")
        now = written(ordered.select(*_KEYS, F.monotonically_increasing_id().alias("m"), "pm", F.lit(len(out)).alias("depth")))
        if now.isEmpty():
            break
        out.append(now)
    return out


def shortest_paths(edges: DataFrame, starts: DataFrame, max_length: int = 20) -> DataFrame:
    """(graph, start, node, path): a shortest path to each node reached, of equals the first by names.

    edges(graph, src, dst) are followed both ways; starts(graph, start). Frontiers of all graphs
    and starts move together.
    """
    first, *others = _levels(edges, starts, max_length)
    total = paths = first.withColumn("path", F.array("node"))
    for level in others:
        before = paths.select(F.col("m").alias("pm"), F.col("path").alias("before"))
        paths = cut(level.join(before, "pm").withColumn("path", F.concat("before", F.array("node"))).drop("before"))
        total = total.unionByName(paths)
    return total.select(*_KEYS, "path")


def shortest_path(edges: DataFrame, pairs: DataFrame, max_length: int = 20) -> DataFrame:
    """(graph, a, b, path) for ``pairs(graph, a, b)`` that are connected.

    A start grows until its pairs are met; paths are followed back from their ends, level by level.
    """
    pairs = written(pairs)
    asked = written(pairs.select("graph", F.col("a").alias("start"), F.col("b").alias("node")).filter("node is not null").distinct())
    levels = _levels(edges, asked.select("graph", "start"), max_length, asked)
    found = None
    for level in reversed(levels):
        ends = level.join(asked, _KEYS).select("graph", "start", F.col("node").alias("end"), F.array("node").alias("path"), F.col("pm").alias("to"))
        if found is not None:
            back = found.join(level.select("node", "m", "pm"), F.col("to") == F.col("m"))
            ends = ends.unionByName(back.select("graph", "start", "end", F.concat(F.array("node"), "path").alias("path"), F.col("pm").alias("to")))
        found = ends
    return pairs.join(found.select("graph", F.col("start").alias("a"), F.col("end").alias("b"), "path"), ["graph", "a", "b"])


def bfs_order(edges: DataFrame, starts: DataFrame, max_length: int = 20) -> DataFrame:
    """(graph, start, node, place): breadth first, within a depth by path.

    Levels are sorted as they are made, so a place is that within a sorted part and the number of rows in the parts before.
    """
    reach = functools.reduce(DataFrame.unionByName, _levels(edges, starts, max_length)).withColumn("part", F.shiftright("m", 33))
    parts = reach.groupBy("graph", "start", "depth", "part").agg(F.min("m").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("graph", "start").orderBy("depth", "part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    placed = reach.join(parts.withColumn("before", before), ["graph", "start", "depth", "part"])
    return placed.select(*_KEYS, (F.col("before") + F.col("m") - F.col("first") + 1).alias("place"))


def connected_components(pairs: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node that ``pairs(a, b)`` connect it to.

    Nodes are numbered. A round hashes the numbers anew, one to one, and a node takes the least of its own and its neighbours'
    as its label; edges between labels, a constant share fewer, are the next round's. At the end labels are followed back.
    """
    ends = pairs.select("a", "b").filter("a is not null and b is not null")
    nodes = written(ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("id", F.monotonically_increasing_id()))
    number = lambda c, i: nodes.select(F.col("node").alias(c), F.col("id").alias(i))
    edges = written(ends.join(number("a", "u"), "a").join(number("b", "v"), "b").filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels: list[DataFrame] = []
    while not edges.isEmpty():
        if len(labels) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        mixed = edges.select(*(F.xxhash64(F.lit(len(labels)), c).alias(c) for c in ("u", "v")))
        both = mixed.unionByName(mixed.select(F.col("v").alias("u"), F.col("u").alias("v")))
        label = written(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("label")))
        moved = mixed.join(label.withColumnRenamed("label", "lu"), "u").join(label.select(F.col("u").alias("v"), F.col("label").alias("lv")), "v")
        edges = written(moved.filter("lu <> lv").select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct())
        labels.append(label)
    named = nodes.select("node", F.col("id").alias("label"), F.lit(-1).alias("round"))
    root = None  # (u, round, root): a label without edges in the next round is a root
    for i in reversed(range(-1, len(labels))):
        label = (labels[i].withColumn("round", F.lit(i)) if i >= 0 else named).withColumn("next", F.xxhash64(F.lit(i + 1), "label"))
        if root is None:
            label = label.withColumn("root", F.col("label"))
        else:
            after = root.select(F.col("u").alias("next"), F.col("round").alias("later"), F.col("root").alias("last"))
            label = label.join(after, "next", "left").withColumn("root", F.coalesce("last", "label")).withColumn("round", F.coalesce("later", "round"))
        root = label.select("u" if i >= 0 else "node", "round", "root")
        root = written(root)
    least = root.groupBy("round", "root").agg(F.min("node").alias("component"))
    return root.join(least, ["round", "root"]).select("node", "component")


def split_random(vertices: DataFrame, edges: DataFrame, k: int, share: float = 0.2, seed: int = 0, max_rounds: int = 50) -> DataFrame:
    """(node, part): hashed seeds of k parts grow over edges; a node joins the part that reaches it first, the smaller of equals."""
    seeds = vertices.filter(coin(seed, "node") % 1_000_000 < int(share * 1_000_000)).select("node", (coin(seed + 1, "node") % k).cast("int").alias("part"))
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    grow = lambda delta, i: delta.join(both, delta["node"] == both["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("part").alias("part"))
    return semi_naive(seeds, grow, ["node"], max_rounds)


def split_snowball(vertices: DataFrame, edges: DataFrame, k: int, size: int, p: float, seed: int = 0, max_rounds: int = 20) -> DataFrame:
    """(node, part): disjoint samples of about ``size`` nodes; an edge is followed with probability p.

    A part stops growing once it has ``size`` nodes; the last round may pass it.
    """
    start = vertices.select("node").orderBy(coin(seed, "node"), "node").limit(k)
    seeds = start.withColumn("part", (F.row_number().over(W.orderBy(coin(seed, "node"), "node")) - 1).cast("int"))  # k rows
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    taken = followed = cut(seeds)
    for i in range(max_rounds):
        small = taken.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") < size).select("part")
        follow = coin(seed + i, "src", "dst") % 1_000_000 < int(p * 1_000_000)
        new = followed.join(F.broadcast(small), "part").join(both, F.col("node") == F.col("src")).filter(follow)  # k rows at most
        followed = cut(new.groupBy(F.col("dst").alias("node")).agg(F.min("part").alias("part")).join(taken, "node", "left_anti"))
        if followed.isEmpty():
            break
        taken = taken.unionByName(followed)
    return taken


def induced_relations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes(node)``."""
    inside = lambda c: nodes.select(F.col("node").alias(c)).distinct()
    return edges.join(inside("src"), "src", "left_semi").join(inside("dst"), "dst", "left_semi")


#: Groups whose verbs a task gathers at once (a power of two), and pairs of a group and a verb that it looks at in one step.
GATHERED, PAIRS = 256, 1 << 21


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of numbers, one to one."""
    z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).view(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different verbs of each group with their number and two hashes, of rows (block, groups, verbs) sorted by block."""
    block, held = None, np.zeros(0, np.int64)

    def made() -> pa.RecordBatch:
        by = np.lexsort((held >> 8, held & 255))
        group, verbs = held[by] & 255, held[by] >> 8
        first = np.flatnonzero(np.diff(group, prepend=-1))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(verbs)), pa.int32()), pa.array(verbs))
        hashes = [np.bitwise_xor.reduceat(_mixed(verbs, i), first) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(block * GATHERED + group[first]), pa.array(np.diff(np.append(first, len(verbs)))), *map(pa.array, hashes), lists], names=["class", "n", "x0", "x1", "verbs"])

    for batch in batches:
        blocks = batch.column("block").to_numpy()
        (g, gl), (v, vl) = ((x.flatten().to_numpy(), x.value_lengths().to_numpy().astype(np.int64)) for x in (batch.column("groups"), batch.column("verbs")))
        g0, v0 = np.cumsum(gl) - gl, np.cumsum(vl) - vl
        low = 0
        while low < len(blocks):
            if blocks[low] != block:
                if block is not None:
                    yield made()
                block, held = int(blocks[low]), held[:0]
            end = int(np.searchsorted(blocks, block, side="right"))
            high = max(min(end, low + int(np.searchsorted(np.cumsum(gl[low:end] * vl[low:end]), PAIRS, side="right"))), low + 1)
            n = np.repeat(vl[low:high], gl[low:high])  # a row's verbs for each of its groups
            start = np.repeat(v0[low:high], gl[low:high])
            of = g[g0[low] : g0[high - 1] + gl[high - 1]] % GATHERED
            held = np.unique(np.concatenate((held, (v[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())] << 8) | np.repeat(of, n))))
            low = high
    if block is not None:
        yield made()


def verb_groups(arguments: DataFrame, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """(verb, class) and (class, node): the groups of verb_based_split, once for all verbs that have the same.

    Verbs are numbered in their order. A node's verbs go once to each block of groups that have the node, not once for each
    group; a task keeps the different verbs of a block's groups. Groups that reach the same verbs in a round, by two hashes and
    the count of these, go on as one.
    """
    numbers = written(arguments.select("verb").distinct().orderBy(F.asc_nulls_last("verb")).select("verb", F.monotonically_increasing_id().alias("v")))
    named = numbers.withColumnRenamed("verb", "name")
    given = written(arguments.select("verb", "node").distinct().join(named, F.col("verb").eqNullSafe(F.col("name"))).select("v", "verb", "node"))
    by_node = lambda rows, c, name: rows.filter("node is not null").groupBy("node").agg(F.collect_list(c).alias(name))
    members, groups = given.select("v", F.col("v").alias("class")).distinct(), given.select(F.col("v").alias("class"), "node")
    block = lambda c: F.shiftright(c, GATHERED.bit_length() - 1)
    for i in range(rounds):
        met = by_node(given, "v", "verbs")
        met = met.join(by_node(groups, "class", "all"), "node") if i else met.withColumn("all", F.col("verbs"))
        met = met.withColumn("block", F.explode(F.array_distinct(F.transform("all", block)))).select("block", F.filter("all", lambda c: block(c) == F.col("block")).alias("groups"), "verbs")
        sorted_ = met.repartition("block").sortWithinPartitions("block")
        signed = written(sorted_.mapInArrow(_gathered, "class long, n long, x0 long, x1 long, verbs array<long>"))
        first = signed.groupBy("x0", "x1", "n").agg(F.min("class").alias("first"))
        same = written(signed.join(first, ["x0", "x1", "n"]).select(F.col("class").alias("old"), "first"))
        members = members.join(same, F.col("class") == F.col("old")).select("v", F.col("first").alias("class"))
        kept = signed.join(same.filter("old = first"), F.col("class") == F.col("old"), "left_semi").select("class", F.explode("verbs").alias("v"))
        groups = written(kept.join(given.filter("verb is not null"), "v").select("class", "node").distinct())
    number = numbers.select(F.col("v").alias("class"), F.col("verb").alias("of"))
    return members.join(numbers, "v").join(number, "class").select("verb", F.col("of").alias("class")), groups.join(number, "class").select(F.col("of").alias("class"), "node")


def verb_based_split(arguments: DataFrame, rounds: int = 1) -> DataFrame:
    """(verb, node): a group for each verb of ``arguments(verb, node)``, grown through verbs that share an argument."""
    members, groups = verb_groups(arguments, rounds)
    return members.withColumnRenamed("class", "of").join(groups, F.col("of").eqNullSafe(F.col("class"))).select("verb", "node")


def group_children(relations: DataFrame) -> DataFrame:
    """head, children: the dependents (label, child) of each head."""
    return relations.groupBy("head").agg(F.array_sort(F.collect_set(F.struct("label", "child"))).alias("children"))
