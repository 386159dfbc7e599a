"""Soft logic: predicate tables, grounding by joins, rule distances, inference in table form.

A predicate table has argument columns a1, a2, ..., ``truth`` in [0, 1] and optionally ``part``
and ``state``. A rule body is a list of atoms: a predicate's name and its arguments, where a
string is a variable and ``Const(x)`` a constant.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.loops import cut, semi_naive, written


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Atom:
    predicate: str
    args: tuple


def predicate_table(rows: DataFrame, args: list[str], truth: str | None = None, part: int = 0) -> DataFrame:
    """Argument columns as a1.., truth 1 where no column gives it."""
    named = [F.col(c).alias(f"a{i}") for i, c in enumerate(args, 1)]
    return rows.select(*named, (F.col(truth).cast("double") if truth else F.lit(1.0)).alias("truth"), F.lit(part).alias("part"))


def visible(predicate: DataFrame, read_parts: list[int], write_part: int) -> DataFrame:
    return predicate.filter(F.col("part").isin(*read_parts, write_part))


def drop_partition(predicate: DataFrame, part: int) -> DataFrame:
    return predicate.filter(F.col("part") != part)


def get_facts(predicate: DataFrame, bound: dict[int, object]) -> DataFrame:
    """Free arguments and truth of the facts with the bound arguments (by position from 1)."""
    for i, value in bound.items():
        predicate = predicate.filter(F.col(f"a{i}") == value)
    free = [c for c in predicate.columns if c.startswith("a") and c[1:].isdigit() and int(c[1:]) not in bound]
    return predicate.select(*free, "truth")


def atom_lookup(atoms: DataFrame, predicate: DataFrame, closed: bool) -> DataFrame:
    """``atoms`` with truth and state: a missing atom is 0 if the predicate is closed, else a random variable."""
    args = atoms.columns
    found = atoms.join(predicate.select(*args, "truth"), args, "left")
    state = F.when(F.col("truth").isNotNull(), "fact").otherwise("default" if closed else "random")
    return found.withColumn("state", state).withColumn("truth", F.coalesce("truth", F.lit(0.0)) if closed else F.col("truth"))


def facts_with(predicates: dict[str, DataFrame], entity) -> DataFrame:
    """(predicate, position, truth, args) of every fact that has the entity in some position."""
    out = None
    for name, p in predicates.items():
        args = [c for c in p.columns if c.startswith("a") and c[1:].isdigit()]
        shown = F.concat_ws(",", *(F.col(c).cast("string") for c in args))
        for i, c in enumerate(args, 1):
            rows = p.filter(F.col(c).cast("string") == str(entity)).select(F.lit(name).alias("predicate"), F.lit(i).alias("position"), "truth", shown.alias("args"))
            out = rows if out is None else out.unionByName(rows)
    return out


def order_atoms(body: list[Atom]) -> list[Atom]:
    """Atoms one after another by the fewest variables that are not bound yet, then by their order."""
    left, bound, out = list(body), set(), []
    while left:
        best = min(left, key=lambda a: (sum(isinstance(x, str) and x not in bound for x in dict.fromkeys(a.args)), left.index(a)))
        left.remove(best)
        out.append(best)
        bound |= {x for x in best.args if isinstance(x, str)}
    return out


def _atom(predicates: dict[str, DataFrame], atom: Atom, truth: str) -> DataFrame:
    """An atom's facts: constants as filters, variables as columns, a repeated variable as an equality."""
    p = predicates[atom.predicate]
    seen: dict[str, str] = {}
    for i, x in enumerate(atom.args, 1):
        if isinstance(x, Const):
            p = p.filter(F.col(f"a{i}") == x.value)
        elif x in seen:
            p = p.filter(F.col(f"a{i}") == F.col(seen[x]))
        else:
            seen[x] = f"a{i}"
    return p.select(*(F.col(c).alias(v) for v, c in seen.items()), F.col("truth").alias(truth))


def ground_inner(predicates: dict[str, DataFrame], body: list[Atom], bindings: DataFrame | None = None, condition: Column | None = None) -> DataFrame:
    """All groundings: a column for each variable, and truth1.. in the body's order.

    Catalyst orders the joins; an atom that shares no variable with those before is an error.
    """
    out, bound = bindings, set(bindings.columns) if bindings is not None else set()
    for n, atom in [(body.index(a) + 1, a) for a in order_atoms(body)]:
        rows = _atom(predicates, atom, f"truth{n}")
        shared = [c for c in rows.columns if c in bound]
        if out is not None and not shared:
            raise ValueError(f"{atom} shares no variable with the atoms before it")
        out = rows if out is None else out.join(rows, shared)
        bound |= {c for c in rows.columns if not c.startswith("truth")}
    return out if condition is None else out.filter(condition)


def distinct_groundings(grounded: DataFrame, variables: list[str]) -> DataFrame:
    return grounded.select(*variables).distinct()


def anchor_outer(predicates: dict[str, DataFrame], body: list[Atom]) -> DataFrame:
    """The first atom's facts with the other atoms left-joined on what they share; missing truths are null."""
    out = _atom(predicates, body[0], "truth1")
    for n, atom in enumerate(body[1:], 2):
        rows = _atom(predicates, atom, f"truth{n}")
        out = out.join(rows, [c for c in rows.columns if c in out.columns], "left")
    return out


def ground_outer(predicates: dict[str, DataFrame], body: list[Atom], per_variable: int = 2, limit: int = 10_000) -> DataFrame:
    """Groundings of averaging bodies: each variable's best candidates in all combinations.

    A variable's candidates are the values of its columns, by the summed truth of the facts they
    stand in, then by value; ``per_variable`` of them are taken. Their combinations, at most
    per_variable ** variables rows, get each atom's truth, 0 where there is none; ``limit`` are kept
    by falling sum.
    """
    variables = list(dict.fromkeys(x for a in body for x in a.args if isinstance(x, str)))
    if per_variable ** len(variables) > 1_000_000:
        raise ValueError("too many combinations; lower per_variable")
    out, taken = None, {}
    for v in variables:
        values = None
        for a in body:
            if v in a.args:
                rows = _atom(predicates, a, "truth").select(F.col(v).alias(v), "truth")
                values = rows if values is None else values.unionByName(rows)
        best = values.groupBy(v).agg(F.round(F.sum("truth"), 9).alias("summed_truth")).orderBy(F.desc("summed_truth"), v).limit(per_variable).select(v)
        taken[v] = best = cut(best)
        out = best if out is None else out.crossJoin(F.broadcast(best))  # per_variable rows
    for n, a in enumerate(body, 1):
        rows = _atom(predicates, a, f"truth{n}")
        keys = [c for c in rows.columns if not c.startswith("truth")]
        for v in keys:
            rows = rows.join(F.broadcast(taken[v]), v, "left_semi")  # per_variable rows
        out = out.join(rows.groupBy(*keys).agg(F.max(f"truth{n}").alias(f"truth{n}")), keys, "left").withColumn(f"truth{n}", F.coalesce(f"truth{n}", F.lit(0.0)))
    total = sum((F.col(f"truth{n}") for n in range(2, len(body) + 1)), F.col("truth1"))
    return out.orderBy(F.desc(total), *variables).limit(limit)


def null_count(grounded: DataFrame, atoms: int) -> DataFrame:
    """The fewest unmatched atoms over all groundings of anchor_outer."""
    missing = sum((F.col(f"truth{n}").isNull().cast("int") for n in range(2, atoms + 1)), F.lit(0))
    return grounded.agg(F.min(missing).alias("null_count"))


def bind_variables(grounded: DataFrame, values: dict[str, object]) -> DataFrame:
    """Groundings with the given values; an id of 0 stands for null and matches nothing."""
    for v, x in values.items():
        grounded = grounded.filter(F.nullif(F.col(v), F.lit(0)) == x if isinstance(x, int) else F.col(v) == x)
    return grounded


def entity_domain(predicates: dict[str, tuple[DataFrame, list[int]]]) -> DataFrame:
    """(entity): different values over the given positions of the given predicates."""
    out = None
    for p, positions in predicates.values():
        for i in positions:
            rows = p.select(F.col(f"a{i}").alias("entity"))
            out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def external_function_filter(grounded: DataFrame, function: Callable[..., Column], *variables: str) -> DataFrame:
    return grounded.filter(function(*map(F.col, variables)) > 0)


def rule_distance(grounded: DataFrame, atoms: int, head: str) -> DataFrame:
    """distance: max(0, sum(body) - (n - 1) - head), the Lukasiewicz distance to satisfaction."""
    body = sum((F.col(f"truth{n}") for n in range(2, atoms + 1)), F.col("truth1")) - (atoms - 1)
    return grounded.withColumn("distance", F.greatest(F.lit(0.0), body - F.col(head)))


def rule_distance_avg(grounded: DataFrame, arities: list[int], head: str, meta_w: float = 1.0, rest_w: float = 1.0, rel_w: float = 1.0) -> DataFrame:
    """distance to an averaging body: the weighted mean of its truths.

    Atoms without, with one and with two arguments share the class weights meta_w, rest_w and rel_w.
    """
    of = {0: meta_w, 1: rest_w, 2: rel_w}
    counts = {k: sum(min(a, 2) == k for a in arities) for k in of}
    total = sum(of[k] for k in of if counts[k])
    weights = [of[min(a, 2)] / counts[min(a, 2)] / total for a in arities]
    body = sum((F.col(f"truth{n}") * w for n, w in list(enumerate(weights, 1))[1:]), F.col("truth1") * weights[0])
    return grounded.withColumn("distance", F.greatest(F.lit(0.0), body - F.col(head)))


def total_incompatibility(distances: DataFrame) -> DataFrame:
    """rule, incompatibility, derivative, groundings of ``distances(rule, weight, distance)``."""
    return distances.groupBy("rule").agg(F.sum(F.col("weight") * F.col("distance")).alias("incompatibility"), F.sum("distance").alias("derivative"), F.count("*").alias("groundings"))


def prior(atoms: DataFrame, args: list[str], weight: float, default: float = 0.0) -> DataFrame:
    """penalty of open atoms ``(args, truth)``, each once."""
    return atoms.groupBy(*args).agg(F.max("truth").alias("truth")).agg(F.sum(F.lit(weight) * F.abs(F.col("truth") - default)).alias("penalty"))


def functional_constraint(predicate: DataFrame, kind: str) -> DataFrame:
    """key, total, violation: functional and inverse_functional sums must be 1, partial_* at most 1."""
    key = "a2" if "inverse" in kind else "a1"
    sums = predicate.groupBy(F.col(key).alias("key")).agg(F.sum("truth").alias("total"))
    gap = F.greatest(F.lit(0.0), F.col("total") - 1) if kind.startswith("partial") else F.abs(F.col("total") - 1)
    return sums.withColumn("violation", gap).filter(F.col("violation") > 1e-9)


def set_term(grounded: DataFrame, anchors: list[str], leaf: str, truth: Column) -> DataFrame:
    """(anchors, element, degree): soft sets of a formula's leaf values; degrees add up."""
    return grounded.groupBy(*anchors, F.col(leaf).alias("element")).agg(F.sum(truth).alias("degree"))


def set_union(*sets: DataFrame) -> DataFrame:
    keys = [c for c in sets[0].columns if c != "degree"]
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.groupBy(*keys).agg(F.sum("degree").alias("degree"))


def set_comparison(a: DataFrame, b: DataFrame, similar: DataFrame, kind: str, nc: float = 0.1, factor: float | None = None) -> DataFrame:
    """(id, score) of soft sets ``(id, element, degree)`` by ``similar(e1, e2, truth)``.

    kinds: equality sum(min * sim) / max(size); overlap / min(size), at most 1, empty 1;
    constant_overlap / (max(size) * nc), at most 1; cross_equality / (size1 * size2);
    average / size1, 0 when empty; min the plain sum; evid_min the same, at most 1.
    ``factor`` leaves ids out whose number of comparisons times factor is under 0.01.
    """
    sizes = lambda s, name: s.groupBy("id").agg(F.sum("degree").alias(name))
    ids = a.select("id").unionByName(b.select("id")).distinct()
    pairs = a.select("id", F.col("element").alias("e1"), F.col("degree").alias("d1")).join(similar, "e1").join(b.select("id", F.col("element").alias("e2"), F.col("degree").alias("d2")), ["id", "e2"])
    sums = pairs.groupBy("id").agg(F.sum(F.least("d1", "d2") * F.col("truth")).alias("m"), F.sum(F.col("d1") * F.col("d2") * F.col("truth")).alias("x"), F.sum("truth").alias("t"), F.count("*").alias("n"))
    rows = ids.join(sizes(a, "s1"), "id", "left").join(sizes(b, "s2"), "id", "left").join(sums, "id", "left").na.fill(0.0, ["s1", "s2", "m", "x", "t"]).na.fill(0, ["n"])
    s1, s2, m = F.col("s1"), F.col("s2"), F.col("m")
    over = lambda top, low: F.coalesce(top / F.nullif(low, F.lit(0.0)), F.lit(0.0))
    empty = (s1 == 0) | (s2 == 0)
    score = {
        "equality": over(m, F.greatest(s1, s2)),
        "overlap": F.when(empty, 1.0).otherwise(F.least(F.lit(1.0), over(m, F.least(s1, s2)))),
        "constant_overlap": F.least(F.lit(1.0), over(m, F.greatest(s1, s2) * nc)),
        "cross_equality": over(F.col("x"), s1 * s2),
        "average": over(m, s1),
        "min": F.col("t"),
        "evid_min": F.least(F.lit(1.0), F.col("t")),
    }[kind]
    if factor is not None:
        rows = rows.filter(~empty & (F.col("n") * factor >= 0.01))
    return rows.select("id", score.alias("score"))


def close_world(predicate: DataFrame, domain: DataFrame, arity: int, wildcards: DataFrame | None = None) -> DataFrame:
    """Negative facts for each constant, or pair, of ``domain(problem, entity)`` without one.

    ``predicate`` has the arguments and their problem. ``wildcards(a1)`` are first arguments that
    stand for all: their pairs are not closed. Pairs are those of one reasoning problem.
    """
    named = lambda c: domain.select("problem", F.col("entity").alias(c)).distinct()
    every = named("a1") if arity == 1 else named("a1").join(named("a2"), "problem")
    args = ["problem", *(f"a{i}" for i in range(1, arity + 1))]
    missing = every.join(predicate.select(*args), args, "left_anti")
    if wildcards is not None:
        missing = missing.join(wildcards.select("a1"), "a1", "left_anti")
    return missing.withColumn("truth", F.lit(0.0))


def closed_lookup(asked: DataFrame, predicate: DataFrame, domain: DataFrame, arity: int, wildcards: DataFrame | None = None) -> DataFrame:
    """``asked(problem, a1[, a2])`` with ``truth`` in the closed world: a fact's own, 0 for what close_world has, else null.

    The negative facts are never made: they are the domain's constants less the facts, and a row is met with both. Of
    repeated facts the largest truth counts. Asked rows stay as they are, repeated ones too; one with a null is unknown.
    """
    args = [f"a{i}" for i in range(1, arity + 1)]
    facts = predicate.groupBy("problem", *args).agg(F.max("truth").alias("fact"))
    out = asked.join(facts, ["problem", *args], "left")
    inside = F.lit(True)
    for a in args:
        known = domain.select("problem", F.col("entity").alias(a)).distinct().withColumn(f"in_{a}", F.lit(True))
        out = out.join(known, ["problem", a], "left")
        inside = inside & F.coalesce(F.col(f"in_{a}"), F.lit(False))
    if wildcards is not None:
        out = out.join(wildcards.select("a1").distinct().withColumn("wild", F.lit(True)), "a1", "left")
        inside = inside & F.col("wild").isNull()
    return out.select(*asked.columns, F.coalesce("fact", F.when(inside, 0.0)).alias("truth"))


def closed_counts(predicate: DataFrame, domain: DataFrame, arity: int, wildcards: DataFrame | None = None) -> DataFrame:
    """(problem, negative): how many rows close_world has, for each problem of the domain, by inclusion and exclusion.

    All tuples whose first constant is no wildcard, less the facts among them; no tuple is made.
    """
    args = [f"a{i}" for i in range(1, arity + 1)]
    constants = domain.select("problem", "entity").dropna().distinct()
    firsts = constants if wildcards is None else constants.join(wildcards.select(F.col("a1").alias("entity")), "entity", "left_anti")
    facts = predicate.select("problem", *args).distinct()
    for a in args:
        facts = facts.join((firsts if a == "a1" else constants).withColumnRenamed("entity", a), ["problem", a], "left_semi")
    count = lambda df, name: df.groupBy("problem").agg(F.count("*").alias(name))
    sizes = count(constants, "n").join(count(firsts, "m"), "problem", "left").join(count(facts, "k"), "problem", "left").fillna(0, ["m", "k"])
    tuples = F.col("m") if arity == 1 else F.col("m") * F.col("n")
    return sizes.select("problem", (tuples - F.col("k")).alias("negative"))


def propagate_constants(sets: DataFrame, implications: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(pred, const): ``sets`` closed under implications(rule, lhs, rhs): rhs takes the constants all lhs share."""
    sizes = implications.groupBy("rule").agg(F.countDistinct("lhs").alias("n_lhs"))
    heads = implications.groupBy("rule", "rhs").agg(F.collect_set("lhs").alias("needs")).join(sizes, "rule").filter(F.size("needs") == F.col("n_lhs"))
    heads = cut(heads.select(F.explode("needs").alias("newest"), "needs", "rhs"))
    total = written(sets.select("pred", "const").distinct())
    # A constant carries its predicates; only those with new ones go on to the next round.
    rows = total.filter("const is not null").groupBy("const").agg(F.collect_set("pred").alias("preds")).withColumn("new", F.col("preds"))
    for _ in range(max_rounds):
        fires = (F.size(F.array_except("needs", "preds")) == 0) & ~F.array_contains("preds", F.col("rhs"))
        met = rows.select("const", "preds", F.explode("new").alias("newest")).join(heads, "newest").filter(fires)
        new = met.groupBy("const").agg(F.first("preds").alias("preds"), F.collect_set("rhs").alias("new"))
        rows = written(new.select("const", F.concat("preds", "new").alias("preds"), "new"))
        if rows.isEmpty():
            return total
        total = total.unionByName(rows.select(F.explode("new").alias("pred"), "const"))
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")


def activate_to_fixpoint(start: DataFrame, step: Callable[[DataFrame, int], DataFrame], threshold: float = 0.01, max_rounds: int = 50) -> DataFrame:
    """Atoms ``(a1, a2, truth)`` grounded again from the newly active ones until none is above the threshold."""
    return semi_naive(start.filter(F.col("truth") >= threshold), lambda delta, i: step(delta, i).filter(F.col("truth") >= threshold), ["a1", "a2"], max_rounds)


def map_inference(terms: DataFrame, rules: DataFrame, rounds: int = 1000, tolerance: float = 1e-3, every: int = 10) -> DataFrame:
    """(atom, truth, cost, bound): most probable truths in [0, 1] under hinge losses, with the proof that they are.

    terms(rule, atom, coefficient) and rules(rule, weight, constant): rule r costs
    weight * max(0, constant + sum(coefficient * truth)), with weights of 0 or more; each rule once. A rule has a
    multiplier between 0 and its weight, and any multipliers bound the least cost from below: sum(multiplier * constant)
    plus, for each atom, the lesser of 0 and sum(multiplier * coefficient). Primal-dual steps (Chambolle and Pock 2011,
    with a step size for each rule and atom) move multipliers up and truths down their slopes. Every few rounds the means
    since the last restart are compared with the newest; once the gap of the better ones has halved, or after long,
    the search goes on from those, and the step sizes are balanced by how far both have moved (restarts as of
    Applegate et al. 2021). It ends once ``cost`` is within ``tolerance`` * max(1, cost) of ``bound``; if it doesn't in
    ``rounds``, that is an error. Equal (rule, atom) are added up; a rule without terms costs its constant; terms without
    a rule and rows with a null are left out. Without terms the result is empty. Sums by rule and by atom are combined
    before they are shuffled, so that an atom in most rules is no one task's.
    """
    if not rules.filter("weight < 0").isEmpty():
        raise ValueError("a weight below 0 has no least cost")
    whole = rules.select("rule", F.col("weight").cast("double").alias("weight"), F.col("constant").cast("double").alias("constant")).dropna()
    terms = terms.dropna(subset=["rule", "atom", "coefficient"]).groupBy("rule", "atom").agg(F.sum(F.col("coefficient").cast("double")).alias("a"))
    terms = cut(terms.join(whole.select("rule"), "rule", "left_semi"))
    sizes = F.greatest(F.sum(F.abs("a")), F.lit(1e-12))
    duals = cut(whole.join(terms.groupBy("rule").agg((1 / sizes).alias("step")), "rule").select("*", *(F.lit(0.0).alias(c) for c in ("y", "y_sum", "y_from"))))
    atoms = cut(terms.groupBy("atom").agg((1 / sizes).alias("step")).select("*", F.lit(0.5).alias("z"), F.lit(0.5).alias("ahead"), F.lit(0.0).alias("z_sum"), F.lit(0.5).alias("z_from")))
    alone = whole.join(terms, "rule", "left_anti").agg(F.sum(F.greatest(F.lit(0.0), F.col("constant")) * F.col("weight"))).first()[0] or 0.0

    def by_rule(*values: Column) -> DataFrame:
        sums = terms.join(atoms, "atom").groupBy("rule").agg(*(F.sum(F.col("a") * v).alias(f"s{i}") for i, v in enumerate(values)))
        return duals.join(sums, "rule")

    def by_atom(*values: Column) -> DataFrame:
        sums = terms.join(duals.drop("step"), "rule").groupBy("atom").agg(*(F.sum(F.col("a") * v).alias(f"s{i}") for i, v in enumerate(values)))
        return atoms.join(sums, "atom")

    if atoms.isEmpty():
        return atoms.select("atom", F.col("z").alias("truth"), F.lit(alone).alias("cost"), F.lit(alone).alias("bound"))
    lean, since, gap_then, bound, cost = 1.0, 0, float("inf"), float("-inf"), float("inf")
    for i in range(1, rounds + 1):
        up = F.col("y") + lean * F.col("step") * (F.col("s0") + F.col("constant"))
        y = F.least("weight", F.greatest(F.lit(0.0), up))
        duals = cut(by_rule(F.col("ahead")).select("rule", "weight", "constant", "step", y.alias("y"), (F.col("y_sum") + y).alias("y_sum"), "y_from"))
        z = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("z") - F.col("step") / lean * F.col("s0")))
        atoms = cut(by_atom(F.col("y")).select("atom", "step", z.alias("z"), (2 * z - F.col("z")).alias("ahead"), (F.col("z_sum") + z).alias("z_sum"), "z_from"))
        since += 1
        if i % every:
            continue
        mean_y, mean_z = F.col("y_sum") / since, F.col("z_sum") / since
        costs = by_rule(F.col("z"), mean_z).agg(*(F.sum(F.col("weight") * F.greatest(F.lit(0.0), F.col(f"s{k}") + F.col("constant"))) for k in (0, 1)), *(F.sum(v * F.col("constant")) for v in (F.col("y"), mean_y))).first()
        pulls = by_atom(F.col("y"), mean_y).agg(*(F.sum(F.least(F.lit(0.0), F.col(f"s{k}"))) for k in (0, 1))).first()
        found = [(costs[k] + alone, costs[2 + k] + pulls[k] + alone) for k in (0, 1)]
        best = min((0, 1), key=lambda k: found[k][0])
        cost, bound = found[best][0], max(bound, *(x[1] for x in found))
        if cost - bound <= tolerance * max(1.0, abs(cost)):
            return atoms.select("atom", (mean_z if best else F.col("z")).alias("truth"), F.lit(cost).alias("cost"), F.lit(bound).alias("bound"))
        gaps = [c - b for c, b in found]
        if min(gaps) <= 0.5 * gap_then or since >= 0.36 * i:
            mean, gap_then = gaps[1] < gaps[0], min(gaps)
            y, z = (mean_y, mean_z) if mean else (F.col("y"), F.col("z"))
            far = lambda df, to, since_: df.agg(F.sqrt(F.sum((to - F.col(since_)) * (to - F.col(since_)) / F.col("step")))).first()[0]
            moved_y, moved_z = far(duals, y, "y_from"), far(atoms, z, "z_from")
            if min(moved_y, moved_z) > 1e-9:
                lean = math.sqrt(lean * moved_y / moved_z)
            duals = duals.select("rule", "weight", "constant", "step", y.alias("y"), F.lit(0.0).alias("y_sum"), y.alias("y_from"))
            atoms = atoms.select("atom", "step", z.alias("z"), z.alias("ahead"), F.lit(0.0).alias("z_sum"), z.alias("z_from"))
            since = 0
    raise RuntimeError(f"after {rounds} rounds the cost {cost} is not within {tolerance} of its bound {bound}")


def learn_weights(truth_sums: dict[str, float], infer: Callable[[dict[str, float]], dict[str, float]], weights: dict[str, float], steps: int = 10, rate: float = 0.1, low: float = 0.0, high: float = 100.0) -> dict[str, float]:
    """Averaged perceptron: weights move by a rule's summed distance under inference less that on the truth.

    ``infer`` gives each rule's summed distance (total_incompatibility) for weights; only the
    weight vector is on the driver.
    """
    now, total = dict(weights), dict.fromkeys(weights, 0.0)
    for _ in range(steps):
        got = infer(now)
        now = {r: min(high, max(low, w + rate * (got.get(r, 0.0) - truth_sums.get(r, 0.0)))) for r, w in now.items()}
        total = {r: total[r] + now[r] for r in now}
    return {r: t / steps for r, t in total.items()}


def entailment_answer(candidates: DataFrame, truths: DataFrame) -> DataFrame:
    """(name, truth): the largest truth over a name's ids, 0 by default."""
    return candidates.join(truths, "id", "left").groupBy("name").agg(F.max(F.coalesce("truth", F.lit(0.0))).alias("truth"))


def clause_true_counts(grounded: DataFrame, threshold: float = 0.5) -> DataFrame:
    return grounded.filter(F.col("truth") >= threshold).groupBy("clause").agg(F.count("*").alias("n"))


def learn_external_function(pairs: DataFrame, features: list[str], label: str):
    """A logistic similarity learned from grounded pairs; its ``transform`` scores pairs in bulk."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), LogisticRegression(labelCol=label, maxIter=30, regParam=1e-3)]).fit(pairs)


def query_stats(rows: DataFrame, columns: list[str], single: bool = False) -> DataFrame:
    """Numeric columns as doubles; with ``single`` any number of rows but one is an error."""
    out = rows.select(*(F.col(c).cast("double") for c in columns))
    if not single:
        return out
    first = out.agg(*(F.first(c).alias(c) for c in columns), F.count("*").alias("rows"))
    return first.select(*(F.when(F.col("rows") == 1, F.col(c)).otherwise(F.raise_error(F.lit("not one row")).cast("double")).alias(c) for c in columns))
