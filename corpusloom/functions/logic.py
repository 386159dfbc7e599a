"""Truth values, probabilities and weights as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coin(seed: int, *identity: str) -> Column:
    """A repeatable number in [0, 2 ** 32) for a row: the first digits of md5 over the seed and the row's id."""
    return coin_of(seed, *map(F.col, identity))


def coin_of(seed: int, *identity: Column) -> Column:
    """``coin`` of columns that need no name."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in identity)).cast("binary")), 1, 8), 16, 10).cast("long")


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_odds(p: Column, low: float = 1e-9) -> Column:
    """ln(p / (1 - p)) with p clamped to [low, 1 - low]."""
    p = clamp(p, low, 1 - low)
    return F.ln(p / (1 - p))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def log_add(a: Column, b: Column) -> Column:
    """ln(e^a + e^b) without overflow; null as minus infinity."""
    high = F.greatest(a, b)
    return F.when(a.isNull() | b.isNull(), F.coalesce(a, b)).otherwise(high + F.log1p(F.exp(F.least(a, b) - high)))


def log_sum_exp(values: Column) -> Column:
    """ln of the sum of e^x over an array; null for an empty one."""
    high = F.array_max(values)
    return high + F.ln(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - high)))


def luk_and(*truths: Column) -> Column:
    """Lukasiewicz: max(0, sum - (n - 1))."""
    return F.greatest(F.lit(0.0), sum(truths[1:], truths[0]) - (len(truths) - 1))


def luk_or(*truths: Column) -> Column:
    return F.least(F.lit(1.0), sum(truths[1:], truths[0]))


def goedel_and(*truths: Column) -> Column:
    return F.least(*truths) if len(truths) > 1 else truths[0]


def goedel_or(*truths: Column) -> Column:
    return F.greatest(*truths) if len(truths) > 1 else truths[0]


def product_and(*truths: Column) -> Column:
    out = truths[0]
    for t in truths[1:]:
        out = out * t
    return out


def product_or(*truths: Column) -> Column:
    out = 1 - truths[0]
    for t in truths[1:]:
        out = out * (1 - t)
    return 1 - out


def negation(truth: Column) -> Column:
    return 1 - truth


def luk_all(truths: Column) -> Column:
    """Lukasiewicz conjunction of an array; 1 for an empty one."""
    return F.greatest(F.lit(0.0), F.aggregate(truths, F.lit(0.0), lambda s, t: s + t) - (F.size(truths) - 1))


def implication_distance(body: Column, head: Column) -> Column:
    """Distance to satisfaction of body -> head: max(0, body - head)."""
    return F.greatest(F.lit(0.0), body - head)


def functional(kind: str, a: Column, b: Column) -> Column:
    """Built-in predicates as conditions: unequal, equal, non_symmetric (a before b)."""
    return {"unequal": a != b, "equal": a == b, "non_symmetric": a < b}[kind]
