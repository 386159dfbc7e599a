"""Similarity of strings, token arrays and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import filter_stopwords, word_ngrams


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def levenshtein_sim(a: Column, b: Column, threshold: float = 0.5) -> Column:
    """1 - distance / longer length, 0 unless above the threshold; two empty strings give 1."""
    longer = F.greatest(F.length(a), F.length(b))
    sim = F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.nullif(longer, F.lit(0)))
    return F.when(sim > threshold, sim).otherwise(F.when(sim.isNotNull(), 0.0))


def substring_sim(a: Column, b: Column) -> Column:
    """Shorter length over longer if the shorter stands in the longer, in any case; else 0."""
    a, b = F.lower(a), F.lower(b)
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    ratio = F.coalesce(F.length(short) / F.nullif(F.length(long), F.lit(0)), F.lit(1.0))
    return F.when(F.contains(long, short), ratio).otherwise(F.when(long.isNotNull() & short.isNotNull(), 0.0))


def sparse_vector(text: Column) -> Column:
    """``i:v i:v`` as a map of int to double."""
    pairs = F.filter(F.split(text, "\\s+"), lambda p: F.contains(p, F.lit(":")))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, ":", 1).cast("int"), F.substring_index(p, ":", -1).cast("double"))))


def sparse_cosine(a: Column, b: Column, threshold: float = 0.4) -> Column:
    """Cosine of two maps, 0 unless above the threshold or where a norm is 0."""
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.element_at(a, k) * F.coalesce(F.try_element_at(b, k), F.lit(0.0)))
    sim = F.coalesce(dot / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))
    return F.when(sim > threshold, sim).otherwise(0.0)


def charset_sim(a: Column, b: Column) -> Column:
    """Jaccard of character sets: 0 under five characters or up to 0.5, 0.99 at most."""
    chars = lambda s: F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))
    sim = F.least(F.lit(0.99), array_jaccard(chars(a), chars(b)))
    return F.when((F.length(a) >= 5) & (F.length(b) >= 5) & (sim > 0.5), sim).otherwise(0.0)


def array_jaccard(a: Column, b: Column) -> Column:
    """Shared over all different elements; 0 for two empty arrays."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def ngram_jaccard(a: Column, b: Column, n: int, stopwords: list[str] | None = None) -> Column:
    """Jaccard of the n-grams of two token arrays without stopwords."""
    return array_jaccard(word_ngrams(filter_stopwords(a, stopwords), n), word_ngrams(filter_stopwords(b, stopwords), n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    return F.transform(a, lambda x: F.coalesce(x.cast("double") / F.nullif(norm2(a), F.lit(0.0)), x.cast("double")))


def cosine(a: Column, b: Column, missing: float = 0.0) -> Column:
    """Cosine; ``missing`` where a norm is 0 or a vector is null."""
    return F.coalesce(dot(a, b) / F.nullif(norm2(a) * norm2(b), F.lit(0.0)), F.lit(missing))


def cosine_nan(a: Column, b: Column) -> Column:
    """Cosine with -1 for what isn't a number."""
    return F.coalesce(F.nanvl(cosine(a, b, -1.0), F.lit(-1.0)), F.lit(-1.0))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def positive_cosine(a: Column, b: Column) -> Column:
    """Cosine in which products below 0 count as 0; 0 if a norm is 0."""
    above = F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(above / F.nullif(norm2(a) * norm2(b), F.lit(0.0)), F.lit(0.0))


def class_probabilities(a: Column, b: Column, weights: dict[str, tuple[list[float], list[float], float]]) -> Column:
    """A map of class to probability: logistic models over difference, its square and a base, renormalised."""
    unit = F.zip_with(normalise(a), normalise(b), lambda x, y: x - y)

    def raw(w: tuple[list[float], list[float], float]) -> Column:
        linear, square, base = w
        score = dot(unit, F.array(*map(F.lit, linear))) + dot(F.transform(unit, lambda x: x * x), F.array(*map(F.lit, square))) + base
        return 1 / (1 + F.exp(-score))

    total = sum((raw(w) for w in list(weights.values())[1:]), raw(next(iter(weights.values()))))
    return F.create_map(*(x for k, w in weights.items() for x in (F.lit(k), raw(w) / total)))


def entailment_probability(a: Column, b: Column, weights: dict[str, tuple[list[float], list[float], float]], classes: tuple[str, ...] = ("syn", "hyper", "mero")) -> Column:
    """Summed probability of the classes that entail."""
    p = class_probabilities(a, b, weights)
    return sum((F.coalesce(F.try_element_at(p, F.lit(c)), F.lit(0.0)) for c in classes[1:]), F.coalesce(F.try_element_at(p, F.lit(classes[0])), F.lit(0.0)))
