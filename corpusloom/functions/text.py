"""Text functions on columns. A null gives a null unless said otherwise."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F


def _replace(text: Column, *pairs: tuple[str, str]) -> Column:
    return functools.reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def words(text: Column) -> Column:
    """What white space parts; an empty array for a text without words."""
    return F.filter(F.split(text, "\\s+"), lambda w: w != "")


def tokenize_simple(text: Column) -> Column:
    """Periods, commas and the endings n't and 's stand alone."""
    return words(_replace(text, (".", " . "), (",", " , "), ("n't", " n't"), ("'s", " 's")))


def tokenize_punct(text: Column) -> Column:
    """Each mark of ``?!()";|[].,'`` stands alone."""
    return words(F.regexp_replace(text, "([?!()\";|\\[\\].,'])", " $1 "))


#: Rules of each language in the order they apply: pattern, replacement.
LANGUAGE_RULES: dict[str, list[tuple[str, str]]] = {
    "en": [("([a-z])n't\\b", "$1 n't"), ("'(s|re|ve|ll|d|m)\\b", " '$1"), ("([.,;:!?()\"])", " $1 ")],
    "fr": [("\\b([cdjlmnst]|qu)'", "$1' "), ("-(je|tu|il|elle|nous|vous|ils|elles|on|ce)\\b", " -$1"), ("([.,;:!?()\"])", " $1 ")],
    "de": [("([.,;:!?()\"])", " $1 ")],
    "es": [("([¿¡])", "$1 "), ("([.,;:!?()\"])", " $1 ")],
}


def tokenize_language(language: Column, text: Column, rules: dict[str, list[tuple[str, str]]] | None = None) -> Column:
    """Tokens by the rewrite rules of the row's language; English rules for others."""
    rules = rules or LANGUAGE_RULES
    rewrite = lambda name: functools.reduce(lambda t, r: F.regexp_replace(t, *r), rules[name], text)
    chain = functools.reduce(lambda c, name: c.when(language == name, rewrite(name)), [n for n in rules if n != "en"], F.when(language == "en", rewrite("en")))
    return words(chain.otherwise(rewrite("en")))


#: A short list of English function words; callers pass their own for real work.
STOPWORDS = "a about all also an and any are as at be been but by can do for from had has have he her his i if in into is it its may more most not of on one or other our she so some such that the their them then there these they this to up was we were what when which who will with would you your".split()


def filter_stopwords(tokens: Column, stopwords: list[str] | None = None) -> Column:
    """Tokens that are no stopwords, in order, repeats kept."""
    return F.filter(tokens, lambda t: ~F.lower(t).isin(*(stopwords or STOPWORDS)))


def clean_query(tokens: Column, ignored: list[str]) -> Column:
    """Different tokens of two or more letters that aren't ignored."""
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(*ignored) if ignored else F.length(t) > 1))


def word_pos_index(token: Column) -> Column:
    """``word-pos-i`` as a struct; hyphens before the last two belong to the word. Nulls where it doesn't fit."""
    pattern = "^(.*)-([^-]*)-(\\d+)$"
    fits = token.rlike(pattern)
    part = lambda i: F.when(fits, F.regexp_extract(token, pattern, i))
    return F.struct(part(1).alias("word"), part(2).alias("pos"), part(3).cast("int").alias("index"))


def clean_name(text: Column) -> Column:
    """Quotes become spaces, other characters than letters, digits, space and underscore ``_``."""
    return F.regexp_replace(F.regexp_replace(text, "['\"]", " "), "[^A-Za-z0-9_ ]", "_")


def strip_transparent_nouns(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, "\\b(?:group|slice|piece|can) of\\b", " "))


def contains_phrase(sentence: Column, phrase: Column) -> Column:
    """Whether the phrase's tokens stand in the sentence as a whole run."""
    fenced = lambda c: F.concat(F.lit("#"), F.array_join(words(c), "#"), F.lit("#"))
    return F.contains(fenced(sentence), fenced(phrase))


def is_intelligible(text: Column) -> Column:
    """ASCII only and three or more tokens."""
    return text.rlike("^[\\x00-\\x7F]*$") & (F.size(words(text)) >= 3)


def word_ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by a space; empty for shorter arrays.

    The array grows by its own shifted form, as a function of places would work it out once for each of them.
    """
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    runs = F.transform(F.slice(tokens, F.lit(1), count), lambda t: F.array(t))
    for i in range(2, n + 1):
        runs = F.zip_with(runs, F.slice(tokens, F.lit(i), count), lambda run, t: F.concat(run, F.array(t)))
    return F.when(tokens.isNotNull(), F.transform(runs, lambda run: F.array_join(run, " ")))


def char_trigrams(word: Column, compat: bool = False) -> Column:
    """Trigrams with a growing start: the first two characters, the first three, then by one.

    ``compat`` keeps the repeat that words of fewer than three characters give.
    """
    ends = F.sequence(F.lit(2), F.greatest(F.lit(3), F.length(word)))
    grams = F.transform(ends, lambda e: F.substr(word, F.greatest(F.lit(1), e - 2), F.least(F.lit(3), e)))
    return grams if compat else F.array_distinct(grams)


def affixes(word: Column, longest: int = 4, compat: bool = False) -> Column:
    """A struct of prefixes and suffixes of 1 to ``longest`` characters; ``compat`` reverses suffixes."""
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.length(word)))
    suffix = lambda n: F.substr(word, F.length(word) - n + 1, n)
    some = F.length(word) > 0
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(some, F.transform(sizes, lambda n: F.substr(word, F.lit(1), n))).otherwise(none).alias("prefixes"),
        F.when(some, F.transform(sizes, lambda n: F.reverse(suffix(n)) if compat else suffix(n))).otherwise(none).alias("suffixes"),
    )


def shape(word: Column) -> Column:
    """Whether a word has an upper-case letter, a hyphen, a digit."""
    return F.struct(word.rlike("[A-Z]").alias("upper"), F.contains(word, F.lit("-")).alias("hyphen"), word.rlike("[0-9]").alias("digit"))


def unescape_backslash(text: Column) -> Column:
    return F.regexp_replace(text, "\\\\(.)", "$1")


def expand_annotations(tokens: Column) -> Column:
    """``word|tag`` tokens as structs; the tag is O where none is given, ``@`` words are placeholders."""

    def one(t: Column) -> Column:
        word = F.substring_index(t, "|", 1)
        return F.struct(word.alias("word"), F.when(F.contains(t, F.lit("|")), F.substring_index(t, "|", -1)).otherwise("O").alias("tag"), F.startswith(word, F.lit("@")).alias("placeholder"))

    return F.transform(tokens, one)


def polarity_signature(signature: Column) -> Column:
    """Signatures such as ``+/-``: implication signs in positive and negative environments; nulls where malformed."""
    pattern = "^([+-]|o)/([+-]|o)$"
    fits = signature.rlike(pattern)
    return F.struct(*(F.when(fits, F.regexp_extract(signature, pattern, i)).alias(n) for i, n in ((1, "positive"), (2, "negative"))))
