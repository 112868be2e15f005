"""Normalization, tokens, n-grams and keyword rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V


def clean(c: Column) -> Column:
    """Missing text as empty, outer whitespace removed."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def tokenize(c: Column) -> Column:
    """Support text from any channel as lower-case words.

    Words are taken out, not what lies between them replaced, which costs twenty times as much.
    """
    t = F.coalesce(c, F.lit(""))
    for pattern, with_ in ((V.URL, " "), (V.HANDLE, " "), (V.HASHTAG, " $1 "), (V.EMOJI, " "), (V.MASK, " ")):
        t = F.regexp_replace(t, pattern, with_)
    t = F.regexp_replace(F.lower(t), V.QUOTES, "'")
    t = F.replace(t, F.lit("&amp;"), F.lit(" and "))
    t = F.regexp_replace(t, V.REPEATS, "$1$1")
    return F.regexp_extract_all(t, F.lit("[a-z0-9']+"), F.lit(0))


def normalize_text(c: Column) -> Column:
    """The words of ``tokenize``, joined by one space."""
    return F.array_join(tokenize(c), " ")


def words_of(normalized: Column) -> Column:
    """Tokens of an already normalized text."""
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def unique_terms(c: Column) -> Column:
    return F.array_distinct(tokenize(c))


def plain_tokens(c: Column) -> Column:
    """Letter and digit runs of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def expand_colloquial(c: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in V.COLLOQUIAL.items() for x in kv])
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    bare = r"""^['".,!?]+|['".,!?]+$"""
    return F.array_join(
        F.transform(parts, lambda w: F.coalesce(mapping[F.regexp_replace(F.lower(w), bare, "")], w)), " ")


# -- n-grams ----------------------------------------------------------------
#
# Built by zipping shifted slices: the token array is never referenced inside
# a lambda, where it would be evaluated again for every element.


def word_ngrams(tokens: Column, n: int) -> Column:
    """Distinct word n-grams, joined by one space."""
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    shifted = [F.slice(tokens, i + 1, count) for i in range(n)]
    return F.array_distinct(reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat_ws(" ", x, y)), shifted))


def char_ngrams(tokens: Column, n: int = 3, min_length: int = 5) -> Column:
    """Distinct character n-grams of the longer tokens."""
    longer = F.filter(tokens, lambda t: F.length(t) >= min_length)
    grams = F.transform(
        longer, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substr(t, i, F.lit(n))))
    return F.array_distinct(F.flatten(grams))


# -- keyword rules ----------------------------------------------------------


def contains_any(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms])


def count_hits(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(t).cast("int") for t in terms])


def tone_of(agent_text: Column) -> Column:
    t = normalize_text(agent_text)
    return F.when(contains_any(t, V.TONE_EMPATHETIC), "empathetic").when(
        contains_any(t, V.TONE_PROFESSIONAL), "professional").otherwise("friendly")


def section_of(text: Column) -> Column:
    t = normalize_text(text)
    out = None
    for name, terms in V.SECTION_TERMS:
        cond = contains_any(t, terms)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("general")


def role_of(role: Column, inbound: Column | None = None) -> Column:
    """Speaker role; without one the inbound flag decides, else user."""
    r = F.lower(clean(role))
    named = F.when(r != "", F.when(contains_any(r, V.ASSISTANT_ROLES), "assistant").otherwise("user"))
    if inbound is None:
        return F.coalesce(named, F.lit("user"))
    return F.coalesce(named, F.when(~inbound, "assistant"), F.lit("user"))


def parse_bool(raw: Column) -> Column:
    t = F.lower(clean(raw))
    return F.when(t.isin("true", "1", "yes"), F.lit(True)).when(t.isin("false", "0", "no"), F.lit(False))


def tags_of(text: Column, vocabulary: list[str]) -> Column:
    """Sorted tags among the tokens of ``text``."""
    return F.array_sort(F.array_intersect(F.array(*[F.lit(t) for t in sorted(vocabulary)]), tokenize(text)))


def category_section(category: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in V.CATEGORY_SECTIONS.items() for x in kv])
    return F.coalesce(mapping[F.trim(F.upper(category))], F.lit("general"))


def intent_tone(intent: Column, flags: Column) -> Column:
    f = F.coalesce(flags, F.lit(""))
    return (
        F.when(f.contains("W"), "empathetic").when(f.contains("P"), "professional").when(f.contains("Q"), "friendly")
        .when(F.lower(intent).isin("complaint", "review"), "empathetic").otherwise("professional"))


# -- trimming ---------------------------------------------------------------


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def trim_to(c: Column, limit: int) -> Column:
    """One-line text of at most ``limit`` characters, dots marking a cut."""
    t = squeeze(c)
    return F.when(F.length(t) <= limit, t).otherwise(
        F.concat(F.rtrim(F.substring(t, 1, max(0, limit - 3))), F.lit("...")))
