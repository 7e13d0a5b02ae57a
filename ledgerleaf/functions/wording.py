"""Labels and headings told by their words: texts as words in single spaces, met by phrases."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_words(c: Column) -> Column:
    """Lower-case words of letters and digits with one blank around each; apostrophes join what they part, other marks part words."""
    c = F.translate(F.lower(F.coalesce(c, F.lit(""))), "'‘’ʼ", "")
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def _forms(phrase: str) -> set[str]:
    """A phrase as printed: also with its last word in the plural, and two words run together."""
    words = phrase.split()
    out = {phrase, phrase + "s"}
    return out | {"".join(words)} if len(words) == 2 else out


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def begins(words: Column, phrases: Iterable[str]) -> Column:
    """The words begin with one of the phrases: their first words, as many as a phrase has, are looked up in the set of phrases of that length."""
    by: dict[int, set[str]] = {}
    for f in (f for p in phrases for f in _forms(p)):
        by.setdefault(len(f.split()), set()).add(f" {f}")
    return any_of(F.substring_index(words, " ", n + 1).isin(*sorted(fs)) for n, fs in sorted(by.items()))


def whole(words: Column, phrases: Iterable[str]) -> Column:
    """The words are one of the phrases."""
    return words.isin(*[f" {f} " for p in phrases for f in sorted(_forms(p))])


def holds(words: Column, phrases: Iterable[str]) -> Column:
    """One of the phrases stands somewhere in the words."""
    return any_of(F.contains(words, F.lit(f" {f} ")) for p in phrases for f in sorted(_forms(p)))


def only(words: Column, allowed: Iterable[str], one_of: Iterable[str]) -> Column:
    """All words are of ``allowed``, and the first is of ``one_of``."""
    each = F.split(F.btrim(words), " ")
    return (F.size(F.array_except(each, F.array(*map(F.lit, allowed)))) == 0) & F.get(each, 0).isin(*one_of)
