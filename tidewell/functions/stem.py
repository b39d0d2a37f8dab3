"""Light stemming for English, German and Russian by suffix rules over folded words; other languages keep the word.

A rule takes the longest ending that leaves enough of the word; rules of a language apply one after the other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tidewell.conf import DEFAULT, EngineConf
from tidewell.functions.text import fold, tokens, tokens_col

_RULES: dict[str, tuple[tuple[int, str], ...]] = {
    "en": ((3, "ational ization fulness ousness iveness"), (3, "ingly edly ement ments ness ance ence able ible"), (3, "ing ed es s ly er"), (2, "e y")),
    "de": ((4, "heiten keiten ungen lichen"), (4, "heit keit lich ung isch"), (3, "ern em en er es"), (3, "e n s t")),
    "ru": ((3, "ившись ывшись вшись"), (3, "иями ями ами ией иям ием иях ого его ому ему ыми ими"), (2, "ая яя ое ее ые ие ый ий ой ей ам ям ах ях ом ем ов ев ть"), (2, "а я о е ы и у ю ь й")),
}


def _pattern(least: int, endings: str) -> str:
    # the longest ending is tried first, as alternatives are in order
    ordered = sorted(endings.split(), key=len, reverse=True)
    return f"^(.{{{least},}}?)(?:{'|'.join(ordered)})$"


def stem(word: str, language: str) -> str:
    import re

    word = fold(word)
    for least, endings in _RULES.get((language or "").lower(), ()):
        word = re.sub(_pattern(least, endings), r"\1", word)
    return word


def _rule(least: int, endings: str):
    """A word after one rule; one without any of the endings isn't searched for them."""

    def apply(word: Column) -> Column:
        ends = reduce(lambda a, b: a | b, [F.endswith(word, F.lit(e)) for e in endings.split()])
        return F.when(ends, F.regexp_replace(word, _pattern(least, endings), "$1")).otherwise(word)

    return apply


def stemmed(words: Column, language: str) -> Column:
    """stem() of each of an array's folded words: rule by rule, so that a word is a variable in each."""
    for rule in _RULES.get(language, ()):
        words = F.transform(words, _rule(*rule))
    return words


def stems_col(text: Column, language: Column, conf: EngineConf = DEFAULT) -> Column:
    """The distinct stems of a text's tokens by its row's language; of languages without rules, or by the fallback's."""
    words = F.array_distinct(tokens_col(text))
    out: Column | None = None
    for name in (n for n in _RULES if n in conf.stemmed_languages):
        these = stemmed(words, name)
        out = F.when(F.lower(language) == name, these) if out is None else out.when(F.lower(language) == name, these)
    rest = stemmed(words, conf.fallback_language)
    return F.array_distinct(rest if out is None else out.otherwise(rest))


def stem_groups(groups: tuple[tuple[str, ...], ...], language: str, conf: EngineConf = DEFAULT) -> list[list[str]]:
    """Of each group its terms' stems; a term of several words stands for its words together and has none."""
    name = language.lower() if language.lower() in conf.stemmed_languages else conf.fallback_language
    return [[stem(t, name) for t in g if len(tokens(t)) == 1] for g in groups]


def matches_stems(stems: Column, groups: tuple[tuple[str, ...], ...], language: str, conf: EngineConf = DEFAULT) -> Column:
    """Every group has a member whose stem the text has."""
    out = F.lit(True)
    for own in stem_groups(groups, language, conf):
        out = out & (F.arrays_overlap(stems, F.array(*map(F.lit, own))) if own else F.lit(False))
    return out
