"""Text: folding, tokens, transliteration, dictionaries, query normalisation.

The driver's functions define the meaning; the column functions say the same in Catalyst expressions.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column, functions as F

from tidewell.conf import DEFAULT, EngineConf, imported
from tidewell.model import Words

TOKEN = re.compile(r"[^\W_]+(?:[-/][^\W_]+)*")
CYRILLIC = ("Ѐ", "ӿ")


def fold(text: str | None) -> str:
    """Case and Latin accents away; Cyrillic letters keep theirs, but ё is е."""
    composed = unicodedata.normalize("NFC", (text or "").casefold()).replace("ё", "е")
    kept, cyrillic = [], False
    for c in unicodedata.normalize("NFD", composed):
        if not unicodedata.combining(c):
            cyrillic = CYRILLIC[0] <= c <= CYRILLIC[1]
        elif not cyrillic:
            continue
        kept.append(c)
    return unicodedata.normalize("NFC", "".join(kept))


def tokens(text: str | None) -> list[str]:
    return [fold(t) for t in TOKEN.findall(text or "")]


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    one, many = {}, []
    for code in (*range(0xAA, 0x590), *range(0x1E00, 0x2000), *range(0x2C60, 0x2C80), *range(0xA720, 0xA800), *range(0xFB00, 0xFB07)):
        c = chr(code)
        if unicodedata.combining(c):
            continue
        to = fold(c)
        if to != c:
            if len(to) == 1:
                one[c] = to
            else:
                many.append((c, to))
    return "".join(one), "".join(one.values()), tuple(many)


#: Signs that fold to several and do occur; the rest of them are left to fold().
_WIDE = "ßﬀﬁﬂﬃﬄﬅﬆ"


#: TOKEN for Java; no character ends two of its parts, so that nothing is tried twice.
_TOKEN = "(?U)[\\w&&[^_]]++(?:[-/][\\w&&[^_]]++)*+"


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _signs(text: Column) -> Column:
    """fold_col() but for marks: each character by itself."""
    source, target, many = _fold_tables()
    out = F.translate(F.lower(text), source, target)
    for c, to in many:
        if c in _WIDE:
            out = F.replace(out, F.lit(c), F.lit(to))
    return out


def fold_col(text: Column) -> Column:
    """fold() inside whole-stage codegen; composed input is assumed for Cyrillic letters with marks."""
    text = F.coalesce(text, F.lit(""))
    return F.when(_ascii(text), F.lower(text)).otherwise(F.regexp_replace(_signs(text), "(?<![Ѐ-ӿ\\p{Mn}])\\p{Mn}+", ""))


def tokens_col(text: Column) -> Column:
    """tokens(). Where no mark is (İ becomes one) and nothing that Java doesn't know, folding takes each character by itself and letters to letters,
    so that the whole text can be folded before it is cut; else token by token."""
    text = F.coalesce(text, F.lit(""))
    cut = lambda t: F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(0))
    return F.when(_ascii(text), cut(F.lower(text))).when(~text.rlike("[\\p{Mn}\\p{Cn}İ]"), cut(_signs(text))).otherwise(F.transform(cut(text), fold_col))


def _pairs(line: str) -> list[tuple[str, str]]:
    found = [p.partition("=")[::2] for p in line.split()]
    return sorted(found, key=lambda p: -len(p[0]))


TO_LATIN = _pairs("а=a б=b в=v г=g д=d е=e ё=e ж=zh з=z и=i й=y к=k л=l м=m н=n о=o п=p р=r с=s т=t у=u ф=f х=h ц=ts ч=ch ш=sh щ=shch ъ= ы=y ь= э=e ю=yu я=ya")
TO_CYRILLIC = _pairs("a=а b=б c=к d=д e=е f=ф g=г h=х i=и j=дж k=к l=л m=м n=н o=о p=п q=к r=р s=с t=т u=у v=в w=в x=кс y=й z=з sh=ш ch=ч ts=ц zh=ж yu=ю ya=я ph=ф th=т ck=к kh=х ee=и oo=у sch=щ shch=щ")


def transliterate(term: str) -> str | None:
    """In the other script, longest matches first; None for mixed or other scripts."""
    term = fold(term)
    latin, cyrillic = bool(re.search("[A-Za-z]", term)), any(CYRILLIC[0] <= c <= CYRILLIC[1] for c in term)
    if latin == cyrillic:
        return None
    table, out, at = TO_CYRILLIC if latin else TO_LATIN, "", 0
    while at < len(term):
        hit = next((p for p in table if term.startswith(p[0], at)), (term[at], term[at]))
        out, at = out + hit[1], at + len(hit[0])
    return out or None


@dataclass(frozen=True)
class Dictionary:
    """Symmetric synonym groups, query rewrites and stop words of one language."""

    language: str = ""
    groups: tuple[tuple[str, ...], ...] = ()
    rewrites: dict[str, str] = field(default_factory=dict)
    stopwords: frozenset[str] = frozenset()
    version: int = 0

    def group(self, term: str) -> tuple[str, ...]:
        for g in reversed(self.groups):
            if term in g:
                return (term, *(m for m in g if m != term))
        return (term,)


#: group members by =, groups by ;
_SHIPPED = {
    "en": (1, "iphone=i-phone;second-hand=secondhand=used=pre-owned;laptop=notebook;tv=television", "", "cheap sale selling urgent wanted"),
    "ru": (
        1,
        "samsung=самсунг;iphone=айфон=айфоне=ифон;xiaomi=ксиаоми=сяоми;macbook=макбук;huawei=хуавей;playstation=плойка=плейстейшн;бу=б/у=бэушный=бывший в употреблении;laptop=лэптоп=ноут=ноутбук;смартфон=телефон;холодос=холодильник;авто=автомобиль=машина",
        "квартира-студия>студия;микроволновка>микроволновая печь;посудомойка>посудомоечная машина;стиралка>стиральная машина",
        "дешево куплю недорого новый продаю продам продается срочно торг",
    ),
}


def _entries(given: object) -> dict:
    """A dictionary's entries: a mapping, a JSON file, or the dotted path of a mapping or of what returns one."""
    import json
    import os

    if isinstance(given, str):
        if os.path.exists(given):
            with open(given, encoding="utf-8") as f:
                given = json.load(f)
        else:
            given = imported(given)
            given = given() if callable(given) else given
    if not isinstance(given, dict):
        raise TypeError(f"no dictionary: {type(given).__name__}")
    return given


def dictionary(language: str, conf: EngineConf = DEFAULT) -> Dictionary:
    """Shipped entries, overlaid in turn by those of conf.dictionaries[language]: groups and stop words join, rewrites replace, the version is the largest."""
    language = (language or "").lower()
    version, groups, rewrites, stops = _SHIPPED.get(language, (0, "", "", ""))
    found = [tuple(g.split("=")) for g in groups.split(";") if g]
    changes = dict(r.split(">") for r in rewrites.split(";") if r)
    dropped = set(stops.split())
    given = conf.dictionaries.get(language, ())
    for extra in map(_entries, given if isinstance(given, (list, tuple)) else [given]):
        found += [tuple(g) for g in extra.get("equivalents", ())]
        changes |= extra.get("rewrites", {})
        dropped |= set(extra.get("stopwords", ()))
        version = max(version, int(extra.get("version", 0)))
    folded = tuple(g for g in (tuple(dict.fromkeys(map(fold, g))) for g in found) if len(g) > 1)
    return Dictionary(language, folded, {fold(k): fold(v) for k, v in changes.items()}, frozenset(map(fold, dropped)), version)


def lint(d: Dictionary, conf: EngineConf = DEFAULT) -> list[str]:
    """Findings: a term in two groups, too long terms, stop words in groups, rewrite cycles and rewrites that never apply."""
    seen: dict[str, int] = {}
    out = []
    for k, g in enumerate(d.groups):
        for term in g:
            if term in seen:
                out.append(f"duplicate:{term}")
            seen[term] = k
            if len(term) > conf.max_query_chars:
                out.append(f"too_long:{term[:20]}")
            if term in d.stopwords:
                out.append(f"stopword_in_group:{term}")
    for start in d.rewrites:
        at, hops = start, 0
        while at in d.rewrites and hops <= 10:
            at, hops = d.rewrites[at], hops + 1
        if hops > 10:
            out.append(f"rewrite_cycle:{start}")
        if start in d.stopwords or len(tokens(start)) != 1:
            out.append(f"dead_rewrite:{start}")
    return out


def normalize_query(text: str, language: str = "", conf: EngineConf = DEFAULT) -> Words:
    """fold, tokens, rewrites, stop words, synonyms or else transliteration, and the budget of terms, in this order."""
    d = dictionary(language, conf)
    words = [w for t in tokens(text) for w in (tokens(d.rewrites[t]) if t in d.rewrites else [t])]
    dropped = tuple(w for w in words if w in d.stopwords)
    groups, used, cut = [], 0, False
    for word in words:
        if word in d.stopwords:
            continue
        group = d.group(word)
        if len(group) == 1 and d.language in conf.transliterate and (other := transliterate(word)) and other != word:
            group = (word, other)
        if used + len(group) > conf.max_query_terms:
            group, cut = group[: conf.max_query_terms - used], True
        if group:
            groups.append(group)
            used += len(group)
        if cut:
            break
    return Words(tuple(groups), text, d.language, dropped, d.version, cut)


def contains_group(text: Column, group: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for term in group:
        out = out | F.contains(text, F.lit(term))
    return out


def trigrams(word: str) -> list[str]:
    padded = f"  {word} "
    return sorted({padded[k : k + 3] for k in range(len(padded) - 2)})


def trigrams_col(word: Column) -> Column:
    padded = F.concat(F.lit("  "), word, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3)))


def word_similarity(text_tokens: Column, word: str) -> Column:
    """Largest share of the word's trigrams that one token has: containment, word by word."""
    own = trigrams(word)
    shares = F.transform(text_tokens, lambda t: F.size(F.array_intersect(trigrams_col(t), F.array(*map(F.lit, own)))) / F.lit(len(own)))
    return F.coalesce(F.array_max(shares), F.lit(0.0))
