"""Benchmark decontamination by canonical templates.

Words stand between any white space, and are lower-cased and stripped of punctuation; the end of a line is an end of a
sentence, no more. Numbers (digits, with signs, separators or a unit attached, and number words), names (capitalised inside
a sentence, among words that mostly aren't) and units become typed placeholders, whose words are kept as slots. A capital
that begins a sentence may be a name or not, so that there are three readings of a text: without such names, with them, and
the plain words. Windows of `width` words of every benchmark item are hashed into a table in all readings, and every window
of every document is looked up in it, in all readings. Matches of one item at one offset form an alignment; it counts if it
covers min(item, `least`) words of the item, enough of them not placeholders (or in windows copied word by word), and if its
slots agree: one value of the item always stands for one of the document. Where they don't, windows copied word by word are
judged alone. Alignments at neighbouring offsets count together as well. Equal slots: exact; else the question is
re-parameterised.

A batch of texts is read at once, as arrays over its bytes and words; only words with digits and windows that an item has are
looked at one by one. The benchmark is taken in blocks of bounded size, each of them broadcast and held against all documents.

Null or empty text, documents or items: no windows, no match. Items shorter than a window are one window; items of fewer
than 4 words must be a whole sentence or line of the document, word by word, as they stand in any text by chance. Repeated
items, equal ids: the best alignment of each id. Documents without id are matched all the same. Several copies in one
document: the best one is reported. Empty tables: an empty result. Texts are read whole. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from tidewell.llm.common import slices
from tidewell.llm.shingles import BASE, INVERSE, powers
from tidewell.llm.words import Table, byte_set, cut, hash_of, hashes_of, lowered, shrunk

WIDTH, LEAST, LITERAL = 8, 13, 6
#: Items of fewer words are looked for as whole sentences.
SHORT = 4
#: Alignments of an item whose offsets differ by so many words at most are one copy with words put in or left out.
SHIFT = 4
BLOCK_BYTES = 16 << 20
#: Bytes of texts that are read at once: so many that their arrays fit in a cache.
SLICE = 1 << 19
WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3
_NUMBER = re.compile(r"[+\-±$€£#]*\d[\d.,:/]*(?:%|°|[a-zµ]{1,3})?")
#: English, German, French, Spanish; words that are articles or anything else more often are left out.
_NUMBER_WORDS = set(
    """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
    null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend million millionen
    deux trois quatre cinq sept huit dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent cents mille millions
    dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince dieciséis veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil millón millones""".split()
)
_UNITS = set(
    """kg g mg km m cm mm l ml s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars cent euro euros pound pounds mile miles foot feet inch inches
    meter meters metre metres kilometer kilometers gram grams kilogram kilograms liter liters litre litres percent degree degrees mph kmh watt watts volt volts hz
    sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad gramm kilogramm kilometern
    seconde secondes heure heures jour jours semaine semaines mois année années kilomètre kilomètres mètre mètres gramme grammes degré degrés
    segundo segundos minuto minutos hora horas día días semana semanas mes meses año años kilómetro kilómetros metro metros gramo gramos litro litros grado grados dólar dólares""".split()
)
_HASH = {NUMBER: np.uint64(0x1F3A5C7E9B2D4F61), UNIT: np.uint64(0x2E4B6D8FA1C3E507), NAME: np.uint64(0x3D5C7B9AF8E6D4C2)}
_DIGIT, _LINE = byte_set(*range(48, 58)), byte_set(10, 11, 12, 13, 0x1C, 0x1D, 0x1E)
#: What is stripped from words; 0 stands behind a quote or dash that was more than one byte.
_STRIP, _CLOSE, _END = byte_set(0, *b".,;:!?\"'()[]{}*_`-|"), byte_set(0, *b"\"')]"), byte_set(*b".!?:")


_LISTED = {w: NUMBER for w in _NUMBER_WORDS} | {w: UNIT for w in sorted({*_UNITS, "%", "°"} - _NUMBER_WORDS)}
_KINDS = Table(np.array([hash_of(w) for w in _LISTED], np.uint64), np.array(list(_LISTED.values())))


def kinds_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Numbers and units among words in lower case."""
    out = _KINDS(hashes).astype(np.uint8)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int32)])
    for k in np.flatnonzero(digits[end] > digits[start]).tolist():
        if _NUMBER.fullmatch(data[start[k] : end[k]].tobytes().decode("utf-8", "replace")):
            out[k] = NUMBER
    return out


@dataclass
class Reading:
    """The words of a batch of texts: where each text's begin (and, last, all end), their places in the bytes, whether they begin a sentence; kinds and hashes
    without and with names that begin a sentence, and hashes of the words themselves."""

    first: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    begins: np.ndarray
    kind: np.ndarray
    wide: np.ndarray
    hashes: tuple[np.ndarray, np.ndarray, np.ndarray]

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def read(texts: pa.Array) -> Reading:
    data, start, end, first = cut(texts)
    n = len(start)
    a = shrunk(data, _STRIP, start, end, 1)
    b = shrunk(data, _STRIP, end - 1, a - 1, -1) + 1
    last = shrunk(data, _CLOSE, end - 1, start - 1, -1)
    lower = lowered(data)
    keep = np.flatnonzero(a < b)
    ends, capital = np.zeros(n, bool), np.zeros(n, bool)
    own, hashed = np.zeros(len(keep), np.uint8), np.zeros(len(keep), np.uint64)
    if n:
        ends = (last >= start) & _END[data[last]]
        a, b = a[keep], b[keep]
        differs = lower[a] != data[a]
        # a letter of more bytes may differ in the later ones
        wide = np.flatnonzero(data[a] > 127)
        for k in (1, 2, 3):
            wide = wide[a[wide] + k < b[wide]]
            wide = wide[(data[a[wide] + k] & 0xC0) == 0x80]
            differs[wide] |= lower[a[wide] + k] != data[a[wide] + k]
        capital[keep] = differs
        hashed = hashes_of(lower, a, b)
        own = kinds_of(lower, a, b, hashed)
    lines = np.concatenate([[0], np.cumsum(_LINE[data], dtype=np.int32)])
    after_end = np.ones(n + 1, bool)
    if n:
        after_end[1:n] = ends[:-1] | (lines[start[1:]] != lines[start[:-1]])
    after_end[first] = True
    after_end = after_end[:n]
    # where most words around are capitalised, as in titles, capitals name nothing
    capitals, at, text = np.concatenate([[0], np.cumsum(capital, dtype=np.int32)]), keep, np.repeat(np.arange(len(texts)), np.diff(first))[keep]
    lo, hi = np.maximum(at - 4, first[:-1][text]), np.minimum(at + 5, first[1:][text])
    capital = capital[keep] & (own == WORD) & (2 * (capitals[hi] - capitals[lo]) <= hi - lo)
    sentence = np.cumsum(after_end, dtype=np.int32)[keep]
    begins = np.ones(len(keep), bool)
    begins[1:] = sentence[1:] != sentence[:-1]
    name = capital & ~after_end[keep]
    typed = np.where(own == NUMBER, _HASH[NUMBER], np.where(own == UNIT, _HASH[UNIT], hashed))
    kind, wide = np.where(name, NAME, own).astype(np.uint8), np.where(capital, NAME, own).astype(np.uint8)
    return Reading(np.searchsorted(keep, first), lower, a, b, begins, kind, wide, (np.where(name, _HASH[NAME], typed), np.where(capital, _HASH[NAME], typed), hashed))


class Windows:
    """Hashes of the windows of a batch's words, of any width, from sums over all of them."""

    def __init__(self, hashes: np.ndarray):
        size = 1 << max(16, int(len(hashes)).bit_length())
        self.back = powers(INVERSE, size)
        with np.errstate(over="ignore"):
            self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(BASE, size)[: len(hashes)], dtype=np.uint64)])

    def __call__(self, at: np.ndarray | slice, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            if isinstance(at, slice):
                return (self.total[at.start + width : at.stop + width] - self.total[at]) * self.back[at] + np.uint64(width)
            return (self.total[at + width] - self.total[at]) * self.back[at] + np.uint64(width)


@dataclass
class Match:
    item: int
    covered: int
    item_words: int
    matched: int
    slots: int
    exact: bool


class Matcher:
    """A block of benchmark items, and what of it stands in a batch of texts."""

    def __init__(self, items: Sequence[tuple[object, str | None]], width: int = WIDTH, least: int = LEAST, literal: int = LITERAL):
        self.most, self.least, self.literal = width, least, literal
        self.ids = [i for i, _ in items]
        r = read(pa.array([t or "" for _, t in items], pa.large_string()))
        bounds = [(int(a), int(b)) for a, b in zip(r.first[:-1], r.first[1:])]
        self.values = [[r.word(k) for k in range(a, b)] for a, b in bounds]
        self.kinds, self.wide = [r.kind[a:b] for a, b in bounds], [r.wide[a:b] for a, b in bounds]
        length = np.diff(r.first)
        wide = np.minimum(length, width)
        item = np.repeat(np.arange(len(items)), length)
        at = np.arange(len(item)) - r.first[:-1][item]
        found = []
        for w in sorted(set(wide[wide > 0].tolist())):
            here = np.flatnonzero((wide[item] == w) & (at + w <= length[item]))
            # windows of templates and of the words themselves: what is copied is found even where names are read otherwise
            for hashes in r.hashes if w >= SHORT else r.hashes[2:]:
                found.append((Windows(hashes)(here, w), item[here], at[here], np.full(len(here), w)))
        h, self.item, self.at, self.width = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*found) if found else [()] * 4))
        h = h.astype(np.uint64)
        order = np.lexsort((self.at, self.item, h))
        self.known, self.item, self.at, self.width = h[order], self.item[order], self.at[order], self.width[order]
        self.widths = sorted(set(self.width.tolist()))
        # about one bit in sixteen is set, at any size of the block
        self.shift = np.uint64(64 - max(16, int(16 * len(h)).bit_length()))
        self.bits = np.zeros(1 << (61 - int(self.shift)), np.uint8)
        places = self._place(h)
        np.bitwise_or.at(self.bits, (places >> np.uint64(3)).astype(np.int64), np.uint8(1) << (places & np.uint64(7)).astype(np.uint8))

    def _place(self, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def _hits(self, r: Reading) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the batch whose windows the table has, and from where to where it has them."""
        n = len(r.start)
        rest = np.repeat(r.first[1:], np.diff(r.first)) - np.arange(n)
        apart = [None, r.hashes[1] != r.hashes[0], (r.kind != WORD)]
        out = []
        for hashes, odd in zip(r.hashes, apart):
            if odd is not None:
                odd = np.concatenate([[0], np.cumsum(odd)])
            windows = Windows(hashes)
            for w in self.widths:
                if n < w or w < SHORT and hashes is not r.hashes[2] and odd is not None:
                    continue
                # readings that don't differ in a window are looked up once
                h = windows(slice(0, n - w + 1), w)
                place = self._place(h)
                hit = ((self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                if odd is not None:
                    hit &= odd[w:] != odd[: n - w + 1]
                at = np.flatnonzero(hit)
                at = at[rest[at] >= w]
                if len(at):
                    lo, hi = np.searchsorted(self.known, h[at]), np.searchsorted(self.known, h[at], "right")
                    some = lo < hi
                    out.append((at[some], lo[some], hi[some]))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def find_all(self, texts: pa.Array) -> list[list[Match]]:
        """The matches of each text."""
        r = read(texts)
        found: list[list[Match]] = [[] for _ in range(len(texts))]
        if not len(self.known) or not len(r.start):
            return found
        place, lo, hi = self._hits(r)
        by_text: dict[int, dict[tuple[int, int], set[int]]] = defaultdict(lambda: defaultdict(set))
        of = np.searchsorted(r.first, place, "right") - 1
        for text, p, i, j in zip(of.tolist(), place.tolist(), lo.tolist(), hi.tolist()):
            for k in range(i, j):
                item, at = int(self.item[k]), int(self.at[k])
                if len(self.values[item]) < SHORT:
                    end = p + len(self.values[item])
                    if not r.begins[p] or not (end == r.first[text + 1] or r.begins[end]) or r.begins[p + 1 : end].any():
                        continue
                by_text[text][item, p - at].add(at)
        for text, aligned in by_text.items():
            best: dict[object, Match] = {}
            for item, runs in self._runs(aligned):
                m = self._judge(item, r, runs)
                if m is None:
                    continue
                key = self.ids[item]
                if key not in best or (m.covered, m.matched, m.exact) > (best[key].covered, best[key].matched, best[key].exact):
                    best[key] = m
            found[text] = list(best.values())
        return found

    def find(self, text: str | None) -> list[Match]:
        return self.find_all(pa.array([text or ""], pa.large_string()))[0]

    def _runs(self, aligned: dict[tuple[int, int], set[int]]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Item and (place in it, offset) of windows to be judged together: those of each alignment, and those of neighbouring ones, as words put in or left out shift what follows."""
        by_item: dict[int, list[int]] = defaultdict(list)
        for item, offset in aligned:
            by_item[item].append(offset)
        for item, offsets in by_item.items():
            offsets.sort()
            for offset in offsets:
                yield item, [(at, offset) for at in sorted(aligned[item, offset])]
            group: list[int] = []
            for offset, after in zip(offsets, [*offsets[1:], None]):
                group.append(offset)
                if after is None or after - offset > SHIFT:
                    if len(group) > 1:
                        group.sort(key=lambda o: -len(aligned[item, o]))
                        yield item, [(at, o) for o in group for at in sorted(aligned[item, o])]
                    group = []

    def _judge(self, item: int, r: Reading, runs: list[tuple[int, int]]) -> Match | None:
        """runs: windows, the ones that count first where two cover a word."""
        own, narrow, wide = self.values[item], self.kinds[item], self.wide[item]
        width = min(self.most, len(own))
        copied = [(at, o) for at, o in runs if all(own[k] == r.word(k + o) for k in range(at, at + width))]
        same = {k for at, _ in copied for k in range(at, at + width)}
        # if the slots disagree, the windows that are copied word by word may still be enough
        for taken in (runs, copied):
            theirs: dict[int, bytes] = {}
            for at, o in taken:
                for k in range(at, at + width):
                    theirs.setdefault(k, r.word(k + o))
            literal = sum(k in same or narrow[k] == WORD and own[k] == v for k, v in theirs.items())
            if len(theirs) < min(len(own), self.least) or literal < min(self.literal, (len(theirs) + 1) // 2):
                continue
            slots = [(int(wide[k]), own[k], v) for k, v in theirs.items() if wide[k] != WORD and (narrow[k] != WORD or own[k] != v)]
            if len({(kind, a) for kind, a, _ in slots}) == len(set(slots)):
                return Match(item, len(theirs), len(own), len({at for at, _ in taken}), len(slots), all(a == b for _, a, b in slots))
        return None


_MATCHERS: dict[int, tuple[list, Matcher]] = {}


def _matcher(items: list[tuple[object, str | None]]) -> Matcher:
    """One for all tasks of a worker that hold the same block; the last two of them."""
    if id(items) not in _MATCHERS:
        while len(_MATCHERS) > 1:
            _MATCHERS.pop(next(iter(_MATCHERS)))
        # the block is kept with its matcher, so that no other gets its number
        _MATCHERS[id(items)] = items, Matcher(items)
    return _MATCHERS[id(items)][1]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about BLOCK_BYTES, by hash of the text."""
    items = benchmark.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).where("t <> ''").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = size // BLOCK_BYTES + 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k).collect()
        yield sorted(((r.i, r.t) for r in rows), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, item, covered, item_words, matched_windows, slots, kind for each document and item found in it. No shuffle of texts."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = f"id {kind}, item {item_kind}, covered long, item_words long, matched_windows long, slots long, kind string"
    out = None
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value)
            for b in slices(batches, 1, SLICE):
                rows = []
                for k, matches in enumerate(matcher.find_all(b.column(1))):
                    rows += [(b.column(0)[k].as_py(), matcher.ids[m.item], m.covered, m.item_words, m.matched, m.slots, "exact" if m.exact else "re-parameterised") for m in matches]
                if rows:
                    frame = dict(zip(("id", "item", "covered", "item_words", "matched_windows", "slots", "kind"), map(list, zip(*rows))))
                    yield pa.RecordBatch.from_arrays([pa.array(frame["id"], b.schema.field(0).type), *[pa.array(frame[c]) for c in list(frame)[1:]]], list(frame))

        found = picked.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    # copies of an item in two blocks: the best alignment of each id
    best = out.groupBy("id", "item").agg(F.max(F.struct("covered", "matched_windows", "item_words", "slots", "kind")).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "m.covered", "m.item_words", "m.matched_windows", "m.slots", "m.kind")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs' rows in which no item is found, in docs' columns; texts are judged where they are."""
    out = docs
    for block in _blocks(benchmark, item_col, item_text_col):
        clean = _clean(docs.sparkSession.sparkContext.broadcast(block))
        out = out.where(F.arrow_udf(clean, "boolean")(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return out


def _clean(block: Broadcast):
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = _matcher(block.value)
        for batch in texts:
            found = []
            for b in slices([pa.RecordBatch.from_arrays([batch], ["text"])], 0, SLICE):
                found += [not m for m in matcher.find_all(b.column(0))]
            yield pa.array(found, pa.bool_())

    return judge
