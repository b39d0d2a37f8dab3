"""Words of a batch of texts as places in its bytes, with array operations."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from tidewell.llm.common import mix64
from tidewell.llm.shingles import BASE, INVERSE, powers

#: A random number for each byte.
_BYTE = mix64(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_set(*signs: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(signs)] = True
    return out


SPACE = byte_set(*range(9, 14), *range(0x1C, 0x21))
#: White space and punctuation beyond ASCII, in UTF-8, by the first byte: the bytes behind it, and what stands for it.
_WIDE = {
    0xC2: [((0x85,), 10), ((0xA0,), 32), ((0xAB,), 34), ((0xBB,), 34), ((0xA1,), 33), ((0xBF,), 40)],
    0xE1: [((0x9A, 0x80), 32)],
    0xE2: [*(((0x80, k), 10 if k in (0xA8, 0xA9) else 32) for k in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), ((0x81, 0x9F), 32), ((0x80, 0xA6), 46), *(((0x80, k), 34) for k in (0x9C, 0x9D, 0x9E, 0x98, 0x99)), *(((0x80, k), 45) for k in (0x93, 0x94))],
    0xE3: [((0x80, 0x80), 32)],
}
#: Letters whose lower case has another length in UTF-8.
ODD = "".join(c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000)]) if len(c.lower().encode()) != len(c.encode()))
_ODD_LEADS = sorted({c.encode()[0] for c in ODD})
_EVEN = re.compile(f"[^{re.escape(ODD)}]+")


def plainer(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with all white space and punctuation as ASCII signs, in the same places."""
    out = data
    for lead, kinds in _WIDE.items():
        leads = np.flatnonzero(data[: len(data) - len(kinds[0][0])] == lead)
        for rest, sign in kinds if len(leads) else ():
            at = leads
            for k, byte in enumerate(rest, 1):
                at = at[data[at + k] == byte]
            if len(at):
                out = data.copy() if out is data else out
                out[at] = sign
                for k in range(1, len(rest) + 1):
                    out[at + k] = sign if SPACE[sign] else 0
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes in lower case, in the same places; the few letters whose lower case is longer or shorter stay."""
    text = data.tobytes().decode("utf-8", "surrogateescape")
    there = np.bincount(data, minlength=256) > 0
    if there[_ODD_LEADS].any() and any(c in text for c in ODD):
        raw = _EVEN.sub(lambda m: m.group().lower(), text)
    else:
        raw = text.lower()
    return np.frombuffer(raw.encode("utf-8", "surrogateescape"), np.uint8)


def shrunk(data: np.ndarray, kind: np.ndarray, at: np.ndarray, stop: np.ndarray, step: int) -> np.ndarray:
    """Places moved by step over signs of a kind, as far as stop."""
    at = at.copy()
    some = np.flatnonzero(at != stop)
    for _ in range(16):
        some = some[kind[data[at[some]]]]
        at[some] += step
        some = some[at[some] != stop[some]]
        if not len(some):
            return at
    # long runs: the nearest other sign of every place
    place = np.arange(len(data))
    if step < 0:
        near = np.maximum.accumulate(np.where(kind[data], -1, place))
        at[some] = np.maximum(near[at[some]], stop[some])
    else:
        near = np.minimum.accumulate(np.where(kind[data], len(data), place)[::-1])[::-1]
        at[some] = np.minimum(near[at[some]], stop[some])
    return at


class Hashes:
    """Hashes of any runs of the bytes, from sums over all of them."""

    def __init__(self, data: np.ndarray):
        self.size = 1 << max(16, int(len(data)).bit_length())
        with np.errstate(over="ignore"):
            self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers(BASE, self.size)[: len(data)], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.total[end] - self.total[start]) * powers(INVERSE, self.size)[start] + (end - start).astype(np.uint64))


def hashes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of the words at these places."""
    return Hashes(data)(start, end)


def cut(texts: pa.Array, plain: bool = True) -> tuple[np.ndarray, ...]:
    """The bytes of all texts, as `plainer` has them (or, if not plain, as they are, with the places of texts); where words start and end; and the first word
    of each text, with all words' number behind."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data = plainer(data) if plain else data
    inside = ~SPACE[data]
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | breaks[1:-1]
    closes[:-1] &= ~inside[1:] | breaks[1:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, offsets)
    return (data, start, end, first) if plain else (data, offsets, start, end, first)


class Table:
    """Numbers by hash: of those given, and 0 for all others."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray):
        self.bits = max(8, int(16 * len(hashes)).bit_length())
        self.known, self.numbers = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int64)
        for h, n in zip(hashes, numbers.tolist()):
            at = int(h >> np.uint64(64 - self.bits))
            while self.known[at]:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.known[at], self.numbers[at] = h, n

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(hashes), np.int64), (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            there = self.known[at[left]]
            same = there == hashes[left]
            out[left[same]] = self.numbers[at[left[same]]]
            left = left[~same & (there != 0)]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        return out


def hash_of(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode("utf-8", "surrogatepass"), np.uint8)
    return hashes_of(raw, np.array([0]), np.array([len(raw)]))[0]
