"""Word shingles of whole texts as hashes, with array operations over the bytes of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidewell.llm.common import mix64

BASE = 0xB5AD4ECEDA1CE2A9
INVERSE = pow(BASE, -1, 1 << 64)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(9, 14)]] = True
#: A random number for each byte, the same for A-Z as for a-z.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, size: int) -> np.ndarray:
    """1, base, base**2 and so on, modulo 2**64; kept as far as they have been needed."""
    if len(_POWERS.get(base, ())) < size:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:size]


def word_hashes(data: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte's place of every word of a run of UTF-8 bytes, A-Z as a-z. starts: places where a word can't go on."""
    inside = ~SPACES[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    if starts is not None:
        at = starts[(starts > 0) & (starts < len(data))]
        opens[at] |= inside[at]
        closes[at - 1] |= inside[at - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    size = 1 << max(16, int(len(data)).bit_length())
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers(BASE, size)[: len(data)], dtype=np.uint64)])
        word = (total[end] - total[start]) * powers(INVERSE, size)[start]
        return mix64(word + (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), start


def _rolled(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row, at each place where they begin."""
    h = np.full(len(words) - k + 1, np.uint64(k))
    for j in range(k):
        h = h * np.uint64(0x9FB21C651E98DF25) + words[j : len(words) - k + 1 + j]
    return mix64(h)


def shingle_sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its n-word shingles; with fewer words, of the whole sequence; empty without words."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if not len(texts):
        return []
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    out = []
    with np.errstate(over="ignore"):
        words, start = word_hashes(data, offsets)
        first = np.searchsorted(start, offsets)
        every = _rolled(words, n) if len(words) >= n else np.zeros(0, np.uint64)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= n:
                h = np.sort(every[a : b - n + 1])
                keep = np.empty(len(h), bool)
                keep[0] = True
                np.not_equal(h[1:], h[:-1], out=keep[1:])
                out.append(h[keep])
            else:
                out.append(_rolled(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out
