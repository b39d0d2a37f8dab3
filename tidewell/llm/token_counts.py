"""Token counts by rank-synchronous array merging.

A batch's distinct pre-tokens are held as one ragged pair of numpy arrays (symbols, sequence number).
In each round every unfinished sequence finds its lowest-ranked neighbouring pair and merges all places where
it stands, all sequences at once; what is left when no pair has a rank are the tokens. Symbols outside the
vocabulary count as their UTF-8 bytes. Counts of pre-tokens seen before are looked up.

Null and empty texts have 0 tokens. Ties in rank go to the left. Texts are processed whole, of any length.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewell.llm.common import slices

MARK = "▁"
NONE = np.int64(1) << 60
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffers message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0]
            at += n


class PieceModel:
    """A BPE piece model read from its bytes: pieces, ranks of pairs, and what its normaliser does."""

    def __init__(self, data: bytes):
        pieces: list[tuple[str, float, int]] = []
        spec: dict[int, object] = {}
        trainer: dict[int, object] = {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((bytes(f[1]).decode("utf-8"), float(f.get(2, 0.0)), int(f.get(3, NORMAL))))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                spec = dict(_fields(value))
        kinds = {k for _, _, k in pieces}
        if trainer.get(3, 1) != 2 or spec.get(2) or not spec.get(3, 1) or spec.get(4, 1) or USER in kinds or UNUSED in kinds or not trainer.get(35):
            raise ValueError("only BPE models with byte fallback, an identity normaliser and a leading space are supported")
        usable = {p: s for p, s, k in pieces if k == NORMAL}
        self.runs = max((len(p) for p in usable if set(p) == {MARK}), default=1)
        if any(MARK in p.lstrip(MARK) or p.startswith(MARK * 2) and p.strip(MARK) for p in usable):
            raise ValueError("pieces that join words are not supported")
        spaces = {len(p): usable[p] for p in usable if set(p) == {MARK} and len(p) > 1}
        if len(set(spaces.values())) > 1 or spaces and max(spaces.values()) >= min(s for p, s in usable.items() if set(p) != {MARK}):
            raise ValueError("runs of spaces must merge last, with equal scores")
        self.run_tokens = [self._merged(n, spaces) for n in range(self.runs)]
        if any(self._merged(n, spaces) != self.spaces(n) for n in range(3 * self.runs)):
            raise ValueError("a long run of spaces must end in pieces of the greatest length")
        longer = [p for p in usable if len(p) > 1 and set(p) != {MARK}]
        self.breaks_at_newline = not any("\n" in p for p in longer)
        singles = sorted({c for p in longer for c in p} | {p for p in usable if len(p) == 1})
        ids = {p: i for i, p in enumerate(singles)} | {p: i + len(singles) for i, p in enumerate(sorted(longer))}
        order = {p: r for r, p in enumerate(sorted(longer, key=lambda p: -usable[p]))}
        pairs = sorted((ids[p[:k]] << 32 | ids[p[k:]], order[p], ids[p]) for p in longer for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        self.keys = np.array([k for k, _, _ in pairs], np.int64)
        self.ranks = np.array([r for _, r, _ in pairs], np.int64)
        self.made = np.array([m for _, _, m in pairs], np.int64)
        self.chars = {c: i for c, i in ids.items() if len(c) == 1}
        self.points = np.array(sorted(map(ord, self.chars)), np.int64)
        self.point_ids = np.array([self.chars[chr(c)] for c in self.points], np.int64)
        width = max(ids.values()) + 1
        self.weight = np.ones(width, np.int64)
        for c, i in self.chars.items():
            if c not in usable:
                self.weight[i] = len(c.encode("utf-8"))
        self.mark = self.chars[MARK]
        self.unknown = width

    @staticmethod
    def _merged(n: int, lengths: dict[int, float]) -> int:
        parts, k = [1] * n, 0
        while k < len(parts) - 1:
            if parts[k] + parts[k + 1] in lengths:
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                k = 0
            else:
                k += 1
        return len(parts)

    def spaces(self, n: int) -> int:
        """Tokens of a run of n spaces that no word takes part of."""
        return n // self.runs + self.run_tokens[n % self.runs]

    def count(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each sequence of characters: surviving symbols (in tokens), and whether the first is a lone mark."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, bool)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        seq = np.repeat(np.arange(len(words)), lengths)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        known = self.points[at] == points
        symbols = np.where(known, self.point_ids[at], self.unknown)
        size = np.where(known, self.weight[self.point_ids[at]], np.select([points < 0x80, points < 0x800, points < 0x10000], [1, 2, 3], 4))
        total, lone = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        rank, made = self._ranked(symbols[:-1], symbols[1:], seq[:-1] == seq[1:])
        rank, made = np.append(rank, NONE), np.append(made, 0)
        while len(seq):
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lengths = np.diff(np.append(first, len(seq)))
            best = np.minimum.reduceat(rank, first)
            over = best == NONE
            if over.any():
                total[seq[first[over]]] = np.add.reduceat(size, first)[over]
                lone[seq[first[over]]] = symbols[first[over]] == self.mark
            least = np.repeat(np.where(over, -1, best), lengths)
            # of a run of overlapping places, every second one from the left
            places = np.flatnonzero(rank == least)
            if len(places):
                start = np.r_[True, np.diff(places) != 1]
                run_at = np.maximum.accumulate(np.where(start, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - run_at) % 2 == 0]
                symbols[places] = made[places]
                size[places] = 1
            keep = least >= 0
            keep[places + 1] = False
            changed = np.zeros(len(seq), bool)
            changed[places] = True
            symbols, size, seq, rank, made, changed = symbols[keep], size[keep], seq[keep], rank[keep], made[keep], changed[keep]
            # only pairs beside a new symbol have to be looked up again
            changed[:-1] |= changed[1:]
            look = np.flatnonzero(changed)
            if len(look) and look[-1] == len(seq) - 1:
                rank[-1], look = NONE, look[:-1]
            rank[look], made[look] = self._ranked(symbols[look], symbols[look + 1], seq[look] == seq[look + 1])
        return total, lone

    def _ranked(self, left: np.ndarray, right: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[where] == key) & same, self.ranks[where], NONE), self.made[where]


class Counter:
    """Counts texts, remembering pre-tokens; the memory is emptied beyond `remember` entries."""

    def __init__(self, model: PieceModel, remember: int = 400_000):
        self.model, self.remember, self.seen = model, remember, {"": 0}
        self.bare: set[str] = set()  # words whose leading mark stays alone

    def _learn(self, words: set[str]) -> None:
        if len(self.seen) + len(words) > self.remember:
            self.seen, self.bare = {"": 0}, set()
        new = list(words - self.seen.keys())
        totals, lone = self.model.count([w if w[:1] == "\n" and self.model.breaks_at_newline else MARK + w for w in new])
        self.seen.update(zip(new, totals.tolist()))
        self.bare.update(w for w, alone in zip(new, lone.tolist()) if alone)

    def texts(self, texts: list[str | None]) -> list[int]:
        split = []
        for t in texts:
            t = (t or "").replace(MARK, " ")
            if self.model.breaks_at_newline:
                t = t.replace("\n", " \n")  # a newline takes part in no merge: a word may end before it
            split.append(t.split(" "))
        self._learn(set(chain.from_iterable(split)))
        get, out = self.seen.__getitem__, []
        for text, parts in zip(texts, split):
            if not text:
                out.append(0)
                continue
            n = sum(map(get, parts))
            if "" in parts:
                n += self._spaces(parts)
            out.append(n)
        return out

    def _spaces(self, parts: list[str]) -> int:
        """Tokens of runs of spaces beyond the one before each word."""
        extra = run = 0
        spaces, newline = self.model.spaces, self.model.breaks_at_newline
        for p in parts:
            if p == "":
                run += 1
            elif run:
                if not (newline and p[0] == "\n") and p in self.bare:
                    extra += spaces(run + 1) - 1
                else:
                    extra += spaces(run)
                run = 0
        return extra + spaces(run)


@lru_cache(maxsize=1)
def _counter(model: bytes) -> Counter:
    """One for all tasks of a worker: the model is read once, and pre-tokens stay known."""
    return Counter(PieceModel(model))


def token_counts(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row's whole text; one narrow pass, no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for b in slices(batches, 1):
            n = pa.array(counter.texts(b.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n], ["id", "n_bytes", "n_tokens"])

    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    counted = picked.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
