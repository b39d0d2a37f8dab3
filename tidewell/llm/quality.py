"""Quality by a factorisation machine.

Features of a document, all binary and scaled to length 1 together: its distinct words, hashed; its structure statistics
(share of distinct words, repeats in a row, letters, capitals, digits, other signs, line lengths and repeated lines, word
lengths), each as the bin it falls in; its length, as metadata. The model is w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,
the pairs computed in linear time as half of sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2). It is trained by AdaGrad on the
logistic loss from a fixed seed, in fixed order: reruns agree. Its sums are scaled to probabilities by cross-validation. Learning sees at most about `sample` labelled rows (by hash
of the id, none held out); scoring reads every whole text. Language, source and id are no features.

Null or empty text: no words, the bins of empty statistics. Without labels of both kinds: the score is 0.5 everywhere.
Equal texts score alike. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidewell.llm.common import crc_mod, slices
from tidewell.llm.toxicity import fit_logistic, labelled_sample
from tidewell.llm.words import Hashes, byte_set, cut

BITS, FACTORS = 15, 8
WORDS = 1 << BITS
STATS, BINS = 12, 12
WIDTH = WORDS + STATS * (BINS + 1)
_KIND = np.full(256, 3)  # letters 0, capitals 1, digits 2, other signs 3, white space 4; bytes beyond ASCII are letters
_KIND[128:] = 0
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[32, *range(9, 14)]] = 4


_LINE = byte_set(10)
_ENDED = byte_set(*b".!?")
#: Bytes of texts that are read at once: so many that their arrays fit in a cache.
SLICE = 1 << 19


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of the values between each two bounds."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(hashes: np.ndarray, bounds: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Between each two bounds, how many hashes differ, and of these how many have their flag, a part of what is hashed; and the places of the first ones."""
    firsts, n, flagged = [], np.zeros(len(bounds) - 1, np.int64), np.zeros(len(bounds) - 1, np.int64)
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b > a:
            order = np.argsort(hashes[a:b])
            own = hashes[a:b][order]
            new = np.empty(b - a, bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            first = order[new] + a
            firsts.append(first)
            n[k], flagged[k] = len(first), flags[first].sum()
    return n, flagged, np.concatenate(firsts) if firsts else np.zeros(0, np.int64)


def statistics(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text STATS numbers between 0 and 1, then the number of its distinct words, and the hashes of these."""
    words, texts = np.diff(first), len(offsets) - 1
    kinds = np.stack([_sums(_KIND[data] == k, offsets) for k in range(5)], 1)
    signs, n = np.maximum(1, np.diff(offsets)), np.maximum(1, words)
    hashes = Hashes(data)
    hashed = hashes(start, end)
    same = np.zeros(len(start), bool)
    same[1:] = hashed[1:] == hashed[:-1]
    same[first[:-1][words > 0]] = False
    repeats = _sums(same, first)
    distinct, ended, places = _distinct(hashed, first, _ENDED[data[end - 1]])
    # lines without their ends; a text's end is one
    inside = ~_LINE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    opens[at] |= inside[at]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    at = offsets[1:][offsets[1:] > 0] - 1
    closes[at] |= inside[at]
    line, line_end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    of_line = np.searchsorted(line, offsets)
    line_hash = hashes(line, line_end)
    kept, _, _ = _distinct(line_hash, of_line, np.zeros(len(line), bool))
    lines = np.diff(of_line)
    points = _sums((data & 0xC0) != 0x80, offsets)
    out = np.stack(
        [
            distinct / n,
            repeats / n,
            kinds[:, 1] / signs,
            kinds[:, 2] / signs,
            np.minimum(1.0, kinds[:, 3] / signs * 2),
            kinds[:, 4] / signs,
            np.minimum(1.0, signs / n / 20),
            np.minimum(1.0, lines / n * 4),
            kept / np.maximum(1, lines),
            ended / np.maximum(1, distinct),
            np.minimum(1.0, np.log1p(words) / 12),
            np.minimum(1.0, np.log1p(points) / 16),
        ],
        1,
    ).reshape(texts, STATS)
    return out, distinct, hashed[places]


def features(texts: pa.Array) -> list[np.ndarray]:
    """Of each text the indices of the features that are 1, rising; distinct words with equal indices count once."""
    if not len(texts):
        return []
    texts = pc.fill_null(texts, "")
    data, offsets, start, end, first = cut(texts, plain=False)
    stats, distinct, hashed = statistics(data, offsets, start, end, first)
    bins = WORDS + np.arange(STATS) * (BINS + 1) + (stats * BINS).astype(np.int64)
    index = (hashed >> np.uint64(64 - BITS)).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(distinct)])
    out = []
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        own = np.sort(index[a:b])
        out.append(np.concatenate([own[np.concatenate([[True], own[1:] != own[:-1]])] if b > a else own, bins[k]]))
    return out


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    #: What the sum is multiplied by, and what is added, before it becomes a probability.
    scale: float = 1.0
    shift: float = 0.0

    def sums(self, rows: list[np.ndarray]) -> np.ndarray:
        """The statistics weigh as much as all words together."""
        if not rows:
            return np.zeros(0)
        index = np.concatenate(rows)
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        x = values(index, lengths)
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        z = self.bias + np.add.reduceat(self.linear[index] * x, start)
        vx = self.factors[index] * x[:, None]
        s = np.add.reduceat(vx, start, axis=0)
        return z + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), start))

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probabilities."""
        return 1 / (1 + np.exp(-np.clip(self.scale * self.sums(rows) + self.shift, -30, 30)))


def values(index: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    words = np.maximum(1, lengths - STATS)
    return np.where(index < WORDS, np.repeat(1 / np.sqrt(2 * words), lengths), 1 / np.sqrt(2 * STATS)).astype(np.float32)


def fit(rows: list[np.ndarray], labels: np.ndarray, steps: int = 750, batch: int = 64, rate: float = 0.1, decay: float = 1e-5) -> Machine:
    rng = np.random.default_rng(8)
    w, v = np.zeros(WIDTH, np.float32), rng.normal(0, 0.05, (WIDTH, FACTORS)).astype(np.float32)
    gw, gv = np.full(WIDTH, 1e-6, np.float32), np.full((WIDTH, FACTORS), 1e-6, np.float32)
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    bias = float(np.log(share / (1 - share)))
    for _ in range(max(1, round(steps * batch / len(rows)))):  # as many steps for few rows as for many
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            take = order[at : at + batch]
            index = np.concatenate([rows[k] for k in take])
            lengths = np.array([len(rows[k]) for k in take])
            start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            x = values(index, lengths)
            vx = v[index] * x[:, None]
            s = np.add.reduceat(vx, start, axis=0)
            z = bias + np.add.reduceat(w[index] * x, start) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), start))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[take]).astype(np.float32)
            each = np.repeat(g, lengths) * x
            seen = np.flatnonzero(np.bincount(index, minlength=WIDTH))
            dw = np.bincount(index, each, WIDTH)[seen].astype(np.float32) / len(take) + decay * w[seen]
            slope = each[:, None] * (np.repeat(s, lengths, axis=0) - vx)
            dv = np.column_stack([np.bincount(index, slope[:, f], WIDTH)[seen] for f in range(FACTORS)]).astype(np.float32) / len(take) + decay * v[seen]
            gw[seen] += dw * dw
            gv[seen] += dv * dv
            w[seen] -= rate * dw / np.sqrt(gw[seen])
            v[seen] -= rate / 2 * dv / np.sqrt(gv[seen])
            bias -= rate * float(g.mean()) / 10
    return Machine(bias, w, v)


def fit_calibrated(rows: list[np.ndarray], labels: np.ndarray, folds: int = 4, **how: object) -> Machine:
    """A machine whose sums are scaled to probabilities by those of machines that hadn't learned from the rows: with few rows sums are too near the mean."""
    machine = fit(rows, labels, **how)
    of = np.array([zlib.crc32(r.tobytes()) % folds for r in rows])
    sums, seen = np.zeros(len(rows)), np.zeros(len(rows), bool)
    for k in range(folds):
        held, taught = np.flatnonzero(of == k), np.flatnonzero(of != k)
        if len(held) and 0 < labels[taught].sum() < len(taught):
            sums[held] = fit([rows[j] for j in taught], labels[taught], **how).sums([rows[j] for j in held])
            seen[held] = True
    y = labels[seen]
    if 0 < y.sum() < len(y):
        scale, shift = fit_logistic(sums[seen, None], y, decay=1e-3)
        if scale > 0:
            machine.scale, machine.shift = float(scale), float(shift)
    return machine


def _index(rows: DataFrame) -> DataFrame:
    """y, i: each row's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0, SLICE):
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([r.astype(np.int32).tobytes() for r in features(b.column(0))], pa.binary())], ["y", "i"])

    return rows.select("text", "y").mapInArrow(run, "y int, i binary")


def train(docs: DataFrame, labels: DataFrame, sample: int = 6_000, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", held_out: Column | None = None) -> Machine | None:
    """held_out: of labels' rows, those not to learn from; by default crc32(id) mod 4 = 2. Features of at most about `sample` rows come to the driver."""
    held_out = crc_mod(F.col(id_col), 4) == 2 if held_out is None else held_out
    got = _index(labelled_sample(docs, labels, label, held_out, sample, id_col, text_col)).toPandas()
    got = got.sort_values(["y", "i"], kind="stable")
    if got["y"].nunique() < 2:
        return None
    return fit_calibrated([np.frombuffer(i, np.int32).astype(np.int64) for i in got["i"]], got["y"].to_numpy(np.float64))


def score(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """id, score, predicted of every row; one narrow pass, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches, 1, SLICE):
            rows = features(b.column(1))
            p = model.scores(rows) if model else np.full(len(rows), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.astype(np.float64))], ["id", "score"])

    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = picked.mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
