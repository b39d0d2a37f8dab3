"""Document fingerprints by order MinHash.

A text's k-mers of code points are numbered by occurrence, so that a repeated k-mer stands for several elements. Each
element has one random 64-bit hash; the i-th of `m` orders is the order of the hashes rotated by a fixed random offset,
so that its `l` minimal elements are the l that follow the offset on the ring of sorted hashes. These l are put back in
text order and hashed as a tuple: entry i of the signature. Two texts agree in an entry if the same elements are minimal
and stand in the same order, which makes the share of equal entries sensitive to edit distance and not to sets alone.

Null text: as the empty text, which has a signature of its own; two empty texts are alike. Texts shorter than k are one
k-mer. Equal texts have equal fingerprints, since nothing else enters. Very long texts are processed whole.

The orders share one sort, so they aren't independent: measured over random texts with edits, the estimate's deviation is that of
independent orders from some 100 signs on, and up to 1.6 times that below.

`compare_with_next` puts rows in order of id (ties by text) without a global sort in one task: bounded ranges of ids are
streamed, each with the first row of the next range behind it. Ranges are cut at quantiles, and, where ids are numbers and rows
are many, evenly between quantiles. Rows without id have no next row: an empty text stands
for it. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from tidewell.llm.common import mix64, seeds, slices

K, L, M = 12, 2, 64
BASE = 0x9E3779B97F4A7C15 | 1
POS = np.uint64(31)
LOW = np.uint64((1 << 31) - 1)
OFFSETS = seeds(M, 3) & ~LOW
ENTRY = 4  # hex digits


def _kmers(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive code points, by doubling."""
    if len(points) <= k:
        h = np.uint64(len(points))
        for p in points:
            h = h * np.uint64(BASE) + p
        return np.array([h], np.uint64)
    whole, width, done, length = points, 1, None, 0
    left = k
    while True:
        if left & 1:
            if done is None:
                done, length = whole, width
            else:
                power = np.uint64(pow(BASE, width, 1 << 64))
                n = len(points) - length - width + 1
                done = done[:n] * power + whole[length : length + n]
                length += width
        left >>= 1
        if not left:
            return done
        n = len(whole) - width
        whole = whole[:n] * np.uint64(pow(BASE, width, 1 << 64)) + whole[width : width + n]
        width *= 2


def signature(text: str | None, k: int = K, l: int = L) -> np.ndarray:  # noqa: E741
    """The M entries, 16 bits each."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        if not len(points):
            return np.zeros(M, np.uint16)
        h = mix64(_kmers(points, k))
        n = len(h)
        at = np.arange(n, dtype=np.uint64)
        ranked = np.sort(h & ~LOW | at)
        same = ranked >> POS
        order = np.arange(n)
        new = np.r_[True, same[1:] != same[:-1]]
        occurrence = order - np.maximum.accumulate(np.where(new, order, 0))
        elements = mix64(same * np.uint64(0xD6E8FEB86659FD93) + occurrence.astype(np.uint64) + np.uint64(1))
        ring = np.sort(elements & ~LOW | ranked & LOW)
        first = np.searchsorted(ring, OFFSETS)
        take = min(l, n)
        picked = ring[(first[:, None] + np.arange(take)) % n]
        in_text = np.take_along_axis(picked, np.argsort(picked & LOW, axis=1, kind="stable"), 1) >> POS
        out = np.full(M, take, np.uint64)
        for j in range(take):
            out = mix64(out * np.uint64(0x9FB21C651E98DF25) + in_text[:, j] + np.uint64(1))
        return (out >> np.uint64(48)).astype(np.uint16)


def as_hex(entries: np.ndarray) -> str:
    return entries.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, l: int = L) -> float:  # noqa: E741
    """Estimates the share of equal elements in equal order: an entry is equal if all l of its tuple are, hence the root."""
    return float((a == b).mean() ** (1 / l))


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint of every row; no shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([as_hex(signature(t)) for t in b.column(1).to_pylist()], pa.string())], ["id", "fingerprint"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fingerprint string")
    return out.withColumnRenamed("id", id_col)


def _judge(row_id: object, text: str, sig: np.ndarray, after: str, after_sig: np.ndarray) -> tuple:
    changed = edited(text, after)
    other = signature(changed)
    return row_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), as_hex(sig), as_hex(other), likeness(sig, other), likeness(sig, after_sig)


def _bucket(value: Column, cuts: list, lo: object, hi: object, parts: int) -> Column:
    """How many cuts are below a value, by bisection, and which of `parts` even parts between two cuts it is in."""
    at = F.lit(cuts)
    bits = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    below = F.aggregate(F.lit(bits), F.lit(0), lambda k, bit: F.when((k + bit <= len(cuts)) & (F.get(at, k + bit - 1) < value), k + bit).otherwise(k))
    if parts == 1:
        return below
    ends = F.lit([float(v) for v in (lo, *cuts, hi)])
    first, last = F.get(ends, below), F.get(ends, below + 1)
    inside = F.floor((value.cast("double") - first) / F.greatest(last - first, F.lit(1e-300)) * parts).cast("int")
    return below * parts + F.greatest(F.lit(0), F.least(F.lit(parts - 1), inside))


COLUMNS = ("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 1024, most_cuts: int = 4096, most_parts: int = 256) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The text moves once."""
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = docs.where("id IS NOT NULL")
    n = known.count()
    wanted = max(1, n // rows_per_range)
    number = isinstance(df.schema[id_col].dataType, NumericType)
    ranges = min(most_cuts, wanted)
    parts = min(most_parts, -(-wanted // ranges)) if number else 1
    cuts: list = []
    bucket = F.lit(0)
    if ranges > 1:
        shares = [k / ranges for k in range(1, ranges)]
        found = known.agg(F.percentile_approx("id", shares, max(10_000, 5 * ranges)).alias("q"), F.min("id").alias("lo"), F.max("id").alias("hi")).first()
        cuts = sorted(set(found.q))
        bucket = _bucket(F.col("id"), cuts, found.lo, found.hi, parts)
    placed = known.withColumn("bucket", bucket.cast("int"))
    # the first row of each range, wanted behind the range before it; at most most_cuts * most_parts of them
    firsts = sorted((r.bucket, r.id) for r in placed.groupBy("bucket").agg(F.min("id").alias("id")).collect())
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}
    spark = df.sparkSession
    heads = spark.createDataFrame([(i, b) for i, b in before.items()], f"id {kind}, bucket int")
    heads = known.join(F.broadcast(heads), "id").groupBy("id", "bucket").agg(F.min("text").alias("text"))
    rows = placed.withColumn("tail", F.lit(0)).unionByName(heads.withColumn("tail", F.lit(1)))
    # some ranges in each task, so that tasks are alike; a range is whole in its task
    rows = rows.repartition(max(1, len(firsts) // 8), "bucket").sortWithinPartitions("bucket", "tail", "id", "text")
    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def pack(found: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 7, kinds)], list(COLUMNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in slices(batches, 1):
            found = []
            for row_id, text, bucket, tail in zip(*(b.column(c).to_pylist() for c in range(4))):
                sig = signature(text)
                if held is not None and held[3] == bucket:
                    found.append(_judge(*held[:3], text, sig))
                held = None if tail else (row_id, text, sig, bucket)
            yield pack(found, b.schema.field(0).type)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            yield pack([_judge(None, t, signature(t), "", signature("")) for t in b.column(1).to_pylist()], b.schema.field(0).type)

    out = rows.select("id", "text", "bucket", "tail").mapInArrow(run, schema)
    if df.schema[id_col].nullable:
        out = out.unionByName(docs.where("id IS NULL").mapInArrow(alone, schema))
    return out.withColumnRenamed("id", id_col)
