"""Sharding by histogram sort.

Rows are ordered by a key, the 64-bit hash of the text and then that of the id, so that equal texts stand together.
Shard boundaries are found by counting: each round sums the exact bytes and rows of candidate key intervals over all
partitions and keeps only the intervals in which an unfinished boundary lies, to be probed finer in the next round.
A boundary is done when the bytes below one of its interval's edges meet the tolerance, or when one row is left in
it or the key can't be divided further. Nothing but these counts (at most 2**bits for each unfinished boundary) reaches the driver. Rows then
move once, into their shard's ranges, and are numbered there.

Law `bytes`: the shards' sizes are near equal. Equal texts stay in one shard unless their group alone exceeds the
tolerance at a boundary. Null text: no bytes, size 16. Null ids hash as the empty string. Rows equal in text and id
can't be told apart: they share a key and stay together. An empty table gives an empty result. The result's columns size,
shard and slot replace those of the table, which may have any others; the id may not have one of these names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.llm.common import fresh, materialize

OVERHEAD = 16
#: Bits of the key's two halves; each is probed from its highest bit.
HALF = 64


def _keys(text: Column, doc_id: Column) -> tuple[Column, Column]:
    """Both halves as unsigned order in signed longs."""
    flip = F.lit(-(1 << 63))
    return F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseXOR(flip), F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(7)).bitwiseXOR(flip)


def _unsigned(x: int) -> int:
    return x + (1 << 63)


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.01, bits: int = 12) -> tuple[list[tuple[int, int]], int, int]:
    """The shards - 1 boundaries as (h1, h2): a row belongs above a boundary when its key is not below it. Also all bytes and the rounds.

    keys: h1, h2, size, near uniform but for equal keys, as hashes are.
    """
    found: dict[int, tuple[int, int]] = {}
    total, rounds = 0, 0
    # an unfinished boundary's interval: its prefix of the 128-bit key, the prefix's length, the bytes below it
    state: dict[int, tuple[int, int, int]] = {b: (0, 0, 0) for b in range(1, shards)}
    goal: dict[int, float] = {}
    while state or not rounds:
        rounds += 1
        groups: dict[int, set[int]] = {}
        for prefix, length, _ in state.values():
            groups.setdefault(length, set()).add(prefix)
        counted: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for length, prefixes in groups.items() or {0: {0}}.items():
            for prefix, *found_in in _count(keys, length, prefixes, bits):
                counted.setdefault((length, prefix), []).append(tuple(found_in))
        if rounds == 1:
            total = sum(s for _, s, _ in counted.get((0, 0), []))
            goal = {b: total * b / shards for b in range(1, shards)}
        allowed = tolerance * total / shards
        after: dict[int, tuple[int, int, int]] = {}
        for b, (prefix, length, below) in state.items():
            step = min(bits, (HALF if length < HALF else 2 * HALF) - length)
            edge = prefix << (2 * HALF - length)
            width = 1 << (2 * HALF - length - step)
            best, inside = (edge, below), None
            for bin_, size, n in sorted(counted.get((length, prefix), [])):
                if below + size > goal[b] and inside is None:
                    inside = (bin_, below, n)
                    for at, under in ((edge + bin_ * width, below), (edge + (bin_ + 1) * width, below + size)):
                        if abs(under - goal[b]) < abs(best[1] - goal[b]):
                            best = (at, under)
                below += size
            if inside is None or abs(best[1] - goal[b]) <= allowed or inside[2] == 1 or length + step >= 2 * HALF:
                found[b] = divmod(min(best[0], (1 << 2 * HALF) - 1), 1 << HALF)
            else:
                after[b] = (prefix << step | inside[0], length + step, inside[1])
        state = after
    cuts = [found[b] for b in range(1, shards)]
    return [max(cuts[: k + 1]) for k in range(len(cuts))], total, rounds


def _count(keys: DataFrame, length: int, prefixes: set[int], bits: int) -> list[tuple[int, int, int, int]]:
    """Exact bytes in the next finer intervals of the given prefixes; summed in each partition before they meet."""
    half, inner = (1, length) if length < HALF else (2, length - HALF)
    step = min(bits, HALF - inner)
    key = F.col(f"h{half}").bitwiseXOR(F.lit(-(1 << 63)))
    bin_ = F.shiftrightunsigned(F.shiftleft(key, inner) if inner else key, HALF - step)
    own = F.lit(0) if not inner else F.shiftrightunsigned(key, HALF - inner)
    rows = keys
    if half == 2:
        firsts = {_signed(p >> inner) for p in prefixes}
        rows = rows.where(F.col("h1").isin(*firsts))
        outer = F.col("h1")
    else:
        outer = F.lit(0)
    if inner:
        rows = rows.where(own.isin(*{_long(p & ((1 << inner) - 1)) for p in prefixes}))
    got = rows.groupBy(outer.cast("long").alias("o"), own.cast("long").alias("p"), bin_.cast("long").alias("b")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    out = []
    for r in got:
        prefix = (r.p if r.p >= 0 else r.p + (1 << 64)) if inner else 0
        if half == 2:
            prefix |= _unsigned(r.o) << inner
        if prefix in prefixes:
            out.append((prefix, r.b, int(r.s), int(r.n)))
    return out


def _signed(u: int) -> int:
    return u - (1 << 63)


def _long(u: int) -> int:
    return u - (1 << 64) if u >= 1 << 63 else u


def histogram_shards(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.01, range_bytes: int = 128 << 20) -> DataFrame:
    """df with size, shard, slot (gapless in the shard, in key order); one exchange of the rows."""
    h1, h2 = _keys(F.col(text_col), F.col(id_col))
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + OVERHEAD).cast("long")
    keys = materialize(df.select(h1.alias("h1"), h2.alias("h2"), size.alias("size")), "shard-keys")
    cuts, total, _ = splitters(keys, shards, tolerance)

    def shard_of(a: Column, b: Column) -> Column:
        # a boundary at key 0 of the second half depends on the first alone: binary search as nested conditions
        def search(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi + 1) // 2
            x, y = (_signed(v) for v in cuts[mid - 1])
            return F.when((a > x) | ((a == x) & (b >= y)), search(mid, hi)).otherwise(search(lo, mid - 1))

        return search(0, shards - 1)

    # a shard is numbered in pieces of bounded size: ranges of the first half, and of the second half in case one text fills the shard;
    # at most about half a million of them at any size of the input, so that their counts can be broadcast and rows move once
    # and enough of them that the tasks of the exchange are alike
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    piece_bytes = max(min(range_bytes, total // (8 * tasks)), total // 500_000, 1 << 16)
    side = max(1, min(1 << 10, math.isqrt(max(0, total // (shards * piece_bytes) - 1)) + 1))

    def part(half: Column, n: int) -> Column:
        return F.floor((half.cast("double") + float(1 << 63)) / float((1 << 64) // n)).cast("long")

    def piece(first: Column, second: Column) -> Column:
        return part(first, shards * side) * (side + 1) + part(second, side)

    own = [c for c in df.columns if c.lower() not in ("size", "shard", "slot")]
    a, b, s, p, n, before = fresh(df, "_h1", "_h2", "_shard", "_piece", "_n", "_before")
    w = fresh(df, "_size")[0]
    rows = df.select(*[F.col(f"`{c}`") for c in own], h1.alias(a), h2.alias(b), size.alias(w))
    rows = rows.withColumn(s, shard_of(F.col(a), F.col(b))).withColumn(p, piece(F.col(a), F.col(b)))
    counts = keys.select(shard_of(F.col("h1"), F.col("h2")).alias(s), piece(F.col("h1"), F.col("h2")).alias(p)).groupBy(s, p).agg(F.count("*").alias(n))
    upto = Window.partitionBy(s).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(s, p, F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(before))
    inside = Window.partitionBy(s, p).orderBy(a, b, F.col(id_col).asc_nulls_first())
    rows = rows.withColumn(n, F.row_number().over(inside)).join(F.broadcast(counts), [s, p])
    return rows.select(*[F.col(f"`{c}`") for c in own], F.col(w).alias("size"), F.col(s).alias("shard"), (F.col(before) + F.col(n) - 1).cast("long").alias("slot"))
