"""N-gram Jaccard self-join by a size-aware heavy-light scheme, exact, with the classes' connected components.

A document's set: its distinct 5-word shingles (A-Z as a-z) as 64-bit hashes; with fewer words the whole sequence.
Documents with equal sets form a class, and only classes are joined. Shingles are put in one order for all sets: those
that many documents share last (their frequencies come from every document, by a hash of shingle and document; the
order decides how fast the join is, never what it returns). Of two sets of at least `percent` likeness, each has a shared
shingle in the first n - ceil(percent n) + 1 of this order, and two shared ones in the first n - ceil(percent n) + 2.

* small sets (n <= x) enumerate the 2-subsets of the latter as signatures;
* large sets are looked up in the inverted lists of the former, as are the small ones that a large set can match;
* x is where the cost summed over all sizes, of rows written and of list entries scanned, is least.

Signatures move once. Those that few classes have give pairs, whose shared ones are counted, which bounds the overlap from
above; what is left is verified on the whole sets, recomputed from the texts of candidates only. Those that more than
`CROWDED` classes have would give pairs without end, as in groups of near copies. Such classes get a home, the most
crowded signature they have (one for each band of set sizes), and go to their home and to homes they share a crowded
signature with, each home cut into tiles of bounded size. A tile first sees the looked-up shingles alone, and keeps the classes for which they
allow a partner; then the whole sets of these. It computes all overlaps as a matrix product and returns, for each class,
the number of its links and a class that they lead to: no pairs. Pairs that meet in a tile are left out elsewhere. Components grow from links by alternating large and small stars, written out each round.

Null or empty text, or no words: an empty set, linked with nothing, its own component. Equal texts, repeated rows: one
class, all linked with each other. A row without id counts as a document, never as a component's name unless all lack
one. An empty table gives an empty result. Extra columns are ignored. Any text length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewell.llm import common
from tidewell.llm.common import drop_table, mix64, skew_join, slices
from tidewell.llm.shingles import shingle_sets

#: One in so many elements is counted for the order; a shingle counted so often comes last; at most so many do (8 MB).
COUNTED, OFTEN, MOST = 20, 4, 500_000
#: A signature with more classes is crowded. A tile has at most two chunks of about so many classes and elements.
CROWDED, CHUNK, ELEMENTS = 64, 1024, 1 << 19
#: Signatures beyond a thousandth of all rows, and beyond so many, don't move at all; found in one of so many classes.
HOT_PART, HOT_ROWS, PROBED = 1000, 100_000, 64
#: Rows of signatures in a task.
TASK_ROWS = 2_000_000
#: Cost of a scanned list entry, as a part of that of a written row.
ENTRY_COST = 0.5
#: Bytes of texts that are read at once: so many that their arrays fit in a cache.
SLICE = 1 << 18
#: A bit map has up to 2 to this power of bits (16 MB).
BITMAP = 27
#: Has Spark remove a query's shuffle files when it ends, rather than when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """common.materialize; what the writing shuffled leaves the disks with it."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return common.materialize(df, name)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Overlap that a set of size n needs with any partner."""
    return -(-n * percent // 100)


def _shingled(df: DataFrame, n: int, body, schema: str, *more: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0, SLICE):
            yield from body(b, shingle_sets(b.column(0), n))

    return df.select("text", *more).mapInArrow(run, schema)


@lru_cache(maxsize=2)
def _sorted(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.frombuffer(raw, np.uint64)
    order = np.argsort(hashes)
    return hashes[order], order


def in_order(shingles: np.ndarray, often: bytes) -> tuple[np.ndarray, int]:
    """A set's shingles in the common order, and how many of them are not frequent."""
    hashes, rank = _sorted(often)
    if not len(hashes) or not len(shingles):
        return shingles, len(shingles)
    at = np.minimum(np.searchsorted(hashes, shingles), len(hashes) - 1)
    hit = hashes[at] == shingles
    if not hit.any():
        return shingles, len(shingles)
    last = shingles[hit][np.argsort(rank[at[hit]])]
    return np.concatenate([shingles[~hit], last]), len(shingles) - len(last)


def frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, float]:
    """Frequent shingles, rarest first, and the mean number of other entries in a list of the rest."""

    def body(b: pa.RecordBatch, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        picked = [s[mix64(s ^ salt) % np.uint64(COUNTED) == 0] for s, salt in zip(sets, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(picked).view(np.int64))], ["shingle"])

    rows = _shingled(docs, n, body, "shingle long", "salt")
    counts = materialize(rows.groupBy("shingle").count().where(F.col("count") > 1), "jaccard-counts")
    by_count = sorted((r["count"], r.n) for r in counts.groupBy("count").agg(F.count("*").alias("n")).collect())
    least, above = 1 << 62, 0
    for c, k in reversed(by_count):
        if c < OFTEN or above + k > MOST:
            break
        least, above = c, above + k
    got = counts.where(F.col("count") >= least).select("shingle", "count").toPandas().sort_values(["count", "shingle"])
    drop_table(counts)
    light = [(c, k) for c, k in by_count if c < least]
    # a list of f entries is counted f / COUNTED times in the mean, so the sum of c (c - 1) stands for f (f - 1) / COUNTED^2
    mass = sum(c * (c - 1) * k for c, k in light) * COUNTED
    seen = max(1, sum(c * k for c, k in light))
    return got["shingle"].to_numpy(np.int64).view(np.uint64), mass / seen


def boundary(sizes: list[tuple[int, int]], percent: int, others: float) -> int:
    """The size x up to which sets enumerate subsets: the least total cost over all (size, number of sets)."""
    share = 1 - percent / 100

    def small(n: int) -> float:
        p = n - least_overlap(n, percent) + 2
        return p * (p - 1) / 2

    def large(n: int) -> float:
        p = n - least_overlap(n, percent) + 1
        return p * (1 + ENTRY_COST * others * share)

    ordered = sorted(sizes)
    best = cost = sum(large(n) * k for n, k in ordered)
    x = 0
    for n, k in ordered:
        cost += (small(n) - large(n)) * k
        if cost < best:
            best, x = cost, n
    return x


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set; the first names its class."""
    with np.errstate(over="ignore"):
        return tuple(np.array([mix64(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for salt in (0, 0xA5A5A5A5A5A5A5A5))


def _summaries(docs: DataFrame, n: int, percent: int, often: bytes) -> DataFrame:
    """id, n, d1, d2, early: digest of the set and its first shingles in the common order."""
    kind = docs.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def body(b: pa.RecordBatch, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        d1, d2 = digests(sets)
        early, light = [], []
        for s in sets:
            o, k = in_order(s, shared.value)
            early.append(o[: len(s) - least_overlap(len(s), percent) + 2].tobytes() if len(s) else b"")
            light.append(k)
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1), pa.array(d2), pa.array(light, pa.int64()), pa.array(early, pa.binary())], ["id", "n", "d1", "d2", "light", "early"])

    return _shingled(docs, n, body, f"id {kind}, n long, d1 long, d2 long, light long, early binary", "id")


def looked_up(early: np.ndarray, n: int, light: int, percent: int) -> tuple[np.ndarray, int]:
    """The shingles that a set is looked up by, and the last one's place in the order: 16 bits, frequent ones all at the end."""
    p = min(len(early), n - least_overlap(n, percent) + 1)
    return early[:p], int(early[p - 1] >> np.uint64(49)) if p <= light else 1 << 15


def _signatures(classes: DataFrame, percent: int, x: int) -> DataFrame:
    """sig, cid, n, last. last: place of the last looked-up shingle in the order; -1 for subsets."""
    reach = least_overlap(x + 1, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 3, 1 << 20):
            sig, cid, size, last = [], [], [], []
            for c, n, light, raw in zip(*(b.column(k).to_pylist() for k in range(4))):
                early = np.frombuffer(raw, np.uint64)
                found = []
                if n <= x:
                    i, j = np.triu_indices(len(early), 1)
                    with np.errstate(over="ignore"):
                        found.append((mix64(early[i] * np.uint64(0x9FB21C651E98DF25) + mix64(early[j])), -1))
                if n >= reach:
                    found.append(looked_up(early, n, light, percent))
                for s, w in found:
                    sig.append(s)
                    for part, v in ((cid, c), (size, n), (last, w)):
                        part.append(np.full(len(s), v, np.int64))
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(cid)), pa.array(np.concatenate(size).astype(np.int32)), pa.array(np.concatenate(last).astype(np.int32))], ["sig", "cid", "n", "last"])

    return classes.select("cid", "n", "light", "early").mapInArrow(run, "sig long, cid long, n int, last int")


def _signature_rows(sizes: list[tuple[int, int]], percent: int, x: int) -> int:
    """How many rows _signatures makes."""
    reach, out = least_overlap(x + 1, percent), 0
    for n, k in sizes:
        p = n - least_overlap(n, percent) + 2
        out += k * ((min(p, n) * (min(p, n) - 1) // 2 if n <= x else 0) + (p - 1 if n >= reach else 0))
    return out


def _hottest(classes: DataFrame, percent: int, x: int, total: int) -> dict[int, int]:
    """Signatures that hold more than a thousandth of all rows, by an estimate, and how many: fewer than about a thousand."""
    most = max(total // HOT_PART, HOT_ROWS)
    if total <= most:
        return {}
    probe = _signatures(classes.where(F.pmod(F.xxhash64("cid", F.lit(5)), F.lit(PROBED)) == 0), percent, x)
    return {r.sig: r["count"] * PROBED for r in probe.groupBy("sig").count().where(F.col("count") * PROBED > most).collect()}


def _meetings(sigs: DataFrame, percent: int, x: int, total: int) -> DataFrame:
    """a, b, a_n, b_n, a_last, b_last of the pairs of classes with a signature that few have, crowd 0; and a row for each class with
    a crowded one: the class as a, its size as a_n, the signature as b, and how many have it as crowd."""
    names = ("a", "b", "a_n", "b_n", "a_last", "b_last", "crowd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task's rows are bounded by the number of partitions; no signature left in here has more than a thousandth of all
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        sig, cid, n, last = (np.concatenate(c) for c in zip(*parts))
        del parts
        order = np.argsort(sig)
        sig, cid, n, last = sig[order], cid[order], n[order].astype(np.int64), last[order]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.concatenate([start, [len(sig)]]))
        for k in range(2, CROWDED + 1):
            i, j = np.triu_indices(k, 1)
            for firsts in np.array_split(start[size == k], 1 + int((size == k).sum()) * len(i) // 1_000_000):
                u, v = (firsts[:, None] + i).ravel(), (firsts[:, None] + j).ravel()
                most = np.maximum(n[u], n[v])
                kind = np.where(last[u] < 0, last[v] < 0, (last[v] >= 0) & (most > x))
                keep = kind & (100 * np.minimum(n[u], n[v]) >= percent * most) & (cid[u] != cid[v])
                u, v = u[keep], v[keep]
                u, v = np.where(cid[u] < cid[v], u, v), np.where(cid[u] < cid[v], v, u)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (cid[u], cid[v], n[u].astype(np.int32), n[v].astype(np.int32), last[u], last[v], np.zeros(len(u), np.int64))], names)
        crowd = np.repeat(size, size)
        at = np.flatnonzero(crowd > CROWDED)
        none = np.zeros(len(at), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (cid[at], sig[at], n[at].astype(np.int32), none, none, none, crowd[at].astype(np.int64))], names)

    parts = max(int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_ROWS + 1)
    return sigs.repartition(parts, "sig").mapInArrow(run, "a long, b long, a_n int, b_n int, a_last int, b_last int, crowd long")


def _candidates(met: DataFrame, percent: int) -> DataFrame:
    """a, b, crowd: of pairs, those whose looked-up shingles allow the overlap they need; and all rows of crowded signatures."""
    counted = met.groupBy("a", "b", "a_n", "b_n", "a_last", "b_last", "crowd").agg(F.count("*").alias("c"))
    need = F.expr(f"(cast(a_n + b_n as long) * {percent} + {99 + percent}) div {100 + percent}")
    # shingles behind those that were looked up
    a_rest, b_rest = (F.expr(f"((cast({s}_n as long) * {percent} + 99) div 100) - 1") for s in "ab")
    behind = F.when(F.col("a_last") < F.col("b_last"), a_rest).when(F.col("b_last") < F.col("a_last"), b_rest).otherwise(F.greatest(a_rest, b_rest))
    return counted.where((F.col("crowd") > 0) | (F.col("a_last") < 0) | (F.col("c") + behind >= need)).select("a", "b", F.col("a_n").alias("n"), "crowd")


def _homes(met: DataFrame, sigs: DataFrame, hottest: dict[int, int], percent: int) -> DataFrame:
    """cid, home, k, near of the classes with crowded signatures: their home, its chunks, and the homes met in such signatures."""
    crowded = met.where("crowd > 0").select(F.col("a").alias("cid"), "n", F.col("b").alias("sig"), "crowd")
    if hottest:
        known = sigs.sparkSession.createDataFrame(list(hottest.items()), "sig long, crowd long")
        crowded = crowded.unionByName(sigs.join(F.broadcast(known), "sig").select("cid", "n", "sig", "crowd"))
    width = float(np.log(100 / percent) * 1.001)  # partners are in one band of sizes, or in neighbouring ones
    own = crowded.groupBy("cid", "n").agg(F.max(F.struct("crowd", "sig")).alias("top"), F.collect_set("sig").alias("sigs"))
    own = own.withColumn("band", F.floor(F.log("n") / width).cast("int"))
    chunks = 1 + F.greatest(F.col("top.crowd") / CHUNK, F.col("top.crowd") * F.exp((F.col("band") + 1) * width) / ELEMENTS)
    own = materialize(own.select("cid", "band", F.xxhash64("top.sig", "band").alias("home"), F.floor(chunks).cast("int").alias("k"), "sigs"), "jaccard-crowded")
    each = own.select("cid", "band", "home", "k", F.explode("sigs").alias("sig"))
    met_in = each.groupBy("sig").agg(F.collect_set(F.struct("home", "k", "band")).alias("homes"), F.count("*").alias("n")).where(F.size("homes") > 1)
    beside = skew_join(each, met_in, "sig", F.col("n"), each.count(), "inner").select("cid", "band", "home", F.explode("homes").alias("h"))
    beside = beside.where((F.col("h.home") != F.col("home")) & (F.abs(F.col("h.band") - F.col("band")) <= 1))
    near = beside.groupBy("cid").agg(F.collect_set(F.struct("h.home", "h.k")).alias("near"))
    none = F.array().cast("array<struct<home:bigint,k:int>>")
    out = materialize(own.select("cid", "home", "k").join(near, "cid", "left").withColumn("near", F.coalesce("near", none)), "jaccard-homes")
    drop_table(own)
    return out


def _apart(pairs: DataFrame, homes: DataFrame) -> DataFrame:
    """The pairs that don't meet in a tile."""
    at = homes.select("cid", "home", F.transform("near", lambda h: h.home).alias("near"))
    a, b = (at.select(*[F.col(c).alias(f"{side}_{c}") for c in at.columns]).withColumnRenamed(f"{side}_cid", side) for side in "ab")
    both = F.expr("a_home = b_home OR (array_contains(a_near, b_home) AND array_contains(b_near, a_home))")
    return pairs.join(a, "a", "left").join(b, "b", "left").where(~F.coalesce(both, F.lit(False))).select("a", "b")


def _bitmap(ids: DataFrame) -> tuple[int, bytes]:
    """A power of two and as many bits, of which those of the ids' hashes are set: 16 for each id, as far as BITMAP allows."""
    power = int(min(BITMAP, max(16, np.ceil(np.log2(16 * max(1, ids.count()))))))
    spot = F.pmod(F.col("cid"), F.lit(1 << power))
    got = ids.groupBy(F.bitmap_bucket_number(spot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits")).collect()
    out = bytearray((1 << power) // 8 + 8192)
    for r in got:
        at = r.k * 4096
        out[at : at + 4096] = r.bits
    return power, bytes(out)


def _places(ids: np.ndarray, power: int) -> np.ndarray:
    """Where the bit map has an id: bucket 0 is bit 0 alone, later ones begin at bit 1."""
    bit = np.mod(ids, 1 << power)
    bucket = np.where(bit > 0, 1 + (bit - 1) // 32768, bit // 32768)
    return bucket * 32768 + np.where(bit > 0, (bit - 1) % 32768, -bit % 32768)


def _wanted(ids: np.ndarray, bitmap: tuple[int, bytes]) -> np.ndarray:
    """Whether the bit map has them: true for all that it was made of, and for few others."""
    power, raw = bitmap
    at = _places(ids, power)
    return ((np.frombuffer(raw, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def _candidate_sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """cid, shingles of candidate classes (and few others), computed again from the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()
        for b in slices(batches, 0, SLICE):
            sets = shingle_sets(b.column(0), n)
            cids = digests(sets)[0]
            ids, found = [], []
            for k in np.flatnonzero(_wanted(cids, shared.value)):
                cid = int(cids[k])
                if cid not in sent and len(sets[k]):
                    if len(sent) > 100_000:
                        sent.clear()
                    sent.add(cid)
                    ids.append(cid)
                    found.append(sets[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["cid", "shingles"])

    return docs.select("text").mapInArrow(run, "cid long, shingles binary").groupBy("cid").agg(F.first("shingles").alias("shingles"))


def _links(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs whose whole sets are alike."""
    one = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("a_set"))
    other = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("b_set"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            a_ids, b_ids = [], []
            for i, j, x, y in zip(*(c.to_pylist() for c in b.columns)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    a_ids.append(i)
                    b_ids.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a_ids, pa.int64()), pa.array(b_ids, pa.int64())], ["a", "b"])

    return pairs.join(one, "a").join(other, "b").select("a", "b", "a_set", "b_set").mapInArrow(run, "a long, b long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Of all pairs of sets, how many elements both have. Elements of many sets are counted by a matrix product, the others one by one."""
    g, lengths = len(sets), np.array([len(s) for s in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(g), lengths)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    size = np.diff(np.concatenate([start, [len(every)]]))
    kind = np.float32 if lengths.max() < 1 << 24 else np.float64
    out = np.zeros((g, g), kind)
    dense = (size > 1) & (size * 12 > g)
    width = max(1, min(2048, (1 << 22) // g))
    for k in range(0, int(dense.sum()), width):
        at, n = start[dense][k : k + width], size[dense][k : k + width]
        rows = np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        x = np.zeros((g, len(at)), kind)
        x[owner[rows], np.repeat(np.arange(len(at)), n)] = 1
        out += x @ x.T
    flat, held, many = out.reshape(-1), [], 0
    for f in np.unique(size[(size > 1) & ~dense]).tolist():
        firsts = start[(size == f) & ~dense]
        for at in np.array_split(firsts, 1 + len(firsts) * f * f // (1 << 22)):
            o = owner[at[:, None] + np.arange(f)]
            held.append((o[:, :, None] * g + o[:, None, :]).ravel())
            many += held[-1].size
            if many > 1 << 22:
                flat += np.bincount(np.concatenate(held), minlength=g * g).astype(kind)
                held, many = [], 0
    if held:
        flat += np.bincount(np.concatenate(held), minlength=g * g).astype(kind)
    out[np.arange(g), np.arange(g)] = lengths
    return out


def tile_links(sets: list[np.ndarray], side: np.ndarray, copies: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each set, the copies of those it is linked with, and the first of those that links lead to. Sets of one side alone, or pairs of both sides."""
    n = np.array([len(s) for s in sets], np.float64)
    both = overlaps(sets).astype(np.float64)
    link = (100 + percent) * both >= percent * (n[:, None] + n[None, :])
    np.fill_diagonal(link, False)
    if side.any():
        link &= side[:, None] != side[None, :]
    label = np.arange(len(sets))
    while True:
        after = np.minimum(label, np.where(link, label[None, :], len(sets)).min(1))
        after = after[after]
        if (after == label).all():
            return link @ copies, label
        label = after


def _tiles(homes: DataFrame) -> DataFrame:
    """g, h, i, j, side, cid: the tiles that a class goes to, homes and chunks of both sides."""
    own = homes.withColumn("i", F.pmod(F.xxhash64("cid", F.lit(3)), F.col("k")).cast("int"))
    inner = own.select("cid", F.col("home").alias("g"), F.col("home").alias("h"), "i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    inner = inner.select(F.col("g"), "h", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), (F.col("j") < F.col("i")).cast("int").alias("side"), "cid")
    outer = own.select("cid", "home", "i", F.explode("near").alias("o")).select("cid", "home", "i", F.col("o.home").alias("other"), F.explode(F.sequence(F.lit(0), F.col("o.k") - 1)).alias("j"))
    first = F.col("home") < F.col("other")
    outer = outer.select(F.least("home", "other").alias("g"), F.greatest("home", "other").alias("h"), F.when(first, F.col("i")).otherwise(F.col("j")).alias("i"), F.when(first, F.col("j")).otherwise(F.col("i")).alias("j"), (~first).cast("int").alias("side"), "cid")
    return inner.unionByName(outer)


TILE = ("g", "h", "i", "j")


def _in_tiles(rows: DataFrame, judge: Callable[[list, list[tuple]], pa.RecordBatch], schema: str) -> DataFrame:
    """What judge makes of each tile with pairs in it; rows: tile, side, and what else it needs, a set's shingles last."""
    last = len(rows.columns) - 1

    def closed(at: list, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        inside = at is not None and at[0] == at[1] and at[2] == at[3]
        if len(held) > 1 and (inside or len({r[0] for r in held}) > 1):
            yield judge(at, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in slices(batches, last):
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if list(row[:4]) != at:
                    yield from closed(at, held)
                    at, held = list(row[:4]), []
                held.append(row[4:])
        yield from closed(at, held)

    return rows.repartition(*TILE).sortWithinPartitions(*TILE).mapInArrow(run, schema)


def _lists(classes: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """cid, n, last, lost, early of the classes in ids, and few others: only these move. early: the looked-up shingles, of each the low
    half, which adds to overlaps but for the lost ones that are alike in it."""
    shared = classes.sparkSession.sparkContext.broadcast(_bitmap(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 3, 1 << 20):
            b = b.filter(pa.array(_wanted(b.column(0).to_numpy(), shared.value)))
            found = [looked_up(np.frombuffer(raw, np.uint64), n, light, percent) for n, light, raw in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
            halves = [np.unique(s.astype(np.uint32)) for s, _ in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([w for _, w in found], pa.int32()), pa.array([len(s) - len(h) for (s, _), h in zip(found, halves)], pa.int32()), pa.array([h.tobytes() for h in halves], pa.binary())], ["cid", "n", "last", "lost", "early"])

    return classes.select("cid", "n", "light", "early").mapInArrow(run, "cid long, n long, last int, lost int, early binary")


def _hopeful(homes: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The rows of tiles whose looked-up shingles allow a partner in the tile."""

    def judge(at: list, tile: list[tuple]) -> pa.RecordBatch:
        side, n, last, lost = (np.array([r[k] for r in tile], np.int64) for k in (0, 2, 3, 4))
        both = overlaps([np.frombuffer(r[5], np.uint32) for r in tile]).astype(np.int64)
        both = np.where(both > 0, both + np.minimum(lost[:, None], lost[None, :]), 0)
        rest = (n * percent + 99) // 100 - 1
        one, other, a, b = last[:, None], last[None, :], rest[:, None], rest[None, :]
        behind = np.where(one < other, a, np.where(other < one, b, np.maximum(a, b)))
        total = n[:, None] + n[None, :]
        hope = (both > 0) & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])) & ((both + behind) * (100 + percent) >= total * percent)
        np.fill_diagonal(hope, False)
        if side.any():
            hope &= side[:, None] != side[None, :]
        kept = np.flatnonzero(hope.any(1))
        place = [pa.array(np.full(len(kept), v, t)) for v, t in zip(at, (np.int64, np.int64, np.int32, np.int32))]
        return pa.RecordBatch.from_arrays([*place, pa.array(side[kept].astype(np.int32)), pa.array([tile[k][1] for k in kept.tolist()], pa.int64())], [*TILE, "side", "cid"])

    early = _lists(classes, homes.select("cid"), percent)
    return _in_tiles(_tiles(homes).join(early, "cid").select(*TILE, "side", "cid", "n", "last", "lost", "early"), judge, "g long, h long, i int, j int, side int, cid long")


def _tile_links(tiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """cid, linked, root: for each class and tile in which it has links, the documents it is linked with there, and a class they lead to. sets: cid, copies, shingles."""

    def judge(at: list, tile: list[tuple]) -> pa.RecordBatch:
        side, cid, copies = (np.array([r[k] for r in tile], np.int64) for k in (0, 1, 2))
        linked, label = tile_links([np.frombuffer(r[3], np.uint64) for r in tile], side, copies, percent)
        some = linked > 0
        return pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(linked[some]), pa.array(cid[label[some]])], ["cid", "linked", "root"])

    return _in_tiles(tiles.join(sets, "cid").select(*TILE, "side", "cid", "copies", "shingles"), judge, "cid long, linked long, root long")


def components(links: DataFrame) -> DataFrame:
    """node, root (its component's least node) of every node of links (a, b); about as many rounds as the logarithm of the longest chain."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "components")
    mark = (F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)))
    before = edges.agg(*mark).first()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "components")
        drop_table(edges)
        edges, last = after, before
        before = edges.agg(*mark).first()
        if before == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def jaccard_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """members (id, cid, n) and classes (cid, rep, copies, similar, component)."""
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("salt", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.octet_length("text")))
    shingles, others = frequent(docs, n)
    summaries = materialize(_summaries(docs, n, percent, shingles.tobytes()), "jaccard-summaries")
    classes = summaries.where("n > 0").groupBy(F.col("d1").alias("cid"), "d2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("light").alias("light"), F.first("early").alias("early"))
    classes = materialize(classes, "jaccard-classes")
    members = materialize(summaries.select("id", F.col("d1").alias("cid"), "n"), "jaccard-members")
    drop_table(summaries)
    size_of = materialize(classes.select("cid", "rep", "copies"), "jaccard-sizes")
    # sizes to three digits
    short = F.expr("n - n % cast(pow(10, greatest(0, floor(log10(n)) - 2)) as long)")
    sizes = [(r.s, r["count"]) for r in classes.groupBy(short.alias("s")).count().collect()]
    x = boundary(sizes, percent, others)
    total = _signature_rows(sizes, percent, x)
    sigs, hottest = _signatures(classes, percent, x), _hottest(classes, percent, x, total)
    cold = sigs
    if hottest:
        cold = sigs.join(F.broadcast(df.sparkSession.createDataFrame([(k,) for k in hottest], "sig long")), "sig", "left_anti")
    met = materialize(_candidates(_meetings(cold, percent, x, total), percent), "jaccard-met")
    homes = _homes(met, sigs, hottest, percent)
    pairs = materialize(_apart(met.where("crowd = 0").select("a", "b"), homes), "jaccard-pairs")
    drop_table(met)
    tiles = materialize(_hopeful(homes, classes, percent), "jaccard-hopeful")
    drop_table(classes)
    drop_table(homes)
    ids = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).union(tiles.select("cid"))
    sets = materialize(_candidate_sets(docs, ids, n), "jaccard-sets")
    links = materialize(_links(sets, pairs, percent), "jaccard-links")
    drop_table(pairs)
    hopeful, tiles = tiles, materialize(_tile_links(tiles, sets.join(size_of.select("cid", "copies"), "cid"), percent), "jaccard-tiles")
    drop_table(sets)
    drop_table(hopeful)
    ends = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    similar = ends.join(size_of.select(F.col("cid").alias("b"), "copies"), "b").select(F.col("a").alias("cid"), F.col("copies").alias("linked"))
    similar = similar.unionByName(tiles.select("cid", "linked")).groupBy("cid").agg(F.sum("linked").alias("linked"))
    roots = components(links.union(tiles.select(F.col("cid").alias("a"), F.col("root").alias("b")))).select(F.col("node").alias("cid"), "root")
    named = roots.join(size_of.select("cid", "rep"), "cid").groupBy("root").agg(F.min("rep").alias("component"))
    roots = roots.join(named, "root").drop("root")
    known = size_of.join(similar, "cid", "left").join(roots, "cid", "left")
    known = known.select("cid", "rep", "copies", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("similar"), F.coalesce("component", "rep").alias("component"))
    known = materialize(known, "jaccard-known")
    for done in (links, tiles, size_of):
        drop_table(done)
    return members, known


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, n: int = 5) -> DataFrame:
    """id, n_shingles, n_similar, component_id of every row."""
    members, classes = jaccard_classes(df, id_col, text_col, percent, n)
    filled = members.where("n > 0")
    found = skew_join(filled, classes.select("cid", "copies", "similar", "component"), "cid", F.col("copies"), members.count())
    out = found.select("id", F.col("n").alias("n_shingles"), F.col("similar").alias("n_similar"), F.col("component").alias("component_id"))
    empty = members.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.lit(0).cast("long").alias("n_similar"), F.col("id").alias("component_id"))
    return out.unionByName(empty).withColumnRenamed("id", id_col)


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, n: int = 5) -> DataFrame:
    """df's rows without near duplicates: of each component one row stays, the one with the least (id, hash of the text), ids before none; empty texts all stay.

    Components follow from the texts alone: unlike rows stay, even with one id or none. Of rows equal in id and text, any one.
    The table's own columns may have any names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"))
    # a row goes by id and text, so the least one names its component and no other
    members, classes = jaccard_classes(df.select(key.alias("key"), text.alias("text")), "key", "text", percent, n)
    keep = classes.select(F.col("component").alias("key")).distinct()
    times = members.where("n > 0").groupBy(F.col("id").alias("key")).agg(F.count("*").alias("times"))
    keep = materialize(keep.join(times, "key"), "jaccard-kept")
    empty = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")) == ""
    rows = df.where(~empty).select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    kept = skew_join(rows, keep, "key", F.col("times"), members.count(), "inner")
    # equal rows are reduced where they are before they meet
    once = kept.where("times = 1").select("row").unionByName(kept.where("times > 1").groupBy("key").agg(F.first("row").alias("row")).select("row"))
    return once.select("row.*").unionByName(df.where(empty))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT w.doc_id, CAST(count(s.g) AS BIGINT) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT a AS node, b AS other FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT node, min(least(node, other)) AS component FROM r GROUP BY 1),
d AS (SELECT a, count(*) AS similar FROM l GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, CAST(coalesce(d.similar, 0) AS BIGINT) AS n_similar, coalesce(c.component, n.doc_id) AS component_id
FROM n LEFT JOIN d ON d.a = n.doc_id LEFT JOIN c ON c.node = n.doc_id
"""
