"""The change paths as streams: each batch is folded into a state in buckets of keys.

foreachBatch runs at least once. A batch writes the buckets that it touches under its own number, reads those before it,
and so replaces itself when it is repeated; a state's bucket is that of the highest number. What two later batches have
replaced is removed, so that a batch costs what it touches and disk holds two states at most. Late means late by
sequence number, not by time: no watermark drops rows, the guards do.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators import changes
from tidewell.sources import events as inbound
from tidewell.sources.registry import Registry

BUCKETS = 64
#: Milliseconds of the years 1 to 9999. A number of an event that is beyond them still orders it, but is no time.
TIMES = (-62_135_596_800_000, 253_402_300_799_999)


def bucket_of(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, folder: str) -> dict[int, list[int]]:
    """bucket -> numbers of the batches that wrote it and ended, rising."""
    path, fs = _files(spark, folder)
    out: dict[int, list[int]] = defaultdict(list)
    if fs.exists(path):
        for s in fs.listStatus(path):
            m = re.fullmatch(r"v=(\d+)", s.getPath().getName())
            if not m or not fs.exists(_files(spark, f"{folder}/{m[0]}/_SUCCESS")[0]):
                continue
            for b in fs.listStatus(s.getPath()):
                if n := re.fullmatch(r"bucket=(\d+)", b.getPath().getName()):
                    out[int(n[1])].append(int(m[1]))
    return {b: sorted(v) for b, v in out.items()}


def state(spark: SparkSession, folder: str, before: int | None = None, buckets: set[int] | None = None) -> DataFrame | None:
    """What the batches (those before one) have left, of some buckets or of all; None if nothing."""
    paths = []
    for b, versions in sorted(_versions(spark, folder).items()):
        known = [v for v in versions if before is None or v < before]
        if known and (buckets is None or b in buckets):
            paths.append(f"{folder}/v={known[-1]}/bucket={b}")
    return spark.read.parquet(*paths) if paths else None


def _store(rows: DataFrame, folder: str, number: int, keys: list[str], read: set[int] | None = None) -> None:
    """read: the buckets that the batch had before it, None for all: those without rows now are written as empty ones."""
    spark = rows.sparkSession
    before = {b for b, v in _versions(spark, folder).items() if any(n < number for n in v)}
    # few files for a small bucket, tasks of the usual size for a large one
    rows.withColumn("bucket", bucket_of(*keys)).hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/v={number}")
    for b in before if read is None else before & read:
        path, fs = _files(spark, f"{folder}/v={number}/bucket={b}")
        if not fs.exists(path):
            spark.createDataFrame([], rows.schema).coalesce(1).write.parquet(f"{folder}/v={number}/bucket={b}")
    for b, versions in _versions(spark, folder).items():
        # the batch may come again and then reads what was before it
        kept = {versions[-1], *[v for v in versions if v < number][-1:]}
        for v in versions:
            if v not in kept:
                path, fs = _files(spark, f"{folder}/v={v}/bucket={b}")
                fs.delete(path, True)


def _touched(keys: DataFrame, *names: str) -> set[int]:
    """At most BUCKETS numbers."""
    return {r.b for r in keys.select(bucket_of(*names).alias("b")).distinct().collect()}


def ingest_stream(deliveries: DataFrame, payload: list[str], folder: str, checkpoint: str) -> StreamingQuery:
    """Deliveries (doc_key, arrival, seq, eid, payload) into the last state of each key."""
    keep = ["doc_key", "seq", "eid", *payload]

    def apply(batch: DataFrame, number: int) -> None:
        batch.persist()
        held = state(batch.sparkSession, folder, number, _touched(batch, "doc_key"))
        # what is held came before all that arrives
        known = [] if held is None else [held.withColumn("arrival", F.lit(-1).cast("long"))]
        log = batch.select("doc_key", F.col("arrival").cast("long").alias("arrival"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), "eid", *payload)
        for k in known:
            log = log.unionByName(k)
        _store(changes.latest_by_sequence(log, ["eid", *payload]).select(*keep), folder, number, ["doc_key"], set())
        batch.unpersist()

    return deliveries.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_stream(events: DataFrame, sources: Registry, pull: Callable[[str, DataFrame], DataFrame], folder: str, checkpoint: str, paths: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Events (inbound.ENVELOPE) into an index: documents that an event names are pulled and ingested, signals applied, owners erased, categories renamed.

    pull(doc_type, keys): index rows of the keys that the source still has. paths(category ids): category_id, path of changed categories.
    Times are those of the events, never the wall clock's.
    """
    inbound.wire(sources)

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        last = batch.agg(F.max(F.when(F.col("timestamp").between(*TIMES), F.col("timestamp")))).first()[0] or 0
        at = spark.range(1).select(F.date_format(F.timestamp_millis(F.lit(last)), "yyyy-MM-dd HH:mm:ss")).first()[0]
        keys = None
        for s in sources.values():
            one = inbound.keys_of(batch, s)
            keys = one if keys is None else keys.unionByName(one)
        signals, owners, moved = inbound.signals_of(batch), inbound.deleted_owners(batch), inbound.changed_categories(batch)
        everywhere = not owners.isEmpty() or paths is not None and not moved.isEmpty()
        buckets = None if everywhere else _touched(keys.select(*changes.KEY).union(signals.select(*changes.KEY)), *changes.KEY)
        built = None
        for name in sources:
            rows = pull(name, keys.where(F.col("doc_type") == name))
            built = rows if built is None else built.unionByName(rows)
        held = state(spark, folder, number, buckets)
        index = built.limit(0) if held is None else held.select(*built.columns)
        after, _ = changes.ingest(index, built, keys, at)
        after = changes.with_signals(after, changes.folded_signals(signals))
        if everywhere:
            after = changes.erased(after, owners).select(*built.columns)
            if paths is not None:
                after = changes.recategorised(after, paths(moved))
        _store(after, folder, number, changes.KEY, buckets)
        batch.unpersist()

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def signal_stream(signals: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Signals are appended as they come, once for each batch; their state is last_signals() of all that came."""

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return signals.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def signal_state(spark: SparkSession, folder: str) -> DataFrame:
    return changes.last_signals(spark.read.parquet(folder).drop("batch"))
