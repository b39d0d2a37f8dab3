"""How an index changes: deliveries with guards, signals, expiry, tombstones, rebuilds, drift.

All are folds and joins over append-only logs; nothing is updated in place. Times are parameters, never the wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.conf import DEFAULT, EngineConf

KEY = ["doc_type", "doc_key"]


def guard_fold(log: DataFrame, payload: list[str], state: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """The last state of each key after its deliveries (arrival, seq, eid, payload...) in order of arrival, with what was skipped.

    For batches, as a key's deliveries meet in a row: `latest_by_sequence` has no such bound. A delivery with the event id last applied is a duplicate; else one with a lower number than the highest applied is stale;
    else it replaces the payload. Number 0 always applies and keeps the number known. state: what the keys held before.
    """
    keys = keys or ["doc_key"]
    body = F.struct(*payload)
    step_row = F.struct(F.col("arrival"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.coalesce("eid", F.lit("")).alias("eid"), body.alias("body"))
    grouped = log.groupBy(*keys).agg(F.array_sort(F.collect_list(step_row)).alias("log"))
    kind = log.select(body.alias("b")).schema["b"].dataType.simpleString()
    nothing = F.struct(F.lit(0).cast("long").alias("seq"), F.lit("").alias("eid"), F.lit(None).cast(kind).alias("body"), F.lit(0).alias("duplicates"), F.lit(0).alias("stale"), F.lit(0).alias("applied"))
    start = nothing
    if state is not None:
        held = state.select(*keys, F.struct(F.col("seq").cast("long").alias("seq"), F.col("eid").alias("eid"), F.struct(*payload).cast(kind).alias("body"), F.lit(0).alias("duplicates"), F.lit(0).alias("stale"), F.lit(0).alias("applied")).alias("held"))
        grouped = grouped.join(held, keys, "left")
        start = F.coalesce(F.col("held"), nothing)

    def step(acc: Column, d: Column) -> Column:
        duplicate = (d["eid"] != "") & (d["eid"] == acc["eid"])
        stale = (d["seq"] != 0) & (acc["seq"] != 0) & (d["seq"] < acc["seq"])
        return (
            F.when(duplicate, F.struct(acc["seq"].alias("seq"), acc["eid"].alias("eid"), acc["body"].alias("body"), (acc["duplicates"] + 1).alias("duplicates"), acc["stale"].alias("stale"), acc["applied"].alias("applied")))
            .when(stale, F.struct(acc["seq"].alias("seq"), acc["eid"].alias("eid"), acc["body"].alias("body"), acc["duplicates"].alias("duplicates"), (acc["stale"] + 1).alias("stale"), acc["applied"].alias("applied")))
            .otherwise(F.struct(F.when(d["seq"] != 0, d["seq"]).otherwise(acc["seq"]).alias("seq"), d["eid"].alias("eid"), d["body"].alias("body"), acc["duplicates"].alias("duplicates"), acc["stale"].alias("stale"), (acc["applied"] + 1).alias("applied")))
        )

    folded = grouped.select(*keys, F.aggregate("log", start, step).alias("s"))
    return folded.select(*keys, "s.seq", "s.eid", "s.duplicates", "s.stale", "s.applied", *[F.col(f"s.body.{c}").alias(c) for c in payload])


def latest_by_sequence(log: DataFrame, payload: list[str], keys: list[str] | None = None) -> DataFrame:
    """The same winner without what was skipped, by aggregates alone, so that a key with any number of deliveries is reduced where they are:
    the last delivery with the highest number, or the last one with number 0, whichever came later."""
    keys = keys or ["doc_key"]
    number = F.coalesce("seq", F.lit(0))
    row = F.struct("arrival", *payload)
    numbered, free = F.when(number != 0, row), F.when(number == 0, row)
    found = log.groupBy(*keys).agg(F.max_by(numbered, F.when(number != 0, F.struct(number.alias("seq"), F.col("arrival")))).alias("a"), F.max_by(free, F.when(number == 0, F.col("arrival"))).alias("b"), F.max(number).alias("seq"))
    later = F.when(F.col("a").isNull() | F.coalesce(F.col("b.arrival") > F.col("a.arrival"), F.lit(False)), F.col("b")).otherwise(F.col("a"))
    return found.select(*keys, later.alias("w"), "seq").select(*keys, *[F.col(f"w.{c}").alias(c) for c in payload], "seq")


def _keys(*tables: DataFrame) -> list[str]:
    """What names a document in all of the tables: type and key, or the key alone where a table of one type doesn't say which."""
    return [k for k in KEY if all(k in t.columns for t in tables)]


def folded_signals(log: DataFrame) -> DataFrame:
    """Of each document boost (held to -1..5), popularity, promoted, promotion_expires_at: the last writer of each kind by arrival, null where none wrote.
    A repeated id counts once, as it came first; a missing or empty id repeats nothing."""
    keys = _keys(log)
    named = log.where("sig_id <> ''").groupBy("sig_id").agg(*[F.min_by(c, "arrival").alias(c) for c in (*keys, "kind", "value", "expires_at")], F.min("arrival").alias("arrival"))
    once = named.unionByName(log.where("coalesce(sig_id, '') = ''").select(named.columns))
    of = lambda kind, c: F.max_by(F.when(F.col("kind") == kind, F.col(c)), F.when(F.col("kind") == kind, F.col("arrival")))
    out = once.groupBy(*keys).agg(of("boost", "value").alias("boost"), of("popularity", "value").alias("popularity"), of("promoted", "value").alias("promoted"), of("promoted", "expires_at").alias("promotion_expires_at"))
    # greatest and least pass nulls over
    held = F.when(F.col("boost").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(5.0), F.col("boost"))))
    return out.select(*keys, held.alias("boost"), F.col("popularity").cast("int").alias("popularity"), (F.col("promoted") != 0).alias("promoted"), "promotion_expires_at")


def last_signals(log: DataFrame) -> DataFrame:
    """folded_signals() with what holds where none wrote."""
    none = {"boost": F.lit(0.0), "popularity": F.lit(0), "promoted": F.lit(False)}
    return folded_signals(log).withColumns({c: F.coalesce(F.col(c), v) for c, v in none.items()})


SIGNALS = ["popularity", "boost", "promoted", "promotion_expires_at"]


def with_signals(index: DataFrame, signals: DataFrame) -> DataFrame:
    """Signal columns (folded_signals) over an index whose documents don't own them; what no signal is about stays."""
    keys = _keys(index, signals)
    s = signals.select(*keys, *[F.col(c).alias(f"_{c}") for c in SIGNALS])
    out = index.join(s, keys, "left")
    new = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in SIGNALS}
    # an expiry goes with the promotion it came with
    new["promotion_expires_at"] = F.when(F.col("_promoted").isNotNull(), F.col("_promotion_expires_at")).otherwise(F.col("promotion_expires_at"))
    return out.withColumns(new).select(*index.columns)


def signal_audit(index: DataFrame, log: DataFrame) -> DataFrame:
    """The log's rows, repeated ids but once, with whether the index has the document: what a signal did is never invisible."""
    keys = _keys(index, log)
    first = F.row_number().over(Window.partitionBy("sig_id").orderBy("arrival")) == 1
    named = log.where("sig_id <> ''").withColumn("_first", first).where("_first").drop("_first")
    once = named.unionByName(log.where("coalesce(sig_id, '') = ''"))
    return once.join(index.select(*keys, F.lit(True).alias("applied")), keys, "left").withColumn("applied", F.coalesce("applied", F.lit(False)))


def expired(df: DataFrame, as_of: str) -> DataFrame:
    """Promotions past their time are over, boosts of any sign with them."""
    gone = F.coalesce(F.col("promotion_expires_at") <= F.lit(as_of).cast("timestamp"), F.lit(False)) & (F.col("promoted") | (F.col("boost") != 0))
    return df.withColumns({"promoted": F.col("promoted") & ~gone, "boost": F.when(gone, 0.0).otherwise(F.col("boost")), "promotion_expires_at": F.when(~gone, F.col("promotion_expires_at"))})


def pulled(source: DataFrame, keys: DataFrame) -> DataFrame:
    """The source's documents of some keys."""
    on = _keys(source, keys)
    return source.join(keys.select(*on).distinct(), on, "left_semi")


def missing_keys(source: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys asked for that the source no longer has: to be tombstoned."""
    on = _keys(source, keys)
    return keys.select(*on).distinct().join(source, on, "left_anti")


def tombstones(index: DataFrame, gone: DataFrame, at: str) -> DataFrame:
    """index with the rows of gone's keys hidden, and when; rows of the same key but another type stay."""
    on = _keys(index, gone)
    marked = index.join(gone.select(*on, F.lit(True).alias("_gone")).distinct(), on, "left")
    return marked.withColumn("visible", F.col("visible") & F.col("_gone").isNull()).withColumn("indexed_at", F.when(F.col("_gone").isNotNull(), F.lit(at).cast("timestamp")).otherwise(F.col("indexed_at"))).select(*index.columns)


def keeping_signals(built: DataFrame, index: DataFrame) -> DataFrame:
    """built's rows with what signals gave the rows that index has in their place."""
    own = index.select(*KEY, F.lit(True).alias("_old"), *[F.col(c).alias(f"_{c}") for c in SIGNALS])
    out = built.join(own, KEY, "left")
    return out.withColumns({c: F.when(F.col("_old"), F.col(f"_{c}")).otherwise(F.col(c)) for c in SIGNALS}).select(*built.columns)


#: What an ingest reports.
REPORT = ("indexed", "removed", "missing", "duplicate", "stale", "truncated")


def merged(*reports: DataFrame) -> DataFrame:
    """Several reports as one."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in REPORT])


def ingest(index: DataFrame, built: DataFrame, keys: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """The index after some keys (doc_type, doc_key, eid, seq) were pulled as `built`: rows that pass the guards replaced, keys gone from the source hidden.

    Also one row of what happened (REPORT): missing are keys that the source hasn't, removed those of them that the index has.
    """
    if missing := [c for c in (*KEY, "eid", "seq") if c not in keys.columns]:
        raise ValueError(f"keys without {', '.join(missing)}")
    fresh = built.join(keys.groupBy(*KEY).agg(F.max_by("eid", "seq").alias("_eid"), F.max("seq").alias("_seq")), KEY)
    old = index.select(*KEY, F.col("source_event_id").alias("_old_eid"), F.col("source_seq").alias("_old_seq"))
    judged = fresh.join(old, KEY, "left")
    duplicate = F.coalesce((F.col("_eid") != "") & (F.col("_eid") == F.col("_old_eid")), F.lit(False))
    stale = ~duplicate & F.coalesce((F.col("_seq") != 0) & (F.col("_old_seq") != 0) & (F.col("_seq") < F.col("_old_seq")), F.lit(False))
    judged = judged.withColumn("_duplicate", duplicate).withColumn("_stale", stale)
    seq = F.when(F.col("_seq") != 0, F.col("_seq")).otherwise(F.coalesce("_old_seq", F.lit(0)))
    taken = judged.where(~F.col("_duplicate") & ~F.col("_stale")).withColumns({"source_seq": seq, "source_event_id": F.coalesce("_eid", F.lit("")), "indexed_at": F.lit(at).cast("timestamp")})
    taken = keeping_signals(taken.select(*index.columns), index)
    gone = keys.select(*KEY).distinct().join(built.select(*KEY), KEY, "left_anti")
    after = tombstones(index.join(taken.select(*KEY), KEY, "left_anti"), gone, at).unionByName(taken)
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    report = judged.agg(n(~F.col("_duplicate") & ~F.col("_stale")).alias("indexed"), n(F.col("_duplicate")).alias("duplicate"), n(F.col("_stale")).alias("stale"), F.coalesce(F.sum("truncated_terms"), F.lit(0)).alias("truncated"))
    lost = gone.join(index.select(*KEY, F.lit(1).alias("_had")), KEY, "left").agg(F.count("*").alias("missing"), F.count("_had").alias("removed"))
    return after, report.withColumn("_one", F.lit(1)).join(lost.withColumn("_one", F.lit(1)), "_one").select(*REPORT)


def not_seen(index: DataFrame, source: DataFrame) -> DataFrame:
    """Visible rows that a full snapshot lacks: what a rebuild hides."""
    return index.where("visible").join(source.select(*KEY), KEY, "left_anti")


def rebuild(index: DataFrame, built: DataFrame, at: str, doc_types: tuple[str, ...] | None = None) -> DataFrame:
    """The snapshot's rows with the signals of the old ones, and the old rows it lacks as tombstones; types that it isn't of stay as they are.

    doc_types: what the snapshot is of; by default the types it has rows of.
    """
    if doc_types is None:
        own = index.join(F.broadcast(built.select("doc_type").distinct()), "doc_type", "left_semi")
        other = index.join(F.broadcast(built.select("doc_type").distinct()), "doc_type", "left_anti")
    else:
        own, other = (index.where(c) for c in (F.col("doc_type").isin(*doc_types), ~F.col("doc_type").isin(*doc_types)))
    old = own.join(built.select(*KEY), KEY, "left_anti")
    hidden = old.withColumn("indexed_at", F.when(F.col("visible"), F.lit(at).cast("timestamp")).otherwise(F.col("indexed_at"))).withColumn("visible", F.lit(False))
    rows = keeping_signals(built.withColumn("indexed_at", F.lit(at).cast("timestamp")), own)
    return rows.unionByName(hidden).unionByName(other.select(*rows.columns))


def recategorised(index: DataFrame, categories: DataFrame) -> DataFrame:
    """index with the paths (category_id, path) of categories that have changed, for rows whose path ends in one of them."""
    new = categories.select(F.col("category_id").alias("_leaf"), F.col("path").alias("_path"))
    out = index.withColumn("_leaf", F.element_at(F.when(F.size("category_path") > 0, F.col("category_path")), -1)).join(new, "_leaf", "left")
    return out.withColumn("category_path", F.coalesce("_path", "category_path")).select(*index.columns)


def drift(index: DataFrame, source: DataFrame) -> DataFrame:
    """One row: keys on either side, missing here, surplus here, stale (a lower number here, or none), in_sync."""
    on = _keys(source, index)
    a = source.select(*on, F.col("seq").alias("_source"), F.lit(1).alias("_s"))
    b = index.select(*on, F.col("seq").alias("_own"), F.lit(1).alias("_i"))
    both = a.join(b, on, "full_outer")
    count = lambda c: F.count(F.when(c, 1))
    stale = F.col("_s").isNotNull() & (F.coalesce("_own", F.lit(-1)) < F.col("_source"))
    out = both.agg(count(F.col("_s").isNotNull()).alias("source_rows"), count(F.col("_i").isNotNull()).alias("index_rows"), count(F.col("_i").isNull()).alias("missing"), count(F.col("_s").isNull()).alias("surplus"), count(stale).alias("stale"))
    return out.withColumn("in_sync", (F.col("source_rows") == F.col("index_rows")) & (F.col("stale") == 0))


def catch_up(index: DataFrame, as_of: str, conf: EngineConf = DEFAULT) -> DataFrame:
    """Keys to pull again: indexed longest ago first, from rows that have a source time within ten years."""
    now = F.lit(as_of).cast("timestamp")
    return index.where(F.col("source_updated_at").isNotNull() & (F.col("source_updated_at") > now - F.expr("INTERVAL 3650 DAYS"))).orderBy("indexed_at", "doc_key").limit(conf.catch_up_limit).select(*KEY)


def purged(index: DataFrame, as_of: str, conf: EngineConf = DEFAULT) -> DataFrame:
    """Without tombstones older than their retention."""
    old = ~F.col("visible") & (F.col("indexed_at") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {conf.tombstone_days} DAYS"))
    return index.where(~F.coalesce(old, F.lit(False)))


def erased(index: DataFrame, owners: DataFrame) -> DataFrame:
    """Without anything of some owners, of every type."""
    return index.join(owners.select("owner_key").where("owner_key <> ''").distinct(), "owner_key", "left_anti")


def health(index: DataFrame, as_of: str) -> DataFrame:
    """doc_type, documents, lag_seconds since the newest row."""
    lag = F.timestamp_diff("SECOND", F.max("indexed_at"), F.lit(as_of).cast("timestamp"))
    return index.where("visible").groupBy("doc_type").agg(F.count("*").alias("documents"), lag.alias("lag_seconds"))
