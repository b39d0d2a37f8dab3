"""What arrives from outside: payload types by event name, and which keys an event is about."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewell.sources.registry import Registry, Source

ENVELOPE = "event_id string, event_name string, timestamp bigint, payload string"
PAYLOADS = {
    "search.signal": "doc_type string, doc_key string, boost double, popularity int, promoted boolean, expires_at timestamp",
    "category.changed": "category_id string, revision bigint",
    "user.deleted": "user_id string",
    "listing.published": "listing_id string",
    "listing.updated": "listing_id string",
    "listing.removed": "listing_id string",
}


def keys_of(events: DataFrame, source: Source) -> DataFrame:
    """doc_type, doc_key, eid, seq (the event's milliseconds) of the events that a source listens to; those without a key are left out."""
    fields = F.from_json("payload", ", ".join(f"{f} string" for f in source.key_fields))
    key = F.coalesce(*[F.nullif(fields[f], F.lit("")) for f in source.key_fields])
    wanted = events.where(F.col("event_name").isin(*source.signals)) if source.signals else events.limit(0)
    return wanted.select(F.lit(source.doc_type).alias("doc_type"), key.alias("doc_key"), F.coalesce("event_id", F.lit("")).alias("eid"), F.coalesce("timestamp", F.lit(0)).cast("long").alias("seq")).where("doc_key IS NOT NULL")


def signals_of(events: DataFrame) -> DataFrame:
    """search.signal events as a signal log: one row a kind, in the columns that last_signals() reads; those without type or key are left out.
    An event without an id gives signals without one."""
    p = F.from_json("payload", PAYLOADS["search.signal"])
    rows = events.where("event_name = 'search.signal'").select("event_id", "timestamp", p.alias("p"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"p.{k}").cast("double").alias("value")) for k in ("boost", "popularity", "promoted")])
    each = rows.select("event_id", "timestamp", "p", F.explode(kinds).alias("k")).where("k.value IS NOT NULL AND p.doc_key <> '' AND p.doc_type <> ''")
    return each.select(F.col("timestamp").alias("arrival"), F.when(F.col("event_id") != "", F.concat_ws(":", "event_id", "k.kind")).otherwise("").alias("sig_id"), F.col("p.doc_type").alias("doc_type"), F.col("p.doc_key").alias("doc_key"), F.col("k.kind").alias("kind"), F.col("k.value").alias("value"), F.col("p.expires_at").alias("expires_at"))


def deleted_owners(events: DataFrame) -> DataFrame:
    """owner_key of user.deleted events: what erased() takes."""
    return events.where("event_name = 'user.deleted'").select(F.from_json("payload", PAYLOADS["user.deleted"])["user_id"].alias("owner_key")).where("owner_key IS NOT NULL")


def changed_categories(events: DataFrame) -> DataFrame:
    """category_id and the highest revision of category.changed events."""
    p = F.from_json("payload", PAYLOADS["category.changed"])
    return events.where("event_name = 'category.changed'").select(p.alias("p")).where("p.category_id <> ''").groupBy(F.col("p.category_id").alias("category_id")).agg(F.max(F.coalesce("p.revision", F.lit(0))).alias("revision"))


def without_key(events: DataFrame, sources: Registry) -> DataFrame:
    """event_name, event_id of events that a source listens to and that name no document: what `keys_of` leaves out."""
    out = None
    for s in sources.values():
        fields = F.from_json("payload", ", ".join(f"{f} string" for f in s.key_fields))
        bad = events.where(F.col("event_name").isin(*s.signals) if s.signals else F.lit(False)).where(F.coalesce(*[F.nullif(fields[f], F.lit("")) for f in s.key_fields]).isNull())
        one = bad.select(F.lit(s.doc_type).alias("doc_type"), "event_name", "event_id")
        out = one if out is None else out.unionByName(one)
    return out


def check_wiring(sources: Registry) -> list[str]:
    """Findings: sources that can't be wired, and events that a source listens to and nobody has described."""
    bad = [f"E004:{name}:mapper" for name, s in sources.items() if not callable(s.mapper)]
    return bad + [f"E004:{name}:{event}" for name, s in sources.items() for event in s.signals if event not in PAYLOADS]


def wire(sources: Registry) -> Registry:
    """The sources, if all of them can be wired; else a refusal that names what can't."""
    if found := check_wiring(sources):
        raise ValueError(", ".join(found))
    return sources
