"""python -m tidewell COMMAND --data DIR --index DIR ...: the index from the command line.

rebuild: a type's snapshot into the index; its rows that are gone are hidden, signals and other types stay
reindex: some keys (--keys a,b) pulled again       catch-up: those indexed longest ago pulled again
expire, purge: promotions past their time, tombstones past theirs
drift, health, validate, search, suggest: what is there       lint, ranking, settings: what is configured
"""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.conf import DEFAULT, EngineConf
from tidewell.functions.text import dictionary, lint
from tidewell.operators import changes
from tidewell.plans.engine import Engine
from tidewell.sources.corpora import SOURCES
from tidewell.sources.registry import disclosure

COMMANDS = ("rebuild", "reindex", "catch-up", "expire", "purge", "drift", "health", "validate", "search", "suggest", "lint", "ranking", "settings")


def _current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The index is in the folder that the file CURRENT names, so that writing the next one never disturbs a reader."""
    name = os.path.join(folder, "CURRENT")
    if not os.path.exists(name):
        return None
    with open(name, encoding="utf-8") as f:
        return spark.read.parquet(os.path.join(folder, f.read().strip()))


def _replace(folder: str, index: DataFrame, now: str) -> None:
    name = "at-" + "".join(c for c in now if c.isdigit())
    index.write.mode("overwrite").partitionBy("doc_type").parquet(os.path.join(folder, name))
    part = os.path.join(folder, "CURRENT.next")
    with open(part, "w", encoding="utf-8") as f:
        f.write(name)
    os.replace(part, os.path.join(folder, "CURRENT"))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidewell", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--data")
    p.add_argument("--index")
    p.add_argument("--type", default="listing", choices=sorted(SOURCES))
    p.add_argument("--language", default="en")
    p.add_argument("--keys", default="", help="of documents, with commas")
    p.add_argument("--prefix", default="")
    p.add_argument("--params", default="{}", help="JSON of request parameters")
    p.add_argument("--settings", help="JSON file of settings")
    a = p.parse_args(argv)
    conf = DEFAULT
    if a.settings:
        with open(a.settings, encoding="utf-8") as f:
            conf = EngineConf.of(json.load(f))
    if a.command == "lint":
        found = lint(dictionary(a.language, conf), conf)
        print("\n".join(found))
        return bool(found)
    if a.command in ("ranking", "settings"):
        print(json.dumps(disclosure() if a.command == "ranking" else asdict(conf), default=sorted))
        return 0
    spark, now = SparkSession.builder.getOrCreate(), datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    held = _current(spark, a.index)
    if a.command == "rebuild":
        built = Engine.over(spark, a.data, (a.type,), conf, indexed_at=now).index
        _replace(a.index, built if held is None else changes.rebuild(held, built.select(*held.columns), now, (a.type,)), now)
        return 0
    if held is None:
        p.error(f"no index in {a.index}")
    engine = Engine(held, conf)
    if a.command in ("reindex", "catch-up"):
        if a.command == "reindex":
            keys = spark.createDataFrame([(a.type, k) for k in a.keys.split(",") if k], "doc_type string, doc_key string")
        else:
            keys = changes.catch_up(held, now, conf).where(F.col("doc_type") == a.type)
        keys = keys.withColumns({"eid": F.lit(""), "seq": F.lit(0).cast("long")})
        source = SOURCES[a.type]
        built = Engine.built(changes.pulled(source.mapper(source.load(spark, a.data)), keys), source, conf, now).select(*held.columns)
        after, report = changes.ingest(held, built, keys, now)
        print(json.dumps(report.first().asDict()))
        _replace(a.index, after, now)
    elif a.command in ("expire", "purge"):
        _replace(a.index, changes.expired(held, now) if a.command == "expire" else changes.purged(held, now, conf), now)
    elif a.command == "drift":
        own = held.where(F.col("doc_type") == a.type).select("doc_key", F.col("source_seq").alias("seq"))
        source = SOURCES[a.type].mapper(SOURCES[a.type].load(spark, a.data)).select("doc_key", F.coalesce("source_seq", F.lit(0)).alias("seq"))
        print(json.dumps(changes.drift(own, source).first().asDict()))
    elif a.command == "health":
        print(json.dumps(engine.health(now)))
    elif a.command == "validate":
        found = engine.validate(SOURCES[a.type].load(spark, a.data) if a.data else None)
        print("\n".join(found))
        return any(f.startswith("E") for f in found)
    elif a.command == "suggest":
        print(json.dumps(engine.suggest(a.type, a.prefix), ensure_ascii=False))
    else:
        print(json.dumps(engine.search({"type": a.type} | json.loads(a.params)), default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
