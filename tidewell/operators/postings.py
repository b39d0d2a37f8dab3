"""Postings: which documents have a stem, as a table of its own in segments, so that a search of words reads the rows of its stems alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidewell.conf import DEFAULT, EngineConf
from tidewell.functions.stem import stem_groups
from tidewell.model import Words


def postings(index: DataFrame) -> DataFrame:
    """doc_type, doc_key, stem of visible documents."""
    return index.where("visible").select("doc_type", "doc_key", F.explode("stems").alias("stem"))


def store(index: DataFrame, folder: str) -> DataFrame:
    """Postings as segments: each partition of the index sorts its own by stem, nothing is moved. A filter on a stem reads of each file the pages that have it."""
    rows = postings(index).sortWithinPartitions("doc_type", "stem", "doc_key")
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("doc_type").parquet(folder)
    return index.sparkSession.read.parquet(folder)


def matching(table: DataFrame, doc_type: str, q: Words, language: str, conf: EngineConf = DEFAULT) -> DataFrame:
    """doc_key of the documents in which every group has a member; none if a group has no stems."""
    groups = stem_groups(q.groups, language, conf)
    if not all(groups):
        return table.select("doc_key").limit(0)
    wanted = sorted({s for g in groups for s in g})
    rows = table.where((F.col("doc_type") == doc_type) & F.col("stem").isin(*wanted))
    met = [F.max(F.col("stem").isin(*g).cast("int")).alias(f"g{k}") for k, g in enumerate(groups)]
    every = reduce(lambda a, b: a & b, [F.col(f"g{k}") == 1 for k in range(len(groups))])
    return rows.groupBy("doc_key").agg(*met).where(every).select("doc_key")


def search(index: DataFrame, table: DataFrame, doc_type: str, q: Words, language: str, conf: EngineConf = DEFAULT) -> DataFrame:
    """The index's rows that match, by a semi-join."""
    return index.where((F.col("doc_type") == doc_type) & F.col("visible")).join(matching(table, doc_type, q, language, conf), "doc_key", "left_semi")
