"""Completions of titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewell.conf import DEFAULT, EngineConf
from tidewell.functions.text import fold


def suggest(index: DataFrame, doc_type: str, prefix: str, limit: int | None = None, conf: EngineConf = DEFAULT) -> DataFrame:
    """Distinct titles of visible documents that begin so, folded; in order of title."""
    n = max(1, min(conf.max_suggestions, conf.default_suggestions if limit is None else int(limit)))
    rows = index.where((F.col("doc_type") == doc_type) & F.col("visible") & (F.col("title") != "") & F.startswith("folded_title", F.lit(fold(prefix.strip()))))
    return rows.select("title").distinct().orderBy("title").limit(n)
