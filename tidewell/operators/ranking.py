"""Scores, sort values, and pages cut at a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions.covers import cover_density
from tidewell.functions.geo import haversine_col
from tidewell.functions.text import tokens_col
from tidewell.model import Cursor, Search
from tidewell.operators.filters import text_score
from tidewell.sources.registry import SCORERS, Registry, scorers_for

#: sort -> (column, descending)
ORDERS = {"relevance": ("score", True), "newest": ("published_at", True), "price_asc": ("price_base", False), "price_desc": ("price_base", True), "distance": ("distance_km", False)}


def scored(df: DataFrame, q: Search, scorers: Registry = SCORERS) -> DataFrame:
    """df with distance_km and score, rounded before anything is ordered by them. q.as_of stands for now."""
    distance = haversine_col(F.col("lat"), F.col("lon"), q.centre.lat, q.centre.lon) if q.centre else F.lit(None).cast("double")
    df = df.withColumn("distance_km", F.round(distance, 6))
    now = F.lit(q.as_of).cast("timestamp") if q.as_of else F.current_timestamp()
    context: dict[str, Column] = {"text_score": text_score(q.words), "distance_km": F.col("distance_km"), "boost": F.col("boost"), "popularity": F.col("popularity"), "published_at": F.col("published_at").cast("timestamp"), "as_of": now, "category_path": F.col("category_path"), "facet_terms": F.col("facet_terms")}
    if q.words and "body" in df.columns:  # read by scorers that ask for it, and by no others
        context["covers"] = cover_density(tokens_col(F.concat_ws(" ", "title", "text_extra", "body")), q.words.groups)
    else:
        context["covers"] = F.lit(0.0)
    total = F.lit(0.0)
    for s in scorers_for(q.sort, scorers):
        if s.expr is not None:
            total = total + F.lit(s.weight) * s.expr(context)
    return df.withColumn("score", F.round(total, 6))


def ordering(sort: str, backwards: bool = False) -> list[Column]:
    """Nulls last either way, then by key; backwards: the exact mirror."""
    name, down = ORDERS[sort]
    if backwards:
        return [F.col(name).asc_nulls_first() if down else F.col(name).desc_nulls_first(), F.col("doc_key").desc()]
    return [F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_last(), F.col("doc_key").asc()]


def sort_value(sort: str) -> Column:
    name = ORDERS[sort][0]
    if sort == "newest":
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.col(name).cast("string")


def behind(sort: str, cursor: Cursor, backwards: bool = False) -> Column:
    """Rows strictly after the cursor's row, or before it."""
    name, down = ORDERS[sort]
    column, key = F.col(name), F.col("doc_key")
    if cursor.sort_value is None:
        return (column.isNotNull() | (key < cursor.doc_key)) if backwards else column.isNull() & (key > cursor.doc_key)
    kind = {"score": "double", "distance_km": "double", "published_at": "timestamp", "price_base": "decimal(12,2)"}[name]
    anchor = F.lit(str(cursor.sort_value)).cast(kind)
    column = column.cast(kind)
    further = (column < anchor) if down != backwards else (column > anchor)
    tied = (column == anchor) & ((key < cursor.doc_key) if backwards else (key > cursor.doc_key))
    return F.coalesce(further | tied, F.lit(False)) if backwards else F.coalesce(further | tied, F.lit(True))


def page(df: DataFrame, q: Search, extra: int = 0) -> DataFrame:
    """A page of scored rows, `extra` rows more to look ahead, in order; a top-k in each partition and no full sort."""
    backwards = q.backwards and q.cursor is not None
    if q.cursor is not None:
        df = df.where(behind(q.sort, q.cursor, backwards))
    out = df.orderBy(*ordering(q.sort, backwards)).limit(q.limit + extra)
    return out.orderBy(*ordering(q.sort)) if backwards else out


def total(df: DataFrame, cap: int | None = None) -> tuple[int, bool]:
    """Number of rows and whether it is exact; with a cap, counting stops one beyond it."""
    if cap is None:
        return df.count(), True
    n = df.limit(cap + 1).count()
    return n, n <= cap
