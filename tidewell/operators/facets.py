"""Facet counts in one pass, and the plan of what to count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewell.conf import DEFAULT, EngineConf
from tidewell.model import CountPlan, Search
from tidewell.operators.filters import base, facet
from tidewell.sources.registry import FACET_MAPPINGS, Registry, mapping_of


def facet_plan(features: list[dict], requested: tuple[str, ...] | None = None, conf: EngineConf = DEFAULT, mappings: Registry = FACET_MAPPINGS) -> CountPlan:
    """features: {slug, config: {type, options, allowCustom}} of a category. Asked-for slugs come in their order, known ones first; the rest beyond the cap is skipped."""
    kinds: dict[str, str] = {}
    closed: dict[str, tuple[str, ...]] = {}
    for f in features:
        slug, config = f.get("slug"), f.get("config") or {}
        kind = mapping_of(config.get("type") or "", mappings).kind
        if not slug or not config.get("type") or kind == "skip":
            continue
        kinds[slug] = kind
        options = tuple(str(o["value"]) for o in config.get("options") or () if isinstance(o, dict) and o.get("value") is not None)
        if options and not config.get("allowCustom"):
            closed[slug] = options
    order = list(kinds)
    if requested is not None:
        wanted = [s for s in requested if s]
        order = sorted(wanted, key=lambda s: s not in kinds)
    taken = tuple(order[: conf.max_facet_fields])
    return CountPlan(taken, {s: kinds.get(s, "term") for s in taken}, {s: closed[s] for s in taken if s in closed}, tuple(order[conf.max_facet_fields :]))


def failing(index: DataFrame, q: Search, text=None) -> DataFrame:
    """Rows that fit all but at most one facet filter, with the slugs they fail."""
    active = [(s, v) for s, v in sorted(q.chosen.items()) if v]
    failed = F.array_compact(F.array(*[F.when(~facet(s, v), F.lit(s)) for s, v in active])) if active else F.array().cast("array<string>")
    return base(index, q, text).withColumn("failed", failed).where(F.size("failed") <= 1)


def facet_counts(index: DataFrame, q: Search, plan: CountPlan, text=None) -> DataFrame:
    """slug, value, count: each slug counted as if its own filter weren't there. One scan, one shuffle of distinct terms."""
    rows = failing(index, q, text).select("failed", F.explode("facet_terms").alias("term"))
    rows = rows.select("failed", F.substring_index("term", "=", 1).alias("slug"), F.expr("substring(term, locate('=', term) + 1)").alias("value"))
    rows = rows.where(F.col("slug").isin(*plan.slugs) if plan.slugs else F.lit(False)).where((F.size("failed") == 0) | (F.get("failed", F.lit(0)) == F.col("slug")))
    return rows.groupBy("slug", "value").agg(F.count("*").alias("count"))


def tallies(index: DataFrame, q: Search, text=None) -> DataFrame:
    """only, n: documents by the one facet filter that they fail; null: those that fail none, which are the result."""
    return failing(index, q, text).groupBy(F.get("failed", F.lit(0)).alias("only")).agg(F.count("*").alias("n"))


def facet_candidates(index: DataFrame, q: Search, plan: CountPlan, text=None) -> DataFrame:
    """slug, candidates: documents that each slug's counts are made of; documents without terms count."""
    rows = tallies(index, q, text)
    slugs = _listed(index.sparkSession, [{"slug": s} for s in plan.slugs])
    n = F.coalesce(F.sum(F.when(F.col("only").isNull() | (F.col("only") == F.col("slug")), F.col("n"))), F.lit(0))
    # both sides are a few rows: one for each slug
    return slugs.join(rows, F.col("only").isNull() | (F.col("only") == F.col("slug")), "left").groupBy("slug").agg(n.alias("candidates"))


def _listed(spark: SparkSession, rows: list[dict[str, str]]) -> DataFrame:
    """A few literal rows, without a job of their own."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows])))


def sampled(index: DataFrame, fraction: float) -> DataFrame:
    """A share of the documents, by a hash of their keys: the same ones for each page."""
    part = F.conv(F.substring(F.md5(F.col("doc_key").cast("binary")), 1, 8), 16, 10).cast("long")
    return index.where(part < int(fraction * (1 << 32)))


def sampled_counts(index: DataFrame, q: Search, plan: CountPlan, fraction: float, text=None) -> DataFrame:
    """Estimates from a sample of documents, scaled and rounded."""
    fraction = min(1.0, max(0.001, fraction))
    counts = facet_counts(sampled(index, fraction), q, plan, text)
    return counts.withColumn("count", F.round(F.col("count") / fraction).cast("long"))


def zero_filled(counts: DataFrame, plan: CountPlan) -> DataFrame:
    """With a row for every option of the closed slugs."""
    options = [{"slug": s, "value": v} for s, vs in plan.options.items() for v in vs]
    if not options:
        return counts
    listed = _listed(counts.sparkSession, options)
    return counts.join(listed, ["slug", "value"], "full_outer").select("slug", "value", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def top_values(counts: DataFrame, k: int = 200) -> DataFrame:
    """The k most frequent values of each slug, ties by value."""
    w = Window.partitionBy("slug").orderBy(F.col("count").desc(), F.col("value"))
    return counts.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k)
