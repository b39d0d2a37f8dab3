"""Input documents to index rows; every derived column is a Catalyst expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.conf import DEFAULT, EngineConf
from tidewell.functions.geo import geohash_col
from tidewell.functions.stem import stems_col
from tidewell.functions.text import fold_col
from tidewell.sources.registry import FACET_MAPPINGS, OTHER_TYPE, Registry


def _by_type(kind: Column, mappings: Registry, pick, other) -> Column:
    out: Column | None = None
    for name, m in mappings.items():
        out = F.when(kind == name, pick(m)) if out is None else out.when(kind == name, pick(m))
    return out.otherwise(other)


def _full(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def facet_columns(features: Column, fallback: Column | None = None, conf: EngineConf = DEFAULT, mappings: Registry = FACET_MAPPINGS) -> tuple[Column, Column, Column, Column]:
    """facets, facet_terms (distinct, in order), numbers, terms cut for length."""
    entries = F.coalesce(F.map_entries(features), F.array().cast("array<struct<key:string,value:struct<type:string,scalar:string,list:array<string>,simple:string>>>"))

    def extracted(e: Column) -> Column:
        kind = F.coalesce(e["value"]["type"], F.lit(""))
        return F.struct(
            e["key"].alias("slug"),
            _by_type(kind, mappings, lambda m: F.lit(m.kind), F.lit(OTHER_TYPE.kind)).alias("kind"),
            _by_type(kind, mappings, lambda m: F.lit(m.numeric), F.lit(False)).alias("numeric"),
            _full(_by_type(kind, mappings, lambda m: m.values(e["value"]), OTHER_TYPE.values(e["value"]))).alias("values"),
        )

    read = F.filter(F.transform(entries, extracted), lambda e: (e["kind"] != "skip") & (F.size(e["values"]) > 0))

    def terms_of(e: Column) -> Column:
        paths = F.transform(F.sequence(F.lit(1), F.size(e["values"])), lambda i: F.concat(e["slug"], F.lit("="), F.array_join(F.slice(e["values"], F.lit(1), i), "/")))
        plain = F.transform(e["values"], lambda v: F.concat(e["slug"], F.lit("="), v))
        return F.when(e["kind"] == "path", paths).when(e["kind"] == "term", plain).otherwise(F.array().cast("array<string>"))

    whole = F.flatten(F.transform(read, terms_of))
    facets = F.map_from_entries(F.transform(read, lambda e: F.struct(e["slug"], e["values"])))
    valued = F.transform(F.filter(read, lambda e: e["numeric"]), lambda e: F.struct(e["slug"].alias("slug"), F.get(e["values"], F.lit(0)).try_cast("decimal(18,6)").alias("value")))
    numbers = F.map_from_entries(F.filter(valued, lambda e: e["value"].isNotNull()))
    if fallback is not None and conf.accept_features_search:
        lossy = F.filter(F.transform(F.map_entries(fallback), lambda e: F.struct(e["key"].alias("slug"), F.lit("term").alias("kind"), F.lit(False).alias("numeric"), _full(F.coalesce(e["value"], F.array().cast("array<string>"))).alias("values"))), lambda e: F.size(e["values"]) > 0)
        alone = (F.size(entries) == 0) & fallback.isNotNull()
        whole = F.when(alone, F.flatten(F.transform(lossy, terms_of))).otherwise(whole)
        facets = F.when(alone, F.map_from_entries(F.transform(lossy, lambda e: F.struct(e["slug"], e["values"])))).otherwise(facets)
    cut = F.size(F.filter(whole, lambda t: F.length(t) > conf.max_term_chars))
    return facets, F.array_distinct(F.transform(whole, lambda t: F.substring(t, 1, conf.max_term_chars))), numbers, cut


def build_index(df: DataFrame, conf: EngineConf = DEFAULT, visible_statuses: tuple[str, ...] | None = None, mappings: Registry = FACET_MAPPINGS) -> DataFrame:
    """One index row for each input document. Signal columns start at nothing; a popularity column of the input is kept."""
    facets, terms, numbers, cut = facet_columns(F.col("features"), F.col("features_search"), conf, mappings)
    extra = F.array_join(F.filter(F.coalesce(F.col("text_extra"), F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != "")), " ")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    plain = [fold_col(text("title")), fold_col(extra), fold_col(text("body"))]
    path = F.coalesce(F.filter(F.col("category_path"), lambda p: p.isNotNull()), F.when(F.col("category_id").isNotNull(), F.array("category_id")), F.array().cast("array<string>"))
    return df.select(
        "doc_type",
        F.col("doc_key").cast("string").alias("doc_key"),
        F.coalesce(F.col("status").isin(*(visible_statuses or conf.visible_statuses)), F.lit(False)).alias("visible"),
        text("language").alias("language"),
        text("owner_key").alias("owner_key"),
        path.alias("category_path"),
        text("title").alias("title"),
        text("body").alias("body"),
        extra.alias("text_extra"),
        plain[0].alias("folded_title"),
        plain[1].alias("folded_extra"),
        F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in plain]).alias("text_plain"),
        stems_col(F.concat_ws(" ", text("title"), extra, text("body")), text("language"), conf).alias("stems"),
        facets.alias("facets"),
        terms.alias("facet_terms"),
        numbers.alias("numbers"),
        cut.alias("truncated_terms"),
        "price_base",
        "published_at",
        (F.coalesce(F.col("popularity"), F.lit(0)) if "popularity" in df.columns else F.lit(0)).cast("int").alias("popularity"),
        "lat",
        "lon",
        F.coalesce(geohash_col(F.col("lat"), F.col("lon")), F.lit("")).alias("geohash"),
        F.lit(0.0).alias("boost"),
        F.lit(False).alias("promoted"),
        F.lit(None).cast("timestamp").alias("promotion_expires_at"),
        "card",
        F.coalesce(F.col("source_seq"), F.lit(0)).alias("source_seq"),
        text("source_event_id").alias("source_event_id"),
        "source_updated_at",
    )


def attach_category_path(df: DataFrame, categories: DataFrame) -> DataFrame:
    """Paths by category id (category_id, path) where the source gave none; the id alone where none is known."""
    known = categories.select("category_id", F.col("path").alias("_path"))
    out = df.join(known, "category_id", "left")
    return out.withColumn("category_path", F.coalesce("category_path", "_path", F.when(F.col("category_id").isNotNull(), F.array("category_id")))).drop("_path")


def unplaced(df: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Rows with a category and no path, neither their own nor a known one: they are found under their category alone."""
    bare = df.where("category_id IS NOT NULL AND category_path IS NULL")
    return bare if categories is None else bare.join(categories.select("category_id"), "category_id", "left_anti")


def defaulted_types(df: DataFrame, mappings: Registry = FACET_MAPPINGS) -> DataFrame:
    """Attribute types without a mapping, which are treated as terms."""
    types = df.select(F.explode(F.map_values("features")).alias("f")).select(F.col("f.type").alias("type"))
    return types.where(~F.col("type").isin(*mappings)).groupBy("type").count()
