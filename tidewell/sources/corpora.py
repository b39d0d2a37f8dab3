"""Corpora over the star-schema tables: listings, documents, pages, and logs of signals and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.sources.registry import Registry, Source

#: Runs unchanged in Spark SQL and DuckDB.
LISTING = """
SELECT CAST(p.p_partkey AS string) AS doc_key,
  CASE WHEN p.p_partkey % 17 = 0 THEN 'draft' ELSE 'published' END AS status,
  CASE p.p_partkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE '' END AS language,
  coalesce(concat('s', CAST(a.supp AS string)), '') AS owner_key, r.r_name AS region, n.n_name AS nation,
  p.p_name AS title, concat(p.p_brand, ' ', p.p_type) AS text_extra, '' AS body,
  p.p_brand AS brand, p.p_type AS ptype, p.p_size AS size,
  split_part(p.p_name, ' ', 1) AS adjective, split_part(p.p_name, ' ', 2) AS noun,
  CASE WHEN p.p_partkey % 13 = 0 THEN NULL ELSE CAST(p.p_retailprice AS decimal(12,2)) END AS price_base,
  CASE WHEN p.p_partkey % 11 = 0 THEN NULL ELSE a.first_ship END AS published_at,
  CASE WHEN p.p_partkey % 19 = 0 THEN NULL ELSE CAST(-60 + CAST(p.p_partkey * 37 % 12000 AS double) / 100 AS decimal(9,6)) END AS lat,
  CASE WHEN p.p_partkey % 19 = 0 THEN NULL ELSE CAST(-180 + CAST(p.p_partkey * 91 % 36000 AS double) / 100 AS decimal(9,6)) END AS lon,
  CAST(coalesce(a.n_lines, 0) AS int) AS popularity
FROM {part} p
LEFT JOIN (SELECT l_partkey, min(l_shipdate) AS first_ship, count(*) AS n_lines, min(l_suppkey) AS supp FROM {lineitem} GROUP BY l_partkey) a ON a.l_partkey = p.p_partkey
LEFT JOIN {supplier} s ON s.s_suppkey = a.supp LEFT JOIN {nation} n ON n.n_nationkey = s.s_nationkey LEFT JOIN {region} r ON r.r_regionkey = n.n_regionkey
"""
DOCUMENT = """
SELECT CAST(d.doc_id AS string) AS doc_key, CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'hidden' ELSE 'published' END AS status,
  d.lang AS language, d.source AS owner_key, left(split_part(d.text, chr(10), 1), 512) AS title, d.text AS body,
  CASE WHEN l.quality IS NULL THEN 'unknown' WHEN l.quality = 1 THEN 'high' ELSE 'low' END AS quality, d.n_chars
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id
"""
PAGE = """
SELECT CAST(page_id AS string) AS doc_key, split_part(url, '/', 3) AS host, split_part(url, '/', 4) AS section, url FROM {pages}
"""
SIGNAL = """
SELECT event_id AS arrival, CAST(event_id AS string) AS sig_id, CAST(user_id AS string) AS doc_key,
  CASE event_type WHEN 'purchase' THEN 'boost' WHEN 'view' THEN 'popularity' WHEN 'click' THEN 'popularity' ELSE 'promoted' END AS kind,
  CASE event_type WHEN 'purchase' THEN (value - 100) / 50 WHEN 'signup' THEN 1.0 WHEN 'error' THEN 0.0 ELSE floor(value) END AS value,
  CASE WHEN event_type = 'signup' THEN ts + INTERVAL 7 days ELSE NULL END AS expires_at, ts FROM {events}
"""
CHANGES = """
SELECT o_orderkey AS arrival, CAST(o_custkey AS string) AS doc_key, CAST(o_orderkey AS string) AS eid,
  CASE WHEN o_orderkey % 29 = 0 THEN 0 ELSE o_orderkey * 7919 % 1009 END AS seq,
  CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'published' END AS status, o_orderpriority AS title FROM {orders}
"""


def load_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The statement over the directory's Parquet tables."""
    import string

    names = [n for _, n, _, _ in string.Formatter().parse(sql) if n]
    return spark.sql(sql.format(**{n: f"parquet.`{sf_dir}/{n}.parquet`" for n in names}))


def feature(kind: str, scalar=None, items=None):
    null = F.lit(None)
    return F.struct(F.lit(kind).alias("type"), (null if scalar is None else scalar).cast("string").alias("scalar"), (null if items is None else items).cast("array<string>").alias("list"), null.cast("string").alias("simple"))


def _input(df: DataFrame, doc_type: str, **columns) -> DataFrame:
    """df's own columns of the input schema, those given, and nulls for the others."""
    from pyspark.sql.types import _parse_datatype_string

    from tidewell.model import INPUT_SCHEMA

    have = {c: F.col(c) for c in df.columns} | columns | {"doc_type": F.lit(doc_type)}
    return df.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in _parse_datatype_string(INPUT_SCHEMA)], *[F.col(c) for c in ("popularity",) if c in df.columns])


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load_sql(spark, sf_dir, LISTING)
    features = F.create_map(*[x for slug in ("brand", "ptype", "adjective", "noun") for x in (F.lit(slug), feature("string", F.col(slug)))], F.lit("size"), feature("int", F.col("size")), F.lit("place"), feature("hierarchical_select", items=F.array("region", "nation")))
    card = F.create_map(F.lit("title"), F.col("title"), F.lit("price"), F.col("price_base").cast("string"))
    return _input(df, "listing", features=features, category_path=F.array("ptype", "noun"), text_extra=F.array("text_extra"), card=card)


def document(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")}
    if tables["labels"].count() <= LABELS_SENT:
        tables["labels"] = F.broadcast(tables["labels"])
    df = spark.sql(DOCUMENT, **tables)
    features = F.create_map(F.lit("quality"), feature("string", F.col("quality")), F.lit("source"), feature("string", F.col("owner_key")), F.lit("n_chars"), feature("int", F.col("n_chars")))
    return _input(df, "document", features=features, category_path=F.array("language"))


def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load_sql(spark, sf_dir, PAGE)
    return _input(df, "page", status=F.lit("published"), title=F.col("url"), category_path=F.array("host", "section"), features=F.create_map(F.lit("host"), feature("string", F.col("host")), F.lit("section"), feature("string", F.col("section"))))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_sql(spark, sf_dir, SIGNAL)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_sql(spark, sf_dir, CHANGES)


#: Rows of labels that are sent to where the texts are, about 100 bytes each; with more of them the texts are moved.
LABELS_SENT = 1_500_000

_SCHEMA = {
    "": [
        {"slug": "brand", "config": {"type": "string"}},
        {"slug": "ptype", "config": {"type": "select", "options": [{"value": v} for v in ("ECONOMY", "STANDARD", "PROMO", "MEDIUM", "SMALL", "LARGE", "NONE")]}},
        {"slug": "noun", "config": {"type": "string"}},
        {"slug": "place", "config": {"type": "hierarchical_select"}},
        {"slug": "size", "config": {"type": "int"}},
    ]
}
SOURCES = Registry(
    {
        "listing": Source("listing", listing, key_fields=("listing_id", "key"), signals=("listing.published", "listing.updated", "listing.removed"), category_schema=_SCHEMA),
        "document": Source("document", document, key_fields=("doc_id", "key")),
        "page": Source("page", page, key_fields=("page_id", "key")),
    }
)
