"""One query for each operator over the star-schema corpora, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.functions import geo, text
from tidewell.model import Between, Box, Circle, Cursor, Search, Words
from tidewell.operators import build, changes, facets, filters, ranking, suggest
from tidewell.plans.engine import Engine
from tidewell.sources import corpora
from tidewell.sources.scratch import shared_scratch
from tidewell.sources.registry import disclosure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF, SIGNALS_AS_OF = "2002-01-01 00:00:00", "2024-01-20 00:00:00"
CENTER = Circle(10.0, 20.0, 2000.0)

_TABLES = {t: t for t in "region nation customer supplier part orders lineitem events documents labels pages".split()}
FOLD = "replace(strip_accents(lower({0})), 'ß', 'ss')"
_WITH = f"""WITH listing AS ({corpora.LISTING.format(**_TABLES)}), idx AS (SELECT *, status = 'published' AS visible, [ptype, noun] AS category_path, lower(title) AS folded_title, lower(text_extra) AS folded_extra,
  lower(concat(title, ' ', text_extra)) AS text_plain,
  list_filter(['brand=' || brand, 'ptype=' || ptype, 'adjective=' || adjective, 'noun=' || noun, 'place=' || region, 'place=' || region || '/' || nation], lambda x: x IS NOT NULL) AS facet_terms FROM listing),
vis AS (SELECT * FROM idx WHERE visible)
"""
_DIST = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(10.0 - CAST(lat AS DOUBLE)) / 2), 2) + cos(radians(CAST(lat AS DOUBLE))) * cos(radians(10.0)) * pow(sin(radians(20.0 - CAST(lon AS DOUBLE)) / 2), 2))))"
_AGE = "greatest(0.0, date_diff('microsecond', published_at, TIMESTAMP '2002-01-01') / 86400e6)"
_FRESH = f"CASE WHEN published_at IS NULL THEN 0.0 ELSE pow(0.5, {_AGE} / 14) END"
_DOC = f"WITH document AS ({corpora.DOCUMENT.format(**_TABLES)}), vis AS (SELECT *, {FOLD.format('title')} AS folded_title, {FOLD.format('body')} AS text_body FROM document WHERE status = 'published')\n"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_STORED: dict[tuple[str, str, str], str] = {}


def engine(spark: SparkSession, sf_dir: str, doc_type: str) -> Engine:
    """Over the stored index of a corpus, which an application builds once and then reads."""
    at = (spark.sparkContext.applicationId, sf_dir, doc_type)
    if at not in _STORED:
        folder = shared_scratch(spark, f"index-{doc_type}")
        Engine.over(spark, sf_dir, (doc_type,)).stored(folder)
        _STORED[at] = folder
    return Engine(spark.read.parquet(_STORED[at]))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "listing").index


def document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "document").index


def ask(**how) -> Search:
    return Search(**({"doc_type": "listing", "sort": "newest", "as_of": AS_OF} | how))


def words(*groups: str) -> Words:
    return Words(groups=tuple(tuple(g.split("|")) for g in groups))


def _keys(name: str, where: str, **how) -> None:
    """A query of candidates: their keys."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filters.candidates(listing(spark, sf_dir), ask(**how)).select("doc_key")

    f.__name__ = name
    query(_WITH + f"SELECT doc_key FROM vis WHERE {where}")(f)


_keys("q_visible_scan", "true")
_keys("q_language_filter", "language = 'de'", only_language="de")
_keys("q_owner_filter", "owner_key = 's3'", owner="s3")
_keys("q_category_prefix", "ptype = 'ECONOMY' AND noun = 'widget'", within=("ECONOMY", "widget"))
_keys("q_facet_or_within", "brand IN ('Brand#2', 'Brand#17')", chosen={"brand": ["Brand#2", "Brand#17"]})
_keys("q_facet_and_across", "brand IN ('Brand#2', 'Brand#17') AND ptype = 'ECONOMY'", chosen={"brand": ["Brand#2", "Brand#17"], "ptype": ["ECONOMY"]})
_keys("q_facet_path_rollup", "region = 'ASIA'", chosen={"place": ["ASIA"]})
_keys("q_range_closed", "size BETWEEN 10 AND 30", between=(Between("size", Decimal(10), Decimal(30)),))
_keys("q_range_open_lower", "size <= 7", between=(Between("size", None, Decimal(7)),))
_keys("q_range_open_upper", "price_base >= 950.5", between=(Between("price", Decimal("950.5"), None),))
_keys("q_bbox", "lat BETWEEN -30 AND 30 AND lon BETWEEN -50 AND 60", area=Box(-30.0, -50.0, 30.0, 60.0))
_keys("q_bbox_antimeridian", "lat BETWEEN -20 AND 20 AND (lon >= 170 OR lon <= -170)", area=Box(-20.0, 170.0, 20.0, -170.0))
_keys("q_radius_filter", f"{_DIST} <= 2000", area=CENTER)


@query(_WITH + "SELECT doc_key FROM vis WHERE size BETWEEN 10 AND 30")
def q_range_semi_join(spark, sf_dir):
    index = listing(spark, sf_dir)
    return filters.in_range_semi(filters.candidates(index, ask()), filters.numbers_table(index), Between("size", Decimal(10), Decimal(30))).select("doc_key")


def _page(name: str, order: str, value: str, extra: str = "true", **how) -> None:
    """A page of hits: key and sort value."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = ask(limit=50, **how)
        rows = ranking.scored(filters.candidates(listing(spark, sf_dir), q), q)
        return ranking.page(rows, q).select("doc_key", ranking.sort_value(q.sort).alias("sort_value"))

    f.__name__ = name
    query(_WITH + f"SELECT doc_key, {value} AS sort_value FROM vis WHERE {extra} ORDER BY {order} LIMIT 50")(f)


_NEWEST, _PRICE = "strftime(published_at, '%Y-%m-%dT%H:%M:%S.%f')", "CAST(price_base AS VARCHAR)"
_page("q_sort_newest", "published_at DESC NULLS LAST, doc_key", _NEWEST)
_page("q_sort_price_asc_nulls_last", "price_base NULLS LAST, doc_key", _PRICE, "brand = 'Brand#2'", sort="price_asc", chosen={"brand": ["Brand#2"]})
_page("q_sort_price_desc_nulls_last", "price_base DESC NULLS LAST, doc_key", _PRICE, sort="price_desc")
_page("q_keyset_next", "price_base NULLS LAST, doc_key", _PRICE, "(price_base > 920.10 OR (price_base = 920.10 AND doc_key > '1201') OR price_base IS NULL)", sort="price_asc", cursor=Cursor("920.10", "1201", 24))
_page("q_keyset_prev", "price_base DESC NULLS FIRST, doc_key DESC", _PRICE, "(price_base < 960.10 OR (price_base = 960.10 AND doc_key < '601'))", sort="price_asc", backwards=True, cursor=Cursor("960.10", "601", 200))
_page("q_keyset_null_frontier", "doc_key", _PRICE, "price_base IS NULL AND doc_key > '1300'", sort="price_asc", cursor=Cursor(None, "1300", 24))


@query(_WITH + f"SELECT doc_key, round({_DIST}, 2) AS distance_km FROM vis WHERE {_DIST} <= 2000 ORDER BY {_DIST}, doc_key LIMIT 50")
def q_sort_distance(spark, sf_dir):
    q = ask(area=CENTER, sort="distance", limit=50)
    return ranking.page(ranking.scored(filters.candidates(listing(spark, sf_dir), q), q), q).select("doc_key", F.round("distance_km", 2).alias("distance_km"))


@query(_WITH + "SELECT count(*) AS total FROM vis WHERE ptype = 'ECONOMY'")
def q_exact_total(spark, sf_dir):
    return filters.candidates(listing(spark, sf_dir), ask(chosen={"ptype": ["ECONOMY"]})).agg(F.count("*").alias("total"))


@query(_WITH + "SELECT least(count(*), 101) AS total FROM vis")
def q_capped_total(spark, sf_dir):
    return filters.candidates(listing(spark, sf_dir), ask()).limit(101).agg(F.count("*").alias("total"))


_TERMS = "SELECT split_part(t, '=', 1) AS slug, substr(t, strpos(t, '=') + 1) AS value, count(*) AS count FROM (SELECT unnest(facet_terms) AS t FROM vis WHERE {0}) GROUP BY 1, 2 HAVING slug IN ({1})"


def _counts(name: str, slugs: tuple[str, ...], sql: str, after=None, **how) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        plan = facets.CountPlan(slugs, {s: "term" for s in slugs}, {"brand": ("Brand#1", "Brand#99", "none")})
        counts = facets.facet_counts(listing(spark, sf_dir), ask(**how), plan)
        return after(counts, plan) if after else counts

    f.__name__ = name
    query(_WITH + sql)(f)


_counts("q_facet_counts", ("brand", "ptype", "noun"), _TERMS.format("true", "'brand', 'ptype', 'noun'"))
_counts("q_facet_counts_path", ("place",), _TERMS.format("size > 20", "'place'"), between=(Between("size", Decimal("20.5"), None),))
_counts(
    "q_facet_drilldown_onepass",
    ("brand", "ptype", "noun"),
    " UNION ALL ".join(_TERMS.format(w, f"'{s}'") for s, w in (("brand", "ptype = 'ECONOMY' AND noun = 'widget'"), ("ptype", "brand IN ('Brand#2', 'Brand#3') AND noun = 'widget'"), ("noun", "brand IN ('Brand#2', 'Brand#3') AND ptype = 'ECONOMY'"))),
    chosen={"brand": ["Brand#2", "Brand#3"], "ptype": ["ECONOMY"], "noun": ["widget"]},
)
_counts("q_facet_zero_fill", ("brand",), f", c AS ({_TERMS.format('size < 3', chr(39) + 'brand' + chr(39))}), o(slug, value) AS (VALUES ('brand', 'Brand#1'), ('brand', 'Brand#99'), ('brand', 'none')) SELECT slug, value, coalesce(count, 0) AS count FROM c FULL JOIN o USING (slug, value)", facets.zero_filled, between=(Between("size", None, Decimal(2)),))
_counts("q_facet_top200", ("brand", "noun"), f", c AS ({_TERMS.format('true', chr(39) + 'brand' + chr(39) + ', ' + chr(39) + 'noun' + chr(39))}) SELECT slug, value, count, row_number() OVER (PARTITION BY slug ORDER BY count DESC, value) AS place FROM c QUALIFY place <= 5", lambda c, p: facets.top_values(c, 5))


@query(_WITH + "SELECT 'brand' AS slug, count(*) AS candidates FROM vis WHERE ptype = 'ECONOMY' UNION ALL SELECT 'ptype', count(*) FROM vis WHERE brand = 'Brand#2' UNION ALL SELECT 'noun', count(*) FROM vis WHERE brand = 'Brand#2' AND ptype = 'ECONOMY'")
def q_facet_candidates(spark, sf_dir):
    return facets.facet_candidates(listing(spark, sf_dir), ask(chosen={"brand": ["Brand#2"], "ptype": ["ECONOMY"]}), facets.CountPlan(("brand", "ptype", "noun")))


@query(_WITH + "SELECT 'brand' AS slug, brand AS value, CAST(round(count(*) / 0.5) AS BIGINT) AS count FROM vis WHERE CAST('0x' || substr(md5(doc_key), 1, 8) AS BIGINT) < 2147483648 AND brand IS NOT NULL GROUP BY brand")
def q_facet_sampled(spark, sf_dir):
    return facets.sampled_counts(listing(spark, sf_dir), ask(), facets.CountPlan(("brand",)), 0.5)


_T1, _T2 = "contains(text_plain, 'red') OR contains(text_plain, 'blue')", "contains(text_plain, 'ring')"
_keys("q_text_and_groups", f"({_T1}) AND ({_T2})", words=words("red|blue", "ring"))


@query(_DOC + "SELECT doc_key FROM vis WHERE (contains(folded_title, 'erte') OR contains(text_body, 'erte')) AND (contains(folded_title, 'ation') OR contains(text_body, 'ation') OR contains(folded_title, 'einge') OR contains(text_body, 'einge'))")
def q_text_documents(spark, sf_dir):
    return filters.candidates(document(spark, sf_dir), ask(doc_type="document", words=words("erte", "ation|einge"))).select("doc_key")


def _weight(*terms: str) -> str:
    any_ = lambda c: " OR ".join(f"contains({c}, '{t}')" for t in terms)
    return f"CASE WHEN {any_('folded_title')} THEN 1.0 WHEN {any_('folded_extra')} THEN 0.4 WHEN {any_('text_plain')} THEN 0.2 ELSE 0.0 END"


@query(_WITH + f"SELECT doc_key, round({_weight('red', 'promo')} + {_weight('brand#2')}, 6) AS text_score FROM vis")
def q_text_weights(spark, sf_dir):
    return listing(spark, sf_dir).where("visible").select("doc_key", F.round(filters.text_score(words("red|promo", "brand#2")), 6).alias("text_score"))


@query(_DOC + "SELECT doc_key, folded_title AS folded, length(text_body) AS signs, md5(text_body) AS folded_text FROM vis")
def q_text_fold(spark, sf_dir):
    """Titles, and whole texts by their digests."""
    whole = text.fold_col(F.col("body"))
    return document(spark, sf_dir).where("visible").select("doc_key", F.col("folded_title").alias("folded"), F.length(whole).cast("bigint").alias("signs"), F.md5(whole.cast("binary")).alias("folded_text"))


_TOKENS = f"list_transform(regexp_extract_all({{0}}, '[\\p{{{{L}}}}\\p{{{{N}}}}]+(?:[-/][\\p{{{{L}}}}\\p{{{{N}}}}]+)*'), lambda t: {FOLD.format('t')})"


@query(_DOC + f", w AS (SELECT doc_key, {_TOKENS.format('body')} AS ws FROM vis) SELECT doc_key, CAST(len(ws) AS BIGINT) AS n, md5(array_to_string(ws, ' ')) AS words FROM w")
def q_tokenize(spark, sf_dir):
    """The tokens of whole texts: how many, and their digest."""
    ws = text.tokens_col(F.col("body"))
    return document(spark, sf_dir).where("visible").select("doc_key", F.size(ws).cast("bigint").alias("n"), F.md5(F.array_join(ws, " ").cast("binary")).alias("words"))


_keys("q_synonym_expand", "contains(text_plain, 'laptop') OR contains(text_plain, 'notebook') OR contains(text_plain, 'tv') OR contains(text_plain, 'ring')", words=Words(groups=(tuple(dict.fromkeys([*text.normalize_query("laptop", "en").groups[0], *text.normalize_query("tv", "en").groups[0], "ring"])),)))
_keys("q_stopword_strip", "contains(text_plain, 'ring')", words=text.normalize_query("urgent ring cheap", "en"))


def _scores(name: str, sql: str, only: str | None, **how) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tidewell.sources.registry import SCORERS, Registry

        q = ask(sort="relevance", **how)
        rows = ranking.scored(filters.candidates(listing(spark, sf_dir), q), q, SCORERS if only is None else Registry({only: SCORERS[only]}))
        return rows.select("doc_key", F.round("score", 4).alias("score"))

    f.__name__ = name
    query(_WITH + sql)(f)


_POP = "CAST(popularity AS DOUBLE) / (popularity + 10)"
_scores("q_score_freshness", f"SELECT doc_key, round(round(0.3 * {_FRESH}, 6), 4) AS score FROM vis", "freshness_decay")
_scores("q_score_popularity", f"SELECT doc_key, round(round(0.2 * {_POP}, 6), 4) AS score FROM vis", "popularity")
_scores("q_score_geo_decay", f"SELECT doc_key, round(round(0.3 * greatest(0.0, 1 - {_DIST} / 50), 6), 4) AS score FROM vis WHERE {_DIST} <= 2000", "geo_decay", area=CENTER)
_NEAR = _DIST.replace("radians(10.0", "radians(-59.5").replace("radians(20.0", "radians(-179.0")
_scores("q_score_geo_decay_near", f"SELECT doc_key, round(round(0.3 * greatest(0.0, 1 - {_NEAR} / 50), 6), 4) AS score FROM vis WHERE {_NEAR} <= 300", "geo_decay", area=Circle(-59.5, -179.0, 300.0))
_scores("q_relevance_score", f"SELECT doc_key, round(round({_weight('ring')} + 0.3 * {_FRESH} + 0.2 * {_POP}, 6), 4) AS score FROM vis WHERE {_T2}", None, words=words("ring"))


@query(_WITH + "SELECT DISTINCT title FROM vis WHERE starts_with(folded_title, 'red') ORDER BY title LIMIT 10")
def q_suggest_prefix(spark, sf_dir):
    return suggest.suggest(listing(spark, sf_dir), "listing", "Red")


_SIGNALS = f"WITH signal AS ({corpora.SIGNAL.format(**_TABLES)}), s AS (SELECT doc_key, arg_max(value, arrival) FILTER (kind = 'boost') AS b, arg_max(value, arrival) FILTER (kind = 'popularity') AS p, arg_max(value, arrival) FILTER (kind = 'promoted') AS m, max(arrival) FILTER (kind = 'promoted') AS ma FROM signal GROUP BY 1), l AS (SELECT s.doc_key, greatest(-1.0, least(5.0, coalesce(b, 0.0))) AS boost, CAST(coalesce(p, 0) AS INTEGER) AS popularity, coalesce(m <> 0, false) AS promoted, e.expires_at FROM s LEFT JOIN signal e ON e.arrival = s.ma)\n"


@query(_SIGNALS + "SELECT doc_key, round(CAST(boost AS DOUBLE), 6) AS boost, popularity, promoted FROM l")
def q_signals_last_writer(spark, sf_dir):
    return changes.last_signals(corpora.signals(spark, sf_dir)).select("doc_key", F.round(F.col("boost").cast("double"), 6).alias("boost"), "popularity", "promoted")


@query(f"WITH signal AS ({corpora.SIGNAL.format(**_TABLES)}) SELECT arrival, round(CAST(greatest(-1.0, least(5.0, value)) AS DOUBLE), 6) AS boost FROM signal WHERE kind = 'boost'")
def q_score_boost_clamp(spark, sf_dir):
    from tidewell.sources.registry import SCORERS

    rows = corpora.signals(spark, sf_dir).where("kind = 'boost'")
    return rows.select("arrival", F.round(SCORERS["promotion_boost"].expr({"boost": F.col("value").cast("double")}), 6).alias("boost"))


@query(_SIGNALS + f"SELECT doc_key, promoted AND NOT coalesce(expires_at <= TIMESTAMP '{SIGNALS_AS_OF}' AND (promoted OR boost <> 0), false) AS promoted, round(CAST(CASE WHEN coalesce(expires_at <= TIMESTAMP '{SIGNALS_AS_OF}' AND (promoted OR boost <> 0), false) THEN 0.0 ELSE boost END AS DOUBLE), 6) AS boost FROM l")
def q_promotion_expiry(spark, sf_dir):
    state = changes.last_signals(corpora.signals(spark, sf_dir)).withColumn("boost", F.col("boost").cast("double"))
    return changes.expired(state, SIGNALS_AS_OF).select("doc_key", "promoted", F.round("boost", 6).alias("boost"))


_CHANGES = f"WITH log AS ({corpora.CHANGES.format(**_TABLES)}), o AS (SELECT *, coalesce(max(seq) OVER (PARTITION BY doc_key ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM log), f AS (SELECT * FROM o WHERE seq = 0 OR seq >= seen), st AS (SELECT doc_key, arg_max(title, arrival) AS title, arg_max(status, arrival) AS status, max(seq) AS seq, count(*) AS applied FROM f GROUP BY 1)\n"


@query(_CHANGES + "SELECT st.doc_key, title, status, CAST(seq AS BIGINT) AS seq, CAST(applied AS INTEGER) AS applied, CAST(n - applied AS INTEGER) AS stale FROM st JOIN (SELECT doc_key, count(*) AS n FROM log GROUP BY 1) c ON c.doc_key = st.doc_key")
def q_upsert_latest_wins(spark, sf_dir):
    return changes.guard_fold(corpora.changes(spark, sf_dir), ["title", "status"]).select("doc_key", "title", "status", "seq", "applied", "stale")


@query(_CHANGES + "SELECT doc_key, title, status, CAST(seq AS BIGINT) AS seq FROM st")
def q_upsert_by_window(spark, sf_dir):
    return changes.latest_by_sequence(corpora.changes(spark, sf_dir), ["title", "status"]).select("doc_key", "title", "status", F.col("seq").cast("bigint").alias("seq"))


def _old_and_new(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """An index of listings but those divisible by 7, and a snapshot but those divisible by 5."""
    index = listing(spark, sf_dir)
    return index.where("CAST(doc_key AS BIGINT) % 7 <> 0"), index.drop("indexed_at").where("CAST(doc_key AS BIGINT) % 5 <> 0")


@query(_WITH + "SELECT doc_key FROM vis WHERE CAST(doc_key AS BIGINT) % 7 <> 0 AND CAST(doc_key AS BIGINT) % 5 = 0")
def q_rebuild_anti_join(spark, sf_dir):
    return changes.not_seen(*_old_and_new(spark, sf_dir)).select("doc_key")


@query(_WITH + "SELECT doc_key, visible AND CAST(doc_key AS BIGINT) % 5 <> 0 AS visible FROM idx WHERE CAST(doc_key AS BIGINT) % 7 <> 0 OR CAST(doc_key AS BIGINT) % 5 <> 0")
def q_rebuild(spark, sf_dir):
    return changes.rebuild(*_old_and_new(spark, sf_dir), "2024-01-02").select("doc_key", "visible")


_DRIFT = "s AS (SELECT doc_key, max(seq) AS seq FROM log GROUP BY 1), i AS (SELECT doc_key, max(seq) AS seq FROM log WHERE arrival * 5 < 4 * (SELECT max(arrival) FROM log) AND CAST(doc_key AS BIGINT) % 9 <> 0 GROUP BY 1), j AS (SELECT s.doc_key AS a, i.doc_key AS b, s.seq AS sq, i.seq AS iq FROM s FULL JOIN i ON s.doc_key = i.doc_key)"


@query(_CHANGES + f", {_DRIFT} SELECT *, source_rows = index_rows AND stale = 0 AS in_sync FROM (SELECT count(a) AS source_rows, count(b) AS index_rows, count(*) FILTER (b IS NULL) AS missing, count(*) FILTER (a IS NULL) AS surplus, count(*) FILTER (a IS NOT NULL AND coalesce(iq, -1) < sq) AS stale FROM j)")
def q_drift_full_outer(spark, sf_dir):
    log = corpora.changes(spark, sf_dir)
    source = log.groupBy("doc_key").agg(F.max("seq").alias("seq"))
    last = F.lit(log.agg(F.max("arrival")).first()[0] or 0)  # the index has seen four fifths of the log
    return changes.drift(log.where((F.col("arrival") * 5 < last * 4) & F.expr("CAST(doc_key AS BIGINT) % 9 <> 0")).groupBy("doc_key").agg(F.max("seq").alias("seq")), source)


@query(_CHANGES + ", k AS (SELECT DISTINCT doc_key FROM log) SELECT k.doc_key FROM k WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.doc_key = k.doc_key AND l.status = 'pending' AND l.arrival % 3 = 0)")
def q_missing_keys(spark, sf_dir):
    log = corpora.changes(spark, sf_dir)
    return changes.missing_keys(log.where("status = 'pending' AND arrival % 3 = 0"), log)


@query(_CHANGES + "SELECT doc_key FROM st WHERE doc_key IN (SELECT doc_key FROM log WHERE title = '1-URGENT')")
def q_pull_documents(spark, sf_dir):
    log = corpora.changes(spark, sf_dir)
    return changes.pulled(changes.latest_by_sequence(log, ["title"]), log.where("title = '1-URGENT'")).select("doc_key")


@query(_WITH + "SELECT doc_key, visible AND size <> 4 AS visible FROM idx")
def q_tombstone(spark, sf_dir):
    index = listing(spark, sf_dir)
    return changes.tombstones(index, index.where("numbers['size'] = 4"), "2024-01-05").select("doc_key", "visible")


@query(_WITH + "SELECT doc_key FROM idx WHERE visible OR CAST(doc_key AS BIGINT) % 2 = 1")
def q_purge_tombstones(spark, sf_dir):
    index = listing(spark, sf_dir).withColumn("indexed_at", F.expr("IF(CAST(doc_key AS BIGINT) % 2 = 1, TIMESTAMP '2024-01-19', TIMESTAMP '2024-01-01')"))
    return changes.purged(index, SIGNALS_AS_OF).select("doc_key")


@query(_WITH + "SELECT doc_key FROM idx WHERE owner_key NOT IN ('s1', 's2', 's3')")
def q_erase_owner(spark, sf_dir):
    return changes.erased(listing(spark, sf_dir), spark.createDataFrame([("s1",), ("s2",), ("s3",)], "owner_key string")).select("doc_key")


@query(_WITH + "SELECT doc_key FROM idx WHERE published_at IS NOT NULL AND published_at > TIMESTAMP '2002-01-01' - INTERVAL 3650 DAY ORDER BY published_at, doc_key LIMIT 500")
def q_catch_up(spark, sf_dir):
    index = listing(spark, sf_dir).withColumn("source_updated_at", F.col("published_at").cast("timestamp")).withColumn("indexed_at", F.col("published_at").cast("timestamp"))
    return changes.catch_up(index, AS_OF).select("doc_key")


@query(f"WITH document AS ({corpora.DOCUMENT.format(**_TABLES)}) SELECT doc_key, 'body=' || substr(body, 1, 155) AS term, CAST(length(body) > 155 AS INTEGER) AS truncated FROM document WHERE body IS NOT NULL AND body <> ''")
def q_term_truncation(spark, sf_dir):
    df = corpora.document(spark, sf_dir).withColumn("features", F.create_map(F.lit("body"), corpora.feature("string", F.col("body"))))
    return build.build_index(df).where(F.size("facet_terms") > 0).select("doc_key", F.get("facet_terms", F.lit(0)).alias("term"), F.col("truncated_terms").alias("truncated"))


@query(_WITH + "SELECT 'listing' AS doc_type, count(*) AS documents, CAST(date_diff('second', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-20') AS BIGINT) AS lag_seconds FROM vis")
def q_health_lag(spark, sf_dir):
    return changes.health(listing(spark, sf_dir), SIGNALS_AS_OF)


@query(
    """SELECT * FROM (VALUES
      ('freshness_decay', 0.3::DOUBLE, 'half_life_days=14', 'relevance', true, 'newer first'), ('geo_decay', 0.3::DOUBLE, 'radius_km=50', 'relevance', true, 'nearer first'),
      ('popularity', 0.2::DOUBLE, 'half=10', 'relevance', true, 'often seen'), ('promotion_boost', 1.0::DOUBLE, 'max=5,min=-1', 'relevance', true, 'promoted'),
      ('relevance', 1.0::DOUBLE, '', 'relevance', true, 'how well the words match')) t(slug, weight, params, sorts, active, reason)"""
)
def q_ranking_disclosure(spark, sf_dir):
    return spark.createDataFrame([tuple(d.values()) for d in disclosure()], "slug string, weight double, params string, sorts string, active boolean, reason string")


@query(_WITH + "SELECT doc_key, facet_terms[1] AS first_term, len(facet_terms) AS terms, size AS size_number, len(category_path) AS depth, text_plain FROM idx")
def q_index_build(spark, sf_dir):
    df = Engine.over(spark, sf_dir, ("listing",)).index
    return df.select("doc_key", F.get("facet_terms", F.lit(0)).alias("first_term"), F.size("facet_terms").cast("bigint").alias("terms"), F.col("numbers")["size"].cast("int").alias("size_number"), F.size("category_path").cast("bigint").alias("depth"), "text_plain")


@query(f"WITH p AS ({corpora.PAGE.format(**_TABLES)}) SELECT host, section, count(*) AS n FROM p GROUP BY 1, 2")
def q_page_corpus(spark, sf_dir):
    index = engine(spark, sf_dir, "page").index
    return index.groupBy(F.get("category_path", F.lit(0)).alias("host"), F.get("category_path", F.lit(1)).alias("section")).agg(F.count("*").alias("n"))


_CELL = geo.geohash_box(geo.box_prefix(*geo.radius_box(CENTER.lat, CENTER.lon, 100.0)))


def _geohash_sql() -> str:
    """Twelve signs from the interleaved bits of both grid numbers."""
    bit = lambda k: f"((({'gx' if k % 2 == 0 else 'gy'} >> {29 - k // 2}) & 1) << {4 - k % 5})"
    return " || ".join(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(1 + {' + '.join(bit(5 * s + b) for b in range(5))} AS BIGINT), 1)" for s in range(12))


_GRID = "CAST(floor((CAST(lon AS DOUBLE) + 180.0) / 360.0 * 1073741824) AS BIGINT) AS gx, CAST(floor((CAST(lat AS DOUBLE) + 90.0) / 180.0 * 1073741824) AS BIGINT) AS gy"


@query(_WITH + f", g AS (SELECT doc_key, {_GRID} FROM vis WHERE lat >= {_CELL[0]} AND lat < {_CELL[2]} AND lon >= {_CELL[1]} AND lon < {_CELL[3]}) SELECT doc_key, {_geohash_sql()} AS geohash FROM g")
def q_geohash_prefilter(spark, sf_dir):
    box = geo.radius_box(CENTER.lat, CENTER.lon, 100.0)
    return listing(spark, sf_dir).where(F.col("visible") & F.startswith("geohash", F.lit(geo.box_prefix(*box)))).select("doc_key", "geohash")


_OWN_TRIGRAMS = "[" + ", ".join(f"'{t}'" for t in text.trigrams("widgett")) + "]"
_SHARE = f"len(list_intersect(list_transform(range(1, length('  ' || t || ' ') - 1), lambda i: substr('  ' || t || ' ', i, 3)), {_OWN_TRIGRAMS})) / {len(text.trigrams('widgett'))}::DOUBLE"


@query(_WITH + f"SELECT doc_key FROM vis WHERE contains(text_plain, 'widgett') OR list_max(list_transform(regexp_split_to_array(text_plain, '[^\\p{{L}}\\p{{N}}]+'), lambda t: {_SHARE})) >= 0.45")
def q_typo_arm(spark, sf_dir):
    return engine(spark, sf_dir, "listing").candidates(ask(words=words("widgett")), fuzzy=True).select("doc_key")


_STEMMED = (("antions", "thened"), ("inth",))


def _stem_sql(word: str, language: str) -> str:
    from tidewell.functions.stem import _RULES, _pattern

    for least, endings in _RULES[language]:
        word = f"regexp_replace({word}, '{_pattern(least, endings)}', '\\1')"
    return word


def _stems_sql() -> str:
    from tidewell.functions.stem import stem

    met = " AND ".join("list_has_any(CASE language " + " ".join(f"WHEN '{n}' THEN list_transform(ws, lambda t: {_stem_sql('t', n)})" for n in ("en", "de")) + " ELSE ws END, [" + ", ".join(f"'{stem(t, 'en')}'" for t in g) + "])" for g in _STEMMED)
    return _DOC + f", w AS (SELECT doc_key, language, list_distinct({_TOKENS.format(chr(116) + 'itle || chr(32) || body')}) AS ws FROM vis) SELECT doc_key FROM w WHERE {met}"


@query(_stems_sql())
def q_stemmed_arm(spark, sf_dir):
    """Whole texts that have the words by their stems."""
    from tidewell.functions.stem import matches_stems

    return document(spark, sf_dir).where(F.col("visible") & matches_stems(F.col("stems"), _STEMMED, "en")).select("doc_key")


@query(_stems_sql())
def q_postings_search(spark, sf_dir):
    """The same over a table of postings, which is read by stem."""
    from tidewell.operators import postings

    index = document(spark, sf_dir)
    at = (spark.sparkContext.applicationId, sf_dir, "postings")
    if at not in _STORED:
        _STORED[at] = shared_scratch(spark, "postings")
        postings.store(index, _STORED[at])
    return postings.search(index, spark.read.parquet(_STORED[at]), "document", Words(_STEMMED), "en").select("doc_key")


_COVER = (("antion", "thened", "inth"), ("the", "is"))


def _cover_sql() -> str:
    ins = ["(" + ", ".join(f"'{t}'" for t in g) + ")" for g in _COVER]
    return _DOC + f""", w AS (SELECT doc_key, {_TOKENS.format('body')} AS ws FROM vis), t AS (SELECT doc_key, unnest(ws) AS tok, generate_subscripts(ws, 1) AS pos FROM w),
      m AS (SELECT *, max(CASE WHEN tok IN {ins[0]} THEN pos END) OVER p AS l0, max(CASE WHEN tok IN {ins[1]} THEN pos END) OVER p AS l1 FROM t WHERE tok IN {ins[0]} OR tok IN {ins[1]} WINDOW p AS (PARTITION BY doc_key ORDER BY pos)),
      c AS (SELECT doc_key, pos, least(l0, l1) AS lft FROM m WHERE l0 IS NOT NULL AND l1 IS NOT NULL),
      d AS (SELECT *, max(lft) OVER (PARTITION BY doc_key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM c)
      SELECT doc_key, round(sum(1.0::DOUBLE / (1 + pos - lft - 1)), 4) AS density FROM d WHERE seen IS NULL OR lft > seen GROUP BY doc_key"""


@query(_cover_sql())
def q_cover_density(spark, sf_dir):
    """Whole texts that have the words, by how closely. A text without them, as parts of words even, isn't cut into tokens."""
    from tidewell.functions.covers import cover_density

    rows = document(spark, sf_dir).where("visible")
    for group in _COVER:
        rows = rows.where(text.contains_group(F.col("text_plain"), group))
    rows = rows.select("doc_key", cover_density(text.tokens_col(F.col("body")), _COVER).alias("density"))
    return rows.where("density > 0").select("doc_key", F.round("density", 4).alias("density"))


def _two_types(spark, sf_dir) -> DataFrame:
    """Listings and pages in one index: their keys are the same numbers."""
    return listing(spark, sf_dir).unionByName(engine(spark, sf_dir, "page").index)


_TWO = _WITH + f", pg AS ({corpora.PAGE.format(**_TABLES)}), two AS (SELECT 'listing' AS doc_type, doc_key, visible, size FROM idx UNION ALL SELECT 'page', doc_key, true, NULL FROM pg)\n"


@query(_TWO + "SELECT doc_type, doc_key, visible AND NOT coalesce(size = 4, false) AS visible FROM two")
def q_tombstone_two_types(spark, sf_dir):
    """Hiding listings leaves pages of the same keys alone."""
    index = _two_types(spark, sf_dir)
    return changes.tombstones(index, index.where("doc_type = 'listing' AND numbers['size'] = 4"), "2024-01-05").select("doc_type", "doc_key", "visible")


@query(_TWO + "SELECT doc_type, doc_key, doc_type = 'page' OR (visible AND CAST(doc_key AS BIGINT) % 5 <> 0) AS visible, CAST(CASE WHEN doc_type = 'page' THEN 3.5 ELSE 0 END AS DOUBLE) + CASE WHEN CAST(doc_key AS BIGINT) % 3 = 0 THEN 1.5 ELSE 0 END AS boost FROM two")
def q_rebuild_two_types(spark, sf_dir):
    """A snapshot of listings but those divisible by 5: pages stay, and what signals gave stays with all rows."""
    boost = F.when(F.col("doc_type") == "page", 3.5).otherwise(0.0) + F.when(F.col("doc_key").cast("bigint") % 3 == 0, 1.5).otherwise(0.0)
    index = _two_types(spark, sf_dir).withColumn("boost", boost)
    snapshot = listing(spark, sf_dir).drop("indexed_at").where("CAST(doc_key AS BIGINT) % 5 <> 0")
    return changes.rebuild(index, snapshot, "2024-01-02", ("listing",)).select("doc_type", "doc_key", "visible", "boost")


_EVENTS = """
SELECT o_orderkey AS arrival, CASE WHEN o_orderkey % 7 = 3 THEN '' ELSE CONCAT('e', CAST(o_orderkey AS string)) END AS event_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'listing.updated' WHEN 1 THEN 'listing.published' WHEN 2 THEN 'listing.removed' WHEN 3 THEN 'search.signal' ELSE 'unheard.of' END AS event_name,
  CASE WHEN o_orderkey % 29 = 0 THEN 0 ELSE 1000 * o_custkey END AS timestamp, CAST(o_custkey AS string) AS doc_key, round(o_totalprice / 100000, 2) AS boost FROM {orders}
"""
_EVENTS_SQL = f"""WITH ev AS ({_EVENTS.format(**_TABLES)}), k AS (SELECT * FROM ev WHERE event_name LIKE 'listing.%'), n AS (SELECT doc_key, max("timestamp") AS seq FROM k GROUP BY 1),
l AS ({corpora.LISTING.format(**_TABLES)}), s AS (SELECT doc_key, arg_max(boost, "timestamp" * 1000000000 + arrival) AS boost FROM ev WHERE event_name = 'search.signal' GROUP BY 1)
"""


@query(_EVENTS_SQL + "SELECT l.doc_key, l.status = 'published' AS visible, n.seq AS source_seq, round(CASE WHEN s.boost IS NULL THEN 0.0 ELSE CAST(greatest(-1.0, least(5.0, s.boost)) AS DOUBLE) END, 6) AS boost FROM l JOIN n USING (doc_key) LEFT JOIN s USING (doc_key)")
def q_stream_events(spark, sf_dir):
    """Events, some twice, late, without number or without id, as a stream: documents pulled and ingested, signals applied; the index that results."""
    from tidewell.streaming.jobs import event_stream, state

    folder = shared_scratch(spark, "events")
    ev = corpora.load_sql(spark, sf_dir, _EVENTS)
    at = F.when(F.col("event_name") == "search.signal", F.col("timestamp") * F.lit(1_000_000_000) + F.col("arrival")).otherwise(F.col("timestamp"))
    signal = F.to_json(F.struct(F.lit("listing").alias("doc_type"), "doc_key", F.col("boost").cast("double").alias("boost")))
    payload = F.when(F.col("event_name") == "search.signal", signal).otherwise(F.to_json(F.struct(F.col("doc_key").alias("listing_id"))))
    rows = ev.select("event_id", "event_name", at.cast("long").alias("timestamp"), payload.alias("payload"), "doc_key")
    # signals are about documents that the first file brings; every third event comes again in the last one
    first = rows.where("event_name <> 'search.signal'").drop("doc_key")
    then = rows.where("event_name = 'search.signal'").drop("doc_key").unionByName(rows.where("event_name <> 'search.signal' AND CAST(doc_key AS BIGINT) % 3 = 0").drop("doc_key"))
    for part in (first, then):
        part.coalesce(2).write.mode("append").parquet(f"{folder}/events")
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/events")
    index = listing(spark, sf_dir)
    sources = corpora.SOURCES.overlay({"document": None, "page": None})
    event_stream(stream, sources, lambda _, keys: changes.pulled(index, keys), f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    return state(spark, f"{folder}/state").select("doc_key", "visible", "source_seq", F.round("boost", 6).alias("boost"))


@query(_CHANGES + "SELECT doc_key, title, status, CAST(seq AS BIGINT) AS seq FROM st")
def q_stream_ingest(spark, sf_dir):
    """The change log as a stream of files, folded batch by batch; its state."""
    from tidewell.streaming.jobs import ingest_stream, state

    folder = shared_scratch(spark, "stream")
    log = corpora.changes(spark, sf_dir)
    last = log.agg(F.max("arrival")).first()[0]
    for k in range(4):  # delivered in order: a stream reads files in the order in which they were written
        part = F.least(F.floor(F.col("arrival") * 4 / F.lit(max(1, last))), F.lit(3))
        log.where(part == k).repartition(1).write.mode("append").parquet(f"{folder}/log")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/log").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    q = ingest_stream(stream, ["title", "status"], f"{folder}/state", f"{folder}/checkpoint")
    q.awaitTermination()
    return state(spark, f"{folder}/state").select("doc_key", "title", "status", "seq")


@query(_WITH + "SELECT doc_key FROM vis WHERE brand IN ('Brand#2', 'Brand#3') AND size BETWEEN 10 AND 30 ORDER BY price_base NULLS LAST, doc_key LIMIT 24")
def q_search_flagship(spark, sf_dir):
    """Facet, range, sort and page in one plan: what search() runs for its items."""
    q = ask(chosen={"brand": ["Brand#2", "Brand#3"]}, between=(Between("size", Decimal(10), Decimal(30)),), sort="price_asc", limit=24)
    return ranking.page(engine(spark, sf_dir, "listing").hits(q), q).select("doc_key")


