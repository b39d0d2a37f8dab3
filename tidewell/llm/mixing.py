"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words; a target stops at
`max_copies` times its source's words and the excess goes to the others by weight (closed form over sorted caps).
Within a source a document's expected copies grow with the bit length of its size, scaled and capped in the same way
so that the expected words meet the target. Its whole copies are certain. The fraction left, p, is an inclusion
probability: documents are ranked by random odds u/(1-u) divided by inclusion odds p/(1-p), and the sample is the
prefix of that order whose words come nearest to what the source still needs (fixed size, counted in words).
The prefix is found by exact histograms over rank bins, then ranks inside one bin of the second level, so that no
task holds a source. u is a hash of the id, or of the text where there is none: reruns agree.

Null or empty text: size 0, 0 copies or more of nothing. Null source: a source of its own. Repeated rows and ties in
rank go by id, then size; rows equal in both are interchangeable. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.llm.common import fresh, materialize, word_count

#: Tables of sources with so many rows at most are broadcast; the join with larger ones splits each of their keys so often.
SMALL, SALTS = 100_000, 256


def _fill(df: DataFrame, by: list[str], order: list[Column], weight: str, cap: str, total: str, out: str) -> DataFrame:
    """Shares `total` by `weight` among the rows of a group, none above `cap`; order: rising cap / weight."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.coalesce(F.sum(cap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    since = F.sum(weight).over(w.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    capped = F.col("_cap_ratio") * since <= F.col(total) - before
    whole = Window.partitionBy(*by)
    full = F.coalesce(F.sum(F.when(F.col("_capped"), F.col(cap))).over(whole), F.lit(0)).cast("double")
    rest = F.sum(F.when(~F.col("_capped"), F.col(weight))).over(whole).cast("double")
    df = df.withColumn("_capped", F.coalesce(capped, F.lit(True)))
    return df.withColumn(out, (F.col(total) - full) / rest)


def _small_join(rows: DataFrame, small: DataFrame, on: dict[str, str], key: Column, how: str) -> DataFrame:
    """rows joined with the one row that a materialized table has for their source and the like, without its keys (on: rows' column to small's)."""
    salt = []
    if small.count() <= SMALL:
        small = F.broadcast(small)
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
        small = small.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = [("salt", "salt_")]
    both = None
    for a, b in [*on.items(), *salt]:
        same = rows[a].eqNullSafe(small[b])
        both = same if both is None else both & same
    return rows.join(small, both, how).drop(*on.values(), *(c for pair in salt for c in pair))


def _key(id_col: Column, text: Column) -> Column:
    """What chance hangs on: the id, and for a row without one its text."""
    return F.coalesce(id_col.cast("string"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def targets(sizes: DataFrame, max_copies: int = 3) -> DataFrame:
    """source, source_size, target from rows of source, size; one row per source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("_all", F.lit(1))
    s = s.withColumn("weight", ((F.row_number().over(Window.partitionBy("_all").orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * max_copies).withColumn("total", F.sum("source_size").over(Window.partitionBy("_all")).cast("double"))
    s = s.withColumn("_cap_ratio", F.col("cap") / F.col("weight"))
    s = _fill(s, ["_all"], [F.col("_cap_ratio"), F.col("source").asc_nulls_last()], "weight", "cap", "total", "_level")
    return s.select("source", "source_size", F.when(F.col("_capped"), F.col("cap").cast("double")).otherwise(F.col("_level") * F.col("weight")).alias("target"))


def _mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_copies: int = 3, seed: str = "mix", bits: int = 12) -> DataFrame:
    """id, key, source, size, source_size, target, copies of every row."""
    sizes = df.select(F.col(id_col).alias("id"), _key(F.col(id_col), F.col(text_col)).alias("key"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    sizes = materialize(sizes, "mix-sizes").withColumn("g", F.length(F.bin("size")).cast("long"))
    goals = targets(sizes, max_copies)
    classes = sizes.groupBy("source", "g").agg(F.sum("size").alias("words"))
    classes = classes.join(goals, classes.source.eqNullSafe(goals.source)).drop(goals.source)
    classes = classes.withColumn("w", F.col("g") * F.col("words")).withColumn("cap", F.col("words") * max_copies).withColumn("_cap_ratio", F.lit(float(max_copies)) / F.col("g"))
    classes = _fill(classes, ["source"], [F.col("g").desc()], "w", "cap", "target", "_level")
    classes = classes.withColumn("m", F.when(F.col("_capped"), F.lit(float(max_copies))).otherwise(F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("g")))
    sure = F.sum((F.floor("m") * F.col("words")).cast("long")).over(Window.partitionBy("source"))
    classes = materialize(classes.select("source", "g", "source_size", "target", "m", (F.col("target") - sure.cast("double")).alias("need")), "mix-classes")

    rows = _small_join(sizes, classes.withColumnsRenamed({"source": "s", "g": "h"}), {"source": "s", "g": "h"}, F.col("key"), "inner").drop("g")
    key = F.col("key")
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    rows = rows.withColumn("u", u).withColumn("p", F.col("m") - F.floor("m"))
    q = (F.col("u") / (1.0 - F.col("u"))) / (F.col("p") / (1.0 - F.col("p")))
    rows = rows.withColumn("q", F.when(F.col("p") > 0, q)).withColumn("rank", F.col("q") / (1.0 + F.col("q")))
    for level in (1, 2):
        rows = rows.withColumn(f"b{level}", F.floor(F.col("rank") * float(1 << bits * level)).cast("long"))
    ranked = materialize(rows.drop("u", "p", "q"), "mix-ranked")

    edge1 = _edge(ranked.where(F.col("b1").isNotNull()), [], "b1")
    near = ranked.join(edge1, ranked.source.eqNullSafe(edge1.source) & (ranked.b1 == edge1.at)).select(ranked["*"], "below")
    edge2 = _edge(near, ["below"], "b2").select("source", F.col("at").alias("at2"), F.col("below").alias("below2"))
    edges = edge1.select("source", F.col("at").alias("at1"))
    edges = edges.join(edge2, edges.source.eqNullSafe(edge2.source), "left").drop(edge2.source)
    edges = materialize(edges.withColumnRenamed("source", "s"), "mix-edges")
    # a source without an edge needs nothing
    joined = _small_join(ranked, edges, {"source": "s"}, F.col("key"), "left")
    place = F.when(F.col("rank").isNull(), "out").when(F.col("at1").isNull(), "out").when(F.col("b1") < F.col("at1"), "in").when(F.col("b1") > F.col("at1"), "out")
    place = place.when(F.col("b2") < F.col("at2"), "in").when(F.col("b2") > F.col("at2"), "out").otherwise("edge")
    joined = joined.withColumn("place", place)
    edge = joined.where("place = 'edge'")
    upto = Window.partitionBy("source", "b2").orderBy("rank", F.col("id").asc_nulls_last(), "size", "key").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("taken", F.col("below2") + F.sum("size").over(upto) - F.col("size") / 2.0 <= F.col("need"))
    rest = joined.where("place <> 'edge'").withColumn("taken", F.col("place") == "in")
    both = edge.unionByName(rest)
    return both.select("id", "key", "source", "size", "source_size", "target", (F.floor("m") + F.col("taken").cast("int")).cast("int").alias("copies"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how: object) -> DataFrame:
    """id, source, size, source_size, target, copies of every row."""
    return _mixed(df, id_col, text_col, source_col, **how).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies")


def _edge(rows: DataFrame, start: list[str], bin_col: str) -> DataFrame:
    """Of each source, the last bin below which there aren't more words than needed, and the words below it."""
    base = F.first(start[0]) if start else F.lit(0)
    hist = rows.groupBy("source", bin_col).agg(F.sum("size").alias("words"), F.first("need").alias("need"), base.alias("base"))
    w = Window.partitionBy("source").orderBy(bin_col).rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("below", F.col("base") + F.sum("words").over(w) - F.col("words"))
    return hist.where(F.col("below") <= F.col("need")).groupBy("source").agg(F.max(F.struct(F.col(bin_col).alias("at"), "below")).alias("last")).select("source", "last.at", "last.below")


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how: object) -> DataFrame:
    """The mix itself: each row of df as often as the mix takes it, in df's columns, which may have any names. Rows alike in id (or, without one, in text),
    size and source share their copies evenly."""
    k, w, s, n, rows_, at, times, take = fresh(df, "_key", "_words", "_source", "_n", "_rows", "_at", "_times", "_take")
    copies = _mixed(df, id_col, text_col, source_col, **how).groupBy(F.col("key").alias(k), F.col("size").alias(w), F.col("source").alias(s)).agg(F.sum("copies").alias(n), F.count("*").alias(rows_))
    own = df.withColumns({k: _key(F.col(id_col), F.col(text_col)), w: word_count(F.col(text_col)), s: F.col(source_col).cast("string")})
    # a missing source would be no partner; after this all three are plain keys, and those alike in them are few unless their rows are
    fill = lambda d: d.withColumn(s, F.coalesce(F.concat(F.lit("="), s), F.lit("")))
    rows = fill(own).join(fill(copies.where(F.col(n) > 0)), [k, w, s])
    alike = Window.partitionBy(k, w, s).orderBy(F.xxhash64(text_col))
    single = rows.where(F.col(rows_) == 1).withColumn(times, F.col(n))
    several = rows.where(F.col(rows_) > 1).withColumn(at, F.row_number().over(alike)).withColumn(times, F.expr(f"{n} div {rows_} + IF({at} <= {n} % {rows_}, 1, 0)")).drop(at)
    both = single.unionByName(several).where(F.col(times) > 0)
    return both.withColumn(take, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*[F.col(f"`{c}`") for c in df.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS key, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s0),
s2 AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM s1),
s3 AS (SELECT *, ratio * CAST(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE)
    <= total - CAST(coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS capped FROM s2),
s4 AS (SELECT *, (total - CAST(coalesce(sum(CASE WHEN capped THEN 3 * source_size END) OVER (), 0) AS DOUBLE)) / CAST(sum(CASE WHEN NOT capped THEN weight END) OVER () AS DOUBLE) AS level FROM s3),
s AS (SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE level * weight END AS target FROM s4),
c0 AS (SELECT source, CAST(length(bin(size)) AS BIGINT) AS g, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY 1, 2),
c1 AS (SELECT c0.*, s.source_size, s.target FROM c0 JOIN s ON c0.source IS NOT DISTINCT FROM s.source),
c2 AS (SELECT *, (CAST(3.0 AS DOUBLE) / g) * CAST(sum(g * words) OVER (PARTITION BY source ORDER BY g DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE)
    <= target - CAST(coalesce(sum(3 * words) OVER (PARTITION BY source ORDER BY g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS capped FROM c1),
c3 AS (SELECT *, (target - CAST(coalesce(sum(CASE WHEN capped THEN 3 * words END) OVER (PARTITION BY source), 0) AS DOUBLE))
    / CAST(sum(CASE WHEN NOT capped THEN g * words END) OVER (PARTITION BY source) AS DOUBLE) AS level FROM c2),
c4 AS (SELECT *, CASE WHEN capped THEN CAST(3.0 AS DOUBLE) ELSE coalesce(level, 0) * g END AS m FROM c3),
c AS (SELECT *, target - CAST(sum(CAST(floor(m) AS BIGINT) * words) OVER (PARTITION BY source) AS DOUBLE) AS need FROM c4),
r0 AS (SELECT d.*, c.source_size, c.target, c.m, c.need, c.m - floor(c.m) AS p,
    (CAST(CAST('0x' || substr(md5('mix:' || d.key), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND CAST(length(bin(d.size)) AS BIGINT) = c.g),
r1 AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM r0),
r2 AS (SELECT *, q / (1 + q) AS rank FROM r1),
r3 AS (SELECT *, sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS LAST, size, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM r2)
SELECT doc_id, size, source_size, target,
  CAST(size * (CAST(floor(m) AS BIGINT) + CASE WHEN rank IS NOT NULL AND CAST(upto AS DOUBLE) - size / 2.0::DOUBLE <= need THEN 1 ELSE 0 END) AS BIGINT) AS taken,
  CAST(CAST(floor(m) AS BIGINT) + CASE WHEN rank IS NOT NULL AND CAST(upto AS DOUBLE) - size / 2.0::DOUBLE <= need THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM r3
"""
