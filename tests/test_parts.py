import random
import unicodedata
from decimal import Decimal

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tests.corpus import doc, index, listed, scalar
from tidewell.conf import EngineConf
from tidewell.functions import geo, stem, text
from tidewell.model import Box, CountPlan, QueryRefused, Search
from tidewell.operators import changes, facets
from tidewell.operators.filters import candidates
from tidewell.plans.parse import decode_cursor, encode_cursor, parse_query
from tidewell.model import Cursor
from tidewell.sources.registry import FACET_MAPPINGS, SCORERS, FacetMapping, Registry, Source, mapping_of

TYPES = {"thing": 1}


def parse(**params):
    return parse_query({"type": "thing"} | {k.replace("__", "."): v for k, v in params.items()}, TYPES)


@pytest.mark.parametrize(
    "params,code",
    [
        ({"type": "x"}, "unknown_doc_type"),
        ({"q": "x" * 201}, "query_too_long"),
        ({"r__y": "5"}, "bad_range"),
        ({"r__y": ".."}, "bad_range"),
        ({"r__y": "5..1"}, "bad_range"),
        ({"r__y": "NaN.."}, "bad_range"),
        ({f"f__s{k}": "v" for k in range(13)}, "too_many_facets"),
        ({f"r__s{k}": "1.." for k in range(5)}, "too_many_ranges"),
        ({"lat": "1"}, "bad_geo"),
        ({"lat": "91", "lon": "0"}, "bad_geo"),
        ({"lat": "1", "lon": "0", "radius": "-1"}, "bad_geo"),
        ({"bbox": "1,2,3"}, "bad_geo"),
        ({"bbox": "5,0,1,0"}, "bad_geo"),
        ({"sort": "popular"}, "unknown_sort"),
        ({"sort": "distance"}, "distance_without_center"),
        ({"cursor": "!!"}, "bad_cursor"),
        ({"cursor": encode_cursor(Cursor(None, "1", 990))}, "window_exceeded"),
    ],
)
def test_refusals(params, code):
    with pytest.raises(QueryRefused) as e:
        parse(**params)
    assert e.value.code == code and e.value.status == 400


def test_parse():
    q = parse(q=" Red ring ", f__brand=["a", "b"], r__size="1..", category="/x/y/", limit="1000", direction="sideways", lang="EN", facets="brand, size")
    assert q.sort == "relevance" and q.chosen == {"brand": ["a", "b"]} and q.between[0].low == Decimal(1) and q.within == ("x", "y")
    assert q.limit == 100 and not q.backwards and q.only_language == "en" and q.counted == ("brand", "size")
    assert parse().sort == "newest" and parse(limit="junk").limit == 24 and parse(facets="off").counting is False
    assert parse(bbox="1,170,2,-170", lat="1", lon="1").area == Box(1, 170, 2, -170)


def test_cursor_round_trip():
    c = Cursor("2026-01-01", "ключ", 24, "2026-02-02 00:00:00")
    assert decode_cursor(encode_cursor(c)) == c and "=" not in encode_cursor(c)


WORDS = "Ёлка café STRASSE Straße мой Élan ŒUVRE ﬁn naïve Ångström İ İstanbul ё й İ x́ а́".split()


def test_fold_column_is_the_function(spark):
    rows = spark.createDataFrame([(w,) for w in WORDS if w == unicodedata.normalize("NFC", w)], "w string").select("w", text.fold_col(F.col("w")).alias("f")).collect()
    assert {r.w: r.f for r in rows} == {r.w: text.fold(r.w) for r in rows}
    assert text.fold("мой Ёж") == "мой еж" and text.fold("CAFÉ") == "cafe"


def test_tokens_column_is_the_function(spark):
    samples = ["Б/у i-phone, (2nd) хорошо_ок", "", "a--b c/d/ é"]
    rows = spark.createDataFrame([(s,) for s in samples], "s string").select("s", text.tokens_col(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in rows} == {s: text.tokens(s) for s in samples}


def test_transliteration():
    assert text.transliterate("щука") == "shchuka" and text.transliterate("shchuka") == "щука" and text.transliterate("aб") is None and text.transliterate("12") is None


def test_query_normalisation_order_and_budget():
    q = text.normalize_query("стиралка срочно samsung", "RU")
    assert q.dropped == ("срочно",) and [g[0] for g in q.groups] == ["стиральная", "машина", "samsung"]
    assert q.groups[1] == ("машина", "авто", "автомобиль") and q.groups[2] == ("samsung", "самсунг")
    assert len([t for g in text.normalize_query(" ".join(["машина"] * 20), "ru").groups for t in g]) == 32
    assert not text.normalize_query("cheap", "en")


def test_dictionary_overlay_and_lint():
    conf = EngineConf(dictionaries={"en": {"version": 3, "equivalents": [["ring", "band"], ["ring", "hoop"]], "rewrites": {"a": "b", "b": "a"}, "stopwords": ["band"]}})
    d = text.dictionary("en", conf)
    assert d.version == 3 and d.group("ring") == ("ring", "hoop")
    assert {f.split(":")[0] for f in text.lint(d, conf)} == {"duplicate", "stopword_in_group", "rewrite_cycle"}


def test_stems():
    assert stem.stem("running", "en") == stem.stem("runn", "en") and stem.stem("телефоны", "ru") == stem.stem("телефон", "ru") and stem.stem("Wohnungen", "de") == stem.stem("Wohnung", "de")


@settings(max_examples=50, deadline=None)
@given(st.floats(-89, 89), st.floats(-180, 180), st.floats(1, 3000), st.floats(0, 360))
def test_a_circle_is_inside_its_box(lat, lon, km, angle):
    import math

    south, west, north, east = geo.radius_box(lat, lon, km)
    d = km / 6371.0 * 0.99
    a = math.asin(math.sin(math.radians(lat)) * math.cos(d) + math.cos(math.radians(lat)) * math.sin(d) * math.cos(math.radians(angle)))
    b = math.radians(lon) + math.atan2(math.sin(math.radians(angle)) * math.sin(d) * math.cos(math.radians(lat)), math.cos(d) - math.sin(math.radians(lat)) * math.sin(a))
    x = (math.degrees(b) + 540) % 360 - 180
    assert south - 1e-6 <= math.degrees(a) <= north + 1e-6
    if abs(lat) + km / 100 < 80:
        assert west - 1e-6 <= x <= east + 1e-6 if west <= east else x >= west - 1e-6 or x <= east + 1e-6


def test_geohash_column_is_the_function(spark):
    points = [(49.6116, 6.1319), (-10.5, 179.9), (0.0, 0.0), (89.9, -180.0)]
    rows = spark.createDataFrame(points, "a double, b double").select("a", "b", geo.geohash_col(F.col("a"), F.col("b")).alias("h")).collect()
    assert [r.h for r in rows] == [geo.geohash(r.a, r.b) for r in rows]
    assert geo.geohash(57.64911, 10.40744, 11) == "u4pruydqqvj" and geo.box_prefix(0, 170, 1, -170) == ""


def test_build_of_all_kinds(spark):
    rows = [doc("1", features={"b": scalar("bool", True), "h": ("hex_color", "#f00", None, "red"), "x": scalar("header", "no"), "n": scalar("float", "1.5"), "bad": scalar("int", "many"), "s": scalar("select", "one"), "odd": scalar("never_heard_of", "v"), "e": scalar("string", ""), "p": listed("hierarchical_select", "r", "s")})]
    rows.append(doc("2", features=None, features_search={"k": ["v", "", "w"]}))
    got = {r.doc_key: r for r in index(spark, rows).collect()}
    assert sorted(got["1"].facet_terms) == ["b=True", "h=red", "odd=v", "p=r", "p=r/s", "s=one"] and got["1"].numbers == {"n": Decimal("1.5")}
    assert got["2"].facet_terms == ["k=v", "k=w"] and got["2"].facets == {"k": ["v", "w"]}


def test_long_terms_are_cut_and_counted(spark):
    r = index(spark, [doc("1", features={"t": scalar("string", "y" * 200)})]).first()
    assert len(r.facet_terms[0]) == 160 and r.truncated_terms == 1


def test_facet_plan():
    features = [{"slug": "brand", "config": {"type": "select", "options": [{"value": "a"}]}}, {"slug": "open", "config": {"type": "select", "options": [{"value": "a"}], "allowCustom": True}}, {"slug": "head", "config": {"type": "header"}}]
    p = facets.facet_plan(features)
    assert p.slugs == ("brand", "open") and p.options == {"brand": ("a",)}
    p = facets.facet_plan(features, tuple(f"x{k}" for k in range(12)) + ("open",))
    assert p.slugs[0] == "open" and p.left_out == ("x11",) and p.kinds["x0"] == "term"


def test_one_pass_counts_are_the_per_slug_counts(spark):
    rng = random.Random(4)
    rows = [doc(str(k), features={s: scalar("string", rng.choice("abc")) for s in "xyz" if rng.random() < 0.9}) for k in range(80)]
    df = index(spark, rows).persist()
    q = Search("thing", chosen={"x": ["a"], "y": ["b", "c"]}, as_of="2026-01-01")
    got = {(r.slug, r.value): r["count"] for r in facets.facet_counts(df, q, CountPlan(("x", "y", "z"))).collect()}
    expected = {}
    for s in "xyz":
        for r in candidates(df, q, skip=s).select(F.explode("facet_terms").alias("t")).where(F.startswith("t", F.lit(f"{s}="))).groupBy("t").count().collect():
            expected[s, r.t[2:]] = r["count"]
    assert got == expected


def replay(log, state=(0, "", None)):
    seq, eid, value = state
    skipped = {"duplicates": 0, "stale": 0, "applied": 0}
    for _, s, e, v in sorted(log):
        if e and e == eid:
            skipped["duplicates"] += 1
        elif s and seq and s < seq:
            skipped["stale"] += 1
        else:
            seq, eid, value = s or seq, e, v
            skipped["applied"] += 1
    return (seq, eid, value), skipped


def test_guard_fold_is_a_sequential_replay(spark):
    rng = random.Random(5)
    logs = {str(k): [(a, rng.choice([0, 0, 5, 6, 7, 8]), rng.choice(["", "e1", "e2"]), f"v{a}") for a in range(rng.randrange(1, 12))] for k in range(40)}
    held = {str(k): (6, "e1", "old") for k in range(0, 50, 3)}
    log = spark.createDataFrame([(k, *r) for k, rows in logs.items() for r in rows], "doc_key string, arrival long, seq long, eid string, v string")
    state = spark.createDataFrame([(k, *r) for k, r in held.items()], "doc_key string, seq long, eid string, v string")
    for start in (None, state):
        got = {r.doc_key: ((r.seq, r.eid, r.v), {c: r[c] for c in ("duplicates", "stale", "applied")}) for r in changes.guard_fold(log, ["v"], start).collect()}
        assert got == {k: replay(rows, held.get(k, (0, "", None)) if start is not None else (0, "", None)) for k, rows in logs.items()}


def test_drift_purge_erase_catch_up(spark):
    own = spark.createDataFrame([("a", 1), ("b", 5), ("x", 1)], "doc_key string, seq long")
    source = spark.createDataFrame([("a", 2), ("b", 5), ("c", 1)], "doc_key string, seq long")
    r = changes.drift(own, source).first()
    assert (r.missing, r.surplus, r.stale, r.in_sync) == (1, 1, 2, False)
    df = index(spark).withColumn("indexed_at", F.lit("2026-01-01").cast("timestamp"))
    assert changes.purged(df, "2026-01-30").count() == 4 and changes.purged(df, "2026-01-03").count() == 5
    assert changes.erased(df, spark.createDataFrame([("u2",), ("",)], "owner_key string")).count() == 4
    assert changes.catch_up(df.withColumn("source_updated_at", F.lit("2025-01-01").cast("timestamp")), "2026-01-01").count() == 5


def test_stream_is_the_fold(spark, tmp_path):
    from tidewell.streaming.jobs import ingest_stream, state, signal_state, signal_stream

    log = spark.createDataFrame([(str(k % 7), k, k % 11, f"e{k}", f"v{k}") for k in range(60)], "doc_key string, arrival long, seq long, eid string, v string")
    for k in range(3):  # files are read in the order in which they were written
        log.where(f"arrival div 20 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    ingest_stream(stream, ["v"], str(tmp_path / "state"), str(tmp_path / "c")).awaitTermination()
    got = {(r.doc_key, r.seq, r.v) for r in state(spark, str(tmp_path / "state")).collect()}
    whole = {(r.doc_key, r.seq, r.v) for r in changes.guard_fold(log, ["v"]).collect()}
    assert {k for k, _, _ in got} == {k for k, _, _ in whole} and got == whole
    signals = spark.createDataFrame([(1, "s1", "a", "boost", 9.0, None), (2, "s2", "a", "boost", 2.0, None), (1, "s1", "a", "boost", 9.0, None)], "arrival long, sig_id string, doc_key string, kind string, value double, expires_at timestamp")
    signals.write.parquet(str(tmp_path / "sig"))
    signal_stream(spark.readStream.schema(signals.schema).parquet(str(tmp_path / "sig")), str(tmp_path / "sigs"), str(tmp_path / "c2")).awaitTermination()
    assert signal_state(spark, str(tmp_path / "sigs")).first().boost == 2.0


def test_registries():
    merged = FACET_MAPPINGS.overlay({"header": None, "colour": FacetMapping("term", lambda f: F.array(f["scalar"]))})
    assert "header" not in merged and "header" in FACET_MAPPINGS and mapping_of("colour", merged).kind == "term"
    with pytest.raises(ValueError):
        FacetMapping("bucket", lambda f: f)
    assert Source("t", lambda s, d: None, key_fields=("id", "key")).key_of({"id": "", "key": 7}) == "7"
    assert isinstance(SCORERS.overlay({"popularity": None}), Registry)


def test_entry_imports():
    import __spark_entry__ as e

    assert "q_search_flagship" in e.queries() and set(k for k in e.oracle_sql()) <= set(e.queries())
