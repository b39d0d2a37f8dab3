"""What every engine of this contract has to answer over the five documents."""

from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.corpus import HERE, ROWS, doc, index, scalar
from tidewell.functions.text import normalize_query
from tidewell.model import Between, Box, Circle, CountPlan, Cursor, Search, Words
from tidewell.operators import changes, facets, ranking
from tidewell.plans.engine import Engine
from tidewell.plans.parse import decode_cursor
from tidewell.sources.registry import Registry, Source

AS_OF = "2026-04-02 00:00:00"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    sources = Registry({"thing": Source("thing", lambda s, d: index(s))})
    return Engine(index(spark), sources=sources).stored(str(tmp_path_factory.mktemp("index")))


def ask(**how):
    return Search(**({"doc_type": "thing", "sort": "newest", "limit": 20, "as_of": AS_OF, "counting": False} | how))


def words(text, language=""):
    return normalize_query(text, language)


def keys(engine, **how):
    q = ask(**how)
    return [r.doc_key for r in ranking.page(engine.hits(q), q).collect()]


def box(*b):
    return Box(b[0], b[1], b[2], b[3])


def near(km):
    return Circle(HERE[0], HERE[1], km)


FILTERS = [
    ("all visible", {}, "1234"),
    ("other type", {"doc_type": "other"}, ""),
    ("owner u2", {"owner": "u2"}, "4"),
    ("owner u1", {"owner": "u1"}, "123"),
    ("language", {"only_language": "ru"}, "1234"),
    ("no such language", {"only_language": "de"}, ""),
    ("category", {"within": ("electronics",)}, "123"),
    ("category leaf", {"within": ("electronics", "laptops")}, "3"),
    ("no such category", {"within": ("nonexistent",)}, ""),
    ("facet", {"chosen": {"brand": ["apple"]}}, "1"),
    ("or within", {"chosen": {"brand": ["apple", "samsung"]}}, "12"),
    ("and across", {"chosen": {"brand": ["apple"], "color": ["blue"]}}, ""),
    ("several values", {"chosen": {"color": ["red"]}}, "12"),
    ("several values, one", {"chosen": {"color": ["blue"]}}, "2"),
    ("path root", {"chosen": {"tree": ["a"]}}, "1"),
    ("path middle", {"chosen": {"tree": ["a/b"]}}, "1"),
    ("path leaf", {"chosen": {"tree": ["a/b/c"]}}, "1"),
    ("path inner name", {"chosen": {"tree": ["b"]}}, ""),
    ("range from", {"between": (Between("year", Decimal(2015)),)}, "13"),
    ("range both", {"between": (Between("year", Decimal(2014), Decimal(2015)),)}, "12"),
    ("range to", {"between": (Between("year", None, Decimal(2014)),)}, "2"),
    ("price range", {"between": (Between("price", Decimal(100), None),)}, "12"),
    ("word in title", {"words": words("Samsung")}, "2"),
    ("word in body", {"words": words("работы", "ru")}, "3"),
    ("word in extra", {"words": words("128")}, "1"),
    ("unknown word", {"words": words("nonexistentword")}, ""),
    ("both words", {"words": words("Samsung Lenovo")}, ""),
    ("synonym", {"words": words("самсунг", "ru")}, "2"),
    ("10 km", {"area": near(10)}, "12"),
    ("1 km", {"area": near(1)}, "1"),
    ("centre alone", {"area": near(None)}, "1234"),
    ("box", {"area": box(49.0, 6.0, 50.0, 7.0)}, "12"),
    ("box over the date line", {"area": box(-10.0, 179.0, 10.0, -179.0)}, "4"),
    ("box the long way", {"area": box(-10.0, -179.0, 10.0, 179.0)}, ""),
]


@pytest.mark.parametrize("how,expected", [pytest.param(h, e, id=n) for n, h, e in FILTERS])
def test_candidates(engine, how, expected):
    assert sorted(keys(engine, **how)) == list(expected)


@pytest.mark.parametrize("sort,expected", [("newest", "3241"), ("price_asc", "4213"), ("price_desc", "1243")])
def test_sorts_put_nulls_last_and_are_stable(engine, sort, expected):
    assert keys(engine, sort=sort) == list(expected) == keys(engine, sort=sort)


def test_distance_is_sorted_and_reported(engine):
    assert keys(engine, sort="distance", area=near(500)) == ["1", "2", "3"]
    found = {i["key"]: i["distance_km"] for i in engine.search(ask(area=near(10)))["items"]}
    assert found["1"] < 0.5 and 3 < found["2"] < 6


def test_empty_index(spark):
    out = Engine(index(spark).where("false")).search(ask())
    assert out["items"] == [] and out["count"] == 0 and not out["has_next"]


def test_tombstone_and_repeated_build(spark):
    df = index(spark)
    hidden = changes.tombstones(df, df.where("doc_key = '2'"), AS_OF)
    assert sorted(keys(Engine(hidden))) == ["1", "3", "4"]
    again = changes.rebuild(df, index(spark).drop("indexed_at"), AS_OF)
    assert sorted(keys(Engine(again))) == ["1", "2", "3", "4"]


def counts(engine, **how):
    rows = facets.facet_counts(engine.index, ask(**how), CountPlan(("brand",))).collect()
    return {r.value: r["count"] for r in rows}


def test_facet_counts(engine):
    assert counts(engine) == {"apple": 1, "samsung": 1, "lenovo": 1, "acme": 1}


def test_a_chosen_facet_keeps_its_neighbours(engine):
    assert counts(engine, chosen={"brand": ["apple"]}) == {"apple": 1, "samsung": 1, "lenovo": 1, "acme": 1}


def test_facets_follow_other_filters(engine):
    assert counts(engine, within=("electronics", "laptops")) == {"lenovo": 1}


def test_zero_fill_and_candidates(engine):
    q, plan = ask(chosen={"brand": ["apple"]}), CountPlan(("brand", "color"), {}, {"brand": ("apple", "nokia")})
    rows = {(r.slug, r.value): r["count"] for r in facets.zero_filled(facets.facet_counts(engine.index, q, plan), plan).collect()}
    assert rows["brand", "nokia"] == 0 and rows["color", "red"] == 1 and ("color", "blue") not in rows
    assert {r.slug: r.candidates for r in facets.facet_candidates(engine.index, q, plan).collect()} == {"brand": 4, "color": 1}


def test_typo_is_tolerated(engine):
    assert [i["key"] for i in engine.search(ask(words=words("Samsng")))["items"]] == ["2"]


def with_signals(engine, spark, *rows):
    log = spark.createDataFrame([(k, str(k), *r, None) for k, r in enumerate(rows)], "arrival long, sig_id string, doc_key string, kind string, value double, expires_at timestamp")
    return Engine(changes.with_signals(engine.index, changes.last_signals(log)))


def test_boost_moves_relevance_only(engine, spark):
    boosted = with_signals(engine, spark, ("2", "boost", 50.0), ("3", "boost", 5.0))
    assert keys(boosted, sort="relevance", words=words("телефон", "ru"))[0] == "2"
    assert keys(boosted, sort="price_asc") == ["4", "2", "1", "3"]


def test_popularity_raises_a_score(engine, spark):
    score = lambda e: {r.doc_key: r.score for r in e.hits(ask(sort="relevance", words=words("телефон", "ru"))).collect()}
    assert score(with_signals(engine, spark, ("1", "popularity", 1000.0)))["1"] > score(engine)["1"]


def test_promotion_expires(engine):
    df = engine.index.withColumns({"promoted": F.col("doc_key") == "1", "boost": F.lit(-2.0), "promotion_expires_at": F.when(F.col("doc_key") == "1", F.lit("2026-01-01").cast("timestamp"))})
    rows = {r.doc_key: r for r in changes.expired(df, AS_OF).collect()}
    assert rows["1"].promoted is False and rows["1"].boost == 0.0 and rows["2"].boost == -2.0


def walk(engine, **how):
    q, pages = ask(**how), []
    while True:
        out = engine.search(q)
        pages.append([i["key"] for i in out["items"]])
        if not out["has_next"]:
            return pages, out
        q = replace(q, cursor=decode_cursor(out["next_anchor"]))


@pytest.mark.parametrize("sort", ["newest", "price_asc", "price_desc", "relevance"])
def test_pages_cover_everything_once(engine, sort):
    pages, _ = walk(engine, sort=sort, limit=2)
    assert [k for p in pages for k in p] == keys(engine, sort=sort) and [len(p) for p in pages] == [2, 2]


def test_page_back(engine):
    _, last = walk(engine, sort="newest", limit=2)
    back = engine.search(ask(limit=2, backwards=True, cursor=decode_cursor(last["prev_anchor"])))
    assert [i["key"] for i in back["items"]] == ["3", "2"] and back["has_next"]


def test_a_row_put_in_between_shifts_no_page(engine, spark):
    first = engine.search(ask(limit=2))
    more = Engine(index(spark, [*ROWS, doc("6", "Put in between", published="2026-02-15", features={"brand": scalar("string", "acme")})]))
    second = more.search(ask(limit=2, cursor=decode_cursor(first["next_anchor"])))
    assert not {i["key"] for i in first["items"]} & {i["key"] for i in second["items"]}


def test_total_is_exact_or_capped(engine):
    out = engine.search(ask())
    assert out["count"] == 4 and out["exact_total"]
    assert ranking.total(engine.candidates(ask()), 2) == (3, False)


def test_suggest(engine):
    assert engine.suggest("thing", "APP", 5)["items"] == ["Apple iPhone 13 Pro"]
    assert engine.suggest("thing", "", 5)["items"] == sorted(engine.suggest("thing", "")["items"])


def test_capabilities_health_disclosure(engine):
    caps = engine.capabilities
    assert caps.limits["max_result_window"] > 0 and caps.limits["max_facet_fields"] > 0 and "relevance" in caps.scorers and "exact_facet_counts" in caps.able
    assert engine.health(AS_OF)["types"]["thing"] == {"documents": 4, "lag_seconds": 86400}
    assert [d["slug"] for d in engine.ranking()] == sorted(d["slug"] for d in engine.ranking())


def test_normalised_query_is_one_for_all():
    a = normalize_query("Айфон б/у продам", "ru")
    assert a == normalize_query("Айфон б/у продам", "ru")
    assert "продам" in a.dropped and any("iphone" in g for g in a.groups) and isinstance(a, Words)


def test_cursor_without_value(engine):
    assert keys(engine, sort="price_asc", cursor=Cursor(None, "2", 2)) == ["3"]
