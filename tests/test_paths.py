"""Write paths end to end, and the plans that queries come to."""

import json

from pyspark.sql import functions as F

from tests.corpus import doc, index
from tidewell import __main__ as cli
from tidewell.conf import EngineConf
from tidewell.model import INPUT_SCHEMA, CountPlan
from tidewell.operators import build, changes, filters, ranking
from tidewell.operators.facets import facet_counts
from tidewell.plans.engine import Engine
from tidewell.queries import ask
from tidewell.sources import events
from tidewell.sources.corpora import SOURCES

AT = "2026-05-01 00:00:00"


def test_ingest_applies_guards_and_keeps_signals(spark):
    old = index(spark).withColumns({"boost": F.lit(2.0), "source_event_id": F.lit("e1"), "source_seq": F.lit(5).cast("bigint")})
    built = index(spark, [doc("1", "new title"), doc("2", "late"), doc("3", "again"), doc("7", "first")]).drop("indexed_at").withColumn("indexed_at", F.lit(AT).cast("timestamp"))
    keys = spark.createDataFrame([("thing", "1", "e2", 6), ("thing", "2", "e3", 4), ("thing", "3", "e1", 9), ("thing", "7", "e4", 1), ("thing", "4", "e5", 7), ("thing", "x", "e6", 1)], "doc_type string, doc_key string, eid string, seq long")
    after, report = changes.ingest(old, built, keys, AT)
    rows = {r.doc_key: r for r in after.collect()}
    assert rows["1"].title == "new title" and rows["1"].boost == 2.0 and rows["1"].source_seq == 6
    assert rows["2"].title == "Samsung Galaxy" and rows["3"].title == "Ноутбук Lenovo" and rows["7"].visible and not rows["4"].visible and len(rows) == 6
    assert report.first().asDict() == {"indexed": 2, "duplicate": 1, "stale": 1, "truncated": 0, "removed": 1, "missing": 2}


def test_events(spark):
    rows = [("a", "listing.updated", 10, {"listing_id": "7"}), ("b", "listing.updated", 11, {}), ("c", "other", 12, {"listing_id": "8"}), ("d", "search.signal", 13, {"doc_type": "listing", "doc_key": "7", "boost": 9.0, "promoted": True}), ("e", "user.deleted", 14, {"user_id": "u"})]
    df = spark.createDataFrame([(i, n, t, json.dumps(p)) for i, n, t, p in rows], events.ENVELOPE)
    assert [tuple(r) for r in events.keys_of(df, SOURCES["listing"]).collect()] == [("listing", "7", "a", 10)]
    s = changes.last_signals(events.signals_of(df)).first()
    assert (s.doc_key, s.boost, s.popularity, s.promoted) == ("7", 5.0, 0, True)
    assert [r.owner_key for r in events.deleted_owners(df).collect()] == ["u"] and events.check_wiring(SOURCES) == []


def test_category_paths(spark):
    df = spark.createDataFrame([("a", "c1", None), ("b", "c9", None), ("c", None, ["own"])], "doc_key string, category_id string, category_path array<string>")
    known = spark.createDataFrame([("c1", ["root", "c1"])], "category_id string, path array<string>")
    assert {r.doc_key: r.category_path for r in build.attach_category_path(df, known).collect()} == {"a": ["root", "c1"], "b": ["c9"], "c": ["own"]}


def test_validation_and_sampling(spark):
    inputs = spark.createDataFrame([doc("1", features={"odd": ("unheard", "v", None, None)})], INPUT_SCHEMA)
    assert Engine(index(spark)).validate(inputs) == ["W002:unheard"]
    e = Engine(index(spark), EngineConf(facet_candidate_cap=1), SOURCES.overlay({"thing": SOURCES["listing"]}))
    out = e.search({"type": "thing", "facets": "brand", "as_of": AT})
    assert out["facet_meta"]["approximate"] and out["degraded"] == ["exact_facet_counts"] and "exact_facet_counts" not in e.capabilities.able


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_plans(spark, tmp_path):
    e = Engine(index(spark)).stored(str(tmp_path / "i"))
    q = ask(doc_type="thing", owner="u1", sort="price_asc", limit=5)
    text = plan(ranking.page(e.hits(q), q))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text and "Python" not in text
    assert "EqualTo(owner_key,u1)" in text and "EqualTo(visible,true)" in text and "PartitionFilters" in text
    assert "body" not in text.split("ReadSchema:")[1].split("\n")[0]
    text = plan(facet_counts(e.index, q, CountPlan(("brand",))))
    assert text.split("(1) Scan")[0].count("Exchange") == 1
    assert filters.candidates(e.index, q).count() == 3


def test_commands(spark, tmp_path, capsys):
    assert cli.main(["lint"]) == 0 and cli.main(["ranking"]) == 0
    where = ["--data", "/root/testdata/sf0.001", "--index", str(tmp_path / "i")]
    assert cli.main(["rebuild", *where]) == 0 and cli.main(["drift", *where]) == 0 and cli.main(["search", *where, "--params", '{"f.brand": "Brand#2", "limit": "2"}']) == 0
    lines = capsys.readouterr().out.strip().splitlines()
    assert json.loads(lines[-2])["in_sync"] and len(json.loads(lines[-1])["items"]) <= 2

    assert cli.main(["reindex", *where, "--keys", "1,2,none"]) == 0 and cli.main(["catch-up", *where]) == 0 and cli.main(["purge", *where]) == 0 and cli.main(["expire", *where]) == 0
    assert cli.main(["rebuild", *where, "--type", "page"]) == 0 and cli.main(["health", *where]) == 0 and cli.main(["validate", *where]) == 0 and cli.main(["suggest", *where, "--prefix", "re"]) == 0
    lines = [json.loads(line) if line.startswith("{") else line for line in capsys.readouterr().out.strip().splitlines()]
    assert lines[0] == {"indexed": 2, "removed": 0, "missing": 1, "duplicate": 0, "stale": 0, "truncated": 0} and len(lines[-1]["items"]) > 0
    # a rebuild of pages leaves listings as they were
    types = next(x["types"] for x in lines if isinstance(x, dict) and "types" in x)
    assert types["listing"]["documents"] > 100 and types["page"]["documents"] == 50
    settings = tmp_path / "s.json"
    settings.write_text(json.dumps({"TYPO_THRESHOLD": 5}))
    assert cli.main(["settings", "--settings", str(settings)]) == 0 and json.loads(capsys.readouterr().out)["typo_threshold"] == 5


def two(spark):
    """A thing and a page of the same key."""
    own = index(spark, [doc("1", "one"), doc("2", "two")])
    return own.unionByName(index(spark, [doc("1", "page one", doc_type="page")]))


def test_types_with_one_key_stay_apart(spark):
    both = two(spark).withColumn("boost", F.when(F.col("doc_type") == "page", 2.0).otherwise(1.0))
    gone = spark.createDataFrame([("thing", "1")], "doc_type string, doc_key string")
    seen = lambda df: {(r.doc_type, r.doc_key): r for r in df.collect()}
    hidden = seen(changes.tombstones(both, gone, AT))
    assert not hidden["thing", "1"].visible and hidden["page", "1"].visible
    built = index(spark, [doc("1", "new")])
    keys = spark.createDataFrame([("thing", "1", "e", 9), ("thing", "2", "e", 9)], "doc_type string, doc_key string, eid string, seq long")
    after, report = changes.ingest(both, built, keys, AT)
    rows = seen(after)
    assert rows["thing", "1"].title == "new" and rows["page", "1"].title == "page one" and rows["page", "1"].boost == 2.0 and rows["thing", "1"].boost == 1.0 and not rows["thing", "2"].visible
    assert changes.merged(report, report).first().asDict() == {"indexed": 2, "removed": 2, "missing": 2, "duplicate": 0, "stale": 0, "truncated": 0}
    rebuilt = seen(changes.rebuild(both, built.drop("indexed_at").withColumn("indexed_at", F.lit(AT).cast("timestamp")).select(*both.columns), AT))
    assert rebuilt["page", "1"].visible and rebuilt["page", "1"].boost == 2.0 and rebuilt["thing", "1"].boost == 1.0 and not rebuilt["thing", "2"].visible
    emptied = seen(changes.rebuild(both, built.limit(0).select(*both.columns), AT, ("thing",)))
    assert not emptied["thing", "1"].visible and emptied["page", "1"].visible


def test_signals_without_ids_and_of_types(spark):
    rows = [(1, "", "thing", "1", "boost", 1.0, None), (2, "", "thing", "2", "boost", 2.0, None), (3, None, "page", "1", "promoted", 1.0, None), (4, "s", "thing", "1", "popularity", 5.0, None), (5, "s", "thing", "1", "popularity", 9.0, None)]
    log = spark.createDataFrame(rows, "arrival long, sig_id string, doc_type string, doc_key string, kind string, value double, expires_at timestamp")
    got = {(r.doc_type, r.doc_key): (r.boost, r.popularity, r.promoted) for r in changes.last_signals(log).collect()}
    assert got == {("thing", "1"): (1.0, 5, False), ("thing", "2"): (2.0, 0, False), ("page", "1"): (0.0, 0, True)}
    both = two(spark).withColumn("popularity", F.lit(7))
    after = {(r.doc_type, r.doc_key): (r.boost, r.popularity, r.promoted) for r in changes.with_signals(both, changes.folded_signals(log)).collect()}
    # a kind that nobody signalled stays
    assert after == {("thing", "1"): (1.0, 5, False), ("thing", "2"): (2.0, 7, False), ("page", "1"): (0.0, 7, True)}
    audit = changes.signal_audit(both.where("doc_key = '1'"), log).collect()
    assert len(audit) == 4 and sum(not r.applied for r in audit) == 1


def test_latest_by_sequence_is_the_fold(spark):
    import random

    rng = random.Random(7)
    rows = [(k, str(rng.randrange(12)), f"e{k}", rng.choice([0, 0, *range(1, 9)]), f"v{k}") for k in range(400)]
    log = spark.createDataFrame(rows, "arrival long, doc_key string, eid string, seq long, title string")
    fold = {r.doc_key: (r.title, r.seq) for r in changes.guard_fold(log, ["title"]).collect()}
    latest = changes.latest_by_sequence(log, ["title"])
    assert {r.doc_key: (r.title, r.seq) for r in latest.collect()} == fold
    assert "Window" not in plan(latest)


def test_event_stream(spark, tmp_path):
    from tidewell.sources.registry import Registry, Source
    from tidewell.streaming.jobs import event_stream, state

    sources = Registry({"thing": Source("thing", lambda s, d: None, signals=("listing.updated",)), "page": Source("page", lambda s, d: None, key_fields=("page_id",), signals=("listing.published",))})
    docs = index(spark, [doc("1", "one", category_path=["root", "c1"]), doc("2", "two", owner_key="gone"), doc("3", "three")]).unionByName(index(spark, [doc("1", "page", doc_type="page")]))
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    batches = [
        [("a", "listing.updated", 10, {"key": "1"}), ("b", "listing.updated", 11, {"key": "2"}), ("c", "listing.published", 12, {"page_id": "1"}), ("d", "listing.updated", 12, {"other": "1"})],
        [("e", "search.signal", 20, {"doc_type": "thing", "doc_key": "1", "boost": 2.0}), ("f", "listing.updated", 21, {"key": "9"}), ("g", "listing.updated", 5, {"key": "1"})],
        [("h", "user.deleted", 30, {"user_id": "gone"}), ("i", "category.changed", 31, {"category_id": "c1", "revision": 2}), ("j", "listing.updated", 32, {"key": "3"})],
    ]
    paths = lambda moved: moved.select("category_id", F.array(F.lit("top"), F.col("category_id")).alias("path"))
    for rows in batches:
        spark.createDataFrame([(i, n, t, json.dumps(p)) for i, n, t, p in rows], events.ENVELOPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(events.ENVELOPE).parquet(str(tmp_path / "in"))
        event_stream(stream, sources, lambda kind, keys: changes.pulled(docs.where(F.col("doc_type") == kind), keys), str(tmp_path / "state"), str(tmp_path / "cp"), paths).awaitTermination()
    rows = {(r.doc_type, r.doc_key): r for r in state(spark, str(tmp_path / "state")).collect()}
    assert rows.keys() == {("thing", "1"), ("page", "1"), ("thing", "3")}
    assert rows["thing", "1"].boost == 2.0 and rows["thing", "1"].source_seq == 10 and list(rows["thing", "1"].category_path) == ["top", "c1"]
    # two states of a bucket at most
    assert all(len(list((tmp_path / "state").glob(f"v=*/bucket={b}"))) <= 2 for b in range(64))
    bad = spark.createDataFrame([(i, n, t, json.dumps(p)) for i, n, t, p in batches[0]], events.ENVELOPE)
    assert [(r.doc_type, r.event_id) for r in events.without_key(bad, sources).collect()] == [("thing", "d")]


def test_event_numbers_beyond_times(spark, tmp_path):
    from tidewell.sources.registry import Registry, Source
    from tidewell.streaming.jobs import event_stream, state

    sources = Registry({"thing": Source("thing", lambda s, d: None, signals=("listing.updated",))})
    rows = [("a", "listing.updated", 1_000, {"key": "1"}), ("b", "listing.updated", -(2**63), {"key": "2"}), ("c", "search.signal", 2**62, {"doc_type": "thing", "doc_key": "1", "boost": 2.0}), ("d", "search.signal", 2**62 - 1, {"doc_type": "thing", "doc_key": "1", "boost": 3.0})]
    spark.createDataFrame([(i, n, t, json.dumps(p)) for i, n, t, p in rows], events.ENVELOPE).coalesce(1).write.parquet(str(tmp_path / "in"))
    event_stream(spark.readStream.schema(events.ENVELOPE).parquet(str(tmp_path / "in")), sources, lambda kind, keys: changes.pulled(index(spark), keys), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    got = {r.doc_key: (r.boost, r.source_seq, r.at) for r in state(spark, str(tmp_path / "state")).withColumn("at", F.col("indexed_at").cast("string")).collect()}
    assert got == {"1": (2.0, 1_000, "1970-01-01 00:00:01"), "2": (0.0, -(2**63), "1970-01-01 00:00:01")}


def test_wiring_is_refused():
    import pytest

    from tidewell.sources.registry import Registry, Source

    with pytest.raises(ValueError, match="E004:x:never.heard"):
        events.wire(Registry({"x": Source("x", lambda s, d: None, signals=("never.heard",))}))
    assert events.wire(SOURCES) is SOURCES


def test_schedules(spark):
    from datetime import datetime

    from tidewell.streaming.schedule import due, jobs, run_due

    now = datetime(2026, 5, 1, 3, 25)
    names = lambda last: [j.name for j in due(now, last)]
    assert names({}) == list(jobs())
    assert names(dict.fromkeys(jobs(), datetime(2026, 5, 1, 3, 21))) == ["expire_signals"]
    assert names(dict.fromkeys(jobs(), datetime(2026, 5, 1, 3, 19))) == list(jobs()) and names(dict.fromkeys(jobs(), now)) == []
    assert [j.name for j in due(datetime(2026, 5, 1, 3, 10), dict.fromkeys(jobs(), datetime(2026, 4, 30, 23, 59)))] == ["reindex_stale", "expire_signals"]
    rows = index(spark).withColumns({"source_updated_at": F.lit("2026-04-01").cast("timestamp"), "promoted": F.lit(True), "promotion_expires_at": F.lit("2026-04-02").cast("timestamp")})
    after, keys, ran = run_due(rows, now, {})
    assert ran == list(jobs()) and keys.count() == 5 and after.where("promoted").count() == 0 and after.where("visible").count() == 4 and after.count() == 4


def test_settings_and_dictionaries(tmp_path):
    import pytest

    from tidewell.functions.text import dictionary

    file = tmp_path / "d.json"
    file.write_text(json.dumps({"version": 7, "equivalents": [["bike", "Bicycle"]], "stopwords": ["Very"]}), encoding="utf-8")
    conf = EngineConf.of({"DICTIONARIES": {"en": [str(file), "tests.corpus.WORDS", {"rewrites": {"fone": "phone"}}]}, "max_page_size": 5})
    d = dictionary("en", conf)
    assert d.version == 7 and d.group("bike") == ("bike", "bicycle") and "very" in d.stopwords and d.rewrites == {"fone": "phone"} and d.group("couch") == ("couch", "sofa") and conf.max_page_size == 5
    with pytest.raises(ValueError, match="unknown settings: no_such"):
        EngineConf.of({"no_such": 1})
    with pytest.raises(ImportError):
        dictionary("en", EngineConf(dictionaries={"en": "nowhere"}))
    with pytest.raises(TypeError):
        dictionary("en", EngineConf(dictionaries={"en": 3}))


def test_all_checks(spark):
    conf = EngineConf(engine="tidewell.plans.engine.Nothing", sorts=("newest", "popular", "odd"))
    inputs = spark.createDataFrame([doc("1", category_id="c9", category_path=None)], INPUT_SCHEMA)
    e = Engine(index(spark).drop("stems").withColumn("truncated_terms", F.lit(1)), conf)
    found = e.validate(inputs, scheduled=("expire_signals",))
    assert found == ["E001:tidewell.plans.engine.Nothing", "E002:odd", "E003:stems", "W006", "W003:reindex_stale", "W003:purge_tombstones", "W004", "W005"]
    known = spark.createDataFrame([("c9", ["root", "c9"])], "category_id string, path array<string>")
    assert "W006" not in e.validate(inputs, categories=known)
    assert Engine(index(spark), EngineConf(engine="collections.OrderedDict")).validate()[:2] == ["E002:search", "E002:suggest"]


def test_degraded_paths_are_said(spark):
    from tidewell.sources.registry import Registry, Source

    inputs = spark.createDataFrame([doc("1", category_id="c9", category_path=None)], INPUT_SCHEMA)
    sources = Registry({"thing": Source("thing", lambda s, d: inputs)})
    out = Engine.over(spark, "", ("thing",), sources=sources).search({"type": "thing", "category": "c9", "as_of": AT})
    assert out["degraded"] == ["category_path"] and [i["key"] for i in out["items"]] == ["1"]
    known = spark.createDataFrame([("c9", ["root", "c9"])], "category_id string, path array<string>")
    out = Engine.over(spark, "", ("thing",), sources=sources, categories=known).search({"type": "thing", "category": "root", "as_of": AT})
    assert out["degraded"] == [] and [i["key"] for i in out["items"]] == ["1"]


def test_stems_and_postings(spark, tmp_path):
    from tidewell.functions.text import normalize_query
    from tidewell.operators import postings

    rows = index(spark, [doc("1", "Walking boots", language="en"), doc("2", "he walked", "in boots and boots", language="EN"), doc("3", "walk", language="de"), doc("4", "boot walks", status="draft", language="en")])
    e = Engine(rows, sources=SOURCES.overlay({"thing": SOURCES["listing"]}))
    search = lambda text: sorted(i["key"] for i in e.search({"type": "thing", "q": text, "lang": "", "as_of": AT}, "en")["items"])
    assert search("walks boot") == ["1", "2"] and search("walks") == ["1", "2", "3"]
    table = postings.store(rows, str(tmp_path / "p"))
    assert table.where("stem = 'boot'").count() == 2 and table.where("doc_key = '4'").count() == 0
    got = postings.search(rows, table, "thing", normalize_query("walks boot", "en"), "en")
    assert sorted(r.doc_key for r in got.collect()) == ["1", "2"]
    text = plan(postings.matching(table, "thing", normalize_query("walks", "en"), "en"))
    assert "PushedFilters" in text and "EqualTo(stem,walk)" in text or "In(stem" in text


def test_postings_are_segments_of_the_index(spark, tmp_path):
    """Written where they are: each file is some partition's, in the order of stems."""
    from tidewell.operators import postings

    docs = [doc(str(k), f"walk w{k % 7} boots{k}", language="en") for k in range(60)]
    index(spark, docs).repartition(3).write.parquet(str(tmp_path / "i"))
    table = postings.store(spark.read.parquet(str(tmp_path / "i")).repartition(3, "doc_key"), str(tmp_path / "p"))
    files = [spark.read.parquet(str(f)).select("stem", "doc_key").collect() for f in (tmp_path / "p" / "doc_type=thing").glob("*.parquet")]
    assert len(files) == 3 and all(f == sorted(f) for f in files)
    owners = [{r.doc_key for r in f} for f in files]
    assert all(owners) and sum(map(len, owners)) == 60 and table.where("stem = 'walk'").count() == 60
    assert all(f.name.endswith(".zstd.parquet") for f in (tmp_path / "p").rglob("*.parquet"))


def test_texts_are_not_moved_to_their_labels(spark, monkeypatch):
    from tidewell.sources import corpora

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = corpora.document(spark, "/root/testdata/sf0.001")
        assert "BroadcastHashJoin" in plan(sent) and "SortMergeJoin" not in plan(sent)
        monkeypatch.setattr(corpora, "LABELS_SENT", 0)
        moved = corpora.document(spark, "/root/testdata/sf0.001")
        assert "SortMergeJoin" in plan(moved)
        seen = lambda df: sorted((r.doc_key, r.status, r.features["quality"].scalar) for r in df.collect())
        assert seen(sent) == seen(moved)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_geohash_cells():
    from tidewell.functions import geo

    for lat, lon in ((49.6116, 6.1319), (-33.9, 151.2), (0.0, 0.0), (-90.0, -180.0)):
        for n in (1, 5, 12):
            south, west, north, east = geo.geohash_box(geo.geohash(lat, lon, n))
            assert south <= lat < north and west <= lon < east
            assert geo.geohash((south + north) / 2, (west + east) / 2, n) == geo.geohash(lat, lon, n)


def test_cover_density_is_brute_force(spark):
    import random

    from tidewell.functions.covers import cover_density

    rng = random.Random(3)
    texts = [[rng.choice("abcdxyz") for _ in range(rng.randrange(30))] for _ in range(80)]
    for groups in ((("a",),), (("a", "b"), ("c",)), (("a",), ("b",), ("c", "d"))):

        def brute(words):
            runs = [(i, j) for i in range(len(words)) for j in range(i, len(words)) if all(set(g) & set(words[i : j + 1]) for g in groups)]
            least = [(i, j) for i, j in runs if not any((a, b) != (i, j) and i <= a and b <= j for a, b in runs)]
            return sum(1 / (1 + max(0, j - i - (len(groups) - 1))) for i, j in least)

        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t array<string>")
        got = {r.k: r.d for r in df.select("k", cover_density(F.col("t"), groups).alias("d")).collect()}
        assert all(abs(got[k] - brute(t)) < 1e-9 for k, t in enumerate(texts))


def test_tokens_are_folded_alike(spark):
    """Whole texts and token by token; signs that one of Java and Unicode's tables doesn't know; marks before, in and after words."""
    from tidewell.functions.stem import stem, stemmed
    from tidewell.functions.text import fold, tokens, tokens_col

    texts = ["", None, "Plain ASCII-text_with/parts 1-2", "Größe ÉCOLE ΑΣ ΣΑ", "İstanbul e\u0301te\u0301", "и\u0301х й\u0301\u0301b", "\u0482\u0301abc", "ﬁn ẞ", "a\ua7cbb", "\u0301", "x" * 40 + "--y/z"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.w for r in df.select("k", tokens_col(F.col("t")).alias("w")).collect()}
    assert all(got[k] == tokens(texts[k]) for k in (0, 1, 2, 3, 7, 10))
    assert got[4] == ["istanbul", "ete"] and got[6][-1] == "abc" and got[8] == ["a", "b"] and got[9] == [""]
    words = [fold(w) for w in "nationalization hopefulness ness sses Walking walked ies es s edly Häuser Freiheiten ungen en nst ходившись красивыми дома я".split()]
    rows = spark.createDataFrame([(words,)], "w array<string>")
    for language in ("en", "de", "ru", "fr"):
        assert rows.select(stemmed(F.col("w"), language)).first()[0] == [stem(w, language) for w in words]


def test_cover_density_takes_texts_that_may_have_the_words(spark):
    from tidewell.queries import QUERIES

    df = QUERIES["q_cover_density"](spark, "/root/testdata/sf0.001")
    assert "Contains(text_plain" in plan(df)


def test_close_words_rank_first(spark):
    from tidewell.sources.registry import COVER_DENSITY

    rows = index(spark, [doc("1", "red and then a very long way from any ring"), doc("2", "of a red ring")])
    e = Engine(rows, EngineConf(scorers={"cover_density": COVER_DENSITY}), SOURCES.overlay({"thing": SOURCES["listing"]}))
    assert [i["key"] for i in e.search({"type": "thing", "q": "red ring", "sort": "relevance", "as_of": AT}, "en")["items"]] == ["2", "1"]
