"""Token counts, fingerprints, URL rules, archives: against libraries, brute force and round trips."""

import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidewell.llm import fingerprints, token_counts, url_filter, warc
from tidewell.llm.common import mix64, word_count

DOCS = "doc_id long, text string, id string, size string, fingerprint string"


def docs(spark, texts):
    return spark.createDataFrame([(k if k != 3 else None, t, "clash", "clash", "clash") for k, t in enumerate(texts)], DOCS)


EDGES = [None, "", " ", "a", "no id", "same text", "same text", "é" * 30 + " ▁x  y\n\n z\t", "日本 語😀", "word " * 3000, "x" * 5000]


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def test_token_counts_are_the_librarys(model):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(1)
    texts = [t or "" for t in EDGES] + [" " * n + "q" + " " * n for n in range(40)] + ["<s>x</s><0x0A>", "ababab" * 30, "aaaa" * 40]
    texts += ["".join(rng.choice("ab eé\n ▁the,.in 0日😀\t") for _ in range(rng.randrange(80))) for _ in range(800)]
    counter = token_counts.Counter(token_counts.PieceModel(model), remember=500)
    assert counter.texts(texts) == [len(x) for x in sp.encode(texts)]


def test_token_counts_query(spark, model):
    rows = {(r.doc_id, r.n_bytes): r for r in token_counts.token_counts(docs(spark, EDGES), model, limit=2000).collect()}
    assert len(rows) == len(EDGES) and rows[0, 0].n_tokens == 0 and rows[9, 15000].over_limit and not rows[5, 9].over_limit
    assert token_counts.token_counts(docs(spark, EDGES).limit(0), model).count() == 0


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        token_counts.PieceModel(b"")


def brute_signature(text, k=fingerprints.K, l=fingerprints.L):  # noqa: E741
    points = [ord(c) for c in text]
    if not points:
        return [0] * fingerprints.M
    grams = [points] if len(points) <= k else [points[i : i + k] for i in range(len(points) - k + 1)]
    low, seen, elements = (1 << 31) - 1, {}, []
    m = lambda v: int(mix64(np.array([v % (1 << 64)], np.uint64))[0])
    for at, g in enumerate(grams):
        h = len(points) if len(points) <= k else 0
        for p in g:
            h = (h * fingerprints.BASE + p) % (1 << 64)
        same = m(h) >> 31
        n = seen[same] = seen.get(same, -1) + 1
        elements.append((m(same * 0xD6E8FEB86659FD93 + n + 1) & ~low | at, at))
    out = []
    for offset in map(int, fingerprints.OFFSETS):
        first = sorted(elements, key=lambda e: (e[0] - offset) % (1 << 64))[: min(l, len(elements))]
        v = len(first)
        for e, _ in sorted(first, key=lambda e: e[1]):
            v = m(v * 0x9FB21C651E98DF25 + (e >> 31) + 1)
        out.append(v >> 48)
    return out


@pytest.mark.parametrize("text", ["", "a", "short text", "exactly 12 c", "repeat repeat repeat repeat repeat", "éü日本😀 mixed signs and some more"])
def test_signature_is_brute_force(text):
    assert fingerprints.signature(text).tolist() == brute_signature(text)


def test_likeness_falls_with_edits_and_order():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    a, swapped, one = (fingerprints.signature(" ".join(w)) for w in (words, words[100:] + words[:100], [*words[:50], "edit", *words[51:]]))
    other = fingerprints.signature(" ".join(words[::-1]))
    assert fingerprints.likeness(a, one) > fingerprints.likeness(a, swapped) > fingerprints.likeness(a, other)


def test_compare_with_next(spark):
    texts = [*EDGES, "tie b", "tie a"]
    df = docs(spark, texts).withColumn("doc_id", F.expr("IF(text IN ('tie a', 'tie b'), 50, doc_id)")).repartition(3)
    ordered = sorted(((k if k < len(EDGES) else 50, t or "") for k, t in enumerate(texts) if k != 3))
    expected = []
    for k, (i, t) in enumerate(ordered):
        n = len(t) // 4
        changed = t[: len(t) - n] + ordered[(k + 1) % len(ordered)][1][:n]
        expected.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.as_hex(fingerprints.signature(t)), fingerprints.as_hex(fingerprints.signature(changed))))
    for how in ({"rows_per_range": 2}, {"rows_per_range": 1}, {}, {"rows_per_range": 1, "most_cuts": 2}, {"rows_per_range": 1, "most_cuts": 3, "most_parts": 2}):
        rows = fingerprints.compare_with_next(df, **how).collect()
        assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in rows if r.doc_id is not None) == sorted(expected)
        assert len(rows) == len(texts) and all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
    assert fingerprints.compare_with_next(df.limit(0)).count() == 0
    assert fingerprints.fingerprints(df).count() == len(texts)


def test_buckets_keep_the_order(spark):
    """Bisection over many cuts, with parts between them, is as counting them."""
    rng = random.Random(5)
    ids = sorted(rng.randrange(-(1 << 62), 1 << 62) for _ in range(300)) + [7, 7, 8]
    cuts = sorted(rng.sample(ids, 37))
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r.id: (r.a, r.b) for r in df.select("id", fingerprints._bucket(F.col("id"), cuts, min(ids), max(ids), 1).alias("a"), fingerprints._bucket(F.col("id"), cuts, min(ids), max(ids), 5).alias("b")).collect()}
    assert all(a == sum(c < i for c in cuts) and b // 5 == a for i, (a, b) in got.items())
    assert [b for _, (_, b) in sorted(got.items())] == sorted(b for _, b in got.values())


def test_word_count(spark):
    texts = [None, "", " ", "a", " a ", "a\x0bb\x0cc\td\re\nf g", "a\u00a0b c"]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t")).alias("n")).collect()]
    assert got == [0, 0, 0, 1, 1, 7, 2]


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7x?q", "http://example.com/en/1", "http://example.com/en/7", "https://x.example.net/de/8?x", "https://x.example.net/de/1", "https://other.net/de/", "http://net/de/", "http://xnet/de/", "http://a.org#f", "http://a.org/es/#f", "http://casino-palace.com/win", "http://news.example.com/fr/", "http://É.com/p?://x", "x://y://z/en/", "http://a.b/" + "p" * 20000]


#: As the contract has them.
ASKED = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def expected_rule(host, path):
    fits = [r for r in ASKED if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def test_url_rules_and_parts_of_all_pages(spark):
    """host, path and rule in SQL, over whole tables."""
    got = url_filter.judge_urls(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).select("page_id", "host", "path", "rule").collect()
    expected = duckdb.sql(r"""
      WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM '/root/testdata/sf0.01/pages.parquet'),
      h AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
      SELECT page_id, host, path, CASE
        WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/7%' THEN 'example.com/en/7' WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/de/8%' THEN 'example.net/de/8'
        WHEN ('.' || host) LIKE '%.com' AND path LIKE '/en/%' THEN 'com/en/' WHEN ('.' || host) LIKE '%.net' AND path LIKE '/de/%' THEN 'net/de/'
        WHEN ('.' || host) LIKE '%.org' AND path LIKE '/es/%' THEN 'org/es/' END FROM h""").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected)) and len(got) == 250


def test_url_table_holds_no_host_of_the_pages(spark):
    """The model is judged on hosts that it hasn't seen, by their names: spam is named as spam."""
    hosts = {r.h for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(url_filter.host_of(F.col("url")).alias("h")).distinct().collect()}
    sites = {h.split(".example.")[0].rsplit(".", 1)[-1] for h in hosts}
    table = {url_filter.split_url(u)[0] for u, _ in url_filter.SEED}
    assert len(sites) > 20 and not any(s in h for s in sites for h in table)
    model = url_filter.train()
    spam = {"casino-win", "free-bets", "cheap-pills", "spam-farm", "adult-x", "ads-track"}
    p = dict(zip(sites, url_filter.probability([(f"www.{s}.example.org", "/xx/1") for s in sites], model)))
    assert {s for s, x in p.items() if x >= 0.5} == spam & sites


def test_url_rules_and_parts(spark):
    df = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS)], "page_id long, url string, host string, p string")
    rows = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert len(rows) == len(URLS)
    for k, u in enumerate(URLS):
        host, path = url_filter.split_url(u)
        rule = expected_rule(host, path)
        assert (rows[k].host, rows[k].path, rows[k].rule) == (host, path, rule and rule[1] + rule[2])
        if rule:  # as asked, and not scored
            assert rows[k].verdict == rule[0] and rows[k].score is None
    assert rows[14].verdict == "block" and rows[15].verdict == "allow" and rows[0].verdict == "allow"
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_url_model_on_held_out_sites():
    model = url_filter.train(tuple(r for k, r in enumerate(url_filter.SEED) if (k // 5) % 5))
    held = [r for k, r in enumerate(url_filter.SEED) if (k // 5) % 5 == 0]
    p, y = np.array(url_filter.probability([url_filter.split_url(u) for u, _ in held], model)), np.array([y for _, y in held])
    assert np.mean((p >= 0.5) == y) > 0.8 and np.mean(p[y == 0] >= 0.5) < 0.03 and np.mean(p[y == 1] >= 0.5) > 0.15


def test_archives_round_trip(spark, tmp_path):
    big, long_ = "<p>" + "é" * 600 + "</p>", "z" * 300_000
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (9, None, big), (None, "http://n", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", long_), (10, "u", long_), (11, "u", "r" * 1000), (11, "u", "r" * 1000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.deduplicated_archives(df, folder=f"file://{tmp_path}/w").collect()
    assert len(got) == len(rows)
    kinds = sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.record_type, r.refers_to) for r in got)
    expected = [(-1, 1207, "revisit", 9), (1, 1207, "revisit", 9), (2, 1207, "revisit", 9), (4, 5, "response", None), (5, 5, "response", None), (6, 0, "response", None), (7, 0, "response", None), (8, 300000, "revisit", 10), (9, 1207, "response", None), (10, 300000, "response", None)]
    assert [k for k in kinds if k[0] != 11] == expected
    assert sorted(k[2] for k in kinds if k[0] == 11) == ["response", "revisit"]
    assert {r.payload_digest for r in got} == {hashlib.sha1((h or "").encode()).hexdigest() for _, _, h in rows}
    files = list((tmp_path / "w/deduplicated").glob("*.warc.gz"))
    heads = [h for f in files for h, _ in warc.read_records(open(f, "rb"))]
    ids = {h["warc-record-id"] for h in heads}
    assert len(ids) == len(rows) and all(h["warc-refers-to"] in ids for h in heads if h["warc-type"] == "revisit")
    assert all(f.name.endswith((".warc.gz", ".crc")) for f in (tmp_path / "w").glob("*/*"))
    assert warc.deduplicated_archives(df.limit(0)).count() == 0
    named = warc.deduplicated_archives(df.where("page_id IS NOT NULL").withColumn("page_id", F.concat(F.lit("p-"), F.col("page_id")))).collect()
    assert len(named) == len(rows) - 1 and {(r.page_id, r.refers_to) for r in named if r.record_type == "revisit"} >= {("p-1", "p-9"), ("p-2", "p-9")}


def test_archives_sweep(tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"x")
    half = warc.Archive(f"file://{tmp_path}/b.warc.gz")
    half.write(b"y")
    warc.sweep(f"file://{tmp_path}")
    assert [f.name for f in tmp_path.iterdir()] == ["a.warc.gz"]
    gone = warc.Archive(f"file://{tmp_path}/c.warc.gz")
    gone.abandon()
    warc.sweep(f"file://{tmp_path}/none")
    assert [f.name for f in tmp_path.iterdir()] == ["a.warc.gz"]
