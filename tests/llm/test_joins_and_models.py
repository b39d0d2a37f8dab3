"""Jaccard join, decontamination, mixing, sharding, classifiers and the pipeline: against brute force, SQL and invariants."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import decontamination, jaccard, mixing, quality, sharding, toxicity, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, shard string, cid string, y string"


def docs(spark, rows):
    """rows: (doc_id, text[, source]); further columns clash with names used inside."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *["clash"] * 5) for r in rows], SCHEMA)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute_join(rows):
    sets = [shingles(t) for _, t in rows]
    link = [[i != j and bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and bool(sets[i] & sets[j]) for j in range(len(rows))] for i in range(len(rows))]
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(link[todo.pop()]).tolist():
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((key, len(sets[i]), sum(link[i]), min(ids) if sets[i] and ids else key))
    return out


def near_copies():
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(60)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    texts = [None, "", " \n\t", "one", "ONE", "one two", "a b c d", "a B c d", passage, passage]
    for n in (5, 8, 12, 20, 60, 150):
        for _ in range(4):
            base = [rng.choice(vocabulary) for _ in range(n)]
            texts.append(" ".join(base))
            for _ in range(3):
                copy = list(base)
                for _ in range(rng.randrange(1, 3)):
                    copy[rng.choice([0, -1, rng.randrange(len(copy))])] = "changed"
                texts.append(" ".join(copy[rng.randrange(2) :]))
            texts.append(passage + " " + " ".join(base[: n // 3]))
    texts += ["long " + " ".join(vocabulary * 200)] * 2
    return [(k if k != 3 else None, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("x", [None, 0, 10_000])
def test_jaccard_join_is_brute_force(spark, monkeypatch, x):
    """With the boundary chosen by cost, with inverted lists alone and, small as these are, with subsets for nearly all."""
    rows = near_copies()
    if x is not None:
        limit = 0 if x == 0 else 60
        monkeypatch.setattr(jaccard, "boundary", lambda *a: limit)
    got = sorted(map(repr, ((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in jaccard.jaccard_join(docs(spark, rows)).collect())))
    assert got == sorted(map(repr, brute_join(rows)))


def test_frequent_shingles_come_last_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COUNTED", 1)
    monkeypatch.setattr(jaccard, "OFTEN", 3)
    rows = near_copies()
    got = sorted(map(repr, ((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in jaccard.jaccard_join(docs(spark, rows)).collect())))
    assert got == sorted(map(repr, brute_join(rows)))


def crowds():
    """Groups of near copies of several sizes, that drift apart and share a passage."""
    rng = random.Random(66)
    word = lambda: f"w{rng.randrange(10_000)}"
    passage, texts = [word() for _ in range(25)], []
    for n, copies in ((8, 30), (40, 60), (41, 20), (90, 25)):
        base = passage[: n // 3] + [word() for _ in range(n)]
        for k in range(copies):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.choice([-1, rng.randrange(len(copy))])] = word()
            if k % 3 == 0:
                base = copy
            texts.append(" ".join(copy + ([word()] * (k % 2))))
    return [(k, t) for k, t in enumerate([*texts, *texts[:5], None, ""])]


@pytest.mark.parametrize("chunk, hot", [(1024, False), (4, False), (4, True), (1024, True)])
def test_crowded_signatures_lose_no_link(spark, monkeypatch, chunk, hot):
    """Tiles of one chunk and of many, with signatures that don't move and without."""
    for name, value in {"CROWDED": 3, "CHUNK": chunk, "ELEMENTS": 400 if chunk == 4 else 1 << 19, **({"HOT_ROWS": 20, "HOT_PART": 400, "PROBED": 1} if hot else {})}.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = crowds()
    got = sorted(map(repr, ((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in jaccard.jaccard_join(docs(spark, rows)).collect())))
    assert got == sorted(map(repr, brute_join(rows)))


def test_only_crowded_classes_move_to_tiles(spark):
    """Of 3000 classes, of which 40 have a home, the lists of these move, and of a bit map's few false hits."""
    rng = np.random.default_rng(8)
    cids = rng.integers(-(1 << 63), 1 << 63, 3000)
    early = {int(c): rng.integers(0, 1 << 63, 12, np.uint64) for c in cids}
    classes = spark.createDataFrame([(c, 50, 50, bytearray(s.tobytes())) for c, s in early.items()], "cid long, n long, light long, early binary")
    homes = spark.createDataFrame([(int(c),) for c in cids[:40]], "cid long")
    got = {r.cid: bytes(r.early) for r in jaccard._lists(classes, homes, 80).collect()}
    assert {int(c) for c in cids[:40]} <= set(got) and len(got) < 60
    assert all(raw == np.unique(early[c][:11].astype(np.uint32)).tobytes() for c, raw in got.items())
    assert jaccard._lists(classes, homes.limit(0), 80).count() == 0


@pytest.mark.parametrize("shared, hope", [(6, True), (5, False)])
def test_halves_of_shingles_that_are_alike_lose_no_pair(spark, shared, hope):
    """Sets of 50 need 6 of the 11 that are looked up; two of them are alike in their low half, so that 5 halves are."""
    rng = np.random.default_rng(9)
    both, a, b = (np.sort(rng.integers(0, 1 << 63, k, np.uint64)) for k in (12, 11, 11))
    both[1] = both[0] + np.uint64(1 << 40)
    rows = [(k + 1, 50, 0, bytearray(np.concatenate([both[:shared], own])[:12].tobytes())) for k, own in enumerate((a, b))]
    classes = spark.createDataFrame(rows, "cid long, n long, light long, early binary")
    homes = spark.createDataFrame([(1, 7, 1, []), (2, 7, 1, [])], "cid long, home long, k int, near array<struct<home:long,k:int>>")
    assert sorted(r.cid for r in jaccard._hopeful(homes, classes, 80).collect()) == ([1, 2] if hope else [])


def test_shuffle_files_go_with_the_step_that_wrote_them(spark):
    def held():
        return set(re.findall(r"shuffle_\d+", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")))

    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    setting, before = spark.conf.get(jaccard.CLEANUP, None), held()
    kept = jaccard.materialize(rows, "shuffled")
    assert not held() - before and spark.conf.get(jaccard.CLEANUP, None) == setting
    assert kept.count() == 7 and rows.count() == 7
    spark.conf.set(jaccard.CLEANUP, "false")
    jaccard.materialize(rows, "shuffled")
    assert spark.conf.get(jaccard.CLEANUP) == "false"
    spark.conf.unset(jaccard.CLEANUP)


def test_tiles_are_brute_force():
    rng = np.random.default_rng(4)
    for g, spread in ((2, 10), (40, 30), (40, 3000), (150, 400)):
        base = rng.integers(0, 1 << 60, 60, np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(60) < 0.9], rng.integers(0, spread, rng.integers(1, 8)).astype(np.uint64)])) for _ in range(g)]
        expected = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
        assert (jaccard.overlaps(sets) == expected).all()
        n, copies = np.array([len(s) for s in sets]), rng.integers(1, 5, g)
        for side in (np.zeros(g, int), np.arange(g) % 2):
            link = 100 * expected >= 80 * (n[:, None] + n[None, :] - expected)
            np.fill_diagonal(link, False)
            if side.any():
                link &= side[:, None] != side[None, :]
            linked, label = jaccard.tile_links(sets, side, copies, 80)
            assert (linked == link @ copies).all() and all((label[np.flatnonzero(row)] == label[k]).all() for k, row in enumerate(link))
            assert all(label[k] <= k and label[label[k]] == label[k] for k in range(g))


def test_boundary_has_the_least_cost():
    sizes = [(n, 1000 // n) for n in range(1, 200)]
    for others in (0.0, 3.0, 50.0):
        x = jaccard.boundary(sizes, 80, others)

        def cost(b):
            total = 0.0
            for n, k in sizes:
                p = n - jaccard.least_overlap(n, 80) + 1
                total += k * ((p + 1) * p / 2 if n <= b else p * (1 + jaccard.ENTRY_COST * others * 0.2))
            return total

        assert cost(x) == pytest.approx(min(cost(b) for b in range(200)))
    assert jaccard.boundary(sizes, 80, 50.0) > jaccard.boundary(sizes, 80, 0.0)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(1, 41), 1) | dict.fromkeys(range(100, 140), 100)
    assert jaccard.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(spark):
    rows = near_copies()
    kept = jaccard.one_of_each(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({c for k, n, _, c in brute_join(rows) if c is not None and (n or k == c)})
    assert jaccard.one_of_each(docs(spark, rows).limit(0)).count() == 0


def test_one_of_each_goes_by_text_where_ids_repeat_or_lack(spark):
    rng = random.Random(16)
    base = [[f"w{k}x{rng.randrange(1000)}" for _ in range(40)] for k in range(9)]
    near = lambda k: " ".join([*base[k][:-1], "changed"])
    a, b, c, d, *lone = map(" ".join, base)
    # two unlike texts with one id, each with a near copy under a higher one; unlike texts without id; exact and near copies of these
    rows = [(1, a), (1, b), (1, b), (2, near(0)), (3, near(1)), (None, c), (None, near(2)), (None, c.upper()), (None, d), (4, near(3)), *[(None, t) for t in lone], (None, lone[0]), (None, ""), (None, " "), (1, "")]
    kept = [(r.doc_id, r.text) for r in jaccard.one_of_each(docs(spark, rows)).collect()]
    like_c = [k for k in kept if k[1] in (c, near(2), c.upper())]
    assert len(like_c) == 1 and like_c[0][0] is None
    expected = [(1, a), (1, b), (4, near(3)), *[(None, t) for t in lone], (None, ""), (None, " "), (1, "")]
    assert sorted(map(repr, (k for k in kept if k not in like_c))) == sorted(map(repr, expected))


ITEMS = [
    (1, "Today Anna Smith drives 60 km in 2 hours from the old harbour to the quiet village. How fast does Anna go on average?"),
    (2, "the reaction of hydrogen with oxygen gives water and releases a great amount of energy that warms the vessel"),
    (3, "tiny item"),
    (4, "one short question of six words"),
    (5, None),
    (5, ""),
]


def found(text):
    m = decontamination.Matcher(ITEMS)
    return [(m.ids[x.item], x.exact) for x in m.find(text)]


def test_templates():
    before, after = "Some words of a page come first here. ", " And some words come behind it."
    exact = before + ITEMS[0][1] + after
    changed = before + "Today Boris Jones drives 75 miles in 3 hours from the old harbour to the quiet village. How fast does Boris go on average?" + after
    torn = changed.replace("does Boris", "does Clara")
    assert found(exact) == [(1, True)] and found(changed) == [(1, False)] and found(torn) == []
    assert found(ITEMS[1][1].upper()) == [(2, True)] and found(before + ITEMS[3][1] + ".") == [(4, True)]
    assert found("the reaction of hydrogen with oxygen gives water") == [] and found(None) == [] and found("tiny item") == [(3, True)] and found("Behind a sentence. Tiny item! And on") == [(3, True)]
    assert found("no tiny item here") == [] and found("tiny items") == []
    assert found("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16") == []


def test_white_space_is_no_word():
    """Wrapped elsewhere than the item, with CRLF, tabs and no-break spaces."""
    words = ("the reaction of hydrogen with oxygen gives water and releases a great amount of energy that warms the vessel " * 2).split()[:38]
    item = "\n".join(" ".join(words[k : k + 10]) for k in range(0, 38, 10))
    m = decontamination.Matcher([(1, item)])
    for sep in ("\n", "\r\n"):
        text = sep.join(" ".join(words[k : k + 7]) for k in range(0, 38, 7))
        assert [(x.covered, x.exact) for x in m.find("before it" + sep + text)] == [(38, True)]
    for sep in ("\t", "\u00a0", "\r", " \n\n "):
        assert [(x.covered, x.exact) for x in m.find(sep.join(words))] == [(38, True)]


def test_copies_are_found_however_names_are_read():
    items = [(1, "Who wrote Romeo and Juliet?"), (2, "What is the capital of France and which river runs through it?"), (3, "Compute 17 23 41 59"), (4, "the long letter that Anna wrote to the old teacher of Boris in the last spring")]
    m = decontamination.Matcher(items)

    def found(text):
        return [(m.ids[x.item], x.covered, x.exact) for x in m.find(text)]

    assert found("in the evening they asked each other who Who wrote Romeo and Juliet? and then went on to talk") == [(1, 5, True)]
    assert found("we then asked What is the capital of France and which river runs through it? in class") == [(2, 12, True)]
    assert found("a task: Compute 17 23 41 59") == [(3, 5, True)] and found("a task: Compute 17 23 41 60") == []
    assert found(items[3][1].lower()) == [(4, 16, True)] and found("so THE LONG " + items[3][1][9:]) == [(4, 16, True)]


def test_slots_may_meet_and_a_change_leaves_the_rest():
    fruit = "if a boy buys 3 apples and 5 pears at the market of the town how many does he have"
    prose = " ".join(f"w{k}" if k % 20 else "in 1848 and" for k in range(200))
    boat = "so a slow boat went along the wide river as night fell over the quiet town by the sea"
    m = decontamination.Matcher([(1, fruit), (2, prose), (3, boat)])

    def found(text):
        return [(m.ids[x.item], x.exact) for x in m.find("before it " + text)]

    assert found(fruit.replace("3", "4").replace("5", "4")) == [(1, False)]
    assert found(prose.replace("1848", "1849", 1)) == [(2, True)]
    # a word put in: pieces of 9 and of 10 words
    assert found(boat.replace("river as", "river just as")) == [(3, True)]


def test_sentence_names_meet_names_within():
    items = [(1, "Alice buys 5 apples and 3 pears today in Paris"), (2, "drei Hunde laufen 20 kg schwer durch den langen dunklen Park"), (3, "Yes")]
    m = decontamination.Matcher(items)
    found = lambda t: [(m.ids[x.item], x.exact) for x in m.find(t)]
    assert found("we know Alice buys 5 apples and 3 pears today in Paris and so on") == [(1, True)]
    assert found("we know Carol buys 7 apples and 4 pears today in London and so on") == [(1, False)]
    assert found("It rained. Carol buys 7 apples and 4 pears today in London.") == [(1, False)]
    assert found("we know Carol buys seven apples and 4 pears today in London and so on") == [(1, False)]
    assert found("es heißt vier Hunde laufen 30 kg schwer durch den langen dunklen Park") == [(2, False)]
    assert found("She said yes to it") == [] and found("Is it so?\nYes.\nIt is") == [(3, True)] and found("yes") == [(3, True)]


def test_words_are_pythons():
    """Of texts in one batch, with white space, quotes and capitals of many kinds, runs of signs, and letters whose lower case is longer."""
    rng = random.Random(8)
    signs = "aB éÉßẞİKЖжΣσ0٣.,;:!?…\"'()[]{}*_`-|«»„“”‘’–—¿¡\n\r\t\x0b\x1c\u00a0\u2003\u2028\u3000😀%°"
    texts = ["", " ", "...", "x", "-" * 100 + "Mid" + "!" * 90, "É. İstanbul K", "end\u00a0"] + ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(500)]
    r = decontamination.read(pa.array([None, *texts], pa.string()).slice(1))
    around = ".,;:!?…\"'()[]{}«»„“”‘’*_`-–—|¿¡"
    plain = lambda w: w.translate({ord(k): v for k, v in {**dict.fromkeys("„“”‘’", '"\0\0'), **dict.fromkeys("«»", '"\0'), **dict.fromkeys("–—", "-\0\0"), "…": ".\0\0", "¿": "(\0", "¡": "!\0"}.items()})
    lower = lambda w: "".join(c if c in words.ODD else c.lower() for c in w)
    for k, text in enumerate(texts):
        got = [r.word(j).decode() for j in range(r.first[k], r.first[k + 1])]
        cut = [w.strip(around) for w in re.split(r"[\s\x1c-\x1f]+", text)]
        expected = [lower(plain(w)) for w in cut if w]
        assert [w.replace("ς", "σ") for w in got] == [w.replace("ς", "σ") for w in expected], text


def brute_windows(text):
    """Words, and kinds in both readings, of plain texts: one word after the other."""
    words = text.split()
    kinds = []
    for k, w in enumerate(words):
        bare = w.strip(".?").lower()
        own = 1 if re.fullmatch(r"\d+", bare) else 2 if bare in ("kg", "hours") else 0
        around = words[max(0, k - 4) : k + 5]
        capital = own == 0 and w[0].isupper() and 2 * sum(x[0].isupper() for x in around) <= len(around)
        first = k == 0 or words[k - 1][-1] in ".?"
        kinds.append((3 if capital and not first else own, 3 if capital else own))
    return [w.strip(".?").lower() for w in words], kinds


def brute_match(item, text):
    """Whether an alignment of item and text counts, from the definition: readings, windows, runs, slots."""
    (b, b_kinds), (d, d_kinds) = brute_windows(item), brute_windows(text)
    width = min(8, len(b))
    signs = lambda words, kinds, reading: [w if reading == 2 or k[reading] == 0 else k[reading] for w, k in zip(words, kinds)]
    b_signs = [signs(b, b_kinds, r) for r in range(3)]
    d_signs = [signs(d, d_kinds, r) for r in range(3)]
    runs = {}
    for at in range(len(b) - width + 1):
        for place in range(len(d) - width + 1):
            if any(x[at : at + width] == y[place : place + width] for x in b_signs for y in d_signs):
                runs.setdefault(place - at, []).append(at)
    groups = [[(at, o) for at in ats] for o, ats in runs.items()]
    offsets, chain = sorted(runs), []
    for o in [*offsets, 1 << 30]:
        if chain and o - chain[-1] > 4:
            groups.append([(at, k) for k in sorted(chain, key=lambda k: -len(runs[k])) for at in runs[k]])
            chain = []
        chain.append(o)
    best = None
    for group in groups:
        copied = [(at, o) for at, o in group if b[at : at + width] == d[at + o : at + o + width]]
        same = {k for at, _ in copied for k in range(at, at + width)}
        for taken in (group, copied):
            theirs = {}
            for at, o in taken:
                for k in range(at, at + width):
                    theirs.setdefault(k, d[k + o])
            literal = sum(k in same or b_kinds[k][0] == 0 and b[k] == v for k, v in theirs.items())
            if len(theirs) < min(len(b), 13) or literal < min(6, (len(theirs) + 1) // 2):
                continue
            value, agree = {}, True
            for k, v in theirs.items():
                if b_kinds[k][1] and (b_kinds[k][0] or b[k] != v):
                    agree &= value.setdefault((b_kinds[k][1], b[k]), v) == v
            if agree:
                best = max(best or (0, False), (len(theirs), all(b[k] == v for k, v in theirs.items())))
                break
    return best


def test_templates_are_brute_force():
    rng = random.Random(33)
    vocabulary = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu") for b in ("lan", "mer", "nis", "pot")]
    names, units = ["Anna", "Boris", "Clara", "Dmitri"], ["kg", "hours"]

    def sentence(n):
        out = []
        for k in range(n):
            kind = rng.random()
            word = rng.choice(names) if kind < 0.12 else str(rng.randrange(100)) if kind < 0.24 else rng.choice(units) if kind < 0.28 else rng.choice(vocabulary)
            out.append(word.capitalize() if k == 0 else word)
        return out

    items = [(k, " ".join(sentence(rng.randrange(4, 30))) + rng.choice(["", ".", "?"])) for k in range(25)]
    texts = []
    for k in range(150):
        words = items[rng.randrange(25)][1].split()
        rename, shift = dict(zip(names, rng.sample(names, 4))), rng.randrange(1, 9)
        if k % 3:
            words = [rename.get(w, str(int(w) + shift) if w.isdigit() else w) for w in words]
        if k % 5 == 0:
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if k % 7 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(vocabulary))
        texts.append(" ".join([*sentence(rng.randrange(6)), *words, *sentence(6)]))
    m = decontamination.Matcher(items)
    found = m.find_all(pa.array(texts))
    kinds = set()
    for text, matches in zip(texts, found):
        got = {m.ids[x.item]: (x.covered, x.exact) for x in matches}
        expected = {i: b for i, t in items if (b := brute_match(t, text))}
        assert got.keys() == expected.keys() and all(got[i][0] == expected[i][0] for i in got)
        kinds |= {e for _, e in expected.values()}
    assert kinds == {True, False}
    # texts of a batch don't meet
    assert [m.find(t) for t in texts[:20]] == found[:20]


def test_contaminated_is_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("klmnop") for _ in range(5)) for _ in range(40)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 40)))) for k in range(20)]
    rows = [(None if k == 4 else k, " ".join(rng.choice(vocabulary) for _ in range(60))) for k in range(60)]
    for k in range(0, 60, 3):
        item = items[rng.randrange(20)][1].split()
        part = item[: max(5, rng.randrange(len(item) + 1))]
        rows[k] = (rows[k][0], rows[k][1] + " " + " ".join(part) + " tail")
    rows += [(100, None), (101, ""), (102, " ".join(vocabulary * 60)), (7, rows[3][1])]

    def brute(text, item):
        d, b = (text or "").split(), item.split()
        w, best = min(8, len(b)), 0
        for offset in range(-len(b), len(d)):
            cover = set()
            for at in range(len(b) - w + 1):
                if offset + at >= 0 and d[offset + at : offset + at + w] == b[at : at + w]:
                    cover |= set(range(at, at + w))
            best = max(best, len(cover))
        return best if best >= min(len(b), 13) else 0

    df, bench = docs(spark, rows), spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, doc_id string")
    got = {}
    for r in decontamination.contaminated(df, bench).collect():
        got[r.doc_id, r.item_id] = r.covered
    expected = {}
    for k, t in rows:
        for i, b in items:
            if t is not None and (c := brute(t, b)):
                expected[k, i] = max(c, expected.get((k, i), 0))
    assert expected and got == expected
    clean = decontamination.without_benchmark(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} & {k for k, _ in expected} <= {7}
    assert decontamination.contaminated(df.limit(0), bench).count() == 0 and decontamination.without_benchmark(df, bench.limit(0)).count() == len(rows)


def test_benchmark_in_blocks_finds_the_same(spark, monkeypatch):
    df = docs(spark, [(1, "x " + ITEMS[0][1]), (2, ITEMS[1][1])])
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = sorted(decontamination.contaminated(df, bench).collect())
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 60)
    assert sorted(decontamination.contaminated(df, bench).collect()) == whole and len(whole) == 2


def mixture_rows():
    rng = random.Random(9)
    rows = [(k, " ".join(["w"] * int(rng.paretovariate(0.8) + 1)), rng.choice(["a", "b", "b", "b", "é", "z"])) for k in range(300)]
    rows += [(None, f"no id {'w ' * k}", "b") for k in range(9)] + [(None, "no id w", "b")]
    return rows + [(300, None, "a"), (301, "", None), (302, "two words", None), (302, "two words", None), (303, " \t ", "empty"), (304, "x", "Z")]


@pytest.mark.parametrize("small", [100_000, 0])
def test_mix_is_its_sql(spark, tmp_path, monkeypatch, small):
    """With tables of sources that are broadcast, and with salted joins."""
    monkeypatch.setattr(mixing, "SMALL", small)
    df = docs(spark, mixture_rows())
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    expected = con.sql(mixing.ORACLE).fetchall()
    got = [(r.doc_id, r.size, r.source_size, r.target, r.size * r.copies, r.copies) for r in mixing.mix(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    totals, goal, largest = {}, {}, {}
    for r in mixing.mix(df).collect():
        totals[r.source] = totals.get(r.source, 0) + r.size * r.copies
        goal[r.source], largest[r.source] = r.target, max(r.size, largest.get(r.source, 0))
        assert 0 <= r.copies <= 3
    assert all(abs(totals[s] - goal[s]) <= largest[s] / 2 + 1e-6 for s in goal)
    assert abs(sum(goal.values()) - sum(len(re.findall(r"\S+", t or "")) for _, t, _ in mixture_rows())) < 1e-6


def test_mix_takes_what_ends_just_at_the_need(spark, tmp_path):
    """Sources of one size: the words needed end where a document does. Two of them have empty documents besides."""
    rows = [(10 * k + j, "five words are in here", s) for k, s in enumerate("abc") for j in range(2)] + [(100 + k, "", "ab"[k % 2]) for k in range(12)]
    docs(spark, rows).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    expected = con.sql(mixing.ORACLE).fetchall()
    got = mixing.mix(docs(spark, rows)).collect()
    assert sorted(map(repr, ((r.doc_id, r.size, r.source_size, r.target, r.size * r.copies, r.copies) for r in got))) == sorted(map(repr, expected))
    assert {s: sum(r.size * r.copies for r in got if r.source == s) for s in "abc"} == {"a": 5, "b": 10, "c": 15}


def test_mixed_rows(spark):
    df = docs(spark, mixture_rows())
    n = {}
    for r in mixing.mix(df).collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + r.copies
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in n.items() if v}
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_rows(df.limit(0)).count() == 0
    clash = df.withColumnsRenamed({"lang": "_key", "n_chars": "_n", "id": "_Rows", "cid": "_times"})
    assert mixing.mixed_rows(clash).columns == clash.columns and mixing.mixed_rows(clash).count() == out.count()


def shard_rows(hot):
    rng = random.Random(10)
    rows = [(k if k else None, None if k == 5 else "same text for many rows" if hot and k % 3 == 0 else "t" * rng.randrange(200)) for k in range(2000)]
    return rows + [(1, "same row")] * 3


@pytest.mark.parametrize("hot", [False, True])
def test_shards(spark, hot):
    rows = shard_rows(hot)
    for bytes_ in (128 << 20, 200):
        got = sharding.histogram_shards(docs(spark, rows), 8, range_bytes=bytes_).collect()
        by = {}
        for r in got:
            by.setdefault(r.shard, []).append(r)
        assert len(got) == len(rows) and sorted(by) == list(range(8))
        sizes = [sum(r["size"] for r in rs) for rs in by.values()]
        mean = sum(sizes) / 8
        assert max(abs(s - mean) for s in sizes) <= 0.01 * mean + 220
        assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    assert all(r["size"] == len(r.text or "") + 16 for r in got)
    assert sharding.histogram_shards(docs(spark, rows).limit(0), 8).count() == 0 and sharding.histogram_shards(docs(spark, rows[:1]), 8).count() == 1
    clash = docs(spark, rows).withColumnsRenamed({"lang": "_h1", "source": "_piece", "id": "_SIZE", "cid": "_before"})
    put = sharding.histogram_shards(clash, 8)
    assert put.columns == [*[c for c in clash.columns if c not in ("size", "shard")], "size", "shard", "slot"] and put.count() == len(rows)


@pytest.mark.parametrize("hot", [False, True])
def test_shards_are_brute_force(spark, hot):
    """Splitters, shards and slots from one sorted list of the keys."""
    rows, shards, tolerance = shard_rows(hot), 8, 0.01
    df = docs(spark, rows)
    h1, h2 = sharding._keys(F.col("text"), F.col("doc_id"))
    keyed = [(r.a + (1 << 63), r.b + (1 << 63), len(r.text or "") + 16) for r in df.select(h1.alias("a"), h2.alias("b"), "text").collect()]
    keyed.sort()
    total = sum(s for *_, s in keyed)
    for bits in (3, 12):
        keys = df.select(h1.alias("h1"), h2.alias("h2"), (F.coalesce(F.length("text"), F.lit(0)) + 16).alias("size"))
        cuts, counted, _ = sharding.splitters(keys, shards, tolerance, bits)
        assert counted == total and cuts == sorted(cuts)
        for k, cut in enumerate(cuts, 1):
            under = sum(s for a, b, s in keyed if (a, b) < cut)
            goal = total * k / shards
            # no cut between two keys is nearer, unless this one is near enough
            sums, best = {}, goal
            for a, b, s in keyed:
                sums[a, b] = sums.get((a, b), 0) + s
            run = 0
            for s in sums.values():
                run += s
                best = min(best, abs(run - goal))
            assert abs(under - goal) <= max(tolerance * total / shards, best)
    got = {}
    for r in sharding.histogram_shards(df, shards).select("shard", "slot", h1.alias("a"), h2.alias("b")).collect():
        got.setdefault(r.shard, {})[r.slot] = (r.a + (1 << 63), r.b + (1 << 63))
    cuts = sharding.splitters(keys, shards, tolerance)[0]
    for k in range(shards):
        mine = [(a, b) for a, b, _ in keyed if sum((a, b) >= c for c in cuts) == k]
        assert [got.get(k, {})[j] for j in range(len(mine))] == mine


def test_grammar_weakens_and_strengthens():
    reader = toxicity.Reader(toxicity.BUILT_IN)
    s = lambda t: sum(reader.clauses(t))
    assert s("you are an idiot") > s("what an idiot") > s("he said idiot") > s("not an idiot") > 0
    assert s("we will kill you") > s("they kill time") > s("we will not kill you")
    assert s("a fine day") == 0 and s(None) == 0 and s("") == 0 and s("said yes. what an idiot") == s("what an idiot")
    t = toxicity.negation().compose(toxicity.reported(), toxicity.CLASSES)
    state, out = t.start, ""
    for c in "NOIRI":
        state, label, _ = t.step(state, c)
        out += label
    assert out == "NOiRr"


def test_composed_grammar_is_its_transducers_in_turn():
    """Brute force: each of the five reads what the one before wrote; factors multiply."""
    rng, machine = random.Random(12), toxicity.grammar()
    parts = [toxicity.negation(), toxicity.reported(), toxicity.aimed(), toxicity.threatening(), toxicity.weighing()]
    for _ in range(300):
        state, states, total = machine.start, [t.start for t in parts], 1.0
        for label in (rng.choice(toxicity.CLASSES) for _ in range(rng.randrange(1, 25))):
            state, out, factor = machine.step(state, label)
            seen, product = label, 1.0
            for k, t in enumerate(parts):
                states[k], seen, f = t.step(states[k], seen)
                product *= f
            assert out == seen and factor == pytest.approx(product)


def test_batches_read_as_single_words_do():
    """Against one word after the other, looked up by Python's strings."""
    rng = random.Random(13)
    lexicon = toxicity.BUILT_IN | {"réeuxe*": ("I", 1.5), "zork*": ("H", 2.0), "größe": ("I", 0.7)}
    reader = toxicity.Reader(lexicon)
    pieces = ["idiot", "Idiot.", "kill,", "you", "not", "said:", "will", "trash###", "a\nb", "Réeuxelle", "réeux", "zorks!***", "GRÖSSE", "Größe;", "word", "—", "...", "“scum”", "no-one", "(moron)", "été"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(300)] + ["", None]

    def one_by_one(text):
        codes, scores = [], []
        for line in (text or "").split("\n"):
            for word in [*line.split(), "."]:
                code = reader[word]
                codes.append(code >> 1)
                if code & 1:
                    if any(reader.classes[c] in "IH" for c in codes):
                        scores.append(reader.score(codes))
                    codes = []
        return scores

    assert reader.clauses_of(pa.array(texts)) == [one_by_one(t) for t in texts]


def test_learned_words_behind_intentions_are_threats():
    lexicon = toxicity.BUILT_IN | {"zork": ("I", 2.0), "blim*": ("I", 2.0)}
    texts = ["we will zork them", "I will then zork it. zork", "they will surely zork", "a blimmer will go. what blims", "will go. blimmed"]
    seen = toxicity.planned(texts, lexicon, {"zork", "blim*"})
    assert seen == {"zork": (4, 3), "blim*": (3, 0)}
    classes = {m: c for m, (c, _) in toxicity.with_threats(lexicon, {"zork", "blim*"}, seen).items()}
    assert classes["zork"] == "H" and classes["blim*"] == "I" and classes["idiot"] == "I"


def test_strewn_signs_hide_no_word():
    reader = toxicity.Reader(toxicity.BUILT_IN)
    assert reader.clauses("a fine day trash### here") == reader.clauses("a fine day *trash* here") == reader.clauses("a fine day trash here") != []
    assert reader.clauses("he said so.*** trash") == reader.clauses("he said so. trash")


def test_few_false_marks():
    rng = random.Random(1)
    counts = {f"w{k}$": (n := sum(rng.random() < 0.1 for _ in range(8)), 8 - n) for k in range(5000)} | {f"t{k}$": (7, 0) for k in range(40)}
    assert toxicity.beyond_chance(counts, 0.1, len(counts)) == {f"t{k}$" for k in range(40)}
    assert toxicity.beyond_chance({}, 0.1, 0) == set()


def toxic_rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    rows, labels = [], []
    for k in range(600):
        words = [rng.choice(vocabulary) for _ in range(30)]
        toxic = k % 6 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(["zorkling", "zorkles", "idiot"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 2 == 0), int(toxic)))
    return rows, labels


def test_toxicity_learns_words_and_generalises(spark):
    rows, labels = toxic_rows()
    df = docs(spark, [*rows, (None, "zorkles"), (9000, None), (9001, "")])
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, lab)
    assert any(w.startswith("zork") for w in model.lexicon)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert len(got) == 603 and all(got[k].predicted == t for k, _, t in labels) and got[None].predicted == 1 and got[9000].score == got[9001].score < 0.5
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == 603 - 101
    assert toxicity.train(df, lab.limit(0)) is toxicity.DEFAULT and toxicity.score(df.limit(0), model).count() == 0


def test_factorisation_machine_is_all_pairs():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=quality.WIDTH).astype(np.float32), rng.normal(size=(quality.WIDTH, quality.FACTORS)).astype(np.float32))
    row = quality.features(pa.array(["some words, Some more words.\nAnd a line 12"]))[0]
    x = quality.values(row, np.array([len(row)])).astype(float)
    z = 0.3 + (m.linear[row] * x).sum()
    for i in range(len(row)):
        for j in range(i):
            z += float(m.factors[row[i]] @ m.factors[row[j]]) * x[i] * x[j]
    assert m.scores([row])[0] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4)


def test_statistics_are_brute_force():
    rng = random.Random(21)
    texts = ["".join(rng.choice(["word ", "Wörd. ", "12 ", "%", "\n", "end! ", "word ", " ", "\n\n", "É"]) for _ in range(rng.randrange(50))) for _ in range(200)] + ["", "x", "\n", "a\na\n"]

    def brute(text):
        words, lines = text.encode().split(), [x for x in text.encode().split(b"\n") if x]
        kinds = [0] * 5
        for c in text.encode():
            kinds[quality._KIND[c]] += 1
        signs, n, distinct = max(1, len(text.encode())), max(1, len(words)), set(words)
        ended = sum(w[-1:] in b".!?" for w in distinct)
        return [len(distinct) / n, sum(a == b for a, b in zip(words, words[1:])) / n, kinds[1] / signs, kinds[2] / signs, min(1, kinds[3] / signs * 2), kinds[4] / signs, min(1, signs / n / 20), min(1, len(lines) / n * 4), len(set(lines)) / max(1, len(lines)), ended / max(1, len(distinct)), min(1, np.log1p(len(words)) / 12), min(1, np.log1p(len(text)) / 16)]

    got, distinct, _ = quality.statistics(*words.cut(pa.array(texts), plain=False))
    assert np.allclose(got, [brute(t) for t in texts]) and distinct.tolist() == [len(set(t.encode().split())) for t in texts]
    rows = quality.features(pa.array([*texts, None]))
    assert all((np.diff(r) > 0).all() for r in rows) and (rows[-1] == rows[200]).all()
    assert [r.tolist() for r in quality.features(pa.array(texts).slice(50, 10))] == [r.tolist() for r in rows[50:60]]


def test_quality_learns_structure(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3))
    rows, labels = [], []
    for k in range(400):
        good = k % 3 > 0
        text = " ".join(word() for _ in range(40)) + "." if good else " ".join([word() + "%%%"] * 20 + [word().upper()] * 10)
        rows.append((k, text))
        labels.append((k, int(good), 0))
    df = docs(spark, [*rows, (None, "x"), (900, None), (901, "")])
    lab = spark.createDataFrame([*labels, (None, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(df, quality.train(df, lab)).collect()}
    assert len(got) == 403 and np.mean([got[k].predicted == q for k, q, _ in labels]) > 0.97 and got[900].score == got[901].score
    assert quality.score(df, quality.train(df, lab.limit(0))).select("score").distinct().first().score == 0.5
    assert quality.score(df.limit(0), None).count() == 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Rows without id, text or source, empty texts, repeated rows, further columns with names used inside, and no rows at all."""
    import corpus_pipeline

    rng = random.Random(14)
    word = lambda: "".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3))
    lone = [" ".join(word() for _ in range(60)) for _ in range(30)]
    rows = [(k, t, rng.choice(["a", "b", None])) for k, t in enumerate(lone)] + [(None, " ".join(word() for _ in range(60)), "a") for _ in range(10)]
    rows += [rows[0], rows[35], (100, None, "a"), (None, None, None), (101, "", "b"), (102, "x " * 30_000, "b"), (103, lone[3] + " tail", "a")]
    schema = "doc_id long, text string, source string, _key string, _n string, _row string, _h1 string, label int, cid string, `a.b` string"
    whole = spark.createDataFrame([(*r, "c", "c", "c", "c", 1, "c", "c") for r in rows], schema)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, lone[7]), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs_ in (whole, whole.limit(0)):
        before = docs_
        sizes = []
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, before, str(tmp_path))
            assert out.columns == (docs_.columns if k < 4 else [*docs_.columns, "size", "shard", "slot"]), name
            before = jaccard.materialize(out, "odd") if k < 4 else out
            sizes.append(before.count())
        if docs_ is whole:
            # three rows are copies; an item is found; mixing moves words between sources, which keep their number
            assert sizes[0] == len(rows) and sizes[1] == len(rows) - 3 and sizes[2] == sizes[1] - 1 and sizes[4] == sizes[3] > 0
        else:
            assert sizes == [0] * 5


def test_pipeline_keeps_what_its_stages_say(spark, tmp_path):
    """Every stage against a version of its own: scores text by text, all pairs, items text by text, SQL, and shards from one sorted list."""
    import math

    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage, before = dict(corpus_pipeline.STAGES), source
    kept, counts = {}, {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        before = jaccard.materialize(f(spark, before, sf_dir), "test")
        assert before.columns == source.columns
        rows = before.collect()
        kept[name] = {r.doc_id: r.text for r in rows}
        counts = {k: sum(r.doc_id == k for r in rows) for k in kept[name]}
        if name == "benchmark decontamination":
            before.write.parquet(str(tmp_path / "mixed_from"))
    clean, unique, decontaminated, mixed = kept.values()
    whole = {r.doc_id: r.text for r in source.collect()}
    model = toxicity.train(source, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    reader = toxicity.Reader(model.lexicon)
    score = lambda t: 1 / (1 + math.exp(-sum(a * b for a, b in zip([*toxicity.document_features(reader.clauses(t)), 1.0], model.weights))))
    assert set(clean) == {k for k, t in whole.items() if score(t) < 0.5} and len(clean) < len(whole)
    expected = brute_join(sorted(clean.items()))
    assert set(unique) == {c if n else k for k, n, _, c in expected}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    m = decontamination.Matcher(bench)
    assert set(decontaminated) == {k for k, t in unique.items() if not m.find(t)} and len(decontaminated) < len(unique)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/mixed_from/*.parquet'")
    copies = {r[0]: r[5] for r in con.sql(mixing.ORACLE).fetchall() if r[5]}
    assert counts == copies and all(mixed[k] == decontaminated[k] for k in mixed)
    out = stage["sharding"](spark, before, sf_dir)
    assert {*source.columns, "size", "shard", "slot"} == {*out.columns}
    placed = out.select("doc_id", "size", "shard", "slot").collect()
    assert len(placed) == sum(counts.values()) and all(r["size"] == len(mixed[r.doc_id].encode()) + 16 for r in placed)
    sizes = [sum(r["size"] for r in placed if r.shard == k) for k in range(40)]
    # equal rows stay together, so a shard may be off by those at its two ends
    most = max(counts[r.doc_id] * r["size"] for r in placed)
    assert all(abs(s - sum(sizes) / 40) <= 0.01 * sum(sizes) / 40 + 2 * most for s in sizes)
    assert all(sorted(r.slot for r in placed if r.shard == k) == list(range(sum(r.shard == k for r in placed))) for k in range(40))
    again = corpus_pipeline.run(spark, sf_dir).select("doc_id", "size", "shard", "slot").collect()
    assert sorted(again) == sorted(placed)
