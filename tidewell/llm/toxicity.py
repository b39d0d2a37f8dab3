"""Toxicity by a weighted finite-state pattern grammar.

Words are read as classes: insult (I), threat (H), target (T), negation (N), reported speech (R), intention (M), other (O).
Five small transducers over classes are composed into one: negation and reported speech weaken the insults and threats
in their reach, a target makes an insult aimed, intention makes a threat a plan, and the last weighs what it reads. The
composed machine runs over each clause with an insult or a threat, so that clauses are scored, not words: a clause's
score is the sum of its words' lexical weights times the machine's factors.

The lexicon holds some common English words; whole words and word beginnings that mark the labels are learned with it,
those that explain toxic documents and can't be chance
among all that were tried. A learned word that mostly stands behind an intention is a threat, any other an insult. A logistic
regression then maps the clause scores of a document to a probability; it is fitted on scores from lexicons that the other
folds of the labelled rows taught. Learning sees at most `sample` labelled rows (by hash of the id, none of
them held out); scoring reads every whole text.

Null or empty text: no clause, the score of a text without any. No labels at all: the built-in lexicon and fixed
coefficients. Repeated rows and equal texts score alike. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewell.llm.common import crc_mod, drop_table, materialize, slices
from tidewell.llm.words import Hashes, Table, byte_set, cut, hash_of, lowered, shrunk

INSULTS = "idiot idiots moron morons stupid scum trash loser losers clown worthless pathetic disgusting dumb imbecile degenerate vermin filth lowlife jerk".split()
THREATS = "kill hurt beat destroy smash strangle stab shoot punish crush".split()
TARGETS = "you your you're he she they them this these that those such du ihr sie dieser tu vous ce ces ils él ella ellos este esa".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't nicht kein keine nie ne pas jamais nunca jamás".split()
REPORTS = "said says say claimed claims called quoted quote wrote alleged sagte sagt schrieb dit disait écrit dijo dice escribió".split()
INTENTIONS = "will shall gonna going werde werden vais allons voy vamos i'll we'll".split()
CLASSES = "OITNRMH"
ENDS = ".,;:!?…"
#: Signs strewn around words, behind an end of a clause too.
STREWN = "*#$%&+=@~^<>|/\\_\"'()[]{}«»„“”‘’`"
AROUND = ENDS + STREWN + "-–—¿¡"
_LINE = byte_set(10, 11, 12, 13, 0x1C, 0x1D, 0x1E)
#: The same signs as bytes; those beyond ASCII have become ASCII ones, with 0 behind.
_ENDS, _STREWN = byte_set(*b".,;:!?"), byte_set(0, *b"*#$%&+=@~^<>|/\\_\"'()[]{}`")
_AROUND = _ENDS | _STREWN | byte_set(*b"-")
#: Bytes of texts that are read at once: so many that their arrays fit in a cache.
SLICE = 1 << 19
STEMS = (4, 5, 6, 7)
FAMILY = 4
#: Parts of the labelled rows: the features of each come from a lexicon that the others taught.
FOLDS = 4
_COUNTS = [f"{kind}{k}" for k in range(FOLDS) for kind in ("clean", "toxic")]


@dataclass
class Transducer:
    """Deterministic: (state, label) -> (state, label written, factor). A label without an arc is copied and the state kept."""

    arcs: dict[tuple[object, str], tuple[object, str, float]] = field(default_factory=dict)
    start: object = 0

    def step(self, state: object, label: str) -> tuple[object, str, float]:
        return self.arcs.get((state, label), (state, label, 1.0))

    def compose(self, other: Transducer, alphabet: str) -> Transducer:
        """What self writes, other reads; factors multiply. Only states that can be reached are made."""
        out = Transducer({}, (self.start, other.start))
        todo, seen = [out.start], {out.start}
        while todo:
            state = todo.pop()
            for label in alphabet:
                a, mid, x = self.step(state[0], label)
                b, end, y = other.step(state[1], mid)
                out.arcs[state, label] = ((a, b), end, x * y)
                if (a, b) not in seen:
                    seen.add((a, b))
                    todo.append((a, b))
        return out


def negation(reach: int = 3) -> Transducer:
    """I, H within reach behind N become i, h."""
    t = Transducer()
    for s in range(reach + 1):
        t.arcs[s, "N"] = (reach, "N", 1.0)
        for c in "OTRM":
            t.arcs[s, c] = (max(0, s - 1), c, 1.0)
        for c in "IH":
            t.arcs[s, c] = (max(0, s - 1), c.lower() if s else c, 1.0)
    return t


def reported() -> Transducer:
    """Behind R, whatever is said is someone else's: r, p."""
    t = Transducer({(0, "R"): (1, "R", 1.0)})
    t.arcs |= {(1, a): (1, b, 1.0) for a, b in zip("IiHh", "rrpp")}
    return t


def aimed() -> Transducer:
    """An insult behind a target is A; a target behind an insult is written as B."""
    return Transducer({(0, "T"): (1, "T", 1.0), (1, "I"): (1, "A", 1.0), (2, "I"): (2, "I", 1.0), (0, "I"): (2, "I", 1.0), (2, "T"): (1, "B", 1.0)})


def threatening() -> Transducer:
    """A threat behind an intention is a plan, P."""
    return Transducer({(0, "M"): (1, "M", 1.0), (1, "H"): (1, "P", 1.0), (1, "N"): (0, "N", 1.0)})


def weighing() -> Transducer:
    """The factor of each word; insults in a row weigh a little more."""
    factor = {"I": 1.0, "A": 1.25, "B": 0.0, "i": 0.25, "r": 0.5, "H": 0.5, "P": 1.5, "h": 0.1, "p": 0.3}
    t = Transducer()
    for s in (0, 1):
        for c in "OTNRMB":
            t.arcs[s, c] = (s if c in "TB" else 0, c, 0.0)
        for c, f in factor.items():
            if c != "B":
                t.arcs[s, c] = (1, c, f * (1.1 if s else 1.0))
    return t


def grammar() -> Transducer:
    t = negation()
    for other in (reported(), aimed(), threatening(), weighing()):
        t = t.compose(other, CLASSES)
    return t


class Reader(dict):
    """word -> (class number, weight, whether a clause ends); words are looked at once, and forgotten beyond `remember`."""

    def __init__(self, lexicon: dict[str, tuple[str, float]], remember: int = 150_000):
        super().__init__()
        self.whole = {w: v for w, v in lexicon.items() if not w.endswith("*")}
        self.stems = {w[:-1]: v for w, v in lexicon.items() if w.endswith("*")}
        self.lengths = sorted({len(w) for w in self.stems}, reverse=True)
        self.remember, self.weights, self.machine = remember, [0.0], grammar()
        self.codes: dict[tuple[str, float], int] = {("O", 0.0): 0}
        self.classes = ["O"]
        for hit in [*self.whole.values(), *self.stems.values()]:
            if hit not in self.codes:
                self.codes[hit] = len(self.classes)
                self.classes.append(hit[0])
                self.weights.append(hit[1])
        self.strong = np.array([c in "IH" for c in self.classes])
        with np.errstate(over="ignore"):
            self.table = Table(np.array([hash_of(w) for w in self.whole], np.uint64), np.array([self.codes[v] + 1 for v in self.whole.values()], np.int64))
            shortest = self.lengths[-1] if self.lengths else 0
            openings = sorted({w[:shortest] for w in self.stems})
            self.openings = Table(np.array([hash_of(w) + np.uint64(shortest) for w in openings], np.uint64), np.ones(len(openings), np.int64))
            self.beginnings = Table(np.array([hash_of(w) + np.uint64(len(w)) for w in self.stems], np.uint64), np.array([self.codes[v] + 1 for v in self.stems.values()], np.int64))

    def __missing__(self, word: str) -> int:
        if len(self) > self.remember:
            self.clear()
        bare = word.lower().strip(AROUND)
        hit = self.whole.get(bare)
        if hit is None:
            hit = next((self.stems[bare[:n]] for n in self.lengths if bare[:n] in self.stems), ("O", 0.0))
        self[word] = out = self.codes[hit] * 2 + (word.rstrip(STREWN)[-1:] in tuple(ENDS))
        return out

    def score(self, codes: list[int]) -> float:
        """Of one clause."""
        state, total = self.machine.start, 0.0
        for code in codes:
            state, _, factor = self.machine.step(state, self.classes[code])
            total += factor * self.weights[code]
        return total

    def clauses(self, text: str | None) -> list[float]:
        """Scores of the clauses that have an insult or a threat, weights included."""
        return self.clauses_of(pa.array([text or ""], pa.large_string()))[0]

    def clauses_of(self, texts: pa.Array) -> list[list[float]]:
        """The same for each text of a batch, whose words are looked up at once; only clauses with an insult or a threat are run through the machine."""
        out: list[list[float]] = [[] for _ in range(len(texts))]
        data, start, end, first = cut(texts)
        if not len(start):
            return out
        lower = lowered(data)
        a = shrunk(data, _AROUND, start, end, 1)
        b = shrunk(data, _AROUND, end - 1, a - 1, -1) + 1
        last = shrunk(data, _STREWN, end - 1, start - 1, -1)
        code = np.zeros(len(start), np.int64)
        keep = np.flatnonzero(a < b)
        a, b = a[keep], b[keep]
        hashes = Hashes(lower)
        found = self.table(hashes(a, b))
        if self.lengths:
            # beginnings are so many signs long, not bytes
            signs = np.flatnonzero((lower & 0xC0) != 0x80)
            sign = np.cumsum((lower & 0xC0) != 0x80, dtype=np.int32)[a] - 1
            signs = np.append(signs, len(lower))
            maybe = np.arange(len(a))
            # first those words that begin as any of the beginnings does, by as many signs as the shortest has
            for n, table in [(self.lengths[-1], self.openings), *((n, self.beginnings) for n in self.lengths)]:
                k = maybe[(found[maybe] == 0) & (sign[maybe] + n < len(signs))]
                stop = signs[sign[k] + n]
                k, stop = k[stop <= b[k]], stop[stop <= b[k]]
                hit = table(hashes(a[k], stop) + np.uint64(n))
                if table is self.openings:
                    maybe = k[hit > 0]
                else:
                    found[k] = hit
        code[keep] = np.maximum(0, found - 1)
        strong = np.flatnonzero(self.strong[code])
        if not len(strong):
            return out
        # a clause ends with its last word, before a new line, and with its text
        ends = ((last >= start) & _ENDS[data[np.maximum(0, last)]]).astype(bool)
        lines = np.concatenate([[0], np.cumsum(_LINE[data], dtype=np.int32)])
        ends[:-1] |= lines[start[1:]] != lines[start[:-1]]
        ends[first[1:][first[1:] > 0] - 1] = True
        clause = np.concatenate([[0], np.cumsum(ends)[:-1]])
        stops = np.flatnonzero(ends) + 1
        of = np.searchsorted(first, strong, "right") - 1
        for k, text in dict(zip(clause[strong].tolist(), of.tolist())).items():
            out[text].append(self.score(code[(stops[k - 1] if k else 0) : stops[k]].tolist()))
        return out


def document_features(scores: list[float]) -> list[float]:
    total = sum(scores)
    return [math.log1p(total), math.tanh(max(scores, default=0.0)), 1.0 if total > 0.5 else 0.0]


BUILT_IN = {w: ("I", 2.0) for w in INSULTS} | {w: ("H", 1.0) for w in THREATS} | {w: ("T", 0.0) for w in TARGETS} | {w: ("N", 0.0) for w in NEGATIONS} | {w: ("R", 0.0) for w in REPORTS} | {w: ("M", 0.0) for w in INTENTIONS}


def weight_of(toxic: int, clean: int) -> float:
    return round(min(3.0, max(0.1, math.log((toxic + 0.5) / (clean + 0.5)) / 2)), 6)


def log_chance(toxic: int, clean: int, rate: float) -> float:
    """Bounds the logarithm of the chance that so large a share is toxic of documents that are so at this rate (Chernoff)."""
    n, share = toxic + clean, toxic / max(1, toxic + clean)
    if share <= rate:
        return 0.0
    return -n * (share * math.log(share / rate) + ((1 - share) * math.log((1 - share) / (1 - rate)) if share < 1 else 0.0))


def beyond_chance(counts: dict[str, tuple[int, int]], rate: float, tried: int, part: float = 0.01) -> set[str]:
    """Marks of which no more than about this part are there by chance, of all that were tried (Benjamini and Hochberg)."""
    ordered = sorted((log_chance(*c, rate), m) for m, c in counts.items())
    last = max((k for k, (p, _) in enumerate(ordered, 1) if p <= math.log(part * k / max(1, tried))), default=0)
    return {m for _, m in ordered[:last]}


def learned_lexicon(counts: dict[str, tuple[int, int]], having: list[list[str]], tried: int, families: dict[str, int], toxic: int, clean: int) -> dict[str, tuple[str, float]]:
    """Words and beginnings (with *) that toxic documents have more often than chance allows.

    counts: mark -> toxic and clean documents with it; having: the marks of each toxic document; tried: the number of all marks, families: by their
    first letters. Greedily the mark is taken that explains most documents not yet explained, nine times its clean ones taken off (ties: the longer,
    then by code point), of those beyond chance. So words that only stand beside others, or in copies of one text, aren't learned. Then words that
    begin as a learned one does are taken if they are beyond chance among their family.
    """
    rate = max(1e-6, toxic / max(1, toxic + clean))
    sure = beyond_chance(counts, rate, tried)
    where: dict[str, set[int]] = defaultdict(set)
    for k, marks in enumerate(having):
        for m in marks:
            if m in sure:
                where[m].add(k)
    open_, out = set(range(len(having))), {}
    while where:
        mark = max(where, key=lambda m: (len(where[m]) - 9 * counts[m][1], len(m), m))
        explained, n = where.pop(mark), counts[mark][1]
        if len(explained) <= 9 * n or len(explained) < 2:
            break
        open_ -= explained
        out[mark.rstrip("$")] = ("I", weight_of(*counts[mark]))
        where = {m: left for m, ks in where.items() if (left := ks & open_)}
    for family in {m[:FAMILY] for m in out if len(m.rstrip("*")) >= FAMILY}:
        own = {m: c for m, c in counts.items() if m.startswith(family) and m.endswith("$")}
        for mark in beyond_chance(own, rate, families.get(family, len(own))):
            out.setdefault(mark.rstrip("$"), ("I", weight_of(*counts[mark])))
    return out


def planned(texts: Iterable[str], lexicon: dict[str, tuple[str, float]], learned: set[str], reach: int = 3) -> dict[str, tuple[int, int]]:
    """Of learned words and beginnings: how often they stand in the texts, and how often within reach behind an intention of their clause."""
    reader, found = Reader(lexicon), defaultdict(lambda: [0, 0])
    for text in texts:
        since = reach + 1
        for word in (text or "").replace("\n", " . ").split():
            bare = word.lower().strip(AROUND)
            mark = bare if bare in learned else next((bare[:n] + "*" for n in reader.lengths if bare[:n] + "*" in learned), None) if bare not in reader.whole else None
            if mark is not None:
                found[mark][0] += 1
                found[mark][1] += since < reach
            code = reader[word]
            since = 0 if reader.classes[code >> 1] == "M" else since + 1
            if code & 1:
                since = reach + 1
    return {m: (n, k) for m, (n, k) in found.items()}


def with_threats(lexicon: dict[str, tuple[str, float]], learned: set[str], seen: dict[str, tuple[int, int]]) -> dict[str, tuple[str, float]]:
    """Learned words that mostly stand behind an intention are threats."""
    return {m: (("H", w) if m in learned and (n := seen.get(m, (0, 0)))[1] >= 3 and 2 * n[1] > n[0] else (c, w)) for m, (c, w) in lexicon.items()}


def marks_in(text: str | None) -> set[str]:
    """Words, with $, and their beginnings, with *."""
    marks = set()
    for word in set((text or "").lower().split()):
        word = word.strip(AROUND)
        if len(word) > 2:
            marks.add(word + "$")
            marks.update(word[:n] + "*" for n in STEMS if len(word) > n)
    return marks


def _marks_of(docs: DataFrame, wanted: set[str]) -> DataFrame:
    """fold, marks of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([sorted(marks_in(t) & shared.value) for t in b.column(0).to_pylist()], pa.list_(pa.string()))], ["fold", "marks"])

    return docs.select("text", "fold").mapInArrow(run, "fold int, marks array<string>")


def _count_marks(docs: DataFrame) -> DataFrame:
    """mark, toxic, clean: in how many documents of each fold words ($) and beginnings (*) stand, as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = defaultdict(lambda: [0] * (2 * FOLDS))

        def flush() -> pa.RecordBatch:
            n = np.array(list(found.values()), np.int64).reshape(-1, 2 * FOLDS)
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *[pa.array(n[:, k]) for k in range(2 * FOLDS)]], ["mark", *_COUNTS])
            found.clear()
            return out

        for b in slices(batches, 0):
            for text, label, fold in zip(*(b.column(k).to_pylist() for k in range(3))):
                for m in marks_in(text):
                    found[m][2 * fold + (1 if label else 0)] += 1
            if len(found) > 100_000:
                yield flush()
        yield flush()

    counted = docs.select("text", "y", "fold").mapInArrow(run, ", ".join(["mark string", *(f"{c} long" for c in _COUNTS)])).groupBy("mark").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    return counted.select("mark", F.array(*_COUNTS[1::2]).alias("toxic"), F.array(*_COUNTS[::2]).alias("clean"))


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton's method with an L2 penalty (none on the intercept, the last coefficient)."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([decay] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass
class Model:
    lexicon: dict[str, tuple[str, float]]
    weights: tuple[float, ...]


DEFAULT = Model(BUILT_IN, (1.0, 2.0, 2.0, -3.0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, sample: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text and y of at most about `sample` labelled rows outside the held-out part, chosen by hash of the id."""
    usable = labels.where(~held_out & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("y"))
    n = usable.count()
    if n > sample:
        usable = usable.where(F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    # at most about `sample` rows of two numbers: bounded by a parameter
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return materialize(own.join(F.broadcast(usable), "_id").select("text", F.col("y").cast("int").alias("y")), "labelled")


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", held_out: Column | None = None) -> Model:
    """held_out: of labels' rows, those not to learn from; by default crc32(id) mod 5 = 0."""
    held_out = crc_mod(F.col(id_col), 5) == 0 if held_out is None else held_out
    rows = labelled_sample(docs, labels, label, held_out, sample, id_col, text_col).withColumn("fold", F.pmod(F.xxhash64("text", F.lit(2)), F.lit(FOLDS)).cast("int"))
    n = np.zeros((2, FOLDS), np.int64)
    for r in rows.groupBy("y", "fold").count().collect():
        n[int(r.y > 0), r.fold] = r["count"]
    if not n[1].sum() or not n[0].sum():
        return DEFAULT
    marks = materialize(_count_marks(rows), "marks")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    folds = range(FOLDS) if ((n.sum(1, keepdims=True) - n) > 0).all() else []
    common = total("toxic") + total("clean") >= 3
    tried = marks.where(common).count()
    own = {r.mark[:-1]: (r.toxic, r.clean) for r in marks.where(F.col("mark").isin([w + "$" for w in INSULTS])).collect()}
    kept = marks.where((total("toxic") >= 3) & (total("toxic") > 9 * (total("clean") - F.array_max("clean"))))
    counts = {r.mark: (np.array(r.toxic), np.array(r.clean)) for r in kept.collect()}
    beginnings = sorted({m[:FAMILY] for m in counts})
    words = marks.where(common & F.col("mark").endswith("$")).groupBy(F.substring("mark", 1, FAMILY).alias("f")).count()
    families = {r.f: r["count"] for r in words.where(F.col("f").isin(beginnings)).collect()} if beginnings else {}
    drop_table(marks)
    rate = n[1].sum() / n.sum()
    few = lambda k, c: int(c.sum() - (c[k] if k is not None else 0))
    worth = {k: {m: (few(k, t), few(k, c)) for m, (t, c) in counts.items()} for k in (None, *folds)}
    worth = {k: {m: c for m, c in of.items() if c[0] >= 3 and c[0] > 9 * c[1]} for k, of in worth.items()}
    sure = set().union(*(beyond_chance(of, rate, tried) for of in worth.values()))
    toxic_rows = rows.where("y > 0")
    having = [(r.fold, r.marks) for r in _marks_of(toxic_rows, sure).collect()]
    lexicons = {}
    for k in (None, *folds):
        of = worth[k]
        learned = learned_lexicon(of, [[m for m in ms if m in of] for f, ms in having if f != k], tried, families, few(k, n[1]), few(k, n[0]))
        known = {w: ("I", weight_of(few(k, np.array(t)), few(k, np.array(c)))) for w, (t, c) in own.items() if few(k, np.array(t)) + few(k, np.array(c)) >= 3}
        lexicons[k] = (BUILT_IN | learned | known, set(learned) - set(BUILT_IN))
    # which of the learned words are threats is read off the toxic texts
    lexicons = _threats(toxic_rows, lexicons)
    if not folds:
        return Model(lexicons[None], DEFAULT.weights)
    found = None
    for k in folds:
        part = _features(rows.where(F.col("fold") == k).select(F.col("y").alias("id"), "text"), lexicons[k], "int")
        found = part if found is None else found.unionByName(part)
    got = found.groupBy("id", "f").count().collect()
    x = np.repeat(np.array([r.f for r in got]), [r["count"] for r in got], axis=0)
    y = np.repeat(np.array([r.id > 0 for r in got], float), [r["count"] for r in got])
    return Model(lexicons[None], tuple(float(w) for w in fit_logistic(x, y)))


def _threats(rows: DataFrame, lexicons: dict) -> dict:
    """The lexicons, with the learned words that are threats as such. rows: toxic ones, with their fold."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            out = []
            texts, of = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k, (lexicon, learned) in shared.value.items():
                out += [(-1 if k is None else k, m, n, p) for m, (n, p) in planned([t for t, f in zip(texts, of) if f != k], lexicon, learned).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["k", "mark", "n", "p"])

    got = rows.select("text", "fold").mapInArrow(run, "k int, mark string, n long, p long").groupBy("k", "mark").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).collect()
    seen: dict = defaultdict(dict)
    for r in got:
        seen[None if r.k < 0 else r.k][r.mark] = (r.n, r.p)
    return {k: with_threats(lexicon, learned, seen[k]) for k, (lexicon, learned) in lexicons.items()}


def _features(docs: DataFrame, lexicon: dict[str, tuple[str, float]], kind: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for b in slices(batches, 1, SLICE):
            f = [document_features(c) for c in reader.clauses_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.list_(pa.float64()))], ["id", "f"])

    return docs.mapInArrow(run, f"id {kind}, f array<double>")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, score, predicted of every row; one narrow pass, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    found = _features(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), model.lexicon, kind)
    z = F.lit(model.weights[-1])
    for k, w in enumerate(model.weights[:-1]):
        z = z + F.col("f")[k] * w
    return found.select(F.col("id").alias(id_col), (1 / (1 + F.exp(-z))).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs' rows that are not rejected, in docs' columns; no shuffle: texts are judged where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader, w = Reader(shared.value.lexicon), shared.value.weights
        for batch in texts:
            f = []
            for b in slices([pa.RecordBatch.from_arrays([batch], ["text"])], 0, SLICE):
                f += [document_features(c) for c in reader.clauses_of(b.column(0))]
            yield pa.array([1 / (1 + math.exp(-(sum(a * b for a, b in zip(v, w)) + w[-1]))) for v in f], pa.float64())

    return docs.where(F.arrow_udf(judge, "double")(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) < threshold)
