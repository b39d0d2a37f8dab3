"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained here from a small labelled table of URLs (`SEED`, or one of the caller's), by full-batch gradient
descent from zero: reruns agree. N-grams of 3 to 5 signs of "^host$" and "^path$" are hashed, host and path apart, into
2**18 weights, so many that n-grams unlike any of the table rarely meet its own; digits count as one sign, so that numbers in paths can't be learned by heart.

Null URLs, URLs without "://" and empty hosts: host and path are empty, and the model, trained to, lets them pass. Very long
URLs are processed whole. Equal URLs get equal verdicts. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewell.llm.common import mix64

BITS = 18
DIGITS = re.compile("[0-9]")
SIZES = (3, 4, 5)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: The labelled table, made up from the vocabulary of the web at large: names of sites that sell, lure, track or spread spam, and of sites of institutions, trades and hobbies.
_BAD = """royal-casino/slots/free-spins bestcasino/bonus onlinecasinos/roulette pokerstars-club/play jackpot-slots/spin
lucky-casino/promo grand-casino/blackjack mega-jackpots/prize slots-palace/deposit roulette-king/wheel winner-casino/cash vegas-poker/tables
betting-odds/today sportsbets/odds live-betting/football bets-online/stake freebet/signup bookmaker-bet/bonus win-more/lottery bigwin/scratch lotto-win-now/claim bet-and-win/join
buy-viagra/order discount-pharmacy/cialis canadian-meds/rx pillsdirect/buy diet-pills/weightloss generic-pills/cheap cheapmeds/tablets cheap-replica-watches/rolex cheapest-handbags/outlet miracle-cure/trial slimming-pill/offer steroid-shop/buy
xxx-videos/hot porntube/watch adultcams/live adult-dating/join sexchat/girls nude-webcams/free adultmovies/stream hot-singles/meet escort-girls/night x-rated/gallery adult-toys-xx/shop sexy-x/clips
adserver/banner adclick/redirect popunder/pop clicktracker/pixel trackingpixel/px ads-network/serve bannerads/imp ad-tracking/beacon trackers/collect affiliate-ads/offer doubleads/slot adtrack/hit
spam-blog/post linkfarm/backlinks seo-spam/keywords buy-backlinks/links comment-spam/bot contentfarm/spun spammers/list email-spam/blast splog-farm/auto link-farms/directory
payday-loans/apply fast-cash/money easymoney/earn get-rich/quick crypto-doubler/profit bitcoin-profit/invest free-money/grab instant-loan/approved
free-gift-cards/claim freeiphone/winner free-ringtones/get freestuff/samples free-spins-bonus/now prize-winner/congratulations
warez/crack keygens/serial torrent-movies/download malware-update/setup.exe phishing-login/verify cracked-software/keygen fake-antivirus/scan clickbait/shocking""".split()
_GOOD = """news-tribune/world/story morningpost/politics/report travel-notes/lakes documentation/reference/guide encyclopedia/article/history county-library/catalog/books
university/research/paper maritime-museum/exhibits/ancient weather-station/forecast recipes/soup/vegetable gardening/tips/roses citycouncil/minutes physics-letters/lecture atlas/region/north
grammar-school/courses/algebra healthline/advice/sleep photography/gallery/birds musicreview/album theatre/programme football-league/results cycling/routes/hills magazine/essays/culture
archive/letters/collection discussion/thread/question dictionary/entry software-manual/install railway/timetable bakery/opening-hours hiking/trails/lake painting/lessons astronomy/planets
elementary/calendar orchestra/concert nursery/plants heritage/castle translators/glossary mathematics/theorem chemistry/elements brewery/tour botanical/gardens librarian/reading
cathedral/organ fishermen/harbour engineering/bridges hospital/visitors firebrigade/station parliament/debates observatory/stars ceramics/workshop woodwork/benches knitting/patterns
allotment-farm/harvest farmhouse/cheese farmers-market/saturday organicfarm/eggs track-and-field/athletes racetrack-history/circuit soundtrack-reviews/film windmill/flour free-church/service freedom/essay freelance-writers/contact adventure/journal
adult-education/evening adulteducation/courses address-book/contacts roads-ministry/maps readers/letters loads-and-beams/physics headstone/genealogy winter-sports/snow windsurf/club twins/family alphabet/primer better-homes/ideas bettys-tearoom/menu diabetes/information
zeitung/nachrichten bibliothek/katalog wetterdienst/vorhersage rathaus/sitzung rezepte/kuchen volkshochschule/kurse wanderwege/karte
journal-local/actualites mairie/conseil recettes/tarte bibliotheque/livres musee/exposition meteo/previsions ecole/rentree
periodico/noticias ayuntamiento/plenos recetas/arroz biblioteca/libros universidad/facultad escuela/horario museo/coleccion
thornton/parish harrington/village stanhope/estate hathersage/walks eastleigh/station northampton/town reading-room/notes anderson/family esterhazy/quartet
oneill/plays inverness/ferry strathmore/glen tennant/letters hendon/school ashton/canal bletchley/park renton/joinery arlington/houses""".split()
#: Plain words as sites, since most sites are named by such: what stands in any language's names speaks for nothing.
_PLAIN = """weather leather father mother brother feather together another gather heather northern southern western eastern anthem theory theatre thesis thermal athlete method pathway earth hearth strength length month health wealth tenth
nation station motion action section portion mention caption fiction tradition education relation creation edition election position question reason season lesson person garden golden wooden kitchen children listen
morning evening building painting reading writing spring string ring singing thinking inning training opening listing printing sewing rowing fishing farming running swimming winning
stone bone throne phone zone alone honest one bonnet sonnet marble table cable noble trouble double humble gable ensemble stable able bubble
error mirror terror horror tutor author editor doctor sailor tailor harbor minor motor honor senator
order border ladder powder under thunder winter summer paper letter water river silver copper corner dinner number hunter printer carter potter weaver baker
fresh wish dish fish english spanish polish finish shore ship sheep shelf short shirt shadow share
hand land sand island band stand grand thousand husband england poland holland friend weekend legend thunderstorm
first thirst forest harvest guest chest west north south rest best interest artist tourist list coast
street meadow valley mountain bridge castle market village church tower square lane lake ocean beach cliff desert prairie orchard vineyard
history science music poetry drama letters grammar logic algebra geometry biology botany zoology anatomy medicine surgery law justice senate council embassy
haus garten strasse wasser sonne berg wald stadt kirche schule zeit arbeit freund leben welt reise buch lehrer
maison jardin chemin rivage soleil foret ville eglise monde voyage livre travail ami temps lettre
casa jardin camino agua sol monte bosque ciudad iglesia mundo viaje libro trabajo amigo tiempo carta""".split()
#: A site stands as it is and at usual places, so that subdomains, endings and neutral paths carry no label; the URL without a host is let pass.
_PLACES = ("http://{}.test{}", "https://www.{}.invalid/about", "http://shop.{}.test/item?id=3", "https://news.{}.localhost/2019/05/contents", "http://{}/index.php")
SEED: tuple[tuple[str, int], ...] = tuple((place.format(site, "/" + path), label) for label, urls in ((1, _BAD), (0, _GOOD), (0, _PLAIN)) for site, _, path in (u.partition("/") for u in urls) for place in _PLACES) + (("", 0),) * 5


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.locate("://", url) > 0, F.regexp_replace(url, "^(?s).*?://", "")).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.regexp_replace(url, "^(?s).*?://", "")).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*([^?#]*)", 1)


def grams(text: str, side: int) -> np.ndarray:
    """Hashed n-grams of one part of a URL, repeats included."""
    signs = np.frombuffer(f"^{text}$".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    signs = np.where((signs >= 48) & (signs <= 57), np.uint64(48), signs)
    out = []
    for n in SIZES:
        if len(signs) >= n:
            h = np.full(len(signs) - n + 1, np.uint64(side * 8 + n))
            for k in range(n):
                h = mix64(h * np.uint64(0x100000001B3) + signs[k : len(signs) - n + 1 + k])
            out.append(h >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def features(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their values; the path's count half of the host's. Not scaled by length: it would tell, by n-grams that all share, how long a host is."""
    ids, values = [], []
    for side, text, scale in ((0, host, 1.0), (1, path, 0.5)):
        i, n = np.unique(grams(text, side), return_counts=True)
        ids.append(i)
        values.append(scale / 5 * n)
    return np.concatenate(ids), np.concatenate(values)


def split_url(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:end], rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:stop]


@lru_cache(maxsize=4)
def train(labelled: Sequence[tuple[str, int]] = SEED, rounds: int = 1000, rate: float = 20.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and intercept; label 1: block."""
    rows, cols, vals, y = [], [], [], []
    for k, (url, label) in enumerate(labelled):
        ids, values = features(*split_url(url))
        rows.append(np.full(len(ids), k))
        cols.append(ids)
        vals.append(values)
        y.append(label)
    r, c, v, target = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals), np.array(y, float)
    known, c = np.unique(c, return_inverse=True)
    w, b = np.zeros(len(known)), 0.0
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-np.bincount(r, v * w[c], len(target)) - b)) - target) / len(target)
        w -= rate * (np.bincount(c, v * g[r], len(w)) + decay * w)
        b -= rate * g.sum() / 10
    out = np.zeros(1 << BITS)
    out[known] = w
    return out, b


def probability(pairs: Sequence[tuple[str, str]], model: tuple[np.ndarray, float]) -> list[float]:
    """Of host and path; each distinct one is looked at once, digits being one sign."""
    w, b = model
    known: dict[tuple[str, str], float] = {}
    out = []
    for host, path in pairs:
        key = (host, DIGITS.sub("0", path))
        if key not in known:
            ids, values = features(host, path)
            known[key] = float(1 / (1 + np.exp(-float((w[ids] * values).sum()) - b)))
        out.append(known[key])
    return out


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does. Of equally long ones the first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # longest first, later branches of when() only if no earlier one fits
    chain_name: Column | None = None
    chain_verdict: Column | None = None
    for kind, site, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(start)
        chain_name = chain_name.when(fits, site + start) if chain_name is not None else F.when(fits, site + start)
        chain_verdict = chain_verdict.when(fits, kind) if chain_verdict is not None else F.when(fits, kind)
    return (chain_name, chain_verdict) if chain_name is not None else (name, verdict)


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, labelled: Sequence[tuple[str, int]] = SEED, threshold: float = 0.5) -> DataFrame:
    """id, host, path, rule, verdict, score (the model's, null where a rule decides); one narrow pass, no shuffle."""
    model = df.sparkSession.sparkContext.broadcast(train(tuple(labelled)))

    def run(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for host, path in frames:
            out = pd.Series(np.full(len(host), np.nan))
            open_ = host.notna().to_numpy()
            out[open_] = probability(list(zip(host[open_], path[open_])), model.value)
            yield out

    score = F.pandas_udf(run, "double")
    cut = df.select(F.col(id_col).alias("id"), host_of(F.col(url_col).cast("string")).alias("host"), path_of(F.col(url_col).cast("string")).alias("path"))
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    scored = cut.withColumn("rule", name).withColumn("by_rule", verdict)
    # a decided row's URL isn't scored
    scored = scored.withColumn("p", score(F.when(F.col("by_rule").isNull(), F.col("host")), F.col("path")))
    chosen = F.coalesce(F.col("by_rule"), F.when(F.col("p") >= threshold, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", chosen.alias("verdict"), F.when(F.col("by_rule").isNull(), F.col("p")).alias("score"))
