"""The search engine: one call a verb, over an index DataFrame."""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.conf import DEFAULT, EngineConf, imported
from tidewell.functions.stem import matches_stems
from tidewell.functions.text import dictionary, lint, word_similarity
from tidewell.model import ABILITIES, Capabilities, Cursor, Search
from tidewell.operators import changes, facets, ranking, suggest as completions
from tidewell.operators.build import attach_category_path, build_index, defaulted_types, unplaced
from tidewell.operators.filters import candidates, text_match
from tidewell.plans.parse import encode_cursor, parse_query
from tidewell.sources.corpora import SOURCES
from tidewell.sources.events import check_wiring
from tidewell.sources.registry import FACET_MAPPINGS, SCORERS, Registry, Source, disclosure
from tidewell.streaming.schedule import jobs


#: What whatever serves in this one's place has to have, and the columns that an index has to have.
VERBS = ("search", "suggest", "ranking", "health", "validate", "candidates", "hits", "stored")
NEEDED = ("doc_type", "doc_key", "visible", "category_path", "folded_title", "folded_extra", "text_plain", "stems", "facet_terms", "numbers", "geohash", "boost", "popularity", "promoted", "indexed_at")


class Engine:
    """Holds nothing but an index; every verb declares a plan and runs it once."""

    def __init__(self, index: DataFrame, conf: EngineConf = DEFAULT, sources: Registry = SOURCES, scorers: Registry = SCORERS, degraded: tuple[str, ...] = ()):
        self.index, self.conf, self.degraded = index, conf, degraded
        self.sources, self.scorers = sources.overlay(conf.sources), scorers.overlay(conf.scorers)

    @classmethod
    def over(cls, spark: SparkSession, sf_dir: str, doc_types: tuple[str, ...] = ("listing",), conf: EngineConf = DEFAULT, sources: Registry = SOURCES, indexed_at: str = "2024-01-01", categories: DataFrame | None = None) -> Engine:
        """categories: category_id, path; rows whose category has none are found under it alone, and the engine says so (`category_path` in degraded)."""
        built, degraded, known = None, (), sources.overlay(conf.sources)
        for t in doc_types:
            given = known[t].mapper(known[t].load(spark, sf_dir))
            if not unplaced(given, categories).isEmpty():
                degraded = ("category_path",)
            one = cls.built(given, known[t], conf, indexed_at, categories)
            built = one if built is None else built.unionByName(one)
        return cls(built, conf, sources, degraded=degraded)

    @staticmethod
    def built(given: DataFrame, source: Source, conf: EngineConf, indexed_at: str, categories: DataFrame | None = None) -> DataFrame:
        """Index rows of a source's documents."""
        given = given if categories is None else attach_category_path(given, categories)
        return build_index(given, conf, source.visible_statuses, FACET_MAPPINGS.overlay(conf.facet_mappings)).withColumn("indexed_at", F.lit(indexed_at).cast("timestamp"))

    def over_index(self, index: DataFrame) -> Engine:
        return type(self)(index, self.conf, self.sources, self.scorers, self.degraded)

    def stored(self, folder: str) -> Engine:
        """The same engine over the index written to a folder, by type: what serves queries, as filters and columns reach the scan. Other types there stay."""
        self.index.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("doc_type").parquet(folder)
        return self.over_index(self.index.sparkSession.read.parquet(folder).select(*self.index.columns))

    def reindexed(self, folder: str, doc_type: str, keys: DataFrame, at: str, sf_dir: str, categories: DataFrame | None = None) -> tuple[Engine, DataFrame]:
        """Keys (doc_key, eid, seq) pulled again from their source; the engine afterwards, over a new folder, and what happened."""
        source, spark = self.sources[doc_type], self.index.sparkSession
        keys = keys.withColumn("doc_type", F.lit(doc_type))
        given = changes.pulled(source.mapper(source.load(spark, sf_dir)), keys.select("doc_key"))
        after, report = changes.ingest(self.index, self.built(given, source, self.conf, at, categories).select(*self.index.columns), keys, at)
        return self.over_index(after).stored(folder), report

    @property
    def capabilities(self) -> Capabilities:
        lacking = {"geo_native", "synonyms_native", *(["exact_facet_counts"] if self.conf.facet_candidate_cap is not None else [])}
        limits = {c: getattr(self.conf, c) for c in ("max_facet_fields", "max_result_window")}
        return Capabilities(frozenset(ABILITIES) - lacking, tuple(sorted(s.slug for s in self.scorers.values() if s.expr)), limits)

    def parse(self, params: Mapping, accept_language: str = "") -> Search:
        return parse_query(params, self.sources, self.conf, accept_language)

    def candidates(self, q: Search, fuzzy: bool = False) -> DataFrame:
        return candidates(self.index, q, text=self._text(q, fuzzy))

    def _text(self, q: Search, fuzzy: bool):
        """The words as they stand or by their stems; with fuzzy, or nearly."""
        if not q.words:
            return None
        own = text_match(q.words) | matches_stems(F.col("stems"), q.words.groups, q.words.language or q.language, self.conf)
        return own | self._near(q) if fuzzy else own

    def _near(self, q: Search):
        """Every group has a member that the text nearly has in one of its words."""
        words = F.split(F.col("text_plain"), "[^\\p{L}\\p{N}]+")
        out = F.lit(True)
        for g in q.words.groups:
            near = F.lit(False)
            for term in g:
                near = near | (word_similarity(words, term) >= self.conf.trigram_similarity * 1.5)
            out = out & near
        return out

    def hits(self, q: Search, fuzzy: bool = False) -> DataFrame:
        """Scored candidates: doc_key, score, distance_km, sort_value, promoted, card."""
        rows = ranking.scored(self.candidates(q, fuzzy), q, self.scorers)
        return rows.select("doc_key", "score", "distance_km", "published_at", "price_base", "promoted", "card")

    def search(self, params: Mapping | Search, accept_language: str = "") -> dict:
        began = time.monotonic()
        q = params if isinstance(params, Search) else self.parse(params, accept_language)
        if q.as_of is None:
            q = replace(q, as_of=datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S"))  # one now for all of its pages
        fuzzy = False
        tally = self._tally(q, False)
        if q.words and tally.get(None, 0) < self.conf.typo_threshold:
            # the typed words decide by the whole result, so that a last page is no reason for it
            fuzzy = True
            tally = self._tally(q, True)
        total, exact = tally.get(None, 0), True
        rows = ranking.page(self.hits(q, fuzzy).withColumn("sort_value", ranking.sort_value(q.sort)), q, 1).collect()
        backwards = q.backwards
        offset = q.cursor.offset if q.cursor else 0
        if backwards:
            more_before, has_next = len(rows) > q.limit, True
            rows = rows[-q.limit :]
            has_prev = more_before
        else:
            has_next, has_prev = len(rows) > q.limit, offset > 0
            rows = rows[: q.limit]
        plan, counts, meta, degraded = self._facets(q, fuzzy, tally)
        items = []
        for r in rows:
            item = {"key": r.doc_key, "score": r.score, "promoted": bool(r.promoted), "card": dict(r.card or {})}
            if r.distance_km is not None:
                item["distance_km"] = round(r.distance_km, 2)
            items.append(item)
        out = {"items": items, "facets": counts, "facet_meta": meta, "has_next": has_next, "has_prev": has_prev, "count": total, "exact_total": exact, "degraded": degraded, "backend": "spark", "sort": q.sort, "took_ms": int((time.monotonic() - began) * 1000)}
        if rows and has_next:
            out["next_anchor"] = encode_cursor(Cursor(rows[-1].sort_value, rows[-1].doc_key, (offset if not backwards else max(0, offset - q.limit)) + len(rows), q.as_of))
        if rows and has_prev:
            out["prev_anchor"] = encode_cursor(Cursor(rows[0].sort_value, rows[0].doc_key, max(0, offset - (0 if not backwards else q.limit)), q.as_of))
        return out

    def plan_of(self, q: Search):
        schema = self.sources[q.doc_type].category_schema
        features = schema.get(q.within[-1], schema.get("", [])) if q.within else []
        return facets.facet_plan(features, q.counted, self.conf, FACET_MAPPINGS.overlay(self.conf.facet_mappings))

    def _tally(self, q: Search, fuzzy: bool) -> dict[str | None, int]:
        """The total (at None) and what each facet's own filter keeps out, from one scan; a row for each filter at most."""
        return {r.only: r.n for r in facets.tallies(self.index, q, self._text(q, fuzzy)).collect()}

    def _facets(self, q: Search, fuzzy: bool, tally: dict[str | None, int]) -> tuple:
        plan, degraded = self.plan_of(q) if q.counting else facets.CountPlan(), list(self.degraded)
        if not plan.slugs:
            return plan, {}, {"approximate": False, "candidates": 0, "counted": [], "skipped": list(plan.left_out)}, degraded
        text = self._text(q, fuzzy)
        n = tally.get(None, 0) + max((tally.get(s, 0) for s in plan.slugs), default=0)
        cap = self.conf.facet_candidate_cap
        approximate = cap is not None and n > cap
        counts = facets.sampled_counts(self.index, q, plan, cap / n, text) if approximate else facets.facet_counts(self.index, q, plan, text)
        found: dict[str, dict[str, int]] = {s: {} for s in plan.slugs}
        # no more than so many values of each slug, and the options of closed ones
        for r in facets.zero_filled(facets.top_values(counts, self.conf.max_facet_values).drop("place"), plan).collect():
            found[r.slug][r.value] = r["count"]
        if approximate:
            degraded.append("exact_facet_counts")
        return plan, found, {"approximate": approximate, "candidates": n, "counted": list(plan.slugs), "skipped": list(plan.left_out)}, degraded

    def suggest(self, doc_type: str, prefix: str, limit: int | None = None) -> dict:
        rows = completions.suggest(self.index, doc_type, prefix, limit, self.conf).collect()
        return {"items": [r.title for r in rows], "backend": "spark"}

    def ranking(self) -> list[dict]:
        return disclosure(self.scorers)

    def health(self, as_of: str) -> dict:
        rows = {r.doc_type: {"documents": r.documents, "lag_seconds": r.lag_seconds} for r in changes.health(self.index, as_of).collect()}
        return {"backend": "spark", "reachable": True, "documents": sum(t["documents"] for t in rows.values()), "types": rows, "capabilities": self.capabilities.described()}

    def validate(self, inputs: DataFrame | None = None, signals: DataFrame | None = None, categories: DataFrame | None = None, scheduled: tuple[str, ...] | None = None) -> list[str]:
        """Findings, errors first.

        E001 the configured engine can't be imported; E002 it lacks a verb, or a sort has no order; E003 the index lacks a column; E004 a source can't be wired.
        W001 no sources; W002 a type without a mapping; W003 recurring jobs that nobody has scheduled; W004 `popular` among the sorts and no popularity ever signalled;
        W005 terms were cut; W006 categories without a path. Dictionaries' faults come by their own names.
        """
        out = []
        try:
            named = imported(self.conf.engine)
            out += [f"E002:{v}" for v in VERBS if not callable(getattr(named, v, None))]
        except ImportError:
            out.append(f"E001:{self.conf.engine}")
        out += [f"E002:{s}" for s in self.conf.sorts if s not in ranking.ORDERS and s != "popular"]
        out += [f"E003:{c}" for c in NEEDED if c not in self.index.columns]
        out += [f"E004:{k}" for k, s in self.sources.items() if not callable(s.load)] + check_wiring(self.sources)
        out += [] if self.sources else ["W001"]
        if inputs is not None:
            out += [f"W002:{r.type}" for r in defaulted_types(inputs, FACET_MAPPINGS.overlay(self.conf.facet_mappings)).orderBy("type").collect()]
            out += [] if unplaced(inputs, categories).isEmpty() else ["W006"]
        if scheduled is not None:
            out += [f"W003:{j}" for j in jobs(self.conf) if j not in scheduled]
        if "popular" in self.conf.sorts and (signals is None or signals.where("kind = 'popularity'").isEmpty()):
            out.append("W004")
        if "truncated_terms" in self.index.columns and not self.index.where("truncated_terms > 0").isEmpty():
            out.append("W005")
        languages = sorted({"en", "ru", *self.conf.dictionaries})
        return out + [f"dictionary:{f}" for language in languages for f in lint(dictionary(language, self.conf), self.conf)]
