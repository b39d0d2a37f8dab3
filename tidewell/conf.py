"""Settings, closed and with defaults."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class EngineConf:
    #: what serves: a class by dotted path; entries laid over the built-in registries, None removes one
    engine: str = "tidewell.plans.engine.Engine"
    sources: dict = field(default_factory=dict)
    facet_mappings: dict = field(default_factory=dict)
    scorers: dict = field(default_factory=dict)
    #: language -> dictionaries, each a mapping, a JSON file, or the dotted path of a mapping or of what returns one
    dictionaries: dict = field(default_factory=dict)
    #: what a request may ask for
    sorts: tuple[str, ...] = ("relevance", "newest", "price_asc", "price_desc", "distance")
    default_language: str = "en"
    max_query_chars: int = 200
    max_query_terms: int = 32
    max_facet_fields: int = 12
    max_range_filters: int = 4
    max_page_size: int = 100
    default_page_size: int = 24
    max_result_window: int = 1000
    max_suggestions: int = 25
    default_suggestions: int = 10
    #: requests a minute that a front end lets one caller have
    query_rate: int = 120
    suggest_rate: int = 300
    #: facets
    facet_candidate_cap: int | None = None  # exact counts unless set
    max_facet_values: int = 200
    max_term_chars: int = 160
    accept_features_search: bool = True
    #: text
    stemmed_languages: tuple[str, ...] = ("ru", "en", "de")
    fallback_language: str = ""  # how texts of other languages are stemmed; empty: not at all
    transliterate: frozenset[str] = frozenset({"ru"})
    typo_threshold: int = 3
    trigram_similarity: float = 0.3
    #: the index over time
    visible_statuses: tuple[str, ...] = ("published",)
    tombstone_days: int = 7
    catch_up_limit: int = 500
    stale_reindex_minutes: int = 10
    nightly_at: tuple[int, int] = (3, 20)

    @classmethod
    def of(cls, settings: Mapping) -> EngineConf:
        """Settings by name, in any case; an unknown name is refused."""
        known = {f.name for f in fields(cls)}
        given = {k.lower(): v for k, v in settings.items()}
        if unknown := sorted(given.keys() - known):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**given)


def imported(path: str):
    """What a dotted path names."""
    from importlib import import_module

    module, _, name = path.rpartition(".")
    if not module:
        raise ImportError(f"no dotted path: {path!r}")
    try:
        return getattr(import_module(module), name)
    except AttributeError as e:
        raise ImportError(f"{module} has no {name}") from e


DEFAULT = EngineConf()
