"""Registries: sources, facet mappings, scorers. Built-in entries, overlaid at run time; None removes one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewell.conf import DEFAULT

KINDS = ("term", "range", "path", "skip")


@dataclass(frozen=True)
class FacetMapping:
    """How an attribute type becomes facets. values: of a feature struct, the array of its values."""

    kind: str
    values: Callable[[Column], Column]
    numeric: bool = False

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"facet kind {self.kind}")


def _scalar(feature: Column) -> Column:
    return F.array(feature["scalar"])


def _list(feature: Column) -> Column:
    return F.coalesce(feature["list"], F.array(feature["scalar"]))


def _simple(feature: Column) -> Column:
    return F.array(feature["simple"])


@dataclass(frozen=True)
class Scorer:
    """weight * expr(context), in the sorts it applies to. Without an expression it counts nothing and isn't supported."""

    slug: str
    weight: float
    expr: Callable[[dict[str, Column]], Column] | None = None
    params: dict = field(default_factory=dict)
    sorts: tuple[str, ...] = ("relevance",)
    reason: str = ""


@dataclass(frozen=True)
class Source:
    """A corpus: load(spark, dir) gives input documents or whatever `mapper` turns into them."""

    doc_type: str
    load: Callable[[SparkSession, str], DataFrame]
    mapper: Callable[[DataFrame], DataFrame] = lambda df: df
    key_fields: tuple[str, ...] = ("key",)
    visible_statuses: tuple[str, ...] = DEFAULT.visible_statuses
    signals: tuple[str, ...] = ()
    category_schema: dict[str, list[dict]] = field(default_factory=dict)

    def key_of(self, payload: dict) -> str | None:
        """First of the key fields that isn't empty, as text."""
        return next((str(payload[f]) for f in self.key_fields if payload.get(f) not in (None, "")), None)

    def key_col(self, event: DataFrame) -> Column:
        return F.coalesce(*[F.nullif(event[f].cast("string"), F.lit("")) for f in self.key_fields])


class Registry(dict):
    """name -> entry; a layer put over it wins, None in it removes."""

    def overlay(self, layer: dict) -> Registry:
        merged = Registry(self)
        for k, v in layer.items():
            if v is None:
                merged.pop(k, None)
            else:
                merged[k] = v
        return merged


FACET_MAPPINGS = Registry(
    {t: FacetMapping("range", _scalar, True) for t in ("int", "float", "convertible_unit", "date")}
    | {t: FacetMapping("term", _scalar) for t in ("string", "bool")}
    | {"select": FacetMapping("term", _list), "hierarchical_select": FacetMapping("path", _list), "hex_color": FacetMapping("term", _simple), "header": FacetMapping("skip", _scalar)}
)
OTHER_TYPE = FacetMapping("term", _scalar)


def mapping_of(type_slug: str, mappings: Registry = FACET_MAPPINGS) -> FacetMapping:
    return mappings.get(type_slug, OTHER_TYPE)


def _freshness(c: dict[str, Column]) -> Column:
    micros = F.timestamp_diff("MICROSECOND", c["published_at"], c["as_of"]).cast("double")
    days = F.greatest(F.lit(0.0), micros / F.lit(86400e6))
    return F.when(c["published_at"].isNull(), 0.0).otherwise(F.pow(F.lit(0.5), days / 14))


SCORERS = Registry(
    {
        "relevance": Scorer("relevance", 1.0, lambda c: c["text_score"], reason="how well the words match"),
        "freshness_decay": Scorer("freshness_decay", 0.3, _freshness, {"half_life_days": 14}, reason="newer first"),
        "geo_decay": Scorer("geo_decay", 0.3, lambda c: F.coalesce(F.greatest(F.lit(0.0), 1 - c["distance_km"] / 50), F.lit(0.0)), {"radius_km": 50}, reason="nearer first"),
        "promotion_boost": Scorer("promotion_boost", 1.0, lambda c: F.least(F.lit(5.0), F.greatest(F.lit(-1.0), c["boost"])), {"min": -1, "max": 5}, reason="promoted"),
        "popularity": Scorer("popularity", 0.2, lambda c: F.greatest(F.lit(0.0), c["popularity"].cast("double")) / (F.greatest(F.lit(0.0), c["popularity"].cast("double")) + 10), {"half": 10}, reason="often seen"),
    }
)


#: For a host to lay over SCORERS: words close together count more. It reads whole texts of the candidates.
COVER_DENSITY = Scorer("cover_density", 0.5, lambda c: c["covers"] / (1 + c["covers"]), reason="words close together")


def scorers_for(sort: str, scorers: Registry = SCORERS) -> list[Scorer]:
    return [s for _, s in sorted(scorers.items()) if sort in s.sorts]


def disclosure(scorers: Registry = SCORERS) -> list[dict]:
    """What moves a ranking, by slug."""
    return [{"slug": s.slug, "weight": s.weight, "params": ",".join(f"{k}={v}" for k, v in sorted(s.params.items())), "sorts": ",".join(s.sorts), "active": s.expr is not None and s.weight != 0, "reason": s.reason} for _, s in sorted(scorers.items())]
