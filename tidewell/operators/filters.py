"""What is a candidate of a query, said once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions.geo import box_prefix, haversine_col, in_box, radius_box
from tidewell.functions.text import contains_group
from tidewell.model import Between, Box, Circle, Search, Words

#: What a word counts where it stands first: title, extra, anywhere in the text.
TEXT_WEIGHTS = (1.0, 0.4, 0.2)


def scope(doc_type: str) -> Column:
    return (F.col("doc_type") == doc_type) & F.col("visible")


def category(path: tuple[str, ...]) -> Column:
    """The path begins so."""
    return F.slice("category_path", 1, len(path)) == F.array(*map(F.lit, path))


def facet(slug: str, values: list[str]) -> Column:
    return F.arrays_overlap("facet_terms", F.array(*[F.lit(f"{slug}={v}") for v in values]))


def in_range(r: Between) -> Column:
    """Inclusive, either end open; without the number nothing is in. The slug `price` is the price column."""
    value = F.col("price_base") if r.slug == "price" else F.col("numbers")[r.slug]
    out = value.isNotNull()
    if r.low is not None:
        out = out & (value >= F.lit(r.low))
    if r.high is not None:
        out = out & (value <= F.lit(r.high))
    return F.coalesce(out, F.lit(False))


def numbers_table(index: DataFrame) -> DataFrame:
    """doc_type, doc_key, slug, value: the numbers as rows."""
    return index.select("doc_type", "doc_key", F.explode("numbers").alias("slug", "value"))


def in_range_semi(index: DataFrame, numbers: DataFrame, r: Between) -> DataFrame:
    """The same as a semi-join with the rows of numbers_table()."""
    wanted = numbers.where((F.col("slug") == r.slug) & (F.lit(True) if r.low is None else F.col("value") >= F.lit(r.low)) & (F.lit(True) if r.high is None else F.col("value") <= F.lit(r.high)))
    return index.join(wanted, ["doc_type", "doc_key"], "left_semi")


def located(area: Box | Circle) -> Column:
    """In the area. A box without the date line in it has a common geohash beginning, which can skip row groups of an index in that order."""
    lat, lon = F.col("lat"), F.col("lon")
    edges = (area.south, area.west, area.north, area.east) if isinstance(area, Box) else radius_box(area.lat, area.lon, area.km) if area.km is not None else None
    out = lat.isNotNull() & lon.isNotNull()
    if edges is not None:
        if prefix := box_prefix(*edges):
            out = F.startswith("geohash", F.lit(prefix)) & out
        out = out & in_box(lat, lon, *edges)
    if isinstance(area, Circle) and area.km is not None:
        out = out & (haversine_col(lat, lon, area.lat, area.lon) <= area.km)
    return out


def text_match(q: Words) -> Column:
    """Every group has a member in the folded text."""
    return reduce(lambda a, b: a & b, [contains_group(F.col("text_plain"), g) for g in q.groups], F.lit(True))


def text_score(q: Words) -> Column:
    """Of each group the best place of any of its members, added up."""
    title, extra, plain = F.col("folded_title"), F.col("folded_extra"), F.col("text_plain")
    out = F.lit(0.0)
    for g in q.groups:
        best = F.when(contains_group(title, g), TEXT_WEIGHTS[0]).when(contains_group(extra, g), TEXT_WEIGHTS[1]).when(contains_group(plain, g), TEXT_WEIGHTS[2]).otherwise(0.0)
        out = out + best
    return out


def conditions(q: Search, text: Column | None = None) -> list[Column]:
    """All but the facets, cheap ones first. text: in place of the query's own words."""
    out = [scope(q.doc_type)]
    if q.only_language is not None:
        out.append(F.col("language") == q.only_language)
    if q.owner is not None:
        out.append(F.col("owner_key") == q.owner)
    if q.within:
        out.append(category(q.within))
    out += [in_range(r) for r in q.between]
    if q.area is not None:
        out.append(located(q.area))
    if text is not None:
        out.append(text)
    elif q.words:
        out.append(text_match(q.words))
    return out


def base(index: DataFrame, q: Search, text: Column | None = None) -> DataFrame:
    return index.where(reduce(lambda a, b: a & b, conditions(q, text)))


def candidates(index: DataFrame, q: Search, skip: str | None = None, text: Column | None = None) -> DataFrame:
    """Rows that fit; `skip` leaves one facet's own filter out."""
    fits = [facet(s, v) for s, v in sorted(q.chosen.items()) if s != skip and v]
    df = base(index, q, text)
    return df.where(reduce(lambda a, b: a & b, fits)) if fits else df
