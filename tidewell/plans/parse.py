"""Request parameters to a query, or a named refusal."""

from __future__ import annotations

import base64
import json
from collections.abc import Mapping
from decimal import Decimal, InvalidOperation

from tidewell.conf import DEFAULT, EngineConf
from tidewell.functions.text import normalize_query
from tidewell.model import Between, Box, Circle, Cursor, QueryRefused, Search


def encode_cursor(c: Cursor) -> str:
    raw = json.dumps({"v": c.sort_value, "k": c.doc_key, "o": c.offset, "t": c.as_of}, separators=(",", ":"))
    return base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")


def decode_cursor(text: str) -> Cursor:
    try:
        d = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        return Cursor(d["v"], str(d["k"]), max(0, int(d["o"])), d.get("t"))
    except (ValueError, KeyError, TypeError) as e:
        raise QueryRefused("bad_cursor") from e


def _many(params: Mapping, name: str) -> list[str]:
    v = params.get(name)
    return [str(x) for x in (v if isinstance(v, (list, tuple)) else [v]) if x not in (None, "")]


def _number(text: str) -> Decimal | None:
    if not text.strip():
        return None
    try:
        d = Decimal(text.strip())
    except InvalidOperation as e:
        raise QueryRefused("bad_range", text) from e
    if not d.is_finite():
        raise QueryRefused("bad_range", text)
    return d


def parse_range(slug: str, text: str) -> Between:
    low, dots, high = str(text).partition("..")
    if not dots:
        raise QueryRefused("bad_range", text)
    r = Between(slug, _number(low), _number(high))
    if r.low is None and r.high is None or r.low is not None and r.high is not None and r.low > r.high:
        raise QueryRefused("bad_range", text)
    return r


def parse_area(params: Mapping) -> Box | Circle | None:
    """A box wins over a circle."""
    try:
        if params.get("bbox"):
            south, west, north, east = (float(x) for x in str(params["bbox"]).split(","))
            if not (-90 <= south <= north <= 90 and -180 <= west <= 180 and -180 <= east <= 180):
                raise QueryRefused("bad_geo", "bbox")
            return Box(south, west, north, east)
        given = [params.get(k) not in (None, "") for k in ("lat", "lon")]
        if not any(given):
            if params.get("radius") not in (None, ""):
                raise QueryRefused("bad_geo", "radius without centre")
            return None
        lat, lon = float(params.get("lat") or "nan"), float(params.get("lon") or "nan")
        radius = float(params["radius"]) if params.get("radius") not in (None, "") else None
    except (ValueError, TypeError) as e:
        if isinstance(e, QueryRefused):
            raise
        raise QueryRefused("bad_geo") from e
    if not all(given) or not (-90 <= lat <= 90 and -180 <= lon <= 180) or radius is not None and not radius > 0:
        raise QueryRefused("bad_geo")
    return Circle(lat, lon, radius)


def parse_query(params: Mapping, doc_types: Mapping, conf: EngineConf = DEFAULT, accept_language: str = "") -> Search:
    doc_type = params.get("type") or ""
    if doc_type not in doc_types:
        raise QueryRefused("unknown_doc_type", doc_type)
    asked = (params.get("lang") or "").strip().lower()
    language = asked or accept_language.split(",")[0].split(";")[0].split("-")[0].strip().lower() or conf.default_language
    raw = str(params.get("q") or "").strip()
    if len(raw) > conf.max_query_chars:
        raise QueryRefused("query_too_long")
    text = normalize_query(raw, language, conf)
    facets = {k[2:]: _many(params, k) for k in params if k.startswith("f.") and _many(params, k)}
    ranges = tuple(parse_range(k[2:], v) for k in params if k.startswith("r.") for v in _many(params, k))
    if len(facets) > conf.max_facet_fields:
        raise QueryRefused("too_many_facets")
    if len(ranges) > conf.max_range_filters:
        raise QueryRefused("too_many_ranges")
    area = parse_area(params)
    sort = params.get("sort") or ("relevance" if raw else "newest")
    if sort not in conf.sorts:
        raise QueryRefused("unknown_sort", sort)
    if sort == "distance" and not isinstance(area, Circle):
        raise QueryRefused("distance_without_center")
    try:
        limit = max(1, min(conf.max_page_size, int(params.get("limit") or conf.default_page_size)))
    except (ValueError, TypeError):
        limit = conf.default_page_size
    cursor = decode_cursor(params["cursor"]) if params.get("cursor") else None
    if cursor and cursor.offset + limit > conf.max_result_window:
        raise QueryRefused("window_exceeded")
    wanted = params.get("facets")
    slugs = None if wanted in (None, "", "on") else tuple(s.strip() for s in str(wanted).split(",") if s.strip())
    return Search(
        doc_type,
        owner=params.get("owner") or None,
        only_language=asked or None,
        within=tuple(p for p in str(params.get("category") or "").strip("/").split("/") if p),
        chosen=facets,
        between=ranges,
        area=area,
        words=text,
        sort=sort,
        as_of=(cursor.as_of if cursor else None) or params.get("as_of"),
        cursor=cursor,
        backwards=params.get("direction") == "prev" and cursor is not None,
        limit=limit,
        language=language,
        counting=wanted != "off",
        counted=None if wanted == "off" else slugs,
    )
