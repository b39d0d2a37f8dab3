"""Geography by plain trigonometry: distances, boxes, geohashes."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_KM, KM_PER_DEGREE = 6371.0, 111.32
_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine_km(lat: float, lon: float, to_lat: float, to_lon: float) -> float:
    a = math.sin(math.radians(to_lat - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(to_lat)) * math.sin(math.radians(to_lon - lon) / 2) ** 2
    return 2 * EARTH_KM * math.asin(math.sqrt(min(1.0, a)))


def haversine_col(lat: Column, lon: Column, to_lat: float, to_lon: float) -> Column:
    """Null without coordinates."""
    lat, lon = lat.cast("double"), lon.cast("double")
    a = F.pow(F.sin(F.radians(F.lit(to_lat) - lat) / 2), 2) + F.cos(F.radians(lat)) * F.lit(math.cos(math.radians(to_lat))) * F.pow(F.sin(F.radians(F.lit(to_lon) - lon) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def radius_box(lat: float, lon: float, radius_km: float) -> tuple[float, float, float, float]:
    """min_lat, min_lon, max_lat, max_lon around a circle; min_lon > max_lon crosses the date line."""
    d_lat = radius_km / KM_PER_DEGREE
    south, north = max(-90.0, lat - d_lat), min(90.0, lat + d_lat)
    shrink = math.cos(math.radians(min(89.9, max(abs(south), abs(north)))))
    d_lon = d_lat / max(shrink, 1e-9)
    if d_lon >= 180:
        return south, -180.0, north, 180.0
    west, east = lon - d_lon, lon + d_lon
    return south, west + 360 if west < -180 else west, north, east - 360 if east > 180 else east


def in_box(lat: Column, lon: Column, min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> Column:
    lat, lon = lat.cast("double"), lon.cast("double")
    east_west = lon.between(min_lon, max_lon) if min_lon <= max_lon else (lon >= min_lon) | (lon <= max_lon)
    return F.coalesce(lat.between(min_lat, max_lat) & east_west, F.lit(False))


def geohash(lat: float, lon: float, precision: int = 12) -> str:
    ranges, bits = [[-180.0, 180.0], [-90.0, 90.0]], 0
    for k in range(precision * 5):
        r, v = ranges[k % 2], (lon, lat)[k % 2]
        mid = (r[0] + r[1]) / 2
        bits = bits * 2 + (v >= mid)
        r[0 if v >= mid else 1] = mid
    return "".join(_ALPHABET[bits >> 5 * (precision - 1 - k) & 31] for k in range(precision))


def geohash_box(code: str) -> tuple[float, float, float, float]:
    """South, west, north, east of a geohash's cell; south and west belong to it."""
    ranges = [[-180.0, 180.0], [-90.0, 90.0]]
    for k, bit in enumerate(b >> s & 1 for b in map(_ALPHABET.index, code.lower()) for s in (4, 3, 2, 1, 0)):
        r = ranges[k % 2]
        r[0 if bit else 1] = (r[0] + r[1]) / 2
    return ranges[1][0], ranges[0][0], ranges[1][1], ranges[0][1]


def box_prefix(min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> str:
    """Common geohash beginning of the box's corners; empty across the date line."""
    if min_lon > max_lon:
        return ""
    corners = [geohash(a, b) for a in (min_lat, max_lat) for b in (min_lon, max_lon)]
    n = 0
    while n < 12 and len({c[n] for c in corners}) == 1:
        n += 1
    return corners[0][:n]


def geohash_col(lat: Column, lon: Column, precision: int = 12) -> Column:
    """The same by interleaving the bits of both grid numbers, five a sign; null without coordinates."""
    n = precision * 5
    x = F.least(F.floor((lon.cast("double") + 180.0) / 360.0 * float(1 << (n + 1) // 2)), F.lit((1 << (n + 1) // 2) - 1)).cast("long")
    y = F.least(F.floor((lat.cast("double") + 90.0) / 180.0 * float(1 << n // 2)), F.lit((1 << n // 2) - 1)).cast("long")
    signs = []
    for s in range(precision):
        code = F.lit(0)
        for b in range(5):
            k = s * 5 + b
            grid, at = (x, (n + 1) // 2 - 1 - k // 2) if k % 2 == 0 else (y, n // 2 - 1 - k // 2)
            code = code * 2 + F.shiftright(grid, at).bitwiseAND(F.lit(1)).cast("int")
        signs.append(F.substring(F.lit(_ALPHABET), 1, 32).substr((code + 1).cast("int"), F.lit(1)))
    return F.concat(*signs)
