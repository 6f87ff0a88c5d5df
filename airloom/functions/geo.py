"""Distances, Web Mercator and map tiles as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: The mean radius of distances, the radius and the latitude limit of Web Mercator.
EARTH_M = 6_371_000.0
MERCATOR_M = 6_378_137.0
MERCATOR_LATITUDE = 85.05112878
MAX_TILES = 80


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def haversine(lat0, lon0, lat1, lon1) -> Column:
    """Great-circle metres between two places in degrees.

    Differences are taken in degrees, where those of close places are exact; places equally far off are so to the last
    bit wherever they lie."""
    lat0, lon0, lat1, lon1 = map(_col, (lat0, lon0, lat1, lon1))
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    a = half(lat0, lat1) + half(lon0, lon1) * F.cos(F.radians(lat0)) * F.cos(F.radians(lat1))
    return F.asin(F.least(F.lit(1.0), F.sqrt(a))) * (2 * EARTH_M)


def to_mercator(lon, lat) -> tuple[Column, Column]:
    """Web Mercator metres; latitudes are held within the map."""
    lat = F.greatest(F.lit(-MERCATOR_LATITUDE), F.least(F.lit(MERCATOR_LATITUDE), _col(lat)))
    return F.radians(_col(lon)) * MERCATOR_M, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR_M


def from_mercator(x, y) -> tuple[Column, Column]:
    """Longitude and latitude of Web Mercator metres."""
    return F.degrees(_col(x) / MERCATOR_M), F.degrees(2 * F.atan(F.exp(_col(y) / MERCATOR_M)) - math.pi / 2)


def tile_index(lon, lat, zoom: int) -> tuple[Column, Column]:
    """Column and row of the tile at a zoom, held within the map."""
    n = float(1 << zoom)
    lat = F.greatest(F.lit(-MERCATOR_LATITUDE), F.least(F.lit(MERCATOR_LATITUDE), _col(lat)))
    hold = lambda v: F.greatest(F.lit(0), F.least(F.lit(int(n) - 1), F.floor(v))).cast("int")
    return hold((_col(lon) + 180) / 360 * n), hold((1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n)


def tile_bounds(x: int, y: int, zoom: int) -> tuple[float, float, float, float]:
    """West, south, east and north of a tile in degrees."""
    n = 1 << zoom
    lat = lambda row: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * row / n))))
    return x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)


def tile_of(lon: float, lat: float, zoom: int) -> tuple[int, int]:
    """``tile_index`` of one place, on the driver."""
    n = 1 << zoom
    lat = max(-MERCATOR_LATITUDE, min(MERCATOR_LATITUDE, lat))
    hold = lambda v: max(0, min(n - 1, math.floor(v)))
    return hold((lon + 180) / 360 * n), hold((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n)


def choose_zoom(bounds: tuple[float, float, float, float], max_tiles: int = MAX_TILES) -> int:
    """The largest zoom up to 19 at which west, south, east, north need no more tiles than that."""
    west, south, east, north = bounds
    for zoom in range(19, 0, -1):
        (x0, y0), (x1, y1) = tile_of(west, north, zoom), tile_of(east, south, zoom)
        if (x1 - x0 + 1) * (y1 - y0 + 1) <= max_tiles:
            return zoom
    return 1
