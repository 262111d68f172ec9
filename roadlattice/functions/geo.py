"""Geometry as column expressions; a line is an array of struct(lon, lat)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed metres: earth radius, and a degree of longitude (at the equator) and of latitude in the plane.
EARTH_M, LON_M, LAT_M = 6371000.0, 111320.0, 110540.0


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def east_m(dlon: Column, lat: Column) -> Column:
    return dlon * LON_M * F.cos(F.radians(lat))


def planar_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return F.sqrt(F.pow(east_m(lon2 - lon1, lat1), F.lit(2.0)) + F.pow((lat2 - lat1) * LAT_M, F.lit(2.0)))


def pairs(line: Column) -> Column:
    """Consecutive point pairs of a line as struct(p, q)."""
    return F.transform(F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))), lambda p, i: F.struct(p.alias("p"), F.get(line, i + 1).alias("q")))


def length_m(line: Column) -> Column:
    return F.aggregate(F.transform(pairs(line), lambda s: haversine_m(s["p"]["lon"], s["p"]["lat"], s["q"]["lon"], s["q"]["lat"])), F.lit(0.0), lambda a, x: a + x)


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle bearing from the first point, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def planar_bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Bearing in the plane, 0 to 360; greater longitudes are east also on a grid that goes on past a pole."""
    return F.pmod(F.degrees(F.atan2((lon2 - lon1) * LON_M * F.abs(F.cos(F.radians(lat1))), (lat2 - lat1) * LAT_M)), F.lit(360.0))


def heading_gap(a: Column, b: Column) -> Column:
    """Angle between two undirected lines, 0 to 90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180 - d)


def turn(a: Column, b: Column) -> Column:
    """Change of direction, -180 to 180, right positive."""
    return F.pmod(b - a + 180, F.lit(360.0)) - 180


def point_segment_m(lon: Column, lat: Column, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres from a point to a segment, in the plane about the point."""
    x1, y1, x2, y2 = east_m(lon1 - lon, lat), (lat1 - lat) * LAT_M, east_m(lon2 - lon, lat), (lat2 - lat) * LAT_M
    dx, dy = x2 - x1, y2 - y1
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(-(x1 * dx + y1 * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
    return F.sqrt(F.pow(x1 + t * dx, F.lit(2.0)) + F.pow(y1 + t * dy, F.lit(2.0)))


def interpolate(line: Column, share: float) -> Column:
    """Point at a share of a line's planar length, as struct(lon, lat)."""
    steps = F.transform(pairs(line), lambda s: F.struct(s["p"].alias("p"), s["q"].alias("q"), planar_m(s["p"]["lon"], s["p"]["lat"], s["q"]["lon"], s["q"]["lat"]).alias("m")))
    total = F.aggregate(steps, F.lit(0.0), lambda a, s: a + s["m"])
    first = F.get(line, F.lit(0))
    start = F.struct(F.lit(0.0).alias("done"), first["lon"].alias("lon"), first["lat"].alias("lat")).cast("struct<done:double,lon:double,lat:double>")

    def step(acc: Column, s: Column) -> Column:
        target = total * share
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (target - acc["done"]) / F.greatest(s["m"], F.lit(1e-12))))
        here = acc["done"] < target
        lon, lat = s["p"]["lon"] + part * (s["q"]["lon"] - s["p"]["lon"]), s["p"]["lat"] + part * (s["q"]["lat"] - s["p"]["lat"])
        return F.struct((acc["done"] + s["m"]).alias("done"), F.when(here, lon).otherwise(acc["lon"]).alias("lon"), F.when(here, lat).otherwise(acc["lat"]).alias("lat"))

    return F.aggregate(steps, start, step, lambda acc: F.struct(acc["lon"].alias("lon"), acc["lat"].alias("lat")))


def tile(lon: Column, lat: Column, zoom: int) -> Column:
    """Web-mercator tile struct(x, y)."""
    n = float(1 << zoom)
    r = F.radians(lat)
    return F.struct(F.floor((lon + 180) / 360 * n).alias("x"), F.floor((1 - F.asinh(F.tan(r)) / F.pi()) / 2 * n).alias("y"))


def cell(lon: Column, lat: Column, size: float) -> Column:
    return F.struct(F.floor(lon / size).alias("cx"), F.floor(lat / size).alias("cy"))


def near_cells(lon: Column, lat: Column, size: float) -> Column:
    """The cell of a point and its eight neighbours, for joins within ``size``."""
    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    c = cell(lon, lat, size)
    return F.transform(moves, lambda m: F.struct((c["cx"] + m["i"]).alias("cx"), (c["cy"] + m["j"]).alias("cy")))


def _reach_width(band: Column, within_m: float) -> Column:
    """Degrees of longitude that hold ``within_m`` metres on every latitude of a band and its two neighbours; at a pole, more than there are."""
    size = 2 * within_m / LAT_M
    least_cos = F.abs(F.cos(F.radians((band + 0.5) * size))) - math.radians(1.5 * size)
    return F.least(F.lit(1000.0), 1.001 * within_m / LON_M / F.greatest(least_cos, F.lit(1e-9)))


def reach_cell(lon: Column, lat: Column, within_m: float) -> Column:
    """The cell of a point where cells widen with the latitude, so that near_reach_cells misses nothing within ``within_m`` planar metres."""
    band = F.floor(lat / (2 * within_m / LAT_M))
    return F.struct(F.floor(lon / _reach_width(band, within_m)).alias("cx"), band.alias("cy"))


def near_reach_cells(lon: Column, lat: Column, within_m: float) -> Column:
    """The reach_cells that can hold points within ``within_m`` planar metres: three in each of three bands."""
    bands = F.array(*[F.floor(lat / (2 * within_m / LAT_M)) + i for i in (-1, 0, 1)])
    moves = F.array(*[F.lit(j) for j in (-1, 0, 1)])
    return F.flatten(F.transform(bands, lambda b: F.transform(moves, lambda j: F.struct((F.floor(lon / _reach_width(b, within_m)) + j).alias("cx"), b.alias("cy")))))


def rounded(line: Column, digits: int = 5) -> Column:
    """Coordinates rounded, repeated vertices collapsed."""
    r = F.transform(line, lambda p: F.struct(F.round(p["lon"], digits).alias("lon"), F.round(p["lat"], digits).alias("lat")))
    return F.filter(r, lambda p, i: (i == 0) | (p != F.get(r, i - 1)))


def undirected_key(line: Column) -> Column:
    return F.least(F.to_json(line), F.to_json(F.reverse(line)))


def within_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd ray cast of a point against a closed ring."""
    crossings = F.transform(pairs(ring), lambda s: ((s["p"]["lat"] > lat) != (s["q"]["lat"] > lat)) & (lon < (s["q"]["lon"] - s["p"]["lon"]) * (lat - s["p"]["lat"]) / F.nullif(s["q"]["lat"] - s["p"]["lat"], F.lit(0.0)) + s["p"]["lon"]))
    return F.aggregate(crossings, F.lit(0), lambda a, c: a + F.when(c, 1).otherwise(0)) % 2 == 1


def within_bounds(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    return lon.between(west, east) & lat.between(south, north)
