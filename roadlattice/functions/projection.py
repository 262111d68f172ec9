"""Lambert conformal conic projections of an ellipsoid with two standard parallels, both ways, as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latitude settles to under 1e-11 degrees within so many steps.
STEPS = 8
US_FOOT_M = 1200 / 3937


@dataclass(frozen=True)
class Conic:
    """Degrees for the parallels and the origin, metres for the false easting and northing and the axis; unit is a plane unit's metres."""

    parallel_1: float
    parallel_2: float
    origin_lat: float
    origin_lon: float
    false_east_m: float = 0.0
    false_north_m: float = 0.0
    unit: float = 1.0
    axis_m: float = 6378137.0
    flattening: float = 1 / 298.257222101

    @property
    def eccentricity(self) -> float:
        return math.sqrt(self.flattening * (2 - self.flattening))

    def _t(self, lat: float) -> float:
        e = self.eccentricity * math.sin(lat)
        return math.tan(math.pi / 4 - lat / 2) / ((1 - e) / (1 + e)) ** (self.eccentricity / 2)

    def _m(self, lat: float) -> float:
        return math.cos(lat) / math.sqrt(1 - (self.eccentricity * math.sin(lat)) ** 2)

    @property
    def shape(self) -> tuple[float, float, float]:
        """Cone constant, scale in metres, and the radius of the origin's parallel."""
        p, q = math.radians(self.parallel_1), math.radians(self.parallel_2)
        n = (math.log(self._m(p)) - math.log(self._m(q))) / (math.log(self._t(p)) - math.log(self._t(q))) if p != q else math.sin(p)
        scale = self.axis_m * self._m(p) / (n * self._t(p) ** n)
        return n, scale, scale * self._t(math.radians(self.origin_lat)) ** n


#: Fixed values of the state plane that road agencies of Washington publish in (south zone, US survey feet).
WASHINGTON_SOUTH = Conic(parallel_1=47 + 20 / 60, parallel_2=45 + 50 / 60, origin_lat=45 + 20 / 60, origin_lon=-120.5, false_east_m=500_000.0001016001, unit=US_FOOT_M)


def _squeeze(sin_lat: Column, e: float) -> Column:
    return F.pow((1 - e * sin_lat) / (1 + e * sin_lat), F.lit(e / 2))


def to_plane(lon: Column, lat: Column, conic: Conic = WASHINGTON_SOUTH) -> Column:
    """struct(x, y) in plane units. Null in, null out; the pole opposite the cone has no place."""
    n, scale, origin = conic.shape
    phi = F.radians(lat)
    rho = scale * F.pow(F.tan(math.pi / 4 - phi / 2) / _squeeze(F.sin(phi), conic.eccentricity), F.lit(n))
    theta = n * F.radians(lon - conic.origin_lon)
    unit = Fraction(conic.unit).limit_denominator(10_000)  # a foot is a ratio, which its double rounds
    feet = lambda m: m * unit.denominator / unit.numerator
    return F.struct(feet(conic.false_east_m + rho * F.sin(theta)).alias("x"), feet(conic.false_north_m + origin - rho * F.cos(theta)).alias("y"))


def to_lonlat(x: Column, y: Column, conic: Conic = WASHINGTON_SOUTH) -> Column:
    """struct(lon, lat) in degrees; the latitude, which the ellipsoid gives no closed form for, is iterated."""
    n, scale, origin = conic.shape
    east, south = x * conic.unit - conic.false_east_m, origin - (y * conic.unit - conic.false_north_m)
    sign = math.copysign(1.0, n)
    t = F.pow(F.sqrt(east * east + south * south) / abs(scale), F.lit(1 / n))
    theta = F.atan2(sign * east, sign * south)
    lat = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), math.pi / 2 - 2 * F.atan(t), lambda phi, _: math.pi / 2 - 2 * F.atan(t * _squeeze(F.sin(phi), conic.eccentricity)))
    return F.struct((F.degrees(theta / n) + conic.origin_lon).alias("lon"), F.degrees(lat).alias("lat"))


def line_to_lonlat(line: Column, conic: Conic = WASHINGTON_SOUTH) -> Column:
    """An array of struct(x, y) as an array of struct(lon, lat)."""
    return F.transform(line, lambda p: to_lonlat(p["x"], p["y"], conic))


def clipped_ring(ring: Column, planes: list[tuple[float, float, float]]) -> Column:
    """A ring (array of struct(lon, lat) doubles, open or closed) cut to the half-planes a * lon + b * lat <= c, one after the other; gives an open ring,
    empty if nothing is left. Convex clips only; a concave ring may come back with edges along the clip's border, its area is right all
    the same. A null ring is null."""
    halves = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(c)).alias("c")) for a, b, c in planes])

    def cut(acc: Column, h: Column) -> Column:
        over = lambda p: h["a"] * p["lon"] + h["b"] * p["lat"] - h["c"]

        def step(p: Column, i: Column) -> Column:
            q = F.get(acc, (i + 1) % F.size(acc))
            share = over(p) / (over(p) - over(q))
            meet = F.struct((p["lon"] + share * (q["lon"] - p["lon"])).alias("lon"), (p["lat"] + share * (q["lat"] - p["lat"])).alias("lat"))
            into = F.when(over(q) <= 0, F.array(q)).otherwise(F.array().cast("array<struct<lon:double,lat:double>>"))
            return F.when((over(p) <= 0) != (over(q) <= 0), F.concat(F.array(meet), into)).otherwise(into)

        return F.flatten(F.transform(acc, step))

    return F.aggregate(halves, ring, cut)


def box(west: float, south: float, east: float, north: float) -> list[tuple[float, float, float]]:
    """The half-planes of a box, for clipped_ring."""
    return [(-1, 0, -west), (1, 0, east), (0, -1, -south), (0, 1, north)]


def ring_area(ring: Column) -> Column:
    """Area of an open or closed ring in squared units of its coordinates, by the shoelace sum."""
    turn = lambda p, i: p["lon"] * F.get(ring, (i + 1) % F.size(ring))["lat"] - F.get(ring, (i + 1) % F.size(ring))["lon"] * p["lat"]
    return F.abs(F.aggregate(F.transform(ring, turn), F.lit(0.0), lambda s, v: s + v)) / 2
