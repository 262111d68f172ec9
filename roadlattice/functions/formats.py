"""Text for readers: distances, durations, compass words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MILE_M, FOOT_M = 1609.344, 0.3048
COMPASS = ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")


def miles(m: Column) -> Column:
    v = m / MILE_M
    return F.concat(F.when(v >= 10, F.floor(v + 0.5).cast("string")).otherwise(F.format_string("%.1f", F.floor(v * 10 + 0.5) / 10)), F.lit(" mi"))


def feet(m: Column) -> Column:
    return F.concat((F.floor(m / FOOT_M / 10 + 0.5) * 10).cast("string"), F.lit(" ft"))


def distance(m: Column) -> Column:
    """Feet below a fifth of a mile, else miles."""
    return F.when(m < MILE_M / 5, feet(m)).otherwise(miles(m))


def duration(s: Column) -> Column:
    minutes = F.floor(s / 60 + 0.5)
    return F.when(minutes < 60, F.concat(F.greatest(minutes, F.lit(1)).cast("string"), F.lit(" min"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h "), (minutes % 60).cast("string"), F.lit(" min")))


def compass(bearing: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in COMPASS]), (F.floor(bearing / 45 + 0.5) % 8).cast("int"))


#: Fixed pattern of a highway's name.
HIGHWAY = "(?i)\\b(highway|state route|sr\\s*\\d|us\\s*(?:route\\s*)?\\d|i-?\\s*\\d)\\b"
SURFACES = ("Surface not recorded", "Paved", "Gravel", "Rough")


#: Fixed names of facilities (1 to 5) and of road classes (1 to 13).
FACILITY_NAMES = ("sharrow (no dedicated space)", "bike lane", "buffered bike lane", "separated bike lane", "shared-use path")
ROAD_CLASS_NAMES = (
    "residential street", "living street", "unclassified road", "tertiary road", "tertiary link", "secondary road", "secondary link",
    "primary road", "primary link", "trunk road", "trunk link", "motorway", "motorway link",
)


def numbered_name(names: tuple, k: Column) -> Column:
    """The name of a number counted from 1; null for others."""
    return F.when(k >= 1, F.get(F.array(*[F.lit(n) for n in names]), (k - 1).cast("int")))


def is_highway_name(name: Column) -> Column:
    return F.coalesce(name.rlike(HIGHWAY), F.lit(False))


def surface_label(surface: Column) -> Column:
    """Name of a surface class; what is none counts as not recorded."""
    table = F.array(*[F.lit(x) for x in SURFACES])
    return F.coalesce(F.when(surface >= 0, F.get(table, surface.cast("int"))), F.lit(SURFACES[0]))


def spoken_distance(m: Column) -> Column:
    """Feet to tens below a tenth of a mile, else miles to a tenth."""
    return F.when(m < MILE_M / 10, F.concat((F.floor(m / FOOT_M / 10 + 0.5) * 10).cast("string"), F.lit(" feet"))).otherwise(F.concat(F.format_string("%.1f", F.floor(m / MILE_M * 10 + 0.5) / 10), F.lit(" miles")))
