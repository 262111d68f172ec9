"""Parsing and classification of map tags; ``tags`` is a map column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed vocabularies.
DRIVE = ["motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link"]
PATHS = ["cycleway", "path", "track", "footway", "pedestrian", "bridleway"]
PAVED = ["paved", "asphalt", "concrete", "paving_stones", "chipseal"]
GRAVEL = ["gravel", "fine_gravel", "compacted", "unpaved", "pebblestone"]
ROUGH = ["dirt", "ground", "earth", "grass", "sand", "mud", "rock", "cobblestone"]
DEFAULT_MPH = {"motorway": 65, "motorway_link": 45, "trunk": 55, "trunk_link": 40, "primary": 50, "primary_link": 35, "secondary": 45, "secondary_link": 35, "tertiary": 35, "tertiary_link": 30, "unclassified": 35, "residential": 25, "living_street": 15}
FERRY_MPH = 15


def tag(name: str) -> Column:
    return F.nullif(F.trim(F.col("tags")[name]), F.lit(""))


def first_tag(*names: str) -> Column:
    return F.coalesce(*[tag(n) for n in names])


def mph(text: Column) -> Column:
    """Whole mph of a speed text: plain numbers are km/h, 'mph' and 'knots' say so; rounded half to even."""
    n = F.regexp_extract(text, "^\\s*([0-9]+(?:\\.[0-9]+)?)", 1).try_cast("double")
    return F.bround(F.when(text.rlike("mph"), n).when(text.rlike("knots"), n * 1.15078).otherwise(n * 0.621371), 0).cast("int")


def duration_s(text: Column) -> Column:
    """Seconds of 'MM', 'HH:MM' or 'HH:MM:SS'."""
    p = F.split(text, ":")
    part = lambda i: F.get(p, F.lit(i)).try_cast("int")
    return F.when(F.size(p) == 1, part(0) * 60).when(F.size(p) == 2, part(0) * 3600 + part(1) * 60).when(F.size(p) == 3, part(0) * 3600 + part(1) * 60 + part(2))


def ferry_mph(length_m: Column, text: Column) -> Column:
    """Speed that a crossing's duration gives, if it is 3 to 45 mph; else the default."""
    v = length_m / F.nullif(duration_s(text), F.lit(0)) / 0.44704
    return F.when(v.between(3, 45), v).otherwise(F.lit(float(FERRY_MPH)))


def shoulder_ft(text: Column) -> Column:
    """Feet of a width text: feet and inches, else metres; at most 40."""
    n = F.regexp_extract(text, "([0-9]+(?:\\.[0-9]+)?)", 1).try_cast("double")
    return F.least(F.lit(40), F.bround(F.when(text.rlike("ft|'"), n).otherwise(n / 0.3048), 0).cast("int"))


def incline_pct(text: Column) -> Column:
    """Per cent of '7%', '-5 %' or '4°'; up and down give no number."""
    n = F.regexp_extract(text, "(-?[0-9]+(?:\\.[0-9]+)?)", 1).try_cast("double")
    return F.when(text.rlike("°"), F.tan(F.radians(n)) * 100).when(text.rlike("%"), n)


def route_numbers(text: Column) -> Column:
    """Sorted distinct route numbers of a reference text."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), 1), lambda x: x.cast("int"))))


def surface_class() -> Column:
    s = F.lower(tag("surface"))
    return F.when(s.isin(PAVED), 1).when(s.isin(GRAVEL), 2).when(s.isin(ROUGH), 3).otherwise(0)


def facility_class() -> Column:
    """0 none, 1 shared, 2 lane, 3 buffered lane, 4 separated, 5 path."""
    c = F.lower(first_tag("cycleway", "cycleway:both", "cycleway:right", "cycleway:left"))
    return (
        F.when((tag("highway") == "cycleway") | (tag("highway").isin("path", "footway") & tag("bicycle").isin("designated", "yes")), 5)
        .when(c.isin("track", "separate"), 4).when((c == "lane") & (tag("cycleway:buffer").isNotNull()), 3).when(c == "lane", 2).when(c.isin("shared_lane", "share_busway", "shared"), 1).otherwise(0)
    )


def sidewalk_class() -> Column:
    s = F.lower(first_tag("sidewalk", "sidewalk:both"))
    return F.when(s.isin("both", "left", "right", "yes", "separate"), "present").when(s.isin("no", "none"), "absent")


def one_way() -> Column:
    """1 with the line, -1 against it, 0 both; bicycles may be exempt."""
    o = F.lower(tag("oneway"))
    d = F.when(o.isin("yes", "1", "true") | (tag("junction") == "roundabout"), 1).when(o.isin("-1", "reverse"), -1).otherwise(0)
    return F.when(F.lower(tag("oneway:bicycle")) == "no", 0).otherwise(F.coalesce(d, F.lit(0)))


def lanes() -> Column:
    """Lane count: the total, else both directions and the centre lane added."""
    n = lambda k: tag(k).try_cast("int")
    parts = F.coalesce(n("lanes:forward"), F.lit(0)) + F.coalesce(n("lanes:backward"), F.lit(0)) + F.coalesce(n("lanes:both_ways"), F.lit(0))
    return F.least(F.lit(63), F.coalesce(n("lanes"), F.nullif(parts, F.lit(0)), F.lit(0)))


def default_mph() -> Column:
    return reduce(lambda rest, k: F.when(tag("highway") == k, DEFAULT_MPH[k]).otherwise(rest), DEFAULT_MPH, F.lit(None).cast("int"))


def is_mtb(members: Column | None = None) -> Column:
    keyed = F.exists(F.map_keys("tags"), lambda k: (k == "mtb") | k.startswith("mtb:"))
    return keyed | members if members is not None else keyed


def admitted() -> Column:
    """Whether a way may enter the network, and as what: ferry, infra, drive, walk-link; null if not."""
    closed = tag("access").isin("no", "private") & ~F.coalesce(tag("bicycle").isin("yes", "designated", "permissive"), F.lit(False))
    return (
        F.when(F.coalesce(closed, F.lit(False)), None).when(F.coalesce(tag("bicycle") == "no", F.lit(False)) & ~F.coalesce(tag("highway").isin("footway", "pedestrian"), F.lit(False)), None)
        .when(tag("route") == "ferry", "ferry").when(facility_class() == 5, "infra").when(tag("highway").isin(DRIVE), "drive").when(tag("highway").isin(PATHS), "walk-link")
    )


def closure_reason() -> Column:
    return F.when(tag("highway").isin("construction", "proposed"), "construction").when(tag("access").isin("no", "private"), "closed to the public").when(tag("bicycle") == "no", "no bicycles").when(tag("seasonal").isNotNull() | tag("conditional").isNotNull(), "seasonal")


def land_kind() -> Column:
    return F.when(tag("natural").isin("water", "bay"), "water").when(tag("natural").isin("wood"), "forest").when(tag("landuse").isin("forest"), "forest").when(tag("leisure").isin("park", "garden"), "park")


def place_zoom() -> Column:
    """Least zoom of a place name by kind and population."""
    pop = F.coalesce(F.col("population"), F.lit(0))
    return F.when(F.col("kind") == "city", F.when(pop >= 200000, 4).when(pop >= 50000, 6).otherwise(7)).when(F.col("kind") == "town", F.when(pop >= 10000, 8).otherwise(9)).when(F.col("kind") == "village", 11).otherwise(12)
