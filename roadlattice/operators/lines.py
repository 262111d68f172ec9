"""Operators on whole lines: splitting, densifying, climbs, curves, simplification."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from roadlattice.functions import geo

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def split_at_junctions(refs: DataFrame, keep_all: Column | None = None) -> DataFrame:
    """refs(way_id, pos, node) -> runs between junctions: (way_id, run, from_node, to_node, vertices).

    A node is a junction if two ways or two places of one use it, or at a way's ends. A junction in the middle ends one
    run and begins the next.
    """
    w = Window.partitionBy("way_id").orderBy("pos")
    uses = refs.groupBy("node").agg((F.count("*") >= 2).alias("shared"))
    j = refs.join(uses, "node")
    cut = F.col("shared") | keep_all if keep_all is not None else F.col("shared")
    ends = Window.partitionBy("way_id")
    marked = j.withColumn("inner", cut & (F.col("pos") > F.min("pos").over(ends)) & (F.col("pos") < F.max("pos").over(ends)))
    before = F.coalesce(F.sum(F.col("inner").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = marked.withColumn("run", before)
    both = runs.select("way_id", "run", "pos", "node").union(runs.where("inner").select("way_id", F.col("run") + 1, "pos", "node"))
    return both.groupBy("way_id", "run").agg(F.min_by("node", "pos").alias("from_node"), F.max_by("node", "pos").alias("to_node"), F.count("*").alias("vertices"))


def densified(vertices: DataFrame, every_m: float = 120.0) -> DataFrame:
    """vertices(way_id, pos, lon, lat) -> (way_id, seq, lon, lat, added): the vertices, and a point at every ``every_m`` metres of the way.

    The distance is carried over from segment to segment, so many short ones get points too; a point that falls on
    a vertex is added behind it, and none at the way's end.
    """
    w = Window.partitionBy("way_id").orderBy("pos")
    seg = vertices.select("*", F.lead("lon").over(w).alias("lon2"), F.lead("lat").over(w).alias("lat2"))
    m = F.when(F.col("lon2").isNotNull(), F.round(geo.haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 6)).otherwise(0.0)
    seg = seg.withColumn("m", m).withColumn("e", F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("s", F.col("e") - F.col("m"))
    first = F.greatest(F.lit(1), F.ceil(F.round(F.col("s") / every_m, 9))).cast("long")
    last = (F.ceil(F.round(F.col("e") / every_m, 9)) - 1).cast("long")
    inner = F.when((F.col("m") > 0) & (last >= first), F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
    share = lambda k: F.greatest(F.lit(0.0), (k * every_m - F.col("s")) / F.col("m"))
    added = F.transform(inner, lambda k: F.struct(k.alias("k"), (F.col("lon") + share(k) * (F.col("lon2") - F.col("lon"))).alias("lon"), (F.col("lat") + share(k) * (F.col("lat2") - F.col("lat"))).alias("lat"), F.lit(True).alias("added")))
    own = F.array(F.struct(F.lit(0).cast("long").alias("k"), "lon", "lat", F.lit(False).alias("added")))
    points = seg.select("way_id", "pos", F.explode(F.concat(own, added)).alias("p"))
    place = F.row_number().over(Window.partitionBy("way_id").orderBy("pos", "p.k"))
    return points.select("way_id", place.alias("seq"), "p.lon", "p.lat", "p.added")


def climbs(elevations: Column, deadband: int = 2) -> Column:
    """struct(up_m, down_m) of an array of elevations: changes under the deadband wait until they add up to it."""
    start = F.struct(F.get(elevations, F.lit(0)).cast("double").alias("at"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down")).cast("struct<at:double,up:double,down:double>")

    def step(acc: Column, e: Column) -> Column:
        d = e.cast("double") - acc["at"]
        big = F.abs(d) >= deadband
        return F.struct(F.when(big, e.cast("double")).otherwise(acc["at"]).alias("at"), (acc["up"] + F.when(big & (d > 0), d).otherwise(0.0)).alias("up"), (acc["down"] + F.when(big & (d < 0), -d).otherwise(0.0)).alias("down"))

    return F.aggregate(elevations, start, step, lambda a: F.struct(a["up"].cast("long").alias("up_m"), a["down"].cast("long").alias("down_m")))


_POINTS = ArrayType(StructType([StructField("lon", DoubleType()), StructField("lat", DoubleType())]))


def _kept(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Vertices that Douglas-Peucker keeps; a closed ring keeps its farthest vertex too."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        n = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / n, 0, 1) if n else np.zeros(len(px))
        d = np.hypot(px - t * dx, py - t * dy)
        i = int(np.argmax(d))
        if d[i] > tolerance:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return keep


def simplify(tolerance: float = 0.00005):
    """Vectorised UDF: a line without the vertices nearer than the tolerance to it. Of a small shape at most an eighth of its
    extent is given up, so rings stay rings."""

    @F.pandas_udf(_POINTS)
    def run(lines: pd.Series) -> pd.Series:
        out = []
        for line in lines:
            pts = [] if line is None else [(p["lon"], p["lat"]) for p in line]
            if len(pts) > 2:
                x, y = np.array(pts).T
                extent = max(np.ptp(x), np.ptp(y))
                pts = [p for p, k in zip(pts, _kept(x, y, min(tolerance, extent / 8))) if k]
            out.append([{"lon": a, "lat": b} for a, b in pts])
        return pd.Series(out)

    return run


#: Fixed values of the curve rule: speed from which it holds, facility from which not, metres looked at on each side and in
#: all, turn and grade of the three severities, and the speeds and shoulders that move it.
CURVE_MPH, CURVE_FACILITY, CURVE_SIDE_M, CURVE_LEAST_M = 30, 2, 35.0, 30.0
CURVE_TURN, CURVE_GRADE = (30.0, 50.0, 75.0), (0.03, 0.05, 0.055)
FAST_MPH, BRISK_MPH, WIDE_FT, NARROW_FT = 45, 40, 4, 1


def _one_way_hazard(lon: np.ndarray, lat: np.ndarray, ele: np.ndarray, mph: float, shoulder: float | None) -> tuple[int, int, int]:
    """Severity 0 to 3 and vertex range of the worst uphill bend along the line, in its direction."""
    n = len(lon)
    a, b = np.radians(lat[:-1]), np.radians(lat[1:])
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(np.diff(lon)) / 2) ** 2
    at = np.concatenate([[0.0], np.cumsum(2 * geo.EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, h))))])
    if at[-1] < CURVE_SIDE_M:
        return 0, 0, 0
    heading = np.degrees(np.arctan2(np.diff(lon) * np.cos((a + b) / 2), np.diff(lat)))
    turned = np.concatenate([[0.0, 0.0], np.cumsum(np.abs((np.diff(heading) + 180) % 360 - 180))])  # before vertex i
    moved = (mph >= FAST_MPH) + (-1 if shoulder is None else -2 if shoulder >= WIDE_FT else int(shoulder <= NARROW_FT and mph >= BRISK_MPH))
    worst = (0, 0, 0)
    for i in range(1, n - 1):
        lo = max(0, int(np.searchsorted(at, at[i] - CURVE_SIDE_M, "right")) - 1)
        hi = min(n - 1, int(np.searchsorted(at, at[i] + CURVE_SIDE_M, "left")))
        metres = at[hi] - at[lo]
        if metres < CURVE_LEAST_M:
            continue
        turn, grade = turned[min(n - 1, hi)] - turned[lo + 1], (ele[hi] - ele[lo]) / metres
        if turn < CURVE_TURN[0] or grade < CURVE_GRADE[0]:
            continue
        level = 3 if turn >= CURVE_TURN[2] and grade >= CURVE_GRADE[2] else 2 if turn >= CURVE_TURN[1] or grade >= CURVE_GRADE[1] else 1
        level = max(0, min(3, level + moved))
        if level > worst[0]:
            worst = (level, lo, hi)
    return worst


def curve_hazard():
    """Vectorised UDF of (line, elevations, mph, shoulder, facility): struct(ab, ba, ab_first, ab_last, ba_first, ba_last), the severity 0
    to 3 of the worst climbing bend in each direction and its vertices. Only where traffic is fast and there is no lane.
    A shoulder that is not known (null) lowers it less than a wide one."""

    @F.pandas_udf("ab int, ba int, ab_first int, ab_last int, ba_first int, ba_last int")
    def run(lines: pd.Series, elevations: pd.Series, mph: pd.Series, shoulder: pd.Series, facility: pd.Series) -> pd.DataFrame:
        out = []
        for line, ele, v, sh, f in zip(lines, elevations, mph, shoulder, facility):
            if line is None or len(line) < 3 or v is None or not v >= CURVE_MPH or f is not None and f >= CURVE_FACILITY:
                out.append((0,) * 6)
                continue
            lon, lat = np.array([(p["lon"], p["lat"]) for p in line], float).T
            z, sh, n = np.asarray(ele, float), None if sh is None or sh != sh else sh, len(line)
            ab, ba = _one_way_hazard(lon, lat, z, v, sh), _one_way_hazard(lon[::-1], lat[::-1], z[::-1], v, sh)
            out.append((ab[0], ba[0], ab[1], ab[2], *((n - 1 - ba[2], n - 1 - ba[1]) if ba[0] else (0, 0))))
        return pd.DataFrame(out, columns=["ab", "ba", "ab_first", "ab_last", "ba_first", "ba_last"])

    return run
