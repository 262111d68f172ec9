"""What a request adds: profiles, access at its ends, pinned candidates, and estimates of splices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlattice.functions import geo

from .costs import MODES
from .portfolio import SAFETY, material

ACCESS_EDGE_M, ACCESS_REACH_M = 800, 300.0


def profiles(requests: DataFrame) -> DataFrame:
    """Twelve profiles for each request: three modes, with and without signed routes and residential streets preferred. What
    the request forces (prefer_designated, prefer_residential not null) leaves fewer."""
    grid = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(d).alias("designated"), F.lit(r).alias("residential")) for m in MODES for d in (False, True) for r in (False, True)])).alias("p")
    p = requests.select("request", "prefer_designated", "prefer_residential", grid)
    ok = (F.coalesce(F.col("prefer_designated"), F.col("p.designated")) == F.col("p.designated")) & (F.coalesce(F.col("prefer_residential"), F.col("p.residential")) == F.col("p.residential"))
    return p.where(ok).select("request", "p.*")


def safety_ranked(c: DataFrame) -> DataFrame:
    """Rank of each candidate of a request by the lexicographic safety order, then by number."""
    return c.withColumn("safety_rank", F.row_number().over(Window.partitionBy("request").orderBy(*SAFETY, "candidate")))


def prefix_sums(segments: DataFrame, columns: list[str]) -> DataFrame:
    """Running sums of each column before a segment of its route."""
    w = Window.partitionBy("route_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return segments.select("route_id", "seq", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in columns])


def splice_estimates(prefixes: DataFrame, cuts: DataFrame, columns: list[str]) -> DataFrame:
    """cuts(route_id, from_seq, to_seq) -> sums between two places, as differences of running sums."""
    a = prefixes.select("route_id", F.col("seq").alias("from_seq"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = prefixes.select("route_id", F.col("seq").alias("to_seq"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return cuts.join(a, ["route_id", "from_seq"]).join(b, ["route_id", "to_seq"]).select("route_id", "from_seq", "to_seq", *[(F.col(f"{c}_b") - F.col(f"{c}_a")).alias(c) for c in columns])


def terminal_access(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges(edge_id, len_m, freeway, lon1..lat2) exempt near a leg's end: at most 800 m, no freeway, an end within 300 m."""
    short = edges.where((F.col("len_m") <= ACCESS_EDGE_M) & ~F.col("freeway"))
    both = short.select("edge_id", F.col("lon1").alias("lon"), F.col("lat1").alias("lat")).union(short.select("edge_id", "lon2", "lat2"))
    e = ends.select("end_id", F.col("lon").alias("e_lon"), F.col("lat").alias("e_lat")).withColumn("c", F.explode(geo.near_reach_cells(F.col("e_lon"), F.col("e_lat"), ACCESS_REACH_M)))
    near = both.withColumn("c", geo.reach_cell(F.col("lon"), F.col("lat"), ACCESS_REACH_M)).join(e, "c")
    return near.where(geo.planar_m(F.col("lon"), F.col("lat"), F.col("e_lon"), F.col("e_lat")) <= ACCESS_REACH_M).select("end_id", "edge_id").distinct()


def restricted(vertices: DataFrame, restrictions: DataFrame) -> DataFrame:
    """Edges with a vertex within 0.00004 degrees of a restriction's segment, or within 0.00035 if its route number agrees."""
    size = 0.0008
    v = vertices.withColumn("c", F.explode(geo.near_cells(F.col("lon"), F.col("lat"), size)))
    r = restrictions.select("r_ref", "r_lon", "r_lat").withColumn("c", geo.cell(F.col("r_lon"), F.col("r_lat"), size))
    d = F.sqrt(F.pow(F.col("lon") - F.col("r_lon"), F.lit(2.0)) + F.pow(F.col("lat") - F.col("r_lat"), F.lit(2.0)))
    return v.join(r, "c").where((d <= 0.00004) | (d <= 0.00035) & (F.col("ref") == F.col("r_ref"))).select("edge_id").distinct()


def different(c: DataFrame, shares: DataFrame) -> DataFrame:
    """Pairs of a request's candidates that are both worth showing: they share less than 0.96, or less than 0.99 and differ in kind."""
    a, b = c.alias("a"), c.alias("b")
    s = shares.select("request", F.col("a").alias("ca"), F.col("b").alias("cb"), "share")
    j = s.join(a, (s["request"] == F.col("a.request")) & (s["ca"] == F.col("a.candidate"))).join(b, (s["request"] == F.col("b.request")) & (s["cb"] == F.col("b.candidate")))
    return j.where((F.col("share") < 0.96) | (F.col("share") < 0.99) & material()).select(s["request"], F.col("ca").alias("a"), F.col("cb").alias("b"))


def pinned(wanted: DataFrame, c: DataFrame) -> DataFrame:
    """Pinned candidates in their order, with whether each is missing now."""
    return wanted.join(c.select("request", "candidate", "time", F.lit(True).alias("there")), ["request", "candidate"], "left").select("request", "place", "candidate", "time", F.col("there").isNull().alias("missing"))


def extras(raw: DataFrame, presented: DataFrame) -> DataFrame:
    return raw.join(presented.select("request", "candidate"), ["request", "candidate"], "left_anti")


def shared_edges(routes: DataFrame) -> DataFrame:
    """(request, route, shared): for each route how many of its edges its request's first route has too."""
    sets = routes.groupBy("request", "route").agg(F.collect_set("edge_id").alias("edges"))
    first = sets.groupBy("request").agg(F.min_by("edges", "route").alias("first"))
    return sets.join(first, "request").select("request", "route", F.size(F.array_intersect("edges", "first")).alias("shared"))

