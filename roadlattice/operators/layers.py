"""Source layers: which records enter, what they carry, and how lines are gathered, matched, merged and clipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlattice.functions import geo, tags

from .sequences import islands
from .spatial import covering_cells

#: Fixed values of the sources: class codes that are roads, codes of planned ones, rural area codes, the sentinel of a rating
#: that is not known, and the years that a count may have (per source).
ROAD_CLASSES, PLANNED, RURAL, NO_RATING = (1, 7), (92, 93, 94, 95, 96), (98, 99), 999
COUNT_YEARS, SAMPLE_YEARS, STALE_BEFORE = (1930, 2035), (1980, 2035), 2010
#: Degrees within which a sample lies on a designated route, and a chunk's metres in the road layer.
ROUTE_DEG, CHUNK_M = 0.0003, 250.0
#: Grades: the greatest that is believed when stated, the shortest structure that has one, and the cap of old railways.
STATED_PCT, STRUCTURE_M, RAIL_PCT = 30.0, 80.0, 5.0
OLD_RAIL = ("abandoned", "disused", "razed", "dismantled")
FACILITY_LEVELS = {"Shared-Use Path": 5, "Sidepath": 5, "One-Way Separated Bike Lane": 4, "Two-Way Separated Bike Lane": 4, "Buffered Bike Lane": 3, "Bike Lane": 2}
OFF_STREET = ("cycleway", "path", "footway", "bridleway", "track", "service")


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def between(c: Column, limits: tuple[int, int]) -> Column:
    return F.when(c.between(*limits), c)


def counts_layer(f: DataFrame) -> DataFrame:
    """Counts of state roads: what has a count; a year out of range is unknown."""
    return f.where("aadt > 0").select("id", F.col("aadt").alias("adt"), between(F.col("year"), COUNT_YEARS).alias("year"))


def class_layer(f: DataFrame) -> DataFrame:
    """Functional classes: planned and unknown ones go; whether the agency calls the area rural."""
    return f.where(F.col("code").between(*ROAD_CLASSES) & ~F.col("code").isin(*PLANNED)).select("id", F.col("code").alias("fc"), "owner", F.coalesce(F.col("area").isin(*RURAL), F.lit(False)).alias("rural"))


def sample_layer(f: DataFrame) -> DataFrame:
    """Federal samples: what has a count; class, year, lanes and speed where they are in range."""
    return f.where("aadt > 0").select("id", F.col("aadt").alias("adt"), between(F.col("code"), ROAD_CLASSES).alias("fc"), between(F.col("year"), SAMPLE_YEARS).alias("year"), positive(F.col("lanes")).alias("lanes"), positive(F.col("speed")).alias("speed"))


def road_log_layer(f: DataFrame) -> DataFrame:
    """County road log: count and year in range, whether the count is old, edge space and widest shoulders to a tenth."""
    year = between(F.col("year"), COUNT_YEARS)
    edge = F.col("edge.space")
    return f.select(
        "id", positive(F.col("aadt")).alias("adt"), year.alias("year"), F.coalesce((F.col("aadt") > 0) & (year < STALE_BEFORE), F.lit(False)).alias("stale"),
        F.round(edge, 1).alias("edge"), F.col("edge.clamped").alias("clamped"), F.round(F.greatest("left_ft", "right_ft"), 1).alias("shoulder"),
    )


def stress_layer(f: DataFrame, restrictions: DataFrame, designated_ids: DataFrame, urban_ids: DataFrame) -> DataFrame:
    """Stress segments(id, route, begin, end, lts, speed, lanes, aadt, access): sentinels and zeros are unknown; prohibited where a
    restriction of the route overlaps their miles, designated and urban where those layers have them."""
    from .spatial import milepost_overlap

    mark = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    lo_hi = f.withColumns({"begin": F.least("begin", "end"), "end": F.greatest("begin", "end")})
    out = f.join(mark(milepost_overlap(lo_hi, restrictions), "prohibited"), "id", "left").join(mark(designated_ids, "designated"), "id", "left").join(mark(urban_ids, "urban"), "id", "left")
    sure = lambda n: F.coalesce(n, F.lit(False)).alias(n)
    return out.select("id", F.when(F.col("lts") != NO_RATING, F.col("lts")).alias("lts"), positive(F.col("speed")).alias("speed"), positive(F.col("lanes")).alias("lanes"), positive(F.col("aadt")).alias("adt"), F.col("access").isin("F", "P").alias("limited"), sure("prohibited"), sure("designated"), sure("urban"))


def infra_score() -> Column:
    """struct(score, prohibited) of a way's bicycle infrastructure, null if it has none."""
    hw, bike, cw = tags.tag("highway"), tags.tag("bicycle"), F.lower(tags.first_tag("cycleway", "cycleway:both", "cycleway:right", "cycleway:left"))
    may = F.coalesce(bike.isin("designated", "yes"), F.lit(False))
    kept = lambda n: F.struct(F.lit(n).alias("score"), F.lit(n == 4).alias("prohibited"))
    shut = tags.tag("motor_vehicle").isin("no", "private") | tags.tag("access").isin("no", "private")
    return (
        F.when((hw == "cycleway") & ~F.coalesce(bike == "no", F.lit(False)), kept(1)).when((hw == "path") & may, kept(1)).when((hw == "footway") & (bike == "designated"), kept(2)).when(hw.isin("bridleway", "track") & may, kept(2))
        .when((hw == "service") & (bike == "designated") & shut, kept(1)).when(cw.isin("track", "separate"), kept(1)).when(cw == "lane", kept(2)).when((bike == "no") & (hw.isin(*OFF_STREET) & (hw != "footway") | cw.isNotNull()), kept(4))
    )


def infra_layer(ways: DataFrame, mtb_members: DataFrame) -> DataFrame:
    """ways(way_id, tags) with infrastructure: score, whether prohibited, whether a mountain-bike way by tags or relation."""
    j = ways.join(mtb_members.select("way_id", F.lit(True).alias("member")).distinct(), "way_id", "left")
    return j.withColumn("s", infra_score()).where("s is not null").select("way_id", "s.score", "s.prohibited", tags.is_mtb(F.coalesce("member", F.lit(False))).alias("mtb"))


def sharrow_only() -> Column:
    """Shared-lane markings on a street that is not for bicycles alone."""
    cw = F.lower(tags.first_tag("cycleway", "cycleway:both", "cycleway:right", "cycleway:left"))
    return F.coalesce(cw == "shared_lane", F.lit(False)) & ~F.coalesce(tags.tag("highway").isin("cycleway", "path", "footway"), F.lit(False))


def drawn_at(zoom: Column, layer: str) -> Column:
    """Whether a layer's feature is drawn at a zoom: all from 9 on, before that off-street infrastructure alone."""
    return (zoom >= 9) | (F.coalesce(tags.tag("highway").isin(*OFF_STREET), F.lit(False)) if layer == "infra" else F.lit(layer not in ("infra", "stress")))


def route_base(route: Column) -> Column:
    """A milepost route's number without the letter of its direction."""
    return F.regexp_replace(F.coalesce(route, F.lit("")), "[idID]$", "")


def route_direction(route: Column) -> Column:
    return F.when(route.rlike("[iI]$"), "increasing mileposts").when(route.rlike("[dD]$"), "decreasing mileposts")


def facility_level(name: Column) -> Column:
    level = F.lit(None).cast("int")
    for k, v in FACILITY_LEVELS.items():
        level = F.when(name == k, v).otherwise(level)
    return level


def first_of(df: DataFrame, keys: list[str | Column], order: str) -> DataFrame:
    """The first row of each key."""
    named = [F.col(k).alias(f"__k{i}") if isinstance(k, str) else k.alias(f"__k{i}") for i, k in enumerate(keys)]
    return df.select(*named, F.struct(*df.columns).alias("r")).groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.min_by("r", f"r.{order}").alias("r")).select("r.*")


def way_lines(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """refs(way_id, pos, node), nodes(node, lon, lat) -> (way_id, line): lines of the nodes that are known, of two at least."""
    points = refs.join(nodes.select("node", "lon", "lat"), "node")
    lines = points.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p"))
    return lines.where(F.size("p") >= 2).select("way_id", F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("line"))


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the coordinates and elevations of both ends."""
    for end, i in (("a", 1), ("b", 2)):
        edges = edges.join(nodes.select(F.col("node").alias(end), F.col("lon").alias(f"lon{i}"), F.col("lat").alias(f"lat{i}"), F.col("ele").alias(f"ele{i}")), end)
    return edges


def boxed(ways: DataFrame, segments: DataFrame, degrees: float) -> DataFrame:
    """Ways whose box lies within ``degrees`` of a segment's box: those that a matcher has to look at. A semi-join on cells of
    the boxes, then the boxes themselves."""
    size = max(degrees * 4, 0.004)

    def box(df, p):
        lo = lambda n: F.least(f"{p}{n}1", f"{p}{n}2")
        hi = lambda n: F.greatest(f"{p}{n}1", f"{p}{n}2")
        return {"x0": lo("lon"), "x1": hi("lon"), "y0": lo("lat"), "y1": hi("lat")}

    span = lambda a, b: F.sequence(F.floor(a / size).cast("long"), F.floor(b / size).cast("long"))
    cells = lambda b, pad: F.explode(F.flatten(F.transform(span(b["x0"] - pad, b["x1"] + pad), lambda x: F.transform(span(b["y0"] - pad, b["y1"] + pad), lambda y: F.struct(x.alias("cx"), y.alias("cy"))))))
    w, s = box(ways, ""), box(segments, "s_")
    left = ways.withColumns({f"w_{k}": v for k, v in w.items()}).withColumn("c", cells(w, 0.0))
    right = segments.select(cells(s, degrees).alias("s_c"), *[v.alias(f"s_{k}") for k, v in s.items()])
    touch = (F.col("w_x0") <= F.col("s_x1") + degrees) & (F.col("w_x1") >= F.col("s_x0") - degrees) & (F.col("w_y0") <= F.col("s_y1") + degrees) & (F.col("w_y1") >= F.col("s_y0") - degrees)
    hits = left.join(right, (F.col("c") == F.col("s_c")) & touch, "left_semi").select("way_id").distinct()
    return ways.join(hits, "way_id", "left_semi")


def on_route(lines: DataFrame, segments: DataFrame, degrees: float = ROUTE_DEG) -> DataFrame:
    """lines(id, line): those of which two of three samples (the vertices at a fourth, a half and three fourths) lie within ``degrees`` of a
    designated route's segment(lon1, lat1, lon2, lat2): (id, hits)."""
    size = degrees * 4
    at = F.explode(F.sequence(F.lit(1), F.lit(3)))
    s = lines.select("id", "line", at.alias("k")).select("id", "k", F.get("line", F.floor(F.size("line") * F.col("k") / 4).cast("int")).alias("p")).select("id", "k", "p.lon", "p.lat")
    s = s.withColumn("c", F.explode(geo.near_cells(F.col("lon"), F.col("lat"), size)))
    g = segments.withColumn("c", F.explode(covering_cells(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"), size)))
    g = g.select("c", *[F.col(n).alias(f"g_{n}") for n in ("lon1", "lat1", "lon2", "lat2")])
    near = s.join(g, "c").where(degree_distance(F.col("lon"), F.col("lat"), F.col("g_lon1"), F.col("g_lat1"), F.col("g_lon2"), F.col("g_lat2")) < degrees)
    return near.groupBy("id").agg(F.count_distinct("k").alias("hits")).where("hits >= 2")


def degree_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance from a point to a segment, in plain degrees."""
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((x - ax) * dx + (y - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
    return F.sqrt(F.pow(x - ax - t * dx, F.lit(2.0)) + F.pow(y - ay - t * dy, F.lit(2.0)))


def segment_cells(lines: DataFrame, size: float, degrees: float) -> DataFrame:
    """lines(line_id, ref, line) -> (line_id, ref, lon1..lat2, c): each segment with the cells that its box, wider by ``degrees``, covers."""
    seg = lines.select("line_id", "ref", F.explode(geo.pairs(F.col("line"))).alias("s")).select("line_id", "ref", *[F.col(f"s.{e}.{n}").cast("double").alias(f"{n}{i}") for i, e in ((1, "p"), (2, "q")) for n in ("lon", "lat")])
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - degrees) / size).cast("long"), F.floor((F.greatest(a, b) + degrees) / size).cast("long"))
    xs, ys = span(F.col("lon1"), F.col("lon2")), span(F.col("lat1"), F.col("lat2"))
    return seg.withColumn("c", F.explode(F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))))


def nearest_allowed(points: DataFrame, cells: DataFrame, size: float, near: float, strict: float) -> DataFrame:
    """points(id, ref, lon, lat) -> (id, line_id, degrees): the nearest line within ``strict`` degrees, or within ``near`` if its route
    number agrees."""
    p = points.withColumn("c", F.struct(F.floor(F.col("lon") / size).cast("long").alias("cx"), F.floor(F.col("lat") / size).cast("long").alias("cy")))
    g = cells.select("c", "line_id", F.col("ref").alias("g_ref"), *[F.col(n).alias(f"g_{n}") for n in ("lon1", "lat1", "lon2", "lat2")])
    d = F.round(degree_distance(F.col("lon"), F.col("lat"), F.col("g_lon1"), F.col("g_lat1"), F.col("g_lon2"), F.col("g_lat2")), 7)
    hit = p.join(g, "c").withColumn("d", d).where((F.col("d") <= strict) | (F.col("d") <= near) & (F.col("ref") == F.col("g_ref")))
    return hit.groupBy("id").agg(F.min(F.struct("d", "line_id")).alias("b")).select("id", "b.line_id", F.col("b.d").alias("degrees"))


def credited(matches: DataFrame, ways: DataFrame, samples: int = 5) -> DataFrame:
    """(layer, matched, metres): ways that a layer's segments match and the metres they are credited with, the covered share of each."""
    j = matches.join(ways.select("way_id", "metres"), "way_id")
    return j.groupBy("layer").agg(F.count("*").alias("matched"), F.sum(F.col("metres") * F.col("union_covered") / samples).alias("metres"))


def chunked(vertices: DataFrame, most_m: float = CHUNK_M) -> DataFrame:
    """vertices(way_id, pos, m), m the metres to the next one -> (way_id, pos, chunk): segments in chunks that end with the first
    segment that brings them to ``most_m``."""
    per_way = vertices.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("s"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0.0).alias("run"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        full = acc["run"] + s["m"] >= most_m
        return F.struct((acc["chunk"] + F.when(full, 1).otherwise(0)).alias("chunk"), F.when(full, 0.0).otherwise(acc["run"] + s["m"]).alias("run"), F.concat(acc["out"], F.array(acc["chunk"])).alias("out"))

    placed = per_way.select("way_id", F.explode(F.arrays_zip("s", F.aggregate("s", start, step, lambda a: a["out"]).alias("chunk"))).alias("z"))
    return placed.select("way_id", "z.s.pos", "z.s.m", "z.chunk")


def coalesced(runs: DataFrame, values: list[str]) -> DataFrame:
    """runs(way_id, run, ...values, metres): neighbours of equal values are one."""
    marked = islands(runs, F.struct(*values), "joined", keys=["way_id"], order=["run"])
    return marked.groupBy("way_id", "joined", *values).agg(F.min("run").alias("first_run"), F.count("*").alias("runs"), F.sum("metres").alias("metres"))


def merged_properties(p: DataFrame) -> DataFrame:
    """A road feature's properties from its own tags, the agency's match (a_*) and the measures (m_*): own speeds and shoulders win unless
    the speed is an estimate; limited access counts only without a lane."""
    wins = F.when(F.col("estimated") & (F.col("a_speed") > 0), F.col("a_speed")).otherwise(F.col("speed"))
    fills = F.coalesce("shoulder", "a_shoulder")
    better = F.when(F.col("shoulder").isNull() & (F.col("a_shoulder_max") != F.col("a_shoulder")), F.col("a_shoulder_max"))
    limited = F.coalesce(F.col("a_limited"), F.lit(False)) & (F.coalesce("facility", F.lit(0)) < 2)
    return p.select("id", wins.alias("speed"), (F.col("estimated") & ~F.coalesce(F.col("a_speed") > 0, F.lit(False))).alias("estimated"), fills.alias("shoulder"), (F.col("shoulder").isNull() & F.col("a_shoulder").isNotNull()).alias("from_agency"), better.alias("better_side"), limited.alias("limited"), F.coalesce(positive(F.col("lanes")), positive(F.col("a_lanes"))).alias("lanes"), positive(F.col("m_adt")).alias("adt"))


def clipped(segments: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """segments(line_id, pos, lon1, lat1, lon2, lat2) -> the parts inside the bounds: (line_id, part, pos, lon1, lat1, lon2, lat2).

    Each segment is cut by the four sides (the shares at which it enters and leaves); those that follow each other without a gap are one part.
    """
    dx, dy = F.col("lon2") - F.col("lon1"), F.col("lat2") - F.col("lat1")
    sides = [(-dx, F.col("lon1") - west), (dx, east - F.col("lon1")), (-dy, F.col("lat1") - south), (dy, north - F.col("lat1"))]
    enter, leave, out = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q in sides:
        enter = F.greatest(enter, F.when(p < 0, q / p).otherwise(0.0))
        leave = F.least(leave, F.when(p > 0, q / p).otherwise(1.0))
        out = out | (p == 0) & (q < 0)
    inside = segments.withColumns({"t0": enter, "t1": leave, "out": out}).where(~F.col("out") & (F.col("t0") < F.col("t1")))
    cut = inside.select("line_id", "pos", "t0", "t1", (F.col("lon1") + F.col("t0") * dx).alias("x1"), (F.col("lat1") + F.col("t0") * dy).alias("y1"), (F.col("lon1") + F.col("t1") * dx).alias("x2"), (F.col("lat1") + F.col("t1") * dy).alias("y2"))
    w = Window.partitionBy("line_id").orderBy("pos")
    joins = (F.lag("pos").over(w) == F.col("pos") - 1) & (F.lag("t1").over(w) == 1.0) & (F.col("t0") == 0.0)
    begun = cut.withColumn("begin", (~F.coalesce(joins, F.lit(False))).cast("int"))
    return begun.select("line_id", (F.sum("begin").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("part"), "pos", F.col("x1").alias("lon1"), F.col("y1").alias("lat1"), F.col("x2").alias("lon2"), F.col("y2").alias("lat2"))


def edge_grade(length_m: Column, way_m: Column, way_rise: Column, up: Column, down: Column, ferry: Column, backward: Column) -> Column:
    """struct(up, down) of an edge of a way (``tags``): none on ferries; a stated incline, signed along the way; on a bridge or in a
    tunnel its share of the rise between the whole way's ends (none if that is short); what the ground says, capped on old railways."""
    said = F.regexp_extract(F.coalesce(tags.tag("incline"), F.lit("")), "^\\s*([+-]?[0-9]+(?:\\.[0-9]+)?)\\s*%\\s*$", 1).try_cast("double")
    stated = F.when(F.abs(said) <= STATED_PCT, said) * F.when(backward, -1).otherwise(1)
    on = lambda k: F.coalesce(tags.tag(k) != "no", F.lit(False))
    delta = F.when(way_m >= STRUCTURE_M, way_rise * length_m / way_m).otherwise(0.0)
    built = on("bridge") | on("tunnel")
    u, d = (F.when(built, F.greatest(F.lit(0.0), s * delta)).otherwise(g) for s, g in ((1, up), (-1, down)))
    rail, cap = F.coalesce(tags.tag("railway").isin(*OLD_RAIL), F.lit(False)), length_m * RAIL_PCT / 100
    u, d = (F.when(rail, F.least(x, cap)).otherwise(x) for x in (u, d))
    rise = length_m * stated / 100
    pick = lambda s, x: F.when(ferry, 0.0).when(stated.isNotNull(), F.greatest(F.lit(0.0), s * rise)).otherwise(x)
    return F.struct(pick(1, u).alias("up"), pick(-1, d).alias("down"))


def snap_flags(edges: DataFrame) -> DataFrame:
    """(node, local, plain): whether a node touches an edge that may be ridden and is no freeway or ferry, and one that is no
    mountain-bike path besides."""
    ok = ~F.col("prohibited") & ~F.col("freeway") & ~F.col("ferry")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), ok.alias("ok"), (ok & ~F.col("mtb")).alias("plain"))
    return ends.groupBy("node").agg(F.bool_or("ok").alias("local"), F.bool_or("plain").alias("plain"))


def end_bearings(line: Column) -> Column:
    """struct(first, last): bearings out of a line's ends, to the nearest vertex that is another point."""
    def out(points: Column) -> Column:
        p = F.get(points, F.lit(0))
        others = F.filter(points, lambda q: (q["lon"] != p["lon"]) | (q["lat"] != p["lat"]))
        q = F.get(others, F.lit(0))
        return F.coalesce(geo.bearing(p["lon"], p["lat"], q["lon"], q["lat"]), F.lit(0.0))

    return F.struct(out(line).alias("first"), out(F.reverse(line)).alias("last"))


def bearing_near(line: Column, lon: Column, lat: Column) -> Column:
    """Planar bearing of the segment of a line that lies nearest to a point (the first of equal ones)."""
    steps = F.transform(geo.pairs(line), lambda s, i: F.struct(F.round(geo.point_segment_m(lon, lat, s["p"]["lon"], s["p"]["lat"], s["q"]["lon"], s["q"]["lat"]), 6).alias("m"), i.alias("i"), geo.planar_bearing(s["p"]["lon"], s["p"]["lat"], s["q"]["lon"], s["q"]["lat"]).alias("b")))
    return F.array_min(steps)["b"]


def fastest_ferry_mps(edges: DataFrame) -> DataFrame:
    """One row: the greatest speed of a ferry edge, of 3 mph at least, in metres a second (0 without ferries)."""
    return edges.where("ferry").agg(F.coalesce(F.max(F.greatest("mph", F.lit(3)) * 0.44704), F.lit(0.0)).alias("mps"))


def official_layers(f: DataFrame) -> DataFrame:
    """(id, limit_mph, facility): legal speeds where there is one, and facilities of the vocabulary."""
    speeds = f.where("speed > 0").select("id", F.col("speed").alias("limit_mph"), F.lit(None).cast("long").alias("facility"))
    level = facility_level(F.col("facility_name")).cast("long")
    return speeds.union(f.where(level.isNotNull()).select("id", F.lit(None).cast("long"), level))
