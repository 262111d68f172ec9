"""Queries of the spatial joins, over the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlattice.functions import geo
from roadlattice.operators import spatial as S
from roadlattice.sources.adapters import read, view

from .registry import query

#: Planar metres in SQL, for the oracles.
PLANE = "sqrt(pow(({0} - {2}) * 111320.0 * cos(radians({1})), 2) + pow(({1} - {3}) * 110540.0, 2))"
WAYS = """WAYS AS (SELECT e.edge_id AS way_id, e.dir, e.p, e.name, e.a, e.b, x.lon AS lon1, x.lat AS lat1, y.lon AS lon2, y.lat AS lat2 FROM grid_edges e JOIN grid_nodes x ON x.node = e.a JOIN grid_nodes y ON y.node = e.b)"""
SEGS = """SEGS AS (SELECT m.seg_id, m.adt, m.year, m.source, x.lon AS s_lon1, x.lat + m.north_m / CAST(110540 AS DOUBLE) AS s_lat1, y.lon AS s_lon2, y.lat + m.north_m / CAST(110540 AS DOUBLE) AS s_lat2 FROM measure_segments m JOIN grid_nodes x ON x.node = m.a JOIN grid_nodes y ON y.node = m.b)"""


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = view(spark, sf_dir, "grid_edges"), view(spark, sf_dir, "grid_nodes")
    ends = {i: n.select(F.col("node").alias(k), F.col("lon").alias(f"lon{i}"), F.col("lat").alias(f"lat{i}")) for i, k in ((1, "a"), (2, "b"))}
    return e.join(ends[1], "a").join(ends[2], "b").withColumn("way_id", F.col("edge_id"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, n = view(spark, sf_dir, "measure_segments"), view(spark, sf_dir, "grid_nodes")
    for i, k in ((1, "a"), (2, "b")):
        m = m.join(n.select(F.col("node").alias(k), F.col("lon").alias(f"s_lon{i}"), (F.col("lat")).alias(f"s_lat{i}")), k)
        m = m.withColumn(f"s_lat{i}", F.col(f"s_lat{i}") + F.col("north_m") / 110540.0)
    return m


@query(f"""WITH {WAYS}, {SEGS}, H AS (SELECT w.way_id, s.seg_id FROM WAYS w JOIN SEGS s ON w.dir = 0 AND w.p = s.seg_id AND abs((s.s_lat1 - w.lat1) * 110540.0) <= 18)
SELECT way_id, seg_id, CAST(5 AS BIGINT) AS covered, CAST(5 AS BIGINT) AS union_covered FROM H""")
def span_bearing_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """East edges and the segments shifted 0 to 24 m north of them; north edges cross them and never match."""
    return S.span_match(ways(spark, sf_dir), segments(spark, sf_dir))


@query("""SELECT k AS key, adt, year, source FROM (SELECT seg_id % 50 AS k, *, row_number() OVER (PARTITION BY seg_id % 50 ORDER BY coalesce(year, 0) DESC, CASE WHEN source <> 3 THEN 1 ELSE 0 END DESC, seg_id) AS r FROM measure_segments WHERE adt IS NOT NULL) WHERE r = 1""")
def best_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "measure_segments").withColumn("key", F.col("seg_id") % 50).withColumn("seen", F.col("seg_id"))
    return S.best_count(m, "key")


@query("""WITH S AS (SELECT o_orderkey AS seg, o_custkey % 30 AS route, o_orderkey % 1000 AS b, o_orderkey % 1000 + o_custkey % 7 AS e FROM orders), R AS (SELECT c_custkey % 30 AS route, c_custkey * 7 % 1000 AS b, c_custkey * 7 % 1000 + 3 AS e FROM customer)
SELECT seg FROM S WHERE EXISTS (SELECT 1 FROM R WHERE R.route = S.route AND S.b < R.e AND S.e > R.b)""")
def milepost_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seg"), (F.col("o_custkey") % 30).alias("route"), (F.col("o_orderkey") % 1000).alias("begin"), (F.col("o_orderkey") % 1000 + F.col("o_custkey") % 7).alias("end"))
    r = read(spark, sf_dir, "customer").select((F.col("c_custkey") % 30).alias("route"), (F.col("c_custkey") * 7 % 1000).alias("begin"), (F.col("c_custkey") * 7 % 1000 + 3).alias("end"))
    return S.milepost_overlap(s, r).select("seg")


POINTS = "POINTS AS (SELECT c_custkey AS point_id, -122.5 + 0.0001 * (c_custkey * 7 % 780) AS lon, 47.3 + 0.0001 * (c_custkey * 11 % 730) AS lat FROM customer)"
HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({3} - {1}) / 2), 2) + cos(radians({1})) * cos(radians({3})) * pow(sin(radians({2} - {0}) / 2), 2))))"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), F.expr("CAST(-122.5 + 0.0001 * (c_custkey * 7 % 780) AS DOUBLE)").alias("lon"), F.expr("CAST(47.3 + 0.0001 * (c_custkey * 11 % 730) AS DOUBLE)").alias("lat"))


@query(f"""WITH {POINTS}, D AS (SELECT point_id, node, node % 3 = 0 AS local, round({HAV.format('CAST(p.lon AS DOUBLE)', 'CAST(p.lat AS DOUBLE)', 'n.lon', 'n.lat')}, 3) AS m FROM POINTS p, grid_nodes n),
B AS (SELECT point_id, min(m) AS nm, arg_min(node, (m, node)) AS nn, min(CASE WHEN local THEN m END) AS lm, arg_min(node, (m, node)) FILTER (local) AS ln FROM D GROUP BY 1)
SELECT point_id, CASE WHEN lm <= nm + 300 THEN ln ELSE nn END AS node, CASE WHEN lm <= nm + 300 THEN lm ELSE nm END AS m FROM B""")
def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nearest_node(_points(spark, sf_dir), view(spark, sf_dir, "grid_nodes").withColumn("local", F.col("node") % 3 == 0))


_PS = """sqrt(pow(x1 + t * (x2 - x1), 2) + pow(y1 + t * (y2 - y1), 2))"""
BLOCKS = f"""WITH {POINTS}, {WAYS}, X AS (SELECT point_id AS block_id, way_id AS edge_id, (lon1 - CAST(lon AS DOUBLE)) * 111320.0 * cos(radians(CAST(lat AS DOUBLE))) AS x1, (lat1 - CAST(lat AS DOUBLE)) * 110540.0 AS y1,
  (lon2 - CAST(lon AS DOUBLE)) * 111320.0 * cos(radians(CAST(lat AS DOUBLE))) AS x2, (lat2 - CAST(lat AS DOUBLE)) * 110540.0 AS y2 FROM POINTS, WAYS),
T AS (SELECT *, greatest(0.0, least(1.0, -(x1 * (x2 - x1) + y1 * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM X), M AS (SELECT block_id, edge_id, round({_PS}, 6) AS m FROM T), K AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY m, edge_id) AS k FROM M)"""


@query(f"{BLOCKS} SELECT block_id, edge_id, round(m, 3) AS m FROM K WHERE m <= 16 OR k = 1")
def road_block_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _points(spark, sf_dir).withColumnRenamed("point_id", "block_id")
    return S.blocked_edges(blocks, ways(spark, sf_dir).select("edge_id", "lon1", "lat1", "lon2", "lat2")).withColumn("m", F.round("m", 3))


@query(f"""WITH {WAYS}, E0 AS (SELECT w.p * 2 AS node, w.name, w.lon1 AS lon, w.lat1 AS lat FROM WAYS w WHERE w.dir = 0 UNION ALL SELECT w.p * 2 + 1, w.name, w.lon1, w.lat1 + (w.p % 4) / CAST(110540 AS DOUBLE) FROM WAYS w WHERE w.dir = 0)
SELECT a.node AS a, b.node AS b FROM E0 a JOIN E0 b ON a.node < b.node AND a.name = b.name AND a.name <> '' AND {PLANE.format('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 2 WHERE NOT (a.node % 10 = 0 AND b.node = a.node + 1)""")
def seam_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ways(spark, sf_dir).where("dir = 0")
    ends = w.select((F.col("p") * 2).alias("node"), "name", F.col("lon1").alias("lon"), F.col("lat1").alias("lat")).union(w.select(F.col("p") * 2 + 1, "name", "lon1", F.col("lat1") + (F.col("p") % 4) / 110540.0))
    existing = w.where("p * 2 % 10 = 0").select((F.col("p") * 2).alias("a"), (F.col("p") * 2 + 1).alias("b"))
    return S.seam_pairs(ends, existing)


@query(f"""WITH {WAYS}, {SEGS}, C AS (SELECT w.way_id AS edge_id, s.seg_id AS line_id, round(abs(s.s_lat1 - w.lat1) * 110540.0, 6) AS m, CASE WHEN w.p % 5 = s.seg_id % 3 THEN 0.00035 ELSE 0.00009 END * 110540.0 AS lim FROM WAYS w JOIN SEGS s ON w.dir = 0 AND s.seg_id = w.p)
SELECT edge_id, line_id, round(2 * m, 5) AS metres FROM C WHERE m <= lim""")
def official_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ways(spark, sf_dir).where("dir = 0").select("edge_id", (F.col("p") % 5).alias("ref"), "lon1", "lat1", "lon2", "lat2")
    lines = segments(spark, sf_dir).select(F.col("seg_id").alias("line_id"), (F.col("seg_id") % 3).alias("line_ref"), *[F.col(f"s_{k}").alias(f"l_{k}") for k in ("lon1", "lat1", "lon2", "lat2")])
    return S.official_match(e, lines)


STRESS = """STRESS AS (SELECT l_partkey AS edge_id, l_orderkey * 10 + l_linenumber AS rec_id, CASE l_orderkey % 3 WHEN 0 THEN 'i' WHEN 1 THEN 'd' ELSE 'none' END AS direction, l_suppkey % 2 = 0 AS same_way, CAST(l_quantity AS BIGINT) AS m, l_orderkey % 9 AS shoulder, 20 + 5 * (l_suppkey % 9) AS speed, l_suppkey % 13 = 0 AS prohibited, 1 + l_orderkey % 4 AS lts FROM lineitem),
SIDES AS (SELECT *, unnest(CASE WHEN direction = 'none' THEN ['ab', 'ba'] WHEN (direction = 'i') = same_way THEN ['ab'] ELSE ['ba'] END) AS side FROM STRESS),
BEST AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edge_id, side ORDER BY m, CASE WHEN direction = 'none' THEN 1 ELSE 0 END, rec_id, shoulder, speed, prohibited, lts) AS k FROM SIDES) WHERE k = 1)"""


def _stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey AS edge_id", "l_orderkey * 10 + l_linenumber AS rec_id", "CASE l_orderkey % 3 WHEN 0 THEN 'i' WHEN 1 THEN 'd' ELSE 'none' END AS direction", "l_suppkey % 2 = 0 AS same_way", "CAST(l_quantity AS BIGINT) AS m",
        "l_orderkey % 9 AS shoulder", "20 + 5 * (l_suppkey % 9) AS speed", "l_suppkey % 13 = 0 AS prohibited", "1 + l_orderkey % 4 AS lts",
    )


@query(f"WITH {STRESS} SELECT edge_id, side, shoulder, speed, prohibited, lts FROM BEST")
def directional_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.both_directions(_stress(spark, sf_dir))


@query(f"WITH {STRESS} SELECT edge_id, min(shoulder) AS shoulder, max(speed) AS speed, bool_or(prohibited) AS prohibited, max(lts) AS lts FROM BEST GROUP BY 1")
def conservative_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.conservative(S.both_directions(_stress(spark, sf_dir)))


#: Diamonds about the nodes.
@query(f"""WITH {WAYS}, A AS (SELECT node AS area, lon AS clon, lat AS clat FROM grid_nodes)
SELECT way_id, area FROM WAYS JOIN A ON abs(((lon1 + lon2) / 2) - clon) / 0.0033 + abs(((lat1 + lat2) / 2) - clat) / 0.0029 < 1""")
def urban_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose midpoint lies within an area: joined by cells of the areas' bounds, then ray cast."""
    mid = ways(spark, sf_dir).select("way_id", ((F.col("lon1") + F.col("lon2")) / 2).alias("lon"), ((F.col("lat1") + F.col("lat2")) / 2).alias("lat"))
    n = view(spark, sf_dir, "grid_nodes").select(F.col("node").alias("area"), F.col("lon").alias("clon"), F.col("lat").alias("clat"))
    corner = lambda dx, dy: F.struct((F.col("clon") + dx).alias("lon"), (F.col("clat") + dy).alias("lat"))
    ring = F.array(corner(0.0033, 0.0), corner(0.0, 0.0029), corner(-0.0033, 0.0), corner(0.0, -0.0029), corner(0.0033, 0.0))
    size = 0.004
    cells = n.withColumn("ring", ring).withColumn("c", F.explode(geo.near_cells(F.col("clon"), F.col("clat"), size)))
    return mid.withColumn("c", geo.cell(F.col("lon"), F.col("lat"), size)).join(cells, "c").where(geo.within_ring(F.col("lon"), F.col("lat"), F.col("ring"))).select("way_id", "area")


@query(f"""WITH {WAYS} SELECT way_id, round({HAV.format('lon1', 'lat1', 'lon2', 'lat2')}, 4) AS metres, round({PLANE.format('lon2', 'lat1', 'lon1', 'lat2')}, 4) AS planar, CASE WHEN dir = 0 THEN 90.0 ELSE 0.0 END AS heading,
  CAST(floor((lon1 + 180) / 360 * 4096) AS BIGINT) AS tx, CAST(floor((1 - asinh(tan(radians(lat1))) / pi()) / 2 * 4096) AS BIGINT) AS ty, round(lon1 + 0.3 * (lon2 - lon1), 8) AS lon3, round(lat1 + 0.3 * (lat2 - lat1), 8) AS lat3 FROM WAYS""")
def geo_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ways(spark, sf_dir)
    c = [F.col(k) for k in ("lon1", "lat1", "lon2", "lat2")]
    line = F.array(F.struct(c[0].alias("lon"), c[1].alias("lat")), F.struct(c[2].alias("lon"), c[3].alias("lat")))
    third = geo.interpolate(line, 0.3)
    return w.select("way_id", F.round(geo.length_m(line), 4).alias("metres"), F.round(geo.planar_m(*c), 4).alias("planar"), F.round(geo.planar_bearing(*c), 6).alias("heading"), geo.tile(c[0], c[1], 12)["x"].alias("tx"), geo.tile(c[0], c[1], 12)["y"].alias("ty"), F.round(third["lon"], 8).alias("lon3"), F.round(third["lat"], 8).alias("lat3"))
