"""Queries of source layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlattice.functions import geo
from roadlattice.operators import graph as G
from roadlattice.operators import layers as L
from roadlattice.operators import spatial as S
from roadlattice.sources.adapters import read, view

from .registry import query
from .spatial import SEGS, WAYS, segments, ways
from .ways import TAGS, osm_ways

#: Raw source records: the columns of several agencies, with what they hold besides numbers in range.
RECORDS = """RECORDS AS (SELECT o_orderkey AS id, o_custkey * 37 % 9000 - 300 AS aadt, 1900 + o_custkey % 160 AS year, o_custkey % 100 AS code, o_orderkey % 6 AS owner, CASE WHEN o_custkey % 3 > 0 THEN 90 + o_custkey % 10 END AS area, o_custkey % 5 - 1 AS lanes, 5 * (o_custkey % 13) - 10 AS speed,
  CASE WHEN o_custkey % 7 = 0 THEN 999 ELSE 1 + o_custkey % 4 END AS lts, concat(CAST(o_custkey % 30 AS VARCHAR(9)), CASE o_custkey % 3 WHEN 0 THEN 'i' WHEN 1 THEN 'd' ELSE '' END) AS route, o_orderkey % 1000 AS begin_m, o_orderkey % 1000 + o_custkey % 9 - 4 AS end_m, CASE o_custkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'P' WHEN 2 THEN 'N' END AS access FROM orders)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        k.alias("id"), (c * 37 % 9000 - 300).alias("aadt"), (1900 + c % 160).alias("year"), (c % 100).alias("code"), (k % 6).alias("owner"), F.when(c % 3 > 0, 90 + c % 10).alias("area"), (c % 5 - 1).alias("lanes"), (5 * (c % 13) - 10).alias("speed"),
        F.when(c % 7 == 0, 999).otherwise(1 + c % 4).alias("lts"), F.concat((c % 30).cast("string"), F.when(c % 3 == 0, "i").when(c % 3 == 1, "d").otherwise("")).alias("route"), (k % 1000).alias("begin"), (k % 1000 + c % 9 - 4).alias("end"), F.when(c % 4 == 0, "F").when(c % 4 == 1, "P").when(c % 4 == 2, "N").alias("access"),
    )


@query(f"WITH {RECORDS} SELECT id, aadt AS adt, CASE WHEN year BETWEEN 1930 AND 2035 THEN year END AS year FROM RECORDS WHERE aadt > 0")
def counts_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.counts_layer(records(spark, sf_dir))


@query(f"WITH {RECORDS} SELECT id, code AS fc, owner, coalesce(area IN (98, 99), false) AS rural FROM RECORDS WHERE code BETWEEN 1 AND 7")
def class_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.class_layer(records(spark, sf_dir))


@query(f"WITH {RECORDS} SELECT id, aadt AS adt, CASE WHEN code BETWEEN 1 AND 7 THEN code END AS fc, CASE WHEN year BETWEEN 1980 AND 2035 THEN year END AS year, CASE WHEN lanes > 0 THEN lanes END AS lanes, CASE WHEN speed > 0 THEN speed END AS speed FROM RECORDS WHERE aadt > 0")
def sample_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sample_layer(records(spark, sf_dir))


@query(f"""WITH {RECORDS}, W AS (SELECT *, CAST(18 + code AS DOUBLE) AS w, 1 + owner % 4 AS n FROM RECORDS)
SELECT id, CASE WHEN aadt > 0 THEN aadt END AS adt, CASE WHEN year BETWEEN 1930 AND 2035 THEN year END AS year, aadt > 0 AND year BETWEEN 1930 AND 2035 AND year < 2010 AS stale, round(greatest(0, (w - CASE WHEN w / n > 13 THEN least(w / n, 12.0) ELSE w / n END * n) / 2), 1) AS edge, w / n > 13 AS clamped,
  CASE WHEN area IS NULL AND lanes < 0 THEN NULL ELSE round(greatest(coalesce((area - 88) / 4.0, -1), coalesce(CASE WHEN lanes >= 0 THEN lanes / 3.0 END, -1)), 1) END AS shoulder FROM W""")
def road_log_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadlattice.functions import packing

    r = records(spark, sf_dir).withColumn("edge", packing.edge_space_ft((18 + F.col("code")).cast("double"), 1 + F.col("owner") % 4))
    return L.road_log_layer(r.withColumns({"left_ft": (F.col("area") - 88) / 4.0, "right_ft": F.when(F.col("lanes") >= 0, F.col("lanes") / 3.0)}))


_RESTR = "R AS (SELECT CASE c_custkey % 2 WHEN 0 THEN concat(CAST(c_custkey % 30 AS VARCHAR(9)), 'i') ELSE CAST(c_custkey % 30 AS VARCHAR(9)) END AS route, c_custkey * 7 % 1000 AS rb, c_custkey * 7 % 1000 + 3 AS re FROM customer)"


@query(f"""WITH {RECORDS}, {_RESTR} SELECT id, CASE WHEN lts <> 999 THEN lts END AS lts, CASE WHEN speed > 0 THEN speed END AS speed, CASE WHEN lanes > 0 THEN lanes END AS lanes, CASE WHEN aadt > 0 THEN aadt END AS adt, access IN ('F', 'P') AS limited,
  EXISTS (SELECT 1 FROM R WHERE R.route = RECORDS.route AND least(begin_m, end_m) < R.re AND greatest(begin_m, end_m) > R.rb) AS prohibited, owner = 1 AS designated, coalesce(area < 95, false) AS urban FROM RECORDS""")
def stress_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, c = records(spark, sf_dir), F.col("c_custkey")
    restr = read(spark, sf_dir, "customer").select(F.concat((c % 30).cast("string"), F.when(c % 2 == 0, "i").otherwise("")).alias("route"), (c * 7 % 1000).alias("begin"), (c * 7 % 1000 + 3).alias("end"))
    return L.stress_layer(r, restr, r.where("owner = 1"), r.where("area < 95"))


_SCORE = """CASE WHEN highway = 'cycleway' AND NOT coalesce(bicycle = 'no', false) THEN 1 WHEN highway = 'path' AND bicycle IN ('designated', 'yes') THEN 1 WHEN highway = 'footway' AND bicycle = 'designated' THEN 2 WHEN cycleway = 'track' THEN 1 WHEN cycleway = 'lane' THEN 2
  WHEN bicycle = 'no' AND (highway IN ('cycleway', 'path') OR cycleway IS NOT NULL) THEN 4 END"""


@query(f"WITH {TAGS}, S AS (SELECT *, {_SCORE} AS score FROM TAGS) SELECT way_id, CAST(score AS BIGINT) AS score, score = 4 AS prohibited, mtb IS NOT NULL OR way_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AS mtb FROM S WHERE score IS NOT NULL")
def infra_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = read(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("way_id"))
    return L.infra_layer(osm_ways(spark, sf_dir), members).withColumn("score", F.col("score").cast("long"))


@query(f"""WITH {TAGS} SELECT way_id, coalesce(cycleway = 'shared_lane', false) AND NOT highway IN ('cycleway', 'path', 'footway') AS sharrow, way_id % 14 >= 9 OR highway IN ('cycleway', 'path', 'footway') AS infra_drawn, way_id % 14 >= 9 AS stress_drawn, true AS roads_drawn FROM TAGS""")
def drawn_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    zoom = F.col("way_id") % 14
    return osm_ways(spark, sf_dir).select("way_id", L.sharrow_only().alias("sharrow"), L.drawn_at(zoom, "infra").alias("infra_drawn"), L.drawn_at(zoom, "stress").alias("stress_drawn"), L.drawn_at(zoom, "roads").alias("roads_drawn"))


@query(f"""WITH {RECORDS} SELECT id, CASE WHEN right(route, 1) IN ('i', 'd') THEN left(route, length(route) - 1) ELSE route END AS base, CASE right(route, 1) WHEN 'i' THEN 'increasing mileposts' WHEN 'd' THEN 'decreasing mileposts' END AS direction,
  CAST(CASE owner WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 2 END AS BIGINT) AS facility FROM RECORDS""")
def route_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["Shared-Use Path", "Sidepath", "Two-Way Separated Bike Lane", "Buffered Bike Lane", "Bike Lane", "Signed Route"]
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("owner").cast("int"))
    return records(spark, sf_dir).select("id", L.route_base(F.col("route")).alias("base"), L.route_direction(F.col("route")).alias("direction"), L.facility_level(name).cast("long").alias("facility"))


@query("""WITH P AS (SELECT c_custkey AS id, concat('Place ', CAST(c_custkey % 300 AS VARCHAR(9))) AS name, c_custkey % 4 AS kind FROM customer) SELECT id, name, kind FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), kind ORDER BY id) AS k FROM P) WHERE k = 1""")
def first_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    p = read(spark, sf_dir, "customer").select(c.alias("id"), F.concat(F.lit("Place "), (c % 300).cast("string")).alias("name"), (c % 4).alias("kind"))
    return L.first_of(p, [F.lower("name"), F.col("kind")], "id")


#: Ways of up to four nodes, of which some are not in the node table.
REFS = "REFS AS (SELECT c_custkey AS way_id, pos, c_custkey * 13 % 2100 + pos * 40 AS node FROM customer, range(0, 4) AS r(pos) WHERE pos <= c_custkey % 4 + 1)"


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(c.alias("way_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(3).cast("long"), c % 4 + 1))).alias("pos")).withColumn("node", F.col("way_id") * 13 % 2100 + F.col("pos") * 40)


@query(f"""WITH {REFS}, J AS (SELECT way_id, pos, lon, lat FROM REFS JOIN grid_nodes USING (node)) SELECT way_id, count(*) AS vertices, round(arg_min(lon, pos), 8) AS lon0, round(arg_max(lat, pos), 8) AS lat1 FROM J GROUP BY 1 HAVING count(*) >= 2""")
def way_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = L.way_lines(_refs(spark, sf_dir), view(spark, sf_dir, "grid_nodes"))
    return w.select("way_id", F.size("line").cast("long").alias("vertices"), F.round(F.get("line", F.lit(0))["lon"], 8).alias("lon0"), F.round(F.element_at("line", -1)["lat"].cast("double"), 8).alias("lat1"))


@query("SELECT e.edge_id, round(x.lon, 8) AS lon1, round(y.lat, 8) AS lat2, x.ele AS ele1, y.ele AS ele2 FROM grid_edges e JOIN grid_nodes x ON x.node = e.a JOIN grid_nodes y ON y.node = e.b")
def edge_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = L.with_ends(view(spark, sf_dir, "grid_edges"), view(spark, sf_dir, "grid_nodes"))
    return e.select("edge_id", F.round("lon1", 8).alias("lon1"), F.round(F.col("lat2").cast("double"), 8).alias("lat2"), "ele1", "ele2")


@query(f"""WITH {WAYS}, {SEGS}, B AS (SELECT * FROM SEGS WHERE adt > 15000), W AS (SELECT way_id, least(lon1, lon2) AS x0, greatest(lon1, lon2) AS x1, least(lat1, lat2) AS y0, greatest(lat1, lat2) AS y1 FROM WAYS)
SELECT way_id FROM W WHERE EXISTS (SELECT 1 FROM B WHERE x0 <= s_lon2 + 0.0003 AND x1 >= s_lon1 - 0.0003 AND y0 <= greatest(s_lat1, s_lat2) + 0.0003 AND y1 >= least(s_lat1, s_lat2) - 0.0003)""")
def boxed_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways near the segments of busy roads."""
    return L.boxed(ways(spark, sf_dir), segments(spark, sf_dir).where("adt > 15000"), 0.0003).select("way_id")


_DEG = "sqrt(pow(px - ax - t * (bx - ax), 2) + pow(py - ay - t * (by_ - ay), 2))"
_T = "greatest(0.0, least(1.0, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2))))"


@query(f"""WITH {WAYS}, S AS (SELECT w.way_id AS id, k, CASE WHEN k = 1 THEN lon1 ELSE lon2 END AS px, CASE WHEN k = 1 THEN lat1 ELSE lat2 END + 0.0001 * (w.p % 4) AS py FROM WAYS w, range(1, 4) AS r(k)), G AS (SELECT w.lon1 AS ax, w.lat1 AS ay, w.lon2 AS bx, w.lat2 AS by_ FROM WAYS w JOIN grid_edges e ON e.edge_id = w.way_id WHERE e.designated),
X AS (SELECT id, k, px, py, ax, ay, bx, by_, {_T} AS t FROM S JOIN G ON abs(px - (ax + bx) / 2) < 0.005 AND abs(py - (ay + by_) / 2) < 0.005) SELECT id, count(DISTINCT k) AS hits FROM X WHERE {_DEG} < 0.0003 GROUP BY 1 HAVING count(DISTINCT k) >= 2""")
def on_designated_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as lines of two vertices, some of them beside their road, against the designated edges."""
    w = ways(spark, sf_dir)
    off = (F.col("p") % 4) / 10000.0  # the double nearest to the decimal; a third of the edges lies just at the limit
    point = lambda i: F.struct(F.col(f"lon{i}").alias("lon"), (F.col(f"lat{i}") + off).alias("lat"))
    line = F.array(point(1), point(1), point(2), point(2))  # samples are the vertices 1, 2 and 3
    return L.on_route(w.select(F.col("way_id").alias("id"), line.alias("line")), w.where("designated").select("lon1", "lat1", "lon2", "lat2"))


@query(f"""WITH {WAYS}, P AS (SELECT node AS id, node % 7 AS ref, lon + 0.00003 * (node % 5) AS px, lat + 0.00005 * (node % 9) AS py FROM grid_nodes), G AS (SELECT w.way_id AS line_id, w.p % 7 AS g_ref, w.lon1 AS ax, w.lat1 AS ay, w.lon2 AS bx, w.lat2 AS by_ FROM WAYS w JOIN grid_edges e ON e.edge_id = w.way_id WHERE e.limited_access),
X AS (SELECT *, {_T} AS t FROM P JOIN G ON abs(px - (ax + bx) / 2) < 0.005 AND abs(py - (ay + by_) / 2) < 0.005), D AS (SELECT id, line_id, ref = g_ref AS same, round({_DEG}, 7) AS d FROM X)
SELECT id, arg_min(line_id, (d, line_id)) AS line_id, round(min(d) * 10000000) AS degrees FROM D WHERE d <= 0.00004 OR (d <= 0.00035 AND same) GROUP BY 1""")
def nearest_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points beside the nodes against the edges of limited access, dealt to cells."""
    w = ways(spark, sf_dir).where("limited_access")
    line = F.array(*[F.struct(F.col(f"lon{i}").alias("lon"), F.col(f"lat{i}").alias("lat")) for i in (1, 2)])
    cells = L.segment_cells(w.select(F.col("way_id").alias("line_id"), (F.col("p") % 7).alias("ref"), line.alias("line")), 0.01, 0.00035)
    n = F.col("node")
    p = view(spark, sf_dir, "grid_nodes").select(n.alias("id"), (n % 7).alias("ref"), (F.col("lon") + F.lit(0.00003) * (n % 5)).alias("lon"), (F.col("lat") + F.lit(0.00005) * (n % 9)).alias("lat"))
    return L.nearest_allowed(p, cells, 0.01, 0.00035, 0.00004).withColumn("degrees", F.round(F.col("degrees") * 10000000))


@query(f"""WITH {WAYS}, C AS (SELECT DISTINCT w.way_id, w.lon1, w.lat1, floor(x / 0.01) AS cx, floor(y / 0.01) AS cy FROM WAYS w JOIN grid_edges e ON e.edge_id = w.way_id, (VALUES (-0.00035), (0.00035)) a(dx), (VALUES (-0.00035), (0.00035)) b(dy), LATERAL (SELECT unnest([least(w.lon1, w.lon2) - 0.00035, greatest(w.lon1, w.lon2) + 0.00035]) AS x), LATERAL (SELECT unnest([least(w.lat1, w.lat2) - 0.00035, greatest(w.lat1, w.lat2) + 0.00035]) AS y) WHERE e.limited_access)
SELECT way_id AS line_id, count(*) AS cells FROM C GROUP BY 1""")
def restriction_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ways(spark, sf_dir).where("limited_access")
    line = F.array(*[F.struct(F.col(f"lon{i}").alias("lon"), F.col(f"lat{i}").alias("lat")) for i in (1, 2)])
    return L.segment_cells(w.select(F.col("way_id").alias("line_id"), F.lit(0).alias("ref"), line.alias("line")), 0.01, 0.00035).groupBy("line_id").agg(F.count("*").alias("cells"))


@query(f"""WITH {WAYS}, {SEGS}, H AS (SELECT w.way_id, CAST(s.source AS BIGINT) AS layer, 2 * 6371000.0 * asin(sqrt(pow(cos(radians(w.lat1)), 2) * pow(sin(radians(w.lon2 - w.lon1) / 2), 2))) AS m FROM WAYS w JOIN SEGS s ON w.dir = 0 AND w.p = s.seg_id AND abs((s.s_lat1 - w.lat1) * 110540.0) <= 18)
SELECT layer, count(*) AS matched, round(sum(m), 3) AS metres FROM H GROUP BY 1""")
def credited_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, s = ways(spark, sf_dir), segments(spark, sf_dir)
    hit = S.span_match(w, s).join(view(spark, sf_dir, "measure_segments").select("seg_id", F.col("source").alias("layer")), "seg_id")
    metres = w.select("way_id", geo.haversine_m(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")).alias("metres"))
    return L.credited(hit, metres).withColumn("metres", F.round("metres", 3))


@query("""WITH RECURSIVE V AS (SELECT route_id AS way_id, row_number() OVER (PARTITION BY route_id ORDER BY seq) AS i, seq AS pos, CAST(len_m AS DOUBLE) AS m FROM route_segments),
C(way_id, i, pos, m, chunk, run) AS (SELECT way_id, i, pos, m, 0, CASE WHEN m >= 250 THEN 0.0 ELSE m END FROM V WHERE i = 1 UNION ALL SELECT V.way_id, V.i, V.pos, V.m, CASE WHEN C.run = 0 THEN C.chunk + 1 ELSE C.chunk END, CASE WHEN C.run + V.m >= 250 THEN 0.0 ELSE C.run + V.m END FROM C JOIN V ON V.way_id = C.way_id AND V.i = C.i + 1)
SELECT way_id, CAST(chunk AS BIGINT) AS chunk, min(pos) AS first_pos, sum(m) AS metres FROM C GROUP BY 1, 2""")
def road_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "route_segments").select(F.col("route_id").alias("way_id"), F.col("seq").alias("pos"), F.col("len_m").cast("double").alias("m"))
    return L.chunked(v).groupBy("way_id", F.col("chunk").cast("long").alias("chunk")).agg(F.min("pos").alias("first_pos"), F.sum("m").alias("metres"))


@query("""WITH K AS (SELECT *, concat_ws('|', mph, coalesce(CAST(lts AS VARCHAR), '-')) AS k FROM (SELECT route_id, seq, len_m, mph // 20 AS mph, lts FROM route_segments)), I AS (SELECT *, sum(CASE WHEN k <> p THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY seq) AS j FROM (SELECT *, coalesce(lag(k) OVER (PARTITION BY route_id ORDER BY seq), k) AS p FROM K))
SELECT route_id AS way_id, CAST(j AS BIGINT) AS joined, CAST(mph AS BIGINT) AS band, lts, min(seq) AS first_run, count(*) AS runs, CAST(sum(len_m) AS BIGINT) AS metres FROM I GROUP BY ALL""")
def coalesced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "route_segments").select(F.col("route_id").alias("way_id"), F.col("seq").alias("run"), F.floor(F.col("mph") / 20).alias("band"), "lts", F.col("len_m").alias("metres"))
    return L.coalesced(r, ["band", "lts"])


_PROPS = """PROPS AS (SELECT o_orderkey AS id, 5 * (o_custkey % 12) AS speed, o_custkey % 3 = 0 AS estimated, CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 9 END AS shoulder, o_custkey % 5 AS facility, o_custkey % 4 AS lanes, CASE WHEN o_orderkey % 2 = 0 THEN 20 + o_orderkey % 40 END AS a_speed, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 8 END AS a_shoulder,
  CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 8 + o_orderkey % 2 END AS a_shoulder_max, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 7 = 0 END AS a_limited, o_orderkey % 6 AS a_lanes, o_custkey % 900 - 50 AS m_adt FROM orders)"""


@query(f"""WITH {_PROPS} SELECT id, CASE WHEN estimated AND coalesce(a_speed > 0, false) THEN a_speed ELSE speed END AS speed, estimated AND NOT coalesce(a_speed > 0, false) AS estimated, coalesce(shoulder, a_shoulder) AS shoulder, shoulder IS NULL AND a_shoulder IS NOT NULL AS from_agency, CASE WHEN shoulder IS NULL AND a_shoulder_max <> a_shoulder THEN a_shoulder_max END AS better_side,
  coalesce(a_limited, false) AND facility < 2 AS limited, coalesce(nullif(lanes, 0), nullif(a_lanes, 0)) AS lanes, CASE WHEN m_adt > 0 THEN m_adt END AS adt FROM PROPS""")
def road_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    p = read(spark, sf_dir, "orders").select(
        k.alias("id"), (5 * (c % 12)).alias("speed"), (c % 3 == 0).alias("estimated"), F.when(c % 4 > 0, c % 9).alias("shoulder"), (c % 5).alias("facility"), (c % 4).alias("lanes"), F.when(k % 2 == 0, 20 + k % 40).alias("a_speed"), F.when(k % 3 > 0, k % 8).alias("a_shoulder"),
        F.when(k % 3 > 0, k % 8 + k % 2).alias("a_shoulder_max"), F.when(k % 5 > 0, k % 7 == 0).alias("a_limited"), (k % 6).alias("a_lanes"), (c % 900 - 50).alias("m_adt"),
    )
    return L.merged_properties(p)


_BOX = (-122.4815, 47.3025, -122.4485, 47.3265)
_CLIP = f"""SEG AS (SELECT w.p % 40 * 2 + w.dir AS x, w.way_id AS line_id, k AS pos, lon1 + (lon2 - lon1) * k / 2 AS lon1, lat1 + (lat2 - lat1) * k / 2 AS lat1, lon1 + (lon2 - lon1) * (k + 1) / 2 AS lon2, lat1 + (lat2 - lat1) * (k + 1) / 2 AS lat2 FROM WAYS w, range(0, 2) AS r(k)),
T AS (SELECT *, greatest(0.0, CASE WHEN lon2 > lon1 THEN ({_BOX[0]} - lon1) / (lon2 - lon1) ELSE 0 END, CASE WHEN lat2 > lat1 THEN ({_BOX[1]} - lat1) / (lat2 - lat1) ELSE 0 END) AS t0, least(1.0, CASE WHEN lon2 > lon1 THEN ({_BOX[2]} - lon1) / (lon2 - lon1) ELSE 1 END, CASE WHEN lat2 > lat1 THEN ({_BOX[3]} - lat1) / (lat2 - lat1) ELSE 1 END) AS t1 FROM SEG
  WHERE (lon2 > lon1 OR (lon1 >= {_BOX[0]} AND lon1 <= {_BOX[2]})) AND (lat2 > lat1 OR (lat1 >= {_BOX[1]} AND lat1 <= {_BOX[3]})))"""


@query(f"""WITH {WAYS}, {_CLIP} SELECT line_id, CAST(0 AS BIGINT) AS part, pos, round(lon1 + t0 * (lon2 - lon1), 8) AS lon1, round(lat1 + t0 * (lat2 - lat1), 8) AS lat1, round(lon1 + t1 * (lon2 - lon1), 8) AS lon2, round(lat1 + t1 * (lat2 - lat1), 8) AS lat2 FROM T WHERE t0 < t1""")
def clipped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges halved into two segments and clipped; an edge is straight, so it never has two parts."""
    w = ways(spark, sf_dir).select(F.col("way_id").alias("line_id"), "lon1", "lat1", "lon2", "lat2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("pos"))
    at = lambda n, k: F.col(f"{n}1") + (F.col(f"{n}2") - F.col(f"{n}1")) * k / 2
    seg = w.select("line_id", "pos", at("lon", F.col("pos")).alias("lon1"), at("lat", F.col("pos")).alias("lat1"), at("lon", F.col("pos") + 1).alias("lon2"), at("lat", F.col("pos") + 1).alias("lat2"))
    return L.clipped(seg, *_BOX).select("line_id", F.col("part").cast("long").alias("part"), "pos", *[F.round(n, 8).alias(n) for n in ("lon1", "lat1", "lon2", "lat2")])


_GRADES = """GR AS (SELECT edge_id, CAST(len_m AS DOUBLE) AS len, CAST(len_m + p % 5 * 20 AS DOUBLE) * 0.7 AS way_m, CAST(p % 21 - 10 AS DOUBLE) AS rise, CAST(up_m AS DOUBLE) AS u, CAST(down_m AS DOUBLE) AS d, ferry, dir = 1 AS backward, CASE p % 8 WHEN 0 THEN concat(CAST(p % 45 - 20 AS VARCHAR(9)), '%') WHEN 1 THEN 'steep' END AS incline,
  CASE p % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS bridge, CASE p % 7 WHEN 0 THEN 'abandoned' WHEN 1 THEN 'rail' END AS railway FROM grid_edges),
ST AS (SELECT *, CASE WHEN incline LIKE '%\\%' ESCAPE '\\' AND abs(CAST(replace(incline, '%', '') AS DOUBLE)) <= 30 THEN CAST(replace(incline, '%', '') AS DOUBLE) * CASE WHEN backward THEN -1 ELSE 1 END END AS stated, CASE WHEN way_m >= 80 THEN rise * len / way_m ELSE 0 END AS delta FROM GR),
UD AS (SELECT *, CASE WHEN bridge = 'yes' THEN greatest(0, delta) ELSE u END AS u1, CASE WHEN bridge = 'yes' THEN greatest(0, -delta) ELSE d END AS d1 FROM ST)"""


@query(f"""WITH {_GRADES} SELECT edge_id, round(CASE WHEN ferry THEN 0 WHEN stated IS NOT NULL THEN greatest(0, len * stated / 100) WHEN railway = 'abandoned' THEN least(u1, len * 0.05) ELSE u1 END, 6) AS up, round(CASE WHEN ferry THEN 0 WHEN stated IS NOT NULL THEN greatest(0, -len * stated / 100) WHEN railway = 'abandoned' THEN least(d1, len * 0.05) ELSE d1 END, 6) AS down FROM UD""")
def edge_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, p = view(spark, sf_dir, "grid_edges"), F.col("p")
    made = {"incline": F.when(p % 8 == 0, F.concat((p % 45 - 20).cast("string"), F.lit("%"))).when(p % 8 == 1, "steep"), "bridge": F.when(p % 5 == 0, "yes").when(p % 5 == 1, "no"), "railway": F.when(p % 7 == 0, "abandoned").when(p % 7 == 1, "rail")}
    tagged = e.withColumn("tags", F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in made.items()]), lambda x: x["value"].isNotNull())))
    d = lambda c: c.cast("double")
    g = L.edge_grade(d(F.col("len_m")), d(F.col("len_m") + p % 5 * 20) * 0.7, d(p % 21 - 10), d(F.col("up_m")), d(F.col("down_m")), F.col("ferry"), F.col("dir") == 1)
    return tagged.select("edge_id", g.alias("g")).select("edge_id", F.round("g.up", 6).alias("up"), F.round("g.down", 6).alias("down"))


@query("""WITH E AS (SELECT unnest([a, b]) AS node, NOT prohibited AND NOT freeway AND NOT ferry AS ok, NOT prohibited AND NOT freeway AND NOT ferry AND NOT mtb AS plain FROM grid_edges) SELECT node, bool_or(ok) AS local, bool_or(plain) AS plain FROM E GROUP BY 1""")
def snap_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.snap_flags(view(spark, sf_dir, "grid_edges"))


@query(f"""WITH {WAYS} SELECT way_id, CASE WHEN dir = 0 THEN round(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))), 5) ELSE 0.0 END AS first_deg, CASE WHEN dir = 0 THEN 90.0 ELSE 0.0 END AS near_deg, CAST(dir AS BIGINT) AS dir FROM WAYS""")
def bearings_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edge's first vertex is repeated, which the bearing passes over; its first bearing from -180 to 180."""
    w = ways(spark, sf_dir)
    point = lambda i: F.struct(F.col(f"lon{i}").alias("lon"), F.col(f"lat{i}").alias("lat"))
    line = F.array(point(1), point(1), point(2))
    near = L.bearing_near(F.array(point(1), point(2)), F.col("lon1"), F.col("lat1"))
    first = F.col("first")
    w = w.select("way_id", L.end_bearings(line)["first"].alias("first"), near.alias("near"), "dir")
    return w.select("way_id", F.round(F.when(first > 180, first - 360).otherwise(first), 5).alias("first_deg"), F.round("near", 5).alias("near_deg"), "dir")


@query("SELECT coalesce(max(greatest(mph, 3) * 0.44704), 0) AS mps FROM grid_edges WHERE ferry")
def fastest_ferry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fastest_ferry_mps(view(spark, sf_dir, "grid_edges"))


@query(f"""WITH RECURSIVE {TAGS}, LINKS AS (SELECT n_nationkey AS way_id, n_regionkey FROM nation), MEMB AS (SELECT 1000 + n_regionkey AS rel, s_suppkey AS way_id FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION SELECT n_nationkey, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey),
G AS (SELECT w.way_id, t.highway, t.acc, t.bicycle FROM (SELECT DISTINCT way_id FROM MEMB) w JOIN TAGS t USING (way_id)), C AS (SELECT *, CASE WHEN highway = 'construction' THEN 'construction' WHEN acc IS NOT NULL THEN 'closed to the public' WHEN bicycle = 'no' THEN 'no bicycles' END AS reason FROM G)
SELECT m.rel AS route, count(*) AS ways, sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END)::BIGINT AS open_ways, sum(CASE WHEN reason IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS closures FROM MEMB m JOIN C USING (way_id) GROUP BY 1""")
def route_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designated routes: nested relations to ways, ways to their tags, and which of them are closed."""
    from roadlattice.functions import tags

    member = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("id"), F.col("s_suppkey").alias("member"), F.lit("way").alias("member_type"))
    nested = read(spark, sf_dir, "nation").select((1000 + F.col("n_regionkey")).cast("long").alias("id"), F.col("n_nationkey").cast("long").alias("member"), F.lit("relation").alias("member_type"))
    of = G.members(member.unionByName(nested)).select(F.col("id").alias("route"), F.col("way").alias("way_id"))
    closed = osm_ways(spark, sf_dir).select("way_id", tags.closure_reason().alias("reason"))
    return of.join(closed, "way_id").groupBy("route").agg(F.count("*").alias("ways"), F.count_if(F.col("reason").isNull()).alias("open_ways"), F.count_if(F.col("reason").isNotNull()).alias("closures"))
