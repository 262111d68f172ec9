"""Queries of what a request adds to the candidates and the network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlattice.operators import arcs as A
from roadlattice.operators import portfolio as P
from roadlattice.operators import requests as R
from roadlattice.operators import spatial as S
from roadlattice.sources.adapters import view

from .costs import ARCS_SQL, arcs
from .portfolio import CORRIDOR, EDGES, SCORED, _candidates, _corridor, _edges
from .registry import query
from .spatial import PLANE, WAYS, ways


@query("""WITH Q AS (SELECT DISTINCT request, CASE request % 3 WHEN 0 THEN true WHEN 1 THEN false END AS fd, CASE WHEN request % 5 = 0 THEN true END AS fr FROM candidates)
SELECT request, m AS mode, d AS designated, r AS residential FROM Q, (VALUES ('direct'), ('balanced'), ('low')) a(m), (VALUES (true), (false)) b(d), (VALUES (true), (false)) c(r) WHERE coalesce(fd, d) = d AND coalesce(fr, r) = r""")
def profile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("request")
    forced = view(spark, sf_dir, "candidates").select("request").distinct().select(q, F.when(q % 3 == 0, True).when(q % 3 == 1, False).alias("prefer_designated"), F.when(q % 5 == 0, True).alias("prefer_residential"))
    return R.profiles(forced)


@query(f"WITH {SCORED} SELECT request, candidate, row_number() OVER (PARTITION BY request ORDER BY fail, freeway, mtb, hazard, dismount, limited, aggression, time, candidate) AS safety_rank FROM SCORED")
def safety_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.safety_ranked(_candidates(spark, sf_dir)).select("request", "candidate", F.col("safety_rank").cast("long").alias("safety_rank"))


@query("""SELECT route_id, CAST(20 AS BIGINT) AS from_seq, CAST(60 AS BIGINT) AS to_seq, CAST(sum(len_m) AS BIGINT) AS len_m, CAST(sum(mph) AS BIGINT) AS mph FROM route_segments WHERE seq >= 20 AND seq < 60 GROUP BY 1 HAVING count(*) = 40""")
def splice_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = view(spark, sf_dir, "route_segments")
    cuts = seg.groupBy("route_id").agg(F.count_if((F.col("seq") >= 20) & (F.col("seq") < 60)).alias("n")).where("n = 40").select("route_id", F.lit(20).cast("long").alias("from_seq"), F.lit(60).cast("long").alias("to_seq"))
    return R.splice_estimates(R.prefix_sums(seg, ["len_m", "mph"]), cuts, ["len_m", "mph"])


@query(f"""WITH {WAYS}, N AS (SELECT node AS end_id, lon, lat FROM grid_nodes), X AS (SELECT w.way_id AS edge_id, w.lon1 AS lon, w.lat1 AS lat FROM WAYS w JOIN grid_edges e ON e.edge_id = w.way_id WHERE NOT e.freeway AND e.len_m <= 800 UNION ALL SELECT w.way_id, w.lon2, w.lat2 FROM WAYS w JOIN grid_edges e ON e.edge_id = w.way_id WHERE NOT e.freeway AND e.len_m <= 800)
SELECT DISTINCT end_id, edge_id FROM X JOIN N ON {PLANE.format('X.lon', 'X.lat', 'N.lon', 'N.lat')} <= 300""")
def terminal_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = view(spark, sf_dir, "grid_nodes").select(F.col("node").alias("end_id"), "lon", "lat")
    return R.terminal_access(ways(spark, sf_dir), ends)


@query(f"""WITH {WAYS}, V AS (SELECT way_id AS edge_id, p % 7 AS ref, lon1 AS lon, lat1 AS lat FROM WAYS UNION ALL SELECT way_id, p % 7, lon2, lat2 FROM WAYS), N AS (SELECT node % 7 AS r_ref, lon + 0.00002 * (node % 13) AS r_lon, lat AS r_lat FROM grid_nodes)
SELECT DISTINCT edge_id FROM V JOIN N ON abs(lon - r_lon) < 0.001 AND abs(lat - r_lat) < 0.001 AND (sqrt(pow(lon - r_lon, 2) + pow(lat - r_lat, 2)) <= 0.00004 OR (ref = r_ref AND sqrt(pow(lon - r_lon, 2) + pow(lat - r_lat, 2)) <= 0.00035))""")
def restricted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ways(spark, sf_dir)
    v = w.select("edge_id", (F.col("p") % 7).alias("ref"), F.col("lon1").alias("lon"), F.col("lat1").alias("lat")).union(w.select("edge_id", F.col("p") % 7, "lon2", "lat2"))
    r = view(spark, sf_dir, "grid_nodes").select((F.col("node") % 7).alias("r_ref"), F.expr("lon + 0.00002 * (node % 13)").cast("double").alias("r_lon"), F.col("lat").alias("r_lat"))
    return R.restricted(v, r)


@query(f"""WITH N AS (SELECT * FROM grid_nodes), M AS (SELECT * FROM grid_nodes) SELECT N.node AS l_id, M.node AS r_id FROM N JOIN M ON {PLANE.format('N.lon', 'N.lat', 'M.lon', 'M.lat')} <= 250""")
def terminal_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = view(spark, sf_dir, "grid_nodes")
    left = n.select(F.col("node").alias("l_id"), "lon", "lat")
    return S.near_points(left, n.select(F.col("node").alias("r_id"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat")), S.TERMINAL_M).select("l_id", "r_id")


@query(f"""WITH {ARCS_SQL} SELECT CAST(sum(CASE WHEN NOT prohibited AND NOT freeway AND NOT mtb THEN 1 ELSE 0 END) AS BIGINT) AS plain, CAST(sum(CASE WHEN NOT prohibited THEN 1 ELSE 0 END) AS BIGINT) AS most, CAST(sum(CASE WHEN NOT prohibited AND NOT freeway AND NOT mtb AND NOT ferry THEN 1 ELSE 0 END) AS BIGINT) AS land FROM ARCS""")
def legal_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = arcs(spark, sf_dir).withColumn("level", F.lit(1))
    kinds = {"plain": A.legal(a), "most": A.legal(a, freeways=True, mtb=True), "land": A.legal(a, ferries=False)}
    tagged = None
    for name, df in kinds.items():
        part = df.select(F.lit(name).alias("kind"))
        tagged = part if tagged is None else tagged.union(part)
    return tagged.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


@query(f"""WITH {SCORED}, {CORRIDOR}, J AS (SELECT c.request, c.a, c.b, c.share, greatest(250.0, 0.08 * least(x.dist, y.dist)) AS sc, abs(x.fail - y.fail) AS dfail, abs(x.freeway - y.freeway) AS dfree, abs(x.limited - y.limited) AS dlim, abs(x.mtb - y.mtb) AS dmtb, (x.dismount > 0) <> (y.dismount > 0) AS ddis,
  abs(x.facility - y.facility) AS dfac, abs(x.trail - y.trail) AS dtr, abs(x.designated - y.designated) AS dde, abs(x.residential - y.residential) AS dre, abs(x.hazard - y.hazard) AS dhz FROM CORRIDOR c JOIN SCORED x ON x.candidate = c.a JOIN SCORED y ON y.candidate = c.b)
SELECT request, a, b FROM J WHERE share < 0.96 OR (share < 0.99 AND (dfail >= 60 OR dfree >= 60 OR dlim >= greatest(120.0, sc / 2) OR dmtb >= 40 OR ddis OR dfac >= sc OR dtr >= sc OR dde >= sc OR dre >= sc OR dhz >= 50))""")
def meaningful_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.different(_candidates(spark, sf_dir), _corridor(spark, sf_dir))


@query("""WITH W AS (SELECT DISTINCT request, unnest([1, 2, 3]) AS place FROM candidates), X AS (SELECT request, place, request * 7 + place * 25 AS candidate FROM W)
SELECT X.request, CAST(X.place AS BIGINT) AS place, X.candidate, c.time, c.candidate IS NULL AS missing FROM X LEFT JOIN candidates c ON c.request = X.request AND c.candidate = X.candidate""")
def pinned_lineup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "candidates")
    wanted = c.select("request").distinct().select("request", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])).alias("place")).withColumn("candidate", F.col("request") * 7 + F.col("place") * 25)
    return R.pinned(wanted, c)


@query("""SELECT request, candidate FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY time, dist, candidate) AS k FROM candidates) WHERE k > 6""")
def extra_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    return R.extras(c, P.lettered(c)).select("request", "candidate")


@query(f"""WITH {EDGES}, F AS (SELECT request, min(route) AS f FROM EDGES GROUP BY 1) SELECT e.request, e.route, CAST(sum(CASE WHEN x.edge_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS shared FROM EDGES e JOIN F ON F.request = e.request LEFT JOIN EDGES x ON x.request = e.request AND x.route = F.f AND x.edge_id = e.edge_id GROUP BY 1, 2""")
def shared_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shared_edges(_edges(spark, sf_dir)).withColumn("shared", F.col("shared").cast("long"))
