"""Queries of single predicates, readers and writers, and reductions over candidates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlattice.functions import geo, tags
from roadlattice.operators import arcs as A
from roadlattice.operators import costs as C
from roadlattice.operators import etl as E
from roadlattice.operators import generation as N
from roadlattice.operators import layers as L
from roadlattice.operators import portfolio as P
from roadlattice.operators import reporting as R
from roadlattice.operators.graph import shared_folder
from roadlattice.sources.adapters import read, view

from .costs import ARCS_SQL, LEVELS_SQL, arcs
from .generation import STOPS, _open, _path_sql, _request, _search_sql
from .graphs import COST_SQL, whole_cost
from .layers import RECORDS, records
from .portfolio import BEATEN, SCORED, _candidates, _corridor
from .registry import query
from .ways import TAGS, osm_ways


@query("SELECT node FROM grid_nodes WHERE lon BETWEEN -122.48 AND -122.45 AND lat BETWEEN 47.31 AND 47.33")
def nodes_in_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "grid_nodes").where(geo.within_bounds(F.col("lon"), F.col("lat"), -122.48, 47.31, -122.45, 47.33)).select("node")


@query("""WITH W AS (SELECT p_partkey AS id, (['water', 'bay', 'wood', NULL])[p_partkey % 4 + 1] AS nat, (['forest', NULL, NULL])[p_partkey % 3 + 1] AS use, (['park', 'garden', NULL, NULL, NULL])[p_partkey % 5 + 1] AS leisure FROM part)
SELECT id, CASE WHEN nat IN ('water', 'bay') THEN 'water' WHEN nat = 'wood' THEN 'forest' WHEN use = 'forest' THEN 'forest' WHEN leisure IN ('park', 'garden') THEN 'park' END AS kind FROM W""")
def land_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (k % len(xs)).cast("int"))
    made = {"natural": pick(["water", "bay", "wood", None]), "landuse": pick(["forest", None, None]), "leisure": pick(["park", "garden", None, None, None])}
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in made.items()]), lambda e: e["value"].isNotNull())
    return read(spark, sf_dir, "part").select(k.alias("id"), F.map_from_entries(entries).alias("tags")).select("id", tags.land_kind().alias("kind"))


@query(f"WITH {ARCS_SQL} SELECT arc_id FROM ARCS WHERE edge_id NOT IN (SELECT edge_id FROM grid_edges WHERE limited_access)")
def unblocked_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.without_edges(arcs(spark, sf_dir), view(spark, sf_dir, "grid_edges").where("limited_access").select("edge_id")).select("arc_id")


@query(f"""WITH {LEVELS_SQL} SELECT arc_id, NOT freeway AND NOT mtb AND (level < 4 OR len_m // 4 <= 40) AS strict, NOT freeway AND NOT mtb AS plain, level = 4 AND NOT freeway AND len_m // 4 <= 40 AS provisional FROM LEVELLED WHERE NOT prohibited""")
def gated_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which gates each open arc passes, with lengths a fourth, so that some failing arcs are short enough to cross."""
    a = A.judged(arcs(spark, sf_dir)).where("not prohibited").withColumn("len_m", F.floor(F.col("len_m") / 4))
    mark = lambda df, n: df.select("arc_id", F.lit(True).alias(n))
    j = a.join(mark(A.legal(a, require_safe=True), "strict"), "arc_id", "left").join(mark(A.legal(a), "plain"), "arc_id", "left")
    sure = lambda n: F.coalesce(n, F.lit(False)).alias(n)
    return j.select("arc_id", sure("strict"), sure("plain"), ((F.col("level") == 4) & ~F.col("freeway") & (F.col("len_m") <= N.CROSSING_M)).alias("provisional"))


@query("SELECT edge_id, CASE WHEN len_m < 20 OR abs((up_m - down_m) * 100.0 / len_m) > 40 THEN 0.0 ELSE floor((up_m - down_m) * 100.0 / CAST(len_m AS DOUBLE) + 0.5) END AS grade FROM grid_edges")
def reported_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "grid_edges").select("edge_id", C.reported_grade().alias("grade"))


@query("""WITH H AS (SELECT CAST('0x' || substr(md5(concat_ws('|', p_partkey, p_brand, p_size)), 1, 15) AS BIGINT) AS h FROM part) SELECT substr(sha256(concat(CAST(sum(h) AS VARCHAR), ':', CAST(count(*) AS VARCHAR))), 1, 12) AS version FROM H""")
def layer_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.version_stamp(read(spark, sf_dir, "part"), ["p_partkey", "p_brand", "p_size"])


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS name, 'Point' AS geometry_type FROM part")
def feature_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written as compressed JSON lines in files of bounded size, and read again."""
    k = F.col("p_partkey")
    f = read(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 3 > 0, F.col("p_brand")).alias("name"), F.lit("Point").alias("geometry_type"), F.concat(F.lit("["), k.cast("string"), F.lit(",0]")).alias("coordinates"))
    path = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    E.write_features(f, path, rows_per_file=500)
    kind = "properties struct<id:long,name:string>, geometry struct<type:string,coordinates:string>"
    return spark.read.schema(kind).json(path).select("properties.*", F.col("geometry.type").alias("geometry_type"))


@query("SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS nation, unnest([0, 1]) AS part, CAST(s_suppkey AS DOUBLE) AS x FROM supplier")
def paged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of records written as a service gives them, read, and their paths taken apart."""
    k = F.col("s_suppkey")
    path = F.array(F.array(F.array(k.cast("double"), F.lit(0.0)), F.array(k.cast("double"), F.lit(1.0))), F.array(F.array(k.cast("double"), F.lit(2.0)), F.array(k.cast("double"), F.lit(3.0))))
    feature = F.struct(F.struct(k.alias("id"), F.col("s_nationkey").cast("long").alias("nation")).alias("attributes"), F.struct(path.alias("paths")).alias("geometry"))
    pages = read(spark, sf_dir, "supplier").groupBy(F.floor(k / 25).alias("page")).agg(F.collect_list(feature).alias("features"))
    folder = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    pages.select(F.to_json(F.struct("features")).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    lines = E.lines(E.read_pages(spark, folder, "id long, nation long"))
    y = F.get("line", F.lit(0))["lat"]
    return lines.select("id", "nation", (y / 2).cast("int").alias("part"), F.get("line", F.lit(0))["lon"].alias("x"))


@query("""WITH S AS (SELECT c_custkey AS id, [concat('busy=', c_custkey % 5), concat('lanes=', c_custkey % 3), concat('cap=', c_custkey % 7)] AS kv FROM customer) SELECT id, array_to_string(list_sort(kv), ',') AS signature FROM S""")
def settings_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    m = F.create_map(F.lit("lanes"), k % 3, F.lit("cap"), k % 7, F.lit("busy"), k % 5)
    return read(spark, sf_dir, "customer").select(k.alias("id"), E.signature(m).alias("signature"))


_SAFE = "(fail, freeway, mtb, hazard, dismount, limited, aggression, time, candidate)"


@query(f"""WITH {SCORED} SELECT request, arg_min(candidate, (time, candidate)) AS fastest, arg_min(candidate, {_SAFE}) AS safest, arg_min(candidate, (score, candidate)) AS best_priced, arg_min(candidate, (-trail, candidate)) AS trail_richest, arg_min(candidate, (score, candidate)) FILTER (fail <= dist * 0.05) AS low_fail FROM SCORED GROUP BY 1""")
def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.best_of(_candidates(spark, sf_dir))


@query("""SELECT route_id, CAST(sum(CASE WHEN level = 4 THEN len_m ELSE 0 END) AS BIGINT) AS fail, CAST(sum(CASE WHEN hazard >= 2 OR mtb THEN len_m ELSE 0 END) AS BIGINT) AS danger, CAST(sum(CASE WHEN level = 3 THEN len_m ELSE 0 END) AS BIGINT) AS caution, CAST(sum(CASE WHEN facility < 2 AND NOT infra THEN len_m ELSE 0 END) AS BIGINT) AS gap,
  CAST(sum(CASE WHEN NOT (infra OR facility = 5) THEN len_m ELSE 0 END) AS BIGINT) AS non_trail, CAST(sum(CASE WHEN surface >= 2 THEN len_m ELSE 0 END) AS BIGINT) AS rough, CAST(sum(CASE WHEN grade_pct > 0 THEN len_m * grade_pct ELSE 0 END) AS BIGINT) AS ascent, CAST(sum(len_m) AS BIGINT) AS dist FROM route_segments WHERE NOT ferry GROUP BY 1""")
def metric_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.metric_vectors(view(spark, sf_dir, "route_segments"))


@query("""SELECT route_id, CAST(sum(CASE WHEN grade_pct > 5 THEN len_m ELSE 0 END) AS BIGINT) AS incline_m, CAST(sum(CASE WHEN mph >= 30 AND sh < 4 AND facility < 2 THEN len_m ELSE 0 END) AS BIGINT) AS no_space_m, CAST(sum(CASE WHEN surface >= 2 THEN len_m ELSE 0 END) AS BIGINT) AS unpaved_m, CAST(sum(CASE WHEN dismount AND dismount_tagged THEN len_m ELSE 0 END) AS BIGINT) AS walk_m,
  max(mph) AS max_mph, round(sum(mph * len_m) / CAST(sum(len_m) AS DOUBLE), 6) AS mean_mph FROM route_segments WHERE NOT ferry GROUP BY 1""")
def report_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.report_stats(view(spark, sf_dir, "route_segments"))


@query(f"""WITH {RECORDS} SELECT id, speed AS limit_mph, NULL::BIGINT AS facility FROM RECORDS WHERE speed > 0 UNION ALL SELECT id, NULL, CASE owner WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 3 ELSE 2 END FROM RECORDS WHERE owner <= 4""")
def official_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal speeds and facilities, each with its filter."""
    names = ["Shared-Use Path", "Sidepath", "Two-Way Separated Bike Lane", "Buffered Bike Lane", "Bike Lane", "Signed Route"]
    r = records(spark, sf_dir).withColumn("facility_name", F.get(F.array(*[F.lit(n) for n in names]), F.col("owner").cast("int")))
    return L.official_layers(r)


@query(f"""WITH {BEATEN}, DUP AS (SELECT DISTINCT request, b AS candidate FROM CORRIDOR WHERE share >= 0.99), FIRSTS AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY time, ord, candidate) AS k FROM SCORED), KEPT AS (SELECT s.request, s.candidate FROM SCORED s JOIN FIRSTS f ON f.request = s.request AND f.k = 1 WHERE s.time <= 2.2 * f.time + 600 OR s.fail + s.freeway <= f.fail + f.freeway - 80 OR (s.fail = 0 AND s.freeway = 0)),
OFFERED AS (SELECT request, candidate FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY time, dist, candidate) AS k FROM SCORED) WHERE k <= 6)
SELECT s.request, s.candidate, CASE WHEN o.candidate IS NOT NULL THEN 'offered' WHEN k.candidate IS NULL THEN 'too-slow' WHEN d.candidate IS NOT NULL THEN 'duplicate' WHEN b.candidate IS NOT NULL AND s.candidate % 6 <> 0 THEN 'dominated' ELSE 'not-chosen' END AS stage
FROM SCORED s LEFT JOIN KEPT k ON k.candidate = s.candidate LEFT JOIN DUP d ON d.candidate = s.candidate LEFT JOIN BEATEN b ON b.candidate = s.candidate LEFT JOIN OFFERED o ON o.candidate = s.candidate""")
def candidate_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages with duplicates, and with some candidates protected from being dominated."""
    c, near = _candidates(spark, sf_dir), _corridor(spark, sf_dir)
    duplicates = near.where("share >= 0.99").select("request", F.col("b").alias("candidate")).distinct()
    beaten = P.dominated(c, near, protected=c.where("candidate % 6 = 0").select("request", "candidate"))
    return P.staged(c, P.reasonable(c), beaten, P.lettered(c), duplicates).select("request", "candidate", "stage")


@query(f"""WITH RECURSIVE {ARCS_SQL}, C AS (SELECT src AS s, dst AS d, CAST(min({COST_SQL}) AS DOUBLE) AS c FROM ARCS WHERE NOT prohibited GROUP BY 1, 2), {_search_sql('D', STOPS[0])}, {_path_sql('W', 'D', STOPS[2])} SELECT row_number() OVER (ORDER BY k DESC) - 1 AS step, pred AS src, node AS dst FROM W""")
def route_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arcs of a least-cost route, in order; of equal costs by the least predecessor."""
    plan = _request(spark, STOPS[0], STOPS[2]).select("request", F.lit(0).alias("plan"), F.lit("g").alias("graph"), "start", "goal")
    return N.searched({"g": _open(spark, sf_dir)}, plan).select(F.col("step").cast("long").alias("step"), "src", "dst")


_STRICT = f"""{LEVELS_SQL}, C AS (SELECT src AS s, dst AS d, CAST(min({COST_SQL}) AS DOUBLE) AS c FROM LEVELLED WHERE NOT prohibited AND NOT freeway AND NOT mtb AND (level < 4 OR len_m <= 40) GROUP BY 1, 2), {_search_sql('D', 42)},
P AS (SELECT C.d AS node, min(C.s) AS pred FROM C JOIN D u ON u.node = C.s JOIN D v ON v.node = C.d AND abs(u.dist + C.c - v.dist) < 1e-9 AND v.dist > 0 GROUP BY 1), G AS (SELECT node FROM D ORDER BY dist DESC, node LIMIT 1), W(node, k) AS (SELECT node, 0 FROM G UNION ALL SELECT P.pred, W.k + 1 FROM W JOIN P ON P.node = W.node)"""


@query(f"WITH RECURSIVE {_STRICT} SELECT node, CAST(k AS BIGINT) AS steps_back FROM W")
def strict_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the least path that uses no level-4 arc but short crossings, from the farthest node back to its start."""
    from roadlattice.operators import graph as G

    safe = A.legal(A.judged(arcs(spark, sf_dir)), require_safe=True)
    source = spark.range(1).select(F.lit(42).cast("long").alias("node"), F.lit(0).alias("request"))
    best = G.distances(safe.select("src", "dst", whole_cost().alias("cost")), source)
    goal = best.orderBy(F.desc("dist"), "node").limit(1).select("request", "node")
    return G.walked_back(best, goal).select("node", F.col("steps_back").cast("long").alias("steps_back"))


_LABELS = "LB AS (SELECT l_partkey AS node, (l_orderkey * 10 + l_linenumber) * 10000 + l_suppkey AS label, CAST(l_quantity AS BIGINT) AS time, l_suppkey % 50 AS fail, l_orderkey % 40 AS ascent FROM lineitem)"


@query(f"""WITH {_LABELS}, R AS (SELECT *, least(row_number() OVER (PARTITION BY node ORDER BY time, label), row_number() OVER (PARTITION BY node ORDER BY fail, label), row_number() OVER (PARTITION BY node ORDER BY ascent, label)) = 1 AS extreme, time * 10 + fail * 20 + ascent * 6 AS cost FROM LB),
K AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY CASE WHEN extreme THEN 0 ELSE 1 END, cost, label) AS k FROM R) SELECT node, label, CAST(k AS BIGINT) AS rank FROM K WHERE k <= 8""")
def top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight labels a node: those that are best in a metric first, then in practical order."""
    labels = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10000 + F.col("l_suppkey")).alias("label"), F.col("l_quantity").cast("long").alias("time"), (F.col("l_suppkey") % 50).alias("fail"), (F.col("l_orderkey") % 40).alias("ascent"))
    return P.top_labels(labels, {"time": 10, "fail": 20, "ascent": 6}, 8).select("node", "label", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {TAGS}, M AS (SELECT way_id, count(*) AS n FROM (SELECT c_custkey * 13 % 2100 AS way_id FROM customer) GROUP BY 1) SELECT t.way_id, coalesce(t.bicycle = 'designated', false) AS designated, coalesce(M.n, 0) AS members FROM TAGS t LEFT JOIN M USING (way_id) WHERE t.highway IN ('cycleway', 'path', 'footway') ORDER BY 1""")
def off_street_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag filter as the base map makes it, with how many routes use each way."""
    used = read(spark, sf_dir, "customer").select((F.col("c_custkey") * 13 % 2100).alias("way_id")).groupBy("way_id").agg(F.count("*").alias("n"))
    w = osm_ways(spark, sf_dir).where(tags.tag("highway").isin("cycleway", "path", "footway")).join(used, "way_id", "left")
    return w.select("way_id", F.coalesce(tags.tag("bicycle") == "designated", F.lit(False)).alias("designated"), F.coalesce("n", F.lit(0)).alias("members"))


@query("""WITH P AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 > 0 THEN CAST(c_custkey * 7 % 400 - 200 AS DOUBLE) END AS lon, CAST(c_custkey * 3 % 200 - 100 AS DOUBLE) AS lat, c_custkey % 6 - 1 AS surface FROM customer)
SELECT id, coalesce(lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90, false) AS valid, CASE surface WHEN 1 THEN 'Paved' WHEN 2 THEN 'Gravel' WHEN 3 THEN 'Rough' ELSE 'Surface not recorded' END AS surface FROM P""")
def point_and_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadlattice.functions import formats

    c = F.col("c_custkey")
    p = read(spark, sf_dir, "customer").select(c.alias("id"), F.when(c % 11 > 0, (c * 7 % 400 - 200).cast("double")).alias("lon"), (c * 3 % 200 - 100).cast("double").alias("lat"), (c % 6 - 1).alias("surface"))
    return p.select("id", R.valid_point(F.col("lon"), F.col("lat")).alias("valid"), formats.surface_label(F.col("surface")).alias("surface"))


@query(f"""WITH E AS (SELECT *, CASE WHEN p % 4 = 0 THEN p % 10 END AS sh_ba, CASE WHEN p % 6 = 0 THEN p % 12 = 0 END AS pr_ba FROM grid_edges) SELECT edge_id * 2 AS arc_id, shoulder_ft, prohibited, up_m FROM E
UNION ALL SELECT edge_id * 2 + 1, coalesce(sh_ba, shoulder_ft), coalesce(pr_ba, prohibited), down_m FROM E WHERE NOT one_way""")
def directional_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs whose backward side has a shoulder and a ban of its own."""
    p = F.col("p")
    e = view(spark, sf_dir, "grid_edges").withColumns({"shoulder_ft_ba": F.when(p % 4 == 0, p % 10), "prohibited_ba": F.when(p % 6 == 0, p % 12 == 0)})
    return A.directed(e).select("arc_id", "shoulder_ft", "prohibited", "up_m")
