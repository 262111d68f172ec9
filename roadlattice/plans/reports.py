"""Queries of layer building, coverage and whole-line operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlattice.functions import geo
from roadlattice.operators import etl as E
from roadlattice.operators import lines as L
from roadlattice.sources.adapters import read, view

from .registry import query
from .spatial import WAYS, ways


@query("""SELECT road_class, CAST(sum(len_m) AS BIGINT) AS metres, CAST(sum(CASE WHEN adt IS NOT NULL THEN len_m ELSE 0 END) AS BIGINT) AS counted, CAST(sum(CASE WHEN edge_space IS NOT NULL THEN len_m ELSE 0 END) AS BIGINT) AS spaced FROM grid_edges GROUP BY ROLLUP (road_class)""")
def coverage_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.coverage(view(spark, sf_dir, "grid_edges"), "road_class", counted=F.col("adt").isNotNull(), spaced=F.col("edge_space").isNotNull())


@query("""SELECT field, value, count(*) AS rows FROM (SELECT unnest(['year', 'source', 'fc']) AS field, unnest([CAST(year AS VARCHAR), CAST(source AS VARCHAR), CAST(fc AS VARCHAR)]) AS value FROM measure_segments) GROUP BY 1, 2""")
def build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.statistics(view(spark, sf_dir, "measure_segments"), ["year", "source", "fc"])


_CORR = "SELECT c_custkey % 200 AS k, concat('net', CAST(c_custkey % 3 AS VARCHAR(9))) AS network, concat('r', CAST(c_nationkey % 4 AS VARCHAR(9))) AS ref FROM customer"


@query(f"""WITH W AS ({_CORR}), M AS (SELECT k, array_to_string(list_sort(list(DISTINCT network)), ';') AS network, array_to_string(list_sort(list(DISTINCT ref)), ';') AS ref FROM W GROUP BY 1)
SELECT network, ref, count(*) AS lines, min(least(concat('[{{"lon":', CAST(k AS VARCHAR), '.0,"lat":0.0}},{{"lon":', CAST(k + 1000 AS VARCHAR), '.0,"lat":0.0}}]'), concat('[{{"lon":', CAST(k + 1000 AS VARCHAR), '.0,"lat":0.0}},{{"lon":', CAST(k AS VARCHAR), '.0,"lat":0.0}}]'))) AS first_key FROM M GROUP BY 1, 2""")
def corridor_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the ways run against the others; the undirected key brings them together."""
    w = read(spark, sf_dir, "customer").select((F.col("c_custkey") % 200).alias("k"), F.col("c_custkey"), F.concat(F.lit("net"), (F.col("c_custkey") % 3).cast("string")).alias("network"), F.concat(F.lit("r"), (F.col("c_nationkey") % 4).cast("string")).alias("ref"))
    point = lambda x: F.struct(x.cast("double").alias("lon"), F.lit(0.0).alias("lat"))
    line = F.array(point(F.col("k")), point(F.col("k") + 1000))
    return E.corridors(w.withColumn("line", F.when(F.col("c_custkey") % 2 == 0, line).otherwise(F.reverse(line))), geo.undirected_key(F.col("line")), ["network", "ref"])


@query("""WITH A AS (SELECT p_partkey AS id, p_size AS v, p_partkey % 9 AS w FROM part WHERE p_partkey % 3 = 0), B AS (SELECT p_partkey AS id, p_size + 100 AS v, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 7 END AS w FROM part WHERE p_partkey % 2 = 0), C AS (SELECT p_partkey AS id, CAST(NULL AS INT) AS v, p_partkey % 5 AS w FROM part WHERE p_partkey % 5 = 0)
SELECT p.p_partkey AS id, CAST(coalesce(A.v, B.v, C.v) AS BIGINT) AS v, CAST(coalesce(A.w, B.w, C.w) AS BIGINT) AS w FROM part p LEFT JOIN A ON A.id = p.p_partkey LEFT JOIN B ON B.id = p.p_partkey LEFT JOIN C ON C.id = p.p_partkey""")
def measure_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("z"))
    i, z = F.col("id"), F.col("z")
    layers = [p.where(i % 3 == 0).select("id", z.alias("v"), (i % 9).alias("w")), p.where(i % 2 == 0).select("id", (z + 100).alias("v"), (i % 7).alias("w")), p.where(i % 5 == 0).select("id", F.lit(None).cast("long").alias("v"), (i % 5).alias("w"))]
    return E.resolve(p.select("id"), "id", layers, ["v", "w"])


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN p_brand || '!' ELSE p_brand END AS brand FROM part""")
def patched_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    return E.updated(p, p.where("id % 4 = 0").withColumn("brand", F.concat("brand", F.lit("!"))), "id", ["brand"])


@query("""WITH R AS (SELECT c_custkey AS way_id, unnest([0, 1, 2, 3]) AS pos, unnest([c_custkey, 5000 + c_custkey * 7 % 900, 9000 + c_custkey * 3 % 1600, 20000 + c_custkey]) AS node FROM customer),
S AS (SELECT node FROM R GROUP BY 1 HAVING count(*) >= 2), M AS (SELECT R.*, pos BETWEEN 1 AND 2 AND node IN (SELECT node FROM S) AS cut FROM R),
N AS (SELECT *, coalesce(sum(CAST(cut AS INT)) OVER (PARTITION BY way_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM M), B AS (SELECT way_id, run, pos, node FROM N UNION ALL SELECT way_id, run + 1, pos, node FROM N WHERE cut)
SELECT way_id, CAST(run AS BIGINT) AS run, arg_min(node, pos) AS from_node, arg_max(node, pos) AS to_node, count(*) AS vertices FROM B GROUP BY 1, 2""")
def way_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    refs = read(spark, sf_dir, "customer").select(c.alias("way_id"), F.posexplode(F.array(c, 5000 + c * 7 % 900, 9000 + c * 3 % 1600, 20000 + c)).alias("pos", "node"))
    return L.split_at_junctions(refs)


#: Each row of the grid is a way of short segments.
_ROWS = "ROWS_ AS (SELECT gy AS way_id, gx AS pos, lon, lat FROM grid_nodes)"
_HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({3} - {1}) / 2), 2) + cos(radians({1})) * cos(radians({3})) * pow(sin(radians({2} - {0}) / 2), 2))))"


@query(f"""WITH {_ROWS}, S AS (SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM ROWS_ WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
M AS (SELECT *, CASE WHEN lon2 IS NULL THEN 0.0 ELSE round({_HAV.format('lon', 'lat', 'lon2', 'lat2')}, 6) END AS m FROM S), E AS (SELECT *, sum(m) OVER (PARTITION BY way_id ORDER BY pos) AS e FROM M),
X AS (SELECT way_id, pos, 0 AS k, lon, lat, false AS added FROM E UNION ALL SELECT way_id, pos, k, lon + greatest(0.0, (k * 120 - (e - m)) / m) * (lon2 - lon), lat + greatest(0.0, (k * 120 - (e - m)) / m) * (lat2 - lat), true FROM E, range(1, 200) AS r(k) WHERE m > 0 AND k >= ceil(round((e - m) / 120, 9)) AND k <= ceil(round(e / 120, 9)) - 1)
SELECT way_id, row_number() OVER (PARTITION BY way_id ORDER BY pos, k) AS seq, round(lon, 8) AS lon, round(lat, 8) AS lat, added FROM X""")
def densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = view(spark, sf_dir, "grid_nodes").select(F.col("gy").alias("way_id"), F.col("gx").alias("pos"), "lon", "lat")
    return L.densified(n).select("way_id", F.col("seq").cast("long").alias("seq"), F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"), "added")


@query("""WITH RECURSIVE P AS (SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS r, p_partkey % 40 AS i, p_size AS e FROM part),
S(r, i, lvl, up, down) AS (SELECT r, i, e, 0, 0 FROM P WHERE i = 0 UNION ALL SELECT P.r, P.i, CASE WHEN abs(P.e - S.lvl) >= 2 THEN P.e ELSE S.lvl END, S.up + CASE WHEN P.e - S.lvl >= 2 THEN P.e - S.lvl ELSE 0 END, S.down + CASE WHEN S.lvl - P.e >= 2 THEN S.lvl - P.e ELSE 0 END FROM S JOIN P ON P.r = S.r AND P.i = S.i + 1)
SELECT r AS row_id, CAST(max(up) AS BIGINT) AS up_m, CAST(max(down) AS BIGINT) AS down_m FROM S GROUP BY 1""")
def sampled_ascent(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = view(spark, sf_dir, "grid_nodes").groupBy("gy").agg(F.transform(F.array_sort(F.collect_list(F.struct("gx", "ele"))), lambda s: s["ele"]).alias("e"))
    return n.select(F.col("gy").alias("row_id"), L.climbs(F.col("e")).alias("c")).select("row_id", "c.up_m", "c.down_m")


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers over as many tasks as shuffles have: small rows make much work here, and their file is one task's."""
    return read(spark, sf_dir, "customer").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")


def _zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of nine vertices for each customer, that bends by its number."""
    c = F.col("c_custkey")
    bend = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.struct((-122.0 + i * 0.0001).alias("lon"), (47.0 + F.when(i % 2 == 0, 0.0).otherwise((c % 5) * 0.00002)).alias("lat")))
    return _spread(spark, sf_dir).select(c.alias("id"), bend.alias("line"))


#: Vertices of the five shapes, as a plain recursion over the points gives them.
@query("SELECT c_custkey AS id, CAST(CASE c_custkey % 5 WHEN 3 THEN 5 WHEN 4 THEN 9 ELSE 2 END AS BIGINT) AS vertices FROM customer")
def simplified_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zigzag(spark, sf_dir).select("id", F.size(L.simplify()(F.col("line"))).cast("long").alias("vertices"))


#: Bends of nine vertices that climb: by the customer's number more or less sharp, steep, fast and wide.
_BENDS = """BENDS AS (SELECT c_custkey AS id, 25 + 5 * (c_custkey % 6) AS mph, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 6 END AS shoulder, c_custkey % 3 AS facility, i, -122.0 + 0.00015 * i * CASE WHEN i > 4 AND c_custkey % 5 > 2 THEN 0.5 ELSE 1.0 END AS lon,
  47.0 + 0.00002 * (c_custkey % 5) * greatest(0, i - 3) * greatest(0, i - 3) AS lat, CAST((c_custkey % 9) * i AS DOUBLE) / 8 AS ele FROM customer, range(0, 9) AS r(i))"""


def _way(name: str, order: str) -> str:
    """The rule along one direction, in SQL: window ends, turn and grade of each inner vertex."""
    return f"""{name}V AS (SELECT id, mph, shoulder, facility, row_number() OVER (PARTITION BY id ORDER BY i {order}) - 1 AS j, lon, lat, ele FROM BENDS),
{name}S AS (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM {name}V WINDOW w AS (PARTITION BY id ORDER BY j)),
{name}A AS (SELECT *, sum(CASE WHEN lon0 IS NULL THEN 0.0 ELSE {_HAV.format('lon0', 'lat0', 'lon', 'lat')} END) OVER (PARTITION BY id ORDER BY j) AS run_m, degrees(atan2((lon - lon0) * cos(radians((lat0 + lat) / 2)), lat - lat0)) AS h FROM {name}S),
{name}T AS (SELECT *, coalesce(abs(((lead(h) OVER w - h + 180) - 360 * floor((lead(h) OVER w - h + 180) / 360)) - 180), 0.0) AS turn FROM {name}A WINDOW w AS (PARTITION BY id ORDER BY j)),
{name}W AS (SELECT c.id, c.j, c.mph, c.shoulder, c.facility, coalesce((SELECT max(x.j) FROM {name}A x WHERE x.id = c.id AND x.run_m <= c.run_m - 35), 0) AS lo, coalesce((SELECT min(x.j) FROM {name}A x WHERE x.id = c.id AND x.run_m >= c.run_m + 35), 8) AS hi, (SELECT max(run_m) FROM {name}A x WHERE x.id = c.id) AS whole FROM {name}A c WHERE c.j BETWEEN 1 AND 7),
{name}G AS (SELECT w.*, (SELECT run_m FROM {name}A x WHERE x.id = w.id AND x.j = w.hi) - (SELECT run_m FROM {name}A x WHERE x.id = w.id AND x.j = w.lo) AS m, (SELECT coalesce(sum(turn), 0) FROM {name}T x WHERE x.id = w.id AND x.j > w.lo AND x.j < w.hi) AS turn,
  (SELECT ele FROM {name}A x WHERE x.id = w.id AND x.j = w.hi) - (SELECT ele FROM {name}A x WHERE x.id = w.id AND x.j = w.lo) AS rise FROM {name}W w),
{name}L AS (SELECT id, j, lo, hi, CASE WHEN mph < 30 OR facility >= 2 OR whole < 35 OR m < 30 OR turn < 30 OR rise / m < 0.03 THEN 0 ELSE greatest(0, least(3, CASE WHEN turn >= 75 AND rise / m >= 0.055 THEN 3 WHEN turn >= 50 OR rise / m >= 0.05 THEN 2 ELSE 1 END
  + CASE WHEN mph >= 45 THEN 1 ELSE 0 END + CASE WHEN shoulder IS NULL THEN -1 WHEN shoulder >= 4 THEN -2 WHEN shoulder <= 1 AND mph >= 40 THEN 1 ELSE 0 END)) END AS level FROM {name}G),
{name}B AS (SELECT id, level, CASE WHEN level > 0 THEN lo ELSE 0 END AS lo, CASE WHEN level > 0 THEN hi ELSE 0 END AS hi FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY level DESC, j) AS k FROM {name}L) WHERE k = 1)"""


@query(f"""WITH {_BENDS}, {_way('F', '')}, {_way('R', 'DESC')}
SELECT f.id, CAST(f.level AS BIGINT) AS ab, CAST(r.level AS BIGINT) AS ba, CAST(f.lo AS BIGINT) AS ab_first, CAST(f.hi AS BIGINT) AS ab_last, CAST(CASE WHEN r.level > 0 THEN 8 - r.hi ELSE 0 END AS BIGINT) AS ba_first, CAST(CASE WHEN r.level > 0 THEN 8 - r.lo ELSE 0 END AS BIGINT) AS ba_last FROM FB f JOIN RB r USING (id)""")
def curve_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    up = lambda i: F.greatest(F.lit(0), i - 3).cast("double")
    line = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.struct((F.lit(-122.0) + F.lit(0.00015) * i * F.when((i > 4) & (c % 5 > 2), 0.5).otherwise(1.0)).alias("lon"), (F.lit(47.0) + F.lit(0.00002) * (c % 5) * up(i) * up(i)).alias("lat")))
    ele = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: ((c % 9) * i).cast("double") / 8)
    h = L.curve_hazard()(line, ele, (25 + 5 * (c % 6)).cast("int"), F.when(c % 4 > 0, c % 6).cast("int"), (c % 3).cast("int"))
    return _spread(spark, sf_dir).select(c.alias("id"), h.alias("h")).select("id", *[F.col(f"h.{n}").cast("long").alias(n) for n in ("ab", "ba", "ab_first", "ab_last", "ba_first", "ba_last")])
