"""Queries of live guidance, as batches and as streams over files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlattice.operators.graph import shared_folder
from roadlattice.sources.adapters import read, view
from roadlattice.streaming import guidance as L
from roadlattice.streaming import rides as V

from .registry import query


def _fixes(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """Fixes of the events: the ride is the user; time (a tenth of a second each) and distance along the route follow the event's number."""
    events = source if source is not None else read(spark, sf_dir, "events")
    e = F.col("event_id")
    plan = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.struct((i * 900.0).alias("at_m"), F.concat(F.lit("turn "), i.cast("string")).alias("text")))
    return events.select(F.col("user_id").alias("ride_id"), F.timestamp_millis(1_704_067_200_000 + e * 100).alias("ts"), e.alias("event_id"), (e * 7 % 120).cast("double").alias("off_m"), (10 + 10 * (e % 15)).cast("double").alias("accuracy_m"), (e % 1201 * 10).cast("double").alias("route_m"), plan.alias("instructions"), F.lit(11900.0).alias("end_m"), F.when(e % 4 == 0, (e % 10).cast("double")).when(e % 4 == 1, -1.0).alias("speed_mps"))


@query("SELECT ride_id, ts, off_m, accuracy_m FROM (SELECT *, row_number() OVER (PARTITION BY ride_id ORDER BY ts DESC, event_id DESC) AS k FROM gps_fixes) WHERE k = 1")
def latest_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.latest(view(spark, sf_dir, "gps_fixes"))


@query("""WITH F AS (SELECT ride_id, ts, event_id, event_id % 1201 * 10 AS m, event_id / 10.0 AS s, CASE WHEN event_id % 4 = 0 THEN event_id % 10 END AS own FROM gps_fixes), D AS (SELECT *, s - lag(s) OVER w AS e, m - lag(m) OVER w AS d FROM F WINDOW w AS (PARTITION BY ride_id ORDER BY event_id))
SELECT ride_id, event_id, round(coalesce(own, d / CAST(e AS DOUBLE)), 6) AS speed, round(coalesce(own, d / CAST(e AS DOUBLE)) * 2.23694, 5) AS mph FROM D WHERE own IS NOT NULL OR (e > 0 AND e < 30)""")
def fix_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.speeds(_fixes(spark, sf_dir)).where("speed is not null").select("ride_id", "event_id", F.round("speed", 6).alias("speed"), F.round("mph", 5).alias("mph"))


#: The rules of the road in SQL, one recursion step for each fix of a ride: a fix off the route that only raises suspicion ends its turn,
#: so does one of a ride that stays off; all others clear suspicion and go on to the instructions, and to the arrival when none is left.
_EVENTS = """WITH RECURSIVE F AS (SELECT user_id AS ride_id, event_id AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id / 10.0 AS t, event_id * 7 % 120 AS off_m, 10 + 10 * (event_id % 15) AS acc, event_id % 1201 * 10 AS m FROM events),
S(ride_id, n, e, off, began, fixes, told_at, told, nxt, ap, im, arr, ev) AS (
  SELECT DISTINCT ride_id, 0::BIGINT, 0::BIGINT, false, NULL::DOUBLE, 0::BIGINT, -1e18::DOUBLE, false, 0::BIGINT, false, false, false, []::VARCHAR[] FROM F
  UNION ALL
  SELECT ride_id, n, e, CASE WHEN enters THEN true WHEN back THEN false ELSE off END,
    CASE WHEN enters OR riding THEN NULL WHEN counted THEN began1 ELSE began END, CASE WHEN enters OR riding THEN 0 WHEN counted THEN fixes1 ELSE fixes END,
    CASE WHEN enters OR back OR near OR again THEN t ELSE told_at END, CASE WHEN enters OR back THEN false WHEN near THEN true ELSE told1 END,
    nxt1, ap1 OR now OR soon, im1 OR now, arr OR arrives,
    list_concat(CASE WHEN enters THEN ['off-route:'] WHEN back THEN ['rejoined:'] WHEN near THEN ['approach:'] WHEN again THEN ['still-off:'] ELSE [] END,
      CASE WHEN now THEN [concat('now:turn ', nxt1 + 1)] WHEN soon THEN [concat('ahead:turn ', nxt1 + 1)] ELSE [] END, CASE WHEN arrives THEN ['arrived:'] ELSE [] END)
  FROM (SELECT *, pending AND ahead <= 350 AND NOT ap1 AND NOT now AS soon FROM (
    SELECT *, pending AND ahead <= 90 AND NOT im1 AS now FROM (
      SELECT *, riding AND nxt1 < 12 AS pending, 900 * (nxt1 + 1) - m AS ahead, ap AND nxt1 = nxt AS ap1, im AND nxt1 = nxt AS im1, riding AND nxt1 >= 12 AND m >= 11900 - 45 AS arrives FROM (
        SELECT *, counted AND fixes1 >= CASE WHEN acc > 60 THEN 3 ELSE 2 END AS enters, away AND off_m <= 130 AND NOT told1 AS near, away AND NOT (off_m <= 130 AND NOT told1) AND t - told_at >= 30 AS again,
          CASE WHEN riding THEN greatest(nxt, least(12, greatest(0, CAST(ceil((m - 60) / 900.0) AS BIGINT) - 1))) ELSE nxt END AS nxt1 FROM (
          SELECT *, suspect AND acc <= 120 AS counted, NOT arr AND NOT suspect AND NOT away AS riding, CASE WHEN began IS NULL OR t - began > 40 THEN t ELSE began END AS began1, CASE WHEN began IS NULL OR t - began > 40 THEN 1 ELSE fixes + 1 END AS fixes1,
            told AND NOT (away AND off_m > 250) AS told1 FROM (
            SELECT s.ride_id, f.n, f.e, f.t::DOUBLE AS t, f.off_m, f.acc, f.m, s.off, s.began, s.fixes, s.told_at, s.told, s.nxt, s.ap, s.im, s.arr, NOT s.arr AND NOT s.off AND f.off_m > 65 AS suspect, NOT s.arr AND s.off AND f.off_m > 40 AS away, NOT s.arr AND s.off AND f.off_m <= 40 AS back
            FROM S s JOIN F f ON f.ride_id = s.ride_id AND f.n = s.n + 1))))))
), X AS (SELECT ride_id, 1704067200000 + e * 100 AS at_ms, unnest(ev) AS k FROM S WHERE n > 0), E AS (SELECT ride_id, at_ms, split_part(k, ':', 1) AS kind, split_part(k, ':', 2) AS detail FROM X)"""


@query(f"{_EVENTS} SELECT ride_id, (at_ms - 1704067200000) // 100 AS event_id FROM E WHERE kind = 'arrived'")
def ride_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fix with which each ride arrives."""
    ends = L.guide_batch(_fixes(spark, sf_dir)).where("kind = 'arrived'")
    return ends.select("ride_id", F.floor((F.unix_millis("ts") - 1_704_067_200_000) / 100).cast("long").alias("event_id"))


@query(f"{_EVENTS} SELECT * FROM E")
def instruction_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.guide_batch(_fixes(spark, sf_dir)).select("ride_id", F.unix_millis("ts").alias("at_ms"), "kind", "detail")


@query(f"{_EVENTS} SELECT ride_id, at_ms, kind FROM E WHERE kind IN ('off-route', 'approach', 'still-off', 'rejoined')")
def off_route_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful stream run to its end over the events file; its events are written to the shared folder and read back."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    out = f"{shared_folder(spark)}/guidance-{uuid.uuid4().hex}"
    q = L.guide(_fixes(spark, sf_dir, stream), idle_minutes=None).writeStream.outputMode("append").format("parquet").option("path", f"{out}/events").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    events = spark.read.schema(L.EVENTS).parquet(f"{out}/events")
    return events.where(F.col("kind").isin("off-route", "approach", "still-off", "rejoined")).select("ride_id", F.unix_millis("ts").alias("at_ms"), "kind")


#: A ride's route is a row of the grid; its fixes lie beside it.
_RIDES = """N AS (SELECT count(DISTINCT gy) AS n FROM grid_nodes), PTS AS (SELECT gy AS r, gx AS idx, lon, lat FROM grid_nodes), SG AS (SELECT r, idx AS segment, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM PTS WINDOW w AS (PARTITION BY r ORDER BY idx)),
FX AS (SELECT user_id AS ride_id, event_id, user_id % 5 AS r, -122.5 + 0.00013 * (event_id * 37 % 600) AS lon, 47.3 + 0.0015 * (user_id % 5) + 0.0004 * (event_id % 7 - 3) AS lat FROM events)"""


def _rides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e, u = F.col("event_id"), F.col("user_id")
    n = view(spark, sf_dir, "grid_nodes").where("gy < 5").select(F.col("gy").alias("r"), F.col("gx").alias("idx"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), (F.col("gx") * 150.0).alias("distance_m"))
    fixes = read(spark, sf_dir, "events").select(u.alias("ride_id"), (u % 5).alias("r"), F.timestamp_millis(1_704_067_200_000 + e * 100).alias("ts"), e.alias("event_id"), (F.lit(-122.5) + F.lit(0.00013) * (e * 37 % 600)).alias("lon"), (F.lit(47.3) + F.lit(0.0015) * (u % 5) + F.lit(0.0004) * (e % 7 - 3)).alias("lat"))
    return fixes, n


_XY = "(x1 - lon) * 111320.0 * cos(radians(lat)) AS ax, (y1 - lat) * 110540.0 AS ay, (x2 - lon) * 111320.0 * cos(radians(lat)) AS bx, (y2 - lat) * 110540.0 AS by_"


@query(f"""WITH {_RIDES}, D AS (SELECT ride_id, event_id, segment, {_XY} FROM FX JOIN SG USING (r) WHERE x2 IS NOT NULL), T AS (SELECT *, greatest(0.0, least(1.0, -(ax * (bx - ax) + ay * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS t FROM D), M AS (SELECT ride_id, event_id, segment, round(sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (by_ - ay), 2)), 6) AS off_m FROM T)
SELECT ride_id, event_id, arg_min(segment, (off_m, segment)) AS segment, round(min(off_m), 3) AS off_m FROM M GROUP BY 1, 2""")
def route_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixes, n = _rides(spark, sf_dir)
    points = fixes.select("ride_id", "r").distinct().join(n, "r").drop("r")
    return L.nearest_on_route(fixes, points).withColumn("off_m", F.round("off_m", 3))


@query(f"""WITH {_RIDES}, D AS (SELECT ride_id, event_id, segment, {_XY} FROM FX JOIN SG USING (r) WHERE x2 IS NOT NULL), T AS (SELECT *, greatest(0.0, least(1.0, -(ax * (bx - ax) + ay * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS t FROM D), M AS (SELECT ride_id, event_id, sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (by_ - ay), 2)) AS off_m FROM T)
SELECT ride_id, event_id, round(min(off_m), 3) AS off_m FROM M GROUP BY 1, 2""")
def matched_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful match; routes of 39 segments lie within its reach whole, so it finds the nearest."""
    fixes, n = _rides(spark, sf_dir)
    route = n.groupBy("r").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "lon", "lat", "distance_m"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), p["distance_m"].alias("distance_m"))).alias("route"))
    rides = fixes.select("ride_id", "r").distinct().join(F.broadcast(route), "r").drop("r")  # five routes
    return L.matched(fixes.drop("r"), rides).select("ride_id", "event_id", F.round("off_m", 3).alias("off_m"))


#: The same rules for fixes beside whole rows of the grid, with six instructions on each and 5850 m to its end.
_RIDE_EVENTS = (
    _EVENTS.replace("event_id * 7 % 120 AS off_m", "abs(event_id % 7 - 3) * 0.0004 * 110540.0 AS off_m").replace("event_id % 1201 * 10 AS m FROM events", "0.000131 * (event_id * 37 % 596) / 0.002 * 150 AS m FROM events")
    .replace("nxt1 < 12", "nxt1 < 6").replace("nxt1 >= 12", "nxt1 >= 6").replace("least(12,", "least(6,").replace("11900 - 45", "5850 - 45").replace("f.off_m, f.acc, f.m", "f.off_m::DOUBLE AS off_m, f.acc, f.m::DOUBLE AS m")
)


@query(f"{_RIDE_EVENTS} SELECT * FROM E")
def ride_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match and guidance as one stateful stream over the events file, routes as initial state: each ride follows a row of the grid."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    e, u = F.col("event_id"), F.col("user_id")
    grid = view(spark, sf_dir, "grid_nodes")
    rows = grid.agg(F.greatest(F.lit(1), F.floor(F.max("node") / 40) - 1).alias("rows"))  # one row; rows 1 .. rows are whole
    on = lambda events: events.crossJoin(F.broadcast(rows)).withColumn("gy", 1 + u % F.col("rows"))
    text = F.when((F.col("gx") % 6 == 0) & (F.col("gx") > 0), F.concat(F.lit("turn "), F.floor(F.col("gx") / 6).cast("string")))
    points = grid.select("gy", F.col("gx").alias("idx"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), (F.col("gx") * 150.0).cast("double").alias("distance_m"), text.alias("text"))
    routes = on(spark.read.parquet(path).select("user_id").distinct()).join(points, "gy").withColumnRenamed("user_id", "ride_id")
    stream = on(spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder))
    fixes = stream.select(u.alias("ride_id"), F.timestamp_millis(1_704_067_200_000 + e * 100).alias("ts"), e.alias("event_id"), (F.lit(-122.5) + F.lit(0.000131) * (e * 37 % 596)).cast("double").alias("lon"), (F.lit(47.3) + F.lit(0.0015) * F.col("gy") + F.lit(0.0004) * (e % 7 - 3)).cast("double").alias("lat"), (10 + 10 * (e % 15)).cast("double").alias("accuracy_m"))
    out = f"{shared_folder(spark)}/rides-{uuid.uuid4().hex}"
    q = V.ride_events(V.fixes_as_input(fixes), routes, idle_minutes=None).writeStream.outputMode("append").format("parquet").option("path", f"{out}/events").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(L.EVENTS).parquet(f"{out}/events").select("ride_id", F.unix_millis("ts").alias("at_ms"), "kind", "detail")


_SPOKEN = "CASE WHEN m < 160.9344 THEN concat(CAST(CAST(floor(m / 0.3048 / 10 + 0.5) * 10 AS BIGINT) AS VARCHAR), ' feet') ELSE concat(printf('%.1f', floor(m / 1609.344 * 10 + 0.5) / 10), ' miles') END"
_COMPASS = "(['north', 'northeast', 'east', 'southeast', 'south', 'southwest', 'west', 'northwest'])[CAST(floor({0} / 45.0 + 0.5) AS BIGINT) % 8 + 1]"


@query(f"""WITH G AS (SELECT o_orderkey AS id, CAST(o_custkey * 37 % 900 AS DOUBLE) AS m, o_custkey % 360 AS rb, o_custkey * 7 % 360 AS own, CASE WHEN o_custkey % 5 > 0 THEN CAST(o_custkey % 17 AS DOUBLE) END AS moved, o_custkey % 3 > 0 AS headings, coalesce(([CASE WHEN o_custkey % 4 = 0 THEN 'First St' END, CASE WHEN o_custkey % 3 = 0 THEN 'Second St' END, CASE WHEN o_custkey % 7 = 0 THEN 'Fifth St' END]), []) AS ns FROM orders),
H AS (SELECT *, coalesce(ns[1], ns[2], '') AS road, (rb - own + 540) % 360 - 180 AS delta FROM G)
SELECT id, concat('Rejoin route ', {_SPOKEN}, ' ', {_COMPASS.format('rb')}, CASE WHEN road = '' THEN '.' ELSE concat(' on ', road, '.') END) AS rejoin,
  CASE WHEN coalesce(moved >= 8, false) THEN concat(CASE WHEN delta > 115 THEN 'Turn sharply right' WHEN delta > 28 THEN 'Turn right' WHEN delta < -115 THEN 'Turn sharply left' WHEN delta < -28 THEN 'Turn left' ELSE 'Continue' END, ' onto ', CASE WHEN road = '' THEN 'the route' ELSE road END, CASE WHEN headings THEN concat(', heading ', {_COMPASS.format('rb')}) ELSE '' END, '.')
    ELSE concat('Ahead: rejoin ', CASE WHEN road = '' THEN 'the route' ELSE road END, CASE WHEN headings THEN concat(', heading ', {_COMPASS.format('rb')}) ELSE '' END, '.') END AS approach FROM H""")
def guidance_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    names = F.array(F.lit(""), F.when(c % 4 == 0, "First St").otherwise(""), F.lit(""), F.when(c % 3 == 0, "Second St").otherwise(""), F.lit(""), F.when(c % 7 == 0, "Fifth St").otherwise(""))
    g = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (c * 37 % 900).cast("double").alias("m"), (c % 360).cast("double").alias("rb"), (c * 7 % 360).cast("double").alias("own"), F.when(c % 5 > 0, (c % 17).cast("double")).alias("moved"), (c % 3 > 0).alias("headings"), L.road_ahead(names, F.lit(1)).alias("road"))
    return g.select("id", L.rejoin_text(F.col("m"), F.col("rb"), F.col("road")).alias("rejoin"), L.approach_text(F.col("rb"), F.col("own"), F.col("moved"), F.col("road"), F.col("headings")).alias("approach"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS fixes, CAST(sum(CASE WHEN off_m > 65 THEN 1 ELSE 0 END) AS BIGINT) AS off FROM gps_fixes GROUP BY 1""")
def hourly_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark-native extra: fixes and off-route fixes by hour window."""
    f = view(spark, sf_dir, "gps_fixes")
    return f.groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("fixes"), F.count_if(F.col("off_m") > L.OFF_M).alias("off")).select(F.col("window.start").alias("hour"), "fixes", "off")
