"""Queries of tag parsing, classification and packed measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadlattice.functions import formats, packing, tags
from roadlattice.sources.adapters import read

from .registry import query

#: Tags of a part: highway, surface, cycleway and other keys from its numbers.
HIGHWAYS = [*tags.DRIVE[:8], "cycleway", "path", "footway", "construction"]
TAGS = f"""TAGS AS (SELECT p_partkey AS way_id, ({HIGHWAYS})[p_partkey % 12 + 1] AS highway, (['asphalt', 'gravel', 'dirt', 'paved', ''])[p_size % 5 + 1] AS surface, CASE p_partkey % 6 WHEN 0 THEN 'lane' WHEN 1 THEN 'track' WHEN 2 THEN 'shared_lane' END AS cycleway,
  CASE p_size % 7 WHEN 0 THEN 'no' WHEN 1 THEN 'designated' WHEN 2 THEN 'yes' END AS bicycle, CASE p_size % 11 WHEN 0 THEN 'private' WHEN 1 THEN 'no' END AS acc, CASE p_partkey % 4 WHEN 0 THEN concat(CAST(20 + p_size AS VARCHAR(9)), ' mph') WHEN 1 THEN CAST(30 + p_size AS VARCHAR(9)) END AS maxspeed,
  CASE WHEN p_partkey % 97 = 0 THEN 'ferry' END AS route, CASE p_partkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' END AS oneway, CASE WHEN p_size % 13 = 0 THEN 'no' END AS ob, CASE p_size % 3 WHEN 0 THEN CAST(p_size % 6 AS VARCHAR(9)) END AS lanes, CAST(p_size % 3 AS VARCHAR(9)) AS lf, CAST(p_size % 2 AS VARCHAR(9)) AS lb,
  CASE p_partkey % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'no' END AS sidewalk, CASE WHEN p_partkey % 37 = 0 THEN '1' END AS mtb, CASE WHEN p_size % 2 = 0 THEN 'x' END AS buf FROM part)"""


def osm_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    k, z = F.col("p_partkey"), F.col("p_size").cast("long")
    case = lambda v, table: F.get(F.array(*[F.lit(x) for x in table]), v.cast("int"))
    values = {
        "highway": pick(HIGHWAYS, k % 12), "surface": pick(["asphalt", "gravel", "dirt", "paved", ""], z % 5), "cycleway": case(k % 6, ["lane", "track", "shared_lane", None, None, None]), "bicycle": case(z % 7, ["no", "designated", "yes", None, None, None, None]),
        "access": F.when(z % 11 == 0, "private").when(z % 11 == 1, "no"), "maxspeed": F.when(k % 4 == 0, F.concat((20 + z).cast("string"), F.lit(" mph"))).when(k % 4 == 1, (30 + z).cast("string")), "route": F.when(k % 97 == 0, "ferry"),
        "oneway": F.when(k % 5 == 0, "yes").when(k % 5 == 1, "-1"), "oneway:bicycle": F.when(z % 13 == 0, "no"), "lanes": F.when(z % 3 == 0, (z % 6).cast("string")), "lanes:forward": (z % 3).cast("string"), "lanes:backward": (z % 2).cast("string"),
        "sidewalk": F.when(k % 3 == 0, "both").when(k % 3 == 1, "no"), "mtb": F.when(k % 37 == 0, "1"), "cycleway:buffer": F.when(z % 2 == 0, "x"),
    }
    made = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in values.items()]), lambda e: e["value"].isNotNull()))
    return p.select(k.alias("way_id"), made.alias("tags"))


_FACILITY = "CASE WHEN highway = 'cycleway' OR (highway IN ('path', 'footway') AND bicycle IN ('designated', 'yes')) THEN 5 WHEN cycleway = 'track' THEN 4 WHEN cycleway = 'lane' AND buf IS NOT NULL THEN 3 WHEN cycleway = 'lane' THEN 2 WHEN cycleway = 'shared_lane' THEN 1 ELSE 0 END"


@query(f"""WITH {TAGS} SELECT way_id, CASE WHEN acc IS NOT NULL AND NOT coalesce(bicycle IN ('yes', 'designated', 'permissive'), false) THEN NULL WHEN coalesce(bicycle = 'no', false) AND NOT highway IN ('footway', 'pedestrian') THEN NULL
  WHEN route = 'ferry' THEN 'ferry' WHEN {_FACILITY} = 5 THEN 'infra' WHEN highway IN {tuple(tags.DRIVE)} THEN 'drive' WHEN highway IN {tuple(tags.PATHS)} THEN 'walk-link' END AS admitted, mtb IS NOT NULL AS mtb FROM TAGS""")
def classify_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return osm_ways(spark, sf_dir).select("way_id", tags.admitted().alias("admitted"), tags.is_mtb().alias("mtb"))


@query(f"""WITH {TAGS} SELECT way_id, CAST({_FACILITY} AS BIGINT) AS facility, CAST(CASE WHEN surface IN ('asphalt', 'paved') THEN 1 WHEN surface = 'gravel' THEN 2 WHEN surface = 'dirt' THEN 3 ELSE 0 END AS BIGINT) AS surface,
  CAST(coalesce(CAST(lanes AS BIGINT), nullif(CAST(lf AS BIGINT) + CAST(lb AS BIGINT), 0), 0) AS BIGINT) AS lanes, CASE sidewalk WHEN 'both' THEN 'present' WHEN 'no' THEN 'absent' END AS sidewalk,
  CAST(CASE WHEN ob = 'no' THEN 0 WHEN oneway = 'yes' THEN 1 WHEN oneway = '-1' THEN -1 ELSE 0 END AS BIGINT) AS one_way FROM TAGS""")
def lane_surface_facility(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = {"facility": tags.facility_class(), "surface": tags.surface_class(), "lanes": tags.lanes(), "one_way": tags.one_way()}
    return osm_ways(spark, sf_dir).select("way_id", *[c.cast("long").alias(n) for n, c in whole.items()], tags.sidewalk_class().alias("sidewalk"))


@query(f"""WITH {TAGS} SELECT way_id, CAST(round_even(CASE WHEN maxspeed LIKE '%mph' THEN CAST(regexp_extract(maxspeed, '^[0-9]+') AS DOUBLE) ELSE CAST(maxspeed AS DOUBLE) * 0.621371 END, 0) AS BIGINT) AS mph,
  CAST(CASE highway WHEN 'motorway' THEN 65 WHEN 'trunk' THEN 55 WHEN 'primary' THEN 50 WHEN 'secondary' THEN 45 WHEN 'tertiary' THEN 35 WHEN 'unclassified' THEN 35 WHEN 'residential' THEN 25 WHEN 'living_street' THEN 15 END AS BIGINT) AS default_mph,
  CAST(CASE way_id % 3 WHEN 0 THEN way_id % 90 * 60 WHEN 1 THEN way_id % 5 * 3600 + way_id % 60 * 60 ELSE way_id % 5 * 3600 + way_id % 60 * 60 + way_id % 50 END AS BIGINT) AS seconds FROM TAGS""")
def parse_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("way_id")
    s = lambda c: c.cast("string")
    text = F.when(k % 3 == 0, s(k % 90)).when(k % 3 == 1, F.concat_ws(":", s(k % 5), s(k % 60))).otherwise(F.concat_ws(":", s(k % 5), s(k % 60), s(k % 50)))
    return osm_ways(spark, sf_dir).select("way_id", tags.mph(tags.tag("maxspeed")).cast("long").alias("mph"), tags.default_mph().cast("long").alias("default_mph"), tags.duration_s(text).cast("long").alias("seconds"))


@query(f"""WITH {TAGS} SELECT CASE WHEN highway = 'construction' THEN 'construction' WHEN acc IS NOT NULL THEN 'closed to the public' WHEN bicycle = 'no' THEN 'no bicycles' END AS reason, count(*) AS ways FROM TAGS GROUP BY 1""")
def closure_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return osm_ways(spark, sf_dir).groupBy(tags.closure_reason().alias("reason")).agg(F.count("*").alias("ways"))


_PLACES = "PLACES AS (SELECT c_custkey AS id, concat('Place ', CAST(c_custkey % 300 AS VARCHAR(9))) AS name, (['city', 'town', 'village', 'hamlet'])[c_custkey % 4 + 1] AS kind, c_custkey * 977 % 300000 AS population FROM customer)"


@query(f"""WITH {_PLACES}, D AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), kind ORDER BY id) AS k FROM PLACES) WHERE k = 1)
SELECT id, name, kind, row_number() OVER (PARTITION BY kind ORDER BY population DESC, name) AS place, CAST(CASE kind WHEN 'city' THEN CASE WHEN population >= 200000 THEN 4 WHEN population >= 50000 THEN 6 ELSE 7 END WHEN 'town' THEN CASE WHEN population >= 10000 THEN 8 ELSE 9 END WHEN 'village' THEN 11 ELSE 12 END AS BIGINT) AS min_zoom FROM D""")
def place_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    places = read(spark, sf_dir, "customer").select(c.alias("id"), F.concat(F.lit("Place "), (c % 300).cast("string")).alias("name"), F.get(F.array(*[F.lit(x) for x in ("city", "town", "village", "hamlet")]), (c % 4).cast("int")).alias("kind"), (c * 977 % 300000).alias("population"))
    first = places.groupBy(F.lower("name").alias("key"), "kind").agg(F.min(F.struct("id", "name", "population")).alias("p")).select("kind", "p.*")
    return first.select("id", "name", "kind", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("population"), "name")).cast("long").alias("place"), tags.place_zoom().cast("long").alias("min_zoom"))


@query("""WITH M AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN (p_size * 3 + p_partkey % 2 * 0.5) END AS edge, p_partkey % 3 = 0 AS clamp, CASE WHEN p_partkey % 4 <> 0 THEN p_size * 6 END AS sh, CASE WHEN p_partkey % 6 <> 0 THEN p_partkey * 377 % 90000 END AS adt, 1930 + p_partkey % 150 AS year, p_partkey % 9 AS fc, p_partkey % 6 AS owner FROM part)
SELECT id, CAST(CASE WHEN edge IS NOT NULL THEN least(126, round_even(edge, 0)) END AS BIGINT) AS edge_space, edge IS NOT NULL AND clamp AS edge_clamp, CAST(CASE WHEN sh IS NOT NULL THEN least(254, sh) END AS BIGINT) AS shoulder, CAST(nullif(least(65535, coalesce(adt, 0)), 0) AS BIGINT) AS adt,
  CAST(CASE WHEN year > 1940 AND year <= 2067 THEN year END AS BIGINT) AS year, CAST(CASE WHEN fc BETWEEN 1 AND 7 THEN fc END AS BIGINT) AS fc, CAST(CASE WHEN owner BETWEEN 1 AND 4 THEN owner END AS BIGINT) AS owner FROM M""")
def measure_pack_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    edge = F.when(k % 5 != 0, z * 3 + (k % 2) * 0.5)
    packed = read(spark, sf_dir, "part").select(
        k.alias("id"), packing.pack_edge(edge, k % 3 == 0).alias("e"), packing.pack_shoulder(F.when(k % 4 != 0, (z * 6).cast("double"))).alias("s"), packing.pack_adt(F.when(k % 6 != 0, k * 377 % 90000)).alias("a"), packing.pack_year((1930 + k % 150).cast("int")).alias("y"), packing.pack_class((k % 9).cast("int"), (k % 6).cast("int")).alias("c"),
    )
    whole = {"edge_space": packing.unpack_edge(F.col("e"))["edge_space"], "shoulder": packing.unpack_shoulder(F.col("s")), "adt": packing.unpack_adt(F.col("a")), "year": packing.unpack_year(F.col("y")), "fc": packing.unpack_class(F.col("c"))["fc"], "owner": packing.unpack_class(F.col("c"))["owner"]}
    return packed.select("id", packing.unpack_edge(F.col("e"))["edge_clamp"].alias("edge_clamp"), *[c.cast("long").alias(n) for n, c in whole.items()])


@query("""WITH R AS (SELECT p_partkey AS id, CAST(18 + p_size AS DOUBLE) AS w, 1 + p_partkey % 4 AS n FROM part)
SELECT id, round(greatest(0, (w - CASE WHEN w / n > 13 THEN least(w / n, 12.0) ELSE w / n END * n) / 2), 6) AS space, w / n > 13 AS clamped FROM R""")
def edge_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), packing.edge_space_ft((18 + F.col("p_size")).cast("double"), 1 + F.col("p_partkey") % 4).alias("e"))
    return r.select("id", F.round("e.space", 6).alias("space"), "e.clamped")


@query("""SELECT o_orderkey AS id, CASE WHEN m < 1609.344 / 5 THEN concat(CAST(CAST(floor(m / 0.3048 / 10 + 0.5) * 10 AS BIGINT) AS VARCHAR), ' ft') WHEN m / 1609.344 >= 10 THEN concat(CAST(CAST(floor(m / 1609.344 + 0.5) AS BIGINT) AS VARCHAR), ' mi') ELSE concat(printf('%.1f', floor(m / 1609.344 * 10 + 0.5) / 10), ' mi') END AS distance,
  CASE WHEN floor(s / 60.0 + 0.5) < 60 THEN concat(CAST(CAST(greatest(floor(s / 60.0 + 0.5), 1) AS BIGINT) AS VARCHAR), ' min') ELSE concat(CAST(CAST(floor(floor(s / 60.0 + 0.5) / 60) AS BIGINT) AS VARCHAR), ' h ', CAST(CAST(floor(s / 60.0 + 0.5) AS BIGINT) % 60 AS VARCHAR), ' min') END AS duration,
  (['north', 'northeast', 'east', 'southeast', 'south', 'southwest', 'west', 'northwest'])[CAST(floor(b / 45.0 + 0.5) AS BIGINT) % 8 + 1] AS compass FROM (SELECT o_orderkey, CAST(o_custkey * 37 % 30000 AS DOUBLE) AS m, o_custkey * 53 % 9000 AS s, o_custkey % 360 AS b FROM orders)""")
def text_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), formats.distance((c * 37 % 30000).cast("double")).alias("distance"), formats.duration(c * 53 % 9000).alias("duration"), formats.compass(c % 360).alias("compass"))
