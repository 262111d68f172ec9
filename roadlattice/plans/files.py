"""Queries of pages, files of bounded size, and the preview of a route."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlattice.operators import etl as E
from roadlattice.operators import reporting as R
from roadlattice.operators import sequences as S
from roadlattice.operators.graph import shared_folder
from roadlattice.sources import pages as G
from roadlattice.sources.adapters import read, view

from .registry import query
from .routes import _STYLE


@query("SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS nation, CAST(s_suppkey AS DOUBLE) AS x FROM supplier WHERE s_nationkey >= 12 AND s_nationkey IS NOT NULL")
def verified_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a service gives them, read by the paged source: every page checked, the comparison pushed to it."""
    k = F.col("s_suppkey")
    path = F.array(F.array(F.array(k.cast("double"), F.lit(0.0)), F.array(k.cast("double"), F.lit(1.0))))
    records = read(spark, sf_dir, "supplier").select("s_suppkey", F.struct(k.alias("id"), F.col("s_nationkey").cast("long").alias("nation")).alias("attributes"), F.struct(path.alias("paths")).alias("geometry"))
    first = records.agg(F.min("s_suppkey").alias("first"))  # keys follow each other, so a page is a range of 25 of them
    folder = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    G.write_pages(records.crossJoin(F.broadcast(first)), folder, F.floor((F.col("s_suppkey") - F.col("first")) / 25))  # one row
    lines = E.lines(G.paged(spark, folder, "id long, nation long", page_rows=25).where("nation >= 12"))
    return lines.select("id", "nation", F.get("line", F.lit(0))["lon"].alias("x"))


_LONG = "CASE WHEN p_partkey % 97 = 7 THEN 400 ELSE 1 + p_partkey % 5 END"


@query(f"""WITH f AS (SELECT p_partkey AS id, 1 + strlen(concat('{{"type":"Feature","properties":{{"id":', p_partkey, ',"name":"', repeat(p_brand, CAST({_LONG} AS BIGINT)), '"}},"geometry":{{"type":"Point","coordinates":"[', p_partkey, ',0]"}}}}')) AS b FROM part),
r AS (SELECT id, b, sum(CASE WHEN b <= 2000 THEN b ELSE 0 END) OVER w - CASE WHEN b <= 2000 THEN b ELSE 0 END AS s, CASE WHEN b > 2000 THEN sum(CASE WHEN b > 2000 THEN 1 ELSE 0 END) OVER w ELSE 0 END AS alone FROM f WINDOW w AS (ORDER BY id))
SELECT concat(CAST(floor(s / 2000) AS BIGINT), '-', CAST(alone AS BIGINT)) AS file, count(*) AS lines, CAST(sum(b) AS BIGINT) AS bytes, min(id) AS first_id, max(id) AS last_id FROM r GROUP BY 1""")
def bounded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer written in files of 4000 bytes at most (but for longer lines), read again and measured."""
    k = F.col("p_partkey")
    f = read(spark, sf_dir, "part").select(k.alias("id"), F.expr(f"repeat(p_brand, CAST({_LONG} AS INT))").alias("name"), F.lit("Point").alias("geometry_type"), F.concat(F.lit("["), k.cast("string"), F.lit(",0]")).alias("coordinates"))
    path = f"{shared_folder(spark)}/bounded-{uuid.uuid4().hex}"
    E.write_bounded(f, path, ["id"], max_bytes=4000, grouped=True)
    written = E.read_bounded(spark, path)
    number = F.get_json_object("value", "$.properties.id").cast("long")
    return written.groupBy("file").agg(F.count("*").alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.min(number).alias("first_id"), F.max(number).alias("last_id"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS name, 'Point' AS geometry_type, c_custkey AS x, CAST(c_nationkey AS BIGINT) AS y FROM customer")
def geojson_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature collections, a compressed file for each hundred customers, read as a layer."""
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(k.alias("id"), F.when(k % 4 > 0, F.col("c_mktsegment")).alias("name")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(k, n).alias("coordinates")).alias("geometry"))
    files = read(spark, sf_dir, "customer").groupBy(F.floor(k / 100).alias("k")).agg(F.collect_list(feature).alias("features"))
    path = f"{shared_folder(spark)}/collections-{uuid.uuid4().hex}"
    files.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    place = F.from_json("coordinates", "array<bigint>")
    return E.read_geojson(spark, path, "id long, name string").select("id", "name", "geometry_type", F.get(place, F.lit(0)).alias("x"), F.get(place, F.lit(1)).alias("y"))


@query(f"""WITH n AS (SELECT *, 1 + edge_id % 3 AS n FROM route_segments), s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY route_id ORDER BY seq) AS BIGINT) AS c1, {_STYLE} AS style FROM n),
x AS (SELECT route_id, unnest(range(c1 - n, c1)) AS i FROM s), g AS (SELECT route_id, greatest(1, max(c1)) AS longest FROM s GROUP BY 1),
p AS (SELECT route_id, i, row_number() OVER (PARTITION BY route_id ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY route_id) AS m FROM x WHERE i % 5 <> 3),
q AS (SELECT route_id, pos, CASE WHEN i % 23 <> 5 THEN CAST(i AS DOUBLE) ELSE longest * pos / CAST(greatest(1, m - 1) AS DOUBLE) END AS spot FROM p JOIN g USING (route_id)),
e AS (SELECT route_id, pos, (spot + lead(spot) OVER (PARTITION BY route_id ORDER BY pos)) / 2 AS mid FROM q), h AS (SELECT route_id, pos, max(mid) OVER (PARTITION BY route_id ORDER BY pos) AS hi FROM e WHERE mid IS NOT NULL),
j AS (SELECT h.route_id, pos, coalesce(min(seq) FILTER (WHERE c1 > hi), max(seq)) AS seq FROM h JOIN s ON h.route_id = s.route_id GROUP BY 1, 2)
SELECT j.route_id, CAST(j.pos AS BIGINT) AS pos, j.seq, s.style, s.surface >= 2 AS unpaved, s.dismount FROM j JOIN s ON j.route_id = s.route_id AND j.seq = s.seq""")
def preview_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of each route's simplified preview with what the segment under them shows."""
    seg = view(spark, sf_dir, "route_segments").withColumn("n", 1 + F.col("edge_id") % 3)
    seg = seg.withColumn("c1", F.sum("n").over(S.along()))
    i = F.explode(F.sequence(F.col("c1") - F.col("n"), F.col("c1") - 1)).alias("i")
    kept = seg.select("route_id", i).where("i % 5 <> 3")
    points = kept.select("route_id", F.col("i").alias("pos"), F.when(F.col("i") % 23 != 5, F.col("i")).alias("route_index"))
    numbered = points.withColumn("pos", (F.row_number().over(S.along(order=["pos"])) - 1).cast("long"))
    shown = seg.select("route_id", "seq", F.coalesce(R.category(), F.lit("ferry")).alias("style"), (F.col("surface") >= 2).alias("unpaved"), "dismount")
    return S.previewed(seg, numbered).join(shown, ["route_id", "seq"]).select("route_id", "pos", "seq", "style", "unpaved", "dismount")
