"""Packing, geometry, formats and parsing against known values."""

import math

from pyspark.sql import functions as F

from roadlattice.functions import formats, geo, nullsafe, packing, tags


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_roundings(spark):
    r = one(spark, nullsafe.round_up_half(F.lit(-2.5)).alias("a"), nullsafe.round_half_even(F.lit(2.5)).alias("b"), nullsafe.number(F.lit(" x ")).alias("c"), nullsafe.number(F.lit(" 4.5 ")).alias("d"))
    assert (r.a, r.b, r.c, r.d) == (-2, 2, None, 4.5)


def test_pack_limits(spark):
    rows = spark.createDataFrame([(127.0, True, 254.0, 70000, 2035), (None, False, None, None, None), (0.0, False, 0.0, 140, 1939)], "e double, c boolean, s double, a int, y int")
    got = rows.select(packing.pack_edge(F.col("e"), F.col("c")).alias("e"), packing.pack_shoulder(F.col("s")).alias("s"), packing.pack_adt(F.col("a")).alias("a"), packing.pack_year(F.col("y")).alias("y")).collect()
    assert [tuple(r) for r in got] == [(254, 254, 65535, 95), (255, 255, 0, 0), (0, 0, 140, 0)]


def test_geometry(spark):
    line = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(0.0).alias("lat")) for x in (0.0, 1.0, 3.0)])
    r = one(spark, geo.length_m(line).alias("m"), geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("b"), geo.heading_gap(F.lit(10.0), F.lit(175.0)).alias("g"), geo.turn(F.lit(350.0), F.lit(20.0)).alias("t"), geo.interpolate(line, 0.5).alias("i"))
    assert math.isclose(r.m, 3 * math.pi / 180 * 6371000, rel_tol=1e-9)
    assert (r.b, r.g, r.t) == (90.0, 15.0, 30.0)
    assert math.isclose(r.i.lon, 1.5)


def test_parsing(spark):
    t = lambda f, x: f(F.lit(x)).alias("v")
    assert [one(spark, t(tags.mph, x)).v for x in ("30 mph", "50", "walk")] == [30, 31, None]
    assert [one(spark, t(tags.duration_s, x)).v for x in ("35", "1:05", "0:01:30", "x")] == [2100, 3900, 90, None]
    assert one(spark, t(tags.route_numbers, "SR 99;US 2;SR 99")).v == [2, 99]


def test_formats(spark):
    r = one(spark, formats.distance(F.lit(100.0)).alias("a"), formats.distance(F.lit(5000.0)).alias("b"), formats.duration(F.lit(4000)).alias("c"), formats.compass(F.lit(350)).alias("d"))
    assert (r.a, r.b, r.c, r.d) == ("330 ft", "3.1 mi", "1 h 7 min", "north")


def test_projection_round_trip_and_origin(spark):
    """Points of the whole state come back to under 1e-8 degrees; the origin is the false easting; feet are survey feet."""
    from roadlattice.functions import projection as J

    rows = [(float(lon), float(lat)) for lon in range(-125, -116) for lat in (45.4, 46.0, 47.123456, 48.9)] + [(-120.5, 45 + 20 / 60), (None, 47.0)]
    df = spark.createDataFrame(rows, "lon double, lat double").withColumn("p", J.to_plane(F.col("lon"), F.col("lat"))).withColumn("q", J.to_lonlat(F.col("p.x"), F.col("p.y")))
    for r in df.collect():
        if r.lon is None:
            assert r.q.lon is None
            continue
        assert abs(r.q.lon - r.lon) < 1e-8 and abs(r.q.lat - r.lat) < 1e-8
        if (r.lon, r.lat) == (-120.5, 45 + 20 / 60):
            assert abs(r.p.x - 1640416.6667) < 1e-3 and abs(r.p.y) < 1e-3


def test_clipped_rings(spark):
    from roadlattice.functions import projection as J

    ring = lambda *ps: [{"lon": float(x), "lat": float(y)} for x, y in ps]
    rows = [
        (1, ring((0, 0), (4, 0), (4, 4), (0, 4)), 4.0), (2, ring((0, 0), (0, 4), (4, 4), (4, 0), (0, 0)), 4.0), (3, ring((1, 1), (2, 1), (1.5, 2)), 0.5), (4, ring((9, 9), (10, 9), (9, 10)), 0.0),
        (5, ring((-5, 2), (2, -5), (9, 2), (2, 9)), 4.0), (6, ring((0, 0), (3, 0), (3, 3), (2, 0.5)), 1.0), (7, [], 0.0), (8, None, None),
    ]
    df = spark.createDataFrame(rows, "k int, ring array<struct<lon:double,lat:double>>, want double")
    for r in df.withColumn("area", J.ring_area(J.clipped_ring(F.col("ring"), J.box(1, 1, 3, 3)))).collect():
        if r.k == 6:
            assert 0 < r.area < 2
        else:
            assert r.area == r.want
