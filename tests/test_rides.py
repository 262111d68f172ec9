"""Match and guidance as one stateful stream."""

import datetime
import random
import time

from pyspark.sql import functions as F

from roadlattice.streaming import rides

FIX = "ride_id long, ts timestamp, event_id long, lon double, lat double, accuracy_m double"
POINT = "ride_id long, idx long, lon double, lat double, distance_m double, text string"


def made(n_rides, n_fixes):
    r = random.Random(5)
    points = [(k, i, -122.5 + 0.002 * i, 47.0 + k, 150.0 * i, f"turn {i}" if i % 6 == 5 else None) for k in range(n_rides) for i in range(40)]
    fixes = []
    for k in range(n_rides):
        for j in range(n_fixes):
            at = datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=8 * j)
            fixes.append((k, at, j, -122.5 + 0.078 * (j + 1) / n_fixes, 47.0 + k + (r.choice((0, 0, 0, 0.0003, 0.0007, 0.0011, 0.003)) if j < n_fixes - 4 else 0), float(r.choice((5, 5, 70, 150)))))
    return fixes, points


def run(spark, folder, routes, **args):
    stream = spark.readStream.schema(rides.INPUT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = rides.ride_events(stream, routes, **args).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()))


def test_a_restarted_stream_equals_the_batch_run(spark, tmp_path):
    fixes, points = made(4, 60)
    table, routes = spark.createDataFrame(fixes, FIX), spark.createDataFrame(points, POINT)
    known, late = routes.where("ride_id < 3"), routes.where("ride_id = 3")
    write = lambda df: df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    write(rides.fixes_as_input(table.where("event_id < 20 and ride_id <> 3")))
    first = run(spark, tmp_path, known, idle_minutes=None)
    # after a restart the initial state is not read again, and a new ride's route comes with its fixes
    late_rows = late.select("ride_id", F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("event_id"), "lon", "lat", F.lit(None).cast("double").alias("accuracy_m"), "idx", "distance_m", "text")
    write(rides.fixes_as_input(table.where("event_id between 20 and 39 or ride_id = 3 and event_id < 20")).unionByName(late_rows))
    second = run(spark, tmp_path, known.where("false"), idle_minutes=None)
    write(rides.fixes_as_input(table.where("event_id > 39")))
    third = run(spark, tmp_path, known.where("false"), idle_minutes=None)
    want = sorted(map(tuple, rides.ride_events_batch(table, routes).collect()))
    assert third == want and set(first) < set(second) < set(third)
    assert {k for _, _, k, _ in want} >= {"off-route", "rejoined", "now", "arrived"} and {r for r, *_ in want} == {0, 1, 2, 3}


def test_idle_rides_are_forgotten_and_rides_without_a_route_pass(spark, tmp_path):
    fixes, points = made(2, 30)
    table, routes = spark.createDataFrame(fixes, FIX), spark.createDataFrame(points, POINT).where("ride_id = 0")
    write = lambda test: rides.fixes_as_input(table.where(test)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else a stream with timers never ends by itself
    try:
        write("event_id < 15")
        first = run(spark, tmp_path, routes, idle_minutes=0)
        assert first and {r for r, *_ in first} == {0}
        time.sleep(1)
        write("ride_id = 1 and event_id = 15")  # any batch lets ride 0's timer clear it, with its route
        run(spark, tmp_path, routes, idle_minutes=0)
        write("event_id > 15")
        assert run(spark, tmp_path, routes, idle_minutes=0) == first
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
