"""Sequence operators over ordered segments: islands, running sums, sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUTE, SEQ = ["route_id"], ["seq"]


def along(keys=ROUTE, order=SEQ):
    return Window.partitionBy(*keys).orderBy(*order)


def islands(df: DataFrame, key: Column, name: str = "island", keys=ROUTE, order=SEQ, breaks: Column | None = None) -> DataFrame:
    """Number the runs of equal consecutive keys (nulls equal) from 0; ``breaks`` begins a run too."""
    w = along(keys, order)
    marked = df.withColumn("__key", key)
    begin = ~F.lag("__key").over(w).eqNullSafe(F.col("__key")) & F.lag(F.lit(1)).over(w).isNotNull()
    if breaks is not None:
        begin = begin | (breaks & F.lag(F.lit(1)).over(w).isNotNull())
    return marked.withColumn("__begin", begin.cast("int")).withColumn(name, F.sum("__begin").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__key", "__begin")


def running(df: DataFrame, length: str = "len_m", keys=ROUTE, order=SEQ) -> DataFrame:
    """start_m and end_m: distance along the sequence before and after each row."""
    total = F.sum(length).over(along(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("end_m", total).withColumn("start_m", F.col("end_m") - F.col(length))


def sections(df: DataFrame, key: Column, keys=ROUTE, order=SEQ) -> DataFrame:
    """Runs of equal keys merged: key, first position, number of segments and metres."""
    runs = islands(df.withColumn("section_key", key), key, keys=keys, order=order)
    return runs.groupBy(*keys, "island", "section_key").agg(F.min(order[0]).alias("first_seq"), F.count("*").alias("segments"), F.sum("len_m").alias("metres"))


def short_crossings(df: DataFrame, most_m: int = 40) -> DataFrame:
    """Runs of level 4 (not freeway) of at most most_m metres with other segments on both sides become crossings of level 2."""
    failing = (F.col("level") == 4) & ~F.col("freeway")
    runs = islands(df.withColumn("fails", failing), F.col("fails"))
    whole = Window.partitionBy("route_id", "island")
    per_run = runs.withColumn("run_m", F.sum("len_m").over(whole)).withColumn("first", F.min("seq").over(whole)).withColumn("last", F.max("seq").over(whole))
    ends = Window.partitionBy("route_id")
    bounded = (F.col("first") > F.min("seq").over(ends)) & (F.col("last") < F.max("seq").over(ends))
    cross = F.col("fails") & bounded & (F.col("run_m") <= most_m)
    return per_run.withColumn("crossing", cross).withColumn("level", F.when(cross, 2).otherwise(F.col("level")))


def tagged_dismounts(df: DataFrame, over_m: int = 100) -> DataFrame:
    """Dismount segments have level 3 at least; a contiguous tagged run over over_m metres has level 4."""
    runs = islands(df.withColumn("tagged", F.col("dismount") & F.col("dismount_tagged")), F.col("tagged"), "tag_run")
    run_m = F.sum("len_m").over(Window.partitionBy("route_id", "tag_run"))
    level = F.when(F.col("tagged") & (run_m > over_m), 4).when(F.col("dismount"), F.greatest("level", F.lit(3))).otherwise(F.col("level"))
    return runs.withColumn("run_m", run_m).withColumn("level", level)


def _credible(df: DataFrame) -> DataFrame:
    """Segments on land with what of their grade is believed: nothing over 40 % or on under 20 m."""
    grade = F.when((F.abs(F.col("grade_pct")) <= 40) & (F.col("len_m") >= 20), F.col("grade_pct")).otherwise(0).cast("double")
    return islands(df.where("len_m > 0"), F.col("ferry"), "leg").where(~F.col("ferry")).withColumn("g", grade)


def grade_windows(df: DataFrame, window_m: int = 100) -> DataFrame:
    """(route_id, seq, from_seq, mean): mean grade of the window_m metres that end with each segment.

    The rise to a point is a running sum; a window begins inside the segment that holds its start (found by a merge on
    running distance, see as_of), whose part is taken in proportion. Ferries end an island. Only whole windows count.
    """
    keys = ["route_id", "leg"]
    run = running(_credible(df), keys=keys)
    rise = F.col("g") * F.col("len_m")
    run = run.withColumn("rise_end", F.sum(rise).over(along(keys).rowsBetween(Window.unboundedPreceding, 0))).withColumn("rise_start", F.col("rise_end") - rise)
    ends = run.where(F.col("end_m") >= window_m).select(*keys, "seq", "end_m", "rise_end", (F.col("end_m") - window_m).alias("from_m"))
    starts = run.select(*keys, F.col("seq").alias("from_seq"), F.col("start_m").alias("s0"), F.col("rise_start").alias("r0"), F.col("g").alias("g0"))
    windows = as_of(ends, starts, keys, "from_m", "s0", "from_seq")
    mean = (F.col("rise_end") - (F.col("r0") + F.col("g0") * (F.col("from_m") - F.col("s0")))) / (F.col("end_m") - F.col("from_m"))
    return windows.select("route_id", "seq", "from_seq", mean.alias("mean"))


def sustained_grade(df: DataFrame, window_m: int = 100) -> DataFrame:
    """Per route: length-weighted mean of grades above 0.5 % and the steepest mean over window_m metres (see grade_windows)."""
    steepest = grade_windows(df, window_m).groupBy("route_id").agg(F.max("mean").alias("max_grade"))
    up = _credible(df).where("g > 0.5").groupBy("route_id").agg((F.sum(F.col("g") * F.col("len_m")) / F.sum("len_m")).alias("avg_up"))
    tenth = lambda c: F.floor(F.coalesce(c, F.lit(0.0)) * 10 + 0.5) / 10
    return df.select("route_id").distinct().join(steepest, "route_id", "left").join(up, "route_id", "left").select("route_id", tenth(F.greatest(F.col("max_grade"), F.lit(0.0))).alias("max_grade"), tenth(F.col("avg_up")).alias("avg_up"))


def downsample(df: DataFrame, most: int) -> DataFrame:
    """Every k-th row of a sequence and always the last, at most about ``most`` rows."""
    w = Window.partitionBy("route_id")
    n, i = F.count("*").over(w), F.row_number().over(along()) - 1
    step = F.greatest(F.lit(1), F.ceil(n / F.lit(most)))
    return df.withColumn("n", n).withColumn("i", i).withColumn("step", step).where((F.col("i") % F.col("step") == 0) | (F.col("i") == F.col("n") - 1)).drop("n", "step")


def worst_by_bucket(df: DataFrame, buckets: int) -> DataFrame:
    """Worst level in each of ``buckets`` equal parts of a sequence."""
    n, i = F.count("*").over(Window.partitionBy("route_id")), F.row_number().over(along()) - 1
    placed = df.withColumn("bucket", F.floor(i * buckets / n))
    return placed.groupBy("route_id", "bucket").agg(F.max("level").alias("worst"))


def as_of(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, order: str) -> DataFrame:
    """Each point with the columns of the span of its key that begins last at or before it; of spans that begin together the last by
    ``order``. Points and spans are sorted into one sequence, so a key's rows meet once and nothing is paired; points
    before every span are dropped. Column names of both sides must differ but for the keys."""
    of_span, of_point = [c for c in spans.columns if c not in keys], [c for c in points.columns if c not in keys]
    s = spans.select(*keys, F.col(start).alias("__at"), F.lit(0).alias("__side"), F.col(order).alias("__order"), F.struct(*of_span).alias("__span"), F.lit(None).alias("__point"))
    p = points.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).alias("__order"), F.lit(None).alias("__span"), F.struct(*of_point).alias("__point"))
    w = Window.partitionBy(*keys).orderBy("__at", "__side", "__order").rowsBetween(Window.unboundedPreceding, 0)
    met = s.unionAll(p).withColumn("__span", F.last("__span", ignorenulls=True).over(w))
    return met.where((F.col("__side") == 1) & F.col("__span").isNotNull()).select(*keys, "__point.*", "__span.*")


def at_distance(df: DataFrame, points: DataFrame) -> DataFrame:
    """points(route_id, at_m) -> the segment that holds each distance (the last one beyond the end; none before the start)."""
    spans = running(df).select("route_id", "seq", "start_m")
    return as_of(points.select("route_id", "at_m"), spans, ROUTE, "at_m", "start_m", "seq").select("route_id", "at_m", "seq", (F.col("at_m") - F.col("start_m")).alias("into_m"))


def previewed(segments: DataFrame, points: DataFrame) -> DataFrame:
    """segments(route_id, seq, c1), points(route_id, pos, route_index) -> (route_id, pos, seq): the segment that each edge
    from one point of a preview to the next shows.

    c1 is where a segment ends in the route's own coordinates. An edge shows the first segment that ends after its middle (the last one
    beyond all ends); it never shows a segment before that of an edge before it, and none behind a segment without an end.
    Points without an index are spread evenly over the route. A route of one point has no edges.
    """
    route = Window.partitionBy("route_id")
    before = along().rowsBetween(Window.unboundedPreceding, -1)
    spans = segments.select("route_id", "seq", F.lag("c1").over(along()).alias("begin"), F.coalesce(F.bool_or(F.col("c1").isNull()).over(before), F.lit(False)).alias("cut"))
    spans = spans.where("not cut").select("route_id", "seq", F.coalesce(F.col("begin").cast("double"), F.lit(float("-inf"))).alias("begin"))
    longest = segments.groupBy("route_id").agg(F.greatest(F.lit(1), F.coalesce(F.max("c1"), F.lit(1))).alias("longest"))
    by_pos = route.orderBy("pos")
    placed = points.join(longest, "route_id").withColumn("place", F.row_number().over(by_pos) - 1).withColumn("n", F.count("*").over(route))
    even = F.col("longest") * F.col("place") / F.greatest(F.lit(1), F.col("n") - 1)
    placed = placed.withColumn("i", F.coalesce(F.col("route_index").cast("double"), even))
    middle = placed.withColumn("middle", (F.col("i") + F.lead("i").over(by_pos)) / 2).where(F.col("middle").isNotNull())
    edges = middle.select("route_id", "pos", F.max("middle").over(by_pos.rowsBetween(Window.unboundedPreceding, 0)).alias("at"))
    return as_of(edges, spans, ROUTE, "at", "begin", "seq").select("route_id", "pos", "seq")
