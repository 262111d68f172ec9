"""Totals, shares and listings of a route's segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlattice.functions import formats

from .sequences import grade_windows, islands

#: Speed bands of the report, in mph.
BANDS = (35, 45, 55)


def _metres(test: Column) -> Column:
    return F.sum(F.when(test, F.col("len_m")).otherwise(0)).cast("bigint")


def totals(df: DataFrame, by: list[str]) -> DataFrame:
    """Metres of a route by what its segments are; sums of legs add up to sums of routes."""
    land = ~F.col("ferry")
    named = {
        "dist": F.lit(True), "fail": (F.col("level") == 4) & land, "ferry_m": F.col("ferry"), "designated_m": F.col("designated"), "facility_m": F.col("facility") >= 2, "trail_m": F.col("infra") | (F.col("facility") == 5),
        "mtb_m": F.col("mtb"), "dismount_m": F.col("dismount"), "residential_m": F.col("residential"), "freeway_m": F.col("freeway"), "limited_m": F.col("limited_access"), "hazard_m": F.col("hazard") >= 2,
        "unpaved_m": F.col("surface") >= 2, "fast_bare_m": (F.col("mph") >= 30) & (F.col("sh") < 4) & (F.col("facility") < 2) & land,
    }
    bands = {f"over_{b}_m": F.col("mph") >= b for b in BANDS}
    levels = F.array(*[_metres(F.col("level") == k) for k in range(5)])
    return df.groupBy(*by).agg(*[_metres(c).alias(n) for n, c in (named | bands).items()], levels.alias("level_m"), F.max("mph").alias("max_mph"), F.sum(F.col("mph") * F.col("len_m")).cast("bigint").alias("mph_m"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Totals of wholes from totals of parts."""
    sums = [c for c in parts.columns if c.endswith("_m") and c != "level_m" or c in ("dist", "fail")]
    levels = F.array(*[F.sum(F.get("level_m", F.lit(k))) for k in range(5)])
    return parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums], levels.alias("level_m"), F.max("max_mph").alias("max_mph"))


def category() -> Column:
    """Display category of a segment; ferries have none."""
    return (
        F.when(F.col("ferry"), None).when(F.col("level") == 4, "fail").when(F.col("level") == 3, "caution").when(F.col("infra") | (F.col("facility") == 5), "trail").when(F.col("facility") >= 2, "bike").otherwise("pass")
    )


def percentages(df: DataFrame, by: list[str], name: str, value: str) -> DataFrame:
    """Whole percentages that add up to 100 per group, at least 1 for what is not 0.

    Shares are rounded down (raised to 1); what is missing goes, one each, to the largest remainders, or if too much
    was given, comes off those with the largest excess that keep 1. Ties by name.
    """
    g = Window.partitionBy(*by)
    total = F.sum(value).over(g)
    raw = F.col(value) * 100.0 / F.nullif(total, F.lit(0))
    base = df.withColumn("raw", raw).withColumn("pct", F.when(F.col(value) > 0, F.greatest(F.lit(1), F.floor(F.col("raw")))).otherwise(0))
    base = base.withColumn("short", 100 - F.sum("pct").over(g))
    more = F.row_number().over(g.orderBy(F.desc(F.when(F.col(value) > 0, F.col("raw") - F.col("pct")).otherwise(-1000.0)), name))
    base = base.withColumn("rank_up", more)
    takes = F.when(F.col("pct") > 1, F.col("pct") - 1).otherwise(0)
    room = F.sum(takes).over(g.orderBy(F.desc(F.col("pct") - F.col("raw")), name).rowsBetween(Window.unboundedPreceding, 0))
    base = base.withColumn("room", room).withColumn("takes", takes)
    off = F.greatest(F.lit(0), F.least(F.col("takes"), -F.col("short") - (F.col("room") - F.col("takes"))))
    pct = F.when(F.col("raw").isNull(), 0).when(F.col("short") > 0, F.col("pct") + F.when(F.col("rank_up") <= F.col("short"), 1).otherwise(0)).otherwise(F.col("pct") - off)
    return base.select(*by, name, value, pct.cast("bigint").alias("pct"))


def concerns(df: DataFrame) -> DataFrame:
    """Concern families: runs of equal name and kind, consolidated by name: metres, times, worst edge, risk."""
    kind = (
        F.when((F.col("level") == 4) & F.col("freeway"), "freeway").when(F.col("level") == 4, "failing").when(F.col("dismount"), "dismount").when(F.col("grade_pct") > 10, "steep")
        .when(F.col("limited_access"), "limited").when(F.col("lts") >= 4, "high-stress").when(F.col("mtb"), "mtb").when(F.col("hazard") >= 3, "curve").when(F.col("surface") >= 2, "unpaved")
    )
    risk = F.col("level") * 1000 + F.col("mph") * 10 + F.col("lanes")
    road = F.when(F.col("name") == "", "Unnamed road").otherwise(F.col("name"))
    marked = df.where(~F.col("ferry")).select("route_id", "seq", "len_m", kind.alias("kind"), road.alias("road"), risk.alias("risk"), "edge_id")
    runs = islands(marked, F.struct("kind", "road")).where("kind is not null")
    runs = runs.groupBy("route_id", "island", "kind", "road").agg(F.sum("len_m").alias("m"), F.max(F.struct("risk", F.col("len_m"), (-F.col("edge_id")).alias("e"))).alias("w"))
    return runs.groupBy("route_id", "kind", "road").agg(F.sum("m").alias("metres"), F.count("*").alias("times"), F.max("w.risk").alias("risk"), (-F.max("w").getField("e")).alias("worst_edge"))


def steps(df: DataFrame, bridge_m: int = 100) -> DataFrame:
    """Turn-by-turn steps: runs of one name; an unnamed run of at most bridge_m metres between runs of the same name is folded into them."""
    runs = islands(df, F.col("name")).groupBy("route_id", "island", "name").agg(F.min("seq").alias("first_seq"), F.sum("len_m").alias("m"))
    w = Window.partitionBy("route_id").orderBy("island")
    before, after = F.lag("name").over(w), F.lead("name").over(w)
    folded = runs.withColumn("as_name", F.when((F.col("name") == "") & (F.col("m") <= bridge_m) & (before == after), before).otherwise(F.col("name")))
    again = islands(folded, F.col("as_name"), "step", order=["island"])
    return again.groupBy("route_id", "step", F.col("as_name").alias("name")).agg(F.min("first_seq").alias("first_seq"), F.sum("m").alias("metres"))


#: Grade over which a sustained climb is a concern.
STEEP_PCT = 10.0


def steep_climbs(df: DataFrame, over_pct: float = STEEP_PCT, window_m: int = 100) -> DataFrame:
    """Sustained climbs: windows over the grade, merged while they follow each other on one road: first and last segment,
    metres, steepest mean to a tenth."""
    w = grade_windows(df, window_m).withColumn("pct", F.floor(F.col("mean") * 10 + 0.5) / 10).where(F.col("pct") > over_pct)
    road = F.when(F.col("name") == "", "Unnamed road").otherwise(F.col("name"))
    w = w.join(df.select("route_id", "seq", "len_m", road.alias("road")), ["route_id", "seq"])
    along = Window.partitionBy("route_id").orderBy("seq")
    joins = (F.lag("road").over(along) == F.col("road")) & (F.col("from_seq") <= F.lag("seq").over(along) + 1)
    marked = w.withColumn("run", F.sum((~F.coalesce(joins, F.lit(False))).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.row_number().over(Window.partitionBy("route_id", "run").orderBy("seq")) == 1
    added = marked.withColumn("m", F.when(first, F.lit(window_m)).otherwise(F.col("len_m")))
    return added.groupBy("route_id", "run", "road").agg(F.min("from_seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum("m").alias("metres"), F.max("pct").alias("max_pct")).drop("run")


def families() -> dict[str, tuple[Column, Column]]:
    """Concern families of a segment: whether it belongs, and its risk there. A segment may belong to several."""
    caution = (F.col("level") == 3) & ~F.col("ferry")
    mph, shoulder = F.col("mph"), F.coalesce("sh", F.lit(0))
    cause = (
        F.when(F.col("sidewalk_fallback"), "sidewalk").when(~F.col("freeway") & F.col("limited_access"), "limited").when(F.coalesce(F.col("lts") >= 4, F.lit(False)), "stress").when(F.col("dismount"), "dismount").when(F.col("mtb"), "mtb").otherwise("other")
    )
    kind = F.when(caution, cause).otherwise("")
    highway = ~(F.col("freeway") | F.col("limited_access") | F.col("infra") | F.col("ferry")) & ((mph >= 45) | formats.is_highway_name(F.col("name")))
    return {
        "freeway": (F.col("freeway"), 1000 + mph), "limited": (~F.col("freeway") & (F.col("limited_access") | (kind == "limited")), mph), "highway": (highway, mph),
        "failing": (F.col("level") == 4, F.when(F.col("freeway"), 10000).otherwise(0) + mph * 100 + F.greatest(F.lit(0), 4 - shoulder)), "dismount": (F.col("dismount") | (kind == "dismount"), F.col("len_m")), "sidewalk": (F.col("sidewalk_fallback") | (kind == "sidewalk"), mph),
        "mtb": (F.col("mtb") | (kind == "mtb"), F.lit(1)), "high-stress": (kind == "stress", F.coalesce("lts", F.lit(4))), "other": (kind == "other", mph), "unpaved": (F.col("surface") >= 2, F.col("surface")), "curve": (F.col("hazard") > 0, F.greatest(F.lit(0), F.col("grade_pct")) * 100 + mph),
    }


def concern_families(df: DataFrame) -> DataFrame:
    """(route_id, family, road, metres, times, risk, place): stretches of each family, those of one road together, by risk and length."""
    road = F.when(F.col("name") == "", "Unnamed road").otherwise(F.col("name"))
    rows = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(k).alias("family"), risk.cast("long").alias("risk"))) for k, (test, risk) in families().items()]))
    e = df.select("route_id", "seq", "len_m", road.alias("road"), F.explode(rows).alias("f")).select("route_id", "seq", "len_m", "road", "f.*")
    w = Window.partitionBy("route_id", "family").orderBy("seq")
    begins = ~((F.lag("seq").over(w) == F.col("seq") - 1) & (F.lag("road").over(w) == F.col("road")))
    runs = e.withColumn("begins", F.coalesce(begins, F.lit(True)).cast("int"))
    out = runs.groupBy("route_id", "family", "road").agg(F.sum("len_m").alias("metres"), F.sum("begins").alias("times"), F.max("risk").alias("risk"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("route_id", "family").orderBy(F.desc("risk"), F.desc("metres"), "road")))


def preview_runs(df: DataFrame) -> DataFrame:
    """What a small map shows of a route: runs of one category, runs without pavement, and where a walk begins."""
    style = F.coalesce(category(), F.lit("ferry"))
    styled = islands(df, style, "run").groupBy("route_id", "run", style.alias("style")).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).select("route_id", F.lit("style").alias("kind"), "style", "first_seq", "last_seq")
    rough = islands(df, F.col("surface") >= 2, "run").where("surface >= 2").groupBy("route_id", "run").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).select("route_id", F.lit("unpaved").alias("kind"), F.lit("").alias("style"), "first_seq", "last_seq")
    w = Window.partitionBy("route_id").orderBy("seq")
    walks = df.withColumn("before", F.coalesce(F.lag("dismount").over(w), F.lit(False))).where("dismount and not before").select("route_id", F.lit("dismount").alias("kind"), F.lit("").alias("style"), F.col("seq").alias("first_seq"), F.col("seq").alias("last_seq"))
    return styled.union(rough).union(walks)


def step_text() -> Column:
    """What stands under a step: its speed, class and what to mind."""
    kind = F.when(F.col("freeway"), "freeway").when(F.col("limited_access"), "limited access").when(F.col("facility") == 5, "shared-use path").when(F.col("facility") == 4, "separated lane").when(F.col("facility") == 3, "buffered lane").when(F.col("facility") == 2, "bike lane").when(F.col("infra"), "bike infrastructure").when(F.col("designated"), "bike route")
    return F.concat_ws(" · ", F.when(F.col("mtb"), "mountain-bike trail"), F.when(F.col("hazard") > 0, "possible limited-visibility uphill curve"), F.when(F.col("mph") > 0, F.concat(F.col("mph").cast("string"), F.lit(" mph"))), kind, F.when(formats.is_highway_name(F.col("name")) | (F.col("mph") >= 45), "highway"), F.when(F.col("surface") >= 2, formats.surface_label(F.col("surface"))))


def valid_point(lon: Column, lat: Column) -> Column:
    return F.coalesce(lon.between(-180, 180) & lat.between(-90, 90) & ~F.isnan(lon.cast("double")) & ~F.isnan(lat.cast("double")), F.lit(False))


def directions_joined(directions: DataFrame, df: DataFrame) -> DataFrame:
    """directions(route_id, index, text) with the segment that they begin at; null beyond the route."""
    return directions.join(df.select("route_id", F.col("seq").alias("index"), "name", "len_m"), ["route_id", "index"], "left")


def report_stats(df: DataFrame) -> DataFrame:
    """Per route, on land: metres of over 5 % grade, of 30 mph and more without space, unpaved and to walk; greatest and mean speed."""
    walk = F.col("dismount") & F.col("dismount_tagged")
    named = {"incline_m": F.col("grade_pct") > 5, "no_space_m": (F.col("mph") >= 30) & (F.col("sh") < 4) & (F.col("facility") < 2), "unpaved_m": F.col("surface") >= 2, "walk_m": walk}
    return df.where("not ferry").groupBy("route_id").agg(*[_metres(c).alias(n) for n, c in named.items()], F.max("mph").alias("max_mph"), F.round(F.sum(F.col("mph") * F.col("len_m")) / F.sum("len_m").cast("double"), 6).alias("mean_mph"))
