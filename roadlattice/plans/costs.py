"""Queries of the cost model over the grid's arcs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlattice.operators import arcs as A
from roadlattice.operators import costs as C
from roadlattice.sources.adapters import view

from .registry import query
from .verdicts import DEFAULTS, LADDER

ARCS_SQL = """ARCS AS (SELECT *, a AS src, b AS dst, true AS forward, edge_id * 2 AS arc_id FROM grid_edges UNION ALL
  SELECT * REPLACE (down_m AS up_m, up_m AS down_m), b, a, false, edge_id * 2 + 1 FROM grid_edges WHERE NOT one_way)"""
TIMED_SQL = f"""{ARCS_SQL}, TIMED AS (SELECT *, CASE WHEN ferry THEN CAST(len_m AS DOUBLE) / (greatest(mph, 3) * CAST(0.44704 AS DOUBLE)) WHEN dismount THEN CAST(len_m AS DOUBLE) / 1.15
  ELSE CAST(len_m AS DOUBLE) / CASE WHEN up_m >= down_m THEN greatest(5.6 * exp(-7 * ((up_m - down_m) / CAST(len_m AS DOUBLE))), 1.3) ELSE least(5.6 * (1 - 2.5 * ((up_m - down_m) / CAST(len_m AS DOUBLE))), 12.0) END + 3.0 * (up_m - greatest(up_m - down_m, 0)) END AS time_s FROM ARCS)"""
LEVELS_SQL = f"""{TIMED_SQL}, src AS (SELECT * EXCLUDE (infra), infra AS infra0, infra OR facility >= 4 AS infra, CASE WHEN infra OR facility >= 4 THEN 1 END AS infra_score, mph AS speed, shoulder_ft AS shoulder, lts AS stress_rating, {DEFAULTS} FROM TIMED), {LADDER},
  LEVELLED AS (SELECT * EXCLUDE (infra), infra0 AS infra FROM levels)"""


def _pick(m: int, *three: float) -> str:
    return f"CAST({three[m]} AS DOUBLE)"


def cost_sql(m: int) -> str:
    """Cost of an arc of LEVELLED in SQL, for the oracles."""
    p = lambda *x: _pick(m, *x)
    apart = "(infra OR ferry OR freeway OR limited_access)"
    return f"""((time_s + (greatest(up_m - down_m, 0) * (1 + 8 * greatest(0, greatest(up_m - down_m, 0) / CAST(len_m AS DOUBLE) - 0.04)) + 0.5 * (up_m - greatest(up_m - down_m, 0))) * {p(0.25, 0.9, 1.6)})
  * CASE level WHEN 4 THEN {p(1.5, 9, 30)} WHEN 1 THEN {p(1, 0.92, 0.9)} ELSE 1 END
  * CASE WHEN infra OR ferry THEN 1 WHEN mph > 35 THEN 1 + {p(0, 0.01, 0.02)} * (mph - 35) WHEN coalesce(shoulder_ft, 0) <= 0 THEN greatest(0.25, 1 + {p(0.005, 0.015, 0.03)} * (mph - 35)) ELSE 1 END
  * CASE hazard WHEN 1 THEN {p(1.08, 1.35, 1.8)} WHEN 2 THEN {p(1.16, 1.8, 3.4)} WHEN 3 THEN {p(1.3, 2.6, 6.5)} ELSE 1 END
  * CASE WHEN facility >= 1 OR {apart} THEN 1 ELSE CASE {TIER_SQL} WHEN 1 THEN {p(1.02, 1.12, 1.22)} WHEN 2 THEN {p(1.05, 1.28, 1.48)} WHEN 3 THEN {p(1.1, 1.5, 1.85)} ELSE 1 END END
  * CASE WHEN facility >= 4 OR {apart} THEN 1 ELSE 1 + greatest(CASE WHEN lanes >= 4 OR (lanes >= 3 AND center_turn) THEN {p(1.03, 1.14, 1.24)} - 1 ELSE 0 END, CASE lts WHEN 4 THEN 1 WHEN 3 THEN 0.5 ELSE 0 END * ({p(1.04, 1.18, 1.3)} - 1)) * CASE WHEN facility >= 2 THEN 0.5 ELSE 1 END END
  * CASE WHEN urban AND coalesce(sidewalk, '') <> 'present' AND facility = 0 AND mph >= 30 THEN {p(1.06, 1.16, 1.3)} ELSE 1 END * CASE WHEN rule = 'sidewalk-fallback' THEN {p(1.9, 3.8, 8)} ELSE 1 END
  * CASE WHEN freeway THEN 60 ELSE 1 END * CASE WHEN limited_access THEN {p(1.05, 1.35, 1.75)} ELSE 1 END * CASE WHEN mtb THEN 6 ELSE 1 END * CASE WHEN dismount THEN CASE WHEN dismount_tagged AND len_m > 100 THEN 8 ELSE 4 END ELSE 1 END
  * CASE WHEN ferry OR freeway OR dismount OR level = 4 THEN 1 ELSE CASE facility WHEN 1 THEN 0.82 WHEN 2 THEN 0.4 WHEN 3 THEN 0.36 WHEN 4 THEN 0.29 WHEN 5 THEN 0.16 ELSE CASE WHEN designated THEN 0.94 ELSE 1 END END END
  {"* CASE WHEN road_class <= 3 AND facility = 0 AND NOT " + apart + " THEN 0.78 ELSE 1 END" if m == 2 else ""}
  + {steep_sql(m)} + CASE surface WHEN 2 THEN 0.065 WHEN 3 THEN 0.2 ELSE 0 END * len_m * 0.2)"""


def steep_sql(m: int) -> str:
    g = "((up_m - down_m) * 100.0 / CAST(len_m AS DOUBLE))"
    return f"""CASE WHEN ferry OR dismount OR len_m < 20 OR {g} <= 9 THEN 0 ELSE least(2400.0, 8 * time_s, least(1.0, len_m / 100.0) * {1.35 if m == 2 else 1.0} * (5 * pow(least({g}, 12.0) - 9, 2) + 400 * pow(greatest(0.0, {g} - 12), 2))) END"""


TIER_SQL = """(CASE WHEN adt IS NOT NULL THEN CASE WHEN adt > 15000 THEN 3 WHEN adt > 6000 THEN 2 WHEN adt > 2000 THEN 1 ELSE 0 END WHEN fc IS NOT NULL THEN CASE WHEN fc <= 3 THEN 3 WHEN fc <= 4 THEN 2 WHEN fc <= 5 THEN 1 ELSE 0 END
  ELSE CASE WHEN road_class BETWEEN 8 AND 11 THEN 3 WHEN road_class BETWEEN 6 AND 7 THEN 2 WHEN road_class BETWEEN 4 AND 5 THEN 1 ELSE 0 END END)"""


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.directed(view(spark, sf_dir, "grid_edges"))


@query(f"WITH {TIMED_SQL} SELECT arc_id, src, dst, round(time_s, 6) AS time_s FROM TIMED")
def edge_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arcs(spark, sf_dir).select("arc_id", "src", "dst", F.round(C.time_s(), 6).alias("time_s"))


@query(f"WITH {LEVELS_SQL} SELECT arc_id, CAST(level AS BIGINT) AS level, round({cost_sql(0)} + 1e-8, 4) AS cost_direct, round({cost_sql(1)} + 1e-8, 4) AS cost_balanced, round({cost_sql(2)} + 1e-8, 4) AS cost_low FROM LEVELLED")
def arc_cost_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = C.priced(A.judged(arcs(spark, sf_dir)))
    return priced.select("arc_id", F.col("level").cast("bigint").alias("level"), *[F.round(F.col(f"cost_{m}") + 1e-8, 4).alias(f"cost_{m}") for m in C.MODES])


@query(f"""SELECT CAST({TIER_SQL} AS BIGINT) AS tier, CAST(CASE WHEN road_class BETWEEN 8 AND 11 THEN 3 WHEN road_class BETWEEN 6 AND 7 THEN 2 WHEN road_class BETWEEN 4 AND 5 THEN 1 ELSE 0 END AS BIGINT) AS osm, count(*) AS edges FROM grid_edges GROUP BY 1, 2""")
def traffic_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "grid_edges").groupBy(C.tier().cast("bigint").alias("tier"), C.osm_tier().cast("bigint").alias("osm")).agg(F.count("*").alias("edges"))


@query(f"WITH {TIMED_SQL}, T AS (SELECT arc_id, ferry, dismount, up_m * 4 AS up_m, down_m, len_m, time_s FROM TIMED) SELECT arc_id, round({steep_sql(1)}, 4) AS balanced, round({steep_sql(2)}, 4) AS low FROM T")
def steep_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = arcs(spark, sf_dir).withColumn("time_s", C.time_s()).withColumn("up_m", F.col("up_m") * 4)
    return timed.select("arc_id", F.round(C.steep_avoidance(1, F.col("time_s")), 4).alias("balanced"), F.round(C.steep_avoidance(2, F.col("time_s")), 4).alias("low"))


_B = "CASE WHEN d = 0 THEN CASE WHEN fwd THEN 90.0 ELSE 270.0 END ELSE CASE WHEN fwd THEN 0.0 ELSE 180.0 END END"


def bearing(prefix: str = "") -> F.Column:
    return F.when(F.col(f"{prefix}dir") == 0, F.when(F.col(f"{prefix}forward"), 90.0).otherwise(270.0)).otherwise(F.when(F.col(f"{prefix}forward"), 0.0).otherwise(180.0))


@query(f"""WITH {ARCS_SQL}, B AS (SELECT arc_id, edge_id, src, dst, name, CASE WHEN dir = 0 THEN CASE WHEN forward THEN 90.0 ELSE 270.0 END ELSE CASE WHEN forward THEN 0.0 ELSE 180.0 END END AS h FROM ARCS),
P AS (SELECT i.arc_id AS from_arc, o.arc_id AS to_arc, abs(((o.h - i.h + 180) % 360 + 360) % 360 - 180) AS delta, i.name = o.name AND i.name <> '' AS same FROM B i JOIN B o ON i.dst = o.src AND i.edge_id <> o.edge_id)
SELECT from_arc, to_arc, CAST(CASE WHEN delta < 30 THEN 0 WHEN same AND delta < 70 THEN 0 WHEN delta >= 150 THEN 22 WHEN delta < 55 THEN 7.15 ELSE 11 END AS DOUBLE) AS cost FROM P""")
def turn_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = arcs(spark, sf_dir).withColumn("h", bearing())
    i = a.select(F.col("arc_id").alias("from_arc"), F.col("edge_id").alias("e1"), F.col("dst").alias("node"), F.col("h").alias("bearing_in"), F.col("name").alias("n1"))
    o = a.select(F.col("arc_id").alias("to_arc"), F.col("edge_id").alias("e2"), F.col("src").alias("node"), F.col("h").alias("bearing_out"), F.col("name").alias("n2"))
    same = (F.col("n1") == F.col("n2")) & (F.col("n1") != "")
    return i.join(o, "node").where("e1 <> e2").select("from_arc", "to_arc", C.turn_cost(1, same_name=same).alias("cost"))


@query("SELECT CAST(0 AS BIGINT) AS violations, 2 * count(*) - CAST(sum(CASE WHEN one_way THEN 1 ELSE 0 END) AS BIGINT) AS arcs FROM grid_edges")
def cost_floor_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = C.priced(A.judged(arcs(spark, sf_dir)))
    low = [F.col(f"cost_{n}") < C.cost_floor(m) - 1e-9 for m, n in enumerate(C.MODES)]
    return priced.agg(F.count_if(low[0] | low[1] | low[2]).alias("violations"), F.count("*").alias("arcs"))
