"""Directed arcs of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .verdict import Rules, evaluate


def directed(edges: DataFrame) -> DataFrame:
    """Two rows for an edge (a forward one, and a backward one with ascent and descent exchanged), one if it is one-way. Columns that
    end in _ba hold what another column is for the backward arc (where they are not null), as shoulder_ft_ba does for shoulder_ft."""
    other = [c for c in edges.columns if c.endswith("_ba") and c.removesuffix("_ba") in edges.columns]
    forward = edges.withColumns({"src": F.col("a"), "dst": F.col("b"), "forward": F.lit(True)})
    backward = edges.where("not one_way").withColumns({"src": F.col("b"), "dst": F.col("a"), "forward": F.lit(False), "__asc": F.col("down_m"), "__des": F.col("up_m")})
    backward = backward.withColumns({c.removesuffix("_ba"): F.coalesce(c, c.removesuffix("_ba")) for c in other}) if other else backward
    backward = backward.drop("up_m", "down_m").withColumnsRenamed({"__asc": "up_m", "__des": "down_m"})
    return forward.unionByName(backward).drop(*other).withColumn("arc_id", F.col("edge_id") * 2 + F.when(F.col("forward"), 0).otherwise(1))


def judged(arcs: DataFrame, rules=Rules()) -> DataFrame:
    """Arcs with the level and rule of their facts; facility 4 and up counts as infrastructure of level 1."""
    facts = arcs.select(
        "arc_id", "prohibited", "ferry", "freeway", (F.col("infra") | (F.col("facility") >= 4)).alias("infra"), F.when(F.col("infra") | (F.col("facility") >= 4), 1).alias("infra_score"),
        "facility", "limited_access", F.col("mph").alias("speed"), F.col("shoulder_ft").alias("shoulder"), "edge_space", "lanes", "sidewalk", "urban", F.col("lts").alias("stress_rating"), "adt", "fc",
        F.struct(*arcs.columns).alias("arc"),
    )
    v = evaluate(facts, rules)
    return v.select("arc.*", "level", "rule")


def legal(arcs: DataFrame, *, freeways: bool = False, ferries: bool = True, mtb: bool = False, require_safe: bool = False) -> DataFrame:
    """Arcs that a search may use. Level 4 is barred under require_safe, but for crossings of at most 40 m."""
    ok = ~F.col("prohibited")
    if not freeways:
        ok = ok & ~F.col("freeway")
    if not ferries:
        ok = ok & ~F.col("ferry")
    if not mtb:
        ok = ok & ~F.col("mtb")
    if require_safe:
        ok = ok & ((F.col("level") < 4) | (F.col("len_m") <= 40))
    return arcs.where(ok)


def without_edges(arcs: DataFrame, blocked: DataFrame) -> DataFrame:
    return arcs.join(blocked.select("edge_id").distinct(), "edge_id", "left_anti")
