"""Ranking of route candidates: filters, dominance, diversity, letters."""

from __future__ import annotations

import sys
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .costs import score
from .graph import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Letters that a request's offered routes carry, at most six.
MOST_OFFERED = 6
SAFETY = ("fail", "freeway", "mtb", "hazard", "dismount", "limited", "aggression", "time")


def aggression() -> Column:
    """How much a route asks of its rider, per metre ridden. Weights are hundredths, so that the sum of whole metres is exact and routes
    of equal worth tie."""
    riding = F.greatest(F.col("dist") - F.col("ferry"), F.lit(1)).cast("double")
    bad = 18 * F.col("l2") + 75 * F.col("l3") + 350 * F.col("fail") + 400 * F.col("freeway") + 80 * F.col("limited") + 110 * F.col("hazard") + 125 * F.col("mtb")
    bad = bad + F.when(F.col("dismount") > 0, 45000 + 150 * F.col("dismount")).otherwise(0)
    good = 12 * F.col("designated") + 8 * F.col("facility") + 12 * F.col("trail") + 8 * F.col("residential")
    return (bad - good) / 100.0 / riding


def scored(c: DataFrame) -> DataFrame:
    return c.withColumn("score", score()).withColumn("aggression", F.round(aggression(), 9))


def reasonable(c: DataFrame) -> DataFrame:
    """Candidates within 2.2 x the fastest + 600 s, or that save 80 m of failing or freeway metres, or match fully."""
    w = Window.partitionBy("request")
    fastest = F.min(F.struct("time", "ord", "candidate", (F.col("fail") + F.col("freeway")).alias("bad"))).over(w)
    marked = c.withColumn("__f", fastest)
    ok = (F.col("time") <= 2.2 * F.col("__f.time") + 600) | (F.col("fail") + F.col("freeway") <= F.col("__f.bad") - 80) | ((F.col("fail") == 0) & (F.col("freeway") == 0))
    return marked.where(ok).drop("__f")


def overlap(edges: DataFrame) -> DataFrame:
    """edges(request, route, edge_id, len_m) -> (request, a, b, share) of routes that share an edge: metres in common
    over the shorter route's. Routes without a common edge have no row. Edges are compared once for routes that are the same."""
    one = edges.groupBy("request", "route", "edge_id").agg(F.max("len_m").alias("len_m"))
    whole = one.groupBy("request", "route").agg(F.sort_array(F.collect_list(F.struct("edge_id", "len_m"))).alias("edges"), F.sum("len_m").alias("m"))
    kinds = Window.partitionBy("request", "edges")
    of = cut_lineage(whole.withColumn("kind", F.min("route").over(kinds)).select("request", "route", "kind", "m", F.when(F.col("route") == F.col("kind"), F.col("edges")).alias("edges")))
    each = of.where("edges is not null").select("request", "kind", F.explode("edges").alias("e")).select("request", "kind", "e.edge_id", "e.len_m")
    x, y = (each.select("request", "edge_id", F.col("kind").alias(n), F.col("len_m").alias(f"m{n}")) for n in ("x", "y"))
    both = x.join(y, ["request", "edge_id"]).where("x <= y").groupBy("request", "x", "y").agg(F.sum("mx").alias("mx"), F.sum("my").alias("my"))
    for n in ("x", "y"):
        both = both.join(of.select("request", F.col("kind").alias(n), F.col("route").alias(f"r{n}"), F.col("m").alias(f"t{n}")), ["request", n])
    first = F.col("rx") < F.col("ry")
    both = both.where("rx <> ry and (x <> y or rx < ry)")
    return both.select("request", F.least("rx", "ry").alias("a"), F.greatest("rx", "ry").alias("b"), (F.when(first, F.col("mx")).otherwise(F.col("my")) / F.least("tx", "ty")).alias("share"))


def material(a: str = "a", b: str = "b") -> Column:
    """Whether two routes differ enough in kind, though their roads are nearly the same."""
    d = lambda n: F.abs(F.col(f"{a}.{n}") - F.col(f"{b}.{n}"))
    scale = F.greatest(F.lit(250.0), 0.08 * F.least(F.col(f"{a}.dist"), F.col(f"{b}.dist")))
    return (
        (d("fail") >= 60) | (d("freeway") >= 60) | (d("limited") >= F.greatest(F.lit(120.0), scale / 2)) | (d("mtb") >= 40) | ((F.col(f"{a}.dismount") > 0) != (F.col(f"{b}.dismount") > 0))
        | (d("facility") >= scale) | (d("trail") >= scale) | (d("designated") >= scale) | (d("residential") >= scale) | (d("hazard") >= 50)
    )


def _safety_key(alias: str) -> Column:
    return F.struct(*[F.col(f"{alias}.{n}").cast("double") for n in SAFETY[:-1]])


def dominated(c: DataFrame, shares: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """Candidates that another of the same corridor (share at least 0.96) beats: no slower by over 5 s and no less safe. Protected
    ones (request, candidate) never are."""
    pairs = shares.where("share >= 0.96")
    both = pairs.select("request", F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("request", "b", "a"))
    x, y = c.alias("x0"), c.alias("y0")
    joined = both.join(x, (both["request"] == F.col("x0.request")) & (both["x"] == F.col("x0.candidate"))).join(y, (both["request"] == F.col("y0.request")) & (both["y"] == F.col("y0.candidate")))
    better = (F.col("y0.time") <= F.col("x0.time") + 5) & (_safety_key("y0") <= _safety_key("x0")) & ((F.col("y0.time") < F.col("x0.time")) | (_safety_key("y0") < _safety_key("x0")) | (F.col("y0.candidate") < F.col("x0.candidate")))
    beaten = joined.where(better).select(F.col("x0.request").alias("request"), F.col("x0.candidate").alias("candidate")).distinct()
    return beaten if protected is None else beaten.join(protected.select("request", "candidate"), ["request", "candidate"], "left_anti")


def within_window(dist_factor: float, dist_m: int, time_factor: float, time_s: int) -> Column:
    """Whether a candidate stays near the request's shortest and fastest."""
    w = Window.partitionBy("request")
    return (F.col("dist") <= dist_factor * F.min("dist").over(w) + dist_m) & (F.col("time") <= time_factor * F.min("time").over(w) + time_s)


def recommended(c: DataFrame) -> DataFrame:
    """One candidate for each request: the safest fully matching one of the wide window if it costs at most 600 s of score more
    than the best practical one, else the best practical one."""
    m = c.withColumns({"practical": within_window(1.5, 800, 1.4, 300), "wide": within_window(1.8, 1600, 1.85, 600), "matching": (F.col("fail") == 0) & (F.col("freeway") == 0)})
    best = m.groupBy("request").agg(
        F.min(F.when(F.col("practical"), F.struct("score", "time", "candidate"))).alias("p"),
        F.min(F.when(F.col("wide") & F.col("matching"), F.struct("score", "time", "candidate"))).alias("f"),
        F.min(F.struct("score", "time", "candidate")).alias("any"),
    )
    use_f = F.coalesce(F.col("f.score") <= F.col("p.score") + 600, F.lit(False))
    return best.select("request", F.when(use_f, F.col("f.candidate")).otherwise(F.coalesce("p.candidate", "any.candidate")).alias("candidate"), use_f.alias("fully_matching"))


def lettered(c: DataFrame) -> DataFrame:
    """Ranks and letters A.. by time, distance and candidate, for the first six."""
    k = F.row_number().over(Window.partitionBy("request").orderBy("time", "dist", "candidate"))
    return c.withColumn("rank", k).where(F.col("rank") <= MOST_OFFERED).withColumn("letter", F.char(64 + F.col("rank")))


def staged(c: DataFrame, kept: DataFrame, beaten: DataFrame, offered: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """Stage of each candidate: offered, too-slow, duplicate, dominated or not-chosen."""
    flags = {"kept": kept, "beaten": beaten, "offered": offered} | ({"doubled": duplicates} if duplicates is not None else {})
    for n, df in flags.items():
        c = c.join(df.select("request", "candidate", F.lit(True).alias(n)), ["request", "candidate"], "left")
    doubled = F.col("doubled") if duplicates is not None else F.lit(False)
    return c.withColumn("stage", F.when(F.col("offered"), "offered").when(F.col("kept").isNull(), "too-slow").when(doubled, "duplicate").when(F.col("beaten"), "dominated").otherwise("not-chosen"))


def best_of(c: DataFrame, low_fail: float = 0.05) -> DataFrame:
    """For each request the fastest, safest, best priced and trail-richest candidate, and the best priced of those that hardly fail."""
    least = lambda *k: F.min(F.struct(*k, "candidate"))["candidate"]
    low = F.min(F.when(F.col("fail") <= F.col("dist") * low_fail, F.struct("score", "candidate")))["candidate"]
    return c.groupBy("request").agg(least("time").alias("fastest"), least(*SAFETY).alias("safest"), least("score").alias("best_priced"), least((-F.col("trail")).alias("t")).alias("trail_richest"), low.alias("low_fail"))


def metric_vectors(df: DataFrame) -> DataFrame:
    """The metrics by which sections are compared, of whole routes on land: metres that fail, are dangerous, need caution, lack a facility, are no
    trail, are rough; climbing; and the distance."""
    m = lambda test: F.sum(F.when(test, F.col("len_m")).otherwise(0))
    climb = F.sum(F.when(F.col("grade_pct") > 0, F.col("len_m") * F.col("grade_pct")).otherwise(0))
    named = {
        "fail": m(F.col("level") == 4), "danger": m((F.col("hazard") >= 2) | F.col("mtb")), "caution": m(F.col("level") == 3), "gap": m((F.col("facility") < 2) & ~F.col("infra")), "non_trail": m(~(F.col("infra") | (F.col("facility") == 5))),
        "rough": m(F.col("surface") >= 2), "ascent": climb, "dist": F.sum("len_m"),
    }
    return df.where("not ferry").groupBy("route_id").agg(*[v.alias(k) for k, v in named.items()])


def top_labels(labels: DataFrame, weights: dict[str, float], most: int, rows_per_task: int = 1 << 18) -> DataFrame:
    """labels(node, label, metrics) -> at most ``most`` of each node, with their rank: the best in each metric first, then by weighted sum.

    Labels are counted, so that a task sorts about ``rows_per_task`` of them however many there are; labels should be cheap to read twice.
    """
    tasks = max(int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-labels.count() // rows_per_task))
    labels = labels.repartition(tasks, "node")
    by = Window.partitionBy("node")
    extreme = F.least(*[F.row_number().over(by.orderBy(m, "label")) for m in weights]) == 1
    cost = F.round(sum(w * F.col(m) for m, w in weights.items()).cast("double"), 6)
    marked = labels.withColumns({"first": F.when(extreme, 0).otherwise(1), "cost": cost})
    return marked.withColumn("rank", F.row_number().over(by.orderBy("first", "cost", "label"))).where(F.col("rank") <= most)


def _front(values: np.ndarray) -> np.ndarray:
    """Which rows no other dominates. In order of sums only earlier rows can dominate a row."""
    order = values.sum(axis=1).argsort(kind="stable")
    keep = np.empty_like(values)
    n, stays = 0, np.zeros(len(values), bool)
    for i in order:
        v = values[i]
        k = keep[:n]
        if n and ((k <= v).all(axis=1) & (k < v).any(axis=1)).any():
            continue
        keep[n], stays[i], n = v, True, n + 1
    return stays


def skyline(c: DataFrame, metrics: list[str], key: str = "candidate", block: int = 4096) -> DataFrame:
    """Candidates that no other of their request dominates (no worse in all metrics, better in one; equal ones all stay).

    A request of more than ``block`` candidates is dealt to blocks of about that many; each keeps its own front. Then the
    blocks of such a request meet in pairs, which drop what the other dominates. A task holds two blocks at most.
    """
    from .graph import cut_lineage

    many = c.groupBy("request").agg(F.count("*").alias("n")).where(F.col("n") > block).select("request", F.ceil(F.col("n") / block).cast("long").alias("blocks"))
    kind = T.StructType([*c.schema.fields, T.StructField("__b", T.LongType()), T.StructField("__blocks", T.LongType())])

    def front(group: pd.DataFrame) -> pd.DataFrame:
        return group[_front(group[metrics].to_numpy(dtype=float))]

    dealt = c.join(many.withColumnRenamed("blocks", "__blocks"), "request", "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1).cast("long")))
    dealt = dealt.withColumn("__b", F.pmod(F.xxhash64(key), F.col("__blocks"))).select(*c.columns, "__b", "__blocks")
    fronts = dealt.groupBy("request", "__b").applyInPandas(front, kind)
    if many.isEmpty():
        return fronts.select(c.columns)
    fronts = cut_lineage(fronts)
    others = F.explode(F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1), F.col("__b")))
    big = fronts.where("__blocks > 1")
    asks = big.select("request", key, *metrics, F.col("__b").alias("__mine"), others.alias("__other"))
    meets = big.select("request", *metrics, F.col("__b").alias("__other"), others.alias("__mine"))

    def lost(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = a[metrics].to_numpy(dtype=float), b[metrics].to_numpy(dtype=float)
        gone = [len(y) > 0 and bool(((y <= v).all(axis=1) & (y < v).any(axis=1)).any()) for v in x]
        return a.loc[gone, ["request", key]]

    pair = ["request", "__mine", "__other"]
    gone = asks.groupBy(pair).cogroup(meets.groupBy(pair)).applyInPandas(lost, T.StructType([c.schema["request"], c.schema[key]])).distinct()
    return fronts.join(gone, ["request", key], "left_anti").select(c.columns)


def cut_points(paths: DataFrame | None, both: DataFrame | None = None) -> DataFrame:
    """paths(request, route, seq, node) -> shared nodes of two routes where they part or meet: runs of shared nodes, consecutive
    on both, count once by their first and last node. Shared nodes may be given as both(request, a, b, node, sa, sb, ...); more columns stay."""
    if both is None:
        a, b = (paths.select("request", F.col("route").alias(n), F.col("seq").alias(f"s{n}"), "node") for n in ("a", "b"))
        both = a.join(b, ["request", "node"]).where("a < b")
    more = [c for c in both.columns if c not in ("request", "a", "b", "node", "sa", "sb")]
    w = Window.partitionBy("request", "a", "b").orderBy("sa")
    starts = ~((F.lag("sa").over(w) == F.col("sa") - 1) & (F.lag("sb").over(w) == F.col("sb") - 1))
    ends = ~((F.lead("sa").over(w) == F.col("sa") + 1) & (F.lead("sb").over(w) == F.col("sb") + 1))
    marked = both.withColumn("starts", F.coalesce(starts, F.lit(True))).withColumn("ends", F.coalesce(ends, F.lit(True)))
    return marked.where("starts or ends").select("request", "a", "b", "node", "sa", "sb", "starts", "ends", *more)


def select_six(c: DataFrame, shares: DataFrame, required: DataFrame) -> DataFrame:
    """At most six routes for each request: (request, candidate, required).

    c has request, candidate, ord, pref (whether both preferences hold), aggression, time and the metrics of ``material``; shares
    has pairs (request, a, b, share) with edges in common; required has request, candidate. Routes are ordered by ord,
    -aggression, time. Six or fewer are all taken. Else the first is, then three times the one that
    differs from all taken ones and has the greatest sum of its least difference in edges, a fifth of its least distance in ord / 4, and
    0.08 for both preferences; then the last, if it differs. Required routes that are missing fill free places, and
    take those of the last ones that are not required. Every step is a grouped maximum and an anti-join.
    """
    from .graph import cut_lineage

    order = F.row_number().over(Window.partitionBy("request").orderBy("ord", F.desc("aggression"), "time", "candidate"))
    ranked = c.withColumn("place", order).withColumn("n", F.count("*").over(Window.partitionBy("request")))
    ranked = cut_lineage(ranked)
    sides = shares.select("request", "a", "b", "share").union(shares.select("request", F.col("b"), F.col("a"), "share"))
    x, y = ranked.alias("a"), ranked.alias("b")
    j = sides.join(x, (sides["request"] == F.col("a.request")) & (sides["a"] == F.col("a.candidate"))).join(y, (sides["request"] == F.col("b.request")) & (sides["b"] == F.col("b.candidate")))
    same = ~((F.col("share") < 0.96) | (F.col("share") < 0.99) & material())
    met = cut_lineage(j.select(sides["request"], F.col("a.candidate").alias("candidate"), F.col("b.candidate").alias("other"), "share", same.alias("same")))
    small = ranked.where(F.col("n") <= MOST_OFFERED)
    large = ranked.where(F.col("n") > MOST_OFFERED).select("request", "candidate", "place", "n", "ord", "pref")
    taken = large.where("place = 1").select("request", "candidate", "ord", F.lit(1).alias("slot"))
    pool = large.where("place > 1 and place < n").select("request", "candidate", "place", "ord", "pref", F.lit(1.0).alias("apart"), F.lit(1e9).alias("spread"))
    newest = taken
    for slot in range(2, MOST_OFFERED - 1):
        last = newest.select("request", F.col("candidate").alias("other"), F.col("ord").alias("other_ord"))
        near = pool.join(last, "request").join(met, ["request", "candidate", "other"], "left").where(~F.coalesce("same", F.lit(False)))
        pool = cut_lineage(near.select("request", "candidate", "place", "ord", "pref", F.least("apart", 1 - F.coalesce("share", F.lit(0.0))).alias("apart"), F.least("spread", F.abs(F.col("ord") - F.col("other_ord")).cast("double")).alias("spread")))
        worth = F.round(F.col("apart") + F.col("spread") / 4 * 0.2 + F.when(F.col("pref"), 0.08).otherwise(0.0), 9)
        newest = pool.groupBy("request").agg(F.max(F.struct(worth.alias("w"), (-F.col("place")).alias("p"), "candidate", "ord")).alias("b")).select("request", "b.candidate", "b.ord", F.lit(slot).alias("slot"))
        newest = cut_lineage(newest)
        taken = taken.union(newest)
        pool = pool.join(newest.select("request", "candidate"), ["request", "candidate"], "left_anti")
    end = large.where("place = n").select("request", "candidate", "ord", F.lit(MOST_OFFERED).alias("slot"))
    clash = end.select("request", "candidate").join(met.where("same"), ["request", "candidate"]).join(taken.select("request", F.col("candidate").alias("other")), ["request", "other"]).select("request", "candidate")
    taken = cut_lineage(taken.union(end.join(clash, ["request", "candidate"], "left_anti")).select("request", "candidate", "slot").union(small.select("request", "candidate", F.col("place").alias("slot"))))
    wanted = required.select("request", "candidate").distinct().withColumn("required", F.lit(True))
    have = taken.join(wanted, ["request", "candidate"], "left").withColumn("required", F.coalesce("required", F.lit(False)))
    missing = wanted.join(taken, ["request", "candidate"], "left_anti").groupBy("request").agg(F.count("*").alias("missing"))
    by_request = Window.partitionBy("request")
    spare = have.join(missing, "request", "left").withColumn("free", MOST_OFFERED - F.count("*").over(by_request))
    from_end = F.row_number().over(by_request.orderBy("required", F.desc("slot")))
    goes = (~F.col("required")) & (F.col("from_end") <= F.greatest(F.lit(0), F.coalesce("missing", F.lit(0)) - F.col("free")))
    kept = spare.withColumn("from_end", from_end).where(~goes).select("request", "candidate", "required")
    return kept.union(wanted.join(taken, ["request", "candidate"], "left_anti").select("request", "candidate", "required"))


#: Metrics of a section-frontier label, smaller is better, and the weight of each in the practical order.
LABEL = {"time": 1.0, "fail": 2.0, "danger": 0.35, "caution": 0.2, "gap": 0.08, "non_trail": 0.12, "rough": 0.2, "ascent": 0.6, "dist": 0.0}
#: The order of labels by safety, and the orders whose first label a full bag keeps in any case.
LABEL_SAFETY = ("fail", "danger", "caution", "rough", "gap", "non_trail", "ascent", "time")
KEPT_FIRST = (LABEL_SAFETY, ("practical",), ("caution", *LABEL_SAFETY), ("gap", *LABEL_SAFETY), ("non_trail", *LABEL_SAFETY), ("rough", "time"), ("ascent", "time"), ("time",))
#: Paths may take so many times the fastest one's time and metres, and seconds and metres more, to be chosen; those near the safest fail by
#: at most so many metres more than it, or than the practical one.
FRONTIER_TIME, FRONTIER_S, FRONTIER_DIST, FRONTIER_M, NEAR_SAFEST_M, NEAR_PRACTICAL_M = 1.85, 600, 1.8, 1600, 80, 20


def _practical(get) -> Column:
    return F.round(sum(w * get(n) for n, w in LABEL.items()), 6)


def _front_of(labels: Column) -> Column:
    """Labels that no other dominates; of equal ones that which was there, then that of the least path."""
    names = list(LABEL)
    earlier = lambda y, x: F.struct(y["fresh"], y["path"]) < F.struct(x["fresh"], x["path"])
    beats = lambda y, x: reduce(and_, [y[n] <= x[n] for n in names]) & (reduce(or_, [y[n] < x[n] for n in names]) | earlier(y, x))
    return F.filter(labels, lambda x: ~F.exists(labels, lambda y: beats(y, x)))


def _in_order(labels: Column, by: tuple[str, ...]) -> Column:
    """Labels after their sort keys, the path last."""

    def keyed(x: Column) -> Column:
        keys = [(_practical(lambda n: x[n]) if k == "practical" else x[k]).alias(f"k{i}") for i, k in enumerate(by)]
        return F.struct(*keys, x["path"].alias("p"), x.alias("x"))

    return F.transform(labels, keyed)


def _cut(front: Column, most: int) -> Column:
    """At most ``most`` labels: the first of each of KEPT_FIRST, then by the practical order."""
    firsts = [F.array_min(_in_order(front, by))["x"] for by in KEPT_FIRST]
    ranked = F.transform(F.array_sort(_in_order(front, ("practical",))), lambda x: x["x"])
    return F.when(F.size(front) <= most, front).otherwise(F.slice(F.array_distinct(F.concat(F.array(*firsts), ranked)), 1, most))


def section_frontier(arcs: DataFrame, most: int = 8) -> DataFrame:
    """arcs(request, src, dst, edge, start, goal, metrics) -> (request, rank, edges, metrics): paths of each request's small union graph that
    no other dominates, by the practical order.

    Every node has a bag of labels. A round sends the labels that the last one added along their arcs and merges each node's bag with
    what arrives, for all requests together; a bag keeps at most ``most`` labels (see _cut). No label returns to a node that it has
    passed. A bag meets at most ``most`` labels for each arc that leads to its node, so no group grows with the graph.
    """
    from .graph import stored

    names = list(LABEL)
    a = stored(arcs.select("request", "src", "dst", "edge", "goal", *[F.col(n).cast("double").alias(n) for n in names]).dropDuplicates(["request", "src", "dst", "edge"]), "frontier-arcs")
    label = lambda get, path, nodes: F.struct(*[get(n).alias(n) for n in names], path.alias("path"), nodes.alias("nodes"), F.lit(True).alias("fresh"))
    begin = arcs.select("request", "goal", F.col("start").alias("node")).distinct()
    begin = begin.select("request", "goal", "node", F.array(label(lambda n: F.lit(0.0), F.array().cast("array<bigint>"), F.array("node"))).alias("labels"))
    bags = stored(begin, "bags")
    while True:
        fresh = bags.where("node <> goal").select("request", "node", F.explode(F.filter("labels", lambda x: x["fresh"])).alias("l"))
        sent = fresh.join(a.withColumnRenamed("src", "node"), ["request", "node"]).where(~F.array_contains("l.nodes", F.col("dst")))
        sent = sent.select("request", "goal", F.col("dst").alias("node"), label(lambda n: F.col(f"l.{n}") + F.col(n), F.concat("l.path", F.array("edge")), F.concat("l.nodes", F.array("dst"))).alias("l"))
        have = bags.select("request", "goal", "node", F.explode(F.transform("labels", lambda x: x.withField("fresh", F.lit(False)))).alias("l"))
        met = have.union(sent).groupBy("request", "goal", "node").agg(F.collect_list("l").alias("all")).withColumn("front", _front_of(F.col("all")))
        bags = stored(met.select("request", "goal", "node", _cut(F.col("front"), most).alias("labels")), "bags")
        if bags.where(F.exists("labels", lambda x: x["fresh"]) & (F.col("node") != F.col("goal"))).isEmpty():
            break
    ends = bags.where("node = goal").select("request", F.explode("labels").alias("l")).select("request", "l.*")
    rank = F.row_number().over(Window.partitionBy("request").orderBy(_practical(F.col), "path"))
    return ends.select("request", rank.cast("long").alias("rank"), F.array_join("path", ",").alias("edges"), *names)


def frontier_choices(paths: DataFrame) -> DataFrame:
    """section_frontier's paths -> (request, kind, rank): up to six that become children of their request's section: the practical and the safest
    one; and of those that fail little more than these the ones with the least caution, gaps, metres off trails and climbing.

    All are within 1.85 times the fastest path's time and 600 s, and 1.8 times its metres and 1600 m. A path may be of several kinds.
    """
    by = Window.partitionBy("request")
    first = lambda *order: F.min(F.struct(*order, "rank")).over(by)
    p = paths.withColumn("practical", _practical(F.col)).withColumn("fastest", F.min(F.struct("time", "rank", "dist")).over(by))
    p = p.where((F.col("time") <= FRONTIER_TIME * F.col("fastest.time") + FRONTIER_S) & (F.col("dist") <= FRONTIER_DIST * F.col("fastest.dist") + FRONTIER_M))
    p = p.withColumns({"best": F.min(F.struct("practical", "rank", "fail")).over(by), "safe": first(*LABEL_SAFETY)})
    near = F.col("fail") <= F.greatest(F.col("safe.fail") + NEAR_SAFEST_M, F.col("best.fail") + NEAR_PRACTICAL_M)
    kinds = {"practical": F.col("best.rank"), "safest": F.col("safe.rank")} | {k: F.min(F.when(near, F.struct(k, "practical", "rank"))).over(by)["rank"] for k in ("caution", "gap", "non_trail", "ascent")}
    p = p.withColumns({f"of_{k}": v for k, v in kinds.items()})
    chosen = p.select("request", "rank", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"of_{k}").alias("of")) for k in kinds])).alias("k"))
    return chosen.where(F.col("rank") == F.col("k.of")).select("request", "k.kind", "rank")
