"""Graph operators over edges(a, b): components, relations, pruning, and shortest paths by relaxation."""

from __future__ import annotations

import heapq
import sys
import tempfile
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Tasks get this module's helpers with them, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors share; only a local master without that
    setting gets a temporary one."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="roadlattice-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared)
    return shared.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder. A checkpoint keeps the size that was estimated for its plan, which joins multiply: in a
    loop that number's digits double with every round until the driver's memory is full of them. So its rows get a plan without one."""
    spark = df.sparkSession
    shared_folder(spark)
    kept = df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(kept.toJavaRDD(), kept.schema()), spark)


#: Bytes of a method up to which the JVM compiles it.
COMPILED = "8000"


def stored(df: DataFrame, name: str, split: bool = False) -> DataFrame:
    """Written to the shared folder and read again: one job, and a lost executor costs only what is read. With ``split`` expressions that
    would make a method too long for the JVM to compile, as prices do, are evaluated in several."""
    spark, limit = df.sparkSession, "spark.sql.codegen.hugeMethodLimit"
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(limit)
    try:
        if split:
            spark.conf.set(limit, COMPILED)
        df.write.parquet(path)
    finally:
        if split:
            spark.conf.set(limit, before)
    return spark.read.schema(df.schema).parquet(path)


def neighbours(edges: DataFrame) -> DataFrame:
    """Undirected incidence: (node, other) from both ends."""
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b"), F.col("a")))


def degrees(edges: DataFrame) -> DataFrame:
    return neighbours(edges).groupBy("node").agg(F.count("*").alias("degree"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the least node reachable. Every round each node takes the least label of itself and its
    neighbours and then that label's own label (pointer jumping), until nothing changes. Joins merge: labels that are small enough for a
    broadcast would go to the driver three times a round."""
    both = cut_lineage(neighbours(edges).distinct())
    labels = cut_lineage(nodes.select("node", F.col("node").alias("component")))
    while True:
        least = both.join(labels.withColumnRenamed("node", "other").hint("merge"), "other").groupBy("node").agg(F.min("component").alias("m"))
        hooked = labels.join(least.hint("merge"), "node", "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("was"))
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = cut_lineage(hooked.join(jump.hint("merge"), "component", "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component"), "was"))
        labels = new.select("node", "component")
        if new.where("component <> was").isEmpty():
            return labels


def giant(labels: DataFrame) -> DataFrame:
    """Component with the most nodes (the least label of a tie), and its size."""
    return labels.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(1)


def pruned(edges: DataFrame, nodes: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Edges without the components in which no edge has ``keep``, and dense new node numbers in node order."""
    labels = components(edges, nodes)
    good = edges.where(keep).select(F.col("a").alias("node")).join(labels, "node").select("component").distinct()
    left = labels.join(good, "component", "left_semi")
    kept = edges.join(left.select(F.col("node").alias("a")), "a", "left_semi")
    # a dense number is the rank over a range partitioning: sizes of the partitions, then a rank in each
    ranged = left.select("node").repartitionByRange("node").sortWithinPartitions("node").withColumn("part", F.spark_partition_id())
    within = F.row_number().over(Window.partitionBy("part").orderBy("node"))
    numbered = cut_lineage(ranged.withColumn("k", within))
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.alias("x").join(sizes.alias("y"), F.col("y.part") < F.col("x.part"), "left").groupBy(F.col("x.part").alias("part")).agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("skip"))
    return kept, numbered.join(before, "part").select("node", (F.col("skip") + F.col("k") - 1).alias("new_id"))


def members(relations: DataFrame) -> DataFrame:
    """relations(id, member, member_type): (id, way) with nested relations followed; cycles end by themselves."""
    ways = relations.where("member_type = 'way'").select("id", F.col("member").alias("way"))
    inner = relations.where("member_type = 'relation'").select("id", F.col("member").alias("sub"))
    reach = frontier = inner.distinct()
    while True:
        step = frontier.join(inner.select(F.col("id").alias("sub"), F.col("sub").alias("deeper")), "sub").select("id", F.col("deeper").alias("sub")).distinct()
        frontier = cut_lineage(step.join(reach, ["id", "sub"], "left_anti"))
        if frontier.isEmpty():
            break
        reach = reach.union(frontier)
    nested = reach.join(ways.withColumnRenamed("id", "sub"), "sub").select("id", "way")
    return ways.union(nested).distinct()


def terminals(edges: DataFrame) -> DataFrame:
    """Nodes that touch both a ferry and land."""
    ends = edges.select(F.col("a").alias("node"), "ferry").union(edges.select("b", "ferry"))
    return ends.groupBy("node").agg(F.bool_or("ferry").alias("boat"), F.bool_or(~F.col("ferry")).alias("land")).where("boat and land").select("node")


#: Labels that could only be on paths of over so many times the best known cost are not kept, if a search has bounds.
MARGIN = 1.15
OFFERS = "request long, node long, block long, dist double, pred long, offer boolean"


def _block(node: Column, size: int) -> Column:
    return F.floor(node / size).cast("long")


def _relax(arcs: pd.DataFrame, state: pd.DataFrame, cap: float, size: int, margin: float | None = None, bounded: bool = False) -> pd.DataFrame:
    """One block's turn: for each request the offers enter its labels, and what they improve spreads inside the block, least cost
    first. Gives the changed labels and, for nodes of other blocks, the least offers. Of equal costs the least predecessor stays.
    With a margin, labels whose cost and bound (0 unless bounded) exceed margin times the goals' best known costs go. A
    node without a bound has the one of all others (kind 5); if there is none, its labels go."""
    out: dict[int, list] = {}
    for s, d, c in zip(arcs["src"].tolist(), arcs["dst"].tolist(), arcs["cost"].tolist()):
        out.setdefault(s, []).append((d, c))
    rows = []
    for request, own in state.groupby("request", sort=False):
        block, is_offer, is_penalty = int(own["block"].iloc[0]), own["kind"].to_numpy() == 1, own["kind"].to_numpy() == 2
        dear = {(n, p): d for n, p, d in own.loc[is_penalty, ["node", "pred", "dist"]].itertuples(index=False)}
        lower = dict(own.loc[own["kind"] == 3, ["node", "dist"]].itertuples(index=False)) if bounded else None
        aim = dict(own.loc[own["kind"] == 4, ["node", "dist"]].itertuples(index=False))
        beyond = min(own.loc[own["kind"] == 5, "dist"], default=float("inf"))
        most = min(cap, margin * max(aim.values())) if aim else cap
        known = own.loc[own["kind"] == 0]
        best = {n: (d, -1 if p != p or p is None else p) for n, d, p in known[["node", "dist", "pred"]].itertuples(index=False)}
        heap, changed, away = [], set(), {}

        def offer(n, d, p):
            nonlocal most
            have, bound = best.get(n), 0.0 if lower is None else lower.get(n, beyond)
            if d + bound <= most and (have is None or (d, p) < have):
                if d < aim.get(n, d):
                    aim[n] = d
                    most = min(most, margin * max(aim.values()))
                if have is None or d < have[0]:
                    heapq.heappush(heap, (d + bound, d, n))
                best[n] = (d, p)
                changed.add(n)

        for n, d, p in own.loc[is_offer, ["node", "dist", "pred"]].itertuples(index=False):
            offer(n, d, -1 if p != p or p is None else p)
        while heap:
            key, d, u = heapq.heappop(heap)
            if d > best[u][0] or key > most:
                continue
            for v, c in out.get(u, ()):
                c = c * dear.get((u, v), 1.0)
                if v // size == block:
                    offer(v, d + c, u)
                elif d + c <= most and (v not in away or (d + c, u) < away[v]):
                    away[v] = (d + c, u)
        rows += [(request, n, block, *best[n], False) for n in changed]
        rows += [(request, n, n // size, d, p, True) for n, (d, p) in away.items()]
    cols = list(zip(*rows)) if rows else [()] * 6
    names = ("request", "node", "block", "dist", "pred", "offer")
    out = pd.DataFrame({k: pd.Series(v, dtype=t) for k, v, t in zip(names, cols, ("int64", "int64", "int64", "float64", "int64", "bool"))})
    out["pred"] = out["pred"].astype("Int64").mask(out["pred"] < 0)
    return out


@dataclass
class Dealt:
    """Least arcs by block and part, as a table in the shared folder, for any number of searches."""

    least: DataFrame
    block_nodes: int
    request_parts: int


def dealt(arcs: DataFrame, *, block_nodes: int = 1 << 14, request_parts: int = 1) -> Dealt:
    """arcs(src, dst, cost >= 0) for distances, which are then not dealt anew in each search."""
    keyed = arcs.where("src <> dst").select(_block(F.col("src"), block_nodes).alias("block"), "src", "dst", "cost").repartition("block")
    least = keyed.groupBy("block", "src", "dst").agg(F.min("cost").alias("cost")).sortWithinPartitions("block")
    return Dealt(stored(least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(request_parts - 1)))), "dealt-arcs"), block_nodes, request_parts)


def distances(arcs: DataFrame | Dealt, sources: DataFrame, *, cap: float | None = None, block_nodes: int = 1 << 14, request_parts: int = 1, penalties: DataFrame | None = None, bounds: DataFrame | None = None, goals: DataFrame | None = None, margin: float = MARGIN) -> DataFrame:
    """arcs(src, dst, cost >= 0), sources(node, request) -> (request, node, dist, pred): least costs, of equal ones with the least
    predecessor.

    Nodes are dealt to blocks of ``block_nodes`` by number (numbers that lie near each other should be near in the
    graph). A round gives every block that has new offers its labels and offers, lets them spread inside the block to
    their end, and sends what crosses a border to the other blocks, until no offer improves a label. So rounds follow the blocks
    that a path crosses, not its arcs; a task holds a block's arcs and the labels of one of ``request_parts`` parts of the
    requests. ``penalties(request, src, dst, factor)`` make arcs dearer for one request. With ``cap`` costs above it are not
    followed. Lineage is cut with a reliable checkpoint, so a lost executor costs no more than the current round. A round reads the
    arcs of the blocks that have offers.

    With goals(request, node) only labels that can still be on a path of at most ``margin`` (1 or more) times the goal's best known cost
    are kept: the goals' labels and their paths are those of the search without goals, others may be missing. (Of several goals of a
    request the dearest counts.) So a search ends about as far away as its goal lies, and blocks beyond are not read. With
    bounds(request, node, bound), which no path from the node to the request's goal costs less than (see goal_bounds), more labels go;
    a row without a node gives the bound of all nodes that have none, without such a row these do not lead to the goal. Bounds join the
    labels of a block that has its turn.
    """
    if not isinstance(arcs, Dealt):
        arcs = dealt(arcs, block_nodes=block_nodes, request_parts=request_parts)
    block_nodes, request_parts, least = arcs.block_nodes, arcs.request_parts, arcs.least
    part = F.pmod(F.xxhash64("request"), F.lit(request_parts)).cast("int").alias("part")
    label = lambda kind: F.lit(kind).alias("kind")
    offers = cut_lineage(sources.select(F.col("request").cast("long").alias("request"), "node", _block(F.col("node"), block_nodes).alias("block"), F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("pred")).distinct())
    names = ["request", "node", "block", "dist", "pred"]
    best = offers.limit(0)
    fixed = penalties.select(F.col("request").cast("long").alias("request"), F.col("src").alias("node"), _block(F.col("src"), block_nodes).alias("block"), F.col("factor").cast("double").alias("dist"), F.col("dst").alias("pred")) if penalties is not None else None
    limit, size = float("inf") if cap is None else cap, block_nodes
    bounded, aimed, no_pred = bounds is not None, goals is not None, F.lit(None).cast("long").alias("pred")
    if aimed:
        aim = cut_lineage(goals.select(F.col("request").cast("long").alias("request"), F.col("node").alias("goal")))
    if bounded:
        lows = bounds.select(F.col("request").cast("long").alias("request"), "node", _block(F.col("node"), block_nodes).alias("block"), F.col("bound").cast("double").alias("dist"), no_pred)
        lows = cut_lineage(lows.join(aim.select("request"), "request", "left_semi"))
        others = lows.where("node is null").select("request", "dist")

    def turn(a: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        return _relax(a, state, limit, size, margin if aimed else None, bounded)

    while True:
        active = offers.select("request", "block").distinct()
        state = offers.select(*names, label(1)).union(best.join(active, ["request", "block"], "left_semi").select(*names, label(0)))
        if fixed is not None:
            state = state.union(fixed.join(active, ["request", "block"], "left_semi").select(*names, label(2)))
        if bounded:
            state = state.union(lows.join(active, ["request", "block"], "left_semi").select(*names, label(3)))
            state = state.union(active.join(others, "request").select("request", F.lit(None).cast("long").alias("node"), "block", "dist", no_pred, label(5)))
        if aimed:
            known = aim.join(best.select("request", F.col("node").alias("goal"), "dist"), ["request", "goal"], "left")
            state = state.union(active.join(known, "request").select("request", F.col("goal").alias("node"), "block", F.coalesce("dist", F.lit(float("inf"))).alias("dist"), no_pred, label(4)))
        own = least.join(F.broadcast(active.select("block").distinct()), "block", "left_semi")  # a row for each block
        moved = own.groupBy("block", "part").cogroup(state.select("*", part).groupBy("block", "part")).applyInPandas(turn, OFFERS)
        moved = cut_lineage(moved)
        labels = best.union(moved.where("not offer").select(names)).groupBy("request", "node", "block").agg(F.min(F.struct("dist", F.coalesce("pred", F.lit(-1)).alias("pred"))).alias("o"))
        best = cut_lineage(labels.select("request", "node", "block", "o.dist", F.when(F.col("o.pred") >= 0, F.col("o.pred")).alias("pred")))
        sent = moved.where("offer").groupBy("request", "node", "block").agg(F.min(F.struct("dist", "pred")).alias("o")).select("request", "node", "block", "o.dist", "o.pred")
        have = best.select("request", "node", F.col("dist").alias("had"), F.col("pred").alias("had_pred"))
        useful = (F.col("had").isNull()) | (F.col("dist") < F.col("had")) | (F.col("dist") == F.col("had")) & (F.col("pred") < F.col("had_pred"))
        offers = sent.join(have, ["request", "node"], "left").where(useful)
        if aimed:  # what the goals' costs rule out by now has no turn
            reached = aim.join(best.select("request", F.col("node").alias("goal"), "dist"), ["request", "goal"], "left")
            most = reached.groupBy("request").agg((F.max(F.coalesce("dist", F.lit(float("inf")))) * margin).alias("most"))
            offers = offers.join(most, "request", "left").where(F.col("most").isNull() | (F.col("dist") <= F.col("most")))
        offers = cut_lineage(offers.select(names))
        if offers.isEmpty():
            return best.select("request", "node", "dist", "pred")


def goal_bounds(arcs: DataFrame, goals: DataFrame, floor: Column, *, starts: DataFrame | None = None, margin: float = MARGIN, **blocks) -> DataFrame:
    """(request, node, bound): least costs to each request's goal over the arcs with their ``floor`` (as costs.cost_floor) instead of a
    cost. Floors hold for every profile of a mode and whatever penalties, so one table serves all searches to a goal.

    With starts(request, node) bounds are looked for up to ``margin`` times the (dearest) start's; a row without a node then gives that much
    as the bound of all other nodes. So a search for bounds ends about as far from its goal as the start lies.
    """
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), floor.cast("double").alias("cost"))
    found = distances(back, goals.select("request", "node"), goals=starts, margin=margin, **blocks).select("request", "node", F.col("dist").alias("bound"))
    if starts is None:
        return found
    ends = starts.select(F.col("request").cast("long").alias("request"), "node").join(found, ["request", "node"], "left")
    reach = cut_lineage(ends.groupBy("request").agg((F.max(F.coalesce("bound", F.lit(float("inf")))) * margin).alias("reach")))
    near = found.join(reach, "request", "left").where(F.col("reach").isNull() | (F.col("bound") <= F.col("reach"))).select(found.columns)
    return near.union(reach.where(F.col("reach") < float("inf")).select("request", F.lit(None).cast("long"), "reach"))


def walked_back(best: DataFrame, goals: DataFrame, *, block_nodes: int = 1 << 14) -> DataFrame:
    """goals(request, node) -> (request, node, steps_back): the nodes of each least path, from the goal. A round walks inside each
    block and hands over at its border."""
    size = block_nodes
    labels = cut_lineage(best.where("pred is not null").select(F.col("request").cast("long").alias("request"), "node", "pred", _block(F.col("node"), size).alias("block")))

    def walk(own: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        back = dict(zip(own["node"].tolist(), own["pred"].tolist()))
        rows = []
        for r, n, k in zip(at["request"].tolist(), at["node"].tolist(), at["steps_back"].tolist()):
            block = n // size
            while n in back and n // size == block:
                n, k = back[n], k + 1
                rows.append((r, n, k, n // size != block))
        return pd.DataFrame(rows, columns=["request", "node", "steps_back", "open"]).astype({"request": "int64", "node": "int64", "steps_back": "int32", "open": "bool"})

    at = goals.select(F.col("request").cast("long").alias("request"), "node", F.lit(0).alias("steps_back"))
    out = at
    while True:
        keyed = at.withColumn("block", _block(F.col("node"), size))
        step = cut_lineage(labels.groupBy("request", "block").cogroup(keyed.groupBy("request", "block")).applyInPandas(walk, "request long, node long, steps_back int, open boolean"))
        out = out.union(step.drop("open"))
        at = cut_lineage(step.where("open").drop("open"))
        if at.isEmpty():
            return out
