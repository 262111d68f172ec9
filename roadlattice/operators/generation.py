"""Candidate routes: many searches in one, probes that differ from a seed, legs, strict routes and their retries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import overlay
from .arcs import legal
from .costs import MODES, TURN, profile_name
from .graph import Dealt, cut_lineage, dealt, distances, stored, walked_back
from .portfolio import SAFETY, dominated, lettered, overlap, reasonable, recommended, select_six
from .recombine import LEAST_PART_M, alike_pairs, crossbred, distinct_routes, ferry_seeds, ferry_signatures, totalled
from .requests import different, profiles
from .sequences import islands

#: Bits of a node's number below those of its graph, and of a search's number below its request's.
NODE_BITS, PLAN_BITS = 40, 6
#: Factors by which probes make a seed's edges dearer (quick, balanced, safer, wide), and how often a strict search is tried.
PROBES = {"quick": ("fastest", 1.3), "balanced": ("fastest", 1.35), "safer": ("safest", 1.35), "wide": ("fastest", 1.6)}
CROSSING_M, RETRIES, BARRED = 40, 8, 1e15
#: A stricter speed without a shoulder for discovery, and the bounds that it keeps.
STRICTER_MPH, LEAST_MPH, MOST_MPH = 5, 15, 30
#: Exponent that flattens the factors of the direct lens.
FLATTEN = 0.22


@dataclass
class Copies:
    """Graphs for any number of searches: their arcs on copies of the nodes of their own, as tables in the shared folder."""

    number: dict[str, int]
    arcs: DataFrame
    dealt: Dealt


def copies(graphs: dict[str, DataFrame], **blocks) -> Copies:
    """graphs gives arcs(edge_id, src, dst, cost) by name."""
    number = {name: i for i, name in enumerate(graphs)}
    copy = lambda i, node: (F.lit(i << NODE_BITS) + node).cast("long")
    arcs = None
    for name, i in number.items():
        part = graphs[name].select("edge_id", copy(i, F.col("src")).alias("src"), copy(i, F.col("dst")).alias("dst"), F.col("cost").cast("double").alias("cost"))
        arcs = part if arcs is None else arcs.union(part)
    arcs = stored(arcs, "copies")
    return Copies(number, arcs, dealt(arcs.select("src", "dst", "cost"), **blocks))


def searched(graphs: dict[str, DataFrame] | Copies, plans: DataFrame, penalties: DataFrame | None = None, **blocks) -> DataFrame:
    """The least-cost path of every plan: (request, plan, step, edge_id, src, dst, cost), steps from 0.

    graphs gives arcs(edge_id, src, dst, cost) by name, or what ``copies`` made of them; plans has request, plan (0 to 63), graph, start and goal; penalties
    (request, plan, edge_id, factor) make edges dearer for one plan. All plans run in the same rounds, each on its graph's copy of
    the nodes, and each until its goal's cost is known. A plan whose goal is not reached gives no rows.
    """
    on = graphs if isinstance(graphs, Copies) else copies(graphs, **blocks)
    arcs = on.arcs
    shift = F.lit(None).cast("long")
    for name, i in on.number.items():
        shift = F.when(F.col("graph") == name, F.lit(i << NODE_BITS)).otherwise(shift)
    key = (F.col("request") * (1 << PLAN_BITS) + F.col("plan")).cast("long")
    keyed = cut_lineage(plans.select(key.alias("key"), (F.col("start") + shift).alias("start"), (F.col("goal") + shift).alias("goal")))
    dear = None
    if penalties is not None:
        p = penalties.join(plans.select("request", "plan", "graph"), ["request", "plan"]).select(key.alias("request"), "edge_id", "factor", shift.alias("shift"))
        ends = arcs.select("edge_id", "src", "dst")
        dear = p.join(ends, "edge_id").where(F.col("src").between(F.col("shift"), F.col("shift") + ((1 << NODE_BITS) - 1))).groupBy("request", "src", "dst").agg(F.max("factor").alias("factor"))
        dear = cut_lineage(dear)
    goals = keyed.select(F.col("key").alias("request"), F.col("goal").alias("node"))
    best = distances(on.dealt, keyed.select(F.col("key").alias("request"), F.col("start").alias("node")), penalties=dear, cap=BARRED / 2, goals=goals, margin=1.0)
    reached = goals.join(best.select("request", "node"), ["request", "node"], "left_semi")
    back = walked_back(best, reached, block_nodes=on.dealt.block_nodes)
    w = Window.partitionBy("request").orderBy(F.desc("steps_back"))
    hops = back.select("request", F.col("node").alias("src"), F.lead("node").over(w).alias("dst"), (F.row_number().over(w) - 1).alias("step")).where("dst is not null")
    hops = cut_lineage(hops)
    cheapest = arcs.join(hops.select("src", "dst").distinct(), ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.min(F.struct("cost", "edge_id")).alias("a"))
    mask = (1 << NODE_BITS) - 1
    return hops.join(cheapest, ["src", "dst"]).select(
        F.shiftright("request", PLAN_BITS).alias("request"), F.col("request").bitwiseAND(F.lit((1 << PLAN_BITS) - 1)).cast("int").alias("plan"), "step", "a.edge_id",
        F.col("src").bitwiseAND(F.lit(mask)).alias("src"), F.col("dst").bitwiseAND(F.lit(mask)).alias("dst"), "a.cost",
    )


def measured(paths: DataFrame, arcs: DataFrame) -> DataFrame:
    """Totals of each (request, plan) over its arcs(edge_id, src, time_s, level and the flags of an edge)."""
    a = arcs.dropDuplicates(["edge_id", "src"]).drop("dst", "cost", "arc_id")
    j = paths.join(a, ["edge_id", "src"])
    metres = lambda test: F.sum(F.when(test, F.col("len_m")).otherwise(0))
    return j.groupBy("request", "plan").agg(
        F.sum("cost").alias("cost"), F.sum("len_m").alias("dist"), F.sum("time_s").alias("time"), F.sum("up_m").alias("ascent"), metres((F.col("level") == 4) & ~F.col("ferry")).alias("fail"), metres(F.col("ferry")).alias("ferry"),
        metres(F.col("freeway")).alias("freeway"), metres(F.col("limited_access")).alias("limited"), metres(F.col("mtb")).alias("mtb"), metres(F.col("dismount")).alias("dismount"), metres(F.col("designated")).alias("designated"),
        metres(F.col("facility") >= 2).alias("facility"), metres(F.col("infra")).alias("trail"), metres(F.col("hazard") >= 2).alias("hazard"), metres((F.col("road_class") <= 3) & (F.col("facility") == 0)).alias("residential"), F.count("*").alias("edges"),
    )


def stricter_mph(mph: Column) -> Column:
    """Speed up to which discovery accepts no shoulder: 5 mph less, between 15 and 30; null if that is no stricter."""
    s = F.greatest(F.lit(LEAST_MPH), F.least(F.lit(MOST_MPH), mph - STRICTER_MPH))
    return F.when(s < mph, s)


def flattened(cost: Column, time: Column) -> Column:
    """Cost of the direct lens: what makes an arc dearer or cheaper than its time counts by a small power."""
    return time * F.pow(F.greatest(cost, F.lit(1e-6)) / F.greatest(time, F.lit(1e-6)), F.lit(FLATTEN))


def legs_merged(paths: DataFrame, n_legs: int) -> DataFrame:
    """Paths whose plans are the legs 0.. of a request -> (request, seq, leg, edge_id, src, dst, cost): the legs after each other. A
    request with a leg that has no path has no route."""
    whole = paths.groupBy("request").agg(F.count_distinct("plan").alias("legs")).where(F.col("legs") == n_legs)
    seq = F.row_number().over(Window.partitionBy("request").orderBy("plan", "step")) - 1
    return paths.join(whole.select("request"), "request", "left_semi").select("request", seq.alias("seq"), F.col("plan").alias("leg"), "edge_id", "src", "dst", "cost")


def rejected_crossings(route: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """route(request, seq, edge_id, level, freeway, len_m) -> (request, edge_id) to be barred: of every run of level 4 that is no crossing
    (over 40 m together, or at an end of the route) its longest edge of at most 40 m, if that is not exempt."""
    fails = (F.col("level") == 4) & ~F.col("freeway")
    runs = islands(route.withColumn("fails", fails), F.col("fails"), "run", keys=["request"], order=["seq"])
    per_run, ends = Window.partitionBy("request", "run"), Window.partitionBy("request")
    r = runs.withColumns({"run_m": F.sum("len_m").over(per_run), "first": F.min("seq").over(per_run), "last": F.max("seq").over(per_run), "lo": F.min("seq").over(ends), "hi": F.max("seq").over(ends)})
    crossing = (F.col("first") > F.col("lo")) & (F.col("last") < F.col("hi")) & (F.col("run_m") <= CROSSING_M)
    bad = r.where(F.col("fails") & ~crossing & (F.col("len_m") <= CROSSING_M))
    if exempt is not None:
        bad = bad.join(exempt.select("request", "edge_id"), ["request", "edge_id"], "left_anti")
    return bad.groupBy("request", "run").agg(F.max(F.struct("len_m", (-F.col("seq")).alias("s"), "edge_id")).alias("b")).select("request", "b.edge_id").distinct()


def strict_arcs(arcs: DataFrame, exempt: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(arcs of the strict graph, their attributes, factors of requests): legal arcs, and failing ones near someone's ends at a cost that
    nobody pays but those whom a factor brings back to theirs."""
    usable = stored(legal(arcs, require_safe=True, freeways=True, mtb=True), "strict-arcs")
    if exempt is None:
        return usable, usable, None
    extra = legal(arcs, freeways=True, mtb=True).join(exempt.select("edge_id").distinct(), "edge_id", "left_semi").join(usable.select("edge_id", "src"), ["edge_id", "src"], "left_anti")
    extra = cut_lineage(extra.select(usable.columns))
    allowed = extra.select("edge_id", "cost").join(exempt.select("request", "edge_id").distinct(), "edge_id").groupBy("request", "edge_id").agg(F.min("cost").alias("cost"))
    allowed = cut_lineage(allowed.select("request", F.lit(0).alias("plan"), "edge_id", (F.col("cost") / (2 * BARRED)).alias("factor")))
    return usable.union(extra.withColumn("cost", F.lit(2 * BARRED))), usable.union(extra), allowed


def strict_routes(arcs: DataFrame, requests: DataFrame, exempt: DataFrame | None = None, retries: int = RETRIES, find=None, parts=None, **blocks) -> DataFrame:
    """requests(request, start, goal) -> (request, tries, seq, edge_id, src, dst, cost, level, len_m): least-cost routes on which every
    failing stretch is a short crossing.

    arcs(edge_id, src, dst, cost, level, freeway, len_m and what ``legal`` needs). Failing arcs of at most 40 m are let in; where a
    route uses some as more than a crossing, the longest of each stretch is barred for its request and that is searched again,
    at most ``retries`` times. Requests that are still not clean, or have no path, give no rows. Exempt edges (request,
    edge_id; near the route's ends, see requests.terminal_access) may be used by their request whatever their length, and are never
    barred for it. Parallel arcs count as the cheapest of them. ``find`` (plans, penalties) searches instead of ``searched``, as on an
    overlay built with ``parts`` (see strict_arcs).
    """
    usable, attr, allowed = parts or strict_arcs(stored(arcs.select("edge_id", "src", "dst", "cost", "level", "freeway", "len_m", "prohibited", "ferry", "mtb"), "strict-all", split=True), exempt)
    attr = attr.select("edge_id", "src", "level", "freeway", "len_m", "cost")
    graph = None if find else copies({"strict": usable.select("edge_id", "src", "dst", "cost")}, **blocks)
    plan = lambda r: r.select("request", F.lit(0).alias("plan"), F.lit("strict").alias("graph"), "start", "goal")
    todo, barred, done = requests, None, None
    for attempt in range(retries + 1):
        dear = barred.select("request", F.lit(0).alias("plan"), "edge_id", F.lit(BARRED).alias("factor")) if barred is not None else None
        dear = dear.union(allowed) if dear is not None and allowed is not None else allowed if dear is None else dear
        paths = stored((find(plan(todo), dear) if find else searched(graph, plan(todo), dear)).select("request", F.col("step").alias("seq"), "edge_id", "src", "dst"), "strict-paths")
        used = attr.join(paths.select("edge_id", "src").distinct(), ["edge_id", "src"], "left_semi").dropDuplicates(["edge_id", "src"])
        route = cut_lineage(paths.join(used, ["edge_id", "src"]))
        bad = cut_lineage(rejected_crossings(route, exempt))
        good = route.join(bad.select("request").distinct(), "request", "left_anti").select("request", F.lit(attempt).alias("tries"), "seq", "edge_id", "src", "dst", "cost", "level", "len_m")
        good = cut_lineage(good)
        done = good if done is None else done.union(good)
        todo = cut_lineage(todo.join(bad.select("request").distinct(), "request", "left_semi"))
        if todo.isEmpty():
            break
        barred = bad if barred is None else cut_lineage(barred.union(bad).distinct())
    return done


#: Plans of a request: twelve profiles, the probes, discovery, the lens and its probe, the strict route.
PROFILES = [(m, d, r) for m in MODES for d in (False, True) for r in (False, True)]
#: The profiles of discovery, which are all that its arcs need prices for.
DISCOVERED = [("direct", False, False), ("low", True, True), ("balanced", True, True)]
FIRST_PROBE, FIRST_DISCOVERY, LENS, LENS_PROBE, STRICT = 12, 16, 19, 20, 21
#: Fewer different routes than this call for probes; a gentle discovery may take so many times the direct one's time and seconds more.
ENOUGH, GENTLE_TIMES, GENTLE_S = 5, 2.2, 600
#: What probes search (mode, signed, quiet), off which seed, and by what factor; None takes what the request forces.
PROBE_PLANS = [("direct", None, None, "fastest", 1.3), ("balanced", True, True, "fastest", 1.35), ("low", True, True, "safest", 1.35), ("balanced", None, True, "fastest", 1.6)]


def _graph_name(mode: str, designated: Column, residential: Column) -> Column:
    return F.concat(F.lit(mode), F.when(designated, "_signed").otherwise(""), F.when(residential, "_quiet").otherwise(""))


def pool_graphs(arcs: DataFrame, discovery: DataFrame, exempt: DataFrame | None = None) -> tuple[dict, tuple]:
    """The graphs that a pool searches, each with its turn cost, and the strict graph's parts. arcs have the costs of all profiles under
    the rider's rules (costs.priced_profiles), discovery those of DISCOVERED for the same arcs under stricter ones."""
    usable, turn = legal(arcs, freeways=True, mtb=True), dict(zip(MODES, TURN))
    shape = lambda df, cost: df.select("arc_id", "edge_id", "src", "dst", cost.alias("cost"), "bearing_in", "bearing_out", "name")
    graphs = {profile_name(*p): (shape(usable, F.col(f"cost_{profile_name(*p)}")), turn[p[0]]) for p in PROFILES}
    careful = legal(discovery, freeways=True, mtb=True)
    for p in DISCOVERED:
        graphs[f"discover_{p[0]}"] = (shape(careful, F.col(f"cost_{profile_name(*p)}")), turn[p[0]])
    for mode, both in (("direct", False), ("balanced", True)):
        graphs[f"lens_{mode}"] = (shape(usable, flattened(F.col(f"cost_{profile_name(mode, both, both)}"), F.col("time_s"))), turn[mode])
    parts = strict_arcs(arcs.withColumn("cost", F.col("cost_direct_signed_quiet")), exempt)
    graphs["strict"] = (shape(parts[0], F.col("cost")), turn["direct"])
    return graphs, parts


def pool(arcs: DataFrame, discovery: DataFrame, requests: DataFrame, nodes: DataFrame, exempt: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """requests(request, start, goal, prefer_designated, prefer_residential) -> (paths, totals) of all candidates, with turns priced.

    Plans: the profiles that the request leaves (0 to 11); where fewer than five of their routes are different, four probes off the
    fastest and the safest (12 to 15); without a boat on any of these, discovery on roads that stricter rules (``discovery``, see
    pool_graphs) price: direct, gentle (kept within 2.2 times the direct one's time and 600 s) and an alternative off the direct one's
    edges (16 to 18); the direct lens and its probe (19, 20); where nothing matches fully, a strict route (21); and ferry itineraries with a land
    section searched anew (100 and up, see refined_ferries; their costs are not given). Probes leave protected
    infrastructure at its price. All searches of a step run together on one overlay (see overlay.build); nodes(node, x, y) are its cells.
    exempt(request, edge_id) are failing edges near the ends (requests.terminal_access). Totals are judged under the rider's rules.
    """
    arcs, requests = stored(arcs, "pool-arcs"), stored(requests, "pool-requests")
    graphs, parts = pool_graphs(arcs, stored(discovery, "pool-discovery"), exempt)
    on = overlay.build(graphs, nodes)
    columns = ["request", "plan", "step", "edge_id", "src", "dst", "cost"]
    find = lambda plans, dear=None: overlay.routes(on, plans, dear, cap=BARRED / 2)
    plan = lambda k, graph, r=requests: r.select("request", F.lit(k).cast("int").alias("plan"), (F.lit(graph) if isinstance(graph, str) else graph).alias("graph"), "start", "goal")
    forced_d, forced_r = F.coalesce("prefer_designated", F.lit(False)), F.coalesce("prefer_residential", F.lit(False))

    number = F.lit(None).cast("int")
    for k, p in enumerate(PROFILES):
        number = F.when((F.col("mode") == p[0]) & (F.col("designated") == p[1]) & (F.col("residential") == p[2]), k).otherwise(number)
    first = profiles(requests).join(requests.select("request", "start", "goal"), "request")
    first = first.select("request", number.alias("plan"), F.concat("mode", F.when(F.col("designated"), "_signed").otherwise(""), F.when(F.col("residential"), "_quiet").otherwise("")).alias("graph"), "start", "goal")
    own = stored(find(first.unionByName(plan(LENS, "lens_direct")).unionByName(plan(FIRST_DISCOVERY, "discover_direct"))), "pool-first")
    totals = stored(measured(own, arcs), "pool-totals")
    base = totals.where(F.col("plan") < FIRST_PROBE).withColumn("candidate", F.col("plan"))
    shares = stored(overlap(own.where(F.col("plan") < FIRST_PROBE).join(arcs.select("edge_id", "src", "len_m").dropDuplicates(["edge_id", "src"]), ["edge_id", "src"]).withColumn("route", F.col("plan"))), "pool-shares")
    alike = shares.join(different(base, shares), ["request", "a", "b"], "left_anti")
    apart = distinct_routes(base, alike, ["plan"]).groupBy("request").agg(F.count("*").alias("different"))
    fewest = F.min(F.struct(*[c for c in SAFETY if c in base.columns and c != "aggression"], "plan"))["plan"]
    kinds = base.groupBy("request").agg(F.min(F.struct("time", "plan"))["plan"].alias("fastest"), fewest.alias("safest"), F.max("ferry").alias("ferry"))
    kinds = stored(kinds.join(apart, "request"), "pool-kinds")

    open_ = requests.join(kinds.where(F.col("different") < ENOUGH).select("request"), "request", "left_semi")
    dry = requests.join(kinds.where("ferry = 0").select("request"), "request", "left_semi")
    ordinary = arcs.where(~F.col("infra") & (F.col("facility") < 4)).select("edge_id").distinct()
    more, dear = plan(LENS_PROBE, "lens_balanced").unionByName(plan(FIRST_DISCOVERY + 1, "discover_low", dry)).unionByName(plan(FIRST_DISCOVERY + 2, "discover_balanced", dry)), None
    seeds = [(LENS, LENS_PROBE, PROBES["balanced"][1]), (FIRST_DISCOVERY, FIRST_DISCOVERY + 2, PROBES["balanced"][1])]
    for seed, k, factor in seeds:
        part = own.where(F.col("plan") == seed).select("request", F.lit(k).cast("int").alias("plan"), "edge_id", F.lit(factor).alias("factor"))
        dear = part if dear is None else dear.union(part)
    for k, (mode, d, r, seed, factor) in enumerate(PROBE_PLANS, FIRST_PROBE):
        more = more.unionByName(plan(k, _graph_name(mode, forced_d if d is None else F.lit(d), forced_r if r is None else F.lit(r)), open_))
        part = kinds.where(F.col("different") < ENOUGH).select("request", F.col(seed).alias("plan")).join(own, ["request", "plan"])
        dear = dear.union(part.select("request", F.lit(k).cast("int").alias("plan"), "edge_id", F.lit(factor).alias("factor")))
    dear = stored(dear.distinct().join(ordinary, "edge_id", "left_semi").select("request", "plan", "edge_id", "factor"), "pool-dear")
    found = stored(own.join(dry.select("request").withColumn("dry", F.lit(True)), "request", "left").where((F.col("plan") != FIRST_DISCOVERY) | F.col("dry")).select(columns).union(find(more, dear).select(columns)), "pool-more")
    totals = stored(measured(found, arcs), "pool-totals")
    direct = totals.where(F.col("plan") == FIRST_DISCOVERY).select("request", F.col("time").alias("direct_time"))
    slow = totals.where(F.col("plan") == FIRST_DISCOVERY + 1).join(direct, "request").where(F.col("time") > GENTLE_TIMES * F.col("direct_time") + GENTLE_S).select("request", "plan")
    unmatched = stored(requests.join(totals.where("fail = 0").select("request").distinct(), "request", "left_anti"), "pool-unmatched")
    paths = found.join(slow, ["request", "plan"], "left_anti").select(columns)
    if not unmatched.isEmpty():
        strict = strict_routes(arcs, unmatched, exempt, find=lambda plans, d=None: find(plans, d).select(columns), parts=parts)
        paths = paths.union(strict.select("request", F.lit(STRICT).alias("plan"), F.col("seq").cast("int").alias("step"), "edge_id", "src", "dst", "cost"))
    refined = refined_ferries(stored(measured_edges(found.join(slow, ["request", "plan"], "left_anti"), arcs), "pool-edges"), arcs, lambda plans, d=None: find(plans, d).select(columns))
    paths = stored(paths.union(refined.select(columns)), "pool-paths")
    return paths, measured(paths, arcs)


#: Where the other plans stand among the profiles, which stand at 0, 0.1, 0.2, 0.3, 1, ...; children of two routes behind them.
PLACES = {12: 0.45, 13: 1.45, 14: 2.35, 15: 1.55, 16: 0.48, 17: 2.28, 18: 1.48, LENS: 0.46, LENS_PROBE: 1.46, STRICT: 2.42}
FIRST_CHILD, CHILD_PLACE, REFINED_PLACE = 64, 1.47, 1.53


def measured_edges(paths: DataFrame, arcs: DataFrame) -> DataFrame:
    """paths(request, plan, step, edge_id, src) -> rows for recombine.crossbred: every edge with what it adds to a route's metrics."""
    metres = lambda test: F.when(test, F.col("len_m")).otherwise(0)
    a = arcs.dropDuplicates(["edge_id", "src"]).drop("dst", "cost", "arc_id")
    return paths.select("request", "plan", "step", "edge_id", "src", F.col("dst").alias("end")).join(a, ["edge_id", "src"]).select(
        "request", F.col("plan").cast("long").alias("route"), F.col("step").cast("long").alias("seq"), "edge_id", F.col("src").alias("node"), "end", "len_m", F.col("time_s").alias("time"), metres((F.col("level") == 4) & ~F.col("ferry")).alias("fail"), metres(F.col("freeway")).alias("freeway"),
        metres(F.col("mtb")).alias("mtb"), metres(F.col("hazard") >= 2).alias("hazard"), metres(F.col("dismount")).alias("dismount"), metres(F.col("limited_access")).alias("limited"), metres(F.col("ferry")).alias("ferry"), metres(F.col("facility") >= 2).alias("facility"),
        metres(F.col("infra")).alias("trail"), metres(F.col("designated")).alias("designated"), metres((F.col("road_class") <= 3) & (F.col("facility") == 0)).alias("residential"), metres(F.col("level") == 2).alias("l2"), metres(F.col("level") == 3).alias("l3"),
    )


#: Refined ferry itineraries are numbered from here; bits of a section's number and of a plan's in the number of a section's search.
FIRST_REFINED, SECTION_BITS, SEED_BITS = 100, 14, 6
#: A replacement may take so many times the quickest way over its section and seconds more, unless it fails by 80 m less; one that fails by 80 m
#: more must gain at least so many friendly metres, or that share of its own.
SECTION_TIMES, SECTION_S, LESS_FAIL_M, FRIENDLY_M, FRIENDLY_SHARE = 1.85, 300, 80, 1600, 0.08


def refined_ferries(edges: DataFrame, arcs: DataFrame, find) -> DataFrame:
    """edges (measured_edges, with the node where each ends) -> (request, plan, step, edge_id, src, dst, cost): itineraries of which one
    land section between boats is searched anew, numbered from FIRST_REFINED.

    Seeds are those of ferry_seeds (discovery apart) with two land sections of 1000 m or more. Every such section is searched between
    its own ends under the stricter rules, directly and then balanced off the direct one's ordinary edges (``find`` with the graphs
    discover_direct and discover_balanced). The second replaces the section if it stays on land, differs from it, and is about as quick
    or fails less, and friendlier if it fails more. Boats and the other sections stay. All sections of all seeds share the searches.
    A request without boats has no rows. Requests must be under 2^37, plans under 64 and an itinerary's sections under 2^14.
    """
    key = (F.col("request") * (1 << SEED_BITS) + F.col("route")).cast("long")
    boats = ferry_signatures(edges.select(key.alias("route"), "seq", "edge_id", (F.col("ferry") > 0).alias("ferry")))
    signed = totalled(edges).join(boats.select(F.col("route").alias("k"), "signature"), key == F.col("k")).where(~F.col("candidate").between(FIRST_DISCOVERY, FIRST_DISCOVERY + 2))
    seeds = stored(ferry_seeds(signed).select("request", F.col("candidate").alias("route")).distinct(), "ferry-seeds")
    if seeds.isEmpty():
        return edges.limit(0).select("request", F.col("route").cast("int").alias("plan"), F.col("seq").cast("int").alias("step"), "edge_id", F.col("node").alias("src"), F.col("end").alias("dst"), F.lit(0.0).alias("cost"))
    own = islands(edges.join(seeds, ["request", "route"], "left_semi"), F.col("ferry") > 0, "run", keys=["request", "route"], order=["seq"])
    own = stored(own.withColumn("search", ((F.col("request") * (1 << SEED_BITS) + F.col("route")) * (1 << SECTION_BITS) + F.col("run")).cast("long")), "ferry-own")
    first_last = [F.min(F.struct("seq", "node"))["node"].alias("start"), F.max(F.struct("seq", "end"))["end"].alias("goal")]
    land = own.where("ferry <= 0").groupBy("request", "route", "run", "search").agg(*first_last, F.sum("len_m").alias("m")).where(F.col("m") >= LEAST_PART_M)
    land = stored(land.join(land.groupBy("request", "route").agg(F.count("*").alias("n")).where("n >= 2"), ["request", "route"], "left_semi"), "ferry-land")
    ask = lambda k, graph: land.select(F.col("search").alias("request"), F.lit(k).cast("int").alias("plan"), F.lit(graph).alias("graph"), "start", "goal").where("start <> goal")
    columns = ["request", "plan", "step", "edge_id", "src", "dst", "cost"]
    direct = stored(find(ask(1, "discover_direct"), None).select(columns), "ferry-direct")
    ordinary = arcs.where(~F.col("infra") & (F.col("facility") < 4)).select("edge_id").distinct()
    dear = direct.select("request", F.lit(2).cast("int").alias("plan"), "edge_id", F.lit(PROBES["balanced"][1]).alias("factor")).distinct().join(ordinary, "edge_id", "left_semi").select("request", "plan", "edge_id", "factor")
    other = stored(find(ask(2, "discover_balanced"), stored(dear, "ferry-dear")).select(columns), "ferry-other")
    before = own.join(land.select("search"), "search", "left_semi").withColumn("request", F.col("search")).withColumn("route", F.lit(0).cast("long")).drop("search", "run")
    tried = stored(before.unionByName(measured_edges(direct.unionByName(other), arcs)), "ferry-tried")
    c, shares = stored(totalled(tried), "ferry-totals"), overlap(tried)
    like = alike_pairs(c, shares).where("a = 0 and b = 2").select("request")
    o, d, x = (c.where(F.col("candidate") == k).alias(n) for k, n in ((0, "o"), (1, "d"), (2, "x")))
    j = x.join(o, F.col("x.request") == F.col("o.request")).join(d, F.col("x.request") == F.col("d.request"))
    quick = F.col("x.time") <= SECTION_TIMES * F.least("o.time", "d.time") + SECTION_S
    safer = F.col("x.fail") + LESS_FAIL_M < F.least("o.fail", "d.fail")
    gain = sum((F.col(f"x.{n}") - F.col(f"o.{n}") for n in ("facility", "designated", "residential")), F.lit(0))
    friendly = (F.col("x.fail") <= F.col("o.fail") + LESS_FAIL_M) | (gain >= F.greatest(F.lit(FRIENDLY_M), F.col("x.dist") * FRIENDLY_SHARE))
    taken = j.where((F.col("x.ferry") <= 0) & (quick | safer) & friendly).select(F.col("x.request").alias("search")).join(like.withColumnRenamed("request", "search"), "search", "left_anti")
    number = (F.row_number().over(Window.partitionBy("request").orderBy("route", "run")) + (FIRST_REFINED - 1)).cast("int")
    made = stored(land.join(taken, "search", "left_semi").select("request", "route", "search", F.col("run").alias("section"), number.alias("plan")), "ferry-made")
    kept = own.join(made.select("request", "route", "section", "plan"), ["request", "route"]).where(F.col("run") != F.col("section"))
    kept = kept.select("request", "plan", F.struct("run", F.col("seq").alias("at")).alias("place"), "edge_id", F.col("node").alias("src"), F.col("end").alias("dst"))
    new = other.select(F.col("request").alias("search"), "step", "edge_id", "src", "dst").join(made, "search").select("request", "plan", F.struct(F.col("section").alias("run"), F.col("step").cast("long").alias("at")).alias("place"), "edge_id", "src", "dst")
    step = (F.row_number().over(Window.partitionBy("request", "plan").orderBy("place")) - 1).cast("int")
    return kept.unionByName(new).select("request", "plan", step.alias("step"), "edge_id", "src", "dst", F.lit(0.0).alias("cost"))


def composed(paths: DataFrame, arcs: DataFrame) -> DataFrame:
    """The pool's paths -> what a request offers: (request, rank, letter, candidate, recommended, totals).

    Candidates are the pool's plans and their cross-bred children (64 and up). Too slow ones go, then those that are like one before them,
    then those that another of their corridor beats; six of the others are chosen, the recommended one among them, and lettered by time.
    """
    raw = stored(measured_edges(paths, arcs).drop("end"), "composed-edges")
    child_paths, children = crossbred(raw)
    number = (F.row_number().over(Window.partitionBy("request").orderBy("score", "candidate")) + (FIRST_CHILD - 1)).cast("long")
    numbered = stored(children.select("request", F.col("candidate").alias("route"), number.alias("number")), "composed-children")
    born = child_paths.join(numbered, ["request", "route"]).withColumn("route", F.col("number")).select(raw.columns)
    edges = stored(raw.unionByName(born), "composed-all")
    place = F.col("candidate")
    order = F.when(place >= FIRST_REFINED, REFINED_PLACE + (place - FIRST_REFINED) * 0.001).when(place >= FIRST_CHILD, CHILD_PLACE + (place - FIRST_CHILD) * 0.001)
    for k, at in PLACES.items():
        order = order.when(place == k, at)
    c = totalled(edges).withColumns({"ord": order.otherwise(F.floor(place / 4) + place % 4 * 0.1).cast("double"), "pref": (place < FIRST_PROBE) & (place % 4 == 3) | place.isin(13, 14, 17, 18, LENS_PROBE)})
    c = stored(c, "composed-totals")
    shares = stored(overlap(edges), "composed-shares")
    kept = reasonable(c)
    unlike = kept.join(distinct_routes(kept, alike_pairs(kept, shares), ["ord", F.desc("aggression"), "time", "candidate"]), ["request", "candidate"], "left_semi")
    unlike = stored(unlike, "composed-unlike")
    left = stored(unlike.join(dominated(unlike, shares).select("request", "candidate"), ["request", "candidate"], "left_anti"), "composed-left")
    star = stored(recommended(left), "composed-star")
    six = select_six(left, shares, star.select("request", "candidate"))
    out = lettered(left.join(six.select("request", "candidate"), ["request", "candidate"], "left_semi"))
    marked = out.join(star.select("request", "candidate", F.lit(True).alias("star")), ["request", "candidate"], "left")
    return marked.select("request", "rank", "letter", "candidate", F.coalesce("star", F.lit(False)).alias("recommended"), "time", "dist", "fail", "score")


def connector(arcs: DataFrame, requests: DataFrame, blocked: DataFrame | None = None, **blocks) -> DataFrame:
    """A way to a planned route's start, or on from where a rider is: one balanced search that failing roads don't bar; blocked(request,
    edge_id) are."""
    graph = {"balanced": legal(arcs, freeways=True, mtb=True).select("edge_id", "src", "dst", F.col("cost_balanced").alias("cost"))}
    plans = requests.select("request", F.lit(0).alias("plan"), F.lit("balanced").alias("graph"), "start", "goal")
    dear = blocked.select("request", F.lit(0).alias("plan"), "edge_id", F.lit(BARRED).alias("factor")) if blocked is not None else None
    return searched(graph, plans, dear, **blocks)
