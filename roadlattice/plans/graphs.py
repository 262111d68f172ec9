"""Queries over the grid graph: construction, components, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlattice.operators import arcs as A
from roadlattice.operators import costs as C
from roadlattice.operators import graph as G
from roadlattice.operators import overlay as O
from roadlattice.sources.adapters import read, view

from .costs import ARCS_SQL, LEVELS_SQL, arcs, bearing, cost_sql
from .registry import query



def whole_cost() -> Column:
    """Whole-metre costs keep sums exact in both engines."""
    return (F.col("len_m") * F.when(F.col("facility") >= 2, 1).otherwise(2) + F.col("up_m") * 5).cast("double")


COST_SQL = "(len_m * CASE WHEN facility >= 2 THEN 1 ELSE 2 END + up_m * 5)"


@query(f"WITH {ARCS_SQL} SELECT arc_id, edge_id, src, dst, forward, up_m, down_m FROM ARCS")
def directed_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arcs(spark, sf_dir).select("arc_id", "edge_id", "src", "dst", "forward", "up_m", "down_m")


@query("SELECT node, count(*) AS degree FROM (SELECT a AS node FROM grid_edges UNION ALL SELECT b FROM grid_edges) GROUP BY 1")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(view(spark, sf_dir, "grid_edges"))


#: Edges that may be ridden.
OPEN = "NOT prohibited"
_COMP = f"""WITH RECURSIVE E AS (SELECT a, b FROM grid_edges WHERE {OPEN} UNION ALL SELECT b, a FROM grid_edges WHERE {OPEN}),
L(node, c) USING KEY (node) AS (SELECT node, node AS c FROM grid_nodes UNION SELECT e.b, min(l.c) FROM L l JOIN E e ON e.a = l.node JOIN recurring.L r ON r.node = e.b WHERE l.c < r.c GROUP BY e.b)"""


def _open(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, "grid_edges").where(OPEN), view(spark, sf_dir, "grid_nodes").select("node")


@query(f"{_COMP} SELECT node, c AS component FROM L")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(*_open(spark, sf_dir))


@query(f"{_COMP} SELECT c AS component, count(*) AS size FROM L GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def giant_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.giant(G.components(*_open(spark, sf_dir)))


@query(f"""{_COMP}, K AS (SELECT DISTINCT c FROM L JOIN grid_edges g ON g.a = L.node WHERE {OPEN} AND g.designated) SELECT node, row_number() OVER (ORDER BY node) - 1 AS new_id FROM L JOIN K USING (c)""")
def prune_walk_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = _open(spark, sf_dir)
    return G.pruned(edges, nodes, F.col("designated"))[1]


@query("""SELECT node FROM (SELECT a AS node, ferry FROM grid_edges UNION ALL SELECT b, ferry FROM grid_edges) GROUP BY 1 HAVING bool_or(ferry) AND bool_or(NOT ferry)""")
def ferry_terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.terminals(view(spark, sf_dir, "grid_edges"))


@query("""SELECT 1000 + r_regionkey AS id, s_suppkey AS way FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey UNION SELECT n_nationkey, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey""")
def relation_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("id"), F.col("s_suppkey").alias("member"), F.lit("way").alias("member_type"))
    nested = read(spark, sf_dir, "nation").select((1000 + F.col("n_regionkey")).cast("long").alias("id"), F.col("n_nationkey").cast("long").alias("member"), F.lit("relation").alias("member_type"))
    return G.members(ways.unionByName(nested))


def _costed(spark: SparkSession, sf_dir: str) -> DataFrame:
    legal = A.legal(arcs(spark, sf_dir).withColumn("level", F.lit(1)), freeways=True, mtb=True)
    return legal.select("arc_id", "src", "dst", "edge_id", whole_cost().alias("cost"))


def _sp(source: str, edges: str = "ARCS", where: str = "NOT prohibited", rev: bool = False) -> str:
    s, d = ("dst", "src") if rev else ("src", "dst")
    return f"""WITH RECURSIVE {ARCS_SQL}, C AS (SELECT {s} AS s, {d} AS d, min({COST_SQL}) AS c FROM {edges} WHERE {where} GROUP BY 1, 2),
D(node, dist) USING KEY (node) AS (SELECT CAST({source} AS BIGINT), CAST(0 AS BIGINT) UNION SELECT C.d, CAST(min(D.dist + C.c) AS BIGINT) FROM D JOIN C ON C.s = D.node LEFT JOIN recurring.D r ON r.node = C.d WHERE r.dist IS NULL OR D.dist + C.c < r.dist GROUP BY C.d)"""


@query(f"{_sp('42')} SELECT node, CAST(dist AS DOUBLE) AS dist FROM D")
def shortest_route_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.range(1).select(F.lit(42).cast("long").alias("node"), F.lit(0).alias("request"))
    return G.distances(_costed(spark, sf_dir), source).select("node", "dist")


@query(f"{_sp('555', rev=True)} SELECT node, CAST(dist AS DOUBLE) AS potential FROM D WHERE dist <= 12000")
def goal_potential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backward costs to a goal over reversed arcs, not followed beyond a cap."""
    back = _costed(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost")
    goal = spark.range(1).select(F.lit(555).cast("long").alias("node"), F.lit(0).alias("request"))
    return G.distances(back, goal, cap=12000.0).select("node", F.col("dist").alias("potential"))


#: Nodes of a block, few enough that all sizes of the grid have several.
BLOCK = 1024
#: Grid steps of a cell's side on the lowest level of an overlay.
SIDE = 12


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell of every node of the grid."""
    return view(spark, sf_dir, "grid_nodes").select("node", F.floor(F.col("gx") / SIDE).alias("x"), F.floor(F.col("gy") / SIDE).alias("y"))


def placed_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arcs(spark, sf_dir).withColumn("bearing_in", bearing()).withColumn("bearing_out", F.col("bearing_in"))


def _turning(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, O.Overlay]:
    usable = A.legal(placed_arcs(spark, sf_dir).withColumn("level", F.lit(1)), freeways=True, mtb=True).withColumn("cost", whole_cost())
    grid = usable.select("arc_id", "edge_id", "src", "dst", "cost", "bearing_in", "bearing_out", F.lit(None).cast("string").alias("name"))
    return usable, O.build({"grid": (grid, C.TURN[1])}, cells(spark, sf_dir))


#: Turn-aware search runs on the graph of arcs: its nodes are arcs, its arcs are turns.
_TURNS = f"""{ARCS_SQL}, B AS (SELECT arc_id, edge_id, src, dst, name, {COST_SQL} AS c, CASE WHEN dir = 0 THEN CASE WHEN forward THEN 90 ELSE 270 END ELSE CASE WHEN forward THEN 0 ELSE 180 END END AS h FROM ARCS WHERE NOT prohibited),
T AS (SELECT i.arc_id AS s, o.arc_id AS d, o.c + CASE WHEN abs((o.h - i.h + 540) % 360 - 180) < 30 THEN 0 WHEN abs((o.h - i.h + 540) % 360 - 180) >= 150 THEN 22 ELSE 11 END AS c FROM B i JOIN B o ON i.dst = o.src AND i.edge_id <> o.edge_id)"""


@query(f"""WITH RECURSIVE {_TURNS}, D(node, dist) USING KEY (node) AS (SELECT arc_id, c FROM B WHERE src = 42 UNION SELECT T.d, CAST(min(D.dist + T.c) AS BIGINT) FROM D JOIN T ON T.s = D.node LEFT JOIN recurring.D r ON r.node = T.d WHERE r.dist IS NULL OR D.dist + T.c < r.dist GROUP BY T.d)
SELECT B.dst AS node, CAST(min(dist) AS DOUBLE) AS cost FROM D JOIN B ON B.arc_id = D.node GROUP BY 1""")
def turn_aware_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable, on = _turning(spark, sf_dir)
    start = spark.range(1).select(F.lit(0).cast("long").alias("request"), F.lit(0).alias("plan"), F.lit("grid").alias("graph"), F.lit(42).cast("long").alias("start"))
    best = O.labels(on, start)
    return best.join(usable.select("arc_id", F.col("dst").alias("node")), "arc_id").groupBy("node").agg(F.min("dist").alias("cost"))


#: Plans that all sizes of the grid have: request, start, goal, and the factor of limited access.
_ASKED = [(0, 42, 187, 1.0), (1, 3, 155, 1.0), (2, 42, 187, 1.5), (3, 155, 42, 3.0)]


def _turn_plan_sql(k: int, start: int, goal: int, factor: float) -> str:
    return f"""B{k} AS (SELECT B.*, B.c * CASE WHEN g.limited_access THEN {factor} ELSE 1 END AS w FROM B JOIN grid_edges g USING (edge_id)),
T{k} AS (SELECT T.s, T.d, T.c - o.c + o.w AS c FROM T JOIN B{k} o ON o.arc_id = T.d),
D{k}(node, dist) USING KEY (node) AS (SELECT arc_id, CAST(w AS DOUBLE) FROM B{k} WHERE src = {start} UNION SELECT t.d, CAST(min(D{k}.dist + t.c) AS DOUBLE) FROM D{k} JOIN T{k} t ON t.s = D{k}.node LEFT JOIN recurring.D{k} r ON r.node = t.d WHERE r.dist IS NULL OR D{k}.dist + t.c < r.dist GROUP BY t.d)"""


@query(f"""WITH RECURSIVE {_TURNS}, {", ".join(_turn_plan_sql(*a) for a in _ASKED)}
{" UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS request, round(min(dist), 6) AS cost FROM D{k} JOIN B ON B.arc_id = D{k}.node WHERE B.dst = {goal}" for k, _, goal, _ in _ASKED)}""")
def turn_aware_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many requests on one overlay, two of them with edges of limited access made dearer: the least cost of each with its turns."""
    usable, on = _turning(spark, sf_dir)
    asked = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("request"), F.lit(0).alias("plan"), F.lit("grid").alias("graph"), F.lit(s).cast("long").alias("start"), F.lit(g).cast("long").alias("goal"), F.lit(f).alias("factor")) for k, s, g, f in _ASKED])).alias("a")
    plans = spark.range(1).select(asked).select("a.*")
    dear = usable.where("limited_access").select("edge_id").distinct().crossJoin(F.broadcast(plans.where("factor > 1").select("request", "plan", "factor")))
    return O.routes(on, plans.drop("factor"), dear).groupBy("request").agg(F.round(F.sum("spent"), 6).alias("cost"))


#: Searches with bounds: request, start, goal and the mode that prices them.
_AIMED = [(0, 42, 187, 1), (1, 3, 155, 1), (2, 155, 42, 1), (3, 187, 3, 1)]


def _aimed_sql(k: int, start: int) -> str:
    return f"D{k}(node, dist) USING KEY (node) AS (SELECT CAST({start} AS BIGINT), CAST(0 AS DOUBLE) UNION SELECT c.d, CAST(min(x.dist + c.c) AS DOUBLE) FROM D{k} x JOIN C c ON c.s = x.node LEFT JOIN recurring.D{k} r ON r.node = c.d WHERE r.dist IS NULL OR x.dist + c.c < r.dist GROUP BY c.d)"


@query(f"""WITH RECURSIVE {LEVELS_SQL}, C AS (SELECT src AS s, dst AS d, CAST(min({cost_sql(1)}) AS DOUBLE) AS c FROM LEVELLED WHERE NOT prohibited GROUP BY 1, 2), {", ".join(_aimed_sql(k, s) for k, s, _, _ in _AIMED)}
{" UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS request, round(dist, 6) AS cost FROM D{k} WHERE node = {g}" for k, _, g, _ in _AIMED)}""")
def bounded_route_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least balanced costs where lower bounds from each goal, over the floors of arcs, keep a search from spreading everywhere."""
    return bounded_labels(spark, sf_dir)[0]


def bounded_labels(spark: SparkSession, sf_dir: str, margin: float = G.MARGIN) -> tuple[DataFrame, DataFrame]:
    """Costs at the goals, and all labels that the searches kept."""
    priced = A.legal(C.priced(A.judged(arcs(spark, sf_dir))), freeways=True, mtb=True)
    priced = G.stored(priced.select("src", "dst", F.col("cost_balanced").alias("cost"), C.cost_floor(1).alias("floor")), "aimed-arcs", split=True)
    ends = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("request"), F.lit(s).cast("long").alias("start"), F.lit(g).cast("long").alias("goal")) for k, s, g, _ in _AIMED])).alias("e")
    asked = spark.range(1).select(ends).select("e.*")
    goals = asked.select("request", F.col("goal").alias("node"))
    starts = asked.select("request", F.col("start").alias("node"))
    bounds = G.goal_bounds(priced, goals, F.col("floor"), starts=starts, block_nodes=BLOCK)
    best = G.distances(priced, starts, bounds=bounds, goals=goals, margin=margin, block_nodes=BLOCK)
    return best.join(goals, ["request", "node"]).select("request", F.round("dist", 6).alias("cost")), best
