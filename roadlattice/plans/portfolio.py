"""Queries that rank the route candidates of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlattice.operators import portfolio as P
from roadlattice.sources.adapters import read, view

from .costs import ARCS_SQL, arcs
from .registry import query

_AGG = """((0.18 * l2 + 0.75 * l3 + 3.5 * fail + 4.0 * freeway + 0.8 * limited + 1.1 * hazard + 1.25 * mtb + CASE WHEN dismount > 0 THEN 450 + 1.5 * dismount ELSE 0 END
  - 0.12 * designated - 0.08 * facility - 0.12 * trail - 0.08 * residential) / CAST(greatest(dist - ferry, 1) AS DOUBLE))"""
SCORED = f"SCORED AS (SELECT *, CAST(time + fail + dismount + 0.2 * greatest(0, dist - ferry - facility) - 0.12 * trail AS DOUBLE) AS score, round(CAST({_AGG} AS DOUBLE), 9) AS aggression FROM candidates)"
KEPT = f"""{SCORED}, FIRSTS AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY time, ord, candidate) AS k FROM SCORED),
KEPT AS (SELECT s.* FROM SCORED s JOIN FIRSTS f ON f.request = s.request AND f.k = 1 WHERE s.time <= 2.2 * f.time + 600 OR s.fail + s.freeway <= f.fail + f.freeway - 80 OR (s.fail = 0 AND s.freeway = 0))"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.scored(view(spark, sf_dir, "candidates"))


@query(f"WITH {SCORED} SELECT request, candidate, round(score, 4) AS score, round(aggression, 6) AS aggression FROM SCORED")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("request", "candidate", F.round("score", 4).alias("score"), F.round("aggression", 6).alias("aggression"))


@query(f"WITH {KEPT} SELECT request, candidate FROM KEPT")
def reasonable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.reasonable(_candidates(spark, sf_dir)).select("request", "candidate")


@query(f"""WITH {SCORED}, W AS (SELECT *, dist <= 1.5 * min(dist) OVER r + 800 AND time <= 1.4 * min(time) OVER r + 300 AS practical, dist <= 1.8 * min(dist) OVER r + 1600 AND time <= 1.85 * min(time) OVER r + 600 AND fail = 0 AND freeway = 0 AS wide FROM SCORED WINDOW r AS (PARTITION BY request)),
B AS (SELECT request, min(CASE WHEN practical THEN score END) AS ps, min(CASE WHEN wide THEN score END) AS fs, arg_min(candidate, (score, time, candidate)) FILTER (practical) AS p, arg_min(candidate, (score, time, candidate)) FILTER (wide) AS f, arg_min(candidate, (score, time, candidate)) AS x FROM W GROUP BY 1)
SELECT request, CASE WHEN coalesce(fs <= ps + 600, false) THEN f ELSE coalesce(p, x) END AS candidate, coalesce(fs <= ps + 600, false) AS fully_matching FROM B""")
def recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.recommended(_candidates(spark, sf_dir))


@query("""SELECT request, candidate, CAST(k AS BIGINT) AS rank, chr(CAST(64 + k AS INTEGER)) AS letter FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY time, dist, candidate) AS k FROM candidates) WHERE k <= 6""")
def route_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.lettered(_candidates(spark, sf_dir)).select("request", "candidate", F.col("rank").cast("long").alias("rank"), "letter")


#: Routes as edge sets: a request is a ship year and month, a route an order's supplier, an edge a part block.
EDGES = "EDGES AS (SELECT DISTINCT l_suppkey % 25 AS request, l_suppkey AS route, l_partkey % 40 AS edge_id, 10 + l_partkey % 40 AS len_m FROM lineitem)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 25).alias("request"), F.col("l_suppkey").alias("route"), (F.col("l_partkey") % 40).alias("edge_id"), (10 + F.col("l_partkey") % 40).alias("len_m")).distinct()


SHARES = f"""{EDGES}, TOT AS (SELECT request, route, sum(len_m) AS m FROM EDGES GROUP BY ALL), BOTHR AS (SELECT x.request, x.route AS a, y.route AS b, sum(x.len_m) AS c FROM EDGES x JOIN EDGES y ON x.request = y.request AND x.edge_id = y.edge_id AND x.route < y.route GROUP BY ALL),
SHARES AS (SELECT b.request, b.a, b.b, c / CAST(least(p.m, q.m) AS DOUBLE) AS share FROM BOTHR b JOIN TOT p ON p.request = b.request AND p.route = b.a JOIN TOT q ON q.request = b.request AND q.route = b.b)"""


@query(f"WITH {SHARES} SELECT request, a, b, round(share, 6) AS share FROM SHARES")
def edge_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.overlap(_edges(spark, sf_dir)).withColumn("share", F.round("share", 6))


#: Pairs of one corridor among the candidates: neighbours by number have a share that their numbers give.
CORRIDOR = "CORRIDOR AS (SELECT x.request, x.candidate AS a, y.candidate AS b, 0.9 + (x.candidate * 7 + y.candidate) % 10 / 100.0 AS share FROM candidates x JOIN candidates y ON x.request = y.request AND y.candidate > x.candidate AND y.candidate < x.candidate + 400)"


def _corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = view(spark, sf_dir, "candidates").select("request", F.col("candidate").alias("a"), F.floor(F.col("candidate") / 400).alias("block"))
    y = x.select("request", F.col("a").alias("b"), F.explode(F.array(F.col("block"), F.col("block") - 1)).alias("block"))
    near = x.join(y, ["request", "block"]).where("b > a and b < a + 400")
    return near.select("request", "a", "b", (0.9 + (F.col("a") * 7 + F.col("b")) % 10 / 100.0).alias("share"))


_KEY = "({0}.fail, {0}.freeway, {0}.mtb, {0}.hazard, {0}.dismount, {0}.limited, {0}.aggression)"
BEATEN = f"""{SCORED}, {CORRIDOR}, PAIRS AS (SELECT request, a AS x, b AS y FROM CORRIDOR WHERE share >= 0.96 UNION ALL SELECT request, b, a FROM CORRIDOR WHERE share >= 0.96),
BEATEN AS (SELECT DISTINCT p.request, p.x AS candidate FROM PAIRS p JOIN SCORED s ON s.candidate = p.x AND s.request = p.request JOIN SCORED t ON t.candidate = p.y AND t.request = p.request
  WHERE t.time <= s.time + 5 AND {_KEY.format('t')} <= {_KEY.format('s')} AND (t.time < s.time OR {_KEY.format('t')} < {_KEY.format('s')} OR t.candidate < s.candidate))"""


@query(f"WITH {BEATEN} SELECT request, candidate FROM BEATEN")
def dominance_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dominated(_candidates(spark, sf_dir), _corridor(spark, sf_dir))


@query(f"""WITH {BEATEN}, FIRSTS AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY time, ord, candidate) AS k FROM SCORED),
KEPT AS (SELECT s.request, s.candidate FROM SCORED s JOIN FIRSTS f ON f.request = s.request AND f.k = 1 WHERE s.time <= 2.2 * f.time + 600 OR s.fail + s.freeway <= f.fail + f.freeway - 80 OR (s.fail = 0 AND s.freeway = 0)),
OFFERED AS (SELECT request, candidate FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY time, dist, candidate) AS k FROM SCORED) WHERE k <= 6)
SELECT s.request, s.candidate, CASE WHEN o.candidate IS NOT NULL THEN 'offered' WHEN k.candidate IS NULL THEN 'too-slow' WHEN b.candidate IS NOT NULL THEN 'dominated' ELSE 'not-chosen' END AS stage
FROM SCORED s LEFT JOIN KEPT k ON k.candidate = s.candidate LEFT JOIN BEATEN b ON b.candidate = s.candidate LEFT JOIN OFFERED o ON o.candidate = s.candidate""")
def stage_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    return P.staged(c, P.reasonable(c), P.dominated(c, _corridor(spark, sf_dir)), P.lettered(c)).select("request", "candidate", "stage")


@query("""SELECT x.request, x.candidate FROM candidates x WHERE NOT EXISTS (SELECT 1 FROM candidates y WHERE y.request = x.request AND y.time <= x.time AND y.fail <= x.fail AND y.ascent <= x.ascent AND y.dist <= x.dist AND (y.time < x.time OR y.fail < x.fail OR y.ascent < x.ascent OR y.dist < x.dist))""")
def skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.skyline(view(spark, sf_dir, "candidates"), ["time", "fail", "ascent", "dist"]).select("request", "candidate")


@query("""WITH P AS (SELECT CAST(floor(route_id / 5) AS BIGINT) AS request, route_id AS route, seq, edge_id % 400 AS node FROM route_segments),
U AS (SELECT request, route, node, min(seq) AS seq FROM P GROUP BY ALL),
B AS (SELECT x.request, x.route AS a, y.route AS b, x.node, x.seq AS sa, y.seq AS sb FROM U x JOIN U y ON x.request = y.request AND x.node = y.node AND x.route < y.route),
M AS (SELECT *, coalesce(NOT (lag(sa) OVER w = sa - 1 AND lag(sb) OVER w = sb - 1), true) AS starts, coalesce(NOT (lead(sa) OVER w = sa + 1 AND lead(sb) OVER w = sb + 1), true) AS ends FROM B WINDOW w AS (PARTITION BY request, a, b ORDER BY sa))
SELECT * FROM M WHERE starts OR ends""")
def cut_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = view(spark, sf_dir, "route_segments").select(F.floor(F.col("route_id") / 5).alias("request"), F.col("route_id").alias("route"), "seq", (F.col("edge_id") % 400).alias("node"))
    return P.cut_points(paths.groupBy("request", "route", "node").agg(F.min("seq").alias("seq")))


_SIX = f"""WITH {SCORED}, {CORRIDOR}, RANKED AS (SELECT *, candidate % 5 = 0 AS pref, row_number() OVER (PARTITION BY request ORDER BY ord, aggression DESC, time, candidate) AS place, count(*) OVER (PARTITION BY request) AS n FROM SCORED),
SIDES AS (SELECT request, a, b, share FROM CORRIDOR UNION ALL SELECT request, b, a, share FROM CORRIDOR),
MET AS (SELECT s.request, s.a AS candidate, s.b AS other, s.share, NOT (s.share < 0.96 OR (s.share < 0.99 AND (abs(x.fail - y.fail) >= 60 OR abs(x.freeway - y.freeway) >= 60 OR abs(x.limited - y.limited) >= greatest(120.0, greatest(250.0, 0.08 * least(x.dist, y.dist)) / 2) OR abs(x.mtb - y.mtb) >= 40 OR (x.dismount > 0) <> (y.dismount > 0)
  OR greatest(abs(x.facility - y.facility), abs(x.trail - y.trail), abs(x.designated - y.designated), abs(x.residential - y.residential)) >= greatest(250.0, 0.08 * least(x.dist, y.dist)) OR abs(x.hazard - y.hazard) >= 50))) AS same
  FROM SIDES s JOIN SCORED x ON x.request = s.request AND x.candidate = s.a JOIN SCORED y ON y.request = s.request AND y.candidate = s.b),
T1 AS (SELECT request, candidate, ord, 1 AS slot FROM RANKED WHERE n > 6 AND place = 1),
P1 AS (SELECT request, candidate, place, ord, pref, 1.0 AS apart, 1e9 AS spread FROM RANKED WHERE n > 6 AND place > 1 AND place < n)"""
for _k in (2, 3, 4):
    _SIX += f""",
Q{_k} AS (SELECT p.request, p.candidate, p.place, p.ord, p.pref, least(p.apart, 1 - coalesce(m.share, 0)) AS apart, least(p.spread, CAST(abs(p.ord - t.ord) AS DOUBLE)) AS spread FROM P{_k - 1} p JOIN T{_k - 1} t ON t.request = p.request AND t.slot = {_k - 1}
  LEFT JOIN MET m ON m.request = p.request AND m.candidate = p.candidate AND m.other = t.candidate WHERE NOT coalesce(m.same, false)),
T{_k} AS (SELECT request, candidate, ord, {_k} AS slot FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY round(apart + spread / 4 * 0.2 + CASE WHEN pref THEN 0.08 ELSE 0 END, 9) DESC, place) AS k FROM Q{_k}) WHERE k = 1),
P{_k} AS (SELECT q.* FROM Q{_k} q ANTI JOIN T{_k} t ON t.request = q.request AND t.candidate = q.candidate)"""


@query(f"""{_SIX}, T AS (SELECT * FROM T1 UNION ALL SELECT * FROM T2 UNION ALL SELECT * FROM T3 UNION ALL SELECT * FROM T4), LASTS AS (SELECT request, candidate, ord, 6 AS slot FROM RANKED WHERE n > 6 AND place = n),
TAKEN AS (SELECT request, candidate, slot FROM T UNION ALL SELECT request, candidate, slot FROM LASTS l WHERE NOT EXISTS (SELECT 1 FROM MET m JOIN T ON T.request = m.request AND T.candidate = m.other WHERE m.request = l.request AND m.candidate = l.candidate AND m.same) UNION ALL SELECT request, candidate, place FROM RANKED WHERE n <= 6),
NEED AS (SELECT DISTINCT request, candidate FROM (SELECT request, arg_min(candidate, (time, candidate)) AS candidate FROM SCORED GROUP BY 1 UNION ALL SELECT request, arg_min(candidate, (fail, candidate)) FROM SCORED GROUP BY 1 UNION ALL SELECT request, arg_min(candidate, (score, candidate)) FROM SCORED GROUP BY 1)),
HAVE AS (SELECT t.*, n.candidate IS NOT NULL AS required FROM TAKEN t LEFT JOIN NEED n ON n.request = t.request AND n.candidate = t.candidate), MISSING AS (SELECT n.request, count(*) AS missing FROM NEED n ANTI JOIN TAKEN t ON t.request = n.request AND t.candidate = n.candidate GROUP BY 1),
R AS (SELECT h.*, row_number() OVER (PARTITION BY h.request ORDER BY required, slot DESC) AS from_end, 6 - count(*) OVER (PARTITION BY h.request) AS free, coalesce(m.missing, 0) AS missing FROM HAVE h LEFT JOIN MISSING m USING (request))
SELECT request, candidate, required FROM R WHERE required OR from_end > greatest(0, missing - free) UNION ALL SELECT n.request, n.candidate, true FROM NEED n ANTI JOIN TAKEN t ON t.request = n.request AND t.candidate = n.candidate""")
def select_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fastest, safest and best-scored routes are required."""
    c = _candidates(spark, sf_dir).withColumn("pref", F.col("candidate") % 5 == 0)
    best = c.groupBy("request").agg(*[F.min(F.struct(k, "candidate"))["candidate"].alias(k) for k in ("time", "fail", "score")])
    required = best.select("request", F.explode(F.array("time", "fail", "score")).alias("candidate"))
    return P.select_six(c, _corridor(spark, sf_dir), required)


_METRICS = {"time": "len_m / CAST(5 AS DOUBLE)", "fail": "CASE WHEN facility = 0 THEN len_m ELSE 0 END", "danger": "hazard * 10", "caution": "lanes * 5", "gap": "CASE WHEN facility < 2 THEN len_m ELSE 0 END", "non_trail": "CASE WHEN infra THEN 0 ELSE len_m END", "rough": "surface * 3", "ascent": "up_m", "dist": "len_m"}
_SCORE = "round(" + " + ".join(f"CAST({w} AS DOUBLE) * {n}" for n, w in P.LABEL.items()) + ", 6)"


def _paths_sql() -> str:
    """All simple paths across the blocks, then those that no other dominates."""
    block = lambda n: f"CAST(floor(floor({n} / 40.0) / 3) * 20 + floor({n} % 40 / 3.0) AS BIGINT)"
    sums = ", ".join(f"p.{n} + a.{n}" for n in P.LABEL)
    beats = " AND ".join(f"y.{n} <= x.{n}" for n in P.LABEL) + " AND (" + " OR ".join(f"y.{n} < x.{n}" for n in P.LABEL) + " OR y.path < x.path)"
    return f"""WITH RECURSIVE {ARCS_SQL}, A AS (SELECT {block('src')} AS request, src, dst, edge_id AS edge, {", ".join(f"CAST({v} AS DOUBLE) AS {n}" for n, v in _METRICS.items())} FROM ARCS WHERE NOT prohibited AND {block('src')} = {block('dst')} AND src % 40 < 39),
S AS (SELECT DISTINCT request, request // 20 * 120 + request % 20 * 3 AS start FROM A),
W(request, node, nodes, path, {", ".join(P.LABEL)}) AS (SELECT request, start, [start], CAST([] AS BIGINT[]), {", ".join("CAST(0 AS DOUBLE)" for _ in P.LABEL)} FROM S
  UNION ALL SELECT p.request, a.dst, list_append(p.nodes, a.dst), list_append(p.path, a.edge), {sums} FROM W p JOIN A a ON a.request = p.request AND a.src = p.node WHERE NOT list_contains(p.nodes, a.dst) AND p.node <> p.request // 20 * 120 + p.request % 20 * 3 + 82),
G AS (SELECT * FROM W WHERE node = request // 20 * 120 + request % 20 * 3 + 82),
F AS (SELECT *, {_SCORE} AS practical FROM G x WHERE NOT EXISTS (SELECT 1 FROM G y WHERE y.request = x.request AND {beats})),
R AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY practical, path) AS rank FROM F)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths across blocks of 3 x 3 grid nodes, from their south-west to their north-east corner; no bag there can hold 16 labels."""
    a = arcs(spark, sf_dir).where("not prohibited")
    block = lambda n: (F.floor(F.floor(n / 40) / 3) * 20 + F.floor(n % 40 / 3)).cast("long")
    inner = a.where(block(F.col("src")) == block(F.col("dst"))).where(F.col("src") % 40 < 39).withColumn("request", block(F.col("src")))
    corner = F.floor(F.col("request") / 20) * 120 + F.col("request") % 20 * 3
    metrics = [F.expr(v).cast("double").alias(n) for n, v in _METRICS.items()]
    return P.section_frontier(inner.select("request", "src", "dst", F.col("edge_id").alias("edge"), corner.cast("long").alias("start"), (corner + 82).cast("long").alias("goal"), *metrics), most=16)


@query(f"{_paths_sql()} SELECT request, rank, array_to_string(path, ',') AS edges, time, fail FROM R")
def section_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags of labels in shared rounds: all paths across every block that no other dominates."""
    return _blocks(spark, sf_dir).select("request", "rank", "edges", "time", "fail")


def _kind_sql(kind: str, where: str, order: str) -> str:
    return f"SELECT request, '{kind}' AS kind, rank FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY {order}, rank) AS n FROM N {where}) WHERE n = 1"


@query(f"""{_paths_sql()}, T AS (SELECT *, first_value(time) OVER f AS ft, first_value(dist) OVER f AS fd FROM R WINDOW f AS (PARTITION BY request ORDER BY time, rank)),
B AS (SELECT *, first_value(fail) OVER (PARTITION BY request ORDER BY practical, rank) AS pf, min(fail) OVER (PARTITION BY request) AS sf FROM T WHERE time <= 1.85 * ft + 600 AND dist <= 1.8 * fd + 1600), N AS (SELECT *, fail <= greatest(sf + 80, pf + 20) AS near FROM B)
{" UNION ALL ".join([_kind_sql("practical", "", "practical"), _kind_sql("safest", "", ", ".join(P.LABEL_SAFETY)), *[_kind_sql(k, "WHERE near", f"{k}, practical") for k in ("caution", "gap", "non_trail", "ascent")]])}""")
def section_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a section's paths become children, and as what."""
    return P.frontier_choices(_blocks(spark, sf_dir))
