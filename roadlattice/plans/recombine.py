"""Queries that recombine and choose candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlattice.operators import recombine as R
from roadlattice.sources.adapters import view

from .portfolio import CORRIDOR, SCORED, _KEY, _candidates, _corridor
from .registry import query

PATHS = "PATHS AS (SELECT CAST(floor(route_id / 5) AS BIGINT) AS request, route_id AS route, seq, edge_id, edge_id % 400 AS node, len_m, len_m * 10 // mph AS time, CASE WHEN level = 4 THEN len_m ELSE 0 END AS fail, ferry FROM route_segments)"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "route_segments")
    return s.select(F.floor(F.col("route_id") / 5).alias("request"), F.col("route_id").alias("route"), "seq", "edge_id", (F.col("edge_id") % 400).alias("node"), "len_m", F.floor(F.col("len_m") * 10 / F.col("mph")).alias("time"), F.when(F.col("level") == 4, F.col("len_m")).otherwise(0).alias("fail"), "ferry")


_RECIPES = "RECIPES AS (SELECT DISTINCT route AS recipe, route AS prefix, 30 AS prefix_cut, route - route % 5 + (route + 1) % 5 AS suffix, 50 AS suffix_cut FROM PATHS)"


def _recipes(p: DataFrame) -> DataFrame:
    r = F.col("route")
    return p.select(r.alias("recipe"), r.alias("prefix"), F.lit(30).cast("long").alias("prefix_cut"), (r - r % 5 + (r + 1) % 5).alias("suffix"), F.lit(50).cast("long").alias("suffix_cut")).distinct()


@query(f"""WITH {PATHS}, {_RECIPES}, X AS (SELECT recipe, seq, edge_id, len_m FROM RECIPES JOIN PATHS ON route = prefix WHERE seq < 30 UNION ALL SELECT recipe, seq - 50 + 30, edge_id, len_m FROM RECIPES JOIN PATHS ON route = suffix WHERE seq >= 50)
SELECT recipe, count(*) AS edges, CAST(sum(len_m) AS BIGINT) AS dist, max(seq) AS last_seq, arg_max(edge_id, seq) AS last_edge FROM X GROUP BY 1""")
def spliced_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths(spark, sf_dir)
    return R.spliced(p, _recipes(p)).groupBy("recipe").agg(F.count("*").alias("edges"), F.sum("len_m").alias("dist"), F.max("seq").alias("last_seq"), F.max_by("edge_id", "seq").alias("last_edge"))


@query(f"""WITH {PATHS} SELECT route, count(*) AS edges, CAST(sum(len_m) AS BIGINT) AS dist, min(seq) - 20 AS first_seq FROM PATHS WHERE seq >= 20 AND seq < 60 GROUP BY 1""")
def route_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths(spark, sf_dir)
    cuts = p.select("route", F.lit(20).alias("from_seq"), F.lit(60).alias("to_seq")).distinct()
    return R.fragments(p, cuts).groupBy("route").agg(F.count("*").alias("edges"), F.sum("len_m").alias("dist"), F.min("seq").cast("long").alias("first_seq"))


@query(f"""WITH {PATHS}, {_RECIPES} SELECT recipe FROM RECIPES r WHERE EXISTS (SELECT 1 FROM PATHS x JOIN PATHS y ON x.node = y.node WHERE x.route = r.prefix AND x.seq < 30 AND y.route = r.suffix AND y.seq > 50)""")
def splice_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths(spark, sf_dir)
    return R.looping(p, _recipes(p))


_CUTS = f"""{PATHS}, U AS (SELECT request, route, node, min(seq) AS seq FROM PATHS GROUP BY ALL), B AS (SELECT x.request, x.route AS a, y.route AS b, x.node, x.seq AS sa, y.seq AS sb FROM U x JOIN U y ON x.request = y.request AND x.node = y.node AND x.route < y.route),
M AS (SELECT *, coalesce(NOT (lag(sa) OVER w = sa - 1 AND lag(sb) OVER w = sb - 1), true) AS starts, coalesce(NOT (lead(sa) OVER w = sa + 1 AND lead(sb) OVER w = sb + 1), true) AS ends FROM B WINDOW w AS (PARTITION BY request, a, b ORDER BY sa)), CUTS AS (SELECT * FROM M WHERE starts OR ends),
BEFORE AS (SELECT route, seq, coalesce(sum(len_m) OVER w, 0) AS len_m, coalesce(sum(time) OVER w, 0) AS time, coalesce(sum(fail) OVER w, 0) AS fail FROM PATHS WINDOW w AS (PARTITION BY route ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), TOT AS (SELECT route, sum(len_m) AS len_m, sum(time) AS time, sum(fail) AS fail FROM PATHS GROUP BY 1),
RX AS (SELECT request, a, b, a AS prefix, sa AS prefix_cut, b AS suffix, sb AS suffix_cut FROM CUTS UNION ALL SELECT request, a, b, b, sb, a, sa FROM CUTS), RR AS (SELECT *, concat_ws(':', prefix, prefix_cut, suffix, suffix_cut) AS recipe FROM RX),
EST AS (SELECT r.*, p.time + t.time - s.time AS time, p.fail + t.fail - s.fail AS fail FROM RR r JOIN BEFORE p ON p.route = r.prefix AND p.seq = r.prefix_cut JOIN BEFORE s ON s.route = r.suffix AND s.seq = r.suffix_cut JOIN TOT t ON t.route = r.suffix WHERE p.len_m >= 1000 AND t.len_m - s.len_m >= 1000),
OK AS (SELECT * FROM EST e WHERE NOT EXISTS (SELECT 1 FROM PATHS x JOIN PATHS y ON x.node = y.node WHERE x.route = e.prefix AND x.seq < e.prefix_cut AND y.route = e.suffix AND y.seq > e.suffix_cut))"""


@query(f"""WITH {_CUTS}, BEST AS (SELECT request, a, b, arg_min(recipe, (time, fail, recipe)) AS x, arg_min(recipe, (fail, time, recipe)) AS y FROM OK GROUP BY 1, 2, 3) SELECT request, a, b, x AS recipe FROM BEST UNION SELECT request, a, b, y FROM BEST""")
def crossbred_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each pair of a request's routes the junctions at which their parts make the best and the safest child."""
    p = paths(spark, sf_dir)
    return R.finalists(R.crossed(p, ["len_m", "time", "fail"]), "time", "fail")


@query(f"""WITH {SCORED}, {CORRIDOR} SELECT c.request, c.a AS child, c.b AS parent, x.time + 5 < y.time OR x.score + 5 < y.score OR ({_KEY.format('x')[1:-1]}, x.time) < ({_KEY.format('y')[1:-1]}, y.time) AS better FROM CORRIDOR c JOIN SCORED x ON x.candidate = c.a JOIN SCORED y ON y.candidate = c.b""".replace("OR (x.fail", "OR row(x.fail").replace("< (y.fail", "< row(y.fail"))
def improved_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _candidates(spark, sf_dir), _corridor(spark, sf_dir)
    x, y = c.alias("x"), c.alias("y")
    j = s.join(x, s["a"] == F.col("x.candidate")).join(y, s["b"] == F.col("y.candidate"))
    return j.select(s["request"], s["a"].alias("child"), s["b"].alias("parent"), R.improves("x", "y").alias("better"))


@query(f"""WITH RECURSIVE {SCORED}, {CORRIDOR}, RANKED AS (SELECT request, candidate, row_number() OVER (PARTITION BY request ORDER BY score, candidate) AS place FROM SCORED), ALIKE AS (SELECT a AS candidate, b AS other FROM CORRIDOR WHERE share >= 0.96 UNION ALL SELECT b, a FROM CORRIDOR WHERE share >= 0.96),
RIV AS (SELECT candidate, list(other) AS rivals FROM ALIKE GROUP BY 1), N AS (SELECT r.*, coalesce(rivals, []) AS rivals FROM RANKED r LEFT JOIN RIV USING (candidate)),
G(request, place, chosen) AS (SELECT request, 1::BIGINT, [candidate] FROM N WHERE place = 1 UNION ALL SELECT g.request, n.place, CASE WHEN len(list_intersect(g.chosen, n.rivals)) = 0 THEN list_append(g.chosen, n.candidate) ELSE g.chosen END FROM G g JOIN N n ON n.request = g.request AND n.place = g.place + 1)
SELECT request, unnest(chosen) AS candidate FROM (SELECT request, arg_max(chosen, place) AS chosen FROM G GROUP BY 1)""")
def distinct_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distinct_routes(_candidates(spark, sf_dir), _corridor(spark, sf_dir).where("share >= 0.96"), ["score", "candidate"])


_FAR = f"""WITH {SCORED}, {CORRIDOR}, NEAR AS (SELECT request, a AS candidate, b AS other, share FROM CORRIDOR UNION ALL SELECT request, b, a, share FROM CORRIDOR), BEST AS (SELECT request, min(score) AS best FROM SCORED GROUP BY 1), C AS (SELECT s.request, candidate, least(1.0, best / score) AS quality FROM SCORED s JOIN BEST USING (request)),
T0 AS (SELECT DISTINCT request, candidate FROM (SELECT request, arg_min(candidate, (score, candidate)) AS candidate FROM SCORED GROUP BY 1 UNION ALL SELECT request, arg_min(candidate, (time, candidate)) FROM SCORED GROUP BY 1)), SIZE AS (SELECT request, count(*) AS n FROM T0 GROUP BY 1), P0 AS (SELECT C.*, 1.0 AS apart FROM C ANTI JOIN T0 ON T0.request = C.request AND T0.candidate = C.candidate)"""
for _k in (1, 2, 3, 4):
    _FAR += f""",
Q{_k} AS (SELECT p.request, p.candidate, p.quality, min(least(p.apart, 1 - coalesce(m.share, 0))) AS apart FROM P{_k - 1} p LEFT JOIN T{_k - 1} t ON t.request = p.request LEFT JOIN NEAR m ON m.request = p.request AND m.candidate = p.candidate AND m.other = t.candidate GROUP BY 1, 2, 3),
T{_k} AS (SELECT request, candidate FROM (SELECT q.*, row_number() OVER (PARTITION BY q.request ORDER BY round(0.8 * apart + 0.2 * quality, 9) DESC, candidate) AS k FROM Q{_k} q JOIN SIZE z ON z.request = q.request AND z.n + {_k} <= 5) WHERE k = 1), P{_k} AS (SELECT q.* FROM Q{_k} q ANTI JOIN T{_k} t ON t.request = q.request AND t.candidate = q.candidate)"""


@query(_FAR + " " + " UNION ALL ".join(f"SELECT request, candidate, CAST({k} AS BIGINT) AS turn FROM T{k}" for k in range(5)))
def farthest_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best scored and fastest, then up to five by difference and quality."""
    c = _candidates(spark, sf_dir)
    best = c.groupBy("request").agg(F.min("score").alias("best"), F.min(F.struct("score", "candidate"))["candidate"].alias("x"), F.min(F.struct("time", "candidate"))["candidate"].alias("y"))
    seeds = best.select("request", F.explode(F.array_distinct(F.array("x", "y"))).alias("candidate"))
    quality = c.join(best.select("request", "best"), "request").withColumn("quality", F.least(F.lit(1.0), F.col("best") / F.col("score")))
    return R.farthest(quality, _corridor(spark, sf_dir), seeds, 5, 0.8).withColumn("turn", F.col("turn").cast("long"))


@query(f"""WITH {PATHS}, I AS (SELECT *, sum(CASE WHEN ferry <> p THEN 1 ELSE 0 END) OVER (PARTITION BY route ORDER BY seq) AS run FROM (SELECT *, coalesce(lag(ferry) OVER (PARTITION BY route ORDER BY seq), ferry) AS p FROM PATHS)), T AS (SELECT route, run, string_agg(CAST(edge_id AS VARCHAR), ',' ORDER BY seq) AS t, min(seq) AS f FROM I WHERE ferry GROUP BY 1, 2)
SELECT route, count(*) AS boats, string_agg(t, '|' ORDER BY f) AS signature FROM T GROUP BY 1""")
def ferry_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ferry_signatures(paths(spark, sf_dir))


_SIG = f"{SCORED}, SG AS (SELECT *, CASE WHEN ferry > 500 THEN ferry % 5 END AS signature FROM SCORED)"
_SAFE = "(fail, freeway, mtb, hazard, dismount, limited, aggression, time, candidate)"


@query(f"""WITH {_SIG}, BS AS (SELECT request, signature, arg_min(candidate, {_SAFE}) AS s, arg_min(candidate, (score, {_SAFE[1:-1]})) AS p FROM SG WHERE signature IS NOT NULL GROUP BY 1, 2), PL AS (SELECT x.* FROM SG x JOIN (SELECT request, s AS candidate FROM BS UNION SELECT request, p FROM BS) USING (request, candidate)),
B AS (SELECT request, arg_min(candidate, {_SAFE}) AS safest, arg_min(candidate, (score, {_SAFE[1:-1]})) AS practical, arg_min(candidate, (score, {_SAFE[1:-1]})) FILTER (fail <= dist * 0.05) AS low_fail FROM PL GROUP BY 1)
SELECT request, candidate, string_agg(kind, ',' ORDER BY kind) AS kinds FROM (SELECT request, unnest([safest, practical, low_fail]) AS candidate, unnest(['safest', 'practical', 'low_fail']) AS kind FROM B) WHERE candidate IS NOT NULL GROUP BY 1, 2""")
def ferry_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    return R.ferry_seeds(c.withColumn("signature", F.when(F.col("ferry") > 500, F.col("ferry") % 5)))


@query(f"""WITH {PATHS}, S AS (SELECT request, route, seq // 25 AS section, sum(len_m) AS len_m, sum(time) AS time, sum(fail) AS fail FROM PATHS GROUP BY 1, 2, 3), PR AS (SELECT DISTINCT request, route AS base, route - route % 5 + (route + 1) % 5 AS donor FROM PATHS)
SELECT p.request, base, donor, CAST(b.section AS BIGINT) AS section, CAST(d.len_m - b.len_m AS BIGINT) AS len_m, CAST(d.time - b.time AS BIGINT) AS time, CAST(d.fail - b.fail AS BIGINT) AS fail FROM PR p JOIN S b ON b.route = base JOIN S d ON d.route = donor AND d.section = b.section""")
def section_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = paths(spark, sf_dir), F.col("route")
    pairs = p.select("request", r.alias("base"), (r - r % 5 + (r + 1) % 5).alias("donor")).distinct()
    return R.section_swaps(pairs, p.groupBy("route", F.floor(F.col("seq") / 25).alias("section")).agg(*[F.sum(m).alias(m) for m in ("len_m", "time", "fail")]))


@query(f"WITH {PATHS}, X AS (SELECT request, node AS src, lead(node) OVER (PARTITION BY request, route ORDER BY seq) AS dst, edge_id FROM PATHS) SELECT DISTINCT request, src, dst, edge_id FROM X WHERE dst IS NOT NULL")
def union_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.union_graph(paths(spark, sf_dir))


@query(f"WITH {SCORED} SELECT request, candidate, row_number() OVER (PARTITION BY request ORDER BY ord, aggression DESC, time, candidate) AS place FROM SCORED")
def portfolio_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.in_order(_candidates(spark, sf_dir)).select("request", "candidate", F.col("place").cast("long").alias("place"))


@query("""WITH L AS (SELECT request, candidate, leg, CAST(floor(dist * (CASE leg WHEN 0 THEN 3 + candidate % 3 ELSE 7 - candidate % 3 END) / 10.0) AS BIGINT) AS dist, CAST(floor(time * (CASE leg WHEN 0 THEN 3 + candidate % 3 ELSE 7 - candidate % 3 END) / 10.0) AS BIGINT) AS time FROM candidates, range(0, 2) AS r(leg)),
N AS (SELECT *, dist <= 1.55 * min(dist) OVER w + 600 AND time <= 1.6 * min(time) OVER w + 300 AS near FROM L WINDOW w AS (PARTITION BY request, leg)) SELECT request, candidate FROM N GROUP BY 1, 2 HAVING bool_and(near)""")
def bounded_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "candidates")
    part = F.when(F.col("leg") == 0, 3 + F.col("candidate") % 3).otherwise(7 - F.col("candidate") % 3)
    legs = c.select("request", "candidate", "dist", "time", F.explode(F.array(F.lit(0), F.lit(1))).alias("leg")).select("request", "candidate", "leg", F.floor(F.col("dist") * part / 10).alias("dist"), F.floor(F.col("time") * part / 10).alias("time"))
    return R.within_every_leg(legs, 1.55, 600, 1.6, 300)


@query("""SELECT c_custkey AS ask, c.candidate, c.candidate IS NOT NULL AS found FROM customer q LEFT JOIN candidates c ON c.request = q.c_custkey % 30 AND c.candidate = q.c_custkey * 7 % 1600""")
def candidate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadlattice.sources.adapters import read

    k = F.col("c_custkey")
    asked = read(spark, sf_dir, "customer").select(k.alias("ask"), (k % 30).cast("long").alias("request_key"), (k * 7 % 1600).alias("profile"))
    return R.looked_up(view(spark, sf_dir, "candidates").select(F.col("request").cast("long").alias("request_key"), F.col("candidate").alias("profile"), "candidate"), asked)


_OD = "CASE WHEN {0} < 160.934 THEN concat(CAST(greatest(10, CAST(floor({0} * 3.28084 / 10 + 0.5) AS BIGINT) * 10) AS VARCHAR), ' ft') ELSE concat(printf('%.1f', floor({0} / 1609.344 * 10 + 0.5) / 10), ' mi') END"


def _part(c: str, what: str) -> str:
    return f"CASE WHEN {c} > 0 THEN concat({_OD.format(c)}, '{what}') END"


@query(f"""WITH X AS (SELECT *, CAST(greatest(1, dist - ferry) AS DOUBLE) AS r FROM candidates), Y AS (SELECT *, CAST(floor(100 * least(r, greatest(0, dist - fail - l3 - ferry)) / r + 0.5) AS BIGINT) AS pp, CAST(floor(100 * least(r, l3) / r + 0.5) AS BIGINT) AS cp, CAST(floor(100 * least(r, facility) / r + 0.5) AS BIGINT) AS bp FROM X), Z AS (SELECT *, CASE WHEN fail > 0 AND pp = 100 THEN '99.9' ELSE CAST(pp AS VARCHAR) END AS ps FROM Y)
SELECT request, candidate, dist, time, fail, facility, trail, designated, residential, ferry, ascent, concat_ws(' · ', {_part('fail', ' fails rules')}, CASE WHEN bp > 0 THEN concat(bp, '% trails/lanes') END, CASE WHEN ps <> '0' THEN concat(ps, '% passes') END, CASE WHEN cp > 0 THEN concat(cp, '% caution') END, {_part('limited', ' limited-access caution')},
  {_part('mtb', ' mountain-bike trail')}, CASE WHEN dismount > 0 THEN 'contains dismount' END, {_part('hazard', ' curve caution')}) AS outcome FROM Z""")
def candidate_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.summaries(view(spark, sf_dir, "candidates"))


@query("""WITH P AS (SELECT c_custkey AS id, (['direct', 'balanced', 'low'])[c_custkey % 3 + 1] AS mode, c_custkey % 2 = 0 AS d, c_custkey % 5 < 2 AS r, c_custkey % 7 = 0 AS a, CASE WHEN c_custkey % 11 = 0 THEN 15 + c_custkey % 15 END AS mph, c_custkey % 13 = 0 AS s FROM customer)
SELECT id, CASE WHEN s THEN 'Strict probe: searched only road that fully matches your rules.' WHEN mph IS NOT NULL THEN concat('Discovery: same search with the no-shoulder speed dropped to ', mph, ' mph, to see whether a quieter corridor exists at all.')
  ELSE concat(CASE mode WHEN 'direct' THEN 'Direct' WHEN 'balanced' THEN 'Balanced' ELSE 'Low stress' END, ' cost model', CASE WHEN d THEN ', preferring signed bike routes and trails' ELSE '' END, CASE WHEN r THEN ', preferring residential streets' ELSE '' END, '.', CASE WHEN a THEN ' Re-run with the roads of an earlier option penalised, to force a different corridor.' ELSE '' END) END AS why FROM P""")
def profile_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadlattice.sources.adapters import read

    k = F.col("c_custkey")
    mode = F.get(F.array(*[F.lit(m) for m in R.MODE_WORDS]), (k % 3).cast("int"))
    p = read(spark, sf_dir, "customer").select(k.alias("id"), mode.alias("mode"), (k % 2 == 0).alias("designated"), (k % 5 < 2).alias("residential"), (k % 7 == 0).alias("alternative"), F.when(k % 11 == 0, 15 + k % 15).alias("discovery_mph"), (k % 13 == 0).alias("strict"))
    return p.select("id", R.profile_text().alias("why"))
