"""Queries over the ordered segments of routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlattice.operators import reporting as R
from roadlattice.operators import sequences as S
from roadlattice.sources.adapters import view

from .registry import query


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "route_segments")


_SUMS = """CAST(sum(len_m) AS BIGINT) AS dist, CAST(sum(CASE WHEN level = 4 AND NOT ferry THEN len_m ELSE 0 END) AS BIGINT) AS fail, CAST(sum(CASE WHEN ferry THEN len_m ELSE 0 END) AS BIGINT) AS ferry_m,
  CAST(sum(CASE WHEN designated THEN len_m ELSE 0 END) AS BIGINT) AS designated_m, CAST(sum(CASE WHEN facility >= 2 THEN len_m ELSE 0 END) AS BIGINT) AS facility_m, CAST(sum(CASE WHEN infra OR facility = 5 THEN len_m ELSE 0 END) AS BIGINT) AS trail_m,
  CAST(sum(CASE WHEN mtb THEN len_m ELSE 0 END) AS BIGINT) AS mtb_m, CAST(sum(CASE WHEN dismount THEN len_m ELSE 0 END) AS BIGINT) AS dismount_m, CAST(sum(CASE WHEN residential THEN len_m ELSE 0 END) AS BIGINT) AS residential_m,
  CAST(sum(CASE WHEN freeway THEN len_m ELSE 0 END) AS BIGINT) AS freeway_m, CAST(sum(CASE WHEN limited_access THEN len_m ELSE 0 END) AS BIGINT) AS limited_m, CAST(sum(CASE WHEN hazard >= 2 THEN len_m ELSE 0 END) AS BIGINT) AS hazard_m,
  CAST(sum(CASE WHEN surface >= 2 THEN len_m ELSE 0 END) AS BIGINT) AS unpaved_m, CAST(sum(CASE WHEN mph >= 30 AND sh < 4 AND facility < 2 AND NOT ferry THEN len_m ELSE 0 END) AS BIGINT) AS fast_bare_m,
  CAST(sum(CASE WHEN mph >= 35 THEN len_m ELSE 0 END) AS BIGINT) AS over_35_m, CAST(sum(CASE WHEN mph >= 45 THEN len_m ELSE 0 END) AS BIGINT) AS over_45_m, CAST(sum(CASE WHEN mph >= 55 THEN len_m ELSE 0 END) AS BIGINT) AS over_55_m"""


@query(f"""SELECT route_id, {_SUMS}, concat_ws(',', 0, sum(CASE WHEN level = 1 THEN len_m ELSE 0 END), sum(CASE WHEN level = 2 THEN len_m ELSE 0 END), sum(CASE WHEN level = 3 THEN len_m ELSE 0 END), sum(CASE WHEN level = 4 THEN len_m ELSE 0 END)) AS level_m,
  max(mph) AS max_mph, round(sum(mph * len_m) / CAST(sum(len_m) AS DOUBLE), 6) AS mean_mph FROM route_segments GROUP BY 1""")
def route_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = R.totals(_segments(spark, sf_dir), ["route_id"])
    return t.withColumn("level_m", F.array_join(F.transform("level_m", lambda x: x.cast("string")), ",")).withColumn("mean_mph", F.round(F.col("mph_m") / F.col("dist"), 6)).drop("mph_m")


@query(f"SELECT CAST(floor(route_id / 10) AS BIGINT) AS trip, {_SUMS}, CAST(sum(CASE WHEN level = 2 THEN len_m ELSE 0 END) AS BIGINT) AS level_2, max(mph) AS max_mph FROM route_segments GROUP BY 1")
def merged_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = R.totals(_segments(spark, sf_dir).withColumn("trip", F.floor(F.col("route_id") / 10)), ["trip", "route_id"]).drop("mph_m")
    return R.merged(legs, ["trip"]).withColumn("level_2", F.get("level_m", F.lit(2))).drop("level_m")


_RUNS = """WITH b AS (SELECT *, level = 4 AND NOT freeway AS fails FROM route_segments),
i AS (SELECT *, sum(CASE WHEN fails <> p THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY seq) AS island FROM (SELECT *, coalesce(lag(fails) OVER (PARTITION BY route_id ORDER BY seq), fails) AS p FROM b)),
r AS (SELECT route_id, island, fails, sum(len_m) AS m, min(seq) AS f, max(seq) AS l FROM i GROUP BY ALL), e AS (SELECT route_id, min(seq) AS f0, max(seq) AS l0 FROM b GROUP BY 1)"""


@query(f"""{_RUNS} SELECT route_id, CAST(sum(CASE WHEN fails AND m <= 40 AND f > f0 AND l < l0 THEN 1 ELSE 0 END) AS BIGINT) AS crossings, CAST(sum(CASE WHEN fails AND m <= 40 AND f > f0 AND l < l0 THEN m ELSE 0 END) AS BIGINT) AS crossing_m,
  CAST(sum(CASE WHEN fails AND NOT (m <= 40 AND f > f0 AND l < l0) THEN m ELSE 0 END) AS BIGINT) AS failing_m FROM r JOIN e USING (route_id) GROUP BY 1""")
def crossing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.short_crossings(_segments(spark, sf_dir))
    runs = c.groupBy("route_id", "island", "fails", "crossing").agg(F.sum("len_m").alias("m"))
    return runs.groupBy("route_id").agg(F.sum(F.col("crossing").cast("bigint")).alias("crossings"), F.sum(F.when(F.col("crossing"), F.col("m")).otherwise(0)).alias("crossing_m"), F.sum(F.when(F.col("fails") & ~F.col("crossing"), F.col("m")).otherwise(0)).alias("failing_m"))


@query("""WITH b AS (SELECT *, dismount AND dismount_tagged AS tagged FROM route_segments),
i AS (SELECT *, sum(CASE WHEN tagged <> p THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY seq) AS island FROM (SELECT *, coalesce(lag(tagged) OVER (PARTITION BY route_id ORDER BY seq), tagged) AS p FROM b)),
m AS (SELECT *, sum(len_m) OVER (PARTITION BY route_id, island) AS run_m FROM i)
SELECT route_id, seq, CAST(CASE WHEN tagged AND run_m > 100 THEN 4 WHEN dismount THEN greatest(level, 3) ELSE level END AS BIGINT) AS level, CAST(run_m AS BIGINT) AS run_m FROM m WHERE dismount""")
def dismount_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tagged_dismounts(_segments(spark, sf_dir)).where("dismount").select("route_id", "seq", F.col("level").cast("bigint").alias("level"), "run_m")


@query("""WITH k AS (SELECT *, concat_ws('|', level, facility, name) AS key FROM route_segments),
i AS (SELECT *, sum(CASE WHEN key <> p THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY seq) AS island FROM (SELECT *, coalesce(lag(key) OVER (PARTITION BY route_id ORDER BY seq), key) AS p FROM k))
SELECT route_id, CAST(island AS BIGINT) AS island, key AS section_key, min(seq) AS first_seq, count(*) AS segments, CAST(sum(len_m) AS BIGINT) AS metres FROM i GROUP BY ALL""")
def route_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("|", F.col("level").cast("string"), F.col("facility").cast("string"), "name")
    return S.sections(_segments(spark, sf_dir), key)


@query("""WITH i AS (SELECT *, sum(CASE WHEN name <> p THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY seq) AS island FROM (SELECT *, coalesce(lag(name) OVER (PARTITION BY route_id ORDER BY seq), name) AS p FROM route_segments)),
r AS (SELECT route_id, island, name, min(seq) AS f, sum(len_m) AS m FROM i GROUP BY ALL),
d AS (SELECT *, CASE WHEN name = '' AND m <= 100 AND lag(name) OVER w = lead(name) OVER w THEN lag(name) OVER w ELSE name END AS n2 FROM r WINDOW w AS (PARTITION BY route_id ORDER BY island)),
j AS (SELECT *, sum(CASE WHEN n2 <> p THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY island) AS step FROM (SELECT *, coalesce(lag(n2) OVER (PARTITION BY route_id ORDER BY island), n2) AS p FROM d))
SELECT route_id, CAST(step AS BIGINT) AS step, n2 AS name, min(f) AS first_seq, CAST(sum(m) AS BIGINT) AS metres FROM j GROUP BY ALL""")
def route_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.steps(_segments(spark, sf_dir))


@query("""WITH c AS (SELECT route_id, CASE WHEN level = 4 THEN 'fail' WHEN level = 3 THEN 'caution' WHEN infra OR facility = 5 THEN 'trail' WHEN facility >= 2 THEN 'bike' ELSE 'pass' END AS category, sum(len_m) AS metres FROM route_segments WHERE NOT ferry GROUP BY ALL),
p AS (SELECT *, metres * 100.0 / sum(metres) OVER (PARTITION BY route_id) AS raw FROM c), q AS (SELECT *, greatest(1, floor(raw)) AS pct FROM p),
s AS (SELECT *, 100 - sum(pct) OVER (PARTITION BY route_id) AS short FROM q),
t AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY CAST(raw AS DOUBLE) - pct DESC, category) AS up, CASE WHEN pct > 1 THEN pct - 1 ELSE 0 END AS takes FROM s),
u AS (SELECT *, sum(takes) OVER (PARTITION BY route_id ORDER BY pct - CAST(raw AS DOUBLE) DESC, category ROWS UNBOUNDED PRECEDING) AS room FROM t)
SELECT route_id, category, CAST(metres AS BIGINT) AS metres, CAST(CASE WHEN short > 0 THEN pct + CASE WHEN up <= short THEN 1 ELSE 0 END ELSE pct - greatest(0, least(takes, -short - (room - takes))) END AS BIGINT) AS pct FROM u""")
def category_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_category = _segments(spark, sf_dir).withColumn("category", R.category()).where("category is not null").groupBy("route_id", "category").agg(F.sum("len_m").alias("metres"))
    return R.percentages(by_category, ["route_id"], "category", "metres")


@query("""WITH b AS (SELECT *, CAST(CASE WHEN abs(grade_pct) <= 40 AND len_m >= 20 THEN grade_pct ELSE 0 END AS DOUBLE) AS g FROM route_segments),
l AS (SELECT *, sum(CASE WHEN ferry <> p THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY seq) AS leg FROM (SELECT *, coalesce(lag(ferry) OVER (PARTITION BY route_id ORDER BY seq), ferry) AS p FROM b)),
c AS (SELECT *, sum(len_m) OVER w AS e, sum(g * len_m) OVER w AS re FROM l WHERE NOT ferry WINDOW w AS (PARTITION BY route_id, leg ORDER BY seq)),
v AS (SELECT a.route_id, max((a.re - (s.re - s.g * s.len_m + s.g * (greatest(a.e - 100, 0) - (s.e - s.len_m)))) / (a.e - greatest(a.e - 100, 0))) AS mx FROM c a JOIN c s ON a.route_id = s.route_id AND a.leg = s.leg
  AND greatest(a.e - 100, 0) >= s.e - s.len_m AND greatest(a.e - 100, 0) < s.e WHERE a.e >= 100 GROUP BY 1),
u AS (SELECT route_id, sum(g * len_m) / sum(len_m) AS up FROM c WHERE g > 0.5 GROUP BY 1)
SELECT r.route_id, floor(greatest(coalesce(mx, 0.0), 0.0) * 10 + 0.5) / 10 AS max_grade, floor(coalesce(up, 0.0) * 10 + 0.5) / 10 AS avg_up FROM (SELECT DISTINCT route_id FROM route_segments) r LEFT JOIN v USING (route_id) LEFT JOIN u USING (route_id)""")
def sustained_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sustained_grade(_segments(spark, sf_dir))


@query("""WITH m AS (SELECT route_id, seq, len_m, edge_id, CASE WHEN level = 4 AND freeway THEN 'freeway' WHEN level = 4 THEN 'failing' WHEN dismount THEN 'dismount' WHEN grade_pct > 10 THEN 'steep' WHEN limited_access THEN 'limited' WHEN lts >= 4 THEN 'high-stress' WHEN mtb THEN 'mtb'
   WHEN hazard >= 3 THEN 'curve' WHEN surface >= 2 THEN 'unpaved' END AS kind, CASE WHEN name = '' THEN 'Unnamed road' ELSE name END AS road, level * 1000 + mph * 10 + lanes AS risk FROM route_segments WHERE NOT ferry),
k AS (SELECT *, concat_ws('|', coalesce(kind, '-'), road) AS key FROM m),
i AS (SELECT *, sum(CASE WHEN key <> p THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY seq) AS island FROM (SELECT *, coalesce(lag(key) OVER (PARTITION BY route_id ORDER BY seq), key) AS p FROM k)),
n AS (SELECT *, row_number() OVER (PARTITION BY route_id, kind, road ORDER BY risk DESC, len_m DESC, edge_id) AS k1 FROM i WHERE kind IS NOT NULL)
SELECT route_id, kind, road, CAST(sum(len_m) AS BIGINT) AS metres, count(DISTINCT island) AS times, max(risk) AS risk, max(CASE WHEN k1 = 1 THEN edge_id END) AS worst_edge FROM n GROUP BY 1, 2, 3""")
def concerns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.concerns(_segments(spark, sf_dir))


@query("""SELECT route_id, seq, CAST(sum(len_m) OVER w - len_m AS BIGINT) AS start_m, CAST(sum(len_m) OVER w AS BIGINT) AS end_m, CAST(CASE WHEN infra THEN 15 ELSE mph END AS BIGINT) AS mph FROM route_segments WINDOW w AS (PARTITION BY route_id ORDER BY seq)""")
def speed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.running(_segments(spark, sf_dir)).select("route_id", "seq", "start_m", "end_m", F.when(F.col("infra"), 15).otherwise(F.col("mph")).alias("mph"))


@query("""WITH n AS (SELECT route_id, seq, level, row_number() OVER (PARTITION BY route_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY route_id) AS n FROM route_segments)
SELECT route_id, seq, i FROM n WHERE i % greatest(1, CAST(ceil(n / 24.0) AS BIGINT)) = 0 OR i = n - 1""")
def profile_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.downsample(_segments(spark, sf_dir), 24).select("route_id", "seq", F.col("i").cast("bigint").alias("i"))


@query("""WITH n AS (SELECT route_id, level, row_number() OVER (PARTITION BY route_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY route_id) AS n FROM route_segments)
SELECT route_id, CAST(floor(i * 48 / n) AS BIGINT) AS bucket, max(level) AS worst FROM n GROUP BY 1, 2""")
def shape_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.worst_by_bucket(_segments(spark, sf_dir), 48)


@query("""WITH c AS (SELECT route_id, seq, sum(len_m) OVER w - len_m AS s, sum(len_m) OVER w AS e, sum(len_m) OVER (PARTITION BY route_id) AS t FROM route_segments WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
p AS (SELECT DISTINCT route_id, unnest([0, 777, 2500, 100000]) AS at_m FROM c)
SELECT p.route_id, CAST(p.at_m AS BIGINT) AS at_m, c.seq, CAST(p.at_m - c.s AS BIGINT) AS into_m FROM p JOIN c ON c.route_id = p.route_id AND p.at_m >= c.s AND (p.at_m < c.e OR c.e = c.t)""")
def segment_at_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = _segments(spark, sf_dir)
    points = seg.select("route_id").distinct().select("route_id", F.explode(F.array(*[F.lit(x).cast("bigint") for x in (0, 777, 2500, 100000)])).alias("at_m"))
    return S.at_distance(seg, points)


_WINDOWS = """b AS (SELECT *, CAST(CASE WHEN abs(grade_pct) <= 40 AND len_m >= 20 THEN grade_pct ELSE 0 END AS DOUBLE) AS g FROM route_segments),
l AS (SELECT *, sum(CASE WHEN ferry <> p THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY seq) AS leg FROM (SELECT *, coalesce(lag(ferry) OVER (PARTITION BY route_id ORDER BY seq), ferry) AS p FROM b)),
c AS (SELECT *, sum(len_m) OVER w AS e, sum(g * len_m) OVER w AS re FROM l WHERE NOT ferry WINDOW w AS (PARTITION BY route_id, leg ORDER BY seq)),
v AS (SELECT a.route_id, a.seq, a.len_m, CASE WHEN a.name = '' THEN 'Unnamed road' ELSE a.name END AS road, s.seq AS from_seq, floor((a.re - (s.re - s.g * s.len_m + s.g * ((a.e - 100) - (s.e - s.len_m)))) / 100 * 10 + 0.5) / 10 AS pct FROM c a JOIN c s ON a.route_id = s.route_id AND a.leg = s.leg AND a.e - 100 >= s.e - s.len_m AND a.e - 100 < s.e WHERE a.e >= 100)"""


@query(f"""WITH {_WINDOWS}, h AS (SELECT * FROM v WHERE pct > 10), j AS (SELECT *, coalesce(lag(road) OVER w = road AND from_seq <= lag(seq) OVER w + 1, false) AS joins FROM h WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
r AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY route_id ORDER BY seq) AS run FROM j)
SELECT route_id, road, min(from_seq) AS first_seq, max(seq) AS last_seq, CAST(sum(CASE WHEN joins THEN len_m ELSE 100 END) AS BIGINT) AS metres, max(pct) AS max_pct FROM r GROUP BY route_id, run, road""")
def steep_climbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.steep_climbs(_segments(spark, sf_dir))


_HW = r"regexp_matches(lower(name), '\b(highway|state route|sr\s*[0-9]|us\s*(?:route\s*)?[0-9]|i-?\s*[0-9])\b')"
_NAMED = "n AS (SELECT * REPLACE (CASE edge_id % 9 WHEN 0 THEN 'SR 9' WHEN 1 THEN 'Old Highway' WHEN 2 THEN 'I-5' WHEN 3 THEN 'US Route 2' WHEN 4 THEN 'Highwayman Lane' ELSE name END AS name), edge_id % 17 = 0 AND mph > 35 AS sidewalk_fallback FROM route_segments)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("edge_id") % 9
    names = F.when(k == 0, "SR 9").when(k == 1, "Old Highway").when(k == 2, "I-5").when(k == 3, "US Route 2").when(k == 4, "Highwayman Lane").otherwise(F.col("name"))
    return _segments(spark, sf_dir).withColumn("name", names).withColumn("sidewalk_fallback", (F.col("edge_id") % 17 == 0) & (F.col("mph") > 35))


_FAMILIES = f"""{_NAMED}, k AS (SELECT *, CASE WHEN level = 3 AND NOT ferry THEN CASE WHEN sidewalk_fallback THEN 'sidewalk' WHEN NOT freeway AND limited_access THEN 'limited' WHEN coalesce(lts >= 4, false) THEN 'stress' WHEN dismount THEN 'dismount' WHEN mtb THEN 'mtb' ELSE 'other' END ELSE '' END AS cause FROM n),
fam AS (SELECT * FROM (SELECT route_id, seq, len_m, CASE WHEN name = '' THEN 'Unnamed road' ELSE name END AS road, unnest(['freeway', 'limited', 'highway', 'failing', 'dismount', 'sidewalk', 'mtb', 'high-stress', 'other', 'unpaved', 'curve']) AS family,
  unnest([freeway, NOT freeway AND (limited_access OR cause = 'limited'), NOT (freeway OR limited_access OR infra OR ferry) AND (mph >= 45 OR {_HW}), level = 4, dismount OR cause = 'dismount', sidewalk_fallback OR cause = 'sidewalk', mtb OR cause = 'mtb', cause = 'stress', cause = 'other', surface >= 2, hazard > 0]) AS inside,
  unnest([1000 + mph, mph, mph, CASE WHEN freeway THEN 10000 ELSE 0 END + mph * 100 + greatest(0, 4 - sh), len_m, mph, 1, coalesce(lts, 4), mph, surface, greatest(0, grade_pct) * 100 + mph]) AS risk FROM k) WHERE inside)"""


@query(f"""WITH {_FAMILIES}, g AS (SELECT *, coalesce(lag(seq) OVER w = seq - 1 AND lag(road) OVER w = road, false) AS joins FROM fam WINDOW w AS (PARTITION BY route_id, family ORDER BY seq)), a AS (SELECT route_id, family, road, CAST(sum(len_m) AS BIGINT) AS metres, CAST(sum(CASE WHEN joins THEN 0 ELSE 1 END) AS BIGINT) AS times, max(risk) AS risk FROM g GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (PARTITION BY route_id, family ORDER BY risk DESC, metres DESC, road) AS place FROM a""")
def concern_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.concern_families(_named(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


_STYLE = "CASE WHEN ferry THEN 'ferry' WHEN level = 4 THEN 'fail' WHEN level = 3 THEN 'caution' WHEN infra OR facility = 5 THEN 'trail' WHEN facility >= 2 THEN 'bike' ELSE 'pass' END"


@query(f"""WITH s AS (SELECT route_id, seq, {_STYLE} AS style, surface >= 2 AS rough, dismount FROM route_segments), p AS (SELECT *, lag(style) OVER w AS ps, lag(rough) OVER w AS pr, coalesce(lag(dismount) OVER w, false) AS pd FROM s WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
i AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps = style THEN 0 ELSE 1 END) OVER w AS si, sum(CASE WHEN pr IS NULL OR pr = rough THEN 0 ELSE 1 END) OVER w AS ri FROM p WINDOW w AS (PARTITION BY route_id ORDER BY seq))
SELECT route_id, 'style' AS kind, style, min(seq) AS first_seq, max(seq) AS last_seq FROM i GROUP BY route_id, si, style UNION ALL SELECT route_id, 'unpaved', '', min(seq), max(seq) FROM i WHERE rough GROUP BY route_id, ri UNION ALL SELECT route_id, 'dismount', '', seq, seq FROM p WHERE dismount AND NOT pd""")
def preview_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.preview_runs(_segments(spark, sf_dir))


@query(f"""WITH {_NAMED} SELECT route_id, seq, concat_ws(' · ', CASE WHEN mtb THEN 'mountain-bike trail' END, CASE WHEN hazard > 0 THEN 'possible limited-visibility uphill curve' END, CASE WHEN mph > 0 THEN concat(mph, ' mph') END,
  CASE WHEN freeway THEN 'freeway' WHEN limited_access THEN 'limited access' WHEN facility = 5 THEN 'shared-use path' WHEN facility = 4 THEN 'separated lane' WHEN facility = 3 THEN 'buffered lane' WHEN facility = 2 THEN 'bike lane' WHEN infra THEN 'bike infrastructure' WHEN designated THEN 'bike route' END,
  CASE WHEN {_HW} OR mph >= 45 THEN 'highway' END, CASE surface WHEN 2 THEN 'Gravel' WHEN 3 THEN 'Rough' END) AS meta FROM n""")
def step_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("route_id", "seq", R.step_text().alias("meta"))


@query("""WITH d AS (SELECT DISTINCT route_id, unnest([0, 17, 250]) AS index FROM route_segments) SELECT d.route_id, CAST(d.index AS BIGINT) AS index, s.name, s.len_m FROM d LEFT JOIN route_segments s ON s.route_id = d.route_id AND s.seq = d.index""")
def directions_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = _segments(spark, sf_dir)
    d = seg.select("route_id").distinct().select("route_id", F.explode(F.array(*[F.lit(i).cast("long") for i in (0, 17, 250)])).alias("index"))
    return R.directions_joined(d, seg)
