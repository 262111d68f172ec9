"""Candidates from parts of others, and which of many candidates are kept apart: splices, loops, ferries, distinct and far routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlattice.functions import formats

from .costs import score
from .graph import cut_lineage, stored
from .portfolio import SAFETY, cut_points, overlap, reasonable, scored
from .requests import different
from .sequences import islands

#: Metres that both parts of a splice have at least, and seconds or points by which a child beats its parents.
LEAST_PART_M, BETTER_BY = 1000, 5
#: Share of failing metres up to which an itinerary counts as within the rules.
LOW_FAIL = 0.05
MODE_WORDS = {"direct": "Direct", "balanced": "Balanced", "low": "Low stress"}


def fragments(paths: DataFrame, cuts: DataFrame) -> DataFrame:
    """cuts(part, route, from_seq, to_seq) -> the rows of each part, numbered from 0."""
    j = cuts.join(paths, "route").where((F.col("seq") >= F.col("from_seq")) & (F.col("seq") < F.col("to_seq")))
    return j.withColumn("seq", F.col("seq") - F.col("from_seq")).drop("from_seq", "to_seq")


def spliced(paths: DataFrame, recipes: DataFrame) -> DataFrame:
    """recipes(recipe, prefix, prefix_cut, suffix, suffix_cut) -> the child's rows: the prefix before its cut, then the suffix from its
    own, numbered through. If recipes have a request, routes are numbered within requests. No search is needed."""
    p = paths.withColumnRenamed("request", "__of") if "request" in recipes.columns else paths.drop("request")
    of = F.col("request") == F.col("__of") if "request" in recipes.columns else F.lit(True)
    head = recipes.join(p, of & (F.col("prefix") == F.col("route"))).where(F.col("seq") < F.col("prefix_cut")).withColumn("at", F.col("seq"))
    tail = recipes.join(p, of & (F.col("suffix") == F.col("route"))).where(F.col("seq") >= F.col("suffix_cut")).withColumn("at", F.col("seq") - F.col("suffix_cut") + F.col("prefix_cut"))
    drop = ["prefix", "prefix_cut", "suffix", "suffix_cut", "route", "__of"]
    return head.union(tail).withColumn("seq", F.col("at")).drop(*drop, "at")


def looping(paths: DataFrame, recipes: DataFrame) -> DataFrame:
    """(recipe): those whose prefix has a node that the suffix has again behind the cut."""
    head = recipes.join(paths.select("route", "seq", "node"), F.col("prefix") == F.col("route")).where(F.col("seq") < F.col("prefix_cut")).select("recipe", "node")
    tail = recipes.join(paths.select("route", "seq", "node"), F.col("suffix") == F.col("route")).where(F.col("seq") > F.col("suffix_cut")).select("recipe", "node")
    return head.join(tail, ["recipe", "node"], "left_semi").select("recipe").distinct()


def crossed(paths: DataFrame, metrics: list[str], alike: DataFrame | None = None) -> DataFrame:
    """paths(request, route, seq, node, metrics with len_m) -> (request, a, b, prefix, prefix_cut, suffix, suffix_cut, recipe, metrics): the
    children of two routes at the places where they part or meet (see cut_points), both ways round, with each metric of the child. Both
    parts have LEAST_PART_M metres and no node comes twice. Pairs in alike(request, a, b) are left out.

    Running sums travel with the first visit of each node. A child has a node twice if one that is on the prefix before the cut is on
    the suffix behind its own, so a running maximum over the nodes that a pair shares tells; no path is written out for it.
    """
    route = Window.partitionBy("request", "route")
    before = route.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    summed = paths.select("request", "route", "seq", "node", *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"p_{m}") for m in metrics], *[F.sum(m).over(route).alias(f"t_{m}") for m in metrics])
    sums = [f"{k}_{m}" for k in "pt" for m in metrics]
    visits = summed.repartition("request", "node").groupBy("request", "route", "node").agg(F.min(F.struct("seq", *sums)).alias("at"), F.max("seq").alias("last"))
    a, b = (visits.select("request", "node", F.col("route").alias(n), F.col("at.seq").alias(f"s{n}"), F.col("last").alias(f"l{n}"), *[F.col(f"at.{c}").alias(f"{n}_{c}") for c in sums]) for n in ("a", "b"))
    pair = Window.partitionBy("request", "a", "b")
    ahead = lambda n: pair.orderBy(f"s{n}").rangeBetween(Window.unboundedPreceding, -1)
    cuts = cut_points(None, a.join(b, ["request", "node"]).where("a < b").withColumns({"upto_a": F.max("lb").over(ahead("a")), "upto_b": F.max("la").over(ahead("b"))}))
    if alike is not None:
        cuts = cuts.join(alike, ["request", "a", "b"], "left_anti")

    def child(x, y):
        long = (F.col(f"{x}_p_len_m") >= LEAST_PART_M) & (F.col(f"{y}_t_len_m") - F.col(f"{y}_p_len_m") >= LEAST_PART_M)
        made = [(F.col(f"{x}_p_{m}") + F.col(f"{y}_t_{m}") - F.col(f"{y}_p_{m}")).alias(m) for m in metrics]
        return F.when(long & ~F.coalesce(F.col(f"upto_{x}") > F.col(f"s{y}"), F.lit(False)), F.struct(F.col(x).alias("prefix"), F.col(f"s{x}").alias("prefix_cut"), F.col(y).alias("suffix"), F.col(f"s{y}").alias("suffix_cut"), *made))

    r = cuts.select("request", "a", "b", F.explode(F.array(child("a", "b"), child("b", "a"))).alias("r")).where("r is not null").select("request", "a", "b", "r.*")
    return r.select("request", "a", "b", "prefix", "prefix_cut", "suffix", "suffix_cut", F.concat_ws(":", "prefix", "prefix_cut", "suffix", "suffix_cut").alias("recipe"), *metrics)


def finalists(estimates: DataFrame, price: str, fail: str) -> DataFrame:
    """For each pair of parents the recipe of best price and the one that fails least (one row if they are the same)."""
    by = ["request", "a", "b"]
    order = lambda *c: F.min(F.struct(*c, "recipe"))["recipe"]
    best = estimates.groupBy(by).agg(order(price, fail).alias("x"), order(fail, price).alias("y"))
    return best.select(*by, F.explode(F.array_distinct(F.array("x", "y"))).alias("recipe"))


def improves(child: str, parent: str) -> Column:
    """Whether a child gives something back against a parent: time, score, or safety in its order."""
    key = lambda x: F.struct(*[F.col(f"{x}.{n}").cast("double") for n in SAFETY])
    return (F.col(f"{child}.time") + BETTER_BY < F.col(f"{parent}.time")) | (F.col(f"{child}.score") + BETTER_BY < F.col(f"{parent}.score")) | (key(child) < key(parent))


def distinct_routes(c: DataFrame, alike: DataFrame, order: list[str]) -> DataFrame:
    """(request, candidate): in this order each candidate that is not like an earlier one that stays. alike(request, a, b) names pairs.

    Each round decides all candidates whose earlier likes are decided: they stay unless one of those does. So the rounds follow
    the longest chain of likes, not the number of candidates.
    """
    ranked = c.select("request", "candidate", F.row_number().over(Window.partitionBy("request").orderBy(*order)).alias("place"))
    both = alike.select("request", "a", "b").union(alike.select("request", "b", "a"))
    earlier = both.join(ranked.select("request", F.col("candidate").alias("a"), F.col("place").alias("pa")), ["request", "a"]).join(ranked.select("request", F.col("candidate").alias("b"), F.col("place").alias("pb")), ["request", "b"])
    edges = cut_lineage(earlier.where("pb < pa").select("request", F.col("a").alias("candidate"), F.col("b").alias("before")))
    state = cut_lineage(ranked.select("request", "candidate", F.lit(None).cast("boolean").alias("stays")))
    while True:
        seen = edges.join(state.select("request", F.col("candidate").alias("before"), "stays"), ["request", "before"])
        facts = seen.groupBy("request", "candidate").agg(F.bool_or(F.coalesce("stays", F.lit(False))).alias("beaten"), F.bool_or(F.col("stays").isNull()).alias("open"))
        j = state.join(facts, ["request", "candidate"], "left")
        decided = F.when(F.coalesce("beaten", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        state = cut_lineage(j.select("request", "candidate", F.coalesce("stays", decided).alias("stays")))
        if state.where("stays is null").isEmpty():
            return state.where("stays").select("request", "candidate")


def farthest(c: DataFrame, shares: DataFrame, seeds: DataFrame, most: int, weight: float = 1.0) -> DataFrame:
    """seeds(request, candidate), then one after the other the candidate with the greatest ``weight`` x least difference in edges from the
    chosen ones + (1 - weight) x quality, until ``most``: (request, candidate, turn). c has request, candidate, quality."""
    near = shares.select("request", "a", "b", "share").union(shares.select("request", F.col("b"), F.col("a"), "share"))
    near = cut_lineage(near.select("request", F.col("a").alias("candidate"), F.col("b").alias("other"), "share"))
    chosen = cut_lineage(seeds.select("request", "candidate").distinct().withColumn("turn", F.lit(0)))
    pool = c.select("request", "candidate", "quality").join(chosen.select("request", "candidate"), ["request", "candidate"], "left_anti")
    pool = pool.withColumn("apart", F.lit(1.0))
    newest = chosen
    size = chosen.groupBy("request").agg(F.count("*").alias("n"))
    for turn in range(1, most):
        met = pool.join(newest.select("request", F.col("candidate").alias("other")), "request", "left").join(near, ["request", "candidate", "other"], "left")
        pool = cut_lineage(met.groupBy("request", "candidate", "quality").agg(F.min(F.least("apart", 1 - F.coalesce("share", F.lit(0.0)))).alias("apart")))
        worth = F.round(weight * F.col("apart") + (1 - weight) * F.col("quality"), 9)
        open_ = pool.join(size.where(F.col("n") + turn <= most), "request", "left_semi")
        newest = cut_lineage(open_.groupBy("request").agg(F.max(F.struct(worth.alias("w"), (-F.col("candidate")).alias("c"))).alias("b")).select("request", (-F.col("b.c")).alias("candidate"), F.lit(turn).alias("turn")))
        if newest.isEmpty():
            break
        chosen = chosen.union(newest)
        pool = pool.join(newest, ["request", "candidate"], "left_anti")
    return chosen


#: Seeds and children of the general cross-breeding, and what difference counts beside quality in the choice of each.
MOST_SEEDS, MOST_CHILDREN, SEED_APART, CHILD_APART = 10, 6, 0.8, 0.7
#: Columns of paths that add up to a route's metrics.
ADDED = ("time", "fail", "freeway", "mtb", "hazard", "dismount", "limited", "ferry", "facility", "trail", "designated", "residential", "l2", "l3")


def totalled(paths: DataFrame) -> DataFrame:
    """Metrics, score and aggression of each route."""
    sums = [F.sum(c).alias(c) for c in ADDED]
    t = paths.groupBy("request", "route").agg(F.sum("len_m").alias("dist"), F.count("*").alias("edges"), F.count_distinct("node").alias("nodes"), *sums)
    return scored(t.withColumn("candidate", F.col("route")))


def alike_pairs(c: DataFrame, shares: DataFrame) -> DataFrame:
    """Pairs of a request's routes that are not worth showing both."""
    return shares.join(different(c, shares), ["request", "a", "b"], "left_anti").select("request", "a", "b")


def _rated(c: DataFrame) -> DataFrame:
    """quality: the best score of a request over each candidate's, at most 1."""
    return c.withColumn("quality", F.least(F.lit(1.0), F.min("score").over(Window.partitionBy("request")) / F.col("score")))


def _ends(c: DataFrame, *orders: tuple[str, ...]) -> DataFrame:
    """The first candidate of each request in every order."""
    first = c.groupBy("request").agg(*[F.min(F.struct(*o, "candidate"))["candidate"].alias(f"c{i}") for i, o in enumerate(orders)])
    return first.select("request", F.explode(F.array_distinct(F.array(*[f"c{i}" for i in range(len(orders))]))).alias("candidate"))


def crossbred(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """paths(request, route, seq, edge_id, node, len_m and ADDED) -> (children's paths, children's totals), route being the recipe.

    Seeds are a request's reasonable routes on land without a node twice, each unlike the better ones; of more than ten the best, the fastest
    and the safest, then those that differ most from the chosen ones (0.8) and are good (0.2). Two seeds that differ are joined at the places
    where they part or meet, both ways round, if both parts have 1000 m and no node comes twice; of each pair the best-priced and the safest
    recipe are made. A child must be better than both parents in time, price or safety, and unlike every route there is. Of a pair the best
    child stays, and the safest if unlike it; of all the best and the safest, then up to six by difference (0.7) and price (0.3). node is
    where an edge begins. No search is needed; requests are independent of each other and share all rounds.
    """
    p = stored(paths.select("request", "route", "seq", "edge_id", "node", "len_m", *ADDED), "cross-paths")
    totals = stored(totalled(p), "cross-totals")
    shares = stored(overlap(p), "cross-shares")
    alike = stored(alike_pairs(totals, shares), "cross-alike")
    land = reasonable(totals.where("ferry <= 0 and edges > 1 and nodes = edges").withColumn("ord", F.lit(0)))
    apart = land.join(distinct_routes(land, alike, ["score", *SAFETY, "candidate"]), ["request", "candidate"], "left_semi")
    apart = stored(_rated(apart), "cross-apart")
    seeds = farthest(apart, shares, _ends(apart, ("score",), ("time",), SAFETY), MOST_SEEDS, SEED_APART)
    own = stored(p.join(seeds.select("request", F.col("candidate").alias("route")), ["request", "route"], "left_semi"), "cross-seeds")

    est = crossed(own, ["len_m", *ADDED], alike).withColumn("dist", F.col("len_m")).withColumn("score", score())
    clean = stored(est, "cross-recipes")
    best = clean.groupBy("request", "a", "b").agg(F.min(F.struct("score", "fail", "recipe"))["recipe"].alias("x"), F.min(F.struct("fail", "dismount", "score", "recipe"))["recipe"].alias("y"))
    final = best.select("request", F.explode(F.array_distinct(F.array("x", "y"))).alias("recipe")).join(clean.select("request", "recipe", "a", "b", "prefix", "prefix_cut", "suffix", "suffix_cut"), ["request", "recipe"])
    final = stored(final, "cross-finalists")

    made = spliced(own, final.select("request", "recipe", "prefix", "prefix_cut", "suffix", "suffix_cut")).withColumnRenamed("recipe", "route")
    made = stored(made, "cross-children")
    old = p.withColumn("route", F.col("route").cast("string"))
    born = stored(totalled(made), "cross-born").join(final.select("request", F.col("recipe").alias("candidate"), F.col("a").alias("ma"), F.col("b").alias("mb")), ["request", "candidate"])
    better = born.alias("x").join(totals.alias("y"), (F.col("x.request") == F.col("y.request")) & F.col("y.candidate").isin(F.col("x.ma"), F.col("x.mb")))
    ok = better.groupBy(F.col("x.request").alias("request"), F.col("x.candidate").alias("candidate")).agg(F.bool_and(improves("x", "y")).alias("ok")).where("ok").drop("ok")
    good = stored(born.join(ok, ["request", "candidate"], "left_semi"), "cross-good")
    all_totals = good.drop("ma", "mb").unionByName(totals.withColumn("candidate", F.col("candidate").cast("string")).withColumn("route", F.col("route").cast("string")))
    every = overlap(old.unionByName(made.join(good.select("request", "route"), ["request", "route"], "left_semi").select(old.columns)))
    near = stored(alike_pairs(all_totals, every), "cross-near")
    both = near.select("request", F.col("a").alias("candidate"), F.col("b").alias("other")).union(near.select("request", "b", "a"))
    known = both.join(old.select("request", F.col("route").alias("other")).distinct(), ["request", "other"], "left_semi")
    new = stored(good.join(known.select("request", "candidate"), ["request", "candidate"], "left_anti"), "cross-new")

    rank = Window.partitionBy("request", "ma", "mb")
    pick = new.withColumns({"first": F.min(F.struct("score", *SAFETY, "candidate")).over(rank)["candidate"], "safest": F.min(F.struct(*SAFETY, "candidate")).over(rank)["candidate"]})
    like_first = both.withColumnRenamed("other", "first")
    second = pick.where("candidate = safest and candidate <> first").join(like_first, ["request", "candidate", "first"], "left_anti").select(new.columns)
    chosen = stored(pick.where("candidate = first").select(new.columns).union(second), "cross-chosen")
    unlike = chosen.join(distinct_routes(chosen, near.join(chosen.select("request", F.col("candidate").alias("a")), ["request", "a"], "left_semi").join(chosen.select("request", F.col("candidate").alias("b")), ["request", "b"], "left_semi"), ["score", *SAFETY, "candidate"]), ["request", "candidate"], "left_semi")
    numbered = stored(_rated(unlike).withColumn("number", F.row_number().over(Window.partitionBy("request").orderBy("score", *SAFETY, "candidate"))), "cross-unlike")
    # numbers stand for recipes, which are texts
    to = numbered.select("request", F.col("candidate").alias("a"), F.col("number").alias("na"))
    pairs = every.join(to, ["request", "a"]).join(to.toDF("request", "b", "nb"), ["request", "b"]).select("request", F.col("na").alias("a"), F.col("nb").alias("b"), "share")
    by_number = numbered.drop("candidate").withColumnRenamed("number", "candidate")
    last = farthest(by_number, pairs, _ends(by_number, ("score",), SAFETY), MOST_CHILDREN, CHILD_APART).select("request", F.col("candidate").alias("number"))
    result = stored(numbered.join(last, ["request", "number"], "left_semi").drop("ma", "mb", "number", "quality", "nodes"), "cross-result")
    return made.join(result.select("request", "route"), ["request", "route"], "left_semi"), result


def ferry_signatures(paths: DataFrame) -> DataFrame:
    """paths(route, seq, edge_id, ferry) -> (route, boats, signature): the edges of each boat trip, trips apart. Routes without a boat have no row."""
    runs = islands(paths, F.col("ferry"), "run", keys=["route"], order=["seq"]).where("ferry")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x["text"].cast("string"))
    trips = runs.withColumns({"at": F.col("seq"), "text": F.col("edge_id")}).groupBy("route", "run").agg(F.array_join(listed("text"), ",").alias("text"), F.min("seq").alias("at"))
    return trips.groupBy("route").agg(F.count("*").alias("boats"), F.array_join(listed("text"), "|").alias("signature"))


def ferry_seeds(c: DataFrame) -> DataFrame:
    """c(request, candidate, signature, score, dist and the safety keys) -> itineraries to refine: (request, candidate, kinds).

    Of each signature the safest and the best priced one; among those the safest, the best priced, and the best priced one
    that fails on at most LOW_FAIL of its way.
    """
    key = F.struct(*[F.col(n).cast("double").alias(n) for n in SAFETY], "candidate")
    price = F.struct("score", key.alias("k"))
    both = c.where("signature is not null").groupBy("request", "signature").agg(F.min(key)["candidate"].alias("s"), F.min(price)["k"]["candidate"].alias("p"))
    pooled = both.select("request", F.explode(F.array_distinct(F.array("s", "p"))).alias("candidate")).distinct().join(c, ["request", "candidate"])
    low = F.when(F.col("fail") <= F.col("dist") * LOW_FAIL, price)
    best = pooled.groupBy("request").agg(F.min(key)["candidate"].alias("safest"), F.min(price)["k"]["candidate"].alias("practical"), F.min(low)["k"]["candidate"].alias("low_fail"))
    kinds = F.explode(F.array(*[F.struct(F.col(k).alias("candidate"), F.lit(k).alias("kind")) for k in ("safest", "practical", "low_fail")])).alias("k")
    return best.select("request", kinds).where("k.candidate is not null").groupBy("request", "k.candidate").agg(F.array_join(F.array_sort(F.collect_list("k.kind")), ",").alias("kinds"))


def section_swaps(pairs: DataFrame, sections: DataFrame) -> DataFrame:
    """pairs(request, base, donor) of one signature, sections(route, section, ...metrics) between its terminals -> children that take one section
    of the donor: (request, base, donor, section, and each metric's change)."""
    metrics = [x for x in sections.columns if x not in ("route", "section")]
    b = sections.select(F.col("route").alias("base"), "section", *[F.col(m).alias(f"b_{m}") for m in metrics])
    d = sections.select(F.col("route").alias("donor"), "section", *[F.col(m).alias(f"d_{m}") for m in metrics])
    return pairs.join(b, "base").join(d, ["donor", "section"]).select("request", "base", "donor", "section", *[(F.col(f"d_{m}") - F.col(f"b_{m}")).alias(m) for m in metrics])


def union_graph(paths: DataFrame) -> DataFrame:
    """The distinct arcs of each request's candidates: (request, src, dst, edge_id)."""
    w = Window.partitionBy("request", "route").orderBy("seq")
    return paths.select("request", F.col("node").alias("src"), F.lead("node").over(w).alias("dst"), "edge_id").where("dst is not null").distinct()


def in_order(c: DataFrame) -> DataFrame:
    """Candidates by ord, -aggression, time."""
    return c.withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy("ord", F.desc("aggression"), "time", "candidate")))


def within_every_leg(legs: DataFrame, dist_factor: float, dist_m: int, time_factor: float, time_s: int) -> DataFrame:
    """legs(request, candidate, leg, dist, time) -> candidates all of whose legs stay near the leg's shortest and fastest."""
    w = Window.partitionBy("request", "leg")
    near = (F.col("dist") <= dist_factor * F.min("dist").over(w) + dist_m) & (F.col("time") <= time_factor * F.min("time").over(w) + time_s)
    return legs.withColumn("near", near).groupBy("request", "candidate").agg(F.bool_and("near").alias("near")).where("near").select("request", "candidate")


def looked_up(cache: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(ask, request_key, profile) -> what the cache(request_key, profile, candidate) has of the same request; null if that is stale."""
    return asked.join(cache.select("request_key", "profile", "candidate"), ["request_key", "profile"], "left").select("ask", "candidate", F.col("candidate").isNotNull().alias("found"))


def summaries(c: DataFrame) -> DataFrame:
    """What lists show of a candidate, without its geometry."""
    return c.select("request", "candidate", "dist", "time", "fail", "facility", "trail", "designated", "residential", "ferry", "ascent", outcome_text().alias("outcome"))


def _round(c: Column) -> Column:
    return F.floor(c + 0.5).cast("long")


def outcome_distance(m: Column) -> Column:
    feet = F.concat(F.greatest(F.lit(10).cast("long"), _round(m * 3.28084 / 10) * 10).cast("string"), F.lit(" ft"))
    return F.when(m <= 0, "no distance").when(m < 160.934, feet).otherwise(F.concat(F.format_string("%.1f", F.floor(m / formats.MILE_M * 10 + 0.5) / 10), F.lit(" mi")))


def outcome_text() -> Column:
    """One line about a route: what fails, shares of trails and lanes, of what passes and needs caution, and what else it holds."""
    riding = F.greatest(F.lit(1), F.col("dist") - F.col("ferry")).cast("double")
    passing = F.greatest(F.lit(0), F.col("dist") - F.col("fail") - F.col("l3") - F.col("ferry"))
    pct = lambda c: _round(100 * F.least(riding, c.cast("double")) / riding)
    passes = F.when((F.col("fail") > 0) & (pct(passing) == 100), "99.9").otherwise(pct(passing).cast("string"))
    said = lambda test, text: F.when(test, text)
    part = lambda c, what: said(F.col(c) > 0, F.concat(outcome_distance(F.col(c)), F.lit(what)))
    share = lambda n, what: said(n > 0, F.concat(n.cast("string"), F.lit(what)))
    bits = [
        part("fail", " fails rules"), share(pct(F.col("facility")), "% trails/lanes"), said(passes != "0", F.concat(passes, F.lit("% passes"))), share(pct(F.col("l3")), "% caution"), part("limited", " limited-access caution"),
        part("mtb", " mountain-bike trail"), said(F.col("dismount") > 0, F.lit("contains dismount")), part("hazard", " curve caution"),
    ]
    return F.concat_ws(" · ", *bits)


def profile_text() -> Column:
    """Why a search was made: profile(mode, designated, residential, alternative, discovery_mph, strict)."""
    word = F.lit(None).cast("string")
    for mode, name in MODE_WORDS.items():
        word = F.when(F.col("mode") == mode, name).otherwise(word)
    plain = F.concat(F.concat_ws(", ", F.concat(word, F.lit(" cost model")), F.when(F.col("designated"), "preferring signed bike routes and trails"), F.when(F.col("residential"), "preferring residential streets")), F.lit("."))
    plain = F.concat(plain, F.when(F.col("alternative"), " Re-run with the roads of an earlier option penalised, to force a different corridor.").otherwise(""))
    lower = F.concat(F.lit("Discovery: same search with the no-shoulder speed dropped to "), F.col("discovery_mph").cast("string"), F.lit(" mph, to see whether a quieter corridor exists at all."))
    return F.when(F.col("strict"), "Strict probe: searched only road that fully matches your rules.").when(F.col("discovery_mph").isNotNull(), lower).otherwise(plain)
