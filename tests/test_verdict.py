"""The ladder against a plain version of it, and its optimisation."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from roadlattice.operators import verdict as V


def plain(f: dict, r: V.Rules) -> tuple[int, str]:
    busy = {1: (500, 6), 2: (2000, 5), 3: (6000, 4), 4: (15000, 3)}.get(r.busy_no_shoulder)
    painted = f["facility"] >= 2
    stress = (f["stress_rating"] or 0) >= 4 and not painted
    soft = f["limited_access"] or stress
    sh = f["shoulder"]
    if sh is None and r.infer_shoulder_from_edge and (f["edge_space"] or 0) > 0:
        sh = max(0, f["edge_space"] - 1)
    sh = sh or 0
    fast = f["speed"] is not None and f["speed"] > (r.max_speed_no_shoulder or 35)
    wide = 0 < r.lanes_no_shoulder_over < 6 and f["lanes"] > r.lanes_no_shoulder_over
    traffic = busy is not None and (f["adt"] > busy[0] if f["adt"] is not None else f["fc"] is not None and f["fc"] <= busy[1])
    wants = fast or wide or traffic
    narrow = not painted and sh < r.min_shoulder
    if f["prohibited"]:
        return 4, "prohibited"
    if f["ferry"]:
        return 2, "ferry"
    if f["freeway"]:
        return 4, "freeway"
    if f["infra"]:
        return f["infra_score"] or 0, "infra"
    if not r.no_upper_limit and f["speed"] is not None and f["speed"] > r.upper_max_speed:
        return 4, "speed-cap"
    if f["speed"] is not None and 0 < f["speed"] <= 15:
        return (3 if soft else 1), "slow-street"
    if wants and narrow and r.allow_sidewalk_fallback and f["sidewalk"] == "present" and fast:
        return 3, "sidewalk-fallback"
    if wants and narrow:
        return 4, "needs-space"
    if wants:
        return (3 if soft else 2), "default"
    if f["speed"] is not None:
        return (3 if soft else 1), "shares-lane"
    return (3 if soft else 2), "default"


@pytest.fixture(scope="module")
def facts():
    base = dict(prohibited=False, ferry=False, freeway=False, infra=False, infra_score=None, facility=0, limited_access=False, speed=None, shoulder=None, edge_space=None, lanes=0, sidewalk=None, urban=False, stress_rating=None, adt=None, fc=None)
    rows = [base | dict(speed=s, shoulder=w, lanes=n, facility=f, sidewalk=k) for s, w, n, f, k in product([None, 20, 45], [None, 0, 4], [0, 3, 5], [0, 2], [None, "present"])]
    rows += [base | x for x in (dict(prohibited=True), dict(ferry=True), dict(freeway=True), dict(infra=True), dict(infra=True, infra_score=1), dict(adt=3000), dict(fc=4), dict(speed=15), dict(stress_rating=4, speed=20), dict(limited_access=True), dict(edge_space=9.0, speed=50))]
    return rows


SCHEMA = "id int, prohibited boolean, ferry boolean, freeway boolean, infra boolean, infra_score int, facility int, limited_access boolean, speed int, shoulder int, edge_space double, lanes int, sidewalk string, urban boolean, stress_rating int, adt int, fc int"


@pytest.mark.parametrize("rules", [V.Rules(), V.Rules(no_upper_limit=False, upper_max_speed=35), V.Rules(lanes_no_shoulder_over=6, busy_no_shoulder=0), V.Rules(allow_sidewalk_fallback=False, infer_shoulder_from_edge=False, max_speed_no_shoulder=0)])
def test_ladder(spark, facts, rules):
    df = spark.createDataFrame([(i, *(f[c.split()[0]] for c in SCHEMA.split(", ")[1:])) for i, f in enumerate(facts)], SCHEMA)
    got = {r.id: (r.level, r.rule) for r in V.evaluate(df, rules).collect()}
    assert got == {i: plain(f, rules) for i, f in enumerate(facts)}


def test_disabled_rung_is_folded(spark):
    df = V.seal(spark.createDataFrame([(1,)], "speed int")).select(V.verdict(V.Rules())["rule"].alias("rule"))
    assert "speed-cap" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_missing_facts_and_defaults(spark):
    df = spark.createDataFrame([(None, 30)], "lanes int, speed int")
    assert df.select(F.size(V.missing_facts(df)).alias("n")).first().n == len(V.FACTS) - 1
    assert V.seal(df).first().lanes == 0
