"""What an arc costs a rider: time, and factors for stress, surface, grade and turns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlattice.functions.nullsafe import ge, gt, le, round_up_half

MODES = ("direct", "balanced", "low")

#: Fixed weights, per mode where there are three (direct, balanced, low stress).
LEVEL_4 = (1.5, 9.0, 30.0)
LEVEL_1 = (1.0, 0.92, 0.9)
FACILITY = {1: 0.82, 2: 0.4, 3: 0.36, 4: 0.29, 5: 0.16}
SPEED_OVER = (0.0, 0.01, 0.02)
SPEED_UNDER = (0.005, 0.015, 0.03)
CURVE = {1: (1.08, 1.35, 1.8), 2: (1.16, 1.8, 3.4), 3: (1.3, 2.6, 6.5)}
BUSY = {1: (1.02, 1.12, 1.22), 2: (1.05, 1.28, 1.48), 3: (1.1, 1.5, 1.85)}
WIDE = (1.03, 1.14, 1.24)
STRESSED = (1.04, 1.18, 1.3)
EXPOSED = (1.06, 1.16, 1.3)
SIDEWALK_FALLBACK = (1.9, 3.8, 8.0)
LIMITED = (1.05, 1.35, 1.75)
CLIMB = (0.25, 0.9, 1.6)
TURN = (6.0, 11.0, 15.0)
FREEWAY, MTB, DISMOUNT, LONG_DISMOUNT, DISMOUNT_ENTRY_S, FERRY_WAIT_S, SIGNED, RESIDENTIAL = 60.0, 6.0, 4.0, 8.0, 360.0, 900.0, 0.94, 0.78
#: A signed route where such are preferred.
STRONGLY_SIGNED = 0.5
GRAVEL, ROUGH = 0.065, 0.2
MPH = 0.44704


def weights_valid(w: dict[str, float]) -> list[str]:
    """Names of weights outside 0.1 to 120 (zero is allowed for the speed slopes)."""
    return sorted(k for k, v in w.items() if not (0.1 <= v <= 120 or k.startswith("speed_") and v >= 0))


def time_s(len_m="len_m", up_m="up_m", down_m="down_m", ferry="ferry", dismount="dismount", mph="mph") -> Column:
    """Seconds to ride an arc: grade-aware speed, walking pace where dismounted, the boat's speed on a ferry."""
    length, up = F.col(len_m).cast("double"), F.col(up_m)
    g = (up - F.col(down_m)) / F.greatest(length, F.lit(1.0))
    v = F.when(g >= 0, F.greatest(5.6 * F.exp(-7 * g), F.lit(1.3))).otherwise(F.least(5.6 * (1 - 2.5 * g), F.lit(12.0)))
    rolling = up - F.greatest(up - F.col(down_m), F.lit(0))
    return F.when(F.col(ferry), length / (F.greatest(F.col(mph), F.lit(3)) * MPH)).when(F.col(dismount), length / 1.15).otherwise(length / v + 3.0 * rolling)


def climb_preference(m: int) -> Column:
    net = F.greatest(F.col("up_m") - F.col("down_m"), F.lit(0))
    grade = net / F.greatest(F.col("len_m"), F.lit(1))
    rolling = F.col("up_m") - net
    return (net * (1 + 8 * F.greatest(F.lit(0.0), grade - 0.04)) + 0.5 * rolling) * CLIMB[m]


def surface_preference(prefer_paved: bool = False) -> Column:
    base = F.when(F.col("surface") == 2, GRAVEL).when(F.col("surface") == 3, ROUGH).otherwise(0.0) * F.col("len_m")
    return base * (10.0 if prefer_paved else 0.2)


def steep_avoidance(m: int, time: Column) -> Column:
    """Penalty of arcs over 9 % and 20 m, growing with the square, at most 2400 s and eight times the riding time."""
    length = F.col("len_m").cast("double")
    g = (F.col("up_m") - F.col("down_m")) * 100.0 / F.greatest(length, F.lit(1.0))
    over = 5 * F.pow(F.least(g, F.lit(12.0)) - 9, F.lit(2.0)) + 400 * F.pow(F.greatest(F.lit(0.0), g - 12), F.lit(2.0))
    raw = F.least(F.lit(1.0), length / 100) * (1.35 if m == 2 else 1.0) * over
    return F.when(F.col("ferry") | F.col("dismount") | (length < 20) | (g <= 9), 0.0).otherwise(F.least(F.lit(2400.0), 8 * time, raw))


def osm_tier(c="road_class") -> Column:
    return F.when(F.col(c).between(8, 11), 3).when(F.col(c).between(6, 7), 2).when(F.col(c).between(4, 5), 1).otherwise(0)


def measured_tier() -> Column:
    """Tier of a traffic count, or of the functional class where none is known."""
    return F.when(F.col("adt").isNotNull(), F.when(F.col("adt") > 15000, 3).when(F.col("adt") > 6000, 2).when(F.col("adt") > 2000, 1).otherwise(0)).when(
        F.col("fc").isNotNull(), F.when(F.col("fc") <= 3, 3).when(F.col("fc") <= 4, 2).when(F.col("fc") <= 5, 1).otherwise(0)
    )


def tier(use_measured: bool = True) -> Column:
    return F.coalesce(measured_tier(), osm_tier()) if use_measured else osm_tier()


def _off_street() -> Column:
    return F.col("infra") | F.col("ferry")


def _by_key(key: Column, table: dict, m: int) -> Column:
    return reduce(lambda rest, k: F.when(key == k, table[k][m]).otherwise(rest), table, F.lit(1.0))


def factors(m: int, rules_limit: int = 35) -> dict[str, Column]:
    """Multipliers of an arc with a verdict level, for mode number m."""
    apart = F.col("infra") | F.col("ferry") | F.col("freeway") | F.col("limited_access")
    bare = F.coalesce(F.col("shoulder_ft"), F.lit(0)) <= 0
    d = F.col("mph") - rules_limit
    wide = (F.col("lanes") >= 4) | (F.col("lanes") >= 3) & F.col("center_turn")
    stress = F.when(F.col("lts") == 4, 1.0).when(F.col("lts") == 3, 0.5).otherwise(0.0)
    paint = F.when(F.col("facility") >= 2, 0.5).otherwise(1.0)
    traffic = F.greatest(F.when(wide, WIDE[m] - 1).otherwise(0.0), stress * (STRESSED[m] - 1)) * paint
    plain = (F.col("road_class") <= 3) & (F.col("facility") == 0) & ~apart
    facility = reduce(lambda rest, k: F.when(F.col("facility") == k, FACILITY[k]).otherwise(rest), FACILITY, F.when(F.col("designated"), SIGNED).otherwise(1.0))
    return {
        "mode": F.when(F.col("level") == 4, LEVEL_4[m]).when(F.col("level") == 1, LEVEL_1[m]).otherwise(1.0),
        "speed": F.when(_off_street(), 1.0).when(d > 0, 1 + SPEED_OVER[m] * d).when(bare, F.greatest(F.lit(0.25), 1 + SPEED_UNDER[m] * d)).otherwise(1.0),
        "curve": _by_key(F.col("hazard"), CURVE, m),
        "major": F.when((F.col("facility") >= 1) | apart, 1.0).otherwise(_by_key(tier(), BUSY, m)),
        "traffic": F.when((F.col("facility") >= 4) | apart, 1.0).otherwise(1 + traffic),
        "exposure": F.when(F.col("urban") & (F.coalesce(F.col("sidewalk"), F.lit("")) != "present") & (F.col("facility") == 0) & ge("mph", 30), EXPOSED[m]).otherwise(1.0),
        "fallback": F.when(F.col("rule") == "sidewalk-fallback", SIDEWALK_FALLBACK[m]).otherwise(1.0),
        "freeway": F.when(F.col("freeway"), FREEWAY).otherwise(1.0),
        "limited": F.when(F.col("limited_access"), LIMITED[m]).otherwise(1.0),
        "mtb": F.when(F.col("mtb"), MTB).otherwise(1.0),
        "dismount": F.when(F.col("dismount"), F.when(F.col("dismount_tagged") & gt("len_m", 100), LONG_DISMOUNT).otherwise(DISMOUNT)).otherwise(1.0),
        "facility": F.when(F.col("ferry") | F.col("freeway") | F.col("dismount") | (F.col("level") == 4), 1.0).otherwise(facility),
        "residential": F.when(plain, RESIDENTIAL).otherwise(1.0) if m == 2 else F.lit(1.0),
    }


def arc_cost(m: int, prefer_paved: bool = False) -> Column:
    """Cost of an arc in seconds, without what depends on the arc before it."""
    time = F.col("time_s")
    product = reduce(lambda a, b: a * b, factors(m).values())
    return (time + climb_preference(m)) * product + steep_avoidance(m, time) + surface_preference(prefer_paved)


def profile_cost(m: int, designated: bool, residential: bool, rules_limit: int = 35) -> Column:
    """Cost of an arc under a profile: a mode, with or without signed routes and residential streets preferred."""
    f = factors(m, rules_limit)
    plain = (F.col("road_class") <= 3) & ~(F.col("infra") | F.col("ferry") | F.col("freeway") | F.col("limited_access"))
    lane = reduce(lambda rest, k: F.when(F.col("facility") == k, FACILITY[k]).otherwise(rest), FACILITY, F.when(F.col("designated"), STRONGLY_SIGNED if designated else SIGNED).otherwise(1.0))
    f["facility"] = F.when(F.col("ferry") | F.col("freeway") | F.col("dismount") | (F.col("level") == 4), 1.0).otherwise(lane)
    f["residential"] = F.when(plain, RESIDENTIAL).otherwise(1.0) if residential else F.lit(1.0)
    return (F.col("time_s") + climb_preference(m)) * reduce(lambda a, b: a * b, f.values()) + steep_avoidance(m, F.col("time_s")) + surface_preference()


def profile_name(mode: str, designated: bool, residential: bool) -> str:
    return mode + ("_signed" if designated else "") + ("_quiet" if residential else "")


def priced_profiles(arcs: DataFrame, rules_limit: int = 35, only: list[tuple[str, bool, bool]] | None = None) -> DataFrame:
    """arcs with level and rule -> time_s and the costs of the twelve profiles, or ``only`` some (cost_ and profile_name), all in one pass."""
    timed = arcs.withColumn("time_s", time_s())
    every = [(n, d, r) for n in MODES for d in (False, True) for r in (False, True)]
    return timed.withColumns({f"cost_{profile_name(n, d, r)}": profile_cost(MODES.index(n), d, r, rules_limit) for n, d, r in only or every})


def priced(arcs: DataFrame) -> DataFrame:
    """arcs with level and rule -> time_s and a cost column for each mode, all in one pass."""
    timed = arcs.withColumn("time_s", time_s())
    return timed.withColumns({f"cost_{name}": arc_cost(m) for m, name in enumerate(MODES)})


def least_factor(m: int) -> float:
    """A lower bound of the product of all factors."""
    low = min(1.0, LEVEL_1[m]) * 0.25 * min(FACILITY.values())
    return low * (RESIDENTIAL if m == 2 else 1.0)


def cost_floor(m: int) -> Column:
    """A lower bound of arc_cost that needs no verdict."""
    return F.col("time_s") * least_factor(m)


def turn_cost(m: int, bearing_in="bearing_in", bearing_out="bearing_out", same_name: Column | None = None) -> Column:
    """Seconds for the change of direction: free below 30 degrees, and below 70 on one named road; doubled from 150."""
    delta = F.abs(F.pmod(F.col(bearing_out) - F.col(bearing_in) + 180, F.lit(360.0)) - 180)
    base = TURN[m]
    same = same_name if same_name is not None else F.lit(False)
    return F.when(delta < 30, 0.0).when(same & (delta < 70), 0.0).when(delta >= 150, 2 * base).when(delta < 55, 0.65 * base).otherwise(base)


def reported_grade() -> Column:
    """Grade of an arc in per cent with half-up rounding; not credible over 40 % or under 20 m."""
    g = (F.col("up_m") - F.col("down_m")) * 100.0 / F.greatest(F.col("len_m"), F.lit(1))
    return F.when((F.col("len_m") < 20) | ~le(F.abs(g), F.lit(40)), 0.0).otherwise(round_up_half(g).cast("double"))


def score(time="time", fail="fail", dismount="dismount", dist="dist", ferry="ferry", facility="facility", trail="trail") -> Column:
    """Recommendation score of a route."""
    off = F.greatest(F.lit(0), F.col(dist) - F.col(ferry) - F.col(facility))
    return F.col(time) + F.col(fail) + F.col(dismount) + 0.2 * off - 0.12 * F.col(trail)
