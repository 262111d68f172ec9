"""The verdict of a road segment under a rider's rules: one first-match ladder of expressions."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlattice.functions import formats
from roadlattice.functions.nullsafe import col, ge, gt, is_text, is_true, known, le, lt

#: Fixed vocabulary of facts, with the value that a missing one takes.
FACTS = {
    "prohibited": False, "ferry": False, "freeway": False, "infra": False, "infra_score": None, "facility": 0, "limited_access": False, "speed": None,
    "shoulder": None, "edge_space": None, "lanes": 0, "sidewalk": None, "urban": False, "stress_rating": None, "adt": None, "fc": None,
}
TYPES = {"sidewalk": "string"} | {k: "boolean" for k, v in FACTS.items() if v is False} | {"edge_space": "double"}

#: Busy setting: vehicles a day from which a road is busy, and the functional class that stands for an unknown count.
BUSY = {1: (500, 6), 2: (2000, 5), 3: (6000, 4), 4: (15000, 3)}

RUNGS = ("prohibited", "ferry", "freeway", "infra", "speed-cap", "slow-street", "sidewalk-fallback", "needs-space", "shares-lane", "default")


@dataclass(frozen=True)
class Rules:
    min_shoulder: int = 4
    max_speed_no_shoulder: int = 35
    upper_max_speed: int = 45
    no_upper_limit: bool = True
    lanes_no_shoulder_over: int = 3
    busy_no_shoulder: int = 2
    allow_sidewalk_fallback: bool = True
    infer_shoulder_from_edge: bool = True


def rule_columns(rules) -> dict[str, Column]:
    """Rules as columns: literals of a Rules record, or the columns of that name if rules is None."""
    return {k: F.lit(v) for k, v in asdict(rules).items()} if rules is not None else {k: F.col(k) for k in asdict(Rules())}


def facts_from(df: DataFrame) -> DataFrame:
    """Normalised properties -> facts. The coarse flag ``bike`` raises a facility of none to 2."""
    facility = F.coalesce(F.col("facility"), F.lit(0))
    return df.withColumn("facility", F.when(is_true("bike") & (facility == 0), 2).otherwise(facility))


def seal(df: DataFrame) -> DataFrame:
    """All facts as columns: missing columns and null values take their defaults."""
    made = {}
    for name, default in FACTS.items():
        kind = TYPES.get(name, "bigint")
        value = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        made[name] = value if default is None else F.coalesce(value, F.lit(default).cast(kind))
    return df.withColumns(made)


def missing_facts(df: DataFrame) -> Column:
    """Names of the facts that a row does not know."""
    return F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) if n in df.columns else F.lit(n) for n in FACTS]))


def inferred_shoulder(r: dict) -> Column:
    return F.when(is_true(r["infer_shoulder_from_edge"]) & gt("edge_space", 0), F.greatest(F.lit(0.0), F.col("edge_space") - 1).cast("double"))


def effective_shoulder(r: dict) -> Column:
    return F.coalesce(F.col("shoulder").cast("double"), inferred_shoulder(r), F.lit(0.0))


def shoulder_was_inferred(r: dict) -> Column:
    return ~known("shoulder") & inferred_shoulder(r).isNotNull()


def busy(r: dict) -> Column:
    level = r["busy_no_shoulder"]
    test = lambda t, c: gt("adt", t) | (~known("adt") & le("fc", c))
    return reduce(lambda rest, k: F.when(level == k, test(*BUSY[k])).otherwise(rest), BUSY, F.lit(False))


def triggers(r: dict) -> dict[str, Column]:
    """What makes a road want riding space of its own."""
    no_shoulder = F.when(r["max_speed_no_shoulder"] == 0, 35).otherwise(r["max_speed_no_shoulder"])
    limit = r["lanes_no_shoulder_over"]
    return {"speed": gt("speed", no_shoulder), "lanes": (limit > 0) & (limit < 6) & gt("lanes", limit), "traffic": busy(r)}


def space_reasons(r: dict) -> Column:
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in triggers(r).items()]))


def bike_network() -> Column:
    return is_true("infra") | ge("facility", 4) | (ge("facility", 2) & ~ge("stress_rating", 4))


def _ladder(r: dict) -> list[tuple[Column, str, int, int]]:
    """Rungs in order: condition, rule, level, and level of a road that is soft (limited access, or stressful without a lane). A
    comparison with an unknown value is false."""
    t = triggers(r)
    wants = t["speed"] | t["lanes"] | t["traffic"]
    narrow = ~ge("facility", 2) & (effective_shoulder(r) < r["min_shoulder"])
    side = is_true(r["allow_sidewalk_fallback"]) & is_text("sidewalk", "present") & t["speed"] & narrow
    return [
        (is_true("prohibited"), "prohibited", 4, 4),
        (is_true("ferry"), "ferry", 2, 2),
        (is_true("freeway"), "freeway", 4, 4),
        (is_true("infra"), "infra", 0, 0),
        (~is_true(r["no_upper_limit"]) & gt("speed", r["upper_max_speed"]), "speed-cap", 4, 4),
        (gt("speed", 0) & le("speed", 15), "slow-street", 1, 3),
        (wants & narrow & side, "sidewalk-fallback", 3, 3),
        (wants & narrow, "needs-space", 4, 4),
        (wants, "default", 2, 3),
        (known("speed"), "shares-lane", 1, 3),
        (F.lit(True), "default", 2, 3),
    ]


def _rung(ladder: list) -> Column:
    return reduce(lambda rest, x: F.when(x[1][0], F.lit(x[0])).otherwise(rest), reversed(list(enumerate(ladder[:-1]))), F.lit(len(ladder) - 1))


def _read(ladder: list, rung: Column, soft: Column, stress: Column) -> dict[str, Column]:
    """Level, rule and caution of a rung."""
    table = lambda k: F.get(F.array(*[F.lit(x[k]) for x in ladder]), rung)
    names = [x[1] for x in ladder]
    level = F.when(rung == names.index("infra"), F.coalesce(F.col("infra_score").cast("int"), F.lit(0))).when(soft, table(3)).otherwise(table(2))
    caution = F.when(rung == names.index("sidewalk-fallback"), F.lit("sidewalk-fallback")).when((level == 3) & is_true("limited_access"), F.lit("limited-access")).when((level == 3) & stress, F.lit("high-stress"))
    return {"level": level, "rule": table(1), "caution": caution}


def verdict(rules=Rules()) -> Column:
    """struct(level, rule, shoulder, limited, high_stress, caution) of a row of sealed facts, as one expression. With literal rules
    the optimiser folds what a setting turns off."""
    r = rule_columns(rules)
    ladder, stress = _ladder(r), ge("stress_rating", 4) & ~ge("facility", 2)
    limited = is_true("limited_access")
    score = F.coalesce(F.col("infra_score").cast("int"), F.lit(0))
    grade = lambda x: score if x[1] == "infra" else F.lit(x[2]) if x[2] == x[3] else F.when(limited | stress, x[3]).otherwise(x[2])
    pick = lambda value: reduce(lambda rest, x: F.when(x[0], value(x)).otherwise(rest), reversed(ladder[:-1]), value(ladder[-1]))
    level, rule = pick(grade), pick(lambda x: F.lit(x[1]))
    caution = F.when(rule == "sidewalk-fallback", F.lit("sidewalk-fallback")).when((level == 3) & limited, F.lit("limited-access")).when((level == 3) & stress, F.lit("high-stress"))
    return F.struct(level.cast("int").alias("level"), rule.alias("rule"), effective_shoulder(r).alias("shoulder"), limited.alias("limited"), stress.alias("high_stress"), caution.alias("caution"))


def evaluate(facts: DataFrame, rules=Rules()) -> DataFrame:
    """Facts with level, rule, eff_shoulder and caution (null facts take defaults first). The rung is found once, in a column of its own;
    what follows from it is looked up."""
    r = rule_columns(rules)
    ladder, stress = _ladder(r), ge("stress_rating", 4) & ~ge("facility", 2)
    found = seal(facts).withColumns({"__rung": _rung(ladder), "__stress": stress, "eff_shoulder": effective_shoulder(r)})
    v = _read(ladder, F.col("__rung"), is_true("limited_access") | F.col("__stress"), F.col("__stress"))
    return found.withColumns({"level": v["level"].cast("int"), "rule": v["rule"], "caution": v["caution"]}).drop("__rung", "__stress")


def _number(c: Column) -> Column:
    """A number as a reader writes it: without a fraction that is nought."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def fail_texts(evaluated: DataFrame, rules=Rules()) -> DataFrame:
    """Adds ``reason``, why a road fails, and ``details``, what is known of it, to rows of evaluate (with road_class, if there is one).

    Details, each only where known: speed, what wants riding space (speed, lanes, the count or class of traffic), shoulder, facility, and
    limited access or else the class of road. A freeway's limited access goes without saying.
    """
    r = rule_columns(rules)
    t, said = triggers(r), F.col("rule")
    own, inferred = known("shoulder"), shoulder_was_inferred(r)
    feet = _number(F.col("eff_shoulder"))
    below = F.concat(F.lit(" — below your "), r["min_shoulder"].cast("string"), F.lit(" ft minimum"))
    space = F.concat(F.when(inferred, F.concat(feet, F.lit(" ft inferred shoulder"))).when(own, F.concat(feet, F.lit(" ft shoulder"))).otherwise("No shoulder recorded"), below)
    reason = (
        F.when(said == "prohibited", "Bicycles are prohibited").when(said == "freeway", "Limited-access freeway — last resort only")
        .when(said == "speed-cap", F.concat(F.lit("Above your "), r["upper_max_speed"].cast("string"), F.lit(" mph maximum"))).when(said == "needs-space", space).otherwise("Does not meet your selected riding rules")
    )
    wants = lambda n: (said == "needs-space") & t[n]
    limit = F.when(r["max_speed_no_shoulder"] == 0, 35).otherwise(r["max_speed_no_shoulder"])
    road_class = formats.numbered_name(formats.ROAD_CLASS_NAMES, F.col("road_class")) if "road_class" in evaluated.columns else F.lit(None).cast("string")
    details = [
        F.when(gt("speed", 0), F.concat(F.col("speed").cast("string"), F.lit(" mph"))),
        F.when(wants("speed"), F.concat(F.lit("Shoulder or bike lane required above "), limit.cast("string"), F.lit(" mph"))),
        F.when(wants("lanes"), F.concat(F.col("lanes").cast("string"), F.lit(" lanes — bike space required above "), r["lanes_no_shoulder_over"].cast("string"))),
        F.when(wants("traffic") & gt("adt", 0), F.concat(F.format_number("adt", 0), F.lit(" vehicles/day"))),
        F.when(wants("traffic") & ~known("adt"), "Busy-road class requires bike space"),
        F.when(own, F.concat(F.col("shoulder").cast("string"), F.lit(" ft shoulder"))).when(inferred, F.concat(feet, F.lit(" ft inferred shoulder"))),
        formats.numbered_name(formats.FACILITY_NAMES, F.col("facility")),
        F.when(~is_true("freeway") & is_true("limited_access"), "Limited access").otherwise(road_class),
    ]
    return evaluated.withColumns({"reason": reason, "details": F.array_compact(F.array(*details))})


def metres_by_level(df: DataFrame, by: list[str], length: str = "len_m") -> DataFrame:
    """Array of metres for the levels 0 to 4, for each group."""
    sums = [F.sum(F.when(F.col("level") == k, F.col(length)).otherwise(0)).cast("bigint") for k in range(5)]
    return df.groupBy(*by).agg(F.array(*sums).alias("level_m"))


def rule_grid() -> dict[str, list]:
    """Domain of the rule sweep: 144 rule sets."""
    return {"lanes_no_shoulder_over": [2, 4, 6], "allow_sidewalk_fallback": [True, False], "no_upper_limit": [True, False], "max_speed_no_shoulder": [25, 35], "busy_no_shoulder": [0, 2, 4], "infer_shoulder_from_edge": [False, True]}
