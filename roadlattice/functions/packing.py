"""Packed road measures: bytes to columns and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nullsafe import round_half_even

#: Fixed codes: unknown byte, greatest edge space and county shoulder, clamp bit, first year, greatest count.
UNKNOWN, EDGE_CAP, SHOULDER_CAP, CLAMP, YEAR_0, ADT_CAP = 255, 126, 254, 128, 1940, 65535


def pack_edge(feet: Column, clamped: Column) -> Column:
    v = F.least(F.lit(EDGE_CAP), F.greatest(F.lit(0), round_half_even(feet).cast("int")))
    return F.when(feet.isNull(), UNKNOWN).otherwise(v.bitwiseOR(F.when(clamped, CLAMP).otherwise(0)))


def unpack_edge(b: Column) -> Column:
    known = b != UNKNOWN
    return F.struct(F.when(known, b.bitwiseAND(F.lit(127))).alias("edge_space"), F.when(known, b.bitwiseAND(F.lit(CLAMP)) != 0).otherwise(False).alias("edge_clamp"))


def pack_shoulder(feet: Column) -> Column:
    return F.when(feet.isNull(), UNKNOWN).otherwise(F.least(F.lit(SHOULDER_CAP), F.greatest(F.lit(0), round_half_even(feet).cast("int"))))


def unpack_shoulder(b: Column) -> Column:
    return F.when(b != UNKNOWN, b)


def pack_adt(n: Column) -> Column:
    return F.least(F.lit(ADT_CAP), F.coalesce(n, F.lit(0)))


def unpack_adt(n: Column) -> Column:
    return F.when(n != 0, n)


def pack_year(y: Column) -> Column:
    return F.when((y > YEAR_0) & (y - YEAR_0 <= 127), y - YEAR_0).otherwise(0)


def unpack_year(b: Column) -> Column:
    return F.when(b != 0, b + YEAR_0)


def pack_class(fc: Column, owner: Column) -> Column:
    return F.when(fc.between(1, 7), fc).otherwise(0).bitwiseOR(F.shiftleft(F.when(owner.between(1, 4), owner).otherwise(0), 4))


def unpack_class(b: Column) -> Column:
    low, high = b.bitwiseAND(F.lit(15)), F.shiftright(b, 4)
    return F.struct(F.when(low.between(1, 7), low).alias("fc"), F.when(high.between(1, 4), high).alias("owner"))


def flag(bits: Column, mask: int) -> Column:
    return bits.bitwiseAND(F.lit(mask)) != 0


#: Fixed bits of the flags and official bytes.
FLAGS = {"estimated_speed": 1, "bike_facility": 2, "freeway": 4, "infra": 8, "one_way": 16, "ferry": 32, "designated": 64}
OFFICIAL = {"legal_speed": 1, "official_facility": 2, "mtb": 4, "dismount": 8, "sidewalk_present": 16, "sidewalk_absent": 32, "urban": 64, "dismount_tagged": 128}


def flags(bits: Column, names: dict[str, int]) -> dict[str, Column]:
    return {n: flag(bits, m) for n, m in names.items()}


def edge_space_ft(road_width: Column, lane_count: Column) -> Column:
    """struct(space, raw, clamped): half of what a carriageway has beyond its lanes. A lane wider than 13 ft counts as 12."""
    lane = road_width / F.nullif(lane_count, F.lit(0))
    clamped = lane > 13
    used = F.when(clamped, F.least(lane, F.lit(12.0))).otherwise(lane) * lane_count
    return F.struct(F.greatest(F.lit(0.0), (road_width - used) / 2).alias("space"), (road_width - lane * lane_count).alias("raw"), clamped.alias("clamped"))
