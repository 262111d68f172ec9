"""The contract: every oracle has a query, and a few agree with DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = entry.SMALL


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


CHECKED = """verdict_levels route_totals category_pct arc_cost_modes span_bearing_match dominance_prune way_split select_six skyline multi_leg diversity_probes crossbred_recipes distinct_routes farthest_seeds
concern_families steep_climbs instruction_triggers off_route_state curve_hazards densify stress_layer edge_grades clipped_lines nearest_restricted route_path top_labels candidate_stages matched_fixes""".split()


def plain(v):
    if v is None or v is pd.NA or v != v:
        return ""
    return str(int(v)) if isinstance(v, float) and v == int(v) else f"{v:.4f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    text = lambda df: sorted(tuple(map(plain, row)) for row in df[cols].astype(object).itertuples(index=False))
    assert sorted(got.columns) == cols and text(got) == text(want)


def test_lines_are_spread_over_tasks(spark):
    from roadlattice.plans import reports

    for q in (reports.simplified_lines, reports.curve_hazards):
        assert q(spark, entry.SMALL).rdd.getNumPartitions() == 4
