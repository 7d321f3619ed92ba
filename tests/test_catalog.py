"""A sample of the catalogue against its SQL twins; tools/check.py covers all of it."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = (
    "A3_annotations", "B1_project_px", "C1_asof_nearest", "C9_eligibility", "D2_flag_in_intervals", "D3_nearest_line",
    "E7_centre_line", "F4_paired_diff", "F7_rejection_rates", "G6_block_length", "H3_best_threshold", "I3_stratified_split",
    "J5_slew_limit", "K4_resolve_status",
)


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_twin(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    at = {d[0]: n for n, d in enumerate(cur.description)}
    assert sorted(at) == cols
    key = lambda r: tuple((v is None, round(v, 6) + 0.0 if isinstance(v, float) else v) for v in r if v is not None)
    want = sorted((tuple(r[at[c]] for c in cols) for r in cur.fetchall()), key=key)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(abs(a - b) <= 1e-6 * max(1, abs(b)) if isinstance(a, float) and b is not None else a == b for a, b in zip(g, w)), (g, w)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
