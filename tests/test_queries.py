"""Every query of the series gives the rows of its SQL."""

import datetime
import math

import duckdb
import pytest

from sunloom.plans import QUERIES, SQL, flagship

SF = "/root/testdata/sf0.01"


def plain(v):
    """Exact, but for the last few bits of floating-point numbers."""
    if isinstance(v, float):
        return float(f"{v:.10g}") if math.isfinite(v) else str(v)
    return v if not isinstance(v, datetime.datetime) else v.replace(tzinfo=None)


def same(ours, theirs) -> None:
    rows, names = ours.collect(), sorted(ours.columns)
    cols = [d[0] for d in theirs.description]
    assert names == sorted(cols)
    want = [dict(zip(cols, r, strict=True)) for r in theirs.fetchall()]
    key = lambda r: str([plain(r[c]) for c in names])
    assert sorted(key(r.asDict()) for r in rows) == sorted(map(key, want))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck.execute(SQL[name]))


def test_comparisons_are_not_empty(spark):
    n = QUERIES["mask_logic_counts"](spark, SF).first()
    assert 0 < n["n_old"] < n["n_new"] and QUERIES["windows_all_daylight"](spark, SF).count() == n["n_old"]
    assert {r["label"] for r in QUERIES["cluster_report_hard"](spark, SF).collect()} == {None, 0, 1, 2}


def test_flagship(spark):
    rows = {r["horizon"]: r["n"] for r in flagship(spark, "/root/testdata/sf0.001").collect()}
    assert rows["overall"] == 3 * rows["4h"] == 3 * 5 * 65
