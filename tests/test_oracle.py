"""Registered queries against their SQL at the smallest scale; time-ordered ones also with forced chunks."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from ridelens.plans import ordered

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["alert_rate_report", "gate_alerts", "map_public_labels", "redact_text", "match_gt", "nms", "alert_policy", "track_lifecycle",
         "plan_export_volumes", "ride_report_parts"]
CHUNKED = ["interp_linear", "interp_location", "interval_percentiles", "bad_streak", "infer_schedule", "event_clips", "match_one_to_one", "ttc", "scan_time_offset"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cell(x):
    if isinstance(x, float) and not math.isnan(x):
        return repr(x + 0.0)
    return str(x)


def compare(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(cell(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want and got


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, duck, name):
    compare(spark, duck, name)


@pytest.mark.parametrize("name", CHUNKED)
def test_query_in_chunks(spark, duck, name, monkeypatch):
    monkeypatch.setattr(ordered, "TIME_CHUNK", 3e9)
    monkeypatch.setattr(ordered, "INDEX_CHUNK", 200.0)
    compare(spark, duck, name)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_entry(spark):
    assert entry.entry(spark).count() == 1
