"""Parallel next-fit packing against the plain walk."""

import random

from ridelens.plans.packing import next_fit
from ridelens.sources import sinks

DDL = "session_id string, path string, length long"


def walk(rows, cap):
    """Volume of every row, one file after the other; equal rows keep equal multisets."""
    out, state = [], {}
    for key, path, length in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2] if r[2] is not None else -1)):
        size = max(length or 0, 0)
        vol, used, n = state.get(key, (1, 0, 0))
        if n and used + size > cap:
            vol, used = vol + 1, 0
        state[key] = (vol, used + size, n + 1)
        out.append((key, path, length, vol))
    return sorted(out, key=repr)


def got(spark, rows, cap):
    plan = sinks.plan_export_volumes(spark.createDataFrame(rows, DDL), cap)
    assert plan.dtypes == [("session_id", "string"), ("path", "string"), ("length", "bigint"), ("volume", "int")]
    return sorted((tuple(r) for r in plan.collect()), key=repr)


def test_one_ride_holds_most_files(spark):
    rnd = random.Random(4)
    rows = [("hot" if rnd.random() < 0.9 else f"r{rnd.randrange(5)}", f"video/{i:05d}", rnd.choice([1, 7, 40, 99, 100, 101, 350])) for i in range(700)]
    for cap in (100, 1000, 10**9):
        assert got(spark, rows, cap) == walk(rows, cap)


def test_empty_and_odd_sizes(spark):
    rows = [("s", "a", 0), ("s", "b", None), ("s", "c", 60), ("s", "d", 0), ("s", "e", 50), ("s", "f", 0), ("s", "g", 500), ("s", "h", -3),
            ("s", "i", 1), ("lead", "a", 0), ("lead", "b", 900), ("lead", "c", 0), ("lead", "d", 0), ("lead", "e", 100), ("lead", "f", 0), ("only_empty", "a", 0), ("only_empty", "b", None), (None, "a", 70), (None, "b", 70), ("big", "a", 900)]
    assert got(spark, rows, 100) == walk(rows, 100)
    assert got(spark, [], 100) == []


def test_repeated_rows_and_clashing_columns(spark):
    rows = [("s", "same", 60, i % 3, i) for i in range(30)]
    df = spark.createDataFrame(rows, "session_id string, path string, length long, _open int, prev int")
    out = next_fit(df.drop("_open"), ["session_id"], ["path"], "length", 100)
    assert out.columns == ["session_id", "path", "length", "prev", "pack"]
    assert sorted(r.pack for r in out.collect()) == list(range(1, 31))
