"""Chunked plans against plain Python, with one key holding most rows and chunks much smaller than the data."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from ridelens.plans import ordered as O
from ridelens.plans.grid import near_join, overlap_join

random.seed(5)
ROWS = [("hot" if random.random() < 0.7 else f"k{i % 5}", random.randrange(0, 20_000), i, random.random() * 10) for i in range(900)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "k string, t long, id long, v double").repartition(4).cache()


def by_key():
    out = {}
    for r in sorted(ROWS, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("chunk", [None, 37.0, 1000.0])
def test_with_previous(df, chunk):
    got = {r.id: r.prev_v for r in O.with_previous(df, ["k"], ["t", "id"], ["v"], chunk=chunk).collect()}
    want = {}
    for rows in by_key().values():
        for i, r in enumerate(rows):
            want[r[2]] = rows[i - 1][3] if i else None
    assert got == want


@pytest.mark.parametrize("chunk", [None, 37.0, 1000.0])
def test_rank_and_running_sum(df, chunk):
    got = {r.id: (r.s, r.n) for r in O.running_sums(df, ["k"], ["t", "id"], {"s": F.col("id"), "n": F.lit(1)}, chunk=chunk).collect()}
    for rows in by_key().values():
        s = 0
        for i, r in enumerate(rows):
            s += r[2]
            assert got[r[2]] == (s, i + 1)


@pytest.mark.parametrize("chunk,block", [(None, 10), (200.0, 10), (200.0, 3)])
def test_trailing(df, chunk, block):
    got = {r.id: round(r.m, 9) for r in O.trailing(df, ["k"], ["t", "id"], 7, {"m": F.max("v")}, chunk=chunk, block=block).collect()}
    for rows in by_key().values():
        for i, r in enumerate(rows):
            assert got[r[2]] == round(max(x[3] for x in rows[max(0, i - 6):i + 1]), 9)


@pytest.mark.parametrize("chunk", [None, 50.0, 2000.0])
def test_asof_is_brute_force_nearest(spark, df, chunk):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}", random.randrange(-500, 21_000), i) for i in range(300)], "k string, lt long, lid long")
    out = O.asof(left, df, ["k"], "lt", "t", ["v"], tie=["id"], chunk=chunk).collect()
    assert len(out) == 300
    series = by_key()
    for r in out:
        ts = [(x[1], x[2]) for x in series.get(r.k, [])]
        i = bisect.bisect_right([a for a, _ in ts], r.lt)
        assert (r.prev.id if r.prev else None) == (ts[i - 1][1] if i else None)
        j = bisect.bisect_left([a for a, _ in ts], r.lt)
        assert (r.next.id if r.next else None) == (ts[j][1] if j < len(ts) else None)


@pytest.mark.parametrize("force", [False, True])
def test_rank_quantiles(df, force):
    picks = {"lin": ("linear", 0.95), "near": ("nearest", 0.95), "flo": ("floor", 0.95), "up": ("upper", 0)}
    out = O.rank_quantiles(df.withColumn("t", F.col("t") % 50), ["k"], "t", picks, chunk=7.0 if force else None).collect()
    for r in out:
        xs = sorted(x[1] % 50 for x in by_key()[r.k])
        n = len(xs)
        pos = 0.95 * (n - 1)
        lo = int(pos)
        assert r.n == n
        assert abs(r.lin - (xs[lo] + (xs[min(lo + 1, n - 1)] - xs[lo]) * (pos - lo))) < 1e-9
        assert (r.near, r.flo, r.up) == (xs[round(pos)], xs[lo], xs[n // 2])


def test_band_join(spark, df):
    left = df.select("k", F.col("t").alias("c"), F.col("id").alias("lid")).where("id % 9 = 0")
    got = {(r.lid, r.id) for r in O.band_join(left, df, ["k"], F.col("c") - 40, F.col("c") + 25, "t", bucket=64).select("lid", "id").collect()}
    want = {(a[2], b[2]) for a in ROWS if a[2] % 9 == 0 for b in ROWS if a[0] == b[0] and a[1] - 40 <= b[1] <= a[1] + 25}
    assert got == want


def test_wild_time_and_hot_key_keep_chunks_small(spark):
    """One absurd timestamp, and a key with nine tenths of all rows, leave every chunk at its constant width."""
    step = int(O.TIME_CHUNK // 100)
    rows = [("hot" if i % 10 else "k", i * step, i) for i in range(1000)] + [("hot", 2**62, 5000)]
    df = spark.createDataFrame(rows, "k string, t_ns long, id long")
    sizes = df.groupBy("k", O._chunk_col("t_ns", O.chunk_width("t_ns"))).count().agg(F.max("count")).first()[0]
    assert sizes <= 101
    got = O.with_rank(df, ["k"], ["t_ns", "id"]).groupBy("k").agg(F.max("rank").alias("m"), F.count("*").alias("n")).collect()
    assert all(r.m == r.n - 1 for r in got)


def test_value_chunks_are_monotone(spark):
    vs = [-1e300, -5.5, -1e-3, 0.0, 1e-3, 2.0, 2.5, 1e9, 2.0**62]
    got = [r.c for r in spark.createDataFrame([(v,) for v in vs], "v double").select(O.value_chunk("v").alias("c"), "v").orderBy("v").collect()]
    assert got == sorted(got)


def test_grid_joins(spark):
    random.seed(3)
    a = [("f", i, random.uniform(0, 900), random.uniform(0, 900), random.uniform(1, 400), random.uniform(1, 90)) for i in range(80)]
    df = spark.createDataFrame([(f, i, x, y, x + w, y + h) for f, i, x, y, w, h in a], "f string, i int, x0 double, y0 double, x1 double, y1 double")
    other = df.select("f", F.col("i").alias("j"), *[F.col(c).alias(f"o{c}") for c in ("x0", "y0", "x1", "y1")])
    box = lambda p: tuple(F.col(f"{p}{c}") for c in ("x0", "y0", "x1", "y1"))
    got = [(r.i, r.j) for r in overlap_join(df, other, ["f"], box(""), box("o"), size=100.0).collect()]
    want = [(p[1], q[1]) for p in a for q in a if p[2] <= q[2] + q[4] and q[2] <= p[2] + p[4] and p[3] <= q[3] + q[5] and q[3] <= p[3] + p[5]]
    assert sorted(got) == sorted(want)
    near = [(r.i, r.j) for r in near_join(df, other, ["f"], (F.col("x0"), F.col("y0")), (F.col("ox0"), F.col("oy0")), 120.0).collect()]
    want = [(p[1], q[1]) for p in a for q in a if (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= 120.0 ** 2]
    assert sorted(near) == sorted(want)
