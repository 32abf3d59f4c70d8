"""Every stream gives what the batch operator gives on the same rows."""

import pytest
from pyspark.sql import functions as F

from ridelens.catalog.q_state import observations
from ridelens.catalog.registry import Views
from ridelens.config import ImpactConfig
from ridelens.operators import alert_policy as batch_policy
from ridelens.operators import hygiene, rows, tracking
from ridelens.streaming import gates

SF = "/root/testdata/sf0.001"


@pytest.fixture
def run(spark, tmp_path):
    """Write a batch table as time-ordered files, read it as a stream, return the collected result."""
    count = [0]

    def feed(df, ts, files=3):
        count[0] += 1
        src = str(tmp_path / f"in{count[0]}")
        lo, hi = df.agg(F.min(ts), F.max(ts)).first()
        step = max(1, (hi - lo) // files + 1)
        for i in range(files):
            part = df.where((F.col(ts) >= lo + i * step) & (F.col(ts) < lo + (i + 1) * step))
            part.coalesce(1).write.mode("append").parquet(src)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(src)

    def collect(stream_df):
        count[0] += 1
        name = f"out_{count[0]}"
        q = (stream_df.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(tmp_path / f"cp{count[0]}")).trigger(availableNow=True).start())
        assert q.awaitTermination(180)
        return spark.table(name).collect()

    return feed, collect


def same(a, b, cols):
    key = lambda r: tuple(str(r[c]) for c in cols)
    assert sorted(map(key, a)) == sorted(map(key, b))


def test_alert_policy(spark, run):
    feed, collect = run
    t = Views(spark, SF).a_tracks
    got = collect(gates.alert_policy(feed(t, "timestamp_ns"), ttl_s=None))
    want = batch_policy.alert_policy(t).where("reason in ('fired', 'already_alerted', 'global_cooldown', 'class_cooldown')").collect()
    assert want
    same(got, want, ["session_id", "timestamp_ns", "seq", "price", "reason", "phrase"])


def test_track_sessions(spark, run):
    feed, collect = run
    obs = observations(Views(spark, SF)).where("session_id < 6")
    got = collect(gates.track_sessions(feed(obs, "timestamp_ns"), ttl_s=None))
    want = tracking.track_sessions(obs)
    last = want.groupBy("session_id").agg(F.max("timestamp_ns").alias("m"))
    # the stream still waits for the frame after the last one
    want = want.join(last, "session_id").where("timestamp_ns < m").collect()
    assert want
    same(got, want, ["session_id", "timestamp_ns", "track_id", "lifecycle_state", "hits"])


def test_stall_monitor(spark, run):
    feed, collect = run
    imu = Views(spark, SF).a_imu.select("session_id", "sensor_type", "timestamp_ns", "event_id")
    got = collect(gates.stall_monitor(feed(imu, "timestamp_ns"), ttl_s=None, expected_hz=0.5))
    want = hygiene.detect_gaps(imu, keys=["session_id", "sensor_type"], expected_hz=0.5).collect()
    assert want
    same(got, want, ["session_id", "sensor_type", "timestamp_ns", "dt_ns", "code"])


def test_rate_windows(spark, run):
    feed, collect = run
    imu = Views(spark, SF).a_imu
    got = {(r.session_id, r.sensor_type, r.start_us // 1_000_000): r.hz for r in collect(gates.rate_windows(feed(imu, "timestamp_ns")))}
    want = {(r.session_id, r.sensor_type, r.s): r.n for r in imu.groupBy(
        "session_id", "sensor_type", F.floor(F.col("timestamp_ns") / 1_000_000_000).alias("s")).agg(F.count("*").alias("n")).collect()}
    assert len(got) > 0.9 * len(want)  # windows behind the last watermark are still open
    assert all(want[k] == v for k, v in got.items())


def test_crash_monitor(spark, run):
    feed, collect = run
    imu = Views(spark, SF).a_imu
    cfg = ImpactConfig(residual_threshold=4.0)
    got = collect(gates.crash_monitor(feed(imu, "timestamp_ns"), ttl_s=None, cfg=cfg))
    want = rows.flag_impacts(imu, cfg=cfg).where("severe").groupBy("session_id").agg(F.min("timestamp_ns").alias("timestamp_ns")).collect()
    assert want
    same(got, want, ["session_id", "timestamp_ns"])


def test_event_clip_stream(spark, run):
    feed, collect = run
    v = Views(spark, SF)
    f = v.a_frames.select("session_id", "event_id", "sensor_timestamp_ns")
    a = v.a_alerts.select("session_id", F.col("event_id").alias("alert_id"), "timestamp_ns", "fired")
    got = collect(gates.event_clip_stream(feed(f, "sensor_timestamp_ns"), feed(a, "timestamp_ns")))
    want = f.join(a.where("fired"), "session_id").where("abs(sensor_timestamp_ns - timestamp_ns) <= 2000000000").collect()
    assert want
    same(got, want, ["session_id", "event_id", "alert_id"])


def test_quality_stream(spark, run):
    feed, collect = run
    fr = rows.classify_frames(Views(spark, SF).a_frames)
    cols = ["session_id", "sensor_timestamp_ns", "event_id", "usable", "visibility_class", "occluded_ratio", "thermal_c"]
    got = collect(gates.quality_stream(feed(fr.select(*cols), "sensor_timestamp_ns"), ttl_s=None))
    want = rows.frame_status(fr).collect()
    same(got, want, ["session_id", "event_id", "status", "thermal_reason"])


def test_capture_match_stream(spark, run):
    feed, collect = run
    ms = 1_000_000
    ev = [("result", 10), ("result", 20), ("result", 30), ("image", 10), ("image", 21), ("image", 34), ("image", 15), ("image", 15)]
    df = spark.createDataFrame([("s", i, k, t * ms) for i, (k, t) in enumerate(ev)], "session_id string, arrival long, kind string, timestamp_ns long")
    got = {(r.arrival, r.code, r.result_ns) for r in collect(gates.capture_match_stream(feed(df, "arrival"), ttl_s=None))}
    assert got == {(3, "MATCHED", 10 * ms), (4, "MATCHED", 20 * ms), (5, "UNMATCHED_FRAME", None), (6, "REORDER", None), (6, "UNMATCHED_FRAME", None),
                   (7, "DUPLICATE", None), (7, "UNMATCHED_FRAME", None)}


def test_capture_ring_evicts_orphans(spark, run):
    feed, collect = run
    df = spark.createDataFrame([("s", i, "result", i * 10) for i in range(5)], "session_id string, arrival long, kind string, timestamp_ns long")
    got = collect(gates.capture_match_stream(feed(df, "arrival"), ttl_s=None, capacity=3))
    assert [(r.result_ns, r.code) for r in sorted(got, key=lambda r: r.arrival)] == [(0, "ORPHAN_RESULT"), (10, "ORPHAN_RESULT")]


def test_harvest_impact_stream(spark, run):
    feed, collect = run
    t = Views(spark, SF).a_tracks
    got = collect(gates.harvest_impact_stream(feed(t, "timestamp_ns", files=2)))
    want = rows.score_impacts(t.where("distance_valid")).where("impact_score > 0").collect()
    assert len(got) == len(want) > 0
