"""Streams replayed from tables: late rows are kept, and near tracks of impact spikes."""

from pyspark.sql import functions as F

from ridelens.operators import reports
from ridelens.streaming import gates
from ridelens.streaming.replay import replay

SEC = 1_000_000_000


def test_late_rows_and_the_others_are_all_rows(spark):
    rows = [("a", "GYRO", i, t * SEC, b) for i, (t, b) in enumerate([(1, 0), (5, 0), (4, 1), (9, 1), (5, 2), (9, 2), (8, 2), (10, 2)])]
    rows += [("b", "GYRO", 20, 3 * SEC, 2), ("b", "GYRO", 21, 1 * SEC, 2)]
    df = spark.createDataFrame(rows, "session_id string, sensor_type string, event_id int, timestamp_ns long, batch int")
    got = {r.event_id: (r.newest_ns, r.late) for r in replay(df, "batch", 3, lambda s: gates.tag_late(s, delay_ns=SEC // 2, ttl_s=None)).collect()}
    assert len(got) == len(rows)
    # late is what lies more than half a second before the newest row of earlier batches, not of its own batch
    assert {i for i, (_, late) in got.items() if late} == {2, 4, 6}
    assert got[0] == (None, False) and got[2] == (5 * SEC, True) and got[3] == (5 * SEC, False) and got[7] == (9 * SEC, False)
    assert got[20] == got[21] == (None, False)


def test_replay_of_an_empty_table(spark):
    df = spark.createDataFrame([], "session_id string, sensor_type string, timestamp_ns long, batch int")
    assert replay(df, "batch", 2, lambda s: gates.tag_late(s, ttl_s=None)).count() == 0


def test_near_tracks(spark):
    accel = spark.createDataFrame([("a", 1, 10, 20.0), ("a", 2, 10, 30.0), ("a", 3, 31, 20.0), ("a", 4, 50, 9.8), ("b", 5, 10, 20.0), (None, 6, 10, 20.0), ("a", 7, -3, 20.0)],
                                  "session_id string, event_id int, timestamp_ns long, z double")
    near = spark.createDataFrame([("a", 0, 7), ("a", 20, 9), ("a", 20, 9), ("a", 21, 8), ("a", None, 1), ("c", 10, 2), ("a", 13, 3)], "session_id string, timestamp_ns long, track_id int")
    got = {r.event_id: r.near_track_ids for r in reports.harvest_impact_windows(accel, near=near, near_ns=10).collect()}
    assert got == {1: [3, 7, 9], 2: [3, 7, 9], 3: [8], 5: [], 6: [], 7: [7]}
    assert "near_track_ids" not in reports.harvest_impact_windows(accel).columns
    assert reports.harvest_impact_windows(accel, near=near.where("false"), near_ns=10).select(F.sum(F.size("near_track_ids"))).first()[0] == 0
