"""Clips of a stream with late, missing and repeated frames against a plain frame buffer."""

from collections import deque

from pyspark.sql import functions as F

from ridelens.streaming import clips
from ridelens.streaming.replay import replay

MS = 1_000_000


def buffered(frames, alerts, ring, post_ns):
    """One ride after the other, in event order; frames come before alerts of the same time."""
    out = {}
    for key in {r[0] for r in frames + alerts}:
        pre, open_, done = deque(maxlen=ring), [], []
        events = sorted([(t, 0, i) for k, i, t in frames if k == key] + [(t, 1, a) for k, a, t in alerts if k == key], key=lambda e: e[:2])
        for t, kind, what in events:
            if kind:
                open_.append((what, t, list(pre)))
                continue
            pre.append((t, what))
            for c in open_:
                c[2].append((t, what))
            done += [(*c, True) for c in open_ if t - c[1] >= post_ns]
            open_ = [c for c in open_ if t - c[1] < post_ns]
        for a, t, got, complete in done + [(*c, False) for c in open_]:
            out[key, a] = (t, got[0][1] if got else 0, got[-1][1] if got else -1, len(got), got[0][0] if got else None, got[-1][0] if got else None,
                           complete, not got)
    return out


def test_late_and_missing_frames(spark):
    frames = [("a", i, i * 100 * MS) for i in range(120) if not 40 <= i < 55]  # frames 40 to 54 never came
    frames += [("b", i, 20_000 * MS + i * 50 * MS) for i in range(30)] + [("b", 30, 20_000 * MS + 29 * 50 * MS)]
    alerts = [("a", "start", 0), ("a", "gap", 4_200 * MS), ("a", "two", 7_050 * MS), ("a", "same", 7_050 * MS), ("a", "end", 11_500 * MS),
              ("b", "before", 19_000 * MS), ("b", "last", 21_400 * MS), ("c", "alone", 5_000 * MS)]
    f = spark.createDataFrame(frames, "ride string, frame_index long, sensor_timestamp_ns long")
    a = spark.createDataFrame(alerts, "ride string, alert_id string, timestamp_ns long")
    rows = clips.clip_rows(f, a, key="ride")
    # a third of all rows arrives one part later than its time says, within the delay
    arrival = F.floor(F.col("t") / (8_000 * MS)).cast("int") + (F.floor(F.col("t") / (50 * MS)) % 3 == 0).cast("int")
    tick = spark.createDataFrame([("z", 10**12, clips.TICK, -1, "", 4)], "ride string, t long, kind int, idx long, alert string, batch int")
    too_late = spark.createDataFrame([("a", 1, clips.FRAME, 999, "", 5)], tick.schema)
    arriving = rows.withColumn("batch", arrival).unionByName(tick).unionByName(too_late)
    got = replay(arriving, "batch", 6, lambda s: clips.clip_stream(s, key="ride", pre_s=1.0, post_s=1.0, fps=5.0, delay="17 seconds"))
    assert got.columns == ["ride", "alert_id", *clips.COLUMNS]
    result = got.collect()
    want = buffered(frames, alerts, 9, 1000 * MS)
    assert {(r.ride, r.alert_id): tuple(r)[2:] for r in result} == want
    assert len(result) == len(want) == len(alerts)
    assert not want["a", "end"][6] and want["a", "gap"][6] and want["c", "alone"][7]
