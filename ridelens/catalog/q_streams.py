"""Streams over given tables: each runs to its end in several micro-batches and returns the rows of its sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridelens.catalog import q_hygiene, q_joins  # noqa: F401  (their oracles are used below)
from ridelens.catalog.registry import ORACLES, Views, query
from ridelens.config import ImpactConfig
from ridelens.operators import rows
from ridelens.streaming import clips, gates
from ridelens.streaming.replay import replay

BATCHES = 4
# the rows of a quarter of the time arrive together; `late`: every tenth one arrives a quarter later
_ARRIVAL = "select i.*, (timestamp_ns - lo) * 4 // (hi - lo + 1){late} as batch from a_imu i, (select min(timestamp_ns) as lo, max(timestamp_ns) as hi from a_imu)"


def _arriving(v: Views, late: bool):
    imu = v.a_imu
    lo, hi = imu.agg(F.min("timestamp_ns"), F.max("timestamp_ns")).first()
    batch = F.floor((F.col("timestamp_ns") - (lo or 0)) * BATCHES / ((hi or 0) - (lo or 0) + 1)).cast("int")
    return imu.withColumn("batch", batch + (F.col("event_id") % 10 == 0).cast("int") if late else batch)


@query("rate_and_late_stream", ["ev", "a_imu"], f"""
with r as ({_ARRIVAL.format(late=" + (event_id % 10 = 0)::int")}),
b as (select session_id, sensor_type, batch, max(timestamp_ns) as top from r group by 1, 2, 3),
w as (select *, max(top) over (partition by session_id, sensor_type order by batch rows between unbounded preceding and 1 preceding) as newest from b),
t as (select r.*, coalesce(timestamp_ns < newest - 500000000, false) as late from r join w using (session_id, sensor_type, batch))
select session_id, sensor_type, timestamp_ns // 1000000000 as second, late, count(*) as n from t group by 1, 2, 3, 4
""")
def _(v: Views):
    tagged = replay(_arriving(v, True), "batch", BATCHES + 1, lambda s: gates.tag_late(s, ttl_s=None))
    second = F.floor(F.col("timestamp_ns") / 1_000_000_000)
    return tagged.groupBy("session_id", "sensor_type", second.alias("second"), "late").agg(F.count(F.lit(1)).alias("n"))


@query("stall_stream", ["ev", "a_imu"], """
with g as (select *, timestamp_ns - lag(timestamp_ns) over (partition by session_id, sensor_type order by timestamp_ns, event_id) as dt_ns from a_imu)
select session_id, sensor_type, timestamp_ns, dt_ns, 'SENSOR_STALL' as code from g where dt_ns > 20000000
""")
def _(v: Views):
    return replay(_arriving(v, False), "batch", BATCHES, lambda s: gates.stall_monitor(s, ttl_s=None))


@query("crash_stream", ["ev", "a_imu"], """
with h as (select *, sqrt(x * x + y * y + z * z) as norm from a_imu where sensor_type = 'ACCEL')
select session_id, min(timestamp_ns) as timestamp_ns from h where abs(norm - 9.81) >= 5 group by 1
""")
def _(v: Views):
    return replay(_arriving(v, False), "batch", BATCHES, lambda s: gates.crash_monitor(s.where("sensor_type = 'ACCEL'"), cfg=ImpactConfig(residual_threshold=5.0), ttl_s=None)).select("session_id", "timestamp_ns")


@query("quality_stream", None, ORACLES["frame_status"])
def _(v: Views):
    frames = rows.classify_frames(v.a_frames).select("session_id", "sensor_timestamp_ns", "event_id", "usable", "visibility_class", "occluded_ratio", "thermal_c")
    lo, hi = frames.agg(F.min("sensor_timestamp_ns"), F.max("sensor_timestamp_ns")).first()
    batch = F.floor((F.col("sensor_timestamp_ns") - (lo or 0)) * BATCHES / ((hi or 0) - (lo or 0) + 1)).cast("int")
    out = replay(frames.withColumn("batch", batch), "batch", BATCHES, lambda s: gates.quality_stream(s, ttl_s=None))
    return out.select("session_id", "event_id", "status", "thermal_reason", "skip_far_roi", "infer_period_ns")


@query("clip_stream", None, ORACLES["event_clips"])
def _(v: Views):
    al = v.a_alerts.where("fired").select("session_id", F.col("event_id").alias("alert_id"), "timestamp_ns")
    events = clips.clip_rows(q_joins._frames(v), al)
    lo, hi = events.agg(F.min("t"), F.max("t")).first()
    lo, hi = lo or 0, hi or 0
    # every tenth time stamp arrives a part later, which the watermark waits for; a last row ends all rides
    batch = F.floor((F.col("t") - lo) * BATCHES / (hi - lo + 1)).cast("int") + (F.floor(F.col("t") / 1000) % 10 == 0).cast("int")
    part_s = (hi - lo) // BATCHES // 1_000_000_000 + 1
    ends = events.sparkSession.range(1).select(F.lit(-1).cast("long").alias("session_id"), F.lit(hi + (2 * part_s + 120) * 1_000_000_000).alias("t"),
                                              F.lit(clips.TICK).alias("kind"), F.lit(-1).cast("long").alias("idx"), F.lit("").alias("alert"))
    arriving = events.withColumn("batch", batch).unionByName(ends.withColumn("batch", F.lit(BATCHES + 1)))
    out = replay(arriving, "batch", BATCHES + 2, lambda s: clips.clip_stream(s, fps=1.0, delay=f"{2 * part_s} seconds"))
    return out.select("session_id", F.col("alert_id").cast("long").alias("alert_id"), "start_index", "end_index", "n_frames", "start_ns", "end_ns", "complete")
