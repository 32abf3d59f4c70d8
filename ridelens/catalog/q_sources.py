"""Session tables written and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.catalog.registry import Views, query
from ridelens.session import shared_folder
from ridelens.sources import bundles, sinks

_LOGS = ("frames", "gyro", "accelerometer", "rotation_vector", "location")


@query("session_tables", ["ev", "a_frames", "a_imu", "a_location"], """
with r as (
  select session_id, 'frames' as log, sensor_timestamp_ns as t, event_id as v from a_frames
  union all select session_id, case sensor_type when 'GYRO' then 'gyro' when 'ACCEL' then 'accelerometer' else 'rotation_vector' end,
    timestamp_ns, round(x * 1000)::bigint from a_imu
  union all select session_id, 'location', timestamp_ns, round(coalesce(latitude, 0) * 1000)::bigint from a_location)
select session_id::varchar as session_id, log, count(*) as n, min(t) as first_ns, max(t) as last_ns, sum(v)::bigint as total from r group by 1, 2
""")
def _(v: Views):
    out = shared_folder(v.spark, "sessions")
    sinks.write_session_tables({
        "frames": v.a_frames.select("session_id", F.col("event_id").alias("frame_id"), "sensor_timestamp_ns"),
        "imu": v.a_imu.select("session_id", "timestamp_ns", "sensor_type", "x", "y", "z"),
        "location": v.a_location.select("session_id", "timestamp_ns", "latitude", "longitude", "altitude")}, out)

    def part(kind: str) -> DataFrame:
        log = bundles.read_log(v.spark, out, kind)
        ts = "sensor_timestamp_ns" if kind == "frames" else "timestamp_ns"
        value = {"frames": F.col("frame_id"), "location": F.round(F.coalesce("latitude", F.lit(0.0)) * 1000)}.get(kind, F.round(F.col("x") * 1000))
        return log.groupBy("session_id", F.lit(kind).alias("log")).agg(
            F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ns"), F.max(ts).alias("last_ns"), F.sum(value.cast("long")).alias("total"))

    return reduce(DataFrame.unionByName, map(part, _LOGS))
