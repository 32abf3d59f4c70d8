"""Streaming forms of the online gates. Every function takes and returns a (streaming) DataFrame."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.config import AlertConfig, ImpactConfig, QualityConfig, RuntimeConfig, TrackingConfig
from ridelens.functions import scoring
from ridelens.operators import alert_policy as policy
from ridelens.operators import tracking
from ridelens.operators.rows import flag_impacts, gate_alerts, rows_where, score_alerts, status_columns
from ridelens.streaming.state import RIDE_TTL_S, LateTagger, stateful

NS_PER_MS = 1_000_000


def event_time(df: DataFrame, ts: str = "timestamp_ns") -> DataFrame:
    """Watermark column: nanoseconds are cut to microseconds for the watermark only."""
    return df.withColumn("event_time", F.timestamp_micros(F.floor(F.col(ts) / 1000).cast("long")))


# --- alert policy ------------------------------------------------------------------------------

def alert_policy(tracks: DataFrame, *, key: str = "session_id", ts: str = "timestamp_ns", tie: Sequence[str] = ("seq", "price"),
                 cfg: AlertConfig = AlertConfig(), ttl_s: int | None = RIDE_TTL_S) -> DataFrame:
    """Decisions of the rows that pass the stateless gates; cooldowns and alerted tracks live in the state store."""
    base = gate_alerts(score_alerts(tracks, cfg), cfg)
    slim = rows_where(base, F.col("gate_reason").isNull(), key, ts, *tie, "track_id", "semantic_type", "severity", "alert_score",
                      scoring.phrase().alias("phrase"))
    types = dict(slim.dtypes)
    cols = [ts, *tie, "track_id", "semantic_type", "alert_score"]

    def step(state: dict, rows: list[dict], out: list) -> dict:
        for r in rows:
            why = policy.decide(state, int(r[ts]), int(r["track_id"]), r["semantic_type"], int(r["severity"]), cfg)
            out.append((*(r[c] for c in cols), why, why == "fired", r["phrase"] if why == "fired" else ""))
        return state

    names = [*cols, "reason", "fired", "phrase"]
    schema = f"{key} {types[key]}, " + ", ".join(f"{c} {types[c]}" for c in cols) + ", reason string, fired boolean, phrase string"
    return stateful(slim, [key], [ts, *tie], policy.new_policy_state, step, schema, names, ttl_s=ttl_s)


# --- tracking ------------------------------------------------------------------------------------

def track_sessions(observations: DataFrame, *, key: str = "session_id", cfg: TrackingConfig = TrackingConfig(), ttl_s: int | None = RIDE_TTL_S) -> DataFrame:
    """The tracker on a stream of detections. A frame is processed once a later frame of its session has
    arrived, so detections of one frame may be spread over files."""
    key_t = dict(observations.dtypes)[key]
    names = [c.split()[0] for c in tracking.OUTPUT.split(", ")]

    def step(state: dict, rows: list[dict], out: list) -> dict:
        c = {n: [r[n] for r in rows] for n in rows[0]}
        tracking.step_rows(state, c, range(len(rows)), lambda row: out.append(tuple(row[n] for n in names)), cfg)
        return state

    cols = list(dict.fromkeys([key, *tracking.FRAME, *tracking.OBS]))
    return stateful(observations.select(*cols), [key], ["timestamp_ns", "frame_id", "obs_index"], tracking.new_session, step,
                    f"{key} {key_t}, {tracking.OUTPUT}", names, ttl_s=ttl_s)


# --- sensors ---------------------------------------------------------------------------------------

def stall_monitor(imu: DataFrame, *, keys: Sequence[str] = ("session_id", "sensor_type"), ts: str = "timestamp_ns", tie: Sequence[str] = ("event_id",),
                  expected_hz: float = 200.0, factor: float = 4.0, ttl_s: int | None = RIDE_TTL_S) -> DataFrame:
    """SENSOR_STALL on long gaps; a row older than the last one seen is reported as TIMESTAMP_JUMP, not dropped."""
    limit = 1e9 / max(expected_hz, 1e-3) * factor
    types = dict(imu.dtypes)

    def step(state: dict, rows: list[dict], out: list) -> dict:
        for r in rows:
            t, last = int(r[ts]), state.get("last")
            if last is not None and t - last > limit:
                out.append((t, t - last, "SENSOR_STALL"))
            elif last is not None and t < last:
                out.append((t, t - last, "TIMESTAMP_JUMP"))
            state["last"] = t
        return state

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", {ts} long, dt_ns long, code string"
    return stateful(imu.select(*keys, ts, *tie), keys, [ts, *tie], dict, step, schema, [ts, "dt_ns", "code"], ttl_s=ttl_s)


def rate_windows(imu: DataFrame, *, keys: Sequence[str] = ("session_id", "sensor_type"), ts: str = "timestamp_ns", delay: str = "500 milliseconds") -> DataFrame:
    """Samples per second and sensor in tumbling windows."""
    timed = event_time(imu, ts).withWatermark("event_time", delay)
    return timed.groupBy(F.window("event_time", "1 second"), *keys).agg(F.count(F.lit(1)).alias("hz")).select(
        *keys, F.unix_micros("window.start").alias("start_us"), "hz")


def tag_late(rows: DataFrame, *, keys: Sequence[str] = ("session_id", "sensor_type"), ts: str = "timestamp_ns", delay_ns: int = 500 * NS_PER_MS, ttl_s: int | None = RIDE_TTL_S) -> DataFrame:
    """Every row with newest_ns and `late`: older than the newest row of its key in earlier micro-batches by more than `delay_ns`.

    Nothing is dropped: rows that are not late go on to windows, late ones to a side table of anomalies, and both
    together are the input. `newest_ns` is null in a key's first batch. The state is one number per key.
    """
    from pyspark.sql.types import BooleanType, LongType, StructField, StructType

    out = StructType([*rows.schema.fields, StructField("newest_ns", LongType()), StructField("late", BooleanType())])
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=LateTagger(ts, delay_ns, ttl_s), outputStructType=out, outputMode="Append",
                                                          timeMode="ProcessingTime" if ttl_s else "None")


def crash_monitor(imu: DataFrame, *, key: str = "session_id", ts: str = "timestamp_ns", cfg: ImpactConfig = ImpactConfig(), ttl_s: int | None = RIDE_TTL_S) -> DataFrame:
    """One row per session: the earliest severe sample of the first micro-batch that has one; later ones stay silent."""
    hits = flag_impacts(imu, cfg=cfg).where("severe").select(key, ts, "residual")

    def step(state: dict, rows: list[dict], out: list) -> dict:
        if not state:
            out.append((int(rows[0][ts]), rows[0]["residual"]))
            state["reported"] = True
        return state

    return stateful(hits, [key], [ts], dict, step, f"{key} {dict(imu.dtypes)[key]}, {ts} long, residual double", [ts, "residual"], ttl_s=ttl_s)


def harvest_impact_stream(tracks: DataFrame, *, cfg: ImpactConfig = ImpactConfig()) -> DataFrame:
    """Impact events of near objects, frame by frame (stateless; write with an append sink)."""
    score = scoring.impact_score(F.col("accel_z"), F.col("own_speed_mps"), F.when(F.col("distance_valid"), F.col("distance_m")), cfg)
    hit = tracks.withColumn("impact_score", score).where(F.coalesce("impact_score", F.lit(0.0)) > 0)
    return hit.select("session_id", "track_id", "timestamp_ns", F.lit("M5").alias("domain"), F.lit("IMPACT_SPIKE").alias("code"),
                      F.format_string("score=%.3f", "impact_score").alias("detail"), F.lit(False).alias("used_for_alert"))


# --- frames --------------------------------------------------------------------------------------------

def event_clip_stream(frames: DataFrame, alerts: DataFrame, *, key: str = "session_id", frame_ts: str = "sensor_timestamp_ns", alert_ts: str = "timestamp_ns",
                      pre_s: float = 2.0, post_s: float = 2.0, delay: str = "1 second") -> DataFrame:
    """Frames within [alert − pre, alert + post] of each fired alert: a stream-stream interval join."""
    f = event_time(frames, frame_ts).withColumnRenamed("event_time", "frame_time").withWatermark("frame_time", delay)
    a = event_time(alerts.where("fired"), alert_ts).withColumnRenamed("event_time", "alert_time").withColumnRenamed(key, "_key").withWatermark("alert_time", delay)
    pre, post = F.expr(f"INTERVAL {int(pre_s * 1e6)} MICROSECONDS"), F.expr(f"INTERVAL {int(post_s * 1e6)} MICROSECONDS")
    on = (F.col(key) == F.col("_key")) & (F.col("frame_time") >= F.col("alert_time") - pre) & (F.col("frame_time") <= F.col("alert_time") + post)
    return f.join(a, on, "inner").drop("_key")


def capture_match_stream(events: DataFrame, *, key: str = "session_id", seq: str = "arrival", ts: str = "timestamp_ns", max_dt_ns: int = 2 * NS_PER_MS,
                         capacity: int = 24, ttl_s: int | None = RIDE_TTL_S) -> DataFrame:
    """Image timestamps matched against a ring of the last `capacity` capture results, in arrival order.

    `events` rows are results (`kind = 'result'`) or images (`kind = 'image'`) with a growing arrival number.
    """
    types = dict(events.dtypes)

    def step(state: dict, rows: list[dict], out: list) -> dict:
        arrived: list[int] = state.setdefault("arrived", [])  # results in the ring, oldest first
        free: list[int] = state.setdefault("free", [])  # times of those that no image has taken, sorted
        for r in rows:
            t = int(r[ts])
            if r["kind"] == "result":
                arrived.append(t)
                insort(free, t)
                for old in arrived[:-capacity]:
                    at = bisect_left(free, old)
                    if free[at : at + 1] == [old]:
                        out.append((r[seq], t, free.pop(at), "ORPHAN_RESULT"))
                del arrived[:-capacity]
                continue
            before, state["image"] = state.get("image", t - 1), t
            if t <= before:
                out.append((r[seq], t, None, "DUPLICATE" if t == before else "REORDER"))
            at = bisect_left(free, t)
            around = range(max(0, at - 1), min(len(free), at + 1))
            best = min(around, key=lambda i: abs(free[i] - t), default=None)
            near = best is not None and abs(free[best] - t) <= max_dt_ns
            out.append((r[seq], t, free.pop(best), "MATCHED") if near else (r[seq], t, None, "UNMATCHED_FRAME"))
        return state

    return stateful(events.select(key, seq, ts, "kind"), [key], [seq], dict, step,
                    f"{key} {types[key]}, {seq} {types[seq]}, {ts} long, result_ns long, code string", [seq, ts, "result_ns", "code"], ttl_s=ttl_s)


def quality_stream(frames: DataFrame, *, key: str = "session_id", ts: str = "sensor_timestamp_ns", frame: str = "event_id",
                   cfg: QualityConfig = QualityConfig(), runtime: RuntimeConfig = RuntimeConfig(), ttl_s: int | None = RIDE_TTL_S) -> DataFrame:
    """Bad streak, selected frame, status and thermal policy of every frame (needs usable, visibility_class, occluded_ratio, thermal_c)."""
    types = dict(frames.dtypes)
    carried = ["visibility_class", "usable", "occluded_ratio", "thermal_c"]
    limit = min(cfg.max_selected_age_ns, cfg.buffer_ns)

    def step(state: dict, rows: list[dict], out: list) -> dict:
        for r in rows:
            t, last = int(r[ts]), state.get("last")
            dt = cfg.first_frame_dt_s if last is None else max(cfg.min_dt_s, (t - last) / 1e9)
            state["last"] = t
            if r["usable"]:
                state["good"], state["streak"] = (t, r[frame]), 0.0
            else:
                state["streak"] = state.get("streak", 0.0) + dt
            good = state.get("good")
            fresh = good is not None and t - good[0] <= limit
            out.append((t, r[frame], *(r[c] for c in carried), state["streak"], good[1] if fresh else r[frame], fresh))
        return state

    names = [ts, frame, *carried, "bad_streak_s", "selected_frame", "fresh"]
    schema = (f"{key} {types[key]}, {ts} long, {frame} {types[frame]}, visibility_class string, usable boolean, occluded_ratio double, thermal_c double, "
              f"bad_streak_s double, selected_frame {types[frame]}, fresh boolean")
    return status_columns(stateful(frames.select(key, ts, frame, *carried), [key], [ts, frame], dict, step, schema, names, ttl_s=ttl_s), cfg, runtime)
