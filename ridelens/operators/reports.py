"""Session, fleet, ride, impact and evaluation reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.config import AlertConfig, ImpactConfig
from ridelens.functions import scoring
from ridelens.functions import vocab as V
from ridelens.operators.rows import flag_impacts
from ridelens.operators.tracks import first_confirmed
from ridelens.plans.ordered import asof, band_join, rank_quantiles, trailing, with_rank

NS_PER_H = 3.6e12


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


# --- hours and alert rate ----------------------------------------------------------------------

def session_hours(manifests: DataFrame, frames: DataFrame, *, key: str = "session_id", frame_ts: str = "sensor_timestamp_ns") -> DataFrame:
    """Ridden hours of every session of either log: manifest span, else the span of its frame times, else 0."""
    span = F.col("end_elapsed_realtime_ns") - F.col("start_elapsed_realtime_ns")
    man = manifests.groupBy(key).agg(F.max(F.when(span > 0, span / 1e9 / 3600.0)).alias("_mh"))
    t = F.when(F.col(frame_ts) != 0, F.col(frame_ts))
    cam = frames.groupBy(key).agg(F.count(t).alias("_n"), (F.max(t) - F.min(t)).alias("_s"))
    cam_h = F.when(F.col("_n") >= 2, F.greatest(F.lit(0.0), F.col("_s") / 1e9 / 3600.0))
    return man.join(cam, key, "full").select(key, F.coalesce("_mh", cam_h, F.lit(0.0)).alias("hours"))


def alert_sessions(hours: DataFrame, alerts: DataFrame, *, key: str = "session_id") -> DataFrame:
    """Hours and fired alerts of every session of either input; a session known from alerts alone has no hours."""
    fired = alerts.groupBy(key).agg(F.count_if("fired").alias("n_alerts_fired"))
    return hours.join(fired, key, "full").select(
        key, F.coalesce("hours", F.lit(0.0)).alias("hours"), F.coalesce("n_alerts_fired", F.lit(0)).cast("long").alias("n_alerts_fired"))


# Release gate of the false-voice rate.
FALSE_VOICE_HOURS_MIN = 10.0
FALSE_VOICE_PER_HOUR_MAX = 0.5


def alert_rate_report(hours: DataFrame, alerts: DataFrame, *, key: str = "session_id") -> DataFrame:
    """One fleet row: hours, fired alerts, rate and the two gates."""
    per = alert_sessions(hours, alerts, key=key)
    tot = per.agg(F.count(F.lit(1)).alias("n_sessions"), F.coalesce(F.sum("hours"), F.lit(0.0)).alias("hours"),
                  F.coalesce(F.sum("n_alerts_fired"), F.lit(0)).cast("long").alias("n_alerts_fired"))
    rate = share(F.col("n_alerts_fired"), F.col("hours"))
    return (tot.withColumn("alerts_per_hour", rate)
            .withColumn("hours_ok", F.col("hours") >= FALSE_VOICE_HOURS_MIN)
            .withColumn("rate_ok", F.coalesce(F.col("alerts_per_hour") <= FALSE_VOICE_PER_HOUR_MAX, F.lit(False)))
            .withColumn("pass", F.col("hours_ok") & F.col("rate_ok")))


# --- ride report ---------------------------------------------------------------------------------

def runtime_stats(runtime: DataFrame, *, key: str = "session_id") -> DataFrame:
    """Means, shares and the nearest-rank p95 latency of the runtime log; absent columns give nulls."""
    have = set(runtime.columns)
    def col(c: str) -> Column:
        return F.col(c) if c in have else F.lit(None).cast("double")
    n_blur = F.count(col("blur"))
    out = runtime.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_diag"), F.avg(col("blur")).alias("mean_blur"),
        share(F.count_if(col("blur") > 0.5), n_blur).alias("blur_share"),
        share(F.count_if(col("blur") < 0.5), n_blur).alias("usable_frame_share"),
        F.avg(col("infer_fps")).alias("mean_infer_fps"), F.avg(col("thermal_c")).alias("mean_thermal_c"),
        F.avg(col("battery_pct")).alias("mean_battery_pct"), F.avg(col("memory_mb")).alias("mean_memory_mb"),
        F.count_if(F.coalesce(col("inferred").cast("boolean"), F.lit(False))).alias("n_inferred"))
    if "latency_p95_ms" in have:
        q = rank_quantiles(runtime, [key], "latency_p95_ms", {"p95_latency_ms": ("nearest", 0.95)}, count_name="_nl")
        out = out.join(q.drop("_nl"), key, "left")
    else:
        out = out.withColumn("p95_latency_ms", F.lit(None).cast("double"))
    return out


def ride_report(tracks: DataFrame, alerts: DataFrame, runtime: DataFrame, gyro: DataFrame, sessions: DataFrame, *,
                intervals: DataFrame | None = None, verified: DataFrame | None = None, impacts: DataFrame | None = None,
                visibility: str = "visibility_confidence", key: str = "session_id") -> DataFrame:
    """One row per session; each log is aggregated map-side before the small per-session joins.

    `verified` (of `verify_sessions`) adds verify_ok and the numbers of findings, null for a session it does not hold;
    `impacts` (of `impact_report`) adds its columns as impact_*, zero or null without aligned impacts. Track rows with
    and without a visibility value are counted where tracks have that column.
    """
    states = tracks.groupBy(key, F.coalesce("lifecycle_state", F.lit("missing")).alias("lifecycle_state")).agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("lifecycle_state", "n")))).alias("track_states"),
        F.sum("n").alias("n_track_rows"))
    dec = alerts.groupBy(key).agg(F.count(F.lit(1)).alias("n_alert_decisions"), F.count_if("fired").alias("n_alerts_fired"))
    peak = gyro.groupBy(key).agg(F.max(F.abs(F.coalesce("x", F.lit(0.0))) + F.abs(F.coalesce("y", F.lit(0.0)))
                                       + F.abs(F.coalesce("z", F.lit(0.0)))).alias("gyro_peak"))
    out = sessions.select(key).distinct()
    parts = [states, dec, runtime_stats(runtime, key=key), peak, *([intervals] if intervals is not None else [])]
    counts = ["n_track_rows", "n_alert_decisions", "n_alerts_fired", "n_inferred", "n_diag"]
    if visibility in tracks.columns:
        seen = F.col(visibility).isNotNull()
        parts.append(tracks.groupBy(key).agg(F.count_if(seen).alias("n_visibility_known"), F.count_if(~seen).alias("n_visibility_missing")))
        counts += ["n_visibility_known", "n_visibility_missing"]
    if verified is not None:
        parts.append(verified.select(key, F.col("ok").alias("verify_ok"), F.col("n_errors").alias("n_verify_errors"), F.col("n_warnings").alias("n_verify_warnings")))
    if impacts is not None:
        names = [c for c in impacts.columns if c != key]
        parts.append(impacts.select(key, *[F.col(c).alias(f"impact_{c}") for c in names]))
        counts += [f"impact_{c}" for c in names if c.startswith("n_")]
    for part in parts:
        out = out.join(part, key, "left")
    for c in counts:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    return out


def thermal_series(runtime: DataFrame, *, keys: Sequence[str] = ("session_id",), order: Sequence[str] = ("sensor_timestamp_ns", "event_id"),
                   points: int | None = None, chunk: float | None = None) -> DataFrame:
    """Rows that have a temperature or a battery level; with `points`, every max(1, n div points)-th of them."""
    keys = list(keys)
    known = F.col("thermal_c").isNotNull()
    if "battery_pct" in runtime.columns:
        known = known | F.col("battery_pct").isNotNull()
    if points is None:
        return runtime.where(known)
    sizes = runtime.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = with_rank(runtime.where(known), keys, list(order), name="_i", chunk=chunk)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / points))
    return ranked.join(sizes, keys).where(F.col("_i") % step == 0).drop("_n", "_i")


def damping_ab(report: DataFrame, a, b, *, key: str = "session_id") -> DataFrame:
    """Two sessions side by side; the lower blur share wins."""
    cols = ["blur_share", "mean_blur", "gyro_peak", "n_alerts_fired"]
    one = report.where(F.col(key) == F.lit(a)).select(*[F.col(c).alias(f"a_{c}") for c in cols], F.lit(1).alias("_j"))
    two = report.where(F.col(key) == F.lit(b)).select(*[F.col(c).alias(f"b_{c}") for c in cols], F.lit(1).alias("_j"))
    x, y = F.col("a_blur_share"), F.col("b_blur_share")
    return one.join(two, "_j", "full").drop("_j").withColumn(
        "winner_lower_blur_share", F.when(y < x, "B").when(x < y, "A").when(x == y, "tie"))


def damping_pairs(report: DataFrame, pairs: DataFrame, *, key: str = "session_id") -> DataFrame:
    """The same comparison for a table of (a, b) session pairs."""
    cols = ["blur_share", "gyro_peak"]
    out = pairs
    for side in "ab":
        out = out.join(report.select(F.col(key).alias(side), *[F.col(c).alias(f"{side}_{c}") for c in cols]), side, "left")
    x, y = F.col("a_blur_share"), F.col("b_blur_share")
    return out.withColumn("winner_lower_blur_share", F.when(y < x, "B").when(x < y, "A").when(x == y, "tie"))


def model_ab(tracks: DataFrame, alerts: DataFrame, *, variant: str = "variant", order: Sequence[str] = ("timestamp_ns", "seq", "price"),
             a: str = "A", b: str = "B") -> DataFrame:
    """Alerts, confirmed track rows and first confirmed distance per variant, and the differences b−a."""
    conf = tracks.where(F.col("lifecycle_state").isin(V.CONFIRMED_STATES)).groupBy(variant).agg(
        F.count(F.lit(1)).alias("n_confirmed_track_frames"),
        F.min(F.when(F.col("distance_m").isNotNull(), F.struct(*order, "distance_m"))).alias("_f"))
    fired = alerts.where("fired").groupBy(variant).agg(F.count(F.lit(1)).alias("n_alerts"))
    per = tracks.select(variant).distinct().join(conf, variant, "left").join(fired, variant, "left").select(
        variant, F.coalesce("n_alerts", F.lit(0)).alias("n_alerts"),
        F.coalesce("n_confirmed_track_frames", F.lit(0)).alias("n_confirmed_track_frames"),
        F.col("_f.distance_m").alias("first_confirm_m"))
    def side(v: str, c: str) -> Column:
        return F.max(F.when(F.col(variant) == v, F.col(c)))
    cells = [side(v, c).alias(f"{n}_{c}") for n, v in (("a", a), ("b", b))
             for c in ("n_alerts", "n_confirmed_track_frames", "first_confirm_m")]
    wide = per.agg(*cells)
    for c in ("n_alerts", "n_confirmed_track_frames"):
        wide = wide.withColumn(f"delta_{c}", F.coalesce(f"b_{c}", F.lit(0)) - F.coalesce(f"a_{c}", F.lit(0)))
    return wide


METRIC_KEYS = ("direction_accuracy", "distance_mae_m", "alerts", "mean_infer_fps", "p95_latency_ms")


def metric_delta(a: DataFrame, b: DataFrame, *, on: Sequence[str], metrics: Sequence[str] = METRIC_KEYS) -> DataFrame:
    """b − a on each metric, null when either is missing."""
    left = a.select(*on, *[F.col(m).alias(f"a_{m}") for m in metrics])
    right = b.select(*on, *[F.col(m).alias(f"b_{m}") for m in metrics])
    return left.join(right, list(on), "full").select(*on, *[(F.col(f"b_{m}") - F.col(f"a_{m}")).alias(f"delta_{m}") for m in metrics])


def rolling_runtime_stats(frames: DataFrame, *, keys: Sequence[str] = ("session_id",), ts: str = "sensor_timestamp_ns", tie: Sequence[str] = ("event_id",),
                          latency: str = "latency_ms", inferred: str = "inferred", chunk: float | None = None) -> DataFrame:
    """p50 and p95 latency of the last 120 frames, and the rate of the last 40 inferences."""
    keys, order = list(keys), [ts, *tie]
    lat = trailing(frames, keys, order, 120, {
        "latency_p50_ms": F.percentile(latency, F.lit(0.5)), "latency_p95_ms": F.percentile(latency, F.lit(0.95))}, chunk=chunk)
    inf = trailing(frames.where(F.col(inferred)).select(*keys, *order), keys, order, 40, {
        "_first": F.min(ts), "_n": F.count(F.lit(1))}, chunk=chunk)
    rate = F.when(F.col("_n") >= 2, (F.col("_n") - 1) / F.greatest((F.col(ts) - F.col("_first")) / 1e9, F.lit(1e-3))).otherwise(0.0)
    near = asof(lat, inf.withColumn("_fps", rate), keys, ts, ts, ["_fps"], tie=list(tie), chunk=chunk)
    return near.select(*lat.columns, F.coalesce("prev._fps", F.lit(0.0)).alias("infer_fps"))


# --- impacts --------------------------------------------------------------------------------------

def upper_median_speed(location: DataFrame, *, key: str = "session_id", chunk: float | None = 1.0) -> DataFrame:
    q = rank_quantiles(location, [key], "speed_mps", {"speed_mps": ("upper", 0.0)}, count_name="_n", chunk=chunk)
    return q.drop("_n")


def align_future_impact(tracks: DataFrame, accel: DataFrame, *, speeds: DataFrame | None = None, default_speed: float = 0.0,
                        key: str = "session_id", order: Sequence[str] = ("timestamp_ns", "seq", "price"), ts: str = "timestamp_ns",
                        own_speed: str | None = "own_speed_mps", cfg: ImpactConfig = ImpactConfig()) -> DataFrame:
    """Vertical shaking after each first-confirmed track: expected pass ± half window, else the whole horizon."""
    cols = ["distance_m", "geometry_type", "semantic_type", *([own_speed] if own_speed else [])]
    first = first_confirmed(tracks, keys=[key, "track_id"], order=order, cols=cols)
    if speeds is not None:
        first = first.join(speeds.select(key, F.col("speed_mps").alias("_ds")), key, "left")
    else:
        first = first.withColumn("_ds", F.lit(None).cast("double"))
    dflt = F.coalesce("_ds", F.lit(float(default_speed)))
    own = F.coalesce(F.col(own_speed), dflt) if own_speed else dflt
    spd = F.when((own < cfg.min_speed_mps) & (dflt >= cfg.min_speed_mps), dflt).otherwise(own)
    seeds = first.withColumn("speed_mps", spd).where(F.col("speed_mps") >= cfg.min_speed_mps)
    t_pass = F.col("distance_m") / F.col("speed_mps")
    usable = F.col("distance_m").isNotNull() & (t_pass >= 0) & (t_pass <= cfg.horizon_s + cfg.horizon_slack_s)
    half = cfg.pass_half_window_s
    lo = F.when(usable, F.col(ts) + (F.greatest(F.lit(0.0), t_pass - half) * 1e9).cast("long")).otherwise(F.col(ts))
    hi = F.when(usable, F.col(ts) + ((t_pass + half) * 1e9).cast("long")).otherwise(F.col(ts) + int(cfg.horizon_s * 1e9))
    seeds = seeds.withColumn("expected_pass_s", F.when(usable, t_pass)).withColumn("_w0", lo).withColumn("_w1", hi)
    z = accel.select(key, F.col(ts).alias("_at"), scoring.vertical_residual(F.coalesce("z", F.lit(0.0)), cfg).alias("_z"))
    slim = seeds.select(key, "track_id", "_w0", "_w1")
    hits = band_join(slim, z, [key], F.col("_w0"), F.col("_w1"), "_at", bucket=2_000_000_000)
    agg = hits.groupBy(key, "track_id").agg(F.max("_z").alias("_p"), F.avg(F.col("_z") * F.col("_z")).alias("_q"), F.count(F.lit(1)).alias("_n"))
    out = seeds.join(agg, [key, "track_id"], "left")
    zero = F.lit(0.0)
    return out.select(
        key, "track_id", F.col(ts), F.lit(cfg.horizon_s).alias("horizon_s"), "expected_pass_s", "speed_mps", "distance_m",
        F.coalesce("_p", zero).alias("peak_ms2"), F.coalesce(F.sqrt("_q"), zero).alias("rms_ms2"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_imu"),
        scoring.impact_label(F.coalesce("_p", zero), F.col("speed_mps")).alias("impact_label"),
        F.coalesce("geometry_type", F.lit("unknown")).alias("geometry_type"),
        F.coalesce("semantic_type", F.lit("unknown_anomaly")).alias("semantic_type"),
        F.lit(False).alias("used_for_alert"))


def impact_report(aligned: DataFrame, *, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Label counts and the relief-versus-patch separation."""
    relief = F.col("geometry_type").isin(V.RELIEF_GEOMETRIES)
    patch = F.col("semantic_type").isin(V.PATCH_SEMANTICS) | (F.col("geometry_type") == "flat")
    agg = aligned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_aligned"),
        *[F.count_if(F.col("impact_label") == lab).alias(f"n_{lab}") for lab in ("none", "weak", "medium", "strong")],
        F.count_if(relief).alias("n_relief"), F.count_if(patch).alias("n_patch"),
        F.avg(F.when(relief, F.col("peak_ms2"))).alias("mean_relief_peak_ms2"),
        F.avg(F.when(patch, F.col("peak_ms2"))).alias("mean_patch_peak_ms2"))
    delta = F.col("mean_relief_peak_ms2") - F.col("mean_patch_peak_ms2")
    return agg.withColumn("delta_ms2", delta).withColumn("pass", F.coalesce(F.col("delta_ms2") > 0.5, F.lit(False))).withColumn(
        "used_for_alert", F.lit(False))


def crash_scan(imu: DataFrame, *, keys: Sequence[str] = ("session_id",), seq: str = "event_id", ts: str = "timestamp_ns",
               cfg: ImpactConfig = ImpactConfig()) -> DataFrame:
    """Hits among all accelerometer rows of each session, combined map-side; `first_hit_ns` is the first in log order."""
    keys = list(keys)
    return flag_impacts(imu, cfg=cfg).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if("severe").alias("n_hits"),
        F.min_by(F.col(ts), F.when(F.col("severe"), F.col(seq))).alias("first_hit_ns"),
        F.max(F.when(F.col("severe"), F.col("residual"))).alias("max_residual")).withColumn("used_for_alert", F.lit(False))


def harvest_impact_windows(accel: DataFrame, *, near: DataFrame | None = None, near_ns: int = 200_000_000, key: str = "session_id", ts: str = "timestamp_ns",
                           row: str = "event_id", cfg: ImpactConfig = ImpactConfig()) -> DataFrame:
    """Accelerometer rows with a vertical spike and their 0..1 score.

    With `near` (rows of `key`, `ts`, track_id) each spike also gets near_track_ids: the tracks seen within `near_ns`
    of it, ascending, an empty array where there are none. `row` tells the samples of one `key` and `ts` apart. Spikes are
    few, so they go to three time buckets each, of `near_ns`. Of a track a bucket keeps its first and last time: in a spike's
    own bucket every time is near, before it the last one decides and after it the first, so no spike meets all sightings.
    """
    az = scoring.vertical_residual(F.coalesce("z", F.lit(0.0)), cfg)
    out = accel.withColumn("_az", az).where(F.col("_az") >= cfg.spike_ms2).withColumn(
        "impact_score", F.least(F.lit(1.0), F.col("_az") / cfg.full_scale_ms2)).withColumn("used_for_alert", F.lit(False)).drop("_az")
    if near is None:
        return out
    bucket = F.col(ts) - F.pmod(F.col(ts), F.lit(near_ns))  # where the bucket begins, exact for whole numbers
    spikes = out.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.col(row).alias("_row"),
                        F.explode(F.array(bucket - near_ns, bucket, bucket + near_ns)).alias("_bucket"))
    seen = near.select(F.col(key).alias("_key"), F.col(ts).alias("_seen"), "track_id", bucket.alias("_bucket")).groupBy(
        "_key", "_bucket", "track_id").agg(F.min("_seen").alias("_first"), F.max("_seen").alias("_last"))
    met = spikes.join(seen, ["_key", "_bucket"]).where((F.col("_last") >= F.col("_ts") - near_ns) & (F.col("_first") <= F.col("_ts") + near_ns))
    ids = met.groupBy("_key", "_ts", "_row").agg(F.array_sort(F.collect_set("track_id")).alias("near_track_ids"))
    same = (F.col(key).eqNullSafe(F.col("_key"))) & (F.col(ts) == F.col("_ts")) & (F.col(row) == F.col("_row"))
    joined = out.join(ids, same, "left").drop("_key", "_ts", "_row")
    return joined.withColumn("near_track_ids", F.coalesce("near_track_ids", F.array().cast(joined.schema["near_track_ids"].dataType)))


# --- calibration and hard negatives -----------------------------------------------------------------

def reliability_diagram(df: DataFrame, *, keys: Sequence[str] = (), conf: str = "confidence", correct: str = "correct", bins: int = 10) -> DataFrame:
    """Accuracy and mean confidence per bin, empty bins included; the last bin is closed."""
    keys = list(keys)
    c = F.least(F.greatest(F.col(conf), F.lit(0.0)), F.lit(1.0))
    step = 1.0 / bins
    edges = F.array(*[F.lit(i * step) for i in range(bins)])
    binned = df.select(*keys, c.alias("_c"), F.col(correct).cast("double").alias("_y")).withColumn(
        "bin", F.size(F.filter(edges, lambda e: e <= F.col("_c"))) - 1)
    per = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("acc"), F.avg("_c").alias("conf"))
    packed = per.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n", "acc", "conf")))).alias("_m"))
    rows = packed.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    cell = F.col("_m")[F.col("bin")]
    return rows.select(*keys, "bin", (F.col("bin") * step).alias("lo"), ((F.col("bin") + 1) * step).alias("hi"),
                       F.coalesce(cell["n"], F.lit(0)).cast("long").alias("n"), cell["acc"].alias("acc"), cell["conf"].alias("conf"))


def calibration_error(diagram: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error from the diagram rows."""
    gap = F.sum(F.abs(F.col("acc") - F.col("conf")) * F.col("n"))
    return diagram.groupBy(*keys).agg(F.sum("n").alias("n"), (gap / F.sum("n")).alias("ece"))


def hard_negative_report(tracks: DataFrame, alerts: DataFrame, *, key: str = "slice", bins: int = 10, cfg: AlertConfig = AlertConfig()) -> DataFrame:
    """Per slice: fired alerts, confirmed rows, pass and the calibration of "would not alert"."""
    fired = alerts.where("fired").groupBy(key).agg(F.count(F.lit(1)).alias("n_alerts_fired"))
    conf = tracks.groupBy(key).agg(F.count_if(F.col("lifecycle_state").isin(V.CONFIRMED_STATES)).alias("n_confirmed_rows"))
    quiet = tracks.withColumn("_quiet", F.when(F.col("alert_score") < cfg.score_threshold, 1).otherwise(0))
    ece = calibration_error(reliability_diagram(quiet, keys=[key], conf="effective_confidence", correct="_quiet", bins=bins), keys=[key])
    out = conf.join(fired, key, "left").join(ece, key, "left")
    return out.select(key, F.coalesce("n_alerts_fired", F.lit(0)).alias("n_alerts_fired"), "n_confirmed_rows",
                      (F.coalesce("n_alerts_fired", F.lit(0)) == 0).alias("pass"), F.col("n").alias("n_scored"), "ece")


def hard_negative_summary(report: DataFrame) -> DataFrame:
    return report.agg(F.sum("n_alerts_fired").alias("n_alerts_fired"), F.sum("n_confirmed_rows").alias("n_confirmed_rows"),
                      F.bool_and("pass").alias("pass"))


# --- evaluation against ground truth ------------------------------------------------------------------

def gt_direction(x: Column, semantic: Column, half_width: float = 0.85) -> Column:
    side = F.when(F.abs(x) <= half_width * 0.72, "CENTER_FRONT").when(x < 0, "LEFT_FRONT").otherwise("RIGHT_FRONT")
    return F.when(semantic == "speed_bump", "CENTER_FRONT").otherwise(side)


def action_zone_hits(gt: DataFrame, confirmed: DataFrame, *, key: str = "slice") -> DataFrame:
    """Objects seen 5-15 m away that were confirmed; all confirmed ones count when the zone is empty."""
    zone = gt.where(F.col("distance_m").between(5.0, 15.0)).select(key, "id").distinct()
    conf = confirmed.select(key, "id").distinct()
    in_zone = zone.intersect(conf).groupBy(key).agg(F.count(F.lit(1)).alias("_h"))
    n_zone = zone.groupBy(key).agg(F.count(F.lit(1)).alias("_z"))
    n_conf = conf.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    out = gt.select(key).distinct().join(n_zone, key, "left").join(n_conf, key, "left").join(in_zone, key, "left")
    z = F.coalesce("_z", F.lit(0))
    return out.select(key, F.when(z > 0, F.coalesce("_h", F.lit(0))).otherwise(F.coalesce("_c", F.lit(0))).alias("action_zone_hits"),
                      z.alias("action_zone_n"))


def false_solids(tracks: DataFrame, matches: DataFrame, *, keys: Sequence[str] = ("slice", "track_id")) -> DataFrame:
    """Confirmed tracks that never matched an object."""
    conf = tracks.where(F.col("lifecycle_state").isin(V.CONFIRMED_STATES)).select(*keys).distinct()
    return conf.join(matches.select(*keys).distinct(), list(keys), "left_anti")


def golden_metrics(gt: DataFrame, tracks: DataFrame, matches: DataFrame, switches: DataFrame, *, alerts: DataFrame | None = None,
                   blur_frames: DataFrame | None = None, key: str = "slice", frame: str = "frame", fps: float = 30.0,
                   half_width: float = 0.85) -> DataFrame:
    """Metrics per slice from ground truth, tracks and their matches.

    `matches` carries both sides: id, gt distance `gt_distance_m`, `x_m`, `semantic`, and the track's
    lifecycle_state, distance_m, distance_valid, direction and track_id.
    """
    rows = tracks.groupBy(key).agg(
        F.count_if(F.col("lifecycle_state") == "CONFIRMED").alias("confirmed"),
        F.count_if(F.col("lifecycle_state") == "CANDIDATE").alias("candidates"))
    frames = gt.select(key, frame).union(tracks.select(key, frame)).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("frames"))
    solid = matches.where(F.col("lifecycle_state").isin("CONFIRMED", "ALERTED", "TRACKED"))
    want = gt_direction(F.col("x_m"), F.col("semantic"), half_width)
    right = (F.col("direction") == want) | ((want == "CENTER_FRONT") & (F.col("direction") == "ACROSS"))
    err = F.when(F.col("distance_m").isNotNull() & F.col("distance_valid"), F.abs(F.col("distance_m") - F.col("gt_distance_m")))
    m = solid.groupBy(key).agg(F.count(F.lit(1)).alias("direction_total"), F.count_if(right).alias("direction_correct"),
                               F.avg(err).alias("distance_mae_m"))
    conf = matches.where(F.col("lifecycle_state").isin(V.CONFIRMED_STATES))
    first = conf.groupBy(key, "id").agg(F.min_by("gt_distance_m", frame).alias("first_confirm_distance_m"))
    med = rank_quantiles(first, [key], "first_confirm_distance_m", {"first_confirm_median_m": ("linear", 0.5)}, count_name="n_first_confirm")
    sw = switches.groupBy(key).agg(F.sum("switches").alias("id_switches_est"))
    fs = false_solids(tracks, matches, keys=(key, "track_id")).groupBy(key).agg(F.count(F.lit(1)).alias("false_solid_count"))
    out = frames.join(rows, key, "left").join(m, key, "left").join(med, key, "left").join(sw, key, "left").join(fs, key, "left")
    out = out.join(action_zone_hits(gt, conf, key=key), key, "left")
    if alerts is not None:
        out = out.join(alerts.where("fired").groupBy(key).agg(F.count(F.lit(1)).alias("alerts")), key, "left")
    else:
        out = out.withColumn("alerts", F.lit(0))
    if blur_frames is not None:
        b = tracks.join(blur_frames.select(key, frame).distinct(), [key, frame], "left_semi").where(
            (F.col("lifecycle_state") == "CONFIRMED") & (F.col("temporal_confidence") < 0.25))
        out = out.join(b.groupBy(key).agg(F.count(F.lit(1)).alias("blur_new_confirmed")), key, "left")
    else:
        out = out.withColumn("blur_new_confirmed", F.lit(0))
    for c in ("confirmed", "candidates", "alerts", "id_switches_est", "direction_total", "direction_correct", "n_first_confirm",
              "false_solid_count", "action_zone_hits", "action_zone_n", "blur_new_confirmed"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    minutes = F.greatest(F.col("frames") / max(fps, 1.0) / 60.0, F.lit(1e-6))
    return (out.withColumn("direction_accuracy", share(F.col("direction_correct"), F.col("direction_total")))
            .withColumn("action_zone_recall", share(F.col("action_zone_hits"), F.col("action_zone_n")))
            .withColumn("false_solid_per_min", F.when(F.col("frames") > 0, F.col("false_solid_count") / minutes)))


def acceptance_gates(metrics: DataFrame, *, overlay_ok: Column | None = None) -> DataFrame:
    """Release gates on the metrics rows."""
    direction = F.coalesce(F.col("direction_accuracy") >= 0.95, F.lit(False))
    mae = F.coalesce(F.col("distance_mae_m") <= 2.5, F.lit(False))
    over = F.lit(True) if overlay_ok is None else overlay_ok
    return (metrics.withColumn("direction_ge_95", direction).withColumn("distance_mae_5_15_le_2_5", mae)
            .withColumn("has_first_confirm", F.col("n_first_confirm") > 0).withColumn("overlay_ok", over)
            .withColumn("pass", direction & mae & over))


def run_summary(tracks: DataFrame, frames: DataFrame, alerts: DataFrame, *, key: str = "session_id",
                order: Sequence[str] = ("timestamp_ns", "seq", "price"), fps: float = 30.0) -> DataFrame:
    """One row per run: frame, track and alert totals, what was confirmed and how far away it was first.

    Distinct tracks are counted on one row per (run, track), so no set is gathered.
    """
    order = list(order)
    conf = F.col("lifecycle_state").isin(V.CONFIRMED_STATES)
    ranged = F.col("distance_m").isNotNull() & F.col("distance_valid")
    per_track = tracks.groupBy(key, "track_id").agg(
        F.count_if(conf).alias("_rows"),
        F.min(F.when(conf, F.struct(*order, "semantic_type"))).alias("_first"),
        F.min(F.when(conf & ranged, F.struct(*order, "distance_m"))).alias("_dist"),
        F.bool_or(conf & (F.col("direction") != "UNKNOWN")).alias("_dir"))
    t = per_track.withColumn("_sem", F.col("_first.semantic_type")).withColumn("_d", F.col("_dist.distance_m"))
    is_conf = F.col("_rows") > 0
    agg = t.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_unique_tracks"), F.count_if(is_conf).alias("n_confirmed_tracks"), F.sum("_rows").alias("n_confirmed_rows"),
        F.count_if(F.col("_sem") == "rough_broken").alias("n_rough_broken_confirmed"),
        F.count_if(F.col("_sem").isin(V.INFO_LAYER)).alias("n_info_confirmed"),
        F.count_if(F.col("_sem").isin(V.BUMP_SEMANTICS)).alias("n_bump_confirmed"),
        F.count_if(F.col("_sem") == "unknown_anomaly").alias("n_unknown_confirmed"),
        F.count("_d").alias("n_confirmed_with_distance"), F.count_if("_dir").alias("n_confirmed_with_direction"))
    sem = t.where(is_conf).groupBy(key, F.coalesce("_sem", F.lit("missing")).alias("_sem")).agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("_sem", "n")))).alias("confirmed_semantics"))
    med = rank_quantiles(t, [key], "_d", {"first_confirm_median_m": ("linear", 0.5)}, count_name="_nd").drop("_nd")
    fr = frames.groupBy(key).agg(
        F.count(F.lit(1)).alias("frames"), F.avg("blur").alias("mean_blur"), F.avg("glare").alias("mean_glare"), F.avg("luma").alias("mean_luma"),
        F.avg(F.col("has_road").cast("double")).alias("road_frame_share"), F.avg(F.col("has_occlusion").cast("double")).alias("occlusion_frame_share"))
    al = alerts.where("fired").groupBy(key).agg(F.count(F.lit(1)).alias("n_alerts_fired"))
    out = fr.join(agg, key, "left").join(sem, key, "left").join(med, key, "left").join(al, key, "left")
    for c in ("n_unique_tracks", "n_confirmed_tracks", "n_confirmed_rows", "n_rough_broken_confirmed", "n_info_confirmed", "n_bump_confirmed",
              "n_unknown_confirmed", "n_confirmed_with_distance", "n_confirmed_with_direction", "n_alerts_fired"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    secs = F.col("frames") / fps
    return (out.withColumn("n_unconfirmed_tracks", F.col("n_unique_tracks") - F.col("n_confirmed_tracks"))
            .withColumn("duration_s", secs).withColumn("confirmed_per_min", F.col("n_confirmed_tracks") / secs * 60.0)
            .withColumn("lighting", F.when(F.col("mean_luma") < 105, "night").otherwise("day")))


def field_gates(runs: DataFrame) -> DataFrame:
    """Day and night rule sets per clip: a map of the checks that apply and their conjunction."""
    night, day = F.col("alias") == "night_25013", F.col("alias") == "day_25007"
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in
         ("frames", "n_confirmed_tracks", "n_alerts_fired", "n_rough_broken_confirmed", "n_info_confirmed", "n_bump_confirmed")}
    solid = F.greatest(n["n_confirmed_tracks"] - n["n_info_confirmed"] - n["n_bump_confirmed"], F.lit(0))
    calm = n["n_rough_broken_confirmed"] == 0
    checks = F.create_map(
        F.lit("overlay_ok"), F.coalesce("overlay_ok", F.lit(False)),
        F.lit("has_frames"), n["frames"] > 0,
        F.lit("night_no_solid_damage"), F.when(night, (solid == 0) & calm),
        F.lit("night_no_rough_broken"), F.when(night, calm),
        F.lit("night_no_alerts"), F.when(night & (n["n_bump_confirmed"] == 0), n["n_alerts_fired"] == 0),
        F.lit("day_road_polygon"), F.when(day, F.coalesce("road_frame_share", F.lit(0.0)) >= 0.05))
    live = F.map_filter(checks, lambda _, v: v.isNotNull())
    limit = F.when(night, 1.0).when(day, 0.5)
    return (runs.withColumn("checks", live).withColumn("n_solid_confirmed", solid.cast("long"))
            .withColumn("pass", F.forall(F.map_values("checks"), lambda v: v)).withColumn("spec_solid_fp_per_min", limit))


def field_report(gates: DataFrame) -> DataFrame:
    named = gates.where(F.coalesce("alias", F.lit("")) != "")
    return named.agg(F.count(F.lit(1)).alias("n_clips"), F.coalesce(F.bool_and("pass"), F.lit(False)).alias("pass"))


def segmentation_scores(pixels: DataFrame, *, keys: Sequence[str] = ("slice",), pred: str = "pred", gt: str = "gt", n_classes: int = 4) -> DataFrame:
    """Pixel accuracy and per-class intersection over union (0 where a class is in neither)."""
    p, g = F.col(pred), F.col(gt)
    aggs = [F.count(F.lit(1)).alias("n_pixels"), F.avg((p == g).cast("double")).alias("pixel_acc")]
    for k in range(n_classes):
        inter, union = F.count_if((p == k) & (g == k)), F.count_if((p == k) | (g == k))
        aggs.append(F.when(union > 0, inter / union).otherwise(0.0).alias(f"iou_{k}"))
    return pixels.groupBy(*keys).agg(*aggs)
