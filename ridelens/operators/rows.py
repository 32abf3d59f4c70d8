"""Row-level jobs: every one is a projection or filter over a whole fleet table, without a shuffle
(the small per-reason counts aside)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens.config import AlertConfig, GeometryConfig, ImpactConfig, QualityConfig, RuntimeConfig, TrackingConfig
from ridelens.functions import camera, redaction, scoring, shapes
from ridelens.functions import vocab as V
from ridelens.plans.ordered import chunk_width, running_sums, with_previous


# --- impacts ---------------------------------------------------------------------------------

def flag_impacts(imu: DataFrame, *, gyro: str | None = None, cfg: ImpactConfig = ImpactConfig()) -> DataFrame:
    """Magnitude, residual against gravity and the severe flag of each accelerometer row."""
    x, y, z = (F.coalesce(F.col(c), F.lit(0.0)) for c in "xyz")
    g = F.coalesce(F.col(gyro), F.lit(0.0)) if gyro else F.lit(0.0)
    return (imu.withColumn("magnitude", scoring.magnitude(x, y, z))
            .withColumn("residual", scoring.linear_residual(x, y, z, cfg))
            .withColumn("severe", scoring.severe_impact(x, y, z, g, cfg)))


def score_impacts(tracks: DataFrame, *, accel_z: str = "accel_z", speed: str = "own_speed_mps",
                  distance: str = "distance_m", cfg: ImpactConfig = ImpactConfig()) -> DataFrame:
    """0..1 score when a vertical spike meets a near object at speed, plus the speed-scaled label."""
    z, v = F.col(accel_z), F.col(speed)
    return tracks.withColumn("impact_score", scoring.impact_score(z, v, F.col(distance), cfg)).withColumn(
        "impact_label", scoring.impact_label(scoring.vertical_residual(z, cfg), F.coalesce(v, F.lit(0.0))))


# --- alerts ----------------------------------------------------------------------------------

def score_alerts(tracks: DataFrame, cfg: AlertConfig = AlertConfig()) -> DataFrame:
    """Score, its factors and the threshold that applies to each track row."""
    # staged, so that no expression contains another one several times
    out = tracks.withColumn("bump_hazard", V.is_bump_hazard(F.col("semantic_type"), F.col("geometry_type"), F.col("object_state")))
    out = out.withColumns(scoring.alert_factors())
    return out.withColumns(scoring.alert_totals(cfg))


def gate_alerts(tracks: DataFrame, cfg: AlertConfig = AlertConfig()) -> DataFrame:
    """`gate_reason`: the first stateless gate the row fails, null when it passes all."""
    base = tracks if {"bump_hazard", "alert_score", "threshold"} <= set(tracks.columns) else score_alerts(tracks, cfg)
    out = base.withColumn("gate_reason", scoring.gate_reason(cfg))
    return out if base is tracks else out.select(*tracks.columns, "gate_reason")


def rows_where(df: DataFrame, condition: Column, *cols: str | Column) -> DataFrame:
    """`df.where(condition).select(cols)` for a condition on derived columns.

    A plain filter is pushed below the projections, which copies the whole derivation into the
    predicate and evaluates it twice; a generator keeps it where the columns already are.
    """
    row = F.struct(*cols)
    return df.select(F.inline(F.when(condition, F.array(row))))


def gate_reason_counts(tracks: DataFrame, cfg: AlertConfig = AlertConfig()) -> DataFrame:
    return (gate_alerts(tracks, cfg).groupBy(F.coalesce("gate_reason", F.lit("passed")).alias("reason"))
            .agg(F.count(F.lit(1)).alias("n_rows")))


def audit_phrases(alerts: DataFrame, *, text: str = "phrase") -> DataFrame:
    """Fired alerts whose text gives steering or braking advice or is not the composed phrase."""
    forbidden = F.array(*[F.lit(p) for p in V.FORBIDDEN_PHRASES])
    bad = F.exists(forbidden, lambda p: F.contains(F.col(text), p))
    return (alerts.withColumn("expected_phrase", scoring.phrase())
            .withColumn("has_forbidden", F.coalesce(bad, F.lit(False)))
            .withColumn("differs", ~F.col(text).eqNullSafe(F.col("expected_phrase")))
            .where(F.col("fired") & (F.col("has_forbidden") | F.col("differs"))))


# --- frame quality ---------------------------------------------------------------------------

def classify_frames(frames: DataFrame, cfg: QualityConfig = QualityConfig(), *, strict_python: bool = False) -> DataFrame:
    """`usable` and `visibility_class` of each frame."""
    return frames.withColumn("usable", scoring.frame_usable(cfg)).withColumn(
        "visibility_class", scoring.visibility_class(cfg, strict_python=strict_python))


def classify_tiles(tiles: DataFrame, *, luma: str = "mean_luma", laplacian: str = "laplacian") -> DataFrame:
    """Class and score of each quality tile from its mean luma (0..1) and Laplacian variance."""
    score = F.least(F.greatest(F.col(laplacian) / 60.0, F.lit(0.0)), F.lit(1.0))
    dark, bright, soft = F.col(luma) < 0.12, F.col(luma) > 0.9, F.col(laplacian) < 8
    return tiles.withColumn("visibility", F.when(dark, "underexposed").when(bright, "overexposed")
                            .when(soft, "blur").otherwise("clear")).withColumn(
        "score", F.when(dark | bright, F.least(score, F.lit(0.25))).when(soft, F.least(score, F.lit(0.3))).otherwise(score))


def bad_streak(frames: DataFrame, *, keys: Sequence[str] = ("session_id",), ts: str = "sensor_timestamp_ns",
               tie: Sequence[str] = ("event_id",), usable: str = "usable", cfg: QualityConfig = QualityConfig(),
               chunk: float | None = None) -> DataFrame:
    """Seconds of unusable frames since the last usable one.

    Running total of the steps minus its value at the last usable frame; both are running sums, so
    the result does not need a session in one place.
    """
    keys, order = list(keys), [ts, *tie]
    chunk = chunk or chunk_width(ts)
    prev = with_previous(frames, keys, order, [ts], chunk=chunk)
    dt = F.when(F.col(f"prev_{ts}").isNull(), F.lit(cfg.first_frame_dt_s)).otherwise(
        F.greatest(F.lit(cfg.min_dt_s), (F.col(ts) - F.col(f"prev_{ts}")) / 1e9))
    runs = running_sums(prev.withColumn("_dt", dt), keys, order, {
        "_island": F.col(usable).cast("long")}, chunk=chunk)
    bad = F.when(F.col(usable), 0.0).otherwise(F.col("_dt"))
    out = running_sums(runs, [*keys, "_island"], order, {"bad_streak_s": bad}, chunk=chunk)
    return out.select(*frames.columns, "bad_streak_s")


def frame_status(frames: DataFrame, *, keys: Sequence[str] = ("session_id",), ts: str = "sensor_timestamp_ns",
                 tie: Sequence[str] = ("event_id",), cfg: QualityConfig = QualityConfig(),
                 runtime: RuntimeConfig = RuntimeConfig(), chunk: float | None = None) -> DataFrame:
    """Perception status and thermal policy of each frame (needs visibility_class, usable, thermal_c)."""
    streak = bad_streak(frames, keys=keys, ts=ts, tie=tie, cfg=cfg, chunk=chunk)
    return status_columns(streak, cfg, runtime)


def status_columns(frames: DataFrame, cfg: QualityConfig = QualityConfig(), runtime: RuntimeConfig = RuntimeConfig()) -> DataFrame:
    base = scoring.perception_status(cfg, F.col("visibility_class"), F.col("usable"), F.col("occluded_ratio"),
                                     F.col("bad_streak_s"))
    temp = F.col("thermal_c")
    hot = F.coalesce(temp >= 42.0, F.lit(False))
    return (frames.withColumn("status", F.when(hot & (base == "NORMAL"), "THERMAL_THROTTLE").otherwise(base))
            .withColumn("thermal_reason", scoring.thermal_reason(temp))
            .withColumn("skip_far_roi", F.coalesce(temp >= 43.0, F.lit(False)))
            .withColumn("infer_period_ns", scoring.infer_period_ns(temp, runtime)))


def admission_gate(frames: DataFrame, *, polygons: str = "occluded_polygons", cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """Occluded share of the frame and whether new tracks may start."""
    ratio = shapes.cover_ratio(F.col(polygons), F.col("width"), F.col("height"))
    ok = F.col("fresh") & F.col("usable") & (F.col("occlusion_ratio") < cfg.occlusion_block) & ~F.col("status").isin(V.PAUSE_STATUSES)
    return frames.withColumn("occlusion_ratio", ratio).withColumn("allow_new", ok)


# --- geometry --------------------------------------------------------------------------------

def localize_tracks(tracks: DataFrame, mounts: DataFrame, *, key: str = "profile_id", contact: tuple[str, str] = ("contact_x", "contact_y"),
                    quality: str = "quality_at_mask") -> DataFrame:
    """Road position, distance and its confidence from the ground-contact pixel of each track.

    How the mount profiles are joined is left to Spark: it broadcasts them where their size allows, and
    else splits a hot profile in the adaptive skew join.
    """
    cols = ["camera_height_m", "lateral_offset_m", "fx", "fy", "cx", "cy", "valid", "_rot"]
    dim = camera.with_rotation(mounts).select(key, *cols)
    joined = tracks.join(dim, key, "left")
    u, v = (F.col(c) for c in contact)
    point = F.when(F.coalesce(F.col("valid"), F.lit(False)), camera.ground_point(u, v, camera.mount_columns(), max_y=80.0))
    out = joined.withColumn("_g", point).withColumn("road_x", F.col("_g.x")).withColumn("road_y", F.col("_g.y"))
    dist = F.when(F.col("road_y").isNotNull(), F.greatest(F.lit(0.5), F.col("road_y")))
    conf = F.when(dist > 30, 0.45).when(dist > 20, 0.62).otherwise(0.82) * F.when(F.col(quality) < 0.4, 0.7).otherwise(1.0)
    return (out.withColumn("distance_m", dist)
            .withColumn("distance_confidence", F.when(dist.isNotNull(), conf).otherwise(0.0))
            .withColumn("distance_valid", dist.isNotNull())
            .drop("_g", *cols))


def display_distance(dist: Column, valid: Column, confidence: Column) -> Column:
    near = F.concat(F.rint(dist).cast("long").cast("string"), F.lit(" m"))
    mid = F.concat(F.lit("约 "), (F.rint(dist / 2.0) * 2).cast("long").cast("string"), F.lit(" m"))
    far = F.concat(F.lit("约 "), F.rint(dist).cast("long").cast("string"), F.lit(" m"))
    shown = F.when(dist < 10, near).when(dist <= 30, mid).when(confidence < 0.5, F.lit("远处")).otherwise(far)
    return F.when(valid & dist.isNotNull(), shown)


def assign_corridor(tracks: DataFrame, *, cfg: GeometryConfig = GeometryConfig()) -> DataFrame:
    """Direction, corridor relevance, distance band and display text from the road position."""
    x, y, hw = F.col("road_x"), F.col("road_y"), cfg.corridor_half_width_m
    direction = (F.when(x.isNull(), "UNKNOWN")
                 .when((F.col("width_m") >= cfg.across_min_width_m) & (F.abs(x) < hw), "ACROSS")
                 .when(F.abs(x) <= hw * 0.72, "CENTER_FRONT").when(x < 0, "LEFT_FRONT").otherwise("RIGHT_FRONT"))
    k = x / (hw * 1.15)
    along = F.least(F.greatest((40.0 - y) / 40.0, F.lit(0.0)), F.lit(1.0))
    rel = F.least(F.greatest(0.75 * F.exp(-0.5 * k * k) + 0.25 * along, F.lit(0.0)), F.lit(1.0))
    d = F.col("distance_m")
    return (tracks.withColumn("direction", direction)
            .withColumn("path_relevance", F.when(x.isNull(), 0.2).otherwise(rel))
            .withColumn("band", F.when(d.isNull(), "unknown").when(d < 12, "near").when(d < 25, "mid").otherwise("far"))
            .withColumn("display_distance", display_distance(d, F.col("distance_valid"), F.col("distance_confidence"))))


def score_track_confidence(tracks: DataFrame, *, cfg: TrackingConfig = TrackingConfig()) -> DataFrame:
    """Temporal, geometric and effective confidence and the risk of each track row."""
    one = F.lit(1.0)
    stable = F.least(one, F.col("hits") / 6.0) * F.least(one, F.col("age_s") / max(cfg.confirm_window_s, 1e-3))
    temporal = F.least(F.greatest(stable * F.pow(F.lit(0.85), F.col("misses")), F.lit(0.05)), one)
    geom = F.when(F.col("road_x").isNull(), 0.35).otherwise(
        F.least(F.greatest(0.4 + 0.6 * F.col("distance_confidence"), F.lit(0.0)), one))
    vis = F.least(F.greatest(F.col("visibility_confidence"), F.lit(0.0)), one)
    out = tracks.withColumn("temporal_confidence", temporal).withColumn("geometry_consistency", geom)
    out = out.withColumn("effective_confidence", scoring.visual_score(
        F.col("model_confidence"), vis, F.col("temporal_confidence"), F.col("geometry_consistency")))
    return out.withColumn("risk_score", F.col("effective_confidence") * scoring.risk_weight(F.col("severity")) * F.col("path_relevance"))


def mark_passed(tracks: DataFrame, *, keys: Sequence[str] = ("session_id", "track_id"), ts: str = "timestamp_ns",
                tie: Sequence[str] = ("seq", "price"), cfg: GeometryConfig = GeometryConfig(), chunk: float | None = None) -> DataFrame:
    """Whether the object has been ridden past at each row."""
    prev = with_previous(tracks, keys, [ts, *tie], ["distance_m"], chunk=chunk)
    bump = V.is_bump_for_tracking(F.col("semantic_type"), F.col("geometry_type"))
    d, p = F.col("distance_m"), F.col("prev_distance_m")
    rule = (((d < cfg.near_boundary_m) & (F.col("image_vy") > 40)) | ((d > p + 4.0) & (d < 8.0)) | (F.col("road_y") < 1.6))
    blocked = (bump & ~F.col("lifecycle_state").isin(V.CONFIRMED_STATES)) | d.isNull()
    return prev.withColumn("passed", ~blocked & F.coalesce(rule, F.lit(False)))


def mount_health(sessions: DataFrame, mounts: DataFrame, *, key: str = "profile_id", cfg: GeometryConfig = GeometryConfig()) -> DataFrame:
    """Whether the mount geometry may be trusted in each session, with the reason when not."""
    # the expected horizon belongs to the mount, so it is computed on the small side
    _, horizon = camera.project(F.lit(0.0), F.lit(80.0), camera.mount_columns())
    cols = ["_h", "valid"]
    joined = sessions.join(camera.with_rotation(mounts).withColumn("_h", horizon).select(key, *cols), key, "left")
    off = F.coalesce(F.abs(F.col("horizon_y_px") - F.col("_h")) > cfg.horizon_tolerance_px, F.lit(False))
    ok = (F.abs(F.coalesce("pitch_err_deg", F.lit(0.0))) <= cfg.pitch_health_deg) & (
        F.abs(F.coalesce("roll_err_deg", F.lit(0.0))) <= cfg.roll_health_deg) & ~off
    valid = F.coalesce("valid", F.lit(False))
    return (joined.withColumn("_ok", ok)
            .withColumn("geometry_valid", F.col("_ok") & valid)
            .withColumn("invalid_reason", F.when(~F.col("_ok"), "install_health_fail").when(~valid, "no_mount_profile"))
            .withColumn("expected_horizon_y", F.col("_h")).drop("_ok", *cols))


# --- shapes ------------------------------------------------------------------------------------

def measure_polygons(obs: DataFrame, *, poly: str = "polygon") -> DataFrame:
    p = F.col(poly)
    gx, gy = shapes.ground_contact(p)
    mx, my = shapes.centroid(p)
    out = obs.withColumn("_b", shapes.bbox(p))
    for i, n in enumerate(("x0", "y0", "x1", "y1")):
        out = out.withColumn(f"box_{n}", F.col("_b")[i])
    return out.drop("_b").withColumn("area", shapes.area(p)).withColumn("mean_x", mx).withColumn("mean_y", my).withColumn(
        "contact_x", gx).withColumn("contact_y", gy)


def mask_runs(pixels: DataFrame, *, keys: Sequence[str], width: str = "width", height: str = "height", x: str = "x", y: str = "y",
              label: str = "label", chunk: float | None = None) -> DataFrame:
    """Column-major run lengths of a mask given as one row per pixel, starting with the zero run.

    Rows: keys, run index, value (0/1), length. A mask that starts with a set pixel gets a first zero
    run of length 0. Pixel order is x·height + y, so a mask is cut into ranges and never gathered.
    """
    keys = list(keys)
    pos = (F.col(x).cast("long") * F.col(height) + F.col(y)).alias("_pos")
    flat = pixels.select(*keys, pos, F.when(F.col(label) != 0, 1).otherwise(0).alias("value"))
    chunk = chunk or chunk_width("_pos")
    prev = with_previous(flat, keys, ["_pos"], ["value"], chunk=chunk)
    begins = (F.col("value") != F.coalesce("prev_value", F.lit(0))).cast("long")
    runs = running_sums(prev, keys, ["_pos"], {"run": begins}, chunk=chunk)
    sizes = runs.groupBy(*keys, "run").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("length"))
    lead = sizes.where("run = 1").join(sizes.where("run = 0").select(*keys), keys, "left_anti").select(
        *keys, F.lit(0).cast("long").alias("run"), F.lit(0).alias("value"), F.lit(0).cast("long").alias("length"))
    return sizes.select(*keys, "run", "value", "length").unionByName(lead)


def encode_runs(runs: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Run rows to the stored `counts` array (a mask's run list is the stored cell itself)."""
    return runs.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("run", "length"))), lambda r: r["length"]).alias("counts"))


def mask_coverage(obs: DataFrame, *, keys: Sequence[str] = ("frame",), rle: str = "mask_rle") -> DataFrame:
    """Covered pixels per frame and class from stored runs."""
    m = F.col(rle)
    on = shapes.run_cover(m["counts"], m["width"], m["height"])
    return (obs.where(m.isNotNull()).select(*keys, "semantic_type", on.alias("_on"), (m["width"] * m["height"]).cast("long").alias("_n"))
            .groupBy(*keys, "semantic_type").agg(
                F.count(F.lit(1)).alias("n_masks"), F.sum("_on").alias("covered_px"), F.sum("_n").alias("grid_px")))


# --- privacy -----------------------------------------------------------------------------------

def coarsen_locations(loc: DataFrame, decimals: int = 2, min_accuracy_m: float = 150.0) -> DataFrame:
    return (loc.withColumn("latitude", F.bround("latitude", decimals)).withColumn("longitude", F.bround("longitude", decimals))
            .withColumn("horizontal_accuracy_m", F.greatest(F.coalesce("horizontal_accuracy_m", F.lit(0.0)), F.lit(min_accuracy_m)))
            .withColumn("privacy", F.lit("coarsened")))


def redact_events(events: DataFrame, *, keep: Sequence[str] = ()) -> DataFrame:
    """Redact every column by name and type, nested structs, arrays and maps included."""
    return events.select(*[
        F.col(f.name) if f.name in keep else redaction.redact(F.col(f.name), f.dataType, f.name).alias(f.name)
        for f in events.schema.fields])


def redact_json_object(df: DataFrame, column: str) -> DataFrame:
    """Redact a column of JSON object text into a map of its outermost keys; nested values stay JSON text, redacted at any depth."""
    return df.withColumn(column, F.from_json(redaction.redact_json(F.col(column)), T.MapType(T.StringType(), T.StringType())))


def redact_json_text(df: DataFrame, column: str) -> DataFrame:
    """Redact a column of free-form JSON text at any depth; it stays JSON text. Text that is no JSON is treated like a crash log."""
    text = F.col(column)
    return df.withColumn(column, F.coalesce(redaction.redact_json(text), redaction.crash_text(text)))


def redact_text(logs: DataFrame, column: str) -> DataFrame:
    return logs.withColumn(column, redaction.crash_text(F.col(column)))
