"""Scores and decision tables shared by batch operators and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridelens.config import AlertConfig, ImpactConfig, QualityConfig, RuntimeConfig
from ridelens.functions import vocab as V


def first_true(rules: list[tuple[Column, str]], otherwise: Column | None = None) -> Column:
    """Name of the first rule that holds."""
    head, *rest = rules
    chain = reduce(lambda acc, r: acc.when(r[0], F.lit(r[1])), rest, F.when(head[0], F.lit(head[1])))
    return chain if otherwise is None else chain.otherwise(otherwise)


def visual_score(*parts: Column) -> Column:
    zero = F.lit(0.0)
    return reduce(lambda a, b: a * b, [F.greatest(zero, p) for p in parts])


def urgency(ttc: Column) -> Column:
    return (F.when(ttc.isNull(), 0.35).when(ttc <= 0.8, 1.0).when(ttc <= 1.6, 0.85)
            .when(ttc <= 2.8, 0.6).otherwise(0.25))


def severity_weight(severity: Column, geometry: Column, state: Column) -> Column:
    calm = F.coalesce(state == "normal", F.lit(False)) | F.coalesce(geometry == "flat", F.lit(False))
    return (F.when(calm, 0.02).when(severity == 0, 0.05).when(severity == 1, 0.28)
            .when(severity == 2, 0.7).when(severity == 3, 1.0).otherwise(0.22))


def risk_weight(severity: Column) -> Column:
    return (F.when(severity == 0, 0.05).when(severity == 1, 0.3).when(severity == 2, 0.7)
            .when(severity == 3, 1.0).otherwise(0.22))


def alert_factors(c=F.col) -> dict[str, Column]:
    """Factors of the alert score; needs the `bump_hazard` column."""
    raw = urgency(c("ttc_s"))
    return {
        "visual_score": visual_score(c("model_confidence"), c("visibility_confidence"),
                                     c("temporal_confidence"), c("geometry_consistency")),
        "severity_score": severity_weight(c("severity"), c("geometry_type"), c("object_state")),
        "urgency": F.when(c("bump_hazard"), F.greatest(raw, F.lit(0.65))).otherwise(raw),
    }


def alert_totals(cfg: AlertConfig, c=F.col) -> dict[str, Column]:
    """Score and threshold from the factor columns."""
    damp = F.when(c("semantic_type") == "unknown_anomaly", 0.55).otherwise(1.0)
    base = c("visual_score") * c("severity_score") * c("path_relevance") * c("urgency") * damp
    floor = F.when(c("bump_hazard"), c("model_confidence") * c("path_relevance")).otherwise(0.0)
    return {
        "alert_score": F.when(c("bump_hazard"), F.greatest(base, floor)).otherwise(base),
        "threshold": F.when(c("bump_hazard"), F.lit(cfg.bump_score_threshold)).otherwise(F.lit(cfg.score_threshold)),
    }


def gate_reason(cfg: AlertConfig, c=F.col) -> Column:
    """First stateless gate a scored track row fails, null when it passes them all."""
    bump = c("bump_hazard")
    sem, geo, state = c("semantic_type"), c("geometry_type"), c("object_state")
    status = c("status")
    pause = F.lit(cfg.pause_on_degraded)
    return first_true([
        (F.lit(not cfg.enabled), "alerts_disabled"),
        (~c("lifecycle_state").isin(V.CONFIRMED_STATES), "not_confirmed"),
        (pause & status.isin(V.PAUSE_STATUSES), "quality_pause"),
        (pause & (status == "OCCLUDED") & ~bump, "quality_pause"),
        (~c("geometry_valid"), "geometry_invalid"),
        (sem.isin(V.INFO_LAYER), "info_layer"),
        (sem.isin(V.LOW_RISK_WHEN_NORMAL) & ((state == "normal") | (geo == "flat")), "normal_or_flat"),
        ((c("severity") >= 0) & (c("severity") < cfg.min_severity), "severity_too_low"),
        ((c("visibility_confidence") < cfg.min_visibility) & ~bump, "visibility_gate"),
        ((c("effective_confidence") < cfg.min_effective)
         & ~(bump & (c("model_confidence") >= cfg.bump_model_floor)), "effective_gate"),
        (c("path_relevance") < cfg.min_path_relevance, "off_corridor"),
        (c("direction") == "UNKNOWN", "direction_unknown"),
        (c("alert_score") < c("threshold"), "below_threshold"),
    ])


def phrase(c=F.col) -> Column:
    """Spoken text: heading word plus kind word; the generic kind when severity is unknown."""
    sem, geo, state = c("semantic_type"), c("geometry_type"), c("object_state")
    heading = V.lookup(V.DIRECTION_WORDS, c("direction"), V.DEFAULT_HEADING)
    sunken = (sem == "manhole_cover") & (geo == "concave") & (state == "abnormal")
    kind = (F.when(c("severity") == -1, V.GENERIC_WORD)
            .when(sunken, V.SUNKEN_COVER_WORD)
            .otherwise(V.lookup(V.SEMANTIC_WORDS, sem, V.GENERIC_WORD)))
    return F.concat(heading, kind)


# --- impacts ---------------------------------------------------------------------------------

def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def linear_residual(x: Column, y: Column, z: Column, cfg: ImpactConfig) -> Column:
    return F.abs(magnitude(x, y, z) - F.lit(cfg.gravity))


def severe_impact(x: Column, y: Column, z: Column, gyro: Column, cfg: ImpactConfig) -> Column:
    return (linear_residual(x, y, z, cfg) >= cfg.residual_threshold) | (F.abs(gyro) >= cfg.gyro_threshold)


def vertical_residual(z: Column, cfg: ImpactConfig) -> Column:
    return F.abs(z - F.lit(cfg.gravity))


def impact_score(z: Column, speed: Column, distance: Column, cfg: ImpactConfig) -> Column:
    az = vertical_residual(z, cfg)
    hit = (speed >= cfg.min_speed_mps) & (distance <= cfg.near_m) & (az >= cfg.spike_ms2)
    return F.when(hit, F.least(F.lit(1.0), az / F.lit(cfg.full_scale_ms2)))


def impact_label(peak: Column, speed: Column) -> Column:
    adj = peak / F.greatest(speed / 10.0, F.lit(0.35))
    return F.when(adj < 2.0, "none").when(adj < 4.0, "weak").when(adj < 7.0, "medium").otherwise("strong")


# --- quality -----------------------------------------------------------------------------------

def frame_usable(cfg: QualityConfig, c=F.col) -> Column:
    return (
        (c("laplacian") >= cfg.laplacian_usable) & (c("motion_blur") < cfg.motion_blur_block)
        & (c("glare") < cfg.glare_block) & (c("underexposure") < cfg.underexposure_block)
        & (c("overexposure") < cfg.overexposure_block) & (c("road_visible_ratio") >= cfg.min_road_visible)
        & (c("lens_drops") < cfg.lens_drop_blob_min)
    )


def visibility_class(cfg: QualityConfig, c=F.col, *, strict_python: bool = False) -> Column:
    """`strict_python` compares the 0..1 sharpness with the raw-variance threshold, which marks every
    frame that is neither occluded nor glaring as blurred."""
    sharp = F.least(F.greatest(c("laplacian") / cfg.sharpness_scale, F.lit(0.0)), F.lit(1.0))
    measure = sharp if strict_python else sharp * cfg.sharpness_scale
    return first_true([
        (c("lens_drops") >= cfg.lens_drop_blob_min, "lens_drop"),
        (c("occluded_ratio") > cfg.occluded_block, "occluded"),
        (c("glare") >= cfg.glare_block, "glare"),
        ((c("motion_blur") >= cfg.motion_blur_block) | (measure < cfg.laplacian_usable), "blur"),
        (c("underexposure") >= cfg.underexposure_block, "underexposed"),
        (c("overexposure") >= cfg.overexposure_block, "overexposed"),
        (c("road_visible_ratio") < cfg.min_road_visible, "unknown"),
    ], F.lit("clear"))


def perception_status(cfg: QualityConfig, visibility: Column, usable: Column, occluded: Column,
                      bad_streak_s: Column) -> Column:
    return first_true([
        (visibility == "lens_drop", "LENS_CONTAMINATION"),
        ((visibility == "occluded") | (occluded > 0.5), "OCCLUDED"),
        (bad_streak_s > cfg.bad_streak_s, "PERCEPTION_LIMITED"),
        (~usable & (visibility == "blur"), "SEVERE_BLUR"),
        (visibility.isin("glare", "underexposed", "overexposed"), "DEGRADED_VISIBILITY"),
        (~usable, "DEGRADED_VISIBILITY"),
    ], F.lit("NORMAL"))


def thermal_reason(temp: Column) -> Column:
    return (F.when(temp.isNull() | (temp < 42.0), F.lit(None).cast("string"))
            .when(temp >= 45.0, "THERMAL_DROP_INFER_HZ").when(temp >= 43.0, "THERMAL_DROP_FAR_ROI")
            .otherwise("THERMAL_DROP_INFER_HZ"))


def infer_period_ns(temp: Column, cfg: RuntimeConfig) -> Column:
    base = int(1e9 / max(cfg.infer_fps, 1.0))
    floor = int(1e9 / max(cfg.thermal_min_infer_fps, 1.0))
    slow = int(1e9 / max(max(cfg.thermal_min_infer_fps, cfg.infer_fps * 0.7), 1.0))
    return (F.when(temp.isNull() | (temp < 42.0), F.lit(base)).when(temp >= 45.0, F.lit(floor))
            .when(temp >= 43.0, F.lit(base)).otherwise(F.lit(slow))).cast("long")
