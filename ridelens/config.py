"""Operator parameters. Plain frozen dataclasses: every threshold an operator uses lives here."""

from __future__ import annotations

from dataclasses import dataclass, field


# Default thresholds of the published operator contract.
@dataclass(frozen=True)
class QualityConfig:
    laplacian_usable: float = 18.0
    sharpness_scale: float = 80.0
    motion_blur_block: float = 0.62
    glare_block: float = 0.45
    underexposure_block: float = 0.72
    overexposure_block: float = 0.55
    min_road_visible: float = 0.18
    occluded_block: float = 0.45
    lens_drop_blob_min: int = 12
    max_selected_age_ns: int = 100_000_000
    buffer_ns: int = 500_000_000
    bad_streak_s: float = 0.45
    first_frame_dt_s: float = 1.0 / 60.0
    min_dt_s: float = 1e-3
    occlusion_block: float = 0.40


@dataclass(frozen=True)
class TrackingConfig:
    confirm_window_s: float = 0.40
    min_confirm_hits: int = 3
    candidate_max_age_s: float = 0.35
    low_quality_hold_s: float = 0.45
    iou_match: float = 0.25
    center_match_px: float = 80.0
    process_noise: float = 18.0
    meas_noise: float = 6.0
    unknown_anomaly_extra_hits: int = 2
    rough_extra_hits: int = 3
    bump_confirm_hits: int = 2
    bump_tracked_age_s: float = 0.08
    bump_confirm_age_s: float = 0.12
    lost_slack_s: float = 0.25
    expired_memory_s: float = 30.0  # own choice: a timed-out candidate can be matched again for so long


@dataclass(frozen=True)
class GeometryConfig:
    corridor_half_width_m: float = 0.85
    across_min_width_m: float = 1.6
    near_boundary_m: float = 2.2
    min_speed_for_ttc_mps: float = 2.0
    pitch_health_deg: float = 8.0
    roll_health_deg: float = 10.0
    horizon_tolerance_px: float = 48.0


@dataclass(frozen=True)
class AlertConfig:
    enabled: bool = True
    score_threshold: float = 0.62
    bump_score_threshold: float = 0.08
    global_cooldown_s: float = 2.2
    class_cooldown_s: float = 4.0
    min_severity: int = 2
    min_path_relevance: float = 0.45
    min_visibility: float = 0.40
    min_effective: float = 0.48
    realert_severity_jump: int = 1
    pause_on_degraded: bool = True
    bump_model_floor: float = 0.08


@dataclass(frozen=True)
class RuntimeConfig:
    infer_fps: float = 12.0
    thermal_min_infer_fps: float = 8.0


@dataclass(frozen=True)
class ImpactConfig:
    gravity: float = 9.81
    residual_threshold: float = 40.0
    gyro_threshold: float = 15.0
    min_speed_mps: float = 2.0
    near_m: float = 6.0
    spike_ms2: float = 3.5
    full_scale_ms2: float = 12.0
    horizon_s: float = 3.0
    horizon_slack_s: float = 0.75
    pass_half_window_s: float = 0.40


@dataclass(frozen=True)
class EngineConfig:
    quality: QualityConfig = field(default_factory=QualityConfig)
    tracking: TrackingConfig = field(default_factory=TrackingConfig)
    geometry: GeometryConfig = field(default_factory=GeometryConfig)
    alert: AlertConfig = field(default_factory=AlertConfig)
    runtime: RuntimeConfig = field(default_factory=RuntimeConfig)
    impact: ImpactConfig = field(default_factory=ImpactConfig)
