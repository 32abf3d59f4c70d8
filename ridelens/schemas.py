"""Explicit schemas of the session logs (never inferred) and where each log lies in a bundle."""

from __future__ import annotations

_VEC = "ARRAY<DOUBLE>"
_POLY = "ARRAY<ARRAY<DOUBLE>>"
_RLE = "STRUCT<width: INT, height: INT, counts: ARRAY<INT>, encoding: STRING>"

LOGS: dict[str, tuple[str, str]] = {
    "frames": ("camera/frame_metadata.jsonl",
               "frame_id BIGINT, sensor_timestamp_ns BIGINT, image_timestamp_ns BIGINT, exposure_time_ns BIGINT, iso INT, "
               "focal_length_mm DOUBLE, focus_distance_diopters DOUBLE, af_state STRING, ae_state STRING, awb_state STRING, "
               "crop_region ARRAY<INT>, stabilization_mode STRING, width INT, height INT, availability MAP<STRING, BOOLEAN>"),
    "gyro": ("imu/gyro.jsonl", "timestamp_ns BIGINT, sensor_type STRING, x DOUBLE, y DOUBLE, z DOUBLE, accuracy INT, source_rate_hz DOUBLE"),
    "accelerometer": ("imu/accelerometer.jsonl",
                      "timestamp_ns BIGINT, sensor_type STRING, x DOUBLE, y DOUBLE, z DOUBLE, accuracy INT, source_rate_hz DOUBLE"),
    "rotation_vector": ("imu/rotation_vector.jsonl",
                        "timestamp_ns BIGINT, sensor_type STRING, x DOUBLE, y DOUBLE, z DOUBLE, accuracy INT, source_rate_hz DOUBLE"),
    "location": ("location/location.jsonl",
                 "timestamp_ns BIGINT, latitude DOUBLE, longitude DOUBLE, altitude DOUBLE, speed_mps DOUBLE, bearing_deg DOUBLE, "
                 "horizontal_accuracy_m DOUBLE, speed_accuracy_mps DOUBLE, interpolated BOOLEAN, privacy STRING"),
    "observations": ("perception/observations.jsonl",
                     "timestamp_ns BIGINT, source_frame_id BIGINT, semantic_type STRING, geometry_type STRING, state STRING, severity INT, "
                     f"mask_rle {_RLE}, polygon {_POLY}, bbox {_VEC}, model_confidence DOUBLE, quality_at_mask DOUBLE, visibility STRING, "
                     "calibrated_confidence DOUBLE"),
    "tracks": ("perception/tracks.jsonl",
               "schema_version STRING, track_id BIGINT, timestamp_ns BIGINT, lifecycle_state STRING, semantic_type STRING, geometry_type STRING, "
               "object_state STRING, severity INT, direction STRING, distance_m DOUBLE, distance_confidence DOUBLE, distance_valid BOOLEAN, ttc_s DOUBLE, "
               "model_confidence DOUBLE, visibility_confidence DOUBLE, temporal_confidence DOUBLE, geometry_consistency DOUBLE, "
               "effective_confidence DOUBLE, path_relevance DOUBLE, risk_score DOUBLE, alert_score DOUBLE, "
               f"polygon {_POLY}, bbox {_VEC}, mask_rle {_RLE}, source_frame_id BIGINT, mount_profile_id STRING, model_version STRING, "
               f"visual_style STRING, label_rank INT, road_xy_m {_VEC}, depth_confidence DOUBLE, impact_score DOUBLE, speed_mps DOUBLE"),
    "road": ("perception/road.jsonl", f"timestamp_ns BIGINT, road_polygon {_POLY}"),
    "occlusion": ("perception/occlusion.jsonl", f"timestamp_ns BIGINT, occluded_polygons ARRAY<{_POLY}>"),
    "alerts": ("events/alerts.jsonl",
               "timestamp_ns BIGINT, track_id BIGINT, fired BOOLEAN, phrase STRING, direction STRING, semantic_type STRING, alert_score DOUBLE, "
               "threshold DOUBLE, reasons ARRAY<STRING>, snapshot STRING"),
    "marks": ("events/marks.jsonl", "timestamp_ns BIGINT, note STRING, frame_id BIGINT"),
    "runtime": ("diagnostics/runtime.jsonl",
                "timestamp_ns BIGINT, blur DOUBLE, glare DOUBLE, infer_fps DOUBLE, latency_p95_ms DOUBLE, status STRING, backend STRING, "
                "degrade_reason STRING, selected_for_infer BOOLEAN, selected_age_ms DOUBLE, occupancy_occluded_ratio DOUBLE, sharpness DOUBLE, "
                "inferred BOOLEAN, thermal_c DOUBLE, battery_pct DOUBLE, memory_mb DOUBLE, thermal_reason STRING, skip_far_roi BOOLEAN, "
                "dropped_infer BIGINT, queue_depth INT"),
    "diag_events": ("diagnostics/events.jsonl", "timestamp_ns BIGINT, domain STRING, code STRING, detail STRING, track_id BIGINT, used_for_alert BOOLEAN"),
}

MANIFEST = ("schema_version STRING, session_id STRING, device STRUCT<manufacturer: STRING, model: STRING, os_version: STRING>, camera_profile STRING, "
            "mount_profile_id STRING, calibration_hash STRING, model_packages ARRAY<STRING>, start_elapsed_realtime_ns BIGINT, "
            "end_elapsed_realtime_ns BIGINT, video_segments INT, capability_report_hash STRING, privacy_mode STRING, run_mode STRING, "
            "config_snapshot STRING, notes STRING")
MOUNT = ("profile_id STRING, name STRING, camera_id STRING, landscape BOOLEAN, camera_height_m DOUBLE, pitch_deg DOUBLE, roll_deg DOUBLE, "
         "yaw_deg DOUBLE, lateral_offset_m DOUBLE, handlebar_neutral_yaw_deg DOUBLE, near_reference_m DOUBLE, horizon_y_px DOUBLE, "
         "vehicle_centerline_x_px DOUBLE, known_distance_5m_px DOUBLE, known_distance_10m_px DOUBLE, known_distance_20m_px DOUBLE, valid BOOLEAN")
