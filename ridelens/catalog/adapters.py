"""Views of the driver tables in the shape of the ride logs.

Each view is stated once as select expressions that Spark and DuckDB both read, so that the oracle
starts from exactly the same rows; `spark_view` builds DataFrames, `duck_cte` the same in SQL text.
Operators never share expressions with the oracle - only these input views do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
           "benchmark labels conversations").split()


def _case(expr: str, values: list[str]) -> str:
    arms = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))
    return f"(case {expr} {arms} end)"


_SEM = ["pothole", "manhole_cover", "speed_bump", "road_joint", "repair_patch",
        "rough_broken", "puddle", "gravel", "unknown_anomaly"]
_GEO = ["concave", "convex", "rough", "step", "flat", "unknown"]
_STATUS = ["NORMAL", "DEGRADED_VISIBILITY", "SEVERE_BLUR", "OCCLUDED", "LENS_CONTAMINATION",
           "THERMAL_THROTTLE", "STORAGE_LOW", "SAFE_MODE", "PERCEPTION_LIMITED"]
_DIR = ["LEFT_FRONT", "CENTER_FRONT", "RIGHT_FRONT", "ACROSS", "UNKNOWN"]
_RAW_LABELS = ["D40", "D00", "manhole", "speed_bump", "Sunken-Manhole", "repair patch", "subsidence", "rutting",
               "drain", "plain_road", "minor damage", "Major-Damage", "nonsense", "open manhole cover",
               "Alligator_Crack", "patch", "Looseness", "hump"]
_PROMPTS = ["pothole", "large pothole", "speed_bump", "sunken manhole cover", "manhole", "bicycle",
            "Speed-Hump", "asphalt hole"]

# name -> (source, [expressions], where)
VIEWS: dict[str, tuple[str, list[str], str | None]] = {
    "ev": ("events", [
        "event_id", "user_id % 8 as session_id",
        "{EPOCH_US} - 1704067200000000 as t_ns", "{K} as k", "event_type", "value", "user_id"], None),
    "a_frames": ("ev", [
        "event_id", "session_id", "t_ns as sensor_timestamp_ns", "k",
        "(k % 100) / 100.0::double as blur", "38.0::double + k % 10 as thermal_c", "k % 5 <> 0 as usable",
        "(k % 37) * 2.0::double as laplacian", "((k * 7) % 100) / 100.0::double as motion_blur",
        "((k * 11) % 60) / 100.0::double as glare", "((k * 13) % 90) / 100.0::double as underexposure",
        "((k * 17) % 70) / 100.0::double as overexposure",
        "((k * 19) % 100) / 100.0::double as road_visible_ratio",
        "((k * 23) % 70) / 100.0::double as occluded_ratio", "k % 15 as lens_drops",
        "value as latency_ms", "k % 3 = 0 as inferred"], None),
    "a_imu": ("ev", [
        "event_id", "session_id", "t_ns as timestamp_ns",
        "case event_type when 'click' then 'GYRO' when 'view' then 'ACCEL' else 'ROTATION_VECTOR' end as sensor_type",
        "k / 10.0::double as x", "value / 50.0::double as y",
        "9.81::double + (k % 21 - 10) as z"], "event_type in ('click', 'view', 'error')"),
    "a_location": ("ev", [
        "event_id", "session_id", "t_ns as timestamp_ns",
        "case when k % 7 = 0 then null else 31 + k / 1000.0::double end as latitude",
        "121 + k / 1000.0::double as longitude", "1 + k / 10.0::double as speed_mps",
        "((k * 37) % 360)::double as bearing_deg",
        "case when k % 3 = 0 then null else 0.5::double end as speed_accuracy_mps",
        "(k % 200)::double as horizontal_accuracy_m",
        "case when k % 2 = 0 then null else (k % 90)::double end as altitude"], "event_type = 'signup'"),
    "a_alerts": ("ev", [
        "event_id", "session_id", "t_ns as timestamp_ns", "value > 50 as fired", "k % 40 as track_id",
        _case("k % 5", _DIR) + " as direction", _case("k % 9", _SEM) + " as semantic_type",
        _case("event_id % 6", _GEO) + " as geometry_type",
        "case event_id % 3 when 0 then 'abnormal' when 1 then 'normal' else 'unknown' end as object_state",
        "(k % 5 - 1)::int as severity", "value as alert_score"], "event_type = 'purchase'"),
    "a_manifest": ("customer", [
        "c_custkey as session_id", "0::bigint as start_elapsed_realtime_ns",
        "case when c_custkey % 11 = 0 then null else c_custkey * 60000000000 end as end_elapsed_realtime_ns",
        "case c_custkey % 4 when 0 then null when 1 then '0.9' else '1.0' end as schema_version",
        "(c_custkey % 7)::bigint as video_segments", "c_mktsegment as notes"], None),
    "a_tracks": ("lineitem", [
        "l_orderkey as frame", "l_orderkey % 50 as session_id", "l_partkey % 200 as track_id",
        "l_orderkey * 33000000 as timestamp_ns",
        "l_linenumber * 1000000000000000 + l_partkey * 10000000 + l_suppkey as seq", "l_extendedprice as price",
        "l_quantity as distance_m", "l_linenumber <> 1 as distance_valid",
        "l_discount * 10 as effective_confidence", "1 - l_tax * 10 as visibility_confidence",
        "case when l_returnflag = 'A' then 'CONFIRMED' when l_returnflag = 'R' then 'TRACKED' "
        "when l_linestatus = 'O' then 'CANDIDATE' else 'ALERTED' end as lifecycle_state",
        _case("l_suppkey % 9", _SEM) + " as semantic_type", _case("l_linenumber % 6", _GEO) + " as geometry_type",
        "case l_partkey % 3 when 0 then 'abnormal' when 1 then 'normal' else 'unknown' end as object_state",
        "(l_partkey % 5 - 1)::int as severity", _case("(l_orderkey + l_linenumber) % 5", _DIR) + " as direction",
        "1 - l_discount * 5 as model_confidence", "((l_partkey % 50) + 50) / 100.0::double as temporal_confidence",
        "0.4::double + (l_suppkey % 10) * 0.06::double as geometry_consistency",
        "(l_orderkey % 21) / 20.0::double as path_relevance",
        "case when l_linenumber = 7 then null else l_quantity / 10 end as ttc_s",
        "l_discount * l_tax as risk_score", _case("(l_orderkey + l_suppkey) % 9", _STATUS) + " as status",
        "l_partkey % 13 <> 0 as geometry_valid", "(l_partkey % 41) / 10.0::double - 2 as road_x",
        "l_quantity as road_y", "l_linenumber * 0.4::double as width_m",
        "(1 + l_linenumber)::int as hits", "(l_suppkey % 4)::int as misses",
        "(l_partkey % 60) / 100.0::double as age_s", "(l_suppkey % 100) / 100.0::double as distance_confidence",
        "((l_partkey * 3) % 90)::double as image_vy",
        "case when l_partkey % 4 = 0 then null else (l_partkey % 17)::double end as own_speed_mps",
        "9.81::double + (l_suppkey % 21 - 10) as accel_z",
        "l_returnflag as variant", "l_orderkey as source_frame_id"], None),
    "a_boxes": ("lineitem", [
        "l_orderkey as image", "l_partkey as part", "l_suppkey as supp", "l_linenumber as line",
        "l_linenumber * 1000000000000000 + l_partkey * 10000000 + l_suppkey as seq", "l_extendedprice as price",
        "((l_partkey * 37) % 1800)::double as x0", "((l_suppkey * 53) % 1000)::double as y0",
        "(l_partkey * 37) % 1800 + 20 + 4 * l_quantity as x1", "(l_suppkey * 53) % 1000 + 15.0::double + 8 * l_linenumber as y1",
        "l_discount * 10 as conf", "1 - l_tax * 10 as quality",
        _case("l_partkey % 8", _PROMPTS) + " as name", _case("l_suppkey % 9", _SEM) + " as semantic_type",
        "l_suppkey % 24 as class_id", "l_returnflag as source"], None),
    "a_gt": ("orders", [
        "o_orderkey as frame", "o_custkey % 100 as id", "((o_custkey * 41) % 1900)::double as cx",
        "((o_custkey * 29) % 1000)::double as cy", "2.0::double + o_custkey % 40 as distance_m",
        "(o_custkey % 41) / 10.0::double - 2 as x_m", _case("o_custkey % 9", _SEM) + " as semantic",
        "o_custkey % 6 as slice"], None),
    "a_labels": ("part", [
        "p_partkey as label_id", "p_partkey % 18 as raw_id", _case("p_partkey % 18", _RAW_LABELS) + " as raw",
        "case p_size % 6 when 0 then null when 1 then 'mild' when 2 then '2' when 3 then ' Severe ' "
        "when 4 then 'None' else 'weird' end as severity_raw", "p_brand as source",
        "(p_size % 6)::int as severity_int", "p_size"], None),
    "a_calib": ("labels join documents using (doc_id)", [
        "doc_id", "(n_chars % 1000) / 1000.0::double as confidence", "quality::int as correct",
        "toxic::int as toxic", "lang as slice"], None),
    "a_pixels": ("lineitem", [
        "l_linenumber % 4 as pred", "l_suppkey % 4 as gt", "l_returnflag as slice"], None),
    "a_mounts": ("supplier", [
        "s_suppkey as profile_id", "0.9::double + (s_suppkey % 50) / 100.0::double as camera_height_m",
        "10.0::double + s_suppkey % 17 as pitch_deg", "(s_suppkey % 9 - 4)::double as roll_deg",
        "(s_suppkey % 7 - 3)::double as yaw_deg", "(s_suppkey % 5 - 1)::double as handlebar_neutral_yaw_deg", "(s_suppkey % 11 - 5) / 10.0::double as lateral_offset_m",
        "1423.0::double as fx", "1423.0::double as fy", "960.0::double as cx", "540.0::double as cy",
        "s_suppkey % 10 <> 0 as valid",
        "case when s_suppkey % 6 = 0 then null else 100.0::double + s_suppkey % 90 end as horizon_y_px",
        "(s_suppkey % 19 - 9)::double as pitch_err_deg", "(s_suppkey % 25 - 12)::double as roll_err_deg",
        "case when s_suppkey % 5 = 0 then null else 480.0::double + s_suppkey % 60 end as known_distance_5m_px",
        "case when s_suppkey % 3 = 0 then null else 300.0::double + s_suppkey % 40 end as known_distance_10m_px",
        "case when s_suppkey % 4 = 0 then null else 210.0::double + s_suppkey % 30 end as known_distance_20m_px"],
        None),
    "a_clips": ("part", [
        "p_partkey as clip_id", "p_name as clip_name", "(p_partkey % 61)::double as fps",
        "p_partkey % 5000 as frames", "50.0::double + p_size * 3 as mean_luma",
        "p_retailprice as bytes", "p_size"], None),
}

DEPENDS = {"ev": [], "a_frames": ["ev"], "a_imu": ["ev"], "a_location": ["ev"], "a_alerts": ["ev"]}

_SPARK = {"EPOCH_US": "unix_micros(cast(ts as timestamp))", "K": "cast(get_json_object(props, '$.k') as bigint)"}
_DUCK = {"EPOCH_US": "epoch_us(ts)", "K": "cast(json_extract(props, '$.k') as bigint)"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in _TABLES:
        return table(spark, sf_dir, name)
    source, exprs, where = VIEWS[name]
    if " join " in source:
        a, b = (s.strip() for s in source.split(" using ")[0].split(" join "))
        base = table(spark, sf_dir, a).join(table(spark, sf_dir, b), source.split("(")[1].rstrip(")"))
    else:
        base = spark_view(spark, sf_dir, source)
    if where:
        base = base.where(where)
    return base.selectExpr(*[e.format(**_SPARK) for e in exprs])


def duck_cte(names: list[str]) -> str:
    """`with ...` prefix that defines the given views in DuckDB."""
    todo: list[str] = []
    for n in names:
        for d in [*DEPENDS.get(n, []), n]:
            if d not in todo:
                todo.append(d)
    parts = []
    for n in todo:
        source, exprs, where = VIEWS[n]
        cond = f" where {where}" if where else ""
        parts.append(f"{n} as (select {', '.join(e.format(**_DUCK) for e in exprs)} from {source}{cond})")
    return ",\n".join(parts)
