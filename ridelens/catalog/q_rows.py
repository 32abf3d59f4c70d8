"""Row-level jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridelens.catalog.registry import Views, nudged, query, rounded
from ridelens.operators import rows

_BUMP = ("((semantic_type = 'pothole' and geometry_type = 'concave' and object_state <> 'normal') or (semantic_type = 'speed_bump' and object_state <> 'normal') "
         "or (semantic_type = 'manhole_cover' and geometry_type = 'concave' and object_state = 'abnormal'))")
SCORED = f"""sc0 as (select *, {_BUMP} as bump_hazard,
  greatest(0, model_confidence) * greatest(0, visibility_confidence) * greatest(0, temporal_confidence) * greatest(0, geometry_consistency) as vs,
  case when object_state = 'normal' or geometry_type = 'flat' then 0.02 else case severity when 0 then 0.05 when 1 then 0.28 when 2 then 0.7 when 3 then 1.0 else 0.22 end end as sv,
  case when ttc_s is null then 0.35 when ttc_s <= 0.8 then 1.0 when ttc_s <= 1.6 then 0.85 when ttc_s <= 2.8 then 0.6 else 0.25 end as ur from a_tracks),
sc1 as (select *, case when bump_hazard then greatest(ur, 0.65) else ur end as urg from sc0),
sc2 as (select *, vs * sv * path_relevance * urg * case when semantic_type = 'unknown_anomaly' then 0.55 else 1.0 end as base from sc1),
sc as (select *, case when bump_hazard then greatest(base, model_confidence * path_relevance) else base end as ascore,
  case when bump_hazard then 0.08 else 0.62 end as thr from sc2),
gt as (select *, case when lifecycle_state not in ('CONFIRMED', 'ALERTED') then 'not_confirmed'
  when status in ('SEVERE_BLUR', 'LENS_CONTAMINATION', 'PERCEPTION_LIMITED') or (status = 'OCCLUDED' and not bump_hazard) then 'quality_pause'
  when not geometry_valid then 'geometry_invalid' when semantic_type in ('puddle', 'gravel') then 'info_layer'
  when semantic_type in ('manhole_cover', 'repair_patch', 'road_joint', 'rough_broken') and (object_state = 'normal' or geometry_type = 'flat') then 'normal_or_flat'
  when severity between 0 and 1 then 'severity_too_low' when visibility_confidence < 0.4 and not bump_hazard then 'visibility_gate'
  when effective_confidence < 0.48 and not (bump_hazard and model_confidence >= 0.08) then 'effective_gate'
  when path_relevance < 0.45 then 'off_corridor' when direction = 'UNKNOWN' then 'direction_unknown' when ascore < thr then 'below_threshold' end as gate from sc)"""
_ID = "frame, seq, price"


@query("flag_impacts", ["a_imu"], """
select event_id, round(sqrt(x*x + y*y + z*z), 6) + 0.0 as magnitude, round(abs(sqrt(x*x + y*y + z*z) - 9.81), 6) + 0.0 as residual,
  abs(sqrt(x*x + y*y + z*z) - 9.81) >= 3 or abs(x) >= 9 as severe from a_imu
""")
def _(v: Views):
    # lowered thresholds: the synthetic samples stay far below a real crash
    from ridelens.config import ImpactConfig
    df = rows.flag_impacts(v.a_imu, gyro="x", cfg=ImpactConfig(residual_threshold=3.0, gyro_threshold=9.0))
    return rounded(df, "magnitude", "residual").select("event_id", "magnitude", "residual", "severe")


@query("score_impacts", ["a_tracks"], f"""
select {_ID}, round(case when own_speed_mps >= 2 and distance_m <= 6 and abs(accel_z - 9.81) >= 3.5 then least(1, abs(accel_z - 9.81) / 12) end, 6) + 0.0 as impact_score,
  case when abs(accel_z - 9.81) / greatest(coalesce(own_speed_mps, 0) / 10, 0.35) < 2 then 'none' when abs(accel_z - 9.81) / greatest(coalesce(own_speed_mps, 0) / 10, 0.35) < 4 then 'weak'
       when abs(accel_z - 9.81) / greatest(coalesce(own_speed_mps, 0) / 10, 0.35) < 7 then 'medium' else 'strong' end as impact_label from a_tracks
""")
def _(v: Views):
    return rounded(rows.score_impacts(v.a_tracks), "impact_score").select("frame", "seq", "price", "impact_score", "impact_label")


@query("score_alerts", ["a_tracks"], f"""
with {SCORED} select {_ID}, bump_hazard, round(vs + 1e-9, 6) as visual_score, sv::double as severity_score, urg::double as urgency,
  round(ascore + 1e-9, 6) as alert_score, thr::double as threshold from sc
""")
def _(v: Views):
    df = nudged(rows.score_alerts(v.a_tracks), "visual_score", "alert_score")
    return df.select("frame", "seq", "price", "bump_hazard", "visual_score", "severity_score", "urgency", "alert_score", "threshold")


@query("gate_alerts", ["a_tracks"], f"with {SCORED} select {_ID}, gate as gate_reason from gt")
def _(v: Views):
    return rows.gate_alerts(v.a_tracks).select("frame", "seq", "price", "gate_reason")


@query("gate_reason_counts", ["a_tracks"], f"with {SCORED} select coalesce(gate, 'passed') as reason, count(*) as n_rows from gt group by 1")
def _(v: Views):
    return rows.gate_reason_counts(v.a_tracks)


_PHRASE = """case direction when 'LEFT_FRONT' then '左前方' when 'CENTER_FRONT' then '正前方' when 'RIGHT_FRONT' then '右前方' when 'ACROSS' then '正前方' else '前方' end ||
 case when severity = -1 then '路面异常' when semantic_type = 'manhole_cover' and geometry_type = 'concave' and object_state = 'abnormal' then '下沉井盖' else
 case semantic_type when 'pothole' then '大坑' when 'manhole_cover' then '井盖' when 'speed_bump' then '减速带' when 'road_joint' then '接缝' when 'repair_patch' then '修补'
  when 'rough_broken' then '粗糙路面' when 'puddle' then '积水' when 'gravel' then '散落物' else '路面异常' end end"""


@query("audit_phrases", ["a_alerts"], f"""
with a as (select *, {_PHRASE} as expected_phrase from a_alerts),
b as (select *, case event_id % 4 when 0 then expected_phrase when 1 then expected_phrase || '刹车' when 2 then 'please steer left' else expected_phrase end as phrase from a)
select event_id, phrase, expected_phrase, (phrase like '%刹车%' or phrase like '%steer left%') as has_forbidden, phrase <> expected_phrase as differs
from b where fired and phrase <> expected_phrase
""")
def _(v: Views):
    from ridelens.functions import scoring
    e = scoring.phrase()
    i = F.col("event_id") % 4
    a = v.a_alerts.withColumn("phrase", F.when(i == 1, F.concat(e, F.lit("刹车"))).when(i == 2, F.lit("please steer left")).otherwise(e))
    return rows.audit_phrases(a).select("event_id", "phrase", "expected_phrase", "has_forbidden", "differs")


@query("classify_frames", ["a_frames"], """
select event_id, lens_drops < 12 and laplacian >= 18 and motion_blur < 0.62 and glare < 0.45 and underexposure < 0.72 and overexposure < 0.55 and road_visible_ratio >= 0.18 as usable,
  case when lens_drops >= 12 then 'lens_drop' when occluded_ratio > 0.45 then 'occluded' when glare >= 0.45 then 'glare'
   when motion_blur >= 0.62 or least(laplacian / 80, 1) * 80 < 18 then 'blur' when underexposure >= 0.72 then 'underexposed'
   when overexposure >= 0.55 then 'overexposed' when road_visible_ratio < 0.18 then 'unknown' else 'clear' end as visibility_class from a_frames
""")
def _(v: Views):
    return rows.classify_frames(v.a_frames).select("event_id", "usable", "visibility_class")


@query("classify_tiles", ["a_frames"], """
with t as (select event_id, occluded_ratio * 1.5 as luma, laplacian from a_frames)
select event_id, case when luma < 0.12 then 'underexposed' when luma > 0.9 then 'overexposed' when laplacian < 8 then 'blur' else 'clear' end as visibility,
  round(least(case when luma < 0.12 or luma > 0.9 then 0.25 when laplacian < 8 then 0.3 else 1 end, least(laplacian / 60, 1)), 6) + 0.0 as score from t
""")
def _(v: Views):
    t = v.a_frames.select("event_id", (F.col("occluded_ratio") * 1.5).alias("mean_luma"), "laplacian")
    return rounded(rows.classify_tiles(t), "score").select("event_id", "visibility", "score")


@query("admission_gate", ["a_frames"], """
with f as (select *, least(1.0, ((k % 12) * 100.0 * 720 + (k % 5) * 80.0 * 400) / (1920.0 * 1080)) as r from a_frames)
select event_id, round(r, 6) + 0.0 as occlusion_ratio, k % 6 <> 0 and usable and r < 0.4 and k % 9 not in (2, 4, 8) as allow_new from f
""")
def _(v: Views):
    def box(w, h):
        z = F.lit(0.0)
        return F.array(F.array(z, z), F.array(w, z), F.array(w, h), F.array(z, h))
    status = F.element_at(F.array(*[F.lit(s) for s in ("NORMAL", "DEGRADED_VISIBILITY", "SEVERE_BLUR", "OCCLUDED", "LENS_CONTAMINATION", "THERMAL_THROTTLE",
                                                       "STORAGE_LOW", "SAFE_MODE", "PERCEPTION_LIMITED")]), (F.col("k") % 9 + 1).cast("int"))
    f = v.a_frames.withColumn("status", status).withColumn("fresh", F.col("k") % 6 != 0).withColumn("width", F.lit(1920)).withColumn("height", F.lit(1080)).withColumn(
        "occluded_polygons", F.array(box(F.col("k") % 12 * 100.0, F.lit(720.0)), box(F.col("k") % 5 * 80.0, F.lit(400.0)),
                                     F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(900.0), F.lit(900.0)))))
    return rounded(rows.admission_gate(f), "occlusion_ratio").select("event_id", "occlusion_ratio", "allow_new")


# camera axes written out: yaw about z, pitch about x, roll about the viewing axis
_CAM = """
m as (select *, radians(pitch_deg) as p, radians(roll_deg) as r, radians(yaw_deg + handlebar_neutral_yaw_deg) as w from a_mounts),
c as (select *, cos(w) as ax, sin(w) as ay, sin(p) * sin(w) as bx, -sin(p) * cos(w) as by_, -cos(p) as bz, -cos(p) * sin(w) as zx, cos(p) * cos(w) as zy, -sin(p) as zz from m),
cam as (select *, cos(r) * ax - sin(r) * bx as xx, cos(r) * ay - sin(r) * by_ as xy, -sin(r) * bz as xz,
         sin(r) * ax + cos(r) * bx as yx, sin(r) * ay + cos(r) * by_ as yy, cos(r) * bz as yz from c)
"""


@query("localize_tracks", ["a_boxes", "a_mounts"], f"""
with {_CAM}, j as (select b.image, b.seq, b.price, b.quality, cam.*, ((x0 + x1) / 2 - cx) / fx as u, (y1 - cy) / fy as q from a_boxes b join cam on b.supp = cam.profile_id),
d as (select *, (u * xx + q * yx + zx) / sqrt(u*u + q*q + 1) as dx, (u * xy + q * yy + zy) / sqrt(u*u + q*q + 1) as dy, (u * xz + q * yz + zz) / sqrt(u*u + q*q + 1) as dz from j),
s as (select *, case when abs(dz) >= 1e-8 then -camera_height_m / dz end as s from d),
g as (select *, case when valid and s >= 0.2 and s * dy between 0.4 and 80 then lateral_offset_m + s * dx end as gx, case when valid and s >= 0.2 and s * dy between 0.4 and 80 then s * dy end as gy from s)
select image, seq, price, round(gx, 6) + 0.0 as road_x, round(gy, 6) + 0.0 as road_y, round(case when gy is not null then greatest(0.5, gy) end, 6) + 0.0 as distance_m,
  case when gy is null then 0.0 else round(case when gy > 30 then 0.45 when gy > 20 then 0.62 else 0.82 end * case when quality < 0.4 then 0.7 else 1 end, 6) end::double + 0.0 as distance_confidence,
  gy is not null as distance_valid from g
""")
def _(v: Views):
    t = v.a_boxes.select("image", "seq", "price", F.col("supp").alias("profile_id"), ((F.col("x0") + F.col("x1")) / 2).alias("contact_x"),
                         F.col("y1").alias("contact_y"), F.col("quality").alias("quality_at_mask"))
    df = rounded(rows.localize_tracks(t, v.a_mounts), "road_x", "road_y", "distance_m", "distance_confidence")
    return df.select("image", "seq", "price", "road_x", "road_y", "distance_m", "distance_confidence", "distance_valid")


@query("assign_corridor", ["a_tracks"], f"""
with e as (select *, road_x / 0.9775 as k0 from a_tracks)
select {_ID}, case when width_m >= 1.6 and abs(road_x) < 0.85 then 'ACROSS' when abs(road_x) <= 0.612 then 'CENTER_FRONT' when road_x < 0 then 'LEFT_FRONT' else 'RIGHT_FRONT' end as direction,
  round(least(greatest(0.75 * exp(-0.5 * k0 * k0) + 0.25 * least(greatest((40 - road_y) / 40, 0), 1), 0), 1), 6) + 0.0 as path_relevance,
  case when distance_m < 12 then 'near' when distance_m < 25 then 'mid' else 'far' end as band,
  case when not distance_valid then null when distance_m < 10 then round_even(distance_m, 0)::int || ' m' when distance_m <= 30 then '约 ' || (round_even(distance_m / 2, 0) * 2)::int || ' m'
       when distance_confidence < 0.5 then '远处' else '约 ' || round_even(distance_m, 0)::int || ' m' end as display_distance from e
""")
def _(v: Views):
    return rounded(rows.assign_corridor(v.a_tracks), "path_relevance").select("frame", "seq", "price", "direction", "path_relevance", "band", "display_distance")


@query("score_track_confidence", ["a_tracks"], f"""
with e as (select *, least(greatest(least(1, hits / 6) * least(1, age_s / 0.4) * pow(0.85, misses), 0.05), 1) as tc, least(greatest(0.4 + 0.6 * distance_confidence, 0), 1) as gc from a_tracks),
f as (select *, model_confidence * visibility_confidence * tc * gc as eff from e)
select {_ID}, round(tc + 1e-9, 6) as temporal_confidence, round(gc + 1e-9, 6) as geometry_consistency, round(eff + 1e-9, 6) as effective_confidence,
  round(eff * case severity when 0 then 0.05 when 1 then 0.3 when 2 then 0.7 when 3 then 1.0 else 0.22 end * path_relevance + 1e-9, 6) as risk_score from f
""")
def _(v: Views):
    cols = ("temporal_confidence", "geometry_consistency", "effective_confidence", "risk_score")
    return nudged(rows.score_track_confidence(v.a_tracks), *cols).select("frame", "seq", "price", *cols)


@query("mark_passed", ["a_tracks"], f"""
with e as (select *, lag(distance_m) over (partition by session_id, track_id order by timestamp_ns, seq, price) as pd,
  semantic_type in ('pothole', 'speed_bump') or (semantic_type = 'manhole_cover' and geometry_type = 'concave') as bump from a_tracks)
select {_ID}, not (bump and lifecycle_state not in ('CONFIRMED', 'ALERTED')) and
  ((distance_m < 2.2 and image_vy > 40) or coalesce(distance_m > pd + 4 and distance_m < 8, false) or road_y < 1.6) as passed from e
""")
def _(v: Views):
    return rows.mark_passed(v.a_tracks).select("frame", "seq", "price", "passed")


@query("mount_health", ["a_mounts"], f"""
with {_CAM}, s as (select o_orderkey as session_id, o_custkey, cam.* from orders join cam on profile_id = o_custkey % 97),
h as (select *, (o_custkey % 19 - 9)::double as pe, (o_custkey % 25 - 12)::double as re, case when o_custkey % 6 <> 0 then 180.0 + o_custkey % 90 end as seen,
  yx * -lateral_offset_m + yy * 80 + yz * -camera_height_m as yc, zx * -lateral_offset_m + zy * 80 + zz * -camera_height_m as zc from s),
e as (select *, (fy * yc + cy * zc) / zc as hz from h),
o as (select *, abs(pe) <= 8 and abs(re) <= 10 and not coalesce(abs(seen - hz) > 48, false) as ok from e)
select session_id, round(hz, 6) + 0.0 as expected_horizon_y, ok and valid as geometry_valid, case when not ok then 'install_health_fail' when not valid then 'no_mount_profile' end as invalid_reason from o
""")
def _(v: Views):
    k = F.col("o_custkey")
    s = v.orders.select(F.col("o_orderkey").alias("session_id"), (k % 97).alias("profile_id"), (k % 19 - 9).cast("double").alias("pitch_err_deg"),
                        (k % 25 - 12).cast("double").alias("roll_err_deg"), F.when(k % 6 != 0, F.lit(180.0) + k % 90).alias("horizon_y_px"))
    df = rows.mount_health(s, v.a_mounts.drop("horizon_y_px", "pitch_err_deg", "roll_err_deg"))
    return rounded(df, "expected_horizon_y").select("session_id", "expected_horizon_y", "geometry_valid", "invalid_reason")


@query("measure_polygons", ["a_boxes"], """
-- a pentagon: the rectangle with its lower right corner cut off
select image, seq, price, x0 as box_x0, y0 as box_y0, x1 as box_x1, y1 as box_y1, round((x1 - x0) * (y1 - y0) - 50.0, 6) + 0.0 as area,
  round((x0 + x1 + x1 + (x1 - 10) + x0) / 5, 6) + 0.0 as mean_x, round((y0 + y0 + (y1 - 10) + y1 + y1) / 5, 6) + 0.0 as mean_y,
  round((x1 - 10 + x0) / 2, 6) + 0.0 as contact_x, y1 as contact_y from a_boxes
""")
def _(v: Views):
    def pt(x, y):
        return F.array(x.cast("double"), y.cast("double"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    poly = F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1 - 10), pt(x1 - 10, y1), pt(x0, y1))
    df = rows.measure_polygons(v.a_boxes.select("image", "seq", "price", poly.alias("polygon")))
    return rounded(df, "area", "mean_x", "mean_y", "contact_x").drop("polygon")


@query("mask_runs", ["a_boxes"], """
with px as (select distinct l_orderkey // 50 as mask_id, (l_partkey * 37 + l_linenumber) % 400 as pos from lineitem),
n as (select *, row_number() over (partition by mask_id order by pos) as i from px),
s as (select mask_id, min(pos) as first, max(pos) as last, count(*) as length, row_number() over (partition by mask_id order by min(pos)) as k from n group by mask_id, pos - i),
g as (select *, coalesce(lag(last) over (partition by mask_id order by k), -1) as before, lead(first) over (partition by mask_id order by k) as after from s)
select mask_id, (2 * k - 1)::bigint as run, 1 as value, length from g
union all select mask_id, (2 * k - 2)::bigint, 0, first - before - 1 from g where first - before > 1 or k = 1
union all select mask_id, (2 * k)::bigint, 0, 399 - last from g where after is null and last < 399
""")
def _(v: Views):
    li = v.lineitem
    px = li.select((F.floor(F.col("l_orderkey") / 50)).alias("mask_id"), ((F.col("l_partkey") * 37 + F.col("l_linenumber")) % 400).alias("pos")).distinct()
    grid = px.select("mask_id").distinct().withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(399).cast("long"))))
    full = grid.join(px.withColumn("label", F.lit(1)), ["mask_id", "pos"], "left").select(
        "mask_id", F.floor(F.col("pos") / 20).alias("x"), (F.col("pos") % 20).alias("y"), F.coalesce("label", F.lit(0)).alias("label"), F.lit(20).alias("height"))
    return rows.mask_runs(full, keys=["mask_id"])


@query("mask_coverage", ["a_boxes"], """
with c as (select image as frame, semantic_type, [line, part % 30, supp % 20, part % 50] as c from a_boxes),
o as (select frame, semantic_type, greatest(least(c[1] + c[2], 64) - least(c[1], 64), 0) + greatest(least(c[1] + c[2] + c[3] + c[4], 64) - least(c[1] + c[2] + c[3], 64), 0) as px from c)
select frame, semantic_type, count(*) as n_masks, sum(px)::bigint as covered_px, (count(*) * 64)::bigint as grid_px from o group by 1, 2
""")
def _(v: Views):
    counts = F.array(*[c.cast("int") for c in (F.col("line"), F.col("part") % 30, F.col("supp") % 20, F.col("part") % 50)])
    rle = F.struct(F.lit(8).alias("width"), F.lit(8).alias("height"), counts.alias("counts"), F.lit("rle_cocoa").alias("encoding"))
    return rows.mask_coverage(v.a_boxes.select(F.col("image").alias("frame"), "semantic_type", rle.alias("mask_rle")))


@query("coarsen_locations", ["a_location"], """
select event_id, round_even(latitude, 2) as latitude, round_even(longitude, 2) as longitude, greatest(coalesce(horizontal_accuracy_m, 0), 150) as horizontal_accuracy_m, 'coarsened' as privacy from a_location
""")
def _(v: Views):
    return rows.coarsen_locations(v.a_location).select("event_id", "latitude", "longitude", "horizontal_accuracy_m", "privacy")


_PATHS = r"""regexp_replace({c}, '([A-Za-z]:)?[/\\][^\s"'']+\.(mp4|jpg|png|jsonl|json|bin)', '[path]', 'gi')"""


@query("redact_events", ["ev"], rf"""
with e as (select event_id, event_type, 'saved /data/ride_' || k || '/cam.MP4 ok' as detail, k % 3 as track_id, value as latency_p95_ms, 'C:\clips\a' || k || '.json' as file_path, k from ev)
select event_id, event_type, {_PATHS.format(c='detail')} as detail, track_id, null::double as latency_p95_ms, '[redacted]' as file_path,
 'see [path]' as nested_note, null::double as nested_latitude, 'x' || k as map_note, '[redacted]' as map_lon_text from e
""")
def _(v: Views):
    k = F.col("k").cast("string")
    e = v.ev.select("event_id", "event_type", F.concat(F.lit("saved /data/ride_"), k, F.lit("/cam.MP4 ok")).alias("detail"), (F.col("k") % 3).alias("track_id"),
                    F.col("value").alias("latency_p95_ms"), F.concat(F.lit("C:\\clips\\a"), k, F.lit(".json")).alias("file_path"),
                    F.struct(F.concat(F.lit("see /tmp/"), k, F.lit(".png")).alias("note"), F.col("value").alias("latitude")).alias("snapshot"),
                    F.create_map(F.lit("note"), F.concat(F.lit("x"), k), F.lit("lon_text"), k).alias("tags"))
    out = rows.redact_events(e)
    return out.select("event_id", "event_type", "detail", "track_id", "latency_p95_ms", "file_path", F.col("snapshot.note").alias("nested_note"),
                      F.col("snapshot.latitude").alias("nested_latitude"), F.col("tags")["note"].alias("map_note"), F.col("tags")["lon_text"].alias("map_lon_text"))


_TEXT = rf"""regexp_replace(regexp_replace({_PATHS.format(c='{c}')}, '"latitude"\s*:\s*-?\d+(\.\d+)?', '"latitude": null', 'g'), '"longitude"\s*:\s*-?\d+(\.\d+)?', '"longitude": null', 'g')"""


@query("redact_json_text", ["ev"], r"""
select event_id, case when event_id % 50 = 0 then '{"broken": ' || k
  else '{"code":' || to_json(event_type)::varchar || ',"n":' || k || ',"latitude":null,"geo":{"longest":"[redacted]","points":[{"lon":null,"tag":"t' || k || '"},{"deep":{"file_path":"[redacted]","ok":' ||
  (case when k % 2 = 0 then 'true' else 'false' end) || ',"note":"see [path]","list":["[path]",' || k || ',null,["[path]"]]}}]},"flat":null,"platform":"[redacted]","none":null}' end as body
from (select *, event_id % 97 as k from events)
""")
def _(v: Views):
    k = F.col("event_id") % 97
    deep = F.concat(
        F.lit('{"code":'), F.concat(F.lit('"'), "event_type", F.lit('"')), F.lit(',"n":'), k, F.lit(',"latitude":31.5,"geo":{"longest":{"a":[1,2]},"points":[{"lon":2.5,"tag":"t'), k,
        F.lit('"},{"deep":{"file_path":"/a/b","ok":'), F.when(k % 2 == 0, "true").otherwise("false"), F.lit(',"note":"see /a/b/c.mp4","list":["C:/x/y.JPG",'), k,
        F.lit(',null,["/q/r.json"]]}}]},"flat":true,"platform":"x","none":null}'))
    body = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit('{"broken": '), k)).otherwise(deep)
    return rows.redact_json_text(v.events.select("event_id", body.alias("body")), "body")


@query("redact_text", None, f"""
with t as (select doc_id, text || ' {{"latitude": 31.2304, "longitude":-121.5}} at /sdcard/ride/' || doc_id || '.jsonl' as body from documents)
select doc_id, {_TEXT.format(c='body')} as body from t
union all select -1 - page_id, {_TEXT.format(c='html')} from pages
""")
def _(v: Views):
    d = v.documents.select("doc_id", F.concat(F.col("text"), F.lit(' {"latitude": 31.2304, "longitude":-121.5} at /sdcard/ride/'), F.col("doc_id").cast("string"), F.lit(".jsonl")).alias("body"))
    p = v.pages.select((F.lit(-1) - F.col("page_id")).alias("doc_id"), F.col("html").alias("body"))
    return rows.redact_text(d.unionByName(p), "body")


@query("redact_crash_detail", None, f"""
select doc_id, {_TEXT.format(c="text")} as detail from documents
""")
def _(v: Views):
    return rows.redact_text(v.documents.select("doc_id", F.col("text").alias("detail")), "detail")
