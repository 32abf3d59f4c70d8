"""Reports and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridelens.plans.rounds import cut_lineage
from ridelens.catalog.registry import Views, query, rounded
from ridelens.operators import reports, spatial, tracks

_HOURS = """
c as (select session_id, (max(sensor_timestamp_ns) - min(sensor_timestamp_ns)) / 1e9 / 3600 as h, count(*) as n from a_frames where sensor_timestamp_ns <> 0 group by 1),
h as (select coalesce(m.session_id, c.session_id) as session_id, case when end_elapsed_realtime_ns > start_elapsed_realtime_ns then (end_elapsed_realtime_ns - start_elapsed_realtime_ns) / 1e9 / 3600.0
       when n >= 2 then h else 0 end as hours from a_manifest m full join c using (session_id))
"""


@query("session_hours", ["a_manifest", "a_frames"], f"with {_HOURS} select session_id, round(hours, 6) + 0.0 as hours from h")
def _(v: Views):
    return rounded(reports.session_hours(v.a_manifest, v.a_frames), "hours")


@query("alert_rate_report", ["a_manifest", "a_frames", "a_alerts"], f"""
with {_HOURS}, a as (select session_id, count(*) filter (where fired) as n from a_alerts group by 1),
t as (select count(*) as n_sessions, sum(hours) as hours, coalesce(sum(n), 0)::bigint as n_alerts_fired from h full join a using (session_id))
select n_sessions, round(hours, 6) + 0.0 as hours, n_alerts_fired, round(n_alerts_fired / hours, 6) + 0.0 as alerts_per_hour, hours >= 10 as hours_ok,
  n_alerts_fired / hours <= 0.5 as rate_ok, hours >= 10 and n_alerts_fired / hours <= 0.5 as pass from t
""")
def _(v: Views):
    return rounded(reports.alert_rate_report(reports.session_hours(v.a_manifest, v.a_frames), v.a_alerts), "hours", "alerts_per_hour")


@query("alert_rate_sessions", ["a_manifest", "a_frames", "a_alerts"], f"""
with {_HOURS}, a as (select session_id, count(*) filter (where fired) as n from a_alerts group by 1)
select session_id, round(coalesce(hours, 0), 6) + 0.0 as hours, coalesce(n, 0) as n_alerts_fired from h full join a using (session_id)
""")
def _(v: Views):
    return rounded(reports.alert_sessions(reports.session_hours(v.a_manifest, v.a_frames), v.a_alerts), "hours")


_RUNTIME = """
rt as (select session_id, count(*) as n_diag, avg(blur) as mean_blur, count(*) filter (where blur > 0.5) / count(*) as blur_share,
  count(*) filter (where blur < 0.5) / count(*) as usable_frame_share, avg(thermal_c) as mean_thermal_c, count(*) filter (where inferred) as n_inferred,
  list(latency_ms order by latency_ms) as ls from a_frames group by 1),
gy as (select session_id, max(abs(x) + abs(y) + abs(z)) as gyro_peak from a_imu where sensor_type = 'GYRO' group by 1)
"""


def _runtime(v: Views):
    return v.a_frames.withColumn("latency_p95_ms", F.col("latency_ms"))


def _gyro(v: Views):
    return v.a_imu.where("sensor_type = 'GYRO'")


@query("ride_report", ["a_frames", "a_imu", "a_alerts", "a_tracks"], f"""
with {_RUNTIME}, ts as (select session_id, lifecycle_state, count(*) as n from a_tracks group by 1, 2),
tr as (select session_id, string_agg(lifecycle_state || '=' || n, ';' order by lifecycle_state) as track_states, sum(n)::bigint as n_track_rows from ts group by 1),
al as (select session_id, count(*) as n_alert_decisions, count(*) filter (where fired) as n_alerts_fired from a_alerts group by 1)
select s.session_id, track_states, coalesce(n_track_rows, 0) as n_track_rows, coalesce(n_alert_decisions, 0) as n_alert_decisions, coalesce(n_alerts_fired, 0) as n_alerts_fired,
  round(mean_blur, 6) + 0.0 as mean_blur, round(blur_share, 6) + 0.0 as blur_share, round(usable_frame_share, 6) + 0.0 as usable_frame_share, round(mean_thermal_c, 6) + 0.0 as mean_thermal_c,
  coalesce(n_inferred, 0) as n_inferred, ls[1 + round_even(0.95 * (len(ls) - 1), 0)::int] as p95_latency_ms, round(gyro_peak, 6) + 0.0 as gyro_peak
from (select distinct session_id from a_tracks union select session_id from a_frames) s left join tr using (session_id) left join al using (session_id) left join rt using (session_id) left join gy using (session_id)
""")
def _(v: Views):
    s = v.a_tracks.select("session_id").union(v.a_frames.select("session_id"))
    df = reports.ride_report(v.a_tracks, v.a_alerts, _runtime(v), _gyro(v), s)
    states = F.array_join(F.transform(F.map_entries("track_states"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    df = df.withColumn("track_states", states)
    return rounded(df, "mean_blur", "blur_share", "usable_frame_share", "mean_thermal_c", "gyro_peak").select(
        "session_id", "track_states", "n_track_rows", "n_alert_decisions", "n_alerts_fired", "mean_blur", "blur_share", "usable_frame_share",
        "mean_thermal_c", "n_inferred", "p95_latency_ms", "gyro_peak")


@query("damping_ab", ["a_frames", "a_imu"], f"""
with {_RUNTIME}, r as (select session_id, blur_share, gyro_peak from rt left join gy using (session_id)),
p as (select a.session_id as a, b.session_id as b, a.blur_share as x, b.blur_share as y, a.gyro_peak as ga, b.gyro_peak as gb from r a join r b on b.session_id = a.session_id + 1)
select a, b, round(x, 6) + 0.0 as a_blur_share, round(y, 6) + 0.0 as b_blur_share, round(ga, 6) + 0.0 as a_gyro_peak, round(gb, 6) + 0.0 as b_gyro_peak,
 case when y < x then 'B' when x < y then 'A' else 'tie' end as winner_lower_blur_share from p
""")
def _(v: Views):
    rt = reports.runtime_stats(v.a_frames)
    peak = _gyro(v).groupBy("session_id").agg(F.max(F.abs("x") + F.abs("y") + F.abs("z")).alias("gyro_peak"))
    rep = rt.join(peak, "session_id", "left").select("session_id", "blur_share", "gyro_peak")
    ids = rep.select("session_id")
    pairs = ids.select(F.col("session_id").alias("a"), (F.col("session_id") + 1).alias("b")).join(ids.select(F.col("session_id").alias("b")), "b").select("a", "b")
    return rounded(reports.damping_pairs(rep, pairs), "a_blur_share", "b_blur_share", "a_gyro_peak", "b_gyro_peak")


@query("model_ab", ["a_tracks"], """
with c as (select variant, count(*) as n, arg_min(distance_m, (timestamp_ns, seq, price)) as d from a_tracks where lifecycle_state in ('CONFIRMED', 'ALERTED') group by 1),
f as (select variant, count(*) as n from a_tracks where effective_confidence > 0.9 and lifecycle_state in ('CONFIRMED', 'ALERTED') group by 1)
select fa.n as a_n_alerts, ca.n as a_n_confirmed_track_frames, ca.d as a_first_confirm_m, fb.n as b_n_alerts, cb.n as b_n_confirmed_track_frames, cb.d as b_first_confirm_m,
 fb.n - fa.n as delta_n_alerts, cb.n - ca.n as delta_n_confirmed_track_frames
from f fa, f fb, c ca, c cb where fa.variant = 'A' and ca.variant = 'A' and fb.variant = 'N' and cb.variant = 'N'
""")
def _(v: Views):
    t = v.a_tracks
    fired = t.select("variant", ((F.col("effective_confidence") > 0.9) & F.col("lifecycle_state").isin("CONFIRMED", "ALERTED")).alias("fired"))
    return reports.model_ab(t, fired, a="A", b="N")


@query("crash_scan", ["a_imu"], """
with a as (select *, row_number() over (partition by session_id order by event_id) as rn, abs(sqrt(x*x + y*y + z*z) - 9.81) as res from a_imu where sensor_type = 'ACCEL')
select session_id, count(*) as n_samples, count(*) filter (where res >= 5) as n_hits, arg_min(timestamp_ns, event_id) filter (where res >= 5) as first_hit_ns,
  round(max(res) filter (where res >= 5), 6) + 0.0 as max_residual from a group by 1
""")
def _(v: Views):
    from ridelens.config import ImpactConfig
    df = reports.crash_scan(v.a_imu.where("sensor_type = 'ACCEL'"), cfg=ImpactConfig(residual_threshold=5.0))
    return rounded(df, "max_residual").drop("used_for_alert")


@query("harvest_impact_windows", ["a_imu"], """
select event_id, session_id, timestamp_ns, round(least(1, abs(z - 9.81) / 12), 6) + 0.0 as impact_score from a_imu where sensor_type = 'ACCEL' and abs(z - 9.81) >= 3.5
""")
def _(v: Views):
    df = reports.harvest_impact_windows(v.a_imu.where("sensor_type = 'ACCEL'"))
    return rounded(df, "impact_score").select("event_id", "session_id", "timestamp_ns", "impact_score")


@query("impact_near_tracks", ["ev", "a_imu"], """
with sp as (select event_id, session_id, timestamp_ns, round(least(1, abs(z - 9.81) / 12), 6) + 0.0 as impact_score from a_imu where sensor_type = 'ACCEL' and abs(z - 9.81) >= 3.5),
tk as (select distinct session_id, t_ns, k % 40 as track_id from ev where event_type = 'purchase'),
m as (select event_id, list(distinct track_id order by track_id) as ids from sp join tk on tk.session_id = sp.session_id and tk.t_ns between timestamp_ns - 60000000000 and timestamp_ns + 60000000000 group by 1)
select event_id, session_id, timestamp_ns, impact_score, coalesce(array_to_string(ids, ','), '') as near_track_ids from sp left join m using (event_id)
""")
def _(v: Views):
    seen = v.ev.where("event_type = 'purchase'").select("session_id", F.col("t_ns").alias("timestamp_ns"), (F.col("k") % 40).alias("track_id"))
    df = reports.harvest_impact_windows(v.a_imu.where("sensor_type = 'ACCEL'"), near=seen, near_ns=60_000_000_000)
    return rounded(df, "impact_score").select("event_id", "session_id", "timestamp_ns", "impact_score", F.array_join(F.col("near_track_ids").cast("array<string>"), ",").alias("near_track_ids"))


# tracks seen at event times, so that accelerometer samples follow them
_FUT = """
tk as (select session_id, k % 40 as track_id, t_ns as timestamp_ns, event_id as seq, case k % 4 when 0 then 'CONFIRMED' when 1 then 'ALERTED' else 'TRACKED' end as lifecycle_state,
   case when k % 6 = 0 then null else (k % 60)::double end as distance_m, case when k % 3 = 0 then null else (k % 23)::double end as own,
   ['concave', 'convex', 'rough', 'step', 'flat', 'unknown'][1 + event_id % 6] as geometry_type, ['pothole', 'repair_patch', 'road_joint', 'gravel'][1 + k % 4] as semantic_type
   from ev where event_type = 'view'),
sp as (select session_id, list(speed_mps order by speed_mps)[1 + count(*) // 2] as ds from a_location group by 1),
fi as (select * from tk where lifecycle_state <> 'TRACKED' qualify row_number() over (partition by session_id, track_id order by timestamp_ns, seq) = 1),
s0 as (select fi.*, coalesce(ds, 0) as ds, coalesce(own, ds, 0) as o from fi left join sp using (session_id)),
s1 as (select *, case when o < 2 and ds >= 2 then ds else o end as v from s0),
s2 as (select *, case when distance_m is not null and distance_m / v between 0 and 3.75 then distance_m / v end as tp from s1 where v >= 2),
s3 as (select *, case when tp is null then timestamp_ns else timestamp_ns + trunc(greatest(0, tp - 0.4) * 1e9)::bigint end as w0,
         case when tp is null then timestamp_ns + 3000000000 else timestamp_ns + trunc((tp + 0.4) * 1e9)::bigint end as w1 from s2),
al as (select s3.session_id, s3.track_id, max(abs(z - 9.81)) as p, avg(pow(abs(z - 9.81), 2)) as q, count(*) as n from s3 join a_imu i
   on i.sensor_type = 'ACCEL' and i.session_id = s3.session_id and i.timestamp_ns between w0 and w1 group by 1, 2),
fu as (select s3.session_id, s3.track_id, s3.timestamp_ns, tp, v, geometry_type, semantic_type, coalesce(p, 0) as p, coalesce(sqrt(q), 0) as rms, coalesce(n, 0) as n,
   case when coalesce(p, 0) / greatest(v / 10, 0.35) < 2 then 'none' when coalesce(p, 0) / greatest(v / 10, 0.35) < 4 then 'weak' when coalesce(p, 0) / greatest(v / 10, 0.35) < 7 then 'medium' else 'strong' end as lab
   from s3 left join al using (session_id, track_id))
"""


def _future(v: Views):
    k = F.col("k")
    geo, sem = ("concave", "convex", "rough", "step", "flat", "unknown"), ("pothole", "repair_patch", "road_joint", "gravel")

    def pick(names, i):
        return F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    tr = v.ev.where("event_type = 'view'").select(
        "session_id", (k % 40).alias("track_id"), F.col("t_ns").alias("timestamp_ns"), F.col("event_id").alias("seq"),
        F.when(k % 4 == 0, "CONFIRMED").when(k % 4 == 1, "ALERTED").otherwise("TRACKED").alias("lifecycle_state"),
        F.when(k % 6 != 0, (k % 60).cast("double")).alias("distance_m"), F.when(k % 3 != 0, (k % 23).cast("double")).alias("own_speed_mps"),
        pick(geo, F.col("event_id") % 6).alias("geometry_type"), pick(sem, k % 4).alias("semantic_type"))
    return reports.align_future_impact(tr, v.a_imu.where("sensor_type = 'ACCEL'"), speeds=reports.upper_median_speed(v.a_location), order=("timestamp_ns", "seq"))


@query("align_future_impact", ["ev", "a_imu", "a_location"], f"""
with {_FUT} select session_id, track_id, timestamp_ns, round(tp, 6) + 0.0 as expected_pass_s, round(v, 6) + 0.0 as speed_mps, round(p, 6) + 0.0 as peak_ms2, round(rms, 6) + 0.0 as rms_ms2,
  n as n_imu, lab as impact_label from fu
""")
def _(v: Views):
    df = rounded(_future(v), "expected_pass_s", "speed_mps", "peak_ms2", "rms_ms2")
    return df.select("session_id", "track_id", "timestamp_ns", "expected_pass_s", "speed_mps", "peak_ms2", "rms_ms2", "n_imu", "impact_label")


@query("impact_report", ["ev", "a_imu", "a_location"], f"""
with {_FUT}, g as (select session_id, count(*) as n_aligned, count(*) filter (where lab = 'none') as n_none, count(*) filter (where lab = 'weak') as n_weak,
  count(*) filter (where lab = 'medium') as n_medium, count(*) filter (where lab = 'strong') as n_strong,
  count(*) filter (where geometry_type in ('concave', 'convex', 'rough', 'step')) as n_relief,
  count(*) filter (where semantic_type in ('repair_patch', 'road_joint') or geometry_type = 'flat') as n_patch,
  avg(p) filter (where geometry_type in ('concave', 'convex', 'rough', 'step')) as r, avg(p) filter (where semantic_type in ('repair_patch', 'road_joint') or geometry_type = 'flat') as q from fu group by 1)
select session_id, n_aligned, n_none, n_weak, n_medium, n_strong, n_relief, n_patch, round(r, 6) + 0.0 as mean_relief_peak_ms2, round(q, 6) + 0.0 as mean_patch_peak_ms2,
  round(r - q, 6) + 0.0 as delta_ms2, coalesce(r - q > 0.5, false) as pass from g
""")
def _(v: Views):
    df = rounded(reports.impact_report(_future(v)), "mean_relief_peak_ms2", "mean_patch_peak_ms2", "delta_ms2")
    return df.drop("used_for_alert")


@query("upper_median_speed", ["a_location"], """
select session_id, list(speed_mps order by speed_mps)[1 + count(*) // 2] as speed_mps from a_location group by 1
""")
def _(v: Views):
    return reports.upper_median_speed(v.a_location)


_DIAG = """
b as (select slice, correct, confidence as c, least((select max(i) from range(10) r(i) where i * 0.1::double <= confidence), 9) as bin from a_calib),
g as (select slice, bin, count(*) as n, avg(correct) as acc, avg(c) as conf from b group by 1, 2)
"""


@query("reliability_diagram", ["a_calib"], f"""
with {_DIAG} select s.slice, i::int as bin, round(i * 0.1::double, 6) + 0.0 as lo, round((i + 1) * 0.1::double, 6) + 0.0 as hi, coalesce(n, 0) as n, round(acc, 6) + 0.0 as acc, round(conf, 6) + 0.0 as conf
from (select distinct slice from a_calib) s cross join range(10) r(i) left join g on g.slice = s.slice and g.bin = i
""")
def _(v: Views):
    return rounded(reports.reliability_diagram(v.a_calib, keys=["slice"]), "lo", "hi", "acc", "conf")


@query("calibration_error", ["a_calib"], f"""
with {_DIAG} select slice, sum(n)::bigint as n, round(sum(abs(acc - conf) * n) / sum(n), 6) + 0.0 as ece from g group by 1
""")
def _(v: Views):
    return rounded(reports.calibration_error(reports.reliability_diagram(v.a_calib, keys=["slice"]), keys=["slice"]), "ece")


_HN = """
hn as (select semantic_type as slice, lifecycle_state, effective_confidence as c, (price % 7) / 7.0 as alert_score, lifecycle_state = 'ALERTED' and semantic_type in ('pothole', 'gravel') as fired from a_tracks),
hb as (select slice, (alert_score < 0.62)::int as y, c, least((select max(i) from range(10) r(i) where i * 0.1::double <= c), 9) as bin from hn),
hg as (select slice, bin, count(*) as n, avg(y) as acc, avg(c) as conf from hb group by 1, 2),
he as (select slice, sum(n)::bigint as n, sum(abs(acc - conf) * n) / sum(n) as ece from hg group by 1),
hr as (select slice, count(*) filter (where fired) as n_alerts_fired, count(*) filter (where lifecycle_state in ('CONFIRMED', 'ALERTED')) as n_confirmed_rows from hn group by 1)
"""


def _hard(v: Views):
    t = v.a_tracks.select(F.col("semantic_type").alias("slice"), "lifecycle_state", "effective_confidence", ((F.col("price") % 7) / 7.0).alias("alert_score"))
    a = t.select("slice", ((F.col("lifecycle_state") == "ALERTED") & F.col("slice").isin("pothole", "gravel")).alias("fired"))
    return reports.hard_negative_report(t, a)


@query("hard_negative_report", ["a_tracks"], f"""
with {_HN} select slice, n_alerts_fired, n_confirmed_rows, n_alerts_fired = 0 as pass, n as n_scored, round(ece, 6) + 0.0 as ece from hr join he using (slice)
""")
def _(v: Views):
    return rounded(_hard(v), "ece")


@query("hard_negative_summary", ["a_tracks"], f"""
with {_HN} select sum(n_alerts_fired)::bigint as n_alerts_fired, sum(n_confirmed_rows)::bigint as n_confirmed_rows, bool_and(n_alerts_fired = 0) as pass from hr
""")
def _(v: Views):
    return reports.hard_negative_summary(_hard(v))


# --- ground truth --------------------------------------------------------------------------------------------

_MATCH = """
gg as (select frame, id, cx, cy, distance_m as gd, x_m, semantic, slice, row_number() over (partition by frame, id order by distance_m) as dup from a_gt),
tb as (select t.*, x0, y0, x1, y1 from a_tracks t join a_boxes b on b.image = t.frame and b.seq = t.seq and b.price = t.price),
pp as (select g.slice, g.frame, g.id, gd, x_m, semantic, t.track_id, t.lifecycle_state, t.distance_m, t.distance_valid, t.direction,
   pow((x0 + x1) / 2 - cx, 2) + pow((y0 + y1) / 2 - cy, 2) as d2, t.seq, t.price from gg g join tb t on g.frame = t.frame),
mt as (select * from pp where d2 <= 19600 qualify row_number() over (partition by frame, id order by d2, seq, price) = 1),
tsl as (select t.*, g.slice from a_tracks t join (select distinct frame, slice from a_gt) g using (frame)),
sw as (select slice, id, count(*) as n_matches, count(*) filter (where p is not null and p <> track_id) as switches from (
   select *, lag(track_id) over (partition by slice, id order by frame) as p from mt where lifecycle_state in ('CONFIRMED', 'ALERTED', 'TRACKED')) group by 1, 2)
"""


def _matches(v: Views):
    t = v.a_tracks.select("frame", "track_id", "seq", "price", "lifecycle_state", "distance_m", "distance_valid", "direction")
    b = v.a_boxes.select(F.col("image").alias("frame"), "seq", "price", ((F.col("x0") + F.col("x1")) / 2).alias("tx"), ((F.col("y0") + F.col("y1")) / 2).alias("ty"))
    tr = t.join(b, ["frame", "seq", "price"])
    gt = v.a_gt.withColumnRenamed("distance_m", "gt_distance_m")
    m = spatial.match_gt(gt, tr, order=("seq", "price"), gt_cols=("slice", "id", "gt_distance_m", "x_m", "semantic"),
                         track_cols=("track_id", "lifecycle_state", "distance_m", "distance_valid", "direction"))
    return m


def _sliced(v: Views):
    return v.a_tracks.join(v.a_gt.select("frame", "slice").distinct(), "frame")


_SOLID = "lifecycle_state in ('CONFIRMED', 'ALERTED', 'TRACKED')"


@query("id_switches", ["a_gt", "a_tracks", "a_boxes"], f"with {_MATCH} select slice, id, n_matches, switches from sw")
def _(v: Views):
    return tracks.id_switches(_matches(v).where(_SOLID))


_GOLD = _MATCH + """,
z as (select slice, count(distinct id) as action_zone_n from a_gt where distance_m between 5 and 15 group by 1),
cf as (select distinct slice, id from mt where lifecycle_state in ('CONFIRMED', 'ALERTED')),
zh as (select slice, count(*) as h from (select distinct slice, id from a_gt where distance_m between 5 and 15 intersect select slice, id from cf) group by 1),
fc as (select slice, id, arg_min(gd, frame) as d from mt where lifecycle_state in ('CONFIRMED', 'ALERTED') group by 1, 2),
fm as (select slice, quantile_cont(d, 0.5) as first_confirm_median_m, count(*) as n_first_confirm from fc group by 1),
cr as (select slice, count(*) filter (where lifecycle_state = 'CONFIRMED') as confirmed, count(*) filter (where lifecycle_state = 'CANDIDATE') as candidates from tsl group by 1),
fs as (select slice, count(*) as false_solid_count from (select distinct slice, track_id from tsl where lifecycle_state in ('CONFIRMED', 'ALERTED') except select slice, track_id from mt) group by 1),
ms as (select slice, count(*) as direction_total, count(*) filter (where direction = want or (want = 'CENTER_FRONT' and direction = 'ACROSS')) as direction_correct,
   avg(case when distance_valid then abs(distance_m - gd) end) as mae from (select *, case when semantic = 'speed_bump' or abs(x_m) <= 0.85 * 0.72 then 'CENTER_FRONT' when x_m < 0 then 'LEFT_FRONT' else 'RIGHT_FRONT' end as want
     from mt where lifecycle_state in ('CONFIRMED', 'ALERTED', 'TRACKED')) group by 1),
nf as (select slice, count(distinct frame) as frames from a_gt group by 1),
gm as (select nf.slice, frames, confirmed, candidates, direction_correct / direction_total as da, mae, sws.n as id_switches_est, coalesce(n_first_confirm, 0) as n_first_confirm, first_confirm_median_m,
   coalesce(h, 0) as action_zone_hits, action_zone_n, coalesce(false_solid_count, 0) as false_solid_count
   from nf left join cr using (slice) left join ms using (slice) left join fm using (slice) left join z using (slice) left join zh using (slice) left join fs using (slice)
   left join (select slice, sum(switches)::bigint as n from sw group by 1) sws using (slice))
"""


def _golden(v: Views):
    m = cut_lineage(_matches(v))  # shared by all metrics, written once and dropped with the last reference
    return reports.golden_metrics(v.a_gt, _sliced(v), m, tracks.id_switches(m.where(_SOLID)))


@query("golden_metrics", ["a_gt", "a_tracks", "a_boxes"], f"""
with {_GOLD} select slice, frames, confirmed, candidates, round(da, 6) + 0.0 as direction_accuracy, round(mae, 6) + 0.0 as distance_mae_m, id_switches_est, n_first_confirm,
  round(first_confirm_median_m, 6) + 0.0 as first_confirm_median_m, action_zone_hits, action_zone_n, false_solid_count, round(false_solid_count / (frames / 30 / 60), 6) + 0.0 as false_solid_per_min from gm
""")
def _(v: Views):
    df = rounded(_golden(v), "direction_accuracy", "distance_mae_m", "first_confirm_median_m", "false_solid_per_min")
    return df.select("slice", "frames", "confirmed", "candidates", "direction_accuracy", "distance_mae_m", "id_switches_est", "n_first_confirm",
                     "first_confirm_median_m", "action_zone_hits", "action_zone_n", "false_solid_count", "false_solid_per_min")


@query("acceptance_gates", ["a_gt", "a_tracks", "a_boxes"], f"""
with {_GOLD} select slice, da >= 0.95 as direction_ge_95, mae <= 2.5 as distance_mae_5_15_le_2_5, n_first_confirm > 0 as has_first_confirm, da >= 0.95 and mae <= 2.5 as pass from gm
""")
def _(v: Views):
    return reports.acceptance_gates(_golden(v)).select("slice", "direction_ge_95", "distance_mae_5_15_le_2_5", "has_first_confirm", "pass")


@query("action_zone_hits", ["a_gt", "a_tracks", "a_boxes"], f"with {_GOLD} select slice, action_zone_hits, action_zone_n from gm")
def _(v: Views):
    conf = _matches(v).where(F.col("lifecycle_state").isin("CONFIRMED", "ALERTED"))
    return reports.action_zone_hits(v.a_gt, conf)


@query("false_solids", ["a_gt", "a_tracks", "a_boxes"], f"""
with {_MATCH} select distinct slice, track_id from tsl where lifecycle_state in ('CONFIRMED', 'ALERTED') except select slice, track_id from mt
""")
def _(v: Views):
    return reports.false_solids(_sliced(v), _matches(v))


@query("metric_delta", ["a_gt", "a_tracks", "a_boxes"], f"""
with {_GOLD} select a.slice, round(b.da - a.da, 6) + 0.0 as delta_direction_accuracy, round(b.mae - a.mae, 6) + 0.0 as delta_distance_mae_m
from gm a join gm b on b.slice = (a.slice + 1) % 6
""")
def _(v: Views):
    g = _golden(v).select("slice", "direction_accuracy", "distance_mae_m")
    nxt = g.withColumn("slice", (F.col("slice") + 5) % 6)
    df = reports.metric_delta(g, nxt, on=["slice"], metrics=["direction_accuracy", "distance_mae_m"])
    return rounded(df, "delta_direction_accuracy", "delta_distance_mae_m")


_SUM = """
pt as (select session_id, track_id, count(*) filter (where c) as n, arg_min(semantic_type, (timestamp_ns, seq, price)) filter (where c) as sem,
   arg_min(distance_m, (timestamp_ns, seq, price)) filter (where c and distance_valid) as d, bool_or(c and direction <> 'UNKNOWN') as dir
   from (select *, lifecycle_state in ('CONFIRMED', 'ALERTED') as c from a_tracks) group by 1, 2),
ag as (select session_id, count(*) as n_unique_tracks, count(*) filter (where n > 0) as n_confirmed_tracks, sum(n)::bigint as n_confirmed_rows, count(*) filter (where sem = 'rough_broken') as n_rough_broken_confirmed,
   count(*) filter (where sem in ('puddle', 'gravel')) as n_info_confirmed, count(*) filter (where sem in ('pothole', 'speed_bump', 'manhole_cover')) as n_bump_confirmed,
   count(d) as n_confirmed_with_distance, count(*) filter (where dir) as n_confirmed_with_direction, quantile_cont(d, 0.5) as med from pt group by 1),
fr as (select session_id, count(*) as frames, avg(blur) as mean_blur, avg(glare) as mean_glare, avg(k * 2.0) as mean_luma, avg((k % 4 > 0)::int) as road_frame_share from a_frames group by 1),
al as (select session_id, count(*) as n_alerts_fired from a_alerts where fired group by 1),
rs as (select *, frames / 30 as duration_s, n_confirmed_tracks / (frames / 30) * 60 as cpm, case when mean_luma < 105 then 'night' else 'day' end as lighting from fr left join ag using (session_id) left join al using (session_id))
"""


def _runs(v: Views):
    f = v.a_frames.select("session_id", "blur", "glare", (F.col("k") * 2.0).alias("luma"), (F.col("k") % 4 > 0).alias("has_road"), (F.col("k") % 5 == 0).alias("has_occlusion"))
    return reports.run_summary(v.a_tracks, f, v.a_alerts)


@query("run_summary", ["a_tracks", "a_frames", "a_alerts"], f"""
with {_SUM} select session_id, frames, n_unique_tracks, n_confirmed_tracks, n_unique_tracks - n_confirmed_tracks as n_unconfirmed_tracks, n_confirmed_rows, n_alerts_fired, n_rough_broken_confirmed, n_info_confirmed, n_bump_confirmed,
 n_confirmed_with_distance, n_confirmed_with_direction, round(med, 6) + 0.0 as first_confirm_median_m, round(cpm, 6) + 0.0 as confirmed_per_min, round(mean_blur, 6) + 0.0 as mean_blur,
 round(mean_glare, 6) + 0.0 as mean_glare, round(mean_luma, 6) + 0.0 as mean_luma, round(road_frame_share, 6) + 0.0 as road_frame_share, lighting from rs
""")
def _(v: Views):
    cols = ("first_confirm_median_m", "confirmed_per_min", "mean_blur", "mean_glare", "mean_luma", "road_frame_share")
    df = rounded(_runs(v), *cols)
    return df.select("session_id", "frames", "n_unique_tracks", "n_confirmed_tracks", "n_unconfirmed_tracks", "n_confirmed_rows", "n_alerts_fired", "n_rough_broken_confirmed",
                     "n_info_confirmed", "n_bump_confirmed", "n_confirmed_with_distance", "n_confirmed_with_direction", *cols, "lighting")


_GATE = """
rg as (select l_orderkey // 4 as run_id, case l_orderkey % 3 when 0 then 'night_25013' when 1 then 'day_25007' else 'extra' end as alias, count(*) as frames, count(*) filter (where l_suppkey % 5 = 0) as nc,
  count(*) filter (where l_suppkey % 5 = 0 and l_suppkey % 7 = 0) as ni, count(*) filter (where l_partkey % 31 = 0) as nb, count(*) filter (where l_partkey % 37 = 0) as nr, count(*) filter (where l_discount > 0.09) as na,
  avg((l_tax > 0.07)::int) as road, max(l_linenumber) > 1 as ok from lineitem group by 1, 2),
ck as (select *, greatest(nc - ni - nb, 0) as solid, alias like 'night%' as ng, alias like 'day%' as dy from rg),
fg as (select run_id, alias, solid, ok and frames > 0 and (not ng or (solid = 0 and nr = 0)) and (not ng or nb > 0 or na = 0) and (not dy or road >= 0.05) as pass,
  2 + case when ng then 2 else 0 end + case when ng and nb = 0 then 1 else 0 end + case when dy then 1 else 0 end as n_checks from ck)
"""


def _field(v: Views):
    li = v.lineitem.withColumn("run_id", F.floor(F.col("l_orderkey") / 4)).withColumn(
        "alias", F.when(F.col("l_orderkey") % 3 == 0, "night_25013").when(F.col("l_orderkey") % 3 == 1, "day_25007").otherwise("extra"))
    conf = F.col("l_suppkey") % 5 == 0
    runs = li.groupBy("run_id", "alias").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(conf).alias("n_confirmed_tracks"), F.count_if(conf & (F.col("l_suppkey") % 7 == 0)).alias("n_info_confirmed"),
        F.count_if(F.col("l_partkey") % 31 == 0).alias("n_bump_confirmed"), F.count_if(F.col("l_partkey") % 37 == 0).alias("n_rough_broken_confirmed"),
        F.count_if(F.col("l_discount") > 0.09).alias("n_alerts_fired"), F.avg((F.col("l_tax") > 0.07).cast("int")).alias("road_frame_share"), (F.max("l_linenumber") > 1).alias("overlay_ok"))
    return reports.field_gates(runs)


@query("field_gates", None, f"with {_GATE} select run_id, alias, solid as n_solid_confirmed, pass, n_checks from fg")
def _(v: Views):
    return _field(v).select("run_id", "alias", "n_solid_confirmed", "pass", F.size("checks").cast("int").alias("n_checks"))


@query("field_report", None, f"with {_GATE} select count(*) as n_clips, bool_and(pass) as pass from fg")
def _(v: Views):
    return reports.field_report(_field(v))


@query("segmentation_scores", ["a_pixels"], """
select slice, count(*) as n_pixels, round(avg((pred = gt)::int), 6) + 0.0 as pixel_acc,
  round(count(*) filter (where pred = 0 and gt = 0) / count(*) filter (where pred = 0 or gt = 0), 6) + 0.0 as iou_0, round(count(*) filter (where pred = 1 and gt = 1) / count(*) filter (where pred = 1 or gt = 1), 6) + 0.0 as iou_1,
  round(count(*) filter (where pred = 2 and gt = 2) / count(*) filter (where pred = 2 or gt = 2), 6) + 0.0 as iou_2, round(count(*) filter (where pred = 3 and gt = 3) / count(*) filter (where pred = 3 or gt = 3), 6) + 0.0 as iou_3
from a_pixels group by 1
""")
def _(v: Views):
    return rounded(reports.segmentation_scores(v.a_pixels), "pixel_acc", "iou_0", "iou_1", "iou_2", "iou_3")

