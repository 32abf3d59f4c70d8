"""Joins in time and in image space."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridelens.catalog.registry import Views, query, rounded
from ridelens.operators import spatial, timejoin
from ridelens.operators.curation import match_clip_spec

# prev / next sample of every frame in DuckDB
_NEAR = """
near as (select f.session_id, f.event_id, f.sensor_timestamp_ns as t, p.timestamp_ns as t0, n.timestamp_ns as t1, {cols}
  from {left} f asof left join {right} p on f.session_id = p.session_id and f.sensor_timestamp_ns >= p.timestamp_ns
  asof left join {right} n on f.session_id = n.session_id and f.sensor_timestamp_ns <= n.timestamp_ns)
"""
_GYRO = "g as (select * from a_imu where sensor_type = 'GYRO')"


def _lerp(c: str) -> str:
    return (f"case when t0 is null then {c}1 when t1 is null then {c}0 when t0 = t then {c}0 "
            f"else (1 - (t - t0) / greatest(t1 - t0, 1)) * {c}0 + (t - t0) / greatest(t1 - t0, 1) * {c}1 end")


@query("interp_linear", ["a_frames", "a_imu"], f"""
with {_GYRO}, {_NEAR.format(left='a_frames', right='g', cols='p.x as x0, p.y as y0, p.z as z0, n.x as x1, n.y as y1, n.z as z1')}
select session_id, event_id, round({_lerp('x')}, 6) + 0.0 as x, round({_lerp('y')}, 6) + 0.0 as y, round({_lerp('z')}, 6) + 0.0 as z from near
""")
def _(v: Views):
    f = v.a_frames.select("session_id", "event_id", "sensor_timestamp_ns")
    df = timejoin.interp_linear(f, v.a_imu.where("sensor_type = 'GYRO'"), ["x", "y", "z"], tie=["event_id"])
    return rounded(df, "x", "y", "z").drop("sensor_timestamp_ns")


# quaternions: yaw in 15° steps and roll signs from k, so neighbours do change hemisphere
_POSE = """
po as (select session_id, event_id, timestamp_ns, 0.0::double as qx0, 0.0::double as qy0,
        sin((event_id * 7 % 48) * pi() / 24) as qz0, cos((event_id * 7 % 48) * pi() / 24) as qw0 from a_imu where sensor_type = 'ROTATION_VECTOR'),
u as (select *, qz0 / greatest(sqrt(qz0*qz0 + qw0*qw0), 1e-9) as z, qw0 / greatest(sqrt(qz0*qz0 + qw0*qw0), 1e-9) as w,
        row_number() over (partition by session_id order by timestamp_ns, event_id) as rn from po)
"""


@query("interp_quaternion", ["a_frames", "a_imu"], f"""
recursive {_POSE},
c as (select session_id, event_id, timestamp_ns, rn, z, w from u where rn = 1
      union all
      select u.session_id, u.event_id, u.timestamp_ns, u.rn, case when c.z*u.z + c.w*u.w < 0 then -u.z else u.z end,
             case when c.z*u.z + c.w*u.w < 0 then -u.w else u.w end from c join u on u.session_id = c.session_id and u.rn = c.rn + 1),
near as (select f.session_id, f.event_id, f.sensor_timestamp_ns as t, p.timestamp_ns as t0, n.timestamp_ns as t1, p.z as z0, p.w as w0, n.z as z1, n.w as w1
  from a_frames f asof left join c p on f.session_id = p.session_id and f.sensor_timestamp_ns >= p.timestamp_ns
  asof left join c n on f.session_id = n.session_id and f.sensor_timestamp_ns <= n.timestamp_ns),
m as (select *, (t - t0) / greatest(t1 - t0, 1) as a, least(greatest(z0*z1 + w0*w1, -1), 1) as d from near),
s as (select *, case when d > 0.9995 then z0 + a*(z1 - z0) else (sin((1-a)*acos(d))*z0 + sin(a*acos(d))*z1) / sin(acos(d)) end as mz,
        case when d > 0.9995 then w0 + a*(w1 - w0) else (sin((1-a)*acos(d))*w0 + sin(a*acos(d))*w1) / sin(acos(d)) end as mw from m)
select session_id, event_id, round(case when t0 is null then z1 when t1 is null or t0 = t then z0 else mz / sqrt(mz*mz + mw*mw) end, 6) + 0.0 as qz,
  round(case when t0 is null then w1 when t1 is null or t0 = t then w0 else mw / sqrt(mz*mz + mw*mw) end, 6) + 0.0 as qw from s
""")
def _(v: Views):
    f = v.a_frames.select("session_id", "event_id", "sensor_timestamp_ns")
    half = (F.col("event_id") * 7 % 48) * F.pi() / 24
    poses = v.a_imu.where("sensor_type = 'ROTATION_VECTOR'").select(
        "session_id", "timestamp_ns", F.col("event_id").alias("pose_id"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"), F.cos(half).alias("qw"))
    df = timejoin.interp_quaternion(f, poses, tie=["pose_id"])
    return rounded(df, "qz", "qw").select("session_id", "event_id", "qz", "qw")


def _soft(c: str) -> str:
    a, b = f"p.{c}", f"n.{c}"
    return (f"case when inside then case when {a} is null then {b} when {b} is null then {a} else {a} + ({b} - {a}) * u end "
            f"when p.timestamp_ns is not null then {a} else {b} end")


@query("interp_location", ["a_frames", "a_location"], f"""
with j as (select f.session_id, f.event_id, f.sensor_timestamp_ns as t, p, n from a_frames f
  asof left join a_location p on f.session_id = p.session_id and f.sensor_timestamp_ns >= p.timestamp_ns
  asof left join a_location n on f.session_id = n.session_id and f.sensor_timestamp_ns <= n.timestamp_ns),
k as (select *, coalesce(p.timestamp_ns < t and n.timestamp_ns is not null, false) as inside, greatest(n.timestamp_ns - p.timestamp_ns, 1) as span from j),
m as (select *, (t - p.timestamp_ns) / span as u from k)
select session_id, event_id, round({_soft('latitude')}, 6) + 0.0 as latitude, round({_soft('longitude')}, 6) + 0.0 as longitude,
  round({_soft('altitude')}, 6) + 0.0 as altitude, round({_soft('speed_mps')}, 6) + 0.0 as speed_mps,
  round({_soft('horizontal_accuracy_m')}, 6) + 0.0 as horizontal_accuracy_m,
  round(case when inside then (p.bearing_deg + ((n.bearing_deg - p.bearing_deg + 540) % 360 - 180) * u + 720) % 360
     when p.timestamp_ns is not null then p.bearing_deg else n.bearing_deg end, 6) + 0.0 as bearing_deg,
  round(case when inside then coalesce({_soft('speed_accuracy_mps')}, 0.4) * (1 + span / 1e9 * 2) else {_soft('speed_accuracy_mps')} end, 6) + 0.0 as speed_accuracy_mps,
  inside as interpolated from m
""")
def _(v: Views):
    f = v.a_frames.select("session_id", "event_id", "sensor_timestamp_ns")
    df = timejoin.interp_location(f, v.a_location, tie=["event_id"])
    return rounded(df, "latitude", "longitude", "altitude", "speed_mps", "horizontal_accuracy_m", "bearing_deg", "speed_accuracy_mps").drop("sensor_timestamp_ns")


@query("synchronize_frames", ["a_frames", "a_imu", "a_location"], f"""
with {_GYRO}, a as (select * from a_imu where sensor_type = 'ACCEL'),
ng as (select * from (with {_NEAR.format(left='a_frames', right='g', cols='p.x as x0, n.x as x1')} select session_id, event_id, {_lerp('x')} as gyro_x from near)),
na as (select * from (with {_NEAR.format(left='a_frames', right='a', cols='p.z as z0, n.z as z1')} select session_id, event_id, {_lerp('z')} as accel_z from near)),
nl as (select * from (with {_NEAR.format(left='a_frames', right='a_location', cols='p.speed_mps as s0, n.speed_mps as s1')} select session_id, event_id, {_lerp('s')} as sp from near))
select f.session_id, f.event_id, round(gyro_x, 6) + 0.0 as gyro_x, round(accel_z, 6) + 0.0 as accel_z,
  round(coalesce(case when f.k % 4 = 0 then null else f.k / 5.0 end, sp), 6) + 0.0 as speed_mps
from a_frames f join ng using (session_id, event_id) join na using (session_id, event_id) join nl using (session_id, event_id)
""")
def _(v: Views):
    f = v.a_frames.select("session_id", F.col("event_id").alias("frame_event"), "sensor_timestamp_ns",
                          F.when(F.col("k") % 4 == 0, None).otherwise(F.col("k") / 5.0).alias("speed_mps"))
    imu = v.a_imu
    df = timejoin.synchronize_frames(f, imu.where("sensor_type = 'GYRO'"), imu.where("sensor_type = 'ACCEL'"), v.a_location, tie=["event_id"])
    return rounded(df, "gyro_x", "accel_z", "speed_mps").select("session_id", F.col("frame_event").alias("event_id"), "gyro_x", "accel_z", "speed_mps")


_IDX = """ix as (select session_id, event_id, sensor_timestamp_ns, row_number() over (partition by session_id order by event_id) - 1 as i from {src})"""
# frames of clicks and views only, so that alerts fall between frames
_SPARSE = _IDX.format(src="a_frames")


def _frames(v: Views):
    return timejoin.number_frames(v.a_frames.select("session_id", "event_id", "sensor_timestamp_ns"))


@query("nearest_frame", ["a_frames", "a_alerts"], f"""
with {_SPARSE}, e as (select * from a_alerts where fired),
c as (select e.session_id, e.event_id, e.timestamp_ns, p.i as pi, e.timestamp_ns - p.sensor_timestamp_ns as pd, n.i as ni, n.sensor_timestamp_ns - e.timestamp_ns as nd
  from e asof left join ix p on e.session_id = p.session_id and e.timestamp_ns >= p.sensor_timestamp_ns
  asof left join ix n on e.session_id = n.session_id and e.timestamp_ns <= n.sensor_timestamp_ns)
select session_id, event_id, case when pd is null then ni when nd is null then pi when nd < pd then ni else pi end as frame_index from c
""")
def _(v: Views):
    ev = v.a_alerts.where("fired").select("session_id", "event_id", "timestamp_ns")
    return timejoin.nearest_frame(ev, _frames(v)).select("session_id", "event_id", "frame_index")


@query("imu_window", ["a_frames", "a_imu"], f"""
with {_SPARSE}
select ix.session_id, i as frame_index, m.event_id as sample_id, m.sensor_type from ix join a_imu m
  on m.session_id = ix.session_id and abs(m.timestamp_ns - ix.sensor_timestamp_ns) < 1500000000
""")
def _(v: Views):
    imu = v.a_imu.select("session_id", F.col("event_id").alias("sample_id"), "timestamp_ns", "sensor_type")
    df = timejoin.imu_window(_frames(v).drop("event_id"), imu, half_ns=1_500_000_000, order=("sample_id",))
    return df.select("session_id", "frame_index", "sample_id", "sensor_type")


@query("replay_state", ["ev", "a_frames", "a_alerts"], f"""
with {_SPARSE}, tr as (select session_id, event_id as seq, k % 40 as track_id, k as source_frame_id, t_ns as timestamp_ns from ev where event_type = 'view'),
a as (select ix.session_id, i, tr.seq, tr.track_id, 0 as tier from ix join tr on ix.session_id = tr.session_id
        and (tr.source_frame_id = i or tr.source_frame_id = ix.sensor_timestamp_ns or abs(tr.timestamp_ns - ix.sensor_timestamp_ns) < 200000000)),
b as (select ix.session_id, i, tr.seq, tr.track_id, 1 as tier from ix join tr on ix.session_id = tr.session_id
        and abs(tr.timestamp_ns - ix.sensor_timestamp_ns) <= 1000000000 where (ix.session_id, i) not in (select session_id, i from a)),
s as (select distinct * from a union all select * from b),
g as (select session_id, i, string_agg(track_id::varchar, ',' order by seq) as track_ids, min(tier) as tier from s group by 1, 2),
al as (select ix.session_id, i, count(*) as n from ix join a_alerts e on ix.session_id = e.session_id and abs(e.timestamp_ns - ix.sensor_timestamp_ns) <= 1000000000 group by 1, 2)
select ix.session_id, ix.i as frame_index, coalesce(track_ids, '') as track_ids, coalesce(tier = 1, false) as fallback, coalesce(n, 0) as n_alerts
from ix left join g on g.session_id = ix.session_id and g.i = ix.i left join al on al.session_id = ix.session_id and al.i = ix.i
""")
def _(v: Views):
    tr = v.ev.where("event_type = 'view'").select("session_id", F.col("event_id").alias("seq"), (F.col("k") % 40).alias("track_id"),
                                                 F.col("k").alias("source_frame_id"), F.col("t_ns").alias("timestamp_ns"))
    df = timejoin.replay_state(_frames(v), tr, v.a_alerts, exact_ns=200_000_000, near_ns=1_000_000_000)
    return df.select("session_id", "frame_index", F.array_join("track_ids", ",").alias("track_ids"), "fallback", "n_alerts")


@query("scan_time_offset", ["a_frames", "a_imu"], """
with g as (select session_id, timestamp_ns, abs(x) + abs(y) + abs(z) as e from a_imu where sensor_type = 'GYRO'),
l as (select session_id, blur, i, -200 + i * 10.0 as off, sensor_timestamp_ns + (-200 + i * 10) * 1000000 as t from a_frames, range(41) r(i)),
n as (select l.session_id, i, off, blur, t, p.timestamp_ns as t0, q.timestamp_ns as t1, p.e as e0, q.e as e1 from l
   asof left join g p on l.session_id = p.session_id and l.t >= p.timestamp_ns asof left join g q on l.session_id = q.session_id and l.t <= q.timestamp_ns),
s as (select session_id, i, off, blur, case when t0 is null then e1 when t1 is null or t0 = t then e0 else (1 - (t - t0) / greatest(t1 - t0, 1)) * e0 + (t - t0) / greatest(t1 - t0, 1) * e1 end as e from n),
c as (select session_id, i, off, corr(e, blur) as r from s group by 1, 2, 3),
b as (select * from c qualify row_number() over (partition by session_id order by r desc, i) = 1),
k as (select session_id, count(*) >= 8 and coalesce((select count(*) from g where g.session_id = f.session_id), 0) >= 16 as ok from a_frames f group by session_id)
select k.session_id, ok, case when ok then round(off, 6) + 0.0 end as best_offset_ms, case when ok then round(r, 6) + 0.0 end as correlation from k left join b using (session_id)
""")
def _(v: Views):
    return rounded(timejoin.scan_time_offset(v.a_frames, v.a_imu.where("sensor_type = 'GYRO'"), tie=["event_id"]), "best_offset_ms", "correlation")


@query("event_clips", ["a_frames", "a_alerts"], f"""
with {_SPARSE}, e as (select * from a_alerts where fired),
z as (select session_id, max(i) as last_i from ix group by 1),
s as (select e.session_id, e.event_id as alert_id, e.timestamp_ns, coalesce(p.i, -1) as at_i, n.i as past_i from
   (select *, timestamp_ns + 2000000000 as te from e) e asof left join ix p on e.session_id = p.session_id and e.timestamp_ns >= p.sensor_timestamp_ns
   asof left join ix n on e.session_id = n.session_id and e.te <= n.sensor_timestamp_ns),
w as (select s.*, greatest(at_i - 7, 0) as a, coalesce(past_i, last_i) as b from s join z using (session_id))
select w.session_id, alert_id, a as start_index, b as end_index, b - a + 1 as n_frames, f.sensor_timestamp_ns as start_ns, g.sensor_timestamp_ns as end_ns, past_i is not null as complete
from w join ix f on f.session_id = w.session_id and f.i = a join ix g on g.session_id = w.session_id and g.i = b
""")
def _(v: Views):
    al = v.a_alerts.where("fired").select("session_id", F.col("event_id").alias("alert_id"), "timestamp_ns")
    df = timejoin.event_clips(_frames(v), al, fps=1.0)
    return df.select("session_id", "alert_id", "start_index", "end_index", "n_frames", "start_ns", "end_ns", "complete")


@query("clip_range", ["a_frames"], f"""
with {_SPARSE}, n as (select session_id, count(*) as n from ix group by 1)
select session_id, i as frame_index, event_id, 100::bigint as clip_start, least(830, n - 1) as clip_end, least(830, n - 1) - 100 + 1 as clip_n
from ix join n using (session_id) where i between 100 and 830
""")
def _(v: Views):
    return timejoin.clip_range(_frames(v), 100, 830).drop("sensor_timestamp_ns")


# --- image space ---------------------------------------------------------------------------------------------

@query("match_gt", ["a_gt", "a_boxes"], """
with p as (select g.frame, g.id, b.part % 200 as track_id, seq, price, pow((x0 + x1) / 2 - cx, 2) + pow((y0 + y1) / 2 - cy, 2) as d2
  from a_gt g join a_boxes b on g.frame = b.image)
select frame, id, track_id, round(sqrt(d2), 6) + 0.0 as distance_px from p where d2 <= 19600
qualify row_number() over (partition by frame, id order by d2, seq, price, track_id) = 1
""")
def _(v: Views):
    tr = v.a_boxes.select(F.col("image").alias("frame"), (F.col("part") % 200).alias("track_id"), "seq", "price",
                          ((F.col("x0") + F.col("x1")) / 2).alias("tx"), ((F.col("y0") + F.col("y1")) / 2).alias("ty"))
    return rounded(spatial.match_gt(v.a_gt, tr, order=("seq", "price")), "distance_px")


def _rect(x0: str, y0: str, x1: str, y1: str):
    a, b, c, d = (F.expr(e).cast("double") for e in (x0, y0, x1, y1))
    return F.array(F.array(a, b), F.array(c, b), F.array(c, d), F.array(a, d))


def _masks(v: Views):
    road = F.when(F.col("o_orderkey") % 5 != 0, _rect("100 + o_custkey % 300", "200", "1500 + o_custkey % 300", "1000"))
    occ = F.when(F.col("o_orderkey") % 3 == 0, F.array(_rect("o_custkey % 900", "100", "o_custkey % 900 + 500", "700"))).otherwise(
        F.array().cast("array<array<array<double>>>"))
    # one mask row per frame: o_orderkey is unique
    return v.orders.select(F.col("o_orderkey").alias("frame"), road.alias("road_polygon"), occ.alias("occluded_polygons"))


_MASK = """mk as (select o_orderkey as frame, o_orderkey % 5 <> 0 as has_road, 100 + o_custkey % 300 as rx0, 1500 + o_custkey % 300 as rx1,
   o_orderkey % 3 = 0 as has_occ, o_custkey % 900 as ox0, o_custkey % 900 + 500 as ox1 from orders)"""
_GATED = """not (coalesce(has_occ, false) and cx >= ox0 and cx < ox1 and cy >= 100 and cy < 700)
  and (not coalesce(has_road, false) or (cx >= rx0 and cx < rx1 and cy >= 200 and cy < 1000))"""


def _obs(v: Views):
    return v.a_boxes.withColumnRenamed("image", "frame")


@query("gate_observations", ["a_boxes"], f"""
with {_MASK}, o as (select *, (x0 + x1) * 0.5 as cx, (y0 + y1) * 0.5 as cy from a_boxes)
select image as frame, seq, price from o left join mk on mk.frame = o.image where {_GATED}
""")
def _(v: Views):
    return spatial.gate_observations(_obs(v), _masks(v)).select("frame", "seq", "price")


@query("hit_test", ["a_gt", "a_boxes"], """
with h as (select g.frame, g.id, b.part % 200 as track_id, seq, price, greatest(1.0, (x1 - x0) * (y1 - y0)) as a
  from a_gt g join a_boxes b on g.frame = b.image and cx >= x0 and cx < x1 and cy >= y0 and cy < y1)
select frame, id, track_id, round(a, 6) + 0.0 as box_area from h qualify row_number() over (partition by frame, id order by a, seq, price, track_id) = 1
""")
def _(v: Views):
    tr = _obs(v).select("frame", "seq", "price", (F.col("part") % 200).alias("track_id"), _rect("x0", "y0", "x1", "y1").alias("polygon"))
    df = spatial.hit_test(v.a_gt.select("frame", "id", "cx", "cy"), tr, point_id=("id",), xy=("cx", "cy"), order=("seq", "price"))
    return rounded(df, "box_area")


@query("mask_visibility", ["a_boxes"], """
with t as (select o_orderkey as frame, c * 240 as tx0, r * 180 as ty0, c * 240 + 240 as tx1, r * 180 + 180 as ty1,
   ((o_orderkey + c * 3 + r * 5) % 20) / 20.0 as score from orders, range(8) a(c), range(6) b(r)),
m as (select image, seq, price, avg(score) as s from a_boxes join t on t.frame = image and least(x1, tx1) > greatest(x0, tx0) and least(y1, ty1) > greatest(y0, ty0) group by 1, 2, 3)
select b.image as frame, b.seq, b.price, round(coalesce(s, quality * (1 - conf)), 6) + 0.0 as mask_visibility from a_boxes b left join m using (image, seq, price)
""")
def _(v: Views):
    # frames are dealt over the tasks before each of them becomes 48 rows
    cr = v.orders.select(F.col("o_orderkey").alias("frame")).repartition("frame").select("frame", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("i")).withColumn(
        "c", F.col("i") % 8).withColumn("r", F.floor(F.col("i") / 8))
    tiles = cr.select("frame", (F.col("c") * 240.0).alias("x0"), (F.col("r") * 180.0).alias("y0"), (F.col("c") * 240.0 + 240).alias("x1"),
                      (F.col("r") * 180.0 + 180).alias("y1"), (((F.col("frame") + F.col("c") * 3 + F.col("r") * 5) % 20) / 20.0).alias("score"))
    df = spatial.mask_visibility(_obs(v), tiles, sharpness="quality", motion_blur="conf")
    return rounded(df, "mask_visibility").select("frame", "seq", "price", "mask_visibility")


_IOU = """case when least({a}x1, {b}x1) > greatest({a}x0, {b}x0) and least({a}y1, {b}y1) > greatest({a}y0, {b}y0) then
  (least({a}x1, {b}x1) - greatest({a}x0, {b}x0)) * (least({a}y1, {b}y1) - greatest({a}y0, {b}y0)) /
  (({a}x1 - {a}x0) * ({a}y1 - {a}y0) + ({b}x1 - {b}x0) * ({b}y1 - {b}y0) - (least({a}x1, {b}x1) - greatest({a}x0, {b}x0)) * (least({a}y1, {b}y1) - greatest({a}y0, {b}y0)))
  else 0 end"""


@query("associate_candidates", ["a_boxes"], f"""
with t as (select image, seq as tseq, price as tprice, semantic_type as semantic, x0 as tx0, y0 as ty0, x1 as tx1, y1 as ty1, (x0 + x1) / 2 as mx, y1 as my from a_boxes where source = 'A'),
o as (select *, (x0 + x1) / 2 as gx, y1 as gy from a_boxes where source <> 'A'),
p as (select t.image as frame, tseq, tprice, o.seq, o.price, semantic, semantic_type, {_IOU.format(a='t', b='')} as iou, sqrt(pow(gx - mx, 2) + pow(gy - my, 2)) as dist from t join o using (image))
select frame, tseq, tprice, seq, price, round(iou * case when semantic = semantic_type or semantic_type = 'unknown_anomaly' then 1.2 else 0.7 end - dist / 400, 6) + 0.0 as score
from p where iou >= 0.25 or dist < 80
""")
def _(v: Views):
    b = _obs(v)
    t = b.where("source = 'A'").select("frame", F.col("seq").alias("tseq"), F.col("price").alias("tprice"), F.col("semantic_type").alias("semantic"),
                                       *[F.col(c).alias(f"t{c}") for c in spatial.BOX], ((F.col("x0") + F.col("x1")) / 2).alias("mean_x"), F.col("y1").alias("mean_y"))
    o = b.where("source <> 'A'").withColumn("contact_x", (F.col("x0") + F.col("x1")) / 2).withColumn("contact_y", F.col("y1"))
    return rounded(spatial.associate_candidates(t, o), "score").select("frame", "tseq", "tprice", "seq", "price", "score")


# coarser frames hold several boxes each, so that suppression has work to do
_NMS = """
recursive b as (select (image // 25) as im, *, row_number() over (partition by image // 25 order by conf desc, seq, price) as rn from a_boxes),
n as (select im, max(rn) as m from b group by 1),
k as (select im, 0::bigint as rn, []::struct(x0 double, y0 double, x1 double, y1 double)[] as kept, false as hit, null::bigint as seq, null::double as price from n
 union all
 select b.im, b.rn, case when len(list_filter(k.kept, lambda q: {clash})) = 0 then list_append(k.kept, {{'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1}}) else k.kept end,
   len(list_filter(k.kept, lambda q: {clash})) = 0, b.seq, b.price from k join b on b.im = k.im and b.rn = k.rn + 1)
"""
_PLUS = """(greatest(0, least(q.x1, b.x1) - greatest(q.x0, b.x0) + 1) * greatest(0, least(q.y1, b.y1) - greatest(q.y0, b.y0) + 1)) /
 ((q.x1 - q.x0 + 1) * (q.y1 - q.y0 + 1) + (b.x1 - b.x0 + 1) * (b.y1 - b.y0 + 1) -
  (greatest(0, least(q.x1, b.x1) - greatest(q.x0, b.x0) + 1) * greatest(0, least(q.y1, b.y1) - greatest(q.y0, b.y0) + 1)) + 1e-9) > 0.45"""


def _coarse(v: Views):
    return v.a_boxes.withColumn("image", F.floor(F.col("image") / 25))


@query("nms", ["a_boxes"], _NMS.format(clash=_IOU.format(a='q.', b='b.') + " >= 0.10") + " select im as image, seq, price from k where hit")
def _(v: Views):
    return spatial.nms(_coarse(v), iou_threshold=0.10).select("image", "seq", "price")


@query("nms_plus_one", ["a_boxes"], _NMS.format(clash=_PLUS) + """
, r as (select im, seq, price, row_number() over (partition by im order by rn) as p from k where hit) select im as image, seq, price from r where p <= 60
""")
def _(v: Views):
    return spatial.nms(_coarse(v), iou_threshold=0.45, plus_one=True, cap=60).select("image", "seq", "price")


@query("decode_detections", ["a_boxes"], """
with s as (select image, seq, price, (x0 / 3) as xc, (y0 / 3) as yc, (x1 - x0) / 3 as w, (y1 - y0) / 3 as h,
  [conf * 0.4, quality * 0.5, conf * quality, (class_id % 5) / 10.0] as sc from a_boxes),
b as (select *, list_max(sc) as conf, list_position(sc, list_max(sc)) - 1 as cid from s),
d as (select *, 640.0 / 1920 as g, (640 - 360) / 2.0 as py from b where conf >= 0.08 and cid <> 2)
select image, seq, price, cid::int as class_id, ['pothole', 'speed bump', ' ', 'manhole'][cid + 1] as name, round(conf, 6) + 0.0 as conf,
 round(least(greatest((xc - w / 2) / g, 0), 1919), 6) + 0.0 as x0, round(least(greatest((yc - h / 2 - py) / g, 0), 1079), 6) + 0.0 as y0,
 round(least(greatest((xc + w / 2) / g, 1), 1920), 6) + 0.0 as x1, round(least(greatest((yc + h / 2 - py) / g, 1), 1080), 6) + 0.0 as y1 from d
""")
def _(v: Views):
    b = v.a_boxes
    p = b.select("image", "seq", "price", (F.col("x0") / 3).alias("xc"), (F.col("y0") / 3).alias("yc"), ((F.col("x1") - F.col("x0")) / 3).alias("w"),
                 ((F.col("y1") - F.col("y0")) / 3).alias("h"), F.lit(1920).alias("width"), F.lit(1080).alias("height"),
                 F.array(F.col("conf") * 0.4, F.col("quality") * 0.5, F.col("conf") * F.col("quality"), (F.col("class_id") % 5) / 10.0).alias("scores"))
    df = spatial.decode_detections(p, ["pothole", "speed bump", " ", "manhole"])
    return rounded(df, "conf", "x0", "y0", "x1", "y1").select("image", "seq", "price", "class_id", "name", "conf", "x0", "y0", "x1", "y1")


@query("decode_with_objectness", ["a_boxes"], """
with b as (select image, seq, price, x0, y0, x1, y1, quality as obj, [conf * quality, ((class_id % 5) / 5.0) * quality] as sc from a_boxes)
select image, seq, price, (list_position(sc, list_max(sc)) - 1)::int as class_id, round(list_max(sc), 6) + 0.0 as conf from b where obj > 0.3 and list_max(sc) > 0.3
""")
def _(v: Views):
    p = v.a_boxes.select("image", "seq", "price", F.col("x0").alias("xc"), F.col("y0").alias("yc"), F.col("x1").alias("w"), F.col("y1").alias("h"),
                         F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.col("quality").alias("obj"),
                         F.array(F.col("conf"), (F.col("class_id") % 5) / 5.0).alias("scores"))
    df = spatial.decode_detections(p, ["car", "truck"], objectness="obj", conf_threshold=0.3, clip_to_edge=True)
    return rounded(df, "conf").select("image", "seq", "price", "class_id", "conf")


@query("filter_hazard_boxes", ["a_boxes"], """
with b as (select *, ['pothole', 'speed_bump', 'manhole_cover', 'other'][1 + class_id % 4] as c, x1 - x0 as bw, y1 - y0 as bh from a_boxes),
f as (select *, bw * bh / (1920.0 * 1080) as fr, bw / greatest(bh, 1) as asp, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy from b)
select image, seq, price, c as detector_class from f where bw >= 12 and bh >= 8 and cy >= 0.16 * 1080 and cx >= 0.08 * 1920 and cx <= 0.92 * 1920 and fr <= 0.2 and bw <= 0.88 * 1920
 and case c when 'pothole' then fr >= 0.00035 and fr <= 0.12 and asp < 3.5 when 'speed_bump' then fr >= 0.0008 and fr <= 0.12 and (bw >= 192 or asp >= 1.6)
     when 'manhole_cover' then fr >= 0.00035 and fr <= 0.08 and asp >= 0.35 and asp <= 4.2 else false end
""")
def _(v: Views):
    cls = F.element_at(F.array(*[F.lit(c) for c in ("pothole", "speed_bump", "manhole_cover", "other")]), (F.col("class_id") % 4 + 1).cast("int"))
    return spatial.filter_hazard_boxes(v.a_boxes.withColumn("detector_class", cls)).select("image", "seq", "price", "detector_class")


@query("filter_vehicle_boxes", ["a_boxes"], """
with f as (select *, greatest(1, x1 - x0) as bw, greatest(1, y1 - y0) as bh from a_boxes)
select image, seq, price from f where bw * bh >= 0.001 * 1920 * 1080 and bw * bh <= 0.22 * 1920 * 1080 and y1 >= 0.22 * 1080 and bw / bh <= 4.2 and bw / bh >= 0.28
 and not (x0 < 0.03 * 1920 and bw < 0.14 * 1920 and bh > 0.35 * 1080) and not (x1 > 0.97 * 1920 and bw < 0.14 * 1920 and bh > 0.35 * 1080)
 and not (bh < 0.025 * 1080 and bw < 0.035 * 1920) and (class_id > 20 or class_id between 1 and 7)
""")
def _(v: Views):
    return spatial.filter_vehicle_boxes(v.a_boxes).select("image", "seq", "price")


def _det(v: Views):
    b = v.a_boxes.withColumn("frame", F.floor(F.col("image") / 4))
    return b.select("frame", "seq", "price", "semantic_type", "source", *spatial.BOX, F.col("conf").alias("model_confidence"),
                    F.when(F.col("line") % 2 == 0, F.col("quality")).alias("calibrated_confidence"))


@query("merge_bump", ["a_boxes"], f"""
with {_MASK}, o as (select image // 4 as fr, *, (x0 + x1) * 0.5 as cx, (y0 + y1) * 0.5 as cy from a_boxes)
select fr as frame, seq, price, source from o where source in ('A', 'N') and semantic_type not in ('pothole', 'speed_bump', 'manhole_cover')
union all select fr, seq, price, source from o left join mk on mk.frame = o.fr where source = 'R'
  and not (coalesce(has_occ, false) and cx >= ox0 and cx < ox1 and cy >= 100 and cy < 700)
""")
def _(v: Views):
    d = _det(v)
    return spatial.merge_bump(d.where("source in ('A', 'N')"), d.where("source = 'R'"), _masks(v)).select("frame", "seq", "price", "source")


@query("merge_sidecar", ["a_boxes"], f"""
recursive {_MASK}, d as (select image // 4 as frame, seq, price, source, x0, y0, x1, y1, conf, case when line % 2 = 0 then quality end as cal, (x0 + x1) * 0.5 as cx, (y0 + y1) * 0.5 as cy from a_boxes),
pm as (select * from mk where frame % 2 = 0), sm as (select frame, has_road and frame % 4 = 1 as has_road, rx0, rx1, has_occ, ox0, ox1 from mk where frame % 2 = 1),
p as (select * from d where source in ('A', 'N')), s as (select * from d where source = 'R'),
fr as (select s.*, row_number() over (partition by frame order by seq, price) as rn from s
       where not exists (select 1 from p where p.frame = s.frame and {_IOU.format(a='p.', b='s.')} >= 0.30)),
k as (select distinct frame, 0::bigint as rn, []::struct(x0 double, y0 double, x1 double, y1 double)[] as kept, false as hit, null::bigint as seq, null::double as price from fr
  union all select b.frame, b.rn, case when len(list_filter(k.kept, lambda q: {_IOU.format(a='q.', b='b.')} >= 0.30)) = 0 then list_append(k.kept, {{'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1}}) else k.kept end,
   len(list_filter(k.kept, lambda q: {_IOU.format(a='q.', b='b.')} >= 0.30)) = 0, b.seq, b.price from k join fr b on b.frame = k.frame and b.rn = k.rn + 1),
x as (select fr.* from fr join k on k.hit and k.frame = fr.frame and k.seq = fr.seq and k.price = fr.price),
live as (select frame from s union select frame from sm where has_road or has_occ),
a as (select frame, seq, price, source, cx, cy, least(greatest(0.55 * coalesce(cal, conf) + 0.45 * 0.6, 0), 1) as c from p where frame in (select frame from live)
      union all select frame, seq, price, source, cx, cy, cal from x),
m as (select coalesce(pm.frame, sm.frame) as frame, case when sm.has_road then true else pm.has_road end as has_road, case when sm.has_road then sm.rx0 else pm.rx0 end as rx0,
  case when sm.has_road then sm.rx1 else pm.rx1 end as rx1, case when sm.has_occ then true else pm.has_occ end as has_occ,
  case when sm.has_occ then sm.ox0 else pm.ox0 end as ox0, case when sm.has_occ then sm.ox1 else pm.ox1 end as ox1 from pm full join sm on pm.frame = sm.frame)
select a.frame, seq, price, source, round(c, 6) + 0.0 as calibrated_confidence from a left join m on m.frame = a.frame where {_GATED}
union all select frame, seq, price, source, round(cal, 6) + 0.0 from p where frame not in (select frame from live)
""")
def _(v: Views):
    d, mk = _det(v), _masks(v)
    side = mk.where("frame % 2 = 1").withColumn("road_polygon", F.when(F.col("frame") % 4 == 1, F.col("road_polygon")))
    df = spatial.merge_sidecar(d.where("source in ('A', 'N')"), d.where("source = 'R'"), mk.where("frame % 2 = 0"), side, score=0.6)
    return rounded(df, "calibrated_confidence").select("frame", "seq", "price", "source", "calibrated_confidence")


@query("match_clip_spec", ["a_clips"], """
with c as (select clip_id, (55 + clip_id % 200 / 10.0)::double as duration_s, case when clip_id % 2 = 0 then 'day' else 'night' end as lighting from a_clips)
select clip_id, case when abs(duration_s - 68.824) <= 1 then 'day_25007' when abs(duration_s - 55.014) <= 1 then 'night_25013' else 'extra' end as alias,
  case when abs(duration_s - 68.824) <= 1 then '25007.mp4' when abs(duration_s - 55.014) <= 1 then '25013.mp4' end as spec_name,
  case when abs(duration_s - 68.824) <= 1 then 'day' when abs(duration_s - 55.014) <= 1 then 'night' else lighting end as lighting from c
""")
def _(v: Views):
    c = v.a_clips.select("clip_id", (F.lit(55.0) + (F.col("clip_id") % 200) / 10.0).alias("duration_s"),
                         F.when(F.col("clip_id") % 2 == 0, "day").otherwise("night").alias("lighting"))
    return match_clip_spec(c).drop("duration_s")
