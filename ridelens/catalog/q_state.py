"""State machines in batch form, and the pluggable detector."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridelens.catalog.q_rows import _PHRASE, SCORED
from ridelens.catalog.registry import ORACLES, Views, nudged, query
from ridelens.operators import alert_policy, detector, tracking


@query("alert_policy", ["a_tracks"], f"""
recursive {SCORED}, {{PH}} as (select *, {_PHRASE} as phrase from gt),
o as (select *, row_number() over (partition by session_id order by timestamp_ns, seq, price) as rn from ph where gate is null),
w as (select distinct session_id, 0::bigint as rn, null::bigint as frame, null::bigint as seq, null::double as price, 0::bigint as ga, map([]::varchar[], []::bigint[]) as cl, map([]::bigint[], []::int[]) as svm, null::varchar as reason from o
 union all
 select session_id, rn, frame, seq, price, case when rs = 'fired' then t else ga end, case when rs = 'fired' then map_concat(cl, map([sem], [t])) else cl end,
   case when rs = 'fired' then map_concat(svm, map([tr], [greatest(sev, 0)])) else svm end, rs
 from (select o.session_id, o.rn, o.frame, o.seq, o.price, o.timestamp_ns as t, o.semantic_type as sem, o.track_id as tr, o.severity as sev, ga, cl, svm,
   case when svm[o.track_id] is not null and not (o.severity - svm[o.track_id] >= 1 and o.severity >= 2) then 'already_alerted'
        when ga <> 0 and o.timestamp_ns - ga < 2200000000 then 'global_cooldown'
        when coalesce(cl[o.semantic_type], 0) <> 0 and o.timestamp_ns - cl[o.semantic_type] < 4000000000 then 'class_cooldown' else 'fired' end as rs
   from w join o on o.session_id = w.session_id and o.rn = w.rn + 1))
select p.frame, p.seq, p.price, coalesce(gate, reason) as reason, coalesce(reason = 'fired', false) as fired, round(case when gate is null or gate = 'below_threshold' then ascore else 0 end + 1e-9, 6) as alert_score,
  case when reason = 'fired' then phrase else '' end as phrase from ph p left join w on w.frame = p.frame and w.seq = p.seq and w.price = p.price
""".replace("{PH}", "ph"))
def _(v: Views):
    # timestamps are frame · 33 ms
    df = alert_policy.alert_policy(v.a_tracks).withColumn("frame", (F.col("timestamp_ns") / 33_000_000).cast("long"))
    return nudged(df, "alert_score").select("frame", "seq", "price", "reason", "fired", "alert_score", "phrase")


@query("alert_reason_counts", None, f"select reason, count(*) as n from ({ORACLES['alert_policy']}) group by 1")
def _(v: Views):
    return alert_policy.alert_policy(v.a_tracks).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def observations(v: Views):
    """Boxes of an order as the detections of one frame; order keys number the frames, 1200 to a ride."""
    b = v.a_boxes
    return b.select(
        F.floor(F.col("image") / 1200).alias("session_id"), (F.col("image") % 1200 * 50_000_000).alias("timestamp_ns"), F.col("image").alias("frame_id"),
        (F.col("image") % 11 != 0).alias("quality_ok"), (F.col("image") % 13 != 0).alias("allow_new"), ((F.col("image") % 7 - 3) / 100.0).alias("yaw_rate"),
        F.lit(1920.0).alias("frame_width"), (F.xxhash64("seq", "price") % 1_000_000_000).cast("int").alias("obs_index"), "semantic_type",
        F.element_at(F.array(*[F.lit(g) for g in ("concave", "flat", "unknown")]), (F.col("part") % 3 + 1).cast("int")).alias("geometry_type"),
        F.lit("abnormal").alias("state"), (F.col("line") % 5 - 1).cast("int").alias("severity"), F.col("conf").alias("model_confidence"),
        F.col("quality").alias("quality_at_mask"), ((F.col("x0") + F.col("x1")) / 2).alias("contact_x"), F.col("y1").alias("contact_y"), "x0", "y0", "x1", "y1")


@query("track_sessions")
def _(v: Views):
    t = tracking.track_sessions(observations(v))
    return t.groupBy("session_id", "lifecycle_state").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("track_id").alias("n_tracks"), F.max("hits").alias("max_hits"))


@query("run_detector", ["a_boxes"], """
select image as frame_id, seq, 'box' as name, round(x0, 6) + 0.0 as x0, round(y0, 6) + 0.0 as y0, round(x1, 6) + 0.0 as x1, round(y1, 6) + 0.0 as y1, round(conf * 0.9, 6) + 0.0 as conf from a_boxes where conf * 0.9 >= 0.5
""")
def _(v: Views):
    from ridelens.catalog.registry import rounded

    frames = v.a_boxes.select(F.col("image").alias("frame_id"), "seq", "x0", "y0", "x1", "y1", "conf")
    df = detector.run_detector(frames, _threshold_detector, keep=["frame_id", "seq"])
    return rounded(df, "x0", "y0", "x1", "y1", "conf")


def _threshold_detector(batch):
    """Stand-in for a user's model: passes boxes on with a scaled confidence."""
    out = batch.assign(conf=batch["conf"] * 0.9, name="box")
    return out[out["conf"] >= 0.5]
