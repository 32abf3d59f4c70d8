"""Queues, curation, exports and fitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridelens.catalog.q_joins import _IOU, _NMS, _coarse
from ridelens.catalog.registry import Views, query, rounded
from ridelens.functions import vocab as V
from ridelens.operators import curation, fit, queues
from ridelens.sources import sinks


@query("active_learning_queue", ["a_tracks", "a_alerts"], """
with u as (select * from a_tracks qualify row_number() over (partition by session_id, track_id, source_frame_id order by timestamp_ns, seq, price) = 1),
fi as (select distinct session_id, case when track_id = 0 then -1 else track_id end as track_id from a_alerts where fired),
e as (select u.session_id, u.track_id, source_frame_id as frame_id, timestamp_ns, seq, price, semantic_type, visibility_confidence, fi.track_id is not null as hit,
   case when effective_confidence = 0 then 0.5 else effective_confidence end as eff from u left join fi on fi.session_id = u.session_id and fi.track_id = u.track_id),
s as (select *, eff between 0.28 and 0.72 as r1, semantic_type = 'unknown_anomaly' as r2, visibility_confidence < 0.4 as r4 from e),
q as (select *, round_even(1 - abs(eff - 0.5) * 2 + case when r1 then 0.15 else 0 end + case when r2 then 0.35 else 0 end + case when hit then 0.25 else 0 end + case when r4 then 0.2 else 0 end, 4) as score,
   concat_ws(',', case when r1 then 'uncertain_confidence' end, case when r2 then 'unknown_anomaly' end, case when hit then 'alert_event' end, case when r4 then 'low_visibility' end) as reasons from s where r1 or r2 or hit or r4)
select session_id, track_id, frame_id, score, reasons from q qualify row_number() over (partition by session_id order by score desc, timestamp_ns, seq, price, track_id) <= 20
""")
def _(v: Views):
    df = queues.active_learning_queue(v.a_tracks, v.a_alerts, max_n=20)
    return df.select("session_id", "track_id", "frame_id", "score", F.array_join("reasons", ",").alias("reasons"))


@query("first_wins", ["a_tracks"], """
select session_id, track_id, source_frame_id, seq, price from a_tracks qualify row_number() over (partition by session_id, track_id, source_frame_id order by seq, price) = 1
""")
def _(v: Views):
    return queues.first_wins(v.a_tracks.select("session_id", "track_id", "source_frame_id", "seq", "price"), ["session_id", "track_id", "source_frame_id"], ["seq", "price"])


@query("latest_events", ["ev"], """
select session_id, event_id from ev qualify row_number() over (partition by session_id order by t_ns desc, event_id desc) <= 400
""")
def _(v: Views):
    e = v.ev.select("session_id", F.col("t_ns").alias("timestamp_ns"), "event_id")
    return queues.latest_events(e).select("session_id", "event_id")


def _cases(v: Views):
    al = v.a_alerts.withColumn("snapshot", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("{\"score\":"), F.col("alert_score").cast("string"), F.lit("}")))).withColumn("phrase", F.lit("p"))
    marks = v.ev.where("event_type = 'error'").select("session_id", F.col("t_ns").alias("timestamp_ns"), F.col("event_type").alias("note"), F.col("k").alias("frame_id"))
    return queues.error_case_library(al, marks)


@query("error_case_library", ["ev", "a_alerts"], """
select session_id, 'alert' as kind, timestamp_ns, track_id, semantic_type, null as note, null::bigint as frame_id, event_id % 2 = 0 as has_snapshot from a_alerts where fired
union all select session_id, 'mark', t_ns, null, null, event_type, k, null from ev where event_type = 'error'
""")
def _(v: Views):
    snap = F.when(F.col("kind") == "alert", F.col("snapshot").startswith("{\"score\":"))
    return _cases(v).withColumn("has_snapshot", snap).select("session_id", "kind", "timestamp_ns", "track_id", "semantic_type", "note", "frame_id", "has_snapshot")


@query("error_case_counts", ["ev", "a_alerts"], """
with i as (select session_id, 'a' as kind from a_alerts where fired union all select session_id, 'm' from ev where event_type = 'error')
select session_id, count(*) as n_items, count(*) filter (where kind = 'a') as n_alerts, count(*) filter (where kind = 'm') as n_marks, 0::bigint as n_clips from i group by 1
""")
def _(v: Views):
    return queues.error_case_counts(_cases(v))


# --- vocabularies ------------------------------------------------------------------------------------------------

def _values(rows) -> str:
    def lit(x):
        return "true" if x is True else "false" if x is False else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)


_KEY = "trim(regexp_replace(regexp_replace(lower(trim({c})), '[_-]', ' ', 'g'), '\\s+', ' ', 'g'))"
_VOCAB = "vb(name, semantic_type, geometry_type, state, dsev, alert, note) as (values " + _values(
    [(n, *g) for names, *g in V.PUBLIC_LABEL_GROUPS for n in names]) + "), sv(word, code) as (values " + _values(V.SEVERITY_ALIASES.items()) + ")"


@query("map_public_labels", ["a_labels"], f"""
with {_VOCAB}
select label_id, raw, lower(source) as source, coalesce(vb.semantic_type, 'unknown_anomaly') as semantic_type, coalesce(vb.geometry_type, 'unknown') as geometry_type, coalesce(vb.state, 'unknown') as state,
  coalesce(sv.code, vb.dsev, -1)::int as severity, coalesce(vb.alert and vb.state = 'abnormal', false) as alert_eligible, coalesce(vb.note, 'no rule for this label') as note
from a_labels a left join vb on vb.name = {_KEY.format(c='a.raw')} left join sv on sv.word = {_KEY.format(c='a.severity_raw')}
""")
def _(v: Views):
    return curation.map_public_labels(v.a_labels).select("label_id", "raw", "source", "semantic_type", "geometry_type", "state", "severity", "alert_eligible", "note")


@query("map_geometry_severity", ["a_labels"], """
select label_id, case raw_id % 5 when 0 then 'concave' when 1 then 'step' when 2 then 'convex' else 'unknown' end as geometry_type, case when severity_int between 0 and 3 then severity_int else -1 end as severity from a_labels
""")
def _(v: Views):
    words = F.array(*[F.lit(w) for w in ("Sunken", " step_transition", "PROTRUSION", "uncertain", "bumpy")])
    a = v.a_labels.select("label_id", F.element_at(words, (F.col("raw_id") % 5 + 1).cast("int")).alias("geometry_raw"), F.col("severity_int").alias("severity_raw"))
    return curation.map_geometry_severity(a).select("label_id", "geometry_type", "severity")


_DET = "dn(name, cls) as (values " + _values({**{c.replace("_", " "): c for c in V.DETECTOR_CLASSES}, **V.PROMPT_CLASSES}.items()) + ")"


@query("map_detection_names", ["a_boxes"], f"""
with {_DET}
select image, seq, price, cls as detector_class, coalesce(cls, 'unknown_anomaly') as semantic_type,
 case when cls = 'pothole' or b.name = 'sunken manhole cover' then 'concave' when cls = 'speed_bump' then 'convex' when cls = 'manhole_cover' then 'flat' else 'unknown' end as geometry_type,
 case when cls in ('pothole', 'speed_bump') or b.name = 'sunken manhole cover' then 'abnormal' when cls = 'manhole_cover' then 'normal' else 'unknown' end as state,
 case when cls = 'pothole' or b.name = 'sunken manhole cover' then 3 when cls = 'speed_bump' then 2 when cls = 'manhole_cover' then 0 else -1 end as severity
from a_boxes b left join dn on dn.name = {_KEY.format(c='b.name')}
""")
def _(v: Views):
    return curation.map_detection_names(v.a_boxes).select("image", "seq", "price", "detector_class", "semantic_type", "geometry_type", "state", "severity")


@query("clip_hints", ["a_clips"], """
with n as (select clip_id, case clip_id % 7 when 0 then 'SpeedBump-01.mp4' when 1 then 'ride/hump test.mov' when 2 then 'sunken_manhole.mp4' when 3 then 'Manhole.MP4' when 4 then '大坑.mp4' when 5 then clip_name || '.mp4' else 'speed-bump pothole.mkv' end as f from a_clips)
select clip_id, f as name, case when f = 'sunken_manhole.mp4' or f = 'Manhole.MP4' then 'manhole_cover' when f in ('SpeedBump-01.mp4', 'ride/hump test.mov', 'speed-bump pothole.mkv') then 'speed_bump' when f = '大坑.mp4' then 'pothole' end as hint from n
""")
def _(v: Views):
    i = F.col("clip_id") % 7
    f = (F.when(i == 0, "SpeedBump-01.mp4").when(i == 1, "ride/hump test.mov").when(i == 2, "sunken_manhole.mp4").when(i == 3, "Manhole.MP4").when(i == 4, "大坑.mp4")
         .when(i == 5, F.concat("clip_name", F.lit(".mp4"))).otherwise("speed-bump pothole.mkv"))
    return v.a_clips.select("clip_id", f.alias("name"), curation.clip_hint(f).alias("hint"))


# --- splits --------------------------------------------------------------------------------------------------------

@query("split_sessions", None, """
with n as (select count(*) as n from customer)
select 'train' as split, floor(n * 0.7)::bigint as n_sessions from n union all select 'val', floor(n * 0.15)::bigint from n
union all select 'test', n - floor(n * 0.7)::bigint - floor(n * 0.15)::bigint from n
""")
def _(v: Views):
    # the seeded order is Spark's hash, so sizes are compared, not membership
    return curation.split_sessions(v.customer.select(F.col("c_custkey").alias("session_id"))).groupBy("split").agg(F.count(F.lit(1)).alias("n_sessions"))


@query("clip_split", None, """
with n as (select count(distinct l_partkey % 200) as n from lineitem)
select 'train' as split, floor(n * 0.7)::bigint as n_clips from n union all select 'val', floor(n * 0.15)::bigint from n
union all select 'test', n - floor(n * 0.7)::bigint - floor(n * 0.15)::bigint from n
""")
def _(v: Views):
    return curation.clip_split(v.lineitem.select((F.col("l_partkey") % 200).alias("clip"))).groupBy("split").agg(F.count(F.lit(1)).alias("n_clips"))


@query("leakage_check", None, """
select o_custkey as session_id, count(distinct case when o_orderkey % 7 = 0 then 'val' else 'train' end) as n_splits from orders group by 1 having count(distinct case when o_orderkey % 7 = 0 then 'val' else 'train' end) > 1
""")
def _(v: Views):
    a = v.orders.select(F.col("o_custkey").alias("session_id"), F.when(F.col("o_orderkey") % 7 == 0, "val").otherwise("train").alias("split"))
    return curation.leakage_check(a)


def _index(v: Views):
    o = v.orders
    return o.select(F.col("o_orderkey").alias("image"), (F.col("o_custkey") % 90).alias("clip"), F.when(F.col("o_custkey") % 3 == 0, "pothole").when(F.col("o_custkey") % 3 == 1, "speed_bump").alias("hint"))


def _splits(v: Views):
    c = F.col("clip")
    return _index(v).select("clip").distinct().withColumn("split", F.when(c % 10 < 7, "train").when(c % 10 == 7, "val").otherwise("test"))


@query("materialize_split", None, """
with i as (select o_orderkey as image, o_custkey % 90 as clip from orders), s as (select *, case when clip % 10 < 7 then 'train' when clip % 10 = 7 then 'val' else 'test' end as split from i),
l as (select distinct l_orderkey as image, 'n' || (l_orderkey % 5) as label_text from lineitem)
select s.image, clip, split, coalesce(label_text, '') as label_text from s left join l using (image) where split <> 'test'
""")
def _(v: Views):
    lab = v.lineitem.select(F.col("l_orderkey").alias("image"), F.concat(F.lit("n"), (F.col("l_orderkey") % 5).cast("string")).alias("label_text")).distinct()
    return curation.materialize_split(_index(v), lab, _splits(v)).select("image", "clip", "split", "label_text")


@query("dataset_index_summary", None, """
with i as (select o_orderkey as image, o_custkey % 90 as clip from orders), c as (select distinct clip from i), p as (select distinct l_orderkey as image from lineitem)
select (select count(*) from i) as n_frames, (select count(*) from i join p using (image)) as n_positive_frames, (select count(*) from i) - (select count(*) from i join p using (image)) as n_empty_frames,
 (select count(*) from c) as n_clips, (select count(*) from c where clip % 10 < 7) as n_train, (select count(*) from c where clip % 10 = 7) as n_val, (select count(*) from c where clip % 10 > 7) as n_test
""")
def _(v: Views):
    dets = v.lineitem.select(F.col("l_orderkey").alias("image"))
    return curation.dataset_index_summary(_index(v), _splits(v), dets)


# --- annotation ------------------------------------------------------------------------------------------------------

@query("export_annotation_tasks", ["a_tracks"], """
select session_id, frame as frame_id, seq, price, timestamp_ns, track_id, semantic_type, geometry_type, object_state as state, severity, 'clear' as visibility, false as review from a_tracks
""")
def _(v: Views):
    t = v.a_tracks
    df = curation.export_annotation_tasks(t.select("session_id", "source_frame_id", "timestamp_ns", "track_id", "semantic_type", "geometry_type", "object_state", "severity", "seq", "price"))
    p = F.from_json("model_prediction", "seq bigint, price double")
    return df.select("session_id", "frame_id", p["seq"].alias("seq"), p["price"].alias("price"), "timestamp_ns", "track_id", "semantic_type", "geometry_type", "state", "severity", "visibility", "review")


@query("apply_revisions", None, """
with t as (select distinct conv_id % 60 as track_id, turn as frame_id from conversations), p as (select conv_id % 60 as track_id, turn as frame_id, role as key, conv_id as seq, text as value from conversations),
l as (select * from p qualify row_number() over (partition by track_id, frame_id, key order by seq desc, value desc) = 1),
g as (select track_id, frame_id, string_agg(key || '=' || md5(value), ';' order by key) as rev from l group by 1, 2)
select t.track_id, t.frame_id, rev as human_revision from t left join g using (track_id, frame_id)
""")
def _(v: Views):
    c = v.conversations.withColumn("track_id", F.col("conv_id") % 60).withColumn("frame_id", F.col("turn"))
    tasks = c.select("track_id", "frame_id").distinct().withColumn("human_revision", F.lit(None).cast("map<string,string>"))
    patches = c.select("track_id", "frame_id", F.col("role").alias("key"), F.col("conv_id").alias("seq"), F.col("text").alias("value"))
    df = curation.apply_revisions(tasks, patches)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("human_revision")), lambda e: F.concat(e["key"], F.lit("="), F.md5(e["value"]))), ";")
    return df.select("track_id", "frame_id", text.alias("human_revision"))


@query("required_field_check", ["a_labels"], """
select label_id, concat_ws(',', case when label_id % 7 = 0 then 'semantic_type' end, case when label_id % 5 = 0 then 'severity' end, 'visibility') as missing from a_labels
""")
def _(v: Views):
    i = F.col("label_id")
    a = v.a_labels.select("label_id", F.when(i % 7 != 0, "pothole").alias("semantic_type"), F.lit("flat").alias("geometry_type"), F.lit("normal").alias("state"),
                          F.when(i % 5 != 0, 1).alias("severity"), i.alias("track_id"))
    return curation.required_field_check(a).select("label_id", F.array_join("missing", ",").alias("missing"))


@query("export_cvat", ["a_tracks"], """
with f as (select session_id, track_id, arg_min(semantic_type, (timestamp_ns, seq, price)) as label from a_tracks group by 1, 2)
select session_id, track_id, 0 as part, '  <track id="' || track_id || '" label="' || label || '&amp;&lt;">' as line from f
union all select session_id, track_id, 2, '  </track>' from f
union all select session_id, track_id, 1, '    <polygon frame="' || frame || '" points="' || printf('%.1f,%.1f;%.1f,%.1f;%.1f,%.1f', distance_m, 1.0::double, distance_m + 4, 1.0::double, distance_m, width_m) || '" outside="0" occluded="0" />'
 from a_tracks where track_id % 3 <> 0
""")
def _(v: Views):
    def pt(x, y):
        return F.array(x.cast("double"), y.cast("double"))
    d = F.col("distance_m")
    tri = F.array(pt(d, F.lit(1)), pt(d + 4, F.lit(1)), pt(d, F.col("width_m")))
    t = v.a_tracks.withColumn("polygon", F.when(F.col("track_id") % 3 != 0, tri).otherwise(F.slice(tri, 1, 2))).withColumn("semantic_type", F.concat("semantic_type", F.lit("&<")))
    return curation.export_cvat(t).select("session_id", "track_id", "part", "line")


@query("propose_labels", ["a_boxes"], f"""
with {_DET}, i as (select o_orderkey as image, case o_custkey % 3 when 0 then 'pothole' when 1 then 'speed_bump' end as hint from orders)
select b.image, seq, price, round(conf + case when cls = hint then 0.05 else 0 end, 6) + 0.0 as conf from a_boxes b join i using (image) left join dn on dn.name = {_KEY.format(c='b.name')}
""")
def _(v: Views):
    return rounded(curation.propose_labels(v.a_boxes, _index(v)), "conf").select("image", "seq", "price", "conf")


@query("export_yolo_labels", ["a_boxes"], _NMS.format(clash=_IOU.format(a="q.", b="b.") + " >= 0.5") + f""", {_DET},
h as (select b.im, b.seq, b.price, b.conf, cls, b.x0, b.y0, b.x1, b.y1, b.x1 - b.x0 as bw, b.y1 - b.y0 as bh from k join b on b.im = k.im and b.rn = k.rn join dn on dn.name = {_KEY.format(c='b.name')} where hit),
g as (select *, bw * bh / (1920.0 * 1080) as fr, bw / greatest(bh, 1) as asp, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy from h),
o as (select * from g where bw >= 12 and bh >= 8 and cy >= 0.16 * 1080 and cx >= 0.08 * 1920 and cx <= 0.92 * 1920 and fr <= 0.2 and bw <= 0.88 * 1920
 and case cls when 'pothole' then fr >= 0.00035 and fr <= 0.12 and asp < 3.5 when 'speed_bump' then fr >= 0.0008 and fr <= 0.12 and (bw >= 192 or asp >= 1.6) else fr >= 0.00035 and fr <= 0.08 and asp >= 0.35 and asp <= 4.2 end),
t as (select im, string_agg(printf('%d %.6f %.6f %.6f %.6f', case cls when 'pothole' then 0 when 'speed_bump' then 1 else 2 end, least(greatest(cx / 1920, 0), 1), least(greatest(cy / 1080, 0), 1), bw / 1920, bh / 1080), chr(10) order by conf desc, seq, price) as tx, count(*) as n from o group by 1)
select i.im as image, md5(coalesce(tx || chr(10), '')) as label_md5, coalesce(n, 0)::int as n_boxes from n i left join t using (im)
""")
def _(v: Views):
    b = _coarse(v)
    df = curation.export_yolo_labels(b, b.select("image"))
    return df.select("image", F.md5("label_text").alias("label_md5"), "n_boxes")


@query("clip_catalog", ["a_clips"], """
with c as (select *, case when fps > 0 then frames / fps else 0 end as d from a_clips)
select clip_id, round_even(fps, 3) as fps, round_even(d, 3) as duration_s, round_even(mean_luma, 2) as mean_luma,
 case when abs(d - 68.824) <= 1 then 'day' when abs(d - 55.014) <= 1 then 'night' when mean_luma < 105 then 'night' else 'day' end as lighting,
 case when abs(d - 68.824) <= 1 then 'day_25007' when abs(d - 55.014) <= 1 then 'night_25013' else 'extra' end as alias from c
""")
def _(v: Views):
    return curation.clip_catalog(v.a_clips).select("clip_id", "fps", "duration_s", "mean_luma", "lighting", "alias")


@query("content_fingerprint", None, """
select doc_id, sha256(text) as fp from documents
""")
def _(v: Views):
    f = v.documents.select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return curation.content_fingerprint(f).select("doc_id", F.col("sha256").alias("fp"))


# --- sharing -----------------------------------------------------------------------------------------------------------

@query("share_tables", ["a_manifest", "a_location", "a_alerts"], """
select 'manifest' as part, session_id, notes || ' | share pack: GPS coarsened, paths and coordinates redacted' as text, null::double as number from a_manifest
union all select 'location', event_id, 'coarsened', round_even(longitude, 2) from a_location
union all select 'alert', event_id, semantic_type, alert_score from a_alerts
""")
def _(v: Views):
    s = sinks.share_tables({"manifest": v.a_manifest, "location": v.a_location, "alerts": v.a_alerts})
    none = F.lit(None).cast("double")
    return (s["manifest"].select(F.lit("manifest").alias("part"), "session_id", F.col("notes").alias("text"), none.alias("number"))
            .unionByName(s["location"].select(F.lit("location").alias("part"), F.col("event_id").alias("session_id"), F.col("privacy").alias("text"), F.col("longitude").alias("number")))
            .unionByName(s["alerts"].select(F.lit("alert").alias("part"), F.col("event_id").alias("session_id"), F.col("semantic_type").alias("text"), F.col("alert_score").alias("number"))))


# --- fitting --------------------------------------------------------------------------------------------------------------

@query("fit_linear", None, "select 0 as i, 0.5::double as weight union all select 1, -3.0 union all select 2, 7.0 union all select 3, 2.0")
def _(v: Views):
    # a known plane over the whole table: the fit must return its coefficients
    li = v.lineitem.select(F.array("l_quantity", "l_discount", "l_tax").alias("features"),
                           (2 + 0.5 * F.col("l_quantity") - 3 * F.col("l_discount") + 7 * F.col("l_tax")).alias("y"))
    w = fit.fit_linear(li, dim=3)
    return v.spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(w)], "i int, weight double")


# normal equations, solved by eliminating one column a step; the matrix is a list of rows with the four right sides behind
@query("fit_one_vs_rest", None, """
recursive e as (select list_append(embedding::double[], 1.0::double) as f, label % 4 as k from embeddings),
d as (select max(len(f)) as n from e),
x as (select i, f, f[i] as fi, k from e, range(1, (select n + 1 from d)) r(i)),
g as (select i, list_concat(list(v order by j), any_value(c)) as row from (
   select i, j, sum(fi * f[j]) as v, [sum(fi) filter (where k = 0), sum(fi) filter (where k = 1), sum(fi) filter (where k = 2), sum(fi) filter (where k = 3)] as c
   from x, range(1, (select n + 1 from d)) q(j) group by i, j) group by i),
s as (select 0 as step, list(row order by i) as a from g
   union all
   select step + 1, list_transform(a, lambda r, i: case when i = step + 1 then list_transform(r, lambda z: z / r[step + 1])
      else list_transform(r, lambda z, j: z - r[step + 1] * a[step + 1][j] / a[step + 1][step + 1]) end) from s where step < (select n from d)),
w as (select list_transform(range(1, 5), lambda k: list_transform(a, lambda r: r[n + k])) as w from s, d where step = n),
p as (select k, list_transform(w, lambda u: list_dot_product(u, f)) as sc from e, w)
select count(*) as n, avg((list_position(sc, list_max(sc)) - 1 = k)::int) as accuracy from p
""")
def _(v: Views):
    e = v.embeddings.select("vec_id", F.col("embedding").alias("features"), (F.col("label") % 4).alias("label"))
    dim = e.select(F.max(F.size("features"))).first()[0]
    w = fit.fit_one_vs_rest(e, dim=dim, n_classes=4)
    return fit.accuracy(fit.predict_labels(e, w))


@query("predict_labels", ["a_boxes"], """
with s as (select image, seq, price, [0.5 * conf + 0.1, quality - 0.2, 0.3 * conf + 0.3 * quality + 0.05, 0.5 * conf + 0.1] as sc from a_boxes)
select image, seq, price, (list_position(sc, list_max(sc)) - 1)::int as predicted from s
""")
def _(v: Views):
    b = v.a_boxes.select("image", "seq", "price", F.array("conf", "quality").alias("features"))
    w = [[0.5, 0.0, 0.1], [0.0, 1.0, -0.2], [0.3, 0.3, 0.05], [0.5, 0.0, 0.1]]
    return fit.predict_labels(b, w).select("image", "seq", "price", "predicted")


@query("fit_mounts", ["a_mounts"], """
with mk as (select profile_id, 5.0 as d, known_distance_5m_px as px from a_mounts where known_distance_5m_px is not null union all select profile_id, 10.0, known_distance_10m_px from a_mounts where known_distance_10m_px is not null
  union all select profile_id, 20.0, known_distance_20m_px from a_mounts where known_distance_20m_px is not null),
nm as (select profile_id, count(*) as n from mk group by 1),
g as (select m.*, p * 19 + h as i, radians(pitch_deg - 8 + p * 0.5) as pt, greatest(0.55, camera_height_m - 0.45) + h * ((camera_height_m + 0.45 - greatest(0.55, camera_height_m - 0.45)) / 18) as ht,
   radians(roll_deg) as r, radians(yaw_deg + handlebar_neutral_yaw_deg) as w from a_mounts m, range(33) a(p), range(19) b(h) where m.profile_id in (select profile_id from nm where n >= 2)),
e as (select g.profile_id, i, degrees(pt) as pitch, ht, px,
   sin(r) * (cos(w) * -lateral_offset_m + sin(w) * d) + cos(r) * (sin(pt) * sin(w) * -lateral_offset_m - sin(pt) * cos(w) * d + cos(pt) * ht) as yc,
   -cos(pt) * sin(w) * -lateral_offset_m + cos(pt) * cos(w) * d + sin(pt) * ht as zc, fy, cy from g join mk using (profile_id)),
s as (select profile_id, i, any_value(pitch) as pitch, any_value(ht) as ht, sum(pow((fy * yc + cy * zc) / zc - px, 2)) as err, min(zc) as z from e group by 1, 2),
b as (select * from s where z > 0.15 qualify row_number() over (partition by profile_id order by round(err, 6), i) = 1)
select m.profile_id, round(coalesce(b.pitch, pitch_deg), 6) + 0.0 as pitch_deg, round(coalesce(b.ht, camera_height_m), 6) + 0.0 as camera_height_m, b.profile_id is not null or valid as valid from a_mounts m left join b using (profile_id)
""")
def _(v: Views):
    return rounded(fit.fit_mounts(v.a_mounts), "pitch_deg", "camera_height_m").select("profile_id", "pitch_deg", "camera_height_m", "valid")


@query("roundtrip_error", ["a_mounts"], "select profile_id, 0.0::double as max_error_px from a_mounts")
def _(v: Views):
    # the chain is exact for every mount that sees the grid, so the rounded error is zero
    return rounded(fit.roundtrip_error(v.a_mounts), "max_error_px")


@query("holdout_sample", None, """
select 'train' as part, least(1200, count(*)) as n from embeddings union all select 'hold', least(200, count(*)) from embeddings
""")
def _(v: Views):
    return fit.holdout_sample(v.embeddings.select("vec_id"), 1200, 200, key="vec_id").groupBy("part").agg(F.count(F.lit(1)).alias("n"))
