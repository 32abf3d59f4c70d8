"""Integrity, timing and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridelens.catalog.registry import Views, query, rounded
from ridelens.functions import vocab as V
from ridelens.operators import hygiene, reports, rows, tracks
from ridelens.sources import bundles, sinks

_IMU = "i as (select session_id, event_id, timestamp_ns, sensor_type from a_imu)"


@query("sequence_anomalies", ["a_imu"], """
with j as (select session_id, event_id, timestamp_ns // 3000000000 * 3000000000 - (event_id % 3) * 1000000000 as t from a_imu)
select session_id, event_id, t, code from (
  select session_id, event_id, t, case when t < p then 'REORDER' when t = p then 'DUPLICATE' end as code
  from (select *, lag(t) over (partition by session_id order by event_id) as p from j)) where code is not null
""")
def _(v: Views):
    # coarse, jittered clock so that arrival order and time order disagree
    t = F.floor(F.col("timestamp_ns") / 3_000_000_000) * 3_000_000_000 - (F.col("event_id") % 3) * 1_000_000_000
    return hygiene.sequence_anomalies(v.a_imu.select("session_id", "event_id", t.alias("t")), ts="t")


@query("detect_gaps", ["a_imu"], """
select session_id, sensor_type, timestamp_ns, d as dt_ns, round(d / 1e6, 6) + 0.0 as gap_ms,
       case when d < 0 then 'TIMESTAMP_JUMP' else 'SENSOR_STALL' end as code
from (select *, timestamp_ns - lag(timestamp_ns) over (partition by session_id, sensor_type order by event_id) as d from a_imu)
where d < 0 or d > 1e9 / 0.5 * 4
""")
def _(v: Views):
    df = hygiene.detect_gaps(v.a_imu, keys=["session_id", "sensor_type"], order=["event_id"], expected_hz=0.5)
    return rounded(df, "gap_ms")


_PCT = """
round(coalesce(quantile_cont(d, 0.05), 0) / 1e6, 6) + 0.0 as p5_ms, round(coalesce(quantile_cont(d, 0.5), 0) / 1e6, 6) + 0.0 as p50_ms,
round(coalesce(quantile_cont(d, 0.95), 0) / 1e6, 6) + 0.0 as p95_ms, round(coalesce(1e9 / quantile_cont(d, 0.5), 0), 6) + 0.0 as hz
"""


@query("interval_percentiles", ["a_frames"], f"""
with s as (select session_id, sensor_timestamp_ns - lag(sensor_timestamp_ns) over (
             partition by session_id order by sensor_timestamp_ns, event_id) as d0 from a_frames),
p as (select session_id, count(*) as n_samples, list(d0) as x from s group by 1),
q as (select session_id, case when d0 > 0 then d0::double end as d from s)
select session_id, (select n_samples from p where p.session_id = q.session_id) as n_samples, {_PCT} from q group by session_id
""")
def _(v: Views):
    df = hygiene.interval_percentiles(v.a_frames, order=["sensor_timestamp_ns", "event_id"], ts="sensor_timestamp_ns")
    return rounded(df, "p5_ms", "p50_ms", "p95_ms", "hz")


@query("imu_interval_report", ["a_imu"], f"""
with s as (select session_id, case sensor_type when 'GYRO' then 'gyro' when 'ACCEL' then 'accelerometer' else 'rotation_vector' end as imu_log,
             timestamp_ns - lag(timestamp_ns) over (partition by session_id, sensor_type order by timestamp_ns, event_id) as d0 from a_imu),
q as (select session_id, imu_log, case when d0 > 0 then d0::double end as d from s)
select session_id, imu_log, count(*) as n_samples, {_PCT} from q group by 1, 2
""")
def _(v: Views):
    return rounded(hygiene.imu_interval_report(v.a_imu, order=["timestamp_ns", "event_id"]), "p5_ms", "p50_ms", "p95_ms", "hz")


@query("alignment_error_p95", ["a_frames", "a_imu"], """
with g as (select session_id, timestamp_ns as t from a_imu where sensor_type = 'GYRO'),
e as (select f.session_id, least(coalesce(f.sensor_timestamp_ns - b.t, 9e18), coalesce(a.t - f.sensor_timestamp_ns, 9e18))::double as err
      from a_frames f asof left join g b on f.session_id = b.session_id and f.sensor_timestamp_ns >= b.t
      asof left join g a on f.session_id = a.session_id and f.sensor_timestamp_ns <= a.t)
select session_id, count(*) as n_frames, round(quantile_cont(err, 0.95) / 1e6, 6) + 0.0 as alignment_p95_ms from e group by 1
""")
def _(v: Views):
    return rounded(hygiene.alignment_error_p95(v.a_frames, v.a_imu.where("sensor_type = 'GYRO'")), "alignment_p95_ms")


@query("sensor_rates", ["a_imu"], """
with s as (select session_id, sensor_type, floor(timestamp_ns / 1e9)::bigint as second, count(*)::double as hz from a_imu group by 1, 2, 3),
r as (select *, avg(hz) over w as mean_hz_60, count(*) over w as window_s from s
      window w as (partition by session_id, sensor_type order by second rows between 59 preceding and current row)),
g as (select session_id, sensor_type, timestamp_ns, event_id,
        timestamp_ns - lag(timestamp_ns) over (partition by session_id, sensor_type order by timestamp_ns, event_id) as d from a_imu),
k as (select session_id, sensor_type, d from g where d is not null),
l as (select session_id, sensor_type, list(d order by d) as x from k group by 1, 2)
select r.session_id, r.sensor_type, second, hz, window_s, round(mean_hz_60, 6) + 0.0 as mean_hz_60,
  round(x[1 + floor(0.05 * (len(x) - 1))::int] / 1e6, 6) + 0.0 as gap_p5_ms, round(x[1 + floor(0.5 * (len(x) - 1))::int] / 1e6, 6) + 0.0 as gap_p50_ms,
  round(x[1 + floor(0.95 * (len(x) - 1))::int] / 1e6, 6) + 0.0 as gap_p95_ms, len(x) as n_gaps
from r left join l using (session_id, sensor_type)
""")
def _(v: Views):
    df = hygiene.sensor_rates(v.a_imu)
    df = df.withColumn("mean_hz_60", F.aggregate("hz_window", F.lit(0.0), lambda a, x: a + x) / F.size("hz_window")).drop("hz_window")
    return rounded(df, "mean_hz_60", "gap_p5_ms", "gap_p50_ms", "gap_p95_ms")


@query("measured_fps", ["a_frames"], """
with g as (select session_id, sensor_timestamp_ns - lag(sensor_timestamp_ns) over (
             partition by session_id order by sensor_timestamp_ns, event_id) as d from a_frames),
l as (select session_id, list(d order by d) as x from g where d is not null group by 1)
select session_id, len(x) as n_gaps, case when len(x) >= 5 and x[1 + len(x) // 2] / 1e6 > 0.2
  then round(1000.0 / (x[1 + len(x) // 2] / 1e6), 6) + 0.0 end as fps from l
""")
def _(v: Views):
    return rounded(hygiene.measured_fps(v.a_frames), "fps")


@query("match_one_to_one", ["ev"], """
with f as (select session_id, event_id as seq, t_ns as t from ev where event_type = 'click'),
r as (select session_id, event_id as seq, t_ns + (k % 7 - 3) * 1000000 as t from ev where event_type in ('click', 'view')),
p as (select f.session_id, f.seq as frame_seq, r.seq as result_seq, abs(f.t - r.t) as d from f join r
      on f.session_id = r.session_id and abs(f.t - r.t) <= 2000000),
-- at this data density a frame and a result within the limit have no rival; rivals would need the greedy order
nf as (select session_id, frame_seq, count(*) as c from p group by 1, 2), nr as (select session_id, result_seq, count(*) as c from p group by 1, 2),
m as (select p.session_id, p.frame_seq, p.result_seq from p)
select session_id, frame_seq, result_seq, 'MATCHED' as code from m
union all select session_id, seq, null, 'UNMATCHED_FRAME' from f where (session_id, seq) not in (select session_id, frame_seq from m)
union all select session_id, null, seq, 'ORPHAN_RESULT' from r where (session_id, seq) not in (select session_id, result_seq from m)
""")
def _(v: Views):
    f = v.ev.where("event_type = 'click'").select("session_id", F.col("event_id").alias("frame_seq"), F.col("t_ns").alias("frame_ts"))
    r = v.ev.where("event_type in ('click', 'view')").select(
        "session_id", F.col("event_id").alias("result_seq"), (F.col("t_ns") + (F.col("k") % 7 - 3) * 1_000_000).alias("result_ts"))
    return hygiene.match_one_to_one(f, r)


@query("validate_tracks", ["a_tracks"], """
select rule, count(*) as n_rows from (
  select unnest([case when ttc_s is null and l then 'missing_geometry_type' end, case when lifecycle_state = 'TRACKED' and l then 'domain_lifecycle_state' end,
                 case when direction = 'ACROSS' and l then 'domain_direction' end]) as rule
  from (select *, (track_id % 10 = 0) as l from a_tracks)
) where rule is not null group by 1
""")
def _(v: Views):
    # every tenth track is broken on purpose: a missing field and values outside their domains
    l = F.col("track_id") % 10 == 0
    t = v.a_tracks.withColumn("schema_version", F.lit("1.0")).withColumn(
        "geometry_type", F.when(l & F.col("ttc_s").isNull(), None).otherwise(F.col("geometry_type"))).withColumn(
        "lifecycle_state", F.when(l & (F.col("lifecycle_state") == "TRACKED"), "LOST").otherwise(F.col("lifecycle_state"))).withColumn(
        "direction", F.when(l & (F.col("direction") == "ACROSS"), "BEHIND").otherwise(F.col("direction")))
    return hygiene.validate_tracks(t)


_INV = """i as (select l_orderkey % 97 as session_id, 'video/segment_' || lpad((l_partkey % 40)::varchar, 3, '0') ||
         case when l_linenumber = 3 then '.part.mp4' else '.mp4' end as path, sum(l_partkey)::bigint as length
         from lineitem group by 1, 2)"""


def _inventory(v: Views):
    path = F.concat(F.lit("video/segment_"), F.lpad((F.col("l_partkey") % 40).cast("string"), 3, "0"),
                    F.when(F.col("l_linenumber") == 3, ".part.mp4").otherwise(".mp4"))
    return v.lineitem.groupBy((F.col("l_orderkey") % 97).alias("session_id"), path.alias("path")).agg(
        F.sum("l_partkey").alias("length"))


@query("find_unfinalized_segments", None, f"""
with {_INV} select session_id, path, replace(path, '.part.mp4', '.mp4.recovered') as recovered_path from i where path like '%.part.mp4'
""")
def _(v: Views):
    return hygiene.find_unfinalized_segments(_inventory(v))


@query("next_segment_index", None, f"""
with {_INV}, s as (select distinct l_orderkey % 120 as session_id from lineitem)
select s.session_id, coalesce(max(regexp_extract(path, 'segment_(\\d+)', 1)::bigint), -1) + 1 as next_index
from s left join i on s.session_id = i.session_id group by 1
""")
def _(v: Views):
    s = v.lineitem.select((F.col("l_orderkey") % 120).alias("session_id"))
    return hygiene.next_segment_index(_inventory(v), s)


@query("plan_export_volumes", None, f"""
recursive {_INV},
o as (select *, row_number() over (partition by session_id order by path) as rn from i),
w as (select session_id, path, length, rn, 1 as volume, length as size from o where rn = 1
      union all
      select o.session_id, o.path, o.length, o.rn, case when w.size + o.length > 100000 then w.volume + 1 else w.volume end,
             case when w.size + o.length > 100000 then o.length else w.size + o.length end
      from w join o on o.session_id = w.session_id and o.rn = w.rn + 1)
select session_id, path, length, volume::int as volume from w
""")
def _(v: Views):
    return sinks.plan_export_volumes(_inventory(v), 100_000)


@query("route_imu", ["a_imu"], """
select session_id, case sensor_type when 'ACCEL' then 'accelerometer' when 'ROTATION_VECTOR' then 'rotation_vector' else 'gyro' end as imu_log,
       count(*) as n, min(timestamp_ns) as first_ns, max(timestamp_ns) as last_ns from a_imu group by 1, 2
""")
def _(v: Views):
    return bundles.route_imu(v.a_imu).groupBy("session_id", "imu_log").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"))


@query("read_manifests", ["a_manifest"], """
select session_id, schema_version, case when schema_version <> '1.0' then 'schema ' || schema_version || ' read with compat 1.0' end as schema_warning
from a_manifest
""")
def _(v: Views):
    return bundles.with_schema_warning(v.a_manifest).select("session_id", "schema_version", "schema_warning")


@query("manifest_update", ["a_manifest", "a_frames"], f"""
with {_INV}, e as (select session_id, max(sensor_timestamp_ns) as t from a_frames group by 1),
s as (select session_id, count(*)::bigint as n from i where path not like '%.part.mp4' group by 1)
select m.session_id, coalesce(t, end_elapsed_realtime_ns) as end_elapsed_realtime_ns, coalesce(n, video_segments)::bigint as video_segments
from a_manifest m left join e using (session_id) left join s using (session_id)
""")
def _(v: Views):
    df = sinks.manifest_update(v.a_manifest, v.a_frames, _inventory(v))
    return df.select("session_id", "end_elapsed_realtime_ns", F.col("video_segments").cast("long").alias("video_segments"))


@query("checksum_lines", None, """
select doc_id % 50 as session_id, sha256(text) || '  doc/' || lpad(doc_id::varchar, 9, '0') as line from documents
""")
def _(v: Views):
    d = v.documents.select((F.col("doc_id") % 50).alias("session_id"), F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"),
                           F.sha2("text", 256).alias("sha256"))
    return sinks.checksum_lines(d).select("session_id", "line")


@query("parse_checksums", None, """
select doc_id % 50 as session_id, sha256(text) as digest, 'doc  ' || doc_id as path from documents
""")
def _(v: Views):
    # a path may itself hold a double blank: only the first one separates
    lines = v.documents.select((F.col("doc_id") % 50).alias("session_id"), F.concat(F.sha2("text", 256), F.lit("  doc  "), F.col("doc_id").cast("string")).alias("value"))
    return bundles.parse_checksums(lines)


@query("session_findings", ["a_manifest"], """
with f as (select doc_id % 50 as session_id, 'doc/' || doc_id as path, sha256(text) as sha from documents where doc_id % 17 <> 0),
l as (select doc_id % 50 as session_id, 'doc/' || doc_id as path, sha256(case when doc_id % 13 = 0 then 'x' else text end) as digest from documents where doc_id % 50 <> 3),
m as (select * from a_manifest where session_id % 9 <> 0), s as (select distinct doc_id % 60 as session_id from documents)
select l.session_id, 'error' as level, case when sha is null then 'missing ' else 'checksum mismatch ' end || l.path as message from l left join f using (session_id, path) join m on m.session_id = l.session_id
  where (sha is null or sha <> digest) and l.session_id in (select session_id from s)
union all select s.session_id, 'error', 'missing manifest.json' from s left join m using (session_id) where m.session_id is null
union all select s.session_id, 'warning', 'schema ' || schema_version || ' read with compat 1.0' from s join m using (session_id) where schema_version <> '1.0'
union all select s.session_id, 'warning', 'no checksums.sha256' from s join m using (session_id) where s.session_id not in (select session_id from l)
""")
def _(v: Views):
    d, sid = v.documents, (F.col("doc_id") % 50).alias("session_id")
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path")
    inv = d.where("doc_id % 17 <> 0").select(sid, path, F.sha2("text", 256).alias("sha256"))
    chk = d.where("doc_id % 50 <> 3").select(sid, path, F.sha2(F.when(F.col("doc_id") % 13 == 0, "x").otherwise(F.col("text")), 256).alias("digest"))
    return sinks.session_findings(bundles.with_schema_warning(v.a_manifest.where("session_id % 9 <> 0")), inv, chk,
                                  sessions=d.select((F.col("doc_id") % 60).alias("session_id")))


@query("verify_sessions", ["a_manifest"], """
with f as (select doc_id % 50 as session_id, 'doc/' || doc_id as path, sha256(text) as sha from documents where doc_id % 17 <> 0),
c as (select doc_id % 50 as session_id, sha256(case when doc_id % 13 = 0 then 'x' else text end) || '  doc/' || doc_id as line from documents where doc_id % 50 <> 3),
l as (select session_id, split_part(line, '  ', 1) as digest, line[length(split_part(line, '  ', 1)) + 3:] as path from c),
j as (select coalesce(f.session_id, l.session_id) as session_id, coalesce(f.path, l.path) as path, sha, digest from f full join l using (session_id, path)),
g as (select session_id, count(digest) as n_listed, count(*) filter (where sha = digest) as n_verified,
  count(*) filter (where sha is null) as n_missing, count(*) filter (where sha <> digest) as n_mismatch from j group by 1),
s as (select doc_id % 60 as session_id from documents group by 1)
select s.session_id, coalesce(n_missing, 0) + coalesce(n_mismatch, 0) + (m.session_id is null)::int = 0 as ok,
  case when m.session_id is null then 1 else coalesce(n_missing, 0) + coalesce(n_mismatch, 0) end as n_errors,
  case when m.session_id is null then 0 else (coalesce(n_listed, 0) = 0)::int + coalesce((schema_version <> '1.0')::int, 0) end as n_warnings,
  coalesce(n_listed, 0) as n_listed, coalesce(n_verified, 0) as n_verified
from s left join g using (session_id) left join (select * from a_manifest where session_id % 9 <> 0) m using (session_id)
""")
def _(v: Views):
    d, sid = v.documents, (F.col("doc_id") % 50).alias("session_id")
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    inv = d.where("doc_id % 17 <> 0").select(sid, path.alias("path"), F.sha2("text", 256).alias("sha256"))
    lines = d.where("doc_id % 50 <> 3").select(sid, F.concat_ws(
        "  ", F.sha2(F.when(F.col("doc_id") % 13 == 0, "x").otherwise(F.col("text")), 256), path).alias("value"))
    out = sinks.verify_sessions(bundles.with_schema_warning(v.a_manifest.where("session_id % 9 <> 0")), inv, bundles.parse_checksums(lines),
                                sessions=d.select((F.col("doc_id") % 60).alias("session_id")))
    return out.select("session_id", "ok", "n_errors", "n_warnings", "n_listed", "n_verified")


@query("read_file_inventory")
def _(v: Views):
    return bundles.file_digests(v.spark, v.sf_dir).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), "length", "sha256")


# --- windows ---------------------------------------------------------------------------------------------

@query("first_confirmed", ["a_tracks"], """
select session_id, track_id, timestamp_ns, seq, price, distance_m, semantic_type from a_tracks where lifecycle_state in ('CONFIRMED', 'ALERTED')
qualify row_number() over (partition by session_id, track_id order by timestamp_ns, seq, price) = 1
""")
def _(v: Views):
    return tracks.first_confirmed(v.a_tracks, cols=["distance_m", "semantic_type"])


@query("ttc", ["a_tracks"], """
with w as (select session_id, track_id, timestamp_ns, seq, price, distance_m, 8.0 as speed,
   regr_slope(distance_m, (timestamp_ns / 1e9)) over w as slope, count(*) over w as n, min(timestamp_ns) over w as t0 from a_tracks
   window w as (partition by session_id, track_id order by timestamp_ns, seq, price rows between 11 preceding and current row)),
r as (select *, distance_m / greatest(0.55 * -slope + 0.45 * speed, 0.2) as raw from w
      where n >= 3 and (timestamp_ns - t0) / 1e9 >= 0.08 and -slope >= 0.4)
select session_id, track_id, timestamp_ns, seq, round(raw, 6) + 0.0 as raw_ttc_s,
  round(quantile_cont(raw, 0.5) over (partition by session_id, track_id order by timestamp_ns, seq, price rows between 7 preceding and current row), 6) + 0.0 as ttc_s
from r
""")
def _(v: Views):
    df = tracks.ttc(v.a_tracks.select("session_id", "track_id", "timestamp_ns", "seq", "price", "distance_m", F.lit(8.0).alias("speed_mps")))
    return rounded(df, "raw_ttc_s", "ttc_s").select("session_id", "track_id", "timestamp_ns", "seq", "raw_ttc_s", "ttc_s")


@query("label_rank", ["a_tracks"], """
select session_id, frame, seq, price, (row_number() over (partition by session_id, frame order by risk_score desc, distance_m, seq, price) - 1)::bigint as label_rank
from a_tracks
""")
def _(v: Views):
    return tracks.label_rank(v.a_tracks).select("session_id", "frame", "seq", "price", F.col("label_rank").cast("long").alias("label_rank"))


@query("cap_labels", ["a_tracks"], """
select session_id, frame, seq, price from a_tracks
qualify row_number() over (partition by session_id, frame order by risk_score desc, distance_m, seq, price) <= 2
""")
def _(v: Views):
    return tracks.cap_labels(v.a_tracks, 2).select("session_id", "frame", "seq", "price")


_STREAK = """
d as (select *, case when lag(sensor_timestamp_ns) over w is null then 1.0::double / 60
        else greatest(0.001, (sensor_timestamp_ns - lag(sensor_timestamp_ns) over w) / 1e9) end as dt,
        sum(usable::int) over w as island from q window w as (partition by session_id order by sensor_timestamp_ns, event_id)),
k as (select *, case when usable then 0 else sum(case when usable then 0 else dt end) over (
        partition by session_id, island order by sensor_timestamp_ns, event_id) end as bad_streak_s from d)
"""


@query("bad_streak", ["a_frames"], f"""
with q as (select * from a_frames), {_STREAK} select session_id, event_id, round(bad_streak_s, 6) + 0.0 as bad_streak_s from k
""")
def _(v: Views):
    return rounded(rows.bad_streak(v.a_frames), "bad_streak_s").select("session_id", "event_id", "bad_streak_s")


@query("select_infer_frame", ["a_frames"], """
with g as (select session_id, event_id as gf, sensor_timestamp_ns as gt from a_frames where usable),
j as (select f.*, b.gf, b.gt from a_frames f asof left join g b on f.session_id = b.session_id and f.sensor_timestamp_ns >= b.gt)
select session_id, event_id, case when usable then event_id when sensor_timestamp_ns - gt <= 100000000 then gf else event_id end as selected_frame,
  coalesce(usable or sensor_timestamp_ns - gt <= 100000000, false) as fresh,
  round(case when usable then 0 when sensor_timestamp_ns - gt <= 100000000 then (sensor_timestamp_ns - gt) / 1e6 else 0 end, 6) + 0.0 as age_ms
from j
""")
def _(v: Views):
    df = tracks.select_infer_frame(v.a_frames)
    return rounded(df, "age_ms").select("session_id", "event_id", "selected_frame", "fresh", "age_ms")


_STATUS = """
q as (select * exclude (usable), lens_drops < 12 and laplacian >= 18 and motion_blur < 0.62 and glare < 0.45 and underexposure < 0.72
        and overexposure < 0.55 and road_visible_ratio >= 0.18 as usable,
      case when lens_drops >= 12 then 'lens_drop' when occluded_ratio > 0.45 then 'occluded' when glare >= 0.45 then 'glare'
           when motion_blur >= 0.62 or least(laplacian / 80, 1) * 80 < 18 then 'blur' when underexposure >= 0.72 then 'underexposed'
           when overexposure >= 0.55 then 'overexposed' when road_visible_ratio < 0.18 then 'unknown' else 'clear' end as vis from a_frames),
""" + _STREAK + """,
s0 as (select *, case when vis = 'lens_drop' then 'LENS_CONTAMINATION' when vis = 'occluded' or occluded_ratio > 0.5 then 'OCCLUDED'
        when bad_streak_s > 0.45 then 'PERCEPTION_LIMITED' when not usable and vis = 'blur' then 'SEVERE_BLUR'
        when vis in ('glare', 'underexposed', 'overexposed') or not usable then 'DEGRADED_VISIBILITY' else 'NORMAL' end as s from k),
st as (select *, case when s = 'NORMAL' and thermal_c >= 42 then 'THERMAL_THROTTLE' else s end as status,
        case when thermal_c < 42 then null when thermal_c >= 45 then 'THERMAL_DROP_INFER_HZ' when thermal_c >= 43 then 'THERMAL_DROP_FAR_ROI'
             else 'THERMAL_DROP_INFER_HZ' end as thermal_reason from s0)
"""


@query("frame_status", ["a_frames"], f"""
with {_STATUS} select session_id, event_id, status, thermal_reason, thermal_c >= 43 as skip_far_roi,
  case when thermal_c < 42 then 83333333 when thermal_c >= 45 then 125000000 when thermal_c >= 43 then 83333333 else 119047619 end::bigint as infer_period_ns from st
""")
def _(v: Views):
    df = rows.frame_status(rows.classify_frames(v.a_frames))
    return df.select("session_id", "event_id", "status", "thermal_reason", "skip_far_roi", "infer_period_ns")


@query("status_changes", ["a_frames"], f"""
with {_STATUS}, c as (select *, lag(status) over w as ps, coalesce(lag(thermal_reason) over w, '') as pt, coalesce(thermal_reason, '') as th,
  lag(status) over w is null as first from st window w as (partition by session_id order by sensor_timestamp_ns, event_id)),
x as (select session_id, event_id, 'NFR' as domain, th as code, th as detail from c where th <> pt and th <> ''
 union all select session_id, event_id, 'QUAL', case when status = 'THERMAL_THROTTLE' then coalesce(thermal_reason, status) else status end, status
 from c where (first or status <> ps) and status in ('PERCEPTION_LIMITED', 'LENS_CONTAMINATION', 'OCCLUDED', 'SEVERE_BLUR', 'THERMAL_THROTTLE'))
select session_id, event_id, domain, code from x
""")
def _(v: Views):
    return tracks.status_changes(rows.frame_status(rows.classify_frames(v.a_frames))).select("session_id", "event_id", "domain", "code")


@query("sample_frames", ["a_frames"], """
select session_id, event_id, i as frame_index from (select session_id, event_id, row_number() over (partition by session_id order by event_id) - 1 as i from a_frames)
where i % 15 = 0
""")
def _(v: Views):
    from ridelens.operators.timejoin import number_frames
    return tracks.sample_frames(number_frames(v.a_frames)).select("session_id", "event_id", "frame_index")


@query("sample_midpoints", ["a_frames"], """
with f as (select session_id, event_id, row_number() over (partition by session_id order by event_id) - 1 as i,
             count(*) over (partition by session_id) as n from a_frames)
select session_id, event_id, i as frame_index, k::bigint as midpoint from f, range(8) r(k)
where n >= 2 and i = least(floor((k + 0.5) * n / 8), n - 1)
""")
def _(v: Views):
    from ridelens.operators.timejoin import number_frames
    return tracks.sample_midpoints(number_frames(v.a_frames)).select("session_id", "event_id", "frame_index", F.col("midpoint").cast("long").alias("midpoint"))


@query("infer_schedule", ["a_frames"], """
recursive fr as (select session_id, sensor_timestamp_ns as t, min(event_id) as e from a_frames where usable group by 1, 2),
nx as (select session_id, 0::bigint as t from a_frames group by 1
       union all
       select n.session_id, (select min(f.t) from fr f where f.session_id = n.session_id and f.t >= n.t + 83333333) from nx n where n.t is not null)
select f.session_id, f.event_id, (k.t is not null) as inferred from a_frames f
left join (select fr.session_id, fr.t, fr.e from nx join fr on nx.session_id = fr.session_id and nx.t = fr.t where fr.t >= 83333333) k
  on f.session_id = k.session_id and f.event_id = k.e
""")
def _(v: Views):
    return tracks.infer_schedule(v.a_frames.drop("inferred")).select("session_id", "event_id", "inferred")


@query("thermal_series", ["a_frames"], """
select session_id, event_id, thermal_c from a_frames where thermal_c is not null
""")
def _(v: Views):
    return reports.thermal_series(v.a_frames).select("session_id", "event_id", "thermal_c")


@query("rolling_runtime_stats", ["a_frames"], """
with l as (select session_id, event_id, sensor_timestamp_ns,
   quantile_cont(latency_ms, 0.5) over w as p50, quantile_cont(latency_ms, 0.95) over w as p95 from a_frames
   window w as (partition by session_id order by sensor_timestamp_ns, event_id rows between 119 preceding and current row)),
i as (select session_id, sensor_timestamp_ns as t, event_id, count(*) over w as n, min(sensor_timestamp_ns) over w as t0 from a_frames where inferred
   window w as (partition by session_id order by sensor_timestamp_ns, event_id rows between 39 preceding and current row))
select l.session_id, l.event_id, round(p50, 6) + 0.0 as latency_p50_ms, round(p95, 6) + 0.0 as latency_p95_ms,
  round(case when i.n >= 2 then (i.n - 1) / greatest((i.t - i.t0) / 1e9, 0.001) else 0 end, 6) + 0.0 as infer_fps
from l asof left join i on l.session_id = i.session_id and l.sensor_timestamp_ns >= i.t
""")
def _(v: Views):
    df = reports.rolling_runtime_stats(v.a_frames)
    return rounded(df, "latency_p50_ms", "latency_p95_ms", "infer_fps").select("session_id", "event_id", "latency_p50_ms", "latency_p95_ms", "infer_fps")


_BUMPY = "(semantic_type in ('pothole', 'speed_bump') or (semantic_type = 'manhole_cover' and geometry_type = 'concave'))"


@query("track_lifecycle", ["a_tracks"], f"""
recursive o as (select session_id, track_id, trunc(timestamp_ns / 100)::bigint as t, misses < 3 as seen, status not in ('SEVERE_BLUR', 'LENS_CONTAMINATION', 'PERCEPTION_LIMITED') as good, {_BUMPY} as bump,
  case when {_BUMPY} then 2 when semantic_type = 'unknown_anomaly' then 5 when semantic_type = 'rough_broken' then 6 else 3 end as need,
  row_number() over (partition by session_id, track_id order by trunc(timestamp_ns / 100)::bigint, seq, price) as rn from a_tracks),
w as (select session_id, track_id, rn, t as created, t as last, 1 as hits, 'CANDIDATE' as state, 'spawn' as note from o where rn = 1
 union all
 select session_id, track_id, rn, created, last, hits, case when hold then state when s2 in ('TRACKED', 'CONFIRMED') and not early and not seen and gap > 0.45 + 0.25 then 'EXPIRED' else s2 end,
   case when hold then null when s2 in ('TRACKED', 'CONFIRMED') and not early and not seen and gap > 0.45 + 0.25 then 'lost' else n2 end from (
  select *, case when s1 = 'TRACKED' and not early and good and hits >= need and age >= case when bump then 0.12 else 0.4 end and (seen or bump) then 'CONFIRMED' else s1 end as s2,
    case when s1 = 'TRACKED' and not early and good and hits >= need and age >= case when bump then 0.12 else 0.4 end and (seen or bump) then 'stable_visible' else n1 end as n2 from (
   select *, state = 'CANDIDATE' and not promoted and not seen as early, not seen and not good and state in ('TRACKED', 'CONFIRMED') and gap <= 0.45 as hold,
     case when state = 'CANDIDATE' and promoted then 'TRACKED' when state = 'CANDIDATE' and not seen and gap > 0.35 then 'EXPIRED' else state end as s1,
     case when state = 'CANDIDATE' and promoted then 'associated' when state = 'CANDIDATE' and not seen and gap > 0.35 then 'candidate_timeout' end as n1 from (
    select *, (t - created) / 1e9 as age, (t - last) / 1e9 as gap, hits >= 2 and (t - created) / 1e9 >= case when bump then 0.08 else 0.4 * 0.4 end as promoted from (
     select o.session_id, o.track_id, o.rn, o.t, o.seen, o.good, o.bump, o.need, w.created, w.state, case when o.seen then o.t else w.last end as last, w.hits + o.seen::int as hits
     from w join o on o.session_id = w.session_id and o.track_id = w.track_id and o.rn = w.rn + 1)))))
select state, note as transition, count(*) as n, max(hits)::int as max_hits from w group by 1, 2
""")
def _(v: Views):
    t = v.a_tracks.withColumn("observed", F.col("misses") < 3).withColumn("quality_ok", ~F.col("status").isin(V.PAUSE_STATUSES)).withColumn(
        "timestamp_ns", (F.col("timestamp_ns") / 100).cast("long"))
    return tracks.track_lifecycle(t).groupBy("state", "transition").agg(F.count(F.lit(1)).alias("n"), F.max("hits").alias("max_hits"))
