"""Hand-made cases with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ridelens.config import AlertConfig, TrackingConfig
from ridelens.functions import scoring, shapes
from ridelens.functions import vocab as V
from ridelens.functions.numbers import round_exact
from ridelens.operators import alert_policy, curation, fit, hygiene, queues, reports, rows, spatial, timejoin, tracking, tracks

S, MS = 1_000_000_000, 1_000_000


def table(spark, ddl, data):
    return spark.createDataFrame(data, ddl)


def test_interp_linear_midpoint(spark):
    f = table(spark, "session_id string, sensor_timestamp_ns long", [("a", S // 2), ("a", -5), ("a", 2 * S), ("b", 1)])
    s = table(spark, "session_id string, timestamp_ns long, x double, y double", [("a", 0, 0.0, 10.0), ("a", S, 10.0, 20.0)])
    got = {(r.session_id, r.sensor_timestamp_ns): (r.x, r.y) for r in timejoin.interp_linear(f, s, ["x", "y"]).collect()}
    assert got == {("a", S // 2): (5.0, 15.0), ("a", -5): (0.0, 10.0), ("a", 2 * S): (10.0, 20.0), ("b", 1): (None, None)}


def test_quaternion_sign(spark):
    f = table(spark, "session_id string, sensor_timestamp_ns long", [("a", S // 2)])
    p = table(spark, "session_id string, timestamp_ns long, qx double, qy double, qz double, qw double", [("a", 0, 0.0, 0.0, 0.0, 1.0), ("a", S, 0.0, 0.0, 0.0, -1.0)])
    r = timejoin.interp_quaternion(f, p).first()
    assert abs(math.sqrt(r.qx ** 2 + r.qy ** 2 + r.qz ** 2 + r.qw ** 2) - 1) < 1e-12 and r.qw == 1.0


@pytest.mark.parametrize("chunk", [None, 5.0])
def test_quaternion_sign_chain_restarts_at_zero(spark, chunk):
    raw = [(1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0), (0.6, -0.8), (-0.6, 0.8)]
    p = table(spark, "session_id string, timestamp_ns long, qx double, qy double, qz double, qw double", [("a", i * 3, 0.0, 0.0, z, w) for i, (z, w) in enumerate(raw)])
    got = [(r.qz, r.qw) for r in timejoin.continuous_quaternions(p, chunk=chunk).orderBy("timestamp_ns").collect()]
    want = [raw[0]]
    for z, w in raw[1:]:
        s = -1 if want[-1][0] * z + want[-1][1] * w < 0 else 1
        want.append((s * z, s * w))
    assert [(round(a, 9) + 0.0, round(b, 9) + 0.0) for a, b in got] == [(round(a, 9) + 0.0, round(b, 9) + 0.0) for a, b in want]


def test_location_midpoint(spark):
    f = table(spark, "session_id string, sensor_timestamp_ns long", [("a", S // 2), ("a", 0), ("a", S)])
    cols = "session_id string, timestamp_ns long, latitude double, longitude double, altitude double, speed_mps double, bearing_deg double, horizontal_accuracy_m double, speed_accuracy_mps double"
    loc = table(spark, cols, [("a", 0, 31.0, 121.0, 8.0, 10.0, 350.0, 3.0, None), ("a", S, 32.0, 122.0, 10.0, 20.0, 10.0, None, None)])
    got = {r.sensor_timestamp_ns: r for r in timejoin.interp_location(f, loc).collect()}
    m = got[S // 2]
    assert (m.latitude, m.speed_mps, m.interpolated, m.horizontal_accuracy_m) == (31.5, 15.0, True, 3.0)
    assert abs(m.bearing_deg % 360) < 1e-9 and abs(m.speed_accuracy_mps - 0.4 * 3) < 1e-12
    assert not got[0].interpolated and got[0].speed_accuracy_mps is None and not got[S].interpolated is None


def test_reorder_and_pairs(spark):
    f = table(spark, "session_id string, frame_seq long, frame_ts long", [("a", i, t) for i, t in enumerate([10, 20, 15, 30])])
    r = table(spark, "session_id string, result_seq long, result_ts long", [("a", i, t) for i, t in enumerate([10, 20, 30])])
    out = hygiene.match_one_to_one(f, r, max_dt_ns=2).collect()
    assert sum(x.code == "MATCHED" for x in out) == 3 and sum(x.code == "UNMATCHED_FRAME" for x in out) == 1
    seq = hygiene.sequence_anomalies(f.withColumnRenamed("frame_ts", "timestamp_ns").withColumnRenamed("frame_seq", "event_id")).collect()
    assert [x.code for x in seq] == ["REORDER"]


@pytest.mark.parametrize("chunk", [None, 40.0])
def test_one_to_one_matching_is_greedy(spark, chunk):
    random.seed(9)
    fr = [random.randrange(0, 400) for _ in range(120)]
    rs = [random.randrange(0, 400) for _ in range(110)]
    used, want = set(), {}
    last = {t: j for j, t in enumerate(rs)}
    for i, t in enumerate(fr):
        j = last.get(t)
        if j is None or j in used:
            cand = [(abs(x - t), k) for k, x in enumerate(rs) if k not in used]
            d, j = min(cand) if cand else (99, None)
            if d > 2:
                want[i] = None
                continue
        used.add(j)
        want[i] = j
    f = table(spark, "session_id string, frame_seq long, frame_ts long", [("a", i, t) for i, t in enumerate(fr)])
    r = table(spark, "session_id string, result_seq long, result_ts long", [("a", i, t) for i, t in enumerate(rs)])
    out = hygiene.match_one_to_one(f, r, max_dt_ns=2, chunk=chunk).collect()
    assert {x.frame_seq: x.result_seq for x in out if x.frame_seq is not None} == want
    assert {x.result_seq for x in out if x.code == "ORPHAN_RESULT"} == set(range(110)) - used


def test_stall_and_intervals(spark):
    d = table(spark, "session_id string, event_id long, timestamp_ns long", [("a", i, t * MS) for i, t in enumerate([0, 5, 10, 80])])
    assert [r.code for r in hygiene.detect_gaps(d).collect()] == ["SENSOR_STALL"]
    steady = table(spark, "session_id string, timestamp_ns long", [("a", i * 5 * MS) for i in range(50)] + [("z", 7)])
    got = {r.session_id: r for r in hygiene.interval_percentiles(steady).collect()}
    assert 4.5 < got["a"].p50_ms < 5.5 and got["z"].hz == 0.0 and got["z"].p95_ms == 0.0


def test_alignment(spark):
    cam = table(spark, "session_id string, sensor_timestamp_ns long", [("a", int(i * S / 60)) for i in range(120)] + [("b", 1)])
    imu = table(spark, "session_id string, timestamp_ns long", [("a", int(i * S / 200)) for i in range(400)])
    got = {r.session_id: r.alignment_p95_ms for r in hygiene.alignment_error_p95(cam, imu).collect()}
    assert got["a"] <= 10 and math.isinf(got["b"])


def test_future_impact(spark):
    cols = "session_id string, track_id long, timestamp_ns long, seq long, lifecycle_state string, semantic_type string, geometry_type string, distance_m double, own_speed_mps double"
    t = table(spark, cols, [("a", 1, 0, 0, "CONFIRMED", "speed_bump", "convex", 10.0, 10.0), ("a", 2, 0, 1, "CONFIRMED", "repair_patch", "flat", 25.0, 10.0),
                            ("a", 3, 0, 2, "TRACKED", "pothole", "concave", 10.0, 10.0)])
    acc = table(spark, "session_id string, timestamp_ns long, z double", [("a", i * 50 * MS, 17.81 if 18 <= i <= 22 else 9.81) for i in range(80)])
    al = reports.align_future_impact(t, acc, order=("timestamp_ns", "seq"))
    got = {r.track_id: r for r in al.collect()}
    assert set(got) == {1, 2} and got[1].expected_pass_s == 1.0 and got[1].peak_ms2 > 5 and got[2].peak_ms2 < got[1].peak_ms2
    assert got[1].impact_label != "none" and not got[1].used_for_alert
    assert reports.impact_report(al).first()["pass"]


def test_impact_label_and_crash(spark):
    d = table(spark, "p double, v double", [(0.2, 10.0), (8.0, 10.0)])
    assert [r[0] for r in d.select(scoring.impact_label(F.col("p"), F.col("v"))).collect()] == ["none", "strong"]
    imu = table(spark, "session_id string, event_id long, timestamp_ns long, x double, y double, z double", [("a", 0, 5, 0.0, 0.0, 9.81), ("a", 1, 6, 0.0, 0.0, 55.0)])
    r = reports.crash_scan(imu).first()
    assert (r.n_samples, r.n_hits, r.first_hit_ns) == (2, 1, 6)
    z = table(spark, "x double, y double, z double", [(0.0, 0.0, v) for v in (9.81, 29.81, 49.81)])
    assert [r.severe for r in rows.flag_impacts(z).collect()] == [False, False, True]


def test_alert_rate(spark):
    m = table(spark, "session_id string, start_elapsed_realtime_ns long, end_elapsed_realtime_ns long", [("a", 0, 1800 * S)])
    f = table(spark, "session_id string, event_id long, sensor_timestamp_ns long", [("a", 0, 1)])
    al = table(spark, "session_id string, fired boolean", [("a", True), ("a", False)])
    r = reports.alert_rate_report(reports.session_hours(m, f), al).first()
    assert (r.hours, r.n_alerts_fired, r.alerts_per_hour, r.hours_ok, r["pass"]) == (0.5, 1, 2.0, False, False)


BASE = dict(session_id="s", track_id=7, timestamp_ns=S, seq=0, price=0.0, lifecycle_state="CONFIRMED", semantic_type="pothole", geometry_type="concave",
            object_state="abnormal", severity=3, direction="CENTER_FRONT", ttc_s=1.1, model_confidence=0.9, visibility_confidence=0.85, temporal_confidence=0.9,
            geometry_consistency=0.85, effective_confidence=0.7, path_relevance=0.9, status="NORMAL", geometry_valid=True)
DDL = ("session_id string, track_id long, timestamp_ns long, seq long, price double, lifecycle_state string, semantic_type string, geometry_type string, object_state string, severity int, "
       "direction string, ttc_s double, model_confidence double, visibility_confidence double, temporal_confidence double, geometry_consistency double, effective_confidence double, "
       "path_relevance double, status string, geometry_valid boolean")


def alert_rows(spark, *changes):
    return table(spark, DDL, [tuple({**BASE, "seq": i, **c}[n.split()[0]] for n in DDL.split(", ")) for i, c in enumerate(changes)])


def test_gates(spark):
    d = alert_rows(spark, {}, {"semantic_type": "manhole_cover", "geometry_type": "flat", "object_state": "normal", "severity": 0}, {"path_relevance": 0.1},
                   {"status": "SEVERE_BLUR"}, {"status": "OCCLUDED"}, {"status": "OCCLUDED", "semantic_type": "rough_broken", "geometry_type": "rough"}, {"semantic_type": "puddle"},
                   {"lifecycle_state": "TRACKED"}, {"geometry_valid": False}, {"direction": "UNKNOWN"}, {"severity": 1})
    got = [r.gate_reason for r in rows.gate_alerts(d).orderBy("seq").collect()]
    assert got == [None, "normal_or_flat", "off_corridor", "quality_pause", None, "quality_pause", "info_layer", "not_confirmed", "geometry_invalid", "direction_unknown", "severity_too_low"]
    assert rows.gate_alerts(d, AlertConfig(enabled=False)).first().gate_reason == "alerts_disabled"


def test_policy_state(spark):
    d = alert_rows(spark, {}, {"timestamp_ns": 2 * S}, {"timestamp_ns": 2 * S, "track_id": 8}, {"timestamp_ns": 4 * S, "track_id": 9},
                   {"timestamp_ns": 4 * S, "track_id": 9, "semantic_type": "speed_bump", "geometry_type": "convex"}, {"timestamp_ns": 9 * S, "track_id": 10, "severity": -1})
    got = [(r.reason, r.phrase) for r in alert_policy.alert_policy(d).orderBy("timestamp_ns", "seq").collect()]
    assert [g[0] for g in got] == ["fired", "already_alerted", "global_cooldown", "class_cooldown", "fired", "fired"]
    assert got[0][1] == "正前方大坑" and got[4][1] == "正前方减速带" and got[5][1] == "正前方路面异常"
    zero = alert_rows(spark, {"timestamp_ns": 0}, {"timestamp_ns": 1, "track_id": 8})
    assert [r.reason for r in alert_policy.alert_policy(zero).collect()] == ["fired", "fired"]  # a fire at time 0 starts no cooldown


def test_phrases(spark):
    d = table(spark, "fired boolean, phrase string, direction string, semantic_type string, geometry_type string, object_state string, severity int",
              [(True, "正前方下沉井盖", "CENTER_FRONT", "manhole_cover", "concave", "abnormal", 3), (True, "左前方大坑 brake now", "LEFT_FRONT", "pothole", "concave", "abnormal", 3)])
    out = rows.audit_phrases(d).collect()
    assert len(out) == 1 and out[0].has_forbidden and out[0].expected_phrase == "左前方大坑"


def test_admission(spark):
    sq = [[0.0, 0.0], [80.0, 0.0], [80.0, 50.0], [0.0, 50.0]]
    d = table(spark, "fresh boolean, usable boolean, status string, width int, height int, occluded_polygons array<array<array<double>>>", [(True, True, "OCCLUDED", 100, 100, [sq]), (True, True, "NORMAL", 100, 100, [sq, sq])])
    a, b = rows.admission_gate(d).collect()
    assert a.occlusion_ratio >= 0.39 and not a.allow_new and b.occlusion_ratio == 0.8
    assert [r.allow_new for r in rows.admission_gate(d.withColumn("occluded_polygons", F.slice("occluded_polygons", 1, 0))).collect()] == [True, True]


def test_hit_test_and_contains(spark):
    t = table(spark, "frame long, seq long, track_id long, polygon array<array<double>>", [(1, 0, 8, [[-50.0, -50.0], [60.0, -50.0], [60.0, 60.0], [-50.0, 60.0]]), (1, 1, 9, [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]), (1, 2, 7, [[0.0, 0.0], [9.0, 9.0]])])
    p = table(spark, "frame long, point_id long, x double, y double", [(1, 0, 5.0, 5.0), (1, 1, 55.0, 50.0), (1, 2, 500.0, 50.0)])
    assert {r.point_id: r.track_id for r in spatial.hit_test(p, t).collect()} == {0: 9, 1: 8}
    c = table(spark, "p array<array<double>>", [([[0.0, 0.0], [10.0, 0.0], [5.0, 5.0], [10.0, 10.0], [0.0, 10.0]],)])
    assert c.select(shapes.contains(F.col("p"), F.lit(8.0), F.lit(5.0)), shapes.contains(F.col("p"), F.lit(2.0), F.lit(5.0))).first()[:] == (False, True)


def test_calibration(spark):
    d = table(spark, "confidence double, correct int", [(0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1)])
    dia = reports.reliability_diagram(d, bins=2)
    r = reports.calibration_error(dia).first()
    assert r.n == 4 and abs(r.ece - 0.15) < 1e-9
    assert [x.n for x in reports.reliability_diagram(d, bins=10).orderBy("bin").collect()] == [0, 1, 1, 0, 0, 0, 0, 0, 1, 1]


def test_privacy(spark):
    d = table(spark, "t string", [('{"latitude": 31.2304, "x": "C:\\\\ride\\\\a.mp4"}',)])
    assert rows.redact_text(d, "t").first().t == '{"latitude": null, "x": "[path]"}'
    j = rows.redact_json_object(table(spark, "t string", [('{"lat": 3.5, "file_path": "/a/b.mp4", "note": "see /a/b.mp4", "latency_ms": 4}',)]), "t").first().t
    assert j == {"lat": None, "file_path": "[redacted]", "note": "see [path]", "latency_ms": None}


def test_labels(spark):
    raw = ["D40", "d00", "manhole", "Repair_Patch", "speed-bump", "nonsense", "subsidence"]
    d = table(spark, "raw string, severity_raw string, source string", [(r, None, "RDD_2022") for r in raw] + [("D40", "severe", "")])
    out = curation.map_public_labels(d).collect()
    assert [r.semantic_type for r in out] == ["pothole", "rough_broken", "manhole_cover", "repair_patch", "speed_bump", "unknown_anomaly", "unknown_anomaly", "pothole"]
    assert [r.alert_eligible for r in out] == [True, False, False, False, True, False, True, True]
    assert (out[0].severity, out[7].severity, out[0].source, out[7].source, out[5].severity) == (2, 3, "rdd 2022", "unknown", -1)


def test_splits(spark):
    ids = table(spark, "session_id string", [(f"s{i}",) for i in range(4)])
    s = curation.split_sessions(ids).collect()
    assert len({r.session_id for r in s}) == 4 and sorted(r.split for r in s) == ["test", "test", "train", "train"]
    for n, want in ((1, ["train", "val"]), (2, ["train", "val"]), (3, ["train", "train", "val"])):
        c = table(spark, "clip string", [(f"c{i}",) for i in range(n)])
        assert sorted(r.split for r in curation.clip_split(c).collect()) == want
    four = curation.clip_split(table(spark, "clip string", [(f"c{i}",) for i in range(5)])).collect()
    assert sorted(r.split for r in four) == ["test", "test", "train", "train", "val"]
    assert curation.leakage_check(curation.split_sessions(ids)).count() == 0


def test_revision_merge(spark):
    t = table(spark, "track_id long, frame_id long, human_revision map<string,string>", [(1, 1, {"a": "0", "b": "1"}), (2, 1, None)])
    p = table(spark, "track_id long, frame_id long, seq long, key string, value string", [(1, 1, 1, "b", "2"), (1, 1, 2, "b", "3"), (1, 1, 1, "c", "4")])
    got = {r.track_id: r.human_revision for r in curation.apply_revisions(t, p).collect()}
    assert got == {1: {"a": "0", "b": "3", "c": "4"}, 2: None}


@pytest.mark.parametrize("block", [256, 7, 1])
@pytest.mark.parametrize("plus_one", [False, True])
def test_nms_agrees_with_greedy(spark, block, plus_one):
    random.seed(1)
    data = [(i % 3 if i % 5 else 0, i, random.random(), *(lambda x, y: (x, y, x + random.randrange(10, 60), y + random.randrange(10, 60)))(random.randrange(150), random.randrange(90))) for i in range(150)]
    df = table(spark, "image int, seq int, conf double, x0 double, y0 double, x1 double, y1 double", [(r[0], r[1], r[2], *map(float, r[3:])) for r in data])
    def iou(a, b):
        e = 1 if plus_one else 0
        w, h = min(a[5], b[5]) - max(a[3], b[3]) + e, min(a[6], b[6]) - max(a[4], b[4]) + e
        inter = max(w, 0) * max(h, 0)
        area = lambda r: (r[5] - r[3] + e) * (r[6] - r[4] + e)
        return inter / (area(a) + area(b) - inter + (1e-9 if plus_one else 0))
    keep = []
    for r in sorted(data, key=lambda r: -r[2]):
        if all((iou(k, r) <= 0.2) if plus_one else (iou(k, r) < 0.2) for k in keep if k[0] == r[0]):
            keep.append(r)
    got = spatial.nms(df, tie=("seq",), iou_threshold=0.2, plus_one=plus_one, block=block).collect()
    assert sorted(r.seq for r in got) == sorted(r[1] for r in keep)


def test_decode(spark):
    d = table(spark, "xc double, yc double, w double, h double, scores array<double>, width int, height int", [(320.0, 320.0, 64.0, 64.0, [0.1, 0.9], 1280, 640), (10.0, 10.0, 5.0, 5.0, [0.01, 0.02], 1280, 640), (10.0, 10.0, 5.0, 5.0, [0.7, 0.2], 1280, 640)])
    out = spatial.decode_detections(d, [" ", "pothole"]).collect()
    assert len(out) == 1 and out[0].name == "pothole" and (out[0].x0, out[0].y0, out[0].x1, out[0].y1) == (576.0, 256.0, 704.0, 384.0)


def test_field_gates(spark):
    ddl = "alias string, overlay_ok boolean, frames long, n_confirmed_tracks long, n_alerts_fired long, n_rough_broken_confirmed long, n_info_confirmed long, n_bump_confirmed long, road_frame_share double"
    d = table(spark, ddl, [("night_25013", True, 90, 12, 0, 12, None, None, 0.8), ("night_25013", True, 90, 2, 0, 0, 2, None, 0.7), ("day_25007", True, 90, 1, 0, 0, None, None, 0.6), ("night_25013", True, 90, 1, 1, 0, None, 1, 0.7)])
    g = reports.field_gates(d)
    out = g.collect()
    assert [r["pass"] for r in out] == [False, True, True, True] and "night_no_alerts" not in out[3].checks
    assert not reports.field_report(g).first()["pass"]


def ellipse(cx, cy, rx, ry):
    return [[cx + rx * math.cos(2 * math.pi * i / 18), cy + ry * math.sin(2 * math.pi * i / 18)] for i in range(18)]


def track_input(spark, frames, sem="pothole", geo="concave"):
    data = []
    for i, (ts, cx, cy, good, new) in enumerate(frames):
        p = ellipse(cx, cy, 20, 12)
        data.append(("s", ts, i, good, new, 0.0, 1920.0, 0, sem, geo, "abnormal", 2, 0.85, 0.8, float(cx), cy + 11.0, min(a for a, _ in p), min(b for _, b in p), max(a for a, _ in p), max(b for _, b in p)))
    ddl = ("session_id string, timestamp_ns long, frame_id long, quality_ok boolean, allow_new boolean, yaw_rate double, frame_width double, obs_index int, semantic_type string, "
           "geometry_type string, state string, severity int, model_confidence double, quality_at_mask double, contact_x double, contact_y double, x0 double, y0 double, x1 double, y1 double")
    return table(spark, ddl, data)


def test_tracking_keeps_one_id(spark):
    d = track_input(spark, [(i * 50 * MS, 400 + i * 3, 600 + i * 2, True, True) for i in range(12)])
    out = tracking.track_sessions(d, cfg=TrackingConfig(confirm_window_s=0.3)).collect()
    assert {r.track_id for r in out} == {1} and any(r.lifecycle_state == "CONFIRMED" for r in out)


def test_expired_candidates_are_forgotten(spark):
    cfg = TrackingConfig(expired_memory_s=5.0)
    state = tracking.new_session()
    names = [*tracking.FRAME, *tracking.OBS]
    seen = [dict(timestamp_ns=i * 33 * MS, frame_id=i, quality_ok=True, allow_new=True, yaw_rate=0.0, frame_width=1920.0, obs_index=None, semantic_type=None, geometry_type=None,
                 state=None, severity=None, model_confidence=None, quality_at_mask=None, contact_x=None, contact_y=None, x0=None, y0=None, x1=None, y1=None) for i in range(600)]
    for i in range(30):
        seen[i].update(obs_index=0, semantic_type="pothole", geometry_type="concave", state="abnormal", severity=2, model_confidence=0.9, quality_at_mask=0.9,
                       contact_x=60.0 * i, contact_y=50.0, x0=60.0 * i, y0=0.0, x1=60.0 * i + 9, y1=50.0)
    tracking.step_rows(state, {n: [r[n] for r in seen] for n in names}, range(len(seen)), lambda row: None, cfg)
    assert len(state["tracker"]["info"]) == 0


def test_tracking_gates(spark):
    blur = track_input(spark, [(0, 400, 600, True, True), (80 * MS, 900, 200, False, False)])
    assert {r.track_id for r in tracking.track_sessions(blur).collect()} == {1}
    slow = track_input(spark, [(i * 80 * MS, 400, 500, True, True) for i in range(3)], sem="unknown_anomaly", geo="unknown")
    out = tracking.track_sessions(slow, cfg=TrackingConfig(min_confirm_hits=2, unknown_anomaly_extra_hits=3, confirm_window_s=0.2)).collect()
    assert all(r.lifecycle_state != "CONFIRMED" for r in out)
    lost = track_input(spark, [(i * 100 * MS, 400, 500, True, True) for i in range(6)] + [(2 * S + i * 100 * MS, 1700, 100, True, True) for i in range(2)])
    out = tracking.track_sessions(lost).orderBy("timestamp_ns").collect()
    assert ("lost", "EXPIRED") in {(r.transition, r.lifecycle_state) for r in out if r.track_id == 1}


def test_lifecycle_steps(spark):
    ddl = "session_id string, track_id long, timestamp_ns long, seq long, price double, semantic_type string, geometry_type string, observed boolean, quality_ok boolean"
    d = table(spark, ddl, [("s", 1, t * MS, t, 0.0, "pothole", "concave", seen, True) for t, seen in ((0, True), (100, True), (150, True), (300, False), (900, False))]
              + [("s", 2, t * MS, t, 0.0, "gravel", "flat", seen, True) for t, seen in ((0, True), (300, False), (400, False))])
    out = {(r.track_id, r.timestamp_ns // MS): (r.state, r.transition) for r in tracks.track_lifecycle(d).collect()}
    assert out[(1, 0)] == ("CANDIDATE", "spawn") and out[(1, 100)] == ("TRACKED", "associated") and out[(1, 150)] == ("CONFIRMED", "stable_visible")
    assert out[(1, 300)] == ("CONFIRMED", None) and out[(1, 900)] == ("EXPIRED", "lost")
    assert out[(2, 300)] == ("CANDIDATE", None) and out[(2, 400)] == ("EXPIRED", "candidate_timeout")


@pytest.mark.parametrize("chunk", [None, 100.0, 7.0])
def test_infer_schedule_chunks(spark, chunk):
    random.seed(2)
    ts = sorted(random.sample(range(1, 2000), 400))
    d = table(spark, "session_id string, event_id long, sensor_timestamp_ns long, usable boolean", [("s", i, t, t % 4 != 0) for i, t in enumerate(ts)])
    last, want = 0, set()
    for t in ts:
        if t % 4 and t - last >= 30:
            last = t
            want.add(t)
    got = tracks.infer_schedule(d, period_ns=30, chunk=chunk).collect()
    assert len(got) == 400 and {r.sensor_timestamp_ns for r in got if r.inferred} == want


@pytest.mark.parametrize("chunk", [None, 6.0])
def test_mask_round_trip(spark, chunk):
    random.seed(4)
    px = [(m, x, y, int(random.random() < 0.4)) for m in (1, 2) for x in range(8) for y in range(5)]
    px[0] = (1, 0, 0, 1)
    d = table(spark, "mask_id int, x int, y int, label int", px).withColumn("height", F.lit(5))
    enc = rows.encode_runs(rows.mask_runs(d, keys=["mask_id"], chunk=chunk), keys=["mask_id"])
    for r in enc.collect():
        flat = [v for m, x, y, v in sorted(px, key=lambda p: (p[0], p[1], p[2])) if m == r.mask_id]
        back = [b for i, n in enumerate(r.counts) for b in [i % 2] * n]
        assert back == flat
    cov = rows.mask_coverage(enc.select(F.lit(1).alias("frame"), F.lit("pothole").alias("semantic_type"), F.struct(F.lit(8).alias("width"), F.lit(5).alias("height"), F.col("counts").cast("array<int>").alias("counts")).alias("mask_rle")))
    assert cov.first().covered_px == sum(p[3] for p in px)


def test_active_queue(spark):
    t = table(spark, "session_id string, track_id long, source_frame_id long, timestamp_ns long, seq long, price double, effective_confidence double, semantic_type string, visibility_confidence double",
              [("s", 0, 1, 1, 0, 0.0, 0.0, "pothole", 0.9), ("s", 5, 1, 2, 1, 0.0, 0.95, "pothole", 0.9), ("s", 5, 1, 3, 2, 0.0, 0.5, "unknown_anomaly", 0.1), ("s", 6, 2, 4, 3, 0.0, 0.9, "unknown_anomaly", 0.1)])
    a = table(spark, "session_id string, track_id long, fired boolean", [("s", 0, True), ("s", 6, True)])
    out = queues.active_learning_queue(t, a).orderBy("pos").collect()
    # confidence 0 counts as 0.5; fired track 0 counts as -1; the duplicate (5, 1) keeps its first row, which has no reason
    assert [(r.track_id, r.score) for r in out] == [(0, 1.15), (6, 1.0)] and out[0].reasons == ["uncertain_confidence"]


def test_geometry_fit(spark):
    from ridelens.functions import camera
    m = table(spark, "profile_id int, camera_height_m double, pitch_deg double, roll_deg double, yaw_deg double, lateral_offset_m double, fx double, fy double, cx double, cy double, valid boolean",
              [(1, 1.12, 18.0, 0.0, 0.0, -0.32, 1423.0, 1423.0, 960.0, 540.0, True)])
    pix = camera.with_rotation(m)
    vs = pix.select(*[camera.project(F.lit(0.0), F.lit(float(d)), camera.mount_columns())[1].alias(f"known_distance_{d}m_px") for d in (5, 10, 20)])
    wrong = m.withColumn("pitch_deg", F.lit(15.0)).withColumn("camera_height_m", F.lit(1.22)).crossJoin(vs)
    r = fit.fit_mounts(wrong).first()
    assert abs(r.pitch_deg - 18.0) < 0.6 and abs(r.camera_height_m - 1.12) < 0.11 and r.fitted
    assert fit.roundtrip_error(m).first().max_error_px < 1e-6


def test_linear_fit_and_predict(spark):
    random.seed(6)
    d = table(spark, "features array<double>, label int", [([random.gauss(c * 3, 1), random.gauss(-c * 2, 1)], c) for c in (0, 1, 2) for _ in range(60)])
    w = fit.fit_one_vs_rest(d, dim=2, n_classes=3)
    import numpy as np
    rows_ = d.collect()
    x = np.array([[*r.features, 1.0] for r in rows_])
    ref = np.array([np.linalg.lstsq(x, np.array([float(r.label == k) for r in rows_]), rcond=None)[0] for k in range(3)])
    assert np.allclose(w, ref)
    pred = [r.predicted for r in fit.predict_labels(d, w).collect()]
    assert pred == [int(np.argmax(ref @ v)) for v in x]


def test_round_exact(spark):
    xs = [0.35, 0.25, 0.2609375, 0.0078125, 1.005, 2.5, 0.45, 17.149999999999999, 0.910937499999]
    d = table(spark, "x double", [(x,) for x in xs])
    out = d.select(F.format_string("%.1f", round_exact(F.col("x"), 1)), F.format_string("%.6f", round_exact(F.col("x"), 6))).collect()
    assert [tuple(r) for r in out] == [(f"{x:.1f}", f"{x:.6f}") for x in xs]


def test_contract_rules(spark):
    d = table(spark, "track_id long, lifecycle_state string, distance_m string", [(1, "CONFIRMED", "3.5"), (2, "GONE", "far"), (None, "TRACKED", None)])
    got = {r.rule: r.n_rows for r in hygiene.validate_tracks(d).collect()}
    assert got["missing_track_id"] == 1 and got["domain_lifecycle_state"] == 1 and got["numeric_distance_m"] == 1 and got["missing_risk_score"] == 3


def test_vocabulary_sizes():
    assert len(V.SEMANTIC_TYPES) == 9 and len(V.GEOMETRY_TYPES) == 6 and len(V.PERCEPTION_STATUSES) == 9


def test_rides_without_a_manifest_count(spark):
    hour = 3_600_000_000_000
    manifests = spark.createDataFrame([("a", 0, hour)], "session_id string, start_elapsed_realtime_ns long, end_elapsed_realtime_ns long")
    frames = spark.createDataFrame([(s, 1 + i * hour) for s in "ab" for i in range(2)] + [("c", 0)], "session_id string, sensor_timestamp_ns long")
    alerts = spark.createDataFrame([("a", True), ("b", True), ("d", True), ("d", False)], "session_id string, fired boolean")
    hours = reports.session_hours(manifests, frames)
    assert {r.session_id: r.hours for r in hours.collect()} == {"a": 1.0, "b": 1.0, "c": 0.0}
    row = reports.alert_rate_report(hours, alerts).first()
    assert (row.n_sessions, row.hours, row.n_alerts_fired, row.alerts_per_hour) == (4, 2.0, 3, 1.5)


def test_null_confidence_is_decided_last(spark):
    from ridelens.operators import spatial

    rows = [(1, 0.0, 0.0, 9.0, 9.0, None, 1, 1.0), (1, 0.0, 0.0, 9.0, 9.0, 0.2, 2, 1.0), (1, 50.0, 50.0, 60.0, 60.0, None, 3, 1.0)]
    df = spark.createDataFrame(rows, "image long, x0 double, y0 double, x1 double, y1 double, conf double, seq long, price double")
    assert sorted(r.seq for r in spatial.nms(df).collect()) == [2, 3]


def test_redaction_sees_whole_text(spark):
    text = "x" * 390 + " /data/user/jane/ride_7.mp4 end"
    out = rows.redact_text(spark.createDataFrame([(text,)], "detail string"), "detail").first().detail
    assert "jane" not in out and out.endswith("end")
