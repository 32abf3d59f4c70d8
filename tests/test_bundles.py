"""Bundles on disk: write, read back, verify, share."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ridelens.operators import curation, hygiene, rows
from ridelens.sources import bundles, sinks


@pytest.fixture
def root(tmp_path):
    for sid in ("a", "b"):
        d = tmp_path / "fleet" / f"session_{sid}"
        for sub in ("camera", "imu", "video", "calibration", "events", "diagnostics"):
            (d / sub).mkdir(parents=True)
        (d / "camera/frame_metadata.jsonl").write_text("\n".join(
            json.dumps({"frame_id": i, "sensor_timestamp_ns": i * 10, "availability": {"iso": True}}) for i in range(3)) + "\n\n{broken\n")
        (d / "imu/gyro.jsonl").write_text(json.dumps({"timestamp_ns": 5, "sensor_type": "GYRO", "x": 1.0, "y": 2.0, "z": 3.0}) + "\n")
        (d / "events/alerts.jsonl").write_text(json.dumps({"timestamp_ns": 5, "track_id": 1, "fired": True, "snapshot": {"lat": 3.5, "note": "/x/y.mp4"}}) + "\n")
        (d / "video/segment_000.mp4").write_bytes(b"v0")
        (d / "video/segment_001.part.mp4").write_bytes(b"v1")
        man = {"session_id": sid, "device": {"model": "m"}, "start_elapsed_realtime_ns": 0, "notes": "n", "config_snapshot": {"k": 1}}
        if sid == "b":
            man["schema_version"] = "0.9"
        (d / "manifest.json").write_text(json.dumps(man, indent=1))
        (d / "calibration/mount_profile.json").write_text(json.dumps({"profile_id": "p", "camera_height_m": 1.1, "valid": True}))
        (d / "skip.tmp").write_text("x")
        lines = [f"{hashlib.sha256(f.read_bytes()).hexdigest()}  {f.relative_to(d).as_posix()}" for f in sorted(d.rglob("*")) if f.is_file() and not f.name.endswith(".tmp")]
        if sid == "b":
            lines[0] = "0" * 64 + lines[0][64:]
            lines.append("1" * 64 + "  gone/away  file.bin")
        (d / "checksums.sha256").write_text("\n".join(lines) + "\n")
    return str(tmp_path / "fleet")


def test_read_logs(spark, root):
    f = bundles.read_log(spark, root, "frames")
    ok = f.where("_corrupt_record is null").orderBy("session_id", "line_offset").collect()
    assert [(r.session_id, r.frame_id) for r in ok] == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("b", 2)]
    assert ok[0].availability == {"iso": True} and len(f.where("_corrupt_record is not null").collect()) == 2
    assert bundles.read_log(spark, root, "tracks").count() == 0 and "track_id" in bundles.read_log(spark, root, "tracks").columns
    assert json.loads(bundles.read_log(spark, root, "alerts").first().snapshot) == {"lat": 3.5, "note": "/x/y.mp4"}


def test_manifests_and_mounts(spark, root):
    m = {r.session_id: r for r in bundles.read_manifests(spark, root).collect()}
    assert m["a"].schema_warning is None and m["b"].schema_warning == "schema 0.9 read with compat 1.0" and m["a"].device.model == "m"
    assert [r.camera_height_m for r in bundles.read_mounts(spark, root).collect()] == [1.1, 1.1]


def test_verify(spark, root):
    inv, chk = bundles.read_file_inventory(spark, root), bundles.read_checksums(spark, root)
    assert inv.where("path like '%.tmp' or path = 'checksums.sha256'").count() == 0
    assert chk.where("path = 'gone/away  file.bin'").count() == 1
    crash = spark.createDataFrame([("a", 2), ("b", 0)], "session_id string, n_hits int")
    man = bundles.read_manifests(spark, root)
    out = {r.session_id: r for r in sinks.verify_sessions(man, inv, chk, crash=crash).collect()}
    assert out["a"].ok and not out["b"].ok and out["a"].n_verified == out["a"].n_listed
    texts = {(r.session_id, r.level, r.message) for r in sinks.session_findings(man, inv, chk, crash=crash).collect()}
    part = {(s, "warning", m) for s in "ab" for m in ("unfinalized segment segment_001.part.mp4", "copied to segment_001.mp4.recovered (marked recovered)")}
    assert texts == part | {("a", "warning", "crash residual hits=2"), ("b", "error", "checksum mismatch calibration/mount_profile.json"),
                            ("b", "error", "missing gone/away  file.bin"), ("b", "warning", "schema 0.9 read with compat 1.0")}


def test_no_manifest(spark):
    none = spark.createDataFrame([], "session_id string, schema_warning string")
    inv = spark.createDataFrame([("x", "f", "d")], "session_id string, path string, sha256 string")
    chk = spark.createDataFrame([("x", "f", "e")], "session_id string, path string, digest string")
    assert [(r.level, r.message) for r in sinks.session_findings(none, inv, chk).collect()] == [("error", "missing manifest.json")]
    assert not sinks.verify_sessions(none, inv, chk).first().ok


def test_segments(spark, root):
    inv = bundles.read_file_inventory(spark, root)
    assert {r.recovered_path for r in hygiene.find_unfinalized_segments(inv).collect()} == {"video/segment_001.mp4.recovered"}
    ids = spark.createDataFrame([("a",), ("z",)], "session_id string")
    assert {r.session_id: r.next_index for r in hygiene.next_segment_index(inv, ids).collect()} == {"a": 2, "z": 0}


def test_manifest_update_and_writers(spark, root, tmp_path):
    out = str(tmp_path / "out")
    frames, inv = bundles.read_log(spark, root, "frames"), bundles.read_file_inventory(spark, root)
    m = sinks.manifest_update(bundles.read_manifests(spark, root), frames, inv)
    assert {(r.end_elapsed_realtime_ns, r.video_segments) for r in m.collect()} == {(20, 1)}
    sinks.write_manifests(m, f"{out}/manifest")
    assert spark.read.json(f"{out}/manifest").count() == 2
    sinks.write_session_tables({"frames": frames, "imu": bundles.read_log(spark, root, "gyro")}, out)
    back = spark.read.parquet(f"{out}/imu")
    assert {r.imu_log for r in back.collect()} == {"gyro"} and spark.read.parquet(f"{out}/frames").count() == frames.count()
    sinks.write_checksum_manifest(inv, f"{out}/sums")
    lines = [r.value for r in spark.read.text(f"{out}/sums").where("session_id = 'a'").select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).orderBy("f", "i").collect()]
    assert [x.split("  ", 1)[1] for x in lines] == sorted(x.split("  ", 1)[1] for x in lines) and len(lines) == inv.where("session_id = 'a'").count()
    sinks.write_report_json(m.select("session_id", "video_segments"), f"{out}/report")
    assert json.loads(spark.read.text(f"{out}/report").where("session_id = 'a'").first().value) == {"session_id": "a", "video_segments": 1}


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_written_tables_are_read_back(spark, root, tmp_path, fmt):
    """Both formats, ids that look like numbers, a narrower type than the log's, no rows at all, a log nobody wrote."""
    out = str(tmp_path / fmt)
    frames = bundles.read_log(spark, root, "frames").where("_corrupt_record is null")
    alerts = bundles.read_log(spark, root, "alerts")
    imu = spark.createDataFrame([("007", 1, "GYRO", 1.0), ("007", 2, "ACCEL", 2.0), ("a b:c", 3, "what", 3.0), (None, 4, "ACCEL", 4.0)],
                                "session_id string, timestamp_ns int, sensor_type string, x double")
    sinks.write_session_tables({"frames": frames, "alerts": alerts, "imu": imu, "marks": bundles.read_log(spark, root, "marks")}, out, fmt=fmt)
    back = bundles.read_log(spark, out, "frames")
    assert back.columns == bundles.read_log(spark, root, "frames").columns
    logged = [c for c in frames.columns if c not in ("file_block", "line_offset")]
    plain = lambda df: sorted(map(str, df.select(*logged).collect()))
    assert plain(back) == plain(frames)
    assert json.loads(bundles.read_log(spark, out, "alerts").first().snapshot) == {"lat": 3.5, "note": "/x/y.mp4"}
    got = {k: sorted((str(r.session_id), r.timestamp_ns, r.x) for r in bundles.read_log(spark, out, k).collect()) for k in ("gyro", "accelerometer", "rotation_vector")}
    assert got == {"gyro": [("007", 1, 1.0), ("a b:c", 3, 3.0)], "accelerometer": [("007", 2, 2.0), ("None", 4, 4.0)], "rotation_vector": []}
    assert bundles.read_log(spark, out, "marks").count() == 0 and bundles.read_log(spark, out, "road").count() == 0


def test_written_tables_refuse_what_does_not_fit(spark, tmp_path):
    bad = spark.createDataFrame([("a", "soon")], "session_id string, timestamp_ns string")
    with pytest.raises(Exception, match="soon"):
        sinks.write_session_tables({"marks": bad}, str(tmp_path / "bad"))


def test_share_leaves_source(spark, root, tmp_path):
    loc = spark.createDataFrame([("a", 1, 31.23456, 121.5, 5.0)], "session_id string, timestamp_ns long, latitude double, longitude double, horizontal_accuracy_m double")
    rt = spark.createDataFrame([("a", 1, 0.4, 12.5)], "session_id string, timestamp_ns long, blur double, latency_p95_ms double")
    tables = {"location": loc, "runtime": rt, "alerts": bundles.read_log(spark, root, "alerts"), "manifest": bundles.read_manifests(spark, root)}
    out = str(tmp_path / "share")
    sinks.share_export(tables, out)
    shared = spark.read.json(f"{out}/location").first()
    assert (shared.latitude, shared.horizontal_accuracy_m, shared.privacy) == (31.23, 150.0, "coarsened")
    runtime = sinks.share_tables(tables)["runtime"].first()
    assert runtime.blur == 0.4 and runtime.latency_p95_ms is None  # the key contains "lat"
    assert bundles.read_log(spark, out, "location").first().latitude == 31.23
    man = spark.read.json(f"{out}/manifest").where("session_id = 'a'").first()
    assert man.privacy_mode == "SHARE_REDACTED" and man.notes.endswith("coordinates redacted") and "/x/y.mp4" not in json.dumps(sinks.share_tables(tables)["alerts"].first().asDict(), default=str)
    assert loc.first().latitude == 31.23456
    lines = dict(reversed(r.value.split("  ", 1)) for r in spark.read.text(f"{out}/checksums").collect())
    assert {p.split("/")[0] for p in lines} == {"location", "runtime", "alerts", "manifest"}
    assert all(hashlib.sha256((tmp_path / "share" / p).read_bytes()).hexdigest() == d for p, d in lines.items())


def test_volumes(spark):
    inv = spark.createDataFrame([("s", "a", 5), ("s", "b", 4000), ("s", "c", 10), ("t", "a", 9)], "session_id string, path string, length long")
    got = {(r.session_id, r.path): r.volume for r in sinks.plan_export_volumes(inv, 2500).collect()}
    assert got == {("s", "a"): 1, ("s", "b"): 2, ("s", "c"): 3, ("t", "a"): 1}
    assert sinks.volume_sizes(sinks.plan_export_volumes(inv, 2500)).count() == 4


def test_cvat_document(spark, tmp_path):
    t = spark.createDataFrame([("s", 2, 5, 0, 0.0, "a<b", 3, [[0.0, 0.0], [1.25, 0.35], [2.0, 2.0]]), ("s", 1, 6, 1, 0.0, "x", 4, [[0.0, 0.0]]), ("s", 2, 7, 2, 0.0, "zz", 5, [[1.0, 1.0], [2.0, 2.0], [3.0, 3.0]])],
                              "session_id string, track_id long, timestamp_ns long, seq long, price double, semantic_type string, source_frame_id long, polygon array<array<double>>")
    out = str(tmp_path / "cvat")
    sinks.write_cvat(curation.export_cvat(t), out)
    text = [r.value for r in spark.read.text(out).select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).orderBy("f", "i").collect()]
    assert text[0].startswith("<?xml") and text[-1] == "</annotations>"
    assert text[4:] == ['  <track id="2" label="a&lt;b">', '    <polygon frame="3" points="0.0,0.0;1.2,0.3;2.0,2.0" outside="0" occluded="0" />',
                        '    <polygon frame="5" points="1.0,1.0;2.0,2.0;3.0,3.0" outside="0" occluded="0" />', "  </track>", '  <track id="1" label="x">', "  </track>", "</annotations>"]


def test_fingerprint(spark, tmp_path):
    (tmp_path / "f").mkdir()
    small, big = b"abc", bytes(range(256)) * 20
    (tmp_path / "f/small.bin").write_bytes(small)
    (tmp_path / "f/big.bin").write_bytes(big)
    df = spark.read.format("binaryFile").load(str(tmp_path / "f"))
    got = {r.length: r.sha256 for r in curation.content_fingerprint(df).collect()}
    assert got[3] == hashlib.sha256(small).hexdigest()
    assert got[len(big)] == hashlib.sha256(big).hexdigest()


def test_redaction_of_nested_columns(spark):
    d = spark.createDataFrame([(1, ("/a/b.jpg", 3.0), ["/c/d.png"], {"x": "/e/f.bin", "longest": "v"})], "track_id int, s struct<note:string,altitude:double>, l array<string>, m map<string,string>")
    r = rows.redact_events(d).first()
    assert (r.track_id, r.s.note, r.s.altitude, r.l, r.m) == (1, "[path]", None, ["[path]"], {"x": "[path]", "longest": "[redacted]"})
    assert d.select(F.col("s.note")).first()[0] == "/a/b.jpg"
