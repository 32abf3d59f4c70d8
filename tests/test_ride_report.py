"""Optional parts of the ride report."""

from ridelens.operators import reports


def test_parts(spark):
    t = spark.createDataFrame([("a", "CONFIRMED", 0.5), ("a", None, None), ("a", "CONFIRMED", 0.0), ("b", "TRACKED", None)],
                              "session_id string, lifecycle_state string, visibility_confidence double")
    al = spark.createDataFrame([("a", True)], "session_id string, fired boolean")
    run = spark.createDataFrame([("a", 0.4)], "session_id string, blur double")
    gyro = spark.createDataFrame([("a", 1.0, None, -2.0)], "session_id string, x double, y double, z double")
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "session_id string")
    ok = spark.createDataFrame([("a", True, 0, 1), ("b", False, 2, 0)], "session_id string, ok boolean, n_errors long, n_warnings long")
    hits = spark.createDataFrame([("a", "convex", "bump", 3.0, "strong"), ("a", "flat", "road_joint", 1.0, "weak")],
                                 "session_id string, geometry_type string, semantic_type string, peak_ms2 double, impact_label string")
    got = {r.session_id: r for r in reports.ride_report(t, al, run, gyro, ids, verified=ok, impacts=reports.impact_report(hits)).collect()}
    assert sorted(got) == ["a", "b", "c"]
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.n_visibility_known, a.n_visibility_missing, a.verify_ok, a.n_verify_warnings) == (2, 1, True, 1)
    assert (a.impact_n_aligned, a.impact_n_strong, a.impact_delta_ms2, a["impact_pass"], a.impact_used_for_alert) == (2, 1, 2.0, True, False)
    assert (b.verify_ok, b.n_verify_errors, b.n_visibility_missing, b.impact_n_aligned, b.impact_delta_ms2) == (False, 2, 1, 0, None)
    assert (c.verify_ok, c.n_visibility_known, c.n_track_rows, c.impact_n_aligned) == (None, 0, 0, 0)
    plain = reports.ride_report(t.drop("visibility_confidence"), al, run, gyro, ids)
    assert not any(n.startswith(("impact_", "verify_", "n_visibility")) for n in plain.columns) and plain.count() == 3
