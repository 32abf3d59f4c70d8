"""The ride report with its optional parts; the oracle joins the statements of the parts' own queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridelens.catalog import q_hygiene, q_reports  # noqa: F401  (their oracles are used below)
from ridelens.catalog.registry import ORACLES, QUERIES, Views, query
from ridelens.operators import reports

_IMPACT = ["n_aligned", "n_none", "n_weak", "n_medium", "n_strong", "n_relief", "n_patch", "mean_relief_peak_ms2", "mean_patch_peak_ms2", "delta_ms2", "pass"]
_GIVEN = [f"coalesce(i.{c}, 0) as impact_{c}" if c.startswith("n_") else f"i.{c} as impact_{c}" for c in _IMPACT]


@query("ride_report_parts", ["a_tracks"], f"""
with t as (select session_id, count(*) filter (where k) as n_known, count(*) filter (where not k) as n_missing
  from (select session_id, effective_confidence > 0.2 as k from a_tracks) group by 1)
select r.session_id, r.n_track_rows, coalesce(n_known, 0) as n_visibility_known, coalesce(n_missing, 0) as n_visibility_missing,
  v.ok as verify_ok, v.n_errors as n_verify_errors, v.n_warnings as n_verify_warnings, {', '.join(_GIVEN)}
from ({ORACLES["ride_report"]}) r left join t using (session_id) left join ({ORACLES["verify_sessions"]}) v using (session_id)
left join ({ORACLES["impact_report"]}) i using (session_id)
""")
def _(v: Views):
    tracks = v.a_tracks.withColumn("visibility_confidence", F.when(F.col("effective_confidence") > 0.2, F.col("visibility_confidence")))
    sessions = v.a_tracks.select("session_id").union(v.a_frames.select("session_id"))
    verified, impacts = (QUERIES[name](v.spark, v.sf_dir) for name in ("verify_sessions", "impact_report"))
    df = reports.ride_report(tracks, v.a_alerts, q_reports._runtime(v), q_reports._gyro(v), sessions, verified=verified, impacts=impacts)
    return df.select("session_id", "n_track_rows", "n_visibility_known", "n_visibility_missing", "verify_ok", "n_verify_errors", "n_verify_warnings",
                     *[f"impact_{c}" for c in _IMPACT])
