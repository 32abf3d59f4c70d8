"""Top-k queues, first-wins deduplication and the error-case library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in a total order, as a map-side combined minimum."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def active_learning_queue(tracks: DataFrame, alerts: DataFrame, *, key: str = "session_id", max_n: int = 200,
                          order: Sequence[str] = ("timestamp_ns", "seq", "price"), frame: str = "source_frame_id") -> DataFrame:
    """Most informative (track, frame) rows per session.

    A confidence of 0 or null counts as 0.5 and a fired track id of 0 as -1, as "missing" does in the contract.
    """
    order = list(order)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    slim = tracks.select(key, zero("track_id").alias("track_id"), zero(frame).alias("frame_id"), *order,
                         "effective_confidence", "semantic_type", "visibility_confidence")
    uniq = first_wins(slim, [key, "track_id", "frame_id"], order)
    tid = F.when(F.coalesce(F.col("track_id"), F.lit(0)) == 0, F.lit(-1)).otherwise(F.col("track_id"))
    fired = alerts.where("fired").select(key, tid.cast("long").alias("track_id")).distinct().withColumn("_fired", F.lit(True))
    df = uniq.join(fired, [key, "track_id"], "left")
    raw = F.col("effective_confidence")
    eff = F.when(raw.isNull() | (raw == 0), 0.5).otherwise(raw)
    rules = [
        ("uncertain_confidence", eff.between(0.28, 0.72), 0.15),
        ("unknown_anomaly", F.coalesce(F.col("semantic_type"), F.lit("")).isin("unknown_anomaly", "unknown"), 0.35),
        ("alert_event", F.coalesce("_fired", F.lit(False)), 0.25),
        ("low_visibility", F.coalesce(F.col("visibility_confidence") < 0.4, F.lit(False)), 0.2),
    ]
    score = F.lit(1.0) - F.abs(eff - 0.5) * 2.0
    for _, hit, gain in rules:
        score = score + F.when(hit, gain).otherwise(0.0)
    reasons = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit, _ in rules]))
    out = df.withColumn("reasons", reasons).where(F.size("reasons") > 0).withColumn("score", F.bround(score, 4))
    w = W.partitionBy(key).orderBy(F.col("score").desc(), *order, "track_id")
    return out.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= max(1, max_n)).select(
        key, "track_id", "frame_id", "timestamp_ns", "semantic_type", "score", "reasons", "pos")


def latest_events(events: DataFrame, n: int = 400, *, keys: Sequence[str] = ("session_id",), order: Sequence[str] = ("timestamp_ns", "event_id")) -> DataFrame:
    """Last `n` diagnostics of each session; the rank limit runs before the shuffle too."""
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def error_case_library(alerts: DataFrame, marks: DataFrame, *, key: str = "session_id", ts: str = "timestamp_ns") -> DataFrame:
    """Fired alerts (with their snapshot, else the whole row) and manual marks in one table."""
    whole = F.to_json(F.struct(*[c for c in alerts.columns if c != key]))
    snap = F.col("snapshot") if "snapshot" in alerts.columns else F.lit(None).cast("string")
    fired = alerts.where("fired").select(
        key, F.lit("alert").alias("kind"), ts, "track_id",
        *[F.col(c) for c in ("phrase", "semantic_type") if c in alerts.columns],
        F.when(snap.isNull() | snap.isin("", "{}", "null"), whole).otherwise(snap).alias("snapshot"))
    return fired.unionByName(marks.withColumn("kind", F.lit("mark")), allowMissingColumns=True)


def error_case_counts(items: DataFrame, clips: DataFrame | None = None, *, key: str = "session_id") -> DataFrame:
    n = items.groupBy(key).agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("kind") == "alert").alias("n_alerts"),
                               F.count_if(F.col("kind") == "mark").alias("n_marks"))
    if clips is None:
        return n.withColumn("n_clips", F.lit(0).cast("long"))
    c = clips.groupBy(key).agg(F.count(F.lit(1)).alias("n_clips"))
    return n.join(c, key, "left").withColumn("n_clips", F.coalesce("n_clips", F.lit(0)).cast("long"))
