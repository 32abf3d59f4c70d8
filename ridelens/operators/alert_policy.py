"""Stateful part of the alert policy: once per track, global and per-class cooldown.

All stateless gates and scores are column expressions (`rows.gate_alerts`, `rows.score_alerts`); only
rows that pass them reach the per-session state machine, and only with the five columns it reads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.config import AlertConfig
from ridelens.functions import scoring
from ridelens.operators.rows import gate_alerts, rows_where, score_alerts
from ridelens.plans.fold import ordered_fold


def new_policy_state() -> dict:
    return {"any": 0, "cls": {}, "sev": {}}


def decide(state: dict, now: int, track: int, cls: str, severity: int, cfg: AlertConfig) -> str:
    """Outcome for one surviving row; a last fire time of 0 starts no cooldown."""
    before = state["sev"].get(track)
    if before is not None and not (severity - before >= cfg.realert_severity_jump and severity >= 2):
        return "already_alerted"
    if state["any"] and now - state["any"] < int(cfg.global_cooldown_s * 1e9):
        return "global_cooldown"
    last = state["cls"].get(cls, 0)
    if last and now - last < int(cfg.class_cooldown_s * 1e9):
        return "class_cooldown"
    state["any"] = now
    state["cls"][cls] = now
    state["sev"][track] = max(severity, 0)
    return "fired"


def alert_policy(tracks: DataFrame, *, key: str = "session_id", ts: str = "timestamp_ns", tie: Sequence[str] = ("seq", "price"),
                 cfg: AlertConfig = AlertConfig()) -> DataFrame:
    """Decision per track row: reason, fired flag, score, threshold and, when fired, the phrase."""
    order = [ts, *tie]
    base = gate_alerts(score_alerts(tracks, cfg), cfg)
    keys = [key, *order, "track_id"]
    shown = [*keys, "semantic_type", "direction", "alert_score", "threshold"]
    survivors = rows_where(base, F.col("gate_reason").isNull(), *shown, "severity", scoring.phrase().alias("phrase"))
    types = dict(survivors.dtypes)

    def step(state: dict, c: dict, span: range, out: list) -> None:
        for i in span:
            out.append((*(c[n][i] for n in shown), decide(
                state, c[ts][i], c["track_id"][i], c["semantic_type"][i], c["severity"][i], cfg), c["phrase"][i]))

    schema = ", ".join(f"{c} {types[c]}" for c in shown) + ", reason string, phrase string"
    decided = ordered_fold(survivors, [key], order, new_policy_state, step, schema)
    rejected = rows_where(base, F.col("gate_reason").isNotNull(), *shown, F.col("gate_reason").alias("reason"), F.lit("").alias("phrase"))
    every = rejected.unionByName(decided)
    fired = F.col("reason") == "fired"
    scored = F.col("reason").isin("fired", "below_threshold", "already_alerted", "global_cooldown", "class_cooldown")
    limit = F.when(fired, F.col("threshold")).otherwise(F.lit(cfg.score_threshold))
    return every.select(*keys, "semantic_type", "direction", "reason", fired.alias("fired"),
                        F.when(scored, F.col("alert_score")).otherwise(0.0).alias("alert_score"), limit.alias("threshold"),
                        F.when(fired, F.col("phrase")).otherwise("").alias("phrase"))
