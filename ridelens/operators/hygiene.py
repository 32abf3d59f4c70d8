"""Sensor timing checks: arrival order, gaps, intervals, alignment, one-to-one matching, contract rules."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridelens.functions import vocab as V
from ridelens.plans.ordered import asof, chunk_width, rank_quantiles, trailing, with_previous

NS_PER_MS = 1_000_000
NS_PER_S = 1_000_000_000


def sequence_anomalies(df: DataFrame, *, keys: Sequence[str] = ("session_id",), seq: str = "event_id",
                       ts: str = "timestamp_ns", chunk: float | None = None) -> DataFrame:
    """REORDER where a timestamp is smaller than its predecessor in arrival order, DUPLICATE where equal."""
    prev = with_previous(df.select(*keys, seq, ts), keys, [seq], [ts], chunk=chunk)
    code = F.when(F.col(ts) < F.col(f"prev_{ts}"), "REORDER").when(F.col(ts) == F.col(f"prev_{ts}"), "DUPLICATE")
    return prev.withColumn("code", code).where("code is not null").select(*keys, seq, ts, "code")


def detect_gaps(df: DataFrame, *, keys: Sequence[str] = ("session_id",), order: Sequence[str] = ("event_id",),
                ts: str = "timestamp_ns", expected_hz: float = 200.0, stall_factor: float = 4.0,
                chunk: float | None = None) -> DataFrame:
    """SENSOR_STALL where the step exceeds stall_factor periods, TIMESTAMP_JUMP where it is negative."""
    limit = NS_PER_S / max(expected_hz, 1e-3) * stall_factor
    extra = [c for c in order if c != ts]
    prev = with_previous(df.select(*keys, *extra, ts), keys, list(order), [ts], chunk=chunk)
    dt = F.col(ts) - F.col(f"prev_{ts}")
    code = F.when(dt > limit, "SENSOR_STALL").when(dt < 0, "TIMESTAMP_JUMP")
    return (prev.withColumn("dt_ns", dt).withColumn("code", code).where("code is not null")
            .select(*keys, ts, "dt_ns", (F.col("dt_ns") / NS_PER_MS).alias("gap_ms"), "code"))


def intervals(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str,
              chunk: float | None = None) -> DataFrame:
    extra = [c for c in order if c != ts]
    prev = with_previous(df.select(*keys, *extra, ts), keys, list(order), [ts], chunk=chunk)
    return prev.withColumn("dt_ns", F.col(ts) - F.col(f"prev_{ts}")).where("dt_ns is not null")


def interval_percentiles(df: DataFrame, *, keys: Sequence[str] = ("session_id",),
                         order: Sequence[str] = ("timestamp_ns",), ts: str = "timestamp_ns",
                         chunk: float | None = None) -> DataFrame:
    """p5/p50/p95 of the positive steps in ms and the median rate; zeros when a key has none."""
    steps = intervals(df, keys, order, ts, chunk).where("dt_ns > 0")
    q = rank_quantiles(steps, keys, "dt_ns", {
        "p5": ("linear", 0.05), "p50": ("linear", 0.5), "p95": ("linear", 0.95)})
    all_keys = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"))
    zero = F.lit(0.0)
    ms = {c: F.coalesce(F.col(c) / NS_PER_MS, zero).alias(f"{c}_ms") for c in ("p5", "p50", "p95")}
    return all_keys.join(q, list(keys), "left").select(
        *keys, "n_samples", *ms.values(), F.coalesce(F.lit(1e9) / F.col("p50"), zero).alias("hz"))


def imu_interval_report(imu: DataFrame, *, key: str = "session_id", ts: str = "timestamp_ns",
                        order: Sequence[str] = ("timestamp_ns",)) -> DataFrame:
    """Interval percentiles per session and IMU log."""
    log = V.lookup(V.IMU_LOGS, F.col("sensor_type"), "gyro")
    return interval_percentiles(imu.withColumn("imu_log", log), keys=[key, "imu_log"], order=order, ts=ts)


def alignment_error_p95(camera: DataFrame, imu: DataFrame, *, key: str = "session_id",
                        camera_ts: str = "sensor_timestamp_ns", imu_ts: str = "timestamp_ns",
                        chunk: float | None = None) -> DataFrame:
    """p95 of the distance from each camera time to the nearest sensor time (infinite when a side is empty)."""
    near = asof(camera.select(key, camera_ts), imu.select(key, imu_ts), [key], camera_ts, imu_ts, [], chunk=chunk)
    err = F.least(F.col(camera_ts) - F.col("prev.ts"), F.col("next.ts") - F.col(camera_ts))
    q = rank_quantiles(near.withColumn("err", err), [key], "err", {"p95": ("linear", 0.95)})
    frames = camera.groupBy(key).agg(F.count(F.lit(1)).alias("n_frames"))
    return frames.join(q, key, "left").select(
        key, "n_frames", F.coalesce(F.col("p95") / NS_PER_MS, F.lit(float("inf"))).alias("alignment_p95_ms"))


def sensor_rates(df: DataFrame, *, keys: Sequence[str] = ("session_id", "sensor_type"), ts: str = "timestamp_ns",
                 tie: str = "event_id", window_s: int = 60, max_gaps: int | None = None) -> DataFrame:
    """Rate per whole second, the mean rate of the last `window_s` seconds seen so far, and gap statistics.

    The window is carried as an array of at most `window_s` rates; the gap percentiles are the
    floor-index ones of all gaps of the key, or with `max_gaps` of the last so many.
    """
    keys = list(keys)
    per_s = df.groupBy(*keys, F.floor(F.col(ts) / NS_PER_S).alias("second")).agg(
        F.count(F.lit(1)).cast("double").alias("hz"))
    rates = trailing(per_s, keys, ["second"], window_s, {
        "hz_window": F.collect_list("hz"), "window_s": F.count("hz")})
    gaps = intervals(df, keys, [ts, tie], ts)
    if max_gaps is not None:  # the rank limit is applied before the shuffle
        w = W.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(tie).desc())
        gaps = gaps.withColumn("_pos", F.row_number().over(w)).where(F.col("_pos") <= max_gaps)
    q = rank_quantiles(gaps, keys, "dt_ns", {
        "gap_p5": ("floor", 0.05), "gap_p50": ("floor", 0.5), "gap_p95": ("floor", 0.95)}, count_name="n_gaps")
    return rates.join(q, keys, "left").select(
        *keys, "second", "hz", "window_s", "hz_window",
        *[(F.col(c) / NS_PER_MS).alias(f"{c}_ms") for c in ("gap_p5", "gap_p50", "gap_p95")], "n_gaps")


def measured_fps(df: DataFrame, *, keys: Sequence[str] = ("session_id",), ts: str = "sensor_timestamp_ns",
                 tie: str = "event_id") -> DataFrame:
    """1000 / upper-median gap in ms; null below five gaps or when the median is at most 0.2 ms."""
    q = rank_quantiles(intervals(df, keys, [ts, tie], ts), keys, "dt_ns", {"med": ("upper", 0.0)}, count_name="n_gaps")
    med = F.col("med") / NS_PER_MS
    return q.select(*keys, "n_gaps", F.when((F.col("n_gaps") >= 5) & (med > 0.2), 1000.0 / med).alias("fps"))


# --- track contract -------------------------------------------------------------------------

# Fields every published track row must carry.
REQUIRED_TRACK_FIELDS = [
    "schema_version", "track_id", "timestamp_ns", "lifecycle_state", "semantic_type", "geometry_type",
    "object_state", "direction", "effective_confidence", "risk_score",
]


def validate_tracks(tracks: DataFrame) -> DataFrame:
    """Broken contract rules with their row counts."""
    def rule(name: str, broken: Column) -> Column:
        return F.when(F.coalesce(broken, F.lit(False)), F.lit(name))

    have = set(tracks.columns)
    rules = [rule(f"missing_{c}", F.col(c).isNull() if c in have else F.lit(True)) for c in REQUIRED_TRACK_FIELDS]
    for c, domain in (("lifecycle_state", V.LIFECYCLE_STATES), ("object_state", V.OBJECT_STATES),
                      ("direction", V.DIRECTIONS)):
        if c in have:
            rules.append(rule(f"domain_{c}", F.col(c).isNotNull() & ~F.col(c).isin(domain)))
    for c in ("distance_m", "ttc_s"):
        if c in have:
            bad = F.col(c).isNotNull() & (F.try_to_number(F.col(c).cast("string"), F.lit("S999999999D999999999")).isNull()
                                          if dict(tracks.dtypes)[c] == "string" else F.isnan(F.col(c).cast("double")))
            rules.append(rule(f"numeric_{c}", bad))
    return (tracks.select(F.explode(F.array_compact(F.array(*rules))).alias("rule"))
            .groupBy("rule").agg(F.count(F.lit(1)).alias("n_rows")))


# --- one-to-one matching ---------------------------------------------------------------------

class _Free:
    """Sorted positions that are still free; finding the next one on either side is nearly constant time."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n + 1))    # next free position at or after i; n = none
        self.down = list(range(n + 1))  # 1 + last free position before i; 0 = none

    @staticmethod
    def _root(link: list[int], i: int) -> int:
        root = i
        while link[root] != root:
            root = link[root]
        while link[i] != root:
            link[i], i = root, link[i]
        return root

    def at_or_after(self, i: int) -> int:
        return self._root(self.up, i)

    def before(self, i: int) -> int:
        return self._root(self.down, i) - 1

    def take(self, i: int) -> None:
        self.up[i] = i + 1
        self.down[i + 1] = i


def _greedy_pairs(frames: np.ndarray, results: np.ndarray, max_dt: int) -> np.ndarray:
    """Index of the result taken by each frame (-1 for none); arrays are in frame / result order.

    Results are kept by (time, order); a frame looks at the nearest free ones on both sides, the
    earlier-listed one on ties.
    """
    place = np.argsort(results, kind="stable")
    times = results[place]
    spot = np.empty(len(place), dtype=np.int64)
    spot[place] = np.arange(len(place))
    n, free = len(times), _Free(len(times))
    taken = np.zeros(n, dtype=bool)
    last_at = {int(t): j for j, t in enumerate(results)}
    out = np.full(len(frames), -1, dtype=np.int64)
    first = np.searchsorted(times, frames, side="left") if n else np.zeros(len(frames), dtype=np.int64)
    for i, t in enumerate(frames):
        j = last_at.get(int(t))
        if j is not None and not taken[spot[j]]:
            pos = int(spot[j])
        else:
            options = []
            right = free.at_or_after(int(first[i]))
            if right < n:
                options.append((abs(int(times[right]) - int(t)), int(place[right]), right))
            left = free.before(int(first[i]))
            if left >= 0:  # first listed of the free ones with that time
                left = free.at_or_after(int(np.searchsorted(times, times[left], side="left")))
                options.append((abs(int(times[left]) - int(t)), int(place[left]), left))
            if not options or min(options)[0] > max_dt:
                continue
            pos = min(options)[2]
        taken[pos] = True
        free.take(pos)
        out[i] = place[pos]
    return out


def match_one_to_one(frames: DataFrame, results: DataFrame, *, key: str = "session_id", frame_seq: str = "frame_seq",
                     frame_ts: str = "frame_ts", result_seq: str = "result_seq", result_ts: str = "result_ts",
                     max_dt_ns: int = 2_000_000, chunk: float | None = None) -> DataFrame:
    """Each frame takes the result of its own timestamp, else the nearest unused one within `max_dt_ns`.

    Times further apart than `max_dt_ns` cannot compete, so sessions fall into clusters at such gaps.
    Clusters of one frame and one result, of frames only, or of results only are settled by
    expressions; only contested clusters reach Python, grouped by time chunk so that a session is
    never handled by one task.
    """
    f = frames.select(key, F.col(frame_ts).alias("t"), F.col(frame_seq).alias("seq"), F.lit(0).alias("side"))
    r = results.select(key, F.col(result_ts).alias("t"), F.col(result_seq).alias("seq"), F.lit(1).alias("side"))
    both = f.unionByName(r)
    width = chunk or chunk_width("t")
    prev = with_previous(both, [key], ["t", "side", "seq"], ["t"], chunk=width)
    head = prev.withColumn("_start", F.col("prev_t").isNull() | (F.col("t") - F.col("prev_t") > max_dt_ns))
    # cluster id = time of the cluster's first member, spread forward chunk by chunk
    starts = head.where("_start").select(key, F.col("t").alias("cluster")).distinct()
    tagged = asof(both, starts, [key], "t", "cluster", [], chunk=width).select(
        key, "t", "seq", "side", F.col("prev.ts").alias("cluster"))
    sizes = tagged.groupBy(key, "cluster").agg(
        F.count_if(F.col("side") == 0).alias("n_f"), F.count_if(F.col("side") == 1).alias("n_r"),
        F.max(F.when(F.col("side") == 0, F.col("seq"))).alias("f_seq"),
        F.max(F.when(F.col("side") == 1, F.col("seq"))).alias("r_seq"),
        F.max(F.when(F.col("side") == 0, F.col("t"))).alias("f_t"),
        F.max(F.when(F.col("side") == 1, F.col("t"))).alias("r_t"))
    simple = sizes.where("n_f <= 1 and n_r <= 1")
    close = F.abs(F.col("f_t") - F.col("r_t")) <= max_dt_ns
    settled = simple.select(key, F.explode(F.when((F.col("n_f") == 1) & (F.col("n_r") == 1) & close, F.array(
        F.struct(F.col("f_seq"), F.col("r_seq"), F.lit("MATCHED").alias("code")))).otherwise(F.array_compact(F.array(
            F.when(F.col("n_f") == 1, F.struct(F.col("f_seq"), F.lit(None).cast("long").alias("r_seq"),
                                               F.lit("UNMATCHED_FRAME").alias("code"))),
            F.when(F.col("n_r") == 1, F.struct(F.lit(None).cast("long").alias("f_seq"), F.col("r_seq"),
                                               F.lit("ORPHAN_RESULT").alias("code"))))))).alias("x")
    ).select(key, F.col("x.f_seq").alias("frame_seq"), F.col("x.r_seq").alias("result_seq"), F.col("x.code").alias("code"))

    contested = tagged.join(sizes.where("n_f > 1 or n_r > 1").select(key, "cluster"), [key, "cluster"]).withColumn(
        "_g", F.floor(F.col("cluster") / F.lit(float(width))))
    key_type = dict(tagged.dtypes)[key]

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for (k, _), part in pdf.groupby([key, "cluster"], sort=False):
            fr = part[part["side"] == 0].sort_values("seq")
            rs = part[part["side"] == 1].sort_values("seq")
            pick = _greedy_pairs(fr["t"].to_numpy(), rs["t"].to_numpy(), max_dt_ns)
            r_ids = rs["seq"].to_numpy()
            for s, j in zip(fr["seq"].to_numpy(), pick):
                rows.append((k, s, r_ids[j] if j >= 0 else None, "MATCHED" if j >= 0 else "UNMATCHED_FRAME"))
            used = set(pick.tolist())
            rows += [(k, None, s, "ORPHAN_RESULT") for j, s in enumerate(r_ids) if j not in used]
        return pd.DataFrame(rows, columns=[key, "frame_seq", "result_seq", "code"]).astype(
            {"frame_seq": "Int64", "result_seq": "Int64"})

    hard = contested.groupBy(key, "_g").applyInPandas(
        settle, f"{key} {key_type}, frame_seq long, result_seq long, code string")
    return settled.unionByName(hard)


# --- video segments ---------------------------------------------------------------------------

def find_unfinalized_segments(inventory: DataFrame, *, key: str = "session_id", path: str = "path") -> DataFrame:
    """`*.part.mp4` leftovers with the name their recovered copy gets."""
    part = inventory.where(F.col(path).rlike(r"\.part\.mp4$"))
    return part.select(key, path, F.regexp_replace(path, r"\.part\.mp4$", ".mp4.recovered").alias("recovered_path"))


def next_segment_index(inventory: DataFrame, sessions: DataFrame, *, key: str = "session_id", path: str = "path") -> DataFrame:
    """1 + largest `segment_<n>` number per session, 0 where there is none."""
    num = F.expr(f"try_cast(nullif(regexp_extract({path}, 'segment_(\\\\d+)', 1), '') as bigint)")
    top = inventory.groupBy(key).agg(F.max(num).alias("_m"))
    return sessions.select(key).distinct().join(top, key, "left").select(
        key, (F.coalesce(F.col("_m"), F.lit(-1)) + 1).cast("long").alias("next_index"))
