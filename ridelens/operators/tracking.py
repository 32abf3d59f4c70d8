"""Linking detections into tracks: motion prediction, greedy matching, lifecycle.

One session is one state machine; sessions run in parallel. A candidate that timed out is no longer
reported but can still be matched, as in the contract, though only for `expired_memory_s` seconds: then it is
forgotten, so that a long ride holds no more tracks than a short one. A session's rows stream through its task
in time order (`plans.fold`), so only the live tracks are held in memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame

from ridelens.config import TrackingConfig
from ridelens.operators.tracks import advance
from ridelens.plans.fold import ordered_fold

OUTPUT = ("track_id long, timestamp_ns long, frame_id long, lifecycle_state string, hits int, misses int, age_s double, fade double, "
          "semantic_type string, geometry_type string, object_state string, severity int, model_confidence double, "
          "quality_at_mask double, mean_x double, mean_y double, x0 double, y0 double, x1 double, y1 double, obs_index int, transition string")
OBS = ["obs_index", "semantic_type", "geometry_type", "state", "severity", "model_confidence", "quality_at_mask",
       "contact_x", "contact_y", "x0", "y0", "x1", "y1"]
FRAME = ["timestamp_ns", "frame_id", "quality_ok", "allow_new", "yaw_rate", "frame_width"]

# process noise of a place, a speed and a size, in shares of the configured one
_NOISE = (1.0, 4.0, 0.5)
_KEPT = ("obs_index", "frame_id", "semantic_type", "geometry_type", "state", "severity", "model_confidence", "quality_at_mask")
_CARRIED = (("semantic_type", "unknown_anomaly"), ("geometry_type", "unknown"), ("state", "unknown"), ("severity", -1))


def new_tracker() -> dict:
    """Live tracks of one session: motion state and boxes as arrays (column i = i-th live track), the rest as dicts.

    The filter moves x, y, width and height independently and alike, so the covariance of a track is four numbers:
    place, place with speed, speed (the same for x and y) and size (the same for width and height). `dead`, `gone` and
    `last` repeat what the dicts say of expiry, so that timed-out candidates cost no Python step.
    """
    return {"next": 1, "last": None, "ids": np.zeros(0, dtype=np.int64), "mean": np.zeros((6, 0)), "cov": np.zeros((4, 0)),
            "box": np.zeros((4, 0)), "dead": np.zeros(0, dtype=bool), "gone": np.zeros(0, dtype=bool), "seen": np.zeros(0, dtype=np.int64), "info": []}


def _predict(s: dict, dt: float, shift: float, cfg: TrackingConfig) -> None:
    mean, (place, cross, speed, size) = s["mean"], s["cov"]
    mean[:2] += dt * mean[2:4]
    mean[0] += shift
    noise = cfg.process_noise * max(dt, 1e-3)
    moved = cross + dt * speed
    place += dt * cross + dt * moved + noise * _NOISE[0]
    cross[:] = moved
    speed += noise * _NOISE[1]
    size += noise * _NOISE[2]


def _correct(mean: list[float], cov: list[float], z: tuple[float, ...], cfg: TrackingConfig) -> tuple[list[float], list[float]]:
    x, y, vx, vy, w, h = mean
    place, cross, speed, size = cov
    inv, size_inv = 1.0 / (place + cfg.meas_noise), 1.0 / (size + cfg.meas_noise)
    kx, kv, ks = place * inv, cross * inv, size * size_inv
    dx, dy = z[0] - x, z[1] - y
    return ([x + kx * dx, y + kx * dy, vx + kv * dx, vy + kv * dy, w + ks * (z[2] - w), h + ks * (z[3] - h)],
            [(1.0 - kx) * place, (1.0 - kx) * cross, speed - kv * cross, (1.0 - ks) * size])


def _overlap(a: list[float], b: tuple[float, ...]) -> float:
    """Share of the union of two boxes that both cover."""
    if not (a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]):
        return 0.0
    inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = max(0.0, a[2] - a[0]) * max(0.0, a[3] - a[1]) + max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1]) - inter
    return inter / union if inter > 0 and union > 0 else 0.0


def _pairs(s: dict, obs: list[dict], cfg: TrackingConfig) -> list[tuple[float, int, int, int]]:
    """Admissible (score, track id, observation, row) of one frame, best first; ties go to the larger id, then the later box."""
    n = len(s["ids"])
    if not n or not obs:
        return []
    tb, ob = s["box"][:, None], np.array([o["box"] for o in obs]).T[:, :, None]
    off = s["mean"][:2, None] - np.array([o["z"][:2] for o in obs]).T[:, :, None]
    # most pairs are far apart and touch nothing; the others are scored
    near, touch = np.abs(off) <= cfg.center_match_px, (tb[:2] < ob[2:]) & (ob[:2] < tb[2:])
    met = (near[0] & near[1]) | (touch[0] & touch[1])
    at = np.arange(met.size) if cfg.iou_match <= 0 else np.flatnonzero(met)
    if not len(at):
        return []
    row, out = at % n, []
    dist, boxes, ids = np.hypot(*off.reshape(2, -1)[:, at]).tolist(), s["box"][:, row].T.tolist(), s["ids"][row].tolist()
    for a, b, far, box, i in zip(row.tolist(), (at // n).tolist(), dist, boxes, ids):
        o = obs[b]
        overlap = _overlap(box, o["box"])
        if overlap >= cfg.iou_match or far < cfg.center_match_px:
            sem = o["semantic_type"]
            same = sem == "unknown_anomaly" or sem == s["info"][a]["semantic_type"]
            out.append((overlap * (1.2 if same else 0.7) - far / 400.0, i, b, a))
    out.sort(reverse=True)
    return out


def update_tracker(s: dict, frame: dict, obs: list[dict], cfg: TrackingConfig) -> Iterable[dict]:
    """Advance the tracker by one frame; yields a row per track that is not expired or changed in this frame."""
    now = int(frame["timestamp_ns"])
    dt = 1.0 / 60.0 if s["last"] is None else max(1e-3, (now - s["last"]) / 1e9)
    s["last"] = now
    good = bool(frame["quality_ok"])
    if len(s["ids"]):
        _predict(s, dt, float(frame["yaw_rate"]) * dt * float(frame["frame_width"]) * 0.55, cfg)
    taken: dict[int, int] = {}
    used: set[int] = set()
    for _, _, j, row in _pairs(s, obs, cfg):
        if row not in taken and j not in used:
            taken[row] = j
            used.add(j)
    notes: dict[int, str | None] = {}
    for row, j in taken.items():
        t, o = s["info"][row], obs[j]
        s["mean"][:, row], s["cov"][:, row] = _correct(s["mean"][:, row].tolist(), s["cov"][:, row].tolist(), o["z"], cfg)
        s["box"][:, row] = o["box"]
        t.update(misses=0, quality_at_mask=o["quality_at_mask"], frame_id=o["frame_id"], obs_index=o["obs_index"], fade=1.0,
                 model_confidence=0.7 * t["model_confidence"] + 0.3 * o["model_confidence"])
        t.update({c: o[c] for c, unknown in _CARRIED if o[c] != unknown})
        notes[row] = advance(t["life"], now, t["semantic_type"], t["geometry_type"], True, good, cfg)
    # timed-out candidates wait unchanged until they are matched or forgotten
    live = np.flatnonzero(~s["dead"]).tolist()
    for row in live:
        if row in taken:
            continue
        t = s["info"][row]
        t["misses"] += 1
        t["obs_index"] = None
        if not good:
            t["fade"] = max(0.25, t["fade"] * 0.82)
        notes[row] = advance(t["life"], now, t["semantic_type"], t["geometry_type"], False, good, cfg)
        if notes[row] == "lost":
            t["fade"] = 0.0
    fresh = [(j, o) for j, o in enumerate(obs) if j not in used] if frame["allow_new"] else []
    for k, (_, o) in enumerate(fresh):
        life: dict = {}
        notes[len(s["info"])] = advance(life, now, o["semantic_type"], o["geometry_type"], True, good, cfg)
        s["info"].append({**{c: o[c] for c in ("semantic_type", "geometry_type", "state", "severity", "model_confidence", "quality_at_mask",
                                               "frame_id", "obs_index")}, "misses": 0, "fade": 1.0, "life": life})
    if fresh:
        n = len(fresh)
        new = {"ids": s["next"] + np.arange(n), "mean": np.array([(x, y, 0.0, 0.0, w, h) for x, y, w, h in (o["z"] for _, o in fresh)]).T,
               "cov": np.array([(40.0, 0.0, 40.0, 40.0)] * n).T, "box": np.array([o["box"] for _, o in fresh]).T,
               **{c: np.zeros(n, dtype=s[c].dtype) for c in ("dead", "gone", "seen")}}
        s["next"] += n
        for c, values in new.items():
            s[c] = np.concatenate([s[c], values], axis=-1)
    rows = sorted({*live, *taken, *range(len(s["info"]) - len(fresh), len(s["info"]))})
    for row, track, m, box in zip(rows, s["ids"][rows].tolist(), s["mean"][:2, rows].T.tolist(), s["box"][:, rows].T.tolist()):
        t = s["info"][row]
        state = t["life"]["state"]
        if state == "EXPIRED":
            s["dead"][row], s["gone"][row], s["seen"][row] = True, t["fade"] < 0.05, t["life"]["last"]
            if notes.get(row) is None and row not in taken:
                continue
        yield {"track_id": track, "timestamp_ns": now, "frame_id": t["frame_id"], "lifecycle_state": state, "hits": t["life"]["hits"],
               "misses": t["misses"], "age_s": (now - t["life"]["created"]) / 1e9, "fade": t["fade"], "semantic_type": t["semantic_type"],
               "geometry_type": t["geometry_type"], "object_state": t["state"], "severity": t["severity"], "model_confidence": t["model_confidence"],
               "quality_at_mask": t["quality_at_mask"], "mean_x": m[0], "mean_y": m[1], "x0": box[0], "y0": box[1],
               "x1": box[2], "y1": box[3], "obs_index": t["obs_index"], "transition": notes.get(row)}
    keep = ~s["dead"] | (~s["gone"] & ((now - s["seen"]) / 1e9 <= cfg.expired_memory_s))
    if not keep.all():
        for c in ("ids", "mean", "cov", "box", "dead", "gone", "seen"):
            s[c] = s[c][..., keep]
        for row in np.flatnonzero(~keep)[::-1].tolist():
            del s["info"][row]


def read_observation(c: dict, i: int) -> dict:
    """The detection of row i."""
    o = {n: c[n][i] for n in _KEPT}
    x0, y0, x1, y1 = o["box"] = (c["x0"][i], c["y0"][i], c["x1"][i], c["y1"][i])
    o["z"] = (c["contact_x"][i], c["contact_y"][i], max(4.0, x1 - x0), max(4.0, y1 - y0))
    return o


def step_rows(state: dict, c: dict, span: range, emit, cfg: TrackingConfig) -> None:
    """Walk rows; a frame is processed when the next one begins (see `flush`)."""
    ids, found = c["frame_id"], c["obs_index"]
    for i in span:
        if state["frame"] is None or ids[i] != state["frame"]["frame_id"]:
            flush(state, emit, cfg)
            state["frame"] = {n: c[n][i] for n in FRAME}
        if found[i] is not None:
            state["obs"].append(read_observation(c, i))


def flush(state: dict, emit, cfg: TrackingConfig) -> None:
    if state["frame"] is not None:
        for row in update_tracker(state["tracker"], state["frame"], state["obs"], cfg):
            emit(row)
    state["frame"], state["obs"] = None, []


def new_session() -> dict:
    return {"tracker": new_tracker(), "frame": None, "obs": [], "key": None}


def track_sessions(observations: DataFrame, *, key: str = "session_id", cfg: TrackingConfig = TrackingConfig()) -> DataFrame:
    """Tracks of every session from its frames and detections.

    Input: one row per (frame, detection), and one row with null detection columns for a frame without
    any; columns `FRAME` and `OBS`. Output: one row per frame and live track.
    """
    key_t = dict(observations.dtypes)[key]
    names = [c.split()[0] for c in OUTPUT.split(", ")]

    values = itemgetter(*names)

    def emitter(state: dict, out: list):
        return lambda row: out.append((state["key"], *values(row)))

    def step(state: dict, c: dict, span: range, out: list) -> None:
        state["key"] = c[key][span[0]]
        step_rows(state, c, span, emitter(state, out), cfg)

    def finish(state: dict, out: list) -> None:
        flush(state, emitter(state, out), cfg)

    cols = list(dict.fromkeys([key, *FRAME, *OBS]))
    return ordered_fold(observations.select(*cols), [key], ["timestamp_ns", "frame_id", "obs_index"], new_session, step,
                        f"{key} {key_t}, {OUTPUT}", finish)


def deaths(tracks: DataFrame) -> DataFrame:
    """Last row of tracks that expired, with the reason."""
    return tracks.where("transition in ('lost', 'candidate_timeout')")
