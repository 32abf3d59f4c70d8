"""Event clips on a stream: a ring of frames per ride, closed by event-time timers."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FRAME, ALERT, TICK = 0, 1, 2
COLUMNS = ["alert_ts", "start_index", "end_index", "n_frames", "start_ns", "end_ns", "complete", "empty"]


class ClipProcessor(StatefulProcessor):
    """Rows wait until the watermark has passed them, so they are taken in event order however they arrive.

    A frame goes into the ring and closes every clip whose alert lies `post_ns` or more behind it; an alert opens
    a clip with the ring as its start. `end_ms` after a ride's newest row its timer closes what is open,
    marked incomplete, and drops the ride's state. Open clips hold numbers only: no frame is kept for them.
    """

    def __init__(self, key: str, alert: str, ring: int, post_ns: int, end_ms: int) -> None:
        self.key, self.alert, self.size, self.post_ns, self.end_ms = key, alert, ring, post_ns, end_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, kind int, idx long, alert string")
        self.ring = handle.getListState("ring", "t long, idx long")
        # frames seen when the clip opened and how many of them the ring gave it
        self.open = handle.getListState("open", "alert string, t long, first_t long, first long, given long, seen long")
        self.place = handle.getValueState("place", "seen long, idx long, t long, newest_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new, top = [], None
        for pdf in rows:
            if pdf.empty:
                continue
            for t, kind, idx, alert in zip(pdf["t"].tolist(), pdf["kind"].tolist(), pdf["idx"].tolist(), pdf["alert"].tolist()):
                top = t if top is None else max(top, t)
                if kind != TICK:
                    new.append((int(t), int(kind), int(idx), alert))
        if top is None:
            return
        if new:
            self.waiting.appendList(new)
        seen, idx, last, newest = self.place.get() if self.place.exists() else (0, -1, None, 0)
        ms = int(top) // 1_000_000 + 1
        newest = max(newest, ms)
        self.place.update((seen, idx, last, newest))
        self.handle.registerTimer(ms)
        self.handle.registerTimer(newest + self.end_ms)
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        yield from self._advance(key, mark)
        if not self.place.exists() or self.place.get()[3] + self.end_ms > mark:
            return
        seen, idx, last, _ = self.place.get()
        out = [self._clip(c, seen, idx, last, False) for c in self.open.get()] if self.open.exists() else []
        for state in (self.waiting, self.ring, self.open, self.place):
            state.clear()
        yield from self._rows(key, out)

    def _advance(self, key, mark: int) -> Iterator[pd.DataFrame]:
        if not self.waiting.exists():
            return
        rows = [tuple(r) for r in self.waiting.get()]
        ready = sorted((r for r in rows if r[0] // 1000 < mark * 1000), key=lambda r: r[:3])
        if not ready:
            return
        rest = [r for r in rows if r[0] // 1000 >= mark * 1000]
        seen, idx, last, newest = self.place.get()
        ring = deque([tuple(r) for r in self.ring.get()] if self.ring.exists() else [], maxlen=self.size)
        # open clips by alert time: those that a frame closes stand first, so a frame looks at no others
        clips = deque(sorted([tuple(c) for c in self.open.get()] if self.open.exists() else [], key=lambda c: c[1]))
        bare = any(c[3] is None for c in clips)
        out = []
        for t, kind, i, alert in ready:
            if kind == ALERT:
                first_t, first = ring[0] if ring else (None, None)
                clips.append((alert, t, first_t, first, len(ring), seen))
                bare = bare or first is None
                continue
            ring.append((t, i))
            seen, idx, last = seen + 1, i, t
            if bare:
                clips, bare = deque(c if c[3] is not None else (*c[:2], t, i, *c[4:]) for c in clips), False
            while clips and t - clips[0][1] >= self.post_ns:
                out.append(self._clip(clips.popleft(), seen, idx, last, True))
        for state, now in ((self.waiting, rest), (self.ring, list(ring)), (self.open, list(clips))):
            if now:
                state.put(now)
            else:
                state.clear()
        self.place.update((seen, idx, last, newest))
        yield from self._rows(key, out)

    def _clip(self, c: tuple, seen: int, idx: int, last: int | None, complete: bool) -> tuple:
        alert, t, first_t, first, given, before = c
        n = given + seen - before
        return (alert, t, 0 if first is None else first, idx if n else -1, n, first_t, last if n else None, complete, n == 0)

    def _rows(self, key, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            pdf = pd.DataFrame([(key[0], *r) for r in out], columns=[self.key, self.alert, *COLUMNS])
            yield pdf.astype({"start_ns": "Int64", "end_ns": "Int64"})

    def close(self) -> None:
        pass


def clip_rows(frames: DataFrame, alerts: DataFrame, *, key: str = "session_id", frame: str = "frame_index", frame_ts: str = "sensor_timestamp_ns",
              alert_id: str = "alert_id", alert_ts: str = "timestamp_ns") -> DataFrame:
    """Frames and alerts as one table: key, t (ns), kind, idx of a frame, alert (text). Rows without a time are no events.

    No column is null: workers get nullable integers as floating point."""
    text = F.coalesce(F.col(alert_id).cast("string"), F.lit(""))
    f = frames.select(key, F.col(frame_ts).cast("long").alias("t"), F.lit(FRAME).alias("kind"), F.col(frame).cast("long").alias("idx"), F.lit("").alias("alert"))
    a = alerts.select(key, F.col(alert_ts).cast("long").alias("t"), F.lit(ALERT).alias("kind"), F.lit(-1).cast("long").alias("idx"), text.alias("alert"))
    return f.unionByName(a).where("t is not null")


def clip_stream(rows: DataFrame, *, key: str = "session_id", alert_id: str = "alert_id", pre_s: float = 2.0, post_s: float = 2.0, fps: float = 30.0,
                delay: str = "1 second", end_s: float = 60.0) -> DataFrame:
    """One row per alert of `clip_rows`: the clip of the batch operator `event_clips`, as soon as the watermark allows.

    A clip starts with the last max(8, int(pre·fps)+4) frames up to its alert and ends with the first frame at least
    `post_s` after it. Frames that come late but within `delay` take their place; later ones are lost to the
    clips (`tag_late` keeps them aside). A ride that is silent for `end_s` of event time is over: its open clips
    come out incomplete, `n_frames` counts the frames that did arrive. A row of kind TICK of any ride only moves time on.
    Alert ids come as text. Times are zero or more.
    """
    key_type = dict(rows.dtypes)[key]
    # one microsecond on, as a watermark starts at zero and Spark drops what is not after it
    timed = rows.withColumn(key, F.col(key).cast("string")).withColumn("at", F.timestamp_micros((F.floor(F.col("t") / 1000) + 1).cast("long"))).withWatermark("at", delay)
    schema = (f"{key} string, {alert_id} string, alert_ts long, start_index long, end_index long, n_frames long, "
              "start_ns long, end_ns long, complete boolean, empty boolean")
    made = ClipProcessor(key, alert_id, max(8, int(pre_s * fps) + 4), int(post_s * 1e9), int(end_s * 1000))
    out = timed.groupBy(key).transformWithStateInPandas(statefulProcessor=made, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.withColumn(key, F.col(key).cast(key_type))
