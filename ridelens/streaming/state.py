"""Keyed state machines on streams: one processor class per online gate.

Each processor keeps its state as one pickled blob per key (small, bounded dictionaries) in the state
store, so the batch and the stream run the same step functions. Late rows are not dropped silently:
order-sensitive processors report them as anomalies.

Rows of a micro-batch reach a key in no particular order, so they are sorted by event time first; with
the file source one micro-batch never holds a row older than what an earlier batch already delivered,
except real late data.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

RIDE_TTL_S = 24 * 3600

Step = Callable[[Any, list[dict], list[tuple]], Any]


class FoldProcessor(StatefulProcessor):
    """`step(state, rows, out) -> state` over the new rows of a key, in order."""

    def __init__(self, key_names: Sequence[str], order: Sequence[str], new_state: Callable[[], Any], step: Step, columns: Sequence[str], ttl_s: int | None) -> None:
        self.ttl_ms = ttl_s and ttl_s * 1000
        self.key_names, self.order, self.new_state, self.step, self.columns = list(key_names), list(order), new_state, step, list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blob = handle.getValueState("fold", "blob binary", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf = pdf.sort_values(self.order, kind="stable")
        state = pickle.loads(bytes(self.blob.get()[0])) if self.blob.exists() else self.new_state()
        names = list(pdf.columns)
        data = [dict(zip(names, (None if pd.isna(v) else v for v in r))) for r in pdf.itertuples(index=False, name=None)]
        out: list[tuple] = []
        state = self.step(state, data, out)
        self.blob.update((pickle.dumps(state),))
        if out:
            yield pd.DataFrame([(*key, *r) for r in out], columns=[*self.key_names, *self.columns])

    def close(self) -> None:
        pass


class LateTagger(StatefulProcessor):
    """Adds the newest event time of earlier micro-batches and whether a row lies more than `delay_ns` before it."""

    def __init__(self, ts: str, delay_ns: int, ttl_s: int | None) -> None:
        self.ts, self.delay_ns, self.ttl_ms = ts, delay_ns, ttl_s and ttl_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "newest_ns long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = int(self.newest.get()[0]) if self.newest.exists() else None
        top = before
        for pdf in rows:
            if len(pdf):
                now = int(pdf[self.ts].max())
                top = now if top is None else max(top, now)
                late = pdf[self.ts] < before - self.delay_ns if before is not None else False
                yield pdf.assign(newest_ns=pd.Series([before] * len(pdf), index=pdf.index, dtype="Int64"), late=late)
        if top is not None:
            self.newest.update((top,))

    def close(self) -> None:
        pass


def stateful(df: DataFrame, keys: Sequence[str], order: Sequence[str], new_state: Callable[[], Any], step: Step, schema: StructType | str,
             columns: Sequence[str], ttl_s: int | None = RIDE_TTL_S) -> DataFrame:
    """Keyed fold over a stream (state store: RocksDB, see `configure`).

    The state of a key is dropped when nothing has arrived for it in `ttl_s` seconds, so that rides that are
    over do not stay in the store. Expiry keeps a query running, so pass None for one that is to end by itself
    (trigger `availableNow`).
    """
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=FoldProcessor(keys, order, new_state, step, columns, ttl_s),
        outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if ttl_s else "None")


def configure(spark) -> None:
    """`transformWithState` needs the RocksDB state store; set only where the session has not chosen one."""
    name = "spark.sql.streaming.stateStore.providerClass"
    default = "HDFSBackedStateStoreProvider"
    if default in (spark.conf.get(name, default) or default):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
