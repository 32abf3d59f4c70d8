"""Sequential rules (state machines) over ordered rows, run inside Spark tasks.

Rows are hash-partitioned on the key and sorted by Spark; the task then walks Arrow batches and keeps
only the state of the current key, so no group is ever held in memory and a long group only spills
in Spark's own sort.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Columns = dict[str, list]
Step = Callable[[object, Columns, range, list], None]


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    new_state: Callable[[], object],
    step: Step,
    schema: StructType | str,
    finish: Callable[[object, list], None] | None = None,
) -> DataFrame:
    """`step(state, columns, span, out)` gets consecutive rows of one key (a key may take several calls)
    and appends output tuples to `out`; `finish(state, out)` runs when the key is over."""
    keys, order = list(keys), list(order)
    struct = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def pack(out: list) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for rb in batches:
            cols = {n: rb.column(i).to_pylist() for i, n in enumerate(rb.schema.names)}
            tags = list(zip(*(cols[k] for k in keys)))
            out: list = []
            i, n = 0, len(tags)
            while i < n:
                j = i + 1
                while j < n and tags[j] == tags[i]:
                    j += 1
                if state is None or tags[i] != current:
                    if state is not None and finish is not None:
                        finish(state, out)
                    current, state = tags[i], new_state()
                step(state, cols, range(i, j), out)
                i = j
            if out:
                yield pack(out)
        if state is not None and finish is not None:
            out = []
            finish(state, out)
            if out:
                yield pack(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, struct)


def ordered_pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], new_state: Callable[[], object],
                 pick: Callable[[list, list[int], pa.RecordBatch], np.ndarray], columns: Sequence[str]) -> DataFrame:
    """Like `ordered_fold` where the output is some of the input rows: `pick(states, sizes, rows)` gets a batch that holds
    `sizes[i]` consecutive rows of the key with `states[i]` and returns the places of the rows that stay. Their `columns` are
    taken as Arrow, so no other value becomes a Python object. A key that goes on in the next batch keeps its state."""
    keys, names = list(keys), list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for rb in batches:
            tags = list(zip(*(rb.column(k).to_pylist() for k in keys)))
            states, sizes = [], []
            for tag in tags:
                if state is None or tag != current:
                    current, state = tag, new_state()
                if not states or states[-1] is not state:
                    states.append(state)
                    sizes.append(0)
                sizes[-1] += 1
            stay = pick(states, sizes, rb) if tags else []
            if len(stay):
                yield rb.select(names).take(pa.array(stay, pa.int64()))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, df.select(*names).schema)
