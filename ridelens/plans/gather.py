"""Lists of the items near each point in time, made in the task that holds both, so that neither pairs nor lists are shuffled."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType

ROWS, HITS = 256, 2_000_000  # points compared at once, and list entries of a batch after which it is passed on
_NOWHERE = np.iinfo(np.int64).min


def _same(a: pa.Array) -> np.ndarray:
    """Which values equal the one before; nulls are equal, and so are NaNs."""
    x, y = a[1:], a[:-1]
    same = pc.fill_null(pc.equal(x, y), False)
    same = pc.or_(same, pc.and_(x.is_null(), y.is_null()))
    if pa.types.is_floating(a.type):
        same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(x), pc.is_nan(y)), False))
    return same.to_numpy(zero_copy_only=False)


class _Cell:
    """Items of one bucket in list order; an item that comes with several times has several places of one rank."""

    def __init__(self, parts: list[tuple[list[pa.Array], np.ndarray]]) -> None:
        self.fields = [pa.concat_arrays(list(f)) for f in zip(*(p[0] for p in parts))]
        self.seen = np.concatenate([p[1] for p in parts])
        again = np.zeros(len(self.seen), dtype=bool)
        if len(self.seen) > 1:
            again[1:] = np.logical_and.reduce([_same(f) for f in self.fields])
        self.rank = np.cumsum(~again) if again.any() else None

    def hits(self, at: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of the items at most `reach` from each time, by row, then in list order."""
        some = np.flatnonzero((self.seen >= at.min() - reach) & (self.seen <= at.max() + reach))
        step, found = max(1, HITS // max(1, len(some))), []
        for i in range(0, len(at), step):
            r, k = np.nonzero(np.abs(self.seen[some][None, :] - at[i:i + step, None]) <= reach)
            found.append((r + i, some[k]))
        r, k = (np.concatenate(x) for x in zip(*found))
        if self.rank is not None and len(r) > 1:
            first = np.append(True, (r[1:] != r[:-1]) | (self.rank[k][1:] != self.rank[k][:-1]))
            r, k = r[first], k[first]
        return r, k


def near_lists(points: DataFrame, items: DataFrame, key: str, at: str, seen: str, order: Sequence[str], value: str, *,
               close: int, wide: int, raw: str, tasks: int) -> DataFrame:
    """Points with the items of their key at most `close` from them in time or, where there are none, at most `wide`.

    Items stand in the order of the columns `order` and `value`, each once. Adds `_ids`, the values; `_wide`, whether they are of
    the second kind; and, where `raw` holds, `_list` (structs of `order` and `value`) instead of `_ids`. Items are copied to the
    buckets around theirs and a task holds the items of one bucket; its points stream through in order of time. Columns of the
    points that are null lists come back empty.
    """
    names = list(dict.fromkeys([*order, value]))
    far = max(close, wide)
    width = F.lit(max(2 * close, far // 2, 1))
    place = lambda c: F.floor(c / width)
    entry = [f"_e_{c}" for c in names]
    t, kept = F.col("_t"), points.columns
    left = points.withColumn("_t", F.col(at).cast("long")).withColumn("_b", place(t)).withColumn("_kind", F.lit(1))
    right = items.where(F.col(key).isNotNull() & F.col(seen).isNotNull()).select(
        key, F.col(seen).cast("long").alias("_t"), *[F.col(c).alias(e) for c, e in zip(names, entry)]).withColumn(
        "_b", F.explode(F.sequence(place(t - far), place(t + far)))).withColumn("_kind", F.lit(0))
    # the writer of Arrow batches walks back over null lists at every row, so rows without a list have an empty one
    for f in points.schema.fields:
        if isinstance(f.dataType, ArrayType):
            left = left.withColumn(f.name, F.coalesce(f.name, F.array().cast(f.dataType)))
            right = right.withColumn(f.name, F.array().cast(f.dataType))
    types = {c: items.schema[c].dataType for c in names}
    struct = StructType([StructField(c, types[c]) for c in names])
    out = StructType([*points.schema.fields, StructField("_ids", ArrayType(types[value])), StructField("_list", ArrayType(struct)), StructField("_wide", BooleanType())])
    arrow = [to_arrow_type(types[c]) for c in names]
    pick = names.index(value)

    def pack(rb: pa.RecordBatch, rows: list, found: list) -> pa.RecordBatch:
        """Rows of the batch (as ranges) with their hits: (cell, first row, row, place) each."""
        where = np.concatenate([np.arange(i, j) for i, j in rows])
        wrapped = rb.column(raw).fill_null(False).to_numpy(zero_copy_only=False)[where]
        counts, wide_row = np.zeros(len(where), dtype=np.int64), np.zeros(len(where), dtype=bool)
        ids, lists = [pa.array([], arrow[pick])], [[pa.array([], a)] for a in arrow]
        for cell, start, r, k, second in found:
            counts[start:start + len(second)] = np.bincount(r, minlength=len(second))
            wide_row[start:start + len(second)] = second
            whole = wrapped[start:start + len(second)][r]
            if not whole.all():
                ids.append(cell.fields[pick].take(pa.array(k[~whole])))
            if whole.any():
                for to, f in zip(lists, cell.fields):
                    to.append(f.take(pa.array(k[whole])))

        def listed(values: pa.Array, here: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(here, counts, 0))), pa.int32()), values)

        structs = pa.StructArray.from_arrays([pa.concat_arrays(x) for x in lists], names)
        same = rb.select(kept).take(pa.array(where)) if len(where) < rb.num_rows else rb.select(kept)
        return pa.RecordBatch.from_arrays([*same.columns, listed(pa.concat_arrays(ids), ~wrapped), listed(structs, wrapped),
                                           pa.array(wide_row & (counts > 0))], [*kept, "_ids", "_list", "_wide"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, parts, cell = None, [], None
        for rb in batches:
            if not rb.num_rows:
                continue
            kind, keys = rb.column("_kind").to_numpy(), rb.column(key)
            bucket = rb.column("_b").fill_null(_NOWHERE).to_numpy()
            time, code = rb.column("_t").fill_null(0).to_numpy(), keys.dictionary_encode().indices.fill_null(-1).to_numpy()
            cuts = (np.flatnonzero((code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist()
            rows, found, n, hits = [], [], 0, 0
            for i, j in zip([0, *cuts], [*cuts, len(kind)]):
                here = (keys[i].as_py(), int(bucket[i]))
                if kind[i] == 0:
                    if here != tag:
                        tag, parts = here, []
                    elif cell is not None:
                        parts = [(cell.fields, cell.seen)]
                    parts.append(([rb.column(e).slice(i, j - i) for e in entry], time[i:j]))
                    cell = None
                    continue
                near = here == tag and bucket[i] != _NOWHERE and here[0] is not None
                if near and cell is None:
                    cell = _Cell(parts)
                for a in range(i, j, ROWS):
                    z = min(j, a + ROWS)
                    if near:
                        r, k = cell.hits(time[a:z], close)
                        second = np.bincount(r, minlength=z - a) == 0
                        if second.any():
                            late = np.flatnonzero(second)
                            r2, k2 = cell.hits(time[a:z][late], wide)
                            r, k = np.append(r, late[r2]), np.append(k, k2)
                            by = np.argsort(r, kind="stable")
                            r, k = r[by], k[by]
                        found.append((cell, n, r, k, second))
                        hits += len(r)
                    rows.append((a, z))
                    n += z - a
                    if hits >= HITS:
                        yield pack(rb, rows, found)
                        rows, found, n, hits = [], [], 0, 0
            if rows:
                yield pack(rb, rows, found)

    both = right.unionByName(left, allowMissingColumns=True).repartition(tasks, key, "_b").sortWithinPartitions(key, "_b", "_kind", *entry, "_t")
    return both.mapInArrow(run, out)
