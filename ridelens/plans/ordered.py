"""Ordered computations that survive one key holding a large share of all rows.

`Window.partitionBy(session)` puts a whole session into one task. These building blocks cut every
session into chunks of its order column, summarise each chunk (map-side combined), run the
per-session window over the few chunk summaries only, and hand the result to each chunk as a
*carrier row*. The windows over the data itself are then partitioned by (key, chunk).

A chunk is a pure function of the row, so tasks can be retried at any time.

The width of a chunk is a constant: ten minutes for nanosecond times, a million for row numbers, one
percent of the value for values. One wild timestamp or a very long ride changes nothing for other rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TIME_CHUNK = 600e9  # ns
INDEX_CHUNK = 1e6
BLOCK_ROWS = 200_000


def chunk_width(order: str) -> float:
    """Width of a chunk of an order column: columns named `..._ns` or `t` are times, others row numbers."""
    return TIME_CHUNK if order.endswith("_ns") or order in ("t", "_t") else INDEX_CHUNK


def value_chunk(value: str) -> Column:
    """Monotone chunk number of a value: neighbours within about one percent share a chunk, whatever the scale."""
    v = F.col(value).cast("double")
    return F.floor(F.signum(v) * F.log2(F.lit(1.0) + F.abs(v)) * 64)


def _chunk_col(order: str, width: float | Column) -> Column:
    if isinstance(width, Column):
        return width
    return F.floor(F.col(order).cast("double") / F.lit(float(width)))


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in names]


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    cols: Sequence[str],
    *,
    tie: Sequence[str] = (),
    chunk: float | Column | None = None,
    prev: str = "prev",
    nxt: str = "next",
) -> DataFrame:
    """Every left row plus the last right row at or before it and the first at or after it.

    The two neighbours come as structs `(ts, *tie, *cols)`, null where there is none. Left rows are
    kept whole; left and right share one shuffle on (keys, chunk).
    """
    keys = list(keys)
    width = chunk or TIME_CHUNK
    payload = F.struct(F.col(right_ts).alias("ts"), *_cols(list(dict.fromkeys([*tie, *cols]))))
    r = right.where(F.col(right_ts).isNotNull()).select(
        *keys, F.col(right_ts).cast("long").alias("_t"), payload.alias("_r"))
    lhs = left.select(*keys, F.col(left_ts).cast("long").alias("_t"), F.struct(*_cols(left.columns)).alias("_l"))
    r_type, l_type = r.schema["_r"].dataType, lhs.schema["_l"].dataType
    both = r.select(*keys, "_t", "_r", F.lit(None).cast(l_type).alias("_l"), F.lit(0).alias("_side")).unionByName(
        lhs.select(*keys, "_t", F.lit(None).cast(r_type).alias("_r"), "_l", F.lit(1).alias("_side"))
    )
    both = both.withColumn("_c", _chunk_col("_t", width))

    edges = both.groupBy(*keys, "_c").agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi"))
    per_key = W.partitionBy(*keys)
    before = per_key.orderBy(F.col("_c")).rowsBetween(W.unboundedPreceding, -1)
    after = per_key.orderBy(F.col("_c").desc()).rowsBetween(W.unboundedPreceding, -1)
    carried = edges.select(
        *keys, "_c",
        F.last("_hi", ignorenulls=True).over(before).alias("_p"),
        F.last("_lo", ignorenulls=True).over(after).alias("_n"),
    )
    null_l = F.lit(None).cast(l_type)
    carriers = carried.select(
        *keys, "_c",
        F.explode(F.array(
            F.struct(F.lit(0).alias("_k"), F.col("_p").alias("_r")),
            F.struct(F.lit(2).alias("_k"), F.col("_n").alias("_r")),
        )).alias("_x"),
    ).where(F.col("_x._r").isNotNull()).select(
        *keys, F.col("_x._r.ts").cast("long").alias("_t"), F.col("_x._r").alias("_r"), null_l.alias("_l"),
        F.lit(0).alias("_side"), "_c", F.col("_x._k").alias("_k"))
    rows = both.withColumn("_k", F.lit(1)).unionByName(carriers)
    return _neighbours(rows, [*keys, "_c"], prev, nxt)


def _neighbours(rows: DataFrame, group: list[str], prev: str, nxt: str) -> DataFrame:
    part = W.partitionBy(*group)
    upto = part.orderBy("_k", "_t", "_side", "_r").rowsBetween(W.unboundedPreceding, W.currentRow)
    downto = part.orderBy(
        F.col("_k").desc(), F.col("_t").desc(), F.col("_side"), F.col("_r").desc()
    ).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        rows.withColumn("_pv", F.last("_r", ignorenulls=True).over(upto))
        .withColumn("_nx", F.last("_r", ignorenulls=True).over(downto))
        .where("_side = 1")
        .select("_l.*", F.col("_pv").alias(prev), F.col("_nx").alias(nxt))
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    *,
    chunk: float | Column | None = None,
    prefix: str = "prev_",
) -> DataFrame:
    """`lag(col)` per key. `order[0]` is numeric and cuts the chunks; `order` is a total order."""
    keys, order = list(keys), list(order)
    width = chunk if chunk is not None else chunk_width(order[0])
    base = df.withColumn("_c", _chunk_col(order[0], width))
    edge = F.max(F.struct(*_cols(order), *[F.col(c).alias(f"_v_{c}") for c in cols]))
    last = base.groupBy(*keys, "_c").agg(edge.alias("_e"))
    before = W.partitionBy(*keys).orderBy("_c")
    carriers = last.select(
        *keys, "_c", F.lag("_e").over(before).alias("_e")
    ).where("_e is not null")
    have = set(keys) | {"_c"}
    extra = {c: F.col(f"_e._v_{c}") for c in cols}
    extra.update({o: F.col(f"_e.{o}") for o in order if o not in extra})
    carrier_rows = carriers.select(
        *keys, "_c",
        *[(extra[c] if c in extra else F.lit(None)).cast(df.schema[c].dataType).alias(c)
          for c in df.columns if c not in have],
        F.lit(0).alias("_k"))
    rows = base.withColumn("_k", F.lit(1)).unionByName(carrier_rows)
    w = W.partitionBy(*keys, "_c").orderBy("_k", *order)
    out = rows
    for c in cols:
        out = out.withColumn(f"{prefix}{c}", F.lag(c).over(w))
    return out.where("_k = 1").drop("_k", "_c")


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    *,
    chunk: float | Column | None = None,
) -> DataFrame:
    """Inclusive running sums per key in a total order (`order[0]` numeric)."""
    keys, order = list(keys), list(order)
    width = chunk if chunk is not None else chunk_width(order[0])
    base = df.withColumn("_c", _chunk_col(order[0], width))
    for name, expr in sums.items():
        base = base.withColumn(f"_s_{name}", expr)
    totals = base.groupBy(*keys, "_c").agg(*[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums])
    before = W.partitionBy(*keys).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    carriers = totals.select(
        *keys, "_c",
        *[F.sum(f"_s_{n}").over(before).cast(base.schema[f"_s_{n}"].dataType).alias(f"_s_{n}") for n in sums])
    have = set(keys) | {"_c"} | {f"_s_{n}" for n in sums}
    carrier_rows = carriers.select(
        *keys, "_c", *[f"_s_{n}" for n in sums],
        *[F.lit(None).cast(base.schema[c].dataType).alias(c) for c in base.columns if c not in have],
        F.lit(0).alias("_k"))
    rows = base.withColumn("_k", F.lit(1)).unionByName(carrier_rows)
    w = W.partitionBy(*keys, "_c").orderBy("_k", *order).rowsBetween(W.unboundedPreceding, W.currentRow)
    for n in sums:
        rows = rows.withColumn(n, F.sum(f"_s_{n}").over(w))
    return rows.where("_k = 1").drop("_k", "_c", *[f"_s_{n}" for n in sums])


def with_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, name: str = "rank", chunk: float | Column | None = None
) -> DataFrame:
    """0-based position of each row within its key."""
    out = running_sums(df, keys, order, {name: F.lit(1).cast("long")}, chunk=chunk)
    return out.withColumn(name, F.col(name) - 1)


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    n: int,
    aggs: dict[str, Column],
    *,
    block: int = BLOCK_ROWS,
    chunk: float | Column | None = None,
) -> DataFrame:
    """Aggregates over the last `n` rows of each key, current row included.

    Rows are ranked, cut into blocks of ranks, and each block also receives the `n-1` rows before it.
    """
    keys, order = list(keys), list(order)
    width = chunk if chunk is not None else chunk_width(order[0])
    ranked = with_rank(df, keys, order, name="_rk", chunk=width)
    own = F.floor(F.col("_rk") / F.lit(block))
    spread = ranked.withColumn("_own", own).withColumn(
        "_b", F.explode(F.sequence(F.col("_own"), F.floor((F.col("_rk") + F.lit(n - 1)) / F.lit(block)))))
    w = W.partitionBy(*keys, "_b").orderBy("_rk").rowsBetween(-(n - 1), W.currentRow)
    for name, agg in aggs.items():
        spread = spread.withColumn(name, agg.over(w))
    return spread.where("_b = _own").drop("_b", "_own", "_rk")


def rank_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    picks: dict[str, tuple[str, float]],
    *,
    count_name: str = "n",
    chunk: float | Column | None = None,
) -> DataFrame:
    """Exact order statistics per key without holding a group's values in one place.

    Equal values are combined before the shuffle; positions are then found on running counts.
    `picks[name] = (rule, p)` with rule
      * `linear`   – interpolated at p·(n−1)
      * `nearest`  – index rint(p·(n−1)), half to even
      * `floor`    – index floor(p·(n−1))
      * `upper`    – index n div 2 (p unused)
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_m"))
    cum = running_sums(counts, keys, [value], {"_hi": F.col("_m")}, chunk=value_chunk(value) if chunk is None else chunk)
    totals = counts.groupBy(*keys).agg(F.sum("_m").alias(count_name))
    joined = (cum.join(totals, keys) if keys else cum.join(F.broadcast(totals)))
    nm1 = (F.col(count_name) - 1).cast("double")
    lo_edge = F.col("_hi") - F.col("_m")
    exprs, post = [], {}
    v = F.col(value).cast("double")

    def at(index: Column) -> Column:
        return F.max(F.when((index >= lo_edge) & (index < F.col("_hi")), v))

    for name, (rule, p) in picks.items():
        pos = nm1 * F.lit(float(p))
        if rule == "linear":
            exprs += [at(F.floor(pos)).alias(f"_{name}_a"), at(F.ceil(pos)).alias(f"_{name}_b")]
            frac = (F.col(count_name) - 1).cast("double") * F.lit(float(p))
            frac = frac - F.floor(frac)
            post[name] = F.col(f"_{name}_a") + (F.col(f"_{name}_b") - F.col(f"_{name}_a")) * frac
        else:
            index = {"nearest": F.rint(pos), "floor": F.floor(pos),
                     "upper": F.floor(F.col(count_name) / 2)}[rule]
            exprs.append(at(index).alias(f"_{name}_a"))
            post[name] = F.col(f"_{name}_a")
    agg = joined.groupBy(*keys, count_name).agg(*exprs)
    return agg.select(*keys, count_name, *[e.alias(n) for n, e in post.items()])


def band_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    lo: Column,
    hi: Column,
    right_ts: str,
    *,
    bucket: int,
    how: str = "inner",
    tasks: int | None = None,
) -> DataFrame:
    """Left rows with every right row whose `right_ts` lies in [lo, hi] (both ends included).

    Both sides are bucketed in time, so the shuffle key is (keys, bucket) and never the key alone.
    `how="left_semi"`-style variants are built by the caller from a left row id. With `tasks`, buckets are dealt over
    so many tasks however small the sides are: for a result much larger than its input.
    """
    b = F.lit(int(bucket))
    lhs = left.withColumn("_lo", lo.cast("long")).withColumn("_hi", hi.cast("long")).where("_lo <= _hi").withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("_lo") / b), F.floor(F.col("_hi") / b))))
    rhs = right.withColumn("_rt", F.col(right_ts).cast("long")).withColumn("_b", F.floor(F.col("_rt") / b))
    if tasks:
        lhs, rhs = (side.repartition(tasks, *keys, "_b") for side in (lhs, rhs))
    return (
        lhs.join(rhs, [*keys, "_b"], how)
        .where((F.col("_rt") >= F.col("_lo")) & (F.col("_rt") <= F.col("_hi")))
        .drop("_lo", "_hi", "_b", "_rt")
    )
