"""Next-fit packing of ordered rows without walking them one by one.

Where a pack that starts at a row ends depends on running sums alone, so every row's "next start" is one
as-of lookup. The starts that are really reached from the first row come out by pointer doubling: after k
rounds the first 2^k starts of every key are known and every row knows its 2^k-th start. A key that holds
most of all rows is spread over the tasks like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.plans.ordered import asof, running_sums
from ridelens.plans.rounds import cut_lineage


def _same(a: str, b: str, keys: Sequence[str]):
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return cond


def pack_starts(rows: DataFrame, keys: Sequence[str], cap: int) -> DataFrame:
    """Keys and `_i` of the rows that open a pack.

    `rows`: position `_i` (from 1) in the key, size `_n`, sums before (`_s`) and after (`_p`) the row.
    """
    keys = list(keys)
    sized, large = rows.where("_n > 0"), rows.where(F.col("_n") > cap)
    # a row of size zero opens a pack only as the first one or right after a row that is over the cap by itself
    after = large.select(*keys, (F.col("_i") + 1).alias("_i"))
    zero = rows.where("_n = 0").alias("z")
    zeros = zero.where("_i = 1").unionByName(zero.where("_i > 1").join(
        after.alias("a"), _same("z", "a", keys) & (F.col("z._i") == F.col("a._i")), "left_semi"))
    asked = sized.where(F.col("_n") <= cap).unionByName(zeros).select(*keys, "_i", (F.col("_s") + F.lit(int(cap)) + 1).alias("_at"))
    found = asof(asked, sized.select(*keys, "_p", F.col("_i").alias("_to")), keys, "_at", "_p", ["_to"], chunk=float(max(int(cap), 1)))
    jump = cut_lineage(found.select(*keys, "_i", F.col("next._to").alias("_to")).where("_to is not null").unionByName(
        large.select(*keys, "_i", (F.col("_i") + 1).alias("_to"))))
    reached = rows.where("_i = 1").select(*keys, "_i")
    while not jump.isEmpty():
        onward = reached.alias("r").join(jump.alias("j"), _same("r", "j", keys) & (F.col("r._i") == F.col("j._i"))).select(
            *[F.col(f"r.{k}").alias(k) for k in keys], F.col("j._to").alias("_i"))
        reached = cut_lineage(reached.unionByName(onward))
        # rows near the end of their key drop out, so the table shrinks as the jumps grow
        jump = cut_lineage(jump.alias("a").join(jump.alias("b"), _same("a", "b", keys) & (F.col("a._to") == F.col("b._i"))).select(
            *[F.col(f"a.{k}").alias(k) for k in keys], F.col("a._i").alias("_i"), F.col("b._to").alias("_to")))
    return reached


def next_fit(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, cap: int, *, name: str = "pack") -> DataFrame:
    """Adds the pack number (from 1) of each row: in order, a new pack opens when the next row would pass `cap`.

    Sizes that are null or negative count as zero. Rows that agree in `order` follow by size.
    """
    keys, order = list(keys), list(dict.fromkeys([*order, size]))
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    # slices of the sort order are the chunks; they are written down because a second sort may cut elsewhere
    sliced = cut_lineage(df.withColumn("_n", n).repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()))
    summed = cut_lineage(running_sums(sliced, keys, order, {"_p": F.col("_n"), "_i": F.lit(1).cast("long")}, chunk=F.col("_slice"))
                         .withColumn("_s", F.col("_p") - F.col("_n")))
    starts = pack_starts(summed.select(*keys, "_i", "_n", "_s", "_p"), keys, cap).withColumn("_open", F.lit(1).cast("long"))
    opened = summed.alias("f").join(starts.alias("o"), _same("f", "o", keys) & (F.col("f._i") == F.col("o._i")), "left").select(
        "f.*", F.coalesce("o._open", F.lit(0).cast("long")).alias("_open"))
    numbered = running_sums(opened, keys, ["_i"], {name: F.col("_open")}, chunk=F.col("_slice"))
    return numbered.select(*df.columns, F.col(name).cast("int").alias(name))
