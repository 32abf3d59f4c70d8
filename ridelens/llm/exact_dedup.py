"""Exact duplicates with a heavy-hitter split.

A Misra-Gries summary per task, merged over tasks, finds every digest that holds more than `1 / k` of
all rows. Their exact sizes and smallest ids are then counted (map-side combined) and the verified
winners, at most `k` rows, are broadcast: rows of a huge group are settled where they are read and
never meet in one task. All other digests have groups below `n / k` rows and use an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridelens.llm.base import SPACE, pack, register, schema_of, table

HEAVY = 1024  # counters of a summary, and so the most rows that are broadcast


def text_digest(text: Column) -> Column:
    """Lower-case hex sha256 of the text in UTF-8, each run of white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256)


def misra_gries(keys: DataFrame, column: str, k: int = HEAVY) -> DataFrame:
    """At most `k` rows (column, estimate), among them every key that holds more than `1 / k` of the rows."""
    struct, arrow = schema_of(f"`{column}` string, estimate long")

    def trim(counts: dict[str, int]) -> dict[str, int]:
        if len(counts) <= k:
            return counts
        cut = sorted(counts.values(), reverse=True)[k]
        return {key: n - cut for key, n in counts.items() if n > cut}

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            found = pc.value_counts(batch.column(0))
            for key, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
                counts[key] = counts.get(key, 0) + n
            counts = trim(counts)
        yield pack(arrow, [list(counts), list(counts.values())])

    parts = keys.select(column).mapInArrow(summarise, struct)
    merged = parts.groupBy(column).agg(F.sum("estimate").alias("estimate"))
    return merged.orderBy(F.desc("estimate"), column).limit(k)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), k: int = HEAVY) -> DataFrame:
    """One row per input row: `id_col`, keep_id, group_size, kept, text_sha256 and the columns of `carry`.

    Texts are equal when their digests are; a null text counts as empty. Of equal texts the row with the
    smallest id stays; a null id is larger than any other, and of repeated rows with that id one stays.
    An empty table gives an empty result. Other columns are not looked at, so their names cannot clash.
    """
    digest, size, first = "__digest", "__size", "__first"
    rows = docs.select(F.col(id_col).alias("__id"), text_digest(F.col(text_col)).alias(digest), F.struct(*[F.col(c) for c in carry], F.lit(0).alias("__none")).alias("__row"))
    if not carry:
        rows = rows.checkpoint()
    found = misra_gries(rows, digest, k).select(digest)
    winners = (
        rows.join(F.broadcast(found), digest).groupBy(digest)
        .agg(F.count(F.lit(1)).alias(size), F.min("__id").alias(first)).where(F.col(size) > 1).checkpoint()
    )
    marked = rows.join(F.broadcast(winners), digest, "left")
    heavy = marked.where(F.col(size).isNotNull())
    is_first = F.col("__id").eqNullSafe(F.col(first))
    best = heavy.where(is_first).withColumn("__n", F.row_number().over(W.partitionBy(digest).orderBy("__id")))
    rest = marked.where(F.col(size).isNull())
    order = W.partitionBy(digest).orderBy(F.col("__id").asc_nulls_last())
    every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = rest.withColumns({first: F.first("__id").over(every), size: F.count(F.lit(1)).over(every), "__n": F.row_number().over(order)})
    out = heavy.where(~is_first).withColumn("__n", F.lit(2)).unionByName(best).unionByName(rest)
    return out.select(
        F.col("__id").alias(id_col), F.col(first).alias("keep_id"), F.col(size).alias("group_size"), (F.col("__n") == 1).alias("kept"),
        F.col(digest).alias("text_sha256"), *[F.col("__row")[c].alias(c) for c in carry],
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = HEAVY) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    row = docs.select(id_col, text_col, F.struct("*").alias("__doc"))
    return exact_dedup(row, id_col, text_col, ["__doc"], k).where("kept").select("__doc.*")


SQL = """
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from t group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)
"""


@register("op2_exact_dedup", SQL)
def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))
