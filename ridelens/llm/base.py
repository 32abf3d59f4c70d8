"""Shared helpers of the text operators: registration, session settings, words, Arrow output."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ridelens.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SPACE = r"[\x20\x09-\x0D]+"


def register(name: str, sql: str | None = None):
    """Register `fn(spark, sf_dir) -> DataFrame` as a query, with DuckDB SQL where it can be expressed."""

    def deco(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return deco


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package, keep Arrow batches small enough for long texts, and make sure checkpoints have a folder.

    The folder is the one that the cluster names in `spark.checkpoint.dir`; only where none is named
    (a single machine, tests) one below the warehouse is set.
    """
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` by way of a compressed table in the shared folder: cuts the lineage with less disk than `checkpoint()`."""
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(col: str) -> Column:
    """A text as bytes, null as empty: `bytes.lower()` touches A-Z only and `bytes.split()` cuts exactly at `SPACE`."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def fold(id_col: str, modulus: int = 5) -> Column:
    """Remainder of crc32(id as text); a null id counts as the text ``null``."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")), F.lit(modulus))


def schema_of(ddl: str | StructType) -> tuple[StructType, pa.Schema]:
    struct = ddl if isinstance(ddl, StructType) else _parse_datatype_string(ddl)
    return struct, to_arrow_schema(struct)


def pack(arrow: pa.Schema, columns: Sequence[Iterable]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
