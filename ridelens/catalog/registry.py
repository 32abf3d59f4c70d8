"""Registered queries: each runs an operator over whole driver tables; most carry an independent SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.catalog.adapters import duck_cte, spark_view
from ridelens.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Views:
    """`views.a_frames` is the DataFrame of that view."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return spark_view(self.spark, self.sf_dir, name)


def query(name: str, views: list[str] | None = None, sql: str | None = None):
    """Register `fn(views) -> DataFrame`; `sql` is a DuckDB select, prefixed with the named views."""

    def deco(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(tune(spark), sf_dir))
        if sql is not None:
            body = sql.strip()
            head = duck_cte(views) if views else ""
            if body.lower().startswith("with "):
                body = body[5:]
                ORACLES[name] = f"with {head}{', ' if head else ''}{body}"
            elif body.lower().startswith("recursive "):
                ORACLES[name] = f"with recursive {head}{', ' if head else ''}{body[10:]}"
            else:
                ORACLES[name] = f"with {head} {body}" if head else body
        return fn

    return deco


def r6(c: Column | str) -> Column:
    """Round to 6 places, without negative zero."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, r6(c))
    return df


def nudged(df: DataFrame, *cols: str) -> DataFrame:
    """Like `rounded` for products of short decimals, which often lie exactly between two roundings."""
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c) + F.lit(1e-9), 6))
    return df
