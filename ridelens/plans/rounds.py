"""Cutting lineage between rounds of an iterative job."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in `spark.checkpoint.dir`.

    Where that setting is absent (local tests), a folder below the warehouse is used.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
    return df.checkpoint(eager=True)
