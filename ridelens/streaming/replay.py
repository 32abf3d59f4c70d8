"""Run a stream over a finished table, as it would have arrived, and return what its sink holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ridelens.session import shared_folder
from ridelens.streaming.state import configure


def replay(rows: DataFrame, batch: str, batches: int, gate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that `gate` appends when `rows` arrive in `batches` parts, numbered from 0 in column `batch`.

    The rows are made once and kept by part. Each part is written to the source folder, then the stream takes up what is new and ends by itself
    (`availableNow`); state and offsets live on in its checkpoint. Its rows go through a Parquet sink.
    """
    spark = rows.sparkSession
    configure(spark)
    folder = shared_folder(spark, "streams")
    rows.withColumn("_part", F.col(batch).cast("int")).write.partitionBy("_part").parquet(f"{folder}/parts")
    parts = spark.read.schema(StructType([*rows.schema.fields, StructField("_part", IntegerType())])).parquet(f"{folder}/parts")
    stream = None
    for i in range(batches):
        parts.where(F.col("_part") == i).drop("_part").write.mode("append").parquet(f"{folder}/in")
        stream = gate(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        running = (stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
                   .outputMode("append").trigger(availableNow=True).start())
        running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
