"""Runtime settings that fit these plans."""

from __future__ import annotations

import os
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that it need not be installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="ridelens-"), "ridelens")
    sc.addPyFile(shutil.make_archive(base, "zip", root_dir=os.path.dirname(package), base_dir=os.path.basename(package)))
    _SHIPPED.add(sc.applicationId)


def tune(spark: SparkSession) -> SparkSession:
    """Adjust SQL settings of a running session; nothing here changes results.

    The JVM does not compile methods of more than 8000 bytecodes, and wide projections easily make
    one whole-stage method longer than that. With this limit Spark then splits the expressions into
    short methods, which runs several times faster.
    """
    ship(spark)
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared checkpoint folder; below the warehouse only where none is named."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return f"{(named or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{kind}/{uuid4().hex}"
