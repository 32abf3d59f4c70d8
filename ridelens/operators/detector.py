"""User-supplied detectors over frame references."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DETECTION = [("name", T.StringType()), ("x0", T.DoubleType()), ("y0", T.DoubleType()), ("x1", T.DoubleType()), ("y1", T.DoubleType()), ("conf", T.DoubleType())]


def run_detector(frames: DataFrame, detect: Callable[[pd.DataFrame], pd.DataFrame], *, keep: Sequence[str],
                 setup: Callable[[], object] | None = None) -> DataFrame:
    """`detect(batch)` returns detections with the `keep` columns and name, x0, y0, x1, y1, conf.

    With `setup` the model is made once per task and passed as second argument. A detector that fails
    fails the task, which Spark retries; nothing is dropped silently.
    """
    schema = T.StructType([*[frames.schema[k] for k in keep], *[T.StructField(n, t) for n, t in DETECTION]])
    names = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = setup() if setup is not None else None
        for pdf in batches:
            out = detect(pdf) if setup is None else detect(pdf, model)
            yield out[names]

    return frames.mapInPandas(run, schema)
