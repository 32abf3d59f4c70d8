"""Privacy rules as column expressions, including a schema walk for nested data."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens.functions import vocab as V

_CI_PATH = "(?i)" + V.PATH_PATTERN


def hide_paths(text: Column) -> Column:
    return F.regexp_replace(text, _CI_PATH, "[path]")


def crash_text(text: Column) -> Column:
    """The whole text without paths and coordinates."""
    out = hide_paths(text)
    out = F.regexp_replace(out, V.LATITUDE_PATTERN, '"latitude": null')
    return F.regexp_replace(out, V.LONGITUDE_PATTERN, '"longitude": null')


def sensitive_name(name: str) -> bool:
    low = name.lower()
    return low in V.SENSITIVE_KEYS or any(s in low for s in V.SENSITIVE_SUBSTRINGS)


def sensitive_key(key: Column) -> Column:
    low = F.lower(key)
    hit = low.isin(V.SENSITIVE_KEYS)
    for s in V.SENSITIVE_SUBSTRINGS:
        hit = hit | low.contains(s)
    return hit


def plain_redact(value: Any, key: str = "") -> Any:
    """One decoded JSON value under its nearest key: numbers and booleans under a sensitive key become null, anything
    else there the marker; elsewhere paths are hidden in strings, and objects and lists are entered at any depth."""
    if sensitive_name(key):
        return None if isinstance(value, (int, float)) else "[redacted]"
    if isinstance(value, str):
        return re.sub(_CI_PATH, "[path]", value)
    if isinstance(value, dict):
        return {k: plain_redact(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [plain_redact(v, key) for v in value]
    return value


def _redact_text(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(plain_redact(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


def redact_json(text: Column) -> Column:
    """JSON text of any depth redacted by key, as compact JSON text; null where it is null or no JSON.

    Built-in expressions have fixed depth, so the walk is an Arrow function over whole batches. Numbers keep their value
    (integers exactly), keys their order; of a key that repeats in an object the last value stays.
    """
    @F.pandas_udf("string")
    def walk(values: pd.Series) -> pd.Series:
        return values.map(_redact_text, na_action="ignore")

    return walk(text)


_NUMERIC = (T.NumericType, T.BooleanType)


def redact(value: Column, dtype: T.DataType, name: str) -> Column:
    """Redact one value under its key. Column types are kept: where the marker text does not fit the
    type (a nested value under a sensitive key) the value becomes null."""
    if sensitive_name(name):
        if isinstance(dtype, T.StringType):
            return F.lit("[redacted]")
        return F.lit(None).cast(dtype)
    if isinstance(dtype, T.StringType):
        return hide_paths(value)
    if isinstance(dtype, T.StructType):
        fields = [redact(value[f.name], f.dataType, f.name).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        if isinstance(dtype.elementType, _NUMERIC):
            return value
        return F.transform(value, lambda v: redact(v, dtype.elementType, name))
    if isinstance(dtype, T.MapType):
        def cell(k: Column, v: Column) -> Column:
            plain = redact(v, dtype.valueType, "")
            hidden = (F.lit("[redacted]") if isinstance(dtype.valueType, T.StringType)
                      else F.lit(None).cast(dtype.valueType))
            return F.when(sensitive_key(k), hidden).otherwise(plain)
        return F.transform_values(value, cell)
    return value
