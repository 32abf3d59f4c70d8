"""Number formatting that agrees with C's printf."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2^27 + 1, splits a double into two halves of 26 bits


def _halves(v: float) -> tuple[float, float]:
    c = _SPLIT * v
    hi = c - (c - v)
    return hi, v - hi


def round_exact(x: Column, digits: int) -> Column:
    """Round by the exact binary value, ties to even, as printf and Python do.

    Spark's own rounding works on the shortest decimal text, so 0.35 (in fact 0.34999…) would become
    0.4. Here the product with 10^digits is taken together with its rounding error.
    """
    scale = 10.0 ** digits
    s_hi, s_lo = _halves(scale)
    c = x * _SPLIT
    x_hi = c - (c - x)
    x_lo = x - x_hi
    p = x * scale
    err = ((x_hi * s_hi - p) + x_hi * s_lo + x_lo * s_hi) + x_lo * s_lo
    base = F.floor(p).cast("double")
    rest = p - base
    up = (rest > 0.5) | ((rest == 0.5) & ((err > 0) | ((err == 0) & (F.pmod(base, F.lit(2.0)) == 1.0))))
    return F.when(up, base + 1.0).otherwise(base) / scale
