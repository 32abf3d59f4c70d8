"""Spatial joins through a pixel grid, so that a crowded frame is split by place and no frame emits all pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size)))


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(_cell(lo, size), F.greatest(_cell(hi, size), _cell(lo, size)))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_box: Box, right_box: Box, *,
                 size: float = 160.0) -> DataFrame:
    """Pairs of rows whose boxes touch. Each pair comes out once, in the first cell both boxes share."""
    def spread(df: DataFrame, box: Box, p: str) -> DataFrame:
        out = df
        for n, c in zip(("x0", "y0", "x1", "y1"), box):
            out = out.withColumn(f"_{p}{n}", c.cast("double"))
        return out.withColumn("_gx", F.explode(_cells(F.col(f"_{p}x0"), F.col(f"_{p}x1"), size))).withColumn(
            "_gy", F.explode(_cells(F.col(f"_{p}y0"), F.col(f"_{p}y1"), size)))

    lhs, rhs = spread(left, left_box, "l"), spread(right, right_box, "r")
    first_x = _cell(F.greatest("_lx0", "_rx0"), size)
    first_y = _cell(F.greatest("_ly0", "_ry0"), size)
    touch = (F.col("_lx0") <= F.col("_rx1")) & (F.col("_rx0") <= F.col("_lx1")) & (
        F.col("_ly0") <= F.col("_ry1")) & (F.col("_ry0") <= F.col("_ly1"))
    helper = [f"_{p}{n}" for p in "lr" for n in ("x0", "y0", "x1", "y1")]
    return (lhs.join(rhs, [*keys, "_gx", "_gy"]).where((F.col("_gx") == first_x) & (F.col("_gy") == first_y) & touch)
            .drop("_gx", "_gy", *helper))


def near_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_xy: tuple[Column, Column],
              right_xy: tuple[Column, Column], radius: float) -> DataFrame:
    """Pairs of points at most `radius` apart, with `_d2` (squared distance).

    Cells are four radii wide, so a left point falls into one to four of them, a little over two on average.
    """
    r = float(radius)
    size = 4 * r or 1.0
    lhs = left.withColumn("_lx", left_xy[0]).withColumn("_ly", left_xy[1])
    lhs = lhs.withColumn("_gx", F.explode(_cells(F.col("_lx") - r, F.col("_lx") + r, size))).withColumn(
        "_gy", F.explode(_cells(F.col("_ly") - r, F.col("_ly") + r, size)))
    rhs = right.withColumn("_rx", right_xy[0]).withColumn("_ry", right_xy[1])
    rhs = rhs.withColumn("_gx", _cell(F.col("_rx"), size)).withColumn("_gy", _cell(F.col("_ry"), size))
    d2 = (F.col("_lx") - F.col("_rx")) * (F.col("_lx") - F.col("_rx")) + (
        F.col("_ly") - F.col("_ry")) * (F.col("_ly") - F.col("_ry"))
    return (lhs.join(rhs, [*keys, "_gx", "_gy"]).withColumn("_d2", d2).where(F.col("_d2") <= r * r)
            .drop("_gx", "_gy", "_lx", "_ly", "_rx", "_ry"))


def point_in_box_join(points: DataFrame, boxes: DataFrame, keys: Sequence[str], xy: tuple[Column, Column], box: Box, *,
                      size: float = 160.0) -> DataFrame:
    """Points with every box that contains them (closed); callers refine with the exact shape."""
    rhs = boxes
    for n, c in zip(("x0", "y0", "x1", "y1"), box):
        rhs = rhs.withColumn(f"_b{n}", c.cast("double"))
    rhs = rhs.withColumn("_gx", F.explode(_cells(F.col("_bx0"), F.col("_bx1"), size))).withColumn(
        "_gy", F.explode(_cells(F.col("_by0"), F.col("_by1"), size)))
    lhs = points.withColumn("_px", xy[0].cast("double")).withColumn("_py", xy[1].cast("double"))
    lhs = lhs.withColumn("_gx", _cell(F.col("_px"), size)).withColumn("_gy", _cell(F.col("_py"), size))
    inside = (F.col("_px") >= F.col("_bx0")) & (F.col("_px") <= F.col("_bx1")) & (
        F.col("_py") >= F.col("_by0")) & (F.col("_py") <= F.col("_by1"))
    return lhs.join(rhs, [*keys, "_gx", "_gy"]).where(inside).drop(
        "_gx", "_gy", "_px", "_py", "_bx0", "_by0", "_bx1", "_by1")
