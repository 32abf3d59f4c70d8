"""Polygon, box and run-length expressions (native column expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xs(poly: Column) -> Column:
    return F.transform(poly, lambda p: p[0])


def ys(poly: Column) -> Column:
    return F.transform(poly, lambda p: p[1])


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def mean(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, total(arr) / F.size(arr)).otherwise(F.lit(0.0))


def empty(poly: Column) -> Column:
    return poly.isNull() | (F.size(poly) == 0)


def bbox(poly: Column) -> Column:
    """[x0, y0, x1, y1]; zeros for an empty polygon."""
    box = F.array(F.array_min(xs(poly)), F.array_min(ys(poly)), F.array_max(xs(poly)), F.array_max(ys(poly)))
    return F.when(empty(poly), F.array(*[F.lit(0.0)] * 4)).otherwise(box)


def area(poly: Column) -> Column:
    """Shoelace area; 0 below three vertices."""
    shifted = F.concat(F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(1))), F.slice(poly, 1, 1))
    cross = F.zip_with(poly, shifted, lambda a, b: a[0] * b[1] - a[1] * b[0])
    return F.when(poly.isNull() | (F.size(poly) < 3), F.lit(0.0)).otherwise(F.abs(total(cross)) * 0.5)


def centroid(poly: Column) -> tuple[Column, Column]:
    z = F.lit(0.0)
    return F.when(empty(poly), z).otherwise(mean(xs(poly))), F.when(empty(poly), z).otherwise(mean(ys(poly)))


def ground_contact(poly: Column, band_px: float = 6.0) -> tuple[Column, Column]:
    """Mean of the vertices within `band_px` of the lowest one (largest y)."""
    bottom = F.array_max(ys(poly)) - F.lit(band_px)
    band = F.filter(poly, lambda p: p[1] >= bottom)
    z = F.lit(0.0)
    return F.when(empty(poly), z).otherwise(mean(xs(band))), F.when(empty(poly), z).otherwise(mean(ys(band)))


def iou(a: list[Column], b: list[Column], *, plus_one: bool = False) -> Column:
    """Intersection over union of two boxes given as four columns each."""
    one = F.lit(1.0 if plus_one else 0.0)
    zero = F.lit(0.0)
    iw = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + one)
    ih = F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + one)
    inter = iw * ih
    if plus_one:
        area_a = (a[2] - a[0] + one) * (a[3] - a[1] + one)
        area_b = (b[2] - b[0] + one) * (b[3] - b[1] + one)
        return inter / (area_a + area_b - inter + F.lit(1e-9))
    area_a = F.greatest(zero, a[2] - a[0]) * F.greatest(zero, a[3] - a[1])
    area_b = F.greatest(zero, b[2] - b[0]) * F.greatest(zero, b[3] - b[1])
    union = area_a + area_b - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(zero)


def contains(poly: Column, x: Column, y: Column) -> Column:
    """Even-odd rule. Each edge (previous vertex, vertex) that a ray to the right crosses flips the parity."""
    before = F.concat(F.slice(poly, F.size(poly), 1), F.slice(poly, 1, F.greatest(F.size(poly) - 1, F.lit(0))))

    def crossed(cur: Column, prev: Column) -> Column:
        dy = prev[1] - cur[1]
        at_x = (prev[0] - cur[0]) * (y - cur[1]) / F.when(dy == 0, F.lit(1e-9)).otherwise(dy) + cur[0]
        return ((cur[1] > y) != (prev[1] > y)) & (x < at_x)

    flips = F.size(F.filter(F.zip_with(poly, before, crossed), lambda f: f))
    return F.when(empty(poly), F.lit(False)).otherwise(flips % 2 == 1)


def cover_ratio(polys: Column, width: Column, height: Column) -> Column:
    """Sum of the polygons' box areas over the frame area, at most 1."""
    def box_area(p: Column) -> Column:
        w = F.greatest(F.lit(0.0), F.array_max(xs(p)) - F.array_min(xs(p)))
        h = F.greatest(F.lit(0.0), F.array_max(ys(p)) - F.array_min(ys(p)))
        return F.when(F.size(p) >= 3, w * h).otherwise(F.lit(0.0))

    covered = F.aggregate(F.transform(polys, box_area), F.lit(0.0), lambda a, v: a + v)
    ratio = F.least(F.lit(1.0), covered / (width * height).cast("double"))
    return F.when(polys.isNull() | (F.size(polys) == 0) | (width < 1) | (height < 1), F.lit(0.0)).otherwise(ratio)


def run_cover(counts: Column, width: Column, height: Column) -> Column:
    """Pixels set by run lengths that start with a zero run, cut at width·height."""
    limit = (width * height).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("on"), F.lit(False).alias("lit"))

    def step(acc: Column, c: Column) -> Column:
        stop = acc["pos"] + c.cast("long")
        gained = F.greatest(F.least(stop, limit) - F.least(acc["pos"], limit), F.lit(0).cast("long"))
        return F.struct(
            stop.alias("pos"),
            (acc["on"] + F.when(acc["lit"], gained).otherwise(F.lit(0).cast("long"))).alias("on"),
            (~acc["lit"]).alias("lit"))

    return F.aggregate(counts, start, step, lambda acc: acc["on"])
