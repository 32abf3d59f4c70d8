"""Pinhole camera on a handlebar mount: vehicle frame (x right, y forward, z up) to pixels and back.

The rotation is computed once per mount (`rotation`, a struct of nine numbers) and then only referenced,
so that projecting many points stays a short expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOUNT_FIELDS = ("camera_height_m", "pitch_deg", "roll_deg", "yaw_deg", "lateral_offset_m", "fx", "fy", "cx", "cy")
_AXES = ("right", "down", "ahead")


def rotation(pitch_deg: Column, roll_deg: Column, yaw_deg: Column) -> Column:
    """Camera axes in vehicle coordinates: fields right_i, down_i, ahead_i (i = 0..2)."""
    p, r, y = F.radians(pitch_deg), F.radians(roll_deg), F.radians(yaw_deg)
    cp, sp, cr, sr, cy, sy = F.cos(p), F.sin(p), F.cos(r), F.sin(r), F.cos(y), F.sin(y)
    # without roll: yaw about the up axis, then pitch about the right axis
    right = [cy, sy, F.lit(0.0)]
    down = [sp * sy, -sp * cy, -cp]
    rolled = {
        "right": [cr * a - sr * b for a, b in zip(right, down)],
        "down": [sr * a + cr * b for a, b in zip(right, down)],
        "ahead": [-cp * sy, cp * cy, -sp],
    }
    return F.struct(*[rolled[a][i].alias(f"{a}_{i}") for a in _AXES for i in range(3)])


def heading(mounts: DataFrame) -> Column:
    """Yaw of the camera on the bar plus that of the bar when riding straight."""
    own = F.col("yaw_deg")
    return own + F.coalesce("handlebar_neutral_yaw_deg", F.lit(0.0)) if "handlebar_neutral_yaw_deg" in mounts.columns else own


def with_rotation(mounts: DataFrame, name: str = "_rot") -> DataFrame:
    return mounts.withColumn(name, rotation(F.col("pitch_deg"), F.col("roll_deg"), heading(mounts)))


def mount_columns(rot: str | Column = "_rot", c=F.col) -> dict[str, Column]:
    m = {n: c(n) for n in ("camera_height_m", "lateral_offset_m", "fx", "fy", "cx", "cy")}
    m["rot"] = F.col(rot) if isinstance(rot, str) else rot
    return m


def project(x: Column, y: Column, m: dict[str, Column]) -> tuple[Column, Column]:
    """Pixel of the ground point (x, y, 0); null when it is not in front of the camera."""
    rel = [x - m["lateral_offset_m"], y, -m["camera_height_m"]]
    xc, yc, zc = (sum((m["rot"][f"{a}_{i}"] * rel[i] for i in range(1, 3)), m["rot"][f"{a}_0"] * rel[0]) for a in _AXES)
    seen = zc > 0.15
    return (F.when(seen, m["fx"] * xc / zc + m["cx"]), F.when(seen, m["fy"] * yc / zc + m["cy"]))


def ground_point(u: Column, v: Column, m: dict[str, Column], *, max_y: float = 90.0) -> Column:
    """Struct (x, y) where the ray through a pixel meets the road plane; null when it misses or is out of range.

    The ray is not normalised first: its length cancels out of the meeting point. Only the two range
    tests on the scale need it.
    """
    rx, ry = (u - m["cx"]) / m["fx"], (v - m["cy"]) / m["fy"]
    dx, dy, dz = (rx * m["rot"][f"right_{i}"] + ry * m["rot"][f"down_{i}"] + m["rot"][f"ahead_{i}"] for i in range(3))
    norm = F.sqrt(rx * rx + ry * ry + F.lit(1.0))
    scale = F.when(F.abs(dz / norm) >= 1e-8, -m["camera_height_m"] / dz)
    gy = scale * dy
    ok = (scale * norm >= 0.2) & (gy >= 0.4) & (gy <= max_y)
    return F.when(ok, F.struct((m["lateral_offset_m"] + scale * dx).alias("x"), gy.alias("y")))
