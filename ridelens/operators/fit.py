"""Least squares from aggregated moments, grid calibration of mounts, seeded samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.functions import camera


def _moments(df: DataFrame, features: str, dim: int, targets: dict[str, Column]) -> tuple[np.ndarray, np.ndarray]:
    """XᵀX and XᵀY with an intercept column.

    Every task multiplies its Arrow batches and hands on one matrix; the matrices are summed by Spark,
    cell by cell, so the driver receives (dim+1)·(dim+1+targets) numbers whatever the row count.
    """
    slim = df.select(F.col(features).alias("x"), *[y.alias(f"y{i}") for i, y in enumerate(targets.values())])
    n_y = len(targets)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim + 1, dim + 1 + n_y))
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.hstack([np.stack(pdf["x"].to_numpy()).astype(np.float64), np.ones((len(pdf), 1))])
            total += x.T @ np.hstack([x, pdf[[f"y{i}" for i in range(n_y)]].to_numpy(dtype=np.float64)])
        yield pd.DataFrame({"cell": np.arange(total.size), "v": total.ravel()})

    cells = slim.mapInPandas(partial, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).orderBy("cell").toPandas()
    m = cells["v"].to_numpy().reshape(dim + 1, dim + 1 + n_y)
    return m[:, :dim + 1], m[:, dim + 1:]


def fit_linear(df: DataFrame, *, features: str = "features", dim: int, target: str = "y") -> list[float]:
    """Weights and intercept of the least-squares fit (minimum norm when the moments are singular)."""
    g, c = _moments(df, features, dim, {"y": F.col(target).cast("double")})
    return np.linalg.lstsq(g, c[:, 0], rcond=None)[0].tolist()


def fit_one_vs_rest(df: DataFrame, *, features: str = "features", dim: int, label: str = "label", n_classes: int) -> list[list[float]]:
    """One least-squares fit per class from a single pass."""
    ys = {str(k): (F.col(label) == k).cast("double") for k in range(n_classes)}
    g, c = _moments(df, features, dim, ys)
    return np.linalg.lstsq(g, c, rcond=None)[0].T.tolist()


def predict_labels(df: DataFrame, weights: Sequence[Sequence[float]], *, features: str = "features", out: str = "predicted") -> DataFrame:
    """Class with the largest linear score, the first one on ties."""
    def score(w: Sequence[float]) -> Column:
        wcol = F.array(*[F.lit(float(v)) for v in w[:-1]])
        prods = F.zip_with(F.col(features), wcol, lambda a, b: a.cast("double") * b)
        return F.aggregate(prods, F.lit(float(w[-1])), lambda a, v: a + v)

    scores = F.array(*[score(w) for w in weights])
    return df.withColumn("_s", scores).withColumn(
        out, (F.array_position("_s", F.array_max("_s")) - 1).cast("int")).drop("_s")


def accuracy(df: DataFrame, *, keys: Sequence[str] = (), label: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def holdout_sample(df: DataFrame, n_train: int, n_hold: int, *, key: str, seed: int = 7) -> DataFrame:
    """Two independent seeded samples of at most the given sizes, marked in `part`.

    The caps define the samples; `orderBy().limit()` keeps only that many rows per task."""
    def take(n: int, salt: int, name: str) -> DataFrame:
        h = F.xxhash64(F.col(key), F.lit(seed), F.lit(salt))
        return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h").withColumn("part", F.lit(name))

    return take(n_train, 0, "train").unionByName(take(n_hold, 1, "hold"))


# --- calibration -----------------------------------------------------------------------------------

def fit_mounts(mounts: DataFrame, *, key: str = "profile_id", n_pitch: int = 33, n_height: int = 19) -> DataFrame:
    """Pitch and height that best explain the measured marker rows of each mount.

    The grid is generated inside the row, so a fleet of mounts is fitted without a join. A mount is few bytes and
    hundreds of trials, so the rows of a small file are dealt over all tasks first; a pitch is turned into a rotation
    once, not once per height. Fewer than two markers keep the profile; a candidate that cannot see a marker is dropped.
    """
    spark = mounts.sparkSession
    mounts = mounts.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    markers = F.array_compact(F.array(*[
        F.when(F.col(f"known_distance_{d}m_px").isNotNull(), F.struct(F.lit(float(d)).alias("d"), F.col(f"known_distance_{d}m_px").alias("v")))
        for d in (5, 10, 20)]))
    p0, h0 = F.col("pitch_deg"), F.col("camera_height_m")
    low = F.greatest(F.lit(0.55), h0 - 0.45)
    grid = F.sequence(F.lit(0), F.lit(n_pitch * n_height - 1))

    def turn(k: Column) -> Column:
        pitch = p0 - 8.0 + k * (16.0 / (n_pitch - 1))
        return F.struct(pitch.alias("pitch"), camera.rotation(pitch, F.col("roll_deg"), camera.heading(mounts)).alias("rot"))

    def candidate(i: Column) -> Column:
        height = low + (i % n_height) * ((h0 + 0.45 - low) / (n_height - 1))
        at = F.get(F.col("_turns"), F.floor(i / n_height).cast("int"))
        return F.struct(i.alias("i"), at["pitch"].alias("pitch"), height.alias("height"), at["rot"].alias("rot"))

    def trial(t: Column) -> Column:
        m = {**camera.mount_columns(t["rot"]), "camera_height_m": t["height"]}

        def err(k: Column) -> Column:
            _, v = camera.project(F.lit(0.0), k["d"], m)
            return (v - k["v"]) * (v - k["v"])

        total = F.aggregate(F.transform(F.col("_mk"), err), F.lit(0.0), lambda a, e: a + e)
        return F.struct(F.coalesce(total, F.lit(float("inf"))).alias("err"), t["i"].alias("i"), t["pitch"].alias("pitch"), t["height"].alias("height"))

    turns = F.when(F.size("_mk") >= 2, F.transform(F.sequence(F.lit(0), F.lit(n_pitch - 1)), turn))
    out = mounts.withColumn("_mk", markers).withColumn("_turns", turns).withColumn(
        "_best", F.when(F.size("_mk") >= 2, F.array_min(F.transform(F.transform(grid, candidate), trial))))
    fitted = F.col("_best").isNotNull()
    found = fitted & (F.col("_best.err") < float("inf"))
    return out.select(
        *[c for c in mounts.columns if c not in ("pitch_deg", "camera_height_m", "valid")],
        F.when(found, F.col("_best.pitch")).otherwise(p0).alias("pitch_deg"),
        F.when(found, F.col("_best.height")).otherwise(h0).alias("camera_height_m"),
        F.when(fitted, F.lit(True)).otherwise(F.col("valid")).alias("valid"), fitted.alias("fitted"))


def roundtrip_error(mounts: DataFrame, *, key: str = "profile_id", n: int = 5) -> DataFrame:
    """Largest pixel error of ground → pixel → ground → pixel on an n×n grid per mount; 999 when nothing projects."""
    grid = F.sequence(F.lit(0), F.lit(n * n - 1))
    m = camera.mount_columns()

    def pixel(g: Column) -> Column:
        u, v = camera.project(g["x"], g["y"], m)
        return F.when(u.isNotNull(), F.struct(u.alias("u"), v.alias("v")))

    def place(i: Column) -> Column:
        return F.struct((F.lit(-1.6) + F.floor(i / n) * (3.2 / (n - 1))).alias("x"), (F.lit(5.0) + (i % n) * (23.0 / (n - 1))).alias("y"))

    # each step is a list of its own, so no expression contains another one several times
    first = F.transform(F.transform(grid, place), pixel)
    df = camera.with_rotation(mounts).withColumn("_first", first)
    df = df.withColumn("_ground", F.transform("_first", lambda p: camera.ground_point(p["u"], p["v"], m)))
    df = df.withColumn("_again", F.transform("_ground", pixel))
    errs = F.zip_with("_first", "_again", lambda a, b: F.hypot(a["u"] - b["u"], a["v"] - b["v"]))
    return df.select(key, F.coalesce(F.array_max(errs), F.lit(999.0)).alias("max_error_px"))
