"""Joins in image space and detection post-processing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridelens.config import TrackingConfig
from ridelens.functions import shapes
from ridelens.functions import vocab as V
from ridelens.plans.fold import ordered_pick
from ridelens.plans.grid import near_join, overlap_join, point_in_box_join

BOX = ("x0", "y0", "x1", "y1")


def box_columns(df: DataFrame, poly: str = "polygon") -> DataFrame:
    """Adds x0, y0, x1, y1 of a polygon column."""
    box = shapes.bbox(F.col(poly))
    out = df.withColumn("_box", box)
    for i, n in enumerate(BOX):
        out = out.withColumn(n, F.col("_box")[i])
    return out.drop("_box")


def match_gt(gt: DataFrame, tracks: DataFrame, *, keys: Sequence[str] = ("frame",), gt_xy: tuple[str, str] = ("cx", "cy"),
             track_xy: tuple[str, str] = ("tx", "ty"), order: Sequence[str] = ("seq",),
             gt_cols: Sequence[str] = ("id",), track_cols: Sequence[str] = ("track_id",), max_px: float = 140.0) -> DataFrame:
    """Nearest track of each ground-truth object in its frame, none beyond `max_px`, first one on ties."""
    pairs = near_join(gt, tracks, keys, (F.col(gt_xy[0]), F.col(gt_xy[1])),
                      (F.col(track_xy[0]), F.col(track_xy[1])), max_px)
    group = list(dict.fromkeys([*keys, *gt_cols]))
    best = pairs.groupBy(*group).agg(F.min(F.struct(
        F.col("_d2"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)],
        *[F.col(c) for c in track_cols])).alias("_m"))
    return best.select(*group, *[F.col(f"_m.{c}").alias(c) for c in track_cols],
                       F.sqrt("_m._d2").alias("distance_px"))


def gate_observations(obs: DataFrame, masks: DataFrame, *, keys: Sequence[str] = ("frame",), road: str = "road_polygon",
                      occluded: str = "occluded_polygons") -> DataFrame:
    """Drop detections whose box centre is occluded or off the road; no road polygon gates nothing.

    `masks` has one row per frame. Boxes are columns x0, y0, x1, y1.
    """
    def framed(p: Column) -> Column:
        return F.struct(p.alias("p"), shapes.bbox(p).alias("b"))

    def covers(o: Column) -> Column:
        # the box test settles most points before the exact one
        x, y, b = F.col("_cx"), F.col("_cy"), o["b"]
        return (x >= b[0]) & (x <= b[2]) & (y >= b[1]) & (y <= b[3]) & shapes.contains(o["p"], x, y)

    # boxes of the polygons are computed once per frame, on the small side
    dim = masks.select(*keys, F.when(F.size(road) >= 3, framed(F.col(road))).alias("_road"),
                       F.when(F.size(occluded) > 0, F.transform(occluded, framed)).alias("_occ"))
    cx, cy = (F.col("x0") + F.col("x1")) * 0.5, (F.col("y0") + F.col("y1")) * 0.5
    joined = obs.join(dim, list(keys), "left").withColumn("_cx", cx).withColumn("_cy", cy)
    hidden = F.coalesce(F.exists("_occ", covers), F.lit(False))
    on_road = F.col("_road").isNull() | covers(F.col("_road"))
    return joined.where(~hidden & on_road).select(*obs.columns)


def hit_test(points: DataFrame, tracks: DataFrame, *, keys: Sequence[str] = ("frame",), point_id: Sequence[str] = ("point_id",),
             xy: tuple[str, str] = ("x", "y"), poly: str = "polygon", order: Sequence[str] = ("seq",),
             track_cols: Sequence[str] = ("track_id",)) -> DataFrame:
    """Track whose polygon contains the point, smallest box first (box area at least 1), then log order."""
    boxed = box_columns(tracks.where(F.size(poly) >= 3), poly)
    cand = point_in_box_join(points, boxed, keys, (F.col(xy[0]), F.col(xy[1])), tuple(F.col(c) for c in BOX))
    hits = cand.where(shapes.contains(F.col(poly), F.col(xy[0]), F.col(xy[1])))
    size = F.greatest(F.lit(1.0), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    group = list(dict.fromkeys([*keys, *point_id]))
    best = hits.groupBy(*group).agg(F.min(F.struct(
        size.alias("a"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)],
        *[F.col(c) for c in track_cols])).alias("_m"))
    return best.select(*group, *[F.col(f"_m.{c}").alias(c) for c in track_cols], F.col("_m.a").alias("box_area"))


def mask_visibility(obs: DataFrame, tiles: DataFrame, *, keys: Sequence[str] = ("frame",), obs_id: Sequence[str] = ("seq", "price"),
                    sharpness: str = "sharpness", motion_blur: str = "motion_blur") -> DataFrame:
    """Mean score of the quality tiles under each box; sharpness·(1−motion blur) where none overlaps.

    Tiles outnumber the boxes by far, so they are neither copied per grid cell nor sorted: the boxes of a partition
    are hashed by frame and its tiles stream past them. Tiles that are partitioned by `keys` are not shuffled.
    """
    keys, obs_id = list(keys), list(obs_id)
    t = tiles.select(*keys, *[F.col(c).alias(f"t{c}") for c in BOX], F.col("score").alias("_score"))
    slim = obs.select(*keys, *obs_id, *BOX).dropna(subset=list(BOX))
    inner = (F.least("x1", "tx1") > F.greatest("x0", "tx0")) & (F.least("y1", "ty1") > F.greatest("y0", "ty0"))
    pairs = t.dropna(subset=[f"t{c}" for c in BOX]).join(slim.hint("shuffle_hash"), keys)
    means = pairs.where(inner).groupBy(*keys, *obs_id).agg(F.avg("_score").alias("_m"))
    fallback = F.col(sharpness) * (1.0 - F.col(motion_blur))
    return obs.join(means, [*keys, *obs_id], "left").withColumn(
        "mask_visibility", F.coalesce("_m", fallback)).drop("_m")


def associate_candidates(tracks: DataFrame, obs: DataFrame, *, keys: Sequence[str] = ("frame",),
                         cfg: TrackingConfig = TrackingConfig()) -> DataFrame:
    """Scored track-observation pairs that overlap enough or are close enough.

    `tracks`: keys, track_id, semantic, mean_x, mean_y and a box (tx0..ty1);
    `obs`: keys, obs_index, semantic_type, contact_x, contact_y and a box (x0..y1).
    """
    r = cfg.center_match_px
    grow = lambda lo, hi, m: (F.least(F.col(lo), F.col(m) - r), F.greatest(F.col(hi), F.col(m) + r))
    tx0, tx1 = grow("tx0", "tx1", "mean_x")
    ty0, ty1 = grow("ty0", "ty1", "mean_y")
    ox0, ox1 = F.least("x0", "contact_x"), F.greatest("x1", "contact_x")
    oy0, oy1 = F.least("y0", "contact_y"), F.greatest("y1", "contact_y")
    pairs = overlap_join(tracks, obs, keys, (tx0, ty0, tx1, ty1), (ox0, oy0, ox1, oy1))
    iou = shapes.iou([F.col(f"t{c}") for c in BOX], [F.col(c) for c in BOX])
    dist = F.hypot(F.col("contact_x") - F.col("mean_x"), F.col("contact_y") - F.col("mean_y"))
    same = (F.col("semantic_type") == F.col("semantic")) | (F.col("semantic_type") == "unknown_anomaly")
    scored = pairs.withColumn("iou", iou).withColumn("dist", dist).where(
        (F.col("iou") >= cfg.iou_match) | (F.col("dist") < r))
    return scored.withColumn("score", F.col("iou") * F.when(same, 1.2).otherwise(0.7) - F.col("dist") / 400.0)


# --- non-maximum suppression -----------------------------------------------------------------

def _clash(a: np.ndarray, b: np.ndarray, threshold: float, plus_one: bool) -> np.ndarray:
    """Do boxes of `a` suppress-overlap those of `b`? The last axis holds a box, the others are broadcast."""
    one = 1.0 if plus_one else 0.0
    wide = np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0]) + one
    high = np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1]) + one
    inter = np.clip(wide, 0, None) * np.clip(high, 0, None)
    size_a, size_b = ((np.clip(v[..., 2] - v[..., 0], 0, None) + one) * (np.clip(v[..., 3] - v[..., 1], 0, None) + one) for v in (a, b))
    union = size_a + size_b - inter
    if plus_one:
        return inter / (union + 1e-9) > threshold
    return (inter > 0) & (inter / np.where(union > 0, union, 1.0) >= threshold)


def _greedy(boxes: np.ndarray, open_: np.ndarray, sizes: np.ndarray, threshold: float, plus_one: bool) -> np.ndarray:
    """Which boxes stay of groups of `sizes` that follow each other, best box first; boxes that are not `open_` neither stay nor suppress.

    All pairs within the groups are compared in one go. A box's fate is known once the pairs of all better ones are
    through, so the clashing pairs are walked in the order of their first box."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    after = ends - 1 - np.arange(len(boxes))
    first = np.repeat(np.arange(len(boxes)), after)
    second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(after) - after, after)
    x0, y0, x1, y1 = np.ascontiguousarray(boxes.T)
    one = 1.0 if plus_one else 0.0
    some = np.flatnonzero((x0[second] - x1[first] <= one) & (x0[first] - x1[second] <= one))
    first, second = first[some], second[some]
    some = np.flatnonzero((y0[second] - y1[first] <= one) & (y0[first] - y1[second] <= one))
    first, second = first[some], second[some]
    hit = _clash(boxes[first], boxes[second], threshold, plus_one)
    stay = open_.tolist()
    for i, j in zip(first[hit].tolist(), second[hit].tolist()):
        if stay[i]:
            stay[j] = False
    return np.array(stay, dtype=bool)


def nms(dets: DataFrame, *, keys: Sequence[str] = ("image",), conf: str = "conf", tie: Sequence[str] = ("seq", "price"),
        iou_threshold: float = 0.50, plus_one: bool = False, cap: int | None = None, block: int = 256) -> DataFrame:
    """Greedy class-agnostic suppression per frame, best confidence first, rows without a confidence last.

    Frames are dealt over the tasks and sorted by Spark; a task streams the boxes of a frame and holds only
    those it keeps, which cannot overlap much and so are bounded by the frame's area. Rows that equal each other
    in confidence and `tie` are decided by their box. `cap` keeps the best so many of a frame.
    """
    keys = list(keys)
    ranked = dets.select("*", F.coalesce(-F.col(conf).cast("double"), F.lit(float("inf"))).alias("_neg"),
                         F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in BOX]).alias("_box"))


    def pick(states: list[dict], sizes: list[int], rows: pa.RecordBatch) -> np.ndarray:
        every = rows.column("_box").flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
        stay = np.zeros(len(every), dtype=bool)
        # whole frames of up to `block` boxes go together, longer or split ones block by block
        at, together, held = 0, [], 0
        jobs: list[list[tuple[int, int, dict]]] = []
        for state, n in zip(states, sizes):
            for lo in range(at, at + n, block):
                m = min(block, at + n - lo)
                if len(state["kept"]) or lo > at or n > block:
                    jobs.append([(lo, m, state)])
                else:
                    together.append((lo, m, state))
                    held += m * m
                    if held > 2_000_000:
                        jobs.append(together)
                        together, held = [], 0
            at += n
        for job in [together, *jobs]:
            if not job:
                continue
            where = np.concatenate([np.arange(lo, lo + m) for lo, m, _ in job])
            boxes, kept = every[where], job[0][2]["kept"]
            if cap is not None and len(kept) >= cap:
                continue
            open_ = ~_clash(kept[:, None], boxes[None], iou_threshold, plus_one).any(axis=0) if len(kept) else np.ones(len(boxes), dtype=bool)
            stay[where] = _greedy(boxes, open_, np.array([m for _, m, _ in job]), iou_threshold, plus_one)
            for lo, m, state in job:
                if cap is not None:
                    over = lo + np.flatnonzero(stay[lo:lo + m])[cap - len(state["kept"]):]
                    stay[over] = False
                state["kept"] = np.vstack([state["kept"], every[lo:lo + m][stay[lo:lo + m]]])
        return np.flatnonzero(stay)

    return ordered_pick(ranked, keys, ["_neg", *tie, "_box"], lambda: {"kept": np.zeros((0, 4))}, pick, dets.columns)


def decode_detections(preds: DataFrame, names: Sequence[str], *, box: Sequence[str] = ("xc", "yc", "w", "h"),
                      scores: str = "scores", objectness: str | None = None, conf_threshold: float = 0.08,
                      image_size: int = 640, width: str = "width", height: str = "height",
                      clip_to_edge: bool = False) -> DataFrame:
    """Raw prediction rows to named boxes in source pixels.

    Best class by first maximum; rows below the confidence threshold, or whose class name is blank,
    are dropped. With `objectness` the class scores are multiplied by it and must exceed the threshold.
    """
    names_col = F.array(*[F.lit(n) for n in names])
    sc = F.col(scores)
    if objectness is not None:
        sc = F.transform(sc, lambda s: s * F.col(objectness))
    df = preds.withColumn("_sc", sc).withColumn("conf", F.array_max("_sc")).withColumn(
        "class_id", (F.array_position("_sc", F.array_max("_sc")) - 1).cast("int"))
    if objectness is not None:
        df = df.where((F.col(objectness) > conf_threshold) & (F.col("conf") > conf_threshold))
    else:
        df = df.where(F.col("conf") >= conf_threshold)
    df = df.where(F.col("class_id") < len(names)).withColumn("name", names_col[F.col("class_id")]).where(
        F.trim("name") != "")
    xc, yc, bw, bh = (F.col(c) for c in box)
    w = F.greatest(F.col(width), F.lit(1))
    h = F.greatest(F.col(height), F.lit(1))
    gain = F.least(F.lit(float(image_size)) / h, F.lit(float(image_size)) / w)
    if clip_to_edge:  # padding kept fractional, boxes clipped to the frame edge
        px, py = (F.lit(float(image_size)) - w * gain) / 2.0, (F.lit(float(image_size)) - h * gain) / 2.0
        top_x, top_y, low = w, h, F.lit(0.0)
    else:
        px = (F.lit(float(image_size)) - F.rint(w * gain)) / 2.0
        py = (F.lit(float(image_size)) - F.rint(h * gain)) / 2.0
        top_x, top_y, low = w - 1, h - 1, F.lit(1.0)

    def clip(v: Column, lo: Column, hi: Column) -> Column:
        return F.least(F.greatest(v, lo), hi.cast("double"))

    zero = F.lit(0.0)
    return df.withColumn("x0", clip((xc - bw * 0.5 - px) / gain, zero, top_x)).withColumn(
        "y0", clip((yc - bh * 0.5 - py) / gain, zero, top_y)).withColumn(
        "x1", clip((xc + bw * 0.5 - px) / gain, low, w)).withColumn(
        "y1", clip((yc + bh * 0.5 - py) / gain, low, h)).drop("_sc")


def filter_hazard_boxes(dets: DataFrame, *, cls: str = "detector_class", width: float = 1920.0, height: float = 1080.0) -> DataFrame:
    """Size, place and shape rules a hazard box must meet."""
    bw = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0"))
    bh = F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))
    cx, cy = (F.col("x0") + F.col("x1")) * 0.5, (F.col("y0") + F.col("y1")) * 0.5
    frac = bw * bh / F.lit(max(1.0, width * height))
    aspect = bw / F.greatest(bh, F.lit(1.0))
    placed = (bw >= 12) & (bh >= 8) & (cy >= 0.16 * height) & (cx >= 0.08 * width) & (cx <= 0.92 * width) & (
        frac <= 0.20) & (bw <= 0.88 * width)
    shape = (F.when(F.col(cls) == "pothole", (frac >= 0.00035) & (frac <= 0.12) & (aspect < 3.5))
             .when(F.col(cls) == "speed_bump", (frac >= 0.0008) & (frac <= 0.12) & ((bw >= 0.10 * width) | (aspect >= 1.6)))
             .when(F.col(cls) == "manhole_cover", (frac >= 0.00035) & (frac <= 0.08) & (aspect >= 0.35) & (aspect <= 4.2))
             .otherwise(False))
    return dets.where(placed & shape)


def filter_vehicle_boxes(dets: DataFrame, *, cls: str = "class_id", width: float = 1920.0, height: float = 1080.0) -> DataFrame:
    """Plausible vehicle boxes: no specks, no edge strips, known or out-of-table classes."""
    bw = F.greatest(F.lit(1.0), F.col("x1") - F.col("x0"))
    bh = F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    size, aspect = bw * bh, bw / bh
    strip = (bw < 0.14 * width) & (bh > 0.35 * height)
    c = F.col(cls).cast("int")
    ok = ((size >= 0.0010 * width * height) & (size <= 0.22 * width * height) & (F.col("y1") >= 0.22 * height)
          & (aspect <= 4.2) & (aspect >= 0.28)
          & ~((F.col("x0") < 0.03 * width) & strip) & ~((F.col("x1") > 0.97 * width) & strip)
          & ~((bh < 0.025 * height) & (bw < 0.035 * width))
          & ~(c.between(0, 20) & ~c.isin(V.VEHICLE_CLASS_IDS)))
    return dets.where(ok)


# --- merging detector outputs -----------------------------------------------------------------

def merge_sidecar(primary: DataFrame, sidecar: DataFrame, primary_masks: DataFrame, sidecar_masks: DataFrame, *,
                  key: str = "frame", order: Sequence[str] = ("seq", "price"), score: float | None = None,
                  iou_threshold: float = 0.30) -> DataFrame:
    """Primary detections plus the sidecar ones that overlap nothing accepted so far, gated by road and occlusion.

    A frame whose sidecar has no road, no occlusion and no detection keeps the primary ungated.
    Extra boxes are accepted in order against the primary boxes and the extras already taken, which
    is suppression of the extras after removing those that touch a primary box.
    """
    cols = primary.columns
    prev = F.coalesce("calibrated_confidence", "model_confidence").cast("double")
    p_box = primary.select(key, *[F.col(c).alias(f"p{c}") for c in BOX])
    # cells as wide as the larger boxes or so: most boxes lie in one, and a crowded frame is still split by place
    pairs = overlap_join(sidecar, p_box, [key], tuple(F.col(c) for c in BOX), tuple(F.col(f"p{c}") for c in BOX), size=320.0)
    hit = pairs.where(shapes.iou([F.col(f"p{c}") for c in BOX], [F.col(c) for c in BOX]) >= iou_threshold).select(
        key, *order).distinct()
    free = sidecar.join(hit, [key, *order], "left_anti").withColumn("_same", F.lit(0.0))
    extras = nms(free, keys=[key], conf="_same", tie=order, iou_threshold=iou_threshold).drop("_same")

    pm = primary_masks.select(key, F.col("road_polygon").alias("_pr"), F.col("occluded_polygons").alias("_po"))
    sm = sidecar_masks.select(key, F.col("road_polygon").alias("_sr"), F.col("occluded_polygons").alias("_so"))
    has_det = sidecar.select(key).distinct().withColumn("_sd", F.lit(True))
    masks = pm.join(sm, key, "full").join(has_det, key, "full")
    road_ok = F.coalesce(F.size("_sr") >= 3, F.lit(False))
    occ_ok = F.coalesce(F.size("_so") > 0, F.lit(False))
    live = road_ok | occ_ok | F.coalesce("_sd", F.lit(False))
    merged_masks = masks.select(
        key, live.alias("_live"),
        F.when(live, F.when(road_ok, F.col("_sr")).otherwise(F.col("_pr"))).alias("road_polygon"),
        F.when(live, F.when(occ_ok, F.col("_so")).otherwise(F.col("_po"))).alias("occluded_polygons"))
    masks_live = merged_masks.where("_live")
    # frames that are not live have no mask here, so the gate leaves their rows alone
    base = primary.join(masks_live.select(key, "_live").distinct(), key, "left")
    if score is not None:
        blend = F.least(F.greatest(prev * 0.55 + F.lit(0.45 * score), F.lit(0.0)), F.lit(1.0))
        base = base.withColumn("calibrated_confidence", F.when(F.col("_live"), blend).otherwise(F.col("calibrated_confidence")))
    merged = base.select(*cols).unionByName(extras.select(*cols), allowMissingColumns=False)
    return gate_observations(merged, masks_live.drop("_live"), keys=[key])


def merge_bump(primary: DataFrame, bump: DataFrame, masks: DataFrame, *, key: str = "frame",
               inferred: DataFrame | None = None) -> DataFrame:
    """The bump model owns pothole, cover and hump classes: primary ones go, its boxes come in unless occluded."""
    owned = primary.where(~F.col("semantic_type").isin(V.BUMP_SEMANTICS))
    gated = gate_observations(bump, masks.select(
        key, F.lit(None).cast("array<array<double>>").alias("road_polygon"), "occluded_polygons"), keys=[key])
    if inferred is not None:
        # frames where the bump model did not run keep their primary detections
        idle = primary.join(inferred.select(key).distinct(), key, "left_anti")
        owned = owned.join(inferred.select(key).distinct(), key, "left_semi").unionByName(idle)
    return owned.unionByName(gated.select(*owned.columns))
