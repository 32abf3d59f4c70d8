"""Label maps, splits, annotation tasks and detector exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridelens.functions import vocab as V
from ridelens.functions.numbers import round_exact
from ridelens.operators.spatial import filter_hazard_boxes, nms
from ridelens.plans.ordered import with_rank


# --- label vocabularies --------------------------------------------------------------------------

def severity_alias(raw: Column) -> Column:
    return V.lookup(V.SEVERITY_ALIASES, V.class_key(raw), -1)


def severity_code(code: Column) -> Column:
    return F.when(code.between(0, 3), code).otherwise(F.lit(-1)).cast("int")


def geometry_alias(raw: Column) -> Column:
    return V.lookup(V.GEOMETRY_ALIASES, V.class_key(raw), "unknown")


def map_geometry_severity(df: DataFrame, *, geometry: str = "geometry_raw", severity: str = "severity_raw") -> DataFrame:
    """Alias tables for geometry and severity text; integers outside 0..3 and unknown words stay unknown."""
    kind = dict(df.dtypes)[severity]
    sev = severity_code(F.col(severity)) if kind in ("int", "bigint", "smallint") else severity_alias(F.col(severity))
    return df.withColumn("geometry_type", geometry_alias(F.col(geometry))).withColumn("severity", F.coalesce(sev, F.lit(-1)))


def map_public_labels(df: DataFrame, *, raw: str = "raw", severity: str = "severity_raw", source: str = "source") -> DataFrame:
    """Public class name to attributes. The vocabulary is a fixed map of a few dozen names, so the lookup
    is a projection. A given severity wins over the group default; unknown names stay unknown."""
    fields = ("semantic_type", "geometry_type", "state", "default_severity", "alert", "note")

    def cell(g: Sequence) -> Column:
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, g)])

    entries = [x for names, *g in V.PUBLIC_LABEL_GROUPS for n in names for x in (F.lit(n), cell(g))]
    got = F.coalesce(F.create_map(*entries)[V.class_key(F.col(raw))], cell(V.UNMAPPED_LABEL))
    kind = dict(df.dtypes)[severity]
    given = severity_code(F.col(severity)) if kind in ("int", "bigint", "smallint") else severity_alias(F.col(severity))
    given = F.coalesce(given, F.lit(-1))
    out = df.withColumn("_g", got).withColumn("_given", given)
    src = V.class_key(F.col(source))
    return out.select(
        *[c for c in df.columns if c not in (source,)],
        F.when(F.coalesce(src, F.lit("")) == "", "unknown").otherwise(src).alias("source"),
        F.col("_g.semantic_type").alias("semantic_type"), F.col("_g.geometry_type").alias("geometry_type"),
        F.col("_g.state").alias("state"),
        F.when(F.col("_given") != -1, F.col("_given")).otherwise(F.col("_g.default_severity")).cast("int").alias("severity"),
        (F.col("_g.alert") & (F.col("_g.state") == "abnormal")).alias("alert_eligible"), F.col("_g.note").alias("note"))


def detector_class(raw: Column) -> Column:
    return V.lookup({**{c: c for c in V.DETECTOR_CLASSES}, **V.PROMPT_CLASSES}, V.class_key(raw))


def map_detection_names(df: DataFrame, *, name: str = "name") -> DataFrame:
    """Detector prompt to class and attributes; covers are flat unless the prompt says sunken."""
    kind = detector_class(F.col(name))
    sunken = F.coalesce(V.class_key(F.col(name)).isin(V.SUNKEN_PROMPTS), F.lit(False))
    out = df.withColumn("detector_class", kind).withColumn("sunken", sunken)
    k, s = F.col("detector_class"), F.col("sunken")
    cover = k == "manhole_cover"
    return (out.withColumn("semantic_type", F.coalesce(k, F.lit("unknown_anomaly")))
            .withColumn("geometry_type", F.when((k == "pothole") | (cover & s), "concave").when(k == "speed_bump", "convex")
                        .when(cover, "flat").otherwise("unknown"))
            .withColumn("state", F.when(k.isin("pothole", "speed_bump") | (cover & s), "abnormal").when(cover, "normal").otherwise("unknown"))
            .withColumn("severity", F.when((k == "pothole") | (cover & s), 3).when(k == "speed_bump", 2).when(cover, 0).otherwise(-1)))


def clip_hint(name: Column) -> Column:
    """Class suggested by a clip's file name."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    stem = F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    low = F.translate(F.lower(stem), "- ", "__")
    out = None
    for words, cls in V.CLIP_HINT_GROUPS:
        hit = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
        out = F.when(hit, cls) if out is None else out.when(hit, cls)
    return out


# --- splits ----------------------------------------------------------------------------------------

def split_sessions(ids: DataFrame, *, key: str = "session_id", seed: int = 7, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """Whole sessions into train, val and test: int() sizes, the remainder to test, seeded hash order.

    Positions come from chunked ranks over the hash, so even very many sessions are not sorted in one task.
    """
    distinct = ids.select(key).distinct().withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    distinct = distinct.withColumn("_all", F.lit(0))
    n = distinct.groupBy("_all").agg(F.count(F.lit(1)).alias("_n"))
    ranked = with_rank(distinct, ["_all"], ["_h", key], name="_r", chunk=2.0**52)
    cut1 = F.floor(F.col("_n") * F.lit(ratios[0]))
    cut2 = cut1 + F.floor(F.col("_n") * F.lit(ratios[1]))
    return ranked.join(F.broadcast(n), "_all").select(
        key, F.when(F.col("_r") < cut1, "train").when(F.col("_r") < cut2, "val").otherwise("test").alias("split"))


def clip_split(ids: DataFrame, *, key: str = "clip", seed: int = 7) -> DataFrame:
    """Clips into splits with the small cases: one clip is both train and val, two are one each, three are two and one.

    From four clips on as `split_sessions`; an empty val takes the last train clip."""
    base = split_sessions(ids, key=key, seed=seed).withColumn("_all", F.lit(0)).withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    # one row: the number of clips, the last train clip, and the largest key
    one = base.groupBy("_all").agg(
        F.count(F.lit(1)).alias("_n"), F.max_by(F.col(key), F.when(F.col("split") == "train", F.struct("_h", key))).alias("_last"), F.max(key).alias("_top"))
    n, mine = F.col("_n"), F.col(key)
    few = F.array(F.when(mine == F.col("_top"), "val").otherwise("train"))
    many = F.array(F.when((F.floor(n * F.lit(0.15)) == 0) & (mine == F.col("_last")), "val").otherwise(F.col("split")))
    sides = F.when(n == 1, F.array(F.lit("train"), F.lit("val"))).when(n <= 3, few).otherwise(many)
    return base.join(F.broadcast(one), "_all").select(key, F.explode(sides).alias("split"))


def leakage_check(assigned: DataFrame, *, key: str = "session_id", split: str = "split") -> DataFrame:
    """Sessions found in more than one split."""
    return assigned.groupBy(key).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def materialize_split(index: DataFrame, labels: DataFrame, splits: DataFrame, *, clip: str = "clip", image: str = "image",
                      names: Sequence[str] = ("train", "val")) -> DataFrame:
    """Images of the clips in each split with their label text (empty when there is none)."""
    picked = index.join(splits.where(F.col("split").isin(list(names))), clip)
    return picked.join(labels, image, "left").withColumn("label_text", F.coalesce("label_text", F.lit("")))


def split_counts(materialized: DataFrame) -> DataFrame:
    return materialized.groupBy("split").agg(F.count(F.lit(1)).alias("n_images"))


def dataset_index_summary(index: DataFrame, splits: DataFrame, dets: DataFrame, *, clip: str = "clip", image: str = "image") -> DataFrame:
    """Clip and frame totals, split sizes, frames with and without detections."""
    pos = dets.select(image).distinct().withColumn("_p", F.lit(1))
    per = index.join(pos, image, "left").agg(
        F.count(F.lit(1)).alias("n_frames"), F.count("_p").alias("n_positive_frames"))
    clips = index.select(clip).distinct()
    s = clips.join(splits, clip, "left").agg(
        F.count_distinct(clip).alias("n_clips"),
        *[F.count_if(F.col("split") == n).alias(f"n_{n}") for n in ("train", "val", "test")])
    return per.withColumn("_j", F.lit(1)).join(s.withColumn("_j", F.lit(1)), "_j").drop("_j").withColumn(
        "n_empty_frames", F.col("n_frames") - F.col("n_positive_frames"))


# --- annotation --------------------------------------------------------------------------------------

REQUIRED_ANNOTATION_FIELDS = ["semantic_type", "geometry_type", "state", "severity", "visibility", "track_id"]


def export_annotation_tasks(tracks: DataFrame, *, frame: str = "source_frame_id") -> DataFrame:
    """Track rows as annotation items, with the prediction embedded as JSON."""
    st = F.col("object_state") if "object_state" in tracks.columns else F.lit(None).cast("string")
    alt = F.col("state") if "state" in tracks.columns else F.lit(None).cast("string")
    poly = F.col("polygon") if "polygon" in tracks.columns else F.lit(None).cast("array<array<double>>")
    return tracks.select(
        "session_id", F.col(frame).alias("frame_id"), "timestamp_ns", "track_id", "semantic_type", "geometry_type",
        F.when(F.coalesce(st, F.lit("")) != "", st).otherwise(alt).alias("state"), "severity", F.lit("clear").alias("visibility"),
        poly.alias("polygon"), F.to_json(F.struct(*tracks.columns)).alias("model_prediction"),
        F.lit(None).cast("map<string,string>").alias("human_revision"), F.lit(False).alias("review"))


def apply_revisions(tasks: DataFrame, patches: DataFrame, *, keys: Sequence[str] = ("track_id", "frame_id"), seq: str = "seq") -> DataFrame:
    """Merge human patches per (track, frame); `patches` rows are keys, seq, `key`, `value`; the later one wins, and one without a key is left out."""
    latest = patches.where("key is not null").groupBy(*keys, "key").agg(F.max(F.struct(seq, "value")).alias("_v"))
    packed = latest.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.col("_v.value").alias("value"))))).alias("_patch"))
    out = tasks.join(packed, list(keys), "left")
    old = F.coalesce(F.col("human_revision"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key("_patch", k)), F.col("_patch"))
    return out.withColumn("human_revision", F.when(F.col("_patch").isNotNull(), merged).otherwise(F.col("human_revision"))).drop("_patch")


def required_field_check(items: DataFrame) -> DataFrame:
    """Items lacking a required field, with the names of what they lack."""
    have = set(items.columns)
    miss = F.array_compact(F.array(*[
        F.when(F.col(c).isNull(), F.lit(c)) if c in have else F.lit(c) for c in REQUIRED_ANNOTATION_FIELDS]))
    return items.withColumn("missing", miss).where(F.size("missing") > 0)


def _xml(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def export_cvat(tracks: DataFrame, *, key: str = "session_id", order: Sequence[str] = ("timestamp_ns", "seq", "price"), poly: str = "polygon",
                frame: str = "source_frame_id") -> DataFrame:
    """CVAT 1.1 lines of each session as rows (track, line number, text), ready for a sorted text writer.

    A session's document is never held in one cell: `write_cvat` sorts and writes the lines.
    """
    order = list(order)
    tid = F.coalesce(F.col("track_id"), F.lit(0)).cast("long")
    base = tracks.withColumn("_tid", tid)
    head = base.groupBy(key, "_tid").agg(F.min(F.struct(*order, F.coalesce("semantic_type", F.lit("unknown_anomaly")).alias("label"))).alias("_f"))
    heads = head.select(key, "_tid", F.lit(0).alias("_part"), *[F.col(f"_f.{o}").alias(o) for o in order],
                        F.concat(F.lit('  <track id="'), F.col("_tid").cast("string"), F.lit('" label="'), _xml(F.col("_f.label")), F.lit('">')).alias("line"))
    tails = head.select(key, "_tid", F.lit(2).alias("_part"), *[F.col(f"_f.{o}").alias(o) for o in order], F.lit("  </track>").alias("line"))
    pts = F.array_join(F.transform(F.col(poly), lambda p: F.format_string("%.1f,%.1f", round_exact(p[0], 1), round_exact(p[1], 1))), ";")
    body = base.where(F.size(poly) >= 3).select(
        key, "_tid", F.lit(1).alias("_part"), *order,
        F.concat(F.lit('    <polygon frame="'), F.coalesce(F.col(frame), F.lit(0)).cast("string"), F.lit('" points="'), pts,
                 F.lit('" outside="0" occluded="0" />')).alias("line"))
    return heads.unionByName(body).unionByName(tails).withColumnRenamed("_tid", "track_id").withColumnRenamed("_part", "part")


# --- detector labels ------------------------------------------------------------------------------------

def propose_labels(dets: DataFrame, index: DataFrame, *, image: str = "image", bonus: float = 0.05) -> DataFrame:
    """Detections whose class equals the clip's hint gain a little confidence."""
    hints = index.select(image, "hint")
    match = F.coalesce(detector_class(F.col("name")) == F.col("hint"), F.lit(False))
    return dets.join(hints, image).withColumn("conf", F.when(match, F.col("conf") + bonus).otherwise(F.col("conf"))).drop("hint")


def export_yolo_labels(dets: DataFrame, images: DataFrame, *, image: str = "image", width: float = 1920.0, height: float = 1080.0,
                       iou_threshold: float = 0.50, tie: Sequence[str] = ("seq", "price")) -> DataFrame:
    """Label text per image: suppression, class map, box rules, normalised centre and size; empty text when none is left."""
    kept = nms(dets, keys=[image], tie=tie, iou_threshold=iou_threshold)
    named = kept.withColumn("detector_class", detector_class(F.col("name"))).where("detector_class is not null")
    good = filter_hazard_boxes(named, width=width, height=height)
    cls = V.lookup({c: i for i, c in enumerate(V.DETECTOR_CLASSES)}, F.col("detector_class"))

    def unit(v: Column) -> Column:
        return round_exact(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)), 6)

    line = F.format_string("%d %.6f %.6f %.6f %.6f", cls,
                           unit((F.col("x0") + F.col("x1")) * 0.5 / width), unit((F.col("y0") + F.col("y1")) * 0.5 / height),
                           unit((F.col("x1") - F.col("x0")) / width), unit((F.col("y1") - F.col("y0")) / height))
    # boxes kept in one image overlap little, so their number is bounded by the frame area
    text = good.groupBy(image).agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("conf")).alias("c"), *tie, line.alias("line")))).alias("_l"))
    joined = F.concat(F.array_join(F.transform("_l", lambda s: s["line"]), "\n"), F.lit("\n"))
    return images.select(image).distinct().join(text, image, "left").select(
        image, F.when(F.size("_l") > 0, joined).otherwise(F.lit("")).alias("label_text"),
        F.greatest(F.coalesce(F.size("_l"), F.lit(0)), F.lit(0)).alias("n_boxes"))


# --- clips ------------------------------------------------------------------------------------------------

def match_clip_spec(clips: DataFrame, *, duration: str = "duration_s", tolerance_s: float = 1.0) -> DataFrame:
    """Alias, spec name and lighting from the first published clip whose duration fits.

    The specification is a fixed list of two, so the band join is a projection."""
    specs = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(n).alias("spec_name"), F.lit(d).alias("d"), F.lit(light).alias("lighting"))
                      for a, n, d, light in V.SPEC_CLIPS])
    hit = F.get(F.filter(specs, lambda s: F.abs(F.col(duration) - s["d"]) <= tolerance_s), F.lit(0))
    out = clips.withColumn("_s", hit)
    own = F.col("lighting") if "lighting" in clips.columns else F.lit(None).cast("string")
    return (out.withColumn("alias", F.coalesce("_s.alias", F.lit("extra"))).withColumn("spec_name", F.col("_s.spec_name"))
            .withColumn("lighting", F.coalesce("_s.lighting", own)).drop("_s"))


def clip_catalog(clips: DataFrame) -> DataFrame:
    """Duration, lighting and published alias per clip."""
    base = clips.withColumn("duration_s", F.when(F.col("fps") > 0, F.col("frames") / F.col("fps")).otherwise(0.0)).withColumn(
        "lighting", F.when(F.col("mean_luma") < 105, "night").otherwise("day"))
    return match_clip_spec(base).withColumn("duration_s", F.bround("duration_s", 3)).withColumn(
        "fps", F.bround("fps", 3)).withColumn("mean_luma", F.bround("mean_luma", 2))


def content_fingerprint(files: DataFrame) -> DataFrame:
    """Hash of the whole content."""
    return files.withColumn("sha256", F.sha2("content", 256)).drop("content")
