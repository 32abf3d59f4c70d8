"""Writers of session tables, manifests, checksums, reports and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridelens.operators.rows import coarsen_locations, redact_events
from ridelens.plans.packing import next_fit
from ridelens.schemas import LOGS
from ridelens.sources.bundles import file_digests, route_imu

SHARE_NOTE = " | share pack: GPS coarsened, paths and coordinates redacted"


def _as_log(df: DataFrame, kind: str) -> DataFrame:
    """Columns of a log's schema get its types; a value that does not fit stops the write. Other columns stay."""
    types = {f.name: f.dataType for f in StructType.fromDDL(LOGS[kind][1])} if kind in LOGS else {}
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def write_session_tables(tables: dict[str, DataFrame], out: str, *, fmt: str = "parquet", buckets: int = 64) -> None:
    """One dataset per log, partitioned by session; `read_log` reads it back. Rows are spread by (session, time
    hash), so a long ride is written by many tasks instead of one."""
    for name, df in tables.items():
        parts = ["session_id"]
        data = _as_log(df, "gyro" if name == "imu" else name)
        if name == "imu":
            data, parts = route_imu(data), ["session_id", "imu_log"]
        salt = next((c for c in ("timestamp_ns", "sensor_timestamp_ns") if c in data.columns), None)
        if salt:
            data = data.withColumn("_salt", F.pmod(F.floor(F.col(salt) / 60_000_000_000), F.lit(buckets)))
            data = data.repartition("session_id", "_salt").drop("_salt")
        data.write.mode("overwrite").partitionBy(*parts).format(fmt).save(f"{out}/{name}")


def manifest_update(manifests: DataFrame, frames: DataFrame, inventory: DataFrame, *, frame_ts: str = "sensor_timestamp_ns") -> DataFrame:
    """Manifests with the end time and the number of finished video segments filled in."""
    end = frames.groupBy("session_id").agg(F.max(frame_ts).alias("_end"))
    seg = inventory.where(F.col("path").rlike(r"video/segment_\d+\.mp4$")).groupBy("session_id").agg(
        F.count(F.lit(1)).cast("int").alias("_seg"))
    out = manifests.join(end, "session_id", "left").join(seg, "session_id", "left")
    return out.withColumn("end_elapsed_realtime_ns", F.coalesce("_end", "end_elapsed_realtime_ns")).withColumn(
        "video_segments", F.coalesce("_seg", "video_segments")).drop("_end", "_seg")


def write_manifests(manifests: DataFrame, out: str) -> None:
    manifests.write.mode("overwrite").partitionBy("session_id").json(out)


def checksum_lines(inventory: DataFrame) -> DataFrame:
    return inventory.select("session_id", "path", F.concat_ws("  ", "sha256", "path").alias("line"))


def write_checksum_manifest(inventory: DataFrame, out: str) -> None:
    """`sha  path` lines per session, sorted by path."""
    # one task owns a ride and streams its sorted lines, so that a manifest is one file
    lines = checksum_lines(inventory).repartition("session_id").sortWithinPartitions("session_id", "path")
    lines.select("session_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("session_id").text(out)


def write_report_json(report: DataFrame, out: str, *, key: str = "session_id") -> None:
    """One JSON document per session."""
    report.select(key, F.to_json(F.struct(*report.columns)).alias("value")).write.mode("overwrite").partitionBy(key).text(out)


def write_cvat(lines: DataFrame, out: str, *, key: str = "session_id", order: Sequence[str] = ("timestamp_ns", "seq", "price")) -> None:
    """The CVAT document of each session: fixed head and foot around the sorted track lines.

    One task owns a session and streams its sorted lines, so that a document is one file."""
    head = ['<?xml version="1.0" encoding="utf-8"?>', "<annotations>", "  <version>1.1</version>",
            "  <meta><task><name>session</name></task></meta>"]
    first = [c for c in order if c in lines.columns]
    # tracks come in order of their first row, then polygons in log order
    start = lines.where("part = 0").select(key, "track_id", F.struct(*first).alias("_start"))
    body = lines.join(start, [key, "track_id"]).select(key, F.lit(1).alias("_s"), "_start", "track_id", "part", *first, "line")
    ids = lines.select(key).distinct()
    blank = {c: F.lit(None).cast(dict(body.dtypes)[c]) for c in body.columns}

    def fixed(pos: int, texts: list[str]) -> DataFrame:
        arr = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(texts)])
        rows = ids.withColumn("_x", F.explode(arr))
        return rows.select(*[
            F.col(key) if c == key else F.lit(pos).alias("_s") if c == "_s" else F.col("_x.i").cast(dict(body.dtypes)["track_id"]).alias(c)
            if c == "track_id" else F.col("_x.t").alias(c) if c == "line" else blank[c].alias(c) for c in body.columns])

    every = fixed(0, head).unionByName(body).unionByName(fixed(2, ["</annotations>"]))
    place = [key, "_s", "_start", "track_id", "part", *first]
    ordered = every.repartition(key).sortWithinPartitions(*place)
    ordered.select(key, F.col("line").alias("value")).write.mode("overwrite").partitionBy(key).text(out)


def plan_export_volumes(inventory: DataFrame, max_bytes: int = 512 * 1024 * 1024, *, key: str = "session_id") -> DataFrame:
    """Volume number of each file: path order, a new volume when the next file would pass the cap.

    One ride may hold most files: they are numbered from prefix sums and pointer doubling, not walked in one
    task. A file larger than the cap is a volume of its own; a null or negative length counts as zero bytes.
    """
    return next_fit(inventory.select(key, "path", "length"), [key], ["path"], "length", max_bytes, name="volume")


def volume_sizes(plan: DataFrame, *, key: str = "session_id") -> DataFrame:
    return plan.groupBy(key, "volume").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))


def share_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """SHARE_REDACTED versions: coarse location, flagged manifest, every other log redacted by its schema. Sources stay as they are."""
    out = dict(tables)
    if "location" in out:
        out["location"] = coarsen_locations(out["location"])
    for name in out.keys() - {"location", "manifest"}:
        out[name] = redact_events(out[name], keep=("session_id",))
    if "manifest" in out:
        out["manifest"] = out["manifest"].withColumn("privacy_mode", F.lit("SHARE_REDACTED")).withColumn(
            "notes", F.concat(F.coalesce("notes", F.lit("")), F.lit(SHARE_NOTE)))
    return out


def share_export(tables: dict[str, DataFrame], out: str) -> None:
    write_session_tables({k: v for k, v in share_tables(tables).items() if k != "manifest"}, out, fmt="json")
    if "manifest" in tables:
        write_manifests(share_tables({"manifest": tables["manifest"]})["manifest"], f"{out}/manifest")
    for df in list(tables.values())[:1]:
        write_checksum_manifest(written_files(df.sparkSession, out), f"{out}/checksums")


def written_files(spark: SparkSession, root: str) -> DataFrame:
    """session_id, path below `root` and SHA-256 of every data file of tables written per session."""
    files = file_digests(spark, root, recursiveFileLookup=True)
    inside = F.regexp_extract("path", r"/([^/]+/session_id=.*/part-[^/]+)$", 1)
    return files.select(F.regexp_extract("path", r"/session_id=([^/]+)/", 1).alias("session_id"), inside.alias("path"), "sha256").where("path <> ''")


# --- verification ------------------------------------------------------------------------------

def session_findings(manifests: DataFrame, inventory: DataFrame, checksums: DataFrame, *, sessions: DataFrame | None = None,
                     crash: DataFrame | None = None, key: str = "session_id") -> DataFrame:
    """One row per finding: session, level (error or warning), message.

    Findings stay rows, so a ride with very many broken files is not gathered anywhere. A session
    without a manifest reports that and nothing else but its unfinished segments.
    """
    have = manifests.select(key, F.lit(True).alias("_has"), *(
        [F.col("schema_warning")] if "schema_warning" in manifests.columns else [F.lit(None).cast("string").alias("schema_warning")]))
    listed = checksums.select(key, "path", "digest")
    both = inventory.select(key, "path", "sha256").join(listed, [key, "path"], "full")
    broken = (F.when(F.col("sha256").isNull(), F.concat(F.lit("missing "), F.col("path")))
              .when(F.col("digest").isNotNull() & (F.col("sha256") != F.col("digest")), F.concat(F.lit("checksum mismatch "), F.col("path"))))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    part = F.col("sha256").isNotNull() & F.col("path").rlike(r"\.part\.mp4$")

    def finding(when: F.Column, level: str, text: F.Column, needs: bool) -> F.Column:
        return F.when(when, F.struct(F.lit(level).alias("level"), text.alias("message"), F.lit(needs).alias("needs_manifest")))

    copied = F.concat(F.lit("copied to "), F.regexp_replace(name, r"\.part\.mp4$", ".mp4.recovered"), F.lit(" (marked recovered)"))
    files = both.select(key, F.explode(F.array_compact(F.array(
        finding(broken.isNotNull(), "error", broken, True),
        finding(part, "warning", F.concat(F.lit("unfinalized segment "), name), False),
        finding(part, "warning", copied, False)))).alias("f")).select(key, "f.*")
    base = sessions.select(key).distinct() if sessions is not None else inventory.select(key).union(have.select(key)).distinct()
    per = base.join(have, key, "left").join(listed.select(key).distinct().withColumn("_sums", F.lit(True)), key, "left")
    if crash is not None:
        per = per.join(crash.select(key, F.col("n_hits").alias("_hits")), key, "left")
    else:
        per = per.withColumn("_hits", F.lit(0))
    heads = per.select(key, F.explode(F.array_compact(F.array(
        finding(F.col("_has").isNull(), "error", F.lit("missing manifest.json"), False),
        finding(F.col("schema_warning").isNotNull(), "warning", F.col("schema_warning"), True),
        finding(F.col("_sums").isNull(), "warning", F.lit("no checksums.sha256"), True),
        finding(F.col("_hits") > 0, "warning", F.concat(F.lit("crash residual hits="), F.col("_hits").cast("string")), True)))).alias("f")).select(key, "f.*")
    every = files.unionByName(heads).join(base, key, "left_semi")
    manifest_keys = have.select(key, F.col("_has"))
    return every.join(manifest_keys, key, "left").where(~F.col("needs_manifest") | F.col("_has").isNotNull()).select(key, "level", "message")


def verify_sessions(manifests: DataFrame, inventory: DataFrame, checksums: DataFrame, *, sessions: DataFrame | None = None,
                    crash: DataFrame | None = None, intervals: DataFrame | None = None, key: str = "session_id") -> DataFrame:
    """ok, number of errors and warnings, and verified files per session; the texts are `session_findings`."""
    found = session_findings(manifests, inventory, checksums, sessions=sessions, crash=crash, key=key).groupBy(key).agg(
        F.count_if(F.col("level") == "error").alias("n_errors"), F.count_if(F.col("level") == "warning").alias("n_warnings"))
    both = checksums.select(key, "path", "digest").join(inventory.select(key, "path", "sha256"), [key, "path"], "left")
    files = both.groupBy(key).agg(F.count(F.lit(1)).alias("n_listed"), F.count_if(F.col("digest") == F.col("sha256")).alias("n_verified"))
    base = sessions.select(key).distinct() if sessions is not None else inventory.select(key).union(manifests.select(key)).distinct()
    out = base.join(found, key, "left").join(files, key, "left")
    n = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_errors", "n_warnings", "n_listed", "n_verified")}
    res = out.select(key, (n["n_errors"] == 0).alias("ok"), *[e.alias(c) for c, e in n.items()])
    return res if intervals is None else res.join(intervals, key, "left")
