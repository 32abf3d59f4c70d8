"""Readers of session bundles: `<root>/session_<id>/<log>` for a whole fleet in one scan."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens import SCHEMA_VERSION
from ridelens.functions import digest
from ridelens.functions import vocab as V
from ridelens.schemas import LOGS, MANIFEST, MOUNT

_SESSION = r"/session_([^/]+)/"
_INSIDE = r"/session_[^/]+/(.*)$"
CHECKSUM_FILE = "checksums.sha256"
WHOLE = 128 << 20  # files up to this size are read in one cell, larger ones split by split
_PACKED = r"(?i)\.(gz|gzip|bz2|deflate|lz4|snappy|zst|zstd|passthrough)$"  # the text reader would unpack these
_BOM = b"\xef\xbb\xbf"


def _exists(spark: SparkSession, glob: str) -> bool:
    """Whether any file matches; asked of Hadoop so that object stores and HDFS work alike."""
    jvm, path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def _table_format(spark: SparkSession, folder: str) -> str | None:
    """`json` or `parquet` by the first data file of a written table, None where there is none; lists no further."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listFiles(path, True) if fs.exists(path) else None
    while files is not None and files.hasNext():
        name = files.next().getPath().getName()
        if name.startswith("part-"):
            return "json" if ".json" in name else "parquet"
    return None


def _read_table(spark: SparkSession, root: str, kind: str, schema: str) -> DataFrame | None:
    """A log that `write_session_tables` wrote, under its own name or as a part of `imu`."""
    for folder, extra in ((kind, ""), ("imu", ", imu_log STRING")):
        fmt = _table_format(spark, f"{root}/{folder}") if folder == kind or kind in V.IMU_LOGS.values() else None
        if fmt:
            reader = spark.read.schema(f"session_id STRING, {schema}{extra}").option("columnNameOfCorruptRecord", "_corrupt_record")
            df = reader.format(fmt).load(f"{root}/{folder}")
            return df.where(F.col("imu_log") == kind).drop("imu_log") if extra else df
    return None


def read_log(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """One log over all sessions, from bundles or from the tables that `write_session_tables` wrote below `root`.

    Blank lines are skipped, a log nobody wrote is an empty table, and a broken line is kept in `_corrupt_record`.
    `line_offset` orders rows as written within their file. Tables give the columns of the log's schema; a null or
    empty session id comes back as null.
    """
    rel, ddl = LOGS[kind]
    glob = f"{root}/session_*/{rel}"
    schema = f"{ddl}, _corrupt_record STRING"
    if _exists(spark, glob):
        df = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(glob)
        session = F.regexp_extract("_metadata.file_path", _SESSION, 1)
    else:
        df, session = _read_table(spark, root, kind, schema), F.col("session_id")
        if df is None:
            return spark.createDataFrame([], f"session_id STRING, {schema}, file_block BIGINT, line_offset BIGINT")
    return df.select(
        session.alias("session_id"), *[c for c in df.columns if c != "session_id"],
        F.col("_metadata.file_block_start").alias("file_block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("line_offset"))


def stream_log(spark: SparkSession, root: str, kind: str, *, max_files: int | None = None) -> DataFrame:
    """The same log as a file stream."""
    rel, ddl = LOGS[kind]
    reader = spark.readStream.schema(ddl)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(f"{root}/session_*/{rel}").withColumn(
        "session_id", F.regexp_extract("_metadata.file_path", _SESSION, 1))


def _read_documents(spark: SparkSession, root: str, rel: str, ddl: str) -> DataFrame:
    glob = f"{root}/session_*/{rel}"
    if not _exists(spark, glob):
        return spark.createDataFrame([], f"dir_session STRING, {ddl}")
    df = spark.read.option("multiLine", True).schema(ddl).json(glob)
    return df.select(F.regexp_extract("_metadata.file_path", _SESSION, 1).alias("dir_session"), "*")


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row per session; a schema version other than ours only gives a warning, a missing one not even that."""
    df = _read_documents(spark, root, "manifest.json", MANIFEST)
    return with_schema_warning(df.drop("session_id").withColumnRenamed("dir_session", "session_id"))


def with_schema_warning(manifests: DataFrame) -> DataFrame:
    v = F.coalesce("schema_version", F.lit(""))
    text = F.concat(F.lit("schema "), v, F.lit(f" read with compat {SCHEMA_VERSION}"))
    return manifests.withColumn("schema_warning", F.when((v != "") & (v != SCHEMA_VERSION), text))


def read_mounts(spark: SparkSession, root: str) -> DataFrame:
    df = _read_documents(spark, root, "calibration/mount_profile.json", MOUNT)
    return df.withColumnRenamed("dir_session", "session_id")


def _hash_splits(parts: DataFrame, due: dict[tuple[str, int], tuple[digest.Sha256, int]]) -> DataFrame:
    """The states after the splits that are due, (file, start) to the state before and the bytes the file still has."""
    schema = pa.schema([("url", pa.string()), ("at", pa.int64()), ("words", pa.binary()), ("size", pa.int64()), ("tail", pa.binary()), ("left", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = {}
        for batch in batches:
            names, at, value = batch["url"].dictionary_encode(), batch["at"].to_numpy(), batch["value"]
            offsets = np.frombuffer(value.buffers()[1], np.int32)[value.offset : value.offset + len(value) + 1]
            index = names.indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(index) | np.diff(at)) + 1).tolist(), len(at)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i < j and (key := (names.dictionary[int(index[i])].as_py(), int(at[i]))) in due:
                    state, left = now.get(key) or due[key]
                    taken = min(int(offsets[j] - offsets[i]), left)  # the last line may have no line end
                    now[key] = digest.update(state, value.buffers()[2][int(offsets[i]) : int(offsets[i]) + taken].to_pybytes()), left - taken
        if now:
            yield pa.RecordBatch.from_pylist([{"url": u, "at": a, "words": s.words, "size": s.size, "tail": s.tail, "left": n} for (u, a), (s, n) in now.items()], schema)

    return parts.mapInArrow(run, "url string, at long, words binary, size long, tail binary, left long")


def _chained_digests(spark: SparkSession, root: str, sizes: dict[str, int], **options) -> dict[str, str]:
    """SHA-256 of large files without any task reading more than a split; files that the text reader alters are left out.

    A digest is a chain, so round k continues the states of all files through their k-th splits. Every line comes with
    its line end, so a split's lines side by side are the file's own bytes. Only the tasks that hold due splits run.
    """
    scan = spark.read.options(**options).text(root, lineSep="\n").where(F.col("_metadata.file_path").isin(list(sizes)))
    parts = scan.select(F.col("_metadata.file_path").alias("url"), F.col("_metadata.file_block_start").alias("at"),
                        F.concat("value", F.lit("\n")).cast("binary").alias("value"))
    splits, total = defaultdict(list), defaultdict(int)
    for url, at, task, n in sorted(parts.groupBy("url", "at", F.spark_partition_id()).agg(F.sum(F.octet_length("value"))).collect()):
        splits[url].append((at, task))
        total[url] += n
    state = {}
    for url, size in sizes.items():
        if size - total[url] in (0, -1):
            state[url] = digest.Sha256(), size
        elif size - total[url] in (3, 2):  # the reader drops a byte order mark
            state[url] = digest.update(digest.Sha256(), _BOM), size - 3
    for k in range(max((len(splits[url]) for url in state), default=0)):
        due = {url: splits[url][k] for url in state if k < len(splits[url])}
        rows = _hash_splits(parts, {(url, at): state[url] for url, (at, _) in due.items()}).rdd
        got = {r.url: r for r in spark.sparkContext.runJob(rows, list, sorted({task for _, task in due.values()})) if due[r.url][0] == r.at}
        for url in due:
            r = got[url]
            state[url] = digest.Sha256(bytes(r.words), r.size, bytes(r.tail)), r.left
    return {url: digest.hexdigest(s) for url, (s, left) in state.items() if left == 0}


def file_digests(spark: SparkSession, root: str, *, whole: int = WHOLE, **options) -> DataFrame:
    """Path, length and SHA-256 of every file below `root`.

    Files above `whole` bytes are read split by split when this is called; of packed ones, and of those that the text
    reader alters otherwise, the content is one cell.
    """
    files = spark.read.format("binaryFile").options(**options).load(root)
    url = F.col("_metadata.file_path")
    large = files.where(F.col("length") > whole).select("path", "length", url.alias("url")).collect()
    plain = {r.url: r.length for r in large if not re.search(_PACKED, r.path)}
    found = _chained_digests(spark, root, plain, **options) if plain else {}
    cell = ("path", "length", F.sha2("content", 256).alias("sha256"))
    out = files.where(F.col("length") <= whole).select(*cell)
    if found:
        out = out.unionByName(spark.createDataFrame([(r.path, r.length, found[r.url]) for r in large if r.url in found], out.schema))
    if rest := [r.url for r in large if r.url not in found]:
        out = out.unionByName(files.where(url.isin(rest)).select(*cell))
    return out


def read_file_inventory(spark: SparkSession, root: str, *, with_content: bool = False) -> DataFrame:
    """Path, size and SHA-256 of every bundle file except the checksum file and `*.tmp`; with `content` each file is one cell."""
    if with_content:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).withColumn("sha256", F.sha2("content", 256))
    else:
        df = file_digests(spark, root, recursiveFileLookup=True)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    keep = (name != CHECKSUM_FILE) & ~name.endswith(".tmp") & F.col("path").rlike(_SESSION)
    cols = [F.regexp_extract("path", _SESSION, 1).alias("session_id"), F.regexp_extract("path", _INSIDE, 1).alias("path"),
            F.col("length"), F.col("sha256")]
    return df.where(keep).select(*cols, *(["content"] if with_content else []))


def read_checksums(spark: SparkSession, root: str) -> DataFrame:
    """`<digest>␠␠<path>` lines, split at the first double blank."""
    glob = f"{root}/session_*/{CHECKSUM_FILE}"
    if not _exists(spark, glob):
        return spark.createDataFrame([], "session_id STRING, digest STRING, path STRING")
    df = spark.read.text(glob).where(F.trim("value") != "")
    return parse_checksums(df.select(F.regexp_extract("_metadata.file_path", _SESSION, 1).alias("session_id"), "value"))


def parse_checksums(lines: DataFrame) -> DataFrame:
    parts = F.split("value", "  ", 2)
    return lines.select("session_id", parts[0].alias("digest"), F.get(parts, F.lit(1)).alias("path"))


def route_imu(samples: DataFrame) -> DataFrame:
    """`imu_log` of each sample: by sensor type, unknown types go to the gyro log."""
    return samples.withColumn("imu_log", V.lookup(V.IMU_LOGS, F.coalesce("sensor_type", F.lit("GYRO")), "gyro"))
