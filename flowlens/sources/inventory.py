"""File inventory: what exists, how large, when changed."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import paths
from flowlens.operators.lineage import cut

# The driver looks for folders until it has this many to deal to tasks.
FOLDERS = 64
# Files that a task reports or reads at once, and the bytes of them.
FILES, BYTES = 2048, 8 << 20


# --- folders on a disk ---


def disk_folder(spark: SparkSession, root: str) -> str | None:
    """The plain path of an existing folder on a disk that driver and executors see; null for anything else that Spark reads."""
    if any(c in root for c in "*?[]{}\\"):
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return whole.getPath() if whole.getScheme() == "file" and os.path.isdir(whole.getPath()) else None


def _hidden(name: bytes, is_folder: bool) -> bool:
    """Names that Spark's own listing leaves out."""
    if is_folder and name.startswith((b"_metadata", b"_common_metadata")):
        return False
    return name.startswith(b".") or name.startswith(b"_") and b"=" not in name or name.endswith(b"._COPYING_")


def _below(folder: bytes) -> list[bytes]:
    with os.scandir(folder) as entries:
        return [e.path for e in entries if e.is_dir() and not _hidden(e.name, True)]


def _files(folder: bytes, deep: bool) -> Iterator[tuple[bytes, int, int]]:
    todo = [folder]
    while todo:
        with os.scandir(todo.pop()) as entries:
            for e in entries:
                is_folder = e.is_dir()
                if _hidden(e.name, is_folder):
                    continue
                if is_folder:
                    todo += [e.path] * deep
                    continue
                try:
                    at = e.stat()
                except FileNotFoundError:  # gone, or a link to nothing
                    continue
                if at.st_size:  # Spark's readers leave empty files out
                    yield e.path, at.st_size, at.st_mtime_ns // 1_000_000 * 1000


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("path", pa.binary()), ("size", pa.int64()), ("modified", pa.int64())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    rows = []
    for given in batches:
        for folder, deep in zip(given.column("folder").to_pylist(), given.column("deep").to_pylist(), strict=True):
            for row in _files(folder, deep):
                rows.append(row)
                if len(rows) == FILES:
                    yield batch(rows)
                    rows = []
    if rows:
        yield batch(rows)


def list_disk(spark: SparkSession, folder: str) -> DataFrame:
    """`path, size, modified` of every file below a folder on a disk, written once; the driver holds folders only, tasks list the files."""
    done, level = [], [os.fsencode(folder)]
    while level and len(level) < FOLDERS:
        done += level
        level = [x for f in level for x in _below(f)]
    work = pa.table({"folder": pa.array(done + level, pa.binary()), "deep": [False] * len(done) + [True] * len(level)})
    tasks = min(len(work), int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")))
    found = spark.createDataFrame(work).repartition(tasks).mapInArrow(_list, "path binary, size long, modified long")
    return cut(found.select(F.col("path").cast("string").alias("path"), "size", F.timestamp_micros("modified").alias("modified")))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(texts, pa.binary())], names=["path", "text"])

    names, texts, size = [], [], 0
    for given in batches:
        for name in given.column("path").to_pylist():
            with open(name, "rb") as file:
                names.append(name)
                texts.append(file.read())
            size += len(texts[-1])
            if len(names) == FILES or size >= BYTES:
                yield batch()
                names, texts, size = [], [], 0
    if names:
        yield batch()


def read_disk(files: DataFrame) -> DataFrame:
    """`path, text`: the bytes of listed files, as text, dealt by path over tasks by their number and size."""
    n, size = files.agg(F.count("path"), F.sum("size")).first()
    tasks = max(1, -(-n // FILES), -(-(size or 0) // (BYTES * 16)), min(n, files.sparkSession.sparkContext.defaultParallelism))
    return files.select(F.col("path").cast("binary").alias("path")).repartition(tasks, "path").mapInArrow(_read, "path binary, text binary").select(
        F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))


# --- inventories ---


def read_inventory(spark: SparkSession, root: str) -> DataFrame:
    """`path, size, modified` of every file below `root`; file contents are never read."""
    folder = disk_folder(spark, root)
    if folder is not None:
        return list_disk(spark, folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(
        F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^/+", "/").alias("path"),
        F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
    )


def folders(inventory: DataFrame) -> DataFrame:
    """Distinct folders that hold at least one file, all levels up."""
    parts = F.split("path", "/")
    ups = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    return inventory.select(F.explode(ups).alias("path")).where("path <> ''").distinct()


def look_up(wanted: DataFrame, inventory: DataFrame) -> DataFrame:
    """The `wanted` paths with `kind` (file, folder, or null where nothing is there) and the file's other columns.

    A folder is there while a file lies anywhere below it, and has neither size nor date. One join for all paths.
    """
    both = inventory.withColumn("kind", F.lit("file")).unionByName(
        folders(inventory).join(inventory, "path", "left_anti").withColumn("kind", F.lit("folder")), allowMissingColumns=True
    )
    return wanted.join(both, "path", "left")


def profile(files: DataFrame, path: str = "path") -> DataFrame:
    """Files per URI scheme and extension."""
    clean = paths.strip_file_prefix(F.col(path))
    return files.select(
        paths.scheme(F.col(path)).alias("scheme"), paths.extension(clean).alias("extension")
    ).groupBy("scheme", "extension").agg(F.count(F.lit(1)).alias("files"))


def bucket_usage(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """Objects and bytes per bucket."""
    links = files.where(paths.bucket(F.col(path)).isNotNull())
    return links.groupBy(paths.bucket(F.col(path)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("objects"), F.sum(size).alias("bytes")
    )
