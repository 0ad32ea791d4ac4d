"""Nested JSON sources: engine metadata, layered inputs, webhook events."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import paths, values
from flowlens.operators.lineage import cut
from flowlens.sources import inventory as inv

# The fields of a webhook event.
WEBHOOK_DDL = (
    "event STRING, runId STRING, utcTime STRING, "
    "trace STRUCT<name: STRING, process: STRING, task_id: STRING, workdir: STRING, exit: STRING, "
    "native_id: STRING, container: STRING, status: STRING>, "
    "metadata STRUCT<workflow: STRUCT<workflowStats: STRUCT<processes: "
    "ARRAY<STRUCT<name: STRING, cached: INT, errored: BOOLEAN>>>>>"
)


def parse_documents(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """JSON texts to a VARIANT `doc`; texts that are not JSON objects go to a reject table."""
    # Through `inline` the text is parsed once: the tests below are not rewritten over the parser.
    parsed = df.select("*", F.inline(F.array(F.struct(values.parse_json(F.col(text)).alias("doc")))))
    good = F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False))
    return parsed.where(good).drop(text), parsed.where(~good).drop("doc")


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One metadata document per file: (`run_id`, `doc`) and rejects (`run_id`, `text`)."""
    raw = spark.read.text(path, wholetext=True).select(
        F.regexp_replace(paths.basename(F.col("_metadata.file_path")), r"\.[^.]*$", "").alias("run_id"),
        F.col("value").alias("text"),
    )
    return parse_documents(raw)


def save_documents(docs: DataFrame, progress: DataFrame, path: str) -> DataFrame:
    """Persist one raw document per submission, once; submissions already marked saved are left out.

    Of several documents of a submission the one whose JSON text comes first is written. Returns the
    milestones to record, of just the documents that were written.
    """
    saved = progress.where("key = 'savedMetadata'").select("submission_id")
    text = docs.join(saved, "submission_id", "left_anti").withColumn("doc", F.to_json("doc"))
    rest = [c for c in text.columns if c not in ("submission_id", "doc")]
    first = text.groupBy("submission_id").agg(F.min(F.struct("doc", *rest)).alias("_first"))
    fresh = cut(first.select("submission_id", "_first.*").select(docs.columns))
    fresh.withColumn("_bucket", F.pmod(F.xxhash64("submission_id"), F.lit(64))).write.mode("append").partitionBy("_bucket").json(path)
    return fresh.select("submission_id", F.lit("savedMetadata").alias("key"))


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def _put(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows = TaskContext.get().partitionId(), 0
        # Hidden from readers until whole; another attempt of the task has a folder of its own.
        own, whole = f"{folder}/_{uuid.uuid4().hex}", f"{folder}/task={number}"
        os.makedirs(own)
        for batch in batches:
            rows += batch.num_rows
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                with open(f"{own}/part-{number:05d}-{name}.txt", "ab") as file:
                    file.write((text or b"") + b"\n")
        try:
            os.rename(own, whole)
        except OSError:
            if not os.path.isdir(whole):  # else another attempt was first
                raise
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    return run


def write_files(texts: DataFrame, root: str, keys: list[str]) -> None:
    """A file for each of the `keys` (numbers) of `texts` below the new folder `root`; its path holds `key=value`, its rows are its lines.

    Rows with the same keys must come in one task. Hadoop's own writer starts a process or more (chmod)
    for each file and folder on a disk, so there the tasks write by themselves, into one folder each.
    """
    parent, name = root.rstrip("/").rsplit("/", 1)
    disk = inv.disk_folder(texts.sparkSession, parent)
    if disk is None:
        # Tasks move their own files into place.
        texts.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(*keys).text(root)
        return
    os.mkdir(f"{disk}/{name}")
    named = F.concat_ws(",", *(F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys))
    rows = texts.select(named.alias("name"), F.col("text").cast("binary").alias("text"))
    rows.mapInArrow(_put(f"{disk}/{name}"), "rows long").agg(F.sum("rows")).collect()


def _texts(spark: SparkSession, root: str | list[str], names: str | None = None) -> DataFrame:
    """`_path, text` of every file below `root`. On a disk the files are listed and read by tasks of many files.

    Spark's reader lists all files on the driver and takes 32 a task at most; it reads what is not on a disk, and what is compressed.
    """
    folder = None if names or not isinstance(root, str) else inv.disk_folder(spark, root)
    if folder is None:
        reader = spark.read.option("recursiveFileLookup", "true")
        reader = reader.option("pathGlobFilter", names) if names else reader
        return reader.text(root, wholetext=True).select(_plain(F.col("_metadata.file_path")).alias("_path"), F.col("value").alias("text"))
    there, ends, jvm = inv.list_disk(spark, folder), [], spark._jvm.org.apache.hadoop
    for codec in jvm.io.compress.CompressionCodecFactory.getCodecClasses(spark._jsc.hadoopConfiguration()):
        ends.append(jvm.util.ReflectionUtils.newInstance(codec, spark._jsc.hadoopConfiguration()).getDefaultExtension())
    packed = F.exists(F.array(*map(F.lit, ends)), lambda end: F.col("path").endswith(end))
    found = inv.read_disk(there.where(~packed)).select(F.col("path").alias("_path"), "text")
    if not there.where(packed).isEmpty():
        found = found.unionByName(_texts(spark, root, "*{" + ",".join(ends) + "}"))
    return found.hint("merge")  # Spark knows the size of the list, not that of the texts


def read_manifests(spark: SparkSession, files: DataFrame, root: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Layered inputs of many manifests: rows (manifest_id, layer, name, value) and rejects (manifest_id, layer, file, reason).

    `files`: manifest_id, layer, file (a path as `root` lists it). One scan reads everything below
    `root`, however many files there are, and meets `files` by the path of each file; a file may serve many
    manifests. Rejected are files that are not one JSON object, and files that do not exist. An empty object
    gives no rows. What was read is cut once, so that rows and rejects do not open every file again.
    """
    found = _texts(spark, root).select("_path", values.parse_json(F.col("text")).alias("doc"), F.lit(True).alias("_found"))
    met = files.select("manifest_id", "layer", "file", _plain(F.col("file")).alias("_path")).join(found, "_path", "left")
    met = cut(met.drop("_path").withColumn("_ok", F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False))))
    rows = met.where("_ok").select("manifest_id", "layer", "doc").lateralJoin(spark.tvf.variant_explode(F.col("doc").outer()))
    reason = F.when(F.col("_found").isNull(), "missing").otherwise("not a JSON object")
    return (
        rows.select("manifest_id", "layer", F.col("key").alias("name"), "value"),
        met.where(~F.col("_ok")).select("manifest_id", "layer", "file", reason.alias("reason")),
    )


def read_layers(spark: SparkSession, files: list[str]) -> DataFrame:
    """Input documents of one manifest in order: `layer, name, value` (VARIANT). Later files have higher layers.

    A file that is not one JSON object fails the read with its name.
    """
    plan = spark.createDataFrame([("", n, f) for n, f in enumerate(files)], "manifest_id string, layer int, file string")
    rows, bad = read_manifests(spark, plan, files)
    wrong = [f"{r.file}: {r.reason}" for r in bad.collect()]
    if wrong:
        raise ValueError("; ".join(sorted(wrong)))
    return rows.drop("manifest_id")


def webhook_events(df: DataFrame, text: str = "value") -> DataFrame:
    """Webhook JSON texts to typed columns; works on a batch or a stream."""
    return df.select(F.from_json(text, WEBHOOK_DDL).alias("e")).select("e.*")


def stream_webhook(spark: SparkSession, path: str) -> DataFrame:
    """Webhook events dropped as JSON lines into a folder (a Kafka `value` column reads the same)."""
    return webhook_events(spark.readStream.text(path))
