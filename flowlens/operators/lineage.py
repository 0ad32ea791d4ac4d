"""Cutting lineage in loops, through the shared checkpoint folder only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

PREFIX = "flowlens-"


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder of this session for intermediate tables, below `spark.checkpoint.dir`.

    Where that setting is absent a local session uses its warehouse; on a cluster, whose executors share
    no default folder, it raises. The folder is deleted when the session's file system closes.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    shared = shared or spark.conf.get("spark.sql.warehouse.dir")
    own = f"{shared.rstrip('/')}/{PREFIX}{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()


def new_path(spark: SparkSession, kind: str = "cut") -> str:
    """A path in the session's folder that nothing has used."""
    return f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once as a table in the checkpoint folder and read it back.

    Unlike `checkpoint()`, which computes its input twice, this computes it once, keeps the rows
    columnar and gives the next plan the table's size; a lost executor only re-reads files.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table's folder, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(*tables: DataFrame) -> None:
    """Delete tables made by `cut` that no later plan reads."""
    for df in tables:
        if getattr(df, "cut_path", None):
            remove(df.sparkSession, df.cut_path)
