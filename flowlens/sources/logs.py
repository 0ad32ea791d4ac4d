"""Engine logs as ordered lines, and key=value output metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import paths

WHITESPACE = "\t\x0b\x0c\r "


def clean(line: Column) -> Column:
    return F.rtrim(line, F.lit(WHITESPACE))


def lines_of_text(df: DataFrame, run_id: str, text: str) -> DataFrame:
    """`run_id, line_no, line` from a column of whole texts; blank lines dropped, numbers kept."""
    return (
        df.select(F.col(run_id).alias("run_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
        .select("run_id", F.col("line_no").cast("bigint").alias("line_no"), clean(F.col("line")).alias("line"))
        .where("line <> ''")
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log files as lines: `run_id` (file name without extension), `block`, `line_no`, `line`.

    Big files are split by Spark. `block` is the split's offset in the file and rises with the line
    order; `line_no` orders lines inside it, so (block, line_no) orders a file and `block` is its slice.
    """
    raw = spark.read.text(path)
    name = F.regexp_replace(paths.basename(F.col("_metadata.file_path")), r"\.[^.]*$", "")
    return raw.select(
        name.alias("run_id"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"), clean(F.col("value")).alias("line"),
    ).where("line <> ''")


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of files; numbers order the lines of one micro-batch file."""
    raw = spark.readStream.text(path)
    name = F.regexp_replace(paths.basename(F.col("_metadata.file_path")), r"\.[^.]*$", "")
    return raw.select(
        name.alias("run_id"), F.col("_metadata.file_modification_time").alias("at"),
        F.monotonically_increasing_id().alias("line_no"), clean(F.col("value")).alias("line"),
    ).where("line <> ''")


def key_values(lines: DataFrame, line: str = "line") -> DataFrame:
    """`key=value` lines: `key, is_list, items, value, reason`; `reason` marks a malformed line.

    `[]` is the empty list and `[a, b]` a list; items are split on comma and blank.
    """
    parts = F.split(line, "=")
    ok = F.size(parts) == 2
    value = F.trim(F.get(parts, F.lit(1)))
    is_list = value.startswith("[")
    items = F.when(value == "[]", F.array().cast("array<string>")).when(
        is_list, F.split(F.regexp_replace(value, r"^[\]\[]+|[\]\[]+$", ""), ", ")
    )
    return (
        lines.withColumn("key", F.when(ok, F.trim(F.get(parts, F.lit(0)))))
        .withColumn("is_list", F.when(ok, is_list))
        .withColumn("items", F.when(ok, items))
        .withColumn("value", F.when(ok & ~is_list, value))
        .withColumn("reason", F.when(~ok, "not one key and one value"))
    )


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejected rows."""
    return parsed.where("reason is null").drop("reason"), parsed.where("reason is not null")


def require_clean(rejects: DataFrame, what: str) -> None:
    """Fail with a few examples when anything was rejected."""
    bad = rejects.limit(3).collect()
    if bad:
        raise ValueError(f"{what}: malformed rows, such as {bad}")
