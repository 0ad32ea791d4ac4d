"""Contig names from reference indexes and interval files (plain or gzip)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _first_field(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.split_part("value", F.lit("\t"), F.lit(1)).alias("contig")
    )


def reference_contigs(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (`file`, `contig`) of reference indexes."""
    return _first_field(spark, path).distinct()


def interval_contigs(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (`file`, `contig`) of interval files; names trimmed, empties dropped."""
    return (
        _first_field(spark, path).where("contig <> ''")
        .withColumn("contig", F.trim("contig", F.lit("\t\x0b\x0c\r "))).distinct()
    )
