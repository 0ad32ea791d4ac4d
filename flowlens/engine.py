"""Session settings and the SQL entry point over a run-history store."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from flowlens.schema import SPECS

# Settings that a session needs for right results or good plans at any size.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Folders of many files are listed by this many tasks at most, not by one a folder.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the session settings the operators rely on; cluster sizing stays with the caller."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, so that Python tasks can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "flowlens_shipped", False):
        return spark
    root, body = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(body, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    path = os.path.join(tempfile.mkdtemp(prefix="flowlens-code-"), "flowlens.zip")  # read by the driver alone, which serves it
    Path(path).write_bytes(body.getvalue())
    context.addPyFile(path)
    context.flowlens_shipped = True
    return spark


class Engine:
    """A run-history store whose tables are registered as views for SQL."""

    def __init__(self, spark: SparkSession):
        self.spark = tune(spark)

    def register(self, tables: dict[str, DataFrame]) -> "Engine":
        """Register store tables (name to DataFrame) as temporary views."""
        unknown = set(tables) - set(SPECS)
        if unknown:
            raise ValueError(f"not store tables: {sorted(unknown)}")
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return self

    def open(self, root: str) -> "Engine":
        """Register every table found under a store folder (one parquet folder per table)."""
        from flowlens.operators import store

        return self.register(
            {n: store.read(self.spark, root, s) for n, s in SPECS.items() if store.exists(self.spark, root, s)}
        )

    def sql(self, text: str) -> DataFrame:
        """Run the user's SQL over the registered tables."""
        return self.spark.sql(text)
