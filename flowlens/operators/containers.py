"""Container images: inventory, pinning, tools per image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import images
from flowlens.operators import ordered


def inventory(rows: DataFrame, image: str) -> DataFrame:
    """Parsed distinct images with registry class, rebuilt reference and a file-safe name."""
    p = images.parse(rows.select(image).distinct(), image)
    ref = images.rebuild(*[F.col(c) for c in ("host", "repository", "image", "tag", "digest")])
    return p.select(
        image, "valid", "host", "repository", "image", "tag", "digest",
        F.when(F.col("valid"), images.registry(F.col("host"))).alias("registry"),
        F.when(F.col("valid"), ref).alias("reference"), F.when(F.col("valid"), images.file_safe(ref)).alias("file_name"),
    )


def to_pin(rows: DataFrame, image: str, digests: DataFrame) -> DataFrame:
    """Images without a digest that the digest table does not know."""
    open_ = inventory(rows, image).where("valid and digest is null")
    known = digests.select(F.lower("image").alias("_k"))
    return open_.withColumn("_k", F.lower(image)).join(known, "_k", "left_anti").drop("_k")


def pin(tools: DataFrame, overrides: DataFrame, digests: DataFrame) -> DataFrame:
    """Each tool's image, overridden first, then replaced by its pinned digest (case-insensitive).

    The digest side is joined on its key without a hint: Spark broadcasts it when its size allows.
    """
    own = tools.join(overrides.select("tool", F.col("image").alias("_o")), "tool", "left").withColumn("image", F.coalesce("_o", "image"))
    pinned = digests.select(F.lower("image").alias("_k"), "pinned")
    return own.withColumn("_k", F.lower("image")).join(pinned, "_k", "left").withColumn(
        "container", F.coalesce("pinned", "image")
    ).drop("_k", "_o", "pinned")


def tools_by_image(tools: DataFrame, size: int = 1000) -> DataFrame:
    """Distinct tools per image (lower case), in parts."""
    pairs = tools.where("image is not null").select(F.lower("image").alias("image"), "tool").distinct()
    return ordered.lists(pairs, ["image"], F.col("tool"), {"tools": F.col("tool")}, size)
