"""Container image references: parse, classify, rebuild."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The shape of an image reference that has a slash, and of a digest.
IMAGE_PATTERN = (
    r"^([a-z0-9]+(?:[._-][a-z0-9]+)*(?::[0-9]+)?(?:/[a-z0-9]+(?:[._-][a-z0-9]+)*)*)"
    r"(?::([A-Za-z0-9]+(?:[-.:_A-Za-z0-9]+)*))?"
    r"(?:@([A-Za-z0-9]+(?:[-.:_A-Za-z0-9]+)*))?"
)
DIGEST_PATTERN = r"^([a-zA-Z0-9_+.-]+):([a-zA-Z0-9]+)"


def parse(df: DataFrame, source: str) -> DataFrame:
    """Add `valid, host, repository, image, tag, digest` of an image reference; an invalid text gives nulls.

    Staged projections: each stage names what the next one uses more than once, so expressions stay small.
    """
    src = F.col(source)

    def group(n: int) -> Column:
        return F.nullif(F.regexp_extract(src, IMAGE_PATTERN, n), F.lit(""))

    keep = [F.col(c) for c in df.columns]
    split = df.select(
        *keep, src.contains("/").alias("_slashed"), src.contains("@").alias("_at"),
        F.when(src.contains("@"), F.split(src, "@")).otherwise(F.split(src, ":")).alias("_pieces"),
        group(1).alias("_g1"), group(2).alias("_g2"), group(3).alias("_g3"),
    )
    second = F.get("_pieces", F.lit(1))
    by_digest = F.col("_at") & second.rlike(DIGEST_PATTERN)
    named = split.select(
        *keep,
        # One struct through `inline`: later filters stay above it instead of being rewritten over
        # the whole expression, which would outgrow a generated method.
        F.inline(
            F.array(
                F.struct(
                    F.col("_slashed"), F.col("_pieces"),
                    F.when(F.col("_slashed"), F.col("_g1")).otherwise(F.get("_pieces", F.lit(0))).alias("_name"),
                    F.when(F.col("_slashed"), F.col("_g2")).otherwise(F.when(~by_digest, second)).alias("_tag"),
                    F.when(F.col("_slashed"), F.col("_g3")).otherwise(F.when(by_digest, second)).alias("_digest"),
                )
            )
        ),
    )
    valid = F.when(
        F.col("_slashed"),
        F.col("_name").isNotNull() & (F.col("_digest").isNull() | F.col("_digest").rlike(DIGEST_PATTERN)),
    ).otherwise(F.size("_pieces") <= 2)
    parted = named.select(
        *keep, F.coalesce(valid, F.lit(False)).alias("valid"), F.split("_name", "/").alias("_parts"), "_tag", "_digest"
    )
    first, n = F.get("_parts", F.lit(0)), F.size("_parts")
    hosted = (n > 1) & (first.contains(".") | F.lower(first).startswith("localhost"))
    placed = parted.select("*", F.when(hosted, 1).otherwise(0).alias("_skip"))
    ok, skip = F.col("valid"), F.col("_skip")
    middle = F.array_join(F.slice("_parts", skip + 1, F.greatest(n - 1 - skip, F.lit(0))), "/")
    return placed.select(
        *keep, "valid", F.when(ok & (skip == 1), first).alias("host"), F.when(ok, F.nullif(middle, F.lit(""))).alias("repository"),
        F.when(ok, F.get("_parts", n - 1)).alias("image"),
        F.when(ok & F.col("_digest").isNull(), F.coalesce("_tag", F.lit("latest"))).alias("tag"),
        F.when(ok, F.col("_digest")).alias("digest"),
    )


def registry(host: Column) -> Column:
    return (
        F.when(F.coalesce(host, F.lit("")) == "", "dockerhub")
        .when(host.contains("quay.io"), "quay")
        .when(host.contains("gcr"), "gcr")
        .otherwise("custom")
    )


def rebuild(host: Column, repository: Column, image: Column, tag: Column, digest: Column) -> Column:
    end = F.coalesce(F.concat(F.lit("@"), digest), F.concat(F.lit(":"), tag), F.lit(""))
    return F.concat(F.concat_ws("/", host, repository, image), end)


def file_safe(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_")
