"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.engine import ship
from flowlens.operators.lineage import cut

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^ \t-\r]+"


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def row_digest(df: DataFrame) -> Column:
    """SHA-256 over every column of a row; rows have the same one when they are the same in each column."""
    parts = [F.coalesce(F.concat(F.lit("+"), F.base64(F.col(f"`{c}`").cast("string").cast("binary"))), F.lit("-")) for c in df.columns]
    return F.sha2(F.concat_ws(",", *parts), 256)


#: Keys that may be joined in place: no other key holds more than one of HOT_KEYS parts of the rows.
HOT_KEYS = 1024


def join_hot(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of rows with a table that has each key once; keys that many rows share do not meet in one task.

    The rows are counted by key, combined before the shuffle. Keys with more than one of HOT_KEYS parts
    of all rows number fewer than HOT_KEYS, so what is broadcast of them, and of their rows in `other`,
    has a proven bound; the rows of the other keys are joined over a shuffle. Null keys join with nothing.
    """
    counts = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    limit = (counts.agg(F.sum("_n")).first()[0] or 0) / HOT_KEYS
    hot = F.broadcast(counts.where(F.col("_n") > limit).select(*keys))
    in_place = rows.join(F.broadcast(cut(other.join(hot, keys, "left_semi"))), keys)
    return in_place.unionByName(rows.join(hot, keys, "left_anti").join(other, keys))
