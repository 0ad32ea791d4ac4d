"""The corpus pipeline: filter, dedup, mix and pack the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.engine import ship
from flowlens.llm import exact_dedup, mixing, ngram_join, packing
from flowlens.llm import toxicity as tox
from flowlens.llm.shared import row_digest, table
from flowlens.operators.lineage import cut

#: The columns that every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    ship(spark)
    return docs.select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose score is at the threshold or above; a null or empty text scores 0 and stays."""
    rows = _rows(spark, docs)
    model = tox.fit(rows, table(spark, sf_dir, "labels"))
    return tox.score(rows, model, name="_score").where(F.col("_score") < tox.THRESHOLD).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of equal texts the row with the largest id; of rows that repeat id and text one stays."""
    def key(sha: Column) -> Column:
        """One value for each (id, text): copies with different ids do not meet in one task."""
        return F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), sha), 256)

    rows = _rows(spark, docs)
    kept = cut(exact_dedup.exact_dedup(rows).where("kept").select(key(F.col("text_sha256")).alias("_key")))
    keyed = rows.withColumn("_key", key(F.sha2(F.coalesce("text", F.lit("")), 256)))
    return keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of linked documents the one with the smallest id; rows with a null id link with nothing and stay."""
    rows = _rows(spark, docs)
    found = ngram_join.ngram_join(rows)
    gone = cut(found.where("doc_id <> component_id").select("doc_id").distinct())
    return rows.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it. Documents without words carry no weight in it and stay as they are."""
    rows = _rows(spark, docs)
    rows = rows.withColumn("_row", row_digest(rows))
    mixed = mixing.mix(rows, carry=("_row",))
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(1))
    # Rows with the same digest are alike in every column, so their copies may be added up.
    total = cut(mixed.groupBy("_row").agg(F.sum(copies).cast("int").alias("_copies")).where("_copies > 0"))
    return (
        rows.join(total, "_row").dropDuplicates(["_row"])
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select(*COLUMNS)
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of each document of the mix."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mix), ("packing", pack)]

#: The learned filter and the random mix are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
