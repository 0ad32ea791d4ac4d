"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import (
    chat, embedding_join, exact_dedup, fill_middle, html_extract, mixing, ngram_join, packing, substring_dedup, toxicity, url_filter, warc,
)
from flowlens.llm import phrases as collocations
from flowlens.llm.shared import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.embedding_join(table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows are moved and restored; both texts are hashed here."""
    moved = fill_middle.fill_in_middle(table(spark, sf_dir, "documents")).withColumn("output_sha256", F.sha2("output", 256))
    columns = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")
    return fill_middle.restore(moved, columns).select(*columns, F.sha2("text", 256).alias("restored_sha256"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), url_filter.default_rules(spark))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_exact_dedup, op3_substring_dedup, op4_embedding_join, op5_packing, op6_html_extract, op7_warc,
        op8_ngram_join, op9_mixing, op10_chat, op11_fill_middle, op12_url_filter, op13_phrases,
    )
}

SQL: dict[str, str] = {
    "op2_exact_dedup": """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))""",
    "op7_warc": warc.SQL,
    "op10_chat": chat.SQL,
    "op11_fill_middle": fill_middle.SQL,
    "op12_url_filter": url_filter.SQL,
    "op13_phrases": collocations.SQL,
}
