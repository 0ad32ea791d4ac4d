"""Contigs of interval files against those of references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_contigs(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, "contig").distinct()


#: Registers of a contig sketch, as a power of two. The relative standard error is 1.04 / sqrt(2 ** 14), 0.8 %.
SKETCH_LOG = 14


def contig_sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One distinct-count sketch per key: of at most 16 KiB, exact while few, and kept to be united later without the rows."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg("contig", SKETCH_LOG).alias("sketch"), F.count("contig").alias("intervals"))


def unite_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches united per coarser key; a contig that several files name counts once. Combines map-side."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("intervals").alias("intervals"))


def contig_profile(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Approximate distinct contigs per key, null contigs left out; see SKETCH_LOG for the error."""
    return estimate(contig_sketches(rows, keys))


def estimate(sketches: DataFrame) -> DataFrame:
    """Sketches as estimated numbers of contigs."""
    return sketches.withColumn("contigs", F.hll_sketch_estimate("sketch")).drop("sketch")


def missing_contigs(intervals: DataFrame, references: DataFrame) -> DataFrame:
    """Contigs of each interval input that a reference of its workflow lacks.

    `intervals`: workflow, input, contig. `references`: workflow, ref, contig. Every reference is
    checked; one without contigs has no rows and so checks nothing. Inputs are reduced to distinct
    contigs before any join.
    """
    known = references.select("workflow", "ref", "contig").distinct()
    refs = known.select("workflow", "ref").distinct()
    used = distinct_contigs(intervals, ["workflow", "input"])
    return used.join(refs, "workflow").join(known, ["workflow", "ref", "contig"], "left_anti")


def summarise_missing(missing: DataFrame, keys: list[str]) -> DataFrame:
    """Missing-contig count, with all names when fewer than five, else the first three."""
    counts = missing.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy("contig")
    few = missing.withColumn("_rn", F.row_number().over(w)).where("_rn <= 4").groupBy(*keys).agg(
        F.sort_array(F.collect_list("contig")).alias("_c")
    )
    text = F.when(F.col("n") < 5, F.array_join("_c", ", ")).otherwise(F.concat(F.array_join(F.slice("_c", 1, 3), ", "), F.lit("...")))
    return counts.join(few, keys).select(*keys, "n", text.alias("examples"))
