"""Guessing file types by extension and companions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import paths

#: What a present companion adds to a type's score.
COMPANION_REWARD = 20


def guess_types(files: DataFrame, types: DataFrame, inventory: DataFrame) -> DataFrame:
    """Best type per distinct path; `type` and `score` are null when none fits.

    A type fits when the path ends with one of its extensions (the longest counts) and all its
    companions exist; score = extension length + 20 per companion, ties to the earlier catalog entry.
    The suffix match is an equi-join: a path is taken apart only at the extension lengths the catalog
    has, which cannot outnumber the characters of its longest extension.
    """
    exts = types.select("type", "pos", "companions", F.explode("extensions").alias("_ext"))
    lengths = [r[0] for r in exts.select(F.length("_ext")).distinct().collect()]
    distinct = files.select("path").distinct()
    tails = distinct.select("path", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("_n")).where(
        F.length("path") >= F.col("_n")
    ).select("path", F.right("path", F.col("_n")).alias("_ext"))
    fits = tails.join(exts, "_ext").select(
        "path", "type", "pos", "companions",
        (F.length("_ext") + COMPANION_REWARD * F.coalesce(F.size("companions"), F.lit(0))).alias("score"),
    )
    needed = fits.select("path", "type", F.explode("companions").alias("_c")).select(
        "path", "type", paths.companion(F.col("path"), F.col("_c")).alias("_need")
    )
    lacking = needed.join(inventory.select(F.col("path").alias("_need")), "_need", "left_anti").select("path", "type").distinct()
    best = fits.join(lacking, ["path", "type"], "left_anti").groupBy("path").agg(
        F.max_by(F.struct("type", "score"), F.struct(F.col("score"), -F.col("pos"))).alias("_b")
    )
    return distinct.join(best, "path", "left").select("path", "_b.type", "_b.score")
