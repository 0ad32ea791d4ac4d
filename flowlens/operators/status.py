"""Status and timeline roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions import status as st
from flowlens.functions import timing
from flowlens.operators import ordered
from flowlens.schema import engine_status_dim, status_dim


def describe(df: DataFrame, col: str = "status") -> DataFrame:
    """Add label, symbol, finality, notification, exit code and colour (a constant 12-row table)."""
    dim = status_dim(df.sparkSession).withColumnRenamed("status", col)
    return df.join(F.broadcast(dim), col, "left")


def map_engine_words(df: DataFrame, word: str, engine: str) -> DataFrame:
    """Engine status words to statuses through the constant mapping table."""
    dim = engine_status_dim(df.sparkSession).where(F.col("engine") == engine).select(
        F.col("word").alias("_word"), F.col("status").alias("_status")
    )
    key = F.lower(word) if engine == "document" else F.col(word)
    known = df.join(F.broadcast(dim), key == F.col("_word"), "left")
    fallback = "failed" if engine == "document" else "queued"
    missing = F.when(F.col(word).isNull(), "processing") if engine == "document" else F.lit(None)
    return known.withColumn("status", F.coalesce("_status", missing, F.lit(fallback))).drop("_word", "_status")


def collapse(df: DataFrame, keys: list[str], ord: str | Column, status: str = "status") -> DataFrame:
    ordc = F.col(ord) if isinstance(ord, str) else ord
    return df.groupBy(*keys).agg(st.collapse(F.col(status), ordc).alias("status"))


def collapse_all(df: DataFrame, ord: str | Column) -> DataFrame:
    """Overall status of a set of submissions and the exit code to leave with."""
    ordc = F.col(ord) if isinstance(ord, str) else ord
    one = df.agg(st.collapse(F.col("status"), ordc).alias("status"), F.count(F.lit(1)).alias("n"))
    return one.withColumn("exit_code", st.exit_code(F.col("status")))


def timeline(events: DataFrame, keys: list[str]) -> DataFrame:
    """Status = latest by date; start = earliest; finish = first final event. All map-side combinable."""
    when = F.struct("date", "seq")
    final = st.is_final(F.col("status"))
    return events.groupBy(*keys).agg(
        F.max_by("status", when).alias("status"),
        F.min("date").alias("start"),
        F.min(F.when(final, F.col("date"))).alias("finish"),
    )


def changes(events: DataFrame, keys: list[str], unit: str | None = None) -> DataFrame:
    """Events whose status differs from the one before in the same run, flagged when they notify."""
    rows, at = ordered.sliced(events, keys, ["date", "seq"], ordered.time_slice(F.col("date"), unit) if unit else None)
    before = ordered.previous(rows, keys, ["date", "seq"], at, "status", "previous").drop(ordered.MADE)
    return before.where(~F.col("status").eqNullSafe(F.col("previous"))).withColumn(
        "notifies", st.notifies(F.col("status"))
    )


def finished(submissions: DataFrame, runs: DataFrame) -> DataFrame:
    """Submissions that have runs, all of them final, and are final themselves."""
    per = runs.groupBy("submission_id").agg(F.bool_and(st.is_final(F.col("status"))).alias("_all"))
    done = per.where("_all").select("submission_id")
    return submissions.where(st.is_final(F.col("status"))).join(
        done, submissions.id == done.submission_id, "left_semi"
    )


def settle_jobs(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Jobs not completed take the final status of a run that did not complete."""
    end = runs.select(F.col("id").alias("run_id"), F.col("status").alias("_run"))
    joined = jobs.join(end, "run_id", "left")
    takes = (F.col("status") != "completed") & (F.col("_run") != "completed")
    return joined.withColumn("status", F.when(takes, F.col("_run")).otherwise(F.col("status"))).drop("_run")


def run_durations(runs: DataFrame, as_of: Column) -> DataFrame:
    """Seconds and text per run; an open run is measured up to `as_of`."""
    end = F.coalesce("finish", as_of)
    secs = timing.rounded_seconds(F.col("start"), end)
    return runs.withColumn("seconds", secs).withColumn("duration", timing.duration_text(secs))


def query_runs(catalog: DataFrame, metadata: DataFrame, status: str | None = None, name: str | None = None) -> DataFrame:
    """Catalogued runs by exact status and case-insensitive name prefix, by start, missing start last."""
    hits = metadata
    if status:
        hits = hits.where(F.col("status") == status)
    if name:
        hits = hits.where(F.lower("name").startswith(name.lower()))
    return (
        catalog.join(hits, catalog.id == hits.submission_id)
        .drop(hits.submission_id)
        .orderBy(F.asc_nulls_last("start"), "id")
    )


def stuck_jobs(jobs: DataFrame, inventory: DataFrame, as_of: Column, min_seconds: int = 600) -> DataFrame:
    """Running jobs with a work folder, unchanged for `min_seconds`, whose script was never written."""
    idle = jobs.where(
        (F.col("status") == "running") & F.col("workdir").isNotNull()
        & (timing.micros_between(F.col("lastupdated"), as_of) >= min_seconds * 1_000_000)
    )
    script = F.concat("workdir", F.lit("/execution/script"))
    return idle.withColumn("_script", script).join(
        inventory.select(F.col("path").alias("_script")), "_script", "left_anti"
    ).drop("_script")
