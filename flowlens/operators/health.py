"""Health over time: stuck sets, silent runs, error streaks, completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions import status as st
from flowlens.functions import timing
from flowlens.operators import ordered
from flowlens.operators.lineage import cut
from flowlens.schema import FINAL_STATUSES


def health_checks(observed: DataFrame, slice_size: int | None = None) -> DataFrame:
    """Verdict per (submission_id, tick) from observed running jobs (submission_id, tick, job_id, stuck).

    Unhealthy when every checked job is stuck; abort when the check before was unhealthy with the
    same set. Sets are compared by how many members stayed, never gathered.
    """
    marks = cut(observed.groupBy("submission_id", "job_id", "tick").agg(F.bool_and("stuck").alias("stuck")))
    given = ordered.number_slice(F.col("tick"), slice_size) if slice_size else None
    rows, at = ordered.sliced(marks.where("stuck"), ["submission_id", "job_id"], ["tick"], given)
    stuck = ordered.previous(rows, ["submission_id", "job_id"], ["tick"], at, "tick", "_seen")
    stayed = stuck.groupBy("submission_id", "tick", "_seen").agg(F.count(F.lit(1)).alias("_stayed"))
    per_tick = marks.groupBy("submission_id", "tick").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if("stuck").alias("stuck_jobs")
    )
    bad = (F.col("stuck_jobs") > 0) & (F.col("stuck_jobs") == F.col("checked"))
    state = F.struct("tick", "checked", bad.alias("bad"))
    checks, at = ordered.sliced(per_tick.withColumn("unhealthy", bad).withColumn("_state", state), ["submission_id"], ["tick"], given)
    ticks = ordered.previous(checks, ["submission_id"], ["tick"], at, "_state", "_before").withColumn("_seen", F.col("_before.tick"))
    same = (
        F.col("unhealthy") & F.coalesce("_before.bad", F.lit(False))
        & (F.col("_before.checked") == F.col("checked")) & (F.col("_stayed") == F.col("stuck_jobs"))
    )
    return ticks.join(stayed, ["submission_id", "tick", "_seen"], "left").select(
        "submission_id", "tick", "checked", "stuck_jobs", "unhealthy", F.coalesce(same, F.lit(False)).alias("abort")
    )


def completions(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each run once, when it first reaches a final state or the end of execution."""
    done = events.where(st.is_final(F.col("status")) | (F.col("status") == "execution-ended"))
    when = F.struct("date", "seq")
    return done.groupBy(*keys).agg(
        F.min_by("status", when).alias("status"), F.min("date").alias("date"), F.min_by("seq", when).alias("seq")
    )


def silences(contacts: DataFrame, keys: list[str], as_of: Column, minutes: int = 10, unit: str | None = None) -> DataFrame:
    """Suspensions: a contact followed by more than `minutes` of nothing (or by nothing up to `as_of`)."""
    rows, at = ordered.sliced(contacts, keys, ["date", "seq"], ordered.time_slice(F.col("date"), unit) if unit else None)
    after = ordered.following(rows, keys, ["date", "seq"], at, "date", "next_contact")
    limit = minutes * 60 * 1_000_000
    gap = timing.micros_between(F.col("date"), F.coalesce("next_contact", as_of))
    return after.where(gap > limit).select(
        *keys, "seq", F.col("date").alias("last_contact"), "next_contact",
        F.expr(f"date + interval '{minutes}' minute").alias("suspended_at"), F.lit("suspended").alias("status"),
    )


def error_streaks(polls: DataFrame, keys: list[str], kind: str, limit: int, slice_size: int | None = None) -> DataFrame:
    """Polls with the count of `kind` errors since the last success, and whether it passed the limit.

    `polls`: keys, seq, outcome (`ok` or an error kind). A success resets the count.
    """
    rows, sl = ordered.sliced(polls, keys, ["seq"], ordered.number_slice(F.col("seq"), slice_size) if slice_size else None)
    counted = ordered.running_sum(
        rows.withColumn("_err", (F.col("outcome") == kind).cast("int")), keys, ["seq"], sl, "_err", "_total"
    ).withColumn("_at_ok", F.when(F.col("outcome") == "ok", F.col("_total")))
    since = ordered.last_known(counted, keys, ["seq"], sl, "_at_ok", "_base")
    errors = F.col("_total") - F.coalesce("_base", F.lit(0))
    return since.select(*polls.columns, errors.cast("bigint").alias("errors")).withColumn("failed", F.col("errors") > limit)


def live_board(polls: DataFrame, order_by: list[str], max_skips: int = 20) -> DataFrame:
    """The polls of each run that are worth showing: batch twin of the live board's stream.

    `polls`: run_id, last_updated, status, and columns that order a run's polls. A poll is due when the run is new, its
    update time advanced, it is finished, or it was finished and came back; in between, an unchanged run is due each
    time more than `max_skips` polls were skipped. `last_updated` is not null and does not fall along a run's polls.
    """
    key = ["run_id"]
    rows, at = ordered.slices(polls, key, order_by)
    stood = F.struct("last_updated", F.coalesce(F.col("status").isin(FINAL_STATUSES), F.lit(False)).alias("done"))
    seen = ordered.previous(rows.withColumn("_now", stood), key, order_by, at, "_now", "_before")
    forced = F.col("_before").isNull() | (F.col("last_updated") > F.col("_before.last_updated")) | F.col("_now.done") | F.col("_before.done")
    placed = ordered.position(seen, key, order_by, at, "_pos").withColumn("_anchor", F.when(forced, F.col("_pos")))
    since = ordered.last_known(placed, key, order_by, at, "_anchor", "_from")
    return since.where((F.col("_pos") - F.col("_from")) % (max_skips + 2) == 0).select(*polls.columns)
