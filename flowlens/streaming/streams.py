"""Streams over all runs at once: changes, completions, silences, error streaks, scopes, upserts.

State is one small row per run (or submission). It is dropped where the state itself says that it can
no longer matter, never for its age, so a run that pauses for months goes on where it was. Streams that
follow a run's order keep the place of the last row; a row that comes from before it is passed on
marked `late`, and counts for nothing else. Where a watermark decides, `progress` counts what it dropped.
A micro-batch's rows of one key are handled together, so limit the source's rate (`maxFilesPerTrigger`,
`maxOffsetsPerTrigger`) as for any keyed state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from flowlens.functions import status as st
from flowlens.operators import store, telemetry
from flowlens.operators.lineage import remove
from flowlens.schema import FINAL_STATUSES, NOTIFY_STATUSES, SPECS
from flowlens.streaming.scopes import EVENTS, Scopes

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rows(pdfs: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(pdfs), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)


def _ms(ts: pd.Timestamp) -> int:
    return ts.value // 1_000_000


def _us(dates: pd.Series) -> pd.Series:
    return dates.astype("datetime64[us]").astype("int64")


def _expire(state: GroupState, last: pd.Timestamp, idle_ms: int) -> None:
    state.setTimeoutTimestamp(max(_ms(last) + idle_ms, state.getCurrentWatermarkMs() + 1))


def _timed(events: DataFrame, key: str, late: str, fn, out: str, kept: str) -> DataFrame:
    return events.withWatermark("date", late).groupBy(key).applyInPandasWithState(
        fn, out, kept, "append", GroupStateTimeout.EventTimeTimeout
    )


def _kept(events: DataFrame, key: str, fn, out: str, kept: str) -> DataFrame:
    return events.groupBy(key).applyInPandasWithState(fn, out, kept, "append", GroupStateTimeout.NoTimeout)


def _rocks(df: DataFrame) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df


def status_changes(events: DataFrame) -> DataFrame:
    """Events (run_id, seq, date, status) whose status differs from the run's last one, and late events.

    A late event comes by (date, seq) before one that an earlier micro-batch had: it is marked `late`,
    has no previous status and notifies nobody.
    """
    def fn(key, pdfs, state):
        rows = _rows(pdfs, ["date", "seq"])
        status, us, seq = state.get if state.exists else (None, None, None)
        at = _us(rows["date"])
        rows["late"] = False if us is None else (at < us) | ((at == us) & (rows["seq"] < seq))
        late, rows = rows[rows["late"]].assign(previous=None, notifies=False), rows[~rows["late"]].copy()
        if len(rows):
            before = rows["status"].shift(1)
            before.iloc[0] = status
            rows["previous"] = before
            state.update((rows["status"].iloc[-1], int(at.iloc[-1]), int(rows["seq"].iloc[-1])))
            rows["notifies"] = rows["status"].isin(NOTIFY_STATUSES)
            rows = rows[rows["previous"].isna() | (rows["status"] != rows["previous"])]
        for part in (rows, late):
            if len(part):
                yield part[["run_id", "seq", "date", "status", "previous", "notifies", "late"]]

    out = "run_id string, seq long, date timestamp, status string, previous string, notifies boolean, late boolean"
    return _kept(events, "run_id", fn, out, "status string, at long, seq long")


def completions(events: DataFrame) -> DataFrame:
    """A run (run_id, seq, date, status) once, when it first reaches a final state or the end of execution.

    Of several in one micro-batch the first by (date, seq) is it. That a run was passed on is kept for good.
    """
    def fn(key, pdfs, state):
        if not state.exists:
            state.update((True,))
            yield _rows(pdfs, ["date", "seq"]).iloc[:1][["run_id", "seq", "date", "status"]]

    done = events.where(F.col("status").isin([*FINAL_STATUSES, "execution-ended"]))
    return _kept(done, "run_id", fn, "run_id string, seq long, date timestamp, status string", "done boolean")


def execution_ended(events: DataFrame) -> DataFrame:
    return events.withColumn("status", st.execution_ended(F.col("status")))


def silences(contacts: DataFrame, minutes: int = 10, late: str = "1 minute") -> DataFrame:
    """A suspension for each contact followed by more than `minutes` of nothing."""
    limit = pd.Timedelta(minutes=minutes)

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            last, seq = pd.Timestamp(state.get[0], unit="us"), state.get[1]
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "seq": [seq], "last_contact": [last], "suspended_at": [last + limit], "status": ["suspended"]})
            return
        rows = _rows(pdfs, ["date", "seq"])[["date", "seq"]]
        if state.exists:
            first = pd.DataFrame({"date": [pd.Timestamp(state.get[0], unit="us")], "seq": [state.get[1]]})
            rows = pd.concat([first, rows], ignore_index=True).sort_values(["date", "seq"], kind="stable", ignore_index=True)
        last = rows["date"].iloc[-1]
        state.update((last.value // 1000, int(rows["seq"].iloc[-1])))
        _expire(state, last, int(limit.total_seconds() * 1000) + 1)
        gone = rows[(rows["date"].shift(-1) - rows["date"]) > limit]
        if len(gone):
            yield pd.DataFrame({
                "run_id": key[0], "seq": gone["seq"], "last_contact": gone["date"], "suspended_at": gone["date"] + limit, "status": "suspended",
            })

    out = "run_id string, seq long, last_contact timestamp, suspended_at timestamp, status string"
    return _timed(contacts, "run_id", late, fn, out, "last long, seq long")


def error_streaks(polls: DataFrame, kind: str, limit: int) -> DataFrame:
    """Polls (run_id, seq, outcome) with `kind` errors since the last success, and the verdict.

    A poll with a lower `seq` than an earlier micro-batch had is marked `late`, without count or verdict.
    """
    def fn(key, pdfs, state):
        rows = _rows(pdfs, ["seq"])
        start, last = state.get if state.exists else (0, None)
        rows["late"] = False if last is None else rows["seq"] < last
        late, rows = rows[rows["late"]].assign(errors=None, failed=None), rows[~rows["late"]].copy()
        if len(rows):
            ok, err = rows["outcome"] == "ok", (rows["outcome"] == kind).astype("int64")
            counted = err.groupby(ok.cumsum()).cumsum()
            rows["errors"] = counted + start * (ok.cumsum() == 0)
            rows["failed"] = rows["errors"] > limit
            state.update((int(rows["errors"].iloc[-1]), int(rows["seq"].iloc[-1])))
        for part in (rows, late):
            if len(part):
                yield part[["run_id", "seq", "outcome", "errors", "failed", "late"]]

    out = "run_id string, seq long, outcome string, errors long, failed boolean, late boolean"
    return _kept(polls, "run_id", fn, out, "errors long, seq long")


class Verdicts(StatefulProcessor):
    """Per submission: the mark of its last check. Only an unhealthy one is kept, as a healthy one cannot lead to an abort."""

    def init(self, handle) -> None:
        self.mark = handle.getValueState("mark", "mark string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        checks = _rows(rows, ["tick"])
        bad = (checks["stuck_jobs"] > 0) & (checks["stuck_jobs"] == checks["checked"])
        mark = (checks["digest"] + " " + checks["checked"].astype(str)).where(bad, None)
        before = mark.shift(1)
        before.iloc[0] = self.mark.get()[0] if self.mark.exists() else None
        if bad.iloc[-1]:
            self.mark.update((mark.iloc[-1],))
        else:
            self.mark.clear()
        yield checks.assign(unhealthy=bad, abort=bad & (mark == before))[["submission_id", "tick", "checked", "stuck_jobs", "unhealthy", "abort"]]

    def close(self) -> None:
        pass


def health_checks(observed: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Verdicts per check from observed running jobs (submission_id, tick, date, job_id, stuck).

    `date` is the check's time: rows of a check fall in one window of `width`. Two aggregations reduce a
    check to its counts and to a sum of hashes of its stuck jobs, in any order and split; the watermark
    closes it, and its verdict meets that of the check before. Needs the RocksDB state store, which this
    sets for the session.
    """
    jobs = observed.withWatermark("date", late).groupBy(F.window("date", width).alias("at"), "submission_id", "tick", "job_id").agg(F.bool_and("stuck").alias("stuck"))
    digest = [F.sum(F.when(F.col("stuck"), F.xxhash64("job_id", F.lit(salt)).cast("decimal(20,0)"))).cast("string") for salt in (1, 2)]
    checks = jobs.groupBy(F.window(F.window_time("at"), width).alias("at"), "submission_id", "tick").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if("stuck").alias("stuck_jobs"), F.concat_ws(" ", *digest).alias("digest")
    )

    out = "submission_id string, tick long, checked long, stuck_jobs long, unhealthy boolean, abort boolean"
    return _rocks(checks.drop("at")).groupBy("submission_id").transformWithStateInPandas(Verdicts(), out, outputMode="Append", timeMode="None")


def step_events(lines: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Step events with nested workflow scope from log lines (run_id, line_no, date, line).

    Dates do not fall as line numbers rise. A line is judged once the watermark has passed it, with all
    lines before it. Needs the RocksDB state store, which this sets for the session.
    """
    hits = telemetry.step_lines(lines).where(F.col("component").isin("workflow", "step")).drop("line")
    return _rocks(hits).withWatermark("date", late).groupBy("run_id").transformWithStateInPandas(
        Scopes(), EVENTS, outputMode="Append", timeMode="EventTime"
    )


def counted(df: DataFrame, name: str = "feed", **counts: Column) -> DataFrame:
    """The rows unchanged, with their number and further aggregates observed as they pass; a batch or a stream."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()])


def progress(query: StreamingQuery, name: str = "feed") -> list[dict]:
    """Per recent micro-batch: its number, what `counted` observed, and the late rows its watermarks dropped."""
    return [
        {
            "batch": p.batchId, **(p.observedMetrics[name].asDict() if name in p.observedMetrics else {}),
            "dropped": sum(o.numRowsDroppedByWatermark for o in p.stateOperators),
        }
        for p in query.recentProgress
    ]


def upsert_jobs(events: DataFrame, root: str, scope: dict[str, Column], at: Column, final_step: str = "") -> Callable:
    """Start a stream of webhook events into the store's `jobs` table.

    Each field keeps its newest value by event time, so a batch that is repeated, split or arrives late
    gives the same table. `scope` gives submission_id and run_id. Returns a function that starts the query at a checkpoint.
    """
    tagged = events.select("*", *[c.alias(n) for n, c in scope.items()], at.alias("_at"))
    keys = list(scope)

    def each(batch: DataFrame, _epoch: int) -> None:
        started = telemetry.webhook_jobs(batch, [*keys, "_at"], F.col("_at"), final_step)
        cached = telemetry.cached_jobs(batch, [*keys, "_at"], F.col("_at"))
        rows = started.unionByName(cached, allowMissingColumns=True).withColumnRenamed("_at", "seq")
        store.merge(batch.sparkSession, root, SPECS["jobs"], rows, seq="seq")

    def start(checkpoint: str, **trigger):
        return tagged.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    return start


def live_board(snapshots: DataFrame, out: str, state: str, max_skips: int = 20) -> Callable:
    """Write only the runs worth refreshing from each snapshot of (run_id, last_updated, status, ...).

    A run is written when it is new, its update time advanced, it was skipped more than `max_skips`
    times, or it is finished. The last written time and the skip count are a small table per batch
    number, so a repeated batch reads the same state and writes the same rows.
    """
    def each(batch: DataFrame, epoch: int) -> None:
        spark: SparkSession = batch.sparkSession
        shown = "run_id string, _shown timestamp, _skips int"
        before = spark.read.schema(shown).parquet(f"{state}/{epoch - 1}") if epoch else spark.createDataFrame([], shown)
        newest = batch.groupBy("run_id").agg(F.max_by(F.struct(*batch.columns), "last_updated").alias("_r")).select("_r.*")
        seen = newest.join(before, "run_id", "full_outer")
        here = F.col("status").isNotNull()
        finished = F.coalesce(F.col("status").isin(FINAL_STATUSES), F.lit(False))
        due = here & (
            F.col("_skips").isNull() | F.coalesce(F.col("last_updated") > F.col("_shown"), F.lit(False))
            | (F.col("_skips") > max_skips) | finished
        )
        judged = seen.withColumn("_due", due)
        judged.where("_due").select(*batch.columns).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        kept = judged.where(~finished).select(
            "run_id", F.when(F.col("_due"), F.col("last_updated")).otherwise(F.col("_shown")).alias("_shown"),
            F.when(F.col("_due"), 0).when(here, F.col("_skips") + 1).otherwise(F.col("_skips")).alias("_skips"),
        )
        kept.write.mode("overwrite").parquet(f"{state}/{epoch}")
        if epoch > 1:  # a repeated batch reads no more than the one before it
            remove(spark, f"{state}/{epoch - 2}")

    def start(checkpoint: str, **trigger):
        return snapshots.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    return start
