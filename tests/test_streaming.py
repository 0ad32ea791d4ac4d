"""Streams fed file by file give what their batch twins give."""

import datetime as dt
import json
import os
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlens.operators import health, status as sta, store, telemetry as tel
from flowlens.plans.adapter import Tables
from flowlens.schema import SPECS
from flowlens.sources import documents
from flowlens.streaming import scopes, streams


def feed(spark, tmp_path, df, order, parts=4):
    """Write rows as a few files in `order`, then read them back one file per micro-batch."""
    path = str(tmp_path / uuid.uuid4().hex)
    rows = df.orderBy(*order).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def drain(stream, spark):
    name = "m" + uuid.uuid4().hex
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def events(spark, small_dir):
    t = Tables(spark, small_dir)
    return t.runstatus.withColumn("date", F.col("date").cast("timestamp"))


def test_status_changes(spark, tmp_path, events):
    got = drain(streams.status_changes(feed(spark, tmp_path, events, ["seq"])), spark)
    want = sta.changes(events, ["run_id"]).select("run_id", "seq", "date", "status", "previous", "notifies")
    assert got.where("late").isEmpty() and rows(got.drop("late")) == rows(want)


def test_status_changes_after_months_and_late(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    data = [("a", 1, day(0), "running"), ("b", 1, day(200), "queued"), ("a", 2, day(300), "running"), ("a", 0, day(-1), "queued")]
    events = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], "run_id string, seq long, date timestamp, status string, i int")
    got = drain(streams.status_changes(feed(spark, tmp_path, events, ["i"])), spark)
    assert [(r.run_id, r.seq, r.previous) for r in got.where("not late").collect()] == [("a", 1, None), ("b", 1, None)]
    assert [(r.run_id, r.seq, r.status, r.notifies) for r in got.where("late").collect()] == [("a", 0, "queued", False)]


def test_completions(spark, tmp_path, events):
    got = drain(streams.completions(feed(spark, tmp_path, events, ["seq"])), spark)
    want = health.completions(events, ["run_id"])
    assert rows(got.select("run_id", "seq", "status")) == rows(want.select("run_id", "seq", "status"))


def test_execution_ended(spark, tmp_path, events):
    got = drain(streams.execution_ended(feed(spark, tmp_path, events, ["seq"])), spark)
    assert got.where("status = 'execution-ended'").count() == events.where("status = 'completed'").count() > 0


def test_silences(spark, tmp_path, events):
    got = drain(streams.silences(feed(spark, tmp_path, events, ["seq"]), minutes=600), spark).select("run_id", "seq", "last_contact", "suspended_at")
    want = health.silences(events, ["run_id"], F.lit(None).cast("timestamp"), minutes=600).select("run_id", "seq", "last_contact", "suspended_at")
    # The stream also ends the runs that fell silent before the last watermark.
    tails = {r for r in rows(got)} - {r for r in rows(want)}
    assert {r for r in rows(want)} <= {r for r in rows(got)}
    last = {(r.run_id, r.seq) for r in events.groupBy("run_id").agg(F.max("seq").alias("seq")).collect()}
    assert {(t[0], t[1]) for t in tails} <= last


def test_error_streaks(spark, tmp_path, events):
    polls = events.select("run_id", "seq", "date", F.expr("case status when 'completed' then 'ok' when 'queued' then 'connection' else 'metadata' end").alias("outcome"))
    got = drain(streams.error_streaks(feed(spark, tmp_path, polls, ["seq"]), "metadata", 5), spark)
    want = health.error_streaks(polls.drop("date"), ["run_id"], "metadata", 5)
    assert got.where("late").isEmpty() and rows(got.drop("late")) == rows(want.select("run_id", "seq", "outcome", "errors", "failed"))


def test_error_streak_goes_on_after_a_long_pause(spark, tmp_path):
    polls = spark.createDataFrame([("a", i, "metadata", dt.datetime(2024, i + 1, 1)) for i in range(4)] + [("a", 1, "ok", dt.datetime(2024, 12, 1))],
                                  "run_id string, seq long, outcome string, date timestamp")
    got = drain(streams.error_streaks(feed(spark, tmp_path, polls, ["date"], 5), "metadata", 3), spark).collect()
    assert sorted((r.seq, r.errors, r.failed) for r in got if not r.late) == [(0, 1, False), (1, 2, False), (2, 3, False), (3, 4, True)]
    assert [(r.seq, r.errors) for r in got if r.late] == [(1, None)]


def test_health_checks(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    data = [(f"s{s}", tick, start + dt.timedelta(minutes=15 * tick), str(j), (tick * (s + 2) + j * s) % 5 < 3 + s % 3)
            for tick in range(12) for s in range(4) for j in range(2)]
    obs = spark.createDataFrame(data, "submission_id string, tick long, date timestamp, job_id string, stuck boolean")
    after = spark.createDataFrame([("end", 10 ** 6, start + dt.timedelta(days=400), "0", False)], obs.schema)
    # Five files cut through checks, and the jobs of two checks in a row are mixed.
    split = feed(spark, tmp_path, obs.unionByName(after).withColumn("at", F.expr("tick div 2")), ["at", "job_id", "tick"], 5)
    got = drain(streams.health_checks(split, late="40 minutes"), spark).where("submission_id <> 'end'")
    want = health.health_checks(obs)
    assert rows(got) == rows(want)
    assert want.where("abort").count() > 0


def test_step_events(spark, tmp_path, small_dir):
    t = Tables(spark, small_dir)
    lines = t.event_lines.join(t.events.select(F.col("event_id").alias("line_no"), F.col("ts").cast("timestamp").alias("date")), "line_no")
    after = spark.createDataFrame([("end", 10 ** 9, dt.datetime(2100, 1, 1), "INFO [step x] start")], "run_id string, line_no long, date timestamp, line string")
    source = lines.select("run_id", F.col("line_no").cast("long"), "date", "line").unionByName(after)
    got = drain(streams.step_events(feed(spark, tmp_path, source, ["line_no"])), spark).where("run_id <> 'end'")
    assert rows(got) == rows(tel.step_scopes(t.event_lines, slice_size=50))


def log(runs, size):
    """Lines with nested, unmatched and unnamed workflow steps, a second apart."""
    acts = ["[workflow w{}] start", "[step s{}] start", "[workflow] start", "[workflow v{}] start", "[step s{}] completed success", "[workflow v{}] completed success", "[step] start", "[workflow w{}] completed success", "[workflow] completed success"]
    start = dt.datetime(2024, 1, 1)
    return [(f"r{r}", i, start + dt.timedelta(seconds=i), "INFO " + acts[(i * i + 3 * i * r + i // 7) % len(acts)].format(i % 5)) for r in range(runs) for i in range(size)]


def test_step_events_shuffled_and_split(spark, tmp_path):
    lines = spark.createDataFrame(log(3, 400), "run_id string, line_no long, date timestamp, line string")
    after = spark.createDataFrame([("end", 1, dt.datetime(2100, 1, 1), "INFO [step x] start")], lines.schema)
    # Lines move by up to nine minutes against each other.
    moved = lines.unionByName(after).withColumn("at", F.unix_timestamp("date") + F.pmod(F.xxhash64("run_id", "line_no"), F.lit(540)))
    got = drain(streams.step_events(feed(spark, tmp_path, moved, ["at"], 8)), spark).where("run_id <> 'end'")
    want = tel.step_scopes(lines.select("run_id", "line_no", "line"))
    assert rows(got) == rows(want) and want.where("parent like '%\\_%'").count() > 0


def test_stack_effects_compose():
    hits = []
    for _, line, date, text in log(1, 300):
        words, action = text[6:].split("] ")
        component, _, step = words.partition(" ")
        hits.append((line, date, component, step, action))
    whole = pd.DataFrame(hits, columns=["line_no", "date", "component", "step", "action"])
    events, kept, pushed = scopes.stretch(whole, [])
    assert kept == 0
    for size in (1, 7, 64):
        stack, parts = [], []
        for i in range(0, len(whole), size):
            got, keep, more = scopes.stretch(whole.iloc[i:i + size], stack)
            stack = stack[:keep] + more
            parts.append(got)
        joined = pd.concat([p for p in parts if len(p)], ignore_index=True)
        assert stack == pushed and joined.astype(object).where(joined.notna(), None).values.tolist() == events.astype(object).where(events.notna(), None).values.tolist()


def test_progress_counts_rows_without_a_second_pass(spark, tmp_path, events):
    stream = streams.counted(feed(spark, tmp_path, events, ["seq"]), final=F.count_if(F.col("status") == "completed"))
    query = stream.writeStream.format("noop").trigger(availableNow=True).start()
    query.awaitTermination(120)
    feed_ = streams.progress(query)
    assert sum(p["rows"] for p in feed_ if "rows" in p) == events.count() and len(feed_) >= 4
    assert sum(p["final"] for p in feed_ if "final" in p) == events.where("status = 'completed'").count()


@pytest.mark.parametrize("order", [[0, 1, 2, 3, 4, 5], [5, 4, 3, 2, 1, 0], [2, 5, 0, 3, 1, 4]])
def test_webhook_events_upsert_the_store(spark, tmp_path, order):
    def process(i, name, status):
        return json.dumps({"event": "process_x", "utcTime": f"2024-01-01T00:00:{i:02d}Z", "runId": "r1",
                           "trace": {"name": name, "process": "p", "task_id": "1", "workdir": "/w/1/", "exit": "0", "native_id": "7", "container": "ubuntu", "status": status}})

    lines = [process(1, "a", "SUBMITTED"), process(2, "a", "RUNNING"), process(5, "a", "COMPLETED"), process(3, "b", "RUNNING"), '{"event": "started"}',
             json.dumps({"event": "completed", "utcTime": "2024-01-01T00:00:09Z", "runId": "r1",
                         "metadata": {"workflow": {"workflowStats": {"processes": [{"name": "c", "cached": 1, "errored": False}, {"name": "n", "cached": 0, "errored": False}]}}}})]
    src = tmp_path / "in"
    src.mkdir()
    for k, i in enumerate(order):  # the source reads files by their time
        (src / f"{i}.json").write_text(lines[i] + "\n")
        os.utime(src / f"{i}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    events = documents.webhook_events(spark.readStream.option("maxFilesPerTrigger", 2).text(str(src)))
    root = str(tmp_path / "store")
    at = F.to_timestamp("utcTime")
    start = streams.upsert_jobs(events, root, {"submission_id": F.lit("s"), "run_id": F.col("runId")}, at)
    start(str(tmp_path / "ck"), availableNow=True).awaitTermination(180)
    jobs = {r.id: r for r in store.read(spark, root, SPECS["jobs"]).collect()}
    assert set(jobs) == {"a", "b", "c"}
    assert jobs["a"].status == "completed" and jobs["a"].start.second == 2 and jobs["a"].finish.second == 5 and jobs["a"].stderr == "/w/1/.command.err"
    assert jobs["b"].status == "running" and jobs["c"].cached and jobs["c"].status == "completed"


def test_live_board_writes_only_what_changed(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    schema = "run_id string, last_updated timestamp, status string"
    polls = [[("a", at, "running"), ("b", at, "running")], [("a", at, "running"), ("b", at + dt.timedelta(seconds=5), "running")],
             [("a", at, "completed"), ("b", at + dt.timedelta(seconds=5), "running")]] + [[("b", at + dt.timedelta(seconds=5), "running")]] * 21
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    class Sink:
        def foreachBatch(self, fn):
            self.fn = fn
            return self

        def option(self, *_):
            return self

        def trigger(self, **_):
            return self

        def start(self):
            return self.fn

    class Source:
        writeStream = Sink()

    each = streams.live_board(Source(), out, state)("unused")
    for epoch, rows_ in enumerate(polls):
        each(spark.createDataFrame(rows_, schema), epoch)
    shown = {(r.epoch, r.run_id) for r in spark.read.option("basePath", out).schema(schema + ", epoch int").parquet(out).collect()}
    assert shown == {(0, "a"), (0, "b"), (1, "b"), (2, "a"), (23, "b")}


def test_live_board_equals_its_twin(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    schema = "run_id string, last_updated timestamp, status string"
    polls = []
    for epoch in range(12):
        polls.append([(f"r{i}", at + dt.timedelta(hours=epoch // (2 + 4 * i)), "completed" if (i, epoch) in ((1, 5), (2, 11)) else "running")
                      for i in range(3) if (epoch * 7 + i) % 5 or i == 2])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    class Stream:
        """Stands for a stream: gives the function of a micro-batch back."""
        writeStream = property(lambda self: self)
        option = trigger = lambda self, *_, **__: self

        def foreachBatch(self, fn):
            self.start = lambda: fn
            return self

    each = streams.live_board(Stream(), out, state, max_skips=2)("unused")
    for epoch, rows_ in enumerate(polls):
        each(spark.createDataFrame(rows_, schema), epoch)
    got = spark.read.option("basePath", out).schema(schema + ", epoch int").parquet(out).select("epoch", "run_id", "last_updated", "status")
    every = spark.createDataFrame([(e, *r) for e, p in enumerate(polls) for r in p], "epoch int, " + schema)
    want = health.live_board(every, ["epoch"], max_skips=2)
    assert rows(got) == rows(want) and len(rows(want)) < every.count()
