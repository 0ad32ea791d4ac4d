"""Collapse against the stated rule, job trees with cycles and orphans, reports."""

import itertools

from pyspark.sql import functions as F

from flowlens.operators import health, jobs as jb, report, status as sta
from flowlens.schema import STATUS_ROWS


def rule(states):
    if not states:
        return "processing"
    if any(s in ("running", "prepared", "queued", "processing") for s in states):
        return "running"
    for s in ("aborting", "aborted", "failed"):
        if s in states:
            return s
    return "completed" if all(s == "completed" for s in states) else states[0]


def test_collapse_equals_the_rule_on_all_short_sequences(spark):
    names = [r[0] for r in STATUS_ROWS]
    seqs = [s for n in (1, 2, 3) for s in itertools.product(names, repeat=n)]
    data = [(i, o, s) for i, seq in enumerate(seqs) for o, s in enumerate(seq)]
    got = dict(map(tuple, sta.collapse(spark.createDataFrame(data, "k int, o int, status string"), ["k"], "o").select("k", "status").collect()))
    assert got == {i: rule(list(s)) for i, s in enumerate(seqs)}
    empty = sta.collapse_all(spark.createDataFrame([], "o int, status string"), "o").first()
    assert (empty["status"], empty["exit_code"]) == ("processing", 0)


def jobs(spark, data):
    rows = [("s", "r", i, p, i, sh, at, st, b, e) for i, p, sh, at, st, b, e in data]
    df = spark.createDataFrame(rows, "submission_id string, run_id string, id string, parent string, name string, shard int, attempt int, status string, start string, finish string")
    return df.withColumn("start", F.col("start").cast("timestamp")).withColumn("finish", F.col("finish").cast("timestamp"))


D = "2020-01-01 00:00:0"


def test_tree_with_cycle_and_orphan(spark):
    df = jobs(spark, [
        ("a", "b", None, None, "running", D + "1", None), ("b", "a", None, None, "running", D + "1", None),
        ("top", None, None, None, "running", D + "1", None), ("kid", "top", 1, None, "running", D + "2", None),
        ("leaf", "kid", None, None, "failed", D + "3", None), ("lost", "nowhere", None, None, "failed", D + "1", None),
    ])
    place = {r.id: r.place for r in jb.attach_parents(df).collect()}
    assert place == {"a": "child", "b": "child", "top": "root", "kid": "child", "leaf": "child", "lost": "orphan"}
    assert {(r.root, r.id, r.depth) for r in jb.descendants(df, df.where("id in ('top', 'a')")).collect()} == {("top", "kid", 1), ("top", "leaf", 2), ("a", "b", 1)}
    assert [r.id for r in jb.report_order(df).collect()] == ["top", "kid", "leaf"]


def test_report_order_and_missing_start_last(spark):
    df = jobs(spark, [
        ("late", None, None, None, "running", D + "5", None), ("none", None, None, None, "queued", None, None), ("early", None, None, None, "running", D + "1", None),
        ("s1", "early", 1, None, "running", D + "1", None), ("s0", "early", 0, None, "running", D + "2", None), ("plain", "early", None, None, "running", D + "1", None),
    ])
    assert [r.id for r in jb.report_order(df).collect()] == ["early", "plain", "s0", "s1", "late", "none"]


def test_shard_roll_up_waits_for_every_finish(spark):
    df = jobs(spark, [("x0", "x", 0, None, "completed", D + "1", D + "4"), ("x1", "x", 1, None, "running", D + "2", None),
                      ("y0", "y", 0, None, "failed", D + "1", D + "2"), ("y0r", "y", 0, 2, "completed", D + "3", D + "6")])
    got = {r.parent: r for r in jb.roll_up_shards(df, ["parent"], "shard").collect()}
    assert got["x"].finish is None and got["x"].status == "running"
    assert str(got["y"].finish) == D + "6" and got["y"].status == "failed"


def test_labels_shorter_than_shards_only_rename_what_they_cover(spark):
    df = jobs(spark, [("p", None, None, None, "running", D + "1", None), ("p0", "p", 0, None, "running", D + "1", None), ("p2", "p", 2, None, "running", D + "1", None),
                      ("p0x", "p0", 0, None, "running", D + "1", None)])
    labels = spark.sql("select 's' submission_id, 'r' run_id, explode(array('p', 'p0')) job_id, array('L0') labels")
    assert {r.id: r.name for r in jb.label_shards(df, labels).collect()} == {"p": "p", "p0": "L0", "p2": "p2", "p0x": "p0x"}


def test_brief_report_folds_completed_jobs_but_not_an_only_root(spark):
    extra = "*, true cached, 'b' batchid, 'slurm' backend, '1' returncode, 'err' stderr, cast(null as string) error"
    two = jobs(spark, [("p", None, None, None, "completed", D + "1", D + "3"), ("k", "p", None, None, "completed", D + "1", D + "2"), ("q", None, None, None, "failed", D + "2", D + "2")]).selectExpr(*extra.split(", "))
    as_of = F.expr("timestamp'2020-01-01 00:01:00'")
    full = {r.id: r for r in report.status_report(two, as_of).collect()}
    assert set(full) == {"p", "k", "q"} and full["p"].details == [] and full["k"].details == ["from cache: True"]
    assert full["q"].details == ["rc: 1", "stderr: err"] and full["q"].duration == "0s"
    brief = {r.id: r for r in report.status_report(two, as_of, brief=True).collect()}
    assert set(brief) == {"p", "q"} and brief["p"].details == ["from cache: True"]
    assert {r.id for r in report.status_report(two.where("id <> 'q'"), as_of, brief=True).collect()} == {"p", "k"}


def test_timeline_ties_and_first_final_event(spark):
    ev = spark.sql("select * from values ('r', 1, timestamp'2020-01-01', 'running'), ('r', 2, timestamp'2020-01-01', 'failed'), ('r', 3, timestamp'2020-01-02', 'completed') as t(run_id, seq, date, status)")
    row = sta.timeline(ev, ["run_id"]).first()
    assert row.status == "completed" and str(row.finish) == "2020-01-01 00:00:00"
    assert sta.timeline(ev.where("seq < 3"), ["run_id"]).first().status == "failed"


def test_second_equal_bad_check_aborts(spark):
    obs = [("s", 1, "a", True), ("s", 1, "b", False), ("s", 2, "a", True), ("s", 2, "b", True), ("s", 3, "a", True), ("s", 3, "b", True),
           ("s", 4, "a", True), ("s", 5, "a", True), ("s", 6, "c", True)]
    got = {r.tick: (r.unhealthy, r.abort) for r in health.health_checks(spark.createDataFrame(obs, "submission_id string, tick long, job_id string, stuck boolean"), slice_size=2).collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (True, True), 4: (True, False), 5: (True, True), 6: (True, False)}
