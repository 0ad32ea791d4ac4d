"""Upsert, change capture, lookups and the partitioned store on disk."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from flowlens.engine import Engine
from flowlens.operators import store
from flowlens.schema import SPECS

DDL = "id string, sub string, status string, n int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upsert_keeps_non_null_fields_and_matches_null_keys(spark):
    base = spark.createDataFrame([("a", "s", "running", 1), ("b", None, "queued", 2), ("c", "s", "failed", 3)], DDL)
    delta = spark.createDataFrame([("a", "s", "completed", None), ("b", None, None, 9), ("d", "s", None, None)], DDL)
    out = store.upsert(base, delta, ("id", "sub"))
    assert rows(out) == rows(spark.createDataFrame(
        [("a", "s", "completed", 1), ("b", None, "queued", 9), ("c", "s", "failed", 3), ("d", "s", None, None)], DDL))
    assert rows(store.upsert(out, delta, ("id", "sub"))) == rows(out)


def test_repeats_in_a_delta_take_the_last_non_null_field(spark):
    base = spark.createDataFrame([("a", "s", "queued", 1)], DDL)
    delta = spark.createDataFrame([("a", "s", "running", None, 1), ("a", "s", None, 7, 2), ("b", "s", "queued", 1, 3), ("b", "s", "running", None, 4)], DDL + ", seq int")
    assert rows(store.upsert(base, delta, ("id", "sub"), seq="seq")) == [("a", "s", "running", 7), ("b", "s", "running", 1)]


def test_update_of_only_nulls_changes_nothing(spark):
    base = spark.createDataFrame([("a", "s", "queued", 1)], DDL)
    assert rows(store.upsert(base, spark.createDataFrame([("a", "s", None, None)], DDL), ("id", "sub"))) == rows(base)


def test_change_capture_inside_a_batch_and_against_the_base(spark):
    base = spark.createDataFrame([("a", "running"), ("b", "queued")], "id string, status string")
    delta = spark.createDataFrame(
        [("a", "running", 1), ("a", "failed", 2), ("a", "failed", 3), ("c", "queued", 4), ("c", "queued", 5), ("b", "running", 6)], "id string, status string, seq bigint")
    for size in (2, 1000):
        got = {(r.id, r.seq): r.change for r in store.capture_changes(base, delta, ["id"], "seq", slice_size=size).collect()}
        assert got == {("a", 1): "skip", ("a", 2): "update", ("a", 3): "skip", ("c", 4): "insert", ("c", 5): "skip", ("b", 6): "update"}


def test_change_capture_compares_more_columns_on_request(spark):
    base = spark.createDataFrame([("a", "running", 1)], "id string, status string, n int")
    delta = spark.createDataFrame([("a", "running", 2, 1)], "id string, status string, n int, seq bigint")
    assert store.capture_changes(base, delta, ["id"], "seq", compare=["status", "n"]).first()["change"] == "update"


def test_lookup(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "id string, n int")
    wanted = spark.createDataFrame([("a",), ("b",), ("z",)], "id string")
    assert rows(store.lookup(t, wanted, ["id"])) == [("a", 1)]
    assert rows(store.lookup(t, wanted, ["id"], strict=False)) == [("a", 1), ("b", 2)]


def test_kv(spark):
    kv = spark.createDataFrame([("s", "name", "x", 1), ("s", "status", "queued", 1)], "submission_id string, key string, value string, seq int")
    new = spark.createDataFrame([("s", "status", "running", 2), ("s", "name", None, 2)], kv.schema)
    assert rows(store.kv_replace(kv, new, ["submission_id"], "seq")) == [("s", "name", "x"), ("s", "status", "running")]
    assert rows(store.kv_changes(kv.drop("seq"), new.drop("seq"), ["submission_id"])) == [("s", "status", "running")]
    assert rows(store.kv_pivot(kv, ["submission_id"], ["name", "error"])) == [("s", "x", None)]


def stored(spark, root, spec):
    return rows(store.read(spark, root, spec).select("id", "submission_id", "run_id", "status", "container", "start"))


def test_registers_fold_alike_in_any_order_and_split(spark, tmp_path):
    spec, rng = SPECS["jobs"], random.Random(4)
    events = [
        (rng.choice("abc"), rng.choice(["s", None]), "r", rng.choice(["queued", "running", "completed", None]), rng.choice(["x:1", "y:2", None]), rng.randrange(12))
        for _ in range(60)
    ]
    ddl = "id string, submission_id string, run_id string, status string, container string, seq long"
    want = {}
    for i, s, r, *fields, at in events:
        held = want.setdefault((i, s, r), [(-1, "")] * 2)
        want[(i, s, r)] = [max(h, (at, f)) if f is not None else h for h, f in zip(held, fields, strict=True)]
    want = sorted(((*k, *[f if at >= 0 else None for at, f in v], None) for k, v in want.items()), key=repr)
    for trial in range(3):
        rng.shuffle(events)
        root, at = str(tmp_path / str(trial)), 0
        while at < len(events):
            to = at + rng.randrange(1, 30)
            store.merge(spark, root, spec, spark.createDataFrame(events[at:to], ddl), seq="seq", bucket_rows=rng.choice([2, 1000]))
            at = to
        store.merge(spark, root, spec, spark.createDataFrame(events[:9], ddl), seq="seq")  # a batch again
        assert stored(spark, root, spec) == want
        store.compact(spark, root, spec, bucket_rows=3, file_rows=4)
        assert stored(spark, root, spec) == want and len(store.layout(spark, root, spec)["folders"]) == 1


def test_older_events_do_not_overwrite_newer_ones(spark, tmp_path):
    spec, root, ddl = SPECS["jobs"], str(tmp_path), "id string, submission_id string, run_id string, status string, container string, seq timestamp"
    at = [dt.datetime(2024, 1, 1, 0, 0, s) for s in range(3)]
    store.merge(spark, root, spec, spark.createDataFrame([("a", "s", "r", "completed", None, at[2])], ddl), seq="seq")
    store.merge(spark, root, spec, spark.createDataFrame([("a", "s", "r", "queued", "img", at[0])], ddl), seq="seq")
    assert stored(spark, root, spec) == [("a", "s", "r", "completed", "img", None)]


def test_store_appends_without_rewriting_and_prunes_in_sql(spark, tmp_path):
    spec, root = SPECS["runstatus"], str(tmp_path)
    base = spark.range(200).selectExpr("concat('s', id % 20) submission_id", "concat('r', id) run_id", "'queued' status", "timestamp'2020-01-01 00:00:00' date")
    store.merge(spark, root, spec, base, bucket_rows=20, file_rows=50)
    before = {f["name"]: set(spark.read.parquet(f"{root}/runstatus/{f['name']}").inputFiles()) for f in store.layout(spark, root, spec)["folders"]}
    delta = base.where("run_id in ('r1', 'r2')").withColumn("date", F.expr("timestamp'2021-01-01 00:00:00'")).unionByName(
        spark.sql("select 'new' submission_id, 'r' run_id, 'failed' status, timestamp'2022-01-01 00:00:00' date"))
    store.merge(spark, root, spec, delta, bucket_rows=20)
    folders = store.layout(spark, root, spec)["folders"]
    assert [f["kind"] for f in folders] == ["base", "delta"] and folders[0]["buckets"] == 10 != folders[1]["buckets"]
    assert set(spark.read.parquet(f"{root}/runstatus/{folders[0]['name']}").inputFiles()) == before[folders[0]["name"]]
    engine = Engine(spark).open(root)
    for _ in range(2):  # with a delta, and compacted to another number of buckets
        after = store.read(spark, root, spec)
        assert after.count() == 201 and after.where("year(date) = 2021").count() == 2 and after.where("submission_id = 'new'").count() == 1
        for name in [f"s{k}" for k in range(20)]:
            assert engine.sql(f"select * from runstatus where submission_id = '{name}'").count() == 10 == store.read(spark, root, spec, scope=name).count()
        plan = engine.sql("select status from runstatus where submission_id = 's3'")._jdf.queryExecution().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*\(_bucket#\d+ = \d+\)", plan) and "container" not in plan
        assert engine.sql("select count(*) n from runstatus").first()["n"] == 201
        store.compact(spark, root, spec, bucket_rows=70)
        engine = Engine(spark).open(root)
    store.vacuum(spark, root, spec, keep=1)
    assert store.read(spark, root, spec).count() == 201 and [p.name for p in (tmp_path / "runstatus").glob("*-*")] == [store.layout(spark, root, spec)["folders"][0]["name"]]


def test_store_keeps_variants_and_a_hot_submission_spreads(spark, tmp_path):
    spec, root = SPECS["inputs"], str(tmp_path)
    df = spark.range(300).selectExpr("concat('i', id) id", "'hot' submission_id", "'r' run_id", "parse_json(concat('{\"k\": [', id, ']}')) value", "id size", "id seq")
    store.write(df, root, spec, seq="seq", bucket_rows=50, file_rows=30)
    store.append(spark, root, spec, spark.sql("select 'i7' id, 'hot' submission_id, 'r' run_id, parse_json('1') value, 0L seq"), seq="seq")
    store.append(spark, root, spec, spark.sql("select 'i8' id, 'hot' submission_id, 'r' run_id, parse_json('[2]') value, 99L seq"), seq="seq")
    got = {r.id: (r.v, r.size) for r in store.read(spark, root, spec).selectExpr("id", "to_json(value) v", "size").collect()}
    assert len(got) == 300 and got["i7"] == ('{"k":[7]}', 7) and got["i8"] == ("[2]", 8)
    files = spark.read.parquet(f"{root}/inputs/{store.layout(spark, root, spec)['folders'][0]['name']}").inputFiles()
    assert len(files) >= 8  # one bucket, written by ten tasks


def test_deltas_and_compactions_write_their_rows_once(spark, tmp_path, monkeypatch):
    spec, root, ddl = SPECS["jobs"], str(tmp_path), "id string, submission_id string, run_id string, status string, seq long"
    store.write(spark.createDataFrame([(f"j{k}", f"s{k % 5}", None, "queued", 1) for k in range(40)], ddl), root, spec, seq="seq", bucket_rows=4)
    cuts = []
    monkeypatch.setattr(store, "cut", lambda df: cuts.append(df) or df)
    delta = [("j1", "s1", None, "running", 3), ("j1", "s1", None, "failed", 2), ("j1", "s1", None, None, 9), ("new", None, None, "queued", 0)]
    for part in (delta, delta[:1], []):
        store.append(spark, root, spec, spark.createDataFrame(part, ddl), seq="seq")
    keys = spark.createDataFrame([("only", "keys", "here", 5)] * 2, "id string, submission_id string, run_id string, seq long")
    store.append(spark, root, spec, keys, seq="seq")
    assert [f["rows"] for f in store.layout(spark, root, spec)["folders"]] == [40, 2, 1, 1]
    want = sorted([(f"j{k}", f"s{k % 5}", None, "running" if k == 1 else "queued") for k in range(40)] + [("new", None, None, "queued"), ("only", "keys", "here", None)], key=repr)
    for whole, n in ((None, [40, 2, 1, 1]), (False, [40, 3]), (True, [42])):
        if whole is not None:
            store.compact(spark, root, spec, whole, bucket_rows=4)
        assert [f["rows"] for f in store.layout(spark, root, spec)["folders"]] == n
        table = store.read(spark, root, spec)
        assert table.columns == list(spec.columns) and rows(table.select("id", "submission_id", "run_id", "status")) == want
        assert store.read(spark, root, spec, scope="s1").count() == 8
    assert not cuts


def test_two_writers_do_not_lose_each_other(spark, tmp_path):
    spec, root, ddl = SPECS["jobs"], str(tmp_path), "id string, submission_id string, run_id string, status string, container string, seq long"
    store.append(spark, root, spec, spark.createDataFrame([("a", "s", "r", "queued", None, 1)], ddl), seq="seq")
    taken = store.layout(spark, root, spec)
    store.append(spark, root, spec, spark.createDataFrame([("b", "s", "r", "queued", None, 1)], ddl), seq="seq")
    assert not store._commit(spark, root, spec, taken["version"] + 1, taken["folders"])
    assert [r[0] for r in stored(spark, root, spec)] == ["a", "b"]


def test_milestones_keep_the_first(spark):
    p = spark.sql("select * from values ('s', 'start', timestamp'2020-01-02 00:00:00'), ('s', 'start', timestamp'2020-01-01 00:00:00') as t(submission_id, key, timestamp)")
    assert str(store.milestones(p).first()["start"]) == "2020-01-01 00:00:00"
    assert store.reached(spark.createDataFrame([("s",), ("u",)], "id string"), p, "start").count() == 1
