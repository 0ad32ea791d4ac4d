"""Steps that must not repeat work: how often rows are shuffled, and by how many tasks files are written."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from flowlens.operators import manifest as mf
from flowlens.operators import ordered, outputs, store
from flowlens.operators import telemetry as tel
from flowlens.plans import manifest_queries
from flowlens.plans.adapter import Tables
from flowlens.plans.registry import QUERIES
from flowlens.sources import inventory


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_groups_are_shuffled_once_and_large_ones_dealt(spark):
    rows = spark.range(60).selectExpr("case when id < 40 then 'big' when id < 58 then concat('k', id % 6) end k", "cast(id as string) v")
    small = ordered.lists(rows.where("k <> 'big'"), ["k"], F.col("v"), {"v": F.col("v")}, 10)
    assert len(re.findall(r"Exchange hashpartitioning", plan(small))) == 1
    got = {(r.k, r.part, r.parts): (r.n, list(r.v)) for r in ordered.lists(rows, ["k"], F.col("v"), {"v": F.col("v")}, 10).collect()}
    assert sum(n for n, _ in got.values()) == 58 and None not in {k for k, _, _ in got}
    assert {p for k, _, p in got if k == "big"} == {4} and {p for k, _, p in got if k != "big"} == {1}
    assert all(v == sorted(v) and n == len(v) for n, v in got.values())
    assert sorted(x for (k, _, _), (_, v) in got.items() if k == "big" for x in v) == sorted(str(i) for i in range(40))


def test_attempts_meet_orders_in_one_shuffle(spark, tmp_path):
    day = "timestamp_ntz'1998-01-01 00:00:00' + make_dt_interval(cast(id as int) * 20)"
    spark.range(8).selectExpr(
        "id div 4 l_orderkey", "cast(id % 2 as int) l_linenumber", "id l_partkey", "id l_suppkey", "id * 1.0 l_extendedprice",
        "1.0 l_quantity", "0.0 l_discount", "0.0 l_tax", "'N' l_returnflag", "'O' l_linestatus", f"{day} l_shipdate",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(2).selectExpr("id o_orderkey", "id o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    jobs = Tables(spark, str(tmp_path)).jobs
    assert len(re.findall(r"hashpartitioning\(l_orderkey", plan(jobs))) == 1
    got = sorted((r.run_id, r.name, r.attempt) for r in jobs.collect())
    assert got == [(str(o), f"step{n}", a) for o in (0, 1) for n in (0, 1) for a in (1, 2)]


def test_layer_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest_queries, "LAYER_FILES", 2)
    spark.range(12).selectExpr("id s_suppkey", "concat('s', id) s_name", "id % 5 s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    written = []
    monkeypatch.setattr(manifest_queries, "new_path", lambda s, kind: written.append(f"{tmp_path}/{kind}") or written[-1])
    rows = QUERIES["a7_layered_inputs"](spark, str(tmp_path)).collect()
    assert len(rows) == 12 * 2 + 7 * 2 + 5 and sum(r.reason == "missing" for r in rows) == 4
    files = [p.name for p in (tmp_path / "layers").rglob("part-*") if not p.name.endswith(".crc")]
    assert len(files) == 20 and len({f[:10] for f in files}) > 1


def test_layer_files_are_listed_and_read_by_few_tasks(spark, tmp_path, monkeypatch):
    # 200 files: a folder and a checksum file for each would show below, as would readers that take 32 files a task.
    spark.range(1, 121).selectExpr("id s_suppkey", "concat('s', id) s_name", "cast(id % 5 as int) s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    written = []
    monkeypatch.setattr(manifest_queries, "new_path", lambda s, kind: written.append(f"{tmp_path}/{kind}") or written[-1])
    rows = QUERIES["a7_layered_inputs"](spark, str(tmp_path)).collect()
    assert len(rows) == 2 * 120 + 2 * 68 + 52 and sum(r.reason == "missing" for r in rows) == 40
    below = [*(tmp_path / "layers").rglob("*")]
    assert sum(p.is_file() for p in below) == 200 and sum(p.is_dir() for p in below) == 1
    assert len(inventory.read_inventory(spark, written[0]).inputFiles()) < 200
    files = inventory.read_disk(inventory.list_disk(spark, written[0]))
    assert files.rdd.getNumPartitions() <= 8 and files.count() == 200


def test_layers_are_the_same_with_and_without_a_disk(spark, tmp_path, monkeypatch):
    keys = "case when id < 12 then id when id < 15 then 4 when id = 15 then -8 end"
    spark.range(18).selectExpr(f"{keys} s_suppkey", "case when id <> 7 then concat('s', id div 13) end s_name", "id % 5 s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    run = lambda: sorted(map(str, QUERIES["a7_layered_inputs"](spark, str(tmp_path)).collect()))
    on_disk = run()
    monkeypatch.setattr(inventory, "disk_folder", lambda *_: None)
    assert on_disk == run() and sum("not a JSON object" in r for r in on_disk) == 9


def test_batch_names_are_made_before_the_join(spark):
    groups = spark.createDataFrame([("m", "w", "a-1")], "manifest_id string, workflow string, value string")
    outs = spark.createDataFrame([("w", "o", ["x"]), ("w", "p", None)], "workflow string, name string, folders array<string>")
    placed = mf.place_batch_outputs(groups, outs)
    tree = plan(placed)
    assert tree.index("Join") < tree.index("[^A-Za-z0-9_]")
    assert "REPARTITION_BY_NUM" in tree  # AQE joins no partitions here
    assert sorted(map(tuple, placed.collect())) == [("m", "a_1_o", "o", ["a-1", "x"]), ("m", "a_1_p", "p", ["a-1"])]


def test_logs_meet_the_inventory_without_texts_made_of_them(spark):
    jobs = spark.createDataFrame(
        [("s", "r", "j", 2, "/a", None, "/c"), ("s", "r", "k", None, "/d", "/e", "/f")],
        "submission_id string, run_id string, id string, shard int, stdout string, stderr string, script string")
    there = spark.createDataFrame([("/a",), ("/c",), ("/e",), ("/e",)], "path string")
    planned = outputs.plan_logs(jobs, there, F.lit("/logs"))
    tree = plan(planned)
    assert tree.index("shard-") < tree.index("Join")
    assert sorted((r.id, r.kind, r.source, r.target) for r in planned.collect()) == [
        ("j", "script", "/c", "/logs/jshard-2_script"), ("j", "stdout", "/a", "/logs/jshard-2_stdout"), ("k", "stderr", "/e", "/logs/k_stderr")]


def test_job_rows_are_not_derived_again_by_their_readers(spark):
    text = '{"calls": {"wf.a": [{"shardIndex": 0, "attempt": 1, "executionStatus": "Done", "start": "1998-03-01T00:00:00Z"}]}}'
    docs = spark.createDataFrame([("r", text)], "run_id string, text string").selectExpr("run_id", "parse_json(text) doc")
    rows = tel.job_rows(docs, ["run_id"], F.expr("timestamp'2000-01-01 00:00:00'"))
    assert "Join" not in plan(rows)
    assert sorted((r.id, r.parent) for r in rows.collect()) == [("a", None), ("a_shard-0", "a")]


def test_rounds_of_a_store_join_their_rows_once(spark, small_dir, monkeypatch):
    plans, append = [], store.append

    def seen(spark, root, spec, delta, **kw):
        plans.append(delta._jdf.queryExecution().optimizedPlan().toString())
        append(spark, root, spec, delta, **kw)

    monkeypatch.setattr(store, "append", seen)
    QUERIES["f1_stored_rounds"](spark, small_dir)
    assert len(plans) == 3 and not any("Join" in p for p in plans)
