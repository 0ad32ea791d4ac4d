"""Edge cases: nested documents, retries, logs, manifests, files, outputs, sources on disk."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from flowlens.operators import containers, contigs, files, manifest as mf, outputs, telemetry as tel
from flowlens.plans import store_queries  # noqa: F401
from flowlens.sources import contigs as contig_files, documents, inventory, logs

T0, T1, T2 = "2020-01-01T00:00:00Z", "2020-01-01T01:00:00Z", "2020-01-01T02:00:00Z"


def variant(spark, doc, name="doc"):
    return spark.createDataFrame([("r", json.dumps(doc))], "run_id string, js string").select("run_id", F.parse_json("js").alias(name))


def test_sub_workflows_two_levels_deep_and_retries(spark):
    def call(**kw):
        return {"executionStatus": "Done", "shardIndex": -1, "attempt": 1, **kw}

    doc = {"id": "x", "calls": {
        "wf.one": [call(subWorkflowMetadata={"calls": {"sub.two": [call(subWorkflowMetadata={"calls": {"deep.three.b": [call(start=T1, end=T2)]}})]}})],
        "wf.s": [call(shardIndex=0, start=T0, end=T1), call(shardIndex=1, start=T0, end=T1, executionStatus="Failed"), call(shardIndex=1, attempt=2, start=T1, end=T2)],
        "wf.again": [call(start=T0, end=T0, executionStatus="Failed", failures=[{"message": "m", "causedBy": []}]), call(attempt=2, start=T1)],
        "wf.none": [],
    }}
    jobs = tel.job_rows(variant(spark, doc), ["run_id"], F.expr("timestamp'2030-01-01 00:00:00'"))
    got = {r.id: r for r in jobs.collect()}
    assert {i: r.parent for i, r in got.items()} == {
        "one": None, "one_two": "one", "one_two_three.b": "one_two", "s": None, "s_shard-0": "s", "s_shard-1": "s", "s_shard-1_attempt-2": "s",
        "again": None, "again_attempt-2": "again"}
    assert got["one_two"].start.hour == 1 and got["one"].start.year == 2030
    assert got["s"].status == "failed" and got["s"].finish.hour == 2 and got["s_shard-1_attempt-2"].attempt == 2
    errors = {r.id: r.error for r in tel.job_errors(jobs, ["run_id"]).collect()}
    assert errors["again"] == "m" and errors["s"] is None
    times = {r.name: r.seconds for r in tel.call_times(variant(spark, doc), ["run_id"]).collect()}
    assert times["wf.one.sub.two.deep.three.b"] == 3600.0 and times["wf.again"] == 0.0 and times["wf.one"] is None
    legacy = {r.name for r in tel.call_times(variant(spark, doc), ["run_id"], legacy_prefix=True).collect()}
    assert "sub.two.deep.three.b" in legacy


def test_cause_text_shapes(spark):
    doc = {"f": [{"message": "Workflow failed", "causedBy": [{"message": "a", "causedBy": {"message": "b"}}, {"message": "c", "causedBy": []}]}, {"message": "z"}]}
    rows = variant(spark, doc).select("run_id", F.variant_get("doc", "$.f", "variant").alias("f"))
    assert tel.cause_text(rows, ["run_id"], "f").first()["error"] == "a: b, c, z"
    doc = {"f": [{"message": "odd: , text: ", "causedBy": [{"causedBy": [{"message": ", "}]}, {"message": ""}, {"message": "d: "}]}, {"causedBy": []}, {"message": "e"}]}
    rows = variant(spark, doc).select("run_id", F.variant_get("doc", "$.f", "variant").alias("f"))
    assert tel.cause_text(rows, ["run_id"], "f").first()["error"] == "odd: , text: : , , d: , e"


def test_run_rows_carry_their_error(spark):
    docs = variant(spark, {"id": "e1", "status": "Failed", "failures": [{"message": "no: , way"}]})
    assert tel.run_rows(docs, ["run_id"]).first()["error"] == "no: , way"
    assert tel.run_rows(variant(spark, {"id": "e2", "status": "Done"}), ["run_id"]).first()["error"] is None


def test_empty_list_outputs_are_empty_not_absent(spark):
    returned = tel.output_rows(variant(spark, {"w.a": [], "w.b": [[], ["x"]], "w.c": "v", "w.d": {"location": "/l"}}), ["run_id"], "doc")
    assert sorted((r.id, tuple(r.path), r.value) for r in returned.collect()) == [("a", (), ""), ("b", (0,), ""), ("b", (1, 0), "x"), ("c", (), "v"), ("d", (), "/l")]
    declared = returned.select("run_id", F.explode(F.array(*[F.lit(x) for x in ("a", "c", "z")])).alias("id")).distinct()
    states = outputs.compare_outputs(declared, returned.where("size(path) = 0").select("run_id", "id", "value"), ["run_id", "id"])
    assert {r.id: r.state for r in states.collect()} == {"a": "empty", "c": "ok", "z": "absent"}


def test_conversion_paths_of_any_length(spark):
    steps = [(f"t{i}", f"t{i + 1}") for i in range(12)] + [("t12", "t0")]
    found = mf.conversion_paths(spark.createDataFrame([("t0", "t10"), ("t3", "t2"), ("t0", "x"), ("t1", "t1")], "guessed string, wanted string"), spark.createDataFrame(steps, "`from` string, to string"))
    assert {(r.guessed, r.wanted): r.steps for r in found.collect()} == {("t0", "t10"): 10, ("t3", "t2"): 12, ("t0", "x"): None}


def test_malformed_documents_are_rejected(spark, tmp_path):
    for name, text in {"good": '{"id": 1}', "cut": '{"id": ', "list": "[1]", "tail": '{"id": 1} x'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    good, bad = documents.read_documents(spark, str(tmp_path))
    assert [r.run_id for r in good.collect()] == ["good"] and {r.run_id for r in bad.collect()} == {"cut", "list", "tail"}


def test_layers_keep_file_order(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"x": 1, "y": [1, 2]}')
    (tmp_path / "a.json").write_text('{"x": "two"}')
    rows = documents.read_layers(spark, [str(tmp_path / "b.json"), str(tmp_path / "a.json")])
    got = {(r.layer, r.name): r.v for r in rows.selectExpr("layer", "name", "to_json(value) v").collect()}
    assert got == {(0, "x"): "1", (0, "y"): "[1,2]", (1, "x"): '"two"'}


def test_layers_of_many_manifests_in_one_scan(spark, tmp_path):
    plan = []
    for m in range(40):
        for layer in range(2):
            (tmp_path / f"{m}_{layer}.json").write_text(json.dumps({"x": m, f"y{layer}": [layer]}))
            plan.append((str(m), layer, str(tmp_path / f"{m}_{layer}.json")))
    (tmp_path / "cut.json").write_text('{"x": ')
    (tmp_path / "none.json").write_text("{}")
    plan += [("a", 0, str(tmp_path / "cut.json")), ("a", 1, str(tmp_path / "gone.json")), ("a", 2, str(tmp_path / "none.json")), ("a", 3, str(tmp_path / "3_0.json"))]
    rows, bad = documents.read_manifests(spark, spark.createDataFrame(plan, "manifest_id string, layer int, file string"), str(tmp_path))
    got = {(r.manifest_id, r.layer, r.name): r.v for r in rows.selectExpr("*", "to_json(value) v").collect()}
    assert len(got) == 162 and got["7", 1, "x"] == "7" and got["7", 1, "y1"] == "[1]" and got["a", 3, "x"] == "3"
    assert sorted((r.layer, r.reason) for r in bad.collect()) == [(0, "not a JSON object"), (1, "missing")]
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    with pytest.raises(ValueError, match="cut.json"):
        documents.read_layers(spark, [str(tmp_path / "none.json"), str(tmp_path / "cut.json")])


def test_files_on_a_disk_are_those_that_spark_lists(spark, tmp_path, monkeypatch):
    odd = ["a.json", "_hid.json", ".dot.json", "_k=1/x.json", "_h/x.json", ".d/x.json", "_metadata", "_metadata_x/y.json", "c._COPYING_", "1/2/3/4/d.json", "sub/_s.json", "sub/\u00e9 b.json"]
    for name in odd + [f"many/{k}/m.json" for k in range(70)]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text('{"x": 1}')
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "void").mkdir()
    (tmp_path / "bad.json").write_bytes(b'{"x": \xff')
    (tmp_path / "packed.json.gz").write_bytes(gzip.compress(b'{"z": 1}'))
    (tmp_path / "link").symlink_to(tmp_path / "1")
    (tmp_path / "dead.json").symlink_to(tmp_path / "none")
    found = inventory.read_inventory(spark, str(tmp_path))
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()  # listed once
    there = sorted(map(tuple, found.collect()))
    plan = spark.createDataFrame([(str(k), 0, path) for k, (path, *_) in enumerate(there) if " " not in path] + [("e", 0, f"{tmp_path}/empty.json")], "manifest_id string, layer int, file string")
    read = lambda: [sorted(map(str, x)) for x in (r.collect() for r in (lambda rows, bad: (rows.selectExpr("manifest_id", "name", "to_json(value) v"), bad))(*documents.read_manifests(spark, plan, str(tmp_path))))]
    rows = read()
    names = [p.removeprefix(f"{tmp_path}/") for p, *_ in there]
    assert len(names) == 78 and "packed.json.gz" in names and "link/2/3/4/d.json" in names and "empty.json" not in names
    assert len(rows[0]) == 76 and len(rows[1]) == 2
    monkeypatch.setattr(inventory, "disk_folder", lambda *_: None)
    assert there == sorted(map(tuple, inventory.read_inventory(spark, str(tmp_path)).collect())) and rows == read()


def test_one_document_per_submission_is_saved(spark, tmp_path):
    docs = spark.createDataFrame([("a", '{"n": 2}'), ("a", '{"n": 1}'), ("b", '{"n": 3}'), ("c", '{"n": 4}')], "submission_id string, js string").select("submission_id", F.parse_json("js").alias("doc"))
    progress = spark.createDataFrame([("c", "savedMetadata"), ("b", "other")], "submission_id string, key string")
    marks = documents.save_documents(docs, progress, str(tmp_path / "out"))
    assert sorted(map(tuple, marks.collect())) == [("a", "savedMetadata"), ("b", "savedMetadata")]
    assert sorted((r.submission_id, r.doc) for r in spark.read.json(str(tmp_path / "out")).collect()) == [("a", '{"n":1}'), ("b", '{"n":3}')]
    assert documents.save_documents(docs, progress.unionByName(marks), str(tmp_path / "out")).isEmpty()


def test_lists_of_any_depth_are_joined(spark):
    cases = {'["a", "b"]': "a,b", '[["a", ["b", [["c"]]]], "d"]': "a,b,c,d", "[1, null, [true, []], {\"k\": 1}]": '1,None,True,,{"k":1}', "[]": "", "[[], []]": ",",
             '"x"': "x", "null": None, "[null]": "None", str(list(range(12))): ",".join(map(str, range(12)))}
    df = spark.createDataFrame(list(enumerate([*cases, None])), "i int, js string").select("i", F.parse_json("js").alias("v"))
    got = {r.i: r.joined for r in outputs.join_lists(df, "i", "v", ",").collect()}
    assert got == {**dict(enumerate(cases.values())), len(cases): None}
    assert outputs.join_lists(df.where("i < 0"), "i", "v", ",").isEmpty()


def test_sources_may_be_lists_in_either_column(spark):
    hints = spark.createDataFrame([("m", 0, "hg19"), ("m", 1, "hg38")], "manifest_id string, pos int, hint string")

    def chosen(source, sources, rows):
        df = spark.createDataFrame(rows, f"manifest_id string, name string, source {source}, sources map<string,{sources}>")
        return {r.name: r.source for r in mf.choose_sources(df, hints).collect()}

    two = {"hg38": ["gs://38", "gs://38b"], "hg19": ["gs://19"]}
    assert chosen("string", "string", [("m", "a", "gs://p", None), ("m", "b", None, {"hg38": "x", "hg19": "y"}), ("m", "c", None, {"mm10": "z"})]) == {"a": "gs://p", "b": "y"}
    assert chosen("string", "array<string>", [("m", "a", "gs://p", None), ("m", "b", None, two)]) == {"a": ["gs://p"], "b": ["gs://19"]}
    assert chosen("array<string>", "string", [("m", "a", ["p", "q"], None), ("m", "b", None, {"hg38": "x"})]) == {"a": ["p", "q"], "b": ["x"]}
    assert chosen("array<string>", "array<string>", [("m", "a", ["p", "q"], None), ("m", "b", None, two)]) == {"a": ["p", "q"], "b": ["gs://19"]}


def test_log_files_blank_lines_and_missing_final_line(spark, tmp_path):
    (tmp_path / "r1.log").write_text("INFO start\n\n  \nERROR one\n  more\nwarning x\nFinal process status is permanentFail\n")
    (tmp_path / "r2.log").write_text("INFO start\n")
    lines = logs.read_lines(spark, str(tmp_path))
    assert [r.line for r in lines.where("run_id = 'r1'").orderBy("block", "line_no").collect()] == ["INFO start", "ERROR one", "  more", "warning x", "Final process status is permanentFail"]
    assert {r.run_id: r.status for r in tel.final_status(lines).collect()} == {"r1": "failed", "r2": "aborted"}
    assert tel.error_texts(lines).where("run_id = 'r1'").first()["error"] == "ERROR one\n  more"
    assert tel.tail(lines, 2).count() == 3


def test_key_value_rejects_fail_the_load(spark):
    lines = spark.createDataFrame([("a=1",), ("b=[x, y]",), ("bad",)], "line string")
    good, bad = logs.split_rejects(logs.key_values(lines))
    assert {r.key: (r.value, r["items"]) for r in good.collect()} == {"a": ("1", None), "b": (None, ["x", "y"])}
    with pytest.raises(ValueError):
        logs.require_clean(bad, "outputs")


def test_contig_files_plain_and_gzip(spark, tmp_path):
    (tmp_path / "ref.fai").write_text("chr1\t10\t1\nchr2\t5\t2\n")
    with gzip.open(tmp_path / "x.bed.gz", "wt") as f:
        f.write("chr1 \t1\t2\n\tx\nchr9\t1\t2\n")
    ref = contig_files.reference_contigs(spark, str(tmp_path / "ref.fai"))
    bed = contig_files.interval_contigs(spark, str(tmp_path / "x.bed.gz"))
    assert {r.contig for r in bed.collect()} == {"chr1", "chr9"}
    missing = contigs.missing_contigs(bed.selectExpr("'w' workflow", "file input", "contig"), ref.selectExpr("'w' workflow", "file ref", "contig"))
    assert [r.contig for r in missing.collect()] == ["chr9"]
    nothing = contigs.missing_contigs(bed.selectExpr("'w' workflow", "file input", "contig"), ref.where("false").selectExpr("'w' workflow", "file ref", "contig"))
    assert nothing.count() == 0


def test_missing_contig_summary_at_the_limit(spark):
    rows = spark.range(9).selectExpr("case when id < 4 then 'four' else 'five' end input", "concat('c', id) contig")
    got = {r.input: (r.n, r.examples) for r in contigs.summarise_missing(rows, ["input"]).collect()}
    assert got == {"four": (4, "c0, c1, c2, c3"), "five": (5, "c4, c5, c6...")}


def test_inventory_of_a_folder(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("abc")
    inv = inventory.read_inventory(spark, str(tmp_path))
    row = inv.first()
    assert row["path"] == str(tmp_path / "d" / "a.txt") and row["size"] == 3 and row["modified"] is not None
    assert str(tmp_path / "d") in {r.path for r in inventory.folders(inv).collect()}


def test_batch_groups_that_collide_as_identifiers(spark):
    g = spark.createDataFrame([("m", "a-b"), ("m", "a_b"), ("n", "x"), ("n", "x")], "manifest_id string, value string")
    got = {(r.manifest_id, r.value, r.reason) for r in mf.duplicate_groups(g).collect()}
    assert got == {("m", "a_b", "repeated as identifier"), ("n", "x", "repeated"), ("n", "x", "repeated as identifier")}


def test_batch_fan_out(spark):
    rows = spark.sql("""select 'm' manifest_id, name, pos, value from values ('g', 0, 's1'), ('g', 1, '2s'), ('inp', 0, 'test1'), ('inp', 1, 'test2'), ('k', 0, 'v') as t(name, pos, value)""")
    got = {(r.name, r.value) for r in mf.fan_out(rows, "g", ["inp"]).collect()}
    assert got == {("inp_s1", "test1"), ("inp__2s", "test2"), ("g", "s1"), ("g", "2s"), ("k", "v"), ("groupby_field", "s1"), ("groupby_field", "_2s")}


def test_type_guess_needs_companions_and_prefers_longest(spark):
    types = spark.sql("""select * from values ('Gz', 0, array('.gz'), cast(array() as array<string>)), ('FastaGz', 1, array('.gz', '.fasta.gz'), array()),
      ('Indexed', 2, array('.gz'), array('^.idx')) as t(type, pos, extensions, companions)""")
    paths_ = spark.createDataFrame([("/a/x.fasta.gz",), ("/a/y.gz",), ("/a/z",), ("/a/w.fasta.gz",)], "path string")
    inv = spark.createDataFrame([("/a/w.fasta.idx",)], "path string")
    got = {r.path: (r.type, r.score) for r in files.guess_types(paths_, types, inv).collect()}
    assert got == {"/a/x.fasta.gz": ("FastaGz", 9), "/a/y.gz": ("Gz", 3), "/a/z": (None, None), "/a/w.fasta.gz": ("Indexed", 23)}


def test_output_plan_folders_by_shard_and_companions(spark):
    rows = spark.sql("""select 'o' output_id, '/out/' output_dir, 'id' name_mode, cast(null as array<string>) names, i,
      array(named_struct('text', cast(null as string), 'list', array('s0', 's1'))) folders, cast(null as string) extension, true is_copyable,
      concat('/e/', i, '.fa.gz') value, array(i) at, array(2) sizes, array('^^.dict') secondaries from (select explode(array(0, 1)) i)""")
    plan = outputs.plan_outputs(rows)
    assert [r.new_path for r in plan.orderBy("i").collect()] == ["/out/s0/o.gz", "/out/s1/o.gz"]
    assert {(r.source, r.new_path) for r in outputs.plan_companions(plan).collect()} == {("/e/0.dict", "/out/s0/o.dict"), ("/e/1.dict", "/out/s1/o.dict")}
    flat = outputs.plan_outputs(rows.withColumn("folders", F.lit(None).cast(rows.schema["folders"].dataType)))
    assert [r.new_path for r in flat.orderBy("i").collect()] == ["/out/o_shard-0.gz", "/out/o_shard-1.gz"]
    clash = outputs.plan_outputs(rows.withColumn("name_mode", F.lit("original")).withColumn("value", F.lit("/e/same.txt")).withColumn("folders", F.lit(None).cast(rows.schema["folders"].dataType)))
    assert outputs.collisions(clash, ["output_id"]).first()["n"] == 2


def test_output_extension_declared_else_type_default(spark):
    declared = spark.sql("select * from values ('file', 'T', cast(null as string), cast(null as string)), ('file', 'T', '_fastqc.txt', null), ('int', 'T', null, null) as t(kind, type, extension, override)")
    types = spark.sql("select 'T' type, '.out' default_extension, array('.bai') companions")
    got = [(r.kind, r.extension, r.secondaries) for r in outputs.output_parameters(declared, types).collect()]
    assert sorted(got, key=repr) == sorted([("file", ".out", [".bai"]), ("file", "_fastqc.txt", [".bai"]), ("int", None, None)], key=repr)


def test_path_summary(spark):
    rows = spark.createDataFrame([("a", "/x/1"), ("a", "/x/12"), ("b", "/y"), ("c", None)], "k string, p string")
    assert {r.k: r.summary for r in outputs.summarise_paths(rows, ["k"], "p").collect()} == {"a": "(multiple) /x/1*", "b": "/y", "c": ""}


def test_pinning_is_case_insensitive_and_overridable(spark):
    tools = spark.createDataFrame([("t1", "Ubuntu"), ("t2", "other")], "tool string, image string")
    over = spark.createDataFrame([("t2", "mine")], "tool string, image string")
    digests = spark.createDataFrame([("ubuntu", "ubuntu@sha256:1")], "image string, pinned string")
    assert {r.tool: r.container for r in containers.pin(tools, over, digests).collect()} == {"t1": "ubuntu@sha256:1", "t2": "mine"}


def test_pipeline_applies_steps_in_order(spark):
    out = mf.pipeline(spark.range(3).toDF("n"), [lambda d: d.where("n > 0"), lambda d: d.withColumn("n", F.col("n") * 2)])
    assert [r.n for r in out.orderBy("n").collect()] == [2, 4]


def test_scatter_gather_by_hand(spark):
    from hashlib import md5

    def h(x):
        return md5(str(x).encode()).hexdigest()

    want = {k: h(",".join(h(h_)[:0] + h(v) for h_, v in [(None, v) for v in range(3 * k, min(3 * k + 3, 7))])) for k in range(3)}
    got = {r.n: r.hash for r in outputs.scatter_gather(spark.range(7).selectExpr("id n", "id value"), 3, 1).collect()}
    assert got == want


def test_contig_sketches_unite_without_the_rows(spark):
    rows = spark.sql("select concat('w', id % 2) workflow, concat('f', id % 10) input, concat('c', id % 40000) contig from range(200000)")
    kept = contigs.contig_sketches(rows, ["workflow", "input"])
    assert kept.agg(F.max(F.length("sketch"))).first()[0] < 17_000
    got = {r.workflow: (r.contigs, r.intervals) for r in contigs.estimate(contigs.unite_sketches(kept, ["workflow"])).collect()}
    direct = {r.workflow: r.contigs for r in contigs.contig_profile(rows, ["workflow"]).collect()}
    assert all(abs(n - 20_000) <= 0.0325 * 20_000 and i == 100_000 for n, i in got.values()) and set(got) == {"w0", "w1"}
    assert all(abs(direct[w] - got[w][0]) <= 0.0325 * 20_000 for w in got)
    few = spark.sql("select 'a' input, if(id % 3 = 0, null, concat('c', id % 7)) contig from range(50)")
    assert [tuple(r) for r in contigs.contig_profile(few, ["input"]).select("contigs", "intervals").collect()] == [(7, 33)]


def test_inventory_look_up(spark):
    found = spark.sql("select * from values ('/a/b/c.txt', 3), ('/a/b', 9), ('/d.txt', 0) as (path, size)")
    wanted = spark.sql("select explode(array('/a', '/a/b', '/a/b/c.txt', '/a/b/c', '/d.txt', null)) path")
    got = {r.path: (r.kind, r.size) for r in inventory.look_up(wanted, found).collect()}
    assert got == {"/a": ("folder", None), "/a/b": ("file", 9), "/a/b/c.txt": ("file", 3), "/a/b/c": (None, None), "/d.txt": ("file", 0), None: (None, None)}
