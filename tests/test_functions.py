"""Scalar rules on literal cases."""

import pytest
from pyspark.sql import functions as F

from flowlens.functions import images, paths, status as st, timing, values


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("secs, text", [
    (0, "0s"), (8, "8s"), (22, "22s"), (59, "59s"), (60, "1m:00s"), (70, "1m:10s"), (609, "10m:09s"), (3599, "59m:59s"),
    (3600, "1h:00m:00s"), (3660, "1h:01m:00s"), (86399, "23h:59m:59s"), (86400, "1d:00h:00m:00s"), (None, "N/A"),
])
def test_duration_text(spark, secs, text):
    assert one(spark, secs, "bigint", timing.duration_text) == text


@pytest.mark.parametrize("path, ext", [
    ("test.txt", "txt"), ("test.intermediate.txt", "txt"), ("test.intermediate.filenames.txt", "txt"), ("test", None), ("test.", None), (".test", "test"),
])
def test_extension(spark, path, ext):
    assert one(spark, path, "string", paths.extension) == ext


@pytest.mark.parametrize("text, kind, field, value", [
    ("tuRe", "text", "v_text", "tuRe"), ("TRUE", "bool", "v_bool", True), ("fAlSe", "bool", "v_bool", False), ("1", "int", "v_int", 1),
    ("12345", "int", "v_int", 12345), ("-1", "int", "v_int", -1), ("1.0", "double", "v_double", 1.0), ("123.45", "double", "v_double", 123.45),
    ("-1.0", "double", "v_double", -1.0), ("None", "null", "v_text", None), ("null", "null", "v_text", None), ("1_000", "double", "v_double", 1000.0),
    ("", "text", "v_text", ""),
])
def test_infer(spark, text, kind, field, value):
    got = one(spark, text, "string", values.infer)
    assert got["kind"] == kind and got[field] == value


@pytest.mark.parametrize("path, full", [
    ("test/my.txt", "/cwd/test/my.txt"), ("./my.txt", "/cwd/my.txt"), ("~/my.txt", "/home/u/my.txt"), ("/test/my.txt", "/test/my.txt"),
    ("https://host.org", "https://host.org"), ("http://host.org", "http://host.org"), ("s3://b/k/io.txt", "s3://b/k/io.txt"),
    ("gcs://b/k/io.txt", "gcs://b/k/io.txt"), (None, None), ("a/../../b", "/b"), ("//x/y", "//x/y"),
])
def test_qualify(spark, path, full):
    assert one(spark, path, "string", lambda c: paths.qualify(c, F.lit("/cwd"), F.lit("/home/u"))) == full


def test_join_nested(spark):
    row = spark.sql("select array('1', null, '3') a, array(array('1', '2'), array('3')) b, cast(array() as array<string>) c").select(
        values.join_nested(F.col("a"), ",").alias("a"), values.join_nested(F.flatten("b"), ",").alias("b"), values.join_nested(F.col("c"), ",").alias("c")
    ).first()
    assert tuple(row) == ("1,None,3", "1,2,3", "")


@pytest.mark.parametrize("sql, text", [
    ("1", "1"), ("false", "false"), ("1.0D", "1.0"), ("'1.0'", '"1.0"'), ("array(1, 2, 3)", "[1,2,3]"), ("named_struct('s', 'hi', 'i', 1, 'b', true)", '{"s":"hi","i":1,"b":true}'),
    ("cast(null as int)", None),
])
def test_encode_json(spark, sql, text):
    assert spark.sql(f"select {sql} x").select(values.encode_json(F.col("x")).alias("y")).first()["y"] == text


@pytest.mark.parametrize("text, shape", [
    ('{"a": 1}', "OBJECT<a: BIGINT>"), ("[1, 2]", "ARRAY<BIGINT>"), ("myvalue", "STRING"), ('{"a": 1}}', "STRING"), ("1]", "STRING"), ("1,2", "STRING"),
    ('say "hi"', "STRING"), ('"x"', "STRING"), ("", "STRING"), ('{"k": "flowlens:end"}', "OBJECT<k: STRING>"), ('1,"flowlens:end"]', "STRING"),
])
def test_decode_json(spark, text, shape):
    assert one(spark, text, "string", lambda c: F.schema_of_variant(values.decode_json(c))) == shape


@pytest.mark.parametrize("image, parts", [
    ("ubuntu", (True, None, None, "ubuntu", "latest", None)),
    ("python:3.8.1", (True, None, None, "python", "3.8.1", None)),
    ("library/python:3.8.1", (True, None, "library", "python", "3.8.1", None)),
    ("someone/util:0.0.6", (True, None, "someone", "util", "0.0.6", None)),
    ("quay.io/biocontainers/staden_io_lib:1.14.12--h244ad75_0", (True, "quay.io", "biocontainers", "staden_io_lib", "1.14.12--h244ad75_0", None)),
    ("gcr.io/img:2", (True, "gcr.io", None, "img", "2", None)),
    ("localhost:5000/a/b/t@sha256:ff", (True, "localhost:5000", "a/b", "t", None, "sha256:ff")),
    ("a:b:c", (False, None, None, None, None, None)),
    ("x/y@bad", (False, None, None, None, None, None)),
])
def test_parse_image(spark, image, parts):
    df = images.parse(spark.createDataFrame([(image,)], "raw string"), "raw")
    assert tuple(df.select("valid", "host", "repository", "image", "tag", "digest").first()) == parts


@pytest.mark.parametrize("path, pattern, out", [
    ("/a/b.bam", ".bai", "/a/b.bam.bai"), ("/a/b.bam", "^.bai", "/a/b.bai"), ("/a/b.fa.gz", "^^.dict", "/a/b.dict"), ("/a/b", "^.dict", "/a/b.dict"),
    ("/a.d/b", "^.dict", "/a.d/b.dict"), ("/a/.b", "^.x", "/a/.b.x"),
])
def test_companion(spark, path, pattern, out):
    df = spark.createDataFrame([(path, pattern)], "p string, c string")
    assert df.select(paths.companion(F.col("p"), F.col("c")).alias("y")).first()["y"] == out


def test_bucket_and_blob(spark):
    link = "gs://genomics-public-data/references/hg38/v0/1000G.hg38.vcf.gz.tbi"
    assert one(spark, link, "string", paths.bucket) == "genomics-public-data"
    assert one(spark, link, "string", paths.blob) == "references/hg38/v0/1000G.hg38.vcf.gz.tbi"
    assert one(spark, "s3://x/y", "string", paths.blob) is None


def test_parse_iso(spark):
    for text, out in [("2020-01-02T03:04:05+02:00", "2020-01-02 01:04:05"), ("2020-01-02", "2020-01-02 00:00:00"), ("odd", None), (None, None)]:
        assert one(spark, text, "string", lambda c: timing.parse_iso(c).cast("string")) == out


@pytest.mark.parametrize("status, final", [
    ("completed", True), ("failed", True), ("aborted", True), ("dry-run", True), ("suspended", True),
    ("processing", False), ("queued", False), ("running", False), ("aborting", False),
])
def test_final(spark, status, final):
    assert one(spark, status, "string", st.is_final) is final


def test_age_and_identifier_and_display_name(spark):
    at = "timestamp'2020-01-01 00:00:00'"
    row = spark.sql(f"select {at} a, {at} + interval 2 second b, {at} + interval 3 second c").select(
        timing.age_text(F.col("a"), F.col("b")), timing.age_text(F.col("a"), F.col("c")), timing.age_text(F.lit(None), F.col("c")),
        values.identifier(F.lit("1a-b")), values.display_name(F.lit("s"), F.lit(2), F.lit(3)), values.display_name(F.lit("s"), F.lit(None).cast("int"), F.lit(1)),
    ).first()
    assert tuple(row) == ("Just now", "3s ago", "Unknown", "_1a_b", "s (shard-2, attempt-3)", "s")
