"""Sliced windows equal plain windows, also when one key owns a third of the rows and spans slices."""

import pytest
from pyspark.sql import functions as F

from flowlens.operators import ordered, telemetry


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(3000).selectExpr(
        "case when id % 3 = 0 then 'hot' else concat('k', id % 97) end k", "cast(hash(id) % 1000 as bigint) ord", "id",
        "case when id % 4 > 1 then id % 11 end v",
    ).cache()


OVER = "over (partition by k order by ord, id)"
UP_TO = "over (partition by k order by ord, id rows unbounded preceding)"
CASES = {
    "position": f"row_number() {OVER}",
    "previous": f"lag(v) {OVER}",
    "following": f"lead(v) {OVER}",
    "last_known": f"last(v, true) {UP_TO}",
    "running_sum": f"coalesce(sum(v) {UP_TO}, 0)",
    "running_min": f"min(v) {UP_TO}",
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("size", [7, 100, 10_000])
def test_sliced_equals_plain(rows, name, size):
    args = [rows, ["k"], ["ord", "id"], ordered.number_slice(F.col("ord"), size)]
    got = getattr(ordered, name)(*args, *(["x"] if name == "position" else ["v", "x"]))
    got = got.select("id", F.col("x").cast("bigint").alias("x"))
    want = rows.select("id", F.expr(CASES[name]).cast("bigint").alias("x"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("least", [100, 10_000])
def test_made_slices_equal_plain(rows, name, least):
    made, at = ordered.slices(rows, ["k"], ["ord", "id"], least)
    assert (at is None) == (least == 10_000)
    got = getattr(ordered, name)(made, ["k"], ["ord", "id"], at, *(["x"] if name == "position" else ["v", "x"]))
    got = got.select("id", F.col("x").cast("bigint").alias("x"))
    want = rows.select("id", F.expr(CASES[name]).cast("bigint").alias("x"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("n", [1, 17, 500, 5000])
def test_last_rows_equal_plain(rows, n):
    made, at = ordered.slices(rows, ["k"], ["ord", "id"], 100)
    got = ordered.last_rows(made, ["k"], ["ord", "id"], at, n).select("id")
    want = rows.select("id", F.expr("row_number() over (partition by k order by ord desc, id desc) rn")).where(F.col("rn") <= n).select("id")
    assert sorted(got.collect()) == sorted(want.collect())


def test_long_tails_go_through_slices(spark, monkeypatch):
    monkeypatch.setattr(ordered, "LEAST", 1000)
    lines = spark.range(20_000).selectExpr("case when id % 10 = 0 then 'b' else 'a' end run_id", "id line_no", "cast(id as string) line")
    got = telemetry.tail(lines, 1500)
    assert got.columns == lines.columns and "_made" in got._jdf.queryExecution().analyzed().toString()
    want = lines.withColumn("rn", F.expr("row_number() over (partition by run_id order by line_no desc)")).where("rn <= 1500")
    assert sorted(r.line_no for r in got.collect()) == sorted(r.line_no for r in want.collect())


def test_one_key_of_one_day_spreads_evenly(spark):
    """One run, all lines in one second, in a narrow band of numbers: no day and no block of lines would cut it."""
    rows = spark.range(3_000_000).selectExpr("'hot' k", "timestamp'2024-01-01 00:00:00' date", "id + 7000000000 seq")
    width = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        made, at = ordered.slices(rows, ["k"], ["date", "seq"])
        sizes = made.groupBy(at.alias("at")).count().agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most")).first()
        done = ordered.position(made, ["k"], ["date", "seq"], at, "x")
        tasks = done.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("int(x <> seq - 7000000000 + 1)")).alias("wrong"))
        most = tasks.agg(F.max("n"), F.sum("n"), F.sum("wrong")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes.n > 100 and sizes.most < 3 * 3_000_000 / sizes.n
    assert most[1] == 3_000_000 and most[2] == 0 and most[0] < 2 * 3_000_000 / 16


def test_null_keys_are_a_group(spark):
    rows = spark.sql("select if(id % 2 = 0, null, 'a') k, id from range(2000)")
    made, at = ordered.slices(rows, ["k"], ["id"], 100)
    got = ordered.position(made, ["k"], ["id"], at, "x")
    assert got.where("x <> id div 2 + 1").count() == 0 and got.count() == 2000


def test_lists_are_whole_and_bounded(rows):
    packed = ordered.lists(rows, ["k"], F.col("id").cast("string"), {"id": F.col("id")}, size=50)
    got = packed.select("k", F.explode("id").alias("id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.select("k", "id").collect()))
    assert packed.agg(F.max("n")).first()[0] < 120
    assert packed.where("k = 'hot'").count() > 10


def test_lists_gather_no_hot_group_in_a_task(spark):
    rows = spark.range(60_000).selectExpr("case when id % 3 = 0 then 'hot' else concat('k', id % 500) end k", "id")
    held = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        packed = ordered.lists(rows, ["k"], F.col("id").cast("string"), {"id": F.col("id")}, size=200)
        tasks = packed.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.sum("n").alias("n"), F.sum(F.expr("int(k = 'hot')")).alias("hot"))
        most = tasks.agg(F.max("n"), F.max("hot"), F.sum("hot")).first()
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    assert most[2] == 100 and most[1] <= 8 and most[0] < 4 * 60_000 / 64
