"""Whole-submission views: assembly, roll-ups and the status report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions import timing, values
from flowlens.operators import jobs as jb
from flowlens.operators import ordered, store
from flowlens.operators.jobs import SCOPE
from flowlens.operators.status import describe


def header(submissions: DataFrame, runs: DataFrame, kv: DataFrame) -> DataFrame:
    """Submissions with their runs; name, status and error of the key/value table overlay the row."""
    over = store.kv_pivot(kv, ["submission_id"], ["name", "status", "error"]).select(
        "submission_id", *[F.col(c).alias(f"_{c}") for c in ("name", "status", "error")]
    )
    subs = submissions.withColumnRenamed("id", "submission_id").join(over, "submission_id", "left")
    for c in ("name", "status", "error"):
        own = F.col(c) if c in submissions.columns else F.lit(None).cast("string")
        subs = subs.withColumn(c, F.coalesce(f"_{c}", own)).drop(f"_{c}")
    own_runs = runs.select(
        "submission_id", F.col("id").alias("run_id"), F.col("status").alias("run_status"), F.col("name").alias("run_name")
    )
    return subs.join(own_runs, "submission_id", "left")


def assemble(head: DataFrame, children: dict[str, tuple[DataFrame, Column, Column]], size: int = 1000) -> DataFrame:
    """Header rows with each child table gathered per run, one section after another.

    `children`: section name to (rows with the scope columns, identity, item text). Every child is
    gathered on its own before the join, so nothing multiplies; a section of a run takes as many
    rows (`part`) as its size needs.
    """
    sections = None
    for name, (rows, identity, item) in children.items():
        one = ordered.lists(rows, SCOPE, identity, {"items": item}, size).withColumn("section", F.lit(name))
        sections = one if sections is None else sections.unionByName(one)
    return head.join(sections, SCOPE, "left")


def run_bounds(jobs: DataFrame) -> DataFrame:
    """Per run: earliest start, latest finish once every job finished, collapsed status, counts."""
    from flowlens.functions import status as st

    return jobs.groupBy(*SCOPE).agg(
        F.min("start").alias("start"),
        F.when(F.count("finish") == F.count(F.lit(1)), F.max("finish")).alias("finish"),
        st.collapse(F.col("status"), F.struct("start", "id")).alias("status"),
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(F.col("status") == "failed").alias("failed_jobs"),
    )


def roll_up(runs: DataFrame, as_of: Column) -> DataFrame:
    """Per submission: bounds, last update, whole-second duration, statuses, run and job counts.

    A submission has a finish only when all of its runs have; until then the duration runs to `as_of`.
    """
    from flowlens.functions import status as st

    rolled = runs.groupBy("submission_id").agg(
        F.min("start").alias("start"),
        F.when(F.count("finish") == F.count(F.lit(1)), F.max("finish")).alias("finish"),
        F.max("last_updated").alias("last_updated"),
        st.collapse(F.col("status"), F.struct("start", "run_id")).alias("status"),
        F.array_join(F.sort_array(F.collect_set("status")), ", ").alias("statuses"),
        F.count(F.lit(1)).alias("runs"),
        F.sum("jobs").alias("jobs"),
        F.sum("failed_jobs").alias("failed_jobs"),
    )
    secs = F.coalesce(timing.rounded_seconds(F.col("start"), F.coalesce("finish", as_of)), F.lit(0))
    return rolled.withColumn("seconds", secs).withColumn("duration", timing.duration_text(secs)).withColumn(
        "updated", timing.age_text(F.col("last_updated"), as_of)
    )


def texts(submissions: DataFrame, runs: DataFrame, size: int = 1000) -> DataFrame:
    """Engine ids, distinct run names and errors per submission, in parts; a global error comes first."""
    def section(rows: DataFrame, name: str, order: int) -> DataFrame:
        one = ordered.lists(rows, ["submission_id"], F.col("text"), {"texts": F.col("text")}, size)
        return one.select(
            "submission_id", F.lit(name).alias("section"), F.lit(order).alias("ord"), "part", "parts", "n",
            F.array_join("texts", ", ").alias("text"),
        )

    def of(col: str) -> DataFrame:
        return runs.where(F.col(col).isNotNull() & (F.col(col) != "")).select("submission_id", F.col(col).alias("text"))

    top = submissions.where("error is not null").select(
        F.col("id").alias("submission_id"), F.lit("errors").alias("section"), F.lit(0).alias("ord"),
        F.lit(0).cast("bigint").alias("part"), F.lit(1).cast("bigint").alias("parts"), F.lit(1).cast("bigint").alias("n"),
        F.concat(F.lit("GLOBAL: "), "error").alias("text"),
    )
    return (
        section(of("engine_id"), "engine_ids", 1).unionByName(section(of("name").distinct(), "names", 1))
        .unionByName(top).unionByName(section(of("error"), "errors", 1))
    )


def _details() -> Column:
    def line(label: str, col: str) -> Column:
        return F.concat(F.lit(label + ": "), F.nullif(F.col(col), F.lit("")))

    status = F.col("status")
    cached = F.when(F.col("cached"), F.lit("from cache: True"))
    rc = F.when(~F.col("returncode").eqNullSafe("0"), F.concat(F.lit("rc: "), F.coalesce("returncode", F.lit("None"))))
    return F.array_compact(
        F.when(status == "completed", F.array(cached))
        .when(status == "running", F.array(line("batchid", "batchid"), line("backend", "backend")))
        .when(status == "failed", F.array(rc, line("stderr", "stderr"), line("error", "error")))
        .otherwise(F.array().cast("array<string>"))
    )


def status_report(jobs: DataFrame, as_of: Column, brief: bool = False) -> DataFrame:
    """Status lines in tree form: depth, symbol, display name, duration text, detail fields.

    `brief` hides what is below completed jobs, except below the only root of a run. A job with
    children shows no details, as its children carry them.
    """
    roots = jobs.where("parent is null").groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("_roots"))
    rows = jobs.join(roots, SCOPE, "left")
    only_root = F.col("parent").isNull() & (F.col("_roots") == 1)
    key = F.struct(
        F.when(F.col("parent").isNull(), 0).otherwise(F.coalesce("shard", F.lit(0))).alias("shard"),
        F.col("start").isNull().alias("no_start"), F.col("start").alias("start"), F.col("id").alias("id"),
        ((F.col("status") == "completed") & ~only_root).alias("folds"),
    )
    tree = jb.tree_paths(rows, key)
    if brief:
        above = F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))
        tree = tree.where(~F.exists(above, lambda p: p.getField("folds")))
    kids = jb.count_children(jobs)
    secs = F.when(F.col("start").isNotNull(), timing.rounded_seconds(F.col("start"), F.coalesce("finish", as_of)))
    folded = F.lit(brief) & F.col("path")[F.size("path") - 1].getField("folds")
    opened = (F.coalesce("children", F.lit(0)) > 0) & ~folded
    lined = describe(tree.join(kids, [*SCOPE, "id"], "left")).withColumn("seconds", secs)
    return lined.select(
        *SCOPE, "id", "path", "depth", "symbol",
        values.display_name(F.col("name"), F.col("shard"), F.col("attempt")).alias("name"),
        timing.duration_text(F.col("seconds")).alias("duration"),
        F.when(opened, F.array().cast("array<string>")).otherwise(_details()).alias("details"),
    )
