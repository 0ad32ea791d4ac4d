"""Job trees: shards, children, descendants, labels and report order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions import status as st
from flowlens.operators.lineage import cut

SCOPE = ["submission_id", "run_id"]


def clean_numbers(df: DataFrame, shard: str = "shard", attempt: str = "attempt") -> DataFrame:
    """Negative shards and first attempts become null; digit strings are cast."""
    s, a = F.col(shard).try_cast("int"), F.col(attempt).try_cast("int")
    return df.withColumn(shard, F.when(s >= 0, s)).withColumn(attempt, F.when(a > 1, a))


def roll_up_shards(jobs: DataFrame, keys: list[str], ord: str | Column) -> DataFrame:
    """One parent per scattered step: earliest start, latest finish once all finished, one status."""
    ordc = F.col(ord) if isinstance(ord, str) else ord
    return jobs.groupBy(*keys).agg(
        F.min("start").alias("start"),
        F.when(F.count("finish") == F.count(F.lit(1)), F.max("finish")).alias("finish"),
        st.collapse(F.col("status"), ordc).alias("status"),
        F.count(F.lit(1)).alias("jobs"),
    )


def with_parents(shard_jobs: DataFrame, plain_jobs: DataFrame, ord: Column) -> DataFrame:
    """Synthesised scatter parents together with plain jobs and the shards themselves."""
    parents = (
        roll_up_shards(shard_jobs.where("parent is not null"), [*SCOPE, "parent"], ord)
        .drop("jobs").withColumnRenamed("parent", "id").withColumn("kind", F.lit("parent"))
    )
    return (
        parents.unionByName(shard_jobs.withColumn("kind", F.lit("shard")), allowMissingColumns=True)
        .unionByName(plain_jobs.withColumn("kind", F.lit("plain")), allowMissingColumns=True)
    )


def attach_parents(jobs: DataFrame) -> DataFrame:
    """Each job with its parent's fields and `place`: root, child, or orphan (its parent is not there)."""
    up = jobs.select(
        *SCOPE, F.col("id").alias("parent"), F.col("name").alias("parent_name"),
        F.col("status").alias("parent_status"), F.lit(True).alias("_up"),
    )
    place = (
        F.when(F.col("parent").isNull(), "root").when(F.col("_up"), "child").otherwise("orphan")
    )
    return jobs.join(up, [*SCOPE, "parent"], "left").withColumn("place", place).drop("_up")


def count_children(jobs: DataFrame) -> DataFrame:
    """Children per parent, counted before any join."""
    return jobs.where("parent is not null").groupBy(*SCOPE, F.col("parent").alias("id")).agg(
        F.count(F.lit(1)).alias("children")
    )


def descendants(jobs: DataFrame, roots: DataFrame) -> DataFrame:
    """Every descendant of the given jobs with its depth: (scope, root, id, depth).

    `jobs` is read at every level: pass a stored table. The frontier of each level is cut through the
    checkpoint folder. A node already on its own path is dropped, so cycles end.
    """
    edges = jobs.where("parent is not null").select(*SCOPE, F.col("parent").alias("_at"), F.col("id").alias("_to"))
    level = roots.select(*SCOPE, F.col("id").alias("root"), F.col("id").alias("_at"), F.array("id").alias("_path"))
    found, depth = None, 0
    while True:
        depth += 1
        step = (
            level.join(edges, [*SCOPE, "_at"])
            .where(~F.array_contains("_path", F.col("_to")))
            .select(*SCOPE, "root", F.col("_to").alias("_at"), F.concat("_path", F.array("_to")).alias("_path"))
        )
        level = cut(step)
        if level.isEmpty():
            break
        rows = level.select(*SCOPE, "root", F.col("_at").alias("id"), F.lit(depth).alias("depth"))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = level.select(*SCOPE, "root", F.col("_at").alias("id"), F.lit(0).alias("depth"))
    return found


def tree_paths(jobs: DataFrame, sort_key: Column) -> DataFrame:
    """Jobs reachable from a root with depth and a sort path, so one range sort gives report order.

    `jobs` is read at every level: pass a stored table rather than a long derivation.
    """
    nodes = jobs.withColumn("_key", sort_key)
    edges = nodes.where("parent is not null").select(
        *SCOPE, F.col("parent").alias("_at"), F.col("id").alias("_to"), F.col("_key").alias("_k")
    )
    level = cut(
        nodes.where("parent is null").select(
            *SCOPE, "id", F.array("_key").alias("path"), F.array("id").alias("_seen"), F.lit(0).alias("depth")
        )
    )
    found, depth = level, 0
    while True:
        depth += 1
        level = cut(
            level.withColumnRenamed("id", "_at").join(edges, [*SCOPE, "_at"])
            .where(~F.array_contains("_seen", F.col("_to")))
            .select(
                *SCOPE, F.col("_to").alias("id"), F.concat("path", F.array("_k")).alias("path"),
                F.concat("_seen", F.array("_to")).alias("_seen"), F.lit(depth).alias("depth"),
            )
        )
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return nodes.drop("_key").join(found.drop("_seen"), [*SCOPE, "id"])


def report_order(jobs: DataFrame) -> DataFrame:
    """Depth-first report order: roots by start, children by (shard or 0, start), missing start last."""
    start = F.struct(
        F.when(F.col("parent").isNull(), 0).otherwise(F.coalesce("shard", F.lit(0))).alias("shard"),
        F.col("start").isNull().alias("no_start"), F.col("start").alias("start"), F.col("id").alias("id"),
    )
    return tree_paths(jobs, start).orderBy(*SCOPE, "path")


def label_shards(jobs: DataFrame, labels: DataFrame) -> DataFrame:
    """Children of a labelled root scatter take the label at their shard index, when in range."""
    roots = jobs.where("parent is null").select(*SCOPE, F.col("id").alias("parent"))
    by_parent = labels.withColumnRenamed("job_id", "parent").join(roots, [*SCOPE, "parent"], "left_semi")
    label = F.when(F.col("shard") >= 0, F.get("labels", F.col("shard")))
    return (
        jobs.join(by_parent.select(*SCOPE, "parent", "labels"), [*SCOPE, "parent"], "left")
        .withColumn("name", F.coalesce(label, "name")).drop("labels")
    )


def count_jobs(jobs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return jobs.groupBy(*(keys or ["submission_id"])).agg(F.count(F.lit(1)).alias("jobs"))


def label_rows(steps: DataFrame, manifest: DataFrame) -> DataFrame:
    """One label array per labelled scatter step, resolved from the manifest input it names."""
    values = manifest.select(
        *SCOPE, F.col("name").alias("labels_from"), F.col("value").alias("labels")
    )
    return (
        steps.where("labels_from is not null").join(values, [*SCOPE, "labels_from"])
        .where("labels is not null").select(*SCOPE, F.col("step").alias("job_id"), "labels")
    )
