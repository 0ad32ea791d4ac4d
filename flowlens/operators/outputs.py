"""Output declarations, the output and log file plans, and output texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions import paths
from flowlens.operators.lineage import cut


def output_values(outputs: DataFrame, submissions: DataFrame) -> DataFrame:
    """Name and value of the outputs of completed submissions: value, else new path; empty ones dropped."""
    done = submissions.where("status = 'completed'").select(F.col("id").alias("submission_id"))
    value = F.coalesce(F.nullif("value", F.lit("")), F.nullif("new_path", F.lit("")))
    return outputs.join(done, "submission_id", "left_semi").withColumn("value", value).where("value is not null")


def compare_outputs(declared: DataFrame, returned: DataFrame, keys: list[str]) -> DataFrame:
    """Declared outputs with `state`: ok, absent, or empty. `returned.value` is text or array."""
    got = returned.select(*keys, "value", F.lit(True).alias("_got"))
    kind = returned.schema["value"].dataType.simpleString()
    empty = F.size("value") <= 0 if kind.startswith("array") else F.length("value") == 0
    state = F.when(F.col("_got").isNull() | F.col("value").isNull(), "absent").when(empty, "empty").otherwise("ok")
    return declared.join(got, keys, "left").withColumn("state", state).drop("_got")


def output_parameters(declared: DataFrame, types: DataFrame) -> DataFrame:
    """Copyable?, extension and companions of each declared output.

    `declared`: ..., kind (file, directory or a value kind, lists already removed), type, extension,
    override. `types`: type, default_extension, companions. Only files take the type's defaults.
    """
    dim = types.select("type", "default_extension", F.col("companions").alias("_sec"))
    is_file = F.col("kind") == "file"
    return declared.join(dim, "type", "left").select(
        *[c for c in declared.columns if c not in ("extension", "override")],
        F.col("kind").isin("file", "directory").alias("is_copyable"),
        F.coalesce("extension", "override", F.when(is_file, F.col("default_extension"))).alias("extension"),
        F.when(is_file, F.col("_sec")).alias("secondaries"),
    )


def _place(folders: Column, names: Column, at: Column, sizes: Column) -> Column:
    """Folders, names and shard numbers left after walking down the list levels of one element.

    At each level of n elements: the first folder list of length n gives its own element and saves a
    shard number, and so does a list of several names when n > 1.
    """
    # The casts make every field nullable, as the fold's result may hold nulls its start does not.
    start = F.struct(
        folders.cast("array<struct<text:string,list:array<string>>>").alias("folders"),
        names.cast("array<string>").alias("names"), F.array().cast("array<int>").alias("shard"),
    )

    def step(acc: Column, k: Column) -> Column:
        n, i = F.get(sizes, k), F.get(at, k)
        fol, nam = acc.getField("folders"), acc.getField("names")
        hit = F.array_position(F.transform(fol, lambda f: F.coalesce(F.size(f.getField("list")) == n, F.lit(False))), True)
        opened = F.transform(
            fol,
            lambda f, j: F.when(
                j + 1 == hit,
                F.struct(F.get(f.getField("list"), i).alias("text"), F.lit(None).cast("array<string>").alias("list")),
            ).otherwise(f),
        )
        by_name = F.coalesce((n > 1) & (F.size(nam) > 1), F.lit(False))
        drop = F.when(F.coalesce(hit > 0, F.lit(False)), 1).otherwise(0) + F.when(by_name, 1).otherwise(0)
        shard = F.concat(acc.getField("shard"), F.array(i))
        return F.struct(
            opened.alias("folders"), F.when(by_name, F.array(F.get(nam, i))).otherwise(nam).alias("names"),
            F.slice(shard, F.least(drop, F.size(shard)) + 1, F.size(shard)).alias("shard"),
        )

    levels = F.when(F.size(at) > 0, F.sequence(F.lit(0), F.size(at) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(levels, start, step)


def plan_outputs(outputs: DataFrame) -> DataFrame:
    """Final name and folder of every output element; nothing is copied.

    `outputs`: output_id, output_dir, name_mode (original, id, given), names (array), folders (array of
    struct text/list), extension, is_copyable, value, at (list positions), sizes (list lengths).
    """
    placed = outputs.withColumn("_s", _place(F.col("folders"), F.col("names"), F.col("at"), F.col("sizes")))
    unopened = F.exists("_s.folders", lambda f: f.getField("list").isNotNull())
    tags = F.when(F.col("_s.folders").isNull() | unopened, F.array().cast("array<string>")).otherwise(
        F.transform("_s.folders", lambda f: f.getField("text"))
    )
    has_path = F.col("is_copyable") & F.col("value").isNotNull()
    original = (F.col("name_mode") == "original") & has_path
    stem = F.when(original, paths.basename(F.col("value"))).when(
        F.col("name_mode") == "given", F.coalesce(F.get("_s.names", F.lit(0)), "output_id")
    ).otherwise(F.col("output_id"))
    shards = F.array_join(F.transform("_s.shard", lambda s: F.concat(F.lit("_shard-"), s.cast("string"))), "")
    ext = F.coalesce("extension", F.when(has_path, F.concat(F.lit("."), paths.extension(F.col("value")))), F.lit(""))
    name = F.when(original, stem).otherwise(F.concat(stem, shards, ext))
    folder = F.concat_ws("/", F.rtrim("output_dir", F.lit("/")), F.nullif(F.array_join(tags, "/"), F.lit("")))
    return placed.withColumn("folder", folder).withColumn("file_name", name).withColumn(
        "new_path", F.concat("folder", F.lit("/"), "file_name")
    ).drop("_s")


def plan_companions(plan: DataFrame) -> DataFrame:
    """Companion copies of planned outputs: where each comes from and goes to."""
    each = plan.where("is_copyable and value is not null").select("*", F.explode("secondaries").alias("_c"))
    return each.select(
        "output_id", "at", paths.companion(F.col("value"), F.col("_c")).alias("source"),
        F.concat("folder", F.lit("/"), paths.companion(F.col("file_name"), F.col("_c"))).alias("new_path"),
    )


def collisions(plan: DataFrame, keys: list[str]) -> DataFrame:
    """Destinations that more than one element would be written to."""
    return plan.groupBy(*keys, "new_path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def plan_logs(jobs: DataFrame, inventory: DataFrame, log_dir: Column) -> DataFrame:
    """Log copies of jobs: `{job}[shard-n]_{stdout,stderr,script}` for the files that exist."""
    kinds = ["stdout", "stderr", "script"]
    # Three rows a job meet the inventory: they carry numbers, and texts are made of those that are there.
    each = F.posexplode(F.array(*kinds)).alias("_kind", "source")
    rows = jobs.select("submission_id", "run_id", "id", "shard", each).withColumn("_kind", F.col("_kind").cast("byte"))
    present = rows.where("source is not null").join(inventory.select(F.col("path").alias("source")), "source", "left_semi")
    base = F.concat(F.col("id"), F.coalesce(F.concat(F.lit("shard-"), F.col("shard").cast("string")), F.lit("")))
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), F.col("_kind").cast("int"))
    named = present.select("source", "submission_id", "run_id", "id", base.alias("_base"), kind.alias("kind"))
    return named.withColumn("target", F.concat(log_dir, F.lit("/"), "_base", F.lit("_"), "kind")).drop("_base")


def common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.substring(a, F.lit(1), F.array_max(same))


def summarise_paths(rows: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Many paths as `(multiple) prefix*`; the prefix of a set is that of its least and greatest."""
    lo, hi = F.min(path), F.max(path)
    agg = rows.groupBy(*keys).agg(lo.alias("_lo"), hi.alias("_hi"), F.count(path).alias("paths"))
    text = F.when(F.col("paths") == 0, "").when(F.col("paths") == 1, F.col("_lo")).otherwise(
        F.concat(F.lit("(multiple) "), common_prefix(F.col("_lo"), F.col("_hi")), F.lit("*"))
    )
    return agg.select(*keys, "paths", text.alias("summary"))


def scatter_gather(values: DataFrame, width: int, levels: int) -> DataFrame:
    """Hash each value, join the hashes of `width` neighbours with commas, hash again, level by level.

    `values`: n (0, 1, 2, ... unique), value. A group holds at most `width` members by construction.
    """
    level = values.select("n", F.md5(F.col("value").cast("string")).alias("hash"))
    for _ in range(levels):
        packed = level.groupBy(F.floor(F.col("n") / width).alias("n")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("n").alias("at"), "hash"))).alias("_h")
        )
        level = packed.select("n", F.md5(F.array_join("_h.hash", ",")).alias("hash"))
    return level


def join_lists(df: DataFrame, key: str, value: str, sep: str) -> DataFrame:
    """`key, joined`: the VARIANT `value`, lists of lists of any and mixed depth, as one text.

    Each level of lists is opened by one explode; what is no list is a leaf, and leaves are joined in the
    order of their positions. A null inside prints `None`, a truth value `True` or `False`, an empty list
    an empty text, an object its JSON. A value that is no list is its own text; a null value stays null.
    `key` tells rows apart, so a group is never more than one row's own list.
    """
    spark = df.sparkSession
    kind = F.schema_of_variant("v")
    text = (
        F.when(F.col("_end"), "").when(F.is_variant_null("v"), F.when(F.size("at") > 0, "None"))
        .when(kind == "BOOLEAN", F.initcap(F.try_variant_get("v", "$", "string")))
        .otherwise(F.coalesce(F.try_variant_get("v", "$", "string"), F.to_json("v")))
    )
    level = cut(df.select(key, F.array().cast("array<int>").alias("at"), F.col(value).alias("v"), F.lit(False).alias("_end")))
    leaves = None
    while leaves is None or not level.isEmpty():
        listed = F.coalesce(kind.startswith("ARRAY"), F.lit(False))
        done = level.where(~listed).select(key, "at", text.alias("text"))
        leaves = done if leaves is None else leaves.unionByName(done)
        opened = level.where(listed).select(key, "at", F.col("v").alias("_list")).lateralJoin(spark.tvf.variant_explode_outer(F.col("_list").outer()))
        level = cut(opened.select(
            key, F.concat("at", F.array(F.coalesce(F.col("pos"), F.lit(0)))).alias("at"), F.col("value").alias("v"), F.col("pos").isNull().alias("_end")
        ))
    parts = F.array_sort(F.collect_list(F.struct("at", "text")))
    joined = leaves.groupBy(key).agg(parts.alias("_parts"))
    return joined.select(key, F.when(
        (F.size("_parts") > 1) | F.get("_parts", F.lit(0))["text"].isNotNull(), F.array_join(F.col("_parts.text"), sep)
    ).alias("joined"))
