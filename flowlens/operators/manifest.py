"""Input manifests: layering, recipes, batching, checks, path shaping, source choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from flowlens.functions import paths, values
from flowlens.operators import ordered
from flowlens.operators.lineage import cut

ID = "manifest_id"


def pipeline(manifest: DataFrame, steps: list) -> DataFrame:
    """Apply a chain of DataFrame-to-DataFrame steps in order."""
    for step in steps:
        manifest = manifest.transform(step)
    return manifest


def cascade(layers: DataFrame, order: list[str]) -> DataFrame:
    """Last layer wins per name; combines map-side."""
    return layers.groupBy(ID, "name").agg(F.max_by("value", F.struct(*order)).alias("value"))


def require_on_top(inputs: DataFrame, required: DataFrame) -> DataFrame:
    """Inputs with the required ones laid over them."""
    both = inputs.withColumn("layer", F.lit(0)).unionByName(required.withColumn("layer", F.lit(1)))
    return cascade(both, ["layer"])


def with_recipes(inputs: DataFrame, wanted: DataFrame, file_recipes: DataFrame, inline_recipes: DataFrame) -> DataFrame:
    """Recipes by requested key order (file before inline for a key), with the user's inputs on top.

    `wanted`: manifest_id, ord, key. Recipes: key, name, value. Inputs: manifest_id, layer, name, value.
    """
    def rows(recipes: DataFrame, rank: int) -> DataFrame:
        return wanted.join(recipes, "key").select(
            ID, F.struct(F.lit(0).alias("own"), F.col("ord").cast("bigint").alias("at"), F.lit(rank).alias("rank")).alias("_at"), "name", "value"
        )

    own = inputs.select(
        ID, F.struct(F.lit(1).alias("own"), F.col("layer").cast("bigint").alias("at"), F.lit(0).alias("rank")).alias("_at"), "name", "value"
    )
    return cascade(rows(file_recipes, 0).unionByName(rows(inline_recipes, 1)).unionByName(own), ["_at"])


def unknown_recipes(wanted: DataFrame, *recipes: DataFrame) -> DataFrame:
    out = wanted
    for r in recipes:
        out = out.join(r.select("key"), "key", "left_anti")
    return out


def unknown_inputs(inputs: DataFrame, declared: DataFrame) -> DataFrame:
    """Required or strict inputs that the workflow does not declare."""
    return inputs.join(declared.select("workflow", "name"), ["workflow", "name"], "left_anti")


def undeclared_outputs(fields: DataFrame, outputs: DataFrame, compatible: DataFrame) -> DataFrame:
    """Validation fields that are no declared output, or one of an incompatible type.

    `fields`: workflow, field, wanted_type. `outputs`: workflow, name, type. `compatible`: sub, super.
    """
    declared = outputs.select("workflow", F.col("name").alias("field"), "type")
    fits = compatible.select(F.col("sub").alias("type"), F.col("super").alias("wanted_type"), F.lit(True).alias("_fits")).distinct()
    checked = fields.join(declared, ["workflow", "field"], "left").join(fits, ["type", "wanted_type"], "left")
    reason = F.when(F.col("type").isNull(), "not an output").when(
        F.col("_fits").isNull() & (F.col("type") != F.col("wanted_type")), "incompatible type"
    )
    return checked.withColumn("reason", reason).where("reason is not null").select("workflow", "field", "reason")


# --- batches -----------------------------------------------------------------------------------


def stack_batches(layers: DataFrame, fields: list[str]) -> DataFrame:
    """Group fields are concatenated over layers, others last-wins; as rows `name, pos, value`.

    `layers`: manifest_id, layer, name (unique together), value (ARRAY; a value too shallow comes as
    `scalar` and counts as a list of one).
    """
    listed = F.coalesce("value", F.when(F.col("scalar").isNotNull(), F.array("scalar")))
    grouped = layers.where(F.col("name").isin(fields)).select(ID, "layer", "name", listed.alias("_l")).where("_l is not null")
    # Offsets come from the list lengths of the layers, so no element is ever numbered by a window.
    offset = ordered.running_sum(
        grouped.withColumn("_n", F.size("_l")), [ID, "name"], ["layer"], ordered.number_slice(F.col("layer"), 1000), "_n", "_end"
    )
    stacked = offset.select(ID, "name", (F.col("_end") - F.col("_n")).alias("_start"), F.posexplode("_l").alias("_i", "value")).select(
        ID, "name", (F.col("_start") + F.col("_i")).alias("pos"), "value"
    )
    rest = layers.where(~F.col("name").isin(fields)).groupBy(ID, "name").agg(
        F.max_by(F.struct("value", "scalar"), F.col("layer")).alias("_v")
    )
    single = rest.select(ID, "name", F.posexplode_outer(F.coalesce("_v.value", F.array("_v.scalar"))).alias("pos", "value"))
    return stacked.unionByName(single.withColumn("pos", F.coalesce("pos", F.lit(0)).cast("bigint")))


def check_batches(inputs: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """Per manifest and field: missing, not an array, or of another length than the group list."""
    want = inputs.select(ID).distinct().withColumn("name", F.explode(F.array(*[F.lit(f) for f in fields])))
    sized = inputs.select(ID, "name", F.col("value").isNotNull().alias("is_array"), F.size("value").alias("n"), F.lit(True).alias("_have"))
    length = inputs.where(F.col("name") == group).select(ID, F.size("value").alias("expected"))
    checked = want.join(sized, [ID, "name"], "left").join(length, ID, "left")
    reason = (
        F.when(F.col("_have").isNull(), "missing").when(~F.col("is_array"), "not an array")
        .when(F.col("n") != F.col("expected"), F.concat_ws(" ", F.lit("length"), "n", F.lit("not"), "expected"))
    )
    return checked.withColumn("reason", reason).where("reason is not null").select(ID, "name", "reason")


def duplicate_groups(groups: DataFrame) -> DataFrame:
    """Group values that repeat, as given or once made identifiers. `groups`: manifest_id, value."""
    def repeats(col: Column, reason: str) -> DataFrame:
        return groups.groupBy(ID, col.alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("reason", F.lit(reason))

    return repeats(F.col("value"), "repeated").unionByName(repeats(values.identifier(F.col("value")), "repeated as identifier"))


def fan_out(inputs: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """Field i goes to group i as `{field}_{group}`; shared inputs stay once; the group list is kept.

    `inputs` are rows manifest_id, name, pos, value.
    """
    groups = inputs.where(F.col("name") == group).select(ID, "pos", values.identifier(F.col("value")).alias("_g"))
    fanned = inputs.where(F.col("name").isin(fields)).join(groups, [ID, "pos"]).select(
        ID, F.concat("name", F.lit("_"), "_g").alias("name"), F.lit(0).cast("bigint").alias("pos"), "value"
    )
    shared = inputs.where(~F.col("name").isin(fields)).select(ID, "name", F.col("pos").cast("bigint").alias("pos"), "value")
    listed = groups.select(ID, F.lit("groupby_field").alias("name"), F.col("pos").cast("bigint").alias("pos"), F.col("_g").alias("value"))
    return fanned.unionByName(shared).unionByName(listed)


#: Pieces of one workflow's groups in their join with its outputs.
SALTS = 16


def place_batch_outputs(groups: DataFrame, outputs: DataFrame) -> DataFrame:
    """One output per group: `{group}_{output}`, under the raw group value and the declared folders.

    `groups`: manifest_id, workflow, value. `outputs`: workflow, name, folders. Joined per workflow. What
    depends on one side alone is computed before the join, which multiplies. Groups are few bytes that become many
    rows, so they are dealt by (workflow, salt) to a number of tasks that AQE does not lower.
    """
    width = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = groups.select(ID, "workflow", F.pmod(F.xxhash64(ID, "value"), F.lit(SALTS)).cast("int").alias("_salt"), F.array("value").alias("_top"), F.concat(values.identifier(F.col("value")), F.lit("_")).alias("_prefix"))
    declared = outputs.select("workflow", "name", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.coalesce("folders", F.array().cast("array<string>")).alias("_below"))
    return named.repartition(width, "workflow", "_salt").join(declared, ["workflow", "_salt"]).select(
        ID, F.concat("_prefix", "name").alias("output_id"), F.col("name").alias("output_name"), F.concat("_top", "_below").alias("folders"),
    )


# --- files -------------------------------------------------------------------------------------


def qualify_paths(manifest: DataFrame, value: str, base: Column, home: Column) -> DataFrame:
    """Absolute paths for a file-typed column, arrays included."""
    kind = manifest.schema[value].dataType.simpleString()
    if kind == "string":
        out = paths.qualify(F.col(value), base, home)
    elif kind == "array<string>":
        out = F.transform(value, lambda p: paths.qualify(p, base, home))
    else:
        out = F.transform(value, lambda inner: F.transform(inner, lambda p: paths.qualify(p, base, home)))
    return manifest.withColumn(value, out)


def unwrap_files(manifest: DataFrame, value: str = "value", is_file: str = "is_file") -> DataFrame:
    """File objects `{path: ...}` to their path for file-typed inputs, as rows by list position.

    `value` is VARIANT; what cannot be unwrapped keeps its value and gets a `reason`.
    """
    from flowlens.operators.telemetry import _each, _is

    base = [c for c in manifest.columns if c != value]
    level = manifest.withColumn("path", F.array().cast("array<int>"))
    found = None
    while True:
        level = cut(level)
        if found is not None and level.isEmpty():
            return found
        is_list, is_obj = _is(F.col(value), "ARRAY"), _is(F.col(value), "OBJECT")
        inner = F.try_variant_get(value, "$.path", "string")
        reason = F.when(is_obj & ~F.col(is_file), "not a file input").when(is_obj & inner.isNull(), "no path")
        flat = level.where(~is_list | F.col(value).isNull()).select(
            *base, "path", F.coalesce(F.when(F.col(is_file) & is_obj, inner), F.try_variant_get(value, "$", "string"), F.to_json(value)).alias(value),
            reason.alias("reason"),
        )
        found = flat if found is None else found.unionByName(flat)
        level = _each(level.where(is_list).withColumnRenamed(value, "_l"), F.col("_l"), key="_k", value="_v").where("pos is not null").select(
            *base, F.concat("path", F.array("pos")).alias("path"), F.col("_v").alias(value)
        )


def file_elements(inputs: DataFrame, value: str) -> DataFrame:
    """Every path of a file input with its `suffix`: `[i]` per list level."""
    kind = inputs.schema[value].dataType.simpleString()
    rest = [c for c in inputs.columns if c != value]
    out = inputs.withColumn("suffix", F.lit(""))
    while kind.startswith("array<"):
        out = out.select(*rest, "suffix", F.posexplode(value).alias("_i", "_v")).select(
            *rest, F.concat("suffix", F.lit("["), F.col("_i").cast("string"), F.lit("]")).alias("suffix"), F.col("_v").alias(value)
        )
        kind = kind[len("array<"):-1]
    return out.withColumnRenamed(value, "path")


def missing_files(inputs: DataFrame, value: str, types: DataFrame, inventory: DataFrame) -> DataFrame:
    """Input files and their companions that do not exist.

    `inputs`: manifest_id, name, type, value. `types`: type, companions. Names carry `[i]` and `_ext`.
    """
    files = file_elements(inputs, value)
    own = files.select(ID, F.concat("name", "suffix").alias("name"), "path", F.lit(False).alias("secondary"))
    side = files.join(types.select("type", "companions"), "type").select(ID, "name", "suffix", "path", F.explode("companions").alias("_c")).select(
        ID, F.concat("name", F.lit("_"), paths.companion_suffix(F.col("_c")), "suffix").alias("name"),
        paths.companion(F.col("path"), F.col("_c")).alias("path"), F.lit(True).alias("secondary"),
    )
    return own.unionByName(side).join(inventory.select("path"), "path", "left_anti")


def odd_extensions(files: DataFrame, types: DataFrame) -> DataFrame:
    """File inputs that end with none of their type's extensions (types without any are skipped)."""
    typed = files.join(types.select("type", "extensions"), "type")
    ends = F.exists("extensions", lambda e: F.endswith(F.col("path"), e))
    return typed.where((F.size("extensions") > 0) & ~ends).drop("extensions")


def with_sizes(inputs: DataFrame, inventory: DataFrame) -> DataFrame:
    """File size next to file-typed inputs."""
    sized = inventory.select(F.col("path").alias("value"), F.col("size").alias("_size"))
    joined = inputs.join(sized, "value", "left")
    return joined.withColumn("size", F.when(F.col("is_file"), F.col("_size"))).drop("_size")


def check_types(declared: DataFrame, inputs: DataFrame) -> DataFrame:
    """Missing inputs and inputs of the wrong kind; a declared default stands in for an absent value.

    `declared`: manifest_id, name, kind, optional, default (VARIANT). `inputs`: manifest_id, name, value (VARIANT).
    """
    # The VARIANT schema each declared kind accepts.
    accepts = {"int": ["BIGINT"], "float": ["BIGINT", "DOUBLE", "DECIMAL"], "string": ["STRING"], "boolean": ["BOOLEAN"],
               "file": ["STRING", "OBJECT"], "array": ["ARRAY"]}
    joined = declared.join(inputs, [ID, "name"], "left")
    used = F.coalesce("value", "default")
    shape = F.schema_of_variant(used)
    ok = F.lit(False)
    for kind, shapes in accepts.items():
        for s in shapes:
            ok = ok | ((F.col("kind") == kind) & shape.startswith(s))
    empty = used.isNull() | F.coalesce(shape == "VOID", F.lit(False))
    reason = F.when(empty & ~F.col("optional"), "missing").when(~empty & ~ok, F.concat(F.lit("not a "), "kind"))
    return joined.withColumn("reason", reason).where("reason is not null").select(ID, "name", "kind", "reason")


# --- sources and conversions -------------------------------------------------------------------


def sourceable(declared: DataFrame, inputs: DataFrame) -> DataFrame:
    """File inputs that are absent, required, without a default, and declare a source.

    `declared`: manifest_id, name, is_file, optional, has_default, source (text) or sources (map).
    """
    given = inputs.where("value is not null").select(ID, "name")
    return declared.where(
        F.col("is_file") & ~F.col("optional") & ~F.col("has_default") & (F.col("source").isNotNull() | F.col("sources").isNotNull())
    ).join(given, [ID, "name"], "left_anti")


def choose_sources(wanted: DataFrame, hints: DataFrame) -> DataFrame:
    """A plain source as it is; of a source map the entry of the user's first matching hint.

    `wanted`: manifest_id, name, source, sources. `hints`: manifest_id, pos, hint. A source is a text or,
    in either column, a list of texts; where one of the columns holds lists, a text becomes a list of one.
    """
    plain = wanted.where("source is not null").select(ID, "name", "source")
    entries = wanted.where("source is null").select(ID, "name", F.explode("sources").alias("hint", "source"))
    chosen = entries.join(hints, [ID, "hint"]).groupBy(ID, "name").agg(F.min_by("source", "pos").alias("source"))
    branches = [plain, chosen]
    lists = [isinstance(df.schema["source"].dataType, ArrayType) for df in branches]
    if any(lists):
        branches = [df if listed else df.withColumn("source", F.array("source")) for df, listed in zip(branches, lists, strict=True)]
    return branches[0].unionByName(branches[1])


def conversion_paths(pairs: DataFrame, conversions: DataFrame) -> DataFrame:
    """Shortest conversion path from a guessed to a wanted type, ties by path text; absent when none.

    `pairs`: guessed, wanted. `conversions`: from, to. Breadth-first by joins over distinct types: each
    level keeps one best path per (start, reached) and drops what an earlier level reached, so the
    levels end by themselves, after the longest shortest path.
    """
    edges = cut(conversions.select(F.col("from").alias("_at"), F.col("to").alias("_to")).distinct())
    todo = cut(pairs.select("guessed", "wanted").distinct())
    reach = cut(todo.select(F.col("guessed").alias("start")).distinct().select("start", F.col("start").alias("_at"), F.col("start").alias("path"), F.lit(0).alias("steps")))
    level, step = reach, 0
    while not level.isEmpty():
        step += 1
        grown = level.join(edges, "_at").groupBy("start", "_to").agg(F.min(F.concat("path", F.lit(" -> "), "_to")).alias("path"))
        level = cut(
            grown.select("start", F.col("_to").alias("_at"), "path", F.lit(step).alias("steps"))
            .join(reach.select("start", "_at"), ["start", "_at"], "left_anti")
        )
        reach = reach.unionByName(level)
    found = reach.where("steps > 0").select(F.col("start").alias("guessed"), F.col("_at").alias("wanted"), "path", "steps")
    return todo.where("guessed <> wanted").join(found, ["guessed", "wanted"], "left")
