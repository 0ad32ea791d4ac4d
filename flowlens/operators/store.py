"""The run-history store: scans, lookups, upsert, change capture and partitioned writes."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import ordered
from flowlens.operators.lineage import cut, release, remove
from flowlens.schema import PROGRESS_KEYS, TableSpec, split_ddl

BUCKET = "_bucket"
#: Rows of one bucket and of one file; buckets and files follow the rows written.
BUCKET_ROWS, FILE_ROWS, MAX_BUCKETS = 1_000_000, 2_000_000, 4096
#: Deltas are folded into one when there are more; into the base when they hold this part of its rows.
MAX_DELTAS, DELTA_PART = 16, 0.25


# --- registers -------------------------------------------------------------------------------
# A register is a value with the sequence it was written at. Folding takes, for each field, the
# register with the largest sequence (at a tie the largest value), so any order of rows, any split
# into batches and any repeat of a batch gives the same table.


def _order(seq: Column, kind: str) -> Column:
    """A sequence as a number; timestamps by the microsecond."""
    return F.unix_micros(seq) if kind == "timestamp" else seq.cast("bigint")


def _kinds(spec: TableSpec) -> dict[str, str]:
    return dict(part.split(" ", 1) for part in split_ddl(spec.ddl))


def registers(rows: DataFrame, keys, seq: str | Column) -> DataFrame:
    """Keys, and each other column as a register; a null is no write. `seq` names a whole number or timestamp."""
    kind = dict(rows.dtypes)[seq] if isinstance(seq, str) else "bigint"
    at = _order(F.col(seq) if isinstance(seq, str) else seq, kind)
    rest = [c for c in rows.columns if c not in keys and c != seq]
    return rows.select(*keys, *[F.when(F.col(c).isNotNull(), F.struct(at.alias("seq"), F.col(c).alias("value"))).alias(c) for c in rest])


def fold(rows: DataFrame, keys) -> DataFrame:
    """One row of registers per key: of each field the latest. Combines before the shuffle; null keys match null."""
    kinds = dict(rows.dtypes)

    def latest(c: str) -> Column:
        if "variant" in kinds[c]:  # has no order of its own
            return F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(f"{c}.seq", F.to_json(f"{c}.value"))))
        return F.max(c)

    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[latest(c).alias(c) for c in rest]) if rest else rows.select(*keys).distinct()


def settled(rows: DataFrame, keys) -> DataFrame:
    """Registers as plain values."""
    return rows.select(*[F.col(c) if c in keys else F.col(f"{c}.value").alias(c) for c in rows.columns])


# --- files -----------------------------------------------------------------------------------
# A table is a base folder and delta folders of registers; a numbered layout record lists them with
# their number of buckets and rows. Data is only ever written into new folders and becomes visible
# with the next record, so a reader sees one state and a lost writer leaves none.


def _path(root: str, spec: TableSpec) -> str:
    return f"{root.rstrip('/')}/{spec.name}"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _records(spark: SparkSession, root: str, spec: TableSpec) -> list[int]:
    fs, path = _files(spark, f"{_path(root, spec)}/_layout")
    found = fs.listStatus(path) if fs.exists(path) else []
    names = [f.getPath().getName() for f in found]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def layout(spark: SparkSession, root: str, spec: TableSpec, version: int | None = None) -> dict:
    """The newest layout record (or a given one): its version and folders, the base first."""
    if version is None:
        known = _records(spark, root, spec)
        if not known:
            return {"version": 0, "folders": []}
        version = known[-1]
    fs, path = _files(spark, f"{_path(root, spec)}/_layout/{version:012d}.json")
    stream = fs.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def _commit(spark: SparkSession, root: str, spec: TableSpec, version: int, folders: list[dict]) -> bool:
    """Write the next record; false if another writer has taken its number."""
    fs, path = _files(spark, f"{_path(root, spec)}/_layout/{version:012d}.json")
    _, draft = _files(spark, f"{_path(root, spec)}/_layout/{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"version": version, "folders": folders}).encode()))
    out.close()
    # A rename onto a record that exists fails on HDFS; the check covers file systems that would replace it.
    if fs.exists(path) or not fs.rename(draft, path):
        fs.delete(draft, False)
        return False
    return True


def exists(spark: SparkSession, root: str, spec: TableSpec) -> bool:
    return bool(_records(spark, root, spec))


def bucket_of(scope: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(scope), F.lit(buckets)).cast("int")


def _scope_col(spec: TableSpec) -> str:
    return "submission_id" if "submission_id" in spec.columns else spec.keys[0]


def _typed(df: DataFrame, spec: TableSpec, seq: str | None, version: int) -> DataFrame:
    """Registers in those of the table's columns that `df` has; without `seq` a row counts as written at the table's next version."""
    kinds = _kinds(spec)
    extra = [F.col(seq).alias("_seq")] if seq else [F.lit(version).alias("_seq")]
    cols = [(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in spec.columns if c in df.columns or c in spec.keys]
    return registers(df.select(*cols, *extra), spec.keys, "_seq")


def _write_folder(rows: DataFrame, root: str, spec: TableSpec, kind: str, n_rows: int, bucket_rows: int, file_rows: int, folded: bool = True) -> dict:
    """Write registers into a new folder and describe it.

    Rows are placed by ranges of (bucket, key): a hot submission spreads over as many files as its rows
    ask for, and buckets with few rows share a task. A base has a folder per bucket; a delta, which
    is small, keeps the bucket as a column, sorted, so that it is pruned by its statistics. Rows that are
    not folded yet are folded where they are placed, without another shuffle; no key may be hot in them,
    and `n_rows` counts them before.
    """
    buckets = max(1, min(MAX_BUCKETS, -(-n_rows // bucket_rows)))
    name = f"{kind}-{uuid.uuid4().hex}"
    by = [BUCKET, *spec.keys]
    placed = rows.withColumn(BUCKET, bucket_of(F.col(_scope_col(spec)), buckets)).repartitionByRange(max(1, -(-n_rows // file_rows)), *by)
    writer = (placed if folded else fold(placed, by)).sortWithinPartitions(*by).write
    (writer.partitionBy(BUCKET) if kind == "base" else writer).parquet(f"{_path(root, spec)}/{name}")
    return _described(rows, root, spec, name, kind, buckets, n_rows if folded else None)


def _write_delta(rows: DataFrame, root: str, spec: TableSpec, base: dict, file_rows: int) -> dict:
    """Fold registers into a new delta and describe it.

    Its files are what the fold's shuffle leaves, so rows are shuffled once; each is sorted by bucket, so that it is
    pruned by its statistics. Deltas hold DELTA_PART of the base's rows at most before they are folded
    into it, and have that part of its buckets.
    """
    buckets = max(1, int(base["buckets"] * DELTA_PART))
    name = f"delta-{uuid.uuid4().hex}"
    by = [BUCKET, *spec.keys]
    placed = fold(rows, spec.keys).withColumn(BUCKET, bucket_of(F.col(_scope_col(spec)), buckets)).sortWithinPartitions(*by)
    placed.write.option("maxRecordsPerFile", file_rows).parquet(f"{_path(root, spec)}/{name}")
    return _described(rows, root, spec, name, "delta", buckets)


def _described(rows: DataFrame, root: str, spec: TableSpec, name: str, kind: str, buckets: int, n_rows: int | None = None) -> dict:
    """What the layout record says of a folder; rows that were not counted are told by its files' footers."""
    folder = {"name": name, "kind": kind, "buckets": buckets, "columns": rows.columns}
    if n_rows is None:
        n_rows = _stored(rows.sparkSession, root, spec, folder).count()
    return folder | {"rows": n_rows}


def _stored(spark: SparkSession, root: str, spec: TableSpec, folder: dict) -> DataFrame:
    """Registers of one folder with their bucket; columns that its files do not hold are null."""
    kinds = _kinds(spec)
    ddl = ", ".join([*(f"{c} {kinds[c]}" if c in spec.keys else f"{c} struct<seq: bigint, value: {kinds[c]}>" for c in spec.columns), f"{BUCKET} int"])
    return spark.read.schema(ddl).parquet(f"{_path(root, spec)}/{folder['name']}")


def _folder(spark: SparkSession, root: str, spec: TableSpec, folder: dict) -> DataFrame:
    """Registers of one folder.

    Its filter holds for every row. With `submission_id = 'x'` beside it, Catalyst puts the constant
    into it and folds the hash, and what is left is a filter on the bucket: SQL prunes by itself.
    """
    rows = _stored(spark, root, spec, folder)
    return rows.where(F.col(BUCKET) == bucket_of(F.col(_scope_col(spec)), folder["buckets"])).drop(BUCKET)


def read_registers(spark: SparkSession, root: str, spec: TableSpec, folders: list[dict] | None = None) -> DataFrame:
    """The folded registers of a table; a table without deltas needs no fold, so no shuffle."""
    folders = layout(spark, root, spec)["folders"] if folders is None else folders
    if not folders:
        raise ValueError(f"no table {spec.name} under {root}")
    parts = [_folder(spark, root, spec, f) for f in folders]
    return parts[0] if len(parts) == 1 else fold(reduce(DataFrame.unionByName, parts), spec.keys)


def read(spark: SparkSession, root: str, spec: TableSpec, scope: str | None = None) -> DataFrame:
    """A stored table: of each field the last value written. A filter on the scope column prunes to its bucket."""
    df = settled(read_registers(spark, root, spec), spec.keys)
    return df if scope is None else df.where(F.col(_scope_col(spec)) == scope)


def write(
    df: DataFrame, root: str, spec: TableSpec, seq: str | None = None, bucket_rows: int = BUCKET_ROWS, file_rows: int = FILE_ROWS,
) -> None:
    """Make a table of `df`, replacing what the table held."""
    spark, version = df.sparkSession, layout(df.sparkSession, root, spec)["version"] + 1
    rows = cut(fold(_typed(df, spec, seq, version), spec.keys))
    base = _write_folder(rows, root, spec, "base", rows.count(), bucket_rows, file_rows)
    release(rows)
    if not _commit(spark, root, spec, version, [base]):
        raise RuntimeError(f"another writer changed {spec.name} in the meantime")


def append(
    spark: SparkSession, root: str, spec: TableSpec, delta: DataFrame, seq: str | None = None,
    bucket_rows: int = BUCKET_ROWS, file_rows: int = FILE_ROWS,
) -> None:
    """Add rows as a delta: no stored row is read or rewritten.

    Fields that are null are no writes. With `seq` (a whole number or timestamp) the newest value of each
    field stays, whatever the order in which deltas arrive; without it the delta counts as newest. A table
    takes either kind, not both. Adding a delta again changes nothing.
    """
    added = None
    for _ in range(10):
        now = layout(spark, root, spec)
        if added is None or seq is None:
            typed = _typed(delta, spec, seq, now["version"] + 1)
            if now["folders"]:
                added = _write_delta(typed, root, spec, now["folders"][0], file_rows)
                if not added["rows"]:
                    remove(spark, f"{_path(root, spec)}/{added['name']}")
                    return
            else:
                rows = cut(fold(typed, spec.keys))
                added = _write_folder(rows, root, spec, "base", rows.count(), bucket_rows, file_rows)
                release(rows)
        if _commit(spark, root, spec, now["version"] + 1, [*now["folders"], added]):
            return
    raise RuntimeError(f"other writers keep changing {spec.name}")


def compact(
    spark: SparkSession, root: str, spec: TableSpec, whole: bool = True, bucket_rows: int = BUCKET_ROWS, file_rows: int = FILE_ROWS,
) -> None:
    """Fold all folders into a new base, or (`whole` false) the deltas into one delta. Readers go on undisturbed.

    Deltas that arrive meanwhile stay behind the folded ones; nothing is lost to a second compaction, which gives way.
    """
    old = layout(spark, root, spec)["folders"]
    chosen = old if whole else old[1:]
    if len(chosen) < 2:
        return
    # Each folder holds a key once, so no key is hot and one shuffle both places and folds.
    held = {c for f in chosen for c in f.get("columns", spec.columns)}
    rows = reduce(DataFrame.unionByName, [_folder(spark, root, spec, f) for f in chosen]).select(*[c for c in spec.columns if c in held])
    folded = _write_folder(rows, root, spec, "base" if whole else "delta", sum(f["rows"] for f in chosen), bucket_rows, file_rows, folded=False)
    gone = {f["name"] for f in chosen}
    for _ in range(10):
        now = layout(spark, root, spec)
        if not gone <= {f["name"] for f in now["folders"]}:
            return
        kept = [f for f in now["folders"] if f["name"] not in gone]
        folders = [folded, *kept] if whole else [kept[0], folded, *kept[1:]]
        if _commit(spark, root, spec, now["version"] + 1, folders):
            return


def merge(
    spark: SparkSession, root: str, spec: TableSpec, delta: DataFrame, seq: str | None = None,
    bucket_rows: int = BUCKET_ROWS, file_rows: int = FILE_ROWS,
) -> None:
    """Append a delta, then compact when that has become worth it: rewriting the base waits for a share of its rows."""
    append(spark, root, spec, delta, seq, bucket_rows, file_rows)
    base, *deltas = layout(spark, root, spec)["folders"]
    if sum(f["rows"] for f in deltas) > max(base["rows"] * DELTA_PART, bucket_rows * DELTA_PART):
        compact(spark, root, spec, True, bucket_rows, file_rows)
    elif len(deltas) > MAX_DELTAS:
        compact(spark, root, spec, False, bucket_rows, file_rows)


def vacuum(spark: SparkSession, root: str, spec: TableSpec, keep: int = 10) -> None:
    """Delete folders that none of the last `keep` layout records lists, and older records. Not beside a writer."""
    known = _records(spark, root, spec)
    live = {f["name"] for v in known[-keep:] for f in layout(spark, root, spec, v)["folders"]}
    fs, path = _files(spark, _path(root, spec))
    for entry in fs.listStatus(path):
        name = entry.getPath().getName()
        if name.startswith(("base-", "delta-")) and name not in live:
            fs.delete(entry.getPath(), True)
    for v in known[:-keep]:
        fs.delete(_files(spark, f"{_path(root, spec)}/_layout/{v:012d}.json")[1], False)


# --- reading ---------------------------------------------------------------------------------


def scan(
    table: DataFrame, columns: list[str] | None = None, scope: dict | None = None,
    where: str | Column | None = None,
) -> DataFrame:
    """Columns of a table inside a scope (column = value pairs) and an extra predicate."""
    df = table
    for name, value in (scope or {}).items():
        df = df.where(F.col(name) == F.lit(value))
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def lookup(table: DataFrame, wanted: DataFrame, keys: list[str], strict: bool = True, first_by: list[str] | None = None) -> DataFrame:
    """Rows for wanted keys. Strict: only keys with exactly one row. Otherwise the first by `first_by`.

    Both forms are aggregates, so a key with very many rows never gathers in a task.
    """
    hits = table.join(wanted.select(*keys).distinct(), keys, "left_semi")
    rest = [c for c in table.columns if c not in keys]
    row = F.struct(*rest)
    if strict:
        agg = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.any_value(row).alias("_r"))
        agg = agg.where("_n = 1")
    else:
        agg = hits.groupBy(*keys).agg(F.min_by(row, F.struct(*(first_by or rest))).alias("_r"))
    return agg.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def reached(submissions: DataFrame, progress: DataFrame, milestone: str) -> DataFrame:
    """Submissions that reached a milestone."""
    if milestone not in PROGRESS_KEYS:
        raise ValueError(f"unknown milestone: {milestone}")
    done = progress.where(F.col("key") == milestone).select("submission_id")
    return submissions.join(done, submissions.id == done.submission_id, "left_semi")


def latest_id(submissions: DataFrame) -> DataFrame:
    return submissions.orderBy(F.desc("timestamp"), F.asc("id")).limit(1).select("id")


def ids(table: DataFrame, key: str = "id") -> DataFrame:
    return table.select(key).distinct()


def kv_pivot(kv: DataFrame, scope: list[str], keys: list[str]) -> DataFrame:
    """One record per scope from key/value rows."""
    return kv.where(F.col("key").isin(keys)).groupBy(*scope).pivot("key", keys).agg(F.max("value"))


def kv_list(kv: DataFrame, submission: str = "*") -> DataFrame:
    """All keys and values of one submission, or of every one (`*`), in one pass."""
    df = kv if submission == "*" else kv.where(F.col("submission_id") == submission)
    return df.select("submission_id", "run_id", "key", "value").orderBy("submission_id", "run_id", "key")


def milestones(progress: DataFrame) -> DataFrame:
    """One row per submission, one column per milestone; the first occurrence counts."""
    return progress.groupBy("submission_id").pivot("key", PROGRESS_KEYS).agg(F.min("timestamp"))


# --- writing ---------------------------------------------------------------------------------


def _same_keys(left: str, right: str, keys: tuple[str, ...] | list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def reduce_delta(delta: DataFrame, keys, seq: str | None) -> DataFrame:
    """One row per key: the last non-null of every field. Without `seq` keys must not repeat."""
    if seq is None:
        return delta
    rest = [c for c in delta.columns if c not in (*keys, seq)]
    return delta.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in rest]
    )


def upsert(base: DataFrame, delta: DataFrame, keys, seq: str | None = None) -> DataFrame:
    """New keys insert; existing keys take the delta's non-null fields only. Null keys match null.

    One step from a base without history: a base keeps no sequences, so the delta counts as newer. Where
    batches may arrive in any order, keep `registers` and `fold` them, as stored tables do.
    """
    fresh = reduce_delta(delta, keys, seq)
    joined = base.alias("b").join(fresh.alias("d"), _same_keys("b", "d", keys), "full_outer")
    have = set(fresh.columns)
    return joined.select(
        *[
            (F.coalesce(F.col(f"d.{c}"), F.col(f"b.{c}")) if c in have else F.col(f"b.{c}")).alias(c)
            for c in base.columns
        ]
    )


def split_delta(base: DataFrame, delta: DataFrame, keys) -> DataFrame:
    """The delta with `change`: insert for unseen keys, update for known ones."""
    known = base.select(*keys).distinct().withColumn("_known", F.lit(True))
    return (
        delta.alias("d").join(known.alias("b"), _same_keys("d", "b", keys), "left")
        .select("d.*", F.when(F.col("b._known"), "update").otherwise("insert").alias("change"))
    )


def capture_changes(
    base: DataFrame, delta: DataFrame, keys: list[str], seq: str, compare: list[str] | None = None,
    slice_size: int | None = None,
) -> DataFrame:
    """Arriving job rows with `change`: unseen insert, differing update, same skip.

    Only `status` is compared unless `compare` names more. Inside a batch the row before (by `seq`)
    decides; the first row of a key is compared with the base.
    """
    fields = compare or ["status"]
    state = F.struct(*[F.col(c) for c in fields])
    rows, at = ordered.sliced(delta, keys, [seq], ordered.number_slice(F.col(seq), slice_size) if slice_size else None)
    tagged = ordered.previous(rows.withColumn("_state", state), keys, [seq], at, "_state", "_before")
    stored = base.select(*keys, state.alias("_stored"))
    joined = tagged.join(stored, keys, "left").withColumn("_before", F.coalesce("_before", "_stored"))
    change = (
        F.when(F.col("_before").isNull(), "insert")
        .when(F.col("_before").eqNullSafe(F.col("_state")), "skip")
        .otherwise("update")
    )
    return joined.select(*delta.columns, change.alias("change"))


def kv_replace(base: DataFrame, delta: DataFrame, scope: list[str], seq: str) -> DataFrame:
    """Last writer wins per (scope, key); a null is never written."""
    rows = base.unionByName(delta).where("value is not null")
    return rows.groupBy(*scope, "key").agg(F.max_by("value", seq).alias("value"))


def kv_changes(base: DataFrame, delta: DataFrame, scope: list[str]) -> DataFrame:
    """Only the fields of the delta that exist and differ from what is stored."""
    on = [*scope, "key"]
    stored = base.select(*on, F.col("value").alias("_old"))
    return (
        delta.where("value is not null").join(stored, on, "left")
        .where(~F.col("value").eqNullSafe(F.col("_old"))).select(*on, "value")
    )


def delete_ids(table: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def record_transitions(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (keys, status); a repeat refreshes its date."""
    cols = [*keys, "status", "date"]
    return base.select(*cols).unionByName(delta.select(*cols)).groupBy(*keys, "status").agg(F.max("date").alias("date"))


def stamp(rows: DataFrame, as_of: Column) -> DataFrame:
    return rows.withColumn("last_updated", as_of)


def latest_rows(rows: DataFrame, keys: list[str], updated: str, tie: list[str]) -> DataFrame:
    """Latest row per key (repairs a table without a primary key).

    `row_number() = 1` lets Spark keep one candidate per key on the map side, so a key that repeats
    millions of times is thinned before it is shuffled.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.col(updated).desc_nulls_last(), *[F.col(c).asc() for c in tie])
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
