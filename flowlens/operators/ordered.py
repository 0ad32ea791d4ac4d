"""Ordered work inside groups of any size.

A plain window over a key puts the whole key into one task. When one run may own a third of all
rows that task never ends, so these operators cut each group into slices (a column that rises
with the order: a day, an hour, a block of line numbers). Rows are windowed inside
(key, slice); one summary row per slice is combined map-side and carried forward over the few
slices of the key, then joined back on (key, slice) - the partitioning the rows already have.
`slices` makes them from the data, by searched splitters of the keys that need any; with None for
`slice_by`, its answer where no key does, rows are windowed by key.

Contract: `order_by` are column names, ascending, that order a key's rows fully; `slice_by` never
decreases along that order; key columns are not null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.lineage import cut

SLICE = "_slice"
CARRY = "_carry"
#: Pieces that the rows of one group are counted in.
SALTS = 256
#: Column of the slices that `slices` makes.
MADE = "_made"
#: Rows up to which a whole table may meet in one task, and so needs no slices.
LEAST = 1_000_000
#: Splitters of a table, at most. With SAMPLED rows for each this bounds the sample, and what is broadcast.
MOST = 16_384
SAMPLED = 32


def time_slice(col: Column, unit: str = "DAY") -> Column:
    """Slice by calendar unit (a plain date for a day or more). Use HOUR where one day of one key is too much."""
    if unit == "DAY":
        return col.cast("date")
    return F.date_trunc(unit, col) if unit in ("HOUR", "MINUTE") else F.trunc(col.cast("date"), unit)


def number_slice(col: Column, size: int = 1_000_000) -> Column:
    return F.floor(col / size)


def sliced(df: DataFrame, keys: list[str], order_by: list[str], given: Column | None = None) -> tuple[DataFrame, Column | None]:
    """`df` with the slices its caller gives, or else those that `slices` makes."""
    return slices(df, keys, order_by) if given is None else (df.withColumn(MADE, given), F.col(MADE))


def slices(df: DataFrame, keys: list[str], order_by: list[str], least: int | None = None) -> tuple[DataFrame, Column | None]:
    """`df` with slices of about even size, made from the data, and the column that holds them; (`df`, None) where none are needed.

    A uniform sample by hash of at most about MOST * SAMPLED rows gives each key that holds much of the
    table splitters, values of `order_by` at even steps; a row's slice is found by binary search in those of its
    key. Slices hold about 1 / 16 of a task's share, so that a key that is the whole table, or a single day of it,
    still spreads evenly. Reads the keys and order of `df` twice before the plan that uses them; the splitters
    are the only rows broadcast. Rows that repeat in keys and order fall into one slice.
    """
    total, least = df.count(), least or LEAST
    if total <= least:
        return df, None
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(MOST, 16 * width)
    drawn = min((1 << 63) - 1, (1 << 63) * SAMPLED * parts // total)
    sample = df.select(*keys, F.struct(*order_by).alias("_at")).where(
        F.shiftrightunsigned(F.xxhash64(*keys, *order_by), 1) < F.lit(drawn)
    )
    of_key = Window.partitionBy(*keys)
    numbered = sample.select("*", F.row_number().over(of_key.orderBy("_at")).alias("_rn"), F.count(F.lit(1)).over(of_key).alias("_n"))
    ends = cut(
        numbered.where((F.col("_n") >= 2 * SAMPLED) & (F.col("_rn") % SAMPLED == 0))
        .groupBy(*keys).agg(F.sort_array(F.collect_list("_at")).alias("_ends"))
    )
    if ends.isEmpty():
        return df, None
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(MOST.bit_length()))])
    found = F.aggregate(
        steps, F.lit(0),
        lambda at, step: F.when(
            (at + step <= F.size("_ends")) & (F.get("_ends", at + step - 1) <= F.struct(*order_by)), at + step
        ).otherwise(at),
    )
    made = F.when(F.col("_ends").isNull(), 0).otherwise(found)
    return df.join(F.broadcast(ends), keys, "left").select(*df.columns, made.alias(MADE)), F.col(MADE)


def _key_window(keys: list[str], order_by: list[str]):
    return Window.partitionBy(*keys).orderBy(*order_by)


def _within(keys: list[str], order_by: list[str]):
    return Window.partitionBy(*keys, SLICE).orderBy(*order_by)


def _over_slices(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(SLICE)


def _join_carry(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(carry, [*keys, SLICE], "left")


def _order(order_by: list[str]) -> Column:
    return F.struct(*order_by)


def position(df: DataFrame, keys: list[str], order_by: list[str], slice_by: Column | None, name: str) -> DataFrame:
    """1-based position of each row inside its key."""
    if slice_by is None:
        return df.withColumn(name, F.row_number().over(_key_window(keys, order_by)).cast("bigint"))
    rows = df.withColumn(SLICE, slice_by)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, SLICE, F.sum("_n").over(before).alias(CARRY))
    )
    out = _join_carry(rows.withColumn(name, F.row_number().over(_within(keys, order_by))), carry, keys)
    return out.withColumn(name, F.col(name) + F.coalesce(CARRY, F.lit(0))).select(*df.columns, name)


def previous(
    df: DataFrame, keys: list[str], order_by: list[str], slice_by: Column | None, value: str, name: str
) -> DataFrame:
    """`value` of the row before, null on a key's first row."""
    if slice_by is None:
        return df.withColumn(name, F.lag(value).over(_key_window(keys, order_by)))
    rows = df.withColumn(SLICE, slice_by)
    carry = (
        rows.groupBy(*keys, SLICE).agg(F.max_by(value, _order(order_by)).alias("_last"))
        .select(*keys, SLICE, F.lag("_last").over(_over_slices(keys)).alias(CARRY))
    )
    w = _within(keys, order_by)
    seen = rows.withColumn("_rn", F.row_number().over(w)).withColumn(name, F.lag(value).over(w))
    return (
        _join_carry(seen, carry, keys)
        .withColumn(name, F.when(F.col("_rn") == 1, F.col(CARRY)).otherwise(F.col(name)))
        .select(*df.columns, name)
    )


def following(
    df: DataFrame, keys: list[str], order_by: list[str], slice_by: Column | None, value: str, name: str
) -> DataFrame:
    """`value` of the row after, null on a key's last row."""
    if slice_by is None:
        return df.withColumn(name, F.lead(value).over(_key_window(keys, order_by)))
    rows = df.withColumn(SLICE, slice_by)
    carry = (
        rows.groupBy(*keys, SLICE)
        .agg(F.min_by(value, _order(order_by)).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select(*keys, SLICE, "_n", F.lead("_first").over(_over_slices(keys)).alias(CARRY))
    )
    w = _within(keys, order_by)
    seen = rows.withColumn("_rn", F.row_number().over(w)).withColumn(name, F.lead(value).over(w))
    return (
        _join_carry(seen, carry, keys)
        .withColumn(name, F.when(F.col("_rn") == F.col("_n"), F.col(CARRY)).otherwise(F.col(name)))
        .select(*df.columns, name)
    )


def last_known(
    df: DataFrame, keys: list[str], order_by: list[str], slice_by: Column | None, value: str, name: str
) -> DataFrame:
    """Latest non-null `value` up to and including the row."""
    if slice_by is None:
        return df.withColumn(name, F.last(value, ignorenulls=True).over(_key_window(keys, order_by).rowsBetween(Window.unboundedPreceding, 0)))
    rows = df.withColumn(SLICE, slice_by)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col(value).isNotNull(), _order(order_by))
    carry = (
        rows.groupBy(*keys, SLICE).agg(F.max_by(value, known).alias("_last"))
        .select(*keys, SLICE, F.last("_last", ignorenulls=True).over(before).alias(CARRY))
    )
    upto = _within(keys, order_by).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn(name, F.last(value, ignorenulls=True).over(upto))
    return _join_carry(seen, carry, keys).withColumn(name, F.coalesce(name, CARRY)).select(*df.columns, name)


def _running(df, keys, order_by, slice_by, value, name, agg, join) -> DataFrame:
    if slice_by is None:
        return df.withColumn(name, join(agg(value).over(_key_window(keys, order_by).rowsBetween(Window.unboundedPreceding, 0)), F.lit(None)))
    rows = df.withColumn(SLICE, slice_by)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, SLICE).agg(agg(value).alias("_a"))
        .select(*keys, SLICE, agg("_a").over(before).alias(CARRY))
    )
    upto = _within(keys, order_by).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn(name, agg(value).over(upto))
    return _join_carry(seen, carry, keys).withColumn(name, join(F.col(name), F.col(CARRY))).select(*df.columns, name)


def running_sum(
    df: DataFrame, keys: list[str], order_by: list[str], slice_by: Column | None, value: str, name: str
) -> DataFrame:
    """Sum of `value` up to and including the row."""
    zero = F.lit(0)
    return _running(
        df, keys, order_by, slice_by, value, name, F.sum, lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero)
    )


def running_min(
    df: DataFrame, keys: list[str], order_by: list[str], slice_by: Column | None, value: str, name: str
) -> DataFrame:
    """Least `value` up to and including the row."""
    return _running(df, keys, order_by, slice_by, value, name, F.min, F.least)


def last_rows(df: DataFrame, keys: list[str], order_by: list[str], slice_by: Column, n: int) -> DataFrame:
    """The last `n` rows of each key; slices that lie before them are left out before any row is ranked."""
    rows = df.withColumn(SLICE, slice_by)
    later = Window.partitionBy(*keys).orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, SLICE, F.coalesce(F.sum("_n").over(later), F.lit(0)).alias(CARRY)).where(F.col(CARRY) < n)
    )
    backwards = Window.partitionBy(*keys, SLICE).orderBy(*[F.desc(c) for c in order_by])
    ranked = rows.join(carry, [*keys, SLICE]).withColumn("_rn", F.row_number().over(backwards))
    return ranked.where(F.col("_rn") + F.col(CARRY) <= n).select(*df.columns)


def hash_part(identity: Column, parts: Column) -> Column:
    """Part number of a row by its identity: stable across engines and retries."""
    return F.pmod(F.conv(F.substring(F.md5(identity), 1, 8), 16, 10).cast("bigint"), parts)


def lists(
    df: DataFrame, keys: list[str], identity: Column, items: dict[str, Column], size: int = 1000
) -> DataFrame:
    """Group rows into sorted arrays of about `size` items.

    A group is as many rows (`part` 0, 1, ...) as it needs, so no array holds a whole hot group and
    nothing is left out. Only groups of more than `size` rows need telling how many: that reaches their rows
    by (keys, salt), and the rows are dealt by (keys, part), so no task joins or gathers a whole group, and where
    there is no such group the items are shuffled once. Columns: keys, part, parts, n, then one array per item,
    ordered by the item structs. Rows with a null key belong to no group.
    """
    payload = F.struct(*[c.alias(n) for n, c in items.items()])
    whole = df.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
    gather = [F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("_item")).alias("_items")]
    counts = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > size)
    large = cut(counts.select(*keys, F.ceil(F.col("_n") / size).alias("parts")))
    if large.isEmpty():
        packed = whole.select(*keys, payload.alias("_item")).repartition(*keys).groupBy(*keys).agg(*gather)
        packed = packed.withColumn("part", F.lit(0).cast("bigint")).withColumn("parts", F.lit(1).cast("bigint"))
    else:
        salted = whole.select(*keys, payload.alias("_item"), hash_part(identity, F.lit(1 << 32)).alias("_hash")).withColumn("_salt", F.pmod(F.col("_hash"), F.lit(SALTS)))
        # At most SALTS rows a group meet its number of parts, whatever the group holds.
        sized = cut(salted.select(*keys, "_salt").distinct().join(large, keys))
        dealt = salted.join(sized, [*keys, "_salt"], "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
        packed = (
            dealt.withColumn("part", F.pmod(F.col("_hash"), F.col("parts")))
            .repartition(*keys, "part").groupBy(*keys, "part", "parts").agg(*gather)
        )
    return packed.select(*keys, "part", "parts", "n", *[F.col(f"_items.{n}").alias(n) for n in items])
