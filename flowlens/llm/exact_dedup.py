"""Exact dedup by deterministic block naming.

A text is cut into blocks of fixed size. All blocks of the corpus are sorted and each gets its rank
among the distinct ones as its name; then neighbouring names are paired and the pairs are named in
the same way, level by level, until one name is left of each document. A name stands for exactly
one content, so equal (level, name) means equal text: no hash is trusted.

Scale: a level is one range sort on (content, row), so a hot block or a group of copies spreads over
as many partitions as its size asks for. A task needs only its own sorted rows to rank them; what
goes to the driver is three numbers per partition. Each level has half the rows of the one below.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.lineage import cut, release

BLOCK_BYTES = 4096


def _rank_sorted(keys: list[str], carry: list[str]):
    """Rank distinct keys inside one sorted partition; the first and last row also carry their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rank, last, held = TaskContext.get().partitionId(), -1, None, None

        def out(batch, ranks, first, final):
            n = batch.num_rows
            edge = {}
            for k in keys:
                column = batch.column(k)
                mask = [(first and i == 0) or (final and i == n - 1) for i in range(n)] if first or final else None
                edge[f"edge_{k}"] = (
                    pc.if_else(pa.array(mask), column, pa.scalar(None, column.type)) if mask else pa.nulls(n, column.type)
                )
            columns = {c: batch.column(c) for c in carry} | {"part": pa.array([part] * n, pa.int32()), "rank": ranks} | edge
            return pa.RecordBatch.from_pydict(columns)

        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            changed = None
            for k in keys:
                column = batch.column(k)
                own = pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1))
                head = pa.array([last is None or last[k] != column[0].as_py()])
                own = pa.concat_arrays([head, own])
                changed = own if changed is None else pc.or_(changed, own)
            ranks = pc.add(pc.cumulative_sum(changed.cast(pa.int64())), rank)
            rank, last = ranks[-1].as_py(), {k: batch.column(k)[-1].as_py() for k in keys}
            if held is not None:
                yield out(*held, first, False)
                first = False
            held = (batch, ranks)
        if held is not None:
            yield out(*held, first, True)

    return run


def name_by_sort(df: DataFrame, keys: list[str], carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """Add `name`: 1 + the rank of a row's keys among all distinct keys. `carry` holds a unique row identity.

    Returns the named rows and the written table behind them. Keys must not be null.
    """
    spark = df.sparkSession
    order = [*keys, "rid", "idx"]
    # Without a number, so that AQE may join small neighbours: a level with few rows writes few files.
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    types = dict(df.dtypes)
    schema = ", ".join(
        [f"{c} {types[c]}" for c in carry] + ["part int", "rank long"] + [f"edge_{k} {types[k]}" for k in keys]
    )
    ranked = cut(ordered.mapInArrow(_rank_sorted(keys, carry), schema))
    edges = ranked.where(F.col(f"edge_{keys[0]}").isNotNull())
    key = F.struct(*[f"edge_{k}" for k in keys])
    ends = edges.groupBy("part").agg(
        F.min_by(key, "rank").alias("low"), F.max_by(key, "rank").alias("high"), (F.max("rank") + 1).alias("n")
    )
    met = F.col("low") == F.lag("high").over(Window.orderBy("part"))  # two rows for each partition, no more
    offsets, start = [], 1
    for r in sorted(ends.select("part", "n", F.coalesce(met, F.lit(False)).alias("met")).collect()):
        start -= r["met"]
        offsets.append((r["part"], start))
        start += r["n"]
    # As many rows as partitions, two numbers each.
    starts = F.broadcast(spark.createDataFrame(offsets, "part int, start long"))
    return ranked.join(starts, "part").select(*carry, (F.col("start") + F.col("rank")).alias("name")), ranked


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical; null counts as the empty text, which forms a group like
    any other. Of a group the largest id stays; a null id stays only where a group has no other. Of
    rows that repeat id and text one is kept. An empty table gives an empty result; other columns
    are not read, whatever their names. Texts of any length are read whole.
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), body.alias("body"))
    count = F.greatest(F.ceil(F.octet_length("body") / block_bytes), F.lit(1)).cast("int")
    blocks = base.select(
        "rid", "doc_id", F.sha2("body", 256).alias("sha"), count.alias("n_blocks"),
        F.posexplode(
            F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring("body", i * block_bytes + 1, F.lit(block_bytes)))
        ).alias("idx", "block"),
    ).withColumn("sha", F.when(F.col("idx") == 0, F.col("sha")))
    named, bottom = name_by_sort(blocks, ["block"], ["rid", "doc_id", "sha", "n_blocks", "idx"])
    deepest = (named.agg(F.max("n_blocks")).first()[0] or 1) - 1
    whole = named.where("n_blocks = 1").select("rid", F.lit(0).alias("level"), "name")
    rest, tables = named.where("n_blocks > 1").select("rid", "n_blocks", "idx", "name"), []
    for level in range(1, deepest.bit_length() + 1):
        left, right = F.when(F.col("idx") % 2 == 0, F.col("name")), F.when(F.col("idx") % 2 == 1, F.col("name"))
        pairs = rest.groupBy("rid", F.shiftright("idx", 1).alias("idx")).agg(
            F.max("n_blocks").alias("n_blocks"), F.max(left).alias("a"), F.coalesce(F.max(right), F.lit(0)).alias("b")
        )
        named, written = name_by_sort(pairs, ["a", "b"], ["rid", "n_blocks", "idx"])
        tables.append(written)
        whole = whole.unionByName(named.where(f"n_blocks <= {1 << level}").select("rid", F.lit(level).alias("level"), "name"))
        rest = named.where(f"n_blocks > {1 << level}")
    rows = cut(
        bottom.where("idx = 0").select("rid", "doc_id", F.col("sha").alias("text_sha256")).join(whole, "rid")
    )
    release(bottom, *tables)
    groups = cut(
        rows.groupBy("level", "name").agg(F.max(F.struct("doc_id", "rid")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    alone = F.col("n").isNull()
    return rows.join(groups, ["level", "name"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("top.rid") == F.col("rid"))).alias("kept"),
        "text_sha256",
    )
