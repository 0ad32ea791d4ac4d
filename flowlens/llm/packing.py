"""Packing into optimal length buckets.

Texts of one bucket are padded to the bucket's boundary. Dynamic programming over the histogram of
all lengths chooses the boundaries that waste the least padding; inside a bucket, batches are formed
that hold at most a token budget.

Scale: the histogram is aggregated map-side and has one cell for each multiple of `align` that
occurs, so it grows with the longest text, not with the table. Batches need positions inside a
bucket: rows are dealt by hash over slices whose number follows the table, ranked inside a slice,
and shifted by the running count of the slices before, so no task sees a whole bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.shared import n_words

BUCKETS, ALIGN, BUDGET, SLICE_ROWS = 16, 8, 65_536, 20_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries of at most `buckets` buckets with the least total padding; `lengths` ascend.

    cost(i, j), the padded size of cells i..j-1 in one bucket, satisfies the quadrangle inequality,
    so the best split points ascend with j and each layer is solved by divide and conquer, a whole
    depth of the recursion at a time.
    """
    n = len(lengths)
    if not n:
        return []
    total = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    best = np.concatenate([[0.0], total[1:] * lengths])  # one bucket
    splits = []
    for _ in range(min(buckets, n) - 1):
        layer, choice = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        layer[0] = 0.0
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(first, min(last, mid - 1) + 1)
            cost = best[i] + (total[mid] - total[i]) * lengths[mid - 1]
            at = int(np.argmin(cost))
            layer[mid], choice[mid] = cost[at], i[at]
            todo += [(lo, mid - 1, first, int(i[at])), (mid + 1, hi, int(i[at]), last)]
        splits.append(choice)
        best = layer
    ends, j = [], n
    for choice in reversed(splits):
        if not j:
            break
        ends.append(int(lengths[j - 1]))
        j = int(choice[j])
    if j:
        ends.append(int(lengths[j - 1]))
    return sorted(ends)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, align: int = ALIGN,
    budget: int = BUDGET,
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, bucket, padded, batch, slot.

    A token is a word; null and empty texts have none and are padded to `align` like the shortest.
    `padded` is the bucket's boundary, a multiple of `align`; a batch holds budget // padded rows, a
    text beyond the budget is a batch of its own. Batches are numbered from 0 in each bucket, slots
    in each batch. Rows are taken in the order of a hash of (id, length), then id; rows that tie in
    all of it are alike and take any of their slots; a null id is an id. Every batch but a bucket's last is full.
    An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).alias("doc_id"), n_words(F.col(text_col)).alias("n_tokens"))
    cell = F.greatest(F.ceil(F.col("n_tokens") / align), F.lit(1)).cast("long") * align
    histogram = sorted(sized.groupBy(cell.alias("cell")).count().collect())
    cells = np.array([r[0] for r in histogram], dtype=np.int64)
    counts = np.array([r[1] for r in histogram], dtype=np.int64)
    ends = boundaries(cells, counts, buckets)
    slices = max(1, -(-int(counts.sum()) // SLICE_ROWS))
    bucket = sum(((cell > e).cast("int") for e in ends[:-1]), F.lit(0))
    padded = F.element_at(F.array(*map(F.lit, ends or [align])).cast("array<long>"), F.col("bucket") + 1)
    order = F.xxhash64("doc_id", "n_tokens")
    rows = sized.withColumns({"bucket": bucket, "order": order, "slice": F.pmod(order, F.lit(slices))})
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy("bucket", "slice").count().select(
        "bucket", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift")
    )
    within = Window.partitionBy("bucket", "slice").orderBy("order", "doc_id", "n_tokens")
    at = F.col("shift") + F.row_number().over(within) - 1
    room = F.greatest(F.floor(F.lit(budget) / F.col("padded")), F.lit(1)).cast("long")
    return (
        rows.join(shift, ["bucket", "slice"]).withColumns({"at": at, "padded": padded})
        .withColumn("room", room)
        .select(
            "doc_id", "n_tokens", "bucket", "padded", F.floor(F.col("at") / F.col("room")).alias("batch"),
            (F.col("at") % F.col("room")).alias("slot"),
        )
    )
