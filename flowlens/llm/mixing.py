"""Mixing sources to target weights by pivotal dependent rounding.

A source with target t and size s wants each of its texts t / s times: the whole part is given, the
rest is a probability. Two texts with fractional probabilities are paired; words are moved from one
to the other, in a random direction whose odds keep both probabilities right on average, until one
of them is integral. Words are conserved in each step, so a source ends within one text of its
target. Each shard of a source leaves at most one fractional text; these meet in a reduction tree.

Scale: texts are dealt to shards of about SHARD_ROWS by a hash, so a hot source is as many shards as
it needs. Only ids and sizes move. Randomness is a hash of seed, source, level and shard, and a
shard is worked off in a fixed order, so a rerun or a lost executor gives the same mix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.shared import n_words
from flowlens.operators.lineage import cut

WEIGHTS, SHARE, MOST, SHARD_ROWS, FAN_IN = (3, 1, 2), 1.5, 2, 20_000, 1_000


def source_targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words each source should give.

    Sources by code point, null last, weigh `weights` in turn and share `share` times all words; a
    target stops at `most` times its source, and the excess is shared again by weight among the others.
    """
    names = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + [None] * (None in sizes)
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    left, open_, targets = share * sum(sizes.values()), list(names), dict.fromkeys(names, 0.0)
    while open_:
        unit = left / sum(weight[k] for k in open_)
        full = [k for k in open_ if weight[k] * unit >= most * sizes[k]]
        if not full:
            return targets | {k: weight[k] * unit for k in open_}
        targets |= {k: float(most * sizes[k]) for k in full}
        left = max(0.0, left - sum(most * sizes[k] for k in full))
        open_ = [k for k in open_ if k not in full]
    return targets


def round_shard(sizes: np.ndarray, fractions: np.ndarray, seed: str, last: bool) -> np.ndarray:
    """Round fractions in order so that their words are conserved; one may stay open unless `last`."""
    out = fractions.copy()
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "big"))
    draws = iter(rng.random(len(out) + 1))
    held = -1
    for i in range(len(out)):
        if not 0 < out[i] < 1:
            continue
        if sizes[i] == 0:  # carries no words: rounded by itself
            out[i] = float(next(draws) < out[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = sizes[held], sizes[i]
        up = min((1 - out[held]) * a, out[i] * b)  # words that can move to the held text
        down = min(out[held] * a, (1 - out[i]) * b)
        moved = up if next(draws) * (up + down) < down else -down
        full = (moved == (1 - out[held]) * a, moved == out[i] * b, -moved == out[held] * a, -moved == (1 - out[i]) * b)
        out[held], out[i] = out[held] + moved / a, out[i] - moved / b
        if full[0] or full[2]:
            out[held] = float(full[0])
        if full[1] or full[3]:
            out[i] = float(full[3])
        for k in (held, i):
            if not 1e-12 < out[k] < 1 - 1e-12:
                out[k] = round(out[k])
        held = next((k for k in (held, i) if 0 < out[k] < 1), -1)
    if last and held >= 0:
        out[held] = float(next(draws) < out[held])
    return out


def _round_group(seed: str, level: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows["_place"]))  # a stable sort
        source = rows["_source"][0].as_py()
        name = f"{seed}|{level}|{rows['_shard'][0].as_py()}|{'null' if source is None else '=' + source}"
        fraction = round_shard(rows["size"].to_numpy().astype(np.float64), rows["_fraction"].to_numpy().copy(), name, last)
        # Only these two columns become numpy arrays, so carried ids stay exact next to nulls.
        return rows.set_column(rows.column_names.index("_fraction"), "_fraction", pa.array(fraction, pa.float64()))

    return run


def mix(
    docs: DataFrame, size: Column | None = None, source: Column | None = None, carry: tuple[str, ...] = ("doc_id",), seed: str = "mix",
    weights=WEIGHTS, share: float = SHARE, most: int = MOST,
) -> DataFrame:
    """One row per input row: the carried columns, size, source_size, target, taken (words, repeats counted).

    `size` defaults to the number of words of `text` (null: 0), `source` to the column source; a null
    source is a source of its own, an empty name too. A text is taken whole, 0 to `most` times. Rows
    are placed by a hash of the carried columns; rows that tie there are alike. A text without words
    takes 0 words. An empty table gives an empty result; further columns are not read.
    """
    spark = docs.sparkSession
    size = n_words(F.col("text")) if size is None else size
    source = (F.col("source") if source is None else source).cast("string")
    rows = docs.select(*carry, size.alias("size"), source.alias("_source")).select(
        *carry, "size", "_source", F.xxhash64(*carry, "size").alias("_place")
    )
    # One small row per source: the number of sources bounds what the driver sees.
    totals = {r["_source"]: (r["words"], r["n"]) for r in rows.groupBy("_source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()}
    targets = source_targets({k: v[0] for k, v in totals.items()}, weights, share, most)
    plan = spark.createDataFrame(
        [(k, v[0], targets[k], max(1, -(-v[1] // SHARD_ROWS))) for k, v in totals.items()],
        "_name string, source_size long, target double, _shards long",
    )
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    open_ = (
        rows.join(plan, F.col("_source").eqNullSafe(F.col("_name")))
        .withColumn("_wanted", F.least(wanted, F.lit(float(most))))
        .withColumn("_whole", F.floor("_wanted"))
        .withColumn("_fraction", F.col("_wanted") - F.col("_whole"))
        .withColumn("_shard", F.pmod(F.xxhash64("_place"), F.col("_shards")))
        .drop("_name", "_wanted", "_shards")
    )
    settled, level, shards = None, 0, max([1, *(-(-v[1] // SHARD_ROWS) for v in totals.values())])
    while True:
        last = shards == 1
        done = open_.groupBy("_source", "_shard").applyInArrow(_round_group(seed, level, last), open_.schema)
        if last:
            settled = done if settled is None else settled.unionByName(done)
            break
        done = cut(done)
        fractional = (F.col("_fraction") > 0) & (F.col("_fraction") < 1)
        ready = done.where(~fractional)
        settled = ready if settled is None else settled.unionByName(ready)
        level, shards = level + 1, -(-shards // FAN_IN)
        open_ = done.where(fractional).withColumn("_shard", F.floor(F.col("_shard") / FAN_IN))
    taken = ((F.col("_whole") + F.col("_fraction")) * F.col("size")).cast("long")
    return settled.select(*carry, "size", "source_size", "target", taken.alias("taken"))
