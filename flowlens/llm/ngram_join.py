"""N-gram Jaccard join as a blocked sparse matrix product.

Documents are the rows and n-grams the columns of an incidence matrix A; the entries of A A' are the
overlaps. Two documents qualify when 100 * overlap >= 85 * union, and their sizes alone say what
overlap that takes. The product is formed only where these bounds leave a chance:

1. Columns are ordered, those that are frequent last. Of a row of size s only the first
   s - ceil(0.85 s) + 1 columns can hold the first column that a qualifying pair shares (the smaller
   row of a pair: s - ceil(1.7 s / 1.85) + 1). Only these are shuffled, in blocks of columns.
2. A block's task multiplies its part of A with its transpose, sparsely: a column adds one to the
   overlap of each pair of its rows whose sizes, positions and parities in both rows leave a chance.
   Partial overlaps are added up by pair, and pairs below what their sizes ask for are discarded.
   (Parities: each n-gram flips one of 256 bits of its row. Bits in which two rows differ are at most
   the n-grams that one of them has alone, and sizes bound those of a pair that qualifies.
   Reach: of two rows one's columns end first, in the order of columns, and what no other row sent of
   those the other row does not have; the rest of that row bounds the overlap. In the product, rows
   with fewer columns left than a pair's sizes ask for form no pair.)
3. The overlap of each pair that is left is completed once, over its two whole rows.

Rows of one component need no more links, so this is done twice. At first each column pairs its rows
with one hub alone, which joins what is alike at a cost that is linear in the column; then only pairs
are formed whose rows are still apart. All pairs of hubs are settled by then, so the product leaves
hubs out, and columns of two rows. Columns are dealt to it by hub, as those that a group of versions
shares have few hubs; so most partial overlaps of a pair are added up where they arise. A column
with very many rows is cut into tiles. The texts that a step asks for are told by a Bloom filter of
their ids, compressed and sent once a pair, next to one for each hub.

Documents with the same n-grams are one row of the matrix (a class), so copies cost nothing. The
frequent columns are found from repeats inside each task's batches; they only steer the order, and
any order gives the same result. Hashes are 64 bits wide; a class is told by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import bloom
from flowlens.llm.components import components
from flowlens.llm.shared import width
from flowlens.llm.words import Words, chunks, mix
from flowlens.operators.lineage import cut, release

N, PART, WHOLE = 4, 85, 100
FREQUENT, COLUMN_ROWS, HUB_ROWS = 1 << 20, 4096, 256
#: A hub's columns of more rows than this are dealt to several tasks.
DEALT_ROWS = 64
NO_BOUND = (1 << 31) - 1
#: Entries of A that a block of columns holds, and pairs that it forms at a time.
BLOCK_ROWS, PAIRS = 1 << 18, 1 << 19
PARITIES = ["p0", "p1", "p2", "p3"]


def _ceil(a, b):
    return -(-a // b)


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-grams of each text, text after text, and the size of each set."""
    words = Words([t.lower() for t in texts])
    grams, at = words.grams(n)
    of = words.text[at]
    short = np.flatnonzero((words.count > 0) & (words.count < n))  # the whole sequence is the only n-gram
    if len(short):
        whole = [int.from_bytes(hashlib.blake2b(words.whole(i), digest_size=8, salt=b"short").digest(), "little") for i in short]
        grams, of = np.concatenate([grams, np.array(whole, np.uint64)]), np.concatenate([of, short])
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    return grams[new], np.bincount(of[new], minlength=len(texts))


def _bodies(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("body").to_pylist()]


def parities(grams: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """256 bits of each set, as four columns: bit h(g) tells whether an odd number of its n-grams has that h."""
    bit = mix(grams) >> np.uint64(56)
    some = sizes > 0
    first = (np.cumsum(sizes) - sizes)[some]
    out = []
    for k in range(len(PARITIES)):
        word = np.zeros(len(sizes), np.uint64)
        if len(first):
            word[some] = np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == k, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)), first)
        out.append(word.view(np.int64))
    return out


def _describe(n: int):
    """A row per text with its set's size, digest and parities, and a row per n-gram that repeats inside a batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bodies(batch)
            for i, j in chunks(texts):
                grams, sizes = shingle_sets(texts[i:j], n)
                at = np.concatenate([[0], np.cumsum(sizes)])
                digest = [hashlib.blake2b(grams[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(at, at[1:], strict=False)]
                value, count = np.unique(grams, return_counts=True)
                value, count = value[count > 1].view(np.int64), count[count > 1]
                k = len(value)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([batch.column("doc_id").slice(i, j - i), pa.nulls(k, pa.int64())]),
                        pa.concat_arrays([pa.array(sizes, pa.int64()), pa.array(count, pa.int64())]),
                        pa.concat_arrays([pa.array(digest, pa.binary()), pa.nulls(k, pa.binary())]),
                        pa.concat_arrays([pa.nulls(j - i, pa.int64()), pa.array(value, pa.int64())]),
                        *[pa.concat_arrays([pa.array(p), pa.nulls(k, pa.int64())]) for p in parities(grams, sizes)],
                    ],
                    names=["doc_id", "n", "digest", "gram", *PARITIES],
                )

    return run


def _columns(n: int, part: int, whole: int, frequent):
    """The columns of each row that can hold the first one a qualifying pair shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = frequent.value
        for batch in batches:
            texts, docs = _bodies(batch), batch.column("doc_id").to_numpy()
            for i, j in chunks(texts):
                grams, sizes = shingle_sets(texts[i:j], n)
                of = np.repeat(np.arange(j - i), sizes)
                starts = np.cumsum(sizes) - sizes
                same = np.array([int.from_bytes(hashlib.blake2b(grams[a : a + k].tobytes(), digest_size=8).digest(), "little", signed=True) for a, k in zip(starts, sizes, strict=True)], np.int64)
                count = np.zeros(len(grams), np.int64)
                if len(known):
                    place = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                    count = np.where(known[place] == grams, weight[place], 0)
                order = np.lexsort((mix(grams), count, of))
                grams, of = grams[order], of[order]
                at = np.arange(len(grams)) - (np.cumsum(sizes) - sizes)[of]
                keep = at < (sizes - _ceil(part * sizes, whole) + 1)[of]
                grams, of, at = grams[keep], of[keep], at[keep]
                yield pa.RecordBatch.from_pydict(
                    {"gram": grams.view(np.int64), "same": same[of], "doc": docs[i:j][of], "size": sizes[of].astype(np.int32), "at": at.astype(np.int32)}
                )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of columns that two classes have, one row a class, each with the column's size and hub.

    Rows come sorted by (gram, same, doc). The hub is the row in which the column stands first: what a
    text has to itself is rare and stands before, so of many versions of a text the plainest one is it.
    """
    names = ["gram", "same", "doc", "size", "at"]

    def whole(rows: np.ndarray) -> pa.RecordBatch:
        keep = np.append(True, np.any(rows[:2, 1:] != rows[:2, :-1], 0)) & np.ones(rows.shape[1], bool)
        rows = rows[:, keep]  # copies stand behind their class's least id
        new = np.append(True, rows[0, 1:] != rows[0, :-1])
        of = np.cumsum(new) - 1
        count = np.bincount(of)
        rows, of = rows[:, count[of] > 1], of[count[of] > 1]
        order = np.lexsort((rows[2], rows[4], of))
        rows, of = rows[:, order], of[order]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
        hub = np.repeat(first, np.diff(np.append(first, len(of))))
        gram, _, doc, size, at = rows
        return pa.RecordBatch.from_pydict(
            {"gram": gram, "doc": doc, "size": size.astype(np.int32), "at": at.astype(np.int32), "n": count[of], "hub": doc[hub], "hub_size": size[hub].astype(np.int32), "hub_at": at[hub].astype(np.int32)}
        )

    held, size = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names]))
        size += batch.num_rows
        if size >= BLOCK_ROWS:
            rows = np.concatenate(held, 1)
            to = int(np.searchsorted(rows[0], rows[0, -1]))  # the last column may go on
            if to:
                yield whole(rows[:, :to])
            held, size = [rows[:, to:]], rows.shape[1] - to
    if size:
        yield whole(np.concatenate(held, 1))


def needs(small: np.ndarray, large: np.ndarray, part: int, whole: int) -> np.ndarray:
    """The overlap that two sets of these sizes must have to qualify."""
    return _ceil(part * (small + large), part + whole)


def column_pairs(rows: dict[str, np.ndarray], part: int, whole: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of rows of whole columns that the bounds leave a chance: a, b, and what their prefixes must share.

    `rows` is sorted by column (gram, i, j), in it by doc. `at` is the column's position in a row, `lead`
    the row's first position that any other row shares. About PAIRS pairs are formed at a time. Rows
    with the same label are joined already. Parities are optional, and bound nothing for rows that are `open`;
    so is `held`, the number of columns here that the row has.
    """
    n = len(rows["doc"])
    new = np.ones(n, bool)
    new[1:] = np.any([rows[c][1:] != rows[c][:-1] for c in ("gram", "i", "j")], 0)
    last = np.append(np.flatnonzero(new)[1:], n)
    after = last[np.cumsum(new) - 1] - np.arange(n) - 1
    total = np.cumsum(after)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + PAIRS, "right")))
        x = np.repeat(np.arange(low, high), after[low:high])
        begin = np.cumsum(after[low:high]) - after[low:high]
        y = x + 1 + np.arange(len(x)) - np.repeat(begin, after[low:high])
        low = high
        # In a tile between two chunks only rows of different chunks meet.
        keep = (rows["label"][x] != rows["label"][y]) & ((rows["i"][x] == rows["j"][x]) | (rows["side"][x] != rows["side"][y]))
        x, y = x[keep], y[keep]
        swap = rows["size"][x] > rows["size"][y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        sx, sy, ax, ay = rows["size"][x], rows["size"][y], rows["at"][x], rows["at"][y]
        need = needs(sx, sy, part, whole)
        can = sy <= sx * whole // part
        can &= np.minimum(sx - rows["lead"][x], sy - rows["lead"][y]) >= need
        can &= np.minimum(ax, ay) + np.minimum(sx - ax, sy - ay) >= need
        x, y, sx, sy, need = x[can], y[can], sx[can], sy[can], need[can]
        if "open" in rows:
            differ = sum(np.bitwise_count(rows[p][x].view(np.uint64) ^ rows[p][y].view(np.uint64)).astype(np.int64) for p in PARITIES)
            can = (differ <= sx + sy - 2 * need) | (rows["open"][x] + rows["open"][y] > 0)
            x, y, sx, sy, need = x[can], y[can], sx[can], sy[can], need[can]
        # Behind the prefix that ends first (in the order of columns) only that row's rest adds to the overlap.
        least = need - (np.maximum(_ceil(part * sx, whole), _ceil(part * sy, whole)) - 1)
        if "held" in rows:
            can = np.minimum(rows["held"][x], rows["held"][y]) >= least
            x, y, least = x[can], y[can], least[can]
        a, b = rows["doc"][x], rows["doc"][y]
        yield np.minimum(a, b), np.maximum(a, b), least


def _multiply(part: int, whole: int):
    """Partial overlaps of the pairs of a block of columns: a, b, n, least (what the sum of n must reach)."""
    names = ["gram", "i", "j", "side", "doc", "size", "at", "lead", "label", "open", "held", *PARITIES]

    def summed(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = dict(zip(names, rows, strict=True))
        for a, b, least in column_pairs(columns, part, whole):
            order = np.lexsort((b, a))
            a, b, least = a[order], b[order], least[order]
            new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
            count = np.diff(np.append(new, len(a)))
            lowest = np.minimum.reduceat(least, new) if len(new) else least
            yield pa.RecordBatch.from_pydict({"a": a[new], "b": b[new], "n": count.astype(np.int64), "least": lowest.astype(np.int64)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names]))
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                rows = np.concatenate(held, 1)
                same = (rows[:3] == rows[:3, -1:]).all(0)  # the last column may go on
                whole_to = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
                if whole_to:
                    yield from summed(rows[:, :whole_to])
                held, size = [rows[:, whole_to:]], rows.shape[1] - whole_to
        if size:
            yield from summed(np.concatenate(held, 1))

    return run


def _complete(n: int, part: int, whole: int):
    """Links (a, b) among a hub and the partners it is paired with; a hub's rows come before its partners'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, sets = None, []
        for batch in batches:
            hubs, parts, docs = (batch.column(c).to_numpy() for c in ("a", "part", "doc"))
            bodies = [pa.decompress(z, size, "zstd", asbytes=True) for z, size in zip(batch.column("packed").to_pylist(), batch.column("bytes").to_pylist(), strict=True)]
            found = []
            for i, j in chunks(bodies):
                grams, sizes = shingle_sets(bodies[i:j], n)
                at = np.concatenate([[0], np.cumsum(sizes)])
                for k in range(i, j):
                    own = grams[at[k - i] : at[k - i + 1]]
                    if (hubs[k], parts[k]) != hub:
                        hub, sets = (hubs[k], parts[k]), []
                    if docs[k] == hubs[k]:
                        sets.append(own)
                    elif any(both and whole * both >= part * (len(own) + len(other) - both) for other in sets for both in [_overlap(own, other)]):
                        found.append((int(hubs[k]), int(docs[k])))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _overlap(own: np.ndarray, other: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if not len(own) or not len(other):
        return 0
    at = np.minimum(np.searchsorted(other, own), len(other) - 1)
    return int((other[at] == own).sum())


def _ids(column: str):
    """Keys of a batch's ids for a Bloom filter; none of them is null."""
    return lambda batch: mix(batch.column(column).to_numpy().view(np.uint64))


def _pack(wanted):
    """Compressed texts of the rows whose id the filter may hold."""
    keys = _ids("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bloom.contains(wanted.value, keys(batch))))
            bodies = _bodies(batch)
            packed = [pa.compress(b, "zstd", asbytes=True) for b in bodies]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary()), pa.array([len(b) for b in bodies], pa.int64())], names=["doc", "packed", "bytes"])

    return run


def _completed(rows: DataFrame, pairs: DataFrame, n: int, part: int, whole: int, hub_rows: int) -> DataFrame:
    """The pairs that qualify. The hub of a pair is its first row; one with many partners is cut into parts."""
    spark = rows.sparkSession
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / hub_rows).cast("int").alias("parts"))
    dealt = cut(pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")))
    sides = dealt.select("a", "part", F.col("b").alias("doc"), F.lit(1).alias("place")).unionByName(
        dealt.select("a", "part").distinct().select("a", "part", F.col("a").alias("doc"), F.lit(0).alias("place"))
    )
    # The join asks for each id exactly; the filter only keeps texts of other ids from being sent.
    wanted = spark.sparkContext.broadcast(bloom.build(sides.select("doc"), _ids("doc")))
    texts = rows.where("doc_id is not null").mapInArrow(_pack(wanted), "doc long, packed binary, bytes long")
    met = (
        sides.join(texts, "doc").select("a", "part", "place", "doc", "packed", "bytes")
        .repartition(width(spark), "a", "part").sortWithinPartitions("a", "part", "place")
    )
    links = cut(met.mapInArrow(_complete(n, part, whole), "a long, b long"))
    release(dealt)
    return links


def _first_pairs(members: DataFrame, facts: DataFrame, part: int, whole: int) -> DataFrame:
    """(a, b): each column's hub with every other of its rows that the bounds leave a chance; a is the hub.

    The pairs are made distinct first, without what is known of their rows, and then meet it in `facts`
    (`reach` is optional). A pair that is not returned and has a hub in one of its columns cannot qualify.
    """
    sides = {
        "sx": F.least("size", "hub_size"), "sy": F.greatest("size", "hub_size"),
        "need": F.expr(f"({part} * (cast(size as long) + hub_size) + {part + whole - 1}) div {part + whole}"),
    }
    near = members.where("hub <> doc").withColumns(sides).where(
        f"sy <= cast(sx as long) * {whole} div {part}"
        " and least(at, hub_at) + least(size - at, hub_size - hub_at) >= need"
    )
    once = near.select(F.col("hub").alias("a"), F.col("doc").alias("b"), "size", "hub_size", "need").distinct()
    if "reach" not in facts.columns:
        facts = facts.withColumn("reach", F.lit(NO_BOUND))
    of = {side: facts.select(F.col("doc").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("lead", "open", "reach", *PARITIES)]) for side in ("a", "b")}
    met = once.join(of["b"], "b").where("size - b_lead >= need").join(of["a"], "a").where("hub_size - a_lead >= need and greatest(a_reach, b_reach) >= need")
    differ = sum((F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in PARITIES), F.lit(0))
    slack = F.col("size").cast("long") + F.col("hub_size") - 2 * F.col("need")
    near = met.where((differ <= slack) | (F.col("a_open") + F.col("b_open") > 0))
    # Two rows may be each other's hub; one of them is enough.
    return near.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.min("a").alias("a")).select("a", F.expr("low + high - a").alias("b"))


def _multiplied(members: DataFrame, part: int, whole: int, column_rows: int) -> DataFrame:
    """(a, b, n, least) of every block of columns; a column of more than `column_rows` rows is cut into tiles."""
    tiled = (
        members.withColumn("k", F.ceil(F.col("n") / column_rows).cast("int")).withColumn("side", F.pmod(F.xxhash64("doc"), F.col("k")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .withColumn("salt", F.pmod(F.xxhash64("gram"), F.ceil(F.col("n") / DEALT_ROWS)))
        .select("hub", "salt", "gram", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "doc", "size", "at", "lead", "label", "open", "held", *PARITIES)
    )
    dealt = tiled.repartition(width(members.sparkSession), "hub", "salt", "i", "j").sortWithinPartitions("hub", "gram", "i", "j", "doc").drop("hub", "salt")
    return dealt.mapInArrow(_multiply(part, whole), "a long, b long, n long, least long")


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, part: int = PART, whole: int = WHOLE,
    column_rows: int = COLUMN_ROWS, hub_rows: int = HUB_ROWS,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z lower-cased; a text with fewer than `n` words has
    its whole sequence as one n-gram; a null or empty text has none and links with nothing. Two texts
    link when whole * overlap >= part * union of their sets; component_id is the smallest id reachable
    over links. Rows that share an id are one node: it links through any of its texts. A row with a
    null id links with nothing and gets a null component. An empty table gives an empty result;
    other columns are not read.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body"))
    seen = cut(rows.mapInArrow(_describe(n), "doc_id long, n long, digest binary, gram long, p0 long, p1 long, p2 long, p3 long"))
    texts = seen.where("gram is null")
    # At most FREQUENT pairs of numbers, whatever the corpus.
    top = (
        seen.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(FREQUENT).toArrow()
    )
    known = top.column("gram").to_numpy().view(np.uint64)
    by = np.argsort(known)
    frequent = spark.sparkContext.broadcast((known[by], top.column("n").to_numpy()[by]))
    classes = cut(
        texts.where("digest is not null and doc_id is not null").groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_rows"))
    )
    postings = rows.where("doc_id is not null").mapInArrow(_columns(n, part, whole, frequent), "gram long, same long, doc long, size int, at int")
    # One shuffle of the columns; those of one class go where they arrive.
    members = cut(
        postings.repartition(width(spark), "gram").sortWithinPartitions("gram", "same", "doc")
        .mapInArrow(_shared, "gram long, doc long, size int, at int, n long, hub long, hub_size int, hub_at int")
    )
    # An id with several texts has several sets, so neither parities nor reach bound its pairs.
    own = texts.where("digest is not null and doc_id is not null").select(F.col("doc_id").alias("doc"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("reach"), F.lit(1).alias("sets"), *PARITIES)
    reach = F.ceil(part * F.max("size") / whole) - 1 + F.count(F.lit(1))
    shared = members.groupBy("doc").agg(F.min("at").alias("at"), reach.cast("int").alias("reach")).withColumns({"sets": F.lit(0), **{p: F.lit(None).cast("long") for p in PARITIES}})
    about = own.unionByName(shared).groupBy("doc").agg(
        F.min("at").alias("lead"), (F.sum("sets") > 1).cast("int").alias("open"),
        F.when(F.sum("sets") > 1, F.lit(NO_BOUND)).otherwise(F.max("reach")).alias("reach"), *[F.max(p).alias(p) for p in PARITIES]
    )
    facts = cut(about.where("lead is not null"))
    tried = cut(_first_pairs(members, facts, part, whole))
    alike = _completed(rows, tried, n, part, whole, hub_rows)
    joined = components(alike)
    # Pairs of hubs are settled: a pair that is not has both its rows in all columns it shares without them.
    left = members.where("n > 2 and not (doc = hub and size = hub_size and at = hub_at)")
    held = left.groupBy("doc").agg(F.count(F.lit(1)).cast("int").alias("held"))
    # What is known of a row meets its members once, when its label is known too.
    nodes = facts.drop("reach").join(held, "doc").withColumn("held", F.when(F.col("open") > 0, F.lit(NO_BOUND)).otherwise(F.col("held")))
    nodes = nodes.join(joined.select(F.col("node").alias("doc"), F.col("component").alias("label")), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    summed = _multiplied(left.join(nodes, "doc"), part, whole, column_rows).groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    open_ = cut(summed.where("n >= least").select("a", "b").join(known, ["a", "b"], "left_anti"))
    rest = _completed(rows, open_, n, part, whole, hub_rows)
    copies = (
        texts.join(classes.where("n_rows > 1").select("digest", "rep"), "digest").where("doc_id <> rep")
        .select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    )
    found = components(alike.unionByName(rest).unionByName(copies))
    release(members, facts, tried, open_, alike, joined, rest, classes)
    return texts.join(found, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )
