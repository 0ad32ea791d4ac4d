"""Substring dedup by super-k-mer partitioning.

Every window of 50 words has a minimiser, the least hash among its runs of 5 words. Windows that are
equal have the same minimiser, and neighbouring windows mostly share theirs: such a stretch is one
super-k-mer. It travels once, as one packed string, to the bucket of its minimiser, where its windows
are sorted against the others and each run of equal windows shows the least document it starts in.

Scale: 1. only minimisers and ids are counted over all texts; a stretch whose minimiser no other
stretch has cannot repeat and stays home. 2. Texts with shared minimisers send their packed stretches.
3. A bucket of more than BUCKET_ROWS stretches (a passage that many documents hold) is not
gathered: its stretches are made distinct map-side under a 128-bit digest, the windows of the distinct
ones are counted under theirs, and the verdict goes back by joins that split hot keys. 4. What comes
back is spans of words, merged per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.shared import width
from flowlens.llm.words import Words, chunks
from flowlens.operators.lineage import cut, release

WINDOW, GRAM = 50, 5
BUCKET_ROWS = 32  # a task gathers no more stretches than this of one minimiser
NO_ID = (1 << 63) - 1  # a null id counts as the largest


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n neighbours, by doubling."""
    span, out = 1, h
    while span * 2 <= n:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return out if span == n else np.minimum(out[: len(h) - n + 1], out[n - span : n - span + len(h) - n + 1])


def stretches(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers: text, first window, last window (word index of the start), minimiser as a signed value."""
    grams, at = words.grams(GRAM)
    whole = np.zeros(len(words.hash), np.uint64)
    whole[at] = grams
    n = window - GRAM + 1
    if len(whole) < window:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    least = _least(whole[: len(whole) - GRAM + 1], n)
    starts = np.flatnonzero(words.text[: len(least)] == words.text[window - 1 : window - 1 + len(least)])
    if not len(starts):
        return starts, starts, starts, starts
    value = least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (value[1:] != value[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    return words.text[starts[first]], starts[first], starts[last], value[first].view(np.int64)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("body").to_pylist()]


def _minimisers(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, docs, tags = _texts(batch), batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            for i, j in chunks(texts):
                text, _, _, value = stretches(Words(texts[i:j]), window)
                yield pa.RecordBatch.from_pydict({"mini": value, "doc": docs[i:j][text], "tag": tags[i:j][text]})

    return run


def _packed(window: int):
    """Packed stretches of the wanted minimisers; those of hot ones carry a digest of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, docs, tags = _texts(batch), batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            wanted, hot = batch.column("wanted").to_pylist(), batch.column("hot").to_pylist()
            for i, j in chunks(texts):
                words = Words(texts[i:j])
                text, first, last, value = stretches(words, window)
                out = {k: [] for k in ("mini", "packed", "digest", "doc", "tag", "at")}
                split, here = np.searchsorted(text, np.arange(j - i + 1)), first - words.first[text]
                for d in range(j - i):
                    own = value[split[d] : split[d + 1]]
                    is_hot = np.isin(own, np.array(hot[i + d] or [], np.int64))
                    for k in np.flatnonzero(is_hot | np.isin(own, np.array(wanted[i + d] or [], np.int64))):
                        at = k + split[d]
                        packed = words.joined(first[at], last[at] + window - 1)
                        digest = hashlib.blake2b(packed, digest_size=16).digest() if is_hot[k] else None
                        _add(out, value[at], packed, digest, docs[i + d], tags[i + d], here[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=list(out),
                )

    return run


def _hot_windows(window: int):
    """Digests of the windows of distinct stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("digest", "offset", "win", "low", "high")}
            for digest, packed, low, high in zip(*(batch.column(c).to_pylist() for c in ("digest", "packed", "low", "high")), strict=True):
                for k, w in enumerate(_windows(packed, window)):
                    _add(out, digest, k, hashlib.blake2b(w, digest_size=16).digest(), low, high)
            types = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return run


def _add(out: dict[str, list], *values) -> None:
    for column, v in zip(out.values(), values, strict=True):
        column.append(v)


def _windows(packed: bytes, window: int) -> Iterator[bytes]:
    """The windows of a packed stretch, in order."""
    starts = [0, *(np.flatnonzero(np.frombuffer(packed, np.uint8) == 32) + 1).tolist()]
    ends = [s - 1 for s in starts[1:]] + [len(packed)]
    return (packed[s:e] for s, e in zip(starts, ends[window - 1 :], strict=False))


def _runs(flags: Iterator[bool]) -> Iterator[tuple[int, int]]:
    start = None
    i = -1
    for i, flag in enumerate(flags):
        if flag and start is None:
            start = i
        elif not flag and start is not None:
            yield start, i - 1
            start = None
    if start is not None:
        yield start, i


def bucket_spans(rows: list[tuple[bytes, int, int, int]], window: int) -> Iterator[tuple[int, int, int, int]]:
    """Spans of words to remove in the stretches (packed, doc, tag, at) of one minimiser: doc, tag, from, to."""
    if len({doc for _, doc, _, _ in rows}) < 2:
        return
    least: dict[bytes, int] = {}
    for packed, doc, _, _ in rows:  # copies of a stretch are sorted once
        least[packed] = min(doc, least.get(packed, doc))
    ordered = sorted({(w, doc) for packed, doc in least.items() for w in _windows(packed, window)})
    first: dict[bytes, int] = {}
    for w, doc in ordered:  # the first of a run of equal windows has the least document
        first.setdefault(w, doc)
    for packed, doc, tag, at in rows:
        for a, b in _runs(first[w] < doc for w in _windows(packed, window)):
            yield doc, tag, at + a, at + b + window - 1


def _buckets(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            out = []
            for mini, *row in zip(*(batch.column(c).to_pylist() for c in ("mini", "packed", "doc", "tag", "at")), strict=True):
                if mini != current:
                    out += bucket_spans(held, window)
                    current, held = mini, []
                held.append(tuple(row))
            yield _span_batch(out)
        yield _span_batch(list(bucket_spans(held, window)))

    return run


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "tag", "from", "to"])


def _result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = _texts(batch), batch.column("spans").to_pylist()
        for i, j in chunks(texts):
            words = Words(texts[i:j])
            removed, kept = [], []
            for d in range(j - i):
                n = int(words.count[d])
                if not spans[i + d]:
                    removed.append(0)
                    kept.append(words.whole(d))
                    continue
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, [s["from"] for s in spans[i + d]], 1)
                np.add.at(edge, [s["to"] + 1 for s in spans[i + d]], -1)
                gone = np.cumsum(edge[:n]) > 0
                removed.append(int(gone.sum()))
                runs = _runs(~gone)
                kept.append(b" ".join(words.joined(words.first[d] + a, words.first[d] + b) for a, b in runs))
            yield pa.RecordBatch.from_pydict(
                {"doc": batch.column("doc_id").slice(i, j - i), "n_words": pa.array(words.count, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary())}
            ).rename_columns(["doc_id", "n_words", "n_removed", "kept_text"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (binary UTF-8, kept words joined by one blank).

    A word goes when a window over it also starts in a document with a smaller id. Null and empty
    texts have no words; texts under `window` words have no window and stay whole. A null id counts
    as the largest id; rows that share an id are one document as far as order goes, so a repeated
    row removes nothing from its twin and both get the same result. An empty table gives an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(body).alias("tag"), body.alias("body"),
    )
    found = cut(rows.select("doc", "tag", "body").mapInArrow(_minimisers(window), "mini long, doc long, tag long"))
    shared = cut(
        found.groupBy("mini").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("a"), F.max("doc").alias("z")).where("a < z").select("mini", "n")
    )
    mini, is_hot = F.col("mini"), F.col("n") > bucket_rows
    need = found.join(shared, "mini").groupBy("doc", "tag").agg(
        F.collect_set(F.when(~is_hot, mini)).alias("wanted"), F.collect_set(F.when(is_hot, mini)).alias("hot")
    )
    sent = cut(
        rows.select("doc", "tag", "body").join(need, ["doc", "tag"]).mapInArrow(
            _packed(window), "mini long, packed binary, digest binary, doc long, tag long, at long"
        )
    )
    spans = (
        sent.where("digest is null").drop("digest").repartition(width(spark), "mini").sortWithinPartitions("mini")
        .mapInArrow(_buckets(window), "doc long, tag long, from long, to long")
        .select("doc", "tag", F.array(F.struct("from", "to")).alias("spans"))
    )
    hot = sent.where("digest is not null")
    distinct = hot.groupBy("digest").agg(F.first("packed").alias("packed"), F.min("doc").alias("low"), F.max("doc").alias("high"))
    windows = cut(distinct.mapInArrow(_hot_windows(window), "digest binary, offset long, win binary, low long, high long"))
    first = cut(windows.groupBy("win").agg(F.min("low").alias("first"), F.max("high").alias("last")).where("first < last").select("win", "first"))
    verdict = cut(windows.join(first, "win").groupBy("digest").agg(F.collect_list(F.struct("offset", "first")).alias("repeats")))
    own = F.filter("repeats", lambda r: r["first"] < F.col("doc"))
    hot_spans = hot.join(verdict, "digest").select(
        "doc", "tag",
        F.transform(own, lambda r: F.struct((F.col("at") + r["offset"]).alias("from"), (F.col("at") + r["offset"] + window - 1).alias("to"))).alias("spans"),
    )
    gathered = cut(spans.unionByName(hot_spans).groupBy("doc", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    release(found, shared, sent, windows, first, verdict)
    return rows.join(gathered, ["doc", "tag"], "left").select("doc_id", "body", "spans").mapInArrow(
        _result, "doc_id long, n_words long, n_removed long, kept_text binary"
    )
