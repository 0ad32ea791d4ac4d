"""Toxicity by subword-bag embeddings.

A text is a sequence of segments of a few words. A segment's bag holds a vector for each word and
each character n-gram of its words, found by hash; the vectors are averaged and go into a linear
softmax. Vectors and softmax are trained jointly in numpy, so a misspelling that training never saw
shares most of its n-gram vectors with words it did see. A text scores as its worst segment: one
insult in a long text is as toxic as one in a short text.

Scale: training takes a bounded sample of labelled rows in one task and gives one number per hash
bucket (the vector's effect on the log odds), which is all that scoring needs; scoring is one pass
over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The first three bound what training sees.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_SEGMENTS = 3_000, 12_000, 32
BITS, DIM, SEGMENT_WORDS, GRAMS, PIECE = 18, 12, 8, (3, 4, 5), 500_000
RATE, ROUNDS = 10.0, 3
THRESHOLD = 0.7

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)
_LETTER = np.array([chr(c).isalnum() for c in range(0x2000)])


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 3, is 1; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _letters(codes: np.ndarray) -> np.ndarray:
    return _LETTER[np.minimum(codes, 0x1FFF)] | ((codes >= 0x2C00) & (codes < 0x3000)) | (codes > 0x3000)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _MIX
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all subwords, each one's segment, and each segment's text (ascending)."""
    joined = "\n" + "\n".join(t.lower().replace("\n", " ") for t in texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.cumsum(codes == 10) - 1
    letter = _letters(codes)
    codes = np.where(letter, codes, 32).astype(np.uint64)
    starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    ends = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    of_text = text[starts]
    first = np.searchsorted(of_text, of_text)  # index of the text's first word
    local = (np.arange(len(starts)) - first) // SEGMENT_WORDS
    change = np.ones(len(starts), bool)
    change[1:] = (of_text[1:] != of_text[:-1]) | (local[1:] != local[:-1])
    segment = np.cumsum(change) - 1
    # The blank before a word belongs to it, so that its first n-gram is marked.
    word_at = np.maximum(np.cumsum(np.bincount(starts - 1, minlength=len(codes))[: len(codes)]) - 1, 0)
    ids, of = [], []
    rolled = np.zeros(len(codes), np.uint64)
    inner = np.ones(len(codes), bool)
    for n in range(1, max(GRAMS) + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        rolled = rolled[:size] * np.uint64(1_000_003) + codes[n - 1 :]
        if n >= 3:
            inner = inner[:size] & letter[n - 2 : n - 2 + size]  # all but the first and last are letters
        if n in GRAMS:
            at = np.flatnonzero(inner[:size])
            ids.append(_bucket(rolled[at] + np.uint64(n)))
            # A gram that starts at a blank belongs to the word after it.
            of.append(segment[word_at[at]])
    # Whole words: a prefix hash in modular arithmetic, independent of position.
    powers = np.full(len(codes), 0x100000001B3, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inverse = np.full(len(codes), pow(0x100000001B3, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * powers, dtype=np.uint64)])
    ids.append(_bucket((sums[ends] - sums[starts]) * inverse[starts] + np.uint64(77)))
    of.append(segment)
    return np.concatenate(ids), np.concatenate(of), of_text[change]


def _pieces(text: str) -> Iterator[str]:
    """Cut a text too long for one pass, at a blank where there is one."""
    while len(text) > PIECE:
        at = text.rfind(" ", PIECE // 2, PIECE)
        at = PIECE if at < 0 else at
        yield text[:at]
        text = text[at:]
    yield text


def _chunks(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    owner, held, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in _pieces(text):
            if held and size + len(piece) > PIECE:
                yield owner, held
                owner, held, size = [], [], 0
            owner.append(i)
            held.append(piece)
            size += len(piece)
    if held:
        yield owner, held


def segment_logits(table: np.ndarray, bias: float, ids: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    sums = np.bincount(of, weights=table[ids], minlength=n)
    return sums / np.maximum(np.bincount(of, minlength=n), 1) + bias


def score_texts(table: np.ndarray, bias: float, texts: list[str]) -> np.ndarray:
    """Log odds of the worst segment; a text without a word gets -inf."""
    best = np.full(len(texts), -np.inf)
    for owner, held in _chunks(texts):
        ids, of, text = features(held)
        if len(text):
            np.maximum.at(best, np.asarray(owner)[text], segment_logits(table, bias, ids, of, len(text)))
    return best


def _spans(n: int, step: int) -> Iterator[tuple[int, int]]:
    return ((i, min(i + step, n)) for i in range(0, n, step))


def _joint(rng, ids, at, lengths, label, pool, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, softmax and bias by gradient descent over the segments in `pool`, both classes weighing the same.

    The pool is passed over until at least `steps` batches are done, however few segments it holds.
    """
    size = 1 << BITS
    vectors, out, bias = rng.normal(0, 0.05, (size, DIM)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    share = label[pool].mean() or 1.0
    weigh = np.where(label == 1, 0.5 / share, 0.5 / (1 - share) if share < 1 else 1.0)
    for _ in range(max(1, -(-steps * 256 // len(pool)))):
        order = rng.permutation(pool)
        for batch in (order[i:j] for i, j in _spans(len(order), 256)):
            n = lengths[batch]
            begin = np.concatenate([[0], np.cumsum(n)[:-1]])
            b = ids[np.repeat(at[batch] - begin, n) + np.arange(n.sum())]
            mean = np.add.reduceat(vectors[b], begin) / n[:, None]
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p[:, 1] - label[batch]) * weigh[batch]  # the other class has the opposite sign
            push = np.bincount(b, weights=np.repeat(g / n, n), minlength=size)
            hit = np.flatnonzero(push)
            vectors[hit] -= np.clip(RATE * push[hit], -0.5, 0.5)[:, None] * (out[:, 1] - out[:, 0])
            step = 0.2 * (mean.T @ g) / len(batch)
            out -= np.stack([-step, step], 1)
            bias -= 0.05 * np.array([-g.mean(), g.mean()])
    return vectors, out, bias


def train(texts: list[str], toxic: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Joint training of vectors and softmax; returns each bucket's effect on the log odds, and the bias.

    A label belongs to a text, not to its segments. A first epoch gives every segment its text's label,
    which is enough to tell words that many toxic texts share. Each later round starts anew and learns
    of a toxic text only the segment that the round before found worst, and of clean texts also those
    segments that it wrongly found bad.
    """
    rng = np.random.default_rng(seed)
    ids, lengths, doc = [], [], []
    for owner, held in _chunks(texts):
        b, of, text = features(held)
        order = np.argsort(of, kind="stable")
        ids.append(b[order])
        lengths.append(np.bincount(of, minlength=len(text)))
        doc.append(np.asarray(owner)[text] if len(text) else np.zeros(0, np.int64))
    ids, lengths, doc = np.concatenate(ids), np.concatenate(lengths), np.concatenate(doc)
    at = np.concatenate([[0], np.cumsum(lengths)])
    rank = rng.random(len(doc))
    by = np.lexsort((rank, doc))
    place = np.empty(len(doc), np.int64)
    place[by] = np.arange(len(doc)) - np.searchsorted(doc[by], doc[by])
    label = toxic[doc].astype(np.float64)
    drawn = place < SAMPLE_SEGMENTS
    vectors, out, bias = _joint(rng, ids, at, lengths, label, np.flatnonzero((label == 1) | drawn), 600)
    for _ in range(ROUNDS):
        effect = vectors @ (out[:, 1] - out[:, 0])
        logit = np.concatenate(
            [np.add.reduceat(effect[ids[at[i] : at[j]]], at[i:j] - at[i]) for i, j in _spans(len(doc), 50_000)]
        ) / lengths + bias[1] - bias[0]
        top = np.full(len(toxic), -np.inf)
        np.maximum.at(top, doc, logit)
        guilty = (label == 1) & (logit == top[doc])
        clean = (label == 0) & (drawn | (logit > -2))
        vectors, out, bias = _joint(rng, ids, at, lengths, label, np.flatnonzero(guilty | clean), 1500)
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """Train on a bounded sample of labelled rows outside the held-out fold.

    Per class, the SAMPLE_ROWS ids that come first by hash, of texts of 1 to SAMPLE_CHARS characters. Rows
    with a null id, label or text are passed over; of several labels of an id the highest counts.
    Without both classes every text gets the bias of what there is.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    order = F.xxhash64("doc_id")
    picked = [known.where(F.col("toxic") == y).orderBy(order).limit(SAMPLE_ROWS) for y in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * SAMPLE_ROWS small rows at most
    sample = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .where(F.length("text").between(1, SAMPLE_CHARS)).join(chosen, "doc_id")
        .groupBy("doc_id").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if not held:  # no labelled row
            return
        rows = pd.concat(held, ignore_index=True).sort_values("doc_id")
        if rows["toxic"].nunique() < 2:
            table, bias = np.zeros(1 << BITS), 5.0 if len(rows) and rows["toxic"].iloc[0] else -5.0
        else:
            table, bias = train(rows["text"].tolist(), rows["toxic"].to_numpy())
        yield pd.DataFrame({"effect": [table.astype(np.float32).tobytes()], "bias": [bias]})

    model = sample.coalesce(1).mapInPandas(run, "effect binary, bias double").collect()
    if not model:
        return np.zeros(1 << BITS, np.float32), -5.0
    return np.frombuffer(model[0]["effect"], np.float32), model[0]["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", name: str = "score") -> DataFrame:
    """The rows with a toxicity score from 0 to 1 in column `name`. A null, empty or wordless text scores 0."""
    table, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(table)  # one number per bucket, whatever the corpus

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        logit = score_texts(shared.value, bias, texts.fillna("").tolist())
        return pd.Series(1 / (1 + np.exp(-np.clip(logit, -700, 700))) * np.isfinite(logit))

    return docs.withColumn(name, scored(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Repeated rows are scored each; a row with a null id is scored and not held out; an empty table
    gives an empty result; columns other than doc_id and text are not read.
    """
    rows = docs.select("doc_id", "text")
    return score(rows, fit(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
