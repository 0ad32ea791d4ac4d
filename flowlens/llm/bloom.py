"""Blocked Bloom filters over 64-bit keys, built by Spark and probed with numpy, and the hashes of byte strings they take.

A key picks one block of 512 bits and sets BITS bits in it, so a look-up reads one cache line. The
words of a filter are ORed together in a distributed aggregate, and there are never more than
MAX_WORDS of them, whatever the number of keys: a fuller filter lets more keys pass that are not in
it, so whoever asks it must not rely on a hit, only on a miss.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.words import mix

BLOCK_WORDS, BITS, BITS_PER_KEY = 8, 6, 16
#: Words of a filter: 32 MiB at most.
MAX_WORDS = 1 << 22
_BASE, _SPREAD = 0x100000001B3, np.uint64(0x9E3779B97F4A7C15)


def laid(column: pa.BinaryArray) -> memoryview:
    """The bytes of a column's strings, end to end, in place; there is no null among them."""
    _, offsets, body = column.buffers()
    if not len(column) or body is None:
        return memoryview(b"")
    low, high = np.frombuffer(offsets, np.int32)[[column.offset, column.offset + len(column)]]
    return memoryview(body)[low:high]


class Stretches:
    """Hashes of any stretch of byte strings that are laid end to end."""

    def __init__(self, values: list[bytes] | pa.BinaryArray):
        if isinstance(values, pa.BinaryArray):
            self.raw, self.size = np.frombuffer(laid(values), np.uint8), pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            self.raw = np.frombuffer(b"".join(values), np.uint8)
            self.size = np.array([len(v) for v in values], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        powers, back = np.full(len(self.raw), _BASE, np.uint64), np.full(len(self.raw) + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        powers[:1] = back[:1] = 1
        powers, self.back = np.multiply.accumulate(powers), np.multiply.accumulate(back)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)])

    def hash(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix((self.sums[high] - self.sums[low]) * self.back[low] + (high - low).astype(np.uint64))

    def whole(self) -> np.ndarray:
        """Hash of each string."""
        return self.hash(self.start[:-1], self.start[1:])


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of all but its last element and that of the last."""
    return mix(left * _SPREAD + right)


def encoded(column: pa.Array) -> list[bytes]:
    """A column of strings as bytes; null is empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def places(key: np.ndarray, n_words: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of each key the first word of its block, and BITS times a word of the block and a bit in it."""
    block = (key >> np.uint64(32)) % np.uint64(n_words // BLOCK_WORDS) * np.uint64(BLOCK_WORDS)
    seed = mix(key + _SPREAD)
    nine = [seed >> np.uint64(9 * k) & np.uint64(511) for k in range(BITS)]  # BITS times nine bits fit into 64
    return block.astype(np.int64), [(x >> np.uint64(6)).astype(np.int64) for x in nine], [np.uint64(1) << (x & np.uint64(63)) for x in nine]


def contains(words: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys the filter may hold: a miss is sure."""
    out = np.zeros(len(key), bool)
    for a in range(0, len(key), 1 << 18):  # short arrays stay in the cache
        block, word, bit = places(key[a : a + (1 << 18)], len(words))
        hit = np.ones(len(block), bool)
        for w, b in zip(word, bit, strict=True):
            hit &= (words[block + w] & b) != 0
        out[a : a + (1 << 18)] = hit
    return out


def build(rows: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], max_words: int = MAX_WORDS) -> np.ndarray:
    """The filter of all rows; `keys` gives the 64-bit key of each row of a batch."""
    n_words = BLOCK_WORDS * max(1, min(max_words, -(-rows.count() * BITS_PER_KEY // 64)) // BLOCK_WORDS)

    def bits(batches):
        for batch in batches:
            block, word, bit = places(keys(batch), n_words)
            at = np.concatenate([block + w for w in word])
            yield pa.RecordBatch.from_pydict({"word": pa.array(at, pa.int64()), "bit": pa.array(np.concatenate(bit).view(np.int64), pa.int64())})

    found = rows.mapInArrow(bits, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    words = np.zeros(n_words, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return words
