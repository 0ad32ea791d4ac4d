"""Words of whole batches of texts as numpy arrays: the common ground of the window and shingle operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE, _BASE_INVERSE = 0x100000001B3, pow(0x100000001B3, -1, 1 << 64)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text worked on at once; a single longer text is worked on alone.
BATCH_BYTES = 2_000_000


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all bits."""
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of several texts, in order: `text` is each word's text, `hash` a 64-bit hash of its bytes.

    `body` holds the words joined by one blank (a line feed between texts); word i is body[start[i]:end[i]].
    """

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        # Line feeds of the join end the texts; those inside texts are blanks like any other.
        ends_of_text = np.cumsum([len(t) + 1 for t in texts]) - 1
        before = np.concatenate([[True], blank[:-1]])
        starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
        self.n_texts = len(texts)
        self.text = np.searchsorted(ends_of_text, starts)
        self.count = np.bincount(self.text, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        keep = ~blank | ~before
        place = np.cumsum(keep) - 1
        self.start, self.end = place[starts], place[ends]
        body = np.where(blank, np.uint8(32), raw)[keep]
        self.body = body.tobytes()
        powers = _powers(_BASE, len(body))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((body.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)])
        inverse = _powers(_BASE_INVERSE, len(body))
        self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start] if len(starts) else np.zeros(0, np.uint64))

    def joined(self, first: int, last: int) -> bytes:
        """Words first..last of one text, joined by one blank."""
        return self.body[self.start[first] : self.end[last]]

    def whole(self, i: int) -> bytes:
        """All words of text i, joined by one blank."""
        return self.joined(self.first[i], self.first[i + 1] - 1) if self.count[i] else b""

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each place where n words of one text follow, and that place."""
        size = len(self.hash) - n + 1
        if size <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(size, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + self.hash[k : k + size]
        at = np.flatnonzero(self.text[:size] == self.text[n - 1 :])
        return mix(h[at]), at


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BATCH_BYTES."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > BATCH_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
