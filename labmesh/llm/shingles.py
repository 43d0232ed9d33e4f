"""Word shingles of whole texts as sorted 64-bit numbers, a batch of texts at a time.

The hash of a word is a polynomial over its bytes modulo 2**64, read off prefix
sums, so that numpy handles all words of a batch at once; the words of a shingle
are mixed and combined with one odd factor per place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np

BATCH_BYTES = 1 << 20

_random = np.random.default_rng(20_011)
_BYTE = _random.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _random.integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15 & ~7 | 3)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones((2, 1), np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of the numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _steps(n: int) -> np.ndarray:
    """Powers of the step and of its inverse, as far as any batch has needed them."""
    global _powers
    if _powers.shape[1] < n:
        size = max(n, BATCH_BYTES + 4096)
        table = np.empty((2, size), np.uint64)
        table[:, 0] = 1
        table[0, 1:], table[1, 1:] = _STEP, _BACK
        _powers = np.multiply.accumulate(table, axis=1)
    return _powers


def batches(texts: Sequence[bytes], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes; a longer text is a range of its own."""
    start = size = 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > limit:
            yield start, k
            start, size = k, 0
        size += len(text) + 1
    if len(texts) > start:
        yield start, len(texts)


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where the words of each text begin (one more entry)."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    ends_of = np.cumsum([0, *(len(t) + 1 for t in texts)])
    blank = _BLANK[data]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    forth, back = _steps(len(data) + 1)[:, : len(data) + 1]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * forth[:-1], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * back[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(starts, ends_of + 1)


def shingle_sets(texts: Sequence[bytes], words: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct shingles of `words` words.

    With fewer words the whole sequence is one shingle; without words there is none.
    Texts are UTF-8 in which A-Z is in lower case already.
    """
    for start, end in batches(texts):
        hashes, first = word_hashes(texts[start:end])
        combined = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
        for k in range(words):
            combined += hashes[k : k + len(combined)] * _PLACE[k]
        combined = mixed(combined)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            n = b - a
            if n >= words:
                yield np.unique(combined[a : b - words + 1])
            elif n:
                short = (hashes[a:b] * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)
                yield mixed(np.array([short]))
            else:
                yield np.zeros(0, np.uint64)


def set_key(shingles: np.ndarray) -> bytes:
    """16 bytes that equal sets share and different sets do not."""
    return blake2b(shingles.tobytes(), digest_size=16).digest()
