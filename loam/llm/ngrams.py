"""Words and word n-grams of whole Arrow batches as 64-bit hashes, in numpy.

A word is [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased. Its hash is a polynomial in random 64-bit numbers for
its bytes, modulo 2^64, from prefix sums over the batch; an n-gram's hash is a polynomial in its words' mixed hashes. Two
different words or n-grams of a corpus share a hash with a chance of about its distinct number over 2^64 each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once (or one text): bounds the temporary arrays.
TOGETHER = 500_000
_random = np.random.Generator(np.random.PCG64(20240229))
_letters = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_letters[65:91] = _letters[97:123]
_space = np.zeros(256, dtype=bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_base, _step = (int(x) | 1 for x in _random.integers(1 << 62, 1 << 63, 2, dtype=np.uint64))
_inverse = pow(_base, -1, 1 << 64)
_powers = np.zeros(0, dtype=np.uint64)
_inverses = np.zeros(0, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        m = 1 << max(19, (n - 1).bit_length())
        powers, inverses = np.empty(m, dtype=np.uint64), np.empty(m, dtype=np.uint64)
        powers[0] = inverses[0] = 1
        k = 1
        while k < m:  # doubling
            powers[k : 2 * k] = powers[:k] * np.uint64(pow(_base, k, 1 << 64))
            inverses[k : 2 * k] = inverses[:k] * np.uint64(pow(_inverse, k, 1 << 64))
            k *= 2
        _powers, _inverses = powers, inverses
    return _powers, _inverses


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and each row's end (one more entry than rows); null rows are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and each row's end among them (one more entry than rows)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    word = ~_space[raw]
    start = word.copy()
    start[1:] &= ~word[:-1]
    edges = ends[:-1][ends[:-1] < n]
    start[edges] = word[edges]  # a word ends with its row
    first = np.flatnonzero(start)
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    last = ends[1:][ends[1:] > 0] - 1
    stop[last] = word[last]
    end = np.flatnonzero(stop) + 1
    powers, inverses = _tables(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_letters[raw] * powers[:n], out=sums[1:])
    h = mix((sums[end] - sums[first]) * inverses[first] + (end - first).astype(np.uint64))
    return h, np.searchsorted(first, ends)


def gram_hashes(words: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all n-grams of consecutive words inside rows, and each row's end among them."""
    counts = np.maximum(np.diff(ends) - n + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(bounds[-1]) + np.repeat(ends[:-1] - bounds[:-1], counts)
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        h = h * np.uint64(_step) + words[at + k]
    return mix(h + np.uint64(n)), bounds


def shingles(words: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As gram_hashes, but a row of fewer words, not none, has its whole sequence as its one shingle."""
    h, bounds = gram_hashes(words, ends, n)
    sizes = np.diff(ends)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if not len(short):
        return h, bounds
    own = np.empty(len(short), dtype=np.uint64)
    for j, r in enumerate(short.tolist()):
        x = 0
        for w in words[ends[r] : ends[r + 1]].tolist():
            x = (x * _step + w) & 0xFFFFFFFFFFFFFFFF
        own[j] = x + int(sizes[r]) & 0xFFFFFFFFFFFFFFFF
    out = np.insert(h, bounds[short], mix(own))
    counts = np.diff(bounds)
    counts[short] = 1
    return out, np.concatenate([[0], np.cumsum(counts)])


def pieces(batch: pa.RecordBatch, column: int, limit: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have `limit` bytes at most, or one row."""
    from loam.llm.bpe import parts

    yield from parts(batch, column, limit)
