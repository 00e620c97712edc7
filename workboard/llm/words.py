"""Words, hashes and runs of words of many texts at once (numpy inside Arrow batches)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Texts are taken together up to about this many bytes; one longer text makes a batch of its own.
BATCH_BYTES = 4 << 20

_B = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of the word hashes
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # multipliers of the finalizer


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers (splitmix finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.uint64:
    with np.errstate(over="ignore"):
        r = np.uint64(1)
        for _ in range(n):
            r = r * _B
    return r


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """For each i the hash of words[i:i+k]; has max(0, len - k + 1) entries. Doubling keeps it at log2(k) passes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, span, block = None, 0, 1, words
    bits = k
    while bits:
        if bits & 1:
            part = block[done: done + n]
            out = part.copy() if out is None else out + part * powers(done)
            done += span
        bits >>= 1
        if bits:
            block = block[:-span] + block[span:] * powers(span)
            span *= 2
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def batches(it: Iterator[pa.RecordBatch], size_of: str) -> Iterator[pa.RecordBatch]:
    """Re-cut record batches so that the column ``size_of`` holds about BATCH_BYTES a batch, at least one row."""
    for b in it:
        col = b.column(b.schema.get_field_index(size_of))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
        start, total = 0, 0
        for i, s in enumerate(sizes):
            if i > start and total + s > BATCH_BYTES:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += int(s)
        if len(sizes) > start:
            yield b.slice(start)


def segments(counts: np.ndarray) -> np.ndarray:
    """Start offsets of consecutive segments, with the total as the last entry."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def lists(flat: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, type=kind))
