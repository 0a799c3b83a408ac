"""Words, word hashes and shingles of whole Arrow batches of texts, in numpy.

A batch's UTF-8 bytes are handled as one array; documents are ranges of it. Batches are cut
into slices of a few megabytes, so that memory follows the slice and not the batch; one text that is
longer makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scramble 64-bit hashes so that any of their bits can be used alone."""
    h = h + np.uint64((seed * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xE9846AF9B1A615D)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xE9846AF9B1A615D)
    return h ^ (h >> np.uint64(28))


def powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), STEP, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of up to ``most`` bytes of text, or of one row."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, the n + 1 offsets of the texts in them); a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


class Words:
    """The words of some texts: ``start`` and ``end`` as byte offsets, ``first[d]:first[d+1]`` of text d."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, self.offsets = text_bytes(texts)
        if lower:
            self.data = LOWER[self.data]
        space = SPACE[self.data]
        cut = np.zeros(len(self.data) + 1, bool)
        cut[self.offsets] = True
        word = ~space
        self.start = np.flatnonzero(word & (np.r_[True, space[:-1]] | cut[:-1])) if len(word) else np.zeros(0, np.int64)
        self.end = np.flatnonzero(word & (np.r_[space[1:], True] | cut[1:])) + 1 if len(word) else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def strings(self) -> list[str]:
        raw = self.data.tobytes()
        return [raw[a:b].decode() for a, b in zip(self.start.tolist(), self.end.tolist())]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans aren't empty and don't overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    inside = np.arange(int(size.sum())) - np.repeat(at, size)
    codes = BYTE_CODE[data[inside + np.repeat(start, size)]] * powers(int(size.max()))[inside]
    return mix(np.add.reduceat(codes, at))


def windows(hashes: np.ndarray, first: np.ndarray, width: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs of ``width`` words of each text, n + 1 offsets of the texts in them).

    With ``short``, a text with fewer words, but some, has its whole sequence as its one run.
    """
    n = len(hashes)
    counts = np.diff(first)
    full = np.maximum(counts - width + 1, 0)
    weight = powers(width)
    run = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        run += hashes[k:k + len(run)] * weight[k]
    at = np.repeat(first[:-1], full) + np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full)
    out = mix(run[at], width)
    if not short:
        return out, np.concatenate([[0], np.cumsum(full)])
    few = np.flatnonzero((counts > 0) & (counts < width))
    own = np.array([mix((hashes[a:b] * weight[:b - a]).sum(keepdims=True), width + int(b - a))[0]
                    for a, b in zip(first[few].tolist(), first[few + 1].tolist())], np.uint64)
    sizes = full.copy()
    sizes[few] = 1
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    all_ = np.empty(int(ptr[-1]), np.uint64)
    lone = np.zeros(len(all_), bool)
    lone[ptr[few]] = True
    all_[~lone], all_[lone] = out, own
    return all_, ptr


def distinct(values: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values of each range of ``values``, their new offsets, and how often each occurs."""
    values = values.copy()
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist()):
        values[a:b].sort()
    if not len(values):
        return values, ptr, np.zeros(0, np.int64)
    new = np.r_[True, values[1:] != values[:-1]]
    new[ptr[:-1][ptr[:-1] < len(values)]] = True
    # an empty range shares its offset with the next one; marking a start twice changes nothing
    at = np.flatnonzero(new)
    times = np.diff(np.r_[at, len(values)])
    return values[at], np.searchsorted(at, ptr), times


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text, A-Z lower-cased, as sorted hashes with offsets."""
    words = Words(texts, lower=True)
    runs, ptr = windows(words.hashes(), words.first, width, short=True)
    sets, ptr, _ = distinct(runs, ptr)
    return sets, ptr
