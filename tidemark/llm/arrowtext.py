"""Vectorised handling of text columns inside Arrow batches.

The Python operators of this folder see record batches.  They work on the raw
byte buffer of a batch (no Python object per word): find the word spans with
NumPy, let Arrow's hash table number the distinct words, and only loop over the
distinct ones.  A batch is cut into pieces of a few megabytes first, so the
memory of a worker doesn't depend on how many rows or how long texts Spark
hands over at once (a single text is never cut).
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that one NumPy pass works on. A worker needs some 40 times as much for the shingles of a text and their numbers.
PIECE_BYTES = 1 << 20

#: Fixed values of the words `[^\x20\x09-\x0D]+`: the six ASCII white-space bytes separate.
WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most `limit` bytes of text, or one row."""
    column = batch.column(batch.schema.get_field_index(text))
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a piece of text, one after the other.

    `data`, `offsets`: their bytes, gapless; `docs`: the number of the first
    word of each row (one more entry than rows).
    """

    def __init__(self, raw: np.ndarray, rows: np.ndarray, separators: np.ndarray = WHITESPACE):
        keep = ~separators[raw]
        # A word begins where none was before, or where a row does.
        heads = rows[:-1][rows[:-1] < rows[1:]]
        start = keep.copy()
        end = keep.copy()  # its last byte
        if len(raw):
            start[1:] &= ~keep[:-1]
            end[:-1] &= ~keep[1:]
            start[heads] = keep[heads]
            end[heads[1:] - 1] = keep[heads[1:] - 1]
        first = np.flatnonzero(start)
        self.data = raw[keep]
        self.offsets = np.concatenate(([0], np.cumsum(np.flatnonzero(end) + 1 - first)))
        self.docs = np.searchsorted(first, rows)
        self.starts = first  # in the bytes with separators

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def array(self) -> pa.Array:
        """The words as an Arrow array over the same memory."""
        return binary(self.data, self.offsets)

    def distinct(self) -> tuple[np.ndarray, list[bytes]]:
        """(number of each word among the distinct words, the distinct words)."""
        found = self.array().dictionary_encode()
        return found.indices.to_numpy(), found.dictionary.to_pylist()


#: Bytes of a word up to which polynomial() hashes it.
SHORT_WORD = 64


@functools.cache
def _polynomial(seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.integers(0, 1 << 64, 256, np.uint64), draw.integers(0, 1 << 63, SHORT_WORD, np.uint64) * np.uint64(2) + np.uint64(1)


#: Bytes of words that polynomial() works on at a time; it needs some 30 times as much.
HASHED_BYTES = 1 << 20


def polynomial(words: Words, seed: int) -> np.ndarray:
    """A 64-bit hash of every word: random values of its bytes, each times a random odd factor of its place. Long words get XXH3."""
    values, factors = _polynomial(seed)
    lengths = np.diff(words.offsets)
    out = lengths.astype(np.uint64) * factors[0]
    low = 0
    while low < len(lengths):
        high = max(low + 1, int(np.searchsorted(words.offsets, words.offsets[low] + HASHED_BYTES, "right")) - 1)
        begins, sizes = words.offsets[low:high], lengths[low:high]
        base = begins[0]
        data = words.data[base : words.offsets[high]]
        place = np.arange(len(data), dtype=np.int32) - np.repeat((begins - base).astype(np.int32), sizes)
        np.minimum(place, SHORT_WORD - 1, out=place)
        out[low:high] += np.add.reduceat(values[data] * factors[place], begins - base)
        low = high
    for i in np.flatnonzero(lengths > SHORT_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(words.data[words.offsets[i] : words.offsets[i + 1]].tobytes(), seed)
    return out


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    """x, which is sorted, without repeats."""
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow binary array from bytes and offsets."""
    wide = offsets[-1] >= 2**31
    at = pa.py_buffer(np.ascontiguousarray(offsets, np.int64 if wide else np.int32))
    return pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(offsets) - 1, [None, at, pa.py_buffer(np.ascontiguousarray(data))])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+length-1."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def joined(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets by row) of the words marked in `keep`, joined by one blank within a row."""
    lengths = np.diff(words.offsets)
    kept = words.data[np.repeat(keep, lengths)]
    ends = np.cumsum(per_row_sum(keep, words.docs))  # in kept words
    sizes = lengths[keep] + 1
    sizes[np.unique(ends[ends > 0]) - 1] -= 1  # no blank after the last word of a row
    at = np.concatenate(([0], np.cumsum(sizes)))
    blanks = at[1:][sizes > lengths[keep]] - 1
    letter = np.ones(int(at[-1]), bool)
    letter[blanks] = False
    data = np.full(len(letter), 32, np.uint8)
    data[letter] = kept
    return data, at[np.concatenate(([0], ends))]


def per_row_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]], empty ranges included."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: workers live on, and what they hold is missing elsewhere on the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run):
    """run, a function from batches to batches, that gives memory back once it has ended and its arrays are gone."""

    @functools.wraps(run)
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return outer
