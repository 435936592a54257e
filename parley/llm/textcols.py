"""Vectorised text columns for mapInArrow tasks.

A task gets Arrow batches; these helpers turn a batch's strings into word codes
with numpy and Arrow kernels, so no Python object is made per word.  Null texts
count as empty.  ``slices`` bounds what is expanded at once, whatever the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20

#: A-Z to a-z, every other byte as it is.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

#: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: After lower-casing: digits, a-z and every byte of a non-ASCII character are word bytes.
NON_ALNUM = np.zeros(256, dtype=bool)
NON_ALNUM[0x00:0x30] = True
NON_ALNUM[0x3A:0x61] = True
NON_ALNUM[0x7B:0x80] = True


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets from 0) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if bufs[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece has at most ``most`` bytes of text, or one row."""
    for batch in batches:
        _, offs = raw(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
            yield batch.slice(lo, min(hi, batch.num_rows) - lo)
            lo = hi
    release()


def release() -> None:
    """Give freed memory back to the system, so that a worker that waits for its next task stays small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def binary(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    )


@dataclass
class Words:
    """Words of a run of documents: ``codes[doc[i]:doc[i+1]]`` index ``vocab``."""

    codes: np.ndarray
    doc: np.ndarray
    vocab: pa.Array
    starts: np.ndarray
    lengths: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.doc)


def split_words(data: np.ndarray, offs: np.ndarray, gap: np.ndarray = SPACE, lut: np.ndarray | None = ASCII_LOWER) -> Words:
    """Maximal runs of bytes that are not ``gap``, within each document.

    ``gap`` holds ASCII bytes only, so runs never cut a UTF-8 character.
    """
    if lut is not None:
        data = lut[data]
    keep = ~gap[data]
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    inner = offs[:-1][offs[:-1] < len(data)]
    first[inner] = keep[inner]
    starts = np.flatnonzero(first)
    woffs = np.zeros(len(starts) + 1, np.int64)
    if len(starts):  # the kept bytes from one start to the next are its word
        np.cumsum(np.add.reduceat(keep.view(np.uint8), starts, dtype=np.int64), out=woffs[1:])
    coded = binary(data[keep], woffs).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False) if len(starts) else np.zeros(0, np.int32)
    return Words(codes, np.searchsorted(starts, offs), coded.dictionary, starts, np.diff(woffs))


def concat_ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ..., then begin[1], ...: the indices of all ranges in turn."""
    total = int(length.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total, dtype=np.int64) + np.repeat(begin - (ends - length), length)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) for uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_KEYS = [np.zeros(0, np.uint64)]


def _place_keys(n: int) -> np.ndarray:
    """Fixed keys of the first n places."""
    if len(_KEYS[0]) < n:
        with np.errstate(over="ignore"):
            _KEYS[0] = mix64(np.arange(1, max(n, 4096) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0x243F6A8885A308D3))
    return _KEYS[0]


def hash_ranges(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[offs[i]:offs[i+1]], from its bytes alone.

    Every eight bytes are mixed under the key of their place before they are
    added up, so no structure of a text cancels, as it can in a polynomial.
    """
    n = np.diff(offs)
    words = -(-n // 8)
    begin = np.cumsum(words) - words
    padded = np.zeros(8 * int(words.sum()), np.uint8)
    padded[np.arange(len(data)) + np.repeat(8 * begin - offs[:-1], n)] = data
    out = n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    full = n > 0
    if full.any():
        at = np.arange(len(padded) // 8) - np.repeat(begin, words)
        term = mix64(padded.view("<u8") ^ _place_keys(int(words.max()))[at])
        with np.errstate(over="ignore"):
            out[full] ^= np.add.reduceat(term, begin[full])
    return mix64(out)


def hash_vocab(vocab: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    return hash_ranges(*raw(vocab))


def append_columns(df, text: str, compute, fields):
    """``df`` with further columns that ``compute(record batch)`` makes from slices of its rows.

    ``fields`` are Spark StructFields; a field whose name ``df`` has already is an error.
    """
    from pyspark.sql import types as T

    taken = {n.lower() for n in df.columns} & {f.name.lower() for f in fields}
    if taken:
        raise ValueError(f"the table has columns named {sorted(taken)}")
    schema = T.StructType([*df.schema.fields, *fields])
    names = schema.names

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*part.columns, *compute(part)], names=names)

    return df.mapInArrow(task, schema)


def sums(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Sum of values[doc[i]:doc[i+1]] for each i; 0 for an empty range."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, 0, out=total[1:])
    return total[doc[1:]] - total[doc[:-1]]
