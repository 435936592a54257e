"""Arrays of keys as compact byte strings, for shuffles of many small numbers.

Sorted 64-bit keys are stored as differences, numbers as they are; both as planes
of bytes (all lowest bytes, then the next ...), without planes that are all zero,
which shuffles and files compress well.
"""

from __future__ import annotations

import struct

import numpy as np


def _planes(x: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)
    top = int(x.max(initial=0)).bit_length()
    width = max(1, -(-top // 8))
    return struct.pack("<QB", len(x), width) + np.ascontiguousarray(raw[:, :width].T).tobytes()


def _unplanes(blob: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<QB", blob)
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :width] = np.frombuffer(blob, np.uint8, n * width, 9).reshape(width, n).T
    return raw.reshape(-1).view("<u8").astype(np.uint64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys."""
    keys = keys.astype(np.uint64)
    return _planes(np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys)


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(blob), dtype=np.uint64)


def pack_small(values: np.ndarray) -> bytes:
    """Non-negative integers."""
    return _planes(values.astype(np.uint64))


def unpack_small(blob: bytes) -> np.ndarray:
    return _unplanes(blob).astype(np.int64)
