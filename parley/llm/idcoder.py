"""Lossless coding of token ids by context mixing and a range coder.

A stream of ids is cut into blocks; each block starts from a fresh model and has
its own checksum, so one can be read, or lost, without the others.  A block is
cut into lanes that advance side by side: every step codes the next id of each of
them with numpy vectors, in encoder and decoder alike.  The lanes of a block
share one model, so it learns from all of them.

The model mixes three predictions of the next id:

* order 2: the id that followed the last two ids when they last occurred;
* order 1: the id that followed the last id when it last occurred;
* order 0: adaptive counts of every id, taken up every few steps.

The mixing weights are counts too: in each state (how often either prediction has
held lately, and whether they agree) how often order 2, order 1 or neither was
right.  The range of a step is shared out in that order, and a 48-bit range coder
turns the shares into 16-bit words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMRC2\n"
#: Ids of a block, and of one whose ids are coded by their rank among the block's own.
BLOCK, RANKED = 1 << 20, 1 << 18
#: Lanes of a block at most, and ids of a lane at least.
LANES, STEPS = 4096, 256
BITS = 28
TOTAL = 1 << BITS
#: Resolution of order 0; larger ids are coded by rank.
BASE = 1 << 20
MOST = BASE >> 1
SLOTS = 1 << 16
REFRESH = 32
#: Steps after which the mixing weights are taken up.
MIX = 4
U = np.uint64


class BlockError(ValueError):
    """A block whose checksum does not hold."""


class _Model:
    """The shared model of a block's lanes; a slot holds id * 4 + confidence."""

    def __init__(self, lanes: int, n_ids: int, inverse: bool) -> None:
        self.n_ids, self.inverse = n_ids, inverse
        self.count = np.zeros(n_ids, np.int64)
        self.seen: list[np.ndarray] = []
        self.outcomes: list[np.ndarray] = []
        self.t1 = np.zeros(n_ids, np.int32)
        self.t2 = np.zeros(SLOTS, np.int32)
        #: By state: how often order 2, order 1 and neither held.
        self.weight = np.ones((32, 3), np.int64)
        self.p = np.zeros(lanes, np.int32)
        self.pp = np.zeros(lanes, np.int32)
        self.step = 0

    def _refresh(self) -> None:
        if self.seen:
            self.count += np.bincount(np.concatenate(self.seen), minlength=self.n_ids)
            self.seen = []
        total = int(self.count.sum())
        self.per = (1 + self.count * (BASE - self.n_ids) // total).astype(np.int32) if total else np.full(self.n_ids, BASE // self.n_ids, np.int32)
        self.cum = np.zeros(self.n_ids + 1, np.int32)
        np.cumsum(self.per, out=self.cum[1:])
        if self.inverse:
            self.id_at = np.repeat(np.arange(self.n_ids, dtype=np.int32), self.per)

    def _mix(self) -> None:
        """Shares of the range by state: orders 1 and 2 keep a sliver of it at least, and order 0 a thirty-second."""
        if self.outcomes:
            self.weight += np.bincount(np.concatenate(self.outcomes), minlength=96).reshape(3, 32).T
            self.outcomes = []
        share = self.weight * TOTAL // self.weight.sum(1, keepdims=True)
        w2 = np.clip(share[:, 0], 256, TOTAL - (TOTAL >> 4))
        w12 = np.minimum(w2 + np.maximum(share[:, 1], 256), TOTAL - (TOTAL >> 5))
        self.mixed2, self.mixed12, self.scale = w2.astype(np.int32), w12.astype(np.int32), (TOTAL - w12 >> 20).astype(np.int32)

    def predict(self) -> None:
        if self.step in (1, 2, 4, 8) or self.step % REFRESH == 0:
            self._refresh()
        self.step += 1
        with np.errstate(over="ignore"):
            self.h2 = (self.p * np.int32(-1640531535) + self.pp * np.int32(320255973) >> 15) & np.int32(SLOTS - 1)
        x1, x2 = self.t1.take(self.p), self.t2.take(self.h2)
        self.s1, self.s2 = x1 & 3, x2 & 3
        self.p1, self.p2 = x1 >> 2, x2 >> 2
        self.state = self.s2 * 8 + self.s1 * 2 + (self.p1 == self.p2)
        if self.step % MIX == 1:
            self._mix()
        self.w2, self.w12, self.mult = self.mixed2.take(self.state), self.mixed12.take(self.state), self.scale.take(self.state)

    def low_freq(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of the range that codes each id."""
        low = self.w12 + self.cum.take(ids) * self.mult
        freq = self.per.take(ids) * self.mult
        hit2 = ids == self.p2
        hit1 = (ids == self.p1) & ~hit2
        np.copyto(low, self.w2, where=hit1)
        np.copyto(freq, self.w12 - self.w2, where=hit1)
        np.copyto(low, 0, where=hit2)
        np.copyto(freq, self.w2, where=hit2)
        return low, freq

    def find(self, target: np.ndarray) -> np.ndarray:
        """The id whose part of the range holds ``target``."""
        ids = np.where(target < self.w2, self.p2, self.p1)
        rest = np.flatnonzero(target >= self.w12)
        at = (target[rest] - self.w12[rest]) // self.mult[rest]
        ids[rest] = self.id_at.take(np.minimum(at, len(self.id_at) - 1))
        return ids

    def learn(self, ids: np.ndarray) -> None:
        """Weights and predictions follow what came; order 1 learns as well where order 2 spoke first."""
        hit1, hit2 = ids == self.p1, ids == self.p2
        self.outcomes.append(self.state + _OUTCOME.take(hit1 + 2 * hit2.view(np.int8)))
        # Where lanes meet in a slot the last one stays, in encoder and decoder alike.
        self.t1[self.p] = _NEXT.take(self.s1 + 4 * hit1) + 4 * np.where(hit1 | (self.s1 > 2), self.p1, ids)
        self.t2[self.h2] = _NEXT.take(self.s2 + 4 * hit2) + 4 * np.where(hit2 | (self.s2 > 2), self.p2, ids)
        self.seen.append(ids)
        self.pp, self.p = self.p, ids


#: Confidence after a miss from 0..3, then after a hit.
_NEXT = np.array([1, 1, 1, 2, 1, 2, 3, 3], np.int32)
#: Whether order 2 (0), order 1 (32) or neither (64) held, by hits of order 1 and twice those of order 2.
_OUTCOME = np.array([64, 32, 0, 0], np.int32)


def _shape(n: int) -> tuple[int, int]:
    """(lanes, steps) of a block of n ids."""
    lanes = min(LANES, max(1, n // STEPS))
    return lanes, -(-n // lanes)


def _encode_block(ids: np.ndarray) -> bytes:
    lanes, steps = _shape(len(ids))
    names = np.zeros(0, np.uint32)
    grid = ids.astype(np.int64)
    if int(ids.max()) >= MOST:
        names, grid = np.unique(ids, return_inverse=True)
        grid = grid.reshape(-1)
    n_ids = int(grid.max()) + 1
    padded = np.zeros(lanes * steps, np.int32)
    padded[: len(ids)] = grid
    grid = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    model = _Model(lanes, n_ids, False)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 48) - 1, np.uint64)
    width = 2 * steps + 8
    words = np.zeros((lanes, width), np.int32)
    flat, base = words.reshape(-1), np.arange(lanes) * width
    used = np.zeros(lanes, np.int64)
    mask = U((1 << 48) - 1)
    for sym in grid:
        model.predict()
        at, freq = model.low_freq(sym)
        model.learn(sym)
        r = span >> U(BITS)
        low += r * at.astype(np.uint64)
        over = np.flatnonzero(low > mask)
        if over.size:
            flat[base[over] + used[over] - 1] += 1
            low &= mask
        span = r * freq.astype(np.uint64)
        small = np.flatnonzero(span < U(1 << 32))
        while small.size:
            own, width_ = low.take(small), span.take(small) << U(16)
            flat[base.take(small) + used.take(small)] = (own >> U(32)).astype(np.int32)
            used[small] += 1
            low[small] = (own << U(16)) & mask
            span[small] = width_
            small = small[width_ < U(1 << 32)]
    lane = np.arange(lanes)
    for _ in range(3):
        words[lane, used] = (low >> U(32)).astype(np.int32)
        used += 1
        low = (low << U(16)) & mask
    for i in range(int(used.max()) - 1, 0, -1):
        words[:, i - 1] += words[:, i] >> 16
        words[:, i] &= 0xFFFF
    keep = np.arange(words.shape[1]) < used[:, None]
    body = words[keep].astype("<u2").tobytes()
    head = struct.pack("<IIII", len(ids), n_ids, len(names), zlib.crc32(ids.astype("<u4").tobytes()))
    return head + names.astype("<u4").tobytes() + used.astype("<u4").tobytes() + struct.pack("<I", len(body)) + body


def encode_blocks(ids: np.ndarray) -> bytes:
    """Blocks of at most ``BLOCK`` ids, each independently coded and checksummed."""
    size = BLOCK if not len(ids) or int(ids.max()) < MOST else RANKED
    blocks = [_encode_block(ids[lo : lo + size]) for lo in range(0, len(ids), size)]
    return struct.pack("<I", len(blocks)) + b"".join(struct.pack("<I", len(b)) + b for b in blocks)


def _decode_block(blob: bytes) -> np.ndarray:
    n, n_ids, ranked, check = struct.unpack_from("<IIII", blob)
    lanes, steps = _shape(n)
    names = np.frombuffer(blob, "<u4", ranked, 16)
    used = np.frombuffer(blob, "<u4", lanes, 16 + 4 * ranked).astype(np.int64)
    at = 16 + 4 * (ranked + lanes)
    body = np.frombuffer(blob, "<u2", struct.unpack_from("<I", blob, at)[0] // 2, at + 4)
    words = np.zeros((lanes, int(used.max()) + 4), np.uint64)
    words[np.arange(words.shape[1]) < used[:, None]] = body
    model = _Model(lanes, n_ids, True)
    code = (words[:, 0] << U(32)) | (words[:, 1] << U(16)) | words[:, 2]
    read = np.full(lanes, 3)
    last = words.shape[1] - 1
    span = np.full(lanes, (1 << 48) - 1, np.uint64)
    out = np.zeros((steps, lanes), np.int32)
    for step in range(steps):
        model.predict()
        r = span >> U(BITS)
        target = np.minimum(code // r, U(TOTAL - 1)).astype(np.int32)
        sym = model.find(target)
        low, freq = model.low_freq(sym)
        model.learn(sym)
        out[step] = sym
        code -= r * low.astype(np.uint64)
        span = r * freq.astype(np.uint64)
        small = np.flatnonzero(span < U(1 << 32))
        while small.size:
            code[small] = (code[small] << U(16)) | words[small, np.minimum(read[small], last)]
            read[small] += 1
            span[small] <<= U(16)
            small = small[span[small] < U(1 << 32)]
    ids = out.T.reshape(-1)[:n]
    ids = (names[ids] if ranked else ids).astype("<u4")
    if zlib.crc32(ids.tobytes()) != check:
        raise BlockError("a block's checksum does not hold")
    return ids


def decode_blocks(blob: bytes) -> np.ndarray:
    """The ids again; a block whose checksum fails raises ``BlockError``."""
    (count,) = struct.unpack_from("<I", blob)
    at, parts = 4, [np.zeros(0, np.uint32)]
    for _ in range(count):
        (size,) = struct.unpack_from("<I", blob, at)
        try:
            parts.append(_decode_block(blob[at + 4 : at + 4 + size]))
        except (ValueError, IndexError, ZeroDivisionError, struct.error) as e:
            raise BlockError(f"a block can't be read: {e}") from e
        at += 4 + size
    return np.concatenate(parts)
