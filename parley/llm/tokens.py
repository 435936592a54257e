"""Exact tokenisation of whole texts at the cost of their distinct pieces.

Both public vocabularies cut a text at white space, and between a letter and an
ASCII sign, before they merge.  So the ids of a text are the ids of its pieces
in turn.  A piece is a run of non-space bytes, with the single space before it
where the vocabulary keeps spaces, cut again after an ASCII letter or digit
that an ASCII sign follows.  The tokenizers library encodes each distinct piece
once per worker, within a bounded cache; ids are then gathered.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from parley.llm.textcols import SPACE, binary, concat_ranges, hash_vocab

#: Bytes of distinct pieces, their ids and keys that a worker keeps; beyond it those go that were met once only.
CACHE_BYTES = 48 << 20

_SIGN = np.zeros(256, bool)
_SIGN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; a path is returned as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of pieces by one vocabulary file, with a cache of bounded size."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        ids = self.tok.encode("a a", add_special_tokens=False).ids
        self.keeps_space = ids[0] != ids[1]
        self.marks = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.to_chars = {b: c for b, c in _byte_chars().items()}
        #: Letters that every step before the merges leaves whole, but for their case.
        self.plain = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+" if self.keeps_space else "[A-Za-z\u00c0-\u00d6\u00d8-\u00de\u00e0-\u00f6\u00f8-\u00fe]+")
        self.clear()

    def clear(self) -> None:
        #: Sorted hashes of the known pieces and their places below, where they stand as they came.
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int32)
        self.names = pa.array([], pa.large_binary())
        self.start = np.zeros(0, np.int32)
        self.count = np.zeros(0, np.int32)
        self.again = np.zeros(0, bool)
        self.ids = np.zeros(0, np.uint32)

    def held(self) -> int:
        return self.names.nbytes + self.keys.nbytes + self.place.nbytes + self.start.nbytes + self.count.nbytes + self.ids.nbytes

    def trim(self) -> None:
        """Keep the pieces that were met again since the last time."""
        keep = np.flatnonzero(self.again)
        names, start, count = self.names.take(pa.array(keep)), self.start[keep], self.count[keep]
        ids = self.ids[concat_ranges(start.astype(np.int64), count.astype(np.int64))]
        self.clear()
        self.add(names, ids, count)
        if self.held() > CACHE_BYTES // 2:
            self.clear()

    def add(self, names: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        keys = hash_vocab(names)
        order = np.argsort(keys)
        into = np.searchsorted(self.keys, keys[order])
        at = len(self.start)
        self.keys = np.insert(self.keys, into, keys[order])
        self.place = np.insert(self.place, into, (at + order).astype(np.int32))
        self.names = pa.concat_arrays([self.names, names])
        self.start = np.concatenate((self.start, (len(self.ids) + np.cumsum(counts) - counts).astype(np.int32)))
        self.count = np.concatenate((self.count, counts.astype(np.int32)))
        self.again = np.concatenate((self.again, np.zeros(len(counts), bool)))
        self.ids = np.concatenate((self.ids, ids))

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in turn, and how many each has."""
        got: list[list[int] | None] = []
        odd: list[int] = []
        tokenize, chars, fits = self.tok.model.tokenize, self.to_chars, self.plain.fullmatch
        for i, raw_piece in enumerate(pieces):
            piece = raw_piece.decode("utf-8")
            if fits(piece):
                if not self.keeps_space:
                    piece = piece.lower()
                mapped = piece.replace(" ", chars[32]) if piece.isascii() else piece.encode().decode("latin-1").translate(chars)
                got.append([t.id for t in tokenize(mapped)])
            else:
                odd.append(i)
                got.append(None)
        for i, e in zip(odd, self.tok.encode_batch([pieces[i].decode("utf-8") for i in odd], add_special_tokens=False), strict=True):
            got[i] = e.ids
        counts = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(counts.sum())), counts

    def lookup(self, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, count) of each distinct piece, encoding the new ones; a piece is known by its bytes."""
        if self.held() > CACHE_BYTES:
            self.trim()
        keys = hash_vocab(vocab)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        old = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        known = np.flatnonzero(old)
        place = self.place[at[known]] if len(known) else np.zeros(0, np.int32)
        same = pc.equal(self.names.take(pa.array(place)), vocab.take(pa.array(known))).to_numpy(zero_copy_only=False).astype(bool)
        clash = known[~same]
        self.again[place[same]] = True
        start, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        start[known[same]], count[known[same]] = self.start[place[same]], self.count[place[same]]
        new = np.flatnonzero(~old)
        if len(new):
            names = vocab.take(pa.array(new))
            ids, counts = self.encode_pieces(names.to_pylist())
            start[new], count[new] = len(self.ids) + np.cumsum(counts) - counts, counts
            self.add(names, ids, counts)
        if not len(clash):
            return self.ids, start, count
        ids, counts = self.encode_pieces(vocab.take(pa.array(clash)).to_pylist())  # another piece has the hash
        start[clash], count[clash] = len(self.ids) + np.cumsum(counts) - counts, counts
        return np.concatenate((self.ids, ids)), start, count


@lru_cache(maxsize=4)
def load(path: str) -> Encoder:
    return Encoder(path)


def _pieces(data: np.ndarray, offs: np.ndarray, keeps_space: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, document offsets into codes, distinct pieces)."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(offs), np.int64), binary(data, np.zeros(1, np.int64))
    space = SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = _ALNUM[data[:-1]] & _SIGN[data[1:]]
    if keeps_space:
        cut[1:-1] |= (data[1:] == 0x20) & ~space[:-1]
        cut[offs] = True
        at = np.flatnonzero(cut)
        coded = binary(data, at).dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(at, offs), coded.dictionary
    cut[1:-1] |= space[:-1]
    cut[offs] = True
    starts = np.flatnonzero(cut[:-1] & ~space)
    keep = ~space
    before = np.cumsum(keep, dtype=np.int64)
    woffs = np.append(before[starts] - 1, before[-1])
    coded = binary(data[keep], woffs).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False) if len(starts) else np.zeros(0, np.int32)
    return codes, np.searchsorted(starts, offs), coded.dictionary


def encode(path: str, data: np.ndarray, offs: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(uint32 ids, offsets per document) for texts given as bytes; ``end_id`` closes each document.

    A text that holds the string of a special token is encoded whole, as the library does.
    """
    enc = load(path)
    codes, doc, vocab = _pieces(data, offs, enc.keeps_space)
    known, starts, counts = enc.lookup(vocab) if len(vocab) else (enc.ids, np.zeros(0, np.int64), np.zeros(0, np.int64))
    per = counts[codes] if len(codes) else np.zeros(0, np.int64)
    flat = known[concat_ranges(starts[codes], per)] if len(codes) else np.zeros(0, np.uint32)
    ends = np.concatenate(([0], np.cumsum(per)))[doc]
    text = data.tobytes()
    marked = sorted({int(np.searchsorted(offs, m.start(), "right")) - 1 for mark in enc.marks if mark.encode() in text for m in re.finditer(re.escape(mark.encode()), text)})
    if marked:
        parts = [flat[ends[i] : ends[i + 1]] for i in range(len(offs) - 1)]
        for i in marked:
            parts[i] = np.array(enc.tok.encode(text[offs[i] : offs[i + 1]].decode(), add_special_tokens=False).ids, np.uint32)
        flat, ends = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    if end_id is None:
        return flat, ends
    return np.insert(flat, ends[1:], np.uint32(end_id)), ends + np.arange(len(ends))
