"""Vector bin packing of tokenised examples into fixed-length sequences.

``pack_examples`` places examples under three limits at once: tokens, segments
and loss-bearing tokens of a sequence.  The dot-product heuristic fills one
sequence at a time: of the pieces that fit, it takes the one whose demand vector
has the largest weighted dot product with the room that is left.  Examples
longer than a sequence are cut into full ones first; where no piece fits and the
gap is worth it, one is cut to close the gap, so padding stays near nothing.

Each task packs its own rows as they stream by, with a pool of bounded size:
nothing is shuffled, and a lost task is simply run again.

Defined results: a null text counts as empty (its end id alone is packed); a null
key stays null; repeated rows are packed as often as they occur; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.store import documents
from parley.llm.textcols import raw, slices
from parley.llm.tokens import encode, vocabulary

#: Tokens that wait in a task before sequences are filled from them.
POOL_TOKENS = 1 << 20
#: Numbers of sequences that one long example fills begin here, apart from those of the open one.
FULL = 1 << 38
#: The smallest gap for which a piece is cut; a smaller one is padded.
LEAST_CUT = 8


class Packer:
    """Fills sequences from a pool of pieces; ``ids`` of a piece are its uint32 tokens.

    A piece is (key, start, doc_tokens, ids, loss) with ``loss`` its share of
    loss-bearing tokens per token, so that cuts keep the third limit exact enough
    to be checked by ``ceil``.
    """

    def __init__(self, capacity: int, max_segments: int, max_loss: int, may_cut: bool = True) -> None:
        self.limits = np.array([capacity, max_segments, max_loss], float)
        self.may_cut = may_cut
        self.pools: dict[tuple[int, int], list] = {}
        self.tokens = 0
        self.next_sequence = self.full = 0
        self.bin: list = []
        self.used = np.zeros(3)
        self.out: list = []

    @staticmethod
    def _demand(piece: tuple) -> tuple[int, int]:
        return len(piece[3]), int(piece[4].sum())

    def add(self, key: object, ids: np.ndarray, loss: np.ndarray) -> None:
        """Take one example; parts that fill a whole sequence leave at once."""
        step = int(self.limits[0])
        lo = 0
        while lo < len(ids):
            hi = min(lo + step, len(ids))
            over = np.searchsorted(np.cumsum(loss[lo:hi]), self.limits[2], "right")
            hi = min(hi, lo + max(1, int(over)))
            piece = (key, lo, len(ids), ids[lo:hi], loss[lo:hi])
            if hi - lo == step:
                self.out.append((*piece[:4], FULL + self.full, 0))
                self.full += 1
            else:
                self._pool(piece)
            lo = hi

    def _pool(self, piece: tuple) -> None:
        self.pools.setdefault(self._demand(piece), []).append(piece)
        self.tokens += len(piece[3])

    def _take(self, demand: tuple[int, int]) -> tuple:
        pieces = self.pools[demand]
        piece = pieces.pop()
        if not pieces:
            del self.pools[demand]
        self.tokens -= demand[0]
        return piece

    def _place(self, piece: tuple) -> None:
        self.bin.append(piece)
        n, loss = self._demand(piece)
        self.used += (n, 1, loss)

    def _close(self) -> None:
        """End the open sequence; one that would be padded by much is cut into powers of two, which need no padding."""
        left = int(self.used[0])
        size = int(self.limits[0])
        if self.may_cut and size - left >= LEAST_CUT and left:
            size = 1 << (left.bit_length() - 1)
        used = 0
        for key, start, total, ids, _ in self.bin:
            while len(ids):
                n = min(len(ids), size - used)
                self.out.append((key, start, total, ids[:n], self.next_sequence, used))
                ids, start, used, left = ids[n:], start + n, used + n, left - n
                if used == size and left:
                    self.next_sequence += 1
                    used = 0
                    size = 1 << (left.bit_length() - 1)
        if self.bin:
            self.next_sequence += 1
        self.bin = []
        self.used[:] = 0

    def fill(self, rest: int) -> None:
        """Fill sequences until at most ``rest`` tokens wait."""
        while self.tokens > rest:
            demands = np.array([(n, 1, loss) for n, loss in self.pools], float)
            counts = np.array([len(p) for p in self.pools.values()])
            keys = list(self.pools)
            weight = (demands * counts[:, None]).sum(0) / self.limits
            while self.tokens > rest:
                room = self.limits - self.used
                fits = (demands <= room).all(1) & (counts > 0)
                if fits.any():
                    score = np.where(fits, (demands / self.limits) @ (weight * room / self.limits), -1.0)
                    k = int(score.argmax())
                    counts[k] -= 1
                    self._place(self._take(keys[k]))
                    if self.used[0] == self.limits[0]:
                        self._close()
                    continue
                if self.may_cut and min(room[0], room[2]) >= LEAST_CUT and room[1] >= 1:
                    k = int(np.flatnonzero(counts > 0)[demands[counts > 0][:, 0].argmax()])
                    key, start, total, ids, loss = self._take(keys[k])
                    over = int(np.searchsorted(np.cumsum(loss), room[2], "right"))
                    n = min(int(room[0]), over, len(ids))
                    if n:
                        self._place((key, start, total, ids[:n], loss[:n]))
                    if n < len(ids):
                        self._pool((key, start + n, total, ids[n:], loss[n:]))
                self._close()
                break

    def finish(self) -> None:
        """Fill from all that waits, and end the last sequence."""
        self.fill(0)
        self._close()

    def drain(self) -> list:
        """The pieces of sequences that have ended."""
        out, self.out = self.out, []
        return out


def pack_examples(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 1,
    capacity: int = 2048,
    max_segments: int = 256,
    max_loss: int = 2048,
    loss_mask: Callable[[np.ndarray], np.ndarray] | None = None,
    may_cut: bool = True,
) -> DataFrame:
    """Tokenise and pack; a row per piece with its ids as little-endian uint32 bytes.

    ``loss_mask`` maps an example's ids to booleans: which of them bear loss
    (all, by default; for instruction data, the answer's).
    Columns: key, start, length, ids, doc_tokens, sequence_id, offset.
    """
    path = vocabulary(tokenizer)
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind)] + [T.StructField(n, t) for n, t in (("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, max_segments, max_loss, may_cut)
        base = TaskContext.get().partitionId() << 40
        arrow = None

        def rows() -> pa.RecordBatch | None:
            out = packer.drain()
            if not out:
                return None
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], arrow), pa.array(cols[1], pa.int64()), pa.array([len(i) for i in cols[3]], pa.int64()), pa.array([i.astype("<u4").tobytes() for i in cols[3]], pa.binary()), pa.array(cols[2], pa.int64()), pa.array([base + s for s in cols[4]], pa.int64()), pa.array(cols[5], pa.int64())],
                names=schema.names,
            )

        for part in slices(batches, text):
            arrow = part.column(key).type
            ids, offs = encode(path, *raw(part.column(text)), end_id)
            for i, k in enumerate(part.column(key).to_pylist()):
                own = ids[offs[i] : offs[i + 1]]
                packer.add(k, own.copy(), np.ones(len(own), bool) if loss_mask is None else loss_mask(own))
                if packer.tokens > 2 * POOL_TOKENS:
                    packer.fill(POOL_TOKENS)
            if (got := rows()) is not None:
                yield got
        packer.finish()
        if (got := rows()) is not None:
            yield got

    return df.select(key, text).mapInArrow(task, schema)


def packed_documents(docs: DataFrame) -> DataFrame:
    """The contract's columns for a table of documents."""
    # Every id bears loss, and a sequence can't hold more segments than ids: only the tokens bind.
    return pack_examples(docs, max_segments=2048).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir))


QUERIES = {"op4_packing": op4_packing}
ORACLE_SQL: dict[str, str] = {}
