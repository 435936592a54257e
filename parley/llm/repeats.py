"""Removal of repeated byte strings with merged Burrows-Wheeler transforms of shards.

Removed is each byte that a string of ``LENGTH`` bytes covers which also starts
anywhere else.  A full suffix order of a large corpus is out of reach, and only
suffixes at places where a repeat can be matter; so the order is sparse:

1. Anchors.  In every run of ``LENGTH`` bytes the smallest hash of ``GRAM`` bytes
   is an anchor: equal strings have the same anchor at the same place.
2. Exchange.  Slices of documents send the hashes of their anchors, and of the
   anchors' surroundings, by range of hash; reducers answer how often each occurs.
   An anchor that occurs once is in no repeat.  Surroundings that occur again as a
   whole are repeated as a whole, and one copy of them goes on.
3. Merge.  Each slice is a shard: of the strings from its anchors on (and of those
   back from them) it builds the Burrows-Wheeler transform over symbols of eight
   bytes, and sends only that.  A reducer merges the shards' transforms by
   iterative interleave refinement: each pass takes the symbols before the
   suffixes from the shards by rank and distributes the interleave by them, until
   the anchors stand in front.  The merged order, and where neighbours part, follow
   from the interleave alone; suffixes are never sorted again.
4. Intervals.  The intervals of equal prefixes form a tree.  Within one, the same
   merge of the bytes before the anchors (backwards) gives the longest common
   left context; with the interval's depth it makes a repeat of at least ``LENGTH``.

An anchor that more than ``HOT`` places share would gather in one reducer.  The
strings around such anchors are told apart by their own hashes instead, one for
each start, through the same exchange, where a string comes once per slice.

Equality of surroundings, and of strings at hot anchors, is by 64-bit hash over
their bytes, all else by bytes.

Defined results: null and empty texts have no bytes; copies remove each other; a
text shorter than ``LENGTH`` is kept; keys may repeat, rows are judged one by one;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.blobs import pack_keys, pack_small, unpack_keys, unpack_small
from parley.llm.store import documents, scratch, spread_keys
from parley.llm.textcols import concat_ranges, mix64, raw, slices

LENGTH = 200
GRAM = 40
SPAN = LENGTH - GRAM + 1
LEFT, RIGHT = LENGTH - GRAM, LENGTH
SLICE = 2 << 20
#: Places that may share an anchor before its strings are hashed one by one.
HOT = 10_000
_M = 0x9E3779B97F4A7C15
_INV = pow(_M, -1, 1 << 64)


def _cumulative(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of byte * M^i and the powers of 1/M, modulo 2^64."""
    n = len(data)
    power = np.full(n + 1, _M, np.uint64)
    power[0] = 1
    back = np.full(n + 1, _INV, np.uint64)
    back[0] = 1
    with np.errstate(over="ignore"):
        np.cumprod(power, out=power)
        np.cumprod(back, out=back)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    return total, back


def _window(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i:i+w] for each i, by block-wise running values."""
    n = len(x) - w + 1
    pad = -len(x) % w
    ext = np.concatenate((x, np.repeat(x[-1:], pad))).reshape(-1, w)
    ahead = op.accumulate(ext, 1).reshape(-1)
    behind = op.accumulate(ext[:, ::-1], 1)[:, ::-1].reshape(-1)
    return op(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, hashes of the surroundings) of all anchors."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(data) < LENGTH:
        return none
    total, back = _cumulative(data)
    with np.errstate(over="ignore"):
        h = mix64((total[GRAM:] - total[:-GRAM]) * back[: len(data) - GRAM + 1]) | np.uint64(1)
    least = _window(h, SPAN, np.minimum)
    # Windows that leave their document do not count.
    room = np.repeat(offs[1:], np.diff(offs))[: len(least)] - np.arange(len(least))
    least[room < LENGTH] = 0
    most = _window(np.concatenate((np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64))), SPAN, np.maximum)
    at = np.flatnonzero(most[: len(h)] == h)
    doc = np.searchsorted(offs, at, "right") - 1
    lo, hi = np.maximum(at - LEFT, offs[doc]), np.minimum(at + RIGHT, offs[doc + 1])
    with np.errstate(over="ignore"):
        around = (total[hi] - total[lo]) * back[lo] ^ mix64(((at - lo) * 1024 + (hi - at)).astype(np.uint64))
    # Anchors are smallest hashes, hence small; mixed again they fill the hash space evenly.
    return at, mix64(h[at]), mix64(around)


_BLOCKS = "block long, ids binary, offs binary, data binary, at binary, anchor binary, around binary"


def _ipc(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("key", column.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([column], names=["key"]))
    return sink.getvalue().to_pybytes()


def _write_blocks(docs: DataFrame, key: str, text: str, path: str) -> None:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        press = zstandard.ZstdCompressor(level=3)
        for part in slices(batches, text, SLICE):
            data, offs = raw(part.column(text))
            at, anchor, around = anchors(data, offs)
            row = [block, _ipc(part.column(key)), pack_small(np.diff(offs)), press.compress(data.tobytes()), pack_keys(at), anchor.tobytes(), around.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64()] + [pa.binary()] * 6, strict=True)], names=["block", "ids", "offs", "data", "at", "anchor", "around"])
            block += 1

    docs.select(key, text).mapInArrow(task, _BLOCKS).write.option("compression", "none").parquet(path)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.concatenate(([0], np.searchsorted(keys, np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)), [len(keys)]))


def _ask(spread: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, anchor, around in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys, counts = np.unique(np.concatenate((np.frombuffer(anchor, np.uint64), np.frombuffer(around, np.uint64))), return_counts=True)
                yield _by_bucket(block, keys, counts, spread)

    return task


def _answerer(hot: int):
    def answer(table: pa.Table) -> pa.Table:
        """Of one bucket, to each slice and key: 0 once, 1 again, 2 again and first seen here; 4 more where it is hot."""
        table = table.sort_by("block")
        keys = [unpack_keys(x) for x in table["keys"].to_pylist()]
        every, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        counts = np.concatenate([unpack_small(x) for x in table["counts"].to_pylist()])
        total = np.bincount(place.reshape(-1), counts, len(every))
        again = total > 1
        code = again[place].astype(np.int64)
        code[first[again]] = 2
        code += 4 * (total > hot)[place]
        parts = np.split(code, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"block": table["block"], "part": table["part"], "reply": pa.array([pack_small(c) for c in parts], pa.binary()), "hot": pa.array([bool((c > 3).any()) for c in parts])})

    return answer


def _replied(anchor: np.ndarray, around: np.ndarray, replies: list) -> tuple[np.ndarray, np.ndarray]:
    """(code of the anchor, code of its surroundings without hotness) for every anchor of a slice."""
    keys = np.unique(np.concatenate((anchor, around)))
    code = np.concatenate([unpack_small(r["reply"]) for r in replies]) if replies else np.zeros(0, np.int64)
    return code[np.searchsorted(keys, anchor)], code[np.searchsorted(keys, around)] % 4


def _unpacked(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    offs = np.concatenate(([0], np.cumsum(unpack_small(r["offs"]))))
    return offs, unpack_keys(r["at"]).astype(np.int64), np.frombuffer(r["anchor"], np.uint64), np.frombuffer(r["around"], np.uint64)


def _bytes(r: dict) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(r["data"]), np.uint8)


def _hot_strings(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the strings of LENGTH bytes around hot anchors whose surroundings do not recur."""
    offs, at, anchor, around = _unpacked(r)
    own, code = _replied(anchor, around, r["replies"])
    some = at[(own > 3) & (code != 1)]
    if not len(some):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = _bytes(r)
    doc = np.searchsorted(offs, some, "right") - 1
    lo = np.maximum(some - LEFT, offs[doc])
    hi = np.minimum(some, offs[doc + 1] - LENGTH)
    start = np.unique(concat_ranges(lo, np.maximum(hi - lo + 1, 0)))
    total, back = _cumulative(data)
    with np.errstate(over="ignore"):
        return start, mix64((total[start + LENGTH] - total[start]) * back[start])


def _ask_strings(spread: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                _, h = _hot_strings(r)
                keys, counts = np.unique(h, return_counts=True)
                yield _by_bucket(r["block"], keys, counts, spread)

    return task


def _by_bucket(block: int, keys: np.ndarray, counts: np.ndarray, spread: np.ndarray) -> pa.RecordBatch:
    cut = _cuts(keys, len(spread))
    full = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(full), block), pa.int64()), pa.array(spread[full], pa.int64()), pa.array(full, pa.int32()), pa.array([pack_keys(keys[cut[i] : cut[i + 1]]) for i in full], pa.binary()), pa.array([pack_small(counts[cut[i] : cut[i + 1]]) for i in full], pa.binary())],
        names=["block", "bucket", "part", "keys", "counts"],
    )


def _padded(data: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """Bytes from each ``begin`` on (or back), ended by 0xFF, which no UTF-8 text has."""
    out = np.zeros((len(begin), width), np.uint8)
    row = np.repeat(np.arange(len(begin)), size)
    col = concat_ranges(np.zeros(len(begin), np.int64), size)
    out[row, col] = data[begin[row] + step * col]
    out[np.arange(len(begin)), size] = 0xFF
    return out


RIGHT_W, LEFT_W = 208, 168


def _symbols(rows: np.ndarray) -> np.ndarray:
    """Eight bytes at a time as big-endian numbers, which order as the bytes do."""
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


def transform(symbols: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transform of strings of equal length, over symbols of eight bytes, by groups of strings.

    Row j holds, for the suffixes that begin at symbol j + 1 and in their order, the
    symbols before them.  Each order follows from the next one's by a stable
    distribution of these symbols, so no two suffixes are ever compared.  Strings of
    one group stand together; a group's part is the group's own transform.
    """
    n, m = symbols.shape
    order = np.arange(n)
    out = np.empty((m, n), np.uint64)
    for j in range(m - 1, -1, -1):
        before = symbols[order, j]
        out[j] = before[np.argsort(group[order], kind="stable")]
        order = order[np.argsort(before, kind="stable")]
    return out


def merge_transforms(parts: list[np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of all strings of the shards, and each one's common prefix (bytes) with the one before.

    ``first`` is what stands before the strings, shard after shard: their anchors.
    The interleave says from which shard each merged suffix comes.  At the empty
    suffix it is shard after shard; a pass takes from each shard the next symbol
    before its suffixes, by rank, and distributes the interleave stably by them,
    which refines it by one symbol.  Where two neighbours part is then read off.
    """
    n, m = len(first), len(parts[0])
    shard = np.repeat(np.arange(len(parts)), [p.shape[1] for p in parts])
    row = np.arange(n)
    text = np.empty((m, n), np.uint64)
    for j in range(m - 1, -1, -1):
        before = np.empty(n, np.uint64)
        before[np.argsort(shard[row], kind="stable")] = np.concatenate([p[j] for p in parts])
        text[j, row] = before
        row = row[np.argsort(before, kind="stable")]
    row = row[np.argsort(first[row], kind="stable")]
    common = np.zeros(n, np.int64)
    a, b = row[:-1], row[1:]
    same = first[a] == first[b]
    diff = np.zeros(n - 1, np.uint64)
    parted = ~same
    for j in range(m):
        x = text[j, a] ^ text[j, b]
        new = ~parted & (x != 0)
        common[1:][new] = 8 * j
        diff[new] = x[new]
        parted |= new
    for k in range(1, 8):
        common[1:] += (diff > 0) & (diff < np.uint64(1 << (64 - 8 * k)))
    common[1:][same & ~parted] = 8 * m
    return row, common


def _suffixes(spread: np.ndarray):
    """Slices with their replies to (block, bucket, anchors, ids, sizes, right, left) rows: the transforms of a shard's strings from its anchors on, and back."""
    buckets = len(spread)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "bucket", "anchors", "ids", "sizes", "right", "left"]
        for batch in batches:
            for r in batch.to_pylist():
                offs, at, anchor, around = _unpacked(r)
                own_code, code = _replied(anchor, around, r["replies"])
                again = (own_code > 0) & (own_code < 4)
                first = np.zeros(len(at), bool)
                first[np.unique(around, return_index=True)[1]] = True
                some = np.flatnonzero(again & ((code == 0) | ((code == 2) & first)))
                if not len(some):
                    continue
                some = some[np.argsort(anchor[some], kind="stable")]
                data = _bytes(r)
                doc = np.searchsorted(offs, at[some], "right") - 1
                left = np.minimum(at[some] - offs[doc], LEFT)
                right = np.minimum(offs[doc + 1] - at[some], RIGHT)
                cut = _cuts(anchor[some], buckets)
                group = np.repeat(np.arange(buckets), np.diff(cut))
                ahead = transform(_symbols(_padded(data, at[some], right, RIGHT_W, 1)), group)
                behind = transform(_symbols(_padded(data, at[some] - 1, left, LEFT_W, -1)), group)
                rows = []
                for i in np.flatnonzero(np.diff(cut)):
                    own = slice(cut[i], cut[i + 1])
                    rows.append([r["block"], int(spread[i]), pack_keys(anchor[some[own]]), pack_small(2 * some[own] + (code[some[own]] > 0)), pack_small(left[own] * 256 + right[own]), ahead[:, own].tobytes(), behind[:, own].tobytes()])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64()] + [pa.binary()] * 5, strict=True)], names=names)

    return task


class _Least:
    """Minimum of a run of an array, from a table of powers of two."""

    def __init__(self, x: np.ndarray) -> None:
        self.rows = [x]
        while 2 * (1 << len(self.rows) - 1) <= len(x):
            half = 1 << len(self.rows) - 1
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """min x[lo:hi] with lo < hi."""
        k = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), np.int64)
        for p in np.unique(k):
            own = k == p
            out[own] = np.minimum(self.rows[p][lo[own]], self.rows[p][hi[own] - (1 << int(p))])
        return out


def repeated_reach(anchor: np.ndarray, right: list[np.ndarray], left: list[np.ndarray], right_n: np.ndarray, left_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the shards' transforms: for each anchored suffix, how far repeats of LENGTH bytes around it reach (left, right); 0, 0 without any."""
    n = len(anchor)
    reach_l, reach_r = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order, common = merge_transforms(right, anchor)
    common[1:] = np.minimum(common[1:], np.minimum(right_n[order[1:]], right_n[order[:-1]]))
    by_left, left_common = merge_transforms(left, anchor)
    left_common[1:] = np.minimum(left_common[1:], np.minimum(left_n[by_left[1:]], left_n[by_left[:-1]]))
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    least = _Least(left_common)

    def visit(lo: int, hi: int, depth: int) -> None:
        """An interval of suffixes that share ``depth`` bytes: the best left context of each with another."""
        if depth < GRAM:
            return
        ranks = np.sort(rank[order[lo:hi]])
        near = least.of(ranks[:-1] + 1, ranks[1:] + 1)
        best = np.maximum(np.append(near, 0), np.insert(near, 0, 0))
        ok = best + depth >= LENGTH
        rows = by_left[ranks[ok]]
        reach_l[rows] = np.maximum(reach_l[rows], best[ok])
        reach_r[rows] = np.maximum(reach_r[rows], depth)

    # The tree of intervals, from the common prefixes of neighbours.
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*common[1:].tolist(), -1]):
        lo = i
        while stack and stack[-1][1] > depth:
            lo, deep = stack.pop()
            visit(lo, i + 1, deep)
        if depth > 0 and (not stack or stack[-1][1] < depth):
            stack.append((lo, depth))
    return reach_l, reach_r


def _merged(table: pa.Table) -> pa.Table:
    """Of one bucket: merge the shards and answer each slice with its suffixes' reach."""
    rows = table.sort_by("block").to_pylist()
    anchor = np.concatenate([unpack_keys(r["anchors"]) for r in rows])
    ids = [unpack_small(r["ids"]) for r in rows]
    sizes = np.concatenate([unpack_small(r["sizes"]) for r in rows])
    right = [np.frombuffer(r["right"], np.uint64).reshape(RIGHT_W // 8, -1) for r in rows]
    left = [np.frombuffer(r["left"], np.uint64).reshape(LEFT_W // 8, -1) for r in rows]
    reach_l, reach_r = repeated_reach(anchor, right, left, sizes % 256, sizes // 256)
    out, lo = [], 0
    for r, own in zip(rows, ids, strict=True):
        hi = lo + len(own)
        new = (reach_r[lo:hi] > 0) & (own % 2 == 0)
        if new.any():
            out.append((r["block"], pack_small(own[new] // 2), pack_small(reach_l[lo:hi][new] * 256 + reach_r[lo:hi][new])))
        lo = hi
    cols = list(zip(*out, strict=True)) if out else [(), (), ()]
    return pa.table({"block": pa.array(cols[0], pa.int64()), "ids": pa.array(cols[1], pa.binary()), "reach": pa.array(cols[2], pa.binary())})


def _finish(kind: str, key: str, with_text: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                offs, at, anchor, around = _unpacked(r)
                _, code = _replied(anchor, around, r["replies"])
                doc = np.searchsorted(offs, at, "right") - 1
                whole = code > 0
                reach_l = np.where(whole, np.minimum(at - offs[doc], LEFT), 0)
                reach_r = np.where(whole, np.minimum(offs[doc + 1] - at, RIGHT), 0)
                for x in r["found"] or []:
                    own, reach = unpack_small(x["ids"]), unpack_small(x["reach"])
                    reach_l[own], reach_r[own] = reach // 256, reach % 256
                ok = reach_l + reach_r >= LENGTH
                delta = np.zeros(int(offs[-1]) + 1, np.int32)
                np.add.at(delta, at[ok] - reach_l[ok], 1)
                np.add.at(delta, at[ok] + reach_r[ok], -1)
                if r.get("strings"):
                    start, h = _hot_strings(r)
                    keys = np.unique(h)
                    again = np.concatenate([unpack_small(x["reply"]) for x in r["strings"]]) % 4 > 0
                    start = start[again[np.searchsorted(keys, h)]]
                    np.add.at(delta, start, 1)
                    np.add.at(delta, start + LENGTH, -1)
                gone = np.cumsum(delta)[:-1] > 0
                data = _bytes(r) if offs[-1] else np.zeros(0, np.uint8)
                kept = data[~gone].tobytes()
                kept_offs = np.concatenate(([0], np.cumsum(~gone)))[offs]
                start = gone.copy()
                start[1:] &= ~gone[:-1]
                inner = offs[:-1][offs[:-1] < len(gone)]
                start[inner] = gone[inner]
                spans = np.concatenate(([0], np.cumsum(start)))[offs]
                texts = [kept[kept_offs[i] : kept_offs[i + 1]] for i in range(len(offs) - 1)]
                keys = pa.ipc.open_stream(r["ids"]).read_all().column(0).combine_chunks()
                cols = [keys, pa.array(np.diff(offs)), pa.array(np.diff(offs) - np.diff(kept_offs)), pa.array(np.diff(spans)), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    cols.append(pa.array(texts, pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return task


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, kept]): documents without their repeated strings."""
    spark = docs.sparkSession
    path = scratch(spark, "repeats")
    buckets = max(8, 2 * docs.rdd.getNumPartitions())
    spread = spread_keys(spark, buckets)
    dealt = lambda df, by: df.repartition(buckets, by).groupBy(by)
    _write_blocks(docs, key, text, f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    asked = blocks.select("block", "anchor", "around").mapInArrow(_ask(spread), "block long, bucket long, part int, keys binary, counts binary")
    answered = "block long, part int, reply binary, hot boolean"
    dealt(asked, "bucket").applyInArrow(_answerer(HOT), answered).write.option("compression", "zstd").parquet(f"{path}/replies")
    replies = spark.read.parquet(f"{path}/replies")
    gathered = lambda df, name: dealt(df, "block").agg(F.array_sort(F.collect_list(F.struct("part", "reply"))).alias(name))
    answers = gathered(replies, "replies")
    blocks = blocks.repartition(buckets, "block")
    shards = blocks.drop("ids").join(answers, "block").mapInArrow(_suffixes(spread), "block long, bucket long, anchors binary, ids binary, sizes binary, right binary, left binary")
    dealt(shards, "bucket").applyInArrow(_merged, "block long, ids binary, reach binary").write.option("compression", "zstd").parquet(f"{path}/found")
    found = dealt(spark.read.parquet(f"{path}/found"), "block").agg(F.collect_list(F.struct(F.col("ids"), F.col("reach"))).alias("found"))
    ready = blocks.join(answers, "block", "left").join(found, "block", "left")
    if not replies.where("hot").isEmpty():
        strings = blocks.drop("ids").join(answers, "block").mapInArrow(_ask_strings(spread), "block long, bucket long, part int, keys binary, counts binary")
        dealt(strings, "bucket").applyInArrow(_answerer(HOT), answered).write.option("compression", "zstd").parquet(f"{path}/strings")
        ready = ready.join(gathered(spark.read.parquet(f"{path}/strings"), "strings"), "block", "left")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return ready.mapInArrow(_finish(kind, key, with_text), schema)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), with_text=False)


QUERIES = {"op3_repeats": op3_repeats}
ORACLE_SQL: dict[str, str] = {}
