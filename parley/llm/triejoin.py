"""Near-duplicate groups by an exact n-gram Jaccard join with prefix trees.

1. Sets.  A document's set holds 64-bit hashes of its distinct 5-word shingles;
   documents with equal sets form a class, of which the rest sees one.
2. Order.  Shingles are ordered by how many classes hold them.  Each slice of
   documents sends its shingles by range of their hash; reducers answer with the
   counts of those that two classes share.  Shingles that a 256th of all
   documents holds are found before, are few by that bound, and skip the
   exchange, so no key gathers in one task.
3. Filter.  A partner shares three quarters of a set, so a class with fewer
   shared shingles has none.  For the others the rarest quarter of the ordered
   set is a necessary prefix; classes that meet in a prefix shingle are tied to
   the smallest of them, and the connected groups of these ties are candidates.
4. Join.  A group's sets, most frequent shingles first, go into a path-compressed
   trie.  Each set is matched against all others at once: common paths share
   their overlap, and a subtree is left when even all that remains can't reach
   the threshold, or when all of it is linked to the set already; only edges that
   are walked are read.
   A group of more than ``LARGE`` sets is thinned before, by tasks that each see a
   part of it: sets near a pivot are tied to it, and as Jaccard distance is a
   metric, only those tied sets go on that a set beyond the pivot's reach may link.
   A group of more than ``GROUP`` sets is cut into blocks by size and hash; blocks
   whose sizes allow a link meet pairwise, one task for each pair, and the links of
   all tasks are connected at the end.  So no group, however large, is one task's.

Words and shingles are compared by 64-bit keyed hashes of their bytes, equal sets
by 128 bits; a link rests on three quarters of two sets' shingles.

Defined results: null texts and texts without words have an empty set, which
links with nothing; fewer than five words are one shingle; repeated rows link;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.blobs import pack_keys, pack_small, unpack_keys, unpack_small
from parley.llm.decontaminate import _shingles as shingle_hashes
from parley.llm.graphs import components
from parley.llm.store import documents, spread_keys, written
from parley.llm.textcols import concat_ranges, hash_vocab, mix64, raw, release, slices, split_words, sums

SIZE = 5
#: Link when 100 * intersection >= 75 * union.
NUM, DEN = 75, 100
#: A shingle of so large a share of documents counts as frequent: at most SIZE-word sets / share of them exist.
FREQUENT = 256
#: Candidate groups of more than LARGE sets are thinned by pivots, ROUNDS times at most.
LARGE = 2048
ROUNDS = 4
#: Sets that one task joins, about: larger groups are cut into blocks that meet pairwise.
GROUP = 128
#: Bytes of text that are cut into shingles at once.
SLICE = 8 << 20


def document_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted within each document, offsets) of the distinct shingles."""
    w = split_words(*raw(column))
    h = hash_vocab(w.vocab)[w.codes] if len(w.codes) else np.zeros(0, np.uint64)
    n = w.counts
    full = np.maximum(n - SIZE + 1, 0)
    hashes = [shingle_hashes(h, SIZE)[concat_ranges(w.doc[:-1], full)]] if len(h) >= SIZE else [np.zeros(0, np.uint64)]
    doc = [np.repeat(np.arange(len(n)), full)] if len(h) >= SIZE else [np.zeros(0, np.int64)]
    for size in range(1, SIZE):
        short = np.flatnonzero(n == size)
        if len(short):
            hashes.append(shingle_hashes(h, size)[w.doc[short]])
            doc.append(short)
    hashes, doc = np.concatenate(hashes), np.concatenate(doc)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[keep], doc[keep]
    return hashes, np.searchsorted(doc, np.arange(len(n) + 1))


def digests(hashes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Two 64-bit sums per set, free of order: equal for equal sets."""
    out = np.zeros((len(offs) - 1, 2), np.uint64)
    with np.errstate(over="ignore"):
        for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(hashes ^ np.uint64(salt)), dtype=np.uint64)))
            out[:, k] = total[offs[1:]] - total[offs[:-1]]
    return out


def _members(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of documents (key, n, a, b) and of shingles frequent in a slice (a, n), told apart by ``kind``."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"kind int, `{key}` {kind}, n long, a long, b long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, SLICE):
            hashes, offs = document_sets(part.column(text))
            d = digests(hashes, offs).view(np.int64)
            n = np.diff(offs)
            rows = len(n)
            found, many = np.unique(hashes, return_counts=True)
            often = many >= max(8, rows / FREQUENT)
            found, many = found[often].view(np.int64), many[often]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([0, 1], [rows, len(found)]), pa.int32()),
                    pa.concat_arrays([part.column(key), pa.nulls(len(found), part.column(key).type)]),
                    pa.array(np.concatenate((n, many)), pa.int64()),
                    pa.array(np.concatenate((d[:, 0], found)), pa.int64()),
                    pa.array(np.concatenate((d[:, 1], np.zeros(len(found), np.int64))), pa.int64()),
                ],
                names=["kind", key, "n", "a", "b"],
            )

    return docs.select(key, text).mapInArrow(task, schema)


_SENT = "block long, bucket long, keys binary, owners binary, n binary, a binary, b binary, counts binary"


def _sent(docs: DataFrame, text: str, spread: np.ndarray, frequent) -> DataFrame:
    """Per slice: its distinct sets' shingles by range of hash, and (bucket < 0) the set table with its frequent ones."""
    names = ["block", "bucket", "keys", "owners", "n", "a", "b", "counts"]
    buckets = len(spread)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        hot_keys, hot_count = frequent.value
        for part in slices(batches, text, SLICE):
            hashes, offs = document_sets(part.column(text))
            d = digests(hashes, offs)
            n = np.diff(offs)
            _, first = np.unique(d, axis=0, return_index=True)
            own = np.sort(first[n[first] > 0])
            keys = hashes[concat_ranges(offs[own], n[own])]
            owner = np.repeat(np.arange(len(own)), n[own])
            table = [pack_small(n[own]), d[own, 0].tobytes(), d[own, 1].tobytes()]
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            hot = np.zeros(len(keys), bool)
            if len(hot_keys):
                k = np.minimum(np.searchsorted(hot_keys, keys), len(hot_keys) - 1)
                hot = hot_keys[k] == keys
            rows = [[block, -1 - block, pack_keys(keys[hot]), pack_small(owner[hot]), *table, pack_small(hot_count[k[hot]] if hot.any() else np.zeros(0, np.int64))]]
            keys, owner = keys[~hot], owner[~hot]
            cut = np.concatenate(([0], np.searchsorted(keys, np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)), [len(keys)]))
            for i in np.flatnonzero(np.diff(cut)):
                o = owner[cut[i] : cut[i + 1]]
                used, place = np.unique(o, return_inverse=True)
                rows.append([block, int(spread[i]), pack_keys(keys[cut[i] : cut[i + 1]]), pack_small(place), pack_small(used), d[own[used], 0].tobytes(), d[own[used], 1].tobytes(), b""])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64()] + [pa.binary()] * 6, strict=True)], names=names)
            block += 1

    return docs.select(text).mapInArrow(task, _SENT)


def _shared(table: pa.Table) -> pa.Table:
    """Of one bucket: shingles that two classes hold, to the first slice of each class, with their counts."""
    if table["bucket"][0].as_py() < 0:
        return table
    rows = table.select(["block", "keys", "owners", "n", "a", "b"]).sort_by("block").to_pylist()
    keys = [unpack_keys(r["keys"]) for r in rows]
    owners = [unpack_small(r["owners"]) for r in rows]
    used = [unpack_small(r["n"]) for r in rows]
    digest = np.stack([np.concatenate([np.frombuffer(r[c], np.uint64) for r in rows]) for c in ("a", "b")], 1)
    base = np.concatenate(([0], np.cumsum([len(u) for u in used])))
    _, first, cls = np.unique(digest, axis=0, return_index=True, return_inverse=True)
    cls = cls.reshape(-1)
    key = np.concatenate(keys)
    at = np.concatenate([base[i] + o for i, o in enumerate(owners)])
    home = first[cls[at]] == at  # a class speaks through its first slice
    key, at = key[home], at[home]
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    many = np.diff(np.append(edge, len(key)))
    count = np.repeat(many, many)
    keep = count > 1
    key, at, count = key[keep], at[keep], count[keep]
    row = np.searchsorted(base, at, "right") - 1
    local = np.concatenate(used)[at] if len(at) else at
    out = []
    for i in np.unique(row):
        own = row == i
        out.append([rows[i]["block"], table["bucket"][0].as_py(), pack_keys(key[own]), pack_small(local[own]), b"", b"", b"", pack_small(count[own])])
    cols = list(zip(*out, strict=True)) if out else [()] * 8
    release()
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64()] + [pa.binary()] * 6, strict=True)], names=table.column_names)


def _need(n: np.ndarray) -> np.ndarray:
    """The smallest overlap that a set of size n has with a partner."""
    return -(-NUM * n // DEN)


def _eligible(table: pa.Table) -> pa.Table:
    """Of one slice: its sets that share enough, ordered by (count, shingle)."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["bucket"] < 0)
    n = unpack_small(head["n"])
    a, b = np.frombuffer(head["a"], np.int64), np.frombuffer(head["b"], np.int64)
    key = np.concatenate([unpack_keys(r["keys"]) for r in rows])
    owner = np.concatenate([unpack_small(r["owners"]) for r in rows])
    count = np.concatenate([unpack_small(r["counts"]) for r in rows])
    shared = np.bincount(owner, minlength=len(n))
    ok = (shared >= _need(n)) & (n > 0)
    keep = ok[owner]
    key, owner, count = key[keep], owner[keep], count[keep]
    order = np.lexsort((key, count, owner))
    key, count = key[order], count[order]
    offs = np.concatenate(([0], np.cumsum(shared[ok])))
    some = np.flatnonzero(ok)
    return pa.table(
        {
            "a": pa.array(a[some]),
            "b": pa.array(b[some]),
            "n": pa.array(n[some]),
            "shared": pa.array(shared[some]),
            "keys": pa.array([key[offs[i] : offs[i + 1]].tobytes() for i in range(len(some))], pa.binary()),
            "counts": pa.array([pack_small(count[offs[i] : offs[i + 1]]) for i in range(len(some))], pa.binary()),
        }
    )


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, set) for the prefix of each set; its unshared shingles come first in the order."""
    for batch in batches:
        n, shared = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        take = np.minimum(np.maximum(n - _need(n) + 1 - (n - shared), 0), shared)
        keys = [np.frombuffer(x, np.int64)[:t] for x, t in zip(batch.column(3).to_pylist(), take, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), take))], names=["key", "set"])


class Trie:
    """Sets as ascending rank sequences in a path-compressed trie, held in arrays.

    The sets of a subtree are a run of the sorted sequences.  ``match`` walks the
    tree level by level for one set: nodes share the overlap of their paths, and
    leave the walk when their bound is too small or their run is linked already.
    """

    def __init__(self, seqs: list[np.ndarray], n: list[int]) -> None:
        self.order = np.array(sorted(range(len(seqs)), key=lambda i: seqs[i].astype(">u4").tobytes()), np.int64)
        self.seqs = [seqs[i] for i in self.order]
        self.n = np.array(n, np.int64)[self.order]
        self.comp = self.order.copy()  # the smallest set linked, by place in sorted order
        self._mark_changes()
        parent, depth, lo, hi, ends = [-1], [0], [0], [len(seqs)], np.zeros(len(seqs), np.int64)
        stack = [0]
        for i, s in enumerate(self.seqs):
            common = 0
            if i:
                before = self.seqs[i - 1]
                m = min(len(before), len(s))
                differ = np.flatnonzero(before[:m] != s[:m])
                common = int(differ[0]) if len(differ) else m
            last = -1
            while depth[stack[-1]] > common:
                last = stack.pop()
                hi[last] = i
            if depth[stack[-1]] < common:  # the path parts inside an edge
                parent.append(stack[-1])
                depth.append(common)
                lo.append(lo[last])
                hi.append(-1)
                parent[last] = len(depth) - 1
                stack.append(parent[last])
            if len(s) > common:
                parent.append(stack[-1])
                depth.append(len(s))
                lo.append(i)
                hi.append(-1)
                stack.append(len(depth) - 1)
            ends[i] = stack[-1]
        for node in stack:
            hi[node] = len(seqs)
        self.lo, self.hi = np.array(lo), np.array(hi)
        depth, parent = np.array(depth), np.array(parent)
        edges = [self.seqs[a][d:e] for a, d, e in zip(lo[1:], depth[parent[1:]], depth[1:], strict=True)]
        self.tokens = np.concatenate([np.zeros(0, np.int64), *edges])
        self.edge = np.concatenate(([0, 0], np.cumsum([len(e) for e in edges]))).astype(np.int64)
        self.last = np.array([-1] + [int(e[-1]) for e in edges])
        size = np.array([len(s) for s in self.seqs])
        self.least_n = np.array([self.n[a:b].min(initial=1 << 60) for a, b in zip(lo, hi, strict=True)])
        self.most = np.array([size[a:b].max(initial=0) for a, b in zip(lo, hi, strict=True)]) - depth
        self.child = np.argsort(parent[1:], kind="stable") + 1
        self.child_at = np.searchsorted(parent[self.child], np.arange(len(depth) + 1))
        self.ending = np.argsort(ends, kind="stable")
        self.ending_at = np.searchsorted(ends[self.ending], np.arange(len(depth) + 1))

    def match(self, x: int, inside: np.ndarray) -> None:
        """Link the x-th sorted set with every set of another component that is near enough; only edges that are walked are read."""
        seq, nx, own = self.seqs[x], self.n[x], self.comp[x]
        inside[seq] = 1
        node, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        found = []
        while len(node):
            linked = (self.changes[self.hi[node] - 1] == self.changes[self.lo[node]]) & (self.comp[self.lo[node]] == own)
            left = len(seq) - np.searchsorted(seq, self.last[node], "right")
            can = (NUM + DEN) * (overlap + np.minimum(left, self.most[node])) >= NUM * (nx + self.least_n[node])
            node, overlap = node[can & ~linked], overlap[can & ~linked]
            many = self.ending_at[node + 1] - self.ending_at[node]
            sets = self.ending[concat_ranges(self.ending_at[node], many)]
            near = (NUM + DEN) * np.repeat(overlap, many) >= NUM * (nx + self.n[sets])
            found.append(sets[near])
            many = self.child_at[node + 1] - self.child_at[node]
            below = self.child[concat_ranges(self.child_at[node], many)]
            size = self.edge[below + 1] - self.edge[below]
            shared = sums(inside[self.tokens[concat_ranges(self.edge[below], size)]], np.concatenate(([0], np.cumsum(size))))
            node, overlap = below, np.repeat(overlap, many) + shared
        inside[seq] = 0
        tops = np.unique(np.append(self.comp[np.concatenate(found)], own))
        if len(tops) > 1:
            self.comp[np.isin(self.comp, tops)] = tops[0]
            self._mark_changes()

    def _mark_changes(self) -> None:
        """Running number of changes of component along the sorted sets: equal at two places where all between are of one."""
        self.changes = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.comp[1:] != self.comp[:-1])))

    def join(self) -> np.ndarray:
        """For each set the smallest set (by place given) that links reach."""
        ranks = 1 + max((int(s[-1]) for s in self.seqs if len(s)), default=0)
        inside = np.zeros(ranks, np.int64)
        for x in range(len(self.seqs)):
            if (self.comp == self.comp[0]).all():
                break
            self.match(x, inside)
        out = np.empty(len(self.seqs), np.int64)
        out[self.order] = self.comp
        return out


def _joined(table: pa.Table) -> pa.Table:
    """Components among the candidate sets of one group; a component is named by its smallest set."""
    table = table.sort_by("set")
    ids = table["set"].to_numpy()
    keys = [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()]
    counts = [unpack_small(x) for x in table["counts"].to_pylist()]
    flat, count = np.concatenate(keys), np.concatenate(counts)
    found, first, place = np.unique(flat, return_index=True, return_inverse=True)
    # Most frequent first, so that paths are shared.
    rank = np.empty(len(found), np.int64)
    rank[np.lexsort((found, -count[first]))] = np.arange(len(found))
    flat = rank[place.reshape(-1)]
    cut = np.cumsum([len(k) for k in keys])[:-1]
    trie = Trie([np.sort(s) for s in np.split(flat, cut)], table["n"].to_pylist())
    return pa.table({"set": table["set"], "top": pa.array(ids[trie.join()], pa.int64())})


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, component, pivot, distance to the pivot, whether they link), of rows with both sets' shingles."""
    for batch in batches:
        rows = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        n, m = rows["n"].to_numpy(), rows["pivot_n"].to_numpy()
        both = np.zeros(len(n), np.int64)
        last, held = None, np.zeros(0, np.uint64)
        for i, (keys, other) in enumerate(zip(rows["keys"].to_pylist(), rows["pivot_keys"].to_pylist(), strict=True)):
            if other is not last and other != last:
                last, held = other, np.sort(np.frombuffer(other, np.uint64))
            own = np.frombuffer(keys, np.uint64)
            at = np.minimum(np.searchsorted(held, own), max(0, len(held) - 1))
            both[i] = int((held[at] == own).sum()) if len(held) else 0
        far = 1 - both / (n + m - both)
        linked = (NUM + DEN) * both >= NUM * (n + m)
        yield pa.RecordBatch.from_arrays([rows["set"], rows["component"], rows["pivot"], pa.array(far), pa.array(linked)], names=["set", "component", "pivot", "far", "linked"])


def _thinned(grouped: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(groups to join, ties found on the way): the bulk of a large group is tied to pivots, which leaves less to join.

    Exact: what goes on is every set that may link with one that is not tied yet.
    """
    ties = None
    for _ in range(ROUNDS):
        big = grouped.groupBy("component").agg(F.count("*").alias("__many"), F.min_by(F.struct(F.col("set").alias("pivot"), F.col("n").alias("pivot_n"), F.col("keys").alias("pivot_keys")), "set").alias("p")).where(F.col("__many") > LARGE)
        big = written(big.select("component", "p.*"), "pivots")
        if big.isEmpty():
            break
        seen = written(grouped.join(big, "component").select("set", "component", "n", "keys", "pivot", "pivot_n", "pivot_keys").mapInArrow(_distances, "set long, component long, pivot long, far double, linked boolean"), "distances")
        found = seen.where("linked AND set <> pivot").select(F.col("set").alias("src"), F.col("pivot").alias("dst"))
        ties = found if ties is None else ties.unionByName(found)
        beyond = seen.where("NOT linked").groupBy("component").agg(F.min("far").alias("least"))
        # A set y beyond reach links a tied x only if their distances to the pivot differ by a quarter at most.
        again = seen.join(beyond, "component").where((F.col("set") != F.col("pivot")) & (~F.col("linked") | (F.col("far") >= F.col("least") - (1 - NUM / DEN) - 1e-9))).select("set")
        small = grouped.join(big.select("component"), "component", "left_anti")
        grouped = written(small.unionByName(grouped.join(again, "set", "left_semi").select(small.columns)), "grouped")
    return grouped, ties


def _cells(grouped: DataFrame) -> DataFrame:
    """The sets of groups, dealt to cells: a small group is one cell, a large one is cut into blocks that meet pairwise.

    Blocks hold about ``GROUP`` sets of a band of sizes.  Sets that link differ in
    size by a third at most, so a block meets those of its own band and of the next.
    """
    members = grouped.select("set", "n", "component")
    whole = members.groupBy("component").agg(F.count("*").alias("__many"))
    banded = members.join(whole, "component").withColumn("band", F.when(F.col("__many") > GROUP, F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM)) + 1e-9)).otherwise(F.lit(0)).cast("long")).drop("__many")
    sizes = banded.groupBy("component", "band").agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("blocks"))
    above = sizes.select("component", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = sizes.select("component", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    plan = sizes.join(above, ["component", "band"], "left").join(below, ["component", "band"], "left")
    # A group of one small band keeps one cell.
    placed = banded.join(plan, ["component", "band"]).withColumn("at", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    number = lambda n: F.when(n.isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1))
    cell = lambda band, i, j, kind: F.struct(band.alias("band"), i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"))
    own = F.transform(number(F.col("blocks")), lambda j: cell(F.col("band"), F.least("at", j), F.greatest("at", j), 0))
    up = F.transform(number(F.col("above")), lambda j: cell(F.col("band"), F.col("at"), j, 1))
    down = F.transform(number(F.col("below")), lambda j: cell(F.col("band") - 1, j, F.col("at"), 1))
    # Only numbers were dealt so far; the sets themselves meet their cells by set, which no group can skew.
    dealt = placed.select("set", "component", F.explode(F.concat(own, up, down)).alias("at")).select("set", F.struct("component", "at").alias("cell"))
    return dealt.join(grouped.select("set", "n", "keys", "counts"), "set")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id): the smallest key among all that links reach."""
    spark = docs.sparkSession
    # Ranges of the hash space: three for each input partition, so that a reducer holds a third of one's shingles.
    parts = max(8, 3 * docs.rdd.getNumPartitions())
    seen = written(_members(docs, key, text), "members")
    members = seen.where("kind = 0").drop("kind")
    total = members.count()
    frequent = seen.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= max(16, total / FREQUENT))
    # At most FREQUENT times the mean set size rows: a bound that holds at every scale.
    hot = frequent.toArrow()
    hot_keys = hot["a"].to_numpy().view(np.uint64)
    order = np.argsort(hot_keys)
    sent = spark.sparkContext.broadcast((hot_keys[order], hot["n"].to_numpy()[order]))
    spread = spread_keys(spark, parts)
    replies = _sent(docs, text, spread, sent).repartition(parts, "bucket").groupBy("bucket").applyInArrow(_shared, _SENT)
    classes = replies.repartition(parts, "block").groupBy("block").applyInArrow(_eligible, "a long, b long, n long, shared long, keys binary, counts binary")
    best = classes.groupBy("a", "b", "n").agg(F.max_by(F.struct("shared", "keys", "counts"), "shared").alias("s"))
    sets = written(best.select(F.monotonically_increasing_id().alias("set"), "a", "b", "n", "s.*"), "sets")
    prefix = sets.select("set", "n", "shared", "keys").mapInArrow(_prefixes, "key long, set long")
    prefix = written(prefix, "prefixes")
    centre = prefix.groupBy("key").agg(F.min("set").alias("centre"), F.count("*").alias("many")).where("many > 1")
    ties = prefix.join(centre, "key").where("set <> centre").select(F.col("set").alias("src"), F.col("centre").alias("dst")).distinct()
    groups = components(ties)
    grouped = written(sets.join(groups, sets.set == groups.node).select("set", "n", "keys", "counts", "component"), "grouped")
    grouped, ties = _thinned(grouped)
    links = _cells(grouped).groupBy("cell").applyInArrow(_joined, "set long, top long").select(F.col("set").alias("src"), F.col("top").alias("dst"))
    links = written(links.where("src <> dst"), "links")
    tops = components(links if ties is None else links.unionByName(ties)).select(F.col("node").alias("set"), F.col("component").alias("top"))
    tops = written(tops, "tops")
    # Smallest key of a class, then of a component of classes.
    least = members.where("n > 0").groupBy("a", "b", "n").agg(F.min(key).alias("least"))
    linked = sets.join(tops, "set").select("a", "b", "n", "top").join(least, ["a", "b", "n"])
    of_top = linked.groupBy("top").agg(F.min("least").alias("low"))
    named = least.join(linked.select("a", "b", "n", "top"), ["a", "b", "n"], "left").join(of_top, "top", "left").select("a", "b", "n", F.coalesce("low", "least").alias("low"))
    out = members.join(named, ["a", "b", "n"], "left")
    return out.select(key, F.col("n").alias("n_shingles"), F.coalesce("low", key).alias("component_id"))


def op8_triejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op8_triejoin": op8_triejoin}
_WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE_SQL = {
    "op8_triejoin": f"""
    WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, coalesce({_WORDS_SQL}, []) AS w FROM documents),
    s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
          ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS g FROM w),
    n AS MATERIALIZED (SELECT doc_id, len(g) AS n FROM s),
    e AS MATERIALIZED (SELECT doc_id, unnest(g) AS h FROM s),
    o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS MATERIALIZED (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    r AS (SELECT doc_id AS d, doc_id AS t FROM n UNION SELECT r.d, l.b FROM r JOIN l ON l.a = r.t)
    SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.t) AS component_id FROM n JOIN r ON r.d = n.doc_id GROUP BY n.doc_id, n.n
    """
}
