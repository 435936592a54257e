"""Ranked lexical search: document-at-a-time merge of compressed postings, shard by shard.

A shard is a run of documents of at most ``SHARD_BYTES`` of text.  Its index holds, for
each term, the shard's documents in ascending order of id as variable-length gaps
with the term's occurrences, and the lengths of the documents.  Queries meet shards
through an exchange: a task takes one block of queries, then its shards one by one.
For each query it merges the postings of the query's terms by a heap of cursors, so
that a document is scored when all cursors on it are together, and keeps the best k
in a bounded heap keyed by score, then id.  That heap goes on from shard to shard.
Terms whose largest contributions cannot lift a document over the k-th best are not
merged, only looked up (which leaves the result as it is).  The tasks' results,
k rows for a query at most, are merged in two steps.

The index of all terms is built in one pass and written once; frequencies of terms
are sums over shards, joined with the queries' terms, so nothing but two totals
passes through the driver.

Defined results: a null text has no term; documents with a null id count for all
totals but are not ranked; rows that repeat an id are documents of their own; rows
that repeat an item id are one query with the terms of all; null item ids are left
out; an item without a term, or whose terms occur nowhere, returns nothing; an empty
table returns nothing; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.store import documents, written
from parley.llm.textcols import NON_ALNUM, concat_ranges, raw, slices, split_words

SHARD_BYTES = 4 << 20
#: Shards that one task streams through, and terms of the queries that it holds.
SHARDS, QUERY_TERMS = 8, 200_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each value): seven bits a byte, low first, the top bit where more follow."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        size += values >= np.uint64(1 << bits)
    ends = np.cumsum(size)
    place = np.arange(int(size.sum())) - np.repeat(ends - size, size)
    out = ((np.repeat(values, size) >> (7 * place).astype(np.uint64)) & np.uint64(127)).astype(np.uint8)
    out[place < np.repeat(size, size) - 1] |= 128
    return out, ends


def decode(data: np.ndarray) -> np.ndarray:
    """The values of ``encode``."""
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(data < 128) + 1
    starts = np.concatenate(([0], ends[:-1]))
    place = np.arange(len(data)) - np.repeat(starts, ends - starts)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


_INDEXED = "shard long, n_docs long, n_terms long, ids binary, lengths binary, terms array<string>, counts array<long>, ends array<long>, postings binary"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
_NAMES = [f.split(" ")[0] for f in _INDEXED.split(", ")]


def _index_shard(part: pa.RecordBatch) -> list:
    """Totals, documents and postings of one shard."""
    words = split_words(*raw(part.column("text")), NON_ALNUM)
    ids, n = part.column("id"), words.counts
    known = np.asarray(ids.is_valid()) & (n > 0)
    at = np.flatnonzero(known)
    at = at[np.argsort(ids.fill_null(0).to_numpy()[at], kind="stable")]
    rank = np.full(len(n), len(at), np.int64)
    rank[at] = np.arange(len(at))
    rank[~known] = len(at) + np.arange(int((~known).sum()))
    docs = max(1, len(n))
    keys, tf = np.unique(words.codes.astype(np.int64) * docs + np.repeat(rank, n), return_counts=True)
    term, doc = np.divmod(keys, docs)
    counts = np.bincount(term, minlength=len(words.vocab))
    mine = doc < len(at)
    term, doc, tf = term[mine], doc[mine], tf[mine]
    gap = np.diff(doc, prepend=-1)
    head = np.flatnonzero(np.diff(term, prepend=-1) != 0)
    gap[head] = doc[head] + 1
    postings, ends = encode(np.stack((gap, tf), 1).ravel())
    per_term = np.bincount(term, minlength=len(words.vocab)).cumsum()
    ends = np.concatenate(([0], ends))[2 * per_term]
    return [int((n > 0).sum()), int(n.sum()), ids.fill_null(0).to_numpy()[at].astype(np.int64).tobytes(), n[at].astype(np.int64).tobytes(), words.vocab.cast(pa.string()), counts, ends, postings.tobytes()]


def _indexer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = TaskContext.get().partitionId() << 32
    for part in slices(batches, "text", SHARD_BYTES):
        row = [shard, *_index_shard(part)]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _KINDS, strict=True)], names=_NAMES)
        shard += 1


def index_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each shard, written to the shared folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(_indexer, _INDEXED), "postings")


class Cursor:
    """One term's postings in a shard: documents in ascending order and what the term adds to each."""

    def __init__(self, docs: np.ndarray, adds: np.ndarray) -> None:
        self.docs, self.adds = docs.tolist(), adds.tolist()
        self.most = int(adds.max())
        self._found: dict[int, int] | None = None

    def of(self, doc: int) -> int:
        if self._found is None:
            self._found = dict(zip(self.docs, self.adds, strict=True))
        return self._found.get(doc, 0)


def merge_documents(cursors: list[Cursor], ids: list[int], top: list[tuple[int, int]], k: int) -> None:
    """Score a shard's documents in turn and keep the best k in ``top``, a heap of (score, -id).

    Cursors stand in ascending order of what they can add; those before ``first`` cannot
    together reach the k-th best, so a document is met through the others only.
    """
    cursors = sorted(cursors, key=lambda c: c.most)
    bound = list(accumulate(c.most for c in cursors))
    least, first = top[0][0] if len(top) == k else 0, 0
    while first < len(cursors) and bound[first] < least:
        first += 1
    heap = [(cursors[i].docs[0], i, 0) for i in range(first, len(cursors))]
    heapq.heapify(heap)
    while heap:
        doc, score = heap[0][0], 0
        while heap and heap[0][0] == doc:
            _, i, at = heap[0]
            cursor = cursors[i]
            score += cursor.adds[at]
            at += 1
            if at < len(cursor.docs):
                heapq.heapreplace(heap, (cursor.docs[at], i, at))
            else:
                heapq.heappop(heap)
        for i in range(first - 1, -1, -1):
            if score + bound[i] < least:
                score = 0
                break
            score += cursors[i].of(doc)
        if score <= 0 or score < least:
            continue
        entry = (score, -ids[doc])
        if len(top) < k:
            heapq.heappush(top, entry)
        elif entry > top[0]:
            heapq.heapreplace(top, entry)
        if len(top) == k and top[0][0] > least:
            least, before = top[0][0], first
            while first < len(cursors) and bound[first] < least:
                first += 1
            if first > before:
                heap = [e for e in heap if e[1] >= first]
                heapq.heapify(heap)


class _Block:
    """Queries of a task and the best documents that they have met."""

    def __init__(self, k: int, n_docs: int, n_terms: int) -> None:
        self.k, self.n_docs, self.n_terms = k, n_docs, n_terms
        self.queries: list[tuple[object, list[int]]] = []
        self.place: dict[str, int] = {}
        self.weights: list[int] = []
        self.top: list[list[tuple[int, int]]] = []

    def ask(self, item: object, terms: list[str], weights: list[int]) -> None:
        slots = []
        for term, weight in zip(terms, weights, strict=True):
            if term not in self.place:
                self.place[term] = len(self.weights)
                self.weights.append(weight)
            slots.append(self.place[term])
        self.queries.append((item, slots))
        self.top.append([])

    def search(self, ids: bytes, lengths: bytes, terms: pa.Array, ends: np.ndarray, postings: bytes) -> None:
        vocabulary = pa.array(list(self.place), pa.string())
        slot = pc.index_in(terms, value_set=vocabulary)
        asked = np.flatnonzero(np.asarray(slot.is_valid()))
        slot = slot.fill_null(0).to_numpy()[asked]
        begin = np.concatenate(([0], ends[:-1]))[asked]
        size = ends[asked] - begin
        values = np.frombuffer(postings, np.uint8)[concat_ranges(begin, size)]
        n = np.add.reduceat((values < 128).astype(np.int64), (np.cumsum(size) - size)[size > 0]) // 2 if len(values) else np.zeros(0, np.int64)
        slot = slot[size > 0]
        gap, tf = decode(values).reshape(-1, 2).T
        # Gaps add up within a term: what came before its first posting is taken off again.
        total, head = np.cumsum(gap), np.cumsum(n) - n
        doc = total - np.repeat(total[head] - gap[head], n) - 1
        length = np.frombuffer(lengths, np.int64)
        m = 100 - 50 + (50 * length * self.n_docs) // max(1, self.n_terms)
        adds = np.repeat(np.array(self.weights, np.int64)[slot], n) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        cursors = {s: Cursor(doc[lo : lo + c], adds[lo : lo + c]) for s, lo, c in zip(slot.tolist(), head.tolist(), n.tolist(), strict=True)}
        known = np.frombuffer(ids, np.int64).tolist()
        for (_, slots), top in zip(self.queries, self.top, strict=True):
            merge_documents([cursors[s] for s in slots if s in cursors], known, top, self.k)

    def rows(self) -> Iterator[tuple]:
        for (item, _), top in zip(self.queries, self.top, strict=True):
            for score, doc in top:
                yield item, -doc, score


def _searcher(k: int, n_docs: int, n_terms: int, item_type: pa.DataType):
    """Task over sorted rows: of each group the queries come first, then its shards."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None

        def found() -> pa.RecordBatch:
            columns = list(zip(*block.rows(), strict=True)) or [(), (), ()]
            kinds = (item_type, pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(arrays[0]), pa.int32()), *arrays], names=["r", "item", "id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                key = (row.column("r")[0].as_py(), row.column("s")[0].as_py())
                if key != at:
                    if block is not None:
                        yield found()
                    at, block = key, _Block(k, n_docs, n_terms)
                terms, numbers = row.column("terms").flatten(), row.column("numbers").flatten()
                if row.column("shard")[0].is_valid:
                    block.search(*(row.column(n)[0].as_py() for n in ("ids", "lengths")), terms, numbers.to_numpy(), row.column("postings")[0].as_py())
                else:
                    block.ask(row.column("item")[0].as_py(), terms.to_pylist(), numbers.to_pylist())
        if block is not None:
            yield found()

    return task


def rank_documents(index: DataFrame, queries: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(item, rank, id, score): the k documents of the index with the highest scores above 0 for each query."""
    totals = index.agg(F.sum("n_docs"), F.sum("n_terms"), F.count("*")).first()
    n_docs, n_terms, n_shards = (int(x or 0) for x in totals)
    lowered = F.translate(F.col(text_col), UPPER, LOWER)
    asked = queries.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term")).distinct()
    asked = written(asked, "asked")
    item_type = asked.schema["item"].dataType
    counts = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    df = counts.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    items = asked.join(df, "term").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", weight.alias("w")))).alias("x"))

    groups, blocks = max(1, -(-n_shards // SHARDS)), max(1, -(-asked.count() // QUERY_TERMS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = items.select(F.col("item"), F.col("x.term").alias("terms"), F.col("x.w").alias("numbers"), place("item", blocks).alias("s"), every(groups).alias("r"))
    right = index.select("shard", "terms", F.col("ends").alias("numbers"), "ids", "lengths", "postings", place("shard", groups).alias("r"), every(blocks).alias("s"))
    met = left.unionByName(right, allowMissingColumns=True).repartition(groups * blocks, "r", "s").sortWithinPartitions("r", "s", F.asc_nulls_first("shard"))
    arrow = pa.int64() if item_type.simpleString() == "bigint" else pa.int32() if item_type.simpleString() == "int" else pa.string()
    if arrow == pa.string():
        met = met.withColumn("item", F.col("item").cast("string"))
    found = met.mapInArrow(_searcher(k, n_docs, n_terms, arrow), f"r int, item {'string' if arrow == pa.string() else item_type.simpleString()}, id long, score long")
    # Two steps, so that no task merges one query's results of all groups at once.
    best = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("id")))).where(F.col("rank") <= k)
    some = best(found.withColumn("r", F.pmod("r", F.lit(64))), "item", "r").drop("rank")
    return best(some, "item").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(index_documents(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op13_lexical": op13_lexical}
ORACLE_SQL = {
    "op13_lexical": r"""
    WITH words AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
    lens AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
    totals AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM lens),
    dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
    asked AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    weighted AS (SELECT item_id, term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM asked JOIN dfs USING (term), totals),
    ms AS (SELECT doc_id, 100 - 50 + ((50 * n * nd) // nt) AS m FROM lens, totals),
    scores AS (
        SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
        FROM weighted JOIN tfs USING (term) JOIN ms USING (doc_id) GROUP BY item_id, doc_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
    """
}
