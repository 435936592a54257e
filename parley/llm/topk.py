"""Exact top-k search by multi-resolution segment statistics.

Vectors are cut into equal segments; of each segment only its mean and deviation
(the norm around the mean) are kept.  By Cauchy-Schwarz the inner product of two
vectors is at most the sum over segments of ``s * mean * mean' + dev * dev'``;
for equal norms that is a lower bound of their distance.  Bounds go from coarse
(one segment) to fine; a candidate is left out as soon as its bound is under the
query's k-th best so far, and the exact integer product is computed for what is
left: by matrix products where most pairs are left, pair by pair where few are.
Tasks pack candidates and queries into blocks; groups of about ``CANDIDATE_BYTES``
and ``QUERY_BYTES`` meet pairwise through an exchange, one task for each pair of
groups, which returns k rows for a query at most.  So each candidate is sent once
for every group of queries.  Nothing of the tables passes through the driver.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part; vectors of different lengths are not compared; repeated
vectors are separate candidates; ties go to the smaller id; rows with a null id
take no part; an empty table gives no rows; other columns are ignored.
A scaled component beyond 2^31 in size makes the products Python integers, and a
score that leaves the range of a long is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Mean bytes of a group of queries and of candidates; a vector counts with ``OVER`` bytes besides its components.
#: A group's bytes come in ``BLOCKS`` blocks or more, which fall on groups by a hash: a group of more than about twice the mean is rare.
QUERY_BYTES, CANDIDATE_BYTES, OVER, BLOCKS = 8 << 20, 64 << 20, 512, 32
#: Pairs that a task holds bounds and products of at once.
PAIRS = 1 << 20


def _valid(column: str) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~F.exists(column, bad)


def _levels(dim: int) -> list[int]:
    """Segment counts from coarse to fine that divide the length."""
    return [n for n in (1, 4, 16) if dim % n == 0 and dim // n > 1] or [1]


def _statistics(v: np.ndarray, level: int) -> np.ndarray:
    """Rows of (sqrt(s) * mean, deviation) per segment: their products bound the inner product."""
    parts = v.reshape(len(v), level, -1)
    mean = parts.mean(2)
    dev = np.sqrt(((parts - mean[:, :, None]) ** 2).sum(2))
    return np.concatenate((mean * np.sqrt(parts.shape[2]), dev), 1)


def _exact(q: np.ndarray, v: np.ndarray, qi: np.ndarray, vi: np.ndarray, wide: bool) -> np.ndarray:
    if wide:
        return np.array([sum(int(a) * int(b) for a, b in zip(q[i], v[j], strict=True)) for i, j in zip(qi, vi, strict=True)], dtype=object)
    return np.einsum("ij,ij->i", q[qi].astype(np.int64), v[vi].astype(np.int64))


class Searcher:
    """Top k of the rows that have streamed by, for a block of queries of one length."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, q, k
        self.best = np.full(len(ids), -np.inf)
        self.score: list[list] = [[] for _ in ids]
        self.levels = _levels(q.shape[1])
        self.stats = [_statistics(q, n) for n in self.levels]
        self.most = float(np.abs(q).max(initial=0))

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        most = max(self.most, float(np.abs(v).max(initial=0)))
        # Rounding of the bounds stays far below this share of the largest product.
        slack = 1 + 1e-9 * most * most * v.shape[1]
        stats = [_statistics(v, n) for n in self.levels]
        rows = max(1, PAIRS // max(1, len(ids)))
        for lo in range(0, len(self.ids), rows):
            part = slice(lo, lo + rows)
            # Queries without a bound take one from a few exact products; the other candidates then meet it.
            first = 0 if np.isfinite(self.best[part]).all() else min(len(ids), 8 * self.k)
            for at in (slice(0, first), slice(first, len(ids))):
                if at.start < at.stop:
                    self._meet(part, ids[at], v[at], [t[at] for t in stats], most, slack)

    def _meet(self, part: slice, ids: np.ndarray, v: np.ndarray, stats: list[np.ndarray], most: float, slack: float) -> None:
        """Bounds from coarse to fine over a matrix of pairs, over single pairs once few are left; then exact products."""
        best, size = self.best[part], most * most * v.shape[1]
        alive = self.ids[part][:, None] != ids
        pairs = None
        for s, t in zip(self.stats, stats, strict=True):
            if pairs is None:
                alive &= s[part] @ t.T + slack >= best[:, None]
                pairs = np.nonzero(alive) if np.count_nonzero(alive) * 32 < alive.size else None
            else:
                qi, vi = pairs
                keep = np.einsum("ij,ij->i", s[part][qi], t[vi]) + slack >= best[qi]
                pairs = qi[keep], vi[keep]
        if pairs is None and size < 2**53:
            # Every partial sum is an integer that a double holds, so the matrix product is exact.
            product = self.q[part] @ v.T
            alive &= product >= best[:, None]
            if len(ids) > self.k and np.count_nonzero(alive) > 4 * self.k * len(alive):
                product[~alive] = -np.inf
                alive &= product >= np.partition(product, -self.k, axis=1)[:, -self.k, None]
            qi, vi = np.nonzero(alive)
            self._merge(qi + part.start, ids[vi], product[qi, vi].astype(np.int64))
            return
        qi, vi = np.nonzero(alive) if pairs is None else pairs
        for lo in range(0, len(qi), 1 << 16):
            i, j = qi[lo : lo + (1 << 16)] + part.start, vi[lo : lo + (1 << 16)]
            self._merge(i, ids[j], _exact(self.q, v, i, j, most >= 2**31 or size >= 2**62))

    def _merge(self, qi: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        keep = (score >= self.best[qi]).astype(bool)
        qi, ids, score = qi[keep], ids[keep], score[keep]
        order = np.lexsort((ids, -score, qi)) if score.dtype != object else np.array(sorted(range(len(qi)), key=lambda i: (qi[i], -score[i], ids[i])), int)
        qi, ids, score = qi[order], ids[order], score[order]
        first = np.flatnonzero(np.diff(qi, prepend=-1))
        last = np.append(first[1:], len(qi))
        for i, lo, hi in zip(qi[first].tolist(), first.tolist(), np.minimum(last, first + self.k).tolist(), strict=True):
            new = [(-int(s), int(d)) for s, d in zip(score[lo:hi].tolist(), ids[lo:hi].tolist(), strict=True)]
            top = sorted(self.score[i] + new)[: self.k]
            self.score[i] = top
            if len(top) == self.k:
                worst = float(-top[-1][0])
                # Beyond 2^53 a double may lie above the integer: the bound steps down.
                self.best[i] = worst if abs(worst) < 2**53 else np.nextafter(worst, -np.inf)

    def result(self) -> Iterator[tuple[int, int, int]]:
        for q, top in zip(self.ids.tolist(), self.score, strict=True):
            for s, d in top:
                yield q, d, -s


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, scaled vectors) by length of the vectors."""
    lists = batch.column(1)
    size = np.asarray(lists.value_lengths())
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        some = lists.take(pa.array(rows))
        flat = some.flatten().to_numpy(zero_copy_only=False).astype(float)
        yield batch.column(0).take(pa.array(rows)).to_numpy(zero_copy_only=False), np.floor(1024.0 * flat).reshape(len(rows), int(dim))


#: Rows of an Arrow batch that are scaled at once.
ROWS = 1024
_BLOCK = "block long, dim int, ids binary, data binary"


def _blocks(most: int):
    """Task that turns (id, vector) rows into rows of blocks: at most about ``most`` bytes of vectors of one length."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                for ids, v in _matrices(batch.slice(lo, ROWS)):
                    step = max(1, most // (8 * v.shape[1] + OVER))
                    for at in range(0, len(ids), step):
                        row = [block, v.shape[1], ids[at : at + step].astype(np.int64).tobytes(), v[at : at + step].tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "dim", "ids", "data"])
                        block += 1

    return task


def _unblocked(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of one block after another, without a copy."""
    for dim, ids, data in zip(table["dim"], table["ids"], table["data"], strict=True):
        yield np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(data.as_buffer(), np.float64).reshape(-1, dim.as_py())


def _cell(id_col: str, k: int):
    """Of one group of queries and one of candidates: the best k of each query."""

    def search(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        by_dim: dict[int, list] = {}
        for ids, q in _unblocked(asked):
            by_dim.setdefault(q.shape[1], []).append((ids, q))
        own = {dim: Searcher(np.concatenate([i for i, _ in parts]), np.concatenate([q for _, q in parts]), k) for dim, parts in by_dim.items()}
        for ids, v in _unblocked(candidates):
            if v.shape[1] in own:
                own[v.shape[1]].add(ids, v)
        found = list(zip(*(r for x in own.values() for r in x.result()), strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", id_col, "score"), found, strict=True)})

    return search


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): each query's k largest integer inner products with other rows."""
    wanted = F.col(id_col).isNotNull() & _valid(vec_col)
    rows = vectors.where(wanted).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    asked = queries.where(wanted).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    held = lambda df: int(df.agg(F.sum(F.size("v") * 8 + OVER)).first()[0] or 0)
    query_groups = max(1, -(-held(asked) // QUERY_BYTES))
    groups = max(1, rows.rdd.getNumPartitions(), -(-held(rows) // CANDIDATE_BYTES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    left = rows.mapInArrow(_blocks(CANDIDATE_BYTES // BLOCKS), _BLOCK).select(place(groups).alias("r"), every(query_groups).alias("s"), "dim", "ids", "data")
    right = asked.mapInArrow(_blocks(QUERY_BYTES // BLOCKS), _BLOCK).select(every(groups).alias("r"), place(query_groups).alias("s"), "dim", "ids", "data")
    cells = groups * query_groups
    dealt = lambda df: df.repartition(cells, "r", "s").groupBy("r", "s")
    out = dealt(left).cogroup(dealt(right)).applyInArrow(_cell(id_col, k), f"query_id long, `{id_col}` long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_top_k(e, e.where("vec_id % 100 = 0"))


QUERIES = {"op10_topk": op10_topk}
ORACLE_SQL = {
    "op10_topk": """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """
}
