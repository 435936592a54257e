"""Approximate nearest neighbours by an inverted multi-index.

A vector is cut in two halves and each half is quantised by its own ``centroids``
codewords, so a pair of codewords names a cell.  A query walks the pairs in
ascending order of summed distance, from a heap, until the cells it has met hold
``wanted`` entries; the entries of these cells are compared exactly.

``wanted`` is not guessed.  For at most ``CALIBRATED`` queries one pass over all
rows finds the true neighbours, and ``wanted`` is the smallest number of entries
that reaches the share ``recall`` of them; where vectors have structure it is
small, where they have none it is most of the table.

The codewords are fitted to at most ``SAMPLE`` rows; every row is indexed.  Cells
lie one after the other, and runs of at most ``GROUP_BYTES`` of vectors form the
groups that tasks hold: small cells share a group, a large cell is dealt over as
many groups as it fills.  Queries form groups in the same order.  A query goes
only to the groups that hold its cells, a group of rows only to the groups of
queries that ask it.  What reaches the driver is bounded by parameters: the
sample, the true neighbours of calibrated queries, and the counts of
``centroids``^2 cells.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows with a null id; vectors of different lengths
are not compared; every other row is a candidate, so rows with repeated ids or
vectors each count, but none with the query's own id does; of queries that share an id the
smallest vector asks; equal distances go to the smaller id; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.store import written
from parley.llm.textcols import concat_ranges, mix64

#: Rows that codewords are fitted to, and queries that ``wanted`` is measured on, at most.
SAMPLE, CALIBRATED = 16_384, 128
CENTROIDS = 128
#: Bytes of vectors in a group of rows and in a group of queries.
GROUP_BYTES, QUERY_BYTES = 2 << 20, 8 << 20
ROWS = 4096


def _valid(column: str) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(column).isNotNull() & ~F.exists(column, bad) & F.exists(column, lambda x: x != 0)


def _bounded(df: DataFrame, rows: int, most: int) -> DataFrame:
    """About ``most`` of ``rows`` rows, chosen by a hash of the id; never more than twice as many."""
    if rows <= most:
        return df
    return df.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 40)) < int((1 << 40) * (most / rows))).limit(2 * most)


def _matrix(lists: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def fit_codewords(x: np.ndarray, centroids: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """Lloyd's centroids of the rows of ``x``, at most as many as there are distinct rows."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    words = distinct[np.sort(rng.permutation(len(distinct))[:centroids])]
    for _ in range(rounds if words.shape[1] else 0):
        near = squared(x, words).argmin(1)
        n = np.bincount(near, minlength=len(words))
        sums = np.stack([np.bincount(near, x[:, j], minlength=len(words)) for j in range(x.shape[1])], 1)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, in double precision up to rounding."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None], 0)


class Codebook:
    """Two sets of codewords; cells are numbered (first word) * (second words) + second word."""

    def __init__(self, sample: np.ndarray, centroids: int) -> None:
        self.half = (sample.shape[1] + 1) // 2
        self.first = fit_codewords(sample[:, : self.half], centroids)
        self.second = fit_codewords(sample[:, self.half :], centroids)

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(x[:, : self.half], self.first), squared(x[:, self.half :], self.second)

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)


def walk(a: np.ndarray, b: np.ndarray, held: np.ndarray, wanted: int) -> Iterator[int]:
    """Cells in ascending order of ``a[i] + b[j]``, ties by place, until those met hold ``wanted`` entries.

    A pair enters the heap when the pairs before it in its row and column have left it.
    """
    order_a, order_b = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    a, b = np.sort(a).tolist(), np.sort(b).tolist()
    width, height, count = len(b), len(a), held.tolist()
    heap = [(a[0] + b[0], 0, 0)]
    left = [0] * height  # columns of a row that have left the heap
    while heap and wanted > 0:
        _, i, j = heapq.heappop(heap)
        left[i] = j + 1
        cell = order_a[i] * width + order_b[j]
        if count[cell]:
            yield cell
            wanted -= count[cell]
        if j + 1 < width and (i == 0 or left[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if i + 1 < height and left[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))


def nearest(query: np.ndarray, own: int, ids: np.ndarray, v: np.ndarray, at: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest (distance, id) of the rows ``at``, without the query's own id.

    ``rough`` holds their squared distances by products and only leaves rows out; the rest is computed from the differences.
    """
    other = ids[at] != own
    at, rough = at[other], rough[other]
    if len(at) > k and np.isfinite(rough).all():
        # Rounding of the products stays far below this share of the largest.
        at = at[rough <= np.partition(rough, k - 1)[k - 1] + 1e-9 * (1 + rough.max() + query @ query)]
    far = np.sqrt(((v[at] - query) ** 2).sum(1))
    order = np.lexsort((ids[at], far))[:k]
    return far[order], at[order]


_FOUND = "query_id long, id long, score double, cell int"


def _true_neighbours(ids: np.ndarray, asked: np.ndarray, book: Codebook, k: int):
    """Task: the k nearest rows of each calibrated query among the task's rows, with their cells."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in ids]
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                rid, v = part.column(0).to_numpy(), _matrix(part.column(1), asked.shape[1])
                cell, rough, every = book.cell(v), squared(asked, v), np.arange(len(v))
                for q, own in enumerate(ids.tolist()):
                    far, at = nearest(asked[q], own, rid, v, every, rough[q], k)
                    best[q] = heapq.nsmallest(k, best[q] + list(zip(far.tolist(), rid[at].tolist(), cell[at].tolist(), strict=True)))
        rows = [(q, i, f, c) for q, found in zip(ids.tolist(), best, strict=True) for f, i, c in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int32()))], names=["query_id", "id", "score", "cell"]
        )

    return task


def _wanted(true: list, ids: np.ndarray, asked: np.ndarray, book: Codebook, held: np.ndarray, recall: float) -> int:
    """The smallest number of entries within which the share ``recall`` of the true neighbours is met."""
    cells: dict[int, list] = {}
    for row in true:
        cells.setdefault(row["query_id"], []).append(row["cell"])
    a, b = book.distances(asked)
    reached = []
    for q, own in enumerate(ids.tolist()):
        met, seen = {}, 0
        due = set(cells.get(own, ()))
        for cell in walk(a[q], b[q], held, int(held.sum())):
            # A cell is opened while fewer entries than wanted are met.
            met[cell] = seen + 1
            seen += int(held[cell])
            due.discard(cell)
            if not due:
                break
        reached += [met[c] for c in cells.get(own, ())]
    if not reached:
        return 1
    reached.sort()
    return reached[min(len(reached), int(np.ceil(recall * len(reached)))) - 1]


def _counts(df: DataFrame, cells: int) -> np.ndarray:
    """Rows of each cell: as many numbers as there are cells."""
    found = df.groupBy("cell").count().toArrow()
    out = np.zeros(cells, np.int64)
    out[found["cell"].to_numpy()] = found["count"].to_numpy()
    return out


def _coder(book: Codebook, dim: int, counts: np.ndarray | None = None, most: int = 1, name: str = "r"):
    """Task: each row's cell, and with counts its group: cells in turn, a cell over as many groups as its rows fill."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None if counts is None else np.cumsum(counts) - counts
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                cell = book.cell(_matrix(part.column(1), dim))
                if before is None:
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32())], names=["cell"])
                else:
                    spread = mix64(part.column(0).to_numpy().view(np.uint64)) % counts[cell].astype(np.uint64)
                    group = (before[cell] + spread.astype(np.int64)) // most
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(group, pa.int32())], names=["id", "v", "cell", name])

    return task


_ASKED = "s int, r int, ids binary, vectors binary, ends binary, cells binary"


def _asker(book: Codebook, held: np.ndarray, wanted: int, most: int, dim: int):
    """Task: of up to ``ROWS`` queries, a row for each group of rows that some ask, with these and the cells they ask there."""
    before = np.cumsum(held) - held

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                ids, v, group = part.column("id").to_numpy(), _matrix(part.column("v"), dim), part.column("s").to_numpy()
                a, b = book.distances(v)
                asks: dict[tuple[int, int], list] = {}
                for q in range(len(ids)):
                    some = np.sort(np.fromiter(walk(a[q], b[q], held, wanted), np.int64))
                    first, last = before[some] // most, (before[some] + held[some] - 1) // most
                    for r in np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(first, last, strict=True)])).tolist() if len(some) else ():
                        asks.setdefault((int(group[q]), r), []).append((q, some[(first <= r) & (last >= r)].astype(np.int32)))
                for (s, r), found in asks.items():
                    q = np.array([x for x, _ in found])
                    cells = [c for _, c in found]
                    row = (s, r, ids[q].tobytes(), v[q].tobytes(), np.cumsum([len(c) for c in cells]).tobytes(), np.concatenate(cells).tobytes())
                    kinds = (pa.int32(), pa.int32(), *4 * (pa.binary(),))
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["s", "r", "ids", "vectors", "ends", "cells"])

    return task


def _rerank(dim: int, cells: int, k: int):
    """Of a group of rows and a group of queries: each query's k nearest in the cells it asks."""

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        order = np.argsort(rows["cell"].to_numpy(), kind="stable")
        cell, ids = rows["cell"].to_numpy()[order], rows["id"].to_numpy()[order]
        v = _matrix(rows["v"], dim)[order] if rows.num_rows else np.zeros((0, dim))
        first, last = np.searchsorted(cell, np.arange(cells)), np.searchsorted(cell, np.arange(cells), "right")
        for block in asked.to_pylist() if rows.num_rows else ():
            own, ends, some = (np.frombuffer(block[n], t) for n, t in (("ids", np.int64), ("ends", np.int64), ("cells", np.int32)))
            queries = np.frombuffer(block["vectors"], np.float64).reshape(-1, dim)
            runs = [concat_ranges(first[c], last[c] - first[c]) for c in np.split(some, ends[:-1])]
            # Where queries ask for much of the group, one product of all is cheaper than gathering rows.
            whole = 8 * sum(len(x) for x in runs) > len(runs) * len(v)
            for q, (query, at) in enumerate(zip(queries, runs, strict=True)):
                if whole and q % 64 == 0:
                    products = squared(queries[q : q + 64], v)
                rough = products[q % 64][at] if whole else squared(query[None], v[at])[0]
                far, near = nearest(query, int(own[q]), ids, v, at, rough, k)
                out[0].extend([int(own[q])] * len(near))
                out[1].extend(ids[near].tolist())
                out[2].extend(far.tolist())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "id", "score"), out, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    return search


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _of_length(rows: DataFrame, asked: DataFrame, n: int, n_asked: int, dim: int, k: int, recall: float, centroids: int) -> DataFrame:
    sample = _matrix(_bounded(rows, n, SAMPLE).select("v").toArrow()["v"], dim)
    if not len(sample):  # the hash may leave out all of a few rows that repeat one id
        sample = _matrix(rows.limit(SAMPLE).select("v").toArrow()["v"], dim)
    book = Codebook(sample, centroids)

    held, held_asked = (_counts(df.mapInArrow(_coder(book, dim), "cell int"), book.cells) for df in (rows, asked))

    trial = _bounded(asked, n_asked, CALIBRATED).toArrow()
    ids, vectors = trial["id"].to_numpy(), _matrix(trial["v"], dim)
    true = _ranked(rows.mapInArrow(_true_neighbours(ids, vectors, book, k), _FOUND), k).collect() if len(ids) else []
    wanted = _wanted(true, ids, vectors, book, held, recall) if true else int(held.sum())

    most, most_asked = max(1, GROUP_BYTES // (8 * dim)), max(1, QUERY_BYTES // (8 * dim))
    shape = "id long, v array<double>, cell int, {} int"
    index = rows.mapInArrow(_coder(book, dim, held, most, "r"), shape.format("r"))
    asks = asked.mapInArrow(_coder(book, dim, held_asked, most_asked, "s"), shape.format("s")).repartition(-(-n_asked // 128), "id").mapInArrow(
        _asker(book, held, wanted, most, dim), _ASKED
    )
    asks = written(asks, "asks")
    met = index.join(asks.select("r", F.col("s").alias("of")).distinct(), "r").withColumnRenamed("of", "s") if n_asked > most_asked else index.withColumn("s", F.lit(0))
    cells = max(1, -(-n // most) * -(-n_asked // most_asked))
    dealt = lambda df: df.repartition(cells, "r", "s").groupBy("r", "s")
    return dealt(met).cogroup(dealt(asks)).applyInArrow(_rerank(dim, book.cells, k), "query_id long, id long, score double")


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.95, centroids: int = CENTROIDS, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows found for each query, by Euclidean distance.

    ``recall`` is the share of true neighbours that the calibrated queries reach; 1 reaches all of theirs.
    """
    take = lambda df: df.where(F.col(id_col).isNotNull() & _valid(vec_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows, asked = take(vectors), take(queries).groupBy("id").agg(F.min("v").alias("v"))
    lengths = lambda df: {r["dim"]: r["count"] for r in df.groupBy(F.size("v").alias("dim")).count().collect()}
    n, n_asked = lengths(rows), lengths(asked)
    of = lambda df, dim: df.where(F.size("v") == dim)
    found = [_of_length(of(rows, dim), of(asked, dim), n[dim], n_asked[dim], dim, k, recall, centroids) for dim in sorted(set(n) & set(n_asked))]
    all_found = found[0] if found else vectors.sparkSession.createDataFrame([], "query_id long, id long, score double")
    for more in found[1:]:
        all_found = all_found.unionByName(more)
    return _ranked(all_found, k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op11_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_neighbours(e, e.where("vec_id % 100 = 0"))


QUERIES = {"op11_multiindex": op11_multiindex}
#: A fitted index is beyond SQL: recall, order and distances are tested against brute force.
ORACLE_SQL: dict[str, str] = {}
