"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of 13 words (a shorter item is one window).  A
window is the ordered set of its word shingles; containment means that all of
them occur, so one shingle, the rarest of the corpus, is its necessary prefix:
documents that lack it cannot hold the window.  The rarity order counts shingles
over all documents.  A document position with a prefix shingle gives a candidate
by the shingle's place in the window; length and position bounds keep it inside
the document; then the item-sized window is compared, word by word and byte by
byte.

The windows travel to the tasks in blocks of at most ``BLOCK_BYTES``, a size that
is measured before; documents pass twice per block (for the rarity order, and to
be marked) and are never shuffled.

Defined results: null or empty texts have no words; a null item id can hit words
but is not listed; repeated items count once; repeated documents are judged each
by itself; a word of any length is one word; empty tables give no hits; other
columns are carried along untouched, but the added names must be free, else a
ValueError says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.store import documents
from parley.llm.textcols import NON_ALNUM, Words, append_columns, concat_ranges, hash_vocab, raw, slices, split_words, sums

WINDOW = 13
SHINGLE = 3
#: Most bytes of windows that are broadcast at once.
BLOCK_BYTES = 64 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_windows(items: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """(words as one string, n, sorted item ids as strings): each distinct window once."""
    words = items.select(F.col(key).cast("string").alias("item"), F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    cut = words.select("item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, window))).alias("w"))
    return cut.select("item", F.array_join("w", " ").alias("words"), F.size("w").alias("n")).groupBy("words", "n").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _shingles(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position that has so many after it."""
    n = max(0, len(word_hash) - size + 1)
    out = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ word_hash[k : k + n]) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
            out ^= out >> np.uint64(29)
    return out


class _Lookup:
    """Positions of hashes that are in a sorted set, by a bit filter first."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.unique(keys)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``hashes``, index in ``keys``) of those that are there."""
        at = np.flatnonzero(self.bits[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(self.keys) or not len(at):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        ok = self.keys[k] == hashes[at]
        return at[ok], k[ok]


class WindowIndex:
    """Windows of one block with their prefix shingles."""

    def __init__(self, rows: list) -> None:
        self.items = sorted({i for r in rows for i in r["items"]})
        place = {x: i for i, x in enumerate(self.items)}
        self.n = np.array([r["n"] for r in rows], np.int64)
        w = split_words(*raw(pa.array([r["words"] for r in rows], pa.large_string())), NON_ALNUM)
        hashes = hash_vocab(w.vocab)[w.codes]
        self.vocab, self.codes = w.vocab, w.codes
        self.code_at = np.concatenate(([0], np.cumsum(self.n)))
        self.words = np.zeros((len(rows), int(self.n.max(initial=1))), np.uint64)
        self.words[np.repeat(np.arange(len(rows)), self.n), concat_ranges(np.zeros(len(rows), np.int64), self.n)] = hashes
        self.item_of = np.array([place[i] for r in rows for i in r["items"]], np.int64)
        self.item_off = np.concatenate(([0], np.cumsum([len(r["items"]) for r in rows])))
        self.size = np.minimum(self.n, SHINGLE)
        #: (size, window, place in the window, hash) of every shingle.
        self.parts = {}
        for size in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == size)
            win, at, h = [], [], []
            for p in range(int(self.n[own].max()) - size + 1):
                fit = own[self.n[own] >= p + size]
                win.append(fit)
                at.append(np.full(len(fit), p))
                rows_h = self.words[fit, p : p + size]
                h.append(_shingles_of_rows(rows_h))
            self.parts[size] = (np.concatenate(win), np.concatenate(at), np.concatenate(h))
        self.all = {size: _Lookup(h) for size, (_, _, h) in self.parts.items()}
        self.prefix: dict = {}

    def order(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Take each window's rarest shingle (ties: smaller hash) as its prefix; ``counts`` has sorted hashes and their counts by size."""
        for size, (win, at, h) in self.parts.items():
            seen, many = counts.get(size, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            df = np.zeros(len(h), np.int64)
            if len(seen):
                k = np.minimum(np.searchsorted(seen, h), len(seen) - 1)
                df = np.where(seen[k] == h, many[k], 0)
            first = np.lexsort((at, h, df, win))
            first = first[np.unique(win[first], return_index=True)[1]]
            by = first[np.argsort(h[first], kind="stable")]
            look = _Lookup(h[by])
            lo = np.searchsorted(h[by], look.keys)
            hi = np.searchsorted(h[by], look.keys, "right")
            self.prefix[size] = (look, lo, hi - lo, win[by], at[by])

    def matches(self, w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence of a window in the documents."""
        starts, wins = [], []
        for size, (look, lo, many, win, place) in self.prefix.items():
            at, k = look.find(_shingles(hashes, size))
            pick = concat_ranges(lo[k], many[k])
            at = np.repeat(at, many[k])
            start, cand = at - place[pick], win[pick]
            doc = np.searchsorted(w.doc, at, "right") - 1
            ok = (start >= w.doc[doc]) & (start + self.n[cand] <= w.doc[doc + 1])
            start, cand = start[ok], cand[ok]
            for j in range(self.words.shape[1]):
                short = self.n[cand] <= j
                same = short | (hashes[np.minimum(start + j, len(hashes) - 1)] == self.words[cand, j])
                start, cand = start[same], cand[same]
            same = self._equal(w, start, cand)
            start, cand = start[same], cand[same]
            starts.append(start)
            wins.append(cand)
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(wins)


    def _equal(self, w: Words, start: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Whether the words from ``start`` on are those of the window, by their bytes: each pair of words is compared once."""
        n = self.n[cand]
        pair = w.codes[concat_ranges(start, n)].astype(np.int64) * max(1, len(self.vocab)) + self.codes[concat_ranges(self.code_at[cand], n)]
        each, place = np.unique(pair, return_inverse=True)
        mine, other = np.divmod(each, max(1, len(self.vocab)))
        ok = pc.equal(w.vocab.take(pa.array(mine)), self.vocab.take(pa.array(other))).to_numpy(zero_copy_only=False).astype(bool)
        return sums(~ok[place.reshape(-1)], np.concatenate(([0], np.cumsum(n)))) == 0


def _shingles_of_rows(rows: np.ndarray) -> np.ndarray:
    out = np.full(len(rows), rows.shape[1], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            out = (out ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
            out ^= out >> np.uint64(29)
    return out


def _words(part: pa.RecordBatch, text: str) -> tuple[Words, np.ndarray]:
    w = split_words(*raw(part.column(text)), NON_ALNUM)
    return w, hash_vocab(w.vocab)[w.codes]


def _frequencies(docs: DataFrame, text: str, sent) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """How often each shingle of the block's windows occurs in all documents: at most a row per shingle of the block comes back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        count = {size: np.zeros(len(look.keys), np.int64) for size, look in index.all.items()}
        for part in slices(batches, text):
            _, hashes = _words(part, text)
            for size, look in index.all.items():
                _, k = look.find(_shingles(hashes, size))
                count[size] += np.bincount(k, minlength=len(look.keys))
        for size, look in index.all.items():
            some = np.flatnonzero(count[size])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), size), pa.int32()), pa.array(look.keys[some].view(np.int64)), pa.array(count[size][some])], names=["size", "h", "n"])

    got = docs.select(text).mapInArrow(task, "size int, h long, n long").groupBy("size", "h").agg(F.sum("n").alias("n")).toArrow()
    size, h, n = (got.column(i).to_numpy() for i in range(3))
    found = {}
    for s in np.unique(size).tolist():
        own = np.flatnonzero(size == s)
        own = own[np.argsort(h[own].view(np.uint64))]
        found[s] = h[own].view(np.uint64), n[own]
    return found


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", prefix: str = "bench_") -> DataFrame:
    """``docs`` with <prefix>n_words, <prefix>spans (word ranges that are hit) and <prefix>items (sorted ids)."""
    spark = docs.sparkSession
    windows = item_windows(items, item_key, item_text)
    size, n = windows.agg(F.coalesce(F.sum(F.length("words") * 2 + 400), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    names = [f"{prefix}{x}" for x in ("n_words", "spans", "items")]
    if taken := {c.lower() for c in docs.columns} & set(map(str.lower, names)):
        raise ValueError(f"the table has columns named {sorted(taken)}")
    out = docs.withColumns({names[0]: F.lit(0).cast("long"), names[1]: F.array().cast(_SPANS), names[2]: F.array().cast("array<string>")})
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], _SPANS), T.StructField(names[2], T.ArrayType(T.StringType()))])
    for b in range(blocks):
        block = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b)
        rows = [r.asDict() for r in block.toLocalIterator()]
        index = WindowIndex(rows) if rows else None
        if index is not None:
            sent = spark.sparkContext.broadcast(index)
            index.order(_frequencies(docs, text, sent))
        ready = spark.sparkContext.broadcast(index)

        def task(batches: Iterator[pa.RecordBatch], ready=ready) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text):
                yield _mark(part, text, names, ready.value)

        out = out.mapInArrow(task, schema)
    return out


def _mark(part: pa.RecordBatch, text: str, names: list[str], index: WindowIndex | None) -> pa.RecordBatch:
    w, hashes = _words(part, text)
    rows, total = part.num_rows, len(w.codes)
    delta = np.zeros(total + 1, np.int64)
    for i, spans in enumerate(part.column(names[1]).to_pylist()):  # hits of earlier blocks
        for s in spans:
            delta[w.doc[i] + s["start"]] += 1
            delta[w.doc[i] + s["end"]] -= 1
    listed = part.column(names[2]).to_pylist()
    if index is not None:
        start, win = index.matches(w, hashes)
        np.add.at(delta, start, 1)
        np.add.at(delta, start + index.n[win], -1)
        doc = np.searchsorted(w.doc, start, "right") - 1
        many = index.item_off[win + 1] - index.item_off[win]
        pairs = np.unique(np.repeat(doc, many) * max(1, len(index.items)) + index.item_of[concat_ranges(index.item_off[win], many)])
        for p in pairs.tolist():
            i, k = divmod(p, len(index.items))
            listed[i].append(index.items[k])
    hit = np.cumsum(delta)[:total] > 0
    edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
    # A run of hits that crosses into the next document is parted there.
    inner = w.doc[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < total)])
    inner = inner[hit[inner] & hit[inner - 1]]
    begins = np.sort(np.concatenate((np.flatnonzero(edge == 1), inner)))
    ends = np.sort(np.concatenate((np.flatnonzero(edge == -1), inner)))
    doc = np.searchsorted(w.doc, begins, "right") - 1
    many = np.bincount(doc, minlength=rows) if len(doc) else np.zeros(rows, np.int64)
    spans = pa.StructArray.from_arrays([pa.array(begins - w.doc[doc], pa.int64()), pa.array(ends - w.doc[doc], pa.int64())], names=["start", "end"])
    made = [pa.array(w.counts, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32()), spans), pa.array([sorted(set(x)) for x in listed], pa.list_(pa.string()))]
    keep = [c for c, n in zip(part.columns, part.schema.names, strict=True) if n not in names]
    return pa.RecordBatch.from_arrays([*keep, *made], names=[n for n in part.schema.names if n not in names] + names)


def n_hit(prefix: str = "bench_") -> Column:
    return F.aggregate(f"{prefix}spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def is_contaminated(prefix: str = "bench_") -> Column:
    """At least one word is hit, and a twentieth of all."""
    return (n_hit(prefix) > 0) & (20 * n_hit(prefix) >= F.col(f"{prefix}n_words"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        F.col("bench_n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("bench_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("bench_items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


_ASCII_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS_SQL = "regexp_extract_all(" + _ASCII_LOWER_SQL + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUERIES = {"op6_decontamination": op6_decontamination}
ORACLE_SQL = {
    "op6_decontamination": f"""
    WITH i AS (SELECT item_id, {_WORDS_SQL.format("text")} AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, list_slice(w, s, s + 12) AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
    d AS (SELECT doc_id, coalesce({_WORDS_SQL.format("text")}, []) AS w FROM documents),
    sizes AS (SELECT DISTINCT len(x) AS n FROM win),
    p AS (SELECT doc_id, n, unnest(range(1, CAST(len(w) - n + 1 AS BIGINT) + 1)) AS s, w FROM d, sizes WHERE len(w) >= n),
    m AS (SELECT p.doc_id, p.s, p.n, win.item_id FROM (SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS x FROM p) p JOIN win ON p.x = win.x),
    hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM m) GROUP BY doc_id),
    it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
    """
}
