"""Document likelihood over a subword lattice.

A token (a word, or the end of a document) is spelled by every segmentation of
its bytes into pieces of an existing vocabulary, closed by an end-of-word piece.
The pieces' weights start from the vocabulary's own scores (by rank, as a file of
merges has no others) and are re-estimated from the corpus by expected use, ``ROUNDS`` times.  Two more arcs span a whole token: its
corpus count, and a cache of the document's earlier tokens.  A forward recursion
in log space sums all paths, so the score is a marginal over segmentations.

    P(token) = cache * seen before / tokens before
             + (1 - cache) * ((1 - new) * count / N + new * sum over segmentations)

``new`` is the corpus share of words that occurred once, the usual estimate of
the mass of unseen words; the subword part spells any byte string.

Counts follow the corpus: each slice of documents sends its distinct words, by
range of their hash, to reducers that add the counts up and answer every slice;
words are told apart by their bytes; hot words come once per slice, and no task or driver holds the whole vocabulary.
A reducer also keeps each distinct word of the training documents once, of any
length: from these the weights are re-estimated, so they don't depend on slices.

Defined results: a null or empty text is its end token alone; a null key is held
out of nothing (its fold is null: not trained on, not held out); repeated rows
count as often as they occur; without training rows N is 0 and every word is
unknown; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.blobs import pack_keys, pack_small, unpack_keys, unpack_small
from parley.llm.langid import held_out
from parley.llm.store import documents, fold, scratch, spread_keys
from parley.llm.textcols import binary, concat_ranges, hash_ranges, mix64, raw, slices, split_words, sums
from parley.llm.tokens import load, vocabulary

#: Bytes of text that are coded as one block.
SLICE = 8 << 20
CACHE_SHARE = 0.3
#: Re-estimations of the piece weights.
ROUNDS = 2


def _grow(before: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Hashes of byte runs, one byte longer."""
    with np.errstate(over="ignore"):
        return mix64(before + byte.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _grown(runs: list[bytes], n: int) -> np.ndarray:
    """Hashes of byte strings of one length, by their bytes in turn."""
    rows = np.frombuffer(b"".join(runs), np.uint8).reshape(-1, n)
    out = np.zeros(len(rows), np.uint64)
    for i in range(n):
        out = _grow(out, rows[:, i])
    return out


class Pieces:
    """Byte strings of an existing vocabulary with log weights."""

    def __init__(self, path: str) -> None:
        tok = load(path).tok
        chars = {c: b for b, c in load(path).to_chars.items()}
        found = {}
        for piece, rank in tok.get_vocab().items():
            if all(c in chars for c in piece):
                b = bytes(chars[c] for c in piece).strip(b" ").lower()
                if b and not set(b) & set(b" \t\n\v\f\r"):
                    found[b] = min(rank, found.get(b, rank))
        for b in range(256):
            found.setdefault(bytes([b]), len(found))
        names = sorted(found)
        data = np.frombuffer(b"".join(names), np.uint8)
        offs = np.concatenate(([0], np.cumsum([len(x) for x in names])))
        keys = hash_ranges(data, offs)
        order = np.argsort(keys)
        self.keys = keys[order]
        #: The vocabulary's own scores: weights fall with the rank of a piece.
        weight = 1.0 / (100.0 + np.array([found[x] for x in names], float)[order])
        self.first = np.log(weight / weight.sum())
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        whole = dict(zip(names, place.tolist(), strict=True))
        #: By length: (hashes of the pieces' beginnings, the piece that each is or -1).
        self.begin = []
        for n in range(1, max(map(len, names)) + 1):
            heads = sorted({x[:n] for x in names if len(x) >= n})
            keys = _grown(heads, n)
            by = np.argsort(keys)
            self.begin.append((keys[by], np.array([whole.get(x, -1) for x in heads])[by]))

    def spans(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """By length: (first byte, piece) of every place where a piece stands inside a word."""
        end = np.repeat(offs[1:], np.diff(offs))
        out = []
        at, grown = np.arange(len(data)), np.zeros(len(data), np.uint64)
        for n, (heads, piece) in enumerate(self.begin, 1):
            fits = at + n <= end[at]
            at = at[fits]
            if not len(at):
                break
            grown = _grow(grown[fits], data[at + (n - 1)])
            k = np.minimum(np.searchsorted(heads, grown), len(heads) - 1)
            ok = heads[k] == grown
            at, grown, k = at[ok], grown[ok], piece[k[ok]]
            out.append((at[k >= 0], k[k >= 0]))
        return out


#: Distinct words that are spelled at once: the bound on what a lattice holds.
WORDS = 40_000


def word_runs(n: np.ndarray, data: np.ndarray, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indices, bytes, offsets) of the words ``some``, a bounded number of bytes at a time."""
    offs = np.concatenate(([0], np.cumsum(n)))
    lo = 0
    ends = np.cumsum(n[some])
    while lo < len(some):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 12 * WORDS, "right")))
        own = some[lo:hi]
        yield own, data[concat_ranges(offs[own], n[own])], np.concatenate(([0], np.cumsum(n[own])))
        lo = hi


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _columns(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(offs)
    return np.arange(int(offs[-1])) - np.repeat(offs[:-1], n), np.repeat(np.arange(len(n)), n)


def _sweep(key: np.ndarray, source: np.ndarray, target: np.ndarray, gain: np.ndarray, mass: np.ndarray) -> None:
    """Log of the sum of what all arcs carry into each target, in the order of ``key``; a target has one key."""
    order = np.argsort(key * len(mass) + target)
    source, target, gain, key = source[order], target[order], gain[order], key[order]
    first = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
    last = np.append(first[1:], len(target))
    step = key[first]
    bound = np.append(np.flatnonzero(np.append(True, step[1:] != step[:-1])), len(step))
    for lo, hi in zip(bound[:-1], bound[1:], strict=True):
        part = slice(first[lo], last[hi - 1])
        x = mass[source[part]] + gain[part]
        at = first[lo:hi] - first[lo]
        top = np.maximum.reduceat(x, at)
        safe = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            mass[target[first[lo:hi]]] = safe + np.log(np.add.reduceat(np.exp(x - np.repeat(safe, last[lo:hi] - first[lo:hi])), at))


def _arcs(spans: list, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, byte in the word, source, target, piece) of every span; a word of n bytes has n + 1 places."""
    col, word = _columns(offs)
    begin = np.concatenate([at for at, _ in spans])
    size = np.concatenate([np.full(len(at), i + 1) for i, (at, _) in enumerate(spans)])
    source = begin + word[begin]
    return word[begin], col[begin], source, source + size, np.concatenate([k for _, k in spans])


def forward(spans: list, offs: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Log of the sum over segmentations of each word's product of piece weights, in log space.

    All words advance together; ``alpha`` at a word's byte i is the log mass of its first i bytes.
    """
    n = np.diff(offs)
    alpha = np.full(int(offs[-1]) + len(n), -np.inf)
    base = offs[:-1] + np.arange(len(n))
    alpha[base] = 0.0
    if spans:
        _, start, source, target, piece = _arcs(spans, offs)
        _sweep(start + target - source, source, target, weight[piece], alpha)
    return alpha[base + n]


def expected_counts(spans: list, offs: np.ndarray, weight: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by forward-backward in log space, words of any length counted ``times``."""
    n = np.diff(offs)
    if not spans:
        return np.zeros(len(weight))
    base = offs[:-1] + np.arange(len(n))
    alpha = np.full(int(offs[-1]) + len(n), -np.inf)
    beta = alpha.copy()
    alpha[base] = 0.0
    beta[base + n] = 0.0
    word, start, source, target, piece = _arcs(spans, offs)
    gain = weight[piece]
    _sweep(start + target - source, source, target, gain, alpha)
    _sweep(start.max() - start, target, source, gain, beta)
    share = np.exp(alpha[source] + gain + beta[target] - alpha[base + n][word])
    return np.bincount(piece, share * times[word], len(weight))


@dataclass
class Corpus:
    """What the training documents say: totals, new-word share and piece weights."""

    tokens: int
    distinct: int
    new: float
    weight: np.ndarray
    stop: float


def _blocks(docs: DataFrame, key: str, text: str, path: str, train: Column) -> None:
    """Write slices of documents as coded blocks: what scoring needs of them, texts read once."""
    schema = "block long, keys binary, train binary, doc binary, codes binary, hashes binary, data binary, offs binary"
    arrow = pa.schema([("block", pa.int64()), *((n, pa.binary()) for n in ("keys", "train", "doc", "codes", "hashes", "data", "offs"))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for part in slices(batches, text, SLICE):
            w = split_words(*raw(part.column(text)))
            data, offs = raw(w.vocab)
            order = np.argsort(hash_ranges(data, offs))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([part.schema.field(0)])) as out:
                out.write_batch(part.select([0]))
            n = np.diff(offs)[order]
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "block": block,
                        "keys": sink.getvalue().to_pybytes(),
                        "train": np.packbits(part.column(2).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)).tobytes(),
                        "doc": w.doc.astype(np.int64).tobytes(),
                        "codes": pack_small(place[w.codes] if len(w.codes) else np.zeros(0, np.int64)),
                        "hashes": pack_keys(hash_ranges(data, offs)[order]),
                        "data": data[concat_ranges(offs[:-1][order], n)].tobytes(),
                        "offs": pack_small(n),
                    }
                ],
                schema=arrow,
            )
            block += 1

    docs.select(F.col(key), F.col(text), train.alias("train")).mapInArrow(task, schema).write.option("compression", "zstd").parquet(path)


def _counts(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, training counts, training documents) of a block."""
    get = lambda name: batch.column(batch.schema.get_field_index(name))[row].as_py()
    hashes = unpack_keys(get("hashes"))
    doc = np.frombuffer(get("doc"), np.int64)
    train = np.unpackbits(np.frombuffer(get("train"), np.uint8))[: len(doc) - 1].astype(bool)
    used = np.repeat(train, np.diff(doc))
    return hashes, np.bincount(unpack_small(get("codes"))[used], minlength=len(hashes)), int(train.sum())


def _requests(blocks: DataFrame, spread: np.ndarray) -> DataFrame:
    """(block, bucket, part, counts, sizes, words): the distinct words of a block, spelled out, by range of their hash.

    The hash only deals the words out; the end of a document is the empty word.
    """
    buckets = len(spread)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                hashes, counts, docs = _counts(batch, row)
                sizes = np.concatenate(([0], unpack_small(batch.column(batch.schema.get_field_index("offs"))[row].as_py())))
                data = batch.column(batch.schema.get_field_index("data"))[row].as_py()
                ends = np.concatenate(([0], np.cumsum(sizes)))
                counts = np.concatenate(([docs], counts))
                # Ranges of the hash space: part = hash * buckets / 2^64; the end belongs to the first.
                cut = 1 + np.searchsorted(hashes, np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64))
                cut = np.concatenate(([0], cut, [len(counts)]))
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(full), batch.column(0)[row].as_py()), pa.int64()),
                        pa.array(spread[full], pa.int64()),
                        pa.array(full, pa.int32()),
                        pa.array([pack_small(counts[cut[i] : cut[i + 1]]) for i in full], pa.binary()),
                        pa.array([pack_small(sizes[cut[i] : cut[i + 1]]) for i in full], pa.binary()),
                        pa.array([data[ends[cut[i]] : ends[cut[i + 1]]] for i in full], pa.binary()),
                    ],
                    names=["block", "bucket", "part", "counts", "sizes", "words"],
                )

    return blocks.select("block", "train", "doc", "codes", "hashes", "data", "offs").mapInArrow(task, "block long, bucket long, part int, counts binary, sizes binary, words binary")


_ANSWER = "block long, part int, reply binary, tokens long, distinct long, single long, sizes binary, words binary"


def _answer(table: pa.Table) -> pa.Table:
    """Of one bucket: each block's words with their counts over the corpus; and the bucket's totals and training words, each once.

    Words are told apart by their bytes.
    """
    counts = [unpack_small(x) for x in table["counts"].to_pylist()]
    sizes = np.concatenate([unpack_small(x) for x in table["sizes"].to_pylist()])
    coded = binary(np.frombuffer(b"".join(table["words"].to_pylist()), np.uint8), np.concatenate(([0], np.cumsum(sizes)))).dictionary_encode()
    place = coded.indices.to_numpy(zero_copy_only=False)
    total = np.bincount(place, np.concatenate(counts), len(coded.dictionary)).astype(np.int64)
    replies, at = [], 0
    for c in counts:
        replies.append(pack_small(total[place[at : at + len(c)]]))
        at += len(c)
    data, offs = raw(coded.dictionary)
    n = np.diff(offs)
    own = np.flatnonzero((total > 0) & (n > 0))
    words = data[concat_ranges(offs[own], n[own])]
    rows = len(counts)
    return pa.table(
        {
            "block": pa.array([*table["block"].to_pylist(), -1], pa.int64()),
            "part": pa.array([*table["part"].to_pylist(), -1], pa.int32()),
            "reply": pa.array([*replies, b""], pa.binary()),
            "tokens": pa.array([0] * rows + [int(total.sum())], pa.int64()),
            "distinct": pa.array([0] * rows + [int((total > 0).sum())], pa.int64()),
            "single": pa.array([0] * rows + [int((total == 1).sum())], pa.int64()),
            "sizes": pa.array([b""] * rows + [pack_small(n[own])], pa.binary()),
            "words": pa.array([b""] * rows + [words.tobytes()], pa.binary()),
        }
    )


def _piece_counts(words: DataFrame, path: str, weight: np.ndarray) -> np.ndarray:
    """Expected uses of every piece over the distinct training words: a row per task and piece at most."""
    sent = words.sparkSession.sparkContext.broadcast(weight)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        out = np.zeros(len(p.keys) + 1)
        for batch in batches:
            for sizes, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = unpack_small(sizes)
                # A word spells once for its pieces: types, as unseen words are types too.
                for own, text, offs in word_runs(n, np.frombuffer(data, np.uint8), np.arange(len(n))):
                    out[:-1] += expected_counts(p.spans(text, offs), offs, sent.value, np.ones(len(own)))
                out[-1] += len(n)
        used = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(out[used])], names=["piece", "uses"])

    rows = words.mapInArrow(task, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
    out = np.zeros(len(pieces(path).keys) + 1)
    out[rows["piece"].to_numpy()] = rows["uses"].to_numpy()
    return out


def score_documents(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", cache: float = CACHE_SHARE, rounds: int = ROUNDS, whole_words: bool = True) -> DataFrame:
    """Per document: key, n_tokens, n_known, train_tokens, base_score, score (log10).

    ``train`` says which documents the corpus counts come from.  Without ``whole_words``
    and with a ``cache`` of 0 the score is that of the lattice alone.
    """
    spark = docs.sparkSession
    vocab = vocabulary(tokenizer)
    at = scratch(spark, "lattice")
    parts = max(8, 2 * docs.rdd.getNumPartitions())
    _blocks(docs, key, text, f"{at}/blocks", train)
    blocks = spark.read.parquet(f"{at}/blocks")
    _requests(blocks, spread_keys(spark, parts)).repartition(parts, "bucket").groupBy("bucket").applyInArrow(_answer, _ANSWER).write.option("compression", "zstd").parquet(f"{at}/replies")
    replies = spark.read.parquet(f"{at}/replies")
    totals = replies.where("block = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "distinct", "single"))).first()
    weight = pieces(vocab).first
    words = replies.where("block = -1").select("sizes", "words").repartition(parts)
    uses = np.zeros(len(weight) + 1)
    for _ in range(rounds):
        uses = _piece_counts(words, vocab, weight)
        smooth = uses[:-1] + 1e-3 * max(1.0, uses[:-1].sum()) * np.exp(pieces(vocab).first)
        weight = np.log(smooth / smooth.sum())
    stop = (uses[-1] + 1.0) / (uses[:-1].sum() + uses[-1] + 2.0)
    new = min(0.5, max(1e-4, totals["single"] / max(1, totals["tokens"]))) if whole_words else 1.0
    model = Corpus(int(totals["tokens"]), int(totals["distinct"]), new, weight + math.log1p(-stop), math.log(stop))
    sent = spark.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield _score_block(batch, row, key, sent.value, vocab, cache)

    answers = replies.where("block >= 0").repartition(parts, "block").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "reply"))).alias("replies"))
    joined = blocks.drop("train", "hashes").repartition(parts, "block").hint("shuffle_merge").join(answers, "block")
    return joined.mapInArrow(score, f"`{key}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _score_block(batch: pa.RecordBatch, row: int, key: str, model: Corpus, path: str, cache: float) -> pa.RecordBatch:
    get = lambda name: batch.column(batch.schema.get_field_index(name))[row].as_py()
    doc = np.frombuffer(get("doc"), np.int64)
    codes = unpack_small(get("codes"))
    count = np.concatenate([unpack_small(r["reply"]) for r in get("replies")])
    ends, count = count[0], count[1:]
    n = unpack_small(get("offs"))
    data = np.frombuffer(get("data"), np.uint8)
    big = max(1, model.tokens)
    # Base: the add-0.1 unigram of the contract.
    below = model.tokens + 0.1 * (model.distinct + 1)
    base = np.log10((count + 0.1) / below)
    base_end = math.log10((ends + 0.1) / below)
    p = pieces(path)
    spelled = np.zeros(len(n))
    for own, part, offs in word_runs(n, data, np.arange(len(n))):
        spelled[own] = forward(p.spans(part, offs), offs, model.weight) + model.stop
    word = (1 - model.new) * count / big + model.new * np.exp(spelled)
    # A word too long for a double keeps its log.
    log_word = np.where(count == 0, math.log(model.new) + spelled, np.log(np.maximum(word, 1e-300)))
    # Cache: how often the word came before in its document.
    docs = np.repeat(np.arange(len(doc) - 1), np.diff(doc))
    place = np.arange(len(codes)) - doc[:-1][docs]
    order = np.argsort(docs * max(1, len(n)) + codes, kind="stable")
    same = docs[order] * max(1, len(n)) + codes[order]
    first = np.append(True, same[1:] != same[:-1]) if len(same) else np.zeros(0, bool)
    run = np.arange(len(same)) - np.maximum.accumulate(np.where(first, np.arange(len(same)), 0)) if len(same) else np.zeros(0, np.int64)
    seen = np.empty(len(codes))
    seen[order] = run
    lp = log_word[codes]
    with np.errstate(divide="ignore"):
        old = lp if not cache else np.where(place > 0, np.logaddexp(math.log1p(-cache) + lp, math.log(cache) + np.log(seen / np.maximum(place, 1))), lp)
    end = math.log(max((1 - model.new if model.new < 1 else 1) * ends / big, 1e-12))
    size = np.diff(doc)
    total = sums(old, doc) + np.where(size > 0, math.log1p(-cache), 0.0) + end
    known = sums((count > 0)[codes].astype(np.int64), doc) + int(ends > 0)
    keys = pa.ipc.open_stream(get("keys")).read_all().column(0).combine_chunks()
    return pa.RecordBatch.from_arrays(
        [keys, pa.array(size + 1), pa.array(known), pa.array(np.full(len(size), model.tokens)), pa.array(sums(base[codes], doc) + base_end), pa.array(total / math.log(10))],
        names=[key, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(documents(spark, sf_dir), fold(F.col("doc_id"), 10) != 0)
    return scored.select("doc_id", held_out("doc_id", 10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op5_lattice": op5_lattice}
ORACLE_SQL: dict[str, str] = {}
