"""Words that a weak hash would confuse, scores by enumeration, and packing of many short texts."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import decontaminate, lattice, packing, textcols, tokens, triejoin


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


LONG = [thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")]


def test_long_words_of_equal_polynomials_stay_apart(spark):
    assert len({int(textcols.hash_ranges(np.frombuffer(w.encode(), np.uint8), np.array([0, 1024]))[0]) for w in LONG}) == 2
    docs = spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_known"], r["train_tokens"]) for r in lattice.score_documents(docs, F.col("doc_id") == 0).collect()}
    assert got == {0: (2, 2), 1: (1, 2)}
    items = spark.createDataFrame([(7, LONG[0])], "item_id long, text string")
    assert {r["doc_id"]: r["bench_items"] for r in decontaminate.find_contamination(docs, items).collect()} == {0: ["7"], 1: []}
    assert {r["doc_id"]: r["component_id"] for r in triejoin.near_duplicates(docs).collect()} == {0: 0, 1: 1}


def test_equal_hashes_are_told_apart_by_bytes(spark, monkeypatch):
    """With every word in one hash, windows and counts still follow the bytes."""
    monkeypatch.setattr(decontaminate, "hash_vocab", lambda vocab: np.full(len(vocab), 5, np.uint64))
    words = textcols.split_words(*textcols.raw(decontaminate.pa.array(["one two three", "one two four"])), textcols.NON_ALNUM)
    index = decontaminate.WindowIndex([{"words": "one two three", "n": 3, "items": ["1"]}])
    index.order({})
    start, win = index.matches(words, np.full(len(words.codes), 5, np.uint64))
    assert start.tolist() == [0] and win.tolist() == [0]


def test_clashing_names_are_refused(spark):
    docs = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, bench_items long")
    with pytest.raises(ValueError, match="bench_items"):
        decontaminate.find_contamination(docs, spark.createDataFrame([(1, "a")], "item_id long, text string"))


TEXTS = ["the cat sat", "the hat", "a cat the end", None, "cats sat at ten", "", "zq the"]


def test_scores_equal_enumeration(spark):
    """Counts, re-estimated pieces, cache and segmentations, all by enumeration."""
    path = tokens.vocabulary("byte_bpe_50k.json")
    p = lattice.Pieces(path)
    at = {k: i for i, k in enumerate(p.keys.tolist())}

    def piece(b):
        return at.get(int(textcols.hash_ranges(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0]))

    def cuts(b):
        if not b:
            yield []
        for k in range(1, len(b) + 1):
            if (i := piece(b[:k])) is not None:
                for rest in cuts(b[k:]):
                    yield [i, *rest]

    train = [i for i in range(len(TEXTS)) if i != 5 and i != 6]
    count = Counter(w for i in train for w in (TEXTS[i] or "").encode().split())
    n = sum(count.values()) + len(train)
    weight = p.first
    for _ in range(lattice.ROUNDS):
        uses = np.zeros(len(weight))
        for w in count:
            every = list(cuts(w))
            mass = np.array([math.exp(weight[c].sum()) for c in map(np.array, every)])
            for c, m in zip(every, mass / mass.sum()):
                np.add.at(uses, c, m)
        smooth = uses + 1e-3 * max(1.0, uses.sum()) * np.exp(p.first)
        weight = np.log(smooth / smooth.sum())
    stop = (len(count) + 1) / (uses.sum() + len(count) + 2)
    new = min(0.5, max(1e-4, sum(c == 1 for c in count.values()) / n))

    def word(w):
        spelled = sum(math.exp(weight[c].sum()) * (1 - stop) ** len(c) for c in map(np.array, cuts(w))) * stop
        return (1 - new) * count[w] / n + new * spelled

    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lattice.score_documents(df, F.col("doc_id").isin(train)).collect()}
    for i, t in enumerate(TEXTS):
        seen, total = [], 0.0
        for w in (t or "").encode().split():
            q = word(w)
            total += math.log10(q if not seen else 0.7 * q + 0.3 * seen.count(w) / len(seen))
            seen.append(w)
        total += (math.log10(0.7) if seen else 0) + math.log10((1 - new) * len(train) / n)
        assert got[i] == pytest.approx(total, rel=1e-9)
    alone = {r["doc_id"]: r["score"] for r in lattice.score_documents(df, F.col("doc_id").isin(train), cache=0, whole_words=False).collect()}
    assert all(math.isfinite(x) for x in alone.values()) and alone[0] != got[0]


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_scores_do_not_depend_on_partitions(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id < 40")
    train = F.col("doc_id") % 5 != 0
    one = {r["doc_id"]: r["score"] for r in lattice.score_documents(docs.coalesce(1), train).collect()}
    assert one == pytest.approx({r["doc_id"]: r["score"] for r in lattice.score_documents(docs.repartition(parts), train).collect()}, rel=1e-9)


def test_short_texts_are_packed_without_padding(spark):
    rows = [(i, "of the") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    use = Counter()
    for r in packing.packed_documents(df).collect():
        use[r["sequence_id"]] += r["length"]
    pad = sum(0 if n & (n - 1) == 0 else 2048 - n for n in use.values())
    assert pad <= 0.05 * sum(use.values()) and max(use.values()) <= 2048


def test_all_three_limits_bind():
    p = packing.Packer(64, 4, 20)
    r = np.random.default_rng(3)
    for i in range(300):
        n = int(r.integers(1, 100))
        p.add(i, np.arange(n, dtype=np.uint32), r.random(n) < (0.9 if i % 3 else 0.05))
    p.finish()
    use = {}
    rows = p.drain()
    for _, _, _, ids, seq, offset in rows:
        use.setdefault(seq, []).append((offset, len(ids)))
    full = [sum(n for _, n in x) for x in use.values()]
    assert max(full) <= 64 and max(len(x) for x in use.values()) <= 4
    assert all(at == sum(n for _, n in sorted(x)[:k]) for x in use.values() for k, (at, _) in enumerate(sorted(x)))
    pad = sum(0 if n & (n - 1) == 0 else 64 - n for n in full)
    assert pad <= 0.05 * sum(full)


def test_full_sequences_and_the_open_one_have_numbers_of_their_own():
    p = packing.Packer(16, 16, 16)
    for i in range(50):
        p.add(i, np.arange(40 if i % 2 else 3, dtype=np.uint32), np.ones(40 if i % 2 else 3, bool))
        p.fill(20)
    p.finish()
    use = Counter()
    for _, _, _, ids, seq, _ in p.drain():
        use[seq] += len(ids)
    assert max(use.values()) <= 16 and sum(use.values()) == 25 * 43
