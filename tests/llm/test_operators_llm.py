"""Each operator against a brute-force version, with nulls, empty and long texts, repeats and empty tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import decontaminate, idcoder, idfiles, langid, lattice, packing, repeats, surrogates, textcols, tokens, topk, toxicity, triejoin

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


BASE = prose(120, 1)
TEXTS = [
    BASE,
    BASE,
    BASE.replace(VOCAB[0], "changed"),
    BASE + " one more end",
    prose(60, 2),
    None,
    "",
    "  \n\t ",
    "one two",
    "one two",
    "Ünïcode ﬁne 日本語 text é",
    prose(3000, 3),
    "x" * 450,
    prose(50, 4) + " " + BASE[:260],
    "<|endoftext|> marks inside",
    "a a a a a a a a a a " * 40,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())


# Text columns.


def test_split_words_and_hashes():
    data, offs = textcols.raw(pa.array(TEXTS))
    w = textcols.split_words(data, offs)
    vocab = w.vocab.to_pylist()
    for i, t in enumerate(TEXTS):
        assert [vocab[c] for c in w.codes[w.doc[i] : w.doc[i + 1]]] == words(t)
    h = textcols.hash_vocab(w.vocab)
    assert len(set(h.tolist())) == len(vocab)
    assert textcols.hash_vocab(pa.array([vocab[3]], pa.binary()))[0] == h[3]


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], names=["i", "t"])
    parts = list(textcols.slices(iter([batch]), "t", 500))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(len(TEXTS))) and len(parts) > 3


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_equal_the_library(name):
    from tokenizers import Tokenizer

    more = [*TEXTS, "don't  we'll\n\n x's ... 12,345.6 ½ A'S", "é́ é nbsp ​z", "İstanbul ß ẞ ΑΣ", " lead", "trail ", "tab\tnew\r\nline"]
    data, offs = textcols.raw(pa.array(more))
    path = tokens.vocabulary(name)
    ids, at = tokens.encode(path, data, offs, 7)
    tok = Tokenizer.from_file(path)
    for i, t in enumerate(more):
        assert ids[at[i] : at[i + 1]].tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 7]


# 1 and 2: classifiers.


def test_language_held_out_accuracy(spark):
    a = ["the and of that with", "der und die nicht mit"]
    rows = [(i, " ".join(random.Random(i).choices((a[i % 2] + " " + " ".join(VOCAB[:20])).split(), k=30)), "en" if i % 2 == 0 else "de", "s", 0) for i in range(200)]
    rows += [(1000, None, "en", "s", 0), (1001, "123 456 !!", "en", "s", 0), (1002, "", None, "s", 0), (1003, "日本", None, "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    model = langid.train_language_model(df.where("doc_id < 150"))
    got = {r["doc_id"]: r for r in langid.identify_language(df, model).collect()}
    held = [i for i in range(150, 200)]
    assert np.mean([got[i]["lang_pred"] == got[i]["lang"] for i in held]) >= 0.95
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000]["lang_score"] == 0
    assert got[1003]["lang_pred"] in ("en", "de")
    assert all(0 <= r["lang_score"] <= 1 for r in got.values())
    with pytest.raises(ValueError):
        langid.identify_language(df.withColumn("lang_pred", F.lit(1)), model)
    none = langid.train_language_model(df.where("false"))
    assert {r["lang_pred"] for r in langid.identify_language(df, none).collect()} == {"und"}


def test_subword_sums_match_lists():
    vocab = pa.array([b"ab", b"hello", "é".encode()], pa.large_binary())
    table = np.random.default_rng(0).normal(size=(997, 2))
    total, count = langid.subword_sums(vocab, table)
    bucket, off = langid.subword_lists(vocab, 997)
    for i in range(3):
        assert count[i] == off[i + 1] - off[i]
        np.testing.assert_allclose(total[i], table[bucket[off[i] : off[i + 1]]].sum(0))


def test_toxicity_finds_planted_words(spark):
    def text(i):
        w = prose(40, 1000 + i).split()
        if i % 3 == 0:
            w[5], w[20] = "Nastyword,", "vileword"
        return " ".join(w)

    rows = [(i, text(i), "en", "s", 0) for i in range(240)] + [(900, None, None, None, None), (901, "", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(180)] + [(3, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train_toxicity_model(df, labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, model).collect()}
    assert all((got[i]["toxic_score"] >= 0.5) == (i % 3 == 0) for i in range(180, 240))
    assert got[900]["toxic_score"] == got[901]["toxic_score"] < 0.5 and got[901]["toxic_spans"] == []
    spans = got[183]["toxic_spans"]
    assert [text(183)[s["start"] : s["end"]] for s in spans] == ["Nastyword", "vileword"]
    flat = toxicity.train_toxicity_model(df, labels.where("false"))
    assert all(r["toxic_score"] < 0.01 for r in toxicity.score_toxicity(df, flat).collect())


def _split(texts):
    return textcols.split_words(*textcols.raw(pa.array(texts, pa.large_string())), textcols.NON_ALNUM)


def test_beginnings_mark_toxic_words_and_copies_do_not():
    ends = ["an", "ei", "schaft", "lo", "tum", "wei", "ing", "or", "isch", "und", "ab", "em"]
    texts, toxic = [], []
    for i in range(400):
        w = prose(30, 3000 + i).split()
        if i % 4 == 0:
            w[i % 29] = "zorgl" + ends[i % 12] + ends[i // 12 % 12]
        texts.append(" ".join(w))
        toxic.append(int(i % 4 == 0))
    copy = prose(30, 5000) + " quoxa plimba"
    texts, toxic = texts + [copy] * 60, toxic + [1] * 60
    w = _split(texts)
    marks = {v.decode() for v in w.vocab.take(pa.array(np.flatnonzero(toxicity.toxic_words(w, np.array(toxic))))).to_pylist()}
    assert marks and all(m.startswith("zorgl") for m in marks)
    assert not toxicity.toxic_words(_split([]), np.zeros(0, int)).size and not toxicity.toxic_words(_split(["", "a b"]), np.array([1, 0])).any()
    model = toxicity.train(texts, toxic)
    unseen = [t.replace(t.split()[7], "zorglemtum") for t in (prose(30, 7000 + i) for i in range(20))]
    clean = [prose(30, 8000 + i) for i in range(20)]
    w = _split(unseen + clean)
    score = model.score(model.tag(w), w.doc)
    assert (score[:20] >= 0.5).all() and (score[20:] < 0.5).all()


def test_document_score_equals_enumeration():
    model = toxicity.train([f"{prose(6, 60 + i)} {'vile' if i % 2 else 'kind'} {prose(5, 90 + i)}" for i in range(40)], [i % 2 for i in range(40)])
    texts = ["", "vile", "kind words vile here", "vile vile kind", "other kind words"]
    w = _split(texts)
    e = (model.weights[-1] + model.weights[toxicity.word_features(w.vocab)].sum(1))[w.codes]
    got = model.score(model.tag(w), w.doc)
    for i, text in enumerate(texts):
        lo, hi = w.doc[i], w.doc[i + 1]
        mass = np.zeros(hi - lo + 1)
        for tags in itertools.product((0, 1), repeat=int(hi - lo)):
            p = math.exp(sum(e[lo + k] * y for k, y in enumerate(tags)) + sum(model.trans[a, b] for a, b in zip(tags, tags[1:])))
            mass += p * np.array([1, *tags])
        m = mass[1:] / mass[0]
        many = -np.log1p(-np.minimum(m, 1 - 1e-9)).sum()
        x = np.array([1, math.log1p(many), m.max(initial=0), min(1, 20 * many / (len(m) + 20))])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-x @ model.logistic)), rel=1e-6), text


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    e, trans, doc = r.normal(size=7), r.normal(size=(2, 2)), np.array([0, 0, 3, 7])
    got = toxicity.marginals(e, doc, trans)
    for lo, hi in zip(doc[:-1], doc[1:]):
        n = hi - lo
        weight = np.zeros((n, 2))
        for s in range(2**n):
            y = [(s >> k) & 1 for k in range(n)]
            p = math.exp(sum(e[lo + k] * y[k] for k in range(n)) + sum(trans[y[k - 1], y[k]] for k in range(1, n)))
            for k in range(n):
                weight[k, y[k]] += p
        if n:
            np.testing.assert_allclose(got[lo:hi], weight[:, 1] / weight.sum(1), rtol=1e-9)


# 3: repeats.


def removed(texts, n=repeats.LENGTH):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + n] for b in data for k in range(len(b) - n + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k] += 1
                gone[k + n] -= 1
        g = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(g.astype(int), prepend=0) == 1).sum())
        out.append((len(b), int(g.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~g])).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [10_000, 3])
def test_repeats_equal_brute_force(spark, docs, empty, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    r = random.Random(9)
    passage = prose(70, 77)
    more = [prose(r.randint(0, 40), 50 + i) + passage[r.randint(0, 60) : len(passage) - r.randint(0, 60)] + prose(r.randint(0, 40), 90 + i) for i in range(12)]
    more += ["é" * 150 + passage, "é" * 150, passage[:200], passage[:199], "ab" * 180, "ba" * 120]
    texts = TEXTS + more
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x for x in repeats.remove_repeats(df).collect()}
    for i, want in enumerate(removed(texts)):
        x = got[i]
        assert (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) == want
        assert hashlib.sha256(x["kept"]).hexdigest() == want[3]
    assert repeats.remove_repeats(empty).count() == 0


def test_merged_transforms_give_order_and_common_prefixes():
    r = np.random.default_rng(2)
    rows = r.integers(97, 99, (60, 16)).astype(np.uint8)
    rows[30:45] = rows[:15]
    rows[50] = rows[3]
    first = r.integers(0, 3, 60).astype(np.uint64)
    cut = [0, 7, 8, 40, 60]
    parts = [repeats.transform(repeats._symbols(rows[a:b]), np.zeros(b - a, int)) for a, b in zip(cut, cut[1:])]
    order, common = repeats.merge_transforms(parts, first)
    assert sorted(order.tolist()) == list(range(60))
    for i in range(1, 60):
        a, b = order[i - 1], order[i]
        assert (first[a], bytes(rows[a])) <= (first[b], bytes(rows[b]))
        differ = np.flatnonzero(rows[a] != rows[b])
        assert common[i] == (0 if first[a] != first[b] else differ[0] if len(differ) else 16)


def test_a_groups_part_of_a_transform_is_its_own_transform():
    r = np.random.default_rng(3)
    symbols = r.integers(0, 3, (40, 5)).astype(np.uint64)
    group = np.sort(r.integers(0, 4, 40))
    whole = repeats.transform(symbols, group)
    for g in range(4):
        own = np.flatnonzero(group == g)
        assert (whole[:, own] == repeats.transform(symbols[own], np.zeros(len(own), int))).all()


# 4: packing.


def check_pieces(rows, texts, capacity=2048):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    pad = total = 0
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        total += at
        pad += 0 if at & (at - 1) == 0 else capacity - at
    return pad / total


def test_packing(docs, empty):
    assert check_pieces(packing.packed_documents(docs).collect(), TEXTS) < 0.05
    assert packing.packed_documents(empty).count() == 0


def test_packing_limits():
    p = packing.Packer(100, 3, 40, may_cut=False)
    r = random.Random(1)
    for i in range(200):
        n = r.randint(1, 60)
        loss = np.zeros(n, bool)
        loss[: r.randint(0, min(n, 40))] = True
        p.add(i, np.arange(n, dtype=np.uint32), loss)
    p.finish()
    use = {}
    for _key, _, total, ids, seq, _ in p.drain():
        assert len(ids) == total
        use.setdefault(seq, []).append(len(ids))
    assert all(sum(x) <= 100 and len(x) <= 3 for x in use.values())
    assert sum(map(len, use.values())) == 200


# 5: lattice.


def test_lattice_base_and_probability(spark, docs, empty):
    train = F.col("doc_id") % 3 != 0
    got = {r["doc_id"]: r for r in lattice.score_documents(docs, train).collect()}
    counts = Counter()
    for i, t in enumerate(TEXTS):
        if i % 3:
            counts.update([*words(t), "end"])
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(TEXTS):
        w = [*words(t), "end"]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert lattice.score_documents(empty, train).count() == 0


@pytest.mark.parametrize("count", [0, 200, 201, 5000])
def test_lattice_spells_words_of_any_count(count):
    path = tokens.vocabulary("byte_bpe_50k.json")
    p = lattice.Pieces(path)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("doc_id", pa.int64())])) as out:
        out.write_batch(pa.record_batch([pa.array([1])], names=["doc_id"]))
    block = {"keys": sink.getvalue().to_pybytes(), "doc": np.array([0, 1]).tobytes(), "codes": lattice.pack_small(np.array([0]))}
    block |= {"replies": [{"bucket": 0, "reply": lattice.pack_small(np.array([7, count]))}], "offs": lattice.pack_small(np.array([2])), "data": b"th"}
    model = lattice.Corpus(1_000_000, 1000, 0.1, p.first + math.log(0.6), math.log(0.4))
    got = lattice._score_block(pa.RecordBatch.from_pylist([block]), 0, "doc_id", model, path, 0.3).to_pylist()[0]
    spelled = math.exp(lattice.forward(p.spans(np.frombuffer(b"th", np.uint8), np.array([0, 2])), np.array([0, 2]), model.weight)[0] + model.stop)
    want = math.log10(0.9 * count / 1e6 + 0.1 * spelled) + math.log10(0.7) + math.log10(0.9 * 7 / 1e6)
    assert got["score"] == pytest.approx(want, rel=1e-9)


def test_lattice_does_not_depend_on_slices(spark):
    rows = [(i, f"{prose(30, i % 7)} {'日本語の文章' * 5}{i % 3} internationalization", "en", "s", 1) for i in range(40)]
    df = spark.createDataFrame(rows, DOCS)
    one, many = ({r["doc_id"]: r["score"] for r in lattice.score_documents(d, F.col("doc_id") % 5 != 0).collect()} for d in (df.coalesce(1), df.repartition(9)))
    assert one == pytest.approx(many, rel=1e-9)


@pytest.mark.parametrize("word", ["日本語の文章" * 6, "\u0394\x01\x02" * 700, "implementation"])
def test_pieces_of_words_of_any_length_are_counted(word):
    p = lattice.Pieces(tokens.vocabulary("byte_bpe_50k.json"))
    data, offs = textcols.raw(pa.array([word]))
    spans = p.spans(data, offs)
    uses = lattice.expected_counts(spans, offs, p.first, np.ones(1))
    size = np.zeros(len(p.keys))
    for n, (_, k) in enumerate(spans):
        size[k] = n + 1
    assert (uses * size).sum() == pytest.approx(len(data))
    assert word != "implementation" or len(spans[13][0]) == 1


def test_forward_equals_enumeration():
    p = lattice.Pieces(tokens.vocabulary("byte_bpe_50k.json"))
    names = ["thing", "é", "aab"]
    data, offs = textcols.raw(pa.array(names))
    spans = p.spans(data, offs)
    got = lattice.forward(spans, offs, p.first)
    counts = lattice.expected_counts(spans, offs, p.first, np.ones(3))
    known = {k: w for k, w in zip(p.keys.tolist(), p.first.tolist())}

    def total(b):
        if not b:
            return 1.0
        out = 0.0
        for k in range(1, len(b) + 1):
            h = int(textcols.hash_ranges(np.frombuffer(b[:k], np.uint8), np.array([0, k]))[0])
            if h in known:
                out += math.exp(known[h]) * total(b[k:])
        return out

    for x, z in zip(names, got):
        assert z == pytest.approx(math.log(total(x.encode())))
    # Expected piece lengths add up to the bytes of the words.
    size = np.zeros(len(p.keys))
    for n, (_, k) in enumerate(spans):
        size[k] = n + 1
    assert (counts * size).sum() == pytest.approx(len(data))


# 6: decontamination.


def test_decontamination(spark, docs, empty):
    item_rows = [(1, " ".join(BASE.split()[3:40])), (2, "One, TWO!"), (2, "One, TWO!"), (3, None), (4, ""), (5, "not there at all " * 5), (10, BASE), (None, "日本語 text")]
    items = spark.createDataFrame(item_rows, "item_id long, text string")
    w = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    got = {r["doc_id"]: r for r in decontaminate.find_contamination(docs, items).collect()}
    for i, t in enumerate(TEXTS):
        d, hit, found = w(t), set(), set()
        for item, x in item_rows:
            v = w(x)
            size = min(13, len(v))
            for k in range(len(v) - size + 1 if v else 0):
                for s in range(len(d) - size + 1):
                    if d[s : s + size] == v[k : k + size]:
                        hit.update(range(s, s + size))
                        found |= {str(item)} if item is not None else set()
        r = got[i]
        assert r["bench_n_words"] == len(d) and r["bench_items"] == sorted(found)
        assert {p for s in r["bench_spans"] for p in range(s["start"], s["end"])} == hit
    assert decontaminate.find_contamination(empty, items).count() == 0
    assert all(r["bench_spans"] == [] for r in decontaminate.find_contamination(docs, items.where("false")).collect())


def test_decontamination_in_blocks(docs, spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(BASE.split()[i : i + 20])) for i in range(30)], "item_id long, text string")
    once = decontaminate.find_contamination(docs, items).orderBy("doc_id").collect()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 6000)
    assert decontaminate.find_contamination(docs, items).orderBy("doc_id").collect() == once


# 8: near-duplicates.


def brute_components(texts):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def variants():
    r = random.Random(3)
    out = list(TEXTS)
    for g in range(6):
        base = prose(60, 200 + g).split()
        for _ in range(8):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(VOCAB)
            out.append(" ".join(w[r.randint(0, 6) :]))
    return out


def test_near_duplicates_equal_brute_force(spark, empty):
    texts = variants()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in triejoin.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)
    assert triejoin.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("group", [1000, 3])
def test_near_duplicates_with_frequent_shingles(spark, monkeypatch, group):
    monkeypatch.setattr(triejoin, "FREQUENT", 4)
    monkeypatch.setattr(triejoin, "GROUP", group)
    monkeypatch.setattr(triejoin, "LARGE", 4 * group)
    texts = variants() * 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in triejoin.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


# 9: token-id files.


@pytest.mark.parametrize("n", [0, 1, 255, 2049, 9000, 300_000])
@pytest.mark.parametrize("most", [50_257, 2**32])
def test_id_coder_round_trip(n, most):
    r = np.random.default_rng(n)
    ids = np.concatenate((r.integers(0, most, n // 2), r.integers(0, 40, n - n // 2))).astype(np.uint32)
    blob = idcoder.encode_blocks(ids)
    assert (idcoder.decode_blocks(blob) == ids).all()
    if n > 100:
        broken = bytearray(blob)
        broken[-30] ^= 4
        with pytest.raises(idcoder.BlockError):
            idcoder.decode_blocks(bytes(broken))


def test_id_coder_beats_a_general_compressor():
    import zstandard

    table = pa.parquet.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])
    ids, _ = tokens.encode(tokens.vocabulary("byte_bpe_50k.json"), *textcols.raw(table.column(0)), 2)
    assert len(idcoder.encode_blocks(ids)) < len(zstandard.ZstdCompressor(level=3).compress(ids.astype("<u2").tobytes()))


def test_id_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    path = str(tmp_path / "ids")
    idfiles.write_id_files(docs, path)
    got = {r["doc_id"]: r for r in idfiles.read_id_files(spark, path).collect()}
    start = 0
    for i, t in enumerate(TEXTS):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        assert bytes(got[i]["ids"]) == ids.tobytes()
        start += len(ids)
    idfiles.write_id_files(empty, str(tmp_path / "none"))
    assert idfiles.read_id_files(spark, str(tmp_path / "none")).count() == 0


# 10: top-k.


def test_top_k(spark):
    r = np.random.default_rng(4)
    rows = [(int(i), r.normal(size=16).astype("float32").tolist()) for i in range(400)]
    rows += [(400, rows[7][1]), (401, rows[7][1]), (402, None), (403, [1.0] * 15 + [float("nan")]), (404, [1.0] * 15 + [None]), (405, [1.0] * 8), (406, []), (500, [2.0] * 8), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for x in topk.exact_top_k(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    valid = {i: np.floor(1024.0 * np.array(v, float)).astype(np.int64) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    for q in (0, 100, 200, 300, 400, 500):
        s = sorted((-int(valid[q] @ v), i) for i, v in valid.items() if i != q and len(v) == len(valid[q]))[:10]
        assert sorted(got[q]) == [(k + 1, i, -v) for k, (v, i) in enumerate(s)]
    assert topk.exact_top_k(df.where("false"), df.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["flat", "clustered", "copies", "large", "huge"])
def test_top_k_of_a_group_in_blocks(kind, monkeypatch):
    """Matrices cut into parts, bounds that leave much, little or ties, and products beyond doubles and longs."""
    r = np.random.default_rng(3)
    n = 600 if kind == "huge" else 3000
    v = r.normal(size=(n, 16))
    if kind == "clustered":
        v = 0.05 * v + 5 * r.normal(size=(20, 16)).repeat(n // 20, 0)
    if kind == "copies":
        v[500:2500] = v[7]
    v = np.floor({"large": 2.0**26, "huge": 2.0**31}.get(kind, 1024.0) * v)
    ids, asked = r.permutation(n), np.arange(0, n, 20)
    monkeypatch.setattr(topk, "PAIRS", 5000)
    found = topk.Searcher(ids[asked], v[asked], 10)
    for lo in range(0, n, 700):
        found.add(ids[lo : lo + 700], v[lo : lo + 700])
    got = {}
    for q, d, s in found.result():
        got.setdefault(q, []).append((-s, d))
    whole = v.astype(np.int64).astype(object)
    for a in asked:
        s = sorted(zip((-(whole @ whole[a])).tolist(), ids.tolist()))
        assert got[ids[a]] == [x for x in s if x[1] != ids[a]][:10]


def test_top_k_groups_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BYTES", 1 << 14)
    monkeypatch.setattr(topk, "CANDIDATE_BYTES", 1 << 16)
    r = np.random.default_rng(4)
    v = np.round(r.normal(size=(900, 24)), 3)
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(900)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for x in topk.exact_top_k(df, df.where("vec_id % 9 = 0"), 5).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    whole = np.floor(1024 * v).astype(np.int64)
    assert set(got) == set(range(0, 900, 9))
    for q in got:
        s = sorted((-int(x), i) for i, x in enumerate(whole @ whole[q]) if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -x) for k, (x, i) in enumerate(s)]


def test_top_k_large_components(spark):
    rows = [(i, [float((i * 7919) % 1000) * 3e6, 1.0 + i, 3e9 / 1024]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = {i: [math.floor(1024 * x) for x in e] for i, e in rows}
    small = df.where("vec_id < 3")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk.exact_top_k(small, small.where("vec_id = 0"), 2).collect())
    s = sorted((-sum(a * b for a, b in zip(v[0], v[i])), i) for i in (1, 2))
    assert got == [(k + 1, i, -x) for k, (x, i) in enumerate(s)]


# Pipeline.


def test_pipeline(spark, tmp_path):
    clean = [prose(80, 600 + i) for i in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)]
    rows += [(100 + i, " ".join(prose(40, 800 + i).split()[:20] + ["vileword", "nastyword"] + prose(20, 900 + i).split()), "en", "s", 0) for i in range(30)]
    rows += [(200, clean[3], "en", "s", 0), (201, clean[3] + " end", "en", "s", 0), (202, "mail a.b1@mail.example.com now " + prose(30, 990), "en", "s", 0), (203, prose(10, 995) + " " + prose(40, 996), "en", "s", 0), (204, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 100)) for i in list(range(40)) + list(range(100, 130))], "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(40, 996))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not set(kept["toxicity"]) & set(range(100, 130)) and set(range(40)) <= set(kept["toxicity"])
    assert 3 in kept["near_duplicates"] and not {200, 201} & set(kept["near_duplicates"]) and 204 in kept["near_duplicates"]
    assert 203 not in kept["decontamination"] and 202 in kept["decontamination"]
    assert "a.b1@mail" not in kept["surrogates"][202] and kept["surrogates"][5] == clean[5]
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in last.collect()} == set(kept["surrogates"])
