"""Nearest neighbours, conversation repair and ranked search against brute force, SQL and odd rows."""

import hashlib
import itertools
import math
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from parley.llm import dialogues, lexical, multiindex

DATA = "/root/testdata/sf0.001"


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    return con.sql(sql).fetchall()


# --- op11


def brute_neighbours(rows, k):
    out = {}
    for qid, q in rows:
        if qid % 100 == 0:
            far = sorted((math.dist(q, v), i) for i, v in rows if i != qid and len(v) == len(q))
            out[qid] = far[:k]
    return out


def test_walk_is_ascending_and_complete():
    rng = np.random.default_rng(3)
    a, b = rng.random(7), rng.random(5)
    a[3] = a[2]
    held = rng.integers(0, 3, 35)
    cells = list(multiindex.walk(a, b, held, int(held.sum())))
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sums == sorted(sums)
    assert sorted(cells) == np.flatnonzero(held).tolist()
    few = list(multiindex.walk(a, b, held, 4))
    assert few == cells[: len(few)] and held[few].sum() >= 4 > held[few[:-1]].sum()


def test_full_recall_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "GROUP_BYTES", 4096)  # several groups of rows and of queries
    monkeypatch.setattr(multiindex, "QUERY_BYTES", 256)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(601)]
    rows[50] = (50, rows[100][1])
    rows[300] = (300, rows[100][1])  # equal distances go to the smaller id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in multiindex.nearest_neighbours(df, df.where("vec_id % 100 = 0"), recall=1.0, centroids=8).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    true = brute_neighbours(rows, 10)
    hits = 0
    for q, best in true.items():
        found = [got[q][i] for i in range(1, 11)]
        assert found == sorted(found)
        hits += len({i for _, i in best} & {i for _, i in found})
    assert hits == 70
    assert got[100][1][1] == 50 and got[100][2][1] == 300 and got[300][1][1] == 50


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_recall_on_the_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    true = brute_neighbours(rows, 10)
    vector = dict(rows)
    hits = 0
    found = multiindex.op11_multiindex(spark, DATA).collect()
    for r in found:
        hits += r.vec_id in {i for _, i in true[r.query_id]}
        assert r.score == pytest.approx(math.dist(vector[r.query_id], vector[r.vec_id]), rel=1e-12)
    assert len(found) == 10 * len(true)
    assert hits >= 0.9 * 10 * len(true)


def test_neighbours_of_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 2), (2, None, 1), (3, [], 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1),
        (7, [float("inf"), 1.0], 1), (None, [1.0, 2.0], 1), (8, [1.0, 2.0, 3.0], 1), (100, [1.0, 2.0, 4.0], 1), (200, [5.0], 1), (9, [2.0], 1), (0, [9.0, 9.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = sorted(map(tuple, multiindex.nearest_neighbours(df, df.where("vec_id % 100 = 0")).collect()))
    assert got == [(0, 1, 1, 0.0), (0, 2, 1, 0.0), (100, 1, 8, 1.0), (200, 1, 9, 3.0)]
    assert multiindex.nearest_neighbours(df.limit(0), df.limit(0)).collect() == []
    assert multiindex.nearest_neighbours(df, df.where("vec_id = 77")).collect() == []


# --- op12


def brute_repair(symbols):
    best = [None]

    def grow(i, audit, cost, initials):
        if best[0] and cost > best[0][0] or audit.count("I") > 4:
            return
        if i == len(symbols) and re.fullmatch("(s?(ua)+)?", initials) and (best[0] is None or (cost, audit) < best[0]):
            best[0] = (cost, audit)
        for w in "ua":
            grow(i, audit + "I", cost + 2, initials + w)
        if i < len(symbols):
            c, cut = symbols[i], int(symbols[i].isupper())
            grow(i + 1, audit + "D", cost + 3, initials)
            if c != "x":
                if c.lower() != "o":
                    grow(i + 1, audit + "K", cost + cut, initials + c.lower())
                for w in "ua":
                    grow(i + 1, audit + "R", cost + 2 + cut, initials + w)

    grow(0, "", 0, "")
    return best[0]


def test_parse_is_the_cheapest_and_least():
    for n in range(4):
        for symbols in map("".join, itertools.product("suaoUAx", repeat=n)):
            assert dialogues.parse(symbols) == brute_repair(symbols), symbols
    for symbols in ("uuSaxa", "oooou", "assuUA", "aaaaxx"):
        assert dialogues.parse(symbols) == brute_repair(symbols), symbols


def test_long_conversation_is_linear():
    cost, audit = dialogues.parse("s" + "ua" * 50_000 + "u")
    assert (cost, len(audit)) == (2, 100_003) and audit == "K" * 100_002 + "I"
    assert dialogues.parse("o" * 20_000)[0] == 40_000


CONVERSATIONS = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 2, None, None), (2, None, "user", "no end"), (2, None, "assistant", "b."), (2, 5, "tool", "c!"),
    (3, 0, "user", " \t\n"), (None, 0, "user", "q?"), (None, 1, "assistant", "a."), (4, 0, "assistant", "only."), (4, 0, "assistant", "x" * 200_000 + "."), (5, 3, "", "empty role."), (5, 9, "User", "wrong case."),
]


def test_query_on_odd_rows_equals_sql(spark, tmp_path):
    rows = CONVERSATIONS + [(c, t, r, x) for c in range(10, 60) for t, (r, x) in enumerate([("system", "Be kind."), ("user", f"Go {c}."), ("assistant", "Ok."), ("user", "more"), ("user", "Why?")])]
    df = spark.createDataFrame([(*r, "other") for r in rows], "conv_id long, turn long, role string, text string, copy string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    found = dialogues.op12_earley(spark, str(tmp_path))
    conversations = df.toArrow()
    expected = sql_rows(f"SELECT {', '.join(found.columns)} FROM ({dialogues.ORACLE_SQL['op12_earley']})", conversations=conversations)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)
    df.limit(0).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert dialogues.op12_earley(spark, str(tmp_path / "none")).collect() == []


def test_repaired_rows(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    parsed = dialogues.parse_conversations(df)
    edits = {}
    for r in dialogues.repair_conversations(df, parsed).collect():
        edits.setdefault(r.conv_id, []).append((r.place, r.edit, r.role, r.text))
    audits = {r.conv_id: (r.cost, r.audit) for r in parsed.collect()}
    assert {c: "".join(e[1] for e in sorted(found)) for c, found in edits.items()} == {c: a for c, (_, a) in audits.items()}
    assert audits[1] == (6, "KKDD") and audits[3] == (3, "D") and audits[None] == (0, "KK") and audits[2] == (5, "IKKR")
    assert edits[1][1] == (1, "K", "assistant", "Yes.")
    for c, found in edits.items():
        left = [e for e in sorted(found) if e[1] != "D"]
        assert re.fullmatch("(s?(ua)+)?", "".join(e[2][0] for e in left)), c
    digests = {r.conv_id: r.repaired_sha256 for r in dialogues.repaired_digests(dialogues.repair_conversations(df, parsed)).collect()}
    assert digests[None] == hashlib.sha256(b"user:q?\nassistant:a.").hexdigest()


# --- op13


def test_codes_come_back():
    values = np.array([1, 127, 128, 16_383, 16_384, 2**40, 0, 5])
    data, ends = lexical.encode(values)
    assert lexical.decode(data).tolist() == values.tolist()
    assert ends.tolist() == [1, 2, 4, 6, 9, 15, 16, 17]
    assert lexical.decode(np.zeros(0, np.uint8)).tolist() == []


def terms(text):
    return re.findall(lexical.TERM, (text or "").translate(str.maketrans(lexical.UPPER, lexical.LOWER)))


def brute_ranks(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, text in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(text))
    out = []
    for i, some in asked.items():
        found = []
        for d, c in counts:
            m = 50 + 50 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in some if c[t])
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_ranks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_BYTES", 2000)
    monkeypatch.setattr(lexical, "SHARDS", 3)
    monkeypatch.setattr(lexical, "QUERY_TERMS", 10)
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(40)] + ["Élan", "ÉLAN", "a_b", "9"]
    odds = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(rng.choice(words, n, p=odds / odds.sum()))
    docs = [(int(i), text(rng.integers(1, 60))) for i in rng.permutation(300)] + [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w1 w39"), (900, None), (901, "..."), (902, ""), (903, "w1 " * 60_000)]
    items = [(i, text(6)) for i in range(9)] + [(9, None), (10, "nowhere"), (None, "w1"), (3, "w0 w39"), (11, "W1 w1")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, score int").repartition(3)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int")
    for k in (5, 50):
        assert sorted(map(tuple, lexical.rank_documents(lexical.index_documents(d), q, k=k).collect())) == brute_ranks(docs, items, k)
    assert lexical.rank_documents(lexical.index_documents(d.limit(0)), q).collect() == []
    assert lexical.rank_documents(lexical.index_documents(d), q.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("module, name", [(lexical, "op13_lexical"), (dialogues, "op12_earley")])
def test_queries_equal_sql(spark, module, name):
    found = module.QUERIES[name](spark, DATA)
    tables = {t: spark.read.parquet(f"{DATA}/{t}.parquet").toArrow() for t in ("documents", "benchmark", "conversations")}
    expected = sql_rows(f"SELECT {', '.join(found.columns)} FROM ({module.ORACLE_SQL[name]})", **tables)
    assert sorted(map(tuple, found.collect())) == sorted(expected)
