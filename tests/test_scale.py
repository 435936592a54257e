"""Order statistics, dense numbers and needles of any length against plain loops."""

import random

import numpy as np
import pytest

from parley.operators import audit, joins, paired, ranking, sampling


def test_order_statistics_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [("a", float(v)) for v in rng.normal(size=501)] + [("b", float(v)) for v in rng.integers(0, 4, 300)] + [("c", 2.5), ("d", None), (None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    points = {"low": 0.0, "q1": 0.25, "mid": 0.5, "p95": 0.95, "top": 1.0}
    got = {r.g: r for r in ranking.order_statistics(df, ["g"], "v", points).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g in got:
        values = [v for x, v in rows if x == g and v is not None]
        assert got[g].n == len(values)
        assert [got[g][p] for p in points] == pytest.approx([np.quantile(values, p) for p in points.values()])
    near = {r.g: r.p for r in ranking.order_statistics(df, ["g"], "v", {"p": 0.95}, nearest=True).collect()}
    for g, p in near.items():
        assert p == sorted(v for x, v in rows if x == g and v is not None)[max(0, -(-95 * got[g].n // 100) - 1)]
    whole = ranking.order_statistics(df, [], "v", {"mid": 0.5}).first()
    assert whole["mid"] == pytest.approx(np.median([v for _, v in rows if v is not None]))
    assert ranking.order_statistics(df.where("v > 99"), ["g"], "v", points).collect() == []


def test_fences_need_enough_values(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 2, 3, 4, 100])] + [("b", 9, 1.0)], "g string, k int, v double")
    got = {r.g: r for r in audit.tukey(df, ["g"], "v", "k").collect()}
    assert (got["a"].q1, got["a"].median, got["a"].q3, got["a"].high) == (2.0, 3.0, 4.0, 7.0)
    assert got["b"].status == "insufficient_n" and got["b"].q1 is None
    assert [r.k for r in audit.outliers(df, audit.tukey(df, ["g"], "v", "k"), ["g"], "v").collect()] == [4]


def test_numbers_are_dense(spark):
    values = list(range(500))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v, "xyz"[v % 3] if v % 10 else None, v // 7) for v in values], "v int, g string, w int").repartition(7)
    assert {(r.v, r.n) for r in ranking.numbered(df, ["v"], "n").collect()} == {(v, v + 1) for v in values}
    got = {}
    for r in ranking.numbered(df, ["w", "v"], "n", ["g"]).collect():
        got.setdefault(r.g, []).append((r.n, r.v))
    assert set(got) == {"x", "y", "z", None}
    for found in got.values():
        assert [n for n, _ in sorted(found)] == list(range(1, len(found) + 1)) and [v for _, v in sorted(found)] == sorted(v for _, v in found)
    assert ranking.numbered(df.limit(0), ["v"], "n").collect() == []
    same = ranking.numbered(df.selectExpr("1 AS v"), ["v"], "n").collect()
    assert sorted(r.n for r in same) == list(range(1, 501))
    blind = sampling.blind_ids(df, "v", 5, "D").collect()
    assert sorted(r.blind_id for r in blind) == sorted(f"D{i:03d}" for i in range(1, 501))


def test_needles_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK_BYTES", 60)  # several automata
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["an", "ban", "anan", "é", "xé y", "tree", "three words here now then"]) for _ in range(rng.randint(0, 9)))) for i in range(80)] + [(80, None), (81, ""), (82, "ban" * 50_000)]
    needles = [(f"n{i}", w) for i, w in enumerate(["an", "ana", "é", "tree", "", "xé y", "nothing", "an", None, "words here", "ban ban", "tree three words here now then an", "n b"])]
    df, hay = spark.createDataFrame(needles, "nid string, w string"), spark.createDataFrame(texts, "hid int, t string")
    got = joins.contains_join(df, "nid", "w", hay, "hid", "t")
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    assert {tuple(r) for r in got.collect()} == {(n, i) for n, w in needles if w is not None for i, t in texts if t is not None and w in t}
    assert got.count() == len({tuple(r) for r in got.collect()})
    assert joins.contains_join(df.where("w = 'tree three words here now then an'"), "nid", "w", hay, "hid", "t").where("hid >= 80").collect() == []
    assert joins.contains_join(df.limit(0), "nid", "w", hay, "hid", "t").collect() == [] == joins.contains_join(df, "nid", "w", hay.limit(0), "hid", "t").collect()


def test_population_by_name(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "scenario_id string, v int")
    known = {"all": None, "some": ["a"], "table": rows.where("v = 3")}
    assert [paired.named_population(rows, n, known).count() for n in known] == [3, 2, 1]
    with pytest.raises(ValueError, match="'other'"):
        paired.named_population(rows, "other", known)


def test_equal_prompts_and_transcripts_meet_once(spark, monkeypatch):
    same, own = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    talks = spark.createDataFrame([(i, same) for i in range(40)] + [(90, own), (91, "short"), (92, None)], "k int, t string")
    calls = [(f"ask {same} end", "a", i) for i in range(40)] + [(f"ask {own} end", f"b{i}", i) for i in range(9)] + [("a short one", "c", 1), (f"{own} and {same}", "d", 99), (None, "e", 5)]
    sizes, plain = [], joins.contains_join
    monkeypatch.setattr(joins, "contains_join", lambda n, i, c, h, j, t: (sizes.append((n.count(), h.count())), plain(n, i, c, h, j, t))[1])
    got = joins.reconstruct(spark.createDataFrame(calls, "p string, a string, at int"), "p", "a", talks, "k", "t", "at")
    assert sorted(map(tuple, got.collect())) == [(90, "b8"), (91, "c")] and sizes == [(4, 5)]


def test_census_deals_rows_by_the_number_of_jobs(spark, monkeypatch):
    monkeypatch.setattr(audit, "ROWS", 20)
    ids = spark.range(100)
    logs = ids.where("id <> 7").selectExpr("id", "'ok' AS status", "5 AS n_records", "CAST(NULL AS string) AS failure_kind", "CAST(NULL AS string) AS failure_reason")
    none = ids.where("id < 0")
    audited = audit.census(ids, logs, ids, ids, none.selectExpr("id", "'' AS reason"), none, "id")
    assert [tuple(r) for r in audit.anomalies(ids, ids, ids, audited, "id").collect()] == [("missing_dialogue", "7")]
    assert "hashpartitioning(id" in (plan := audited._jdf.queryExecution().executedPlan().toString()) and ", 5)" in plan
