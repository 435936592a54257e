"""Inclusion, digests, exports, instruments, sheets, graphs and recovery on small literal tables."""

import hashlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from parley.operators import agreement, checks, flow, inclusion, provenance, replay, validation
from parley.sources.scratch import written

LOGS = [
    ("edge_01__fsm__rep01", "failed", "instrument", "retry"), ("edge_02__fsm__rep01", "ok", None, None), ("edge_03__fsm__rep01", "failed", "simulation", "turns"),
    ("edge_04__fsm__rep01", "failed", "instrument", "retry"), ("edge_04__fsm__rep01", "failed", "instrument", "retry"), ("edge_05__fsm__rep01", "failed", "instrument", "retry"),
]
LOG = "dialogue_id string, status string, failure_kind string, failure_reason string"


@pytest.fixture
def logs(spark):
    return spark.createDataFrame(LOGS, LOG)


def select(spark, *ids):
    return spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "dialogue_id string, place long")


def test_selection_lists_every_refusal(spark, logs):
    census, candidates = inclusion.discover(logs, "instrument", "retry")
    assert {(r.failure_kind, r.n, r.target) for r in census.collect()} == {("instrument", 4, True), ("simulation", 1, False)}
    chosen = select(spark, "edge_01__fsm__rep01", "edge_02__fsm__rep01", "edge_03__fsm__rep01", "edge_04__fsm__rep01", "edge_09__fsm__rep01", "edge_1__rep01", "edge_05__fsm__rep01", "edge_05__fsm__rep01", None)
    checked, counts = inclusion.check_selection(chosen, logs, candidates.where("dialogue_id <> 'edge_01__fsm__rep01'"), "instrument", "retry")
    refused = {(r.dialogue_id, r.rule) for r in inclusion.refused(checked).collect()}
    assert refused == {
        ("edge_01__fsm__rep01", "not_discovered"), ("edge_02__fsm__rep01", "status"), ("edge_02__fsm__rep01", "failure_class"), ("edge_02__fsm__rep01", "not_discovered"),
        ("edge_03__fsm__rep01", "failure_class"), ("edge_03__fsm__rep01", "not_discovered"), ("edge_04__fsm__rep01", "several_logs"), ("edge_09__fsm__rep01", "not_in_run"),
        ("edge_1__rep01", "malformed_id"), ("edge_05__fsm__rep01", "repeated_id"), (None, "malformed_id"),
    }
    with pytest.raises(ValueError, match="'not_discovered': 3"):
        inclusion.require_accepted(counts)


def test_lock_is_idempotent(spark, logs, tmp_path):
    _, candidates = inclusion.discover(logs, "instrument", "retry")
    path = str(tmp_path / "lock")
    one = inclusion.lock(select(spark, "edge_05__fsm__rep01", "edge_01__fsm__rep01"), logs, candidates, "instrument", "retry", path)
    assert inclusion.lock(select(spark, "edge_01__fsm__rep01", "edge_05__fsm__rep01"), logs, candidates, "instrument", "retry", path) == one
    with pytest.raises(ValueError, match="another selection"):
        inclusion.lock(select(spark, "edge_01__fsm__rep01"), logs, candidates, "instrument", "retry", path)
    assert inclusion.lock(select(spark, "edge_01__fsm__rep01"), logs, candidates, "instrument", "retry", path, replace=True) != one
    assert [r.dialogue_id for r in spark.read.parquet(path).collect()] == ["edge_01__fsm__rep01"]
    with pytest.raises(ValueError, match="refused"):
        inclusion.lock(select(spark, "edge_02__fsm__rep01"), logs, candidates, "instrument", "retry", path, replace=True)


def test_provenance_refuses_unlisted_failures(spark, logs):
    scored = spark.createDataFrame([("edge_01__fsm__rep01", 1.0), ("edge_02__fsm__rep01", 2.0)], "dialogue_id string, m double")
    rows = inclusion.with_provenance(scored, logs, select(spark, "edge_01__fsm__rep01"), "false_positive", "list.json")
    assert {(r.dialogue_id, r.runtime_status, r.adjudication, r.inclusion_source) for r in rows.collect()} == {("edge_01__fsm__rep01", "failed", "false_positive", "list.json"), ("edge_02__fsm__rep01", "ok", None, "status=ok")}
    assert {tuple(r) for r in inclusion.inclusion_record(rows).collect()} == {("list.json", 1, 0, 1), ("status=ok", 1, 1, 0)}
    with pytest.raises(Exception, match="not listed"):
        inclusion.with_provenance(scored, logs, select(spark), "x", "y").collect()


def plain_digest(rows, columns):
    text = ["".join("-" if v is None else f"{len(str(v))}:{v}" for v in row) for row in rows]
    leaves = sorted(hashlib.sha256(t.encode()).hexdigest() for t in text)
    lines = [(leaf, sum(1 for _ in same)) for leaf, same in groupby(leaves)]
    fold = lambda parts, n: [(k, hashlib.sha256("\n".join(sorted(f"{a}:{b}" for a, b in same)).encode()).hexdigest()) for k, same in groupby(parts, lambda x: x[0][:n])]
    top = fold(fold(lines, 5), 2)
    return hashlib.sha256((",".join(columns) + "\n" + "\n".join(f"{a}:{b}" for a, b in top)).encode()).hexdigest()


def test_digest_is_a_plain_loops(spark):
    rows = [(i % 700, None if i % 11 == 0 else f"t{i % 90}") for i in range(3000)] + [(1, "12:a"), (112, ":a")]
    df = spark.createDataFrame(rows, "a int, b string")
    found = {provenance.table_digest(df.repartition(n).orderBy("b") if n % 2 else df.repartition(n), ["a", "b"]).first()["digest"] for n in (1, 2, 5)}
    assert found == {plain_digest(rows, ["a", "b"])}
    other = df.withColumn("b", F.when((F.col("a") == 5) & (F.col("b") == "t5"), "t6").otherwise(F.col("b")))
    assert provenance.table_digest(other, ["a", "b"]).first()["digest"] not in found
    touched = provenance.changed_rows(provenance.chunk_digests(df, ["a", "b"]), other, ["a", "b"])
    assert (5, "t6") in {tuple(r) for r in touched.collect()} and touched.count() < 200
    empty = provenance.table_digest(df.limit(0), ["a", "b"]).first()
    assert (empty["digest"], empty["n"]) == (plain_digest([], ["a", "b"]), 0)


def test_export_gates(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    want = provenance.table_digest(df, df.columns).first()["digest"]
    none = df.where("id < 0")
    for bad in ({"t": "0"}, {}):
        with pytest.raises(ValueError, match="not as expected"):
            provenance.gated_export({"t": df}, str(tmp_path / "no"), none, bad)
    with pytest.raises(ValueError, match="broken"):
        provenance.gated_export({"t": df}, str(tmp_path / "no"), df.limit(1), {"t": want})
    assert not (tmp_path / "no").exists()
    out = str(tmp_path / "out")
    provenance.gated_export({"t": df}, out, none, {"t": want})
    assert provenance.verified(spark, out, "t").count() == 100
    df.limit(1).write.mode("append").parquet(f"{out}/t")
    with pytest.raises(ValueError, match="recorded is"):
        provenance.verified(spark, out, "t")


def test_artifacts_and_frames(spark):
    pairs = lambda *r: spark.createDataFrame(r, "name string, digest string")
    found = provenance.differing_artifacts(pairs(("a", "1"), ("b", "2"), ("c", "3")), pairs(("a", "1"), ("b", "9"), ("d", "4")))
    assert {tuple(r) for r in found.collect()} == {("b", "changed"), ("c", "missing"), ("d", "not_recorded")}
    frame = spark.createDataFrame([("g", 2, "u2", "b"), ("g", 1, "u1", None), ("h", 1, None, "x")], "g string, o int, u string, t string")
    assert {tuple(r) for r in provenance.frame_digests(frame, ["g"], ["o"], "u", "t").collect()} == {("g", hashlib.sha256(b"u1u2b").hexdigest()), ("h", hashlib.sha256(b"x").hexdigest())}


def test_census_faults(spark):
    rows = [("ok", None, "excluded_unscored", "excluded_unscored"), ("ok", None, "included_semantic", "included_frozen"), ("failed", "instrument_true_failure", "excluded_failure", "excluded_failure"), ("failed", None, None, None)]
    audited = spark.createDataFrame(rows, "execution_status string, failure_class string, primary_status string, frozen_status string")
    assert {tuple(r) for r in inclusion.census_faults(audited, {"jobs": 4, "ok": 3, "unscored": 1, "semantic": 1}).collect()} == {("ok", 3, 2), ("parts_of_jobs", 4, 3)}
    with pytest.raises(ValueError, match="no such"):
        inclusion.census_faults(audited, {"other": 1})


def test_instrument_report_equals_the_single_measures(spark):
    rows = [("g", "yes", "yes", "low", "high"), ("g", "no", "yes", "low", "low"), ("g", "uncertain", "yes", "high", "high"), ("g", "yes", None, "mid", "low"), ("g", "no", "no", "mid", "mid"), ("h", None, "no", "low", "low")]
    df = spark.createDataFrame(rows, "g string, ta string, tb string, oa string, ob string")
    labels = agreement.long_labels(df, ["g"], {"task": ("ta", "tb"), "size": ("oa", "ob")})
    order = ["low", "mid", "high"]
    got = {(r.g, r.field): r for r in agreement.instrument_report(labels, ["g"], {"size": order}, ("uncertain",)).collect()}
    task = got["g", "task"]
    whole = df.where("ta IN ('yes', 'no') AND tb IS NOT NULL AND g = 'g'")
    assert (task.n, task.n_excluded, task.weighted_kappa, task.bias) == (3, 2, None, None)
    assert task.kappa == pytest.approx(agreement.cohen_kappa(whole, "ta", "tb", ["g"]).first()["kappa"])
    assert got["g", "size"].weighted_kappa == pytest.approx(agreement.weighted_kappa(df.where("g = 'g'"), "oa", "ob", ["g"], order).first()["weighted_kappa"])
    assert got["g", "size"].bias == pytest.approx((2 + 0 + 0 - 1 + 0) / 5)
    assert (got["h", "task"].n, got["h", "task"].n_excluded, got["h", "task"].agreement, got["h", "task"].kappa) == (0, 1, None, None)
    assert (got["h", "size"].agreement, got["h", "size"].kappa, got["h", "size"].weighted_kappa) == (1.0, 1.0, 1.0)
    with pytest.raises(Exception, match="unknown label"):
        agreement.instrument_report(labels, ["g"], {"size": ["low", "mid"]}).collect()


def test_sheets_that_break_each_rule(spark):
    d = spark.createDataFrame([("D001", "yes"), ("D002", "perhaps"), ("D009", None), ("D001", "no")], "blind_dialogue_id string, task_completed string")
    r = spark.createDataFrame([("D001-R1", "D001", "F01; F77,F02"), ("D001-R1", "D001", None), ("D002-R1", "D005", "F01"), ("R3", "D002", "")], "blind_response_id string, blind_dialogue_id string, fact_ids_stated string")
    c = spark.createDataFrame([("D001-R1-C1", "D001-R1", "said", "supported"), ("D001-R1-C1", "D001-R1", " ", "maybe"), ("C9", "D7", "x", None)], "claim_id string, blind_response_id string, claim_text string, support string")
    facts = spark.createDataFrame([("F01",), ("F02",)], "id string")
    got = sorted((x.sheet, x.id, x.rule, x.value) for x in validation.frozen_sheet_faults(d, r, c, facts).collect() if x.value is not None)
    assert got == sorted([
        ("dialogues", "D009", "id_not_dense", "D009"), ("dialogues", "D001", "id_repeats", "D001"), ("dialogues", "D001", "id_repeats", "D001"), ("dialogues", "D002", "task_invalid", "perhaps"),
        ("responses", "D001-R1", "id_repeats", "D001-R1"), ("responses", "D001-R1", "id_repeats", "D001-R1"), ("responses", "D002-R1", "unknown_dialogue", "D005"), ("responses", "D002-R1", "not_a_child", "D002-R1"),
        ("responses", "R3", "not_a_child", "R3"), ("responses", "D001-R1", "unknown_fact", "F77"), ("responses", "D001-R1", "unknown_fact", "F77"),
        ("claims", "D001-R1-C1", "id_repeats", "D001-R1-C1"), ("claims", "D001-R1-C1", "id_repeats", "D001-R1-C1"), ("claims", "D001-R1-C1", "text_missing", "D001-R1-C1"), ("claims", "D001-R1-C1", "support_invalid", "maybe"),
        ("claims", "C9", "unknown_response", "D7"), ("claims", "C9", "not_a_child", "C9"),
    ])


def test_packet_hides_what_it_must(spark):
    d = spark.createDataFrame([("D001", "", ""), ("D002", "yes", "")], "blind_dialogue_id string, task_completed string, notes string")
    r = spark.createDataFrame([("D001-R1", "D001", "", "", "The FSM says"), ("D002-R1", "D002", "", "note", "fine")], "blind_response_id string, blind_dialogue_id string, fact_ids_stated string, notes string, text string")
    m = spark.createDataFrame([("D001", "edge_1", "fsm"), ("D003", "edge_1", "")], "blind_dialogue_id string, dialogue_id string, condition string")
    got = {(x.sheet, x.id, x.rule) for x in validation.packet_faults(d, r, m, ["fsm"]).collect()}
    assert got == {
        ("dialogues", "D002", "judgement_filled"), ("responses", "D002-R1", "judgement_filled"), ("responses", "D001-R1", "metadata_leak"), ("mapping", "D003", "unknown_dialogue"),
        ("mapping", "D001", "dialogue_repeats"), ("mapping", "D003", "dialogue_repeats"), ("mapping", "D003", "condition_missing"), ("mapping", "D002", "not_mapped"),
    }


def test_reachable_and_closure(spark):
    edges = [("e", "a", "b"), ("e", "b", "c"), ("e", "c", "a"), ("e", "d", "e"), ("w", "*", "f"), ("e", "f", "g")]
    df = spark.createDataFrame(edges, "event string, source string, dest string")
    assert {r.state for r in flow.reachable(df, "a").collect()} == set("abcfg")
    assert {r.state for r in flow.reachable(df, spark.createDataFrame([("d",), ("d",), ("g",)], "state string")).collect()} == set("defg")
    assert flow.reachable(df, df.where("event = 'none'").select(F.col("dest").alias("state"))).collect() == []
    assert {tuple(r) for r in flow.closure(df).collect()} == {(x, y) for x in "abc" for y in "abc"} | {("d", "e"), ("f", "g")}
    chain = spark.createDataFrame([("e", str(i), str(i + 1)) for i in range(9)], "event string, source string, dest string")
    assert flow.reachable(chain, "0").count() == 10 and flow.closure(chain).count() == 45


def test_rounds_do_not_send_what_was_seen_to_the_driver(spark, monkeypatch):
    plans = []

    def spied(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(flow, "written", spied)
    chain = [("e", str(i), str(i + 1)) for i in range(6)] + [("e", "0", "4"), ("e", "3", "1"), ("e", "2", None), ("e", "5", None)]
    edges = spark.createDataFrame(chain, "event string, source string, dest string")
    found, pairs = flow.reachable(edges, "0"), flow.closure(edges)
    rounds = [p for p in plans if "Join" in p]
    assert len(rounds) > 6
    # Of a round's tables only the last round's rows, or the edges, may be broadcast, and no plan grows with the rounds.
    assert all(p.count("BroadcastExchange") <= 1 and p.count("FileScan parquet") <= 3 for p in rounds)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert sorted((r.state for r in found.collect()), key=str) == sorted(["0", "1", "2", "3", "4", "5", "6", None], key=str)
    got = [tuple(r) for r in pairs.collect()]  # an end that is null comes once too
    assert len(got) == len(set(got))
    assert set(got) == {(x, y) for x in "123" for y in "123456"} | {("0", y) for y in "123456"} | {("4", "5"), ("4", "6"), ("5", "6")} | {(x, None) for x in "012345"}


def test_division(spark):
    pairs = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1), ("c", 2), ("c", 1), ("c", 3), ("d", None)], "k string, m int")
    wanted = spark.createDataFrame([(1,), (2,), (2,), (None,)], "m int")
    assert {r.k for r in checks.keys_holding_all(pairs, "k", "m", wanted).collect()} == {"a", "c"}
    assert {r.k for r in checks.keys_holding_all(pairs, "k", "m", wanted.limit(0)).collect()} == {"a", "b", "c", "d"}


def test_recovery_needs_the_whole_history(spark):
    message = "array<struct<role:string,content:string>>"
    talk = [("user", "hi"), ("assistant", "hi"), ("user", "hi")]
    d = spark.createDataFrame([(1, 7, "p", "g", talk), (2, 9, "p", "g", [("user", "hihi")]), (3, 5, "q", "g", talk)], f"k int, seed long, persona string, goal string, messages {message}")
    calls = [("p", "g", talk[:2], '{"message": "b", "status": "continue"}', 2, "x"), ("p", "g", talk[:2], "oops", 1, "y"), ("p", "g", [("user", "h"), ("assistant", "ihi")], "no", 1, "z"), ("p", "g", [], '{"message": "a"}', 1, "w")]
    c = spark.createDataFrame(calls, f"persona string, goal string, messages {message}, text string, timestamp int, prompt_hash string")
    got = sorted((r.k, r.turn, r.attempt, r.seed, r.text, r.reply.message if r.reply else None) for r in replay.retry_candidates(d, c, ["k"], "message string, status string").collect())
    assert got == [(1, 0, 0, 7, '{"message": "a"}', "a"), (1, 2, 0, 7, "oops", None), (1, 2, 1, 8, '{"message": "b", "status": "continue"}', "b"), (2, 0, 0, 9, '{"message": "a"}', "a")]
