"""Operators on small literal tables with results worked out by hand."""

import json
import hashlib
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from parley.functions import cells, texts
from parley.operators import agreement, audit, calls, cases, flow, joins, paired, ranking, replay, resampling, sampling, scoring, script, stats, tables, twister
from parley.plans import registry


def one(spark, expr, **values):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_parse_cell(spark):
    df = spark.createDataFrame([("",), (None,), (" 1.5 ",), ("True",), ("false",)], "c string")
    assert [r[0] for r in df.select(cells.parse_cell(F.col("c"))).collect()] == [None, None, 1.5, 1.0, 0.0]
    with pytest.raises(Exception, match="CAST|cast"):
        spark.createDataFrame([("x1",)], "c string").select(cells.parse_cell(F.col("c"))).collect()


def test_ids(spark):
    df = spark.createDataFrame([("a__b__baseline__rep02",), ("a__other__rep01",), ("a__fsm__rep2",)], "v string")
    got = [r[0] for r in df.select(cells.parse_dialogue_id(F.col("v"))).collect()]
    assert (got[0].scenario_id, got[0].agent, got[0].repetition) == ("a__b", "baseline", 2)
    assert got[1] is None and got[2] is None
    assert one(spark, cells.dialogue_seed(42, F.lit("edge_01"), F.lit(1))) == one(spark, cells.dialogue_seed(42, F.lit("edge_01"), F.lit(1)))
    with pytest.raises(Exception, match="no category"):
        spark.range(1).select(cells.category_of(F.lit("odd_1"))).collect()


ROWS = [("edge", "edge_01", "baseline", 1, 1.0), ("edge", "edge_01", "baseline", 2, None), ("edge", "edge_01", "fsm", 1, 3.0), ("edge", "edge_02", "fsm", 1, 2.0), ("edge", "edge_03", "baseline", 1, None), ("edge", "edge_03", "fsm", 1, 2.0), ("happy_path", "happy_path_01", "baseline", 1, 5.0), ("happy_path", "happy_path_01", "fsm", 1, 5.0), ("happy_path", "happy_path_01", "third", 1, 9.0)]


def test_pairing_skips_nulls_and_unpaired(spark):
    rows = spark.createDataFrame(ROWS, "category string, scenario_id string, agent string, repetition int, m double")
    scores = paired.aggregate_to_scenarios(paired.long_metrics(rows, ["m"]))
    pairs = {r["scenario_id"]: r["diff"] for r in paired.pair_scenarios(scores).collect()}
    assert pairs == {"edge_01": 2.0, "happy_path_01": 0.0}
    wtl = {r["stratum"]: (r["wins"], r["ties"], r["losses"]) for r in paired.wins_ties_losses(paired.with_strata(paired.pair_scenarios(scores))).collect()}
    assert wtl == {"overall": (1, 1, 0), "edge": (1, 0, 0), "happy_path": (0, 1, 0)}
    un = {r["stratum"]: r["n_unpaired"] for r in paired.unpaired(paired.with_strata(scores)).collect()}
    assert un["overall"] == 2
    miss = {r["stratum"]: (r["complete_pairs"], r["residual"], r["baseline_na"]) for r in paired.missingness(paired.with_strata(rows), "m").collect()}
    assert miss["overall"] == (2, 2, 2)


def test_average_ranks_match_a_plain_ranking(spark):
    rng = random.Random(1)
    values = [(g, float(rng.randrange(40))) for g in "ab" for _ in range(300)]
    got = {(r["g"], r["v"]): r["rank"] for r in ranking.average_ranks(spark.createDataFrame(values, "g string, v double"), ["g"], "v").collect()}
    for g in "ab":
        ordered = sorted(v for h, v in values if h == g)
        for v in set(ordered):
            at = [i + 1 for i, x in enumerate(ordered) if x == v]
            assert got[g, v] == sum(at) / len(at)


def diffs(spark, values):
    return spark.createDataFrame([("m", f"s{i:03d}", float(d)) for i, d in enumerate(values)], "metric string, scenario_id string, diff double")


def test_rank_biserial(spark):
    # Ranks of |3|, |-1|, |2|: 3, 1, 2.
    assert stats.rank_biserial(diffs(spark, [3, -1, 2, 0]), ["metric"]).first()["rank_biserial"] == pytest.approx(4 / 6)
    assert stats.rank_biserial(diffs(spark, [0, 0]), ["metric"]).first()["rank_biserial"] == 0.0


def test_wilcoxon_exact_and_normal():
    assert stats.wilcoxon_two_sided([1, 2, 3, 4, 5]) == pytest.approx(2 / 32)
    assert stats.wilcoxon_two_sided([0.0, 0.0]) == 1.0
    assert stats.wilcoxon_two_sided([1, -2, 3]) == pytest.approx(0.75)
    assert 0 < stats.wilcoxon_two_sided([1.0, 1.0, 2.0, -1.0, 3.0]) < 1


def test_permutation_matches_its_definition(spark):
    rng, hits = random.Random(42), 0
    for _ in range(7):
        hits += abs(sum(rng.choice((1, -1)) * x for x in (3, 1, 0))) >= 4
    assert stats.permutation_two_sided([3.0, 1.0, 0.0], 7) == (hits + 1) / 8
    assert stats.permutation_p(diffs(spark, [3, 1, 0]), ["metric"], 7).first()["permutation_p"] == (hits + 1) / 8


@pytest.mark.parametrize("values", [[0.1, -0.25, 1 / 3, 2.0, 0.0, -1e-12, 7e15], [0.5], [0.1 * (i % 7) - 0.2 for i in range(100)]])
def test_resamples_equal_plain_draws(values, monkeypatch):
    monkeypatch.setattr(stats, "DRAWS", 300)
    exact, n = [Fraction(v) for v in values], len(values)
    rng, flips = random.Random(42), []
    for _ in range(50):
        flips.append(abs(float(sum(x * rng.choice((1, -1)) for x in exact) / n)))
    assert stats.permutation_two_sided(values, 50) == (sum(f >= abs(float(sum(exact) / n)) for f in flips) + 1) / 51
    rng = random.Random(42)
    means = sorted(float(sum(exact[rng.randrange(n)] for _ in range(n)) / n) for _ in range(50))
    assert stats.bootstrap_interval(values, 50) == (stats.percentile(means, 2.5), stats.percentile(means, 97.5))


def test_seeded_queries_draw_all_resamples(monkeypatch):
    monkeypatch.setattr(registry, "_pairs", lambda *_: None)
    monkeypatch.setattr(registry, "e_frame", lambda *_: None)
    for name in ("permutation_p", "bootstrap_mean_ci"):
        monkeypatch.setattr(stats, name, lambda pairs, groups, n_resamples=stats.N_RESAMPLES: n_resamples)
    monkeypatch.setattr(registry.tables, "tests", lambda *_, n_resamples=stats.N_RESAMPLES: n_resamples)
    assert [registry.QUERIES[q](None, "") for q in ("q_permutation", "q_bootstrap", "q_test_table")] == [10_000] * 3


def test_bootstrap_bounds():
    low, high = stats.bootstrap_interval([1.0, 2.0, 3.0], 200)
    assert 1 <= low <= high <= 3
    assert stats.percentile([1.0, 2.0, 3.0, 4.0], 50) == 2.5


def test_holm_never_falls(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.02), ("f", "c", 0.9)], "family string, metric string, p double")
    got = {r["metric"]: r["p_holm"] for r in stats.holm(df, "p", ["family"], ["metric"]).collect()}
    assert got == {"a": pytest.approx(0.03), "b": pytest.approx(0.04), "c": pytest.approx(0.9)}


def test_fact_scores(spark):
    f = one(spark, scoring.fact_scores(F.array(*map(F.lit, ["F01", "F02"])), F.array(*map(F.lit, ["F02", "F03", "F03"])), F.lit(1), F.lit(3)))
    assert (f["tp"], f["fp"], f["fn"]) == (1, 2, 1)
    assert f["fact_precision"] == pytest.approx(1 / 3) and f["claim_support"] == 0.75
    none = one(spark, scoring.fact_scores(F.array(F.lit("F01")), F.array().cast("array<string>"), F.lit(0), F.lit(0)))
    assert none["fact_f1"] == 0 and none["claim_support"] is None


def test_kappa_extremes(spark):
    df = spark.createDataFrame([("g", "a", "a"), ("g", "a", "a"), ("h", "a", "b"), ("h", "b", "a")], "g string, x string, y string")
    got = {r["g"]: r["kappa"] for r in agreement.cohen_kappa(df, "x", "y", ["g"]).collect()}
    assert got == {"g": 1.0, "h": -1.0}
    w = {r["g"]: r["weighted_kappa"] for r in agreement.weighted_kappa(df, "x", "y", ["g"], ["a", "b"]).collect()}
    assert w == {"g": 1.0, "h": -1.0}
    with pytest.raises(Exception, match="unknown label"):
        agreement.weighted_kappa(df, "x", "y", ["g"], ["a"]).collect()


def test_flow(spark):
    edges = spark.createDataFrame([("e", "s", "a", None), ("f", "a", "b", "g1"), ("h", "b", "c", None), ("q", "*", "z", None)], "event string, source string, dest string, guard string")
    states = spark.createDataFrame([(x,) for x in "sabczo"], "state string")
    assert {tuple(r) for r in flow.walks_within(edges, 2).collect()} == {("s", "a"), ("a", "b"), ("b", "c"), ("s", "b"), ("a", "c")}
    assert {r["state"] for r in flow.orphans(edges, states, "s").collect()} == {"o"}
    assert flow.expand_wildcards(edges, states).where("from_any").count() == 5
    assert flow.undeclared_guards(edges, ["g2"]).count() == 1
    seqs = spark.createDataFrame([("k", i, x) for i, x in enumerate("saabz")] + [("bad", 0, "c")], "k string, i int, stage string")
    ok = {r["k"]: (r["valid_flow_path"], r["n_invalid_steps"]) for r in flow.valid_paths(seqs, ["k"], ["i"], "stage", edges, "s").collect()}
    assert ok == {"k": (True, 0), "bad": (False, 1)}
    steps = {r["k"]: (r["n_stage_transitions"], r["n_self_loops"], r["last_stage"]) for r in flow.step_counts(seqs, ["k"], ["i"], "stage").collect()}
    assert steps["k"] == (3, 1, "z")


def test_tukey_needs_four(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 1.0)], "g string, v double").withColumn("id", F.monotonically_increasing_id())
    fences = audit.tukey(df, ["g"], "v", "id")
    got = {r["g"]: r["status"] for r in fences.collect()}
    assert got == {"a": "computed", "b": "insufficient_n"}
    assert [r["v"] for r in audit.outliers(df, fences, ["g"], "v").collect()] == [100.0]


def test_census_rules(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    bad = ("instrument", "invalid_candidate_retry_exhausted")
    logs = [(1, "ok", 3, None, None), (2, "ok", 3, None, None), (3, "failed", 3, "simulation", "max_turns_with_incomplete_beat"), (4, "failed", 3, *bad), (5, "ok", 3, None, None), (7, "ok", 0, None, None), (8, "failed", 3, *bad), (9, "failed", 3, "x", "y"), (10, "failed", 3, *bad), (1, "ok", 3, None, None)]
    logs = spark.createDataFrame(logs, "id long, status string, n_records int, failure_kind string, failure_reason string")
    unscored = spark.createDataFrame([(2, "label")], "id long, reason string")
    got = {r["id"]: tuple(r)[1:] for r in audit.census(ids(*range(1, 11)), logs, ids(1), ids(1, 4, 3), unscored, ids(4, 10), "id").collect()}
    assert got == {
        1: ("ok", None, "included_semantic", "included_frozen", None, ["duplicate_log"]),
        2: ("ok", None, "excluded_unscored", "excluded_unscored", "label", []),
        3: ("failed", "max_turns_with_incomplete_beat", "excluded_failure", "excluded_failure", None, ["excluded_failure_with_row"]),
        4: ("failed", "instrument_contract_false_positive", "included_semantic", "excluded_failure", None, []),
        5: ("ok", None, None, None, None, ["incomplete_pair"]),
        6: ("missing", None, None, None, None, ["missing_dialogue"]),
        7: ("empty", None, None, None, None, ["empty_dialogue"]),
        8: ("failed", "instrument_true_failure", "excluded_failure", "excluded_failure", None, []),
        9: ("failed", None, None, None, None, ["unexplained_failure"]),
        10: ("failed", "instrument_contract_false_positive", None, "excluded_failure", None, ["false_positive_without_sidecar_row"]),
    }
    with pytest.raises(ValueError):
        audit.require_none(audit.duplicates(ids(1, 1), ["id"]))


def test_containment(spark):
    needles = spark.createDataFrame([(1, "one two three four five six"), (2, "zz"), (3, "not in any text of these at all"), (4, None)], "n long, t string")
    hay = spark.createDataFrame([(10, "x one two three four five sixty"), (11, "one two three four five six"), (12, "azzb"), (13, "one two three four"), (14, None)], "h long, t string")
    got = joins.contains_join(needles, "n", "t", hay, "h", "t")
    assert {tuple(r) for r in got.collect()} == {(1, 10), (1, 11), (2, 12)}
    status = {r["n"]: (r["status"], r["h"]) for r in joins.unique_attribution(got, needles, "n", "h").collect()}
    assert status == {1: ("unmatched", None), 2: ("matched", 12), 3: ("unmatched", None), 4: ("unmatched", None)}


def test_round_robin_spills(spark):
    units = spark.createDataFrame([("g", "a", 1), ("g", "b", 5), ("g", "c", 5)], "g string, u string, cap int")
    got = {r["u"]: r["allocated"] for r in sampling.round_robin(units, ["g"], "u", "cap", 7, 1).collect()}
    assert got["a"] == 1 and got["b"] + got["c"] == 6 and abs(got["b"] - got["c"]) == 0
    assert sampling.shuffled_ids(["b", "a", "c"], 3) == sampling.shuffled_ids(["c", "a", "b"], 3)
    assert sampling.jobs(spark.createDataFrame([("s",)], "scenario_id string"), ["x", "y"], 2).count() == 4


def test_cases(spark):
    pairs = spark.createDataFrame([("edge", "e1", "t", 1.0), ("edge", "e1", "f", 0.5), ("edge", "e2", "t", -1.0), ("edge", "e3", "t", 0.0), ("edge", "e3", "f", 0.0), ("edge", "e3", "c", 0.0), ("edge", "e4", "f", 1.0)], "category string, scenario_id string, metric string, diff double")
    got = {r["scenario_id"]: (r["bucket"], r["rank"]) for r in cases.rank_candidates(pairs, ("t", "f", "c")).collect()}
    assert got == {"e1": ("helped", 1), "e2": ("restricted", 1), "e3": ("tie", 1), "e4": ("", None)}


def test_texts(spark):
    assert one(spark, texts.normalized(F.lit("It's  A-Test"))) == "it s a test"
    assert one(spark, texts.same_word(F.lit("shipping"), F.lit("shipped"))) is True
    assert one(spark, texts.same_word(F.lit("cat"), F.lit("dog"))) is False
    assert one(spark, texts.denies(F.lit("I don't know"))) is True
    assert one(spark, texts.keywords(F.lit("Where is my order AB-12 of today?"), F.array(F.lit("AB-12")))) == ["where", "order", "today"]
    assert one(spark, texts.fact_ids(F.lit("F02; F01;;F02"))) == ["F01", "F02"]
    assert one(spark, texts.bare_farewell(F.lit("Bye, thanks"), ["bye"], ["thanks"])) is True


def test_script_fold(spark):
    scripts = spark.createDataFrame([(1, ["return the order 1234", "I do not want it", "is it late?"])], "k long, script array<string>")
    contract = script.beats(scripts, "k", "script", ["[0-9]{4}"], stop_words=[*texts.STOP_WORDS, "do"])
    beats = contract.first()["beats"]
    assert [(list(b["literals"]), list(b["keywords"]), b["negates"], b["asks"]) for b in beats] == [(["1234"], ["return", "order"], False, False), ([], ["want"], True, False), ([], ["late"], False, True)]
    say = ["I returned it", "order 1234", "I want it", "I never wanted it", "late", "late again?", "bye"]
    f = contract.select(script.fold(F.array(*map(F.lit, say)), F.col("beats")).alias("f"), "beats")
    log = [(x["turn"], x["beat"], x["started"], x["completed"]) for x in f.first()["f"]["log"]]
    assert log == [(1, None, None, None), (2, 1, 1, 2), (3, None, None, None), (4, 2, 3, 4), (5, None, None, None), (6, 3, 5, 6), (7, None, None, None)]
    half = contract.select(script.fold(F.array(F.lit("I returned it")), F.col("beats")).alias("f"), "beats").select(script.diagnostics(F.col("f"), F.col("beats")).alias("d")).first()["d"]
    assert (half["beat"], half["keywords_held"], half["literals_missing"], half["keywords_missing"], half["turns_on_beat"]) == (1, ["return"], ["1234"], ["order"], 1)
    assert f.select(script.diagnostics(F.col("f"), F.col("beats")).alias("d")).first()["d"] is None


def test_replay(spark):
    request = ("m", "d", json.dumps([{"role": "user", "content": "hi é"}]), "{}", None)
    df = spark.createDataFrame([request], "model string, digest string, messages string, options string, schema string").withColumn("prompt_hash", replay.prompt_hash("model", "digest", "messages", "options", "schema"))
    h = df.first()["prompt_hash"]
    backend = replay.ReplayBackend(spark.createDataFrame([(h, "answer")], "prompt_hash string, text string"))
    assert backend.answer(df).first()["text"] == "answer" and backend.misses(df).count() == 0


def test_calls(spark):
    df = spark.createDataFrame([("a", 10, 1, 2.0, False), ("a", 20, 1, 9.0, True)], "caller string, p int, o int, s double, c boolean")
    r = calls.caller_stats(df, "caller", "p", "o", "s", "c").first()
    assert (r["n"], r["mean_prompt_tokens"], r["mean_latency_s"]) == (2, 15.0, 2.0)
    assert calls.run_hours(36.0, 100, 1, 1) == 1.0


def test_machine(spark):
    from parley.operators.machine import Machine, holds, run

    m = Machine("start", [("identify", "start", "collect", "known"), ("finish", "collect", "done", None), ("farewell", "*", "end", None)], ["start", "collect", "done", "end"], {"order": "AB-[0-9]+", "mail": "[a-z]+@[a-z]+"}, {"known": holds(["order"]), "full": holds(["order", "mail"])}, [("collect", "full", "finish", True)], collecting="collect")
    turns = [("hi", "identify", None), ("it is AB-1", "identify", "refund"), ("mail x@y", None, None), ("bye thanks", None, None)]
    row = spark.createDataFrame([(turns,)], "t array<struct<message:string,event:string,intent:string>>").select(run(F.col("t"), m).alias("r")).first()["r"]
    assert row["state"] == "end" and row["intent"] == "refund" and row["held"] == {"order": "AB-1", "mail": "x@y"}
    assert [(t["turn"], t["source"], t["dest"], t["event"], t["valid"], t["blocked_by_guard"], t["fired_by"]) for t in row["transitions"]] == [(1, "start", "start", "identify", False, True, "user"), (2, "start", "collect", "identify", True, False, "user"), (3, "collect", "done", "finish", True, False, "auto"), (4, "done", "end", "farewell", True, False, "user")]


def test_checks(spark):
    from parley.operators import checks

    plan = spark.createDataFrame([("U1",), ("U1",), ("U9",), (None,)], "u string")
    ids = spark.createDataFrame([("U1",), ("U2",)], "id string")
    assert {tuple(r) for r in checks.coverage(plan, "u", ids, "id").collect()} == {("U1", "repeated"), ("U2", "missing"), ("U9", "unknown")}
    with pytest.raises(ValueError):
        checks.select_listed(ids, spark.createDataFrame([("U3",)], "id string"), "id")
    logs = spark.createDataFrame([("d", [("a",), ("b",)], ["x", "y"])], "k string, records array<struct<state_after:string>>, labels array<string>")
    assert [tuple(r) for r in checks.labelled_turns(logs, "records", "labels", ["k"]).collect()] == [("d", 1, "x", "a"), ("d", 2, "y", "b")]
    cells_ = spark.createDataFrame([("edge", 1, ["a", "b", "c", "d", "e"]), ("edge", 2, ["f"])], "category string, cell int, slots array<string>")
    assert [(r["id"], r["slot"]) for r in checks.expand_plan(cells_, "slots").orderBy("id").collect()] == [("edge_01", "a"), ("edge_02", "b"), ("edge_03", "c"), ("edge_04", "d"), ("edge_05", "f"), ("edge_06", "e")]
    r = spark.createDataFrame([("d", ["F01"]), ("d", ["F01", "F02"])], "k string, fact_ids array<string>")
    c = spark.createDataFrame([("d", "supported"), ("d", "uncertain"), ("d", "unsupported")], "k string, support string")
    s = checks.human_scores(r, c, spark.createDataFrame([("d", ["F01", "F03"])], "k string, required array<string>"), "k").first()
    assert (s["tp"], s["fp"], s["fn"], s["claim_support"]) == (1, 2, 1, 0.5)


@pytest.mark.parametrize("k", [0, 1, 623, 624, 19_937, 70_001])
def test_any_place_of_the_stream(k):
    rng = random.Random(9)
    plain = [rng.getrandbits(32) for _ in range(k + 700)]
    assert twister.words(9, k, 700, twister.characteristic()).tolist() == plain[k:]


def test_draws_over_tasks_equal_one_loop(spark):
    rng = random.Random(5)
    sets = {"mixed": [0.1, -0.25, 1 / 3, 2.0, 0.0, -1e-12, 7e15], "one": [0.5], "many": [0.1 * (i % 7) - 0.2 for i in range(100)], "zero": [0.0, 0.0], "wide": [rng.gauss(0, 1) * 10 ** rng.randint(-20, 20) for _ in range(37)]}
    rows = [(name, f"s{i:03d}", v) for name, values in sets.items() for i, v in enumerate(values)]
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, ("one", "t", None)], "metric string, scenario_id string, diff double")
    got = {r["metric"]: r for r in resampling.resampled(df, ["metric"], n_resamples=150, block=9000, size=16).collect()}
    for name, values in sets.items():
        assert got[name]["n"] == len(values)
        assert got[name]["permutation_p"] == stats.permutation_two_sided(values, 150), name
        assert (got[name]["ci_low"], got[name]["ci_high"]) == stats.bootstrap_interval(values, 150), name
    assert resampling.resampled(df.limit(0), ["metric"], n_resamples=150).count() == 0
    with pytest.raises(Exception, match="not finite"):
        resampling.resampled(df.withColumn("diff", F.lit(float("nan"))), ["metric"], n_resamples=5).collect()

def test_draws_meet_values_a_bounded_number_of_times(spark):
    rng = random.Random(7)
    values = [rng.gauss(0, 3) for _ in range(90)]
    df = spark.createDataFrame([("a", f"s{i:03d}", v) for i, v in enumerate(values)], "metric string, scenario_id string, diff double")
    got = resampling.resampled(df, ["metric"], n_resamples=120, block=500, size=16, blocks=3, hold=32).first()
    assert got["permutation_p"] == stats.permutation_two_sided(values, 120)
    assert (got["ci_low"], got["ci_high"]) == stats.bootstrap_interval(values, 120)
    bounds = spark.createDataFrame([(2, 10**10), (360_000, 36 * 10**8), (5, 50)], "__below long, __draws long")
    blocks = {r["__below"]: r["count"] for r in resampling._blocks(bounds, resampling.BLOCK, resampling.BLOCKS).groupBy("__below").count().collect()}
    assert blocks[5] == 1 and max(blocks.values()) <= resampling.BLOCKS + 1


def test_intervals_of_the_wanted_cells_alone(spark):
    rows = spark.createDataFrame([(c, f"{c}_{i}", "fsm", 1, float(i)) for c in ("edge", "happy_path") for i in range(5)], "category string, scenario_id string, agent string, repetition int, m1 double")
    every = {r["stratum"]: r for r in tables.descriptive(rows, ["m1"], n_resamples=40).collect()}
    some = {r["stratum"]: r for r in tables.descriptive(rows, ["m1"], n_resamples=40, drawn=F.col("stratum") == "edge").collect()}
    assert some["edge"] == every["edge"] and set(some) == set(every)
    assert some["overall"]["ci_low"] is None and some["overall"]["mean"] == every["overall"]["mean"]


def test_counter_draws_are_not_rows(spark):
    rng = random.Random(3)
    values = {"a": [rng.gauss(0, 2) for _ in range(50)], "b": [1.5], "c": [0.5, None, None]}
    df = spark.createDataFrame([(g, f"s{i:02d}", v) for g, vs in values.items() for i, v in enumerate(vs)], "metric string, scenario_id string, diff double")
    table = stats.bootstrap_counter(df, ["metric"], 130, size=8, hold=16)
    got = {r["metric"]: r for r in table.collect()}
    for g, vs in values.items():
        drawn = [[vs[int(hashlib.md5(f"42:{b}:{i}".encode()).hexdigest()[:8], 16) % len(vs)] for i in range(len(vs))] for b in range(130)]
        means = sorted(sum(x for x in d if x is not None) / len(vs) for d in drawn if any(x is not None for x in d))
        assert [got[g]["ci_low"], got[g]["ci_high"]] == pytest.approx([stats.percentile(means, 2.5), stats.percentile(means, 97.5)])
    assert "Join" not in str(table._jdf.queryExecution().analyzed()).split("MapInArrow")[0]
