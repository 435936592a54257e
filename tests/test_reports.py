"""Run reports, plot tables and the reader of unscored dialogues, on literal examples."""

from parley.operators import calls, paired
from parley.sources import readers


def test_run_report_divisors_and_missing_callers(spark):
    log = spark.createDataFrame(
        [("a", "fsm", 10, 1.0, False), ("a", "fsm", 30, 1.0, True), ("a", "classifier", 5, 2.0, False), ("a", "judge", 9, 4.0, False), ("a", "judge", 9, 8.0, True), ("b", "fsm", 7, 1.0, False), ("x", "fsm", 1, 1.0, None)],
        "run string, caller string, tokens int, s double, cached boolean",
    )
    runs = spark.createDataFrame([("a", 2, 2, 40.0), ("b", 0, 0, 3.0), ("c", 0, 5, 10.0)], "run string, n_ok long, n_failed long, elapsed_s double")
    got = {r["run"]: tuple(r)[1:] for r in calls.run_report(log, runs, "run", "caller", "tokens", "s", "cached", ["judge"], ["fsm", "classifier"]).collect()}
    assert got == {"a": (5, 2, 10.0, 2.0, 25.0), "b": (1, 0, None, None, None), "c": (0, 0, 2.0, None, None)}
    assert calls.run_report(log, runs.where("false"), "run", "caller", "tokens", "s", "cached", ["judge"], ["fsm"]).count() == 0


def test_plot_values_in_order(spark):
    rows = spark.createDataFrame([("s2", "fsm", 1.0), ("s2", "fsm", 2.0), ("s1", "fsm", None), ("s10", "fsm", 4.0), ("s1", "baseline", 3.0), ("s1", "other", 9.0)], "scenario_id string, agent string, m double")
    got = sorted((r["agent"], r["position"], r["scenario_id"], r["value"]) for r in paired.plot_values(rows, ["m"]).collect())
    assert got == [("baseline", 1, "s1", 3.0), ("fsm", 1, "s10", 4.0), ("fsm", 2, "s2", 1.5)]


def test_unscored_keeps_the_last_reason(spark, tmp_path):
    path = tmp_path / "unscored.csv"
    assert [x.count() for x in readers.unscored(spark, str(path))] == [0, 0]
    path.write_text('scenario_id,agent,repetition,reason,more\ne_1,fsm,1,first,x\ne_1,fsm, 1 ,"last, with ""quotes""\nand lines",x\ne_2,fsm,one,bad,x\ne_3,fsm,2,,x\n,fsm,1,no key,x\ne_4,fsm\n')
    reasons, faults = readers.unscored(spark, str(path))
    assert {tuple(r) for r in reasons.collect()} == {("e_1__fsm__rep01", 'last, with "quotes"\nand lines'), ("e_3__fsm__rep02", "")}
    assert {tuple(r) for r in faults.collect()} == {("e_2", "fsm", "one"), (None, "fsm", "1"), ("e_4", "fsm", None)}
    path.write_text("scenario_id,repetition\ne_1,1\n")
    reasons, faults = readers.unscored(spark, str(path))
    assert reasons.count() == 0 and [tuple(r) for r in faults.collect()] == [("e_1", None, "1")]
