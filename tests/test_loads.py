"""Load checks on small documents: each fault by name, and gates that refuse."""

import json

import pytest

from parley.operators import loads
from parley.sources import readers

EDGES = "event string, source string, dest string, guard string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_fact_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("- **F01** — early\n## One · `one`\n- **F03** — x\n- **F03** — again\n## Two · `two`\n## One · `one`\n- **F09** — far\n", encoding="utf-8")
    (tmp_path / "b.md").write_text("# KB\n\n## One · `one`\n\n- **F01** — fine\n- **F02** — too\n", encoding="utf-8")
    found = loads.fact_file_faults(readers.fact_lines(spark, str(tmp_path)))
    assert {r["file"].rsplit("/", 1)[1] for r in found.collect()} == {"a.md"}
    assert rows(found.drop("file")) == [("fact_before_section", "F01"), ("missing_number", "F02"), ("missing_number", "F04"), ("number_beyond", "F09"), ("repeated_number", "F03"), ("repeated_section", "one")]
    with pytest.raises(ValueError, match="faults at load"):
        loads.refuse(found)
    fine = readers.fact_lines(spark, str(tmp_path / "b.md"))
    loads.refuse(loads.fact_file_faults(fine))
    assert rows(readers.facts(spark, str(tmp_path / "b.md"))) == [("F01", "one", "fine"), ("F02", "one", "too")]


def test_knowledge(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"needles": [{"fact_id": "F01"}, {"fact_id": "F07"}]}, indent=1))
    (tmp_path / "u.json").write_text(json.dumps({"unanswerable": [{"id": "U1"}, {"id": "U1"}, {"id": "U2"}]}, indent=1))
    fields = [{"key": "order", "pattern": "^[0-9]+$", "example": "12", "required_for": ["one"]}, {"key": "mail", "pattern": "@", "example": "none", "required_for": ["lost"]}, {"key": "name", "example": "Ann", "required_for": []}]
    (tmp_path / "f.json").write_text(json.dumps({"fields": fields}, indent=1))
    facts = spark.createDataFrame([("F01", "one")], "id string, intent string")
    found = loads.knowledge_faults(facts, readers.needles(spark, str(tmp_path / "n.json")), readers.unanswerable(spark, str(tmp_path / "u.json")), readers.user_data_fields(spark, str(tmp_path / "f.json")))
    assert rows(found) == [("needle_without_fact", "F07"), ("pattern_misses_example", "mail"), ("repeated_question", "U1"), ("unknown_intent", "mail:lost")]


def test_machines(spark):
    states = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "state string")
    edges = spark.createDataFrame([("go", "a", "b", "held"), ("go", "a", "c", None), ("on", "b", "gone", "odd"), ("any", "*", "c", None)], EDGES)
    assert rows(loads.machine_faults(edges, states, "a", ["c", "end"], ["held"])) == [("ambiguous_event", "a:go"), ("undeclared_role", "accepting:end"), ("undeclared_state", "gone"), ("unknown_guard", "odd"), ("unreachable_state", "d")]
    sound = spark.createDataFrame([("go", "a", "b", None), ("any", "*", "c", None), ("back", "c", "d", "held")], EDGES)
    assert rows(loads.machine_faults(sound, states, "a", ["c"], ["held"])) == []


def test_logs(spark):
    logs = spark.createDataFrame([("x", "1.jsonl"), ("x", "0.jsonl"), ("y", "2.jsonl"), ("odd", "odd.jsonl")], "dialogue_id string, source_file string")
    index = loads.log_index(logs, spark.createDataFrame([("x",), ("y",), ("z",)], "dialogue_id string"))
    assert {r["dialogue_id"]: (r["n_files"], r["first_file"], r["expected"]) for r in index.collect()} == {"odd": (1, "odd.jsonl", False), "x": (2, "0.jsonl", True), "y": (1, "2.jsonl", True), "z": (0, None, True)}
    assert rows(loads.log_faults(index)) == [("duplicate_log", "x"), ("extra_log", "odd"), ("missing_log", "z")]


def test_flow_beside_scores(spark):
    edges = spark.createDataFrame([("go", "a", "b")], "event string, source string, dest string")
    turns = spark.createDataFrame([("k", 1, "a", "a"), ("k", 2, "b", "a"), ("m", 1, "b", None)], "k string, turn int, stage string, gold string")
    expected = spark.createDataFrame([("k", "b"), ("m", "a")], "k string, expected_final_state string")
    scores = spark.createDataFrame([("k", 2), ("m", 1)], "k string, n_turns int")
    got = {r["k"]: r for r in loads.with_flow(scores, turns, ["k"], ["turn"], "stage", "gold", edges, "a", expected).collect()}
    assert got["k"]["flow_adherence"] and got["k"]["stage_label_accuracy"] == 0.5 and got["m"]["stage_label_accuracy"] is None and not got["m"]["flow_adherence"]
    with pytest.raises(Exception, match="1 labels for 3 turns"):
        loads.with_flow(scores.replace(1, 3), turns, ["k"], ["turn"], "stage", "gold", edges, "a", expected).collect()
