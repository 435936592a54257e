"""Readers and writers on files made here, and the streaming fold."""

import json

import pytest
from pyspark.sql import functions as F

from parley.sources import readers, schemas, writers
from parley.streaming import folds


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("edge_01", "fsm", 1, True, None, [1, 2]), ("edge_02", "fsm", 2, None, "a,b\n\"c\"", [])], "scenario_id string, agent string, repetition int, m boolean, note string, ids array<int>")
    writers.csv_table(df, str(tmp_path / "t"), df.columns, ["scenario_id"])
    rows = readers.text_csv(spark, str(tmp_path / "t")).collect()
    assert rows[0]["m"] == "True" and rows[1]["note"] == 'a,b\n"c"' and rows[0]["ids"] == "1 2"
    typed = readers.metrics_csv(spark, str(tmp_path / "t"), ["m"]).orderBy("repetition").collect()
    assert [r["m"] for r in typed] == [1.0, None]
    with pytest.raises(ValueError):
        writers.csv_table(df.limit(0), str(tmp_path / "u"), df.columns)


def test_json_records(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x__fsm__rep01.jsonl").write_text(json.dumps({"scenario_id": "x", "agent": "fsm", "repetition": 1, "status": "ok", "records": [{"turn": 1, "agent_reply": "hi", "cached": False, "llm_latency_s": 1.5}]}) + "\n")
    (tmp_path / "d" / "y__fsm__rep01.jsonl").write_text("{broken\n")
    logs = readers.dialogues(spark, str(tmp_path / "d"), strict=False)
    assert {r["dialogue_id"] for r in logs.select("dialogue_id").collect()} == {"x__fsm__rep01", "y__fsm__rep01"}
    with pytest.raises(Exception):
        readers.dialogues(spark, str(tmp_path / "d")).collect()
    (tmp_path / "s.jsonl").write_text(json.dumps({"id": "edge_01", "odd": 1}) + "\n")
    assert [r[0] for r in readers.unknown_fields(spark, str(tmp_path / "s.jsonl"), schemas.SCENARIO).collect()] == ["odd"]
    assert readers.llm_calls(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_text_dimensions(spark, tmp_path):
    (tmp_path / "kb.md").write_text("# K\n\n## Opening · `hours`\n- **F01** — Open at nine.\n## Pay · `payment`\n- **F02** — Cards are taken.\n")
    assert [tuple(r) for r in readers.facts(spark, str(tmp_path / "kb.md")).orderBy("id").collect()] == [("F01", "hours", "Open at nine."), ("F02", "payment", "Cards are taken.")]
    (tmp_path / "p.md").write_text("Version: 3\n\nHello {name}")
    assert tuple(readers.prompts(spark, str(tmp_path / "p.md")).first()) == ("p", 3, "Hello {name}")
    (tmp_path / "sums").write_text("# c\nabc  name one\n")
    assert tuple(readers.sha256_sums(spark, str(tmp_path / "sums")).first()) == ("abc", "name one")
    (tmp_path / "m.yaml").write_text("states: [a, b]\ntransitions:\n - {event: e, from: a, to: b}\n - {event: f, from: '*', to: a, guard: g}\n")
    edges, states = readers.state_machine(spark, str(tmp_path / "m.yaml"))
    assert edges.count() == 2 and states.count() == 2
    ids = spark.createDataFrame([("D001",), ("D003",)], "id string")
    assert [r["id"] for r in readers.bijective_ids(ids, "id", "D").collect()] == ["D003"]


def test_malformed_keys_become_anomalies(spark):
    df = spark.createDataFrame([("a1",), ("a1",), ("zz",), ("a2",), (None,)], "id string")
    good, bad = readers.split_malformed(df, "id", "^a[0-9]$")
    assert {r["id"] for r in good.collect()} == {"a1", "a2"}
    assert {(r["id"], r["rule"]) for r in bad.collect()} == {("a1", "repeated"), ("zz", "malformed"), (None, "malformed")}


def test_cache_upsert(spark, tmp_path):
    path = str(tmp_path / "cache")
    new = spark.createDataFrame([("aa1", "x"), ("aa1", "x"), ("bb2", "y")], "prompt_hash string, text string")
    writers.upsert_cache(new, path, None)
    old = spark.read.parquet(path)
    writers.upsert_cache(spark.createDataFrame([("aa1", "z"), ("cc3", "w")], "prompt_hash string, text string"), path, old)
    assert sorted((r["prompt_hash"], r["text"]) for r in spark.read.parquet(path).collect()) == [("aa1", "x"), ("bb2", "y"), ("cc3", "w")]
    writers.document(str(tmp_path / "d.json"), {"b": 1, "a": 2})
    assert list(json.loads((tmp_path / "d.json").read_text())) == ["a", "b"]


def test_stream_fold_equals_batch(spark, tmp_path):
    rows = [("u", i, s) for i, s in enumerate("aabca")] + [("v", 0, "x")]
    df = spark.createDataFrame(rows, "k string, i int, stage string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = folds.flow_counts(stream, "k", "stage", "i").writeStream.outputMode("update").format("memory").queryName("fold").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("SELECT * FROM fold").collect()} == {("u", "a", 3, 1), ("v", "x", 0, 0)}
    events = spark.createDataFrame([("a",)], "kind string").withColumn("ts", F.current_timestamp())
    assert folds.windowed_counts(events, "ts", "kind").count() == 1


def test_large_tables_are_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "ROWS", 10)
    df = spark.range(95).selectExpr("94 - id AS k", "'a\n' || id AS note")
    writers.csv_table(df, str(tmp_path / "t"), ["k", "note"], ["k"])
    files = sorted((tmp_path / "t").glob("*.csv"))
    held = [[int(r["k"]) for r in readers.text_csv(spark, str(f)).collect()] for f in files]
    assert len(held) >= 10 and max(map(len, held)) <= 10 and sum(held, []) == list(range(95))
    writers.csv_table(df.limit(10), str(tmp_path / "u"), ["k"])
    assert len(list((tmp_path / "u").glob("*.csv"))) == 1


def test_packed_files_read_like_files(spark, tmp_path):
    good = json.dumps({"scenario_id": "x", "agent": "fsm", "repetition": 1, "status": "ok"})
    files = {"a/x.jsonl": good + "\n" + good + "\n", "b/y.jsonl": "{broken\n"}
    texts = {"p/ask.md": "Version: 3\n\nServe.\n", "p/kb.md": "# KB\n\n## A (`a_b`)\n\n- **F01** \u2014 One.\n"}
    for name, text in (files | texts).items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    pack = lambda held, at: (writers.bundle(spark.createDataFrame(list(held.items()), "n string, t string"), str(tmp_path / at), "n", "t"), readers.bundle(spark, str(tmp_path / at)))[1]
    logs, docs = pack(files, "logs"), pack(texts, "docs")
    shown = lambda df: sorted(map(str, df.collect()))
    columns = ["dialogue_id", "scenario_id", "status", "_corrupt"]
    assert shown(readers.dialogues(spark, logs, strict=False).select(columns)) == shown(readers.dialogues(spark, str(tmp_path / "[ab]"), strict=False).select(columns))
    assert shown(readers.prompts(spark, docs)) == shown(readers.prompts(spark, str(tmp_path / "p"))) and shown(readers.facts(spark, docs)) == shown(readers.facts(spark, str(tmp_path / "p")))
    with pytest.raises(Exception):
        readers.dialogues(spark, logs).collect()
