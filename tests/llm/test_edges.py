"""Nulls in any column, empty and very long texts, repeated rows, empty tables and clashing names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import decontaminate, idfiles, langid, lattice, packing, repeats, surrogates, topk, toxicity, triejoin

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron".split()
LONG = " ".join(WORDS[i * 7 % 15] + str(i % 97) for i in range(40_000))
CLASHES = ["kind", "n", "a", "b", "set", "component", "block", "bucket", "part", "start", "length", "ids", "shard", "id", "v", "pieces", "found", "draws", "unit"]
ROWS = [(1, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (None, "alpha beta gamma delta epsilon zeta"), (2, None), (None, None), (3, ""), (4, LONG), (5, LONG), (6, "w" * 5000 + " end"), (7, "one")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(None).cast("string") for c in CLASHES}).repartition(2)


def ids(df):
    return sorted((r["doc_id"] is not None, r["doc_id"]) for r in df.select("doc_id").collect())


EVERY = sorted((k is not None, k) for k, _ in ROWS)


def test_language(spark, docs):
    model = langid.train_language_model(docs.where("doc_id IN (1, 4)").unionByName(docs.where("doc_id = 7").withColumn("lang", F.lit("de"))))
    out = langid.identify_language(docs, model)
    assert ids(out) == EVERY and set(docs.columns) <= set(out.columns)
    got = {(r["doc_id"], r["text"] and r["text"][:5]): r["lang_pred"] for r in out.collect()}
    assert got[2, None] == got[None, None] == got[3, ""] == "und"


def test_equal_labels_tie_to_the_first(spark):
    rows = [(i, "same words here", "aa" if i % 2 else "zz") for i in range(40)]
    model = langid.train_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.labels == ["aa", "zz"]


def test_many_dirty_labels(spark):
    rows = [(i, f"text {i} words", f"label {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train_language_model(df, most=100)
    assert 0 < len(model.labels) < 200 and model.rows.shape[1] == langid.DIM
    assert langid.identify_language(df, model).count() == 300


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (7, 0), (4, 0)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, toxicity.train_toxicity_model(docs, labels))
    assert ids(out) == EVERY and all(0 <= r["toxic_score"] <= 1 for r in out.collect())


def test_repeats(docs):
    got = repeats.remove_repeats(docs).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"]) for r in got) == EVERY
    assert {r["doc_id"]: r["n_removed"] for r in got if r["doc_id"] in (4, 5)} == {4: len(LONG), 5: len(LONG)}


def test_packing(docs):
    pieces = packing.packed_documents(docs).collect()
    assert {r["doc_id"] for r in pieces} == {k for k, _ in ROWS}
    assert sum(r["length"] for r in pieces if r["start"] == 0 and r["doc_id"] == 2) == 1


def test_lattice(docs):
    out = lattice.score_documents(docs, F.col("doc_id") < 5)
    assert ids(out) == EVERY and all(r["score"] < 0 for r in out.collect())


def test_contamination(spark, docs):
    items = spark.createDataFrame([(1, "Beta gamma"), (None, None), (2, "w" * 5000)], "item_id long, text string")
    out = decontaminate.find_contamination(docs, items)
    got = {(r["doc_id"], (r["text"] or "")[:1]): r["bench_items"] for r in out.collect()}
    assert got[1, "a"] == got[None, "a"] == ["1"] and got[6, "w"] == ["2"] and got[2, ""] == []


def test_surrogates(docs):
    out = surrogates.replace_entities(docs)
    assert ids(out) == EVERY and out.columns == docs.columns
    assert sorted(str(r["text"]) for r in out.collect()) == sorted(str(t) for _, t in ROWS)


def test_near_duplicates(docs):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in triejoin.near_duplicates(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 2, 1), (1, 2, 1), (None, 2, 1), (2, 0, 2), (None, 0, None), (3, 0, 3), (4, got_n(LONG), 4), (5, got_n(LONG), 4), (6, 1, 6), (7, 1, 7)]))


def got_n(text):
    w = text.split()
    return len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})


def test_id_files(spark, docs, tmp_path):
    idfiles.write_id_files(docs, str(tmp_path / "x"))
    got = idfiles.read_id_files(spark, str(tmp_path / "x"))
    assert ids(got) == EVERY and got.where("doc_id = 2 AND n_tokens = 1").count() == 1
    rows = sorted((r["start"], r["n_tokens"]) for r in got.collect())
    assert [s for s, _ in rows] == [sum(n for _, n in rows[:i]) for i in range(len(rows))]


def test_top_k_breaks_ties_by_id(spark):
    rows = [(i, [1.0, 2.0]) for i in range(20)] + [(0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("r", F.lit(1)).withColumn("id", F.lit(2))
    got = [r["vec_id"] for r in topk.exact_top_k(df, df.where("vec_id = 0").limit(1), 3).orderBy("rank").collect()]
    assert got == [1, 2, 3]


def test_stages(spark, docs, tmp_path):
    spark.createDataFrame([(4, 0), (7, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nowhere at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == docs.columns
        assert out.count() > 0


def test_near_duplicate_stage_drops_rows_not_ids(spark, docs):
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon zeta"), (2, "another text that stays as it is"), (2, "another text that stays as it is"), (None, "alpha beta gamma delta epsilon zeta")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, corpus_pipeline.drop_near_duplicates(spark, df, "").collect()))
    assert got == sorted(map(str, [df.first(), df.collect()[2], df.collect()[4]]))
