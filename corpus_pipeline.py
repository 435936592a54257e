"""Corpus pipeline: toxicity, near-duplicates, benchmark passages, personal data, packing.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.decontaminate import find_contamination, is_contaminated
from parley.llm.packing import packed_documents
from parley.llm.store import documents, written
from parley.llm.surrogates import replace_entities
from parley.llm.toxicity import score_toxicity, trained_for
from parley.llm.triejoin import near_duplicates


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under a half; the model learns from the labels of what is here.

    Null and empty texts score like a text without toxic words and stay; without labels of both
    kinds nothing goes unless all labels are toxic; repeated rows are judged alike; a table with a
    column ``__toxic_score`` or ``__toxic_spans`` is an error; an empty table stays empty.
    """
    scored = score_toxicity(docs, trained_for(spark, docs, sf_dir), prefix="__toxic_")
    return scored.where(F.col("__toxic_score") < 0.5).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest id stays; rows without an id stay.

    Rows that repeat both id and text are one document, rows that repeat an id with another text
    are documents of their own.  Null texts and texts without words are in no group; ties go to
    the smaller hash of the text; other columns may have any name but ``__key``; an empty table
    stays empty.
    """
    key = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h")))
    keyed = docs.withColumn("__key", key)
    found = near_duplicates(keyed, key="__key").select("__key", "component_id")
    dropped = found.where("component_id <> __key").select("__key").distinct()
    kept = keyed.join(dropped, "__key", "left_anti")
    repeated = keyed.groupBy("__key").count().where("count > 1 AND __key IS NOT NULL").select("__key")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(repeated, "__key", "left_semi").dropDuplicates(["__key"])
    return kept.join(repeated, "__key", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule clears.

    Null texts have no words and stay; repeated rows are judged alike; an empty benchmark clears
    all; a table with a column ``__bench_n_words``, ``__bench_spans`` or ``__bench_items`` is an error.
    """
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), prefix="__bench_")
    return found.where(~is_contaminated("__bench_")).select(docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with surrogates in their texts, and their lengths.

    Null texts stay null with the length they had; repeated rows are treated alike; columns may
    have any name; an empty table stays empty.
    """
    done = replace_entities(docs)
    if "n_chars" in done.columns:
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return done.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens.

    A null text is its end id alone; repeated rows are packed as often as they occur; other
    columns are left out; an empty table gives no sequence.
    """
    return packed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("surrogates", replace_personal_data),
    ("packing", pack),
]
#: A trained classifier and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs
