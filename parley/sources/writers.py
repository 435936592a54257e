"""Sinks: CSV with fixed columns, JSON lines, append logs, key-sharded caches."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Most rows of a CSV file: a reader takes a file that may hold line breaks in cells in one task.
ROWS = 1 << 18


def csv_table(df: DataFrame, path: str, columns: list[str], order: list[str] | None = None, allow_empty: bool = False) -> None:
    """A table as CSV: columns in order, null as an empty cell, booleans as True and False.

    A report-sized table is one file; one of more than ``ROWS`` rows is as many as it takes, in the rows' order by their names.
    """
    n = df.limit(ROWS + 1).count()
    if not n and not allow_empty:
        raise ValueError("refusing to write an empty table")
    kinds = dict(df.dtypes)
    cells = [F.initcap(F.col(c).cast("string")).alias(c) if kinds[c] == "boolean" else F.concat_ws(" ", c).alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns]
    out = (df.orderBy(*order) if order else df).select(*cells)
    (out if n > ROWS else out.coalesce(1)).write.options(header=True, nullValue="", emptyValue="", escape='"', maxRecordsPerFile=ROWS).csv(path)


def bundle(df: DataFrame, path: str, name: str, text: str) -> None:
    """Small text files packed in one table, a row for each: a folder and a file of its own cost more than what is in them."""
    df.select(F.col(name).cast("string").alias("name"), F.col(text).alias("value")).write.parquet(path)


def json_lines(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition) if partition else writer).json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def upsert_cache(new: DataFrame, path: str, old: DataFrame | None, key: str = "prompt_hash") -> None:
    """Append the entries whose key is new, sharded by the key's first two characters."""
    fresh = new.dropDuplicates([key]) if old is None else new.dropDuplicates([key]).join(old, key, "left_anti")
    fresh.withColumn("shard", F.substring(key, 1, 2)).write.mode("append").partitionBy("shard").parquet(path)


def document(path: str, payload: dict) -> None:
    """A small JSON document, written beside and renamed, keys sorted."""
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        json.dump(payload, f, sort_keys=True, ensure_ascii=False, indent=2)
    os.replace(f.name, path)


def long_comparison(left: DataFrame, right: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, original, sidecar, delta) of two one-row tables."""
    a = left.select(*[F.col(m).cast("double") for m in metrics]).unpivot([], metrics, "metric", "original")
    b = right.select(*[F.col(m).cast("double") for m in metrics]).unpivot([], metrics, "metric", "sidecar")
    return a.join(b, "metric").withColumn("delta", F.col("sidecar") - F.col("original"))
