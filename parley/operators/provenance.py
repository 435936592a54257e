"""Digests of tables, exports that carry them, and what changed.

A table's digest is a Merkle root: a row's leaf is the sha256 of its cells, equal
rows are one leaf with a count, leaves fall into chunks by the range of their
digest, and chunks fold in two more steps into the root.  The chunks depend on the
rows alone, so the root is the same under any order and any partitioning; no
group ever holds more than a chunk, 1/16^5 of the distinct rows.  Chunks that are kept beside
an export tell which part of a table has changed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.audit import require_none

#: Hex digits of a leaf that name its chunk, and those that name a group of chunks.
CHUNK, GROUP = 5, 2


def row_text(columns: list[str]) -> Column:
    """Cells in order, each as its length and its text, so that no two rows read alike; null is a dash."""
    cell = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.concat(*map(cell, columns))


def _folded(rows: DataFrame, digits: int, name: str, line: Column) -> DataFrame:
    joined = F.array_join(F.sort_array(F.collect_list(line)), "\n")
    return rows.groupBy(F.left(name, F.lit(digits)).alias("chunk")).agg(F.sha2(joined, 256).alias("digest"), F.sum("n").alias("n"))


def chunk_digests(df: DataFrame, columns: list[str]) -> DataFrame:
    """(chunk, digest, n): the digest and the rows of each range of leaves."""
    leaves = df.select(F.sha2(row_text(columns), 256).alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n"))
    return _folded(leaves, CHUNK, "leaf", F.concat_ws(":", "leaf", F.col("n").cast("string")))


def root_digest(chunks: DataFrame, columns: list[str]) -> DataFrame:
    """One row (digest, n) over chunks; the columns' names are part of it; an empty table has a digest too."""
    line = F.concat_ws(":", "chunk", "digest")
    groups = _folded(chunks, GROUP, "chunk", line)
    named = F.concat_ws("\n", F.lit(",".join(columns)), F.array_join(F.sort_array(F.collect_list(line)), "\n"))
    return groups.agg(F.sha2(named, 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    return root_digest(chunk_digests(df, columns), columns)


def changed_chunks(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """(chunk, change, n_recorded, n_found): ranges of leaves that differ between two chunk tables."""
    a = recorded.select("chunk", F.col("digest").alias("a"), F.col("n").alias("n_recorded"))
    b = found.select("chunk", F.col("digest").alias("b"), F.col("n").alias("n_found"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "gone").otherwise("changed")
    both = a.join(b, "chunk", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("chunk", change.alias("change"), F.coalesce("n_recorded", F.lit(0)).alias("n_recorded"), F.coalesce("n_found", F.lit(0)).alias("n_found"))


def changed_rows(recorded: DataFrame, now: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``now`` in ranges of leaves that are not as ``recorded`` has them."""
    changed = changed_chunks(recorded, chunk_digests(now, columns)).select("chunk")
    return now.withColumn("chunk", F.left(F.sha2(row_text(columns), 256), F.lit(CHUNK))).join(changed, "chunk", "left_semi").drop("chunk")


def differing_artifacts(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """(name, problem): artifacts whose digest is not the recorded one, that are missing, or that were never recorded."""
    a, b = recorded.select("name", F.col("digest").alias("a")), found.select("name", F.col("digest").alias("b"))
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "not_recorded").otherwise("changed")
    return a.join(b, "name", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("name", problem.alias("problem"))


def frame_digests(frame: DataFrame, groups: list[str], order: list[str], unit: str, text: str) -> DataFrame:
    """(groups, digest): sha256 of the units and texts of each frame in order, one after the other without a separator.

    A frame is one value's worth of text; ``table_digest`` is for tables of any size.
    """
    said = F.struct(*order, F.concat(F.coalesce(F.col(unit).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).alias("__said"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["__said"]), "")
    return frame.groupBy(*groups).agg(F.sha2(joined, 256).alias("digest"))


def gated_export(tables: Mapping[str, DataFrame], path: str, violations: DataFrame, expected: Mapping[str, str]) -> None:
    """Write tables under ``path`` after two gates: no rule is broken, and every table has the digest that is expected.

    Each is written with its chunk digests; nothing is written if a gate fails.  What is read back has to pass ``verified``.
    """
    require_none(violations)
    spark = violations.sparkSession
    digests = {name: chunk_digests(df, df.columns).cache() for name, df in tables.items()}
    found = {name: root_digest(chunks, tables[name].columns).first()["digest"] for name, chunks in digests.items()}
    wrong = {name: found.get(name) for name, want in expected.items() if found.get(name) != want}
    if wrong or set(tables) - set(expected):
        raise ValueError(f"digests are not as expected: {wrong or sorted(set(tables) - set(expected))}")
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        digests[name].coalesce(1).write.parquet(f"{path}/_chunks/{name}")
        digests[name].unpersist()
    spark.createDataFrame(sorted(found.items()), "name string, digest string").coalesce(1).write.parquet(f"{path}/_digests")


def verified(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of an export, after a check that its rows still have the digest that was recorded."""
    df = spark.read.parquet(f"{path}/{name}")
    recorded = spark.read.parquet(f"{path}/_digests").where(F.col("name") == name).first()
    found = table_digest(df, df.columns).first()["digest"]
    if recorded is None or recorded["digest"] != found:
        raise ValueError(f"{name} in {path} has digest {found}, recorded is {recorded and recorded['digest']}")
    return df
