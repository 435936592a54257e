"""Shared scratch space and deterministic folds used by the operators."""

from __future__ import annotations

import math
import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, an own one if all tasks run on this machine."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.gettempdir()}/checkpoints/parley"
        spark.sparkContext.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/parley-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_keys(spark: SparkSession, parts: int) -> np.ndarray:
    """``parts`` longs that ``repartition(parts, key)`` sends to as many different partitions: ranges dealt by them never share a task."""
    n = int(parts * (math.log(parts + 1) + 12))
    rows = spark.range(n).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("at")).agg(F.min("id").alias("id")).orderBy("at").toArrow()
    found = dict(zip(rows["at"].to_pylist(), rows["id"].to_pylist(), strict=True))
    return np.array([found.get(i, n + i) for i in range(parts)], np.int64)


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``: the contract's way to hold rows out."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def fold_py(key: object, parts: int) -> int:
    return zlib.crc32(str(key).encode()) % parts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
