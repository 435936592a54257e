"""Tables between steps: written to the folder that all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder of ``spark.checkpoint.dir``; in a temporary folder if all tasks run on this machine."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.gettempdir()}/checkpoints/parley"
    path = f"{at}/parley-{sc.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = sc._jvm.org.apache.hadoop.fs.Path(path)
    jvm.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(jvm)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: lineage ends here, and lost executors read the files."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
