"""Token-id files: documents in ascending key order, coded in checksummed blocks.

``write_id_files`` sorts documents by range of their key, and each task writes
segments: a run of whole documents, about ``SEGMENT`` ids, as one record of the
file format below.  ``read_id_files`` decodes segments again, each by itself, to
ids per document and the place of each document in the whole.

The records travel in Parquet files written by Spark, so any store that Spark
reaches serves, and Spark's committer keeps half-written files of a lost
executor out.  A record: magic, number of documents, their keys (int64) and id
counts (uint32), crc32 of that head, then the coded blocks (``idcoder``).

Defined results: a null text is an empty document (its end id alone); a null key
sorts first and is kept; repeated keys stay in one order between write and read;
an empty table gives no files' rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.idcoder import MAGIC, BlockError, decode_blocks, encode_blocks
from parley.llm.store import documents, scratch
from parley.llm.textcols import raw, slices
from parley.llm.tokens import encode, vocabulary

SEGMENT = 4 << 20
_NULL = -(1 << 63)


def pack_segment(keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    head = struct.pack("<I", len(keys)) + keys.astype("<i8").tobytes() + counts.astype("<u4").tobytes()
    return MAGIC + head + struct.pack("<I", zlib.crc32(head)) + encode_blocks(ids)


def unpack_segment(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if blob[: len(MAGIC)] != MAGIC:
        raise BlockError("not a segment")
    at = len(MAGIC)
    (n,) = struct.unpack_from("<I", blob, at)
    end = at + 4 + 12 * n
    if zlib.crc32(blob[at:end]) != struct.unpack_from("<I", blob, end)[0]:
        raise BlockError("head: checksum does not hold")
    keys = np.frombuffer(blob, "<i8", n, at + 4)
    counts = np.frombuffer(blob, "<u4", n, at + 4 + 8 * n)
    return keys, counts.astype(np.int64), decode_blocks(blob[end + 4 :])


def write_id_files(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = 2) -> None:
    """Write the ids of all documents, ascending by ``key``, under ``path``."""
    vocab = vocabulary(tokenizer)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment = TaskContext.get().partitionId(), 0
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            k, c, i = np.concatenate(keys), np.concatenate(counts), np.concatenate(ids)
            del keys[:], counts[:], ids[:]
            return pa.RecordBatch.from_pylist([{"shard": shard, "segment": segment, "n_docs": len(k), "n_ids": len(i), "payload": pack_segment(k, c, i)}], schema=arrow)

        arrow = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
        for part in slices(batches, text):
            got, offs = encode(vocab, *raw(part.column(text)), end_id)
            ids.append(got)
            counts.append(np.diff(offs))
            keys.append(part.column(key).cast(pa.int64()).fill_null(_NULL).to_numpy(zero_copy_only=False))
            if sum(map(len, ids)) >= SEGMENT:
                yield close()
                segment += 1
        if ids:
            yield close()

    parts = max(1, df.rdd.getNumPartitions())
    ordered = df.select(key, text).repartitionByRange(parts, key).sortWithinPartitions(key, text)
    ordered.mapInArrow(task, "shard int, segment int, n_docs long, n_ids long, payload binary").write.option("compression", "none").parquet(path)


def read_id_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids as little-endian uint32 bytes) of every document in the files."""
    files = spark.read.parquet(path)
    # Shards are as many as tasks wrote; only their totals meet in one place.
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("own"))
    shards = shards.select("shard", (F.coalesce(F.sum("own").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    order = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = files.select("shard", "segment", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("within")).join(shards, "shard")
    segments = segments.select("shard", "segment", (F.col("within") + F.col("before")).alias("base"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, counts, ids = unpack_segment(batch.column(2)[row].as_py())
                offs = np.concatenate(([0], np.cumsum(counts)))
                flat = ids.astype("<u4").view(np.uint8)
                step = max(1, len(keys) * (16 << 20) // max(1, len(flat)))
                for lo in range(0, len(keys), step):
                    hi = min(lo + step, len(keys))
                    body = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(((offs[lo : hi + 1] - offs[lo]) * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat[offs[lo] * 4 : offs[hi] * 4]))])
                    n = hi - lo
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, batch.column(0)[row].as_py()), pa.int32()), pa.array(np.full(n, batch.column(1)[row].as_py()), pa.int32()), pa.array(keys[lo:hi], pa.int64(), mask=keys[lo:hi] == _NULL), pa.array(offs[lo:hi], pa.int64()), pa.array(counts[lo:hi], pa.int64()), body],
                        names=["shard", "segment", key, "local", "n_tokens", "ids"],
                    )

    docs = files.select("shard", "segment", "payload").mapInArrow(task, f"shard int, segment int, `{key}` long, local long, n_tokens long, ids binary")
    return docs.withColumn("ids_crc32", F.crc32("ids")).join(segments, ["shard", "segment"]).select(key, (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids", "ids_crc32")


def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "idfiles")
    write_id_files(documents(spark, sf_dir), path)
    return read_id_files(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op9_id_files": op9_id_files}
ORACLE_SQL: dict[str, str] = {}
