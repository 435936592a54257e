"""Containment joins: a text of one table inside a text of another.

A plain theta join compares every pair.  Here a contained text of five words or
more meets only texts that hold one of its inner runs of three words, its
rarest; the containment itself is then checked on the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

RUN = 3
#: Bytes of the needles that one automaton holds.
BLOCK_BYTES = 4 << 20


def _runs(words):
    """Runs of three words; ``words`` is bound once, so that it is not split again for every run."""

    def of(w):
        last = F.greatest(F.size(w) - RUN, F.lit(-1))
        return F.when(F.size(w) >= RUN, F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(RUN)]))).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(words), of)[0]


def contains_join(needles: DataFrame, needle_id: str, needle: str, hay: DataFrame, hay_id: str, text: str) -> DataFrame:
    """(needle_id, hay_id) pairs where ``text`` holds ``needle`` literally.

    Needles under five words (the outer two may be parts of words) have no inner run: automata of bounded
    blocks of them read the texts.  Runs are told apart by hash, as the text is checked; rows of runs carry no
    text, and texts are not broadcast, as their size in memory can be a multiple of that in a shuffle.
    """
    split = lambda c: F.filter(F.split(c, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    n = needles.select(needle_id, F.col(needle).alias("__needle")).where(F.col("__needle").isNotNull()).withColumn("__w", split(F.col("__needle")))
    hashed = lambda w: F.explode(F.array_distinct(F.transform(_runs(w), lambda r: F.xxhash64(r)))).alias("__run")
    inner = n.where(F.size("__w") >= RUN + 2).select(needle_id, hashed(F.slice(F.col("__w"), F.lit(2), F.size("__w") - 2)))
    h = hay.select(hay_id, F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    runs = h.select(hay_id, hashed(split(F.col("__text"))))
    seen = runs.join(inner.select("__run").distinct(), "__run", "left_semi")
    often = seen.groupBy("__run").agg(F.count("*").alias("__df"))
    # A run that no text has can't be contained: such needles drop out here.
    rated = inner.join(often, "__run", "left").groupBy(needle_id).agg(F.min(F.struct("__df", "__run")).alias("__least"), F.count_if(F.col("__df").isNull()).alias("__lost"))
    rarest = rated.where("__lost = 0").select(needle_id, F.col("__least.__run").alias("__run"))
    met = rarest.join(seen, "__run").select(needle_id, hay_id).distinct()
    beside = met.join(n.select(needle_id, "__needle").hint("merge"), needle_id)
    found = beside.join(h.hint("merge"), hay_id).where(F.contains("__text", "__needle")).select(needle_id, hay_id)
    short = n.where(F.size("__w") < RUN + 2).select(F.col(needle_id).alias("nid"), F.col("__needle").alias("needle"))
    return found.unionByName(automaton_matches(short, h.select(F.col(hay_id).alias("hid"), F.col("__text").alias("text"))).toDF(needle_id, hay_id)).distinct()


def _reader(nid: pa.DataType, hid: pa.DataType):
    """Task over sorted rows: of each block the needles come first and build an automaton, then the texts run through it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, machine, empty, ready = None, None, [], False
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for block, needle, text, i, j in zip(*(batch.column(c).to_pylist() for c in ("block", "needle", "text", "nid", "hid")), strict=True):
                if block != at:
                    at, machine, empty, ready = block, ahocorasick.Automaton(), [], False
                if needle is not None:
                    if needle:
                        machine.add_word(needle, (*machine.get(needle, ()), i))
                    else:
                        empty.append(i)
                    continue
                if not ready and len(machine):
                    machine.make_automaton()
                ready = True
                held = set(empty)
                if len(machine):
                    for _, ids in machine.iter(text):
                        held.update(ids)
                found[0].extend(held)
                found[1].extend([j] * len(held))
            yield pa.RecordBatch.from_arrays([pa.array(found[0], nid), pa.array(found[1], hid)], names=["nid", "hid"])

    return task


def automaton_matches(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """(nid, hid) of the texts (hid, text) that hold a needle (nid, needle), of any length; an empty needle is in every text.

    Needles form blocks of at most ``BLOCK_BYTES``, texts are dealt over tasks, and a task streams its texts through the
    automaton of its block (of both, one row at a time): texts are sent once for each block.
    """
    size = needles.agg(F.coalesce(F.sum(F.octet_length("needle") + 16), F.lit(0))).first()[0]
    if not size:
        return needles.select("nid").join(hay.select("hid"), F.lit(False))
    blocks, parts = -(-size // BLOCK_BYTES), int(hay.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = needles.select("nid", "needle", place("needle", blocks).alias("block"), every(parts).alias("part"))
    right = hay.where("text IS NOT NULL").select("hid", "text", every(blocks).alias("block"), F.pmod(F.xxhash64("hid", "text"), F.lit(parts)).cast("int").alias("part"))
    met = left.unionByName(right, allowMissingColumns=True).repartition(blocks * parts, "block", "part").sortWithinPartitions("block", "part", F.col("needle").asc_nulls_last())
    met = met.select(F.concat_ws("/", "block", "part").alias("block"), "needle", "text", "nid", "hid")
    types = {f.name: f.dataType for f in met.schema.fields}
    arrow = {c: to_arrow_type(types[c]) for c in ("nid", "hid")}
    return met.mapInArrow(_reader(arrow["nid"], arrow["hid"]), f"nid {types['nid'].simpleString()}, hid {types['hid'].simpleString()}")


def unique_attribution(pairs: DataFrame, needles: DataFrame, needle_id: str, hay_id: str) -> DataFrame:
    """Each needle with its text if exactly one holds it, else as unmatched with the number of hits."""
    hits = pairs.groupBy(needle_id).agg(F.count("*").alias("hits"), F.min(hay_id).alias("only"))
    found = needles.select(needle_id).join(hits, needle_id, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return found.select(needle_id, "hits", F.when(F.col("hits") == 1, F.col("only")).alias(hay_id), F.when(F.col("hits") == 1, "matched").otherwise("unmatched").alias("status"))


def reconstruct(calls: DataFrame, call_text: str, answer: str, dialogues: DataFrame, key: str, transcript: str, latest: str) -> DataFrame:
    """The last answer of the calls whose prompt holds exactly one dialogue's transcript.

    Equal prompts and equal transcripts meet once, however many there are.
    """
    prompts = calls.groupBy(call_text).agg(F.max_by(answer, latest).alias(answer), F.max(latest).alias(latest)).withColumn("__call", F.sha2(call_text, 256))
    texts = dialogues.groupBy(transcript).agg(F.min(key).alias(key), F.count("*").alias("__same"))
    pairs = contains_join(texts, key, transcript, prompts, "__call", call_text).join(texts.select(key, "__same"), key)
    one = pairs.groupBy("__call").agg(F.sum("__same").alias("__n"), F.min(key).alias(key)).where("__n = 1").drop("__n")
    return one.join(prompts.select("__call", answer, latest), "__call").groupBy(key).agg(F.max_by(answer, latest).alias(answer))
