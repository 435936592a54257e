"""Answers of an external model, by replay.

The model is an opaque function with a content-addressed cache.  Offline, a
request is answered by joining its hash with the cache; what is not there is
returned as misses instead of being called.
"""

from __future__ import annotations

import hashlib
import json
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Backend(Protocol):
    """Anything that answers a table of requests."""

    def answer(self, requests: DataFrame) -> DataFrame: ...


def _digest(model: str, digest: str, messages: str, options: str, schema: str | None) -> str:
    body = {"model": model, "digest": digest, "messages": json.loads(messages), "options": json.loads(options), "format": json.loads(schema) if schema else None}
    return hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


@F.pandas_udf(T.StringType())
def prompt_hash(model: pd.Series, digest: pd.Series, messages: pd.Series, options: pd.Series, schema: pd.Series) -> pd.Series:
    """sha256 of the request as JSON with sorted keys; ``messages``, ``options`` and ``schema`` are JSON texts."""
    return pd.Series([_digest(*r) for r in zip(model, digest, messages, options, schema, strict=True)])


class ReplayBackend:
    """Answers from a cache table of (prompt_hash, text)."""

    def __init__(self, cache: DataFrame) -> None:
        self.cache = cache.dropDuplicates(["prompt_hash"])

    def answer(self, requests: DataFrame) -> DataFrame:
        return requests.join(self.cache, "prompt_hash")

    def misses(self, requests: DataFrame) -> DataFrame:
        return requests.join(self.cache, "prompt_hash", "left_anti")


def parsed(text: Column, schema: str) -> Column:
    """JSON text to a struct; a text that does not fit is null."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def enum_ok(values: Column, allowed: list[str]) -> Column:
    return F.forall(values, lambda v: F.array_contains(F.array(*map(F.lit, allowed)), v))


def prefix_digests(messages: Column) -> Column:
    """Chained digests of every prefix of an array of (role, content), the empty one first: equal digests, equal histories."""
    text = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    said = lambda m: F.concat(text(F.coalesce(m["role"], F.lit(""))), text(F.coalesce(m["content"], F.lit(""))))
    return F.aggregate(messages, F.array(F.sha2(F.lit(""), 256)), lambda acc, m: F.concat(acc, F.array(F.sha2(F.concat(F.element_at(acc, -1), said(m)), 256))))


def retry_candidates(dialogues: DataFrame, calls: DataFrame, key: list[str], schema: str) -> DataFrame:
    """(key, turn, attempt, seed, text, reply): what the simulated user was recorded to say at each turn, in order.

    ``dialogues`` has the key, seed, persona, goal and messages; ``calls`` has persona, goal, messages,
    text, timestamp and prompt_hash.  A call meets the turn whose history it repeats by one equi-join on the
    chained digest of that history beside persona and goal.  ``turn`` counts the messages before; the seed
    goes up with each attempt; a text that does not fit ``schema`` has a null reply.
    """
    told = lambda df: df.withColumn("__h", prefix_digests(F.col("messages")))
    turns = told(dialogues).select(*key, "seed", "persona", "goal", F.posexplode("__h").alias("turn", "__h"))
    asked = told(calls).select("persona", "goal", F.element_at("__h", -1).alias("__h"), "text", "timestamp", "prompt_hash")
    order = Window.partitionBy(*key, "turn").orderBy("timestamp", "prompt_hash", "text")
    met = turns.join(asked, ["persona", "goal", "__h"]).withColumn("attempt", F.row_number().over(order) - 1)
    return met.select(*key, "turn", "attempt", (F.col("seed") + F.col("attempt")).alias("seed"), "text", parsed(F.col("text"), schema).alias("reply"))
