"""Stratified samples with quotas, blind ids, and job lists."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.ranking import numbered


def hash_order(seed: int, *keys: str) -> Column:
    """A seeded order that needs no driver: md5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def round_robin(units: DataFrame, groups: list[str], unit: str, capacity: str, quota: int, seed: int) -> DataFrame:
    """Deal ``quota`` places one at a time over each group's units in seeded order; full units are passed over.

    A quota that a group's units can't hold is an error.
    """
    room = units.groupBy(*groups).agg(F.sum(capacity).alias("__room"))
    fits = F.when(F.col("__room") >= quota, F.col(capacity)).otherwise(F.raise_error(F.lit("the quota is larger than a group holds")))
    units = units.join(room, groups).withColumn(capacity, fits).drop("__room")
    order = Window.partitionBy(*groups).orderBy(hash_order(seed, unit))
    slots = units.withColumn("__pos", F.row_number().over(order)).select(*groups, unit, capacity, "__pos", F.explode(F.sequence(F.lit(1), F.least(F.col(capacity).cast("int"), F.lit(quota)))).alias("__slot"))
    dealt = slots.withColumn("__r", F.row_number().over(Window.partitionBy(*groups).orderBy("__slot", "__pos"))).where(F.col("__r") <= quota)
    return dealt.groupBy(*groups, unit).agg(F.count("*").alias("allocated"))


def draw(rows: DataFrame, groups: list[str], unit: str, key: str, quota: int, seed: int) -> DataFrame:
    """Two stages: a quota per group spread over units, then a seeded pick of rows inside each unit."""
    units = rows.groupBy(*groups, unit).agg(F.count("*").alias("__cap"))
    allocated = round_robin(units, groups, unit, "__cap", quota, seed)
    place = F.row_number().over(Window.partitionBy(*groups, unit).orderBy(hash_order(seed, key)))
    return rows.withColumn("__place", place).join(allocated, [*groups, unit]).where(F.col("__place") <= F.col("allocated")).drop("__place", "allocated")


def blind_ids(df: DataFrame, key: str, seed: int, prefix: str, width: int = 3) -> DataFrame:
    """Number rows in seeded order, independently of any other column; a table of any size."""
    rows = numbered(df, [hash_order(seed, key), key], "__n")
    return rows.withColumn("blind_id", F.format_string(f"{prefix}%0{width}d", "__n")).drop("__n")


def shuffled_ids(ids: list[str], seed: int | str) -> list[str]:
    """The Mersenne Twister shuffle of sorted ids, for lists that must be reproduced exactly."""
    out = sorted(ids)
    random.Random(seed).shuffle(out)
    return out


def jobs(scenarios: DataFrame, agents: list[str], reps: int, seed_of=None) -> DataFrame:
    """repetition x scenario x agent with its place in that order; both multipliers are short constant lists."""
    a = F.posexplode(F.array(*map(F.lit, agents)))
    rows = scenarios.select("scenario_id", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("repetition"))
    return rows.select("scenario_id", "repetition", a.alias("agent_order", "agent"))


def pending(all_jobs: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Jobs without an output yet: what a resumed run still has to do."""
    return all_jobs.join(done.select(*key).distinct(), key, "left_anti")
