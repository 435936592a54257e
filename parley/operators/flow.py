"""State-graph checks: wildcard edges, reachability, closures, and the validity of stage paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.sources.scratch import scratch, written


def expand_wildcards(edges: DataFrame, states: DataFrame) -> DataFrame:
    """An edge from ``*`` becomes one from each state but its own destination; (event, source, dest, from_any)."""
    plain = edges.where("source <> '*'").select("event", "source", "dest", F.lit(False).alias("from_any"))
    wild = edges.where("source = '*'").select("event", "dest").join(states.select(F.col("state").alias("source")), F.col("source") != F.col("dest"))
    return plain.unionByName(wild.select("event", "source", "dest", F.lit(True).alias("from_any")))


def walks_within(edges: DataFrame, limit: int = 2) -> DataFrame:
    """(source, dest) pairs that at most ``limit`` declared edges connect; wildcard edges never extend a walk."""
    one = edges.where("source <> '*'").select("source", "dest").distinct()
    reach = one
    for _ in range(limit - 1):
        step = reach.select("source", F.col("dest").alias("via")).join(one.select(F.col("source").alias("via"), "dest"), "via").select("source", "dest")
        reach = reach.union(step).distinct()
    return reach


def _rounds(first: DataFrame, hop: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``first`` and all that hops lead to, each once.

    Semi-naive: each round hops from the rows of the last round alone and keeps what is new.  What was seen lies in
    one folder, to which rounds are added, and meets the hops in one aggregation: it is never broadcast, so the
    driver gets no seen row again each round, and a scan packs small rounds in a few tasks.
    """
    spark, keys = first.sparkSession, first.columns
    path = scratch(spark, "seen")
    read = spark.read.schema(first.schema)
    first.distinct().write.parquet(path)
    frontier = seen = read.parquet(path)
    while not frontier.isEmpty():
        both = hop(frontier).select(*keys, F.lit(True).alias("__new")).union(seen.select(*keys, F.lit(False)))
        frontier = written(both.groupBy(*keys).agg(F.bool_and("__new").alias("__new")).where("__new").select(*keys), "frontier")
        frontier.write.mode("append").parquet(path)
        seen = read.parquet(path)
    return seen


def reachable(edges: DataFrame, initial: str | DataFrame) -> DataFrame:
    """States that walks from the initial state or states reach, these included; an edge from ``*`` leads on from anywhere."""
    spark = edges.sparkSession
    start = spark.createDataFrame([(initial,)], "state string") if isinstance(initial, str) else initial.select("state")
    steps = written(edges.select(F.col("source").alias("state"), "dest").distinct(), "edges")
    anywhere = steps.where("state = '*'").select(F.col("dest").alias("state"))
    first = start.union(anywhere) if not start.isEmpty() else start
    return _rounds(first, lambda frontier: steps.join(frontier, "state").select(F.col("dest").alias("state")))


def closure(edges: DataFrame) -> DataFrame:
    """(source, dest) of every pair that a walk of declared edges connects, by the same rounds over pairs.

    The result has a row for each pair, so it is for graphs whose closure is wanted, like a machine's.
    """
    one = written(edges.where("source <> '*'").select("source", "dest").distinct(), "edges")
    on = one.select(F.col("source").alias("via"), "dest")
    return _rounds(one, lambda frontier: frontier.select("source", F.col("dest").alias("via")).join(on, "via").select("source", "dest"))


def orphans(edges: DataFrame, states: DataFrame, initial: str) -> DataFrame:
    return states.join(reachable(edges, initial), "state", "left_anti")


def ambiguous_events(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source", "event").agg(F.count_distinct("dest").alias("n")).where("n > 1")


def undeclared_states(edges: DataFrame, states: DataFrame) -> DataFrame:
    used = edges.select(F.explode(F.array("source", "dest")).alias("state")).where("state <> '*'").distinct()
    return used.join(states, "state", "left_anti")


def undeclared_guards(edges: DataFrame, guards: list[str]) -> DataFrame:
    return edges.where(F.col("guard").isNotNull() & ~F.col("guard").isin(guards))


def events_from_any(edges: DataFrame) -> DataFrame:
    return edges.where("source = '*'").groupBy("dest").agg(F.array_sort(F.collect_set("event")).alias("events"))


def events_for(edges: DataFrame, state: str) -> DataFrame:
    return edges.where((F.col("source") == state) | ((F.col("source") == "*") & (F.col("dest") != state))).select("event").distinct().orderBy("event")


def to_mermaid(edges: DataFrame) -> DataFrame:
    """The machine as one text: sorted ``source --> dest : event`` lines."""
    line = F.format_string("    %s --> %s : %s", "source", "dest", "event")
    return edges.where("source <> '*'").agg(F.concat(F.lit("stateDiagram-v2\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("mermaid"))


def step_counts(stages: DataFrame, key: list[str], order: list[str], stage: str) -> DataFrame:
    """Per sequence: stage changes, self-loops and the last stage."""
    w = Window.partitionBy(*key).orderBy(*order)
    steps = stages.withColumn("__prev", F.lag(stage).over(w)).withColumn("__at", F.struct(*order))
    return steps.groupBy(*key).agg(F.count_if(F.col("__prev") != F.col(stage)).alias("n_stage_transitions"), F.count_if(F.col("__prev") == F.col(stage)).alias("n_self_loops"), F.max_by(stage, "__at").alias("last_stage"))


def valid_paths(stages: DataFrame, key: list[str], order: list[str], stage: str, edges: DataFrame, initial: str, limit: int = 2) -> DataFrame:
    """Per sequence whether every step stays, goes to a state reachable from anywhere, or walks at most ``limit`` edges.

    The initial state stands before a sequence that does not begin with it.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    steps = stages.select(*key, F.coalesce(F.lag(stage).over(w), F.lit(initial)).alias("source"), F.col(stage).alias("dest"))
    closure = walks_within(edges, limit).withColumn("near", F.lit(True))
    anywhere = edges.where("source = '*'").select("dest").distinct().withColumn("open", F.lit(True))
    # The machine's tables hold a few states: their size does not follow the data.
    joined = steps.join(F.broadcast(closure), ["source", "dest"], "left").join(F.broadcast(anywhere), "dest", "left")
    ok = (F.col("source") == F.col("dest")) | F.coalesce("open", F.lit(False)) | F.coalesce("near", F.lit(False))
    return joined.groupBy(*key).agg(F.bool_and(ok).alias("valid_flow_path"), F.count_if(~ok).alias("n_invalid_steps"))


def flow_scores(stages: DataFrame, key: list[str], order: list[str], stage: str, edges: DataFrame, initial: str, expected: DataFrame) -> DataFrame:
    """Counts, path validity, and whether a sequence ends where its key's ``expected_final_state`` says."""
    both = step_counts(stages, key, order, stage).join(valid_paths(stages, key, order, stage, edges, initial), key).join(expected, key, "left")
    ended = F.col("last_stage") == F.col("expected_final_state")
    return both.withColumn("ended_in_expected_state", ended).withColumn("flow_adherence", ended & F.col("valid_flow_path"))


def stage_label_accuracy(turns: DataFrame, key: list[str], label: str, gold: str) -> DataFrame:
    """Exact-match rate; all gold null gives null; a part of it null is an error."""
    n, have = F.count("*"), F.count(gold)
    rate = F.avg((F.col(label) == F.col(gold)).cast("double"))
    return turns.groupBy(*key).agg(F.when(have == 0, None).when(have == n, rate).otherwise(F.raise_error(F.lit("some gold labels are missing"))).alias("stage_label_accuracy"))
