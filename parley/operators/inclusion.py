"""Inclusion of failed dialogues: discovery, a selection that is checked in one pass, and its lock.

A selection names dialogues whose failure is held to be the instrument's.  All
rules are columns of one plan: the selection meets the logs and the discovery by
equi-joins on the id, every refusal of an id is listed beside it, and the number
of refusals by rule comes back as observed metrics of the job that writes the
checked selection, so no rule costs a job of its own and none hides another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from parley.functions.cells import parse_dialogue_id
from parley.operators.provenance import table_digest
from parley.sources.readers import exists
from parley.sources.scratch import written

RULES = ("malformed_id", "repeated_id", "not_in_run", "several_logs", "status", "failure_class", "not_discovered")


def discover(logs: DataFrame, kind: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """(census of failure classes, candidates): failed dialogues by class, and those of the class that may be included."""
    failed = logs.where("status = 'failed'")
    target = F.col("failure_kind").eqNullSafe(F.lit(kind)) & F.col("failure_reason").eqNullSafe(F.lit(reason))
    census = failed.groupBy("failure_kind", "failure_reason").agg(F.count("*").alias("n")).withColumn("target", target)
    return census, failed.where(target)


def check_selection(selection: DataFrame, logs: DataFrame, candidates: DataFrame, kind: str, reason: str) -> tuple[DataFrame, Observation]:
    """Each distinct id of a selection (``dialogue_id``, ``place``) with its log and all refusals; counts of refusals by rule.

    The counts are there once the returned table has been written or collected in whole.
    """
    # A log's fields under one name, so that one aggregation keeps them together; the least of several logs stands for them.
    log = F.struct("status", "failure_kind", "failure_reason")
    own = logs.groupBy("dialogue_id").agg(F.count("*").alias("n_logs"), F.min(log).alias("log"))
    ids = selection.groupBy("dialogue_id").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    found = candidates.select("dialogue_id", F.lit(True).alias("discovered")).distinct()
    rows = ids.join(own, "dialogue_id", "left").join(found, "dialogue_id", "left")
    there, formed = F.col("n_logs").isNotNull(), parse_dialogue_id(F.col("dialogue_id")).isNotNull()
    fit = F.col("log.failure_kind").eqNullSafe(F.lit(kind)) & F.col("log.failure_reason").eqNullSafe(F.lit(reason))
    name = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    broken: dict[str, tuple[Column, Column]] = {
        "malformed_id": (~formed, F.col("dialogue_id")),
        "repeated_id": (F.col("n") > 1, F.col("n").cast("string")),
        "not_in_run": (formed & ~there, F.col("dialogue_id")),
        "several_logs": (F.col("n_logs") > 1, F.col("n_logs").cast("string")),
        "status": (formed & there & (F.col("log.status") != "failed"), name(F.col("log.status"))),
        "failure_class": (formed & there & ~fit, F.concat_ws("/", name(F.col("log.failure_kind")), name(F.col("log.failure_reason")))),
        "not_discovered": (formed & there & F.col("discovered").isNull(), F.col("dialogue_id")),
    }
    refusals = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(r).alias("rule"), what.alias("found"))) for r, (rule, what) in broken.items()]))
    checked = rows.select("dialogue_id", "place", "log.status", "log.failure_kind", "log.failure_reason", refusals.alias("refusals"))
    counts = Observation()
    has = lambda r: F.count_if(F.exists("refusals", lambda x: x["rule"] == r)).alias(r)
    return checked.observe(counts, F.count("*").alias("ids"), *map(has, RULES)), counts


def refused(checked: DataFrame) -> DataFrame:
    """(dialogue_id, rule, found) of every refusal."""
    return checked.select("dialogue_id", F.inline("refusals"))


def included(checked: DataFrame) -> DataFrame:
    """The ids that nothing speaks against, with the place that the selection gave them."""
    return checked.where(F.size("refusals") == 0).drop("refusals")


def require_accepted(counts: Observation) -> int:
    """The number of ids of a checked selection; an error that counts each broken rule if any is refused."""
    seen = counts.get
    broken = {r: seen[r] for r in RULES if seen[r]}
    if broken:
        raise ValueError(f"the selection is refused: {broken}")
    return seen["ids"]


def lock(selection: DataFrame, logs: DataFrame, candidates: DataFrame, kind: str, reason: str, path: str, replace: bool = False) -> str:
    """Freeze an accepted selection at ``path`` and return its digest.

    The same selection again leaves the files as they are; another one is refused unless ``replace``.
    """
    spark = selection.sparkSession
    checked, counts = check_selection(selection, logs, candidates, kind, reason)
    checked = written(checked, "selection")
    require_accepted(counts)
    kept = included(checked).select("dialogue_id", "failure_kind", "failure_reason")
    digest = table_digest(kept, kept.columns).first()["digest"]
    if exists(spark, path):
        held = spark.read.parquet(path)
        if table_digest(held, kept.columns).first()["digest"] == digest:
            return digest
        if not replace:
            raise ValueError(f"{path} holds another selection")
    kept.write.mode("overwrite").parquet(path)
    return digest


def with_provenance(scored: DataFrame, logs: DataFrame, listed: DataFrame, adjudication: str, source: str) -> DataFrame:
    """Scored rows beside the runtime status of their log and the reason why they count."""
    marks = listed.select("dialogue_id", F.lit(True).alias("__listed")).distinct()
    rows = scored.join(logs.select("dialogue_id", F.col("status").alias("runtime_status"), "failure_kind", "failure_reason"), "dialogue_id").join(marks, "dialogue_id", "left")
    why = F.when(F.col("__listed"), source).when(F.col("runtime_status") == "ok", "status=ok").otherwise(F.raise_error(F.concat(F.col("dialogue_id"), F.lit(" failed and is not listed"))))
    return rows.withColumn("adjudication", F.when(F.col("__listed"), adjudication)).withColumn("adjudication_date", F.lit(None).cast("date")).withColumn("inclusion_source", why).drop("__listed")


def inclusion_record(provenance: DataFrame) -> DataFrame:
    """Counts of what a scored table holds and why, by source of inclusion."""
    ok = F.col("runtime_status") == "ok"
    return provenance.groupBy("inclusion_source").agg(F.count("*").alias("n_scored"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_included_failed"))


def census_faults(audited: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(count, expected, found) where a census does not have the accounting that was frozen, or does not close.

    ``audited`` has execution_status, failure_class, primary_status and frozen_status; one aggregation counts all.
    """
    is_class = lambda c: F.count_if(F.col("failure_class") == c)
    counts = {
        "jobs": F.count("*"),
        "ok": F.count_if(F.col("execution_status") == "ok"),
        "false_positives": is_class("instrument_contract_false_positive"),
        "max_turns": is_class("max_turns_with_incomplete_beat"),
        "true_failures": is_class("instrument_true_failure"),
        "unscored": F.count_if(F.col("primary_status") == "excluded_unscored"),
        "frozen": F.count_if(F.col("frozen_status") == "included_frozen"),
        "semantic": F.count_if(F.col("primary_status") == "included_semantic"),
    }
    unknown = set(expected) - set(counts)
    if unknown:
        raise ValueError(f"no such counts: {sorted(unknown)}")
    sums = audited.agg(*[c.alias(n) for n, c in counts.items()])
    parts = reduce(lambda a, b: a + b, [F.col(n) for n in ("ok", "false_positives", "max_turns", "true_failures")])
    row = lambda n, want, got: F.struct(F.lit(n).alias("count"), want.cast("long").alias("expected"), got.alias("found"))
    rows = [row(n, F.lit(e), F.col(n)) for n, e in expected.items()] + [row("parts_of_jobs", F.col("jobs"), parts)]
    return sums.select(F.inline(F.array(*rows))).where("expected <> found")
