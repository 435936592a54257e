"""Statistics of a call log: per caller, per role, per prompt budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.ranking import order_statistics


def caller_stats(calls: DataFrame, caller: str, prompt: str, output: str, latency: str, cached: str) -> DataFrame:
    """Mean tokens over all calls, mean latency over those that were not cached."""
    return calls.groupBy(caller).agg(F.count("*").alias("n"), F.count_if(F.col(cached)).alias("n_cached"), F.avg(prompt).alias("mean_prompt_tokens"), F.avg(output).alias("mean_output_tokens"), F.avg(F.when(~F.col(cached), F.col(latency))).alias("mean_latency_s"))


def prompt_summary(calls: DataFrame, caller: str, tokens: str, chars: Column, budget: float) -> DataFrame:
    ratio = F.col(tokens) / chars
    return calls.groupBy(caller).agg(F.count("*").alias("n"), F.avg(tokens).alias("mean_tokens"), F.max(tokens).alias("max_tokens"), F.count_if(F.col(tokens) > budget).alias("over_budget"), F.min(ratio).alias("min_per_char"), F.max(ratio).alias("max_per_char"))


def message_chars(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0), lambda a, m: a + F.length(m["content"]))


def role_stats(calls: DataFrame, role: str, latency: str, tokens: str, order: str) -> DataFrame:
    """n, mean, nearest-rank p95 and throughput per role, in order of first appearance."""
    sums = calls.groupBy(role).agg(F.min(order).alias("first_seen"), F.count("*").alias("n"), F.avg(latency).alias("mean_s"), F.avg(tokens).alias("mean_tokens"), (F.sum(tokens) / F.sum(latency)).alias("tokens_per_s"))
    late = order_statistics(calls, [role], latency, {"p95_s": 0.95}, nearest=True).drop("n")
    return sums.join(late, role, "left").select(role, "first_seen", "n", "mean_s", "p95_s", "mean_tokens", "tokens_per_s").orderBy("first_seen")


def run_hours(mean_s: float, dialogues: int, turns: float, parallel: int) -> float:
    return mean_s * dialogues * turns / parallel / 3600


def judge_hours(mean_s: float, dialogues: int, calls_per_dialogue: float, parallel: int) -> float:
    return mean_s * dialogues * calls_per_dialogue / parallel / 3600


def over_budget(calls: DataFrame, tokens: str, context: int, share: float = 0.8) -> DataFrame:
    return calls.where(F.col(tokens) > share * context)


def run_report(calls: DataFrame, manifests: DataFrame, run: str, caller: str, prompt: str, latency: str, cached: str, judges: list[str], turn_callers: list[str]) -> DataFrame:
    """A row for each run of ``manifests`` (run, n_ok, n_failed, elapsed_s), with or without calls in the log.

    Seconds of play for each dialogue that was played, seconds of uncached calls by ``judges`` for each that
    succeeded, and the prompt of a turn: the mean tokens of every caller of ``turn_callers``, added.  A figure
    whose divisor is 0, or that lacks a caller, is null; a run without calls has 0 of them.
    """
    live = F.when(F.col(caller).isin(judges) & ~F.col(cached), F.col(latency))
    turn = [F.avg(F.when(F.col(caller) == c, F.col(prompt))) for c in turn_callers]
    found = calls.groupBy(run).agg(F.count("*").alias("n_calls"), F.count_if(F.col(cached)).alias("n_cached"), F.coalesce(F.sum(live), F.lit(0.0)).alias("__live"), sum(turn[1:], turn[0]).alias("turn_prompt_tokens"))
    rows = manifests.join(found, run, "left").fillna(0, ["n_calls", "n_cached", "__live"])
    played = F.col("n_ok") + F.col("n_failed")
    return rows.select(
        run,
        "n_calls",
        "n_cached",
        F.when(played > 0, F.col("elapsed_s") / played).alias("run_s_per_dialogue"),
        F.when(F.col("n_ok") > 0, F.col("__live") / F.col("n_ok")).alias("eval_s_per_dialogue"),
        "turn_prompt_tokens",
    )
