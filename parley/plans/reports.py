"""Queries of run reports, plot tables and the table of unscored dialogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import calls, paired
from parley.plans.files import _new
from parley.plans.frames import E_SQL, METRICS, e_frame, read
from parley.plans.registry import query, rounded
from parley.sources import readers, writers


@query("""WITH c AS (SELECT user_id % 97 AS run, event_type, length(props) AS tokens, value, event_id % 3 = 0 AS cached FROM events),
m AS (SELECT o_custkey % 101 AS run, count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 7 <> 0) AS n_ok, count(*) FILTER (o_orderstatus = 'P' AND o_custkey % 11 <> 0) AS n_failed, sum(CAST(o_totalprice AS DOUBLE)) AS elapsed FROM orders GROUP BY ALL),
f AS (SELECT run, count(*) AS n_calls, count(*) FILTER (cached) AS n_cached, coalesce(sum(value) FILTER (NOT cached AND event_type IN ('error', 'signup')), 0) AS live,
             avg(tokens) FILTER (event_type = 'click') + avg(tokens) FILTER (event_type = 'purchase') AS turn FROM c GROUP BY ALL)
SELECT m.run, coalesce(n_calls, 0) AS n_calls, coalesce(n_cached, 0) AS n_cached, round(CASE WHEN n_ok + n_failed > 0 THEN elapsed / (n_ok + n_failed) END, 4) AS run_s_per_dialogue,
round(CASE WHEN n_ok > 0 THEN coalesce(live, 0) / n_ok END, 6) AS eval_s_per_dialogue, round(turn, 6) AS turn_prompt_tokens FROM m LEFT JOIN f USING (run)""")
def q_run_report(spark, sf):
    log = read(spark, sf, "events").select((F.col("user_id") % 97).alias("run"), "event_type", F.length("props").alias("tokens"), "value", (F.col("event_id") % 3 == 0).alias("cached"))
    ok, failed = (F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 7 != 0), (F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 11 != 0)
    runs = read(spark, sf, "orders").groupBy((F.col("o_custkey") % 101).alias("run")).agg(F.count_if(ok).alias("n_ok"), F.count_if(failed).alias("n_failed"), F.sum(F.col("o_totalprice").cast("double")).alias("elapsed_s"))
    report = calls.run_report(log, runs, "run", "event_type", "tokens", "value", "cached", ["error", "signup"], ["click", "purchase"])
    return report.select("run", "n_calls", "n_cached", F.round("run_s_per_dialogue", 4).alias("run_s_per_dialogue"), *paired.round6("eval_s_per_dialogue", "turn_prompt_tokens"))


@query(f"WITH {E_SQL} SELECT metric, agent, scenario_id, round(mean, 6) AS value, row_number() OVER (PARTITION BY metric, agent ORDER BY scenario_id) AS position FROM scores")
def q_plot_values(spark, sf):
    return rounded(paired.plot_values(e_frame(spark, sf), METRICS))


@query("""WITH u AS (SELECT o_orderkey AS number, printf('edge_%04d', CAST(o_custkey % 5000 AS INTEGER)) AS scenario_id, CASE WHEN o_orderkey % 13 <> 0 THEN 'fsm' END AS agent,
CASE WHEN o_orderkey % 17 = 0 THEN 'rep' || o_orderkey ELSE CAST(o_orderkey % 3 + 1 AS VARCHAR) END AS repetition, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority || ', "' || o_orderkey || '"' END AS reason FROM orders)
SELECT 'unscored' AS kind, scenario_id || '__fsm__rep0' || repetition AS item, arg_max(reason, number) AS reason FROM u WHERE agent IS NOT NULL AND number % 17 <> 0 GROUP BY scenario_id, repetition
UNION ALL SELECT 'fault', concat_ws('|', scenario_id, coalesce(agent, ''), repetition), '' FROM u WHERE agent IS NULL OR number % 17 = 0""")
def q_unscored(spark, sf):
    k, path = F.col("o_orderkey"), _new(spark, "unscored")
    rows = read(spark, sf, "orders").select(
        k.alias("number"),
        F.format_string("edge_%04d", F.col("o_custkey") % 5000).alias("scenario_id"),
        F.when(k % 13 != 0, "fsm").alias("agent"),
        F.when(k % 17 == 0, F.concat(F.lit("rep"), k)).otherwise((k % 3 + 1).cast("string")).alias("repetition"),
        F.when(k % 5 == 0, None).otherwise(F.concat("o_orderpriority", F.lit(', "'), k, F.lit('"'))).alias("reason"),
    )
    writers.csv_table(rows, path, ["number", "scenario_id", "agent", "repetition", "reason"], ["number"])
    reasons, faults = readers.unscored(spark, path)
    item = F.concat_ws("|", "scenario_id", F.coalesce("agent", F.lit("")), "repetition")
    return reasons.select(F.lit("unscored").alias("kind"), F.col("dialogue_id").alias("item"), "reason").unionByName(faults.select(F.lit("fault").alias("kind"), item.alias("item"), F.lit("").alias("reason")))
