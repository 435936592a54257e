"""Experiment frames built from the driver's tables, in Spark and in SQL.

E-frame: one row per dialogue of the ``events`` table (clicks and views), with a
scenario per user and week, the two conditions, and three metrics.
Q-frame: stage sequences per user.  C-frame: conversation turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METRICS = ["m1", "m2", "m3"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def e_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    category = F.element_at(F.array(*map(F.lit, ("happy_path", "edge", "adversarial"))), (F.col("user_id") % 3 + 1).cast("int"))
    number = F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 7)
    rows = ev.select(
        category.alias("category"),
        F.format_string("%s_%06d", category, number).alias("scenario_id"),
        F.when(F.col("event_type") == "click", "baseline").otherwise("fsm").alias("agent"),
        "ts",
        "event_id",
        "user_id",
        F.when(F.col("value") >= 5, F.col("value")).alias("m1"),
        F.get_json_object("props", "$.k").cast("double").alias("m2"),
        (F.col("value") > 50).cast("double").alias("m3"),
    )
    order = Window.partitionBy("scenario_id", "agent").orderBy("ts", "event_id")
    return rows.withColumn("repetition", F.row_number().over(order))


E_SQL = """
e AS (SELECT category, printf('%s_%06d', category, num) AS scenario_id, agent, ts, event_id, user_id,
             row_number() OVER (PARTITION BY printf('%s_%06d', category, num), agent ORDER BY ts, event_id) AS repetition, m1, m2, m3
      FROM (SELECT CASE user_id % 3 WHEN 0 THEN 'happy_path' WHEN 1 THEN 'edge' ELSE 'adversarial' END AS category,
                   CAST(user_id * 10 + (day(ts) - 1) // 7 AS BIGINT) AS num, CASE event_type WHEN 'click' THEN 'baseline' ELSE 'fsm' END AS agent,
                   ts, event_id, user_id, CASE WHEN value >= 5 THEN value END AS m1,
                   CAST(json_extract_string(props, '$.k') AS DOUBLE) AS m2, CAST(value > 50 AS DOUBLE) AS m3
            FROM events WHERE event_type IN ('click', 'view'))),
long AS (SELECT category, scenario_id, agent, repetition, metric, value FROM e UNPIVOT INCLUDE NULLS (value FOR metric IN (m1, m2, m3))),
scores AS (SELECT metric, category, scenario_id, agent, count(*) AS n_reps, avg(value) AS mean, stddev_samp(value) AS sd
           FROM long WHERE value IS NOT NULL GROUP BY ALL),
pairs AS (SELECT metric, category, scenario_id, baseline, fsm, round(fsm - baseline, 12) AS diff FROM (
            SELECT metric, category, scenario_id, max(mean) FILTER (agent = 'baseline') AS baseline, max(mean) FILTER (agent = 'fsm') AS fsm
            FROM scores GROUP BY ALL) WHERE baseline IS NOT NULL AND fsm IS NOT NULL),
sp AS (SELECT *, 'overall' AS stratum FROM pairs UNION ALL SELECT *, category AS stratum FROM pairs)
"""


def q_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("stage"))


Q_SQL = "q AS (SELECT user_id, ts, event_id, event_type AS stage FROM events)"
