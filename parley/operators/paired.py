"""Scenario scores, pairing of two conditions, and counts over the pairs.

The unit is the scenario: repetitions are averaged first with nulls left out,
then the two agents of a scenario are paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.cells import AGENTS, OVERALL, canonical_diff, zero_checkable
from parley.operators.ranking import numbered

KEYS = ["category", "scenario_id", "agent", "repetition"]


def long_metrics(rows: DataFrame, metrics: list[str], keys: list[str] = KEYS) -> DataFrame:
    return rows.select(*keys, *metrics).unpivot(keys, metrics, "metric", "value")


def aggregate_to_scenarios(long: DataFrame, by: tuple[str, ...] = ("metric", "category")) -> DataFrame:
    """Mean, count and sample deviation of the values of a (scenario, agent); all-null groups vanish."""
    return long.where(F.col("value").isNotNull()).groupBy(*by, "scenario_id", "agent").agg(F.count("*").alias("n_reps"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def pair_scenarios(scores: DataFrame, agents: tuple[str, str] = AGENTS, by: tuple[str, ...] = ("metric", "category")) -> DataFrame:
    """One row per scenario that has both agents, by one aggregation instead of a self-join."""
    side = [F.max(F.when(F.col("agent") == a, F.col("mean"))).alias(a) for a in agents]
    wide = scores.where(F.col("agent").isin(*agents)).groupBy(*by, "scenario_id").agg(*side).where(F.col(agents[0]).isNotNull() & F.col(agents[1]).isNotNull())
    return wide.withColumn("diff", canonical_diff(F.col(agents[1]), F.col(agents[0])))


def plot_values(rows: DataFrame, metrics: list[str], agents: tuple[str, str] = AGENTS) -> DataFrame:
    """The points of a plot: for each metric and agent the scenario means, numbered from 1 by scenario.

    Nulls are left out; an agent without values has no rows, and other agents are not drawn.
    """
    long = long_metrics(rows.where(F.col("agent").isin(*agents)), metrics, ["scenario_id", "agent"]).where(F.col("value").isNotNull())
    means = long.groupBy("metric", "agent", "scenario_id").agg(F.avg("value").alias("value"))
    return numbered(means, ["scenario_id"], "position", ["metric", "agent"])


def with_strata(df: DataFrame) -> DataFrame:
    """Each row under its category and under ``overall``."""
    return df.withColumn("stratum", F.explode(F.array(F.lit(OVERALL), F.col("category"))))


def wins_ties_losses(pairs: DataFrame, by: tuple[str, ...] = ("metric", "stratum")) -> DataFrame:
    """Counts by sign, and the mean difference."""
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("diff") > 0).alias("wins"), F.count_if(F.col("diff") == 0).alias("ties"), F.count_if(F.col("diff") < 0).alias("losses"), F.count_if(F.col("diff") != 0).alias("n_nonzero"), F.avg("diff").alias("mean_diff"))


def unpaired(scores: DataFrame, by: tuple[str, ...] = ("metric", "stratum")) -> DataFrame:
    """Scenarios with exactly one agent of any name."""
    sides = scores.groupBy(*by, "scenario_id").agg(F.count_distinct("agent").alias("agents"))
    return sides.groupBy(*by).agg(F.count_if(F.col("agents") == 1).alias("n_unpaired"), F.count("*").alias("n_scenarios"))


def missingness(rows: DataFrame, metric: str, by: tuple[str, ...] = ("stratum",), agents: tuple[str, str] = AGENTS) -> DataFrame:
    """Dialogues and nulls per agent, complete pairs, and the scenarios left over."""
    a, b = agents
    per = rows.groupBy(*by, "scenario_id").agg(
        *[F.count_if(F.col("agent") == x).alias(f"{x}_n") for x in agents],
        *[F.count_if((F.col("agent") == x) & F.col(metric).isNull()).alias(f"{x}_na") for x in agents],
    )
    full = (F.col(f"{a}_n") > F.col(f"{a}_na")) & (F.col(f"{b}_n") > F.col(f"{b}_na"))
    return per.groupBy(*by).agg(*[F.sum(c).alias(c) for c in (f"{a}_n", f"{a}_na", f"{b}_n", f"{b}_na")], F.count_if(full).alias("complete_pairs"), F.count_if(~full).alias("residual"))


def zero_checkable_pairs(rows: DataFrame, n_col: str) -> DataFrame:
    """Pairs of the rate of dialogues without a checkable claim."""
    long = rows.select(*KEYS, F.lit("zero_checkable").alias("metric"), zero_checkable(F.col(n_col)).alias("value"))
    return pair_scenarios(aggregate_to_scenarios(long))


def without_keys(rows: DataFrame, listed: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """Rows without the listed keys; a listed key that is not there is an error."""
    if strict:
        lost = listed.join(rows, keys, "left_anti")
        if not lost.isEmpty():
            raise ValueError("a listed key is missing from the rows")
    return rows.join(listed, keys, "left_anti")


def key_counts(rows: DataFrame, listed: DataFrame, keys: list[str], agents: tuple[str, str] = AGENTS) -> DataFrame:
    """Stratum x agent: dialogues and listed dialogues; cells without rows are kept as 0."""
    marked = with_strata(rows.join(listed.select(*keys).distinct().withColumn("hit", F.lit(1)), keys, "left"))
    found = marked.groupBy("stratum", "agent").agg(F.count("*").alias("total"), F.count("hit").alias("listed"))
    strata = rows.sparkSession.createDataFrame([(s, a) for s in (OVERALL, "happy_path", "edge", "adversarial") for a in agents], "stratum string, agent string")
    return strata.join(found, ["stratum", "agent"], "left").fillna(0, ["total", "listed"])


def population(rows: DataFrame, dropped: list[str] | DataFrame | None) -> DataFrame:
    """Rows without the dropped scenarios: a list of names, or a table of any number of them."""
    if isinstance(dropped, DataFrame):
        return rows.join(dropped.select("scenario_id").distinct(), "scenario_id", "left_anti")
    return rows if not dropped else rows.where(~F.col("scenario_id").isin(dropped))


def named_population(rows: DataFrame, name: str, populations: dict[str, DataFrame | list[str] | None]) -> DataFrame:
    """The rows of a population by its name; a name that is not there is an error that lists those that are."""
    if name not in populations:
        raise ValueError(f"no population {name!r}; there are {sorted(populations)}")
    return population(rows, populations[name])


def round6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]
