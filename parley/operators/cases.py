"""Case selection: direction inversions, ranked candidates, exemplars, common repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.cells import OVERALL, bucket, direction
from parley.operators.ranking import numbered


def direction_inversions(wtl: DataFrame) -> DataFrame:
    """Each stratum's direction beside its metric's overall direction, and whether they oppose."""
    rows = wtl.withColumn("direction", direction(F.col("mean_diff")))
    overall = F.max(F.when(F.col("stratum") == OVERALL, F.col("direction"))).over(Window.partitionBy("metric"))
    return rows.withColumn("overall_direction", overall).withColumn("inverted", (F.col("stratum") != OVERALL) & (F.col("direction") != F.col("overall_direction")))


def rank_candidates(pairs: DataFrame, metrics: tuple[str, str, str], dropped: list[str] | DataFrame | None = None, preferred: str = "happy_path") -> DataFrame:
    """Per scenario the differences of three metrics, a composite of those there are, a bucket and a rank inside it."""
    wide = pairs.groupBy("category", "scenario_id").agg(*[F.max(F.when(F.col("metric") == m, F.col("diff"))).alias(f"d_{m}") for m in metrics])
    if isinstance(dropped, DataFrame):
        wide = wide.join(dropped.select("scenario_id").distinct(), "scenario_id", "left_anti")
    elif dropped:
        wide = wide.where(~F.col("scenario_id").isin(dropped))
    d = [F.col(f"d_{m}") for m in metrics]
    there = F.array_compact(F.array(*d))
    composite = F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there)
    rows = wide.withColumn("composite", composite).withColumn("bucket", bucket(*d))
    key = F.when(F.col("bucket") == "helped", -F.col("composite")).when(F.col("bucket") == "restricted", F.col("composite")).otherwise(F.when(F.col("category") == preferred, 0.0).otherwise(1.0))
    ranked = numbered(rows.withColumn("__key", key), ["__key", "scenario_id"], "rank", ["bucket"]).drop("__key")
    return ranked.withColumn("rank", F.when(F.col("bucket") != "", F.col("rank").cast("int")))


def exemplars(ranked: DataFrame) -> DataFrame:
    return ranked.where("rank = 1")


def lowest_common_repetition(rows: DataFrame, agents: tuple[str, str] = ("baseline", "fsm")) -> DataFrame:
    """Per scenario the lowest repetition that both agents have."""
    both = rows.where(F.col("agent").isin(*agents)).groupBy("scenario_id", "repetition").agg(F.count_distinct("agent").alias("n")).where("n = 2")
    return both.groupBy("scenario_id").agg(F.min("repetition").alias("repetition"))


def decompose(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Per count and stratum: paired means, mean difference, tallies by direction, dropped scenarios."""
    by = ["metric", "stratum"]
    tallied = pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("baseline").alias("baseline_mean"), F.avg("fsm").alias("fsm_mean"), F.avg("diff").alias("mean_diff"), F.count_if(F.col("diff") > 0).alias("fsm_higher"), F.count_if(F.col("diff") == 0).alias("equal"), F.count_if(F.col("diff") < 0).alias("baseline_higher")
    )
    sides = scores.groupBy(*by, "scenario_id").agg(F.count_distinct("agent").alias("k"))
    lost = sides.groupBy(*by).agg(F.count_if(F.col("k") == 1).alias("n_dropped_unpaired"))
    return lost.join(tallied, by, "left").fillna(0, ["n", "fsm_higher", "equal", "baseline_higher"])


def compare_conclusions(left: DataFrame, right: DataFrame, p: str = "wilcoxon_p", level: float = 0.05) -> DataFrame:
    """Metric by metric: both instruments' directions and whether both call it at ``level``."""
    a = left.select("metric", "stratum", F.col("direction").alias("left_direction"), (F.col(p) < level).alias("left_called"))
    b = right.select("metric", "stratum", F.col("direction").alias("right_direction"), (F.col(p) < level).alias("right_called"))
    return a.join(b, ["metric", "stratum"]).withColumn("same_direction", F.col("left_direction") == F.col("right_direction")).withColumn("same_call", F.col("left_called") == F.col("right_called"))
