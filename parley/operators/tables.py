"""The descriptive and the test table of an experiment, over named populations, and what reports take from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.cells import direction, family, zero_checkable
from parley.operators.paired import KEYS, aggregate_to_scenarios, long_metrics, missingness, pair_scenarios, unpaired, wins_ties_losses, with_strata, without_keys
from parley.operators.ranking import order_statistics
from parley.operators.resampling import N_RESAMPLES, SEED, resampled
from parley.operators.stats import rank_biserial, wilcoxon_p

GROUPS = ["metric", "stratum"]
ZERO_CHECKABLE = "zero_checkable_claim_occurrence"
DIAGNOSTIC = "diagnostic_missingness"
AGENTS = ("baseline", "fsm")


def missing_columns(rows: DataFrame, metric: str) -> DataFrame:
    """stratum x agent: dialogues, null ones, their share, the others, complete pairs and scenarios left over, for one metric."""
    wide = missingness(with_strata(rows), metric)
    sides = F.array(*[F.struct(F.lit(a).alias("agent"), F.col(f"{a}_n").alias("total"), F.col(f"{a}_na").alias("na")) for a in AGENTS])
    long = wide.select("stratum", "complete_pairs", "residual", F.inline(sides))
    return long.select("stratum", "agent", F.lit(metric).alias("metric"), F.col("total").alias("total_dialogues"), F.col("na").alias("na_dialogues"), F.when(F.col("total") > 0, F.col("na") / F.col("total")).alias("na_pct"), (F.col("total") - F.col("na")).alias("aggregatable_dialogues"), "complete_pairs", F.col("residual").alias("pairs_excluded_either_na"))


def descriptive(rows: DataFrame, metrics: list[str], population: str | None = None, missing_of: str | None = None, n_resamples: int = 0, seed: int = SEED, drawn: Column | None = None) -> DataFrame:
    """metric x stratum x agent over scenario means: n, repetitions, mean, deviation, median, mean deviation inside.

    ``n_resamples`` adds the seeded bootstrap interval of the mean (``drawn``: of those cells alone, null elsewhere), ``missing_of`` the missingness columns of that
    metric; a cell of it that has dialogues but no value is kept, with 0 scenarios and nulls.
    """
    scores = with_strata(aggregate_to_scenarios(long_metrics(rows, metrics))).where(F.col("agent").isin(*AGENTS))
    table = scores.groupBy(*GROUPS, "agent").agg(
        F.count("*").alias("n"), F.sum("n_reps").alias("n_dialogues"), F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("sd"), F.avg("sd").alias("mean_intra_sd")
    )
    middle = order_statistics(scores, [*GROUPS, "agent"], "mean", {"median": 0.5}).drop("n")
    table = table.join(middle, [*GROUPS, "agent"])
    if n_resamples:
        asked = scores if drawn is None else scores.where(drawn)
        ci = resampled(asked, [*GROUPS, "agent"], signs=False, n_resamples=n_resamples, seed=seed, value="mean").drop("n")
        table = table.join(ci, [*GROUPS, "agent"], "left")
    if missing_of:
        lost = missing_columns(rows, missing_of).where("total_dialogues > 0")
        table = table.join(lost, [*GROUPS, "agent"], "full").fillna(0, ["n", "n_dialogues"])
    return table.withColumn("population", F.lit(population)) if population else table


def zero_checkable_rows(rows: DataFrame, n_col: str, population: str) -> DataFrame:
    """stratum: the paired comparison of the share of dialogues without a checkable claim; no p-values."""
    long = rows.select(*KEYS, F.lit(ZERO_CHECKABLE).alias("metric"), zero_checkable(F.col(n_col)).alias("value"))
    scores = with_strata(aggregate_to_scenarios(long))
    pairs = pair_scenarios(scores, by=("metric", "stratum"))
    means = pairs.groupBy(*GROUPS).agg(F.avg("baseline").alias("baseline_mean"), F.avg("fsm").alias("fsm_mean"))
    table = wins_ties_losses(pairs).join(means, GROUPS).join(unpaired(scores).select(*GROUPS, F.col("n_unpaired").alias("n_dropped_unpaired")), GROUPS)
    return table.withColumn("population", F.lit(population)).withColumn("direction", direction(F.col("mean_diff"))).withColumn("role", F.lit(DIAGNOSTIC))


def with_holm(table: DataFrame, chosen: Column, order: list[str], p: str = "wilcoxon_p", by: tuple[str, ...] = ("population",)) -> DataFrame:
    """The step-down adjusted p of the chosen rows, ties in the metrics' order; null elsewhere."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("metric"))
    marked = table.withColumn("__in", chosen & F.col(p).isNotNull())
    w = Window.partitionBy(*by, "__in").orderBy(p, place)
    raw = F.least(F.lit(1.0), F.col(p) * (F.count("*").over(Window.partitionBy(*by, "__in")) - F.row_number().over(w) + 1))
    stepped = F.max("__raw").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("__raw", raw).withColumn(f"{p}_holm", F.when(F.col("__in"), stepped)).drop("__raw", "__in")


def tests(rows: DataFrame, metrics: list[str], population: str, primary: list[str], confirmatory: list[str], n_resamples: int = N_RESAMPLES, seed: int = SEED, missing_of: str | None = None, n_checkable: str | None = None) -> DataFrame:
    """metric x stratum: the paired-test record; Holm over the overall rows of the primary family.

    Without resamples the seeded columns are left out.
    """
    scores = aggregate_to_scenarios(long_metrics(rows, metrics))
    pairs = with_strata(pair_scenarios(scores))
    table = wins_ties_losses(pairs).join(rank_biserial(pairs, GROUPS).drop("n", "n_pairs"), GROUPS).join(unpaired(with_strata(scores)).select(*GROUPS, F.col("n_unpaired").alias("n_dropped_unpaired")), GROUPS)
    if n_resamples:
        seeded = resampled(pairs, GROUPS, n_resamples=n_resamples, seed=seed).drop("n")
        table = table.join(seeded, GROUPS).join(wilcoxon_p(pairs, GROUPS).drop("n"), GROUPS)
    if missing_of:
        lost = missing_columns(rows, missing_of).where(F.col("agent") == AGENTS[0]).select(*GROUPS, F.col("complete_pairs"), "pairs_excluded_either_na")
        table = table.join(lost, GROUPS, "left")
    table = table.withColumn("population", F.lit(population)).withColumn("direction", direction(F.col("mean_diff")))
    if n_checkable:
        table = table.unionByName(zero_checkable_rows(rows, n_checkable, population), allowMissingColumns=True)
    table = table.withColumn("family", family(F.col("metric"), F.col("population"), F.col("stratum"), primary, confirmatory))
    return with_holm(table, F.col("family") == "primary", primary) if n_resamples else table


def analyze(populations: dict[str, DataFrame], metrics: list[str], primary: list[str], confirmatory: list[str], n_resamples: int = N_RESAMPLES, missing_of: str | None = None, n_checkable: str | None = None, drawn: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(descriptive, tests) over all populations of one experiment; ``drawn`` tells the cells of the descriptive table whose intervals are wanted."""
    union = lambda parts: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    described = union([descriptive(rows, metrics, name, missing_of, n_resamples, drawn=drawn) for name, rows in populations.items()])
    tested = union([tests(rows, metrics, name, primary, confirmatory, n_resamples, missing_of=missing_of, n_checkable=n_checkable) for name, rows in populations.items()])
    return described, tested


def reference_holm(table: DataFrame, primary: list[str], by: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Holm over the overall primary p-values alone; rows of a category have none."""
    return with_holm(table, (F.col("stratum") == "overall") & F.col("metric").isin(primary), primary, by=by)


def sensitivity(instruments: dict[str, DataFrame], listed: DataFrame, primary: list[str], n_resamples: int = N_RESAMPLES, seed: int = SEED, population: str = "drop_ambiguous_fact_ids") -> DataFrame:
    """The primary paired tests of each instrument without the listed dialogues; all are exploratory."""
    keys = ["scenario_id", "agent", "repetition"]
    parts = [tests(without_keys(rows, listed, keys), primary, population, primary, [], n_resamples, seed).drop("wilcoxon_p_holm").withColumn("instrument", F.lit(name)) for name, rows in instruments.items()]
    table = reduce(DataFrame.unionByName, parts)
    return reference_holm(table, primary) if n_resamples else table


# What reports take.


def cases_family(metric: Column, stratum: Column, primary: list[str], diagnostic: list[str]) -> Column:
    """diagnostic metrics; primary ones are confirmatory overall and exploratory elsewhere; others are an error."""
    known = F.when(stratum == "overall", "confirmatory").otherwise("exploratory")
    return F.when(metric.isin(diagnostic), "diagnostic").when(metric.isin(primary), known).otherwise(F.raise_error(F.concat(metric, F.lit(" is not a metric of the table"))))


def direction_cells(tested: DataFrame, population: str, primary: list[str], diagnostic: list[str]) -> DataFrame:
    """The inversion table of a population: family, tallies, direction, and whether a category opposes the overall direction."""
    rows = tested.where((F.col("population") == population) & F.col("metric").isin([*primary, *diagnostic]))
    overall = F.max(F.when(F.col("stratum") == "overall", F.col("direction"))).over(Window.partitionBy("metric"))
    cells = rows.withColumn("overall", overall).where(F.col("overall").isNotNull())
    inverted = (F.col("stratum") != "overall") & (F.col("direction") != F.col("overall"))
    return cells.select("metric", "stratum", cases_family(F.col("metric"), F.col("stratum"), primary, diagnostic).alias("family"), "n", "wins", "ties", "losses", "direction", inverted.alias("inverted"), "mean_diff", "rank_biserial")


def primary_rows(table: DataFrame, population: str, primary: list[str], stratum: str = "overall") -> DataFrame:
    """A population's rows of the primary metrics in one stratum, with ``place`` in the metrics' order."""
    place = F.array_position(F.array(*map(F.lit, primary)), F.col("metric"))
    return table.where((F.col("population") == population) & (F.col("stratum") == stratum) & F.col("metric").isin(primary)).withColumn("place", place)


def paired_intervals(tables: dict[str, tuple[DataFrame, str]], primary: list[str], low: str = "ci_low", high: str = "ci_high") -> DataFrame:
    """(metric, instrument, mean_diff, low, high, n) of the overall primary rows; a row that lacks one is an error."""
    parts = [primary_rows(table, population, primary).select("metric", F.lit(name).alias("instrument"), "mean_diff", low, high, "n") for name, (table, population) in tables.items()]
    whole = lambda c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("incomplete interval of "), F.col("metric")))).alias(c)
    return reduce(DataFrame.unionByName, parts).select("metric", "instrument", *[whole(c) for c in ("mean_diff", low, high, "n")])
