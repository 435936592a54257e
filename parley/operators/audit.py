"""Integrity census of a run: what each planned job became, and every rule that is broken."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.cells import failure_class
from parley.operators.ranking import numbered, order_statistics


#: Jobs of a partition, in the mean: a task of the census sorts so many rows of each table.
ROWS = 1 << 18


def _dealt(jobs: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    """The jobs and tables dealt alike by key, before rows of a key are put together: as many partitions as there are jobs for."""
    parts = -(-max(1, jobs.count()) // ROWS)
    return [df.repartition(parts, key) for df in (jobs, *tables)]


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def census(jobs: DataFrame, logs: DataFrame, frozen: DataFrame, sidecar: DataFrame, unscored: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Each job with its execution, its inclusion, and the rules it breaks.

    ``logs`` has status, n_records, failure_kind and failure_reason; ``unscored`` has a reason;
    the others are key tables.  Execution comes first and is never rewritten: a job without a
    log is missing, one without records is empty.  ``anomalies`` names broken rules, or is empty.
    """
    jobs, logs, frozen, sidecar, unscored, listed = _dealt(jobs, key, logs, frozen, sidecar, unscored, listed)
    flag = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    # The least of several logs of a job counts, by its file where there is one; that there are several is a broken rule.
    fields = ["status", "n_records", "failure_kind", "failure_reason"]
    first = F.min(F.struct(*(["source_file"] if "source_file" in logs.columns else []), *fields)).alias("log")
    own = logs.groupBy(key).agg(F.count("*").alias("n_logs"), first).select(key, "n_logs", *[F.col(f"log.{c}").alias(c) for c in fields])
    found = jobs.select(key).join(own, key, "left").join(unscored.select(key, F.col("reason").alias("unscored_reason")).dropDuplicates([key]), key, "left")
    for df, name in ((frozen, "frozen"), (sidecar, "sidecar"), (unscored, "unscored"), (listed, "listed")):
        found = found.join(flag(df, name), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    execution = F.when(F.col("n_logs").isNull(), "missing").when(F.coalesce("n_records", F.lit(0)) == 0, "empty").when(F.col("status") == "ok", "ok").otherwise("failed")
    found = found.withColumn("execution_status", execution)
    kind = F.when(F.col("execution_status") == "failed", failure_class(F.col("failure_kind"), F.col("failure_reason"), F.col("listed")))
    found = found.withColumn("failure_class", kind)
    ok, false_positive = F.col("execution_status") == "ok", F.coalesce(F.col("failure_class") == "instrument_contract_false_positive", F.lit(False))
    pair, excluded = F.col("sidecar") & F.col("frozen"), F.col("failure_class").isNotNull() & ~false_positive
    primary = F.when(ok & F.col("unscored"), "excluded_unscored").when(ok & pair, "included_semantic").when(false_positive & F.col("sidecar"), "included_semantic").when(excluded, "excluded_failure")
    frozen_status = F.when(ok & F.col("unscored"), "excluded_unscored").when(ok & pair, "included_frozen").when(F.col("failure_class").isNotNull(), "excluded_failure")
    rules = {
        "missing_dialogue": F.col("execution_status") == "missing",
        "empty_dialogue": F.col("execution_status") == "empty",
        "duplicate_log": F.col("n_logs") > 1,
        "unexplained_failure": (F.col("execution_status") == "failed") & F.col("failure_class").isNull(),
        "incomplete_pair": ok & ~F.col("unscored") & ~pair,
        "false_positive_without_sidecar_row": false_positive & ~F.col("sidecar"),
        "false_positive_in_frozen_rows": false_positive & F.col("sidecar") & F.col("frozen"),
        "excluded_failure_with_row": excluded & (F.col("sidecar") | F.col("frozen")),
    }
    broken = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))
    return found.select(key, "execution_status", "failure_class", primary.alias("primary_status"), frozen_status.alias("frozen_status"), F.when(ok & F.col("unscored"), F.col("unscored_reason")).alias("unscored_reason"), broken.alias("anomalies"))


def anomalies(jobs: DataFrame, frozen: DataFrame, sidecar: DataFrame, audited: DataFrame, key: str) -> DataFrame:
    """(rule, key) of every violation, instead of the first alone."""
    named = lambda df, rule: df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("id"))
    jobs, frozen, sidecar = _dealt(jobs, key, frozen, sidecar)
    scored = sidecar.select(key).distinct()
    parts = [
        named(duplicates(jobs, [key]), "duplicate_job"),
        named(duplicates(frozen, [key]), "duplicate_frozen_row"),
        named(duplicates(sidecar, [key]), "duplicate_sidecar_row"),
        named(frozen.select(key).distinct().join(jobs, key, "left_anti"), "orphan_frozen_row"),
        named(scored.join(jobs, key, "left_anti"), "orphan_sidecar_row"),
        named(audited.where("primary_status = 'included_semantic'").join(scored, key, "left_anti"), "included_without_row"),
        audited.select(F.explode("anomalies").alias("rule"), F.col(key).cast("string").alias("id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def latency_groups(rows: DataFrame, audited: DataFrame, population: str, key: str, agent: str, value: str) -> DataFrame:
    """Fences per agent over the finite values of a population: ``semantic`` or ``frozen`` jobs that are included."""
    wanted = F.col("primary_status") == "included_semantic" if population == "semantic" else F.col("frozen_status") == "included_frozen"
    kept = rows.join(audited.where(wanted).select(key), key, "left_semi").where(F.col(value).isNotNull())
    return tukey(kept, [agent], value, key).withColumn("population", F.lit(population))


def require_none(violations: DataFrame) -> None:
    """Refuse to go on while a rule is broken."""
    bad = [r.asDict() for r in violations.limit(20).collect()]
    if bad:
        raise ValueError(f"integrity rules are broken: {bad}")


def tukey(values: DataFrame, groups: list[str], value: str, key: str, least: int = 4) -> DataFrame:
    """Inclusive quartiles, fences of 1.5 times their distance, and what lies strictly outside; few values have none."""
    q = order_statistics(values, groups, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75}).withColumn("q", F.array("q1", "q2", "q3"))
    low, high = F.col("q")[0] - 1.5 * (F.col("q")[2] - F.col("q")[0]), F.col("q")[2] + 1.5 * (F.col("q")[2] - F.col("q")[0])
    enough = F.col("n") >= least
    fences = q.select(*groups, "n", F.when(enough, F.col("q")[0]).alias("q1"), F.when(enough, F.col("q")[1]).alias("median"), F.when(enough, F.col("q")[2]).alias("q3"), F.when(enough, low).alias("low"), F.when(enough, high).alias("high"), F.when(enough, "computed").otherwise("insufficient_n").alias("status"))
    return fences


def outliers(values: DataFrame, fences: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Rows strictly outside their group's fences; the fences are a row per group."""
    return values.join(fences.select(*groups, "low", "high"), groups).where((F.col(value) < F.col("low")) | (F.col(value) > F.col("high")))


def failure_census(logs: DataFrame, kind: str, reason: str) -> DataFrame:
    return logs.groupBy(F.coalesce(kind, F.lit("")).alias("failure_kind"), F.coalesce(reason, F.lit("")).alias("failure_reason")).agg(F.count("*").alias("n"))


# Constraint checks of a scenario table: each returns the rows that break one.


def broken_category(s: DataFrame) -> DataFrame:
    return s.where(F.regexp_extract("id", r"^([a-z_]+)_[0-9]+$", 1) != F.col("category"))


def broken_foreign_key(df: DataFrame, column: str, dim: DataFrame, dim_column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).join(dim.select(F.col(dim_column).alias(column)).distinct(), column, "left_anti")


def broken_array_key(df: DataFrame, key: str, column: str, dim: DataFrame, dim_column: str) -> DataFrame:
    return df.select(key, F.explode(column).alias("__v")).join(dim.select(F.col(dim_column).alias("__v")).distinct(), "__v", "left_anti").select(key, F.col("__v").alias("value"))


def broken_answer_key(s: DataFrame) -> DataFrame:
    return s.where(F.arrays_overlap("required_facts", "forbidden_facts"))


def broken_canary(s: DataFrame) -> DataFrame:
    c = F.col("canary")
    planted = F.exists("script", lambda x: F.contains(x, c))
    return s.where(c.isNotNull() & ((F.col("category") != "adversarial") | ~planted | F.contains("reference_answer", c)))


def broken_needle(s: DataFrame, needles: list[str]) -> DataFrame:
    return s.where(F.col("is_needle") & (F.size(F.array_intersect("required_facts", F.array(*map(F.lit, needles)))) != 1))


def broken_numbering(facts: DataFrame) -> DataFrame:
    """Ids that are not the dense F01, F02, ... of their order."""
    return numbered(facts, ["id"], "__n").where(F.col("id") != F.format_string("F%02d", "__n")).drop("__n")


def broken_own_pattern(fields: DataFrame) -> DataFrame:
    return fields.where(F.col("pattern").isNotNull() & ~F.regexp_like("example", "pattern"))


def broken_intent_facts(s: DataFrame, facts: DataFrame, general: str = "general") -> DataFrame:
    """(id, fact): required facts that belong neither to the scenario's intent nor to the general policies."""
    needed = s.select("id", "intent", F.explode(F.array_distinct("required_facts")).alias("fact"))
    known = facts.select(F.col("id").alias("fact"), F.col("intent").alias("fact_intent"))
    return needed.join(known, "fact", "left").where(F.coalesce((F.col("fact_intent") != general) & (F.col("fact_intent") != F.col("intent")), F.lit(True))).select("id", "fact")


def broken_packages(packages: DataFrame, sections: list[str]) -> DataFrame:
    """(name, rule, value): sections that a state's package lacks or adds, and fact ids that it cites."""
    heads = F.transform(F.regexp_extract_all("body", F.lit(r"(?m)^## +(.+?)[ \t]*$"), F.lit(1)), lambda h: F.trim(h))
    wanted = F.array(*map(F.lit, sections))
    cited = F.array_sort(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b(F[0-9]{2})\b"), F.lit(1))))
    part = lambda rule, values: F.transform(values, lambda v: F.struct(F.lit(rule).alias("rule"), v.alias("value")))
    rows = F.concat(part("missing_section", F.array_except(wanted, heads)), part("extra_section", F.array_except(heads, wanted)), part("cites_fact", cited))
    return packages.select("name", F.inline(rows))


def metadata_leaks(rows: DataFrame, key: str, text: str, forbidden: list[str]) -> DataFrame:
    """(key, word): words of the forbidden metadata that a published text holds, ignoring case."""
    found = F.filter(F.array(*map(F.lit, forbidden)), lambda w: F.contains(F.lower(text), F.lower(w)))
    return rows.select(key, F.explode(found).alias("word"))
