"""Lookups that must not miss, coverage, order-keeping distinct, and reports over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.scoring import fact_scores


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def select_listed(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed; a listed key that no row has is an error."""
    require(listed.join(rows, key, "left_anti").isEmpty(), f"a listed {key} is unknown")
    return rows.join(listed.select(key).distinct(), key, "left_semi")


def lookup(rows: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Inner join that refuses rows without a match."""
    require(rows.join(dim, key, "left_anti").isEmpty(), f"a {key} has no match")
    return rows.join(dim, key)


def singleton(values: Column, others: Column) -> Column:
    """The one member that two arrays share; none or several is an error."""
    both = F.array_intersect(values, others)
    return F.when(F.size(both) == 1, both[0]).otherwise(F.raise_error(F.lit("not exactly one member is shared")))


def coverage(plan: DataFrame, column: str, ids: DataFrame, id_column: str) -> DataFrame:
    """(id, problem): ids that the plan misses, repeats or does not know."""
    used = plan.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("id")).agg(F.count("*").alias("n"))
    known = ids.select(F.col(id_column).alias("id"), F.lit(True).alias("known")).distinct()
    rows = known.join(used, "id", "full_outer")
    problem = F.when(F.col("known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return rows.select("id", problem.alias("problem")).where("problem IS NOT NULL")


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values in the order in which they came first."""
    return rows.groupBy(value).agg(F.min(order).alias(order)).orderBy(order)


def restored_order(scored: DataFrame, jobs: DataFrame, key: list[str], order: str) -> DataFrame:
    """Scored rows in the jobs' order; rows of no job come last, by key."""
    return scored.join(jobs.select(*key, order), key, "left").orderBy(F.col(order).asc_nulls_last(), *key)


def labelled_turns(logs: DataFrame, records: str, labels: str, key: list[str]) -> DataFrame:
    """(key, turn, label, state after) by place; lengths that differ are an error."""
    same = F.when(F.size(records) == F.size(labels), F.arrays_zip(F.transform(records, lambda r: r["state_after"]), labels)).otherwise(F.raise_error(F.lit("labels and turns differ in number")))
    zipped = F.transform(same, lambda x: F.struct(x["0"].alias("state_after"), x[labels].alias("label")))
    return logs.select(*key, F.posexplode(zipped).alias("turn", "x")).select(*key, (F.col("turn") + 1).alias("turn"), "x.label", "x.state_after")


def first_per_beat(records: DataFrame, key: list[str], beat: str, turn: str) -> DataFrame:
    w = Window.partitionBy(*key, beat).orderBy(turn)
    return records.where(F.col(beat).isNotNull()).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def turns_of_beats(records: DataFrame, spans: DataFrame, key: list[str], turn: str) -> DataFrame:
    """Records joined to the beats whose span of turns holds them."""
    return records.join(spans, key).where(F.col(turn).between(F.col("start_turn"), F.col("end_turn")))


def carried_state(turns: DataFrame, key: list[str], turn: str, column: str) -> DataFrame:
    """Each turn beside the value that its predecessor left."""
    return turns.withColumn(f"previous_{column}", F.lag(column).over(Window.partitionBy(*key).orderBy(turn)))


def human_scores(responses: DataFrame, claims: DataFrame, required: DataFrame, key: str) -> DataFrame:
    """Per dialogue: stated ids against the required ones, and support over the annotated claims (uncertain ones left out)."""
    stated = responses.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("fact_ids"))).alias("stated"))
    counted = claims.groupBy(key).agg(F.count_if(F.col("support") == "supported").alias("n_yes"), F.count_if(F.col("support") == "unsupported").alias("n_no"))
    rows = stated.join(counted, key, "left").fillna(0, ["n_yes", "n_no"]).join(required, key)
    return rows.select(key, fact_scores(F.col("required"), F.col("stated"), F.col("n_no"), F.col("n_yes")).alias("s")).select(key, "s.*")


def fixture_report(cases: DataFrame, expected: str, got: str) -> DataFrame:
    """Accuracy and the list of misses."""
    hit = F.col(expected).eqNullSafe(F.col(got))
    return cases.agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("accuracy"), F.array_sort(F.collect_list(F.when(~hit, F.col("id")))).alias("misses"))


def adherence_report(reports: DataFrame) -> DataFrame:
    """Dialogues, passes, and the shares of delivered canaries and injections among those that have one."""
    share = lambda c: F.avg(F.col(c).cast("double")).alias(f"{c}_share")
    return reports.agg(F.count("*").alias("n"), F.count_if(F.col("passed")).alias("passed"), share("canary_delivered"), share("injection_delivered"))


def expand_plan(cells: DataFrame, slots: str) -> DataFrame:
    """Scenarios from a plan: category by category, the first four slots of each cell, then the rest; dense ids."""
    rows = cells.select("category", "cell", F.posexplode(slots).alias("pos", "slot"))
    w = Window.partitionBy("category").orderBy((F.col("pos") >= 4).cast("int"), "cell", "pos")
    return rows.withColumn("n", F.row_number().over(w)).select(F.format_string("%s_%02d", "category", "n").alias("id"), "category", "slot")


def same_json(left: Column, right: Column, schema: str) -> Column:
    """Equality of JSON texts as values of a schema."""
    return F.from_json(left, schema).eqNullSafe(F.from_json(right, schema))


def answers_by_history(dialogues: DataFrame, calls: DataFrame, history: str, persona: str, goal: str, prompt: str) -> DataFrame:
    """Calls of a dialogue: equal message history (by hash), with persona and goal in the prompt."""
    a = dialogues.withColumn("__h", F.sha2(F.to_json(history), 256))
    b = calls.withColumn("__h", F.sha2(F.to_json(history), 256)).drop(history)
    return a.join(b, "__h").where(F.contains(prompt, persona) & F.contains(prompt, goal)).drop("__h")


def keys_holding_all(pairs: DataFrame, key: str, member: str, wanted: DataFrame) -> DataFrame:
    """Relational division: the keys that hold every member of ``wanted``; no wanted member at all gives every key.

    Matched members are counted by key; neither side is multiplied with the other.
    """
    members = wanted.select(F.col(member)).where(F.col(member).isNotNull()).distinct()
    held = pairs.select(key, member).join(members.withColumn("__wanted", F.lit(True)), member, "left")
    counts = held.groupBy(key).agg(F.count_distinct(F.when(F.col("__wanted"), F.col(member))).alias("__n"))
    return counts.crossJoin(members.agg(F.count("*").alias("__all"))).where("__n = __all").select(key)


def patterned_keys(fields: DataFrame, intents: DataFrame) -> DataFrame:
    """Keys of patterned fields that every intent requires; ``fields`` has key, pattern and an array ``required_for``."""
    pairs = fields.where(F.col("pattern").isNotNull()).select("key", F.explode_outer("required_for").alias("intent"))
    return keys_holding_all(pairs, "key", "intent", intents)
