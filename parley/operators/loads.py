"""Load checks of knowledge, machines and logs: every fault is a row, and a gate refuses tables that have any.

Checks read any number of documents at once; a document's lines are one group,
as the document is one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators import flow


def _named(rows: DataFrame, rule: str, item: Column, file: bool = True) -> DataFrame:
    return rows.select(*(["file"] if file else []), F.lit(rule).alias("rule"), item.alias("item"))


def fact_file_faults(lines: DataFrame) -> DataFrame:
    """(file, rule, item) of ``readers.fact_lines``: repeated sections, facts before a section, gaps, repeats and excess in the numbering."""
    sections = lines.where("section IS NOT NULL")
    facts = lines.where("id IS NOT NULL")
    repeated = sections.groupBy("file", "section").count().where("count > 1")
    early = facts.where("intent IS NULL")
    sizes = facts.groupBy("file").agg(F.count("*").alias("n"))
    wanted = sizes.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.format_string("F%02d", i))).alias("id"))
    counts = facts.groupBy("file", "id").agg(F.count("*").alias("__k"))
    both = wanted.withColumn("__wanted", F.lit(True)).join(counts, ["file", "id"], "full")
    rule = F.when(F.col("__k").isNull(), "missing_number").when(F.col("__wanted").isNull(), "number_beyond").when(F.col("__k") > 1, "repeated_number")
    numbering = both.select("file", rule.alias("rule"), F.col("id").alias("item")).where("rule IS NOT NULL")
    return _named(repeated, "repeated_section", F.col("section")).unionByName(_named(early, "fact_before_section", F.col("id"))).unionByName(numbering)


def knowledge_faults(facts: DataFrame, needles: DataFrame, questions: DataFrame, fields: DataFrame) -> DataFrame:
    """(rule, item): needles without a fact, repeated question ids, patterns that miss their own example, intents that no section has.

    ``facts``: id, intent; ``needles``: fact_id; ``questions``: id; ``fields``: key, pattern, example, required_for.
    """
    lost = needles.join(facts.select(F.col("id").alias("fact_id")).distinct(), "fact_id", "left_anti")
    repeated = questions.groupBy("id").count().where("count > 1")
    missed = fields.where(F.col("pattern").isNotNull() & ~F.regexp_like("example", "pattern"))
    needed = fields.select("key", F.explode("required_for").alias("intent")).join(facts.select("intent").distinct(), "intent", "left_anti")
    found = [_named(lost, "needle_without_fact", F.col("fact_id"), False), _named(repeated, "repeated_question", F.col("id"), False), _named(missed, "pattern_misses_example", F.col("key"), False), _named(needed, "unknown_intent", F.concat_ws(":", "key", "intent"), False)]
    return found[0].union(found[1]).union(found[2]).union(found[3])


def machine_faults(edges: DataFrame, states: DataFrame, initial: str, accepting: list[str], guards: list[str]) -> DataFrame:
    """(rule, item): undeclared roles, endpoints and guards, ambiguous events and unreachable states, wildcards expanded first.

    ``edges``: event, source, dest, guard; ``states``: state.
    """
    spark = edges.sparkSession
    roles = spark.createDataFrame([("initial", initial), *[("accepting", s) for s in accepting]], "role string, state string")
    plain = flow.expand_wildcards(edges, states)
    found = [
        _named(roles.join(states, "state", "left_anti"), "undeclared_role", F.concat_ws(":", "role", "state"), False),
        _named(flow.undeclared_states(edges, states), "undeclared_state", F.col("state"), False),
        _named(flow.undeclared_guards(edges, guards).select("guard").distinct(), "unknown_guard", F.col("guard"), False),
        _named(flow.ambiguous_events(plain), "ambiguous_event", F.concat_ws(":", "source", "event"), False),
        _named(flow.orphans(plain, states, initial), "unreachable_state", F.col("state"), False),
    ]
    return found[0].union(found[1]).union(found[2]).union(found[3]).union(found[4])


def refuse(faults: DataFrame, shown: int = 20) -> None:
    """An error that shows the first faults, if there are any."""
    first = [" ".join(map(str, r)) for r in faults.limit(shown).collect()]
    if first:
        raise ValueError("faults at load: " + "; ".join(first))


def log_index(logs: DataFrame, expected: DataFrame) -> DataFrame:
    """(dialogue_id, n_files, first_file, expected): every dialogue that has logs or is expected, with how many files claim it.

    ``logs``: dialogue_id, source_file; ``expected``: dialogue_id.  The first file is the smallest name.
    """
    files = logs.groupBy("dialogue_id").agg(F.count_distinct("source_file").alias("n_files"), F.min("source_file").alias("first_file"))
    jobs = expected.select("dialogue_id").distinct().withColumn("expected", F.lit(True))
    return files.join(jobs, "dialogue_id", "full").select("dialogue_id", F.coalesce("n_files", F.lit(0)).alias("n_files"), "first_file", F.coalesce("expected", F.lit(False)).alias("expected"))


def log_faults(index: DataFrame) -> DataFrame:
    """(rule, item): expected dialogues without a log, extra ones, and those that several files claim."""
    rules = F.array_compact(F.array(F.when(F.col("n_files") == 0, "missing_log"), F.when(~F.col("expected"), "extra_log"), F.when(F.col("n_files") > 1, "duplicate_log")))
    return index.select(F.explode(rules).alias("rule"), F.col("dialogue_id").alias("item"))


def with_flow(scores: DataFrame, turns: DataFrame, key: list[str], order: list[str], label: str, gold: str, edges: DataFrame, initial: str, expected: DataFrame) -> DataFrame:
    """Score rows (key, n_turns, ...) beside flow metrics and label accuracy of their labelled turns.

    A dialogue whose labels are not as many as its turns is an error; labels of unscored dialogues go to nobody's row.
    """
    labelled = turns.groupBy(*key).agg(F.count("*").alias("__labels"))
    paths = flow.flow_scores(turns, key, order, label, edges, initial, expected)
    accuracy = flow.stage_label_accuracy(turns, key, label, gold)
    rows = scores.join(labelled, key, "left").join(paths, key, "left").join(accuracy, key, "left")
    given = F.coalesce("__labels", F.lit(0))
    whole = F.when(given == F.col("n_turns"), F.col("n_turns")).otherwise(F.raise_error(F.format_string("%d labels for %d turns", given, F.col("n_turns"))))
    return rows.withColumn("n_turns", whole).drop("__labels")
