"""Rules of annotation sheets, declared as data and evaluated in one scan of each sheet.

A rule is a name, a condition that must hold, and the value to report.  What a rule
needs from other sheets (known ids, how often an id occurs) is joined beside the
rows once, by aggregated keys; then all rules of a sheet are one projection, and every
violation comes out, not the first.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.audit import metadata_leaks


@dataclass(frozen=True)
class Rule:
    name: str
    #: SQL over the sheet's columns; null counts as broken.
    holds: str
    #: SQL of the value that is reported; of an array, each member is a violation.
    value: str


TASKS, SUPPORTS = ("yes", "no", "uncertain"), ("supported", "unsupported", "uncertain")
_one_of = lambda column, values: f"trim({column}) IN ({', '.join(repr(v) for v in values)})"

DIALOGUE_RULES = (
    Rule("id_not_dense", "number BETWEEN 1 AND n_rows", "blind_dialogue_id"),
    Rule("id_repeats", "n_same = 1", "blind_dialogue_id"),
    Rule("task_invalid", _one_of("task_completed", TASKS), "task_completed"),
)
RESPONSE_RULES = (
    Rule("id_repeats", "n_same = 1", "blind_response_id"),
    Rule("unknown_dialogue", "parent_known", "blind_dialogue_id"),
    Rule("not_a_child", "startswith(blind_response_id, concat(blind_dialogue_id, '-'))", "blind_response_id"),
    Rule("unknown_fact", "size(unknown_facts) = 0", "unknown_facts"),
)
CLAIM_RULES = (
    Rule("id_repeats", "n_same = 1", "claim_id"),
    Rule("text_missing", "trim(claim_text) <> ''", "claim_id"),
    Rule("support_invalid", _one_of("support", SUPPORTS), "support"),
    Rule("unknown_response", "parent_known", "blind_response_id"),
    Rule("not_a_child", "startswith(claim_id, concat(blind_response_id, '-'))", "claim_id"),
)
#: A sheet that goes out to annotators holds no judgement yet.
EMPTY_DIALOGUE_RULES = (DIALOGUE_RULES[0], DIALOGUE_RULES[1], Rule("judgement_filled", "coalesce(task_completed, '') = '' AND coalesce(notes, '') = ''", "coalesce(task_completed, notes)"))
EMPTY_RESPONSE_RULES = (*RESPONSE_RULES[:3], Rule("judgement_filled", "coalesce(fact_ids_stated, '') = '' AND coalesce(notes, '') = ''", "coalesce(fact_ids_stated, notes)"))
MAPPING_RULES = (
    Rule("unknown_dialogue", "parent_known", "blind_dialogue_id"),
    Rule("id_repeats", "n_same = 1", "blind_dialogue_id"),
    Rule("dialogue_repeats", "n_dialogue = 1", "dialogue_id"),
    Rule("condition_missing", "coalesce(condition, '') <> ''", "dialogue_id"),
)


def faults(sheet: str, rows: DataFrame, key: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(sheet, id, rule, value) of every broken rule: one projection of the rows."""
    kinds = dict(rows.limit(0).select(*[F.expr(r.value).alias(f"{i}") for i, r in enumerate(rules)]).dtypes)

    def of(i: int, rule: Rule) -> Column:
        value = F.expr(rule.value)
        values = value.cast("array<string>") if kinds[f"{i}"].startswith("array") else F.array(value.cast("string"))
        found = F.transform(values, lambda v: F.struct(F.lit(rule.name).alias("rule"), v.alias("value")))
        return F.when(F.coalesce(F.expr(rule.holds), F.lit(False)), F.array().cast("array<struct<rule:string,value:string>>")).otherwise(found)

    return rows.select(F.lit(sheet).alias("sheet"), F.col(key).cast("string").alias("id"), F.inline(F.flatten(F.array(*[of(i, r) for i, r in enumerate(rules)]))))


def _counted(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Rows beside the number of rows that share their value of ``column``; nulls share theirs."""
    n = rows.groupBy(F.col(column).alias("__of")).agg(F.count("*").alias(name))
    return rows.join(n, F.col(column).eqNullSafe(F.col("__of")), "left").drop("__of")


def _known(rows: DataFrame, column: str, ids: DataFrame, id_column: str) -> DataFrame:
    marks = ids.select(F.col(id_column).alias("__of"), F.lit(True).alias("parent_known")).distinct()
    return rows.join(marks, F.col(column) == F.col("__of"), "left").drop("__of")


def _numbered(dialogues: DataFrame) -> DataFrame:
    number = F.regexp_extract("blind_dialogue_id", "^D([0-9]{3,})$", 1).try_cast("long")
    return _counted(dialogues, "blind_dialogue_id", "n_same").withColumn("number", number).crossJoin(dialogues.agg(F.count("*").alias("n_rows")))


def fact_ids(cell: Column) -> Column:
    """Ids of a cell that commas, semicolons or blanks separate."""
    return F.filter(F.split(F.coalesce(cell, F.lit("")), r"[,;\s]+"), lambda x: x != "")


def frozen_sheet_faults(dialogues: DataFrame, responses: DataFrame, claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Faults of filled sheets: dense ids, valid judgements, known parents and facts, children named after their parents."""
    stated = responses.select("blind_response_id", F.explode(F.array_distinct(fact_ids(F.col("fact_ids_stated")))).alias("fact"))
    strange = stated.join(facts.select(F.col("id").alias("fact")), "fact", "left_anti").distinct().groupBy(F.col("blind_response_id").alias("__of")).agg(F.array_sort(F.collect_list("fact")).alias("unknown_facts"))
    answered = _known(_counted(responses, "blind_response_id", "n_same"), "blind_dialogue_id", dialogues, "blind_dialogue_id")
    answered = answered.join(strange, F.col("blind_response_id") == F.col("__of"), "left").withColumn("unknown_facts", F.coalesce("unknown_facts", F.array().cast("array<string>")))
    claimed = _known(_counted(claims, "claim_id", "n_same"), "blind_response_id", responses, "blind_response_id")
    parts = [
        faults("dialogues", _numbered(dialogues), "blind_dialogue_id", DIALOGUE_RULES),
        faults("responses", answered, "blind_response_id", RESPONSE_RULES),
        faults("claims", claimed, "claim_id", CLAIM_RULES),
    ]
    return reduce(DataFrame.unionByName, parts)


def packet_faults(dialogues: DataFrame, responses: DataFrame, mapping: DataFrame, forbidden: list[str], texts: tuple[str, ...] = ("text",)) -> DataFrame:
    """Faults of a packet before annotation: empty judgements, a bijective private mapping, and no word of the hidden metadata."""
    answered = _known(_counted(responses, "blind_response_id", "n_same"), "blind_dialogue_id", dialogues, "blind_dialogue_id")
    mapped = _counted(_known(_counted(mapping, "blind_dialogue_id", "n_same"), "blind_dialogue_id", dialogues, "blind_dialogue_id"), "dialogue_id", "n_dialogue")
    without = dialogues.select("blind_dialogue_id").join(mapping.select("blind_dialogue_id"), "blind_dialogue_id", "left_anti")
    shown = [metadata_leaks(responses, "blind_response_id", t, forbidden) for t in texts]
    parts = [
        faults("dialogues", _numbered(dialogues), "blind_dialogue_id", EMPTY_DIALOGUE_RULES),
        faults("responses", answered, "blind_response_id", EMPTY_RESPONSE_RULES),
        faults("mapping", mapped, "blind_dialogue_id", MAPPING_RULES),
        without.select(F.lit("mapping").alias("sheet"), F.col("blind_dialogue_id").alias("id"), F.lit("not_mapped").alias("rule"), F.col("blind_dialogue_id").alias("value")),
        *[s.select(F.lit("responses").alias("sheet"), F.col("blind_response_id").alias("id"), F.lit("metadata_leak").alias("rule"), F.col("word").alias("value")) for s in shown],
    ]
    return reduce(DataFrame.unionByName, parts)
