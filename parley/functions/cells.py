"""Cells, keys and seeds: column expressions for schema-on-read tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CATEGORIES = ("happy_path", "edge", "adversarial")
OVERALL = "overall"
AGENTS = ("baseline", "fsm")


def parse_cell(c: Column) -> Column:
    """Text cell to double: blank is null, True/true is 1, False/false is 0, else a number or an error."""
    t = F.trim(c)
    return F.when(c.isNull() | (t == ""), None).when(t.isin("True", "true"), 1.0).when(t.isin("False", "false"), 0.0).otherwise(t.cast("double"))


def finite(c: Column) -> Column:
    """Text to a finite double; blank, malformed, NaN and infinite are null."""
    d = F.trim(c).try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def csv_cell(c: Column, boolean: bool = False) -> Column:
    """A cell as text: null is empty, booleans are True and False."""
    text = F.initcap(c.cast("string")) if boolean else c.cast("string")
    return F.coalesce(text, F.lit(""))


def category_of(scenario_id: Column) -> Column:
    """The stratum that an id names; an id that names none is an error."""
    found = F.regexp_extract(scenario_id, r"^(happy_path|edge|adversarial)_[0-9]+$", 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("id names no category: "), scenario_id)))


def dialogue_id(scenario_id: Column, agent: Column, repetition: Column) -> Column:
    return F.format_string("%s__%s__rep%02d", scenario_id, agent, repetition)


def dialogue_filename(scenario_id: Column, agent: Column, repetition: Column) -> Column:
    return F.concat(dialogue_id(scenario_id, agent, repetition), F.lit(".jsonl"))


def parse_dialogue_id(value: Column) -> Column:
    """Struct (scenario_id, agent, repetition), or null where the text does not round-trip."""
    pattern = r"^(.*)__(baseline|fsm)__rep([0-9]+)$"
    s, a, r = (F.regexp_extract(value, pattern, i) for i in (1, 2, 3))
    rep = r.try_cast("int")
    return F.when(rep.isNotNull() & (dialogue_id(s, a, rep) == value), F.struct(s.alias("scenario_id"), a.alias("agent"), rep.alias("repetition")))


def dialogue_seed(base: Column | int, scenario_id: Column, repetition: Column) -> Column:
    """31 bits of sha256("base:scenario:repetition"): both agents of a repetition share it."""
    base = F.lit(base) if isinstance(base, int) else base
    text = F.concat_ws(":", base.cast("string"), scenario_id, repetition.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(2147483647))


def canonical_diff(fsm: Column, baseline: Column) -> Column:
    """Difference rounded to 12 decimals once; exactly 0 is a tie from here on."""
    return F.round(fsm - baseline, 12)


def direction(mean_diff: Column) -> Column:
    return F.when(mean_diff > 0, "fsm").when(mean_diff < 0, "baseline").when(mean_diff.isNotNull(), "tie")


def family(metric: Column, population: Column, stratum: Column, primary: list[str], confirmatory: list[str]) -> Column:
    """primary: overall stratum of a confirmatory population; the same elsewhere is exploratory."""
    return F.when((stratum != OVERALL) | ~population.isin(confirmatory), "exploratory").when(metric.isin(primary), "primary").otherwise("secondary")


def zero_checkable(n: Column) -> Column:
    return F.when(n.isNotNull(), (n == 0).cast("double"))


def failure_class(kind: Column, reason: Column, listed: Column) -> Column:
    """Class of a failed dialogue; an instrument failure is split by the allowlist; null where no rule explains it."""
    instrument = (kind == "instrument") & (reason == "invalid_candidate_retry_exhausted")
    return (
        F.when((kind == "simulation") & (reason == "max_turns_with_incomplete_beat"), "max_turns_with_incomplete_beat")
        .when(instrument & F.coalesce(listed, F.lit(False)), "instrument_contract_false_positive")
        .when(instrument, "instrument_true_failure")
    )


def call_event(error: Column, attempts: Column) -> Column:
    """timeout before prompt_too_long before retry; null where nothing happened."""
    low = F.lower(F.coalesce(error, F.lit("")))
    too_long = (low.contains("over the") & low.contains("budget")) | low.contains("prompt uses")
    return F.when(low.contains("timed out"), "timeout").when(too_long, "prompt_too_long").when(attempts > 1, "retry")


def bucket(task: Column, fact: Column, claim: Column) -> Column:
    """tie: all three differences are there and 0; else helped or restricted by the first."""
    return F.when((task == 0) & (fact == 0) & (claim == 0), "tie").when(task > 0, "helped").when(task < 0, "restricted").otherwise("")


def support_label(n_yes: Column, n_no: Column) -> Column:
    return F.when((n_yes + n_no) == 0, "none_checkable").when(n_no > 0, "some_unsupported").otherwise("all_supported")


def support_label_from_rate(n: Column, rate: Column) -> Column:
    return F.when(n == 0, "none_checkable").when(F.abs(rate - 1.0) < 1e-9, "all_supported").otherwise("some_unsupported")


def yes_no(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("true", "1", "yes"), "yes").when(low.isin("false", "0", "no"), "no").otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), c)))


def accuracy_label(score: Column) -> Column:
    return F.when(score == 1, "correct").when(score == 0.5, "partial").when(score == 0, "incorrect").otherwise(F.raise_error(F.lit("not an accuracy score")))


def decimal_comma(x: Column, decimals: int = 3) -> Column:
    return F.replace(F.format_string(f"%.{decimals}f", x), F.lit("."), F.lit(","))


def p_text(p: Column) -> Column:
    return F.when(p < 0.001, "<0,001").otherwise(decimal_comma(p, 3))


def percent_text(x: Column) -> Column:
    return F.concat(decimal_comma(x * 100, 4), F.lit("%"))
