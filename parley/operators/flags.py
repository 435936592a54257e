"""Flags on failed dialogues: what may have gone wrong between a script's contract and what was said.

A dialogue's messages are folded through its contract (``script.fold``); the flags
look at the beat that stayed open.  Each flag is a row, so a report is a filter or
a count; nothing is decided by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.texts import SHIPMENT, carries, denies, squeezed, words
from parley.operators.script import cumulative_faults, diagnostics, fold, local_faults

FLAG = "struct<mechanism string, requirement string, turns string>"
#: Fixed closing and thanking words.
CLOSING = ["bye", "goodbye", "thanks", "thank"]


def _flag(mechanism: str, requirement: Column, turns: Column | None = None) -> Column:
    return F.struct(F.lit(mechanism).alias("mechanism"), requirement.alias("requirement"), (turns if turns is not None else F.lit("")).alias("turns")).cast(FLAG)


def _some(flags: Column, condition: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), flags).otherwise(F.array().cast(f"array<{FLAG}>"))


def _turns(records: Column, test) -> Column:
    """Turns of the records whose message passes, comma-joined."""
    return F.array_join(F.transform(F.filter(records, lambda r: test(r["user_message"])), lambda r: r["turn"].cast("string")), ",")


def _with_turns(mechanism: str, wanted: Column, records: Column, label: str, test) -> Column:
    """A flag for each wanted string that some record has."""
    made = F.transform(wanted, lambda x: _flag(mechanism, F.concat(F.lit(label), x), _turns(records, lambda m: test(x, m))))
    return F.filter(made, lambda f: f["turns"] != "")


def candidate_fault(status: Column, message: Column, contract: Column, state: Column) -> Column:
    """Why a reply can't be delivered: status and message contradict each other, or it closes too early; null if it can.

    Only ``agent_ended`` is silent.  A closing reply has to complete the open beat, and the script unless the goal is reached.
    """
    silent, ended = F.trim(F.coalesce(message, F.lit(""))) == "", status == "agent_ended"
    b = F.get(contract, state["index"])
    literals = F.filter(b["literals"], lambda x: F.array_contains(state["literals"], x) | F.contains(message, x))
    said = F.filter(b["keywords"], lambda k: F.array_contains(state["words"], k) | carries(k, message))
    complete = F.size(F.concat(cumulative_faults(b, literals, said), local_faults(b, message))) == 0
    closing, last = status != "continue", state["index"] + 1 >= F.size(contract)
    return (
        F.when(silent != ended, "status and message disagree")
        .when(b.isNull() | ~closing, F.lit(None).cast("string"))
        .when(~complete, "closes with an open beat")
        .when((status != "goal_reached") & ~last, "closes before the last beat")
    )


def audit_flags(logs: DataFrame, contracts: DataFrame, key: str) -> DataFrame:
    """(key, mechanism, requirement, turns) of every hint.

    ``logs``: key, records (turn, user_message), recovered (message, status), goal_reached_seen, stop_reason, invalid_reason.
    ``contracts``: key, beats.
    """
    rows = logs.join(contracts, key).withColumn("__said", F.transform("records", lambda r: r["user_message"]))
    rows = rows.withColumn("__state", fold(F.col("__said"), F.col("beats")))
    rows = rows.withColumn("__d", diagnostics(F.col("__state"), F.col("beats"))).withColumn("__beat", F.get("beats", F.col("__state.index")))
    records, d, beat = F.col("records"), F.col("__d"), F.col("__beat")
    everything = F.concat("__said", F.transform("recovered", lambda r: r["message"]))
    has = lambda x, m: F.contains(m, x)
    none = F.array().cast("array<string>")
    lost_literals, lost_words = F.coalesce(d["literals_missing"], none), F.coalesce(d["keywords_missing"], none)
    earlier = F.filter(records, lambda r: r["turn"] < d["start_turn"])
    later = F.filter("beats", lambda b: b["number"] > d["beat"])
    future = "possible_future_beat_content"
    later_literals = F.flatten(F.transform(later, lambda b: b["literals"]))
    later_words = F.flatten(F.transform(F.filter(later, lambda b: b["verbatim"].isNull()), lambda b: b["keywords"]))
    ahead = F.concat(_with_turns(future, lost_literals, earlier, "string: ", has), _with_turns(future, lost_words, earlier, "word: ", carries), _with_turns(future, later_literals, records, "later string: ", has), _with_turns(future, later_words, records, "later word: ", carries))
    ahead = _some(ahead, d.isNotNull())
    last = F.try_element_at("__said", F.lit(-1))
    before_last = F.slice(records, 1, F.greatest(F.size(records) - 1, F.lit(0)))
    asked, denied = _turns(before_last, lambda m: F.contains(m, F.lit("?"))), _turns(before_last, denies)
    spoken = F.size(records) > 0
    question = _some(F.array(_flag("possible_nonsticky_question", F.lit("question"), asked)), spoken & beat["asks"] & ~F.contains(last, F.lit("?")) & (asked != ""))
    denial = _some(F.array(_flag("possible_nonsticky_denial", F.lit("denial"), denied)), spoken & beat["negates"] & ~denies(last) & (denied != ""))
    exact = lambda x: F.exists(everything, lambda m: F.contains(m, x))
    folded = lambda x: F.exists(everything, lambda m: F.contains(F.lower(m), F.lower(x)))
    spaced = lambda x: F.exists(everything, lambda m: F.contains(F.lower(squeezed(m)), F.lower(x)) | F.contains(squeezed(m), squeezed(x)))
    mismatch = F.transform(F.filter(lost_literals, lambda x: folded(x) & ~exact(x)), lambda x: _flag("possible_exact_string_case_mismatch", x, _turns(records, lambda m: F.contains(F.lower(m), F.lower(x)))))
    absent = F.concat(
        F.transform(F.filter(lost_literals, lambda x: ~folded(x) & ~spaced(x)), lambda x: _flag("possible_required_content_absent", F.concat(F.lit("string: "), x))),
        F.transform(F.filter(lost_words, lambda k: ~F.exists(everything, lambda m: carries(k, m))), lambda k: _flag("possible_required_content_absent", F.concat(F.lit("word: "), k))),
    )
    ship = F.array(*map(F.lit, [*SHIPMENT["present"], *SHIPMENT["past"]]))
    unseen = F.filter(everything, lambda m: F.array_contains(words(m), "before") & F.arrays_overlap(words(m), ship) & ~denies(m))
    gap = _some(F.transform(unseen, lambda m: _flag("possible_denial_detector_gap", m)), beat["negates"])
    ends = ["goal_reached", "gave_up"]
    hints = F.array_compact(
        F.array(
            F.when(F.exists("recovered", lambda r: r["status"].isin(ends)), "a recovered candidate closes"),
            F.when(F.col("goal_reached_seen"), "the goal was seen as reached"),
            F.when(F.col("stop_reason").isin(ends), "the recorded stop is a closing one"),
            F.when(F.arrays_overlap(words(F.coalesce(last, F.lit(""))), F.array(*map(F.lit, CLOSING))), "the last message says goodbye"),
            F.when(F.col("invalid_reason").rlike("|".join(ends)), "the invalid reason names a closing status"),
            F.when(F.size(ahead) > 0, "later content was said before"),
        )
    )
    closed = F.transform(hints, lambda h: _flag("possible_semantic_completion_before_ledger_completion", h))
    empty = F.transform(F.filter("recovered", lambda r: (F.trim(r["message"]) == "") | (r["status"] == "agent_ended")), lambda r: _flag("possible_empty_stop_candidate", r["status"]))
    return rows.select(key, F.inline(F.concat(ahead, question, denial, mismatch, gap, absent, closed, empty)))
