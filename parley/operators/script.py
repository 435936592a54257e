"""Script contracts and the fold that follows a dialogue's messages through them.

A script's beats each ask for content words and literals, and some for a denial,
a question or a whole line.  Messages arrive turn by turn; the words of the open
beat gather over turns, by stem, and the beat is complete when all are there.  The fold is a higher-order aggregate over one dialogue's
ordered messages: state never leaves the JVM, and dialogues are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.texts import STOP_WORDS, carries, contains_normalized, denies, keywords


BEAT = "struct<number int, text string, literals array<string>, keywords array<string>, verbatim string, negates boolean, asks boolean, local_keywords array<string>>"


def literals_in(text: Column, patterns: list[str], canary: Column | None = None) -> Column:
    """What a line spells out: the canary if it stands there, and every match of the fields' patterns, once, in order."""
    found = [F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(0)) for p in patterns]
    first = F.when(F.contains(text, canary), F.array(canary)).otherwise(F.array().cast("array<string>")) if canary is not None else F.array().cast("array<string>")
    return F.array_distinct(F.concat(first, *found))


def beat(number: Column, text: Column, literals: Column, stop_words: list[str] = STOP_WORDS, verbatim: Column | None = None, local_keywords: Column | None = None) -> Column:
    """The contract of one line: literals and content words that may come over several messages, and what a single message must do."""
    none = F.array().cast("array<string>")
    return F.struct(
        number.cast("int").alias("number"),
        text.alias("text"),
        literals.alias("literals"),
        keywords(text, literals, stop_words).alias("keywords"),
        (verbatim if verbatim is not None else F.lit(None).cast("string")).alias("verbatim"),
        denies(text).alias("negates"),
        F.contains(text, F.lit("?")).alias("asks"),
        (local_keywords if local_keywords is not None else none).alias("local_keywords"),
    )


def beats(scripts: DataFrame, key: str, script: str, patterns: list[str] = (), canary: str | None = None, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """(key, beats): the contracts of a script's lines, in order."""
    made = F.transform(script, lambda t, i: beat(i + 1, t, literals_in(t, list(patterns), F.col(canary) if canary else None), stop_words))
    return scripts.select(key, made.alias("beats"))


def _progress(b: Column, literals: Column, words_: Column, message: Column) -> tuple[Column, Column]:
    """What of a beat's literals and content words has come by now."""
    return (
        F.filter(b["literals"], lambda x: F.array_contains(literals, x) | F.contains(message, x)),
        F.filter(b["keywords"], lambda k: F.array_contains(words_, k) | carries(k, message)),
    )


def local_faults(b: Column, message: Column) -> Column:
    """What a single message lacks: the instruction, a denial, a question, a word of the closing set."""
    return F.array_compact(
        F.array(
            F.when(b["verbatim"].isNotNull() & ~contains_normalized(b["verbatim"], message), F.concat(F.lit("instruction: "), b["verbatim"])),
            F.when(b["negates"] & ~denies(message), F.lit("denial")),
            F.when(b["asks"] & ~F.contains(message, F.lit("?")), F.lit("question")),
            F.when((F.size(b["local_keywords"]) > 0) & ~F.exists(b["local_keywords"], lambda k: carries(k, message)), F.concat(F.lit("one of: "), F.array_join(b["local_keywords"], ", "))),
        )
    )


def cumulative_faults(b: Column, literals: Column, words_: Column) -> Column:
    """Literals, and content words where no line is asked for verbatim, that have not come yet."""
    lost = F.transform(F.filter(b["literals"], lambda x: ~F.array_contains(literals, x)), lambda x: F.concat(F.lit("string: "), x))
    words_lost = F.transform(F.filter(b["keywords"], lambda x: ~F.array_contains(words_, x)), lambda x: F.concat(F.lit("word: "), x))
    return F.when(b["verbatim"].isNotNull(), lost).otherwise(F.concat(lost, words_lost))


_STATE = "struct<index int, turn int, start int, literals array<string>, words array<string>, log array<struct<turn int, beat int, started int, completed int, missing array<string>>>>"


def fold(messages: Column, contract: Column) -> Column:
    """Follow ordered messages through a script's beats; struct of the final state, with a log entry for each message.

    A message counts for the open beat alone.  Literals and content words (by stem) gather
    over messages; a beat ends with the message that completes them and meets the beat's
    demands on a single message.  ``missing`` of an entry says what the open beat still lacked.
    """
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("index"), F.lit(0).alias("turn"), F.lit(1).alias("start"), none.alias("literals"), none.alias("words"), F.array().cast("array<struct<turn int, beat int, started int, completed int, missing array<string>>>").alias("log")).cast(_STATE)

    def step(s: Column, m: Column) -> Column:
        turn = s["turn"] + 1

        def with_beat(b: Column) -> Column:
            literals, words_ = _progress(b, s["literals"], s["words"], m)

            def judged(x: Column) -> Column:
                done = F.size(x["missing"]) == 0
                entry = F.struct(turn.alias("turn"), F.when(done, b["number"]).alias("beat"), F.when(done, s["start"]).alias("started"), F.when(done, turn).alias("completed"), x["missing"].alias("missing"))
                return F.struct((s["index"] + done.cast("int")).alias("index"), turn.alias("turn"), F.when(done, turn + 1).otherwise(s["start"]).alias("start"), F.when(done, none).otherwise(x["literals"]).alias("literals"), F.when(done, none).otherwise(x["words"]).alias("words"), F.array_append(s["log"], entry).alias("log")).cast(_STATE)

            gathered = F.transform(F.array(F.struct(literals.alias("literals"), words_.alias("words"))), lambda g: F.struct(g["literals"].alias("literals"), g["words"].alias("words"), F.concat(cumulative_faults(b, g["literals"], g["words"]), local_faults(b, m)).alias("missing")))
            return F.transform(gathered, judged)[0]

        idle = F.struct(turn.alias("turn"), F.lit(None).cast("int").alias("beat"), F.lit(None).cast("int").alias("started"), F.lit(None).cast("int").alias("completed"), none.alias("missing"))
        past = F.struct(s["index"].alias("index"), turn.alias("turn"), s["start"].alias("start"), s["literals"].alias("literals"), s["words"].alias("words"), F.array_append(s["log"], idle).alias("log")).cast(_STATE)
        return F.when(s["index"] >= F.size(contract), past).otherwise(F.transform(F.slice(contract, s["index"] + 1, 1), with_beat)[0])

    return F.aggregate(messages, start, step)


def diagnostics(state: Column, contract: Column) -> Column:
    """Of a folded state, the open beat: what has come, what is missing, what a message must do; null when all beats are done."""
    b = F.get(contract, state["index"])
    have = lambda names, held: F.filter(names, lambda x: F.array_contains(held, x))
    lack = lambda names, held: F.filter(names, lambda x: ~F.array_contains(held, x))
    pending = F.array_compact(F.array(F.when(b["verbatim"].isNotNull(), F.lit("instruction")), F.when(b["asks"], F.lit("question")), F.when(b["negates"], F.lit("denial")), F.when(F.size(b["local_keywords"]) > 0, F.lit("closing word"))))
    return F.when(
        b.isNotNull(),
        F.struct(
            b["number"].alias("beat"),
            have(b["literals"], state["literals"]).alias("literals_held"),
            have(b["keywords"], state["words"]).alias("keywords_held"),
            lack(b["literals"], state["literals"]).alias("literals_missing"),
            lack(b["keywords"], state["words"]).alias("keywords_missing"),
            pending.alias("pending"),
            state["start"].alias("start_turn"),
            F.greatest(F.lit(0), state["turn"] - state["start"] + 1).alias("turns_on_beat"),
        ),
    )


def missing(required: Column, message: Column) -> Column:
    """Words of a beat that a message does not carry, by stem."""
    return F.filter(required, lambda k: ~carries(k, message))


def adherence(records: DataFrame, key: list[str], beat: str, turn: str, planned: Column) -> DataFrame:
    """Per dialogue: beats in order of delivery, what is missing, and whether they came out of order."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(beat).alias("b")))), lambda x: x["b"])
    rows = records.where(F.col(beat).isNotNull()).groupBy(*key).agg(F.array_compact(seq).alias("delivered"), F.max(planned).alias("planned"))
    missing_beats = F.array_except(F.sequence(F.lit(1), F.col("planned").cast("int")), "delivered")
    return rows.withColumn("missing", missing_beats).withColumn("out_of_order", F.col("delivered") != F.array_sort(F.array_distinct("delivered")))


def literal_search(literal: Column, messages: Column) -> Column:
    """Struct: found exactly, ignoring case, and with white space squeezed."""
    from parley.functions.texts import squeezed

    return F.struct(
        F.exists(messages, lambda m: F.contains(m, literal)).alias("exact"),
        F.exists(messages, lambda m: F.contains(F.lower(m), F.lower(literal))).alias("ignoring_case"),
        F.exists(messages, lambda m: F.contains(squeezed(m), squeezed(literal))).alias("squeezed"),
    )


def beat_faults(b: Column, record: Column, records: Column) -> Column:
    """What a completed beat lacks by its recorded span of turns; a beat without a record has none."""
    span = F.filter(records, lambda r: (r["turn"] >= record["beat_started_at_turn"]) & (r["turn"] <= record["beat_completed_at_turn"]))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("literals"), none.alias("words"))

    def gather(s: Column, r: Column) -> Column:
        literals, words_ = _progress(b, s["literals"], s["words"], r["user_message"])
        return F.struct(literals.alias("literals"), words_.alias("words"))

    held = F.aggregate(span, start, gather)
    faults = F.transform(F.array(held), lambda h: F.concat(cumulative_faults(b, h["literals"], h["words"]), local_faults(b, record["user_message"])))[0]
    lost = record["beat_started_at_turn"].isNull() | record["beat_completed_at_turn"].isNull()
    return F.when(record.isNull(), none).when(lost, F.array(F.lit("span is missing"))).otherwise(faults)


def check_dialogues(logs: DataFrame, contracts: DataFrame, key: str, canary: str) -> DataFrame:
    """Per dialogue: beats delivered in order, missing, out of order, their faults, and whether canary and injection arrived.

    ``logs`` has (key, records of turn, user_message, user_beat, beat_started_at_turn, beat_completed_at_turn);
    ``contracts`` has (key, beats, canary).  The first record that names a beat completed it.
    """
    rows = logs.join(contracts, key)
    delivered = F.filter(F.transform("records", lambda r: r["user_beat"]), lambda b: b.isNotNull())
    first = lambda b: F.get(F.filter("records", lambda r: r["user_beat"] == b["number"]), F.lit(0))
    faults = F.transform("beats", lambda b: F.struct(b["number"].alias("number"), F.contains(F.array_join(b["literals"], "\n"), F.col(canary)).alias("plants"), first(b).isNotNull().alias("there"), beat_faults(b, first(b), F.col("records")).alias("faults")))
    rows = rows.select(key, canary, "records", "beats", delivered.alias("delivered"), faults.alias("checked"))
    numbers = F.transform("beats", lambda b: b["number"])
    planted = F.filter("checked", lambda c: F.coalesce(c["plants"], F.lit(False)))
    return rows.select(
        key,
        F.size("beats").alias("n_beats"),
        "delivered",
        F.array_except(numbers, "delivered").alias("missing"),
        (F.col("delivered") != F.array_sort(F.array_distinct("delivered"))).alias("out_of_order"),
        F.flatten(F.transform("checked", lambda c: F.transform(c["faults"], lambda f: F.concat(F.lit("beat "), c["number"].cast("string"), F.lit(" needs "), f)))).alias("unsatisfied"),
        F.when(F.col(canary).isNotNull(), F.exists("records", lambda r: F.contains(r["user_message"], F.col(canary)))).alias("canary_delivered"),
        F.when(F.col(canary).isNotNull(), F.forall(planted, lambda c: c["there"] & (F.size(c["faults"]) == 0))).alias("injection_delivered"),
    )
