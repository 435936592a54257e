"""Text expressions: words, stems, containment and rendering, all built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed word lists.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "i", "in", "is", "it", "my", "of", "on", "or", "that", "the", "this", "to", "was", "with", "you", "your"]
DENIALS = ["no", "not", "never", "none", "nothing", "without", "cannot"]


#: Fixed words about shipments: now, past, auxiliaries, times ahead, and what says that it is over.
SHIPMENT = {"present": ["ship", "ships", "shipping", "dispatch"], "past": ["shipped", "dispatched"], "aux": ["am", "is", "are", "be", "being"], "future": ["tomorrow"], "over": ["after", "when", "once", "already"]}
#: Fixed goodbye phrases.
FAREWELLS = [r"good\s*bye", "bye-bye", "bye", "that['\u2019]s all"]


def words(c: Column) -> Column:
    """Lower-case words, contractions kept."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+(?:'[a-z]+)?"), F.lit(0))


def normalized(c: Column) -> Column:
    """Lower-case words of letters and digits, parted by single spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)), " ")


def contains_normalized(required: Column, message: Column) -> Column:
    return F.contains(normalized(message), normalized(required))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def stem(w: Column) -> Column:
    """A light suffix stemmer: ing, ed, es, s off a rest of four letters or more; a doubled end is undone."""
    out = w
    for suffix in ("s", "es", "ed", "ing"):
        rest = F.substr(w, F.lit(1), F.length(w) - len(suffix))
        plain = F.when((F.right(rest, F.lit(1)) == F.substr(rest, F.length(rest) - 1, F.lit(1))) & F.lit(suffix in ("ed", "ing")), F.substr(rest, F.lit(1), F.length(rest) - 1)).otherwise(rest)
        out = F.when(F.endswith(w, F.lit(suffix)) & (F.length(rest) >= 4), plain).otherwise(out)
    return out


def same_word(keyword: Column, word: Column) -> Column:
    """Equal, of equal stem, or one stem begins the other with four letters or more."""
    a, b = stem(keyword), stem(word)
    n = F.least(F.length(a), F.length(b))
    return (keyword == word) | (a == b) | ((n >= 4) & (F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n)))


def carries(keyword: Column, message: Column) -> Column:
    return F.exists(words(message), lambda w: same_word(keyword, w))


def denies(c: Column, skip: list[str] = STOP_WORDS) -> Column:
    """Whether a text denies something, or says that a shipment has not happened yet; ``skip`` are words without content."""
    w = words(c)
    return F.arrays_overlap(w, F.array(*map(F.lit, DENIALS))) | F.contains(F.lower(c), F.lit("n't")) | before_shipment(w, skip) | upcoming_shipment(w)


def before_shipment(w: Column, skip: list[str] = STOP_WORDS) -> Column:
    """``before`` and then, over words without content, a present shipment, or a past one with an auxiliary on the way (``before it is shipped``)."""
    tail = F.array_join(F.slice(w, F.array_position(w, "before").cast("int") + 1, F.greatest(F.size(w), F.lit(1))), " ")
    aux, over = "|".join(SHIPMENT["aux"]), "|".join(sorted({*skip, "order", *SHIPMENT["aux"]}))
    now = rf"^(?:(?:{over}) )*(?:{'|'.join(SHIPMENT['present'])})(?: |$)"
    passive = rf"^(?:(?:{over}) )*(?:{aux}) (?:(?:{over}) )*(?:{'|'.join(SHIPMENT['past'])})(?: |$)"
    return F.array_contains(w, "before") & (tail.rlike(now) | tail.rlike(passive))


def upcoming_shipment(w: Column) -> Column:
    """A present shipment with ``will`` or a future time, and nothing that says it is over."""
    has = lambda names: F.arrays_overlap(w, F.array(*map(F.lit, names)))
    return has(SHIPMENT["present"]) & has(["will", *SHIPMENT["future"]]) & ~has(SHIPMENT["over"])


def keywords(text: Column, literals: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Distinct content words in order, without the literals, stop words, denials and single letters."""
    bare = F.aggregate(literals, text, lambda acc, x: F.replace(acc, x, F.lit(" ")))
    skip = F.array(*map(F.lit, stop_words + DENIALS))
    return F.array_distinct(F.filter(words(bare), lambda w: (F.length(w) > 1) & ~F.array_contains(skip, w)))


def slots(message: Column, fields: dict[str, str]) -> Column:
    """First match of each field's pattern, ignoring case; a map without the fields that don't match."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.regexp_extract(message, f"(?i){p}", 0).alias("value")) for k, p in fields.items()])
    return F.map_filter(F.map_from_entries(entries), lambda _, v: v != "")


def fact_id_leak(text: Column) -> Column:
    return text.rlike(r"\bF[0-9]{2}\b")


def bare_farewell(message: Column, farewells: list[str], courtesy: list[str]) -> Column:
    """Whether a message is a goodbye phrase and otherwise courtesy alone; ``farewells`` are regular expressions."""
    bye = "(?i)" + "|".join(rf"\b(?:{f})\b" for f in farewells)
    rest = F.regexp_extract_all(F.regexp_replace(F.lower(message), bye, " "), F.lit("([a-z]+)"), F.lit(1))
    return message.rlike(bye) & F.forall(rest, lambda x: F.array_contains(F.array(*map(F.lit, courtesy)), x))


def fact_ids(raw: Column) -> Column:
    """Distinct ids of a ``;`` list, sorted; blanks are left out."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")))


def redact(text: Column, canary: Column) -> Column:
    return F.when(canary.isNull() | (canary == ""), text).otherwise(F.replace(text, canary, F.lit("[redacted]")))


def markdown_section(text: Column, heading: str) -> Column:
    return F.regexp_replace(F.regexp_extract(text, rf"(?ms)^## {heading}\s*\n(.*?)(?=^## |\z)", 1), r"^\s+|\s+$", "")


def numbered(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def as_messages(turns: Column, me: Column) -> Column:
    """Roles as the speaker ``me`` sees them."""
    return F.transform(turns, lambda t: F.struct(F.when(t["speaker"] == me, "assistant").otherwise("user").alias("role"), t["text"].alias("content")))


def valid_free_text(value: Column, patterns: list[str]) -> Column:
    """A free-text slot holds something, and none of the structured ids."""
    out = F.trim(value) != ""
    for p in patterns:
        out = out & ~value.rlike(f"(?i){p}")
    return out


def merged_slots(patterned: Column, payload: Column, free_text: list[str], patterns: list[str]) -> Column:
    """Slots that patterns found, and over them the payload's free-text slots that are valid."""
    offered = F.map_filter(payload, lambda k, v: k.isin(free_text) & F.coalesce(valid_free_text(v, patterns), F.lit(False)))
    trimmed = F.transform_values(offered, lambda k, v: F.trim(v))
    return F.map_concat(F.map_filter(patterned, lambda k, v: ~F.map_contains_key(trimmed, k)), trimmed)


def required_held(required: Column, held: Column) -> Column:
    """Whether every field that the intent requires is held; without an intent (null) none is enough."""
    return F.when(required.isNull(), F.lit(False)).otherwise(F.size(F.array_except(required, F.map_keys(held))) == 0)


def transcript(turns: Column, speakers: dict[str, str]) -> Column:
    """One line for each turn: the speaker's name, and what was said."""
    names = F.create_map(*[F.lit(x) for kv in speakers.items() for x in kv])
    return F.array_join(F.transform(turns, lambda t: F.concat(F.coalesce(names[t["speaker"]], t["speaker"]), F.lit(": "), t["text"])), "\n")


def agent_turns(turns: Column, agent: str) -> Column:
    """The agent's turns, numbered."""
    said = F.filter(turns, lambda t: t["speaker"] == agent)
    return F.array_join(F.transform(said, lambda t, i: F.concat(F.lit("Turn "), (i + 1).cast("string"), F.lit(": "), t["text"])), "\n")


def transcript_after(transcript_: Column, heading: str) -> Column:
    """What follows a heading's line; null where it does not stand there."""
    at = F.locate(heading, transcript_)
    return F.when(at > 0, F.trim(F.substr(transcript_, at + F.lit(len(heading)), F.length(transcript_))))


def rendered(template: Column, values: Column) -> Column:
    """A template with each ``{name}`` of the map filled in; a name without a value is an error."""
    filled = F.aggregate(F.map_entries(values), template, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    left = F.regexp_extract(filled, r"\{([a-z_]+)\}", 1)
    return F.when(left == "", filled).otherwise(F.raise_error(F.concat(F.lit("no value for "), left)))


def rendered_facts(facts: Column) -> Column:
    """Facts as a list of ``- id: text`` lines, ordered by id."""
    return F.array_join(F.transform(F.array_sort(facts), lambda f: F.concat(F.lit("- "), f["id"], F.lit(": "), f["text"])), "\n")


def joined_fact_ids(ids: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(ids)), ";")


def dialogue_id_in(messages: Column) -> Column:
    """The first dialogue id that a call's messages hold."""
    found = F.filter(F.transform(messages, lambda m: F.regexp_extract(m["content"], r"\b([a-z_]+_[0-9]+__(?:baseline|fsm)__rep[0-9]{2,})\b", 1)), lambda x: x != "")
    return F.get(found, F.lit(0))


def over_budget(text: Column, words_: int) -> Column:
    """By how many words a text is longer than its budget; 0 if it is not."""
    return F.greatest(F.lit(0), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) - words_)


def looks_before_shipment(c: Column) -> Column:
    """Whether a text says ``before`` and any shipment word, present or past, wherever they stand."""
    w = words(c)
    return F.array_contains(w, "before") & F.arrays_overlap(w, F.array(*map(F.lit, SHIPMENT["present"] + SHIPMENT["past"])))
