"""Conversation structure repair by error-correcting Earley parsing.

A role grammar says which sequences of roles are dialogues.  Beside scanning a row
as it is, the parser may delete it, take it for another role, or insert an empty
row; each has a weight.  Chart items are dotted rules and retain the minimum
(cost, audit), where the audit spells the edits in order; the completed chart is
walked back to the repair.  The grammar is right-linear (a nonterminal stands at
the end of a rule only), so what follows an item does not depend on where its rule
began: items with the same dot merge, and a conversation of n rows takes n steps
over a fixed number of items, named by the nonterminal after the dot.

Audits of items that end with the same row are never prefixes of one another, so
their order is kept as a rank, and a row costs a few numbers, not a string.

On Spark: pass one sends no texts, but their digests and faults, once by
conversation, and streams each sorted conversation through the chart.  Pass two
sends the texts once, behind the audit of their conversation, and streams out the
repaired rows.  A task holds a few bytes for each row of one conversation, never
its texts; the audit of a conversation is a single value, as asked, and bounds
what one task must see.  Executors that are lost repeat a partition.

Defined results: null roles and texts are one space; rows are taken by turn (nulls
first), then role, then digest of the text, so that ties have one order and repeated
rows are neighbours; a null conversation id is a conversation of its own; a role
whose initial the grammar does not know (an empty role has none) can be taken for another or deleted; a
conversation without rows is not returned by the operators, and the query adds it
with an empty audit; other columns may have any name and are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.store import written

#: Dialogue = s?(ua)+ or nothing; small letters are rows, capitals nonterminals.
GRAMMAR: dict[str, tuple[tuple[str, ...], ...]] = {
    "D": ((), ("s", "B"), ("u", "R")),
    "B": (("u", "R"),),
    "R": (("a", "T"),),
    "T": ((), ("u", "R")),
}
START = "D"
#: Roles that rerole and insert productions may write.
WRITABLE = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1

#: 0x20 and 0x09-0x0D.
SPACES = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


@lru_cache
def predicted(nonterminal: str) -> tuple[tuple[tuple[str, str], ...], bool]:
    """What the predictor finds: (terminal, item after it) of all rules, and whether a rule is complete at once."""
    scans, complete = {}, False
    agenda, seen = [nonterminal], {nonterminal}
    while agenda:
        for rule in GRAMMAR[agenda.pop()]:
            if not rule:
                complete = True
            elif rule[0] in GRAMMAR:
                if rule[0] not in seen:
                    seen.add(rule[0])
                    agenda.append(rule[0])
            else:
                if len(rule) > 2 or len(rule) == 2 and rule[1] not in GRAMMAR:
                    raise ValueError("the grammar is not right-linear")
                scans[rule[0]] = rule[1] if len(rule) == 2 else ""
    return tuple(sorted(scans.items())), complete


@lru_cache
def inserted(item: str) -> tuple[tuple[str, str], ...]:
    """(item, edits) that insert productions reach from an item, itself included; a longer way to an item never pays."""
    found, agenda = {item: ""}, [item]
    while agenda:
        at = agenda.pop(0)
        for terminal, after in predicted(at)[0] if at else ():
            if terminal in WRITABLE and after not in found:
                found[after] = found[at] + "I"
                agenda.append(after)
    return tuple(found.items())


@lru_cache(None)
def moves(item: str, symbol: str) -> tuple[tuple[str, int, str], ...]:
    """(item, cost, edits) over one row: ``x`` is a row that must go, a capital a truncated row, ``o`` an unknown role."""
    best: dict[str, tuple[int, str]] = {}

    def offer(to: str, cost: int, edits: str) -> None:
        best[to] = min(best.get(to, (cost, edits)), (cost, edits))

    kept = CUT if symbol.isupper() else 0
    for at, edits in inserted(item):
        cost = INSERT * len(edits)
        offer(at, cost + DELETE, edits + "D")
        for terminal, after in predicted(at)[0] if at and symbol != "x" else ():
            if terminal == symbol.lower():
                offer(after, cost + kept, edits + "K")
            if terminal in WRITABLE:
                offer(after, cost + REROLE + kept, edits + "R")
    return tuple((to, cost, edits) for to, (cost, edits) in sorted(best.items()))


def parse(symbols: str) -> tuple[int, str]:
    """The smallest (cost, audit) that turns the rows into a dialogue."""
    if len(symbols) <= 64:
        return _parse_short(symbols)
    return _parse(symbols)


def _parse(symbols: str) -> tuple[int, str]:
    chart: dict[str, tuple[int, int]] = {START: (0, 0)}  # item: cost, rank of its audit
    back: list[dict[str, tuple[str, str]]] = []  # item: the item before it, and the edits between
    for symbol in symbols:
        best: dict[str, tuple[int, int, str, str]] = {}
        for item, (cost, rank) in chart.items():
            for to, more, edits in moves(item, symbol):
                new = (cost + more, rank, edits, item)
                if to not in best or new < best[to]:
                    best[to] = new
        order = sorted(best, key=lambda to: best[to][1:3])
        chart = {to: (best[to][0], rank) for rank, to in enumerate(order)}
        back.append({to: (b[3], b[2]) for to, b in best.items()})
    ends = [(cost + INSERT * len(edits), rank, edits, item) for item, (cost, rank) in chart.items() for to, edits in inserted(item) if not to or predicted(to)[1]]
    cost, _, edits, item = min(ends)
    audit = [edits]
    for step in reversed(back):
        item, edits = step[item]
        audit.append(edits)
    return cost, "".join(reversed(audit))


_parse_short = lru_cache(1 << 16)(_parse)


def _expected(item: str) -> tuple[str, str]:
    """(terminal, item after it) that a rerole or insert production writes from an item."""
    return next((t, after) for t, after in predicted(item)[0] if t in WRITABLE)


def faulty_rows(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, role, digest, fault) of each row, sorted within conversations and partitions; texts are left behind."""
    said = F.coalesce(F.col(text), F.lit(" "))
    left = F.rtrim(said, F.lit(SPACES))
    rows = df.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.sha2(said, 256).alias("digest"), (left == "").alias("blank"),
        (~F.right(left, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("place") > 1, DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(0)
    # One exchange serves the window, the sort and the parse.
    judged = rows.repartition("conv_id").withColumn("place", F.row_number().over(seen)).withColumn("fault", fault)
    return judged.select("conv_id", "turn", "role", "digest", "fault", "place").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest", "place")


_PARSED = "n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LEGAL = {"su", "ua", "au"}


class _Conversation:
    def __init__(self) -> None:
        self.symbols: list[str] = []
        self.faults = [0, 0, 0, 0]
        self.low = self.high = self.last = None
        self.turns = self.illegal = 0
        self.initial = None

    def add(self, turn: int | None, role: str, fault: int) -> None:
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in _LEGAL:
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.last:
            self.low = turn if self.low is None else self.low
            self.high = self.last = turn
            self.turns += 1
        self.faults[fault] += 1
        known = initial if initial in ("s", "u", "a") else "o"
        self.symbols.append("x" if fault in (BLANK, DUPLICATE) else known.upper() if fault == TRUNCATED else known)

    def row(self, conv_id) -> tuple:
        cost, audit = parse("".join(self.symbols))
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return conv_id, len(self.symbols), gaps, *self.faults[1:], self.illegal, cost, audit


def _parser(schema: pa.Schema):
    """Task over sorted rows: one row for each conversation."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []
        for batch in batches:
            for conv, turn, role, fault in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "fault")), strict=True):
                if state is None or conv != current:
                    if state is not None:
                        done.append(state.row(current))
                    current, state = conv, _Conversation()
                state.add(turn, role, fault)
                if len(done) >= 1024:
                    yield packed(done)
                    done = []
        if state is not None:
            done.append(state.row(current))
        if done:
            yield packed(done)

    return task


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def parse_conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: its faults, and the cost and audit of its cheapest repair."""
    kind = dict(df.dtypes)[conv_id]
    kind = kind if kind in ("bigint", "int", "string") else "string"
    rows = faulty_rows(df.withColumn(conv_id, F.col(conv_id).cast(kind)), conv_id, turn, role, text)
    names = ["conv_id", *(f.split(" ")[0] for f in _PARSED.split(", "))]
    schema = pa.schema(list(zip(names, [_arrow(kind), *7 * [pa.int64()], pa.string()], strict=True)))
    return rows.mapInArrow(_parser(schema), f"conv_id {kind}, {_PARSED}")


def _writer(schema: pa.Schema):
    """Task over an audit and then the sorted rows of each conversation: its edits in order, with the rows they leave."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, item = "", 0, START
        for batch in batches:
            out: list[tuple] = []
            for conv, audited, turn, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "audit", "turn", "role", "text")), strict=True):
                if audited is not None:
                    audit, at, item = audited, 0, START
                else:  # the letter of this row
                    edit = audit[at]
                    if edit == "K":
                        item = dict(predicted(item)[0])[role[:1]]
                    elif edit == "R":
                        terminal, item = _expected(item)
                        role = WRITABLE[terminal]
                    out.append((conv, at, edit, turn, role, text))
                    at += 1
                while audit[at : at + 1] == "I":
                    terminal, item = _expected(item)
                    out.append((conv, at, "I", None, WRITABLE[terminal], ""))
                    at += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return task


def repair_conversations(df: DataFrame, parsed: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, edit, turn, role, text): all edits in order; rows that are not deleted make up the repaired conversation.

    Partitions hold whole conversations, each in order.
    """
    kind = dict(parsed.dtypes)["conv_id"]
    said = F.coalesce(F.col(text), F.lit(" "))
    rows = df.select(
        F.col(conv_id).cast(kind).alias("conv_id"), F.lit(None).cast("string").alias("audit"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), said.alias("text"), F.sha2(said, 256).alias("digest"), F.lit(1).alias("part"),
    )
    none = F.lit(None).cast("string")
    heads = parsed.select("conv_id", "audit", F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"), none.alias("digest"), F.lit(0).alias("part"))
    sorted_rows = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "part", F.asc_nulls_first("turn"), "role", "digest")
    names = ("conv_id", "place", "edit", "turn", "role", "text")
    schema = pa.schema(list(zip(names, (_arrow(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)))
    return sorted_rows.drop("part", "digest").mapInArrow(_writer(schema), f"conv_id {kind}, place long, edit string, turn long, role string, text string")


def repaired_digests(edits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of rows as ``repair_conversations`` leaves them: ``role:text``, joined by newlines."""
    kind = dict(edits.dtypes)["conv_id"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, first, done = None, None, True, []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], _arrow(kind)), pa.array([d for _, d in done], pa.string())], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            for conv, edit, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "edit", "role", "text")), strict=True):
                if digest is None or conv != current:
                    if digest is not None:
                        done.append((current, digest.hexdigest()))
                    current, digest, first = conv, hashlib.sha256(), True
                if edit != "D":
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            if done:
                yield packed()
                done = []
        if digest is not None:
            done.append((current, digest.hexdigest()))
            yield packed()

    return edits.mapInArrow(task, f"conv_id {kind}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage: by crc32 of ``conv_id:turn`` modulo 20 a row is dropped, emptied, stripped of ends of sentences, repeated or given to the user."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = conversations.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"), copies.alias("copy"))
    return rows.drop("copy")


def op12_earley(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = damaged(conversations)
    parsed = written(parse_conversations(rows), "parsed")
    digests = repaired_digests(repair_conversations(rows, parsed))
    every = conversations.select("conv_id").distinct()
    found = parsed.join(digests.withColumnRenamed("conv_id", "own"), F.col("conv_id").eqNullSafe(F.col("own"))).withColumnRenamed("conv_id", "of").drop("own")
    out = every.join(found, every["conv_id"].eqNullSafe(found["of"]), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {"op12_earley": op12_earley}
#: The damage needs a crc32, spelled out bit by bit; the cheapest edits are folded over the four places of ``s?(ua)+``.
ORACLE_SQL = {
    "op12_earley": r"""
    WITH RECURSIVE keyed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(unicode(c) AS BIGINT)),
                   lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(c, b)), 4294967295) AS crc
        FROM conversations),
    rowset AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM (SELECT *, xor(crc, 4294967295) % 20 AS kind FROM keyed), (SELECT unnest([0, 1]) AS copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n,
               rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM rowset),
    judged AS (
        SELECT *, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN NOT contains('.!?', right(said, 1)) THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS r,
               lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed),
    sums AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
               count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n FROM judged GROUP BY conv_id),
    steps AS (SELECT conv_id, n, r, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut, fault IN ('blank', 'duplicate') AS gone FROM judged),
    fold AS (
        SELECT conv_id, CAST(0 AS BIGINT) AS n, [{'c': 0, 'a': ''}, {'c': 9999999, 'a': ''}, {'c': 2, 'a': 'I'}, {'c': 4, 'a': 'II'}] AS s FROM sums
        UNION ALL
        SELECT conv_id, n, [s[1], s[2], list_min([s[3], {'c': s[1].c + 2, 'a': s[1].a || 'I'}, {'c': s[2].c + 2, 'a': s[2].a || 'I'}, {'c': s[4].c + 2, 'a': s[4].a || 'I'}]),
               list_min([s[4], {'c': s[3].c + 2, 'a': s[3].a || 'I'}, {'c': s[1].c + 4, 'a': s[1].a || 'II'}, {'c': s[2].c + 4, 'a': s[2].a || 'II'}])] AS s
        FROM (SELECT f.conv_id, t.n, [
                  {'c': s[1].c + 3, 'a': s[1].a || 'D'},
                  list_min([{'c': s[2].c + 3, 'a': s[2].a || 'D'}, {'c': CASE WHEN NOT gone AND r = 's' THEN s[1].c + cut ELSE 9999999 END, 'a': s[1].a || 'K'}]),
                  list_min([{'c': s[3].c + 3, 'a': s[3].a || 'D'}]
                      || list_transform([s[1], s[2], s[4]], lambda p: {'c': CASE WHEN gone THEN 9999999 WHEN r = 'u' THEN p.c + cut ELSE p.c + cut + 2 END, 'a': p.a || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END})),
                  list_min([{'c': s[4].c + 3, 'a': s[4].a || 'D'}]
                      || list_transform([s[3]], lambda p: {'c': CASE WHEN gone THEN 9999999 WHEN r = 'a' THEN p.c + cut ELSE p.c + cut + 2 END, 'a': p.a || CASE WHEN r = 'a' THEN 'K' ELSE 'R' END}))] AS s
              FROM fold f JOIN steps t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.n = f.n + 1)),
    ends AS (SELECT f.conv_id, list_min([s[1], s[4]]) AS e FROM fold f JOIN sums USING (n) WHERE f.conv_id IS NOT DISTINCT FROM sums.conv_id),
    letters AS (SELECT conv_id, e, unnest(range(1, length(e.a) + 1)) AS i FROM ends),
    edits AS (SELECT *, substr(e.a, i, 1) AS edit, CAST(length(replace(left(e.a, i), 'I', '')) AS BIGINT) AS n FROM letters),
    lines AS (
        SELECT d.conv_id, i, edit, CASE WHEN edit = 'I' THEN '' ELSE j.text END AS text, CASE WHEN edit = 'K' THEN j.role END AS role
        FROM edits d LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM d.conv_id AND j.n = d.n WHERE edit <> 'D'),
    named AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) - CASE WHEN first_value(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) = 's' THEN 1 ELSE 0 END AS place FROM lines),
    texts AS (
        SELECT conv_id, string_agg(coalesce(role, CASE WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY i) AS said FROM named GROUP BY conv_id),
    ids AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           CAST(coalesce(e.c, 0) AS BIGINT) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
    FROM ids LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM ids.conv_id
    LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM ids.conv_id
    """
}
