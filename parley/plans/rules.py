"""Queries of the rules on cells, texts, dialogues, graphs, scenario tables and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import cells, texts
from parley.operators import agreement, audit, calls, cases, checks, flow, paired, replay, sampling, scoring, stats
from parley.plans.frames import E_SQL, e_frame, read
from parley.plans.registry import GROUPS, SEED, STEM_SQL, _pairs, query, rounded

# Cells.


@query("""SELECT o_orderkey, printf('%s_%06d__%s__rep%02d.jsonl', c, o_orderkey, a, r) AS filename, c AS category,
CASE WHEN stratum <> 'overall' OR population <> 'semantic' THEN 'exploratory' WHEN metric = 'm0' THEN 'primary' ELSE 'secondary' END AS family,
CASE WHEN r <> 5 THEN CAST(r = 1 AS DOUBLE) END AS zero, CASE o_orderkey % 6 WHEN 0 THEN 'timeout' WHEN 1 THEN 'prompt_too_long' WHEN 2 THEN 'prompt_too_long' WHEN 4 THEN 'retry' END AS event,
CASE o_orderkey % 5 WHEN 0 THEN 'max_turns_with_incomplete_beat' WHEN 1 THEN 'instrument_contract_false_positive' WHEN 2 THEN 'instrument_true_failure' END AS class,
CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS yes_no, CASE o_orderkey % 3 WHEN 0 THEN 'incorrect' WHEN 1 THEN 'partial' ELSE 'correct' END AS accuracy,
CASE WHEN o_orderkey % 2 + o_custkey % 2 = 0 THEN 'none_checkable' WHEN o_custkey % 2 > 0 THEN 'some_unsupported' ELSE 'all_supported' END AS support,
CASE WHEN o_custkey % 3 = 0 THEN 'none_checkable' WHEN o_orderkey % 4 = 0 THEN 'all_supported' ELSE 'some_unsupported' END AS support_by_rate,
CASE o_orderkey % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'False' ELSE '' END AS cell, replace(printf('%.2f', o_totalprice), '.', ',') AS price,
CASE WHEN o_orderkey % 10 = 0 THEN '<0,001' ELSE replace(printf('%.3f', (o_orderkey % 10) / 10.0), '.', ',') END AS p, replace(printf('%.4f', (o_orderkey % 8) / 8.0 * 100), '.', ',') || '%' AS pct
FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'happy_path' WHEN 1 THEN 'edge' ELSE 'adversarial' END AS c, CASE WHEN o_orderstatus = 'F' THEN 'baseline' ELSE 'fsm' END AS a, CAST(o_custkey % 12 + 1 AS INTEGER) AS r,
'm' || o_custkey % 2 AS metric, CASE WHEN o_orderkey % 4 < 3 THEN 'semantic' ELSE 'frozen' END AS population, CASE WHEN o_orderkey % 5 < 3 THEN 'overall' ELSE 'edge' END AS stratum FROM orders)""")
def q_cell_rules(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    rep = (c % 12 + 1).cast("int")
    sid = F.format_string("%s_%06d", pick(["happy_path", "edge", "adversarial"], k % 3), k)
    family = cells.family(F.concat(F.lit("m"), (c % 2).cast("string")), F.when(k % 4 < 3, "semantic").otherwise("frozen"), F.when(k % 5 < 3, "overall").otherwise("edge"), ["m0"], ["semantic"])
    error = pick(["Request TIMED OUT", "prompt uses 9000 tokens", "900 over the prompt budget", "timeout soon", "", None], k % 6)
    kind, reason = pick(["simulation", "instrument", "instrument", "instrument", None], k % 5), pick(["max_turns_with_incomplete_beat", "invalid_candidate_retry_exhausted", "invalid_candidate_retry_exhausted", "other", "other"], k % 5)
    return read(spark, sf, "orders").select(
        "o_orderkey",
        cells.dialogue_filename(sid, F.when(F.col("o_orderstatus") == "F", "baseline").otherwise("fsm"), rep).alias("filename"),
        cells.category_of(sid).alias("category"),
        family.alias("family"),
        cells.zero_checkable(F.when(rep != 5, rep - 1)).alias("zero"),
        cells.call_event(error, F.when(k % 6 == 4, 2).otherwise(1)).alias("event"),
        cells.failure_class(kind, reason, k % 5 == 1).alias("class"),
        cells.yes_no(F.when(k % 2 == 0, " TRUE").otherwise("No")).alias("yes_no"),
        cells.accuracy_label((k % 3) / 2).alias("accuracy"),
        cells.support_label(k % 2, c % 2).alias("support"),
        cells.support_label_from_rate(c % 3, 1 - (k % 4) / 8).alias("support_by_rate"),
        cells.csv_cell(F.when(k % 3 < 2, k % 3 == 0), boolean=True).alias("cell"),
        cells.decimal_comma(F.col("o_totalprice"), 2).alias("price"),
        cells.p_text((k % 10) / 10).alias("p"),
        cells.percent_text((k % 8) / 8).alias("pct"),
    )


@query("SELECT s_name AS scenario_id, n.r AS repetition FROM supplier, (SELECT unnest(range(1, 4)) AS r) n WHERE s_suppkey % 5 <> 2")
def q_population(spark, sf):
    rows = read(spark, sf, "supplier").select(F.col("s_name").alias("scenario_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("repetition"), "s_suppkey")
    dropped = rows.where("s_suppkey % 5 = 2")
    return paired.named_population(rows, "frozen_gate", {"semantic_primary": None, "frozen_gate": dropped}).select("scenario_id", "repetition")


@query(f"""WITH {E_SQL}, z AS (SELECT category, scenario_id, agent, avg(CAST(m2 % 3 = 0 AS DOUBLE)) FILTER (m2 IS NOT NULL) AS v FROM e GROUP BY ALL HAVING count(m2) > 0)
SELECT a.category, a.scenario_id, round(a.v, 6) AS baseline, round(b.v, 6) AS fsm, round(b.v - a.v, 6) AS diff FROM z a JOIN z b ON a.scenario_id = b.scenario_id AND a.agent = 'baseline' AND b.agent = 'fsm'""")
def q_zero_checkable_pairs(spark, sf):
    rows = e_frame(spark, sf).withColumn("n_checkable", F.col("m2") % 3)
    return rounded(paired.zero_checkable_pairs(rows, "n_checkable").select("category", "scenario_id", "baseline", "fsm", "diff"))


# Texts.


@query("""SELECT conv_id, turn, regexp_matches(coalesce(text, '') || ' F' || CASE WHEN turn % 2 = 0 THEN '07' ELSE '7' END, '\\bF[0-9]{2}\\b') AS leak, replace(text, 'th', '[redacted]') AS redacted,
contains(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' '), 'th and') AS carried, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squeezed,
CASE WHEN turn % 2 = 0 THEN 'F01,F02' ELSE 'F01,F02,F03' END AS ids, trim(text) AS section, '1. ' || role || chr(10) || '2. b' AS listed FROM conversations""")
def q_text_rules(spark, sf):
    t, turn = F.col("text"), F.col("turn")
    raw = F.when(turn % 2 == 0, " F02 ;F01;; F02").otherwise("F03;F02; F01")
    return read(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        texts.fact_id_leak(F.concat(F.coalesce(t, F.lit("")), F.when(turn % 2 == 0, " F07").otherwise(" F7"))).alias("leak"),
        texts.redact(t, F.lit("th")).alias("redacted"),
        texts.contains_normalized(F.lit("Th, AND"), t).alias("carried"),
        texts.squeezed(t).alias("squeezed"),
        F.array_join(texts.fact_ids(raw), ",").alias("ids"),
        texts.markdown_section(F.concat(F.lit("# All\n## Notes\n"), t, F.lit("\n\n## End\nx")), "Notes").alias("section"),
        texts.numbered(F.array("role", F.lit("b"))).alias("listed"),
    )


@query(f"""WITH u AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?')) AS w FROM conversations), s AS (SELECT conv_id, turn, w, {STEM_SQL.format("w")} AS s FROM u),
h AS (SELECT conv_id, turn, bool_or(w = 'theres' OR left(s, 4) = 'ther') AS hit FROM s GROUP BY ALL) SELECT conv_id, turn, coalesce(hit, false) AS carried FROM conversations LEFT JOIN h USING (conv_id, turn)""")
def q_carries(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(texts.carries(F.lit("theres"), F.col("text")), F.lit(False)).alias("carried"))


PHRASES = [
    ("Before it is shipped", True, False), ("before it shipped", False, False), ("before you ship my order", True, False), ("It will ship", True, False), ("it will ship once paid", False, False),
    ("shipping tomorrow", True, False), ("No thanks", True, False), ("I don't know", True, False), ("fine", False, False), ("Good bye", False, True), ("That's all, thanks!", False, True), ("bye, but wait", False, False), ("goodbye thanks", False, True),
]


def _phrase_sql() -> str:
    rows = ", ".join("({}, '{}', {}, {})".format(i, p.replace("'", "''"), str(a).lower(), str(b).lower()) for i, (p, a, b) in enumerate(PHRASES))
    return f"SELECT p_partkey, phrase, denies, farewell FROM part JOIN (VALUES {rows}) v(i, phrase, denies, farewell) ON p_partkey % {len(PHRASES)} = i"


@query(_phrase_sql())
def q_phrases(spark, sf):
    phrase = F.element_at(F.array(*[F.lit(p) for p, _, _ in PHRASES]), (F.col("p_partkey") % len(PHRASES) + 1).cast("int"))
    rows = read(spark, sf, "part").select("p_partkey", phrase.alias("phrase"))
    return rows.select("p_partkey", "phrase", texts.denies(F.col("phrase")).alias("denies"), texts.bare_farewell(F.col("phrase"), texts.FAREWELLS, ["thanks"]).alias("farewell"))


@query("""WITH t AS (SELECT conv_id, lower(text) AS l, text, regexp_replace(text, '\\s+', ' ', 'g') AS s FROM conversations)
SELECT conv_id, coalesce(bool_or(contains(text, 'Th and')), false) AS exact, coalesce(bool_or(contains(l, 'th and')), false) AS ignoring_case, coalesce(bool_or(contains(s, 'Th and')), false) AS squeezed FROM t GROUP BY ALL""")
def q_literal_search(spark, sf):
    from parley.operators import script

    rows = read(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("messages"))
    return rows.select("conv_id", script.literal_search(F.lit("Th and"), F.col("messages")).alias("x")).select("conv_id", "x.*")


# Dialogues as arrays of records.


def _records(spark, sf):
    record = F.struct("turn", F.coalesce("text", F.lit("")).alias("agent_reply"), (F.col("turn") % 2 == 0).alias("cached"), (F.length(F.coalesce("text", F.lit(""))) / 64).alias("llm_latency_s"), F.lit(0.5).alias("turn_latency_s"), F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("text", F.lit("")).alias("content"))
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(record)).alias("records"))


@query("""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, coalesce(sum(length(text) / 64.0) FILTER (turn % 2 <> 0), 0.0) AS llm_latency_s, count(*) * 0.5 AS turn_latency_s, bool_or(contains(text, 'ingha')) AS injection_succeeded,
bool_or(contains(lower(text), 'hatth') OR contains(lower(text), 'zzz')) AS policy_violation, regexp_matches(string_agg(text, chr(10) ORDER BY turn), '\\bF[0-9]{2}\\b') AS fact_id_leak, CAST(sum(length(text)) AS INTEGER) AS chars,
string_agg(CASE WHEN role = 'user' THEN 'assistant' ELSE 'user' END, ',' ORDER BY turn) AS roles FROM t GROUP BY ALL""")
def q_dialogue_metrics(spark, sf):
    r = F.col("records")
    return _records(spark, sf).select(
        "conv_id",
        scoring.n_turns(r).alias("n_turns"),
        scoring.latency(r, "llm_latency_s", True).alias("llm_latency_s"),
        scoring.latency(r, "turn_latency_s", False).alias("turn_latency_s"),
        scoring.injection_succeeded(r, F.lit("ingha")).alias("injection_succeeded"),
        scoring.policy_violation(r, F.array(F.lit("HATTH"), F.lit("zzz"))).alias("policy_violation"),
        scoring.leaks_fact_id(r).alias("fact_id_leak"),
        calls.message_chars(r).alias("chars"),
        F.array_join(F.transform(texts.as_messages(r, F.lit("user")), lambda m: m["role"]), ",").alias("roles"),
    )


CLAIMS_SQL = """c AS (SELECT l_orderkey AS k, l_linenumber AS i, CASE WHEN l_linenumber % 3 = 0 THEN 'no' WHEN l_linenumber % 5 = 4 THEN 'unverifiable' ELSE 'yes' END AS s, 'F' || lpad(CAST(l_partkey % 20 AS VARCHAR), 2, '0') AS f FROM lineitem)"""


def _claims(spark, sf):
    s = F.when(F.col("l_linenumber") % 3 == 0, "no").when(F.col("l_linenumber") % 5 == 4, "unverifiable").otherwise("yes")
    fact = F.format_string("F%02d", F.col("l_partkey") % 20)
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), scoring.checked_claim(s, F.when(s == "yes", fact)).alias("supported_by_kb"), F.when(s == "yes", fact).alias("fact_id"))


@query(f"""WITH {CLAIMS_SQL} SELECT k, coalesce(array_to_string(list_sort(list(DISTINCT f) FILTER (s = 'yes')), ','), '') AS predicted, CAST(count(*) FILTER (s = 'yes') AS INTEGER) AS n_yes, CAST(count(*) FILTER (s = 'no') AS INTEGER) AS n_no, CAST(count(*) FILTER (s = 'unverifiable') AS INTEGER) AS n_unverifiable FROM c GROUP BY ALL""")
def q_claims(spark, sf):
    rows = _claims(spark, sf).groupBy("k").agg(F.collect_list(F.struct("supported_by_kb", "fact_id")).alias("claims"))
    s = scoring.claims_signature(F.col("claims"))
    return rows.select("k", s.alias("s")).select("k", F.array_join("s.ids", ",").alias("predicted"), "s.n_yes", "s.n_no", "s.n_unverifiable")


@query(f"""WITH {CLAIMS_SQL}, q AS (SELECT k, list(DISTINCT f) FILTER (s = 'yes') AS said, count(*) FILTER (s = 'yes') AS y, count(*) FILTER (s = 'no') AS n FROM c GROUP BY k),
t AS (SELECT k, coalesce(said, []) AS said, y, n, ['F01', 'F' || lpad(CAST(k % 20 AS VARCHAR), 2, '0')] AS need FROM q), x AS (SELECT k, y, n, len(list_intersect(list_distinct(need), said)) AS tp, len(said) AS ns, len(list_distinct(need)) AS nn FROM t)
SELECT k, CAST(tp AS INTEGER) AS tp, CAST(ns - tp + n AS BIGINT) AS fp, CAST(nn - tp AS INTEGER) AS fn, CASE WHEN y + n > 0 THEN round(y / (y + n), 6) END AS claim_support FROM x""")
def q_human_scores(spark, sf):
    c = _claims(spark, sf)
    responses = c.where("supported_by_kb = 'yes'").groupBy("k", "i").agg(F.collect_list("fact_id").alias("fact_ids")).unionByName(c.select("k", "i").where("i = 1").withColumn("fact_ids", F.array().cast("array<string>")))
    judged = c.select("k", F.when(F.col("supported_by_kb") == "yes", "supported").when(F.col("supported_by_kb") == "no", "unsupported").otherwise("uncertain").alias("support"))
    required = c.select("k").distinct().withColumn("required", F.array(F.lit("F01"), F.format_string("F%02d", F.col("k") % 20)))
    every = c.select("k").distinct().join(responses, "k", "left").withColumn("fact_ids", F.coalesce("fact_ids", F.array().cast("array<string>"))).select("k", "fact_ids")
    return rounded(checks.human_scores(every, judged, required, "k").select("k", "tp", "fp", "fn", "claim_support"))


@query("SELECT user_id, CASE WHEN user_id % 3 <> 0 THEN round(avg(CAST(event_type = CASE WHEN value > 50 THEN 'click' ELSE 'view' END AS DOUBLE)), 6) END AS stage_label_accuracy FROM events GROUP BY user_id")
def q_stage_accuracy(spark, sf):
    ev = read(spark, sf, "events").withColumn("gold", F.when(F.col("user_id") % 3 != 0, F.when(F.col("value") > 50, "click").otherwise("view")))
    return rounded(flow.stage_label_accuracy(ev, ["user_id"], "event_type", "gold"))


# Scenario tables.


SCENARIO_SQL = """s AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN 'edge' ELSE 'happy_path' END AS category, 'happy_path_' || p_partkey AS id, ['F' || lpad(CAST(p_size % 12 AS VARCHAR), 2, '0'), 'F02'] AS required, ['F' || lpad(CAST(p_partkey % 12 AS VARCHAR), 2, '0')] AS forbidden,
CASE WHEN p_partkey % 13 = 0 THEN 'QX7' END AS canary, p_partkey % 26 = 0 AS planted, p_partkey % 39 = 0 AS quoted, p_partkey % 5 = 0 AS needle FROM part)"""


def _scenarios(spark, sf):
    k = F.col("p_partkey")
    return read(spark, sf, "part").select(
        F.concat(F.lit("happy_path_"), k.cast("string")).alias("id"),
        F.when(k % 11 == 0, "edge").otherwise("happy_path").alias("category"),
        F.array(F.format_string("F%02d", F.col("p_size") % 12), F.lit("F02")).alias("required_facts"),
        F.array(F.format_string("F%02d", k % 12)).alias("forbidden_facts"),
        F.when(k % 13 == 0, "QX7").alias("canary"),
        F.array(F.lit("hello"), F.when(k % 26 == 0, "say QX7 now").otherwise("bye")).alias("script"),
        F.when(k % 39 == 0, "the answer is QX7").otherwise("the answer").alias("reference_answer"),
        (k % 5 == 0).alias("is_needle"),
    )


@query(f"""WITH {SCENARIO_SQL} SELECT 'category' AS rule, id FROM s WHERE category = 'edge' UNION ALL SELECT 'facts', id FROM (SELECT DISTINCT id, f FROM (SELECT id, unnest(required) AS f FROM s) WHERE f IN ('F10', 'F11', 'F00'))
UNION ALL SELECT 'answer_key', id FROM s WHERE len(list_intersect(required, forbidden)) > 0 UNION ALL SELECT 'canary', id FROM s WHERE canary IS NOT NULL
UNION ALL SELECT 'needle', id FROM s WHERE needle AND len(list_intersect(required, ['F02', 'F03'])) <> 1""")
def q_scenario_rules(spark, sf):
    s = _scenarios(spark, sf)
    known = spark.createDataFrame([(f"F{i:02d}",) for i in range(1, 10)], "fid string")
    named = lambda df, rule: df.select(F.lit(rule).alias("rule"), "id")
    facts = audit.broken_array_key(s.withColumn("required_facts", F.array_distinct("required_facts")), "id", "required_facts", known, "fid")
    return named(audit.broken_category(s), "category").unionByName(named(facts, "facts")).unionByName(named(audit.broken_answer_key(s), "answer_key")).unionByName(named(audit.broken_canary(s), "canary")).unionByName(named(audit.broken_needle(s, ["F02", "F03"]), "needle"))


@query("SELECT 'number' AS rule, printf('F%02d', CASE WHEN n_nationkey >= 20 THEN n_nationkey + 2 ELSE n_nationkey + 1 END) AS id FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT 'pattern', n_name FROM nation WHERE NOT regexp_matches(n_name, '^[A-M]')")
def q_fact_rules(spark, sf):
    n = read(spark, sf, "nation")
    facts = n.select(F.format_string("F%02d", F.when(F.col("n_nationkey") >= 20, F.col("n_nationkey") + 2).otherwise(F.col("n_nationkey") + 1)).alias("id"))
    fields = n.select(F.col("n_name").alias("example"), F.lit("^[A-M]").alias("pattern"))
    return audit.broken_numbering(facts).select(F.lit("number").alias("rule"), "id").unionByName(audit.broken_own_pattern(fields).select(F.lit("pattern").alias("rule"), F.col("example").alias("id")))


@query("""WITH u AS (SELECT s_nationkey AS id, count(*) AS n FROM supplier GROUP BY ALL), k AS (SELECT n_nationkey AS id FROM nation WHERE n_nationkey < 20)
SELECT coalesce(k.id, u.id) AS id, CASE WHEN k.id IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' ELSE 'repeated' END AS problem FROM k FULL JOIN u USING (id) WHERE k.id IS NULL OR n IS NULL OR n > 1""")
def q_coverage(spark, sf):
    return checks.coverage(read(spark, sf, "supplier"), "s_nationkey", read(spark, sf, "nation").where("n_nationkey < 20"), "n_nationkey")


@query("SELECT s_suppkey, s_nationkey, n_name, 'F' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS needle FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 2 = 0")
def q_lookup(spark, sf):
    s = read(spark, sf, "supplier")
    listed = s.where("s_suppkey % 2 = 0").select("s_suppkey")
    named = checks.lookup(checks.select_listed(s, listed, "s_suppkey"), read(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    fact = F.format_string("F%02d", "s_nationkey")
    return named.select("s_suppkey", "s_nationkey", "n_name", checks.singleton(F.array(fact, F.lit("F98")), F.array(fact, F.lit("F99"))).alias("needle"))


@query("SELECT event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def q_first_seen(spark, sf):
    return checks.first_seen(read(spark, sf, "events"), "event_type", "event_id")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS ord FROM orders")
def q_restored_order(spark, sf):
    o = read(spark, sf, "orders")
    return checks.restored_order(o.select(F.col("o_orderkey").alias("k")), o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("ord")), ["k"], "ord").select("k", "ord")


# Turns.


@query("SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS turn, upper(event_type) AS label, event_type AS state_after FROM events")
def q_labelled_turns(spark, sf):
    seq = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    logs = read(spark, sf, "events").groupBy("user_id").agg(seq.alias("s")).select("user_id", F.transform("s", lambda x: F.struct(x["event_type"].alias("state_after"))).alias("records"), F.transform("s", lambda x: F.upper(x["event_type"])).alias("labels"))
    return checks.labelled_turns(logs, "records", "labels", ["user_id"])


@query("""WITH b AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events WHERE event_type <> 'login') SELECT user_id, event_type, event_id FROM b WHERE r = 1""")
def q_first_per_beat(spark, sf):
    rows = read(spark, sf, "events").withColumn("beat", F.when(F.col("event_type") != "login", F.col("event_type")))
    return checks.first_per_beat(rows, ["user_id"], "beat", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT conv_id, turn, beat FROM conversations, (VALUES (1, 0, 1), (2, 2, 3), (3, 4, 9)) b(beat, a, z) WHERE turn BETWEEN a AND z")
def q_turns_of_beats(spark, sf):
    c = read(spark, sf, "conversations")
    spans = c.select("conv_id").distinct().select("conv_id", F.explode(F.array(*[F.struct(F.lit(b).alias("beat"), F.lit(x).alias("start_turn"), F.lit(y).alias("end_turn")) for b, x, y in ((1, 0, 1), (2, 2, 3), (3, 4, 9))])).alias("s")).select("conv_id", "s.*")
    return checks.turns_of_beats(c, spans, ["conv_id"], "turn").select("conv_id", "turn", "beat")


@query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_role FROM conversations")
def q_carried_state(spark, sf):
    return checks.carried_state(read(spark, sf, "conversations"), ["conv_id"], "turn", "role").select("conv_id", "turn", "role", "previous_role")


# Reports.


@query("""SELECT count(*) AS n, round(avg(CAST(quality = toxic AS DOUBLE)), 6) AS accuracy, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (quality <> toxic) AS misses FROM labels WHERE doc_id < 400""")
def q_fixture_report(spark, sf):
    """Fixtures are a short list: here the labels under 400."""
    cases_ = read(spark, sf, "labels").where("doc_id < 400").withColumnRenamed("doc_id", "id")
    return rounded(checks.fixture_report(cases_, "quality", "toxic").withColumn("misses", F.array_join("misses", ",")))


@query("SELECT count(*) AS n, count(*) FILTER (quality = 1) AS passed, round(avg(CAST(toxic = 1 AS DOUBLE)), 6) AS canary_delivered_share, round(avg(CASE WHEN doc_id % 2 = 0 THEN CAST(toxic = 0 AS DOUBLE) END), 6) AS injection_delivered_share FROM labels")
def q_adherence_report(spark, sf):
    rows = read(spark, sf, "labels").select((F.col("quality") == 1).alias("passed"), (F.col("toxic") == 1).alias("canary_delivered"), F.when(F.col("doc_id") % 2 == 0, F.col("toxic") == 0).alias("injection_delivered"))
    return rounded(checks.adherence_report(rows))


@query("""WITH r AS (SELECT r_name AS category, n_name AS cell, unnest(range(0, 6)) AS pos FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT printf('%s_%02d', category, row_number() OVER (PARTITION BY category ORDER BY (pos >= 4)::INT, cell, pos)) AS id, category, cell || pos AS slot FROM r""")
def q_expand_plan(spark, sf):
    n = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    plan = n.select(F.col("r_name").alias("category"), F.col("n_name").alias("cell"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat("n_name", i.cast("string"))).alias("slots"))
    return checks.expand_plan(plan, "slots")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 AS same FROM events")
def q_same_json(spark, sf):
    ev = read(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    other = F.format_string('{ "k" :  %d }', F.when(k % 2 == 0, k).otherwise(k + 1))
    return ev.select("event_id", checks.same_json(F.col("props"), other, "k int").alias("same"))


@query("SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_orderkey % 3 <> 0 AND contains('goal ' || o_orderpriority || ' by ' || o_orderstatus, 'by F')")
def q_matching_calls(spark, sf):
    o = read(spark, sf, "orders")
    history = F.array(F.col("o_orderkey").cast("string"), F.col("o_orderpriority"))
    dialogues = o.select(F.col("o_orderkey").alias("k"), history.alias("history"), F.concat(F.lit("goal "), "o_orderpriority").alias("goal"), F.lit("by F").alias("persona"))
    made = o.where("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("c"), history.alias("history"), F.concat(F.lit("goal "), "o_orderpriority", F.lit(" by "), "o_orderstatus").alias("prompt"))
    return checks.answers_by_history(dialogues, made, "history", "persona", "goal", "prompt").select("k", "c")


@query("SELECT s_name AS scenario_id, CAST(r AS INTEGER) AS repetition, agent FROM supplier, (SELECT unnest(range(1, 4)) AS r), (VALUES ('baseline'), ('fsm')) a(agent) WHERE NOT (s_suppkey % 2 = 0 AND r = 1)")
def q_pending(spark, sf):
    s = read(spark, sf, "supplier").select(F.col("s_name").alias("scenario_id"), "s_suppkey")
    planned = sampling.jobs(s, ["baseline", "fsm"], 3)
    done = s.where("s_suppkey % 2 = 0").select("scenario_id", F.lit(1).alias("repetition"))
    return sampling.pending(planned, done, ["scenario_id", "repetition"]).select("scenario_id", "repetition", "agent")


@query("""WITH k AS (SELECT o_orderkey AS k, o_orderpriority AS grp, o_custkey AS unit, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY md5('42|' || o_orderkey)) AS place FROM orders),
u AS (SELECT grp, unit, count(*) AS cap FROM k GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5('42|' || unit)) AS pos FROM u), s AS (SELECT grp, unit, pos, unnest(range(1, least(cap, 30) + 1)) AS slot FROM p),
d AS (SELECT grp, unit, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY slot, pos) AS r FROM s) WHERE r <= 30 GROUP BY ALL) SELECT k, grp, unit FROM k JOIN d USING (grp, unit) WHERE place <= n""")
def q_draw(spark, sf):
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("unit"))
    return sampling.draw(rows, ["grp"], "unit", "k", 30, SEED)


@query("SELECT s_suppkey, printf('D%03d', row_number() OVER (ORDER BY md5('7|' || s_suppkey))) AS blind_id FROM supplier")
def q_blind_ids(spark, sf):
    return sampling.blind_ids(read(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", 7, "D")


@query("""WITH r AS (SELECT quality AS o, toxic AS x, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS g FROM labels) SELECT CASE WHEN o <> g AND x = g THEN 'corrected' WHEN o <> g THEN 'remaining' WHEN x <> g THEN 'new' ELSE 'right' END AS change, count(*) AS n FROM r GROUP BY ALL""")
def q_compare_labels(spark, sf):
    lab = read(spark, sf, "labels")
    return agreement.compare_labels(lab.select("doc_id", F.col("quality").alias("label")), lab.select("doc_id", F.col("toxic").alias("label")), lab.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("label")), ["doc_id"], "label")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def q_first_labels(spark, sf):
    return agreement.first_labels(read(spark, sf, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey")


@query(f"""WITH {E_SQL}, w AS (SELECT metric, stratum, avg(diff) AS md, count(*) AS n FROM sp GROUP BY ALL), d AS (SELECT *, CASE WHEN md > 0 THEN 'fsm' WHEN md < 0 THEN 'baseline' ELSE 'tie' END AS direction FROM w)
SELECT metric, stratum, direction AS left_direction, n % 2 = 0 AS left_called, CASE direction WHEN 'fsm' THEN 'baseline' ELSE direction END AS right_direction, n % 3 = 0 AS right_called, direction <> 'fsm' AS same_direction, (n % 2 = 0) = (n % 3 = 0) AS same_call FROM d""")
def q_compare_conclusions(spark, sf):
    w = paired.wins_ties_losses(_pairs(spark, sf)).withColumn("direction", cells.direction(F.col("mean_diff")))
    left = w.withColumn("wilcoxon_p", F.when(F.col("n") % 2 == 0, 0.01).otherwise(0.5))
    right = w.withColumn("wilcoxon_p", F.when(F.col("n") % 3 == 0, 0.01).otherwise(0.5)).withColumn("direction", F.when(F.col("direction") == "fsm", "baseline").otherwise(F.col("direction")))
    return cases.compare_conclusions(left, right)


@query("SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_totalprice > 0.8 * 200000")
def q_over_budget(spark, sf):
    return calls.over_budget(read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")), "v", 200000)


@query("SELECT event_type, round(avg(value) * 360 * 2.5 / 2 / 3600, 6) AS run_hours, round(avg(value) * 360 * 2 / 2 / 3600, 6) AS judge_hours FROM events GROUP BY ALL")
def q_hours(spark, sf):
    means = read(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("mean"))
    return rounded(means.select("event_type", F.lit(1.0 * calls.run_hours(1.0, 360, 2.5, 2)) * F.col("mean"), F.lit(1.0 * calls.judge_hours(1.0, 360, 2, 2)) * F.col("mean")).toDF("event_type", "run_hours", "judge_hours"))


# Replay.


@query("""SELECT o_orderkey AS k, 'a' || o_custkey AS text, true AS answered FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, NULL, false FROM orders WHERE o_orderkey % 4 = 0""")
def q_replay(spark, sf):
    o = read(spark, sf, "orders")
    request = lambda df: df.withColumn("prompt_hash", replay.prompt_hash(F.lit("m"), F.lit("d"), F.to_json(F.array(F.struct(F.col("o_orderkey").cast("string").alias("content")))), F.lit("{}"), F.lit(None).cast("string")))
    cache = request(o.where("o_orderkey % 4 <> 0")).select("prompt_hash", F.concat(F.lit("a"), "o_custkey").alias("text"))
    asked = request(o).select(F.col("o_orderkey").alias("k"), "prompt_hash")
    backend = replay.ReplayBackend(cache)
    return backend.answer(asked).select("k", "text", F.lit(True).alias("answered")).unionByName(backend.misses(asked).select("k", F.lit(None).cast("string").alias("text"), F.lit(False).alias("answered")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type IN ('click', 'view') AS known FROM events")
def q_parsed_answers(spark, sf):
    ev = read(spark, sf, "events").withColumn("p", replay.parsed(F.col("props"), "k int"))
    return ev.select("event_id", "p.k", replay.enum_ok(F.array("event_type"), ["click", "view"]).alias("known"))


@query(f"WITH {E_SQL}, s AS (SELECT metric, stratum, list(diff ORDER BY scenario_id) AS d FROM sp GROUP BY ALL) SELECT metric, stratum, CAST(len(d) AS BIGINT) AS n, round(list_sum(d) / len(d), 6) AS mean, round(quantile_cont(x, 0.025), 6) AS low FROM (SELECT metric, stratum, d, unnest(d) AS x FROM s) GROUP BY metric, stratum, d")
def q_group_percentiles(spark, sf):
    def f(values):
        return sum(values) / len(values), stats.percentile(sorted(values), 2.5)

    return rounded(stats.per_group(_pairs(spark, sf), GROUPS, {"mean": "double", "low": "double"}, f))

