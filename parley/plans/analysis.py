"""Queries of the experiment's tables and of what reports take from them.

The seeded columns (p-values of sign flips, bootstrap intervals) are drawn in full
and compared bit for bit in the tests, as SQL has no such generator; here the
intervals must hold the mean, and all other columns are compared.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import texts
from parley.operators import audit, flags, paired, scoring, script, tables
from parley.plans.frames import E_SQL, METRICS, e_frame, read
from parley.plans.registry import P_SQL, query, rounded

LOST_SQL = """se AS (SELECT *, 'overall' AS stratum FROM e UNION ALL SELECT *, category AS stratum FROM e),
k AS (SELECT stratum, scenario_id, count(*) FILTER (agent = 'baseline' AND m1 IS NOT NULL) > 0 AND count(*) FILTER (agent = 'fsm' AND m1 IS NOT NULL) > 0 AS whole FROM se GROUP BY ALL),
kk AS (SELECT stratum, count(*) FILTER (whole) AS complete_pairs, count(*) FILTER (NOT whole) AS pairs_excluded_either_na FROM k GROUP BY ALL),
lost AS (SELECT 'm1' AS metric, stratum, agent, count(*) AS total_dialogues, count(*) FILTER (m1 IS NULL) AS na_dialogues, round(count(*) FILTER (m1 IS NULL) / count(*), 6) AS na_pct, count(m1) AS aggregatable_dialogues FROM se GROUP BY ALL)"""


@query(f"""WITH {E_SQL}, {LOST_SQL}, ss AS (SELECT *, 'overall' AS stratum FROM scores UNION ALL SELECT *, category AS stratum FROM scores),
d AS (SELECT metric, stratum, agent, count(*) AS n, CAST(sum(n_reps) AS BIGINT) AS n_dialogues, round(avg(mean), 6) AS mean, round(stddev_samp(mean), 6) AS sd, round(quantile_cont(mean, 0.5), 6) AS median, round(avg(sd), 6) AS mean_intra_sd FROM ss GROUP BY ALL)
SELECT 'semantic_primary' AS population, d.*, total_dialogues, na_dialogues, na_pct, aggregatable_dialogues, CASE WHEN metric = 'm1' THEN complete_pairs END AS complete_pairs, CASE WHEN metric = 'm1' THEN pairs_excluded_either_na END AS pairs_excluded_either_na
FROM d LEFT JOIN lost USING (metric, stratum, agent) LEFT JOIN kk USING (stratum)""")
def q_descriptive_table(spark, sf):
    return rounded(tables.descriptive(e_frame(spark, sf), METRICS, "semantic_primary", "m1"))


TEST_SQL = f"""{E_SQL}, {LOST_SQL}, ss AS (SELECT *, 'overall' AS stratum FROM scores UNION ALL SELECT *, category AS stratum FROM scores),
z AS (SELECT 'zero_checkable_claim_occurrence' AS metric, stratum, scenario_id, agent, avg(CAST(m2 % 5 = 0 AS DOUBLE)) AS mean FROM se WHERE m2 IS NOT NULL GROUP BY ALL),
a AS (SELECT metric, stratum, scenario_id, agent, mean FROM ss UNION ALL SELECT metric, stratum, scenario_id, agent, mean FROM z),
u AS (SELECT metric, stratum, count(*) FILTER (k = 1) AS n_dropped_unpaired FROM (SELECT metric, stratum, scenario_id, count(DISTINCT agent) AS k FROM a GROUP BY ALL) GROUP BY ALL),
pp AS (SELECT metric, stratum, scenario_id, baseline, fsm, round(fsm - baseline, 12) AS diff FROM (SELECT metric, stratum, scenario_id, max(mean) FILTER (agent = 'baseline') AS baseline, max(mean) FILTER (agent = 'fsm') AS fsm FROM a GROUP BY ALL) WHERE baseline IS NOT NULL AND fsm IS NOT NULL),
r AS (SELECT metric, stratum, diff, rank() OVER (PARTITION BY metric, stratum ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY metric, stratum, abs(diff)) - 1) / 2.0 AS rk FROM pp WHERE diff <> 0),
rb AS (SELECT metric, stratum, (coalesce(sum(rk) FILTER (diff > 0), 0) - coalesce(sum(rk) FILTER (diff < 0), 0)) / sum(rk) AS rank_biserial FROM r GROUP BY ALL),
w AS (SELECT metric, stratum, count(*) AS n, count(*) FILTER (diff > 0) AS wins, count(*) FILTER (diff = 0) AS ties, count(*) FILTER (diff < 0) AS losses, count(*) FILTER (diff <> 0) AS n_nonzero, avg(diff) AS md, avg(baseline) AS bm, avg(fsm) AS fm FROM pp GROUP BY ALL),
t AS (SELECT metric, stratum, n, wins, ties, losses, n_nonzero, md AS mean_diff, CASE WHEN metric LIKE 'zero%' THEN NULL ELSE coalesce(rank_biserial, 0.0) END AS rank_biserial, n_dropped_unpaired, CASE WHEN metric = 'm1' THEN complete_pairs END AS complete_pairs, CASE WHEN metric = 'm1' THEN pairs_excluded_either_na END AS pairs_excluded_either_na,
CASE WHEN md > 0 THEN 'fsm' WHEN md < 0 THEN 'baseline' ELSE 'tie' END AS direction, CASE WHEN metric LIKE 'zero%' THEN bm END AS baseline_mean, CASE WHEN metric LIKE 'zero%' THEN fm END AS fsm_mean, CASE WHEN metric LIKE 'zero%' THEN 'diagnostic_missingness' END AS role,
CASE WHEN stratum <> 'overall' THEN 'exploratory' WHEN metric IN ('m1', 'm3') THEN 'primary' ELSE 'secondary' END AS family FROM w JOIN u USING (metric, stratum) LEFT JOIN rb USING (metric, stratum) LEFT JOIN kk USING (stratum))"""
PRIMARY = ["m1", "m3"]


def _tested(spark, sf):
    rows = e_frame(spark, sf).withColumn("n_checkable", F.col("m2") % 5)
    return tables.tests(rows, METRICS, "semantic_primary", PRIMARY, ["semantic_primary"], 0, missing_of="m1", n_checkable="n_checkable")


@query(f"WITH {TEST_SQL} SELECT 'semantic_primary' AS population, * REPLACE (round(mean_diff, 6) AS mean_diff, round(rank_biserial, 6) AS rank_biserial, round(baseline_mean, 6) AS baseline_mean, round(fsm_mean, 6) AS fsm_mean) FROM t")
def q_test_columns(spark, sf):
    return rounded(_tested(spark, sf))


@query(f"WITH {TEST_SQL}, c AS (SELECT *, max(direction) FILTER (stratum = 'overall') OVER (PARTITION BY metric) AS o FROM t WHERE metric IN ('m1', 'm2', 'm3')) SELECT metric, stratum, CASE WHEN metric = 'm2' THEN 'diagnostic' WHEN stratum = 'overall' THEN 'confirmatory' ELSE 'exploratory' END AS family, n, wins, ties, losses, direction, stratum <> 'overall' AND direction <> o AS inverted, round(mean_diff, 6) AS mean_diff, round(rank_biserial, 6) AS rank_biserial FROM c")
def q_direction_cells(spark, sf):
    return rounded(tables.direction_cells(_tested(spark, sf), "semantic_primary", PRIMARY, ["m2"]))


@query(f"""WITH {TEST_SQL}, x AS (SELECT metric, stratum, n, mean_diff, least(1.0, (n % 97 + 1) / 1000.0) AS p, i.instrument FROM t, (VALUES ('judge'), ('human')) i(instrument) WHERE metric IN ('m1', 'm3')),
o AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY p, metric) AS r FROM x WHERE stratum = 'overall'), h AS (SELECT instrument, metric, stratum, max(least(1.0, p * (3 - r))) OVER (PARTITION BY instrument ORDER BY r ROWS UNBOUNDED PRECEDING) AS p_holm FROM o)
SELECT x.instrument, x.metric, x.stratum, n, round(p, 6) AS p, round(p_holm, 6) AS p_holm FROM x LEFT JOIN h USING (instrument, metric, stratum)""")
def q_reference_holm(spark, sf):
    """The step-down of sensitivity runs on p-values made of the pair counts."""
    table = _tested(spark, sf).where(F.col("metric").isin(PRIMARY)).withColumn("wilcoxon_p", F.least(F.lit(1.0), (F.col("n") % 97 + 1) / 1000)).withColumn("instrument", F.explode(F.array(F.lit("judge"), F.lit("human"))))
    return rounded(tables.reference_holm(table, PRIMARY).select("instrument", "metric", "stratum", "n", F.col("wilcoxon_p").alias("p"), F.col("wilcoxon_p_holm").alias("p_holm")))


HUMAN_SQL = E_SQL.replace("CASE WHEN value >= 5 THEN value END AS m1", "CASE WHEN value >= 20 THEN value END AS m1")


def _sensitivity_sql(e_sql: str, name: str) -> str:
    kept = e_sql.replace("FROM e UNPIVOT", "FROM (SELECT * FROM e WHERE NOT (m3 = 1 AND repetition = 1)) UNPIVOT").replace("metric IN (m1, m2, m3)", "metric IN (m1, m3)")
    return f"""(WITH RECURSIVE {kept}, {P_SQL}, k AS (SELECT metric, stratum, count(*) FILTER (diff > 0) AS wins, count(*) FILTER (diff < 0) AS losses, avg(diff) AS md FROM sp GROUP BY ALL),
o AS (SELECT *, row_number() OVER (ORDER BY wilcoxon_p, metric) AS place FROM sr WHERE stratum = 'overall'), h AS (SELECT metric, stratum, max(least(1.0, wilcoxon_p * (3 - place))) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS p_holm FROM o)
SELECT '{name}' AS instrument, metric, stratum, sr.n, wins, losses, round(md, 6) AS mean_diff, 'exploratory' AS family, round(wilcoxon_p, 6) AS wilcoxon_p, round(p_holm, 6) AS wilcoxon_p_holm, true AS covered, true AS possible
FROM sr JOIN k USING (metric, stratum) LEFT JOIN h USING (metric, stratum))"""


@query(f"{_sensitivity_sql(E_SQL, 'judge')} UNION ALL {_sensitivity_sql(HUMAN_SQL, 'human')}")
def q_sensitivity(spark, sf):
    """The interval and the sign-flip p of 10,000 resamples are held against what must be true of them."""
    e = e_frame(spark, sf)
    listed = e.where("m3 = 1 AND repetition = 1").select("scenario_id", "agent", "repetition")
    human = e.withColumn("m1", F.when(F.col("m1") >= 20, F.col("m1")))
    got = tables.sensitivity({"judge": e, "human": human}, listed, PRIMARY)
    p = F.col("permutation_p") * (tables.N_RESAMPLES + 1)
    checked = got.withColumn("covered", F.col("mean_diff").between(F.col("ci_low"), F.col("ci_high"))).withColumn("possible", p.between(0.5, tables.N_RESAMPLES + 1.5) & (F.abs(p - F.round(p)) < 1e-6))
    return rounded(checked.select("instrument", "metric", "stratum", "n", "wins", "losses", "mean_diff", "family", "wilcoxon_p", "wilcoxon_p_holm", "covered", "possible"))


NORMAL_SQL = f"{TEST_SQL}, v AS (SELECT metric, stratum, 1.96 * stddev_samp(diff) / sqrt(count(*)) AS half FROM pp GROUP BY ALL)"


@query(f"WITH {NORMAL_SQL} SELECT metric, i.instrument, round(mean_diff, 6) AS mean_diff, round(mean_diff - i.k * half, 6) AS ci_low, round(mean_diff + i.k * half, 6) AS ci_high, n FROM t JOIN v USING (metric, stratum), (VALUES ('judge', 1), ('human', 2)) i(instrument, k) WHERE metric IN ('m1', 'm3') AND stratum = 'overall'")
def q_paired_intervals(spark, sf):
    """Intervals of the normal form, one instrument's twice as wide, so that SQL can state them."""
    pairs = paired.with_strata(paired.pair_scenarios(paired.aggregate_to_scenarios(paired.long_metrics(e_frame(spark, sf), METRICS))))
    half = pairs.groupBy("metric", "stratum").agg((1.96 * F.stddev_samp("diff") / F.sqrt(F.count("*"))).alias("half"))
    table = _tested(spark, sf).join(half, ["metric", "stratum"])
    wide = lambda k: table.withColumn("ci_low", F.col("mean_diff") - k * F.col("half")).withColumn("ci_high", F.col("mean_diff") + k * F.col("half"))
    return rounded(tables.paired_intervals({"judge": (wide(1), "semantic_primary"), "human": (wide(2), "semantic_primary")}, PRIMARY))


FIRST_SQL = E_SQL.replace("FROM e UNPIVOT", "FROM (SELECT * FROM e WHERE repetition = 1) UNPIVOT")


def _primary_sql(e_sql: str, name: str) -> str:
    return f"""(WITH {e_sql} SELECT '{name}' AS population, CAST(CASE metric WHEN 'm1' THEN 1 ELSE 2 END AS BIGINT) AS place, metric, agent, count(*) AS n, round(avg(mean), 6) AS mean, true AS covered
FROM scores WHERE metric IN ('m1', 'm3') AND category = 'edge' GROUP BY ALL)"""


@query(f"{_primary_sql(E_SQL, 'semantic_primary')} UNION ALL {_primary_sql(FIRST_SQL, 'frozen_gate')}")
def q_primary_rows(spark, sf):
    e = e_frame(spark, sf)
    shown = (F.col("stratum") == "edge") & F.col("metric").isin(PRIMARY)  # Spark can't see through the draws that only these are taken
    described, _ = tables.analyze({"semantic_primary": e, "frozen_gate": e.where("repetition = 1")}, METRICS, PRIMARY, ["semantic_primary"], drawn=shown)
    both = tables.primary_rows(described, "semantic_primary", PRIMARY, "edge").unionByName(tables.primary_rows(described, "frozen_gate", PRIMARY, "edge"))
    return rounded(both.withColumn("covered", F.col("mean").between(F.col("ci_low"), F.col("ci_high"))).select("population", "place", "metric", "agent", "n", "mean", "covered"))


@query("""WITH c AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber % 3 = 0 THEN 'no' ELSE 'yes' END AS s, 'F' || lpad(CAST(l_partkey % 20 AS VARCHAR), 2, '0') AS f FROM lineitem),
q AS (SELECT k, coalesce(list(DISTINCT f) FILTER (s = 'yes'), []) AS said, count(*) FILTER (s = 'no') AS n, count(*) AS c FROM c GROUP BY k), x AS (SELECT *, len(list_intersect(said, ['F01', 'F02', 'F03'])) AS tp FROM q)
SELECT k, 3 AS n_required, CAST(tp AS INTEGER) AS tp, CAST(3 - tp AS INTEGER) AS fn, CAST(len(said) - tp + n AS INTEGER) AS fp, CAST(len(said) - tp AS INTEGER) AS extra_supported_fact, CAST(n AS INTEGER) AS unsupported_claim, CAST(c AS INTEGER) AS n_checkable_claims FROM x""")
def q_split_false_positives(spark, sf):
    yes = F.col("l_linenumber") % 3 != 0
    claim = F.struct(F.when(yes, "yes").otherwise("no").alias("supported_by_kb"), F.when(yes, F.format_string("F%02d", F.col("l_partkey") % 20)).alias("fact_id"))
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(claim).alias("claims"))
    return rows.select("k", scoring.split_false_positives(F.array(*map(F.lit, ("F01", "F02", "F03"))), F.col("claims")).alias("x")).select("k", "x.*")


@query("""WITH s AS (SELECT p_partkey AS k, 'i' || p_partkey % 3 AS intent, unnest(list_distinct(['F' || p_size % 9, 'F' || p_partkey % 7])) AS f FROM part), f AS (SELECT 'F' || i AS f, CASE WHEN i = 0 THEN 'general' ELSE 'i' || i % 3 END AS fi FROM (SELECT unnest(range(0, 8)) AS i))
SELECT k AS id, f AS fact FROM s LEFT JOIN f USING (f) WHERE fi IS NULL OR (fi <> 'general' AND fi <> intent)""")
def q_intent_facts(spark, sf):
    k = F.col("p_partkey")
    s = read(spark, sf, "part").select(k.alias("id"), F.concat(F.lit("i"), (k % 3).cast("string")).alias("intent"), F.array(F.concat(F.lit("F"), (F.col("p_size") % 9).cast("string")), F.concat(F.lit("F"), (k % 7).cast("string"))).alias("required_facts"))
    facts = spark.createDataFrame([(f"F{i}", "general" if i == 0 else f"i{i % 3}") for i in range(8)], "id string, intent string")
    return audit.broken_intent_facts(s, facts)


@query("""SELECT n_name AS name, 'missing_section' AS rule, 'Goal' AS value FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name, 'extra_section', 'Tone' FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_name, 'cites_fact', 'F0' || n_nationkey % 10 FROM nation WHERE n_nationkey % 5 = 0""")
def q_packages(spark, sf):
    k = F.col("n_nationkey")
    body = F.concat(F.when(k % 2 == 0, "").otherwise("## Goal\nhelp\n"), F.lit("## Steps \nask\n"), F.when(k % 3 == 0, "## Tone\nkind\n").otherwise(""), F.when(k % 5 == 0, F.concat(F.lit("see F0"), (k % 10).cast("string"), F.lit("."))).otherwise("F0 no"))
    return audit.broken_packages(read(spark, sf, "nation").select(F.col("n_name").alias("name"), body.alias("body")), ["Goal", "Steps"])


@query("SELECT doc_id, w AS word FROM documents, (VALUES ('Token'), ('license')) v(w) WHERE contains(lower(text), lower(w))")
def q_metadata_leaks(spark, sf):
    return audit.metadata_leaks(read(spark, sf, "documents"), "doc_id", "text", ["Token", "license"])


@query("""SELECT p_partkey AS k, p_partkey % 3 <> 0 AS valid, CASE WHEN p_partkey % 3 <> 0 THEN 'email=a@b.c,note=late ' || p_size ELSE 'email=a@b.c' END AS slots, p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AS held FROM part""")
def q_free_text(spark, sf):
    k = F.col("p_partkey")
    note = F.when(k % 3 != 0, F.concat(F.lit(" late "), F.col("p_size").cast("string"))).otherwise("my order is AB-1234")
    patterns = ["[a-z]{2}-[0-9]{4}"]
    slots = texts.merged_slots(F.create_map(F.lit("email"), F.lit("a@b.c")), F.create_map(F.lit("note"), note, F.lit("event"), F.lit("x")), ["note"], patterns)
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(slots), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    required = F.when(k % 2 == 0, F.array(F.lit("email"), F.lit("note")))
    return read(spark, sf, "part").select(k.alias("k"), texts.valid_free_text(note, patterns).alias("valid"), shown.alias("slots"), texts.required_held(required, slots).alias("held"))


@query("""WITH t AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'Customer' WHEN 'assistant' THEN 'Agent' ELSE role END || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY ALL),
a AS (SELECT conv_id, string_agg('Turn ' || n || ': ' || text, chr(10) ORDER BY n) AS agent_turns FROM (SELECT conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant') GROUP BY ALL)
SELECT conv_id, transcript, coalesce(agent_turns, '') AS agent_turns, CASE WHEN conv_id % 2 = 0 THEN 'x y' END AS after, 'Dear ' || conv_id || ', {ok' AS prompt, '- F01: one' || chr(10) || '- F02: two' AS facts, 'F01;F02' AS ids, 'edge_0' || conv_id % 10 || '__fsm__rep01' AS named, greatest(0, 3 - CAST(conv_id % 5 AS INTEGER)) AS over FROM t LEFT JOIN a USING (conv_id)""")
def q_renderings(spark, sf):
    turn = F.struct("turn", F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    rows = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    k = F.col("conv_id")
    fact = lambda i, t: F.struct(F.lit(i).alias("id"), F.lit(t).alias("text"))
    message = lambda t: F.struct(t.alias("content"))
    return rows.select(
        "conv_id",
        texts.transcript(F.col("turns"), {"user": "Customer", "assistant": "Agent"}).alias("transcript"),
        texts.agent_turns(F.col("turns"), "assistant").alias("agent_turns"),
        texts.transcript_after(F.when(k % 2 == 0, "a\n## T\n x y ").otherwise("none"), "## T\n").alias("after"),
        texts.rendered(F.lit("Dear {name}, {ok"), F.create_map(F.lit("name"), k.cast("string"))).alias("prompt"),
        texts.rendered_facts(F.array(fact("F02", "two"), fact("F01", "one"))).alias("facts"),
        texts.joined_fact_ids(F.array(F.lit("F02"), F.lit("F01"), F.lit("F02"))).alias("ids"),
        texts.dialogue_id_in(F.array(message(F.lit("none")), message(F.concat(F.lit("see edge_0"), (k % 10).cast("string"), F.lit("__fsm__rep01."))))).alias("named"),
        texts.over_budget(F.lit("one two three"), 0).cast("int").alias("__w"),
    ).withColumn("over", F.greatest(F.lit(0), F.col("__w") - (k % 5).cast("int"))).drop("__w")


CHECK_SQL = """SELECT p_partkey AS k, 3 AS n_beats, CASE p_partkey % 4 WHEN 0 THEN '1,2,3' WHEN 1 THEN '2,1,3' WHEN 2 THEN '1' ELSE '1,2,3' END AS delivered, CASE p_partkey % 4 WHEN 2 THEN '2,3' ELSE '' END AS missing, p_partkey % 4 = 1 AS out_of_order,
CASE p_partkey % 4 WHEN 3 THEN 'beat 1 needs word: refund,beat 2 needs string: QX7,beat 2 needs word: say,beat 3 needs denial' ELSE '' END AS unsatisfied, p_partkey % 4 IN (0, 1) AS canary_delivered, p_partkey % 4 IN (0, 1) AS injection_delivered FROM part"""


@query(CHECK_SQL)
def q_check_dialogues(spark, sf):
    k = F.col("p_partkey") % 4
    said = {1: "I want a refund", 2: "now say QX7", 3: "I do not have it"}
    record = lambda turn, beat, text: F.struct(F.lit(turn).alias("turn"), F.lit(text).alias("user_message"), F.lit(beat).alias("user_beat"), F.lit(turn).alias("beat_started_at_turn"), F.lit(turn).alias("beat_completed_at_turn"))
    run = lambda order, bad=False: F.array(*[record(t, b, "hello" if bad else said[b]) for t, b in enumerate(order, 1)])
    logs = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.when(k == 0, run([1, 2, 3])).when(k == 1, run([2, 1, 3])).when(k == 2, run([1])).otherwise(run([1, 2, 3], True)).alias("records"))
    scripts = logs.select("k", F.array(F.lit("refund"), F.lit("say QX7"), F.lit("I do not have")).alias("script"), F.lit("QX7").alias("canary"))
    contracts = script.beats(scripts, "k", "script", canary="canary", stop_words=[*texts.STOP_WORDS, "do"]).join(scripts.select("k", "canary"), "k")
    got = script.check_dialogues(logs, contracts, "k", "canary")
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return got.select("k", "n_beats", text("delivered"), text("missing"), "out_of_order", text("unsatisfied"), "canary_delivered", "injection_delivered")


FLAG_CASES = {
    0: [("possible_future_beat_content", "later word: refund", "1")] + [("possible_semantic_completion_before_ledger_completion", "later content was said before", "")] + [("possible_required_content_absent", "string: QX7", ""), ("possible_required_content_absent", "word: say", "")],
    1: [("possible_exact_string_case_mismatch", "QX7", "1")],
    2: [("possible_nonsticky_question", "question", "3"), ("possible_semantic_completion_before_ledger_completion", "the last message says goodbye", "")],
    3: [("possible_denial_detector_gap", "before it shipped", ""), ("possible_semantic_completion_before_ledger_completion", "a recovered candidate closes", ""), ("possible_semantic_completion_before_ledger_completion", "the recorded stop is a closing one", "")],
    4: [("possible_empty_stop_candidate", "agent_ended", ""), ("possible_semantic_completion_before_ledger_completion", "the goal was seen as reached", ""), ("possible_semantic_completion_before_ledger_completion", "the invalid reason names a closing status", "")],
}
FLAG_FAULTS = {0: "closes with an open beat", 1: "closes with an open beat", 2: "closes with an open beat", 3: "closes with an open beat", 4: "status and message disagree"}


def _flag_inputs(spark, sf):
    k = F.col("p_partkey") % 5
    scripts = {0: ["say QX7", "a refund"], 1: ["say QX7"], 2: ["say QX7", "refund", "is it late?"], 3: ["say QX7", "I do not"], 4: ["say QX7"]}
    said = {0: ["refund please"], 1: ["say qx7"], 2: ["say QX7", "refund", "is it?", "late bye"], 3: ["say QX7", "before it shipped"], 4: []}
    found = {3: [("hm", "gave_up")], 4: [("say QX7", "agent_ended")]}
    none = F.array().cast("array<struct<message string, status string>>")
    records = lambda i: F.array(*[F.struct(F.lit(n).alias("turn"), F.lit(m).alias("user_message")) for n, m in enumerate(said[i], 1)]).cast("array<struct<turn int, user_message string>>")
    recovered = lambda i: F.array(*[F.struct(F.lit(m).alias("message"), F.lit(s).alias("status")) for m, s in found[i]]) if i in found else none
    case = lambda f: F.coalesce(*[F.when(k == i, f(i)) for i in range(5)])
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), case(records).alias("records"), case(recovered).alias("recovered"), (k == 4).alias("goal_reached_seen"), F.when(k == 3, "gave_up").alias("stop_reason"), F.when(k == 4, "reported goal_reached").alias("invalid_reason"), case(lambda i: F.array(*map(F.lit, scripts[i]))).alias("script"), F.lit("QX7").alias("canary"))
    return rows, script.beats(rows, "k", "script", canary="canary", stop_words=[*texts.STOP_WORDS, "do"])


def _flag_sql() -> str:
    rows = ", ".join(f"({i}, '{m}', '{r}', '{t}')" for i, found in FLAG_CASES.items() for m, r, t in found)
    return f"SELECT p_partkey AS k, mechanism, requirement, turns FROM part JOIN (VALUES {rows}, (4, 'possible_required_content_absent', '', '')) v(i, mechanism, requirement, turns) ON p_partkey % 5 = i AND requirement <> ''"


@query(_flag_sql())
def q_audit_flags(spark, sf):
    logs, contracts = _flag_inputs(spark, sf)
    return flags.audit_flags(logs, contracts, "k")


@query("SELECT p_partkey AS k, fault FROM part JOIN (VALUES " + ", ".join(f"({i}, '{f}')" for i, f in FLAG_FAULTS.items()) + ") v(i, fault) ON p_partkey % 5 = i")
def q_candidate_faults(spark, sf):
    logs, contracts = _flag_inputs(spark, sf)
    rows = logs.join(contracts, "k").withColumn("state", script.fold(F.transform("records", lambda r: r["user_message"]), F.col("beats")))
    message = F.when(F.col("k") % 5 == 4, "say QX7").otherwise("hm")
    status = F.when(F.col("k") % 5 == 4, "agent_ended").otherwise("gave_up")
    return rows.select("k", flags.candidate_fault(status, message, F.col("beats"), F.col("state")).alias("fault"))
