"""Queries over the driver's tables, each with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import cells, texts
from parley.operators import agreement, audit, calls, cases, flow, joins, paired, sampling, scoring, script, stats, tables
from parley.plans.frames import E_SQL, METRICS, Q_SQL, e_frame, q_frame, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
GROUPS = ["metric", "stratum"]
SEED = 42
#: The light stemmer over a column.
STEM_SQL = """CASE WHEN ({0} LIKE '%ing' AND length({0}) >= 7) OR ({0} LIKE '%ed' AND length({0}) >= 6) THEN
CASE WHEN substr({0}, length({0}) - CASE WHEN {0} LIKE '%ing' THEN 3 ELSE 2 END, 1) = substr({0}, length({0}) - CASE WHEN {0} LIKE '%ing' THEN 4 ELSE 3 END, 1)
THEN left({0}, length({0}) - CASE WHEN {0} LIKE '%ing' THEN 4 ELSE 3 END) ELSE left({0}, length({0}) - CASE WHEN {0} LIKE '%ing' THEN 3 ELSE 2 END) END
WHEN {0} LIKE '%es' AND length({0}) >= 6 THEN left({0}, length({0}) - 2) WHEN {0} LIKE '%s' AND length({0}) >= 5 THEN left({0}, length({0}) - 1) ELSE {0} END"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, as both sides sum in their own order."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _scores(spark, sf):
    return paired.aggregate_to_scenarios(paired.long_metrics(e_frame(spark, sf), METRICS))


def _pairs(spark, sf):
    return paired.with_strata(paired.pair_scenarios(_scores(spark, sf)))


# Cells and keys.


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN cell = '' THEN NULL WHEN cell = 'True' THEN 1.0 WHEN cell = 'False' THEN 0.0 ELSE CAST(cell AS DOUBLE) END AS value
FROM (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'True' WHEN 'A' THEN '' ELSE CAST(l_quantity AS VARCHAR) END AS cell FROM lineitem)""")
def q_cast_cells(spark, sf):
    cell = F.when(F.col("l_returnflag") == "R", "True").when(F.col("l_returnflag") == "A", "").otherwise(F.col("l_quantity").cast("string"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", cells.parse_cell(cell).alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS value FROM orders")
def q_finite_cells(spark, sf):
    cell = F.when(F.col("o_orderstatus") == "P", "nan").otherwise(F.col("o_totalprice").cast("string"))
    return read(spark, sf, "orders").select("o_orderkey", cells.finite(cell).alias("value"))


@query(f"WITH {E_SQL} SELECT scenario_id, agent, repetition, printf('%s__%s__rep%02d', scenario_id, agent, repetition) AS dialogue_id FROM e")
def q_dialogue_id(spark, sf):
    e = e_frame(spark, sf)
    return e.select("scenario_id", "agent", F.col("repetition").cast("long").alias("repetition"), cells.dialogue_id(F.col("scenario_id"), F.col("agent"), F.col("repetition")).alias("dialogue_id"))


@query(f"WITH {E_SQL} SELECT event_id, scenario_id, agent, repetition FROM e")
def q_parse_id(spark, sf):
    e = e_frame(spark, sf)
    made = e.select("event_id", cells.parse_dialogue_id(cells.dialogue_id(F.col("scenario_id"), F.col("agent"), F.col("repetition"))).alias("p"))
    return made.select("event_id", "p.scenario_id", "p.agent", F.col("p.repetition").cast("long").alias("repetition"))


@query(f"WITH {E_SQL} SELECT scenario_id, agent, repetition, CAST(('0x' || substr(sha256('42:' || scenario_id || ':' || repetition), 1, 8)) AS BIGINT) & 2147483647 AS seed FROM e")
def q_seed(spark, sf):
    e = e_frame(spark, sf)
    return e.select("scenario_id", "agent", F.col("repetition").cast("long").alias("repetition"), cells.dialogue_seed(SEED, F.col("scenario_id"), F.col("repetition")).alias("seed"))


# Scenario scores and pairs.


@query(f"WITH {E_SQL} SELECT metric, category, scenario_id, agent, n_reps, round(mean, 6) AS mean, round(sd, 6) AS sd FROM scores")
def q_scenario_scores(spark, sf):
    return rounded(_scores(spark, sf))


@query(f"WITH {E_SQL} SELECT metric, category, scenario_id, round(baseline, 6) AS baseline, round(fsm, 6) AS fsm, round(diff, 6) AS diff FROM pairs")
def q_pairs(spark, sf):
    return rounded(paired.pair_scenarios(_scores(spark, sf)))


WTL_SQL = f"""WITH {E_SQL} SELECT metric, stratum, count(*) AS n, count(*) FILTER (diff > 0) AS wins, count(*) FILTER (diff = 0) AS ties, count(*) FILTER (diff < 0) AS losses,
count(*) FILTER (diff <> 0) AS n_nonzero, round(avg(diff), 6) AS mean_diff FROM sp GROUP BY ALL"""


@query(WTL_SQL)
def q_wtl_by_stratum(spark, sf):
    return rounded(paired.wins_ties_losses(_pairs(spark, sf)))


@query(f"""WITH {E_SQL}, ss AS (SELECT *, 'overall' AS stratum FROM scores UNION ALL SELECT *, category AS stratum FROM scores),
k AS (SELECT metric, stratum, scenario_id, count(DISTINCT agent) AS k FROM ss GROUP BY ALL)
SELECT metric, stratum, count(*) FILTER (k = 1) AS n_unpaired, count(*) AS n_scenarios FROM k GROUP BY ALL""")
def q_unpaired(spark, sf):
    return paired.unpaired(paired.with_strata(_scores(spark, sf)))


@query(f"""WITH {E_SQL}, se AS (SELECT *, 'overall' AS stratum FROM e UNION ALL SELECT *, category AS stratum FROM e),
k AS (SELECT stratum, scenario_id, count(*) FILTER (agent = 'baseline') AS bn, count(*) FILTER (agent = 'baseline' AND m1 IS NULL) AS ba, count(*) FILTER (agent = 'fsm') AS fn, count(*) FILTER (agent = 'fsm' AND m1 IS NULL) AS fa FROM se GROUP BY ALL)
SELECT stratum, CAST(sum(bn) AS BIGINT) AS baseline_n, CAST(sum(ba) AS BIGINT) AS baseline_na, CAST(sum(fn) AS BIGINT) AS fsm_n, CAST(sum(fa) AS BIGINT) AS fsm_na,
count(*) FILTER (bn > ba AND fn > fa) AS complete_pairs, count(*) FILTER (NOT (bn > ba AND fn > fa)) AS residual FROM k GROUP BY ALL""")
def q_missingness(spark, sf):
    return paired.missingness(paired.with_strata(e_frame(spark, sf)), "m1")


RANKS_SQL = """r AS (SELECT metric, stratum, diff, rank() OVER (PARTITION BY metric, stratum ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY metric, stratum, abs(diff)) - 1) / 2.0 AS rk,
count(*) OVER (PARTITION BY metric, stratum, abs(diff)) AS t FROM sp WHERE diff <> 0),
s AS (SELECT metric, stratum, count(*) AS n, coalesce(sum(rk) FILTER (diff > 0), 0) AS rp, coalesce(sum(rk) FILTER (diff < 0), 0) AS rm, sum(t * t - 1.0) AS tie FROM r GROUP BY ALL),
a AS (SELECT metric, stratum, count(*) AS n_pairs FROM sp GROUP BY ALL)
"""
RANK_SQL = f"WITH {E_SQL}, {RANKS_SQL}"
#: Signed-rank p: exact from the counts of rank subsets up to 50 untied differences, else the normal tail as a power series.
P_SQL = RANKS_SQL.rstrip() + """,
grown AS (SELECT 0 AS k, [1::DOUBLE] AS c UNION ALL SELECT k + 1, [coalesce(c[i], 0) + CASE WHEN i > k + 1 THEN coalesce(c[i - k - 1], 0) ELSE 0 END FOR i IN range(1, len(c) + k + 2)] FROM grown WHERE k < 50),
wz AS (SELECT metric, stratum, n_pairs, n, tie, least(rp, rm) AS w, abs(least(rp, rm) - n * (n + 1) / 4.0) / sqrt((n * (n + 1) * (2 * n + 1) - tie / 2.0) / 24.0) / sqrt(2) AS x FROM a LEFT JOIN s USING (metric, stratum)),
tail AS (SELECT metric, stratum, CASE WHEN any_value(x) > 4 THEN 0 ELSE 1 - 2 / sqrt(pi()) * sum(pow(-1, k) * pow(x, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1))) END AS p FROM wz, range(121) t(k) GROUP BY metric, stratum),
sr AS (SELECT metric, stratum, n_pairs AS n, CASE WHEN wz.n IS NULL THEN 1.0 WHEN wz.n <= 50 AND wz.n = n_pairs AND tie = 0 THEN least(1.0, 2 * list_sum(c[1:CAST(floor(w) AS INTEGER) + 1]) / pow(2, wz.n)) ELSE tail.p END AS wilcoxon_p
FROM wz LEFT JOIN tail USING (metric, stratum) LEFT JOIN grown ON grown.k = wz.n)"""


@query(RANK_SQL + "SELECT metric, stratum, n_pairs, coalesce(n, 0) AS n, round(CASE WHEN n IS NULL THEN 0.0 ELSE (rp - rm) / (rp + rm) END, 6) AS rank_biserial FROM a LEFT JOIN s USING (metric, stratum)")
def q_rank_biserial(spark, sf):
    return rounded(stats.rank_biserial(_pairs(spark, sf), GROUPS))


@query(RANK_SQL + """SELECT metric, stratum, coalesce(n, 0) AS n, coalesce(least(rp, rm), 0) AS w, round(CASE WHEN n IS NULL THEN 0.0 ELSE (least(rp, rm) - n * (n + 1) / 4.0) / sqrt((n * (n + 1) * (2 * n + 1) - tie / 2.0) / 24.0) END, 6) AS z
FROM a LEFT JOIN s USING (metric, stratum)""")
def q_wilcoxon_z(spark, sf):
    return rounded(stats.wilcoxon_z(_pairs(spark, sf), GROUPS))


@query(f"WITH RECURSIVE {E_SQL}, {P_SQL} SELECT metric, stratum, n, round(wilcoxon_p, 6) AS wilcoxon_p FROM sr")
def q_wilcoxon_p(spark, sf):
    return rounded(stats.wilcoxon_p(_pairs(spark, sf), GROUPS))


@query()
def q_permutation(spark, sf):
    return stats.permutation_p(_pairs(spark, sf), GROUPS)


@query()
def q_bootstrap(spark, sf):
    return stats.bootstrap_mean_ci(_pairs(spark, sf), GROUPS)


CTR = 1000


@query(f"""WITH {E_SQL}, p AS (SELECT metric, stratum, diff, row_number() OVER (PARTITION BY metric, stratum ORDER BY scenario_id) - 1 AS i, count(*) OVER (PARTITION BY metric, stratum) AS n FROM sp),
d AS (SELECT metric, stratum, n, b, CAST(('0x' || substr(md5('42:' || b || ':' || i), 1, 8)) AS BIGINT) % n AS i FROM p, (SELECT unnest(range({CTR})) AS b)),
m AS (SELECT metric, stratum, b, sum(p.diff) / max(d.n) AS mean FROM d JOIN p USING (metric, stratum, i) GROUP BY ALL)
SELECT metric, stratum, round(quantile_cont(mean, 0.025), 6) AS ci_low, round(quantile_cont(mean, 0.975), 6) AS ci_high FROM m GROUP BY ALL""")
def q_bootstrap_ctr(spark, sf):
    return rounded(stats.bootstrap_counter(_pairs(spark, sf), GROUPS, CTR))


@query("""WITH p AS (SELECT l_returnflag AS family, l_linestatus || l_linenumber AS metric, round(min(l_discount) + count(*) / 1000000.0, 6) / 10 AS p FROM lineitem GROUP BY ALL),
r AS (SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, metric) + 1)) AS raw FROM p)
SELECT family, metric, round(p, 6) AS p, round(max(raw) OVER (PARTITION BY family ORDER BY p, metric ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM r""")
def q_holm(spark, sf):
    p = F.round(F.min("l_discount") + F.count("*") / 1000000.0, 6) / 10
    table = read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("family"), F.concat("l_linestatus", "l_linenumber").alias("metric")).agg(p.alias("p"))
    return rounded(stats.holm(table, "p", ["family"], ["metric"]))


@query(f"""WITH {E_SQL}, ss AS (SELECT *, 'overall' AS stratum FROM scores UNION ALL SELECT *, category AS stratum FROM scores)
SELECT metric, stratum, agent, count(*) AS n, CAST(sum(n_reps) AS BIGINT) AS n_dialogues, round(avg(mean), 6) AS mean, round(stddev_samp(mean), 6) AS sd, round(quantile_cont(mean, 0.5), 6) AS median, round(avg(sd), 6) AS mean_intra_sd FROM ss GROUP BY ALL""")
def q_descriptive(spark, sf):
    return rounded(tables.descriptive(e_frame(spark, sf), METRICS))


@query()
def q_test_table(spark, sf):
    return tables.tests(e_frame(spark, sf), METRICS, "semantic_primary", METRICS, ["semantic_primary"])


@query(f"""WITH {E_SQL}, ss AS (SELECT *, 'overall' AS stratum FROM scores UNION ALL SELECT *, category AS stratum FROM scores),
k AS (SELECT metric, stratum, scenario_id, count(DISTINCT agent) AS k FROM ss GROUP BY ALL), u AS (SELECT metric, stratum, count(*) FILTER (k = 1) AS n_dropped_unpaired FROM k GROUP BY ALL)
SELECT metric, stratum, n_dropped_unpaired, count(diff) AS n, round(avg(baseline), 6) AS baseline_mean, round(avg(fsm), 6) AS fsm_mean, round(avg(diff), 6) AS mean_diff, count(*) FILTER (diff > 0) AS fsm_higher, count(*) FILTER (diff = 0) AS equal, count(*) FILTER (diff < 0) AS baseline_higher
FROM u LEFT JOIN sp USING (metric, stratum) GROUP BY ALL""")
def q_decompose(spark, sf):
    s = _scores(spark, sf)
    return rounded(cases.decompose(paired.with_strata(paired.pair_scenarios(s)), paired.with_strata(s)))


@query(f"""WITH {E_SQL}, w AS (SELECT metric, stratum, avg(diff) AS md FROM sp GROUP BY ALL), d AS (SELECT metric, stratum, CASE WHEN md > 0 THEN 'fsm' WHEN md < 0 THEN 'baseline' ELSE 'tie' END AS direction FROM w)
SELECT d.metric, d.stratum, d.direction, o.direction AS overall_direction, d.stratum <> 'overall' AND d.direction <> o.direction AS inverted FROM d JOIN d o ON o.metric = d.metric AND o.stratum = 'overall'""")
def q_direction_inversions(spark, sf):
    return cases.direction_inversions(paired.wins_ties_losses(_pairs(spark, sf))).select("metric", "stratum", "direction", "overall_direction", "inverted")


CASE_SQL = f"""WITH {E_SQL}, x AS (SELECT category, scenario_id, max(diff) FILTER (metric = 'm1') AS d1, max(diff) FILTER (metric = 'm2') AS d2, max(diff) FILTER (metric = 'm3') AS d3 FROM pairs GROUP BY ALL),
c AS (SELECT *, (coalesce(d3, 0) + coalesce(d2, 0) + coalesce(d1, 0)) / ((d1 IS NOT NULL)::INT + (d2 IS NOT NULL)::INT + (d3 IS NOT NULL)::INT) AS composite,
CASE WHEN d3 = 0 AND d2 = 0 AND d1 = 0 THEN 'tie' WHEN d3 > 0 THEN 'helped' WHEN d3 < 0 THEN 'restricted' ELSE '' END AS bucket FROM x),
k AS (SELECT *, CASE bucket WHEN 'helped' THEN -composite WHEN 'restricted' THEN composite ELSE CASE WHEN category = 'happy_path' THEN 0.0 ELSE 1.0 END END AS key FROM c),
r AS (SELECT category, scenario_id, bucket, round(composite, 6) AS composite, CASE WHEN bucket <> '' THEN row_number() OVER (PARTITION BY bucket ORDER BY key, scenario_id) END AS rank FROM k)
"""


def _ranked(spark, sf):
    return cases.rank_candidates(paired.pair_scenarios(_scores(spark, sf)), ("m3", "m2", "m1")).select("category", "scenario_id", "bucket", F.round("composite", 6).alias("composite"), F.col("rank").cast("long").alias("rank"))


@query(CASE_SQL + "SELECT * FROM r")
def q_case_rank(spark, sf):
    return _ranked(spark, sf)


@query(CASE_SQL + "SELECT * FROM r WHERE rank = 1")
def q_exemplars(spark, sf):
    return cases.exemplars(_ranked(spark, sf))


@query(f"WITH {E_SQL} SELECT scenario_id, min(repetition) AS repetition FROM (SELECT scenario_id, repetition FROM e GROUP BY ALL HAVING count(DISTINCT agent) = 2) GROUP BY ALL")
def q_common_rep(spark, sf):
    return cases.lowest_common_repetition(e_frame(spark, sf)).select("scenario_id", F.col("repetition").cast("long").alias("repetition"))


@query(f"WITH {E_SQL} SELECT scenario_id, agent, repetition, event_id FROM e WHERE NOT (m3 = 1 AND repetition = 1)")
def q_drop_keys(spark, sf):
    e, keys = e_frame(spark, sf), ["scenario_id", "agent", "repetition"]
    kept = paired.without_keys(e, e.where("m3 = 1 AND repetition = 1").select(*keys), keys, strict=False)
    return kept.select("scenario_id", "agent", F.col("repetition").cast("long").alias("repetition"), "event_id")


@query(f"""WITH {E_SQL}, se AS (SELECT *, 'overall' AS stratum FROM e UNION ALL SELECT *, category AS stratum FROM e)
SELECT s.stratum, a.agent, count(se.event_id) AS total, count(*) FILTER (m3 = 1 AND repetition = 1) AS listed FROM (VALUES ('overall'), ('happy_path'), ('edge'), ('adversarial')) s(stratum), (VALUES ('baseline'), ('fsm')) a(agent) LEFT JOIN se ON se.stratum = s.stratum AND se.agent = a.agent GROUP BY ALL""")
def q_counts(spark, sf):
    e, keys = e_frame(spark, sf), ["scenario_id", "agent", "repetition"]
    return paired.key_counts(e, e.where("m3 = 1 AND repetition = 1").select(*keys), keys)


# Latency, callers, outliers.


@query("""WITH f AS (SELECT event_type, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY ALL),
g AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM f)
SELECT event_type, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(low, 6) AS low, round(high, 6) AS high, 'computed' AS status, (SELECT count(*) FROM events e WHERE e.event_type = g.event_type AND (value < low OR value > high)) AS n_outliers FROM g""")
def q_tukey(spark, sf):
    ev = read(spark, sf, "events")
    fences = audit.tukey(ev, ["event_type"], "value", "event_id")
    out = audit.outliers(ev, fences, ["event_type"], "value").groupBy("event_type").agg(F.count("*").alias("n_outliers"))
    return rounded(fences.join(out, "event_type", "left").withColumn("n_outliers", F.coalesce("n_outliers", F.lit(0))))


@query("SELECT event_type, min(event_id) AS first_seen, count(*) AS n, round(avg(value), 6) AS mean_s, quantile_disc(value, 0.95) AS p95_s, round(avg(length(props)), 6) AS mean_tokens, round(sum(length(props)) / sum(value), 6) AS tokens_per_s FROM events GROUP BY ALL")
def q_nearest_rank(spark, sf):
    ev = read(spark, sf, "events").withColumn("tokens", F.length("props"))
    return rounded(calls.role_stats(ev, "event_type", "value", "tokens", "event_id"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (user_id % 2 = 0) AS n_cached, round(avg(length(props)), 6) AS mean_prompt_tokens, round(avg(user_id), 6) AS mean_output_tokens, round(avg(value) FILTER (user_id % 2 <> 0), 6) AS mean_latency_s FROM events GROUP BY ALL""")
def q_caller_stats(spark, sf):
    ev = read(spark, sf, "events").withColumn("cached", F.col("user_id") % 2 == 0).withColumn("chars", F.length("props"))
    return rounded(calls.caller_stats(ev, "event_type", "chars", "user_id", "value", "cached"))


@query("SELECT role, count(*) AS n, round(avg(length(text)), 6) AS mean_tokens, max(length(text)) AS max_tokens, count(*) FILTER (length(text) > 200) AS over_budget, round(min(length(text) / (1.0 + turn)), 6) AS min_per_char, round(max(length(text) / (1.0 + turn)), 6) AS max_per_char FROM conversations GROUP BY ALL")
def q_prompt_budget(spark, sf):
    c = read(spark, sf, "conversations").withColumn("tokens", F.length("text").cast("long"))
    return rounded(calls.prompt_summary(c, "role", "tokens", 1.0 + F.col("turn"), 200))


# Dialogues and flow.


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def q_transcript(spark, sf):
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))))
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"), F.count("*").alias("n_turns"))


@query("SELECT conv_id, count(*) FILTER (role = 'assistant') AS n_turns, count(*) AS n_messages FROM conversations GROUP BY conv_id")
def q_dialogue_turns(spark, sf):
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("n_turns"), F.count("*").alias("n_messages"))


@query(f"""WITH {Q_SQL}, s AS (SELECT *, lag(stage) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM q)
SELECT user_id, count(*) FILTER (prev <> stage) AS n_stage_transitions, count(*) FILTER (prev = stage) AS n_self_loops, arg_max(stage, (ts, event_id)) AS last_stage FROM s GROUP BY ALL""")
def q_self_loops(spark, sf):
    return flow.step_counts(q_frame(spark, sf), ["user_id"], ["ts", "event_id"], "stage")


EDGES = [("go", "view", "click"), ("buy", "click", "purchase"), ("end", "purchase", "logout"), ("in", "login", "view"), ("out", "*", "login")]
EDGES_SQL = "g AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in EDGES) + ") t(event, source, dest)), one AS (SELECT DISTINCT source, dest FROM g WHERE source <> '*'), two AS (SELECT source, dest FROM one UNION SELECT a.source, b.dest FROM one a JOIN one b ON a.dest = b.source)"


def _edges(spark):
    return spark.createDataFrame(EDGES, "event string, source string, dest string")


@query(f"""WITH {Q_SQL}, {EDGES_SQL}, s AS (SELECT user_id, coalesce(lag(stage) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'login') AS source, stage AS dest FROM q),
v AS (SELECT user_id, s.source = s.dest OR EXISTS (SELECT 1 FROM g WHERE g.source = '*' AND g.dest = s.dest) OR EXISTS (SELECT 1 FROM two WHERE two.source = s.source AND two.dest = s.dest) AS ok FROM s)
SELECT user_id, bool_and(ok) AS valid_flow_path, count(*) FILTER (NOT ok) AS n_invalid_steps FROM v GROUP BY ALL""")
def q_flow_valid(spark, sf):
    return flow.valid_paths(q_frame(spark, sf), ["user_id"], ["ts", "event_id"], "stage", _edges(spark), "login")


@query("""WITH n AS (SELECT DISTINCT n_regionkey AS r, n_nationkey AS k FROM nation) SELECT 'n' || a.k AS source, 'n' || b.k AS dest, true AS from_any FROM n a JOIN n b ON a.k <> b.k AND b.k = 7""")
def q_wildcards(spark, sf):
    states = read(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("state")).distinct()
    edges = spark.createDataFrame([("any", "*", "n7")], "event string, source string, dest string")
    return flow.expand_wildcards(edges, states).select("source", "dest", "from_any")


# Texts.


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def q_contains_join(spark, sf):
    return joins.contains_join(read(spark, sf, "benchmark"), "item_id", "text", read(spark, sf, "documents"), "doc_id", "text")


@query("""WITH h AS (SELECT b.item_id, count(*) AS hits, min(d.doc_id) AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY ALL)
SELECT b.item_id, coalesce(hits, 0) AS hits, CASE WHEN hits = 1 THEN doc END AS doc_id, CASE WHEN hits = 1 THEN 'matched' ELSE 'unmatched' END AS status FROM benchmark b LEFT JOIN h USING (item_id)""")
def q_unique_attribution(spark, sf):
    needles = read(spark, sf, "benchmark")
    pairs = joins.contains_join(needles, "item_id", "text", read(spark, sf, "documents"), "doc_id", "text")
    return joins.unique_attribution(pairs, needles, "item_id", "doc_id")


@query("SELECT doc_id, regexp_matches(text, '[0-9]{4}-[0-9]{4}') OR regexp_matches(text, '[a-z]+@[a-z0-9]+') AS leak FROM documents")
def q_leak_regex(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.col("text").rlike("[0-9]{4}-[0-9]{4}|[a-z]+@[a-z0-9]+").alias("leak"))


@query("SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS normalized FROM conversations")
def q_normalise(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", texts.normalized(F.col("text")).alias("normalized"))


@query("SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?') AS w FROM conversations)")
def q_tokens(spark, sf):
    w = texts.words(F.col("text"))
    return read(spark, sf, "conversations").select("conv_id", "turn", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


@query("SELECT conv_id, turn, regexp_extract(text, '(?i)[a-z]+tion', 0) AS first_slot, regexp_extract(text, '(?i)[a-z]{12,}', 0) AS short_slot FROM conversations")
def q_slots(spark, sf):
    got = texts.slots(F.col("text"), {"a": "[a-z]+tion", "b": "[a-z]{12,}"})
    return read(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(F.try_element_at(got, F.lit("a")), F.lit("")).alias("first_slot"), F.coalesce(F.try_element_at(got, F.lit("b")), F.lit("")).alias("short_slot"))


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations),
u AS (SELECT w, CASE WHEN w LIKE '%ing' AND length(w) >= 7 THEN left(w, length(w) - 3) WHEN w LIKE '%ed' AND length(w) >= 6 THEN left(w, length(w) - 2) WHEN w LIKE '%es' AND length(w) >= 6 THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND length(w) >= 5 THEN left(w, length(w) - 1) ELSE w END AS s,
(w LIKE '%ing' AND length(w) >= 7) OR (w LIKE '%ed' AND length(w) >= 6 AND NOT w LIKE '%ing') AS cut FROM w)
SELECT w AS word, CASE WHEN cut AND right(s, 1) = substr(s, length(s) - 1, 1) THEN left(s, length(s) - 1) ELSE s END AS stem FROM u""")
def q_stems(spark, sf):
    w = read(spark, sf, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("word")).distinct()
    return w.select("word", texts.stem(F.col("word")).alias("stem"))


# Agreement.


@query("SELECT 'all' AS grp, count(*) AS n, round(avg(CAST(quality = toxic AS DOUBLE)), 6) AS agreement FROM labels")
def q_percent_agreement(spark, sf):
    return rounded(agreement.percent_agreement(read(spark, sf, "labels").withColumn("grp", F.lit("all")), "quality", "toxic", ["grp"]))


@query("""WITH g AS (SELECT CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS grp, quality AS a, toxic AS b FROM labels JOIN documents USING (doc_id)),
c AS (SELECT grp, count(*) AS n, sum((a = b)::INT) / count(*) AS po, (sum(a) * sum(b) + sum(1 - a) * sum(1 - b)) / (count(*) * count(*)) AS pe FROM g GROUP BY grp) SELECT grp, n, round((po - pe) / (1 - pe), 6) AS kappa FROM c""")
def q_kappa(spark, sf):
    rows = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id").withColumn("grp", F.when(F.col("lang") == "en", "en").otherwise("other"))
    return rounded(agreement.cohen_kappa(rows, "quality", "toxic", ["grp"]))


@query("""WITH g AS (SELECT least(n_chars // 1000, 3) AS a, least(n_chars // 1500, 3) AS b FROM documents), c AS (SELECT a, b, count(*) AS n FROM g GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c),
r AS (SELECT a, sum(n) AS x FROM c GROUP BY a), k AS (SELECT b, sum(n) AS y FROM c GROUP BY b)
SELECT 'all' AS grp, CAST(max(t.t) AS BIGINT) AS n, round(1 - (SELECT sum(n * (a - b) * (a - b)) / max(t.t) / 9.0 FROM c, t) / (SELECT sum(x * y * (a - b) * (a - b)) / max(t.t * t.t) / 9.0 FROM r, k, t), 6) AS weighted_kappa FROM t""")
def q_weighted_kappa(spark, sf):
    d = read(spark, sf, "documents").select(F.lit("all").alias("grp"), F.least(F.expr("n_chars div 1000"), F.lit(3)).cast("string").alias("a"), F.least(F.expr("n_chars div 1500"), F.lit(3)).cast("string").alias("b"))
    return rounded(agreement.weighted_kappa(d, "a", "b", ["grp"], ["0", "1", "2", "3"]))


SETS_SQL = """s AS (SELECT l_orderkey, o_orderpriority, list(DISTINCT l_partkey % 20) FILTER (l_linenumber <= 4) AS h, list(DISTINCT l_suppkey % 20) FILTER (l_linenumber >= 2) AS j, count(*) FILTER (l_returnflag = 'R') AS n_no, count(*) FILTER (l_returnflag <> 'R') AS n_yes
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), x AS (SELECT l_orderkey, o_orderpriority, coalesce(h, []) AS h, coalesce(j, []) AS j, n_no, n_yes FROM s)"""


def _sets(spark, sf):
    rows = read(spark, sf, "lineitem").join(read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    return rows.groupBy("l_orderkey", "o_orderpriority").agg(
        F.collect_set(F.when(F.col("l_linenumber") <= 4, F.col("l_partkey") % 20)).alias("h"), F.collect_set(F.when(F.col("l_linenumber") >= 2, F.col("l_suppkey") % 20)).alias("j"), F.count_if(F.col("l_returnflag") == "R").alias("n_no"), F.count_if(F.col("l_returnflag") != "R").alias("n_yes")
    )


@query(f"""WITH {SETS_SQL}, a AS (SELECT o_orderpriority, count(*) AS n, CAST(sum(len(list_intersect(h, j))) AS BIGINT) AS tp, CAST(sum(len(j) - len(list_intersect(h, j))) AS BIGINT) AS fp, CAST(sum(len(h) - len(list_intersect(h, j))) AS BIGINT) AS fn,
avg((list_sort(h) = list_sort(j))::INT) AS exact FROM x GROUP BY ALL)
SELECT o_orderpriority, n, tp, fp, fn, round(exact, 6) AS exact, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM a""")
def q_set_agreement(spark, sf):
    return rounded(agreement.set_agreement(_sets(spark, sf), "h", "j", ["o_orderpriority"]))


@query(f"""WITH {SETS_SQL}, t AS (SELECT l_orderkey, len(list_intersect(h, j)) AS tp, len(j) - len(list_intersect(h, j)) + n_no AS fp, len(h) - len(list_intersect(h, j)) AS fn, n_no, n_yes FROM x),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM t)
SELECT l_orderkey, CAST(tp AS INTEGER) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS INTEGER) AS fn, round(p, 6) AS fact_precision, round(r, 6) AS fact_recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS fact_f1, round(n_yes / (n_yes + n_no), 6) AS claim_support FROM p""")
def q_fact_scores(spark, sf):
    s = _sets(spark, sf).select("l_orderkey", scoring.fact_scores(F.col("h"), F.col("j"), F.col("n_no"), F.col("n_yes")).alias("f"))
    return rounded(s.select("l_orderkey", "f.tp", "f.fp", "f.fn", "f.fact_precision", "f.fact_recall", "f.fact_f1", "f.claim_support"))


@query("SELECT d.doc_id, 'label' AS field, CAST(quality AS VARCHAR) AS original, CAST(toxic AS VARCHAR) AS changed FROM labels d WHERE quality <> toxic")
def q_changed_cases(spark, sf):
    lab = read(spark, sf, "labels")
    return agreement.changed_cases(lab.select("doc_id", F.col("quality").alias("label")), lab.select("doc_id", F.col("toxic").alias("label")), ["doc_id"], ["label"])


# Audit.


def _audit_tables(spark, sf):
    """Jobs of all kinds: missing, empty, scored pairs, unscored, three classes of failures and unexplained ones, and rows that break rules."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("f"))
    k = (F.col("id") % 4).cast("int")
    pick = lambda *values: F.when(F.col("f"), F.element_at(F.array(*[F.lit(v) for v in values]), k + 1))
    logs = o.where("id % 50 <> 3").select("id", F.when(F.col("f"), "failed").otherwise("ok").alias("status"), F.when(F.col("id") % 50 == 4, 0).otherwise(5).alias("n_records"), pick("simulation", "instrument", "instrument", "other").alias("failure_kind"), pick("max_turns_with_incomplete_beat", "invalid_candidate_retry_exhausted", "invalid_candidate_retry_exhausted", "x").alias("failure_reason"))
    scored = o.where("NOT f AND id % 50 NOT IN (3, 4) AND id % 7 <> 0").select("id")
    frozen = scored.unionByName(o.where("f AND id % 40 = 5").select("id"))
    sidecar = scored.unionByName(o.where("f AND (id % 4 = 1 AND id % 40 <> 13 OR id % 40 = 14)").select("id")).unionByName(spark.createDataFrame([(-1,), (-1,)], "id long"))
    unscored = o.where("NOT f AND id % 50 NOT IN (3, 4) AND id % 14 = 0").select("id", F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("reason"))
    return o.select("id"), logs, frozen, sidecar, unscored, o.where("f AND id % 4 = 1").select("id")


AUDIT_SQL = """b AS (SELECT o_orderkey AS id, o_orderkey % 4 AS k, CASE WHEN o_orderkey % 50 = 3 THEN 'missing' WHEN o_orderkey % 50 = 4 THEN 'empty' WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'ok' END AS ex,
o_orderstatus <> 'F' AND o_orderkey % 50 NOT IN (3, 4) AND o_orderkey % 7 <> 0 AS scored, o_orderstatus = 'F' AS f FROM orders),
c AS (SELECT *, CASE WHEN ex = 'failed' THEN CASE k WHEN 0 THEN 'max_turns_with_incomplete_beat' WHEN 1 THEN 'instrument_contract_false_positive' WHEN 2 THEN 'instrument_true_failure' END END AS fc,
scored OR (f AND id % 40 = 5) AS frozen, scored OR (f AND (k = 1 AND id % 40 <> 13 OR id % 40 = 14)) AS sidecar, ex = 'ok' AND id % 14 = 0 AS unscored FROM b),
f AS (SELECT id, ex AS execution_status, fc AS failure_class, CASE WHEN unscored THEN 'excluded_unscored' WHEN ex = 'ok' AND scored THEN 'included_semantic' WHEN k = 1 AND fc IS NOT NULL AND sidecar THEN 'included_semantic' WHEN fc IS NOT NULL AND k <> 1 THEN 'excluded_failure' END AS primary_status,
CASE WHEN unscored THEN 'excluded_unscored' WHEN ex = 'ok' AND scored THEN 'included_frozen' WHEN fc IS NOT NULL THEN 'excluded_failure' END AS frozen_status, CASE WHEN unscored THEN 'r' || id % 3 END AS unscored_reason,
list_filter([CASE WHEN ex = 'missing' THEN 'missing_dialogue' END, CASE WHEN ex = 'empty' THEN 'empty_dialogue' END, CASE WHEN ex = 'failed' AND fc IS NULL THEN 'unexplained_failure' END, CASE WHEN ex = 'ok' AND NOT unscored AND NOT scored THEN 'incomplete_pair' END,
CASE WHEN k = 1 AND fc IS NOT NULL AND NOT sidecar THEN 'false_positive_without_sidecar_row' END, CASE WHEN k = 1 AND fc IS NOT NULL AND sidecar AND frozen THEN 'false_positive_in_frozen_rows' END, CASE WHEN k <> 1 AND fc IS NOT NULL AND (sidecar OR frozen) THEN 'excluded_failure_with_row' END], lambda x: x IS NOT NULL) AS anomalies FROM c)"""


@query(f"WITH {AUDIT_SQL} SELECT * REPLACE (array_to_string(anomalies, ',') AS anomalies) FROM f")
def q_census(spark, sf):
    return audit.census(*_audit_tables(spark, sf), "id").withColumn("anomalies", F.array_join("anomalies", ","))


@query(f"WITH {AUDIT_SQL} SELECT unnest(anomalies) AS rule, CAST(id AS VARCHAR) AS id FROM f UNION ALL SELECT unnest(['duplicate_sidecar_row', 'orphan_sidecar_row']), '-1'")
def q_anomalies(spark, sf):
    jobs, logs, frozen, sidecar, unscored, listed = _audit_tables(spark, sf)
    return audit.anomalies(jobs, frozen, sidecar, audit.census(jobs, logs, frozen, sidecar, unscored, listed, "id"), "id")


@query(f"""WITH {AUDIT_SQL}, v AS (SELECT o_orderpriority AS agent, o_totalprice AS v, 'semantic' AS population FROM orders JOIN f ON id = o_orderkey WHERE primary_status = 'included_semantic' UNION ALL SELECT o_orderpriority, o_totalprice, 'frozen' FROM orders JOIN f ON id = o_orderkey WHERE frozen_status = 'included_frozen'),
q AS (SELECT population, agent, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY ALL)
SELECT population, agent, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(q1 - 1.5 * (q3 - q1), 6) AS low, round(q3 + 1.5 * (q3 - q1), 6) AS high, 'computed' AS status FROM q""")
def q_latency_groups(spark, sf):
    audited = audit.census(*_audit_tables(spark, sf), "id")
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("agent"), F.col("o_totalprice").alias("v"))
    both = audit.latency_groups(rows, audited, "semantic", "id", "agent", "v").unionByName(audit.latency_groups(rows, audited, "frozen", "id", "agent", "v"))
    return rounded(both)


@query("SELECT coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, '') AS failure_kind, o_orderpriority AS failure_reason, count(*) AS n FROM orders GROUP BY ALL")
def q_failure_census(spark, sf):
    return audit.failure_census(read(spark, sf, "orders").withColumn("kind", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))), "kind", "o_orderpriority")


@query("SELECT c.c_custkey, c.c_nationkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = c.c_nationkey AND s.s_nationkey < 15)")
def q_broken_keys(spark, sf):
    """Customers of nations without a supplier among the first fifteen nations: some there are at every size."""
    dim = read(spark, sf, "supplier").where("s_nationkey < 15")
    return audit.broken_foreign_key(read(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", dim, "s_nationkey").select("c_custkey", "c_nationkey")


# Sampling and jobs.


@query("""WITH u AS (SELECT o_orderpriority AS grp, o_custkey AS unit, count(*) AS cap FROM orders GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5('42|' || unit)) AS pos FROM u),
s AS (SELECT grp, unit, pos, unnest(range(1, least(cap, 50) + 1)) AS slot FROM p), d AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY slot, pos) AS r FROM s)
SELECT grp, unit, count(*) AS allocated FROM d WHERE r <= 50 GROUP BY ALL""")
def q_quota(spark, sf):
    units = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("unit")).agg(F.count("*").alias("cap"))
    return sampling.round_robin(units, ["grp"], "unit", "cap", 50, SEED)


@query("SELECT s_name AS scenario_id, CAST(r AS INTEGER) AS repetition, CAST(o AS INTEGER) AS agent_order, agent FROM supplier, (SELECT unnest(range(1, 4)) AS r), (VALUES (0, 'baseline'), (1, 'fsm')) a(o, agent)")
def q_jobs(spark, sf):
    return sampling.jobs(read(spark, sf, "supplier").select(F.col("s_name").alias("scenario_id")), ["baseline", "fsm"], 3)


# Folds.


BEATS = ["There", "hation", "nesses"]


@query(f"""WITH m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS t, text FROM conversations), u AS (SELECT conv_id, t, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?')) AS w FROM m),
s AS (SELECT conv_id, t, w, {STEM_SQL.format("w")} AS s FROM u),
h AS (SELECT DISTINCT conv_id, t, beat FROM s JOIN (VALUES (1, 'there', 'there'), (2, 'hation', 'hation'), (3, 'nesses', 'ness')) k(beat, kw, ks) ON w = kw OR s = ks OR (least(length(s), length(ks)) >= 4 AND left(s, least(length(s), length(ks))) = left(ks, least(length(s), length(ks))))),
c AS (SELECT DISTINCT conv_id FROM conversations), b1 AS (SELECT c.conv_id, min(h.t) AS t1 FROM c LEFT JOIN h ON h.conv_id = c.conv_id AND beat = 1 GROUP BY ALL),
b2 AS (SELECT b1.conv_id, t1, min(h.t) AS t2 FROM b1 LEFT JOIN h ON h.conv_id = b1.conv_id AND beat = 2 AND h.t > t1 GROUP BY ALL), b3 AS (SELECT b2.conv_id, t1, t2, min(h.t) AS t3 FROM b2 LEFT JOIN h ON h.conv_id = b2.conv_id AND beat = 3 AND h.t > t2 GROUP BY ALL)
SELECT conv_id, CAST((t1 IS NOT NULL)::INT + (t2 IS NOT NULL)::INT + (t3 IS NOT NULL)::INT AS INTEGER) AS completed, concat_ws(',', t1, t2, t3) AS completed_at, t3 IS NOT NULL AS complete,
CASE WHEN t1 IS NULL THEN 'there' WHEN t2 IS NULL THEN 'hation' WHEN t3 IS NULL THEN 'nesses' END AS open_keywords FROM b3""")
def q_beat_fold(spark, sf):
    c = read(spark, sf, "conversations")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    rows = c.groupBy("conv_id").agg(in_order.alias("messages")).withColumn("script", F.array(*map(F.lit, BEATS)))
    contracts = script.beats(rows, "conv_id", "script")
    folded = rows.join(contracts, "conv_id").select("conv_id", "beats", script.fold(F.col("messages"), F.col("beats")).alias("f"))
    done = F.filter("f.log", lambda x: x["beat"].isNotNull())
    open_ = script.diagnostics(F.col("f"), F.col("beats"))["keywords_missing"]
    return folded.select("conv_id", F.col("f.index").alias("completed"), F.array_join(F.transform(done, lambda x: x["completed"].cast("string")), ",").alias("completed_at"), (F.col("f.index") >= F.size("beats")).alias("complete"), F.array_join(open_, ",").alias("open_keywords"))


@query("""WITH k AS (SELECT supp, flag, avg(q) AS mean FROM (SELECT l_suppkey AS supp, l_returnflag AS flag, l_quantity AS q FROM lineitem WHERE l_returnflag IN ('A', 'R')) GROUP BY ALL)
SELECT a.supp AS l_suppkey, round(a.mean, 6) AS a_mean, round(r.mean, 6) AS r_mean, round(r.mean - a.mean, 6) AS diff FROM k a JOIN k r ON a.supp = r.supp AND a.flag = 'A' AND r.flag = 'R'""")
def q_paired_lineitem(spark, sf):
    rows = read(spark, sf, "lineitem").where(F.col("l_returnflag").isin("A", "R")).select(F.lit("q").alias("metric"), F.col("l_suppkey").alias("scenario_id"), F.col("l_returnflag").alias("agent"), F.col("l_quantity").alias("value"))
    pairs = paired.pair_scenarios(paired.aggregate_to_scenarios(rows, ("metric",)), ("A", "R"), ("metric",))
    return rounded(pairs.select(F.col("scenario_id").alias("l_suppkey"), F.col("A").alias("a_mean"), F.col("R").alias("r_mean"), "diff"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptive statistics beside wins, ties and losses."""
    return q_descriptive(spark, sf_dir).join(q_wtl_by_stratum(spark, sf_dir).withColumnRenamed("n", "n_pairs"), GROUPS)


from parley.plans import analysis, files, integrity, loads, reports, rules  # noqa: E402, F401  (their queries register themselves)
