"""Queries of inclusion, provenance, agreement of instruments, sheets, graphs and recovery over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import cells, texts
from parley.operators import agreement, checks, flow, inclusion, provenance, replay, validation
from parley.plans.frames import read
from parley.plans.registry import EDGES_SQL, _edges, query, rounded
from parley.sources.scratch import scratch

KIND, REASON = "instrument", "invalid_candidate_retry_exhausted"

# Inclusion: orders are the run's dialogues, returned lines select some of them.

LOG_SQL = """logs AS (SELECT printf('edge_%06d__%s__rep%02d', o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'baseline' ELSE 'fsm' END, o_custkey % 3 + 1) AS dialogue_id, o_orderkey AS k,
    CASE WHEN o_orderstatus = 'O' THEN 'ok' ELSE 'failed' END AS status, CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderpriority < '4' THEN 'instrument' ELSE 'simulation' END AS failure_kind,
    CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderpriority < '3' THEN 'invalid_candidate_retry_exhausted' ELSE 'max_turns_with_incomplete_beat' END AS failure_reason FROM orders)"""


def _logs(spark, sf) -> DataFrame:
    o = read(spark, sf, "orders")
    agent = F.when(F.col("o_custkey") % 2 == 0, "baseline").otherwise("fsm")
    ended = F.col("o_orderstatus") == "O"
    return o.select(
        cells.dialogue_id(F.format_string("edge_%06d", "o_orderkey"), agent, (F.col("o_custkey") % 3 + 1).cast("int")).alias("dialogue_id"), F.col("o_orderkey").alias("k"),
        F.when(ended, "ok").otherwise("failed").alias("status"), F.when(~ended, F.when(F.col("o_orderpriority") < "4", KIND).otherwise("simulation")).alias("failure_kind"),
        F.when(~ended, F.when(F.col("o_orderpriority") < "3", REASON).otherwise("max_turns_with_incomplete_beat")).alias("failure_reason"),
    )


def _selection(spark, sf, logs: DataFrame) -> DataFrame:
    """Ids of returned lines, of lines of no order, and of parts, which are no dialogues."""
    lines = read(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    known = lines.join(logs.select("k", "dialogue_id"), "k").select("dialogue_id", "place")
    absent = read(spark, sf, "supplier").select(cells.dialogue_id(F.format_string("edge_x%06d", "s_suppkey"), F.lit("fsm"), F.lit(1)).alias("dialogue_id"), (-F.col("s_suppkey") - 1).alias("place"))
    malformed = read(spark, sf, "part").select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("dialogue_id"), (F.col("p_partkey") + 10**9).alias("place"))
    return known.unionByName(absent).unionByName(malformed)


CHECKED_SQL = f"""{LOG_SQL}, sel AS (SELECT dialogue_id FROM lineitem JOIN logs ON l_orderkey = k WHERE l_returnflag = 'R' UNION ALL SELECT printf('edge_x%06d__fsm__rep01', s_suppkey) FROM supplier UNION ALL SELECT 'part ' || p_partkey FROM part),
    ids AS (SELECT dialogue_id, count(*) AS n FROM sel GROUP BY dialogue_id), r AS (SELECT ids.*, l.k, status, failure_kind, failure_reason, regexp_full_match(dialogue_id, '.*__(baseline|fsm)__rep[0-9]{{2,}}') AS formed,
    coalesce(failure_kind = 'instrument' AND failure_reason = 'invalid_candidate_retry_exhausted', false) AS fit FROM ids LEFT JOIN logs l USING (dialogue_id))"""


@query(f"""WITH {CHECKED_SQL} SELECT dialogue_id, 'malformed_id' AS rule, dialogue_id AS found FROM r WHERE NOT formed UNION ALL SELECT dialogue_id, 'repeated_id', CAST(n AS VARCHAR) FROM r WHERE n > 1
UNION ALL SELECT dialogue_id, 'not_in_run', dialogue_id FROM r WHERE formed AND k IS NULL UNION ALL SELECT dialogue_id, 'status', status FROM r WHERE k IS NOT NULL AND status <> 'failed'
UNION ALL SELECT dialogue_id, 'failure_class', coalesce(failure_kind, 'none') || '/' || coalesce(failure_reason, 'none') FROM r WHERE k IS NOT NULL AND NOT fit UNION ALL SELECT dialogue_id, 'not_discovered', dialogue_id FROM r WHERE k IS NOT NULL AND NOT fit""")
def q_inclusion_lock(spark, sf):
    """Every refusal of a selection of failed dialogues."""
    logs = _logs(spark, sf)
    _, candidates = inclusion.discover(logs, KIND, REASON)
    checked, _ = inclusion.check_selection(_selection(spark, sf, logs), logs, candidates, KIND, REASON)
    return inclusion.refused(checked)


@query(f"WITH {LOG_SQL} SELECT dialogue_id, failure_kind, failure_reason FROM logs WHERE status = 'failed' AND failure_kind = 'instrument' AND failure_reason = 'invalid_candidate_retry_exhausted'")
def q_locked_selection(spark, sf):
    """A selection that nothing speaks against, frozen twice and read again."""
    logs = _logs(spark, sf)
    _, candidates = inclusion.discover(logs, KIND, REASON)
    chosen = candidates.select("dialogue_id", F.col("k").alias("place"))
    path = scratch(spark, "lock")
    first = inclusion.lock(chosen, logs, candidates, KIND, REASON, path)
    checks.require(inclusion.lock(chosen.repartition(3), logs, candidates, KIND, REASON, path) == first, "a lock depends on the order of its rows")
    return spark.read.parquet(path)


@query(f"WITH {LOG_SQL} SELECT failure_kind, failure_reason, count(*) AS n, failure_kind = 'instrument' AND failure_reason = 'invalid_candidate_retry_exhausted' AS target FROM logs WHERE status = 'failed' GROUP BY ALL")
def q_discovery(spark, sf):
    return inclusion.discover(_logs(spark, sf), KIND, REASON)[0]


@query(f"""WITH {LOG_SQL}, p AS (SELECT *, failure_kind = 'instrument' AND failure_reason = 'invalid_candidate_retry_exhausted' AS listed FROM logs WHERE status = 'ok' OR (failure_kind = 'instrument' AND failure_reason = 'invalid_candidate_retry_exhausted'))
SELECT dialogue_id, status AS runtime_status, failure_kind, failure_reason, CASE WHEN listed THEN 'contract_false_positive' END AS adjudication, CAST(NULL AS DATE) AS adjudication_date, CASE WHEN listed THEN 'listed.json' ELSE 'status=ok' END AS inclusion_source FROM p""")
def q_sidecar_provenance(spark, sf):
    return _provenance(spark, sf)


def _provenance(spark, sf) -> DataFrame:
    logs = _logs(spark, sf)
    _, listed = inclusion.discover(logs, KIND, REASON)
    scored = logs.where("status = 'ok'").select("dialogue_id").unionByName(listed.select("dialogue_id"))
    return inclusion.with_provenance(scored, logs, listed, "contract_false_positive", "listed.json")


@query(f"""WITH {LOG_SQL}, p AS (SELECT CASE WHEN status = 'ok' THEN 'status=ok' ELSE 'listed.json' END AS inclusion_source, status FROM logs WHERE status = 'ok' OR (failure_kind = 'instrument' AND failure_reason = 'invalid_candidate_retry_exhausted'))
SELECT inclusion_source, count(*) AS n_scored, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status <> 'ok') AS n_included_failed FROM p GROUP BY ALL""")
def q_inclusion_record(spark, sf):
    return inclusion.inclusion_record(_provenance(spark, sf))


@query(f"""WITH {LOG_SQL}, c AS (SELECT count(*) AS jobs, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok' AND failure_kind = 'instrument' AND failure_reason LIKE 'inv%' AND k > 50) AS fp,
    count(*) FILTER (status <> 'ok' AND failure_kind = 'instrument' AND failure_reason LIKE 'inv%' AND k <= 50) AS tif, count(*) FILTER (status <> 'ok' AND failure_kind = 'simulation' AND failure_reason LIKE 'max%') AS mt FROM logs)
SELECT * FROM (SELECT 'jobs' AS "count", 360 AS expected, jobs AS found FROM c UNION ALL SELECT 'ok', 180, ok FROM c UNION ALL SELECT 'true_failures', 3, tif FROM c UNION ALL SELECT 'unscored', 0, 0 FROM c UNION ALL SELECT 'parts_of_jobs', jobs, ok + fp + mt + tif FROM c) WHERE expected <> found""")
def q_census_faults(spark, sf):
    """Where the run's accounting is not the one that was frozen."""
    logs = _logs(spark, sf)
    kind = cells.failure_class(F.col("failure_kind"), F.col("failure_reason"), F.col("k") > 50)
    audited = logs.select(F.col("status").alias("execution_status"), F.when(F.col("status") != "ok", kind).alias("failure_class"), F.lit("excluded_failure").alias("primary_status"), F.lit(None).cast("string").alias("frozen_status"))
    return inclusion.census_faults(audited, {"jobs": 360, "ok": 180, "true_failures": 3, "unscored": 0})


# Provenance.

CELL = "coalesce(length(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def _chunk_sql(table: str, columns: list[str], name: str) -> str:
    text = " || ".join(CELL.format(c) for c in columns)
    return f"""{name}_leaf AS (SELECT sha256({text}) AS leaf, count(*) AS n FROM {table} GROUP BY leaf),
    {name}_chunk AS (SELECT left(leaf, 5) AS chunk, sha256(string_agg(leaf || ':' || n, chr(10) ORDER BY leaf || ':' || n)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM {name}_leaf GROUP BY ALL)"""


def _root_sql(name: str, columns: list[str]) -> str:
    return f"""{name}_group AS (SELECT left(chunk, 2) AS chunk, sha256(string_agg(chunk || ':' || digest, chr(10) ORDER BY chunk || ':' || digest)) AS digest, sum(n) AS n FROM {name}_chunk GROUP BY left(chunk, 2)),
    {name}_root AS (SELECT sha256('{",".join(columns)}' || chr(10) || coalesce(string_agg(chunk || ':' || digest, chr(10) ORDER BY chunk || ':' || digest), '')) AS digest, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM {name}_group)"""


@query(f"WITH {_chunk_sql('orders', COLUMNS, 'o')}, {_root_sql('o', COLUMNS)}, {_chunk_sql('lineitem', ['l_returnflag', 'l_linestatus'], 'l')}, {_root_sql('l', ['l_returnflag', 'l_linestatus'])} SELECT 'orders' AS name, * FROM o_root UNION ALL SELECT 'lineitem', * FROM l_root")
def q_table_digest(spark, sf):
    """Digests of a table without repeated rows and of one that has hardly any others."""
    orders = provenance.table_digest(read(spark, sf, "orders").repartition(5, "o_custkey"), COLUMNS)
    lines = provenance.table_digest(read(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])
    return orders.select(F.lit("orders").alias("name"), "*").unionByName(lines.select(F.lit("lineitem").alias("name"), "*"))


NOW_SQL = "now AS (SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 450000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders)"


@query(f"""WITH {NOW_SQL}, {_chunk_sql('orders', COLUMNS, 'a')}, {_chunk_sql('now', COLUMNS, 'b')}
SELECT chunk, CASE WHEN a.digest IS NULL THEN 'added' WHEN b.digest IS NULL THEN 'gone' ELSE 'changed' END AS change, coalesce(a.n, 0) AS n_recorded, coalesce(b.n, 0) AS n_found FROM a_chunk a FULL JOIN b_chunk b USING (chunk) WHERE a.digest IS DISTINCT FROM b.digest""")
def q_changed_chunks(spark, sf):
    """Which parts of a table are no longer as they were recorded."""
    o = read(spark, sf, "orders")
    now = o.withColumn("o_orderstatus", F.when(F.col("o_totalprice") > 450000, "X").otherwise(F.col("o_orderstatus")))
    return provenance.changed_chunks(provenance.chunk_digests(o, COLUMNS), provenance.chunk_digests(now, COLUMNS))


@query("SELECT 'customer' AS name, c_custkey AS k, c_mktsegment AS label FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def q_gated_export(spark, sf):
    """Two tables behind their gates, read back after a check of their digests."""
    tables = {"customer": read(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "supplier": read(spark, sf, "supplier").select("s_suppkey", "s_name")}
    expected = {n: provenance.table_digest(df, df.columns).first()["digest"] for n, df in tables.items()}
    unknown = tables["supplier"].where("s_name IS NULL")
    path = scratch(spark, "export")
    provenance.gated_export(tables, path, unknown, expected)
    back = [provenance.verified(spark, path, n).toDF("k", "label").select(F.lit(n).alias("name"), "k", "label") for n in tables]
    return back[0].unionByName(back[1])


@query("""WITH f AS (SELECT conv_id AS name, sha256(string_agg(turn || coalesce(text, ''), '' ORDER BY turn)) AS digest, count(*) AS n, bool_or(role = 'system') AS sys FROM conversations GROUP BY conv_id)
SELECT name, CASE WHEN n < 4 THEN 'missing' WHEN sys THEN 'changed' END AS problem FROM f WHERE n < 4 OR sys""")
def q_differing_artifacts(spark, sf):
    """Conversations whose copy lacks them or was changed: copies leave out system messages, and short conversations."""
    c = read(spark, sf, "conversations")
    digest = lambda df: provenance.frame_digests(df, ["conv_id"], ["turn"], "turn", "text").withColumnRenamed("conv_id", "name")
    long = c.groupBy("conv_id").count().where("count >= 4").select("conv_id")
    copied = c.where("role <> 'system' OR role IS NULL").join(long, "conv_id", "left_semi")
    return provenance.differing_artifacts(digest(c), digest(copied))


@query("SELECT conv_id, sha256(string_agg(turn || coalesce(text, ''), '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def q_frame_digests(spark, sf):
    return provenance.frame_digests(read(spark, sf, "conversations"), ["conv_id"], ["turn"], "turn", "text")


# Instruments.

RATED_SQL = """rated AS (SELECT year(l_shipdate) AS y, CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'N' THEN 'no' ELSE 'uncertain' END AS ta, CASE WHEN l_linestatus = 'O' THEN 'no' WHEN l_quantity > 48 THEN NULL ELSE 'yes' END AS tb,
    CASE WHEN l_tax > 0.05 THEN 'correct' WHEN l_tax > 0.02 THEN 'partial' ELSE 'incorrect' END AS aa, CASE WHEN l_discount > 0.06 THEN 'correct' WHEN l_tax > 0.03 THEN 'partial' ELSE 'incorrect' END AS ab FROM lineitem)"""


@query(f"""WITH {RATED_SQL}, long AS (SELECT y, 'task' AS field, ta AS a, tb AS b FROM rated UNION ALL SELECT y, 'accuracy', aa, ab FROM rated UNION ALL SELECT y, 'none', NULL, ta FROM rated),
k AS (SELECT *, a IS NOT NULL AND b IS NOT NULL AND a <> 'uncertain' AND b <> 'uncertain' AS ok, CASE a WHEN 'incorrect' THEN 0 WHEN 'partial' THEN 1 WHEN 'correct' THEN 2 END AS i, CASE b WHEN 'incorrect' THEN 0 WHEN 'partial' THEN 1 WHEN 'correct' THEN 2 END AS j FROM long),
s AS (SELECT y, field, count(*) FILTER (ok) AS n, count(*) FILTER (NOT ok) AS n_excluded, avg(CAST(a = b AS DOUBLE)) FILTER (ok) AS po, avg((i - j) ** 2) FILTER (ok) AS d, avg(i) FILTER (ok) AS mi, avg(j) FILTER (ok) AS mj, avg(i * i) FILTER (ok) AS mii, avg(j * j) FILTER (ok) AS mjj FROM k GROUP BY ALL),
ra AS (SELECT y, field, a AS label, count(*) AS x FROM k WHERE ok GROUP BY ALL), rb AS (SELECT y, field, b AS label, count(*) AS z FROM k WHERE ok GROUP BY ALL),
c AS (SELECT y, field, sum(x * z) AS chance FROM ra JOIN rb USING (y, field, label) GROUP BY ALL), e AS (SELECT s.*, coalesce(chance, 0) / (n * n) AS pe, (mii + mjj - 2 * mi * mj) AS ex FROM s LEFT JOIN c USING (y, field))
SELECT y, field, n, n_excluded, CASE WHEN n > 0 THEN round(po, 6) END AS agreement, CASE WHEN n > 0 THEN round(CASE WHEN pe = 1 THEN CAST(po = 1 AS DOUBLE) ELSE (po - pe) / (1 - pe) END, 6) END AS kappa,
CASE WHEN n > 0 AND field = 'accuracy' THEN round(CASE WHEN abs(ex / 4) < 1e-15 THEN CAST(d = 0 AS DOUBLE) ELSE 1 - d / ex END, 6) END AS weighted_kappa, CASE WHEN n > 0 AND field = 'accuracy' THEN round(mj - mi, 6) END AS bias FROM e""")
def q_instrument(spark, sf):
    """Agreement of two raters of every line on all fields at once, by year."""
    tax, cut = F.col("l_tax"), F.col("l_discount")
    rated = read(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("y"), F.when(F.col("l_returnflag") == "A", "yes").when(F.col("l_returnflag") == "N", "no").otherwise("uncertain").alias("ta"),
        F.when(F.col("l_linestatus") == "O", "no").when(F.col("l_quantity") <= 48, "yes").alias("tb"), F.when(tax > 0.05, "correct").when(tax > 0.02, "partial").otherwise("incorrect").alias("aa"),
        F.when(cut > 0.06, "correct").when(tax > 0.03, "partial").otherwise("incorrect").alias("ab"), F.lit(None).cast("string").alias("na"),
    )
    labels = agreement.long_labels(rated, ["y"], {"task": ("ta", "tb"), "accuracy": ("aa", "ab"), "none": ("na", "ta")})
    return rounded(agreement.instrument_report(labels, ["y"], {"accuracy": ["incorrect", "partial", "correct"]}, ("uncertain",)))


def _valid_sql(column: str, name: str) -> str:
    return f"""{name}s AS (SELECT user_id, coalesce(lag({column}) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'login') AS source, {column} AS dest FROM turns),
    {name} AS (SELECT user_id, bool_and(x.source = x.dest OR EXISTS (SELECT 1 FROM g WHERE g.source = '*' AND g.dest = x.dest) OR EXISTS (SELECT 1 FROM two WHERE two.source = x.source AND two.dest = x.dest)) AS ok FROM {name}s x GROUP BY user_id)"""


@query(f"""WITH {EDGES_SQL}, turns AS (SELECT user_id, ts, event_id, event_type AS gold, CASE WHEN value > 50 THEN 'click' ELSE event_type END AS label FROM events), {_valid_sql("gold", "vg")}, {_valid_sql("label", "vl")},
t AS (SELECT count(*) AS n_turns, count(*) FILTER (label = gold) AS n_correct FROM turns), p AS (SELECT count(*) AS n_dialogues, count(*) FILTER (vg.ok) AS n_gold_valid, count(*) FILTER (vl.ok) AS n_labelled_valid, count(*) FILTER (vg.ok = vl.ok) AS n_agree, count(*) FILTER (vg.ok AND NOT vl.ok) AS n_gold_only FROM vg JOIN vl USING (user_id))
SELECT t.*, p.*, round(n_correct / n_turns, 6) AS turn_accuracy, round(n_agree / n_dialogues, 6) AS path_agreement FROM t, p""")
def q_labeller_report(spark, sf):
    turns = read(spark, sf, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("gold"), F.when(F.col("value") > 50, "click").otherwise(F.col("event_type")).alias("label"))
    valid = lambda rows, column: flow.valid_paths(rows, ["user_id"], ["ts", "event_id"], column, _edges(spark), "login")
    return rounded(agreement.labeller_report(turns, ["user_id"], ["ts", "event_id"], "label", "gold", valid))


# Sheets: suppliers are blind dialogues, orders their responses, lines the claims.

SHEETS_SQL = """ds AS (SELECT CASE WHEN s_acctbal < 0 THEN printf('D%03d', s_suppkey + 100000) ELSE printf('D%03d', s_suppkey + 1) END AS id, CASE s_nationkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN ' no' WHEN 2 THEN 'uncertain' ELSE 'maybe' END AS task FROM supplier),
rs AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'X-' ELSE printf('D%03d-', o_custkey + 1) END || printf('R%d', o_orderkey // 2) AS id, printf('D%03d', o_custkey + 1) AS parent, printf('F%02d, F%02d', o_orderkey % 10, o_custkey % 17) AS facts FROM orders),
cs AS (SELECT printf('R%d-C%d', l_orderkey, l_linenumber % 3) AS id, printf('R%d', l_orderkey) AS parent, CASE WHEN l_quantity > 1 THEN 'said' ELSE ' ' END AS text, CASE l_returnflag WHEN 'A' THEN 'supported' WHEN 'N' THEN 'unsupported' ELSE 'returned' END AS support FROM lineitem)"""


def _sheets(spark, sf):
    s, o, line = (read(spark, sf, t) for t in ("supplier", "orders", "lineitem"))
    own = F.when(F.col("s_acctbal") < 0, F.format_string("D%03d", F.col("s_suppkey") + 100000)).otherwise(F.format_string("D%03d", F.col("s_suppkey") + 1))
    task = F.element_at(F.array(*map(F.lit, ("yes", " no", "uncertain", "maybe"))), (F.col("s_nationkey") % 4 + 1).cast("int"))
    dialogues = s.select(own.alias("blind_dialogue_id"), task.alias("task_completed"), F.lit("").alias("notes"), F.col("s_name").alias("dialogue_id"))
    parent = F.format_string("D%03d", F.col("o_custkey") + 1)
    child = F.concat(F.when(F.col("o_orderpriority") == "5-LOW", "X-").otherwise(F.concat(parent, F.lit("-"))), F.format_string("R%d", F.floor(F.col("o_orderkey") / 2)))
    responses = o.select(child.alias("blind_response_id"), parent.alias("blind_dialogue_id"), F.format_string("F%02d, F%02d", F.col("o_orderkey") % 10, F.col("o_custkey") % 17).alias("fact_ids_stated"), F.lit("").alias("notes"), F.col("o_orderpriority").alias("text"))
    claims = line.select(
        F.format_string("R%d-C%d", "l_orderkey", F.col("l_linenumber") % 3).alias("claim_id"), F.format_string("R%d", "l_orderkey").alias("blind_response_id"), F.when(F.col("l_quantity") > 1, "said").otherwise(" ").alias("claim_text"),
        F.when(F.col("l_returnflag") == "A", "supported").when(F.col("l_returnflag") == "N", "unsupported").otherwise("returned").alias("support"),
    )
    return dialogues, responses, claims


@query(f"""WITH {SHEETS_SQL}, n AS (SELECT count(*) AS n FROM ds), dd AS (SELECT *, count(*) OVER (PARTITION BY id) AS same, TRY_CAST(regexp_extract(id, '^D([0-9]{{3,}})$', 1) AS BIGINT) AS num FROM ds, n),
rr AS (SELECT *, count(*) OVER (PARTITION BY id) AS same FROM rs), cc AS (SELECT *, count(*) OVER (PARTITION BY id) AS same FROM cs),
strange AS (SELECT DISTINCT id, unnest(string_split(facts, ', ')) AS f FROM rs)
SELECT 'dialogues' AS sheet, id, 'id_not_dense' AS rule, id AS value FROM dd WHERE NOT num BETWEEN 1 AND n UNION ALL SELECT 'dialogues', id, 'id_repeats', id FROM dd WHERE same > 1 UNION ALL SELECT 'dialogues', id, 'task_invalid', task FROM dd WHERE trim(task) NOT IN ('yes', 'no', 'uncertain')
UNION ALL SELECT 'responses', id, 'id_repeats', id FROM rr WHERE same > 1 UNION ALL SELECT 'responses', id, 'unknown_dialogue', parent FROM rr WHERE parent NOT IN (SELECT id FROM ds) UNION ALL SELECT 'responses', id, 'not_a_child', id FROM rr WHERE NOT starts_with(id, parent || '-')
UNION ALL SELECT 'responses', rs.id, 'unknown_fact', f FROM rs JOIN strange USING (id) WHERE f > 'F12'
UNION ALL SELECT 'claims', id, 'id_repeats', id FROM cc WHERE same > 1 UNION ALL SELECT 'claims', id, 'text_missing', id FROM cc WHERE trim(text) = '' UNION ALL SELECT 'claims', id, 'support_invalid', support FROM cc WHERE support = 'returned'
UNION ALL SELECT 'claims', id, 'unknown_response', parent FROM cc WHERE parent NOT IN (SELECT id FROM rs)""")
def q_sheet_faults(spark, sf):
    """Every fault of three sheets, each scanned once."""
    facts = read(spark, sf, "nation").where("n_nationkey <= 12").select(F.format_string("F%02d", "n_nationkey").alias("id"))
    return validation.frozen_sheet_faults(*_sheets(spark, sf), facts)


@query(f"""WITH {SHEETS_SQL}, n AS (SELECT count(*) AS n FROM ds), dd AS (SELECT *, count(*) OVER (PARTITION BY id) AS same, TRY_CAST(regexp_extract(id, '^D([0-9]{{3,}})$', 1) AS BIGINT) AS num FROM ds, n), rr AS (SELECT *, count(*) OVER (PARTITION BY id) AS same FROM rs),
m AS (SELECT printf('D%03d', c_custkey + 1) AS id, printf('Supplier#%09d', c_nationkey) AS real, CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE '' END AS condition FROM customer), mm AS (SELECT *, count(*) OVER (PARTITION BY id) AS same, count(*) OVER (PARTITION BY real) AS again FROM m)
SELECT 'dialogues' AS sheet, id, 'id_not_dense' AS rule, id AS value FROM dd WHERE NOT num BETWEEN 1 AND n UNION ALL SELECT 'dialogues', id, 'id_repeats', id FROM dd WHERE same > 1 UNION ALL SELECT 'dialogues', id, 'judgement_filled', task FROM dd
UNION ALL SELECT 'responses', id, 'id_repeats', id FROM rr WHERE same > 1 UNION ALL SELECT 'responses', id, 'unknown_dialogue', parent FROM rr WHERE parent NOT IN (SELECT id FROM ds) UNION ALL SELECT 'responses', id, 'not_a_child', id FROM rr WHERE NOT starts_with(id, parent || '-')
UNION ALL SELECT 'responses', id, 'judgement_filled', facts FROM rr UNION ALL SELECT 'mapping', id, 'unknown_dialogue', id FROM mm WHERE id NOT IN (SELECT id FROM ds) UNION ALL SELECT 'mapping', id, 'id_repeats', id FROM mm WHERE same > 1
UNION ALL SELECT 'mapping', id, 'dialogue_repeats', real FROM mm WHERE again > 1 UNION ALL SELECT 'mapping', id, 'condition_missing', real FROM mm WHERE condition = '' UNION ALL SELECT 'mapping', id, 'not_mapped', id FROM ds WHERE id NOT IN (SELECT id FROM m)
UNION ALL SELECT 'responses', CASE WHEN o_orderpriority = '5-LOW' THEN 'X-' ELSE printf('D%03d-', o_custkey + 1) END || printf('R%d', o_orderkey // 2), 'metadata_leak', w FROM orders, (VALUES ('urgent'), ('low')) x(w) WHERE contains(lower(o_orderpriority), w)""")
def q_packet_faults(spark, sf):
    """Every fault of a packet before annotation, the leak of hidden words included."""
    dialogues, responses, _ = _sheets(spark, sf)
    c = read(spark, sf, "customer")
    mapping = c.select(F.format_string("D%03d", F.col("c_custkey") + 1).alias("blind_dialogue_id"), F.format_string("Supplier#%09d", "c_nationkey").alias("dialogue_id"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).otherwise("").alias("condition"))
    return validation.packet_faults(dialogues, responses, mapping, ["urgent", "low"])


# Graphs: parts that follow each other in orders, and the stages that events pass through.

FOLLOWS_SQL = "f AS (SELECT * FROM (SELECT l_partkey AS source, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dest FROM lineitem) WHERE dest > source)"


def _follows(spark, sf) -> DataFrame:
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    steps = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), after.alias("b")).where("b > a")
    return steps.select(F.lit("next").alias("event"), F.col("a").cast("string").alias("source"), F.col("b").cast("string").alias("dest"))


@query(f"WITH RECURSIVE {FOLLOWS_SQL}, r AS (SELECT DISTINCT l_partkey AS state FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem) UNION SELECT f.dest FROM r JOIN f ON f.source = r.state) SELECT CAST(state AS VARCHAR) AS state FROM r")
def q_reach(spark, sf):
    """Parts that orders lead to, step by step to higher numbers, from those of the first order."""
    lines = read(spark, sf, "lineitem")
    start = lines.join(lines.agg(F.min("l_orderkey").alias("l_orderkey")), "l_orderkey").select(F.col("l_partkey").cast("string").alias("state"))
    return flow.reachable(_follows(spark, sf), start)


STAGES_SQL = """steps AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS source, event_type AS dest FROM events), n AS (SELECT source, dest, count(*) AS n FROM steps WHERE source IS NOT NULL AND source <> dest GROUP BY ALL),
g AS (SELECT 'to_' || left(dest, 1) AS event, source, dest, CASE WHEN dest > source THEN 'held' ELSE 'free' END AS guard FROM n WHERE n * (SELECT count(*) FROM n) >= (SELECT sum(n) FROM n) UNION ALL SELECT 'any', '*', (SELECT min(event_type) FROM events), NULL),
one AS (SELECT DISTINCT source, dest FROM g WHERE source <> '*')"""


def _stages(spark, sf) -> DataFrame:
    """The machine that events show: steps between stages that are as frequent as the average, and one stage open from anywhere."""
    ev = read(spark, sf, "events")
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = ev.select(before.alias("source"), F.col("event_type").alias("dest")).where("source <> dest").groupBy("source", "dest").agg(F.count("*").alias("n"))
    often = steps.crossJoin(steps.agg(F.avg("n").alias("mean"))).where("n >= mean")
    guard = F.when(F.col("dest") > F.col("source"), "held").otherwise("free")
    edges = often.select(F.concat(F.lit("to_"), F.left("dest", F.lit(1))).alias("event"), "source", "dest", guard.alias("guard"))
    wild = ev.agg(F.min("event_type").alias("dest")).select(F.lit("any").alias("event"), F.lit("*").alias("source"), "dest", F.lit(None).cast("string").alias("guard"))
    return edges.unionByName(wild)


@query(f"WITH RECURSIVE {STAGES_SQL}, c AS (SELECT source, dest FROM one UNION SELECT c.source, one.dest FROM c JOIN one ON c.dest = one.source) SELECT 'two' AS walks, source, dest FROM (SELECT source, dest FROM one UNION SELECT a.source, b.dest FROM one a JOIN one b ON a.dest = b.source) UNION ALL SELECT 'all', source, dest FROM c")
def q_closure(spark, sf):
    edges = _stages(spark, sf)
    return flow.walks_within(edges, 2).select(F.lit("two").alias("walks"), "source", "dest").unionByName(flow.closure(edges).select(F.lit("all").alias("walks"), "source", "dest"))


@query(f"""WITH RECURSIVE {STAGES_SQL}, s AS (SELECT event_type AS state FROM events GROUP BY event_type HAVING min(event_type) <> (SELECT max(event_type) FROM events) UNION ALL SELECT 'lost'),
r AS (SELECT 'view' AS state UNION SELECT g.dest FROM r JOIN g ON g.source = r.state OR g.source = '*')
SELECT 'ambiguous' AS rule, source || '/' || event AS value FROM g GROUP BY source, event HAVING count(DISTINCT dest) > 1
UNION ALL SELECT 'undeclared_state', x FROM (SELECT source AS x FROM g UNION SELECT dest FROM g) WHERE x <> '*' AND x NOT IN (SELECT state FROM s)
UNION ALL SELECT 'from_any', dest || '/' || string_agg(event, ',' ORDER BY event) FROM g WHERE source = '*' GROUP BY dest
UNION ALL SELECT DISTINCT 'event_of_view', event FROM g WHERE source = 'view' OR (source = '*' AND dest <> 'view') UNION ALL SELECT 'orphan', state FROM s WHERE state NOT IN (SELECT state FROM r)
UNION ALL SELECT 'undeclared_guard', source || '/' || dest FROM g WHERE guard = 'free' UNION ALL SELECT 'mermaid', 'stateDiagram-v2' || chr(10) || string_agg('    ' || source || ' --> ' || dest || ' : ' || event, chr(10) ORDER BY '    ' || source || ' --> ' || dest || ' : ' || event) FROM g WHERE source <> '*'""")
def q_graph_rules(spark, sf):
    """All checks of the machine that the events show, against the stages that are declared."""
    w = _stages(spark, sf)
    ev = read(spark, sf, "events")
    last = ev.agg(F.max("event_type").alias("event_type"))
    states = ev.select("event_type").distinct().join(last, "event_type", "left_anti").select(F.col("event_type").alias("state")).union(ev.sparkSession.createDataFrame([("lost",)], "state string"))
    named = lambda df, rule, value: df.select(F.lit(rule).alias("rule"), value.alias("value"))
    return (
        named(flow.ambiguous_events(w), "ambiguous", F.concat_ws("/", "source", "event"))
        .unionByName(named(flow.undeclared_states(w, states), "undeclared_state", F.col("state")))
        .unionByName(named(flow.events_from_any(w), "from_any", F.concat("dest", F.lit("/"), F.array_join("events", ","))))
        .unionByName(named(flow.events_for(w, "view"), "event_of_view", F.col("event")))
        .unionByName(named(flow.orphans(w, states, "view"), "orphan", F.col("state")))
        .unionByName(named(flow.undeclared_guards(w, ["held"]), "undeclared_guard", F.concat_ws("/", "source", "dest")))
        .unionByName(named(flow.to_mermaid(w), "mermaid", F.col("mermaid")))
    )


# Division, recovery, words.


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def q_division(spark, sf):
    """Customers whose orders have every priority."""
    o = read(spark, sf, "orders")
    return checks.keys_holding_all(o, "o_custkey", "o_orderpriority", o)


@query("""WITH f AS (SELECT p_brand AS key, max(p_size) >= 40 AS patterned FROM part GROUP BY p_brand), i AS (SELECT DISTINCT p_type AS t FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part) AND p_size > 25)
SELECT key FROM f WHERE patterned AND (SELECT count(*) FROM i WHERE t NOT IN (SELECT p_type FROM part WHERE p_brand = f.key)) = 0""")
def q_patterned_keys(spark, sf):
    """Patterned fields (brands with a large part) that every intent (type of a dear, large part) requires."""
    p = read(spark, sf, "part")
    fields = p.groupBy(F.col("p_brand").alias("key")).agg(F.when(F.max("p_size") >= 40, "[0-9]+").alias("pattern"), F.collect_set("p_type").alias("required_for"))
    intents = p.crossJoin(p.agg(F.avg("p_retailprice").alias("mean"))).where("p_retailprice > mean AND p_size > 25").select(F.col("p_type").alias("intent")).distinct()
    return checks.patterned_keys(fields, intents)


REPLY = "message string, status string"


@query("""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS before FROM conversations),
said AS (SELECT *, 0 AS again FROM c WHERE role = 'user' UNION ALL SELECT *, 1 FROM c WHERE role = 'user' AND length(text) % 2 = 0)
SELECT conv_id, CAST(before AS INTEGER) AS turn, CAST(again AS INTEGER) AS attempt, conv_id * 100 + again AS seed, CASE WHEN again = 1 THEN NULL ELSE text END AS message, again = 0 AS parsed FROM said""")
def q_retry_recovery(spark, sf):
    """Recorded candidates of the simulated user, found again by the history that each call repeats."""
    c = read(spark, sf, "conversations")
    message = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"))
    talks = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m")).select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    persona, goal = F.concat(F.lit("persona "), F.col("conv_id").cast("string")), F.lit("a refund")
    dialogues = talks.select("conv_id", (F.col("conv_id") * 100).alias("seed"), persona.alias("persona"), goal.alias("goal"), "messages")
    turns = talks.select("conv_id", persona.alias("persona"), goal.alias("goal"), F.posexplode("messages").alias("i", "said"), "messages").where("said.role = 'user'")
    reply = F.to_json(F.struct(F.col("said.content").alias("message"), F.lit("continue").alias("status")))
    call = turns.select("persona", "goal", F.slice("messages", F.lit(1), F.col("i")).alias("messages"), reply.alias("text"), F.lit(1).alias("timestamp"), F.md5(reply).alias("prompt_hash"), F.length("said.content").alias("n"))
    again = call.where("n % 2 = 0").withColumn("text", F.lit("no json")).withColumn("timestamp", F.lit(2))
    found = replay.retry_candidates(dialogues, call.unionByName(again), ["conv_id"], REPLY)
    return found.select("conv_id", "turn", "attempt", "seed", F.col("reply.message").alias("message"), F.col("reply.message").isNotNull().alias("parsed"))


@query("""WITH c AS (SELECT l_orderkey AS k, l_linenumber AS n, 'please send ' || CASE WHEN l_quantity > 25 THEN 'BEFORE it ' ELSE 'it after it ' END || CASE l_returnflag WHEN 'R' THEN 'was shipped' WHEN 'A' THEN 'ships' ELSE 'is sent' END AS t FROM lineitem)
SELECT k, n, t, contains(t, 'BEFORE') AND contains(t, 'ship') AS looks FROM c""")
def q_looks_before_shipment(spark, sf):
    when = F.when(F.col("l_quantity") > 25, "BEFORE it ").otherwise("it after it ")
    what = F.when(F.col("l_returnflag") == "R", "was shipped").when(F.col("l_returnflag") == "A", "ships").otherwise("is sent")
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.concat(F.lit("please send "), when, what).alias("t"))
    return rows.select("k", "n", "t", texts.looks_before_shipment(F.col("t")).alias("looks"))
