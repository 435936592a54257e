"""Readers: CSV tables of text cells, JSON records, Markdown and plain-text dimensions, Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.cells import dialogue_id, parse_cell
from parley.operators.ranking import numbered
from parley.sources.schemas import DIALOGUE, LLM_CALL, MANIFEST, SCENARIO

KEY = ["scenario_id", "agent", "repetition"]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


def text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header whose cells all stay text; quotes and line breaks inside cells are kept."""
    return spark.read.options(header=True, multiLine=True, escape='"', inferSchema=False).csv(path)


def metrics_csv(spark: SparkSession, path: str, metrics: list[str]) -> DataFrame:
    """Metric rows with typed cells."""
    rows = text_csv(spark, path)
    return rows.select("scenario_id", "agent", F.col("repetition").cast("int").alias("repetition"), *[parse_cell(F.col(m)).alias(m) for m in metrics if m in rows.columns])


def dialogue_keys(spark: SparkSession, path: str) -> DataFrame:
    return text_csv(spark, path).select("scenario_id", "agent", F.col("repetition").cast("int").alias("repetition"))


def unscored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(dialogue_id and reason, faults) of the table of dialogues that got no scores.

    A blank reason is empty text; of rows that repeat an id the last counts, by file name and place in the file.
    A repetition that is no integer makes the row a fault, and so does a missing key column.  Without a file both are empty.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "dialogue_id string, reason string"), spark.createDataFrame([], "scenario_id string, agent string, repetition string")
    found = text_csv(spark, path)
    cell = lambda c: F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c)
    place = F.struct(F.col("_metadata.file_name"), F.monotonically_increasing_id())
    rows = found.select(*map(cell, (*KEY, "reason")), place.alias("__place"))
    number = F.regexp_extract("repetition", r"^\s*([+-]?[0-9]+)\s*$", 1).try_cast("int")
    known = number.isNotNull() & F.col("scenario_id").isNotNull() & F.col("agent").isNotNull()
    reasons = rows.where(known).groupBy(dialogue_id(F.col("scenario_id"), F.col("agent"), number).alias("dialogue_id")).agg(F.max_by(F.coalesce("reason", F.lit("")), "__place").alias("reason"))
    return reasons, rows.where(~F.coalesce(known, F.lit(False))).select(*KEY)


def unique_rows(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows, after a check that no key repeats."""
    if not rows.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError(f"a key of {key} repeats")
    return rows


def split_malformed(rows: DataFrame, id_column: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, anomalies): malformed and repeated keys become anomalies instead of errors."""
    counts = rows.groupBy(F.col(id_column).alias("__id")).agg(F.count("*").alias("__n"))
    ill = lambda c: ~F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    anomalies = counts.where(ill("__id") | (F.col("__n") > 1)).select(F.col("__id").alias("id"), F.when(ill("__id"), "malformed").otherwise("repeated").alias("rule"))
    return rows.where(~ill(id_column)).dropDuplicates([id_column]), anomalies


def optional(spark: SparkSession, path: str, schema: str, read) -> DataFrame:
    return read(spark, path) if exists(spark, path) else spark.createDataFrame([], schema)


def bundle(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of the small files that ``writers.bundle`` packed; readers take it in place of a path."""
    return spark.read.schema("name string, value string").parquet(path)


def whole_texts(spark: SparkSession, source: str | DataFrame, name: Column | None = None) -> DataFrame:
    """(name, value) of text files at a path, by their path if ``name`` does not tell them apart, or of a bundle."""
    if isinstance(source, DataFrame):
        return source.select(F.col("name") if name is None else name.alias("name"), "value")
    named = F.col("_metadata.file_path") if name is None else name
    return spark.read.text(source, wholetext=True).select(named.alias("name"), "value")


def json_records(spark: SparkSession, path: str | DataFrame, schema: str, strict: bool = True) -> DataFrame:
    """Records of a closed schema, a line for each, with their file; strict refuses malformed ones, else they carry ``_corrupt``."""
    if isinstance(path, DataFrame):
        lines = path.select(F.col("name").alias("source_file"), F.explode(F.split("value", "\r?\n")).alias("line")).where(F.trim("line") != "")
        full = schema if strict else schema + ", _corrupt string"
        options = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
        return lines.select(F.from_json("line", full, options).alias("r"), "source_file").select("r.*", "source_file")
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path).withColumn("source_file", F.col("_metadata.file_name"))
    return spark.read.schema(schema + ", _corrupt string").options(mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").json(path).withColumn("source_file", F.col("_metadata.file_name"))


def unknown_fields(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Names of top-level fields that the schema does not have, which a plain read would drop silently."""
    known = T._parse_datatype_string(schema).names
    keys = F.explode(F.json_object_keys("value"))
    return spark.read.text(path).where(F.trim("value") != "").select(keys.alias("field")).distinct().where(~F.col("field").isin(known))


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    return json_records(spark, path, SCENARIO)


def dialogues(spark: SparkSession, path: str | DataFrame, strict: bool = True) -> DataFrame:
    logs = json_records(spark, path, DIALOGUE, strict)
    if strict:
        return logs
    named = F.regexp_extract("source_file", r"([^/]*)\.jsonl?$", 1)
    own = F.format_string("%s__%s__rep%02d", "scenario_id", "agent", "repetition")
    return logs.withColumn("dialogue_id", F.when(F.col("scenario_id").isNull(), named).otherwise(own))


def llm_calls(spark: SparkSession, path: str) -> DataFrame:
    """The append-only call log; a missing file is an empty log."""
    return optional(spark, path, LLM_CALL, lambda s, p: s.read.schema(LLM_CALL).json(p))


def manifest_jobs(spark: SparkSession, path: str) -> DataFrame:
    """A run's planned jobs in their order."""
    doc = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return doc.select(F.posexplode("jobs").alias("ord", "job")).select("ord", "job.*")


def allowlist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ids array<string>").option("multiLine", True).json(path).select(F.explode("ids").alias("dialogue_id"))


def fact_lines(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(file, line_no, section, id, intent, text) of Markdown files: headings name a section, bullets carry the last one as intent."""
    doc = whole_texts(spark, path).select(F.col("name").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    head = F.regexp_extract("line", r"^## .*`([a-z_]+)`", 1)
    ident, text = (F.regexp_extract("line", r"^- \*\*(F[0-9]{2})\*\* — (.*)$", i) for i in (1, 2))
    down = F.last(F.when(head != "", head), ignorenulls=True).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    some = lambda c: F.when(c != "", c)
    return doc.select("file", "line_no", some(head).alias("section"), some(ident).alias("id"), down.alias("intent"), F.trim(text).alias("text")).where("section IS NOT NULL OR id IS NOT NULL")


def facts(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Facts of Markdown files; within a file a section's intent is carried down to its bullets, and a fact before any section is an error."""
    owned = F.when(F.col("intent").isNotNull(), F.col("intent")).otherwise(F.raise_error(F.concat(F.col("id"), F.lit(" stands before any section"))))
    return fact_lines(spark, path).where("id IS NOT NULL").select("id", owned.alias("intent"), "text")


def needles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("needles array<struct<fact_id string>>").option("multiLine", True).json(path).select(F.inline("needles"))


def unanswerable(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("unanswerable array<struct<id string>>").option("multiLine", True).json(path).select(F.inline("unanswerable"))


def user_data_fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("fields array<struct<key string, pattern string, example string, required_for array<string>>>").option("multiLine", True).json(path).select(F.inline("fields"))


def prompts(spark: SparkSession, path: str | DataFrame, name: Column | None = None) -> DataFrame:
    """(name, version, body) of prompt files that begin with a ``Version:`` line; ``name`` tells names that are not the file's."""
    own = F.col("name") if isinstance(path, DataFrame) else F.col("_metadata.file_name")
    files = whole_texts(spark, path, F.regexp_extract(own, r"([^/]*)\.[a-z]+$", 1) if name is None else name)
    return files.select("name", F.regexp_extract("value", r"^Version:\s*([0-9]+)", 1).try_cast("int").alias("version"), F.regexp_replace(F.regexp_replace("value", r"^Version:[^\n]*\n", ""), r"^\s+|\s+$", "").alias("body"))


def sha256_sums(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    return lines.select(F.split("value", "  ", 2)[0].alias("digest"), F.split("value", "  ", 2)[1].alias("name"))


def file_digests(spark: SparkSession, path: str, name: Column | None = None) -> DataFrame:
    named = F.element_at(F.split("path", "/"), -1) if name is None else name
    return spark.read.format("binaryFile").load(path).select(named.alias("name"), F.sha2("content", 256).alias("digest"))


def digest_of_digests(files: DataFrame, name: str = "name", digest: str = "digest") -> DataFrame:
    """One digest over sorted per-file digests."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(name, digest))), lambda x: F.concat(x[digest], F.lit("\n")))
    return files.agg(F.sha2(F.array_join(ordered, ""), 256).alias("digest"))


def state_machine(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, states) of a YAML machine: driver-sized configuration."""
    import yaml

    text = "\n".join(r["value"] for r in spark.read.text(path).collect())
    doc = yaml.safe_load(text)
    edges = [(e["event"], e["from"], e["to"], e.get("guard")) for e in doc["transitions"]]
    states = [(s if isinstance(s, str) else s.get("name") or s.get("id"),) for s in doc["states"]]
    return spark.createDataFrame(edges, "event string, source string, dest string, guard string"), spark.createDataFrame(states, "state string")


def bijective_ids(rows: DataFrame, column: str, prefix: str, width: int = 3) -> DataFrame:
    """Ids that break the dense numbering prefix001, prefix002, ..."""
    return numbered(rows.select(column), [column], "__n").where(F.col(column) != F.format_string(f"{prefix}%0{width}d", "__n")).drop("__n")
