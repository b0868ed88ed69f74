"""Queries of the text and record operators (problems 3 to 6 and 8 to 10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import bpe, digest, duplicates, language, packing, pii, subjects
from quernel.llm.once import once
from quernel.sources import read_table
from quernel.workspace import materialise, spread

# -- 3: duplicates hidden by formatting ---------------------------------------

FORMS = {"question": "question", "executed_sql": "statement"}


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """Runs whose question or statement is that of a run with a smaller id."""
    rows = duplicates.members(read_table(spark, base, "audit_runs"), "run_id", FORMS)
    return rows.where(F.col("id") != F.col("first_id")).select("field", F.col("first_id").alias("first_run_id"), F.col("id").alias("run_id"))


def p3_representatives(spark: SparkSession, base: str) -> DataFrame:
    """Each distinct question and statement once, with its number of runs."""
    rows = duplicates.representatives(read_table(spark, base, "audit_runs"), "run_id", FORMS)
    return rows.withColumnRenamed("first_id", "first_run_id")


# -- 4: languages -------------------------------------------------------------


def _languages(spark: SparkSession, base: str) -> DataFrame:
    runs = read_table(spark, base, "audit_runs").select("run_id", "question", "question_lang")
    profiles = language.fit_on(runs, "question", "question_lang", languages=set(language.NAMES))
    found = language.detect(spread(runs), "question", profiles)
    return once(found.select("run_id", "question_lang", "stretches"), "run_id")


def p4_languages(spark: SparkSession, base: str) -> DataFrame:
    """Every stretch of every question, with language and confidence."""
    rows = _languages(spark, base).select("run_id", F.posexplode("stretches").alias("at", "s"))
    return rows.select("run_id", (F.col("at") + 1).alias("seg"), "s.lang", "s.confidence", "s.start", "s.stop")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Stretches of the questions that are mixed or whose label is missing or wrong."""
    rows = _languages(spark, base).withColumn("label", language.label_language("question_lang"))
    mixed = F.size("stretches") > 1
    unlike = F.col("label").isNull() | (F.col("label") != F.col("stretches")[0]["lang"])
    cases = rows.where((F.size("stretches") > 0) & (mixed | unlike)).select("run_id", F.posexplode("stretches").alias("at", "s"))
    return cases.select("run_id", (F.col("at") + 1).alias("seg"), "s.lang")


# -- 5: percentiles -----------------------------------------------------------

OUTCOME = ["model", "runtime_outcome"]


def _durations(spark: SparkSession, base: str) -> DataFrame:
    runs = read_table(spark, base, "audit_runs").select("run_id", *OUTCOME, F.to_date("created_at").alias("day"), "duration_ms")
    return digest.possible_values(once(runs, "run_id"), "duration_ms", above=0.0)


def p5_percentiles(spark: SparkSession, base: str) -> DataFrame:
    """Percentiles of duration_ms by model and outcome, with their counted rank error."""
    return digest.percentiles(_durations(spark, base), OUTCOME, "duration_ms", "day")


def p5_daily_digests(spark: SparkSession, base: str) -> DataFrame:
    """The digest of each day, model and outcome: the form in which days combine."""
    return digest.digests(materialise(_durations(spark, base), "durations"), [*OUTCOME, "day"], "duration_ms")


def p5_certificates(spark: SparkSession, base: str) -> DataFrame:
    """Number of values by group and percentile, and whether the rank error is within the bound."""
    rows = p5_percentiles(spark, base)
    within = F.col("rank_error") <= F.greatest(F.lit(digest.RANK_ERROR), 1 / F.col("n"))
    return rows.select(*OUTCOME, "n", "percentile", within.alias("within"))


P5_SQL = {
    "p5_certificates": """
WITH runs AS (SELECT run_id, min(model) AS model, min(runtime_outcome) AS runtime_outcome, min(duration_ms) AS v FROM audit_runs GROUP BY run_id)
SELECT model, runtime_outcome, CAST(count(*) AS BIGINT) AS n, percentile, TRUE AS within
FROM runs, (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])::DOUBLE AS percentile)
WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) AND v > 0 GROUP BY model, runtime_outcome, percentile"""
}

# -- 6: personal information --------------------------------------------------


def _texts(spark: SparkSession, base: str) -> DataFrame:
    """record_table, record_id, text of every question and description, as they arrived."""
    runs = read_table(spark, base, "audit_runs").select(F.lit("audit_runs").alias("record_table"), F.col("run_id").alias("record_id"), F.col("question").alias("text"))
    reports = read_table(spark, base, "reports").select(F.lit("reports").alias("record_table"), F.col("id").alias("record_id"), F.col("description").alias("text"))
    return spread(runs.unionByName(reports))


def _field(spark: SparkSession, base: str) -> pii.Field:
    return pii.fit_on([read_table(spark, base, "audit_runs").select("question"), read_table(spark, base, "reports").select("description")])


def _numbered(kind: str) -> Column:
    """array<struct<kind, n>>: the occurrences of one kind, numbered from 1."""
    n = F.size(F.filter("found", lambda x: x["kind"] == kind))
    some = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("n")))
    return F.when(n > 0, some).otherwise(F.array().cast("array<struct<kind:string,n:int>>"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """Each occurrence of personal information, numbered by record and kind."""
    rows = once(pii.find(_texts(spark, base), "text", _field(spark, base)).drop("text"), "record_table", "record_id")
    numbered = [_numbered(kind) for kind in pii.KINDS]
    return rows.select("record_table", "record_id", F.explode(F.concat(*numbered)).alias("x")).select("record_table", "record_id", "x.kind", "x.n")


def p6_redacted(spark: SparkSession, base: str) -> DataFrame:
    """Every question and description with typed placeholders."""
    rows = pii.redact(_texts(spark, base), "text", _field(spark, base))
    return once(rows.select("record_table", "record_id", F.col("redacted").alias("text")), "record_table", "record_id")


# -- 8: token ids -------------------------------------------------------------


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    """Each document's token ids by byte_bpe_50k."""
    return bpe.encode(read_table(spark, base, "documents"), "doc_id", "text")


# -- 9: containers ------------------------------------------------------------

CAPACITY = 2048


def _packed(spark: SparkSession, base: str) -> DataFrame:
    sizes = bpe.count_tokens(read_table(spark, base, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p9_containers(spark: SparkSession, base: str) -> DataFrame:
    """Each document, or piece of a long one, in its container of 2,048 tokens."""
    return _packed(spark, base).withColumnRenamed("item", "doc_id")


def p9_fill(spark: SparkSession, base: str) -> DataFrame:
    """How many containers there are, how full, and how many are needed at least."""
    return packing.fill(_packed(spark, base), CAPACITY)


# -- 10: subjects -------------------------------------------------------------


def _subjects(spark: SparkSession, base: str) -> DataFrame:
    docs = read_table(spark, base, "documents").select("doc_id", "text", "lang")
    labels, areas = read_table(spark, base, "subject_labels"), read_table(spark, base, "subject_areas")
    return subjects.subjects_by_document(spread(docs), "doc_id", "text", labels, areas, language.label_language("lang"))[0]


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    """The subjects that at least a fifth of a document's sentences are about."""
    return _subjects(spark, base).select("doc_id", F.explode("subjects").alias("subject"))


def p10_composition(spark: SparkSession, base: str) -> DataFrame:
    """How much of the corpus each subject makes up: documents, and their share."""
    rows = _subjects(spark, base).withColumn("has", F.size("subjects") > 0)
    total = rows.groupBy().agg(F.count(F.when(F.col("has"), 1)).alias("total"))
    each = rows.select(F.explode("subjects").alias("subject")).groupBy("subject").agg(F.count(F.lit(1)).alias("n_documents"))
    return each.join(F.broadcast(total)).select("subject", "n_documents", (F.col("n_documents") / F.col("total")).alias("share"))


QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_representatives, p4_found, p4_languages, p5_percentiles, p5_daily_digests, p5_certificates, p6_found, p6_redacted, p8_ids, p9_containers, p9_fill, p10_found, p10_composition)
}
SQL = P5_SQL
