"""Relational queries over the tables of a folder: SQL text, pivots, samples, functions registered for SQL, and a stream run to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.operators.named_sequences import named_sequences
from proselake.operators.views import docs
from proselake.plans.metrics import chosen, measured, metric, register_functions
from proselake.plans.registry import query, r6
from proselake.session import app_folder, table

TABLES = ("documents", "findings", "candidates", "turns", "sequences", "reading_bands", "corpus_dist", "text_processing", "mix_targets", "embeddings")


def views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """The tables of a folder as temporary views."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


_SOURCES = """WITH d AS (SELECT doc_id, source, lang FROM documents WHERE source IS NOT NULL)
SELECT d.source, count(DISTINCT d.doc_id) AS documents, count(f.value) AS measured, count(DISTINCT f.metric_id) AS metrics FROM d LEFT JOIN findings f ON f.doc_id = d.doc_id GROUP BY d.source"""


@query("sql_sources", _SOURCES)
def sql_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL text over the tables as views."""
    views(spark, sf_dir, ("documents", "findings"))
    return spark.sql(_SOURCES)


_ASOF = """WITH t AS (SELECT doc_id, metric_id, measured_at, max(value) AS value FROM findings WHERE value IS NOT NULL AND isfinite(value) GROUP BY ALL), c AS (SELECT provider, provider_id, max(seen_at) AS seen_at FROM candidates GROUP BY ALL)
SELECT d.doc_id, c.provider, t.metric_id, max(t.measured_at) AS measured_at FROM documents d JOIN c ON c.provider = d.provider AND c.provider_id = d.provider_id JOIN t ON t.doc_id = d.doc_id AND t.measured_at <= c.seen_at GROUP BY ALL"""


@query("asof_measurements", _ASOF)
def asof_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: of each document's measurements the last before its catalogue entry was seen, by one aggregation instead of a sorted join."""
    t = table(spark, sf_dir, "findings").where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))).select("doc_id", "metric_id", "measured_at").distinct()
    c = table(spark, sf_dir, "candidates").groupBy("provider", "provider_id").agg(F.max("seen_at").alias("seen_at"))
    d = docs(spark, sf_dir).where("provider is not null").select("doc_id", "provider", "provider_id").join(c, ["provider", "provider_id"])
    return t.join(d.select("doc_id", "provider", "seen_at"), "doc_id").where("measured_at <= seen_at").groupBy("doc_id", "provider", "metric_id").agg(F.max("measured_at").alias("measured_at"))


CHANNELS = ("full", "dialogue", "narration")


@query("findings_pivot", "SELECT metric_id, " + ", ".join(f"count(*) FILTER (lower(channel) = '{c}') AS n_{c}" for c in CHANNELS) + " FROM findings GROUP BY metric_id")
def findings_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a metric, a column a channel."""
    f = table(spark, sf_dir, "findings").select("metric_id", F.lower("channel").alias("channel"))
    p = f.groupBy("metric_id").pivot("channel", list(CHANNELS)).count()
    return p.select("metric_id", *(F.coalesce(c, F.lit(0)).alias(f"n_{c}") for c in CHANNELS))


@query("documents_sample", "SELECT doc_id, source FROM documents WHERE (doc_id * 7919 + 104729) % 1000 < 100")
def documents_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling operator: a tenth of the documents by a fixed function of the id, the same on every run."""
    return sample(docs(spark, sf_dir), "doc_id", 0.1).select("doc_id", "source")


def sample(rows: DataFrame, key: str, share: float) -> DataFrame:
    """Rows whose key falls into a share of a thousand classes; rows of one key stay together."""
    return rows.where(F.pmod(F.col(key) * 7919 + 104729, F.lit(1000)) < int(share * 1000))


@query("udtf_words", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}]+(?:[''’][\p{L}\p{Nl}\p{No}]+)*')) AS n FROM turns WHERE text IS NOT NULL")
def udtf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function called from SQL, for each row of a table."""
    register_functions(spark)
    t = table(spark, sf_dir, "turns").where("text is not null").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    t.createOrReplaceTempView("turns_with_rows")
    return spark.sql("SELECT t.doc_id, count(w.word) AS n FROM turns_with_rows t LEFT JOIN LATERAL prose_words(t.text) w GROUP BY t.row, t.doc_id")


@metric("rhythm", "rhythm", ids=("rhythm.sentence_words", "rhythm.paragraph_words"), min_sample=10)
def _rhythm(documents: DataFrame) -> DataFrame:
    s = named_sequences(documents).where(F.col("seq_name").isin("sentence_words", "paragraph_words"))
    return s.groupBy("doc_id", "seq_name").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("sample_size")).select("doc_id", F.concat(F.lit("rhythm."), "seq_name").alias("metric_id"), "value", "sample_size")


@query("registered_metrics")
def registered_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all registered metrics (what is registered is open, so without SQL)."""
    return measured(docs(spark, sf_dir), chosen()).select("doc_id", "metric_id", r6("value").alias("value"), "sample_size", "family", "warning")


@query("stream_to_table", "SELECT CAST(measured_at AS DATE) AS day, metric_id, count(*) AS n, count(value) AS measured FROM findings WHERE measured_at IS NOT NULL GROUP BY ALL")
def stream_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over the table's files run until all are read: daily counts of each metric, written by batches to a shared table and read back."""
    schema = table(spark, sf_dir, "findings").schema
    path = f"{app_folder(spark)}/stream-{uuid.uuid4().hex}"
    f = spark.readStream.schema(schema).parquet(f"{sf_dir}/findings*.parquet").where("measured_at is not null")
    daily = f.groupBy(F.to_date("measured_at").alias("day"), "metric_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("measured"))
    # complete mode: each batch holds all days, so the last one written is the answer
    done = daily.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/table")).start()
    done.awaitTermination()
    return spark.read.parquet(f"{path}/table")
