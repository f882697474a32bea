"""Sinks: reference profiles, reports, training shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 2


def write_profile(dist: DataFrame, path: str) -> None:
    """Write reference distributions (profile, metric_id, obs_id, value), partitioned by profile, sorted within files."""
    d = dist.select("profile", "metric_id", "obs_id", "value", F.lit(SCHEMA_VERSION).alias("schema_version"))
    d.repartition("profile").sortWithinPartitions("metric_id", "obs_id").write.mode("overwrite").partitionBy("profile").parquet(path)


def read_profile(spark: SparkSession, path: str, profile: str | None = None) -> DataFrame:
    """Read a profile back; a version this engine doesn't know is refused."""
    d = spark.read.parquet(path)
    if profile is not None:
        d = d.where(F.col("profile") == profile)
    if d.where(F.col("schema_version") > SCHEMA_VERSION).limit(1).count():
        raise ValueError("the profile was written by a later version")
    return d.select("profile", "metric_id", "obs_id", "value")


def without_observation(dist: DataFrame, obs_id: str) -> DataFrame:
    """A profile with one text held out."""
    return dist.where(F.col("obs_id") != obs_id)


def report_json(compared: DataFrame) -> DataFrame:
    """(doc_id, report): one JSON document for each text, its findings by metric. A text has as many as there are metrics."""
    row = F.struct("metric_id", "channel", "corpus", "value", "percentile", "severity", "tier")
    g = compared.groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("findings"))
    n = F.size("findings")
    flagged = F.size(F.filter("findings", lambda f: f["tier"] == "critical"))
    return g.select("doc_id", F.to_json(F.struct(F.col("doc_id"), n.alias("count"), flagged.alias("critical"), F.col("findings"))).alias("report"))


def write_reports(compared: DataFrame, path: str) -> None:
    report_json(compared).select("report").write.mode("overwrite").text(path)
