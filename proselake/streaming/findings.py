"""Structured Streaming over findings: late and repeated deliveries, windows by time, online drift detection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from proselake.functions import stats
from proselake.plans.registry import query, r6
from proselake.session import table

FINDINGS = "doc_id bigint, metric_id string, channel string, value double, value_str string, unit string, family string, sample_size bigint, min_sample int, warning string, corpus string, measured_at timestamp, loaded_at timestamp"


def read(spark: SparkSession, path: str, per_trigger: int = 16) -> DataFrame:
    """A stream of finding files dropped into a folder."""
    return spark.readStream.schema(FINDINGS).option("maxFilesPerTrigger", per_trigger).parquet(path)


def once(findings: DataFrame, late: str = "21 days") -> DataFrame:
    """Each measurement once: repeated deliveries are dropped, whatever their time of loading, while the watermark keeps their key."""
    keys = ["doc_id", "metric_id", "channel", "corpus", "measured_at"]
    return findings.withColumn("channel", F.lower("channel")).withWatermark("measured_at", late).dropDuplicatesWithinWatermark(keys)


def windowed(findings: DataFrame, size: str = "1 day", late: str | None = "21 days") -> DataFrame:
    """(start, metric_id, n, finite, mean): values of each metric by window of the time of measurement. Works on tables and streams."""
    f = findings.withWatermark("measured_at", late) if late else findings
    v = F.when(stats.finite("value"), F.col("value"))
    return f.groupBy(F.window("measured_at", size).alias("w"), "metric_id").agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("finite"), F.avg(v).alias("mean")).select(F.col("w.start").alias("start"), "metric_id", "n", "finite", "mean")


def drift_events(findings: DataFrame, delta: float = 0.05, threshold: float = 25.0) -> DataFrame:
    """(metric_id, seen, drifts): Page-Hinkley over each metric's values in order of arrival, as a stateful operator.

    The state of a metric is five numbers; values of a batch are taken in order of measured_at.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, cum, low, drifts = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0)
        batch = pd.concat(list(frames)).sort_values("measured_at", kind="stable")
        for x in batch["value"]:
            n += 1
            mean += (x - mean) / n
            cum += x - mean - delta
            low = min(low, cum)
            if cum - low > threshold:
                drifts, cum, low = drifts + 1, 0.0, 0.0
        state.update((n, mean, cum, low, drifts))
        yield pd.DataFrame({"metric_id": [key[0]], "seen": [n], "drifts": [drifts]})

    f = findings.where(stats.finite("value")).select("metric_id", "value", "measured_at")
    return f.groupBy("metric_id").applyInPandasWithState(step, "metric_id string, seen long, drifts int", "n long, mean double, cum double, low double, drifts int", "update", GroupStateTimeout.NoTimeout)


@query(
    "stream_daily_findings",
    "SELECT date_trunc('day', measured_at) AS start, metric_id, count(*) AS n, count(value) FILTER (isfinite(value)) AS finite FROM findings WHERE measured_at IS NOT NULL GROUP BY ALL",
)
def stream_daily_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window aggregation of the stream, over the whole table."""
    return windowed(table(spark, sf_dir, "findings"), late=None).select(F.to_timestamp_ntz(F.date_format("start", "yyyy-MM-dd HH:mm:ss")).alias("start"), "metric_id", "n", "finite")


@query(
    "stream_lateness",
    "SELECT CASE WHEN loaded_at IS NULL OR measured_at IS NULL THEN 'unknown' WHEN loaded_at < measured_at + INTERVAL 1 HOUR THEN 'hour' WHEN loaded_at < measured_at + INTERVAL 1 DAY THEN 'day' WHEN loaded_at < measured_at + INTERVAL 7 DAY THEN 'week' ELSE 'later' END AS late, count(*) AS n FROM findings GROUP BY ALL",
)
def stream_lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How late findings are loaded: what a watermark has to allow for."""
    within = lambda i: F.col("loaded_at") < F.col("measured_at") + F.expr(f"INTERVAL {i}")
    late = F.when(F.col("loaded_at").isNull() | F.col("measured_at").isNull(), "unknown").when(within("1 HOUR"), "hour").when(within("1 DAY"), "day").when(within("7 DAY"), "week").otherwise("later")
    return table(spark, sf_dir, "findings").groupBy(late.alias("late")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_sessions",
    """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of events with gaps below half an hour."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n")).select("user_id", "start", "n")


@query(
    "stream_user_windows",
    "SELECT user_id, event_type, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
)
def stream_user_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user and type in windows of seven days."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.window("ts", "7 days").alias("w")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))
    return e.select("user_id", "event_type", F.to_timestamp_ntz(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss")).alias("start"), "n", "total")
