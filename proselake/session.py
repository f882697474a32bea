"""Session settings, table access and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch handed to Python: whole texts can be long, so both are bounded.
BATCH_ROWS, BATCH_BYTES = 2048, 16 << 20


def build_session(master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC times and bounded Arrow batches."""
    b = (
        SparkSession.builder.master(master)
        .appName("proselake")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return prepare(b.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of a session made elsewhere."""
    for k, v in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        try:
            spark.conf.set(f"spark.sql.execution.arrow.{k}", str(v))
        except Exception:  # a setting this Spark version doesn't know
            pass
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where set, else a local one (single-machine sessions only)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), "proselake-checkpoints")
    return path


def app_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/proselake-{spark.sparkContext.applicationId}"


def drop_materialized(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results not yet written can't be computed after that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(app_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    This cuts lineage and survives the loss of executors. Tables are columnar and compressed, so they are smaller
    than RDD checkpoints; they live as long as the shared folder's clean-up keeps them.
    """
    spark = df.sparkSession
    path = f"{app_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def empty_like(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def broadcast_if_small(df: DataFrame, rows: int = 500_000, size: int = 256 << 20) -> DataFrame:
    """df marked for broadcast if it has at most so many rows and bytes (both measured now); otherwise as it is, for a shuffled join."""
    from pyspark.sql import functions as F

    some = df.limit(rows + 1)
    width = F.lit(8 * len(df.columns))
    if any(not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)) for f in df.schema):
        width = F.length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    n, total = some.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a table of one small file would keep all but one idle.

    Tables of many files have more partitions than that and stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
