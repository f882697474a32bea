"""Percentiles of very large numeric columns from mergeable logarithmic buckets.

A finite value falls into the bucket (sign, ceil(log_gamma |value|)) with gamma = (1 + a) / (1 - a), zero into its own.
Every value of a bucket lies within the relative distance a of its representative 2 gamma^i / (gamma + 1), so each
percentile returned is within a (relatively) of the exact value of its rank. Buckets of partitions, days or runs are
combined by adding equal buckets, which is what Spark's partial aggregation does before the shuffle: a hot group
shuffles as many rows per partition as it has buckets, however many values it has. Numbers from 1e-308 to 1e308 have at most
about 71,000 / (a * 100) buckets a sign; there is no cap on them and none is collapsed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 0.01
QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def _gamma(accuracy: float) -> float:
    if not 0 < accuracy < 1:
        raise ValueError("accuracy must lie between 0 and 1")
    return (1 + accuracy) / (1 - accuracy)


def sketch(rows: DataFrame, keys: list[str], value: str = "value", accuracy: float = ACCURACY) -> DataFrame:
    """keys + (sgn, bucket, n): the counts of each bucket. Null, NaN and infinite values are left out; null keys form a
    group of their own; repeated rows count as often as they stand there; an empty table has no buckets."""
    v = F.col(value).cast("double")
    held = rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    bucket = F.when(v == 0, F.lit(0)).otherwise(F.ceil(F.log(F.abs(v)) / F.lit(math.log(_gamma(accuracy))))).cast("int")
    return held.groupBy(*keys, F.signum(v).cast("int").alias("sgn"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Add the counts of equal buckets: sketches of days or partitions become those of the whole."""
    return buckets.groupBy(*keys, "sgn", "bucket").agg(F.sum("n").alias("n"))


def percentiles(buckets: DataFrame, keys: list[str], quantiles: tuple[float, ...] = QUANTILES, accuracy: float = ACCURACY) -> DataFrame:
    """keys + (q, n, value): of each group and quantile the value of rank floor(q (n - 1)), within the relative error."""
    g = _gamma(accuracy)
    order = F.col("sgn") * F.when(F.col("sgn") == 0, 0).otherwise(F.col("bucket"))
    by = [F.col(k) for k in keys]
    w = Window.partitionBy(*by).orderBy(F.col("sgn"), order)
    upto = buckets.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    qs = F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))
    value = F.col("sgn") * F.lit(2 / (g + 1)) * F.pow(F.lit(g), F.col("bucket"))
    hit = upto.withColumn("q", qs).withColumn("rank", F.floor(F.col("q") * (F.col("total") - 1)))
    hit = hit.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    return hit.select(*keys, "q", F.col("total").alias("n"), F.when(F.col("sgn") == 0, 0.0).otherwise(value).alias("value"))
