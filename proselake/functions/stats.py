"""The statistics kernel: aggregates over groups of a table, none of which gathers a group in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselake.functions import ordered

MAD_TO_SIGMA, IQR_TO_SIGMA = 1.4826, 1.349


def finite(c: Column | str) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def quantiles(x: str, qs: tuple[float, ...]) -> Column:
    """Exact quantiles by linear interpolation at (n - 1) q."""
    return F.percentile(F.col(x), F.array(*[F.lit(q) for q in qs]))


def skewness(x: str) -> Column:
    """Adjusted skewness G1; null under three values, 0 without spread."""
    n = F.count(x).cast("double")
    return F.when(n < 3, None).when(F.coalesce(F.stddev_pop(x), F.lit(0.0)) == 0, 0.0).otherwise(F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x))


def excess_kurtosis(x: str) -> Column:
    """Adjusted excess kurtosis G2; null under four values, 0 without spread."""
    n = F.count(x).cast("double")
    return F.when(n < 4, None).when(F.coalesce(F.stddev_pop(x), F.lit(0.0)) == 0, 0.0).otherwise((n - 1) * ((n + 1) * F.kurtosis(x) + 6) / ((n - 2) * (n - 3)))


def summarize(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys + count, mean, median, sd, cv, min, max, p10, p25, p75, p90, iqr, mad, skewness, kurtosis, bimodality of the finite values."""
    held = df.where(finite(x)).select(*keys, F.col(x).cast("double").alias("x"))
    s = held.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("min"), F.max("x").alias("max"),
        skewness("x").alias("skewness"), excess_kurtosis("x").alias("kurtosis"),
    )
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    # a group may hold a tenth of all rows, so its quantiles come from ranks of slices
    q = ordered.quantiles(held, keys, "x", (0.1, 0.25, 0.5, 0.75, 0.9)).drop("n")
    s = s.alias("s").join(q.alias("q"), same("s", "q")).select("s.*", F.col("q.q").alias("q")).withColumn("median", F.col("q")[2])
    dev = held.alias("h").join(s.select(*keys, "median").alias("c"), same("h", "c")).select(*(F.col(f"h.{k}").alias(k) for k in keys), F.abs(F.col("h.x") - F.col("c.median")).alias("d"))
    mad = ordered.quantiles(dev, keys, "d", (0.5,)).select(*keys, F.col("q")[0].alias("mad"))
    s = s.alias("s").join(mad.alias("m"), same("s", "m"))
    n = F.col("n").cast("double")
    bimodal = (F.pow("skewness", 2) + 1) / (F.col("kurtosis") + 3 * F.pow(n - 1, 2) / ((n - 2) * (n - 3)))
    return s.select(
        *(F.col(f"s.{k}").alias(k) for k in keys), "n", "mean", "median", "sd", F.when(F.col("mean") != 0, 100 * F.col("sd") / F.abs("mean")).alias("cv"), "min", "max",
        F.col("q")[0].alias("p10"), F.col("q")[1].alias("p25"), F.col("q")[3].alias("p75"), F.col("q")[4].alias("p90"), (F.col("q")[3] - F.col("q")[1]).alias("iqr"), "mad",
        "skewness", "kurtosis", F.when(n > 3, bimodal).alias("bimodality"),
    )


def entropy_of_counts(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """keys + (n, kinds, entropy): Shannon entropy in bits of a column's values."""
    c = df.groupBy(*keys, what).agg(F.count(F.lit(1)).alias("c"))
    # -sum p log2 p = log2 n - sum c log2 c / n, so one aggregation over the counts suffices
    return c.groupBy(*keys).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("kinds"), F.sum(F.col("c") * F.log2("c")).alias("clog")).select(*keys, "n", "kinds", (F.log2("n") - F.col("clog") / F.col("n")).alias("entropy"))


def autocorrelation(df: DataFrame, keys: list[str], order: str, x: str, lags: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """keys + (n, acf1, ...): sample autocorrelations; null where n <= lag + 1 or without variance."""
    by = Window.partitionBy(*keys)
    d = df.withColumn("__d", F.col(x) - F.avg(x).over(by))
    for k in lags:
        d = d.withColumn(f"__p{k}", F.col("__d") * F.lead("__d", k).over(by.orderBy(order)))
    s = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__d") * F.col("__d")).alias("__v"), *(F.sum(f"__p{k}").alias(f"__s{k}") for k in lags))
    return s.select(*keys, "n", *(F.when((F.col("n") > k + 1) & (F.col("__v") > 1e-18), F.col(f"__s{k}") / F.col("__v")).alias(f"acf{k}") for k in lags))


def run_lengths(df: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """keys + (label, start, length): maximal runs of equal labels in order."""
    by = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.col(label).eqNullSafe(F.lag(label).over(by)) & (F.row_number().over(by) > 1), 0).otherwise(1)
    return df.withColumn("__new", new).withColumn("__run", F.sum("__new").over(by)).groupBy(*keys, "__run").agg(F.first(label).alias(label), F.min(order).alias("start"), F.count(F.lit(1)).alias("length")).drop("__run")


def average_rank(by: list[str], x: str) -> Column:
    """Ranks with ties averaged, within groups."""
    w = Window.partitionBy(*by).orderBy(x)
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2.0


def gini(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys + gini of non-negative sizes."""
    r = df.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(x)))
    s = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("total"), F.sum(F.col("__i") * F.col(x)).alias("w"))
    return s.select(*keys, "n", F.when(F.col("total") > 0, 2 * F.col("w") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0).alias("gini"))


def g2(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """Dunning's log-likelihood of a word with counts a and b in texts of na and nb words."""
    ea, eb = na * (a + b) / (na + nb), nb * (a + b) / (na + nb)
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    return 2 * (term(a, ea) + term(b, eb))
