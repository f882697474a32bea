"""Findings located in the distributions of a reference corpus: percentiles, severities, tiers, scorecards, typicality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.functions import stats
from proselake.functions.ordered import cumulative
from proselake.plans.registry import query, r6, sig
from proselake.session import broadcast_if_small, table

#: Least observations to call an outlier, and to be confident; severities at which one begins and where they are cut.
MIN_CORPUS, CONFIDENT, OUTLIER, CAP, MIN_SIDE = 8, 20, 3.5, 10.0, 4


def latest_findings(findings: DataFrame) -> DataFrame:
    """One row for each measurement: of rows delivered more than once the one loaded last (then the larger value). Channel spellings are unified."""
    keys = ["doc_id", "metric_id", "channel", "corpus", "measured_at"]
    f = findings.withColumn("channel", F.lower("channel"))
    row = F.struct("loaded_at", "value", "value_str", "family", "sample_size", "min_sample", "warning")
    best = f.groupBy(*keys).agg(F.max(row).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in ("loaded_at", "value", "value_str", "family", "sample_size", "min_sample", "warning")))


LATEST = """latest AS (SELECT doc_id, metric_id, lower(channel) AS channel, corpus, measured_at, loaded_at, value, value_str, family, sample_size, min_sample, warning FROM findings
QUALIFY row_number() OVER (PARTITION BY doc_id, metric_id, lower(channel), corpus, measured_at ORDER BY loaded_at DESC NULLS LAST, value DESC NULLS LAST, value_str DESC NULLS LAST, family DESC NULLS LAST, sample_size DESC NULLS LAST, min_sample DESC NULLS LAST, warning DESC NULLS LAST) = 1)"""


@query("findings_latest", f"WITH {LATEST} SELECT doc_id, metric_id, channel, corpus, measured_at, value, value_str, family, sample_size FROM latest")
def findings_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings without repeated deliveries."""
    return latest_findings(table(spark, sf_dir, "findings")).select("doc_id", "metric_id", "channel", "corpus", "measured_at", "value", "value_str", "family", "sample_size")


def corpus_stats(dist: DataFrame) -> DataFrame:
    """(profile, metric_id, n, median, lo, hi, p10, p25, p75, p90, mad, low_mad, high_mad, sd) of the finite values."""
    by = ["profile", "metric_id"]
    d = dist.where(stats.finite("value")).select(*by, "value")
    s = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), stats.quantiles("value", (0.1, 0.25, 0.5, 0.75, 0.9)).alias("q"), F.stddev_pop("value").alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    s = s.select(*by, "n", F.col("q")[2].alias("median"), "lo", "hi", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p25"), F.col("q")[3].alias("p75"), F.col("q")[4].alias("p90"), "sd")
    off = F.abs(F.col("value") - F.col("median"))
    low, high = F.col("value") <= F.col("median"), F.col("value") >= F.col("median")
    mid = lambda c: F.percentile(c, F.lit(0.5))
    e = d.join(s.select(*by, "median"), by).groupBy(*by).agg(mid(off).alias("mad"), mid(F.when(low, off)).alias("l"), mid(F.when(high, off)).alias("h"), F.count(F.when(low, 1)).alias("nl"), F.count(F.when(high, 1)).alias("nh"))
    or_ = lambda a, b: F.when(a > 0, a).otherwise(b)
    # a side of too few values takes the other's scale
    e = e.withColumn("low_mad", F.when(F.col("nl") < MIN_SIDE, or_(F.col("h"), F.col("l"))).otherwise(F.col("l")))
    e = e.withColumn("high_mad", F.when(F.col("nh") < MIN_SIDE, or_(F.col("low_mad"), F.col("h"))).otherwise(F.col("h")))
    return s.join(e.select(*by, "mad", "low_mad", "high_mad"), by)


STATS_SQL = f"""cd AS (SELECT profile, metric_id, obs_id, value FROM corpus_dist WHERE value IS NOT NULL AND isfinite(value)),
s0 AS (SELECT profile, metric_id, count(*) AS n, quantile_cont(value, 0.5) AS median, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90, stddev_pop(value) AS sd FROM cd GROUP BY ALL),
s1 AS (SELECT profile, metric_id, quantile_cont(abs(value - median), 0.5) AS mad, quantile_cont(abs(value - median), 0.5) FILTER (value <= median) AS l, quantile_cont(abs(value - median), 0.5) FILTER (value >= median) AS h, count(*) FILTER (value <= median) AS nl, count(*) FILTER (value >= median) AS nh FROM cd JOIN s0 USING (profile, metric_id) GROUP BY ALL),
s2 AS (SELECT *, CASE WHEN nl < {MIN_SIDE} THEN CASE WHEN h > 0 THEN h ELSE l END ELSE l END AS low_mad FROM s1),
cs AS (SELECT s0.*, mad, low_mad, CASE WHEN nh < {MIN_SIDE} THEN CASE WHEN low_mad > 0 THEN low_mad ELSE h END ELSE h END AS high_mad FROM s0 JOIN s2 USING (profile, metric_id))"""


def _sig_sql(x: str) -> str:
    return f"CAST(format('{{:.9e}}', {x}) AS DOUBLE) + 0.0"


@query("corpus_stats", f"WITH {STATS_SQL} SELECT profile, metric_id, n, " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {_sig_sql(c)} END AS {c}" for c in ("median", "lo", "hi", "p10", "p25", "p75", "p90", "mad", "low_mad", "high_mad", "sd")) + " FROM cs")
def q_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of each reference distribution."""
    s = corpus_stats(table(spark, sf_dir, "corpus_dist"))
    return s.select("profile", "metric_id", F.col("n").cast("bigint").alias("n"), *(sig(c).alias(c) for c in ("median", "lo", "hi", "p10", "p25", "p75", "p90", "mad", "low_mad", "high_mad", "sd")))


def located(points: DataFrame, dist: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys + (x, lt, le) of each different value among the points: how many values of dist lie below it, and below or at it.

    Points and values are counted together by slices of the real line, so that neither a distribution nor a group of
    points is ever in one row or task.
    """
    both = dist.select(*keys, x, F.lit(1).alias("k")).unionByName(points.select(*keys, x).distinct().withColumn("k", F.lit(0)))
    c = cumulative(both, keys, x, {"k": F.col("k")})
    return c.select(*keys, x, (F.col("upto_k") - F.col("k")).alias("lt"), F.col("upto_k").alias("le"))


def compare(findings: DataFrame, dist: DataFrame) -> DataFrame:
    """findings (doc_id, metric_id, corpus, value, ...) + percentile, direction, method, distance, severity, outlier, confidence, tier.

    Findings without a finite value or without a distribution are left out. The scale is that of the side of the
    median a value lies on; without spread there the pooled one, then quartiles, then the range; a constant
    distribution takes only its own value.
    """
    s = broadcast_if_small(corpus_stats(dist).withColumnRenamed("profile", "corpus"))
    f = findings.where(stats.finite("value")).join(s, ["corpus", "metric_id"])
    v, med = F.col("value"), F.col("median")
    values = dist.where(stats.finite("value")).select(F.col("profile").alias("corpus"), "metric_id", "value")
    f = f.join(located(f, values, ["corpus", "metric_id"], "value"), ["corpus", "metric_id", "value"])
    f = f.withColumn("percentile", 100.0 * (F.col("lt") + 0.5 * (F.col("le") - F.col("lt"))) / F.col("n")).withColumn("side", F.when(v > med, F.col("high_mad")).otherwise(F.col("low_mad")))
    iqr, span = F.col("p75") - F.col("p25"), F.col("hi") - F.col("lo")
    method = F.when(F.col("side") > 0, "median/double-MAD").when(F.col("mad") > 0, "median/MAD").when(iqr > 0, "median/IQR").when(span != 0, "empirical percentile").otherwise("constant")
    f = f.withColumn("method", method)
    scale = F.when(F.col("side") > 0, stats.MAD_TO_SIGMA * F.col("side")).when(F.col("mad") > 0, stats.MAD_TO_SIGMA * F.col("mad")).when(iqr > 0, iqr / stats.IQR_TO_SIGMA)
    f = f.withColumn("distance", (v - med) / scale)
    same = F.abs(v - F.col("lo")) <= F.greatest(1e-9 * F.greatest(F.abs(v), F.abs("lo")), F.lit(1e-12))
    empirical = F.when(v > F.col("hi"), OUTLIER * (1 + (v - F.col("hi")) / span)).when(v < F.col("lo"), OUTLIER * (1 + (F.col("lo") - v) / span)).otherwise(F.abs(F.col("percentile") - 50) / 50 * (OUTLIER - 0.01))
    severity = F.when(F.col("distance").isNotNull(), F.abs("distance")).when(F.col("method") == "empirical percentile", empirical).when(same, 0.0).otherwise(CAP)
    f = f.withColumn("severity", F.least(severity, F.lit(CAP)))
    f = f.withColumn("outlier", F.when(F.col("n") >= MIN_CORPUS, F.col("severity") > OUTLIER))
    f = f.withColumn("direction", F.when((F.col("method") == "constant") & same, "typical").when(v > med, "high").when(v < med, "low").otherwise("typical"))
    tier = F.when(F.col("outlier"), "critical").when((v < F.col("lo")) | (v > F.col("hi")), "high").when((v < F.col("p10")) | (v > F.col("p90")), "review").otherwise("in range")
    return f.withColumn("tier", tier).withColumn("confidence", F.when(F.col("n") < MIN_CORPUS, "none").when(F.col("n") >= CONFIDENT, "high").otherwise("low"))


COMPARED = f"""{LATEST}, {STATS_SQL},
fv AS (SELECT * FROM latest WHERE value IS NOT NULL AND isfinite(value)),
pv AS (SELECT DISTINCT corpus, metric_id, value FROM fv),
pc AS (SELECT pv.corpus, pv.metric_id, pv.value, 100.0 * (count(*) FILTER (cd.value < pv.value) + 0.5 * count(*) FILTER (cd.value = pv.value)) / count(*) AS percentile FROM pv JOIN cd ON cd.profile = pv.corpus AND cd.metric_id = pv.metric_id GROUP BY ALL),
j AS (SELECT fv.*, percentile, n, median, lo, hi, p10, p25, p75, p90, mad, CASE WHEN fv.value > median THEN high_mad ELSE low_mad END AS side FROM fv JOIN pc USING (corpus, metric_id, value) JOIN cs ON cs.profile = fv.corpus AND cs.metric_id = fv.metric_id),
k AS (SELECT *, CASE WHEN side > 0 THEN 'median/double-MAD' WHEN mad > 0 THEN 'median/MAD' WHEN p75 > p25 THEN 'median/IQR' WHEN hi <> lo THEN 'empirical percentile' ELSE 'constant' END AS method,
  (value - median) / CASE WHEN side > 0 THEN {stats.MAD_TO_SIGMA} * side WHEN mad > 0 THEN {stats.MAD_TO_SIGMA} * mad WHEN p75 > p25 THEN (p75 - p25) / {stats.IQR_TO_SIGMA} END AS distance FROM j),
l AS (SELECT *, least({CAP}, CASE WHEN distance IS NOT NULL THEN abs(distance) WHEN hi <> lo THEN CASE WHEN value > hi THEN {OUTLIER} * (1 + (value - hi) / (hi - lo)) WHEN value < lo THEN {OUTLIER} * (1 + (lo - value) / (hi - lo)) ELSE abs(percentile - 50) / 50 * ({OUTLIER} - 0.01) END
  WHEN abs(value - lo) <= greatest(1e-9 * greatest(abs(value), abs(lo)), 1e-12) THEN 0.0 ELSE {CAP} END) AS severity FROM k),
compared AS (SELECT *, CASE WHEN n >= {MIN_CORPUS} THEN severity > {OUTLIER} END AS outlier, CASE WHEN n >= {MIN_CORPUS} AND severity > {OUTLIER} THEN 'critical' WHEN value < lo OR value > hi THEN 'high' WHEN value < p10 OR value > p90 THEN 'review' ELSE 'in range' END AS tier FROM l)"""


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(latest_findings(table(spark, sf_dir, "findings")), table(spark, sf_dir, "corpus_dist"))


@query("compare_findings", f"WITH {COMPARED} SELECT doc_id, metric_id, channel, corpus, measured_at, round(percentile, 6) AS percentile, method, {_sig_sql('severity')} AS severity, outlier, tier FROM compared")
def compare_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding in the distribution of its corpus."""
    return compared(spark, sf_dir).select("doc_id", "metric_id", "channel", "corpus", "measured_at", r6("percentile").alias("percentile"), "method", sig("severity").alias("severity"), "outlier", "tier")


@query(
    "compare_scorecard",
    f"""WITH {COMPARED} SELECT doc_id, family, grouping(family) = 1 AS all_families, count(*) AS n, count(*) FILTER (tier = 'critical') AS critical, count(*) FILTER (tier = 'high') AS high, count(*) FILTER (tier = 'review') AS review, count(*) FILTER (tier = 'in range') AS in_range
FROM compared GROUP BY ROLLUP (doc_id, family) HAVING doc_id IS NOT NULL""",
)
def compare_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of tiers by document and family, with each document's total."""
    tier = lambda t, n: F.sum((F.col("tier") == t).cast("int")).alias(n)
    c = compared(spark, sf_dir).select("doc_id", "family", "tier")
    r = c.rollup("doc_id", "family").agg((F.grouping("family") == 1).alias("all_families"), F.count(F.lit(1)).alias("n"), tier("critical", "critical"), tier("high", "high"), tier("review", "review"), tier("in range", "in_range"))
    return r.where("doc_id is not null")


@query(
    "compare_top_findings",
    f"""WITH {COMPARED} SELECT doc_id, metric_id, channel, corpus, measured_at, {_sig_sql('severity')} AS severity, CAST(rank AS INTEGER) AS rank FROM
(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_sig_sql('severity')} DESC, metric_id, channel NULLS FIRST, corpus, measured_at) AS rank FROM compared) WHERE rank <= 5""",
)
def compare_top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most severe findings of each document."""
    c = compared(spark, sf_dir).select("doc_id", "metric_id", "channel", "corpus", "measured_at", sig("severity").alias("severity"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("severity"), "metric_id", F.asc_nulls_first("channel"), "corpus", "measured_at")
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 5")


@query(
    "compare_metric_noise",
    f"""WITH {COMPARED} SELECT metric_id, count(*) AS n, count(*) FILTER (outlier) AS flagged, round(100.0 * count(*) FILTER (outlier) / count(*), 6) AS flagged_rate, {_sig_sql('max(severity)')} AS max_severity,
count(*) FILTER (outlier AND value > median) AS high, count(*) FILTER (outlier AND value < median) AS low FROM compared GROUP BY metric_id""",
)
def compare_metric_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each metric flags, and in which direction."""
    c = compared(spark, sf_dir)
    flag = lambda x: F.sum(x.cast("int"))
    out = F.coalesce("outlier", F.lit(False))
    return c.groupBy("metric_id").agg(
        F.count(F.lit(1)).alias("n"), flag(out).alias("flagged"), r6(100.0 * flag(out) / F.count(F.lit(1))).alias("flagged_rate"), sig(F.max("severity")).alias("max_severity"), flag(out & (F.col("value") > F.col("median"))).alias("high"), flag(out & (F.col("value") < F.col("median"))).alias("low")
    )


_ATYPICAL = f"""{COMPARED}, dm AS (SELECT doc_id, corpus, family, metric_id, avg(percentile) AS p FROM compared WHERE family IS NOT NULL GROUP BY ALL),
df AS (SELECT doc_id, corpus, family, avg(abs(p - 50) / 50) AS a FROM dm GROUP BY ALL), da AS (SELECT doc_id, corpus, avg(a) AS atypicality, count(*) AS families FROM df GROUP BY ALL),
fam AS (SELECT DISTINCT metric_id, family FROM compared WHERE family IS NOT NULL),
lo1 AS (SELECT profile, metric_id, obs_id, abs(100.0 * (rank() OVER (PARTITION BY profile, metric_id ORDER BY value) - 1 + 0.5 * (count(*) OVER (PARTITION BY profile, metric_id, value) - 1)) / (count(*) OVER (PARTITION BY profile, metric_id) - 1) - 50) / 50 AS a FROM cd),
lo2 AS (SELECT profile, obs_id, family, avg(a) AS a FROM lo1 JOIN fam USING (metric_id) GROUP BY ALL), lo3 AS (SELECT profile, obs_id, avg(a) AS a FROM lo2 GROUP BY ALL)"""


@query(
    "compare_typicality",
    f"""WITH {_ATYPICAL} SELECT doc_id, corpus, round(any_value(atypicality), 9) AS atypicality, any_value(families) AS families,
round(100.0 * (count(*) FILTER (round(lo3.a, 9) > round(atypicality, 9)) + 0.5 * count(*) FILTER (round(lo3.a, 9) = round(atypicality, 9))) / count(*), 6) AS score FROM da JOIN lo3 ON lo3.profile = da.corpus GROUP BY doc_id, corpus HAVING count(*) >= 10""",
)
def compare_typicality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How typical each document is of a corpus: the share of the corpus' own texts, each held out, that are less typical."""
    c = compared(spark, sf_dir).where("family is not null")
    dm = c.groupBy("doc_id", "corpus", "family", "metric_id").agg(F.avg("percentile").alias("p"))
    da = dm.groupBy("doc_id", "corpus", "family").agg(F.avg(F.abs(F.col("p") - 50) / 50).alias("a")).groupBy("doc_id", "corpus").agg(F.avg("a").alias("atypicality"), F.count(F.lit(1)).alias("families"))
    family = table(spark, sf_dir, "findings").where("family is not null").select("metric_id", "family").distinct()
    d = held_out_atypicality(table(spark, sf_dir, "corpus_dist")).join(broadcast_if_small(family), "metric_id")
    lo = d.groupBy("profile", "obs_id", "family").agg(F.avg("a").alias("a")).groupBy("profile", "obs_id").agg(F.round(F.avg("a"), 9).alias("x"))
    ref = lo.select(F.col("profile").alias("corpus"), "x")
    sizes = ref.groupBy("corpus").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")
    da = da.withColumn("x", F.round("atypicality", 9))
    j = da.join(located(da, ref, ["corpus"], "x"), ["corpus", "x"]).join(broadcast_if_small(sizes), "corpus")
    return j.select("doc_id", "corpus", F.col("x").alias("atypicality"), "families", r6(100.0 * (F.col("n") - F.col("le") + 0.5 * (F.col("le") - F.col("lt"))) / F.col("n")).alias("score"))


def held_out_atypicality(dist: DataFrame) -> DataFrame:
    """(profile, metric_id, obs_id, a): distance of each observation's midrank among the others from the middle."""
    by = ["profile", "metric_id"]
    d = dist.where(stats.finite("value")).select(*by, "obs_id", "value")
    n = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    c = cumulative(d, by, "value", {"k": F.lit(1)}).join(n, by)
    p = c.select(*by, "value", (100.0 * (F.col("upto_k") - F.col("k") + 0.5 * (F.col("k") - 1)) / (F.col("n") - 1)).alias("p"))
    return d.join(p, [*by, "value"]).select(*by, "obs_id", (F.abs(F.col("p") - 50) / 50).alias("a"))


@query(
    "corpus_held_out",
    f"""WITH {STATS_SQL}, a AS (SELECT a.profile, a.metric_id, a.obs_id, a.value, count(*) AS n, quantile_cont(b.value, 0.5) AS med, quantile_cont(b.value, 0.75) - quantile_cont(b.value, 0.25) AS iqr FROM cd a JOIN cd b ON a.profile = b.profile AND a.metric_id = b.metric_id AND a.obs_id <> b.obs_id GROUP BY ALL)
SELECT profile, metric_id, count(*) AS n, count(*) FILTER (abs(value - med) * {stats.IQR_TO_SIGMA} > {OUTLIER} * iqr) AS flagged FROM a WHERE iqr > 0 GROUP BY ALL""",
)
def corpus_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a profile's texts, each held out, would be flagged by the quartile scale of the rest.

    Without the value at place i, the value at place j of the rest is the one at j, or at j + 1 from i on; so three values
    about each quartile of the whole give the quartiles of every rest.
    """
    by = ["profile", "metric_id"]
    d = table(spark, sf_dir, "corpus_dist").where(stats.finite("value")).select(*by, "value")
    c = cumulative(d, by, "value", {"k": F.lit(1)}).withColumn("first", F.col("upto_k") - F.col("k"))
    n = c.groupBy(*by).agg(F.sum("k").alias("n")).where("n >= 2")
    c = c.join(n, by)
    place = lambda q: F.floor((F.col("n") - 2) * q)
    here = lambda r: (F.col("first") <= r) & (r < F.col("upto_k"))
    about = c.groupBy(*by).agg(*(F.max(F.when(here(place(q) + m), F.col("value"))).alias(f"s{int(100 * q)}_{m}") for q in (0.25, 0.5, 0.75) for m in range(3)))
    c = c.join(about, by)

    def rest(q: float) -> Column:
        s = [F.col(f"s{int(100 * q)}_{m}") for m in range(3)]
        a, b = (F.when(place(q) + m < F.col("first"), s[m]).otherwise(s[m + 1]) for m in range(2))
        part = (F.col("n") - 2) * q - place(q)
        return F.when(part > 0, a + (b - a) * part).otherwise(a)

    c = c.select(*by, "value", "k", rest(0.5).alias("med"), (rest(0.75) - rest(0.25)).alias("iqr")).where("iqr > 0")
    flag = F.abs(F.col("value") - F.col("med")) * stats.IQR_TO_SIGMA > OUTLIER * F.col("iqr")
    return c.groupBy(*by).agg(F.sum("k").alias("n"), F.sum(F.when(flag, F.col("k")).otherwise(0)).alias("flagged"))


@query(
    "corpus_redundant_metrics",
    f"""WITH {STATS_SQL}, p AS (SELECT a.profile, a.metric_id AS a, b.metric_id AS b, count(*) AS n, corr(a.value, b.value) AS r, max(abs(a.value - b.value)) AS gap FROM cd a JOIN cd b ON a.profile = b.profile AND a.obs_id = b.obs_id AND a.metric_id < b.metric_id GROUP BY ALL)
SELECT profile, a, b, n, round(r, 6) + 0.0 AS r, gap <= 1e-9 AS identical FROM p WHERE n >= 8""",
)
def corpus_redundant_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of each pair of metrics over a profile's texts, and whether they are the same."""
    d = table(spark, sf_dir, "corpus_dist").where(stats.finite("value"))
    a = d.select("profile", "obs_id", F.col("metric_id").alias("a"), F.col("value").alias("x"))
    b = d.select("profile", "obs_id", F.col("metric_id").alias("b"), F.col("value").alias("y"))
    p = a.join(b, ["profile", "obs_id"]).where("a < b").groupBy("profile", "a", "b").agg(F.count(F.lit(1)).alias("n"), r6(F.corr("x", "y")).alias("r"), (F.max(F.abs(F.col("x") - F.col("y"))) <= 1e-9).alias("identical"))
    return p.where("n >= 8")


@query(
    "corpus_rank_correlation",
    f"""WITH {STATS_SQL}, r AS (SELECT profile, metric_id, obs_id, rank() OVER (PARTITION BY profile, metric_id ORDER BY value) + (count(*) OVER (PARTITION BY profile, metric_id, value) - 1) / 2.0 AS r FROM cd)
SELECT a.profile, a.metric_id AS a, b.metric_id AS b, round(corr(a.r, b.r), 6) + 0.0 AS rho FROM r a JOIN r b ON a.profile = b.profile AND a.obs_id = b.obs_id AND a.metric_id < b.metric_id GROUP BY ALL HAVING abs(corr(a.r, b.r)) >= 0.3""",
)
def corpus_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of metrics whose ranks correlate by 0.3 or more."""
    d = table(spark, sf_dir, "corpus_dist").where(stats.finite("value")).withColumn("r", stats.average_rank(["profile", "metric_id"], "value"))
    a = d.select("profile", "obs_id", F.col("metric_id").alias("a"), F.col("r").alias("x"))
    b = d.select("profile", "obs_id", F.col("metric_id").alias("b"), F.col("r").alias("y"))
    p = a.join(b, ["profile", "obs_id"]).where("a < b").groupBy("profile", "a", "b").agg(F.corr("x", "y").alias("rho"))
    return p.where(F.abs("rho") >= 0.3).select("profile", "a", "b", r6("rho").alias("rho"))


_CURVE = ", ".join(f"{q / 100}" for q in range(101))


@query("corpus_curves", f"WITH {STATS_SQL}, q AS (SELECT profile, metric_id, quantile_cont(value, [{_CURVE}]) AS c FROM cd GROUP BY ALL) SELECT profile, metric_id, unnest(range(101)) AS pct, round(unnest(c), 9) + 0.0 AS value FROM q")
def corpus_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 101-point quantile curve of each distribution."""
    c = curves(table(spark, sf_dir, "corpus_dist"), ["profile", "metric_id"], "value")
    return c.select("profile", "metric_id", F.posexplode("curve").alias("pct", "value")).select("profile", "metric_id", F.col("pct").cast("bigint").alias("pct"), (F.round("value", 9) + F.lit(0.0)).alias("value"))


def curves(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys + curve: quantiles at 0, 1, ..., 100 percent."""
    return df.where(stats.finite(x)).groupBy(*keys).agg(stats.quantiles(x, tuple(q / 100 for q in range(101))).alias("curve"))


_UNION = f"""WITH {LATEST}, u AS (SELECT corpus, metric_id, value, 1 AS f, 0 AS g FROM latest WHERE value IS NOT NULL AND isfinite(value) AND corpus IS NOT NULL
  UNION ALL SELECT profile, metric_id, value, 0, 1 FROM corpus_dist WHERE value IS NOT NULL AND isfinite(value)),
t AS (SELECT corpus, metric_id, CAST(sum(f) AS DOUBLE) AS nf, CAST(sum(g) AS DOUBLE) AS ng FROM u GROUP BY ALL HAVING sum(f) > 0 AND sum(g) > 0), v AS (SELECT corpus, metric_id, value, sum(f) AS f, sum(g) AS g FROM u GROUP BY ALL),
c AS (SELECT corpus, metric_id, value, lead(value) OVER w AS nxt, sum(f) OVER w AS cf, sum(g) OVER w AS cg FROM v WINDOW w AS (PARTITION BY corpus, metric_id ORDER BY value)),
d AS (SELECT corpus, metric_id, value, nxt - value AS dx, cf / nf - cg / ng AS gap, nf, ng FROM c JOIN t USING (corpus, metric_id))"""


@query(
    "distance_to_corpus",
    _UNION + f"SELECT corpus, metric_id, CAST(any_value(nf) AS BIGINT) AS n, round(max(abs(gap)), 6) AS ks, {_sig_sql('coalesce(sum(abs(gap) * dx), 0)')} AS wasserstein, {_sig_sql('sqrt(2 * coalesce(sum(gap * gap * dx), 0))')} AS energy FROM d GROUP BY ALL",
)
def distance_to_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kolmogorov-Smirnov, Wasserstein and energy distance of each metric's findings from its corpus' distribution."""
    f = latest_findings(table(spark, sf_dir, "findings")).where(stats.finite("value") & F.col("corpus").isNotNull()).select("corpus", "metric_id", "value", F.lit(1).alias("f"), F.lit(0).alias("g"))
    g = table(spark, sf_dir, "corpus_dist").where(stats.finite("value")).select(F.col("profile").alias("corpus"), "metric_id", "value", F.lit(0).alias("f"), F.lit(1).alias("g"))
    return ecdf_distances(f.unionByName(g))


def ecdf_distances(u: DataFrame) -> DataFrame:
    """From rows (corpus, metric_id, value, f, g) with a 1 in the column of their sample."""
    keys = ["corpus", "metric_id"]
    u = u.groupBy(*keys, "value").agg(F.sum("f").alias("f"), F.sum("g").alias("g"))
    t = u.groupBy(*keys).agg(F.sum("f").cast("double").alias("nf"), F.sum("g").cast("double").alias("ng")).where("nf > 0 and ng > 0")
    c = cumulative(u, keys, "value", {"f": F.col("f"), "g": F.col("g")}).join(t, keys)
    gap = F.col("upto_f") / F.col("nf") - F.col("upto_g") / F.col("ng")
    dx = F.col("next") - F.col("value")
    s = c.groupBy(*keys).agg(F.first("nf").cast("bigint").alias("n"), F.max(F.abs(gap)).alias("ks"), F.sum(F.abs(gap) * dx).alias("w"), F.sum(gap * gap * dx).alias("e"))
    return s.select(*keys, "n", r6("ks").alias("ks"), sig(F.coalesce("w", F.lit(0.0))).alias("wasserstein"), sig(F.sqrt(2 * F.coalesce("e", F.lit(0.0)))).alias("energy"))


@query(
    "distance_histograms",
    f"""WITH {LATEST}, {STATS_SQL}, e AS (SELECT profile AS corpus, metric_id, p10, p25, median, p75, p90 FROM cs),
f AS (SELECT corpus, metric_id, (value > p10)::INT + (value > p25)::INT + (value > median)::INT + (value > p75)::INT + (value > p90)::INT AS bin FROM latest JOIN e USING (corpus, metric_id) WHERE value IS NOT NULL AND isfinite(value)),
g AS (SELECT profile AS corpus, metric_id, (value > p10)::INT + (value > p25)::INT + (value > median)::INT + (value > p75)::INT + (value > p90)::INT AS bin FROM cd JOIN cs USING (profile, metric_id)),
h AS (SELECT DISTINCT f.corpus, f.metric_id, b.bin FROM f, (SELECT unnest(range(6)) AS bin) b),
c AS (SELECT h.corpus, h.metric_id, h.bin, (SELECT count(*) FROM f WHERE f.corpus = h.corpus AND f.metric_id = h.metric_id AND f.bin = h.bin) + 0.5 AS a, (SELECT count(*) FROM g WHERE g.corpus = h.corpus AND g.metric_id = h.metric_id AND g.bin = h.bin) + 0.5 AS b FROM h),
p AS (SELECT corpus, metric_id, a / sum(a) OVER w AS p, b / sum(b) OVER w AS q FROM c WINDOW w AS (PARTITION BY corpus, metric_id))
SELECT corpus, metric_id, round(0.5 * sum(p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q))), 6) AS jensen_shannon, round(sum(p * log2(p / q)), 6) AS kl_forward, round(sum(q * log2(q / p)), 6) AS kl_reverse,
 round(sqrt(greatest(0, 1 - sum(sqrt(p * q)))), 6) AS hellinger, round(0.5 * sum(abs(p - q)), 6) AS total_variation FROM p GROUP BY ALL""",
)
def distance_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of the histograms over the corpus' quantile bands, smoothed by half a count."""
    s = corpus_stats(table(spark, sf_dir, "corpus_dist")).select(F.col("profile").alias("corpus"), "metric_id", "p10", "p25", "median", "p75", "p90")
    s = broadcast_if_small(s, 20_000)
    band = sum((F.col("value") > F.col(c)).cast("int") for c in ("p10", "p25", "median", "p75", "p90"))
    keys = ["corpus", "metric_id"]
    hist = lambda d, n: d.where(stats.finite("value")).join(s, keys).groupBy(*keys, band.alias("bin")).agg(F.count(F.lit(1)).alias(n))
    f = hist(latest_findings(table(spark, sf_dir, "findings")), "a")
    g = hist(table(spark, sf_dir, "corpus_dist").withColumnRenamed("profile", "corpus"), "b")
    spine = f.select(*keys).distinct().withColumn("bin", F.explode(F.array(*map(F.lit, range(6)))))
    c = spine.join(f, [*keys, "bin"], "left").join(g, [*keys, "bin"], "left").select(*keys, (F.coalesce("a", F.lit(0)) + 0.5).alias("a"), (F.coalesce("b", F.lit(0)) + 0.5).alias("b"))
    w = Window.partitionBy(*keys)
    x = c.select(*keys, (F.col("a") / F.sum("a").over(w)).alias("p"), (F.col("b") / F.sum("b").over(w)).alias("q"))
    p, q = F.col("p"), F.col("q")
    return x.groupBy(*keys).agg(
        r6(0.5 * F.sum(p * F.log2(2 * p / (p + q)) + q * F.log2(2 * q / (p + q)))).alias("jensen_shannon"), r6(F.sum(p * F.log2(p / q))).alias("kl_forward"), r6(F.sum(q * F.log2(q / p))).alias("kl_reverse"),
        r6(F.sqrt(F.greatest(F.lit(0.0), 1 - F.sum(F.sqrt(p * q))))).alias("hellinger"), r6(0.5 * F.sum(F.abs(p - q))).alias("total_variation"),
    )


_SUMMARY = ("mean", "median", "sd", "min", "max", "p10", "p25", "p75", "p90", "iqr", "mad")


@query(
    "stats_summary",
    f"""WITH {LATEST}, x AS (SELECT metric_id, value AS v FROM latest WHERE value IS NOT NULL AND isfinite(value)),
s AS (SELECT metric_id, count(*) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS median, stddev_samp(v) AS sd, min(v) AS min, max(v) AS max, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM x GROUP BY ALL),
m AS (SELECT metric_id, quantile_cont(abs(v - median), 0.5) AS mad FROM x JOIN s USING (metric_id) GROUP BY ALL)
SELECT metric_id, n, {', '.join(f'{_sig_sql(c)} AS {c}' for c in _SUMMARY)} FROM s JOIN m USING (metric_id)""",
)
def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary statistics of each metric's finite values."""
    f = latest_findings(table(spark, sf_dir, "findings")).where(stats.finite("value"))
    return stats.summarize(f, ["metric_id"], "value").select("metric_id", "n", *(sig(c).alias(c) for c in _SUMMARY))


@query("findings_rollup", "SELECT family, lower(channel) AS channel, grouping(family) AS all_families, grouping(lower(channel)) AS all_channels, count(*) AS n, count(value) AS measured FROM findings GROUP BY CUBE (family, lower(channel))")
def findings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and measured values by family and channel, with all totals."""
    f = table(spark, sf_dir, "findings").select("family", F.lower("channel").alias("channel"), "value")
    return f.cube("family", "channel").agg(F.grouping("family").cast("bigint").alias("all_families"), F.grouping("channel").cast("bigint").alias("all_channels"), F.count(F.lit(1)).alias("n"), F.count("value").alias("measured"))


@query("findings_missing", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.doc_id = d.doc_id AND f.value IS NOT NULL)")
def findings_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without any measured value (anti join)."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "findings").where("value is not null").select("doc_id"), "doc_id", "left_anti")


@query(
    "findings_gates",
    """SELECT CASE WHEN value IS NULL THEN 'unavailable' WHEN value_str IS NOT NULL THEN 'not compared' WHEN NOT isfinite(value) THEN 'not compared' WHEN sample_size < min_sample THEN 'insufficient' WHEN corpus IS NULL THEN 'no corpus' ELSE 'compared' END AS status, count(*) AS n FROM findings GROUP BY ALL""",
)
def findings_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why findings are or aren't compared, by the ordered gates."""
    v = F.col("value")
    gate = F.when(v.isNull(), "unavailable").when(F.col("value_str").isNotNull(), "not compared").when(~stats.finite(v), "not compared").when(F.col("sample_size") < F.col("min_sample"), "insufficient").when(F.col("corpus").isNull(), "no corpus").otherwise("compared")
    return table(spark, sf_dir, "findings").groupBy(gate.alias("status")).agg(F.count(F.lit(1)).alias("n"))
