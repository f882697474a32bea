"""Rhythm of sentences and paragraphs: autocorrelation, changes, runs, entropy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.functions import stats
from proselake.operators.views import PARA, SENT, WORD_SQL, docs, paragraphs, sentences, split_sql
from proselake.plans.registry import query, r6


def _sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(docs(spark, sf_dir)).select("doc_id", "s", F.col("n_words").cast("double").alias("x"))


def acf_sql(source: str, key: str, order: str, x: str) -> str:
    return f"""d AS (SELECT {key}, {order} AS o, {x} - avg({x}) OVER (PARTITION BY {key}) AS d FROM {source}),
p AS (SELECT *, {', '.join(f'd * lead(d, {k}) OVER (PARTITION BY {key} ORDER BY o) AS p{k}' for k in (1, 2, 3))} FROM d)
SELECT {key}, count(*) AS n, {', '.join(f'round(CASE WHEN count(*) > {k + 1} AND sum(d * d) > 1e-18 THEN sum(p{k}) / sum(d * d) END + 0.0, 6) AS acf{k}' for k in (1, 2, 3))} FROM p GROUP BY {key}"""


@query("rhythm_autocorrelation", f"WITH {SENT}, " + acf_sql("sent", "doc_id", "s", "n_words"))
def rhythm_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelation of sentence lengths at lags 1 to 3."""
    a = stats.autocorrelation(_sents(spark, sf_dir), ["doc_id"], "s", "x")
    return a.select("doc_id", "n", *(r6(f"acf{k}").alias(f"acf{k}") for k in (1, 2, 3)))


@query(
    "rhythm_deltas",
    f"""WITH {SENT}, d AS (SELECT doc_id, n_words - lag(n_words) OVER (PARTITION BY doc_id ORDER BY s) AS d FROM sent)
SELECT doc_id, round(quantile_cont(abs(d), 0.5), 6) AS delta_abs, round(quantile_cont(d, 0.5), 6) AS delta_signed, round(100.0 * avg(CASE WHEN abs(d) <= 2 THEN 1 ELSE 0 END), 6) AS flat_pair_rate FROM d WHERE d IS NOT NULL GROUP BY doc_id""",
)
def rhythm_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of length from sentence to sentence."""
    d = _sents(spark, sf_dir).withColumn("d", F.col("x") - F.lag("x").over(Window.partitionBy("doc_id").orderBy("s"))).where("d is not null")
    return d.groupBy("doc_id").agg(r6(F.percentile(F.abs("d"), F.lit(0.5))).alias("delta_abs"), r6(F.percentile("d", F.lit(0.5))).alias("delta_signed"), r6(100.0 * F.avg((F.abs("d") <= 2).cast("int"))).alias("flat_pair_rate"))


@query(
    "rhythm_runs",
    f"""WITH {SENT}, l AS (SELECT doc_id, s, CASE WHEN n_words <= 8 THEN 'short' WHEN n_words >= 25 THEN 'long' ELSE 'medium' END AS band FROM sent),
g AS (SELECT *, s - row_number() OVER (PARTITION BY doc_id, band ORDER BY s) AS g FROM l), r AS (SELECT doc_id, band, g, count(*) AS length FROM g GROUP BY ALL), n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT doc_id, band, round(100.0 * sum(length) / any_value(n), 6) AS band_share, round(avg(length), 6) AS run_length, max(length) AS max_run, round(100.0 * sum(CASE WHEN length >= 3 THEN length ELSE 0 END) / any_value(n), 6) AS in_run_share
FROM r JOIN n USING (doc_id) GROUP BY doc_id, band""",
)
def rhythm_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of short, medium and long sentences."""
    l = _sents(spark, sf_dir).withColumn("band", F.when(F.col("x") <= 8, "short").when(F.col("x") >= 25, "long").otherwise("medium"))  # noqa: E741
    r = stats.run_lengths(l, ["doc_id"], "s", "band")
    n = r.withColumn("n", F.sum("length").over(Window.partitionBy("doc_id")))
    return n.groupBy("doc_id", "band").agg(
        r6(100.0 * F.sum("length") / F.first("n")).alias("band_share"), r6(F.avg("length")).alias("run_length"), F.max("length").alias("max_run"), r6(100.0 * F.sum(F.when(F.col("length") >= 3, F.col("length")).otherwise(0)) / F.first("n")).alias("in_run_share")
    )


@query(
    "rhythm_entropy",
    f"""WITH {SENT}, c AS (SELECT doc_id, n_words, count(*) AS c, sum(count(*)) OVER (PARTITION BY doc_id) AS n FROM sent GROUP BY doc_id, n_words)
SELECT doc_id, round(-sum(c / n * log2(c / n)) + 0.0, 6) AS entropy, round(CASE WHEN count(*) > 1 THEN -sum(c / n * log2(c / n)) / log2(count(*)) ELSE 0 END + 0.0, 6) AS normalized, round(100.0 * max(c) / any_value(n), 6) AS modal_share FROM c GROUP BY doc_id""",
)
def rhythm_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of sentence lengths."""
    c = _sents(spark, sf_dir).groupBy("doc_id", "x").agg(F.count(F.lit(1)).alias("c"))
    s = c.groupBy("doc_id").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("c") * F.log2("c")).alias("cl"), F.max("c").alias("top"))
    h = F.log2("n") - F.col("cl") / F.col("n")
    return s.select("doc_id", r6(h).alias("entropy"), r6(F.when(F.col("k") > 1, h / F.log2("k")).otherwise(0.0)).alias("normalized"), r6(100.0 * F.col("top") / F.col("n")).alias("modal_share"))


@query(
    "rhythm_paragraphs",
    f"""WITH {PARA}, x AS (SELECT doc_id, p, len(regexp_extract_all(paragraph, '{WORD_SQL}')) AS w, len({split_sql('paragraph')}) AS s FROM para)
SELECT doc_id, count(*) AS n, round(quantile_cont(w, 0.5), 6) AS words_median, round(avg(s), 6) AS sentences_mean, round(100 * stddev_samp(w) / avg(w), 6) AS words_cv, round(100.0 * avg(CASE WHEN s = 1 THEN 1 ELSE 0 END), 6) AS single_share FROM x GROUP BY doc_id""",
)
def rhythm_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph lengths, and the share of paragraphs of one sentence."""
    p = paragraphs(docs(spark, sf_dir))
    return p.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), r6(F.percentile("n_words", F.lit(0.5))).alias("words_median"), r6(F.avg("n_sentences")).alias("sentences_mean"), r6(100 * F.stddev_samp("n_words") / F.avg("n_words")).alias("words_cv"), r6(100.0 * F.avg((F.col("n_sentences") == 1).cast("int"))).alias("single_share")
    )


@query(
    "rhythm_single_runs",
    f"""WITH {PARA}, x AS (SELECT doc_id, p, len({split_sql('paragraph')}) = 1 AS one FROM para), g AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, one ORDER BY p) AS g FROM x),
r AS (SELECT doc_id, one, g, count(*) AS length FROM g GROUP BY ALL)
SELECT doc_id, count(*) AS runs, round(avg(length), 6) AS run_length, max(length) AS max_run FROM r WHERE one GROUP BY doc_id""",
)
def rhythm_single_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of paragraphs of one sentence."""
    p = paragraphs(docs(spark, sf_dir)).select("doc_id", "p", (F.col("n_sentences") == 1).alias("one"))
    return stats.run_lengths(p, ["doc_id"], "p", "one").where("one").groupBy("doc_id").agg(F.count(F.lit(1)).alias("runs"), r6(F.avg("length")).alias("run_length"), F.max("length").alias("max_run"))


@query("rhythm_length_quantiles", f"WITH {SENT} SELECT doc_id, {', '.join(f'round(quantile_cont(n_words, {q}), 6) AS p{int(q * 100)}' for q in (0.1, 0.25, 0.5, 0.75, 0.9))} FROM sent GROUP BY doc_id")
def rhythm_length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of sentence lengths."""
    q = _sents(spark, sf_dir).groupBy("doc_id").agg(stats.quantiles("x", (0.1, 0.25, 0.5, 0.75, 0.9)).alias("q"))
    return q.select("doc_id", *(r6(F.col("q")[i]).alias(n) for i, n in enumerate(("p10", "p25", "p50", "p75", "p90"))))
