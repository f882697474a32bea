"""How a text changes along its course: features of its windows, their trends, windows unlike the others, and points of change."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.functions import text as T
from proselake.functions.grams import per_row
from proselake.operators.core_metrics import held
from proselake.operators.named_sequences import PRONOUNS
from proselake.operators.profiles import windows
from proselake.operators.views import docs
from proselake.plans.registry import query, r6

FEATURES = ("sentence_words", "word_letters", "commas", "dialogue", "pronouns", "variety")
#: Words of a window in the queries (texts of the tables are short); robust deviations from which a window stands out; weight of the penalty of a change.
WORDS, UNUSUAL, PENALTY = 200, 2.5, 1.0


def window_features(documents: DataFrame, size: int = 2000) -> DataFrame:
    """(doc_id, win, x): the FEATURES of each window of whole paragraphs."""
    w = held(windows(documents, size).select("doc_id", "win", "text", T.words(F.col("text")).alias("ws"), T.tokens(F.array_join(F.regexp_extract_all("text", F.lit(T.QUOTED), F.lit(0)), "\n")).alias("q")))
    w = held(w.withColumn("toks", F.transform("ws", lambda x: F.translate(F.lower(x), "’", "'"))).withColumn("ss", F.size(F.flatten(T.sentences(F.col("text"))))))
    n = F.greatest(F.size("ws"), F.lit(1)).cast("double")
    rate = lambda c: 1000.0 * c / n
    x: list[Column] = [n / F.greatest("ss", F.lit(1)), F.aggregate("ws", F.lit(0.0), lambda s, v: s + F.length(v)) / n, rate(F.regexp_count("text", F.lit(","))), 100.0 * F.size("q") / n, rate(F.size(F.filter("toks", lambda t: t.isin(PRONOUNS)))), F.size(F.array_distinct("toks")) / F.pow(n, F.lit(0.8))]
    return w.select("doc_id", "win", F.array(*(c.cast("double") for c in x)).alias("x"))


def ranks(v: np.ndarray) -> np.ndarray:
    """Ranks with ties averaged."""
    _, inverse, count = np.unique(v, return_inverse=True, return_counts=True)
    last = np.cumsum(count)
    return (last - (count - 1) / 2)[inverse]


def trends(x: np.ndarray) -> dict[str, float | str]:
    """The feature whose rank follows the place most, its rank correlation, and the largest gap of the first and last thirds in pooled deviations."""
    n = len(x)
    if n < 4:
        return {}
    place = ranks(np.arange(n))
    rho = [float(np.corrcoef(ranks(c), place)[0, 1]) if c.std() > 1e-12 else 0.0 for c in x.T]
    k, third = int(np.argmax(np.round(np.abs(rho), 9))), n // 3
    a, b = x[:third], x[n - third :]
    pooled = np.sqrt((a.var(0) + b.var(0)) / 2)
    gap = np.abs(a.mean(0) - b.mean(0))
    return {"trend_feature": FEATURES[k], "trend": rho[k], "third_gap": float(np.max(gap[pooled > 1e-12] / pooled[pooled > 1e-12])) if (pooled > 1e-12).any() else 0.0}


def deviations(x: np.ndarray) -> np.ndarray:
    """For each window the root mean square of its features' robust deviations from all other windows."""
    n = len(x)
    if n < 4:
        return np.zeros(0)
    out = np.zeros(x.shape)
    for i in range(n):
        rest = np.delete(x, i, 0)
        mid = np.median(rest, 0)
        scale = 1.4826 * np.median(np.abs(rest - mid), 0)
        scale = np.where(scale > 1e-12, scale, rest.std(0))
        out[i] = np.where(scale > 1e-12, (x[i] - mid) / np.maximum(scale, 1e-12), 0)
    return np.sqrt((out**2).mean(1))


def change_points(x: np.ndarray, weight: float = PENALTY) -> list[int]:
    """Starts of the segments of least squared distance from their means plus a penalty for each, by optimal partitioning; a
    start that can't become the last change of a best partition any more is dropped."""
    n = len(x)
    sd = x.std(0)
    z = (x - x.mean(0))[:, sd > 1e-12] / sd[sd > 1e-12]
    if n < 4 or not z.shape[1]:
        return []
    s, s2 = np.vstack([np.zeros(z.shape[1]), np.cumsum(z, 0)]), np.r_[0, np.cumsum((z**2).sum(1))]
    cost = lambda a, b: s2[b] - s2[a] - ((s[b] - s[a]) ** 2).sum() / (b - a)
    penalty = weight * z.shape[1] * np.log(n)
    best, before, alive = np.r_[-penalty, np.zeros(n)], np.zeros(n + 1, int), [0]
    for t in range(2, n + 1):
        c = [best[a] + cost(a, t) + penalty if t - a >= 2 else np.inf for a in alive]
        k = int(np.argmin(c))
        best[t], before[t] = c[k], alive[k]
        alive = [a for a, v in zip(alive, c) if v - penalty <= best[t]] + [t - 1] if t > 2 else [*alive]
    out, t = [], n
    while t > 0:
        t = int(before[t])
        if t > 0:
            out.append(t)
    return out[::-1]


@query("drift")
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trends, unusual windows and change points of documents of four windows or more (iterations, so without SQL)."""
    return measures(window_features(docs(spark, sf_dir), WORDS))


def measures(features: DataFrame) -> DataFrame:
    """(doc_id, windows, trend_feature, trend, third_gap, most_deviation, unusual, changes, largest_change) from (doc_id, win, x)."""
    d = features.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("win", "x"))).alias("w")).where(F.size("w") >= 4).select("doc_id", F.col("w.x").alias("xs"))  # the windows of one text

    def of(xs: list[list[float]]) -> list[tuple]:
        x = np.array(xs)
        t, d, c = trends(x), deviations(x), change_points(x)
        sd = np.where(x.std(0) > 1e-12, x.std(0), np.inf)
        edges = [0, *c, len(x)]
        means = [x[a:b].mean(0) for a, b in zip(edges, edges[1:])]
        jump = max((float((np.abs(q - p) / sd).max()) for p, q in zip(means, means[1:])), default=0.0)
        return [(len(x), t["trend_feature"], t["trend"], t["third_gap"], float(d.max()), int((d > UNUSUAL).sum()), len(c), jump)]

    m = per_row(d, of, "windows bigint, trend_feature string, trend double, third_gap double, most_deviation double, unusual bigint, changes bigint, largest_change double")
    return m.select("doc_id", "windows", "trend_feature", *(r6(c).alias(c) for c in ("trend", "third_gap", "most_deviation")), "unusual", "changes", r6("largest_change").alias("largest_change"))
