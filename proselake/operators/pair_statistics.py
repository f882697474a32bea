"""Statistics of pairs of metrics over a profile's texts beyond correlation, components, groups, and detectors of unusual texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.functions import stats
from proselake.functions.grams import per_row
from proselake.operators.compare import STATS_SQL, corpus_stats, latest_findings
from proselake.plans.registry import query, r6
from proselake.session import materialize, table

BY = ["profile", "metric_id"]


def kendall(x: np.ndarray, y: np.ndarray) -> float:
    """Tau-b: concordant less discordant pairs over the pairs that neither variable ties, row by row."""
    s = tx = ty = 0
    for i in range(len(x) - 1):
        a, b = np.sign(x[i + 1 :] - x[i]), np.sign(y[i + 1 :] - y[i])
        s, tx, ty = s + float(a @ b), tx + int((a != 0).sum()), ty + int((b != 0).sum())
    return s / np.sqrt(float(tx) * ty) if tx and ty else np.nan


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """From the double-centred distances, a row at a time."""
    mx, my = (np.array([np.abs(v - a).mean() for a in v]) for v in (x, y))
    gx, gy, xy, xx, yy = mx.mean(), my.mean(), 0.0, 0.0, 0.0
    for i in range(len(x)):
        a, b = np.abs(x - x[i]) - mx - mx[i] + gx, np.abs(y - y[i]) - my - my[i] + gy
        xy, xx, yy = xy + a @ b, xx + a @ a, yy + b @ b
    return float(np.sqrt(max(0.0, xy) / np.sqrt(xx * yy))) if xx > 0 and yy > 0 else np.nan


def mutual_information(x: np.ndarray, y: np.ndarray) -> float:
    """In bits, over bins of equal frequency: as many as the root of the observations, two to five."""
    k = max(2, min(5, int(np.sqrt(len(x)))))
    cut = lambda v: np.searchsorted(np.quantile(v, np.arange(1, k) / k), v, "left")
    c = np.zeros((k, k))
    np.add.at(c, (cut(x), cut(y)), 1)
    p = c / c.sum()
    both = p.sum(1, keepdims=True) @ p.sum(0, keepdims=True)
    return float((p[p > 0] * np.log2(p[p > 0] / both[p > 0])).sum())


def orthogonal_slope(x: np.ndarray, y: np.ndarray) -> float:
    """Slope of the line with the least squared distances from the standardised points."""
    if x.std() <= 0 or y.std() <= 0:
        return np.nan
    r = np.corrcoef(x, y)[0, 1]
    return float(np.sign(r)) if abs(r) > 1e-12 else np.nan


def stability(x: np.ndarray, y: np.ndarray) -> float:
    """Standard deviation of the correlation when each observation in turn is left out, from sums less one."""
    n = len(x)
    if n < 4:
        return np.nan
    x, y = x - x.mean(), y - y.mean()
    sx, sy, k = -x, -y, n - 1
    cov, vx, vy = (x @ y - x * y) - sx * sy / k, (x @ x - x * x) - sx * sx / k, (y @ y - y * y) - sy * sy / k
    ok = (vx > 1e-18) & (vy > 1e-18)
    return float((cov[ok] / np.sqrt(vx[ok] * vy[ok])).std()) if ok.any() else np.nan


def two_groups(v: np.ndarray) -> tuple[float, float, float, float] | None:
    """(lower centre, upper centre, share of the upper, separation) of two means from the middle plus and less a quarter of the range; six values at least."""
    if len(v) < 6 or v.max() <= v.min():
        return None
    mid, span = (v.max() + v.min()) / 2, v.max() - v.min()
    a, b = mid - span / 4, mid + span / 4
    for _ in range(40):
        up = np.abs(v - b) < np.abs(v - a)
        if not up.any() or up.all():
            break
        c, d = v[~up].mean(), v[up].mean()
        if (c, d) == (a, b):
            break
        a, b = c, d
    up = np.abs(v - b) < np.abs(v - a)
    total = ((v - v.mean()) ** 2).sum()
    within = sum(((g - g.mean()) ** 2).sum() for g in (v[up], v[~up]) if len(g))
    return float(a), float(b), float(up.mean()), float(1 - within / total)


def partial_correlation(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> float:
    """Correlation of x and y with what z explains of either taken out."""
    r = np.corrcoef([x, y, z])
    rest = (1 - r[0, 2] ** 2) * (1 - r[1, 2] ** 2)
    return float((r[0, 1] - r[0, 2] * r[1, 2]) / np.sqrt(rest)) if rest > 1e-12 else np.nan


def paired(dist: DataFrame) -> DataFrame:
    """(profile, a, b, xs, ys): the values of each two metrics over the texts that have both. A profile holds a value a text."""
    d = dist.where(stats.finite("value"))
    a = d.select("profile", "obs_id", F.col("metric_id").alias("a"), F.col("value").alias("x"))
    b = d.select("profile", "obs_id", F.col("metric_id").alias("b"), F.col("value").alias("y"))
    p = a.join(b, ["profile", "obs_id"]).where("a < b").groupBy("profile", "a", "b").agg(F.array_sort(F.collect_list(F.struct("obs_id", "x", "y"))).alias("v"))
    return p.where(F.size("v") >= 8).select("profile", "a", "b", F.col("v.x").alias("xs"), F.col("v.y").alias("ys"))


def pair_statistics(dist: DataFrame, of) -> DataFrame:
    """(profile, a, b, feature, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p, a, b, xs, ys in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(p, a, b, k, v) for k, v in of(np.array(xs), np.array(ys)).items() if np.isfinite(v)]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.float64())], ["profile", "a", "b", "feature", "value"])

    return paired(dist).mapInArrow(run, "profile string, a string, b string, feature string, value double")


@query(
    "corpus_kendall",
    f"""WITH {STATS_SQL}, p AS (SELECT a.profile, a.obs_id, a.metric_id AS a, b.metric_id AS b, a.value AS x, b.value AS y FROM cd a JOIN cd b ON a.profile = b.profile AND a.obs_id = b.obs_id AND a.metric_id < b.metric_id),
k AS (SELECT p.profile, p.a, p.b, sum(sign(q.x - p.x) * sign(q.y - p.y)) AS s, sum(abs(sign(q.x - p.x))) AS tx, sum(abs(sign(q.y - p.y))) AS ty FROM p JOIN p q ON p.profile = q.profile AND p.a = q.a AND p.b = q.b AND p.obs_id < q.obs_id GROUP BY ALL),
n AS (SELECT profile, a, b, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 8)
SELECT profile, a, b, round(s / sqrt(tx * ty), 6) + 0.0 AS tau FROM k JOIN n USING (profile, a, b) WHERE tx > 0 AND ty > 0""",
)
def corpus_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kendall's tau-b of each two metrics of a profile."""
    k = pair_statistics(table(spark, sf_dir, "corpus_dist"), lambda x, y: {"tau": kendall(x, y)})
    return k.select("profile", "a", "b", r6("value").alias("tau"))


@query("corpus_pair_statistics")
def corpus_pair_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance correlation, mutual information, orthogonal slope and leave-one-out stability of each two metrics (numeric routines, so without SQL)."""
    of = lambda x, y: {"distance_correlation": distance_correlation(x, y), "mutual_information": mutual_information(x, y), "orthogonal_slope": orthogonal_slope(x, y), "stability": stability(x, y)}
    return pair_statistics(table(spark, sf_dir, "corpus_dist"), of).select("profile", "a", "b", "feature", r6("value").alias("value"))


@query("corpus_components")
def corpus_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the principal components of each profile's correlations (an eigenproblem of a number a pair of metrics, so without SQL)."""
    r = pair_statistics(table(spark, sf_dir, "corpus_dist"), lambda x, y: {"r": float(np.corrcoef(x, y)[0, 1]) if x.std() > 0 and y.std() > 0 else 0.0})
    rows = r.groupBy("profile").agg(F.collect_list(F.struct("a", "b", "value")).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for profile, pairs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                names = sorted({x for p in pairs for x in (p["a"], p["b"])})
                at = {n: i for i, n in enumerate(names)}
                m = np.eye(len(names))
                for p in pairs:
                    m[at[p["a"]], at[p["b"]]] = m[at[p["b"]], at[p["a"]]] = p["value"]
                e = np.maximum(np.linalg.eigvalsh(m)[::-1], 0)
                out += [(profile, i, float(v)) for i, v in enumerate(e / e.sum())]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64())], ["profile", "component", "share"])

    return rows.mapInArrow(run, "profile string, component int, share double").select("profile", "component", r6("share").alias("share"))


@query("corpus_two_groups")
def corpus_two_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each reference distribution falls into two groups (an iteration, so without SQL)."""
    v = table(spark, sf_dir, "corpus_dist").where(stats.finite("value")).groupBy(*BY).agg(F.sort_array(F.collect_list("value")).alias("v"))
    named = materialize(v.withColumn("doc_id", F.monotonically_increasing_id()))  # written, so that ids hold
    rows = per_row(named.select("doc_id", "v"), lambda x: [g] if (g := two_groups(np.array(x))) else [], "low double, high double, upper_share double, separation double")
    return named.join(rows, "doc_id").select(*BY, *(r6(c).alias(c) for c in ("low", "high", "upper_share", "separation")))


def detectors(reference: np.ndarray, rows: np.ndarray, itself: np.ndarray | None = None, k: int = 5) -> dict[str, np.ndarray]:
    """Scores of rows against reference vectors, the higher the more unusual: mean distance of the nearest, Mahalanobis distance
    with a drawn-in covariance, what the first components leave over, distance from the centre, largest deviation, and density
    relative to the neighbours. itself: which reference row each row is, so that it isn't its own neighbour."""
    d = np.sqrt(np.maximum(0, (rows**2).sum(1)[:, None] + (reference**2).sum(1)[None] - 2 * rows @ reference.T))
    if itself is not None:
        d[np.arange(len(rows)), itself] = np.inf
    k = max(1, min(k, reference.shape[0] - 1))
    near = np.sort(d, 1)[:, :k]
    centre = reference.mean(0)
    x = reference - centre
    cov = 0.8 * (x.T @ x / max(1, len(x) - 1)) + 0.2 * np.eye(x.shape[1])
    values, axes = np.linalg.eigh(cov)
    dev = rows - centre
    turned = dev @ axes
    few = max(1, x.shape[1] // 3)
    own = np.sqrt(np.maximum(0, (reference**2).sum(1)[:, None] + (reference**2).sum(1)[None] - 2 * reference @ reference.T))
    np.fill_diagonal(own, np.inf)
    reach = np.sort(own, 1)[:, :k].mean(1)
    return {
        "knn": near.mean(1), "mahalanobis": np.sqrt((turned**2 / np.maximum(values, 1e-9)).sum(1)), "components": np.sqrt((turned[:, : x.shape[1] - few] ** 2).sum(1)), "centre": np.sqrt((dev**2).sum(1)),
        "largest": np.abs(rows - np.median(reference, 0)).max(1), "density": near.mean(1) / np.maximum(1e-9, reach[np.argsort(d, 1)[:, :k]].mean(1)),
    }


@query("anomaly_detectors")
def anomaly_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, corpus, detector, percentile, unusual): six detectors over the metrics of a document against the texts of its
    corpus, each placed among the scores of these texts, which are left out of their own neighbours (linear algebra, so without SQL)."""
    return anomalies(latest_findings(table(spark, sf_dir, "findings")), table(spark, sf_dir, "corpus_dist"))


def anomalies(findings: DataFrame, dist: DataFrame) -> DataFrame:
    """Vectors are robust deviations of each metric of the profile, held within ten; a metric that a text lacks stands at the
    median. A profile's vectors (a row a text) are joined to its documents by profile, one row for each."""
    s = corpus_stats(dist).select(F.col("profile").alias("corpus"), "metric_id", "median", F.greatest(F.col("mad") * stats.MAD_TO_SIGMA, F.lit(1e-9)).alias("scale"))
    z = F.least(F.lit(10.0), F.greatest(F.lit(-10.0), (F.col("value") - F.col("median")) / F.col("scale"))).alias("z")
    metrics = s.groupBy("corpus").agg(F.array_sort(F.collect_set("metric_id")).alias("metrics"))  # a name a metric
    dense = F.transform("metrics", lambda m: F.coalesce(F.try_element_at("zs", m), F.lit(0.0))).alias("x")
    zs = F.map_from_entries(F.collect_list(F.struct("metric_id", "z"))).alias("zs")
    ref = dist.where(stats.finite("value")).select(F.col("profile").alias("corpus"), "metric_id", "obs_id", "value").join(s, ["corpus", "metric_id"]).groupBy("corpus", "obs_id", "metric_id").agg(F.avg(z).alias("z"))
    ref = ref.groupBy("corpus", "obs_id").agg(zs).join(metrics, "corpus").select("corpus", "obs_id", dense).groupBy("corpus").agg(F.array_sort(F.collect_list(F.struct("obs_id", "x"))).alias("ref")).where(F.size("ref") >= 10)
    ref = materialize(ref.select("corpus", F.col("ref.x").alias("ref")))
    own = findings.where(stats.finite("value")).join(s, ["corpus", "metric_id"]).groupBy("doc_id", "corpus", "metric_id").agg(F.avg(z).alias("z")).groupBy("doc_id", "corpus").agg(zs)
    own = own.join(metrics, "corpus").select("doc_id", "corpus", dense)
    out, schema = None, "doc_id bigint, corpus string, detector string, percentile double, unusual boolean"
    # one profile after another: its texts are a small matrix that goes with the task
    for name in [r.corpus for r in ref.select("corpus").orderBy("corpus").collect()]:
        m = np.array(ref.where(F.col("corpus") == name).first().ref)
        part = own.where(F.col("corpus") == name).mapInArrow(_scored(m), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else findings.sparkSession.createDataFrame([], schema)


def _scored(reference: np.ndarray):
    held = {k: np.sort(v) for k, v in detectors(reference, reference, np.arange(len(reference))).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, corpora = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = np.array(b.column(2).to_pylist()).reshape(len(ids), -1)
            for k, v in detectors(reference, rows).items():
                p = 100.0 * (np.searchsorted(held[k], v, "left") + np.searchsorted(held[k], v, "right")) / 2 / len(reference)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(corpora, pa.string()), pa.array([k] * len(ids)), pa.array(np.round(p, 6)), pa.array(p > 95)], ["doc_id", "corpus", "detector", "percentile", "unusual"])

    return run


@query("anomaly_consensus")
def anomaly_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many detectors find a document unusual, and how far apart they are."""
    a = anomaly_detectors(spark, sf_dir)
    return a.groupBy("doc_id", "corpus").agg(F.sum(F.col("unusual").cast("int")).alias("consensus"), r6(F.stddev_pop("percentile")).alias("disagreement"))
