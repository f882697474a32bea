"""Ordered channels as time series: autocorrelation, trend, turning points, entropy, drift, spectra, recurrence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.functions import stats
from proselake.plans.registry import query, r6
from proselake.session import table

KEYS = ["doc_id", "seq_name"]
#: Distances held at once by the quadratic measures, which go over all pairs of points in blocks of so many.
MOST_PAIRS = 1 << 21


def clean(seq: DataFrame) -> DataFrame:
    """(doc_id, seq_name, i, x): one finite value for each place (the largest of repeated rows), numbered anew in order."""
    s = seq.where(stats.finite("value")).groupBy(*KEYS, "idx").agg(F.max("value").alias("x"))
    return s.select(*KEYS, (F.row_number().over(Window.partitionBy(*KEYS).orderBy("idx")) - 1).alias("i"), "x")


CLEAN = """c0 AS (SELECT doc_id, seq_name, idx, max(value) AS x FROM sequences WHERE value IS NOT NULL AND isfinite(value) GROUP BY ALL),
c AS (SELECT doc_id, seq_name, row_number() OVER (PARTITION BY doc_id, seq_name ORDER BY idx) - 1 AS i, x FROM c0)"""


def _seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "sequences"))


@query(
    "sequence_autocorrelation",
    f"""WITH {CLEAN}, d AS (SELECT doc_id, seq_name, i, x - avg(x) OVER (PARTITION BY doc_id, seq_name) AS d FROM c), p AS (SELECT *, {', '.join(f'd * lead(d, {k}) OVER (PARTITION BY doc_id, seq_name ORDER BY i) AS p{k}' for k in (1, 2, 3))} FROM d)
SELECT doc_id, seq_name, count(*) AS n, {', '.join(f'round(CASE WHEN count(*) > {k + 1} AND sum(d * d) > 1e-18 THEN sum(p{k}) / sum(d * d) END + 0.0, 6) AS acf{k}' for k in (1, 2, 3))} FROM p GROUP BY ALL""",
)
def sequence_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = stats.autocorrelation(_seq(spark, sf_dir), KEYS, "i", "x")
    return a.select(*KEYS, "n", *(r6(f"acf{k}").alias(f"acf{k}") for k in (1, 2, 3)))


@query(
    "sequence_trend",
    f"WITH {CLEAN} SELECT doc_id, seq_name, count(*) AS n, round(regr_slope(x, i), 9) + 0.0 AS slope, round(regr_intercept(x, i), 9) + 0.0 AS intercept, round(regr_r2(x, i), 9) AS r2, round(stddev_samp(x), 9) AS sd FROM c GROUP BY ALL HAVING count(*) >= 3 AND stddev_samp(x) > 1e-9",
)
def sequence_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares line through each sequence."""
    s = _seq(spark, sf_dir).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("x", "i").alias("slope"), F.regr_intercept("x", "i").alias("intercept"), F.regr_r2("x", "i").alias("r2"), F.stddev_samp("x").alias("sd"))
    return s.where("n >= 3 and sd > 1e-9").select(*KEYS, "n", *((F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("slope", "intercept", "r2", "sd")))


@query(
    "sequence_shape",
    f"""WITH {CLEAN}, m AS (SELECT *, x - avg(x) OVER (PARTITION BY doc_id, seq_name) AS d, x - lag(x) OVER w AS up, lead(x) OVER w - x AS dn FROM c WINDOW w AS (PARTITION BY doc_id, seq_name ORDER BY i)),
z AS (SELECT *, lag(sign(round(d, 9))) OVER (PARTITION BY doc_id, seq_name ORDER BY i) AS before FROM m)
SELECT doc_id, seq_name, count(*) AS n, CAST(sum(CASE WHEN up * dn < 0 THEN 1 ELSE 0 END) AS BIGINT) AS turning_points, CAST(sum(CASE WHEN before * sign(round(d, 9)) < 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_crossings, round(avg(abs(up)), 6) AS mean_change FROM z GROUP BY ALL""",
)
def sequence_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turning points, crossings of the mean and mean change."""
    w = Window.partitionBy(*KEYS).orderBy("i")
    s = _seq(spark, sf_dir).withColumn("sg", F.signum(F.round(F.col("x") - F.avg("x").over(Window.partitionBy(*KEYS)), 9))).withColumn("up", F.col("x") - F.lag("x").over(w)).withColumn("dn", F.lead("x").over(w) - F.col("x")).withColumn("before", F.lag("sg").over(w))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return s.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), one(F.col("up") * F.col("dn") < 0).alias("turning_points"), one(F.col("before") * F.col("sg") < 0).alias("zero_crossings"), r6(F.avg(F.abs("up"))).alias("mean_change"))


@query(
    "sequence_permutation_entropy",
    f"""WITH {CLEAN}, t AS (SELECT doc_id, seq_name, x AS a, lead(x) OVER w AS b, lead(x, 2) OVER w AS d FROM c WINDOW w AS (PARTITION BY doc_id, seq_name ORDER BY i)),
o AS (SELECT doc_id, seq_name, (a <= b)::INT::VARCHAR || (a <= d)::INT::VARCHAR || (b <= d)::INT::VARCHAR AS pattern FROM t WHERE d IS NOT NULL), k AS (SELECT doc_id, seq_name, pattern, count(*) AS c FROM o GROUP BY ALL)
SELECT doc_id, seq_name, CAST(sum(c) AS BIGINT) AS n, round((log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2(6) + 0.0, 6) AS entropy FROM k GROUP BY ALL""",
)
def sequence_permutation_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised entropy of the orders of three successive values."""
    w = Window.partitionBy(*KEYS).orderBy("i")
    t = _seq(spark, sf_dir).select(*KEYS, F.col("x").alias("a"), F.lead("x").over(w).alias("b"), F.lead("x", 2).over(w).alias("d")).where("d is not null")
    bit = lambda c: c.cast("int").cast("string")
    e = stats.entropy_of_counts(t.withColumn("pattern", F.concat(bit(F.col("a") <= F.col("b")), bit(F.col("a") <= F.col("d")), bit(F.col("b") <= F.col("d")))), KEYS, "pattern")
    return e.select(*KEYS, "n", r6(F.col("entropy") / F.log2(F.lit(6.0))).alias("entropy"))


@query(
    "sequence_rolling",
    f"""WITH {CLEAN}, r AS (SELECT doc_id, seq_name, i, avg(x) OVER w AS m, stddev_samp(x) OVER w AS s FROM c WINDOW w AS (PARTITION BY doc_id, seq_name ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT doc_id, seq_name, round(max(m) - min(m), 6) AS mean_range, round(avg(s), 6) AS mean_sd FROM r WHERE i >= 4 GROUP BY ALL""",
)
def sequence_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and deviations of windows of five."""
    w = Window.partitionBy(*KEYS).orderBy("i").rowsBetween(-4, 0)
    r = _seq(spark, sf_dir).select(*KEYS, "i", F.avg("x").over(w).alias("m"), F.stddev_samp("x").over(w).alias("s")).where("i >= 4")
    return r.groupBy(*KEYS).agg(r6(F.max("m") - F.min("m")).alias("mean_range"), r6(F.avg("s")).alias("mean_sd"))


@query(
    "sequence_change_point",
    f"""WITH {CLEAN}, p AS (SELECT doc_id, seq_name, i, i + 1 AS k, sum(x) OVER (PARTITION BY doc_id, seq_name ORDER BY i) AS s, sum(x) OVER (PARTITION BY doc_id, seq_name) AS t, count(*) OVER (PARTITION BY doc_id, seq_name) AS n FROM c),
g AS (SELECT doc_id, seq_name, k, round(abs(s / k - (t - s) / (n - k)) * sqrt(k * (n - k) / (n * 1.0)), 6) AS shift FROM p WHERE k < n)
SELECT doc_id, seq_name, CAST(k AS BIGINT) AS at, shift FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, seq_name ORDER BY shift DESC, k) = 1""",
)
def sequence_change_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of each sequence with the largest shift of the mean, weighed by both sides."""
    by = Window.partitionBy(*KEYS)
    p = _seq(spark, sf_dir).select(*KEYS, (F.col("i") + 1).alias("k"), F.sum("x").over(by.orderBy("i")).alias("s"), F.sum("x").over(by).alias("t"), F.count(F.lit(1)).over(by).alias("n")).where("k < n")
    k, n = F.col("k"), F.col("n")
    p = p.select(*KEYS, k.cast("bigint").alias("k"), r6(F.abs(F.col("s") / k - (F.col("t") - F.col("s")) / (n - k)) * F.sqrt(k * (n - k) / n)).alias("shift"))
    best = p.groupBy(*KEYS).agg(F.max(F.struct("shift", -F.col("k"))).alias("b"))
    return best.select(*KEYS, (-F.col("b.col2")).alias("at"), F.col("b.shift").alias("shift"))


@query("sequence_page_hinkley")
def sequence_page_hinkley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the Page-Hinkley detector (a state machine, so without SQL)."""
    return page_hinkley(_seq(spark, sf_dir))


def page_hinkley(seq: DataFrame, delta: float = 0.05, threshold: float = 5.0) -> DataFrame:
    """(doc_id, seq_name, n, events): upward drifts of the mean in deviations, the detector starting anew after each."""
    s = seq.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("a"), F.stddev_samp("x").alias("sd"))
    xs = F.transform("a", lambda r: r["x"] / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("cum"), F.lit(0.0).alias("low"), F.lit(0).alias("events"))

    def step(st, x):
        n = st["n"] + 1
        mean = st["mean"] + (x - st["mean"]) / n
        cum = st["cum"] + x - mean - delta
        low = F.least(st["low"], cum)
        hit = cum - low > threshold
        field = lambda v, name: F.when(hit, 0.0).otherwise(v).alias(name)
        return F.struct(field(n, "n"), field(mean, "mean"), field(cum, "cum"), field(low, "low"), (st["events"] + F.when(hit, 1).otherwise(0)).alias("events"))

    return s.select(*KEYS, F.size("a").cast("bigint").alias("n"), F.aggregate(xs, zero, step, lambda st: st["events"]).alias("events"))


# Numeric measures of one sequence. Each takes an array and gives a number or NaN.


def spectral(x: np.ndarray) -> dict[str, float]:
    """Entropy, centroid, flatness and peak of the periodogram of the centred sequence."""
    p = np.abs(np.fft.rfft(x - x.mean()))[1:] ** 2
    if len(p) < 2 or p.sum() <= 0:
        return dict.fromkeys(("spectral_entropy", "spectral_centroid", "spectral_flatness", "spectral_peak"), np.nan)
    f, q = np.fft.rfftfreq(len(x))[1:], p / p.sum()
    with np.errstate(divide="ignore"):
        return {
            "spectral_entropy": float(-(q[q > 0] * np.log2(q[q > 0])).sum() / np.log2(len(q))),
            "spectral_centroid": float((f * q).sum()),
            "spectral_flatness": float(np.exp(np.log(np.maximum(p, 1e-300)).mean()) / p.mean()),
            "spectral_peak": float(f[q.argmax()]),
        }


def hurst(x: np.ndarray) -> float:
    """Exponent of the rescaled range over window sizes."""
    sizes = [s for s in (8, 12, 16, 24, 32, 48, 64, 128, 256) if s <= len(x) // 2]
    pts = []
    for s in sizes:
        w = x[: len(x) // s * s].reshape(-1, s)
        y = np.cumsum(w - w.mean(1, keepdims=True), 1)
        sd = w.std(1)
        rs = (y.max(1) - y.min(1))[sd > 0] / sd[sd > 0]
        if len(rs):
            pts.append((np.log(s), np.log(rs.mean())))
    return float(np.polyfit(*np.array(pts).T, 1)[0]) if len(pts) >= 2 else np.nan


def dfa(x: np.ndarray) -> float:
    """Exponent of the fluctuation about local lines."""
    y = np.cumsum(x - x.mean())
    pts = []
    for s in [s for s in (4, 6, 8, 12, 16, 24, 32, 48, 64) if s <= len(x) // 4]:
        w = y[: len(y) // s * s].reshape(-1, s)
        t = np.arange(s) - (s - 1) / 2
        slope = (w * t).sum(1) / (t * t).sum()
        f = np.sqrt(((w - w.mean(1, keepdims=True) - slope[:, None] * t) ** 2).mean())
        if f > 0:
            pts.append((np.log(s), np.log(f)))
    return float(np.polyfit(*np.array(pts).T, 1)[0]) if len(pts) >= 2 else np.nan


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    """-ln of the chance that runs alike for m points stay alike for one more."""
    tol, n = r * x.std(), len(x)
    if n < m + 2 or tol <= 0:
        return np.nan
    count = []
    for k in (m, m + 1):
        e = np.lib.stride_tricks.sliding_window_view(x, k)[: n - m]
        rows, alike = max(1, MOST_PAIRS // len(e)), 0
        for a in range(0, len(e), rows):
            near = np.abs(e[a : a + rows, None, 0] - e[None, :, 0]) <= tol
            for j in range(1, k):
                near &= np.abs(e[a : a + rows, None, j] - e[None, :, j]) <= tol
            alike += int(near.sum())
        count.append((alike - len(e)) / 2)
    return float(-np.log(count[1] / count[0])) if count[0] and count[1] else np.nan


def lz_complexity(x: np.ndarray) -> float:
    """Lempel-Ziv phrases of the sequence cut at its median, over n / log2 n."""
    s = "".join("01"[int(v)] for v in x > np.median(x))
    i, k, phrases, seen = 0, 1, 0, 0
    while i + k <= len(s):
        # a longer phrase can't begin before the place where the shorter one was found
        at = s.find(s[i : i + k], seen, i + k - 1)
        if at >= 0:
            k, seen = k + 1, at
        else:
            phrases, i, k, seen = phrases + 1, i + k, 1, 0
    phrases += i < len(s)
    return float(phrases * np.log2(len(s)) / len(s)) if len(s) > 1 else np.nan


def _kth(parts: Callable[[], Iterator[np.ndarray]], k: int) -> float:
    """The k-th smallest of the numbers from 0 that parts gives anew each time: 16 bits a pass, as their bits are in the same order as they."""
    prefix, below = 0, 0
    for shift in (48, 32, 16, 0):
        held, n = np.zeros(1 << 16, np.int64), 0
        for d in parts():
            bits = (d + 0.0).view(np.int64)
            here = bits[bits >> shift >> 16 == prefix] >> shift & 0xFFFF if shift < 48 else bits >> 48
            held += np.bincount(here, minlength=1 << 16)
        upto = below + np.cumsum(held)
        digit = int(np.searchsorted(upto, k, "right"))
        prefix, below, n = prefix << 16 | digit, int(upto[digit] - held[digit]), int(held[digit])
        if shift and n <= MOST_PAIRS:
            left = np.concatenate([d[(d + 0.0).view(np.int64) >> shift == prefix] for d in parts()])
            return float(np.partition(left, k - below)[k - below])
    return float(np.array([prefix], np.int64).view(float)[0])


def _quantile(parts: Callable[[], Iterator[np.ndarray]], n: int, q: float) -> float:
    """np.quantile of the n numbers from 0 that parts gives anew each time, of which at most MOST_PAIRS are held at once."""
    if n <= MOST_PAIRS:
        return float(np.quantile(np.concatenate(list(parts())), q))
    k = int(q * (n - 1))
    low = _kth(parts, k)
    upto = sum(int((d <= low).sum()) for d in parts())
    high = low if upto > k + 1 else min(float(d[d > low].min(initial=np.inf)) for d in parts())
    return float(np.quantile([low, high], q * (n - 1) - k))


def higuchi(x: np.ndarray, kmax: int = 8) -> float:
    """Higuchi's fractal dimension."""
    n, pts = len(x), []
    for k in range(1, min(kmax, n // 2) + 1):
        lengths = []
        for m in range(k):
            w = x[m::k]
            if len(w) > 1:
                lengths.append(np.abs(np.diff(w)).sum() * (n - 1) / ((len(w) - 1) * k * k))
        if lengths and np.mean(lengths) > 0:
            pts.append((np.log(1 / k), np.log(np.mean(lengths))))
    return float(np.polyfit(*np.array(pts).T, 1)[0]) if len(pts) >= 2 else np.nan


def measures(x: np.ndarray) -> dict[str, float]:
    return spectral(x) | {"hurst": hurst(x), "dfa": dfa(x), "sample_entropy": sample_entropy(x), "lz_complexity": lz_complexity(x), "higuchi": higuchi(x)}


def numeric_features(seq: DataFrame, least: int = 12, compute: Callable[[np.ndarray], dict[str, float]] = measures) -> DataFrame:
    """(doc_id, seq_name, feature, value): measures that need the whole sequence at once. A sequence belongs to one text, and is as long as it."""
    arrays = seq.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("a")).where(F.size("a") >= least).select(*KEYS, F.transform("a", lambda r: r["x"]).alias("xs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, s, xs in zip(*(c.to_pylist() for c in b.columns)):
                out += [(i, s, k, round(v, 6)) for k, v in compute(np.array(xs, float)).items() if np.isfinite(v)]
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64())], [*KEYS, "feature", "value"])

    return arrays.mapInArrow(run, "doc_id bigint, seq_name string, feature string, value double")


@query("sequence_numeric_features")
def sequence_numeric_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra, fractal dimensions and entropies of each sequence (numeric routines, so without SQL)."""
    return numeric_features(_seq(spark, sf_dir))


@query(
    "sequence_cross_correlation",
    f"""WITH {CLEAN}, p AS (SELECT a.doc_id, a.seq_name AS a, b.seq_name AS b, b.i - a.i AS lag, count(*) AS n, corr(a.x, b.x) AS r FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.seq_name < b.seq_name AND b.i - a.i BETWEEN -3 AND 3 GROUP BY ALL HAVING count(*) >= 8 AND stddev_pop(a.x) > 1e-9 AND stddev_pop(b.x) > 1e-9)
SELECT doc_id, a, b, CAST(lag AS BIGINT) AS lag, round(r, 6) + 0.0 AS r FROM p""",
)
def sequence_cross_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of two sequences of a document at lags of up to three."""
    a = _seq(spark, sf_dir)
    b = a.select("doc_id", F.col("seq_name").alias("b"), F.col("i").alias("j"), F.col("x").alias("y"))
    lagged = a.withColumn("lag", F.explode(F.array(*map(F.lit, range(-3, 4))))).withColumn("j", F.col("i") + F.col("lag"))
    p = lagged.join(b, ["doc_id", "j"]).where("seq_name < b").groupBy("doc_id", F.col("seq_name").alias("a"), "b", F.col("lag").cast("bigint").alias("lag"))
    p = p.agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")).where("n >= 8 and sx > 1e-9 and sy > 1e-9")
    return p.select("doc_id", "a", "b", "lag", r6("r").alias("r"))
