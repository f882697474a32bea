"""Further measures of one sequence: spectra by Welch's method, multiscale and wavelet measures, entropies of embeddings,
exponents, recurrence, adaptive windows; and of pairs: coherence and phase. Each takes an array and gives a number or NaN."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations
from math import factorial, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.functions import stats
from proselake.operators import sequences as S
from proselake.operators.conversation import TURNS, clean_turns
from proselake.plans.registry import query, r6
from proselake.session import table

NAN = float("nan")


def autocovariances(x: np.ndarray, most: int) -> np.ndarray:
    d = x - x.mean()
    return np.array([d[k:] @ d[: len(d) - k] for k in range(most + 1)]) / len(x)


def pacf(x: np.ndarray, most: int = 5) -> dict[str, float]:
    """Partial autocorrelations by the Durbin-Levinson recursion."""
    out = {f"pacf{k}": NAN for k in range(1, most + 1)}
    c = autocovariances(x, min(most, len(x) - 2))
    if len(c) < 2 or c[0] <= 1e-18:
        return out
    r, phi, err = c / c[0], np.zeros(0), 1.0
    for k in range(1, len(r)):
        if err <= 1e-12:
            break
        a = (r[k] - phi @ r[k - 1 : 0 : -1]) / err if k > 1 else r[1]
        phi, err = np.r_[phi - a * phi[::-1], a], err * (1 - a * a)
        out[f"pacf{k}"] = float(a)
    return out


def welch(x: np.ndarray, y: np.ndarray | None = None, length: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, cross power of x and y or power of x): means over half-overlapping Hann windows, each centred."""
    y = x if y is None else y
    n = min(length, len(x), len(y))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    starts = range(0, min(len(x), len(y)) - n + 1, max(1, n - n // 2))
    p = np.mean([np.conj(np.fft.rfft(w * (x[a : a + n] - x[a : a + n].mean()))) * np.fft.rfft(w * (y[a : a + n] - y[a : a + n].mean())) for a in starts], 0) / (w * w).sum()
    p[1 : len(p) - (n % 2 == 0)] *= 2
    return np.fft.rfftfreq(n), p


def welch_measures(x: np.ndarray) -> dict[str, float]:
    """Of the power above frequency 0: entropy, peak, centroid, bandwidth, flatness, rolloff, and the shares of three bands."""
    f, p = welch(x)
    f, p = f[1:], np.real(p[1:])
    names = ("entropy", "peak", "centroid", "bandwidth", "flatness", "rolloff", "low", "mid", "high")
    if len(p) < 2 or p.sum() <= 1e-18:
        return {f"welch_{k}": NAN for k in names}
    q = p / p.sum()
    c = float(f @ q)
    edge = np.searchsorted(np.cumsum(q), 0.85 - 1e-12)
    band = np.minimum((f / 0.5 * 3).astype(int), 2)
    shares = np.bincount(band, q, 3)
    values = (
        float(-(q[q > 0] @ np.log2(q[q > 0])) / log2(len(q))), float(f[q.argmax()]), c, float(np.sqrt(((f - c) ** 2) @ q)), float(np.exp(np.log(np.maximum(p, 1e-300)).mean()) / p.mean()), float(f[min(edge, len(f) - 1)]), *map(float, shares)
    )
    return {f"welch_{k}": v for k, v in zip(names, values)}


def peaks(x: np.ndarray) -> dict[str, float]:
    """Peaks (plateaus once) per hundred points, their mean prominence and distance."""
    step = np.flatnonzero(np.diff(x) != 0)
    at = [int((a + 1 + b) // 2) for a, b in zip(step, step[1:]) if x[a + 1] > x[a] and x[b + 1] < x[b]]
    out = {"peak_rate": 100.0 * len(at) / len(x), "peak_prominence": NAN, "peak_distance": float(np.diff(at).mean()) if len(at) > 1 else NAN}
    if at:
        # the lowest point towards the next higher point on each side, by a stack of falling heights
        def base(order: list[int]) -> dict[int, float]:
            found, stack = {}, []
            for i in order:
                low = x[i]
                while stack and stack[-1][0] <= x[i]:
                    low = min(low, stack.pop()[1])
                found[i] = low
                stack.append((x[i], low))
            return found

        left, right = base(list(range(len(x)))), base(list(range(len(x) - 1, -1, -1)))
        out["peak_prominence"] = float(np.mean([x[i] - max(left[i], right[i]) for i in at]))
    return out


def cepstral_peak(x: np.ndarray) -> float:
    """Height of the highest peak of the real cepstrum over its median, from two points to half the length."""
    p = np.abs(np.fft.rfft(x - x.mean()))
    if len(x) < 8 or p.max() <= 1e-12:
        return NAN
    c = np.abs(np.fft.irfft(np.log(np.maximum(p, 1e-12)), len(x)))[2 : len(x) // 2]
    return float(c.max() - np.median(c)) if len(c) else NAN


def multiscale_variance(x: np.ndarray) -> float:
    """Slope of the log variance of block means over the log of the block."""
    pts = []
    for s in (1, 2, 4, 8, 16, 32):
        w = x[: len(x) // s * s].reshape(-1, s).mean(1)
        if len(w) >= 4 and w.var() > 1e-18:
            pts.append((log(s), log(w.var())))
    return _slope(pts)


def haar(x: np.ndarray) -> dict[str, float]:
    """Largest share and normalised entropy of the energy of the levels of Haar's wavelet transform."""
    a, energy = x - x.mean(), []
    while len(a) >= 2:
        a = a[: len(a) // 2 * 2].reshape(-1, 2)
        energy.append(float(((a[:, 0] - a[:, 1]) ** 2).sum() / 2))
        a = a.sum(1) / np.sqrt(2)
    e = np.array(energy)
    if len(e) < 2 or e.sum() <= 1e-18:
        return {"wavelet_energy": NAN, "wavelet_entropy": NAN}
    q = e / e.sum()
    return {"wavelet_energy": float(q.max()), "wavelet_entropy": float(-(q[q > 0] @ np.log2(q[q > 0])) / log2(len(q)))}


def petrosian(x: np.ndarray) -> float:
    d = np.diff(x)
    turns = int((d[1:] * d[:-1] < 0).sum())
    n = len(x)
    return float(np.log10(n) / (np.log10(n) + np.log10(n / (n + 0.4 * turns))))


def _blocks(e: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Largest coordinate distances of each embedded point from all others, in blocks of rows."""
    rows = max(1, S.MOST_PAIRS // max(1, len(e)))
    for a in range(0, len(e), rows):
        d = np.abs(e[a : a + rows, None, 0] - e[None, :, 0])
        for j in range(1, e.shape[1]):
            np.maximum(d, np.abs(e[a : a + rows, None, j] - e[None, :, j]), out=d)
        yield a, d


def _embedded(x: np.ndarray, m: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, m)


def approximate_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    tol = r * x.std()
    if len(x) < m + 2 or tol <= 0:
        return NAN
    phi = []
    for k in (m, m + 1):
        e = _embedded(x, k)
        phi.append(sum(float(np.log((d <= tol).mean(1)).sum()) for _, d in _blocks(e)) / len(e))
    return float(phi[0] - phi[1])


def fuzzy_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    """As the sample entropy, with exponential membership of the distance of centred runs instead of a threshold."""
    tol, n = r * x.std(), len(x)
    if n < m + 2 or tol <= 0:
        return NAN
    phi = []
    for k in (m, m + 1):
        e = _embedded(x, k)[: n - m]
        e = e - e.mean(1, keepdims=True)
        phi.append((sum(float(np.exp(-((d / tol) ** 2)).sum()) for _, d in _blocks(e)) - len(e)) / (len(e) * (len(e) - 1)))
    return float(log(phi[0]) - log(phi[1])) if phi[0] > 0 and phi[1] > 0 else NAN


def dispersion_entropy(x: np.ndarray, classes: int = 4, m: int = 2) -> float:
    """Normalised entropy of patterns of the classes that the normal distribution function cuts the values into."""
    if x.std() <= 0 or len(x) < m + 1:
        return NAN
    from math import erf

    u = np.array([0.5 * (1 + erf(v / np.sqrt(2))) for v in (x - x.mean()) / x.std()])
    z = np.clip(np.round(classes * u + 0.5), 1, classes).astype(int)
    c = np.array(list(Counter(map(tuple, _embedded(z, m).tolist())).values()), float)
    q = c / c.sum()
    return float(-(q @ np.log(q)) / log(classes**m))


def ordinal_complexity(x: np.ndarray, order: int = 3) -> float:
    """Jensen-Shannon complexity of the orders of successive values."""
    if len(x) < order + 1:
        return NAN
    kinds = {p: i for i, p in enumerate(permutations(range(order)))}
    c = np.zeros(len(kinds))
    for p in np.argsort(_embedded(x, order), 1, kind="stable").tolist():
        c[kinds[tuple(p)]] += 1
    p, n = c / c.sum(), factorial(order)
    h = lambda q: float(-(q[q > 0] @ np.log(q[q > 0])))
    js = h((p + 1 / n) / 2) - h(p) / 2 - log(n) / 2
    most = -0.5 * ((n + 1) / n * log(n + 1) - 2 * log(2 * n) + log(n))
    return float(js / most * h(p) / log(n))


def correlation_dimension(x: np.ndarray, m: int = 3) -> float:
    """Slope of the log share of near pairs over the log radius (Grassberger and Procaccia)."""
    if len(x) < 30 or x.std() <= 0:
        return NAN
    e = _embedded(x, m)
    radii = x.std() * 0.1 * 1.25 ** np.arange(10)
    near = np.zeros(len(radii))
    for _, d in _blocks(e):
        near += [(d <= r).sum() for r in radii]
    share = (near - len(e)) / (len(e) * (len(e) - 1))
    return _slope([(log(r), log(s)) for r, s in zip(radii, share) if s > 0])


def lyapunov(x: np.ndarray, m: int = 3, steps: int = 10, apart: int = 10) -> float:
    """Largest exponent by Rosenstein: how fast nearest neighbours, apart in time, move away from one another; from 200 points on."""
    if len(x) < 200 or x.std() <= 0:
        return NAN
    e = _embedded(x, m)
    last = len(e) - steps
    near = np.zeros(last, int)
    for a, d in _blocks(e[:last]):
        for i in range(len(d)):
            d[i, max(0, a + i - apart) : a + i + apart + 1] = np.inf
        near[a : a + len(d)] = d.argmin(1)
    pts = []
    for k in range(steps):
        d = np.abs(e[np.arange(last) + k] - e[near + k]).max(1)
        if (d > 0).any():
            pts.append((k, float(np.log(d[d > 0]).mean())))
    return _slope(pts)


def adwin(x: np.ndarray, delta: float = 0.002, per_row: int = 5) -> float:
    """Events per hundred points of the adaptive window: whenever two parts of it differ in mean by more than chance allows,
    the older part is dropped. The window is kept as buckets of doubling size, so a point costs the log of the window."""
    rows: list[list[tuple[float, float, int]]] = [[]]  # buckets of 2**i points: sum, sum of squares, points; newest last
    events = 0
    for t, v in enumerate(x, 1):
        rows[0].append((float(v), float(v * v), 1))
        i = 0
        while len(rows[i]) > per_row:
            if i + 1 == len(rows):
                rows.append([])
            (a, b), rows[i] = rows[i][:2], rows[i][2:]
            rows[i + 1].append((a[0] + b[0], a[1] + b[1], a[2] + b[2]))
            i += 1
        shrunk = t % 32 == 0
        while shrunk:
            shrunk = False
            parts = [b for row in reversed(rows) for b in row]
            s, ss, n = (sum(p[j] for p in parts) for j in range(3))
            var, s0, n0 = max(0.0, ss / n - (s / n) ** 2), 0.0, 0
            for p in parts[:-1]:
                s0, n0 = s0 + p[0], n0 + p[2]
                n1 = n - n0
                if n0 < 5 or n1 < 5:
                    continue
                h, k = 1 / (1 / n0 + 1 / n1), log(2 * log(max(n, 3)) / delta)
                if abs(s0 / n0 - (s - s0) / n1) > np.sqrt(2 / h * var * k) + 2 / (3 * h) * k:
                    events += 1
                    top = next(r for r in reversed(rows) if r)
                    top.pop(0)
                    shrunk = True
                    break
    return 100.0 * events / len(x)


def recurrence(x: np.ndarray, rate: float = 0.05) -> dict[str, float]:
    """Recurrence quantification of the sequence embedded in two dimensions, at the threshold that gives the rate; one
    diagonal or column of the matrix of distances at a time, leaving out neighbours in time."""
    names = "rate threshold determinism mean_diagonal longest_diagonal diagonal_entropy laminarity trapping_time longest_vertical recurrence_time trend".split()
    if len(x) < 12 or x.std() == 0:
        return {f"rqa_{k}": NAN for k in names}
    a, b, n = x[:-1], x[1:], len(x) - 1
    away = lambda k: np.sqrt((a[k:] - a[: n - k]) ** 2 + (b[k:] - b[: n - k]) ** 2)
    diagonals = lambda: (away(k) for k in range(2, n))
    pairs = (n - 1) * (n - 2) // 2
    most = S._quantile(diagonals, pairs, rate)
    runs = lambda v: np.diff(np.flatnonzero(np.diff(np.r_[0, v.astype(np.int8), 0])).reshape(-1, 2), axis=1).ravel()
    lengths: Counter = Counter()
    density, total = [], 0
    for k, d in enumerate(diagonals(), 2):
        hit = d <= most
        total += int(hit.sum())
        density.append((k, float(hit.mean())))
        lengths.update(runs(hit).tolist())
    upright: Counter = Counter()
    waits, gaps = 0, 0
    for k in range(n):
        hit = np.sqrt((a - a[k]) ** 2 + (b - b[k]) ** 2) <= most
        hit[max(0, k - 1) : k + 2] = False
        upright.update(runs(hit).tolist())
        at = np.flatnonzero(hit)
        if len(at) > 1:
            waits, gaps = waits + int(at[-1] - at[0]), gaps + len(at) - 1
    long_, tall = {k: c for k, c in lengths.items() if k >= 2}, {k: c for k, c in upright.items() if k >= 2}
    points = lambda d: sum(k * c for k, c in d.items())
    kinds = np.array(list(long_.values()), float)
    q = kinds / kinds.sum() if len(kinds) else kinds
    values = (
        100.0 * total / pairs, most / x.std(), points(long_) / max(1, total), points(long_) / kinds.sum() if long_ else NAN, float(max(lengths, default=0)), float(-(q @ np.log2(q))) if long_ else NAN,
        points(tall) / max(1, points(upright)), points(tall) / sum(tall.values()) if tall else NAN, float(max(upright, default=0)), waits / gaps if gaps else NAN, _slope(density),
    )
    return {f"rqa_{k}": float(v) for k, v in zip(names, values)}


def _slope(pts: list[tuple[float, float]]) -> float:
    return float(np.polyfit(*np.array(pts).T, 1)[0]) if len(pts) >= 2 else NAN


def features(x: np.ndarray) -> dict[str, float]:
    """All measures of this module for one sequence."""
    single = {
        "cepstral_peak": cepstral_peak(x), "multiscale_variance": multiscale_variance(x), "petrosian": petrosian(x), "approximate_entropy": approximate_entropy(x), "fuzzy_entropy": fuzzy_entropy(x), "dispersion_entropy": dispersion_entropy(x),
        "ordinal_complexity": ordinal_complexity(x), "correlation_dimension": correlation_dimension(x), "lyapunov": lyapunov(x), "adwin_rate": adwin(x),
    }
    return single | pacf(x) | welch_measures(x) | peaks(x) | haar(x) | recurrence(x)


@query("sequence_dynamics")
def sequence_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra, entropies, exponents, recurrence and drift of each sequence of twelve points or more (numeric routines, so without SQL)."""
    return S.numeric_features(S.clean(table(spark, sf_dir, "sequences")), compute=features)


def coherence(x: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Mean squared coherence over the frequencies above 0, and phase at the frequency of the greatest cross power.

    Windows of a quarter of the points, as the coherence of a single window is always one.
    """
    n = max(8, min(256, len(x) // 4))
    _, pxx = welch(x, length=n)
    _, pyy = welch(y, length=n)
    _, pxy = welch(x, y, n)
    both = np.real(pxx[1:]) * np.real(pyy[1:])
    if not (both > 1e-24).any():
        return {"coherence": NAN, "cross_phase": NAN}
    c = np.abs(pxy[1:]) ** 2 / np.where(both > 1e-24, both, 1)
    return {"coherence": float(c[both > 1e-24].mean()), "cross_phase": float(np.angle(pxy[1:][np.abs(pxy[1:]).argmax()]))}


@query("sequence_coherence")
def sequence_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherence and phase of each two sequences of a document over the places both have (sixteen at least)."""
    s = S.clean(table(spark, sf_dir, "sequences"))
    a = s.groupBy("doc_id", "seq_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("xs"))
    b = a.select("doc_id", F.col("seq_name").alias("b"), F.col("xs").alias("ys"))
    p = a.withColumnRenamed("seq_name", "a").join(b, "doc_id").where("a < b").where(F.least(F.size("xs"), F.size("ys")) >= 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, a, b, xs, ys in zip(*(c.to_pylist() for c in batch.columns)):
                n = min(len(xs), len(ys))
                out += [(i, a, b, k, round(v, 6)) for k, v in coherence(np.array(xs[:n]), np.array(ys[:n])).items() if np.isfinite(v)]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64()))], ["doc_id", "a", "b", "feature", "value"])

    return p.select("doc_id", "a", "b", "xs", "ys").mapInArrow(run, "doc_id bigint, a string, b string, feature string, value double")


@query(
    "sequence_summary",
    f"""WITH {S.CLEAN}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, seq_name) AS n FROM c), m AS (SELECT doc_id, seq_name, quantile_cont(x, 0.5) AS med FROM c GROUP BY ALL),
g AS (SELECT doc_id, seq_name, any_value(n) AS n, corr(x, i) FILTER (i < n // 2) AS r1, corr(x, i) FILTER (i >= n - n // 2) AS r2, avg(x) FILTER (i < n // 2) AS m1, avg(x) FILTER (i >= n // 2) AS m2, stddev_pop(x) AS sd, stddev_pop(x) FILTER (i < n // 2) AS s1, stddev_pop(x) FILTER (i >= n - n // 2) AS s2, avg(x) AS mean, var_samp(x) AS variance FROM n GROUP BY ALL),
l AS (SELECT c.doc_id, c.seq_name, i, sign(x - med) AS side, row_number() OVER (PARTITION BY c.doc_id, c.seq_name ORDER BY i) - row_number() OVER (PARTITION BY c.doc_id, c.seq_name, sign(x - med) ORDER BY i) AS isle FROM c JOIN m USING (doc_id, seq_name)),
k AS (SELECT doc_id, seq_name, max(k) AS longest FROM (SELECT doc_id, seq_name, side, isle, count(*) AS k FROM l GROUP BY ALL) GROUP BY ALL),
r AS (SELECT doc_id, seq_name, quantile_cont(s, 0.5) AS rolling FROM (SELECT doc_id, seq_name, i, stddev_pop(x) OVER (PARTITION BY doc_id, seq_name ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS s FROM c) WHERE i >= 9 GROUP BY ALL)
SELECT doc_id, seq_name, n, round(mean, 10) + 0.0 AS mean, round(variance, 5) + 0.0 AS variance, round(CASE WHEN n >= 6 AND s1 > 1e-9 AND s2 > 1e-9 THEN r2 - r1 END + 0.0, 6) AS trend_change, round(CASE WHEN sd > 1e-9 THEN abs(m2 - m1) / sd END, 6) AS half_shift, round(100.0 * longest / n, 6) AS longest_run_share, round(rolling, 6) AS rolling_sd
FROM g JOIN k USING (doc_id, seq_name) LEFT JOIN r USING (doc_id, seq_name)""",
)
def sequence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and variance, change of the trend between halves, shift of the mean between halves (stationarity), longest run on
    one side of the median, and the median deviation of windows of ten."""
    by = Window.partitionBy(*S.KEYS)
    c = S.clean(table(spark, sf_dir, "sequences")).withColumn("n", F.count(F.lit(1)).over(by)).withColumn("med", F.percentile("x", F.lit(0.5)).over(by))
    half = F.floor(F.col("n") / 2)
    one, two, tail = F.col("i") < half, F.col("i") >= F.col("n") - half, F.col("i") >= half
    when = lambda w, x: F.when(w, F.col(x))
    side = F.signum(F.col("x") - F.col("med"))
    c = c.withColumn("side", side).withColumn("isle", F.row_number().over(by.orderBy("i")) - F.row_number().over(Window.partitionBy(*S.KEYS, "side").orderBy("i")))
    c = c.withColumn("roll", F.when(F.col("i") >= 9, F.stddev_pop("x").over(by.orderBy("i").rowsBetween(-9, 0)))).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy(*S.KEYS, "side", "isle")))
    g = c.groupBy(*S.KEYS, "n").agg(
        F.avg("x").alias("mean"), F.var_samp("x").alias("variance"), F.corr(when(one, "x"), when(one, "i")).alias("r1"), F.corr(when(two, "x"), when(two, "i")).alias("r2"), F.stddev_pop(when(one, "x")).alias("s1"), F.stddev_pop(when(two, "x")).alias("s2"),
        F.avg(when(one, "x")).alias("m1"), F.avg(when(tail, "x")).alias("m2"), F.stddev_pop("x").alias("sd"), F.max("k").alias("longest"), F.percentile("roll", F.lit(0.5)).alias("rolling"),
    )
    return g.select(
        *S.KEYS, "n", (F.round("mean", 10) + F.lit(0.0)).alias("mean"), (F.round("variance", 5) + F.lit(0.0)).alias("variance"), r6(F.when((F.col("n") >= 6) & (F.col("s1") > 1e-9) & (F.col("s2") > 1e-9), F.col("r2") - F.col("r1"))).alias("trend_change"),
        r6(F.when(F.col("sd") > 1e-9, F.abs(F.col("m2") - F.col("m1")) / F.col("sd"))).alias("half_shift"), r6(100.0 * F.col("longest") / F.col("n")).alias("longest_run_share"), r6("rolling").alias("rolling_sd"),
    )


@query(
    "label_transitions",
    f"""WITH {TURNS}, l AS (SELECT doc_id, turn_idx, label, lag(label) OVER (PARTITION BY doc_id ORDER BY turn_idx) AS before FROM t WHERE label IS NOT NULL),
p AS (SELECT doc_id, before, label, count(*) AS c FROM l WHERE before IS NOT NULL GROUP BY ALL), e AS (SELECT doc_id, sum(c) AS pairs, sum(CASE WHEN before <> label THEN c ELSE 0 END) AS changes, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM p GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT doc_id, n, round(100.0 * changes / pairs, 6) AS transition_rate, round(entropy, 6) + 0.0 AS transition_entropy, round(1.0 * n / (changes + 1), 6) AS dwell FROM n JOIN e USING (doc_id)""",
)
def label_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nominal sequence (topics, labels): share of places where it changes, entropy of its transitions, mean stay."""
    t = clean_turns(table(spark, sf_dir, "turns")).where("label is not null").select("doc_id", "turn_idx", "label")
    return transitions(t, "turn_idx", "label")


def transitions(rows: DataFrame, order: str, label: str) -> DataFrame:
    """(doc_id, n, transition_rate, transition_entropy, dwell) of the labels of each document in order; of one label alone none."""
    l = rows.withColumn("before", F.lag(label).over(Window.partitionBy("doc_id").orderBy(order)))  # noqa: E741
    n = l.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("before") != F.col(label), 1).otherwise(0)).alias("changes"))
    e = stats.entropy_of_counts(l.where("before is not null").withColumn("pair", F.struct("before", label)), ["doc_id"], "pair").select("doc_id", F.col("n").alias("pairs"), "entropy")
    return n.join(e, "doc_id").select("doc_id", "n", r6(100.0 * F.col("changes") / F.col("pairs")).alias("transition_rate"), r6("entropy").alias("transition_entropy"), r6(F.col("n") / (F.col("changes") + 1)).alias("dwell"))
