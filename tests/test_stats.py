"""The statistics kernel against numpy on small samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from proselake.functions import stats
from proselake.functions.ordered import cumulative
from proselake.operators import sequence_features as SF
from proselake.operators import sequences as S
from proselake.operators.compare import compare, corpus_stats, ecdf_distances, located


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, float(x)) for g in ("a", "b", None) for i, x in enumerate(np.r_[rng.normal(0, 1, 80), np.round(rng.normal(0, 2, 40)), 0, 0])]
    rows += [("a", 900, None), ("a", 901, float("nan")), ("b", 902, float("inf")), ("one", 0, 5.0), ("flat", 0, 2.0), ("flat", 1, 2.0), ("flat", 2, 2.0), ("flat", 3, 2.0)]
    return rows, spark.createDataFrame(rows, "g string, i int, x double").cache()


def test_summarize(sample):
    rows, df = sample
    got = {r.g: r for r in stats.summarize(df, ["g"], "x").collect()}
    for g in ("a", None):
        v = np.array([x for k, _, x in rows if k == g and x is not None and np.isfinite(x)])
        r = got[g]
        assert r.n == len(v) and r.mean == pytest.approx(v.mean()) and r.sd == pytest.approx(v.std(ddof=1)) and r.median == pytest.approx(np.median(v))
        assert r.p10 == pytest.approx(np.quantile(v, 0.1)) and r.mad == pytest.approx(np.median(np.abs(v - np.median(v))))
        n, d = len(v), v - v.mean()
        assert r.skewness == pytest.approx(np.sqrt(n * (n - 1)) / (n - 2) * (d**3).mean() / (d**2).mean() ** 1.5)
    assert got["flat"].skewness == 0 and got["one"].skewness is None and got["one"].mad == 0


def test_autocorrelation_and_runs(sample, spark):
    rows, df = sample
    v = np.array([x for k, _, x in rows if k is None])
    d = v - v.mean()
    r = next(r for r in stats.autocorrelation(df.where("g is null"), ["g"], "i", "x").collect())
    assert r.acf1 == pytest.approx((d[:-1] * d[1:]).sum() / (d * d).sum()) and r.acf3 == pytest.approx((d[:-3] * d[3:]).sum() / (d * d).sum())
    flat = stats.autocorrelation(df.where("g = 'flat'"), ["g"], "i", "x").first()
    assert flat.acf1 is None
    lab = spark.createDataFrame([("k", i, c) for i, c in enumerate("aabbbac")] + [("n", 0, None), ("n", 1, None)], "k string, i int, l string")
    runs = sorted((r.k, r.start, r.l, r.length) for r in stats.run_lengths(lab, ["k"], "i", "l").collect())
    assert runs == [("k", 0, "a", 2), ("k", 2, "b", 3), ("k", 5, "a", 1), ("k", 6, "c", 1), ("n", 0, None, 2)]


def test_gini_and_entropy(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), ("b", 0), ("b", 0), ("b", 9)], "k string, x int")
    g = {r.k: r.gini for r in stats.gini(df, ["k"], "x").collect()}
    assert g["a"] == pytest.approx(0) and g["b"] == pytest.approx(2 / 3)
    e = {r.k: r.entropy for r in stats.entropy_of_counts(df, ["k"], "x").collect()}
    assert e["a"] == pytest.approx(0) and e["b"] == pytest.approx(-(2 / 3) * np.log2(2 / 3) - (1 / 3) * np.log2(1 / 3))


def test_cumulative_is_exact_over_slices(spark):
    rng = np.random.default_rng(2)
    v = np.r_[rng.lognormal(0, 4, 500), -rng.lognormal(0, 4, 500), np.zeros(20), np.round(rng.normal(0, 3, 300))]
    df = spark.createDataFrame([("k", float(x)) for x in v], "k string, x double")
    rows = cumulative(df, ["k"], "x", {"n": F.lit(1)}).orderBy("x").collect()
    u, c = np.unique(v, return_counts=True)
    assert [r.x for r in rows] == u.tolist() and [r.upto_n for r in rows] == np.cumsum(c).tolist()
    assert [r.next for r in rows] == [*u[1:].tolist(), None]


def test_ecdf_distances(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(0, 1, 200), rng.normal(0.5, 2, 30)
    rows = [("c", "m", float(x), 1, 0) for x in a] + [("c", "m", float(x), 0, 1) for x in b]
    r = ecdf_distances(spark.createDataFrame(rows, "corpus string, metric_id string, value double, f int, g int")).first()
    grid = np.sort(np.r_[a, b])
    gap = np.searchsorted(np.sort(a), grid, "right") / 200 - np.searchsorted(np.sort(b), grid, "right") / 30
    assert r.ks == pytest.approx(np.abs(gap).max(), abs=1e-6) and r.wasserstein == pytest.approx((np.abs(gap)[:-1] * np.diff(grid)).sum(), rel=1e-6)


def test_located(spark):
    """Counts below and at each point against a plain count, with ties, hot values and points outside the values."""
    rng = np.random.default_rng(2)
    dist = np.r_[np.round(rng.normal(0, 3, 300)), np.zeros(50), 1e9]
    points = [-1e12, -2.0, 0.0, 0.0, 0.5, 3.0, 1e9, 1e12]
    d = spark.createDataFrame([("g", float(x)) for x in dist], "g string, x double")
    got = {r.x: (r.lt, r.le) for r in located(spark.createDataFrame([("g", x) for x in points], "g string, x double"), d, ["g"], "x").collect()}
    assert all(got[x] == ((dist < x).sum(), (dist <= x).sum()) for x in points)


@pytest.mark.parametrize("ref,value,method,severity", [
    ([3, 3, 3, 3, 5, 9, 3, 3], 5, "empirical percentile", None), ([2.0] * 9, 2, "constant", 0.0), ([2.0] * 9, 3, "constant", 10.0), ([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], 5.5, "median/double-MAD", 0.0), ([0, 0, 0, 0, 0, 0, 1, 2, 3, 4, 5], 9, "median/IQR", None),
])
def test_compare_ladder(spark, ref, value, method, severity):
    dist = spark.createDataFrame([("p", "m", f"o{i}", float(x)) for i, x in enumerate(ref)] + [("p", "m", "null", None)], "profile string, metric_id string, obs_id string, value double")
    f = spark.createDataFrame([(1, "m", "p", float(value)), (2, "m", "p", None), (3, "x", "p", 1.0)], "doc_id bigint, metric_id string, corpus string, value double")
    (r,) = compare(f, dist).collect()
    if method == "empirical percentile":
        assert r.method in ("empirical percentile", "median/IQR", "median/double-MAD")
    else:
        assert r.method == method
    if severity is not None:
        assert r.severity == pytest.approx(severity)
    assert 0 <= r.percentile <= 100 and r.severity <= 10


def test_small_corpus_calls_no_outlier(spark):
    dist = spark.createDataFrame([("p", "m", f"o{i}", float(i)) for i in range(5)], "profile string, metric_id string, obs_id string, value double")
    r = compare(spark.createDataFrame([(1, "m", "p", 100.0)], "doc_id bigint, metric_id string, corpus string, value double"), dist).first()
    assert r.outlier is None and r.confidence == "none" and corpus_stats(dist).first().n == 5


def test_sequence_measures():
    t = np.arange(128)
    rng = np.random.default_rng(0)
    sine, noise, flat = np.sin(t / 4), rng.normal(size=128), np.ones(128)
    assert S.spectral(sine)["spectral_entropy"] < 0.5 < S.spectral(noise)["spectral_entropy"]
    assert S.sample_entropy(sine) < S.sample_entropy(noise)
    assert SF.recurrence(sine)["rqa_determinism"] > SF.recurrence(noise)["rqa_determinism"]
    assert np.isnan(S.spectral(flat)["spectral_entropy"]) and np.isnan(S.sample_entropy(flat)) and np.isnan(S.dfa(flat)) and np.isnan(S.hurst(flat[:5]))
    assert S.dfa(np.cumsum(noise)) > S.dfa(noise) and S.lz_complexity(noise) > S.lz_complexity(sine) and 1 < S.higuchi(sine) < S.higuchi(noise) < 2.3


def test_page_hinkley(spark):
    rows = [(1, "s", i, 0.0 if i < 50 else 4.0) for i in range(100)] + [(2, "s", i, 1.0) for i in range(100)]
    seq = S.clean(spark.createDataFrame([*rows, (1, "s", 3, None), (1, "s", 4, float("nan")), (1, "s", 5, 0.0)], "doc_id bigint, seq_name string, idx int, value double"))
    got = {r.doc_id: r.events for r in S.page_hinkley(seq).collect()}
    assert got[1] >= 1 and got[2] == 0


def test_long_sequences_use_all_points(monkeypatch):
    """Against the whole matrices of distances, beyond 1500 points; also with few distances held at once."""
    rng = np.random.default_rng(3)
    for x in (np.sin(np.arange(1700) / 5) + rng.normal(0, 0.3, 1700), rng.integers(0, 4, 1600).astype(float)):
        near = [np.abs(x[: len(x) - 2, None] - x[None, : len(x) - 2]) <= 0.2 * x.std()]
        for j in (1, 2):
            near.append(near[-1] & (np.abs(x[j : len(x) - 2 + j, None] - x[None, j : len(x) - 2 + j]) <= 0.2 * x.std()))
        pairs = [(v.sum() - len(v)) / 2 for v in near]
        d = np.sqrt((x[:-1, None] - x[None, :-1]) ** 2 + (x[1:, None] - x[None, 1:]) ** 2)
        r = np.triu(d <= np.quantile(d[np.triu_indices(len(d), 2)], 0.05), 2)
        # points of runs of two or more: those with a neighbour along the run
        p, both = np.pad(r, 1), r | r.T
        q = np.pad(both, 1)
        diag, vert = p[:-2, :-2] | p[2:, 2:], q[:-2, 1:-1] | q[2:, 1:-1]
        want = {"rqa_determinism": (r & diag).sum() / r.sum(), "rqa_laminarity": (both & vert).sum() / both.sum()}
        for most in (1 << 21, 5000):
            monkeypatch.setattr(S, "MOST_PAIRS", most, raising=False)
            assert S.sample_entropy(x) == pytest.approx(-np.log(pairs[2] / pairs[1]))
            got = SF.recurrence(x)
            assert {k: got[k] for k in want} == pytest.approx(want)
