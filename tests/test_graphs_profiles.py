"""Graphs, pair statistics, detectors, stylometry, drift: known cases and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from proselake.operators import affect as A
from proselake.operators import drift as D
from proselake.operators import graphs as G
from proselake.operators import lexical as L
from proselake.operators import pair_statistics as P
from proselake.operators import stylometry as S

RNG = np.random.default_rng(11)
STAR = [("hub", f"n{i}", 1.0) for i in range(6)]
CYCLE = [(f"v{i}", f"v{(i + 1) % 6}", 1.0) for i in range(6)]
CLIQUES = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(5) for j in range(i)] + [("a0", "b0", 1.0)]


def test_star():
    m = G.measures(STAR)
    assert m["degree_centralisation"] == pytest.approx(1) and m["betweenness_centralisation"] == pytest.approx(1) and m["clustering"] == 0 and m["diameter"] == 2 and m["radius"] == 1 and m["assortativity"] == pytest.approx(-1)


def test_cycle():
    m = G.measures(CYCLE)
    assert m["degree_centralisation"] == pytest.approx(0) and m["betweenness_centralisation"] == pytest.approx(0) and m["diameter"] == m["radius"] == 3 and m["mean_path"] == pytest.approx(9 / 5) and m["top_rank"] == pytest.approx(1 / 6)


def test_communities_and_components():
    m = G.measures(CLIQUES)
    assert m["communities"] == 2 and m["modularity"] == pytest.approx(0.4524, abs=1e-3) and m["components"] == 1 and m["transitivity"] > 0.8
    assert G.measures([("a", "b", 1.0), ("c", "d", 1.0)])["components"] == 2 and G.measures([])["nodes"] == 0


def test_near_edges_against_brute_force(spark):
    rows = sorted({(1, int(s), f"n{k}") for s, k in zip(RNG.integers(0, 30, 60), RNG.integers(0, 6, 60))})
    df = spark.createDataFrame(rows, "doc_id bigint, s int, name string")
    want = {}
    for _, s, a in rows:
        for b in {n for _, t, n in rows if abs(t - s) < 3}:
            if a < b:
                want[a, b] = want.get((a, b), 0) + 1
    assert {(r.src, r.dst): r.weight for r in G.near_edges(df).collect()} == want


def test_kendall_and_distance_correlation():
    x = RNG.normal(size=200)
    assert P.kendall(x, x) == 1 and P.kendall(x, -x) == -1 and abs(P.kendall(x, RNG.normal(size=200))) < 0.15 and np.isnan(P.kendall(x, np.ones(200)))
    assert P.kendall(np.array([1, 2, 2, 3.0]), np.array([1, 2, 3, 3.0])) == pytest.approx(0.8)
    assert P.distance_correlation(x, x) == pytest.approx(1) and P.distance_correlation(x, x**2) > 0.4 > 0.25 > P.distance_correlation(x, RNG.normal(size=200))
    d = np.abs(x[:, None] - x[None])
    y = x**2
    e = np.abs(y[:, None] - y[None])
    a, b = (m - m.mean(0) - m.mean(1)[:, None] + m.mean() for m in (d, e))
    assert P.distance_correlation(x, y) == pytest.approx(np.sqrt((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())))


def test_information_groups_and_stability():
    x = RNG.normal(size=400)
    assert P.mutual_information(x, x) == pytest.approx(np.log2(5), abs=0.01) and P.mutual_information(x, RNG.normal(size=400)) < 0.1
    low, high, share, apart = P.two_groups(np.r_[RNG.normal(0, 1, 60), RNG.normal(20, 1, 40)])
    assert abs(low) < 1 and abs(high - 20) < 1 and share == 0.4 and apart > 0.95 and P.two_groups(np.ones(9)) is None and P.two_groups(np.arange(5.0)) is None
    y = x + RNG.normal(size=400)
    loo = np.std([np.corrcoef(np.delete(x, i), np.delete(y, i))[0, 1] for i in range(400)])
    assert P.stability(x, y) == pytest.approx(loo)
    z = RNG.normal(size=400)
    assert abs(P.partial_correlation(z + 0.1 * x, z + 0.1 * RNG.normal(size=400), z)) < 0.2
    assert P.orthogonal_slope(x, -3 * x) == -1


def test_detectors():
    ref = RNG.normal(size=(60, 4))
    got = P.detectors(ref, np.array([[0.0, 0, 0, 0], [8.0, 8, 8, 8]]))
    assert all(v[1] > v[0] for v in got.values())
    own = P.detectors(ref, ref, np.arange(60))
    assert (own["knn"] > 0).all()


def test_anomalies(spark):
    dist = [("p", f"m{k}", f"o{i}", float(RNG.normal())) for k in range(3) for i in range(30)]
    found = [(1, f"m{k}", "p", 0.0) for k in range(3)] + [(2, f"m{k}", "p", 50.0) for k in range(3)] + [(3, "m0", "none", 1.0), (4, "m0", "p", None)]
    r = P.anomalies(spark.createDataFrame(found, "doc_id bigint, metric_id string, corpus string, value double"), spark.createDataFrame(dist, "profile string, metric_id string, obs_id string, value double")).collect()
    assert {x.doc_id for x in r} == {1, 2} and all(x.unusual for x in r if x.doc_id == 2) and not all(x.unusual for x in r if x.doc_id == 1)


def test_compression():
    a, b = b"the old mill by the river stood alone " * 40, bytes(RNG.integers(0, 256, 1500).astype(np.uint8))
    assert S.compression_distance(a, a) < 0.2 < 0.8 < S.compression_distance(a, b)
    assert S.whole_text("AB cd AB. Don't")["capitals"] == 50 and S.whole_text("")  # nothing to measure, but no failure


def test_entropies():
    e = S.entropies("Of the cat and of the dog, and of the mouse. Yes!")
    assert e["word_shape"] > 0 and e["function_word_pairs"] > 0 and e["mark_pairs"] == pytest.approx(1) and e["prefixes"] == 0


def test_verification():
    me, others = np.zeros(10), RNG.normal(5, 1, (20, 10))
    assert S.verified(me, me + 0.1, others, np.random.default_rng(0)) == 1 and S.verified(others[0], me, np.vstack([me, me]), np.random.default_rng(0)) == 0


def test_nearest_author_by_blocks(spark, docs_of, monkeypatch):
    fw = ["the", "of", "and", "to", "in"]
    rows = [(i, " ".join(["word"] * 200 + [fw[i % 3]] * 60), "en", f"s{i % 3}") for i in range(12)] + [(99, "short", "en", "s0"), (98, None, "en", "s1")]
    want = sorted(map(tuple, L.nearest_author(docs_of(rows)).collect()))
    assert len(want) == 12 and all(a == s for _, s, a, _ in want)
    monkeypatch.setattr(L, "CENTROIDS", 1)
    assert sorted(map(tuple, L.nearest_author(docs_of(rows)).collect())) == want


def test_change_points():
    x = np.r_[RNG.normal(0, 1, (30, 2)), RNG.normal(6, 1, (30, 2)), RNG.normal(-3, 1, (20, 2))]
    assert D.change_points(x) == [30, 60] and D.change_points(RNG.normal(size=(40, 2)), 3.0) == [] and D.change_points(np.ones((10, 2))) == []


def test_trends_and_deviations():
    x = np.c_[RNG.normal(size=12), np.arange(12.0), *[np.ones(12)] * 4]
    t = D.trends(x)
    assert t["trend_feature"] == "word_letters" and t["trend"] == pytest.approx(1)
    y = RNG.normal(size=(12, 6))
    y[7] += 20
    assert D.deviations(y).argmax() == 7 and len(D.deviations(y[:3])) == 0


def test_drift_of_documents(docs_of):
    paragraph = lambda n: " ".join(["word"] * n) + "."
    text = "\n\n".join([paragraph(250)] * 4 + [paragraph(20) + " " + " ".join(["A b c."] * 80)] * 4)
    (r,) = D.measures(D.window_features(docs_of([(1, text), (2, "short"), (3, None)]), 200)).collect()
    assert r.doc_id == 1 and r.windows == 8 and abs(r.trend) > 0.8 and r.changes == 1


def test_arc(spark):
    s = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, -1.0, 0.5])], "doc_id bigint, idx int, value double")
    (r,) = A.arc(s).collect()
    assert (r.n, r.reversals, r.opening, r.middle, r.closing) == (3, 2, 1.0, -1.0, 0.5) and r.volatility == 1.75


def test_norms(spark, docs_of):
    norms = spark.createDataFrame([("cat", 3.0, None), ("dog", 1.0, 2.0)], "token string, age double, size double")
    got = {r.norm: (r.n, r.covered, r.level) for r in A.norm_levels(docs_of([(1, "Cat cat dog bird"), (2, None)]), norms, ["age", "size"]).collect()}
    assert got == {"age": (4, 75.0, pytest.approx(7 / 3, abs=1e-6)), "size": (4, 25.0, 2.0)} and A.norm_levels(docs_of([(1, "x")]), norms.where(F.lit(False)), ["age"]).first().level is None
