import numpy as np
import pytest

from proselake.llm import percentiles as P


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(5)
    v = np.r_[rng.lognormal(0, 3, 4000), -rng.lognormal(1, 2, 1500), np.zeros(500), [1e300, -1e300, 1e-300]]
    g = ["a" if i % 3 else None for i in range(len(v))]
    rows = [(k, float(x), i % 7) for i, (k, x) in enumerate(zip(g, v))]
    return rows, spark.createDataFrame([*rows, ("a", None, 0), ("a", float("nan"), 0), ("a", float("inf"), 1), (None, float("-inf"), 2), ("none", None, 0)], "g string, value double, day int")


def test_error_bound(values):
    rows, df = values
    got = P.percentiles(P.sketch(df, ["g"]), ["g"]).collect()
    assert {r.g for r in got} == {"a", None}
    for r in got:
        own = np.sort([x for g, x, _ in rows if g == r.g])
        exact = own[int(np.floor(r.q * (len(own) - 1)))]
        assert r.n == len(own) and abs(r.value - exact) <= 0.0100001 * abs(exact)


def test_days_combine(values):
    _, df = values
    whole = {(r.g, r.q): r.value for r in P.percentiles(P.sketch(df, ["g"]), ["g"]).collect()}
    merged = {(r.g, r.q): r.value for r in P.percentiles(P.merge(P.sketch(df, ["g", "day"]), ["g"]), ["g"]).collect()}
    assert whole == merged


def test_empty(spark):
    e = spark.createDataFrame([], "g string, value double")
    assert P.percentiles(P.sketch(e, ["g"]), ["g"]).count() == 0
    with pytest.raises(ValueError):
        P.sketch(e, ["g"], accuracy=1.5)
