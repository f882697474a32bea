"""Reuse and dialogue: against brute force and small cases with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from proselake.operators import dialogue as D
from proselake.operators import profile_checks as P
from proselake.operators import reuse as R
from proselake.operators import style as S

TALK = "“Go,” she said, “and run.” He nodded. “Why?” asked Tom. “Now!”\n\n“Never,” whispered Anna.\n\n“A.” “B.” “C.”"


def test_turns_and_labels(docs_of):
    rows = D.labelled(D.turns(docs_of([(1, TALK), (2, None), (3, "No speech.")]))).orderBy("turn").collect()
    assert [r.text for r in rows] == ["Go, and run.", "Why?", "Now! Never, A.", "B. C."] or [r.text for r in rows][:2] == ["Go, and run.", "Why?"]
    assert [(r.label, r.verb or None, r.speaker) for r in rows[:2]] == [("speech_tag", "said", None), ("speech_tag", "asked", "Tom")]


def test_unlabelled_turns(docs_of):
    text = "He looked up. “One.” He left. “Two.”\n\nThe end of it."
    assert [r.label for r in D.labelled(D.turns(docs_of([(1, text)]))).orderBy("turn").collect()] == ["action_beat", "action_beat"]


def test_near_sentences_against_brute_force(spark):
    rng = np.random.default_rng(4)
    units = [(d, u, sorted(set(rng.integers(0, 12, rng.integers(3, 12)).tolist()))) for d in (1, 2) for u in range(40)]
    df = spark.createDataFrame(units, "doc_id bigint, unit bigint, sh array<bigint>")
    for least in (0.5, 0.7, 0.9):
        want = {(d, a, b) for d, a, x in units for e, b, y in units if d == e and a < b and len({*x} & {*y}) / len({*x} | {*y}) >= least - 1e-9}
        assert {(r.doc_id, r.a, r.b) for r in R.near_sentences(df, least).collect()} == want and want


def test_shingles(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"],), (["a"],), ([],)], "t array<string>")
    assert [r.n for r in df.select(F.size(R.shingles(F.col("t"))).alias("n")).collect()] == [2, 1, 1]


def test_longest_run():
    assert R.longest_run(np.array([1, 2, 3, 9, 1, 2, 3, 4], np.uint64)) == 3
    assert R.longest_run(np.array([1, 2, 3], np.uint64)) == 0 and R.longest_run(np.array([5] * 10, np.uint64)) == 9 and R.longest_run(np.zeros(0, np.uint64)) <= 0


def test_fingerprints():
    a, b, c = (R.simhash(s.split()) for s in ("the old mill by the river stood alone", "the old mill by the river stood still", "quite another line of words altogether here"))
    near = lambda x, y: bin(x ^ y).count("1")
    assert near(a, b) < near(a, c) and R.nearest_hamming(np.array([a, a, c], np.uint64)) == pytest.approx(near(a, c) / 3)
    assert R.nearest_hamming(np.array([a, b, c], np.uint64), block=3) == R.nearest_hamming(np.array([a, b, c], np.uint64))


def test_jaro_winkler():
    assert R.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4) and R.jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.8133, abs=1e-4)
    assert R.jaro_winkler("abc", "xyz") == 0 and R.jaro_winkler("", "") == 1


def test_curves(spark):
    df = spark.createDataFrame([([0.0, 10.0, 20.0], [1.0, 10.0, 23.0])], "a array<double>, b array<double>")
    r = df.select(P.curve_distance(F.col("a"), F.col("b")).alias("d"), P.curve_distance(F.col("a"), F.col("b"), 2).alias("d2"), *(P.curve_quantile(F.col("a"), F.lit(q)).alias(f"q{i}") for i, q in enumerate((0.0, 0.25, 0.6, 1.0, 2.0)))).first()
    assert r.d == pytest.approx(4 / 3) and r.d2 == pytest.approx(10 / 3) and [r[f"q{i}"] for i in range(5)] == pytest.approx([0, 5, 12, 20, 20])


def test_pools_are_exact(spark):
    rng = np.random.default_rng(1)
    v = np.r_[np.round(rng.normal(0, 5, 500)), np.zeros(300), 1e7]
    df = spark.createDataFrame([(i % 7, "x", float(a)) for i, a in enumerate(v)], "doc_id bigint, item string, v double")
    (r,) = P.pools(df).collect()
    assert r.n == len(v) and r.texts == 7 and np.allclose(r.curve, np.quantile(v, np.linspace(0, 1, 101)))


def test_curve_distance_reads_texts_once(spark, sf, docs_of):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    d = docs_of([(1, "One two. Three!\n\nFour five six."), (2, None), (3, " "), (4, "… — 7\n\nAlone")])
    got = sorted(tuple(r) for r in P.items(d).collect())
    words, chars, paragraphs = ([("sentence_words", v) for v in (2.0, 1.0, 3.0)], [("sentence_chars", v) for v in (8.0, 6.0, 14.0)], [("paragraph_words", v) for v in (3.0, 3.0)])
    assert got == sorted([(1, *x) for x in words + chars + paragraphs] + [(4, "sentence_words", 1.0), (4, "sentence_chars", 5.0), (4, "paragraph_words", 1.0)])
    assert plan(P.items(d)).count("PROJECT GUTENBERG") == 2  # one pass: the start and the end of a book
    df = P.document_curve_distance(spark, sf)
    assert "PROJECT GUTENBERG" not in plan(df)  # what is left compares numbers
    per, all_ = {}, {}
    for r in P.items(P.docs(spark, sf)).collect():
        per.setdefault((r.doc_id, r.item), []).append(r.v), all_.setdefault(r.item, []).append(r.v)
    q = lambda v: np.quantile(v, np.linspace(0, 1, 101))
    rows = df.collect()
    assert len(rows) == len(per)
    for r in rows:
        gap = q(per[r.doc_id, r.item]) - q(all_[r.item])
        assert r.n == len(per[r.doc_id, r.item]) and r.distance == pytest.approx(np.abs(gap).mean(), abs=6e-6) and r.transport == pytest.approx((gap**2).mean(), abs=6e-5)


def test_curve_gaps_of_many_rows(spark):
    rng = np.random.default_rng(5)
    vs = [[int(x) for x in rng.integers(1, 60, rng.integers(1, 30))] for _ in range(2500)]
    df = spark.createDataFrame([(i, "x", v) for i, v in enumerate(vs)], "doc_id bigint, item string, vs array<int>").coalesce(1)
    c = np.quantile(np.concatenate(vs), np.linspace(0, 1, 101))
    for r in P.curve_gaps(df, {"x": c.tolist()}).collect():
        assert r.n == len(vs[r.doc_id]) and r.distance == pytest.approx(np.abs(np.quantile(vs[r.doc_id], np.linspace(0, 1, 101)) - c).mean())


def test_gates(spark):
    f = spark.createDataFrame([("c", "m", 5, {"n": "1"}), ("c", "m", 400, {"n": "2"}), ("c", "m", 100, None)], "corpus string, metric_id string, sample_size long, options map<string,string>")
    usual = spark.createDataFrame([("c", "m", 100.0)], "corpus string, metric_id string, usual double")
    assert [r.gate for r in P.size_gate(f, usual).orderBy("sample_size").collect()] == ["small", None, "large"]
    opts = spark.createDataFrame([("c", "m", {"n": "1"})], "corpus string, metric_id string, options map<string,string>")
    assert [r.comparable for r in P.options_gate(f, opts).orderBy("sample_size").collect()] == [True, True, False]


def test_bands_with_exemptions(spark):
    v = spark.createDataFrame([(1, "a", 1.0), (1, "b", 9.0), (1, "c", 2.0), (2, "a", 50.0)], "doc_id bigint, member string, x double").withColumn("part", F.lit(0))
    bands = spark.createDataFrame([(0, 1.5, 5.0)], "part int, floor double, ceiling double")
    got = {r.doc_id: (r.members, r.outside, r.mean, r.verdict) for r in P.in_bands(v, bands, ["doc_id"], ["part"], F.col("member") == "b").collect()}
    assert got == {1: (2, 1, 1.5, "inside"), 2: (1, 1, 50.0, "above")}


def test_metric_selection(spark):
    r = spark.createDataFrame([("a", False, False), ("b", True, False), ("c", False, True)], "metric_id string, needs_parse boolean, needs_model boolean")
    names = lambda **k: sorted(x.metric_id for x in P.selected_metrics(r, **k).collect())
    assert names() == ["a", "b"] and names(parse=False) == ["a"] and names(model=True, enabled=["c"]) == ["c"]


def test_local_repetition_within_rows(spark, docs_of, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["the", "with", "they", "cat", "Stone", "stone", "river", "été’s", "étés", "Don’t", "don't", "ſtone", *(f"word{chr(97 + k)}" for k in range(20))]
    texts = [" ".join(rng.choice(words, rng.integers(1, 700))) for _ in range(60)] + ["the with cat", "", None, "alone", "river river", "— 7 !", "stone the Stone cat STONE"]
    rows = [(i, texts[i % len(texts)]) for i in range(2200)]  # more than two slices of a batch
    monkeypatch.setattr(S, "docs", lambda *_: docs_of(rows).coalesce(1))
    df = S.style_local_repetition(spark, "")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Aggregate" not in plan  # no row a word, no table sent to the driver
    want = {}
    for i, t in rows:
        toks = [w.lower().replace("’", "'") for w in (t or "").split() if w[0].isalpha()]
        last, gaps, content = {}, [], False
        for k, w in enumerate(toks):
            if len(w) > 3 and w not in S.COMMON:
                content = True
                gaps += [k - last[w]] if w in last else []
                last[w] = k
        if content:
            want[i] = (sum(100 * sum(g <= w for g in gaps) / len(toks) for w in (50, 100, 250)) / 3, float(np.median(gaps)) if gaps else None)
    got = {r.doc_id: (r.repetition, r.median_gap) for r in df.collect()}
    assert got.keys() == want.keys() and all(got[i][0] == pytest.approx(want[i][0], abs=1e-6) and got[i][1] == want[i][1] for i in want)
