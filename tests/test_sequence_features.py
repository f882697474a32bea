"""Measures of sequences against closed forms, brute force and signals of known kind."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from proselake.operators import named_sequences as N
from proselake.operators import sequence_features as SF

RNG = np.random.default_rng(5)
T = np.arange(512)
SINE, NOISE, WALK, STEP = np.sin(2 * np.pi * T / 16), RNG.normal(size=512), np.cumsum(RNG.normal(size=512)), np.r_[np.zeros(256), np.full(256, 5.0)] + RNG.normal(size=512) * 0.1


def test_partial_autocorrelation_of_an_autoregression():
    x = np.zeros(20000)
    for i in range(1, len(x)):
        x[i] = 0.7 * x[i - 1] + RNG.normal()
    p = SF.pacf(x)
    assert p["pacf1"] == pytest.approx(0.7, abs=0.03) and all(abs(p[f"pacf{k}"]) < 0.05 for k in range(2, 6))
    assert np.isnan(SF.pacf(np.ones(20))["pacf1"])


def test_spectra():
    w, n = SF.welch_measures(SINE), SF.welch_measures(NOISE)
    assert w["welch_peak"] == pytest.approx(1 / 16) and w["welch_centroid"] == pytest.approx(1 / 16, abs=0.01) and w["welch_entropy"] < 0.4 < n["welch_entropy"]
    assert w["welch_low"] > 0.99 and n["welch_low"] + n["welch_mid"] + n["welch_high"] == pytest.approx(1) and w["welch_bandwidth"] < n["welch_bandwidth"] and w["welch_rolloff"] < n["welch_rolloff"]
    f, p = SF.welch(NOISE, length=512)
    assert (p.real * (f[1] - f[0])).sum() == pytest.approx(NOISE.var(), rel=0.5)


def test_coherence_and_phase():
    late = np.sin(2 * np.pi * (T - 4) / 16) + 0.1 * NOISE
    c, d = SF.coherence(SINE + 0.1 * RNG.normal(size=512), late), SF.coherence(NOISE, RNG.normal(size=512))
    assert c["cross_phase"] == pytest.approx(-np.pi / 2, abs=0.1) and 0 < d["coherence"] < 0.6


def test_peaks_and_prominence():
    x = np.array([0, 2, 0, 1, 1, 0, 5, 1, 3, 1.0])
    p = SF.peaks(x)
    assert p["peak_rate"] == 40 and p["peak_prominence"] == pytest.approx((2 + 1 + 4 + 2) / 4)


def test_entropies_and_exponents():
    for f in (SF.approximate_entropy, SF.fuzzy_entropy, SF.dispersion_entropy, SF.petrosian):
        assert f(SINE) < f(NOISE)
    assert SF.correlation_dimension(SINE) < 1.6 < SF.correlation_dimension(NOISE)
    chaos = [0.4]
    for _ in range(600):
        chaos.append(4 * chaos[-1] * (1 - chaos[-1]))
    assert SF.ordinal_complexity(NOISE) < 0.05 < SF.ordinal_complexity(np.array(chaos))
    assert SF.lyapunov(np.array(chaos)) > SF.lyapunov(SINE + 1e-3 * NOISE) and np.isnan(SF.lyapunov(SINE[:100]))


def test_scales():
    assert SF.multiscale_variance(NOISE) == pytest.approx(-1, abs=0.3) and SF.multiscale_variance(WALK) > -0.5
    h = SF.haar(np.tile([1.0, -1.0], 64))
    assert h["wavelet_energy"] == pytest.approx(1) and h["wavelet_entropy"] == pytest.approx(0)
    assert SF.cepstral_peak(np.tile([3.0, 0, 0, 0, 0, 0, 0, 0], 16) + 0.1 * NOISE[:128]) > SF.cepstral_peak(SINE[:128] * 0 + NOISE[:128]) * 0.5


def test_adaptive_window():
    assert SF.adwin(STEP) > 0 and SF.adwin(NOISE) == 0 and SF.adwin(np.ones(100)) == 0


def test_recurrence_of_a_cycle():
    r = SF.recurrence(SINE[:128])
    assert r["rqa_determinism"] > 0.95 and r["rqa_recurrence_time"] > 2 and r["rqa_longest_diagonal"] > 20 and r["rqa_rate"] >= 5
    assert np.isnan(SF.recurrence(np.ones(50))["rqa_rate"])


def test_sequences_of_a_text(docs_of):
    text = "He ran home. It was late, and she slept!\\n\\n“Go,” he said. aab!".replace("\\n", "\n")
    docs = docs_of([(1, text), (2, None), (3, "")])
    got = {}
    for r in N.named_sequences(docs).orderBy("seq_name", "idx").collect():
        assert r.doc_id == 1
        got.setdefault(r.seq_name, []).append(r.value)
    assert got["sentence_words"] == [3, 6, 3, 1] and got["paragraph_words"] == [9, 4] and got["paragraph_sentences"] == [2, 2]
    assert got["sentence_punctuation"] == [1, 2, 2, 1] and got["sentence_chars"] == [12, 27, 14, 4]
    assert got["sentence_char_entropy"][3] == pytest.approx(0.9182958) and got["window_dialogue_fraction"] == [pytest.approx(100 / 13)] and got["window_pronoun_rate"] == [pytest.approx(4000 / 13)]


def test_sequences_of_vectors_and_lexicons(spark, docs_of):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (1, 2, [0.0, 2.0]), (2, 0, [0.0, 0.0])], "doc_id bigint, idx int, vector array<float>")
    got = sorted((r.doc_id, r.seq_name, r.idx, round(r.value, 6)) for r in N.vector_sequences(v).collect())
    assert [x[3] for x in got if x[1] == "sentence_similarity_prev"] == [0.0, 1.0] and len([x for x in got if x[1] == "sentence_distance_centroid"]) == 3
    lex = spark.createDataFrame([("good", 1.0), ("bad", -1.0), ("odd", None)], "token string, valence double")
    rows = N.lexicon_sequences(docs_of([(1, "Good good bad. Nothing here. Bad odd."), (2, None)]), lex, "valence", "valence").collect()
    assert [(r.idx, round(r.value, 6)) for r in sorted(rows, key=lambda r: r.idx)] == [(0, 0.333333), (1, -1.0)]


def test_sequences_of_parses(spark):
    rows = [(1, 0, 0, "PRON", "nsubj", 1, ""), (1, 0, 1, "VERB", "ROOT", 1, ""), (1, 0, 2, "PROPN", "obj", 1, "PERSON"), (1, 1, 0, "NOUN", "ROOT", 0, "")]
    p = spark.createDataFrame(rows, "doc_id bigint, sent_idx int, tok_i int, pos string, dep string, head_i int, ent string")
    got = {(r.seq_name, r.idx): r.value for r in N.parse_sequences(p).collect()}
    assert got["sentence_dependency_distance", 0] == 1 and got["sentence_clause_count", 0] == 1 and got["sentence_entity_count", 0] == 1 and got["sentence_pos_entropy", 1] == 0


def test_transitions(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate("aabba")] + [(2, 0, "a")], "doc_id bigint, i int, label string")
    (r,) = SF.transitions(rows, "i", "label").collect()
    assert (r.doc_id, r.n, r.transition_rate, r.dwell) == (1, 5, 50.0, pytest.approx(5 / 3, abs=1e-6)) and r.transition_entropy == 2
    assert rows.where(F.lit(False)).count() == 0
