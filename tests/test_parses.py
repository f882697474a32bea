"""Measurements over a small hand-made parse table."""

import pytest

from proselake.operators import parses as P
from proselake.operators.profiles import mtld, windows

ROWS = [
    # The dog chased Ann .   (active)
    (1, 0, 1, "The", "the", "DET", "det", 2, {}, None), (1, 0, 2, "dog", "dog", "NOUN", "nsubj", 3, {}, None), (1, 0, 3, "chased", "chase", "VERB", "ROOT", 0, {"VerbForm": "Fin", "Tense": "Past"}, None), (1, 0, 4, "Ann", "Ann", "PROPN", "obj", 3, {}, "B-PERSON"), (1, 0, 5, ".", ".", "PUNCT", "punct", 3, {}, None),
    # The nation was seen by dog (passive)
    (1, 1, 1, "The", "the", "DET", "det", 2, {}, None), (1, 1, 2, "nation", "nation", "NOUN", "nsubjpass", 4, {}, None), (1, 1, 3, "was", "be", "AUX", "auxpass", 4, {"VerbForm": "Fin", "Tense": "Past"}, None), (1, 1, 4, "seen", "see", "VERB", "ROOT", 0, {"VerbForm": "Part"}, None), (1, 1, 5, "by", "by", "ADP", "case", 6, {}, None), (1, 1, 6, "dog", "dog", "NOUN", "obl", 4, {}, None),
    # She who waits wins   (relative clause)
    (1, 2, 1, "She", "she", "PRON", "nsubj", 4, {}, None), (1, 2, 2, "who", "who", "PRON", "nsubj", 3, {}, None), (1, 2, 3, "waits", "wait", "VERB", "relcl", 1, {"VerbForm": "Fin", "Tense": "Pres"}, None), (1, 2, 4, "wins", "win", "VERB", "ROOT", 0, {"VerbForm": "Fin", "Tense": "Pres"}, None),
]
SCHEMA = "doc_id bigint, sent_idx int, tok_i int, text string, lemma string, pos string, dep string, head_i int, morph map<string,string>, ent string"


@pytest.fixture(scope="module")
def parse(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_measures(parse):
    d = P.depths(parse).first()
    assert d.mean_token_depth == pytest.approx((2 + 1 + 0 + 1 + 1 + 2 + 1 + 1 + 0 + 2 + 1 + 1 + 3 + 2 + 0) / 15, abs=1e-6) and d.max_parse_depth == 2 and d.mean_max_parse_depth == pytest.approx(7 / 3, abs=1e-6)
    assert P.passive_voice(parse).first().passive_voice == 25
    assert P.pos_distribution(parse).first().pos_noun == pytest.approx(100 * 3 / 14, abs=1e-6)
    c = P.clauses(parse).first()
    assert (c.sentences, c.single_clause_share) == (3, pytest.approx(200 / 3, abs=1e-6)) and c.relative_clause_rate == pytest.approx(100 / 3, abs=1e-6) and c.finite_clauses_per_sentence == pytest.approx(4 / 3, abs=1e-6)
    t = P.tense(parse).first()
    assert (t.dominant_tense, t.tense_drift) == ("Past", 1)
    assert P.nominalizations(parse).first().nominalization_density == pytest.approx(100 / 3, abs=1e-6)
    assert P.dependency_distance(parse).first().dependency_distance_mean == pytest.approx((1 + 1 + 1 + 1 + 2 + 1 + 1 + 2 + 3 + 1 + 2) / 11, abs=1e-6)
    assert P.lemma_repetition(parse).first().top_lemma_count == 2
    assert P.entities(parse).first().entity_pronoun_ratio == 0.5
    assert {r.change: r.n for r in P.entity_transitions(parse).collect()} == {"SX": 1}
    assert P.opening_patterns(parse).first().opening_top_share == pytest.approx(100 / 3, abs=1e-6)


def test_empty_and_cycles(parse, spark):
    for f in (P.depths, P.passive_voice, P.pos_distribution, P.clauses, P.tense, P.nominalizations, P.dependency_distance, P.lemma_repetition, P.entities, P.entity_transitions, P.opening_patterns):
        assert f(parse.limit(0)).count() == 0
    loop = spark.createDataFrame([(1, 0, 1, "a", "a", None, None, 2, None, None), (1, 0, 2, "b", "b", None, None, 1, None, None)], SCHEMA)
    assert P.depths(loop).count() == 1 and P.clauses(loop).count() == 1


def brute_mtld(toks, threshold=0.72):
    def one(ts):
        f, seen, n = 0.0, set(), 0
        for t in ts:
            seen.add(t)
            n += 1
            if len(seen) / n <= threshold:
                f, seen, n = f + 1, set(), 0
        if n:
            f += (1 - len(seen) / n) / (1 - threshold)
        return len(ts) / f if f else float(len(ts))

    return (one(toks) + one(toks[::-1])) / 2


def test_mtld_and_windows(docs_of):
    ws = ["abcdefghij"[(k * k + k // 7) % 10] * 2 for k in range(300)]
    docs = docs_of([(1, " ".join(ws)), (2, None), (3, "\n\n".join(" ".join(["word"] * 90) for _ in range(5)))])
    assert {r.doc_id: r.mtld for r in mtld(docs).collect()}[1] == pytest.approx(brute_mtld(ws), abs=1e-5)
    assert sorted((r.doc_id, r.win, r.n_words) for r in windows(docs, 200).collect()) == [(1, 0, 300), (3, 0, 270), (3, 1, 180)]
