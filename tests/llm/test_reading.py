import numpy as np
import pytest

from proselake.llm import reading as R


def test_isotonic():
    assert R.isotonic(np.array([1, 0, 2, 1, 3.0])).tolist() == [0.5, 0.5, 1.5, 1.5, 3.0]
    assert len(R.isotonic(np.zeros(0))) == 0


def test_held_out_accuracy(sf):
    import pyarrow.parquet as pq

    sf = sf.replace("0.001", "0.1")
    text = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    band = {r["doc_id"]: r["band"] for r in pq.read_table(f"{sf}/reading_bands.parquet").to_pylist() if r["band"]}
    rows = [(R.features(text.get(i)), R.BANDS.index(b)) for i, b in sorted(band.items())]
    rows = [r for r in rows if r[0]]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    train = np.arange(len(x)) % 2 == 0
    got = R.fit(x[train], y[train]).bands(x[~train])
    assert np.mean([R.BANDS.index(g) == w for g, w in zip(got, y[~train])]) > 0.97


def test_odd_cases(docs_of, spark):
    easy, hard = "The cat sat. It was red. He ran.", "Institutional historiography necessitates phenomenological characterisation of multidimensional authoritativeness, notwithstanding irreconcilable epistemological presuppositions."
    docs = docs_of([(1, easy), (2, hard), (3, easy * 2), (4, hard * 2), (5, None), (6, ""), (7, easy), (8, hard), (7, easy)])
    bands = spark.createDataFrame([(1, "r", "easy"), (2, "r", "hard"), (3, "r", "easy"), (3, "q", "easy"), (4, "r", "hard"), (5, None, None), (6, None, None), (7, None, None), (8, None, None), (8, None, None), (99, None, None), (1, None, None)], "doc_id bigint, rater string, band string")
    got = {r.doc_id: r.band for r in R.missing_bands(docs, bands).collect()}
    assert got == {5: "easy", 6: "easy", 7: "easy", 8: "hard"}
    assert R.learn(docs, bands.where("band is null")) is None
    assert R.missing_bands(docs, bands.limit(0)).count() == 0


@pytest.mark.parametrize("text", [None, "", "  ", "!!!"])
def test_no_words(text):
    assert R.features(text) is None


def test_syllables_of_long_texts_are_those_of_all_words():
    words = ["cat", "banana"] * 400  # every second word would be left out by a stride of two
    assert R.features(" ".join(words))[R.FEATURES.index("syllables")] == pytest.approx(2)
    assert R.features("cat banana")[R.FEATURES.index("syllables")] == pytest.approx(2)
