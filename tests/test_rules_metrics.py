"""Rules, citations, edits, settings, plain names, the registry of metrics and the functions for SQL."""

import pytest
from pyspark.sql import functions as F

from proselake.operators import rules as R
from proselake.plans import metrics as M


def test_rules_and_their_errors(docs_of):
    rules = [("dash", "—", ""), ("very", r"\bvery\b", "i"), ("broken", "(", ""), ("flags", "x", "q")]
    got = {(r.doc_id, r.rule): (r.hits, r.first, r.error) for r in R.violations(docs_of([(1, "Very — very"), (2, None)]), rules).collect()}
    assert got[1, "dash"] == (1, "—", None) and got[1, "very"] == (2, "Very", None)
    assert got[None, "broken"][2] and got[None, "flags"][2] and len(got) == 4
    assert R.violations(docs_of([(1, "x")]), [("bad", "[", "")]).first().error


@pytest.mark.parametrize("text,yes", [("Everyone is alone in the end.", True), ("People never change.", True), ("He was alone.", False), ("Life is like Tom Brown said.", False)])
def test_maxims(spark, text, yes):
    assert spark.range(1).select(R.maxim(F.lit(text)).alias("m")).first().m == yes


def test_citations(spark, docs_of):
    docs = docs_of([(1, "The old mill, by the river, stood alone that day."), (2, "Nothing here at all."), (3, None)])
    cites = spark.createDataFrame([(1, 1, "the OLD mill by the river"), (2, 2, "the old mill"), (3, None, "stood alone"), (4, None, "stood apart"), (5, 3, "x"), (6, 1, "old mil")], "cite_id bigint, doc_id bigint, quote string")
    assert sorted(r.cite_id for r in R.missing_citations(cites, docs).collect()) == [2, 4, 5, 6]


def test_edits(docs_of):
    before, after = docs_of([(1, "one two"), (2, "gone")]), docs_of([(1, "one “two three \n\n\n\nend"), (3, "new\ttext")])
    got = {r.doc_id: r for r in R.edits(before, after).collect()}
    assert got[1].change == 2 and got[1].broken == ["unpaired_quotes", "trailing_spaces", "blank_lines"] and got[3].broken == ["tabs"] and got[2].words_after is None


def test_config():
    assert R.config_findings({"corpus": {"paht": 1}, "corpsu": 2}, {"corpus", "corpus.path"}) == [("config.corpus.paht", "corpus.path"), ("config.corpsu", "corpus")]


def test_plain_names(spark):
    f = spark.createDataFrame([("a.b.c",), ("a.x",), ("z",)], "metric_id string")
    n = spark.createDataFrame([("a", "family a"), ("a.b", "more exact")], "prefix string, plain_name string")
    assert {r.metric_id: r.plain_name for r in R.plain_names(f, n).collect()} == {"a.b.c": "more exact", "a.x": "family a", "z": None}


def test_registry(docs_of, monkeypatch):
    monkeypatch.setattr(M, "METRICS", {})

    @M.metric("length", "size", min_sample=5)
    def _length(d):
        return d.select("doc_id", F.lit("size.chars").alias("metric_id"), F.length("text").alias("value"), F.length("text").alias("sample_size"))

    @M.metric("magic", "size", requires=("no_such_package",), cost="slow", ids=("size.magic",))
    def _magic(d):
        raise AssertionError

    with pytest.raises(ValueError):
        M.metric("length", "size")(_length)
    M.metric("length", "size", min_sample=5, replace=True)(_length)
    got = {(r.doc_id, r.metric_id): (r.value, r.warning) for r in M.measured(docs_of([(1, "abc"), (2, "abcdefg")]), M.chosen()).collect()}
    assert got[1, "size.chars"] == (3.0, "fewer than 5") and got[2, "size.chars"] == (7.0, None) and got[1, "size.magic"][0] is None and "no_such_package" in got[1, "size.magic"][1]
    assert [m.name for m in M.chosen(cost=("fast",))] == ["length"] and M.chosen(enable=["magic"], disable=["magic"]) == [] and M.measured(docs_of([(1, "a")]), []).count() == 0


def test_functions_for_sql(spark):
    M.register_functions(spark)
    assert [r.sentence for r in spark.sql("SELECT sentence FROM prose_sentences('One. Two! “Three?” Four')").collect()] == ["One.", "Two!", "“Three?”", "Four"]
    assert spark.sql("SELECT prose_median(x) AS m FROM VALUES (1.0), (5.0), (2.0) AS t(x)").first().m == 2
