import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proselake.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder.of(bpe.VOCABULARY)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab'stre \n\t  .,é中🦊\u0300\u2003\u3000\xa0d1")), max_size=40))
def test_equals_plain_encoding(text):
    e = bpe.Encoder.of(bpe.VOCABULARY)
    assert e.encode(text) == e.encoding.encode_ordinary(text)


def test_round_trip_and_special_strings(enc):
    for t in ("<|endoftext|> is text", "a\r\n\r\nb", "x" * 5000, " " * 300, "'s 're '' don't !'s", "नदी 川 🦊🏽"):
        assert enc.encoding.decode(enc.encode(t)) == t and enc.encode(t) == enc.encoding.encode_ordinary(t)


def test_cuts_are_certain(enc):
    text = "Words, words; and 3 more—words."
    for c in enc.cuts(text):
        assert enc.encoding.encode_ordinary(text[:c]) + enc.encoding.encode_ordinary(text[c:]) == enc.encoding.encode_ordinary(text)


def test_in_spark(docs_of, enc, spark):
    got = {r.doc_id: r.ids for r in bpe.token_ids(docs_of([(1, "One two"), (2, ""), (3, None), (4, "é")])).collect()}
    assert got == {1: enc.encode("One two"), 2: [], 3: [], 4: enc.encode("é")}
    n = {r.doc_id: r.tokens for r in bpe.token_counts(docs_of([(1, "One two"), (3, None)]), ["doc_id", "source"]).collect()}
    assert n == {1: len(got[1]), 3: 0}
    assert bpe.token_ids(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
