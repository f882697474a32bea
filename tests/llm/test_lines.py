"""Repeated lines against brute force, with the odd cases."""

import re
from collections import defaultdict

from proselake.llm import repeated_lines as R
from proselake.llm.repeated_lines import line_templates, repeated_lines, without_repeated_lines


def brute(rows):
    key = lambda l: re.sub(r"[^a-zäöüß\u0430-\u044f]", "", "".join(c for c in l if c.isalpha()).lower())
    n, held = defaultdict(int), defaultdict(set)
    for i, t, _, s in rows:
        if s is not None:
            n[s] += 1
            for l in (t or "").split("\n"):
                held[s, key(l)].add(i)
    return {(i, k) for i, t, _, s in rows if s is not None and t is not None for k, l in enumerate(t.split("\n")) if len(key(l)) >= 10 and len(held[s, key(l)]) >= max(3, 0.2 * n[s])}


def test_against_brute_force(docs_of):
    rows = []
    for i in range(40):
        src = "big" if i % 3 else "small"
        rows.append((i, f"Body {i} of its own kind {'x' * i}\nCopyright {i} The  House, all rights\r\nfiller line number {'abcdefghij'[i % 10] * 4}\nshort", "en", src))
    rows += [(100, None, None, "big"), (101, "", None, "big"), (102, "COPYRIGHT the house all RIGHTS", None, "big"), (103, "copyright the house all rights", None, None), (104, "Copyright the house, all rights\n" * 50, "en", "big")]
    got = {(r.doc_id, r.line_no) for r in repeated_lines(docs_of(rows)).collect()}
    assert got == brute(rows)
    assert any(i == 102 for i, _ in got) and not any(i == 103 for i, _ in got)


def test_texts_come_back_without_them(docs_of):
    rows = [(i, f"own {i}\nThe same closing line\nend {i}", "en", "s") for i in range(5)] + [(9, None, "en", "s")]
    out = {r.doc_id: r.text for r in without_repeated_lines(docs_of(rows)).collect()}
    assert out[3] == "own 3\nend 3" and out[9] is None


def test_empty_table(docs_of, spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    assert repeated_lines(empty).count() == 0 and without_repeated_lines(empty).count() == 0


def test_slots_where_siblings_differ(docs_of):
    """Lines that differ in one place share a template with a slot; it is reported and its lines, not word for word the same, stay."""
    rows = [(i, f"Share this page with {'abcdefghij'[i] * 5} now\nown text {'klmnopqrst'[i] * 9}\nThe very same line", "en", "s") for i in range(10)]
    got = {(r.template, r.slots, r.docs) for r in line_templates(docs_of(rows)).collect()}
    assert ("sharethispagewi*thnow" in {t for t, _, _ in got}) or any(s and t.startswith("sharethisp") and d == 10 for t, s, d in got)
    assert ("theverysameline", 0, 10) in got
    assert {(r.doc_id, r.line_no) for r in repeated_lines(docs_of(rows)).collect()} == {(i, 2) for i in range(10)}


def test_both_ways_to_remove(docs_of, monkeypatch):
    rows = [(i, f"own {i}\nThe same closing line\nend {i}\r\n", "en", "s") for i in range(5)] + [(9, None, "en", "s"), (10, "The same closing line", None, None)]
    want = sorted(map(tuple, without_repeated_lines(docs_of(rows)).collect()))
    monkeypatch.setattr(R, "MOST_LINES", 0)
    assert sorted(map(tuple, without_repeated_lines(docs_of(rows)).collect())) == want and (10, "The same closing line") in want
