from proselake.llm import lookalike as L


def pairs(docs):
    return sorted((r.doc_id_a, r.doc_id_b) for r in L.lookalike_pairs(docs).collect())


def test_pairs(docs_of):
    base = "She said “it’s fine…” and left the café office."
    rows = [
        (1, base), (2, base.replace("“", '"').replace("”", '"').replace("’", "'")), (3, base.replace("…", "...")), (4, base.replace("ffi", "ﬃ")),
        (5, base.replace("a", "а").replace("o", "о")), (6, "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in base)), (7, base.replace("é", "e\u0301")),
        (8, base.replace("left", "le\u200bft")), (9, base.replace(" ", "\u2009")), (10, base), (20, base.lower()), (21, base.replace("é", "e")), (22, base.replace("left", "lost")),
        (30, None), (31, None), (32, ""), (33, " "), (34, "\u00a0"), (35, "..."), (36, "…"),
    ]
    same = range(1, 11)
    assert pairs(docs_of(rows)) == sorted((a, b) for a in same for b in same if a < b and (a, b) != (1, 10))


def test_transitive_classes():
    t = L.table_of({c: 1 for c in "aа "})
    assert t.rewrite("ａа") == t.rewrite("aa")


def test_representatives_follow_frequency():
    """A string or a single sign represents a class, whichever is more frequent, and texts still come out the same."""
    texts = ["wait…", "wait...", "wait.…", "wait....", "ﬁt ﬂow oﬀice oﬃce", "fit flow office office", "caf\u00e9", "cafe\u0301", "“x”", "''x''", '"x"']
    base = {c: 50 for c in "abcdefghijklmnopqrstuvwxyz .'"}
    few, many = L.table_of(base | {"...": 20, "…": 1, "fi": 9}), L.table_of(base | {"...": 20, "…": 90, "é": 9, "\u0301": 1, "“": 30})
    assert few.rewrite("a…") == "a..." and many.rewrite("a...") == "a…" and many.rewrite("e\u0301") == "é" and many.rewrite("''") == "“"
    for t in (few, many):
        out = [t.rewrite(x) for x in texts]
        assert out[0] == out[1] and out[2] == out[3] and out[4] == out[5] and out[6] == out[7] and len(set(out[8:])) == 1


def test_longest_match_first():
    a = L.Rewriter({"ab": "1", "abc": "2", "c": "3"})
    assert a("abcabxc") == "21x3" and a("xyz") == "xyz" and a("xab") == "x1"


def test_table_is_kept_for_later_corpora(spark, docs_of, tmp_path):
    t = L.learn_table(docs_of([(1, "caf\u00e9 … ‘x’"), (2, None)]))
    L.save_table(spark, t, str(tmp_path / "table"))
    back = L.load_table(spark, str(tmp_path / "table"))
    assert (back.spelled, back.kept) == (t.spelled, t.kept)
    got = {r.doc_id: r.text for r in L.normalized(docs_of([(1, "cafe\u0301 ..."), (2, "café …")]), table=back).collect()}
    assert got[1] == got[2]


def test_links(docs_of):
    rows = L.look_classes(docs_of([(1, "‘a’"), (2, "'a'"), (3, "'a'"), (4, "b")])).collect()
    assert {(r.doc_id, r.variants, r.links) for r in rows} == {(1, 2, 2), (2, 2, 1), (3, 2, 1)}


def test_idempotent_and_words_kept():
    t = L.table_of({c: 5 for c in "Ünïcödé “x” …ﬁ한글 नदी ไทย"})
    for s in ("Ünïcödé “x” …ﬁ", "한글", "नदी ไทย", ""):
        assert t.rewrite(t.rewrite(s)) == t.rewrite(s)
    assert t.rewrite("Word") != t.rewrite("word")


def test_copies_and_empty(docs_of, spark):
    assert pairs(docs_of([(i, "the same text") for i in range(50)])) == []
    assert L.lookalike_pairs(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert {r.doc_id: r.text for r in L.normalized(docs_of([(1, None), (2, "")])).collect()} == {1: None, 2: ""}
