import math
import random

import pytest

from proselake.llm import residue as R

GATE = R.Gate({}, 0.0)

BAD = [
    "Title: {{ page.title }}", "Dear ${first_name},", "By {author_name}", "%SUMMARY% and more", "@@title@@", "{% block body %}", "#{title}", "[INSERT author]", "[title HERE]", "Title: %s by %s (%d)", "Hello null, welcome to undefined",
    "Chapter NaN of NaN: [object Object]", "By undefined on Invalid Date", "None None, None pages", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "asdf qwer zxcv", "Your text goes here.", "[text to come]", "TODO: write this chapter",
    "404 - Page not found", "Internal Server Error", "Access denied. You do not have permission to view this leaf.", "Please enable JavaScript to continue reading.", "Whoops! That link is broken (error 12).", "Traceback (most recent call last):",
    "<html><body><h1>Seite nicht gefunden (404)</h1></body></html>", "Página no encontrada (404)", "Страница не найдена (404)", "页面不存在（404）", "ページが見つかりません（404）", "يرجى تفعيل JavaScript للمتابعة.", "A fine story.\n\nError 502: the server could not complete your request.\n\nIt went on.",
]
GOOD = [
    "“Page not found,” the old screen said, and Ivy laughed at the error.", "On the desk lay a manual about JavaScript, unopened.", "Room 404 was locked, and access to the window was denied to Ilse.", "[Enter Rhys, with a lamp]", "```\nhello = \"Dear ${name}, page {{ n }}\"\n```",
    "<pre><code>x = {{ y }}</code></pre>", "\\begin{itemize}\\item \\emph{one} $x_{i}$\\end{itemize}", "{{quote|A line|author=B}}", "She could not find the page in the old book.", "It was about 7 % more than before.", "None of them came.", "Null hypotheses are undefined here, some say.", "", None,
]


@pytest.mark.parametrize("text", BAD)
def test_found(text, docs_of):
    assert flagged(text)


@pytest.mark.parametrize("text", GOOD)
def test_spared(text):
    assert not flagged(text)


def flagged(text):
    if not text:
        return False
    slot, found = R._scan(text, R.TemplateTree(), GATE)
    return slot or any(map(R.classify, found))


def test_in_spark(docs_of, spark):
    docs = docs_of([(1, BAD[0]), (1, BAD[0]), (2, GOOD[0]), (3, None), (4, ""), (5, "Good prose.\nAccess denied. Ref 77"), (6, "Access denied. Ref 99")])
    assert sorted(r.doc_id for r in R.with_residue(docs).collect()) == [1, 5, 6]
    assert sorted(r.doc_id for r in R.without_residue(docs).collect()) == [2, 3, 4]
    assert R.with_residue(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_masked_names_share_a_template():
    t = R.TemplateTree()
    assert t.add("Access denied (ref77)") == t.add("Access denied (ref99)")


def test_gate_passes_every_message(spark):
    """The fitted classifier passes all generated messages and the bad lines above that are messages, and little prose."""
    gate = R.fit_gate(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert all(gate.passes(s.lower()) for s in R.examples() if R.words_of(s.lower()))
    assert all(gate.passes(s.lower()) for x in BAD for s in R.sentences_of(x) if R.classify(s))
    assert gate.passes("valueerror: something") and not gate.passes("the sailor walked along a river")


def test_slots_where_siblings_differ(docs_of, spark):
    """Many siblings at one place make it a slot, across partitions; one verdict then holds for all of them, also for tokens never seen in a pattern."""
    names = [f"{a}{b}" for a in "KLMNP" for b in ("abel", "ovan", "irit")]
    docs = docs_of([(i, f"Access to this page {n} is denied") for i, n in enumerate(names)] + [(99, "A tale of old ships")]).repartition(4)
    seen = R.residue_evidence(docs, R.Gate({}, 0.0))
    merged = {r.merged for r in R.merged_templates(seen).collect()}
    assert "Access to this page <*> is denied" in merged and "A tale of old ships" in merged and len(merged) == 2


@pytest.mark.parametrize("text", ["Access denied. " + "and so on " * 400, "Access denied " + "and so on " * 400, "By undefined " + "and so on " * 400, "a word " * 200 + "null and null"])
def test_length_changes_no_verdict(text):
    assert flagged(text)


def test_none_is_a_word():
    assert not flagged("None of them came, and None the wiser was the old man who had asked for it all that long day by the sea.")


def test_gate_is_fitted_on_all_documents(docs_of):
    """Weights are those of counts over every sentence, however many documents there are and however they lie."""
    texts = [(i, "The page was gone. A sailor came" if i % 3 else "Access to the river") for i in range(6_000)]
    told = [s for s in R.examples() if R.words_of(s.lower())]
    gate = R.fit_gate(docs_of(texts).repartition(3))
    for word, n in (("page", 4_000), ("was", 4_000), ("access", 2_000), ("the", 6_000), ("denied", 0)):
        held = sum(word in R.words_of(s.lower()) for s in told)
        expected = math.log((held + 0.5) / len(told) * (4_000 * 2 + 2_000 + 1) / (n + 0.5))
        assert gate.weights[word] == pytest.approx(min(R.MOST_WEIGHT, max(0.05, expected)))


def test_gate_loses_no_message(spark, docs_of):
    """Whatever sentence the patterns accept passes, also in spellings and forms that no generated example has."""
    gate = R.fit_gate(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    told = ["401 Unauthorized", "Put the body", "Bad gateways", "Sign in to seek", "1502 bad gateway", "Serverfehlerhaft", "请打开javascript", "In et qui dolore"]
    rng = random.Random(1)
    made = [R.generated(m, rng) + rng.choice(("", "s", "x", "页", " and on", "44")) for m in (*R.MESSAGES, R.MESSAGE_AT_CODE.pattern) for _ in range(200)]
    accepted = [s for s in told + made if R.classify(s)]
    assert len(accepted) > 3_000 and accepted[: len(told)] == told
    assert [s for s in accepted if not gate.passes(s.lower())] == []
    prose = [(i, f"A sailor walked along the river number {i}.") for i in range(50)]
    assert [r.doc_id for r in R.with_residue(docs_of([*prose, (99, "A tale.\n401 Unauthorized")])).collect()] == [99]


def test_least_score():
    """The cheapest alternative; words that may go on count nothing, classes of words their weight."""
    w = {"access": 3.0, "denied": 2.0, "page": 1.5, "gone": 4.0, "error": 5.0, "exception": 6.0, "javascript": 6.0, "asdfgh": 6.0, "serverfehler": 6.0, "404": 2.5}
    assert R.least_score(r"access denied\b|page gone\b", w) == 5.0
    assert R.least_score(r"access denied|page gone\b", w) == 3.0
    assert R.least_score(r"(?:page )?[45]\d\d\b\W*gone$", w) == 6.5
    assert R.least_score(r"[a-z]+error: ", w) == 5.0
    assert R.least_score(r"page .{0,9}gone\b", w) == 1.5
    assert R.least_score(r"page .{0,9}\bgone\b", w) == 5.5


def test_prose_beside_a_message_hides_it_not(docs_of):
    """Where many sentences of prose that now reach the tree make the last word a slot, the message among them is still found."""
    prose = [(i, f"This page is {w}.") for i, w in enumerate("torn old blank yellow stained wet thin burnt folded white".split())]
    assert [r.doc_id for r in R.with_residue(docs_of([*prose, (99, "This page is unavailable.")])).collect()] == [99]
