import pytest

from proselake.llm import markup as M

CASES = [
    ("<p>A <b>bold</b> word</p>", {"html"}),
    ("plain &amp; simple", {"html"}),
    ("&lt;p&gt;escaped&lt;/p&gt;", {"html"}),
    ('cut off <span class="note', {"html"}),
    ("text <!-- hidden -->", {"html"}),
    ("# Heading\n\nText", {"markdown"}),
    ("A Title\n=====\n\nText", {"markdown"}),
    ("a **strong** word and [a link](http://x)", {"markdown"}),
    ("```\n<p>\\emph{x}</p> [[y]]\n```", {"markdown"}),
    ("see [[Other page|there]]", {"wiki"}),
    ("== Head ==\n'''bold'''", {"wiki"}),
    ("{{quote|text|author=me}}", {"wiki"}),
    ("\\section{One} and \\emph{two}", {"latex"}),
    ("so $x_1^2$ holds", {"latex"}),
    ("<pre><code>a = {{ b }} ** 2</code></pre>", {"html"}),
    # not markup
    ("{{ title }} and ${name} and [INSERT author]", set()),
    ("* * *\n\n----------\n\n_______", set()),
    ("*** START OF THE PROJECT EBOOK ***", set()),
    ("- one\n- two\n1. three\n2) four", set()),
    ("<|endoftext|> <s> [INST] <pad>", set()),
    ("He paid $5 and then $7.", set()),
    ("A line of prose\n\n----\n\nanother line", set()),
    ("3 < 4 & 5 > 2", set()),
    ("", set()),
    (None, set()),
]


@pytest.mark.parametrize("text,kinds", CASES)
def test_kinds(text, kinds):
    assert M.kinds_of(text) == kinds


def test_ambiguous_sign_takes_its_neighbours_label():
    assert "markdown" in M.kinds_of("# Sure heading\n\nMaybe heading\n-----\n\ntext")
    assert M.kinds_of("Line of a letter\n-----\nand more of it") == set()


PROSE = "It was the end of the day and she had been on the road to the mill with his letter in her hand for an hour"


def test_measures_decide_uncertain_signs(monkeypatch):
    """A starred phrase in running text is emphasis, in a short line between prose it is not; without the measures nothing is decided."""
    running, lone = f"{PROSE}, and it *was not* for him.", f"{PROSE}.\n\n*was not*\n\n{PROSE}."
    assert M.kinds_of(running) == {"markdown"} and M.kinds_of(lone) == set()
    monkeypatch.setattr(M, "STOP_DENSITY", 2.0)
    assert M.kinds_of(running) == set()


def test_neighbours_decide_short_blocks():
    """The same short block counts beside markup, and doesn't between prose nearer than the markup."""
    head = "Maybe heading\n-----"
    assert M.kinds_of(f"so $x_1^2$ holds\n\n{head}\n\n{PROSE}.") == {"latex", "markdown"}
    assert M.kinds_of(f"so $x_1^2$ holds\n\n{PROSE}.\n\n{head}\n\n{PROSE}.") == {"latex"}
    assert M.kinds_of(f"{PROSE}\n-----\n\n# Heading") == {"markdown"} and M.kinds_of(f"{PROSE}\n-----") == set()


def test_boilerplate_between_boilerplate_is_dropped():
    nav = "[Home page](/a) [Archive page](/b) [Contact page](/c)"
    assert M.clean(f"{nav}\n\nMenu\n\n{nav}\n\n{PROSE}.") == f"{PROSE}."
    assert "Menu" in M.clean(f"{PROSE}.\n\nMenu\n\n{nav}")


def test_headings_of_any_length():
    assert M.kinds_of("Long title " * 40 + "\n=====\n\ntext") == {"markdown"}


def test_clean_keeps_structure():
    t = "# Title\n\n<p>One <b>two</b> &amp; three</p>\n\n- item\n\n```\ncode **as is**\n```\n\n\\[ a_1 = b \\]\n\n[link](x) and [[Page|words]]"
    c = M.clean(t)
    for want in ("Title", "One two & three", "- item", "code **as is**", "\\[ a_1 = b \\]", "link and words"):
        assert want in c
    for gone in ("<p>", "# ", "[[", "](x)"):
        assert gone not in c
    assert M.clean(None) is None and M.clean("plain") == "plain"


def test_in_spark(docs_of):
    got = sorted(map(tuple, M.markup_kinds(docs_of([(1, "<p>x</p> **y**"), (1, "<p>x</p> **y**"), (2, None), (3, "plain")])).collect()))
    assert got == [(1, "html"), (1, "markdown")]
    assert M.clean_texts(docs_of([(2, None)])).first().text is None
