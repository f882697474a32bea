"""Markup residue in text documents: which kinds a text holds, and clean text with its structure.

Texts are cut into blocks at blank lines, code blocks kept whole. Signs of markup are of two sorts: certain ones, and
uncertain ones that plain text also has (a starred or underscored phrase, a line above a row of dashes). Two passes
label the blocks and decide the uncertain signs. In the first, each block is measured (length, density of stop words,
density of links) and is decided where the measures are clear: a block with a certain sign is markup, or boilerplate if
it is nearly all links and has few stop words; running text, long and rich in stop words, is prose, and a phrase set
off by stars or underscores in it is emphasis, while a row of dashes below it is only a rule. In the second, blocks
left ambiguous take the label of the nearest decided blocks before and after: between blocks of which one is markup, an
uncertain sign counts as markdown, between prose it doesn't; a short block with boilerplate on both sides is boilerplate.
What a code block shows is not looked at.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from proselake.llm.repetition import UNSPACED

# Names of HTML elements (without those of one letter that serve as special tokens).
ELEMENTS = (
    "html head title body base link meta style script noscript template section nav article aside header footer address main h1 h2 h3 h4 h5 h6 hgroup "
    "p hr pre blockquote ol ul li dl dt dd figure figcaption div a em strong small cite q dfn abbr ruby rt rp data time code var samp kbd sub sup i b u mark "
    "bdi bdo span br wbr ins del picture source img iframe embed object param video audio track map area svg math table caption colgroup col tbody thead tfoot "
    "tr td th form label input button select datalist optgroup option textarea output progress meter fieldset legend details summary dialog canvas center font "
    "big strike tt frame frameset nobr marquee"
).split()
# Frequent words of the languages that put spaces between words.
STOP_WORDS = frozenset(
    "the a an and or but of to in on at by for with from as is was were be been had has have it its he she they we you his her their that this not no "
    "der die das und ein eine in zu von mit den dem des ist war nicht im am bei nach le la les un une et de du des en à au aux est était que qui ne pas "
    "dans pour sur el los las y una del al era con por para sin no se su que en и в на не что с по из у за к от до как это он она они о "
    "का के की है था में से को और ने पर पास في من على إلى عن مع كان التي الذي هذا لم ما".split()
)
# Frequent particles and words of scripts without spaces.
UNSPACED_STOP_WORDS = ("的", "了", "是", "在", "我", "不", "他", "这", "の", "は", "が", "を", "に", "で", "と", "も", "และ", "ที่", "ใน", "ไม่", "ของ", "ว่า")
_TAG = "|".join(sorted(ELEMENTS, key=len, reverse=True))
HTML = re.compile(
    rf"<!--|<!DOCTYPE|<!\[CDATA\[|</?(?:{_TAG})(?:\s[^<>]*)?/?>|</?(?:{_TAG})\s+[\w-]+\s*=[^<>]*$|</?(?:{_TAG})\s*\Z|<[a-z][a-z0-9]*\s+(?:class|href|src|id|style)\s*=|&lt;/?(?:{_TAG})\b|&lt;!--"
    r"|&(?:amp|lt|gt|quot|apos|nbsp|mdash|ndash|hellip|ldquo|rdquo|lsquo|rsquo|copy|reg|eacute|egrave|agrave|uuml|ouml|auml|szlig|ntilde|laquo|raquo|shy|middot|bull|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});",
    re.I | re.M,
)
HTML_HINT = re.compile(r"[<&]")
MARKDOWN = re.compile(
    r"^ {0,3}#{1,6} +\S|^ {0,3}>+ ?\S|!\[[^\]\n]*\]\([^)\n]*\)|(?<!\[)\[[^\[\]\n]+\]\((?!\s)[^)\n]*\)|(?<!\*)\*\*(?![\s*])[^*\n]+(?<!\s)\*\*(?!\*)|(?<![\w_])__(?![\s_])[^_\n]+(?<!\s)__(?![\w_])"
    r"|^ {0,3}\|?(?: *:?-{3,}:? *\|)+ *:?-* *\|? *$|^\[[^\]\n]+\]: +\S+|^ *[-*+] \[[ xX]\] |~~[^~\n]+~~|^\[\^[^\]\n]+\]:|(?<!\[)\[[^\[\]\n]+\]\((?:/|https?:)[^\s)]*\Z",
    re.M,
)
SETEXT = re.compile(r"^(?=[^\n]*[^\W\d_])(?!\s*[|>#=*-])[^\n]+\n={3,}[ \t]*$", re.M)
SETEXT_DASHES = re.compile(r"^(?=[^\n]*[^\W\d_])(?!\s*[|>#=*-])([^\n]+)\n-{3,}[ \t]*$", re.M)
STARRED = re.compile(r"(?<![\w*])\*(?![\s*])[^*\n]+(?<![\s*])\*(?![\w*])|(?<![\w_])_(?![\s_])[^_\n]+(?<![\s_])_(?![\w_])")
WIKI = re.compile(
    r"\[\[(?!\s*(?:INSERT|YOUR)\b)[^\[\]\n]+(?:\]\]|\Z)|'''?(?=[^\s'])[^'\n]+(?:'[^'\n]+)*'''?|^(={2,6}) *[^=\n]+? *\1[ \t]*$|^\{\||^\|\}|^\|-[ \t]*$|\{\{[A-Za-z][^{}|\n]*\|[^{}]*(?:\}\}|\Z)|<ref\b|</ref>|^__(?:NO)?TOC__|^#REDIRECT\b|(?<!\[)\[https?://\S+ [^\]\n]+\](?!\()",
    re.M,
)
LATEX = re.compile(
    r"\\(?:begin|end)\{|\\\[|\\\]|\\\((?=.)|\$\$|(?<![\\$\w])\$(?=[^$\n]*(?:\\[a-zA-Z]|[\^_=+<>{}]))(?![\s\d]*\$)[^$\n]+\$(?!\d)|(?<![\w:\\])\\[a-zA-Z]{2,}\*?(?=[\s{\[\\$^_.,;)]|$)",
    re.M,
)
FENCE = re.compile(r"(?ms)^[ \t>]*(`{3,}|~{3,})[^\n]*$.*?(?:^[ \t>]*\1[`~]*[ \t]*$|\Z)")
PRE = re.compile(r"(?is)<(pre|code|samp|kbd|textarea|syntaxhighlight|source|nowiki|script|style)\b[^>]*>(.*?)(?:</\1\s*>|\Z)|&lt;(pre|code)\b.*?(?:&lt;/\3\s*&gt;|\Z)")
VERBATIM = re.compile(r"(?s)\\begin\{(verbatim\*?|lstlisting|minted|alltt)\}.*?(?:\\end\{\1\}|\Z)")
INLINE_CODE = re.compile(r"(?<![`\\])`(?!`)[^`\n]+`(?!`)")
PLACEHOLDER = re.compile(r"\{\{\s*[\w. ]+\s*\}\}|\{%[^%\n]*%\}|\$\{[^}\n]*\}|#\{[^}\n]*\}|@@[\w. ]+@@|<%[^%\n]*%>|(?<![\w\\}\]^_{])\{[\w. ]+\}")
TOKENS = re.compile(r"<\|[^|<>\n]*\|>|</?s>|<(?:pad|unk|mask|bos|eos|cls|sep)>|\[/?(?:INST|CLS|SEP|MASK|PAD|UNK|BOS|EOS)\]|<</?SYS>>", re.I)
BOOK_MARK = re.compile(r"(?m)^[^\w\n]*\*{2,}\s*(?:START|END)\s+OF\b.*$")
LINK = re.compile(r"<a\b[^>]*>.*?(?:</a>|$)|\[[^\[\]\n]+\]\([^)\n]*\)|\[\[[^\[\]\n]+\]\]|https?://\S+", re.I)
#: A block of fewer words is short; the densities of stop words and of links that decide a block.
SHORT, STOP_DENSITY, LINK_DENSITY = 10, 0.12, 0.6
#: Strings without one of which a text or block holds no sign at all, of all kinds and by kind.
SIGNS_MARKDOWN = ("# ", "](", "]:", "**", "__", "~~", "---", ">", "[x]", "[X]", "[ ]")
SIGNS_WIKI = ("[[", "''", "==", "{|", "|}", "|-", "{{", "<ref", "</ref", "__", "#REDIRECT", "[http")
SIGNS = tuple(dict.fromkeys(("<", "&", "`", "\\", "$", "~~~", "*", "_", "\n>", *SIGNS_MARKDOWN[:7], *SIGNS_MARKDOWN[8:], *SIGNS_WIKI)))
STAR_PAIR = re.compile(r"\*[^\s*][^*\n]*\*|_[^\s_][^_\n]*_")


def has_signs(text: str) -> bool:
    return text[:1] == ">" or any(s in text for s in SIGNS if s not in "*_") or (("*" in text or "_" in text) and STAR_PAIR.search(text) is not None)


@dataclass
class Block:
    text: str
    words: int = 0
    stop: float = 0.0
    links: float = 0.0
    kinds: set[str] = field(default_factory=set)
    unsure: set[str] = field(default_factory=set)
    label: str = ""


def strip_code(text: str) -> tuple[str, set[str]]:
    """The text without what code blocks show, and the kinds of the marks that enclose them."""
    kinds: set[str] = set()

    def gone(kind: str):
        def sub(m: re.Match) -> str:
            kinds.add("wiki" if kind == "html" and re.match(r"(?i)<(?:syntaxhighlight|source|nowiki)", m.group(0)) else kind)
            return " "

        return sub

    if "```" in text or "~~~" in text:
        text = FENCE.sub(gone("markdown"), text)
    text = VERBATIM.sub(gone("latex"), text)
    if "<" in text or "&lt;" in text:
        text = PRE.sub(gone("html"), text)
    if "`" in text:
        text = INLINE_CODE.sub(gone("markdown"), text)
    return text, kinds


def measure(block: str) -> Block:
    """First pass: a block with its measures, its certain and uncertain signs, and its label if these decide it."""
    words = re.findall(r"[^\W\d_]+", block.lower())
    b = Block(block, len(words))
    stop = sum(w in STOP_WORDS for w in words)
    if not block.isascii() and 2 * (letters := len(UNSPACED.findall(block))) > sum(map(len, words)):
        b.words, stop = letters // 2, sum(map(block.count, UNSPACED_STOP_WORDS))  # a word of two characters
    b.stop = stop / b.words if b.words else 0.0
    b.links = sum(len(m.group(0)) for m in LINK.finditer(block)) / max(1, len(block)) if "[" in block or "<a" in block or "http" in block else 0.0
    if HTML_HINT.search(block) and HTML.search(block):
        b.kinds.add("html")
    if any(x in block for x in SIGNS_MARKDOWN) and MARKDOWN.search(block) or "===" in block and SETEXT.search(block):
        b.kinds.add("markdown")
    if any(x in block for x in SIGNS_WIKI) and WIKI.search(block):
        b.kinds.add("wiki")
    if ("\\" in block or "$" in block) and LATEX.search(block):
        b.kinds.add("latex")
    running = b.words >= SHORT and b.stop >= STOP_DENSITY
    if ("*" in block or "_" in block) and STARRED.search(block):
        (b.kinds if running else b.unsure).add("markdown")
    if "---" in block and any(_title(m.group(1)) for m in SETEXT_DASHES.finditer(block)):
        b.unsure.add("markdown")
    if b.kinds:
        b.label = "boilerplate" if b.links > LINK_DENSITY and b.stop < STOP_DENSITY and b.words >= 3 else "markup"
    elif not b.unsure and (b.words >= SHORT or b.stop >= STOP_DENSITY):
        b.label = "prose"
    return b


def _title(line: str) -> bool:
    """Whether a line above a row of dashes may be a heading: short or without the stop words of running text."""
    words = re.findall(r"[^\W\d_]+", line.lower())
    return len(words) < SHORT or sum(w in STOP_WORDS for w in words) < STOP_DENSITY * len(words)


def blocks_of(text: str) -> tuple[list[Block], set[str]]:
    """Both passes: the labelled blocks of a text, and the kinds of its code blocks' marks."""
    body, kinds = strip_code(text.replace("\r\n", "\n").replace("\r", "\n"))
    body = BOOK_MARK.sub(" ", PLACEHOLDER.sub(" ", TOKENS.sub(" ", body)))
    blocks = [measure(x) for x in re.split(r"\n[ \t]*\n", body) if x.strip()]
    first = [b.label for b in blocks]
    before, after, last = [""] * len(blocks), [""] * len(blocks), ""
    for i, label in enumerate(first):
        before[i], last = last, label or last
    last = ""
    for i in range(len(blocks) - 1, -1, -1):
        after[i], last = last, first[i] or last
    for b, x, y in zip(blocks, before, after):
        if b.unsure and "markup" in (x, y, b.label):
            b.kinds |= b.unsure
        if not b.label:
            b.label = "markup" if b.kinds else "boilerplate" if x == y == "boilerplate" and b.words < SHORT else "prose"
    return blocks, kinds


def kinds_of(text: str | None) -> set[str]:
    """The kinds of markup in a text."""
    if not text or not has_signs(text):
        return set()
    blocks, kinds = blocks_of(text)
    return kinds.union(*(b.kinds for b in blocks)) if blocks else kinds


_CLEAN = [
    (re.compile(r"(?s)<!--.*?(?:-->|\Z)"), ""),
    (re.compile(r"(?is)<(script|style|nav)\b[^>]*>.*?(?:</\1\s*>|\Z)"), ""),
    (re.compile(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1\s*>"), r"\n\n\2\n\n"),
    (re.compile(r"(?i)<li\b[^>]*>"), "\n- "),
    (re.compile(r"(?i)</t[dh]>\s*<t[dh]\b[^>]*>"), " | "),
    (re.compile(r"(?i)<br\s*/?>|</(?:p|div|li|tr|ul|ol|table|blockquote|section)>"), "\n"),
    (re.compile(rf"(?i)</?(?:{_TAG})(?:\s[^<>]*)?/?>|</?(?:{_TAG})\s+[\w-]+\s*=[^<>]*$", re.M), ""),
    (re.compile(r"(?m)^ {0,3}#{1,6} +(.*?)[ #]*$"), r"\n\1\n"),
    (re.compile(r"(?m)^([^\n]+)\n(?:={3,})[ \t]*$"), r"\n\1\n"),
    (re.compile(r"(?m)^={2,6} *([^=\n]+?) *={2,6}[ \t]*$"), r"\n\1\n"),
    (re.compile(r"!\[([^\]\n]*)\]\([^)\n]*\)"), r"\1"),
    (re.compile(r"(?<!\[)\[([^\[\]\n]+)\]\([^)\n]*\)"), r"\1"),
    (re.compile(r"\[\[(?:Category|File|Image):[^\[\]\n]*\]\]\n?"), ""),
    (re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]"), r"\1"),
    (re.compile(r"\{\{quote\|([^|{}]*)(?:\|[^{}]*)?\}\}"), r"\1"),
    (re.compile(r"(?m)^\{\|.*$|^\|\}[ \t]*$|^\|-[ \t]*$\n?"), ""),
    (re.compile(r"(?m)^[|!] ?(.+)$"), lambda m: re.sub(r" ?(\|\||!!) ?", " | ", m.group(1)).rstrip(" |")),
    (re.compile(r"'''?([^'\n]+)'''?"), r"\1"),
    (re.compile(r"\*\*([^*\n]+)\*\*"), r"\1"),
    (re.compile(r"(?m)^ {0,3}> ?"), ""),
    (re.compile(r"\\(?:part|chapter|(?:sub)*section)\*?\{([^{}\n]*)\}"), r"\n\1\n"),
    (re.compile(r"\\item\b ?"), "- "),
    (re.compile(r"\\(?:emph|textbf|textit|text|underline)\{([^{}\n]*)\}"), r"\1"),
    (re.compile(r"~?\\(?:cite|label|ref|footnote)\{[^{}\n]*\}"), ""),
    (re.compile(r"\\(?:begin|end)\{(?:document|itemize|enumerate|center|quote|quotation)\}"), ""),
]


def clean(text: str | None) -> str | None:
    """The text without markup. Headings stand alone between line ends, items begin with "- ", cells are parted by
    " | ", code blocks come between ``` lines as they were, formulas keep their LaTeX. Boilerplate blocks are dropped."""
    if not text or not has_signs(text):
        return text
    kept: list[str] = []

    def keep(body: str, block: bool) -> str:
        kept.append(f"\n```\n{body.strip(chr(10))}\n```\n" if block else body)
        return f"\x00{len(kept) - 1}\x01"

    t = text.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "").replace("\x01", "")
    if "&lt;" in t and re.search(rf"(?i)&lt;/?(?:{_TAG})\b", t):
        t = html.unescape(t)
    t = FENCE.sub(lambda m: keep("\n".join(m.group(0).split("\n")[1:]).rsplit(m.group(1), 1)[0], True), t)
    t = VERBATIM.sub(lambda m: keep(re.sub(r"^\\begin\{[^}]*\}(?:\[[^\]]*\])?|\\end\{[^}]*\}$", "", m.group(0)), True), t)
    t = re.sub(r"(?is)<pre\b[^>]*>(?:\s*<code\b[^>]*>)?(.*?)(?:</code>\s*)?(?:</pre\s*>|\Z)", lambda m: keep(html.unescape(m.group(1)), True), t)
    t = re.sub(r"(?s)\\\[.*?\\\]|\$\$.*?\$\$|\$(?=[^$\n]*[\\^_=])[^$\n]+\$", lambda m: keep(m.group(0), False), t)
    drop = {b.text for b in blocks_of(t)[0] if b.label == "boilerplate"}
    t = "\n\n".join(x for x in re.split(r"\n[ \t]*\n", t) if x not in drop)
    for pattern, to in _CLEAN:
        t = pattern.sub(to, t)
    t = html.unescape(t)
    while "\x00" in t:
        t = re.sub(r"\x00(\d+)\x01", lambda m: kept[int(m.group(1))], t)
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def markup_kinds(documents: DataFrame) -> DataFrame:
    """(doc_id, kind): a row for each document and kind of markup in it. Null, empty and plain texts have none; repeated
    rows count once; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kinds = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k in sorted(kinds_of(t)):
                    ids.append(i), kinds.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string())], ["doc_id", "kind"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, kind string").distinct()


def clean_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with the markup taken out; null stays null, and texts without markup stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([clean(t) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, text string")
