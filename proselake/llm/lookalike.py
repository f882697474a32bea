"""One consistent form for texts that look the same but are made of other characters.

Look-alike strings are joined by union-find over strings and code points: a code point with the string that its width,
ligature, space, ellipsis or accent form stands for (a rule over the whole Unicode data), and the fixed look-alikes
below. Classes are transitive. The representative of a class is its most frequent member in the corpus, strings
included.

A text is rewritten greedily (leftmost, then longest match) by a multi-pattern automaton over the members. It first
spells every member out (a class that holds a longer string by that string, any other by its representative) until
nothing changes, so that members inside members meet; then a second automaton replaces spelled-out strings by their
representatives. The second is a function of the first's result, so texts that look the same come out the same
whichever representatives were chosen.

The counts of code points and strings are the only thing collected: at most 1,114,112 and some hundred pairs, whatever
the size of the corpus. The table made from them can be kept (`save_table`, `load_table`) and used for other corpora,
so that texts normalised on different days compare equal.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.session import materialize

# Letters and signs of other scripts with the Latin or ASCII one they look like.
LOOKALIKES = {
    "A": "ΑА", "B": "ΒВ", "C": "ϹСⅭ", "D": "Ⅾ", "E": "ΕЕ", "F": "Ϝ", "G": "Ԍ",
    "H": "ΗН", "I": "ΙІӀⅠ", "J": "ͿЈ", "K": "ΚКK", "L": "Ⅼ", "M": "ΜМϺⅯ",
    "N": "Ν", "O": "ΟОՕ", "P": "ΡР", "Q": "Ԛ", "S": "ЅՏ", "T": "ΤТ", "V": "ѴⅤ",
    "W": "Ԝ", "X": "ΧХⅩ", "Y": "ΥУҮ", "Z": "Ζ",
    "a": "аɑ", "c": "сϲⅽ", "d": "ԁⅾ", "e": "е", "g": "ɡ", "h": "һ", "i": "іⅰ",
    "j": "јϳ", "l": "ӏⅼ", "m": "ⅿ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ",
    "u": "ս", "v": "νѵⅴ", "w": "ԝ", "x": "хⅹ", "y": "уү", "ı": "ι", "ĸ": "κк", "ᴛ": "τт",
    "'": "‘’‚‛ʼ՚′", '"': "“”„‟",
    "-": "‐‑−", "—": "―", "/": "⁄∕", ":": "ː꞉", "!": "ǃ", "·": "•・∙",
}
# Strings that look like a single sign.
LOOKALIKE_STRINGS = {'"': ["''"]}
#: Forms that stand for the same look, by the tags of the Unicode data.
LOOK_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Marks without any look of their own beside the format characters.
UNSEEN = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)}


def invisible(cp: int) -> bool:
    return unicodedata.category(chr(cp)) == "Cf" or cp in UNSEEN or cp < 32 and cp not in (9, 10, 13) or 127 <= cp < 160 and cp != 0x85


class Classes:
    """Union-find over strings with path halving."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, s: str) -> str:
        p = self.parent
        p.setdefault(s, s)
        while p[s] != s:
            p[s] = s = p[p[s]]
        return s

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[b] = a

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for s in self.parent:
            out.setdefault(self.find(s), []).append(s)
        return out


def _form(ch: str) -> str | None:
    """The string that a code point is only another form of."""
    d = unicodedata.decomposition(ch)
    if not d or d[0] == "<" and d.split(" ", 1)[0] not in LOOK_TAGS:
        n = unicodedata.normalize("NFD", ch)
        return n if n != ch else None
    parts = [chr(int(x, 16)) for x in d.split() if x[0] != "<"]
    if d[0] == "<" and len(parts) > 1 and parts[0] == " ":
        return None  # an accent standing alone
    return "".join(parts)


@lru_cache(1)
def classes() -> list[list[str]]:
    """The look-alike classes of more than one member: a rule over all of Unicode and the fixed values."""
    c = Classes()
    for cp in range(0x110000):
        if 0xAC00 <= cp < 0xE000 or invisible(cp):
            continue  # Hangul syllables are spelled out by the canonical order alone
        ch = chr(cp)
        form = " " if ch == "\t" or unicodedata.category(ch) == "Zs" else _form(ch)
        if form and form != ch:
            c.union(ch, form)
    for x, alike in (*LOOKALIKES.items(), *LOOKALIKE_STRINGS.items()):
        for y in alike:
            c.union(x, y)
    return [sorted(m, key=lambda s: (len(s), s)) for m in c.members().values() if len(m) > 1]


def counted_strings() -> list[str]:
    """Strings of members whose occurrences are counted; those with accents are bounded by the counts of their marks."""
    return [s for m in classes() for s in m if len(s) > 1 and not any(unicodedata.combining(x) for x in s) and not "\u1100" <= s[0] <= "\u11ff"]


class Rewriter:
    """Greedy rewriting by an automaton over the patterns of a table.

    Patterns whose first sign a text lacks cannot match in it, so the automaton holds those of the signs met so far (an
    automaton with all of Unicode at its root would look each sign up among thousands).
    """

    MOST_SIGNS = 400

    def __init__(self, table: dict[str, str]) -> None:
        self.of: dict[str, list[tuple[str, str]]] = {}
        for k, v in table.items():
            self.of.setdefault(k[0], []).append((k, v))
        self.met: set[str] = set()
        self.automaton: ahocorasick.Automaton | None = None

    def matches(self, text: str) -> Iterator[tuple[int, tuple[int, str]]]:
        """(last place, (length, replacement)) of the leftmost longest matches."""
        first = {c for c in set(text) if c in self.of}
        if not first:
            return iter(())
        if not first <= self.met:
            self.met = first | self.met if len(self.met) < self.MOST_SIGNS else first
            self.automaton = ahocorasick.Automaton()
            for c in self.met:
                for k, v in self.of[c]:
                    self.automaton.add_word(k, (len(k), v))
            self.automaton.make_automaton()
        return self.automaton.iter_long(text)

    def __call__(self, text: str) -> str:
        out, at = [], 0
        for end, (n, to) in self.matches(text):
            out += (text[at : end - n + 1], to)
            at = end + 1
        return "".join(out) + text[at:] if out else text


@dataclass
class Table:
    """spelled: member to what it is spelled out as. kept: spelled-out string to its representative."""

    spelled: dict[str, str]
    kept: dict[str, str]
    _automata: tuple | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"spelled": self.spelled, "kept": self.kept, "_automata": None}

    def rewrite(self, text: str) -> str:
        """The consistent form; marks that follow one letter in another order come in canonical order."""
        if self._automata is None:
            self._automata = Rewriter(self.spelled), Rewriter(self.kept)
        out, back = self._automata
        return back(self._spell(text.replace("\r\n", "\n"), out))

    @staticmethod
    def _spell(t: str, out: Rewriter) -> str:
        for _ in range(16):
            if (u := out(t)) == t:
                break
            t = u
        return t if t.isascii() else unicodedata.normalize("NFD", t)


def table_of(counts: dict[str, int]) -> Table:
    """The table from how often code points and counted strings stand in a corpus; without counts, of the rule's own order."""

    def often(s: str) -> int:
        if s in counts or len(s) == 1:
            return counts.get(s, 0)
        return min(counts.get(x, 0) // s.count(x) for x in s)

    spelled = {chr(cp): "" for cp in range(0x110000) if not 0xD800 <= cp < 0xE000 and invisible(cp)}
    best: dict[str, str] = {}
    for ms in classes():
        rep = max(ms, key=lambda m: (often(m), len(m), m != "\t", -ord(m[0])))
        whole = max(ms, key=lambda m: (len(m), often(m), -ord(m[0]))) if len(ms[-1]) > 1 else rep
        spelled |= {m: whole for m in ms if m != whole}
        if whole != rep:
            best[whole] = rep
    out = Rewriter(spelled)
    kept: dict[str, str] = {}
    for whole, rep in sorted(best.items(), key=lambda x: -often(x[1])):
        kept.setdefault(Table._spell(whole, out), rep)
    return Table(spelled, kept)


def counts_of(documents: DataFrame) -> dict[str, int]:
    """How often each code point and each counted string stands in the corpus. Collected: at most one row for each of them."""
    strings = counted_strings()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = np.zeros(0x110000, np.int64), {s: 0 for s in strings}
        a = Rewriter({s: s for s in strings})
        for b in batches:
            text = "\x00".join(x for x in b.column(0).to_pylist() if x)
            for _, (_, s) in a.matches(text):
                found[s] += 1
            if text.isascii():
                part = np.bincount(np.frombuffer(text.encode("ascii"), np.uint8), minlength=128)
            else:
                part = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
            total[: len(part)] += part
        cps = [int(c) for c in np.flatnonzero(total) if c and not 0xD800 <= c < 0xE000]
        got = [(chr(c), int(total[c])) for c in cps] + [x for x in found.items() if x[1]]
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64())], ["s", "n"])

    rows = documents.select("text").mapInArrow(count, "s string, n bigint").groupBy("s").agg(F.sum("n").alias("n")).collect()
    return {r.s: r.n for r in rows}


def learn_table(documents: DataFrame) -> Table:
    return table_of(counts_of(documents))


def table_rows(spark: SparkSession, table: Table) -> DataFrame:
    """(stage, member, form) of a table: stage 1 spells out, stage 2 replaces by representatives."""
    return spark.createDataFrame([(1, a, b) for a, b in table.spelled.items()] + [(2, a, b) for a, b in table.kept.items()], "stage int, member string, form string")


def save_table(spark: SparkSession, table: Table, path: str) -> None:
    """Keep a table as Parquet, so that later corpora are rewritten alike."""
    table_rows(spark, table).coalesce(1).write.parquet(path)


def load_table(spark: SparkSession, path: str) -> Table:
    rows = spark.read.parquet(path).collect()  # as many as classes have members
    return Table({r.member: r.form for r in rows if r.stage == 1}, {r.member: r.form for r in rows if r.stage == 2})


def normalized(documents: DataFrame, keep_text: bool = True, table: Table | None = None) -> DataFrame:
    """(doc_id, text, raw_hash, look_hash, letters): the consistent form of each text, with hashes of the raw text and of that form.

    Null texts stay null and have null hashes; empty ones have the hash of the empty string. letters: whether the
    text holds a letter. Repeated rows and clashing columns don't matter: only doc_id and text are read. Without a
    table, one is learned from the documents.
    """
    table = table or learn_table(documents)
    names = ["doc_id", *["text"] * keep_text, "raw_hash", "look_hash", "letters"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            texts = b.column(1).to_pylist()
            looks = [None if t is None else table.rewrite(t) for t in texts]
            cols = [b.column(0)]
            if keep_text:
                cols.append(pa.array(looks, pa.string()))
            cols.append(pa.array([None if t is None else digest(t.encode("utf-8", "surrogatepass")) for t in texts], pa.binary()))
            cols.append(pa.array([None if t is None else digest(t.encode("utf-8", "surrogatepass")) for t in looks], pa.binary()))
            cols.append(pa.array([bool(t) and any(map(str.isalpha, t)) for t in texts], pa.bool_()))
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id bigint, " + "text string, " * keep_text + "raw_hash binary, look_hash binary, letters boolean"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def look_classes(documents: DataFrame, table: Table | None = None) -> DataFrame:
    """(doc_id, look_hash, raw_hash, variants, links): the class of each document with letters whose text has look-alikes
    made of other characters; links: how many documents of other characters look like it."""
    forms = materialize(normalized(documents, False, table).where("letters").select("doc_id", "raw_hash", "look_hash").distinct())
    # at first one row for each variant, so that any number of exact copies of a text comes to one row a partition
    copies = forms.groupBy("look_hash", "raw_hash").agg(F.count(F.lit(1)).alias("copies"))
    many = copies.groupBy("look_hash").agg(F.count(F.lit(1)).alias("variants"), F.sum("copies").alias("members")).where("variants > 1")
    links = copies.join(many, "look_hash").select("look_hash", "raw_hash", "variants", (F.col("members") - F.col("copies")).alias("links"))
    return forms.join(links, ["look_hash", "raw_hash"])


#: Parts into which the variants of one class are split where they are paired.
SALTS = 16


def lookalike_pairs(documents: DataFrame, table: Table | None = None) -> DataFrame:
    """(doc_id_a, doc_id_b): each pair of documents that look the same but aren't made of the same characters.

    Pairs are made of variants (distinct raw texts), spread by salt, and then joined with the documents of each variant,
    so that no class is one key of a join.
    """
    rows = look_classes(documents, table)
    v = rows.select("look_hash", "raw_hash").distinct()
    a = v.select("look_hash", F.col("raw_hash").alias("ra"), F.pmod(F.xxhash64("raw_hash"), F.lit(SALTS)).cast("int").alias("salt"))
    b = v.select("look_hash", F.col("raw_hash").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = a.join(b, ["look_hash", "salt"]).where("ra < rb").select("ra", "rb")
    one, two = (rows.select(F.col("doc_id").alias(d), F.col("raw_hash").alias(r)) for d, r in (("x", "ra"), ("y", "rb")))
    return pairs.join(one, "ra").join(two, "rb").where("x <> y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()
