"""Derived tables of a corpus: texts, tokens, sentences, paragraphs, speech."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.functions import text as T
from proselake.plans.registry import query, r6
from proselake.session import spread, table


def bodies(documents: DataFrame, *more: str) -> DataFrame:
    """(doc_id, body, more): canonical texts; null texts are empty."""
    return documents.select("doc_id", *more, T.body(F.coalesce("text", F.lit(""))).alias("body"))


def tokens(documents: DataFrame, *more: str) -> DataFrame:
    """(doc_id, more, i, token, word): a row for each word."""
    w = bodies(documents, *more).select("doc_id", *more, F.posexplode(T.words(F.col("body"))).alias("i", "word"))
    return w.select("doc_id", *more, "i", F.translate(F.lower("word"), "’", "'").alias("token"), "word")


def paragraphs(documents: DataFrame) -> DataFrame:
    """(doc_id, p, paragraph, n_words, n_sentences)."""
    p = bodies(documents).select("doc_id", F.posexplode(T.paragraphs(F.col("body"))).alias("p", "paragraph"))
    return p.select("doc_id", "p", "paragraph", F.size(T.words(F.col("paragraph"))).alias("n_words"), F.size(T.sentences_of_paragraph(F.col("paragraph"))).alias("n_sentences"))


def sentences(documents: DataFrame, channel: str = "full") -> DataFrame:
    """(doc_id, s, sentence, n_words) of the whole text, of its dialogue or of its narration."""
    b = bodies(documents)
    source = {"full": F.col("body"), "dialogue": T.dialogue(F.col("body")), "narration": T.narration(F.col("body"))}[channel]
    s = b.select("doc_id", F.posexplode(F.flatten(T.sentences(source))).alias("s", "sentence"))
    return s.select("doc_id", "s", "sentence", F.size(T.words(F.col("sentence"))).alias("n_words"))


def quotations(documents: DataFrame) -> DataFrame:
    """(doc_id, q, content)."""
    return bodies(documents).select("doc_id", F.posexplode(T.quotations(F.col("body"))).alias("q", "content"))


# SQL of the same views, as common table expressions.
WORD_SQL = T.WORD.replace("'", "''")
LETTER_SQL = T.LETTER
_STRIP = r"regexp_replace({0}, '^\s+|\s+\z', '', 'g')"


def _body_sql(text: str) -> str:
    x = f"regexp_replace({text}, '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace(regexp_replace({x}, '{T.GUTENBERG_START}', ''), '{T.GUTENBERG_END}', '')"
    x = _STRIP.format(x)
    return f"regexp_replace(regexp_replace({x}, '{T.SETEXT}', chr(10), 'g'), '{T.ATX}', chr(10), 'g')"


BODY = f"b AS (SELECT doc_id, source, lang, {_body_sql('coalesce(text, chr(32))')} AS body FROM documents)"
TOK = BODY + f""", wl AS (SELECT doc_id, source, regexp_extract_all(body, '{WORD_SQL}') AS ws FROM b),
tok AS (SELECT doc_id, source, unnest(range(len(ws))) AS i, unnest(ws) AS word, replace(lower(unnest(ws)), '’', '''') AS token FROM wl)"""
PARA = BODY + f""", pl AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(body, '\\n[ \\t]*\\n+'),
  lambda x: {_STRIP.format("regexp_replace(x, '[ \\t]*\\n[ \\t]*', ' ', 'g')")}), lambda x: regexp_matches(x, '{LETTER_SQL}')) AS ps FROM b),
para AS (SELECT doc_id, unnest(range(len(ps))) AS p, unnest(ps) AS paragraph FROM pl)"""
_SPLIT = "list_filter(list_transform(string_split(regexp_replace({0}, '{1}', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda y: {2}), lambda y: regexp_matches(y, '{3}'))"


def split_sql(p: str) -> str:
    return _SPLIT.format(p, T.SENTENCE_END.replace("'", "''"), _STRIP.format("y"), LETTER_SQL)


SENT = PARA + f""", sl AS (SELECT doc_id, p, {split_sql('paragraph')} AS ss FROM para),
s0 AS (SELECT doc_id, p, unnest(range(len(ss))) AS k, unnest(ss) AS sentence FROM sl),
sent AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY p, k) - 1 AS s, sentence, len(regexp_extract_all(sentence, '{WORD_SQL}')) AS n_words FROM s0)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


@query("canon_body", f"WITH {BODY} SELECT doc_id, body FROM b")
def canon_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical text of each document."""
    d = docs(spark, sf_dir)
    return d.select("doc_id", T.body(F.coalesce("text", F.lit(" "))).alias("body"))


@query("canon_quotes", "SELECT doc_id, translate(text, '“”‘’', '\"\"''''') AS text FROM documents")
def canon_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight quotes."""
    return docs(spark, sf_dir).select("doc_id", T.normalize_quotes(F.col("text")).alias("text"))


@query(
    "canon_transcript",
    rf"""WITH l AS (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS text, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, text, array_to_string(list_filter(ls, lambda x: NOT regexp_matches(x, '{T.TRANSCRIPT}')), chr(10)) AS kept, array_to_string(list_filter(ls, lambda x: regexp_matches(x, '{T.TRANSCRIPT}')), chr(10)) AS gone FROM l)
SELECT doc_id, kept, round(CASE WHEN len(regexp_extract_all(text, '{WORD_SQL}')) > 0 THEN 100.0 * len(regexp_extract_all(gone, '{WORD_SQL}')) / len(regexp_extract_all(text, '{WORD_SQL}')) ELSE 0 END, 6) AS transcript_share FROM m""",
)
def canon_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text without transcript lines, and the share of words in them."""
    d = docs(spark, sf_dir).where("text is not null").select("doc_id", T.unify_line_ends(F.col("text")).alias("text"))
    kept, share = T.transcript_parts(F.col("text"))
    return d.select("doc_id", kept.alias("kept"), r6(share).alias("transcript_share"))


@query("view_tokens", f"WITH {TOK} SELECT doc_id, i, token FROM tok")
def view_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(docs(spark, sf_dir)).select("doc_id", F.col("i").cast("bigint").alias("i"), "token")


@query("view_sentences", f"WITH {SENT} SELECT doc_id, s, sentence, n_words FROM sent")
def view_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sentences(docs(spark, sf_dir))
    return s.select("doc_id", F.col("s").cast("bigint").alias("s"), "sentence", F.col("n_words").cast("bigint").alias("n_words"))


@query("view_paragraphs", f"WITH {PARA} SELECT doc_id, p, paragraph, len(regexp_extract_all(paragraph, '{WORD_SQL}')) AS n_words, len({split_sql('paragraph')}) AS n_sentences FROM para")
def view_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paragraphs(docs(spark, sf_dir))
    return p.select("doc_id", F.col("p").cast("bigint").alias("p"), "paragraph", *(F.col(c).cast("bigint").alias(c) for c in ("n_words", "n_sentences")))


QUOTED_SQL = T.QUOTED.replace("'", "''")


@query(
    "view_quotations",
    f"""WITH {BODY}, q AS (SELECT doc_id, regexp_extract_all(body, '{QUOTED_SQL}') AS qs FROM b)
SELECT doc_id, unnest(range(len(qs))) AS q, regexp_replace(unnest(qs), '^[“"]|[”"]\\z', '', 'g') AS content FROM q""",
)
def view_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations(docs(spark, sf_dir)).select("doc_id", F.col("q").cast("bigint").alias("q"), "content")


@query("view_narration", f"WITH {BODY} SELECT doc_id, regexp_replace(body, '{QUOTED_SQL}', '', 'g') AS narration FROM b")
def view_narration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.narration(T.body(F.coalesce("text", F.lit(" ")))).alias("narration"))


@query(
    "dialogue_word_share",
    f"""WITH {BODY}, c AS (SELECT doc_id, len(regexp_extract_all(body, '{WORD_SQL}')) AS w,
  len(regexp_extract_all(array_to_string(regexp_extract_all(body, '{QUOTED_SQL}'), chr(10)), '{WORD_SQL}')) AS d FROM b)
SELECT doc_id, CASE WHEN w > 0 THEN round(100.0 * d / w, 6) END AS dialogue_share FROM c""",
)
def dialogue_word_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentage of a document's words spoken within double quotes."""
    b = bodies(docs(spark, sf_dir))
    spoken = F.array_join(F.regexp_extract_all("body", F.lit(T.QUOTED), F.lit(0)), "\n")
    c = b.select("doc_id", F.size(T.words(F.col("body"))).alias("w"), F.size(T.words(spoken)).alias("d"))
    return c.select("doc_id", F.when(F.col("w") > 0, r6(100.0 * F.col("d") / F.col("w"))).alias("dialogue_share"))
