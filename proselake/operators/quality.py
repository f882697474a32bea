"""Mechanical quality of texts: odd characters, mixed typography, unbalanced marks, scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.operators.views import docs
from proselake.plans.registry import query, r6

# Classes of characters and their patterns.
CHARACTERS = {
    "control": r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "zero_width": r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]", "replacement": r"\x{FFFD}", "nonbreaking": r"[\x{A0}\x{202F}\x{2007}]",
    "private_use": r"\p{Co}", "whitespace_run": r"[ \t]{2,}", "broken_hyphen": r"[A-Za-z]{2,}-\n[ \t]*[a-z]{2,}", "mojibake": r"Ã[\x{80}-\x{BF}]|â€",
}
WORDLIKE, CAPS = r"[\p{L}\p{M}\p{N}_]+", "^[A-Z]{2,}$"
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Devanagari", "Thai", "Han", "Hiragana", "Katakana", "Hangul", "Hebrew")


def count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


@query("quality_characters", "SELECT doc_id, length(text) AS n_chars, " + ", ".join(f"round(1000.0 * len(regexp_extract_all(text, '{p}')) / length(text), 6) AS {k}_rate" for k, p in CHARACTERS.items()) + f", round(1000.0 * len(list_filter(regexp_extract_all(text, '{WORDLIKE}'), lambda x: regexp_matches(x, '{CAPS}'))) / length(text), 6) AS caps_word_rate FROM documents WHERE length(text) > 0")
def quality_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd characters and typography per thousand characters."""
    d = docs(spark, sf_dir).where("length(text) > 0")
    return d.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), *(r6(1000.0 * count(F.col("text"), p) / F.length("text")).alias(f"{k}_rate") for k, p in CHARACTERS.items()), r6(1000.0 * F.size(F.filter(F.regexp_extract_all("text", F.lit(WORDLIKE), F.lit(0)), lambda w: w.rlike(CAPS))) / F.length("text")).alias("caps_word_rate"))


@query(
    "quality_scripts",
    "WITH s AS (SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '\\p{{{s}}}')) AS {s.lower()}" for s in SCRIPTS) + ", len(regexp_extract_all(text, '\\p{L}')) AS letters FROM documents WHERE text IS NOT NULL) SELECT * FROM s WHERE letters > 0",
)
def quality_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each script, and letters."""
    d = docs(spark, sf_dir).where("text is not null").select("doc_id", *(count(F.col("text"), rf"\p{{Is{s}}}").cast("bigint").alias(s.lower()) for s in SCRIPTS), count(F.col("text"), r"\p{L}").cast("bigint").alias("letters"))
    return d.where("letters > 0")


def _mixed(a: str, b: str, name: str) -> Column:
    x, y = count(F.col("text"), a), count(F.col("text"), b)
    return r6(F.when(x + y > 0, 100.0 * F.least(x, y) / (x + y)).otherwise(0.0)).alias(name)


# Pairs of spellings of one mark.
PAIRS = {"mixed_quotes": ('"', "[“”]"), "mixed_apostrophes": ("[A-Za-z]'[A-Za-z]", "[A-Za-z]’[A-Za-z]"), "mixed_dashes": ("—", "-{2,}"), "mixed_ellipses": ("…", r"\.{3,}")}


@query(
    "quality_typography",
    "SELECT doc_id, " + ", ".join("round(CASE WHEN {0} + {1} > 0 THEN 100.0 * least({0}, {1}) / ({0} + {1}) ELSE 0 END, 6) AS {2}".format(*("len(regexp_extract_all(text, '" + p.replace("'", "''") + "'))" for p in v), k) for k, v in PAIRS.items()) + " FROM documents WHERE text IS NOT NULL",
)
def quality_typography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the rarer of two spellings of a mark."""
    return docs(spark, sf_dir).where("text is not null").select("doc_id", *(_mixed(*v, k) for k, v in PAIRS.items()))


@query(
    "quality_lengths",
    "SELECT doc_id, n_chars, length(text) AS true_chars, CASE WHEN text IS NULL THEN 'no text' WHEN n_chars IS NULL THEN 'missing' WHEN n_chars <> length(text) THEN 'stale' ELSE 'right' END AS state FROM documents",
)
def quality_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded lengths against real ones."""
    state = F.when(F.col("text").isNull(), "no text").when(F.col("n_chars").isNull(), "missing").when(F.col("n_chars") != F.length("text"), "stale").otherwise("right")
    return docs(spark, sf_dir).select("doc_id", "n_chars", F.length("text").cast("bigint").alias("true_chars"), state.alias("state"))


@query(
    "quality_exact_copies",
    "WITH h AS (SELECT doc_id, md5(text) AS h FROM documents WHERE length(trim(text)) > 0) SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS copy_of FROM h QUALIFY count(*) OVER (PARTITION BY h) > 1",
)
def quality_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts delivered more than once, with the first document of each."""
    h = docs(spark, sf_dir).where("length(trim(text)) > 0").select("doc_id", F.md5("text").alias("h"))
    g = h.groupBy("h").agg(F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return h.join(g, "h").select("doc_id", "copy_of")
