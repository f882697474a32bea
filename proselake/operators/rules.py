"""Rules of a project: patterns with flags, forbidden marks and quote styles; citations that must be found; checks of settings;
plain names of metrics; and the reports that count configured patterns."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.functions import text as T
from proselake.operators.core_metrics import arrays
from proselake.operators.views import SENT, TOK, WORD_SQL, bodies, docs, quotations, sentences
from proselake.plans.registry import query, r6
from proselake.session import table

FLAGS = {"i": re.I, "m": re.M, "s": re.S, "x": re.X}
#: The rules of the queries below: name, pattern, flags.
RULES = [
    ("em_dash", "—|--", ""), ("straight_quotes", '"', ""), ("very_adverb", r"\bvery \w+ly\b", "i"), ("double_space", r"[.!?] {2,}\S", ""), ("began_to", r"\bbegan to\b", "i"), ("repeated_word", r"\b(?:the the|and and|of of|to to|a a)\b", "i"),
]
TICS = [("suddenly", r"\bsuddenly\b"), ("seemed", r"\bseem(?:s|ed)?\b"), ("nodded", r"\bnodded\b"), ("smiled", r"\bsmil(?:e|es|ed)\b"), ("sighed", r"\bsigh(?:s|ed)?\b")]


def compiled(rules: list[tuple[str, str, str]]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(name, pattern with its flags) of the valid rules, and (name, error) of the others, which stay visible."""
    good, bad = [], []
    for name, pattern, flags in rules:
        unknown = sorted(set(flags) - set(FLAGS))
        try:
            if unknown:
                raise re.error(f"unknown flags {''.join(unknown)}")
            re.compile(pattern, sum((FLAGS[f] for f in flags), re.RegexFlag(0)))
        except re.error as e:
            bad.append((name, str(e)))
        else:
            good.append((name, f"(?{flags}){pattern}" if flags else pattern))
    return good, bad


def violations(documents: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(doc_id, rule, hits, first, error): the hits of each rule in the canonical text and the first of them; a rule that doesn't
    compile comes once, with a null document and its error."""
    good, bad = compiled(rules)
    spark, b = documents.sparkSession, bodies(documents)
    per = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.regexp_extract_all("body", F.lit(p), F.lit(0)).alias("h")) for n, p in good))).alias("r") if good else None
    errors = spark.createDataFrame([(None, n, None, None, e) for n, e in bad], "doc_id bigint, rule string, hits bigint, first string, error string")
    if per is None:
        return errors
    hits = b.select("doc_id", per).where(F.size("r.h") > 0).select("doc_id", "r.rule", F.size("r.h").cast("bigint").alias("hits"), F.get("r.h", F.lit(0)).alias("first"), F.lit(None).cast("string").alias("error"))
    return hits.unionByName(errors)


def _sql(p: str) -> str:
    return p.replace("'", "''")


@query(
    "rule_violations",
    f"WITH {TOK}, h AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, regexp_extract_all(body, '{_sql(p)}') AS h FROM b" for n, p in compiled(RULES)[0]) + ") SELECT doc_id, rule, len(h) AS hits, h[1] AS first FROM h WHERE len(h) > 0",
)
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the project's rules."""
    return violations(docs(spark, sf_dir), RULES).select("doc_id", "rule", "hits", "first")


@query(
    "report_tics",
    f"WITH {TOK}, n AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id), h AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS tic, len(regexp_extract_all(body, '(?i){_sql(p)}')) AS hits FROM b" for n, p in TICS)
    + ") , t AS (SELECT tic, 100000.0 * sum(hits) / sum(n) AS usual FROM h JOIN n USING (doc_id) GROUP BY tic) SELECT doc_id, tic, hits, round(100000.0 * hits / n, 6) AS per_100k, round(100000.0 * hits / n - usual, 6) + 0.0 AS above FROM h JOIN n USING (doc_id) JOIN t USING (tic) WHERE hits > 0",
)
def report_tics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured habits per hundred thousand words, against the corpus."""
    a = arrays(docs(spark, sf_dir), want="ws").select("doc_id", "body", F.size("ws").alias("n")).where("n > 0")
    per = F.explode(F.array(*(F.struct(F.lit(n).alias("tic"), F.regexp_count("body", F.lit(f"(?i){p}")).alias("hits")) for n, p in TICS))).alias("r")
    h = a.select("doc_id", "n", per).select("doc_id", "n", "r.tic", F.col("r.hits").cast("bigint").alias("hits"))
    usual = h.groupBy("tic").agg((100000.0 * F.sum("hits") / F.sum("n")).alias("usual"))  # one row a tic
    rate = 100000.0 * F.col("hits") / F.col("n")
    return h.where("hits > 0").join(F.broadcast(usual), "tic").select("doc_id", "tic", "hits", r6(rate).alias("per_100k"), r6(rate - F.col("usual")).alias("above"))


# Subjects and copulas of general statements, and signs that a sentence is about someone in particular.
MAXIM = r"(?i)^\W*(?:everyone|everybody|nobody|no one|people|men|women|one|we all|all of us|life|love|time|truth|a man|a woman|those who|he who|the [a-z]+)\b[^.!?]*\b(?:is|are|has|have|never|always|must|can)\b"
PARTICULAR = r"\b(?:was|were|had|did|I|me|my|you|your|him|her)\b|[a-z,;] [A-Z][a-z]+"


def maxim(s: Column) -> Column:
    """Whether a sentence reads as a general statement in the present."""
    return s.rlike(MAXIM) & ~s.rlike(PARTICULAR)


@query(
    "report_quotable",
    f"""WITH {TOK}, q AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(body, '{T.QUOTED.replace("'", "''")}'), lambda x: regexp_replace(x, '^[“"]|[”"]\\z', '', 'g'))) AS c FROM b), l AS (SELECT doc_id, regexp_extract(trim(c), '[^.!?…]*[.!?…]*$') AS last FROM q WHERE regexp_matches(c, '{T.LETTER}'))
SELECT doc_id, count(*) AS speeches, count(*) FILTER (regexp_matches(last, '{_sql(MAXIM)}') AND NOT regexp_matches(last, '{_sql(PARTICULAR)}')) AS maxims FROM l GROUP BY doc_id""",
)
def report_quotable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speeches whose last sentence is a maxim."""
    q = quotations(docs(spark, sf_dir)).where(F.col("content").rlike(T.LETTER)).select("doc_id", F.regexp_extract(F.trim("content"), "[^.!?…]*[.!?…]*$", 0).alias("last"))
    return q.groupBy("doc_id").agg(F.count(F.lit(1)).alias("speeches"), F.count(F.when(maxim(F.col("last")), 1)).alias("maxims"))


@query(
    "report_style",
    f"""WITH {SENT}, s AS (SELECT doc_id, count(*) AS sentences, {', '.join(f'round(100.0 * count(*) FILTER (n_words BETWEEN {lo} AND {hi}) / count(*), 6) AS words_{lo}_{hi}' for lo, hi in ((0, 5), (6, 15), (16, 30)))}, round(100.0 * count(*) FILTER (n_words > 30) / count(*), 6) AS words_over_30,
round(100.0 * count(*) FILTER (regexp_matches(sentence, '(?i)^\\W*(?:and|but|or|so|yet)\\b')) / count(*), 6) AS conjunction_openings FROM sent GROUP BY doc_id)
SELECT *, words_over_30 <= 10 AND words_0_5 <= 40 AS passed FROM s""",
)
def report_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of short and long sentences and of those that open with a conjunction, with a verdict on the first two."""
    s = sentences(docs(spark, sf_dir))
    share = lambda c: r6(100.0 * F.count(F.when(c, 1)) / F.count(F.lit(1)))
    n = F.col("n_words")
    g = s.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sentences"), *(share(n.between(lo, hi)).alias(f"words_{lo}_{hi}") for lo, hi in ((0, 5), (6, 15), (16, 30))), share(n > 30).alias("words_over_30"), share(F.col("sentence").rlike(r"(?i)^\W*(?:and|but|or|so|yet)\b")).alias("conjunction_openings")
    )
    return g.withColumn("passed", (F.col("words_over_30") <= 10) & (F.col("words_0_5") <= 40))


def comparable(text: Column) -> Column:
    """A text as citations are compared: its words in lower case, one space apart."""
    return F.array_join(T.tokens(text), " ")


def missing_citations(citations: DataFrame, documents: DataFrame, words: int = 8) -> DataFrame:
    """(cite_id, quote) of the citations (cite_id, doc_id, quote) that don't stand in the document they cite, word for word.

    A citation is looked up in its own document only; one without a document in any, through a run of its first words, so that
    citations aren't compared with every text.
    """
    d = documents.select("doc_id", comparable(T.body(F.coalesce("text", F.lit("")))).alias("t"))
    c = citations.select("cite_id", "doc_id", "quote", comparable(F.col("quote")).alias("c"))
    placed = c.where("doc_id is not null").join(d, "doc_id").where(F.expr("contains(concat(' ', t, ' '), concat(' ', c, ' '))")).select("cite_id")
    loose = c.where("doc_id is null").withColumn("n", F.least(F.lit(words), F.size(F.split("c", " "))))
    sizes = loose.select("n").distinct()
    grams = d.withColumn("ws", F.split("t", " ")).crossJoin(F.broadcast(sizes)).where(F.size("ws") >= F.col("n"))  # at most `words` sizes
    grams = grams.select("doc_id", "t", "n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("ws") - F.col("n") + 1), lambda i: F.xxhash64(F.array_join(F.slice("ws", i, F.col("n")), " "))))).alias("h"))
    loose = loose.withColumn("h", F.xxhash64(F.array_join(F.slice(F.split("c", " "), F.lit(1), F.col("n")), " ")))
    found = loose.join(grams, ["n", "h"]).where(F.expr("contains(concat(' ', t, ' '), concat(' ', c, ' '))")).select("cite_id")
    return c.select("cite_id", "quote").join(placed.unionByName(found).distinct(), "cite_id", "left_anti")


@query(
    "report_citations",
    f"""WITH {TOK}, w AS (SELECT doc_id, array_to_string(list_transform(ws, lambda x: replace(lower(x), '’', '''')), ' ') AS t FROM wl), c AS (SELECT doc_id AS cite_id, doc_id, text FROM turns WHERE text IS NOT NULL),
k AS (SELECT DISTINCT doc_id, array_to_string(list_transform(regexp_extract_all(text, '{WORD_SQL}'), lambda x: replace(lower(x), '’', '''')), ' ') AS c FROM c)
SELECT k.doc_id, count(*) AS quotes, count(*) FILTER (NOT coalesce(contains(' ' || t || ' ', ' ' || c || ' '), FALSE)) AS missing FROM k LEFT JOIN w USING (doc_id) GROUP BY k.doc_id""",
)
def report_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken turns taken as quotations of their documents: how many don't stand there."""
    t = table(spark, sf_dir, "turns").where("text is not null").select("doc_id", comparable(F.col("text")).alias("quote")).distinct()
    c = t.withColumn("cite_id", F.xxhash64("doc_id", "quote"))
    gone = missing_citations(c, docs(spark, sf_dir)).select("cite_id", F.lit(True).alias("gone"))
    return c.join(gone, "cite_id", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("quotes"), F.count("gone").alias("missing"))


def edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, words_before, words_after, change, broken): how an edited text differs in words, and which forms it breaks: unpaired
    double quotes, spaces at the end of lines, tabs, runs of blank lines."""
    n = lambda d, c: d.select("doc_id", F.size(T.words(F.coalesce("text", F.lit("")))).cast("bigint").alias(c))
    text = F.coalesce("text", F.lit(""))
    marks = {"unpaired_quotes": (F.regexp_count(text, F.lit("“")) != F.regexp_count(text, F.lit("”"))) | (F.regexp_count(text, F.lit('"')) % 2 == 1), "trailing_spaces": text.rlike(r"[ \t](?:\n|\z)"), "tabs": text.contains("\t"), "blank_lines": text.rlike("\n[ \t]*\n[ \t]*\n")}
    broken = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in marks.items()))).alias("broken")
    j = n(before, "words_before").join(n(after, "words_after"), "doc_id", "full").join(after.select("doc_id", broken), "doc_id", "left")
    return j.select("doc_id", "words_before", "words_after", (F.coalesce("words_after", F.lit(0)) - F.coalesce("words_before", F.lit(0))).alias("change"), "broken")


@query(
    "report_edits",
    f"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT *, len(regexp_extract_all(t, '{WORD_SQL}')) AS w, length(t) - length(replace(t, '“', '')) <> length(t) - length(replace(t, '”', '')) OR (length(t) - length(replace(t, '"', ''))) % 2 = 1 AS u, regexp_matches(t, '[ \\t](?:\\n|\\z)') AS s, contains(t, chr(9)) AS tb, regexp_matches(t, '\\n[ \\t]*\\n[ \\t]*\\n') AS bl FROM a)
SELECT doc_id, w AS n_words, concat_ws(',', CASE WHEN u THEN 'unpaired_quotes' END, CASE WHEN s THEN 'trailing_spaces' END, CASE WHEN tb THEN 'tabs' END, CASE WHEN bl THEN 'blank_lines' END) AS broken FROM n""",
)
def report_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms that each text breaks."""
    d = docs(spark, sf_dir)
    return edits(d, d).select("doc_id", F.col("words_after").alias("n_words"), F.array_join("broken", ",").alias("broken"))


def config_findings(config: dict, known: set[str], prefix: str = "config") -> list[tuple[str, str | None]]:
    """(config.<key>, the likeliest known key) of every unknown key, also of nested settings."""
    out: list[tuple[str, str | None]] = []
    for k, v in config.items():
        name = f"{prefix}.{k}"
        if name.removeprefix("config.") not in known:
            near = difflib.get_close_matches(name.removeprefix("config."), sorted(known), 1)
            out.append((name, near[0] if near else None))
        elif isinstance(v, dict):
            out += config_findings(v, known, name)
    return out


def plain_names(findings: DataFrame, names: DataFrame) -> DataFrame:
    """findings + plain_name: the description of the longest beginning of metric_id that names (prefix, plain_name) has; null without one."""
    parts = F.split("metric_id", r"\.")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    ids = findings.select("metric_id").distinct().select("metric_id", F.posexplode(begins).alias("k", "prefix"))
    best = ids.join(names, "prefix").groupBy("metric_id").agg(F.max_by("plain_name", "k").alias("plain_name"))
    return findings.join(best, "metric_id", "left")
