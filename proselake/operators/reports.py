"""Project reports: absolutes, quotation lengths, register, numbers, banned phrases, styles of opening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.functions import ordered
from proselake.functions import text as T
from proselake.operators.core_metrics import arrays
from proselake.operators.style import ABSOLUTE
from proselake.operators.views import BODY, QUOTED_SQL, SENT, TOK, WORD_SQL, docs, quotations, sentences, split_sql
from proselake.plans.registry import query, r6

# Patterns of the reports.
ABSOLUTE_RE = r"(?i)\b(" + "|".join(ABSOLUTE) + r")\b"
EXCEPTION_RE = r"(?i)\b(except|unless|but|however|although|though|sometimes|usually)\b"
NUMBER_RE = r"\d[\d.,]*\d|\d"
BANNED = {"very_adverb": r"(?i)\bvery \w+ly\b", "suddenly": r"(?i)\bsuddenly\b", "it_was_that": r"(?i)\bit was [^.!?]{1,60} that\b", "began_to": r"(?i)\bbegan to\b", "double_dash": r"--"}


@query(
    "report_absolutes",
    f"""WITH {SENT}, f AS (SELECT doc_id, s, n_words, regexp_matches(sentence, '{ABSOLUTE_RE}') AS a, regexp_matches(sentence, '{EXCEPTION_RE}') AS e FROM sent),
x AS (SELECT *, max(CASE WHEN e THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS follows FROM f)
SELECT doc_id, count(*) FILTER (a) AS absolutes, round(1000.0 * count(*) FILTER (a) / sum(n_words), 6) AS per_1000_words, round(100.0 * count(*) FILTER (a) / count(*), 6) AS share, count(*) FILTER (a AND follows = 1) AS excepted FROM x GROUP BY doc_id""",
)
def report_absolutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute statements, and those that one of the next three sentences takes back."""
    s = sentences(docs(spark, sf_dir)).select("doc_id", "s", "n_words", F.col("sentence").rlike(ABSOLUTE_RE).alias("a"), F.col("sentence").rlike(EXCEPTION_RE).cast("int").alias("e"))
    x = s.withColumn("follows", F.max("e").over(Window.partitionBy("doc_id").orderBy("s").rowsBetween(1, 3)))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return x.groupBy("doc_id").agg(one(F.col("a")).alias("absolutes"), r6(1000.0 * one(F.col("a")) / F.sum("n_words")).alias("per_1000_words"), r6(100.0 * one(F.col("a")) / F.count(F.lit(1))).alias("share"), one(F.col("a") & (F.col("follows") == 1)).alias("excepted"))


@query(
    "report_quotations",
    f"""WITH {BODY}, q AS (SELECT doc_id, unnest(regexp_extract_all(body, '{QUOTED_SQL}')) AS q FROM b), c AS (SELECT doc_id, regexp_replace(q, '^[“"]|[”"]\\z', '', 'g') AS c FROM q), n AS (SELECT doc_id, len(regexp_extract_all(c, '{WORD_SQL}')) AS w FROM c)
SELECT doc_id, count(*) AS quotations, round(avg(w), 6) AS words_mean, round(quantile_cont(w, 0.5), 6) AS words_median, round(100.0 * avg(CASE WHEN w <= 4 THEN 1 ELSE 0 END), 6) AS upto4_share, round(100.0 * avg(CASE WHEN w >= 30 THEN 1 ELSE 0 END), 6) AS from30_share FROM n GROUP BY doc_id""",
)
def report_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of quotations."""
    n = quotations(docs(spark, sf_dir)).select("doc_id", F.size(T.words(F.col("content"))).alias("w"))
    share = lambda c: r6(100.0 * F.avg(c.cast("int")))
    return n.groupBy("doc_id").agg(F.count(F.lit(1)).alias("quotations"), r6(F.avg("w")).alias("words_mean"), r6(F.percentile("w", F.lit(0.5))).alias("words_median"), share(F.col("w") <= 4).alias("upto4_share"), share(F.col("w") >= 30).alias("from30_share"))


@query(
    "report_register",
    f"""WITH {TOK}, r AS (SELECT doc_id, source, 100.0 * avg(CASE WHEN length(word) >= 9 THEN 1 ELSE 0 END) AS r FROM tok WHERE source IS NOT NULL GROUP BY ALL), m AS (SELECT source, quantile_cont(r, 0.5) AS m FROM r GROUP BY source)
SELECT doc_id, r.source, round(r, 6) AS long_share, round(r - m, 6) + 0.0 AS above_median FROM r JOIN m ON m.source = r.source""",
)
def report_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of words of nine letters or more, against the median of the source."""
    a = arrays(docs(spark, sf_dir).where("source is not null"), "source", want="ws").select("doc_id", "source", "ws").where(F.size("ws") > 0)
    r = a.select("doc_id", "source", (100.0 * F.size(F.filter("ws", lambda w: F.length(w) >= 9)) / F.size("ws")).alias("r"))
    m = ordered.quantiles(r.select("source", "r"), ["source"], "r", (0.5,)).select("source", F.col("q")[0].alias("m"))
    return r.join(m, "source").select("doc_id", "source", r6("r").alias("long_share"), r6(F.col("r") - F.col("m")).alias("above_median"))


@query(
    "report_numbers",
    f"""WITH {TOK}, n AS (SELECT doc_id, unnest(regexp_extract_all(body, '{NUMBER_RE}')) AS x FROM b), c AS (SELECT doc_id, x, count(*) AS c FROM n GROUP BY ALL), w AS (SELECT doc_id, count(*) AS w FROM tok GROUP BY doc_id)
SELECT doc_id, CAST(sum(c) AS BIGINT) AS numbers, count(*) AS kinds, round(1000.0 * sum(c) / any_value(w), 6) AS per_1000_words, round(100.0 * max(c) / sum(c), 6) AS top_share FROM c JOIN w USING (doc_id) GROUP BY doc_id""",
)
def report_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in figures, and how they concentrate on the commonest."""
    a = arrays(docs(spark, sf_dir), want="ws").select("doc_id", F.size("ws").alias("w"), F.explode(F.regexp_extract_all("body", F.lit(NUMBER_RE), F.lit(0))).alias("x")).where("w > 0")
    c = a.groupBy("doc_id", "w", "x").agg(F.count(F.lit(1)).alias("c"))
    g = c.groupBy("doc_id", "w").agg(F.sum("c").alias("numbers"), F.count(F.lit(1)).alias("kinds"), F.max("c").alias("top"))
    return g.select("doc_id", "numbers", "kinds", r6(1000.0 * F.col("numbers") / F.col("w")).alias("per_1000_words"), r6(100.0 * F.col("top") / F.col("numbers")).alias("top_share"))


@query("report_banned", f"WITH {BODY} SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(body, '{p}')) AS {k}" for k, p in BANNED.items()) + " FROM b")
def report_banned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of configured patterns."""
    a = arrays(docs(spark, sf_dir), want="").select("doc_id", "body")
    return a.select("doc_id", *(F.size(F.regexp_extract_all("body", F.lit(p), F.lit(0))).cast("bigint").alias(k) for k, p in BANNED.items()))


@query(
    "report_source_dialogue",
    f"""WITH {BODY}, q AS (SELECT doc_id, source, len(regexp_extract_all(body, '{WORD_SQL}')) AS w, len(regexp_extract_all(array_to_string(regexp_extract_all(body, '{QUOTED_SQL}'), chr(10)), '{WORD_SQL}')) AS d FROM b WHERE source IS NOT NULL)
SELECT source, count(*) AS docs, CAST(sum(w) AS BIGINT) AS words, round(100.0 * sum(d) / sum(w), 6) AS dialogue_share FROM q GROUP BY source HAVING sum(w) > 0""",
)
def report_source_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken share of each source."""
    a = arrays(docs(spark, sf_dir).where("source is not null"), "source", want="ws")
    q = a.select("source", F.size("ws").alias("w"), F.size(T.words(F.array_join(F.regexp_extract_all("body", F.lit(T.QUOTED), F.lit(0)), "\n"))).alias("d"))
    return q.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("w").alias("words"), r6(100.0 * F.sum("d") / F.sum("w")).alias("dialogue_share")).where("words > 0")


NAME_RE = r"[a-z,;:][\"'’”]? ([A-Z][a-z']+(?: [A-Z][a-z']+){0,2})"


@query(
    "graph_name_cooccurrence",
    f"""WITH {SENT}, n AS (SELECT DISTINCT doc_id, s, unnest(regexp_extract_all(sentence, '{NAME_RE.replace("'", "''")}', 1)) AS name FROM sent)
SELECT a.doc_id, a.name AS src, b.name AS dst, count(*) AS weight FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.s = b.s AND a.name < b.name GROUP BY ALL""",
)
def graph_name_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that stand in one sentence: the edges of each document's graph, made within the row of a sentence."""
    n = sentences(docs(spark, sf_dir)).select("doc_id", F.array_sort(F.array_distinct(F.regexp_extract_all("sentence", F.lit(NAME_RE), F.lit(1)))).alias("ns")).where(F.size("ns") > 1)
    pairs = F.flatten(F.transform("ns", lambda a, i: F.transform(F.slice("ns", i + 2, F.size("ns")), lambda b: F.struct(a.alias("src"), b.alias("dst")))))
    return n.select("doc_id", F.inline(pairs)).groupBy("doc_id", "src", "dst").agg(F.count(F.lit(1)).alias("weight"))


@query(
    "graph_name_degrees",
    f"""WITH {SENT}, n AS (SELECT DISTINCT doc_id, s, unnest(regexp_extract_all(sentence, '{NAME_RE.replace("'", "''")}', 1)) AS name FROM sent), e AS (SELECT DISTINCT a.doc_id, a.name AS src, b.name AS dst FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.s = b.s AND a.name <> b.name),
d AS (SELECT doc_id, src, count(*) AS k FROM e GROUP BY ALL)
SELECT doc_id, count(*) AS nodes, CAST(sum(k) / 2 AS BIGINT) AS edges, max(k) AS max_degree, round(sum(k) / (count(*) * (count(*) - 1.0)), 6) AS density FROM d GROUP BY doc_id""",
)
def graph_name_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, density and largest degree of that graph."""
    e = graph_name_cooccurrence(spark, sf_dir)
    d = e.select("doc_id", F.explode(F.array("src", "dst")).alias("v")).groupBy("doc_id", "v").agg(F.count(F.lit(1)).alias("k"))
    n = F.count(F.lit(1))
    return d.groupBy("doc_id").agg(n.alias("nodes"), (F.sum("k") / 2).cast("bigint").alias("edges"), F.max("k").alias("max_degree"), r6(F.sum("k") / (n * (n - 1))).alias("density"))
