"""Affect and word norms from a supplied lexicon: levels, shares, volatility, reversals, arcs, and what speech and speakers differ by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.functions import text as T
from proselake.operators.conversation import TURNS, clean_turns
from proselake.operators.named_sequences import lexicon_sequences
from proselake.operators.views import QUOTED_SQL, SENT, TOK, WORD_SQL, bodies, docs
from proselake.plans.registry import query, r6
from proselake.session import broadcast_if_small, table

#: A few words with a valence, for the queries over the tables; any table (token, valence) takes its place.
VALENCE = {"good": 1.0, "bright": 0.6, "fine": 0.5, "gentle": 0.7, "warm": 0.6, "quiet": 0.2, "happy": 1.0, "silver": 0.1, "old": -0.1, "dark": -0.5, "cold": -0.4, "broken": -0.7, "lost": -0.6, "rusty": -0.4, "stubborn": -0.3, "empty": -0.4, "sad": -0.9, "bad": -1.0, "afraid": -0.8, "nervous": -0.5}
_LEX = "lex(token, valence) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in VALENCE.items()) + ")"


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(VALENCE.items()), "token string, valence double")


def arc(sequence: DataFrame) -> DataFrame:
    """(doc_id, n, level, positive_share, negative_share, volatility, reversals, opening, middle, closing) of a sequence (doc_id, idx, value)."""
    by = Window.partitionBy("doc_id").orderBy("idx")
    s = sequence.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).withColumn("before", F.lag("value").over(by))
    third = lambda a, b: F.avg(F.when((F.col("idx") * 3 >= a * F.col("n")) & (F.col("idx") * 3 < b * F.col("n")), F.col("value")))
    share = lambda c: r6(100.0 * F.count(F.when(c, 1)) / F.count(F.lit(1)))
    return s.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("level"), share(F.col("value") > 0).alias("positive_share"), share(F.col("value") < 0).alias("negative_share"), r6(F.avg(F.abs(F.col("value") - F.col("before")))).alias("volatility"),
        F.count(F.when(F.col("value") * F.col("before") < 0, 1)).alias("reversals"), r6(third(0, 1)).alias("opening"), r6(third(1, 2)).alias("middle"), r6(third(2, 3)).alias("closing"),
    )


@query(
    "affect_arc",
    f"""WITH {SENT}, {_LEX}, w AS (SELECT doc_id, s, unnest(list_transform(regexp_extract_all(sentence, '{WORD_SQL}'), lambda x: replace(lower(x), '’', ''''))) AS token FROM sent), m AS (SELECT doc_id, s, avg(valence) AS v FROM w JOIN lex USING (token) GROUP BY ALL),
q AS (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, lag(v) OVER (PARTITION BY doc_id ORDER BY s) AS b FROM m)
SELECT doc_id, count(*) AS n, round(avg(v), 6) + 0.0 AS level, round(100.0 * count(*) FILTER (v > 0) / count(*), 6) AS positive_share, round(100.0 * count(*) FILTER (v < 0) / count(*), 6) AS negative_share, round(avg(abs(v - b)), 6) AS volatility, count(*) FILTER (v * b < 0) AS reversals,
round(avg(v) FILTER (i * 3 < n), 6) + 0.0 AS opening, round(avg(v) FILTER (i * 3 >= n AND i * 3 < 2 * n), 6) + 0.0 AS middle, round(avg(v) FILTER (i * 3 >= 2 * n), 6) + 0.0 AS closing FROM q GROUP BY doc_id""",
)
def affect_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level, balance, volatility and arc of the valence of sentences that hold words of the lexicon."""
    return arc(lexicon_sequences(docs(spark, sf_dir), lexicon(spark), "valence", "valence").select("doc_id", "idx", "value"))


def norm_levels(documents: DataFrame, norms: DataFrame, columns: list[str]) -> DataFrame:
    """(doc_id, norm, n, covered, level): mean of each norm (token and a column for each) over a document's words that it knows, and their share."""
    t = bodies(documents).select("doc_id", F.explode(T.tokens(F.col("body"))).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("k"))
    j = t.join(broadcast_if_small(norms.select("token", *columns)), "token", "left")
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("norm"), F.col(c).cast("double").alias("v")) for c in columns))).alias("r")
    x = j.select("doc_id", "k", rows).select("doc_id", "k", "r.norm", "r.v")
    known = F.sum(F.when(F.col("v").isNotNull(), F.col("k")).otherwise(0))
    return x.groupBy("doc_id", "norm").agg(F.sum("k").alias("n"), r6(100.0 * known / F.sum("k")).alias("covered"), r6(F.sum(F.col("k") * F.col("v")) / F.nullif(known, F.lit(0))).alias("level"))


@query(
    "affect_norms",
    f"WITH {TOK}, {_LEX} SELECT doc_id, count(*) AS n, round(100.0 * count(valence) / count(*), 6) AS covered, round(avg(valence), 6) + 0.0 AS level FROM tok LEFT JOIN lex USING (token) GROUP BY doc_id",
)
def affect_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and level of a lexicon over each document's words."""
    return norm_levels(docs(spark, sf_dir), lexicon(spark), ["valence"]).select("doc_id", "n", "covered", (F.col("level") + F.lit(0.0)).alias("level"))


@query(
    "affect_dialogue_gap",
    f"""WITH {SENT}, {_LEX}, t AS (SELECT doc_id, 'd' AS c, unnest(list_transform(regexp_extract_all(array_to_string(regexp_extract_all(body, '{QUOTED_SQL}'), chr(10)), '{WORD_SQL}'), lambda x: replace(lower(x), '’', ''''))) AS token FROM b UNION ALL SELECT doc_id, 'n', unnest(list_transform(regexp_extract_all(regexp_replace(body, '{QUOTED_SQL}', '', 'g'), '{WORD_SQL}'), lambda x: replace(lower(x), '’', ''''))) FROM b),
l AS (SELECT doc_id, avg(valence) FILTER (c = 'd') AS dialogue, avg(valence) FILTER (c = 'n') AS narration FROM t JOIN lex USING (token) GROUP BY doc_id) SELECT doc_id, round(dialogue, 6) + 0.0 AS dialogue, round(narration, 6) + 0.0 AS narration, round(dialogue - narration, 6) + 0.0 AS gap FROM l WHERE dialogue IS NOT NULL AND narration IS NOT NULL""",
)
def affect_dialogue_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valence of speech less that of narration, of documents with words of the lexicon in both."""
    b = bodies(docs(spark, sf_dir))
    spoken = T.tokens(F.array_join(F.regexp_extract_all("body", F.lit(T.QUOTED), F.lit(0)), "\n"))
    parts = F.explode(F.array(F.struct(F.lit("d").alias("c"), spoken.alias("t")), F.struct(F.lit("n").alias("c"), T.tokens(T.narration(F.col("body"))).alias("t")))).alias("p")
    w = b.select("doc_id", parts).select("doc_id", "p.c", F.explode("p.t").alias("token")).join(F.broadcast(lexicon(spark)), "token")
    level = lambda c: F.avg(F.when(F.col("c") == c, F.col("valence")))
    g = w.groupBy("doc_id").agg(level("d").alias("dialogue"), level("n").alias("narration")).where("dialogue is not null and narration is not null")
    return g.select("doc_id", r6("dialogue").alias("dialogue"), r6("narration").alias("narration"), r6(F.col("dialogue") - F.col("narration")).alias("gap"))


@query(
    "affect_speakers",
    f"""WITH {TURNS}, {_LEX}, w AS (SELECT doc_id, speaker, unnest(list_transform(regexp_extract_all(text, '{WORD_SQL}'), lambda x: replace(lower(x), '’', ''''))) AS token FROM t WHERE speaker IS NOT NULL AND text IS NOT NULL), l AS (SELECT doc_id, speaker, avg(valence) AS v FROM w JOIN lex USING (token) GROUP BY ALL)
SELECT doc_id, count(*) AS speakers, round(max(v) - min(v), 6) + 0.0 AS spread FROM l GROUP BY doc_id HAVING count(*) > 1""",
)
def affect_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far apart the speakers of a document are in valence."""
    t = clean_turns(table(spark, sf_dir, "turns")).where("speaker is not null and text is not null")
    l = t.select("doc_id", "speaker", F.explode(T.tokens(F.col("text"))).alias("token")).join(F.broadcast(lexicon(spark)), "token").groupBy("doc_id", "speaker").agg(F.avg("valence").alias("v"))  # noqa: E741
    return l.groupBy("doc_id").agg(F.count(F.lit(1)).alias("speakers"), r6(F.max("v") - F.min("v")).alias("spread")).where("speakers > 1")
