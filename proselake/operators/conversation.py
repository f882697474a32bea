"""Spoken turns: who speaks, who answers whom, how speakers differ and adapt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.functions import stats
from proselake.functions import text as T
from proselake.operators.style import FUNCTION_WORDS, lits, sql_list
from proselake.operators.views import WORD_SQL
from proselake.plans.registry import query, r6
from proselake.session import table

# Markers of politeness and classes of function words.
POLITENESS = {
    "gratitude": r"(?i)\b(thanks?|thank you|thankful|appreciate[ds]?)\b",
    "please": r"(?i)\bplease\b",
    "apology": r"(?i)\b(sorry|apologi[sz]e[ds]?|forgive me|my fault|my apologies)\b",
    "greeting": r"(?i)^\s*(hi|hello|hey|good morning|good evening|good afternoon)\b",
    "hedge": r"(?i)\b(i think|i guess|i suppose|perhaps|maybe|sort of|kind of|probably|it seems|i believe)\b",
    "indirect_request": r"(?i)\b(could you|would you|would you mind|might you)\b",
    "direct_question": r"(?i)^\s*(why|what|where|when|who|how|do|does|did|is|are|can|will)\b.*\?\s*$",
    "first_person_plural": r"(?i)\b(we|us|our|ours)\b",
    "second_person": r"(?i)\b(you|your|yours)\b",
}
CATEGORIES = {
    "articles": "a an the".split(),
    "conjunctions": "and but or nor if as so than".split(),
    "prepositions": "at by for from in of on to with".split(),
    "pronouns": "he her him his i it its me my our she their them they us we you your this that".split(),
    "auxiliary": "be been had has have is was were will".split(),
}


def clean_turns(turns: DataFrame) -> DataFrame:
    """(doc_id, turn_idx, speaker, text, label): one row for each turn (of repeated rows the smallest text; null speakers stay)."""
    row = F.struct("text", "speaker", "label")
    return turns.groupBy("doc_id", "turn_idx").agg(F.min(row).alias("r")).select("doc_id", "turn_idx", "r.speaker", "r.text", "r.label")


TURNS = "t AS (SELECT doc_id, turn_idx, speaker, text, label FROM turns QUALIFY row_number() OVER (PARTITION BY doc_id, turn_idx ORDER BY text NULLS FIRST, speaker NULLS FIRST, label NULLS FIRST) = 1)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_turns(table(spark, sf_dir, "turns"))


@query(
    "conversation_structure",
    rf"""WITH {TURNS}, l AS (SELECT *, lead(speaker) OVER w AS nxt, regexp_matches(text, '\?\s*$') AS q, row_number() OVER w AS k, lead(turn_idx) OVER w AS nt FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY turn_idx))
SELECT doc_id, count(*) AS turns, round(100.0 * count(speaker) / count(*), 6) AS attribution_coverage, count(DISTINCT speaker) AS speakers,
 round(CASE WHEN count(*) FILTER (speaker IS NOT NULL AND nxt IS NOT NULL) > 0 THEN 100.0 * count(*) FILTER (speaker <> nxt) / count(*) FILTER (speaker IS NOT NULL AND nxt IS NOT NULL) END, 6) AS alternation_rate,
 count(*) FILTER (q) AS questions, count(*) FILTER (q AND nt IS NOT NULL AND coalesce(speaker <> nxt, TRUE)) AS answered FROM l GROUP BY doc_id""",
)
def conversation_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of attribution, alternation of speakers, turns that end in a question and those of them that a turn of
    another speaker follows; an unknown speaker counts as another."""
    w = Window.partitionBy("doc_id").orderBy("turn_idx")
    l = _turns(spark, sf_dir).withColumn("nxt", F.lead("speaker").over(w)).withColumn("nt", F.lead("turn_idx").over(w)).withColumn("q", F.coalesce(F.col("text").rlike(r"\?\s*$"), F.lit(False)))  # noqa: E741
    both, other = F.col("speaker").isNotNull() & F.col("nxt").isNotNull(), F.col("speaker") != F.col("nxt")
    n = F.count(F.lit(1))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return l.groupBy("doc_id").agg(
        n.alias("turns"), r6(100.0 * F.count("speaker") / n).alias("attribution_coverage"), F.countDistinct("speaker").alias("speakers"), r6(F.when(one(both) > 0, 100.0 * one(other) / one(both))).alias("alternation_rate"), one(F.col("q")).alias("questions"), one(F.col("q") & F.col("nt").isNotNull() & F.coalesce(other, F.lit(True))).alias("answered")
    )


@query(
    "conversation_dominance",
    f"""WITH {TURNS}, s AS (SELECT doc_id, speaker, count(*) AS n FROM t WHERE speaker IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i FROM s)
SELECT doc_id, count(*) AS speakers, round(2.0 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1.0) / count(*) + 0.0, 6) AS gini, round(100.0 * max(n) / sum(n), 6) AS top_share FROM r GROUP BY doc_id""",
)
def conversation_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How unequally speakers share the turns."""
    s = _turns(spark, sf_dir).where("speaker is not null").groupBy("doc_id", "speaker").agg(F.count(F.lit(1)).alias("n"))
    g = stats.gini(s.withColumnRenamed("n", "turns"), ["doc_id"], "turns")
    top = s.groupBy("doc_id").agg(r6(100.0 * F.max("n") / F.sum("n")).alias("top_share"))
    return g.join(top, "doc_id").select("doc_id", F.col("n").alias("speakers"), r6("gini").alias("gini"), "top_share")


@query("conversation_politeness", f"WITH {TURNS} SELECT doc_id, " + ", ".join(f"round(100.0 * avg(CASE WHEN regexp_matches(text, '{p}') THEN 1 ELSE 0 END), 6) AS {k}" for k, p in POLITENESS.items()) + " FROM t WHERE text IS NOT NULL GROUP BY doc_id")
def conversation_politeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of turns with each marker of politeness."""
    t = _turns(spark, sf_dir).where("text is not null")
    return t.groupBy("doc_id").agg(*(r6(100.0 * F.avg(F.col("text").rlike(p).cast("int"))).alias(k) for k, p in POLITENESS.items()))


_TURN_WORDS = f"{TURNS}, tw AS (SELECT doc_id, turn_idx, speaker, label, text, list_transform(regexp_extract_all(text, '{WORD_SQL}'), lambda x: replace(lower(x), '’', '''')) AS ws FROM t WHERE text IS NOT NULL)"


@query(
    "conversation_turn_lengths",
    f"""WITH {_TURN_WORDS} SELECT doc_id, count(*) AS turns, round(quantile_cont(len(ws), 0.5), 6) AS words_median, round(avg(len(ws)), 6) AS words_mean, count(*) FILTER (len(ws) <= 4) AS upto4, count(*) FILTER (len(ws) BETWEEN 5 AND 10) AS upto10, count(*) FILTER (len(ws) > 10) AS longer FROM tw GROUP BY doc_id""",
)
def conversation_turn_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir).where("text is not null").select("doc_id", F.size(T.words(F.col("text"))).alias("n"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("turns"), r6(F.percentile("n", F.lit(0.5))).alias("words_median"), r6(F.avg("n")).alias("words_mean"), one(F.col("n") <= 4).alias("upto4"), one(F.col("n").between(5, 10)).alias("upto10"), one(F.col("n") > 10).alias("longer"))


@query(
    "conversation_coordination",
    f"""WITH {_TURN_WORDS}, l AS (SELECT doc_id, turn_idx, speaker, ws, lag(speaker) OVER w AS ps, lag(ws) OVER w AS pw FROM tw WINDOW w AS (PARTITION BY doc_id ORDER BY turn_idx)),
k AS (SELECT unnest([{', '.join(f"'{k}'" for k in CATEGORIES)}]) AS category, unnest([{', '.join('[' + ', '.join(f"'{w}'" for w in v) + ']' for v in CATEGORIES.values())}]) AS held),
m AS (SELECT doc_id, category, list_has_any(ws, held) AS used, list_has_any(pw, held) AS primed FROM l, k WHERE speaker <> ps)
SELECT doc_id, category, count(*) AS pairs, round(100.0 * (count(*) FILTER (used AND primed) / CAST(count(*) FILTER (primed) AS DOUBLE) - count(*) FILTER (used) / CAST(count(*) AS DOUBLE)), 6) + 0.0 AS coordination FROM m GROUP BY ALL HAVING count(*) FILTER (primed) > 0""",
)
def conversation_coordination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much likelier a speaker uses a class of function words after another speaker has."""
    w = Window.partitionBy("doc_id").orderBy("turn_idx")
    t = _turns(spark, sf_dir).where("text is not null").select("doc_id", "turn_idx", "speaker", T.tokens(F.col("text")).alias("ws"))
    l = t.withColumn("ps", F.lag("speaker").over(w)).withColumn("pw", F.lag("ws").over(w)).where("speaker <> ps")  # noqa: E741
    marks = F.array(*[F.struct(F.lit(k).alias("category"), F.arrays_overlap("ws", lits(v)).alias("used"), F.arrays_overlap("pw", lits(v)).alias("primed")) for k, v in CATEGORIES.items()])
    m = l.select("doc_id", F.inline(marks))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = m.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("pairs"), one(F.col("primed")).alias("p"), one(F.col("used") & F.col("primed")).alias("up"), one(F.col("used")).alias("u")).where("p > 0")
    return g.select("doc_id", "category", "pairs", r6(100.0 * (F.col("up") / F.col("p") - F.col("u") / F.col("pairs"))).alias("coordination"))


@query("conversation_adjacency", f"WITH {TURNS}, l AS (SELECT doc_id, speaker AS src, lead(speaker) OVER (PARTITION BY doc_id ORDER BY turn_idx) AS dst FROM t) SELECT doc_id, src, dst, count(*) AS weight FROM l WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst GROUP BY ALL")
def conversation_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of who speaks after whom."""
    return adjacency(_turns(spark, sf_dir))


def adjacency(turns: DataFrame) -> DataFrame:
    e = turns.select("doc_id", F.col("speaker").alias("src"), F.lead("speaker").over(Window.partitionBy("doc_id").orderBy("turn_idx")).alias("dst"))
    return e.where("src is not null and dst is not null and src <> dst").groupBy("doc_id", "src", "dst").agg(F.count(F.lit(1)).alias("weight"))


@query(
    "conversation_graph",
    f"""WITH {TURNS}, l AS (SELECT doc_id, speaker AS src, lead(speaker) OVER (PARTITION BY doc_id ORDER BY turn_idx) AS dst FROM t), e AS (SELECT DISTINCT doc_id, src, dst FROM l WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst),
n AS (SELECT doc_id, count(DISTINCT v) AS nodes FROM (SELECT doc_id, src AS v FROM e UNION ALL SELECT doc_id, dst FROM e) GROUP BY doc_id)
SELECT doc_id, nodes, count(*) AS edges, round(count(*) / (nodes * (nodes - 1.0)), 6) AS density, round(count(*) FILTER (EXISTS (SELECT 1 FROM e r WHERE r.doc_id = e.doc_id AND r.src = e.dst AND r.dst = e.src)) / CAST(count(*) AS DOUBLE), 6) AS reciprocity FROM e JOIN n USING (doc_id) GROUP BY doc_id, nodes""",
)
def conversation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, density and reciprocity of that graph."""
    e = adjacency(_turns(spark, sf_dir)).select("doc_id", "src", "dst")
    back = e.select("doc_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back"))
    x = e.join(back, ["doc_id", "src", "dst"], "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("edges"), F.count("back").alias("b"))
    n = e.select("doc_id", F.explode(F.array("src", "dst")).alias("v")).groupBy("doc_id").agg(F.countDistinct("v").alias("nodes"))
    return x.join(n, "doc_id").select("doc_id", "nodes", "edges", r6(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).alias("density"), r6(F.col("b") / F.col("edges")).alias("reciprocity"))


@query(
    "conversation_speaker_distance",
    f"""WITH {_TURN_WORDS}, s AS (SELECT doc_id, speaker, unnest(ws) AS token FROM tw WHERE speaker IS NOT NULL), n AS (SELECT doc_id, speaker, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 20),
v AS (SELECT s.doc_id, s.speaker, token, count(*) / any_value(n) AS r FROM s JOIN n USING (doc_id, speaker) WHERE token IN {sql_list(FUNCTION_WORDS)} GROUP BY ALL), q AS (SELECT doc_id, speaker, sqrt(sum(r * r)) AS norm FROM v GROUP BY ALL),
d AS (SELECT a.doc_id, a.speaker AS a, b.speaker AS b, sum(a.r * b.r) AS dot FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.token = b.token AND a.speaker < b.speaker GROUP BY ALL)
SELECT d.doc_id, d.a, d.b, round(1 - dot / (x.norm * y.norm), 6) + 0.0 AS distance FROM d JOIN q x ON x.doc_id = d.doc_id AND x.speaker = d.a JOIN q y ON y.doc_id = d.doc_id AND y.speaker = d.b""",
)
def conversation_speaker_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine distance of the function-word rates of two speakers of a document."""
    s = _turns(spark, sf_dir).where("text is not null and speaker is not null").select("doc_id", "speaker", F.explode(T.tokens(F.col("text"))).alias("token"))
    c = s.groupBy("doc_id", "speaker", "token").agg(F.count(F.lit(1)).alias("c")).withColumn("n", F.sum("c").over(Window.partitionBy("doc_id", "speaker"))).where("n >= 20")
    v = c.where(F.col("token").isin(FUNCTION_WORDS)).select("doc_id", "speaker", "token", (F.col("c") / F.col("n")).alias("r"))
    v = v.withColumn("norm", F.sqrt(F.sum(F.col("r") * F.col("r")).over(Window.partitionBy("doc_id", "speaker"))))
    a = v.select("doc_id", "token", F.col("speaker").alias("a"), F.col("r").alias("ra"), F.col("norm").alias("na"))
    b = v.select("doc_id", "token", F.col("speaker").alias("b"), F.col("r").alias("rb"), F.col("norm").alias("nb"))
    d = a.join(b, ["doc_id", "token"]).where("a < b").groupBy("doc_id", "a", "b", "na", "nb").agg(F.sum(F.col("ra") * F.col("rb")).alias("dot"))
    return d.select("doc_id", "a", "b", r6(1 - F.col("dot") / (F.col("na") * F.col("nb"))).alias("distance"))


@query("conversation_labels", f"WITH {TURNS} SELECT label, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY label")
def conversation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How turns are attributed."""
    return _turns(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(
    "conversation_voices",
    f"""WITH {_TURN_WORDS}, s AS (SELECT speaker, text, ws FROM tw WHERE speaker IS NOT NULL)
SELECT speaker, count(*) AS turns, round(avg(len(ws)), 6) AS words_per_turn, round(100.0 * avg(CASE WHEN text LIKE '%?%' THEN 1 ELSE 0 END), 6) AS questions, round(100.0 * avg(CASE WHEN len(ws) <= 3 THEN 1 ELSE 0 END), 6) AS short_share, round(100.0 * avg(CASE WHEN len(ws) > 15 THEN 1 ELSE 0 END), 6) AS long_share FROM s GROUP BY speaker""",
)
def conversation_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each speaker talks over all documents."""
    t = _turns(spark, sf_dir).where("text is not null and speaker is not null").select("speaker", "text", F.size(T.words(F.col("text"))).alias("n"))
    share = lambda c: r6(100.0 * F.avg(c.cast("int")))
    return t.groupBy("speaker").agg(F.count(F.lit(1)).alias("turns"), r6(F.avg("n")).alias("words_per_turn"), share(F.col("text").contains("?")).alias("questions"), share(F.col("n") <= 3).alias("short_share"), share(F.col("n") > 15).alias("long_share"))
