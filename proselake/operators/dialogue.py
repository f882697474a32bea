"""Speech in prose: turns put together from quotations, their tags, beats, runs, contractions and the speakers named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.functions import text as T
from proselake.operators.core_metrics import held
from proselake.operators.style import sql_list
from proselake.operators.views import BODY, QUOTED_SQL, SENT, WORD_SQL, bodies, docs, sentences
from proselake.plans.registry import query, r6

# Verbs of saying; those so plain that they don't count as elaborate; the verbs that the density of tags counts.
SPEECH_VERBS = (
    "said asked replied whispered shouted murmured cried called answered exclaimed muttered added continued interrupted snapped yelled laughed sighed gasped stated remarked noted observed "
    "questioned demanded announced admitted insisted protested suggested warned urged begged pleaded wondered mused retorted countered conceded chuckled grinned offered ventured breathed "
    "hissed growled barked drawled stammered stuttered repeated echoed agreed argued explained declared"
).split()
PLAIN_TAGS = ("said", "asked")
TAGS = [*PLAIN_TAGS, *"replied whispered shouted murmured cried called answered exclaimed".split()]
# Endings and whole words that are contractions.
CONTRACTED = r"(?:n't|'ll|'re|'ve|'d|'m)$|^(?:can't|won't|shan't|ain't|let's|o'clock|y'all|ma'am|'tis|'twas|'twill|g'day|d'you|d'ye)$"
# Capitalised words that are no names.
NO_NAMES = "He She They It I We You The A An And But So Then When As With At In On If That This There Here Who What Someone Somebody".split()
SPEECH = r"(?i)\b(" + "|".join(SPEECH_VERBS) + r")\b"
TAG = r"(?i)\b(" + "|".join(TAGS) + r")\b"
STOPS = "[.!?…]"
NAME = "[A-Z][A-Za-z'’-]*"


def spans(documents: DataFrame) -> DataFrame:
    """(doc_id, q, content, before, after): the quotations with the narration before each and after it, up to the next ones."""
    b = held(bodies(documents).select("doc_id", F.split("body", T.QUOTED, -1).alias("gaps"), T.quotations(F.col("body")).alias("qs")))
    return b.select("doc_id", "gaps", F.posexplode("qs").alias("q", "content")).select("doc_id", "q", "content", F.get("gaps", F.col("q")).alias("before"), F.get("gaps", F.col("q") + 1).alias("after"))


def tail(gap: Column) -> Column:
    """What of a gap lies behind its last blank line."""
    return F.element_at(F.split(gap, "\n\n"), -1)


def head(gap: Column) -> Column:
    """What of a gap lies before its first blank line."""
    return F.element_at(F.split(gap, "\n\n"), 1)


def turns(documents: DataFrame) -> DataFrame:
    """(doc_id, turn, text, internal, before, after): quotations joined while the narration between them closes no sentence;
    internal holds that narration. Turns without words are left out."""
    s = spans(documents)
    by = Window.partitionBy("doc_id").orderBy("q")
    s = s.withColumn("turn", F.sum(((F.col("q") > 0) & F.col("before").rlike(STOPS)).cast("int")).over(by))
    part = F.array_sort(F.collect_list(F.struct("q", "content", "before", "after"))).alias("p")  # the quotations of one turn
    t = s.groupBy("doc_id", "turn").agg(part)
    t = t.select("doc_id", "turn", F.array_join("p.content", " ").alias("text"), F.slice("p.before", 2, F.greatest(F.size("p") - 1, F.lit(0))).alias("internal"), F.get("p.before", F.lit(0)).alias("before"), F.element_at("p.after", -1).alias("after"))
    return t.where(F.col("text").rlike(T.LETTER))


SPANS_SQL = BODY + f""", sp AS (SELECT doc_id, string_split_regex(body, '{QUOTED_SQL}') AS gaps, list_transform(regexp_extract_all(body, '{QUOTED_SQL}'), lambda x: regexp_replace(x, '^[“"]|[”"]\\z', '', 'g')) AS qs FROM b),
spans AS (SELECT doc_id, q, qs[q + 1] AS content, gaps[q + 1] AS before, gaps[q + 2] AS after FROM (SELECT doc_id, gaps, qs, unnest(range(len(qs))) AS q FROM sp))"""
TURNS_SQL = SPANS_SQL + f""", numbered AS (SELECT *, sum(CASE WHEN q > 0 AND regexp_matches(before, '{STOPS}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY q) AS turn FROM spans),
turns0 AS (SELECT doc_id, turn, string_agg(content, ' ' ORDER BY q) AS text, list(before ORDER BY q)[2:] AS internal, arg_min(before, q) AS before, arg_max(after, q) AS after FROM numbered GROUP BY doc_id, turn),
tn AS (SELECT * FROM turns0 WHERE regexp_matches(text, '{T.LETTER}'))"""


@query("dialogue_turns", f"WITH {TURNS_SQL} SELECT doc_id, CAST(turn AS BIGINT) AS turn, text, len(regexp_extract_all(text, '{WORD_SQL}')) AS n_words FROM tn")
def dialogue_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken turns of each document."""
    return turns(docs(spark, sf_dir)).select("doc_id", F.col("turn").cast("bigint").alias("turn"), "text", F.size(T.words(F.col("text"))).cast("bigint").alias("n_words"))


@query(
    "dialogue_tags",
    rf"""WITH {SPANS_SQL}, g AS (SELECT doc_id, coalesce(nullif(lower(regexp_extract(string_split(before, chr(10) || chr(10))[-1], '{TAG}', 1)), ''), nullif(lower(regexp_extract(string_split(after, chr(10) || chr(10))[1], '{TAG}', 1)), '')) AS tag FROM spans)
SELECT doc_id, count(*) AS quotations, round(100.0 * count(tag) / count(*), 6) AS tag_density, CASE WHEN count(tag) > 0 THEN round(100.0 * count(*) FILTER (tag NOT IN {sql_list(list(PLAIN_TAGS))}) / count(tag), 6) END AS elaborate_rate FROM g GROUP BY doc_id""",
)
def dialogue_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of quotations with a verb of saying beside them in their paragraph, and of those not plain."""
    find = lambda c: F.nullif(F.lower(F.regexp_extract(c, TAG, 1)), F.lit(""))
    g = spans(docs(spark, sf_dir)).select("doc_id", F.coalesce(find(tail(F.col("before"))), find(head(F.col("after")))).alias("tag"))
    n, k = F.count(F.lit(1)), F.count("tag")
    return g.groupBy("doc_id").agg(n.alias("quotations"), r6(100.0 * k / n).alias("tag_density"), r6(F.when(k > 0, 100.0 * F.count(F.when(~F.col("tag").isin(*PLAIN_TAGS), 1)) / k)).alias("elaborate_rate"))


def labelled(turns: DataFrame) -> DataFrame:
    """turns + (label, verb, speaker): speech_tag where the narration inside, before or after (in this order, within the
    paragraph) has a verb of saying, action_beat where it has any words, else untagged. The speaker is the name beside the verb."""
    c = held(turns.withColumn("near", F.concat("internal", F.array(tail(F.col("before")), head(F.col("after"))))))
    hit = held(c.withColumn("hit", F.get(F.filter("near", lambda g: g.rlike(SPEECH)), F.lit(0))))
    pieces = hit.withColumn("verb", F.lower(F.regexp_extract("hit", SPEECH, 1))).withColumn("two", F.split("hit", SPEECH, 2))
    two = pieces.withColumn("a", F.regexp_extract(F.get("two", F.lit(0)), f"({NAME})\\s*,?\\s*$", 1)).withColumn("b", F.regexp_extract(F.get("two", F.lit(1)), f"^\\s*,?\\s*({NAME})", 1))
    name = lambda x: F.when((F.col(x) != "") & ~F.col(x).isin(NO_NAMES), F.col(x))
    words = F.exists("near", lambda g: g.rlike(T.LETTER))
    label = F.when(F.col("hit").isNotNull(), "speech_tag").when(words, "action_beat").otherwise("untagged")
    return two.withColumn("speaker", F.coalesce(name("a"), name("b"))).withColumn("label", label).drop("near", "hit", "two", "a", "b")


LABELLED_SQL = TURNS_SQL + rf""", near AS (SELECT *, list_concat(internal, [string_split(before, chr(10) || chr(10))[-1], string_split(after, chr(10) || chr(10))[1]]) AS near FROM tn),
hit AS (SELECT *, list_filter(near, lambda g: regexp_matches(g, '{SPEECH}'))[1] AS hit FROM near),
lab AS (SELECT doc_id, turn, text, nullif(lower(regexp_extract(hit, '{SPEECH}', 1)), '') AS verb, CASE WHEN hit IS NOT NULL THEN 'speech_tag' WHEN len(list_filter(near, lambda g: regexp_matches(g, '{T.LETTER}'))) > 0 THEN 'action_beat' ELSE 'untagged' END AS label FROM hit)"""


@query(
    "dialogue_attribution",
    f"""WITH {LABELLED_SQL} SELECT doc_id, count(*) AS turns, round(100.0 * count(*) FILTER (label = 'speech_tag') / count(*), 6) AS speech_tag_rate, round(100.0 * count(*) FILTER (label = 'action_beat') / count(*), 6) AS action_beat_rate, round(100.0 * count(*) FILTER (label = 'untagged') / count(*), 6) AS untagged_rate,
CASE WHEN count(verb) > 0 THEN round(100.0 * count(*) FILTER (verb NOT IN {sql_list(list(PLAIN_TAGS))}) / count(verb), 6) END AS elaborate_share FROM lab GROUP BY doc_id""",
)
def dialogue_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How turns are attributed: by a verb of saying, by an action beside them, or not at all."""
    t = labelled(turns(docs(spark, sf_dir))).withColumn("verb", F.nullif("verb", F.lit("")))
    n, k = F.count(F.lit(1)), F.count("verb")
    rate = lambda x: r6(100.0 * F.count(F.when(F.col("label") == x, 1)) / n)
    return t.groupBy("doc_id").agg(n.alias("turns"), rate("speech_tag").alias("speech_tag_rate"), rate("action_beat").alias("action_beat_rate"), rate("untagged").alias("untagged_rate"), r6(F.when(k > 0, 100.0 * F.count(F.when(~F.col("verb").isin(*PLAIN_TAGS), 1)) / k)).alias("elaborate_share"))


@query("dialogue_speakers")
def dialogue_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers named beside the verbs of saying, with their turns and words (the names need look-around, so without SQL)."""
    t = labelled(turns(docs(spark, sf_dir))).where("speaker is not null")
    return t.groupBy("doc_id", "speaker").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.size(T.words(F.col("text")))).alias("words"))


@query(
    "dialogue_runs",
    f"""WITH {TURNS_SQL}, l AS (SELECT doc_id, turn, CASE WHEN regexp_matches(before, '{T.LETTER}') OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM tn WINDOW w AS (PARTITION BY doc_id ORDER BY turn)),
i AS (SELECT doc_id, sum(new) OVER (PARTITION BY doc_id ORDER BY turn) AS run FROM l), r AS (SELECT doc_id, run, count(*) AS n FROM i GROUP BY ALL)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS turns, round(avg(n), 6) AS mean_run, max(n) AS longest_run, round(100.0 * coalesce(sum(n) FILTER (n >= 3), 0) / sum(n), 6) AS in_run_share FROM r GROUP BY doc_id""",
)
def dialogue_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of turns without a word of narration between them: mean, longest, and share of turns in runs of three or more."""
    by = Window.partitionBy("doc_id").orderBy("turn")
    t = turns(docs(spark, sf_dir)).select("doc_id", "turn", (F.col("before").rlike(T.LETTER) | (F.row_number().over(by) == 1)).cast("int").alias("new"))
    r = t.withColumn("run", F.sum("new").over(by)).groupBy("doc_id", "run").agg(F.count(F.lit(1)).alias("n"))
    return r.groupBy("doc_id").agg(F.sum("n").alias("turns"), r6(F.avg("n")).alias("mean_run"), F.max("n").alias("longest_run"), r6(100.0 * F.sum(F.when(F.col("n") >= 3, F.col("n")).otherwise(0)) / F.sum("n")).alias("in_run_share"))


_CON = CONTRACTED.replace("'", "''")


@query(
    "dialogue_contractions",
    f"""WITH {BODY}, d AS (SELECT doc_id, list_transform(regexp_extract_all(array_to_string(list_transform(regexp_extract_all(body, '{QUOTED_SQL}'), lambda x: regexp_replace(x, '^[“"]|[”"]\\z', '', 'g')), chr(10) || chr(10)), '{WORD_SQL}'), lambda x: replace(lower(x), '’', '''')) AS t FROM b)
SELECT doc_id, len(t) AS n_words, round(100.0 * len(list_filter(t, lambda x: regexp_matches(x, '{_CON}'))) / len(t), 6) AS contraction_rate, round(100.0 * len(list_filter(t, lambda x: x LIKE '%''s' AND NOT regexp_matches(x, '{_CON}'))) / len(t), 6) AS ambiguous_s_rate FROM d WHERE len(t) > 0""",
)
def dialogue_contractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contractions among the spoken words, and words in 's, which may be a contraction or a genitive."""
    d = held(bodies(docs(spark, sf_dir)).select("doc_id", T.tokens(T.dialogue(F.col("body"))).alias("t"))).where(F.size("t") > 0)
    n = F.size("t")
    count = lambda f: F.size(F.filter("t", f))
    return d.select("doc_id", n.cast("bigint").alias("n_words"), r6(100.0 * count(lambda x: x.rlike(CONTRACTED)) / n).alias("contraction_rate"), r6(100.0 * count(lambda x: x.endswith("'s") & ~x.rlike(CONTRACTED)) / n).alias("ambiguous_s_rate"))


_ANY = T.MARKS_ANY.replace("'", "''")


@query(
    "punctuation_patterns",
    f"""WITH {SENT}, k AS (SELECT doc_id, s, array_to_string(regexp_extract_all(sentence, '{_ANY}'), '') AS m FROM sent), c AS (SELECT doc_id, s, m, count(*) OVER (PARTITION BY doc_id, m) AS same, lag(m) OVER (PARTITION BY doc_id ORDER BY s) AS before, row_number() OVER (PARTITION BY doc_id ORDER BY s) - row_number() OVER (PARTITION BY doc_id, m ORDER BY s) AS isle FROM k),
r AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, m, isle, count(*) AS n FROM c GROUP BY ALL) GROUP BY doc_id),
p AS (SELECT doc_id, count(*) OVER (PARTITION BY doc_id, array_to_string(regexp_extract_all(paragraph, '{_ANY}'), '')) AS same FROM para), q AS (SELECT doc_id, round(100.0 * count(*) FILTER (same > 1) / count(*), 6) AS paragraph_share FROM p GROUP BY doc_id)
SELECT doc_id, count(*) AS sentences, round(100.0 * count(*) FILTER (same > 1) / count(*), 6) AS sentence_share, CASE WHEN count(*) > 1 THEN round(100.0 * count(*) FILTER (m = before) / (count(*) - 1), 6) END AS adjacent_rate, any_value(longest) AS longest_run, any_value(paragraph_share) AS paragraph_share FROM c JOIN r USING (doc_id) JOIN q USING (doc_id) GROUP BY doc_id""",
)
def punctuation_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of punctuation marks that come again: in sentences, in neighbours, in runs, in paragraphs."""
    d = docs(spark, sf_dir)
    by = Window.partitionBy("doc_id").orderBy("s")
    k = sentences(d).select("doc_id", "s", F.xxhash64(T.mark_skeleton(F.col("sentence"))).alias("m"))
    k = k.withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "m"))).withColumn("before", F.lag("m").over(by)).withColumn("isle", F.row_number().over(by) - F.row_number().over(Window.partitionBy("doc_id", "m").orderBy("s")))
    k = k.withColumn("run", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "m", "isle")))
    n = F.count(F.lit(1))
    s = k.groupBy("doc_id").agg(n.alias("sentences"), r6(100.0 * F.count(F.when(F.col("same") > 1, 1)) / n).alias("sentence_share"), r6(F.when(n > 1, 100.0 * F.count(F.when(F.col("m") == F.col("before"), 1)) / (n - 1))).alias("adjacent_rate"), F.max("run").alias("longest_run"))
    p = bodies(d).select("doc_id", F.explode(T.paragraphs(F.col("body"))).alias("p")).select("doc_id", F.xxhash64(T.mark_skeleton(F.col("p"))).alias("m"))
    p = p.groupBy("doc_id", "m").agg(n.alias("k")).groupBy("doc_id").agg(r6(100.0 * F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)) / F.sum("k")).alias("paragraph_share"))
    return s.join(p, "doc_id")


