"""Catalogue entries: canonical keys, duplicates, selection with caps, narrator and tense of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.functions import text as T
from proselake.operators.core_metrics import arrays
from proselake.operators.style import count_words, sql_list
from proselake.operators.views import BODY, QUOTED_SQL, WORD_SQL, docs
from proselake.plans.registry import query, r6
from proselake.session import table

# Identifiers in order of trust; pronouns and verb forms of the classifiers.
IDENTIFIERS = ["isbn_13", "isbn_10", "lccn", "oclc"]
FIRST = "i me my mine myself we us our ours ourselves".split()
THIRD = "he him his himself she her hers herself they them their theirs themselves".split()
PAST = "was were had did said went came saw thought knew looked seemed felt took made got gave found told asked turned stood sat ran left".split()
PRESENT = "is are has does says goes comes sees thinks knows looks seems feels takes makes gets gives finds tells asks turns stands sits runs leaves".split()


def canonical(title: Column) -> Column:
    """Letters and digits in lower case, others as single spaces."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))


def dedupe_key() -> Column:
    """The first identifier there is, else canonical title and first author's family name."""
    first = F.get(F.col("authors"), 0)
    by_title = F.concat(F.lit("title:"), canonical(F.coalesce("title", F.lit(""))), F.lit("|author:"), canonical(F.split(F.coalesce(first, F.lit("")), ",")[0]))
    known = [F.when(F.length(F.try_element_at("identifiers", F.lit(i))) > 0, F.concat(F.lit(f"{i}:"), F.try_element_at("identifiers", F.lit(i)))) for i in IDENTIFIERS]
    return F.coalesce(*known, by_title)


_CANON = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_KEY = (
    "coalesce("
    + ", ".join(f"CASE WHEN length(identifiers['{i}']) > 0 THEN '{i}:' || identifiers['{i}'] END" for i in IDENTIFIERS)
    + ", 'title:' || " + _CANON.format("coalesce(title, '')") + " || '|author:' || " + _CANON.format("string_split(coalesce(authors[1], ''), ',')[1]") + ")"
)
_BEST = f"""e AS (SELECT *, {_KEY} AS key FROM candidates), best AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC NULLS LAST, seen_at DESC NULLS LAST, provider DESC NULLS LAST, provider_id DESC NULLS LAST, title DESC NULLS LAST) = 1)"""


def distinct_candidates(candidates: DataFrame) -> DataFrame:
    """Of entries with one key the best: highest score, seen last."""
    e = candidates.withColumn("key", dedupe_key())
    order = F.struct("score", "seen_at", "provider", "provider_id", "title")
    row = F.struct(*[c for c in candidates.columns if c != "identifiers"])
    return e.groupBy("key").agg(F.max_by(row, order).alias("r"), F.count(F.lit(1)).alias("copies")).select("key", "copies", "r.*")


@query("catalogue_keys", f"SELECT provider, provider_id, title, {_KEY} AS key FROM candidates")
def catalogue_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of each entry."""
    return table(spark, sf_dir, "candidates").select("provider", "provider_id", "title", dedupe_key().alias("key"))


@query("catalogue_distinct", f"WITH {_BEST}, n AS (SELECT key, count(*) AS copies FROM e GROUP BY key) SELECT key, copies, provider, provider_id, score, publication_year FROM best JOIN n USING (key)")
def catalogue_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries without duplicates."""
    return distinct_candidates(table(spark, sf_dir, "candidates")).select("key", "copies", "provider", "provider_id", "score", "publication_year")


@query(
    "catalogue_selected",
    f"""WITH {_BEST}, a AS (SELECT *, {_CANON.format("coalesce(authors[1], 'unknown')")} AS author FROM best WHERE publication_year BETWEEN 1750 AND 1950 AND work_type IS NOT NULL)
SELECT key, author, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY score DESC, key) AS rank FROM a) WHERE rank <= 2""",
)
def catalogue_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a span of years and a known type, at most the two best of each author (the cap is the feature)."""
    e = distinct_candidates(table(spark, sf_dir, "candidates")).where(F.col("publication_year").between(1750, 1950) & F.col("work_type").isNotNull())
    e = e.withColumn("author", canonical(F.coalesce(F.get(F.col("authors"), 0), F.lit("unknown"))))
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("author").orderBy(F.desc("score"), "key"))).where("rank <= 2").select("key", "author", "score", "rank")


@query("catalogue_subjects", "SELECT s AS subject, count(*) AS n FROM (SELECT DISTINCT provider, provider_id, unnest(subjects) AS s FROM candidates) GROUP BY s")
def catalogue_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by subject."""
    return table(spark, sf_dir, "candidates").select("provider", "provider_id", F.explode("subjects").alias("subject")).distinct().groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


@query("catalogue_of_documents", f"WITH {_BEST}, p AS (SELECT provider, provider_id, max(score) AS score, count(*) AS entries FROM candidates GROUP BY ALL) SELECT doc_id, d.provider, d.provider_id, score, entries FROM documents d LEFT JOIN p ON p.provider = d.provider AND p.provider_id = d.provider_id")
def catalogue_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its entry, where one is known."""
    p = table(spark, sf_dir, "candidates").groupBy("provider", "provider_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("entries"))
    return docs(spark, sf_dir).select("doc_id", "provider", "provider_id").join(p, ["provider", "provider_id"], "left").select("doc_id", "provider", "provider_id", "score", "entries")


_COUNTS = f"""WITH {BODY}, q AS (SELECT doc_id, regexp_extract_all(regexp_replace(body, '{QUOTED_SQL}', '', 'g'), '{WORD_SQL}') AS ws FROM b), t AS (SELECT doc_id, list_transform(ws, lambda x: replace(lower(x), '’', '''')) AS t FROM q),
c AS (SELECT doc_id, len(list_filter(t, lambda x: x IN {sql_list(FIRST)})) AS f, len(list_filter(t, lambda x: x IN {sql_list(THIRD)})) AS th, len(list_filter(t, lambda x: x IN {sql_list(PAST)})) AS p0, len(list_filter(t, lambda x: x LIKE '%ed' AND length(x) > 4)) AS ed, len(list_filter(t, lambda x: x IN {sql_list(PRESENT)})) AS pr FROM t),
d AS (SELECT *, p0 + least(ed, greatest(50, 2 * p0)) AS pa FROM c)"""


@query(
    "text_narrator",
    _COUNTS
    + """SELECT doc_id, CASE WHEN f + th < 40 THEN 'unknown' WHEN f / CAST(f + th AS DOUBLE) >= 0.62 THEN 'first' WHEN f / CAST(f + th AS DOUBLE) <= 0.38 THEN 'third' ELSE 'mixed' END AS pov,
 round(CASE WHEN f + th < 40 THEN 0 ELSE abs(f / CAST(f + th AS DOUBLE) - 0.5) * 2 * least(1.0, (f + th) / 400.0) END, 6) AS pov_confidence,
 CASE WHEN pa + pr < 60 THEN 'unknown' WHEN pa / CAST(pa + pr AS DOUBLE) >= 0.62 THEN 'past' WHEN pa / CAST(pa + pr AS DOUBLE) <= 0.38 THEN 'present' ELSE 'mixed' END AS tense FROM d""",
)
def text_narrator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrator's person and tense outside quotations, from pronouns and verb forms."""
    n = arrays(docs(spark, sf_dir), want="").select("doc_id", T.tokens(T.narration(F.col("body"))).alias("t"))
    c = n.select("doc_id", count_words(F.col("t"), FIRST).alias("f"), count_words(F.col("t"), THIRD).alias("th"), count_words(F.col("t"), PAST).alias("p0"), F.size(F.filter("t", lambda x: x.endswith("ed") & (F.length(x) > 4))).alias("ed"), count_words(F.col("t"), PRESENT).alias("pr"))
    c = c.withColumn("pa", F.col("p0") + F.least(F.col("ed"), F.greatest(F.lit(50), 2 * F.col("p0"))))
    share, past = F.col("f") / (F.col("f") + F.col("th")), F.col("pa") / (F.col("pa") + F.col("pr"))
    few, few2 = F.col("f") + F.col("th") < 40, F.col("pa") + F.col("pr") < 60
    name = lambda s, few, hi, lo: F.when(few, "unknown").when(s >= 0.62, hi).when(s <= 0.38, lo).otherwise("mixed")
    conf = F.when(few, 0.0).otherwise(F.abs(share - 0.5) * 2 * F.least(F.lit(1.0), (F.col("f") + F.col("th")) / 400.0))
    return c.select("doc_id", name(share, few, "first", "third").alias("pov"), r6(conf).alias("pov_confidence"), name(past, few2, "past", "present").alias("tense"))
