"""Similarity of sentences and paragraphs within documents, by words."""

from __future__ import annotations

from collections import Counter
from math import log, sqrt

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.functions import text as T
from proselake.functions.grams import per_row
from proselake.operators.core_metrics import arrays
from proselake.operators.views import PARA, SENT, WORD_SQL, docs, paragraphs, sentences
from proselake.plans.registry import query, r6

_SW = f"""{SENT}, w AS (SELECT doc_id, s, unnest(list_transform(regexp_extract_all(sentence, '{WORD_SQL}'), lambda x: replace(lower(x), '’', ''''))) AS token FROM sent),
tf AS (SELECT doc_id, s, token, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT doc_id, token, count(*) AS df FROM tf GROUP BY ALL), n AS (SELECT doc_id, count(*) AS n FROM sent GROUP BY doc_id),
v AS (SELECT doc_id, s, token, tf * (ln((1.0 + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (doc_id, token) JOIN n USING (doc_id)), nr AS (SELECT doc_id, s, sqrt(sum(x * x)) AS norm FROM v GROUP BY ALL)"""


def cosines(sentences: list[list[str]], back: int) -> list[list[float]]:
    """For each sentence but the first the cosines with those up to `back` before it, by TF-IDF over the sentences given."""
    counts = [Counter(s) for s in sentences]
    df = Counter(t for c in counts for t in c)
    idf = {t: log((1.0 + len(counts)) / (1 + k)) + 1 for t, k in df.items()}
    vectors = []
    for c in counts:
        v = {t: k * idf[t] for t, k in c.items()}
        norm = sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / norm for t, x in v.items()} if norm else v)
    dot = lambda a, b: sum(x * b[t] for t, x in a.items() if t in b) if len(a) <= len(b) else sum(x * a[t] for t, x in b.items() if t in a)
    return [[dot(vectors[i], vectors[k]) for k in range(max(0, i - back), i)] for i in range(1, len(vectors))]


def _sentence_tokens(documents: DataFrame) -> DataFrame:
    return arrays(documents, want="ss").select("doc_id", F.transform("ss", T.tokens).alias("ss")).where(F.size("ss") > 1)


@query(
    "similarity_adjacent",
    f"""WITH {_SW}, p AS (SELECT a.doc_id, a.s, sum(a.x * b.x) AS dot FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.token = b.token AND b.s = a.s + 1 GROUP BY ALL),
c AS (SELECT q.doc_id, q.s, coalesce(dot / (x.norm * y.norm), 0) AS cos FROM sent q JOIN sent r ON r.doc_id = q.doc_id AND r.s = q.s + 1 LEFT JOIN p ON p.doc_id = q.doc_id AND p.s = q.s JOIN nr x ON x.doc_id = q.doc_id AND x.s = q.s JOIN nr y ON y.doc_id = q.doc_id AND y.s = q.s + 1)
SELECT doc_id, count(*) AS pairs, round(quantile_cont(cos, 0.5), 6) AS median_similarity, round(100.0 * avg(CASE WHEN cos >= 0.8 THEN 1 ELSE 0 END), 6) AS high_share FROM c GROUP BY doc_id""",
)
def similarity_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each sentence with the next, within the row."""

    def of(ss: list[list[str]]) -> list[tuple]:
        c = np.array([x[-1] for x in cosines(ss, 1)])
        return [(len(c), float(np.median(c)), 100.0 * float((c >= 0.8).mean()))]

    return per_row(_sentence_tokens(docs(spark, sf_dir)), of, "pairs bigint, median_similarity double, high_share double").select("doc_id", "pairs", r6("median_similarity").alias("median_similarity"), r6("high_share").alias("high_share"))


@query(
    "similarity_window",
    f"""WITH {_SW}, p AS (SELECT a.doc_id, a.s, b.s AS t, sum(a.x * b.x) / (any_value(x.norm) * any_value(y.norm)) AS cos FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.token = b.token AND b.s BETWEEN a.s - 3 AND a.s - 1
 JOIN nr x ON x.doc_id = a.doc_id AND x.s = a.s JOIN nr y ON y.doc_id = b.doc_id AND y.s = b.s GROUP BY a.doc_id, a.s, b.s), m AS (SELECT doc_id, s, max(cos) AS m FROM p GROUP BY ALL)
SELECT sent.doc_id, round(quantile_cont(coalesce(m, 0), 0.5), 6) AS max_prior_similarity, round(100.0 * avg(CASE WHEN m >= 0.8 THEN 1 ELSE 0 END), 6) AS loop_share FROM sent LEFT JOIN m USING (doc_id, s) WHERE s > 0 GROUP BY sent.doc_id""",
)
def similarity_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence's nearest of the three before, within the row."""

    def of(ss: list[list[str]]) -> list[tuple]:
        m = np.array([max(x) for x in cosines(ss, 3)])
        return [(float(np.median(m)), 100.0 * float((m >= 0.8).mean()))]

    return per_row(_sentence_tokens(docs(spark, sf_dir)), of, "max_prior_similarity double, loop_share double").select("doc_id", r6("max_prior_similarity").alias("max_prior_similarity"), r6("loop_share").alias("loop_share"))


@query(
    "similarity_repeated_sentences",
    f"""WITH {SENT}, k AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(sentence, '{WORD_SQL}'), lambda x: replace(lower(x), '’', '''')), ' ') AS k FROM sent), c AS (SELECT doc_id, k, count(*) AS c FROM k GROUP BY ALL)
SELECT doc_id, count(*) FILTER (c > 1) AS clusters, round(100.0 * coalesce(sum(c) FILTER (c > 1), 0) / sum(c), 6) AS repeated_share, max(c) AS largest FROM c GROUP BY doc_id""",
)
def similarity_repeated_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of equal words within a document."""
    k = arrays(docs(spark, sf_dir), want="ss").select("doc_id", F.explode(F.transform("ss", lambda s: F.xxhash64(F.array_join(T.tokens(s), " ")))).alias("k"))
    c = k.groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias("c"))
    many = F.col("c") > 1
    return c.groupBy("doc_id").agg(F.sum(F.when(many, 1).otherwise(0)).alias("clusters"), r6(100.0 * F.sum(F.when(many, F.col("c")).otherwise(0)) / F.sum("c")).alias("repeated_share"), F.max("c").alias("largest"))


@query(
    "similarity_paragraph_overlap",
    f"""WITH {PARA}, t AS (SELECT doc_id, p, list_distinct(list_transform(regexp_extract_all(paragraph, '{WORD_SQL}'), lambda x: replace(lower(x), '’', ''''))) AS ws FROM para), l AS (SELECT doc_id, ws, lead(ws) OVER (PARTITION BY doc_id ORDER BY p) AS nx FROM t)
SELECT doc_id, count(*) AS pairs, round(avg(len(list_intersect(ws, nx)) / CAST(len(list_distinct(list_concat(ws, nx))) AS DOUBLE)), 6) AS overlap FROM l WHERE nx IS NOT NULL GROUP BY doc_id""",
)
def similarity_paragraph_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean Jaccard overlap of the words of adjacent paragraphs."""
    t = paragraphs(docs(spark, sf_dir)).select("doc_id", "p", F.array_distinct(T.tokens(F.col("paragraph"))).alias("ws"))
    l = t.withColumn("nx", F.lead("ws").over(Window.partitionBy("doc_id").orderBy("p"))).where("nx is not null")  # noqa: E741
    return l.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"), r6(F.avg(F.size(F.array_intersect("ws", "nx")) / F.size(F.array_union("ws", "nx")))).alias("overlap"))


@query(
    "similarity_lexical_chains",
    f"""WITH {SENT}, w AS (SELECT DISTINCT doc_id, s, unnest(list_transform(regexp_extract_all(sentence, '{WORD_SQL}'), lambda x: replace(lower(x), '’', ''''))) AS token FROM sent), g AS (SELECT doc_id, token, s, CASE WHEN s - lag(s) OVER w <= 3 THEN 0 ELSE 1 END AS new FROM w WHERE length(token) > 4 WINDOW w AS (PARTITION BY doc_id, token ORDER BY s)),
r AS (SELECT doc_id, token, s, sum(new) OVER (PARTITION BY doc_id, token ORDER BY s) AS chain FROM g), c AS (SELECT doc_id, token, chain, count(*) AS links FROM r GROUP BY ALL)
SELECT doc_id, count(*) FILTER (links >= 2) AS chains, max(links) AS longest FROM c GROUP BY doc_id""",
)
def similarity_lexical_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of sentences that share a longer word with gaps of three at most."""
    w = sentences(docs(spark, sf_dir)).select("doc_id", "s", F.explode(F.array_distinct(T.tokens(F.col("sentence")))).alias("token")).where(F.length("token") > 4)
    by = Window.partitionBy("doc_id", "token").orderBy("s")
    g = w.withColumn("new", F.when(F.col("s") - F.lag("s").over(by) <= 3, 0).otherwise(1)).withColumn("chain", F.sum("new").over(by))
    c = g.groupBy("doc_id", "token", "chain").agg(F.count(F.lit(1)).alias("links"))
    return c.groupBy("doc_id").agg(F.sum(F.when(F.col("links") >= 2, 1).otherwise(0)).alias("chains"), F.max("links").alias("longest"))
