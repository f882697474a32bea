"""Vocabulary: richness, entropies of n-grams, cross-entropy, rarity, author distances."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.functions import stats
from proselake.functions import text as T
from proselake.functions.grams import code_points, entropy, numbered, per_row, run_counts
from proselake.operators.core_metrics import arrays
from proselake.operators.style import FUNCTION_WORDS
from proselake.operators.views import TOK, WORD_SQL, bodies, docs, tokens
from proselake.plans.registry import query, r6
from proselake.session import materialize

_SPECTRUM = f"""WITH {TOK}, c AS (SELECT doc_id, token, count(*) AS c FROM tok GROUP BY ALL),
s AS (SELECT doc_id, CAST(sum(c) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS v, CAST(sum(CASE WHEN c = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS v1, CAST(sum(CASE WHEN c = 2 THEN 1 ELSE 0 END) AS DOUBLE) AS v2, CAST(sum(c * c) AS DOUBLE) AS m2 FROM c GROUP BY doc_id)"""


def spectrum(documents: DataFrame) -> DataFrame:
    """(doc_id, n, v, v1, v2, m2): the frequency spectrum of each document's vocabulary."""
    c = tokens(documents).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("c"))
    one = lambda k: F.sum(F.when(F.col("c") == k, 1).otherwise(0)).cast("double")
    return c.groupBy("doc_id").agg(F.sum("c").cast("double").alias("n"), F.count(F.lit(1)).cast("double").alias("v"), one(1).alias("v1"), one(2).alias("v2"), F.sum(F.col("c") * F.col("c")).cast("double").alias("m2"))


@query(
    "lexical_richness",
    _SPECTRUM
    + """SELECT doc_id, round(v1 / v, 6) AS hapax_ratio, round(v2 / v, 6) AS dislegomena_ratio, round(10000 * (m2 - n) / (n * n), 6) AS yules_k, round(CASE WHEN m2 > n THEN n * n / (m2 - n) END, 6) AS yules_i,
 round(CASE WHEN v1 < v THEN 100 * ln(n) / (1 - v1 / v) END, 6) AS honore_r, round(CASE WHEN n > 1 THEN ln(v) / ln(n) END, 6) AS herdan_c, round(v / sqrt(n), 6) AS guiraud_r,
 round(CASE WHEN n > 1 THEN (ln(n) - ln(v)) / (ln(n) * ln(n)) END, 6) AS maas, round(CASE WHEN n > v THEN ln(n) * ln(n) / (ln(n) - ln(v)) END, 6) AS uber FROM s""",
)
def lexical_richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-form measures of vocabulary richness."""
    s = spectrum(docs(spark, sf_dir))
    n, v, v1, v2, m2 = (F.col(c) for c in ("n", "v", "v1", "v2", "m2"))
    return s.select(
        "doc_id", r6(v1 / v).alias("hapax_ratio"), r6(v2 / v).alias("dislegomena_ratio"), r6(10000 * (m2 - n) / (n * n)).alias("yules_k"), r6(F.when(m2 > n, n * n / (m2 - n))).alias("yules_i"),
        r6(F.when(v1 < v, 100 * F.log(n) / (1 - v1 / v))).alias("honore_r"), r6(F.when(n > 1, F.log(v) / F.log(n))).alias("herdan_c"), r6(v / F.sqrt(n)).alias("guiraud_r"),
        r6(F.when(n > 1, (F.log(n) - F.log(v)) / (F.log(n) * F.log(n)))).alias("maas"), r6(F.when(n > v, F.log(n) * F.log(n) / (F.log(n) - F.log(v)))).alias("uber"),
    )


@query(
    "lexical_hdd",
    f"""WITH {TOK}, c AS (SELECT doc_id, token, count(*) AS c FROM tok GROUP BY ALL), n AS (SELECT doc_id, sum(c) AS n FROM c GROUP BY doc_id HAVING sum(c) >= 42)
SELECT doc_id, round(sum(1 - list_product(list_transform(range(42), lambda j: greatest(CAST(n - c - j AS DOUBLE), 0) / (n - j)))) / 42, 6) AS hdd FROM c JOIN n USING (doc_id) GROUP BY doc_id""",
)
def lexical_hdd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypergeometric diversity: the expected type-token ratio of 42 words drawn without replacement."""
    c = tokens(docs(spark, sf_dir)).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("c")).withColumn("n", F.sum("c").over(Window.partitionBy("doc_id"))).where("n >= 42")
    # the same ratio for all words of one count, so only counts of counts are evaluated
    cc = c.groupBy("doc_id", "n", "c").agg(F.count(F.lit(1)).alias("k"))
    none = F.aggregate(F.sequence(F.lit(0), F.lit(41)), F.lit(1.0), lambda a, j: a * F.greatest((F.col("n") - F.col("c") - j).cast("double"), F.lit(0.0)) / (F.col("n") - j))
    return cc.groupBy("doc_id").agg(r6(F.sum(F.col("k") * (1 - none)) / 42).alias("hdd"))


@query(
    "lexical_ngram_entropy",
    f"""WITH {TOK}, k AS (SELECT unnest([1, 2, 3]) AS n), l AS (SELECT doc_id, list_transform(ws, lambda x: replace(lower(x), '’', '''')) AS t FROM wl),
g AS (SELECT doc_id, n, unnest(list_transform(range(greatest(len(t) - n + 1, 0)), lambda i: array_to_string(t[i + 1 : i + n], ' '))) AS gram FROM l, k),
c AS (SELECT doc_id, n, gram, count(*) AS c FROM g GROUP BY ALL)
SELECT doc_id, CAST(n AS INTEGER) AS n, round(log2(sum(c)) - sum(c * log2(c)) / sum(c) + 0.0, 6) AS entropy FROM c GROUP BY doc_id, n""",
)
def lexical_ngram_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of word uni-, bi- and trigrams in bits, counted within the row."""
    a = arrays(docs(spark, sf_dir), want="toks").select("doc_id", "toks")

    def of(toks: list[str]) -> list[tuple]:
        ids = numbered(toks)
        return [(n, entropy(run_counts(ids, n))) for n in (1, 2, 3) if len(ids) >= n]

    return per_row(a, of, "n int, entropy double").select("doc_id", "n", r6("entropy").alias("entropy"))


@query(
    "lexical_char_entropy",
    f"""WITH {TOK}, k AS (SELECT unnest([1, 2, 3, 4, 5, 6]) AS n), g AS (SELECT doc_id, n, unnest(list_transform(range(greatest(length(body) - n + 1, 0)), lambda i: substring(body, i + 1, n))) AS gram FROM b, k),
c AS (SELECT doc_id, n, gram, count(*) AS c FROM g GROUP BY ALL) SELECT doc_id, CAST(n AS INTEGER) AS n, count(*) AS kinds, round(log2(sum(c)) - sum(c * log2(c)) / sum(c) + 0.0, 6) AS entropy FROM c GROUP BY doc_id, n""",
)
def lexical_char_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and entropy in bits of runs of one to six characters, counted within the row."""
    b = bodies(docs(spark, sf_dir)).select("doc_id", "body")

    def of(text: str) -> list[tuple]:
        ids = code_points(text)
        counts = [(n, run_counts(ids, n)) for n in range(1, 7) if len(ids) >= n]
        return [(n, len(c), entropy(c)) for n, c in counts]

    return per_row(b, of, "n int, kinds bigint, entropy double").select("doc_id", "n", "kinds", r6("entropy").alias("entropy"))


@query(
    "lexical_word_shapes",
    f"""WITH {TOK}, s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(word, '\\p{{Lu}}+', 'X', 'g'), '[\\p{{Ll}}\\p{{Lo}}\\p{{Lt}}\\p{{Lm}}]+', 'x', 'g'), '\\p{{N}}+', 'd', 'g') AS shape FROM tok)
SELECT doc_id, shape, count(*) AS n FROM s GROUP BY ALL""",
)
def lexical_word_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each word shape stands in a document."""
    return tokens(docs(spark, sf_dir)).select("doc_id", T.word_shape(F.col("word")).alias("shape")).groupBy("doc_id", "shape").agg(F.count(F.lit(1)).alias("n"))


@query(
    "lexical_corpus_words",
    f"""WITH {TOK}, c AS (SELECT token, count(*) AS tf, count(DISTINCT doc_id) AS df FROM tok GROUP BY token), n AS (SELECT (SELECT count(*) FROM b) AS docs, count(*) AS words FROM tok)
SELECT token, tf, df, round(log10(1e6 * tf / words) + 3, 6) AS zipf FROM c, n WHERE df >= ceil(0.5 * docs) ORDER BY tf DESC, token LIMIT 300""",
)
def lexical_corpus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The everyday vocabulary: of the words in half of the documents or more the 300 most frequent, with occurrences, documents and Zipf value."""
    d = docs(spark, sf_dir)
    c = corpus_words(d)
    words = c.agg(F.sum("tf").alias("words")).crossJoin(d.agg(F.count(F.lit(1)).alias("docs")))  # one row
    top = c.crossJoin(F.broadcast(words)).where("df >= ceil(0.5 * docs)").orderBy(F.desc("tf"), "token").limit(300)
    return top.select("token", "tf", "df", r6(F.log10(1e6 * F.col("tf") / F.col("words")) + 3).alias("zipf"))


def corpus_words(documents: DataFrame) -> DataFrame:
    """(token, tf, df): counted first within documents, so that the shuffle carries each word of a document once."""
    c = tokens(documents).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("token").agg(F.sum("c").alias("tf"), F.count(F.lit(1)).alias("df"))


@query(
    "lexical_rare_words",
    f"""WITH {TOK}, c AS (SELECT token, count(*) AS tf FROM tok GROUP BY token), w AS (SELECT count(*) AS words FROM tok), z AS (SELECT token, log10(1e6 * tf / words) + 3 AS zipf FROM c, w)
SELECT doc_id, round(quantile_cont(zipf, 0.5), 6) AS zipf_median, round(100.0 * avg(CASE WHEN zipf < 4 THEN 1 ELSE 0 END), 6) AS rare_share FROM tok JOIN z USING (token) GROUP BY doc_id""",
)
def lexical_rare_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median corpus frequency (Zipf) of each document's words, and the share of rare ones."""
    d = docs(spark, sf_dir)
    c = tokens(d).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("c"))
    z = c.groupBy("token").agg(F.sum("c").alias("tf"))
    z = z.crossJoin(F.broadcast(z.agg(F.sum("tf").alias("words")))).select("token", (F.log10(1e6 * F.col("tf") / F.col("words")) + 3).alias("zipf"))
    x = c.join(z, "token")
    return x.groupBy("doc_id").agg(r6(F.percentile("zipf", F.lit(0.5), F.col("c"))).alias("zipf_median"), r6(100.0 * F.sum(F.when(F.col("zipf") < 4, F.col("c")).otherwise(0)) / F.sum("c")).alias("rare_share"))


@query(
    "lexical_keyness",
    f"""WITH {TOK}, c AS (SELECT source, token, CAST(count(*) AS DOUBLE) AS a FROM tok WHERE source IS NOT NULL GROUP BY ALL), t AS (SELECT token, sum(a) AS t FROM c GROUP BY token),
n AS (SELECT source, sum(a) AS na FROM c GROUP BY source), w AS (SELECT sum(a) AS w FROM c),
x AS (SELECT source, token, a, t - a AS b, na, w - na AS nb FROM c JOIN t USING (token) JOIN n USING (source), w),
g AS (SELECT *, 2 * (a * ln(a / (na * (a + b) / (na + nb))) + CASE WHEN b > 0 THEN b * ln(b / (nb * (a + b) / (na + nb))) ELSE 0 END) AS g2 FROM x)
SELECT source, token, CAST(a AS BIGINT) AS n, round(g2, 4) AS g2 FROM g WHERE g2 >= 10.83 AND a / na > (a + b) / (na + nb)""",
)
def lexical_keyness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a source uses more than the others (log-likelihood of 10.83 and more)."""
    c = tokens(docs(spark, sf_dir).where("source is not null"), "source").groupBy("source", "token").agg(F.count(F.lit(1)).cast("double").alias("a"))
    t, n = c.groupBy("token").agg(F.sum("a").alias("t")), c.groupBy("source").agg(F.sum("a").alias("na"))
    x = c.join(t, "token").join(n, "source").crossJoin(F.broadcast(n.agg(F.sum("na").alias("w"))))
    a, b, na, nb = F.col("a"), F.col("t") - F.col("a"), F.col("na"), F.col("w") - F.col("na")
    g = x.withColumn("g2", stats.g2(a, b, na, nb)).where((F.col("g2") >= 10.83) & (a / na > F.col("t") / F.col("w")))
    return g.select("source", "token", a.cast("bigint").alias("n"), F.round("g2", 4).alias("g2"))


@query(
    "author_nearest",
    f"""WITH {TOK}, n AS (SELECT doc_id, any_value(source) AS source, count(*) AS n FROM tok WHERE source IS NOT NULL GROUP BY doc_id HAVING count(*) >= 200), v AS (SELECT unnest({[*FUNCTION_WORDS]}) AS token),
r AS (SELECT n.doc_id, any_value(n.source) AS source, v.token, 1000.0 * count(tok.token) / any_value(n.n) AS rate FROM n CROSS JOIN v LEFT JOIN tok ON tok.doc_id = n.doc_id AND tok.token = v.token GROUP BY n.doc_id, v.token),
s AS (SELECT token, avg(rate) AS m, stddev_pop(rate) AS sd FROM r GROUP BY token), z AS (SELECT doc_id, source, token, (rate - m) / sd AS z FROM r JOIN s USING (token) WHERE sd > 1e-12),
c AS (SELECT source, token, sum(z) AS cs, count(*) AS cn FROM z GROUP BY ALL),
d AS (SELECT z.doc_id, z.source, c.source AS author, avg(abs(z.z - CASE WHEN c.source = z.source THEN (cs - z.z) / (cn - 1) ELSE cs / cn END)) AS delta FROM z JOIN c USING (token) WHERE c.source <> z.source OR cn > 1 GROUP BY ALL)
SELECT doc_id, source, author, round(delta, 5) AS delta FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(delta, 5), author) = 1""",
)
def author_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source whose centroid of standardised function-word rates lies nearest to each document, itself left out of its own."""
    return nearest_author(docs(spark, sf_dir).where("source is not null"))


#: Centroids that a task holds at once (a vector of a number a function word each); more are compared block by block.
CENTROIDS = 100_000


def nearest_author(documents: DataFrame, least: int = 200) -> DataFrame:
    """(doc_id, source, author, delta) of documents of `least` words or more.

    Each document is a vector in its row. Sources come to a sum of vectors each, and documents are compared with blocks of
    these as matrices, so nothing is joined on words and the work is spread over documents.
    """
    a = arrays(documents, "source", want="toks").where(F.size("toks") >= least).select("doc_id", "source", "toks")
    words = {w: i for i, w in enumerate(FUNCTION_WORDS)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for toks in b.column(2).to_pylist():
                c = Counter(toks)
                out.append([1000.0 * c[w] / len(toks) for w in words])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.float64()))], ["doc_id", "source", "x"])

    v = materialize(a.mapInArrow(vectors, "doc_id bigint, source string, x array<double>"))
    s = {r.k: r for r in v.select(F.posexplode("x").alias("k", "r")).groupBy("k").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("sd")).collect()}  # one row a function word
    kept = [k for k in sorted(s) if s[k].sd > 1e-12]
    mean, sd = np.array([s[k].m for k in kept]), np.array([s[k].sd for k in kept])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for b in batches:
            z = (np.array(b.column(2).to_pylist()).reshape(b.num_rows, -1)[:, kept] - mean) / sd
            for src, row in zip(b.column(1).to_pylist(), z):
                h = held.setdefault(src, [0, np.zeros(len(kept))])
                h[0], h[1] = h[0] + 1, h[1] + row
            if len(held) > 50_000:
                yield _sums(held)
                held = {}
        yield _sums(held)

    part = v.mapInArrow(sums, "author string, n bigint, z array<double>").select("author", "n", F.posexplode("z").alias("k", "z")).groupBy("author", "k").agg(F.sum("n").alias("n"), F.sum("z").alias("z"))
    c = materialize(part.groupBy("author").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "z"))), lambda r: r["z"]).alias("z")))  # a number a function word
    blocks = max(1, -(-c.count() // CENTROIDS))
    best = None
    for i in range(blocks):
        rows = c.where(F.pmod(F.xxhash64("author"), F.lit(blocks)) == i).orderBy("author").collect()
        near = v.mapInArrow(_nearest([r.author for r in rows], np.array([r.n for r in rows], float), np.array([r.z for r in rows]).reshape(len(rows), -1), kept, mean, sd), "doc_id bigint, source string, author string, delta double")
        best = near if best is None else best.unionByName(near)
    if blocks == 1:
        return best
    return best.groupBy("doc_id", "source").agg(F.min(F.struct("delta", "author")).alias("b")).select("doc_id", "source", "b.author", "b.delta")


def _sums(held: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([h[0] for h in held.values()], pa.int64()), pa.array([h[1].tolist() for h in held.values()], pa.list_(pa.float64()))], ["author", "n", "z"])


def _nearest(authors: list[str], n: np.ndarray, sums: np.ndarray, kept: list[int], mean: np.ndarray, sd: np.ndarray):
    """The nearest of the authors (in order of their names) for each document of a batch; of equal distances the first."""
    at = {a: i for i, a in enumerate(authors)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = sums / n[:, None] if len(authors) else sums
        for b in batches:
            ids, sources, out, deltas = [], [], [], []
            x = np.array(b.column(2).to_pylist()).reshape(b.num_rows, -1)
            z = (x[:, kept] - mean) / sd if b.num_rows else x
            for i, src, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), z):
                d = np.abs(centre - row).mean(1) if len(authors) else np.zeros(0)
                if (k := at.get(src)) is not None:
                    d[k] = np.abs((sums[k] - row) / (n[k] - 1) - row).mean() if n[k] > 1 else np.inf
                d = np.round(d, 5)
                if len(d) and np.isfinite(d.min()):
                    j = int(d.argmin())
                    ids.append(i), sources.append(src), out.append(authors[j]), deltas.append(float(d[j]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sources, pa.string()), pa.array(out, pa.string()), pa.array(deltas, pa.float64())], ["doc_id", "source", "author", "delta"])

    return run


@query(
    "lexical_cross_entropy",
    f"""WITH {TOK}, w AS (SELECT token, count(*) AS c FROM tok GROUP BY token), n AS (SELECT sum(c) AS n, count(*) AS v FROM w), d AS (SELECT doc_id, token, count(*) AS k FROM tok GROUP BY ALL)
SELECT doc_id, round(sum(k * -log2((c + 0.5) / (n + 0.5 * v))) / sum(k), 6) AS cross_entropy FROM d JOIN w USING (token), n GROUP BY doc_id""",
)
def lexical_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy of each document under the corpus' smoothed unigram model, in bits a word."""
    d = tokens(docs(spark, sf_dir)).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("k"))
    w = d.groupBy("token").agg(F.sum("k").alias("c"))
    n = w.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
    x = d.join(w.crossJoin(F.broadcast(n)), "token")
    return x.groupBy("doc_id").agg(r6(F.sum(F.col("k") * -F.log2((F.col("c") + 0.5) / (F.col("n") + 0.5 * F.col("v")))) / F.sum("k")).alias("cross_entropy"))


@query(
    "lexical_heaps",
    f"""WITH {TOK}, f AS (SELECT doc_id, i, CASE WHEN row_number() OVER (PARTITION BY doc_id, token ORDER BY i) = 1 THEN 1 ELSE 0 END AS new FROM tok),
g AS (SELECT doc_id, ln(i + 1) AS x, ln(sum(new) OVER (PARTITION BY doc_id ORDER BY i)) AS y, i FROM f)
SELECT doc_id, round(regr_slope(y, x), 5) AS heaps_exponent, round(regr_r2(y, x), 5) AS r2 FROM g JOIN (SELECT doc_id, n FROM (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id)) s USING (doc_id)
WHERE n >= 100 AND (i + 1 = n OR i + 1 IN (SELECT greatest(50, CAST(floor(n * pow(k / 20.0::DOUBLE, 2)) AS BIGINT)) FROM range(1, 21) r(k))) GROUP BY doc_id HAVING count(*) >= 2""",
)
def lexical_heaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponent of vocabulary growth of documents of a hundred words or more, fitted at some twenty places that lie the wider apart the later."""
    t = tokens(docs(spark, sf_dir)).select("doc_id", "i", "token")
    t = t.withColumn("new", (F.row_number().over(Window.partitionBy("doc_id", "token").orderBy("i")) == 1).cast("int"))
    t = t.withColumn("y", F.log(F.sum("new").over(Window.partitionBy("doc_id").orderBy("i")))).withColumn("x", F.log(F.col("i") + 1.0)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    places = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.greatest(F.lit(50), F.floor(F.col("n") * F.pow(k / 20.0, F.lit(2.0))).cast("int")))
    t = t.where("n >= 100").where((F.col("i") + 1 == F.col("n")) | F.array_contains(places, F.col("i").cast("int") + 1))
    g = t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.round(F.regr_slope("y", "x"), 5).alias("heaps_exponent"), F.round(F.regr_r2("y", "x"), 5).alias("r2"))
    return g.where("k >= 2").drop("k")
