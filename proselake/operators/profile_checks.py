"""Profiles from measurements and the checks made with them: pooled curves, bands, gates, drift against length, benchmarks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.functions import stats
from proselake.functions import text as T
from proselake.functions.ordered import cumulative
from proselake.operators.compare import COMPARED, LATEST, STATS_SQL, _sig_sql, compared, corpus_stats, latest_findings
from proselake.operators.core_metrics import held
from proselake.operators.views import SENT, WORD_SQL, bodies, docs
from proselake.plans.registry import query, r6, sig
from proselake.session import broadcast_if_small, materialize, table

KEYS = ["corpus", "metric_id"]
#: Quantiles of the corpus that cut its bands; the least and most of a text's size against the corpus' median.
BANDS, SMALLEST, LARGEST = (0.1, 0.25, 0.5, 0.75, 0.9), 1 / 3, 3.0
#: Metrics of which less is better, by the beginning of their names.
LESS_IS_BETTER = ("lexical.keyness", "repetition", "style.local")


def curve(x: str, points: int = 101) -> Column:
    """The quantile function of a group at evenly spaced places, by linear interpolation."""
    return F.percentile(F.col(x), F.array(*[F.lit(i / (points - 1)) for i in range(points)]))


def curve_distance(a: Column, b: Column, power: int = 1) -> Column:
    """Mean gap of two curves of equal length (power 2: mean squared gap)."""
    gaps = F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(power))))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g) / F.size(a)


def curve_quantile(c: Column, q: Column) -> Column:
    """The value of a stored curve at a quantile, interpolated between its points."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), q)) * (F.size(c) - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(c, low), F.get(c, F.least(low + 1, F.size(c) - 1))
    return a + (b - a) * (at - low)


_CURVES = ", ".join(str(i / 100) for i in range(101))
ITEMS_SQL = f"""items AS (SELECT doc_id, 'sentence_words' AS item, CAST(n_words AS DOUBLE) AS v FROM sent UNION ALL SELECT doc_id, 'sentence_chars', CAST(length(sentence) AS DOUBLE) FROM sent
UNION ALL SELECT doc_id, 'paragraph_words', CAST(len(regexp_extract_all(paragraph, '{WORD_SQL}')) AS DOUBLE) FROM para)"""
ITEMS = ("sentence_words", "sentence_chars", "paragraph_words")


def item_lists(documents: DataFrame) -> DataFrame:
    """(doc_id, item, vs ARRAY<INT>): each document's values of each item, counted within its row in one pass over the text."""
    d = held(held(bodies(documents)).select("doc_id", T.paragraphs(F.col("body")).alias("ps")))
    d = held(d.select("doc_id", F.transform("ps", T.sentences_of_paragraph).alias("pss")))
    # no word goes over the end of a sentence, so a paragraph has the words of its sentences
    w = F.transform("pss", lambda ss: F.transform(ss, lambda s: F.size(T.words(s)))).alias("w")
    d = held(d.select("doc_id", w, F.transform(F.flatten("pss"), F.length).alias("c")))
    total = F.transform("w", lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n))
    vs = F.array(*(F.struct(F.lit(k).alias("item"), v.alias("vs")) for k, v in zip(ITEMS, (F.flatten("w"), F.col("c"), total))))
    return d.select("doc_id", F.inline(vs)).where(F.size("vs") > 0)


def items(documents: DataFrame) -> DataFrame:
    """(doc_id, item, v): the values of single sentences and paragraphs that are pooled over a corpus."""
    return single(item_lists(documents))


def single(lists: DataFrame) -> DataFrame:
    """(doc_id, item, v) of (doc_id, item, vs)."""
    return lists.select("doc_id", "item", F.explode("vs").alias("v")).withColumn("v", F.col("v").cast("double"))


@query("corpus_item_pools", f"WITH {SENT}, {ITEMS_SQL} SELECT item, count(*) AS n, count(DISTINCT doc_id) AS texts, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90 FROM items GROUP BY item")
def corpus_item_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of all texts pooled into one distribution each (the quantiles come from counts by value, whatever the number of items)."""
    return pools(items(docs(spark, sf_dir))).select("item", "n", "texts", *(r6(curve_quantile(F.col("curve"), F.lit(q))).alias(k) for k, q in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))))


def pools(items: DataFrame) -> DataFrame:
    """(item, n, texts, curve): the 101-point curve of each item over the corpus, exact, from ranks of slices."""
    n = items.groupBy("item", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("item").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    c = cumulative(items.select("item", "v"), ["item"], "v", {"k": F.lit(1)}).join(F.broadcast(n), "item")
    # the values at the two ranks beside each point
    at = F.explode(F.expr("transform(sequence(0, 100), p -> struct(p as p, (n - 1) * p / 100.0D as place))")).alias("q")
    c = c.where("k > 0").select("item", "n", "texts", "v", (F.col("upto_k") - F.col("k")).alias("first"), "upto_k", at)
    low, high = F.floor("q.place"), F.ceil("q.place")
    held = lambda r: (F.col("first") <= r) & (r < F.col("upto_k"))
    c = c.where(held(low) | held(high)).groupBy("item", "n", "texts", F.col("q.p").alias("p"), F.col("q.place").alias("place")).agg(F.max(F.when((F.col("first") <= F.floor("q.place")) & (F.floor("q.place") < F.col("upto_k")), F.col("v"))).alias("a"), F.max(F.when((F.col("first") <= F.ceil("q.place")) & (F.ceil("q.place") < F.col("upto_k")), F.col("v"))).alias("b"))
    x = c.withColumn("x", F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place")))
    return x.groupBy("item", "n", "texts").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda r: r["x"]).alias("curve"))  # 101 numbers


@query(
    "document_curve_distance",
    f"""WITH {SENT}, {ITEMS_SQL}, c AS (SELECT item, quantile_cont(v, [{_CURVES}]) AS c FROM items GROUP BY item), d AS (SELECT doc_id, item, count(*) AS n, quantile_cont(v, [{_CURVES}]) AS d, quantile_cont(v, 0.5) AS median FROM items GROUP BY ALL)
SELECT doc_id, item, n, round(list_sum(list_transform(range(1, 102), lambda i: abs(c[i] - d[i]))) / 101, 5) AS distance, round(list_sum(list_transform(range(1, 102), lambda i: pow(c[i] - d[i], 2))) / 101, 4) AS transport FROM d JOIN c USING (item)""",
)
def document_curve_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the curve of each document's sentences and paragraphs lies from the corpus' pooled one, and the squared cost of moving one to the other."""
    # written once, as the pooled curves are needed before the documents are compared with them
    lists = materialize(item_lists(docs(spark, sf_dir)))
    own = lists.groupBy("doc_id", "item").agg(F.flatten(F.collect_list("vs")).alias("vs"))
    g = curve_gaps(own, {r["item"]: r["curve"] for r in pools(single(lists)).collect()})  # 101 numbers an item
    return g.select("doc_id", "item", "n", F.round("distance", 5).alias("distance"), F.round("transport", 4).alias("transport"))


def curve_gaps(lists: DataFrame, curves: dict[str, list[float]]) -> DataFrame:
    """(doc_id, item, n, distance, transport): mean gap and mean squared gap between the quantile function of a row's values
    and the curve of its item; the rows of a batch are compared together."""
    held_curves = {k: np.array(c) for k, c in curves.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(k, 1024) for k in range(0, batch.num_rows, 1024)):
                at = b.column(2).offsets.to_numpy().astype(np.int64)
                v = b.column(2).values.to_numpy()[at[0] : at[-1]].astype(np.float64)
                n, first = np.diff(at), (at[:-1] - at[0])[:, None]
                v = v[np.lexsort((v, np.repeat(np.arange(len(n)), n)))]
                items = b.column(1).to_pylist()
                pooled = np.array([held_curves[x] for x in items])
                place = (n - 1)[:, None] * np.arange(pooled.shape[1]) / (pooled.shape[1] - 1)
                low = np.floor(place).astype(np.int64)
                a, z = v[first + low], v[first + np.ceil(place).astype(np.int64)]
                gap = np.abs(a + (z - a) * (place - low) - pooled)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(items, pa.string()), pa.array(n, pa.int64()), pa.array(gap.mean(axis=1)), pa.array((gap * gap).mean(axis=1))], ["doc_id", "item", "n", "distance", "transport"])

    return lists.select("doc_id", "item", "vs").mapInArrow(run, "doc_id bigint, item string, n bigint, distance double, transport double")


@query(
    "document_band_shares",
    f"""WITH {SENT}, {ITEMS_SQL}, e AS (SELECT item, quantile_cont(v, 0.1) AS a, quantile_cont(v, 0.25) AS b, quantile_cont(v, 0.5) AS c, quantile_cont(v, 0.75) AS d, quantile_cont(v, 0.9) AS f FROM items GROUP BY item),
k AS (SELECT doc_id, item, CASE WHEN v <= a THEN 0 WHEN v <= b THEN 1 WHEN v <= c THEN 2 WHEN v <= d THEN 3 WHEN v <= f THEN 4 ELSE 5 END AS band FROM items JOIN e USING (item))
SELECT doc_id, item, {', '.join(f'round(100.0 * count(*) FILTER (band = {b}) / count(*), 6) AS band{b}' for b in range(6))} FROM k GROUP BY ALL""",
)
def document_band_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each document's sentences and paragraphs in the bands that the corpus' quantiles cut."""
    i = items(docs(spark, sf_dir))
    edges = pools(i).select("item", F.array(*(F.round(curve_quantile(F.col("curve"), F.lit(q)), 9) for q in BANDS)).alias("edges"))
    band = F.size(F.filter("edges", lambda e: F.col("v") > e))
    k = i.join(F.broadcast(edges), "item").withColumn("band", band)
    return k.groupBy("doc_id", "item").agg(*(r6(100.0 * F.count(F.when(F.col("band") == b, 1)) / F.count(F.lit(1))).alias(f"band{b}") for b in range(6)))


def word_rates(documents: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, metric_id, value): occurrences per thousand words of each word of a vocabulary (token), also of those a document lacks."""
    from proselake.operators.core_metrics import arrays

    words = F.broadcast(vocabulary.select("token").agg(F.array_sort(F.collect_set("token")).alias("vocab")))  # bounded: the everyday vocabulary
    a = arrays(documents, want="toks").select("doc_id", "toks").where(F.size("toks") > 0).crossJoin(words)
    kept = F.concat(F.filter("toks", lambda t: F.array_contains("vocab", t)), F.col("vocab"))
    c = a.select("doc_id", F.size("toks").alias("n"), F.explode(kept).alias("token")).groupBy("doc_id", "n", "token").agg(F.count(F.lit(1)).alias("c"))
    return c.select("doc_id", F.concat(F.lit("lexical.word_rate."), "token").alias("metric_id"), (1000.0 * (F.col("c") - 1) / F.col("n")).alias("value"))


@query(
    "findings_of_documents",
    f"""WITH {SENT}, m AS (SELECT doc_id, 'rhythm.sentence_words' AS metric_id, avg(n_words) AS value, count(*) AS sample_size FROM sent GROUP BY doc_id UNION ALL SELECT doc_id, 'rhythm.sentence_chars', avg(length(sentence)), count(*) FROM sent GROUP BY doc_id
UNION ALL SELECT doc_id, 'rhythm.paragraph_words', avg(len(regexp_extract_all(paragraph, '{WORD_SQL}'))), count(*) FROM para GROUP BY doc_id),
r AS (SELECT *, rank() OVER (PARTITION BY metric_id ORDER BY value) AS k, count(*) OVER (PARTITION BY metric_id, value) AS ties, count(*) OVER (PARTITION BY metric_id) AS n FROM m)
SELECT doc_id, metric_id, round(value, 6) AS value, sample_size, round(100.0 * (k - 1 + 0.5 * (ties - 1)) / (n - 1), 6) AS percentile FROM r""",
)
def findings_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in, compared findings out: each measurement located among those of all other documents (leaving its own out)."""
    return held_out(measured(items(docs(spark, sf_dir)))).select("doc_id", "metric_id", r6("value").alias("value"), "sample_size", r6("percentile").alias("percentile"))


def measured(items: DataFrame) -> DataFrame:
    """(doc_id, metric_id, value, sample_size): finding rows from pooled items, the mean of each."""
    return items.groupBy("doc_id", "item").agg(F.avg("v").alias("value"), F.count(F.lit(1)).alias("sample_size")).select("doc_id", F.concat(F.lit("rhythm."), "item").alias("metric_id"), "value", "sample_size")


def held_out(findings: DataFrame) -> DataFrame:
    """findings + percentile among the other observations of the metric, ties half."""
    c = cumulative(findings, ["metric_id"], "value", {"k": F.lit(1)})
    n = findings.groupBy("metric_id").agg(F.count(F.lit(1)).alias("n"))
    p = c.join(F.broadcast(n), "metric_id").select("metric_id", "value", (100.0 * (F.col("upto_k") - F.col("k") + 0.5 * (F.col("k") - 1)) / (F.col("n") - 1)).alias("percentile"))
    return findings.join(p, ["metric_id", "value"])


@query(
    "corpus_spread",
    f"WITH {STATS_SQL}, a AS (SELECT profile, metric_id, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.5) AS median, count(*) AS n FROM cd GROUP BY ALL) SELECT profile, metric_id, n, {_sig_sql('median')} AS median, CASE WHEN mean <> 0 THEN {_sig_sql('100 * sd / abs(mean)')} END AS cv FROM a WHERE n > 1",
)
def corpus_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and coefficient of variation of each reference distribution."""
    d = table(spark, sf_dir, "corpus_dist").where(stats.finite("value"))
    s = d.groupBy("profile", "metric_id").agg(F.count(F.lit(1)).alias("n"), F.percentile("value", F.lit(0.5)).alias("median"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).where("n > 1")
    return s.select("profile", "metric_id", "n", sig("median").alias("median"), sig(F.when(F.col("mean") != 0, 100 * F.col("sd") / F.abs("mean"))).alias("cv"))


@query(
    "compare_maturity",
    f"""WITH {COMPARED}, o AS (SELECT doc_id, corpus, CASE WHEN {' OR '.join(f"metric_id LIKE '{x}%'" for x in LESS_IS_BETTER)} THEN 100 - percentile ELSE percentile END AS p FROM compared)
SELECT doc_id, corpus, count(*) AS metrics, round(quantile_cont(p, 0.5), 6) AS maturity FROM o GROUP BY ALL""",
)
def compare_maturity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median percentile of a document's metrics, each turned so that more is better."""
    return maturity(compared(spark, sf_dir), LESS_IS_BETTER)


def maturity(compared: DataFrame, less: tuple[str, ...]) -> DataFrame:
    turned = F.lit(False)
    for x in less:
        turned = turned | F.col("metric_id").startswith(x)
    p = F.when(turned, 100 - F.col("percentile")).otherwise(F.col("percentile"))
    return compared.groupBy("doc_id", "corpus").agg(F.count(F.lit(1)).alias("metrics"), r6(F.percentile(p, F.lit(0.5))).alias("maturity"))


@query(
    "compare_benchmark_gaps",
    f"""WITH {COMPARED}, t AS (SELECT profile AS corpus, metric_id, min(obs_id) AS obs_id FROM cd GROUP BY ALL), b AS (SELECT t.corpus, t.metric_id, cd.value AS target FROM t JOIN cd ON cd.profile = t.corpus AND cd.metric_id = t.metric_id AND cd.obs_id = t.obs_id),
s AS (SELECT profile AS corpus, metric_id, sd FROM cs WHERE n > 1 AND sd > 1e-9), d AS (SELECT doc_id, corpus, metric_id, avg(value) AS value FROM compared GROUP BY ALL),
g AS (SELECT doc_id, corpus, metric_id, CASE WHEN {' OR '.join(f"metric_id LIKE '{x}%'" for x in LESS_IS_BETTER)} THEN value - target ELSE target - value END / sd AS gap FROM d JOIN b USING (corpus, metric_id) JOIN s USING (corpus, metric_id))
SELECT doc_id, corpus, metric_id, {_sig_sql('gap')} AS gap_sd FROM g WHERE gap > 1e-9""",
)
def compare_benchmark_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many deviations of the corpus a document is behind one of its texts (the first by name), for each metric in which it is."""
    d = table(spark, sf_dir, "corpus_dist").where(stats.finite("value"))
    target = d.groupBy(F.col("profile").alias("corpus"), "metric_id").agg(F.min_by("value", "obs_id").alias("target"))
    sd = corpus_stats(d).where("n > 1 and sd > 1e-9").select(F.col("profile").alias("corpus"), "metric_id", "sd")
    own = compared(spark, sf_dir).groupBy("doc_id", *KEYS).agg(F.avg("value").alias("value"))
    j = own.join(broadcast_if_small(target.join(sd, KEYS)), KEYS)
    less = F.lit(False)
    for x in LESS_IS_BETTER:
        less = less | F.col("metric_id").startswith(x)
    gap = F.when(less, F.col("value") - F.col("target")).otherwise(F.col("target") - F.col("value")) / F.col("sd")
    return j.withColumn("gap", gap).where("gap > 1e-9").select("doc_id", *KEYS, sig("gap").alias("gap_sd"))


@query(
    "corpus_length_confound",
    f"""WITH {STATS_SQL}, m AS (SELECT profile, min(metric_id) AS base FROM cd GROUP BY profile), w AS (SELECT cd.profile, obs_id, value AS words FROM cd JOIN m ON m.profile = cd.profile AND m.base = cd.metric_id)
SELECT cd.profile, metric_id, count(*) AS n, round(corr(value, words), 6) + 0.0 AS r, abs(corr(value, words)) >= 0.8 AS confounded FROM cd JOIN w USING (profile, obs_id) GROUP BY ALL HAVING count(*) >= 8 AND count(DISTINCT value) >= 3 AND count(DISTINCT words) >= 3 AND stddev_pop(value) > 1e-9""",
)
def corpus_length_confound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of each metric with one base metric of the same texts (their length where it is measured; here the first by name)."""
    d = table(spark, sf_dir, "corpus_dist").where(stats.finite("value")).select("profile", "metric_id", "obs_id", "value")
    base = d.groupBy("profile").agg(F.min("metric_id").alias("metric_id"))
    return length_confound(d, d.join(F.broadcast(base), ["profile", "metric_id"]).select("profile", "obs_id", F.col("value").alias("words")))


def length_confound(dist: DataFrame, sizes: DataFrame, least: float = 0.8) -> DataFrame:
    """(profile, metric_id, n, r, confounded): dist (profile, metric_id, obs_id, value) against sizes (profile, obs_id, words)."""
    j = dist.join(sizes, ["profile", "obs_id"]).groupBy("profile", "metric_id").agg(
        F.count(F.lit(1)).alias("n"), F.corr("value", "words").alias("r"), F.countDistinct("value").alias("kinds"), F.countDistinct("words").alias("sizes"), F.stddev_pop("value").alias("sd")
    )
    return j.where("n >= 8 and kinds >= 3 and sizes >= 3 and sd > 1e-9").select("profile", "metric_id", "n", r6("r").alias("r"), (F.abs("r") >= least).alias("confounded"))


@query(
    "findings_size_gate",
    f"""WITH {LATEST}, m AS (SELECT corpus, metric_id, quantile_cont(sample_size, 0.5) AS usual FROM latest WHERE sample_size IS NOT NULL AND corpus IS NOT NULL GROUP BY ALL)
SELECT corpus, metric_id, count(*) AS n, count(*) FILTER (sample_size < usual / 3.0) AS small, count(*) FILTER (sample_size > usual * 3.0) AS large FROM latest JOIN m USING (corpus, metric_id) WHERE sample_size IS NOT NULL GROUP BY ALL""",
)
def findings_size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings refused because their sample is less than a third or more than three times what is usual for the metric."""
    f = latest_findings(table(spark, sf_dir, "findings")).where("sample_size is not null and corpus is not null").select(*KEYS, "sample_size")
    usual = f.groupBy(*KEYS).agg(F.percentile("sample_size", F.lit(0.5)).alias("usual"))
    return size_gate(f, usual).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("gate") == "small", 1)).alias("small"), F.count(F.when(F.col("gate") == "large", 1)).alias("large"))


def size_gate(findings: DataFrame, usual: DataFrame) -> DataFrame:
    """findings + gate: small, large or null by the ratio of sample_size to usual (corpus, metric_id, usual)."""
    s = F.col("sample_size")
    return findings.join(broadcast_if_small(usual), KEYS).withColumn("gate", F.when(s < F.col("usual") / 3.0, "small").when(s > F.col("usual") * 3.0, "large"))


def options_gate(findings: DataFrame, profile_options: DataFrame) -> DataFrame:
    """findings (corpus, metric_id, options map) + comparable: whether the options it was measured with are those of the profile
    (corpus, metric_id, options); where either side has none recorded it can't be refused."""
    digest = lambda c: F.when(c.isNotNull(), F.xxhash64(F.to_json(F.array_sort(F.map_entries(c)))))
    p = profile_options.select(*KEYS, digest(F.col("options")).alias("__theirs"))
    j = findings.withColumn("__own", digest(F.col("options"))).join(broadcast_if_small(p), KEYS, "left")
    return j.withColumn("comparable", F.coalesce(F.col("__own") == F.col("__theirs"), F.lit(True))).drop("__own", "__theirs")


def selected_metrics(registry: DataFrame, enabled: list[str] | None = None, parse: bool = True, model: bool = False) -> DataFrame:
    """Rows of a registry (metric_id, needs_parse, needs_model) that are measured: all, or the enabled ones, without those whose needs aren't met."""
    r = registry if enabled is None else registry.where(F.col("metric_id").isin(enabled))
    return r.where((~F.col("needs_parse") | F.lit(parse)) & (~F.col("needs_model") | F.lit(model)))


@query(
    "sections_in_bands",
    """WITH c AS (SELECT doc_id, seq_name, idx, max(value) AS x FROM sequences WHERE value IS NOT NULL AND isfinite(value) GROUP BY ALL), b AS (SELECT seq_name, quantile_cont(x, 0.25) AS floor, quantile_cont(x, 0.75) AS ceiling FROM c GROUP BY seq_name),
k AS (SELECT doc_id, seq_name, idx // 10 AS part, avg(x) AS mean, count(*) AS members, count(*) FILTER (x < floor OR x > ceiling) AS outside, any_value(floor) AS floor, any_value(ceiling) AS ceiling FROM c JOIN b USING (seq_name) GROUP BY ALL)
SELECT doc_id, seq_name, CAST(part AS BIGINT) AS part, members, outside, round(mean, 6) + 0.0 AS mean, CASE WHEN round(mean, 9) < round(floor, 9) THEN 'below' WHEN round(mean, 9) > round(ceiling, 9) THEN 'above' ELSE 'inside' END AS verdict FROM k""",
)
def sections_in_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each stretch of ten places against the middle half of the corpus, with its members outside of it."""
    c = table(spark, sf_dir, "sequences").where(stats.finite("value")).groupBy("doc_id", "seq_name", "idx").agg(F.max("value").alias("x"))
    b = c.groupBy("seq_name").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).select("seq_name", F.col("q")[0].alias("floor"), F.col("q")[1].alias("ceiling"))
    parts = c.withColumn("part", F.floor(F.col("idx") / 10))
    return in_bands(parts.withColumnRenamed("idx", "member"), b, ["doc_id", "seq_name", "part"], ["seq_name"])


def in_bands(values: DataFrame, bands: DataFrame, keys: list[str], on: list[str], exempt: Column | None = None) -> DataFrame:
    """keys + (members, outside, mean, verdict) of values (keys, x) against bands (on, floor, ceiling); exempt members don't count."""
    v = (values if exempt is None else values.where(~exempt)).join(broadcast_if_small(bands), on)
    out = (F.col("x") < F.col("floor")) | (F.col("x") > F.col("ceiling"))
    g = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), F.count(F.when(out, 1)).alias("outside"), F.avg("x").alias("m"), F.first("floor").alias("floor"), F.first("ceiling").alias("ceiling"))
    r9 = lambda c: F.round(c, 9)
    return g.select(*keys, "members", "outside", r6("m").alias("mean"), F.when(r9("m") < r9("floor"), "below").when(r9("m") > r9("ceiling"), "above").otherwise("inside").alias("verdict"))


@query(
    "report_documents_ranked",
    f"""WITH {COMPARED}, g AS (SELECT doc_id, corpus, count(*) AS findings, count(*) FILTER (outlier) AS flagged, sum(severity) FILTER (outlier) AS total FROM compared GROUP BY ALL)
SELECT doc_id, corpus, findings, flagged, {_sig_sql('coalesce(total, 0)')} AS severity, row_number() OVER (PARTITION BY corpus ORDER BY round(coalesce(total, 0), 6) DESC, doc_id) AS place FROM g""",
)
def report_documents_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged findings and their severities by document, ranked within the corpus: by slices of the severity, so no corpus is sorted in one task."""
    c = compared(spark, sf_dir)
    out = F.coalesce("outlier", F.lit(False))
    g = c.groupBy("doc_id", "corpus").agg(F.count(F.lit(1)).alias("findings"), F.sum(out.cast("int")).alias("flagged"), F.coalesce(F.sum(F.when(out, F.col("severity"))), F.lit(0.0)).alias("total"))
    g = g.withColumn("down", -F.round("total", 6))
    upto = cumulative(g, ["corpus"], "down", {"k": F.lit(1)}).select("corpus", "down", (F.col("upto_k") - F.col("k")).alias("before"))
    j = g.join(upto, ["corpus", "down"])
    place = F.col("before") + F.row_number().over(Window.partitionBy("corpus", "down").orderBy("doc_id"))
    return j.select("doc_id", "corpus", "findings", "flagged", sig("total").alias("severity"), place.alias("place"))


@query(
    "distance_ranks",
    f"""WITH {LATEST}, {STATS_SQL}, u AS (SELECT corpus, metric_id, value, 1 AS f, 0 AS g FROM latest WHERE value IS NOT NULL AND isfinite(value) AND corpus IS NOT NULL UNION ALL SELECT profile, metric_id, value, 0, 1 FROM cd),
v AS (SELECT corpus, metric_id, value, sum(f) AS f, sum(g) AS g FROM u GROUP BY ALL), c AS (SELECT *, sum(f) OVER w AS uf, sum(g) OVER w AS ug, sum(f) OVER p AS nf, sum(g) OVER p AS ng FROM v WINDOW w AS (PARTITION BY corpus, metric_id ORDER BY value), p AS (PARTITION BY corpus, metric_id)),
k AS (SELECT *, (nf + ng)::DOUBLE AS n, (f + g)::DOUBLE AS t, (uf + ug)::DOUBLE AS h FROM c WHERE nf > 0 AND ng > 0)
SELECT corpus, metric_id, {_sig_sql('any_value(nf * ng / (n * n)) * sum(t * pow(uf / nf::DOUBLE - ug / ng::DOUBLE, 2))')} AS cramer_von_mises,
CASE WHEN count(*) >= 5 THEN {_sig_sql('any_value(nf * ng / n) * sum(CASE WHEN h < n THEN t / n * pow(uf / nf::DOUBLE - ug / ng::DOUBLE, 2) / (h / n * (1 - h / n)) ELSE 0 END)')} END AS anderson_darling FROM k GROUP BY ALL""",
)
def distance_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cramer-von Mises and Anderson-Darling statistics of each metric's findings and its corpus, from counts by value."""
    f = latest_findings(table(spark, sf_dir, "findings")).where(stats.finite("value") & F.col("corpus").isNotNull()).select(*KEYS, "value", F.lit(1).alias("f"), F.lit(0).alias("g"))
    g = table(spark, sf_dir, "corpus_dist").where(stats.finite("value")).select(F.col("profile").alias("corpus"), "metric_id", "value", F.lit(0).alias("f"), F.lit(1).alias("g"))
    return rank_distances(f.unionByName(g))


def rank_distances(u: DataFrame) -> DataFrame:
    """From rows (corpus, metric_id, value, f, g) with a 1 in the column of their sample."""
    u = u.groupBy(*KEYS, "value").agg(F.sum("f").alias("f"), F.sum("g").alias("g"))
    t = u.groupBy(*KEYS).agg(F.sum("f").cast("double").alias("nf"), F.sum("g").cast("double").alias("ng")).where("nf > 0 and ng > 0")
    c = cumulative(u, KEYS, "value", {"f": F.col("f"), "g": F.col("g")}).join(t, KEYS)
    n, h = F.col("nf") + F.col("ng"), (F.col("upto_f") + F.col("upto_g")).cast("double")
    gap2, ties = F.pow(F.col("upto_f") / F.col("nf") - F.col("upto_g") / F.col("ng"), F.lit(2.0)), (F.col("f") + F.col("g")).cast("double")
    s = c.groupBy(*KEYS, "nf", "ng").agg(F.count(F.lit(1)).alias("kinds"), F.sum(ties * gap2).alias("cvm"), F.sum(F.when(h < n, ties / n * gap2 / (h / n * (1 - h / n))).otherwise(0.0)).alias("ad"))
    n = F.col("nf") + F.col("ng")
    return s.select(*KEYS, sig(F.col("nf") * F.col("ng") / (n * n) * F.col("cvm")).alias("cramer_von_mises"), sig(F.when(F.col("kinds") >= 5, F.col("nf") * F.col("ng") / n * F.col("ad"))).alias("anderson_darling"))


@query(
    "distance_quantiles",
    f"""WITH {LATEST}, {STATS_SQL}, f AS (SELECT corpus, metric_id, quantile_cont(value, [{_CURVES}]) AS a FROM latest WHERE value IS NOT NULL AND isfinite(value) AND corpus IS NOT NULL GROUP BY ALL), g AS (SELECT profile AS corpus, metric_id, quantile_cont(value, [{_CURVES}]) AS b FROM cd GROUP BY ALL)
SELECT corpus, metric_id, {_sig_sql('sqrt(list_sum(list_transform(range(1, 102), lambda i: pow(a[i] - b[i], 2))))')} AS quantile_vector, {_sig_sql('list_sum(list_transform(range(1, 12), lambda i: abs(a[i] - b[i]))) / 11')} AS tail_lower,
{_sig_sql('list_sum(list_transform(range(91, 102), lambda i: abs(a[i] - b[i]))) / 11')} AS tail_upper, {_sig_sql('list_sum(list_transform(range(1, 102), lambda i: pow(a[i] - b[i], 2))) / 101')} AS optimal_transport FROM f JOIN g USING (corpus, metric_id)""",
)
def distance_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the quantile curves of each metric's findings and its corpus: as vectors, in the outer tenths, and as transport."""
    f = latest_findings(table(spark, sf_dir, "findings")).where(stats.finite("value") & F.col("corpus").isNotNull()).groupBy(*KEYS).agg(curve("value").alias("a"))
    g = table(spark, sf_dir, "corpus_dist").where(stats.finite("value")).groupBy(F.col("profile").alias("corpus"), "metric_id").agg(curve("value").alias("b"))
    j = f.join(g, KEYS)
    part = lambda c, start: F.slice(c, start, 11)
    mean = lambda p: curve_distance(F.col("a"), F.col("b"), p)
    return j.select(
        *KEYS, sig(F.sqrt(mean(2) * 101)).alias("quantile_vector"), sig(curve_distance(part("a", 1), part("b", 1))).alias("tail_lower"), sig(curve_distance(part("a", 91), part("b", 91))).alias("tail_upper"), sig(mean(2)).alias("optimal_transport")
    )


