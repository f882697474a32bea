"""Documents against whole profiles: fit, nearest profile, tail scores, sections, windows and other multi-part measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.functions import ordered, stats
from proselake.functions import text as T
from proselake.operators.compare import COMPARED, LATEST, STATS_SQL, compared, corpus_stats, latest_findings
from proselake.operators.core_metrics import arrays, held
from proselake.operators.views import bodies, docs
from proselake.plans.registry import query, r6
from proselake.session import broadcast_if_small, table

_Z = f"""WITH {LATEST}, {STATS_SQL}, d AS (SELECT doc_id, metric_id, quantile_cont(value, 0.5) AS v FROM latest WHERE value IS NOT NULL AND isfinite(value) AND channel = 'full' GROUP BY ALL),
z AS (SELECT doc_id, profile, metric_id, least(10, abs(v - median) / (1.4826 * mad)) AS z FROM d JOIN cs USING (metric_id) WHERE mad > 0)"""


def robust_z(findings: DataFrame, dist: DataFrame) -> DataFrame:
    """(doc_id, profile, metric_id, z): absolute robust distance of each document's median value of a metric (full text) from every profile, 10 at most."""
    d = latest_findings(findings).where(stats.finite("value") & (F.col("channel") == "full")).groupBy("doc_id", "metric_id").agg(F.percentile("value", F.lit(0.5)).alias("v"))
    s = broadcast_if_small(corpus_stats(dist).where("mad > 0").select("profile", "metric_id", "median", "mad"), 20_000)
    return d.join(s, "metric_id").select("doc_id", "profile", "metric_id", F.least(F.lit(10.0), F.abs(F.col("v") - F.col("median")) / (1.4826 * F.col("mad"))).alias("z"))


@query("reference_fit", _Z + " SELECT doc_id, profile, count(*) AS metrics, round(avg(z), 6) AS mean_abs_z, round(sqrt(avg(z * z)), 6) AS rms_z, round(quantile_cont(z, 0.5), 6) AS median_abs_z FROM z GROUP BY ALL")
def reference_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each document lies from each profile over its metrics."""
    z = robust_z(table(spark, sf_dir, "findings"), table(spark, sf_dir, "corpus_dist"))
    return z.groupBy("doc_id", "profile").agg(F.count(F.lit(1)).alias("metrics"), r6(F.avg("z")).alias("mean_abs_z"), r6(F.sqrt(F.avg(F.col("z") * F.col("z")))).alias("rms_z"), r6(F.percentile("z", F.lit(0.5))).alias("median_abs_z"))


@query(
    "reference_nearest",
    _Z
    + """, f AS (SELECT doc_id, profile, round(avg(z), 6) AS m FROM z GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY m, profile) AS k, lead(m) OVER (PARTITION BY doc_id ORDER BY m, profile) AS nxt FROM f)
SELECT doc_id, profile AS nearest, m AS distance, round(nxt - m, 6) AS margin FROM r WHERE k = 1""",
)
def reference_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest profile of each document, and how much farther the next one is."""
    z = robust_z(table(spark, sf_dir, "findings"), table(spark, sf_dir, "corpus_dist"))
    f = z.groupBy("doc_id", "profile").agg(r6(F.avg("z")).alias("m"))
    g = f.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("m", "profile"))).alias("a"))
    first, second = F.get(F.col("a"), 0), F.get(F.col("a"), 1)
    return g.select("doc_id", first["profile"].alias("nearest"), first["m"].alias("distance"), r6(second["m"] - first["m"]).alias("margin"))


@query(
    "anomaly_tails",
    f"""WITH {COMPARED}, t AS (SELECT doc_id, corpus, metric_id, avg(percentile) AS p, any_value(n) AS n FROM compared GROUP BY ALL)
SELECT doc_id, corpus, count(*) AS metrics, round(sum(-ln(greatest(least(p, 100 - p) / 100, 0.5 / n))), 6) AS tail_score, count(*) FILTER (p > 90 OR p < 10) AS extreme FROM t GROUP BY ALL""",
)
def anomaly_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of negative log tail probabilities of each document's metrics, and the metrics in the outer tenths."""
    t = compared(spark, sf_dir).groupBy("doc_id", "corpus", "metric_id").agg(F.avg("percentile").alias("p"), F.first("n").alias("n"))
    tail = F.greatest(F.least("p", 100 - F.col("p")) / 100, 0.5 / F.col("n"))
    return t.groupBy("doc_id", "corpus").agg(F.count(F.lit(1)).alias("metrics"), r6(F.sum(-F.log(tail))).alias("tail_score"), F.sum(F.when((F.col("p") > 90) | (F.col("p") < 10), 1).otherwise(0)).alias("extreme"))


@query(
    "feature_matrix",
    f"""WITH {LATEST}, d AS (SELECT doc_id, metric_id, quantile_cont(value, 0.5) AS v FROM latest WHERE value IS NOT NULL AND isfinite(value) GROUP BY ALL), n AS (SELECT count(DISTINCT doc_id) AS n FROM d),
c AS (SELECT metric_id, count(*) AS c, quantile_cont(v, 0.5) AS median FROM d GROUP BY metric_id), k AS (SELECT metric_id, median, c FROM c, n WHERE c >= 0.3 * n ORDER BY c DESC, metric_id LIMIT 20), m AS (SELECT d.metric_id, quantile_cont(abs(v - median), 0.5) AS mad FROM d JOIN k USING (metric_id) GROUP BY d.metric_id),
i AS (SELECT DISTINCT doc_id FROM d)
SELECT i.doc_id, k.metric_id, v IS NULL AS imputed, round(CASE WHEN mad > 0 THEN (coalesce(v, median) - median) / (1.4826 * mad) ELSE 0 END, 6) + 0.0 AS z FROM i CROSS JOIN k JOIN m USING (metric_id) LEFT JOIN d ON d.doc_id = i.doc_id AND d.metric_id = k.metric_id""",
)
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised features of each document in long form: the twenty metrics with the widest coverage (the cap is the feature), missing ones at the median."""
    f = latest_findings(table(spark, sf_dir, "findings")).where(stats.finite("value"))
    d = f.groupBy("doc_id", "metric_id").agg(F.percentile("value", F.lit(0.5)).alias("v"))
    n = d.agg(F.countDistinct("doc_id").alias("docs"))
    c = ordered.quantiles(d, ["metric_id"], "v", (0.5,)).select("metric_id", F.col("n").alias("c"), F.col("q")[0].alias("median")).crossJoin(F.broadcast(n)).where("c >= 0.3 * docs")
    k = F.broadcast(c.orderBy(F.desc("c"), "metric_id").limit(20).select("metric_id", "median"))
    off = ordered.quantiles(d.join(k, "metric_id").select("metric_id", F.abs(F.col("v") - F.col("median")).alias("off")), ["metric_id"], "off", (0.5,))
    mad = F.broadcast(off.select("metric_id", F.col("q")[0].alias("mad")).join(k, "metric_id"))
    # each document carries its values as a map, so that every wanted metric is looked up in its row
    docs_ = d.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("metric_id", "v"))).alias("vs"))
    x = docs_.join(mad, how="cross").withColumn("v", F.try_element_at("vs", F.col("metric_id")))
    z = F.when(F.col("mad") > 0, (F.coalesce("v", "median") - F.col("median")) / (1.4826 * F.col("mad"))).otherwise(0.0)
    return x.select("doc_id", "metric_id", F.col("v").isNull().alias("imputed"), r6(z).alias("z"))


SECTION = r"(?m)^[ \t]{0,3}#{1,6}[ \t]+([^\n]*)$|^((?:CHAPTER|BOOK|PART|Chapter|Book|Part)\b[ \t]+\S[^\n]*)$"


@query(
    "view_sections",
    rf"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ' '), '\r\n?', chr(10), 'g'), '{SECTION}', chr(1) || '\1\2' || chr(2), 'g') AS t FROM documents), s AS (SELECT doc_id, string_split(t, chr(1)) AS ss FROM m), e AS (SELECT doc_id, unnest(range(len(ss))) AS k, unnest(ss) AS x FROM s),
h AS (SELECT doc_id, k, CASE WHEN k > 0 THEN string_split(x, chr(2))[1] END AS heading, CASE WHEN k > 0 THEN string_split(x, chr(2))[2] ELSE x END AS body FROM e)
SELECT doc_id, k AS section, heading, length(regexp_replace(body, '^\s+|\s+\z', '', 'g')) AS n_chars FROM h WHERE k > 0 OR regexp_matches(body, '{T.LETTER}')""",
)
def view_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of each text by its headings; a preamble counts if it holds words."""
    s = sections(docs(spark, sf_dir))
    return s.select("doc_id", F.col("section").cast("bigint").alias("section"), "heading", F.length("body").cast("bigint").alias("n_chars"))


def sections(documents: DataFrame) -> DataFrame:
    """(doc_id, section, heading, body)."""
    marked = F.regexp_replace(T.unify_line_ends(F.coalesce("text", F.lit(" "))), SECTION, "\u0001$1$2\u0002")
    s = documents.select("doc_id", F.posexplode(F.split(marked, "\u0001")).alias("section", "x"))
    parts = F.split("x", "\u0002", 2)
    first = F.col("section") == 0
    s = s.select("doc_id", "section", F.when(~first, parts[0]).alias("heading"), T.strip_blank(F.when(first, F.col("x")).otherwise(parts[1])).alias("body"))
    return s.where((F.col("section") > 0) | F.col("body").rlike(T.LETTER))


@query("view_windows")
def view_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of whole paragraphs (greedy packing has state, so without SQL)."""
    return windows(docs(spark, sf_dir))


def windows(documents: DataFrame, size: int = 2000) -> DataFrame:
    """(doc_id, win, n_words, text): paragraphs packed in order until a window holds size words (200 at least); a remainder stays if it has a quarter of that or is alone."""
    size = max(200, size)
    a = arrays(documents, want="ps").select("doc_id", "ps").where(F.size("ps") > 0)
    zero = F.struct(F.array().cast("array<struct<n:int,t:string>>").alias("done"), F.lit(0).alias("n"), F.lit("").alias("t"))

    def step(st, p):
        n = st["n"] + F.size(T.words(p))
        t = F.when(st["t"] == "", p).otherwise(F.concat(st["t"], F.lit("\n\n"), p))
        full = n >= size
        row = F.struct(n.alias("n"), t.alias("t"))
        return F.struct(F.when(full, F.concat(st["done"], F.array(row))).otherwise(st["done"]).alias("done"), F.when(full, 0).otherwise(n).alias("n"), F.when(full, "").otherwise(t).alias("t"))

    rest = lambda st: F.when((st["n"] > 0) & ((F.size(st["done"]) == 0) | (st["n"] >= size // 4)), F.concat(st["done"], F.array(F.struct(st["n"].alias("n"), st["t"].alias("t"))))).otherwise(st["done"])
    w = held(a.select("doc_id", F.aggregate("ps", zero, step, rest).alias("w")))
    return w.select("doc_id", F.posexplode("w").alias("win", "r")).select("doc_id", "win", F.col("r.n").alias("n_words"), F.col("r.t").alias("text"))


@query("lexical_mtld")
def lexical_mtld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical diversity by factors, forwards and backwards (a state machine, so without SQL)."""
    return mtld(docs(spark, sf_dir))


def mtld(documents: DataFrame, threshold: float = 0.72) -> DataFrame:
    """(doc_id, mtld): words for each stretch whose type-token ratio falls to the threshold, of documents of two words or more;
    null where no stretch falls at all in one of the two directions.

    The set of words seen is that of the current stretch only, which is short, so long texts take linear time.
    """
    a = arrays(documents, want="toks").select("doc_id", "toks").where(F.size("toks") >= 2)

    def factors(toks):
        zero = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0).alias("n"), F.lit(0.0).alias("f"))

        def step(st, t):
            seen = F.when(F.array_contains(st["seen"], t), st["seen"]).otherwise(F.concat(st["seen"], F.array(t)))
            n = st["n"] + 1
            full = F.size(seen) / n <= threshold
            return F.struct(F.when(full, F.array().cast("array<string>")).otherwise(seen).alias("seen"), F.when(full, 0).otherwise(n).alias("n"), (st["f"] + F.when(full, 1.0).otherwise(0.0)).alias("f"))

        part = lambda st: st["f"] + F.when(st["n"] > 0, (1 - F.size(st["seen"]) / st["n"]) / (1 - threshold)).otherwise(0.0)
        return F.aggregate(toks, zero, step, part)

    f = held(a.select("doc_id", F.size("toks").alias("n"), factors(F.col("toks")).alias("f"), factors(F.reverse("toks")).alias("b")))
    score = lambda c: F.when(F.col(c) > 0, F.col("n") / F.col(c))
    return f.select("doc_id", r6((score("f") + score("b")) / 2).alias("mtld"))
