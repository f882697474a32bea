"""Style measurements over tokens and sentences: repetition, openings, function words, punctuation, discourse markers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.functions import text as T
from proselake.functions.grams import numbered, per_row, run_counts
from proselake.operators.core_metrics import arrays, count_if, mean
from proselake.operators.core_metrics import held as plain
from proselake.operators.views import BODY, QUOTED_SQL, SENT, TOK, WORD_SQL, bodies, docs, tokens
from proselake.plans.registry import query, r6

# Word lists of the style measurements.
FUNCTION_WORDS = (
    "a an and are as at be been but by for from had has have he her him his i if in is it its me my nor not of on or our she so than that the their them then "
    "there they this to us was we were what when which who will with you your"
).split()
COMMON = "the a an and or but of to in on for with is was it he she they i you".split()
PRONOUNS = {
    "first": "i me my mine we us our ours".split(),
    "second": "you your yours".split(),
    "third": "he him his she her hers they them their theirs".split(),
}
CONNECTIVES = (
    "however indeed moreover furthermore ultimately nevertheless nonetheless additionally consequently therefore thus hence meanwhile instead overall similarly "
    "conversely regardless"
).split() + ["in fact", "in addition", "that said"]
CAUSAL = ["because", "therefore", "hence", "thus", "consequently", "since", "so that", "which meant", "in other words", "that is why", "as a result", "due to", "owing to"]
HEDGES = ["perhaps", "maybe", "seemed", "appeared", "somewhat", "rather", "fairly", "apparently", "presumably", "arguably", "possibly", "sort of", "kind of", "i think", "i guess"]
BOOSTERS = ["clearly", "obviously", "certainly", "definitely", "undoubtedly", "absolutely", "of course", "indeed", "truly", "always", "never", "every", "completely"]
MODALS = "must should could would might may can shall ought".split()
ABSOLUTE = "all every always never none nobody everybody everyone everything nothing entirely solely invariably universally".split()
NEGATION = "not never no none nobody nothing nowhere neither nor without".split()


def lits(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def sql_list(xs: list[str]) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


def count_words(toks: Column, xs: list[str]) -> Column:
    return count_if(toks, lambda t: t.isin(xs))


def count_phrases(toks: Column, joined: Column, phrases: list[str]) -> Column:
    """Occurrences of one- to three-word phrases. joined: the tokens with two spaces before, between and after them."""
    out = count_words(toks, [p for p in phrases if " " not in p])
    for p in phrases:
        if " " in p:
            spaced = " " + p.replace(" ", "  ") + " "
            out = out + (F.length(joined) - F.length(F.replace(joined, F.lit(spaced), F.lit("")))) / F.lit(len(spaced))
    return out


_LISTS = f"""WITH {TOK}, a AS (SELECT doc_id, body, regexp_extract_all(body, '{WORD_SQL}') AS ws FROM b),
t AS (SELECT doc_id, body, ws, list_transform(ws, lambda x: replace(lower(x), '’', '''')) AS toks, len(ws) AS w FROM a WHERE len(ws) > 0),
j AS (SELECT *, '  ' || array_to_string(toks, '  ') || '  ' AS joined FROM t)"""


def _words_sql(xs: list[str]) -> str:
    return f"len(list_filter(toks, lambda x: x IN {sql_list(xs)}))"


def _phrases_sql(xs: list[str]) -> str:
    out = _words_sql([x for x in xs if " " not in x])
    return " + ".join([out, *(f"len(regexp_extract_all(joined, ' {x.replace(' ', '  ')} '))" for x in xs if " " in x)])


@query(
    "style_markers",
    _LISTS
    + "SELECT doc_id, w AS n_words, "
    + ", ".join(f"round(1000.0 * ({_phrases_sql(v)}) / w, 6) AS {k}_rate" for k, v in (("causal", CAUSAL), ("hedge", HEDGES), ("booster", BOOSTERS), ("modal", MODALS), ("absolute", ABSOLUTE), ("negation", NEGATION)))
    + " FROM j",
)
def style_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causal markers, hedges, boosters, modals, absolutes and negations per thousand words."""
    a = arrays(docs(spark, sf_dir), want="toks").select("doc_id", "toks").where(F.size("toks") > 0)
    a = plain(a.withColumn("joined", F.concat(F.lit("  "), F.array_join("toks", "  "), F.lit("  "))))
    n = F.size("toks")
    rates = {"causal": CAUSAL, "hedge": HEDGES, "booster": BOOSTERS, "modal": MODALS, "absolute": ABSOLUTE, "negation": NEGATION}
    return a.select("doc_id", n.cast("bigint").alias("n_words"), *(r6(1000.0 * count_phrases(F.col("toks"), F.col("joined"), v) / n).alias(f"{k}_rate") for k, v in rates.items()))


@query("style_pronouns", _LISTS + "SELECT doc_id, " + ", ".join(f"round(1000.0 * {_words_sql(v)} / w, 6) AS {k}_rate" for k, v in PRONOUNS.items()) + " FROM t")
def style_pronouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pronouns of each person per thousand words."""
    a = arrays(docs(spark, sf_dir), want="toks").select("doc_id", "toks").where(F.size("toks") > 0)
    return a.select("doc_id", *(r6(1000.0 * count_words(F.col("toks"), v) / F.size("toks")).alias(f"{k}_rate") for k, v in PRONOUNS.items()))


@query(
    "style_pov_drift",
    f"""WITH {BODY}, wl AS (SELECT doc_id, source, regexp_extract_all(regexp_replace(body, '{QUOTED_SQL}', '', 'g'), '{WORD_SQL}') AS ws FROM b),
tok AS (SELECT doc_id, unnest(range(len(ws))) AS i, replace(lower(unnest(ws)), '’', '''') AS token FROM wl), g AS (SELECT doc_id, i // 500 AS blk, CASE WHEN token IN {sql_list(PRONOUNS['first'])} THEN 0 WHEN token IN {sql_list(PRONOUNS['second'])} THEN 1 WHEN token IN {sql_list(PRONOUNS['third'])} THEN 2 END AS pov FROM tok),
c AS (SELECT doc_id, blk, pov, count(*) AS n FROM g WHERE pov IS NOT NULL GROUP BY ALL),
m AS (SELECT doc_id, blk, pov FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, blk ORDER BY n DESC, pov) = 1),
l AS (SELECT doc_id, blk, pov, lag(pov) OVER (PARTITION BY doc_id ORDER BY blk) AS before FROM m)
SELECT doc_id, count(*) AS blocks, CAST(sum(CASE WHEN pov <> before THEN 1 ELSE 0 END) AS BIGINT) AS drift,
 round(100.0 * sum(CASE WHEN pov <> before THEN 1 ELSE 0 END) / count(*), 6) AS drift_rate FROM l GROUP BY doc_id""",
)
def style_pov_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the dominant person between blocks of 500 words of narration with evidence, and per hundred such blocks."""
    pov = None
    for k, v in enumerate(PRONOUNS.values()):
        pov = F.when(F.col("token").isin(v), k) if pov is None else pov.when(F.col("token").isin(v), k)
    told = bodies(docs(spark, sf_dir)).select("doc_id", F.posexplode(T.tokens(T.narration(F.col("body")))).alias("i", "token"))
    c = told.select("doc_id", F.floor(F.col("i") / 500).alias("blk"), pov.alias("pov")).where("pov is not null").groupBy("doc_id", "blk", "pov").agg(F.count(F.lit(1)).alias("n"))
    m = c.groupBy("doc_id", "blk").agg(F.max_by("pov", F.struct("n", -F.col("pov"))).alias("pov"))
    x = m.withColumn("before", F.lag("pov").over(Window.partitionBy("doc_id").orderBy("blk")))
    drift = F.sum(F.when(F.col("pov") != F.col("before"), 1).otherwise(0))
    blocks = F.count(F.lit(1))
    return x.groupBy("doc_id").agg(blocks.alias("blocks"), drift.alias("drift"), r6(100.0 * drift / blocks).alias("drift_rate"))


@query(
    "style_ngram_repeats",
    f"""WITH {TOK}, k AS (SELECT unnest([3, 4, 5, 6]) AS n),
l AS (SELECT doc_id, ws, list_transform(ws, lambda x: replace(lower(x), '’', '''')) AS t FROM wl),
g AS (SELECT doc_id, n, len(t) AS toks, unnest(list_transform(range(greatest(len(t) - n + 1, 0)), lambda i: array_to_string(t[i + 1 : i + n], ' '))) AS gram FROM l, k),
c AS (SELECT doc_id, n, toks, gram, count(*) AS c FROM g GROUP BY ALL)
SELECT doc_id, CAST(n AS INTEGER) AS n, count(*) AS repeated, round(10000.0 * sum(c - 1) / any_value(toks), 6) AS excess_rate, round(10000.0 * max(c) / any_value(toks), 6) AS max_rate
FROM c WHERE c >= 2 GROUP BY doc_id, n""",
)
def style_ngram_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs of three to six words: kinds, excess and commonest, per ten thousand words. Counted within the row."""
    a = arrays(docs(spark, sf_dir), want="toks").select("doc_id", "toks")

    def of(toks: list[str]) -> list[tuple]:
        ids, out = numbered(toks), []
        for n in (3, 4, 5, 6):
            c = run_counts(ids, n)
            c = c[c >= 2]
            if len(c):
                out.append((n, len(c), 10000.0 * float((c - 1).sum()) / len(ids), 10000.0 * float(c.max()) / len(ids)))
        return out

    return per_row(a, of, "n int, repeated bigint, excess_rate double, max_rate double").select("doc_id", "n", "repeated", r6("excess_rate").alias("excess_rate"), r6("max_rate").alias("max_rate"))


OPEN_SQL = f"""WITH {SENT}, o AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(sentence, '{WORD_SQL}')[1:3], lambda x: replace(lower(x), '’', '''')), ' ') AS opening FROM sent),
c AS (SELECT doc_id, opening, count(*) AS c FROM o GROUP BY ALL), n AS (SELECT doc_id, sum(c) AS n FROM c GROUP BY doc_id)
SELECT doc_id, round(100.0 * sum(CASE WHEN c > 1 THEN c ELSE 0 END) / any_value(n), 6) AS repetition, round(-sum(c / n * log2(c / n)) + 0.0, 6) AS entropy FROM c JOIN n USING (doc_id) GROUP BY doc_id"""


@query("style_sentence_openings", OPEN_SQL)
def style_sentence_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of sentences whose first three words open another too, and the entropy of openings in bits."""
    a = arrays(docs(spark, sf_dir), want="ss").select("doc_id", F.explode(F.transform("ss", lambda s: F.array_join(F.slice(T.tokens(s), 1, 3), " "))).alias("opening"))
    c = a.groupBy("doc_id", "opening").agg(F.count(F.lit(1)).alias("c")).withColumn("n", F.sum("c").over(Window.partitionBy("doc_id")))
    p = F.col("c") / F.col("n")
    return c.groupBy("doc_id").agg(r6(100.0 * F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.first("n")).alias("repetition"), r6(-F.sum(p * F.log2(p))).alias("entropy"))


@query(
    "style_connective_openings",
    f"""WITH {SENT}, o AS (SELECT doc_id, list_transform(regexp_extract_all(sentence, '{WORD_SQL}')[1:2], lambda x: replace(lower(x), '’', '''')) AS f FROM sent),
m AS (SELECT doc_id, CASE WHEN f[1] IN {sql_list([c for c in CONNECTIVES if ' ' not in c])} THEN f[1] WHEN f[1] || ' ' || f[2] IN {sql_list([c for c in CONNECTIVES if ' ' in c])} THEN f[1] || ' ' || f[2] END AS c FROM o)
SELECT doc_id, count(*) AS n_sentences, round(100.0 * count(c) / count(*), 6) AS connective_rate, count(DISTINCT c) AS kinds FROM m GROUP BY doc_id""",
)
def style_connective_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that open on a connective, per hundred."""
    one, two = lits([c for c in CONNECTIVES if " " not in c]), lits([c for c in CONNECTIVES if " " in c])
    a = arrays(docs(spark, sf_dir), want="ss").select("doc_id", F.transform("ss", lambda s: F.slice(T.tokens(s), 1, 2)).alias("fs")).where(F.size("fs") > 0)
    pair = lambda f: F.array_join(f, " ")
    hits = F.filter(F.transform("fs", lambda f: F.when(F.array_contains(one, F.get(f, 0)), F.get(f, 0)).when(F.array_contains(two, pair(f)), pair(f))), lambda x: x.isNotNull())
    n = F.size("fs")
    return a.select("doc_id", n.cast("bigint").alias("n_sentences"), r6(100.0 * F.size(hits) / n).alias("connective_rate"), F.size(F.array_distinct(hits)).cast("bigint").alias("kinds"))


@query(
    "style_local_repetition",
    f"""WITH {TOK}, g AS (SELECT doc_id, i - lag(i) OVER (PARTITION BY doc_id, token ORDER BY i) AS gap FROM tok WHERE length(token) > 3 AND token NOT IN {sql_list(COMMON)}),
n AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id)
SELECT doc_id, round(list_avg([100.0 * sum(CASE WHEN gap <= 50 THEN 1 ELSE 0 END) / any_value(n), 100.0 * sum(CASE WHEN gap <= 100 THEN 1 ELSE 0 END) / any_value(n), 100.0 * sum(CASE WHEN gap <= 250 THEN 1 ELSE 0 END) / any_value(n)]), 6) AS repetition, round(quantile_cont(gap, 0.5), 6) AS median_gap
FROM g JOIN n USING (doc_id) GROUP BY doc_id""",
)
def style_local_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How soon content words come again: mean share within 50, 100 and 250 words, and the median gap. Counted within the row."""
    a = arrays(docs(spark, sf_dir), want="toks").select("doc_id", "toks").where(F.size("toks") > 0)
    g = a.mapInArrow(_gaps, "doc_id bigint, n bigint, w50 bigint, w100 bigint, w250 bigint, median double")
    share = lambda w: 100.0 * F.col(f"w{w}") / F.col("n")
    return g.select("doc_id", r6((share(50) + share(100) + share(250)) / 3).alias("repetition"), r6("median").alias("median_gap"))


def _gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, toks): doc_id + words, content words that stood at most 50, 100 and 250 words before, and the median gap
    (null if none comes again), for texts with content words; the texts of a batch are counted together."""
    common = pa.array(COMMON)
    for batch in batches:
        for b in (batch.slice(k, 1024) for k in range(0, batch.num_rows, 1024)):
            at = b.column(1).offsets.to_numpy().astype(np.int64)
            toks = b.column(1).values.slice(at[0], at[-1] - at[0])
            n = np.diff(at)
            kept = np.flatnonzero(pc.and_(pc.greater(pc.utf8_length(toks), 3), pc.invert(pc.is_in(toks, common))).to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(len(n)), n)[kept]
            # a number for each word of each text; the stable sort keeps a word's places in order
            kinds = pc.dictionary_encode(toks.take(pa.array(kept)))
            key = row * max(len(kinds.dictionary), 1) + kinds.indices.to_numpy().astype(np.int64)
            by = np.argsort(key, kind="stable")
            again = np.diff(key[by]) == 0
            gap, of = np.diff(kept[by])[again], row[by][1:][again]
            c = np.bincount(of, minlength=len(n))
            ends = np.cumsum(c)
            gap = gap[np.lexsort((gap, of))]
            has = np.flatnonzero(c)
            median = np.full(len(n), np.nan)
            median[has] = (gap[ends[has] - c[has] + (c[has] - 1) // 2] + gap[ends[has] - c[has] + c[has] // 2]) / 2
            within = [np.bincount(of[gap <= w], minlength=len(n)) for w in (50, 100, 250)]
            some = np.unique(row)  # texts with content words
            cols = [b.column(0).take(pa.array(some)), *(pa.array(x[some].astype(np.int64)) for x in (n, *within)), pa.array(median[some], from_pandas=True)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "w50", "w100", "w250", "median"])


@query(
    "style_mattr",
    f"""WITH {TOK}, l AS (SELECT doc_id, list(token ORDER BY i) AS t FROM tok GROUP BY doc_id),
w AS (SELECT doc_id, CASE WHEN len(t) <= 100 THEN [len(list_distinct(t)) / len(t)] ELSE list_transform(range(len(t) - 99), lambda k: len(list_distinct(t[k + 1 : k + 100])) / 100) END AS r FROM l)
SELECT doc_id, round(100 * list_avg(r), 9) AS mattr FROM w""",
)
def style_mattr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean type-token ratio of sliding windows of a hundred words, by counting for each word the windows that it opens a type in."""
    t = tokens(docs(spark, sf_dir)).select("doc_id", "i", "token")
    t = t.withColumn("p", F.lag("i").over(Window.partitionBy("doc_id", "token").orderBy("i"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    w = F.least(F.lit(100), F.col("n"))
    # windows start at 0 .. n - w; the word counts where it stands in the window and its last occurrence doesn't
    windows = F.greatest(F.lit(0), F.least("i", F.col("n") - w) - F.greatest(F.coalesce(F.col("p") + 1, F.lit(0)), F.col("i") - w + 1, F.lit(0)) + 1)
    return t.groupBy("doc_id").agg(F.round(100.0 * F.sum(windows) / F.first((F.col("n") - w + 1) * w), 9).alias("mattr"))


def _marks_sql() -> str:
    from proselake.functions.text import MARKS, MARKS_ANY

    esc = lambda p: p.replace("'", "''")
    case = " ".join(f"WHEN regexp_full_match(m, '{esc(p)}') THEN '{n}'" for n, p in MARKS.items())
    return f"m0 AS (SELECT doc_id, unnest(regexp_extract_all(body, '{esc(MARKS_ANY)}')) AS m FROM b), mk AS (SELECT doc_id, CASE {case} END AS mark FROM m0)"


@query(
    "style_punctuation_profile",
    f"""WITH {TOK}, {_marks_sql()}, n AS (SELECT doc_id, count(*) AS w FROM tok GROUP BY doc_id)
SELECT doc_id, mark, count(*) AS n, round(1000.0 * count(*) / any_value(w), 6) AS per_1000_words FROM mk JOIN n USING (doc_id) GROUP BY doc_id, mark""",
)
def style_punctuation_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of mark, counted and per thousand words."""
    a = arrays(docs(spark, sf_dir), want="ws").select("doc_id", "body", F.size("ws").alias("w")).where("w > 0")
    # counted as they are spelled, then named: each spelling of a document is classified once
    m = a.select("doc_id", "w", F.explode(F.regexp_extract_all("body", F.lit(T.MARKS_ANY), F.lit(0))).alias("m")).groupBy("doc_id", "w", "m").agg(F.count(F.lit(1)).alias("c"))
    return m.groupBy("doc_id", "w", T.mark_name(F.col("m")).alias("mark")).agg(F.sum("c").alias("n")).select("doc_id", "mark", "n", r6(1000.0 * F.col("n") / F.col("w")).alias("per_1000_words"))


@query(
    "style_punctuation_entropy",
    f"""WITH {TOK}, {_marks_sql()}, c AS (SELECT doc_id, mark, count(*) AS c, sum(count(*)) OVER (PARTITION BY doc_id) AS n FROM mk GROUP BY doc_id, mark)
SELECT doc_id, round(-sum(c / n * log2(c / n)) + 0.0, 6) AS mark_entropy, round(CASE WHEN count(*) > 1 THEN -sum(c / n * log2(c / n)) / log2(count(*)) ELSE 0 END + 0.0, 6) AS normalized, round(100.0 * max(c) / any_value(n), 6) AS top_mark_share FROM c GROUP BY doc_id""",
)
def style_punctuation_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = arrays(docs(spark, sf_dir), want="").select("doc_id", F.explode(F.regexp_extract_all("body", F.lit(T.MARKS_ANY), F.lit(0))).alias("m"))
    c = a.groupBy("doc_id", "m").agg(F.count(F.lit(1)).alias("k")).groupBy("doc_id", T.mark_name(F.col("m")).alias("mark")).agg(F.sum("k").alias("c")).withColumn("n", F.sum("c").over(Window.partitionBy("doc_id")))
    p = F.col("c") / F.col("n")
    h = -F.sum(p * F.log2(p))
    return c.groupBy("doc_id").agg(r6(h).alias("mark_entropy"), r6(F.when(F.count(F.lit(1)) > 1, h / F.log2(F.count(F.lit(1)))).otherwise(0.0)).alias("normalized"), r6(100.0 * F.max("c") / F.first("n")).alias("top_mark_share"))


@query(
    "style_function_word_delta",
    f"""WITH {TOK}, n AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id HAVING count(*) >= 200), v AS (SELECT unnest({[*FUNCTION_WORDS]}) AS token),
r AS (SELECT n.doc_id, v.token, 1000.0 * count(tok.token) / any_value(n.n) AS rate FROM n CROSS JOIN v LEFT JOIN tok ON tok.doc_id = n.doc_id AND tok.token = v.token GROUP BY n.doc_id, v.token),
s AS (SELECT token, avg(rate) AS m, stddev_pop(rate) AS sd FROM r GROUP BY token),
d AS (SELECT doc_id, round(avg(abs(rate - m) / sd), 6) AS delta FROM r JOIN s USING (token) WHERE sd > 1e-12 GROUP BY doc_id), w AS (SELECT doc_id, count(*) AS n_words FROM tok GROUP BY doc_id)
SELECT doc_id, n_words, delta, CASE WHEN n_words < 200 THEN 'fewer than 200 words' END AS warning FROM w LEFT JOIN d USING (doc_id)""",
)
def style_function_word_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burrows's Delta of each document against the corpus: mean absolute z of function-word rates. Documents of fewer than
    200 words have none, with a warning, and don't enter the corpus' rates."""
    d = docs(spark, sf_dir)
    n = arrays(d, want="toks").select("doc_id", F.size("toks").cast("bigint").alias("n_words")).where("n_words > 0")
    delta = function_word_z(d).groupBy("doc_id").agg(r6(F.avg(F.abs("z"))).alias("delta"))
    return n.join(delta, "doc_id", "left").withColumn("warning", F.when(F.col("n_words") < 200, "fewer than 200 words"))


def function_word_rates(documents: DataFrame, *more: str, least: int = 200) -> DataFrame:
    """(doc_id, more, token, rate): per thousand words, for each function word, of documents with enough words."""
    a = arrays(documents, *more, want="toks").select("doc_id", *more, "toks").where(F.size("toks") >= least)
    held = lits(FUNCTION_WORDS)
    # every word once more than it stands there, so that words that don't occur have a row as well
    kept = F.concat(F.filter("toks", lambda t: t.isin(FUNCTION_WORDS)), held)
    a = a.select("doc_id", *more, F.size("toks").alias("n"), F.explode(kept).alias("token"))
    return a.groupBy("doc_id", *more, "n", "token").agg(F.count(F.lit(1)).alias("c")).select("doc_id", *more, "token", (1000.0 * (F.col("c") - 1) / F.col("n")).alias("rate"))


def function_word_z(documents: DataFrame, *more: str) -> DataFrame:
    """(doc_id, more, token, rate, z): standardised over the corpus; words without spread are left out. The statistics are one row a word."""
    r = function_word_rates(documents, *more)
    s = r.groupBy("token").agg(F.avg("rate").alias("m"), F.stddev_pop("rate").alias("sd")).where("sd > 1e-12")
    return r.join(F.broadcast(s), "token").select("doc_id", *more, "token", "rate", ((F.col("rate") - F.col("m")) / F.col("sd")).alias("z"))


@query(
    "style_constructions",
    f"""WITH {SENT}, k AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(sentence, '[A-Za-z]+|''[A-Za-z]+|[^\\sA-Za-z0-9'']'), lambda x: CASE WHEN lower(x) IN {sql_list(FUNCTION_WORDS)} THEN lower(x) WHEN regexp_matches(x, '^''?[A-Za-z]') THEN '_' ELSE x END), ' ') AS skeleton FROM sent),
c AS (SELECT doc_id, skeleton, count(*) AS c, sum(count(*)) OVER (PARTITION BY doc_id) AS n FROM k GROUP BY doc_id, skeleton)
SELECT doc_id, round(100.0 * sum(CASE WHEN c >= 3 THEN c ELSE 0 END) / any_value(n), 6) AS repeated_share, round(-sum(c / n * log2(c / n)) + 0.0, 6) AS entropy, max(c) AS top_count FROM c GROUP BY doc_id""",
)
def style_constructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence skeletons (function words and marks kept, other words blank) that recur three times or more."""
    held = lits(FUNCTION_WORDS)
    parts = lambda s: F.regexp_extract_all(s, F.lit(r"[A-Za-z]+|'[A-Za-z]+|[^\sA-Za-z0-9']"), F.lit(0))
    skeleton = lambda s: F.array_join(F.transform(parts(s), lambda x: F.when(F.array_contains(held, F.lower(x)), F.lower(x)).when(x.rlike("^'?[A-Za-z]"), "_").otherwise(x)), " ")
    k = arrays(docs(spark, sf_dir), want="ss").select("doc_id", F.explode(F.transform("ss", skeleton)).alias("skeleton"))
    c = k.groupBy("doc_id", F.xxhash64("skeleton").alias("h")).agg(F.count(F.lit(1)).alias("c")).withColumn("n", F.sum("c").over(Window.partitionBy("doc_id")))
    p = F.col("c") / F.col("n")
    return c.groupBy("doc_id").agg(r6(100.0 * F.sum(F.when(F.col("c") >= 3, F.col("c")).otherwise(0)) / F.first("n")).alias("repeated_share"), r6(-F.sum(p * F.log2(p))).alias("entropy"), F.max("c").alias("top_count"))


@query(
    "style_channels",
    f"""WITH {TOK}, c AS (SELECT doc_id, unnest(['dialogue', 'narration']) AS channel, unnest([array_to_string(regexp_extract_all(body, '{QUOTED_SQL}'), chr(10)), regexp_replace(body, '{QUOTED_SQL}', '', 'g')]) AS t FROM b),
w AS (SELECT doc_id, channel, t, regexp_extract_all(t, '{WORD_SQL}') AS ws FROM c)
SELECT doc_id, channel, len(ws) AS n_words, round(list_avg(list_transform(ws, lambda x: length(x))), 6) AS word_length, round(1000.0 * (length(t) - length(regexp_replace(t, '[!?]', '', 'g'))) / len(ws), 6) AS emphatic_rate FROM w WHERE len(ws) > 0""",
)
def style_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue and narration apart: words, word length, question and exclamation marks."""
    a = arrays(docs(spark, sf_dir), want="").select("doc_id", "body")
    c = a.select("doc_id", F.inline(F.array(F.struct(F.lit("dialogue").alias("channel"), F.array_join(F.regexp_extract_all("body", F.lit(T.QUOTED), F.lit(0)), "\n").alias("t")), F.struct(F.lit("narration").alias("channel"), T.narration(F.col("body")).alias("t")))))
    c = c.withColumn("ws", T.words(F.col("t"))).where(F.size("ws") > 0)
    n = F.size("ws")
    return c.select("doc_id", "channel", n.cast("bigint").alias("n_words"), r6(mean(F.transform("ws", lambda x: F.length(x).cast("double")))).alias("word_length"), r6(1000.0 * (F.length("t") - F.length(F.regexp_replace("t", "[!?]", ""))) / n).alias("emphatic_rate"))
