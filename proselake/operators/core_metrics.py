"""The measurements always taken: readability, rhythm, vocabulary and syntax proxies, one row a document.

Everything is computed inside the row from its arrays of tokens and sentences, so no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.functions import text as T
from proselake.operators.views import SENT, WORD_SQL, bodies, docs, tokens
from proselake.plans.registry import query, r6

# Word lists and patterns of the core measurements.
SUBORDINATOR = r"(?i)\b(because|although|though|while|whereas|since|unless|until|after|before|if|when|whenever|as|so that|even though|rather than|whether)\b"
RELATIVE = r"(?i)\b(who|whom|whose|which|that)\b"
NEGATIVE = (
    r"(?i)\b(?:doesn't|does not|didn't|did not|don't|do not|isn't|is not|wasn't|was not|aren't|weren't|never)\s+[a-z]"
    r"|\b(?:nobody|no one|nothing|none of them)\b|\bwithout \w+ing\b"
)
#: The same for text in lower case, which spares the engine the folding of each character.
SUBORDINATOR_LOW, RELATIVE_LOW, NEGATIVE_LOW = (p.replace("(?i)", "") for p in (SUBORDINATOR, RELATIVE, NEGATIVE))
FRONTLOAD = r"^[\"']?(?:Because|Since|While|Though|Although|When|Whenever|As|After|Before|If|Once|Until|Unless|Whether|Where)\b[^,.!?]{3,60},"
TOP100 = (
    "the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or an will my one all would there their "
    "what so up out if about who get which go me when make can like time no just him know take people into year your good some could them see other than then "
    "now look only come its over think also back after use two how our work first well way even new want because any these give day most us"
).split()


def pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def count_if(a: Column, f) -> Column:
    return F.size(F.filter(a, f))


def sample_sd(a: Column) -> Column:
    m = mean(a)
    return F.when(F.size(a) > 1, F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / (F.size(a) - 1))).when(F.size(a) == 1, 0.0)


def held(df: DataFrame) -> DataFrame:
    """df behind a generator of one row each: columns computed before it are computed once, and filters on them stay after it."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def arrays(documents: DataFrame, *more: str, want: str = "ws toks ps ss lens") -> DataFrame:
    """(doc_id, more, body, and the wanted arrays of a document: words, tokens, paragraphs, sentences, lengths of sentences)."""
    need = set(want.split())
    b = held(bodies(documents, *more))
    b = b.withColumn("ws", T.words(F.col("body"))) if need & {"ws", "toks"} else b
    b = b.withColumn("ps", T.paragraphs(F.col("body"))) if need & {"ps", "ss", "lens"} else b
    b = held(b)
    b = b.withColumn("toks", F.transform("ws", lambda w: F.translate(F.lower(w), "’", "'"))) if "toks" in need else b
    if need & {"ss", "lens"}:
        b = held(b.withColumn("ss", F.flatten(F.transform("ps", T.sentences_of_paragraph))))
    b = b.withColumn("lens", F.transform("ss", lambda s: F.size(T.words(s)))) if "lens" in need else b
    keep = [c for c in ("ws", "toks", "ps", "ss", "lens") if c in need]
    return held(b.select("doc_id", *more, "body", *keep))


def core_metrics(documents: DataFrame) -> DataFrame:
    """A row for each document with at least one sentence; texts without sentences give none."""
    a = arrays(documents).where(F.size("ss") > 0)
    low = F.lower
    flags = lambda s: F.struct(low(s).rlike(SUBORDINATOR_LOW).alias("sub"), low(s).rlike(RELATIVE_LOW).alias("rel"), low(s).rlike(NEGATIVE_LOW).alias("neg"), s.rlike(FRONTLOAD).alias("front"), F.size(F.regexp_extract_all(low(s), F.lit(r"\band\b"), F.lit(0))).alias("ands"))
    a = held(a.withColumn("fs", F.transform("ss", flags)))
    n, w, p = F.size("ss"), F.size("toks"), F.size("ps")
    marks = F.array_join(F.transform("lens", lambda x: F.when(x < 8, "x").otherwise(".")), "")
    short = F.length(F.array_join(F.regexp_extract_all(marks, F.lit("x{3,}"), F.lit(0)), ""))
    chars = F.aggregate("ws", F.lit(0), lambda s, x: s + F.length(x))
    wins = F.transform(F.sequence(F.lit(0), F.floor(w / 1000).cast("int") - 1), lambda k: F.size(F.array_distinct(F.slice("toks", k * 1000 + 1, 1000))) / F.lit(10.0))
    wps = mean(F.col("lens"))
    sub, rel = (lambda f: f["sub"]), (lambda f: f["rel"])
    c = {
        "ari": 4.71 * chars / w + 0.5 * wps - 21.43,
        "wps": wps,
        "sttr": F.when(w >= 1000, mean(wins)),
        "commas": F.size(F.regexp_extract_all("body", F.lit(","), F.lit(0))) / n,
        "subord": pct(count_if(F.col("fs"), sub), n),
        "relcl": pct(count_if(F.col("fs"), rel), n),
        "simple": pct(count_if(F.col("fs"), lambda f: ~sub(f) & ~rel(f)), n),
        "b2035": pct(count_if(F.col("lens"), lambda x: x.between(20, 35)), n),
        "u10": pct(count_if(F.col("lens"), lambda x: x < 10), n),
        "shortruns": pct(short, n),
        "long7": pct(count_if(F.col("ws"), lambda x: F.length(x) >= 7), w),
        "wlen": chars / w,
        "top100": pct(count_if(F.col("toks"), lambda x: x.isin(TOP100)), w),
        "slcv": 100.0 * sample_sd(F.col("lens")) / wps,
        "wpp": w / p,
        "spp": n / p,
        "front": pct(count_if(F.col("fs"), lambda f: f["front"]), n),
        "and2": pct(count_if(F.col("fs"), lambda f: f["ands"] >= 2), n),
        "andrate": pct(count_if(F.col("toks"), lambda x: x == "and"), w),
        "negative": pct(count_if(F.col("fs"), lambda f: f["neg"]), n),
    }
    return a.select("doc_id", *(r6(v).alias(k) for k, v in c.items()), w.cast("bigint").alias("n_words"), n.cast("bigint").alias("n_sentences"), p.cast("bigint").alias("n_paragraphs"))


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


CORE_SQL = f"""WITH {SENT},
l AS (SELECT doc_id, list(sentence ORDER BY s) AS ss, list(n_words ORDER BY s) AS lens, count(DISTINCT p) AS p FROM sent GROUP BY doc_id),
a AS (SELECT doc_id, body, ss, lens, p, regexp_extract_all(body, '{WORD_SQL}') AS ws, len(ss) AS n FROM l JOIN b USING (doc_id)),
t AS (SELECT *, list_transform(ws, lambda x: replace(lower(x), '’', '''')) AS toks, len(ws) AS w, CAST(list_sum(list_transform(ws, lambda x: length(x))) AS DOUBLE) AS chars,
  list_avg(lens) AS wps, array_to_string(list_transform(lens, lambda x: CASE WHEN x < 8 THEN 'x' ELSE '.' END), '') AS flags FROM a)
SELECT doc_id, round(4.71 * chars / w + 0.5 * wps - 21.43, 6) AS ari, round(wps, 6) AS wps,
  CASE WHEN w >= 1000 THEN round(list_avg(list_transform(range(CAST(floor(w / 1000) AS BIGINT)), lambda k: len(list_distinct(toks[k * 1000 + 1 : k * 1000 + 1000])) / 10.0)), 6) END AS sttr,
  round((length(body) - length(replace(body, ',', ''))) / n, 6) AS commas,
  round(100.0 * len(list_filter(ss, lambda x: regexp_matches(x, '{_q(SUBORDINATOR)}'))) / n, 6) AS subord,
  round(100.0 * len(list_filter(ss, lambda x: regexp_matches(x, '{_q(RELATIVE)}'))) / n, 6) AS relcl,
  round(100.0 * len(list_filter(ss, lambda x: NOT regexp_matches(x, '{_q(SUBORDINATOR)}') AND NOT regexp_matches(x, '{_q(RELATIVE)}'))) / n, 6) AS simple,
  round(100.0 * len(list_filter(lens, lambda x: x BETWEEN 20 AND 35)) / n, 6) AS b2035,
  round(100.0 * len(list_filter(lens, lambda x: x < 10)) / n, 6) AS u10,
  round(100.0 * length(array_to_string(regexp_extract_all(flags, 'x{{3,}}'), '')) / n, 6) AS shortruns,
  round(100.0 * len(list_filter(ws, lambda x: length(x) >= 7)) / w, 6) AS long7, round(chars / w, 6) AS wlen,
  round(100.0 * len(list_filter(toks, lambda x: list_contains(string_split('{' '.join(TOP100)}', ' '), x))) / w, 6) AS top100,
  round(100.0 * CASE WHEN n = 1 THEN 0 ELSE list_aggregate(lens, 'stddev_samp') END / wps, 6) AS slcv,
  round(w / p, 6) AS wpp, round(n / p, 6) AS spp,
  round(100.0 * len(list_filter(ss, lambda x: regexp_matches(x, '{_q(FRONTLOAD)}'))) / n, 6) AS front,
  round(100.0 * len(list_filter(ss, lambda x: len(regexp_extract_all(lower(x), '\\band\\b')) >= 2)) / n, 6) AS and2,
  round(100.0 * len(list_filter(toks, lambda x: x = 'and')) / w, 6) AS andrate,
  round(100.0 * len(list_filter(ss, lambda x: regexp_matches(x, '{_q(NEGATIVE)}'))) / n, 6) AS negative,
  w AS n_words, n AS n_sentences, p AS n_paragraphs
FROM t"""


@query("core_metrics", CORE_SQL)
def q_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core measurements of each document."""
    return core_metrics(docs(spark, sf_dir))


@query("core_readability")
def q_readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas that count syllables (no SQL: the counting rules look around)."""
    return readability(docs(spark, sf_dir))


def syllable_table(counts: DataFrame) -> DataFrame:
    """(token, sy): syllables of each distinct token of a table; the spelling rules run once a token, not once an occurrence."""
    forms = held(counts.select("token").distinct().select("token", T.spoken_form(F.col("token")).alias("form")))
    return held(forms.select("token", T.syllables_of_form(F.col("form")).alias("sy")))


def readability(documents: DataFrame) -> DataFrame:
    """Grade, reading ease, fog, smog, Coleman-Liau, lix and rix of each document with sentences."""
    base = arrays(documents, want="ss").where(F.size("ss") > 0).select("doc_id", F.size("ss").alias("n"))
    c = tokens(documents).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("c"))
    sums = {"w": F.lit(1), "syl": F.col("sy"), "hard": (F.col("sy") >= 3).cast("int"), "letters": F.length(F.translate("token", "'", "")), "long6": (F.length("token") > 6).cast("int")}
    syl = c.join(syllable_table(c), "token").groupBy("doc_id").agg(*(F.sum(F.col("c") * e).alias(k) for k, e in sums.items()))
    x = base.join(syl, "doc_id")
    n, w, syllables, hard = F.col("n"), F.col("w"), F.col("syl"), F.col("hard")
    return x.select(
        "doc_id",
        r6(0.39 * w / n + 11.8 * syllables / w - 15.59).alias("fk"),
        r6(206.835 - 1.015 * w / n - 84.6 * syllables / w).alias("reading_ease"),
        r6(0.4 * (w / n + 100.0 * hard / w)).alias("fog"),
        r6(1.043 * F.sqrt(hard * 30.0 / n) + 3.1291).alias("smog"),
        r6(0.0588 * (100.0 * F.col("letters") / w) - 0.296 * (100.0 * n / w) - 15.8).alias("coleman_liau"),
        r6(w / n + 100.0 * F.col("long6") / w).alias("lix"),
        r6(F.col("long6") / n).alias("rix"),
        syllables.alias("n_syllables"),
    )
