"""Traces of style in a text's smallest choices: runs of bytes, marks and function words, affixes, shapes, capitals; how far texts
compress together; and whose model and whose company a text fits."""

from __future__ import annotations

import lzma
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.functions import text as T
from proselake.functions.grams import entropy, per_row, run_counts
from proselake.operators.core_metrics import arrays
from proselake.operators.style import FUNCTION_WORDS, sql_list
from proselake.operators.views import SENT, TOK, WORD_SQL, bodies, docs
from proselake.plans.registry import query, r6

_WORD, _MARK = regex.compile(T.WORD), regex.compile(T.MARKS_ANY)
_UPPER, _LOWER, _DIGIT = regex.compile(r"\p{Lu}+"), regex.compile(r"[\p{Ll}\p{Lo}\p{Lt}\p{Lm}]+"), regex.compile(r"\p{N}+")
_KEPT = frozenset(FUNCTION_WORDS)


def _entropy(values: list) -> float:
    return entropy(np.array(list(Counter(values).values()), float)) if values else float("nan")


def _shape(w: str) -> str:
    return _DIGIT.sub("d", _LOWER.sub("x", _UPPER.sub("X", w)))


def entropies(body: str) -> dict[str, float]:
    """Entropies in bits of the shapes of words, pairs of function words and of marks, and the three letters at either end of longer words."""
    words = _WORD.findall(body)
    low = [w.lower().replace("’", "'") for w in words]
    fw, marks = [w for w in low if w in _KEPT], _MARK.findall(body)
    long_ = [w for w in low if len(w) >= 5]
    return {
        "word_shape": _entropy(list(map(_shape, words))), "function_word_pairs": _entropy(list(zip(fw, fw[1:]))), "mark_pairs": _entropy(list(zip(marks, marks[1:]))),
        "prefixes": _entropy([w[:3] for w in long_]), "suffixes": _entropy([w[-3:] for w in long_]),
    }


_PAIRS = "SELECT doc_id, '{0}' AS feature, {1} AS x FROM {2}"
_FW = sql_list(FUNCTION_WORDS)


@query(
    "stylometry_entropies",
    f"""WITH {TOK}, fw AS (SELECT doc_id, token AS a, lead(token) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM tok WHERE token IN {_FW}), mk0 AS (SELECT doc_id, regexp_extract_all(body, '{T.MARKS_ANY.replace("'", "''")}') AS ms FROM b), mk1 AS (SELECT doc_id, unnest(range(len(ms))) AS i, unnest(ms) AS m FROM mk0), mk AS (SELECT doc_id, m AS a, lead(m) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM mk1),
x AS (SELECT doc_id, 'word_shape' AS feature, regexp_replace(regexp_replace(regexp_replace(word, '\\p{{Lu}}+', 'X', 'g'), '[\\p{{Ll}}\\p{{Lo}}\\p{{Lt}}\\p{{Lm}}]+', 'x', 'g'), '\\p{{N}}+', 'd', 'g') AS x FROM tok UNION ALL SELECT doc_id, 'function_word_pairs', a || ' ' || b FROM fw WHERE b IS NOT NULL
UNION ALL SELECT doc_id, 'mark_pairs', a || ' ' || b FROM mk WHERE b IS NOT NULL UNION ALL SELECT doc_id, 'prefixes', left(token, 3) FROM tok WHERE length(token) >= 5 UNION ALL SELECT doc_id, 'suffixes', right(token, 3) FROM tok WHERE length(token) >= 5),
c AS (SELECT doc_id, feature, x, count(*) AS c FROM x GROUP BY ALL) SELECT doc_id, feature, round(log2(sum(c)) - sum(c * log2(c)) / sum(c) + 0.0, 6) AS entropy FROM c GROUP BY ALL""",
)
def stylometry_entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropies of shapes, pairs and affixes, counted within the row."""
    of = lambda t: [(k, v) for k, v in entropies(t).items() if np.isfinite(v)]
    return per_row(bodies(docs(spark, sf_dir)).select("doc_id", "body"), of, "feature string, entropy double").select("doc_id", "feature", r6("entropy").alias("entropy"))


@query(
    "stylometry_openings",
    f"""WITH {SENT}, o AS (SELECT doc_id, replace(lower(regexp_extract(sentence, '{WORD_SQL}')), '’', '''') AS w FROM sent), c AS (SELECT doc_id, w, count(*) AS c FROM o WHERE w <> '' GROUP BY ALL) SELECT doc_id, CAST(sum(c) AS BIGINT) AS sentences, round(log2(sum(c)) - sum(c * log2(c)) / sum(c) + 0.0, 6) AS entropy FROM c GROUP BY doc_id""",
)
def stylometry_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of the first words of sentences."""
    a = arrays(docs(spark, sf_dir), want="ss").select("doc_id", F.transform("ss", lambda s: F.translate(F.lower(F.regexp_extract(s, T.WORD, 0)), "’", "'")).alias("o"))

    def of(o: list[str]) -> list[tuple]:
        o = [w for w in o if w]
        return [(len(o), _entropy(o))] if o else []

    return per_row(a, of, "sentences bigint, entropy double").select("doc_id", "sentences", r6("entropy").alias("entropy"))


def whole_text(body: str) -> dict[str, float]:
    """Entropy of pairs of bytes, slope and fit of rank against frequency, capitals and contractions per hundred words, how far the
    text compresses, and how far its halves share what they compress by."""
    raw = body.encode("utf-8", "replace")
    words = _WORD.findall(body)
    out = {"byte_pairs": entropy(run_counts(np.frombuffer(raw, np.uint8).astype(np.uint64), 2).astype(float)) if len(raw) > 1 else float("nan")}
    if words:
        out["capitals"] = 100.0 * sum(len(w) > 1 and w.isupper() for w in words) / len(words)
        out["contractions"] = 100.0 * sum(w.lower().replace("’", "'").endswith(("n't", "'ll", "'re", "'ve", "'d", "'m")) for w in words) / len(words)
        c = np.sort(np.array(list(Counter(w.lower() for w in words).values()), float))[::-1]
        if len(c) >= 10 and c[0] > c[-1]:
            x, y = np.log(np.arange(1, len(c) + 1)), np.log(c)
            out["zipf_slope"] = float(np.polyfit(x, y, 1)[0])
            out["zipf_fit"] = float(np.corrcoef(x, y)[0, 1] ** 2)
        out["compression"] = len(zlib.compress(raw, 9)) / len(raw)
        half = len(words) // 2
        if half:
            out["halves_apart"] = compression_distance(" ".join(words[:half]).encode(), " ".join(words[half:]).encode())
    return out


def packed(b: bytes) -> int:
    return len(lzma.compress(b, format=lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 6}]))


def compression_distance(a: bytes, b: bytes) -> float:
    """What two texts cost together beyond the cheaper, over the dearer."""
    x, y = packed(a), packed(b)
    return (packed(a + b) - min(x, y)) / max(x, y)


@query("stylometry_texts")
def stylometry_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures that need bytes and compressors (so without SQL)."""
    of = lambda t: [(k, v) for k, v in whole_text(t).items() if np.isfinite(v)]
    return per_row(bodies(docs(spark, sf_dir)).select("doc_id", "body"), of, "feature string, value double").select("doc_id", "feature", r6("value").alias("value"))


@query(
    "author_cross_entropy",
    f"""WITH {TOK}, d AS (SELECT doc_id, any_value(source) AS source, token, count(*) AS k FROM tok WHERE source IS NOT NULL GROUP BY doc_id, token), s AS (SELECT source, token, sum(k) AS c FROM d GROUP BY ALL), sn AS (SELECT source, sum(c) AS n FROM s GROUP BY source), w AS (SELECT token, sum(k) AS c FROM d GROUP BY token), wn AS (SELECT sum(c) AS n, count(*) AS v FROM w), dn AS (SELECT doc_id, sum(k) AS n FROM d GROUP BY doc_id)
SELECT d.doc_id, any_value(d.source) AS source, round(sum(k * -log2((s.c - k + 0.5) / (sn.n - dn.n + 0.5 * wn.v))) / sum(k), 6) AS own, round(sum(k * -log2((w.c - k + 0.5) / (wn.n - dn.n + 0.5 * wn.v))) / sum(k), 6) AS corpus
FROM d JOIN s ON s.source = d.source AND s.token = d.token JOIN sn ON sn.source = d.source JOIN w ON w.token = d.token JOIN dn ON dn.doc_id = d.doc_id, wn GROUP BY d.doc_id""",
)
def author_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy in bits a word of each document under the smoothed words of its own source and of the corpus, its own words left out of both."""
    a = arrays(docs(spark, sf_dir).where("source is not null"), "source", want="toks").select("doc_id", "source", F.explode("toks").alias("token"))
    d = a.groupBy("doc_id", "source", "token").agg(F.count(F.lit(1)).alias("k"))
    s = d.groupBy("source", "token").agg(F.sum("k").alias("sc"))
    w = s.groupBy("token").agg(F.sum("sc").alias("wc"))
    sn, dn = s.groupBy("source").agg(F.sum("sc").alias("sn")), d.groupBy("doc_id").agg(F.sum("k").alias("dn"))
    wn = F.broadcast(w.agg(F.sum("wc").alias("wn"), F.count(F.lit(1)).alias("v")))  # one row
    j = d.join(s, ["source", "token"]).join(w, "token").join(sn, "source").join(dn, "doc_id").crossJoin(wn)
    bits = lambda c, n: F.col("k") * -F.log2((F.col(c) - F.col("k") + 0.5) / (F.col(n) - F.col("dn") + 0.5 * F.col("v")))
    return j.groupBy("doc_id", "source").agg(r6(F.sum(bits("sc", "sn")) / F.sum("k")).alias("own"), r6(F.sum(bits("wc", "wn")) / F.sum("k")).alias("corpus"))


#: Impostors: sources drawn by hash to stand against a document's own (a set of them is what the method compares with); rounds; share of words in each.
IMPOSTORS, ROUNDS, PART = 200, 100, 0.5


def verified(own: np.ndarray, row: np.ndarray, others: np.ndarray, rng: np.random.Generator, rounds: int = ROUNDS) -> float:
    """Share of rounds, each with half of the words and half of the impostors, in which a document lies nearest to its own source."""
    won = 0
    for _ in range(rounds):
        words = rng.permutation(len(row))[: max(1, int(PART * len(row)))]
        some = others[rng.permutation(len(others))[: max(1, len(others) // 2)]]
        won += bool(np.abs(own[words] - row[words]).mean() < np.abs(some[:, words] - row[words]).mean(1).min())
    return won / rounds


@query("author_verification")
def author_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a document's own source beats drawn impostors, over seeded rounds (so without SQL); documents of 200 words or more."""
    return verification(docs(spark, sf_dir).where("source is not null"))


def verification(documents: DataFrame, least: int = 200) -> DataFrame:
    """(doc_id, source, score): rates of function words against those of the source without the document and of the impostors."""
    names = list(FUNCTION_WORDS)
    a = arrays(documents, "source", want="toks").where(F.size("toks") >= least).select("doc_id", "source", "toks")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for toks in b.column(2).to_pylist():
                c = Counter(toks)
                out.append([1000.0 * c[w] / len(toks) for w in names])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.float64()))], ["doc_id", "source", "x"])

    v = a.mapInArrow(vectors, "doc_id bigint, source string, x array<double>")
    part = v.select("source", F.posexplode("x").alias("k", "x")).groupBy("source", "k").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("sd"))
    c = part.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda r: r["s"]).alias("sums"), F.max("n").alias("n"))  # a number a function word
    drawn = [(r.source, (np.array(r.sums) / r.n).tolist()) for r in c.orderBy(F.xxhash64("source")).limit(IMPOSTORS).collect()]
    j = v.join(c, "source").where("n > 1").select("doc_id", "source", "x", "sums", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, who = np.array([x for _, x in drawn]).reshape(len(drawn), -1), np.array([s for s, _ in drawn])
        sd = m.std(0) + 1e-9
        for b in batches:
            scores = []
            for i, src, x, s, n in zip(*(c.to_pylist() for c in b.columns)):
                row = np.array(x)
                others = m[who != src]
                scores.append(verified((np.array(s) - row) / (n - 1) / sd, row / sd, others / sd, np.random.default_rng(abs(i))) if len(others) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], ["doc_id", "source", "score"])

    return j.mapInArrow(run, "doc_id bigint, source string, score double").where("score is not null").select("doc_id", "source", r6("score").alias("score"))
