"""Text that comes again within a document: sentences equal under several views, near-duplicate sentences, motifs, runs, fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.functions import text as T
from proselake.operators.core_metrics import arrays, held
from proselake.operators.style import FUNCTION_WORDS, sql_list
from proselake.operators.views import SENT, TOK, WORD_SQL, docs, sentences
from proselake.plans.registry import query, r6

#: Tokens of a shingle; similarities at which shares are given, the lowest being that of the join; tokens of a motif and how often it must stand.
SHINGLE, LEVELS, MOTIF, MOTIF_TIMES = 3, (0.7, 0.8, 0.9), 5, 3
DOC = ["doc_id"]


def views(sentence: Column) -> dict[str, Column]:
    """A sentence as seen by each view; what it looks like there is compared."""
    t = T.tokens(sentence)
    return {
        "normalized": F.array_join(t, " "),
        "function_words": F.array_join(F.filter(t, lambda x: x.isin(FUNCTION_WORDS)), " "),
        "content_words": F.array_join(F.filter(t, lambda x: ~x.isin(FUNCTION_WORDS)), " "),
        "skeleton": F.array_join(F.transform(t, lambda x: F.when(x.isin(FUNCTION_WORDS), x).otherwise("_")), " "),
        "word_shape": F.array_join(F.transform(T.words(sentence), T.word_shape), " "),
        "punctuation": T.mark_skeleton(sentence),
    }


_TOKS = f"list_transform(regexp_extract_all(sentence, '{WORD_SQL}'), lambda x: replace(lower(x), '’', ''''))"
_FW = sql_list(FUNCTION_WORDS)
_SHAPE = r"regexp_replace(regexp_replace(regexp_replace(x, '\p{Lu}+', 'X', 'g'), '[\p{Ll}\p{Lo}\p{Lt}\p{Lm}]+', 'x', 'g'), '\p{N}+', 'd', 'g')"
_VIEW_SQL = {
    "normalized": f"array_to_string({_TOKS}, ' ')",
    "function_words": f"array_to_string(list_filter({_TOKS}, lambda x: x IN {_FW}), ' ')",
    "content_words": f"array_to_string(list_filter({_TOKS}, lambda x: x NOT IN {_FW}), ' ')",
    "skeleton": f"array_to_string(list_transform({_TOKS}, lambda x: CASE WHEN x IN {_FW} THEN x ELSE '_' END), ' ')",
    "word_shape": f"array_to_string(list_transform(regexp_extract_all(sentence, '{WORD_SQL}'), lambda x: {_SHAPE}), ' ')",
    "punctuation": f"array_to_string(regexp_extract_all(sentence, '{T.MARKS_ANY.replace(chr(39), chr(39) * 2)}'), '')",
}


@query(
    "reuse_views",
    f"WITH {SENT}, v AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS view, {v} AS x FROM sent" for k, v in _VIEW_SQL.items()) + """), c AS (SELECT doc_id, view, x, count(*) AS c FROM v GROUP BY ALL)
SELECT doc_id, view, CAST(sum(c) AS BIGINT) AS sentences, round(100.0 * coalesce(sum(c) FILTER (c > 1), 0) / sum(c), 6) AS exact_share FROM c GROUP BY ALL""",
)
def reuse_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a document's sentences that look like another one under each view."""
    s = sentences(docs(spark, sf_dir)).select("doc_id", "sentence")
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("view"), F.xxhash64(v).alias("x")) for k, v in views(F.col("sentence")).items()))).alias("r")
    c = s.select("doc_id", rows).groupBy("doc_id", "r.view", "r.x").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("doc_id", "view").agg(F.sum("c").alias("sentences"), r6(100.0 * F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("exact_share"))


def shingles(t: Column, k: int = SHINGLE) -> Column:
    """The different runs of k tokens; a shorter sequence is one shingle."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - k + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(t, i, k), " ")))
    return F.array_distinct(runs)


def near_sentences(units: DataFrame, least: float = LEVELS[0]) -> DataFrame:
    """(doc_id, a, b, similarity) of each two different units (doc_id, unit, sh ARRAY<BIGINT>) of one document whose shingles
    have a Jaccard similarity of `least` or more; a < b.

    Two such units share one of the rarest size - ceil(least x size) + 1 shingles of each, so only these are joined: what
    many units of a document have in common is rare among them, and no document's units are paired all with all.
    """
    sh = units.select("doc_id", "unit", F.size("sh").alias("n"), F.explode("sh").alias("s"))
    sh = sh.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "s")))
    order = Window.partitionBy("doc_id", "unit").orderBy("df", "s")
    sh = sh.withColumn("k", F.row_number().over(order)).where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    a, b = sh.select("doc_id", "s", F.col("unit").alias("a"), F.col("n").alias("na")), sh.select("doc_id", "s", F.col("unit").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, ["doc_id", "s"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9)).select("doc_id", "a", "b").distinct()
    x, y = units.select("doc_id", F.col("unit").alias("a"), F.col("sh").alias("x")), units.select("doc_id", F.col("unit").alias("b"), F.col("sh").alias("y"))
    j = pairs.join(x, ["doc_id", "a"]).join(y, ["doc_id", "b"])
    both = F.size(F.array_intersect("x", "y"))
    return j.select("doc_id", "a", "b", (both / (F.size("x") + F.size("y") - both)).alias("similarity")).where(F.col("similarity") >= least - 1e-9)


@query(
    "reuse_near_sentences",
    f"""WITH {SENT}, t AS (SELECT doc_id, {_TOKS} AS t, count(*) AS copies FROM sent GROUP BY ALL), u AS (SELECT doc_id, row_number() OVER () AS unit, copies, list_distinct(list_transform(range(1, greatest(len(t) - {SHINGLE} + 1, 1) + 1), lambda i: array_to_string(t[i:i + {SHINGLE - 1}], ' '))) AS sh FROM t),
e AS (SELECT doc_id, unit, len(sh) AS n, unnest(sh) AS s FROM u), p AS (SELECT a.doc_id, a.unit AS a, b.unit AS b, count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.s = b.s AND a.unit <> b.unit GROUP BY ALL),
best AS (SELECT doc_id, a AS unit, max(j) AS j FROM p GROUP BY ALL), f AS (SELECT u.doc_id, copies, CASE WHEN copies > 1 THEN 1.0 ELSE coalesce(j, 0) END AS j FROM u LEFT JOIN best USING (doc_id, unit))
SELECT doc_id, CAST(sum(copies) AS BIGINT) AS sentences, {', '.join(f"round(100.0 * coalesce(sum(copies) FILTER (j >= {x} - 1e-9), 0) / sum(copies), 6) AS near_{int(100 * x)}" for x in LEVELS)} FROM f GROUP BY doc_id""",
)
def reuse_near_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a document's sentences that have an equal or near-duplicate one, at three similarities. Copies count as one unit."""
    t = held(sentences(docs(spark, sf_dir)).select("doc_id", T.tokens(F.col("sentence")).alias("t")))
    u = t.groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("copies")).select("doc_id", F.xxhash64("t").alias("unit"), "copies", shingles(F.col("t")).alias("sh"))
    p = near_sentences(u.select("doc_id", "unit", "sh"))
    best = p.select("doc_id", F.explode(F.array("a", "b")).alias("unit"), "similarity").groupBy("doc_id", "unit").agg(F.max("similarity").alias("j"))
    f = u.join(best, ["doc_id", "unit"], "left").select("doc_id", "copies", F.when(F.col("copies") > 1, 1.0).otherwise(F.coalesce("j", F.lit(0.0))).alias("j"))
    return f.groupBy("doc_id").agg(F.sum("copies").alias("sentences"), *(r6(100.0 * F.sum(F.when(F.col("j") >= x - 1e-9, F.col("copies")).otherwise(0)) / F.sum("copies")).alias(f"near_{int(100 * x)}") for x in LEVELS))


@query(
    "reuse_motifs",
    f"""WITH {TOK}, k AS (SELECT doc_id, i, CASE WHEN token IN {_FW} THEN token ELSE '_' END AS x FROM tok), g AS (SELECT doc_id, i, array_to_string([{', '.join('x' if j == 0 else f'lead(x, {j}) OVER w' for j in range(MOTIF))}], ' ') AS g, lead(i, {MOTIF - 1}) OVER w AS last FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT doc_id, i, g, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g WHERE last IS NOT NULL), r AS (SELECT * FROM m WHERE c >= {MOTIF_TIMES} AND g <> '{' '.join('_' * MOTIF)}'),
v AS (SELECT DISTINCT doc_id, unnest(range(i, i + {MOTIF})) AS i FROM r), n AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id HAVING count(*) >= {MOTIF})
SELECT n.doc_id, (SELECT count(DISTINCT g) FROM r WHERE r.doc_id = n.doc_id) AS motifs, round(100.0 * (SELECT count(*) FROM v WHERE v.doc_id = n.doc_id) / n, 6) AS coverage FROM n""",
)
def reuse_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of five tokens, content words masked, that stand three times or more: kinds, and share of tokens in them."""
    a = arrays(docs(spark, sf_dir), want="toks").select("doc_id", "toks").where(F.size("toks") >= MOTIF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = {w: i + 1 for i, w in enumerate(FUNCTION_WORDS)}
        for b in batches:
            kinds, share = [], []
            for t in b.column(1).to_pylist():
                x = np.array([keep.get(w, 0) for w in t], np.uint16)
                g = np.lib.stride_tricks.sliding_window_view(x, MOTIF)
                _, inverse, count = np.unique(g, axis=0, return_inverse=True, return_counts=True)
                hit = (count[inverse.ravel()] >= MOTIF_TIMES) & (g != 0).any(1)
                covered = np.zeros(len(x) + 1, np.int32)
                np.add.at(covered, np.flatnonzero(hit), 1)
                np.add.at(covered, np.flatnonzero(hit) + MOTIF, -1)
                kinds.append(len(np.unique(inverse.ravel()[hit])))
                share.append(100.0 * float((np.cumsum(covered[:-1]) > 0).sum()) / len(x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.int64()), pa.array(share, pa.float64())], ["doc_id", "motifs", "coverage"])

    return a.mapInArrow(run, "doc_id bigint, motifs bigint, coverage double").select("doc_id", "motifs", r6("coverage").alias("coverage"))


def longest_run(ids: np.ndarray) -> int:
    """Length of the longest run of ids that stands twice: binary search over lengths, each checked by hashes of all runs."""
    low, high = 0, len(ids) - 1
    while low < high:
        k = (low + high + 1) // 2
        h = _hashes(ids, k)
        if len(np.unique(h)) < len(h):
            low = k
        else:
            high = k - 1
    return low


def _hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes (modulo 2**64) of all runs of k ids, by doubling."""
    prime, h, size, out, got = 0x9E3779B97F4A7C15, ids, 1, None, 0
    power = lambda n: np.uint64(pow(prime, n, 1 << 64))
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                if out is None:
                    out, got = h, size
                else:
                    m = len(ids) - got - size + 1
                    out, got = out[:m] * power(size) + h[got : got + m], got + size
            if 2 * size > k:
                return out
            h = h[:-size] * power(size) + h[size:]
            size *= 2


def simhash(tokens: list[str]) -> int:
    """64 votes of the hashes of the tokens."""
    bits = np.unpackbits(np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(tokens)).tobytes(), "big")


def nearest_hamming(prints: np.ndarray, block: int = 1 << 21) -> float:
    """Mean distance of each fingerprint from its nearest other one, in blocks of rows."""
    if len(prints) < 2:
        return float("nan")
    rows, near = max(1, block // len(prints)), []
    for a in range(0, len(prints), rows):
        d = np.bitwise_count(prints[a : a + rows, None] ^ prints[None, :]).astype(np.int16)
        d[np.arange(len(d)), a + np.arange(len(d))] = 99
        near.append(d.min(1))
    return float(np.concatenate(near).mean())


@query("reuse_fingerprints")
def reuse_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of tokens that stands twice, and mean distance of a sentence's fingerprint from its nearest (hashes, so without SQL)."""
    a = arrays(docs(spark, sf_dir), want="toks ss").select("doc_id", "toks", F.transform("ss", T.tokens).alias("ss")).where(F.size("toks") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            longest, distance = [], []
            for t, ss in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                table = {w: xxhash.xxh3_64_intdigest(w) for w in set(t)}
                longest.append(longest_run(np.array([table[w] for w in t], np.uint64)))
                d = nearest_hamming(np.array([simhash(s) for s in ss if s], np.uint64))
                distance.append(None if np.isnan(d) else d)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(longest, pa.int64()), pa.array(distance, pa.float64())], ["doc_id", "longest_run", "hamming"])

    return a.mapInArrow(run, "doc_id bigint, longest_run bigint, hamming double").select("doc_id", "longest_run", r6("hamming").alias("hamming"))


def _sorted(t: Column) -> Column:
    return F.array_join(F.array_sort(t), " ")


def _similar(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def _pairs(s: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2))))


def _neighbours(documents: DataFrame) -> DataFrame:
    """(doc_id, a, sa, b, sb): each sentence's tokens and the next one's, in order and sorted."""
    t = held(sentences(documents).select("doc_id", "s", T.tokens(F.col("sentence")).alias("t")))
    by = Window.partitionBy("doc_id").orderBy("s")
    return t.select("doc_id", F.array_join("t", " ").alias("a"), _sorted(F.col("t")).alias("sa"), F.lead(F.array_join("t", " ")).over(by).alias("b"), F.lead(_sorted(F.col("t"))).over(by).alias("sb")).where("b is not null")


@query("reuse_adjacent_edits")
def reuse_adjacent_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike neighbouring sentences are by edits, in order and with sorted tokens (edits are of characters, where the other engine counts bytes, so without SQL)."""
    x = _neighbours(docs(spark, sf_dir))
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"), r6(F.avg(_similar(F.col("a"), F.col("b")))).alias("edit_similarity"), r6(F.avg(_similar(F.col("sa"), F.col("sb")))).alias("sorted_similarity"))


@query(
    "reuse_adjacent_pairs",
    f"""WITH {SENT}, t AS (SELECT doc_id, s, {_TOKS} AS t FROM sent), x AS (SELECT doc_id, array_to_string(t, ' ') AS a, lead(array_to_string(t, ' ')) OVER w AS b FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
p AS (SELECT *, list_distinct(list_transform(range(1, greatest(length(a) - 1, 1) + 1), lambda i: substr(a, i, 2))) AS pa, list_distinct(list_transform(range(1, greatest(length(b) - 1, 1) + 1), lambda i: substr(b, i, 2))) AS pb FROM x WHERE b IS NOT NULL)
SELECT doc_id, count(*) AS pairs, round(avg(2.0 * len(list_intersect(pa, pb)) / (len(pa) + len(pb))), 6) AS pair_similarity FROM p GROUP BY doc_id""",
)
def reuse_adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike neighbouring sentences are by their pairs of characters."""
    x = held(_neighbours(docs(spark, sf_dir)).withColumn("pa", _pairs(F.col("a"))).withColumn("pb", _pairs(F.col("b"))))
    dice = 2.0 * F.size(F.array_intersect("pa", "pb")) / (F.size("pa") + F.size("pb"))
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"), r6(F.avg(dice)).alias("pair_similarity"))


def jaro_winkler(a: str, b: str) -> float:
    """Similarity by matching characters within half the length, their transpositions, and a common beginning of up to four."""
    if a == b:
        return 1.0
    reach, used, hits = max(len(a), len(b)) // 2 - 1, [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(hits, (c for c, u in zip(b, used) if u))) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + same * 0.1 * (1 - jaro)
