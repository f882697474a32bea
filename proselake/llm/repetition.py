"""Repetition inside a single document, judged against its language and source.

Each text gives a vector of statistics: the share of its words in stretches of eight or more that stood earlier in the
same text (fifteen letters in scripts without spaces), the same for stretches of four (seven letters), and how few of
its words are distinct. For each language and source, and for the corpus as a whole, a minimum-covariance-determinant
estimate of the vectors is found by concentration steps from several starts (medians and absolute deviations; the
moments of two halves of the rows): keep the half of the rows nearest by Mahalanobis distance, take their mean and
covariance, repeat until no determinant falls further; the start of least determinant counts. A group's estimate is
drawn to the corpus' as if that were PRIOR_ROWS more rows of the group, so small groups need no rule of their own.

Rows far on the repetitive side are rejected. A group in which most texts repeat themselves would have its centre there
and reject none of them; so a centre is held at a share of MOST_CENTRE or less and the deviation of the share at what
leaves a text of half its length rejected. As the Mahalanobis distance is never less than the deviation of one
statistic, no text that repeats half of itself or more can pass. p2_found keeps those of the rejected whose share is
half or more; the others are outliers by shorter repeats or by few distinct words.

Each step is two aggregations with map-side combination over one small table, so no group is gathered anywhere, however
large; the estimates of groups stay a table joined by group.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselake.session import broadcast_if_small, materialize

WORDS, LETTERS = 8, 15
#: Concentration steps after which it gives up with a warning; fall of a determinant that counts as one; least standard deviation.
STEPS, FALL, FLOOR = 30, 0.01, 0.04
#: Rows of a group that the corpus' estimate counts for; largest share of a centre; share that is always rejected.
PRIOR_ROWS, MOST_CENTRE, ALWAYS = 30.0, 0.2, 0.5
#: Groups up to which their estimates (a dozen numbers each) are broadcast.
MOST_BROADCAST = 500_000
# 97.5 % point of chi-square with 3 degrees of freedom; consistency factor of the covariance of the nearest half.
CUT, HALF_FACTOR = 9.348, 2.456
#: Scripts written without spaces between words.
UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff]")
_WORD = re.compile("[\\w\u0300-\u036f\u064b-\u065f\u0900-\u0dff]+")
_PRIME = 0x9E3779B97F4A7C15
FEATURES = ("share", "share_short", "sameness")


class _Ids(dict):
    """Words of a raw token (between white space) as 64-bit numbers; punctuation and case left out."""

    def __missing__(self, raw: str) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        out = self[raw] = tuple(xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in _WORD.findall(raw.lower()) if w != "_")
        return out


def _rolled(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n ids at each place (len(ids) - n + 1 of them): polynomials modulo 2**64, by doubling."""
    power = lambda k: np.uint64(pow(_PRIME, k, 1 << 64))
    h, size, out, got = ids, 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                if out is None:
                    out, got = h, size
                else:
                    m = len(ids) - got - size + 1
                    out, got = out[:m] * power(size) + h[got : got + m], got + size
            if 2 * size > n:
                return out
            h = h[:-size] * power(size) + h[size:]
            size *= 2


def covered(ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Which units lie in a stretch of n or more that began earlier in the same document. doc: the document of each unit, in order."""
    out = np.zeros(len(ids), bool)
    if len(ids) < n:
        return out
    with np.errstate(over="ignore"):
        h = _rolled(ids, n) ^ (doc[: len(ids) - n + 1].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    whole = np.flatnonzero(doc[: len(h)] == doc[n - 1 :])
    order = whole[np.argsort(h[whole], kind="stable")]
    again = order[1:][h[order[1:]] == h[order[:-1]]]
    edge = np.zeros(len(ids) + 1, np.int32)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES for each text; null, empty and wordless texts have zeros."""
    table = measure.ids
    words: list[int] = []
    letters: list[int] = []
    n_words, n_letters = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if not t:
            continue
        if not t.isascii() and 2 * len(UNSPACED.findall(t)) > sum(map(str.isalpha, t)):
            own = [ord(c) for c in t.lower() if c.isalpha()]
            letters += own
            n_letters[i] = len(own)
        else:
            before = len(words)
            for w in t.split():
                words += table[w]
            n_words[i] = len(words) - before
    out = np.zeros((len(texts), 3))
    for ids, n, runs in ((words, n_words, (WORDS, 4)), (letters, n_letters, (LETTERS, 7))):
        if not ids:
            continue
        u = np.array(ids, np.uint64) if runs[0] == WORDS else np.array(ids, np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        doc, held = np.repeat(np.arange(len(texts)), n), n > 0
        for j, k in enumerate(runs):
            out[held, j] = (np.bincount(doc, covered(u, doc, k), len(texts)) / np.maximum(n, 1))[held]
        first = np.ones(len(u), bool)
        order = np.lexsort((u, doc))
        first[order[1:]] = (u[order[1:]] != u[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
        distinct = np.bincount(doc, first, len(texts))
        out[held, 2] = (1 - np.log1p(distinct) / np.log1p(np.maximum(n, 1)))[held]
    return out


measure.ids = _Ids()


def repetition_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, grp, share, share_short, sameness) of each row; grp: its language and source (null as a value of its own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = measure(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(f[:, j]) for j in range(3))], ["doc_id", "grp", *FEATURES])

    grp = F.concat(F.coalesce("lang", F.lit("~")), F.lit("|"), F.coalesce("source", F.lit("~"))).alias("grp")
    return documents.select("doc_id", grp, "text").mapInArrow(run, "doc_id bigint, grp string, share double, share_short double, sameness double")


PAIRS = [(j, k) for j in range(3) for k in range(j, 3)]
MEANS, COVARIANCES, INVERSES = [f"m{j}" for j in range(3)], [f"v{j}{k}" for j, k in PAIRS], [f"i{j}{k}" for j, k in PAIRS]


def _inverse(c: dict[tuple[int, int], Column]) -> tuple[dict[tuple[int, int], Column], Column]:
    """Inverse (upper triangle) and determinant of a symmetric 3 x 3 matrix."""
    a, b, d, e, f, g = (c[p] for p in PAIRS)
    det = a * (e * g - f * f) - b * (b * g - f * d) + d * (b * f - e * d)
    return dict(zip(PAIRS, [(e * g - f * f) / det, (d * f - b * g) / det, (b * f - d * e) / det, (a * g - d * d) / det, (b * d - a * f) / det, (a * e - b * b) / det])), det


def _estimate(means: list[Column], cov: dict[tuple[int, int], Column], factor: float) -> list[Column]:
    """Columns of an estimate: centre, covariance (widened by the factor, with a least variance), its inverse and determinant."""
    held = {p: v * F.lit(factor) + F.lit(FLOOR**2 if p[0] == p[1] else 0.0) for p, v in cov.items()}
    inv, det = _inverse(held)
    return [*(m.alias(n) for m, n in zip(means, MEANS)), *(held[p].alias(n) for p, n in zip(PAIRS, COVARIANCES)), *(inv[p].alias(n) for p, n in zip(PAIRS, INVERSES)), det.alias("det")]


def distance() -> Column:
    """Squared Mahalanobis distance of a row joined with its group's estimate."""
    x = [F.col(f) - F.col(f"m{j}") for j, f in enumerate(FEATURES)]
    return sum((F.lit(1 if j == k else 2) * F.col(f"i{j}{k}") * x[j] * x[k] for j, k in PAIRS), F.lit(0.0))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.avg(f).alias(f"a{j}") for j, f in enumerate(FEATURES)), *(F.covar_pop(FEATURES[j], FEATURES[k]).alias(f"c{j}{k}") for j, k in PAIRS))


def _from_moments(moments: DataFrame, factor: float, *keys: str) -> DataFrame:
    return moments.select(*keys, *_estimate([F.col(f"a{j}") for j in range(3)], {(j, k): F.col(f"c{j}{k}") for j, k in PAIRS}, factor))


def robust_estimates(rows: DataFrame) -> DataFrame:
    """grp + (n, m0.., v00.., i00.., det): minimum-covariance-determinant centre and covariance of each group.

    One group may hold most rows, so tables of estimates are broadcast while their counted number of rows allows it;
    beyond that Spark's adaptive join splits the hot group.
    """
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    groups = sizes.count()
    small = F.broadcast if groups <= MOST_BROADCAST // 3 else lambda d: d
    med = rows.groupBy("grp").agg(*(F.percentile_approx(f, 0.5, 1000).alias(f"m{j}") for j, f in enumerate(FEATURES)))
    mad = rows.join(small(med), "grp").groupBy("grp", "m0", "m1", "m2").agg(*(F.percentile_approx(F.abs(F.col(f) - F.col(f"m{j}")), 0.5, 1000).alias(f"d{j}") for j, f in enumerate(FEATURES)))
    var = {(j, k): (F.pow(F.col(f"d{j}") * 1.4826, 2) if j == k else F.lit(0.0)) for j, k in PAIRS}
    first = mad.select("grp", F.lit(0).alias("start"), *_estimate([F.col(f"m{j}") for j in range(3)], var, 1.0))
    halves = rows.withColumn("start", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) + 1).cast("int"))
    est = materialize(first.unionByName(_from_moments(_moments(halves, ["grp", "start"]), 1.0, "grp", "start")))
    done = None
    for _ in range(STEPS):
        far = rows.join(small(est.drop(*COVARIANCES)), "grp").withColumn("d2", distance())
        half = far.groupBy("grp", "start").agg(F.percentile_approx("d2", 0.5, 1000).alias("h"))
        near = far.select("grp", "start", "d2", "det", *FEATURES).join(small(half), ["grp", "start"]).where("d2 <= h")
        moved = materialize(_from_moments(_moments(near, ["grp", "start", "det"]).withColumnRenamed("det", "before"), HALF_FACTOR, "grp", "start", "before"))
        # a start whose determinant falls no further is kept aside, so that later steps read less
        still = F.col("det") < F.col("before") * (1 - FALL)
        rest = moved.where(~still).drop("before")
        done, est = rest if done is None else done.unionByName(rest), moved.where(still).drop("before")
        if est.isEmpty():
            break
    else:
        warnings.warn(f"determinants still fall after {STEPS} steps")
        done = done.unionByName(est)
    best = done.groupBy("grp").agg(F.min_by(F.struct(*MEANS, *COVARIANCES, *INVERSES, "det"), F.struct("det", "start")).alias("e"))
    return best.select("grp", "e.*").join(sizes, "grp")


def held_estimates(est: DataFrame) -> DataFrame:
    """grp + (m0.., i00..): the estimates of groups, drawn to the corpus' (group *) and held so that a share of ALWAYS is rejected."""
    corpus = est.where("grp = '*'").first()
    if corpus is None:
        return est.select("grp", *MEANS, *INVERSES)
    blend = lambda c: ((F.col(c) * F.col("n") + F.lit(corpus[c] * PRIOR_ROWS)) / (F.col("n") + F.lit(PRIOR_ROWS))).alias(c)
    drawn = est.select("grp", *map(blend, [*MEANS, *COVARIANCES])).withColumn("m0", F.least("m0", F.lit(MOST_CENTRE)))
    most = F.pow((F.lit(ALWAYS) - F.col("m0")), 2) / F.lit(CUT * 1.0001)
    drawn = drawn.withColumn("s", F.sqrt(F.least(F.lit(1.0), most / F.col("v00"))))
    v = {p: F.col(n) * (F.col("s") if p[0] == 0 else F.lit(1.0)) * (F.col("s") if p[1] == 0 else F.lit(1.0)) for p, n in zip(PAIRS, COVARIANCES)}
    return drawn.select("grp", *MEANS, *(c.alias(n) for c, n in zip(_inverse(v)[0].values(), INVERSES)))


def repetition(documents: DataFrame) -> DataFrame:
    """(doc_id, share, share_short, sameness, d2, outlier) of each row.

    d2 is the squared distance from the centre of the row's group. Null and empty texts have shares of 0; null languages
    and sources form groups of their own. Repeated rows are measured each; other columns are ignored.
    """
    own = materialize(repetition_statistics(documents.select("doc_id", "lang", "source", "text")))
    both = own.unionByName(own.withColumn("grp", F.lit("*")))
    est = materialize(held_estimates(robust_estimates(both.select("doc_id", "grp", *FEATURES))))
    d = own.join(broadcast_if_small(est, MOST_BROADCAST), "grp").withColumn("d2", distance())
    return d.select("doc_id", *FEATURES, "d2", ((F.col("d2") > CUT) & (F.col("share") > F.col("m0"))).alias("outlier"))


def repetitive(documents: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id) of outliers at least this share of which repeats earlier stretches."""
    return repetition(documents).where(F.col("outlier") & (F.col("share") >= share)).select("doc_id").distinct()
