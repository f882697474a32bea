"""Reading level of each document.

Each text gives features of its syntax (words and clauses a sentence) and vocabulary (length of words, shares of long
ones, variety). A linear ranker is learned from pairs of graded documents of different bands, so that the harder one
scores higher, by logistic regression on feature differences. Its scores are calibrated into levels by isotonic
regression (pool adjacent violators) against the graded bands; a band begins where the calibrated level passes halfway.

Fitted on at most GRADED graded documents, chosen by the hash of their ids, and PAIRS pairs of them; the features of
these, a few numbers each, are what the driver collects. Every document is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselake.session import broadcast_if_small

GRADED, PAIRS, SEED = 20_000, 60_000, 17
BANDS = ("easy", "middle", "hard")
FEATURES = ("sentence_words", "clauses", "word_letters", "long7", "long10", "long13", "variety", "syllables")
_MARKUP = re.compile(r"(?s)<[^<>]{1,200}>|&[a-z#0-9]{2,8};|\\[a-zA-Z]+|[{}\[\]|=*#_`$^~]|https?://\S+")
_END = re.compile(r"[.!?…。！？।؟]+[\"”’»)」』]*(?:\s+|$)|\n\s*\n|(?<=[。！？])")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_VOWELS = re.compile(r"[aeiouyáàâäãåæéèêëíìîïóòôöõøœúùûüýÿаеёиоуыэюя]+")
_CLAUSE = re.compile(r"[,;:，、；：—–()]")


def features(text: str | None) -> list[float] | None:
    """FEATURES of a text; None without words. Sentences of a letter or less don't count."""
    if not text:
        return None
    plain = _MARKUP.sub(" ", text)
    words = [w.lower() for w in _WORD.findall(plain)]
    if not words:
        return None
    lengths = np.array([sum(1 for c in w if c.isalpha()) for w in words])
    sents = [n for n in (len(_WORD.findall(s)) for s in _END.split(plain) if s) if n]
    n = np.array(sents or [len(words)], float)
    # the mean over words of their sentence's length: long sentences count as long as they are
    weighted = float((n * n).sum() / n.sum())
    spellings = Counter(words)
    syllables = sum(max(1, len(_VOWELS.findall(w))) * k for w, k in spellings.items()) / len(words)
    return [
        float(np.log(weighted)), float(np.log1p(len(_CLAUSE.findall(plain)) / len(n))), float(lengths.mean()), float((lengths >= 7).mean()), float((lengths >= 10).mean()),
        float((lengths >= 13).mean()), len(spellings) / len(words) ** 0.8, syllables,
    ]


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # scores in order
    levels: np.ndarray  # calibrated level at each, not falling

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def level(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.knots, self.levels)

    def bands(self, x: np.ndarray) -> list[str]:
        return [BANDS[int(np.clip(np.floor(v + 0.5), 0, 2))] for v in self.level(self.score(x))]


def isotonic(y: np.ndarray) -> np.ndarray:
    """The non-falling sequence nearest to y in squares, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v in y:
        blocks.append([float(v), 1.0])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            a[0] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1])
            a[1] += b[1]
    return np.concatenate([np.full(int(k), v) for v, k in blocks]) if blocks else np.zeros(0)


def fit(x: np.ndarray, band: np.ndarray) -> Ranker:
    """Learn the ranker from features and bands (0, 1, 2) of graded documents."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z, rng = (x - mean) / scale, np.random.default_rng(SEED)
    a, b = rng.integers(0, len(z), (2, PAIRS))
    a, b = a[band[a] != band[b]], b[band[a] != band[b]]
    harder = band[a] > band[b]
    d = np.where(harder[:, None], z[a] - z[b], z[b] - z[a])
    w = np.zeros(z.shape[1])
    for _ in range(25):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = d.T @ p - 0.01 * len(d) * w
        hess = (d * (p * (1 - p))[:, None]).T @ d + 0.01 * len(d) * np.eye(len(w))
        w = w + np.linalg.solve(hess, grad)
    s = z @ w
    order = np.argsort(s, kind="stable")
    return Ranker(mean, scale, w, s[order] + np.arange(len(s)) * 1e-12, isotonic(band[order].astype(float)))


def _measured(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "x"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, x array<double>")


def graded_bands(bands: DataFrame) -> DataFrame:
    """(doc_id, band, graded): each document of the table once; of its grades the commonest, ties to the easier."""
    n = bands.select("doc_id", "band").where("doc_id is not null").groupBy("doc_id", "band").agg(F.count(F.lit(1)).alias("n"))
    rank = F.array_position(F.array(*map(F.lit, BANDS)), F.col("band"))
    best = n.where(rank > 0).groupBy("doc_id").agg(F.max_by("band", F.struct("n", -rank)).alias("band"))
    return n.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", "band", F.col("band").isNotNull().alias("graded"))


def learn(documents: DataFrame, bands: DataFrame, limit: int = GRADED) -> Ranker | None:
    """The ranker from the graded documents (None if fewer than two bands are there)."""
    known = graded_bands(bands).where("graded").orderBy(F.xxhash64("doc_id")).limit(limit)
    texts = documents.select("doc_id", "text").join(broadcast_if_small(known.select("doc_id", "band"), limit), "doc_id").select("doc_id", "text", "band")
    rows = _measured(texts).join(known.select("doc_id", "band"), "doc_id").where("x is not null").select("doc_id", "x", "band").dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow().to_pylist()
    if len({r["band"] for r in rows}) < 2:
        return None
    return fit(np.array([r["x"] for r in rows]), np.array([BANDS.index(r["band"]) for r in rows]))


def reading_levels(documents: DataFrame, ranker: Ranker | None) -> DataFrame:
    """(doc_id, score, level, band) of each document: the ranker's score, the calibrated level from 0 (easy) to 2 (hard).

    Null, empty and wordless texts ask for nothing: their score is null, their level 0, their band easy. Without a
    ranker all bands are null. Repeated rows are scored each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column(1).to_pylist()]
            score: list[float | None] = [None] * len(x)
            level, band = [0.0] * len(x), [BANDS[0] if ranker else None] * len(x)
            held = [i for i, v in enumerate(x) if v is not None]
            if ranker and held:
                m = np.array([x[i] for i in held])
                s = ranker.score(m)
                for i, v, lv, bd in zip(held, s, ranker.level(s), ranker.bands(m)):
                    score[i], level[i], band[i] = float(v), float(lv), bd
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(level, pa.float64()), pa.array(band, pa.string())], ["doc_id", "score", "level", "band"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, level double, band string")


def missing_bands(documents: DataFrame, bands: DataFrame) -> DataFrame:
    """(doc_id, band) of each document whose rows in bands all lack one."""
    ask = bands.select("doc_id", "band").where("doc_id is not null").groupBy("doc_id").agg(F.count("band").alias("n")).where("n = 0").select("doc_id")
    texts = documents.select("doc_id", "text").join(broadcast_if_small(ask), "doc_id", "left_semi")
    return reading_levels(texts, learn(documents, bands)).select("doc_id", "band").distinct()
