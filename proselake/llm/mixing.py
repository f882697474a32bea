"""Mixing sources to target weights by soft membership.

A classifier learned from the labelled rows (naive Bayes over hashed byte trigrams, its scores tempered by length) gives
every document its domain posteriors, kept in steps of 1/PARTS. A document with a source belongs to it with the weight
TRUST and to all domains by its posteriors with the rest; one without a source belongs by its posteriors alone.
Projected gradient descent then fits a rate for each document, between 0 and the repeats it is allowed, so that the
expected tokens of each domain match its target in the least-squares sense. Documents of one source and one posterior
share their gradient, so every pass of the descent reads the table of these groups, not the documents. The step of a
domain is divided by the tokens that can reach it; a domain beyond its target pushes rates down. It ends when no
domain's expected tokens move by more than TOLERANCE of all.

The driver holds vectors of one number a domain and the classifier's table, whose buckets are chosen so that it stays
within MODEL_BYTES whatever the number of domains: the target table bounds both, the number of documents bounds neither.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselake.llm.bpe import VOCABULARY, Encoder
from proselake.session import materialize

#: Hash buckets of the classifier's byte trigrams at most, and bytes of its table; weight of a document's mean score.
BUCKETS, MODEL_BYTES, SHARPNESS = 4096, 64 << 20, 60.0
#: Weight of a document's own source in its membership; steps in which posteriors are kept.
TRUST, PARTS = 0.99, 64
#: The gradient descent has converged when a step moves each domain by less than this share of all tokens; steps after which it gives up with a warning.
TOLERANCE, STEPS = 1e-5, 500
_MEMBER = "doc_id bigint, source string, k int, tokens bigint, at array<int>, q array<int>"


def _buckets(domains: int) -> int:
    n = BUCKETS
    while n > 64 and n * domains * 8 > MODEL_BYTES:
        n //= 2
    return n


def _trigrams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(buckets, np.int64)
    h = (b[:-2] * 0x9E3779B1 + b[1:-1] * 0x85EBCA6B + b[2:] * 0xC2B2AE35) & 0xFFFFFFFF
    return np.bincount((h >> 20).astype(np.int64) % buckets, minlength=buckets)


def domain_model(documents: DataFrame, domains: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood of each bucket, log prior) by domain, from all documents with a source among the domains."""
    at, size = {d: i for i, d in enumerate(domains)}, _buckets(len(domains))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        docs: dict[int, int] = {}
        for b in batches:
            by: dict[int, list[str]] = {}
            for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k = at.get(s)
                if k is not None and t:
                    by.setdefault(k, []).append(t)
            for k, ts in by.items():
                sums[k] = sums.get(k, 0) + _trigrams("\n".join(ts), size)
                docs[k] = docs.get(k, 0) + len(ts)
        for k, v in sums.items():
            hit = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit) + 1, k, np.int32)), pa.array(np.append(hit, -1).astype(np.int32)), pa.array(np.append(v[hit], docs[k]))], ["k", "bucket", "n"])

    rows = documents.where("source is not null").select("source", "text").mapInArrow(count, "k int, bucket int, n bigint").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts, prior = np.full((len(domains), size), 0.5), np.full(len(domains), 0.5)
    k, bucket, n = (rows.column(i).to_numpy() for i in range(3))
    counts[k[bucket >= 0], bucket[bucket >= 0]] += n[bucket >= 0]
    prior[k[bucket < 0]] += n[bucket < 0]
    return np.log(counts / counts.sum(1, keepdims=True)), np.log(prior / prior.sum())


def in_parts(p: np.ndarray) -> np.ndarray:
    """Posteriors in whole PARTS that sum to PARTS: rounded down, what is left goes to the largest."""
    q = np.floor(p * PARTS).astype(np.int32)
    q[np.arange(len(q)), p.argmax(1)] += PARTS - q.sum(1)
    return q


def memberships(documents: DataFrame, domains: list[str], model: tuple[np.ndarray, np.ndarray], vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, k, tokens, at, q) of every row: the number of its source among the domains (-1 without a source,
    -2 for a source that isn't one), its tokens, and its posteriors (q parts at the domains `at`); of an empty text the prior."""
    like, prior = model
    place = {d: i for i, d in enumerate(domains)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = Encoder.of(vocabulary), like.shape[1]
        for b in batches:
            texts, sources = b.column(2).to_pylist(), b.column(1).to_pylist()
            k = [-1 if s is None else place.get(s, -2) for s in sources]
            tokens = [len(enc.encode(t)) for t in texts]
            c = np.array([_trigrams(t or "", size) for t in texts], float)
            z = c @ like.T / np.maximum(c.sum(1, keepdims=True), 1) * SHARPNESS + prior
            p = np.exp(z - z.max(1, keepdims=True))
            q = in_parts(p / p.sum(1, keepdims=True))
            row, at = np.nonzero(q)
            ends = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(k, pa.int32()), pa.array(tokens, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(q[row, at]))], ["doc_id", "source", "k", "tokens", "at", "q"]
            )

    # few texts at a time, as each takes a row of the table of buckets
    return documents.select("doc_id", "source", "text").mapInArrow(lambda it: run(_pieces(it, 256)), _MEMBER)


def _pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


class _Rates:
    """Memberships, caps and rates of batches of groups or documents; what a task carries is a vector a domain and a step."""

    def __init__(self, cap: np.ndarray, trust: float, history: list[np.ndarray]) -> None:
        self.cap, self.trust, self.history = cap, trust, list(history)

    def of(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(m, rate): the memberships of each row and its rate after all steps so far."""
        k = np.asarray(b.column("k"))
        q, n = np.zeros((len(k), len(self.cap))), np.asarray(pc.list_value_length(b.column("at")))
        q[np.repeat(np.arange(len(k)), n), np.asarray(b.column("at").flatten())] = np.asarray(b.column("q").flatten()) / PARTS
        top = np.where(k >= 0, self.cap[k], self.cap[q.argmax(1)]) * (k > -2)  # what no domain owns isn't drawn
        own = k >= 0
        m = np.where(own[:, None], (1 - self.trust) * q, q)
        m[np.flatnonzero(own), k[own]] += self.trust
        r = np.zeros(len(k))
        for step in self.history:
            r = np.clip(r + m @ step, 0, top)
        return m, r


class Mixture:
    """The fitted mixture: a rate for each document."""

    def __init__(self, documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, trust: float = TRUST) -> None:
        """documents: doc_id, source, text. targets: source, target_share, max_repeats, each source once (of repeated
        rows the first in order of share and repeats counts); null sources, shares or repeats count as none."""
        rows = sorted({(r.source, float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.select("source", "target_share", "max_repeats").collect() if r.source is not None})
        rows = list({r[0]: r for r in reversed(rows)}.values())[::-1]
        self.spark, self.domains, self.trust = documents.sparkSession, [r[0] for r in rows], trust
        self.share, self.cap = np.array([r[1] for r in rows]), np.array([float(r[2]) for r in rows])
        k = len(self.domains)
        self.own, self.fitted, self.history = np.zeros(k), np.zeros(k), []
        self.members = self.groups = None
        self.total = 0.0
        if not k:
            return
        self.members = materialize(memberships(documents, self.domains, domain_model(documents, self.domains), vocabulary))
        self.groups = materialize(self.members.groupBy("k", "at", "q").agg(F.sum("tokens").alias("tokens")))
        for r in self.groups.groupBy("k").agg(F.sum("tokens").alias("n")).collect():
            self.total += r.n if r.k != -1 else 0
            if r.k >= 0:
                self.own[r.k] = r.n
        self.target = self.share * self.total
        self._fit()

    def _fit(self) -> None:
        # with all tokens that can reach a domain below, the step never overshoots: what it multiplies residuals by has column sums of one at most
        mass, _ = self._expected(None)
        mass, before = np.maximum(mass, 1), np.zeros(len(mass))
        for _ in range(STEPS):
            self.history.append((self.target - before) / mass)
            self.expected, self.fitted = self._expected(self.history)
            if np.abs(self.expected - before).max() <= TOLERANCE * max(1.0, self.total):
                return
            before = self.expected
        warnings.warn(f"rates still move after {STEPS} steps")

    def _expected(self, history: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """(expected tokens by domain, those of them that documents of the domain's own source take) at the rates of the history; None: at rate 1."""
        k, rates = len(self.domains), _Rates(self.cap, self.trust, history or [])

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s, mine = np.zeros(k), np.zeros(k)
            for b in batches:
                m, r = rates.of(b)
                used = np.asarray(b.column("tokens"), float) * (r if history is not None else np.asarray(b.column("k")) > -2)
                s += used @ m
                own = np.asarray(b.column("k"))
                np.add.at(mine, own[own >= 0], used[own >= 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(s), pa.array(mine)], ["d", "v", "mine"])

        out = np.zeros((2, k))
        for r in self.groups.select("k", "at", "q", "tokens").mapInArrow(total, "d int, v double, mine double").groupBy("d").agg(F.sum("v").alias("v"), F.sum("mine").alias("mine")).collect():
            out[:, r.d] = r.v, r.mine
        return out[0], out[1]

    def rates(self) -> DataFrame:
        """(doc_id, source, k, tokens, at, q, rate): how often each document is expected in the mixture."""
        if self.members is None:
            return self.spark.createDataFrame([], _MEMBER + ", rate double")
        rates = _Rates(self.cap, self.trust, self.history)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rates.of(b)[1])], [*b.schema.names, "rate"])

        return self.members.mapInArrow(run, _MEMBER + ", rate double")

    def draw(self) -> DataFrame:
        """(doc_id, source, tokens, copies): whole copies whose expectation is the rate, never more than the repeats of the
        document's source (without one: of its likeliest domain), and the same on every run (the fraction is decided by the document's id)."""
        return _copies(self.rates()).select("doc_id", "source", "tokens", "copies")

    def report(self) -> DataFrame:
        """(source, target_share, tokens, rate, soft_tokens, actual_share, most_copies): the shares of all drawn tokens. tokens,
        rate (their mean over tokens) and most_copies are those of the documents with the source; soft_tokens the drawn
        tokens expected from documents without one."""
        drawn = _copies(self.rates()).where("k > -2")
        own = drawn.where("k >= 0").groupBy("source").agg(
            F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("used"), (F.sum(F.col("tokens") * F.col("rate")) / F.greatest(F.sum("tokens"), F.lit(1))).alias("rate"), F.max("copies").alias("most_copies")
        )
        part = F.explode(F.arrays_zip("at", "q")).alias("p")
        soft = drawn.where("k = -1 and copies > 0").select((F.col("tokens") * F.col("copies")).alias("used"), part).groupBy(F.col("p.at").alias("d")).agg((F.sum(F.col("used") * F.col("p.q")) / float(PARTS)).alias("soft_tokens"))
        goal = self.spark.createDataFrame([(i, d, float(s)) for i, (d, s) in enumerate(zip(self.domains, self.share))], "d int, source string, target_share double")
        rows = goal.join(own, "source", "left").join(soft, "d", "left").na.fill(0)
        used = (F.col("used") + F.col("soft_tokens")).alias("drawn")
        rows = rows.select("source", "target_share", "tokens", "rate", "soft_tokens", "most_copies", used)
        everything = rows.agg(F.sum("drawn").alias("everything"))  # one row
        share = F.when(F.col("everything") > 0, F.col("drawn") / F.col("everything")).alias("actual_share")
        return rows.crossJoin(F.broadcast(everything)).select("source", "target_share", "tokens", "rate", "soft_tokens", share, "most_copies")

    def short(self) -> list[str]:
        """Domains to which the fit can't bring their target from documents of their own, checked exactly: target > cap x own tokens.

        Fitted rates are at most the cap, so no domain short of documents reaches its target; one may also stay below it
        because documents of other domains reach into it, which the check tells apart."""
        return [d for d, f, t, c, n in zip(self.domains, self.fitted, self.target, self.cap, self.own) if f < t and t > c * n] if self.domains else []


def _copies(rates: DataFrame) -> DataFrame:
    """With the whole copies drawn at each rate; the document's id decides the fraction."""
    u = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return rates.withColumn("copies", F.floor(F.col("rate") + u).cast("int"))


def short_sources(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source) of each target that cannot be reached with max_repeats uses of each of its documents."""
    mix = Mixture(documents.select("doc_id", "source", "text"), targets, vocabulary)
    return documents.sparkSession.createDataFrame([(d,) for d in mix.short()], "source string")
