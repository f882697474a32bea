"""Graphs of a document: who stands near whom, which paragraphs share names, how often names come back; and their measures."""

from __future__ import annotations

from collections import deque
from math import log2

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.functions.grams import per_row
from proselake.operators.conversation import TURNS, clean_turns
from proselake.operators.reports import NAME_RE
from proselake.operators.views import PARA, SENT, docs, paragraphs, sentences
from proselake.plans.registry import query, r6
from proselake.session import table

#: Sentences, and paragraphs, within which two names, or paragraphs, are near.
WINDOW, PARAGRAPHS = 3, 5
#: Nodes up to which all shortest paths are followed; beyond that from PIVOTS nodes, spread evenly.
EXACT_NODES, PIVOTS = 200, 100
_NAMES = NAME_RE.replace("'", "''")


def names(documents: DataFrame) -> DataFrame:
    """(doc_id, s, name): the names of each sentence, once each."""
    return sentences(documents).select("doc_id", "s", F.explode(F.array_distinct(F.regexp_extract_all("sentence", F.lit(NAME_RE), F.lit(1)))).alias("name"))


def near_edges(occurrences: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, src, dst, weight): how many units (s) with a name have the other within the window; each occurrence goes only to the places it is near to."""
    a = occurrences.select("doc_id", F.col("name").alias("src"), "s")
    b = occurrences.select("doc_id", F.col("name").alias("dst"), F.explode(F.sequence(F.col("s") - (window - 1), F.col("s") + (window - 1))).alias("s")).distinct()
    return a.join(b, ["doc_id", "s"]).where("src < dst").groupBy("doc_id", "src", "dst").agg(F.count(F.lit(1)).alias("weight"))


_NEAR_SQL = f"""n AS (SELECT DISTINCT doc_id, s, unnest(regexp_extract_all(sentence, '{_NAMES}', 1)) AS name FROM sent),
edges AS (SELECT doc_id, src, dst, count(*) AS weight FROM (SELECT DISTINCT a.doc_id, a.name AS src, b.name AS dst, a.s FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.name < b.name AND abs(a.s - b.s) < {WINDOW}) GROUP BY ALL)"""


@query("graph_near_names", f"WITH {SENT}, {_NEAR_SQL} SELECT doc_id, src, dst, weight FROM edges")
def graph_near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names within three sentences of one another."""
    return near_edges(names(docs(spark, sf_dir)))


@query(
    "graph_reappearance",
    f"WITH {SENT}, {_NEAR_SQL}, g AS (SELECT doc_id, name, s - lag(s) OVER (PARTITION BY doc_id, name ORDER BY s) AS gap FROM n) SELECT doc_id, name, count(*) AS sentences, round(avg(gap), 6) AS mean_gap, CAST(max(gap) AS BIGINT) AS longest_gap FROM g GROUP BY ALL HAVING count(*) > 1",
)
def graph_reappearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After how many sentences each name that comes back does so."""
    g = names(docs(spark, sf_dir)).withColumn("gap", F.col("s") - F.lag("s").over(Window.partitionBy("doc_id", "name").orderBy("s")))
    return g.groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("sentences"), r6(F.avg("gap")).alias("mean_gap"), F.max("gap").cast("bigint").alias("longest_gap")).where("sentences > 1")


@query(
    "graph_paragraph_overlap",
    f"""WITH {PARA}, n AS (SELECT DISTINCT doc_id, p, unnest(regexp_extract_all(paragraph, '{_NAMES}', 1)) AS name FROM para)
SELECT a.doc_id, CAST(a.p AS BIGINT) AS src, CAST(b.p AS BIGINT) AS dst, count(*) AS weight FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.name = b.name AND b.p - a.p BETWEEN 1 AND {PARAGRAPHS} GROUP BY ALL""",
)
def graph_paragraph_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs at most five apart and the names they share; a name goes only to the five next places."""
    n = paragraphs(docs(spark, sf_dir)).select("doc_id", "p", F.explode(F.array_distinct(F.regexp_extract_all("paragraph", F.lit(NAME_RE), F.lit(1)))).alias("name"))
    later = n.select("doc_id", "name", F.col("p").alias("src"), F.explode(F.sequence(F.col("p") + 1, F.col("p") + PARAGRAPHS)).alias("p"))
    e = later.join(n, ["doc_id", "name", "p"]).groupBy("doc_id", "src", F.col("p").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))
    return e.select("doc_id", F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), "weight")


@query(
    "graph_name_paths",
    f"""WITH {SENT}, {_NEAR_SQL}, l AS (SELECT doc_id, name, s AS src, lead(s) OVER (PARTITION BY doc_id, name ORDER BY s) AS dst FROM n) SELECT doc_id, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, count(*) AS weight FROM l WHERE dst IS NOT NULL GROUP BY ALL""",
)
def graph_name_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences linked by chains: each to the next that holds the same name."""
    return chain_edges(names(docs(spark, sf_dir)))


def chain_edges(members: DataFrame) -> DataFrame:
    """(doc_id, src, dst, weight) between consecutive members (doc_id, name, s) of each chain."""
    nxt = members.withColumn("dst", F.lead("s").over(Window.partitionBy("doc_id", "name").orderBy("s"))).where("dst is not null")
    return nxt.groupBy("doc_id", F.col("s").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


@query(
    "graph_speakers",
    f"""WITH {TURNS}, l AS (SELECT doc_id, speaker AS a, lead(speaker) OVER (PARTITION BY doc_id ORDER BY turn_idx) AS b FROM t WHERE speaker IS NOT NULL) SELECT doc_id, least(a, b) AS src, greatest(a, b) AS dst, count(*) AS weight FROM l WHERE b IS NOT NULL AND a <> b GROUP BY ALL""",
)
def graph_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers whose turns follow one another, whoever begins."""
    l = clean_turns(table(spark, sf_dir, "turns")).where("speaker is not null").select("doc_id", F.col("speaker").alias("a"), F.lead("speaker").over(Window.partitionBy("doc_id").orderBy("turn_idx")).alias("b"))  # noqa: E741
    return l.where("b is not null and a <> b").groupBy("doc_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


def measures(edges: list[tuple[str, str, float]]) -> dict[str, float]:
    """Size, density, degrees, clustering, centralisation, ranks, communities and paths of one undirected weighted graph."""
    order = sorted({v for e in edges for v in e[:2]})
    at, n = {v: i for i, v in enumerate(order)}, len(order)
    near: list[dict[int, float]] = [{} for _ in order]
    for a, b, w in edges:
        if a != b:
            i, j = at[a], at[b]
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    degree = np.array([len(x) for x in near], float)
    strength = np.array([sum(x.values()) for x in near])
    m = degree.sum() / 2
    out = {"nodes": float(n), "edges": m, "density": 2 * m / (n * (n - 1)) if n > 1 else 0.0, "mean_degree": float(degree.mean()) if n else 0.0}
    if n < 3 or m == 0:
        return out
    out["degree_centralisation"] = float((degree.max() - degree).sum() / ((n - 1) * (n - 2)))
    closed = np.array([sum(1 for a in x for b in x if a < b and b in near[a]) for x in near], float)
    open_ = degree * (degree - 1) / 2
    out["clustering"] = float(np.where(open_ > 0, closed / np.maximum(open_, 1), 0).mean())
    out["transitivity"] = float(closed.sum() / open_.sum()) if open_.sum() else 0.0
    ends = np.array([(degree[i], degree[j]) for i, x in enumerate(near) for j in x])
    out["assortativity"] = float(np.corrcoef(ends.T)[0, 1]) if ends[:, 0].std() > 0 else float("nan")
    p = strength / strength.sum()
    out["strength_entropy"] = float(-(p[p > 0] @ np.log2(p[p > 0])) / log2(n))
    rank = np.full(n, 1 / n)
    for _ in range(100):
        nxt = np.full(n, 0.15 / n)
        for i, x in enumerate(near):
            for j, w in x.items():
                nxt[j] += 0.85 * rank[i] * w / strength[i]
        nxt += (1 - nxt.sum()) / n
        if np.abs(nxt - rank).max() < 1e-10:
            break
        rank = nxt
    out["top_rank"] = float(rank.max())
    part = _components(near)
    largest = max(part, key=len)
    out |= {"components": float(len(part)), "largest_share": len(largest) / n}
    starts = list(range(n)) if n <= EXACT_NODES else [int(i * n / PIVOTS) for i in range(PIVOTS)]
    between, far, total, pairs = np.zeros(n), [], 0, 0
    inside = set(largest)
    for s in starts:
        depth, paths, seen, queue = {s: 0}, {s: 1.0}, [], deque([s])
        while queue:
            v = queue.popleft()
            seen.append(v)
            for w in near[v]:
                if w not in depth:
                    depth[w], paths[w] = depth[v] + 1, 0.0
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        if s in inside:
            far.append(max(depth.values()))
            total, pairs = total + sum(depth.values()), pairs + len(depth) - 1
        flow = dict.fromkeys(seen, 0.0)
        for w in reversed(seen):
            for v in near[w]:
                if depth.get(v, -1) == depth[w] - 1:
                    flow[v] += paths[v] / paths[w] * (1 + flow[w])
            if w != s:
                between[w] += flow[w]
    between *= n / len(starts) / ((n - 1) * (n - 2))
    out["betweenness_centralisation"] = float((between.max() - between).sum() / (n - 1))
    out |= {"diameter": float(max(far, default=0)), "radius": float(min(far, default=0)), "mean_path": total / pairs if pairs else float("nan")}
    label, q = communities(near, strength)
    sizes = np.bincount(np.unique(label, return_inverse=True)[1]) / n
    out |= {"communities": float(len(sizes)), "modularity": q, "community_entropy": float(-(sizes @ np.log2(sizes)))}
    return out


def _components(near: list[dict[int, float]]) -> list[list[int]]:
    seen, out = set(), []
    for s in range(len(near)):
        if s not in seen:
            part, queue = [], deque([s])
            seen.add(s)
            while queue:
                v = queue.popleft()
                part.append(v)
                for w in near[v]:
                    if w not in seen:
                        seen.add(w)
                        queue.append(w)
            out.append(part)
    return out


def communities(near: list[dict[int, float]], strength: np.ndarray) -> tuple[np.ndarray, float]:
    """Nodes move, in the order of their numbers, to the neighbouring community that raises modularity most, until none moves; (labels, modularity)."""
    n, two = len(near), strength.sum()
    label, held = np.arange(n), strength.astype(float).copy()
    for _ in range(100):
        moved = False
        for v in range(n):
            links: dict[int, float] = {}
            for w, x in near[v].items():
                links[label[w]] = links.get(label[w], 0.0) + x
            own = label[v]
            held[own] -= strength[v]
            gain = lambda c: links.get(c, 0.0) - strength[v] * held[c] / two  # noqa: B023, E731
            best = max(sorted({own, *links}), key=lambda c: (round(gain(c), 12), c == own))
            held[best] += strength[v]
            if best != own:
                label[v], moved = best, True
        if not moved:
            break
    inside = sum(x for v in range(n) for w, x in near[v].items() if label[v] == label[w]) / two
    return label, float(inside - sum((held[c] / two) ** 2 for c in set(label.tolist())))


def battery(edges: DataFrame) -> DataFrame:
    """(doc_id, feature, value) of the graph of each document. A document's graph has at most as many nodes as it has names."""
    g = edges.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("weight").cast("double").alias("weight"))).alias("e"))

    def of(e: list[dict]) -> list[tuple]:
        return [(k, v) for k, v in measures([(r["src"], r["dst"], r["weight"]) for r in e]).items() if np.isfinite(v)]

    return per_row(g, of, "feature string, value double").select("doc_id", "feature", r6("value").alias("value"))


@query("graph_battery")
def graph_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of the graphs of near names (iterative algorithms on one small graph a document, so without SQL)."""
    return battery(graph_near_names(spark, sf_dir))


@query("graph_speaker_battery")
def graph_speaker_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same measures of the graphs of speakers."""
    return battery(graph_speakers(spark, sf_dir))
