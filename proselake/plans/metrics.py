"""Registry of metrics as extension points: a function from documents to findings, with what it needs; and SQL functions."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FINDING = "doc_id bigint, metric_id string, value double, sample_size bigint, family string, warning string"
METRICS: dict[str, MetricSpec] = {}


@dataclass(frozen=True)
class MetricSpec:
    """A measurement: measure gives (doc_id, metric_id, value, sample_size) for the documents."""

    name: str
    family: str
    measure: Callable[[DataFrame], DataFrame]
    cost: str = "fast"
    requires: tuple[str, ...] = ()
    min_sample: int = 1
    ids: tuple[str, ...] = field(default=())


def metric(name: str, family: str, **how) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Register a measuring function; a second one of the same name replaces the first only with replace=True."""
    replace = how.pop("replace", False)

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        if name in METRICS and not replace:
            raise ValueError(f"two metrics are named {name}")
        METRICS[name] = MetricSpec(name, family, f, **how)
        return f

    return add


def require(package: str) -> tuple[object | None, str | None]:
    """(module, None), or (None, why it isn't there); never raises."""
    try:
        return importlib.import_module(package), None
    except Exception as e:  # whatever its import raises
        return None, f"{package} isn't available: {type(e).__name__}"


def chosen(enable: list[str] | None = None, disable: list[str] = (), family: str | None = None, cost: tuple[str, ...] = ("fast", "moderate", "slow")) -> list[MetricSpec]:
    """The metrics asked for, in the order of their names."""
    return [m for n, m in sorted(METRICS.items()) if (enable is None or n in enable) and n not in disable and (family is None or m.family == family) and m.cost in cost]


def measured(documents: DataFrame, metrics: list[MetricSpec]) -> DataFrame:
    """Finding rows (doc_id, metric_id, value, sample_size, family, warning) of all metrics. A metric whose packages are missing
    gives a null value with the reason for each document; a sample below the least has a warning."""
    out = documents.sparkSession.createDataFrame([], FINDING)
    for m in metrics:
        why = next((w for p in m.requires if (w := require(p)[1])), None)
        if why:
            rows = documents.select("doc_id").withColumn("metric_id", F.explode(F.array(*map(F.lit, m.ids or (m.name,))))).select("doc_id", "metric_id", F.lit(None).cast("double").alias("value"), F.lit(0).cast("bigint").alias("sample_size"), F.lit(m.family).alias("family"), F.lit(why).alias("warning"))
        else:
            few = F.when(F.col("sample_size") < m.min_sample, F.lit(f"fewer than {m.min_sample}"))
            rows = m.measure(documents).select("doc_id", "metric_id", F.col("value").cast("double").alias("value"), F.col("sample_size").cast("bigint").alias("sample_size"), F.lit(m.family).alias("family"), few.alias("warning"))
        out = out.unionByName(rows)
    return out


def register_functions(spark: SparkSession) -> None:
    """SQL functions: table functions prose_sentences(text) and prose_words(text), and the aggregate prose_median(x)."""
    import regex
    from pyspark.sql.functions import pandas_udf, udtf

    from proselake.functions import text as X

    word, end, letter = regex.compile(X.WORD), regex.compile(X.SENTENCE_END.replace(r"\z", r"\Z")), regex.compile(X.LETTER)

    @udtf(returnType="place int, sentence string")
    class Sentences:
        def eval(self, text: str) -> Iterator[tuple[int, str]]:
            pieces = (p.strip() for p in end.sub("\\1\x01\\2", text or "").split("\x01"))
            yield from enumerate(p for p in pieces if letter.search(p))

    @udtf(returnType="place int, word string")
    class Words:
        def eval(self, text: str) -> Iterator[tuple[int, str]]:
            yield from enumerate(word.findall(text or ""))

    @pandas_udf(T.DoubleType())
    def median(x: pd.Series) -> float:
        return float(x.median())

    spark.udtf.register("prose_sentences", Sentences)
    spark.udtf.register("prose_words", Words)
    spark.udf.register("prose_median", median)
