"""Queries p1 to p10 over the tables of a data folder, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.llm import bpe, lookalike, markup, mixing, percentiles, reading, repeated_lines, repetition, residue, sentences
from proselake.session import materialize, prepare, spread, table

Query = Callable[[SparkSession, str], DataFrame]
P6_KEYS = ["metric_id", "corpus"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(prepare(spark), sf_dir, "documents"))


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the finite values of each metric and corpus with their bound on the relative error, for each day of measured_at (span day) and for all days
    together (span all). The whole comes from the merged sketches of the days, not from the values again."""
    f = table(spark, sf_dir, "findings").select("value", *P6_KEYS, F.to_date("measured_at").alias("day"))
    days = materialize(percentiles.sketch(f, [*P6_KEYS, "day"]))
    each = percentiles.percentiles(days, [*P6_KEYS, "day"]).withColumn("span", F.lit("day"))
    whole = percentiles.percentiles(percentiles.merge(days, P6_KEYS), P6_KEYS).withColumns({"day": F.lit(None).cast("date"), "span": F.lit("all")})
    return each.unionByName(whole).select(*P6_KEYS, "span", "day", "q", "n", _rounded("value").alias("value"), F.lit(percentiles.ACCURACY).alias("rel_error"))


def p6_unsplit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles of all days from one sketch of all values."""
    p = percentiles.percentiles(percentiles.sketch(table(spark, sf_dir, "findings").select("value", *P6_KEYS), P6_KEYS), P6_KEYS)
    return p.select(*P6_KEYS, "q", "n", _rounded("value").alias("value"), F.lit(percentiles.ACCURACY).alias("rel_error"))


def _rounded(c: str):
    """Eight significant digits, for comparisons across engines."""
    return F.format_string("%.7e", F.col(c)).cast("double")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.Mixture(_docs(spark, sf_dir).select("doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"))
    return mix.report()


def p9_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.Mixture(_docs(spark, sf_dir).select("doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"))
    return mix.draw()


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: repeated_lines.repeated_lines(_docs(s, d)),
        "p1_clean": lambda s, d: repeated_lines.without_repeated_lines(_docs(s, d)),
        "p1_templates": lambda s, d: repeated_lines.line_templates(_docs(s, d)),
        "p2_found": lambda s, d: repetition.repetitive(_docs(s, d)),
        "p2_repetition": lambda s, d: repetition.repetition(_docs(s, d)),
        "p3_found": lambda s, d: markup.markup_kinds(_docs(s, d)),
        "p3_clean": lambda s, d: markup.clean_texts(_docs(s, d)),
        "p4_found": lambda s, d: reading.missing_bands(_docs(s, d), table(s, d, "reading_bands")),
        "p4_levels": lambda s, d: reading.reading_levels(_docs(s, d), reading.learn(_docs(s, d), table(s, d, "reading_bands"))),
        "p5_found": p5_found,
        "p5_sentences": lambda s, d: sentences.sentences(_docs(s, d)),
        "p6_percentiles": p6_percentiles,
        "p6_unsplit": p6_unsplit,
        "p7_found": lambda s, d: lookalike.lookalike_pairs(_docs(s, d)),
        "p7_normalized": lambda s, d: lookalike.normalized(_docs(s, d)).select("doc_id", "text"),
        "p7_classes": lambda s, d: lookalike.look_classes(_docs(s, d)).select("doc_id", F.hex("look_hash").alias("look"), "variants", "links"),
        "p8_ids": lambda s, d: bpe.token_ids(_docs(s, d), s.conf.get("spark.proselake.vocabulary", bpe.VOCABULARY)),
        "p9_found": lambda s, d: mixing.short_sources(_docs(s, d), table(s, d, "mix_targets")),
        "p9_report": p9_report,
        "p9_draw": p9_draw,
        "p10_found": lambda s, d: residue.with_residue(_docs(s, d)),
        "p10_clean": lambda s, d: residue.without_residue(_docs(s, d)).select("doc_id", "lang", "source", "text"),
    }


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of the sentences of passages; the model is learned from all texts."""
    docs = _docs(spark, sf_dir).select("doc_id", "unit", "text")
    found = sentences.sentences(docs.where("unit = 'passage'"), sentences.learn(docs))
    return found.select("doc_id", "end_char").distinct()


_LINES = """
WITH lines AS (
  SELECT doc_id, source, generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE source IS NOT NULL AND text IS NOT NULL)),
keyed AS (SELECT doc_id, source, line_no, lower(regexp_replace(line, '[^\\p{L}]+', '', 'g')) AS k FROM lines),
need AS (SELECT source, greatest(3, count(*) * 0.2) AS need FROM documents WHERE source IS NOT NULL GROUP BY source),
bad AS (SELECT keyed.source, k FROM keyed JOIN need USING (source) WHERE length(k) >= 10 GROUP BY keyed.source, k, need HAVING count(DISTINCT doc_id) >= need),
found AS (SELECT DISTINCT doc_id, CAST(line_no AS INTEGER) AS line_no FROM keyed JOIN bad USING (source, k))
"""
def _p6_sql(keys: str, rows: str, more: str) -> str:
    return f"""(WITH b AS (
  SELECT {keys}, CAST(sign(value) AS INTEGER) AS sgn,
         CASE WHEN value = 0 THEN 0 ELSE CAST(ceil(ln(abs(value)) / ln(1.01 / 0.99)) AS INTEGER) END AS bucket, count(*) AS n
  FROM {rows} WHERE value IS NOT NULL AND isfinite(value) GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS upto, sum(n) OVER (PARTITION BY {keys}) AS total FROM b WINDOW w AS (PARTITION BY {keys} ORDER BY sgn, sgn * bucket)),
q AS (SELECT unnest([0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])::DOUBLE AS q)
SELECT metric_id, corpus, {more} q, CAST(total AS BIGINT) AS n,
       CAST(format('{{:.7e}}', CASE WHEN sgn = 0 THEN 0.0 ELSE sgn * (2 / (1.01 / 0.99 + 1)) * pow(1.01::DOUBLE / 0.99, bucket) END) AS DOUBLE) AS value, CAST(0.01 AS DOUBLE) AS rel_error
FROM c, q WHERE floor(q * (total - 1)) < upto AND floor(q * (total - 1)) >= upto - n)"""


_DAYS = "(SELECT metric_id, corpus, value, CAST(measured_at AS DATE) AS day FROM findings)"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _LINES + "SELECT doc_id, line_no FROM found",
        "p1_clean": _LINES
        + """, gone AS (SELECT doc_id, list(line_no) AS gone FROM found GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN gone IS NULL THEN text ELSE
  array_to_string(list_transform(list_filter(range(len(string_split(text, chr(10)))), lambda i: NOT list_contains(gone, i)), lambda i: string_split(text, chr(10))[i + 1]), chr(10)) END AS text
FROM documents d LEFT JOIN gone USING (doc_id)""",
        "p1_templates": """
WITH lines AS (
  SELECT DISTINCT doc_id, source, lower(regexp_replace(line, '[^\\p{L}]+', '', 'g')) AS k, pos
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE source IS NOT NULL AND text IS NOT NULL)),
cut AS (SELECT doc_id, source, k, list_transform(range(0, (length(k) + 4) // 5), lambda i: substr(k, CAST(i * 5 + 1 AS BIGINT), 5)) AS tokens FROM lines WHERE length(k) >= 10),
need AS (SELECT source, greatest(3, count(*) * 0.2) AS need FROM documents WHERE source IS NOT NULL GROUP BY source),
places AS (SELECT source, len(tokens) AS n, tokens[1] AS a, tokens[2] AS b, unnest(range(1, len(tokens) + 1)) AS place, unnest(tokens) AS token FROM cut),
kept AS (SELECT p.source, n, a, b, place, token FROM places p JOIN need USING (source) GROUP BY p.source, n, a, b, place, token, need HAVING count(*) >= need),
kinds AS (SELECT DISTINCT source, k, tokens FROM cut),
shaped AS (SELECT x.source, x.k, string_agg(CASE WHEN kept.token IS NULL THEN '*' ELSE x.token END, '' ORDER BY x.place) AS template, CAST(count(*) FILTER (kept.token IS NULL) AS INTEGER) AS slots, x.n, x.a, x.b
  FROM (SELECT source, k, len(tokens) AS n, tokens[1] AS a, tokens[2] AS b, unnest(range(1, len(tokens) + 1)) AS place, unnest(tokens) AS token FROM kinds) x
  LEFT JOIN kept ON kept.source = x.source AND kept.n = x.n AND kept.a = x.a AND kept.b = x.b AND kept.place = x.place AND kept.token = x.token
  GROUP BY x.source, x.k, x.n, x.a, x.b)
SELECT s.source, template, slots, count(DISTINCT doc_id) AS docs FROM shaped s JOIN cut ON cut.source = s.source AND cut.k = s.k JOIN need ON need.source = s.source
GROUP BY s.source, template, slots, n, a, b, need HAVING count(DISTINCT doc_id) >= need""",
        "p6_percentiles": _p6_sql("metric_id, corpus, day", _DAYS, "'day' AS span, day,") + " UNION ALL " + _p6_sql("metric_id, corpus", "findings", "'all' AS span, NULL::DATE AS day,"),
        "p6_unsplit": _p6_sql("metric_id, corpus", "findings", ""),
    }
