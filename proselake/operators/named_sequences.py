"""Named sequences of a text: one number for each sentence, paragraph or window, in reading order.

They have the layout of the table of sequences (doc_id, seq_name, idx, value), so every `sequence_` measure takes them.
Those of plain text come from documents; those that need a parse, vectors or a lexicon from the tables that hold these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.functions import stats
from proselake.functions import text as T
from proselake.operators import sequences as S
from proselake.operators.core_metrics import held
from proselake.operators.profiles import windows
from proselake.operators.style import sql_list
from proselake.operators.views import PARA, QUOTED_SQL, SENT, WORD_SQL, bodies, docs, split_sql
from proselake.plans.registry import query, r6
from proselake.session import table

# Punctuation marks counted in a sentence; personal pronouns.
MARKS = r"""[.,;:!?"'()\[\]{}—–…]"""
PRONOUNS = "i me my mine myself you your yours yourself yourselves he him his himself she her hers herself it its itself we us our ours ourselves they them their theirs themselves".split()
SENTENCE_NAMES = ("sentence_words", "sentence_chars", "sentence_punctuation", "sentence_char_entropy")


def _letter_entropy(s: Column) -> Column:
    """Entropy in bits of the letters of a sentence; null without letters. The letters are sorted, so each is a run of one sign."""
    letters = F.array_join(F.array_sort(F.regexp_extract_all(F.lower(s), F.lit(r"\p{L}"), F.lit(0))), "")
    runs = F.transform(F.regexp_extract_all(letters, F.lit(r"(.)\1*"), F.lit(0)), F.length)
    n = F.length(letters)
    return F.when(n > 0, F.log2(n) - F.aggregate(runs, F.lit(0.0), lambda a, c: a + c * F.log2(c)) / n)


def sentence_sequences(documents: DataFrame) -> DataFrame:
    """Words, characters, marks and letter entropy of each sentence; a sentence without letters has no entropy."""
    s = bodies(documents).select("doc_id", F.posexplode(F.flatten(T.sentences(F.col("body")))).alias("i", "s"))
    values = {"sentence_words": F.size(T.words(F.col("s"))), "sentence_chars": F.length("s"), "sentence_punctuation": F.size(F.regexp_extract_all("s", F.lit(MARKS), F.lit(0))), "sentence_char_entropy": _letter_entropy(F.col("s"))}
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("seq_name"), v.cast("double").alias("value")) for k, v in values.items()))).alias("r")
    out = s.select("doc_id", "i", rows).select("doc_id", "r.seq_name", "i", "r.value").where("value is not null")
    # places count the sentences that have a value
    place = F.row_number().over(Window.partitionBy("doc_id", "seq_name").orderBy("i")) - 1
    return out.select("doc_id", "seq_name", place.cast("int").alias("idx"), "value")


def paragraph_sequences(documents: DataFrame) -> DataFrame:
    """Words and sentences of each paragraph."""
    p = bodies(documents).select("doc_id", F.posexplode(T.paragraphs(F.col("body"))).alias("idx", "p"))
    values = {"paragraph_words": F.size(T.words(F.col("p"))), "paragraph_sentences": F.size(T.sentences_of_paragraph(F.col("p")))}
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("seq_name"), v.cast("double").alias("value")) for k, v in values.items()))).alias("r")
    return p.select("doc_id", "idx", rows).select("doc_id", "r.seq_name", "idx", "r.value")


def window_sequences(documents: DataFrame, size: int = 2000) -> DataFrame:
    """Share of words in speech (percent) and personal pronouns per thousand words of each window."""
    w = held(windows(documents, size).select("doc_id", "win", T.tokens(F.col("text")).alias("t"), T.tokens(F.array_join(F.regexp_extract_all("text", F.lit(T.QUOTED), F.lit(0)), "\n")).alias("q")))
    n = F.greatest(F.size("t"), F.lit(1))
    values = {"window_dialogue_fraction": 100.0 * F.size("q") / n, "window_pronoun_rate": 1000.0 * F.size(F.filter("t", lambda x: x.isin(PRONOUNS))) / n}
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("seq_name"), v.alias("value")) for k, v in values.items()))).alias("r")
    return w.select("doc_id", F.col("win").alias("idx"), rows).select("doc_id", "r.seq_name", "idx", "r.value")


def named_sequences(documents: DataFrame, window_words: int = 2000) -> DataFrame:
    """(doc_id, seq_name, idx, value): the eight sequences of plain text. Null and empty texts have none."""
    return sentence_sequences(documents).unionByName(paragraph_sequences(documents)).unionByName(window_sequences(documents, window_words))


def parse_sequences(parses: DataFrame) -> DataFrame:
    """(doc_id, seq_name, idx, value) of a parse table (doc_id, sent_idx, tok_i, pos, dep, head_i, ent): distance to heads,
    clauses, entropy of word classes and named entities of each sentence; depths come from `parses.depths`."""
    by = ["doc_id", "sent_idx"]
    root = F.col("dep").isin("ROOT", "root") | (F.col("head_i") == F.col("tok_i"))
    clause = F.col("dep").isin("ROOT", "root", "ccomp", "advcl", "relcl", "acl:relcl", "conj", "csubj", "csubjpass", "csubj:pass", "parataxis") & F.col("pos").isin("VERB", "AUX")
    begin = F.col("ent").isNotNull() & (F.col("ent") != "")
    s = parses.groupBy(*by).agg(F.avg(F.when(~root, F.abs(F.col("tok_i") - F.col("head_i")))).alias("sentence_dependency_distance"), F.sum(clause.cast("int")).cast("double").alias("sentence_clause_count"), F.sum(begin.cast("int")).cast("double").alias("sentence_entity_count"))
    e = stats.entropy_of_counts(parses, by, "pos").select(*by, F.col("entropy").alias("sentence_pos_entropy"))
    return _long(s.join(e, by), by, [c for c in (*s.columns, "sentence_pos_entropy") if c not in by])


def vector_sequences(vectors: DataFrame) -> DataFrame:
    """(doc_id, seq_name, idx, value) of sentence vectors (doc_id, idx, vector): cosine with the vector before, and cosine
    distance from the document's mean vector; vectors of no length have none."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    cosine = lambda a, b: F.when((dot(a, a) > 0) & (dot(b, b) > 0), dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)))
    v = vectors.withColumn("before", F.lag("vector").over(Window.partitionBy("doc_id").orderBy("idx")))
    part = vectors.select("doc_id", F.posexplode("vector").alias("k", "x")).groupBy("doc_id", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = part.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda r: r["x"]).alias("centre"))  # one number a dimension
    s = v.join(centre, "doc_id").select("doc_id", "idx", cosine(F.col("vector"), F.col("before")).alias("sentence_similarity_prev"), (1 - cosine(F.col("vector"), F.col("centre"))).alias("sentence_distance_centroid"))
    return _long(s, ["doc_id", "idx"], ["sentence_similarity_prev", "sentence_distance_centroid"])


def lexicon_sequences(documents: DataFrame, lexicon: DataFrame, value: str, seq_name: str) -> DataFrame:
    """(doc_id, seq_name, idx, value): mean of a lexicon's value (token, value) over the words of each sentence that it
    holds; sentences without any have none. For frequencies, norms, polarity and emotion alike."""
    s = bodies(documents).select("doc_id", F.posexplode(F.flatten(T.sentences(F.col("body")))).alias("sent_idx", "s"))
    w = s.select("doc_id", "sent_idx", F.explode(T.tokens(F.col("s"))).alias("token")).groupBy("doc_id", "sent_idx", "token").agg(F.count(F.lit(1)).alias("n"))
    m = w.join(lexicon.select("token", F.col(value).cast("double").alias("v")).where("v is not null"), "token").groupBy("doc_id", "sent_idx").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias(seq_name))
    return _long(m, ["doc_id", "sent_idx"], [seq_name])


def _long(wide: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("seq_name"), F.col(k).alias("value")) for k in names))).alias("r")
    out = wide.select(*by, rows).select(*by, "r.seq_name", "r.value").where("value is not null")
    return out.select("doc_id", "seq_name", (F.row_number().over(Window.partitionBy("doc_id", "seq_name").orderBy(by[1])) - 1).alias("idx"), "value")


_MARKS_SQL = MARKS.replace("'", "''")
_VALUE_SQL = {
    "sentence_words": "CAST(n_words AS DOUBLE)",
    "sentence_chars": "CAST(length(sentence) AS DOUBLE)",
    "sentence_punctuation": f"CAST(len(regexp_extract_all(sentence, '{_MARKS_SQL}')) AS DOUBLE)",
}


def _register(name: str, sql: str, build) -> None:
    query(name, sql)(lambda spark, sf_dir: build(docs(spark, sf_dir)).where(F.col("seq_name") == name[4:]).select("doc_id", F.col("idx").cast("bigint").alias("idx"), r6("value").alias("value")))


for _name, _sql in _VALUE_SQL.items():
    _register(f"seq_{_name}", f"WITH {SENT} SELECT doc_id, s AS idx, round({_sql}, 6) AS value FROM sent", sentence_sequences)
_register(
    "seq_sentence_char_entropy",
    rf"""WITH {SENT}, l AS (SELECT doc_id, s, unnest(regexp_extract_all(lower(sentence), '\p{{L}}')) AS c FROM sent), n AS (SELECT doc_id, s, c, count(*) AS k FROM l GROUP BY ALL), e AS (SELECT doc_id, s, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS e FROM n GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS idx, round(e, 6) + 0.0 AS value FROM e""",
    sentence_sequences,
)
_register("seq_paragraph_words", f"WITH {PARA} SELECT doc_id, p AS idx, CAST(len(regexp_extract_all(paragraph, '{WORD_SQL}')) AS DOUBLE) AS value FROM para", paragraph_sequences)
_register("seq_paragraph_sentences", f"WITH {PARA} SELECT doc_id, p AS idx, CAST(len({split_sql('paragraph')}) AS DOUBLE) AS value FROM para", paragraph_sequences)

# windows of whole paragraphs: each begins where the one before has its words, so the chain of starts is followed step by step
_WINDOWS = f"""WITH RECURSIVE {PARA}, pn AS (SELECT doc_id, p, paragraph, len(regexp_extract_all(paragraph, '{WORD_SQL}')) AS n FROM para), pc AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY p) AS upto, max(p) OVER (PARTITION BY doc_id) AS last FROM pn),
nx AS (SELECT a.doc_id, a.p, coalesce(min(b.p), any_value(a.last)) AS stop, min(b.p) IS NOT NULL AS closed, any_value(a.last) AS last FROM pc a LEFT JOIN pc b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.upto - (a.upto - a.n) >= 2000 GROUP BY a.doc_id, a.p),
w AS (SELECT doc_id, 0 AS win, p, stop, closed, last FROM nx WHERE p = 0 UNION ALL SELECT nx.doc_id, win + 1, nx.p, nx.stop, nx.closed, nx.last FROM w JOIN nx ON nx.doc_id = w.doc_id AND nx.p = w.stop + 1 WHERE w.stop < w.last),
wt AS (SELECT w.doc_id, win, any_value(w.closed) AS closed, CAST(sum(n) AS BIGINT) AS n, string_agg(paragraph, chr(10) || chr(10) ORDER BY pc.p) AS text FROM w JOIN pc ON pc.doc_id = w.doc_id AND pc.p BETWEEN w.p AND w.stop GROUP BY w.doc_id, win), win AS (SELECT * FROM wt WHERE closed OR win = 0 OR n >= 500)"""
_register("seq_window_dialogue_fraction", _WINDOWS + f"SELECT doc_id, CAST(win AS BIGINT) AS idx, round(100.0 * len(regexp_extract_all(array_to_string(regexp_extract_all(text, '{QUOTED_SQL}'), chr(10)), '{WORD_SQL}')) / greatest(n, 1), 6) AS value FROM win", window_sequences)
_register("seq_window_pronoun_rate", _WINDOWS + f"SELECT doc_id, CAST(win AS BIGINT) AS idx, round(1000.0 * len(list_filter(list_transform(regexp_extract_all(text, '{WORD_SQL}'), lambda x: replace(lower(x), '’', '''')), lambda x: x IN {sql_list(PRONOUNS)})) / greatest(n, 1), 6) AS value FROM win", window_sequences)


@query("sequences_of_documents")
def sequences_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All named sequences of plain text (each also has a query of its own with SQL)."""
    return named_sequences(docs(spark, sf_dir)).select("doc_id", "seq_name", F.col("idx").cast("bigint").alias("idx"), r6("value").alias("value"))


@query(
    "document_rhythm",
    f"""WITH {SENT}, d AS (SELECT doc_id, s, n_words - avg(n_words) OVER (PARTITION BY doc_id) AS d, n_words FROM sent), p AS (SELECT *, d * lead(d) OVER (PARTITION BY doc_id ORDER BY s) AS p1 FROM d)
SELECT doc_id, count(*) AS n, round(CASE WHEN count(*) > 2 AND sum(d * d) > 1e-18 THEN sum(p1) / sum(d * d) END + 0.0, 6) AS acf1 FROM p GROUP BY doc_id""",
)
def document_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a text to its rhythm: the first autocorrelation of its sentences' lengths, by the measures of sequences."""
    s = S.clean(sentence_sequences(docs(spark, sf_dir)).where("seq_name = 'sentence_words'"))
    return stats.autocorrelation(s, S.KEYS, "i", "x", (1,)).select("doc_id", "n", r6("acf1").alias("acf1"))


@query(
    "embedding_neighbours",
    """WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT CAST(label AS BIGINT) AS doc_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, round(list_cosine_similarity(e, b), 6) + 0.0 AS value FROM v WHERE b IS NOT NULL AND list_dot_product(e, e) > 0 AND list_dot_product(b, b) > 0""",
)
def embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector with the one before, for vectors in the order of their ids within a label."""
    v = table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("doc_id"), F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"))
    return vector_sequences(v).where("seq_name = 'sentence_similarity_prev'").select("doc_id", F.col("idx").cast("bigint").alias("idx"), r6("value").alias("value"))
