"""Lines that a source puts on many of its documents, and texts without them.

Lines are parsed into templates through token trees of fixed depth. White space, digits and punctuation of a line don't
count, so its tokens are cut from its letters alone: runs of TOKEN letters in lower case. The nodes of the tree are
source / number of tokens / first token / second token; the leaf holds all lines of that path. In a leaf, a token
stays in the template of its line where it stands at its place in as many lines as a template needs; where the siblings
differ, the place becomes a wildcard slot. Each partition counts its own tree (the map side of the aggregations), the
shuffles add up the trees of all partitions, and paths that cannot reach the wanted number of documents are pruned.

A template covers many documents if enough of them hold a line of it. Templates without slots are lines word for word:
only they can be excessive lines, and an exact count of their documents follows. Those with slots are reported
(`line_templates`), not removed.

Nothing is collected, and one hot source is spread by leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselake.session import broadcast_if_small, materialize

#: Letters of a token of the tree.
TOKEN = 5
MIN_LETTERS, MIN_DOCS, MIN_SHARE = 10, 3, 0.2
#: Excessive lines up to which they are looked up within the rows of their source: of all sources, of one source.
MOST_LINES, MOST_OF_A_SOURCE = 200_000, 1_000


def letters(line: Column) -> Column:
    """The letters of a line in order and in lower case."""
    return F.lower(F.regexp_replace(line, r"[^\p{L}]+", ""))


def tokens(k: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(k) - 1) / TOKEN).cast("int")), lambda i: F.substring(k, i * TOKEN + 1, F.lit(TOKEN)))


def parse_lines(documents: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(doc_id, source, line_no, leaf, key, k) of each line with enough letters, in documents with a source.

    leaf stands for the path in the token tree, key for all letters k (64-bit hashes, told apart within a leaf).
    """
    lines = documents.where("source is not null and text is not null").select(
        F.col("doc_id"), F.col("source"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")
    )
    cut = lines.where(F.length("line") >= min_letters).withColumn("k", letters(F.col("line"))).where(F.length("k") >= min_letters)
    path = F.xxhash64("source", F.floor((F.length("k") - 1) / TOKEN), F.substring("k", 1, TOKEN), F.substring("k", TOKEN + 1, TOKEN))
    return cut.select("doc_id", "source", "line_no", path.alias("leaf"), F.xxhash64("k").alias("key"), "k")


def needed(documents: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """(source, need): the documents a line of each source needs to be excessive."""
    return documents.where("source is not null").groupBy("source").agg(F.greatest(F.lit(float(min_docs)), F.count(F.lit(1)) * F.lit(min_share)).alias("need"))


def mined(occ: DataFrame, need: DataFrame) -> DataFrame:
    """(source, leaf, key, need, template, slots): the template of each different line in the leaves that hold enough lines."""
    heavy = occ.groupBy("source", "leaf").agg(F.count(F.lit(1)).alias("lines")).join(need, "source").where("lines >= need").select("leaf", "need")
    kinds = materialize(occ.join(heavy, "leaf").groupBy("source", "leaf", "key", "need").agg(F.count(F.lit(1)).alias("lines"), F.first("k").alias("k")))
    runs = kinds.select("source", "leaf", "key", "need", "lines", F.posexplode(tokens(F.col("k"))).alias("place", "token"))
    kept = runs.groupBy("leaf", "place", "token").agg(F.sum("lines").alias("n"), F.max("need").alias("need")).where("n >= need").select("leaf", "place", "token", F.lit(True).alias("kept"))
    shaped = runs.join(kept, ["leaf", "place", "token"], "left").groupBy("source", "leaf", "key", "need").agg(
        F.sort_array(F.collect_list(F.struct("place", F.when(F.col("kept"), F.col("token")).otherwise(F.lit("*")).alias("token")))).alias("parts")
    )  # the tokens of one line each
    return shaped.select("source", "leaf", "key", "need", F.array_join("parts.token", "").alias("template"), F.size(F.filter("parts.token", lambda t: t == "*")).alias("slots"))


def line_templates(documents: DataFrame, min_letters: int = MIN_LETTERS, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(source, template, slots, docs): the templates that cover enough documents of their source; * stands for a slot."""
    docs = documents.select("doc_id", "source", "text")
    occ = materialize(parse_lines(docs, min_letters))
    shaped = mined(occ, needed(docs, min_docs, min_share))
    held = occ.select("leaf", "key", "doc_id").join(shaped, ["leaf", "key"]).select("source", "leaf", "template", "slots", "need", "doc_id").distinct()
    return held.groupBy("source", "leaf", "template", "slots", "need").agg(F.count(F.lit(1)).alias("docs")).where("docs >= need").select("source", "template", "slots", "docs")


def _excessive(docs: DataFrame, min_letters: int, min_docs: int, min_share: float) -> tuple[DataFrame, DataFrame]:
    """(occurrences of lines, (source, leaf, key) of the excessive ones)."""
    occ = materialize(parse_lines(docs, min_letters))
    literal = mined(occ, needed(docs, min_docs, min_share)).where("slots = 0").select("source", "leaf", "key", "need")
    pages = occ.select("leaf", "key", "doc_id").join(literal, ["leaf", "key"]).distinct().groupBy("source", "leaf", "key", "need").agg(F.count(F.lit(1)).alias("docs"))
    return occ, pages.where("docs >= need").select("source", "leaf", "key")


def repeated_lines(documents: DataFrame, min_letters: int = MIN_LETTERS, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, line_no) of every line excessive in its source: with at least min_letters letters, in at least min_docs
    documents and at least min_share of all rows of that source.

    Null texts have no lines but count among the rows of their source; null sources give nothing; an empty table gives
    none. Rows with an equal doc_id are one document. Other columns are ignored, whatever their names.
    """
    occ, excessive = _excessive(documents.select("doc_id", "source", "text"), min_letters, min_docs, min_share)
    return occ.join(excessive, ["leaf", "key"], "left_semi").select("doc_id", F.col("line_no").cast("int").alias("line_no")).distinct()


def without_repeated_lines(documents: DataFrame, min_letters: int = MIN_LETTERS, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, text) with the excessive lines taken out; texts without any come back unchanged, null as null.

    Excessive lines of moderate number (MOST_LINES, MOST_OF_A_SOURCE) are broadcast and looked up within the rows, so that
    no text is shuffled; beyond that the line numbers are joined by document.
    """
    docs = documents.select("doc_id", "source", "text")
    occ, excessive = _excessive(docs, min_letters, min_docs, min_share)
    excessive = materialize(excessive)
    size = excessive.groupBy("source").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("all"), F.coalesce(F.max("count"), F.lit(0)).alias("most")).first()
    lines = F.split("text", "\n", -1)
    if size["all"] <= MOST_LINES and size["most"] <= MOST_OF_A_SOURCE:
        keys = excessive.groupBy("source").agg(F.collect_set("key").alias("keys"))  # at most MOST_OF_A_SOURCE each
        rows = docs.join(F.broadcast(keys), "source", "left")
        gone = lambda x: (F.length(x) >= min_letters) & (F.length(letters(x)) >= min_letters) & F.array_contains("keys", F.xxhash64(letters(x)))
        kept = F.array_join(F.filter(lines, lambda x: ~gone(x)), "\n")
        return rows.select("doc_id", F.when(F.col("keys").isNull() | F.col("text").isNull(), F.col("text")).otherwise(kept).alias("text"))
    found = occ.join(broadcast_if_small(excessive), ["leaf", "key"], "left_semi").groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.array_join(F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains("gone", s["i"])), lambda s: s["x"]), "\n")
    return docs.join(found, "doc_id", "left").select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"))
