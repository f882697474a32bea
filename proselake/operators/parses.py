"""Measurements over a supplied parse table: doc_id, sent_idx, tok_i, text, lemma, pos, dep, head_i, morph MAP<STRING,STRING>, ent.

No parser is part of the engine; the table comes from annotated files (see sources.readers.conllu) or another system.
tok_i counts from 1 within the sentence and head_i is 0 at the root. Empty tables give empty results; rows without a part of
speech or relation count as words without them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselake.functions import stats
from proselake.plans.registry import r6

# Classes of relations and suffixes.
CLAUSES = {"relative_clause": ["relcl", "acl:relcl"], "adverbial_clause": ["advcl"], "complement_clause": ["ccomp", "xcomp"], "clausal_subject": ["csubj", "csubjpass", "csubj:pass"]}
SUBORDINATE = [d for v in CLAUSES.values() for d in v] + ["acl"]
NOMINAL = r"(tion|sion|ment|ness|ity|ance|ence)$"
POS = ["NOUN", "PROPN", "VERB", "ADJ", "ADV", "PRON", "ADP", "DET", "CCONJ", "SCONJ", "AUX"]
CONTENT = ["NOUN", "VERB", "ADJ", "ADV"]


def words(parses: DataFrame) -> DataFrame:
    return parses.where(F.coalesce("pos", F.lit("")).isin("PUNCT", "SPACE") == F.lit(False))


def one(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def pos_distribution(parses: DataFrame) -> DataFrame:
    """doc_id, a percentage for each part of speech, and their entropy in bits."""
    w = words(parses)
    share = w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), *(r6(100.0 * one(F.col("pos") == p) / F.count(F.lit(1))).alias(f"pos_{p.lower()}") for p in POS))
    return share.join(stats.entropy_of_counts(w, ["doc_id"], "pos").select("doc_id", r6("entropy").alias("pos_entropy")), "doc_id")


def passive_voice(parses: DataFrame) -> DataFrame:
    """Share of subjects that are subjects of passives."""
    s = parses.where(F.col("dep").isin("nsubj", "nsubjpass", "nsubj:pass"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("subjects"), r6(100.0 * one(F.col("dep") != "nsubj") / F.count(F.lit(1))).alias("passive_voice"))


def _sentences(parses: DataFrame) -> DataFrame:
    """A row for each sentence with its tokens' heads in order; sentences are short, so they fit a row."""
    return parses.groupBy("doc_id", "sent_idx").agg(F.array_sort(F.collect_list(F.struct("tok_i", "head_i", "pos", "dep"))).alias("t"))


def depths(parses: DataFrame) -> DataFrame:
    """doc_id, mean_token_depth, max_parse_depth (median over sentences), mean_max_parse_depth. A cycle of heads ends where it would repeat."""
    s = _sentences(parses).withColumn("h", F.transform("t", lambda x: x["head_i"]))
    step = lambda st, _: F.when(st["at"] <= 0, st).otherwise(F.struct(F.coalesce(F.get(F.col("h"), st["at"] - 1), F.lit(0)).alias("at"), (st["d"] + 1).alias("d")))
    depth = lambda head: F.aggregate("h", F.struct(F.coalesce(head, F.lit(0)).alias("at"), F.lit(0).alias("d")), step, lambda st: st["d"])
    d = s.select("doc_id", F.transform("h", depth).alias("d"))
    total = F.aggregate("d", F.lit(0), lambda a, x: a + x)
    g = d.select("doc_id", F.size("d").alias("n"), total.alias("sum"), F.array_max("d").alias("max")).groupBy("doc_id")
    return g.agg(r6(F.sum("sum") / F.sum("n")).alias("mean_token_depth"), r6(F.percentile("max", F.lit(0.5))).alias("max_parse_depth"), r6(F.avg("max")).alias("mean_max_parse_depth"))


def dependency_distance(parses: DataFrame) -> DataFrame:
    """Mean distance of words from their heads: over words, and the median of sentence means."""
    d = words(parses).where("head_i > 0").withColumn("x", F.abs(F.col("tok_i") - F.col("head_i")))
    s = d.groupBy("doc_id", "sent_idx").agg(F.avg("x").alias("m"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.count(F.lit(1)).alias("n"))
    n, mean = F.sum("n"), F.sum("sx") / F.sum("n")
    return s.groupBy("doc_id").agg(r6(F.percentile("m", F.lit(0.5))).alias("sentence_dependency_distance"), r6(mean).alias("dependency_distance_mean"), r6(F.sqrt((F.sum("sxx") - n * mean * mean) / (n - 1))).alias("dependency_distance_sd"))


def finite_verb() -> Column:
    return F.coalesce(F.try_element_at("morph", F.lit("VerbForm")) == "Fin", F.lit(False))


def clauses(parses: DataFrame) -> DataFrame:
    """Rates of clause types per hundred sentences, finite clauses a sentence, coordination and subordination."""
    s = parses.groupBy("doc_id", "sent_idx").agg(
        one(finite_verb()).alias("finite"), *(one(F.col("dep").isin(v)).alias(k) for k, v in CLAUSES.items()), one(F.col("dep") == "conj").alias("coordination"), one(F.col("dep").isin(SUBORDINATE)).alias("subordination")
    )
    n = F.count(F.lit(1))
    return s.groupBy("doc_id").agg(
        n.alias("sentences"), r6(F.avg("finite")).alias("finite_clauses_per_sentence"), r6(100.0 * one(F.col("finite") == 1) / n).alias("single_clause_share"), r6(100.0 * one(F.col("finite") >= 3) / n).alias("multi_clause_share"),
        *(r6(100.0 * F.sum(k) / n).alias(f"{k}_rate") for k in CLAUSES), r6(100.0 * F.sum("coordination") / n).alias("coordination_rate"), r6(100.0 * F.sum("subordination") / n).alias("subordination_rate"),
        r6(F.when(F.sum("subordination") > 0, F.sum("coordination") / F.sum("subordination"))).alias("coordination_subordination_ratio"),
    )


def opening_patterns(parses: DataFrame) -> DataFrame:
    """Share of the commonest first two parts of speech with relations, and the entropy of these patterns."""
    w = words(parses)
    p = _sentences(w).select("doc_id", F.array_join(F.transform(F.slice("t", 1, 2), lambda x: F.concat_ws("+", x["pos"], x["dep"])), " ").alias("pattern"))
    top = p.groupBy("doc_id", "pattern").agg(F.count(F.lit(1)).alias("c")).groupBy("doc_id").agg(r6(100.0 * F.max("c") / F.sum("c")).alias("opening_top_share"))
    return top.join(stats.entropy_of_counts(p, ["doc_id"], "pattern").select("doc_id", r6("entropy").alias("opening_entropy")), "doc_id")


def nominalizations(parses: DataFrame) -> DataFrame:
    """Share of nouns with a nominal suffix."""
    n = parses.where("pos = 'NOUN'")
    return n.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nouns"), r6(100.0 * one(F.lower("lemma").rlike(NOMINAL)) / F.count(F.lit(1))).alias("nominalization_density"))


def tense(parses: DataFrame) -> DataFrame:
    """The dominant tense of finite verbs, its share, and changes of the dominant tense between sentences."""
    v = parses.where(finite_verb()).withColumn("tense", F.try_element_at("morph", F.lit("Tense"))).where(F.col("tense").isin("Past", "Pres"))
    s = v.groupBy("doc_id", "sent_idx").agg(one(F.col("tense") == "Past").alias("past"), F.count(F.lit(1)).alias("n"))
    s = s.withColumn("main", F.when(2 * F.col("past") > F.col("n"), "Past").when(2 * F.col("past") < F.col("n"), "Pres")).where("main is not null")
    s = s.withColumn("before", F.lag("main").over(Window.partitionBy("doc_id").orderBy("sent_idx")))
    n, past = F.count(F.lit(1)), one(F.col("main") == "Past")
    return s.groupBy("doc_id").agg(F.when(2 * past >= n, "Past").otherwise("Pres").alias("dominant_tense"), r6(100.0 * F.greatest(past, n - past) / n).alias("dominant_tense_share"), one(F.col("main") != F.col("before")).alias("tense_drift"))


def lemma_repetition(parses: DataFrame) -> DataFrame:
    """Median distance between uses of a content lemma in words, lemma-token ratio, commonest count."""
    w = words(parses).withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_idx", "tok_i"))).where(F.col("pos").isin(CONTENT))
    g = w.withColumn("gap", F.col("i") - F.lag("i").over(Window.partitionBy("doc_id", "lemma").orderBy("i")))
    top = w.groupBy("doc_id", "lemma").agg(F.count(F.lit(1)).alias("c")).groupBy("doc_id").agg(F.max("c").alias("top_lemma_count"), r6(100.0 * F.count(F.lit(1)) / F.sum("c")).alias("lemma_type_token_ratio"))
    return g.groupBy("doc_id").agg(r6(F.percentile("gap", F.lit(0.5))).alias("lemma_reuse_distance")).join(top, "doc_id")


def entities(parses: DataFrame) -> DataFrame:
    """Persons and pronouns per hundred words, and their ratio."""
    w = words(parses)
    n = F.count(F.lit(1))
    person, pron = one(F.col("ent").endswith("PERSON")), one(F.col("pos") == "PRON")
    return w.groupBy("doc_id").agg(r6(100.0 * person / n).alias("person_entity_rate"), r6(100.0 * pron / n).alias("pronoun_rate"), r6(F.when(pron > 0, person / pron)).alias("entity_pronoun_ratio"))


def entity_transitions(parses: DataFrame) -> DataFrame:
    """(doc_id, change, n): transitions of an entity's role (S, O, X or absent) from sentence to sentence."""
    role = F.when(F.col("dep").startswith("nsubj"), 3).when(F.col("dep").isin("obj", "dobj", "iobj"), 2).otherwise(1)
    m = parses.where(F.col("pos").isin("NOUN", "PROPN")).groupBy("doc_id", "sent_idx", F.lower("lemma").alias("e")).agg(F.max(role).alias("r"))
    span = m.groupBy("doc_id", "e").agg(F.min("sent_idx").alias("a"), F.max("sent_idx").alias("b")).where("b > a")
    grid = span.select("doc_id", "e", F.explode(F.sequence("a", "b")).alias("sent_idx")).join(m, ["doc_id", "e", "sent_idx"], "left")
    name = F.element_at(F.array(*map(F.lit, ("-", "X", "O", "S"))), F.coalesce("r", F.lit(0)) + 1)
    t = grid.withColumn("now", name).withColumn("before", F.lag("now").over(Window.partitionBy("doc_id", "e").orderBy("sent_idx"))).where("before is not null")
    return t.groupBy("doc_id", F.concat("before", "now").alias("change")).agg(F.count(F.lit(1)).alias("n"))
