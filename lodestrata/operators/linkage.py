"""Links between data sets: questions to answers, evidence to units, facts to units by lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestrata.functions.text import evidence_text, evidence_tokens, link_text, row_text
from lodestrata.operators.ranking import merged
from lodestrata.session import cut


def link_questions(records: DataFrame, known: DataFrame) -> DataFrame:
    """records with link_status and linked_id.

    records: (record_id, question, answer, ...), known: (example_id, question, answer, signature).
    exact: one known example has question and answer; equivalent: several of one signature, linked
    to the smallest id; ambiguous: several of different ones, or an unknown question;
    answer_mismatch: the question is known with other answers.
    """
    build = known.select("example_id", link_text(F.col("question")).alias("_q"), link_text(F.col("answer")).alias("_a"), "signature")
    exact = build.groupBy("_q", "_a").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(F.coalesce("signature", F.lit(""))).alias("_signatures"), F.min("example_id").alias("_id"))
    asked = build.select("_q").distinct().withColumn("_asked", F.lit(True))
    joined = records.withColumn("_q", link_text(F.col("question"))).withColumn("_a", link_text(F.col("answer"))).join(exact, ["_q", "_a"], "left").join(asked, "_q", "left")
    status = F.when(F.col("_n") == 1, "exact").when((F.col("_n") > 1) & (F.col("_signatures") == 1), "equivalent").when(F.col("_n") > 1, "ambiguous").when(F.col("_asked"), "answer_mismatch").otherwise("ambiguous")
    return joined.withColumn("link_status", status).withColumn("linked_id", F.when(F.col("link_status").isin("exact", "equivalent"), F.col("_id"))).drop("_q", "_a", "_n", "_signatures", "_id", "_asked")


#: Facts of a document from which its units meet them over rare words instead of each.
CROWDED = 200


def match_evidence(facts: DataFrame, units: DataFrame, minimum: float = 0.6) -> DataFrame:
    """(fact_id, chunk_id, chunk_index, score): the best unit of the fact's document for each fact.

    facts: (fact_id, document_id, evidence), units: (document_id, chunk_id, chunk_index, text). The
    score is 1 where the unit holds the evidence, else the share of its distinct words the unit
    holds; the lowest index wins a tie. Facts without words or below the minimum have no match.

    Units of a document meet each of its facts, and where it has more than CROWDED facts only those
    they may match.
    """
    f = cut(facts.where("fact_id IS NOT NULL").select("fact_id", "document_id", evidence_text(F.col("evidence")).alias("e")).withColumn("ew", evidence_tokens(F.col("e"))), release=True).where(F.size("ew") > 0)
    u = units.select("document_id", "chunk_id", "chunk_index", evidence_text(F.col("text")).alias("t")).withColumn("uw", evidence_tokens(F.col("t")))
    crowded = f.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED).select("document_id")
    any_crowded = not crowded.isEmpty()
    few = f.join(merged(crowded), "document_id", "left_anti") if any_crowded else f
    spaced = lambda words: F.concat(F.lit(" "), words, F.lit(" "))
    # one string of words, since arrays of them take several times the room
    both = u.select("document_id", "chunk_id", "chunk_index", "t", spaced(F.array_join("uw", " ")).alias("words")).join(merged(few), "document_id")
    scored = _best(both, F.size(F.filter("ew", lambda w: F.contains("words", spaced(w)))), minimum)
    if any_crowded:
        many = _met_by_rare_words(f.join(merged(crowded), "document_id", "left_semi"), u.join(merged(crowded), "document_id", "left_semi"), minimum)
        scored = scored.unionByName(_best(many, F.size(F.array_intersect("ew", "uw")), minimum))
    return scored.groupBy("fact_id").agg(F.min("b").alias("b")).select("fact_id", "b.chunk_id", "b.chunk_index", (-F.col("b.s")).alias("score"))


def _best(both: DataFrame, held: Column, minimum: float) -> DataFrame:
    """(fact_id, b) of pairs of facts and units that reach the minimum; the smallest b is the best."""
    scored = both.withColumn("score", F.when(F.contains("t", "e"), 1.0).otherwise(held / F.size("ew"))).where(F.col("score") >= minimum)
    return scored.select("fact_id", F.struct((-F.col("score")).alias("s"), "chunk_index", "chunk_id").alias("b"))


def _met_by_rare_words(f: DataFrame, u: DataFrame, minimum: float) -> DataFrame:
    """Pairs of facts and units of their document that may reach the minimum.

    Such a unit holds one of the fact's rarest words, of more than the share it may lack, so facts
    meet units over those only. Evidence of one or two words may also lie inside a longer word, so
    it meets all units of its document.
    """
    long = F.size(F.split("e", " ")) > 2
    words = u.select("document_id", "chunk_id", F.explode("uw").alias("word"))
    df = words.groupBy("document_id", "word").agg(F.count(F.lit(1)).alias("df"))
    asked = f.where(long).select("fact_id", "document_id", F.size("ew").alias("n"), F.explode("ew").alias("word")).join(merged(df), ["document_id", "word"], "left").fillna(0, ["df"])
    place = F.row_number().over(Window.partitionBy("fact_id", "document_id").orderBy("df", "word"))
    # evidence that lies in a unit may be cut at its two ends
    rare = asked.withColumn("place", place).where(F.col("place") <= F.greatest(F.floor((1 - minimum) * F.col("n") + 1e-9), F.lit(2)) + 1)
    met = rare.where("df > 0").join(merged(words), ["document_id", "word"]).select("fact_id", "document_id", "chunk_id").distinct()
    brief = f.where(~long).select("fact_id", "document_id").join(merged(u.select("document_id", "chunk_id")), "document_id")
    return met.unionByName(brief.select("fact_id", "document_id", "chunk_id")).join(merged(f), ["fact_id", "document_id"]).join(merged(u), ["document_id", "chunk_id"])


def lineage(units: DataFrame) -> DataFrame:
    """(chunk_id, document_id, element_id) of units with source_element_ids."""
    return units.select("chunk_id", "document_id", F.explode("source_element_ids").alias("element_id")).distinct()


def map_gold(facts: DataFrame, units: DataFrame, elements: DataFrame, complete: bool = True) -> DataFrame:
    """(fact_id, element_id, chunk_id, via) of each fact.

    facts: (fact_id, document_id, element_id). via is lineage where a unit of the document names the
    element, else parent where a unit that names its parent element holds its text, cell separators
    aside. Gold that nothing holds raises; with complete=False it is reported as unmapped, chunk_id null.
    """
    held = lineage(units).select("chunk_id", "document_id", "element_id")
    direct = facts.join(held, ["document_id", "element_id"], "left")
    found = direct.where(F.col("chunk_id").isNotNull()).select("fact_id", "element_id", "chunk_id", F.lit("lineage").alias("via"))
    open_facts = direct.where(F.col("chunk_id").isNull()).select("fact_id", "document_id", "element_id")
    parents = elements.where(F.col("parent_element_id").isNotNull()).select("element_id", "parent_element_id", row_text(F.col("source_text")).alias("row_text"))
    texts = units.select("chunk_id", row_text(F.col("text")).alias("unit_text"))
    above = open_facts.join(parents, "element_id").join(held.select("chunk_id", "document_id", F.col("element_id").alias("parent_element_id")), ["document_id", "parent_element_id"]).join(texts, "chunk_id")
    by_parent = above.where((F.col("row_text") != "") & F.contains("unit_text", "row_text")).select("fact_id", "element_id", "chunk_id", F.lit("parent").alias("via"))
    mapped = found.unionByName(by_parent)
    missing = facts.select("fact_id", "element_id").join(mapped, ["fact_id", "element_id"], "left_anti").withColumn("chunk_id", F.lit(None).cast("string")).withColumn("via", F.lit("unmapped"))
    if complete:
        missing = missing.withColumn("chunk_id", F.raise_error(F.concat(F.lit("no unit holds the gold element "), F.coalesce("element_id", F.lit("null")))).cast("string"))
    return mapped.unionByName(missing).distinct()


def context_of(facts: DataFrame, elements: DataFrame) -> DataFrame:
    """(query_id, context): the texts of a query's facts in order, each element once, under its key.

    facts: (query_id, position, source_key, element_id), elements: (element_id, source_text). A
    fact whose element is unknown raises.
    """
    first = Window.partitionBy("query_id", "element_id").orderBy("position")
    once = facts.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    joined = once.join(elements.select("element_id", "source_text"), "element_id", "left")
    text = F.coalesce(F.col("source_text"), F.raise_error(F.concat(F.lit("unknown element "), F.col("element_id"))).cast("string"))
    part = F.concat(F.lit("["), F.col("source_key"), F.lit("]\n"), text)
    parts = joined.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", part.alias("part")))).alias("parts"))
    return parts.select("query_id", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("context"))

