"""Whole records harmonised: targets extracted, mapped to fields and terms, and written back into their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.functions.keys import collapse, harmonize_key
from tessera.operators import lookup, targets, writeback
from tessera.operators.skew import skew_join
from tessera.session import staged

#: Names of fields that are broadcast at most; more are joined by a shuffle.
NAMES = 200_000


def chosen_terms(labels: DataFrame, entries: DataFrame, text_hits: DataFrame | None = None) -> DataFrame:
    """(label, ontology_id, term_key, match_type): the term of every label that has one.

    Exact hits come first: the one with the best (index_rank, source_order), ties by ontology and key. A label without any
    takes its best hit of ``text_hits`` (label, ontology_id, term_key, score; smaller is better, rounded to 9 places), if given.
    """
    first = entries.dropna(subset=["lookup_key"]).groupBy("lookup_key").agg(F.min(F.struct("index_rank", "source_order", "ontology_id", "term_key")).alias("t"))
    keyed = labels.select("label").distinct().withColumn("lookup_key", harmonize_key(F.col("label")))
    found = skew_join(keyed, first, ["lookup_key"]).select("label", "t.ontology_id", "t.term_key", F.lit("exact").alias("match_type"))
    if text_hits is None:
        return found
    return found.unionByName(best_text(text_hits.join(found.select("label"), "label", "left_anti")))


def best_text(text_hits: DataFrame) -> DataFrame:
    """(label, ontology_id, term_key, match_type): the best hit of every label of ``text_hits``, ties by ontology and key."""
    best = Window.partitionBy("label").orderBy(F.round("score", 9), "ontology_id", "term_key")
    first = text_hits.withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    return first.select("label", "ontology_id", "term_key", F.lit("fts").alias("match_type"))


def promoted(found: DataFrame, terms: DataFrame) -> DataFrame:
    """Targets (with ontology_id, term_key and hz_label) whose hz_label is their term's title, blanks collapsed; a term without a title keeps the label."""
    titles = terms.select("ontology_id", "term_key", collapse(F.col("title")).alias("_title"), F.coalesce("accession", "id", "iri").alias("term_id"))
    return skew_join(found, titles, ["ontology_id", "term_key"], "left").withColumn("hz_label", F.coalesce(F.nullif("_title", F.lit("")), "hz_label")).drop("_title")


def harmonize(records: DataFrame, entries: DataFrame, terms: DataFrame, registry: DataFrame, text_hits=None, specs: list | None = None, key: str = "record_id", text: str = "metadata") -> tuple[DataFrame, DataFrame]:
    """(documents, targets): every record's targets with their field and term, and the records with the results written in.

    Targets are extracted from the default places (or ``specs``) and made one per document, field and label with all their
    occurrences (only where ``specs`` is not given). hz_field is the registered field of the name, else the normalised name;
    hz_label the title of the chosen term, else the normalised label. ``text_hits`` is a function from a table of labels
    without an exact hit to (label, ontology_id, term_key, score), or None. Results go back at every occurrence; empty
    fields and labels are not written. Records that are not JSON stay as they are. Terms are chosen once a label and joined to
    the targets as the results are read: what a result does not hold, such as occurrences, is not shuffled for it.
    """
    found = targets.extract_targets(records, key, text, specs)
    if specs is None:
        one = targets.dedupe_targets(found, key)
    else:
        paths = F.struct("pre_hz_field_path", "pre_hz_label_path", "parent_path")
        one = found.select(key, "id", "pre_hz_field", "pre_hz_label", F.lit(1).alias("n_occurrences"), F.array(paths).alias("occurrences"))
    one = staged(one, "targets")
    labels = staged(one.select(F.col("pre_hz_label").alias("label")).dropna().distinct(), "labels")
    chosen = staged(chosen_terms(labels, entries), "exact")
    if text_hits is not None:
        rest = labels.join(chosen.select("label"), "label", "left_anti")
        chosen = chosen.unionByName(staged(best_text(text_hits(rest)), "text"))
    titled = staged(promoted(chosen.withColumn("hz_label", harmonize_key(F.col("label"))), terms).withColumnRenamed("label", "pre_hz_label"), "chosen")
    met = skew_join(one, titled, ["pre_hz_label"], "left", deal=[key, "id"]).withColumn("hz_label", F.coalesce("hz_label", harmonize_key(F.col("pre_hz_label"))))
    fields = registry.select("field_id", F.first("canonical").over(Window.partitionBy("field_id").orderBy("ordinal")).alias("canonical")).distinct()
    names = staged(lookup.field_names(registry).join(fields, "field_id", "left"), "names")
    keyed = met.withColumn("name", harmonize_key(F.col("pre_hz_field")))
    named = keyed.join(F.broadcast(names), "name", "left") if names.count() <= NAMES else skew_join(staged(keyed, "met"), names, ["name"], "left")
    done = named.withColumn("hz_field", harmonize_key(F.coalesce("canonical", "pre_hz_field"))).drop("canonical", "name")
    results = done.filter("hz_field <> '' and hz_label <> ''").select(key, "id", "hz_field", "hz_label", "term_id", F.col("ontology_id").alias("onto"), F.explode("occurrences").alias("o"))
    order = F.struct(F.regexp_extract("id", "([0-9]+)$", 1).cast("int"), "o.pre_hz_label_path")
    results = results.select(key, order.alias("ordinal"), "o.pre_hz_field_path", "o.pre_hz_label_path", "o.parent_path", "hz_field", "hz_label", "term_id", "onto")
    return writeback.write_back(records, results, key, text), done


def semantic_view(done: DataFrame) -> DataFrame:
    """The three views of targets that a later judgement reads: field and label as they stand, both labels, and the source triple."""
    return done.select(
        "*", F.struct(F.coalesce("pre_hz_field", "hz_field").alias("field"), F.coalesce("pre_hz_label", "hz_label").alias("label")).alias("field_view"),
        F.struct(F.col("hz_label").alias("label"), "pre_hz_label").alias("label_view"), F.struct("id", "pre_hz_field", "pre_hz_label").alias("source_view"))


def stamped(hits: DataFrame, ontology_id: str, column: str = "hits") -> DataFrame:
    """Rows with ``ontology_id``, in the structs of an array column ``column`` too if there is one."""
    out = hits.withColumn("ontology_id", F.lit(ontology_id))
    if column in hits.columns:
        out = out.withColumn(column, F.transform(column, lambda h: h.withField("ontology_id", F.lit(ontology_id))))
    return out


def outcome_counts(outcomes: DataFrame, prunes: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, added, merged, rejected, pruned) of the outcomes of ``merged_additions`` and the prunes (key, target_id)."""
    n = lambda c: F.count_if(c)
    made = outcomes.groupBy(key).agg(n(F.col("outcome") == "added").alias("added"), n(F.col("outcome") == "merged").alias("merged"), n(~F.col("outcome").isin("added", "merged")).alias("rejected"))
    gone = prunes.select(key, "target_id").distinct().groupBy(key).agg(F.count("*").alias("pruned"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return made.join(gone, key, "full").select(key, *[zero(c) for c in ("added", "merged", "rejected", "pruned")])


def prune_reasons(targets_: DataFrame, prunes: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, target_id, ordinal, outcome) of prune proposals: pruned, duplicate_prune for a repeated one, unknown_target for an id the document has not."""
    known = targets_.select(key, F.col("id").alias("target_id"), F.lit(True).alias("_known")).distinct()
    j = prunes.select(key, "target_id", "ordinal").join(known, [key, "target_id"], "left")
    n = F.row_number().over(Window.partitionBy(key, "target_id").orderBy("ordinal"))
    return j.select(key, "target_id", "ordinal", F.when(F.col("_known").isNull(), "unknown_target").when(n > 1, "duplicate_prune").otherwise("pruned").alias("outcome"))
