"""Queries of the curation operators, with their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import keys, text
from tessera.operators import catalog, fts, graph, harmonize, lookup, pool, registry, store, targets, vector, writeback
from tessera.operators.nested import flat_items
from tessera.sources import ontology
from tessera.session import shared_dir, staged, table

#: Keys of labels that say nothing.
EMPTY = ("", "n/a", "not_applicable", "unknown", "none", "missing")
TYPES, VOCAB = "http://types.terms.example/", "http://vocab.terms.example/"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "targets").select("target_id", F.col("pre_hz_label").alias("label"))


def harmonize_key(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("target_id", keys.harmonize_key(F.col("label")).alias("key"))


def key_twice(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("target_id", keys.harmonize_key(keys.harmonize_key(F.col("label"))).alias("key"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return ontology.payload_terms(table(spark, d, "terms"))


def typed_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("ontology_id", "term_key", "id", "accession", "iri", "title", "description", F.size("parents").alias("n_parents"), "deprecated")


def iri_parts(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("term_key", keys.accession_from_iri(F.col("iri")).alias("accession"), text.file_name(F.col("iri")).alias("file_name"), text.version_from_iri(F.col("iri")).alias("version"))


def term_hash(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("term_key", keys.term_key(F.col("accession"), F.col("iri")).alias("hash"))


def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    made = text.chunk_text(label=F.col("title"), exact_synonyms=F.array_join("synonyms.exact", "; "), description=F.col("description"), parents=F.array_join("parents", "; "))
    return _terms(spark, d).select("term_key", made.alias("chunk"))


def clipped_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", keys.clipped(F.col("text"), 500).alias("clipped"))


def exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    hits = lookup.exact_lookup(_labels(spark, d), table(spark, d, "lookup_entries"))
    return hits.select("target_id", "ontology_id", "term_key", "index_name", "index_rank", "position")


def exact_unique(spark: SparkSession, d: str) -> DataFrame:
    hits = lookup.exact_lookup(_labels(spark, d), table(spark, d, "lookup_entries"))
    return lookup.unique_hits(hits, ["target_id"])


def lookup_index(spark: SparkSession, d: str) -> DataFrame:
    """The lookup rows of the stored terms, made anew."""
    return ontology.lookup_entries(_terms(spark, d).withColumn("ordinal", F.lit(0))).select("index_name", "index_rank", "lookup_key", "term_key").distinct()


def _registry(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reference_values").filter("kind = 'field'").select(F.col("ref_id").alias("field_id"), F.col("ref_id").alias("ordinal"), "canonical", "aliases")


def field_resolve(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "targets").select("target_id", "pre_hz_field")
    return lookup.resolve_fields(values, _registry(spark, d), "pre_hz_field").select("target_id", "field_id")


def alias_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Every second entry claims the name of the entry before it, in other writing."""
    r = table(spark, d, "reference_values").select(F.col("ref_id").alias("field_id"), "canonical", "aliases")
    claims = r.filter("field_id % 2 = 0").select((F.col("field_id") + 1).alias("field_id"), F.concat(F.lit(" "), F.upper("canonical"), F.lit(".")).alias("canonical"), F.array().cast("array<string>").alias("aliases"))
    return lookup.alias_conflicts(r.unionByName(claims))


def local_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Terms known by one identifier, written in capitals, and some by title, filled from the store's terms that have a description."""
    local = _terms(spark, d).select("id", "accession", "iri", "title", "description", F.col("term_key").alias("ordinal"))
    by_iri, titled = F.length("ordinal") % 2 == 0, F.length("iri") % 3 == 0
    none = F.lit(None).cast("string")
    asked = local.select(F.col("ordinal").alias("key"), none.alias("id"), F.when(~by_iri, F.upper("accession")).alias("accession"), F.when(by_iri, F.upper("iri")).alias("iri"), F.when(titled, F.lit("own title")).alias("title"), none.alias("description"))
    return lookup.enriched(asked, local.filter("description is not null"), "key", ["title", "description"]).select("key", "title", "description")


def decision_match(spark: SparkSession, d: str) -> DataFrame:
    """Every label's decision names the last of its exact hits by IRI."""
    hits = exact_lookup(spark, d).join(_terms(spark, d).select("ontology_id", "term_key", "id", "accession", "iri"), ["ontology_id", "term_key"])
    candidates = staged(hits.withColumn("position", F.concat_ws(" ", "ontology_id", F.lpad(F.col("position").cast("string"), 9, "0"))), "candidates")
    return lookup.chosen(candidates.groupBy("target_id").agg(F.max("iri").alias("decision")), candidates, ["target_id"]).select("target_id", "decision", "ontology_id", "term_key")


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "targets").withColumnRenamed("target_id", "ordinal")


def dedupe_targets(spark: SparkSession, d: str) -> DataFrame:
    return targets.dedupe_targets(_targets(spark, d)).select("record_id", "id", "pre_hz_field", "pre_hz_label", "n_occurrences")


def occurrence_union(spark: SparkSession, d: str) -> DataFrame:
    kept = targets.distinct_occurrences(_targets(spark, d), ["record_id"], "ordinal")
    return kept.select("record_id", F.col("ordinal").alias("target_id"))


def extract_targets(spark: SparkSession, d: str) -> DataFrame:
    return targets.extract_targets(table(spark, d, "miniml_records"))


def scalar_walk(spark: SparkSession, d: str) -> DataFrame:
    return targets.extract_targets(table(spark, d, "miniml_records"), specs=[("", "scalar")])


def target_additions(spark: SparkSession, d: str) -> DataFrame:
    t = _targets(spark, d)
    source = F.when(F.col("ordinal") % 7 == 0, F.lit("target-x")).otherwise(F.col("id"))
    proposals = t.select("record_id", "ordinal", source.alias("source_target_id"), F.concat(F.col("pre_hz_label"), F.when(F.col("ordinal") % 3 == 0, "").otherwise(" part")).alias("label"), F.col("pre_hz_field").alias("field_hint"))
    return targets.merged_additions(proposals, t, per_source=1)


def target_prunes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "targets")
    empty = t.filter(keys.harmonize_key(F.col("pre_hz_label")).isin(*EMPTY)).select("record_id", F.col("id").alias("target_id"))
    return targets.pruned(t, empty).select("target_id")


def free_target_ids(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "targets")
    return targets.free_ids(t.select("record_id", "id"), t.filter("hz_label is not null").select("record_id", F.col("target_id").alias("ordinal")))


def metadata_context(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "miniml_records")
    series = flat_items(records, entities=("series",)).filter(~F.col("item_path").rlike("/series/[0-9]+$"))
    title = F.col("cells")[F.lit("title")]
    titles = series.filter(keys.collapse(title) != "").groupBy("record_id").agg(F.min_by(title, F.col("ordinal")).alias("title"))
    found = targets.extract_targets(records).select("record_id", "pre_hz_field", "pre_hz_label", "ordinal")
    return targets.context_text(found.join(titles, "record_id", "full"))


def write_back(spark: SparkSession, d: str) -> DataFrame:
    """The stored results with the term of their label, where it has exactly one."""
    t = table(spark, d, "targets").select("record_id", F.col("target_id").alias("ordinal"), "pre_hz_field_path", "pre_hz_label_path", "parent_path", "hz_field", "hz_label")
    hits = lookup.exact_lookup(t.filter("hz_label is not null").select("ordinal", F.col("hz_label").alias("label")), table(spark, d, "lookup_entries"))
    terms = lookup.unique_hits(hits, ["ordinal"]).select("ordinal", F.col("term_key").alias("term_id"), F.col("ontology_id").alias("onto"))
    return writeback.write_back(table(spark, d, "miniml_records"), t.join(terms, "ordinal", "left"))


def json_pointer(spark: SparkSession, d: str) -> DataFrame:
    """The value each target's label was read from, and that of the member after a missing name."""
    paths = table(spark, d, "targets").select("record_id", F.explode(F.array("pre_hz_label_path", F.concat("parent_path", F.lit("/no such")))).alias("path"))
    return targets.resolved_values(table(spark, d, "miniml_records"), paths)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.concat(F.lit("onto_"), F.col("label")).alias("ontology_id"), F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("term_key"), F.col("embedding").alias("vector"))


def _near(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    queries = table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector.top_k(queries, _vectors(spark, d), k)


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).select("query_id", "ontology_id", "term_key", F.round("score", 6).alias("score"), "position")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    near = _near(spark, d)
    return near.withColumn("framework_rank", F.regexp_extract("ontology_id", "([0-9]+)$", 1).cast("int")).withColumn("identity", F.col("term_key"))


def balanced_pool(spark: SparkSession, d: str) -> DataFrame:
    return pool.balanced_pool(_hits(spark, d), default=0.0).select("query_id", "ontology_id", "term_key", "pool_rank")


def preferred_pool(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d).select("query_id", "ontology_id", "term_key", (F.col("framework_rank") * 1000 + F.col("position")).alias("position"))
    return pool.preferred_pool(hits, ["onto_7", "onto_3"], 10).select("query_id", "ontology_id", "term_key", "pool_rank")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    terms = _terms(spark, d).select("ontology_id", "term_key", F.array_union(F.coalesce("parents", F.array().cast("array<string>")), F.coalesce("parent_iris", F.array().cast("array<string>"))).alias("refs"))
    return graph.edges(terms, table(spark, d, "lookup_entries"))


def hierarchy_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seeds, links and vectors of a fixed tree over the embeddings: in every label, the k-th row's parent is the k/2-th."""
    vectors = staged(_vectors(spark, d), "vectors")
    from pyspark.sql import Window

    k = vectors.select("ontology_id", "term_key", F.row_number().over(Window.partitionBy("ontology_id").orderBy("term_key")).alias("k"))
    links = k.select("ontology_id", F.col("term_key").alias("child"), F.floor(F.col("k") / 2).alias("p")).join(k.select("ontology_id", F.col("term_key").alias("parent"), F.col("k").alias("p")), ["ontology_id", "p"]).drop("p")
    queries = table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    seeds = _near(spark, d, 2).select("query_id", "ontology_id", "term_key").join(queries, "query_id")
    return seeds, staged(links, "links"), vectors


def hierarchy_relatives(spark: SparkSession, d: str) -> DataFrame:
    seeds, links, vectors = _tree(spark, d)
    up, down = graph.relatives(seeds, links, vectors, 2, "parent"), graph.relatives(seeds, links, vectors, 1, "child")
    return up.unionByName(down).withColumn("score", F.round("score", 6))


def hierarchy_pick(spark: SparkSession, d: str) -> DataFrame:
    seeds, links, vectors = _tree(spark, d)
    found = graph.relatives(seeds, links, vectors, 2, "parent").unionByName(graph.relatives(seeds, links, vectors, 1, "child"))
    return graph.pick_relatives(seeds, found.filter(F.col("score") >= graph.relatives_threshold(F.lit(0.0)))).withColumn("score", F.round("score", 6))


FTS_COLUMNS = ["title", "synonyms", "description", "identifiers"]


def _documents(spark: SparkSession, d: str) -> DataFrame:
    made = text.index_text(F.col("title"), F.concat(F.coalesce("synonyms.exact", F.array().cast("array<string>")), F.coalesce("synonyms.related", F.array().cast("array<string>"))), F.col("description"), F.array_compact(F.array("id", "accession", "iri")))
    return _terms(spark, d).select("ontology_id", "term_key", made.alias("x")).select("ontology_id", "term_key", "x.*")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The searches: labels of the targets whose id is divisible by 100."""
    return table(spark, d, "targets").filter("target_id % 100 = 0 and pre_hz_label is not null").select(F.col("target_id").alias("query_id"), F.col("pre_hz_label").alias("label"))


def _store(spark: SparkSession, d: str) -> str:
    """The folder of the stored indexes of a data folder's ontologies; made once per application."""
    folder = f"{shared_dir(spark)}/store-{hashlib.md5(d.encode()).hexdigest()[:12]}"
    if not store.exists(spark, folder, "manifest"):
        terms = table(spark, d, "terms")
        manifest = terms.groupBy("ontology_id").agg(F.count("*").alias("size"), F.max(F.unix_micros("indexed_at")).alias("mtime_ns")).select("ontology_id", F.concat(F.lit("/"), "ontology_id").alias("path"), "size", "mtime_ns", F.lit("json").alias("kind"))
        store.write(folder, terms, table(spark, d, "lookup_entries"), manifest, _documents(spark, d), FTS_COLUMNS)
    return folder


def _searched(spark: SparkSession, d: str, asked: DataFrame, top: int = 25) -> DataFrame:
    return fts.search_index(asked, *store.text_index(spark, _store(spark, d)), top=top)


def fts_or(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d, _asked(spark, d)).withColumn("score", F.round("score", 6))


def fts_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Titles of terms as underscored keys, each one phrase with a prefix at its end."""
    asked = _terms(spark, d).select(F.col("term_key").alias("query_id"), keys.harmonize_key(F.col("title")).alias("label"))
    return _searched(spark, d, asked).withColumn("score", F.round("score", 6))


def exact_then_fts(spark: SparkSession, d: str) -> DataFrame:
    asked = _asked(spark, d)
    exact = staged(lookup.exact_lookup(asked, table(spark, d, "lookup_entries")).select("query_id", "ontology_id", "term_key", "position"), "exact")
    return fts.exact_or_text(exact, _searched(spark, d, asked.join(exact.select("query_id").distinct(), "query_id", "left_anti")))


def store_refresh(spark: SparkSession, d: str) -> DataFrame:
    """A store kept up to date: built, one ontology gone, one that fails, one changed; what it holds after each step."""
    folder = f"{shared_dir(spark)}/refresh-{uuid.uuid4().hex[:8]}"
    terms, entries, text_ = table(spark, d, "terms"), table(spark, d, "lookup_entries"), staged(_documents(spark, d), "documents")
    sources = staged(terms.groupBy("ontology_id").agg(F.count("*").alias("size")).select("ontology_id", F.concat(F.lit("/"), "ontology_id").alias("path"), "size", F.lit(1).cast("long").alias("mtime_ns"), F.lit("json").alias("kind")), "sources")

    def load(name):
        if name == "fails":
            raise ValueError("this ontology cannot be read")
        return tuple(df.filter(F.col("ontology_id") == name) for df in (terms, entries, text_))

    out = None
    names = [r["ontology_id"] for r in sources.orderBy("ontology_id").collect()]  # one row per ontology
    broken = spark.createDataFrame([("fails", "/fails", 1, 1, "json")], sources.schema)
    later = sources.filter(F.col("ontology_id") != names[0]).withColumn("mtime_ns", F.when(F.col("ontology_id") == names[1], 2).otherwise(F.col("mtime_ns")))
    for step, now in enumerate((sources.unionByName(broken), later)):
        report = store.refresh(spark, folder, now, load, FTS_COLUMNS)
        held = store.read(spark, folder, "postings").groupBy("ontology_id").agg(F.count_distinct("term_key").alias("terms"))
        made = staged(report.join(held, "ontology_id", "left").select(F.lit(step).alias("step"), "ontology_id", "status", "error", F.coalesce("terms", F.lit(0)).alias("terms")), "report")
        out = made if out is None else out.unionByName(made)
    return out


def _harmonized(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Of text hits only the first of every label and ontology are asked for, as only the best of all is taken."""
    hits = lambda labels: _searched(spark, d, labels.withColumn("query_id", F.col("label")), 1).select(F.col("query_id").alias("label"), "ontology_id", "term_key", "score")
    return harmonize.harmonize(table(spark, d, "miniml_records"), table(spark, d, "lookup_entries"), _terms(spark, d), _registry(spark, d), hits)


def harmonized_documents(spark: SparkSession, d: str) -> DataFrame:
    return _harmonized(spark, d)[0]


def harmonized_targets(spark: SparkSession, d: str) -> DataFrame:
    return _harmonized(spark, d)[1].select("record_id", "id", "pre_hz_field", "pre_hz_label", "n_occurrences", "hz_field", "hz_label", "ontology_id", "term_key", "match_type")


def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    empty = table(spark, d, "targets").filter(keys.harmonize_key(F.col("pre_hz_label")).isin(*EMPTY)).select("record_id", F.col("id").alias("target_id"))
    return harmonize.outcome_counts(target_additions(spark, d), empty)


def prune_outcomes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "targets")
    asked = t.filter("target_id % 3 = 0").select("record_id", F.when(F.col("target_id") % 9 == 0, "target-x").otherwise(F.col("id")).alias("target_id"), F.col("target_id").alias("ordinal"))
    again = asked.filter("ordinal % 2 = 0").withColumn("ordinal", -F.col("ordinal"))
    return harmonize.prune_reasons(t, asked.unionByName(again))


def candidate_ontologies(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "targets").select("target_id", F.when(F.col("target_id") % 2 == 0, F.array(F.lit("zute"), F.lit("none"), F.lit("anth"), F.lit("zute"))).alias("configured"))
    names = table(spark, d, "terms").groupBy("ontology_id").agg(F.min("term_key").alias("ordinal")).withColumn("has_file", F.col("ontology_id") != "kesp")
    return registry.candidate_ontologies(t, names)


def field_registry(spark: SparkSession, d: str) -> DataFrame:
    """Registered fields with a clash, a repeat and a review, listed by status."""
    new = _registry(spark, d).select(F.col("canonical").alias("field_id"), "canonical", "aliases", F.lit("").alias("description"), F.lit(None).cast("string").alias("review_status"))
    empty = spark.createDataFrame([], "field_id string, canonical string, aliases array<string>, description string, review_status string, created_at timestamp, updated_at timestamp")
    first, _ = registry.put_fields(empty, new, "2026-01-01 00:00:00")
    more = new.select(F.concat(F.lit("new "), "field_id").alias("field_id"), "canonical", "aliases", "description", "review_status").unionByName(new.withColumn("review_status", F.lit("odd")))
    second, rejected = registry.put_fields(staged(first, "fields"), more, "2026-01-02 00:00:00")
    reviewed = registry.set_review_status(second, new.filter(F.length("canonical") % 2 == 0).select("field_id", F.lit("reviewed").alias("review_status")), "2026-01-03 00:00:00")
    return reviewed.select("field_id", F.col("review_status").alias("state")).unionByName(rejected.select("field_id", F.col("reason").alias("state")))


def term_chunks(spark: SparkSession, d: str) -> DataFrame:
    synonyms = F.concat(F.coalesce("synonyms.exact", F.array().cast("array<string>")), F.coalesce("synonyms.related", F.array().cast("array<string>")))
    return _terms(spark, d).select("term_key", text.term_chunk(F.col("ontology_id"), F.col("title"), synonyms, F.col("description"), keys.truthy(F.col("accession"), F.col("id")), F.col("iri")).alias("chunk"))


def _pivoted(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators.wide import expand, namespaces_of

    names = namespaces_of(table(spark, d, "prefixes"))
    t = table(spark, d, "triples").withColumn("predicate", expand(F.col("predicate"), names)).withColumn("object_value", F.when(F.col("object_type") == "uri", expand(F.col("object_value"), names)).otherwise(F.col("object_value")))
    return ontology.pivot_terms(ontology.class_triples(t, TYPES + "rdf#type", TYPES + "owl#Class"), {"title": TYPES + "rdfs#label"}, {"exact": VOCAB + "syn/exact", "parent_iris": TYPES + "rdfs#subClassOf"}, [TYPES + "rdf#type"])


def triple_terms(spark: SparkSession, d: str) -> DataFrame:
    return _pivoted(spark, d).select("subject", "title", F.array_join("exact", "|").alias("exact"), F.array_join("parent_iris", "|").alias("parent_iris"))


def triple_properties(spark: SparkSession, d: str) -> DataFrame:
    return _pivoted(spark, d).select("subject", F.explode("properties").alias("predicate", "v")).select("subject", "predicate", F.array_join("v", "|").alias("property_values"))


def cache_live(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_type").alias("provider"), "user_id", F.col("ts").alias("created_at"), "event_id", "props")
    now = rows.agg(F.max("created_at").cast("string")).first()[0]
    return catalog.cached(rows, ["provider", "user_id"], now, 604_800, tie="event_id").select("provider", "user_id", "event_id", "props")


def freshness_diff(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "terms").groupBy("ontology_id").agg(F.count("*").alias("size"), F.max(F.unix_micros("indexed_at")).alias("mtime_ns")).select("ontology_id", F.concat(F.lit("/"), "ontology_id").alias("path"), "size", "mtime_ns", F.lit("json").alias("kind"))
    before = base.filter("ontology_id <> 'anth'").withColumn("size", F.when(F.col("ontology_id") == "kesp", F.lit(0)).otherwise(F.col("size")))
    return catalog.stale(base.filter("ontology_id <> 'zute'"), before)


def framework_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.counts(table(spark, d, "terms"), table(spark, d, "lookup_entries"))


def html_sniff(spark: SparkSession, d: str) -> DataFrame:
    """Texts, every third of them as a page and every other third as one after an XML declaration."""
    body = F.coalesce("text", F.lit(""))
    page = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  <!DOCTYPE html><p>"), body)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("<?xml version='1.0'?>\n<HTML>"), body)).otherwise(body)
    return table(spark, d, "documents").select("doc_id", text.looks_like_html(page).alias("is_html"))


def query_validate(spark: SparkSession, d: str) -> DataFrame:
    asked = F.when(F.col("doc_id") % 5 == 0, F.concat("edit_comment", F.lit(" [Dataset]"))).otherwise(F.col("edit_comment"))
    return text.valid_queries(table(spark, d, "documents").select("page_id", asked.alias("query")), "page_id")


_ALL = (harmonize_key, key_twice, typed_terms, iri_parts, term_hash, chunk_text, clipped_text, exact_lookup, exact_unique, lookup_index, field_resolve, alias_conflicts, local_enrichment, decision_match, dedupe_targets, occurrence_union,
        extract_targets, scalar_walk, target_additions, target_prunes, free_target_ids, metadata_context, write_back, json_pointer, vector_topk, balanced_pool, preferred_pool, hierarchy_edges, hierarchy_relatives, hierarchy_pick, fts_or,
        fts_phrase, exact_then_fts, triple_terms, triple_properties, cache_live, freshness_diff, framework_counts, html_sniff, query_validate,
        store_refresh, harmonized_documents, harmonized_targets, outcome_counts, prune_outcomes, candidate_ontologies, field_registry, term_chunks)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


_SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
_PUNCT = r"[!-/:-@\[-`{-~]"


def sql_key(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower({x}), '^{_SPACE}+|{_SPACE}+$', '', 'g'), '^{_PUNCT}+|{_PUNCT}+$', '', 'g'), '{_SPACE}+', '_', 'g')"


def _flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}+', ' ', 'g'))"


_TERMS = """typed as (select ontology_id, term_key, payload ->> '$.id' as id, payload ->> '$.accession' as accession, payload ->> '$.iri' as iri, payload ->> '$.title' as title,
  case when json_type(payload, '$.description') = 'ARRAY' then array_to_string(cast(payload -> '$.description' as varchar[]), ' ') else payload ->> '$.description' end as description,
  cast(payload -> '$.parents' as varchar[]) as parents, cast(payload -> '$.parent_iris' as varchar[]) as parent_iris,
  cast(payload -> '$.synonyms.exact' as varchar[]) as exact, cast(payload -> '$.synonyms.related' as varchar[]) as related, cast(payload -> '$.deprecated' as boolean) as deprecated from terms)"""

_HITS = f"""keyed as (select target_id, {sql_key('pre_hz_label')} as lookup_key from targets),
best as (select *, row_number() over (partition by ontology_id, lookup_key, term_key order by index_rank, source_order, index_name) as n from lookup_entries where lookup_key is not null),
placed as (select ontology_id, lookup_key, term_key, index_name, index_rank, row_number() over (partition by ontology_id, lookup_key order by index_rank, source_order, term_key) as position from best where n = 1)"""

_NEAR = """v as (select 'onto_' || label as ontology_id, lpad(cast(vec_id as varchar), 9, '0') as term_key, cast(embedding as double[]) as vector, label from embeddings),
q as (select vec_id as query_id, cast(embedding as double[]) as vector from embeddings where vec_id % 100 = 0),
s as (select q.query_id, v.ontology_id, v.term_key, v.label, list_cosine_similarity(q.vector, v.vector) as score from q, v),
near as (select *, row_number() over (partition by query_id, ontology_id order by score desc, term_key) as position from s qualify position <= 10)"""

_TRIPLE = """named as (select t.subject, t.object_type, coalesce(p.namespace || substr(t.predicate, length(p.prefix) + 2), t.predicate) as predicate,
  coalesce(o.namespace || substr(t.object_value, length(o.prefix) + 2), t.object_value) as object_value
  from triples t left join prefixes p on starts_with(t.predicate, p.prefix || ':') left join prefixes o on t.object_type = 'uri' and starts_with(t.object_value, o.prefix || ':')),
mine as (select * from named where subject in (select subject from named where predicate = 'http://types.terms.example/rdf#type' and object_value = 'http://types.terms.example/owl#Class'))"""

_EXTRACTED = r"""
with recursive tree as (
  select r.record_id, t.id, t.parent, t.key, left(t.type, 1) as kind, case when t.type in ('OBJECT', 'ARRAY', 'NULL') then null when t.type = 'BOOLEAN' then case t.atom ->> '$' when 'true' then 'True' else 'False' end else t.atom ->> '$' end as atom
  from (select record_id, metadata from miniml_records where json_valid(metadata)) r, json_tree(r.metadata) t),
members as (select record_id, parent as id, max(atom) filter (key = 'tag') as tag, max(atom) filter (key = 'value') as value from tree where parent is not null group by 1, 2),
placed as (
  select t.record_id, t.id, t.kind, t.atom, '' as ptr, '' as above, t.kind as kinds, cast(null as varchar) as start, false as done, m.tag, m.value
  from tree t left join members m using (record_id, id) where t.parent is null
  union all
  select record_id, id, kind, atom, ptr, above, kinds, coalesce(was, case when (upper_kinds = 'OAOAO' and regexp_full_match(ptr, '/sample/[0-9]+/channel/[0-9]+/(source|molecule|organism|characteristics)'))
      or (upper_kinds = 'AOAOAO' and regexp_full_match(ptr, '/[0-9]+/sample/[0-9]+/channel/[0-9]+/(source|molecule|organism|characteristics)')) then ptr end) as start, done, tag, value
  from (select t.record_id, t.id, t.kind, t.atom, p.ptr || '/' || replace(replace(t.key, '~', '~0'), '/', '~1') as ptr, p.ptr as above, p.kinds as upper_kinds, p.kinds || t.kind as kinds, p.start as was,
      p.done or (p.start is not null and p.kind = 'O' and p.value is not null and (p.tag is not null or ends_with(p.start, '/organism'))) as done, case when t.kind = 'O' then m.tag end as tag, case when t.kind = 'O' then m.value end as value
    from placed p join tree t on t.record_id = p.record_id and t.parent = p.id left join members m on m.record_id = t.record_id and m.id = t.id)),
found as (
  select *, regexp_extract(start, '([a-z]+)$', 1) as field, list_transform(regexp_extract_all(start, '[0-9]+'), lambda x: cast(x as int)) as place from placed where start is not null and not done),
targets_ as (
  select record_id, id, place, case field when 'source' then 0 else 1 end as rank, field as pre_hz_field, atom as pre_hz_label, ptr as pre_hz_field_path, ptr as pre_hz_label_path, above as parent_path from found where field in ('source', 'molecule') and ptr = start and atom is not null
  union all select record_id, id, place, 2, field, value, start, ptr || '/value', ptr from found where field = 'organism' and kind = 'O' and value is not null
  union all select record_id, id, place, 3, tag, value, ptr || '/tag', ptr || '/value', ptr from found where field = 'characteristics' and kind = 'O' and tag is not null and value is not null)
select record_id, 'target-' || n as id, 'metadata' as source, pre_hz_field, pre_hz_label, pre_hz_field_path, pre_hz_label_path, parent_path, n as ordinal
from (select *, cast(row_number() over (partition by record_id order by place, rank, id) - 1 as int) as n from targets_)
"""

_TOKENS = r"regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[\p{{L}}\p{{N}}]+')"


def oracle_sql() -> dict[str, str]:
    joined = lambda *c: ", ".join(c)
    tok = lambda c: _TOKENS.format(c)
    cols = (tok("title"), tok("array_to_string(list_concat(coalesce(exact, []), coalesce(related, [])), ' ')"), tok("description"), tok("concat_ws(' ', id, accession, iri)"))
    docs = "docs as (select ontology_id, term_key, [" + joined(*cols) + "] as cs, len(flatten([" + joined(*cols) + "])) as size from typed), totals as (select count(*) as n, avg(size) as mean from docs)"
    scored = """df as (select p, count(*) as df from hits group by 1),
scored as (select h.*, -(case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d.size / mean)) as s from hits h join df using (p) join docs d using (ontology_id, term_key), totals),
best as (select query_id, ontology_id, term_key, sum(s * times) as score from words join scored using (p) group by 1, 2, 3),
ranked as (select *, row_number() over (partition by query_id, ontology_id order by round(score, 9), term_key) as position from best qualify position <= 25)"""
    hits = """hits as (select * from (select w.p, d.ontology_id, d.term_key, list_sum(list_transform(d.cs, lambda t: len(list_filter(range(1, len(t) - len(w.p) + 2), lambda i: (len(w.p) = 1 or t[i:i + len(w.p) - 2] = w.p[1:len(w.p) - 1]) and starts_with(t[i + len(w.p) - 1], w.p[len(w.p)]))))) as f from (select distinct p from words) w, docs d) where f > 0)"""
    tree = """k as (select ontology_id, term_key, vector, row_number() over (partition by ontology_id order by term_key) as k from v),
seeds as (select near.query_id, near.ontology_id, k.term_key as seed, k.k, q.vector from near join k using (ontology_id, term_key) join q using (query_id) where position <= 2),
reached as (select s.query_id, s.ontology_id, s.seed, 'parent' as relation, 1 as depth, k.term_key, k.vector as v, s.vector from seeds s join k on k.ontology_id = s.ontology_id and k.k = s.k // 2
  union all select s.query_id, s.ontology_id, s.seed, 'parent', 2, k.term_key, k.vector, s.vector from seeds s join k on k.ontology_id = s.ontology_id and k.k = s.k // 4 and s.k > 1
  union all select s.query_id, s.ontology_id, s.seed, 'child', 1, k.term_key, k.vector, s.vector from seeds s join k on k.ontology_id = s.ontology_id and k.k // 2 = s.k),
relatives as (select query_id, ontology_id, seed, relation, depth, term_key, round(list_cosine_similarity(vector, v), 6) as score from reached r
  where not exists (select 1 from seeds o where o.query_id = r.query_id and o.ontology_id = r.ontology_id and o.seed = r.term_key)
  qualify row_number() over (partition by query_id, ontology_id, seed, relation, depth order by list_cosine_similarity(vector, v) desc, term_key) = 1)"""
    out = {
        "hierarchy_relatives": f"with {_NEAR}, {tree} select * from relatives",
        "fts_phrase": f"""with {_TERMS}, {docs},
words as (select query_id, {tok('w')} as p, count(*) as times from (select term_key as query_id, unnest(regexp_extract_all(lower({sql_key('title')}), '[\\p{{L}}\\p{{N}}_]+')) as w from typed) group by 1, 2),
{hits}, {scored} select query_id, ontology_id, term_key, round(score, 6) as score, position from ranked""",
        "exact_then_fts": f"""with {_TERMS}, {docs},
asked as (select target_id as query_id, pre_hz_label as label from targets where target_id % 100 = 0 and pre_hz_label is not null),
keyed as (select query_id, {sql_key('label')} as lookup_key from asked),
once as (select *, row_number() over (partition by ontology_id, lookup_key, term_key order by index_rank, source_order, index_name) as n from lookup_entries where lookup_key is not null),
placed as (select ontology_id, lookup_key, term_key, row_number() over (partition by ontology_id, lookup_key order by index_rank, source_order, term_key) as position from once where n = 1),
exact_hits as (select query_id, ontology_id, term_key, position from keyed join placed using (lookup_key)),
words as (select query_id, {tok('w')} as p, count(*) as times from (select query_id, unnest(regexp_extract_all(lower(label), '[\\p{{L}}\\p{{N}}_]+')) as w from asked) group by 1, 2),
{hits}, {scored} select *, 'exact' as match_type from exact_hits union all select query_id, ontology_id, term_key, position, 'fts' from ranked where query_id not in (select query_id from exact_hits)""",
        "harmonize_key": f"select target_id, {sql_key('pre_hz_label')} as key from targets",
        "key_twice": f"select target_id, {sql_key(sql_key('pre_hz_label'))} as key from targets",
        "typed_terms": f"with {_TERMS} select ontology_id, term_key, id, accession, iri, title, description, len(parents) as n_parents, deprecated from typed",
        "iri_parts": f"with {_TERMS} select term_key, case when regexp_full_match(regexp_extract(iri, '([^/#]*)$', 1), '[A-Za-z][A-Za-z0-9]*_.+') then regexp_replace(regexp_extract(iri, '([^/#]*)$', 1), '^([A-Za-z][A-Za-z0-9]*)_', '\\1:') end as accession, nullif(regexp_extract(iri, '^[a-z]+://[^/]+/(?:.*/)?([^/?#]+)', 1), '') as file_name, nullif(regexp_extract(iri, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '') as version from typed",
        "term_hash": f"""with {_TERMS} select term_key, sha256('{{"accession":' || coalesce(cast(to_json(accession) as varchar), 'null') || ',"iri":' || coalesce(cast(to_json(iri) as varchar), 'null') || '}}') as hash from typed""",
        "chunk_text": f"with {_TERMS} select term_key, concat_ws(chr(10), case when trim(title) <> '' then 'label: ' || title end, case when len(exact) > 0 then 'exact synonyms: ' || array_to_string(exact, '; ') end, case when trim(description) <> '' then 'description: ' || description end, case when len(parents) > 0 then 'parents: ' || array_to_string(parents, '; ') end) as chunk from typed",
        "clipped_text": f"select doc_id, case when length({_flat('text')}) > 500 then substr({_flat('text')}, 1, 499) || '…' else {_flat('text')} end as clipped from documents",
        "exact_lookup": f"with {_HITS} select k.target_id, p.ontology_id, p.term_key, p.index_name, p.index_rank, p.position from keyed k join placed p using (lookup_key)",
        "exact_unique": f"with {_HITS} select target_id, min(ontology_id) as ontology_id, min(term_key) as term_key from keyed join placed using (lookup_key) group by 1 having count(distinct ontology_id || ' ' || term_key) = 1",
        "lookup_index": f"with {_TERMS} select distinct x.* from (select 'label' as index_name, 0 as index_rank, {sql_key('title')} as lookup_key, term_key from typed where title is not null union all select 'id', 1, {sql_key('id')}, term_key from typed where id is not null union all select 'accession', 2, {sql_key('accession')}, term_key from typed where accession is not null union all select 'iri', 3, {sql_key('iri')}, term_key from typed where iri is not null) x",
        "field_resolve": f"""with names as (select {sql_key('n')} as name, arg_min(ref_id, ref_id) as field_id from (select ref_id, unnest(list_concat([cast(ref_id as varchar), canonical], coalesce(aliases, []))) as n from reference_values where kind = 'field') group by 1)
select t.target_id, n.field_id from targets t left join names n on n.name = {sql_key('t.pre_hz_field')}""",
        "alias_conflicts": f"select name, count(distinct ref_id) as fields from (select ref_id, {sql_key('n')} as name from (select ref_id, unnest(list_concat([canonical], coalesce(aliases, []))) as n from reference_values union all select ref_id + 1, ' ' || upper(canonical) || '.' from reference_values where ref_id % 2 = 0)) group by 1 having count(distinct ref_id) > 1",
        "local_enrichment": f"""with {_TERMS}, asked as (select term_key as key, case when length(term_key) % 2 = 0 then upper(iri) else upper(accession) end as x, case when length(iri) % 3 = 0 then 'own title' end as title from typed),
known as (select unnest([id, accession, iri]) as i, term_key, title, description from typed where description is not null),
met as (select a.key, min(k.term_key) as term_key from asked a join known k on lower(trim(k.i)) = lower(trim(a.x)) group by 1)
select a.key, coalesce(a.title, t.title) as title, t.description from asked a left join met m using (key) left join typed t on t.term_key = m.term_key""",
        "decision_match": f"""with {_TERMS}, {_HITS}, hits as (select k.target_id, p.ontology_id, p.term_key, p.position, t.iri from keyed k join placed p using (lookup_key) join typed t on t.ontology_id = p.ontology_id and t.term_key = p.term_key),
d as (select target_id, max(iri) as decision from hits group by 1)
select d.target_id, d.decision, h.ontology_id, h.term_key from d join hits h on h.target_id = d.target_id and h.iri = d.decision qualify row_number() over (partition by d.target_id order by h.ontology_id, h.position) = 1""",
        "extract_targets": _EXTRACTED,
        "outcome_counts": f"""with o as (ADDITIONS), a as (select record_id, count_if(outcome = 'added') as added, count_if(outcome = 'merged') as merged, count_if(outcome not in ('added', 'merged')) as rejected from o group by 1),
g as (select record_id, count(distinct id) as pruned from targets where {sql_key('pre_hz_label')} in ('', 'n/a', 'not_applicable', 'unknown', 'none', 'missing') group by 1)
select coalesce(a.record_id, g.record_id) as record_id, coalesce(added, 0) as added, coalesce(merged, 0) as merged, coalesce(rejected, 0) as rejected, coalesce(pruned, 0) as pruned from a full join g on a.record_id = g.record_id""",
        "prune_outcomes": """with a as (select record_id, case when target_id % 9 = 0 then 'target-x' else id end as target_id, target_id as ordinal from targets where target_id % 3 = 0),
p as (select * from a union all select record_id, target_id, -ordinal from a where ordinal % 2 = 0)
select record_id, target_id, ordinal, case when not exists (select 1 from targets t where t.record_id = p.record_id and t.id = p.target_id) then 'unknown_target' when row_number() over (partition by record_id, target_id order by ordinal) > 1 then 'duplicate_prune' else 'pruned' end as outcome from p""",
        "candidate_ontologies": """with c as (select ontology_id, row_number() over (order by min(term_key), ontology_id) - 1 as ordinal from terms where ontology_id <> 'kesp' group by 1)
select target_id, ontology_id, cast(ordinal as int) as ordinal from targets, c where target_id % 2 = 1
union all select target_id, x.o, x.n from targets, (values ('zute', 0), ('anth', 2), ('zute', 3)) x(o, n) where target_id % 2 = 0""",
        "term_chunks": f"with {_TERMS} select term_key, 'Ontology: ' || ontology_id || chr(10) || 'Term: ' || coalesce(title, '') || chr(10) || 'Synonyms: ' || array_to_string(list_filter(list_concat(coalesce(exact, []), coalesce(related, [])), lambda s: s is not null and s <> ''), '; ') || chr(10) || 'Description: ' || coalesce(description, '') || chr(10) || 'Accession: ' || coalesce(nullif(accession, ''), nullif(id, ''), '') || chr(10) || 'IRI: ' || coalesce(iri, '') as chunk from typed",
        "dedupe_targets": "select record_id, 'target-' || (row_number() over (partition by record_id order by first) - 1) as id, pre_hz_field, pre_hz_label, n_occurrences from (select record_id, pre_hz_field, pre_hz_label, min(target_id) as first, count(*) as n_occurrences from targets group by 1, 2, 3)",
        "occurrence_union": "select record_id, min(target_id) as target_id from targets group by record_id, pre_hz_field_path, pre_hz_label_path, parent_path",
        "target_additions": f"""
with p as (select record_id, target_id as ordinal, case when target_id % 7 = 0 then 'target-x' else id end as source_target_id, {sql_key('pre_hz_field')} as field, {sql_key("pre_hz_label || case when target_id % 3 = 0 then '' else ' part' end")} as label from targets),
k as (select distinct record_id, id as source_target_id from targets), h as (select distinct record_id, {sql_key('pre_hz_field')} as field, {sql_key('pre_hz_label')} as label from targets),
a as (select p.*, case when k.record_id is null then 'unknown_source_target' when h.record_id is not null then 'already_present' end as r from p left join k using (record_id, source_target_id) left join h using (record_id, field, label)),
b as (select record_id, ordinal, source_target_id, field, label, case when r is null and row_number() over (partition by record_id, r, field, label, source_target_id order by ordinal) > 1 then 'duplicate_proposal' else r end as r from a),
c as (select record_id, ordinal, source_target_id, field, label, case when r is null and row_number() over (partition by record_id, r, source_target_id order by ordinal) > 1 then 'per_source_limit_exceeded' else r end as r from b)
select record_id, ordinal, source_target_id, field, label, coalesce(r, case when row_number() over (partition by record_id, r, field, label order by ordinal) = 1 then 'added' else 'merged' end) as outcome from c""",
        "target_prunes": f"select target_id from targets t where not exists (select 1 from targets e where e.record_id = t.record_id and e.id = t.id and {sql_key('e.pre_hz_label')} in ('', 'n/a', 'not_applicable', 'unknown', 'none', 'missing'))",
        "json_pointer": """with p as (select distinct record_id, unnest([pre_hz_label_path, parent_path || '/no such']) as path from targets)
select p.record_id, p.path, case when json_valid(metadata) and json_type(metadata, p.path) not in ('OBJECT', 'ARRAY', 'NULL') then json_extract_string(metadata, p.path) end as value from p join miniml_records r using (record_id) where p.path is not null""",
        "vector_topk": f"with {_NEAR} select query_id, ontology_id, term_key, round(score, 6) as score, position from near",
        "balanced_pool": f"""with {_NEAR},
kept as (select *, row_number() over (partition by query_id, ontology_id order by score desc, position) <= 2 as r from near where score >= 0.0),
g as (select *, sum(cast(r as int)) over (partition by query_id) as n, row_number() over (partition by query_id, r order by score desc, label, position, ontology_id) as g from kept)
select query_id, ontology_id, term_key, row_number() over (partition by query_id order by score desc, label, position, ontology_id) as pool_rank from g where r or g <= greatest(10, n) - n""",
        "preferred_pool": f"""with {_NEAR},
p as (select query_id, ontology_id, term_key, label * 1000 + position as position, position as k, case ontology_id when 'onto_7' then 0 when 'onto_3' then 1 end as pref from near),
o as (select *, row_number() over (partition by query_id order by case when pref is not null and k <= 2 then 0 else 1 end, case when pref is not null and k <= 2 then k else position end, case when pref is not null and k <= 2 then pref else 0 end) as pool_rank from p)
select query_id, ontology_id, term_key, pool_rank from o where pool_rank <= 10""",
        "hierarchy_edges": f"""with {_TERMS}, refs as (select distinct ontology_id, term_key as child, {sql_key('r')} as lookup_key from (select ontology_id, term_key, unnest(list_concat(coalesce(parents, []), coalesce(parent_iris, []))) as r from typed))
select distinct r.ontology_id, r.child, e.term_key as parent from refs r join lookup_entries e on e.ontology_id = r.ontology_id and e.lookup_key = r.lookup_key and e.index_name in ('id', 'accession', 'iri') where e.term_key <> r.child""",
        "fts_or": f"""with {_TERMS}, {docs},
words as (select query_id, {tok('w')} as p, count(*) as times from (select target_id as query_id, unnest(regexp_extract_all(lower(pre_hz_label), '[\\p{{L}}\\p{{N}}_]+')) as w from targets where target_id % 100 = 0) group by 1, 2),
{hits}, {scored} select query_id, ontology_id, term_key, round(score, 6) as score, position from ranked""",
        "triple_terms": f"""with {_TRIPLE} select subject, min(object_value) filter (predicate = 'http://types.terms.example/rdfs#label' and object_type = 'literal') as title,
coalesce(array_to_string(list_sort(list(distinct object_value) filter (predicate = 'http://vocab.terms.example/syn/exact' and object_type <> 'bnode')), '|'), '') as exact,
coalesce(array_to_string(list_sort(list(distinct object_value) filter (predicate = 'http://types.terms.example/rdfs#subClassOf' and object_type <> 'bnode')), '|'), '') as parent_iris from mine group by 1""",
        "triple_properties": f"""with {_TRIPLE} select subject, predicate, array_to_string(list_sort(list(distinct object_value)), '|') as property_values from mine where object_type = 'literal'
and predicate not in ('http://types.terms.example/rdf#type', 'http://types.terms.example/rdfs#label', 'http://vocab.terms.example/syn/exact', 'http://types.terms.example/rdfs#subClassOf') group by 1, 2""",
        "cache_live": """select event_type as provider, user_id, event_id, props from (select *, row_number() over (partition by event_type, user_id order by ts desc, event_id desc) as n from events)
where n = 1 and (select max(ts) from events) - ts <= interval 604800 seconds""",
        "freshness_diff": "select ontology_id, case ontology_id when 'anth' then 'new' when 'zute' then 'gone' when 'kesp' then 'changed' else 'fresh' end as status from terms group by 1",
        "framework_counts": "select coalesce(t.ontology_id, e.ontology_id) as ontology_id, coalesce(t.n, 0) as terms, coalesce(e.n, 0) as lookups from (select ontology_id, count(*) as n from terms group by 1) t full join (select ontology_id, count(*) as n from lookup_entries group by 1) e on t.ontology_id = e.ontology_id",
        "html_sniff": """select doc_id, regexp_matches(lower(regexp_replace(ltrim(substr(page, 1, 4096)), '^<[?]xml[^>]*[?]>\\s*', '')), '^(<!doctype html|<html)') as is_html from (
select doc_id, case doc_id % 3 when 0 then '  <!DOCTYPE html><p>' || coalesce(text, '') when 1 then '<?xml version=''1.0''?>' || chr(10) || '<HTML>' || coalesce(text, '') else coalesce(text, '') end as page from documents)""",
        "query_validate": f"""select page_id, count(*) as n, case when bool_or(coalesce({_flat('edit_comment')}, '') = '') then 'empty' when count(*) > 3 then 'too_many' when count(distinct lower({_flat('edit_comment')})) < count(*) then 'duplicate'
when bool_or(regexp_matches(edit_comment, '\\[(?i:filter|dataset)\\]')) then 'filter' end as problem from (select page_id, case when doc_id % 5 = 0 then edit_comment || ' [Dataset]' else edit_comment end as edit_comment from documents) group by 1""",
    }
    out["outcome_counts"] = out["outcome_counts"].replace("ADDITIONS", out["target_additions"])
    return out
