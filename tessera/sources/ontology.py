"""Readers of ontologies: RDF/XML as triples, lookup maps in JSON; and the pivot of triples to terms."""

from __future__ import annotations

import json
from urllib.parse import urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.keys import accession_from_iri

#: The namespaces of RDF, RDF Schema, OWL and of the usual annotation properties.
RDF, RDFS, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
OBO, IN_OWL, DC, TERMS = "http://purl.obolibrary.org/obo/", "http://www.geneontology.org/formats/oboInOwl#", "http://purl.org/dc/elements/1.1/", "http://purl.org/dc/terms/"
XML = "http://www.w3.org/XML/1998/namespace"
TRIPLES = "subject string, predicate string, object_type string, object_value string, language string, datatype string"


#: Attributes of RDF/XML that are no properties.
_SYNTAX = {f"{{{RDF}}}{n}" for n in ("about", "ID", "nodeID", "resource", "parseType", "datatype", "bagID")}


def triples_of_file(path: str, part: int = 0, parts: int = 1):
    """Triples of an RDF/XML file, streamed: memory holds one top-level node at a time.

    Of several ``parts`` each reads the whole file but gives the triples of its own top-level nodes only. Blank nodes are named
    by their place in the file, or by their nodeID.
    """
    depth, root, base, n = 0, None, "", 0
    for event, node in ElementTree.iterparse(path, ("start", "end")):
        if event == "start":
            depth += 1
            if root is None:
                root = node
                base, lang = node.get(f"{{{XML}}}base") or "", node.get(f"{{{XML}}}lang") or ""
                alone = node.tag != f"{{{RDF}}}RDF"
        else:
            depth -= 1
            if depth == 1 and not alone:
                if n % parts == part:
                    yield from _Names(base, f"{n}").node(node, lang)[1]
                n += 1
                root.clear()
    if root is not None and alone and part == 0:
        yield from _Names(base, "0").node(root, "")[1]


class _Names:
    """Triples of one top-level node; blank nodes are numbered within it."""

    def __init__(self, base: str, place: str):
        self.base, self.place, self.blanks = base, place, 0

    def full(self, iri: str) -> str:
        return self.base.partition("#")[0] + iri if iri.startswith("#") else self.base if iri == "" else urljoin(self.base, iri) if self.base and ":" not in iri.partition("/")[0] else iri

    def blank(self) -> str:
        self.blanks += 1
        return f"_:n{self.place}x{self.blanks}"

    def name(self, node) -> tuple[str, str]:
        get = lambda n: node.get(f"{{{RDF}}}{n}")
        if get("about") is not None:
            return self.full(get("about")), "uri"
        if get("ID") is not None:
            return self.full("#" + get("ID")), "uri"
        return (f"_:{get('nodeID')}" if get("nodeID") is not None else self.blank()), "bnode"

    def attributes(self, subject: str, node, lang: str):
        for k, v in node.attrib.items():
            if k[0] == "{" and k not in _SYNTAX and not k.startswith(f"{{{XML}}}"):
                predicate = k[1:].replace("}", "")
                yield (subject, predicate, "uri", self.full(v), "", "") if predicate == RDF + "type" else (subject, predicate, "literal", v, lang, "")

    def node(self, node, lang: str) -> tuple[tuple[str, str], list[tuple]]:
        """The name of a node element and all triples in it."""
        lang = node.get(f"{{{XML}}}lang", lang)
        subject, kind = self.name(node)
        tag = node.tag[1:].replace("}", "")
        out = [(subject, RDF + "type", "uri", tag, "", "")] if tag != RDF + "Description" else []
        out += self.attributes(subject, node, lang)
        out += self.properties(subject, node, lang)
        return (subject, kind), out

    def properties(self, subject: str, node, lang: str) -> list[tuple]:
        out, item = [], 0
        for child in node:
            predicate = child.tag[1:].replace("}", "")
            if predicate == RDF + "li":
                item += 1
                predicate = f"{RDF}_{item}"
            own = child.get(f"{{{XML}}}lang", lang)
            get = lambda n: child.get(f"{{{RDF}}}{n}")  # noqa: B023, E731
            if get("parseType") == "Literal":
                text = (child.text or "") + "".join(ElementTree.tostring(c, encoding="unicode") for c in child)
                out.append((subject, predicate, "literal", text, "", RDF + "XMLLiteral"))
            elif get("parseType") == "Collection":
                names = []
                for c in child:
                    name, triples = self.node(c, own)
                    names.append(name)
                    out += triples
                links = [self.blank() for _ in names]
                out.append((subject, predicate, "bnode", links[0], "", "") if links else (subject, predicate, "uri", RDF + "nil", "", ""))
                for i, (link, (name, kind)) in enumerate(zip(links, names)):
                    out.append((link, RDF + "first", kind, name, "", ""))
                    out.append((link, RDF + "rest", "bnode", links[i + 1], "", "") if i + 1 < len(links) else (link, RDF + "rest", "uri", RDF + "nil", "", ""))
            elif get("parseType") is not None:
                blank = self.blank()
                out.append((subject, predicate, "bnode", blank, "", ""))
                out += self.properties(blank, child, own)
            elif len(child):
                for c in child:
                    (name, kind), triples = self.node(c, own)
                    out.append((subject, predicate, kind, name, "", ""))
                    out += triples
            elif get("resource") is not None or get("nodeID") is not None or any(self.attributes("", child, own)):
                name, kind = (self.full(get("resource")), "uri") if get("resource") is not None else (f"_:{get('nodeID')}" if get("nodeID") is not None else self.blank(), "bnode")
                out.append((subject, predicate, kind, name, "", ""))
                out += self.attributes(name, child, own)
            else:
                datatype = get("datatype")
                out.append((subject, predicate, "literal", child.text or "", "" if datatype else own, self.full(datatype) if datatype else ""))
        return out


class _File(InputPartition):
    def __init__(self, path: str, part: int, parts: int):
        self.path, self.part, self.parts = path, part, parts


class RdfReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        import glob

        parts = int(self.options.get("parts", "1"))
        return [_File(p, k, parts) for p in sorted(glob.glob(self.options["path"])) for k in range(parts)]

    def read(self, partition):
        rows: list = []
        for t in triples_of_file(partition.path, partition.part, partition.parts):
            rows.append((*t, partition.path))
            if len(rows) == 5000:
                yield _arrow(rows)
                rows = []
        if rows:
            yield _arrow(rows)


def _arrow(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["subject", "predicate", "object_type", "object_value", "language", "datatype", "file"])


class RdfSource(DataSource):
    """``spark.read.format("rdfxml").option("parts", n).load(glob)``: n partitions per file, read in bounded memory.

    The files lie in a folder that driver and executors see under one name, as the files of the tables do.
    """

    @classmethod
    def name(cls):
        return "rdfxml"

    def schema(self):
        return TRIPLES + ", file string"

    def reader(self, schema):
        return RdfReader(self.options)


def read_rdf(spark: SparkSession, path: str, parts: int = 1) -> DataFrame:
    """Triples of the RDF/XML files of a path or pattern all executors see; ``parts`` tasks share the nodes of each file."""
    spark.dataSource.register(RdfSource)
    return spark.read.format("rdfxml").option("path", path).option("parts", str(parts)).load()


class _Text:
    """A JSON text read in pieces: what was parsed is forgotten, so memory holds one value at a time."""

    def __init__(self, path: str, size: int = 1 << 20):
        self.file, self.size, self.text, self.at = open(path, encoding="utf-8"), size, "", 0
        self.decoder = json.JSONDecoder()

    def more(self) -> bool:
        piece = self.file.read(self.size)
        self.text, self.at = self.text[self.at :] + piece, 0
        return bool(piece)

    def peek(self) -> str:
        while True:
            while self.at < len(self.text) and self.text[self.at] in " \t\n\r":
                self.at += 1
            if self.at < len(self.text) or not self.more():
                return self.text[self.at : self.at + 1]

    def take(self, c: str) -> None:
        if self.peek() != c:
            raise ValueError(f"{c} is missing")
        self.at += 1

    def value(self) -> object:
        self.peek()
        while True:
            try:
                x, end = self.decoder.raw_decode(self.text, self.at)
            except ValueError:
                if not self.more():
                    raise
                continue
            used = end - self.at
            # A number at the end of a piece may go on in the next.
            if end < len(self.text) or not self.more():
                self.at += used
                return x

    def members(self):
        """The names of an object, one after the other; the caller takes each value."""
        self.take("{")
        if self.peek() == "}":
            self.at += 1
            return
        while True:
            name = self.value()
            self.take(":")
            yield name
            if self.peek() == ",":
                self.at += 1
            else:
                self.take("}")
                return


def lookup_rows_of(path: str):
    """(ontology_id, index_name, index_rank, lookup_key, payload, source_order) of a JSON file with ``terms`` maps, read as a stream.

    The id is that of the object ``ontology``; where it comes after the maps, rows read before have null.
    """
    ranks = {"label": 0, "id": 1, "accession": 2, "iri": 3}
    text, ontology = _Text(path), None
    for name in text.members():
        if name == "ontology":
            x = text.value()
            ontology = x.get("id") if isinstance(x, dict) else None
        elif name == "terms" and text.peek() == "{":
            for index in text.members():
                if index not in ranks or text.peek() != "{":
                    text.value()
                    continue
                for key in text.members():
                    found = text.value()
                    for order, term in enumerate(found if isinstance(found, list) else [found]):
                        yield ontology, index, ranks[index], key, json.dumps(term, ensure_ascii=False), order
        else:
            text.value()


class LookupReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        import glob
        import os

        at = self.options["path"]
        return [_File(p, 0, 1) for p in sorted(glob.glob(f"{at}/*.json") if os.path.isdir(at) else glob.glob(at))]

    def read(self, partition):
        rows: list = []
        types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32())
        names = ["file", "ontology_id", "index_name", "index_rank", "lookup_key", "payload", "source_order"]
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        try:
            for row in lookup_rows_of(partition.path):
                rows.append((partition.path, *row))
                if len(rows) == 5000:
                    yield made()
                    rows = []
        except (ValueError, RecursionError):
            pass  # the rows before the fault stand; ``valid_files`` tells which files are whole
        if rows:
            yield made()


class LookupSource(DataSource):
    """``spark.read.format("lookupjson").load(folder or pattern)``: one partition per file, one term in memory at a time."""

    @classmethod
    def name(cls):
        return "lookupjson"

    def schema(self):
        return "file string, ontology_id string, index_name string, index_rank int, lookup_key string, payload string, source_order int"

    def reader(self, schema):
        return LookupReader(self.options)


def read_lookup_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, ontology_id, index_name, index_rank, lookup_key, payload, source_order) of ontology JSON files with ``terms`` maps.

    A key's value is one term or a list of terms; ``source_order`` is the place in that list. Keys stay as written. Files are
    read as streams, so a file that breaks off gives the rows before the fault; ``valid_files`` tells the whole ones.
    """
    spark.dataSource.register(LookupSource)
    return spark.read.format("lookupjson").option("path", path).load()


def valid_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, ok): whether a file is JSON with mappings ``ontology`` and ``terms``."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("v"))
    is_map = lambda p: F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get("v", p, "variant")), F.lit("OBJECT")), F.lit(False))
    return whole.select("file", (is_map("$.ontology") & is_map("$.terms")).alias("ok"))


def class_triples(triples: DataFrame, type_iri: str = RDF + "type", class_iri: str = OWL + "Class") -> DataFrame:
    """The triples of named subjects that are classes."""
    classes = triples.filter(~F.startswith("subject", F.lit("_:")) & (F.col("predicate") == type_iri) & (F.col("object_value") == class_iri)).select("subject").distinct()
    return triples.join(classes, "subject", "left_semi")


def pivot_terms(triples: DataFrame, scalars: dict[str, str], lists: dict[str, str], known: list[str]) -> DataFrame:
    """One term per subject: ``scalars`` (column: predicate) take the smallest literal, ``lists`` the sorted distinct values.

    Literals of other predicates, ``known`` ones left out, come as ``properties``: predicate to sorted distinct values.
    A single pass: partial sets are built before the shuffle by subject.
    """
    literal = F.col("object_type") == "literal"
    aggs = [F.min(F.when(literal & (F.col("predicate") == p), F.col("object_value"))).alias(c) for c, p in scalars.items()]
    aggs += [F.array_sort(F.collect_set(F.when((F.col("object_type") != "bnode") & (F.col("predicate") == p), F.col("object_value")))).alias(c) for c, p in lists.items()]
    named = [*scalars.values(), *lists.values(), *known]
    pair = F.when(literal & ~F.col("predicate").isin(named), F.struct(F.col("predicate").alias("p"), F.col("object_value").alias("v")))
    aggs.append(F.array_sort(F.collect_set(pair)).alias("pairs"))
    made = triples.groupBy("subject").agg(*aggs)
    names = F.array_distinct(F.transform("pairs", lambda x: x["p"]))
    properties = F.map_from_entries(F.transform(names, lambda p: F.struct(p, F.transform(F.filter("pairs", lambda x: x["p"] == p), lambda x: x["v"]))))
    return made.select("subject", *scalars, *lists, properties.alias("properties"))


OWL_SCALARS = {"title": RDFS + "label", "description": OBO + "IAO_0000115", "deprecated": OWL + "deprecated", "explicit_id": IN_OWL + "id"}
OWL_LISTS = {"exact": IN_OWL + "hasExactSynonym", "related": IN_OWL + "hasRelatedSynonym", "broad": IN_OWL + "hasBroadSynonym", "narrow": IN_OWL + "hasNarrowSynonym",
             "xrefs": IN_OWL + "hasDbXref", "subsets": IN_OWL + "inSubset", "parent_iris": RDFS + "subClassOf", "replaced_by": OBO + "IAO_0100001"}


def owl_terms(triples: DataFrame) -> DataFrame:
    """Terms of OWL classes: iri, accession, title, description, parents, parent_iris, synonyms, xrefs, subsets, deprecated, replaced_by, properties."""
    wide = pivot_terms(class_triples(triples), OWL_SCALARS, OWL_LISTS, [RDF + "type"])
    accession = F.coalesce("explicit_id", accession_from_iri(F.col("subject")))
    replaced = F.get("replaced_by", 0)
    return wide.select(
        F.col("subject").alias("iri"), accession.alias("accession"), "title", "description", F.transform("parent_iris", lambda x: F.coalesce(accession_from_iri(x), x)).alias("parents"), "parent_iris",
        F.struct("exact", "related", "broad", "narrow").alias("synonyms"), "xrefs", "subsets", F.coalesce(F.lower("deprecated").isin("true", "1"), F.lit(False)).alias("deprecated"), F.coalesce(accession_from_iri(replaced), replaced).alias("replaced_by"), "properties")


def header(triples: DataFrame) -> DataFrame:
    """(iri, version_iri, title, description, version, license) of the ontologies themselves."""
    own = triples.join(triples.filter((F.col("predicate") == RDF + "type") & (F.col("object_value") == OWL + "Ontology")).select("subject").distinct(), "subject", "left_semi")
    first = lambda p: F.min(F.when(F.col("predicate") == p, F.col("object_value")))
    return own.groupBy("subject").agg(
        first(OWL + "versionIRI").alias("version_iri"), F.coalesce(first(DC + "title"), first(TERMS + "title")).alias("title"), F.coalesce(first(DC + "description"), first(TERMS + "description")).alias("description"),
        first(OWL + "versionInfo").alias("version"), F.coalesce(first(TERMS + "license"), first(DC + "license")).alias("license")).withColumnRenamed("subject", "iri")


def lookup_entries(terms: DataFrame) -> DataFrame:
    """(index_name, index_rank, lookup_key, term_key, source_order) of typed terms (term_key, ordinal, title, id, accession, iri), keys normalised, nulls skipped."""
    from tessera.functions.keys import harmonize_key

    names = F.array(*[F.struct(F.lit(n).alias("index_name"), F.lit(k).alias("index_rank"), F.col(c).alias("key")) for k, (n, c) in enumerate((("label", "title"), ("id", "id"), ("accession", "accession"), ("iri", "iri")))])
    rows = terms.select("term_key", F.col("ordinal").alias("source_order"), F.explode(names).alias("x")).filter("x.key is not null")
    return rows.select("x.index_name", "x.index_rank", harmonize_key(F.col("x.key")).alias("lookup_key"), "term_key", "source_order")


def lookup_maps(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, identifiers) of OWL terms: (title, iris in order) for every title, and (index_name, key, iri) for every accession and IRI.

    Several terms may have a title; of those with one accession the last by IRI counts.
    """
    labels = terms.filter("title is not null").groupBy("title").agg(F.array_sort(F.collect_set("iri")).alias("iris"))
    named = terms.select("iri", F.explode(F.array(F.struct(F.lit("accession").alias("index_name"), F.col("accession").alias("key")), F.struct(F.lit("iri").alias("index_name"), F.col("iri").alias("key")))).alias("x"))
    return labels, named.filter("x.key is not null").groupBy("x.index_name", "x.key").agg(F.max("iri").alias("iri"))


def write_terms(terms: DataFrame, path: str) -> None:
    """One JSON object per term."""
    terms.write.mode("overwrite").json(path)


def payload_terms(terms: DataFrame) -> DataFrame:
    """Stored terms (ontology_id, term_key, payload JSON) with typed columns; a description may be a text or a list."""
    schema = "id string, accession string, iri string, title string, description string, parents array<string>, parent_iris array<string>, synonyms struct<exact: array<string>, related: array<string>>, deprecated boolean"
    p = F.from_json("payload", schema)
    listed = F.from_json(F.get_json_object("payload", "$.description"), "array<string>")
    return terms.withColumn("p", p).withColumn("l", listed).select(
        "ontology_id", "term_key", "indexed_at", "p.id", "p.accession", "p.iri", "p.title", F.when(F.startswith("p.description", F.lit("[")) & F.col("l").isNotNull(), F.array_join("l", " ")).otherwise(F.col("p.description")).alias("description"),
        "p.parents", "p.parent_iris", "p.synonyms", "p.deprecated")
