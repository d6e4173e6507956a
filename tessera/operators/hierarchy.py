"""Parent links to full hierarchies, by splitters and pointer jumping (problem 6)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tessera.operators.skew import running_sum, skew_join
from tessera.session import staged

#: One node in so many is a splitter, so that a walk to the next one is short and the reduced graph small.
SPLIT = 8


def parent_links(terms: DataFrame, entries: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, parent) for every term: the term its reference resolves to, or null.

    A reference resolves in its own ontology through entries named id, accession or iri; itself, unknown terms and
    nulls do not count, repeated and late references change nothing, and of several parents the smallest key is taken.
    """
    names = entries.filter(F.col("index_name").isin("id", "accession", "iri")).select("ontology_id", "lookup_key", F.col("term_key").alias("parent")).dropna().distinct()
    wanted = refs.select("ontology_id", "lookup_key", F.col("child_term_key").alias("id")).dropna().distinct()
    found = skew_join(wanted, names, ["ontology_id", "lookup_key"]).filter("id <> parent")
    keys = terms.select(F.col("term_key").alias("id")).dropna().distinct()
    found = found.join(keys.withColumnRenamed("id", "parent"), "parent", "left_semi").groupBy("id").agg(F.min("parent").alias("parent"))
    return keys.join(found, "id", "left")


def _jumped(nodes: DataFrame, paths: bool, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Follow pointers until they are final. nodes: id, ptr, dist, final[, seg]; seg is the path up to, without, ptr.

    Every round joins the rows that are not final with the rows their pointers name, which doubles their reach. Of the
    rows left after a few rounds almost all are on cycles or below them; a walk that stays among k rows for more than
    k steps never ends, so after log2(k) + 1 further rounds the rest is given back as endless.
    """
    done = [nodes.filter("final")]
    active = nodes.filter("not final")
    left, rounds, until = active.count(), 0, 10**9
    while left:
        until = min(until, rounds + math.ceil(math.log2(left + 1)) + 1)
        if rounds >= until:
            return _union(done), active
        known = active
        for part in done:
            known = known.unionByName(part)
        to = known.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2"), F.col("final").alias("final2"), *([F.col("seg").alias("seg2")] if paths else []))
        moved = skew_join(active.drop("final"), to, ["ptr"], wide=paths).select(
            "id", F.col("ptr2").alias("ptr"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("final2").alias("final"), *([F.concat("seg", "seg2").alias("seg")] if paths else []))
        moved = staged(moved, name)
        done.append(moved.filter("final"))
        active = moved.filter("not final")
        left, rounds = active.count(), rounds + 1
    return _union(done), None


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hierarchy(links: DataFrame, paths: bool = True) -> DataFrame:
    """(id, root, depth[, path]) of every node of (id, parent); a root has no parent, depth 0 and itself as root.

    Nodes on a cycle or below one have root '' and depth -1 (path: empty). ``path`` leads from the root to the node.

    Splitters are all roots and the nodes whose hash says so, the same in every run. Every node walks to its next
    splitter; the splitters alone form a reduced graph, which is solved in the same way down to the roots; a node's path
    is its walk followed by its splitter's path. Cycles without a splitter never end their walk, cycles of splitters
    never reach a root: both come out as endless. A third of all nodes below one parent is no hot spot (skew_join).
    Tables with paths are only shuffled, never broadcast: their size on disk does not tell their size in memory.
    An empty input gives an empty result; ids are unique and not null.
    """
    seg = [F.array("id").alias("seg")] if paths else []
    links = staged(links.select("id", "parent", F.col("parent").isNull().alias("is_root"), (F.col("parent").isNull() | (F.pmod(F.xxhash64("id"), F.lit(SPLIT)) == 0)).alias("is_split")), "links")
    splitters = links.filter("is_split").select(F.col("id").alias("parent"))
    rest = links.filter("not is_root").select("id", "parent")
    step = skew_join(rest, splitters.withColumn("final", F.lit(True)), ["parent"], "left").select("id", F.col("parent").alias("ptr"), F.lit(1).alias("dist"), F.coalesce("final", F.lit(False)).alias("final"), *seg)
    walked, endless = _jumped(staged(step, "walk"), paths, "walk")
    walked = staged(walked, "walked")

    roots = links.filter("is_root").select("id")
    inner = walked.join(links.filter("is_split and not is_root").select("id"), "id", "left_semi").drop("final")
    reduced = skew_join(inner, roots.select(F.col("id").alias("ptr"), F.lit(True).alias("final")), ["ptr"], "left").withColumn("final", F.coalesce("final", F.lit(False)))
    solved, _ = _jumped(staged(reduced.select(*walked.columns), "reduced"), paths, "reduced")
    empty = F.array().cast("array<string>")
    tops = solved.select("id", F.col("ptr").alias("root"), F.col("dist").alias("depth"), *(["seg"] if paths else [])).unionByName(roots.select("id", F.col("id").alias("root"), F.lit(0).alias("depth"), *([empty.alias("seg")] if paths else [])))
    tops = staged(tops, "tops")

    to = tops.select(F.col("id").alias("ptr"), "root", F.col("depth").alias("above"), *([F.col("seg").alias("seg2")] if paths else []))
    plain = walked.join(links.filter("not is_split").select("id"), "id", "left_semi")
    below = skew_join(plain, to, ["ptr"], wide=paths).select("id", "root", (F.col("dist") + F.col("above")).alias("depth"), *([F.concat("seg", "seg2").alias("seg")] if paths else []))
    good = tops.unionByName(below)
    out = links.select("id").join(good.hint("merge") if paths else good, "id", "left").select("id", F.coalesce("root", F.lit("")).alias("root"), F.coalesce(F.col("depth").cast("int"), F.lit(-1)).alias("depth"), *(["seg"] if paths else []))
    if not paths:
        return out
    whole = F.when(F.col("depth") >= 0, F.concat(F.array("root"), F.reverse("seg"))).otherwise(empty)
    return out.select("id", "root", "depth", F.when(F.col("depth") == 0, F.array("id")).otherwise(whole).alias("path"))


def subtrees(found: DataFrame, partitions: int | None = None) -> DataFrame:
    """(id, root, depth, first, last): every node that reaches a root with its place in a walk of all trees, and the last place below it.

    The descendants of a node are the nodes with ``first < place <= last``, where a node's place is its own ``first``: one
    row per node instead of one per pair. Places follow the paths' order, found by a range sort with one sum per range on
    the driver; sizes are counted along the paths and added up before they are shuffled.
    """
    partitions = partitions or int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    good = staged(found.filter("depth >= 0").withColumn("one", F.lit(1).cast("long")), "good")
    placed = running_sum(good, ["path"], "one", "first", partitions, lambda x: staged(x, "placed")).select("id", "root", "depth", "first")
    below = good.filter("depth > 0").select(F.explode(F.slice("path", F.lit(1), F.col("depth"))).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return placed.join(below, "id", "left").select("id", "root", "depth", "first", (F.col("first") + F.coalesce("n", F.lit(0))).alias("last"))


def descendants(found: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of every pair on a path, nodes themselves left out; as many rows as the depths' sum (``subtrees`` has one row per node)."""
    pairs = found.filter("depth > 0").select("id", "depth", F.posexplode("path").alias("level", "ancestor"))
    return pairs.filter("level < depth").select("ancestor", F.col("id").alias("descendant"), (F.col("depth") - F.col("level")).alias("distance"))
