"""Queries of the general problems 3, 4 and 6, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import hierarchy, nested, wide
from tessera.session import staged, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    made, attributes = wide.wide_table(table(spark, d, "triples"), table(spark, d, "prefixes"))
    return wide.cells(made, attributes)


def p3_wide(spark: SparkSession, d: str) -> DataFrame:
    return wide.typed(*wide.wide_table(table(spark, d, "triples"), table(spark, d, "prefixes")))


def p3_wide_latest(spark: SparkSession, d: str) -> DataFrame:
    return wide.typed(*wide.wide_table(table(spark, d, "triples"), table(spark, d, "prefixes"), rule="latest"))


def p3_cells_latest(spark: SparkSession, d: str) -> DataFrame:
    return wide.cells(*wide.wide_table(table(spark, d, "triples"), table(spark, d, "prefixes"), rule="latest"))


def p3_rejected(spark: SparkSession, d: str) -> DataFrame:
    return wide.rejected(table(spark, d, "triples"), table(spark, d, "prefixes"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_items(table(spark, d, "miniml_records"), entities=("series", "organism", "characteristic")).select("record_id", "item_path")


def _flat(spark: SparkSession, d: str, entity: str) -> DataFrame:
    return nested.flat_table(staged(nested.flat_items(table(spark, d, "miniml_records"), entities=(entity,)), entity), entity)


def p4_packages(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "package")


def p4_series(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "series")


def p4_samples(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "sample")


def p4_channels(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "channel")


def p4_organisms(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "organism")


def p4_characteristics(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "characteristic")


def p4_items(spark: SparkSession, d: str) -> DataFrame:
    """The rows of all tables, those without a name of their own too."""
    items = nested.flat_items(table(spark, d, "miniml_records"))
    return items.withColumn("cells", F.to_json("cells"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.parent_links(table(spark, d, "terms"), table(spark, d, "lookup_entries"), table(spark, d, "hierarchy_parent_refs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.hierarchy(_links(spark, d), paths=False)
    return found.select(F.col("id").alias("term_key"), F.col("root").alias("root_term_key"), "depth")


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.hierarchy(_links(spark, d))
    return found.select(F.col("id").alias("term_key"), F.col("root").alias("root_term_key"), "depth", F.array_join("path", "/").alias("path"))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(_links(spark, d)))


def p6_subtrees(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.subtrees(hierarchy.hierarchy(_links(spark, d)))
    return found.select(F.col("id").alias("term_key"), "depth", "first", "last")


_TREE = """
with recursive names as (
  select distinct ontology_id, lookup_key, term_key as parent from lookup_entries where index_name in ('id', 'accession', 'iri')),
links as (
  select r.child_term_key as id, min(n.parent) as parent from hierarchy_parent_refs r
  join names n on n.ontology_id = r.ontology_id and n.lookup_key = r.lookup_key
  where n.parent <> r.child_term_key and n.parent in (select term_key from terms) group by 1),
tree as (
  select term_key as id, term_key as root, 0 as depth, term_key as path from terms where term_key not in (select id from links)
  union all
  select l.id, t.root, t.depth + 1, t.path || '/' || l.id from tree t join links l on l.parent = t.id)
"""

_TRIPLES = """
with full_names as (
  select t.subject, t.object_type, t.object_value, t.staged_at,
    coalesce(p.namespace || substr(t.predicate, length(p.prefix) + 2), t.predicate) as predicate,
    regexp_extract(t.datatype, '([^/#:]*)$', 1) as kind,
    coalesce(o.namespace || substr(t.object_value, length(o.prefix) + 2), t.object_value) as object_name
  from triples t
  left join prefixes p on starts_with(t.predicate, p.prefix || ':')
  left join prefixes o on t.object_type = 'uri' and starts_with(t.object_value, o.prefix || ':')),
classes as (
  select distinct f.subject from full_names f
  where f.predicate = (select namespace from prefixes where prefix = 'rdf') || 'type'
    and f.object_name = (select namespace from prefixes where prefix = 'owl') || 'Class'),
kinds as (
  select predicate, arg_min(kind, (-n, kind)) as kind from (
    select predicate, kind, count(*) as n from full_names where object_type = 'literal' and kind <> '' group by 1, 2) group by 1),
literals as (
  select f.subject, f.predicate, f.staged_at, regexp_extract(f.predicate, '([^/#]*)$', 1) as column_name, k.kind, trim(f.object_value, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) as v
  from full_names f join kinds k using (predicate) where f.object_type = 'literal' and f.subject in (select subject from classes)),
parsed as (
  select subject, column_name, kind, staged_at,
    case when kind = 'integer' and regexp_full_match(v, '[+-]?[0-9]+') then try_cast(v as decimal(38, 0)) end as i,
    case when kind = 'decimal' and regexp_full_match(v, '[+-]?[0-9]+(\\.[0-9]+)?') then try_cast(v as decimal(38, 10)) end as c,
    case when kind = 'boolean' then case when lower(v) in ('true', '1') then 1 when lower(v) in ('false', '0') then 0 end end as b,
    case when kind = 'date' and regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_cast(v as date) end as d,
    case when kind = 'dateTime' and regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}(Z|[+-][0-9]{2}:[0-9]{2})?')
      then epoch(try_cast(case when length(v) = 19 then v || 'Z' else v end as timestamptz)) end as s
  from literals)
"""

_ITEMS = """
with recursive tree as (
  select r.record_id, t.id, t.parent, t.key, left(t.type, 1) as kind, t.type not in ('OBJECT', 'ARRAY', 'NULL') as is_scalar
  from (select record_id, metadata from miniml_records where json_valid(metadata)) r, json_tree(r.metadata) t),
members as (select record_id, parent as id, bool_or(key = 'tag' and is_scalar) as has_tag, bool_or(key = 'value' and is_scalar) as has_value from tree where parent is not null group by 1, 2),
placed as (
  select record_id, id, kind, '' as ptr, '' as rest, kind as root, cast(null as varchar) as above from tree where parent is null
  union all
  select t.record_id, t.id, t.kind, p.ptr || x.step, case when p.root = 'A' and p.ptr = '' then '' else p.rest || x.step end, p.root, p.kind
  from placed p join tree t on t.record_id = p.record_id and t.parent = p.id, lateral (select '/' || replace(replace(t.key, '~', '~0'), '/', '~1') as step) x)
select p.record_id, p.ptr as item_path from placed p left join members m using (record_id, id) where p.kind = 'O' and (
  regexp_full_match(rest, '/series(/[0-9]+)?') and (rest = '/series' or above = 'A')
  or has_value and regexp_full_match(rest, '/sample(/[0-9]+)?/channel(/[0-9]+)?/organism(/[0-9]+)?') and (ends_with(rest, '/organism') or above = 'A')
  or has_value and has_tag and regexp_matches(rest, '^/sample(/[0-9]+)?/channel(/[0-9]+)?/characteristics(/|$)'))
"""


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_wide, p3_wide_latest, p3_cells_latest, p3_rejected, p4_found, p4_packages, p4_series, p4_samples, p4_channels, p4_organisms, p4_characteristics, p4_items, p6_found, p6_paths, p6_descendants, p6_subtrees)}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _TRIPLES + """
select subject, column_name, cell from (
  select subject, column_name, case any_value(kind)
    when 'integer' then cast(min(i) as varchar)
    when 'decimal' then cast(cast(min(c) as decimal(38, 3)) as varchar)
    when 'boolean' then case min(b) when 0 then 'false' when 1 then 'true' end
    when 'date' then strftime(min(d), '%Y-%m-%d')
    when 'dateTime' then strftime(make_timestamp(cast(min(s) * 1000000 as bigint)), '%Y-%m-%dT%H:%M:%SZ') end as cell
  from parsed group by 1, 2) where cell is not null""",
        "p3_cells_latest": _TRIPLES + """
, latest as (select *, row_number() over (partition by subject, predicate_column order by staged_at desc, i, c, b, d, s) as n from (
    select *, column_name as predicate_column from parsed where i is not null or c is not null or b is not null or d is not null or s is not null))
select subject, column_name, case kind
    when 'integer' then cast(i as varchar)
    when 'decimal' then cast(cast(c as decimal(38, 3)) as varchar)
    when 'boolean' then case b when 0 then 'false' when 1 then 'true' end
    when 'date' then strftime(d, '%Y-%m-%d')
    when 'dateTime' then strftime(make_timestamp(cast(s * 1000000 as bigint)), '%Y-%m-%dT%H:%M:%SZ') end as cell
  from latest where n = 1""",
        "p4_found": _ITEMS,
        "p6_found": _TREE + "select m.term_key, coalesce(t.root, '') as root_term_key, coalesce(t.depth, -1) as depth from terms m left join tree t on t.id = m.term_key",
        "p6_paths": _TREE + "select m.term_key, coalesce(t.root, '') as root_term_key, coalesce(t.depth, -1) as depth, coalesce(t.path, '') as path from terms m left join tree t on t.id = m.term_key",
        "p6_subtrees": _TREE + """
, placed as (select id, depth, row_number() over (order by string_split(path, '/')) as first from tree),
sizes as (select split_part(t.path, '/', cast(g.i as int) + 1) as id, count(*) as n from tree t, unnest(range(t.depth)) as g(i) group by 1)
select p.id as term_key, p.depth, p.first, p.first + coalesce(s.n, 0) as last from placed p left join sizes s using (id)""",
        "p6_descendants": _TREE + """
select split_part(t.path, '/', cast(g.i as int) + 1) as ancestor, t.id as descendant, cast(t.depth - g.i as int) as distance
from tree t, unnest(range(t.depth)) as g(i) where t.depth > 0""",
    }
