"""Queries pN_ of the general problems over the trace tables, with SQL for those SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import aggregates, hierarchy, intervals, references
from tickloom.session import table

#: Least share of all records that makes a generator heavy (TESTDATA.md).
HEAVY_SHARE = 0.02
#: Least ancestors that make a node deep (TESTDATA.md).
DEEP = 16


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    totals = aggregates.generator_totals(table(spark, d, "trace_transactions"))
    return aggregates.heavy_keys(totals, "generator", HEAVY_SHARE)


def p1_totals(spark: SparkSession, d: str) -> DataFrame:
    totals = aggregates.generator_totals(table(spark, d, "trace_transactions"))
    return totals.withColumn("generator", F.col("generator").cast("bigint")).withColumn("total_duration", F.col("total_duration").cast("bigint"))


def _forests(spark: SparkSession, d: str) -> list[tuple[str, hierarchy.Forest]]:
    tx, scopes = table(spark, d, "trace_transactions"), table(spark, d, "census_scopes")
    return [
        ("trace_transactions", hierarchy.hierarchy(tx, "id", "parent", (0,))),
        ("census_scopes", hierarchy.hierarchy(scopes, "scope", "parent", (-1,))),
    ]


def _each(spark: SparkSession, d: str, make) -> DataFrame:
    a, b = (make(name, forest) for name, forest in _forests(spark, d))
    return a.unionByName(b)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, lambda name, forest: hierarchy.found(forest, name, DEEP))


def _nodes(name: str, forest: hierarchy.Forest) -> DataFrame:
    placed = forest.placed().select("node", "descendants")
    return forest.paths().join(placed, "node").select(
        F.lit(name).alias("tree"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth", "descendants",
        F.array_join(F.col("path").cast("array<string>"), "/").alias("path"),
    )


def _intervals(name: str, forest: hierarchy.Forest) -> DataFrame:
    return forest.intervals().select(F.lit(name).alias("tree"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), "entry", "exit", "descendants")


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Every node of a tree with its path, depth, root and number of descendants; those on or
    under cycles are in p2_cut_hierarchy."""
    return _each(spark, d, _nodes)


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """The descendants of every node, as intervals: those nodes of its root whose entry lies between its
    entry and its exit. So n rows name them all; `Forest.closure` lists the pairs. Nodes on or
    under cycles are in p2_cut_descendants."""
    return _each(spark, d, _intervals)


def p2_cut_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """p2_hierarchy of the nodes on or under cycles, cut above the smallest id of each cycle."""
    return _each(spark, d, lambda name, forest: _nodes(name, forest.cut()))


def p2_cut_descendants(spark: SparkSession, d: str) -> DataFrame:
    """p2_descendants of the nodes on or under cycles, cut above the smallest id of each cycle."""
    return _each(spark, d, lambda name, forest: _intervals(name, forest.cut()))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.trace_orphans(*(table(spark, d, t) for t in ("trace_transactions", "embedded_stages", "trace_relations", "discarded_records")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("kind", "source", "target")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references and targets per kind, table and day of arrival."""
    return references.orphan_report(_orphans(spark, d)).withColumn("day", F.col("day").cast("string"))


def p3_drift(spark: SparkSession, d: str) -> DataFrame:
    """The old validation report against what is missing now, per kind."""
    return references.report_drift(_orphans(spark, d), table(spark, d, "missing_references"))


def _coverage(spark: SparkSession, d: str) -> intervals.Coverage:
    return intervals.trace_coverage(table(spark, d, "trace_transactions"), table(spark, d, "embedded_stages"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d).gaps()


def p5_busy(spark: SparkSession, d: str) -> DataFrame:
    """The continuous busy periods."""
    return _coverage(spark, d).busy().withColumnsRenamed({"begin": "busy_begin", "end": "busy_end"})


QUERIES = {f.__name__: f for f in (p1_found, p1_totals, p2_found, p2_hierarchy, p2_descendants, p2_cut_hierarchy, p2_cut_descendants, p3_found, p3_report, p3_drift, p5_found, p5_busy)}

_RECORDS = """records as (select id, min(generator) as generator, min(begin_tick) as b, min(end_tick) as e
  from trace_transactions where id is not null group by id)"""

_TREES = """edges as (
    select 'trace_transactions' as tree, id as node, min(case when parent <> 0 then parent end) as parent from trace_transactions group by id
    union all
    select 'census_scopes', scope, min(case when parent <> -1 then parent end) from census_scopes group by scope),
  kept as (select a.tree, a.node, b.node as parent from edges a left join edges b on a.tree = b.tree and a.parent = b.node),
  up as (select tree, node, parent as anc from kept where parent is not null
    union select u.tree, u.node, k.parent from up u join kept k on u.tree = k.tree and u.anc = k.node where k.parent is not null),
  cyc as (select tree, node from up where node = anc),
  caught as (select k.tree, k.node, min(c.node) as low from kept k join up u on k.tree = u.tree and k.node = u.node
    join cyc c on c.tree = u.tree and c.node = u.anc group by 1, 2),
  free as (select k.tree, k.node, k.parent from kept k left join caught c on c.tree = k.tree and c.node = k.node where c.node is null),
  deep as (select f.tree, f.node, count(u.anc) as depth,
      coalesce(min(u.anc) filter (where k.parent is null), f.node) as root
    from free f left join up u on u.tree = f.tree and u.node = f.node
    left join kept k on k.tree = u.tree and k.node = u.anc group by 1, 2)"""

_CUT = f"""{_TREES},
  cut as (select c.tree, c.node, c.low as root, case when c.node <> c.low then k.parent end as parent
    from caught c join kept k on k.tree = c.tree and k.node = c.node),
  climb as (select tree, node, parent as anc, 1 as distance from cut where parent is not null
    union select u.tree, u.node, k.parent, u.distance + 1 from climb u join cut k on k.tree = u.tree and k.node = u.anc where k.parent is not null)"""

_REFS = """refs as (
    select 'Parent' as kind, 'trace_transactions' as table_name, id as source, parent as target, min(arrived_at) as arrived_at from trace_transactions group by all
    union all select 'RelationSource', 'trace_relations', rel_seq, source, min(arrived_at) from trace_relations group by all
    union all select 'RelationDestination', 'trace_relations', rel_seq, destination, min(arrived_at) from trace_relations group by all),
  known as (select id as k from trace_transactions union select stage_id from embedded_stages),
  orphans as (select * from refs where target is not null and target <> 0
    and (target not in (select k from known where k is not null) or target in (select record_id from discarded_records where record_id is not null)))"""

_INTERVALS = f"""{_RECORDS},
  stages as (select stage_id, min(owner) as owner, coalesce(lower(trim(min(lane))), '') as lane, min(begin_tick) as b, min(end_tick) as e
    from embedded_stages group by stage_id),
  spans as (
    select 'generator' as entity, cast(generator as bigint) as entity_id, '' as lane, b, e from records
      where generator is not null and b is not null and e >= b and e <> 9223372036854775807
    union all
    select 'lane', s.owner, s.lane, s.b, coalesce(s.e, greatest(s.b, r.e)) from stages s left join records r on r.id = s.owner
      where s.owner is not null and s.b is not null and coalesce(s.e, greatest(s.b, r.e)) >= s.b),
  tops as (select *, max(e) over (partition by entity, entity_id, lane order by b, e rows between unbounded preceding and 1 preceding) as top from spans)"""

SQL = {
    "p1_found": f"""with {_RECORDS} select cast(generator as bigint) as generator from records where generator is not null
      group by generator having count(*) >= 0.02 * (select count(*) from records)""",
    "p1_totals": f"""with {_RECORDS}, ok as (select *, e >= b and e <> 9223372036854775807 and b is not null and e is not null as k from records)
      select cast(generator as bigint) as generator, count(*) as records, count(*) filter (where k) as with_interval, min(b) as first_begin,
        max(e) filter (where e <> 9223372036854775807) as last_end, cast(coalesce(sum(case when k then e - b end), 0) as bigint) as total_duration
      from ok group by generator""",
    "p2_found": f"""with recursive {_TREES}
      select tree, node as node_id, root as root_id, depth from deep where depth >= 16
      union all select tree, node, low, -1 from caught""",
    "p2_hierarchy": f"""with recursive {_TREES}, walk as (
        select tree, node, cast(node as varchar) as path from free where parent is null
        union all select f.tree, f.node, w.path || '/' || f.node from walk w join free f on f.tree = w.tree and f.parent = w.node),
      below as (select tree, anc as node, count(*) as n from up group by 1, 2)
      select d.tree, d.node as node_id, d.root as root_id, d.depth, coalesce(b.n, 0) as descendants, w.path
      from deep d join walk w on w.tree = d.tree and w.node = d.node left join below b on b.tree = d.tree and b.node = d.node""",
    "p2_cut_hierarchy": f"""with recursive {_CUT}, walk as (
        select tree, node, cast(0 as bigint) as depth, cast(node as varchar) as path from cut where parent is null
        union all select f.tree, f.node, w.depth + 1, w.path || '/' || f.node from walk w join cut f on f.tree = w.tree and f.parent = w.node),
      below as (select tree, anc as node, count(*) as n from climb group by 1, 2)
      select c.tree, c.node as node_id, c.root as root_id, w.depth, coalesce(b.n, 0) as descendants, w.path
      from cut c join walk w on w.tree = c.tree and w.node = c.node left join below b on b.tree = c.tree and b.node = c.node""",
    "p3_found": f"with {_REFS} select kind, source, target from orphans",
    "p3_report": f"""with {_REFS} select kind, table_name, cast(cast(arrived_at as date) as varchar) as day, count(*) as orphan_references,
        count(distinct target) as orphan_targets from orphans group by 1, 2, 3""",
    "p3_drift": f"""with {_REFS},
      now as (select distinct kind, case when kind = 'Parent' then source else 0 end as source, target from orphans),
      named as (select regexp_replace(lower(trim(kind)), '[^a-z]', '', 'g') as k, source, target from missing_references),
      kinds as (select case when k in ('parent', 'missingparent') then 'Parent' when k = 'relationsource' then 'RelationSource'
          when k in ('relationdestination', 'relationdest') then 'RelationDestination' when k = 'childblock' then 'ChildBlock'
          when k = 'clockgenerator' then 'ClockGenerator' else '' end as kind, source, target from named),
      old as (select distinct kind, case when kind = 'Parent' then source else 0 end as source, coalesce(target, 0) as target from kinds),
      both_sides as (select coalesce(n.kind, o.kind) as kind, n.kind as n, o.kind as o from now n full join old o
        on n.kind = o.kind and n.source = o.source and n.target = o.target)
      select kind, count(*) filter (where n is not null and o is not null) as confirmed, count(*) filter (where n is null and kind in ('Parent', 'RelationSource', 'RelationDestination')) as resolved,
        count(*) filter (where o is null) as unreported, count(*) filter (where n is null and kind not in ('Parent', 'RelationSource', 'RelationDestination')) as unchecked from both_sides group by kind""",
    "p5_found": f"""with {_INTERVALS} select entity, entity_id, lane, top + 1 as gap_begin, b - 1 as gap_end from tops where b - 1 > top""",
    "p5_busy": f"""with {_INTERVALS}, isl as (select *, sum(case when top is null or b - 1 > top then 1 else 0 end)
        over (partition by entity, entity_id, lane order by b, e rows unbounded preceding) as island from tops)
      select entity, entity_id, lane, min(b) as busy_begin, max(e) as busy_end from isl group by entity, entity_id, lane, island""",
}
