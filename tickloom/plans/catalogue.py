"""Queries of the trace operators over the driver's tables, with the SQL that states them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import model
from tickloom.functions import bits
from tickloom.operators import activity, clocks, joins, relations, scopes, transactions, validation, waveform
from tickloom.sources.testdata import HOUR, Trace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DAY = 24 * HOUR
#: Windows that the windowed queries ask about.
TICKS = (5 * DAY, 9 * DAY)
TX_WINDOW = (1_000_000, 1_400_000)
DAY_WINDOW = (1500, 1530)


def query(sql: str | None = None):
    """Register a query over a Trace under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(Trace(spark, d))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_CH = """changes as (select user_id as signal_id, epoch_us(ts) - 1704067200000000 as time, event_id as seq, event_type as text, value as real,
    lpad(bin(cast(json_extract_string(props, '$.k') as bigint)), 8, '0') as bits from events)"""
_HOURS = f"{_CH}, hourly as (select signal_id, time // {HOUR} as time, seq, text from changes)"
_PROBES = f"{_CH}, probes as (select signal_id, k * {4 * DAY} as probe_time from (select distinct signal_id from changes), range(8) r(k))"
_TX = """tx as (select id, min(nullif(parent, 0)) as parent, cast(min(generator) as bigint) as generator, min(begin_tick) as b, min(end_tick) as e, min(status) as status,
    min(span_kind) as span_kind, min(attrs) as attrs, min(block) as block from trace_transactions where id is not null group by id)"""
_EMB = """emb as (select stage_id as id, min(owner) as owner, min(stage_name) as name, coalesce(lower(trim(min(lane))), '') as lane, min(begin_tick) as b, min(end_tick) as e
    from embedded_stages where stage_id is not null group by stage_id)"""
_REL = """rel as (select rel_seq as seq, min(kind) as kind, min(source) as source, min(destination) as destination, min(block) as block
    from trace_relations where rel_seq is not null group by rel_seq)"""
_ORD = """ord as (select o_orderkey + 1000000000 as id, o_custkey as customer, cast(substr(o_orderpriority, 1, 1) as bigint) as generator,
      date_diff('day', date '1992-01-01', cast(o_orderdate as date)) as b,
      greatest(date_diff('day', date '1992-01-01', cast(o_orderdate as date)), l.last) as e,
      case o_orderstatus when 'F' then 1 when 'O' then 4 else 0 end as status
    from orders left join (select l_orderkey, max(date_diff('day', date '1992-01-01', cast(l_shipdate as date))) as last from lineitem group by 1) l on l_orderkey = o_orderkey)"""
_LOC = """loc as (select l_orderkey * 8 + l_linenumber + 2000000000 as id, case l_returnflag when 'A' then 'event' when 'R' then 'log' else 'stage' end as kind,
      l_suppkey as generator, date_diff('day', date '1992-01-01', cast(l_shipdate as date)) as b,
      date_diff('day', date '1992-01-01', cast(l_shipdate as date)) + case when l_returnflag in ('A', 'R') then 0 else cast(l_quantity as bigint) end as e,
      l_orderkey + 1000000000 as parent from lineitem)"""
_CLK = """clk as (select cast(substr(p_brand, 7) as bigint) as clock, p_partkey as id, p_partkey * 10000 as b, p_partkey * 10000 + p_size * (p_partkey % 50) as e,
      case when p_partkey % 50 > 0 then p_size end as period from part)"""
_NODES = """nodes as (
      select r_regionkey + 1 as node_id, cast(null as bigint) as parent_id, 'scope' as node_kind, r_name as name, cast(null as bigint) as signal_id from region
      union all select n_nationkey + 100, n_regionkey + 1, 'scope', n_name, null from nation
      union all select c_custkey + 1000000000, c_nationkey + 100, 'variable', c_name, c_nationkey from customer
      union all select s_suppkey + 2000000000, s_nationkey + 100, 'variable', s_name, s_nationkey + 1000 from supplier),
    tree as (select node_id, parent_id, node_kind, name, signal_id, 0 as depth, cast(name as varchar) as path, [cast(node_id as bigint)] as ancestors from nodes where parent_id is null
      union all select n.node_id, n.parent_id, n.node_kind, n.name, n.signal_id, t.depth + 1, t.path || '.' || n.name, list_append(t.ancestors, cast(n.node_id as bigint))
      from nodes n join tree t on n.parent_id = t.node_id)"""


# --- waveforms ---------------------------------------------------------------------------------


def _probes(t: Trace, every: int = 4 * DAY) -> DataFrame:
    return t.changes.select("signal_id").distinct().select("signal_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).select("signal_id", (F.col("k") * every).cast("bigint").alias("probe_time"))


@query(f"with {_PROBES} select p.signal_id, p.probe_time, c.time as since, c.text, c.bits from probes p asof left join changes c on p.signal_id = c.signal_id and p.probe_time >= c.time")
def value_at_probes(t):
    return waveform.value_at(t.changes, _probes(t), ["text", "bits"])


@query(f"""with {_PROBES} select p.signal_id, p.probe_time, c.time as since, coalesce(c.text, 'idle') as text
    from probes p asof left join changes c on p.signal_id = c.signal_id and p.probe_time >= c.time""")
def value_at_default(t):
    return waveform.value_at(t.changes, _probes(t), ["text"], {"text": "idle"})


@query(f"with {_CH} select signal_id, max(time) as since, arg_max(text, time) as text from changes where time <= {9 * DAY} group by 1")
def value_at_time(t):
    return waveform.value_at_time(t.changes, 9 * DAY, ["text"])


@query(f"with {_CH} select signal_id, time, seq, text from changes where time between {TICKS[0]} and {TICKS[1]}")
def changes_window(t):
    return waveform.changes_window(t.changes, *TICKS).select("signal_id", "time", "seq", "text")


@query(f"with {_CH} select time, seq, text from changes where signal_id = 7")
def signal_changes(t):
    return waveform.changes_window(t.changes, None, None, 7).select("time", "seq", "text")


@query(f"with {_CH} select signal_id, time, seq, text, lead(time) over (partition by signal_id order by time, seq) as until from changes")
def hold_intervals(t):
    return waveform.hold_intervals(t.changes, ["text"])


@query(f"""with {_CH}, x as (select *, lag(text) over w as before, row_number() over w as rn from changes window w as (partition by signal_id order by time, seq))
    select signal_id, time, seq, text from x where rn = 1 or text is distinct from before""")
def dedup_held(t):
    return waveform.dedup_held(t.changes.select("signal_id", "time", "seq", "text"), "text")


@query(f"with {_CH} select signal_id, time, seq, bits, lag(bits) over (partition by signal_id order by time, seq) as before from changes")
def previous_values(t):
    return waveform.previous_values(t.changes.select("signal_id", "time", "seq", "bits"), "bits")


@query(f"""with {_CH}, p as (select signal_id, k * {6 * DAY} as start_time from (select distinct signal_id from changes), range(5) r(k))
    select p.signal_id, start_time, c.text from p asof left join changes c on p.signal_id = c.signal_id and p.start_time > c.time""")
def block_frames(t):
    starts = t.spark.range(5).select((F.col("id") * 6 * DAY).alias("start_time"))
    return waveform.frames(t.changes, starts, "text")


@query("select user_id as signal_id, event_type, count(*) as occurrences from events group by 1, 2")
def event_occurrences(t):
    """Every occurrence of an event signal counts, equal ones too."""
    return t.changes.groupBy("signal_id", F.col("text").alias("event_type")).agg(F.count(F.lit(1)).alias("occurrences"))


@query(f"with {_CH} select time, signal_id, seq, text from changes order by time, signal_id, seq limit 100")
def ordered_changes_topn(t):
    return waveform.ordered_changes(t.changes.select("time", "signal_id", "seq", "text"), 100)


@query(f"with {_HOURS} select distinct time from hourly")
def time_steps(t):
    return waveform.time_steps(t.hourly)


@query(f"with {_CH} select min(time) as first, max(time) as last from changes")
def waveform_range(t):
    return waveform.time_range([(t.changes, "time", "time")])


@query(f"""with {_TX}, {_EMB}, {_CLK}, ok as (select b, e from tx where e <> 9223372036854775807 union all select b, e from emb union all select b, e from clk)
    select least(min(b), min(e)) as first, max(coalesce(e, b)) as last from (select b, e from ok union all select b, null from tx)""")
def trace_time_range(t):
    """First and last tick over owners, embedded detail and clocks."""
    closed = t.transactions.filter(f"end <> {2**63 - 1}")
    parts = [(closed, "begin", "end"), (t.transactions, "begin", "begin"), (t.embedded, "begin", "end"), (t.clocks, "begin", "end")]
    low = [(closed, "end", "end"), (t.embedded, "end", "end")]
    return waveform.time_range(parts + low)


@query(f"""with {_CH} select 'top.' || p || signal_id as path, count(*) as changes, max(time) as last from changes, (values ('u'), ('alias')) v(p) group by 1""")
def alias_changes(t):
    names = t.changes.select("signal_id").distinct().select(F.explode(F.array(F.lit("top.u"), F.lit("top.alias"))).alias("p"), "signal_id").select(F.concat("p", "signal_id").alias("path"), "signal_id")
    return waveform.alias_changes(t.changes, names).groupBy("path").agg(F.count(F.lit(1)).alias("changes"), F.max("time").alias("last"))


_MARKS = [(3 * DAY, False), (4 * DAY, True), (20 * DAY, False)]


@query(f"""with {_CH} select signal_id, time, seq from changes where not (time >= {3 * DAY} and time < {4 * DAY}) and time < {20 * DAY}""")
def dump_suppression(t):
    """Changes outside the blackouts that three markers set."""
    marks = t.spark.createDataFrame(_MARKS, "time long, active boolean")
    return waveform.suppress_dumped(t.changes.select("signal_id", "time", "seq"), marks)


# --- activity ----------------------------------------------------------------------------------

_STRETCH = f"""{_HOURS}, ticks as (select distinct signal_id, time from hourly where time > (select min(time) from hourly)),
    st as (select signal_id, min(time) as first, max(time) as last from
      (select *, time - row_number() over (partition by signal_id order by time) as g from ticks) group by signal_id, g)"""


@query(f"with {_STRETCH} select signal_id, first, last, case when first < last then 1 else 0 end as gap from st")
def signal_activity(t):
    return activity.signal_activity(t.hourly)


@query(f"with {_STRETCH} select signal_id, cast(sum(last - first + 1) as bigint) as ticks, count(*) as stretches from st group by 1")
def activity_summary(t):
    return activity.activity_summary(t.hourly)


@query(f"with {_STRETCH} select distinct signal_id from st where first <= 110 and last >= 100")
def active_signals_window(t):
    return activity.signals_active(t.hourly, 100, 110)


@query(f"""with {_STRETCH}, w as (select i as window_id, i * 24 as f, i * 24 + i % 5 - 1 as l from range(30) r(i))
    select distinct window_id, signal_id from w join st on first <= l and last >= f and f <= l""")
def active_signals_many_windows(t):
    """Signals active in each window; every fifth window is reversed and has none."""
    i = F.col("id")
    windows = t.spark.range(30).select(i.alias("window_id"), (i * 24).alias("w_first"), (i * 24 + i % 5 - 1).alias("w_last"))
    return activity.active_in_windows(activity.signal_activity(t.hourly), "signal_id", "first", "last", windows)


@query(f"with {_STRETCH} select signal_id, 'top.alias' || signal_id as path from (select distinct signal_id from st where first <= 110 and last >= 100)")
def active_first_names(t):
    """Each active signal once, under its first name."""
    names = t.changes.select("signal_id").distinct().select("signal_id", F.explode(F.array(F.lit("top.alias"), F.lit("top.u"))).alias("p"))
    named = names.select("signal_id", F.concat("p", "signal_id").alias("path"), F.when(F.col("p") == "top.alias", 1).otherwise(2).alias("node_id"))
    return activity.first_names(activity.signals_active(t.hourly, 100, 110), named)


_GEN = f"""{_ORD}, {_LOC}, spans as (select generator, b, e from ord where e is not null
      union all select generator, b, case when e > b then e - 1 else b end from loc),
    tops as (select *, max(e) over (partition by generator order by b, e rows between unbounded preceding and 1 preceding) as top from spans),
    isl as (select *, sum(case when top is null or b > top + 1 then 1 else 0 end) over (partition by generator order by b, e rows unbounded preceding) as i from tops),
    act as (select generator, min(b) as b, max(e) as e from isl group by generator, i)"""


@query(f"with {_GEN} select generator, b as begin, e as end from act".replace("as begin", 'as "begin"').replace("as end", 'as "end"'))
def generator_activity(t):
    return activity.generator_activity(t.orders, t.located)


@query(f"with {_GEN} select distinct generator from act where b <= {DAY_WINDOW[1]} and e >= {DAY_WINDOW[0]}")
def active_generators_window(t):
    return activity.generators_active(t.orders, t.located, *DAY_WINDOW)


# --- transactions and located records ----------------------------------------------------------


@query(f"with {_TX} select id, generator from tx where b <= {TX_WINDOW[1]} and e >= {TX_WINDOW[0]}")
def tx_window_inclusive(t):
    return t.transactions_where(transactions.in_window(*TX_WINDOW, "begin_tick", "end_tick")).select("id", "generator")


@query(f"with {_LOC} select id, kind, b as \"begin\", e as \"end\" from loc where b <= {DAY_WINDOW[1]} and case when e > b then e > {DAY_WINDOW[0]} else b >= {DAY_WINDOW[0]} end")
def stage_window_half_open(t):
    return transactions.query_located(t.located, *DAY_WINDOW).select("id", "kind", "begin", "end")


@query(f"""with {_LOC} select 'from' as side, kind, count(*) as n from loc where case when e > b then e > {DAY_WINDOW[0]} else b >= {DAY_WINDOW[0]} end group by kind
    union all select 'to', kind, count(*) from loc where b <= {DAY_WINDOW[1]} group by kind""")
def stage_window_one_sided(t):
    """Located records from a tick on, and up to one."""
    sides = [transactions.query_located(t.located, first, last).withColumn("side", F.lit(s)) for s, first, last in (("from", DAY_WINDOW[0], None), ("to", None, DAY_WINDOW[1]))]
    return sides[0].unionByName(sides[1]).groupBy("side", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_CH} select seq as id, signal_id as generator from changes where text in ('error', 'purchase') and time between {TICKS[0]} and {TICKS[1]}")
def logs_without_owner(t):
    logs = t.logs.withColumn("kind", F.lit("log")).withColumn("end", F.col("begin"))
    return transactions.query_located(logs, *TICKS, parent=0).select("id", "generator")


@query(f"with {_TX} select id, status, span_kind from tx where generator = 3455 and parent is null and b <= 20000000")
def tx_by_generator(t):
    some = t.transactions_where("generator = 3455 and begin_tick <= 20000000 and coalesce(parent, 0) = 0")
    return transactions.query_transactions(some, None, 20_000_000, generator=3455, parent=0).select("id", "status", "span_kind")


@query(f"with {_TX}, {_EMB} select t.id, t.generator from tx t where t.id in (select owner from emb where id = 1000709)")
def tx_by_embedded_id(t):
    return transactions.query_transactions(t.transactions, embedded=t.embedded, embedded_id=1000709).select("id", "generator")


_ALL = f"""{_TX}, {_EMB}, {_LOC}, {_CLK}, every as (
    select id, 'transaction' as kind, generator, parent, b, e from tx
    union all select m.id, 'embedded_stage', t.generator, m.owner, m.b, coalesce(m.e, greatest(m.b, t.e)) from emb m left join tx t on t.id = m.owner
    union all select id, kind, generator, parent, b, e from loc
    union all select id, 'clock', clock, null, b, e from clk)"""


def _all(t):
    return transactions.records_all(t.transactions, t.embedded, t.located, t.clocks)


@query(f"with {_ALL} select kind, count(*) as records, min(b) as first, max(e) as last, count(parent) as owned from every group by kind")
def records_all_kinds(t):
    return _all(t).groupBy("kind").agg(F.count(F.lit(1)).alias("records"), F.min("begin").alias("first"), F.max("end").alias("last"), F.count("parent").alias("owned"))


@query(f"with {_ALL} select v.id, v.kind, v.parent, t.status, m.name, case when v.kind = 'embedded_stage' then m.e else v.e end as explicit_end from every v left join tx t on t.id = v.id and v.kind = 'transaction'"
    f"    left join emb m on m.id = v.id and v.kind = 'embedded_stage' where v.id in (select record_id from discarded_records)")
def record_lookup(t):
    return transactions.lookup(_all(t), t.raw("discarded_records").select(F.col("record_id").alias("id"))).select("id", "kind", "parent", "status", "name", "explicit_end")


@query(f"with {_TX}, {_EMB} select m.id, coalesce(m.e, greatest(m.b, t.e)) as effective_end from emb m join tx t on t.id = m.owner where m.e is null")
def embedded_effective_end(t):
    owner = t.transactions.select(F.col("id").alias("owner"), F.col("end").alias("owner_end"))
    return t.embedded.filter("end is null").join(owner, "owner").select("id", bits.effective_end("begin", "end", "owner_end").alias("effective_end"))


@query(f"with {_TX} select c.parent, count(*) as children, min(c.id) as first_child from tx c join tx p on p.id = c.parent where p.generator in (select generator from trace_generators where gen_kind = 'REQUEST') group by 1")
def children_of(t):
    wanted = t.generators.filter("gen_kind = 'REQUEST'").select("generator")
    parents = t.transactions.join(wanted, "generator", "left_semi").select("id")
    return transactions.children_of(t.transactions, parents).groupBy("parent").agg(F.count(F.lit(1)).alias("children"), F.min("id").alias("first_child"))


@query(f"""with {_ORD}, {_LOC} select l.parent as owner, l.kind, l.id, l.b as "begin", l.e as "end" from loc l join ord o on o.id = l.parent where o.generator = 2 and l.kind <> 'log'""")
def expand_owner(t):
    return transactions.expand(t.orders.filter("generator = 2"), t.located)


@query(f"""with {_ORD}, {_LOC} select l.parent as owner, l.id, l.b as "begin" from loc l join ord o on o.id = l.parent
    where o.generator = 1 and l.kind = 'log' and l.b between {DAY_WINDOW[0]} and {DAY_WINDOW[1]}""")
def owner_logs(t):
    logs = transactions.query_located(t.located, *DAY_WINDOW, kind="log")
    owners = t.orders.filter("generator = 1").select(F.col("id").alias("parent"))
    return logs.join(owners, "parent", "left_semi").select(F.col("parent").alias("owner"), "id", "begin")


@query(f"""with {_ORD}, {_LOC} select kind, count(*) as outside from loc l join ord o on o.id = l.parent where l.b < o.b or l.e > o.e group by kind""")
def stage_outside_owner(t):
    parts = t.located.withColumnRenamed("parent", "owner")
    return transactions.outside_owner(parts, t.orders).groupBy("kind").agg(F.count(F.lit(1)).alias("outside"))


@query(f"""with {_EMB} select id, owner, lane, coalesce(e, lead(b) over (partition by owner, lane order by b, id)) as closed from emb""")
def lane_autoclose(t):
    return transactions.lane_autoclose(t.embedded.withColumn("seq", F.col("id"))).select("id", "owner", "lane", "closed")


@query(f"with {_TX} select generator, id from (select generator, id, row_number() over (partition by generator order by id) as r from tx where status = 4) where r <= 3")
def tracker_bind_oldest(t):
    return transactions.oldest(t.transactions_where("status = 4").select("generator", "id"), "generator", 3)


@query(f"with {_TX}, k as (select generator, max(id) as key from tx where status = 2 group by 1) select t.generator, count(*) as younger from tx t join k using (generator) where t.id > k.key group by 1")
def tracker_younger(t):
    tx = t.transactions.select("generator", "id", "status")
    return transactions.younger(tx, "generator", tx.filter("status = 2")).groupBy("generator").agg(F.count(F.lit(1)).alias("younger"))


@query(f"with {_TX} select id, attrs[5] as status from tx where attrs[2] = 4800")
def address_search(t):
    return t.transactions_where(F.get("attrs", F.lit(1)) == 4800).select("id", F.get("attrs", F.lit(4)).alias("status"))


@query(f"with {_TX} select greatest(count(*) - 100, 0) as more from tx where b <= {TX_WINDOW[1]} and e >= {TX_WINDOW[0]}")
def truncation_count(t):
    """Rows that a listing of 100 leaves out."""
    return t.transactions_where(transactions.in_window(*TX_WINDOW, "begin_tick", "end_tick")).agg(F.greatest(F.count(F.lit(1)) - 100, F.lit(0)).alias("more"))


@query(f"""with {_TX} select case status when 0 then 'unset' when 1 then 'ok' when 2 then 'error' when 3 then 'aborted' when 4 then 'open' end as status,
    case span_kind when 0 then 'unspecified' when 1 then 'internal' when 2 then 'server' when 3 then 'client' when 4 then 'producer' when 5 then 'consumer' end as span_kind,
    count(*) as records from tx group by 1, 2""")
def code_names(t):
    named = t.transactions.select(model.code_name("status", model.STATUS).alias("status"), model.code_name("span_kind", model.SPAN_KIND).alias("span_kind"))
    return named.groupBy("status", "span_kind").agg(F.count(F.lit(1)).alias("records"))


# --- relations ---------------------------------------------------------------------------------

_ERR = f"{_TX}, {_REL}, err as (select id from tx where status = 2)"


@query(f"with {_ERR} select seq, kind, source, destination from rel where source in (select id from err)")
def relations_out(t):
    return relations.touching(t.relations, t.transactions_where("status = 2"), False).select("seq", "kind", "source", "destination")


@query(f"with {_ERR} select seq, kind, source, destination from rel where destination in (select id from err)")
def relations_in(t):
    return relations.touching(t.relations, t.transactions_where("status = 2"), True).select("seq", "kind", "source", "destination")


@query(f"with {_REL} select kind, source, destination, count(*) as n from rel group by 1, 2, 3")
def relation_scan_multiset(t):
    return relations.scan_counts(t.relations)


@query(f"with {_REL} select seq, kind from rel where source is null or source = 0 or destination is null or destination = 0")
def relations_outside(t):
    return relations.outside(t.relations).select("seq", "kind")


@query(f"""with recursive {_REL}, edges as (select distinct source as a, destination as b from rel where source <> 0 and destination <> 0),
    walk as (select distinct record_id as start, record_id as id, 0 as hops from discarded_records where record_id is not null
      union select w.start, e.b, w.hops + 1 from walk w join edges e on e.a = w.id where w.hops < 2)
    select start, id, min(hops) as hops from walk group by 1, 2""")
def reachability_2hop(t):
    return relations.reachable(t.relations, t.raw("discarded_records").select(F.col("record_id").alias("id")), 2)


# --- hierarchy ---------------------------------------------------------------------------------


@query(f"with recursive {_NODES} select node_id, depth, path from tree")
def scope_paths(t):
    return scopes.closed(t.scopes).select("node_id", "depth", "path")


@query(f"with recursive {_NODES} select min(node_id) as node_id, path from tree where path = 'ASIA.NATION_12' and node_kind = 'scope' group by path")
def find_by_path(t):
    return scopes.find_path(t.scopes, "ASIA.NATION_12", "scope")


_SIZES = f"""{_NODES}, below as (select unnest(ancestors) as anc, node_id, node_kind, signal_id from tree)"""


@query(f"""with recursive {_SIZES} select anc as node_id, count(*) filter (where node_kind = 'scope') as scopes, count(*) filter (where node_kind = 'variable') as variables,
    count(distinct signal_id) as signals from below where anc < 1000000 group by 1""")
def scope_sizes(t):
    variables = t.scopes.filter("node_kind = 'variable'").select(F.col("parent_id").alias("scope"), "signal_id")
    return scopes.scope_sizes(scopes.closed(t.scopes.filter("node_kind = 'scope'")), variables)


@query(f"""with recursive {_SIZES} select anc as node_id, count(*) filter (where node_kind = 'scope') as scopes,
    count(*) filter (where node_kind = 'variable' and signal_id % 3 = 0) as variables,
    count(distinct case when signal_id % 3 = 0 then signal_id end) as signals from below where anc < 1000000 group by 1""")
def scope_sizes_subset(t):
    """The rollup for an arbitrary set of signals, here every third."""
    variables = t.scopes.filter("node_kind = 'variable'").select(F.col("parent_id").alias("scope"), "signal_id")
    subset = variables.filter("signal_id % 3 = 0").select("signal_id")
    return scopes.scope_sizes(scopes.closed(t.scopes.filter("node_kind = 'scope'")), variables, subset)


@query(f"with recursive {_NODES} select node_id, path from tree where list_contains(ancestors, 3)")
def within_scope(t):
    return scopes.within_scope(scopes.closed(t.scopes), 3).select("node_id", "path")


@query(f"with recursive {_NODES} select node_kind, count(*) as nodes from nodes group by 1")
def node_kind_counts(t):
    return scopes.kind_counts(t.scopes)


@query(f"with recursive {_NODES} select node_id, path from tree where depth < 2 and node_kind <> 'variable'")
def scope_listing(t):
    return scopes.listing(scopes.closed(t.scopes), 2, False).select("node_id", "path")


@query("select n_nationkey + 100 as node_id, n_name as name from nation where n_regionkey + 1 = 2")
def scope_children(t):
    return scopes.children(t.scopes, 2).select("node_id", "name")


_CENSUS = """census as (select scope as node_id, min(case when parent <> -1 then parent end) as parent_id, coalesce(min(scope_name), '') as name from census_scopes where scope is not null group by scope),
    kept as (select a.node_id, b.node_id as parent_id, a.name from census a left join census b on b.node_id = a.parent_id),
    walk as (select node_id, 0 as depth, name as path, [cast(node_id as bigint)] as ancestors from kept where parent_id is null
      union all select k.node_id, w.depth + 1, w.path || '.' || k.name, list_append(w.ancestors, cast(k.node_id as bigint)) from walk w join kept k on k.parent_id = w.node_id)"""


@query(f"with recursive {_CENSUS} select cast(node_id as bigint) as node_id, cast(depth as bigint) as depth, path from walk")
def census_paths(t):
    return scopes.closed(t.census).select("node_id", "depth", "path")


@query(f"""with recursive {_CENSUS} select unnest(w.ancestors) as scope, count(*) as generators, count(distinct g.gen_kind) as kinds
    from trace_generators g join walk w on w.node_id = g.scope group by 1""")
def generators_within(t):
    """Generators and their kinds in the subtree of every scope that has any."""
    up = scopes.closed(t.census).select(F.col("node_id").alias("scope"), "ancestors")
    climbed = t.generators.join(up, "scope").select(F.explode("ancestors").alias("scope"), "generator", "gen_kind")
    return climbed.groupBy("scope").agg(F.count("generator").alias("generators"), F.countDistinct("gen_kind").alias("kinds"))


@query("""select cast(g.generator as bigint) as generator, cast(g.clock as bigint) as clock from trace_generators g join trace_generators c on c.generator = g.clock and c.gen_kind = 'CLOCK'""")
def clock_for_generator(t):
    return clocks.clock_of(t.generators)


@query(f"""with recursive {_TX}, v as (select id, case when parent < id then parent end as ref, b as value from tx), kept as (select v.id, r.id as ref, v.value from v left join v r on r.id = v.ref),
    walk as (select id, id as target, value from kept where ref is null union all select k.id, w.target, w.value from walk w join kept k on k.ref = w.id) select id, target, value from walk""")
def ref_resolution(t):
    """Values that refer to earlier ones, here transactions to older parents, followed to the last one."""
    return scopes.resolve_refs(t.transactions.select("id", F.when(F.col("parent") < F.col("id"), F.col("parent")).alias("ref"), F.col("begin").alias("value")))


@query("""select g.gen_name, s.scope_name, count(*) as n from trace_generators g join (select distinct scope, scope_name from census_scopes) s using (scope) group by 1, 2""")
def string_dictionary_join(t):
    names = t.raw("census_scopes").select(F.col("scope").cast("bigint").alias("scope"), "scope_name").distinct()
    return t.generators.join(names, "scope").groupBy("gen_name", "scope_name").agg(F.count(F.lit(1)).alias("n"))


# --- clocks ------------------------------------------------------------------------------------


@query(f"with {_CLK} select clock, id, b as \"begin\", e as \"end\", period from clk order by clock, b")
def clock_stretches(t):
    return t.clocks.orderBy("clock", "begin")


_PROBE_CLOCKS = "probes as (select c.clock, k * 777777 as probe_time from (select distinct clock from clk) c, range(40) r(k))"


@query(f"""with {_CLK}, {_PROBE_CLOCKS}, n as (select *, sum((e - b) // coalesce(period, 1) + 1) over (partition by clock order by b, id rows between unbounded preceding and 1 preceding) as base from clk)
    select p.clock, p.probe_time, cast(coalesce(n.base, 0) + (least(p.probe_time, n.e) - n.b) // coalesce(n.period, 1) as bigint) as cycle
    from probes p asof left join n on n.clock = p.clock and p.probe_time >= n.b""")
def clock_cycle_at(t):
    probes = t.clocks.select("clock").distinct().select("clock", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k")).select("clock", (F.col("k") * 777777).cast("bigint").alias("probe_time"))
    return clocks.cycle_at(t.clocks, probes)


@query(f"""with {_CLK}, w as (select clock, id, b + 5000 * (id % 3) as b, e + 9000 * (id % 3) as e from clk), x as (select *, lag(e) over (partition by clock order by b, id) as before from w)
    select clock, id, b as "begin", before from x where before >= b""")
def clock_overlap_check(t):
    """Overlaps among stretches that were moved and widened."""
    k = F.col("id") % 3
    moved = t.clocks.withColumn("begin", F.col("begin") + 5000 * k).withColumn("end", F.col("end") + 9000 * k)
    return clocks.overlaps(moved)


@query(f"""with {_CLK}, w as (select clock, id, b, e + id % 2 as e, case when id % 7 = 0 then null else period end as period from clk)
    select clock, id from w where (e > b and period is null) or period <= 0 or (e = b and period is not null) or (period > 0 and (e - b) % period <> 0)""")
def clock_period_check(t):
    changed = t.clocks.withColumn("end", F.col("end") + F.col("id") % 2).withColumn("period", F.when(F.col("id") % 7 != 0, F.col("period")))
    return clocks.period_faults(changed).select("clock", "id")


@query("""with runs as (select cast(substr(p_brand, 7) as bigint) as clock, p_partkey as seq, p_partkey * 100 as first, cast(p_size as bigint) as period,
      case when p_partkey % 4 = 0 then p_partkey * 100 + 500 end as stop from part),
    x as (select *, lead(first) over (partition by clock order by first, seq) as nf from runs),
    u as (select *, greatest(least(coalesce(stop, 9223372036854775807), coalesce(nf - 1, 9223372036854775807)), first) as u from x where stop is not null or nf is not null)
    select clock, seq as id, first as "begin", first + (u - first) // period * period as "end", case when (u - first) // period > 0 then period end as period from u
    union all select clock, seq, first, null, null from x where stop is null and nf is null""")
def clock_runs(t):
    """Stretches from runs and stops; the last run of a clock without a stop is still open."""
    p = F.col("p_partkey")
    runs = t.raw("part").select(
        F.expr("cast(substring(p_brand, 7) as bigint)").alias("clock"), p.alias("seq"), (p * 100).alias("first"), F.col("p_size").cast("bigint").alias("period"),
        F.when(p % 4 == 0, p * 100 + 500).alias("stop"),
    )
    return clocks.from_runs(runs)


# --- scalar functions --------------------------------------------------------------------------


@query(f"with {_CH} select seq, cast(substr(bits, 1, 1) as bigint) * 128 + cast(substr(bits, 2, 1) as bigint) * 64 + cast(substr(bits, 3, 1) as bigint) * 32 + cast(substr(bits, 4, 1) as bigint) * 16 + cast(substr(bits, 5, 1) as bigint) * 8 + cast(substr(bits, 6, 1) as bigint) * 4 + cast(substr(bits, 7, 1) as bigint) * 2 + cast(substr(bits, 8, 1) as bigint) * 1 as value from changes")
def bits_as_u64(t):
    return t.changes.select("seq", bits.as_u64("bits").cast("bigint").alias("value"))


@query(f"""with {_CH}, r as (select seq, ltrim(replace(bits, '1', 'x'), '0') as s from changes)
    select seq, case when length(s) = 0 then '000000000000' when left(s, 1) = 'x' then repeat('x', cast(12 - length(s) as int)) || s else lpad(s, 12, '0') end as wide,
      right(lpad(s, 8, case when left(s, 1) = 'x' then 'x' else '0' end), 3) as low from r""")
def bits_extend(t):
    raw = F.ltrim(F.translate("bits", "1", "x"), F.lit("0"))
    return t.changes.select("seq", bits.pack_ascii(raw, 12).alias("wide"), bits.pack_ascii(raw, 3).alias("low"))


@query(f"""with {_CH} select seq, not regexp_matches(case when seq % 3 = 0 then replace(bits, '1', 'z') else bits end, '[^01]') as two_state,
    case when seq % 3 = 0 and bits like '%1%' then null else bits end as narrow, substr(bits, 6, 1) as bit2, coalesce(nullif(strpos('01xzuwlh-', substr(bits, 8, 1)), 0) - 1, 2) as code0 from changes""")
def two_state_check(t):
    odd = F.when(F.col("seq") % 3 == 0, F.translate("bits", "1", "z")).otherwise(F.col("bits"))
    return t.changes.select(
        "seq", bits.is_two_state(odd).alias("two_state"), bits.narrow(odd).alias("narrow"), bits.state_at("bits", 2).alias("bit2"), bits.state_code(bits.state_at("bits", 0)).cast("bigint").alias("code0")
    )


@query("""select e as encoding, w as width, s as states, case when e = 'bits' and s = 2 then repeat('0', w) when e = 'bits' then repeat('x', w) when e = 'real' then '0.0' else '' end as value,
    cast(ceil(w / case when s <= 2 then 8.0 when s <= 4 then 4.0 else 2.0 end) as bigint) as packed from (values ('bits', 7, 2), ('bits', 37, 4), ('bits', 17, 9), ('real', 64, 2), ('bytes', 1, 2)) v(e, w, s)""")
def signal_defaults(t):
    kinds = t.spark.createDataFrame([("bits", 7, 2), ("bits", 37, 4), ("bits", 17, 9), ("real", 64, 2), ("bytes", 1, 2)], "encoding string, width int, states int")
    return kinds.select("encoding", "width", "states", bits.default_value("encoding", "width", "states").alias("value"), bits.packed_length("width", "states").alias("packed"))


@query("""select l_orderkey as k, l_orderkey & 255 as low8, (l_orderkey * 4294967296 + l_partkey) >> 32 & 4294967295 as word1, count(*) as n from lineitem group by 1, 2, 3""")
def word_packing(t):
    v = F.col("l_orderkey") * F.lit(1 << 32) + F.col("l_partkey")
    return t.raw("lineitem").groupBy(F.col("l_orderkey").alias("k"), bits.masked("l_orderkey", 8).alias("low8"), bits.word32(v, 1).alias("word1")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_TX} select id, chr(cast(33 + id % 94 as int)) || case when id >= 94 then chr(cast(33 + id // 94 % 94 as int)) else '' end || case when id >= 8836 then chr(cast(33 + id // 8836 % 94 as int)) else '' end
    || case when id >= 830584 then chr(cast(33 + id // 830584 % 94 as int)) else '' end as code from tx where id < 78074896""")
def vcd_id_codes(t):
    return t.transactions.filter("id < 78074896").select("id", bits.vcd_id("id").alias("code"))


@query("""select e, case when e between -15 and 2 then cast([1, 10, 100][(e + 15) % 3 + 1] as varchar) || ['fs', 'ps', 'ns', 'us', 'ms', 's'][(e + 15) // 3 + 1] end as scale from (select range - 17 as e from range(22))""")
def timescale_names(t):
    return t.spark.range(22).select((F.col("id") - 17).alias("e")).select("e", bits.timescale_text("e").alias("scale"))


@query("select vec_id, len(embedding) as n, round(cast(embedding[3] as double), 5) as third, embedding[100] is null as beyond from embeddings")
def sequence_element(t):
    e = F.col("embedding")
    return t.raw("embeddings").select("vec_id", F.size(e).cast("bigint").alias("n"), F.round(F.get(e, F.lit(2)).cast("double"), 5).alias("third"), F.get(e, F.lit(99)).isNull().alias("beyond"))


# --- logs --------------------------------------------------------------------------------------

_LOGS = """sites as (select * from (values (1, 'request {} failed', 4), (2, 'bought {:#x}', 2)) v(datatype_id, format, severity)),
    logs as (select event_id as id, user_id as generator, case event_type when 'error' then 1 else 2 end as datatype_id, epoch_us(ts) - 1704067200000000 as b,
      cast(json_extract_string(props, '$.k') as bigint) as arg from events where event_type in ('error', 'purchase'))"""


@query(f"with {_LOGS} select l.id, l.generator, s.severity from logs l join sites s using (datatype_id) where s.severity >= 3")
def callsite_logs_by_severity(t):
    from tickloom.operators import logs

    return logs.at_least(t.logs, t.callsites, 3).select("id", "generator", "severity")


@query(f"with {_LOGS} select id, 'request ' || arg || ' failed' as message from logs where datatype_id = 1")
def log_render_simple(t):
    """Formats of plain places are rendered by concatenation, without Python."""
    from tickloom.operators import logs

    return logs.render_plain(t.logs.filter("datatype_id = 1"), t.callsites.filter("datatype_id = 1"), ["arg"]).select("id", "message")


@query(f"with {_LOGS} select id, case datatype_id when 1 then 'request ' || arg || ' failed' else 'bought 0x' || lower(hex(arg)) end as message from logs")
def log_render_full(t):
    from tickloom.operators import logs

    return logs.render(t.logs, t.callsites, ["arg"]).select("id", "message")


@query(f"with {_LOGS} select id, '#' || lpad(cast(arg as varchar), 6, ' ') || '|' || lower(hex(arg)) as message from logs")
def printf_render(t):
    from tickloom.operators import logs

    sites = t.callsites.withColumn("format", F.lit("#%6d|%x"))
    return logs.render(t.logs, sites, ["arg", "arg"], style="printf").select("id", "message")


@query("select case severity when 0 then 'trace' when 1 then 'debug' when 2 then 'info' when 3 then 'warn' when 4 then 'error' when 5 then 'fatal' else 'other' end as name, severity from (select range as severity from range(9))")
def severity_names(t):
    return t.spark.range(9).select(model.code_name("id", model.SEVERITY).alias("name"), F.col("id").alias("severity"))


# --- validation --------------------------------------------------------------------------------


@query(f"with {_TX} select parent as target, count(*) as n from tx where parent is not null and parent not in (select id from tx) group by 1")
def dangling_parents(t):
    return validation.dangling(t.transactions.select("parent"), "parent", [t.transactions.select("id")])


@query(f"""with {_TX}, {_EMB}, {_REL}, known as (select id from tx union all select id from emb)
    select side, target, count(*) as n from (select 'source' as side, source as target from rel union all select 'destination', destination from rel)
    where target is not null and target <> 0 and target not in (select id from known) group by 1, 2""")
def dangling_endpoints(t):
    known = [t.transactions.select("id"), t.embedded.select("id")]
    parts = [validation.dangling(t.relations.select(s), s, known).withColumn("side", F.lit(s)) for s in ("source", "destination")]
    return parts[0].unionByName(parts[1])


@query(f"with {_LOC} select id, count(*) as n from loc group by id having count(*) > 1")
def duplicate_ids(t):
    return validation.duplicates(t.located, "id")


@query(f"with {_TX} select id, parent from tx where parent >= id and parent in (select id from tx)")
def parent_order_check(t):
    return validation.parent_order(t.transactions)


@query(f"""with {_TX} select rule, id from (select 'end before begin' as rule, id from tx where e < b union all select 'missing tick', id from tx where b is null or e is null
    union all select 'id', id from tx where id <= 0
    union all select 'status', id from tx where status not between 0 and 4 union all select 'span kind', id from tx where span_kind not between 0 and 5)""")
def transaction_shape(t):
    return validation.transaction_shape(t.transactions)


@query(f"with {_TX}, {_EMB}, m as (select id, case when id % 97 = 0 then id + id % 2 else owner end as owner from emb) select id, owner from m where id <= owner")
def embedded_id_order(t):
    """Embedded records that aren't younger than their owner; some owners are shifted."""
    shifted = F.when(F.col("id") % 97 == 0, F.col("id") + F.col("id") % 2).otherwise(F.col("owner"))
    return validation.embedded_order(t.embedded.withColumn("owner", shifted))


@query(f"""with {_TX}, held as (select distinct p.id as owner, c.block from tx c join tx p on p.id = c.parent), listed as (select owner, block + (case when owner % 50 = 0 then 1 else 0 end) as block from held)
    select owner, block, side from (select *, 'listed' as side from (select * from listed except select * from held) union all select *, 'actual' from (select * from held except select * from listed))""")
def child_block_mismatch(t):
    """Listed child blocks, every fiftieth owner's shifted, against the actual ones."""
    child = t.transactions.select(F.col("parent").alias("owner"), "block")
    held = child.join(t.transactions.select(F.col("id").alias("owner")), "owner", "left_semi").distinct()
    listed = held.withColumn("block", F.col("block") + F.when(F.col("owner") % 50 == 0, 1).otherwise(0))
    return transactions.missing_blocks(listed, held)


@query("""with g as (select cast(generator as bigint) as generator, gen_kind, cast(case when generator % 5 = 0 then generator % 2 * 100000 + generator else clock end as bigint) as clock from trace_generators)
    select g.generator, g.clock, case when c.generator is null then 'missing' else 'not a clock' end as fault from g left join g c on c.generator = g.clock
    where g.clock is not null and (c.generator is null or c.gen_kind is distinct from 'CLOCK')""")
def clock_target_check(t):
    """Clocks that don't exist or are none; every fifth generator names itself or nothing known."""
    g = F.col("generator")
    return validation.clock_targets(t.generators.withColumn("clock", F.when(g % 5 == 0, g % 2 * 100000 + g).otherwise(F.col("clock"))))


@query(f"""with {_TX}, {_EMB}, {_REL}, known as (select id from tx union all select id from emb)
    select 'records' as what, count(*) as n from known union all select 'relations', count(*) from rel
    union all select 'missing parents', count(*) from tx where parent is not null and parent not in (select id from tx)
    union all select 'missing sources', count(*) from rel where source is not null and source <> 0 and source not in (select id from known)
    union all select 'missing destinations', count(*) from rel where destination is not null and destination <> 0 and destination not in (select id from known)
    union all select 'repeated ids', count(*) from (select id from known group by id having count(*) > 1)""")
def validation_counts(t):
    return validation.counts(t.transactions, t.embedded, t.relations)


@query(f"""with {_REL} select kind, count(*) as n, bit_xor(seq * 1000003 + coalesce(source, 0)) as mixed, cast(sum((coalesce(source, 0) % 1000003) * 31 + coalesce(destination, 0) % 1000003) as bigint) as total from rel group by kind""")
def digest(t):
    """Counts and sums that don't depend on order, to compare recordings."""
    s, d = F.coalesce("source", F.lit(0)), F.coalesce("destination", F.lit(0))
    return t.relations.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.col("seq") * 1000003 + s).alias("mixed"), F.sum((s % 1000003) * 31 + d % 1000003).alias("total")
    )


@query("select reason, count(*) as n, min(record_id) as lowest, min(discarded_at) = arg_min(discarded_at, discarded_at) as same from discarded_records group by reason")
def diagnostics(t):
    """Per reason its count and first occurrence."""
    return t.raw("discarded_records").groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"), F.min("record_id").alias("lowest"), (F.min("discarded_at") == F.min_by("discarded_at", "discarded_at")).alias("same")
    )


# --- joins and windows that Spark adds ---------------------------------------------------------


@query(f"""with {_ORD} select a.id as a, b.id as b from ord a join ord b on a.customer = b.customer and a.id < b.id and a.b <= b.e and a.e >= b.b where a.e is not null and b.e is not null""")
def interval_overlap_join(t):
    """Orders of one customer that overlap in time."""
    o = t.orders.select("customer", "id", "begin", "end")
    other = o.select("customer", F.col("id").alias("id2"), F.col("begin").alias("begin2"), F.col("end").alias("end2"))
    both = joins.overlap_join(o, other, ("begin", "end"), ("begin2", "end2"), ["customer"])
    return both.filter("id < id2").select(F.col("id").alias("a"), F.col("id2").alias("b"))


@query("select time_bucket(interval '1 day', ts) as day, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2".replace("time_bucket(interval '1 day', ts)", "cast(date_trunc('day', ts) as varchar)"))
def tumbling_windows(t):
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    out = t.raw("events").groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "n", "total")


@query(f"""with {_CH}, w as (select time // {6 * HOUR} - k as s, seq from changes, range(4) r(k)) select s * 6 as hour, count(*) as n from w group by 1""")
def sliding_windows(t):
    slid = t.raw("events").groupBy(F.window(F.col("ts").cast("timestamp"), "24 hours", "6 hours")).agg(F.count(F.lit(1)).alias("n"))
    hour = (F.unix_micros("window.start") - F.lit(1_704_067_200_000_000)) / F.lit(HOUR)
    return slid.select(F.round(hour).cast("bigint").alias("hour"), "n")


@query(f"""with {_CH}, x as (select *, time - lag(time) over (partition by signal_id order by time) as gap from changes),
    s as (select *, sum(case when gap is null or gap >= {12 * HOUR} then 1 else 0 end) over (partition by signal_id order by time rows unbounded preceding) as i from x)
    select signal_id, min(time) as first, max(time) as last, count(*) as n from s group by signal_id, i""")
def session_windows(t):
    ev = t.raw("events").select(F.col("user_id").alias("signal_id"), F.col("ts").cast("timestamp").alias("at"))
    out = ev.groupBy("signal_id", F.session_window("at", "12 hours")).agg(F.min("at").alias("f"), F.max("at").alias("l"), F.count(F.lit(1)).alias("n"))
    base = F.lit(1_704_067_200_000_000)
    return out.select("signal_id", (F.unix_micros("f") - base).alias("first"), (F.unix_micros("l") - base).alias("last"), "n")
