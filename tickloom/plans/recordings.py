"""Queries that write traces in the formats of traces, from the driver's tables, and read them back, with SQL over
the same tables; and those of capture: operation logs, streams and trackers."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import api, model
from tickloom.functions import bits
from tickloom.functions.formatting import Locale
from tickloom.operators import joins, logs, scopes, validation, waveform
from tickloom.operators.ordered import neighbours, running
from tickloom.plans.catalogue import _CH, _EMB, _LOC, _ORD, _REL, _TX, DAY, QUERIES, SQL, query
from tickloom.session import Scratch, shared_dir, started
from tickloom.sources import container, kanata, recording, vcd
from tickloom.sources.testdata import Trace
from tickloom.streaming import oplog, tracker

__all__ = ["QUERIES", "SQL"]

OPEN_END = 2**63 - 1
#: What has been written for a directory of tables by this application, by name.
_made: dict[tuple, str] = {}


def made(t: Trace, name: str, make) -> str:
    """The path of something written once per application and directory; `make` gets the path."""
    key = (t.spark.sparkContext.applicationId, shared_dir(t.spark), t.directory, name)
    if key not in _made:
        folder = Scratch(t.spark, name).root
        path = folder[5:] if folder.startswith("file:") else folder
        if ":/" not in path:
            os.makedirs("/" + path.lstrip("/"), exist_ok=True)
        make(f"{folder}/{name}")
        _made[key] = f"{folder}/{name}"
    return _made[key]


# --- the binary container ----------------------------------------------------------------------

#: Generators of the recording: five kinds of requests, then events, stages and logs.
_KINDS = ["REQUEST"] * 5 + ["EVENT", "STAGE", "LOG"]


def _owners(t: Trace) -> DataFrame:
    """Transactions that a recording can hold: those with an interval; parents must be older."""
    ok = (F.col("begin") >= 0) & (F.col("end") >= F.col("begin"))
    code = lambda c, most: F.when(F.col(c).between(0, most), F.col(c)).otherwise(0).alias(c)
    return t.transactions.filter(ok).select(
        "id", F.when(F.col("parent").between(1, F.col("id") - 1), F.col("parent")).alias("parent"), (1 + F.coalesce(F.pmod("generator", F.lit(5)), F.lit(0))).alias("generator"), "begin", "end",
        code("status", 4), code("span_kind", 5), F.col("attrs").alias("payload"),
    )


def _inside(t: Trace, owners: DataFrame | None = None) -> DataFrame:
    """Embedded detail of those owners; every fourth record is an event."""
    kind = F.when(F.col("id") % 4 == 0, "event").otherwise("stage")
    ok = (F.col("id") > F.col("owner")) & (F.col("begin") >= 0) & (F.col("end").isNull() | (F.col("end") >= F.col("begin")))
    own = t.embedded.filter(ok).join((owners or _owners(t)).select(F.col("id").alias("owner")), "owner", "left_semi")
    return own.select("id", kind.alias("kind"), "owner", F.coalesce("name", F.lit("")).alias("name"), "lane", "begin", "end")


def _edges(t: Trace) -> DataFrame:
    """Relations; an endpoint that is no id is outside the recording."""
    inside = lambda c: F.when(F.col(c) > 0, F.col(c)).alias(c)
    return t.relations.select("kind", inside("source"), inside("destination"))


def _signals(t: Trace, scratch: Scratch | None = None) -> DataFrame:
    """(user, rank) of the users, whose three signals are 3 rank .. 3 rank + 2: bits, a real, text. With a scratch
    the users are written before they are ranked, which takes several passes."""
    users = t.changes.select("signal_id").distinct()
    users = (scratch.write(users) if scratch else users).withColumn("one", F.lit(1))
    return running(users, ["one"], "signal_id", [], F.lit(1), "rank").select(F.col("signal_id").alias("user"), "rank")


def _waves(t: Trace, users: DataFrame | None = None) -> DataFrame:
    bits_ = F.when(F.col("seq") % 3 == 0, F.translate("bits", "1", "x")).otherwise(F.col("bits"))
    none = F.lit(None)
    each = F.array(
        F.struct(F.lit(0).alias("k"), bits_.alias("text"), none.cast("double").alias("real")), F.struct(F.lit(1).alias("k"), none.cast("string").alias("text"), F.col("value").alias("real")),
        F.struct(F.lit(2).alias("k"), F.col("event").alias("text"), none.cast("double").alias("real")),
    )
    rows = t.changes.select(F.col("signal_id").alias("user"), "time", "seq", "bits", F.col("text").alias("event"), F.col("real").alias("value")).join((users or _signals(t)).hint("shuffle_hash"), "user")
    return rows.withColumn("e", F.explode(each)).select((F.col("rank") * 3 + F.col("e.k")).cast("bigint").alias("signal_id"), "time", "seq", "e.text", "e.real")


def _nodes(t: Trace, users: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    fixed = [(0, None, "scope", "top", None, None)] + [(i + 1, 0, "generator", f"g{i + 1}", None, k) for i, k in enumerate(_KINDS)]
    schema = "node_id long, parent_id long, node_kind string, name string, signal_id long, gen_kind string"
    users = (users or _signals(t)).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    signal = F.col("rank") * 3 + F.col("k")
    none = F.lit(None)
    variables = users.select(
        (signal + 9).cast("bigint").alias("node_id"), F.lit(0).cast("bigint").alias("parent_id"), F.lit("variable").alias("node_kind"),
        F.concat(F.element_at(F.array(F.lit("b"), F.lit("r"), F.lit("t")), F.col("k") + 1), F.col("user").cast("string")).alias("name"), signal.cast("bigint").alias("signal_id"), none.cast("string").alias("gen_kind"),
    )
    shape = lambda a, b, c: F.element_at(F.array(F.lit(a), F.lit(b), F.lit(c)), F.col("k") + 1)
    signals = users.select(signal.cast("bigint").alias("signal_id"), shape("bits", "real", "bytes").alias("encoding"), shape(8, 0, 0).alias("width"), shape(4, 2, 2).alias("states"))
    return t.spark.createDataFrame(fixed, schema).unionByName(variables), signals


_BLACKOUTS = [(0, 3 * DAY, False), (1, 4 * DAY, True), (2, 4 * DAY, False), (3, 9 * DAY, True)]


def _write(t: Trace, path: str) -> None:
    scratch = Scratch(t.spark, "sources")
    with ThreadPoolExecutor(2) as pool:
        jobs = started(pool, t.spark, lambda: scratch.write(_signals(t, scratch))), started(pool, t.spark, lambda: scratch.write(_owners(t)))
        users, owners = (j.result() for j in jobs)
    nodes, signals = _nodes(t, users)
    kind = F.element_at(F.create_map(*(F.lit(x) for p in (("event", 6), ("stage", 7), ("log", 8)) for x in p)), F.col("kind")).cast("bigint")
    recording.write_recording(t.spark, path, {
        "nodes": nodes, "signals": signals, "changes": _waves(t, users), "transactions": owners, "embedded": _inside(t, owners), "relations": _edges(t),
        "located": t.located.withColumn("generator", kind), "blackouts": t.spark.createDataFrame(_BLACKOUTS, "seq long, time long, active boolean"),
    })
    scratch.drop(users, owners)


def read(t: Trace, table: str, path: str | None = None) -> DataFrame:
    container.register(t.spark)
    return t.spark.read.format("tickloom").option("table", table).load(path or made(t, "recording", lambda p: _write(t, p)))


_OWN = f"""{_TX}, own as (select id, case when parent between 1 and id - 1 then parent end as parent, 1 + coalesce(generator % 5, 0) as generator, b, e,
      case when status between 0 and 4 then status else 0 end as status, case when span_kind between 0 and 5 then span_kind else 0 end as span_kind, attrs from tx where b >= 0 and e >= b)"""
_INS = f"""{_OWN}, {_EMB}, ins as (select id, case when id % 4 = 0 then 'event' else 'stage' end as kind, owner, coalesce(name, '') as name, case when id % 4 <> 0 then lane end as lane, b,
      case when id % 4 = 0 then b else e end as e from emb where id > owner and b >= 0 and (e is null or e >= b) and owner in (select id from own))"""
_EDG = f"""{_REL}, edg as (select kind, case when source > 0 then source end as source, case when destination > 0 then destination end as destination from rel)"""
_WAV = f"""{_CH}, users as (select signal_id, dense_rank() over (order by signal_id) - 1 as r from (select distinct signal_id from changes)),
    waves as (select 3 * r as signal_id, time, seq, case when seq % 3 = 0 then replace(bits, '1', 'x') else bits end as text, null::double as real from changes join users using (signal_id)
      union all select 3 * r + 1, time, seq, null, real from changes join users using (signal_id) union all select 3 * r + 2, time, seq, text, null from changes join users using (signal_id))"""


@query(f"""with {_OWN} select id, parent, generator, b as "begin", e as "end", status, span_kind, '[' || coalesce(array_to_string(attrs, ', '), '') || ']' as payload from own""")
def recording_transactions(t):
    """Transactions written as blocks of a recording and read again."""
    return read(t, "transactions").select("id", "parent", "generator", "begin", "end", "status", "span_kind", "payload")


@query(f"""with {_INS} select id, kind, owner, name, lane, b as "begin", e as "end" from ins""")
def recording_embedded(t):
    return read(t, "embedded").select("id", "kind", "owner", "name", "lane", "begin", "end")


@query(f"with {_EDG} select coalesce(kind, '') as kind, source, destination, count(*) as n from edg group by 1, 2, 3")
def recording_relations(t):
    return read(t, "relations").groupBy("kind", "source", "destination").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_LOC} select id, kind, b as "begin", e as "end", parent, count(*) as n from loc group by all""")
def recording_located(t):
    return read(t, "located").groupBy("id", "kind", "begin", "end", "parent").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_WAV} select signal_id, time, text, real from waves")
def recording_changes(t):
    return read(t, "changes").select("signal_id", "time", "text", "real")


@query(f"with {_WAV} select time, text from waves where signal_id = 12 and time between {5 * DAY} and {15 * DAY}")
def recording_signal_window(t):
    """One signal in a window: blocks outside it and columns of other signals aren't decoded."""
    return waveform.changes_window(read(t, "changes"), 5 * DAY, 15 * DAY, 12).select("time", "text")


@query(f"with {_WAV} select signal_id, max(time) as since, arg_max(text, (time, seq)) as text from waves where time <= {9 * DAY} and signal_id % 3 <> 1 group by 1")
def recording_values(t):
    """Values at a time from the recording; changes of one tick keep their order."""
    return waveform.value_at_time(read(t, "changes").filter("text is not null"), 9 * DAY, ["text"])


@query(f"with {_CH} select distinct time from changes")
def recording_time_steps(t):
    return read(t, "time_steps").distinct()


@query(f"""with {_WAV} select cast(node_id as bigint) as node_id, 0 as parent_id, node_kind, name, cast(signal_id as bigint) as signal_id from (
      select 9 + 3 * r + k as node_id, 'variable' as node_kind, substr('brt', k + 1, 1) || signal_id as name, 3 * r + k as signal_id from users, range(3) x(k)
      union all select 1 + i, 'generator', 'g' || (1 + i), null from range(8) y(i)) union all select 0, null, 'scope', 'top', null""")
def recording_nodes(t):
    return read(t, "nodes").select("node_id", "parent_id", "node_kind", "name", "signal_id")


@query(f"""with {_WAV} select cast(3 * r + k as bigint) as signal_id, ['bits', 'real', 'bytes'][k + 1] as encoding, [8, 0, 0][k + 1] as width, [4, 2, 2][k + 1] as states from users, range(3) x(k)""")
def recording_signals(t):
    return read(t, "signals")


@query(f"""with {_INS}, {_REL}, {_WAV}, words as (select 'top' as w union select 'g' || (1 + i) from range(8) y(i) union select unnest(['REQUEST', 'EVENT', 'STAGE', 'LOG'])
      union select substr('brt', k + 1, 1) || signal_id from users, range(3) x(k) union select name from ins union select lane from ins union select coalesce(lower(trim(lane)), '') from emb where id % 4 = 0 and id in (select id from ins)
      union select kind from rel) select w as text from words where w <> '' union all select ''""")
def recording_strings(t):
    return read(t, "strings").select("text")


@query("select 23 as datatype_id, 3 as kind, 'words' as name, 5 as element")
def recording_datatypes(t):
    return read(t, "datatypes").select("datatype_id", "kind", "name", "element")


@query(f"""with {_OWN}, {_REL}, {_LOC} select 'TX_BLOCK' as kind, cast(ceil((select count(*) from own) / 65536.0) + ceil((select count(*) from rel) / 65536.0) as bigint) as sections
    union all select 'RECORD_BLOCK', cast(ceil(count(*) / 262144.0) as bigint) from loc
    union all select 'SIGNAL_BLOCK', cast(ceil(3 * count(*) / 4000000.0) as bigint) from events union all select unnest(['STRINGS', 'META', 'DATATYPES', 'HIERARCHY', 'BLACKOUT']), 1""")
def recording_sections(t):
    """Sections of each kind; their bytes must make up the file."""
    found = read(t, "sections").groupBy("kind").agg(F.count(F.lit(1)).alias("sections"), F.sum("bytes").alias("bytes"))
    return found.filter("bytes > 24 * sections").select("kind", "sections")


@query(f"""with {_OWN}, {_LOC}, {_CH} select 'TX_BLOCK' as kind, min(b) as first, max(e) as last from own union all select 'RECORD_BLOCK', min(b), max(e) from loc
    union all select 'SIGNAL_BLOCK', min(time), max(time) from changes""")
def recording_bounds(t):
    """The time bounds that the directory keeps of data sections."""
    data = read(t, "sections").filter("kind in ('TX_BLOCK', 'RECORD_BLOCK', 'SIGNAL_BLOCK') and aux1 > 0")
    return data.groupBy("kind").agg(F.min("aux0").alias("first"), F.max("aux1").alias("last"))


@query("select seq, time, active from (values " + ", ".join(f"({s}, {x}, {str(a).lower()})" for s, x, a in _BLACKOUTS) + ") v(seq, time, active)")
def recording_blackouts(t):
    return read(t, "blackouts")


@query("select 'complete' as completion, 0 as dropped_bytes, -9 as timescale, 'tickloom' as writer")
def recording_metadata(t):
    return read(t, "recording").select("completion", "dropped_bytes", "timescale", "writer")


def _cut(t: Trace, path: str) -> None:
    """The recording without its directory, cut off within its first block of located records."""
    source = made(t, "recording", lambda p: _write(t, p))
    whole = container.catalogue(source)
    at = next(s.offset for s in whole.sections if s.kind == container.RECORD_BLOCK) + 40
    with container.open_file(source) as a, open("/" + path.removeprefix("file:").lstrip("/"), "wb") as b:
        left = at
        while left:
            data = a.read(min(left, 1 << 20))
            b.write(data)
            left -= len(data)


@query(f"""with {_OWN}, {_REL}, {_CH} select 'unfinished' as completion, (select count(*) from own) as transactions, (select count(*) from rel) as relations, 0 as located, 3 * count(*) as changes from changes""")
def recording_prefix(t):
    """What a recording that was cut off still holds."""
    path = made(t, "cut", lambda p: _cut(t, p))
    n = lambda table: read(t, table, path).agg(F.count(F.lit(1)).alias("n")).scalar()
    return read(t, "recording", path).select("completion", *(n(x).alias(x) for x in ("transactions", "relations", "located", "changes")))


@query(f"with {_OWN} select 'incomplete' as completion, 40 as dropped_bytes, (select count(*) from own) as transactions")
def recording_recovered(t):
    """A sealed copy of the recording that was cut off: 40 bytes of its last section are dropped."""
    path = made(t, "recovered", lambda p: container.recover(made(t, "cut", lambda q: _cut(t, q)), p))
    n = read(t, "transactions", path).agg(F.count(F.lit(1)).alias("n")).scalar()
    return read(t, "recording", path).select("completion", "dropped_bytes", n.alias("transactions"))


def _drained(t: Trace, stream: DataFrame, name: str) -> DataFrame:
    """All that a stream gives until its source is used up, as a table."""
    folder = Scratch(t.spark, name).root
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query(f"with {_OWN} select id, b as \"begin\", e as \"end\" from own")
def recording_followed(t):
    """Transactions of the unfinished recording, followed as a stream."""
    container.register(t.spark)
    path = made(t, "cut", lambda p: _cut(t, p))
    rows = t.spark.readStream.format("tickloom").option("table", "transactions").load(path).select("id", "begin", "end")
    return _drained(t, rows, "followed")


@query(f"with {_OWN} select id, attrs[1] as serial, attrs[3] as bytes, len(attrs) as n from own where generator = 3 and attrs is not null and len(attrs) > 0")
def recording_payloads(t):
    """Payloads as a typed column, by the datatype that their generator declares."""
    path = made(t, "recording", lambda p: _write(t, p))
    typed = api.read_trace(t.spark, path).payloads(3).filter(F.size("payload") > 0)
    return typed.select("id", F.get("payload", F.lit(0)).alias("serial"), F.get("payload", F.lit(2)).alias("bytes"), F.size("payload").cast("bigint").alias("n"))


@query(f"""with {_OWN}, m as (select parent, count(*) as n from own where parent is not null and parent not in (select id from own) group by 1), {_EMB}, {_LOC}, {_EDG},
    ins as (select id from emb where id > owner and b >= 0 and (e is null or e >= b) and owner in (select id from own)),
    known as (select id from own union all select id from ins union all select id from loc)
    select 'records' as what, count(*) as n from known union all select 'relations', count(*) from edg
    union all select 'missing parents', (select coalesce(sum(n), 0) from m) + (select count(*) from loc where parent not in (select id from own))
    union all select 'missing sources', count(*) from edg where source is not null and source not in (select id from known)
    union all select 'missing destinations', count(*) from edg where destination is not null and destination not in (select id from known)
    union all select 'repeated ids', count(*) from (select id from known group by id having count(*) > 1)""")
def recording_validated(t):
    """Counts and missing references of the whole recording; located records are known ends of relations."""
    trace = api.read_trace(t.spark, made(t, "recording", lambda p: _write(t, p)))
    return trace.validate().filter("what in ('records', 'relations', 'repeated ids') or what like 'missing%'")


@query(f"""with {_LOC}, ids as (select id from loc group by id having count(*) > 1) select 'repeated id' as rule, count(*) as n, min(id) as lowest from ids""")
def recording_faults(t):
    """The only rule that the written recording breaks: ids of line items that repeat."""
    trace = api.read_trace(t.spark, made(t, "recording", lambda p: _write(t, p)))
    return trace.faults().groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lowest"))


@query(f"with {_CH} select 'top.' || p || signal_id as path from changes, (values ('b'), ('r'), ('t')) v(p) where time between {5 * DAY} and {5 * DAY + DAY // 4}  group by p, signal_id")
def recording_active(t):
    """Signals active in a window, by an index written beside the recording and loaded again."""
    trace = api.read_trace(t.spark, made(t, "recording", lambda p: _write(t, p)))
    index = made(t, "index", lambda p: trace.index(p))
    return trace.active(5 * DAY, 5 * DAY + DAY // 4, trace.load_index(index)[0]).select("path")


# --- value change dumps ------------------------------------------------------------------------


def _dump(t: Trace, path: str, gz: bool = False) -> None:
    waves = _waves(t).filter("signal_id % 3 < 2")
    signals = _nodes(t)[1].filter("encoding <> 'bytes'").withColumn("is_event", F.lit(False))
    nodes = _nodes(t)[0].filter("node_kind = 'scope' or name like 'b%' or name like 'r%'").withColumn("var_type", F.lit(None).cast("string"))
    steps = waves.select("time")
    marks = t.spark.createDataFrame([], "seq long, time long, active boolean")
    vcd.write_vcd(vcd.Recording(vcd.Header(-6, None, None, [], {}), nodes.filter("node_kind <> 'generator'"), signals, waves, steps, marks), path)
    if gz:
        t.spark.read.text(path).coalesce(1).write.option("compression", "gzip").text(path + ".gz")


_VCD = f"{_WAV}, shown as (select 2 * (signal_id // 3) + signal_id % 3 as signal_id, time, text, real from waves where signal_id % 3 < 2)"


@query(f"with {_VCD} select signal_id, time, text, round(real, 6) as real from shown")
def vcd_changes(t):
    """Changes written as a value change dump and read again."""
    r = vcd.read_vcd(t.spark, made(t, "waves", lambda p: _dump(t, p)))
    return r.changes.select("signal_id", "time", "text", F.round("real", 6).alias("real"))


@query(f"with {_WAV} select 'top' as path, 'scope' as node_kind union all select 'top.' || substr('br', k + 1, 1) || signal_id, 'variable' from users, range(2) x(k)")
def vcd_hierarchy(t):
    return scopes.closed(vcd.read_vcd(t.spark, made(t, "waves", lambda p: _dump(t, p))).nodes).select("path", "node_kind")


@query(f"with {_CH} select distinct time from changes")
def vcd_time_steps(t):
    return vcd.read_vcd(t.spark, made(t, "waves", lambda p: _dump(t, p)), check=False).time_steps


@query(f"with {_VCD} select signal_id, count(*) as n, min(time) as first, max(time) as last, max(text) as highest from shown group by 1")
def vcd_compressed(t):
    """The same dump, compressed."""
    made(t, "waves_gz", lambda p: _dump(t, p, True))
    r = vcd.read_vcd(t.spark, made(t, "waves_gz", None) + ".gz", check=False)
    return r.changes.groupBy("signal_id").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first"), F.max("time").alias("last"), F.max("text").alias("highest"))


# --- pipeline logs -----------------------------------------------------------------------------


def _pipeline(t: Trace, path: str) -> None:
    """Orders as instructions: stage wait from the order's day to half way, stage ship to the end; open orders don't retire."""
    o = t.orders.filter("end is not null").withColumn("half", F.expr("begin + (end - begin) div 2"))
    i = F.col("id").cast("string")
    line = lambda time, k, *parts: F.struct(F.col(time).alias("time"), F.lit(k).alias("k"), F.concat_ws("\t", *parts).alias("value"))
    commands = F.array(
        line("begin", 0, F.lit("I"), i, i, F.col("generator").cast("string")), line("begin", 1, F.lit("L"), i, F.lit("0"), F.concat(F.lit("order "), i)), line("begin", 2, F.lit("S"), i, F.lit("0"), F.lit("wait")),
        line("half", 3, F.lit("S"), i, F.lit("0"), F.lit("ship")), line("end", 4, F.lit("E"), i, F.lit("0"), F.lit("ship")),
        F.when(F.col("status") != 4, line("end", 5, F.lit("R"), i, i, F.when(F.col("status") == 1, "0").otherwise("1"))),
    )
    rows = o.withColumn("c", F.explode(F.array_compact(commands))).select("id", "c.*")
    times = Scratch(t.spark, "cycles").write(rows.select("time").distinct().withColumn("one", F.lit(1)))
    steps = neighbours(times, ["one"], "time", [], ["time"]).select("time", F.lit(-1).alias("k"), F.lit(0).cast("bigint").alias("id"), F.concat(F.lit("C\t"), (F.col("time") - F.coalesce("prev.time", F.lit(0))).cast("string")).alias("value"))
    head = t.spark.createDataFrame([(-2, -2, 0, "Kanata\t0004"), (-1, -1, 0, "C=\t0")], "time long, k int, id long, value string")
    every = head.unionByName(steps).unionByName(rows.select("time", "k", "id", "value"))
    every.orderBy("time", "id", "k").select("value").coalesce(1).write.text(path)


_PIPE = f"{_ORD}, ok as (select * from ord where e is not null)"


@query(f"""with {_PIPE} select id, 'thread' || generator as generator, b as "begin", case when status = 4 then (select max(e) from ok) else e end as "end",
    case status when 4 then 'open' when 1 then 'unset' else 'aborted' end as status, 'order ' || id as label from ok""")
def kanata_instructions(t):
    """Orders written as a pipeline log and read again."""
    p = kanata.read_kanata(t.spark, made(t, "pipeline", lambda q: _pipeline(t, q)))
    return p.instructions.select("id", "generator", "begin", "end", "status", "label")


@query(f"""with {_PIPE} select id, 'wait' as name, b as "begin", b + (e - b) // 2 as "end" from ok union all select id, 'ship', b + (e - b) // 2, e from ok""")
def kanata_stages(t):
    p = kanata.read_kanata(t.spark, made(t, "pipeline", lambda q: _pipeline(t, q)))
    return p.stages.select("id", "name", "begin", "end")


@query(f"""with {_PIPE} select 'cpu.cycle' as clock, 0 as "begin", max(e) as "end", 1 as period, 0 as start_cycle from ok""")
def kanata_clock(t):
    return kanata.read_kanata(t.spark, made(t, "pipeline", lambda q: _pipeline(t, q))).clocks.select("clock", "begin", "end", "period", "start_cycle")


# --- operation logs ----------------------------------------------------------------------------


def _ops(t: Trace) -> DataFrame:
    """Transactions as operations of four producers; every fifth payload is deferred, half of those come."""
    tx = t.transactions.filter(f"begin is not null and end <> {OPEN_END}").select("id", "parent", "begin", "end", "status")
    names = [c.split() for c in oplog.OP_SCHEMA.split(", ")]

    def op(name: str, seq: int, stamp: str, **more) -> F.Column:
        own = {"producer": F.concat(F.lit("p"), (F.col("id") % 4).cast("string")), "stamp": F.col(stamp), "seq": F.col("id") * 4 + seq, "op": F.lit(name), "id": F.col("id"), "time": F.col(stamp), **more}
        return F.struct(*(own.get(n, F.lit(None)).cast(k).alias(n) for n, k in names))

    later = F.greatest("begin", "end")
    deferred = F.col("id") % 5 == 0
    rows = tx.withColumn("later", later).withColumn("o", F.explode(F.array_compact(F.array(
        op("begin", 0, "begin", parent=F.col("parent"), value=F.when(~deferred, F.concat(F.lit("v"), F.col("id").cast("string")))),
        F.when(deferred & (F.col("id") % 2 == 0), op("payload", 1, "begin", value=F.lit("late"))),
        op("span_kind", 2, "begin", status=F.col("id") % 6),
        F.when(F.col("status") != 4, op("end", 3, "later", time=F.col("end"), status=F.col("status"))),
    ))))
    return rows.select("o.*")


_LIFE = f"""{_TX}, log as (select id, parent, b, e, status, case when id % 5 <> 0 then 'v' || id when id % 2 = 0 then 'late' end as payload from tx where b is not null and e <> {OPEN_END})"""


@query(f"""with {_LIFE} select id, parent, b as "begin", case when status = 4 or status is null then greatest(b, 100000000) else greatest(e, b) end as "end",
    case when status is null then 4 else status end as status, id % 6 as span_kind, payload from log where payload is not null""")
def oplog_lifetimes(t):
    """Owners of an operation log; those that are still live are open to the log's close."""
    return oplog.lifetimes(_ops(t), 100_000_000).select("id", "parent", "begin", "end", "status", "span_kind", "payload")


@query(f"""with {_LIFE} select id, parent, b as "begin", greatest(e, b) as "end", status, payload from log where payload is not null and status <> 4""")
def oplog_stream_lifetimes(t):
    """The same log as a stream of two batches of files: what begins in the first ends in the second."""
    files = int(t.spark.conf.get("spark.sql.shuffle.partitions"))

    def write(p):
        ops = Scratch(t.spark, "operations").write(_ops(t))
        for c in ("op <> 'end'", "op = 'end'"):
            ops.filter(c).repartition(files).write.mode("append").parquet(p)

    folder = made(t, "oplog", write)
    stream = t.spark.readStream.schema(oplog.OP_SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)
    return _drained(t, oplog.stream_lifetimes(stream), "lifetimes").filter("fault is null").select("id", "parent", "begin", "end", "status", "payload")


_OPS = f"""{_LIFE}, ops as (select 'p' || id % 4 as producer, b as stamp, id * 4 as seq, 'begin' as op, id from log union all select 'p' || id % 4, b, id * 4 + 1, 'payload', id from log where id % 10 = 0
    union all select 'p' || id % 4, b, id * 4 + 2, 'span_kind', id from log union all select 'p' || id % 4, greatest(b, e), id * 4 + 3, 'end', id from log where status <> 4)"""


@query(f"with {_OPS} select seq, op from (select *, lag(stamp) over (partition by producer order by seq) as before from ops) where before > stamp")
def oplog_backward(t):
    """Operations whose producer time goes back."""
    return oplog.backward(_ops(t)).select("seq", "op")


@query(f"with {_OPS}, reached as (select max(stamp) as s from ops group by producer) select min(s) as frontier, count(*) as active from reached")
def oplog_frontier(t):
    ops = _ops(t)
    return oplog.frontier(ops, ops.select("producer").distinct())


@query(f"with {_OPS}, reached as (select min(s) as f from (select max(stamp) as s from ops group by producer)) select op, count(*) as n from ops, reached where stamp < f group by op")
def oplog_released(t):
    """Operations that may be applied, before the least time that all producers have reached."""
    ops = _ops(t)
    return oplog.released(ops, ops.select("producer").distinct()).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_OPS} select stamp, seq, producer from ops order by stamp, seq, producer limit 200")
def oplog_merge_order(t):
    """The first operations in the order of application."""
    return oplog.merge_order(_ops(t)).limit(200).select("stamp", "seq", "producer")


@query(f"""with {_OPS}, touched as (select seq % 97 as id, stamp // 1000 as stamp, producer from ops) select id, stamp, count(distinct producer) as producers from touched group by 1, 2 having count(distinct producer) > 1""")
def oplog_writer_conflicts(t):
    """Resources that several producers touch at one time."""
    return oplog.writer_conflicts(_ops(t).withColumn("id", F.col("seq") % 97).withColumn("stamp", F.expr("stamp div 1000")))


@query(f"""with {_OPS}, moved as (select *, case when op = 'span_kind' then stamp + 5000 else stamp end as s from ops), ends as (select id, s as e, seq as eseq from moved where op = 'end')
    select m.seq from moved m join ends using (id) where m.op <> 'begin' and (s > e or s = e and seq > eseq)""")
def oplog_dead_owners(t):
    """Operations on owners that have ended; span kinds are moved to later."""
    ops = _ops(t).withColumn("stamp", F.when(F.col("op") == "span_kind", F.col("stamp") + 5000).otherwise(F.col("stamp")))
    return oplog.dead_owners(ops).select("seq")


@query(f"with {_CH} select seq, signal_id from changes where time // {DAY} not in (select time // {DAY} from changes where seq % 500 = 0)")
def oplog_batches(t):
    """Batches, one a day, of which only those without an invalid emission count."""
    batches = t.changes.select("seq", "signal_id", F.expr(f"time div {DAY}").alias("batch"), (F.col("seq") % 500 != 0).alias("ok"))
    return oplog.all_or_nothing(batches).select("seq", "signal_id")


@query(f"""with {_EMB}, {_TX} select m.id, m.owner, m.name, m.b as "begin", greatest(coalesce(m.e, t.e), m.b) as "end" from emb m left join tx t on t.id = m.owner where m.b is not null""")
def oplog_stage_lifetimes(t):
    """Stages ended on their own, else with their owner."""
    s = t.embedded.filter("begin is not null")
    start = s.select(F.lit("begin_stage").alias("op"), "id", F.col("owner").alias("parent"), F.col("begin").alias("time"), "name", F.col("begin").alias("stamp"), F.lit(0).alias("seq"))
    end = s.filter("end is not null").select(F.lit("end_stage").alias("op"), "id", F.col("owner").alias("parent"), F.col("end").alias("time"), "name", F.col("end").alias("stamp"), F.lit(1).alias("seq"))
    return oplog.stage_lifetimes(start.unionByName(end), t.transactions).select("id", "owner", "name", "begin", "end")


@query(f"""with {_CH}, m as (select signal_id as id, seq, time, text, lead(time) over w as nt, lead(text) over w as nx from changes where text in ('error', 'purchase') window w as (partition by signal_id order by time, seq))
    select id as clock, seq, time as first, 60 as period, case when nx = 'purchase' then nt end as stop from m where text = 'error'""")
def oplog_clock_runs(t):
    """Clock runs from operations: errors start a run, purchases stop one."""
    op = F.when(F.col("text") == "error", "clock_run").when(F.col("text") == "purchase", "clock_stop")
    ops = t.changes.select(op.alias("op"), F.col("signal_id").alias("id"), F.col("time").alias("stamp"), "seq", "time", F.lit("60").alias("value")).filter("op is not null")
    return oplog.clock_operations(ops)


# --- trackers ----------------------------------------------------------------------------------


def _tracked(t: Trace) -> DataFrame:
    names = [c.split() for c in tracker.OP_SCHEMA.split(", ")]
    tx = t.transactions.filter("begin is not null")
    own = {"tracker": F.concat(F.lit("t"), (F.col("id") % 8).cast("string")), "seq": F.col("id"), "op": F.lit("open"), "space": F.lit("slot"), "key": F.expr("id div 8 % 40"), "id": F.col("id"),
           "name": F.lit("run"), "time": F.col("begin")}
    return tx.select(*(own.get(n, F.lit(None)).cast(k).alias(n) for n, k in names))


_SLOTS = f"""{_TX}, held as (select id, b, id % 8 as tr, id // 8 % 40 as key, lead(b) over (partition by id % 8, id // 8 % 40 order by id) as nb from tx where b is not null)"""


@query(f"""with {_SLOTS} select id, b as "begin", greatest(nb, b) as "end", 3 as status from held where nb is not null""")
def tracker_evictions(t):
    """Items opened on a key that still names one abort that one."""
    return tracker.process(_tracked(t)).filter("what = 'owner'").select("id", "begin", "end", "status")


@query(f"""with {_SLOTS} select id, 'run' as name, b as "begin", greatest(nb, b) as "end" from held where nb is not null""")
def tracker_stages(t):
    """The stages of those items end with them."""
    return tracker.process(_tracked(t)).filter("what = 'stage'").select("id", "name", "begin", "end")


@query(f"""with {_SLOTS} select 't' || tr as tracker, count(*) as n from held where nb is not null group by 1""")
def tracker_diagnostics(t):
    return tracker.process(_tracked(t)).filter("what = 'diagnostic'").groupBy("tracker").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_SLOTS} select id, b as "begin", greatest(nb, b) as "end" from held where nb is not null""")
def tracker_stream(t):
    """The same trackers over a stream, with state between its two micro-batches."""
    folder = made(t, "tracked", lambda p: [_tracked(t).filter(c).coalesce(1).write.mode("append").parquet(p) for c in ("seq <= 1008000", "seq > 1008000")])
    stream = t.spark.readStream.schema(tracker.OP_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return _drained(t, tracker.stream(stream), "tracked_rows").filter("what = 'owner'").select("id", "begin", "end")


# --- rules -------------------------------------------------------------------------------------


def _attributes(t: Trace) -> DataFrame:
    key = F.when(F.col("id") % 3 == 0, "vtr.label").when(F.col("id") % 3 == 1, "opcode").otherwise("note")
    kind = F.when(F.col("id") % 7 == 0, "u32").when(F.col("id") % 7 == 1, None).when(F.col("id") % 2 == 0, "text").otherwise("str")
    return t.transactions.select("id", "generator", key.alias("key"), kind.alias("type"))


@query(f"with {_TX} select id from tx where id % 3 = 0 and id % 7 in (0, 1)")
def label_type_check(t):
    """Labels that are neither text nor interned text."""
    return validation.label_types(_attributes(t)).select("id")


@query(f"with {_TX} select id from tx where id % 3 = 1 and generator in (select generator from trace_generators where gen_kind = 'COMMAND')")
def attribute_field_check(t):
    """Attributes named as a field of their generator's payload."""
    fields = t.generators.filter("gen_kind = 'COMMAND'").select("generator", F.lit("opcode").alias("field"))
    return validation.field_clashes(_attributes(t), fields).select("id")


@query("select cast(generator as bigint) as datatype_id from trace_generators where generator % 4 = 0 and generator % 3 = 0")
def payload_label_check(t):
    """Structures whose field for the label has another type than text."""
    fields = F.array(F.struct(F.lit("opcode").alias("name"), F.lit(9).alias("type")), F.struct(F.when(F.col("generator") % 4 == 0, "vtr.label").otherwise("note").alias("name"), F.when(F.col("generator") % 3 == 0, 9).otherwise(13).alias("type")))
    types = t.generators.select(F.col("generator").alias("datatype_id"), F.col("gen_name").alias("name"), fields.alias("fields"))
    return validation.payload_labels(types).select("datatype_id")


@query(f"""with {_CH}, p as (select signal_id, k * {6 * DAY} as start_time from (select distinct signal_id from changes), range(5) r(k)),
    h as (select p.signal_id, start_time, c.text from p asof left join changes c on p.signal_id = c.signal_id and p.start_time > c.time)
    select signal_id, start_time from h where signal_id % 9 = 0 and text is distinct from 'broken'""")
def frame_check(t):
    """Stored frames that differ from the value held then; those of every ninth signal are broken."""
    starts = t.spark.range(5).select((F.col("id") * 6 * DAY).alias("start_time"))
    held = waveform.frames(t.changes, starts, "text").withColumnRenamed("text", "value")
    stored = held.withColumn("value", F.when(F.col("signal_id") % 9 == 0, "broken").otherwise(F.col("value")))
    return validation.frame_faults(stored, held).select("signal_id", "start_time")


@query(f"""with {_CH} select seq from changes where signal_id % 2 = 0 and seq % 3 = 0 and bits like '%1%' or seq % 11 = 0""")
def alphabet_check(t):
    """Samples of another width or alphabet than their signal's: even signals have two states."""
    text = F.when(F.col("seq") % 11 == 0, F.substring("bits", 1, 7)).when(F.col("seq") % 3 == 0, F.translate("bits", "1", "x")).otherwise(F.col("bits"))
    kinds = t.changes.select("signal_id").distinct().select("signal_id", F.lit(8).alias("width"), F.when(F.col("signal_id") % 2 == 0, 2).otherwise(4).alias("states"))
    return validation.alphabet_faults(t.changes.select("signal_id", "seq", text.alias("text")), kinds).select("seq")


@query("""with d as (select record_id as id, count(*) as n from discarded_records where record_id is not null group by 1),
    e as (select id, id % 5 + 1 as reason, id % 3 = 0 as wrong from d) select id from e where id > (select min(id) from e) or wrong""")
def run_ending_check(t):
    """Run endings beyond the first, or with another text than their reason's."""
    d = t.raw("discarded_records").filter("record_id is not null").groupBy(F.col("record_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    r = (F.col("id") % 5 + 1).cast("int")
    use = lambda k, v: F.when(r == k, v).otherwise(0)
    e = d.withColumn("reason", r).withColumn("signal", F.when(r.isin(1, 3), 11).otherwise(0)).withColumn("code", use(3, 1)).withColumn("address", use(3, F.col("id")).cast("bigint"))
    e = e.withColumn("thread", use(3, 7).cast("bigint")).withColumn("sealed", r == 3).withColumn("status", use(2, 4)).withColumn("dropped", use(4, F.col("id")).cast("bigint"))
    e = e.withColumn("message", F.when(F.col("id") % 3 == 0, "ended").otherwise(logs.ending_text()))
    return logs.ending_faults(e).select("id")


@query("""with d as (select distinct record_id as id from discarded_records where record_id is not null)
    select id, case id % 5 when 0 then 'stopped by SIGSEGV' when 1 then 'exited with status 4' when 2 then 'crashed by SIGSEGV (address 0x' || lower(to_hex(id)) || ', thread 7)'
      when 3 then 'recovered by scanning (' || id || ' bytes dropped)' else 'sealed after a panic in the writer' end as message from d""")
def run_ending_text(t):
    """The sentence of each kind of ending."""
    d = t.raw("discarded_records").filter("record_id is not null").select(F.col("record_id").alias("id")).distinct()
    e = d.withColumn("reason", F.col("id") % 5 + 1).withColumn("signal", F.lit(11)).withColumn("address", F.col("id")).withColumn("thread", F.lit(7)).withColumn("sealed", F.lit(False))
    return e.withColumn("status", F.lit(4)).withColumn("dropped", F.col("id")).select("id", logs.ending_text().alias("message"))


@query("""with m as (select row_number() over (order by record_id, discarded_at, reason) as seq, record_id // 100 % 50 as time, record_id % 2 = 0 as active from discarded_records where record_id is not null),
    x as (select *, lag(time) over (order by seq) as pt, lag(active) over (order by seq) as pa from m) select seq from x where pt > time or pa = active""")
def blackout_check(t):
    """Blackout markers that go back in time or repeat the state before."""
    d = t.raw("discarded_records").filter("record_id is not null").withColumn("one", F.lit(1))
    marks = running(d, ["one"], "record_id", ["discarded_at", "reason"], F.lit(1), "seq").withColumn("seq", F.col("seq") + 1)
    return waveform.blackout_faults(marks.select("seq", F.expr("record_id div 100 % 50").alias("time"), (F.col("record_id") % 2 == 0).alias("active"))).select("seq")


# --- groups, texts and codes -------------------------------------------------------------------


@query("""select a.generator as from_id, b.generator as to_id from trace_generators a join trace_generators b on a.scope = b.scope where a.gen_kind = 'REQUEST' and b.gen_kind = 'PACKET'""")
def related_groups(t):
    """All requests of a scope with all packets of it, as related key groups mean."""
    g = t.generators.select(F.col("scope").alias("key"), F.col("generator").cast("int").alias("id"), "gen_kind")
    return joins.expand_pairs(g.filter("gen_kind = 'REQUEST'").drop("gen_kind"), g.filter("gen_kind = 'PACKET'").drop("gen_kind"), "key")


@query(f"""with {_TX} select id, '{{serial: ' || attrs[1] || ', rest: [' || array_to_string(attrs[2:], ', ') || '], kind: "' || id % 3 || '\\"x"}}' as shown from tx where len(attrs) > 1""")
def payload_text(t):
    """Payloads in their debug form."""
    rows = t.transactions.filter(F.size("attrs") > 1)
    value = F.to_json(F.struct(F.get("attrs", F.lit(0)).alias("serial"), F.slice("attrs", F.lit(2), F.size("attrs")).alias("rest"), F.concat((F.col("id") % 3).cast("string"), F.lit('"x')).alias("kind")))
    return rows.select("id", logs.value_text(value).alias("shown"))


_ARG = "select event_id as id, cast(json_extract_string(props, '$.k') as bigint) * 1234567 as arg from events where event_type in ('error', 'purchase')"


@query(f"with l as ({_ARG}) select id, '<' || format('{{:t.}}', arg) || '>' as message from l")
def log_render_locale(t):
    """Digits grouped by a locale's punctuation."""
    sites = t.callsites.withColumn("format", F.lit("<{:L}>"))
    return logs.render(t.logs.withColumn("arg", F.col("arg") * 1234567), sites, ["arg"], locale=Locale((3,), ".", ",")).select("id", "message")


@query("""select n_nationkey as id, repeat('*', 18 - 6 - length(n_name)) || '日本🍇' || n_name || '|' || '日' as message from nation""")
def log_render_wide(t):
    """Padding and precision by columns: wide characters take two."""
    rows = t.raw("nation").select(F.col("n_nationkey").alias("id"), F.lit(1).alias("datatype_id"), F.concat(F.lit("日本🍇"), "n_name").alias("word"), F.lit("日本").alias("cut"))
    sites = t.spark.createDataFrame([(1, "{:*>18}|{:.3}", 1)], "datatype_id int, format string, severity int")
    return logs.render(rows, sites, ["word", "cut"]).select("id", "message")


@query(f"""with {_EMB} select id, greatest(b, e) as clamped from emb where b is not null and e is not null""")
def stage_end_clamped(t):
    """Ends never before begins."""
    return t.embedded.filter("begin is not null and end is not null").select("id", bits.stage_end("begin", "end").alias("clamped"))


@query("""select n_nationkey as id, case when n_nationkey % 2 = 0 then n_name else '[non-UTF-8 bytes] ff' || lower(hex(n_name)) end as shown from nation""")
def log_bytes_shown(t):
    """Messages that are no UTF-8 are shown as hex."""
    raw = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name").cast("binary")).otherwise(F.concat(F.unhex(F.lit("ff")), F.col("n_name").cast("binary")))
    return t.raw("nation").select(F.col("n_nationkey").alias("id"), bits.log_bytes_text(raw).alias("shown"))


@query("""select l_orderkey as id, l_linenumber as line, case when v < 1024 then v || ' B' when v < 1048576 then printf('%.1f KiB', cast(v as double) / 1024) when v < 1073741824 then printf('%.1f MiB', cast(v as double) / 1048576)
    else printf('%.1f GiB', cast(v as double) / 1073741824) end as size from (select l_orderkey, l_linenumber, l_orderkey * l_orderkey * l_linenumber // 3 as v from lineitem)""")
def byte_sizes(t):
    v = F.expr("l_orderkey * l_orderkey * l_linenumber div 3")
    return t.raw("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), bits.bytes_text(v).alias("size"))


@query("""select scope_type, case """ + " ".join(f"when scope_type = {i} then '{n}'" for i, n in [*enumerate(model.SCOPE_TYPE), *model.SCOPE_TYPE_MORE.items()]) + """ when scope_type is not null then 'other' end as name, count(*) as n from census_scopes group by 1""")
def scope_type_names(t):
    return t.raw("census_scopes").groupBy("scope_type").agg(F.count(F.lit(1)).alias("n")).withColumn("name", model.code_name("scope_type", model.SCOPE_TYPE, model.SCOPE_TYPE_MORE))


@query(f"with {_CH} select seq, case when length(ltrim(bits, '0')) = 0 then '0' else ltrim(bits, '0') end as shortest, cast(real as decimal(18, 2)) as real from changes")
def signal_text(t):
    """Values as text: bits without leading zeros, reals that read back the same."""
    short = F.when(F.ltrim("bits", F.lit("0")) == "", "0").otherwise(F.ltrim("bits", F.lit("0")))
    return t.changes.select("seq", short.alias("shortest"), F.col("real").cast("string").cast("double").cast("decimal(18,2)").alias("real"))


@query("""select p_partkey as id, p_partkey * 100 + (p_partkey % 7) * p_size as edge from part""")
def clock_edges(t):
    """The tick of an edge of a clock run."""
    p = t.raw("part")
    return p.select(F.col("p_partkey").alias("id"), bits.clock_edge(F.col("p_partkey") * 100, F.col("p_size").cast("bigint"), F.col("p_partkey") % 7).alias("edge"))
