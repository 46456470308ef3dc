"""Opening, asking and saving traces: one facade over the operators.

    trace = read_trace(spark, "run.vcd")          # or .kanata, .log, .gz of either, a recording, a saved directory
    trace.value("top.clk", 500)
    trace.save("/data/run")
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import model
from tickloom.operators import activity, clocks, logs, relations, scopes, transactions, validation, waveform
from tickloom.session import Scratch, ship
from tickloom.sources import container, kanata, vcd

#: Rows that listings give by default.
LISTING = 100


def format_of(path: str) -> str:
    """vcd, kanata, fst or recording, by the name without .gz; a directory is a saved trace."""
    if os.path.isdir(path):
        return "saved"
    name = os.path.basename(path).lower().removesuffix(".gz")
    for kind, ends in (("vcd", (".vcd",)), ("kanata", (".kanata", ".log")), ("fst", (".fst",))):
        if name.endswith(ends):
            return kind
    return "recording"


class Trace:
    """The canonical tables of one trace; missing tables are empty."""

    #: Whether each reading of a table decodes it again.
    decoded = False

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], fingerprint: str | None = None):
        self.spark, self.tables, self.fingerprint = spark, tables, fingerprint

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            return self.spark.createDataFrame([], EMPTY[name])
        return self.tables[name]

    # -- hierarchy --

    @cached_property
    def hierarchy(self) -> DataFrame:
        return scopes.closed(self.table("nodes"))

    @cached_property
    def variables(self) -> DataFrame:
        """(path, node_id, scope, signal_id) of the variables; aliases share a signal."""
        named = self.hierarchy.filter("node_kind = 'variable'").select("node_id", "path", F.col("parent_id").alias("scope"))
        return named.join(self.table("nodes").select("node_id", "signal_id"), "node_id")

    def find(self, path: str, kind: str | None = None) -> DataFrame:
        return scopes.find_path(self.table("nodes"), path, kind)

    def find_signal(self, path: str) -> DataFrame:
        found = self.find(path, "variable")
        return found.join(self.table("nodes").select("node_id", "signal_id"), "node_id")

    def find_generator(self, path: str) -> DataFrame:
        return self.find(path, "generator")

    def listing(self, depth: int | None = None, variables: bool = True) -> DataFrame:
        return scopes.listing(self.hierarchy, depth, variables)

    def scope_sizes(self, subset: DataFrame | None = None) -> DataFrame:
        return scopes.scope_sizes(self.hierarchy, self.variables.select("scope", "signal_id"), subset)

    def within(self, scope: str | None) -> DataFrame:
        """Node ids within a scope given by its path; None is everything."""
        if scope is None:
            return self.hierarchy.select("node_id")
        top = self.find(scope, "scope").select(F.col("node_id").alias("top"))
        return self.hierarchy.select("node_id", F.explode("ancestors").alias("top")).join(top, "top", "left_semi").select("node_id")

    # -- waveforms --

    def changes(self, path: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
        out = waveform.changes_window(self.table("changes"), first, last)
        return out if path is None else out.join(self.find_signal(path), "signal_id", "left_semi")

    def ordered_changes(self, n: int | None = None) -> DataFrame:
        return waveform.ordered_changes(self.table("changes"), n)

    def value(self, path: str, time: int) -> DataFrame:
        """The value of a signal at a time, else its default."""
        probe = self.find_signal(path).select("signal_id", F.lit(time).cast("bigint").alias("probe_time"))
        return self.values_at(probe)

    def values_at(self, probes: DataFrame) -> DataFrame:
        """Many probes (signal_id, probe_time) as one job; before the first change the default."""
        from tickloom.functions.bits import default_value

        kinds = self.table("signals").select("signal_id", "encoding", "width", *(["states"] if "states" in self.table("signals").columns else [F.lit(4).alias("states")]))
        found = waveform.value_at(self.table("changes"), probes.select("signal_id", "probe_time"), ["text", "real"]).join(kinds.dropDuplicates(["signal_id"]), "signal_id", "left")
        shown = F.coalesce("text", F.when(F.col("encoding") == "real", F.coalesce("real", F.lit(0.0)).cast("string")), default_value("encoding", "width", "states"))
        return found.select("signal_id", "probe_time", "since", shown.alias("value"))

    def waveform_range(self) -> DataFrame:
        return waveform.time_range([(self.table("time_steps"), "time", "time"), (self.table("changes"), "time", "time")])

    def time_range(self) -> DataFrame:
        parts = [("changes", "time", "time"), ("time_steps", "time", "time"), ("transactions", "begin", "end"), ("located", "begin", "end"), ("embedded", "begin", "end")]
        return waveform.time_range([(self.table(t), b, e) for t, b, e in parts])

    # -- records --

    def transactions(self, first: int | None = None, last: int | None = None, scope: str | None = None, **query) -> DataFrame:
        out = transactions.query_transactions(self.table("transactions"), first, last, embedded=self.table("embedded"), **query)
        return out if scope is None else out.join(self.within(scope).select(F.col("node_id").alias("generator")), "generator", "left_semi")

    def records(self, first: int | None = None, last: int | None = None, **query) -> DataFrame:
        return transactions.query_located(self.table("located"), first, last, **query)

    def lookup(self, ids: DataFrame) -> DataFrame:
        clock = self.clock_stretches().withColumnRenamed("clock", "clock")
        owners = self.table("transactions")
        owners = owners.filter("kind <> 'clock'") if "kind" in owners.columns else owners
        every = transactions.records_all(owners, self.table("embedded"), self.table("located"), clock)
        return transactions.lookup(every, ids)

    def expand(self, id: int) -> DataFrame:
        """Located events and stages of an ordinary transaction; of other ids it is an error."""
        own = self.table("transactions").filter(F.col("id") == id)
        own = own.filter("kind <> 'clock'") if "kind" in own.columns else own
        if not own.limit(1).count():
            raise ValueError(f"{id} is no transaction that owns records")
        return transactions.expand(own, self.table("located")).orderBy("id")

    def missing_blocks(self, id: int) -> DataFrame:
        """(block) of the child blocks that a transaction lists and the recording doesn't hold, as one that was
        cut off; its expansion is complete without any."""
        own = self.table("transactions").filter(F.col("id") == id)
        if "child_blocks" not in own.columns:
            return own.select(F.col("id").alias("block")).limit(0)
        have = self.table("transactions").select("block").unionByName(self.table("located").select("block")).distinct()
        return own.select(F.explode("child_blocks").alias("block")).join(have, "block", "left_anti")

    def payloads(self, generator: int) -> DataFrame:
        """The transactions of a generator with `payload` as a typed column, by its declared datatype."""
        kind = self.table("nodes").filter(F.col("node_id") == generator).select("payload_type").first()
        types = {r["datatype_id"]: (r["kind"], r["fields"], r["element"]) for r in self.table("datatypes").collect()}  # declarations, a few rows
        ddl = container.payload_ddl(types, kind["payload_type"] if kind else 0)
        return self.table("transactions").filter(F.col("generator") == generator).withColumn("payload", F.from_json("payload", ddl))

    def children(self, id: int) -> DataFrame:
        return transactions.children_of(self.table("transactions"), self.spark.createDataFrame([(id,)], "id long"))

    def relations(self, id: int, incoming: bool = False) -> DataFrame:
        r = self.table("relations")
        if id == 0:
            return r.filter(F.col("destination" if incoming else "source").isNull())
        return r.filter(F.col("destination" if incoming else "source") == id)

    def scan_relations(self) -> DataFrame:
        return self.table("relations")

    def sites(self) -> DataFrame:
        """The callsites: those of the table, or of the datatypes that say they are."""
        if "callsites" in self.tables or "attributes" not in self.table("datatypes").columns:
            return self.table("callsites")
        plain = F.transform("attributes", lambda a: F.struct(a["key"].alias("key"), F.regexp_replace(a["value"], '^"|"$', "").alias("value")))
        return logs.callsites_of(self.table("datatypes").withColumn("attributes", plain))

    def logs(self, severity: int = 0, first: int | None = None, last: int | None = None, scope: str | None = None, args: list[str] | None = None, locale=None) -> DataFrame:
        """Log records of a severity, window and scope; with `args` (columns) their rendered `message`."""
        out = self.table("logs") if "logs" in self.tables else self.table("located").filter("kind = 'log'")
        if first is not None or last is not None:
            out = out.filter(waveform.within("begin", first, last))
        if scope is not None:
            out = out.join(self.within(scope).select(F.col("node_id").alias("generator")), "generator", "left_semi")
        if args is None:
            return logs.at_least(out, self.sites(), severity)
        return logs.render(out, self.sites().filter(F.col("severity") >= severity), args, locale=locale)

    # -- clocks --

    def clock_stretches(self) -> DataFrame:
        if "clocks" in self.tables or "kind" not in self.table("transactions").columns:
            return self.table("clocks")
        period = F.expr("try_cast(get(filter(attributes, a -> a.key = 'vtr.period'), 0).value as bigint)")
        return self.table("transactions").filter("kind = 'clock'").select(F.col("generator").alias("clock"), "id", "begin", "end", period.alias("period"))

    def cycle_at(self, probes: DataFrame) -> DataFrame:
        return clocks.cycle_at(self.clock_stretches(), probes)

    # -- activity --

    def signal_activity(self) -> DataFrame:
        return activity.signal_activity(self.table("changes"))

    def generator_activity(self) -> DataFrame:
        return activity.generator_activity(self.table("transactions"), self.table("located"))

    def active(self, first: int, last: int, stretches: DataFrame | None = None) -> DataFrame:
        """Signals that change in a window, each once under its first name."""
        if stretches is None:
            hit = activity.signals_active(self.table("changes"), first, last)
        else:
            hit = activity.active_in(stretches, "signal_id", "first", "last", first, last)
        return activity.first_names(hit, self.variables)

    def index(self, path: str) -> None:
        """Write the activity of signals and generators beside the trace's fingerprint."""
        mark = self.spark.createDataFrame([(self.fingerprint,)], "fingerprint string")
        self.signal_activity().write.mode("overwrite").parquet(f"{path}/signals")
        self.generator_activity().write.mode("overwrite").parquet(f"{path}/generators")
        mark.write.mode("overwrite").parquet(f"{path}/mark")  # last: an index without it is none

    def load_index(self, path: str) -> tuple[DataFrame, DataFrame]:
        """The index of this trace; that of another one, or an unfinished one, is an error."""
        try:
            found = self.spark.read.parquet(f"{path}/mark").first()
        except Exception as e:
            raise ValueError("no finished index") from e
        if found is None or found["fingerprint"] != self.fingerprint:
            raise ValueError("index of another trace")
        return self.spark.read.parquet(f"{path}/signals"), self.spark.read.parquet(f"{path}/generators")

    # -- whole traces --

    def info(self) -> DataFrame:
        """(what, n): nodes by kind, and rows of the data tables."""
        kinds = scopes.kind_counts(self.table("nodes")).select(F.concat(F.lit("node "), "node_kind").alias("what"), F.col("nodes").alias("n"))
        out = kinds
        for t in ("changes", "transactions", "embedded", "located", "relations"):
            out = out.unionByName(self.table(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("what"), "n"))
        return out

    def validate(self, complete: bool = False) -> DataFrame:
        """(what, n): counts, missing references, and broken rules by name. For a complete recording
        missing references are an error; broken rules always are rows."""
        counted = validation.counts(self.table("transactions"), self.table("embedded").select("id", "owner"), self.table("relations"), self.table("located"))
        validation.missing_as_errors(counted, complete)
        return counted.unionByName(self.faults().groupBy(F.col("rule").alias("what")).agg(F.count(F.lit(1)).alias("n")))

    def faults(self) -> DataFrame:
        """(rule, id) of every record that breaks a rule; see `validation.faults`. Many rules read the same
        records, so those of a recording are decoded once and written, without payloads."""
        known = ("transactions", "embedded", "located", "nodes", "datatypes", "signals", "changes")
        trace = self
        if self.decoded:
            scratch = Scratch(self.spark, "faults")
            trace = Trace(self.spark, {**self.tables, **{t: scratch.write(self.table(t).drop("payload")) for t in known[:3]}})
        return validation.faults({**{t: trace.table(t) for t in known}, "clocks": trace.clock_stretches()})

    def listed(self, df: DataFrame, n: int = LISTING) -> tuple[list, int]:
        """The first n rows of a listing, and how many more there are."""
        rows = df.limit(n).collect()
        return rows, max(0, df.count() - n) if len(rows) == n else 0

    def save(self, path: str) -> None:
        """Write every table as Parquet, small ones first; an existing directory is an error.
        Changes are clustered by signal and records by generator, so filters on them skip files."""
        order = ["recording", "strings", "interned", "datatypes", "nodes", "signals", "callsites", "blackouts", "time_steps", "changes", "transactions", "embedded", "located", "relations", "logs", "clocks"]
        by = {"changes": ["signal_id", "time", "seq"], "transactions": ["generator", "begin"], "located": ["generator", "begin"], "relations": ["source"]}
        for name in [n for n in order if n in self.tables]:
            df = self.tables[name]
            if name in by:
                df = df.repartitionByRange(*by[name]).sortWithinPartitions(*by[name])
            df.write.mode("errorifexists").parquet(f"{path}/{name}")
        self.spark.createDataFrame([(self.fingerprint,)], "fingerprint string").write.mode("errorifexists").parquet(f"{path}/_mark.parquet")


EMPTY = {
    **{k: v for k, v in model.TABLES.items()},
    "nodes": "node_id bigint, parent_id bigint, node_kind string, name string, signal_id bigint",
    "signals": "signal_id bigint, encoding string, width int, states int",
    "time_steps": "time bigint",
    "blackouts": "seq bigint, time bigint, active boolean",
    "datatypes": "datatype_id int, kind int, name string",
}


def content_mark(spark: SparkSession, path: str) -> str:
    """A digest of the content of the file or files at a path, in parallel by lines, whatever the order
    in which they are read; places in the file count."""
    from tickloom.sources.lines import ordered_lines

    h = F.xxhash64("pos", "value")
    seen = ordered_lines(spark, path).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftrightunsigned(h, 24)).alias("s")).first()
    return f"{seen['n']}-{seen['x']}-{seen['s']}"


def read_trace(spark: SparkSession, path: str, **options: str) -> Trace:
    """A trace of any supported kind. FST waveforms need an external decoder and are refused."""
    ship(spark)
    kind = format_of(path)
    if kind == "fst":
        raise ValueError("FST files are not supported; convert them to VCD")
    if kind == "saved":
        names = sorted(n for n in os.listdir(path) if not n.startswith(("_", ".")))
        mark = spark.read.parquet(f"{path}/_mark.parquet").first()
        return Trace(spark, {n: spark.read.parquet(f"{path}/{n}") for n in names}, mark["fingerprint"])
    if kind == "vcd":
        r = vcd.read_vcd(spark, path)
        signals = r.signals.withColumn("states", F.when(F.col("encoding") == "bits", 4).otherwise(2))
        return Trace(spark, {"nodes": r.nodes, "signals": signals, "changes": r.changes, "time_steps": r.time_steps, "blackouts": r.blackouts}, f"vcd-{content_mark(spark, path)}")
    if kind == "kanata":
        p = kanata.read_kanata(spark, path)
        tx = p.instructions.withColumn("parent", F.lit(None).cast("bigint"))
        embedded = p.stages.select(F.lit(None).cast("bigint").alias("id"), F.col("id").alias("owner"), "name", "lane", "begin", "end")
        return Trace(spark, {"transactions": tx, "embedded": embedded, "relations": p.relations.withColumn("seq", F.lit(None).cast("bigint")), "clocks": p.clocks.withColumn("id", F.lit(0).cast("bigint"))}, f"kanata-{content_mark(spark, path)}")
    container.register(spark)
    names = [t for t in container.TABLES if t != "sections"]
    tables = {t: spark.read.format("tickloom").options(table=t, **options).load(path) for t in names}
    trace = Trace(spark, tables, tables["recording"].first()["fingerprint"])
    trace.decoded = True
    return trace


def convert(spark: SparkSession, source: str, target: str) -> None:
    """Read a trace of any kind and save it."""
    read_trace(spark, source).save(target)
