"""The driver's tables as a trace.

Signals come from `events` (one per user), transactions, embedded stages, relations, scopes and
generators from the trace tables, located stages from `lineitem` under `orders`, logs from
`events`, clock stretches from `part`, and a scope tree from region, nation, customer, supplier.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import table

#: Offsets that keep the ids of different sources apart.
ORDER_BASE, STAGE_BASE = 10**9, 2 * 10**9
#: Microseconds of 2024-01-01, the zero of event ticks; days are counted from 1992-01-01.
EPOCH_US = 1_704_067_200_000_000
HOUR = 3_600_000_000


def micros(column: str) -> F.Column:
    return F.unix_micros(F.col(column).cast("timestamp")) - EPOCH_US


def days(column: str) -> F.Column:
    return F.datediff(F.col(column), F.lit("1992-01-01").cast("date")).cast("bigint")


class Trace:
    """The tables of one directory in canonical form; everything is lazy."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.directory, name)

    @cached_property
    def changes(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.raw("events").select(
            F.col("user_id").alias("signal_id"), micros("ts").alias("time"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"),
            F.col("value").alias("real"), F.lpad(F.bin(k), 8, "0").alias("bits"),
        )

    @cached_property
    def hourly(self) -> DataFrame:
        """Changes with hours as ticks, so that activity has runs."""
        return self.changes.withColumn("time", F.expr(f"time div {HOUR}"))

    def transactions_where(self, condition: str | F.Column = "true") -> DataFrame:
        """Transactions, each once, whose rows meet a condition on the raw columns. Deliveries of a
        record agree, so the condition holds for all or none of them and is applied before they
        are made one, where it reaches the scan."""
        rows = self.raw("trace_transactions").filter("id is not null").filter(condition)
        one = rows.groupBy("id").agg(*(F.min(c).alias(c) for c in ("parent", "generator", "begin_tick", "end_tick", "status", "span_kind", "attrs", "block")))
        return one.select(
            "id", F.expr("nullif(parent, 0)").alias("parent"), F.col("generator").cast("bigint").alias("generator"), F.col("begin_tick").alias("begin"),
            F.col("end_tick").alias("end"), "status", "span_kind", "attrs", "block",
        )

    @cached_property
    def transactions(self) -> DataFrame:
        return self.transactions_where()

    @cached_property
    def embedded(self) -> DataFrame:
        rows = self.raw("embedded_stages").filter("stage_id is not null")
        one = rows.groupBy("stage_id").agg(*(F.min(c).alias(c) for c in ("owner", "stage_name", "lane", "begin_tick", "end_tick")))
        lane = F.coalesce(F.lower(F.trim("lane")), F.lit(""))
        return one.select(F.col("stage_id").alias("id"), "owner", F.col("stage_name").alias("name"), lane.alias("lane"), F.col("begin_tick").alias("begin"), F.col("end_tick").alias("end"))

    @cached_property
    def relations(self) -> DataFrame:
        rows = self.raw("trace_relations").filter("rel_seq is not null")
        one = rows.groupBy("rel_seq").agg(*(F.min(c).alias(c) for c in ("kind", "source", "destination", "block")))
        return one.withColumnRenamed("rel_seq", "seq")

    @cached_property
    def orders(self) -> DataFrame:
        """Orders as owners of line items, with priorities as generators."""
        o = self.raw("orders").select((F.col("o_orderkey") + ORDER_BASE).alias("id"), F.col("o_custkey").alias("customer"), days("o_orderdate").alias("begin"), "o_orderpriority", "o_orderstatus")
        last = self.raw("lineitem").groupBy((F.col("l_orderkey") + ORDER_BASE).alias("id")).agg(F.max(days("l_shipdate")).alias("last"))
        status = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 4).otherwise(0)
        return o.join(last, "id", "left").select(
            "id", "customer", F.substring("o_orderpriority", 1, 1).cast("bigint").alias("generator"), "begin", F.greatest("begin", "last").alias("end"), status.alias("status")
        )

    @cached_property
    def located(self) -> DataFrame:
        """Line items as located records under their order, generator the supplier: stages of
        l_quantity days, events (flag A) and logs (flag R) at one day. Ids repeat where order and
        line number do."""
        begin = days("l_shipdate")
        kind = F.when(F.col("l_returnflag") == "A", "event").when(F.col("l_returnflag") == "R", "log").otherwise("stage")
        end = F.when(F.col("l_returnflag").isin("A", "R"), begin).otherwise(begin + F.col("l_quantity").cast("bigint"))
        return self.raw("lineitem").select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber") + STAGE_BASE).alias("id"), kind.alias("kind"), F.col("l_suppkey").alias("generator"), begin.alias("begin"),
            end.alias("end"), (F.col("l_orderkey") + ORDER_BASE).alias("parent"),
        )

    @cached_property
    def clocks(self) -> DataFrame:
        p = F.col("p_partkey")
        begin, edges = p * 10000, 1 + p % 50
        return self.raw("part").select(
            F.expr("cast(substring(p_brand, 7) as bigint)").alias("clock"), p.alias("id"), begin.alias("begin"), (begin + F.col("p_size") * (edges - 1)).alias("end"),
            F.when(edges > 1, F.col("p_size").cast("bigint")).alias("period"),
        )

    @cached_property
    def scopes(self) -> DataFrame:
        """Region, nation, customer and supplier as nodes; customers and suppliers are variables
        whose signal is their nation's, so every nation has many aliases of one signal."""
        none = F.lit(None).cast("bigint")

        def part(df, node, parent, kind, name, signal=none):
            return df.select(node.cast("bigint").alias("node_id"), parent.cast("bigint").alias("parent_id"), F.lit(kind).alias("node_kind"), name.alias("name"), signal.cast("bigint").alias("signal_id"))

        c = F.col
        return (
            part(self.raw("region"), c("r_regionkey") + 1, none, "scope", c("r_name"))
            .unionByName(part(self.raw("nation"), c("n_nationkey") + 100, c("n_regionkey") + 1, "scope", c("n_name")))
            .unionByName(part(self.raw("customer"), c("c_custkey") + 1_000_000_000, c("c_nationkey") + 100, "variable", c("c_name"), c("c_nationkey")))
            .unionByName(part(self.raw("supplier"), c("s_suppkey") + 2_000_000_000, c("s_nationkey") + 100, "variable", c("s_name"), c("s_nationkey") + 1000))
        )

    @cached_property
    def census(self) -> DataFrame:
        """census_scopes as nodes."""
        rows = self.raw("census_scopes")
        return rows.groupBy(F.col("scope").cast("bigint").alias("node_id")).agg(
            F.min(F.when(F.col("parent") != -1, F.col("parent")).cast("bigint")).alias("parent_id"), F.lit("scope").alias("node_kind"), F.min("scope_name").alias("name"),
            F.min("scope_type").alias("scope_type"),
        )

    @cached_property
    def generators(self) -> DataFrame:
        return self.raw("trace_generators").select(F.col("generator").cast("bigint").alias("generator"), "gen_name", "gen_kind", F.col("scope").cast("bigint").alias("scope"), F.col("clock").cast("bigint").alias("clock"))

    @cached_property
    def logs(self) -> DataFrame:
        """Events of type error and purchase as log records without an owner."""
        k = F.get_json_object("props", "$.k").cast("bigint")
        site = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2)
        return self.raw("events").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("generator"), site.alias("datatype_id"), micros("ts").alias("begin"), F.lit(None).cast("bigint").alias("parent"), k.alias("arg")
        ).filter("datatype_id is not null")

    @cached_property
    def callsites(self) -> DataFrame:
        rows = [(1, "request {} failed", 4, "io.c", 10, "read"), (2, "bought {:#x}", 2, "shop.c", 22, "buy")]
        return self.spark.createDataFrame(rows, "datatype_id int, format string, severity int, file string, line int, func string")
