"""Capture as a stream of operations: lifetimes, clocks and the order of several producers.

An operation log is (producer, stamp, seq, op, id, ...): producer time `stamp` never goes back
within a producer, `seq` is its order of arrival. Record timestamps (`time`) are independent of
producer time and may be out of order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.ordered import neighbours

#: Operations and what they carry.
OPS = ("begin", "payload", "attribute", "span_kind", "begin_stage", "end_stage", "end", "point", "relate", "clock_run", "clock_stop", "emit", "dump", "finish")

OP_SCHEMA = "producer string, stamp long, seq long, op string, id long, parent long, time long, name string, lane string, status int, value string"


def backward(ops: DataFrame) -> DataFrame:
    """Operations whose producer time is before that of the one before: errors, not late data."""
    out = neighbours(ops, ["producer"], "seq", [], ["stamp"])
    return out.filter(F.col("prev.stamp") > F.col("stamp")).drop("prev", "next")


def frontier(ops: DataFrame, producers: DataFrame) -> DataFrame:
    """(frontier, active): the least time that all unfinished producers have reached, NULL when
    all are finished. A producer (producer) without operations is at time 0, so it holds the
    frontier back until it reports or finishes."""
    last = ops.groupBy("producer").agg(F.max("stamp").alias("at"), F.max((F.col("op") == "finish").cast("int")).alias("done"))
    state = producers.select("producer").distinct().join(last, "producer", "left")
    live = state.filter(F.coalesce("done", F.lit(0)) == 0)
    return live.agg(F.min(F.coalesce("at", F.lit(0))).alias("frontier"), F.count(F.lit(1)).alias("active"))


def released(ops: DataFrame, producers: DataFrame) -> DataFrame:
    """Operations that may be applied: those below the frontier; with one active producer those at
    it too; all when every producer is finished."""
    at = frontier(ops, producers).select(F.struct("frontier", "active")).scalar()
    rows = ops.withColumn("_f", at)
    cond = F.col("_f.frontier").isNull() | (F.col("stamp") < F.col("_f.frontier")) | ((F.col("_f.active") < 2) & (F.col("stamp") == F.col("_f.frontier")))
    return rows.filter(cond).drop("_f")


def merge_order(ops: DataFrame) -> DataFrame:
    """Operations in the order of application: stamp, arrival, producer."""
    return ops.orderBy("stamp", "seq", "producer")


def lifetimes(ops: DataFrame, closed_at: int | None = None) -> DataFrame:
    """Owners of a log in batch: (id, parent, begin, end, status, span_kind, payload, label).

    `end` is never before `begin`; an owner without one is open to `closed_at` (NULL without it).
    The last payload, attribute of a key and span kind before the end count. An owner that ends
    without a payload, where one was deferred (value NULL at begin and no payload later), is
    discarded. One aggregate with partial states per owner.
    """
    at = F.struct("stamp", "seq")
    when = lambda op, c: F.when(F.col("op") == op, F.col(c))
    out = ops.filter(F.col("op").isin("begin", "payload", "span_kind", "end", "attribute")).groupBy("id").agg(
        F.min(when("begin", "parent")).alias("parent"),
        F.min(when("begin", "time")).alias("begin"),
        F.min_by(F.struct("time", "status"), F.when(F.col("op") == "end", at)).alias("e"),
        F.max_by(when("span_kind", "status"), F.when(F.col("op") == "span_kind", at)).alias("span_kind"),
        F.max_by("value", F.when(F.col("op").isin("begin", "payload") & F.col("value").isNotNull(), at)).alias("payload"),
        F.max_by(when("attribute", "value"), F.when((F.col("op") == "attribute") & (F.col("name") == "vtr.label"), at)).alias("label"),
    )
    out = out.filter("begin is not null and payload is not null")
    end = F.when(F.col("e").isNotNull(), F.greatest("e.time", "begin")).otherwise(F.greatest(F.lit(closed_at).cast("bigint"), F.col("begin")) if closed_at is not None else F.lit(None).cast("bigint"))
    return out.select("id", "parent", "begin", end.alias("end"), F.when(F.col("e").isNull(), 4).otherwise(F.coalesce("e.status", F.lit(0))).alias("status"), F.coalesce("span_kind", F.lit(0)).alias("span_kind"), "payload", "label")


def stage_lifetimes(ops: DataFrame, owners: DataFrame) -> DataFrame:
    """Located stages (id, owner, name, begin, end): ended on their own, else with their owner."""
    s = ops.filter(F.col("op").isin("begin_stage", "end_stage")).groupBy("id").agg(
        F.min(F.when(F.col("op") == "begin_stage", F.struct("time", "parent", "name"))).alias("b"), F.min(F.when(F.col("op") == "end_stage", F.struct("stamp", "seq", "time"))).alias("e")
    ).filter("b is not null")
    o = owners.select(F.col("id").alias("owner"), F.col("end").alias("owner_end"))
    joined = s.withColumn("owner", F.col("b.parent")).join(o, "owner", "left")
    end = F.coalesce(F.col("e.time"), F.col("owner_end"))
    return joined.select("id", "owner", F.col("b.name").alias("name"), F.col("b.time").alias("begin"), F.when(end.isNotNull(), F.greatest(end, F.col("b.time"))).alias("end"))


def writer_conflicts(ops: DataFrame) -> DataFrame:
    """(id, stamp, producers): resources that several producers touch at one time."""
    per = ops.filter("id is not null").groupBy("id", "stamp", "producer").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("id", "stamp").agg(F.count(F.lit(1)).alias("producers")).filter("producers > 1")


def dead_owners(ops: DataFrame) -> DataFrame:
    """Operations on an owner after its end, before its begin or without one, in the order of the log."""
    life = ops.groupBy("id").agg(
        F.min(F.when(F.col("op") == "begin", F.struct("stamp", "seq"))).alias("b"), F.min(F.when(F.col("op") == "end", F.struct("stamp", "seq"))).alias("e")
    )
    at = F.struct("stamp", "seq")
    touch = ops.filter(F.col("op").isin("payload", "attribute", "span_kind", "end")).join(life, "id")
    return touch.filter(F.col("b").isNull() | (at < F.col("b")) | (at > F.col("e"))).drop("b", "e")


_LIFE = T.StructType([T.StructField("id", T.LongType()), T.StructField("parent", T.LongType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()),
                      T.StructField("status", T.IntegerType()), T.StructField("payload", T.StringType()), T.StructField("fault", T.StringType())])
#: Owners with neighbouring ids, whose state is kept together.
SPAN = 1024
_STATE = "owners string"


def _apply(frames: Iterator[pd.DataFrame], state, forget: int | None = None) -> Iterator[pd.DataFrame]:
    """Operations of a span of owners in a micro-batch, in order, on their state: a list of
    (id, begin, parent, payload, ended, time of the last operation) as JSON."""
    now = 0 if forget is None else state.getCurrentProcessingTimeMs()
    owners = {o[0]: o for o in json.loads(state.get[0])} if state.exists else {}
    rows = []
    given = [] if state.hasTimedOut else [f for f in frames if len(f)]
    if given:
        ops = pd.concat(given, ignore_index=True).sort_values(["stamp", "seq"])
        for i, op, parent, child, time, status, value in zip(*(ops[c].tolist() for c in ("id", "op", "parent", "child", "time", "status", "value")), strict=True):
            value = value if isinstance(value, str) else None
            owner = owners.get(i)
            if owner is not None:
                owner[5] = now
            fault = None
            if op == "begin":
                if owner is None:
                    owners[i] = [i, int(time), parent if child else None, value, False, now]
                else:
                    fault = "begun twice"
            elif owner is None or owner[4]:
                fault = f"{op} without a live owner"
            elif op == "payload":
                owner[3] = value
            elif op == "end":
                owner[4] = True
                if owner[3] is None:
                    fault = "ended without a payload"
                else:
                    rows.append((i, owner[2], owner[1], max(int(time), owner[1]), 0 if pd.isna(status) else int(status), owner[3], None))
            if fault is not None:
                rows.append((i, None, None, None, None, None, fault))
    if forget is not None:
        owners = {i: o for i, o in owners.items() if not o[4] or o[5] + forget > now}
    if owners:
        state.update((json.dumps(list(owners.values())),))
        ended = [o[5] for o in owners.values() if o[4]]
        if forget is not None and ended:
            state.setTimeoutDuration(max(1, min(ended) + forget - now))
    elif state.exists:
        state.remove()
    if rows:
        types = {T.LongType(): "Int64", T.IntegerType(): "Int32", T.StringType(): object}
        yield pd.DataFrame({f.name: pd.Series(c, dtype=types[f.dataType]) for f, c in zip(_LIFE, zip(*rows, strict=True), strict=True)})


def stream_lifetimes(ops: DataFrame, forget: int | None = None) -> DataFrame:
    """Owners as they end, from a streaming log: (id, parent, begin, end, status, payload, fault).

    State per owner is four fields; operations of a micro-batch apply in order of (stamp, seq). The
    owners of `SPAN` neighbouring ids share a call and an entry of state, so the cost of both is
    divided among them and no entry holds more, however many owners there are.
    Faults (operations without a live owner, a missing payload) are rows, so nothing is lost
    silently. An ended owner keeps a tombstone, so that late operations are told apart from
    those of an owner that never began. With `forget` (milliseconds) tombstones that get no operation for
    so long are dropped, so that the state holds what is live; without it they stay.
    """
    # columns without NULLs stay whole numbers in pandas
    parent, time = F.coalesce("parent", F.lit(0)).alias("parent"), F.when(F.col("op") == "payload", 0).otherwise(F.col("time")).cast("bigint").alias("time")
    wanted = ops.filter(F.col("op").isin("begin", "payload", "end") & F.col("id").isNotNull()).select(
        F.expr(f"id div {SPAN}").alias("span"), "id", "stamp", "seq", "op", parent, F.col("parent").isNotNull().alias("child"), time, "status", "value"
    )
    timeout = "NoTimeout" if forget is None else "ProcessingTimeTimeout"

    def apply(key, frames, state):
        yield from _apply(frames, state, forget)

    return wanted.groupBy("span").applyInPandasWithState(apply, _LIFE, _STATE, "append", timeout)


def stream_windows(events: DataFrame, time: str, key: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts per key and window of a stream of events; a window is final once the watermark,
    `late` behind the latest event, has passed it. Several sources are joined by `union` and
    then keep to the slowest (spark.sql.streaming.multipleWatermarkPolicy = min)."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n"))


def stream_sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


def clock_operations(ops: DataFrame) -> DataFrame:
    """Runs (clock, seq, first, period, stop) of clock operations, for `clocks.from_runs`: a run
    is stopped by the next stop of its clock before the next run."""
    moves = ops.filter(F.col("op").isin("clock_run", "clock_stop"))
    out = neighbours(moves, ["id"], "stamp", ["seq"], ["op", "time"])
    return out.filter("op = 'clock_run'").select(
        F.col("id").alias("clock"), "seq", F.col("time").alias("first"), F.col("value").cast("bigint").alias("period"), F.when(F.col("next.op") == "clock_stop", F.col("next.time")).alias("stop")
    )


def all_or_nothing(batches: DataFrame) -> DataFrame:
    """Emissions (batch, ..., ok) of batches in which every one is valid."""
    bad = batches.filter(~F.coalesce("ok", F.lit(False))).select("batch").distinct()
    return batches.join(bad, "batch", "left_anti")


def last_value_wins(attributes: DataFrame) -> DataFrame:
    """Attributes (id, key, value, stamp, seq): one row per id and key, the last written."""
    return attributes.groupBy("id", "key").agg(F.max_by("value", F.struct("stamp", "seq")).alias("value"))


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; used where a batch repeats an operation."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
