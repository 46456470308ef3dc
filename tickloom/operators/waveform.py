"""Signal changes: point lookups, windows, holding intervals and deduplication.

`changes` is (signal_id, time, seq, value columns); (time, seq) is the order of emission.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ordered import as_of, neighbours


#: Markers of blackouts that become conditions of a filter.
MARKERS = 64


def check_window(first: int | None, last: int | None) -> None:
    """A window is closed at both ends; None is unbounded. A reversed one is an error."""
    if first is not None and last is not None and first > last:
        raise ValueError("window begins after its end")


def within(column: str, first: int | None, last: int | None) -> Column:
    check_window(first, last)
    cond = F.col(column).isNotNull()
    if first is not None:
        cond = cond & (F.col(column) >= first)
    if last is not None:
        cond = cond & (F.col(column) <= last)
    return cond


def changes_window(changes: DataFrame, first: int | None, last: int | None, signal: int | None = None) -> DataFrame:
    """Changes of all signals or one, with time in the closed window; the filter reaches the scan."""
    out = changes.filter(within("time", first, last))
    return out if signal is None else out.filter(F.col("signal_id") == signal)


def value_at(changes: DataFrame, probes: DataFrame, values: list[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Probes (signal_id, probe_time, ...) with `since` and the values in effect: those of the
    last change with time <= probe time in the order of emission, else `defaults` (NULL without)."""
    found = as_of(changes, probes, ["signal_id"], "time", ["seq"], values, "probe_time")
    cols = [F.coalesce(F.col(f"found.{v}"), F.lit((defaults or {}).get(v))).alias(v) if v in (defaults or {}) else F.col(f"found.{v}").alias(v) for v in values]
    return found.select(*probes.columns, F.col("found.time").alias("since"), *cols)


def value_at_time(changes: DataFrame, time: int, values: list[str]) -> DataFrame:
    """The values of every signal at one time: an aggregate, without a sort. Signals without a
    change until then have no row."""
    order = F.struct("time", "seq")
    return changes.filter(within("time", None, time)).groupBy("signal_id").agg(
        F.max("time").alias("since"), *(F.max_by(v, order).alias(v) for v in values)
    )


def hold_intervals(changes: DataFrame, values: list[str]) -> DataFrame:
    """Each change with `until`, the tick at which the next change of the signal is (NULL for the
    last). Changes at one tick hold an empty interval but for the last of them."""
    out = neighbours(changes, ["signal_id"], "time", ["seq"], ["time"])
    return out.select("signal_id", "time", "seq", *values, F.col("next.time").alias("until"))


def dedup_held(changes: DataFrame, value: str, keep: Column | None = None) -> DataFrame:
    """Changes whose value differs from the one before of the same signal. The first change of a
    signal is always kept, also if it equals the default; where `keep` is true (event signals)
    every occurrence is. NULL equals NULL; floats compare as Spark does (NaN equals NaN)."""
    out = neighbours(changes, ["signal_id"], "time", ["seq"], [value])
    cond = F.col("prev").isNull() | ~F.col(value).eqNullSafe(F.col(f"prev.{value}"))
    if keep is not None:
        cond = cond | keep
    return out.filter(cond).drop("prev", "next")


def previous_values(changes: DataFrame, value: str) -> DataFrame:
    """Each change with `before`, the value that the signal held until then (NULL at its first)."""
    out = neighbours(changes, ["signal_id"], "time", ["seq"], [value])
    return out.withColumn("before", F.col(f"prev.{value}")).drop("prev", "next")


def frames(changes: DataFrame, starts: DataFrame, value: str) -> DataFrame:
    """The value of every signal at the start of each block before any of the block's changes
    (starts: start_time, one row a block, a few rows): the last change with time < start."""
    listed = starts.agg(F.sort_array(F.collect_set("start_time")).alias("s")).scalar()
    probes = changes.select("signal_id").distinct().select("signal_id", F.explode(listed).alias("start_time"))
    asked = probes.withColumn("probe_time", F.col("start_time") - 1)
    return value_at(changes, asked, [value]).select("signal_id", "start_time", value)


def ordered_changes(changes: DataFrame, n: int | None = None) -> DataFrame:
    """Changes by (time, signal, emission); with n the first n of them (no full sort is needed)."""
    out = changes.orderBy("time", "signal_id", "seq")
    return out if n is None else out.limit(n)


def time_steps(changes: DataFrame, *more: DataFrame) -> DataFrame:
    """The distinct ticks of changes, and of further (time) tables such as quiet progress."""
    out = changes.select("time")
    for df in more:
        out = out.unionByName(df.select("time"))
    return out.filter("time is not null").distinct()


def time_range(columns: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """(first, last) over tables given as (table, begin column, end column); NULLs are ignored.
    Each table is reduced to one row before they meet."""
    parts = None
    for df, b, e in columns:
        one = df.agg(F.min(b).alias("first"), F.max(F.coalesce(e, b)).alias("last"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.agg(F.min("first").alias("first"), F.max("last").alias("last"))


def alias_changes(changes: DataFrame, variables: DataFrame) -> DataFrame:
    """The changes under every name: variables (path, signal_id) may share a signal."""
    return variables.select("path", "signal_id").join(changes, "signal_id")


def suppress_dumped(changes: DataFrame, blackouts: DataFrame) -> DataFrame:
    """Changes outside blackouts (time, active, seq if markers share a tick): a change counts while
    the last marker before or at its time is active or there is none. NULL times are dropped.

    Up to MARKERS markers (a recording has a handful) become a sorted list that each change is
    looked up in where it is read; more of them are matched in shards of the order of time."""
    tie = F.col("seq") if "seq" in blackouts.columns else F.lit(0)
    marks = blackouts.filter("time is not null").select(F.lit(0).alias("k"), F.col("time").cast("bigint").alias("time"), tie.cast("bigint").alias("seq"), F.col("active"))
    timed = changes.filter("time is not null")
    few = marks.limit(MARKERS + 1).select("time", "seq", "active").collect()
    if len(few) > MARKERS:
        found = as_of(marks, timed.withColumn("k", F.lit(0)), ["k"], "time", ["seq"], ["active"], "time")
        return found.filter(F.coalesce(F.col("found.active"), F.lit(True))).drop("found", "k")
    off, since = F.lit(False), None
    for m in [*sorted(few, key=lambda m: (m["time"], m["seq"])), None]:
        if since is not None and (m is None or m["active"] is not False):
            off = off | ((F.col("time") >= since) & (F.col("time") < m["time"]) if m is not None else F.col("time") >= since)
            since = None
        elif since is None and m is not None and m["active"] is False:
            since = m["time"]
    return timed.filter(~off)


def blackout_faults(blackouts: DataFrame) -> DataFrame:
    """Markers (seq, time, active) that go back in time or repeat the state before."""
    prev = neighbours(blackouts.withColumn("k", F.lit(0)), ["k"], "seq", [], ["time", "active"])
    bad = (F.col("prev.time") > F.col("time")) | (F.col("prev.active") == F.col("active"))
    return prev.filter(bad).select("seq", "time", "active")
