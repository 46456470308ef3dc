"""Activity: when signals change and generators are busy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.intervals import coverage
from tickloom.operators.joins import overlap_join


def _after_first(changes: DataFrame, t_min: int | None) -> DataFrame:
    ticks = changes.filter("time is not null and signal_id is not null").select("signal_id", "time")
    if t_min is not None:
        return ticks.filter(F.col("time") > t_min)
    return ticks.filter(F.col("time") > changes.agg(F.min("time").alias("t")).scalar())


def signal_activity(changes: DataFrame, t_min: int | None = None) -> DataFrame:
    """(signal_id, first, last, gap): maximal runs of consecutive ticks with a change, after the
    recording's first tick (`t_min`, by default the first change). gap is 0 for a single tick."""
    runs = coverage(_after_first(changes, t_min), ["signal_id"], "time", "time").busy()
    return runs.select("signal_id", F.col("begin").alias("first"), F.col("end").alias("last"), (F.col("begin") < F.col("end")).cast("int").alias("gap"))


def activity_summary(changes: DataFrame, t_min: int | None = None) -> DataFrame:
    """(signal_id, ticks, stretches): distinct ticks with a change, and runs of them."""
    runs = signal_activity(changes, t_min)
    return runs.groupBy("signal_id").agg(F.sum(F.col("last") - F.col("first") + 1).alias("ticks"), F.count(F.lit(1)).alias("stretches"))


def generator_activity(transactions: DataFrame, located: DataFrame | None = None) -> DataFrame:
    """(generator, begin, end): union of closed transactions [begin, end] and clocks, positive
    stages [begin, end - 1] and points; overlapping or adjacent intervals are one."""
    spans = transactions.select("generator", F.col("begin").alias("b"), F.col("end").alias("e"))
    if located is not None:
        last = F.when(F.col("end") > F.col("begin"), F.col("end") - 1).otherwise(F.col("begin"))
        spans = spans.unionByName(located.select("generator", F.col("begin").alias("b"), last.alias("e")))
    return coverage(spans, ["generator"], "b", "e").busy()


def active_in(stretches: DataFrame, key: str, first: str, last: str, a: int, b: int) -> DataFrame:
    """Keys with a stretch that meets the closed window [a, b]; none meets a reversed one."""
    return stretches.filter((F.col(first) <= b) & (F.col(last) >= a) & F.lit(a <= b)).select(key).distinct()


def signals_active(changes: DataFrame, a: int, b: int, t_min: int | None = None) -> DataFrame:
    """Signals (signal_id) with a change in the closed window [a, b], as `active_in` over
    `signal_activity`: a stretch meets a window where it has a tick there, so the window goes to the
    scan and no stretch is built. A reversed window has none."""
    inside = changes.filter(F.col("time").between(a, b))
    first = F.lit(t_min) if t_min is not None else changes.agg(F.min("time").alias("t")).scalar()
    return inside.filter(F.col("signal_id").isNotNull() & (F.col("time") > first)).select("signal_id").distinct()


def generators_active(transactions: DataFrame, located: DataFrame | None, a: int, b: int) -> DataFrame:
    """Generators busy in the closed window [a, b], as `active_in` over `generator_activity`, without
    building the union: an interval of a generator meets the window or none of its union does."""
    spans = transactions.filter((F.col("begin") <= b) & (F.col("end") >= a) & (F.col("begin") <= F.col("end"))).select("generator")
    if located is not None:
        last = F.when(F.col("end") > F.col("begin"), F.col("end") - 1).otherwise(F.col("begin"))
        spans = spans.unionByName(located.filter((F.col("begin") <= b) & (last >= a)).select("generator"))
    return spans.filter(F.col("generator").isNotNull() & F.lit(a <= b)).distinct()


def active_in_windows(stretches: DataFrame, key: str, first: str, last: str, windows: DataFrame) -> DataFrame:
    """(window_id, key) for windows (window_id, w_first, w_last): keys active in each."""
    hit = overlap_join(windows, stretches.select(key, F.col(first).alias("_f"), F.col(last).alias("_l")), ("w_first", "w_last"), ("_f", "_l"))
    return hit.select("window_id", key).distinct()


def first_names(active: DataFrame, variables: DataFrame) -> DataFrame:
    """Each active signal once, under the path of its first variable (smallest node_id)."""
    named = variables.groupBy("signal_id").agg(F.min_by("path", "node_id").alias("path"))
    return active.join(named, "signal_id").select("signal_id", "path")
