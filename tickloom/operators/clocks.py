"""Gated clocks: stretches of edges, cycle numbers and checks.

`stretches` is (clock, id, begin, end, period): edges at begin, begin + period, ... end. A
stretch of one edge may have a NULL period and counts as period 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ordered import as_of, neighbours, running


def _edges():
    return F.when(F.col("end") > F.col("begin"), F.expr("(`end` - begin) div coalesce(nullif(period, 0), 1)")).otherwise(0) + 1


def numbered(stretches: DataFrame) -> DataFrame:
    """Stretches with `base`, the number of edges before their first one."""
    return running(stretches, ["clock"], "begin", ["id"], _edges(), "base")


def cycle_at(stretches: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes (clock, probe_time, ...) with `cycle`: edges at or before the probe less one, NULL
    before the first edge. Between stretches the last edge counts on."""
    found = as_of(numbered(stretches), probes, ["clock"], "begin", ["id"], ["end", "period", "base"], "probe_time")
    into = F.expr("(least(probe_time, found.end) - found.begin) div coalesce(nullif(found.period, 0), 1)")
    return found.select(*probes.columns, (F.col("found.base") + into).alias("cycle"))


def overlaps(stretches: DataFrame) -> DataFrame:
    """Stretches that begin at or before the end of the one before: (clock, id, begin, before)."""
    out = neighbours(stretches, ["clock"], "begin", ["id"], ["end"])
    return out.filter(F.col("prev.end") >= F.col("begin")).select("clock", "id", "begin", F.col("prev.end").alias("before"))


def period_faults(stretches: DataFrame) -> DataFrame:
    """Stretches whose period is absent though they have a length, is zero, doesn't divide the
    length, or is there though they have one edge."""
    length = F.col("end") - F.col("begin")
    bad = (
        ((length > 0) & F.col("period").isNull()) | (F.col("period") <= 0) | ((length == 0) & F.col("period").isNotNull())
        | (F.when(F.col("period") > 0, F.pmod(length, F.col("period"))) != 0)
    )
    return stretches.filter(bad)


def from_runs(runs: DataFrame) -> DataFrame:
    """Stretches of runs (clock, seq, first, period, stop): a run ends at its stop, or where the
    next run of the clock begins less one tick; its last edge is the last one not after that.
    A stop before the first edge leaves the first edge. A clock's last run without a stop is
    open: its end and period are NULL."""
    out = neighbours(runs, ["clock"], "first", ["seq"], ["first"])
    close = F.least(F.col("stop"), F.col("next.first") - 1)
    until = F.when(close.isNotNull(), F.greatest(close, F.col("first")))
    count = F.expr("(u - first) div period")
    return out.withColumn("u", until).withColumn("k", count).select(
        "clock", F.col("seq").alias("id"), F.col("first").alias("begin"), (F.col("first") + F.col("k") * F.col("period")).alias("end"),
        F.when(F.col("k") > 0, F.col("period")).alias("period"),
    )


def clock_of(generators: DataFrame) -> DataFrame:
    """(generator, clock) of generators (generator, gen_kind, clock) whose clock is one."""
    known = generators.filter("gen_kind = 'CLOCK'").select(F.col("generator").alias("clock"))
    return generators.filter("clock is not null").select("generator", "clock").join(known, "clock", "left_semi").select("generator", "clock")
