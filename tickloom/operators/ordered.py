"""Ordered computations per key that no key's size turns into one task.

A window partitioned by a key alone puts a key that holds a third of all rows into one task.
These helpers cut the order (key, time, tie) of all rows into shards of about equal numbers of
rows, wherever the data say, and order rows within (key, shard); then only the shards of a key are
ordered, one row each. Bounds of shards are rows of a sample that is chosen by hash, so that every
evaluation finds the same ones, whatever the ticks look like; each helper costs one shuffle of its
rows, and before it a count and a sampling pass over the ordering columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shards per shuffle partition, so that the partitions come out even.
SHARDS = 4
#: Sampled rows per shard, about.
SAMPLED = 8


def _sharded(df: DataFrame, order: list[str], shards: int | None = None) -> DataFrame:
    """Adds `_shard`: the number of bounds at or before the row in the order of `order` (NULLs
    first). Rows equal in all of it are in one shard."""
    n = shards or SHARDS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n < 2:
        return df.withColumn("_shard", F.lit(0))
    place = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    every = F.greatest(F.floor(rows / F.lit(n * SAMPLED)), F.lit(1)).cast("bigint")
    # equal rows are one of the sample, so its size doesn't grow with the data
    sample = df.filter(F.pmod(F.xxhash64(*order), every) == 0).agg(F.sort_array(F.collect_set(place)).alias("s"))
    step = F.greatest(F.ceil(F.size("s") / F.lit(n)), F.lit(1)).cast("int")
    at = F.when(F.size("s") > step, F.sequence(step + 1, F.size("s"), step)).otherwise(F.array().cast("array<int>"))
    bounds = sample.select(F.transform(at, lambda i: F.element_at("s", i)).alias("b")).scalar()
    held = df.withColumn("_bounds", bounds).withColumn("_place", place)
    # binary search, from the highest power of two that may be needed
    steps = F.array(*(F.lit(1 << k) for k in reversed(range((2 * n).bit_length()))))
    found = F.aggregate(steps, F.lit(0), lambda lo, w: F.when(F.get("_bounds", lo + w - 1) <= F.col("_place"), lo + w).otherwise(lo))
    # adding nothing, the id of the row keeps the optimizer from copying the search into conditions that it infers
    return held.withColumn("_shard", found + (F.monotonically_increasing_id() * 0).cast("int")).drop("_bounds", "_place")


def _same(keys: list[str]) -> Column:
    cond = F.col("a._shard") == F.col("b._shard")
    for k in keys:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return cond


def neighbours(df: DataFrame, keys: list[str], time: str, tie: list[str], carry: list[str], shards: int | None = None) -> DataFrame:
    """Adds `prev` and `next`: structs of `carry` of the row before and after in the order
    (time, tie) of its key, NULL at the ends. Rows without a time are dropped; NULL keys are one
    key. Rows equal in time and tie come in any order."""
    row = F.struct(*(F.col(c).alias(c) for c in carry))
    order = [F.col(time), *(F.col(c) for c in tie)]
    rows = _sharded(df.filter(F.col(time).isNotNull()), [*keys, time, *tie], shards).withColumn("_row", row)
    w = Window.partitionBy(*keys, "_shard").orderBy(*order)
    near = rows.withColumn("prev", F.lag("_row").over(w)).withColumn("next", F.lead("_row").over(w))
    at = F.struct(*order)
    ends = rows.groupBy(*keys, "_shard").agg(F.min_by("_row", at).alias("_first"), F.max_by("_row", at).alias("_last"))
    v = Window.partitionBy(*keys).orderBy("_shard")
    ends = ends.withColumn("_before", F.lag("_last").over(v)).withColumn("_after", F.lead("_first").over(v))
    return near.alias("a").join(ends.alias("b"), _same(keys)).select(
        *(F.col(f"a.{c}").alias(c) for c in df.columns),
        F.coalesce("a.prev", "b._before").alias("prev"),
        F.coalesce("a.next", "b._after").alias("next"),
    )


def running(df: DataFrame, keys: list[str], time: str, tie: list[str], value: Column, name: str, kind: str = "sum", shards: int | None = None) -> DataFrame:
    """Adds `name`: the sum (or max) of `value` over the rows before this one, in the order
    (time, tie) of its key; 0 (or NULL) for the first."""
    fold = {"sum": F.sum, "max": F.max}[kind]
    rows = _sharded(df.filter(F.col(time).isNotNull()), [*keys, time, *tie], shards).withColumn("_value", value)
    w = Window.partitionBy(*keys, "_shard").orderBy(time, *tie).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("_here", fold("_value").over(w))
    v = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "_shard").agg(fold("_value").alias("_whole")).withColumn("_base", fold("_whole").over(v))
    both = F.greatest("a._here", "b._base") if kind == "max" else F.coalesce("a._here", F.lit(0)) + F.coalesce("b._base", F.lit(0))
    return near.alias("a").join(ends.alias("b"), _same(keys)).select(*(F.col(f"a.{c}").alias(c) for c in df.columns), both.alias(name))


def as_of(facts: DataFrame, probes: DataFrame, keys: list[str], time: str, tie: list[str], carry: list[str], probe_time: str, shards: int | None = None) -> DataFrame:
    """Each probe with `found`: `carry` of the last fact of its key with time <= probe time, in
    the order (time, tie), or NULL.

    Facts and probes are sorted together within shards; a shard starts from the last fact of the
    shards before it. Repeated probes stay; a probe with a NULL key or time finds nothing.
    Key columns must have the same names on both sides; other names may clash.
    """
    row = F.struct(*(F.col(c).alias(c) for c in [time, *carry]))
    probe = F.struct(*(F.col(c).alias(c) for c in probes.columns))
    order = F.struct(*(F.col(c).alias(c) for c in tie)) if tie else F.lit(None).cast("int")
    f = facts.filter(F.col(time).isNotNull()).select(
        *keys, F.col(time).cast("bigint").alias("_t"), F.lit(0).alias("_is_probe"), order.alias("_tie"), row.alias("_row"), F.lit(None).cast(probes.schema).alias("_probe")
    )
    for k in keys:
        f = f.filter(F.col(k).isNotNull())
    p = probes.select(
        *keys, F.col(probe_time).cast("bigint").alias("_t"), F.lit(1).alias("_is_probe"), F.lit(None).cast(f.schema["_tie"].dataType).alias("_tie"),
        F.lit(None).cast(f.schema["_row"].dataType).alias("_row"), probe.alias("_probe"),
    )
    # a probe's own columns don't matter for its place, but spread the probes of one tick
    spread = F.when(F.col("_is_probe") == 1, F.xxhash64("_probe"))
    rows = _sharded(f.unionByName(p).withColumn("_spread", spread), [*keys, "_t", "_is_probe", "_tie", "_spread"], shards)
    w = Window.partitionBy(*keys, "_shard").orderBy("_t", "_is_probe", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("_here", F.last("_row", ignorenulls=True).over(w)).filter("_is_probe = 1")
    last = F.max_by("_row", F.when(F.col("_is_probe") == 0, F.struct("_t", "_tie")))
    # shards that hold only probes carry no fact on their own but pass on the ones before
    v = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "_shard").agg(last.alias("_own")).withColumn("_before", F.last("_own", ignorenulls=True).over(v))
    found = F.when(F.col("a._t").isNotNull(), F.coalesce("a._here", "b._before"))
    return near.alias("a").join(ends.alias("b"), _same(keys)).select("a._probe.*", found.alias("found"))
