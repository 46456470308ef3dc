"""Per-key aggregation that stays balanced when a few keys hold most records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: End tick of a record that has not ended.
OPEN_END = 9223372036854775807


def has_interval(begin: str | Column = "begin_tick", end: str | Column = "end_tick") -> Column:
    """True where both ticks are present, in order, and the end is not the open mark; never NULL."""
    b, e = (F.col(x) if isinstance(x, str) else x for x in (begin, end))
    return F.coalesce((e >= b) & (e != F.lit(OPEN_END)), F.lit(False))


def one_per_id(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per non-NULL `key`, with `columns` of any of its deliveries.

    Deliveries of one record are equal in these columns, so any of them serves; `min` is used
    because it is deterministic and, on fixed-width columns, keeps its state in hash tables that
    combine before the shuffle and spill by sorting. Rows without a key are dropped.
    """
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*(F.min(c).alias(c) for c in columns))


def per_key_totals(records: DataFrame, key: str, begin: str, end: str) -> DataFrame:
    """Per key: records, records with an interval, first begin, last end and summed duration.

    `records` holds one row per record. All five are algebraic: each task combines its rows in a
    bounded hash table (beyond its memory it spills sorted states that are merged later), so a
    key that holds a third of all rows reaches the final stage as one small row per task.

    A NULL key is a key of its own. First begin is over all present begins, last end over all
    ends but the open mark; both are NULL where there are none. The duration is summed over
    records that have an interval, as decimal, so it can't overflow; it is 0 without any.
    """
    ok = has_interval(begin, end)
    length = F.col(end).cast("decimal(20,0)") - F.col(begin).cast("decimal(20,0)")
    return records.groupBy(key).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(ok).alias("with_interval"),
        F.min(begin).alias("first_begin"),
        F.max(F.when(F.col(end) != OPEN_END, F.col(end))).alias("last_end"),
        F.coalesce(F.sum(F.when(ok, length)), F.lit(0)).cast("decimal(38,0)").alias("total_duration"),
    )


def generator_totals(transactions: DataFrame) -> DataFrame:
    """per_key_totals of trace_transactions by generator; deliveries of a record count once."""
    records = one_per_id(transactions, "id", "generator", "begin_tick", "end_tick")
    return per_key_totals(records, "generator", "begin_tick", "end_tick")


def heavy_keys(totals: DataFrame, key: str, share: float) -> DataFrame:
    """Keys that hold at least `share` of all records, NULL keys counted in the total only.

    The total is a scalar subquery over the per-key rows, whose exchange Spark reuses.
    """
    total = totals.agg(F.sum("records").alias("t")).scalar()
    return totals.filter(F.col(key).isNotNull() & (F.col("records") >= F.lit(share) * total)).select(
        F.col(key).cast("bigint").alias(key)
    )
