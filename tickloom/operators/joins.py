"""Interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], keys: list[str] | None = None, levels: int = 8) -> DataFrame:
    """All pairs of rows whose closed intervals meet, on equal `keys` if given.

    Each interval stands in the dyadic cells of its own level: the smallest width 2^(8k) at
    least its length, of which it touches at most two. A pair meets at the level of the wider
    interval, where the narrower one is in at most two cells as well, so a row is copied at most
    2 * levels times whatever its length (128 times above 2^56 ticks), and the join is an equi-join on (level, cell). A pair
    that shares two cells is kept in the first one only. Rows with NULL or reversed intervals
    match nothing. Columns of both sides must have different names, apart from `keys`.
    """
    keys = keys or []

    def cells(df, lo, hi, every):
        ok = df.filter((F.col(lo) <= F.col(hi)))
        length = F.col(hi) - F.col(lo)
        level = F.lit(levels - 1)
        for k in reversed(range(levels - 1)):
            level = F.when(length < F.lit(1 << (8 * k)), k).otherwise(level)
        own = ok.withColumn("_level", level)
        levels_of = F.sequence(F.col("_level"), F.lit(levels - 1)) if every else F.array("_level")
        out = own.withColumn("_at", F.explode(levels_of))
        first, last = F.expr(f"shiftright(`{lo}`, _at * 8)"), F.expr(f"shiftright(`{hi}`, _at * 8)")
        return out.withColumn("_cell", F.explode(F.sequence(first, last)))

    def joined(wide, narrow, w, n, strict):
        x, y = cells(wide, *w, False).drop("_level"), cells(narrow, *n, True)
        y = y.withColumnsRenamed({"_at": "_at2", "_cell": "_cell2", "_level": "_level2"})
        y = y.withColumnsRenamed({k: f"_r_{k}" for k in keys})
        cond = (F.col("_at") == F.col("_at2")) & (F.col("_cell") == F.col("_cell2"))
        cond = cond & ((F.col("_level2") < F.col("_at")) if strict else (F.col("_level2") <= F.col("_at")))
        for k in keys:
            cond = cond & (F.col(k) == F.col(f"_r_{k}"))
        cond = cond & (F.col(w[0]) <= F.col(n[1])) & (F.col(w[1]) >= F.col(n[0]))
        # the first shared cell is that of the later begin
        start = F.expr(f"shiftright(greatest(`{w[0]}`, `{n[0]}`), _at * 8)")
        return x.join(y, cond & (F.col("_cell") == start))

    both = [*left.columns, *(c for c in right.columns if c not in keys)]
    one = joined(left, right, a, b, False).select(*both)
    two = joined(right, left, b, a, True)
    two = two.select(*(F.col(f"_r_{c}").alias(c) if c in keys else F.col(c) for c in both))
    return one.unionByName(two)


def expand_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every (from_id, to_id) of two keyed member tables (key, id): all members of a key on one
    side with all on the other, as related groups mean. The result has the product of the two
    members' numbers per key by definition; NULL keys relate nothing."""
    a, b = left.select(key, F.col("id").alias("from_id")), right.select(key, F.col("id").alias("to_id"))
    return a.join(b, key).select("from_id", "to_id")
