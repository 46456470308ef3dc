"""Overlapping and gapped intervals: continuous busy periods and the gaps between them.

Ticks are discretised into run bitmaps (sorted disjoint [start, end] runs of set units) per
entity and time shard. Tasks union their own rows into bitmaps before the shuffle, so what
reaches a shard is bounded by its 2^16 units, however many intervals an entity has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.aggregates import has_interval, one_per_id
from tickloom.session import Scratch

#: Bits of a unit at each level. A shard of levels 0 and 1 has 2^16 units; level 2 has one shard.
UNIT_BITS = (0, 16, 32)
#: Rows that a task gathers before it unions them into bitmaps.
GATHER = 400_000


def _pieces(b: np.ndarray, e: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Intervals as (row, level, shard, start, end): at most two pieces of a shard per level, and
    whole shards between them as units of the next level."""
    out = []
    row, x, y = np.arange(len(b)), b, e
    for level in (0, 1):
        one = (x >> 16) == (y >> 16)
        for keep, lo, hi in ((one, x, y), (~one, x, x | 0xFFFF), (~one, y & ~0xFFFF, y)):
            if keep.any():
                lo, hi = lo[keep], hi[keep]
                out.append((row[keep], level, lo >> 16, lo & 0xFFFF, hi & 0xFFFF))
        more = ~one & ((x >> 16) + 1 <= (y >> 16) - 1)
        row, x, y = row[more], (x[more] >> 16) + 1, (y[more] >> 16) - 1
    if len(row):
        out.append((row, 2, np.zeros(len(row), np.int64), x, y))
    return out


def _union(keys: pa.Table, row: np.ndarray, level: np.ndarray, shard: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Table:
    """One bitmap per key, level and shard from runs in any order; `row` gives a run's row in `keys`."""
    code = np.zeros(keys.num_rows, np.int64)
    for name in keys.column_names:
        c, values = pd.factorize(keys[name].to_pandas(), use_na_sentinel=False)
        code = np.unique(code * len(values) + c, return_inverse=True)[1]
    code = code[row]
    order = np.lexsort((s, shard, level, code))
    code, level, shard, s, e, row = code[order], level[order], shard[order], s[order], e[order], row[order]
    new_group = np.ones(len(s), bool)
    new_group[1:] = (code[1:] != code[:-1]) | (level[1:] != level[:-1]) | (shard[1:] != shard[:-1])
    far = (np.cumsum(new_group) - 1) * (1 << 34) + (1 << 31)  # groups lie apart on one axis
    top = np.maximum.accumulate(e + far)
    new_run = np.ones(len(s), bool)
    new_run[1:] = (s + far)[1:] > top[:-1] + 1
    starts = np.flatnonzero(new_run)
    ends = np.append(starts[1:], len(s)) - 1
    firsts = np.flatnonzero(new_group)
    offsets = np.append(np.searchsorted(starts, firsts), len(starts)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v)) for v in (s[starts], (top - far)[ends])]
    out = keys.take(pa.array(row[firsts]))
    for name, v in (("level", pa.array(level[firsts].astype(np.int32))), ("shard", pa.array(shard[firsts])), ("starts", lists[0]), ("ends", lists[1])):
        out = out.append_column(name, v)
    return out


def _discretise(keys: list[str]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(batches):
            t = pa.Table.from_batches(batches)
            pieces = _pieces(t["b"].to_numpy(), t["e"].to_numpy())
            cat = [np.concatenate(x) for x in zip(*((r, np.full(len(r), lv), sh, s, e) for r, lv, sh, s, e in pieces), strict=True)]
            return _union(t.select(keys), *cat).combine_chunks().to_batches(max_chunksize=50_000)

        held, n = [], 0
        for batch in it:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= GATHER:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return run


def _merge(keys: list[str]):
    """Union the bitmaps of a sorted partition; a shard's bitmaps may span batches."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = [*keys, "level", "shard"]

        def flush(t):
            lengths = np.diff(t["starts"].combine_chunks().offsets.to_numpy()) if t.num_rows else np.zeros(0, int)
            row = np.repeat(np.arange(t.num_rows), lengths)
            flat = [t[c].combine_chunks().flatten().to_numpy() for c in ("starts", "ends")]
            level, shard = (t[c].to_numpy().astype(np.int64)[row] for c in ("level", "shard"))
            return _union(t.select(keys), row, level, shard, *flat).combine_chunks().to_batches(max_chunksize=50_000)

        held = None
        for batch in it:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 100_000:
                continue
            held = held.combine_chunks()
            last = held.slice(held.num_rows - 1).select(by).to_pylist()[0]
            same = np.ones(held.num_rows, bool)
            for c in by:
                v = held[c].to_pandas()
                same &= (v.isna() if last[c] is None else v == last[c]).to_numpy()
            cut = held.num_rows - int(same.sum())  # rows are sorted: the last shard's are at the end
            if cut:
                yield from flush(held.take(pa.array(np.arange(cut))))
                held = held.take(pa.array(np.arange(cut, held.num_rows)))
        if held is not None and held.num_rows:
            yield from flush(held.combine_chunks())

    return run


def run_bitmaps(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level, shard, starts, ends) of intervals (keys, b, e), both ends included, b <= e."""
    types = ", ".join(f"`{c}` {intervals.schema[c].dataType.simpleString()}" for c in keys)
    schema = f"{types}, level int, shard long, starts array<long>, ends array<long>"
    local = intervals.select(*keys, "b", "e").mapInArrow(_discretise(keys), schema)
    by = [*keys, "level", "shard"]
    return local.repartition(*by).sortWithinPartitions(*by).mapInArrow(_merge(keys), schema)


class Coverage:
    """Bitmaps of entities, and what they say. `coverage` builds it from intervals."""

    def __init__(self, bitmaps: DataFrame, keys: list[str]):
        self.bitmaps, self.keys = bitmaps, keys

    def _not_within(self, df: DataFrame, tick: str, levels: tuple[int, ...]) -> DataFrame:
        """Rows whose unit (that of `tick`) no bitmap of the given higher levels has set."""
        for level in levels:
            unit = F.shiftright(tick, UNIT_BITS[level])
            cover = self.bitmaps.filter(F.col("level") == level).select(
                *(F.col(k).alias(f"_{k}") for k in self.keys), F.col("shard").alias("_shard"), F.col("starts").alias("_s"), F.col("ends").alias("_e")
            )
            at = F.shiftright(unit, 16) == F.col("_shard") if level < 2 else F.lit(True)
            x = F.col("_x") if level == 2 else F.col("_x").bitwiseAND(0xFFFF)
            hit = F.exists(F.arrays_zip("_s", "_e"), lambda r: (r["_s"] <= x) & (r["_e"] >= x))
            cond = at
            for k in self.keys:
                cond = cond & (F.col(k) == F.col(f"_{k}"))
            df = df.withColumn("_x", unit).join(cover, cond & hit, "left_anti").drop("_x")
        return df

    def _hulls(self) -> DataFrame:
        """(keys, high, b, e): hulls of the level 0 shards, and the runs of level 1."""
        bits, low = UNIT_BITS, self.bitmaps.filter("level = 0")
        base = F.shiftleft("shard", 16)
        zero = low.select(*self.keys, (base + F.col("starts")[0]).alias("b"), (base + F.element_at("ends", -1)).alias("e"))
        runs = self.bitmaps.filter("level = 1").select(*self.keys, "shard", F.explode(F.arrays_zip("starts", "ends")).alias("r"))
        unit = F.shiftleft("shard", 16)
        one = runs.select(
            *self.keys, F.shiftleft(unit + F.col("r.starts"), bits[1]).alias("b"), (F.shiftleft(unit + F.col("r.ends"), bits[1]) + 0xFFFF).alias("e")
        )
        return zero.unionByName(one).withColumn("high", F.shiftright("b", 32))

    @staticmethod
    def _between(df: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("b", "e").rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("top", F.max("e").over(w)).withColumn("gap_end", F.try_subtract("b", F.lit(1))).filter("gap_end > top")

    def _wide(self) -> DataFrame:
        """Per 2^32 ticks of an entity the hull of what is set, with the runs of level 2."""
        near = self._hulls()
        wide = near.groupBy(*self.keys, "high").agg(F.min("b").alias("b"), F.max("e").alias("e")).drop("high")
        two = self.bitmaps.filter("level = 2").select(*self.keys, F.explode(F.arrays_zip("starts", "ends")).alias("r"))
        two = two.select(*self.keys, F.shiftleft("r.starts", 32).alias("b"), (F.shiftleft("r.ends", 32) + 0xFFFFFFFF).alias("e"))
        return wide.unionByName(two)

    def gaps(self) -> DataFrame:
        """(keys, gap_begin, gap_end): each maximal run of clear ticks between set ones.

        Clear runs within a shard come from its bitmap, those between the at most 2^16 shards
        and runs of units of 2^32 ticks from a window over them, and those between the latter
        from a window with one row per 2^32 ticks. Clear runs of a shard that a longer interval
        covers whole, as set units of a higher level, don't count.
        """
        inner = self.bitmaps.filter((F.col("level") == 0) & (F.size("starts") > 1)).withColumn("tick", F.shiftleft("shard", 16))
        inner = self._not_within(inner, "tick", (1, 2))
        clear = F.arrays_zip(
            F.slice("ends", F.lit(1), F.size("ends") - 1).alias("l"), F.slice("starts", F.lit(2), F.size("starts") - 1).alias("r")
        )
        inner = inner.select(*self.keys, "tick", F.explode(clear).alias("g")).select(
            *self.keys, (F.col("tick") + F.col("g.l") + 1).alias("gap_begin"), (F.col("tick") + F.col("g.r") - 1).alias("gap_end")
        )
        near = self._hulls()
        middle = self._not_within(self._between(near, [*self.keys, "high"]), "b", (2,))
        outer = self._between(self._wide(), self.keys)
        cut = [*self.keys, (F.col("top") + 1).alias("gap_begin"), "gap_end"]
        return inner.unionByName(middle.select(*cut)).unionByName(outer.select(*cut))

    def busy(self) -> DataFrame:
        """(keys, begin, end): each maximal run of set ticks. Periods end where the next gap
        begins; gaps are ordered within shards of 2^20 ticks and then the shards' first ones."""
        hull = self._wide().groupBy(*self.keys).agg(F.min("b").alias("first"), F.max("e").alias("final"))
        marks = self.gaps().select(*self.keys, F.col("gap_begin").alias("at"), (F.col("gap_end") + 1).alias("begin")).unionByName(
            hull.select(*self.keys, F.col("first").alias("at"), F.col("first").alias("begin"))
        )
        marks = marks.withColumn("shard", F.shiftright("at", 20))
        near = marks.withColumn("next", F.lead("at").over(Window.partitionBy(*self.keys, "shard").orderBy("at")))
        heads = marks.groupBy(*self.keys, "shard").agg(F.min("at").alias("head"))
        heads = heads.withColumn("next_head", F.lead("head").over(Window.partitionBy(*self.keys).orderBy("shard"))).drop("head")
        return (
            near.join(heads, [*self.keys, "shard"])
            .join(hull, self.keys)
            .select(*self.keys, "begin", F.coalesce(F.coalesce("next", "next_head") - 1, "final").alias("end"))
        )


def coverage(intervals: DataFrame, keys: list[str], begin: str, end: str) -> Coverage:
    """Coverage of the entities named by `keys`.

    Both end ticks belong to an interval. Rows with a NULL key, tick or with end < begin have no
    interval and are left out; repeated rows change nothing. Any 64-bit ticks are allowed.
    """
    ok = F.col(end) >= F.col(begin)
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    rows = intervals.filter(ok).select(*keys, F.col(begin).cast("bigint").alias("b"), F.col(end).cast("bigint").alias("e"))
    return Coverage(Scratch(intervals.sparkSession, "bitmaps").write(run_bitmaps(rows, keys)), keys)


def trace_intervals(transactions: DataFrame, stages: DataFrame) -> DataFrame:
    """(entity, entity_id, lane, b, e) of the transactions per generator, and of the stages per
    owner and lane. An open stage ends at the larger of its begin and its owner's end; without a
    known end of the owner that is its begin. Lanes are trimmed and in lower case, NULL is ''."""
    tx = one_per_id(transactions, "id", "generator", "begin_tick", "end_tick").filter(has_interval())
    per_generator = tx.select(
        F.lit("generator").alias("entity"), F.col("generator").cast("bigint").alias("entity_id"), F.lit("").alias("lane"), F.col("begin_tick").alias("b"), F.col("end_tick").alias("e")
    )
    # deliveries agree in these columns: distinct rows hash, where a minimum of text would sort
    st = stages.filter("stage_id is not null").select("stage_id", "owner", "lane", "begin_tick", "end_tick").distinct()
    lane = F.coalesce(F.lower(F.regexp_replace("lane", r"^\s+|\s+$", "")), F.lit(""))
    cut = [F.lit("lane").alias("entity"), F.col("owner").alias("entity_id"), lane.alias("lane"), F.col("begin_tick").alias("b"), F.col("e")]
    closed = st.filter("end_tick is not null").withColumn("e", F.col("end_tick")).select(*cut)
    owners = one_per_id(transactions, "id", "end_tick").select(F.col("id").alias("owner"), F.col("end_tick").alias("owner_end"))
    opened = st.filter("end_tick is null and owner is not null").join(owners, "owner", "left").withColumn("e", F.greatest("begin_tick", "owner_end")).select(*cut)
    return per_generator.unionByName(closed).unionByName(opened)


TRACE_KEYS = ["entity", "entity_id", "lane"]


def trace_coverage(transactions: DataFrame, stages: DataFrame) -> Coverage:
    return coverage(trace_intervals(transactions, stages), TRACE_KEYS, "b", "e")
