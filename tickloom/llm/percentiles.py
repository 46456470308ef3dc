"""Percentiles of very large numeric columns by distributed multi-select.

Tasks sort the values of each group that they hold into runs; a run is reduced to points with
weights, so that a rank is wrong by at most `eps` of all values, and runs of different
partitions, blocks or days combine by standing side by side. Selection then works on the runs:
each proposes the median of what it still has in range, the weighted median of the proposals
(first of those in a task, then of the tasks') becomes the pivot, the runs count three ways against it, and the ruled-out range is discarded
(runs are rewritten whenever at most half of their points are left), for all groups and percentiles at once, until every rank is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.aggregates import has_interval, one_per_id
from tickloom.session import Scratch, table

#: Values that a task gathers before it sorts them into runs.
GATHER = 1_000_000
#: Points of a group still in range at which they are brought together and the rank is read off.
FINISH = 512


def _runs(keys: list[str], eps: float):
    def flush(batches):
        t = pa.Table.from_batches(batches)
        code = np.zeros(t.num_rows, np.int64)
        for k in keys:
            c, values = pd.factorize(t[k].to_pandas(), use_na_sentinel=False)
            code = np.unique(code * len(values) + c, return_inverse=True)[1]
        v = t["value"].to_numpy()
        order = np.lexsort((v, code))
        code, v = code[order], v[order]
        firsts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        sizes = np.diff(np.append(firsts, len(code)))
        stride = np.maximum(1, (sizes * eps).astype(np.int64))  # a point stands for so many values around it
        within = np.arange(len(code)) - np.repeat(firsts, sizes)
        s, size = np.repeat(stride, sizes), np.repeat(sizes, sizes)
        start = within - within % s
        weight = np.minimum(s, size - start)
        keep = within == start + (weight - 1) // 2
        points = np.add.reduceat(keep, firsts)
        offsets = pa.array(np.append(0, np.cumsum(points)).astype(np.int32))
        out = t.select(keys).take(pa.array(order[firsts]))
        out = out.append_column("points", pa.ListArray.from_arrays(offsets, pa.array(v[keep])))
        out = out.append_column("weights", pa.ListArray.from_arrays(offsets, pa.array(weight[keep])))
        return out.combine_chunks().to_batches(max_chunksize=2_000)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in it:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= GATHER:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return run


def summarise(values: DataFrame, keys: list[str], value: str, eps: float = 0.001) -> DataFrame:
    """The runs (keys, points, weights) of `value` per group, without a shuffle.

    With eps 0 a run keeps every value and selection is exact. NULL values are left out, NULL
    keys are groups of their own. Summaries of different parts are combined by `union`; a key
    left out of a summary afterwards merges the groups that it told apart.
    """
    types = ", ".join(f"`{k}` {values.schema[k].dataType.simpleString()}" for k in keys)
    rows = values.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("bigint").alias("value"))
    return rows.mapInArrow(_runs(keys, eps), f"{types}, points array<long>, weights array<long>")


def _combined(keys: list[str]):
    """Runs of one key that a task holds as one run, equal points as one with the sum of weights."""

    def flush(batches):
        t = pa.Table.from_batches(batches).combine_chunks()
        code = np.zeros(t.num_rows, np.int64)
        for k in keys:
            c, values = pd.factorize(t[k].to_pandas(), use_na_sentinel=False)
            code = np.unique(code * len(values) + c, return_inverse=True)[1]
        lists = t["points"].combine_chunks()
        run = np.repeat(np.arange(t.num_rows), np.diff(lists.offsets.to_numpy()))
        points, weights = lists.flatten().to_numpy(), t["weights"].combine_chunks().flatten().to_numpy()
        order = np.lexsort((points, code[run]))
        run, points, weights = run[order], points[order], weights[order]
        group = code[run]
        new = np.append(True, (group[1:] != group[:-1]) | (points[1:] != points[:-1])) if len(points) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        firsts = np.flatnonzero(np.append(True, group[at][1:] != group[at][:-1])) if len(at) else at
        offsets = pa.array(np.append(firsts, len(at)).astype(np.int32))
        out = t.select(keys).take(pa.array(run[at[firsts]]))
        for name, v in (("points", points[at]), ("weights", np.add.reduceat(weights, at) if len(at) else weights)):
            out = out.append_column(name, pa.ListArray.from_arrays(offsets, pa.array(v)))
        return out.combine_chunks().to_batches(max_chunksize=2_000)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in it:
            if b.num_rows:
                held.append(b)
                n += len(b["points"].flatten())
            if n >= GATHER:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return run


def combine(summary: DataFrame, keys: list[str]) -> DataFrame:
    """A summary by fewer keys (those of blocks or days left out), with the runs that a task holds of
    a key made one. Selection gives the same from either; it looks at fewer runs."""
    types = ", ".join(f"`{k}` {summary.schema[k].dataType.simpleString()}" for k in keys)
    return summary.select(*keys, "points", "weights").mapInArrow(_combined(keys), f"{types}, points array<long>, weights array<long>")


#: Proposals or counts of (group, percentile) that a task holds before it passes them on.
HELD = 100_000


def _weighted_median(proposals: list[tuple[int, int]]) -> tuple[int, int]:
    values, weights = (np.array(x, np.int64) for x in zip(*proposals, strict=True))
    order = np.argsort(values, kind="stable")
    sums = np.cumsum(weights[order])
    return int(values[order][np.searchsorted(sums, (sums[-1] + 1) // 2)]), int(sums[-1])


def _scan(mode: str):
    """Of a task's runs, for each percentile asked of their group: the weighted median of the medians
    they propose and its weight, or the sums of their weights and numbers of points below and above
    the pivot. So a group has one row a task, however many runs it has. In mode gather: the points in range."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        names, types = None, None

        def flush():
            found = [(k, q, *(_weighted_median(v) if mode == "propose" else v)) for (k, q), v in held.items()]
            held.clear()
            columns = [pa.array([k[i] for k, *_ in found], t) for i, t in enumerate(types)]
            columns.append(pa.array([f[1] for f in found], pa.float64()))
            for j in range(4):
                columns.append(pa.array([int(f[2 + j]) if len(f) > 2 + j else 0 for f in found], pa.int64()))
            return pa.RecordBatch.from_arrays(columns, [*names, "q", "one", "two", "three", "four"])

        for b in it:
            if not b.num_rows:
                continue
            names = b.column_names[: b.column_names.index("points")]
            types = [b[k].type for k in names]
            offsets, points, weights = b["points"].offsets.to_numpy(), b["points"].values.to_numpy(), b["weights"].values.to_numpy()
            asks = b["asks"]
            at, ask = asks.offsets.to_numpy(), asks.values
            q = ask.field("q").to_numpy()
            low, high, pivot = (ask.field(c).fill_null(0).to_numpy() for c in ("low", "high", "pivot"))
            has_low, has_high = (ask.field(c).is_valid().to_numpy(zero_copy_only=False) for c in ("low", "high"))
            key = list(zip(*(b[k].to_pylist() for k in names), strict=True)) or [()] * b.num_rows
            gathered = []
            for i in range(b.num_rows):
                p, w = points[offsets[i] : offsets[i + 1]], weights[offsets[i] : offsets[i + 1]]
                for k in range(at[i], at[i + 1]):
                    lo = np.searchsorted(p, low[k], "right") if has_low[k] else 0
                    hi = np.searchsorted(p, high[k], "left") if has_high[k] else len(p)
                    if lo >= hi:
                        continue
                    if mode == "gather":
                        gathered.append((i, k, offsets[i] + lo, offsets[i] + hi))
                    elif mode == "propose":
                        sums = np.cumsum(w[lo:hi])
                        held.setdefault((key[i], q[k]), []).append((p[lo + np.searchsorted(sums, (sums[-1] + 1) // 2)], sums[-1]))
                    else:
                        x, z = lo + np.searchsorted(p[lo:hi], pivot[k], "left"), lo + np.searchsorted(p[lo:hi], pivot[k], "right")
                        sums = held.setdefault((key[i], q[k]), [0, 0, 0, 0])
                        for j, v in enumerate((w[lo:x].sum(), w[x:z].sum(), x - lo, hi - z)):
                            sums[j] += int(v)
            if gathered:
                i, k, lo, hi = (np.array(x, np.int64) for x in zip(*gathered, strict=True))
                n = hi - lo
                index = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                t = pa.Table.from_batches([b.select(names)]).take(pa.array(np.repeat(i, n)))
                zeros = np.zeros(len(index), np.int64)
                for name, v in (("q", q[np.repeat(k, n)]), ("one", points[index]), ("two", weights[index]), ("three", zeros), ("four", zeros)):
                    t = t.append_column(name, pa.array(v))
                yield from t.combine_chunks().to_batches()
            if len(held) > HELD:
                yield flush()
        if held:
            yield flush()

    return run


def _compact(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs without the points that are out of every range asked of their group."""
    for b in it:
        if not b.num_rows:
            continue
        keys = b.column_names[: b.column_names.index("points")]
        offsets, points, weights = b["points"].offsets.to_numpy(), b["points"].values.to_numpy(), b["weights"].values.to_numpy()
        at, ask = b["asks"].offsets.to_numpy(), b["asks"].values
        low, high = (ask.field(c).fill_null(0).to_numpy() for c in ("low", "high"))
        has_low, has_high = (ask.field(c).is_valid().to_numpy(zero_copy_only=False) for c in ("low", "high"))
        keep = np.zeros(len(points), bool)
        for i in range(b.num_rows):
            p, base = points[offsets[i] : offsets[i + 1]], offsets[i]
            for k in range(at[i], at[i + 1]):
                lo = np.searchsorted(p, low[k], "right") if has_low[k] else 0
                hi = np.searchsorted(p, high[k], "left") if has_high[k] else len(p)
                keep[base + lo : base + max(lo, hi)] = True
        left = np.append(0, np.cumsum(keep))[offsets].astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(left - left[0]), pa.array(v[offsets[0] : offsets[-1]][keep[offsets[0] : offsets[-1]]])) for v in (points, weights)]
        t = pa.Table.from_batches([b.select(keys)]).append_column("points", lists[0]).append_column("weights", lists[1])
        yield from t.filter(pa.array(np.diff(left) > 0)).combine_chunks().to_batches()


def _asked(active: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """The percentiles still sought, one row a group; written, so that the size is known."""
    pivot = F.col("pivot") if "pivot" in active.columns else F.lit(None).cast("bigint")
    asks = F.collect_list(F.struct("q", "low", "high", pivot.alias("pivot"))).alias("asks")
    return scratch.write(active.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(asks))


def _matched(runs: DataFrame, ask: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """Runs beside what is asked of their group: a broadcast where that is below Spark's threshold
    by the size of its file, else a sort."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = runs.join(ask, cond).select(*keys, "points", "weights", "asks")
    types = ", ".join(f"`{k}` {runs.schema[k].dataType.simpleString()}" for k in keys)
    if mode == "compact":
        return joined.mapInArrow(_compact, f"{types}, points array<long>, weights array<long>")
    return joined.mapInArrow(_scan(mode), f"{types}, q double, one long, two long, three long, four long")


def _at_rank(pairs: Column, rank: Column) -> Column:
    """Of sorted (value, weight) pairs, the value whose weights first exceed `rank`."""
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("bigint").alias("value"))
    step = lambda acc, x: F.struct(
        (acc["sum"] + x["two"]).alias("sum"), F.when(acc["value"].isNull() & (acc["sum"] + x["two"] > rank), x["one"]).otherwise(acc["value"]).alias("value")
    )
    return F.aggregate(pairs, start, step)["value"]


def select(summary: DataFrame, keys: list[str], quantiles: list[float]) -> DataFrame:
    """(keys, q, n, value): per group and quantile the value of rank ceil(q * n) (1 at least).

    `n` counts the values behind the summary. Groups may be as many as there are values; a group
    of any size takes part as runs spread over all tasks.
    """
    scratch = Scratch(summary.sparkSession, "percentiles")
    runs = scratch.write(summary)
    weight = F.aggregate("weights", F.lit(0).cast("bigint"), lambda a, x: a + x)
    totals = runs.groupBy(*keys).agg(F.sum(weight).alias("n"), F.sum(F.size("points")).cast("bigint").alias("left"))
    q = F.explode(F.array(*(F.lit(float(x)) for x in quantiles)))
    none = F.lit(None).cast("bigint")
    active = totals.withColumn("q", q).select(
        *keys, "q", "n", (F.greatest(F.ceil(F.round(F.col("q") * F.col("n"), 6)), F.lit(1)) - 1).cast("bigint").alias("rank"),
        none.alias("low"), none.alias("high"), "left", none.alias("value"),
    )
    active = scratch.write(active)
    by = [*keys, "q"]
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]

    def matching(a, b, how="inner"):
        cond = F.lit(True)
        for c in same("a", "b"):
            cond = cond & c
        return a.alias("a").join(b.alias("b"), cond, how)

    stored = None
    while True:
        ranges = active.filter("value is null").groupBy(*keys, "low", "high").agg(F.max("left").alias("left"))
        seen = ranges.agg(F.count_if(F.col("left") > FINISH).alias("big"), F.coalesce(F.sum("left"), F.lit(0)).alias("left")).first()
        if not seen["big"]:
            break
        if stored is None or seen["left"] < stored / 2:
            if stored is not None:
                smaller = scratch.write(_matched(runs, _asked(active.filter("value is null"), keys, scratch), keys, "compact"))
                scratch.drop(runs)
                runs = smaller
            stored = seen["left"]
        big = active.filter(f"value is null and left > {FINISH}")
        ask = _asked(big, keys, scratch)
        proposals = _matched(runs, ask, keys, "propose").groupBy(*by).agg(
            F.sort_array(F.collect_list(F.struct("one", "two"))).alias("pairs"), F.sum("two").alias("weight")
        )
        pivots = proposals.select(*by, _at_rank(F.col("pairs"), F.floor((F.col("weight") - 1) / 2)).alias("pivot"))
        asked = scratch.write(matching(big, pivots).select("a.*", "b.pivot"))
        against = _asked(asked, keys, scratch)
        counts = _matched(runs, against, keys, "count").groupBy(*by).agg(
            F.sum("one").alias("less"), F.sum("two").alias("equal"), F.sum("three").alias("points_less"), F.sum("four").alias("points_more")
        )
        r, less, equal, pivot = F.col("a.rank"), F.col("b.less"), F.col("b.equal"), F.col("a.pivot")
        below, hit = r < less, (r >= less) & (r < less + equal)
        narrowed = matching(asked, counts).select(
            *(F.col(f"a.{c}").alias(c) for c in by), "a.n", F.when(below, r).otherwise(r - less - equal).alias("rank"),
            F.when(below, F.col("a.low")).otherwise(pivot).alias("low"), F.when(below, pivot).otherwise(F.col("a.high")).alias("high"),
            F.when(below, F.col("b.points_less")).otherwise(F.col("b.points_more")).alias("left"), F.when(hit, pivot).alias("value"),
        )
        following = scratch.write(narrowed.unionByName(active.filter(f"value is not null or left <= {FINISH}")))
        scratch.drop(ask, asked, against, active)
        active = following
    few = active.filter("value is null")
    gathered = _matched(runs, _asked(few, keys, scratch), keys, "gather").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("one", "two"))).alias("pairs"))
    last = matching(few, gathered).select(*(F.col(f"a.{c}").alias(c) for c in by), "a.n", _at_rank(F.col("b.pairs"), F.col("a.rank")).alias("value"))
    return active.filter("value is not null").select(*by, "n", "value").unionByName(last)


def trace_lengths(spark, d: str, *more: str) -> DataFrame:
    """(generator, ..., length) of the transactions that have an interval, each once."""
    tx = one_per_id(table(spark, d, "trace_transactions"), "id", "generator", "begin_tick", "end_tick", *more)
    return tx.filter(has_interval()).select("generator", *more, (F.col("end_tick") - F.col("begin_tick")).alias("length"))
