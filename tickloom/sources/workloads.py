"""Synthetic traces whose every value and total is given in closed form, for benches and as goldens.

The profiles have the numbers of signals, generators and ticks of the published suite in
takes a new value every `period(s)` ticks, a generator begins three transactions every 14 ticks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Widths and periods of the signals in turn.
WIDTHS = (1, 1, 8, 16, 32, 32, 48, 63)
PERIODS = (2, 8, 4, 16, 4, 8, 4, 8)
#: Signals, generators, ticks, and whether all is quiet but for OPEN of every CYCLE ticks.
PROFILES = {
    "core": (64, 0, 480_000, False),
    "soc": (4096, 0, 24_000, False),
    "idle": (4096, 0, 48_000, True),
    "requests": (0, 8, 120_000, False),
    "many-generators": (0, 64, 24_000, False),
    "mixed": (256, 16, 24_000, False),
}
CYCLE, OPEN = 1024, 64
#: Of every 14 ticks, those at which generator 0 begins a transaction; generator g is 3 g ticks ahead.
STARTS = np.array([0, 5, 9])
#: Probes of each kind of query; every fourth asks for a value that nothing has.
PROBES = 12


@dataclass(frozen=True)
class Profile:
    name: str
    signals: int
    generators: int
    ticks: int
    gated: bool

    @property
    def observations(self) -> int:
        """Changes and transactions."""
        steps = self.ticks // CYCLE * OPEN + min(self.ticks % CYCLE, OPEN) if self.gated else self.ticks
        changes = sum(-(-steps // PERIODS[s % 8]) for s in range(self.signals))
        return changes + sum(int(_begun(g, np.array([self.ticks]))[0]) for g in range(self.generators))


def profile(name: str) -> Profile:
    return Profile(name, *PROFILES[name])


def _step(tick: np.ndarray, gated: bool) -> np.ndarray:
    """Open ticks before a tick."""
    return tick // CYCLE * OPEN + np.minimum(tick % CYCLE, OPEN - 1) if gated else tick


def value_of(signal: int, tick: np.ndarray, gated: bool = False) -> np.ndarray:
    """Values of a signal: an odd multiple of the number of its periods so far, cut to its width, so
    that each period has another value than the one before."""
    k = _step(np.asarray(tick, np.int64), gated) // PERIODS[signal % 8]
    return k * (2 * signal + 1) & ((1 << WIDTHS[signal % 8]) - 1)


def _ticks(it: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in it:
        if b.num_rows:
            yield b.column(0).to_numpy()


def changes(spark: SparkSession, p: Profile, parts: int | None = None) -> DataFrame:
    """(signal_id, time, value) of every change."""

    def run(it):
        for tick in _ticks(it):
            if p.gated:
                tick = tick[tick % CYCLE < OPEN]
            step = _step(tick, p.gated)
            for s in range(p.signals):
                at = tick[step % PERIODS[s % 8] == 0]
                if len(at):
                    columns = [pa.array(np.full(len(at), s, np.int32)), pa.array(at), pa.array(value_of(s, at, p.gated))]
                    yield pa.RecordBatch.from_arrays(columns, ["signal_id", "time", "value"])

    return spark.range(0, p.ticks, 1, parts or spark.sparkContext.defaultParallelism).mapInArrow(run, "signal_id int, time long, value long")


def _begun(g: int, tick: np.ndarray) -> np.ndarray:
    """Transactions that a generator begins before a tick."""
    upto = lambda x: x // 14 * 3 + np.searchsorted(STARTS, x % 14)
    return upto(tick + 3 * g) - upto(np.array([3 * g]))


def transactions(spark: SparkSession, p: Profile, parts: int | None = None) -> DataFrame:
    """(serial, generator, begin, end, attrs) of every transaction; serials follow (generator, begin)."""
    before = np.append(0, np.cumsum([_begun(g, np.array([p.ticks]))[0] for g in range(p.generators)]))

    def run(it):
        for tick in _ticks(it):
            for g in range(p.generators):
                t = tick[np.isin((tick + 3 * g) % 14, STARTS)]
                if not len(t):
                    continue
                s = before[g] + _begun(g, t)
                attrs = np.stack([s, address_of(s), 1 << (2 + s % 5), s % 6, (s % 101 == 0).astype(np.int64)], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 5 * len(t) + 1, 5, dtype=np.int32)), pa.array(attrs.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s), pa.array(np.full(len(t), g, np.int32)), pa.array(t), pa.array(t + 3 + s * 7919 % 61), lists], ["serial", "generator", "begin", "end", "attrs"]
                )

    return spark.range(0, p.ticks, 1, parts or spark.sparkContext.defaultParallelism).mapInArrow(run, "serial long, generator int, begin long, end long, attrs array<long>")


def address_of(serial):
    return serial * 40503 % 1024 * 16


def probes(spark: SparkSession, p: Profile, of_transactions: bool, whole: bool) -> DataFrame:
    """(probe, source, first, last, wanted) of the deterministic probes; `wanted` NULL has no match."""
    sources, rows = (p.generators if of_transactions else p.signals), []
    for i in range(PROBES):
        source, first = (i * 37 + 5) % sources, (2 * i + 1) * p.ticks // (2 * PROBES + 2)
        wanted = address_of(i * 977) if of_transactions else int(value_of(source, np.array([first]), p.gated)[0])
        window = (0, 2**62) if whole else (first, min(p.ticks - 1, first + 128))
        rows.append((i, source, *window, None if i % 4 == 3 else wanted, first))
    return spark.createDataFrame(rows, "probe int, source int, first long, last long, wanted long, at long")


def find_changes(table: DataFrame, asked: DataFrame) -> DataFrame:
    """(probe, n): changes of a probe's signal with its value in its window; all probes in one scan."""
    hit = (F.col("signal_id") == F.col("source")) & (F.col("value") == F.col("wanted")) & F.col("time").between(F.col("first"), F.col("last"))
    return table.join(F.broadcast(asked), hit).groupBy("probe").agg(F.count(F.lit(1)).alias("n"))  # 12 probes


def find_transactions(table: DataFrame, asked: DataFrame) -> DataFrame:
    hit = (F.col("generator") == F.col("source")) & (F.get("attrs", F.lit(1)) == F.col("wanted")) & (F.col("begin") <= F.col("last")) & (F.col("end") >= F.col("first"))
    return table.join(F.broadcast(asked), hit).groupBy("probe").agg(F.count(F.lit(1)).alias("n"))


def points(table: DataFrame, asked: DataFrame) -> DataFrame:
    """(probe, value): the value of each probe's signal at its tick."""
    hit = (F.col("signal_id") == F.col("source")) & (F.col("time") <= F.col("at"))
    return table.join(F.broadcast(asked), hit).groupBy("probe").agg(F.max_by("value", "time").alias("value"))


def digest(table: DataFrame) -> DataFrame:
    """Count, sum and xor over all rows, whatever their order."""
    h = F.xxhash64(*table.columns)
    return table.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("mixed"), F.sum(F.shiftrightunsigned(h, 32)).alias("total"))
