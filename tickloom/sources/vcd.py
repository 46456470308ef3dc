"""Value change dumps: reading into canonical tables and writing them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import bits
from tickloom.session import Scratch
from tickloom.sources.lines import ordered_lines, raw_lines

# Units as powers of ten, and the kinds of variables and scopes that are accepted.
UNITS = {"s": 0, "ms": -3, "us": -6, "ns": -9, "ps": -12, "fs": -15}
VARIABLES = [
    "event", "integer", "parameter", "real", "reg", "supply0", "supply1", "time", "tri", "triand", "trior", "trireg", "tri0", "tri1", "wand", "wire", "wor", "string",
]
SCOPES = ["module", "task", "function", "begin", "fork"]
#: First characters of values whose identifier is a token of its own.
LONG_VALUES = ["b", "B", "r", "R", "s", "S"]


@dataclass
class Header:
    exponent: int
    version: str | None
    date: str | None
    nodes: list[tuple]
    signals: dict[str, tuple[int, str, int, bool]]


def parse_header(text: str) -> Header:
    """Declarations up to $enddefinitions: nodes (node_id, parent_id, node_kind, name, signal_id,
    var_type) and signals by identifier code as (signal_id, encoding, width, is_event). A repeated
    code is an alias and must agree in kind, width and event-ness. Errors raise ValueError."""
    head = Header(-9, None, None, [], {})
    stack: list[int] = []
    for word, body in re.findall(r"\$(\w+)\s*(.*?)\s*\$end(?=\s|$)", text, re.DOTALL):
        parent = stack[-1] if stack else None
        if word == "timescale":
            m = re.fullmatch(r"(\d+)\s*(\w+)", body)
            if not m or m[1] not in ("1", "10", "100") or m[2] not in UNITS:
                raise ValueError(f"timescale {body!r} must be 1, 10 or 100 of a unit")
            head.exponent = UNITS[m[2]] + len(m[1]) - 1
        elif word == "version":
            head.version = body
        elif word == "date":
            head.date = body
        elif word == "scope":
            kind, name = body.split(None, 1)
            if kind not in SCOPES:
                raise ValueError(f"unsupported scope type {kind}")
            head.nodes.append((len(head.nodes), parent, "scope", name, None, kind))
            stack.append(len(head.nodes) - 1)
        elif word == "upscope":
            if not stack:
                raise ValueError("upscope without a scope")
            stack.pop()
        elif word == "var":
            parts = body.split(None, 4)
            if len(parts) < 4 or parts[0] not in VARIABLES:
                raise ValueError(f"unsupported variable {body!r}")
            kind, width, code, name = parts[0], int(parts[1]), parts[2], " ".join(parts[3:])
            encoding = {"real": "real", "string": "bytes"}.get(kind, "bits")
            if encoding == "bits" and (width < 1 or kind == "event" and width != 1):
                raise ValueError(f"variable {name} can't have width {width}")
            width = width if encoding == "bits" else 0
            known = head.signals.get(code)
            if known is None:
                known = head.signals[code] = (len(head.signals), encoding, width, kind == "event")
            elif known[1:] != (encoding, width, kind == "event"):
                raise ValueError(f"alias {name!r} has an incompatible type or width")
            head.nodes.append((len(head.nodes), parent, "variable", name, known[0], kind))
        elif word not in ("comment", "enddefinitions"):
            raise ValueError(f"unsupported declaration ${word}")
    return head


class Recording:
    """Canonical tables of one VCD file."""

    def __init__(self, header: Header, nodes: DataFrame, signals: DataFrame, changes: DataFrame, time_steps: DataFrame, blackouts: DataFrame):
        self.header, self.nodes, self.signals, self.changes, self.time_steps, self.blackouts = header, nodes, signals, changes, time_steps, blackouts


_PARSED = "file string, split long, kind int, seq long, time long, value string, code string"
#: Kinds of parsed rows: entries, the state that a split ends in, and faults.
ENTRY, END, FAULT = 0, 1, 2
#: The state of a split that ends within a comment.
COMMENT = "$comment"


class _Split:
    """Parses the lines of one split. A split may begin with a value whose identifier is still to
    come, or within a comment: `state` is what the split before it left."""

    def __init__(self, file: str, split: int, state: str | None, edge: tuple[int, int]):
        self.file, self.split, self.edge = file, split, edge
        self.held, self.comment = (None, True) if state == COMMENT else (state, False)
        self.lines = self.tokens = 0
        self.first = self.time = None

    def rows(self, kind: int, seq, time, value: pa.Array, code: pa.Array) -> pa.RecordBatch:
        n = len(value)
        fixed = [pa.array([self.file] * n, pa.string()), pa.array(np.full(n, self.split)), pa.array(np.full(n, kind, np.int32))]
        return pa.RecordBatch.from_arrays([*fixed, pa.array(seq, pa.int64()), pa.array(time, pa.int64()), value, code], [c.split()[0] for c in _PARSED.split(", ")])

    def fault(self, why: str) -> pa.RecordBatch:
        return self.rows(FAULT, [None], [None], pa.array([why]), pa.array([None], pa.string()))

    def end(self) -> pa.RecordBatch:
        """The state left, with the first time of the split as `seq` and the last one as `time`."""
        return self.rows(END, [self.first], [self.time], pa.array([COMMENT if self.comment else self.held], pa.string()), pa.array([None], pa.string()))

    def feed(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        begin, self.lines = self.lines, self.lines + len(lines)
        at = self.edge[1] - begin
        if self.split < self.edge[0] or self.split == self.edge[0] and at >= len(lines):
            return  # declarations
        if self.split == self.edge[0] and at >= 0:
            rest = lines[at].as_py().partition("$enddefinitions")[2]
            self.comment = True  # up to $end
            lines = pa.concat_arrays([pa.array([rest], lines.type), lines.slice(at + 1)])
        tokens = pc.list_flatten(pc.ascii_split_whitespace(lines))
        tokens = tokens.filter(pc.not_equal(tokens, ""))
        index = self.tokens + np.arange(len(tokens))
        self.tokens += len(tokens)
        words = pc.index_in(tokens, pa.array(["$end", COMMENT])).fill_null(2).to_numpy()
        if self.comment or (words == 1).any():
            keep = self._outside(words)
            tokens, index = tokens.filter(pa.array(keep)), index[keep]
        if self.held is not None and len(tokens):
            tokens, index = pa.concat_arrays([pa.array([self.held], tokens.type), tokens]), np.append(self.tokens - len(index) - 1, index)
        if len(tokens):
            yield from self._entries(tokens, index)

    def _outside(self, words: np.ndarray) -> np.ndarray:
        """Tokens outside comments, whose marks go too."""
        keep, at = np.ones(len(words), bool), 0
        ends, starts = np.flatnonzero(words == 0), np.flatnonzero(words == 1)
        while True:
            if self.comment:
                k = np.searchsorted(ends, at)
                close = ends[k] if k < len(ends) else len(words) - 1
                keep[at : close + 1] = False
                self.comment, at = k == len(ends), close + 1
            k = np.searchsorted(starts, at)
            if self.comment or k == len(starts):
                return keep
            self.comment, at = True, starts[k]

    def _entries(self, tokens: pa.Array, index: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(tokens)
        first = pc.utf8_slice_codeunits(tokens, 0, 1)
        long = pc.is_in(first, value_set=pa.array(LONG_VALUES)).to_numpy(zero_copy_only=False)
        place = np.arange(n)
        # in a run of tokens that look like values, every other one is an identifier
        run = place - np.maximum.accumulate(np.where(long, -1, place)) - 1
        value = long & (run % 2 == 0)
        taken = np.append(False, value[:-1])
        self.held = tokens[n - 1].as_py() if value[-1] else None
        mark = pc.is_in(first, value_set=pa.array(["#", "$"])).to_numpy(zero_copy_only=False)
        free = ~long & ~taken
        pairs, alone, glued = np.flatnonzero(value[:-1]), np.flatnonzero(free & mark), np.flatnonzero(free & ~mark)
        ticks = np.flatnonzero(free & pc.equal(first, "#").to_numpy(zero_copy_only=False))
        times = self._times(tokens.take(pa.array(ticks)))
        known = [t for t in times if t is not None]
        if len(known) < len(times):
            yield self.fault("time ?")
        back = [b for a, b in zip([self.time, *known], known, strict=False) if a is not None and b < a]
        if back:
            yield self.fault(f"time {back[0]}")
        every = np.concatenate([pairs, alone, glued])
        k = np.searchsorted(ticks, every, "right")
        time = pa.array([self.time, *times], pa.int64()).take(pa.array(k))
        at = lambda array, i: array.take(pa.array(i))
        values = pa.concat_arrays([at(tokens, pairs), at(tokens, alone), at(first, glued)])
        codes = pa.concat_arrays([at(tokens, pairs + 1), pa.nulls(len(alone), tokens.type), pc.utf8_slice_codeunits(at(tokens, glued), 1)])
        if known:
            self.first = known[0] if self.first is None else self.first
            self.time = known[-1]
        yield self.rows(ENTRY, self.split + index[every], time, values, codes)

    @staticmethod
    def _times(marks: pa.Array) -> list[int | None]:
        digits = pc.utf8_slice_codeunits(marks, 1)
        try:
            return pc.cast(digits, pa.int64()).to_pylist()
        except pa.ArrowInvalid:
            return [int(x) if re.fullmatch(r"[0-9]{1,19}", x) and int(x) < 1 << 63 else None for x in digits.to_pylist()]


def _parse(edge: tuple[int, int], states: dict[tuple[str, int], str]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Split | None = None
        for b in it:
            if not b.num_rows:
                continue
            files, splits, lines = b["file"].dictionary_encode(), b["split"].to_numpy(), b["value"]
            code = files.indices.to_numpy()
            cuts = np.flatnonzero((code[1:] != code[:-1]) | (splits[1:] != splits[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                key = files.dictionary[code[i]].as_py(), int(splits[i])
                if now is None or (now.file, now.split) != key:
                    if now is not None:
                        yield now.end()
                    now = _Split(*key, states.get(key), edge)
                yield from now.feed(lines.slice(i, j - i))
        if now is not None:
            yield now.end()

    return run


def _parsed(raw: DataFrame, edge: tuple[int, int], scratch: Scratch) -> tuple[DataFrame, list]:
    """Parsed rows, written, and the ends of the splits (one row each) in order. Splits are parsed on
    their own; where one leaves a value or comment open, they are parsed again from the states
    found, until these stay as they are (mostly no split needs that)."""
    states: dict[tuple[str, int], str] = {}
    while True:
        rows = scratch.write(raw.mapInArrow(_parse(edge, states), _PARSED))
        ends = rows.filter(F.col("kind") == END).orderBy("file", "split").collect()
        found = {(b["file"], b["split"]): a["value"] for a, b in zip(ends, ends[1:], strict=False) if a["file"] == b["file"] and a["value"] is not None}
        if found == states:
            return rows, ends
        scratch.drop(rows)
        states = found


def read_vcd(spark: SparkSession, path: str, check: bool = True) -> Recording:
    """Read a VCD file (or .vcd.gz). Declarations (as many rows as variables) pass the driver;
    the body stays distributed: tokens are parsed where they are read, line breaks mean nothing,
    and what comes before a split's first time has the last time of the splits before it.

    With `check`, times that go back, undeclared identifiers, values wider than declared or of
    the wrong kind and unfinished values raise ValueError; otherwise such entries are dropped.
    `seq` grows with the place in the file.
    """
    scratch = Scratch(spark, "vcd")
    lines = ordered_lines(spark, path)
    edge = lines.filter(F.col("value").contains("$enddefinitions")).agg(F.min(F.struct("pos", "split", "at")).alias("e")).first()["e"]
    if edge is None:
        raise ValueError("no $enddefinitions")
    head_rows = lines.filter(F.col("pos") <= edge["pos"]).orderBy("pos").select("value").collect()
    header = parse_header("\n".join(r["value"] for r in head_rows).partition("$enddefinitions")[0])
    nodes = spark.createDataFrame(header.nodes, "node_id long, parent_id long, node_kind string, name string, signal_id long, var_type string")
    table = [(c, *s) for c, s in header.signals.items()]
    signals = spark.createDataFrame(table, "code string, signal_id long, encoding string, width int, is_event boolean")
    rows, ends = _parsed(raw_lines(spark, path), (edge["split"], edge["at"]), scratch)
    before, faults, file = [], [], None
    for e in ends:
        if e["file"] != file:
            file, time = e["file"], None
        before.append((file, e["split"], 0 if time is None else time))
        if time is not None and e["seq"] is not None and e["seq"] < time:
            faults.append(f"time {e['seq']}")
        time = time if e["time"] is None else e["time"]
    if ends and ends[-1]["value"] is not None:
        faults.append(f"unfinished {ends[-1]['value'][:40]}")
    entries = rows.filter(F.col("kind") == ENTRY).select("file", "split", "seq", "time", "value", "code")
    carried = spark.createDataFrame(before, "file string, split long, before long")
    late = entries.filter("time is null").join(carried, ["file", "split"]).withColumn("time", F.col("before")).drop("before")
    timed = entries.filter("time is not null").unionByName(late)
    values = timed.filter("code is not null").join(signals, "code", "left")
    kind = F.lower(F.substring("value", 1, 1))
    rest = F.expr("substring(value, 2)")
    digits = F.when(kind == "b", rest).otherwise(F.col("value"))
    scalar = (F.length("value") == 1) & ~kind.isin("b", "r", "s")
    fits = (
        F.when(F.col("encoding") == "bits", F.when(scalar, F.col("width") == 1).otherwise((kind == "b") & F.length(digits).between(1, F.col("width"))))
        .when(F.col("encoding") == "real", kind == "r").otherwise(kind == "s")
    )
    legal = F.when(F.col("encoding") == "bits", F.lower(digits).rlike("^[01xz]+$")).otherwise(True)
    good = F.coalesce(fits & legal, F.lit(False))
    if check:
        bad = values.filter(~good).select(F.concat_ws(" ", F.lit("bad value"), F.substring("value", 1, 40), "code").alias("why"))
        commands = timed.filter("code is null and value like '$%'").agg(F.count_if(F.col("value") == "$end").alias("ends"), F.count(F.lit(1)).alias("n"))
        bad = bad.unionByName(rows.filter(F.col("kind") == FAULT).select(F.col("value").alias("why"))).unionByName(commands.filter("ends * 2 <> n").select(F.lit("unfinished command").alias("why")))
        faults += [r["why"] for r in bad.limit(1).collect()]
        if faults:
            raise ValueError(faults[0])
    changes = values.filter(good).select(
        "signal_id", "time", "seq",
        F.when(F.col("encoding") == "bits", bits.pack_ascii(digits, F.col("width"))).when(F.col("encoding") == "bytes", rest).alias("text"),
        F.when(F.col("encoding") == "real", F.expr("try_cast(substring(value, 2) as double)")).alias("real"),
    )
    steps = timed.filter("code is null and value like '#%' and time is not null").select("time").distinct()
    blackouts = timed.filter("code is null and value in ('$dumpoff', '$dumpon')").select("seq", "time", (F.col("value") == "$dumpon").alias("active"))
    return Recording(header, nodes, signals.drop("code"), changes, steps, blackouts)


def header_text(nodes: list[tuple], signals: dict[int, tuple[str, int, bool]], exponent: int, names: dict[int, str]) -> str:
    """The declarations of a VCD file; see `write_vcd` for what is refused."""
    units = [(0, "s"), (-3, "ms"), (-6, "us"), (-9, "ns"), (-12, "ps"), (-15, "fs")]
    if not -15 <= exponent <= 2:
        raise ValueError("a timescale must be between 1 fs and 100 s")
    base, unit = next(u for u in units if exponent >= u[0])
    out = ["$version tickloom $end", f"$timescale {10 ** (exponent - base)}{unit} $end"]
    below: dict = {}
    for n in nodes:
        below.setdefault(n[1], []).append(n)
    stack = [iter(below.get(None, []))]
    while stack:
        n = next(stack[-1], None)
        if n is None:
            stack.pop()
            if stack:
                out.append("$upscope $end")
            continue
        node_id, _, node_kind, name, signal, var_type = n
        parts = name.split()
        if "$end" in name or not parts or len(parts) > 2 or len(parts) == 2 and (node_kind == "scope" or not re.fullmatch(r"\[.*\]", parts[1])):
            raise ValueError(f"name {name!r} can't be written")
        if node_kind == "scope":
            out.append(f"$scope {var_type or 'module'} {name} $end")
            stack.append(iter(below.get(node_id, [])))
        else:
            encoding, width, event = signals[signal]
            if encoding == "bytes":
                raise ValueError("byte signals can't be written")
            word, size = ("real", 64) if encoding == "real" else ("event" if event else "wire", width)
            out.append(f"$var {word} {size} {names[signal]} {name} $end")
    return "\n".join([*out, "$enddefinitions $end"])


def write_vcd(recording: Recording, path: str) -> None:
    """Write one VCD text file (a directory with one part, as Spark writes text). Lines are
    sorted across the cluster, then written by one task, since the format is one stream.

    Refused: blackouts, byte signals, timescales outside 1 fs .. 100 s and names with blanks
    other than an index. An existing path is an error.
    """
    spark = recording.changes.sparkSession
    if recording.blackouts.limit(1).count():
        raise ValueError("blackouts can't be written")
    signals = {r["signal_id"]: (r["encoding"], r["width"], r["is_event"]) for r in recording.signals.dropDuplicates(["signal_id"]).collect()}
    codes = spark.createDataFrame([(s,) for s in sorted(signals)], "signal_id long").select("signal_id", bits.vcd_id("signal_id").alias("code"))
    names = {r["signal_id"]: r["code"] for r in codes.collect()}
    nodes = [tuple(r) for r in recording.nodes.orderBy("node_id").select("node_id", "parent_id", "node_kind", "name", "signal_id", "var_type").collect()]
    head = header_text(nodes, signals, recording.header.exponent, names)
    width = F.length("text")
    shown = F.when(F.col("real").isNotNull(), F.concat(F.lit("r"), F.col("real").cast("string"), F.lit(" "))).when(width == 1, F.col("text")).otherwise(F.concat(F.lit("b"), "text", F.lit(" ")))
    body = recording.changes.join(codes, "signal_id").select("time", F.lit(1).alias("k"), "signal_id", "seq", F.concat(shown, "code").alias("value"))
    ticks = recording.changes.select("time").distinct()
    last = recording.time_steps.agg(F.max("time").alias("time")).filter("time is not null")
    marks = ticks.union(last).distinct().select("time", F.lit(0).alias("k"), F.lit(-1).cast("bigint").alias("signal_id"), F.lit(0).cast("bigint").alias("seq"), F.concat(F.lit("#"), F.col("time").cast("string")).alias("value"))
    top = spark.createDataFrame([(-1, -1, -1, 0, head)], "time long, k int, signal_id long, seq long, value string")
    rows = top.unionByName(marks).unionByName(body).orderBy("time", "k", "signal_id", "seq").select("value")
    rows.coalesce(1).write.mode("errorifexists").text(path)
