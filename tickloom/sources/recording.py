"""Writing the binary container: blocks are encoded by the tasks that hold their rows, and the driver
only strings the finished sections together, one at a time.

`write_recording` takes the canonical tables. Declarations (strings, nodes, datatypes) are one section each
and pass the driver, as the footer of a file does; data sections are made in parallel and stand in
a written table until they are copied.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.model import SCOPE_TYPE, STATES
from tickloom.session import Scratch, started
from tickloom.sources import container as C

#: Transactions or relations of a block, records of a block, changes of a waveform block (about).
TX_ROWS, RECORD_ROWS, CHANGE_ROWS = 65_536, 262_144, 4_000_000
#: Changes of a task that encodes waveforms (about).
TASK_ROWS = 262_144
#: Signals of a group.
GROUP = 64
#: Type of payloads: a sequence of 64-bit integers, the first declared datatype.
SEQUENCE, I64 = C.FIRST_DECLARED_TYPE, 5
NONE = 0xFFFFFFFF


def varints(values) -> bytes:
    """LEB128 of unsigned 64-bit values, all at once."""
    if len(values) < 24:
        return b"".join(map(one, values.tolist() if isinstance(values, np.ndarray) else values))
    return sized_varints(values)[0].tobytes()


def sized_varints(values) -> tuple[np.ndarray, np.ndarray]:
    """Their bytes and the number of bytes of each."""
    v = np.asarray(values, np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << (7 * k))
    at = np.append(0, np.cumsum(size))
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(size.max()) if len(v) else 0):
        has = size > k
        more = np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
        out[at[:-1][has] + k] = ((v[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, size


def interleaved(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Items made of a piece of each part; a part is the bytes of its pieces and their lengths."""
    size = sum(n for _, n in parts)
    out = np.empty(int(size.sum()), np.uint8)
    at = _starts(size)
    for flat, n in parts:
        out[np.repeat(at - _starts(n), n) + np.arange(len(flat))] = flat
        at = at + n
    return out, size


def zigzag(values) -> np.ndarray:
    v = np.asarray(values, np.int64)
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def svarints(values) -> bytes:
    return varints(zigzag(values))


def deltas(values) -> np.ndarray:
    v = np.asarray(values, np.int64)
    return np.diff(v, prepend=np.int64(0))


def one(v: int) -> bytes:
    if 0 <= v < 128:
        return bytes((v,))
    C.need(0 <= v < 1 << 64, "no unsigned 64-bit value")
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


def blob(data: bytes) -> bytes:
    return one(len(data)) + data


def packed(data: bytes) -> bytes:
    """A compressed blob, by Zstandard."""
    return b"\x02" + one(len(data)) + (pa.compress(data, codec="zstd", asbytes=True) if data else b"")


def column_set(columns: list[bytes]) -> bytes:
    return one(len(columns)) + varints([len(c) for c in columns]) + b"".join(columns)


def _bounds(*columns) -> bytes:
    out = []
    for c in columns:
        v = np.asarray(c, np.int64)
        out += [int(v.min()), int(v.max())] if len(v) else [0, 0]
    return struct.pack(f"<{len(out)}Q", *out)


# --- transactions ------------------------------------------------------------------------------


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths of the lists of a column, 0 for NULL, and all their items in order."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, column.flatten()


def _whole_numbers(column: pa.Array) -> np.ndarray:
    """Numbers of a column, 0 for NULL."""
    return pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)


def _indices(column: pa.Array, strings: dict[str, int]) -> np.ndarray:
    """Numbers of the texts of a column; NULL is the empty one."""
    coded = pc.fill_null(column, "").dictionary_encode()
    return np.array([strings[w] for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(column) else np.zeros(0, np.int64)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def transaction_section(tx: pa.Table, rel: pa.Table, block: int, strings: dict[str, int]) -> bytes:
    """A TX_BLOCK of transactions in the order of their ids, each with `events` (id, time, name) and `stages`
    (id, name, lane, begin, end or None), and of relations."""
    tx, rel = ({c: t[c].combine_chunks() if t[c].num_chunks != 1 else t[c].chunk(0) for c in t.column_names} for t in (tx, rel))
    ids, begins, ends, parents, gens, status, spans = (_whole_numbers(tx[c]) for c in ("id", "begin", "end", "parent", "generator", "status", "span_kind"))
    C.need(bool((ends >= begins).all()), "end before begin")
    generators, generator_index = np.unique(gens, return_inverse=True)
    n_events, events = _lists(tx["events"])
    n_stages, stages = _lists(tx["stages"])
    event_begin, stage_begin = np.repeat(begins, n_events), np.repeat(begins, n_stages)
    event_ids, event_times, stage_ids, at = (_whole_numbers(c) for c in (events.field("id"), events.field("time"), stages.field("id"), stages.field("begin")))
    open_end = pc.is_null(stages.field("end")).to_numpy(zero_copy_only=False)
    until = _whole_numbers(stages.field("end"))
    C.need(bool((open_end | (until >= at)).all()), "end before begin")
    source, destination = (_whole_numbers(rel[c]) for c in ("source", "destination"))
    sizes, payload = _lists(tx["payload"])
    # counts stand before the values of each payload
    stream = np.zeros(len(ids) + int(sizes.sum()), np.uint64)
    counts = np.arange(len(ids)) + _starts(sizes)
    values = np.ones(len(stream), bool)
    values[counts] = False
    stream[counts] = sizes.astype(np.uint64)
    stream[values] = zigzag(_whole_numbers(payload))
    n_children, children = _lists(tx["child_blocks"])  # sorted, each once
    children = _whole_numbers(children)
    steps = deltas(children)
    first = _starts(n_children)[n_children > 0]
    steps[first] = children[first]
    columns = [
        svarints(deltas(ids)), varints(generator_index), svarints(deltas(begins)), varints(ends - begins),
        (status.astype(np.uint8) | spans.astype(np.uint8) << 4).tobytes(),
        varints(np.where(parents > 0, ids - parents, 0)), bytes(len(ids) + len(event_ids) + len(stage_ids) + len(source)), b"", b"", b"", b"", b"", b"",
        varints(n_events), svarints(event_times - event_begin), varints(_indices(events.field("name"), strings)),
        varints(n_stages), varints(_indices(stages.field("name"), strings)), varints(_indices(stages.field("lane"), strings)),
        svarints(at - stage_begin), varints(np.where(open_end, 0, until - at + 1)),
        varints(_indices(rel["kind"], strings)), svarints(deltas(source)), svarints(destination - source),
        varints(stream), b"", b"", one(0), b"",
        varints(n_children), varints(steps), svarints(deltas(event_ids)), svarints(deltas(stage_ids)),
    ]
    page = column_set(columns)
    body = packed(page)
    inside = np.append(event_ids, stage_ids)
    bounds = _bounds(ids, np.append(begins, ends), parents[parents > 0], inside, source, destination)
    # the second pair is first begin and last end
    head = struct.pack("<QQQ", block, len(ids), len(source)) + bounds + struct.pack("<II", len(generators), 1) + struct.pack(f"<{len(generators)}I", *map(int, generators))
    return head + struct.pack("<QQ", len(ids), len(source)) + bounds + struct.pack("<III", 0, len(body), len(page)) + body


# --- located records ---------------------------------------------------------------------------


def record_section(rows: pa.Table, block: int) -> bytes:
    """A RECORD_BLOCK of located records (id, kind, generator, begin, end, parent), a segment per generator."""
    C.need(not any(rows[c].null_count for c in ("id", "kind", "generator", "begin", "end")), "no value")
    rows = rows.combine_chunks()
    all_ids, all_begins, all_ends, all_parents, generators = (_whole_numbers(rows[c].chunk(0)) for c in ("id", "begin", "end", "parent", "generator"))
    coded = rows["kind"].chunk(0).dictionary_encode()
    names = sorted(coded.dictionary.to_pylist())
    kinds = np.array([names.index(k) for k in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
    segments, pages, at = [], [], 0
    for generator in np.unique(generators).tolist():
        of = np.flatnonzero(generators == generator)
        for k in np.unique(kinds[of]).tolist():
            part, kind = of[kinds[of] == k], names[k]
            ids, begins, ends, parents = (v[part] for v in (all_ids, all_begins, all_ends, all_parents))
            before = np.append(0, (ends if kind == "stage" else begins)[:-1])
            owners = varints(np.where(parents > 0, ids - parents, 0)) if kind == "log" else svarints(deltas(parents))
            columns = [svarints(begins - before), svarints(deltas(ids)), owners, varints(ends - begins) if kind == "stage" else b"", b"", b"", b"", one(0), b""]
            data = column_set(columns)
            kind_id = struct.pack("<I", 0) if kind == "log" else b""
            segments.append(struct.pack("<I", generator) + kind_id + struct.pack("<IIII", 0, len(part), at, len(data)) + _bounds(ids, parents[parents > 0], np.append(begins, ends)))
            pages.append(data)
            at += len(data)
    page = b"".join(pages)
    body = packed(page)
    head = struct.pack("<QQ", block, len(all_ids)) + _bounds(all_ids, np.append(all_begins, all_ends)) + struct.pack("<II", len(segments), 1)
    return head + b"".join(segments) + struct.pack("<III", 0, len(body), len(page)) + body


# --- waveforms ---------------------------------------------------------------------------------


_CODES = np.full(256, 255, np.uint8)
_CODES[np.frombuffer(STATES.encode(), np.uint8)] = np.arange(len(STATES), dtype=np.uint8)


def state_codes(texts: pa.Array, width: int) -> np.ndarray:
    """Codes of the states of texts of one width, a row each, the highest state first."""
    flat, size = _utf8(texts)
    codes = _CODES[flat]
    C.need(bool((size == width).all()) and not (codes == 255).any(), "value of another width or alphabet")
    return codes.reshape(len(texts), width)


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts and their lengths."""
    C.need(not texts.null_count, "no value")
    data = texts.cast(pa.large_binary())
    if not len(data):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    _, offsets, flat = data.buffers()
    ends = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1]
    return (np.frombuffer(flat, np.uint8) if flat is not None else np.zeros(0, np.uint8))[ends[0] : ends[-1]], np.diff(ends)


def pack_codes(codes: np.ndarray, states: int) -> np.ndarray:
    """The packed bytes of rows of codes."""
    bits = 1 if states == 2 else 2 if states == 4 else 4
    C.need(not codes.size or codes.max() < (2 if states == 2 else 4 if states == 4 else 9), "state of another alphabet")
    low = (codes[:, ::-1, None] >> np.arange(bits)) & 1
    return np.packbits(low.reshape(len(codes), codes.shape[1] * bits), axis=1, bitorder="little")


def _default(encoding: str, width: int, states: int) -> bytes:
    """The packed value of a signal that has none yet."""
    if encoding == "bits":
        return pack_codes(state_codes(pa.array([("0" if states == 2 else "x") * width]), width), states).tobytes()
    return struct.pack("<d", 0.0) if encoding == "real" else b"\x00"


def _pieces(flat: np.ndarray, size: np.ndarray) -> list[bytes]:
    data, ends = flat.tobytes(), np.append(0, np.cumsum(size)).tolist()
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def signal_columns(kind: tuple[str, int, int], n: np.ndarray, at: np.ndarray, values: pa.Array) -> tuple[list[bytes], list[bytes]]:
    """Columns of changes at time indices, in order, of signals of one kind that stand one after another with
    `n` changes each, at least one; and the packed last value of each signal."""
    encoding, width, states = kind
    first, last = _starts(n), np.cumsum(n) - 1
    step = np.diff(at, prepend=0)
    step[first] = at[first]
    step = step.astype(np.uint64)
    if encoding == "bits":
        codes = state_codes(values, width)
        whole = _pieces(pack_codes(codes[last], states).reshape(-1), np.full(len(n), -(-width * (1 if states == 2 else 2 if states == 4 else 4) // 8)))
        if width == 1:
            C.need(codes.max() < (2 if states == 2 else 4 if states == 4 else 9), "state of another alphabet")
            flat, size = sized_varints(step << np.uint64(5) | codes[:, 0].astype(np.uint64) << np.uint64(1) | np.uint64(1))
            return _pieces(flat, np.add.reduceat(size, first)), whole
        # values of two states only are packed as such
        plain = (codes < 2).all(axis=1)
        head, size = sized_varints(step << np.uint64(1) | plain.astype(np.uint64))
        n_plain = np.add.reduceat(plain.astype(np.int64), first)
        same, none = (n_plain == n) | (n_plain == 0), n_plain == 0
        two, many = pack_codes(codes[plain], 2), pack_codes(codes[~plain], states)
        row = np.where(plain, two.shape[1], many.shape[1])
        rows, place = np.empty(int(row.sum()), np.uint8), _starts(row)
        for mask, data in ((plain, two), (~plain, many)):
            rows[place[mask][:, None] + np.arange(data.shape[1])] = data
        flags = same.astype(np.int64) << 1 | none
    else:
        head, size = sized_varints(step)
        if encoding == "real":
            rows = np.frombuffer(values.to_numpy(zero_copy_only=False).astype("<f8").tobytes(), np.uint8)
            row = np.full(len(at), 8)
        else:
            flat, lengths = _utf8(values)
            rows, row = interleaved(sized_varints(lengths), (flat, lengths))
        ends = np.append(0, np.cumsum(row))
        whole = [rows[a:b].tobytes() for a, b in zip(ends[last].tolist(), ends[last + 1].tolist(), strict=True)]
        flags = np.full(len(n), int(encoding == "real") << 1)
    heads = np.add.reduceat(size, first)
    lead = sized_varints(heads << 2 | flags)
    return _pieces(*interleaved(lead, (head, heads), (rows, np.add.reduceat(row, first)))), whole


def group_container(n: int, frame: bytes, run: bytes) -> bytes:
    """A group's container of n signals: the values before a block, and a packed run of columns."""
    return one(n) + one(0) + blob(packed(frame)) + one(1) + one(n) + b"\x00" + one(len(run)) + run


def signal_head(first: int, last: int, n_times: int, table: bytes, n_signals: int, dirty: list[tuple[int, int]], before: dict[int, int]) -> bytes:
    """The head of a SIGNAL_BLOCK with a packed table of times, whose dirty groups (group, bytes) follow; `before` is
    the block that a group was last dirty in."""
    n_groups = -(-n_signals // GROUP)
    index, at = b"", 0
    for group, size in dirty:
        index += struct.pack("<IIQ", group, size, at)
        at += size
    previous = struct.pack(f"<{n_groups}I", *(before.get(g, NONE) for g in range(n_groups)))
    return struct.pack("<QQIIIIII", first, last, n_times, n_signals, GROUP, len(dirty), n_groups, len(table)) + table + index + previous


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, 256)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _waveforms(changes: DataFrame, kinds: list[tuple[str, int, int]], scratch: Scratch) -> Callable[[], Iterator[tuple[int, bytes]]]:
    """Encodes changes; what is returned gives their sections."""
    seen = changes.agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("a"), F.max("time").alias("b")).first()
    if not seen["n"]:
        return lambda: iter(())
    width = -(-(seen["b"] - seen["a"] + 1) // max(1, -(-seen["n"] // CHANGE_ROWS)))
    blocks = (seen["b"] - seen["a"]) // width + 1
    shares = max(1, -(-min(seen["n"], CHANGE_ROWS) // TASK_ROWS))
    rows = changes.withColumn("block", F.expr(f"cast((time - {seen['a']}) div {width} as int)"))
    group, forms = GROUP, list(dict.fromkeys(kinds))
    form = np.array([forms.index(k) for k in kinds], np.int64)
    table = pa.schema([("block", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
    coded = pa.schema([("block", pa.int32()), ("grp", pa.int64()), ("run", pa.binary()), ("last", pa.list_(pa.binary()))])
    done = pa.schema([("block", pa.int32()), ("grp", pa.int64()), ("data", pa.binary())])

    def pack_times(it):
        held = [b for b in it if b.num_rows]
        if held:
            block, time = (np.concatenate([b[c].to_numpy() for b in held]) for c in ("block", "time"))
            order = np.lexsort((time, block))
            block, time = block[order], time[order]
            for part in np.split(np.arange(len(time)), np.flatnonzero(np.diff(block)) + 1):
                t = time[part]
                yield pa.RecordBatch.from_pydict(dict(zip(table.names, ([block[part[0]]], [t[0]], [t[-1]], [len(t)], [packed(varints(np.diff(t, prepend=0)))]), strict=True)), schema=table)

    def encode(it):
        """Groups of one block, whose table of times comes with its rows."""
        held, ticks = [], None
        for b in it:
            if b["ticks"].null_count < b.num_rows:
                ticks = b["ticks"].drop_null()[0].as_py()
                b = b.filter(pc.is_null(b["ticks"]))
            if b.num_rows:
                held.append(b.select(["block", "signal_id", "time", "seq", "text", "real"]))
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        block = t["block"][0].as_py()
        owner, time, seq = (t[c].to_numpy() for c in ("signal_id", "time", "seq"))
        times = np.cumsum(C.numbers(C.decompress(ticks)).view(np.int64))
        order = np.lexsort((seq, time, owner))
        C.need(owner.min() >= 0 and owner.max() < len(kinds), "unknown signal")
        own = form[owner[order]]
        columns, lasts = {}, {}
        for k in np.unique(own).tolist():
            sel = order[own == k]
            signals, n = np.unique(owner[sel], return_counts=True)
            values = t["real" if forms[k][0] == "real" else "text"].take(pa.array(sel)).combine_chunks()
            made, last = signal_columns(forms[k], n, np.searchsorted(times, time[sel]), values)
            columns.update(zip(signals.tolist(), made, strict=True))
            lasts.update(zip(signals.tolist(), last, strict=True))

        def containers():
            for g in np.unique(owner // group).tolist():
                every = range(g * group, min(len(kinds), g * group + group))
                found = [columns.get(s, b"") for s in every]
                yield block, g, packed(varints([len(c) for c in found]) + b"".join(found)), [lasts.get(s) for s in every]

        yield from _batches(containers(), coded)

    def frames(it):
        """Containers of each group in the order of blocks; the last values of a block are held before the next."""

        def containers():
            grp, held = None, []
            for b in it:
                for block, g, run, last in zip(*(b[c].to_pylist() for c in coded.names), strict=True):
                    if g != grp:
                        grp, held = g, [defaults[form[s]] for s in range(g * group, min(len(kinds), g * group + group))]
                    yield block, g, group_container(len(held), b"".join(held), run)
                    held = [h if v is None else v for h, v in zip(held, last, strict=True)]

        defaults = [_default(*k) for k in forms]
        yield from _batches(containers(), done)

    heads = scratch.write(rows.select("block", "time").distinct().repartitionById(blocks, "block").mapInArrow(pack_times, "block int, first long, last long, n long, data binary"))
    none = lambda t: F.lit(None).cast(t)
    share = lambda c: F.pmod(F.xxhash64(F.expr(f"{c} div {group}")), F.lit(shares)).cast("int")
    placed = rows.select((F.col("block") * shares + share("signal_id")).alias("task"), "block", "signal_id", "time", "seq", F.col("text").cast("string").alias("text"), F.col("real").cast("double").alias("real"), none("binary").alias("ticks"))
    every = heads.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).select(
        (F.col("block") * shares + F.col("s")).alias("task"), "block", *(none(t).alias(c) for c, t in (("signal_id", "bigint"), ("time", "bigint"), ("seq", "bigint"), ("text", "string"), ("real", "double"))), F.col("data").alias("ticks"),
    )
    both = placed.unionByName(every).repartitionById(blocks * shares, "task")
    found = scratch.write(both.mapInArrow(encode, "block int, grp long, run binary, last array<binary>"))
    groups = scratch.write(found.repartition(max(1, min(blocks * shares, -(-len(kinds) // group))), "grp").sortWithinPartitions("grp", "block").mapInArrow(frames, "block int, grp long, data binary"))
    scratch.drop(found)

    def sections():
        before: dict[int, int] = {}
        parts = groupby(groups.orderBy("block", "grp").toLocalIterator(True), lambda r: r["block"])
        for number, (t, (b, found)) in enumerate(zip(heads.orderBy("block").toLocalIterator(), parts, strict=True)):
            C.need(t["block"] == b, "block without times")
            dirty = [(r["grp"], bytes(r["data"])) for r in found]
            yield C.SIGNAL_BLOCK, signal_head(t["first"], t["last"], t["n"], bytes(t["data"]), len(kinds), [(g, len(d)) for g, d in dirty], before) + b"".join(d for _, d in dirty)
            before.update({g: number for g, _ in dirty})
        scratch.drop(groups, heads)

    return sections


# --- whole recordings --------------------------------------------------------------------------


def _parts(n: int, rows: int) -> int:
    return max(1, -(-n // rows))


def _ranges(df: DataFrame, order: list[str], parts: int, first: int) -> DataFrame:
    """A table in ranges of `order`, a partition each, with their `block`, numbered from `first`."""
    return df.repartitionByRange(parts, *order).withColumn("block", F.spark_partition_id() + F.lit(first))


def _encoded(placed: DataFrame, order: list[str], encode, scratch: Scratch, ddl: str = "block long, data binary") -> DataFrame:
    """A row of each block of a table whose blocks stand whole in their partitions, encoded where they are."""

    def run(it):
        held = [b for b in it if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            rows = rows.take(pa.array(np.lexsort([rows[c].to_numpy() for c in (*reversed(order), "block")])))
            number = rows["block"].to_numpy()
            at = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(at[:-1], at[1:], strict=True):
                found = encode(rows.slice(a, b - a).drop_columns(["block"]), int(number[a]))
                yield pa.RecordBatch.from_pydict({c: pa.array([v], t) for (c, t), v in zip(types, (int(number[a]), *found), strict=True)})

    types = [(c.split()[0], {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[c.split()[1]]) for c in ddl.split(", ")]
    return scratch.write(placed.mapInArrow(run, ddl))


def _block_of(starts: list[int], first: int, column: str):
    """The block of an id, by binary search in the least ids of the blocks."""
    bounds = F.lit(starts).cast("array<bigint>")
    steps = F.lit([1 << k for k in reversed(range(len(starts).bit_length()))]).cast("array<int>")
    found = F.aggregate(steps, F.lit(0), lambda lo, w: F.when(F.get(bounds, lo + w - 1) <= F.col(column), lo + w).otherwise(lo))
    return F.greatest(found - 1, F.lit(0)) + F.lit(first)


def write_recording(spark: SparkSession, path: str, tables: dict[str, DataFrame], timescale: int = -9, incomplete: bool = False) -> None:
    """Write a recording of tables `nodes` (node_id from 0 without gaps, parents first; parent_id, node_kind, name, signal_id,
    gen_kind), `signals` (signal_id from 0, encoding, width, states), `changes`, `transactions` (id, parent, generator, begin,
    end, status, span_kind, payload array of integers), `embedded` (id, kind, owner, name, lane, begin, end), `located`,
    `relations` and `blackouts`; absent tables are empty. The path must be new; the file appears when it is whole.

    Ticks and ids are not NULL and not negative, ends are not before begins, parents are smaller than their children's ids,
    or encoding fails. Of embedded records without their owner nothing is written. Each transaction lists the blocks that
    hold its children.
    """
    with ThreadPoolExecutor(8, "recording") as pool:
        _write_recording(spark, path, dict(tables), timescale, incomplete, lambda f, *args: started(pool, spark, f, *args))


def _write_recording(spark: SparkSession, path: str, tables: dict[str, DataFrame], timescale: int, incomplete: bool, start: Callable[..., Future]) -> None:
    """`start` calls a function in another thread: what doesn't wait for each other is computed side by side, so that
    the last tasks of one table leave no core idle. A thread waits only for what has been started before it."""
    scratch = Scratch(spark, "recording")

    def once(df: DataFrame) -> tuple[DataFrame, int]:
        """A table and its count; each is read several times, so what is not written yet is written."""
        return (df, df.count()) if getattr(df, "_tickloom_path", None) else scratch.counted(df)

    names = [n for n in ("nodes", "signals", "transactions", "embedded", "relations", "changes") if n in tables]
    jobs = {n: start(once, tables[n]) for n in names}
    n_located = start(tables["located"].count) if "located" in tables else None
    counts: dict[str, int] = {}
    written: dict[str, DataFrame] = {}

    def ready(*wanted: str) -> None:
        for n in wanted:
            if n in jobs:
                table, counts[n] = jobs.pop(n).result()
                if table is not tables[n]:
                    written[n] = tables[n] = table

    ready("nodes", "signals")
    # declarations pass the driver as Arrow, which needs a fraction of the memory of rows
    nodes = tables["nodes"].orderBy("node_id").toArrow() if "nodes" in tables else None
    kinds: dict[tuple, tuple] = {}
    signals = []
    if "signals" in tables:
        found = tables["signals"].orderBy("signal_id").toArrow()
        signals = [kinds.setdefault(k, k) for k in zip(*(found[c].to_pylist() for c in ("encoding", "width", "states")), strict=True)]
    waves = start(lambda job: _waveforms(job.result()[0], signals, scratch), jobs["changes"]) if "changes" in tables else None
    made, block = [], 1
    no_tx = pa.table({c: pa.array([], t) for c, t in _TX_TYPES})
    no_rel = pa.table({"kind": pa.array([], pa.string()), "source": pa.array([], pa.int64()), "destination": pa.array([], pa.int64())})
    tx_range, children = None, []
    if "transactions" in tables:
        ready("transactions")
        tx_parts = _parts(counts["transactions"], TX_ROWS)
        slim = scratch.write(_ranges(tables["transactions"].select("id", _zero("parent")), ["id"], tx_parts, block))
        starts = [(r["lo"], r["hi"], r["block"]) for r in slim.groupBy("block").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("block").collect()]
        tx_first, block = block, block + tx_parts
        children.append(slim.select("parent", "block"))
        tx_range = (starts[0][0], starts[-1][1]) if starts else (1, 0)
    ready("relations")
    rel_first, rel_parts = block, _parts(counts["relations"], TX_ROWS) if "relations" in tables else 0
    block += rel_parts
    records = None
    if "located" in tables:
        located = _ranges(tables["located"].select("id", "kind", "generator", "begin", "end", _zero("parent")), ["begin", "id"], _parts(n_located.result(), RECORD_ROWS), block)

        def record(p, number):
            owners = _whole_numbers(p["parent"].combine_chunks().filter(pc.not_equal(p["kind"].combine_chunks(), "log")))
            # only those that transactions of the recording can have
            owners = np.unique(owners[(owners >= tx_range[0]) & (owners <= tx_range[1])]) if tx_range else owners[:0]
            return record_section(p, number), owners

        records = start(_encoded, located, ["begin", "id"], record, scratch, "block long, data binary, owners array<long>")
    ready("embedded")
    words = [tables["nodes"].select(F.explode(F.array("name", "gen_kind")).alias("w"))] if nodes is not None else []
    words += [tables["embedded"].select(F.explode(F.array("name", "lane")).alias("w"))] if "embedded" in tables else []
    words += [tables["relations"].select(F.col("kind").alias("w"))] if "relations" in tables else []
    listed = [""]
    if words:
        every = words[0]
        for w in words[1:]:
            every = every.unionByName(w)
        listed += every.filter("w is not null and w <> ''").distinct().orderBy("w").toArrow()["w"].to_pylist()
    strings = {s: i for i, s in enumerate(listed)}
    relations = None
    if "relations" in tables:
        rel = _ranges(tables["relations"].select("kind", _zero("source"), _zero("destination")), ["source", "destination"], rel_parts, rel_first)
        relations = start(_encoded, rel, ["source", "destination"], lambda p, number: (transaction_section(no_tx, p, number, strings),), scratch)
    if records:
        encoded = records.result()
        children.append(encoded.select(F.explode("owners").alias("parent"), "block"))
    if "transactions" in tables:
        every = children[0] if len(children) == 1 else children[0].unionByName(children[1])
        listed_blocks = every.filter("parent > 0").groupBy(F.col("parent").alias("id")).agg(F.sort_array(F.collect_set(F.col("block").cast("bigint"))).alias("child_blocks"))
        rows = _with_detail(tables).join(listed_blocks, "id", "left")
        # ranges may be empty, so blocks are told by their place among those that aren't
        place = _block_of([lo for lo, _, _ in starts], 0, "id") if starts else F.lit(0)
        block_at = F.get(F.lit([b for _, _, b in starts] or [tx_first]).cast("array<int>"), place)
        rows = rows.withColumn("block", block_at).repartitionById(tx_parts, F.col("block") - F.lit(tx_first))
        made.append((C.TX_BLOCK, _encoded(rows, ["id"], lambda p, number: (transaction_section(p, no_rel, number, strings),), scratch)))
    if relations:
        made.append((C.TX_BLOCK, relations.result()))
    if records:
        made.append((C.RECORD_BLOCK, encoded.select("block", "data")))
    scratch.drop(*(written.get(t) for t in ("transactions", "embedded", "relations")))
    sections = []
    if "blackouts" in tables:
        marks = tables["blackouts"].orderBy("time", "seq").collect()
        steps = np.diff([0, *(m["time"] for m in marks)])
        sections.append((C.BLACKOUT, one(len(marks)) + b"".join(bytes([m["active"]]) + one(int(d)) for m, d in zip(marks, steps, strict=True))))
    declared: dict[int, int] = {}

    def every_section():
        yield C.STRINGS, packed(one(0) + one(len(listed)) + b"".join(blob(s.encode()) for s in listed))
        yield C.META, one(1) + svarints([timescale]) + svarints([0]) + b"\x00" + blob(b"tickloom") + blob(b"") + blob(b"") + one(GROUP) + one(0)
        yield C.DATATYPES, one(SEQUENCE) + one(1) + b"\x03" + blob(b"words") + one(I64)
        if nodes:
            yield C.HIERARCHY, packed(one(0) + one(len(nodes)) + b"".join(_node(n, strings, signals, declared) for b in nodes.to_batches(max_chunksize=4096) for n in b.to_pylist()))
        yield from sections
        if waves:
            yield from waves.result()()
            ready("changes")
            scratch.drop(written.get("changes"))
        for kind, table in made:
            for r in table.orderBy("block").toLocalIterator(True):
                yield kind, bytes(r["data"])

    C.write_sections(path, uuid.uuid4().bytes, every_section(), incomplete)


_TX_TYPES = [
    *((c, pa.int64()) for c in ("id", "parent", "generator", "begin", "end", "status", "span_kind")), ("payload", pa.list_(pa.int64())), ("child_blocks", pa.list_(pa.int64())),
    ("events", pa.list_(pa.struct([("id", pa.int64()), ("time", pa.int64()), ("name", pa.string())]))),
    ("stages", pa.list_(pa.struct([("id", pa.int64()), ("name", pa.string()), ("lane", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))),
]


def _with_detail(tables: dict[str, DataFrame]) -> DataFrame:
    """Transactions with their embedded events and stages, in the order of ids."""
    tx = tables["transactions"]
    payload = F.col("payload") if "payload" in tx.columns else F.lit(None).cast("array<bigint>")
    tx = tx.select("id", _zero("parent"), "generator", "begin", "end", _zero("status"), _zero("span_kind"), payload.alias("payload"))
    none = {"events": "array<struct<id:bigint,time:bigint,name:string>>", "stages": "array<struct<id:bigint,name:string,lane:string,begin:bigint,end:bigint>>"}
    if "embedded" not in tables:
        return tx.select("*", *(F.array().cast(t).alias(c) for c, t in none.items()))
    inside = tables["embedded"].groupBy(F.col("owner").alias("id")).agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "event", F.struct("id", F.col("begin").alias("time"), "name")))).alias("events"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "stage", F.struct("id", "name", "lane", "begin", "end")))).alias("stages"),
    )
    return tx.join(inside, "id", "left").select(*tx.columns, *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in none.items()))


def _zero(column: str):
    """Absent as 0, as the format has it; a column without NULLs stays whole numbers in pandas."""
    return F.coalesce(F.col(column).cast("bigint"), F.lit(0).cast("bigint")).alias(column)


def _node(n: dict, strings: dict[str, int], signals: list[tuple[str, int, int]], declared: dict[int, int]) -> bytes:
    up = one(n["node_id"] - n["parent_id"] if n["parent_id"] is not None else 0)
    name = one(strings[n["name"] or ""])
    if n["node_kind"] == "scope":
        return b"\x01" + up + name + one(SCOPE_TYPE.index("module")) + one(0) + one(0)
    if n["node_kind"] == "generator":
        payload = SEQUENCE if n["gen_kind"] not in ("EVENT", "STAGE", "LOG", "CLOCK") else 0
        return b"\x03" + up + name + one(strings[n["gen_kind"]]) + one(payload) + one(0)
    encoding, width, states = signals[n["signal_id"]]
    if n["signal_id"] in declared:
        own = one(len(declared) - declared[n["signal_id"]]) + b"\x00"
    else:
        C.need(n["signal_id"] == len(declared), "signals must be declared in order")
        declared[n["signal_id"]] = len(declared)
        own = one(0) + b"\x01" + (bytes([{2: 0, 4: 1, 9: 2}[states]]) + one(width) if encoding == "bits" else bytes([3 if encoding == "real" else 4]))
    return b"\x02" + up + name + one(16) + b"\x00" + own + one(0)
