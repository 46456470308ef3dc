"""The binary trace container: sections, declarations, waveforms and records.

`register` adds the format "tickloom": `spark.read.format("tickloom").option("table", t).load(path)`
with t one of TABLES. The directory at the end of a file (or, for an unfinished one, a scan of its
sections) is read when the query is planned; each data section becomes a partition, pruned by its time bounds against
filters on begin, end and time, and is decoded where it is read, into Arrow batches; of waveforms only the
signals that a filter names are decoded.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tickloom.model import SECTION_KIND, STATES

# Fixed values of the format.
MAGIC, TRAILER = bytes.fromhex("89 56 54 52 0d 0a 1a 0a"), bytes.fromhex("56 54 52 5f 45 4e 44 00")
VERSION = (3, 5)
META, STRINGS, HIERARCHY, SIGNAL_BLOCK, TX_BLOCK, BLACKOUT, DIRECTORY, RECORD_BLOCK, DATATYPES, VALUES = 1, 2, 3, 4, 5, 6, 7, 9, 10, 11
FIRST_DECLARED_TYPE = 23
MAX_NESTING = 64
LONG_MAX = (1 << 63) - 1


class Corrupt(ValueError):
    """The bytes are no valid recording."""


def need(ok: bool, why: str) -> None:
    if not ok:
        raise Corrupt(why)


class Cursor:
    """Reads one stream; every stream must be consumed exactly (`done`)."""

    __slots__ = ("at", "data", "end")

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def take(self, n: int) -> bytes:
        need(0 <= n <= self.end - self.at, "truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def fixed(self, n: int, signed: bool = False) -> int:
        return int.from_bytes(self.take(n), "little", signed=signed)

    def varint(self, limit: int = (1 << 64) - 1) -> int:
        value, shift = 0, 0
        while True:
            b = self.byte()
            value |= (b & 0x7F) << shift
            if b < 0x80:
                break
            shift += 7
            need(shift < 70, "long varint")
        need(value <= limit, "varint out of range")
        return value

    def svarint(self) -> int:
        v = self.varint()
        return (v >> 1) ^ -(v & 1)

    def blob(self) -> bytes:
        return self.take(self.varint())

    def text(self) -> str:
        return utf8(self.blob())

    def done(self) -> None:
        need(self.at == self.end, "bytes are left over")


def utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        raise Corrupt("text is not UTF-8") from e


def unsigned(v: int) -> int:
    """A 64-bit value after wrapping addition."""
    return v & ((1 << 64) - 1)


def long(v: int) -> int:
    """A tick or id as bigint; those from 2^63 on don't fit and are an error, never wrapped."""
    if v > LONG_MAX:
        raise OverflowError(f"{v} does not fit a bigint")
    return v


def decompress(data: bytes, limit: int = 1 << 30) -> bytes:
    """A compressed blob: codec (0 stored, 1 raw LZ4, 2 Zstandard), length, bytes."""
    c = Cursor(data)
    codec, size = c.byte(), c.varint()
    need(size < limit, "blob exceeds the limit")
    body = data[c.at :]
    if codec == 0:
        need(len(body) == size, "stored length")
        return body
    need(codec in (1, 2), "unknown codec")
    if not size:
        return b""
    try:
        return pa.decompress(body, size, codec="lz4_raw" if codec == 1 else "zstd", asbytes=True)
    except (OSError, pa.ArrowException) as e:
        raise Corrupt("blob can't be decompressed") from e


# --- container ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Section:
    index: int
    kind: int
    flags: int
    offset: int
    length: int
    aux0: int
    aux1: int
    block: int


@dataclass
class Catalogue:
    identity: str
    sections: list[Section]
    completion: str
    dropped_bytes: int
    fingerprint: str | None


def open_file(path: str):
    """A file to read at any place, on the local disk or on any file system that Arrow knows by its URI."""
    if ":/" not in path:
        return open(path, "rb")
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def catalogue(path: str, prefix: bool = True) -> Catalogue:
    """Sections of a file by its directory; without a valid one by scanning from the start to the
    first section that is incomplete, unknown or fails its check sum (`prefix`; else an error)."""
    with open_file(path) as f:
        head = f.read(32)
        need(len(head) == 32 and head[:8] == MAGIC, "not a recording")
        need(struct.unpack("<HH", head[8:12]) == VERSION, "unsupported version")
        need(head[12:16] == bytes(4) and any(head[16:]), "bad header")
        identity = head[16:].hex()
        size = f.seek(0, 2)
        try:
            return _directory(f, size, identity)
        except Corrupt:
            if not prefix:
                raise
        sections, at = [], 32
        while at + 24 <= size:
            f.seek(at)
            kind, flags, length, crc, reserved = struct.unpack("<IIQII", f.read(24))
            if kind == DIRECTORY or (kind not in SECTION_KIND and not flags & 1) or reserved or at + 24 + length > size:
                break
            payload = f.read(length)
            if crc and zlib.crc32(payload) != crc:
                break
            sections.append(Section(len(sections), kind, flags, at, length, *_bounds(kind, payload)))
            at += 24 + length
        return Catalogue(identity, sections, "unfinished", size - at, None)


def _bounds(kind: int, payload: bytes) -> tuple[int, int, int]:
    """Time bounds and block number of a data section, as a directory has them."""
    if kind == SIGNAL_BLOCK:
        return (*struct.unpack_from("<QQ", payload), 0)
    if kind == TX_BLOCK:
        block, n = struct.unpack_from("<QQ", payload)
        return (*(struct.unpack_from("<QQ", payload, 40) if n else (0, 0)), block)
    if kind == RECORD_BLOCK:
        return (*struct.unpack_from("<QQ", payload, 32), struct.unpack_from("<Q", payload)[0])
    return 0, 0, 0


def _directory(f, size: int, identity: str) -> Catalogue:
    need(size >= 32 + 24 + 24, "no trailer")
    f.seek(size - 24)
    offset, total, mark = struct.unpack("<QQ8s", f.read(24))
    need(mark == TRAILER and total == size and 32 <= offset <= size - 48, "no trailer")
    f.seek(offset)
    kind, flags, length, crc, _ = struct.unpack("<IIQII", f.read(24))
    need(kind == DIRECTORY and offset + 24 + length == size - 24, "directory extent")
    payload = f.read(length)
    need(zlib.crc32(payload) == crc, "directory check sum")
    count, dropped = struct.unpack_from("<QQ", payload)
    need(len(payload) == 16 + 48 * count, "directory length")
    sections, at = [], 32
    for i in range(count):
        kind, section_flags, start, length, a0, a1, block = struct.unpack_from("<IIQQQQQ", payload, 16 + 48 * i)
        need(start == at, "sections must follow each other")
        at += 24 + length
        sections.append(Section(i, kind, section_flags, start, length, a0, a1, block))
    need(at == offset, "sections must fill the file")
    return Catalogue(identity, sections, "incomplete" if flags & 2 else "complete", dropped, f"{identity}-{size}-{crc:08x}")


def payload_of(f, s: Section, checked: bool = True) -> bytes:
    f.seek(s.offset)
    _, _, length, crc, _ = struct.unpack("<IIQII", f.read(24))
    data = f.read(length)
    need(len(data) == length == s.length, "section length")
    need(not checked or not crc or zlib.crc32(data) == crc, "section check sum")
    return data


def write_sections(path: str, identity: bytes, sections: Iterable[tuple[int, bytes]], incomplete: bool = False, dropped: int = 0) -> None:
    """Write a recording of (kind, payload) sections with its directory and trailer, one section at a
    time. The path (on a local or mounted file system) must be new; the file appears under it only
    when it is whole."""
    need(len(identity) == 16 and any(identity), "identity")
    path = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
    if os.path.exists(path):
        raise FileExistsError(path)
    part = f"{path}.{os.getpid()}.part"
    try:
        with open(part, "xb") as f:
            f.write(MAGIC + struct.pack("<HHI", *VERSION, 0) + identity)
            entries, at = [], 32
            for kind, payload in sections:
                aux0, aux1, block = _bounds(kind, payload)
                if kind in (STRINGS, HIERARCHY, DATATYPES, VALUES):
                    c = Cursor(payload if kind == DATATYPES else decompress(payload))
                    aux0, aux1 = c.varint(), c.varint()
                f.write(struct.pack("<IIQII", kind, 0, len(payload), zlib.crc32(payload), 0) + payload)
                entries.append(struct.pack("<IIQQQQQ", kind, 0, at, len(payload), aux0, aux1, block))
                at += 24 + len(payload)
            directory = struct.pack("<QQ", len(entries), dropped) + b"".join(entries)
            f.write(struct.pack("<IIQII", DIRECTORY, 2 if incomplete else 0, len(directory), zlib.crc32(directory), 0) + directory)
            f.write(struct.pack("<QQ", at, at + 24 + len(directory) + 24) + TRAILER)
        os.link(part, path)  # fails if the path has appeared meanwhile
    finally:
        if os.path.exists(part):
            os.unlink(part)


def recover(source: str, target: str) -> int:
    """Copy what can be verified of a recording to a new, sealed one, section by section; the bytes
    dropped. A complete recording keeps its completion; the copy of any other is incomplete."""
    cat = catalogue(source)
    with open_file(source) as f:
        f.seek(16)
        identity = f.read(16)
        write_sections(target, identity, ((s.kind, payload_of(f, s)) for s in cat.sections), cat.completion != "complete", cat.dropped_bytes)
    return cat.dropped_bytes


# --- declarations ------------------------------------------------------------------------------

# Widths in bytes and signedness of the integer types by id.
INTEGERS = {2: (1, True), 3: (2, True), 4: (4, True), 5: (8, True), 6: (1, False), 7: (2, False), 8: (4, False), 9: (8, False), 18: (8, False), 20: (8, False)}
TAGS = ["null", "bool", "i8", "i16", "i32", "i64", "u8", "u16", "u32", "u64", "f32", "f64", "str", "text", "bytes", "bits", "logic", "logic9", "time", "enum", "pointer",
        "fixed", "ufixed", "list", "map", "ref"]


@dataclass
class Datatype:
    kind: int
    name: str
    fields: list[tuple[str, int]] = field(default_factory=list)
    element: int = 0
    count: int = 0
    literals: list[tuple[int, str]] = field(default_factory=list)
    attributes: list = field(default_factory=list)


@dataclass
class Declarations:
    metadata: dict = field(default_factory=dict)
    strings: list[str] = field(default_factory=lambda: [])
    values: list = field(default_factory=list)
    types: dict[int, Datatype] = field(default_factory=dict)
    nodes: list[dict] = field(default_factory=list)
    signals: list[tuple[str, int, int]] = field(default_factory=list)  # encoding, width, states

    def string(self, i: int) -> str:
        need(i < len(self.strings), "unknown string")
        return self.strings[i]

    def text_of(self, width: int, states: int, data: bytes) -> str:
        return unpack(width, states, data)


def packed_size(width: int, states: int) -> int:
    per = 8 if states == 2 else 4 if states == 4 else 2
    return -(-width // per)


def unpack(width: int, states: int, data: bytes) -> str:
    """States of a packed value, the highest first."""
    bits = 1 if states == 2 else 2 if states == 4 else 4
    n = int.from_bytes(data, "little")
    need(n >> (bits * width) == 0, "padding must be zero")
    if states == 2:
        return format(n, f"0{width}b")
    out = []
    for i in reversed(range(width)):
        code = (n >> (bits * i)) & ((1 << bits) - 1)
        need(code < (4 if states == 4 else 9), "bad state")
        out.append(STATES[code])
    return "".join(out)


def read_value(c: Cursor, d: Declarations, depth: int = 0):
    """A tagged value as (tag name, value for JSON)."""
    need(depth <= MAX_NESTING, "nested too deeply")
    tag = c.byte()
    need(tag < len(TAGS), "unknown tag")
    return TAGS[tag], _tagged(c, c, c, c, tag, d, depth)


def _tagged(num: Cursor, flo: Cursor, text: Cursor, misc: Cursor, tag: int, d: Declarations, depth: int):
    """A value's payload; its parts may stand in different streams."""
    if tag == 0:
        return None
    if tag == 1:
        b = num.byte()
        need(b < 2, "bad bool")
        return bool(b)
    if 2 <= tag <= 5:
        v = num.svarint()
        need(-(1 << (8 * INTEGERS[tag][0] - 1)) <= v < 1 << (8 * INTEGERS[tag][0] - 1), "integer out of range")
        return v
    if 6 <= tag <= 9:
        return num.varint((1 << (8 * INTEGERS[tag][0])) - 1)
    if tag == 10:
        return struct.unpack("<f", flo.take(4))[0]
    if tag == 11:
        return struct.unpack("<d", flo.take(8))[0]
    if tag == 12:
        return d.string(text.varint())
    if tag == 13:
        return misc.text()
    if tag == 14:
        return misc.blob().hex()
    if 15 <= tag <= 17:
        width, states = misc.varint(), (2, 4, 9)[tag - 15]
        return unpack(width, states, misc.take(packed_size(width, states)))
    if tag in (18, 20):
        return num.varint()
    if tag == 19:
        v = num.svarint()
        return {"value": v, "name": d.string(text.varint())}
    if tag == 21:
        return {"raw": num.svarint(), "scale": num.svarint()}
    if tag == 22:
        return {"raw": num.varint(), "scale": num.svarint()}
    if tag == 23:
        return [read_value(misc, d, depth + 1)[1] for _ in range(misc.varint())]
    if tag == 24:
        return {a["key"]: json.loads(a["value"]) for a in read_attributes(misc, d, depth + 1)}
    i = num.varint()
    need(i < len(d.values), "unknown interned value")
    return {"ref": i}


def _attribute(key: str, tag: str, value) -> dict:
    return {"key": key, "tag": tag, "value": json.dumps(value)}


def read_attributes(c: Cursor, d: Declarations, depth: int = 0) -> list[dict]:
    out, keys = [], set()
    for _ in range(c.varint()):
        key = c.varint()
        need(key not in keys, "repeated attribute key")
        keys.add(key)
        out.append(_attribute(d.string(key), *read_value(c, d, depth)))
    return out


def read_types(c: Cursor, d: Declarations) -> None:
    first, count = c.varint(), c.varint()
    need(first == FIRST_DECLARED_TYPE + len(d.types), "datatype ids must follow")
    for i in range(first, first + count):
        flags = c.byte()
        t = Datatype(flags & 0x7F, c.text())

        def earlier(j, i=i):
            need(j < FIRST_DECLARED_TYPE or j in d.types, "forward reference")
            need(j < i, "forward reference")
            return j

        if t.kind == 1:
            for _ in range(c.varint()):
                name = c.text()
                need(bool(name) and name not in dict(t.fields), "field names")
                t.fields.append((name, earlier(c.varint())))
        elif t.kind == 2:
            t.element, t.count = earlier(c.varint()), c.varint()
        elif t.kind == 3:
            t.element = earlier(c.varint())
        elif t.kind == 4:
            t.element = earlier(c.varint())
            need(t.element in INTEGERS, "enumeration of a type that is no integer")
            size, signed = INTEGERS[t.element]
            for _ in range(c.varint()):
                bits = c.fixed(8)
                value = bits - (1 << 64) if signed and bits >> 63 else bits
                t.literals.append((value, c.text()))
            del size
        else:
            raise Corrupt("unknown kind of datatype")
        if flags & 0x80:
            t.attributes = read_attributes(c, d)
            need(bool(t.attributes), "empty attributes")
        d.types[i] = t


def read_nodes(c: Cursor, d: Declarations) -> None:
    first, count = c.varint(), c.varint()
    need(first == len(d.nodes), "node ids must follow")
    for i in range(first, first + count):
        kind, distance, name = c.byte(), c.varint(), d.string(c.varint())
        need(distance <= i, "bad parent")
        node = {"node_id": i, "parent_id": i - distance if distance else None, "name": name, "signal_id": None, "code": None, "gen_kind": None, "payload_type": None}
        need(not distance or d.nodes[i - distance]["node_kind"] == "scope", "a parent must be a scope")
        if kind == 1:
            node |= {"node_kind": "scope", "code": c.varint()}
            d.string(c.varint())
        elif kind == 2:
            node |= {"node_kind": "variable", "code": c.varint()}
            need(c.byte() <= 5, "bad direction")
            back, declares = c.varint(), c.byte()
            if declares:
                need(back == 0 and declares == 1, "bad declaration")
                encoding = c.byte()
                need(encoding <= 4, "bad encoding")
                if encoding <= 2:
                    width = c.varint()
                    need(0 < width < 1 << 31, "bad width")
                    d.signals.append(("bits", width, (2, 4, 9)[encoding]))
                else:
                    d.signals.append(("real" if encoding == 3 else "bytes", 0, 2))
                node["signal_id"] = len(d.signals) - 1
            else:
                need(0 < back <= len(d.signals), "bad alias")
                node["signal_id"] = len(d.signals) - back
        elif kind == 3:
            node |= {"node_kind": "generator", "gen_kind": d.string(c.varint()), "payload_type": c.varint()}
        elif kind == 4:
            node["node_kind"] = "enum"
            for _ in range(c.varint()):
                d.string(c.varint())
                d.string(c.varint())
        else:
            raise Corrupt("unknown kind of node")
        node["attributes"] = read_attributes(c, d)
        d.nodes.append(node)


def declarations(path: str, cat: Catalogue | None = None, before: int | None = None, checked: bool = True) -> Declarations:
    """All declarations, or those of sections before a data section (which may use no others)."""
    cat, d = cat or catalogue(path), Declarations()
    with open_file(path) as f:
        for s in cat.sections:
            if before is not None and s.index >= before:
                break
            if s.kind not in (META, STRINGS, HIERARCHY, DATATYPES, VALUES):
                continue
            data = payload_of(f, s, checked)
            if s.kind in (STRINGS, HIERARCHY, VALUES):
                data = decompress(data)
            c = Cursor(data)
            if s.kind == STRINGS:
                first, count = c.varint(), c.varint()
                need(first == len(d.strings), "string ids must follow")
                d.strings += [c.text() for _ in range(count)]
            elif s.kind == VALUES:
                first, count = c.varint(), c.varint()
                need(first == len(d.values), "value ids must follow")
                for _ in range(count):
                    v = Cursor(c.blob())
                    d.values.append(read_value(v, d))
                    v.done()
            elif s.kind == DATATYPES:
                read_types(c, d)
            elif s.kind == HIERARCHY:
                read_nodes(c, d)
            else:
                need(c.varint() == 1, "metadata layout")
                m = {"timescale": c.svarint(), "time_zero": c.svarint(), "file_type": c.byte(), "writer": c.text(), "date": c.text(), "comment": c.text(), "group_size": c.varint()}
                d.metadata = m | {"attributes": read_attributes(c, d)}
            c.done()
    return d


# --- payloads ----------------------------------------------------------------------------------


class Arguments:
    """The five streams of schema-guided values of a page or segment."""

    def __init__(self, streams: list[Cursor], d: Declarations, shared_allowed: bool):
        self.num, self.flo, self.refs, dictionary, self.misc = streams
        self.d = d
        head = dictionary.varint()
        self.shared, count = head & 1, head >> 1
        need(shared_allowed or not self.shared, "shared text outside a transaction page")
        self.local = [dictionary.text() for _ in range(count)]
        dictionary.done()

    def value(self, t: int):
        d = self.d
        if t >= FIRST_DECLARED_TYPE:
            need(t in d.types, "unknown datatype")
            dt = d.types[t]
            if dt.kind == 1:
                return {name: self.value(ft) for name, ft in dt.fields}
            if dt.kind == 2:
                return [self.value(dt.element) for _ in range(dt.count)]
            if dt.kind == 3:
                return [self.value(dt.element) for _ in range(self.num.varint())]
            v = self.value(dt.element)
            return {"value": v, "name": next((n for x, n in dt.literals if x == v), None)}
        if t == 0:
            return None
        if t == 1 or 2 <= t <= 11 or t in (18, 20, 21):
            return _tagged(self.num, self.flo, self.misc, self.misc, t, d, 0)
        if t == 22:
            return {"raw": self.num.varint(), "scale": self.num.svarint()}
        if t == 12:
            return d.string(self.misc.varint())
        if t == 13:
            ref = self.refs.varint()
            if self.shared:
                if ref & 1:
                    return d.string(ref >> 1)
                ref >>= 1
            need(ref < len(self.local), "unknown text")
            return self.local[ref]
        return _tagged(self.num, self.flo, self.misc, self.misc, t, d, 0)

    def done(self) -> None:
        for c in (self.num, self.flo, self.refs, self.misc):
            c.done()


def column_set(c: Cursor, count: int) -> list[Cursor]:
    """Streams of a column set that starts at a cursor."""
    need(c.varint() == count, "number of columns")
    sizes = [c.varint() for _ in range(count)]
    return [Cursor(c.take(n)) for n in sizes]


# --- waveforms ---------------------------------------------------------------------------------


def _inverse(xform: int, raw: bytes, n: int, w: int) -> bytes:
    """Value bytes of a column before its transform."""
    if xform == 4:
        c = Cursor(raw)
        size = c.varint()
        if not size:
            return raw[c.at :]
        entries = np.frombuffer(c.take(size * w), np.uint8).reshape(size, w)
        codes = np.frombuffer(c.take(n), np.uint8)
        c.done()
        need(not n or codes.max() < size, "bad dictionary code")
        return entries[codes].tobytes()
    a = np.frombuffer(raw, np.uint8)
    need(len(a) == n * w, "column length")
    if xform in (1, 3):
        a = a.reshape(w, n).T.reshape(-1)
    if xform in (2, 3):
        out, total, mask = [], 0, (1 << (8 * w)) - 1
        data = a.tobytes()
        for i in range(n):
            total = (total + int.from_bytes(data[i * w : i * w + w], "little")) & mask
            out.append(total.to_bytes(w, "little"))
        return b"".join(out)
    return a.tobytes()


def numbers(data: bytes) -> np.ndarray:
    """All varints of a stream at once."""
    a = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(a < 128)
    need(not len(a) or len(ends) > 0 and ends[-1] == len(a) - 1, "truncated")
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    size = ends - starts + 1
    need(not len(size) or size.max() <= 10, "long varint")
    place = np.arange(len(a)) - np.repeat(starts, size)
    # the tenth byte has room for one bit
    need(not len(a) or not (a[place == 9] > 1).any(), "varint out of range")
    return np.add.reduceat((a & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts) if len(starts) else np.zeros(0, np.uint64)


_CHARS = np.frombuffer(STATES.encode().ljust(16, b"?"), np.uint8)


def unpack_all(width: int, states: int, data: bytes, n: int) -> pa.Array:
    """The texts of n packed values of one alphabet."""
    w, bits = packed_size(width, states), 1 if states == 2 else 2 if states == 4 else 4
    raw = np.unpackbits(np.frombuffer(data, np.uint8).reshape(n, w), axis=1, bitorder="little")
    need(not raw[:, width * bits :].any(), "padding must be zero")
    codes = raw[:, : width * bits].reshape(n, width, bits) @ (1 << np.arange(bits))
    need(not codes.size or codes.max() < (2 if states == 2 else 4 if states == 4 else 9), "bad state")
    text = _CHARS[codes[:, ::-1]]
    offsets = (np.arange(n + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(text.tobytes())])


def signal_columns(data: bytes, d: Declarations, wanted: set[int] | None = None) -> Iterator[tuple[int, np.ndarray, pa.Array, pa.Array]]:
    """(signal, time indices, texts, reals) of the signals that change in a block (see `block_times`), or
    of the wanted ones: groups and columns of others aren't decoded."""
    c = Cursor(data)
    _, _, _, n_signals, group_size, n_dirty, n_groups, tt = struct.unpack("<QQIIIIII", c.take(40))
    c.take(tt)
    need(n_signals <= len(d.signals) and n_groups == -(-n_signals // group_size), "signals of the block")
    index = [struct.unpack("<IIQ", c.take(16)) for _ in range(n_dirty)]
    c.take(4 * n_groups)
    area = c.at
    where = {group: (length, offset) for group, length, offset in index}

    def group_of(group: int, only: set[int] | None) -> tuple[dict, list]:
        length, offset = where[group]
        g = Cursor(data, area + offset, area + offset + length)
        first, n = group * group_size, g.varint()
        need(n == min(group_size, n_signals - first), "signals of the group")
        aliases = [(first + g.varint(), g.varint()) for _ in range(g.varint())]
        g.blob()
        runs = [(g.varint(), g.byte(), g.varint()) for _ in range(g.varint())]
        s, found = first, {}
        for count, xform, size in runs:
            need(xform <= 4, "unknown transform")
            body = g.take(size)
            if only is None or only & set(range(s, s + count)):
                r = Cursor(decompress(body))
                for k in [r.varint() for _ in range(count)]:
                    column = r.take(k)
                    if k and (only is None or s in only):
                        found[s] = _column(column, d.signals[s], xform)
                    s += 1
                r.done()
            else:
                s += count
        need(s == first + n, "runs must cover the group")
        g.done()
        return found, aliases

    columns: dict = {}
    shared: list[tuple[int, int]] = []
    for group, _, _ in index:
        if wanted is None or any(group * group_size <= s < (group + 1) * group_size for s in wanted):
            found, aliases = group_of(group, wanted)
            columns |= found
            shared += [a for a in aliases if wanted is None or a[0] in wanted]
    for s, target in shared:
        if target not in columns and wanted is not None and target // group_size in where:
            columns_of_target = group_of(target // group_size, {target})[0]
            need(target in columns_of_target and s not in columns, "bad alias")
            columns[s] = columns_of_target[target]
            continue
        need(target in columns and s not in columns, "bad alias")
        columns[s] = columns[target]
    for s in sorted(columns):
        yield s, *columns[s]


def _column(data: bytes, signal: tuple[str, int, int], xform: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    encoding, width, states = signal
    if encoding == "bits" and width == 1:
        v = numbers(data)
        given = (v & np.uint64(1)).astype(bool)
        at = np.cumsum(np.where(given, v >> np.uint64(5), v >> np.uint64(1)).astype(np.int64))
        need(not len(v) or given[0], "toggle of an unknown value")
        code = np.where(given, (v >> np.uint64(1)) & np.uint64(15), 0).astype(np.int64)
        need(not code.size or code.max() < (2 if states == 2 else 4 if states == 4 else 9), "bad state")
        # toggles since the last code that stands there
        since = np.maximum.accumulate(np.where(given, np.arange(len(v)), -1)) if len(v) else np.zeros(0, np.int64)
        turns = np.cumsum(~given)
        need(not (~given & (code[since] > 1)).any(), "toggle of an unknown value")
        code = code[since] ^ ((turns - turns[since]) & 1) if len(v) else code
        offsets = np.arange(len(v) + 1, dtype=np.int32)
        text = pa.Array.from_buffers(pa.string(), len(v), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(_CHARS[code].tobytes())])
        return at, text, pa.nulls(len(v), pa.float64())
    c = Cursor(data)
    word = c.varint()
    head, eligible, full = numbers(c.take(word >> 2)), word >> 1 & 1, word & 1
    n = len(head)
    at = np.cumsum((head >> np.uint64(1) if encoding == "bits" else head).astype(np.int64))
    body = c.data[c.at : c.end]
    if eligible and xform:
        body = _inverse(xform, body, n, 8 if encoding == "real" else packed_size(width, states if full else 2))
    if encoding == "real":
        need(len(body) == 8 * n, "column length")
        return at, pa.nulls(n, pa.string()), pa.array(np.frombuffer(body, "<f8"))
    if encoding == "bytes":
        v = Cursor(body)
        texts = [v.blob().decode("utf-8", "replace") for _ in range(n)]
        v.done()
        return at, pa.array(texts, pa.string()), pa.nulls(n, pa.float64())
    plain = (head & np.uint64(1)).astype(bool)
    size = np.where(plain, packed_size(width, 2), packed_size(width, states))
    need(int(size.sum()) == len(body), "column length")
    if not n or plain.all() or not plain.any():
        return at, unpack_all(width, 2 if n and plain[0] else states, body, n), pa.nulls(n, pa.float64())
    raw, begin = np.frombuffer(body, np.uint8), np.append(0, np.cumsum(size)[:-1])
    parts, order = [], []
    for alphabet, rows in ((2, np.flatnonzero(plain)), (states, np.flatnonzero(~plain))):
        span = begin[rows][:, None] + np.arange(packed_size(width, alphabet))
        parts.append(unpack_all(width, alphabet, raw[span].tobytes(), len(rows)))
        order.append(rows)
    return at, pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order)))), pa.nulls(n, pa.float64())


def block_times(data: bytes) -> list[int]:
    """Ticks of a signal block's time table."""
    n, tt = struct.unpack_from("<I", data, 16)[0], struct.unpack_from("<I", data, 36)[0]
    out = np.cumsum(numbers(decompress(data[40 : 40 + tt]))).tolist()
    need(len(out) == n, "length of the time table")
    need(not out or (out[0], out[-1]) == struct.unpack_from("<QQ", data), "time bounds")
    return out


# --- records -----------------------------------------------------------------------------------


def _pages(data: bytes, at: int, heads: list[tuple[int, int, int]]) -> Iterator[bytes]:
    """Decompressed pages from (offset, length, raw length); they fill the rest of the section."""
    expected = 0
    for offset, length, raw in heads:
        need(offset == expected, "pages must follow each other")
        expected += length
        page = decompress(data[at + offset : at + offset + length])
        need(len(page) == raw, "page length")
        yield page
    need(at + expected == len(data), "pages must fill the section")


class Records:
    """What a data section holds, as rows of the tables."""

    def __init__(self):
        self.transactions: list[tuple] = []
        self.embedded: list[tuple] = []
        self.relations: list[tuple] = []
        self.located: list[tuple] = []


def record_block(data: bytes, d: Declarations, kinds: dict[int, tuple[str, int]]) -> Records:
    """Located records; `kinds` gives (kind, payload type) by generator."""
    out, c = Records(), Cursor(data)
    block, total = c.fixed(8), c.fixed(8)
    c.take(32)
    n_segments, n_pages = c.fixed(4), c.fixed(4)
    segments = []
    for _ in range(n_segments):
        generator = c.fixed(4)
        need(generator in kinds, "unknown generator")
        kind, t = kinds[generator]
        need(kind in ("EVENT", "STAGE", "LOG"), "generator of another kind")
        if kind == "LOG":
            t = c.fixed(4)
        page, count, start, length = (c.fixed(4) for _ in range(4))
        c.take(48)
        segments.append((generator, kind, t, page, count, start, length))
    heads = [(c.fixed(4), c.fixed(4), c.fixed(4)) for _ in range(n_pages)]
    pages = list(_pages(data, c.at, heads))
    for generator, kind, t, page, count, start, length in segments:
        s = Cursor(pages[page], start, start + length)
        cols = column_set(s, 9)
        s.done()
        times, ids, parents, durations = cols[:4]
        args = Arguments(cols[4:], d, False)
        time = rid = parent = 0
        for _ in range(count):
            begin = time = unsigned(time + times.svarint())
            rid = unsigned(rid + ids.svarint())
            if kind == "LOG":
                back = parents.varint()
                owner = rid - back if back else None
            else:
                owner = parent = unsigned(parent + parents.svarint())
                need(0 < owner < rid, "bad parent")
            end = begin
            if kind == "STAGE":
                end = time = begin + durations.varint()
            out.located.append((long(rid), kind.lower(), generator, t, long(begin), long(end), owner, json.dumps(args.value(t)), block))
        for col in cols[:4]:
            col.done()
        args.done()
    need(len(out.located) == total, "record count")
    return out


def transaction_block(data: bytes, d: Declarations, kinds: dict[int, tuple[str, int]]) -> Records:
    """Transactions, clock stretches, embedded detail and relations of a block."""
    out, c = Records(), Cursor(data)
    block, n_tx, n_rel = c.fixed(8), c.fixed(8), c.fixed(8)
    c.take(96)
    n_gen, n_pages = c.fixed(4), c.fixed(4)
    generators = [c.fixed(4) for _ in range(n_gen)]
    heads, counts = [], []
    for _ in range(n_pages):
        counts.append((c.fixed(8), c.fixed(8)))
        c.take(96)
        heads.append((c.fixed(4), c.fixed(4), c.fixed(4)))
    for (tx, rel), page in zip(counts, _pages(data, c.at, heads), strict=True):
        if page[0] == 2:
            _scalar_page(page, tx, generators, d, kinds, block, out)
        else:
            _general_page(page, tx, rel, generators, d, kinds, block, out)
    need(len(out.transactions) == n_tx and len(out.relations) == n_rel, "block counts")
    return out


def _words(t: int, d: Declarations) -> int:
    """64-bit words of a fixed payload of unsigned 64-bit leaves."""
    if t in (9, 18, 20):
        return 1
    dt = d.types.get(t)
    need(dt is not None, "not a scalar payload")
    if dt.kind == 1:
        return sum(_words(f, d) for _, f in dt.fields)
    if dt.kind == 2:
        return dt.count * _words(dt.element, d)
    need(dt.kind == 4 and dt.element == 9, "not a scalar payload")
    return 1


def _scalar_value(t: int, d: Declarations, words: Iterator[int]):
    dt = d.types.get(t)
    if dt is None:
        return next(words)
    if dt.kind == 1:
        return {name: _scalar_value(f, d, words) for name, f in dt.fields}
    if dt.kind == 2:
        return [_scalar_value(dt.element, d, words) for _ in range(dt.count)]
    v = next(words)
    return {"value": v, "name": next((n for x, n in dt.literals if x == v), None)}


def _scalar_page(page: bytes, count: int, generators, d, kinds, block, out: Records) -> None:
    c = Cursor(page, 1)
    t, rows = c.fixed(4), c.fixed(4)
    need(rows == count, "row count")
    columns = []
    for _ in range(6 + _words(t, d)):
        width = c.byte()
        need(width <= 8, "plane width")
        planes = np.frombuffer(c.take(width * rows), np.uint8).reshape(width, rows)
        need(not width or planes[-1].any(), "needless plane")
        wide = np.zeros((rows, 8), np.uint8)
        wide[:, :width] = planes.T
        columns.append(wide.reshape(-1).view("<u8").tolist())
    c.done()
    for i, (rid, g, begin, duration, parent, state) in enumerate(zip(*columns[:6], strict=True)):
        need(g < len(generators) and kinds[generators[g]][1] == t, "generator and payload")
        payload = _scalar_value(t, d, iter([col[i] for col in columns[6:]]))
        out.transactions.append((long(rid), "transaction", parent or None, generators[g], long(begin), long(begin + duration), state & 15, state >> 4, json.dumps(payload), [], [], block))


def _general_page(page: bytes, n_tx: int, n_rel: int, generators, d: Declarations, kinds, block, out: Records) -> None:
    s = Cursor(page)
    cols = column_set(s, 33)
    s.done()
    (ids, gens, begins, durations, states, parents, counts, keys, tags, num, flo, strs, misc, ev_n, ev_time, ev_name, st_n, st_name, st_lane, st_begin, st_end,
     rel_kind, rel_from, rel_to, *args, ch_n, ch_block, ev_id, st_id) = cols
    arguments = Arguments(args, d, True)

    def attributes() -> list[dict]:
        found = []
        for _ in range(counts.varint()):
            key, tag = d.string(keys.varint()), tags.byte()
            need(tag < len(TAGS), "unknown tag")
            found.append(_attribute(key, TAGS[tag], _tagged(num, flo, strs, misc, tag, d, 0)))
        return found

    rid = begin = event_id = stage_id = 0
    for _ in range(n_tx):
        rid = unsigned(rid + ids.svarint())
        g = gens.varint()
        need(g < len(generators), "generator index")
        generator = generators[g]
        kind, t = kinds[generator]
        begin = unsigned(begin + begins.svarint())
        end = begin + durations.varint()
        state = states.byte()
        need(state & 15 <= 4 and state >> 4 <= 5, "bad status")
        back = parents.varint()
        own = attributes()
        what = "clock" if kind == "CLOCK" else "transaction"
        events = []
        for _ in range(ev_n.varint()):
            event_id = unsigned(event_id + ev_id.svarint())
            events.append((event_id, unsigned(begin + ev_time.svarint()), d.string(ev_name.varint())))
        for e in events:
            out.embedded.append((long(e[0]), "event", rid, e[2], None, long(e[1]), long(e[1]), attributes(), block))
        stages = []
        for _ in range(st_n.varint()):
            stage_id = unsigned(stage_id + st_id.svarint())
            at = unsigned(begin + st_begin.svarint())
            stages.append((stage_id, d.string(st_name.varint()), d.string(st_lane.varint()), at, st_end.varint(1 << 64)))
        for e in stages:
            out.embedded.append((long(e[0]), "stage", rid, e[1], e[2], long(e[3]), long(e[3] + e[4] - 1) if e[4] else None, attributes(), block))
        blocks, last = [], 0
        for _ in range(ch_n.varint()):
            step = ch_block.varint()
            need(step > 0, "child blocks must grow")
            last += step
            blocks.append(long(last))
        payload = json.dumps(arguments.value(t))
        out.transactions.append((long(rid), what, rid - back if back else None, generator, long(begin), long(end), state & 15, state >> 4, payload, own, blocks, block))
    source = 0
    rels = []
    for _ in range(n_rel):
        kind = d.string(rel_kind.varint())
        source = unsigned(source + rel_from.svarint())
        rels.append((kind, source, unsigned(source + rel_to.svarint())))
    for kind, a, b in rels:
        out.relations.append((kind, long(a) or None, long(b) or None, attributes(), block))
    for col in (*cols[:24], *cols[29:]):
        col.done()
    arguments.done()


class _Unusual(Exception):
    """What is not decoded by columns; rows are decoded one at a time then, which also finds what is wrong."""


def _plain(ok) -> None:
    if not ok:
        raise _Unusual


def _signed(v: np.ndarray) -> np.ndarray:
    return (v >> np.uint64(1)).view(np.int64) ^ -(v & np.uint64(1)).view(np.int64)


def _summed(steps: np.ndarray) -> np.ndarray:
    """Running sums that can't have wrapped and aren't negative."""
    _plain(np.abs(steps.astype(np.float64)).sum() < 2.0**62)
    total = np.cumsum(steps)
    _plain(not len(total) or total.min() >= 0)
    return total


def _ragged(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def _texts(indices: np.ndarray, d: Declarations) -> pa.Array:
    _plain(not len(indices) or indices.max() < len(d.strings))
    known, at = np.unique(indices, return_inverse=True)
    return pa.array([d.strings[i] for i in known.tolist()], pa.string()).take(pa.array(at))


def _payload_texts(stream: np.ndarray, wordy: np.ndarray) -> pa.Array:
    """JSON of sequences of 64-bit integers where `wordy`, null elsewhere; counts stand before the values."""
    words, at, counts = stream.tolist(), 0, []
    for _ in range(int(wordy.sum())):
        _plain(at < len(words))
        counts.append((at, words[at]))
        at += 1 + words[at]
    _plain(at == len(words))
    places, sizes = (np.array([c[i] for c in counts], np.int64) for i in (0, 1))
    values = np.ones(len(stream), bool)
    values[places] = False
    lists = _ragged(sizes, pa.array(_signed(stream[values])).cast(pa.string()))
    joined = pc.binary_join_element_wise("[", pc.binary_join(lists, ", "), "]", "")
    out = np.full(len(wordy), len(counts), np.int64)
    out[wordy] = np.arange(len(counts))
    return pa.concat_arrays([joined.cast(pa.string()), pa.array(["null"], pa.string())]).take(pa.array(out))


def general_columns(page: bytes, n_tx: int, n_rel: int, generators: list[int], d: Declarations, kinds: dict, block: int, table: str) -> list:
    """The columns of a table of a general page without attributes, whose payloads are absent or sequences of 64-bit
    integers; all streams are decoded and checked."""
    s = Cursor(page)
    cols = [c.data[c.at : c.end] for c in column_set(s, 33)]
    s.done()
    (ids, gens, begins, durations, states, parents, counts, keys, tags, num, flo, strs, misc, ev_n, ev_time, ev_name, st_n, st_name, st_lane, st_begin, st_end,
     rel_kind, rel_from, rel_to, words, more, refs, local, other, ch_n, ch_block, ev_id, st_id) = cols
    _plain(not any(counts) and not any((keys, tags, num, flo, strs, misc, more, refs, other)) and local == b"\x00")
    gens, durations, parents, ev_n, ev_name, st_n, st_name, st_lane, st_end, rel_kind, words, ch_n, ch_block = map(numbers, (gens, durations, parents, ev_n, ev_name, st_n, st_name, st_lane, st_end, rel_kind, words, ch_n, ch_block))
    ids, begins, ev_time, st_begin, rel_from, rel_to, ev_id, st_id = (_signed(numbers(c)) for c in (ids, begins, ev_time, st_begin, rel_from, rel_to, ev_id, st_id))
    _plain(all(len(c) == n_tx for c in (ids, gens, begins, durations, states, parents, ev_n, st_n, ch_n)) and all(len(c) == n_rel for c in (rel_kind, rel_from, rel_to)))
    _plain(all(n.sum(dtype=np.float64) == len(c) for n, cs in ((ev_n, (ev_time, ev_name, ev_id)), (st_n, (st_name, st_lane, st_begin, st_end, st_id)), (ch_n, (ch_block,))) for c in cs))
    _plain(not n_tx or gens.max() < len(generators))
    ev_n, st_n, ch_n = (c.astype(np.int64) for c in (ev_n, st_n, ch_n))
    _plain(len(counts) == n_tx + n_rel + len(ev_id) + len(st_id))
    rid, begin = _summed(ids), _summed(begins)
    _plain(bool((durations <= np.uint64(LONG_MAX) - begin.astype(np.uint64)).all()) and bool((parents <= np.uint64(LONG_MAX)).all()))
    end = (begin.astype(np.uint64) + durations).view(np.int64)
    state = np.frombuffer(states, np.uint8)
    _plain(bool(((state & 15 <= 4) & (state >> 4 <= 5)).all()))
    event_id, stage_id = _summed(ev_id), _summed(st_id)
    small = lambda c: not len(c) or np.abs(c.astype(np.float64)).max() < 2.0**61
    _plain(small(ev_time) and small(st_begin) and small(rel_to) and small(begin))
    event_at, stage_at = np.repeat(begin, ev_n) + ev_time, np.repeat(begin, st_n) + st_begin
    source = _summed(rel_from)
    target = source + rel_to
    open_end = st_end == 0
    _plain(small(st_end) and small(stage_at) and all(not len(c) or c.min() >= 0 for c in (event_at, stage_at, target)))
    _plain(not len(ch_block) or ch_block.min() > 0)
    kind_of = [kinds[g] for g in generators]
    sequences = [t in d.types and d.types[t].kind == 3 and d.types[t].element == 5 for _, t in kind_of]
    _plain(all(q or t == 0 for q, (_, t) in zip(sequences, kind_of, strict=True)))
    place = gens.astype(np.int64)
    payload = _payload_texts(words, np.array(sequences, bool)[place] if n_tx else np.zeros(0, bool))
    nothing = lambda n: _ragged(np.zeros(n, np.int64), pa.array([], ATTRIBUTES.value_type))
    blocks = lambda n: pa.array(np.full(n, block, np.int64))
    if table == "relations":
        return [_texts(rel_kind, d), pa.array(source, mask=source == 0), pa.array(target, mask=target == 0), nothing(n_rel), blocks(n_rel)]
    if table == "embedded":
        # of each transaction the events, then the stages
        n, m = len(event_id), len(stage_id)
        order = pa.array(np.argsort(np.append(2 * np.repeat(np.arange(n_tx), ev_n), 2 * np.repeat(np.arange(n_tx), st_n) + 1), kind="stable"))
        until = pa.concat_arrays([pa.array(event_at), pa.array(np.where(open_end, 0, stage_at + st_end.astype(np.int64) - 1), mask=open_end)])
        both = [
            pa.array(np.append(event_id, stage_id)), pa.array(["event", "stage"]).take(pa.array(np.repeat([0, 1], [n, m]))), pa.array(np.append(np.repeat(rid, ev_n), np.repeat(rid, st_n))),
            pa.concat_arrays([_texts(ev_name, d), _texts(st_name, d)]), pa.concat_arrays([pa.nulls(n, pa.string()), _texts(st_lane, d)]), pa.array(np.append(event_at, stage_at)), until,
        ]
        return [*(c.take(order) for c in both), nothing(n + m), blocks(n + m)]
    of = lambda v, t: pa.array(v, t).take(pa.array(place))
    _texts(np.concatenate((ev_name, st_name, st_lane, rel_kind)), d)
    first = np.cumsum(ch_n) - ch_n
    child = np.cumsum(ch_block.astype(np.int64))
    _plain(small(ch_block) and ch_block.sum(dtype=np.float64) < 2.0**62)
    child -= np.repeat(np.append(0, child)[first], ch_n)
    return [
        pa.array(rid), of(["clock" if k == "CLOCK" else "transaction" for k, _ in kind_of], pa.string()), pa.array(rid - parents.astype(np.int64), mask=parents == 0), of(generators, pa.int64()),
        pa.array(begin), pa.array(end), pa.array((state & 15).astype(np.int32)), pa.array((state >> 4).astype(np.int32)), payload, nothing(n_tx), _ragged(ch_n, pa.array(child)), blocks(n_tx),
    ]


def transaction_columns(data: bytes, d: Declarations, kinds: dict[int, tuple[str, int]], table: str) -> list[list]:
    """The columns of a table of a block, of each of its pages."""
    c = Cursor(data)
    block, n_tx, n_rel = c.fixed(8), c.fixed(8), c.fixed(8)
    c.take(96)
    n_gen, n_pages = c.fixed(4), c.fixed(4)
    generators = [c.fixed(4) for _ in range(n_gen)]
    _plain(all(g in kinds for g in generators))
    heads, counts = [], []
    for _ in range(n_pages):
        counts.append((c.fixed(8), c.fixed(8)))
        c.take(96)
        heads.append((c.fixed(4), c.fixed(4), c.fixed(4)))
    _plain(sum(t for t, _ in counts) == n_tx and sum(r for _, r in counts) == n_rel and block <= LONG_MAX)
    out = []
    for (tx, rel), page in zip(counts, _pages(data, c.at, heads), strict=True):
        _plain(page[0] != 2)
        out.append(general_columns(page, tx, rel, generators, d, kinds, block, table))
    return out


# --- Spark source ------------------------------------------------------------------------------

_ATTRS = "array<struct<key string, tag string, value string>>"
ATTRIBUTES = pa.list_(pa.struct([(c, pa.string()) for c in ("key", "tag", "value")]))
TABLES = {
    "recording": "identity string, fingerprint string, completion string, dropped_bytes long, timescale int, time_zero long, file_type int, writer string, date string, comment string",
    "sections": "section int, kind string, bytes long, aux0 long, aux1 long, block long",
    "strings": "id int, text string",
    "interned": "id int, tag string, value string",
    "datatypes": f"datatype_id int, kind int, name string, fields array<struct<name string, type int>>, element int, count long, literals array<struct<value long, name string>>, attributes {_ATTRS}",
    "nodes": f"node_id long, parent_id long, node_kind string, name string, code int, signal_id long, gen_kind string, payload_type int, attributes {_ATTRS}",
    "signals": "signal_id long, encoding string, width int, states int",
    "blackouts": "seq long, time long, active boolean",
    "time_steps": "time long",
    "changes": "signal_id long, time long, seq long, text string, real double",
    "transactions": f"id long, kind string, parent long, generator long, begin long, end long, status int, span_kind int, payload string, attributes {_ATTRS}, child_blocks array<long>, block long",
    "embedded": f"id long, kind string, owner long, name string, lane string, begin long, end long, attributes {_ATTRS}, block long",
    "relations": f"kind string, source long, destination long, attributes {_ATTRS}, block long",
    "located": "id long, kind string, generator long, datatype_id int, begin long, end long, parent long, payload string, block long",
}
_SECTIONS = {"changes": SIGNAL_BLOCK, "time_steps": SIGNAL_BLOCK, "transactions": TX_BLOCK, "embedded": TX_BLOCK, "relations": TX_BLOCK, "located": RECORD_BLOCK}


@dataclass
class Part(InputPartition):
    """A data section with the declarations that stand before it, or the whole catalogue."""

    section: Section | None
    cat: Catalogue

    def __init__(self, section: Section | None, cat: Catalogue):
        super().__init__(section.index if section else -1)
        self.section, self.cat = section, cat


#: Declarations by file and section, kept by each process: many sections share them.
_known: dict[tuple, Declarations] = {}


def _declared(path: str, cat: Catalogue, before: int, checked: bool) -> Declarations:
    """Declarations of the sections before a data section, decoded once a process."""
    last = max((s.index for s in cat.sections if s.index < before and s.kind in (META, STRINGS, HIERARCHY, DATATYPES, VALUES)), default=-1)
    key = (path, cat.identity, cat.fingerprint, last, checked)
    if key not in _known:
        if len(_known) > 8:
            _known.clear()
        _known[key] = declarations(path, cat, last + 1, checked)
    return _known[key]


def _arrow(table: str) -> pa.Schema:
    """The Arrow schema of a table, from its DDL of longs, ints, texts, and lists of them or of structures."""
    plain = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}

    def kind(ddl: str) -> pa.DataType:
        if ddl.startswith("array<"):
            return pa.list_(kind(ddl[6:-1]))
        if ddl.startswith("struct<"):
            return pa.struct([(f.split()[0], kind(f.split()[1])) for f in ddl[7:-1].split(", ")])
        return plain[ddl]

    fields, depth, at = [], 0, 0
    ddl = TABLES[table] + ","
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, _, t = ddl[at:i].strip().partition(" ")
            fields.append((name, kind(t)))
            at = i + 1
    return pa.schema(fields)


_BOUNDS = {"changes": ("time", "time"), "time_steps": ("time", "time"), "transactions": ("begin", "end"), "located": ("begin", "end")}
#: Rows of a batch.
BATCH = 65_536


class TraceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "transactions")
        if self.table not in TABLES:
            raise ValueError(f"no table {self.table!r}")
        self.prefix = options.get("mode", "PREFIX").upper() == "PREFIX"
        self.checked = options.get("checksums", "true").lower() == "true"
        self.limit = int(options.get("payloadLimit", 1 << 62))
        self.after, self.before, self.signals = None, None, None

    def pushFilters(self, filters):
        """Bounds of time prune sections, and signals prune columns; every filter is applied to the
        rows by Spark too."""
        begin, end = _BOUNDS.get(self.table, (None, None))
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if isinstance(f, GreaterThanOrEqual | GreaterThan | EqualTo) and name is not None and name == end:
                self.after = value if self.after is None else max(self.after, value)
            if isinstance(f, LessThanOrEqual | LessThan | EqualTo) and name is not None and name == begin:
                self.before = value if self.before is None else min(self.before, value)
            if self.table == "changes" and name == "signal_id" and isinstance(f, EqualTo | In):
                asked = {value} if isinstance(f, EqualTo) else set(value)
                self.signals = asked if self.signals is None else self.signals & asked
            yield f

    def partitions(self):
        cat = catalogue(self.path, self.prefix)
        kind = _SECTIONS.get(self.table)
        if kind is None:
            return [Part(None, cat)]
        found = [s for s in cat.sections if s.kind == kind]
        found = [s for s in found if (self.after is None or s.aux1 >= self.after) and (self.before is None or s.aux0 <= self.before)]
        slim = Catalogue(cat.identity, [s for s in cat.sections if s.kind in (META, STRINGS, HIERARCHY, DATATYPES, VALUES)], cat.completion, cat.dropped_bytes, cat.fingerprint)
        return [Part(s, slim) for s in found] or [Part(None, slim)]

    def read(self, partition: Part) -> Iterator:
        if self.table in _SECTIONS:
            if partition.section is not None:
                need(partition.section.length <= self.limit, "payload exceeds the limit")
                yield from self._data(partition.section, partition.cat)
            return
        yield from self._small(partition.cat)

    def _data(self, s: Section, cat: Catalogue) -> Iterator[pa.RecordBatch]:
        d = _declared(self.path, cat, s.index, self.checked)
        with open_file(self.path) as f:
            data = payload_of(f, s, self.checked)
        if s.kind == SIGNAL_BLOCK:
            times = np.array([long(t) for t in block_times(data)], np.int64)
            if self.table == "time_steps":
                yield pa.RecordBatch.from_arrays([pa.array(times)], ["time"])
                return
            held, n = [], 0
            names = ["signal_id", "time", "seq", "text", "real"]
            for signal, at, text, real in signal_columns(data, d, self.signals):
                need(not len(at) or at[-1] < len(times), "time index")
                k = len(at)
                held.append((pa.array(np.full(k, signal, np.int64)), pa.array(times[at]), pa.array((s.index << 40) + np.arange(k)), text, real))
                n += k
                if n >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], names)
                    held, n = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], names)
            return
        kinds = {n["node_id"]: (n["gen_kind"], n["payload_type"]) for n in d.nodes if n["node_kind"] == "generator"}
        schema = _arrow(self.table)
        if s.kind == TX_BLOCK:
            try:
                pages = transaction_columns(data, d, kinds, self.table)
            except (_Unusual, ValueError, ArithmeticError, IndexError):
                pages = None
            if pages is not None:
                for columns in pages:
                    whole = pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
                    yield from (whole.slice(i, BATCH) for i in range(0, whole.num_rows, BATCH))
                return
        rows = getattr((transaction_block if s.kind == TX_BLOCK else record_block)(data, d, kinds), self.table)
        for i in range(0, len(rows), BATCH):
            columns = zip(*rows[i : i + BATCH], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    def _small(self, cat: Catalogue) -> Iterator[tuple]:
        if self.table == "sections":
            for s in cat.sections:
                yield s.index, SECTION_KIND.get(s.kind, "optional"), s.length + 24, min(s.aux0, LONG_MAX), min(s.aux1, LONG_MAX), s.block
            return
        if self.table == "blackouts":
            with open_file(self.path) as f:
                n = 0
                for s in cat.sections:
                    if s.kind == BLACKOUT:
                        c, time = Cursor(payload_of(f, s, self.checked)), 0
                        for _ in range(c.varint()):
                            active = c.byte()
                            need(active < 2, "bad blackout")
                            time += c.varint()
                            yield n, long(time), bool(active)
                            n += 1
                        c.done()
            return
        d = declarations(self.path, cat, None, self.checked)
        if self.table == "recording":
            m = d.metadata
            yield cat.identity, cat.fingerprint, cat.completion, cat.dropped_bytes, *(m.get(k) for k in ("timescale", "time_zero", "file_type", "writer", "date", "comment"))
        elif self.table == "strings":
            yield from enumerate(d.strings)
        elif self.table == "interned":
            yield from ((i, tag, json.dumps(v)) for i, (tag, v) in enumerate(d.values))
        elif self.table == "datatypes":
            yield from ((i, t.kind, t.name, [{"name": n, "type": f} for n, f in t.fields], t.element, t.count, [{"value": v, "name": n} for v, n in t.literals], t.attributes) for i, t in d.types.items())
        elif self.table == "signals":
            yield from ((i, *s) for i, s in enumerate(d.signals))
        else:
            for n in d.nodes:
                yield tuple(n[k] for k in ("node_id", "parent_id", "node_kind", "name", "code", "signal_id", "gen_kind", "payload_type", "attributes"))


class TraceStream(DataSourceStreamReader):
    """Follows a recording that is still written: each micro-batch reads the data sections that have become
    whole since the last one."""

    def __init__(self, options: dict):
        self.inner = TraceReader(options)
        if self.inner.table not in _SECTIONS:
            raise ValueError("only tables of data sections can be followed")

    def _sections(self) -> Catalogue:
        return catalogue(self.inner.path)

    def initialOffset(self) -> dict:
        return {"sections": 0}

    def latestOffset(self) -> dict:
        return {"sections": len(self._sections().sections)}

    def partitions(self, start: dict, end: dict):
        kind = _SECTIONS[self.inner.table]
        return [p for p in self.inner.partitions() if p.section is not None and p.section.kind == kind and start["sections"] <= p.section.index < end["sections"]]

    def read(self, partition: Part) -> Iterator:
        yield from self.inner.read(partition)

    def commit(self, end: dict) -> None:
        pass


def payload_ddl(datatypes: dict[int, tuple], t: int) -> str:
    """The Spark type of a payload, for `from_json`: datatypes by id as (kind, fields, element)."""
    if t < FIRST_DECLARED_TYPE:
        return _DDL.get(t, "string")
    kind, fields, element = datatypes[t]
    if kind == 1:
        return "struct<" + ", ".join(f"`{f['name']}`: {payload_ddl(datatypes, f['type'])}" for f in fields) + ">"
    if kind in (2, 3):
        return f"array<{payload_ddl(datatypes, element)}>"
    return "struct<value: bigint, name: string>"


# Spark types of the plain types by id; others are text.
_DDL = {1: "boolean", 2: "tinyint", 3: "smallint", 4: "int", 5: "bigint", 6: "smallint", 7: "int", 8: "bigint", 9: "decimal(20,0)", 10: "float", 11: "double", 18: "bigint", 20: "decimal(20,0)",
        21: "struct<raw: bigint, scale: bigint>", 22: "struct<raw: decimal(20,0), scale: bigint>"}


class TraceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tickloom"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "transactions")]

    def reader(self, schema) -> TraceReader:
        return TraceReader(self.options)

    def streamReader(self, schema) -> TraceStream:
        return TraceStream(self.options)


def register(spark: SparkSession) -> None:
    """Make spark.read.format("tickloom") known, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TraceSource)
