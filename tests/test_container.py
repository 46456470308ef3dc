"""The binary container, against bytes laid out here by the format's rules."""

import json
import struct

import pyarrow as pa
import pytest

from tickloom.sources import container as C


def vint(v):
    out = b""
    while v > 127:
        out, v = out + bytes([v & 127 | 128]), v >> 7
    return out + bytes([v])


def sint(v):
    return vint((v << 1) ^ (v >> 63) if v >= 0 else ((-v) << 1) - 1)


def blob(b):
    return vint(len(b)) + b


def packed(b, codec=0):
    body = b if codec == 0 else pa.compress(b, codec="lz4_raw" if codec == 1 else "zstd", asbytes=True)
    return bytes([codec]) + vint(len(b)) + body


STRINGS = ["", "top", "clk", "bus", "t", "name", "REQUEST", "k", "v", "stage", "lane", "rel", "STAGE", "LOG", "CLOCK"]
ID = bytes(range(1, 17))


def strings(codec=0):
    return C.STRINGS, packed(vint(0) + vint(len(STRINGS)) + b"".join(blob(s.encode()) for s in STRINGS), codec)


META = (C.META, vint(1) + sint(-9) + sint(0) + bytes([0]) + blob(b"w") + blob(b"d") + blob(b"") + vint(4) + vint(0))
# datatype 23: structure {t: text, k: u8}; 24: sequence of it; 25: enumeration over i8
TYPES = (C.DATATYPES, vint(23) + vint(3) + b"\x01" + blob(b"P") + vint(2) + blob(b"t") + vint(13) + blob(b"k") + vint(6)
         + b"\x83" + blob(b"S") + vint(23) + vint(1) + vint(7) + bytes([12]) + vint(8)
         + b"\x04" + blob(b"E") + vint(2) + vint(1) + struct.pack("<q", -1) + blob(b"low"))


def nodes(codec=0):
    none = vint(0)
    n = [
        b"\x01" + vint(0) + vint(1) + vint(0) + vint(0) + none,  # 0 scope top
        b"\x02" + vint(1) + vint(2) + vint(16) + b"\x00" + vint(0) + b"\x01\x01" + vint(1) + none,  # 1 clk, 4-state, width 1
        b"\x02" + vint(2) + vint(3) + vint(16) + b"\x00" + vint(0) + b"\x01\x01" + vint(4) + none,  # 2 bus, width 4
        b"\x02" + vint(3) + vint(4) + vint(3) + b"\x00" + vint(0) + b"\x01\x03" + none,  # 3 real
        b"\x02" + vint(4) + vint(5) + vint(65) + b"\x00" + vint(0) + b"\x01\x04" + none,  # 4 bytes
        b"\x02" + vint(5) + vint(5) + vint(16) + b"\x00" + vint(4) + b"\x00" + vint(1) + vint(7) + bytes([13]) + blob(b"alias"),  # 5 alias of clk
        b"\x03" + vint(6) + vint(5) + vint(6) + vint(23) + none,  # 6 REQUEST
        b"\x03" + vint(7) + vint(5) + vint(12) + vint(0) + none,  # 7 STAGE
        b"\x03" + vint(8) + vint(5) + vint(13) + vint(0) + none,  # 8 LOG
    ]
    return C.HIERARCHY, packed(vint(0) + vint(len(n)) + b"".join(n), codec)


def wave(codec=0, xform=0):
    times = [0, 5, 7]
    table = packed(vint(0) + vint(5) + vint(2), codec)
    clk = vint(0 << 5 | 0 << 1 | 1) + vint(1 << 1) + vint(1 << 1) + vint(0 << 5 | 2 << 1 | 1)  # 0, 1, 0, then x in one tick
    full = 1
    values = bytes([0b11_10_01_00]) + bytes([0b00_01_10_11])  # zx10, 01xz
    if xform == 4:
        values = vint(2) + values + bytes([0, 1])
    elif xform == 2:
        values = values[:1] + bytes([(values[1] - values[0]) % 256])
    bus = vint(len(head := vint(0 << 1) + vint(2 << 1)) << 2 | 1 << 1 | full) + head + values
    raw = struct.pack("<dd", 1.5, -0.0)
    if xform == 1:
        raw = bytes(raw[i * 8 + b] for b in range(8) for i in range(2))
    real = vint(2 << 2 | 1 << 1) + vint(0) + vint(1) + (raw if xform in (0, 1) else vint(0) + raw if xform == 4 else struct.pack("<Q", struct.unpack("<Q", struct.pack("<d", 1.5))[0]) + struct.pack("<Q", (struct.unpack("<Q", struct.pack("<d", -0.0))[0] - struct.unpack("<Q", struct.pack("<d", 1.5))[0]) % 2**64))
    text = vint(1 << 2) + vint(2) + blob("hé".encode())
    columns = [clk, bus, real, text]
    run = packed(b"".join(vint(len(c)) for c in columns) + b"".join(columns), codec)
    group = vint(4) + vint(0) + blob(packed(bytes(4), codec)) + vint(1) + vint(4) + bytes([xform]) + vint(len(run)) + run
    head = struct.pack("<QQIIIIII", times[0], times[-1], 3, 4, 4, 1, 1, len(table))
    return C.SIGNAL_BLOCK, head + table + struct.pack("<IIQ", 0, len(group), 0) + struct.pack("<I", 0xFFFFFFFF) + group


def general(codec=0):
    """Transactions 10 (with a stage, an event, attributes, child blocks) and 20 (parent 10), a relation."""
    cols = [b""] * 33
    cols[0] = sint(10) + sint(10)
    cols[1] = vint(0) * 2
    cols[2] = sint(100) + sint(-60)
    cols[3] = vint(7) + vint(0)
    cols[4] = bytes([1, 2 << 4 | 3])
    cols[5] = vint(0) + vint(10)
    cols[6] = vint(2) + vint(0) + vint(1) + vint(0) + vint(0)  # of 10, its event, its stage, of 20, of the relation
    cols[7], cols[8] = vint(7) + vint(8) + vint(7), bytes([5, 23, 11])
    cols[9], cols[10], cols[12] = sint(-4), struct.pack("<d", 0.5), vint(2) + bytes([1, 1]) + bytes([0])
    cols[13], cols[14], cols[15] = vint(1) + vint(0), sint(-3), vint(5)
    cols[16], cols[17], cols[18], cols[19], cols[20] = vint(1) + vint(0), vint(9), vint(10), sint(2), vint(0)
    cols[21], cols[22], cols[23] = vint(11), sint(20), sint(-10)
    cols[24] = vint(200) + vint(1)  # field k of both payloads
    cols[26], cols[27] = vint(0) + vint(0), vint(1 << 1) + blob("tö".encode())
    cols[29], cols[30] = vint(2) + vint(0), vint(3) + vint(2)
    cols[31], cols[32] = sint(11), sint(12)
    page = vint(33) + b"".join(vint(len(c)) for c in cols) + b"".join(cols)
    body = packed(page, codec)
    bounds = struct.pack("<QQQQQQQQQQQQ", 10, 20, 40, 107, 10, 10, 11, 12, 20, 20, 10, 10)
    return C.TX_BLOCK, struct.pack("<QQQ", 9, 2, 1) + bounds + struct.pack("<III", 1, 1, 6) + struct.pack("<QQ", 2, 1) + bounds + struct.pack("<III", 0, len(body), len(page)) + body


def scalar():
    """A page of byte planes for two transactions of generator 6 with an empty payload type 0."""
    cols = [[1, 300], [0, 0], [5, 70_000], [1, 0], [0, 1], [1, 4]]
    out = b""
    for c in cols:
        width = (max(c).bit_length() + 7) // 8
        out += bytes([width]) + b"".join(bytes(v >> 8 * j & 255 for v in c) for j in range(width))
    return b"\x02" + struct.pack("<II", 26, 2) + out


def located():
    """A stage segment and a log segment on one page."""
    stage = [sint(5) + sint(-2), sint(30) + sint(1), sint(10) + sint(0), vint(4) + vint(0), b"", b"", b"", vint(0), b""]
    log = [sint(50), sint(40), vint(0), b"", vint(3), b"", vint(0), vint(1 << 1) + blob(b"hi"), b""]
    sets = [vint(9) + b"".join(vint(len(c)) for c in cs) + b"".join(cs) for cs in (stage, log)]
    page = b"".join(sets)
    body = packed(page)
    q = lambda *v: struct.pack(f"<{len(v)}Q", *v)
    seg = struct.pack("<IIIII", 7, 0, 2, 0, len(sets[0])) + q(30, 31, 10, 10, 5, 9) + struct.pack("<IIIIII", 8, 23, 0, 1, len(sets[0]), len(sets[1])) + q(40, 40, 0, 0, 50, 50)
    return C.RECORD_BLOCK, q(4, 3, 30, 40, 5, 50) + struct.pack("<II", 2, 1) + seg + struct.pack("<III", 0, len(body), len(page)) + body


BLACKOUT = (C.BLACKOUT, vint(2) + b"\x00" + vint(3) + b"\x01" + vint(2))


def recording(path, codec=0, xform=0, **more):
    C.write_sections(str(path), ID, [strings(codec), META, TYPES, nodes(codec), BLACKOUT, wave(codec, xform), general(codec), located()], **more)
    return str(path)


@pytest.fixture(scope="module")
def source(spark):
    C.register(spark)
    return lambda path, table, **o: spark.read.format("tickloom").options(table=table, **o).load(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(("codec", "xform"), [(0, 0), (1, 1), (2, 2), (1, 4), (0, 2)])
def test_waveforms_of_every_codec_and_transform(spark, source, tmp_path, codec, xform):
    path = recording(tmp_path / "a", codec, xform)
    got = sorted(rows(source(path, "changes").select("signal_id", "time", "text", "real", "seq")), key=lambda r: (r[0], r[4]))
    assert [r[:4] for r in got] == [
        (0, 0, "0", None), (0, 5, "1", None), (0, 7, "0", None), (0, 7, "x", None), (1, 0, "zx10", None), (1, 7, "01xz", None), (2, 0, None, 1.5), (2, 5, None, -0.0), (3, 7, "hé", None),
    ]
    assert sorted(r[0] for r in rows(source(path, "time_steps"))) == [0, 5, 7]


def test_declarations(source, tmp_path):
    path = recording(tmp_path / "a")
    m = source(path, "recording").first()
    assert (m["identity"], m["completion"], m["dropped_bytes"], m["timescale"], m["writer"]) == (ID.hex(), "complete", 0, -9, "w")
    assert rows(source(path, "strings"))[1] == (1, "top")
    n = {r["node_id"]: r for r in source(path, "nodes").collect()}
    assert n[5]["signal_id"] == n[1]["signal_id"] == 0 and n[5]["attributes"][0]["value"] == '"alias"' and n[0]["parent_id"] is None and n[2]["parent_id"] == 0
    assert rows(source(path, "signals")) == [(0, "bits", 1, 4), (1, "bits", 4, 4), (2, "real", 0, 2), (3, "bytes", 0, 2)]
    t = {r["datatype_id"]: r for r in source(path, "datatypes").collect()}
    assert t[24]["attributes"][0]["key"] == "k" and t[23]["name"] == "P"
    assert rows(source(path, "blackouts")) == [(0, 3, False), (1, 5, True)]
    assert [r["kind"] for r in source(path, "sections").collect()] == ["STRINGS", "META", "DATATYPES", "HIERARCHY", "BLACKOUT", "SIGNAL_BLOCK", "TX_BLOCK", "RECORD_BLOCK"]


@pytest.mark.parametrize("codec", [0, 1, 2])
def test_records(source, tmp_path, codec):
    path = recording(tmp_path / "a", codec)
    tx = {r["id"]: r for r in source(path, "transactions").collect()}
    assert (tx[10]["begin"], tx[10]["end"], tx[10]["status"], tx[10]["parent"], list(tx[10]["child_blocks"])) == (100, 107, 1, None, [3, 5])
    assert (tx[20]["begin"], tx[20]["end"], tx[20]["status"], tx[20]["span_kind"], tx[20]["parent"]) == (40, 40, 3, 2, 10)
    assert json.loads(tx[10]["payload"]) == {"t": "tö", "k": 200} and json.loads(tx[20]["payload"]) == {"t": "tö", "k": 1}
    assert [(a["key"], a["tag"], a["value"]) for a in tx[10]["attributes"]] == [("k", "i64", "-4"), ("v", "list", "[true, null]")]
    emb = {r["id"]: r for r in source(path, "embedded").collect()}
    assert (emb[11]["kind"], emb[11]["owner"], emb[11]["begin"], emb[11]["name"]) == ("event", 10, 97, "name")
    assert (emb[12]["begin"], emb[12]["end"], emb[12]["lane"], emb[12]["attributes"][0]["value"]) == (102, None, "lane", "0.5")
    assert rows(source(path, "relations").select("kind", "source", "destination")) == [("rel", 20, 10)]
    got = sorted(rows(source(path, "located").select("id", "kind", "begin", "end", "parent", "payload")))
    assert got == [(30, "stage", 5, 9, 10, "null"), (31, "stage", 7, 7, 10, "null"), (40, "log", 50, 50, None, '{"t": "hi", "k": 3}')]


def test_time_bounds_prune_sections(source, tmp_path):
    path = recording(tmp_path / "a")
    assert source(path, "transactions").filter("begin <= 50 and end >= 40").count() == 1
    assert source(path, "transactions").filter("begin <= 39").count() == 0
    assert source(path, "changes").filter("time >= 7").count() == 4 and source(path, "changes").filter("time >= 8").count() == 0
    assert source(path, "changes").filter("signal_id = 1").count() == 2 and source(path, "changes").filter("signal_id in (2, 3)").count() == 3
    r = C.TraceReader({"path": path, "table": "changes"})
    list(r.pushFilters([C.GreaterThanOrEqual(("time",), 8)]))
    assert [p.section for p in r.partitions()] == [None]


def test_scalar_pages():
    d = C.Declarations(strings=STRINGS)
    d.types[26] = C.Datatype(1, "empty")
    out = C.Records()
    C._scalar_page(scalar(), 2, [6], d, {6: ("REQUEST", 26)}, 7, out)
    assert [t[:8] for t in out.transactions] == [(1, "transaction", None, 6, 5, 6, 1, 0), (300, "transaction", 1, 6, 70_000, 70_000, 4, 0)]
    d.types[27] = C.Datatype(2, "a", element=9, count=2)
    assert C._words(27, d) == 2 and C._scalar_value(27, d, iter([1, 2])) == [1, 2]


def test_prefixes_recovery_and_no_clobber(source, tmp_path):
    path = recording(tmp_path / "a")
    whole = open(path, "rb").read()
    sections = C.catalogue(path).sections
    for cut in (sections[-1].offset + 30, sections[-1].offset + 3, len(whole) - 1):
        part = tmp_path / f"cut{cut}"
        part.write_bytes(whole[:cut])
        cat = C.catalogue(str(part))
        assert cat.completion == "unfinished" and len(cat.sections) == len(sections) - (cut < sections[-1].offset + 100)
        with pytest.raises(C.Corrupt):
            C.catalogue(str(part), prefix=False)
        assert source(str(part), "transactions").count() == 2
        dropped = C.recover(str(part), str(tmp_path / f"fixed{cut}"))
        again = C.catalogue(str(tmp_path / f"fixed{cut}"))
        assert again.completion == "incomplete" and again.dropped_bytes == dropped == cut - (cat.sections[-1].offset + 24 + cat.sections[-1].length)
    C.recover(path, str(tmp_path / "copy"))
    assert open(tmp_path / "copy", "rb").read() == whole
    with pytest.raises(FileExistsError):
        C.recover(path, str(tmp_path / "copy"))


def test_malformed_recordings_are_errors(tmp_path):
    path = recording(tmp_path / "a")
    data = bytearray(open(path, "rb").read())
    s = C.catalogue(path).sections[0]
    data[s.offset + 30] ^= 1
    (tmp_path / "b").write_bytes(data)
    with pytest.raises(C.Corrupt):
        C.declarations(str(tmp_path / "b"))
    for bad in (b"", b"XYZ" * 20, bytes(data[:8]) + b"\x04\x00" + bytes(data[10:])):
        (tmp_path / "c").write_bytes(bad)
        with pytest.raises(C.Corrupt):
            C.catalogue(str(tmp_path / "c"))
    d = C.Declarations(strings=STRINGS)
    for stream in (b"\x1a", b"\x01\x02", b"\x02" + sint(200), b"\x0c" + vint(99), b"\x19" + vint(0), b"\x0d" + blob(b"\xff"), b"\x06"):
        with pytest.raises(C.Corrupt):
            C.read_value(C.Cursor(stream), d)
    with pytest.raises(C.Corrupt):
        C.read_types(C.Cursor(vint(23) + vint(1) + b"\x03" + blob(b"") + vint(24)), C.Declarations(strings=STRINGS))
    with pytest.raises(OverflowError):
        C.long(2**63)
    with pytest.raises(C.Corrupt):
        C.unpack(3, 2, b"\xff")


def test_tables_of_a_recording_without_data(source, tmp_path):
    C.write_sections(str(tmp_path / "e"), ID, [strings(), META])
    for table in ("changes", "transactions", "located", "relations", "nodes", "blackouts"):
        assert source(str(tmp_path / "e"), table).count() == 0
