"""Recordings written and read again, with nulls, every kind of signal, several blocks and empty tables."""

import random
from threading import Barrier

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom import api, cli
from tickloom.sources import container as C
from tickloom.sources import recording as R

NODES = "node_id long, parent_id long, node_kind string, name string, signal_id long, gen_kind string"
KINDS = [("bits", 1, 2), ("bits", 1, 9), ("bits", 9, 2), ("bits", 5, 4), ("bits", 13, 9), ("real", 0, 2), ("bytes", 0, 2)]


def nodes(spark, signals=len(KINDS)):
    rows = [(0, None, "scope", "top", None, None), (1, 0, "generator", "req", None, "REQUEST"), (2, 0, "generator", "st", None, "STAGE"), (3, 0, "generator", "lg", None, "LOG"), (4, 0, "generator", "ev", None, "EVENT")]
    rows += [(5 + i, 0, "variable", f"s{i}", i, None) for i in range(signals)] + [(5 + signals, 0, "variable", "alias", 2, None)]
    return spark.createDataFrame(rows, NODES)


def signals(spark):
    return spark.createDataFrame([(i, *k) for i, k in enumerate(KINDS)], "signal_id long, encoding string, width int, states int")


def waves(n=900):
    rng, rows = random.Random(3), []
    for seq in range(n):
        s = rng.randrange(len(KINDS))
        encoding, width, states = KINDS[s]
        text = "".join(rng.choice("01" if states == 2 or rng.random() < 0.5 else "01xz" if states == 4 else "01xzuwlh-") for _ in range(width)) if encoding == "bits" else "é\n" * rng.randrange(3)
        rows.append((s, rng.randrange(0, 400), seq, None if encoding == "real" else text, rng.choice([0.0, -0.0, 1.5, float("inf")]) if encoding == "real" else None))
    return rows


def read(spark, path, table):
    C.register(spark)
    return spark.read.format("tickloom").option("table", table).load(path)


@pytest.mark.parametrize("rows_per_block", [10**9, 200])
def test_waveforms_of_every_kind(spark, tmp_path, monkeypatch, rows_per_block):
    monkeypatch.setattr(R, "CHANGE_ROWS", rows_per_block)
    monkeypatch.setattr(R, "GROUP", 3)
    rows = waves()
    changes = spark.createDataFrame(rows, "signal_id long, time long, seq long, text string, real double")
    path = str(tmp_path / "w")
    R.write_recording(spark, path, {"nodes": nodes(spark), "signals": signals(spark), "changes": changes})
    got = {}
    for r in read(spark, path, "changes").orderBy("signal_id", "time", "seq").collect():
        got.setdefault(r["signal_id"], []).append((r["time"], r["text"], str(r["real"])))
    want = {}
    for s, t, _, text, real in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want.setdefault(s, []).append((t, text, str(real)))
    assert got == want
    blocks = [s for s in C.catalogue(path).sections if s.kind == C.SIGNAL_BLOCK]
    assert len(blocks) == (1 if rows_per_block > 1000 else 5)
    assert read(spark, path, "changes").filter("signal_id = 4 and time >= 200").count() == sum(t >= 200 for t, *_ in want[4])
    value = api.read_trace(spark, path).value("top.alias", 123).first()["value"]
    before = [text for t, text, _ in want[2] if t <= 123]
    assert value == (before[-1] if before else "0" * 9)


def test_frames_hold_the_values_before_a_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "CHANGE_ROWS", 2)
    rows = [(0, 0, 0, "1", None), (2, 1, 1, "000000101", None), (0, 10, 2, "0", None), (2, 11, 3, "000000111", None)]
    path = str(tmp_path / "f")
    R.write_recording(spark, path, {"nodes": nodes(spark), "signals": signals(spark), "changes": spark.createDataFrame(rows, "signal_id long, time long, seq long, text string, real double")})
    with open(path, "rb") as f:
        data = [C.payload_of(f, s) for s in C.catalogue(path).sections if s.kind == C.SIGNAL_BLOCK]
    assert len(data) == 2
    frames, previous = [], []
    for d in data:
        c = C.Cursor(d, 36)
        c.take(c.fixed(4))
        c.take(16)
        previous.append(c.fixed(4))
        g = C.Cursor(d, c.at)
        g.varint(), g.varint()
        frames.append(C.decompress(g.blob()))
    assert previous == [R.NONE, 0]
    assert frames[0][:4] == bytes([0, 2, 0, 0]) and frames[1][:4] == bytes([1, 2, 5, 0])  # defaults, then 1, x, 5


@pytest.mark.parametrize("rows_per_block", [10**9, 7])
def test_records_and_their_blocks(spark, tmp_path, monkeypatch, rows_per_block):
    monkeypatch.setattr(R, "TX_ROWS", rows_per_block)
    monkeypatch.setattr(R, "RECORD_ROWS", rows_per_block)
    tx = spark.createDataFrame(
        [(i * 10, i * 10 - 10 if i % 3 == 0 and i > 1 else None, 1, 500 - i, 500 - i + i % 4 * 2**40, i % 5, i % 6, None if i % 4 == 0 else [i, -i, 2**62]) for i in range(1, 41)],
        "id long, parent long, generator long, begin long, end long, status int, span_kind int, payload array<long>")
    inside = spark.createDataFrame([(11, "stage", 10, "a", None, 498, None), (12, "event", 10, None, None, 0, 0), (13, "stage", 10, "b", "L", 700, 700), (999, "stage", 998, "c", "L", 1, 2)],
                                   "id long, kind string, owner long, name string, lane string, begin long, end long")
    rel = spark.createDataFrame([("k", 10, 20), ("k", 10, 20), (None, None, 10), ("z", 2**60, None)], "kind string, source long, destination long")
    located = spark.createDataFrame([(1000 + i, ["stage", "event", "log"][i % 3], [2, 4, 3][i % 3], 50 - i, 50 - i + (i if i % 3 == 0 else 0), None if i % 3 == 2 and i % 2 else 10) for i in range(30)],
                                    "id long, kind string, generator long, begin long, end long, parent long")
    path = str(tmp_path / "r")
    R.write_recording(spark, path, {"nodes": nodes(spark, 3), "signals": signals(spark), "transactions": tx, "embedded": inside, "relations": rel, "located": located})
    key = lambda r: tuple(map(str, r))
    got = read(spark, path, "transactions").select("id", "parent", "generator", "begin", "end", "status", "span_kind", F.from_json("payload", "array<bigint>").alias("payload"))
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(*r[:7], r[7] or []) for r in tx.collect()], key=key)
    got = read(spark, path, "embedded").select("id", "kind", "owner", "name", "lane", "begin", "end").collect()
    assert sorted(map(tuple, got), key=key) == [(11, "stage", 10, "a", "", 498, None), (12, "event", 10, "", None, 0, 0), (13, "stage", 10, "b", "L", 700, 700)]
    got = read(spark, path, "relations").select("kind", "source", "destination").collect()
    assert sorted(map(tuple, got), key=key) == sorted([("k", 10, 20), ("k", 10, 20), ("", None, 10), ("z", 2**60, None)], key=key)
    got = read(spark, path, "located").select("id", "kind", "generator", "begin", "end", "parent").collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, located.collect()), key=key)
    trace = api.read_trace(spark, path)
    assert trace.faults().filter("rule = 'child blocks'").count() == 0
    assert trace.missing_blocks(10).count() == 0
    assert trace.payloads(1).filter("id = 20").first()["payload"] == [2, -2, 2**62]
    counts = [s.kind for s in C.catalogue(path).sections].count(C.TX_BLOCK)
    assert counts == (2 if rows_per_block > 100 else 7)


def test_empty_tables_and_no_clobber(spark, tmp_path):
    none = lambda ddl: spark.createDataFrame([], ddl)
    path = str(tmp_path / "e")
    R.write_recording(spark, path, {
        "nodes": none(NODES), "signals": signals(spark).limit(0), "changes": none("signal_id long, time long, seq long, text string, real double"), "blackouts": none("seq long, time long, active boolean"),
        "transactions": none("id long, parent long, generator long, begin long, end long, status int, span_kind int"), "relations": none("kind string, source long, destination long"),
        "located": none("id long, kind string, generator long, begin long, end long, parent long"),
    })
    for table in ("nodes", "changes", "transactions", "relations", "located", "blackouts"):
        assert read(spark, path, table).count() == 0
    assert read(spark, path, "recording").first()["completion"] == "complete"
    with pytest.raises(FileExistsError):
        R.write_recording(spark, path, {})


def test_varints_read_back():
    values = [0, 1, 127, 128, 300, 2**35, 2**63, 2**64 - 1]
    assert C.numbers(R.varints(values)).tolist() == values
    assert C.numbers(b"").tolist() == [] and R.varints([]) == b""
    signed = [0, -1, 1, -(2**63), 2**63 - 1]
    c = C.Cursor(R.svarints(signed))
    assert [c.svarint() for _ in signed] == signed
    with pytest.raises(C.Corrupt):
        C.numbers(b"\x80")


def test_a_growing_file_is_followed(spark, tmp_path):
    tx = spark.createDataFrame([(i, None, 1, i, i, 0, 0) for i in range(1, 31)], "id long, parent long, generator long, begin long, end long, status int, span_kind int")
    whole = str(tmp_path / "w")
    R.TX_ROWS, was = 10, R.TX_ROWS
    try:
        R.write_recording(spark, whole, {"nodes": nodes(spark, 3), "signals": signals(spark), "transactions": tx})
    finally:
        R.TX_ROWS = was
    data = open(whole, "rb").read()
    blocks = [s for s in C.catalogue(whole).sections if s.kind == C.TX_BLOCK]
    growing = tmp_path / "g"
    seen = []
    for cut in (blocks[0].offset + 30, blocks[1].offset + 1, blocks[2].offset, len(data)):
        growing.write_bytes(data[:cut])
        rows = spark.readStream.format("tickloom").option("table", "transactions").load(str(growing)).select("id")
        rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "o")).trigger(availableNow=True).start().awaitTermination()
        seen.append(spark.read.schema("id long").parquet(str(tmp_path / "o")).count())
    assert seen[0] == 0 and 0 < seen[1] < seen[2] < seen[3] == 30


def test_commands(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = [(0, 5, 0, "1", None), (2, 7, 1, "000000101", None), (5, 9, 2, None, 2.5)]
    tx = spark.createDataFrame([(10, None, 1, 3, 8, 1, 0), (20, 10, 1, 4, 6, 0, 0)], "id long, parent long, generator long, begin long, end long, status int, span_kind int")
    located = spark.createDataFrame([(30, "stage", 2, 4, 6, 10), (40, "log", 3, 5, 5, None)], "id long, kind string, generator long, begin long, end long, parent long")
    R.write_recording(spark, path, {"nodes": nodes(spark), "signals": signals(spark), "changes": spark.createDataFrame(rows, "signal_id long, time long, seq long, text string, real double"), "transactions": tx, "located": located})
    ask = lambda *argv: cli.run(spark, [str(a) for a in argv])
    assert ask("value", path, "top.s2", 8) == (0, ["000000101"])
    assert ask("changes", path, "top.s0", "--from", 0, "--to", 9) == (0, ["5\t1"])
    assert ask("transactions", path, "--to", 3) == (0, ["10\t1\t\t3\t8\t1"]) and ask("transactions", path, "--max", 1)[1][1] == "... 1 more"
    assert ask("transactions", path, "--id", 10)[1][1] == "30\tstage\t4\t6"
    assert ask("active", path, "--from", 6, "--to", 8) == (0, ["top.s2"])
    assert ask("hierarchy", path, "--depth", 2)[1][:2] == ["0\tscope\ttop", "1\tgenerator\ttop.req"]
    assert ("node variable\t8" in ask("info", path)[1]) and ask("clocks", path) == (0, [])
    assert ask("index", path, tmp_path / "i") == (0, []) and ask("index", path, tmp_path / "i", "--check") == (0, ["fresh"])
    assert ask("active", path, "--from", 9, "--to", 9, "--index", tmp_path / "i") == (0, ["top.s5"])
    assert ask("validate", path, "--complete")[0] == 0 and ask("logs", path, "--sites") == (0, [])
    assert ask("convert", path, tmp_path / "saved")[0] == 0 and ask("value", tmp_path / "saved", "top.s2", 8) == (0, ["000000101"])
    (tmp_path / "part").write_bytes(open(path, "rb").read()[:-30])
    assert ask("recover", tmp_path / "part", tmp_path / "fixed")[0] == 3 and ask("recover", path, tmp_path / "copy") == (0, ["0 bytes dropped"])
    assert ask("value", path, "top.none", 8) == (0, []) and ask("info", tmp_path / "nothing")[0] == 1 and ask("unknown")[0] == 2


def test_tables_are_evaluated_once(spark, tmp_path, monkeypatch):
    """However many passes a table's sections need, what gives the table runs once."""
    monkeypatch.setattr(R, "TX_ROWS", 7)
    monkeypatch.setattr(R, "CHANGE_ROWS", 8)
    ran = spark.sparkContext.accumulator(0)

    def counted(rows, ddl):
        def run(it):
            for p in it:
                ran.add(len(p))
                yield p

        return spark.createDataFrame(rows, ddl).mapInPandas(run, ddl)

    tx = counted([(i * 2, i - i % 2, 1, i, i, 0, 0) for i in range(1, 31)], "id long, parent long, generator long, begin long, end long, status int, span_kind int")
    inside = counted([(100 + i, "stage", 2 * i, "a", "L", i, i) for i in range(1, 11)], "id long, kind string, owner long, name string, lane string, begin long, end long")
    rel = counted([("k", i, i) for i in range(1, 21)], "kind string, source long, destination long")
    changes = counted([(0, i, i, "01"[i % 2], None) for i in range(40)], "signal_id long, time long, seq long, text string, real double")
    path = str(tmp_path / "o")
    R.write_recording(spark, path, {"nodes": nodes(spark), "signals": signals(spark), "changes": changes, "transactions": tx, "embedded": inside, "relations": rel})
    assert ran.value == 30 + 10 + 20 + 40
    trace = api.read_trace(spark, path)
    assert trace.faults().filter("rule = 'child blocks'").count() == 0
    assert {t: read(spark, path, t).count() for t in ("transactions", "embedded", "relations", "changes")} == {"transactions": 30, "embedded": 10, "relations": 20, "changes": 40}


def test_faults_decode_records_once(spark, tmp_path):
    tx = spark.createDataFrame([(10, None, 1, 3, 8, 1, 0), (20, 10, 1, 4, 6, 0, 0)], "id long, parent long, generator long, begin long, end long, status int, span_kind int")
    located = spark.createDataFrame([(30, "stage", 2, 4, 6, 10), (30, "log", 3, 5, 5, None)], "id long, kind string, generator long, begin long, end long, parent long")
    path = str(tmp_path / "d")
    R.write_recording(spark, path, {"nodes": nodes(spark), "signals": signals(spark), "transactions": tx, "located": located})
    trace = api.read_trace(spark, path)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "tickloom" in plan(trace.table("located"))
    for t in ("nodes", "datatypes", "signals", "changes"):  # small ones are read where they are
        trace.tables[t] = spark.createDataFrame([], trace.tables[t].schema)
    found = trace.faults()
    assert "tickloom" not in plan(found)
    assert [tuple(r) for r in found.collect()] == [("repeated id", 30)]


def test_transactions_are_decoded_by_columns(monkeypatch):
    """The columns of a block are those of its rows, and no row is decoded on its own."""
    rng, n, m = random.Random(5), 60, 20
    kinds = {1: ("REQUEST", 23), 2: ("CLOCK", 23), 3: ("REQUEST", 23)}
    types, strings = dict(R._TX_TYPES), {"": 0, "a": 1, "L": 2}
    of = lambda name, values: pa.array(values, types[name])
    tx = pa.table({
        "id": of("id", [7 * i + 10 for i in range(n)]), "parent": of("parent", [0 if i % 3 else 7 * i for i in range(n)]), "generator": of("generator", [1 + i % 3 for i in range(n)]),
        "begin": of("begin", [rng.randrange(10**12) for _ in range(n)]), "end": of("end", [2**63 - 1 if i % 5 == 0 else 10**12 + i for i in range(n)]),
        "status": of("status", [i % 5 for i in range(n)]), "span_kind": of("span_kind", [i % 6 for i in range(n)]),
        "payload": of("payload", [None if i % 4 == 0 else [rng.choice([-(2**63), 2**63 - 1, -1, 0]) for _ in range(rng.randrange(6))] for i in range(n)]),
        "child_blocks": of("child_blocks", [sorted(rng.sample(range(1, 50), rng.randrange(4))) for _ in range(n)]),
        "events": of("events", [[{"id": 1000 + i, "time": 5 * i, "name": rng.choice(["a", None])}] * rng.randrange(3) for i in range(n)]),
        "stages": of("stages", [[{"id": 2000 + i, "name": "a", "lane": rng.choice(["L", None]), "begin": 5 + i, "end": rng.choice([None, 10**6])}] * rng.randrange(3) for i in range(n)]),
    })
    rel = pa.table({"kind": pa.array([rng.choice(["a", None]) for _ in range(m)]), "source": pa.array([rng.choice([0, 2**50]) for _ in range(m)]), "destination": pa.array([rng.choice([0, 10]) for _ in range(m)])})
    data = R.transaction_section(tx, rel, 9, strings)
    d = C.Declarations()
    d.strings, d.types = list(strings), {23: C.Datatype(3, "words", element=5)}
    rows = C.transaction_block(data, d, kinds)
    monkeypatch.setattr(C, "_general_page", None)
    for table in ("transactions", "embedded", "relations"):
        got = [r for page in C.transaction_columns(data, d, kinds, table) for r in zip(*(c.cast(f.type).to_pylist() for c, f in zip(page, C._arrow(table), strict=True)), strict=True)]
        assert got == getattr(rows, table) and got
    with pytest.raises(C._Unusual):  # payloads of other types are decoded by rows
        d.types[23] = C.Datatype(3, "words", element=9)
        C.transaction_columns(data, d, kinds, "transactions")


def test_columns_of_many_signals_at_once():
    """Signals encoded together are the same as each alone."""
    rng = np.random.default_rng(4)
    for kind in KINDS:
        n = rng.integers(1, 5, 9)
        at = np.concatenate([np.sort(rng.integers(0, 300, k)) for k in n])
        texts = ["".join(rng.choice(list("01" if kind[2] == 2 or rng.random() < 0.5 else "01xz"), kind[1])) for _ in at] if kind[0] == "bits" else ["\u00e9" * k for k in rng.integers(0, 4, len(at))]
        values = pa.array(rng.random(len(at))) if kind[0] == "real" else pa.array(texts)
        starts = np.cumsum(n) - n
        alone = [R.signal_columns(kind, n[i : i + 1], at[a : a + n[i]], values[a : a + n[i]]) for i, a in enumerate(starts)]
        assert R.signal_columns(kind, n, at, values) == ([c for c, _ in alone for c in c], [w for _, w in alone for w in w])


def test_tables_are_written_side_by_side(spark, tmp_path, monkeypatch):
    """Tables that don't need each other don't wait for each other, and one that stands written is not written again."""
    both, counted, written = Barrier(2, timeout=60), R.Scratch.counted, []

    def meet(self, df):
        written.append(df.columns)
        if df.columns in (changes.columns, rel.columns):
            both.wait()
        return counted(self, df)

    monkeypatch.setattr(R.Scratch, "counted", meet)
    changes = spark.createDataFrame([(0, 5, 0, "1", None)], "signal_id long, time long, seq long, text string, real double")
    rel = spark.createDataFrame([("k", 1, 2)], "kind string, source long, destination long")
    scratch = R.Scratch(spark, "mine")
    mine = counted(scratch, spark.createDataFrame([(10, None, 1, 3, 8, 1, 0)], "id long, parent long, generator long, begin long, end long, status int, span_kind int"))[0]
    path = str(tmp_path / "s")
    R.write_recording(spark, path, {"nodes": nodes(spark), "signals": signals(spark), "changes": changes, "relations": rel, "transactions": mine})
    assert mine.columns not in written and mine.count() == 1
    assert [read(spark, path, t).count() for t in ("changes", "relations", "transactions")] == [1, 1, 1]
