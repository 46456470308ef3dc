import pytest

from tests.test_container import recording
from tests.test_sources import PIPELINE, WAVES
from tickloom.api import convert, format_of, read_trace


def test_formats_by_name(tmp_path):
    assert [format_of(x) for x in ("a.vcd", "a.VCD.gz", "b.kanata", "b.log.gz", "c.fst", "d.bin", str(tmp_path))] == ["vcd", "vcd", "kanata", "kanata", "fst", "recording", "saved"]


def test_waves(spark, tmp_path):
    (tmp_path / "w.vcd").write_text(WAVES)
    t = read_trace(spark, str(tmp_path / "w.vcd"))
    value = lambda path, at: t.value(path, at).first()["value"]
    assert value("chip.tick", 9) == "0" and value("chip.unit.tick_copy", 11) == "1" and value("chip.level [5:0]", 7) == "000110" and value("chip.unit.volts", 99) == "-0.125"
    assert value("chip.level [5:0]", 2) == "xxxxxx"
    assert tuple(t.waveform_range().first()) == (3, 20)
    assert t.changes("chip.unit.fired", 9, 11).count() == 2 and [r["time"] for r in t.ordered_changes(3).collect()] == [3, 3, 3]
    assert sorted(r["path"] for r in t.active(10, 15).collect()) == ["chip.tick", "chip.unit.fired", "chip.unit.volts"]
    assert t.active(15, 10).count() == 0
    sizes = {r["node_id"]: (r["scopes"], r["variables"], r["signals"]) for r in t.scope_sizes().collect()}
    assert sizes == {0: (2, 5, 4), 3: (1, 3, 3)}
    assert {r["what"]: r["n"] for r in t.info().collect()}["changes"] == 10
    assert t.within("chip").count() == 7 and t.within("chip.unit").count() == 4 and t.within(None).count() == 7 and t.listing(1).count() == 1
    rows, more = t.listed(t.changes(), 4)
    assert len(rows) == 4 and more == 6


def test_saved_traces_and_indexes(spark, tmp_path):
    (tmp_path / "w.vcd").write_text(WAVES)
    convert(spark, str(tmp_path / "w.vcd"), str(tmp_path / "out"))
    t = read_trace(spark, str(tmp_path / "out"))
    assert t.value("chip.tick", 9).first()["value"] == "0"
    with pytest.raises(Exception, match="exists"):
        convert(spark, str(tmp_path / "w.vcd"), str(tmp_path / "out"))
    t.index(str(tmp_path / "idx"))
    signals, _ = t.load_index(str(tmp_path / "idx"))
    assert sorted(r["path"] for r in t.active(8, 9, signals).collect()) == ["chip.level [5:0]", "chip.tick", "chip.unit.fired"]
    t.fingerprint = "other"
    with pytest.raises(ValueError, match="another"):
        t.load_index(str(tmp_path / "idx"))
    same_size = WAVES.replace("r0.5 n", "r0.7 n")
    (tmp_path / "w.vcd").write_text(same_size)
    with pytest.raises(ValueError, match="another"):
        read_trace(spark, str(tmp_path / "w.vcd")).load_index(str(tmp_path / "idx"))
    with pytest.raises(ValueError, match="no finished"):
        t.load_index(str(tmp_path / "nothing"))


def test_pipeline(spark, tmp_path):
    (tmp_path / "p.kanata").write_text(PIPELINE)
    t = read_trace(spark, str(tmp_path / "p.kanata"))
    probes = spark.createDataFrame([("cpu.cycle", 55), ("cpu.cycle", 39)], "clock string, probe_time long")
    assert {(r["probe_time"], r["cycle"]) for r in t.cycle_at(probes).collect()} == {(55, 15), (39, None)}
    assert [r["destination"] for r in t.relations(0).collect()] == []
    assert t.transactions(50, None).count() == 1


def test_recording(spark, tmp_path):
    t = read_trace(spark, recording(tmp_path / "a"))
    assert [r["id"] for r in t.expand(10).collect()] == [30, 31] and [r["id"] for r in t.children(10).collect()] == [20]
    with pytest.raises(ValueError):
        t.expand(30)
    assert t.relations(20).count() == 1 and t.relations(20, True).count() == 0 and t.scan_relations().count() == 1
    assert {(r["id"], r["kind"]) for r in t.lookup(spark.createDataFrame([(10,), (12,), (40,), (99,)], "id long")).collect()} == {(10, "transaction"), (12, "embedded_stage"), (40, "log")}
    assert t.transactions(scope="top").count() == 2 and t.records(0, 6, kind="stage").count() == 1
    assert tuple(t.time_range().first()) == (0, 107)
    # relations to located records are sound; the child blocks listed hold no children here, and one attribute is named as a field
    assert {r["what"]: r["n"] for r in t.validate(True).collect()} == {"records": 7, "relations": 1, "missing parents": 0, "missing sources": 0, "missing destinations": 0, "repeated ids": 0, "child blocks": 4, "attribute named as a field": 1}
    assert t.find_generator("top.REQUEST").count() + t.find_generator("top.name").count() == 1
    t.save(str(tmp_path / "saved"))
    assert read_trace(spark, str(tmp_path / "saved")).expand(10).count() == 2


def test_fst_is_refused(spark):
    with pytest.raises(ValueError, match="FST"):
        read_trace(spark, "x.fst")
