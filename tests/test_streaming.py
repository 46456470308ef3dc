import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import clocks
from tickloom.streaming import oplog, tracker


def ops(spark, rows):
    names = [c.split()[0] for c in oplog.OP_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], oplog.OP_SCHEMA)


def op(producer, stamp, seq, _op, **more):
    return {"producer": producer, "stamp": stamp, "seq": seq, "op": _op, **more}


LIFE = [
    op("a", 0, 0, "begin", id=1, time=10, value="p"),
    op("a", 1, 1, "begin", id=2, parent=1, time=12),
    op("a", 2, 2, "payload", id=2, value="late"),
    op("a", 3, 3, "attribute", id=1, name="vtr.label", value="x"),
    op("a", 4, 4, "attribute", id=1, name="vtr.label", value="y"),
    op("a", 5, 5, "begin_stage", id=20, parent=1, time=11, name="fetch"),
    op("a", 6, 6, "end", id=1, time=5, status=1),
    op("a", 7, 7, "begin", id=3, time=30),
    op("a", 8, 8, "end", id=3, time=40, status=1),
    op("a", 9, 9, "span_kind", id=2, status=2),
]


def test_lifetimes_clamp_discard_and_stay_open(spark):
    got = {r["id"]: r for r in oplog.lifetimes(ops(spark, LIFE), 99).collect()}
    assert set(got) == {1, 2}  # 3 never got its deferred payload
    assert (got[1]["begin"], got[1]["end"], got[1]["status"], got[1]["label"]) == (10, 10, 1, "y")
    assert (got[2]["end"], got[2]["status"], got[2]["payload"], got[2]["span_kind"], got[2]["parent"]) == (99, 4, "late", 2, 1)
    stages = oplog.stage_lifetimes(ops(spark, LIFE), oplog.lifetimes(ops(spark, LIFE), 99)).collect()
    assert [(s["id"], s["owner"], s["begin"], s["end"]) for s in stages] == [(20, 1, 11, 11)]


def test_frontier_waits_for_the_slowest_producer(spark):
    rows = [op("a", 5, 0, "emit"), op("a", 9, 1, "emit"), op("b", 5, 2, "emit"), op("b", 3, 3, "emit")]
    producers = spark.createDataFrame([("a",), ("b",)], "producer string")
    df = ops(spark, rows)
    assert oplog.frontier(df, producers).first()["frontier"] == 5
    assert sorted(r["seq"] for r in oplog.released(df, producers).collect()) == [3]
    assert [r["seq"] for r in oplog.backward(df).collect()] == [3]
    done = ops(spark, rows + [op("b", 9, 4, "finish")])
    assert sorted(r["seq"] for r in oplog.released(done, producers).collect()) == [0, 1, 2, 3, 4]
    idle = spark.createDataFrame([("a",), ("b",), ("c",)], "producer string")
    assert oplog.released(df, idle).count() == 0
    assert [r["seq"] for r in oplog.merge_order(df).collect()] == [3, 0, 2, 1]


def test_conflicts_dead_owners_batches_and_last_values(spark):
    rows = [op("a", 1, 0, "begin", id=1, time=1), op("b", 1, 1, "payload", id=1, value="v"), op("a", 2, 2, "end", id=1, time=3), op("a", 3, 3, "payload", id=1, value="w"), op("a", 3, 4, "end", id=8, time=3)]
    df = ops(spark, rows)
    assert [(r["id"], r["producers"]) for r in oplog.writer_conflicts(df).collect()] == [(1, 2)]
    assert sorted(r["seq"] for r in oplog.dead_owners(df).collect()) == [3, 4]
    batches = spark.createDataFrame([(1, True), (1, None), (2, True)], "batch int, ok boolean")
    assert [r["batch"] for r in oplog.all_or_nothing(batches).collect()] == [2]
    attrs = spark.createDataFrame([(1, "k", "a", 1, 0), (1, "k", "b", 1, 1), (1, "j", None, 0, 0)], "id long, key string, value string, stamp long, seq long")
    assert sorted((r["key"], r["value"]) for r in oplog.last_value_wins(attrs).collect()) == [("j", None), ("k", "b")]
    assert oplog.first_per(attrs, ["id", "key"], ["seq"]).count() == 2


def test_clock_operations_make_stretches(spark):
    rows = [op("a", 0, 0, "clock_run", id=7, time=1, value="3"), op("a", 1, 1, "clock_run", id=7, time=9, value="4"), op("a", 2, 2, "clock_stop", id=7, time=21)]
    runs = oplog.clock_operations(ops(spark, rows))
    stretches = clocks.from_runs(runs)
    assert sorted((r["begin"], r["end"], r["period"]) for r in stretches.collect()) == [(1, 7, 3), (9, 21, 4)]
    probes = spark.createDataFrame([(7, t) for t in (0, 1, 8, 9, 21, 25)], "clock long, probe_time long")
    assert [r["cycle"] for r in clocks.cycle_at(stretches, probes).orderBy("probe_time").collect()] == [None, 0, 2, 3, 6, 6]


def streamed(spark, tmp_path, batches, make, schema):
    source, out = tmp_path / "in", []
    source.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(source))
    q = make(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).start()
    try:
        for i, b in enumerate(batches):
            b.coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
            part = next((tmp_path / f"b{i}").glob("part-*"))
            part.rename(source / f"{i}.parquet")
            q.processAllAvailable()
    finally:
        q.stop()
    return out


def test_streamed_lifetimes_equal_batch(spark, tmp_path):
    batches = [ops(spark, LIFE[:4]), ops(spark, LIFE[4:])]
    got = streamed(spark, tmp_path, batches, oplog.stream_lifetimes, oplog.OP_SCHEMA)
    assert sorted(r[:5] for r in got if r[6] is None) == [(1, None, 10, 10, 1)]
    assert [r[0] for r in got if r[6] == "ended without a payload"] == [3]


def test_streamed_owners_share_state_by_spans(spark, tmp_path):
    n, far = 3000, 2**60 + 1
    rows = [op("a", i, 2 * i, "begin", id=i, time=i, value=f"v{i}", parent=far if i % 2 else None) for i in range(n)]
    ends = [op("a", n + i, 2 * i + 1, "end", id=i, time=i - 1 if i % 3 else i + far, status=i % 4) for i in range(n)]
    folder = str(tmp_path / "in")
    for part in (rows, [*ends, op("a", 9 * n, 9 * n, "end", id=5, time=1), op("a", 9 * n, 9 * n + 1, "begin", id=6, time=1), op("a", 0, 0, "payload", id=10**6, value="x")]):
        ops(spark, part).coalesce(1).write.mode("append").parquet(folder)
    stream = oplog.stream_lifetimes(spark.readStream.schema(oplog.OP_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder))
    q = stream.writeStream.format("memory").queryName("spans").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [tuple(r) for r in spark.sql("select * from spans").collect()]
    assert sorted(r for r in got if r[6] is None) == [(i, far if i % 2 else None, i, i if i % 3 else i + far, i % 4, f"v{i}", None) for i in range(n)]
    assert sorted((r[0], r[6]) for r in got if r[6]) == [(5, "end without a live owner"), (6, "begun twice"), (10**6, "payload without a live owner")]
    assert 0 < q.lastProgress["stateOperators"][0]["numRowsTotal"] <= n // oplog.SPAN + 1


class State:
    """A group's state without a stream."""

    def __init__(self, now):
        self.now, self.held, self.wait, self.hasTimedOut = now, None, None, False

    exists = property(lambda self: self.held is not None)
    get = property(lambda self: self.held)

    def update(self, held):
        self.held = held

    def remove(self):
        self.held = None

    def getCurrentProcessingTimeMs(self):
        return self.now

    def setTimeoutDuration(self, ms):
        self.wait = ms


def test_tombstones_of_a_span_are_forgotten_one_by_one():
    state = State(1000)

    def apply(*rows):
        frame = pd.DataFrame([{"stamp": state.now, "seq": k, "parent": 0, "child": False, "status": 1, "value": None, **r} for k, r in enumerate(rows)])
        return [tuple(r) for f in oplog._apply(iter([frame] if rows else []), state, 100) for r in f.itertuples(index=False)]

    begin = [{"id": i, "op": "begin", "time": i, "value": "v"} for i in (1, 2, 3)]
    assert [r[0] for r in apply(*begin, {"id": 1, "op": "end", "time": 9})] == [1] and state.wait == 100
    state.now = 1060
    assert [r[0] for r in apply({"id": 2, "op": "end", "time": 9})] == [2] and state.wait == 40
    state.now, state.hasTimedOut = 1100, True
    assert apply() == [] and state.wait == 60
    state.hasTimedOut = False
    assert [(r[0], r[6]) for r in apply({"id": 1, "op": "begin", "time": 5, "value": "w"}, {"id": 2, "op": "begin", "time": 5})] == [(2, "begun twice")] and state.wait == 100
    state.now = 1300
    assert [(r[0], r[2], r[3]) for r in apply({"id": 3, "op": "end", "time": 9})] == [(3, 3, 9)]


def top(seq, _op, **more):
    return {"tracker": "t", "seq": seq, "op": _op, "time": more.pop("time", seq), **more}


def tops(spark, rows):
    names = [c.split()[0] for c in tracker.OP_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], tracker.OP_SCHEMA)


TRACK = [
    top(0, "open", space="rob", key=1, id=100, name="F"),
    top(1, "open", space="rob", key=2, id=101, name="F"),
    top(2, "stage", space="rob", key=1, name="D"),
    top(3, "stage", space="rob", key=1, name="D"),
    top(4, "lane", space="rob", key=1, lane="mem", name="M"),
    top(5, "attribute", space="rob", key=1, name="pc", value="1"),
    top(6, "attribute", space="rob", key=1, name="pc", value="2"),
    top(7, "bind_oldest", space="rob", count=3, to_space="lsq", to_key=9),
    top(8, "relate", space="lsq", key=9, to_space="lsq", to_key=9, name="k"),
    top(9, "lane", space="lsq", key=9, lane="mem", name=""),
    top(10, "event", space="lsq", key=9, name="e"),
    top(11, "open", space="rob", key=2, id=102, name="F"),
    top(12, "open", space="rob", key=2, id=103, name="F"),
    top(13, "bind", space="rob", key=2, to_space="lsq", to_key=9),
    top(14, "close", space="lsq", key=9, status=1, time=3),
    top(15, "stage", space="rob", key=77, name="X"),
    top(16, "abort_all"),
]


def check_tracker(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    owners = {r[2]: (r[5], r[6], r[7]) for r in by["owner"]}
    assert owners == {102: (11, 12, 3), 100: (0, 13, 3), 101: (1, 13, 3), 103: (12, 12, 1)}
    stages = {(r[2], r[3], r[4], r[5], r[6]) for r in by["stage"]}
    assert {(100, "F", "", 0, 2), (100, "D", "", 2, 13), (100, "M", "mem", 4, 9), (101, "F", "", 1, 13), (103, "F", "", 12, 12)} <= stages and len(by["stage"]) == 6
    assert [(r[2], r[3], r[8]) for r in by["attribute"]] == [(100, "pc", "2")]
    assert sorted((r[2], r[9]) for r in by["relation"]) == [(100, 100), (100, 101), (101, 100), (101, 101)]
    assert sorted(r[2] for r in by["event"]) == [100, 101]
    assert sorted(r[8] for r in by["diagnostic"]) == sorted([tracker.FEWER, tracker.REPLACED, tracker.EVICTED, tracker.NOTHING.format("stage")])


def test_tracker_in_batch(spark):
    check_tracker([tuple(r) for r in tracker.process(tops(spark, TRACK)).collect()])


def test_tracker_streamed_in_three_batches(spark, tmp_path):
    batches = [tops(spark, TRACK[:5]), tops(spark, TRACK[5:12]), tops(spark, TRACK[12:])]
    check_tracker(streamed(spark, tmp_path, batches, tracker.stream, tracker.OP_SCHEMA))


def test_tracker_younger_keyspace_and_detach(spark):
    rows = [top(i, "open", space="s", key=i, id=i, name="F") for i in range(5)]
    rows += [top(5, "abort_younger", space="s", key=2), top(6, "bind", space="s", key=0, to_space="u", to_key=0), top(7, "abort_keyspace", space="u"), top(8, "label", space="s", key=1, value="n"), top(9, "detach")]
    got = [tuple(r) for r in tracker.process(tops(spark, rows)).collect()]
    assert sorted(r[2] for r in got if r[1] == "owner") == [0, 3, 4]
    assert [(r[2], r[8]) for r in got if r[1] == "attribute"] == [(1, "n")]


def test_stream_windows_close_behind_the_watermark(spark, tmp_path):
    mk = lambda rows: spark.createDataFrame(rows, "ts string, k string").select(F.col("ts").cast("timestamp").alias("ts"), "k")
    batches = [mk([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a")]), mk([("2024-01-01 05:00:00", "b")]), mk([("2024-01-01 00:30:00", "a"), ("2024-01-01 09:00:00", "b")])]
    got = streamed(spark, tmp_path, batches, lambda s: oplog.stream_windows(s, "ts", "k", "1 hour"), "ts timestamp, k string")
    assert sorted((r[1], r[2]) for r in got) == [("a", 2), ("b", 1)]  # the late row is dropped


@pytest.mark.parametrize("rows", [[], [top(0, "abort_all")]])
def test_tracker_without_items(spark, rows):
    assert tracker.process(tops(spark, rows)).count() == 0
