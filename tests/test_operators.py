"""Trace operators against plain Python, with nulls, ties and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import bits
from tickloom.operators import activity, clocks, joins, logs, ordered, relations, scopes, transactions, validation, waveform

CH = "signal_id long, time long, seq long, text string, prev string, found string, _t long"


def changes(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 3) for r in rows], CH)


def sample(seed, n=300):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2, 3]), rng.choice([None, *range(0, 400, 7)]), i, rng.choice("abc") if rng.random() < 0.9 else None) for i in range(n)]


def by_signal(rows):
    out = {}
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("bits_", [1, 3, 64])
def test_value_at_many_probes(spark, bits_):
    rows = sample(1)
    probes = [(s, t) for s in (1, 2, 3, 9, None) for t in (None, -1, 0, 6, 7, 200, 1000)] + [(1, 200)]
    p = spark.createDataFrame(probes, "signal_id long, probe_time long")
    got = ordered.as_of(changes(spark, rows), p, ["signal_id"], "time", ["seq"], ["text"], "probe_time", bits_)
    held = by_signal(rows)
    want = []
    for s, t in probes:
        last = [r for r in held.get(s, []) if t is not None and r[1] <= t]
        want.append((s, t, last[-1][1] if last else None, last[-1][3] if last else None))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([(r["signal_id"], r["probe_time"], r["found"] and r["found"]["time"], r["found"] and r["found"]["text"]) for r in got.collect()], key=key) == sorted(want, key=key)


def test_default_before_the_first_change(spark):
    p = spark.createDataFrame([(1, -5), (7, 3)], "signal_id long, probe_time long")
    got = waveform.value_at(changes(spark, sample(2)), p, ["text"], {"text": "0"})
    assert {(r["signal_id"], r["text"], r["since"]) for r in got.collect()} == {(1, "0", None), (7, "0", None)}
    assert waveform.value_at(changes(spark, []), p, ["text"]).count() == 2


@pytest.mark.parametrize("bits_", [1, 3, 64])
def test_neighbours_and_running_sums(spark, bits_):
    rows = sample(3)
    df = changes(spark, rows).drop("prev", "found", "_t")
    near = {r["seq"]: (r["prev"] and r["prev"]["seq"], r["next"] and r["next"]["seq"]) for r in ordered.neighbours(df, ["signal_id"], "time", ["seq"], ["seq"], bits_).collect()}
    total = {r["seq"]: (r["s"], r["m"]) for r in ordered.running(ordered.running(df, ["signal_id"], "time", ["seq"], F.col("seq"), "s", shards=bits_), ["signal_id"], "time", ["seq"], F.col("seq"), "m", "max", bits_).collect()}
    for held in by_signal(rows).values():
        seqs = [r[2] for r in held]
        for i, s in enumerate(seqs):
            assert near[s] == (seqs[i - 1] if i else None, seqs[i + 1] if i + 1 < len(seqs) else None)
            assert total[s] == (sum(seqs[:i]), max(seqs[:i]) if i else None)


def test_no_key_is_one_task(spark):
    """One signal with all changes and ticks below 2^20 spreads over all partitions."""
    n = 60_000
    df = spark.range(n).select(F.lit(1).cast("bigint").alias("signal_id"), (F.col("id") * 17 % n).alias("time"), F.col("id").alias("seq"), (F.col("id") % 3).cast("string").alias("text"))
    probes = spark.range(4000).select(F.lit(1).cast("bigint").alias("signal_id"), (F.col("id") * 15).alias("probe_time"))
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for out in (waveform.hold_intervals(df, ["text"]), waveform.previous_values(df, "text"), waveform.value_at(df, probes, ["text"])):
            sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
            assert len(sizes) == 4 and max(sizes) < 0.6 * sum(sizes)
    finally:
        for k in settings:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_dedup_keeps_first_and_occurrences(spark):
    rows = [(1, 0, 0, "a"), (1, 0, 1, "a"), (1, 5, 2, None), (1, 6, 3, None), (1, 7, 4, "a"), (2, 1, 5, "x"), (2, 2, 6, "x")]
    df = changes(spark, rows).drop("prev", "found", "_t")
    assert sorted(r["seq"] for r in waveform.dedup_held(df, "text").collect()) == [0, 2, 4, 5]
    assert sorted(r["seq"] for r in waveform.dedup_held(df, "text", F.col("signal_id") == 2).collect()) == [0, 2, 4, 5, 6]
    assert {(r["seq"], r["until"]) for r in waveform.hold_intervals(df, ["text"]).collect()} == {(0, 0), (1, 5), (2, 6), (3, 7), (4, None), (5, 2), (6, None)}
    assert {(r["seq"], r["before"]) for r in waveform.previous_values(df, "text").collect()} == {(0, None), (1, "a"), (2, "a"), (3, None), (4, None), (5, None), (6, "x")}


def test_windows_are_closed_and_never_reversed(spark):
    df = changes(spark, [(1, t, t, "a") for t in (0, 5, 10)])
    assert waveform.changes_window(df, 5, 10).count() == 2
    assert waveform.changes_window(df, None, 5, 1).count() == 2
    for bad in (lambda: waveform.changes_window(df, 6, 5), lambda: transactions.in_window(6, 5)):
        with pytest.raises(ValueError):
            bad()
    assert activity.active_in(df, "signal_id", "time", "time", 6, 5).count() == 0 and activity.signals_active(df, 6, 5).count() == 0


def test_blackouts(spark):
    marks = spark.createDataFrame([(0, 5, False), (1, 5, True), (2, 8, False), (3, 7, False)], "seq long, time long, active boolean")
    df = changes(spark, [(1, t, t, "a") for t in (4, 5, 9)]).drop("prev", "found", "_t")
    kept = waveform.suppress_dumped(df, marks.filter("seq = 2").select("time", "active"))
    assert sorted(r["time"] for r in kept.collect()) == [4, 5]
    for cap in (waveform.MARKERS, 0):
        waveform.MARKERS, was = cap, waveform.MARKERS
        try:
            two = spark.createDataFrame([(0, 5, False), (1, 5, True), (2, 8, False), (3, 8, False), (4, 20, True)], "seq long, time long, active boolean")
            kept = waveform.suppress_dumped(changes(spark, [(1, t, t, "a") for t in (None, 4, 5, 8, 9, 19, 20)]).drop("prev", "found", "_t"), two)
            assert sorted(r["time"] for r in kept.collect()) == [4, 5, 20]
        finally:
            waveform.MARKERS = was
    assert [r["seq"] for r in waveform.blackout_faults(marks).collect()] == [3]


def test_time_steps_and_range(spark):
    df = changes(spark, [(1, 3, 0, "a"), (2, 3, 1, "a"), (1, None, 2, "a")])
    quiet = spark.createDataFrame([(9,), (3,)], "time long")
    assert sorted(r["time"] for r in waveform.time_steps(df, quiet).collect()) == [3, 9]
    assert tuple(waveform.time_range([(df, "time", "time"), (quiet, "time", "time")]).first()) == (3, 9)
    assert tuple(waveform.time_range([(df.limit(0), "time", "time")]).first()) == (None, None)


def test_signal_activity_ignores_the_first_tick_and_joins_consecutive_ones(spark):
    df = changes(spark, [(1, t, i, "a") for i, t in enumerate([40, 41, 42, 42, 44, 50])] + [(2, 40, 9, "b")])
    assert sorted(map(tuple, activity.signal_activity(df).collect())) == [(1, 41, 42, 1), (1, 44, 44, 0), (1, 50, 50, 0)]
    assert sorted(map(tuple, activity.activity_summary(df).collect())) == [(1, 4, 3)]
    runs = activity.signal_activity(df)
    for a in range(38, 53):
        for b in range(a, 53):
            want = any(f <= b and last >= a for f, last in [(41, 42), (44, 44), (50, 50)])
            if (a * b) % 5 == 0:
                assert bool(activity.active_in(runs, "signal_id", "first", "last", a, b).count()) == want


def test_generator_activity_conventions(spark):
    t = spark.createDataFrame([(1, 0, 5), (1, 6, 7), (2, 0, 0)], "generator long, begin long, end long")
    s = spark.createDataFrame([(1, 9, 10), (1, 10, 12), (3, 4, 4)], "generator long, begin long, end long")
    assert sorted(map(tuple, activity.generator_activity(t, s).collect())) == [(1, 0, 7), (1, 9, 11), (2, 0, 0), (3, 4, 4)]


def test_interval_rules(spark):
    df = spark.createDataFrame([(1, 0, 10), (2, 10, 10), (3, 11, 20), (4, 20, 20), (5, None, 3), (6, 3, None)], "id long, begin long, end long")
    ids = lambda cond: sorted(r["id"] for r in df.filter(cond).collect())
    assert ids(transactions.in_window(10, 11)) == [1, 2, 3]
    assert ids(transactions.in_window_half_open(10, 20)) == [2, 3, 4]
    assert ids(transactions.in_window_half_open(20, 30)) == [4]


def test_overlap_join_against_all_pairs(spark):
    rng = random.Random(5)
    spans = lambda n, top: [(i, rng.choice([1, 2, None]), *(lambda b: (b, b + int(rng.choice([0, 3, 500, 10**6, 10**12, 2**57]) * rng.random()) - rng.choice([0, 0, 0, 1])))(rng.randint(0, top))) for i in range(n)]
    a, b = spans(120, 10**7), spans(120, 10**7)
    da = spark.createDataFrame(a, "i long, k long, b long, e long")
    db = spark.createDataFrame(b, "j long, k long, c long, d long")
    want = sorted((x[0], y[0]) for x in a for y in b if x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and x[3] >= y[2])
    assert sorted((r["i"], r["j"]) for r in joins.overlap_join(da, db.drop("k"), ("b", "e"), ("c", "d")).collect()) == want
    keyed = sorted(p for p in want if a[p[0]][1] is not None and a[p[0]][1] == b[p[1]][1])
    assert sorted((r["i"], r["j"]) for r in joins.overlap_join(da, db, ("b", "e"), ("c", "d"), ["k"]).collect()) == keyed


def test_expand_pairs(spark):
    a = spark.createDataFrame([("k", 1), ("k", 2), (None, 3)], "key string, id long")
    b = spark.createDataFrame([("k", 8), ("k", 9), (None, 7)], "key string, id long")
    assert sorted(map(tuple, joins.expand_pairs(a, b, "key").collect())) == [(1, 8), (1, 9), (2, 8), (2, 9)]


def test_ownership(spark):
    t = spark.createDataFrame([(1, None, 5, 0, 10), (2, 1, 5, 3, 20), (3, 1, 6, 4, 4), (4, 99, 6, 1, 1)], "id long, parent long, generator long, begin long, end long")
    located = spark.createDataFrame([(10, "stage", 7, 1, 2, 1), (11, "log", 7, 5, 5, 1), (12, "event", 7, 30, 30, 1), (13, "log", 7, 2, 2, None)], "id long, kind string, generator long, begin long, end long, parent long")
    ids = lambda df, c="id": sorted(r[c] for r in df.collect())
    assert ids(transactions.children_of(t, t.filter("id = 1"))) == [2, 3]
    assert ids(transactions.expand(t.filter("id = 1"), located)) == [10, 12]
    assert ids(transactions.query_located(located, parent=0)) == [13]
    assert ids(transactions.query_located(located, 0, 9, kind="log", parent=1)) == [11]
    assert ids(transactions.query_located(located, include_logs=False)) == [10, 12]
    assert ids(transactions.query_transactions(t, parent=0)) == [1]
    assert ids(transactions.query_transactions(t, 5, None, generator=5)) == [1, 2]
    assert ids(transactions.outside_owner(located.withColumnRenamed("parent", "owner"), t)) == [12]
    emb = spark.createDataFrame([(20, 1, "F", "l", 4, None), (21, 9, "F", "l", 4, None)], "id long, owner long, name string, lane string, begin long, end long")
    clk = spark.createDataFrame([(1, 30, 0, 4, 2)], "clock long, id long, begin long, end long, period long")
    every = transactions.records_all(t, emb, located, clk)
    assert every.count() == 11 and [r["end"] for r in every.filter("id in (20, 21)").orderBy("id").collect()] == [10, 4]
    assert ids(transactions.lookup(every, spark.createDataFrame([(20,), (20,), (1,), (77,), (None,)], "id long"))) == [1, 20]
    assert ids(transactions.query_transactions(t, embedded=emb, embedded_id=20)) == [1]


def test_lanes_oldest_and_younger(spark):
    st = spark.createDataFrame([(1, 1, "a", 0, None), (2, 1, "a", 5, None), (3, 1, "b", 1, 2), (4, None, "a", 0, None)], "id long, owner long, lane string, begin long, end long").withColumn("seq", F.col("id"))
    assert {(r["id"], r["closed"]) for r in transactions.lane_autoclose(st).collect()} == {(1, 5), (2, None), (3, 2), (4, None)}
    m = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 7)], "g long, id long")
    assert sorted(r["id"] for r in transactions.oldest(m, "g", 3).collect()) == [0, 1, 2, 7]
    key = spark.createDataFrame([(1, 40), (1, 45)], "g long, id long")
    assert sorted(r["id"] for r in transactions.younger(m, "g", key).collect()) == [46, 47, 48, 49]


def test_reachability_ends_on_cycles(spark):
    r = spark.createDataFrame([("k", 1, 2), ("k", 2, 3), ("k", 3, 1), ("k", 3, 3), ("k", 3, 0), (None, None, 4), ("k", 1, 2)], "kind string, source long, destination long")
    start = spark.createDataFrame([(1,), (9,), (None,)], "id long")
    assert sorted(map(tuple, relations.reachable(r, start, 5).collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (9, 9, 0)]
    assert sorted(x["n"] for x in relations.scan_counts(r).collect()) == [1, 1, 1, 1, 1, 2]
    assert relations.outside(r).count() == 2
    assert relations.touching(r, start, True).count() == 1


def test_scopes(spark):
    nodes = spark.createDataFrame(
        [(0, None, "scope", "top"), (1, 0, "scope", "a"), (2, 1, "variable", "x"), (3, 0, "variable", "x"), (4, 0, "scope", None), (5, 0, "scope", "vtr.run"), (6, 0, "scope", "a"), (7, 7, "scope", "loop")],
        "node_id long, parent_id long, node_kind string, name string",
    )
    c = scopes.closed(nodes)
    assert {(r["node_id"], r["path"], r["depth"]) for r in c.collect()} == {(0, "top", 0), (1, "top.a", 1), (2, "top.a.x", 2), (3, "top.x", 1), (4, "top.", 1), (5, "top.vtr.run", 1), (6, "top.a", 1)}
    assert [tuple(r) for r in scopes.find(c, "top.a").collect()] == [tuple(r) for r in scopes.find_path(nodes, "top.a").collect()] == [(1, "top.a")]
    assert scopes.find(c, "top.vtr.run").count() == 0 and scopes.find(c, "top.x", "scope").count() == 0
    assert sorted(r["node_id"] for r in scopes.within_scope(c, 1).collect()) == [1, 2] and scopes.within_scope(c, None).count() == 7
    assert [r["node_id"] for r in scopes.children(nodes, 0).collect()] == [1, 3, 4, 5, 6]
    assert [r["node_id"] for r in scopes.listing(c, 2, False).collect()] == [0, 1, 4, 5, 6]
    v = spark.createDataFrame([(0, 3), (1, 3), (1, 9)], "scope long, signal_id long")
    sizes = {r["node_id"]: (r["scopes"], r["variables"], r["signals"]) for r in scopes.scope_sizes(c, v).collect()}
    assert sizes[0] == (5, 3, 2) and sizes[1] == (1, 2, 2) and sizes[5] == (1, 0, 0)
    only = {r["node_id"]: (r["variables"], r["signals"]) for r in scopes.scope_sizes(c, v, spark.createDataFrame([(3,)], "signal_id long")).collect()}
    assert only[0] == (2, 1) and only[1] == (1, 1)


def test_clock_cycles_against_listed_edges(spark):
    rng = random.Random(8)
    st, probes = [], []
    for clock in range(4):
        at = 0
        for i in range(6):
            at += rng.randint(1, 9)
            period, k = rng.randint(1, 5), rng.randint(0, 4)
            st.append((clock, i, at, at + period * k, period if k else None))
            at += period * k
        probes += [(clock, t) for t in range(0, at + 5)]
    s = spark.createDataFrame(st, "clock long, id long, begin long, end long, period long")
    got = {(r["clock"], r["probe_time"]): r["cycle"] for r in clocks.cycle_at(s, spark.createDataFrame(probes, "clock long, probe_time long")).collect()}
    for clock, t in probes:
        edges = [x for c, _, b, e, p in st if c == clock for x in range(b, e + 1, p or 1)]
        n = sum(x <= t for x in edges)
        assert got[clock, t] == (n - 1 if n else None)
    assert clocks.overlaps(s).count() == 0 and clocks.period_faults(s).count() == 0
    bad = spark.createDataFrame([(1, 1, 0, 10, None), (1, 2, 10, 20, 3), (1, 3, 30, 30, 2), (1, 4, 40, 44, 0)], "clock long, id long, begin long, end long, period long")
    assert sorted(r["id"] for r in clocks.overlaps(bad).collect()) == [2]
    assert sorted(r["id"] for r in clocks.period_faults(bad).collect()) == [1, 2, 3, 4]


def test_bits(spark):
    df = spark.createDataFrame([("1",), ("z1",), ("10xz",), ("-0",), ("q",), ("",), (None,), ("1" * 64,), ("0" * 65,)], "s string")
    got = df.select(bits.pack_ascii("s", 4).alias("p"), bits.as_u64("s").cast("string").alias("u"), bits.is_two_state("s").alias("t"), bits.state_at("s", 1).alias("b")).collect()
    assert [r["p"] for r in got] == ["0001", "zzz1", "10xz", "---0", "xxxx", "0000", None, "1111", "0000"]
    assert [r["u"] for r in got] == ["1", None, None, None, None, None, None, str(2**64 - 1), None]
    assert [r["t"] for r in got] == [True, False, False, False, False, True, None, True, True]
    assert [r["b"] for r in got][:3] == [None, "z", "x"]
    assert df.select(bits.log_bytes_text(F.lit(b"\xff\x00")).alias("x")).first()["x"] == "[non-UTF-8 bytes] ff00"


def test_rendered_logs(spark):
    rows = spark.createDataFrame([(1, 1, 5), (2, 1, None), (3, 2, 255), (4, 9, 1)], "id long, datatype_id int, arg long")
    sites = spark.createDataFrame([(1, "request {} of {}", 4), (2, "at {:#x}", 2), (3, None, 9)], "datatype_id int, format string, severity int")
    plain = {r["id"]: r["message"] for r in logs.render_plain(rows, sites, ["arg"]).collect()}
    assert plain == {1: "request 5 of {?}", 2: "request {?} of {?}", 3: None}
    full = {r["id"]: r["message"] for r in logs.render(rows, sites, ["arg"]).collect()}
    assert full == {1: "request 5 of {?}", 2: "request {?} of {?}", 3: "at 0xff"}
    assert sorted(r["id"] for r in logs.at_least(rows, sites, 3).collect()) == [1, 2]
    with pytest.raises(ValueError):
        logs.render(rows, sites, ["arg"], style="other")


def test_callsites_and_endings(spark):
    d = spark.createDataFrame([(1, [("log.format", "a {}"), ("log.severity", "4"), ("log.format", "b")]), (2, [("x", "y")])], "datatype_id int, attributes array<struct<key:string,value:string>>")
    got = logs.callsites_of(d).collect()
    assert [(r["datatype_id"], r["format"], r["style"], r["severity"], r["file"]) for r in got] == [(1, "a {}", "brace", 4, None)]
    schema = "id long, message string, reason int, signal int, code int, address long, thread long, sealed boolean, status int, dropped long"
    good = [
        ("crashed by SIGSEGV (address 0x10, thread 7, sealed mid-call)", 3, 11, 1, 16, 7, True, 0, 0), ("crashed by signal 99 (address 0x0, thread 0)", 3, 99, 0, 0, 0, False, 0, 0),
        ("stopped by SIGTERM", 1, 15, 0, 0, 0, False, 0, 0), ("exited with status 2", 2, 0, 0, 0, 0, False, 2, 0), ("recovered by scanning (40 bytes dropped)", 4, 0, 0, 0, 0, False, 0, 40),
        ("sealed after a panic in the writer", 5, 0, 0, 0, 0, False, 0, 0),
    ]
    bad = [("stopped by SIGTERM", 1, 15, 0, 0, 0, False, 3, 0), ("stopped by SIGINT", 1, 15, 0, 0, 0, False, 0, 0), (None, 9, 0, 0, 0, 0, False, 0, 0), ("exited with status 2", 2, 0, 0, 0, 0, True, 2, 0)]
    for rows, want in ((good, 0), (bad, 1)):
        for r in rows:
            assert logs.ending_faults(spark.createDataFrame([(4, *r)], schema)).count() == want
    e = spark.createDataFrame([(4, *good[0]), (5, *good[2]), (6, *bad[0])], schema)
    assert sorted(r["id"] for r in logs.ending_faults(e).collect()) == [5, 6]


def test_validation_rules(spark):
    a = spark.createDataFrame([(1, 1, "vtr.label", "text"), (2, 1, "vtr.label", "u32"), (3, 1, "vtr.label", None), (4, 2, "pc", "u32")], "id long, generator long, key string, type string")
    assert sorted(r["id"] for r in validation.label_types(a).collect()) == [2, 3]
    assert [r["id"] for r in validation.field_clashes(a, spark.createDataFrame([(2, "pc"), (1, "pc")], "generator long, field string")).collect()] == [4]
    g = spark.createDataFrame([(1, "CLOCK", None), (2, "X", 1), (3, "X", 2), (4, "X", 9), (5, None, 1)], "generator long, gen_kind string, clock long")
    assert {(r["generator"], r["fault"]) for r in validation.clock_targets(g).collect()} == {(3, "not a clock"), (4, "missing")}
    assert sorted(r["generator"] for r in clocks.clock_of(g).collect()) == [2, 5]
    f = spark.createDataFrame([(1, 0, "a"), (1, 5, None)], "signal_id long, start_time long, value string")
    assert validation.frame_faults(f, f).count() == 0 and validation.frame_faults(f, f.withColumn("value", F.lit("b"))).count() == 2
    s = spark.createDataFrame([(1, 2, 2), (2, 2, 4)], "signal_id long, width int, states int")
    c = spark.createDataFrame([(1, "01"), (1, "0x"), (1, "011"), (2, "xz"), (2, "uu")], "signal_id long, text string")
    assert validation.alphabet_faults(c, s).count() == 3
    t = spark.createDataFrame([(1, None, 5, 3, 0, 0), (2, 3, None, 3, 9, 7), (3, None, 0, 0, 0, 0)], "id long, parent long, begin long, end long, status int, span_kind int")
    assert sorted((r["rule"], r["id"]) for r in validation.transaction_shape(t).collect()) == [("end before begin", 1), ("missing tick", 2), ("span kind", 2), ("status", 2)]
    assert [tuple(r) for r in validation.parent_order(t).collect()] == [(2, 3)]
    counted = validation.counts(t, spark.createDataFrame([(1, 9)], "id long, owner long"), spark.createDataFrame([("k", 1, 77), ("k", None, 0)], "kind string, source long, destination long"))
    got = {r["what"]: r["n"] for r in counted.collect()}
    assert got == {"records": 4, "relations": 2, "missing parents": 0, "missing sources": 0, "missing destinations": 1, "repeated ids": 1}
    with pytest.raises(ValueError):
        validation.missing_as_errors(counted, True)
    validation.missing_as_errors(counted, False)
    located = spark.createDataFrame([(77, 1), (78, 50), (79, None)], "id long, parent long")
    whole = validation.counts(t, spark.createDataFrame([], "id long, owner long"), spark.createDataFrame([("k", 1, 77), ("k", 79, 0)], "kind string, source long, destination long"), located)
    assert {r["what"]: r["n"] for r in whole.collect()} == {"records": 6, "relations": 2, "missing parents": 1, "missing sources": 0, "missing destinations": 0, "repeated ids": 0}


def test_resolve_refs(spark):
    v = spark.createDataFrame([(1, None, "a"), (2, 1, None), (3, 2, None), (4, None, "b")], "id long, ref long, value string")
    assert sorted(map(tuple, scopes.resolve_refs(v).collect())) == [(1, 1, "a"), (2, 1, "a"), (3, 1, "a"), (4, 4, "b")]
