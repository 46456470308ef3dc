"""Per-key totals, orphan references and coverage against plain Python."""

import datetime
import random
from collections import defaultdict

import pytest

from tickloom.operators import aggregates as A
from tickloom.operators import intervals as I
from tickloom.operators import references as R

TX = "id long, parent long, generator int, begin_tick long, end_tick long, arrived_at timestamp, key long, n long, records string"
DAY = datetime.datetime(2031, 3, 3)
OPEN = 2**63 - 1


def tx(spark, rows):
    return spark.createDataFrame([(*r, DAY, 1, 2, "x") for r in rows], TX)


ROWS = [
    (1, None, 7, 0, 10), (1, None, 7, 0, 10), (2, 1, 7, 5, 5), (3, 1, 7, 9, 4), (4, 0, 7, None, 8), (5, 2, 7, 3, OPEN), (6, 9, None, 1, 2), (7, 9, None, None, None),
    (8, None, 8, OPEN, OPEN), (None, 3, 8, 1, 2), (9, 1, 9, -(2**62), 2**62),
]


def test_totals_of_odd_rows(spark):
    got = {r["generator"]: tuple(r)[1:] for r in A.generator_totals(tx(spark, ROWS)).collect()}
    assert got == {
        7: (5, 2, 0, 10, 10), None: (2, 1, 1, 2, 1), 8: (1, 0, OPEN, None, 0), 9: (1, 1, -(2**62), 2**62, 2**63),
    }


def test_heavy_keys_count_null_keys_in_the_total_only(spark):
    totals = A.generator_totals(tx(spark, ROWS))
    assert sorted(r["generator"] for r in A.heavy_keys(totals, "generator", 0.2).collect()) == [7]
    assert sorted(r["generator"] for r in A.heavy_keys(totals, "generator", 1 / 9).collect()) == [7, 8, 9]


def test_totals_of_an_empty_table(spark):
    totals = A.generator_totals(tx(spark, []))
    assert totals.count() == 0 and A.heavy_keys(totals, "generator", 0.02).count() == 0


def test_totals_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(i, None, rng.choice([1] * 6 + list(range(2, 9)) + [None]), rng.choice([None, rng.randrange(100)]), rng.choice([None, OPEN, rng.randrange(120)])) for i in range(3000)]
    rows += rng.sample(rows, 400)
    want = defaultdict(lambda: [0, 0, None, None, 0])
    for _, _, g, b, e in set(rows):
        w = want[g]
        w[0] += 1
        if b is not None:
            w[2] = b if w[2] is None else min(w[2], b)
        if e is not None and e != OPEN:
            w[3] = e if w[3] is None else max(w[3], e)
        if b is not None and e is not None and e != OPEN and e >= b:
            w[1] += 1
            w[4] += e - b
    got = {r["generator"]: [*r][1:] for r in A.generator_totals(tx(spark, rows)).collect()}
    assert got == dict(want)


def refs(spark, transactions, stages, relations, discarded):
    return R.trace_orphans(
        tx(spark, transactions), spark.createDataFrame([(s,) for s in stages], "stage_id long"),
        spark.createDataFrame([(*r, DAY) for r in relations], "rel_seq long, source long, destination long, arrived_at timestamp"),
        spark.createDataFrame([(d,) for d in discarded], "record_id long"),
    )


def test_orphans_of_every_kind(spark):
    got = refs(spark, ROWS, [50, None], [(1, 1, 50), (1, 1, 50), (2, 77, None), (3, 0, 4), (4, 50, 78), (None, 79, 1)], [4, 4, None, 2])
    rows = sorted((r["kind"], r["source"] or 0, r["target"]) for r in got.collect())
    assert rows == [("Parent", 5, 2), ("RelationDestination", 3, 4), ("RelationDestination", 4, 78), ("RelationSource", 0, 79), ("RelationSource", 2, 77)]
    assert sorted((r["kind"], r["orphan_references"], r["orphan_targets"]) for r in R.orphan_report(got).collect()) == [("Parent", 1, 1), ("RelationDestination", 2, 2), ("RelationSource", 2, 2)]


def test_late_parents_are_no_orphans_but_a_hot_missing_one_is(spark):
    rows = [(i, 5000 if i % 3 == 0 else i + 1, 1, 0, 1) for i in range(1, 600)] + [(600, None, 1, 0, 1)]
    got = refs(spark, rows, [], [], [])
    assert {(r["source"], r["target"]) for r in got.collect()} == {(i, 5000) for i in range(3, 600, 3)}
    assert [(r["orphan_references"], r["orphan_targets"]) for r in R.orphan_report(got).collect()] == [(199, 1)]


def test_orphans_of_empty_tables(spark):
    assert refs(spark, [], [], [], []).count() == 0
    assert refs(spark, [(2, 1, 1, 0, 0)], [], [], []).count() == 1
    lone = spark.createDataFrame([("Parent", "t", 1, 2, DAY)], "kind string, table_name string, source long, target long, arrived_at timestamp")
    assert R.orphan_keys(lone, [], lone.select("target").limit(0)).count() == 1


def test_old_reports_are_matched_by_kind_in_any_spelling(spark):
    now = spark.createDataFrame([("Parent", 1, 10), ("RelationSource", 5, 11), ("Parent", 2, 12)], "kind string, source long, target long")
    old = spark.createDataFrame([("missing parent", 1, 10), ("PARENT", 1, 10), ("relation-source", 0, 11), ("Relation Dest.", 0, 13), (None, 0, 14), ("ChildBlock", 3, None)], "kind string, source long, target long")
    got = {r["kind"]: tuple(r)[1:] for r in R.report_drift(now, old).collect()}
    assert got == {"Parent": (1, 0, 1, 0), "RelationSource": (1, 0, 0, 0), "RelationDestination": (0, 1, 0, 0), "": (0, 0, 0, 1), "ChildBlock": (0, 0, 0, 1)}


def plain(rows):
    by = defaultdict(list)
    for k, b, e in rows:
        if k is not None and b is not None and e is not None and e >= b:
            by[k].append((b, e))
    gaps, busy = set(), set()
    for k, spans in by.items():
        first, top = None, None
        for b, e in sorted(spans):
            if top is not None and b > top + 1:
                gaps.add((k, top + 1, b - 1))
                busy.add((k, first, top))
                first = b
            first = b if first is None else first
            top = e if top is None else max(top, e)
        busy.add((k, first, top))
    return gaps, busy


@pytest.mark.parametrize("scale", [50, 300_000, 2**34, 2**62])
def test_coverage_against_sorting(spark, scale):
    rng = random.Random(scale)
    rows = []
    for k in range(25):
        for _ in range(rng.randint(1, 60)):
            b = rng.randint(0, scale)
            rows.append((k, b, min(b + int(rng.choice([0, 1, 5, 100, 70_000, 200_000, 2**33, 2**50]) * rng.random()), 2**63 - 1)))
    rows += rng.sample(rows, 10) + [(None, 1, 2), (1, None, 2), (1, 5, None), (1, 9, 3)]
    c = I.coverage(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "k long, b long, e long, level int, shard int, starts int"), ["k"], "b", "e")
    gaps, busy = plain(rows)
    assert {tuple(r) for r in c.gaps().collect()} == gaps
    assert {tuple(r) for r in c.busy().collect()} == busy


def test_coverage_at_shard_edges_and_domain_ends(spark):
    rows = [(1, 65535, 65535), (1, 65536, 65536), (1, 131071, 2 * 65536), (1, 2**32 - 1, 2**32), (2, 0, 2**63 - 1), (2, 5, 6), (3, 0, 0), (3, 2**63 - 1, 2**63 - 1), (4, -10, -5), (4, 3, 4)]
    c = I.coverage(spark.createDataFrame(rows, "k long, b long, e long"), ["k"], "b", "e")
    gaps, busy = plain(rows)
    assert {tuple(r) for r in c.gaps().collect()} == gaps
    assert {tuple(r) for r in c.busy().collect()} == busy


def test_a_long_interval_covers_the_gaps_of_the_shards_within(spark):
    rows = [(1, t, t) for t in range(0, 10 * 65536, 977)] + [(1, 100, 8 * 65536 + 5)]
    gaps, _ = plain(rows)
    c = I.coverage(spark.createDataFrame(rows, "k long, b long, e long"), ["k"], "b", "e")
    assert {tuple(r) for r in c.gaps().collect()} == gaps


def test_coverage_of_an_empty_table(spark):
    c = I.coverage(spark.createDataFrame([], "k long, b long, e long"), ["k"], "b", "e")
    assert c.gaps().count() == 0 and c.busy().count() == 0


def test_trace_intervals_of_open_stages_and_lanes(spark):
    st = [(50, 1, " Exec ", 2, None), (51, 1, "EXEC", 20, 21), (52, 99, None, 5, None), (53, 1, "  ", 30, 31), (54, 1, "exec", 40, 39), (50, 1, " Exec ", 2, None), (55, None, "exec", 1, 2), (56, 5, "q", 1, None)]
    stages = spark.createDataFrame(st, "stage_id long, owner long, lane string, begin_tick long, end_tick long")
    got = {tuple(r) for r in I.trace_intervals(tx(spark, ROWS), stages).filter("entity = 'lane' and entity_id is not null and e >= b").collect()}
    assert got == {("lane", 1, "exec", 2, 10), ("lane", 1, "exec", 20, 21), ("lane", 99, "", 5, 5), ("lane", 1, "", 30, 31), ("lane", 5, "q", 1, OPEN)}
