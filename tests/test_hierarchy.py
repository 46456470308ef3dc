import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tickloom.operators import hierarchy as H
from tickloom.plans import problems

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def brute(rows, none=()):
    """node -> (root, depth, path), or for trapped nodes the smallest id of their cycle."""
    parent = {}
    for n, p in rows:
        if n is None:
            continue
        p = None if p in none else p
        if n in parent and (p is None or parent[n] is not None and parent[n] <= p):
            continue
        parent[n] = p
    out, trapped = {}, {}
    for n in parent:
        path, x, seen = [], n, set()
        while x is not None and x in parent and x not in seen:
            seen.add(x)
            path.append(x)
            x = parent[x]
        if x is not None and x in seen:
            cycle = path[path.index(x) :]
            trapped[n] = (min(cycle), n in cycle)
        else:
            out[n] = (path[-1], len(path) - 1, path[::-1])
    return out, trapped


def check(spark, rows, none=(), small=H.SMALL):
    df = spark.createDataFrame(rows, "n long, p long, extra string") if rows and len(rows[0]) == 3 else spark.createDataFrame(rows, "n long, p long")
    f = H.hierarchy(df, "n", "p", none, small)
    want, trapped = brute([r[:2] for r in rows], none)
    placed = {r["node"]: r for r in f.placed().collect()}
    assert {k: (r["root"], r["depth"]) for k, r in placed.items()} == {k: v[:2] for k, v in want.items()}
    paths = {r["node"]: list(r["path"]) for r in f.paths().collect()}
    assert paths == {k: v[2] for k, v in want.items()}
    below = {k: 0 for k in want}
    for _, _, path in want.values():
        for a in path[:-1]:
            below[a] += 1
    assert {k: r["descendants"] for k, r in placed.items()} == below
    for k, r in placed.items():  # intervals nest as the paths do
        for a in want[k][2]:
            assert placed[a]["entry"] <= r["entry"] and r["exit"] <= placed[a]["exit"]
    entries = [(r["root"], r["entry"]) for r in placed.values()] + [(r["root"], r["exit"]) for r in placed.values()]
    assert len(set(entries)) == len(entries)
    assert f.closure().count() == sum(v[1] for v in want.values())
    got = {} if f.cyclic is None else {r["node"]: (r["cycle"], r["on_cycle"]) for r in f.cyclic.collect()}
    assert got == trapped
    for least in (0, 1, 3):
        assert {r["node"]: r["depth"] for r in f.deep(least).collect()} == {k: v[1] for k, v in want.items() if v[1] >= least}


def forest(seed, n, chain):
    rng = random.Random(seed)
    ids = list(range(1, n + 1))
    rng.shuffle(ids)
    rows = [(ids[0], None)]
    for i in range(1, n):
        pick = rng.random()
        rows.append((ids[i], ids[i - 1] if pick < chain else None if pick < chain + 0.1 else ids[rng.randrange(i)]))
    return rows


@pytest.mark.parametrize("small", [H.SMALL, 0])
def test_random_forest_with_cycles(spark, small):
    rows = forest(1, 220, 0.5)
    loop = [1000, 1001, 1002, 1003, 1004]
    rows += [(loop[i], loop[(i + 1) % 5]) for i in range(5)] + [(2000, 1001), (2001, 2000), (2002, 2001), (3000, 3000), (3001, 3000)]
    check(spark, rows, small=small)


def test_ties_nulls_repeats_and_missing_parents(spark):
    rows = [(1, None, "a"), (1, None, "b"), (2, 1, None), (2, 1, None), (3, 99, ""), (4, 0, None), (None, 1, None), (5, 4, None), (6, 5, None), (6, 4, None), (-7, 2, None), (2**62 + 1, -7, None), (-(2**62), 2**62 + 1, None)]
    check(spark, rows, none=(0,))


def test_long_chain_and_wide_star(spark):
    check(spark, [(i, i + 1) for i in range(1, 150)] + [(150, None)], small=0)
    check(spark, [(10_000, None)] + [(i, 10_000) for i in range(1, 600)] + [(20_000 + i, i) for i in range(1, 300)])


def test_pure_cycles_only(spark):
    check(spark, [(1, 2), (2, 3), (3, 1), (10, 11), (11, 10)], small=0)


def test_empty_table(spark):
    f = H.hierarchy(spark.createDataFrame([], "n long, p long"), "n", "p")
    assert f.placed().count() == 0 and f.paths().count() == 0 and f.cyclic is None and H.found(f, "t").count() == 0


def test_found_names_deep_and_trapped_nodes(spark):
    rows = [(i, i - 1) for i in range(2, 20)] + [(1, None), (50, 51), (51, 50), (52, 50)]
    f = H.hierarchy(spark.createDataFrame(rows, "n long, p long"), "n", "p")
    got = {tuple(r) for r in H.found(f, "t", 16).collect()}
    assert got == {("t", 17, 1, 16), ("t", 18, 1, 17), ("t", 19, 1, 18), ("t", 50, 50, -1), ("t", 51, 50, -1), ("t", 52, 50, -1)}


def test_same_result_on_more_partitions(spark):
    rows = forest(4, 300, 0.3)
    df = spark.createDataFrame(rows, "n long, p long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    for parts in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        f = H.hierarchy(df, "n", "p", small=0)
        out.append(sorted(map(tuple, f.placed().select("node", "root", "depth", F.col("descendants")).collect())))
        assert {r["node"]: list(r["path"]) for r in f.paths().collect()} == {n: v[2] for n, v in brute(rows)[0].items()}
        at = {r["node"]: r for r in f.intervals().collect()}
        below = {n: {m for m, v in brute(rows)[0].items() if n in v[2][:-1]} for n in list(at)[:40]}
        for n, want in below.items():
            assert {m for m, r in at.items() if r["root"] == at[n]["root"] and at[n]["entry"] < r["entry"] < at[n]["exit"]} == want
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]


@pytest.mark.parametrize("name", ["p2_found", "p2_hierarchy"])
def test_queries_by_rounds_alone(spark, monkeypatch, name):
    """Without any step finished by one task the queries give the rows of their SQL too."""
    if not os.path.isdir(DIR):
        pytest.skip("no test tables")
    monkeypatch.setattr(H, "SMALL", 0)
    con = duckdb.connect()
    for t in ("trace_transactions", "census_scopes"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = problems.QUERIES[name](spark, DIR)
    want = con.sql(problems.SQL[name])
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in df.collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("small", [H.SMALL, 0])
def test_trees_below_cycles_are_cut_above_the_smallest_id(spark, small):
    rng = random.Random(7)
    rows = [(1, None), (2, 1), (50, 52), (51, 50), (52, 51), (70, 70)]
    for n in range(100, 300):  # a large tree below the cycles, and some nodes of a tree without any
        rows.append((n, rng.choice([r[0] for r in rows[1:]])))
    f = H.hierarchy(spark.createDataFrame(rows, "n long, p long"), "n", "p", small=small)
    free, trapped = brute(rows)
    want = brute([(n, None if n in trapped and n == trapped[n][0] else p) for n, p in rows])[0]
    want = {n: v for n, v in want.items() if n in trapped}
    cut = f.cut()
    placed = {r["node"]: r for r in cut.placed().collect()}
    assert {n: (r["root"], r["depth"]) for n, r in placed.items()} == {n: v[:2] for n, v in want.items()}
    assert {r["node"]: list(r["path"]) for r in cut.paths().collect()} == {n: v[2] for n, v in want.items()}
    assert {n: r["descendants"] for n, r in placed.items()} == {n: sum(n in v[2][:-1] for v in want.values()) for n in want}
    assert {tuple(r) for r in cut.closure().collect()} == {(a, n, v[1] - i) for n, v in want.items() for i, a in enumerate(v[2][:-1])}
    assert {placed[n]["root"] for n in placed} == {50, 70} and len(placed) + len(free) == len(rows)


def test_without_cycles_nothing_is_cut(spark):
    f = H.hierarchy(spark.createDataFrame([(1, None), (2, 1)], "n long, p long"), "n", "p")
    assert f.cut().placed().count() == 0 and f.cut().closure().count() == 0
