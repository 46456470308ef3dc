import math
import random

import pytest

from tickloom.llm import percentiles as P

SCHEMA = "g string, block int, value long, q long, points long"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, 7, 8) for r in rows], SCHEMA).repartition(parts)


def exact(values, q):
    s = sorted(values)
    return s[max(1, math.ceil(round(q * len(s), 6))) - 1]


def sample(seed, n=4000):
    rng = random.Random(seed)
    spread = [lambda: rng.randrange(10), lambda: rng.randrange(10**12), lambda: 5, lambda: -(2**62) + rng.randrange(3) * 2**62]
    return [(g := rng.choice(["hot"] * 5 + ["a", "b", "c", None]), rng.randrange(4), None if rng.random() < 0.05 else rng.choice(spread if g == "hot" else spread[:2])()) for _ in range(n)]


QS = [0.0, 0.01, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("finish", [512, 3])
def test_exact_selection_by_many_rounds(spark, monkeypatch, finish):
    monkeypatch.setattr(P, "FINISH", finish)
    rows = sample(1)
    got = {(r["g"], r["q"]): (r["n"], r["value"]) for r in P.select(P.summarise(frame(spark, rows), ["g"], "value", 0), ["g"], QS).collect()}
    groups = {}
    for g, _, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert got == {(g, q): (len(vs), exact(vs, q)) for g, vs in groups.items() for q in QS}


@pytest.mark.parametrize("eps", [0.001, 0.02, 0.2])
def test_rank_error_is_bounded_by_eps(spark, monkeypatch, eps):
    monkeypatch.setattr(P, "FINISH", 4)
    rows = sample(2, 6000)
    for r in P.select(P.summarise(frame(spark, rows, 7), ["g"], "value", eps), ["g"], QS).collect():
        values = [v for g, _, v in rows if g == r["g"] and v is not None]
        rank = max(1, math.ceil(round(r["q"] * len(values), 6)))
        below, upto = sum(v < r["value"] for v in values), sum(v <= r["value"] for v in values)
        assert r["n"] == len(values)
        assert below + 1 - rank <= eps * len(values) and rank - upto <= eps * len(values)


def test_blocks_combine_into_the_whole(spark):
    rows = sample(3)
    by_block = P.summarise(frame(spark, rows), ["g", "block"], "value", 0)
    whole = P.select(P.summarise(frame(spark, rows), ["g"], "value", 0), ["g"], QS)
    parts = [by_block.filter(f"block = {b}").drop("block") for b in range(4)]
    joined = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    assert sorted(map(str, P.select(joined, ["g"], QS).collect())) == sorted(map(str, whole.collect()))
    per = P.select(by_block, ["g", "block"], [0.5]).collect()
    assert {(r["g"], r["block"]): r["value"] for r in per} == {
        (g, b): exact([v for x, y, v in rows if x == g and y == b and v is not None], 0.5) for g, b in {(x, y) for x, y, v in rows if v is not None}
    }


def test_combined_runs_give_the_same(spark):
    """Runs of blocks made one by their group, equal values together."""
    rng = random.Random(12)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.randrange(9), rng.randrange(400)) for _ in range(6000)]
    df = spark.createDataFrame(rows, "g string, block int, v long").repartition(5)
    summary = P.summarise(df, ["g", "block"], "v", eps=0)
    qs = [0.01, 0.5, 0.99]
    one = sorted(map(str, P.select(summary.drop("block"), ["g"], qs).collect()))
    few = P.combine(summary, ["g"])
    assert few.count() <= 15 and sorted(map(str, P.select(few, ["g"], qs).collect())) == one
    assert P.combine(summary.limit(0), ["g"]).count() == 0


def test_nulls_single_values_and_empty_tables(spark):
    rows = [("a", 0, None), ("b", 0, 4), (None, 0, 1), (None, 0, 1)]
    got = sorted(((r["g"], r["q"], r["n"], r["value"]) for r in P.select(P.summarise(frame(spark, rows), ["g"], "value"), ["g"], [0.5, 0.99]).collect()), key=str)
    assert got == sorted([("b", 0.5, 1, 4), ("b", 0.99, 1, 4), (None, 0.5, 2, 1), (None, 0.99, 2, 1)], key=str)
    assert P.select(P.summarise(frame(spark, []), ["g"], "value"), ["g"], [0.5]).count() == 0
