"""The synthetic traces against their closed forms, counted here in plain Python."""

import numpy as np
import pytest

from tickloom.sources import workloads as W


def plain_changes(p):
    """Changes of each signal by watching its value tick by tick."""
    out = {}
    for s in range(p.signals):
        held = None
        for t in range(p.ticks):
            if p.gated and t % 1024 >= 64:
                continue
            v = int(W.value_of(s, np.array([t]), p.gated)[0])
            if v != held:
                out[s, t] = held = v
    return out


@pytest.mark.parametrize("gated", [False, True])
def test_changes_are_where_values_change(spark, gated):
    p = W.Profile("x", 9, 0, 2100, gated)
    want = plain_changes(p)
    assert {(r["signal_id"], r["time"]): r["value"] for r in W.changes(spark, p, 3).collect()} == want
    assert p.observations == len(want)


def test_totals_of_the_profiles():
    assert {name: W.profile(name).observations for name in W.PROFILES} == {
        "core": 6_480_000, "soc": 20_736_000, "idle": 2_598_912, "requests": 205_715, "many-generators": 329_143, "mixed": 1_378_286,
    }


def test_transactions_and_probes(spark):
    p = W.profile("requests")
    t = W.transactions(spark, p).cache()
    assert t.count() == p.observations == t.select("serial").distinct().count()
    plain = sum((tick + 3 * g) % 14 in (0, 5, 9) for g in range(p.generators) for tick in range(p.ticks))
    assert plain == p.observations
    for whole in (False, True):
        asked = W.probes(spark, p, True, whole)
        got = {r["probe"]: r["n"] for r in W.find_transactions(t, asked).collect()}
        rows = t.collect()
        for q in asked.collect():
            want = sum(r["generator"] == q["source"] and r["attrs"][1] == q["wanted"] and r["begin"] <= q["last"] and r["end"] >= q["first"] for r in rows)
            assert got.get(q["probe"], 0) == want


def test_points_and_found_changes(spark):
    p = W.Profile("x", 16, 0, 5000, False)
    table = W.changes(spark, p).cache()
    asked = W.probes(spark, p, False, False)
    got = {r["probe"]: r["value"] for r in W.points(table, asked).collect()}
    found = {r["probe"]: r["n"] for r in W.find_changes(table, asked).collect()}
    rows = table.collect()
    for r in asked.collect():
        assert got[r["probe"]] == int(W.value_of(r["source"], np.array([r["at"]]))[0])
        assert found.get(r["probe"], 0) == sum(c["signal_id"] == r["source"] and c["value"] == r["wanted"] and r["first"] <= c["time"] <= r["last"] for c in rows)


def test_partitions_do_not_matter(spark):
    p = W.Profile("x", 16, 3, 3000, True)
    for make in (W.changes, W.transactions):
        assert W.digest(make(spark, p, 1)).collect() == W.digest(make(spark, p, 7)).collect()
