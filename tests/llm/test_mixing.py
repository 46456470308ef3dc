import random

import pytest

from tickloom.llm import mixing as M


def leaf(source, share, supply, language="en", domain="latin"):
    return {"source": source, "share": share, "supply": supply, "language": language, "domain": domain}


def test_shortage_goes_to_siblings_before_ancestors():
    leaves = [leaf("a", 0.2, 5), leaf("b", 0.2, 1000), leaf("c", 0.2, 1000, "de"), leaf("d", 0.4, 1000, "ru", "cyrillic")]
    got = M.budgets(leaves, 100)
    assert got == pytest.approx({"a": 5, "b": 35, "c": 20, "d": 40})
    leaves[1]["supply"] = 10  # the language is short, so the other language of the domain takes over
    assert M.budgets(leaves, 100) == pytest.approx({"a": 5, "b": 10, "c": 45, "d": 40})
    leaves[2]["supply"] = 12  # the domain is short
    assert M.budgets(leaves, 100) == pytest.approx({"a": 5, "b": 10, "c": 12, "d": 73})
    assert sum(M.budgets(leaves, 10**9).values()) == pytest.approx(5 + 10 + 12 + 1000)


def test_largest_mixture_meets_every_share():
    leaves = [leaf("a", 0.5, 50), leaf("b", 0.3, 300), leaf("c", 0.2, 0, "", "other")]
    got = M.budgets(leaves)
    total = sum(got.values())
    assert got["c"] == 0 and got["a"] == pytest.approx(50, rel=1e-6)
    assert got["a"] >= 0.5 * total - 1e-6 and got["b"] >= 0.3 * total - 1e-6
    assert M.budgets([leaf("a", 0.5, 0)]) == {"a": 0.0}


def frames(spark, docs, targets):
    return (spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, source string, lang string, tokens long, repeats int, bucket int"),
            spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))


def sample(n=3000):
    rng = random.Random(6)
    return [(i, rng.choice(["big"] * 6 + ["mid", "small", None, "other"]), rng.choice(["en", "eng", None, "de"]), rng.randrange(0, 400)) for i in range(n)]


TARGETS = [("big", 0.3, 1), ("mid", 0.4, 3), ("small", 0.25, 4), ("absent", 0.05, 2), ("big", 0.3, 1), (None, 0.5, 1)]


@pytest.mark.parametrize("bucket", [2048, 20])
def test_shares_repeats_and_prefixes(spark, monkeypatch, bucket):
    monkeypatch.setattr(M, "BUCKET", bucket)
    docs = sample()
    chosen, shares = M.mixture(*frames(spark, docs, TARGETS))
    rows = {r["source"]: r for r in shares.collect()}
    assert set(rows) == {"big", "mid", "small", "absent"} and rows["absent"]["tokens"] == 0
    picked = chosen.collect()
    assert len({r["doc_id"] for r in picked}) == len(picked)
    total = sum(r["tokens"] * r["repeats"] for r in picked)
    for s, share, most in TARGETS[:3]:
        mine = [r for r in picked if r["source"] == s]
        assert max(r["repeats"] for r in mine) <= most and max(r["repeats"] for r in mine) - min(r["repeats"] for r in mine) <= 1
        got = sum(r["tokens"] * r["repeats"] for r in mine)
        assert got == rows[s]["tokens"] and abs(got - rows[s]["budget_tokens"]) <= 400
        assert rows[s]["share"] == pytest.approx(got / total) and got / total >= share - 0.01
    again, _ = M.mixture(*frames(spark, docs[::-1], TARGETS))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, picked))
    other, _ = M.mixture(*frames(spark, docs, TARGETS), seed=8)
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, picked))


def test_buckets_do_not_change_the_choice(spark, monkeypatch):
    out = []
    for bucket in (4096, 7):
        monkeypatch.setattr(M, "BUCKET", bucket)
        out.append(sorted(map(tuple, M.mixture(*frames(spark, sample(800), TARGETS))[0].collect())))
    assert out[0] == out[1]


def test_too_large_a_total_gives_all_there_is(spark):
    docs = [(1, "a", "en", 10), (2, "a", "en", 20), (3, "b", "de", 5), (4, "b", "de", None)]
    chosen, shares = M.mixture(*frames(spark, docs, [("a", 0.5, 2), ("b", 0.5, 3)]), total=10_000)
    assert {(r["doc_id"], r["repeats"]) for r in chosen.collect()} == {(1, 2), (2, 2), (3, 3)}
    assert {(r["source"], r["tokens"]) for r in shares.collect()} == {("a", 60), ("b", 15)}


def test_repeated_documents_count_once_and_those_without_an_id_are_left_out(spark):
    docs = [(1, "a", "en", 10), (1, "a", "en", 10), (None, "a", "en", 50), (2, "b", "en", 10)]
    chosen, _ = M.mixture(*frames(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)]))
    assert sorted(map(tuple, chosen.collect())) == [(1, "a", 10, 1), (2, "b", 10, 1)]


def test_a_source_misses_its_budget_by_less_than_a_document(spark):
    """Also where sources run short and repeat."""
    docs = sample(2000)
    longest = {}
    for _, s, _, n in docs:
        longest[s] = max(longest.get(s, 0), n)
    whole = sum(n for _, s, _, n in docs if s in ("big", "mid", "small"))
    for total in (None, 0.3 * whole, whole, 2.0 * whole):
        _, shares = M.mixture(*frames(spark, docs, TARGETS), total=total)
        for r in shares.collect():
            assert abs(r["tokens"] - r["budget_tokens"]) <= longest.get(r["source"], 0) or r["tokens"] == r["budget_tokens"] == 0
        assert total is None or abs(sum(r["tokens"] for r in shares.collect()) - min(total, 1.0 * sum(r["budget_tokens"] for r in shares.collect()))) <= 1200


def test_empty_documents_and_targets(spark):
    chosen, shares = M.mixture(*frames(spark, [], TARGETS))
    assert chosen.count() == 0 and shares.count() == 4
    chosen, shares = M.mixture(*frames(spark, [(1, "a", "en", 5)], []))
    assert chosen.count() == 0 and shares.count() == 0
