import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tickloom.llm import packing as K
from tickloom.llm import tokens


def frames(spark, docs, caps):
    d = spark.createDataFrame([(*r, "en", "x", 1) for r in docs], "doc_id long, tokens long, prompt_tokens long, lang string, source string, capacity int")
    return d, spark.createDataFrame(caps, "container string, capacity_tokens int")


def check(rows, docs, caps, loss_share=1.0, per_segment=K.TOKENS_PER_SEGMENT):
    """No limit is exceeded, every document is there once in every size, whole where it can be."""
    sizes = {d[0]: d for d in docs}
    for name, cap in caps:
        mine = [r for r in rows if r["container"] == name]
        per, pieces = defaultdict(list), defaultdict(list)
        for r in mine:
            per[r["container_id"]].append(r)
            pieces[r["doc_id"]].append(r)
        assert set(pieces) == {i for i, d in sizes.items() if d[1] and d[1] > 0}
        for i, ps in pieces.items():
            at = 0
            for k, p in enumerate(sorted(ps, key=lambda p: p["token_from"])):
                assert (p["piece"], p["token_from"]) == (k, at)
                at += p["tokens"]
            assert at == sizes[i][1]
            if sizes[i][1] <= cap and sizes[i][1] - sizes[i][2] <= cap * loss_share:
                assert len(ps) == 1
        for rs in per.values():
            assert sum(r["tokens"] for r in rs) <= cap and len(rs) <= max(1, cap // per_segment)
            assert sorted(r["place"] for r in rs) == list(range(len(rs)))
            loss = sum(r["tokens"] - max(0, min(r["tokens"], sizes[r["doc_id"]][2] - r["token_from"])) for r in rs)
            assert loss <= max(1, int(cap * loss_share))
        yield name, sum(r["tokens"] for r in mine) / (cap * len(per))


@pytest.mark.parametrize(("share", "group"), [(1.0, 4096), (1.0, 64), (0.5, 128)])
def test_limits_hold_and_little_is_unused(spark, share, group):
    rng = random.Random(4)
    docs = [(i, n := int(rng.lognormvariate(5, 1.2)) + 1, rng.randrange(min(n, 30))) for i in range(1200)] + [(9000, 0, 0), (9001, None, None), (9002, 5000, 10), (9003, 1024, 0)]
    caps = [("short", 256), ("long", 2048)]
    rows = K.fill(*frames(spark, docs, [*caps, caps[0]]), loss_share=share, group=group).collect()
    for _, filled in check(rows, docs, caps, share):
        assert filled > (0.93 if share == 1.0 else 0.4)


def test_all_three_limits_bind(spark):
    """Items heavy in one resource each: containers are full by tokens, by segments and by loss."""
    rng = random.Random(5)
    docs = [(i, rng.randrange(90, 130), 0) for i in range(200)]  # all bear loss
    docs += [(1000 + i, rng.randrange(200, 260), 190) for i in range(200)]  # mostly prompt
    docs += [(2000 + i, rng.randrange(1, 4), 0) for i in range(1500)]  # tiny
    rows = K.fill(*frames(spark, docs, [("c", 1024)]), loss_share=0.5, tokens_per_segment=64).collect()
    assert dict(check(rows, docs, [("c", 1024)], 0.5, 64))
    per = {}
    for r in rows:
        t, n, x = per.get(r["container_id"], (0, 0, 0))
        per[r["container_id"]] = t + r["tokens"], n + 1, x + r["loss_tokens"]
    assert sum(t > 900 for t, _, _ in per.values()) > 10 and sum(n == 16 for _, n, _ in per.values()) > 10 and sum(x > 480 for _, _, x in per.values()) > 10


def test_many_tiny_and_equal_items_keep_the_segment_limit(spark):
    docs = [(i, 1, 0) for i in range(300)] + [(1000 + i, 100, 0) for i in range(50)]
    rows = K.fill(*frames(spark, docs, [("c", 160)])).collect()
    assert dict(check(rows, docs, [("c", 160)]))


def test_repeated_documents_count_once_and_those_without_an_id_are_left_out(spark):
    docs = [(1, 40, 3), (2, 5, 0), (3, 7, None)]
    rows = K.fill(*frames(spark, docs * 3 + [(None, 9, 0)], [("c", 16)])).collect()
    assert dict(check(rows, [(1, 40, 3), (2, 5, 0), (3, 7, 0)], [("c", 16)]))


def test_empty_tables_and_no_sizes(spark):
    assert K.fill(*frames(spark, [], [("c", 10)])).count() == 0
    assert K.fill(*frames(spark, [(1, 5, 0)], [])).count() == 0
    assert K.fill(*frames(spark, [(1, 5, 0)], [("c", None)])).count() == 0
    assert K.fill(*frames(spark, [(1, 5, 0)], [("c", 1)])).count() == 5


def test_pack_prefers_what_fills_the_room():
    demands = np.array([[6, 1, 6], [5, 1, 5], [4, 1, 4], [5, 1, 5]])
    bins, places = K.pack(demands, np.array([10, 4, 10]))
    assert Counter(bins.tolist()) == {0: 2, 1: 2} and bins[0] == bins[2] and sorted(places[bins == 0]) == [0, 1]
    assert K.pack(np.zeros((0, 3), int), np.array([1, 1, 1]))[0].size == 0


def test_token_sizes_of_nulls_blanks_and_long_texts(spark):
    long = "word " * 200_000
    docs = spark.createDataFrame([(1, None, None, "s", 3), (2, "", "en", None, 3), (3, "a b\nc d", "en", "s", 3), (4, long, "en", "s", 3), (5, "<|endoftext|>", "en", "s", 3)], "doc_id int, text string, lang string, source string, tokens int")
    got = {r["doc_id"]: (r["tokens"], r["prompt_tokens"]) for r in tokens.sizes(docs).collect()}
    e = tokens.encoder().encode_ordinary
    assert got[1] == got[2] == (0, 0)
    assert got[3] == (len(e("a b\nc d")), len(e("a b")))
    assert got[4] == (len(e(long)), 0) and got[5][0] == len(e("<|endoftext|>")) > 1
