import math

import numpy as np
import pytest

from saffron.llm import topk


def brute(rows, every=20, k=20, scale=64):
    usable = {}
    for i, v in sorted((r for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], [math.floor(scale * x) for x in r[1]])):
        usable.setdefault(i, [math.floor(scale * float(np.float32(x))) for x in v])
    out = []
    for q in usable:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", *([extra] if extra else []))


def test_ties_bad_vectors_and_clashing_columns(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 8) / 4]) for i in range(400)]  # few values, so many ties
    rows += [(400, None), (420, [None] + [0.0] * 7), (440, [float("nan")] + [0.0] * 7), (460, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    have = sorted(map(tuple, topk.top_k(frame(spark, rows, "1 AS rank"), every=20, k=20).collect()))
    assert have == brute(rows)


def test_identical_vectors_and_few_candidates(spark):
    same = [(i, [0.5, -0.5]) for i in range(0, 3000)]
    have = sorted(map(tuple, topk.top_k(frame(spark, same), every=1000, k=5).collect()))
    assert have == brute(same, every=1000, k=5)
    few = [(0, [1.0]), (20, [2.0])]
    assert sorted(map(tuple, topk.top_k(frame(spark, few)).collect())) == brute(few)
    assert topk.top_k(frame(spark, [])).count() == 0
    assert topk.top_k(frame(spark, [(20, None)])).count() == 0


@pytest.mark.parametrize("spread", [0.01, 1.0, 1000.0])
def test_bounds_never_lose_a_neighbour(spread):
    rng = np.random.default_rng(int(spread * 100))
    x = np.floor(rng.standard_normal((700, 16)) * spread * 64).astype(np.int64)
    x[:, :4] *= 5  # a few dimensions matter most, so that bounds close early
    ids = np.arange(700)
    for q, places, scores in topk.search_block(ids[:40], x[:40], topk.Lists(ids, x), 10):
        s = x @ x[q]
        want = sorted((i for i in range(700) if i != q), key=lambda i: (-s[i], i))[:10]
        assert list(places) == want and list(scores) == [s[i] for i in want]


def test_rows_that_share_an_id_are_all_candidates(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.integers(-8, 9, 8) / 8]) for i in range(60)]
    rows += [(7, [8.0] * 8), (7, [8.0] * 8), (20, [2.0] * 8), (40, [-1.0] * 8), *[(33, [0.5] * 8)] * 300]
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    want = []
    for q in (0, 20, 40):
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for j, x in whole if j == q for i, y in whole if i != q)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:20], 1)]
    assert sorted(map(tuple, topk.top_k(frame(spark, rows)).collect())) == sorted(want)


def _few_count(rng, n):
    x = np.floor(rng.standard_normal((n, 16)) * 64).astype(np.int64)
    x[:, :2] *= 40  # two dimensions matter most
    return x


def test_entries_that_decide_nothing_are_not_read():
    rng = np.random.default_rng(11)
    x = _few_count(rng, 2000)
    plain = 2000 * 16 * 30
    lists = topk.Lists(np.arange(2000), x)
    first = {q: (list(p), list(s)) for q, p, s in topk.search_block(np.arange(30), x[:30], lists, 5)}
    assert lists.entries < 0.8 * plain  # every entry once would be plain scoring
    # a score that others reach closes lists sooner, and what is above it is still found
    floors = np.array([first[q][1][2] for q in range(30)], float)
    again = topk.Lists(np.arange(2000), x)
    second = {q: (list(p), list(s)) for q, p, s in topk.search_block(np.arange(30), x[:30], again, 5, floors + 10**7)}
    assert again.entries < lists.entries and all(not p for p, _ in second.values())
    third = {q: (list(p), list(s)) for q, p, s in topk.search_block(np.arange(30), x[:30], topk.Lists(np.arange(2000), x), 5, floors)}
    assert all(third[q][1][:3] == first[q][1][:3] for q in range(30))


def test_factors_of_zero_need_no_list():
    x = np.zeros((100, 8), np.int64)
    x[:, 3] = np.arange(100)
    lists = topk.Lists(np.arange(100), x)
    found = list(topk.search_block(np.array([100, 99]), np.array([[0] * 3 + [-1] + [0] * 4, [0] * 8]), lists, 3))
    assert [(q, list(p), list(s)) for q, p, s in found] == [(100, [0, 1, 2], [0, -1, -2]), (99, [0, 1, 2], [0, 0, 0])] or sorted((q, list(p)) for q, p, _ in found) == [(99, [0, 1, 2]), (100, [0, 1, 2])]
    assert lists.entries <= 100


def test_several_blocks_share_what_the_first_one_finds(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 128)
    monkeypatch.setattr(topk, "QUERIES", 16)
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.integers(-9, 10, 12) / 8]) for i in range(1000)] + [(2000 + i, [1.0] * 12) for i in range(300)]
    have = sorted(map(tuple, topk.top_k(frame(spark, rows).repartition(5), every=20, k=20).collect()))
    assert have == brute(rows)


def test_sums_beyond_the_exact_floats_are_scored_in_full(spark):
    rows = [(i, [1e6 + i, -1e6 * i]) for i in range(50)]
    assert sorted(map(tuple, topk.top_k(frame(spark, rows), every=20, k=3).collect())) == brute(rows, k=3)
