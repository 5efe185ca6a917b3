import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from saffron.llm import sharding
from tests.llm.rows import ODD, docs


def test_shards_differ_by_a_row_and_slots_have_no_gap(spark):
    for rows in (ODD, ODD * 9, ODD[:3], [ODD[0]]):
        out = sharding.shard(docs(spark, rows, clash=True).repartition(3)).collect()
        want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
        sizes = Counter(r["shard"] for r in out)
        assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(8)) <= 1
        for s, n in sizes.items():
            assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
        assert {(r["law"], r["grown_shard"]) for r in out} == {("rows", None)}
    assert sharding.shard(docs(spark, [])).collect() == []


def test_many_blocks_and_a_hot_row(spark, monkeypatch):
    monkeypatch.setattr(sharding, "block_rows", lambda rows: 100)
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text")).repartition(7)
    out = sharding.shard(df)
    rows = out.collect()
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, i) for s in range(8) for i in range(750)]
    hot = Counter(r["shard"] for r in rows if r["text_crc32"] == zlib.crc32(b"same"))
    assert all(180 <= hot[s] <= 320 for s in range(8))  # 250 each by chance, five standard deviations
    assert sorted(map(str, sharding.shard(df).collect())) == sorted(map(str, rows))
    other = sharding.shard(df, seed=5).collect()
    assert sorted(map(str, other)) != sorted(map(str, rows))


def test_the_matrix_has_exact_margins_and_the_law_of_a_permutation():
    counts, totals = np.array([30, 0, 7, 50, 13]), np.array([25, 25, 24, 26])
    before = np.concatenate([[0], np.cumsum(counts)])
    cells = np.zeros((400, 5, 4))
    for seed in range(400):
        m = np.array([sharding.matrix_row(before, totals, p, seed) for p in range(5)])
        assert (m.sum(1) == counts).all() and (m.sum(0) == totals).all() and (m >= 0).all()
        cells[seed] = m
    mean = counts[:, None] * totals[None] / 100
    var = mean * (1 - totals / 100)[None] * ((100 - counts) / 99)[:, None]
    assert (np.abs(cells.mean(0) - mean) <= 4.5 * np.sqrt(var / 400) + 1e-9).all()
    assert (np.abs(cells.var(0) - var) <= 0.35 * var + 0.2).all()


def test_draws_beyond_numpy_are_as_wide_as_they_should_be():
    rng = np.random.default_rng(3)
    for good, bad, draws in ((3 * 10**9, 7 * 10**9, 10**6), (7 * 10**9, 3 * 10**9, 9 * 10**9)):
        total = good + bad
        x = np.array([sharding._hypergeometric(rng, good, bad, draws) for _ in range(4000)], float)
        mean, var = draws * good / total, draws * good / total * bad / total * (total - draws) / (total - 1)
        assert abs(x.mean() - mean) < 4 * (var / 4000) ** 0.5 and 0.9 < x.var() / var < 1.1
    small = np.array([sharding._hypergeometric(rng, 5, 10**10, 4 * 10**9) for _ in range(2000)])
    assert small.min() >= 0 and small.max() <= 5 and abs(small.mean() - 2) < 0.1


def test_every_row_is_as_likely_in_every_shard(spark):
    df = docs(spark, [(i, str(i), "en", "web", 1) for i in range(64)]).repartition(4)
    seen = np.zeros((64, 8))
    for seed in range(40):
        for r in sharding.shard(df, seed=seed).collect():
            seen[r["doc_id"], r["shard"]] += 1
    assert (seen.sum(1) == 40).all() and ((seen - 5) ** 2 / 5).sum() < 63 * 7 + 6 * (2 * 63 * 7) ** 0.5
