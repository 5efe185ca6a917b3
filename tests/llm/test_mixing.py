import re
from collections import Counter, defaultdict

import pytest

from saffron.llm import mixing
from tests.conftest import SMALL
from tests.llm.rows import docs


def brute_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(spark, clash):
    df = docs(spark, clash=clash)
    sizes = Counter()
    for r in df.collect():
        sizes[r["source"]] += words(r["text"])
    want = brute_targets(sizes)
    out, _ = mixing.mix(df)
    rows = out.collect()
    assert len(rows) == df.count()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
    taken = Counter()
    by_id = {r["doc_id"]: r["source"] for r in df.collect() if r["doc_id"] is not None}
    for r in rows:
        if r["doc_id"] is not None:
            assert r["target"] == pytest.approx(want[by_id[r["doc_id"]]])
            assert r["source_size"] == sizes[by_id[r["doc_id"]]]
            taken[by_id[r["doc_id"]]] += r["taken"]
    assert taken["books"] == int(want["books"])


def test_an_empty_table_gives_an_empty_mix(spark):
    out, plan = mixing.mix(docs(spark, []))
    assert out.count() == 0 and plan.count() == 0
    assert mixing.mixed(docs(spark, [])).count() == 0


def test_taken_words_come_to_the_target_and_stretches_hold_the_shares(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    out, plan = mixing.mix(df)
    sources = {r["doc_id"]: r["source"] for r in df.collect()}
    taken, target = Counter(), {}
    for r in out.collect():
        taken[sources[r["doc_id"]]] += r["taken"]
        target[sources[r["doc_id"]]] = r["target"]
    assert all(taken[s] == int(target[s]) for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in out.collect()))
    # in any first half of the mix each source is off by a few blocks at most
    slots = defaultdict(int)
    for r in plan.select("slot", "source_key", "words").collect():
        slots[r["slot"], r["source_key"]] += r["words"]
    order = sorted({s for s, _ in slots})
    total, half = Counter(), Counter()
    for (slot, key), n in slots.items():
        total[key] += n
        half[key] += n if slot < order[len(order) // 2] else 0
    for key in total:
        assert abs(half[key] - total[key] / 2) <= 6 * mixing.BLOCK


def test_reruns_agree(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    first, second = (sorted(map(tuple, mixing.mix(x)[0].collect())) for x in (df, df.repartition(7)))
    assert first == second


def test_mixed_repeats_whole_documents(spark):
    df = docs(spark, [(i, "w " * 10, "en", "a" if i < 30 else "b", 20) for i in range(40)], clash=True)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    n = Counter(r["source"] for r in out.collect())
    want = brute_targets({"a": 300, "b": 100})
    assert all(want[s] <= 10 * n[s] < want[s] + 10 for s in "ab")
    assert max(Counter(r["doc_id"] for r in out.collect()).values()) <= 2


@pytest.mark.parametrize("id_", [7, None])
def test_equal_rows_each_have_their_own_copies(spark, id_):
    # a's weight is three times b's, so b's target is half its size or so while a is doubled
    rows = [(i, "w " * 10, "en", "a", 20) for i in range(300)] + [(id_, "w " * 10, "en", "b", 20)] * 700
    sizes = {"a": 3000, "b": 7000, "c": 50000}
    rows += [(1000 + i, "w " * 100, "en", "c", 200) for i in range(500)]
    want = brute_targets(sizes)
    n = Counter()
    for r in mixing.mixed(docs(spark, rows).repartition(5)).collect():
        n[r["source"]] += words(r["text"])
    assert all(want[s] <= n[s] < want[s] + 100 for s in "abc")


def test_equal_rows_of_a_source_lose_half(spark):
    rows = [(None, "w " * 10, "en", "a", 20)] * 6000 + [(5, "w " * 10, "en", "b", 20)] * 1000 + [(i, "w " * 10, "en", "c", 20) for i in range(500)]
    want = brute_targets({"a": 60000, "b": 10000, "c": 5000})
    n = Counter(r["source"] for r in mixing.mixed(docs(spark, rows)).collect())
    assert all(want[s] <= 10 * n[s] < want[s] + 10 for s in "abc")


def test_mixed_rows_stand_in_the_order_of_the_schedule(spark):
    rows = [(i, "w " * 16, "en", "a" if i < 4000 else "b", 32) for i in range(8000)]
    out = [r["source"] for r in mixing.mixed(docs(spark, rows).repartition(3)).collect()]
    total, half = Counter(out), Counter(out[: len(out) // 2])
    assert all(abs(half[s] - total[s] / 2) <= 6 * mixing.BLOCK / 16 for s in "ab")


def test_blocks_of_a_huge_target_are_numbered_run_by_run(spark):
    from pyspark.sql import functions as F

    counts = spark.createDataFrame([("=a", 10**10, 9 * 10**9), ("=b", 10**10, 3), ("-", 10**10, mixing.RUN + 1)], "source_key string, slots long, blocks long")
    small = mixing.numbered_blocks(counts.where("source_key <> '=a'")).groupBy("source_key").agg(F.count("*"), F.min("block"), F.max("block"), F.countDistinct("block"))
    assert sorted(map(tuple, small.collect())) == [("-", mixing.RUN + 1, 0, mixing.RUN, mixing.RUN + 1), ("=b", 3, 0, 2, 3)]
    # a target of 1e13 words: a few of its blocks are looked at, and no row holds more than a run of them
    some = mixing.numbered_blocks(counts.where("source_key = '=a'")).limit(5).collect()
    assert len(some) == 5 and all(0 <= r["block"] < 9 * 10**9 for r in some)
