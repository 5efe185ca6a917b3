"""Substring index, deep pages, searches for many vectors, and grants that all tasks share."""

import itertools
import random
import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from saffron.model import star_schema
from saffron.operators import ranks, vectors
from saffron.plans import pages as pages_module
from saffron.plans import search as plan
from saffron.plans import substring
from saffron.plans.filters import Condition, Group, Search
from saffron.plans.search import By, pages_of
from saffron.sources import completion
from saffron.streaming.grants import Grants
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    c = star_schema(spark, SMALL)
    recipes = c.described().withColumn("name", F.when(F.col("id") % 50 == 0, F.concat("name", F.lit(" Crème Brûlée İ ẞ"))).when(F.col("id") % 61 == 0, None).otherwise(F.col("name"))).cache()
    kept = substring.build(recipes, substring.texts_of(recipes, c.searched_keywords()), str(tmp_path_factory.mktemp("index") / "i"), block_rows=100)
    return replace(c, recipes=recipes.drop("title", "author")), kept


@pytest.mark.parametrize("value", ["urgent", "URGENT 1", "brûlée", "CRÈME", "i̇", "ẞ", "ed", "-", "3-MEDIUM 10", "nation_12", "zzz", "x%", "customer#000000014", "red", "hot ring"])
def test_a_search_finds_the_same_with_the_index(spark, indexed, value):
    c, kept = indexed
    found = lambda search, cat: sorted(r[0] for r in plan.build(search, cat).select("id").collect())
    conditions = [Condition(f, op, value) for f in ("name", "author", "keywords") for op in ("contains", "starts")]
    searches = [Search(text=value), Search(groups=(Group("or", tuple(conditions[:4])), Group("and", (conditions[0], Condition("ingredients", "not_contains", "low"))), Group("and", (conditions[4],))), group_logic="or")]
    for search in searches:
        assert found(search, replace(c, substrings=kept)) == found(search, c)


def test_odd_searches_with_the_index(spark, indexed):
    c, kept = indexed
    odd = [Search(), Search(lists=(3,)), Search(book=7, text="urgent"), Search(groups=(Group("and", (Condition("name", "sounds like", "urgent"), Condition("author", "equals", "nation_7"))),)), Search(groups=(Group("or", (Condition("name", "contains", "urgent"), Condition("instructions", "equals", "f"))),))]
    for search in odd:
        assert sorted(r[0] for r in plan.build(search, replace(c, substrings=kept)).select("id").collect()) == sorted(r[0] for r in plan.build(search, c).select("id").collect())


def test_few_blocks_are_read_for_a_rare_text(spark, indexed):
    c, kept = indexed
    search = Search(groups=(Group("and", (Condition("name", "contains", "urgent 1000"),)),))
    narrowed = kept.narrowed(search)
    files = lambda df: len({f.split("block=")[1].split("/")[0] for f in df.inputFiles() if "block=" in f})
    assert kept.blocks >= 15 and files(kept.rows) == kept.blocks
    ids = {r[0] for r in narrowed.select("id").collect()}
    want = {r[0] for r in c.recipes.where("lower(name) LIKE '%urgent 1000%'").select("id").collect()}
    assert want <= ids and len(ids) <= len(want) + 5
    assert kept.containing("name", "zzzz").count() == 0 and kept.containing("name", "zz") is None and kept.containing("price", "abc") is None
    read = narrowed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [block" in read.replace("isnotnull(block#", "[block") or "block" in read.split("PartitionFilters")[1][:60]


def test_any_page_is_that_of_a_full_sort(spark, monkeypatch):
    monkeypatch.setattr(pages_module, "SPLITS", 6)
    monkeypatch.setattr(pages_module, "SAMPLE", 60)
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "a", "b", "é", "z" * 3]), rng.choice([None, 1.5, float(i % 11)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, s string, x double").repartition(5).cache()
    for down in itertools.product((True, False), repeat=2):
        order = [By(F.col("s"), down[0]), By(F.col("x"), down[1]), By(F.col("id"))]
        whole = [r["id"] for r in df.orderBy(*[k.sorted() for k in order]).collect()]
        pages = pages_of(df, order, narrow=100)
        for number in (1, 2, 37, 50, 99, 100, 5000):
            at = min(number, 100)
            assert [r["id"] for r in pages.page(number, 30).collect()] == whole[(at - 1) * 30 : at * 30], (down, number)
        assert all(r.rows <= 100 for r in pages.ranges(0, 3000)) and len(pages.ranges(1500, 1530)) <= 6


def test_pages_of_equal_and_no_rows(spark):
    same = spark.range(500).select(F.lit(1).alias("x"))
    pages = pages_of(same, [By(F.col("x"))], narrow=50)
    assert pages.page(3, 100).count() == 100 and pages.page(1, 10).count() == 10
    assert pages_of(same.limit(0), [By(F.col("x"))]).page(2, 10).count() == 0


def test_many_vector_searches_equal_single_ones(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES", 7)
    monkeypatch.setattr(vectors, "ROWS", 64)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 8)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [(2000, [0.0] * 8), (2001, None), (2002, [1.0, None] * 4), (2003, [1.0, 2.0])]
    e = spark.createDataFrame(rows, "recipe_id long, embedding array<double>").repartition(4).cache()
    asked = [3, 17, 44, 101, 1005, 2000, 2002, 2003, *range(200, 212)]
    queries = e.where(F.col("recipe_id").isin(asked)).select(F.col("recipe_id").alias("query_id"), "embedding")
    have = {}
    for r in vectors.search_many(e, queries, 9, exclude_self=True).collect():
        have.setdefault(r["query_id"], []).append((r["rank"], r["recipe_id"]))
    plain = e.where("size(embedding) = 8 AND NOT exists(embedding, x -> x IS NULL)")
    for q in asked:
        if q in (2002, 2003):
            continue
        vector = next(v for i, v in rows if i == q)
        want = [(r["rank"], r["recipe_id"]) for r in vectors.search(plain, vector, 9, exclude=q).collect()]
        assert sorted(have[q]) == sorted(want), q
    assert 2002 not in have and 2003 not in have
    assert vectors.search_many(e, queries.limit(0), 5).count() == 0 and vectors.search_many(e.limit(0), queries, 5).count() == 0


@pytest.mark.parametrize("tasks", [1, 4])
def test_the_rate_holds_for_all_tasks_together(spark, tasks):
    prompts = spark.range(90).select(F.col("id").cast("string").alias("key"), F.lit("p").alias("prompt"), F.lit("m").alias("model"))
    grants = Grants(spark, 60 * 30, at_once=16, burst=3)
    try:
        stamped = lambda prompt, model: (str(time.time()), (0.0, 1, 1))
        times = sorted(float(r["response"]) for r in completion.completed(prompts, stamped, tasks=tasks, grants=grants.client).collect())
        assert len(times) == 90 and abs((len(times) - 3) / (times[-1] - times[0]) / 30 - 1) < 0.05  # two more than the rate go out at once
    finally:
        grants.stop()


def test_slots_bound_the_calls_at_once_and_come_back(spark):
    prompts = spark.range(24).select(F.col("id").cast("string").alias("key"), F.lit("p").alias("prompt"), F.lit("m").alias("model"))
    grants = Grants(spark, 1e9, at_once=2)

    def slow(prompt, model):
        began = time.time()
        time.sleep(0.05)
        if began % 0.01 < 0.001:
            raise ValueError("no")
        return f"{began} {time.time()}", (0.0, 1, 1)

    try:
        answers = [r["response"] for r in completion.completed(prompts, slow, tasks=4, first_wait=0.0, grants=grants.client).collect()]
        spans = [tuple(map(float, a.split())) for a in answers if a]
        assert max(sum(b <= x < e for b, e in spans) for x, _ in spans) <= 2
        with grants.client.connected() as call:  # breaks off while it holds a slot
            with pytest.raises(KeyError), call():
                raise KeyError
        with pytest.raises(OSError), grants.client.__class__(grants.client.host, grants.client.port, "wrong").connected() as call, call():
            pass
        assert len(completion.completed(prompts, lambda p, m: ("ok", (0.0, 1, 1)), tasks=4, grants=grants.client).where("response = 'ok'").collect()) == 24
    finally:
        grants.stop()


def test_places_in_a_group_of_any_size(spark):
    rng = random.Random(9)
    rows = [(i, None if i % 10 == 0 else "hot" if i % 3 else f"g{i % 40}", rng.randrange(50), f"x{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, grp string, at int, _other string").repartition(6)
    want, beside = {}, {}
    for g in {r[1] for r in rows}:
        mine = [r[0] for r in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))]
        for i, id_ in enumerate(mine):
            want[id_] = i + 1
            beside[id_] = (mine[i - 1] if i else None, mine[i + 1] if i + 1 < len(mine) else None)
    out = ranks.ranked(df, "grp", ["at", "id"], "place")
    assert out.columns == [*df.columns, "place"] and {r["id"]: r["place"] for r in out.collect()} == want
    assert {r["id"]: (r["previous_id"], r["next_id"]) for r in ranks.neighbours(df, "grp", ["at", "id"], "id").collect()} == beside
    assert ranks.neighbours(df.limit(0), "grp", ["at"], "id").count() == 0
    spread = spark.createDataFrame([(i,) for i in range(4000)], "id int").select(F.lit(1).alias("grp"), "id").repartitionByRange(4, "grp", "id")
    assert spread.groupBy(F.spark_partition_id()).count().count() == 4  # one group lies in several partitions
