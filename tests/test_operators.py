"""Vectors, navigation, archives, the workflow's table and the rate limiter on small inputs."""

import zipfile

import pytest
from pyspark.sql import functions as F

from saffron.functions import text, values
from saffron.operators import keywords, navigation, vectors, workflow
from saffron.sources import archive, completion
from saffron.streaming.limiter import Limiter, TokenBucket


def wide(*leading):
    return [float(x) for x in leading] + [0.0] * (32 - len(leading))


def stored(spark, rows):
    return spark.createDataFrame([(k, wide(*v)) for k, v in rows], "recipe_id string, embedding array<float>")


@pytest.mark.parametrize(
    "rows, query, order",
    [
        ([("thai", (0.95, 0.05)), ("indian", (0.7, 0.3)), ("italian", (0, 1))], (1,), ["thai", "indian", "italian"]),
        ([("a", (0.1, 0.9)), ("b", (0.5, 0.5)), ("c", (0.9, 0.1))], (1,), ["c", "b", "a"]),
        ([("zero", ()), ("x", (-1,))], (1,), ["x", "zero"]),
    ],
)
def test_nearest_first_and_the_zero_vector_last(spark, rows, query, order):
    near = vectors.search(stored(spark, rows), wide(*query), 5).orderBy("rank").collect()
    assert [r["recipe_id"] for r in near] == order


def test_similar_leaves_itself_out_and_needs_a_vector(spark):
    e = stored(spark, [("source", (1,)), ("other", (0.5, 0.5))])
    assert [r["recipe_id"] for r in vectors.similar(e, "source", 10).collect()] == ["other"]
    assert vectors.similar(e, "none").count() == 0
    assert vectors.by_text(spark, e, None, "soup").count() == 0
    assert vectors.by_text(spark, e, lambda _: wide(1), "soup", 1).first()["recipe_id"] == "source"


def test_ties_of_order_pass_each_other_over(spark):
    rows = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, 1), (4, 1, 2), (5, 2, 1)], "id long, book_id int, ord int")
    have = {r["id"]: (r["previous_id"], r["next_id"]) for r in navigation.in_book(rows).collect()}
    assert have == {1: (None, 2), 2: (1, 4), 3: (1, 4), 4: (2, None), 5: (None, None)}


@pytest.mark.parametrize("n", [1, 16, 17, 33, 151, 400])
def test_blocks_cover_every_file(spark, n):
    blocks = spark.range(1).select(values.blocks(F.sequence(F.lit(1), F.lit(n))).alias("b")).first()["b"]
    assert sorted({x for b in blocks for x in b}) == list(range(1, n + 1))
    assert len(blocks) == (1 if n <= 16 else 16)
    assert all(b[-1] == after[0] for b, after in zip(blocks, blocks[1:], strict=False))


def test_an_archive_is_read_in_its_reading_order(spark, tmp_path):
    package = """<package xmlns="http://www.idpf.org/2007/opf"><manifest>
      <item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="a" href="ch1.xhtml" media-type="application/xhtml+xml"/>
      <item id="b" href="ch2.xhtml" media-type="application/xhtml+xml"/><item id="i" href="images/x.jpg" media-type="image/jpeg"/></manifest>
      <spine><itemref idref="n"/><itemref idref="b"/><itemref idref="a"/><itemref idref="i"/><itemref idref="lost"/></spine></package>"""
    for name, container in (("one", '<c xmlns="urn:x"><rootfile full-path="OEBPS/p.opf"/></c>'), ("two", None)):
        with zipfile.ZipFile(tmp_path / f"{name}.epub", "w") as z:
            if container:
                z.writestr("META-INF/container.xml", container)
            z.writestr("OEBPS/p.opf", package)
            z.writestr("OEBPS/ch1.xhtml", "<p>first é</p>")
            z.writestr("OEBPS/ch2.xhtml", b"\xff\xfe not text")
            z.writestr("OEBPS/images/x.jpg", b"jpg")
    (tmp_path / "broken.epub").write_bytes(b"no archive")
    rows = archive.members(spark, str(tmp_path)).cache()
    order = archive.reading_order(rows)
    for name in ("one", "two"):
        paths = [r["path"] for r in order.where(F.col("book").contains(name)).orderBy("place").collect()]
        assert paths == ["OEBPS/ch2.xhtml", "OEBPS/ch1.xhtml"]
    assert {r["text"] for r in archive.contents(rows, order).collect()} == {"<p>first é</p>"}
    book = rows.where(F.col("book").contains("one")).first()["book"]
    assert archive.member(rows, book, "OEBPS/images/x.jpg").first()["data"] == b"jpg"
    assert archive.member(rows, book, "OEBPS/none.jpg").count() == 0


def test_completions_are_retried_and_failures_kept(spark):
    def provider(prompt, model):
        if prompt == "bad":
            raise ValueError("no")
        return f"{model}:{prompt}", (0.5, 10, 2)

    waits = []
    with pytest.raises(ValueError):
        completion.retried(provider, "bad", "m", sleep=waits.append)
    assert waits == [2, 4, 8, 16]
    rows = completion.completed(spark.createDataFrame([("a", "p", "m")], "key string, prompt string, model string"), provider).collect()
    assert [tuple(r) for r in rows] == [("a", "m:p", 0.5, 10, 2, None)]


def test_the_bucket_holds_its_rate():
    now = [0.0]
    bucket = TokenBucket.per_minute(60, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(10):
        assert bucket.acquire(blocking=False)
    assert not bucket.acquire(blocking=False) and not bucket.acquire(timeout=0.5)
    assert bucket.acquire() and now[0] == pytest.approx(1.0)


def test_merges_are_applied_one_after_the_other():
    assert keywords.resolved({"a": "b", "b": "c"}) == {"a": "c", "b": "c"}
    assert keywords.resolved({"b": "c", "a": "b"}) == {"b": "c", "a": "b"}


def test_singulars(spark):
    words = ["berries", "tomatoes", "dishes", "carrots", "hummus", "bay leaves", "glass"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", keywords.singular(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in rows} == {"berries": "berry", "tomatoes": "tomato", "dishes": "dish", "carrots": "carrot", "hummus": None, "bay leaves": "bay leaf", "glass": None}


def test_repeated_titles_keep_the_first(spark):
    rows = spark.createDataFrame([(1, 0, 0, "Soup"), (1, 1, 0, " soup "), (1, 1, 1, "Stew")], "report_id int, chapter int, place int, name string")
    assert sorted(r["name"] for r in workflow.without_repeats(rows).collect()) == ["Soup", "Stew"]


def test_navigation_and_toggles_over_whole_tables(spark):
    from saffron.queries.tables import QUERIES
    from tests.conftest import SMALL

    ids = [r[0] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id").collect()]
    order = sorted(ids, key=lambda i: (i % 7, i))
    have = sorted(QUERIES["nav_in_ranked_all"](spark, SMALL).collect(), key=lambda r: r["position"])
    assert [tuple(r) for r in have] == [(x, i, order[i - 1] if i else None, order[i + 1] if i + 1 < len(order) else None) for i, x in enumerate(order)]
    items = {(r[0], r[1]) for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_suppkey", "l_orderkey").collect()}
    pairs = {(1 + r[0] % 10, r[0]) for r in spark.read.parquet(f"{SMALL}/orders.parquet").select("o_orderkey").collect()}
    assert {(r["list_id"], r["recipe_id"]) for r in QUERIES["list_toggle_all"](spark, SMALL).collect()} == items ^ pairs


def test_slots_and_tokens_are_given_back(spark):
    limiter = Limiter(TokenBucket(1000, 1000), 1)
    with limiter.call():
        with pytest.raises(TimeoutError):
            with limiter.call(timeout=0.01):
                pass
    with pytest.raises(ValueError), limiter.call():
        raise ValueError
    with limiter.call(timeout=0.01):
        pass


def test_paths_are_normalised(spark):
    cases = {"a//b/./c": "a/b/c", "a/../..": "..", "../../a": "../../a", "/../a": "/a", "": ".", "a/..": ".", "/": "/"}
    rows = spark.createDataFrame([(p,) for p in cases], "p string").select("p", text.normalised(F.col("p")).alias("n")).collect()
    assert {r["p"]: r["n"] for r in rows} == cases


def test_members_leave_a_task_in_bounded_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "BATCH_BYTES", 10)
    with zipfile.ZipFile(tmp_path / "many.epub", "w") as z:
        for i in range(7):
            z.writestr(f"{i}.txt", f"text {i}")
        z.writestr("x.jpg", "jpg")
    rows = archive.members(spark, str(tmp_path), wanted=r"\.txt$").orderBy("ord").collect()
    assert [(r["path"], bytes(r["data"]).decode()) for r in rows] == [(f"{i}.txt", f"text {i}") for i in range(7)]


def test_prompts_that_fail_keep_their_error_in_spark(spark):
    def provider(prompt, model):
        if prompt == "bad":
            raise ValueError("no")
        return prompt, (0.5, 10, 2)

    prompts = spark.createDataFrame([("a", "p", "m"), ("b", "bad", "m"), ("c", "q", "m")], "key string, prompt string, model string")
    rows = completion.completed(prompts, provider, tasks=2, first_wait=0.0).orderBy("key").collect()
    assert [(r["key"], r["response"], r["error"]) for r in rows] == [("a", "p", None), ("b", None, "no"), ("c", "q", None)]
