"""Cases that a reviewer's findings have shown."""

import datetime
import json
import os
import sqlite3

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq

from pyspark.sql import functions as F
from pyspark.sql import types as T

from saffron import registry
from saffron.operators import mutations, vectors
from saffron.plans import substring
from saffron.sources import archive, book_files, sqlite
from saffron.streaming import extraction
from saffron.streaming.buckets import BucketTable, Fold
from tests.conftest import same_as_duckdb


def test_prompts_of_long_and_missing_addresses(spark, tmp_path):
    rows = [(1, None), (2, "http://" + "a" * 200), (3, "http://é\U0001f469‍"), (4, ""), (5, "{what} \\")]
    pq.write_table(pa.table({"page_id": [r[0] for r in rows], "url": [r[1] for r in rows]}), tmp_path / "pages.parquet")
    same_as_duckdb(registry.QUERIES["prompts"](spark, str(tmp_path)), registry.ORACLE_SQL["prompts"], str(tmp_path))


def test_a_fold_moves_only_what_has_events_or_is_due(spark, tmp_path):
    """Rows without events don't pass through Python; a batch that comes again is passed over; null is a key like others."""

    def moved(now):
        def run(batches):
            for batch in batches:
                rows = zip(batch.column("k").to_pylist(), batch.column("_old").to_pylist(), batch.column("_came").to_pylist(), strict=True)
                out = [(k, (old or {"n": 0})["n"] + sum(c["by"] for c in came or []), None if came is None else True) for k, old, came in rows]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.bool_()), strict=True)], ["k", "n", "asked"])

        return run

    kept = BucketTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    fold = Fold(None, "k string, n bigint, asked boolean", moved, lambda now: F.col("n") == 7)
    put = lambda batch, *rows: kept.fold(spark.createDataFrame(rows, "k string, by long"), fold, batch)
    put(0, ("a", 1), ("a", 2), (None, 5), ("b", 7), *[(f"x{i}", 1) for i in range(50)])
    put(1, ("a", 10), (None, 1))
    assert put(1, ("a", 100))["version"] == 2
    rows = {r["k"]: (r["n"], r["asked"]) for r in kept.read().collect()}
    assert kept.read().count() == 53 and rows["a"] == (13, True) and rows[None] == (6, True) and rows["b"] == (7, None) and rows["x3"] == (1, True)


def test_the_workflow_asks_no_store_for_each_book(spark):
    plan = extraction.transitions(*[spark.readStream.format("rate").load().selectExpr("'a' AS book_id", "1 AS seq", "timestamp AS at", "'analysed' AS kind", "true AS flag", "'file' AS value")] * 2)
    assert isinstance(plan, Fold) and "TransformWithState" not in plan.events._jdf.queryExecution().logical().toString()


def test_staging_holds_two_files_a_task(spark, tmp_path):
    """However many books there are; else the driver removes a file of each by itself."""
    keyed = spark.range(500).select(F.col("id").cast("string").alias("_book"), F.lit(1).alias("_place"), "id").repartitionByRange(3, "_book").sortWithinPartitions("_book")
    spark.dataSource.register(book_files.BookFiles)
    keyed.write.format("book_files").mode("append").options(path=str(tmp_path), job="j").save()
    assert len([p for p in (tmp_path / book_files.STAGED / "j").rglob("*") if p.is_file()]) <= 3 * 2 + 1
    assert book_files.publish(spark, str(tmp_path), "j", "r.json") == 500
    assert json.loads((tmp_path / "77" / book_files.FOLDER / "r.json").read_text()) == [{"id": 77}]


def test_a_book_of_several_tasks_and_more_than_a_copy(spark, tmp_path):
    """Small books before and after one whose parts are joined from all tasks."""
    rows = spark.range(3000).select(F.when(F.col("id") < 5, "a").when(F.col("id") < 2990, "b").otherwise(F.concat(F.lit("c"), "id")).alias("book_id"), "id", F.repeat(F.lit("é"), 500).alias("t"))
    assert book_files.write(rows, str(tmp_path), ["id"]) == 12
    found = {r["book_id"]: json.loads(r["json"]) for r in book_files.read_back(rows.select("book_id").distinct(), str(tmp_path)).collect()}
    assert [x["id"] for x in found["b"]] == list(range(5, 2990)) and [x["id"] for x in found["a"]] == list(range(5)) and [x["id"] for x in found["c2999"]] == [2999]


def test_files_are_read_back_by_many_tasks(spark, tmp_path):
    """Though ids come in one partition."""
    books = spark.range(40).coalesce(1).select(F.col("id").alias("book_id"))
    book_files.write(books.withColumn("n", F.lit(1)), str(tmp_path), ["n"])
    found = book_files.read_back(books, str(tmp_path))
    assert found.rdd.getNumPartitions() == 4 and found.where("json IS NOT NULL").count() == 40


def test_folders_of_new_books_come_by_one_move(spark, tmp_path, monkeypatch):
    """Tasks don't wait for each other to make them; a book that has files keeps those of other names."""
    made, files = [], pa.fs.LocalFileSystem()
    put = lambda book, name, aside: book_files._put(files, [iter([b"1"])], str(tmp_path), book, name, aside, False, 1)
    (tmp_path / "own").mkdir()
    monkeypatch.setattr(book_files.os, "mkdir", lambda path, real=os.mkdir: made.append(str(path)) or real(path))
    aside = book_files.Aside(str(tmp_path / "own"), True)
    put("a", "x.json", aside)
    assert made == [str(tmp_path / "own" / "a"), str(tmp_path / "own" / "a" / book_files.FOLDER)] and aside.used
    for name in ("x.json", "y.json"):
        put("a", name, aside)
    for book in ("b", ""):
        put(book, "x.json", book_files.Aside(str(tmp_path / "own"), book != "b"))
    assert not aside.used and os.listdir(tmp_path / "own") == []
    assert sorted(os.listdir(tmp_path / "a" / book_files.FOLDER)) == ["x.json", "y.json"] and (tmp_path / "b" / book_files.FOLDER / "x.json").read_text() == "[\n1\n]"


def test_rows_are_written_as_json_dumps_writes_them():
    rows = [
        {"id": 1, "n%s": "a\n\"é\u2028\x01", "l": ["x", None, "y\n"], "f": 0.1, "b": True, "at": datetime.datetime(2024, 1, 2), "s": {"k": [], "m": "\n"}, "ll": [["p"], []]},
        {"id": None, "n%s": None, "l": [], "f": float("nan"), "b": None, "at": None, "s": None, "ll": None},
        {"id": -5, "n%s": "", "l": None, "f": 1e300, "b": False, "at": None, "s": {"k": [1], "m": None}, "ll": []},
    ]
    batch = pa.RecordBatch.from_pylist(rows)
    plain = [json.dumps(r, indent=2, ensure_ascii=False, default=str) for r in rows]
    assert list(book_files.texts(batch, batch.schema.names, "")) == plain
    assert list(book_files.texts(batch, batch.schema.names, "  ")) == ["\n".join(f"  {x}" for x in p.split("\n")) for p in plain]
    assert list(book_files.texts(batch, [], "")) == ["{}"] * 3


def test_archives_come_in_bounded_batches(spark, monkeypatch):
    """By bytes, not by 10,000 rows, whatever the archives' size."""
    monkeypatch.setattr(archive, "BATCH_BYTES", 1 << 16)
    files = spark.range(0, 300, 1, 1).select(F.col("id").cast("string").alias("path"), F.expr("cast(repeat('x', 8192) as binary)").alias("content"))
    archive.opened(files)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["n"])

    assert max(r[0] for r in files.mapInArrow(sizes, "n bigint").collect()) < 1 << 18
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_postings_are_those_of_each_text(spark, monkeypatch):
    """Texts that rows share, that are short, empty or beyond 16 bits, against one text at a time; a batch is made once."""
    rows = [(i, f, t) for i in (5, -3, 9, 2) for f, t in (("name", "abcabc"), ("name", f"x{i}yz"), ("title", "ab"), ("title", ""), ("other", "\U0001f469äö\U0001f469äö"))]
    table = pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "field": [r[1] for r in rows], "text": [r[2] for r in rows]})
    have = {(r["field"], r["gram"]): r["ids"] for r in substring._postings((pa.scalar(7),), table).to_pylist() if r["block"] == 7 and r["n"] == len(r["ids"])}
    want = {}
    for i, field, text in sorted(rows):
        for gram in substring.grams(text).tolist():
            want.setdefault((field, gram), []).append(i)
    assert have == want


def test_texts_that_rows_share_are_cut_up_once(monkeypatch):
    asked, whole = [], substring._pairs
    monkeypatch.setattr(substring, "_pairs", lambda texts: asked.append(len(texts)) or whole(texts))
    substring._postings((pa.scalar(0),), pa.table({"id": pa.array(range(100)), "field": ["name"] * 100, "text": ["butter", "bread"] * 50}))
    assert asked == [2]


def test_a_large_table_has_a_bounded_number_of_tasks(tmp_path, monkeypatch):
    """Each row is read once all the same."""
    db = sqlite3.connect(tmp_path / "x.db")
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY)")
    db.executemany("INSERT INTO t VALUES (?)", [(i,) for i in range(5000)])
    db.commit()
    db.close()
    monkeypatch.setattr(sqlite, "TASKS", 10)
    reader = sqlite.SqliteSource({"path": str(tmp_path / "x.db"), "dbtable": "t", "rows": "50"}).reader(T.StructType([T.StructField("id", T.LongType())]))
    made = reader.partitions()
    assert len(made) <= 12 and sorted(i for task in made for batch in reader.read(task) for i in batch.column(0).to_pylist()) == list(range(5000))


def test_a_toggle_takes_as_many_tasks_as_its_rows_ask_for(spark, monkeypatch):
    """Not as many as there are cores; rows that come again count once, and one with a null meets no other."""
    monkeypatch.setattr(mutations, "TASK_ROWS", 100)
    frame = lambda rows: spark.createDataFrame(rows, "list_id long, recipe_id long")
    items = [(i % 7, i) for i in range(1500)] + [(1, 1), (None, 5), (3, None)]
    pair = [(i % 5, i) for i in range(500)] + [(0, 0), (None, 5), (8, 8)]
    out = mutations.toggle(frame(items), frame(pair))
    assert out.rdd.getNumPartitions() >= 12
    whole = lambda rows: {r for r in rows if None not in r}
    want = [*(whole(items) ^ whole(pair)), (None, 5), (None, 5), (3, None)]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def test_a_task_gives_k_rows_a_query_whatever_ties(spark, monkeypatch):
    """Copies, the zero vector and ones that are not finite, asked for and found, in one partition of files; all cores share."""
    monkeypatch.setattr(vectors, "QUERIES", 50)
    monkeypatch.setattr(vectors, "ROWS", 100)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 4)]) for i in range(900)] + [(5000 + i, [0.0] * 4) for i in range(300)]
    rows += [(7000, [float("nan"), 1.0, 0.0, 0.0]), (7001, [float("inf"), 1.0, 0.0, 0.0])]
    e = spark.createDataFrame(rows, "recipe_id long, embedding array<double>").coalesce(1).cache()
    queries = e.where("recipe_id % 9 = 0 OR recipe_id >= 7000").select(F.col("recipe_id").alias("query_id"), "embedding")
    have = {}
    for r in vectors.search_many(e, queries, 5, exclude_self=True).collect():
        have.setdefault(r["query_id"], []).append((r["rank"], r["recipe_id"]))
    v, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    for q in (i for i, row in enumerate(rows) if row[0] % 9 == 0 or row[0] >= 7000):
        distance = vectors._distances(v, np.repeat(v[q : q + 1], len(v), 0))
        order = [int(ids[i]) for i in np.lexsort((ids, np.where(np.isnan(distance), 9.0, distance))) if i != q]
        assert sorted(have.pop(int(ids[q]))) == list(enumerate(order[:5], 1))
    assert not have
    part = vectors._partial(e.repartition(1), np.array([5000, 3]), np.array([[0.0] * 4, rows[3][1]]), 5, False)
    assert part.columns == ["query_id", "recipe_id", "distance"] and part.groupBy("query_id").count().agg(F.max("count")).first()[0] == 5
    assert vectors.search_many(e, queries, 5)._jdf.queryExecution().optimizedPlan().toString().count("Repartition") >= 1


def test_distances_of_a_batch_are_those_of_the_column(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(300, 64)).astype(np.float32).astype(float), rng.normal(size=(300, 64)).astype(np.float32).astype(float)
    a[0] = 0
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i int, a array<double>, b array<double>")
    want = np.array([r[0] for r in df.orderBy("i").select(vectors.cosine_distance(F.col("a"), F.col("b"))).collect()])
    assert np.array_equal(vectors._distances(a, b), want, equal_nan=True)
