"""Library databases, files of books, bucketed tables and the workflow's state."""

import json
import os
import sqlite3
import time
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from saffron.operators import workflow
from saffron.queries.stores import run_workflow
from saffron.sources import book_files, catalogue, sqlite
from saffron.streaming import extraction
from saffron.streaming.buckets import BucketTable, latest


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("library") / "metadata.db")
    db = sqlite3.connect(path)
    db.executescript("CREATE TABLE books (id INTEGER PRIMARY KEY, title TEXT, score REAL, cover BLOB); CREATE TABLE tags (id INTEGER PRIMARY KEY, name TEXT); CREATE TABLE pairs (a INT, b TEXT, PRIMARY KEY (a, b)) WITHOUT ROWID; CREATE TABLE bare (n INTEGER)")
    db.executemany("INSERT INTO books VALUES (?, ?, ?, ?)", [(i, f"Tarte {i} é" if i % 3 else None, i / 2, bytes([i % 256])) for i in range(1, 1001)])
    db.executemany("INSERT INTO pairs VALUES (?, ?)", [(i, str(i)) for i in range(7)])
    db.executemany("INSERT INTO bare VALUES (?)", [(1,), ("two",), (None,), (4.0,)])
    db.commit()
    db.close()
    sqlite.register(spark)
    return path


def of(spark, path, name, **options):
    return spark.read.format("sqlite").options(path=path, dbtable=name, **options).load()


def test_a_table_is_read_in_several_tasks(spark, library):
    books = of(spark, library, "books", rows=100)
    assert books.rdd.getNumPartitions() == 10
    rows = {r["id"]: r for r in books.collect()}
    assert len(rows) == 1000 and rows[3]["title"] is None and rows[4]["title"] == "Tarte 4 é" and rows[5]["score"] == 2.5 and bytes(rows[300]["cover"]) == b"\x2c"
    assert {r["library"] for r in rows.values()} == {"metadata"}


def test_filters_reach_the_database(spark, library):
    books = of(spark, library, "books", rows=100)
    here, one = spark.createDataFrame(books.collect(), books.schema), books.where("id = 321")
    assert one.rdd.getNumPartitions() == 1 and [r["title"] for r in one.collect()] == [None]
    for test in ("id IN (5, 6, 999)", "id > 990 AND id <= 995", "title = 'Tarte 7 é'", "title IS NOT NULL AND id < 10", "title IS NULL", "title LIKE 'Tarte 1%'", "score > 499.5", "library = 'metadata' AND id = 2", "NOT id = 3"):
        assert sorted(map(str, books.where(test).collect())) == sorted(map(str, here.where(test).collect())), test
    assert books.where("id = 5000").count() == 0


def test_odd_tables(spark, library):
    assert of(spark, library, "pairs").count() == 7
    assert [r["n"] for r in of(spark, library, "bare").collect()] == [1, None, None, 4]
    assert of(spark, library, "bare").where("n > 0").count() == 2
    assert of(spark, library, "tags").count() == 0
    with pytest.raises(Exception, match="no table"):
        of(spark, library, "nothing")
    with pytest.raises(Exception, match="no database"):
        catalogue.read(spark, library + ".lost")


def test_a_folder_of_databases_and_one_that_spark_sends(spark, library, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.db").write_bytes(Path(library).read_bytes())
    (tmp_path / "notes.txt").write_text("no database")
    assert {(r[0], r[1]) for r in of(spark, str(tmp_path), "pairs").groupBy("library").count().collect()} == {("a", 7), ("b", 7)}
    spark.sparkContext.addFile(str(tmp_path / "a.db"))
    assert spark.read.format("sqlite").options(shipped="a.db", dbtable="pairs").load().count() == 7


def database(path, ids, name="t", indexed=False):
    db = sqlite3.connect(path)
    db.execute(f"CREATE TABLE {name} (id INTEGER PRIMARY KEY, kind TEXT, note TEXT)")
    db.executemany(f"INSERT INTO {name} VALUES (?, ?, ?)", [(i, "even" if i % 2 == 0 else "odd", "rare" if i == ids[-1] else None) for i in ids])
    if indexed:
        db.execute(f"CREATE INDEX kinds ON {name} (note)")
    db.commit()
    db.close()
    return str(path)


@pytest.mark.parametrize(
    "ids",
    [
        range(1, 5001),
        range(-3000, 150_000, 30),
        [(i * 0x9E3779B97F4A7C15 & (1 << 63) - 1) for i in range(1, 5001)],  # random ids
        [*range(2000), 10**6, *range(10**12, 10**12 + 3000)],  # clusters
        [7],
        [-(1 << 63), (1 << 63) - 1],
    ],
)
def test_ranges_follow_the_rows(tmp_path, ids):
    """Every row is in one range, no range holds many more rows than asked, and none of the tasks is nearly empty."""
    path = database(tmp_path / "x.db", sorted(ids))
    with sqlite.opened(path) as db:
        found = sqlite.ranges(db, path, "t", *sqlite.ends(db, "t"), 200)
        held = [db.execute("SELECT count(*) FROM t WHERE rowid BETWEEN ? AND ?", (r.first, r.last)).fetchone()[0] for r in found]
    assert sum(held) == len(ids) and all(a.last < b.first for a, b in zip(found, found[1:], strict=False))
    made = sqlite.tasks(found, 200)
    assert max(held) <= 400 and len(made) <= 2 * len(ids) / 200 + 2
    assert [r for t in made for r in t.ranges] == found


def test_planning_seeks_and_does_not_scan(tmp_path):
    path = database(tmp_path / "x.db", range(1, 300_001), indexed=True)
    steps = []
    with sqlite.opened(path) as db:
        db.set_progress_handler(lambda: steps.append(1) and None, 100)
        assert len(sqlite.ranges(db, path, "t", *sqlite.ends(db, "t"), 10_000)) == 30
        assert sqlite.ends(db, "t", " WHERE note = 'rare'") == (300_000, 300_000)
        assert sqlite.sought(db, "t") == {"id", "note"}
    assert len(steps) < 200  # hundreds of instructions; a scan takes more than 3,000


def test_small_databases_share_tasks_and_others_stay_unread(spark, library, tmp_path):
    for i in range(20):
        database(tmp_path / f"lib{i}.db", range(1, 51))
    rows = of(spark, str(tmp_path), "t", rows=500)
    assert rows.rdd.getNumPartitions() == 2 and rows.count() == 1000
    assert {r[0] for r in rows.where("kind = 'odd'").groupBy("library").count().select("count").collect()} == {25}
    assert rows.where("note = 'rare'").count() == 20
    (tmp_path / "lib3.db").write_text("broken")  # is not opened
    for test, n in (("library = 'lib7'", 50), ("library IN ('lib7', 'lib12', 'no')", 100), ("library = 'lib7' AND library = 'lib8'", 0), ("library = 'lib7' AND id > 45", 5)):
        assert rows.where(test).count() == n, test


def test_files_are_what_json_writes(spark, tmp_path):
    rows = [(b, i, f"Crème \"{i}\"\n/ 日本", [str(i)] * (i % 3), date(2024, 1, 1 + i % 9) if i % 2 else None) for b, n in (("big", 400), ("a/b c", 2), ("x", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "book_id string, id int, name string, steps array<string>, day date").repartition(7)
    books = spark.createDataFrame([("big",), ("none",), ("a/b c",), ("x",)], "book_id string")
    for _ in range(2):  # a second write replaces the first
        assert book_files.write(df, str(tmp_path), ["id"], books=books) == 4
    found = {r["book_id"]: r["json"] for r in book_files.read_back(books, str(tmp_path)).collect()}
    for book in ("big", "a/b c", "x", "none"):
        want = [dict(zip(("id", "name", "steps", "day"), r[1:], strict=True)) for r in rows if r[0] == book]
        assert found[book] == json.dumps(want, indent=2, ensure_ascii=False, default=str)
    assert os.listdir(tmp_path / book_files.STAGED) == []
    assert book_files.write(df.limit(0), str(tmp_path), ["id"]) == 0


def test_a_book_spreads_over_tasks_and_a_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.range(5000).select(F.lit("one").alias("book_id"), "id")
    book_files.write(df, str(tmp_path / "w"), ["id"])
    assert [x["id"] for x in json.loads(Path(book_files.target(str(tmp_path / "w"), "one", book_files.RECIPES)).read_text())] == list(range(5000))
    keyed = df.select(F.col("book_id").alias("_book"), F.lit(1).alias("_place"), "id").repartitionByRange(4, "id")
    keyed.write.format("book_files").mode("append").options(path=str(tmp_path / "s"), job="j").save()
    assert len([p for p in (tmp_path / "s" / book_files.STAGED / "j").iterdir() if p.is_dir()]) == 4  # four tasks wrote a part
    assert book_files.publish(spark, str(tmp_path / "s"), "j", "r.json") == 1
    broken = keyed.withColumn("id", F.when(F.col("id") == 4999, F.raise_error(F.lit("no"))).otherwise(F.col("id")))
    with pytest.raises(Exception):
        broken.write.format("book_files").mode("append").options(path=str(tmp_path / "f"), job="j").save()
    assert not list((tmp_path / "f").rglob("*.json")) and not list((tmp_path / "f").rglob("one"))


def test_an_upsert_writes_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    kept = BucketTable(spark, path, ["id"], buckets=16)
    kept.upsert(spark.range(1000).select("id", F.lit("old").alias("v")))
    new = spark.createDataFrame([(5, "new", 2), (5, "newer", 3), (5, "first", 1), (2000, "added", 1)], "id long, v string, n int")
    state = BucketTable(spark, path, ["id"]).upsert(new, order=["n"])
    assert (state["created"], state["updated"], state["deleted"]) == (1, 1, 0) and state["touched"] <= 2
    assert len(os.listdir(f"{path}/data/2")) - 1 <= 2 + 2  # its buckets, and Spark's marks
    rows = {r["id"]: r["v"] for r in BucketTable(spark, path, ["id"]).read().collect()}
    assert len(rows) == 1001 and rows[5] == "newer" and rows[2000] == "added" and rows[6] == "old"
    assert {r["v"] for r in kept.read(1).collect()} == {"old"}
    assert [r["v"] for r in kept.lookup(spark.createDataFrame([(5,), (77_777,)], "id long")).collect()] == ["newer"]
    gone = kept.upsert(spark.range(1000).select("id", F.lit("").alias("v")), gone=F.col("id") > 2)
    assert gone["deleted"] == 997 and {r["id"] for r in kept.read().collect()} == {0, 1, 2, 2000}
    assert kept.vacuum() > 0 and kept.read().count() == 4


def test_a_version_without_its_file_has_not_happened(spark, tmp_path):
    path = str(tmp_path / "t")
    kept = BucketTable(spark, path, ["id"])
    rows = spark.range(10).select("id", F.lit(1).alias("v"))
    kept.upsert(rows, batch=0)
    kept.upsert(rows.withColumn("v", F.lit(2)), batch=1)
    os.remove(f"{path}/versions/2.json")  # the driver stopped before the version was committed
    again = BucketTable(spark, path, ["id"])
    assert {r["v"] for r in again.read().collect()} == {1}
    again.upsert(rows.withColumn("v", F.lit(3)), batch=1)
    assert again.upsert(rows.withColumn("v", F.lit(4)), batch=1)["version"] == 2  # a batch that comes again
    assert {r["v"] for r in again.read().collect()} == {3} and again.read().count() == 10
    with pytest.raises(ValueError):
        BucketTable(spark, path, ["v"])


def test_null_keys_and_the_last_of_many(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, 1), (1, "b", None), (2, "c", 5)], "id int, v string, at int")
    assert {(r["id"], r["v"]) for r in latest(rows, ["id"], ["at"]).collect()} == {(1, None), (2, "c")}
    empty = BucketTable(spark, str(tmp_path / "e"), ["id"])
    with pytest.raises(FileNotFoundError):
        empty.read()
    empty.upsert(rows.limit(0))
    assert empty.read().count() == 0
    empty.upsert(rows.where("at is not null"))
    assert empty.read().count() == 2


def test_rules_are_those_of_the_status_table(spark):
    cases = []
    for stage in ("analyse", "extract_file", "extract_block", "await_human", "resolve_images"):
        for flag in (True, False):
            for value in ("block", "file", "has_images", "none"):
                for tried in (["file"], ["file", "block"]):
                    for response in (None, "none"):
                        asked = "validate" if stage.startswith("extract") else stage
                        cases.append((len(cases), asked, value, flag, flag, value if stage == "await_human" else response, tried, extraction.after(stage, flag, value, tried, response)))
    status = spark.createDataFrame(cases, "id int, stage string, extraction_type string, any_image boolean, any_resolved boolean, human_response string, already_tried array<string>, want string")
    assert workflow.routed(status).where("next_stage <> want OR next_stage IS NULL").count() == 0


def test_a_review_becomes_overdue_and_a_restart_goes_on(spark, tmp_path):
    from saffron.streaming.incremental import stream_into

    schema = "book_id string, seq int, at timestamp, kind string, flag boolean, value string"
    folder, at = str(tmp_path), datetime(2024, 1, 1)
    put = lambda where, *rows: spark.createDataFrame([(b, s, at, k, f, v) for b, s, k, f, v in rows], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{where}")
    read = lambda w: spark.readStream.schema(schema).parquet(f"{folder}/{w}")

    def run():
        stream_into(extraction.transitions(read("steps"), read("said"), patience=timedelta(seconds=2)), f"{folder}/states", ["book_id"], ["turn"], f"{folder}/cp")
        return {r["book_id"]: (r["stage"], r["status"], r["steps"]) for r in BucketTable(spark, f"{folder}/states", ["book_id"]).read().collect()}

    put("steps", ("a", 1, "analysed", None, "file"), ("a", 2, "extracted", False, None), ("b", 2, "extracted", True, None))
    put("said", ("early", 0, "decision", None, "none"))
    assert run() == {"a": ("await_human", "review", 2), "b": ("analyse", "running", 0), "early": ("analyse", "running", 0)}
    put("steps", ("b", 1, "analysed", None, "file"), ("early", 1, "analysed", None, "file"), ("early", 2, "extracted", False, None))
    time.sleep(2)
    states = run()
    assert states["a"] == ("await_human", "overdue", 2)
    assert states["b"] == ("resolve_images", "running", 2)  # its extraction had come before its analysis
    assert states["early"] == ("resolve_images", "running", 3)  # the answer had come before the question
    put("said", ("a", 0, "decision", None, "has_images"))
    put("steps", ("a", 2, "extracted", True, None), ("a", 3, "extracted", True, None), ("a", 4, "resolved", False, None))
    assert run()["a"] == ("finalise", "done", 5)


def test_workflow_runs_on_an_empty_folder(spark, tmp_path):
    schema = "book_id string, seq int, at timestamp, kind string, flag boolean, value string"
    for name in ("s", "d"):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
    assert run_workflow(spark, f"{tmp_path}/s", f"{tmp_path}/d", str(tmp_path / "w")).count() == 0
