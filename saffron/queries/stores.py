"""What is read from and written to stores: library databases, files of books, keyed tables and the workflow's state."""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..model import star_schema, table
from ..operators import analytics, vectors
from ..plans import search
from ..sources import book_files, catalogue, completion
from ..sources.sqlite import local
from ..streaming import buckets, extraction
from ..streaming.folders import work_folder
from ..streaming.incremental import stream_into

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a function under its name, with its SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return register


#: Customers of a library; so libraries grow in number with the tables, not in size.
SHELF = 500
_TABLES = """CREATE TABLE books (id INTEGER PRIMARY KEY, title TEXT, path TEXT, pubdate TIMESTAMP, timestamp TIMESTAMP);
CREATE TABLE identifiers (id INTEGER PRIMARY KEY, book INTEGER, type TEXT, val TEXT); CREATE TABLE data (id INTEGER PRIMARY KEY, book INTEGER, format TEXT, name TEXT);
CREATE TABLE authors (id INTEGER PRIMARY KEY, name TEXT); CREATE TABLE books_authors_link (id INTEGER PRIMARY KEY, book INTEGER, author INTEGER);
CREATE TABLE comments (id INTEGER PRIMARY KEY, book INTEGER, text TEXT); CREATE TABLE books_tags_link (id INTEGER PRIMARY KEY, book INTEGER, tag INTEGER);
CREATE TABLE tags (id INTEGER PRIMARY KEY, name TEXT); CREATE INDEX tag_names ON tags (name); INSERT INTO tags VALUES (1, 'Food'), (2, 'Travel');"""


def _write_library(folder: str):
    def write(key: tuple, rows: pa.Table) -> pa.Table:
        name = f"library-{key[0].as_py()}.db"
        here = f"{folder}/.{os.getpid()}-{name}"
        db = sqlite3.connect(here)
        db.executescript(_TABLES)
        for r in rows.to_pylist():
            o, day, kind = r["o_orderkey"], r["day"], r["o_orderkey"] % 3
            db.execute("INSERT INTO books VALUES (?, 'Order', 'p', ?, ?)", (o, (f"{day} 00:00:00+00:00", day, "soon")[kind], r["moment"] if kind < 2 else "soon"))
            db.execute("INSERT OR IGNORE INTO authors VALUES (?, ?)", (r["o_custkey"], r["c_name"]))
            db.execute("INSERT INTO books_authors_link (book, author) VALUES (?, ?)", (o, r["o_custkey"]))
            db.execute("INSERT INTO data (book, format, name) VALUES (?, ?, ?)", (o, "EPUB" if o % 5 else "PDF", str(o)))
            db.execute("INSERT INTO books_tags_link (book, tag) VALUES (?, ?)", (o, 1 if r["o_orderstatus"] == "F" else 2))
            if o % 2 == 0:
                db.execute("INSERT INTO identifiers (book, type, val) VALUES (?, 'isbn', ?)", (o, str(o)))
            if o % 4 == 0:
                db.execute("INSERT INTO comments (book, text) VALUES (?, ?)", (o, r["o_orderpriority"]))
        db.commit()
        db.close()
        os.replace(here, f"{folder}/{name}")
        return pa.table({"n": pa.array([rows.num_rows], pa.int64())})

    return write


def _libraries(spark, d) -> str:
    """A folder of library databases made of the orders, one for each SHELF customers."""
    folder = local(work_folder(spark, "libraries"))
    os.makedirs(folder)
    orders = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    moment = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("moment")
    rows = orders.select("o_orderkey", "o_custkey", "c_name", "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), moment)
    rows.groupBy(F.floor(F.col("o_custkey") / SHELF)).applyInArrow(_write_library(folder), "n bigint").agg(F.sum("n")).collect()
    return folder


_DETAILS = f"""SELECT 'library-' || (o_custkey // {SHELF}) AS library, o_orderkey AS calibre_id, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS pubdate,
  CASE WHEN o_orderkey % 3 < 2 THEN date_trunc('second', o_orderdate) END AS calibre_added_at, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS isbn,
  CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey AS VARCHAR) END AS epub_name, c_name AS author, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE '' END AS description
FROM orders JOIN customer ON c_custkey = o_custkey """


def _details(rows):
    return rows.withColumn("calibre_added_at", F.col("calibre_added_at").cast("timestamp_ntz")).drop("title", "path")


@query(_DETAILS + "WHERE o_orderstatus = 'F' AND o_orderkey % 5 > 0")
def library_books(spark, d):
    """The books of a folder of SQLite databases, each read in ranges of row ids."""
    return _details(catalogue.books(catalogue.read(spark, _libraries(spark, d), rows=2000)))


@query(_DETAILS + "WHERE o_orderkey = 5")
def library_book(spark, d):
    """One book by its id, whatever its tag and formats; SQLite gives its rows alone."""
    return _details(catalogue.book(catalogue.read(spark, _libraries(spark, d)), 5))


_ITEM = """'  {' || chr(10) || '    "id": ' || o_orderkey || ',' || chr(10) || '    "name": "' || o_orderpriority || ' ' || o_orderkey || '",' || chr(10)
  || '    "ingredients": [' || chr(10) || '      "' || array_to_string(string_split(o_orderpriority, '-'), '",' || chr(10) || '      "') || '"' || chr(10) || '    ],' || chr(10)
  || '    "image": ' || CASE o_orderstatus WHEN 'F' THEN '"img/' || o_orderkey || '.jpg"' WHEN 'O' THEN '""' ELSE 'null' END || chr(10) || '  }'"""


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS book_id, coalesce('[' || chr(10) || string_agg({_ITEM}, ',' || chr(10) ORDER BY o_orderkey) || chr(10) || ']', '[]') AS json
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def json_files(spark, d):
    """Every book's recipes written as one indented file at its output path, and the files read back whole."""
    c, root = star_schema(spark, d), work_folder(spark, "books")
    rows = c.recipes.select("book_id", "id", "name", "ingredients", "image")
    books = c.books.select(F.col("id").alias("book_id"))
    book_files.write(rows, root, ["id"], books=books)
    return book_files.read_back(books, root)


@query("""SELECT CAST(event_id AS VARCHAR) AS book_id, '{' || chr(10) || '  "id": ' || event_id || ',' || chr(10) || '  "kind": "' || event_type || '",' || chr(10) || '  "completed_at": "' || strftime(ts, '%Y-%m-%d')
  || '",' || chr(10) || '  "note": null' || chr(10) || '}' AS json FROM events WHERE event_type = 'purchase'""")
def report_files(spark, d):
    """A report of one row a book as an indented object; a date becomes text."""
    events, root = table(spark, d, "events").where("event_type = 'purchase'"), work_folder(spark, "reports")
    rows = events.select(F.col("event_id").alias("book_id"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("ts").cast("date").alias("completed_at"), F.lit(None).cast("string").alias("note"))
    book_files.write(rows, root, [], book_files.REPORT, one=True)
    return book_files.read_back(rows.select("book_id"), root, book_files.REPORT)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS book_id, CASE WHEN o_orderkey % 7 = 0 THEN 'new' ELSE o_orderpriority END AS name FROM orders WHERE o_orderkey % 11 > 0
UNION ALL SELECT -1 - c_custkey, c_custkey, 'made' FROM customer""")
def bucket_upserts(spark, d):
    """A bucketed table made of the orders; then every seventh is changed twice (the last change counts), each customer
    adds a row, and every eleventh is deleted."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("book_id"), F.col("o_orderpriority").alias("name"))
    kept = buckets.BucketTable(spark, work_folder(spark, "orders"), ["id"])
    kept.upsert(orders)
    sevenths = orders.where("id % 7 = 0").select("id", (F.col("book_id") + 1).alias("book_id"), F.explode(F.array(F.lit("old"), F.lit("new"))).alias("name")).withColumn("at", F.when(F.col("name") == "new", 2).otherwise(1))
    made = table(spark, d, "customer").select((-1 - F.col("c_custkey")).alias("id"), F.col("c_custkey").alias("book_id"), F.lit("made").alias("name"), F.lit(1).alias("at"))
    kept.upsert(sevenths.union(made), order=["at"])
    kept.upsert(orders.where("id % 11 = 0"), gone=F.lit(True))
    return buckets.BucketTable(spark, kept.path, ["id"]).read()


_RULES = """WITH e AS (SELECT CAST(o_orderkey AS VARCHAR) AS book_id, o_orderkey % 3 = 0 AS block, o_orderkey % 4 = 0 AS any_image, o_orderkey % 5 > 1 AS resolved,
  CASE WHEN o_orderkey % 7 = 0 THEN 'has_images' WHEN o_orderkey % 7 < 4 THEN 'none' END AS decision FROM orders),
x AS (SELECT *, NOT any_image AND NOT block AS asked_first, (any_image AND NOT block AND NOT resolved) AS asked_later FROM e),
y AS (SELECT *, asked_first OR asked_later AS asked FROM x)
SELECT book_id, CASE WHEN asked AND decision IS NULL THEN 'await_human' ELSE 'finalise' END AS stage, CASE WHEN asked AND decision IS NULL THEN 'review' ELSE 'done' END AS status,
  CASE WHEN block THEN ['block'] WHEN asked AND decision = 'has_images' THEN ['file', 'block'] ELSE ['file'] END AS tried, CASE WHEN asked THEN decision END AS response,
  CAST(CASE WHEN asked AND decision IS NULL THEN CASE WHEN asked_first THEN 2 ELSE 3 END WHEN NOT asked THEN 3
    WHEN decision = 'has_images' THEN CASE WHEN asked_first THEN 5 ELSE 6 END ELSE CASE WHEN asked_first THEN 4 ELSE 5 END END AS INTEGER) AS steps FROM y"""


def _events(spark, d) -> tuple[DataFrame, DataFrame]:
    """What happens to a book for each order, as the rules of _RULES have it, and the answers of people."""
    o = F.col("o_orderkey")
    orders = table(spark, d, "orders").select(o.cast("string").alias("book_id"), o, F.col("o_orderdate").cast("timestamp").alias("at"))
    step = lambda seq, kind, flag, value: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), flag.alias("flag"), value.alias("value"))
    none, no, resolved = F.lit(None).cast("string"), F.lit(None).cast("boolean"), o % 5 > 1
    file, image = o % 3 != 0, o % 4 == 0
    steps = [
        (F.lit(True), step(1, "analysed", no, F.when(file, "file").otherwise("block"))),
        (F.lit(True), step(2, "extracted", image, none)),
        (image | ~file, step(3, "resolved", resolved, none)),
        (file & ~(image & resolved) & (o % 7 == 0), step(4, "extracted", F.lit(True), none)),
        (file & ~(image & resolved) & (o % 7 < 4), step(5, "resolved", F.lit(False), none)),
    ]
    rows = orders.select("book_id", "at", F.explode(F.array_compact(F.array(*[F.when(c, s) for c, s in steps]))).alias("s")).select("book_id", "s.seq", "at", "s.kind", "s.flag", "s.value")
    decisions = orders.where("o_orderkey % 7 < 4").select("book_id", F.lit(0).alias("seq"), "at", F.lit("decision").alias("kind"), no.alias("flag"), F.when(o % 7 == 0, "has_images").otherwise("none").alias("value"))
    return rows, decisions


def run_workflow(spark, steps: str, decisions: str, folder: str) -> DataFrame:
    """Takes up what has come to two folders of events since the last run; the books' states are a bucketed table."""
    schema = "book_id string, seq int, at timestamp, kind string, flag boolean, value string"
    arriving = [spark.readStream.schema(schema).parquet(p) for p in (steps, decisions)]
    stream_into(extraction.transitions(*arriving), f"{folder}/states", ["book_id"], ["turn"], f"{folder}/checkpoint")
    return buckets.BucketTable(spark, f"{folder}/states", ["book_id"]).read()


@query(_RULES)
def workflow_states(spark, d):
    """The workflow as a stream in two runs: the first sees each book's events up to its extraction, the second, which
    knows nothing but the checkpoint and the table, the answers and all that follows them."""
    folder = work_folder(spark, "workflow")
    rows, decisions = _events(spark, d)
    rows.where("seq <= 2").write.parquet(f"{folder}/steps")
    decisions.limit(0).write.parquet(f"{folder}/decisions")
    run_workflow(spark, f"{folder}/steps", f"{folder}/decisions", folder)
    rows.where("seq > 2").write.mode("append").parquet(f"{folder}/steps")
    decisions.write.mode("append").parquet(f"{folder}/decisions")
    return run_workflow(spark, f"{folder}/steps", f"{folder}/decisions", folder).select("book_id", "stage", "status", "tried", "response", "steps")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT q.vec_id AS query_id, c.vec_id AS recipe_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - list_cosine_similarity(c.v, q.v), c.vec_id) AS INTEGER) AS rank
FROM v q JOIN v c ON q.vec_id % 7 = 0 AND c.vec_id <> q.vec_id QUALIFY rank <= 8""")
def knn_many(spark, d):
    """The eight nearest of every seventh vector, by one matrix product a batch for all of them."""
    e = star_schema(spark, d).embeddings
    queries = e.where("recipe_id % 7 = 0").select(F.col("recipe_id").alias("query_id"), "embedding")
    return vectors.search_many(e, queries, 8, exclude_self=True).select("query_id", "recipe_id", "rank")


@query("""SELECT l_shipdate AS shipped, l_orderkey AS id, l_linenumber AS line FROM lineitem ORDER BY l_shipdate DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 60 OFFSET ((SELECT count(*) FROM lineitem) // 2 // 60) * 60""")
def page_deep(spark, d):
    """A page from the middle of all lines: ranges of keys are counted, and one narrow range is sorted."""
    lines = table(spark, d, "lineitem").select(F.col("l_shipdate").alias("shipped"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"))
    pages = search.pages_of(lines, [search.By(F.col("shipped"), True), search.By(F.col("id")), search.By(F.col("line"))], narrow=1000)
    return pages.page(pages.total // 2 // 60 + 1, 60)


@query("""SELECT o_orderkey AS id, CAST(CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'O' THEN 0 ELSE 1 END AS INTEGER) AS n_recipes, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS DOUBLE) / 2 END AS minutes FROM orders""")
def answers_by_schema_file(spark, d):
    """Answers read by a JSON schema that stands in a file: complete ones, ones without a required field, and no JSON."""
    path = work_folder(spark, "schema")
    fields = {"name": {"type": "string"}, "minutes": {"type": ["number", "null"]}, "steps": {"type": "array", "items": {"type": "string"}}}
    schema = {"type": "array", "items": {"type": "object", "properties": fields, "required": ["name", "steps"]}}
    spark.createDataFrame([(json.dumps(schema, indent=1),)], "value string").coalesce(1).write.text(path)
    kind, required = completion.schema_of(spark, path)
    some = F.struct(F.col("o_orderpriority").alias("name"), (F.col("o_orderkey") / 2).alias("minutes"))
    whole = F.struct("some.*", F.array(F.lit("boil")).alias("steps"))
    status = F.col("o_orderstatus")
    answer = F.when(status == "P", "no list").when(status == "O", F.to_json(F.array("some"))).otherwise(F.to_json(F.array(whole)))
    rows = table(spark, d, "orders").withColumn("some", some).select(F.col("o_orderkey").alias("id"), completion.answered(answer, kind, required).alias("r"))
    return rows.select("id", F.when(F.col("r").isNotNull(), F.size("r")).alias("n_recipes"), F.get("r", F.lit(0))["minutes"].alias("minutes"))


@query("SELECT (SELECT count(*) > 0 FROM customer) AS has_books, (SELECT count(*) > 0 FROM orders) AS has_recipes, (SELECT count(*) > 0 FROM orders WHERE o_orderkey < 0) AS has_drafts")
def any_rows(spark, d):
    c = star_schema(spark, d)
    return analytics.any_rows(has_books=c.books, has_recipes=c.recipes, has_drafts=c.recipes.where("id < 0"))


@query("SELECT o_custkey AS book_id, CASE WHEN count(*) <= 20 THEN 'many' ELSE 'one' END AS per_file FROM orders GROUP BY 1")
def recipes_per_file(spark, d):
    chapters = star_schema(spark, d).recipes.groupBy("book_id").agg(F.count("*").alias("n"))
    return chapters.select("book_id", F.when(values.many_per_file(F.col("n")), "many").otherwise("one").alias("per_file"))
