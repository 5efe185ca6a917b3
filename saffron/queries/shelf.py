"""The list of books, repeatable samples, and facts about reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import star_schema, table
from ..operators import shelf, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a function under its name, with its SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return register


_SHELF = """WITH s AS (SELECT c_custkey AS id, c_name AS title, n_name AS author, DATE '2020-01-01' + CAST(c_custkey * 37 % 500 AS INTEGER) AS added_at,
  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS recipe_count FROM customer JOIN nation ON c_nationkey = n_nationkey) """


def _shelf(spark, d):
    return star_schema(spark, d).books.withColumn("added_at", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 37 % 500).cast("int")))


def _page(spark, d, **asked):
    page = shelf.book_page(shelf.BookList(**asked), _shelf(spark, d), star_schema(spark, d).recipes)
    return page.select("id", "title", "author", "added_at", "recipe_count")


@query(_SHELF + "SELECT * FROM s WHERE contains(lower(title), 'nation_1') OR contains(lower(author), 'nation_1')")
def books_search(spark, d):
    found, _ = shelf.books(shelf.BookList(search="Nation_1", sort="title"), _shelf(spark, d), star_schema(spark, d).recipes)
    return found.select("id", "title", "author", "added_at", "recipe_count")


@query(_SHELF + "SELECT * FROM s WHERE contains(lower(title), '77') OR contains(lower(author), '77')")
def books_search_title(spark, d):
    return shelf.books(shelf.BookList(search="77"), _shelf(spark, d), star_schema(spark, d).recipes)[0].select("id", "title", "author", "added_at", "recipe_count")


@query(_SHELF + "SELECT * FROM s WHERE author IN ('NATION_3', 'NATION_17', 'nowhere') AND recipe_count >= 1")
def books_of_authors(spark, d):
    asked = shelf.BookList(authors=["NATION_3", "NATION_17", "nowhere"], has_recipes=True)
    return shelf.books(asked, _shelf(spark, d), star_schema(spark, d).recipes)[0].select("id", "title", "author", "added_at", "recipe_count")


@query(_SHELF + "SELECT * FROM s ORDER BY title, id LIMIT 60")
def books_by_title(spark, d):
    return _page(spark, d, sort="title")


@query(_SHELF + "SELECT * FROM s ORDER BY author, title, id LIMIT 60 OFFSET 60")
def books_by_author(spark, d):
    return _page(spark, d, sort="author", page=2)


@query(_SHELF + "SELECT * FROM s ORDER BY recipe_count DESC, title, id LIMIT 60")
def books_by_recipes(spark, d):
    return _page(spark, d, sort="recipes")


@query(_SHELF + "SELECT * FROM s ORDER BY added_at DESC, title, id LIMIT 60")
def books_by_recent(spark, d):
    return _page(spark, d, sort="recent")


@query(_SHELF + "SELECT * FROM s ORDER BY added_at DESC, title, id LIMIT 60 OFFSET ((SELECT count(*) FROM s) - 1) // 60 * 60")
def books_unknown_sort_last_page(spark, d):
    return _page(spark, d, sort="colour", page=10**6)


@query(_SHELF + "SELECT * FROM s ORDER BY CASE WHEN recipe_count >= 1 THEN 0 ELSE 1 END, md5('5:' || id), id LIMIT 60")
def books_random(spark, d):
    return _page(spark, d, seed=5)


@query(_SHELF + """SELECT id, title, CASE WHEN id % 10 > 0 THEN recipe_count ELSE 0 END AS recipe_count FROM s
ORDER BY CASE WHEN recipe_count >= 1 AND id % 10 > 0 THEN 0 ELSE 1 END, md5('5:' || id), id LIMIT 60 OFFSET ((SELECT count(*) FROM s) - 1) // 60 * 60""")
def books_random_last_page(spark, d):
    """Where every tenth book has lost its recipes, such books end a random order."""
    recipes = star_schema(spark, d).recipes.where("book_id % 10 > 0")
    return shelf.book_page(shelf.BookList(seed=5, page=10**9), _shelf(spark, d), recipes).select("id", "title", "recipe_count")


@query("""SELECT o_orderkey AS id, o_custkey AS book_id FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY md5('3:' || o_orderkey), o_orderkey) <= 6""")
def sample_recipes_of_each(spark, d):
    return shelf.sample_of_each(star_schema(spark, d).recipes.select("id", "book_id"), "book_id", seed=3)


@query("""SELECT c_custkey AS id, c_name AS title FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 10 > 0)
ORDER BY md5('0:' || c_custkey), c_custkey LIMIT 10""")
def sample_without_recipes(spark, d):
    """Where every tenth book has lost its recipes."""
    c = star_schema(spark, d)
    return shelf.sample_without_recipes(c.books, c.recipes.where("book_id % 10 > 0"), "ten").select("id", "title")


@query("""WITH t AS (SELECT length(o_orderpriority || ' ' || o_orderkey) AS tokens FROM orders ORDER BY md5('0:' || o_orderkey), o_orderkey LIMIT 10)
SELECT CAST(sum(tokens) AS BIGINT) AS total, sum(tokens) / 10.0::DOUBLE AS average FROM t""")
def sample_token_total(spark, d):
    return shelf.token_total(star_schema(spark, d).recipes.select("id", F.length("name").cast("long").alias("tokens")))


@query("SELECT o_custkey AS book_id, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders GROUP BY 1")
def first_recipe(spark, d):
    return shelf.first_in_order(star_schema(spark, d).recipes)


def _reports(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("book_id"),
        F.when(F.col("event_type") != "signup", F.col("ts")).alias("started_at"),
        F.when(F.col("event_type").isin("view", "error"), F.col("ts")).alias("completed_at"),
        F.when(F.col("event_type") == "error", F.array_repeat(F.lit("failed"), (F.col("event_id") % 3 + 1).cast("int"))).alias("errors"),
    )


@query("""SELECT event_id AS id, c_name AS title, CASE WHEN event_type IN ('view', 'error') THEN ts END AS completed_at,
  CAST(CASE WHEN event_type = 'error' THEN event_id % 3 + 1 ELSE 0 END AS INTEGER) AS n_errors
FROM events JOIN customer ON c_custkey = user_id ORDER BY completed_at DESC NULLS FIRST, id LIMIT 100""")
def reports_with_books(spark, d):
    return shelf.recent_reports(_reports(spark, d), star_schema(spark, d).books).select("id", "title", "completed_at", "n_errors")


@query("SELECT user_id AS book_id, min(event_id) AS report_id FROM events WHERE event_type = 'signup' GROUP BY 1")
def reports_unstarted(spark, d):
    return shelf.unstarted(_reports(spark, d))


@query("""SELECT count(*) AS reports, CAST(coalesce(sum(CAST(value AS DECIMAL(10,2))), 0) AS DECIMAL(28,6)) AS old_cost,
  CAST(sum(event_id * 13 * 300 + user_id * 7 * 2500) / 1e9 AS DECIMAL(28,6)) AS new_cost,
  CAST(sum(event_id * 13 * 300 + user_id * 7 * 2500) / 1e9 AS DECIMAL(28,6)) - CAST(coalesce(sum(CAST(value AS DECIMAL(10,2))), 0) AS DECIMAL(28,6)) AS difference
FROM events WHERE event_id % 4 IN (0, 1) AND event_id % 7 > 0""")
def recost_totals(spark, d):
    from .tables import _reports as priced

    return shelf.recost_totals(priced(spark, d))


@query("SELECT CAST(event_id % 3 AS INTEGER) AS provider, list_sort(list(DISTINCT event_type)) AS models FROM events GROUP BY 1")
def models_of_providers(spark, d):
    return shelf.models_of(table(spark, d, "events").select((F.col("event_id") % 3).cast("int").alias("provider"), F.col("event_type").alias("model")))


@query("""SELECT 'both' AS row, true AS configured UNION ALL SELECT 'no key', false UNION ALL SELECT 'null key', false UNION ALL SELECT 'no row', false""")
def settings_configured(spark, d):
    one = lambda key: table(spark, d, "region").where("r_regionkey = 0").select(F.col("r_name").alias("provider"), F.lit(key).cast("string").alias("api_key"))
    cases = {"both": one("k"), "no key": one(""), "null key": one(None), "no row": one("k").where("false")}
    parts = [shelf.configured(rows).withColumn("row", F.lit(name)) for name, rows in cases.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE contains(lower(s_name), '1')")
def lists_by_name(spark, d):
    return star_schema(spark, d).lists.where(shelf.contains_any([F.col("name")], "1"))


@query("""WITH k AS (SELECT l_orderkey, list_sort(list(p_name)) AS keywords FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT o_orderkey AS id, {'name': o_orderpriority || ' ' || o_orderkey, 'recipeIngredients': string_split(o_orderpriority, '-'), 'recipeInstructions': [o_orderstatus],
  'image': CASE o_orderstatus WHEN 'F' THEN 'img/' || o_orderkey || '.jpg' WHEN 'O' THEN '' END, 'keywords': coalesce(keywords, []), 'author': n_name, 'bookTitle': c_name,
  'bookOrder': date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))} AS data
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey LEFT JOIN k ON l_orderkey = o_orderkey""")
def recipe_transfer(spark, d):
    c = star_schema(spark, d)
    return shelf.transfer(c.described(), c.named_keywords())


@query("""SELECT event_id AS id, strftime(ts, '%Y') AS year, strftime(ts, '%Y-%m-%d %H:%M') AS minute, strftime(ts, '%b %d, %Y') AS day,
  event_id * 13 - user_id * 7 AS output_tokens FROM events""")
def dates_shown(spark, d):
    e = table(spark, d, "events")
    shown = [column.alias(name) for name, column in shelf.dates(F.col("ts")).items()]
    return e.select(F.col("event_id").alias("id"), *shown, shelf.output_tokens(F.col("event_id") * 13, F.col("user_id") * 7).alias("output_tokens"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT v FROM v WHERE vec_id = 7)
SELECT vec_id AS recipe_id, CAST(row_number() OVER (ORDER BY 1 - list_cosine_similarity(v.v, q.v), vec_id) AS INTEGER) AS rank FROM v, q QUALIFY rank <= 20""")
def search_kept_and_fetched(spark, d):
    embeddings = star_schema(spark, d).embeddings
    prompt = embeddings.where("recipe_id = 7").first()["embedding"]
    ranked = vectors.search(embeddings, list(prompt), shelf.FOUND)
    kept = shelf.kept_search(ranked, " lemon tart ", "a1", 20).union(shelf.kept_search(ranked, "soup", "b2", 5))
    return shelf.fetched_search(kept, "a1")
