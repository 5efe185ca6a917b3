"""Counts, dashboards, navigation, vectors, changes to tables and the status table."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import daily_pick
from ..model import star_schema, table
from ..operators import analytics, keywords, mutations, navigation, vectors, workflow
from ..sources import catalogue as library
from ..streaming.buckets import BucketTable
from ..streaming.folders import work_folder
from ..streaming.incremental import stream_into, windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = datetime(2024, 1, 31)
MODELS = ("gemini-2.5-flash", "gemini-2.5-flash-lite", "gemini-2.0-flash-lite", "other")


def query(sql: str | None):
    """Registers a function under its name, with its SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


@query("SELECT c_custkey AS id, c_name AS title, count(o_orderkey) AS recipe_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def book_counts(spark, d):
    c = star_schema(spark, d)
    return analytics.counted(c.books.select("id", "title"), c.recipes, "book_id", "recipe_count")


@query("SELECT p_partkey AS id, count(DISTINCT l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL")
def keyword_counts(spark, d):
    c = star_schema(spark, d)
    return analytics.counted(c.keywords.select("id"), c.recipe_keywords, "keyword_id")


@query("SELECT s_suppkey AS id, s_name AS name, count(DISTINCT l_orderkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL")
def list_counts(spark, d):
    c = star_schema(spark, d)
    return analytics.counted(c.lists, c.list_items, "list_id")


@query("SELECT p_partkey AS id, count(DISTINCT l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL ORDER BY n DESC, id LIMIT 100")
def sort_count_desc(spark, d):
    return keyword_counts(spark, d).orderBy(F.desc("n"), "id").limit(100)


@query("SELECT o_orderkey AS id, count(DISTINCT l_partkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL HAVING n = 0")
def having_without_keywords(spark, d):
    c = star_schema(spark, d)
    return analytics.counted(c.recipes.select("id"), c.recipe_keywords, "recipe_id").where("n = 0")


@query("SELECT c_custkey AS id, c_name AS title FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def having_with_recipes(spark, d):
    c = star_schema(spark, d)
    return c.books.join(c.recipes.select(F.col("book_id").alias("id")), "id", "left_semi").select("id", "title")


@query("""SELECT event_id AS id, user_id AS book_id, coalesce(n, 0) AS recipe_count, coalesce(images, 0) AS image_count FROM events
LEFT JOIN (SELECT o_custkey, count(*) AS n, count_if(o_orderstatus = 'F') AS images FROM orders GROUP BY 1) ON o_custkey = user_id""")
def report_image_counts(spark, d):
    reports = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("book_id"))
    return analytics.image_counts(reports, star_schema(spark, d).recipes)


@query("""SELECT count(*) AS reports, CAST(round(coalesce(sum(CAST(value AS DECIMAL(10,2))), 0), 2) AS DECIMAL(18,2)) AS total_cost
FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAYS AND value IS NOT NULL""")
def cost_window_total(spark, d):
    reports = table(spark, d, "events").select(F.col("ts").alias("created_at"), F.col("value").cast("decimal(10,2)").alias("cost_usd"))
    return analytics.recent_costs(reports, AS_OF)


@query("SELECT (SELECT count(*) FROM customer) AS books, (SELECT count(*) FROM orders) AS recipes, (SELECT count(DISTINCT o_custkey) FROM orders) AS processed_books")
def processed_summary(spark, d):
    c = star_schema(spark, d)
    return analytics.summary(c.books, c.recipes)


_REPORTS = """WITH r AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'gemini-2.5-flash' WHEN 1 THEN 'gemini-2.5-flash-lite' WHEN 2 THEN 'gemini-2.0-flash-lite' ELSE 'other' END AS model_name,
  CASE WHEN event_id % 7 > 0 THEN event_id * 13 END AS input_tokens, user_id * 7 AS output_tokens, CAST(value AS DECIMAL(10,2)) AS cost_usd FROM events) """


def _reports(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.element_at(F.array(*map(F.lit, MODELS)), (F.col("event_id") % 4 + 1).cast("int")).alias("model_name"),
        F.when(F.col("event_id") % 7 > 0, F.col("event_id") * 13).alias("input_tokens"),
        (F.col("user_id") * 7).alias("output_tokens"),
        F.col("value").cast("decimal(10,2)").alias("cost_usd"),
    )


@query(_REPORTS + """SELECT id, model_name, CAST((input_tokens * CASE model_name WHEN 'gemini-2.5-flash' THEN 300 WHEN 'gemini-2.5-flash-lite' THEN 100 WHEN 'gemini-2.0-flash-lite' THEN 75 END
  + output_tokens * CASE model_name WHEN 'gemini-2.5-flash' THEN 2500 WHEN 'gemini-2.5-flash-lite' THEN 400 WHEN 'gemini-2.0-flash-lite' THEN 300 END) AS DOUBLE) / 1e9 AS cost FROM r""")
def token_cost(spark, d):
    return _reports(spark, d).select("id", "model_name", analytics.token_cost(F.col("model_name"), F.col("input_tokens"), F.col("output_tokens")).cast("double").alias("cost"))


@query(_REPORTS + """SELECT id, (input_tokens * 3 + output_tokens * 25) AS new_cost_1e7, CAST(input_tokens * 3 + output_tokens * 25 - cost_usd * 10000000 AS BIGINT) AS difference_1e7
FROM r WHERE contains(model_name, '2.5-flash') AND input_tokens IS NOT NULL AND output_tokens IS NOT NULL""")
def token_recost(spark, d):
    tenth_millionths = lambda c: (F.col(c) * 10_000_000).cast("long").alias(f"{c}_1e7")
    return analytics.recosted(_reports(spark, d)).select("id", tenth_millionths("new_cost"), tenth_millionths("difference"))


@query("""SELECT user_id AS report_id, CAST(sum(event_id) AS BIGINT) AS input_tokens, CAST(sum(event_id % 10) AS BIGINT) AS output_tokens, CAST(sum(CAST(value AS DECIMAL(10,2))) AS DECIMAL(18,4)) AS cost_usd FROM events GROUP BY 1""")
def usage_totals(spark, d):
    steps = table(spark, d, "events").select(F.col("user_id").alias("report_id"), F.col("event_id").alias("input_tokens"), (F.col("event_id") % 10).alias("output_tokens"), F.col("value").cast("decimal(10,2)").alias("cost_usd"))
    return analytics.usage(steps)


@query("SELECT DISTINCT n_name AS author FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey")
def facet_authors(spark, d):
    return analytics.facet(star_schema(spark, d).described(), "author")


@query("SELECT DISTINCT p_name AS keyword FROM part JOIN lineitem ON l_partkey = p_partkey")
def facet_keywords(spark, d):
    return analytics.facet(star_schema(spark, d).named_keywords(), "keyword")


@query("SELECT date_trunc('month', CAST(o_orderdate AS TIMESTAMP)) AS period, count(*) AS n FROM orders GROUP BY 1")
def drill_down_months(spark, d):
    return analytics.drill_down(star_schema(spark, d).recipes, "created_at", "month").withColumn("period", F.col("period").cast("timestamp_ntz"))


@query("""SELECT c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE (contains(lower(c_name), 'customer') OR contains(lower(n_name), 'customer')) AND (contains(lower(c_name), 'nation_1') OR contains(lower(n_name), 'nation_1'))""")
def admin_search(spark, d):
    b = star_schema(spark, d).books
    return b.where(analytics.matches_all_terms([F.col("title"), F.col("author")], "Customer NATION_1")).select("id")


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS book_id, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS ord FROM orders)
SELECT a.id, (SELECT b.id FROM r b WHERE b.book_id = a.book_id AND b.ord > a.ord ORDER BY b.ord, b.id LIMIT 1) AS next_id,
  (SELECT b.id FROM r b WHERE b.book_id = a.book_id AND b.ord < a.ord ORDER BY b.ord DESC, b.id LIMIT 1) AS previous_id FROM r a""")
def nav_in_book(spark, d):
    return navigation.in_book(star_schema(spark, d).recipes).select("id", "next_id", "previous_id")


@query("""WITH li AS (SELECT l_suppkey AS list_id, l_orderkey AS recipe_id, min(l_shipdate) AS listed_at FROM lineitem GROUP BY ALL)
SELECT list_id, recipe_id, lag(recipe_id) OVER w AS previous_id, lead(recipe_id) OVER w AS next_id FROM li WINDOW w AS (PARTITION BY list_id ORDER BY listed_at, recipe_id)""")
def nav_in_list(spark, d):
    items = star_schema(spark, d).list_items
    return navigation.in_sequence(items, "list_id", ["created_at", "recipe_id"], "recipe_id").drop("created_at")


@query("SELECT conv_id, turn, lag(turn) OVER w AS previous_id, lead(turn) OVER w AS next_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def nav_in_conversation(spark, d):
    return navigation.in_sequence(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", ["turn"], "turn")


_NEAR = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near AS (SELECT v.vec_id AS recipe_id, list_cosine_distance(v.e, q.e) AS distance FROM v JOIN v q ON q.vec_id = 3 {where} ORDER BY distance, recipe_id LIMIT {k}) """


@query(_NEAR.format(where="", k=12) + "SELECT recipe_id, round(distance, 4) AS distance, CAST(row_number() OVER (ORDER BY near.distance, recipe_id) AS INTEGER) AS rank FROM near")
def knn_topk(spark, d):
    e = star_schema(spark, d).embeddings
    return vectors.search(e, vectors.vector_of(e, 3), 12).withColumn("distance", F.round("distance", 4))


@query(_NEAR.format(where="AND v.vec_id <> 3", k=8) + "SELECT recipe_id, round(distance, 4) AS distance, CAST(row_number() OVER (ORDER BY near.distance, recipe_id) AS INTEGER) AS rank FROM near")
def knn_exclude_self(spark, d):
    return vectors.similar(star_schema(spark, d).embeddings, 3).withColumn("distance", F.round("distance", 4))


@query(_NEAR.format(where="AND v.vec_id <> 3", k=12) + "SELECT o_orderkey AS id, CAST(row_number() OVER (ORDER BY distance, recipe_id) AS INTEGER) AS rank, o_custkey AS book_id FROM near JOIN orders ON o_orderkey = recipe_id")
def similar_join_rank(spark, d):
    c = star_schema(spark, d)
    return vectors.ranked_recipes(vectors.similar(c.embeddings, 3, 12), c.recipes).select("id", "rank", "book_id")


@query("SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = o_orderkey)")
def embed_backfill_anti(spark, d):
    c = star_schema(spark, d)
    return vectors.missing(c.recipes, c.embeddings).select("id")


@query("""SELECT vec_id AS recipe_id, CAST(CASE WHEN vec_id % 10 = 0 THEN vec_id % 3 ELSE embedding[1] END AS FLOAT) AS first FROM embeddings""")
def embed_upsert(spark, d):
    """Every tenth vector is replaced, by the last of three new ones."""
    e = star_schema(spark, d).embeddings
    new = e.where("recipe_id % 10 = 0").select("recipe_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("position"))
    new = new.select("recipe_id", F.array(F.when(F.col("position") == 3, F.col("recipe_id") % 3).otherwise(-9).cast("float")).alias("embedding"), "position")
    return vectors.upsert(e, new).select("recipe_id", F.get("embedding", F.lit(0)).alias("first"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT v FROM v WHERE vec_id = 3),
r AS (SELECT vec_id, row_number() OVER (ORDER BY 1 - list_cosine_similarity(v.v, q.v), vec_id) AS rank FROM v, q WHERE vec_id <> 3 QUALIFY rank <= 200)
SELECT vec_id AS recipe_id, CAST(rank - 1 AS INTEGER) AS position, lag(vec_id) OVER (ORDER BY rank) AS previous_id, lead(vec_id) OVER (ORDER BY rank) AS next_id FROM r""")
def nav_in_ranked(spark, d):
    """Next and previous among the 200 nearest of a kept search, whose ids are one array as long as its limit."""
    near = vectors.similar(star_schema(spark, d).embeddings, 3, 200)
    return navigation.in_ranked(near.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "recipe_id"))), lambda x: x["recipe_id"]).alias("ids")))


@query("""SELECT vec_id AS recipe_id, row_number() OVER w - 1 AS position, lag(vec_id) OVER w AS previous_id, lead(vec_id) OVER w AS next_id FROM embeddings WINDOW w AS (ORDER BY vec_id % 7, vec_id)""")
def nav_in_ranked_all(spark, d):
    """Next and previous of every vector in an order of all."""
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 7).alias("k"), F.floor(F.col("vec_id") / 16384).alias("part"))
    return navigation.in_ranked_rows(rows, ["k", "part"], ["vec_id"], "vec_id")


@query("""SELECT o_custkey AS book_id, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id, count(*) AS n FROM orders GROUP BY 1
UNION ALL SELECT -1 - c_custkey, -1, -1, 1 FROM customer WHERE c_custkey % 50 = 0""")
def upsert_books(spark, d):
    old = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("book_id")).agg(F.lit(0).cast("long").alias("first_id"), F.lit(0).cast("long").alias("last_id"), F.lit(0).cast("long").alias("n"))
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("book_id")).agg(F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id"), F.count("*").alias("n"))
    more = table(spark, d, "customer").where("c_custkey % 50 = 0").select((-1 - F.col("c_custkey")).alias("book_id"), F.lit(-1).cast("long").alias("first_id"), F.lit(-1).cast("long").alias("last_id"), F.lit(1).cast("long").alias("n"))
    return mutations.upsert(old, new.union(more), ["book_id"])


@query("SELECT count_if(o_orderkey % 3 = 0) AS created, count_if(o_orderkey % 3 > 0) AS updated FROM orders")
def upsert_counts(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey")
    return mutations.upsert_counts(rows.where("o_orderkey % 3 > 0"), rows, ["o_orderkey"])


@query("SELECT o_custkey AS book_id, o_orderpriority AS name, max(o_orderkey) AS id FROM orders GROUP BY 1, 2")
def upsert_last_wins(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("id"))
    return mutations.last_wins(rows, ["book_id", "name"], [F.col("id")])


@query("SELECT min(doc_id) AS doc_id, lower(trim(text)) AS title FROM documents GROUP BY 2")
def dedup_first_by_title(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lower(F.trim("text")).alias("title"))
    return mutations.first_wins(docs, [F.col("title")], [F.col("doc_id")])


@query("SELECT DISTINCT p_name AS name FROM part")
def append_missing(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("name"))
    return mutations.append_missing(names.where(F.col("name") > "m").distinct(), names, ["name"])


@query("""SELECT l_orderkey AS recipe_id, l_partkey AS keyword_id FROM lineitem WHERE l_orderkey % 5 > 0 GROUP BY ALL
UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderkey % 5 = 0""")
def replace_links(spark, d):
    c = star_schema(spark, d)
    new = c.recipes.where("id % 5 = 0").select(F.col("id").alias("recipe_id"), F.lit(0).cast("long").alias("keyword_id"))
    return mutations.replace_links(c.recipe_keywords, new.union(new), "recipe_id")


@query("SELECT o_orderkey AS id, o_custkey AS book_id FROM orders WHERE o_custkey % 4 > 0")
def cascade_delete(spark, d):
    c = star_schema(spark, d)
    return mutations.delete(c.recipes.select("id", "book_id"), c.books.where("id % 4 = 0").select(F.col("id").alias("book_id")), ["book_id"])


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 > 0 THEN o_custkey END AS book_id FROM orders")
def delete_sets_null(spark, d):
    c = star_schema(spark, d)
    return mutations.set_null(c.recipes.select("id", "book_id"), c.books.where("id % 4 = 0").select("id"), "book_id")


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey = 7 OR o_orderstatus = 'O' THEN '' WHEN o_orderstatus = 'F' THEN 'img/' || o_orderkey || '.jpg' END AS image FROM orders")
def clear_images(spark, d):
    return mutations.clear_images(star_schema(spark, d).recipes, 7).select("id", "image")


@query("""WITH li AS (SELECT DISTINCT l_suppkey AS list_id, l_orderkey AS recipe_id FROM lineitem), p AS (SELECT 1 + o_orderkey % 10 AS list_id, o_orderkey AS recipe_id FROM orders)
(FROM li EXCEPT FROM p) UNION ALL (FROM p EXCEPT FROM li)""")
def list_toggle_all(spark, d):
    """One pair for every order: in where it was out, out where it was in."""
    c = star_schema(spark, d)
    return mutations.toggle(c.raw_items, c.recipes.select((1 + F.col("id") % 10).alias("list_id"), F.col("id").alias("recipe_id")))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN ['F'] ELSE [o_orderstatus, 'F'] END AS tried FROM orders")
def append_once(spark, d):
    return star_schema(spark, d).recipes.select("id", mutations.append_once(F.col("instructions"), F.lit("F")).alias("tried"))


@query("SELECT s_suppkey AS id FROM supplier EXCEPT SELECT l_suppkey FROM lineitem WHERE l_orderkey = 5")
def lists_available(spark, d):
    """The lists that do not hold a recipe."""
    c = star_schema(spark, d)
    return mutations.delete(c.lists.select("id"), c.list_items.where("recipe_id = 5").select(F.col("list_id").alias("id")), ["id"])


@query("""SELECT o_custkey AS book_id, CAST(count(*) AS BIGINT) AS n, CAST(min(o_orderkey) AS BIGINT) AS first FROM orders GROUP BY 1""")
def json_documents(spark, d):
    """The JSON document of each book, read back for its length and first element."""
    rows = star_schema(spark, d).recipes.select("book_id", "id", "name")
    parsed = mutations.document(rows, [F.col("id")]).withColumn("a", F.from_json("json", "array<struct<id:long,name:string>>"))
    return parsed.select("book_id", F.size("a").cast("long").alias("n"), F.get("a", F.lit(0))["id"].alias("first"))


@query("SELECT o_orderkey AS id, 'lib/' || o_orderkey || '/_output/recipes.json' AS path FROM orders")
def output_paths(spark, d):
    return star_schema(spark, d).recipes.select("id", mutations.output_path(F.lit("lib"), F.col("id"), "recipes.json").alias("path"))


@query("SELECT o_orderkey AS id, o_orderpriority || ' ' || o_orderkey AS name FROM orders ORDER BY md5('20240131:' || o_orderkey), o_orderkey LIMIT 1")
def daily_recipe(spark, d):
    recipes = star_schema(spark, d).recipes
    return daily_pick(recipes.select("id", "name"), F.lit("2024-01-31").cast("date"))


_STATUS = """WITH s AS (SELECT doc_id AS book_id, CASE doc_id % 6 WHEN 0 THEN 'analyse' WHEN 1 THEN 'extract_file' WHEN 2 THEN 'validate' WHEN 3 THEN 'await_human' WHEN 4 THEN 'resolve_images' ELSE 'extract_block' END AS stage,
  CASE WHEN source < 'm' THEN 'block' ELSE 'file' END AS kind, n_chars % 2 = 0 AS img, n_chars % 3 = 0 AS res, CASE WHEN n_chars % 5 = 0 THEN 'has_images' WHEN n_chars % 5 = 1 THEN 'none' END AS resp, n_chars % 4 = 0 AS blocked FROM documents) """


@query(_STATUS + """SELECT book_id, CASE stage WHEN 'analyse' THEN CASE WHEN kind = 'block' THEN 'extract_block' ELSE 'extract_file' END
  WHEN 'extract_file' THEN 'validate' WHEN 'extract_block' THEN 'validate'
  WHEN 'validate' THEN CASE WHEN NOT img AND NOT blocked THEN 'await_human' ELSE 'resolve_images' END
  WHEN 'await_human' THEN CASE WHEN resp = 'has_images' THEN 'extract_block' ELSE 'resolve_images' END
  ELSE CASE WHEN res OR resp IS NOT NULL OR blocked THEN 'finalise' ELSE 'await_human' END END AS next_stage FROM s""")
def route_next_state(spark, d):
    n, stages = F.col("n_chars"), ("analyse", "extract_file", "validate", "await_human", "resolve_images", "extract_block")
    status = table(spark, d, "documents").select(
        F.col("doc_id").alias("book_id"),
        F.element_at(F.array(*map(F.lit, stages)), (F.col("doc_id") % 6 + 1).cast("int")).alias("stage"),
        F.when(F.col("source") < "m", "block").otherwise("file").alias("extraction_type"),
        (n % 2 == 0).alias("any_image"),
        (n % 3 == 0).alias("any_resolved"),
        F.when(n % 5 == 0, "has_images").when(n % 5 == 1, "none").alias("human_response"),
        F.when(n % 4 == 0, F.array(F.lit("file"), F.lit("block"))).otherwise(F.array(F.lit("file"))).alias("already_tried"),
    )
    return workflow.routed(status).select("book_id", "next_stage")


@query("""SELECT doc_id AS book_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'running' WHEN doc_id % 2 = 0 THEN 'review' ELSE 'done' END AS status,
  CASE WHEN doc_id % 3 = 0 THEN 'has_images' END AS human_response FROM documents""")
def resume_reviews(spark, d):
    docs = table(spark, d, "documents")
    status = docs.select(F.col("doc_id").alias("book_id"), F.when(F.col("doc_id") % 2 == 0, "review").otherwise("done").alias("status"), F.lit(None).cast("string").alias("human_response"))
    decisions = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("book_id"), F.lit("has_images").alias("response"))
    return workflow.resumed(status, decisions).select("book_id", "status", "human_response")


@query("SELECT l_suppkey AS report_id, l_orderkey AS chapter, l_linenumber AS place, l_partkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS book_order FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem)")
def number_rows(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("report_id"), F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("place"), "l_partkey").distinct()
    keyed = rows.withColumn("line", F.col("place")).withColumn("place", F.struct("place", "l_partkey"))
    return workflow.numbered(keyed).select("report_id", "chapter", F.col("line").alias("place"), "l_partkey", "book_order")


@query("SELECT c_custkey AS id, CAST(count(o_orderkey) AS INTEGER) AS recipes_found, 'done' AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def finalise_reports(spark, d):
    c = star_schema(spark, d)
    recipes = c.recipes.select(F.col("book_id").alias("report_id"))
    return workflow.finalised(c.books.select("id"), recipes, F.lit(AS_OF)).select("id", "recipes_found", "status")


_KW = "WITH k AS (SELECT DISTINCT l_orderkey AS recipe_id, p_name AS keyword FROM lineitem JOIN part ON l_partkey = p_partkey) "


@query(_KW + "SELECT DISTINCT recipe_id, CASE keyword WHEN 'hot ring' THEN 'Rings' WHEN 'red ring' THEN 'Rings' WHEN 'old rod' THEN 'Rods' ELSE keyword END AS keyword FROM k")
def keyword_merge_apply(spark, d):
    """hot ring becomes red ring, which then becomes Rings."""
    ends = keywords.resolved({"hot ring": "red ring", "red ring": "Rings", "old rod": "Rods"})
    return keywords.applied(star_schema(spark, d).named_keywords().distinct(), spark.createDataFrame(list(ends.items()), "original string, canonical string"))


@query("""SELECT p_name AS original, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS canonical FROM part GROUP BY 1, 2""")
def keyword_normalise(spark, d):
    return keywords.proposed(table(spark, d, "part").select(F.col("p_name").alias("name")))


@query("""SELECT o_orderkey AS calibre_id, 'Order ' || o_orderkey AS title, o_orderkey || '-f' AS epub_name, coalesce((SELECT 'isbn' || min(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS isbn,
  coalesce((SELECT string_agg(s_name, ' & ' ORDER BY s_name) FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_orderkey = o_orderkey) JOIN supplier ON s_suppkey = l_suppkey), '') AS author
FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
def catalogue_query(spark, d):
    """A library's tables made of orders: the status is the format of a file, the priority a tag, suppliers are authors."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    o = F.col("o_orderkey")
    tags = orders.select(F.col("o_orderpriority").alias("name")).distinct().withColumn("id", F.crc32("name"))
    links = lines.select(F.col("l_orderkey").alias("book"), F.col("l_suppkey").alias("author")).distinct()
    tables = {
        "books": orders.select(o.alias("id"), F.concat(F.lit("Order "), o).alias("title"), F.lit("p").alias("path"), F.col("o_orderdate").cast("string").alias("pubdate"), F.col("o_orderdate").cast("string").alias("timestamp")),
        "identifiers": lines.select(F.col("l_orderkey").alias("book"), F.lit("isbn").alias("type"), F.concat(F.lit("isbn"), F.col("l_linenumber")).alias("val")),
        "data": orders.select(o.alias("book"), F.col("o_orderstatus").alias("format"), F.concat(o, F.lit("-f")).alias("name")),
        "authors": table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        "books_authors_link": links,
        "comments": orders.where("false").select(o.alias("book"), F.lit("").alias("text")),
        "books_tags_link": orders.select(o.alias("book"), F.crc32("o_orderpriority").alias("tag")),
        "tags": tags,
    }
    return library.books(tables, "1-URGENT", "F").select("calibre_id", "title", "epub_name", "isbn", "author")


@query("""SELECT time_bucket(INTERVAL 60 MINUTES, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_windowed_counts(spark, d):
    """An extension: the events counted as a stream in windows of an hour. Each batch upserts the windows that it changed,
    and windows beyond the watermark leave the state."""
    folder = work_folder(spark, "windows")
    counts = windowed_counts(spark, d, table(spark, d, "events").schema, name="events.parquet")
    counts = counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", F.col("count").alias("n"))
    stream_into(counts, f"{folder}/counts", ["start", "event_type"], ["n"], f"{folder}/checkpoint")
    return BucketTable(spark, f"{folder}/counts", ["start", "event_type"]).read()
