"""Searches of the catalogue: conditions, groups, scopes, sorts and pages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import star_schema
from ..operators import vectors
from ..plans import search as plan
from ..plans import substring
from ..plans.filters import Condition, Group, Search, parse
from ..streaming.folders import work_folder

#: What the searches below read, as common table expressions.
TABLES = r"""
WITH b AS (SELECT c_custkey AS id, c_name AS title, n_name AS author FROM customer JOIN nation ON c_nationkey = n_nationkey),
r AS (
  SELECT o_orderkey AS id, o_custkey AS book_id, title, author, o_orderpriority || ' ' || o_orderkey AS name,
    array_to_string(string_split(o_orderpriority, '-'), chr(10)) AS ingredients, o_orderstatus AS instructions,
    date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS ord, o_orderdate AS created_at
  FROM orders JOIN b ON o_custkey = b.id
),
kw AS (SELECT DISTINCT l_orderkey AS recipe_id, lower(p_name) AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
li AS (SELECT l_suppkey AS list_id, l_orderkey AS recipe_id, min(l_shipdate) AS listed_at FROM lineitem GROUP BY ALL)
"""
COLUMNS = ("id", "book_id", "title", "author", "name")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _c(field: str, op: str, value: str) -> Condition:
    return Condition(field, op, value)


def _has(test: str) -> str:
    return f"EXISTS (SELECT 1 FROM kw WHERE kw.recipe_id = r.id AND {test})"


def _found(name: str, search: Search, where: str) -> None:
    """Registers all rows of a search."""
    QUERIES[name] = lambda spark, d: plan.build(search, star_schema(spark, d)).select(*COLUMNS)
    ORACLE_SQL[name] = f"{TABLES} SELECT {', '.join(COLUMNS)} FROM r WHERE {where}"


def _page(name: str, search: Search, where: str, order: str | None, more: str = "") -> None:
    """Registers one page of a search; order None: an order that SQL cannot express."""
    QUERIES[name] = lambda spark, d: plan.run(search, star_schema(spark, d)).select(*COLUMNS)
    if order:
        ORACLE_SQL[name] = f"{TABLES} SELECT {', '.join(f'r.{c}' for c in COLUMNS)} FROM r {more} WHERE {where} ORDER BY {order} LIMIT {search.per_page} OFFSET {(search.page - 1) * search.per_page}"


AND, OR = "and", "or"
_has_ring, _has_red = _has("contains(k, 'ring')"), _has("contains(k, 'red')")
_quick = "(contains(lower(name), '{0}') OR contains(lower(ingredients), '{0}') OR contains(lower(instructions), '{0}') OR contains(lower(author), '{0}') OR contains(lower(title), '{0}')"

_flagship = Search(groups=(Group(AND, (_c("keywords", "contains", "RING"), _c("author", "contains", "nation_1"), _c("name", "not_contains", "urgent"))),), sort="recent")
_page("search_flagship", _flagship, f"{_has_ring} AND contains(lower(author), 'nation_1') AND NOT contains(lower(name), 'urgent')", "created_at DESC, id")

_found("search_quick", Search(text="red"), f"{_quick.format('red')} OR {_has_red})")
_found("search_quick_author", Search(text="nation_12"), f"{_quick.format('nation_12')} OR {_has("contains(k, 'nation_12')")})")
_found("search_contains", Search(groups=(Group(AND, (_c("author", "contains", "Nation_2"),)),)), "contains(lower(author), 'nation_2')")
_found("search_not_contains", Search(groups=(Group(AND, (_c("ingredients", "not_contains", "low"),)),)), "NOT contains(lower(ingredients), 'low')")
_found("search_equals", Search(groups=(Group(AND, (_c("author", "equals", "nation_7"),)),)), "lower(author) = 'nation_7'")
_found("search_starts", Search(groups=(Group(AND, (_c("name", "starts", "3-med"),)),)), "starts_with(lower(name), '3-med')")
_found("search_unknown_operation", Search(groups=(Group(AND, (_c("name", "sounds like", "x"), _c("author", "equals", "nation_7"))),)), "lower(author) = 'nation_7'")
_found("search_wildcards_are_text", Search(groups=(Group(OR, (_c("author", "contains", "n%1"), _c("author", "contains", "N_1"))),)), "contains(lower(author), 'n%1') OR contains(lower(author), 'n_1')")
_found("search_m2m_and", Search(groups=(Group(AND, (_c("keywords", "contains", "ring"), _c("keywords", "contains", "red"))),)), f"{_has_ring} AND {_has_red}")
_found("search_m2m_or", Search(groups=(Group(OR, (_c("keywords", "contains", "ring"), _c("keywords", "starts", "red"))),)), _has("(contains(k, 'ring') OR starts_with(k, 'red'))"))
_found("search_m2m_not", Search(groups=(Group(AND, (_c("keywords", "not_contains", "ring"),)),)), f"NOT {_has_ring}")
_found("search_m2m_equals", Search(groups=(Group(AND, (_c("keywords", "equals", "Hot Ring"),)),)), _has("k = 'hot ring'"))
_found("search_lists_field", Search(groups=(Group(AND, (_c("recipe_lists", "equals", "supplier#000000003"),)),)), "EXISTS (SELECT 1 FROM li JOIN supplier ON list_id = s_suppkey WHERE li.recipe_id = r.id AND lower(s_name) = 'supplier#000000003')")
_mixed_groups = (Group(OR, (_c("ingredients", "contains", "urgent"), _c("ingredients", "contains", "high"))), Group(AND, (_c("author", "contains", "nation_1"), _c("instructions", "equals", "f"))))
_left, _right = "(contains(lower(ingredients), 'urgent') OR contains(lower(ingredients), 'high'))", "(contains(lower(author), 'nation_1') AND lower(instructions) = 'f')"
_found("search_groups_and", Search(groups=_mixed_groups, group_logic=AND), f"{_left} AND {_right}")
_found("search_groups_or", Search(groups=_mixed_groups, group_logic=OR), f"{_left} OR {_right}")
_found(
    "search_same_row",
    Search(text="ring", groups=(Group(OR, (_c("keywords", "contains", "red"), _c("name", "starts", "5-low"))),)),
    f"EXISTS (SELECT 1 FROM (SELECT k FROM kw WHERE kw.recipe_id = r.id UNION ALL SELECT '') s WHERE ({_quick.format('ring')} OR contains(s.k, 'ring'))) AND (contains(s.k, 'red') OR starts_with(lower(name), '5-low')))",
)
_found("search_chained_ignores_group_logic", Search(groups=(Group(AND, (_c("keywords", "contains", "ring"),)), Group(AND, (_c("ingredients", "contains", "low"),))), group_logic=OR), f"{_has_ring} AND contains(lower(ingredients), 'low')")
_found("search_nothing", Search(), "false")
_request = {"q": " red ", "filter_field[]": ["author", "name", "keywords"], "filter_op[]": ["contains", "contains", "contains"], "filter_value[]": ["nation_1", "  ", "ring"], "filter_group[]": ["0", "0", "x"], "filter_logic[]": ["and", "and", "and"], "group_logic": "and", "page": "zero"}
_found("search_parsed_request", parse(_request), f"({_quick.format('red')} OR {_has_red})) AND contains(lower(author), 'nation_1') AND {_has_ring}")

_found("scope_lists", Search(lists=(3, 5)), "EXISTS (SELECT 1 FROM li WHERE li.recipe_id = r.id AND list_id IN (3, 5))")
_found("scope_keywords", Search(keywords=("HOT RING", "red plate")), f"{_has("k = 'hot ring'")} AND {_has("k = 'red plate'")}")
_found("scope_book", Search(book=7), "book_id = 7")
_found("scope_unknown_book", Search(book=-1), "false")
_found("scope_unknown_book_is_passed_over", Search(book=-1, text="nation_12"), f"{_quick.format('nation_12')} OR {_has("contains(k, 'nation_12')")})")

_all = (Group(AND, (_c("author", "contains", "nation_1"),)),)
_where = "contains(lower(r.author), 'nation_1')"
_page("sort_name", Search(groups=_all, sort="name"), _where, "r.name, r.id")
_page("sort_recent", Search(groups=_all), _where, "r.created_at DESC, r.id")
_page("sort_author", Search(groups=_all, sort="author"), _where, "r.author, r.title, r.name, r.id")
_page("sort_book", Search(groups=_all, sort="book"), _where, "r.title, r.ord, r.id")
_page("sort_order", Search(groups=_all, sort="order"), _where, "r.author, r.ord, r.id")
_page("sort_unknown", Search(groups=_all, sort="colour"), _where, "r.name, r.id")
_page("sort_random", Search(groups=_all, sort="random", seed=11), _where, "md5('11:' || r.id), r.id")
_page("sort_list_order", Search(lists=(3,)), "true", "li.listed_at, r.id", "JOIN li ON li.recipe_id = r.id AND li.list_id = 3")
_page("page_3", Search(groups=_all, sort="name", page=3), _where, "r.name, r.id")
_page("page_beyond_the_last", Search(book=7, sort="name", page=500), "r.book_id = 7", "r.name, r.id")


def page_with_keywords(spark: SparkSession, d: str) -> DataFrame:
    catalogue = star_schema(spark, d)
    page = plan.run(Search(groups=_all, sort="name"), catalogue).select("id", "name")
    return plan.with_keywords(page, catalogue)


QUERIES["page_with_keywords"] = page_with_keywords
ORACLE_SQL["page_with_keywords"] = f"""{TABLES}, p AS (SELECT id, name FROM r WHERE {_where} ORDER BY name, id LIMIT 30),
n AS (SELECT DISTINCT l_orderkey AS id, p_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT p.id, p.name, coalesce(list_sort(list(p_name) FILTER (p_name IS NOT NULL)), []) AS keyword_names FROM p LEFT JOIN n USING (id) GROUP BY p.id, p.name"""


def last_page(spark: SparkSession, d: str) -> DataFrame:
    """A page far too high is the last one."""
    catalogue = star_schema(spark, d)
    rows, order = plan.ordering(search := Search(groups=_all, sort="name"), plan.build(search, catalogue), catalogue)
    page, total = plan.get_page(rows, order, 10**6, 30)
    return page.select("id", F.lit(total).cast("long").alias("total"))


QUERIES["page_last"] = last_page
ORACLE_SQL["page_last"] = f"""{TABLES}, f AS (SELECT id, row_number() OVER (ORDER BY name, id) - 1 AS place, count(*) OVER () AS total FROM r WHERE {_where})
SELECT id, total FROM f WHERE place // 30 = (total - 1) // 30"""


def page_read_on(spark: SparkSession, d: str) -> DataFrame:
    """The page after the row that ends the third one."""
    catalogue = star_schema(spark, d)
    rows, order = plan.ordering(search := Search(groups=_all, sort="recent"), plan.build(search, catalogue), catalogue)
    last = plan.paged(rows, order, 90, 1).select("id").first()
    return plan.page_after(rows, order, last[0], 30).select("id", "name")


QUERIES["page_read_on"] = page_read_on
ORACLE_SQL["page_read_on"] = f"""{TABLES} SELECT id, name FROM r WHERE {_where} ORDER BY created_at DESC, id LIMIT 30 OFFSET 90"""


def nav_in_result(spark: SparkSession, d: str) -> DataFrame:
    """The rows before and after the 40th of a sorted search."""
    catalogue = star_schema(spark, d)
    rows, order = plan.ordering(search := Search(groups=_all, sort="recent"), plan.build(search, catalogue), catalogue)
    current = rows.orderBy(*[k.sorted() for k in order]).offset(39).limit(1).select("id").first()
    return plan.around(rows, order, current[0])


QUERIES["nav_in_result"] = nav_in_result
ORACLE_SQL["nav_in_result"] = f"""{TABLES}, f AS (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS place FROM r WHERE {_where})
SELECT CASE place WHEN 41 THEN 'next' ELSE 'previous' END AS direction, id FROM f WHERE place IN (39, 41)"""


def sort_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Recipes found by vector in the order of their distance."""
    catalogue = star_schema(spark, d)
    near = vectors.similar(catalogue.embeddings, 3, 40)
    return plan.run(Search(ranked=near), catalogue).select("id", "rank", "name")


QUERIES["sort_relevance"] = sort_relevance
ORACLE_SQL["sort_relevance"] = f"""{TABLES}, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near AS (SELECT v.vec_id AS id, list_cosine_distance(v.e, q.e) AS distance FROM v JOIN v q ON q.vec_id = 3 AND v.vec_id <> 3 ORDER BY distance, id LIMIT 40),
f AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS rank FROM near)
SELECT id, CAST(rank AS INTEGER) AS rank, name FROM f JOIN r USING (id) ORDER BY rank LIMIT 30"""


def _indexed(name: str, of: str, search: Search) -> None:
    """Registers a search that goes by a trigram index made of the catalogue; its SQL is that of the search without one."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        catalogue = star_schema(spark, d)
        recipes = catalogue.described()
        kept = substring.build(recipes, substring.texts_of(recipes, catalogue.searched_keywords()), work_folder(spark, "trigrams"))
        return plan.build(search, replace(catalogue, substrings=kept)).select(*COLUMNS)

    QUERIES[name], ORACLE_SQL[name] = run, ORACLE_SQL[of]


_indexed("indexed_quick", "search_quick_author", Search(text="nation_12"))
_indexed("indexed_groups", "search_groups_and", Search(groups=_mixed_groups, group_logic=AND))
_indexed("indexed_keywords", "search_m2m_and", Search(groups=(Group(AND, (_c("keywords", "contains", "ring"), _c("keywords", "contains", "red"))),)))
