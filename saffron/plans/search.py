"""From a search to a DataFrame of recipes.

Conditions on related rows (keywords, lists) come in two kinds. Those of and-groups are each an EXISTS of their own
(a semi-join) and always narrow the result, whatever joins the groups. All others, the quick search included, form
one predicate in which the conditions on a relation speak of the same related row. For that predicate each recipe
gets the distinct combinations of outcomes over its related rows, one small array, so the recipes themselves are
never multiplied. Negated conditions on a relation hold where no related row matches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Catalogue
from .filters import RELATIONS, Condition, Search, text_predicate
from .pages import NARROW, Pages

#: Fields of recipes and their books as text; a list counts as its elements, one in each line.
FIELDS = {"author": "author", "book": "title", "title": "title"}

Outcome = Callable[[dict[str, Column]], Column]


@dataclass
class _Relation:
    """Positive conditions met so far on one relation, each known by its place."""

    rows: DataFrame
    name: str
    conditions: list[Condition]

    def outcome(self, condition: Condition) -> Outcome:
        self.conditions.append(condition)
        place = f"c{len(self.conditions) - 1}"
        return lambda bound: bound[self.name][place]


def _related(catalogue: Catalogue) -> dict[str, DataFrame]:
    lists = catalogue.list_items.join(catalogue.lists.select(F.col("id").alias("list_id"), F.col("name").alias("related")), "list_id")
    return {"keywords": catalogue.searched_keywords(), "recipe_lists": lists.select("recipe_id", "related")}


def _as_text(recipes: DataFrame, field: str) -> Column:
    name = FIELDS.get(field, field)
    return F.array_join(F.col(name), "\n") if dict(recipes.dtypes).get(name, "").startswith("array") else F.col(name).cast("string")


def _joined(parts: list[Outcome], every: bool) -> Outcome | None:
    if not parts:
        return None
    combine = (lambda a, b: a & b) if every else (lambda a, b: a | b)
    return lambda bound: reduce(combine, (p(bound) for p in parts))


def _with_absent(recipes: DataFrame, rows: DataFrame, condition: Condition, flag: str) -> DataFrame:
    """A flag for the recipes none of whose related rows matches the condition without its negation."""
    matching = rows.where(text_predicate(F.col("related"), "contains", condition.value)).select(F.col("recipe_id").alias("id")).distinct()
    return recipes.join(matching.withColumn(flag, F.lit(True)), "id", "left").withColumn(flag, F.col(flag).isNull())


def build(search: Search, catalogue: Catalogue) -> DataFrame:
    """The recipes found, with title and author, unsorted."""
    related = _related(catalogue)
    recipes = catalogue.described() if catalogue.substrings is None else catalogue.substrings.narrowed(search)
    relations = {name: _Relation(related[name], name, []) for name in RELATIONS}
    # a book that does not exist is passed over, and a search that asks for nothing finds nothing
    book = search.book is not None and not catalogue.books.where(F.col("id") == search.book).limit(1).isEmpty()
    if not (search.text or search.groups or search.lists or search.keywords or book or search.ranked is not None):
        return recipes.where(F.lit(False))
    if book:
        recipes = recipes.where(F.col("book_id") == search.book)
    for name in search.keywords:
        recipes = _exists(recipes, related["keywords"], Condition("keywords", "equals", name))
    if search.lists:
        recipes = recipes.join(catalogue.list_items.where(F.col("list_id").isin(*search.lists)).select(F.col("recipe_id").alias("id")), "id", "left_semi")

    negated = 0

    def outcome(condition: Condition) -> Outcome | None:
        nonlocal recipes, negated
        if condition.binds_a_row:
            return relations[condition.field].outcome(condition)
        if condition.field in RELATIONS and condition.op == "not_contains":
            flag, negated = f"_absent{negated}", negated + 1
            recipes = _with_absent(recipes, related[condition.field], condition, flag)
            return lambda _: F.col(flag)
        test = text_predicate(_as_text(recipes, condition.field), condition.op, condition.value)
        return None if test is None else lambda _: test

    chained, groups = [], []
    for group in search.groups:
        every = group.logic == "and"
        chained += [c for c in group.conditions if every and c.binds_a_row]
        parts = [o for c in group.conditions if not (every and c.binds_a_row) if (o := outcome(c)) is not None]
        groups.append(_joined(parts, every))
    tests = [_joined([g for g in groups if g], search.group_logic == "and")]
    if search.text:
        quick = [Condition(f, "contains", search.text) for f in ("name", "ingredients", "instructions", "keywords", "author", "book")]
        tests.append(_joined([outcome(c) for c in quick if c.field in RELATIONS or FIELDS.get(c.field, c.field) in recipes.columns], False))

    recipes = _bound_where(recipes, relations, _joined([t for t in tests if t], True))
    for condition in chained:
        recipes = _exists(recipes, related[condition.field], condition)
    if search.ranked is not None and not (search.empty_ranked_is_no_filter and search.ranked.limit(1).isEmpty()):
        recipes = recipes.join(search.ranked.select(F.col("recipe_id").alias("id")), "id", "left_semi")
    return recipes.drop(*[f"_absent{i}" for i in range(negated)])


def _exists(recipes: DataFrame, rows: DataFrame, condition: Condition) -> DataFrame:
    matching = rows.where(text_predicate(F.col("related"), condition.op, condition.value))
    return recipes.join(matching.select(F.col("recipe_id").alias("id")), "id", "left_semi")


def _bound_where(recipes: DataFrame, relations: dict[str, _Relation], test: Outcome | None) -> DataFrame:
    """The recipes for which some choice of one row from each relation satisfies the test. The test uses relations only
    positively, so the choice of a row that matches nothing can always be allowed."""
    if test is None:
        return recipes
    used = [r for r in relations.values() if r.conditions]
    for r in used:
        outcomes = [F.coalesce(text_predicate(F.col("related"), c.op, c.value), F.lit(False)).alias(f"c{i}") for i, c in enumerate(r.conditions)]
        flagged = r.rows.select(F.col("recipe_id").alias("id"), F.struct(*outcomes).alias("o"))
        flagged = flagged.where(reduce(lambda a, b: a | b, (F.col("o")[f"c{i}"] for i in range(len(outcomes)))))
        recipes = recipes.join(flagged.groupBy("id").agg(F.collect_set("o").alias(f"_{r.name}")), "id", "left")
        none = F.array(F.struct(*[F.lit(False).alias(f"c{i}") for i in range(len(outcomes))]))
        recipes = recipes.withColumn(f"_{r.name}", F.coalesce(F.col(f"_{r.name}"), none))

    def choose(left: list[_Relation], bound: dict[str, Column]) -> Column:
        if not left:
            return test(bound)
        return F.exists(F.col(f"_{left[0].name}"), lambda o: choose(left[1:], bound | {left[0].name: o}))

    return recipes.where(choose(used, {})).drop(*[f"_{r.name}" for r in used])


@dataclass(frozen=True)
class By:
    """One key of a sort; nulls come first going up and last going down."""

    column: Column
    down: bool = False

    def sorted(self, forward: bool = True) -> Column:
        return self.column.desc() if self.down == forward else self.column.asc()

    def beyond(self, value, forward: bool) -> Column:
        """Whether a row comes after (or before) one whose key is `value`."""
        if value is None:
            return self.column.isNotNull() if forward != self.down else F.lit(False)
        up = forward != self.down
        moved = self.column > F.lit(value) if up else self.column < F.lit(value)
        return F.coalesce(moved, F.lit(not up))


def ordering(search: Search, recipes: DataFrame, catalogue: Catalogue) -> tuple[DataFrame, list[By]]:
    """recipes with what the sort needs, and its keys; id breaks ties, so pages never overlap."""
    sort = search.sort or search.default_sort
    name = lambda c, down=False: By(F.col(c), down)
    if sort == "relevance" and search.ranked is not None:
        ranked = search.ranked.select(F.col("recipe_id").alias("id"), "rank")
        return recipes.join(ranked, "id", "left").withColumn("rank", F.coalesce("rank", F.lit(9999))), [name("rank"), name("id")]
    if sort == "list_order" and len(search.lists) == 1:
        items = catalogue.list_items.where(F.col("list_id") == search.lists[0]).select(F.col("recipe_id").alias("id"), F.col("created_at").alias("listed_at"))
        return recipes.join(items, "id", "left"), [name("listed_at"), name("id")]
    orders = {
        "recent": [name("created_at", True)],
        "author": [name("author"), name("title"), name("name")],
        "book": [name("title"), name("ord")],
        "order": [name("author"), name("ord")],  # a book's own default order is its author
        "random": [By(F.md5(F.concat(F.lit(f"{search.seed}:"), F.col("id").cast("string"))))],
    }
    return recipes, [*orders.get(sort, [name("name")]), name("id")]


def paged(rows: DataFrame, order: list[By], page: int, per_page: int) -> DataFrame:
    return rows.orderBy(*[k.sorted() for k in order]).offset((page - 1) * per_page).limit(per_page)


def run(search: Search, catalogue: Catalogue) -> DataFrame:
    """One sorted page of a search."""
    return paged(*ordering(search, build(search, catalogue), catalogue), search.page, search.per_page)


def get_page(rows: DataFrame, order: list[By], page: int, per_page: int) -> tuple[DataFrame, int]:
    """(rows of the page, number of all rows); a page beyond the last is the last. Where there are many rows, only a narrow
    range of keys around the page is sorted. For page after page of one result keep a Pages; page_after reads on from any
    row without counting."""
    pages = pages_of(rows, order)
    return pages.page(page, per_page), pages.total


def pages_of(rows: DataFrame, order: list[By], narrow: int = NARROW) -> Pages:
    """The pages of a sorted result by number, of which at most about `narrow` rows are sorted for one."""
    return Pages(rows, order, _past, narrow)


def with_keywords(page: DataFrame, catalogue: Catalogue) -> DataFrame:
    """A page with each recipe's keyword names in order; nested after paging, so only a page's keywords are read."""
    names = catalogue.named_keywords().join(page.select(F.col("id").alias("recipe_id")), "recipe_id", "left_semi")
    nested = names.groupBy(F.col("recipe_id").alias("id")).agg(F.array_sort(F.collect_list("keyword")).alias("keyword_names"))
    return page.join(nested, "id", "left").withColumn("keyword_names", F.coalesce("keyword_names", F.array().cast("array<string>")))


def _key(rows: DataFrame, order: list[By], current):
    """The sort's keys of the row whose id is `current`."""
    return rows.where(F.col("id") == current).select(*[k.column.alias(f"k{i}") for i, k in enumerate(order)]).first()


def _past(order: list[By], key, forward: bool) -> Column:
    """Whether a row comes after (or before) the one with these keys."""
    same, past = F.lit(True), F.lit(False)
    for k, value in zip(order, key, strict=True):
        past = past | (same & k.beyond(value, forward))
        same = same & k.column.eqNullSafe(F.lit(value))
    return past


def page_after(rows: DataFrame, order: list[By], current, per_page: int) -> DataFrame:
    """The page that follows the row whose id is `current`, at any depth for the price of the first; none for an unknown id."""
    key = _key(rows, order, current)
    past = F.lit(False) if key is None else _past(order, key, True)
    return rows.where(past).orderBy(*[k.sorted() for k in order]).limit(per_page)


def around(found: DataFrame, order: list[By], current) -> DataFrame:
    """(direction, id): the rows before and after the one whose id is `current` in a sorted result of any size: each is
    the first of those beyond it, so nothing but the two rows is gathered."""
    key = _key(found, order, current)
    if key is None:
        return found.select(F.lit("next").alias("direction"), "id").where(F.lit(False))

    def nearest(forward: bool) -> DataFrame:
        return found.where(_past(order, key, forward)).orderBy(*[k.sorted(forward) for k in order]).limit(1).select(F.lit("next" if forward else "previous").alias("direction"), "id")

    return nearest(True).union(nearest(False))
