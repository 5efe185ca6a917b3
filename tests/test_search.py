"""The search of a small cookbook catalogue, against expected names and against a plain evaluator."""

import random

import pytest
from pyspark.sql import functions as F

from saffron.model import Catalogue
from saffron.plans import search as plan
from saffron.plans.filters import Condition, Group, Search, parse_groups

BOOKS = [(1001, "Chinese Cooking", "Fuchsia Dunlop"), (1002, "Indian Kitchen", "Asma Khan")]
RECIPES = [
    ("kung_pao", 1001, 1, "Kung Pao Chicken", "chicken, peanuts, chilli", "Stir fry chicken with sauce", "Chinese"),
    ("char_siu", 1001, 2, "Char Siu Pork", "pork, honey, soy sauce", "Roast pork with glaze", "Chinese"),
    ("spring_rolls", 1001, 3, "Vegetable Spring Rolls", "cabbage, carrots, spring roll wrappers", "Roll and fry", "Chinese,Vegetarian,Starter"),
    ("beef_curry", 1002, 1, "Kerala Beef Curry", "beef, coconut milk, curry leaves", "Slow cook with spices", "Indian,Curry"),
    ("dal", 1002, 2, "Dal Tadka", "lentils, onions, tomatoes", "Cook lentils with tempered spices", "Indian,Vegetarian,Curry,Quick"),
    ("samosa", 1002, 3, "Vegetable Samosas", "potatoes, peas, pastry", "Fill and fry", "Indian,Vegetarian,Starter"),
]
WORDS = ("Chinese", "Indian", "Vegetarian", "Starter", "Curry", "Quick")
LISTS = {1: ["kung_pao", "dal"], 2: ["kung_pao", "dal", "beef_curry"]}


@pytest.fixture(scope="module")
def catalogue(spark):
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema).coalesce(1).cache()

    return Catalogue(
        books=frame(BOOKS, "id int, title string, author string"),
        recipes=frame([(r[0], r[1], r[2], r[3], [r[4]], [r[5]], i) for i, r in enumerate(RECIPES)], "id string, book_id int, ord int, name string, ingredients array<string>, instructions array<string>, created_at int"),
        keywords=frame(list(enumerate(WORDS)), "id int, name string"),
        recipe_keywords=frame([(r[0], WORDS.index(k)) for r in RECIPES for k in r[6].split(",")], "recipe_id string, keyword_id int"),
        lists=frame([(1, "A"), (2, "B")], "id int, name string"),
        list_items=frame([(n, r, i) for n, rs in LISTS.items() for i, r in enumerate(rs)], "list_id int, recipe_id string, created_at int"),
    )


def c(field, op, value):
    return Condition(field, op, value)


def found(catalogue, **search):
    return {r["id"] for r in plan.build(Search(**search), catalogue).select("id").collect()}


CHINESE, VEGETARIAN, STARTER = (c("keywords", "contains", k) for k in ("Chinese", "Vegetarian", "Starter"))
CASES = [
    (dict(text="kung pao"), "kung_pao"),
    (dict(text="coconut"), "beef_curry"),
    (dict(text="fuchsia"), "kung_pao char_siu spring_rolls"),
    (dict(text="vegetarian"), "spring_rolls dal samosa"),
    (dict(groups=(Group("and", (CHINESE,)),)), "kung_pao char_siu spring_rolls"),
    (dict(groups=(Group("and", (CHINESE, c("ingredients", "not_contains", "chicken"))),)), "char_siu spring_rolls"),
    (dict(groups=(Group("and", (CHINESE,)), Group("or", (c("ingredients", "contains", "chicken"), c("ingredients", "contains", "pork")))), group_logic="and"), "kung_pao char_siu"),
    (dict(groups=(Group("or", (VEGETARIAN, STARTER)),)), "spring_rolls dal samosa"),
    (dict(groups=(Group("and", (VEGETARIAN, STARTER)),)), "spring_rolls samosa"),
    (dict(groups=(Group("and", (c("keywords", "contains", "Curry"), c("ingredients", "contains", "coconut"), c("ingredients", "contains", "beef"))),)), "beef_curry"),
    (dict(groups=(Group("and", (c("author", "contains", "Fuchsia Dunlop"),)),)), "kung_pao char_siu spring_rolls"),
    (dict(groups=(Group("and", (c("keywords", "contains", "Quick"),)), Group("and", (c("author", "contains", "Asma Khan"),))), group_logic="and"), "dal"),
    (dict(lists=(1,)), "kung_pao dal"),
    (dict(lists=(2,), groups=(Group("and", (VEGETARIAN,)),)), "dal"),
    (dict(), ""),
    (dict(groups=(Group("and", (CHINESE,)), Group("and", (c("ingredients", "contains", "beef"),))), group_logic="or"), ""),
    (dict(groups=(Group("and", (c("keywords", "not_contains", "Vegetarian"),)),)), "kung_pao char_siu beef_curry"),
    (dict(groups=(Group("and", (c("name", "starts", "veg"),)),)), "spring_rolls samosa"),
    (dict(groups=(Group("and", (c("keywords", "equals", "curry"),)),)), "beef_curry dal"),
]


@pytest.mark.parametrize("search, names", CASES)
def test_searches_of_the_cookbook(catalogue, search, names):
    assert found(catalogue, **search) == set(names.split())


def test_sorted_by_name_and_author(catalogue):
    names = [r["name"] for r in plan.run(Search(text="curry", sort="name"), catalogue).collect()]
    assert names == ["Dal Tadka", "Kerala Beef Curry"]
    authors = [r["author"] for r in plan.run(Search(groups=(Group("and", (c("name", "contains", "a"),)),), sort="author"), catalogue).collect()]
    assert authors == sorted(authors) and len(authors) == 6


@pytest.mark.parametrize("down", [False, True])
def test_pages_from_either_end_and_by_reading_on(spark, down):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else i % 7) for i in range(23)], "id int, v int")
    order = [plan.By(F.col("v"), down), plan.By(F.col("id"))]
    whole = [r["id"] for r in rows.orderBy(*[k.sorted() for k in order]).collect()]
    for page in (1, 2, 3, 4, 5, 6, 99):
        first = (min(page, 5) - 1) * 5
        have, total = plan.get_page(rows, order, page, 5)
        assert ([r["id"] for r in have.collect()], total) == (whole[first : first + 5], 23)
    for place in (0, 4, 11, 20, 22):
        assert [r["id"] for r in plan.page_after(rows, order, whole[place], 5).collect()] == whole[place + 1 : place + 6]
    assert plan.page_after(rows, order, -1, 5).count() == 0
    assert plan.get_page(rows.where("false"), order, 3, 5)[0].count() == 0


def test_parsing_of_parallel_lists():
    groups = parse_groups(["a", "b", "c", "d"], ["contains"] * 4, ["1", " ", "3", "4"], ["2", "0", "x", "2"], ["and", "or", "or"])
    assert [(g.logic, [(k.field, k.value) for k in g.conditions]) for g in groups] == [("or", [("c", "3")]), ("and", [("a", "1")])]


def plainly(text, groups, group_logic):
    """Some choice of one keyword satisfies quick search and groups, and each chained condition has a keyword."""
    out = set()
    for key, book, _, name, ingredients, instructions, keywords in RECIPES:
        author = dict((b[0], b[2]) for b in BOOKS)[book]
        title = dict((b[0], b[1]) for b in BOOKS)[book]
        fields = {"name": name, "ingredients": ingredients, "author": author}
        own = keywords.split(",")

        def holds(k, bound):
            tests = {"contains": lambda x: k.value.lower() in x.lower(), "equals": lambda x: x.lower() == k.value.lower(), "starts": lambda x: x.lower().startswith(k.value.lower())}
            if k.field == "keywords":
                return not any(k.value.lower() in x.lower() for x in own) if k.op == "not_contains" else tests[k.op](bound)
            return k.value.lower() not in fields[k.field].lower() if k.op == "not_contains" else tests[k.op](fields[k.field])

        chained = [k for g in groups if g.logic == "and" for k in g.conditions if k.binds_a_row]

        def whole(bound):
            parts = []
            for g in groups:
                inner = [holds(k, bound) for k in g.conditions if not (g.logic == "and" and k.binds_a_row)]
                if inner:
                    parts.append(all(inner) if g.logic == "and" else any(inner))
            quick = not text or any(text.lower() in x.lower() for x in (name, ingredients, instructions, author, title, bound))
            return quick and (not parts or (all(parts) if group_logic == "and" else any(parts)))

        if any(whole(k) for k in own) and all(any(holds(k, x) for x in own) for k in chained):
            out.add(key)
    return out


@pytest.mark.parametrize("seed", range(25))
def test_any_filter_equals_a_plain_evaluation(catalogue, seed):
    rng = random.Random(seed)

    def condition():
        field = rng.choice(["keywords", "keywords", "name", "ingredients", "author"])
        op = rng.choice(["contains", "not_contains", "equals", "starts"])
        return c(field, op, rng.choice(["veg", "Curry", "chi", "a", "Indian", "Quick", "khan", "Vegetarian", "o"]))

    groups = tuple(Group(rng.choice(["and", "or"]), tuple(condition() for _ in range(rng.randint(1, 3)))) for _ in range(rng.randint(1, 3)))
    logic, text = rng.choice(["and", "or"]), rng.choice(["", "", "veg", "cu"])
    assert found(catalogue, text=text, groups=groups, group_logic=logic) == plainly(text, groups, logic)
