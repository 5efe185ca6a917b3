"""The list of books, samples that can be repeated, and facts about reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import clamped
from ..plans.search import By, get_page
from .analytics import counted, recosted

#: Books of a page, recipes shown of a book, recipes whose tokens are counted, results of a vector search.
PAGE, SHOWN, COUNTED, FOUND = 60, 6, 10, 1000


def shuffled(id_: Column, seed: int = 0) -> Column:
    """A random place for each id, the same for the same seed."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string")))


def contains_any(fields: list[Column], text: str) -> Column:
    """Whether one of the fields at least holds the text, in any case; all rows for no text."""
    test = F.lit(not text)
    for f in fields:
        test = test | F.coalesce(F.contains(F.lower(f), F.lower(F.lit(text))), F.lit(False))
    return test


@dataclass(frozen=True)
class BookList:
    search: str = ""
    authors: list[str] = field(default_factory=list)
    has_recipes: bool = False
    sort: str = "random"
    page: int = 1
    seed: int = 0


def books(asked: BookList, shelf: DataFrame, recipes: DataFrame) -> tuple[DataFrame, list[By]]:
    """shelf (id, title, author, added_at) as asked for, with recipe_count, and the keys of its sort. Books are chosen
    before they are counted. A sort that is not known is the most recent first; ids break ties."""
    chosen = shelf.where(contains_any([F.col("title"), F.col("author")], asked.search))
    if asked.authors:
        chosen = chosen.where(F.col("author").isin(asked.authors))
    chosen = counted(chosen, recipes.select("book_id"), "book_id", "recipe_count")
    if asked.has_recipes:
        chosen = chosen.where("recipe_count >= 1")
    key = lambda c, down=False: By(F.col(c), down)
    recent = [key("added_at", True), key("title")]
    orders = {
        "title": [key("title")],
        "author": [key("author"), key("title")],
        "recipes": [key("recipe_count", True), key("title")],
        "random": [By(F.when(F.col("recipe_count") >= 1, 0).otherwise(1)), By(shuffled(F.col("id"), asked.seed))],
    }
    return chosen, [*orders.get(asked.sort, recent), key("id")]


def book_page(asked: BookList, shelf: DataFrame, recipes: DataFrame) -> DataFrame:
    """One page of the list; a page beyond the last is the last."""
    return get_page(*books(asked, shelf, recipes), asked.page, PAGE)[0]


def sample_of_each(rows: DataFrame, key: str, n: int = SHOWN, seed: int = 0) -> DataFrame:
    """At most n rows of each key, chosen by a random place. Spark keeps n rows a task before it deals them out."""
    place = Window.partitionBy(key).orderBy(shuffled(F.col("id"), seed), "id")
    return rows.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= n).drop("_r")


def sample(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows of all, chosen by a random place."""
    return rows.orderBy(shuffled(F.col("id"), seed), "id").limit(n)


def sample_without_recipes(shelf: DataFrame, recipes: DataFrame, asked: str | None, seed: int = 0) -> DataFrame:
    """As many books without recipes as asked for: 1 to 1000, or 10 where that is no number."""
    n = shelf.sparkSession.range(1).select(clamped(F.lit(asked).cast("string"), 1, 1000, 10)).first()[0]
    without = shelf.join(recipes.select(F.col("book_id").alias("id")), "id", "left_anti")
    return sample(without, n, seed)


def token_total(texts: DataFrame, n: int = COUNTED, seed: int = 0) -> DataFrame:
    """(total, average) of the tokens of a sample of texts (id, tokens); the average is over n even where there are fewer."""
    return sample(texts, n, seed).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total")).withColumn("average", F.col("total") / n)


def first_in_order(recipes: DataFrame) -> DataFrame:
    """(book_id, id) of the first recipe of each book."""
    return recipes.groupBy("book_id").agg(F.min_by("id", F.struct("ord", "id")).alias("id"))


def recent_reports(reports: DataFrame, shelf: DataFrame, n: int = 100) -> DataFrame:
    """The n reports completed last with their book's title, and how many errors each has; open ones come first."""
    titled = reports.join(shelf.select(F.col("id").alias("book_id"), "title"), "book_id")
    return titled.withColumn("n_errors", F.coalesce(F.size("errors"), F.lit(0))).orderBy(F.desc_nulls_first("completed_at"), "id").limit(n)


def unstarted(reports: DataFrame) -> DataFrame:
    """(book_id, report_id): the first report of each book that has not been started."""
    return reports.where(F.col("started_at").isNull()).groupBy("book_id").agg(F.min("id").alias("report_id"))


def recost_totals(reports: DataFrame) -> DataFrame:
    """(reports, old_cost, new_cost, difference) over all reports that are priced anew."""
    sums = recosted(reports).agg(F.count("*").alias("reports"), F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("decimal(28,6)").alias("old_cost"), F.coalesce(F.sum("new_cost"), F.lit(0)).cast("decimal(28,6)").alias("new_cost"))
    return sums.withColumn("difference", F.col("new_cost") - F.col("old_cost"))


def models_of(steps: DataFrame) -> DataFrame:
    """(provider, models): the models of each provider once each, in order."""
    return steps.where(F.coalesce("model", F.lit("")) != "").groupBy("provider").agg(F.array_sort(F.collect_set("model")).alias("models"))


def configured(settings: DataFrame) -> DataFrame:
    """(configured): whether there is a row of settings (provider, api_key) with both filled in."""
    return settings.agg(F.coalesce(F.bool_or((F.length("provider") > 0) & (F.length("api_key") > 0)), F.lit(False)).alias("configured"))


def transfer(described: DataFrame, named_keywords: DataFrame) -> DataFrame:
    """(id, data): each recipe as one struct, with its keywords' names in order and its book's title and author."""
    names = named_keywords.groupBy(F.col("recipe_id").alias("id")).agg(F.array_sort(F.collect_list("keyword")).alias("keywords"))
    joined = described.join(names, "id", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    fields = {"name": "name", "recipeIngredients": "ingredients", "recipeInstructions": "instructions", "image": "image", "keywords": "keywords", "author": "author", "bookTitle": "title", "bookOrder": "ord"}
    return joined.select("id", F.struct(*[F.col(c).alias(name) for name, c in fields.items()]).alias("data"))


def dates(moment: Column) -> dict[str, Column]:
    """The three ways in which dates are shown."""
    return {"year": F.date_format(moment, "yyyy"), "minute": F.date_format(moment, "yyyy-MM-dd HH:mm"), "day": F.date_format(moment, "MMM dd, yyyy")}


def output_tokens(total: Column, prompt: Column) -> Column:
    return total - prompt


def kept_search(ranked: DataFrame, prompt: str, key: str, limit: int = FOUND) -> DataFrame:
    """(search_key, query, recipe_id, rank): the result of a vector search (recipe_id, rank) as it is kept under a key."""
    if not prompt.strip():
        raise ValueError("a search needs a prompt")
    return ranked.where(F.col("rank") <= limit).select(F.lit(key).alias("search_key"), F.lit(prompt.strip()).alias("query"), "recipe_id", "rank")


def fetched_search(kept: DataFrame, key: str) -> DataFrame:
    """(recipe_id, rank) of a kept search; no rows for a key that is not known."""
    return kept.where(F.col("search_key") == key).select("recipe_id", "rank")
