"""Counts, dashboards, costs and facets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dollars for a million tokens in and out.
PRICES = {"gemini-2.5-flash": (0.30, 2.50), "gemini-2.5-flash-lite": (0.10, 0.40), "gemini-2.0-flash-lite": (0.075, 0.30)}


def counted(parents: DataFrame, children: DataFrame, key: str, name: str = "n") -> DataFrame:
    """parents (id, ...) with the number of children (key, ...), 0 where there are none; counted before the join."""
    counts = children.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))
    return parents.join(counts, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def has_image(image: Column) -> Column:
    return image.isNotNull() & (image != "")


def image_counts(reports: DataFrame, recipes: DataFrame) -> DataFrame:
    """reports (id, book_id, ...) with the recipes and the recipes with an image of their book; so the reports of one
    book show the same numbers."""
    per_book = recipes.groupBy("book_id").agg(F.count("*").alias("recipe_count"), F.count_if(has_image(F.col("image"))).alias("image_count"))
    return reports.join(per_book, "book_id", "left").fillna(0, ["recipe_count", "image_count"])


def recent_costs(reports: DataFrame, as_of: datetime, days: int = 14) -> DataFrame:
    """(reports, total_cost): what reports (created_at, cost_usd) since `days` before as_of cost, to the cent; 0 for none."""
    recent = F.col("created_at") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    cost = F.coalesce(F.sum("cost_usd"), F.lit(0).cast("decimal(10,6)"))
    return reports.where(recent & F.col("cost_usd").isNotNull()).agg(F.count("*").alias("reports"), F.round(cost, 2).cast("decimal(18,2)").alias("total_cost"))


def summary(books: DataFrame, recipes: DataFrame) -> DataFrame:
    """(books, recipes, processed_books): how many there are, and of how many books there are recipes."""
    processed = recipes.select("book_id").distinct().agg(F.count("*").alias("processed_books"))
    return books.agg(F.count("*").alias("books")).join(recipes.agg(F.count("*").alias("recipes"))).join(processed)


def token_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars at the model's own price; null for a model without one."""
    price = F.lit(None).cast("decimal(28,10)")
    for name, (rate_in, rate_out) in PRICES.items():
        price = F.when(model == name, flat_cost(tokens_in, tokens_out, rate_in, rate_out)).otherwise(price)
    return price


def flat_cost(tokens_in: Column, tokens_out: Column, rate_in: float = 0.30, rate_out: float = 2.50) -> Column:
    rate = lambda tokens, r: tokens.cast("decimal(18,0)") * F.lit(str(r)).cast("decimal(6,3)")
    return ((rate(tokens_in, rate_in) + rate(tokens_out, rate_out)) / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(28,10)")


def recosted(reports: DataFrame, model: str = "gemini-2.5-flash") -> DataFrame:
    """reports whose model is `model` or holds 2.5-flash, with tokens, at the flat price: adds new_cost and difference."""
    known = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    chosen = reports.where(((F.col("model_name") == model) | F.contains("model_name", F.lit("2.5-flash"))) & known)
    new = chosen.withColumn("new_cost", flat_cost(F.col("input_tokens"), F.col("output_tokens")))
    return new.withColumn("difference", F.col("new_cost") - F.coalesce("cost_usd", F.lit(0)))


def usage(steps: DataFrame) -> DataFrame:
    """Cost and tokens of each report summed exactly over its steps, the cost rounded to 4 places at the end."""
    sums = steps.groupBy("report_id").agg(F.sum("cost_usd").alias("cost"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return sums.withColumn("cost_usd", F.bround(F.coalesce("cost", F.lit(0)), 4)).drop("cost")


def facet(rows: DataFrame, column: str) -> DataFrame:
    """The values of a column, each once, in order."""
    return rows.select(column).distinct().orderBy(column)


def any_rows(**tables: DataFrame) -> DataFrame:
    """One row that tells of each table whether it has any; a row at most is read of each."""
    flags = [rows.limit(1).select(F.lit(name).alias("name")) for name, rows in tables.items()]
    found = flags[0]
    for more in flags[1:]:
        found = found.union(more)
    return found.agg(*[F.coalesce(F.bool_or(F.col("name") == name), F.lit(False)).alias(name) for name in tables])


def matches_all_terms(fields: list[Column], query: str) -> Column:
    """Every word of the query is in some field: the admin search over several columns."""
    test = F.lit(True)
    for term in query.split():
        some = F.lit(False)
        for field in fields:
            some = some | F.coalesce(F.contains(F.lower(field), F.lower(F.lit(term))), F.lit(False))
        test = test & some
    return test


def drill_down(rows: DataFrame, column: str, unit: str) -> DataFrame:
    """(period, n): how many rows fall into each year, month or day."""
    return rows.groupBy(F.date_trunc(unit, F.col(column)).alias("period")).agg(F.count("*").alias("n"))
