"""Previous and next rows within a book, a list or a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import neighbours


def in_book(recipes: DataFrame, book: str = "book_id", order: str = "ord", id_: str = "id") -> DataFrame:
    """Adds previous_id and next_id: of the rows of the book with a strictly smaller (greater) order the nearest; rows
    of equal order pass each other over, and among several nearest the one with the smallest id is taken. The places of
    a book are ranked, one row for each order, and joined back."""
    places = recipes.where(F.col(order).isNotNull()).groupBy(book, order).agg(F.min(id_).alias("_first"))
    by_place = Window.partitionBy(book).orderBy(order)
    places = places.withColumn("next_id", F.lead("_first").over(by_place)).withColumn("previous_id", F.lag("_first").over(by_place))
    return recipes.join(places.drop("_first"), [book, order], "left").select(*recipes.columns, "next_id", "previous_id")


def in_sequence(rows: DataFrame, partition: str, order: list[str], id_: str) -> DataFrame:
    """Adds previous_id and next_id by position within each partition, such as a list, of any length."""
    return neighbours(rows, partition, order, id_)


def in_ranked(ids: DataFrame) -> DataFrame:
    """(recipe_id, position, previous_id, next_id) of one array of ranked ids, read off the array itself."""
    at = ids.select("ids", F.posexplode("ids").alias("position", "recipe_id"))
    return at.select("recipe_id", "position", F.get("ids", F.col("position") - 1).alias("previous_id"), F.get("ids", F.col("position") + 1).alias("next_id"))


def in_ranked_rows(rows: DataFrame, chunk: list[str], order: list[str], id_: str) -> DataFrame:
    """(recipe_id, position, previous_id, next_id) of ranked rows, for whole tables. chunk: columns without nulls that sort
    the rows as order does, though coarser; ranks are taken within chunks and carried by their totals, one row a chunk."""
    earlier = Window.orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*chunk).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    ranked = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*chunk).orderBy(*order)) - 1).join(totals, chunk)
    ranked = ranked.select(F.col(id_).alias("recipe_id"), (F.col("_before") + F.col("_place")).alias("position"))
    beside = lambda step, name: ranked.select((F.col("position") + step).alias("position"), F.col("recipe_id").alias(name))
    return ranked.join(beside(1, "previous_id"), "position", "left").join(beside(-1, "next_id"), "position", "left").select("recipe_id", "position", "previous_id", "next_id")
