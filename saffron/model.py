"""The catalogue's tables, and a catalogue made from star-schema tables.

books(id, title, author, created_at) · recipes(id, book_id, ord, name, description, ingredients, instructions, yields,
image, created_at) · keywords(id, name) · recipe_keywords(recipe_id, keyword_id) · lists(id, name) ·
list_items(id, list_id, recipe_id, created_at) · embeddings(recipe_id, embedding)
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from .plans.substring import SubstringIndex


@dataclass(frozen=True)
class Catalogue:
    books: DataFrame
    recipes: DataFrame
    keywords: DataFrame
    recipe_keywords: DataFrame
    lists: DataFrame
    list_items: DataFrame
    embeddings: DataFrame | None = None
    #: recipe_keywords in which a link may stand more than once; searches ask only whether one exists, so they read
    #: these and no shuffle makes them distinct.
    raw_links: DataFrame | None = None
    #: (list_id, recipe_id) of list_items, some perhaps more than once, for what makes them distinct by itself.
    raw_items: DataFrame | None = None
    #: A SubstringIndex of described() by which searches narrow what they read.
    substrings: SubstringIndex | None = None

    def described(self) -> DataFrame:
        """recipes with their book's title and author."""
        return self.recipes.join(self.books.select(F.col("id").alias("book_id"), "title", "author"), "book_id")

    def searched_keywords(self) -> DataFrame:
        """(recipe_id, related) of every link, some perhaps more than once."""
        links = self.recipe_keywords if self.raw_links is None else self.raw_links
        return links.join(self.keywords.select(F.col("id").alias("keyword_id"), F.col("name").alias("related")), "keyword_id").select("recipe_id", "related")

    def named_keywords(self) -> DataFrame:
        """(recipe_id, keyword) of every recipe's keywords."""
        return self.recipe_keywords.join(self.keywords.select(F.col("id").alias("keyword_id"), F.col("name").alias("keyword")), "keyword_id").select("recipe_id", "keyword")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_schema(spark: SparkSession, sf_dir: str) -> Catalogue:
    """customer as books (author: the nation), orders as recipes, part as keywords, supplier as lists, with lineitem
    giving the recipes' keywords and the lists' items."""
    read = lambda name: table(spark, sf_dir, name)
    lines = read("lineitem")
    books = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return Catalogue(
        books=books.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("n_name").alias("author")),
        recipes=read("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("book_id"),
            F.unix_date(F.col("o_orderdate").cast("date")).alias("ord"),
            F.concat_ws(" ", "o_orderpriority", "o_orderkey").alias("name"),
            F.split("o_orderpriority", "-").alias("ingredients"),
            F.array(F.col("o_orderstatus")).alias("instructions"),
            F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("img/"), F.col("o_orderkey").cast("string"), F.lit(".jpg"))).when(F.col("o_orderstatus") == "O", "").alias("image"),
            F.col("o_totalprice").alias("price"),
            F.col("o_orderdate").alias("created_at"),
        ),
        keywords=read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")),
        recipe_keywords=lines.select(F.col("l_orderkey").alias("recipe_id"), F.col("l_partkey").alias("keyword_id")).distinct(),
        lists=read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        list_items=lines.groupBy(F.col("l_suppkey").alias("list_id"), F.col("l_orderkey").alias("recipe_id")).agg(F.min("l_shipdate").alias("created_at")),
        raw_links=lines.select(F.col("l_orderkey").alias("recipe_id"), F.col("l_partkey").alias("keyword_id")),
        raw_items=lines.select(F.col("l_suppkey").alias("list_id"), F.col("l_orderkey").alias("recipe_id")),
        embeddings=read("embeddings").select(F.col("vec_id").alias("recipe_id"), "embedding"),
    )
