"""A library's database: books of a tag and a format with their authors, identifiers and comments."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import date_of, timestamp_of
from . import sqlite

#: The tables of a library's database.
TABLES = ("books", "identifiers", "data", "authors", "books_authors_link", "comments", "books_tags_link", "tags")


def read(spark: SparkSession, path: str, rows: int = sqlite.ROWS) -> dict[str, DataFrame]:
    """The tables of a library's database, or of a folder of them; each has the library's name in a column of its own.
    A path of a file system that only Spark reaches is sent to the executors first, which takes one database."""
    sqlite.register(spark)
    if re.match("[a-z][a-z0-9+.-]*:", path) and not path.startswith("file:"):
        spark.sparkContext.addFile(path)
        where = {"shipped": path.rstrip("/").rpartition("/")[2]}
    else:
        where = {"path": path}
    return {t: spark.read.format("sqlite").options(dbtable=t, rows=rows, **where).load() for t in TABLES}


def books(tables: dict[str, DataFrame], tag: str = "Food", format_: str | None = "EPUB") -> DataFrame:
    """One row for each book that has the tag and the format: (calibre_id, title, path, pubdate, calibre_added_at, isbn,
    epub_name, author, description). Of several identifiers or files the smallest value counts; authors are joined by
    ' & ' in order of name. Each detail is gathered before it is joined. Without a format, books of any or none."""
    t = tables
    in_library = ["library"] if "library" in t["books"].columns else []
    book = [*in_library, "book"]
    tagged = t["books_tags_link"].join(t["tags"].where(F.col("name") == tag).select(*in_library, F.col("id").alias("tag")), [*in_library, "tag"]).select(*book)
    files = t["data"].where(F.col("format") == (format_ or "EPUB")).groupBy(*book).agg(F.min("name").alias("epub_name"))
    isbn = t["identifiers"].where("type = 'isbn'").groupBy(*book).agg(F.min("val").alias("isbn"))
    names = t["books_authors_link"].join(t["authors"].select(*in_library, F.col("id").alias("author"), "name"), [*in_library, "author"])
    authors = names.groupBy(*book).agg(F.array_join(F.array_sort(F.collect_list("name")), " & ").alias("author"))
    comments = t["comments"].groupBy(*book).agg(F.min("text").alias("description"))
    out = t["books"].withColumnRenamed("id", "book").join(tagged, book, "left_semi").join(files, book, "inner" if format_ else "left")
    for detail in (isbn, authors, comments):
        out = out.join(detail, book, "left")
    return out.select(
        *in_library, F.col("book").alias("calibre_id"), "title", "path", date_of(F.col("pubdate")).alias("pubdate"), timestamp_of(F.col("timestamp")).alias("calibre_added_at"),
        F.coalesce("isbn", F.lit("")).alias("isbn"), "epub_name", F.coalesce("author", F.lit("")).alias("author"), F.coalesce("description", F.lit("")).alias("description"),
    )


def book(tables: dict[str, DataFrame], calibre_id: int) -> DataFrame:
    """The same for a single book of a library, whatever its tag and formats; of several libraries, the book of each."""
    one = {name: rows.where(F.col("id" if name == "books" else "book") == calibre_id) if name in ("books", "identifiers", "data", "books_authors_link", "comments") else rows for name, rows in tables.items()}
    one["tags"] = one["books"].select(*[c for c in ("library",) if c in one["books"].columns], F.lit(0).alias("id"), F.lit("any").alias("name"))
    return books(one | {"books_tags_link": one["books"].withColumnsRenamed({"id": "book"}).withColumn("tag", F.lit(0))}, "any", None)
