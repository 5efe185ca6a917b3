"""Changes to tables as functions from the old rows and a change to the new rows; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a task that groups them by key, about, and the share of keys by which they are counted beforehand.
TASK_ROWS, SHARE = 500_000, 64
#: Types that JSON has too.
PLAIN = ("string", "boolean", "byte", "short", "integer", "long", "float", "double", "array", "struct", "map")


def last_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of rows with the same key the one that comes last."""
    window = Window.partitionBy(*key).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_place", F.row_number().over(window)).where("_place = 1").drop("_place")


def first_wins(rows: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    window = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(window)).where("_place = 1").drop("_place")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those with their key; new has each key once."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"), allowMissingColumns=True)


def upsert_counts(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(created, updated): how many rows of new have no (a) row of old with their key."""
    known = old.select(*key).distinct().withColumn("_known", F.lit(True))
    return new.join(known, key, "left").agg(F.count_if(F.col("_known").isNull()).alias("created"), F.count_if("_known").alias("updated"))


def append_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """get_or_create: old with the rows of new whose key it lacks, each once."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"), allowMissingColumns=True)


def delete(rows: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Also a cascade: dependent rows without those whose parent is in keys."""
    return rows.join(keys.select(*key), key, "left_anti")


def replace_links(links: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """The links of every owner in new are those of new alone, each once."""
    return links.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new.dropDuplicates())


def set_null(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """column without references to rows that are deleted."""
    gone = keys.select(F.col(keys.columns[0]).alias("_gone")).distinct()
    return rows.join(gone, rows[column] == gone["_gone"], "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone")


def ordered(rows: DataFrame, column: str = "ord") -> DataFrame:
    """Rows whose place is not known stand at 0."""
    return rows.withColumn(column, F.coalesce(column, F.lit(0)))


def images_of(recipes: DataFrame, book) -> DataFrame:
    """(cleared): how many rows clear_images changes or rewrites, as a bulk update counts them."""
    return recipes.where(F.col("book_id") == book).agg(F.count("*").alias("cleared"))


def clear_images(recipes: DataFrame, book) -> DataFrame:
    return recipes.withColumn("image", F.when(F.col("book_id") == book, "").otherwise(F.col("image")))


def toggle(items: DataFrame, pair: DataFrame) -> DataFrame:
    """List membership (list_id, recipe_id): those in pair leave if they are in and join if they are not. Both may hold a
    row more than once, the result has each once; a row with a null is like no other.

    One aggregation over both, in as many tasks as the rows ask for: by themselves tasks would be as few as the cores."""
    key = ["list_id", "recipe_id"]
    both = items.select(*key, F.lit(1).alias("_side")).unionByName(pair.select(*key, F.lit(2).alias("_side")))
    alone = F.when(F.col("list_id").isNull() | F.col("recipe_id").isNull(), F.col("_side")).alias("_alone")
    sides = both.repartition(_tasks(both, key), *key).groupBy(*key, alone).agg(F.bit_or("_side").alias("_sides"))
    return sides.where("_sides < 3").select(*key)


def _tasks(rows: DataFrame, key: list[str]) -> int:
    """Tasks among which rows may be dealt by key; how many rows there are is guessed from one key in SHARE."""
    some = rows.where(F.pmod(F.xxhash64(*key), F.lit(SHARE)) == 0).count()
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-some * SHARE // TASK_ROWS))


def append_once(values: Column, value: Column) -> Column:
    return F.when(F.array_contains(values, value), values).otherwise(F.array_append(values, value))


def set_once(table: DataFrame, defaults: DataFrame) -> DataFrame:
    """A table of one row: the row it has, or the defaults."""
    return table.limit(1).union(defaults.limit(1)).limit(1)


def report_document(row: DataFrame, key: str = "id") -> DataFrame:
    """(key, json) of each row as an object; what JSON has no type for is written as text."""
    plain = [F.col(f.name) if f.dataType.typeName() in PLAIN else F.col(f.name).cast("string").alias(f.name) for f in row.schema]
    return row.select(F.col(key), F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias("json"))


def document(rows: DataFrame, order: list[Column]) -> DataFrame:
    """One JSON text of each book's rows (book_id, ...) as an array in order."""
    fields = [c for c in rows.columns if c != "book_id"]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("_by"), F.struct(*fields).alias("row")))), lambda x: x["row"])
    return rows.groupBy("book_id").agg(F.to_json(ordered).alias("json"))


def output_path(root: Column, book: Column, name: str) -> Column:
    """Where a book's files go: a folder of its own below the root, under fixed names."""
    return F.concat_ws("/", root, book.cast("string"), F.lit("_output"), F.lit(name))
