"""Session helpers: where lineage is cut, and how a bounded training sample is taken."""

from __future__ import annotations

import gc
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Training rows of a fold have a remainder other than 0.
FOLDS = 5


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared folder of spark.checkpoint.dir, so that a lost executor costs no earlier stage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            local = sc.master.startswith("local")
            folder = "/tmp/checkpoints" if local else df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results have been written by cut(). Spark does so once the
    driver has collected the objects of a step as garbage, which may else be long after. (It deletes the files of cut()
    likewise, but only under spark.cleaner.referenceTracking.cleanCheckpoints.)"""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors of a session once, so that their Python workers can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        package = Path(__file__).resolve().parents[1]
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model here learns labels from; a null doc_id counts as held out."""
    return F.coalesce(fold(doc_id) == 0, F.lit(True))


def bounded_sample(docs: DataFrame, labelled: DataFrame, label: str, per_label: int) -> DataFrame:
    """Texts of at most per_label rows of each label value, as (doc_id, text, label), chosen by a hash of doc_id.

    labelled: (doc_id, <label>). An id that has several rows counts once, with its smallest label and text. The count of each value gives the share of ids to keep before the exact cut, so
    the rows that meet in one window task stay near per_label however large the corpus is.
    """
    usable = labelled.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = usable.groupBy(label).agg(F.count("*").alias("_n"))
    point = (F.xxhash64(F.col("doc_id"), F.lit("sample")) % 1_000_000_000 + 999_999_999) / 1_999_999_999
    # one row for each label value; broadcast, so that the rows aren't dealt out by label before most of them are gone
    likely = usable.join(F.broadcast(sizes), label).withColumn("_p", point).where(F.col("_p") <= F.lit(1.3 * per_label + 60) / F.col("_n"))
    likely = likely.groupBy("doc_id").agg(F.min(label).alias(label), F.min("_p").alias("_p"))
    order = Window.partitionBy(label).orderBy("_p", "doc_id")
    chosen = likely.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_label).select("doc_id", label)
    # a row of the sample is two numbers: at most per_label of them for each label value, so this side is safe to broadcast
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", label).agg(F.min("text").alias("text")).select("doc_id", "text", label)
