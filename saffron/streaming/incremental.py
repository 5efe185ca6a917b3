"""Incremental work with Structured Streaming: each run takes what has arrived since the last one and then ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vectors import missing
from .buckets import BucketTable, Fold


def stream_into(arriving: DataFrame | Fold, path: str, key: list[str], order: list[str], checkpoint: str) -> None:
    """Upserts what has arrived into the bucketed table at path, or folds it into the table's rows, batch by batch, and ends.
    The table's own version file knows the batches it holds, so a batch that comes again is passed over and another driver
    goes on where one stopped. order: which row of a key counts; a fold has its own."""
    events = arriving.events if isinstance(arriving, Fold) else arriving

    def merge(batch: DataFrame, number: int) -> None:
        kept = BucketTable(batch.sparkSession, path, key)
        kept.fold(batch, arriving, batch=number) if isinstance(arriving, Fold) else kept.upsert(batch, order=order, batch=number)

    # timers on the clock would ask for a batch without data after each batch, and the run would never end
    setting, spark = "spark.sql.streaming.noDataMicroBatches.enabled", events.sparkSession
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        stream = events.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, before)
    stream.awaitTermination()


def backfill(recipes: DataFrame, embeddings: DataFrame, embed, text) -> DataFrame:
    """embeddings with vectors for the recipes that had none; text is the column that is embedded."""
    from ..sources.completion import embedded

    todo = missing(recipes, embeddings).select(F.col("id").alias("recipe_id"), text.alias("text"))
    return embeddings.unionByName(embedded(todo, embed))


def windowed_counts(spark: SparkSession, folder: str, schema, minutes: int = 60, late_minutes: int = 10, name: str = "*.parquet") -> DataFrame:
    """Events of a folder's files counted in tumbling windows by type, late ones within a watermark; an extension."""
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", f"{late_minutes} minutes").groupBy(F.window("ts", f"{minutes} minutes"), "event_type").count()
