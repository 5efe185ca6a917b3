"""Places within groups of any size: no task holds a group.

Rows are sorted into partitions by group and order and written to the shared folder of spark.checkpoint.dir, so that
partitions stay as they are. A row's place is its place in the partition's part of its group plus what earlier partitions
hold of the group; that takes one number for each partition and group, not the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.folders import shared_folder

#: More counts than this are joined by a shuffle instead of a broadcast.
FEW = 1 << 18


def checkpointed(rows: DataFrame) -> DataFrame:
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds each row's place from 1 within its group (a null group is one too), in an order of columns; rows equal in all
    of them stand in any order."""
    group_key = F.struct(F.col(group).isNull().alias("_n"), F.col(group).alias("_v"))
    placed = checkpointed(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order))
    # the lower 33 bits of this id are the row's place in its partition
    placed = placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).withColumn("_group", group_key)
    counts = placed.groupBy("_group", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("_group").alias("_g"), F.col("_part").alias("_p"), (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_before"))
    few = counts.limit(FEW + 1).count() <= FEW
    met = placed.join(counts.hint("broadcast" if few else "merge"), F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return met.select(*rows.columns, (F.col("_at") + F.col("_before") + 1).alias(name))


def neighbours(rows: DataFrame, group: str, order: list[str], id_: str) -> DataFrame:
    """Adds previous_id and next_id within each group."""
    placed = ranked(rows, group, order, "_place")
    beside = lambda step, name: placed.select(F.col(group).alias("_g"), (F.col("_place") + step).alias("_p"), F.col(id_).alias(name))
    out = placed
    for step, name in ((1, "previous_id"), (-1, "next_id")):
        out = out.join(beside(step, name), (F.col("_place") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g", "_p")
    return out.drop("_place")
