"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the warehouse; under a local master without the setting, a temporary folder."""
    local = tempfile.gettempdir() if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
    return spark.conf.get("spark.checkpoint.dir", None) or local


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below it."""
    return f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex}"
