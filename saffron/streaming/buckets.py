"""A keyed table in hash buckets: an upsert rewrites only the buckets it touches, and a version is one small file.

    <path>/data/<version>/bucket=<b>/*.parquet     the buckets that a version wrote
    <path>/versions/<version>.json                 of every bucket, which version wrote it last; the schema; the batch

A change is read into the version after the current one; its file, written last and moved into place, makes it the
current version. So readers see a version whole or not at all, whoever stops in between: a change whose version file is
missing has not happened and its folder is written over. A stream's batch number is kept in the version file and a batch
that comes again is passed over. Any driver that opens the path goes on where the last one stopped; two writers at once
are not foreseen. The number of buckets is fixed when the table is made, as are its key columns.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import and_

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.book_files import store

BUCKETS = 64


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of rows with the same key the one that comes last in `order` (nulls first), summed up before rows are dealt out by
    key, so that a key with very many rows is no burden to one task."""
    rest = [c for c in rows.columns if c not in key]
    by = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])
    found = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), by).alias("_row"))
    return found.select(*[c if c in key else F.col("_row")[c].alias(c) for c in rows.columns])


@dataclass(frozen=True)
class Fold:
    """What a stream's events make of a table's rows. moved(now) is a function over Arrow batches of (key, _old, _came): a
    key's row or null and the list of its events in no order or null; it gives one row of the schema for each. due(now)
    tells which of the table's rows move without events too. now: a batch's time in milliseconds."""

    events: DataFrame
    schema: str
    moved: Callable[[int], Callable]
    due: Callable[[int], Column]


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.files, self.root = store(self.path)
        now = self.current()
        self.buckets = now["buckets"] if now else buckets
        if now and now["key"] != key:
            raise ValueError(f"the table's key is {now['key']}")

    def _versions(self) -> list[int]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/versions", allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))

    def current(self, version: int | None = None) -> dict | None:
        """The version file of a version, or of the last one; None for a table that does not exist yet."""
        known = self._versions()
        if not known:
            return None
        with self.files.open_input_stream(f"{self.root}/versions/{known[-1] if version is None else version}.json") as held:
            return json.loads(held.read())

    @cached_property
    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _read(self, state: dict, only: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(state["schema"])
        paths = [f"{self.path}/data/{v}/bucket={b}" for b, v in state["written"].items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, or of the last one."""
        state = self.current(version)
        if state is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return self._read(state)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, of which only the buckets are read."""
        state = self.current()
        touched = {r[0] for r in keys.select(self.bucket).distinct().collect()}  # at most as many as there are buckets
        return self._read(state, touched).join(keys.select(*self.key).distinct(), self.key, "left_semi")

    def upsert(self, rows: DataFrame, order: list[str] | None = None, batch: int | None = None, gone: Column | None = None) -> dict:
        """Puts rows in place of those with their key; of several with one key the last in `order` counts. Where `gone`
        holds the row of that key is removed instead. batch: the number of a stream's batch; one that is not greater than
        the last is passed over. Gives the new version's file, with the counts of created, updated and deleted rows."""
        state = self.current()
        if state and batch is not None and state["batch"] is not None and batch <= state["batch"]:
            return state
        new = latest(rows, self.key, order) if order else rows
        new = new.withColumn("_gone", F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)).withColumn("bucket", self.bucket)
        new = new.persist()  # read for its buckets and again to be merged; what is lost is made again
        try:
            touched = {r[0] for r in new.select("bucket").distinct().collect()}
            schema = T.StructType.fromJson(state["schema"]) if state else rows.schema
            old = self._read(state, touched) if state else self.spark.createDataFrame([], schema)
            old = old.withColumn("bucket", self.bucket)
            names = [f.name for f in schema]
            both = old.select(F.struct(*names).alias("_old"), *self.key, "bucket").join(new.select(F.struct(*names).alias("_new"), *self.key, "_gone", "bucket"), [*self.key, "bucket"], "full")
            both = both.withColumn("_kept", F.when(F.col("_new").isNull(), F.col("_old")).when(~F.col("_gone"), F.col("_new"))).persist()
            try:
                created, updated, deleted = both.agg(
                    F.count_if(F.col("_old").isNull() & F.col("_kept").isNotNull()), F.count_if(F.col("_old").isNotNull() & F.col("_new").isNotNull() & ~F.col("_gone")), F.count_if(F.col("_old").isNotNull() & F.col("_kept").isNull())
                ).first()
                version = self._write(both.where(F.col("_kept").isNotNull()).select("_kept.*", "bucket"), state, touched)
            finally:
                both.unpersist()
        finally:
            new.unpersist()
        return self._commit(version | {"batch": batch if batch is not None else state and state["batch"], "schema": schema.jsonValue(), "created": created, "updated": updated, "deleted": deleted})

    def fold(self, events: DataFrame, by: Fold, batch: int | None = None) -> dict:
        """Puts what a batch of events makes of the rows in their place; like upsert(), which buckets it touches and which
        batches it passes over. Rows of these buckets without events, and not due, stay outside Python. Nothing is kept in
        memory and nothing counted."""
        state, now = self.current(), int(time.time() * 1000)
        if state and batch is not None and state["batch"] is not None and batch <= state["batch"]:
            return state
        schema, due = T._parse_datatype_string(by.schema), by.due(now)
        touched = {r[0] for r in events.select(self.bucket).distinct().collect()}
        if state:
            touched |= {r[0] for r in self._read(state).where(due).select(self.bucket).distinct().collect()}
        old = self._read(state, touched) if state else self.spark.createDataFrame([], schema)
        old = old.select(F.struct(*schema.names).alias("_old"), F.coalesce(due, F.lit(False)).alias("_due"))
        came = events.groupBy(*self.key).agg(F.collect_list(F.struct(*[c for c in events.columns if c not in self.key])).alias("_came"))
        both = came.join(old, reduce(and_, (came[k].eqNullSafe(F.col("_old")[k]) for k in self.key)), "full")
        moves = F.col("_came").isNotNull() | F.col("_due")
        rows = both.where(moves).select(*[F.coalesce(came[k], F.col("_old")[k]).alias(k) for k in self.key], "_old", "_came").mapInArrow(by.moved(now), schema)
        if state:
            rows = rows.unionByName(both.where(~moves).select("_old.*"))
        version = self._write(rows.withColumn("bucket", self.bucket), state, touched)
        return self._commit(version | {"batch": batch if batch is not None else state and state["batch"], "schema": schema.jsonValue()})

    def _write(self, rows: DataFrame, state: dict | None, touched: set[int]) -> dict:
        """Writes all rows of the buckets touched; gives the new version's file but for what was counted."""
        number = (self._versions() or [0])[-1] + 1
        # a change that a driver left unfinished has the same number: its folder is written over
        rows.repartition(max(1, min(len(touched), self.buckets)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{number}")
        filled = {f.base_name.partition("=")[2] for f in self.files.get_file_info(fs.FileSelector(f"{self.root}/data/{number}")) if f.base_name.startswith("bucket=")}
        written = {b: v for b, v in (state["written"] if state else {}).items() if int(b) not in touched} | {b: number for b in filled}
        return {"version": number, "key": self.key, "buckets": self.buckets, "written": written, "touched": len(touched)}

    def _commit(self, state: dict) -> dict:
        self.files.create_dir(f"{self.root}/versions")
        beside = f"{self.root}/versions/.{uuid.uuid4().hex}"
        with self.files.open_output_stream(beside) as out:
            out.write(json.dumps(state).encode())
        self.files.move(beside, f"{self.root}/versions/{state['version']}.json")
        return state

    def vacuum(self, keep: int = 1) -> int:
        """Drops all versions but the last `keep` and what only they hold; gives the number of folders removed."""
        known = self._versions()
        stay = known[-keep:]
        used = {f"{v}/bucket={b}" for n in stay for b, v in self.current(n)["written"].items()}
        gone = 0
        for n in known[:-keep]:
            self.files.delete_file(f"{self.root}/versions/{n}.json")
        for version in self.files.get_file_info(fs.FileSelector(f"{self.root}/data", allow_not_found=True)):
            if not version.base_name.isdigit() or int(version.base_name) > known[-1]:
                continue
            for bucket in self.files.get_file_info(fs.FileSelector(version.path)):
                if bucket.base_name.startswith("bucket=") and f"{version.base_name}/{bucket.base_name}" not in used:
                    self.files.delete_dir(bucket.path)
                    gone += 1
        return gone
