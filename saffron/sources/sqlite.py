"""SQLite files as a Spark data source: `spark.read.format("sqlite")`, read in ranges of row ids by several tasks.

Options: `path` is a database or a folder of them, which driver and executors see alike; `shipped` instead is the name of
a file that SparkContext.addFile has sent to every executor (for a path that only Spark's file systems reach). `dbtable` is
the table, `rows` about how many rows a task reads, or more where that would make over TASKS tasks. Filters on columns are checked by SQLite itself, those on the row id or
on an indexed column in the choice of the ranges too, so that they read little more than their rows; a filter on `library`
leaves other databases unread. A table without row ids is one range.

Ranges are chosen by seeks, never by a scan. From some points of the row ids the next few rows are read, which tells how
densely ids lie; where they lie in clusters, each part is looked at alone. Short ranges, also of several databases, share
a task. So neither gaps between ids nor many small databases make tasks that read next to nothing.

Columns get the type of their declaration: whole numbers, fractions, bytes, or text for all others. A value that is no
number in a column of numbers reads as null. `library`, the file's name without its ending, comes before the table's own
columns, so that ids of several databases don't meet. The files must not change while they are read.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

ROWS = 100_000
BATCH = 8192
#: Points from which the density of row ids is measured, the rows read from each, and the parts of a range that is no even one.
PROBES, PROBE_ROWS, PARTS = 16, 32, 16
#: About how many tasks a table has at most; larger ones read more rows in each.
TASKS = 1024
ENDINGS = (".db", ".sqlite", ".sqlite3")


def local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith(("file:", "/")) else path


def files(options) -> list[str]:
    if "shipped" in options:
        return [SparkFiles.get(options["shipped"])]
    path = Path(local(options["path"]))
    if not path.exists():
        raise FileNotFoundError(f"no database at {path}")
    return sorted(str(p) for p in path.iterdir() if p.suffix in ENDINGS) if path.is_dir() else [str(path)]


def opened(path: str):
    return closing(sqlite3.connect(f"file:{quote(path)}?mode=ro&immutable=1", uri=True))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def type_of(declared: str) -> T.DataType:
    kind = declared.upper()
    if "INT" in kind or "BOOL" in kind:
        return T.LongType()
    if any(x in kind for x in ("REAL", "FLOA", "DOUB")):
        return T.DoubleType()
    return T.BinaryType() if "BLOB" in kind else T.StringType()


@dataclass(frozen=True)
class Range:
    """Row ids from first to last of a database's table, all rows if there are none, and about how many rows that is."""

    path: str
    first: int | None
    last: int | None
    rows: int


@dataclass(frozen=True)
class Task(ds.InputPartition):
    ranges: tuple[Range, ...]


def ends(db, table: str, where: str = "", values=()) -> tuple[int | None, int | None]:
    """The first and the last row id. One question for each, as SQLite answers both at once by a scan only."""
    return tuple((db.execute(f"SELECT rowid FROM {table}{where} ORDER BY rowid {way} LIMIT 1", values).fetchone() or (None,))[0] for way in ("ASC", "DESC"))


def density(db, table: str, first: int, last: int) -> float:
    """Rows for each row id of a range whose ends are rows."""
    rows, ids = 0, 0
    for i in range(PROBES):
        at = first + (last - first) * i // PROBES
        n, end = db.execute(f"SELECT count(*), max(rowid) FROM (SELECT rowid FROM {table} WHERE rowid >= ? AND rowid <= ? ORDER BY rowid LIMIT {PROBE_ROWS})", (at, last)).fetchone()
        rows, ids = rows + n, ids + end - at + 1
    return rows / ids


def ranges(db, path: str, table: str, first: int, last: int, rows: int) -> list[Range]:
    """Ranges of about `rows` rows that hold all rows from first to last, which are rows themselves."""
    if last - first < rows:
        return [Range(path, first, last, last - first + 1)]
    width = -(-(last - first + 1) // PARTS)
    parts = [(at, min(at + width - 1, last)) for at in range(first, last + 1, width)]
    tight = [ends(db, table, " WHERE rowid BETWEEN ? AND ?", part) for part in parts]
    if all(lo is not None and 2 * (hi - lo + 1) > part[1] - part[0] + 1 for (lo, hi), part in zip(tight, parts, strict=True)):
        share = density(db, table, first, last)
        step = max(1, round(rows / share))
        return [Range(path, at, min(at + step - 1, last), max(1, round(share * min(step, last - at + 1)))) for at in range(first, last + 1, step)]
    return [r for lo, hi in tight if lo is not None for r in ranges(db, path, table, lo, hi, rows)]


def tasks(found: list[Range], rows: int) -> list[Task]:
    """Neighbouring ranges of no more than `rows` rows together."""
    out, n = [], 0
    for r in found:
        if not out or n + r.rows > rows:
            out.append([])
            n = 0
        out[-1].append(r)
        n += r.rows
    return [Task(tuple(x)) for x in out]


def sought(db, table: str) -> set[str]:
    """The columns by which SQLite finds rows without a scan: the row id's own name and the first one of each index."""
    keys = [c for c in db.execute(f"PRAGMA table_info({table})") if c[5]]
    names = {c[1] for c in keys if len(keys) == 1 and c[2].upper() == "INTEGER"}
    for index in db.execute(f"PRAGMA index_list({table})").fetchall():
        if not index[4]:  # not a partial one
            names |= {c[2] for c in db.execute(f"PRAGMA index_info({quoted(index[1])})").fetchall() if c[0] == 0 and c[2]}
    return names


class Reader(ds.DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.options, self.schema = dict(options), schema
        self.table, self.rows = options["dbtable"], int(options.get("rows", ROWS))
        self.tests: list[tuple[str, str, list]] = []
        self.libraries: set[str] | None = None

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            if not self._push(f):
                yield f

    def _push(self, f: ds.Filter) -> bool:
        """Takes over a comparison with a number or a text that SQLite and Spark decide alike."""
        signs = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}
        if len(f.attribute if hasattr(f, "attribute") else ()) != 1:
            return False
        if f.attribute[0] == "library":
            named = {f.value} if isinstance(f, ds.EqualTo) else set(f.value) if isinstance(f, ds.In) else None
            if named is not None:
                self.libraries = named if self.libraries is None else self.libraries & named
            return named is not None
        column, kind = quoted(f.attribute[0]), self.schema[f.attribute[0]].dataType
        usual = int if isinstance(kind, T.LongType) else str if isinstance(kind, T.StringType) else None
        if type(f) in signs and usual and type(f.value) is usual and (usual is int or signs[type(f)] == "="):
            self._add(f"{column} {signs[type(f)]} ?", [f.value], usual, column)
        elif isinstance(f, ds.In) and usual and 0 < len(f.value) <= 500 and all(type(v) is usual for v in f.value):
            self._add(f"{column} IN ({', '.join('?' * len(f.value))})", f.value, usual, column)
        elif isinstance(f, ds.IsNotNull) and usual is str:
            self._add(f"{column} IS NOT NULL", [], None, column)
        else:
            return False
        return True

    def _add(self, test: str, values, usual, column: str) -> None:
        # a text in a column of numbers reads as null, so it must not be compared as greater than every number
        self.tests.append((column, f"{test} AND typeof({column}) IN ('integer', 'real')" if usual is int else test, list(values)))

    def condition(self, *more: str, columns: set[str] | None = None) -> tuple[str, list]:
        """The WHERE clause of the filters, on some columns only if they are given, and its values."""
        tests = [t for t in self.tests if columns is None or t[0] in columns]
        where = [*(test for _, test, _ in tests), *more]
        return " WHERE " + " AND ".join(where) if where else "", [v for _, _, values in tests for v in values]

    def partitions(self) -> list[Task]:
        out, table = [], quoted(self.table)
        for path in files(self.options):
            if self.libraries is not None and Path(path).stem not in self.libraries:
                continue
            with opened(path) as db:
                try:
                    first, last = ends(db, table, *self.condition(columns={quoted(c) for c in sought(db, table)}))
                except sqlite3.OperationalError as e:
                    if "rowid" not in str(e):
                        raise
                    out.append(Range(path, None, None, self.rows))
                    continue
                if first is not None:
                    out += ranges(db, path, table, first, last, self.rows)
        # ranges stay as they are, more of them share a task
        return tasks(out, max(self.rows, -(-sum(r.rows for r in out) // TASKS))) or [Task(())]

    def read(self, task: Task) -> Iterator[pa.RecordBatch]:
        fields = [(f.name, f.dataType) for f in self.schema]
        columns = ", ".join(quoted(n) for n, _ in fields if n != "library") or "NULL"
        for part in task.ranges:
            where, values = self.condition(*([] if part.first is None else ["rowid BETWEEN ? AND ?"]))
            with opened(part.path) as db:
                cursor = db.execute(f"SELECT {columns} FROM {quoted(self.table)}{where}", [*values, *([] if part.first is None else (part.first, part.last))])
                while rows := cursor.fetchmany(BATCH):
                    own = iter(zip(*rows, strict=True))
                    arrays = [pa.array([Path(part.path).stem] * len(rows)) if n == "library" else _array(next(own), kind) for n, kind in fields]
                    yield pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])


def _array(values: tuple, kind: T.DataType) -> pa.Array:
    if isinstance(kind, T.LongType):
        return pa.array([int(v) if isinstance(v, (int, float)) else None for v in values], pa.int64())
    if isinstance(kind, T.DoubleType):
        return pa.array([float(v) if isinstance(v, (int, float)) else None for v in values], pa.float64())
    if isinstance(kind, T.BinaryType):
        return pa.array([v.encode() if isinstance(v, str) else v if v is None or isinstance(v, bytes) else str(v).encode() for v in values], pa.binary())
    return pa.array([v.decode("utf-8", "replace") if isinstance(v, bytes) else v if v is None else str(v) for v in values], pa.string())


class SqliteSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        for path in files(self.options):
            with opened(path) as db:
                columns = db.execute(f"PRAGMA table_info({quoted(self.options['dbtable'])})").fetchall()
            if columns:
                return T.StructType([T.StructField("library", T.StringType()), *[T.StructField(c[1], type_of(c[2])) for c in columns]])
        raise ValueError(f"no table {self.options['dbtable']}")

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
