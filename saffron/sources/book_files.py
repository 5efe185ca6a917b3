"""One JSON file for each book at its output path, as a Spark sink: `df.write.format("book_files")`.

A file is an array of the book's rows in their order (or, for `one` row a book, that row as an object), indented by 2,
with characters beyond ASCII as they are and with text for what JSON has no type for.

Rows are sorted into partitions by book and order, so a large book spreads over several tasks; each task streams its rows
into one file of a staging folder, its books' parts one after the other, with a list of their lengths beside it, and no book
is ever one cell. Commit is in two steps. First the write's own: either all tasks have staged their parts and a list of the
staging folders is written, or abort() removes what there is. Then publish() cuts the parts out and puts them in their
places in tasks of their own; the parts of a book that several tasks have written are joined, bytes after bytes, by the task
of the first. What the driver holds is one line a task, and what it removes at the end are two files and a folder a task.

Paths may be of any file system that Arrow knows by its scheme (file, hdfs, s3 and others).
"""

from __future__ import annotations

import io
import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.types as at
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A book's folder below its own, and its files.
FOLDER, RECIPES, REPORT = "_output", "recipes.json", "report.json"
STAGED = "_staged"
PARTS, LENGTHS = "parts", "lengths"
COPY = 1 << 20


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def target(root: str, book: str, name: str) -> str:
    return f"{root}/{book}/{FOLDER}/{name}"


def _value(kind: pa.DataType, pad: str) -> Callable[[object], str]:
    """How values of a type are written, their further lines after pad; JSON keeps line ends out of its strings."""
    quoted, whole = json.encoder.encode_basestring, json.JSONEncoder(indent=2, ensure_ascii=False, default=str).encode
    word = lambda x: "null" if x is None else quoted(x)
    if at.is_string(kind):
        return word
    if at.is_integer(kind):
        return lambda x: "null" if x is None else str(x)
    if at.is_list(kind) and at.is_string(kind.value_type):
        return lambda x: "null" if x is None else f"[\n{pad}  " + f",\n{pad}  ".join(map(word, x)) + f"\n{pad}]" if x != [] else "[]"
    return lambda x: whole(x).replace("\n", f"\n{pad}")


def texts(batch: pa.RecordBatch, fields: list[str], pad: str) -> Iterator[str]:
    """Each row as an object that is indented by 2 after pad, as json.dumps writes it, which takes one row at a time by Python
    code and some twenty times as long."""
    if not fields:
        return iter([f"{pad}{{}}"] * batch.num_rows)
    row = f"{pad}{{\n" + ",\n".join(f"{pad}  {json.dumps(c, ensure_ascii=False).replace('%', '%%')}: %s" for c in fields) + f"\n{pad}}}"
    columns = [batch.column(c) for c in fields]
    return (row % values for values in zip(*[map(_value(c.type, f"{pad}  "), c.to_pylist()) for c in columns], strict=True))


@dataclass
class Staged(ds.WriterCommitMessage):
    """What one task has written: its folder, and the books it begins and ends with."""

    folder: str
    place: int
    first: str | None
    last: str | None


class Writer(ds.DataSourceArrowWriter):
    """Takes rows of (_book, _place, fields ...), sorted by book and order; a row whose _place is null stands for a book
    that may have no rows."""

    def __init__(self, options, schema: T.StructType):
        self.root, self.job = options["path"].rstrip("/"), options["job"]
        self.one = options.get("one", "false") == "true"
        self.fields = [f.name for f in schema if f.name not in ("_book", "_place")]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        task = TaskContext.get()
        files, root = store(self.root)
        folder = f"{root}/{STAGED}/{self.job}/{task.partitionId()}-{task.attemptNumber()}"
        first, book, out, lengths, size = None, None, None, None, 0
        waiting, held = [], 0

        def ended() -> None:
            if book is not None:
                lengths.write(json.dumps([book, size]).encode() + b"\n")

        try:
            for batch in batches:
                books, placed = batch.column("_book").to_pylist(), batch.column("_place").is_valid().to_pylist()
                for name, has, text in zip(books, placed, texts(batch, self.fields, "" if self.one else "  "), strict=True):
                    if out is None:
                        files.create_dir(folder)
                        out, lengths = (files.open_output_stream(f"{folder}/{x}", buffer_size=COPY) for x in (PARTS, LENGTHS))
                    if name != book:
                        ended()
                        first, book, size = name if first is None else first, name, 0
                    if not has:
                        continue
                    # a part holds elements; the brackets and the commas between parts come when it is published
                    part = (text if size == 0 else f",\n{text}").encode()
                    waiting.append(part)
                    size, held = size + len(part), held + len(part)
                    if held >= COPY:
                        out.write(b"".join(waiting))
                        waiting, held = [], 0
            if out is not None:
                out.write(b"".join(waiting))
            ended()
        finally:
            for opened in (out, lengths):
                if opened is not None:
                    opened.close()
        return Staged(folder, task.partitionId(), first, book)

    def commit(self, messages: list[Staged | None]) -> None:
        files, root = store(self.root)
        files.create_dir(f"{root}/{STAGED}/{self.job}")
        lines = [json.dumps([m.folder, m.place, m.first, m.last]) for m in messages if m is not None and m.first is not None]
        with files.open_output_stream(f"{root}/{STAGED}/{self.job}/_list") as out:
            out.write("\n".join(lines).encode())

    def abort(self, messages: list[Staged | None]) -> None:
        files, root = store(self.root)
        files.delete_dir_contents(f"{root}/{STAGED}/{self.job}", missing_dir_ok=True)


class BookFiles(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "book_files"

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema)


def _lengths(files: fs.FileSystem, folder: str) -> Iterator[tuple[str, int]]:
    """(book, bytes) of the parts that a task has staged, in their order."""
    with files.open_input_stream(f"{folder}/{LENGTHS}", buffer_size=COPY) as held:
        for line in io.TextIOWrapper(held, "utf-8"):
            yield tuple(json.loads(line))


def _pieces(held, length: int) -> Iterator[bytes]:
    while length:
        piece = held.read(min(length, COPY))
        if not piece:
            raise EOFError("a staged part is cut short")
        length -= len(piece)
        yield piece


def _begun(files: fs.FileSystem, folder: str) -> Iterator[bytes]:
    """The first part that a task has staged."""
    with files.open_input_stream(f"{folder}/{PARTS}", buffer_size=COPY) as held:
        yield from _pieces(held, next(_lengths(files, folder))[1])


def _publish(root: str, name: str, one: bool):
    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(root)
        for batch in batches:
            n = 0
            for row in batch.to_pylist():
                aside = Aside(f"{row['folder']}/{uuid.uuid4().hex}", isinstance(files, fs.LocalFileSystem))
                files.create_dir(aside.folder)
                with files.open_input_stream(f"{row['folder']}/{PARTS}", buffer_size=COPY) as held:
                    for book, length in _lengths(files, row["folder"]):
                        own = _pieces(held, length)
                        if book == row["not_mine"]:
                            for _ in own:
                                pass
                            continue
                        more = row["more"] if book == row["last"] else []
                        _put(files, [own, *[_begun(files, folder) for folder in more]], base, book, name, aside, one, length if not more else COPY)
                        n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    return publish


@dataclass
class Aside:
    """A task's own folder, and whether it makes books' folders in it: until one turns out to be there already, as looking
    each up first would take a third longer in a folder into which all tasks write."""

    folder: str
    used: bool


def _put(files: fs.FileSystem, parts: list[Iterator[bytes]], base: str, book: str, name: str, aside: Aside, one: bool, size: int) -> None:
    """Joins the parts of a file beside its place and then moves it there, so that it is never seen half written. A small
    file, by its size, is one write. On a local file system the folder of a new book is made in one of the task's own and
    moved as a whole: tasks that make folders in the same one wait for each other, and a move is the shortest wait."""

    def pieces() -> Iterator[bytes]:
        between = b"[\n"
        for part in parts:
            begun = False
            for piece in part:
                if not begun and not one:
                    yield between
                    between = b",\n"
                begun = True
                yield piece
        yield b"" if one else b"\n]" if between == b",\n" else b"[]"

    path, local = target(base, book, name), isinstance(files, fs.LocalFileSystem)
    new = aside.used and book not in ("", ".", "..")
    if new:
        beside = target(aside.folder, book, name)
        os.mkdir(f"{aside.folder}/{book}")
        os.mkdir(os.path.dirname(beside))
    else:
        beside = f"{path}.{uuid.uuid4().hex}"
        files.create_dir(path.rpartition("/")[0])
    with open(beside, "wb") if local and size < COPY else files.open_output_stream(beside, buffer_size=COPY if size >= COPY else None) as out:
        for piece in pieces() if size >= COPY else [b"".join(pieces())]:
            out.write(piece)
    if new:
        try:
            os.rename(f"{aside.folder}/{book}", f"{base}/{book}")
        except OSError:  # the book has a folder with files
            aside.used = False
            files.create_dir(path.rpartition("/")[0])
            files.move(beside, path)
            os.rmdir(os.path.dirname(beside))
            os.rmdir(f"{aside.folder}/{book}")
    else:
        files.move(beside, path)


def write(rows: DataFrame, root: str, order: list[str], name: str = RECIPES, books: DataFrame | None = None, one: bool = False) -> int:
    """Writes rows (book_id, ...) as a file for each book and gives their number. order: columns by which a book's rows
    are sorted. Rows without a book are passed over. books (book_id): those of them without rows get an empty array. one: a book has one row, its file is an
    object. Files of an earlier write are replaced, book by book."""
    spark = rows.sparkSession
    spark.dataSource.register(BookFiles)
    fields = [c for c in rows.columns if c != "book_id"]
    sorted_by = [F.col(c).alias(f"_by{i}") for i, c in enumerate(order)]
    named = F.url_encode(F.col("book_id").cast("string")).alias("_book")
    keyed = rows.where(F.col("book_id").isNotNull()).select(named, F.lit(1).alias("_place"), *fields, *sorted_by)
    if books is not None:
        # one row for each of them, whether it has others or not, as it is less to sort than a join would be
        keyed = keyed.unionByName(books.where(F.col("book_id").isNotNull()).select(named), allowMissingColumns=True)
    by = ["_book", *[f"_by{i}" for i in range(len(order))]]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("_book", "_place", *fields)
    job = uuid.uuid4().hex
    laid.write.format("book_files").mode("append").options(path=root, job=job, one=str(one).lower()).save()
    return publish(spark, root, job, name, one)


def publish(spark: SparkSession, root: str, job: str, name: str, one: bool = False) -> int:
    """Moves what a job has staged to its places; it may be called again after a failure."""
    files, base = store(root)
    with files.open_input_stream(f"{base}/{STAGED}/{job}/_list") as held:
        staged = sorted((json.loads(x) for x in held.read().decode().split("\n") if x), key=lambda x: x[1])
    rows = []
    for i, (folder, _, first, last) in enumerate(staged):
        # the first book belongs to the task before where that one ends with it; the last goes on in those that follow
        shared = first if i and staged[i - 1][3] == first else None
        more = []
        for later, _, begins, ends in staged[i + 1 :]:
            if begins != last:
                break
            more.append(later)
            if ends != last:
                break
        rows.append((folder, shared, last, more))
    if not rows:
        return 0
    tasks = spark.createDataFrame(rows, "folder string, not_mine string, last string, more array<string>").repartition(min(len(rows), 4 * spark.sparkContext.defaultParallelism))
    n = tasks.mapInArrow(_publish(root, name, one), "files bigint").agg(F.sum("files")).first()[0]
    files.delete_dir(f"{base}/{STAGED}/{job}")
    return n or 0


def read_back(books: DataFrame, root: str, name: str = RECIPES) -> DataFrame:
    """(book_id, json) of the files of some books (book_id); null where there is none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(root)
        for batch in batches:
            texts = []
            for book in batch.column("_book").to_pylist():
                try:
                    with files.open_input_stream(target(base, book, name)) as held:
                        texts.append(held.read().decode())
                except FileNotFoundError:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("book_id"), pa.array(texts, pa.string())], ["book_id", "json"])

    book, spark = F.col("book_id").cast("string"), books.sparkSession
    # ids are small and come in few partitions, their files take long
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return books.select(book.alias("book_id"), F.url_encode(book).alias("_book")).repartition(parts, "_book").mapInArrow(read, "book_id string, json string")
