"""Book archives: members, reading order, chapters and images."""

from __future__ import annotations

import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import basename, dirname

#: What the names of chapter files hold, what those of other matter hold, and the types of chapters.
CHAPTER = r"(?i)p\d+|ch[_-]?\d[\d_-]*|(chapter|part)\d|chapter|part|_?c\d+"
OTHER = r"(?i)(toc|nav|cover|copyright|dedication|acknowledg|appendix)"
CHAPTER_TYPES = ("application/xhtml+xml", "application/x-dtbook+xml")
IMAGE = r"(?i)\.(jpg|jpeg|png|gif|webp)$"
#: Fewer chapter-like files than this, and all of the reading order counts.
LEAST_CHAPTERS = 5
#: Bytes of archives that a task takes in, and of members that it sends on, at once.
BATCH_BYTES = 16 << 20


def opened(files: DataFrame, wanted: str = "") -> DataFrame:
    """(book, ord, path, data) of the members of archives (path, content) whose names match `wanted`; a member that
    cannot be read has null data, an archive that cannot be opened has none. Rows leave a task in batches of about
    BATCH_BYTES, so an archive of many images is never held twice; archives come in by as much (or one that is larger), for
    which the session's Arrow batches are bounded."""
    by_bytes, conf = "spark.sql.execution.arrow.maxBytesPerBatch", files.sparkSession.conf
    bound = conf.get(by_bytes, None)
    if bound is None or not bound.isdigit() or not 0 < int(bound) <= BATCH_BYTES:
        conf.set(by_bytes, str(BATCH_BYTES))
    names, fits = ["book", "ord", "path", "data"], re.compile(wanted)

    def packed(rows):
        columns = zip(*rows, strict=True)
        types = (pa.string(), pa.int32(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    def of_archive(book, content):
        try:
            archive = zipfile.ZipFile(io.BytesIO(content or b""))
        except zipfile.BadZipFile:
            return
        for place, name in enumerate(archive.namelist()):
            if fits.search(name):
                try:
                    data = archive.read(name)
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError):
                    data = None
                yield book, place, name, data

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for book, content in zip(batch.column(0), batch.column(1), strict=True):
                for row in of_archive(book.as_py(), content.as_py()):
                    rows.append(row)
                    size += len(row[2]) + len(row[3] or b"")
                    if size >= BATCH_BYTES:
                        yield packed(rows)
                        rows, size = [], 0
        if rows:
            yield packed(rows)

    return files.select("path", "content").mapInArrow(run, "book string, ord int, path string, data binary")


def members(spark: SparkSession, folder: str, pattern: str = "*.epub", wanted: str = "") -> DataFrame:
    """The members of every archive below a folder, as opened() gives them."""
    return opened(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder), wanted)


def first_files(files: DataFrame, ending: str = ".epub", cover: str = "cover.jpg") -> DataFrame:
    """(folder, archive, cover) of files (path): the first archive of each folder in order of name, and the path of its
    cover, each null where there is none."""
    name = basename(F.col("path"))
    archive, picture = F.when(name.endswith(ending), F.col("path")), F.when(name == cover, F.col("path"))
    return files.groupBy(dirname(F.col("path")).alias("folder")).agg(F.min(archive).alias("archive"), F.min(picture).alias("cover"))


def _text(data: Column) -> Column:
    return F.make_valid_utf8(data.cast("string"))


def package_path(rows: DataFrame) -> DataFrame:
    """(book, package): the package file that the container names, else the first member that ends in .opf."""
    named = F.xpath_string(_text(F.col("data")), F.lit("string(//*[local-name()='rootfile']/@full-path)"))
    container = rows.where("path = 'META-INF/container.xml'").select("book", F.nullif(named, F.lit("")).alias("named"))
    fallback = rows.where(F.col("path").endswith(".opf")).groupBy("book").agg(F.min_by("path", "ord").alias("first"))
    return rows.select("book").distinct().join(container, "book", "left").join(fallback, "book", "left").select("book", F.coalesce("named", "first").alias("package")).where("package is not null")


def reading_order(rows: DataFrame) -> DataFrame:
    """(book, place, path): the chapters of a book's spine in order, by the type of their manifest entry; entries out of
    the line, of another type, navigation, or not in the manifest are left out."""
    at = package_path(rows).withColumnRenamed("package", "path")
    package = rows.join(at, ["book", "path"]).select("book", F.col("path").alias("package"), _text(F.col("data")).alias("xml"))
    items = "//*[local-name()='manifest']/*[local-name()='item']"
    refs = "//*[local-name()='spine']/*[local-name()='itemref'][not(@linear) or @linear!='no']"
    whole = f"{items}[@href and @media-type]"  # entries with all three attributes, so that the lists below run in step
    columns = [F.xpath("xml", F.lit(f"{whole}/@{a}")).alias(n) for a, n in (("id", "id"), ("href", "href"), ("media-type", "media"))]
    manifest = package.select("book", "package", *columns).select("book", "package", F.inline(F.arrays_zip("id", "href", "media")))
    marked = package.select("book", F.explode(F.xpath("xml", F.lit(f"{items}[contains(@properties, 'nav')]/@id"))).alias("id"))
    spine = package.select("book", F.posexplode(F.xpath("xml", F.lit(f"{refs}/@idref"))).alias("place", "id"))
    kept = manifest.where(F.col("media").isin(*CHAPTER_TYPES)).join(marked, ["book", "id"], "left_anti")
    folder = dirname(F.col("package"))
    path = F.when(folder == "", F.col("href")).otherwise(F.concat(folder, F.lit("/"), F.col("href")))
    return spine.join(kept, ["book", "id"]).select("book", "place", path.alias("path"))


def chapters(files: DataFrame) -> DataFrame:
    """Of files (book, place, path) those whose names look like chapters; where a book has LEAST_CHAPTERS - 1 of these
    or fewer, all whose names don't look like other matter."""
    name = basename(F.col("path"))
    flagged = files.where(~name.rlike(OTHER)).withColumn("_like", basename(F.col("path")).rlike(CHAPTER))
    counted = flagged.withColumn("_n", F.count_if("_like").over(Window.partitionBy("book")))
    return counted.where(F.col("_like") | (F.col("_n") < LEAST_CHAPTERS)).drop("_like", "_n")


def contents(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(book, place, path, text) of files in UTF-8; members that are absent or unreadable are left out."""
    text = rows.select("book", "path", F.try_validate_utf8(F.col("data").cast("string")).alias("text"))
    return files.join(text, ["book", "path"]).where("text is not null").select("book", "place", "path", "text")


def unreadable(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Files (book, place, path) that contents() leaves out, with the reason: absent, or unreadable."""
    known = rows.select("book", "path", F.lit("unreadable").alias("reason"), F.try_validate_utf8(F.col("data").cast("string")).alias("_text"))
    joined = files.join(known, ["book", "path"], "left").where("_text is null")
    return joined.select("book", "place", "path", F.coalesce("reason", F.lit("absent")).alias("reason"))


def member(rows: DataFrame, book: str, path: str) -> DataFrame:
    """The data of one member by its exact path; no row if it is absent."""
    return rows.where((F.col("book") == book) & (F.col("path") == path)).select("data")


def resolve_images(refs: DataFrame, paths: DataFrame) -> DataFrame:
    """refs (book, ref, ...) with the archive's path of the image: the member with the same file name, if there are
    several the first whose path ends in the reference, else the first. paths: (book, ord, path)."""
    images = paths.where(F.col("path").rlike(IMAGE)).select("book", "ord", "path", F.lower(basename(F.col("path"))).alias("_name"))
    # one small list for each file name, so a name that many archives share stays within its book
    lists = images.groupBy("book", "_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"]).alias("_paths"))
    joined = refs.withColumn("_name", F.lower(basename(F.col("ref")))).join(lists, ["book", "_name"], "left")
    fitting = F.filter("_paths", lambda p: F.endswith(F.lower(p), F.lower(F.col("ref"))))
    best = F.coalesce(F.get(fitting, F.lit(0)), F.get("_paths", F.lit(0)))
    return joined.withColumn("image_path", F.when(F.coalesce("ref", F.lit("")) != "", best)).drop("_name", "_paths")
