"""Archives, library details, completions, streamed changes, and facts that the other modules of queries leave out."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.values import middle_sample
from ..model import star_schema, table
from ..operators import keywords, mutations, vectors, workflow
from ..plans.search import By, get_page
from ..sources import archive, catalogue, completion
from ..streaming import incremental
from ..streaming.buckets import BucketTable
from ..streaming.folders import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a function under its name, with its SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return register


_PACKAGE = """<package xmlns="urn:p" version="3.0"><manifest>
<item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>
<item id="a" href="ch1.xhtml" media-type="application/xhtml+xml"/>
<item id="b" href="ch2.xhtml" media-type="application/x-dtbook+xml"/>
<item id="s" href="side.xhtml" media-type="application/xhtml+xml"/>
<item id="i" href="images/x.jpg" media-type="image/jpeg"/></manifest>
<spine><itemref idref="n"/><itemref idref="b"/><itemref idref="i"/><itemref idref="lost"/><itemref idref="s" linear="no"/><itemref idref="a" linear="yes"/></spine></package>"""


def _archives(spark, d):
    """(path, content): each page as an archive of its own. Even ids have a container that names the package, odd ones
    two packages of which the first counts; of ids that 3 divides the second chapter is no text, of those that 5
    divides it is absent, and those that 7 divides are no archives at all."""

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], ["path", "content"])

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for page, text in zip(batch.column(0), batch.column(1), strict=True):
                i, html = page.as_py(), text.as_py()
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    if i % 2 == 0:
                        z.writestr("META-INF/container.xml", '<c xmlns="urn:c"><rootfile full-path="OEBPS/p.opf"/></c>')
                        z.writestr("a.opf", "<package/>")
                    z.writestr("OEBPS/p.opf", _PACKAGE)
                    if i % 2:
                        z.writestr("z.opf", "<package/>")
                    z.writestr("OEBPS/ch1.xhtml", html or "")
                    if i % 5:
                        z.writestr("OEBPS/ch2.xhtml", b"\xff\xfe" if i % 3 == 0 else f"<p>{i}</p>")
                    z.writestr("OEBPS/images/x.jpg", f"jpg {i}")
                out.append((str(i), held.getvalue() if i % 7 else b"no archive"))
                size += len(out[-1][1])
                if size >= archive.BATCH_BYTES:
                    yield packed(out)
                    out, size = [], 0
            if out:
                yield packed(out)

    return table(spark, d, "pages").select("page_id", "html").mapInArrow(run, "path string, content binary")


_BOOKS = "WITH b AS (SELECT page_id, CAST(page_id AS VARCHAR) AS book, html FROM pages WHERE page_id % 7 > 0) "


@query(_BOOKS + """, m AS (SELECT book, unnest(list_filter([
    CASE WHEN page_id % 2 = 0 THEN 'META-INF/container.xml' END, CASE WHEN page_id % 2 = 0 THEN 'a.opf' END, 'OEBPS/p.opf', CASE WHEN page_id % 2 = 1 THEN 'z.opf' END,
    'OEBPS/ch1.xhtml', CASE WHEN page_id % 5 > 0 THEN 'OEBPS/ch2.xhtml' END, 'OEBPS/images/x.jpg'], lambda x: x IS NOT NULL)) AS path, html, page_id FROM b)
SELECT book, path, CAST(CASE path WHEN 'OEBPS/ch1.xhtml' THEN octet_length(encode(coalesce(html, ''))) WHEN 'OEBPS/images/x.jpg' THEN length('jpg ' || page_id) END AS BIGINT) AS n_bytes FROM m""")
def archive_members(spark, d):
    sized = F.when(F.col("path").isin("OEBPS/ch1.xhtml", "OEBPS/images/x.jpg"), F.octet_length("data").cast("long"))
    return archive.opened(_archives(spark, d)).select("book", "path", sized.alias("n_bytes"))


@query(_BOOKS + "SELECT book, 'OEBPS/p.opf' AS package FROM b")
def archive_packages(spark, d):
    return archive.package_path(archive.opened(_archives(spark, d), r"\.(opf|xml)$"))


@query(_BOOKS + "SELECT book, 1 AS place, 'OEBPS/ch2.xhtml' AS path FROM b UNION ALL SELECT book, 4, 'OEBPS/ch1.xhtml' FROM b")
def archive_reading_order(spark, d):
    return archive.reading_order(archive.opened(_archives(spark, d), r"\.(opf|xml)$"))


@query(_BOOKS + """SELECT book, 4 AS place, md5(coalesce(html, '')) AS text_md5 FROM b
UNION ALL SELECT book, 1, md5('<p>' || book || '</p>') FROM b WHERE page_id % 5 > 0 AND page_id % 3 > 0""")
def archive_contents(spark, d):
    rows = archive.opened(_archives(spark, d), r"\.(opf|xml|xhtml)$")
    return archive.contents(rows, archive.reading_order(rows)).select("book", "place", F.md5("text").alias("text_md5"))


@query(_BOOKS + "SELECT book, 1 AS place, CASE WHEN page_id % 5 = 0 THEN 'absent' ELSE 'unreadable' END AS reason FROM b WHERE page_id % 5 = 0 OR page_id % 3 = 0")
def archive_unreadable(spark, d):
    rows = archive.opened(_archives(spark, d), r"\.(opf|xml|xhtml)$")
    return archive.unreadable(rows, archive.reading_order(rows)).select("book", "place", "reason")


@query("SELECT 'jpg 11' AS data")
def archive_image(spark, d):
    """The bytes of one image by its archive and exact path."""
    rows = archive.opened(_archives(spark, d), archive.IMAGE)
    return archive.member(rows, "11", "OEBPS/images/x.jpg").select(F.col("data").cast("string").alias("data"))


@query("""SELECT 'lib/' || o_custkey AS folder, min(CASE WHEN o_orderstatus <> 'P' THEN 'lib/' || o_custkey || '/' || o_orderkey || '.epub' END) AS archive,
  CASE WHEN bool_or(o_orderstatus = 'P') THEN 'lib/' || o_custkey || '/cover.jpg' END AS cover FROM orders GROUP BY o_custkey""")
def archive_first_files(spark, d):
    name = F.when(F.col("o_orderstatus") == "P", "cover.jpg").otherwise(F.concat("o_orderkey", F.lit(".epub")))
    return archive.first_files(table(spark, d, "orders").select(F.concat_ws("/", F.lit("lib"), "o_custkey", name).alias("path")))


def _library(spark, d):
    """A library's tables made of orders whose dates are written in three ways, the third not readable."""
    orders = table(spark, d, "orders")
    o, day, moment = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kinds = o % 3
    return {
        "books": orders.select(o.alias("id"), F.lit("Order").alias("title"), F.lit("p").alias("path"), F.when(kinds == 0, F.concat(day, F.lit(" 00:00:00+00:00"))).when(kinds == 1, day).otherwise("soon").alias("pubdate"), F.when(kinds < 2, moment).otherwise("soon").alias("timestamp")),
        "identifiers": orders.where("o_orderkey % 2 = 0").select(o.alias("book"), F.lit("isbn").alias("type"), o.cast("string").alias("val")),
        "data": orders.select(o.alias("book"), F.lit("EPUB").alias("format"), o.cast("string").alias("name")),
        "authors": table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        "books_authors_link": orders.select(o.alias("book"), F.col("o_custkey").alias("author")),
        "comments": orders.where("o_orderkey % 4 = 0").select(o.alias("book"), F.col("o_orderpriority").alias("text")),
        "books_tags_link": orders.where("o_orderstatus = 'F'").select(o.alias("book"), F.lit(1).alias("tag")),
        "tags": table(spark, d, "region").where("r_regionkey = 0").select(F.lit(1).alias("id"), F.lit("Food").alias("name")),
    }


_LIBRARY = """SELECT o_orderkey AS calibre_id, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS pubdate, CASE WHEN o_orderkey % 3 < 2 THEN date_trunc('second', o_orderdate) END AS calibre_added_at,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS isbn, c_name AS author, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE '' END AS description
FROM orders JOIN customer ON c_custkey = o_custkey """


def _details(rows):
    return rows.select("calibre_id", "pubdate", F.col("calibre_added_at").cast("timestamp_ntz").alias("calibre_added_at"), "isbn", "author", "description")


@query(_LIBRARY + "WHERE o_orderstatus = 'F'")
def catalogue_details(spark, d):
    return _details(catalogue.books(_library(spark, d)))


@query(_LIBRARY + "WHERE o_orderkey = 4")
def catalogue_book(spark, d):
    """One book by its id, whatever its tag."""
    return _details(catalogue.book(_library(spark, d), 4))


@query("""SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 10 > 0 THEN 'm: ' || upper(left(source, 3)) END AS response, CASE WHEN doc_id % 10 > 0 THEN 0.5 ELSE 0 END::DOUBLE AS cost_usd,
  CAST(CASE WHEN doc_id % 10 > 0 THEN 7 ELSE 0 END AS INTEGER) AS input_tokens, CASE WHEN doc_id % 10 = 0 THEN 'no answer' END AS error FROM documents""")
def completions(spark, d):
    """A provider that never answers one prompt of ten, and each other prompt at its second try only."""
    seen = set()

    def provider(prompt, model):
        refused, _, text = prompt.partition(" ")
        if refused == "0":
            raise ValueError("no answer")
        if prompt not in seen:
            seen.add(prompt)
            raise ConnectionError("later")
        seen.discard(prompt)
        return f"{model}: {text[:3].upper()}", (0.5, 7, 2)

    asked = F.concat_ws(" ", (F.col("doc_id") % 10).cast("string"), "source")
    prompts = table(spark, d, "documents").select(F.col("doc_id").alias("key"), asked.alias("prompt"), F.lit("m").alias("model"))
    return completion.completed(prompts, provider, rate_per_minute=1e9, first_wait=0.0).drop("output_tokens")


@query("""SELECT o_orderkey AS id, CAST(CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'O' THEN 0 ELSE 1 END AS INTEGER) AS n_recipes, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS name FROM orders""")
def answers_by_schema(spark, d):
    """Answers as typed recipes: one with all required fields, one without its steps, and one that is no JSON."""
    full = F.to_json(F.array(F.struct(F.col("o_orderpriority").alias("name"), F.array(F.lit("egg")).alias("recipeIngredients"), F.array(F.lit("boil")).alias("recipeInstructions"))))
    part = F.to_json(F.array(F.struct(F.col("o_orderpriority").alias("name"))))
    status = F.col("o_orderstatus")
    recipes = completion.answered(F.when(status == "P", "no list").when(status == "O", part).otherwise(full))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), recipes.alias("r"))
    return rows.select("id", F.when(F.col("r").isNotNull(), F.size("r")).alias("n_recipes"), F.get("r", F.lit(0))["name"].alias("name"))


@query("""SELECT r_regionkey AS row, CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE 'default' END AS name FROM region""")
def settings_once(spark, d):
    """A table of one row that is there for every other region, and made of defaults for the rest."""
    regions = table(spark, d, "region")
    out = None
    for key in (0, 1, 2, 3, 4):
        rows = regions.where((F.col("r_regionkey") == key) & (F.col("r_regionkey") % 2 == 0)).select(F.col("r_regionkey").alias("row"), F.col("r_name").alias("name"))
        defaults = regions.where(F.col("r_regionkey") == key).select("r_regionkey", F.lit("default"))
        one = mutations.set_once(rows, defaults)
        out = one if out is None else out.union(one)
    return out


@query("""SELECT c_custkey AS id, list_concat(['first'], coalesce((SELECT list(event_type || event_id ORDER BY ts, event_type || event_id) FROM events WHERE user_id = c_custkey), [])) AS errors FROM customer""")
def errors_appended(spark, d):
    reports = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array(F.lit("first")).alias("errors"))
    errors = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.concat("event_type", "event_id").alias("error"))
    return workflow.failed(reports, errors)


@query("SELECT l_orderkey AS id, bool_or(l_linenumber % 3 = 0) AS any_image FROM lineitem GROUP BY 1")
def any_image_flag(spark, d):
    found = F.collect_list(F.struct(F.when(F.col("l_linenumber") % 3 == 0, "x.jpg").when(F.col("l_linenumber") % 3 == 1, "").alias("image")))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(found.alias("r")).select("id", workflow.any_image(F.col("r")).alias("any_image"))


@query("SELECT doc_id AS book_id, CASE WHEN doc_id % 2 = 0 THEN ['block'] ELSE ['file', 'block'] END AS already_tried FROM documents")
def methods_tried(spark, d):
    status = table(spark, d, "documents").select(F.col("doc_id").alias("book_id"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("block"))).otherwise(F.array(F.lit("file"))).alias("already_tried"))
    return workflow.tried(status, "block")


_IMAGES = "WITH r AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'img/' || o_orderkey || '.jpg' WHEN 'O' THEN '' END AS image FROM orders) SELECT id, image FROM r ORDER BY image "


@query(_IMAGES + "ASC NULLS FIRST, id LIMIT 30")
def sort_nulls_up(spark, d):
    return get_page(star_schema(spark, d).recipes.select("id", "image"), [By(F.col("image")), By(F.col("id"))], 1, 30)[0]


@query(_IMAGES + "DESC NULLS LAST, id LIMIT 30 OFFSET ((SELECT count(*) FROM orders) - 1) // 30 * 30")
def sort_nulls_down_last_page(spark, d):
    return get_page(star_schema(spark, d).recipes.select("id", "image"), [By(F.col("image"), True), By(F.col("id"))], 10**9, 30)[0]


@query("SELECT c_custkey AS id FROM customer ORDER BY 1 DESC LIMIT 60")
def books_latest_first(spark, d):
    return get_page(star_schema(spark, d).books.select("id"), [By(F.col("id"), True)], 1, 60)[0]


@query("""WITH k AS (SELECT l_orderkey AS id, list(p_name ORDER BY p_name) AS names FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT id, names[:4] AS shown, CAST(greatest(0, len(names) - 4) AS INTEGER) AS more FROM k""")
def keywords_shown(spark, d):
    names = star_schema(spark, d).named_keywords().groupBy(F.col("recipe_id").alias("id")).agg(F.array_sort(F.collect_list("keyword")).alias("names"))
    return names.select("id", t.added(F.col("names"), 4).alias("s")).select("id", "s.shown", "s.more")


@query("SELECT o_orderkey AS id, o_orderstatus AS a, 'second' AS b, 'second' AS c, CAST(3 AS INTEGER) AS n FROM orders")
def maps_merged(spark, d):
    """Of two maps that share a key the second has the last word."""
    first = F.create_map(F.lit("a"), F.col("o_orderstatus"), F.lit("b"), F.lit("first"))
    second = F.create_map(F.lit("b"), F.lit("second"), F.lit("c"), F.lit("second"))
    merged = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), keywords.merged_maps(first, second).alias("m"))
    return merged.select("id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in "abc"], F.size("m").alias("n"))


@query("""WITH n AS (SELECT DISTINCT p_name FROM part), c AS (SELECT p_name, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS canonical FROM n)
SELECT p_name AS original, canonical FROM c UNION ALL SELECT p_name || 's', canonical || 's' FROM c UNION ALL SELECT canonical || 's', canonical FROM c""")
def keyword_plurals(spark, d):
    """Every keyword with its plural: the plural's spelling becomes the singular."""
    names = table(spark, d, "part").select("p_name")
    return keywords.proposed(names.select(F.col("p_name").alias("name")).union(names.select(F.concat("p_name", F.lit("s")))))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_upserts(spark, d):
    """The events as a stream of changes to a bucketed table of each user's latest, which another driver could go on with."""
    events, folder = table(spark, d, "events"), work_folder(spark, "upserts")
    arriving = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    incremental.stream_into(arriving, f"{folder}/latest", ["user_id"], ["ts", "event_id"], f"{folder}/checkpoint")
    return BucketTable(spark, f"{folder}/latest", ["user_id"]).read().select("user_id", "event_type", "event_id")


@query("""SELECT vec_id AS recipe_id, CAST(64 AS INTEGER) AS width, -1 AS words FROM embeddings
UNION ALL SELECT o_orderkey, 64, CAST(len(string_split(o_orderpriority || ' ' || o_orderkey, ' ')) AS INTEGER) FROM orders WHERE o_orderkey NOT IN (SELECT vec_id FROM embeddings)""")
def embed_backfilled(spark, d):
    """Recipes without a vector get one; the sum of a stand-in vector is its number of words."""
    c = star_schema(spark, d)
    filled = incremental.backfill(c.recipes, c.embeddings, completion.hashed_words, F.col("name"))
    known = c.embeddings.select("recipe_id", F.lit(True).alias("known"))
    words = F.when(F.col("known"), -1).otherwise(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).cast("int"))
    return filled.join(known, "recipe_id", "left").select("recipe_id", F.size("embedding").alias("width"), words.alias("words"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT v FROM v WHERE vec_id = 3)
SELECT vec_id AS recipe_id, CAST(row_number() OVER (ORDER BY 1 - list_cosine_similarity(v.v, q.v), vec_id) AS INTEGER) AS rank FROM v, q QUALIFY rank <= 20""")
def search_by_text(spark, d):
    """A text is embedded by an injected provider, here one that knows a single text; an unknown text finds nothing."""
    embeddings = star_schema(spark, d).embeddings
    known = {"lemon tart": vectors.vector_of(embeddings, 3)}
    found = [vectors.by_text(spark, embeddings, provider, text) for provider, text in ((known.get, "lemon tart"), (known.get, "soup"), (None, "lemon tart"), (known.get, " "))]
    return found[0].union(found[1]).union(found[2]).union(found[3]).select("recipe_id", "rank")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '../img/' || o_orderkey || '.jpg' WHEN 1 THEN 'OEBPS/img/' || o_orderkey || '.jpg' WHEN 2 THEN '/' || o_orderkey ELSE '.' END AS path FROM orders""")
def paths_normalised(spark, d):
    o = F.col("o_orderkey")
    name = F.concat(o.cast("string"), F.lit(".jpg"))
    path = F.when(o % 4 == 0, F.concat(F.lit("a/../../img//"), name)).when(o % 4 == 1, F.concat(F.lit("OEBPS/text/./../img/"), name)).when(o % 4 == 2, F.concat(F.lit("/../"), o.cast("string"), F.lit("/."))).otherwise("a/..")
    return table(spark, d, "orders").select(o.alias("id"), t.normalised(path).alias("path"))


@query("""SELECT l_orderkey AS id, string_agg('--- FILE: ' || l_linenumber || '.xhtml ---' || chr(10) || l_returnflag, chr(10) || chr(10) ORDER BY l_linenumber, l_returnflag) AS text FROM lineitem GROUP BY 1""")
def chapters_joined(spark, d):
    files = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(files.alias("f"))
    names = F.transform("f", lambda f: F.concat(f["l_linenumber"].cast("string"), F.lit(".xhtml")))
    return rows.select("id", t.joined_files(names, F.transform("f", lambda f: f["l_returnflag"])).alias("text"))


@query("SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 3 END AS BIGINT) AS ord FROM orders")
def orders_default_to_zero(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.nullif(F.col("o_orderkey") % 3, F.lit(0).cast("long")).alias("ord"))
    return mutations.ordered(rows)


@query("SELECT count(*) AS cleared FROM orders WHERE o_custkey = 7")
def images_cleared(spark, d):
    return mutations.images_of(star_schema(spark, d).recipes, 7)


@query("""SELECT event_id AS id, '{"id":' || event_id || ',"event_type":"' || event_type || '","ts":"' || strftime(ts, '%Y-%m-%d') || '","none":null}' AS json FROM events""")
def report_json(spark, d):
    """One JSON object a report; dates are written as text."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", F.col("ts").cast("date").alias("ts"), F.lit(None).cast("string").alias("none"))
    return mutations.report_document(rows)


@query("""WITH s AS (SELECT page_id, 11 + page_id % 60 AS n FROM pages), w AS (SELECT *, n * 25 // 100 AS low, n * 75 // 100 AS high FROM s),
x AS (SELECT *, CASE WHEN n <= 10 THEN 0 WHEN high - low <= 10 THEN low ELSE low + CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT) % (high - low - 9) END AS start FROM w)
SELECT page_id, list_transform(range(start, start + CASE WHEN n <= 10 THEN n ELSE least(10, high - low) END), lambda i: CAST(i AS BIGINT)) AS sampled FROM x""")
def chapter_samples(spark, d):
    """Ten chapters in a row from the middle half, begun where a hash of the book's id says."""
    files = F.sequence(F.lit(0).cast("long"), (10 + F.col("page_id") % 60).cast("long"))
    return table(spark, d, "pages").select("page_id", middle_sample(files, F.col("page_id")).alias("sampled"))
