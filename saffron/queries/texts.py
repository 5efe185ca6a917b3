"""Text, dates, arrays, JSON and archives as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import values as v
from ..model import star_schema, table
from ..sources import archive, completion

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


@query("SELECT doc_id, trim(split_part(trim(split_part(coalesce(source, '') || ' x_y: ' || lang, ':', 1)), '_', 1)) AS title FROM documents")
def clean_title(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", t.clean_title(F.concat(F.coalesce("source", F.lit("")), F.lit(" x_y: "), F.col("lang"))).alias("title"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN '(' || p_name || ')' ELSE p_name END AS name FROM part")
def clean_name(spark, d):
    part = table(spark, d, "part")
    name = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("("), F.col("p_name"), F.lit(")"))).otherwise(F.concat("p_name", F.lit(" (of "), F.col("p_size"), F.lit(") ")))
    return part.select(F.col("p_partkey").alias("id"), t.clean_name(name).alias("name"))


@query("SELECT p_partkey AS id, array_to_string(list_transform(string_split(p_name || ' ' || lower(p_type), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name FROM part")
def capwords(spark, d):
    part = table(spark, d, "part")
    return part.select(F.col("p_partkey").alias("id"), t.capwords(F.concat(F.lit("  "), "p_name", F.lit(" \t "), "p_type")).alias("name"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_size || ' ' || lower(p_type) ELSE upper(p_name[1]) || lower(p_name[2:]) || ' for ' || p_size END AS yields FROM part""")
def yields(spark, d):
    part = table(spark, d, "part")
    raw = F.when(F.col("p_size") % 2 == 0, F.concat_ws(" ", "p_size", "p_type")).otherwise(F.concat_ws(" FOR ", "p_name", "p_size"))
    return part.select(F.col("p_partkey").alias("id"), t.yields(raw).alias("yields"))


@query("""WITH k AS (SELECT l_orderkey AS id, list_sort(list(p_name)) AS names FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT o_orderkey AS id, concat_ws('. ', o_orderpriority || ' ' || o_orderkey, nullif(array_to_string(names, ', '), ''), array_to_string(string_split(o_orderpriority, '-'), ', ')) AS text FROM orders LEFT JOIN k ON id = o_orderkey""")
def recipe_to_text(spark, d):
    c = star_schema(spark, d)
    names = c.named_keywords().groupBy(F.col("recipe_id").alias("id")).agg(F.array_sort(F.collect_list("keyword")).alias("names"))
    return c.recipes.join(names, "id", "left").select("id", t.recipe_text(F.col("name"), F.col("names"), F.col("ingredients")).alias("text"))


@query("SELECT p_partkey AS id, [p_name, p_brand] AS names, p_name[1:4] || '…' AS short, CASE WHEN p_size = 1 THEN '' ELSE 's' END AS plural FROM part")
def names_and_lengths(spark, d):
    part = table(spark, d, "part")
    csv = F.concat(F.lit(" , "), "p_name", F.lit(",,  "), "p_brand", F.lit(" ,"))
    return part.select(F.col("p_partkey").alias("id"), t.names_of(csv).alias("names"), t.truncated(F.col("p_name"), 5).alias("short"), t.plural_end(F.col("p_size")).alias("plural"))


@query("SELECT event_id AS id, '[' || event_id || ']' AS inner_text, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS answer FROM events")
def completions_cleaned(spark, d):
    e = table(spark, d, "events")
    body = F.concat(F.lit("["), "event_id", F.lit("]"))
    n = F.col("event_id") % 3
    fenced = F.when(n == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n == 1, F.concat(F.lit("```\n"), body, F.lit("\n```"))).otherwise(F.concat(body, F.lit("  ")))
    reply = F.when(n == 0, ' "YES"\n').when(n == 1, "'no'").otherwise("maybe")
    return e.select(F.col("event_id").alias("id"), t.without_fences(fenced).alias("inner_text"), t.yes_or_no(reply).alias("answer"))


@query(r"""SELECT page_id, regexp_extract(url, '[^/]*$') AS base, regexp_replace(url, '/?[^/]*$', '') AS dir, CASE page_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/webp' ELSE 'image/jpeg' END AS mime FROM pages""")
def paths_and_types(spark, d):
    pages = table(spark, d, "pages")
    n = F.col("page_id") % 3
    file = F.concat(F.lit("a/b."), F.when(n == 0, "PNG").when(n == 1, "webp").otherwise("tiff"))
    return pages.select("page_id", t.basename(F.col("url")).alias("base"), t.dirname(F.col("url")).alias("dir"), t.mime_type(file).alias("mime"))


@query("SELECT page_id, 'data:image/png;base64,' || base64(encode(url)) AS uri, '--- FILE: ' || page_id || ' ---' || chr(10) || url AS headed, 'Read ' || url || ' now' AS prompt, CAST(ceil(len(url) / 4) AS INTEGER) AS tokens FROM pages")
def prompts(spark, d):
    pages = table(spark, d, "pages")
    url = F.col("url")
    return pages.select("page_id", t.data_uri(F.lit("x.png"), F.encode(url, "UTF-8")).alias("uri"), t.with_header(F.col("page_id").cast("string"), url).alias("headed"), F.when(url.isNotNull(), t.prompt("Read {what} now", what=url)).alias("prompt"), t.tokens_estimate(url).alias("tokens"))


@query("SELECT p_partkey AS id, 'brand=' || replace(p_brand, '#', '%23') || '&q=' || replace(p_name, ' ', '+') AS q FROM part")
def query_strings(spark, d):
    part = table(spark, d, "part")
    params = F.create_map(F.lit("q"), "p_name", F.lit("brand"), "p_brand", F.lit("empty"), F.lit(""))
    return part.select(F.col("p_partkey").alias("id"), t.query_string(params).alias("q"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 4 > 0 THEN CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) END AS number,
  CAST(CASE o_orderkey % 3 WHEN 0 THEN least(greatest(o_orderkey, 1), 1000) WHEN 1 THEN 10 ELSE 1 END AS INTEGER) AS n FROM orders""")
def dates_and_numbers(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    raw = F.when(key % 4 > 0, F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 00:00"))).otherwise("soon")
    count = F.when(key % 3 == 0, key.cast("string")).when(key % 3 == 1, "many").otherwise("-5")
    day = v.date_of(raw)
    return o.select(key.alias("id"), day.alias("day"), v.day_number(day).alias("number"), v.clamped(count, 1, 1000, 10).alias("n"))


@query("SELECT event_id AS id, round(100.0 * (event_id % 7) / (event_id % 5 + 7), 1) AS percent, CASE WHEN event_id % 7 > 0 THEN (event_id % 5 + 7 - event_id % 7) * 3.0 / (event_id % 7) END AS left_s FROM events")
def progress(spark, d):
    done, total = F.col("event_id") % 7, F.col("event_id") % 5 + 7
    p = v.progress(done, total, F.lit(3.0))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), p["percent"].cast("double").alias("percent"), p["left_s"].alias("left_s"))


_SIZES = "WITH s AS (SELECT page_id, CAST(1 + page_id * 7 % 400 AS INTEGER) AS n FROM pages) "


def _files(spark, d) -> DataFrame:
    n = (1 + F.col("page_id") * 7 % 400).cast("int")
    return table(spark, d, "pages").select("page_id", F.sequence(F.lit(1), n).alias("files"))


@query(_SIZES + """SELECT page_id, CASE WHEN n <= 16 THEN [range(1, n + 1)] ELSE list_transform(range(16), lambda i: range(i * (n // 16) + 1, CASE WHEN i = 15 THEN n + 1 ELSE i * (n // 16) + n // 16 + 2 END)) END AS blocks FROM s""")
def block_chunks(spark, d):
    return _files(spark, d).select("page_id", v.blocks(F.col("files")).alias("blocks"))


@query(_SIZES + """SELECT page_id, CASE WHEN n < 30 THEN 'many_per_file' WHEN n <= 180 THEN 'one_per_file' ELSE 'split' END AS layout, n > 150 AS apart, least(n, CASE WHEN n <= 10 THEN n ELSE least(10, CAST(floor(n * 0.75) AS INTEGER) - CAST(floor(n * 0.25) AS INTEGER)) END) AS sampled FROM s""")
def chapter_layout(spark, d):
    n = F.size("files")
    return _files(spark, d).select("page_id", v.layout(n).alias("layout"), v.images_apart(n).alias("apart"), F.size(v.middle_sample(F.col("files"), F.col("page_id"))).alias("sampled"))


_MEMBERS = """WITH m AS (SELECT page_id // 20 AS book, page_id AS place, 'OEBPS/' || CASE page_id % 5 WHEN 0 THEN 'ch' WHEN 1 THEN 'toc' WHEN 2 THEN 'x' WHEN 3 THEN 'Part' ELSE 'cover' END || CASE WHEN page_id % 5 = 3 OR page_id // 20 % 2 = 0 THEN CAST(page_id AS VARCHAR) ELSE '-' || chr(CAST(97 + page_id % 20 AS INTEGER)) END || '.xhtml' AS path FROM pages) """


def _members(spark, d) -> DataFrame:
    n, book = F.col("page_id"), F.floor(F.col("page_id") / 20).cast("long")
    kind = F.element_at(F.array(*map(F.lit, ("ch", "toc", "x", "Part", "cover"))), (n % 5 + 1).cast("int"))
    tail = F.when((n % 5 == 3) | (book % 2 == 0), n.cast("string")).otherwise(F.concat(F.lit("-"), F.char(97 + n % 20)))
    return table(spark, d, "pages").select(book.alias("book"), n.alias("place"), F.concat(F.lit("OEBPS/"), kind, tail, F.lit(".xhtml")).alias("path"))


@query(_MEMBERS + r""", f AS (SELECT *, regexp_matches(regexp_extract(path, '[^/]*$'), '(?i)p\d+|ch[_-]?\d[\d_-]*|(chapter|part)\d|chapter|part|_?c\d+') AS liked FROM m WHERE NOT regexp_matches(regexp_extract(path, '[^/]*$'), '(?i)(toc|nav|cover|copyright|dedication|acknowledg|appendix)')),
g AS (SELECT *, count_if(liked) OVER (PARTITION BY book) AS n FROM f) SELECT book, place, path FROM g WHERE liked OR n < 5""")
def chapter_classify(spark, d):
    return archive.chapters(_members(spark, d))


@query("""WITH p AS (SELECT p_partkey % 40 AS book, p_partkey AS ord, CASE p_partkey % 2 WHEN 0 THEN 'OEBPS/images/' ELSE 'OEBPS/alt/' END || 'I' || p_partkey // 80 || '.JPG' AS path FROM part),
r AS (SELECT p_partkey AS id, p_partkey % 40 AS book, CASE p_partkey % 4 WHEN 0 THEN 'images/' WHEN 1 THEN '../images/' WHEN 2 THEN 'alt/' ELSE '' END || 'i' || p_partkey // 80 || '.jpg' AS ref FROM part)
SELECT r.id, (SELECT p.path FROM p WHERE p.book = r.book AND lower(regexp_extract(p.path, '[^/]*$')) = lower(regexp_extract(r.ref, '[^/]*$')) ORDER BY NOT ends_with(lower(p.path), lower(r.ref)), p.ord LIMIT 1) AS image_path FROM r""")
def image_resolve(spark, d):
    n = F.col("p_partkey")
    tail = F.floor(n / 80).cast("string")
    paths = table(spark, d, "part").select((n % 40).alias("book"), n.alias("ord"), F.concat(F.when(n % 2 == 0, "OEBPS/images/").otherwise("OEBPS/alt/"), F.lit("I"), tail, F.lit(".JPG")).alias("path"))
    folder = F.when(n % 4 == 0, "images/").when(n % 4 == 1, "../images/").when(n % 4 == 2, "alt/").otherwise("")
    refs = table(spark, d, "part").select(n.alias("id"), (n % 40).alias("book"), F.concat(folder, F.lit("i"), tail, F.lit(".jpg")).alias("ref"))
    return archive.resolve_images(refs, paths).select("id", "image_path")


@query("SELECT event_id AS id, json_extract_string(props, '$.k') AS k, 0 AS elements FROM events")
def json_props(spark, d):
    props = F.col("props")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), v.json_map(props)["k"].alias("k"), F.size(v.json_array(props)).alias("elements"))


@query("""SELECT event_id AS id, CAST(1 AS INTEGER) AS place, event_type AS name, ['a', 'b'] AS ingredients, [CAST(user_id AS VARCHAR)] AS instructions, NULL AS yields, 'x.jpg' AS image, CAST([] AS VARCHAR[]) AS keywords FROM events WHERE event_id % 3 > 0""")
def model_rows(spark, d):
    """Completions with a scalar, a good element, one without ingredients and one with a numeric name; a third are no array."""
    good = F.concat(F.lit('{"name":"'), "event_type", F.lit('","recipeIngredients":["a","b"],"recipeInstructions":["'), "user_id", F.lit('"],"image":"x.jpg"}'))
    text = F.concat(F.lit("[7,"), good, F.lit(',{"name":"n","recipeIngredients":[],"recipeInstructions":["i"]},{"name":5,"recipeIngredients":["a"],"recipeInstructions":["i"]}]'))
    raw = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 > 0, text).otherwise(good).alias("response"))
    return v.model_rows(raw)


@query("SELECT p_partkey AS id, CASE p_size % 2 WHEN 0 THEN 'gemini-2.5-flash-lite' ELSE 'gemini-2.5-flash' END AS model, CASE WHEN p_size % 5 = 0 THEN 'own' WHEN p_size % 2 = 0 THEN 'gemini-2.5-flash-lite' ELSE 'gemini-2.5-flash' END AS chosen FROM part")
def model_choice(spark, d):
    size = F.col("p_size")
    method = F.when(size % 2 == 0, "file").otherwise("block")
    own = F.when(size % 5 == 0, "own").otherwise("")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), completion.model_for(F.lit("GEMINI"), method).alias("model"), completion.model_for(F.lit("GEMINI"), method, own).alias("chosen"))


@query("SELECT item_id AS recipe_id, CAST(len(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')) AS DOUBLE) AS words FROM benchmark")
def embed_texts(spark, d):
    """Vectors of hashed words, of which the sum is the number of words."""
    vectors = completion.embedded(table(spark, d, "benchmark").select(F.col("item_id").alias("recipe_id"), "text"), completion.hashed_words)
    return vectors.select("recipe_id", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).alias("words"))
