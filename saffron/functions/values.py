"""Dates, numbers, arrays and JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = 16
SAMPLE = 10
#: Chapters beyond which images count as apart, chapters up to which each holds many recipes.
MANY_CHAPTERS, FEW_CHAPTERS = 150, 20


def date_of(text: Column) -> Column:
    """The first word as yyyy-mm-dd; null if it is none."""
    return F.try_to_date(F.get(F.split(F.trim(text), r"\s+"), F.lit(0)), "yyyy-MM-dd")


def timestamp_of(text: Column) -> Column:
    return F.try_to_timestamp(text)


def day_number(date: Column) -> Column:
    return F.date_format(date, "yyyyMMdd").cast("int")


def daily_pick(rows: DataFrame, date: Column, id_: str = "id") -> DataFrame:
    """One row of all, the same all day: that whose id hashes lowest together with the day."""
    return rows.withColumn("_place", F.md5(F.concat_ws(":", day_number(date).cast("string"), F.col(id_).cast("string")))).orderBy("_place", id_).limit(1).drop("_place")


def clamped(text: Column, low: int, high: int, default: int) -> Column:
    """A number within bounds; what cannot be read is the default."""
    return F.least(F.greatest(F.coalesce(F.try_to_number(F.trim(text), F.lit("S999999999")).cast("int"), F.lit(default)), F.lit(low)), F.lit(high))


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """Share done in percent and the seconds that the rest will take."""
    return F.struct(F.round(100 * done / F.nullif(total, F.lit(0)), 1).alias("percent"), ((total - done) * seconds / F.nullif(done, F.lit(0))).alias("left_s"))


def blocks(files: Column) -> Column:
    """An array of files in BLOCKS blocks, each but the last also holding the file that the next begins with; the last
    takes what is left. No more than BLOCKS files are one block."""
    n = F.size(files)
    width = F.floor(n / BLOCKS).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda i: F.slice(files, i * width + 1, F.when(i == BLOCKS - 1, n).otherwise(width + 1)))
    return F.when(n <= BLOCKS, F.array(files)).otherwise(cut)


def middle_sample(files: Column, seed: Column) -> Column:
    """SAMPLE files in a row from the middle half, begun where the seed says; all, if there are no more than that."""
    n = F.size(files)
    start, end = F.floor(n * 0.25).cast("int"), F.floor(n * 0.75).cast("int")
    room = end - start
    shift = F.pmod(F.conv(F.substring(F.md5(seed.cast("string")), 1, 8), 16, 10).cast("long"), F.greatest(room - SAMPLE + 1, F.lit(1)).cast("long")).cast("int")
    return F.when(n <= SAMPLE, files).when(room <= SAMPLE, F.slice(files, start + 1, room)).otherwise(F.slice(files, start + shift + 1, SAMPLE))


def layout(chapters: Column) -> Column:
    """How a book's files hold its recipes, by their number."""
    return F.when(chapters < 30, "many_per_file").when(chapters <= 180, "one_per_file").otherwise("split")


def images_apart(chapters: Column) -> Column:
    return chapters > MANY_CHAPTERS


def many_per_file(chapters: Column) -> Column:
    """Whether a book's few files each hold many recipes."""
    return chapters <= FEW_CHAPTERS


def json_array(text: Column) -> Column:
    """The elements of a JSON array as JSON texts; what is no array is empty."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def json_map(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))


def model_rows(raw: DataFrame) -> DataFrame:
    """raw (..., response): a row for each valid recipe of a completion, with its place. A row needs a name that is a
    text, and ingredients and instructions that are arrays of texts with one element at least; others are passed over,
    also where they stand among valid ones."""
    element = raw.select("*", F.posexplode(json_array(F.col("response"))).alias("place", "element"))
    variant = F.try_parse_json(F.col("element"))
    get = lambda path, kind: F.try_variant_get(variant, path, kind)
    kind = lambda *paths: F.coalesce(*[F.schema_of_variant(F.try_variant_get(variant, p, "variant")) for p in paths])
    texts = lambda *paths: F.coalesce(*[get(p, "array<string>") for p in paths])
    parsed = element.select(
        *raw.drop("response").columns,
        "place",
        kind("$.name").alias("name_kind"),
        kind("$.recipeIngredients", "$.ingredients").alias("ingredients_kind"),
        kind("$.recipeInstructions", "$.instructions").alias("instructions_kind"),
        get("$.name", "string").alias("name"),
        texts("$.recipeIngredients", "$.ingredients").alias("ingredients"),
        texts("$.recipeInstructions", "$.instructions").alias("instructions"),
        F.coalesce(get("$.recipeYield", "string"), get("$.yields", "string")).alias("yields"),
        get("$.image", "string").alias("image"),
        F.coalesce(texts("$.keywords"), F.array().cast("array<string>")).alias("keywords"),
    )
    good = (F.col("name_kind") == "STRING") & (F.col("ingredients_kind") == "ARRAY<STRING>") & (F.col("instructions_kind") == "ARRAY<STRING>")
    return parsed.where(good & (F.size("ingredients") > 0) & (F.size("instructions") > 0)).drop("name_kind", "ingredients_kind", "instructions_kind")
