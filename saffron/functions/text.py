"""Text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_title(title: Column) -> Column:
    """What stands before the first colon, of that what stands before the first underscore, without outer blanks."""
    return F.trim(F.split_part(F.trim(F.split_part(title, F.lit(":"), F.lit(1))), F.lit("_"), F.lit(1)))


def clean_name(name: Column) -> Column:
    """Without one parenthesis at its end, unless nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(name, r"\s*\([^\)]*\)\s*$", "")), F.lit("")), name)


def capwords(text: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(text, r"\s+", " ")))


def yields(text: Column) -> Column:
    """A text that begins with a letter is capitalised, any other in lower case."""
    capital = F.concat(F.initcap(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))
    return F.when(text.rlike(r"^\p{L}"), capital).otherwise(F.lower(text))


def recipe_text(name: Column, keywords: Column, ingredients: Column) -> Column:
    """The text that is embedded: name, keywords and ingredients, empty parts left out."""
    listed = lambda c: F.nullif(F.array_join(c, ", "), F.lit(""))
    return F.concat_ws(". ", F.nullif(name, F.lit("")), listed(keywords), listed(ingredients))


def names_of(csv: Column) -> Column:
    return F.filter(F.transform(F.split(csv, ","), lambda x: F.trim(x)), lambda x: x != "")


def truncated(text: Column, n: int) -> Column:
    """n characters at most, the ellipsis among them."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 1)), F.lit("…"))).otherwise(text)


def without_fences(text: Column) -> Column:
    """A completion without code fences: a leading one marked json, a leading plain one, one at the end, in this order."""
    for fence in (r"^```json", r"^```", r"```\z"):
        text = F.regexp_replace(text, fence, "")
    return F.btrim(text, F.lit(" \n\t\r"))


def yes_or_no(text: Column) -> Column:
    """true or false for an answer yes or no, quotes and case aside; null for any other."""
    answer = F.btrim(F.lower(F.btrim(text, F.lit(" \n\t\r"))), F.lit("\"'"))
    return F.when(answer == "yes", True).when(answer == "no", False)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def normalised(path: Column) -> Column:
    """A path without empty and '.' parts, in which '..' takes back the part before it; '.' if nothing is left. A '..'
    with nothing to take back stays in a relative path and goes from one that begins at the root."""
    rooted, up = path.startswith("/"), F.lit("..")
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))

    def take(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        back = F.when(last.isNull() & rooted, done).when(last.isNull() | (last == up), F.array_append(done, part)).otherwise(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        return F.when(part == up, back).otherwise(F.array_append(done, part))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), take), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1))


def mime_type(path: Column) -> Column:
    """Fixed values: .png, .gif and .webp are images of that type, all else is image/jpeg."""
    end = extension(path)
    return F.when(end.isin(".png", ".gif", ".webp"), F.concat(F.lit("image/"), F.substr(end, F.lit(2)))).otherwise("image/jpeg")


def data_uri(path: Column, data: Column) -> Column:
    """On one line, while base64() may break its text every 76 characters."""
    return F.concat(F.lit("data:"), mime_type(path), F.lit(";base64,"), F.translate(F.base64(data), "\r\n", ""))


def with_header(name: Column, text: Column) -> Column:
    return F.concat(F.lit("--- FILE: "), name, F.lit(" ---\n"), text)


def joined_files(names: Column, texts: Column) -> Column:
    """Files under their headers with a blank line between them; names and texts run in step."""
    return F.array_join(F.zip_with(names, texts, with_header), "\n\n")


def prompt(template: str, **parts: Column) -> Column:
    """A template whose {names} are replaced by columns."""
    out = F.lit(template)
    for name, part in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(part, F.lit("")))
    return out


def query_string(params: Column) -> Column:
    """A map of parameters as a query string in the order of their names, empty ones left out."""
    kept = F.array_sort(F.map_entries(F.map_filter(params, lambda _, v: F.coalesce(v, F.lit("")) != "")))
    return F.array_join(F.transform(kept, lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"]))), "&")


def tokens_estimate(text: Column) -> Column:
    """About a token for four characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("int")


def plural_end(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def added(names: Column, n: int) -> Column:
    """The first n of a list and how many more there are."""
    return F.struct(F.slice(names, 1, n).alias("shown"), F.greatest(F.lit(0), F.size(names) - n).alias("more"))
