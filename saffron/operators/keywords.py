"""Keyword canonicalisation: spelling, singulars, merge maps and their application to the links."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Plurals that no rule below gives, with their singulars.
IRREGULAR = {"leaves": "leaf", "loaves": "loaf", "halves": "half", "knives": "knife", "potatoes": "potato", "tomatoes": "tomato", "mangoes": "mango", "children": "child", "geese": "goose", "mice": "mouse"}


def spelled(name: Column) -> Column:
    """White space made single, words capitalised."""
    return F.initcap(F.trim(F.regexp_replace(name, r"\s+", " ")))


def singular(name: Column) -> Column:
    """The singular of the last word in lower case, by rule; null where the word is no plural."""
    by_rule = (
        F.when(name.rlike("[^aeiou]ies$"), F.regexp_replace(name, "ies$", "y"))
        .when(name.rlike("(ss|x|z|ch|sh)es$"), F.regexp_replace(name, "es$", ""))
        .when(name.rlike("[^su]s$"), F.regexp_replace(name, "s$", ""))
    )
    word = F.regexp_extract(name, r"\S+$", 0)
    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    found = F.try_element_at(irregular, word)
    return F.coalesce(F.concat(F.regexp_extract(name, r"^(.*?)\S+$", 1), found), by_rule)


def proposed(keywords: DataFrame) -> DataFrame:
    """(original, canonical) of keywords (name): another spelling, or the singular where it is a keyword itself. Of
    spellings that differ in case only the first in order stands for all."""
    named = keywords.select(F.trim(F.regexp_replace("name", r"\s+", " ")).alias("original")).distinct()
    named = named.withColumn("canonical", spelled(F.col("original"))).withColumn("key", F.lower("canonical"))
    spellings = named.groupBy("key").agg(F.min("canonical").alias("seen"))
    plural = spellings.select("key", "seen", singular(F.col("key")).alias("one"))
    singulars = plural.join(spellings.select(F.col("key").alias("one"), F.col("seen").alias("one_seen")), "one").select(F.col("seen").alias("original"), F.col("one_seen").alias("canonical"))
    respelled = named.where("original <> canonical").select("original", "canonical")
    return respelled.unionByName(singulars).groupBy("original").agg(F.max("canonical").alias("canonical"))


def resolved(merges: Mapping[str, str]) -> dict[str, str]:
    """What each name ends as when merges are applied one after the other: a later merge moves what earlier ones
    brought to its original, an earlier one knows nothing of later ones."""
    ends: dict[str, str] = {}
    for original, canonical in merges.items():
        if original == canonical:
            continue
        for name, end in ends.items():
            if end == original:
                ends[name] = canonical
        ends[original] = canonical
    return {a: b for a, b in ends.items() if a != b}


def applied(links: DataFrame, merges: DataFrame) -> DataFrame:
    """(recipe_id, keyword) with originals replaced by their canonical keyword, each once. merges: (original, canonical)."""
    moved = links.join(merges, links["keyword"] == merges["original"], "left")
    return moved.select("recipe_id", F.coalesce("canonical", "keyword").alias("keyword")).distinct()


def merged_maps(first: Column, second: Column) -> Column:
    """The union of two maps in which the second has the last word."""
    kept = F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k))
    return F.map_concat(kept, second)
