"""The extraction workflow as a status table: what comes next for each book, decisions, and finished reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mutations import append_once, first_wins
from .ranks import ranked


def after_analysis(kind: Column) -> Column:
    return F.when(kind == "block", "extract_block").otherwise("extract_file")


def after_validation(any_image: Column, tried: Column) -> Column:
    return F.when(any_image, "resolve_images").when(~F.array_contains(tried, "block"), "await_human").otherwise("resolve_images")


def after_decision(response: Column) -> Column:
    return F.when(response == "has_images", "extract_block").otherwise("resolve_images")


def after_resolving(any_resolved: Column, response: Column, tried: Column) -> Column:
    return F.when(any_resolved, "finalise").when(response.isNotNull(), "finalise").when(~F.array_contains(tried, "block"), "await_human").otherwise("finalise")


def routed(status: DataFrame) -> DataFrame:
    """status (stage, extraction_type, any_image, any_resolved, human_response, already_tried, ...) with next_stage."""
    stage, tried = F.col("stage"), F.col("already_tried")
    return status.withColumn(
        "next_stage",
        F.when(stage == "analyse", after_analysis(F.col("extraction_type")))
        .when(stage.isin("extract_file", "extract_block"), F.lit("validate"))
        .when(stage == "validate", after_validation(F.col("any_image"), tried))
        .when(stage == "await_human", after_decision(F.col("human_response")))
        .when(stage == "resolve_images", after_resolving(F.col("any_resolved"), F.col("human_response"), tried)),
    )


def tried(status: DataFrame, method: str) -> DataFrame:
    return status.withColumn("already_tried", append_once(F.col("already_tried"), F.lit(method)))


def resumed(status: DataFrame, decisions: DataFrame) -> DataFrame:
    """Books in review take up their decision (book_id, response); those without one go on waiting."""
    joined = status.drop("human_response").join(decisions.select("book_id", F.col("response").alias("human_response")), "book_id", "left")
    return joined.withColumn("status", F.when((F.col("status") == "review") & F.col("human_response").isNotNull(), "running").otherwise(F.col("status")))


def any_image(recipes: Column) -> Column:
    return F.exists(recipes, lambda r: F.coalesce(r["image"], F.lit("")) != "")


def numbered(rows: DataFrame, report: str = "report_id") -> DataFrame:
    """Extracted rows numbered from 1 within their report by chapter and place; recipes of one title keep the first."""
    return ranked(rows, report, ["chapter", "place"], "book_order").withColumn("book_order", F.col("book_order").cast("int"))


def without_repeats(rows: DataFrame, report: str = "report_id") -> DataFrame:
    return first_wins(rows, [F.col(report), F.trim(F.lower("name"))], [F.col("chapter"), F.col("place")])


def finalised(reports: DataFrame, recipes: DataFrame, completed_at: Column) -> DataFrame:
    """Reports with the number of their recipes, done at a time that is given."""
    counts = recipes.groupBy("report_id").agg(F.count("*").cast("int").alias("_n"))
    done = reports.join(counts, reports["id"] == counts["report_id"], "left").drop("report_id")
    return done.withColumn("recipes_found", F.coalesce("_n", F.lit(0))).withColumn("completed_at", completed_at).withColumn("status", F.lit("done")).drop("_n")


def failed(reports: DataFrame, errors: DataFrame) -> DataFrame:
    """errors (id, at, error) appended to their report's list in the order of their time."""
    timed = F.array_sort(F.collect_list(F.struct("at", "error")))
    lists = errors.groupBy("id").agg(F.transform(timed, lambda e: e["error"]).alias("_more"))
    return reports.join(lists, "id", "left").withColumn("errors", F.concat("errors", F.coalesce("_more", F.array().cast("array<string>")))).drop("_more")
