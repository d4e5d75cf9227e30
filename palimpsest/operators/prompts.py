"""Rendering one classification prompt per edit from a template and a taxonomy."""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("section", "article", "previous", "current", "labels")
PAGE_NAME = "{PAGE_NAME}"


def bundled_template(name: str) -> str:
    return resources.files("palimpsest").joinpath("data", f"{name}.txt").read_text("utf-8")


def render(template: str, **values: Column) -> Column:
    """Fill a template's ``{field}`` places.

    The result is put together from pieces, never by replacing in a text that already holds user
    text, so a section that contains ``{current}`` comes through unchanged.
    """
    parts = re.split("\\{(" + "|".join(FIELDS) + ")\\}", template)
    pieces = [values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)]
    return F.concat(*pieces)


def taxonomy_lines(taxonomy: DataFrame) -> Column:
    """The taxonomy in order of its numbers, as a scalar subquery: computed once, without a join."""
    rows = F.struct("label", "category", "definition", "example")
    return taxonomy.agg(F.sort_array(F.collect_list(rows)).alias("rows")).scalar()


def labels_text(rows: Column, article: Column) -> Column:
    """The taxonomy as prompt text. ``{PAGE_NAME}`` stands for the article in definitions only."""

    def line(row: Column) -> Column:
        return F.concat(
            row["label"].cast("string"),
            F.lit(". "),
            row["category"],
            F.lit(": "),
            F.replace(row["definition"], F.lit(PAGE_NAME), article),
            F.lit("\n\tExample: "),
            row["example"],
        )

    return F.array_join(F.transform(rows, line), "\n")


def is_first_time() -> Column:
    """No earlier version to compare with. A match with an empty text is still a match."""
    nothing = (F.coalesce("prev_content", F.lit("")) == "") & F.col("prev_rev_id").isNull()
    return F.coalesce(F.col("match_type").isin("first-time", "none"), F.lit(False)) | nothing


def build_prompts(
    linked: DataFrame,
    taxonomy: DataFrame,
    taxonomy_first_time: DataFrame,
    compare: str | None = None,
    first_time: str | None = None,
) -> DataFrame:
    """Add ``custom_id``, ``is_first_time`` and ``prompt`` to every linked edit."""
    compare = compare or bundled_template("compare")
    first_time = first_time or bundled_template("first_time")
    article = F.col("article")
    values = {
        "section": F.col("section"),
        "article": article,
        "previous": F.coalesce("prev_content", F.lit("")),
        "current": F.coalesce("content", F.lit("")),
    }
    prompt = F.when(
        F.col("is_first_time"),
        render(first_time, labels=labels_text(F.col("_first_rows"), article), **values),
    ).otherwise(render(compare, labels=labels_text(F.col("_rows"), article), **values))
    return (
        linked.withColumn("custom_id", custom_id())
        .withColumn("is_first_time", is_first_time())
        .withColumn("_rows", taxonomy_lines(taxonomy))
        .withColumn("_first_rows", taxonomy_lines(taxonomy_first_time))
        .withColumn("prompt", prompt)
        .drop("_rows", "_first_rows")
    )


def custom_id() -> Column:
    return F.concat(F.col("article"), F.lit("#"), F.col("seq").cast("string"))
