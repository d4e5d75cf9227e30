"""Taxonomy tables: ``label, category, definition, example`` and the row's ``position``."""

from __future__ import annotations

import csv
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.api_pages import source_place

# The columns of a taxonomy file, whose header reads #,Category Name,Definition,Example.
TAXONOMY_SCHEMA = "label INT, category STRING, definition STRING, example STRING"


def read_taxonomy(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A taxonomy CSV with quoted commas, doubled quotes and line breaks in cells.

    Several files are read in order of their names. The position is one in all of them.
    """
    reader = spark.read.schema(TAXONOMY_SCHEMA).option("header", True).option("escape", '"')
    rows = reader.option("multiLine", True).option("enforceSchema", True).csv(path)
    return one_per_label(rows.withColumn("position", source_place()))


def bundled_taxonomy(spark: SparkSession, first_time: bool = False) -> DataFrame:
    """The sample taxonomy, read on the driver because executors may not see package files."""
    name = "taxonomy_first_time.csv" if first_time else "taxonomy.csv"
    with resources.files("palimpsest").joinpath("data", name).open(encoding="utf-8") as file:
        rows = [(int(r[0]), *r[1:], i) for i, r in enumerate(list(csv.reader(file))[1:])]
    return one_per_label(spark.createDataFrame(rows, f"{TAXONOMY_SCHEMA}, position LONG"))


def one_per_label(rows: DataFrame) -> DataFrame:
    """Of rows with the same number the last counts, at the place of the first."""
    texts = F.struct("category", "definition", "example")
    last = F.max_by(texts, "position").alias("last")
    merged = rows.groupBy("label").agg(last, F.min("position").alias("position"))
    return merged.select("label", "last.*", "position")
