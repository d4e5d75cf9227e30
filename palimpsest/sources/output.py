"""The published table of labelled edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = [
    "article",
    "section",
    "rev_id",
    "ts",
    "user",
    "prev_content",
    "content",
    "labels",
    "explanations",
]
# The header of the published CSV file, in the order of COLUMNS.
CSV_HEADER = [
    "Article",
    "Section",
    "Revision Id",
    "Timestamp",
    "Author",
    "Previous Section Text",
    "Edited Section Text",
    "Labels",
    "Explanations",
]
# Together these keep quotes, line breaks and spaces at cell edges.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "quoteAll": True,
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def labelled_edits(parsed: DataFrame) -> DataFrame:
    previous = F.coalesce("prev_content", F.lit(""))
    return parsed.withColumn("prev_content", previous).select(*COLUMNS)


def write_parquet(labelled: DataFrame, path: str, codec: str | None = None) -> None:
    """The typed form: labels as an array, explanations as a map. ``codec`` is that of the files, if not the session's."""
    labelled.write.parquet(path, compression=codec)


def write_csv(labelled: DataFrame, path: str) -> None:
    """The published form, labels and explanations as JSON. NULL and "" become the same."""
    flat = labelled.withColumn("labels", F.to_json("labels")).withColumn(
        "explanations", F.to_json("explanations")
    )
    flat.toDF(*CSV_HEADER).write.options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    names = zip(CSV_HEADER, COLUMNS, strict=True)
    texts = {"rev_id": "LONG", "ts": "TIMESTAMP"}
    schema = ", ".join(f"`{head}` {texts.get(c, 'STRING')}" for head, c in names)
    rows = spark.read.schema(schema).options(**CSV_OPTIONS).option("multiLine", True).csv(path)
    labels = F.from_json("labels", "array<int>")
    texts_by_key = F.from_json("explanations", "map<string,string>")
    explanations = F.transform_keys(texts_by_key, lambda key, _: key.cast("int"))
    return (
        rows.toDF(*COLUMNS).withColumn("labels", labels).withColumn("explanations", explanations)
    )
