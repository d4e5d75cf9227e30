"""Parsing model answers into validated labels and explanations, in column expressions only.

An answer is a JSON object of label to explanation, alone or in a ``json`` code fence. Failing that it
may be the older text form, ``Explanation: ...`` and ``Labels: 1, 5``. One unknown label rejects the
whole answer. No answer fails the job: what cannot be read is ``invalid``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import BLANK, WS, bind, strip

# This label is valid whether or not the taxonomy lists it.
NO_CHANGE = 11
# Display names of the label numbers.
LABEL_NAMES = {
    1: "New Information",
    2: "Clarification Added",
    3: "Researcher Names Added",
    4: "Technical Terms Added",
    5: "Information Removed",
    6: "Clarifications Removed",
    7: "Researcher Names Removed",
    8: "Technical Terms Removed",
    9: "Tense Change",
    10: "References Added",
    11: "Non Scientific Edit",
}

FENCE = rf"(?s)```json{WS}*\n(.*?)\n```"
_BLANK = r"[ \t\n\r]*+"
_STRING = (
    r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
)
_PAIR = f"{_STRING}{_BLANK}:{_BLANK}{_STRING}{_BLANK}"
# A flat JSON object of strings. from_json alone is more lenient than JSON.
FLAT_OBJECT = rf"^{_BLANK}\{{{_BLANK}(?:{_PAIR}(?:,{_BLANK}{_PAIR})*+)?+\}}{_BLANK}\z"
# Blank lines before a label line need no matching, which keeps long runs of them cheap.
LABEL_LINE = rf"(?imdu)^{BLANK}*+Labels?{WS}*:{WS}*(.+)$"
EXPLANATION = rf"(?isu)Explanation{WS}*:{WS}*(.+?)(?:\n{BLANK}*+Labels?{WS}*:|\z)"
NUMBERS = rf"^[0-9]++(?:{WS}++[0-9]++)*+\z"


def parse_answers(df: DataFrame, taxonomy: DataFrame, response: str = "response") -> DataFrame:
    """Add ``labels``, ``explanations`` and ``parse_status``."""
    answer = F.col(response)

    def validated(items: Column) -> Column:
        return F.when(_all_valid(items, F.col("_valid")), items)

    return (
        df.withColumn("_valid", valid_labels(taxonomy))
        .withColumn("_names", category_numbers(taxonomy))
        .withColumn("_items", bind(answer_items(answer, F.col("_names")), validated))
        .withColumn("labels", F.array_sort(F.array_distinct("_items.label")))
        .withColumn("explanations", _explanations(F.col("_items")))
        .withColumn("parse_status", F.when(F.col("labels").isNull(), "invalid").otherwise("ok"))
        .drop("_valid", "_names", "_items")
    )


def valid_labels(taxonomy: DataFrame) -> Column:
    return taxonomy.agg(F.collect_set("label")).scalar()


def category_numbers(taxonomy: DataFrame) -> Column:
    """Category name to number; of equal names the first taxonomy row counts."""
    name = F.lower(strip(F.col("category"))).alias("name")
    first = taxonomy.groupBy(name).agg(F.min_by("label", "position").alias("label"))
    return first.agg(F.map_from_entries(F.collect_list(F.struct("name", "label")))).scalar()


def answer_items(answer: Column, names: Column) -> Column:
    """An answer's (label, text) pairs in order, or null if it has neither form."""

    def read(body: Column) -> Column:
        return F.when(body.rlike(FLAT_OBJECT), _json_items(body, names)).otherwise(
            _text_items(answer)
        )

    has_fence = answer.contains("```json") & answer.rlike(FENCE)
    fenced = F.when(has_fence, F.regexp_extract(answer, FENCE, 1)).otherwise(answer)
    return bind(fenced, read)


def _json_items(body: Column, names: Column) -> Column:
    def item(pair: Column) -> Column:
        key = strip(pair["key"])
        label = F.coalesce(key.try_cast("int"), F.try_element_at(names, F.lower(key)))
        return F.struct(label.alias("label"), strip(pair["value"]).alias("text"))

    # A map read from JSON keeps repeated keys, in order, as long as it is only taken apart again.
    return F.transform(F.map_entries(F.from_json(body, "map<string,string>")), item)


def _text_items(answer: Column) -> Column:
    def cleaned(item: Column) -> Column:
        return F.rtrim(strip(item), F.lit(".;,"))

    def numbers(item: Column) -> Column:
        leading = F.array(F.regexp_extract(item, "^([0-9]+)", 1))
        return F.when(item.rlike(NUMBERS), F.split(item, f"{WS}+")).otherwise(leading)

    line = cleaned(F.regexp_extract(answer, LABEL_LINE, 1))
    items = F.filter(F.transform(F.split(line, "[,;\n]+"), cleaned), lambda i: i != "")
    found = F.transform(F.flatten(F.transform(items, numbers)), lambda n: n.try_cast("int"))
    explanation = strip(F.regexp_extract(answer, EXPLANATION, 1))

    def with_text(text: Column) -> Column:
        return F.transform(
            F.array_distinct(found), lambda n: F.struct(n.alias("label"), text.alias("text"))
        )

    return bind(explanation, with_text)


def _all_valid(items: Column, valid: Column) -> Column:
    def known(item: Column) -> Column:
        label = item["label"]
        return F.coalesce((label == NO_CHANGE) | F.array_contains(valid, label), F.lit(False))

    return (F.size(items) > 0) & F.forall(items, known)


def _explanations(items: Column) -> Column:
    """Label to text; the texts of a repeated label are joined in answer order."""

    def text(label: Column) -> Column:
        same = F.filter(items, lambda i: i["label"] == label)
        return F.array_join(F.transform(same, lambda i: i["text"]), " ")

    labels = F.array_distinct(F.transform(items, lambda i: i["label"]))
    return bind(labels, lambda found: F.map_from_arrays(found, F.transform(found, text)))


def label_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABEL_NAMES.items()), "label int, name string")


def taxonomy_names(taxonomy: DataFrame) -> DataFrame:
    """Names from the taxonomy, and the built-in name for the label that is always valid."""
    extra = label_names(taxonomy.sparkSession).filter(F.col("label") == NO_CHANGE)
    names = taxonomy.select("label", F.col("category").alias("name"))
    return names.unionByName(extra.join(names, "label", "left_anti"))
