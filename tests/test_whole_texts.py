"""Texts are used whole, and nulls neither end a job nor change its result."""

from palimpsest.operators.changes import changed_sections
from palimpsest.operators.link import link_edits
from pyspark.sql import functions as F

EDITS = "article string, seq long, rev_id long, section string, content string"


def linked(spark, rows, vec):
    def embed(df):
        return df.withColumn("vec", vec).drop("content")

    found = link_edits(spark.createDataFrame(rows, EDITS), embed).collect()
    return {r["seq"]: r["match_type"] for r in found}


def test_texts_that_differ_late_are_different(spark):
    start = "a" * 10_000
    rows = [("x", 0, 1, "first", start + "b"), ("x", 1, 2, "second", start + "c")]
    ends = F.when(F.col("content").endswith("b"), F.array(F.lit(1.0), F.lit(0.0)))
    vec = ends.otherwise(F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>")
    assert linked(spark, rows, vec) == {0: "first-time", 1: "none"}


def test_null_vectors_match_nothing(spark):
    rows = [("x", i, i, f"{'abcd'[i]}" * 9, t) for i, t in enumerate(["p", "q", "r", "s"])]
    vec = F.when(F.col("content").isin("q", "s"), F.array(F.lit(1.0), F.lit(1.0)))
    assert linked(spark, rows, vec.cast("array<float>")) == {
        0: "first-time", 1: "none", 2: "none", 3: "content",
    }


def test_null_titles(spark):
    rows = [("x", 0, 1, None, "p"), ("x", 1, 2, None, "q"), ("x", 2, 3, "title", "q")]
    none = F.lit(None).cast("array<float>")
    assert linked(spark, rows, none) == {0: "first-time", 1: "none", 2: "content"}


def test_null_times_do_not_repeat_edits(spark):
    rows = [("x", i, None, "u", "== a ==\nsame") for i in range(400)]
    schema = "article string, rev_id long, ts timestamp, user string, wikitext string"
    frame = spark.createDataFrame(rows, schema)
    once = changed_sections(frame.filter("rev_id = 0")).count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert changed_sections(frame).count() == once
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
