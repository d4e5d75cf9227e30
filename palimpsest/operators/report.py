"""Summary figures of the stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F


def revision_counts(revisions: DataFrame) -> DataFrame:
    """All revisions of each article, and those that hold text."""
    return revisions.groupBy("article").agg(
        F.count(F.lit(1)).alias("n_revisions"),
        F.count_if(F.length("wikitext") > 0).alias("n_with_text"),
    )


def edits_per_section(edits: DataFrame) -> DataFrame:
    return edits.groupBy("article", "section").agg(F.count(F.lit(1)).alias("n_edits"))


def sections_per_article(edits: DataFrame) -> DataFrame:
    return (
        edits_per_section(edits)
        .groupBy("article")
        .agg(F.count(F.lit(1)).alias("n_sections"), F.sum("n_edits").alias("n_edits"))
    )


def match_type_stats(linked: DataFrame) -> DataFrame:
    """Edits per match type. At most five rows reach the window over all of them."""
    counts = linked.groupBy("match_type").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("percent", F.col("n") * 100.0 / total)


def match_distance_stats(linked: DataFrame) -> DataFrame:
    distance = F.when(F.col("match_distance") > 0, F.col("match_distance"))
    return linked.agg(
        F.count(distance).alias("n_linked"),
        F.avg(distance).alias("avg_distance"),
        F.max(distance).alias("max_distance"),
    )


def linking_stats(
    edits: DataFrame, title_threshold: float, content_threshold: float, lookback: int
) -> DataFrame:
    """Edits linked and texts embedded for it, with the settings in use."""
    # Counting the embedded texts by group keeps the distinct keys spread over the cluster.
    keys = edits.groupBy("article", "rev_id", "section").agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_edits"),
        F.count(F.lit(1)).alias("n_embeddings"),
    ).select(
        "*",
        F.lit(title_threshold).alias("title_threshold"),
        F.lit(content_threshold).alias("content_threshold"),
        F.lit(lookback).alias("lookback"),
    )


def parse_rate(parsed: DataFrame) -> DataFrame:
    return parsed.agg(
        F.count_if(F.col("labels").isNotNull()).alias("n_parsed"),
        F.count(F.lit(1)).alias("n_prompts"),
    )


def failed_answers(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("labels").isNull())


MATCH_TYPES = ("first-time", "none", "title", "content", "both")


def observed_links(linked: DataFrame) -> tuple[DataFrame, Observation]:
    """``linked``, and figures of it that come with whatever run writes it.

    They are exact where no shuffle follows before the write, as for prompts: a task that is run again
    there counts once.
    """
    seen = Observation()
    distance = F.when(F.col("match_distance") > 0, F.col("match_distance"))
    types = [F.count_if(F.col("match_type") == t).alias(f"n_{t}") for t in MATCH_TYPES]
    observed = linked.observe(
        seen,
        *types,
        F.count(distance).alias("n_linked"),
        F.coalesce(F.sum(distance), F.lit(0)).alias("sum_distance"),
        F.max(distance).alias("max_distance"),
    )
    return observed, seen


def observed_answers(parsed: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation()
    n_parsed = F.count(F.when(F.col("labels").isNotNull(), 1)).alias("n_parsed")
    return parsed.observe(seen, n_parsed, F.count(F.lit(1)).alias("n_prompts")), seen


def link_figures(seen: Observation) -> dict[str, object]:
    """Match types and distances as ``match_type_stats`` and ``match_distance_stats`` count them.

    Waits for the run that the figures come from.
    """
    found = seen.get
    n = found["n_linked"]
    return {
        "types": {t: found[f"n_{t}"] for t in MATCH_TYPES if found[f"n_{t}"]},
        "n_linked": n,
        "avg_distance": found["sum_distance"] / n if n else None,
        "max_distance": found["max_distance"],
    }
