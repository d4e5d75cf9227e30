"""The stages in sequence: revisions to linked edits, prompts, answers and labelled edits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.materialize import cut_lineage
from palimpsest.operators.changes import section_edits
from palimpsest.operators.embed import Embed
from palimpsest.operators.labels import parse_answers
from palimpsest.operators.link import (
    CONTENT_THRESHOLD,
    LOOKBACK,
    TITLE_THRESHOLD,
    link_edits,
    link_types,
)
from palimpsest.operators.prompts import build_prompts
from palimpsest.sources.batch import (
    join_responses,
    ledger_answers,
    open_prompts,
    read_ledger,
    record_answers,
)
from palimpsest.sources.output import labelled_edits

# Bytes of prompts that a model gets at a time.
PORTION = 4 << 20


def link_revisions(
    revisions: DataFrame,
    embed: Embed,
    title_threshold: float = TITLE_THRESHOLD,
    content_threshold: float = CONTENT_THRESHOLD,
    lookback: int = LOOKBACK,
) -> DataFrame:
    """Section edits with their previous versions. Edits are written once and read three times."""
    edits = cut_lineage(section_edits(revisions), "edits", codec="zstd")
    return link_edits(edits, embed, title_threshold, content_threshold, lookback)


def link_revision_types(
    revisions: DataFrame,
    embed: Embed,
    title_threshold: float = TITLE_THRESHOLD,
    content_threshold: float = CONTENT_THRESHOLD,
    lookback: int = LOOKBACK,
) -> DataFrame:
    """What ``link_revisions`` finds, without texts: for counts of matches and prompts."""
    edits = cut_lineage(section_edits(revisions), "edits", codec="zstd")
    return link_types(edits, embed, title_threshold, content_threshold, lookback)


def prompts_for_model(
    linked: DataFrame, taxonomy: DataFrame, taxonomy_first_time: DataFrame
) -> DataFrame:
    """Prompts, written before they leave for the model so that answers stay aligned with them."""
    return cut_lineage(build_prompts(linked, taxonomy, taxonomy_first_time), "prompts", codec="zstd")


def answered(prompts: DataFrame, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """``(custom_id, response)`` from a model called on portions of prompts of about ``PORTION`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A whole batch as Python strings takes several times its room.
            step = max(1, PORTION * len(batch) // max(1, batch.nbytes))
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                answers = list(model(part.column("prompt").to_pandas()))
                response = pa.array(answers, from_pandas=True).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("custom_id"), response], ["custom_id", "response"])
            # The next batch comes when this one is gone.
            batch = part = None

    asked = prompts.select(F.col("custom_id").cast("string"), "prompt")
    return asked.mapInArrow(run, "custom_id string, response string")


def score(prompts: DataFrame, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Answers, written, since a model is costly and need not answer the same way twice."""
    return cut_lineage(answered(prompts, model), "responses")


def resumed_score(
    prompts: DataFrame, model: Callable[[pd.Series], pd.Series], ledger: str
) -> DataFrame:
    """Answers as ``score`` gives them, but only prompts that the ledger has no answer to are asked.

    A null answer counts as failed: it is noted, and its prompt is asked again in the next run.
    """
    spark = prompts.sparkSession
    open_ = cut_lineage(open_prompts(prompts, read_ledger(spark, ledger)), "open")
    responses = cut_lineage(answered(open_, model), "responses")
    failed = responses.filter(F.col("response").isNull())
    record_answers(open_, responses.filter(F.col("response").isNotNull()), ledger, failed)
    return ledger_answers(prompts, read_ledger(spark, ledger))


def label_edits(prompts: DataFrame, responses: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Published rows: every edit with its labels, or null labels where the answer is invalid."""
    answered = join_responses(prompts, responses)
    return labelled_edits(parse_answers(answered, taxonomy))
