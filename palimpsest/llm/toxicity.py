"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbouring words and pairs of words with one
between, hashed to ``1 << FEATURE_BITS`` coordinates. Words lose ASCII punctuation at their ends and
upper case. Nothing else of a row takes part.

Learning is online: each coordinate has its own rate, and the L1 term keeps a coordinate at zero until
the evidence outweighs it, so the weights that are broadcast are few, and never more than the
coordinates. The bounded training rows go through one task in hash order, once a round, and the state
between rounds is a table with one row for each coordinate met.

At most ``train_rows`` labelled rows are used, those whose ids have the smallest hashes. Labels with a
null id or mark do not count, repeated ones count each. Without any training row, every score is 0.
Empty and null texts are scored by the intercept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.text import SEED, binary, words_of
from palimpsest.materialize import cut_lineage

FEATURE_BITS = 20
TRAIN_ROWS = 20_000
ROUNDS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 1.0
FOLDS = 5
ENDS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Odd multipliers that tell the kinds of features apart.
SINGLE, PAIR, SKIP, MIX = (
    np.uint64(m)
    for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)
)
# Words whose hash a task remembers.
CACHE = 1 << 18


class Features:
    """The coordinates of a text; coordinate 0 is the intercept."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        hashes = []
        for word in words_of(text):
            value = known.get(word)
            if value is None:
                value = known[word] = xxhash.xxh64_intdigest(word.strip(ENDS), SEED)
            hashes.append(value)
        h = np.array(hashes, np.uint64)
        mixed = np.concatenate(
            [h * SINGLE, h[:-1] * PAIR ^ h[1:] * SINGLE, h[:-2] * SKIP ^ h[2:] * PAIR]
        )
        mixed ^= mixed >> np.uint64(29)
        mixed *= MIX
        slots = (mixed >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)
        return np.unique(np.append(slots, np.int32(0)))


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def _learn(rows: Iterator[tuple[bytes, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass over ``rows``, which changes ``z`` and ``n``."""
    features = Features()
    for text, label in rows:
        at = features(text)
        weights = _weights(z[at], n[at])
        gradient = _sigmoid(weights.sum()) - label
        square = gradient * gradient
        rate = (np.sqrt(n[at] + square) - np.sqrt(n[at])) / ALPHA
        z[at] += gradient - rate * weights
        n[at] += square


def learnable(doc_id: Column) -> Column:
    """Rows that may be learned from; the others are held out. A null id is never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS != 0


def train(
    docs: DataFrame,
    labels: DataFrame,
    mark: str = "toxic",
    doc_id: str = "doc_id",
    text: str = "text",
    train_rows: int = TRAIN_ROWS,
) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates with a weight, and their weights."""
    usable = labels.select(F.col(doc_id).alias("_id"), F.col(mark).cast("int").alias("_mark"))
    usable = usable.filter(learnable(F.col("_id")) & F.col("_mark").isNotNull())
    order = F.xxhash64("_id")
    drawn = cut_lineage(usable.orderBy(order, "_id", "_mark").limit(train_rows), "train-labels")
    # At most ``train_rows`` pairs of numbers are broadcast.
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    rows = texts.join(F.broadcast(drawn), "_id").select(
        order.alias("_order"), "_id", "_mark", "_text"
    )
    rows = cut_lineage(rows, "train-rows")
    state = None
    for _ in range(ROUNDS):
        state = cut_lineage(_round(rows, state), "ftrl")
    kept = state.filter(F.abs("z") > L1).orderBy("slot").toArrow()
    slots = kept["slot"].to_numpy()
    return slots, _weights(kept["z"].to_numpy(), kept["n"].to_numpy()).astype(np.float32)


def _round(rows: DataFrame, state: DataFrame | None) -> DataFrame:
    """Learns from all rows in order, starting at ``state``; returns ``(slot, z, n)``.

    The state comes to the task as rows ahead of the texts, so it never passes through the driver.
    """
    empty = {"slot": "int", "z": "double", "n": "double"}
    ahead = rows.select("*", *(F.lit(None).cast(t).alias(c) for c, t in empty.items()))
    if state is not None:
        ahead = ahead.unionByName(state, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, n = np.zeros(1 << FEATURE_BITS), np.zeros(1 << FEATURE_BITS)

        def texts() -> Iterator[tuple[bytes, int]]:
            for batch in batches:
                known = batch.filter(batch.column("slot").is_valid())
                slots = known.column("slot").to_numpy()
                z[slots] = known.column("z").to_numpy()
                n[slots] = known.column("n").to_numpy()
                rest = batch.filter(batch.column("slot").is_null())
                yield from zip(binary(rest.column("_text")), rest.column("_mark").to_pylist())

        _learn(texts(), z, n)
        slots = np.flatnonzero(n).astype(np.int32)
        for at in range(0, len(slots), 100_000):
            part = slots[at : at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(z[part]), pa.array(n[part])], ["slot", "z", "n"]
            )

    ordered = ahead.repartition(1).sortWithinPartitions(
        F.col("slot").asc_nulls_last(), "_order", "_id", "_mark", "_text"
    )
    narrow = ordered.select("_mark", "_text", "slot", "z", "n")
    return narrow.mapInArrow(run, "slot int, z double, n double")


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """Adds ``score`` to every row, from 0 to 1, replacing a column of that name."""
    slots, weights = model
    shared = docs.sparkSession.sparkContext.broadcast((slots, weights))
    docs = docs.drop("score") if text != "score" else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, weights = shared.value
        dense = np.zeros(1 << FEATURE_BITS, np.float32)
        dense[slots] = weights
        features = Features()
        for batch in batches:
            found = np.zeros(len(batch))
            if len(slots):
                for i, value in enumerate(binary(batch.column(text))):
                    found[i] = _sigmoid(dense[features(value)].sum(dtype=np.float64))
            columns = [*batch.columns, pa.array(found)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def predicted(threshold: float = 0.5) -> Column:
    return (F.col("score") >= threshold).cast("int")
