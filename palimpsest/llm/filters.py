"""MinHash permutations, and filters of bounded size that are broadcast to find rows worth joining."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A filter has so many bits for each value if not told else, and this power of two at most (16 MB).
FILTER_RATIO = 16
FILTER_BITS = 27
SLICE = 15
MOST_HASHES = 128

_draw = np.random.default_rng(20240229)
FACTORS = _draw.integers(1, 1 << 62, MOST_HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _draw.integers(1, 1 << 62, MOST_HASHES, np.uint64)


def permuted(hashes: np.ndarray, j: int) -> np.ndarray:
    mixed = (hashes ^ OFFSETS[j]) * FACTORS[j]
    return (mixed ^ (mixed >> np.uint64(31))) * FACTORS[-1 - j]


def value_filter(values: DataFrame, ratio: int = FILTER_RATIO) -> tuple[int, Broadcast]:
    """A bitmap over the top bits of ``values(value)``, and how many bits these are.

    Its size is fixed at ``2**FILTER_BITS`` bits or less. A table too large for it lets more pass, and
    what passes is joined exactly later on.
    """
    count = values.count()
    bits = int(np.clip(np.ceil(np.log2(max(count, 1) * ratio)), SLICE, FILTER_BITS))
    slot = F.shiftrightunsigned("value", 64 - bits).alias("slot")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << SLICE, bool)
        flags[group["slot"].to_numpy() & ((1 << SLICE) - 1)] = True
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "bits": [np.packbits(flags).tobytes()]})

    slots = values.select(slot).distinct().withColumn("slice", F.shiftright("slot", SLICE))
    packed = slots.groupBy("slice").applyInPandas(pack, "slice long, bits binary")
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    for row in packed.collect():
        part = np.frombuffer(row["bits"], np.uint8)
        bitmap[row["slice"] * len(part) : (row["slice"] + 1) * len(part)] = part
    return bits, values.sparkSession.sparkContext.broadcast(bitmap)


def passes(values: np.ndarray, bits: int, bitmap: np.ndarray) -> np.ndarray:
    slots = values >> np.uint64(64 - bits)
    return bitmap[slots >> np.uint64(3)] >> (~slots & np.uint64(7)).astype(np.uint8) & 1 == 1
