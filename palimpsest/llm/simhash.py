"""Near-duplicate documents by SimHash, linked through pigeonring filtering.

A fingerprint of 64 bits is cut into ``max_bits + 1`` segments that stand in a ring (``max_bits``
is at most 24, and three segments are the least). If two
fingerprints differ in at most ``max_bits`` bits, there is a segment from which on every chain of
consecutive segments stays within its share of the budget: ``l`` segments differ in at most
``l * max_bits / (max_bits + 1)`` bits. So the first segment of such a chain is equal, the second
differs in at most one bit and the first three in at most two. Buckets are made so that all pairs with
such a chain meet, under keys of 30 bits or more: the first two segments and a part of the third that
must be equal. The longer chains are tested on the candidates before the full Hamming distance is.

One of two segments that differ in one bit has an even number of ones, so only fingerprints of even
parity are filed under all neighbours of their second segment: about 85 narrow rows for a fingerprint.
Equal fingerprints are one node from the start.

Rows without text have fingerprint zero. A null ``doc_id`` does not count for the smallest one; where
a component has no other, its id is null. Repeated rows are returned as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import (
    across_labels,
    bucket_degrees,
    connected_components,
    pivot_links,
    shared_buckets,
)
from palimpsest.llm.text import binary, shingle_hashes, words_of
from palimpsest.materialize import cut_lineage

BITS = 64
SHINGLE = 4
MAX_BITS = 4
ROUNDS = 1
BLOCK = 2000
# Segments and kinds are numbered above the bits of a key.
KIND_BIT = 56
# Shingles whose bits are unpacked at a time.
STEP = 1 << 16


def simhash(text: bytes, shingle: int) -> int:
    """Bits that are set in over half the shingles' hashes; zero for a text without words."""
    hashes = shingle_hashes(words_of(text), shingle)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), STEP):
        part = hashes[at : at + STEP].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The other columns and ``fingerprint``, 64 bits as a long, in place of the text."""
    kept = docs.select(*[c for c in docs.columns if c not in (text, "fingerprint")], text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(t, shingle) for t in binary(batch.column(text))]
            rest = batch.drop_columns([text])
            columns = [*rest.columns, pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*rest.schema.names, "fingerprint"])

    return kept.mapInArrow(run, kept.drop(text).schema.add("fingerprint", "long"))


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """First bit and width of each segment: one more than ``max_bits``, or three."""
    count = max(3, max_bits + 1)
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


#: Kinds of bucket: how often the second segment differs, and the equal part of the third. A third
#: segment with two differences left has three parts of which one is equal; with one left, two.
KINDS = [(0, part, 3) for part in range(3)] + [(1, part, 2) for part in range(2)]


def _bucket_keys(fingerprint: Column, max_bits: int, equal_only: bool = False) -> Column:
    """Each key holds the numbers of its segment and kind, and the bits of the segments.

    With ``equal_only`` those alone whose second segment is equal too, fifteen for a fingerprint.
    """
    segments = _segments(max_bits)

    def field(start: int, size: int) -> Column:
        return F.shiftrightunsigned(fingerprint, start).bitwiseAND(F.lit((1 << size) - 1))

    keys = []
    for i, (at, width) in enumerate(segments):
        nat, nwidth = segments[(i + 1) % len(segments)]
        tat, twidth = segments[(i + 2) % len(segments)]
        second = field(nat, nwidth)
        even = F.bit_count(second) % 2 == 0
        own = F.shiftleft(field(at, width), nwidth).bitwiseOR(second)
        for number, (apart, part, parts) in enumerate(KINDS):
            if apart and equal_only:
                continue
            key = F.lit((len(KINDS) * i + number) << KIND_BIT).bitwiseOR(own)
            low, high = twidth * part // parts, twidth * (part + 1) // parts
            third = F.shiftleft(field(tat + low, high - low), width + nwidth)
            key = key.bitwiseOR(third)
            if apart:
                flips = F.array(*[key.bitwiseXOR(F.lit(1 << b)) for b in range(nwidth)])
                keys.append(F.when(even, flips).otherwise(F.array(key)))
            else:
                keys.append(F.array(key))
    return F.concat(*keys)


def _chains_hold(bucket: Column, difference: Column, max_bits: int) -> Column:
    """Whether all chains from the bucket's segment on stay within their share of the budget."""
    segments = _segments(max_bits)
    count = len(segments)
    start = F.floor(F.shiftright(bucket, KIND_BIT) / len(KINDS)).cast("int")
    holds = F.lit(True)
    for length in range(2, count + 1):
        masks = []
        for i in range(count):
            mask = 0
            for at, width in (segments[(i + k) % count] for k in range(length)):
                mask |= ((1 << width) - 1) << at
            masks.append(F.lit(_signed(mask)))
        within = difference.bitwiseAND(F.get(F.array(*masks), start))
        holds &= F.bit_count(within) <= length * max_bits // count
    return holds


def near_fingerprints(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(node, component)`` of the distinct fingerprints ``prints(node)`` that have any link.

    Large groups of near copies are tied together by pivots first. What is left to compare are pairs
    across components that share a bucket, all of which are checked.
    """

    def verify(candidates: DataFrame) -> DataFrame:
        difference = F.col("a").bitwiseXOR(F.col("b"))
        near = _chains_hold(F.col("bucket"), difference, max_bits)
        return candidates.filter(near & (F.bit_count(difference) <= max_bits))

    # The few buckets of equal segments tie most of a group together.
    first = F.explode(_bucket_keys(F.col("node"), max_bits, True)).alias("bucket")
    alike = shared_buckets(prints.select(first, "node"))
    degrees = cut_lineage(bucket_degrees(alike), "degrees")
    ranked = cut_lineage(alike.join(degrees, "node"), "ranked")
    stars, _ = pivot_links(ranked, verify, ROUNDS)
    # Of all buckets only those are looked at that hold nodes not tied together by then. Nodes bring their
    # degree along, so the many rows of these buckets are not joined for it.
    known = stars.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labelled = prints.select("node").join(known, "node", "left").join(degrees, "node", "left")
    labelled = labelled.select(
        "node", F.coalesce("label", "node").alias("label"), F.coalesce("degree", F.lit(0)).alias("degree")
    )
    keys = F.explode(_bucket_keys(F.col("node"), max_bits)).alias("bucket")
    shared = shared_buckets(cut_lineage(labelled, "labelled").select(keys, "node", "label", "degree"))
    links, open_ = pivot_links(shared, verify, ROUNDS, stars)
    rest = verify(across_labels(cut_lineage(open_, "open"), BLOCK)).select("a", "b")
    return connected_components(links.union(rest))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint``, ``cluster`` and ``component_id``.

    ``cluster`` is the least fingerprint reachable, never null; ``component_id`` the smallest id.
    """
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return cluster_fingerprints(with_fingerprint(ids, "text", shingle), max_bits)


def cluster_fingerprints(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """As ``near_duplicates``, from rows with ``doc_id`` and ``fingerprint``; keeps other columns."""
    prints = cut_lineage(prints, "fingerprints")
    nodes = prints.groupBy(F.col("fingerprint").alias("node")).agg(F.min("doc_id").alias("least"))
    nodes = cut_lineage(nodes, "nodes")
    found = near_fingerprints(nodes.select("node"), max_bits)
    linked = nodes.join(found, "node", "left")
    linked = linked.withColumn("cluster", F.coalesce("component", "node"))
    least = linked.groupBy("cluster").agg(F.min("least").alias("first"))
    named = linked.select(F.col("node").alias("fingerprint"), "cluster").join(least, "cluster")
    joined = prints.join(named, "fingerprint")
    return joined.select(*prints.columns, "cluster", F.col("first").alias("component_id"))
