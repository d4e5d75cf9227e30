"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is contained in a document if at least ``threshold`` of its distinct five-word shingles occur
there. Items are partitioned by their number of shingles into classes of sizes below ``2**c``, and for
each class the documents are covered by windows of twice that many shingles, every one overlapping
the next by half. In a window of its own class an item has a high similarity however long the document
is, so a few MinHash values find it. Any agreement of one value makes a candidate: where the item is
scattered over many windows, each adds its chance. Candidates are verified by exact containment in
the whole document.

Documents are read once. Two filters of bounded size, of the items' MinHash values and of their
shingles, are broadcast; what passes them goes into narrow tables, and all matching is joins.

Words are separated by ASCII white space and compared without regard to ASCII case. Fewer than five
words are one shingle, so such items are found in documents of just these words. Items and documents
without words match nothing. Rows with a null id take part, and repeated rows are found each; of
repeated items each is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.filters import passes, permuted, value_filter
from palimpsest.llm.text import binary, shingle_hashes, words_of
from palimpsest.materialize import cut_lineage

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 32
# A document has thousands of window values, so their filter is a sparse one.
FILTER_RATIO = 1 << 14
# Shingles that are worked on at a time.
STEP = 1 << 16


def item_sketches(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``(row, item_id, shingles, n, size_class, minima)`` of the items that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles = [
                np.unique(shingle_hashes(words_of(t), SHINGLE)) for t in binary(batch.column(text))
            ]
            minima = [
                np.array([permuted(s, j).min() for j in range(HASHES)] if len(s) else [], np.uint64)
                for s in shingles
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(item_id),
                    pa.array([s.view(np.int64) for s in shingles], pa.list_(pa.int64())),
                    pa.array([m.view(np.int64) for m in minima], pa.list_(pa.int64())),
                ],
                ["item_id", "shingles", "minima"],
            )

    kind = items.schema[item_id].dataType.simpleString()
    schema = f"item_id {kind}, shingles array<long>, minima array<long>"
    found = items.select(item_id, text).mapInArrow(run, schema)
    n = F.size("shingles").alias("n")
    size_class = F.length(F.bin(F.size("shingles").cast("long"))).alias("size_class")
    found = found.select(F.monotonically_increasing_id().alias("row"), "*", n, size_class)
    return cut_lineage(found.filter("n > 0"), "items")


def search(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``(doc_id, text_hash, item_id, n_shared, n_item)`` of all contained items.

    ``text_hash`` is Spark's ``xxhash64`` of the text: with the id it tells rows of ``docs`` apart.
    """
    items = item_sketches(items, item_id, item_text)
    classes = sorted(r[0] for r in items.select("size_class").distinct().collect())
    minima = items.select("row", "size_class", F.posexplode("minima").alias("j", "value"))
    shingles = items.select("row", F.explode("shingles").alias("value"))
    hits = _hits(docs, doc_id, text, classes, value_filter(minima, FILTER_RATIO), value_filter(shingles))
    hits = cut_lineage(hits.select(F.monotonically_increasing_id().alias("doc"), "*"), "hits")
    agreed = hits.select("doc", F.explode(F.array_distinct("minima")).alias("_m"))
    agreed = agreed.select("doc", "_m.*").join(minima, ["size_class", "j", "value"])
    candidates = cut_lineage(agreed.select("doc", "row").distinct(), "candidates")
    wanted = candidates.join(shingles, "row")
    present = hits.select("doc", F.explode("shingles").alias("value"))
    shared = wanted.join(present, ["doc", "value"]).groupBy("doc", "row").count()
    found = shared.join(items.select("row", "item_id", "n"), "row").filter(
        F.col("count") >= F.col("n") * F.lit(threshold) - F.lit(1e-9)
    )
    return found.join(hits.select("doc", "doc_id", "text_hash"), "doc").select(
        "doc_id", "text_hash", "item_id", F.col("count").alias("n_shared"), F.col("n").alias("n_item")
    )


def _hits(
    docs: DataFrame,
    doc_id: str,
    text: str,
    classes: list[int],
    minima: tuple[int, Broadcast],
    shingles: tuple[int, Broadcast],
) -> DataFrame:
    """Documents with a MinHash value that passes, with these and the shingles that pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values, sizes = [], [], []

            def flush() -> Iterator[pa.RecordBatch]:
                hashes = np.concatenate(values)
                found = _sketch_hits(hashes, np.array(sizes), classes, minima)
                ends, out = np.cumsum(sizes), []
                for k, hit in found.items():
                    own = np.unique(hashes[ends[k] - sizes[k] : ends[k]])
                    own = own[passes(own, shingles[0], shingles[1].value)]
                    out.append((rows[k], hit, own.view(np.int64).tolist()))
                if out:
                    at = pa.array([r for r, _, _ in out])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").take(at),
                            batch.column("text_hash").take(at),
                            pa.array([h for _, h, _ in out], MINIMA),
                            pa.array([s for _, _, s in out], pa.list_(pa.int64())),
                        ],
                        ["doc_id", "text_hash", "minima", "shingles"],
                    )

            total = 0
            for k, value in enumerate(binary(batch.column("text"))):
                hashes = shingle_hashes(words_of(value), SHINGLE)
                if not len(hashes):
                    continue
                rows.append(k)
                values.append(hashes)
                sizes.append(len(hashes))
                total += len(hashes)
                if total >= STEP:
                    yield from flush()
                    rows, values, sizes, total = [], [], [], 0
            if rows:
                yield from flush()

    kind = docs.schema[doc_id].dataType.simpleString()
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.col(text).alias("text"),
    )
    schema = (
        f"doc_id {kind}, text_hash long, "
        "minima array<struct<size_class: int, j: int, value: long>>, shingles array<long>"
    )
    return narrow.mapInArrow(run, schema)


MINIMA = pa.list_(
    pa.struct([("size_class", pa.int32()), ("j", pa.int32()), ("value", pa.int64())])
)


def _sketch_hits(
    hashes: np.ndarray, sizes: np.ndarray, classes: list[int], minima: tuple[int, Broadcast]
) -> dict[int, list[tuple[int, int, int]]]:
    """By position of the document: ``(size class, number of the hash, value)`` of what passes."""
    bits, bitmap = minima
    starts = np.cumsum(sizes) - sizes
    layout = []
    for size_class in classes:
        step = 1 << size_class
        blocks = -(-sizes // step)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        layout.append((size_class, starts[owner] + inner * step, owner))
    found: dict[int, list[tuple[int, int, int]]] = {}
    for j in range(HASHES):
        values = permuted(hashes, j)
        for size_class, edges, owner in layout:
            least = np.minimum.reduceat(values, edges)
            # A window is a block and the next one, if that is of the same document.
            both = least.copy()
            both[:-1] = np.where(
                owner[:-1] == owner[1:], np.minimum(least[:-1], least[1:]), least[:-1]
            )
            for at in np.flatnonzero(passes(both, bits, bitmap.value)):
                value = int(both[at : at + 1].view(np.int64)[0])
                found.setdefault(int(owner[at]), []).append((size_class, j, value))
    return found


def decontaminate(docs: DataFrame, items: DataFrame, **columns) -> DataFrame:
    """The rows of ``docs`` in which no item is contained, with all their columns, whatever their names.

    Without items, or without documents, all rows stay; null and empty texts contain nothing.
    """
    doc_id, text = columns.get("doc_id", "doc_id"), columns.get("text", "text")
    found = search(docs, items, **columns).select(
        F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash")
    )
    names = {name: f"_c{i}" for i, name in enumerate(docs.columns)}
    plain = docs.toDF(*names.values())
    same = F.col(names[doc_id]).eqNullSafe(F.col("_doc_id"))
    same &= F.xxhash64(names[text]) == F.col("_text_hash")
    return plain.join(found.distinct(), same, "left_anti").toDF(*docs.columns)
