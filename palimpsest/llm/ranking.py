"""Ranked lexical search: an automaton of all item terms runs over the texts, without an index of them.

The terms of the items make one Aho-Corasick automaton, each guarded by a boundary before and after it, so
that it matches whole terms only. It is broadcast and counts, in one pass over a text, how often each term
occurs. Of every document only these counts are kept; scores follow once document frequencies are known.
The outputs of the automaton are mapped to the items that hold the term.

Items are taken in blocks whose terms have a bounded size, each of which is one pass over the documents.
A task keeps, for each item, the best documents it has met, so at most ``depth`` rows an item leave it.

Null and empty texts have no terms: such documents don't count, such items find nothing. Rows that share
an ``item_id`` are one item, null too. Every row of the documents counts as one document; of equal scores
the smaller ``doc_id`` goes first, null last. Other columns are left out. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from palimpsest.llm.text import binary
from palimpsest.materialize import cut_lineage

DEPTH = 50
BLOCK_BYTES = 32 << 20
#: Groups by which the tasks' best documents are ranked before all of an item meet.
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GUARD = 0x20
#: Bytes of texts as the automaton reads them: boundaries are blanks, and only A to Z are lower-cased.
FOLD = bytes(
    c if c > 0x7F or chr(c).isdigit() or chr(c) in LOWER else c + 32 if chr(c) in UPPER else GUARD
    for c in range(256)
)
# Numbers held at a time while scores are added up.
CELLS = 2_000_000
#: Score sums are whole numbers below this, so adding them as doubles is exact.
EXACT = 1 << 53


def item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, term)``, each once."""
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    terms = F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(F.array_distinct(terms)).alias("term")).distinct()


@dataclass
class Block:
    """Some items: their ids, their terms, and for each term its items (``owners`` from ``starts`` on)."""

    ids: pa.Array
    terms: list[str]
    starts: np.ndarray
    owners: np.ndarray

    @staticmethod
    def of(pairs: pa.Table) -> Block:
        # The number of an item is found by value, as its id may be null or of any type.
        ids = pairs["item_id"].to_pylist()
        numbers = {item: n for n, item in enumerate(dict.fromkeys(ids))}
        by_term: dict[str, list[int]] = {}
        for item, term in zip(ids, pairs["term"].to_pylist()):
            by_term.setdefault(term, []).append(numbers[item])
        counts = [len(owners) for owners in by_term.values()]
        return Block(
            pa.array(list(numbers), pairs.schema.field("item_id").type),
            list(by_term),
            np.concatenate([[0], np.cumsum(counts)]).astype(np.int64),
            np.concatenate([*by_term.values(), []]).astype(np.int64),
        )


def _automaton(terms: list[str]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        # The bytes of a term, one character each.
        built.add_word(f" {term.encode().decode('latin-1')} ", number)
    if terms:
        built.make_automaton()
    return built


def count_terms(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``(doc_id, n, terms, tfs)``: a document's number of terms, the given ones it has and how often."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    kept = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared.value)
        for batch in batches:
            sizes, found = [], []
            for text in binary(batch.column("text")):
                folded = text.translate(FOLD)
                sizes.append(len(folded.split()))
                guarded = f" {folded.decode('latin-1')} "
                hits = map(itemgetter(1), automaton.iter(guarded)) if shared.value else ()
                found.append(Counter(hits))
            columns = [
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array([list(c) for c in found], pa.list_(pa.int32())),
                pa.array([list(c.values()) for c in found], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    added = T.StructType.fromDDL("n long, terms array<int>, tfs array<int>")
    return kept.mapInArrow(run, T.StructType([kept.schema["doc_id"], *added]))


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class _Best:
    """The best documents of every item among those a task has met."""

    def __init__(self, n_items: int, depth: int) -> None:
        self.depth = depth
        self.least = np.zeros(n_items, np.int64)
        self.kept: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.size = 0

    def offer(self, doc_ids: pa.Array, scores: np.ndarray) -> None:
        """``scores`` has a row per document and a column per item."""
        doc, item = np.nonzero((scores > 0) & (scores >= self.least))
        self.kept.append((item, doc_ids.take(pa.array(doc)), scores[doc, item]))
        self.size += len(doc)
        if self.size > max(CELLS // 4, 2 * self.depth * len(self.least)):
            self.prune()

    def prune(self) -> pa.Table:
        item, ids, score = (list(c) for c in zip(*self.kept)) if self.kept else ([], [], [])
        table = pa.table({
            "item": pa.array(np.concatenate([*item, []]).astype(np.int64)),
            "doc_id": pa.chunked_array(ids) if ids else pa.array([], pa.int64()),
            "score": pa.array(np.concatenate([*score, []]).astype(np.int64)),
        })
        order = [("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")]
        table = table.sort_by(order).combine_chunks()
        item, score = table["item"].to_numpy(), table["score"].to_numpy()
        starts = np.flatnonzero(np.diff(item, prepend=-1))
        rank = np.arange(len(item)) - np.repeat(starts, np.diff(starts, append=len(item)))
        full = np.flatnonzero(rank == self.depth - 1)
        self.least[item[full]] = score[full]
        table = table.filter(pa.array(rank < self.depth))
        ids = table["doc_id"].combine_chunks()
        self.kept = [(table["item"].to_numpy(), ids, table["score"].to_numpy())]
        self.size = len(table)
        return table


def _ranked(hits: DataFrame, block: Block, weights: np.ndarray, totals: tuple[int, int], depth: int) -> DataFrame:
    n_docs, n_terms = totals
    shared = hits.sparkSession.sparkContext.broadcast((block, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights = shared.value
        degree = np.diff(block.starts)
        n_items = len(block.ids)
        best = _Best(n_items, depth)
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            norm = 50 + (50 * sizes * n_docs) // n_terms
            lists = batch.column("terms")
            ends = np.cumsum(pc.list_value_length(lists).to_numpy())
            term = lists.flatten().to_numpy()
            tf = batch.column("tfs").flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(sizes)), np.diff(ends, prepend=0))
            value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm[doc]))
            # Documents are taken in portions of bounded work.
            work = np.cumsum(np.bincount(doc, degree[term], len(sizes)) + n_items)
            start = 0
            while start < len(sizes):
                done = work[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(work, done + CELLS)))
                part = slice(ends[start - 1] if start else 0, ends[end - 1])
                times = degree[term[part]]
                at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                item = block.owners[np.repeat(block.starts[term[part]], times) + at]
                cell = np.repeat(doc[part] - start, times) * n_items + item
                sums = np.bincount(cell, np.repeat(value[part], times), (end - start) * n_items)
                scores = sums.reshape(end - start, n_items)
                if scores.max(initial=0) >= EXACT:
                    raise OverflowError("scores are too large to be added exactly")
                best.offer(batch.column("doc_id").slice(start, end - start), scores.astype(np.int64))
                start = end
        table = best.prune()
        if len(table):
            table = table.set_column(0, "item_id", block.ids.take(table["item"]))
            yield from table.combine_chunks().to_batches()

    item_id = T.StructField("item_id", from_arrow_type(block.ids.type))
    schema = T.StructType([item_id, hits.schema["doc_id"], T.StructField("score", T.LongType())])
    return hits.mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``depth`` documents of highest score for every item."""
    pairs = cut_lineage(item_terms(items), "item-terms")
    size = pairs.agg(F.coalesce(F.sum(F.octet_length("term") + 32), F.lit(0))).first()[0]
    n_blocks = max(1, math.ceil(size / BLOCK_BYTES))
    block_of = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    found = None
    for number in range(n_blocks):
        block = Block.of(pairs.filter(block_of == number).orderBy("term").toArrow())
        hits = cut_lineage(count_terms(docs, block.terms), "term-counts")
        counted = hits.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(block.terms), np.int64)
        # One row per term of the block.
        for term, df in hits.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            weights[term] = term_weight(counted[0], df)
        ranked = _ranked(hits, block, weights, (counted[0], max(counted[1], 1)), depth)
        found = found.union(ranked) if found else ranked
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]

    def best(rows: DataFrame, *by: str | Column) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return rows.withColumn("rank", rank).filter(F.col("rank") <= depth)

    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    few = best(found, "item_id", salt).drop("rank")
    return best(few, "item_id").select("item_id", "rank", "doc_id", "score")
