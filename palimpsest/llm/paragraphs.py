"""Substring deduplication by paragraphs: MinHash banding, exact Jaccard, components.

A paragraph is a line with at least ``min_words`` words, which is any word if not told else. Adjacent
lines of fewer than ``WRAPPED`` words are also one paragraph together, as a passage may be wrapped in
them: first whole passages and long lines are settled, then the single lines that are left. Paragraphs with the same words are one class
from the start. A class has ``HASHES`` MinHash values over its five-word shingles, filed in bands; how
many rows a band has is tuned so that a pair at the threshold is missed with probability
``1 - recall`` at most. Classes that collide in a band are compared by exact Jaccard similarity, and
linked classes make components. Of a component, the paragraph that comes first by document id and place
stays, all others are removed from their documents.

Words are separated by ASCII white space and compared without regard to ASCII case. Classes are told
apart by 64-bit hashes. Null texts have no paragraphs. Null ids come last in order. Rows that repeat
both id and text are one document: what is removed from one is removed from all of them.

A passage may also repeat within longer paragraphs that are not similar. With ``passage``, the least number
of words of one, paragraphs have as many words, and each run of so many words that a document before has goes
too, wherever it stands. Such runs are windows that slide over the words of the whole text. A window is filed
under the MinHash of its shingles, and adjacent windows of one MinHash are a block. Windows are alike only within
a bucket of several documents: its blocks are compared as wholes by a hash of all their words and, where they
differ, window by window, so none is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import connected_components, pivot_links, shared_buckets, unsettled
from palimpsest.llm.filters import passes, permuted, value_filter
from palimpsest.llm.text import LOWER, SEED, binary
from palimpsest.materialize import cut_lineage

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.998
HASHES = 48
MIN_WORDS = 1
WRAPPED = 20
ROUNDS = 2
# Nodes of a bucket that are taken together, and columns of a matrix.
BLOCK = 1000
WIDTH = 4096
# Shingles that are worked on at a time.
STEP = 1 << 17
# Words of a text that are taken together; a line or passage is never parted.
STRETCH = 1 << 14
# Bytes of a text whose windows are taken together.
PART = 1 << 20
# Numbers for bytes, none for the space between words; a base with its inverse; joins hashes of words.
BYTES = np.random.default_rng(SEED).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BYTES[[32, *range(9, 14)]] = 0
LOWERED = BYTES[list(LOWER)]
FACTOR = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x9E3779B97F4A7C15 ^ 64)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def band_rows(threshold: float, recall: float, hashes: int) -> int:
    """The most rows a band may have if pairs at the threshold are still found so often."""
    fitting = [
        r for r in range(1, hashes + 1) if 1 - (1 - threshold**r) ** (hashes // r) >= recall
    ]
    return max(fitting, default=1)


def _class(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words), SEED)


SPACE = re.compile(rb"[\x20\x09-\x0D]")
Unit = tuple[int, int, int | None, int, int]


def _stretches(text: bytes, min_words: int) -> Iterator[tuple[list[bytes], list[Unit]]]:
    """Words of some adjacent lines, and the paragraphs in them.

    A paragraph has its first and last line, passage, and the range of its words. A line within a passage
    of several lines names the first line of it; others have no passage.
    """
    words: list[bytes] = []
    units: list[Unit] = []
    wrapped: list[tuple[int, int, int]] = []
    # Splitting bytes at white space means the same six characters as everywhere here.
    for place, line in enumerate([*text.translate(LOWER).split(b"\n"), b""]):
        own, low = line.split(), len(words)
        words += own
        if 0 < len(own) < WRAPPED:
            wrapped.append((place, low, len(words)))
            continue
        passage = wrapped[0][0] if len(wrapped) > 1 else None
        units += [(at, at, passage, a, b) for at, a, b in wrapped if b - a >= min_words]
        if passage is not None and low - wrapped[0][1] >= min_words:
            units.append((passage, wrapped[-1][0], None, wrapped[0][1], low))
        wrapped = []
        if own and len(own) >= min_words:
            units.append((place, place, None, low, len(words)))
        if len(words) >= STRETCH:
            yield words, units
            words, units = [], []
    if units:
        yield words, units


def _powers(base: np.uint64, n: int) -> np.ndarray:
    powers = np.full(n, base)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


# Powers for most stretches; longer ones make their own.
POWERS, INVERSES = _powers(BASE, 1 << 16), _powers(INVERSE, 1 << 16)


def _table(powers: np.ndarray, base: np.uint64, n: int) -> np.ndarray:
    return powers[:n] if n <= len(powers) else _powers(base, n)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """Sums of random numbers for bytes times powers by place, stirred: all words in a few passes."""
    data = np.frombuffer(b" ".join(words), np.uint8)
    return _hashes_at(BYTES[data], np.append(0, np.flatnonzero(data == 32) + 1))


def _hashes_at(numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the words that start there; white space counts for nothing."""
    n = len(numbers)
    sums = np.add.reduceat(numbers * _table(POWERS, BASE, n), starts)
    sums *= _table(INVERSES, INVERSE, n)[starts]
    return (sums ^ sums >> np.uint64(32)) * FACTOR


def _starts(data: np.ndarray) -> np.ndarray:
    """Where words start."""
    word = (data != 32) & ((data < 9) | (data > 13))
    word[1:] &= ~word[:-1].copy()
    return np.flatnonzero(word)


def _shingles(words: list[bytes]) -> np.ndarray:
    """A hash of every run of ``SHINGLE`` words, put together from hashes of the words.

    Paragraphs of the same words have the same hashes wherever they stand, so a passage and its lines
    share them.
    """
    runs = len(words) - SHINGLE + 1
    if runs < 1:
        return np.zeros(0, np.uint64)
    return _joined(_word_hashes(words), SHINGLE)


def _joined(hashes: np.ndarray, count: int) -> np.ndarray:
    """A hash of every run of ``count`` words, there being as many at least."""
    runs = len(hashes) - count + 1
    out = hashes[:runs]
    for i in range(1, count):
        out = out * FACTOR + hashes[i : i + runs]
    return out


def _least(values: np.ndarray, count: int) -> np.ndarray:
    """The least of every ``count`` adjacent values."""
    runs, width = len(values) - count + 1, 1
    while 2 * width <= count:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[:runs], values[count - width : count - width + runs])


def _windows(text: bytes, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The windows of ``size`` words, part by part: number of the first, buckets, and hashes of the words."""
    end, at, kept = 0, 0, np.zeros(0, np.uint64)
    while end < len(text):
        start, end = end, end + PART
        # A part ends where a word does.
        gap = SPACE.search(text, end) if end < len(text) else None
        end = gap.start() if gap else len(text)
        data = np.frombuffer(text, np.uint8)[start:end]
        words = _starts(data)
        if not len(words):
            continue
        hashes = _hashes_at(LOWERED[data], words)
        hashes = np.concatenate([kept, hashes]) if len(kept) else hashes
        more = max(0, len(hashes) - size + 1)
        if more:
            width, n = min(SHINGLE, size), len(hashes)
            least = _least(permuted(_joined(hashes, width), HASHES), size - width + 1)
            sums = np.append(np.uint64(0), np.cumsum(hashes * _table(POWERS, BASE, n)))
            windows = (sums[size:] - sums[:more]) * _table(INVERSES, INVERSE, n)[:more]
            yield at, permuted(least, -1), windows
        at += more
        kept = hashes[more:]


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def paragraphs(docs: DataFrame, rows: int, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, text_hash, place, last, passage, node, buckets)`` of all paragraphs.

    ``docs`` is ``(doc_id, text_hash, text)``. Paragraphs of less than a shingle are like no others, so
    they have no buckets.
    """
    bands = HASHES // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, units, ends, values, total = [], [], [0], [], 0
            for owner, text in enumerate(binary(batch.column("text"))):
                for words, found in _stretches(text, min_words):
                    shingles = _shingles(words)
                    for place, last, passage, low, high in found:
                        owners.append(owner)
                        units.append((place, last, passage, _class(words[low:high])))
                        if high - low >= SHINGLE:
                            values.append(shingles[low : high - SHINGLE + 1])
                        ends.append(len(values) * bands)
                    total += len(words)
                    if total >= STEP:
                        yield table(batch, owners, units, ends, values)
                        owners, units, ends, values, total = [], [], [0], [], 0
            if owners:
                yield table(batch, owners, units, ends, values)

    def table(
        batch: pa.RecordBatch, owners: list, units: list, ends: list, values: list
    ) -> pa.RecordBatch:
        at = pa.array(owners)
        places, lasts, passages, nodes = map(list, zip(*units))
        buckets = _buckets(values, rows, bands).view(np.int64).ravel()
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(at),
                batch.column("text_hash").take(at),
                pa.array(places, pa.int32()),
                pa.array(lasts, pa.int32()),
                pa.array(passages, pa.int32()),
                pa.array(_signed(nodes)),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(buckets)),
            ],
            ["doc_id", "text_hash", "place", "last", "passage", "node", "buckets"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, place int, last int, passage int, node long"
    return docs.mapInArrow(run, f"{schema}, buckets array<long>")


def _buckets(values: list[np.ndarray], rows: int, bands: int) -> np.ndarray:
    """One hash for each paragraph and band, from the least values of the band's permutations."""
    if not values:
        return np.empty((0, bands), np.uint64)
    hashes = np.concatenate(values)
    sizes = np.array([len(v) for v in values])
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(values), bands), np.uint64)
    for band in range(bands):
        mixed = np.full(len(values), band, np.uint64)
        for j in range(band * rows, (band + 1) * rows):
            mixed = permuted(np.minimum.reduceat(permuted(hashes, j), starts) ^ mixed, -2 - band)
        out[:, band] = mixed
    return out


def shingle_sets(docs: DataFrame, nodes: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(node, shingles)`` of the classes ``nodes(node)``, read from the texts again."""
    bits, bitmap = value_filter(nodes.select(F.col("node").alias("value")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, np.ndarray] = {}
            for text in binary(batch.column("text")):
                for words, units in _stretches(text, min_words):
                    spans = [(low, high) for *_, low, high in units if high - low >= SHINGLE]
                    classes = [_class(words[low:high]) for low, high in spans]
                    wanted = passes(np.array(classes, np.uint64), bits, bitmap.value).tolist()
                    if not any(wanted):
                        continue
                    shingles = _shingles(words)
                    for node, (low, high), want in zip(classes, spans, wanted):
                        if want and node not in found:
                            own = shingles[low : high - SHINGLE + 1]
                            found[node] = np.unique(own).view(np.int64)
            if found:
                sets = pa.array(list(found.values()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(list(found))), sets], ["node", "shingles"]
                )

    sets = docs.select("text").mapInArrow(run, "node long, shingles array<long>")
    return sets.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def linked_classes(
    docs: DataFrame, found: DataFrame, threshold: float, min_words: int = MIN_WORDS
) -> DataFrame:
    """``(node, component)`` of the classes that are similar to another one."""
    members = found.select(F.explode("buckets").alias("bucket"), "node")
    shared = cut_lineage(shared_buckets(members).distinct(), "bands", drop_shuffles=True)
    sets = shingle_sets(docs, shared.select("node").distinct(), min_words)
    sets = cut_lineage(sets, "shingles", drop_shuffles=True)

    def verify(candidates: DataFrame) -> DataFrame:
        pairs = candidates.select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        ).distinct()
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        enough = both >= F.lit(threshold) * (F.size("sa") + F.size("sb") - both) - F.lit(1e-9)
        return pairs.join(left, "a").join(right, "b").filter(enough).select("a", "b")

    links, open_ = pivot_links(shared, verify, ROUNDS)
    return connected_components(links.union(_block_links(unsettled(open_), sets, threshold)))


def _block_links(open_: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links ``(a, b)`` that join the labels of ``open_(bucket, node, label)`` within buckets.

    Buckets are cut into parts of about ``BLOCK`` nodes, and every two parts of a bucket meet in one
    block, where all similarities come from one matrix product. Of the links between two labels as
    many leave the block as join what they join.
    """
    sizes = open_.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    parts = open_.join(sizes, "bucket").withColumn("part", part)
    rows = parts.select("*", other).select(
        "bucket",
        F.least("part", "other").alias("i"),
        F.greatest("part", "other").alias("j"),
        "node",
        "label",
    )

    def link(table: pa.Table) -> pa.Table:
        nodes, back = np.unique(table["label"].to_numpy(), return_inverse=True)
        lists = table["shingles"].combine_chunks()
        size = lists.value_lengths().to_numpy()
        values, column, count = np.unique(
            lists.flatten().to_numpy(), return_inverse=True, return_counts=True
        )
        row = np.repeat(np.arange(len(size)), size)
        # Shingles of one node only are shared with none.
        number = np.cumsum(count > 1) - 1
        common = count[column] > 1
        row, column = row[common], number[column[common]]
        shared = np.zeros((len(size), len(size)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
            a, b = np.searchsorted(column, [first, first + WIDTH])
            matrix = np.zeros((len(size), WIDTH), np.float32)
            matrix[row[a:b], column[a:b] - first] = 1
            shared += matrix @ matrix.T
        total = size[:, None] + size[None, :] - shared
        near = (shared >= threshold * total - 1e-9) & (back[:, None] < back[None, :])
        parent = list(range(len(nodes)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        ids, found = table["node"].to_numpy(), []
        for x, y in zip(*np.nonzero(near)):
            low, high = root(back[x]), root(back[y])
            if low != high:
                parent[high] = low
                found.append((ids[x], ids[y]))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    given = rows.join(sets, "node").select("bucket", "i", "j", "node", "label", "shingles")
    return given.groupBy("bucket", "i", "j").applyInArrow(link, "a long, b long")


def repeated_paragraphs(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """Every line to remove: ``doc_id, text_hash, place`` and ``keeper``, the document that keeps it."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.col(text).alias("text"),
    )
    found = paragraphs(rows, band_rows(threshold, recall, HASHES), min_words)
    found = cut_lineage(found, "paragraphs", drop_shuffles=True)
    classes = linked_classes(rows, found, threshold, min_words)
    named = found.drop("buckets").join(classes, "node", "left")
    named = named.withColumn("label", F.coalesce("component", "node"))
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash", "place", "last")
    named = named.withColumn("order", order)
    ranges = named.groupBy("label").agg(
        F.min("order").alias("low"),
        F.max("order").alias("high"),
        F.min(F.when(F.col("passage").isNull(), F.col("order"))).alias("outer"),
    )
    several = ranges.filter("low <> high").select("label", "outer")
    repeats = named.join(several, "label").select("label", "outer", "order", "passage")
    repeats = cut_lineage(repeats, "repeats", drop_shuffles=True)
    # Whole passages and lines of their own: all but the first go.
    later = F.col("passage").isNull() & (F.col("order") != F.col("outer"))
    gone = repeats.filter(later & (F.col("order.place") < F.col("order.last"))).select(
        F.col("order.doc_id").alias("d"),
        F.col("order.text_hash").alias("h"),
        F.col("order.place").alias("p"),
    )
    within = (
        F.col("order.doc_id").eqNullSafe(F.col("d"))
        & (F.col("order.text_hash") == F.col("h"))
        & (F.col("passage") == F.col("p"))
    )
    # Lines of passages that stay: all but the first of what is left go.
    left = cut_lineage(repeats.join(gone.distinct(), within, "left_anti"), "left", drop_shuffles=True)
    first = left.filter(~later).groupBy("label").agg(F.min("order").alias("first"))
    single = (F.col("order.place") == F.col("order.last")) & (F.col("order") != F.col("first"))
    again = left.join(first, "label").filter(later | single)
    return again.select(
        "order.doc_id",
        "order.text_hash",
        F.explode(F.sequence("order.place", "order.last")).alias("place"),
        F.col("first.doc_id").alias("keeper"),
    )


def _blocks(buckets: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, length and hash of each run of adjacent windows in one bucket."""
    starts = np.append(0, np.flatnonzero(buckets[1:] != buckets[:-1]) + 1)
    sizes = np.diff(np.append(starts, len(buckets)))
    place = (np.arange(len(buckets)) - np.repeat(starts, sizes)) % len(POWERS)
    sums = np.add.reduceat(permuted(windows, 0) * POWERS[place], starts)
    return starts, sizes, permuted(sums ^ sizes.astype(np.uint64), -1)


def repeated_windows(rows: DataFrame, size: int) -> DataFrame:
    """``(doc_id, text_hash, at, count, keepers)`` of windows that an earlier document has.

    ``rows`` is ``(doc_id, text_hash, text)``. ``count`` windows start at word ``at`` and at those after it;
    words are numbered through the whole text.
    """
    rows = rows.withColumn("owner", F.xxhash64("doc_id", "text_hash"))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, total = [], 0
            for i, text in enumerate(binary(batch.column("text"))):
                for at, buckets, windows in _windows(text, size):
                    starts, sizes, blocks = _blocks(buckets, windows)
                    own = np.full(len(starts), i)
                    found.append((own, at + starts, sizes, buckets[starts].view(np.int64), blocks.view(np.int64)))
                    total += len(starts)
                if total >= STEP:
                    yield table(batch, found)
                    found, total = [], 0
            if found:
                yield table(batch, found)

    def table(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        own, *columns = (pa.array(np.concatenate(c)) for c in zip(*found))
        given = [batch.column(c).take(own) for c in names[:3]]
        return pa.RecordBatch.from_arrays([*given, *columns], names)

    names = ["doc_id", "text_hash", "owner", "at", "count", "bucket", "block"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in names[1:])
    filed = cut_lineage(rows.mapInArrow(file, f"doc_id {kind}, {longs}"), "blocks", drop_shuffles=True)
    ends = [f(c).alias(f"{c}_{f.__name__}") for c in ("owner", "block") for f in (F.min, F.max)]
    span = filed.groupBy("bucket").agg(*ends).filter("owner_min <> owner_max")
    span = span.select("bucket", F.expr("block_min <> block_max").alias("mixed")).hint("merge")
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")
    shared = filed.join(span, "bucket").withColumn("order", order)
    shared = cut_lineage(shared.drop("bucket", "doc_id", "text_hash", "owner"), "shared", drop_shuffles=True)
    ends = [F.min("order").alias("first"), F.max("order").alias("last")]
    firsts = cut_lineage(shared.groupBy("block", "mixed").agg(*ends), "firsts", drop_shuffles=True)
    # Where all blocks of a bucket are alike, all but those of the first document go.
    several = firsts.filter("NOT mixed AND first <> last").select("block", "first").hint("merge")
    later = shared.filter("NOT mixed").join(several, "block").filter("order <> first")
    later = later.select("order", "at", "count", F.array("first.doc_id").alias("keepers"))

    mixed = firsts.filter("mixed").drop("mixed")
    # Each block is looked at in the first document that has it.
    value = F.col("block").bitwiseXOR(F.xxhash64("first.doc_id", "first.text_hash")).alias("value")
    bits, bitmap = value_filter(mixed.select(value))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners = batch.column("owner").to_numpy().view(np.uint64)
            found, total = [], 0
            for owner, text in zip(owners, binary(batch.column("text"))):
                for _, buckets, windows in _windows(text, size):
                    _, sizes, blocks = _blocks(buckets, windows)
                    want = passes(blocks ^ owner, bits, bitmap.value)
                    if want.any():
                        found.append((blocks[want], sizes[want], windows[np.repeat(want, sizes)]))
                        total += len(found[-1][2])
                if total >= STEP:
                    yield lists(found)
                    found, total = [], 0
            if found:
                yield lists(found)

    def lists(found: list) -> pa.RecordBatch:
        blocks, sizes, inside = (np.concatenate(c).view(np.int64) for c in zip(*found))
        ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
        inside = pa.ListArray.from_arrays(pa.array(ends), pa.array(inside))
        return pa.RecordBatch.from_arrays([pa.array(blocks), inside], ["block", "windows"])

    held = rows.select("owner", "text").mapInArrow(look, "block long, windows array<long>")
    held = held.dropDuplicates(["block"]).join(mixed.hint("merge"), "block")
    held = held.select("block", "first", "last", F.posexplode("windows").alias("place", "window"))
    held = cut_lineage(held, "windows", drop_shuffles=True)
    least = held.groupBy("window").agg(F.min("first").alias("least"))
    found = held.join(least.hint("merge"), "window").filter("least <> last")
    found = found.groupBy("block").agg(F.collect_list(F.struct("place", "least")).alias("found"))
    inner = shared.filter("mixed").join(cut_lineage(found, "found", drop_shuffles=True).hint("merge"), "block")
    inner = inner.select("order", "at", F.expr("filter(found, x -> x.least < order)").alias("found"))
    # A column of its own, so that it is sorted once for a block and not for each place.
    inner = inner.withColumn("places", F.array_sort("found.place"))
    places = F.col("places")
    # Places that are adjacent go as one range.
    runs = F.arrays_zip(
        F.filter(places, lambda p, i: F.coalesce(F.get(places, i - 1) < p - 1, F.lit(True))).alias("low"),
        F.filter(places, lambda p, i: F.coalesce(F.get(places, i + 1) > p + 1, F.lit(True))).alias("high"),
    )
    keepers = F.array_distinct("found.least.doc_id").alias("keepers")
    inner = inner.select("order", "at", keepers, F.explode(runs).alias("run"))
    inner = inner.select(
        "order",
        F.expr("at + run.low").alias("at"),
        F.expr("CAST(run.high - run.low + 1 AS long)").alias("count"),
        "keepers",
    )
    return later.union(inner).select("order.doc_id", "order.text_hash", "at", "count", "keepers")


def _without(text: bytes, places: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int]:
    """The text without these lines and ranges of words and the white space after them, and how many words went."""
    data = np.frombuffer(text, np.uint8)
    words = _starts(data)
    lines = np.cumsum(data == 10)[words]
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    gone = (np.cumsum(depth)[:-1] > 0) | np.isin(lines, places)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
    cuts = np.append(words, len(data))[edges].tolist()
    return b"".join(text[a:b] for a, b in zip([0, *cuts[1::2]], [*cuts[::2], len(data)])), int(gone.sum())


def remove_passages(
    docs: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text", **how
) -> DataFrame:
    """``docs`` without paragraphs of ``size`` words or more and windows of ``size`` words that repeat."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")
    )
    added = ["_places", "_starts", "_ends"]
    none = F.lit(None).cast("long")
    again = repeated_paragraphs(docs, doc_id, text, min_words=size, **how)
    again = again.select(
        "doc_id",
        "text_hash",
        F.col("place").cast("long"),
        none.alias("at"),
        none.alias("end"),
        F.array("keeper").alias("keepers"),
    )
    end = F.col("at") + F.col("count") + (size - 1)
    inside = repeated_windows(rows, size)
    again = again.union(inside.select("doc_id", "text_hash", none, "at", end, "keepers"))
    per_doc = again.groupBy(
        F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash")
    ).agg(
        F.collect_set("place").alias("_places"),
        F.collect_list("at").alias("_starts"),
        F.collect_list("end").alias("_ends"),
        F.collect_set("keepers").alias("_keepers"),
    )
    keepers = F.sort_array(F.array_distinct(F.array_compact(F.flatten("_keepers")))).alias("keepers")
    per_doc = per_doc.select("_doc_id", "_text_hash", *added, keepers)
    per_doc = cut_lineage(per_doc, "removed", drop_shuffles=True)
    docs = docs.drop("kept_text", "n_removed", "keepers")
    same = F.col(doc_id).eqNullSafe(F.col("_doc_id")) & (F.xxhash64(text) == F.col("_text_hash"))
    joined = docs.join(per_doc, same, "left").select(
        *docs.columns,
        *added,
        F.col(text).alias("kept_text"),
        F.lit(0).cast("long").alias("n_removed"),
        F.coalesce("keepers", F.array()).alias("keepers"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts = batch.column("kept_text").cast(pa.binary()).to_pylist(), [0] * len(batch)
            found = batch.column("_places").is_valid().to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(found).tolist():
                lists = [batch.column(c)[i].values.to_numpy() for c in added]
                kept[i], counts[i] = _without(kept[i], *lists)
            left = batch.drop_columns(added)
            at = left.schema.get_field_index("kept_text")
            left = left.set_column(at, "kept_text", pa.array(kept, pa.binary()).cast(pa.string()))
            yield left.set_column(at + 1, "n_removed", pa.array(counts, pa.int64()))

    return joined.mapInArrow(run, joined.drop(*added).schema)


def remove_paragraphs(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    passage: int | None = None,
    **how,
) -> DataFrame:
    """``docs`` with ``kept_text, n_removed, keepers`` added; columns of these names are replaced.

    ``keepers`` are the ids of the documents that keep what was removed, sorted; ``n_removed`` counts
    lines or, with ``passage``, words.
    """
    if passage:
        return remove_passages(docs, passage, doc_id, text, **how)
    again = repeated_paragraphs(docs, doc_id, text, **how)
    per_doc = again.groupBy(
        F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash")
    ).agg(
        F.collect_set("place").alias("_places"),
        F.sort_array(F.collect_set("keeper")).alias("_keepers"),
    )
    docs = docs.drop("kept_text", "n_removed", "keepers")
    same = F.col(doc_id).eqNullSafe(F.col("_doc_id")) & (F.xxhash64(text) == F.col("_text_hash"))
    lines = F.split(F.col(text), "\n")
    rest = F.filter(lines, lambda line, i: ~F.array_contains("_places", i))
    kept = F.when(F.col("_places").isNull(), F.col(text)).otherwise(F.array_join(rest, "\n"))
    return docs.join(per_doc, same, "left").select(
        *docs.columns,
        kept.alias("kept_text"),
        F.coalesce(F.size("_places"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("_keepers", F.array()).alias("keepers"),
    )
