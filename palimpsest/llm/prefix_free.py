"""Exact substring deduplication across documents through prefix-free parsing.

**Parse.** Every string of ``LENGTH`` bytes has a trigger: the place in it where the rolling hash of
``GRAM`` bytes is least. Consecutive string starts with one trigger make a phrase, so the triggers parse
a text into phrases, and equal stretches of text are parsed alike. A phrase goes with the ``LENGTH - 1``
bytes after its last start, which is as far as the order of suffixes matters here, and is 80 bytes at most.

**Dictionary.** One row per different phrase, with the smallest and the greatest id of a document that
has it. Phrases whose trigger string stands in one row only are left out from the start: a count by hash
range gives bitmaps of fixed size, and where these are too small for a corpus, more is looked at.

**Suffix array of the dictionary.** Equal strings have equal triggers, so the dictionary is dealt by
trigger and its suffixes are sorted to a depth of ``LENGTH`` where they are; neighbours with that common
prefix are one string. Of each phrase remain the places whose string a document has that is smaller than
all that have the phrase. Triggers met more than ``MOST`` times don't go to one task: their suffixes
are rows, of which Spark finds the least id by string.

**Corpus order.** The documents are parsed again, and each phrase meets its dictionary row. In the order
of the corpus, documents with one phrase follow each other by id: all but the smallest lose the whole
phrase, and the smallest loses the places found above. Phrases in a large part of all documents are
salted.

A row's bytes are removed if a document with a smaller id has them. Null texts are empty. Rows with a
null id have no order: they are kept whole, and nothing is removed because of them. Rows that share an
id do not remove each other's bytes, and repeated rows get equal results. Texts of any length are cut
into overlapping pieces, so nothing is lost. An empty table gives an empty result; columns other than id
and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.text import binary
from palimpsest.materialize import cut_lineage

LENGTH = 50
GRAM = 20
WINDOW = LENGTH - GRAM + 1
# Bytes worked on at a time; positions in them must fit into PLACE.
CHUNK = 1 << 17
PLACE = np.uint64((1 << 20) - 1)
# Each bitmap has so many bits (16 MB).
FILTER_BITS = 27
# Phrases of one trigger that a task sorts at most; where there are more, suffixes become rows.
MOST = 1 << 15
# Phrases that a task counts at a time.
COUNTED = 1 << 17
# A phrase is salted if it has more than this part of all occurrences; so many phrases can be.
HOT = 1000
SALTS = 32

_draw = np.random.default_rng(50)


def _odd(n: int) -> np.ndarray:
    return _draw.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


BYTE_HASH = _draw.integers(0, 1 << 63, 256, np.uint64)
JOIN = _odd(5)
STIR = _odd(2)


class Chunk:
    """Phrases of some texts, or of a piece of a long one."""

    def __init__(self, pieces: list[tuple[int, int, bytes]]) -> None:
        """``pieces`` are ``(row, offset of the piece in its text, bytes)``, each long enough."""
        self.data = b"".join(p for _, _, p in pieces)
        data = np.frombuffer(self.data, np.uint8)
        sizes = np.array([len(p) for _, _, p in pieces])
        ends = np.cumsum(sizes)
        starts_here = np.ones(len(data), bool)
        for end in ends.tolist():
            starts_here[end - LENGTH + 1 : end] = False
        starts = np.flatnonzero(starts_here)
        grams = self._grams(data)
        least = grams & ~PLACE | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while 2 * span <= WINDOW:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < WINDOW:
            least = np.minimum(least[: span - WINDOW], least[WINDOW - span :])
        trigger = (least[starts] & PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(trigger, prepend=-1))
        self.low = starts[first]
        self.high = starts[np.append(first[1:], len(starts)) - 1]
        # Least hashes are small ones, so they are stirred once more to spread over slots and ranges.
        anchor = grams[trigger[first]] * STIR[1]
        self.anchor = anchor ^ anchor >> np.uint64(32)
        piece = np.searchsorted(ends, self.low, side="right")
        self.row = np.array([r for r, _, _ in pieces])[piece]
        self.shift = np.array([o for _, o, _ in pieces])[piece] - (ends - sizes)[piece]

    @staticmethod
    def _grams(data: np.ndarray) -> np.ndarray:
        """Hashes of all strings of GRAM bytes, put together from halves."""
        parts = {1: BYTE_HASH[data]}
        size = 1
        while 2 * size <= GRAM:
            h = parts[size]
            factor = JOIN[len(parts) - 1]
            parts[2 * size] = h[:-size] * factor + h[size:]
            size *= 2
        whole, length = parts[size], size
        for size in sorted(parts, reverse=True):
            if length + size <= GRAM:
                tail = parts[size][length:]
                whole = whole[: len(tail)] * JOIN[-1] + tail
                length += size
        whole = whole ^ whole >> np.uint64(31)
        whole *= STIR[0]
        return whole ^ whole >> np.uint64(29)

    def phrases(self, which: np.ndarray) -> list[bytes]:
        ends = (self.high[which] + LENGTH).tolist()
        return [self.data[low:end] for low, end in zip(self.low[which].tolist(), ends)]


def _chunks(texts: Iterator[bytes]) -> Iterator[Chunk]:
    pieces, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(len(text) - LENGTH + 1, 0), CHUNK // 2):
            piece = text[at : at + CHUNK // 2 + LENGTH - 1]
            if pieces and size + len(piece) > CHUNK:
                yield Chunk(pieces)
                pieces, size = [], 0
            pieces.append((row, at, piece))
            size += len(piece)
    if pieces:
        yield Chunk(pieces)


def _ranges(df: DataFrame) -> int:
    """Hash ranges, a power of two: four for each shuffle partition, and 64 at least."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << min(max(6, (4 * partitions - 1).bit_length()), FILTER_BITS - 3)


def shared_triggers(rows: DataFrame) -> np.ndarray:
    """Bitmaps of the trigger strings met in several rows, and of those met more than ``MOST`` times.

    Hashes are sorted and reduced where they are made and sent in blocks by hash range, with 32 bits of
    each that the range does not tell, and counts. Bitmaps hold a fixed number of slots, so a slot may
    also be set for another string.
    """
    ranges = _ranges(rows)
    bits = ranges.bit_length() - 1
    slots = (1 << FILTER_BITS) // ranges

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(c.anchor, c.row) for c in _chunks(binary(batch.column("text")))]
            if not found:
                continue
            key, row = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(key)
            key, row = key[order], row[order]
            first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
            several = np.maximum.reduceat(row, first) != np.minimum.reduceat(row, first)
            times = np.minimum(np.diff(np.append(first, len(key))), MOST + 1).astype(np.uint16)
            key = key[first]
            part = (key >> np.uint64(64 - bits)).astype(np.int64)
            rest = (key << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
            edges = np.searchsorted(part, np.arange(ranges + 1))
            filled = np.flatnonzero(np.diff(edges))
            blocks = [slice(edges[r], edges[r + 1]) for r in filled]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(filled),
                    pa.array([rest[b].tobytes() for b in blocks]),
                    pa.array([np.packbits(several[b], bitorder="little").tobytes() for b in blocks]),
                    pa.array([times[b].tobytes() for b in blocks]),
                ],
                ["range", "rest", "several", "times"],
            )

    def merge(table: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(b, np.uint32) for b in table["rest"].to_pylist()]
        flags = [
            np.unpackbits(np.frombuffer(f, np.uint8), count=len(b), bitorder="little")
            for b, f in zip(blocks, table["several"].to_pylist())
        ]
        rest, several = np.concatenate(blocks), np.concatenate(flags) > 0
        times = np.frombuffer(b"".join(table["times"].to_pylist()), np.uint16)
        order = np.argsort(rest)
        rest, several = rest[order], several[order]
        first = np.flatnonzero(np.diff(rest.astype(np.int64), prepend=-1))
        # Blocks come from different rows, so what is in two of them is in several.
        shared = np.logical_or.reduceat(several, first) | (np.diff(np.append(first, len(rest))) > 1)
        often = np.add.reduceat(times[order].astype(np.int64), first) > MOST
        slot = rest[first] >> np.uint32(32 - FILTER_BITS + bits)
        maps = np.zeros((2, slots), bool)
        maps[0, slot[shared]] = True
        maps[1, slot[shared & often]] = True
        packed = [np.packbits(m, bitorder="little").tobytes() for m in maps]
        return pa.table({"range": table["range"][:1], "shared": packed[:1], "often": packed[1:]})

    parts = rows.mapInArrow(emit, "range long, rest binary, several binary, times binary")
    maps = parts.groupBy("range").applyInArrow(merge, "range long, shared binary, often binary")
    bitmaps = np.zeros((2, (1 << FILTER_BITS) // 8), np.uint8)
    for row in maps.toLocalIterator():
        at = slice(row["range"] * slots // 8, (row["range"] + 1) * slots // 8)
        bitmaps[0, at] = np.frombuffer(row["shared"], np.uint8)
        bitmaps[1, at] = np.frombuffer(row["often"], np.uint8)
    return bitmaps


def _look(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    slot = key >> np.uint64(64 - FILTER_BITS)
    return bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1


def parse(rows: DataFrame, triggers: Broadcast) -> DataFrame:
    """``(phrase, doc_id, text_hash, start)`` of the phrases whose trigger is met in several rows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in _chunks(binary(batch.column("text"))):
                met = np.flatnonzero(_look(triggers.value[0], c.anchor))
                row = pa.array(c.row[met])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c.phrases(met), pa.binary()),
                        batch.column("doc_id").take(row),
                        batch.column("text_hash").take(row),
                        pa.array((c.low[met] + c.shift[met]).astype(np.int32)),
                    ],
                    ["phrase", "doc_id", "text_hash", "start"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(emit, f"phrase binary, doc_id {kind}, text_hash long, start int")


def owned_phrases(rows: DataFrame, triggers: Broadcast) -> DataFrame:
    """``(anchor, often, phrase, lo, hi, n)``: the same phrases, counted by some rows at a time.

    ``anchor`` is the hash of the trigger, and ``often`` says whether it may be met more than ``MOST`` times.
    """
    keys = ["anchor", "often", "phrase"]
    names = [*keys, "lo", "hi", "n"]

    def counted(found: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(found).group_by(keys)
        rows = rows.aggregate([("doc_id", k) for k in ("min", "max", "count")])
        rows = rows.select([*keys, "doc_id_min", "doc_id_max", "doc_id_count"]).rename_columns(names)
        yield from rows.to_batches()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = [], 0
            for c in _chunks(binary(batch.column("text"))):
                met = np.flatnonzero(_look(triggers.value[0], c.anchor))
                columns = {
                    "anchor": c.anchor[met].view(np.int64),
                    "often": _look(triggers.value[1], c.anchor[met]),
                    "phrase": pa.array(c.phrases(met), pa.binary()),
                    "doc_id": batch.column("doc_id").take(pa.array(c.row[met])),
                }
                found.append(pa.table(columns))
                size += len(met)
                if size >= COUNTED:
                    yield from counted(found)
                    found, size = [], 0
            if size:
                yield from counted(found)

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"anchor long, often boolean, phrase binary, lo {kind}, hi {kind}, n long"
    return rows.mapInArrow(emit, schema)


RUNS = "array<struct<place: int, length: int>>"


def sorted_suffixes(phrases: pa.Table) -> pa.Array:
    """Runs of each phrase, ``(place, length)``, whose strings belong to a phrase of smaller ``lo``.

    ``phrases(phrase, lo)`` hold all phrases of their triggers. The suffix array is sorted to a depth of
    ``LENGTH``, and neighbours that agree to it are one string.
    """
    values = phrases["phrase"].to_pylist()
    data = np.frombuffer(b"".join(values), np.uint8)
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    counts = sizes - LENGTH + 1
    phrase = np.repeat(np.arange(len(values)), counts)
    place = np.arange(len(phrase)) - np.repeat(np.cumsum(counts) - counts, counts)
    begins = (np.cumsum(sizes) - sizes)[phrase] + place
    strings = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[begins]
    order = np.argsort(strings.view(f"S{LENGTH}").ravel())
    ranked = strings[order]
    differs = np.ones(len(order), bool)
    differs[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    lo = pc.rank(phrases["lo"], sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
    least = np.minimum.reduceat(lo[phrase[order]], np.flatnonzero(differs))[np.cumsum(differs) - 1]
    owned = np.zeros(len(order), bool)
    owned[order] = least < lo[phrase[order]]
    run = owned & ((place == 0) | ~np.append(False, owned[:-1]))
    last = owned & ((place == counts[phrase] - 1) | ~np.append(owned[1:], False))
    low, high = place[run], place[last]
    ends = np.append(0, np.cumsum(np.bincount(phrase[run], minlength=len(values))))
    pairs = pa.StructArray.from_arrays(
        [pa.array(low, pa.int32()), pa.array(high - low + LENGTH, pa.int32())], ["place", "length"]
    )
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)


def _names() -> list[Column]:
    """The name of a phrase in 128 bits."""
    return [F.xxhash64(F.lit(seed), "phrase").alias(f"n{seed}") for seed in (1, 2)]


def dictionary(found: DataFrame) -> DataFrame:
    """``(n1, n2, lo, hi, n, runs)`` of the ``owned_phrases`` that remove something anywhere.

    ``lo`` and ``hi`` are the smallest and greatest id of a document with the phrase, ``n`` its
    occurrences, and ``runs`` the places whose string also stands in a document before ``lo``. Phrases
    cross the network once, dealt by trigger, or by themselves where the trigger is met often.
    """
    whole = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.combine_chunks()
            if len(rows):
                yield from rows.append_column("runs", sorted_suffixes(rows)).to_batches()

        held = None
        for batch in batches:
            if not len(batch):
                continue
            held = pa.concat_tables([t for t in (held, pa.Table.from_batches([batch])) if t is not None])
            anchor = held["anchor"].to_numpy()
            whole = int(np.searchsorted(anchor, anchor[-1]))
            yield from done(held.slice(0, whole))
            held = held.slice(whole)
        if held is not None:
            yield from done(held)

    dealt = found.filter(~F.col("often")).drop("often").repartition("anchor")
    dealt = dealt.groupBy("anchor", "phrase").agg(*whole).sortWithinPartitions("anchor")
    kind = found.schema["lo"].dataType.simpleString()
    schema = f"anchor long, phrase binary, lo {kind}, hi {kind}, n long, runs {RUNS}"
    few = dealt.mapInArrow(compare, schema).select(*_names(), "lo", "hi", "n", "runs")

    places = F.explode(F.sequence(F.lit(0), F.octet_length("phrase") - LENGTH)).alias("place")
    often = cut_lineage(found.filter("often").groupBy("phrase").agg(*whole), "phrases")
    many = often.select("*", places)
    many = many.withColumn("string", F.substring("phrase", F.col("place") + 1, F.lit(LENGTH)))
    least = many.groupBy("string").agg(F.min("lo").alias("least"))
    run = F.struct("place", F.lit(LENGTH).alias("length"))
    runs = F.collect_list(F.when(F.col("least") < F.col("lo"), run)).cast(RUNS).alias("runs")
    many = many.join(least, "string").groupBy(*_names(), "lo", "hi", "n").agg(runs)
    return few.unionByName(many).filter((F.col("lo") < F.col("hi")) | (F.size("runs") > 0))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text_hash, spans)``: byte spans that also stand in a document of smaller id.

    ``spans`` is an array of ``(start, length)`` that may overlap. Only rows that have any are there;
    ``text_hash`` is Spark's ``xxhash64`` of the text.
    """
    rows = docs.filter(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.col(text).alias("text"),
    )
    triggers = rows.sparkSession.sparkContext.broadcast(shared_triggers(rows))
    known = cut_lineage(dictionary(owned_phrases(rows, triggers)), "dictionary", drop_shuffles=True)
    total = known.agg(F.sum("n")).first()[0] or 0
    often = known.filter(F.col("n") * HOT > F.lit(total)).select("n1").distinct()
    often = F.col("n1").isin([row["n1"] for row in often.collect()])
    salts = F.explode(F.sequence(F.lit(0), F.when(often, SALTS - 1).otherwise(0))).alias("salt")
    salt = F.when(often, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(0)
    length = F.octet_length("phrase").alias("length")
    met = parse(rows, triggers).select(*_names(), "doc_id", "text_hash", "start", length).withColumn("salt", salt)
    met = met.join(known.select("n1", "n2", salts, "lo", "runs"), ["n1", "n2", "salt"])
    later = F.col("doc_id") > F.col("lo")
    own = F.transform(
        "runs", lambda r: F.struct((F.col("start") + r["place"]).alias("start"), r["length"].alias("length"))
    )
    spans = met.filter(later | (F.size("runs") > 0)).select(
        "doc_id", "text_hash", F.when(later, F.array(F.struct("start", "length"))).otherwise(own).alias("spans")
    )
    spans = spans.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return cut_lineage(spans, "spans", drop_shuffles=True)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept`` (binary)."""
    spans = repeated_spans(docs, doc_id, text)
    spans = spans.select(
        F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"), "spans"
    )
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    same = (F.col("doc_id") == F.col("_doc_id")) & (F.xxhash64("text") == F.col("_text_hash"))
    joined = rows.join(spans, same, "left").select(
        "doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.length").alias("lengths")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, kept = [], [], [], []
            for i, value in enumerate(binary(batch.column("text"))):
                gone = np.zeros(len(value), bool)
                starts = batch.column("starts")[i].values
                if starts is not None and len(starts):
                    low = starts.to_numpy()
                    high = low + batch.column("lengths")[i].values.to_numpy()
                    depth = np.bincount(low, minlength=len(value) + 1)
                    depth -= np.bincount(high, minlength=len(value) + 1)
                    gone = np.cumsum(depth[:-1]) > 0
                sizes.append(len(value))
                removed.append(int(gone.sum()))
                runs.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                kept.append(np.frombuffer(value, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)),
                    pa.array(kept, pa.binary()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    return joined.mapInArrow(cut, schema)
