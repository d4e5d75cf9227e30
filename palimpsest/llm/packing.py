"""Best-fit packing of token pieces into sequences, bettered by swaps.

Only the length of a piece matters to where it fits, so all pieces of a corpus are packed by the counts of
their lengths, of which there are no more than a sequence has tokens. Sequences that hold pieces of the same
lengths are one pattern with a number. The plan is a list of patterns, of a size that does not depend on the
corpus. First pieces go, longest first, to the fullest sequence with room for them. Then pieces of an
underfull sequence are moved to others, or swapped one for one, two for one or one for two, as long as that
increases the sum of squared fills, the emptiest sequences first, until they are empty or nothing betters.

Spark cuts and encodes the texts, counts lengths, numbers the pieces of each length, and gives each piece the
place that the plan holds for its number. Pieces of one length spread over many tasks.

Null texts are empty; they hold the end token alone. Rows that share an id are separate documents. Empty
tables give no rows. Columns that ``encode_pieces`` adds replace those of the same name.
"""

from __future__ import annotations

import base64
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.tokens import PATTERN, RANKS
from palimpsest.materialize import cut_lineage
from palimpsest.operators.ordering import number_rows

CAPACITY = 1024
END = 2
#: Fixed value: the special token that texts may spell out, and its id.
SPECIAL = {"<|endoftext|>": 50256}

Pattern = tuple[tuple[int, int], ...]
Bins = Counter[Pattern]


@lru_cache(maxsize=2)
def _coder(ranks: bytes, pattern: str, special: tuple[tuple[str, int], ...]) -> tiktoken.Encoding:
    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding(
        "pieces", pat_str=pattern, mergeable_ranks=merges, special_tokens=dict(special)
    )


def encode_pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    ranks_path: str = RANKS,
    pattern: str = PATTERN,
    special: dict[str, int] | None = None,
    end: int = END,
    text: str = "text",
) -> DataFrame:
    """The other columns of ``docs`` and ``piece, start, length, ids``, one row per piece.

    ``ids`` are unsigned 32-bit numbers, little-endian. A document of more than ``capacity`` tokens is cut
    into pieces of that size, of which the first may be shorter. The vocabulary file is read by the driver
    and broadcast; its size is fixed.
    """
    fields = T.StructType.fromDDL("piece int, start long, length int, ids binary")
    added = fields.names
    kept = docs.select(*[c for c in docs.columns if c not in (*added, text)], text)
    special = SPECIAL if special is None else special
    with open(ranks_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, pattern, tuple(special.items()))
        for batch in batches:
            row, piece, start, length, ids = [], [], [], [], []
            for i, value in enumerate(batch.column(text)):
                tokens = coder.encode(value.as_py() or "", allowed_special="all")
                data = np.array([*tokens, end], "<u4")
                cuts = [0, *range(len(data) % capacity or capacity, len(data), capacity), len(data)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    ids.append(data[a:b].tobytes())
            rest = batch.drop_columns([text]).take(pa.array(row, pa.int64()))
            columns = [
                pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int32()), pa.array(ids, pa.binary()),
            ]
            names = [*rest.schema.names, *added]
            yield pa.RecordBatch.from_arrays([*rest.columns, *columns], names)

    return kept.mapInArrow(run, T.StructType([*kept.drop(text).schema, *fields]))


def fill(pattern: Pattern) -> int:
    return sum(length * n for length, n in pattern)


def _changed(pattern: Pattern, out: tuple[int, ...], into: tuple[int, ...]) -> Pattern:
    counts = Counter(dict(pattern))
    counts.update(into)
    counts.subtract(out)
    return tuple(sorted(((length, n) for length, n in counts.items() if n), reverse=True))


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Bins:
    """Longest pieces first, each to the fullest sequence that has room."""
    by_room: dict[int, Bins] = defaultdict(Counter)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in range(length, capacity):
            # After a piece its sequence is the fullest one, so it takes as many as go in.
            most = room // length
            for pattern, number in list(by_room[room].items() if room in by_room else ()):
                for n, times in ((most, min(number, left // most)), (left % most, 1)):
                    if n and times and by_room[room][pattern] and n <= left:
                        by_room[room][pattern] -= times
                        by_room[room - n * length][(*pattern, (length, n))] += times
                        left -= n * times
                if not by_room[room][pattern]:
                    del by_room[room][pattern]
        most = capacity // length
        for n, times in ((most, left // most), (left % most, 1)):
            if n and times:
                by_room[capacity - n * length][((length, n),)] += times
    return sum(by_room.values(), Counter())


@lru_cache(1 << 16)
def _handed(pattern: Pattern) -> tuple[np.ndarray, np.ndarray, list[tuple[int, ...]]]:
    """Sums of none, one or two pieces of a sequence, how many these are, and the pieces."""
    held = dict(pattern)
    pieces = [()]
    for size in (1, 2):
        for some in combinations_with_replacement(held, size):
            if all(some.count(p) <= held[p] for p in some):
                pieces.append(some)
    return np.array([sum(p) for p in pieces]), np.array([len(p) for p in pieces]), pieces


class _Targets:
    """What every underfull sequence could give back for what it gets, as arrays to search."""

    def __init__(self, bins: Bins, capacity: int) -> None:
        self.patterns = [p for p in bins if fill(p) < capacity]
        handed = [_handed(p) for p in self.patterns]
        self.starts = np.cumsum([0, *(len(h[0]) for h in handed)])
        self.total, self.size = (np.concatenate([*(h[k] for h in handed), []]) for k in (0, 1))
        rooms = [capacity - fill(p) for p in self.patterns]
        self.room = np.repeat(rooms, np.diff(self.starts))

    def best(self, donor: Pattern, bins: Bins, capacity: int):
        """Pieces to give, the sequence that gets them and what it gives back, so that squared fill
        increases most; none if it can't."""
        top, found = 0, None
        for total, size, pieces in zip(*_handed(donor)):
            if not size:
                continue
            moved = total - self.total
            # A move, one for one, one for two, or two for one.
            allowed = (moved > 0) & (moved <= self.room) & ((size == 1) | (self.size == 1))
            gain = np.where(allowed, 2 * moved * (capacity - self.room - fill(donor) + moved), 0)
            while len(gain) and gain[k := int(np.argmax(gain))] > top:
                at = int(np.searchsorted(self.starts, k, "right")) - 1
                target = self.patterns[at]
                if bins[target] > (target == donor):
                    top = gain[k]
                    found = (pieces, target, _handed(target)[2][k - self.starts[at]])
                gain[k] = 0
        return found


def improve(bins: Bins, capacity: int = CAPACITY) -> Bins:
    """Exchanges between underfull sequences until none betters, or no fewer sequences could do.

    Every exchange increases the sum of squared fills, so there is an end.
    """
    bins = +bins
    least = -(-sum(fill(p) * n for p, n in bins.items()) // capacity)
    changed = True
    while changed and bins.total() > least:
        changed = False
        targets = _Targets(bins, capacity)
        for donor in sorted(targets.patterns, key=lambda p: (fill(p), p)):
            # Equal sequences give together, as many as have a partner.
            while donor and bins[donor] and bins.total() > least:
                found = targets.best(donor, bins, capacity)
                if found is None:
                    break
                out, target, back = found
                number = bins[donor] // 2 if donor == target else min(bins[donor], bins[target])
                bins[donor] -= number
                bins[target] -= number
                bins[_changed(target, back, out)] += number
                donor = _changed(donor, out, back)
                if donor:
                    bins[donor] += number
                bins = +bins
                changed, targets = True, _Targets(bins, capacity)
    return bins


PLAN = ("length", "first", "each", "base", "offset")


def plan_rows(bins: Bins) -> np.ndarray:
    """For each length of each pattern: the number of the first piece, pieces in a sequence, the first
    sequence and the place in it. Columns as ``PLAN``, in order of length and piece."""
    rows, used, base = [], Counter(), 0
    for pattern, number in sorted(bins.items(), reverse=True):
        offset = 0
        for length, each in pattern:
            rows.append((length, used[length], each, base, offset))
            used[length] += each * number
            offset += length * each
        base += number
    table = np.array(rows, np.int64).reshape(-1, len(PLAN))
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    ``pieces`` is written once. Its other columns are shuffled, so it should be a narrow table.
    """
    names = {c: f"_c{i}" for i, c in enumerate(pieces.columns)}
    length = names["length"]
    plain = pieces.toDF(*names.values()).withColumn("_row", F.monotonically_increasing_id())
    plain = cut_lineage(plain, "pieces")
    counts = {r[0]: r[1] for r in plain.groupBy(length).count().collect()}
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    plan = plan_rows(improve(best_fit(counts, capacity), capacity))
    numbered = number_rows(plain, [length], ["_row"], "_seq").drop("_row")
    shared = plain.sparkSession.sparkContext.broadcast((plan, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, counts = shared.value
        # Pieces of all lengths numbered in one row, shorter ones first.
        before = np.zeros(capacity + 2, np.int64)
        for size, n in counts.items():
            before[size + 1] = n
        before = np.cumsum(before)
        firsts = before[plan[:, 0]] + plan[:, 1]
        for batch in batches:
            size = batch.column(length).to_numpy().astype(np.int64)
            seq = batch.column("_seq").to_numpy()
            _, first, each, base, offset = plan[np.searchsorted(firsts, before[size] + seq, "right") - 1].T
            place = seq - first
            kept = batch.drop_columns(["_seq"])
            columns = [pa.array(base + place // each), pa.array(offset + place % each * size)]
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, *columns], [*kept.schema.names, "_sequence", "_offset"]
            )

    schema = numbered.drop("_seq").schema.add("_sequence", T.LongType()).add("_offset", T.LongType())
    placed = numbered.mapInArrow(run, schema)
    kept = [F.col(names[c]).alias(c) for c in pieces.columns if c not in ("sequence_id", "offset")]
    return placed.select(
        *kept, F.col("_sequence").alias("sequence_id"), F.col("_offset").alias("offset")
    )


def sequences(packed: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    """``(sequence_id, ids)``: the tokens of every sequence, from pieces with ``ids`` under the same key."""
    found = packed.select(*key, "sequence_id", "offset").join(ids.select(*key, "ids"), key)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda out, part: F.concat(out, part["ids"]))
    return found.groupBy("sequence_id").agg(whole.alias("ids"))
