"""Token counts of sections: each text is encoded once, and its tokens are dealt to sections by offset.

The tokenizer is a byte-level one, so the lengths of its tokens add up to the text, and every token has
a span. Spans and sections are both in order, so their interval join is a merge inside one row; a token
that crosses a boundary goes to one section by the rule asked for:

``first``    the section that has its first byte,
``last``     the section that has its last byte,
``largest``  the section that has most of its bytes, the earlier one of equals.

A token none of whose bytes lie in a section (by the rule ``first`` or ``last``: whose first or last
byte does not) counts as outside. So the counts of all sections and of what is outside add up to the
tokens of the text.

Sections are the lines of a text, each with its line feed, or come as a table of character spans that
do not overlap within a text. Null texts have no tokens; empty ones have one empty line. Sections of
ids that no text has are left out, and rows that share an id share its sections.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer cuts texts before it merges bytes.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
RULES = ("first", "last", "largest")
COUNTS = "n_tokens long, n_crossing long, n_outside long, section_tokens array<long>"


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    lengths = np.zeros(max(merges.values()) + 1, np.int64)
    for token, rank in merges.items():
        lengths[rank] = len(token)
    coder = tiktoken.Encoding(
        "given", pat_str=pattern, mergeable_ranks=merges, special_tokens={}
    )
    return coder, lengths


def _byte_offsets(text: bytes) -> np.ndarray:
    """The first byte of each character, and the end."""
    data = np.frombuffer(text, np.uint8)
    return np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))


def line_spans(text: bytes) -> np.ndarray:
    feeds = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    edges = np.concatenate([[0], feeds, [len(text)]])
    return np.column_stack([edges[:-1], edges[1:]])


def allocate(ends: np.ndarray, spans: np.ndarray, rule: str) -> tuple[int, int, np.ndarray]:
    """Tokens across a boundary, tokens outside, and tokens by section.

    ``ends`` are the ends of consecutive tokens, ``spans`` starts and ends of sections in order.
    """
    counts = np.zeros(len(spans), np.int64)
    if not len(spans):
        return 0, len(ends), counts
    begins = np.concatenate([[0], ends[:-1]])
    # Sections that end before a token and those that start before its end limit what it touches.
    low = np.searchsorted(spans[:, 1], begins, side="right")
    high = np.searchsorted(spans[:, 0], ends, side="left")
    size = ends - begins
    inside = np.minimum(spans[np.minimum(low, len(spans) - 1), 1], ends) - np.maximum(
        spans[np.minimum(low, len(spans) - 1), 0], begins
    )
    whole = (high - low == 1) & (inside == size)
    np.add.at(counts, low[whole], 1)
    crossing = outside = 0
    for k in np.flatnonzero(~whole).tolist():
        touched = [
            (min(spans[s, 1], ends[k]) - max(spans[s, 0], begins[k]), -s)
            for s in range(low[k], high[k])
            if spans[s, 0] < spans[s, 1]
        ]
        crossing += bool(touched)
        if rule == "first":
            touched = [t for t in touched if spans[-t[1], 0] <= begins[k]]
        elif rule == "last":
            touched = [t for t in touched if spans[-t[1], 1] >= ends[k]]
        if touched:
            counts[-max(touched)[1]] += 1
        else:
            outside += 1
    return crossing, outside, counts


def count_tokens(
    docs: DataFrame,
    sections: DataFrame | None = None,
    rule: str = "first",
    ranks_path: str = RANKS,
    pattern: str = PATTERN,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The columns of ``docs`` but for the text, and ``n_tokens, n_crossing, n_outside, section_tokens``.

    ``sections`` has ``start`` and ``end``, in characters, under the same id column. Their counts come
    in order of start; without the table, in order of lines. The vocabulary file is read by the driver
    and broadcast; its size is fixed.
    """
    if rule not in RULES:
        raise ValueError(f"the rule must be one of {RULES}")
    added = ["n_tokens", "n_crossing", "n_outside", "section_tokens"]
    kept = docs.select(*[c for c in docs.columns if c not in (*added, text)], text)
    by_line = sections is None
    if not by_line:
        span = F.struct(
            F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")
        )
        spans = sections.groupBy(F.col(doc_id).alias("_of")).agg(
            F.sort_array(F.collect_list(span)).alias("_spans")
        )
        kept = kept.join(spans, kept[doc_id] == spans["_of"], "left").drop("_of")
    with open(ranks_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, lengths = _encoding(shared.value, pattern)
        for batch in batches:
            found = []
            for i, value in enumerate(batch.column(text)):
                value = value.as_py()
                if value is None:
                    found.append((0, 0, 0, []))
                    continue
                raw = value.encode()
                ends = np.cumsum(lengths[coder.encode_ordinary(value)], dtype=np.int64)
                if by_line:
                    spans = line_spans(raw)
                else:
                    given = batch.column("_spans")[i].as_py() or []
                    places = _byte_offsets(raw)
                    at = np.array([(s["start"], s["end"]) for s in given], np.int64).reshape(-1, 2)
                    spans = places[np.clip(at, 0, len(places) - 1)]
                crossing, outside, counts = allocate(ends, spans, rule)
                found.append((len(ends), crossing, outside, counts.tolist()))
            rest = batch.select([c for c in batch.schema.names if c not in (text, "_spans")])
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
            columns.append(pa.array([f[3] for f in found], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, *columns], [*rest.schema.names, *added]
            )

    schema = kept.drop(text, "_spans").schema
    for field in docs.sparkSession.createDataFrame([], COUNTS).schema:
        schema = schema.add(field)
    return kept.mapInArrow(run, schema)
