"""Words and shingles of whole texts, as the operators of this package share them.

Tasks work on UTF-8 bytes: the separators are ASCII, so no character is ever cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BYTES = re.compile(WORD.encode())
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42


def binary(column: pa.Array) -> Iterator[bytes]:
    """The texts of a column as bytes, null as empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def words_of(text: bytes, lower: bool = True) -> list[bytes]:
    return WORD_BYTES.findall(text.translate(LOWER) if lower else text)


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, repeats included.

    Fewer words make one shingle of them all, no word makes none.
    """
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.array([digest(joined[s:e], SEED) for s, e in spans], np.uint64)
