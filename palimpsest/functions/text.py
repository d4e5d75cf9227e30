"""Text rules shared by the section split and the answer parser.

Spark's ``trim`` removes only U+0020 and Java's ``\\s`` is ASCII, so both the strip and the regexes
use one explicit whitespace set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code point ranges that count as whitespace, both ends included.
WHITESPACE_RANGES = [
    (0x09, 0x0D),
    (0x1C, 0x20),
    (0x85, 0x85),
    (0xA0, 0xA0),
    (0x1680, 0x1680),
    (0x2000, 0x200A),
    (0x2028, 0x2029),
    (0x202F, 0x202F),
    (0x205F, 0x205F),
    (0x3000, 0x3000),
]
WHITESPACE = "".join(chr(c) for low, high in WHITESPACE_RANGES for c in range(low, high + 1))
WS_RANGES = "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in WHITESPACE_RANGES)
WS = f"[{WS_RANGES}]"

# Whitespace within a line.
BLANK = f"[{WS_RANGES}&&[^\n]]"

# A token is a run of letters and digits, or one other character that is not whitespace.
TOKEN = rf"[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}{WS_RANGES}]"

TOP = "(Top)"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Catalyst may inline a projected column into a lambda, where it would be computed again for
    every array element. A lambda's own argument cannot be inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


# A heading is two runs of at least two equal signs, anywhere in a line and of any lengths, with the
# title between them. It is taken apart by position: one regex for all of it,
# ==+ space title space ==+, needs cubic time on a long run of spaces.


def is_heading(line: Column) -> Column:
    # The substring test is cheap and spares most lines the regex.
    return line.contains("==") & line.rlike("(?s)==.*==")


def _opening(line: Column) -> Column:
    return F.regexp_extract(line, "==+", 0)


def _after_opening(line: Column) -> Column:
    return F.substr(line, F.instr(line, "==") + F.length(_opening(line)))


def _is_closed(line: Column) -> Column:
    """Whether a second run follows. If not, a run of four or more is both: its last two close."""
    return _after_opening(line).contains("==")


def heading_title(line: Column) -> Column:
    """The text up to the second run, cut at the first slash."""
    title = F.substring_index(F.substring_index(_after_opening(line), "==", 1), "/", 1)
    return F.when(_is_closed(line), strip(title)).otherwise("")


def heading_level(line: Column) -> Column:
    """One less than the length of the opening run."""
    return F.length(_opening(line)) - F.when(_is_closed(line), 1).otherwise(3)


def level_stars(level: Column) -> Column:
    return F.repeat(F.lit("*"), level)


def clip(text: Column, max_chars: int | None) -> Column:
    """Text as it is embedded: null counts as empty, and nothing is cut unless ``max_chars`` says so."""
    whole = F.coalesce(text, F.lit(""))
    return whole if max_chars is None else F.substring(whole, 1, max_chars)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
