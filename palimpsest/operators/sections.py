"""Splitting a revision's text into sections, row by row and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import (
    TOP,
    bind,
    heading_level,
    heading_title,
    is_heading,
    level_stars,
    strip,
)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def section_body(lines: Column, section: Column) -> Column:
    body = F.slice(lines, section["first_line"] + 1, section["n_lines"])
    return strip(F.array_join(body, "\n"))


def _located(lines: Column, heads: Column) -> Column:
    """The lead and every heading with the lines below it, in text order."""

    def section(line: Column, k: Column) -> Column:
        heading = F.get(lines, line)
        end = F.coalesce(F.get(heads, k), F.size(lines))
        return F.struct(
            F.when(line < 0, F.lit(TOP)).otherwise(heading_title(heading)).alias("title"),
            k.alias("pos"),
            F.when(line < 0, F.lit(0)).otherwise(heading_level(heading)).alias("level"),
            (line + 1).alias("first_line"),
            (end - line - 1).alias("n_lines"),
        )

    return F.transform(F.concat(F.array(F.lit(-1)), heads), section)


def _marked(lines: Column, sections: Column) -> Column:
    def marked(s: Column) -> Column:
        # A title holds no line break, so title and body can be told apart in the joined text.
        text = F.concat(s["title"], F.lit("\n"), section_body(lines, s))
        mark = F.sha2(text, 256).alias("mark")
        return F.struct(s["title"], s["pos"], s["level"], s["first_line"], s["n_lines"], mark)

    return F.transform(sections, marked)


def _one_per_title(ordered: Column) -> Column:
    """Of equal titles the last body and level count, at the position of the first."""

    def differs_from(step: int):
        def test(s: Column, i: Column) -> Column:
            return F.coalesce(F.get(ordered, i + step)["title"] != s["title"], F.lit(True))

        return test

    def merged(first: Column, last: Column) -> Column:
        rest = [last[c] for c in ("title", "level", "first_line", "n_lines", "mark")]
        return F.struct(first["pos"], *rest)

    firsts, lasts = (F.filter(ordered, differs_from(step)) for step in (-1, 1))
    return F.sort_array(F.zip_with(firsts, lasts, merged))


def outline(text: Column) -> Column:
    """The sections of a text as an array of (pos, title, level, line range, fingerprint).

    Holding line ranges instead of texts keeps the array narrow. The lead is always there.
    """

    def of_lines(lines: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(lines) - 1)
        heads = F.filter(numbers, lambda i: is_heading(F.get(lines, i)))
        sections = bind(heads, lambda h: _marked(lines, _located(lines, h)))
        return bind(F.sort_array(sections), _one_per_title)

    return bind(lines_of(text), of_lines)


def filled(text: Column, sections: Column) -> Column:
    """The outline's sections with their texts in place of the line ranges."""

    def of_lines(lines: Column) -> Column:
        def section(s: Column) -> Column:
            return F.struct(
                s["pos"],
                s["title"].alias("section"),
                s["level"],
                level_stars(s["level"]).alias("level_stars"),
                section_body(lines, s).alias("content"),
            )

        return F.transform(sections, section)

    return bind(lines_of(text), of_lines)


def with_text(revisions: DataFrame) -> DataFrame:
    """Revisions that hold any text; the others neither emit sections nor count as previous."""
    return revisions.filter(F.length("wikitext") > 0)


def split_sections(revisions: DataFrame) -> DataFrame:
    """One row per section of every revision that holds text."""
    keep = [c for c in revisions.columns if c != "wikitext"]
    text = F.col("wikitext")
    sections = bind(outline(text), lambda found: filled(text, found))
    # The outer form: the plain one would add a filter that computes the whole split again.
    return with_text(revisions).select(*keep, F.inline_outer(sections))
