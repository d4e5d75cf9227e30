"""Change detection: which sections differ from the article's previous revision.

Only outlines (titles, line ranges, fingerprints) take part in ordering and comparison. Texts are
shuffled once, at the end, to fetch the bodies of the sections that did change; lines of other sections
are left out of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import bind, level_stars
from palimpsest.materialize import cut_lineage
from palimpsest.operators.ordering import SLICE, at_edges, carried, slice_by_order, slice_window
from palimpsest.operators.sections import filled, lines_of, outline, with_text

KEY = ["article"]
ANONYMOUS = "Anonymous/Bot"
# The bitmap of lines that are asked for: bits for each of them, at most (16 MB), and of one value that
# ``bitmap_construct_agg`` returns.
LINE_BITS = 16
MOST_BITS = 1 << 27
WORD_BITS = 1 << 15


def _order(df: DataFrame) -> list[str]:
    # Revisions of equal time keep their source order when the table carries it.
    return [c for c in ("ts", "rev_seq", "rev_id") if c in df.columns]


def _outlines(revisions: DataFrame) -> DataFrame:
    order = _order(revisions)
    sections = outline(F.col("wikitext")).alias("sections")
    base = F.lit(None).cast("long").alias("_base")
    return with_text(revisions).select(*KEY, *order, "user", sections, base)


def _edit_sets(outlines: DataFrame, order: list[str], slices: int | None) -> DataFrame:
    """One row per revision that changed anything: its changed sections and running edit count.

    A row with ``_base`` stands for all that came before: its sections are known, and so many edits
    were counted.
    """
    # Written first, because range bounds are sampled in a pass of their own over the input.
    sliced = slice_by_order(cut_lineage(outlines, "outlines"), KEY, order, slices)
    # The last revision of each slice is found on narrow rows before its outline is fetched.
    last = F.max(F.struct(*order)).alias("_last")
    lasts = at_edges(sliced.select(*KEY, SLICE, *order), KEY).groupBy(*KEY, SLICE).agg(last)
    lasts = lasts.select(*KEY, SLICE, "_last.*")
    lasts = lasts.select(*(F.col(c).alias(f"_{c}_last") for c in [*KEY, SLICE, *order]))
    # Times may be null.
    same = [F.col(c).eqNullSafe(F.col(f"_{c}_last")) for c in [*KEY, SLICE, *order]]
    tails = sliced.join(lasts, same).select(*KEY, SLICE, F.col("sections.mark").alias("_tail"))
    before = carried(tails, KEY, _carried=F.last("_tail"))
    window = slice_window(KEY, order)
    known = F.coalesce("_previous", "_carried", F.array().cast("array<string>"))
    upto = F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, 0))
    fresh = F.when(F.col("_base").isNull(), _not_among(known, F.col("sections")))
    changed = (
        sliced.withColumn("_previous", F.lag("sections.mark").over(window))
        .join(before, [*KEY, SLICE], "left")
        .withColumn("sections", fresh)
        .withColumn("_n", F.coalesce("_base", F.size("sections").cast("long")))
        .withColumn("_upto", upto)
        # Above the window, where the filter cannot be pushed down to compare everything twice.
        .filter("_n > 0")
        .select(*KEY, SLICE, *order, "user", "sections", "_base", "_n", "_upto")
    )
    edits = cut_lineage(changed, "edit-sets")
    sizes = at_edges(edits, KEY).groupBy(*KEY, SLICE).agg(F.sum("_n").alias("_n"))
    offsets = carried(sizes, KEY, _offset=F.sum("_n"))
    first = F.col("_upto") - F.col("_n") + F.coalesce("_offset", F.lit(0))
    return (
        edits.filter(F.col("_base").isNull())
        .join(offsets, [*KEY, SLICE], "left")
        .withColumn("_first", first)
        .withColumn("user", F.coalesce("user", F.lit(ANONYMOUS)))
        .select(*KEY, *order, "user", "sections", "_first")
    )


def _not_among(marks: Column, sections: Column) -> Column:
    """The sections whose fingerprint is not among ``marks``, by sorting both together."""
    old = F.transform(marks, lambda m: F.struct(m.alias("mark"), F.lit(-1).alias("k")))
    new = F.transform(sections, lambda s, k: F.struct(s["mark"].alias("mark"), k.alias("k")))

    def fresh(both: Column) -> Column:
        def is_fresh(entry: Column, i: Column) -> Column:
            known = F.coalesce(F.get(both, i - 1)["mark"] == entry["mark"], F.lit(False))
            return (entry["k"] >= 0) & ~known

        numbers = F.transform(F.filter(both, is_fresh), lambda entry: entry["k"])
        return F.transform(F.sort_array(numbers), lambda k: F.get(sections, k))

    return bind(F.sort_array(F.concat(old, new)), fresh)


def _rows(sets: DataFrame) -> DataFrame:
    keep = [c for c in sets.columns if c not in ("sections", "_first", *KEY)]
    # The outer form adds no filter that would compute the sections a second time.
    exploded = sets.select(*KEY, *keep, "_first", F.posexplode_outer("sections").alias("_k", "_s"))
    seq = (F.col("_first") + F.col("_k")).alias("seq")
    return exploded.select(*KEY, seq, *keep, "_s.*")


def changed_sections(revisions: DataFrame, slices: int | None = None) -> DataFrame:
    """Section edits without their texts, numbered per article in order of (time, position)."""
    sets = _edit_sets(_outlines(revisions), _order(revisions), slices)
    rows = _rows(sets).withColumnRenamed("title", "section")
    return rows.withColumn("level_stars", level_stars(F.col("level"))).drop(
        "first_line", "n_lines", "mark"
    )


def _line_bits(sets: DataFrame, key: list[str], most: int) -> np.ndarray:
    """A bitmap in which the lines of changed sections have bits. Where it is crowded, others have too."""
    lines = F.aggregate("sections", F.lit(0).cast("long"), lambda n, s: n + s["n_lines"])
    wanted = LINE_BITS * (sets.agg(F.sum(lines)).first()[0] or 0)
    bits = WORD_BITS
    while bits < min(wanted, most):
        bits *= 2
    asked = sets.select(*key, F.explode("sections").alias("_s")).filter("_s.n_lines > 0")
    line = F.sequence(F.col("_s.first_line"), F.col("_s.first_line") + F.col("_s.n_lines") - 1)
    place = _line_place(key, F.col("_line"), bits).alias("_place")
    places = asked.select(*key, F.explode(line).alias("_line")).select(place)
    word = F.floor(F.col("_place") / WORD_BITS).alias("word")
    words = places.groupBy(word).agg(F.bitmap_construct_agg(F.col("_place") % WORD_BITS).alias("bits"))
    bitmap = np.zeros((bits // WORD_BITS, WORD_BITS // 8), np.uint8)
    for row in words.collect():
        bitmap[row["word"]] = np.frombuffer(row["bits"], np.uint8)
    return bitmap.reshape(-1)


def _line_place(key: list[str], line: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(*key, line), F.lit(bits))


def _asked_lines(revisions: DataFrame, key: list[str], bitmap: np.ndarray) -> DataFrame:
    """Revisions whose texts have empty lines in place of those without a bit, so line numbers stay."""
    shared = revisions.sparkSession.sparkContext.broadcast(bitmap)
    bits = 8 * len(bitmap)

    @F.arrow_udf("array<boolean>")
    def asked(places: pa.Array) -> pa.Array:
        place = places.flatten().to_numpy()
        has_bit = shared.value[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1
        ends = np.cumsum(pc.list_value_length(places).to_numpy())
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(has_bit))

    lines = lines_of(F.col("wikitext"))
    places = F.transform(lines, lambda _, i: _line_place(key, i, bits))
    kept = F.zip_with(lines, "_asked", lambda line, yes: F.when(yes, line).otherwise(""))
    marked = revisions.withColumn("_asked", asked(places))
    return marked.withColumn("wikitext", F.array_join(kept, "\n")).drop("_asked")


def _with_bodies(sets: DataFrame, revisions: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The only shuffle of texts: they are sent to the revisions that changed anything.

    Of a text go the lines of changed sections, which a bitmap of bounded size tells, and here and there others.
    """
    # As one value the key is the same also where a part of it is null.
    names = [*KEY, *_order(revisions)]
    key = F.struct(*names).alias("_key")
    asked = _asked_lines(with_text(revisions), names, _line_bits(sets, names, most_bits))
    texts = asked.select(key, "wikitext")
    found = sets.withColumn("_key", key).join(texts, "_key")
    bodies = filled(F.col("wikitext"), F.col("sections"))
    return _rows(found.withColumn("sections", bodies).drop("wikitext", "_key"))


def section_edits(revisions: DataFrame, slices: int | None = None) -> DataFrame:
    """Section edits with their texts. Revisions of an article must differ in time, order or id."""
    sets = _edit_sets(_outlines(revisions), _order(revisions), slices)
    return _with_bodies(sets, revisions)


def late_revisions(revisions: DataFrame, state: DataFrame) -> DataFrame:
    """Revisions that are no later than the last one the state has seen of their article.

    Either they were seen before, or they came too late to be told apart by ``continue_edits``.
    """
    last = state.select(*KEY, F.col("last").alias("_last"))
    late = F.struct(*_order(revisions)) <= F.col("_last")
    return revisions.drop("wikitext").join(last, KEY).filter(late).drop("_last")


def continue_edits(
    revisions: DataFrame, state: DataFrame | None = None, slices: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Section edits of new revisions, given what is known of their articles, and the state after them.

    The state has a row per article: ``article, last, marks, n_edits``, which are the order of its last
    revision with text, the fingerprints of that one's sections, and the number of its edits. So older
    pages need not be read again: edits are found and numbered as in one run over the whole history.
    Revisions no later than ``last`` are left out; a page fetched twice does no harm.
    """
    order = _order(revisions)
    outlines = _outlines(revisions)
    if state is None:
        fields = ", ".join(f"`{c}` {revisions.schema[c].dataType.simpleString()}" for c in order)
        schema = f"article string, last struct<{fields}>, marks array<string>, n_edits long"
        state = revisions.sparkSession.createDataFrame([], schema)
    # Of the state only the articles at hand are read on.
    known = cut_lineage(state.join(outlines.select(*KEY).distinct(), KEY, "left_semi"), "known")
    last = known.select(*KEY, F.col("last").alias("_last"))
    later = F.col("_last").isNull() | (F.struct(*order) > F.col("_last"))
    fresh = outlines.join(last, KEY, "left").filter(later).drop("_last")
    fresh = cut_lineage(fresh, "fresh")
    element = outlines.schema["sections"].dataType.elementType

    def section(mark: Column) -> Column:
        values = {f.name: F.lit(None).cast(f.dataType) for f in element} | {"mark": mark}
        return F.struct(*(value.alias(name) for name, value in values.items()))

    seeds = known.select(
        *KEY,
        *(F.col("last")[c].alias(c) for c in order),
        F.lit(None).cast("string").alias("user"),
        F.transform("marks", section).alias("sections"),
        F.col("n_edits").alias("_base"),
    )
    sets = cut_lineage(_edit_sets(fresh.unionByName(seeds), order, slices), "numbered-sets")
    edits = _with_bodies(sets, revisions)
    now = fresh.groupBy(*KEY).agg(
        F.max(F.struct(*order)).alias("last"),
        F.max_by(F.col("sections.mark"), F.struct(*order)).alias("marks"),
    )
    counts = sets.groupBy(*KEY).agg(F.sum(F.size("sections")).alias("_new"))
    before = known.select(*KEY, F.col("n_edits").alias("_before"))
    total = F.coalesce("_before", F.lit(0)) + F.coalesce("_new", F.lit(0))
    touched = now.join(counts, KEY, "left").join(before, KEY, "left")
    touched = touched.select(*KEY, "last", "marks", total.cast("long").alias("n_edits"))
    rest = state.join(now.select(*KEY), KEY, "left_anti")
    return edits, rest.unionByName(touched)
