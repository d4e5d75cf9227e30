"""Linking every edit to its most likely earlier version.

An edit looks back over the last ``lookback`` edits of its article. The newest one from another
revision that is similar in title or in content is its previous version. Edits of the lead match
only other leads, and there the newest similar content goes before the newest title.

An edit's match depends on earlier edits only, never on earlier matches, so articles are cut into
blocks of consecutive edits. Each block is sent together with the ``lookback`` edits before it to one
task, so that what belongs together is bounded by the look-back, whatever the size of the article. A
task streams through its blocks, and no pair of edits ever leaves it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import TOP
from palimpsest.materialize import cut_lineage
from palimpsest.operators.embed import Embed

TITLE_THRESHOLD = 0.8
CONTENT_THRESHOLD = 0.99
LOOKBACK = 1000
# Long blocks repeat fewer edits: with the default look-back each edit is sent 1.25 times.
MIN_BLOCK = 4000
# Rows taken at a time, how far their look-back may spread, and the size of other work arrays.
STEP = 256
MAX_COLUMNS = 8000
CELLS = 2_000_000
BAGS = 32
# Coordinates that bound the similarity of contents.
LEADING = 16
SLACK = 1e-9
# What a product of one pair costs, in products that are part of a matrix product.
SINGLE = 20

LINK_SCHEMA = "article string, seq long, prev_seq long, title_match boolean, content_match boolean"


def link_edits(
    edits: DataFrame,
    embed: Embed,
    title_threshold: float = TITLE_THRESHOLD,
    content_threshold: float = CONTENT_THRESHOLD,
    lookback: int = LOOKBACK,
) -> DataFrame:
    """Add the previous version, the match type and the distance to every edit.

    ``edits`` is read more than once, so it should be a table rather than a long plan. It needs
    ``article, seq, rev_id, section, content`` with ``seq`` counting from 0 within an article.
    Links are written, so that what the embedding shuffled is gone when texts are shuffled to be attached.
    """
    links = _links(edits, embed, title_threshold, content_threshold, lookback)
    links = cut_lineage(links, "links")
    return attach_previous(edits, links, lookback)


def link_types(
    edits: DataFrame,
    embed: Embed,
    title_threshold: float = TITLE_THRESHOLD,
    content_threshold: float = CONTENT_THRESHOLD,
    lookback: int = LOOKBACK,
) -> DataFrame:
    """``article, seq, section, rev_id, prev_seq, match_type, match_distance, is_first_time``.

    All that can be told of the links without any text: none is shuffled.
    """
    links = _links(edits, embed, title_threshold, content_threshold, lookback)
    unnamed = F.col("rev_id").isNull() & (F.coalesce(F.length("content"), F.lit(0)) == 0)
    # Of previous versions only those that say nothing and have no id change what an edit counts as.
    nothing = edits.filter(unnamed).select("article", F.col("seq").alias("prev_seq"), F.lit(True).alias("_nothing"))
    narrow = edits.select("article", "seq", "section", "rev_id")
    typed = narrow.join(links, ["article", "seq"]).select(
        *narrow.columns, "prev_seq", match_type().alias("match_type"), match_distance().alias("match_distance")
    )
    found = typed.join(nothing, ["article", "prev_seq"], "left")
    first = F.col("match_type").isin("first-time", "none") | F.col("_nothing").isNotNull()
    return found.select(*typed.columns, first.alias("is_first_time"))


def _links(
    edits: DataFrame, embed: Embed, title_threshold: float, content_threshold: float, lookback: int
) -> DataFrame:
    text_id = F.sha2(F.coalesce("content", F.lit("")), 256)
    narrow = edits.select(
        "article", "seq", "rev_id", "section", text_id.alias("text_id"), "content"
    )
    return find_previous(embed(narrow), title_threshold, content_threshold, lookback)


def blocks_of(lookback: int) -> tuple[Column, Column]:
    """The block of an edit, and whether the next block looks back on it."""
    size = max(lookback, MIN_BLOCK)
    return F.floor(F.col("seq") / size), F.pmod("seq", F.lit(size)) >= size - lookback


def find_previous(
    vectors: DataFrame, title_threshold: float, content_threshold: float, lookback: int
) -> DataFrame:
    """One row per edit: the number of its previous version, if any, and what made it match."""
    block, follows = blocks_of(lookback)
    blocks = F.when(follows, F.array(block, block + 1)).otherwise(F.array(block))
    return (
        vectors.withColumn("_own", block)
        .withColumn("_block", F.explode(blocks))
        .repartition("article", "_block")
        .sortWithinPartitions("article", "_block", "seq")
        .mapInArrow(_linker(title_threshold, content_threshold, lookback), LINK_SCHEMA)
    )


def match_type() -> Column:
    return (
        F.when(F.col("seq") == 0, "first-time")
        .when(F.col("prev_seq").isNull(), "none")
        .when(F.col("title_match") & F.col("content_match"), "both")
        .when(F.col("content_match"), "content")
        .otherwise("title")
    )


def match_distance() -> Column:
    return F.coalesce(F.col("seq") - F.col("prev_seq"), F.lit(0))


def attach_previous(edits: DataFrame, links: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Edits and their previous versions brought together by one shuffle of the texts.

    Edits go to the task of their block, and the last ones of a block also to that of the next. Links go
    to both of their ends. All that follows are windows within blocks: an edit learns its link and
    whether it is asked for; then each one asked for hands its text to those that ask.
    """
    block, follows = blocks_of(lookback)
    edit = F.struct(*edits.columns)
    link = F.struct("prev_seq", "title_match", "content_match")
    no_edit = F.lit(None).cast(edits.select(edit).schema[0].dataType)
    no_link = F.lit(None).cast(links.select(link).schema[0].dataType)

    def rows(df: DataFrame, block: Column, seq: Column, edit: Column, link: Column, own: bool) -> DataFrame:
        return df.select(
            "article", block.alias("_block"), seq.alias("_seq"), edit.alias("_edit"), link.alias("_link"),
            F.lit(own).alias("_own"),
        )

    sent = rows(edits, block, F.col("seq"), edit, no_link, True)
    # What the next block looks back on needs no more than what a previous version shows.
    shown = ("seq", "content", "rev_id", "section")
    tail = F.struct(
        *(
            (F.col(c) if c in shown else F.lit(None).cast(edits.schema[c].dataType)).alias(c)
            for c in edits.columns
        )
    )
    sent = sent.union(rows(edits.filter(follows), block + 1, F.col("seq"), tail, no_link, False))
    sent = sent.union(rows(links, block, F.col("seq"), no_edit, link, True))
    asks = links.filter(F.col("prev_seq").isNotNull())
    sent = sent.union(rows(asks, block, F.col("prev_seq"), no_edit, no_link, False))
    gathered = sent.repartition("article", "_block")
    same = Window.partitionBy("article", "_block", "_seq")
    asked = F.max(F.col("_edit").isNull() & F.col("_link").isNull()).over(same)
    told = gathered.withColumn("_asked", asked).withColumn("_told", F.max("_link").over(same))
    told = told.filter(F.col("_edit").isNotNull())
    # An edit that is asked for stands under its own number, one that asks under that of the other.
    previous = F.struct(F.col("_edit.content"), F.col("_edit.rev_id"), F.col("_edit.section"))
    offers = F.when(F.col("_asked"), F.array(F.struct(F.col("_seq").alias("at"), F.lit(0).alias("kind"))))
    at = F.coalesce(F.col("_told.prev_seq"), F.lit(-1) - F.col("_seq"))
    takes = F.when(F.col("_own"), F.array(F.struct(at.alias("at"), F.lit(1).alias("kind"))))
    none = F.array().cast("array<struct<at: long, kind: int>>")
    both = F.concat(F.coalesce(offers, none), F.coalesce(takes, none))
    met = told.withColumn("_place", F.explode(both))
    offered = F.when(F.col("_place.kind") == 0, previous)
    hand = Window.partitionBy("article", "_block", "_place.at")
    first = hand.orderBy("_place.kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    handed = met.withColumn("_previous", F.first(offered).over(first)).filter("_place.kind = 1")
    return handed.select("_edit.*", "_told.*", "_previous").select(
        *edits.columns,
        F.col("_previous.content").alias("prev_content"),
        F.col("_previous.rev_id").alias("prev_rev_id"),
        F.col("_previous.section").alias("prev_section"),
        match_type().alias("match_type"),
        match_distance().alias("match_distance"),
    )


Batches = Iterator[pa.RecordBatch]


def _linker(
    title_threshold: float, content_threshold: float, lookback: int
) -> Callable[[Batches], Batches]:
    """Links blocks that arrive one after the other, each in order. Small ones are taken together."""

    def link_all(batches: Batches) -> Batches:
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest else table
            # The last block may go on in the next batch.
            end = int(_block_starts(table)[-1])
            rest = table.slice(end)
            if end:
                yield from link(table.slice(0, end)).to_batches()
        if rest:
            yield from link(rest).to_batches()

    def link(table: pa.Table) -> pa.Table:
        starts = _block_starts(table)
        group = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(table)))
        seq = table["seq"].to_numpy()
        rev = table["rev_id"].to_numpy()
        text = _codes(table["text_id"])[0]
        title, titles = _codes(table["section"])
        top = np.array([t == TOP for t in titles])[title]
        unit = _unit_rows(table["vec"], len(seq))
        own = np.flatnonzero(table["_own"].to_numpy() == table["_block"].to_numpy())
        # An article's last edits are also sent on to a block that may hold no edits of its own.
        found = [(own[:0], own[:0], top[:0], top[:0])]
        start = 0
        while start < len(own):
            # All that a row may look back on lies between its reach within its block and itself.
            first = starts[group[own[start]]]
            reach = seq[own[start]] - lookback
            low = first + np.searchsorted(seq[first : own[start]], reach)
            end = np.searchsorted(own, low + MAX_COLUMNS)
            rows = own[start : min(max(end, start + 1), start + STEP)]
            start += len(rows)
            near = slice(low, rows[-1] + 1)
            now, lead = seq[rows, None], top[rows]
            allowed = (group[near] == group[rows, None]) & (seq[near] < now)
            allowed &= (seq[near] >= now - lookback) & (rev[near] != rev[rows, None])
            allowed &= top[near] | ~lead[:, None]
            same = text[near] == text[rows, None]
            similar, _ = similar_contents(unit[rows], unit[near], allowed, same, content_threshold)
            by_content = _newest(similar)
            codes, local = np.unique(title[near], return_inverse=True)
            by_title = newest_similar_titles(
                np.searchsorted(codes, title[rows]),
                _newest_by_title(allowed, local),
                by_content - 1,
                [titles[c] for c in codes],
                title_threshold,
            )
            # Leads share their title by definition, and a similar text outranks a newer lead.
            by_title = np.where(lead, _newest(allowed), by_title)
            pick = np.maximum(by_content, by_title)
            pick = np.where(lead & (by_content >= 0), by_content, pick)
            at = np.where(pick >= 0, pick + low, -1)
            found.append((rows, at, lead | (pick == by_title), pick == by_content))
        rows, pick, title_match, content_match = (np.concatenate(c) for c in zip(*found))
        return pa.table(
            {
                "article": table["article"].take(rows),
                "seq": seq[rows],
                "prev_seq": pa.array(seq[pick], mask=pick < 0),
                "title_match": title_match & (pick >= 0),
                "content_match": content_match & (pick >= 0),
            }
        )

    return link_all


def _block_starts(table: pa.Table) -> np.ndarray:
    """The first row of every block; rows of a block follow each other."""
    article = _codes(table["article"])[0]
    block = table["_block"].to_numpy()
    return np.flatnonzero(np.diff(article, prepend=-1) | np.diff(block, prepend=-1))


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list[str]]:
    encoded = column.combine_chunks().fill_null("").dictionary_encode()
    return encoded.indices.to_numpy(), encoded.dictionary.to_pylist()


def _unit_rows(column: pa.ChunkedArray, n: int) -> np.ndarray:
    """Unit vectors; a null one counts as zero. All others must have the same length."""
    lists = column.combine_chunks()
    sizes = np.unique(lists.drop_null().value_lengths().to_numpy())
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes.tolist()}")
    width = int(sizes[0]) if len(sizes) else 0
    vectors = np.zeros((n, width))
    known = lists.is_valid().to_numpy(zero_copy_only=False)
    if width:
        vectors[known] = lists.drop_null().flatten().to_numpy().reshape(-1, width)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def similar_contents(
    a: np.ndarray, b: np.ndarray, allowed: np.ndarray, same: np.ndarray, threshold: float
) -> tuple[np.ndarray, int]:
    """Which allowed pairs have the same text or reach the cosine, and how many products that took.

    ``a`` and ``b`` hold unit vectors or zeros. The product over a few leading coordinates and the
    lengths of what is left bound the whole one from above (Cauchy-Schwarz), so only pairs that can reach
    the threshold are multiplied in full.
    """
    similar = allowed & same if threshold <= 1 else np.zeros_like(allowed)
    open_ = allowed & ~same
    if a.shape[1] > 2 * LEADING:
        left = [np.sqrt(np.square(x[:, LEADING:]).sum(axis=1)) for x in (a, b)]
        bound = a[:, :LEADING] @ b[:, :LEADING].T + left[0][:, None] * left[1]
        # Rounding must not decide.
        open_ &= bound >= threshold - SLACK
    some, others = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    count = int(np.count_nonzero(open_))
    if count * SINGLE > len(some) * len(others):
        block = np.ix_(some, others)
        similar[block] |= open_[block] & (a[some] @ b[others].T >= threshold)
        return similar, len(some) * len(others)
    rows, columns = np.nonzero(open_)
    step = max(1, CELLS // max(a.shape[1], 1))
    for at in range(0, count, step):
        i, j = rows[at : at + step], columns[at : at + step]
        similar[i, j] = np.einsum("ij,ij->i", a[i], b[j]) >= threshold
    return similar, count


def _newest(matches: np.ndarray) -> np.ndarray:
    """The last true column of each row, or -1."""
    last = matches.shape[1] - 1 - np.argmax(matches[:, ::-1], axis=1)
    return np.where(matches.any(axis=1), last, -1)


def _newest_by_title(allowed: np.ndarray, title: np.ndarray) -> np.ndarray:
    """For each row the last allowed column of every title, or -1."""
    order = np.argsort(title, kind="stable")
    starts = np.flatnonzero(np.diff(title[order], prepend=-1))
    columns = np.where(allowed, np.arange(allowed.shape[1]), -1)
    return np.maximum.reduceat(columns[:, order], starts, axis=1)


def newest_similar_titles(
    current: np.ndarray, last: np.ndarray, floor: np.ndarray, titles: list[str], threshold: float
) -> np.ndarray:
    """For each row the newest column whose title is similar to the row's own, or -1.

    ``last`` holds the newest column of every title; columns up to ``floor`` need not be found. Titles
    are tried from the newest on, so a row is done with its first match.
    """
    encoded = _encoded(titles)
    lengths = encoded[1]
    longer = np.maximum(lengths[current, None], lengths)
    gap = np.abs(lengths[current, None] - lengths)
    bound = np.where(longer > 0, 1 - gap / np.maximum(longer, 1), 0.0)
    same = np.where(lengths[current] > 0, 1.0, 0.0) >= threshold
    found = np.where(same, last[np.arange(len(current)), current], -1)
    possible = (last > np.maximum(floor, found)[:, None]) & (bound >= threshold)
    order = np.argsort(np.where(possible, -last, 1), axis=1)
    count = possible.sum(axis=1)
    start, width = 0, 8
    open_rows = np.flatnonzero(count)
    while len(open_rows):
        tried = order[open_rows, start : start + width]
        real = np.arange(start, start + tried.shape[1]) < count[open_rows, None]
        row, column = np.nonzero(real)
        similar = np.zeros(tried.shape, bool)
        pairs = current[open_rows[row]], tried[row, column]
        similar[row, column] = similar_titles(encoded, *pairs, threshold)
        hit = similar.any(axis=1)
        match = tried[hit, similar[hit].argmax(axis=1)]
        found[open_rows[hit]] = last[open_rows[hit], match]
        start, width = start + width, 2 * width
        open_rows = open_rows[~hit & (count[open_rows] > start)]
    return found


Encoded = tuple[list[np.ndarray], np.ndarray, np.ndarray]


def similar_titles(
    encoded: Encoded, i: np.ndarray, j: np.ndarray, threshold: float
) -> np.ndarray:
    """Which pairs of titles reach the similarity ``1 - edits / longer length``."""
    points, lengths, bags = encoded
    pairs, back = np.unique(i.astype(np.int64) * len(lengths) + j, return_inverse=True)
    similarity = np.zeros(len(pairs))
    i, j = np.divmod(pairs, len(lengths))
    longer = np.maximum(lengths[i], lengths[j])
    order = np.argsort(longer)
    start = np.searchsorted(longer[order], 1)
    while start < len(order):
        # Pairs are taken by length, in portions of bounded memory.
        rest = longer[order[start:]]
        cells = np.arange(1, len(rest) + 1) * (rest + BAGS)
        taken = order[start : start + max(1, np.searchsorted(cells, CELLS))]
        start += len(taken)
        # Differing character counts bound the number of edits from below.
        surplus = bags[i[taken]] - bags[j[taken]]
        edits = np.maximum(surplus.clip(min=0).sum(axis=1), (-surplus).clip(min=0).sum(axis=1))
        taken = taken[1 - edits / longer[taken] >= threshold]
        if len(taken):
            a, b = i[taken], j[taken]
            distance = _edit_distances(
                _padded(points, a), lengths[a], _padded(points, b), lengths[b]
            )
            similarity[taken] = 1 - distance / longer[taken]
    return (similarity >= threshold)[back]


def _encoded(titles: list[str]) -> Encoded:
    """Code points, lengths and counts of characters, these by code point modulo ``BAGS``."""
    points = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in titles]
    lengths = np.array([len(p) for p in points], np.int64)
    bags = np.zeros((len(points), BAGS), np.int32)
    for row, p in enumerate(points):
        bags[row] = np.bincount(p % BAGS, minlength=BAGS)
    return points, lengths, bags


def _padded(points: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    distinct, back = np.unique(codes, return_inverse=True)
    padded = np.zeros((len(distinct), max(len(points[c]) for c in distinct)), np.uint32)
    for row, code in enumerate(distinct):
        padded[row, : len(points[code])] = points[code]
    return padded[back]


def _edit_distances(
    a: np.ndarray, len_a: np.ndarray, b: np.ndarray, len_b: np.ndarray
) -> np.ndarray:
    """Levenshtein distances of many pairs at once, one row of the tables per step."""
    steps = np.arange(b.shape[1] + 1, dtype=np.int32)
    row = np.tile(steps, (len(a), 1))
    distance = len_b.copy()
    for k in range(a.shape[1]):
        best = np.minimum(row[:, 1:] + 1, row[:, :-1] + (b != a[:, k : k + 1]))
        row = np.column_stack([np.full(len(a), k + 1, np.int32), best]) - steps
        row = np.minimum.accumulate(row, axis=1) + steps
        ended = np.flatnonzero(len_a == k + 1)
        distance[ended] = row[ended, len_b[ended]]
    return distance
