"""Personal data: fixed forms, and what stands where such data stands.

The base finds e-mail addresses, IPv4 addresses, card and phone numbers by their form. These are the
seeds of a bootstrapped extraction. A pattern is the words around a place: the word before, the two
words before, or the words before and after. Instances are the seeds, all runs of
digit groups joined by spaces, brackets, dots or hyphens, and all other words with an at sign or a digit.
Patterns and instances make a graph that Spark scores by turns: a pattern is
worth the share of its places, among all places of the corpus, that instances of one kind take up; an
instance that is no seed is worth its best pattern. Patterns with ``MIN_SEEDS`` different instances and
a share of ``ACCEPT`` mark their other instances as data of that kind, and these support patterns in the
next turn, also patterns without a seed. Worths only rise, and turns end when no further pattern can hold.

Base spans are always kept. Null texts are empty. Rows are told apart by a number of their own, so
repeated and null ids do no harm.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.filters import passes, value_filter
from palimpsest.llm.text import SEED, binary, words_of
from palimpsest.materialize import cut_lineage

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS = 3
ACCEPT = 0.5
# Turns that add no pattern go on only while worths rise by more and could lift one over ``ACCEPT``.
SETTLED = 1e-6
ENDS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CACHE = 1 << 18
# There are few patterns and many words, so the filter of patterns is a sparse one.
FILTER_RATIO = 4096

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
SPACE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIGIT = re.compile(r"[0-9]")
# Digit groups of a word, and of several words. A dot before a space ends a sentence.
GROUPS = re.compile(r"[0-9]++(?:[().-]++[0-9]++)*+")
RUN = re.compile(r"[0-9]++(?:(?:(?!\.\x20)[\x20().-])++[0-9]++)*+")
WORD_END = re.compile(f"[{re.escape(ENDS)}]*+(?![^\\x20\\x09-\\x0D])")

SINGLE, PAIR, AROUND, MIX = (
    np.uint64(m)
    for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)
)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        at += 1
        if domain:
            yield start, domain.end()
            done = at = domain.end()


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans in code points by kind, in order."""
    ips, cards, phones = [], [], []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                ips.append(m.span())
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                cards.append(m.span())
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(DIGIT.findall(m[0])) <= 15:
                    phones.append(m.span())
    return [list(_emails(text)) if "@" in text else [], ips, cards, phones]


def _run_end(text: str, begin: int, end: int, limit: int) -> int:
    """Where the digit groups that start at ``begin`` end, at the end of a word; else ``end``."""
    run = RUN.match(text, begin, limit)
    while run and run.end() > end:
        if WORD_END.match(text, run.end()):
            return run.end()
        # The last group is the start of another word.
        run = RUN.match(text, begin, text.rfind(" ", begin, run.end()))
    return end


def _candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of digit groups, and other words with a digit or an at sign, off the base.

    They go without punctuation at their ends.
    """
    at = k = 0
    while found := MARK.search(text, at):
        start = found.start()
        while start > at and not SPACE.match(text, start - 1):
            start -= 1
        stop = SPACE.search(text, found.end())
        at = stop.start() if stop else len(text)
        word = text[start:at]
        left = len(word) - len(word.lstrip(ENDS))
        begin, end = start + left, start + left + len(word.strip(ENDS))
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        clear = k == len(taken) or taken[k][0] >= at
        if clear and MARK.search(text, begin, end):
            if GROUPS.fullmatch(text, begin, end):
                end = _run_end(text, begin, end, taken[k][0] if k < len(taken) else len(text))
                at = max(at, end)
            yield begin, end


def _name(word: str) -> str:
    return word.encode().lower().decode().strip(ENDS)


def _value(word: str) -> int:
    return xxhash.xxh64_intdigest(_name(word).encode(), SEED)


def _patterns(one: np.ndarray, two: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Keys of the contexts: the word before, the two words before, the words before and after."""
    keys = np.concatenate([one * SINGLE, two * PAIR ^ one * SINGLE, one * AROUND ^ after * PAIR])
    keys ^= keys >> np.uint64(29)
    keys *= MIX
    return keys ^ keys >> np.uint64(31)


class _Contexts:
    """The pattern keys of the places of a text. Words and what lies between may have any length."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.spans = [m.span() for m in WORD.finditer(text)]
        self.starts = [start for start, _ in self.spans]
        self.values: dict[int, int] = {}

    def value(self, k: int) -> int:
        """The hash of a word, 0 off the text."""
        if not 0 <= k < len(self.spans):
            return 0
        if k not in self.values:
            start, end = self.spans[k]
            self.values[k] = _value(self.text[start:end])
        return self.values[k]

    def __call__(self, start: int, end: int) -> list[int]:
        """None at the very start of a text. What belongs to the same words is no context."""
        first = bisect_right(self.starts, start) - 1
        last = bisect_left(self.starts, end) - 1
        if first < 1:
            return []
        one, two, after = (
            np.array([self.value(k)], np.uint64) for k in (first - 1, first - 2, last + 1)
        )
        return _patterns(one, two, after).view(np.int64).tolist()


PLACES = "array<struct<kind: int, start: int, end: int, instance: long, keys: array<long>>>"
PLACE_TYPE = pa.list_(
    pa.struct(
        [
            ("kind", pa.int32()),
            ("start", pa.int32()),
            ("end", pa.int32()),
            ("instance", pa.int64()),
            ("keys", pa.list_(pa.int64())),
        ]
    )
)


def places(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(row, doc_id, places)``: the base spans and the candidates, whose kind is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column("text"):
                content = value.as_py() or ""
                base = base_spans(content)
                spans = [(k, s, e) for k, found in enumerate(base) for s, e in found]
                taken = sorted((s, e) for _, s, e in spans)
                spans += [(None, s, e) for s, e in _candidates(content, taken)]
                contexts = _Contexts(content if spans else "")
                out.append(
                    [
                        {
                            "kind": kind,
                            "start": start,
                            "end": end,
                            "instance": np.int64(
                                np.uint64(_value(content[start:end])).view(np.int64)
                            ),
                            "keys": contexts(start, end),
                        }
                        for kind, start, end in spans
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out, PLACE_TYPE)], ["doc_id", "places"]
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = narrow.mapInArrow(run, f"doc_id {kind}, places {PLACES}")
    return found.select(F.monotonically_increasing_id().alias("row"), "*")


def context_counts(docs: DataFrame, patterns: DataFrame, text: str) -> DataFrame:
    """``(key, total)``: how many places of all texts have each of the contexts ``patterns(key)``."""
    bits, bitmap = value_filter(patterns.select(F.col("key").alias("value")), FILTER_RATIO)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            met = []
            for value in binary(batch.column("text")):
                hashes = []
                for word in words_of(value):
                    if (h := known.get(word)) is None:
                        if len(known) > CACHE:
                            known.clear()
                        h = known[word] = _value(word.decode("utf-8", "replace"))
                    hashes.append(h)
                if len(hashes) < 2:
                    continue
                h = np.array([0, *hashes, 0], np.uint64)
                # The place after word i has it before, word i - 1 before that, and word i + 2 after.
                keys = _patterns(h[1:-2], h[:-3], h[3:])
                met.append(keys[passes(keys, bits, bitmap.value)])
            if met:
                keys, counts = np.unique(np.concatenate(met), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"]
                )

    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "key long, n long")
    totals = counted.groupBy("key").agg(F.sum("n").alias("total"))
    return totals.join(patterns.select("key"), "key", "left_semi")


def trusted_patterns(docs: DataFrame, uses: DataFrame, text: str) -> DataFrame:
    """``(key, kind, worth)`` of the patterns that hold, from ``uses(key, instance, kind)``."""
    graph = uses.groupBy("key", "instance", "kind").agg(F.count(F.lit(1)).alias("n"))
    graph = cut_lineage(graph, "graph")
    seeds = graph.filter("kind IS NOT NULL").select("instance", "kind").distinct()
    seeds = cut_lineage(seeds.withColumn("worth", F.lit(1.0)), "seeds")
    # Only patterns with candidates can mark anything, and only those with enough instances hold.
    sides = graph.groupBy("key").agg(
        F.sum("n").alias("used"),
        F.count(F.lit(1)).alias("instances"),
        F.count_if(F.col("kind").isNull()).alias("others"),
    )
    sides = sides.filter((F.col("others") > 0) & (F.col("instances") >= MIN_SEEDS))
    edges = graph.join(sides.select("key", "used"), "key")
    edges = cut_lineage(edges.select("key", "used", "instance", "n", "kind"), "edges")
    spark = docs.sparkSession
    totals = spark.createDataFrame([], "key long, total long")
    held = spark.createDataFrame([], "key long, kind int, worth double")
    # One row for each pattern and instance, so that instances are counted exactly.
    places_of = edges.groupBy("key", "instance").agg(
        F.sum("n").alias("n"), F.first("used").alias("used")
    )
    places_of = cut_lineage(places_of, "instances")
    others = edges.filter("kind IS NULL").select("key", "instance")
    worth, n_held, mass = seeds, 0, 0.0
    while True:
        weighed = places_of.join(worth, "instance")
        shares = weighed.groupBy("key", "kind").agg(
            F.sum(F.col("n") * F.col("worth")).alias("mass"),
            F.sum("n").alias("most"),
            F.count(F.lit(1)).alias("instances"),
            F.first("used").alias("used"),
        )
        # The others cannot hold before more instances are marked, whatever their totals are.
        able = (F.col("instances") >= MIN_SEEDS) & (F.col("most") >= ACCEPT * F.col("used"))
        shares = cut_lineage(shares.filter(able), "shares")
        fresh = shares.select("key", "used").distinct().join(totals, "key", "left_anti")
        fresh = cut_lineage(fresh, "patterns")
        if not fresh.isEmpty():
            met = fresh.join(context_counts(docs, fresh, text), "key", "left").select(
                "key", F.greatest("used", F.coalesce("total", F.lit(0))).alias("total")
            )
            totals = totals.unionByName(cut_lineage(met, "totals"))
        shares = shares.join(totals, "key").withColumn("worth", F.col("mass") / F.col("total"))
        good = F.col("worth") >= ACCEPT
        # With marked instances worth as much as seeds, which their worth can only come near.
        open_ = ~good & (F.col("most") >= ACCEPT * F.col("total"))
        shares = cut_lineage(shares.select("key", "kind", "worth", open_.alias("open")), "shares")
        held = shares.filter(good).select("key", "kind", "worth")
        now = shares.agg(
            F.count_if(good), F.sum(F.when(good, F.col("worth"))), F.count_if("open")
        ).first()
        more, risen = now[0] > n_held, (now[1] or 0.0) - mass > SETTLED
        n_held, mass = now[0], now[1] or 0.0
        if not more and not (now[2] and risen):
            return held
        marked = others.join(held, "key").groupBy("instance", "kind").agg(F.max("worth").alias("worth"))
        fresh = marked.join(seeds.select("instance", "kind"), ["instance", "kind"], "left_anti")
        worth = cut_lineage(seeds.unionByName(fresh), "worth")


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``base`` and ``added``, arrays of kind, start and end.

    Spans are in code points, the end exclusive; kinds are numbers of ``KINDS``.
    """
    found = cut_lineage(places(docs, doc_id, text), "places")
    each = found.select("row", F.explode("places").alias("p")).select("row", "p.*")
    uses = each.select("instance", "kind", F.explode("keys").alias("key"))
    held = trusted_patterns(docs, uses, text)
    candidates = each.filter("kind IS NULL").select(
        "row", "start", "end", F.explode("keys").alias("key")
    )
    # Of several patterns the one worth most decides, the first kind of equals.
    best = F.max_by("kind", F.struct("worth", -F.col("kind"))).alias("kind")
    marked = candidates.join(held, "key").groupBy("row", "start", "end").agg(best)
    added = marked.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    base = F.transform(
        F.filter("places", lambda p: p["kind"].isNotNull()),
        lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")),
    )
    none = F.array().cast("array<struct<kind: int, start: int, end: int>>")
    return found.join(added, "row", "left").select(
        "doc_id", base.alias("base"), F.coalesce("added", none).alias("added")
    )
