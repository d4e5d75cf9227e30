"""Conversation structure repair by a generalised LR parse that may edit its input.

The grammar of role initials is ``(s?(ua)+)?``. Its LR automaton is built from the rules below. All
parses of a conversation advance together: their stacks share what lies below their tops, and stacks
that come to be equal are merged, of which the least ``(cost, audit)`` stays. Before a turn any number
of turns may be inserted; the turn itself is kept, gets another role, or is deleted.

A conversation of any length is cut into runs of consecutive turns. A run is parsed from every stack
that its conversation may bring along, so that runs go to different tasks; then runs are put together,
each as one small table of stacks to ``(cost, audit)``. Nothing but its audit grows with a conversation.

Turns are ordered by ``turn``, nulls first, and those of one turn by role and digest of the text. Null
roles and texts count as one space. A null ``conv_id`` is a conversation like others. Columns other than
the four are left out. Empty tables give empty tables. Only its first character says what a role is.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palimpsest.materialize import cut_lineage
from palimpsest.operators.ordering import SLICE, slice_by_order

SPACE = " \t\n\x0b\x0c\r"
RULES = [("C", "P"), ("C", "sP"), ("P", "PT"), ("P", "T"), ("T", "ua")]
GOAL = "C"
ROLES = {"u": "user", "a": "assistant"}
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
LEGAL = {"su", "ua", "au"}
# Audits are shortened by what all have in common after so many turns.
SHORTEN = 256

Items = frozenset[tuple[int, int]]
Stack = tuple
Parses = dict[Stack, tuple[int, str]]


def _closed(items: set[tuple[int, int]]) -> Items:
    """Rules with a place in each, and the rules that may begin at these places."""
    open_ = list(items)
    while open_:
        rule, at = open_.pop()
        rest = RULES[rule][1][at:]
        for i, (name, _) in enumerate(RULES):
            if rest[:1] == name and (i, 0) not in items:
                items.add((i, 0))
                open_.append((i, 0))
    return frozenset(items)


def _go(state: Items, symbol: str) -> Items | None:
    moved = {(r, at + 1) for r, at in state if RULES[r][1][at : at + 1] == symbol}
    return _closed(moved) if moved else None


START: Stack = (_closed({(i, 0) for i, (name, _) in enumerate(RULES) if name == GOAL}), None)


@lru_cache(None)
def shift(stack: Stack, symbol: str) -> Stack | None:
    """The stack after a symbol and all reductions that it completes; none if it doesn't fit."""
    state = _go(stack[0], symbol)
    if state is None:
        return None
    whole = [r for r, at in state if at == len(RULES[r][1]) and RULES[r][0] != GOAL]
    if not whole:
        return (state, stack)
    name, body = RULES[whole[0]]
    for _ in body[1:]:
        stack = stack[1]
    return shift(stack, name)


def accepts(stack: Stack) -> bool:
    whole = (RULES[r][0] == GOAL and at == len(RULES[r][1]) for r, at in stack[0])
    return stack == START or any(whole)


def _all_stacks() -> list[Stack]:
    found = [START]
    for stack in found:
        found += {n for s in "sua" if (n := shift(stack, s)) and n not in found}
    return found


def _offer(parses: Parses, stack: Stack | None, found: tuple[int, str]) -> bool:
    if stack is None or (stack in parses and parses[stack] <= found):
        return False
    parses[stack] = found
    return True


def _with_inserts(parses: Parses) -> Parses:
    parses = dict(parses)
    open_ = list(parses)
    while open_:
        stack = open_.pop()
        cost, audit = parses[stack]
        for symbol in ROLES:
            after = shift(stack, symbol)
            if _offer(parses, after, (cost + INSERT, audit + "I")):
                open_.append(after)
    return parses


def _advance(parses: Parses, mark: str) -> Parses:
    after: Parses = {}
    initial = mark.lower()
    for stack, (cost, audit) in _with_inserts(parses).items():
        _offer(after, stack, (cost + DELETE, audit + "D"))
        if mark.isdigit():
            continue
        extra = TRUNCATED if mark.isupper() else 0
        _offer(after, shift(stack, initial), (cost + extra, audit + "K"))
        for symbol in ROLES:
            if symbol != initial:
                _offer(after, shift(stack, symbol), (cost + extra + REROLE, audit + "R"))
    return after


def parse(marks: str, entry: Stack = START) -> Parses:
    """The cheapest edits of a run for each stack it may end with.

    Of two audits for the same turns and of the same cost, neither begins with the other, as it would
    have fewer inserts; so the least of a run is the least whatever follows.
    """
    parses, common = {entry: (0, "")}, []
    for i, mark in enumerate(marks):
        parses = _advance(parses, mark)
        if i % SHORTEN == SHORTEN - 1:
            common.append(os.path.commonprefix([audit for _, audit in parses.values()]))
            parses = {s: (c, a[len(common[-1]) :]) for s, (c, a) in parses.items()}
    start = "".join(common)
    return {s: (c, start + a) for s, (c, a) in parses.items()}


def finished(parses: Parses) -> tuple[int, str]:
    """The cheapest parse that the grammar accepts, with inserts at the end."""
    return min(found for stack, found in _with_inserts(parses).items() if accepts(stack))


STACKS = _all_stacks()
#: What the grammar still wants of each stack at the end.
ENDS = {stack: finished({stack: (0, "")}) for stack in STACKS}
COUNTS = ["n_turns", "blank", "duplicate", "truncated"]
SOLVED = (
    "gaps long, n_turns long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, segments array<struct<slice: int, audit: string, leads: boolean, place: long>>"
)
EDITS = "slice int, number int, place long, new_role string"
OUTCOMES = "outcomes array<struct<entry: int, exit: int, cost: long, audit: string>>"


def _parsed_from(marks: str, entries: int) -> list[dict]:
    return [
        {"entry": entry, "exit": STACKS.index(stack), "cost": cost, "audit": audit}
        for entry in range(entries)
        for stack, (cost, audit) in parse(marks, STACKS[entry]).items()
    ]


@lru_cache(1 << 16)
def _short_run(marks: str, entries: int) -> list[dict]:
    return _parsed_from(marks, entries)


def _illegal(marks: str) -> int:
    initials = marks.lower().translate(str.maketrans("1230", "suax"))
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _parse_runs(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            marks = row["marks"]
            parsed = _short_run if len(marks) <= 32 else _parsed_from
            row["outcomes"] = parsed(marks, len(STACKS) if row["later"] else 1)
            row["illegal"] = _illegal(marks)
            row["ends"] = marks[0] + marks[-1]
        yield pa.RecordBatch.from_pylist(rows, schema)


class _Conversation:
    """A conversation put together from its runs, which come one after the other."""

    def __init__(self, run: dict) -> None:
        self.conv = run["conv"]
        # Of each stack the cost, the audit since what all have in common, and the runs so far.
        self.parses: dict = {START: (0, "", None)}
        self.totals = dict.fromkeys((*COUNTS, "turns", "illegal"), 0)
        self.known: list[int] = []
        self.before: dict | None = None

    def add(self, run: dict) -> None:
        for name in self.totals:
            self.totals[name] += run[name]
        if self.before:
            self.totals["illegal"] += _illegal(self.before["ends"][1] + run["ends"][0])
            repeated = run["first_turn"] is not None and run["first_turn"] == self.before["last_turn"]
            self.totals["turns"] -= repeated
        self.before = {name: run[name] for name in ("ends", "last_turn")}
        ends = [t for t in (*self.known, run["low"], run["high"]) if t is not None]
        self.known = [min(ends), max(ends)] if ends else []
        after: dict = {}
        for found in run["outcomes"]:
            if STACKS[found["entry"]] not in self.parses:
                continue
            cost, audit, path = self.parses[STACKS[found["entry"]]]
            new = (cost + found["cost"], audit + found["audit"])
            stack = STACKS[found["exit"]]
            if stack not in after or new < after[stack][:2]:
                after[stack] = (*new, (path, run["slice"], found["audit"]))
        # What all have in common is left to the paths.
        shared = len(os.path.commonprefix([audit for _, audit, _ in after.values()]))
        self.parses = {s: (cost, audit[shared:], path) for s, (cost, audit, path) in after.items()}

    def row(self) -> dict:
        parses, totals = self.parses, self.totals
        best = min(parses, key=lambda s: (parses[s][0] + ENDS[s][0], parses[s][1] + ENDS[s][1]))
        cost, _, path = parses[best]
        segments = []
        while path:
            path, number, audit = path
            segments.append({"slice": number, "audit": audit, "leads": _leads(best)})
        segments.reverse()
        segments[-1]["audit"] += ENDS[best][1]
        place = 0
        for segment in segments:
            segment["place"] = place
            place += len(segment["audit"]) - segment["audit"].count("D")
        n_distinct = totals.pop("turns")
        return {
            "conv": self.conv,
            "gaps": self.known[1] - self.known[0] + 1 - n_distinct if self.known else 0,
            **totals,
            "cost": cost + ENDS[best][0],
            "audit": "".join(s["audit"] for s in segments),
            "segments": segments,
        }


def _leads(stack: Stack | None) -> bool:
    """Whether a turn of the system stands first."""
    return stack is not None and (stack == shift(START, "s") or _leads(stack[1]))


def _join_runs(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs come by conversation and in order; the last conversation may go on in the next batch."""
    now: _Conversation | None = None
    for batch in batches:
        done = []
        for run in batch.to_pylist():
            if now is None or now.conv != run["conv"]:
                done += [now.row()] if now else []
                now = _Conversation(run)
            now.add(run)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if now:
        yield pa.RecordBatch.from_pylist([now.row()], schema)


def _edits(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per edit that leaves a turn: its place, its turn if it has one, and its new role."""
    for batch in batches:
        for row in batch.to_pylist():
            done, place, number = [], row["place"], 0
            for edit in row["audit"]:
                number += edit != "I"
                if edit == "D":
                    continue
                wanted = "ua"[(place - row["leads"]) % 2]
                done.append({
                    "conv": row["conv"],
                    "slice": row["slice"],
                    "number": None if edit == "I" else number,
                    "place": place,
                    "new_role": None if edit == "K" else ROLES[wanted],
                })
                place += 1
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)


def _extended(df: DataFrame, fields: str) -> T.StructType:
    return T.StructType(df.schema.fields + T.StructType.fromDDL(fields).fields)


def _mapped(df: DataFrame, function: Callable, schema: T.StructType) -> DataFrame:
    arrow = to_arrow_schema(schema)
    return df.mapInArrow(partial(function, arrow), schema)


def faults(turns: DataFrame) -> DataFrame:
    """``conv, turn, role, text`` and what can be told of a turn alone, written once."""
    text = F.coalesce("text", F.lit(" "))
    end = F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))
    rows = turns.select(
        F.struct("conv_id").alias("conv"),
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        text.alias("text"),
        F.unhex(F.sha2(text, 256)).alias("text_id"),
        (end == "").alias("blank"),
        (~end.isin("", ".", "!", "?")).alias("cut"),
        F.monotonically_increasing_id().alias("row"),
    )
    return cut_lineage(rows, "turns")


def _marked(turns: DataFrame) -> DataFrame:
    """Turns without texts, in order within slices, each with one character for role and fault."""
    key = ["conv", "role", "text_id"]
    narrow = turns.drop("text")
    place = F.struct("turn", "row")
    firsts = narrow.groupBy(*key).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    rows = narrow.join(firsts.filter("n > 1").drop("n"), key, "left")
    seen = F.coalesce(place > F.col("first"), F.lit(False)) & ~F.col("blank")
    truncated = F.col("cut") & ~seen
    initial = F.left("role", F.lit(1))
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    mark = F.when(F.col("blank") | seen, F.translate(initial, "suax", "1230"))
    mark = mark.when(truncated, F.upper(initial)).otherwise(initial)
    rows = rows.select(
        "conv", "turn", "role", "text_id", "row", "blank",
        seen.alias("duplicate"), truncated.alias("truncated"), mark.alias("mark"),
    )
    order = ["turn", "role", "text_id", "row"]
    sliced = slice_by_order(cut_lineage(rows, "marks"), ["conv"], order)
    window = Window.partitionBy("conv", SLICE).orderBy(*order)
    before = F.lag("turn").over(window)
    fresh = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(before)
    numbered = sliced.withColumn("number", F.row_number().over(window)).withColumn("fresh", fresh)
    return cut_lineage(numbered.withColumnRenamed(SLICE, "slice"), "numbered")


def _runs(marked: DataFrame) -> DataFrame:
    """The turns of each slice of a conversation as one text of marks, no longer than the slice."""
    ordered = F.array_sort(F.collect_list(F.struct("number", "mark")))
    runs = marked.groupBy("conv", "slice").agg(
        F.array_join(F.transform(ordered, lambda t: t["mark"]), "").alias("marks"),
        F.count(F.lit(1)).alias("n_turns"),
        *(F.count_if(name).alias(name) for name in COUNTS[1:]),
        F.count_if("fresh").alias("turns"),
        F.min("turn").cast("long").alias("low"),
        F.max("turn").cast("long").alias("high"),
        F.min_by("turn", "number").cast("long").alias("first_turn"),
        F.max_by("turn", "number").cast("long").alias("last_turn"),
    )
    first = F.min("slice").over(Window.partitionBy("conv"))
    return runs.withColumn("later", F.col("slice") > first)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repairs ``turns(conv_id, turn, role, text)``; returns conversations and repaired turns.

    The first has a row per conversation with any turn: ``conv_id, gaps, n_turns, blank, duplicate,
    truncated, illegal, cost, audit``. The second has ``conv_id, place, role, text``, places from 0.
    """
    turns = faults(turns)
    marked = _marked(turns)
    runs = _runs(marked)
    added = f"{OUTCOMES}, illegal long, ends string"
    found = _mapped(runs, _parse_runs, _extended(runs, added))
    found = found.repartition("conv").sortWithinPartitions("conv", "slice")
    key = turns.select("conv")
    solved = _mapped(found, _join_runs, _extended(key, SOLVED))
    solved = cut_lineage(solved, "solved")
    segments = solved.select("conv", F.inline("segments"))
    edits = _mapped(segments, _edits, _extended(key, EDITS))
    key = ["conv", "slice", "number"]
    kept = edits.join(marked.select(*key, "row"), key, "left")
    texts = turns.select("row", "role", "text")
    repaired = kept.join(texts, "row", "left").select(
        "conv.conv_id",
        "place",
        F.coalesce("new_role", "role").alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    named = [c for c in solved.columns if c not in ("conv", "segments")]
    return solved.select("conv.conv_id", *named), repaired


def damage(turns: DataFrame) -> DataFrame:
    """Damaged turns to test a repair with: of each twenty, five are hit, each in its own way."""
    turns = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *parts)) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.filter(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")


def digests(repaired: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of ``role:text`` lines. Turns stream through, none is held."""
    rows = repaired.select(F.struct("conv_id").alias("conv"), "place", "role", "text")
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "place").drop("place")
    schema = rows.select("conv").schema.add("repaired_sha256", "string")
    return _mapped(ordered, _hash_lines, schema).select("conv.conv_id", "repaired_sha256")


def _hash_lines(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = digest = None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            line = f"{row['role']}:{row['text']}".encode()
            if digest is None or now != row["conv"]:
                done += [{"conv": now, "repaired_sha256": digest.hexdigest()}] if digest else []
                now, digest = row["conv"], hashlib.sha256(line)
            else:
                digest.update(b"\n" + line)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if digest:
        yield pa.RecordBatch.from_pylist([{"conv": now, "repaired_sha256": digest.hexdigest()}], schema)
