"""Packing, ranked search and structure repair against brute force, also on tables with awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from palimpsest.llm import packing, ranking, structure
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, length int, ids string, sequence_id string, n int, term string, score int"


def texts(rng):
    words = ["the", "of", "Zürich", "naïve", "東京", "a1", "X", "don't", "e-mail", "İx", "<|endoftext|>", "  "]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    long = " ".join(rng.choice(words) for _ in range(6000))
    return [None, "", " \n\t", "the", "THE the", "\x00\x7f", long, long, "x" * 3000, *made]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "i", "s", 2, "t", 3) for i, t in rows], DOCS)


# Packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packed_pieces(spark, tokenizer):
    rng = random.Random(1)
    rows = [*enumerate(texts(rng)), (2, "of"), (2, "of"), (None, None)]
    docs = docs_of(spark, rows)
    pieces = packing.encode_pieces(docs)
    assert {"n", "score", "sequence_id"} <= set(pieces.columns)
    digest = F.crc32("ids").alias("crc")
    packed = packing.pack(pieces.select("doc_id", "piece", "start", "length", digest, "sequence_id"))
    assert packed.columns[-2:] == ["sequence_id", "offset"] and packed.columns.count("sequence_id") == 1
    expected = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            crc = zlib.crc32(np.array(ids[a:b], "<u4").tobytes())
            expected.append((str(doc_id), k, a, b - a, crc))
    found = packed.collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.crc) for r in found) == sorted(expected)
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        ends = list(itertools.accumulate((n for _, n in sorted(places)), initial=0))
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 1024
    total = sum(r.length for r in found)
    assert -(-total // 1024) <= len(by_sequence) <= -(-total // 1024) + 1
    empty = packing.pack(packing.encode_pieces(docs.limit(0)))
    assert empty.isEmpty() and {"sequence_id", "offset"} <= set(empty.columns)


def test_sequences_hold_their_pieces(spark):
    docs = docs_of(spark, [(i, f"text number {i} " * (i + 1)) for i in range(30)])
    pieces = packing.encode_pieces(docs, capacity=64)
    packed = packing.pack(pieces.select("doc_id", "piece", "length"), 64)
    whole = packing.sequences(packed, pieces, ["doc_id", "piece"]).collect()
    sizes = {r.sequence_id: r.n for r in packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()}
    assert {r.sequence_id: len(r.ids) // 4 for r in whole} == sizes


def test_vocabularies_agree_on_every_character(tokenizer):
    """The ids are those of the tokenizers library, whatever characters meet."""
    with open(packing.RANKS, "rb") as file:
        coder = packing._coder(file.read(), packing.PATTERN, tuple(packing.SPECIAL.items()))
    known = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    parts = ["".join(f"a{chr(c)} {chr(c)}{chr(c)}1 {chr(c)}b" for c in known[i : i + 2000]) for i in range(0, len(known), 2000)]
    for text, code in zip(parts, tokenizer.encode_batch(parts, add_special_tokens=False)):
        assert coder.encode(text, allowed_special="all") == code.ids


def piecewise(bins):
    return Counter({length: n for length, n in sum((Counter({k: v * m for k, v in p}) for p, m in bins.items()), Counter()).items()})


@pytest.mark.parametrize("seed", range(6))
def test_search_saves_sequences(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randint(1, 20), rng.randint(20, 64)]) for _ in range(300))
    counts += Counter({33: 40, 31: 20})
    first = packing.best_fit(counts, 64)
    better = packing.improve(first, 64)
    for bins in (first, better):
        assert piecewise(bins) == counts and all(packing.fill(p) <= 64 for p in bins)
    assert better.total() <= first.total()
    by_piece = []
    for length in sorted(counts.elements(), reverse=True):
        room = [b for b in by_piece if b + length <= 64]
        if room:
            by_piece[by_piece.index(max(room))] += length
        else:
            by_piece.append(length)
    assert sorted(by_piece) == sorted(packing.fill(p) for p in first.elements())


def test_swaps_empty_a_sequence():
    """Best fit leaves three sequences where two hold all."""
    counts = {6: 1, 5: 2, 4: 1, 3: 2, 2: 2}
    assert packing.best_fit(counts, 15).total() == 2 or packing.improve(packing.best_fit(counts, 15), 15).total() == 2
    start = Counter({((6, 1), (2, 1)): 1, ((5, 1), (4, 1)): 1, ((3, 1),): 1})
    assert packing.improve(start, 10) == Counter({((6, 1), (4, 1)): 1, ((5, 1), (3, 1), (2, 1)): 1})
    many = Counter({p: 1000 for p in start})
    assert packing.improve(many, 10).total() == 2000


# Ranked search


def brute_ranks(docs, items, depth):
    def terms(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(ranking.TERM, lowered)

    counted = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    wanted = defaultdict(set)
    for item_id, text in items:
        wanted[item_id] |= set(terms(text))
    out = []
    for item_id, asked in wanted.items():
        scored = []
        for (doc_id, c), n in zip(counted, sizes):
            score = 0
            for t in asked & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 50 + (50 * n * n_docs) // n_terms
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scored)[:depth], 1):
            out.append((item_id, rank, doc_id, -score))
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [1, 3])
def test_ranks(spark, blocks, monkeypatch):
    rng = random.Random(2)
    rows = [*enumerate(texts(rng)), (9, "東京 東京"), (9, "東京 東京"), (None, "naïve X"), (None, None)]
    items = [(0, "東京 Naïve"), (1, None), (2, ""), (3, "the of a1 X don e"), (3, "mail"), (None, "zürich"), (4, "none at all"), (5, "x" * 3000)]
    item_table = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id int, rank int")
    docs = docs_of(spark, rows)
    if blocks > 1:
        monkeypatch.setattr(ranking, "BLOCK_BYTES", 1200)
    monkeypatch.setattr(ranking, "CELLS", 50)
    for depth in (3, 50):
        found = ranking.search(docs, item_table, depth).collect()
        assert sorted(map(tuple, found), key=str) == brute_ranks(rows, items, depth)
    assert ranking.search(docs.limit(0), item_table).isEmpty()
    assert ranking.search(docs, item_table.limit(0)).isEmpty()


# Structure repair


def brute_repair(rows):
    """Cheapest edits by trying all, shortest path over (turns done, roles so far)."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        if not bare:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    states = {("", False): (0, "", ())}

    def follow(state, initial):
        last, led = state
        if initial == "s" and last == "" or initial == "u" and last in ("", "s", "a") or initial == "a" and last == "u":
            return (initial, led or initial == "s")
        return None

    def inserted(states):
        states = dict(states)
        for _ in range(3):
            for state, (cost, audit, out) in list(states.items()):
                for role in ("user", "assistant"):
                    after = follow(state, role[0])
                    new = (cost + 2, audit + "I", (*out, f"{role}:"))
                    if after and new < states.get(after, (math.inf,)):
                        states[after] = new
        return states

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, out) in inserted(states).items():
            options = [(state, (cost + 3, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                options.append((follow(state, role[:1]), (cost + extra, audit + "K", (*out, f"{role}:{text}"))))
                for new in ("user", "assistant"):
                    options.append((follow(state, new[0]), (cost + extra + 2, audit + "R", (*out, f"{new}:{text}"))))
            for to, found in options:
                if to and found < after.get(to, (math.inf,)):
                    after[to] = found
        states = after
    cost, audit, out = min(v for s, v in inserted(states).items() if s[0] in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = zip(rows, rows[1:])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)


def conversations(rng):
    roles = ["user", "assistant", "system", "tool", "", "sys", None]
    weights = [8, 8, 2, 1, 0.3, 0.5, 0.3]
    out = []
    for conv in [*range(40), None, "hot"]:
        for turn in range(rng.randint(1, 9) if conv != "hot" else 700):
            text = rng.choice(["Yes.", "no", "Really?", "", " \n", "Go on! ", None, f"t{turn}."])
            number = None if rng.random() < 0.03 else turn + 2 * (turn > 5)
            out.append((-1 if conv == "hot" else conv, number, rng.choices(roles, weights)[0], text, "m", 0))
    out += out[:3]
    rng.shuffle(out)
    return out


SCHEMA = "conv_id long, turn long, role string, text string, mark string, place int"


def expected_repairs(rows):
    by_conv = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = (" " if v is None else v for v in (role, text))
        by_conv[conv].append((turn, role, text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return {c: brute_repair(sorted(rows, key=order)) for c, rows in by_conv.items()}


@pytest.mark.parametrize("seed", range(2))
def test_repair(spark, seed):
    rows = conversations(random.Random(seed))
    turns = spark.createDataFrame(rows, SCHEMA)
    # Without coalescing, the long conversation spreads over slices.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found, repaired = structure.repair(turns)
        digests = {r.conv_id: r.repaired_sha256 for r in structure.digests(repaired).collect()}
        found = found.collect()
        places = repaired.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("top")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(r.n == r.top + 1 for r in places)
    nothing = hashlib.sha256(b"").hexdigest()
    assert {
        r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests.get(r.conv_id, nothing))
        for r in found
    } == expected_repairs(rows)


def test_repair_of_nothing(spark):
    found, repaired = structure.repair(spark.createDataFrame([], SCHEMA))
    assert found.isEmpty() and repaired.isEmpty() and structure.digests(repaired).isEmpty()


def test_a_long_conversation_lies_in_several_slices(spark):
    turns = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat(id, '.') AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        marked = structure._marked(structure.faults(turns))
        assert marked.select("slice").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found, _ = structure.repair(turns)
    row = found.first()
    assert (row.cost, row.audit) == (0, "K" * 3000)


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b!") for c in (1, 2, None) for t in (None, *range(40))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    expected = []
    for c, t, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (c, t))
        kind = zlib.crc32(key.encode()) % 20
        changed = {1: "", 2: "A b"}.get(kind, text)
        expected += [(c, t, "user" if kind == 4 else role, changed)] * {0: 0, 3: 2}.get(kind, 1)
    assert sorted(map(tuple, structure.damage(turns).collect()), key=str) == sorted(expected, key=str)
