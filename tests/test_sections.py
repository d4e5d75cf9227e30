import random

import pytest
from emulation import edits_of, sections_of
from pyspark.sql import functions as F

from palimpsest.functions.text import WHITESPACE
from palimpsest.operators.changes import (
    changed_sections,
    continue_edits,
    late_revisions,
    section_edits,
)
from palimpsest.operators.ordering import SLICE, number_rows, slice_by_order
from palimpsest.operators.sections import split_sections
from palimpsest.sources.api_pages import ANONYMOUS
from palimpsest.sources.state import read_state, write_state

REVISIONS = "article string, rev_id long, second int, user string, wikitext string"


def revisions(spark, rows):
    df = spark.createDataFrame(rows, REVISIONS)
    return df.withColumn("ts", F.timestamp_seconds("second")).drop("second")


@pytest.mark.parametrize("count", [WHITESPACE])
def test_whitespace_is_what_python_strips(count):
    assert set(count) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


HEADINGS = [
    ("== A ==", "A", 1),
    ("== A ==x", "A", 1),
    ("=== X ==", "X", 2),
    ("== X ===", "X", 1),
    ("a == b == c", "b", 1),
    ("== a = b ==", "a = b", 1),
    ("=== B/x ===", "B", 2),
    ("== /q ==", "", 1),
    ("====", "", 1),
    ("=====", "", 2),
    ("== A ==", "A", 1),
    ("==\x1cA ==\r", "A", 1),
    ("a=b", None, None),
    ("== open", None, None),
]


def test_headings(spark):
    rows = [("h", i, i, None, line + "\nbody") for i, (line, _, _) in enumerate(HEADINGS)]
    found = split_sections(revisions(spark, rows)).collect()
    for i, (line, title, level) in enumerate(HEADINGS):
        sections = sorted((r for r in found if r.rev_id == i), key=lambda r: r.pos)
        assert (sections[0].section, sections[0].level) == ("(Top)", 0), line
        if title is None:
            assert [s.content for s in sections] == [f"{line}\nbody"]
        else:
            assert [(s.section, s.level, s.level_stars, s.content) for s in sections[1:]] == [
                (title, level, "*" * level, "body")
            ], line


def test_changes_of_one_article(spark):
    texts = [
        "lead\n== A ==\nx",
        "",
        "lead\n=== A ===\nx",
        "lead",
        "lead\n== A ==\nx",
        "lead\n== A ==\nx\n== A ==\ny",
    ]
    rows = [("a", i + 1, i, "u" if i else None, text) for i, text in enumerate(texts)]
    edits = section_edits(revisions(spark, rows)).orderBy("seq").collect()
    assert [(e.seq, e.rev_id, e.pos, e.section, e.content, e.user) for e in edits] == [
        (0, 1, 0, "(Top)", "lead", ANONYMOUS),
        (1, 1, 1, "A", "x", ANONYMOUS),
        (2, 5, 1, "A", "x", "u"),
        (3, 6, 1, "A", "y", "u"),
    ]


def test_long_lines(spark):
    lines = ["== " + " " * 100000 + "x", "=" * 100000, "== a" + " " * 100000 + "==", "== " * 30000]
    rows = [("long", i, i, None, line) for i, line in enumerate(lines)]
    found = split_sections(revisions(spark, rows)).orderBy("rev_id", "pos").collect()
    titles = [(r.rev_id, r.section, r.level) for r in found if r.pos]
    assert titles == [(1, "", 99997), (2, "a", 1), (3, "", 1)]


def test_many_sections(spark):
    texts = ["".join(f"== {i} ==\n{i % 7 + turn * (i % 2)}\n" for i in range(20000)) for turn in (0, 1)]
    rows = [("many", turn, turn, None, text) for turn, text in enumerate(texts)]
    edits = changed_sections(revisions(spark, rows)).groupBy("rev_id").count().orderBy("rev_id")
    assert [tuple(r) for r in edits.collect()] == [(0, 20001), (1, 10000)]


@pytest.mark.parametrize("seed", range(3))
def test_headings_against_a_regex(spark, seed):
    rng = random.Random(seed)
    lines = ["".join(rng.choice("===a /\t\u00a0") for _ in range(rng.randint(0, 12))) for _ in range(500)]
    rows = [("r", i, i, None, line) for i, line in enumerate(lines) if line]
    found = split_sections(revisions(spark, rows)).filter("pos > 0").collect()
    expected = [
        (i, title, level)
        for i, line in enumerate(lines)
        for title, (level, _) in list(sections_of(line).items())[1:]
    ]
    assert sorted((r.rev_id, r.section, r.level) for r in found) == expected


def random_text(rng):
    parts = ["", " ", "x", "y z", "\t", "== A ==", "== B ==", "=== B/c ===", "==A==tail", "====",
             "a == b == c", "= no =", " ", "\x1c", "\r"]
    return "\n".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))


def test_against_row_by_row_emulation(spark):
    rng = random.Random(7)
    articles = {f"a{a}": [random_text(rng) for _ in range(rng.randint(1, 12))] for a in range(40)}
    # One article holds most rows, and its revisions arrive shuffled.
    articles["hot"] = [random_text(rng) for _ in range(400)]
    rows = [(a, i, i // 2, None, t or None) for a, ts in articles.items() for i, t in enumerate(ts)]
    rng.shuffle(rows)
    df = revisions(spark, rows).repartition(4)
    expected = [
        (a, seq, *edit)
        for a, texts in articles.items()
        for seq, edit in enumerate(edits_of(texts))
    ]
    found = section_edits(df).select("article", "seq", "rev_id", "section", "level", "content")
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    narrow = changed_sections(df).select("article", "seq", "rev_id", "section", "level")
    assert sorted(map(tuple, narrow.collect())) == sorted(e[:5] for e in expected)
    split = split_sections(df).filter("article = 'a0'").collect()
    assert {(r.rev_id, r.section): (r.level, r.content) for r in split} == {
        (i, title): found
        for i, text in enumerate(articles["a0"])
        if text
        for title, found in sections_of(text).items()
    }


EDIT = ["article", "seq", "rev_id", "pos", "section", "level", "content"]


@pytest.mark.parametrize("slices", [None, 12])
def test_a_history_fed_in_parts(spark, tmp_path, slices):
    rng = random.Random(3)
    articles = {f"a{a}": [random_text(rng) for _ in range(rng.randint(1, 9))] for a in range(25)}
    articles["hot"] = [random_text(rng) for _ in range(150)]
    rows = [(a, i, i // 2, None, t or None) for a, ts in articles.items() for i, t in enumerate(ts)]
    whole = sorted(map(tuple, section_edits(revisions(spark, rows)).select(*EDIT).collect()), key=str)
    state = str(tmp_path / "state")
    found = []
    # Cuts differ by article, some run through revisions of one time, and pages overlap.
    cuts = {a: sorted(rng.sample(range(len(ts) + 1), min(2, len(ts) + 1))) for a, ts in articles.items()}
    for part in range(3):
        fed = []
        for row in rows:
            cut = [0, *cuts[row[0]], len(articles[row[0]])]
            if (0 if part == 1 else cut[min(part, len(cut) - 1)] - 1) <= row[1] < cut[min(part + 1, len(cut) - 1)]:
                fed.append(row)
        edits, after = continue_edits(revisions(spark, fed), read_state(spark, state), slices)
        found += map(tuple, edits.select(*EDIT).collect())
        write_state(after, state)
    assert sorted(found, key=str) == whole
    last = read_state(spark, state)
    counts = {r.article: r.n_edits for r in last.collect()}
    assert counts == {a: sum(e[0] == a for e in whole) for a, ts in articles.items() if any(ts)}
    again, after = continue_edits(revisions(spark, rows), last)
    assert again.isEmpty() and sorted(map(str, after.collect())) == sorted(map(str, last.collect()))
    assert late_revisions(revisions(spark, [("a0", 0, 0, None, "x"), ("a0", 99, 99, None, "x")]), last).count() == 1


def test_slices_are_as_many_as_told(spark):
    rows = [("hot" if i % 10 else f"a{i}", i, i, None, f"text {i % 7}\n== A ==\n{i // 3}") for i in range(400)]
    df = revisions(spark, rows)
    assert slice_by_order(df, ["article"], ["ts", "rev_id"], 16).select(SLICE).distinct().count() == 16
    for made in (section_edits, changed_sections):
        few, many = (
            sorted(map(str, made(df, slices=n).select("article", "seq", "rev_id", "section").collect()))
            for n in (1, 16)
        )
        assert few == many


def test_null_and_repeated_ids_keep_their_edits(spark):
    rows = [("a", 1, 0, None, "one"), ("a", None, 1, None, "two"), ("a", 1, 2, None, "three"), ("a", None, None, None, "zero")]
    edits = section_edits(revisions(spark, rows)).orderBy("seq").collect()
    assert [(e.seq, e.content) for e in edits] == [(0, "zero"), (1, "one"), (2, "two"), (3, "three")]


def test_source_order_breaks_ties(spark):
    rows = [("a", 9, 0, None, "one"), ("a", 4, 0, None, "two")]
    df = revisions(spark, rows)
    by_id = section_edits(df).orderBy("seq").collect()
    assert [e.rev_id for e in by_id] == [4, 9]
    ordered = df.withColumn("rev_seq", F.when(F.col("rev_id") == 9, 0).otherwise(1))
    assert [e.rev_id for e in section_edits(ordered).orderBy("seq").collect()] == [9, 4]


def test_a_hot_group_spreads_over_slices(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") < 1500, "hot").otherwise(F.concat(F.lit("a"), F.col("id") % 50)).alias("k"),
        "id",
    )
    numbered = number_rows(df.repartition(4), ["k"], ["id"])
    rows = sorted(map(tuple, numbered.select("k", "id", "seq").collect()))
    for key in {k for k, _, _ in rows}:
        assert [s for k, _, s in rows if k == key] == list(range(sum(k == key for k, _, _ in rows)))


def test_windows_never_span_a_whole_article(spark, capsys):
    rows = [("a", i, i, None, f"text {i}") for i in range(20)]
    numbered = number_rows(revisions(spark, rows), ["article"], ["ts", "rev_id"])
    numbered.explain()
    plan = capsys.readouterr().out
    # The only window by article alone runs over slice sizes, not over rows.
    for line in plan.splitlines():
        if "Window [row_number" in line:
            assert "_slice" in line
