import pytest

from palimpsest.operators.prompts import build_prompts
from palimpsest.sources.taxonomy import bundled_taxonomy, read_taxonomy

LINKED = """article string, seq long, section string, content string, prev_content string,
    prev_rev_id long, match_type string"""
COMPARE = "C|{section}|{article}|{previous}|{current}|{labels}|{{other}}"
FIRST = "F|{section}|{article}|{current}|{labels}"


@pytest.fixture
def taxonomies(spark, tmp_path):
    full = tmp_path / "full.csv"
    full.write_text(
        "#,Category Name,Definition,Example\n"
        '10,Ten,"Quoted, ""doubled"" of {PAGE_NAME}",In {PAGE_NAME}\n'
        '2,Two,"Line\nbreak",E\n',
        encoding="utf-8",
    )
    first = tmp_path / "first.csv"
    first.write_text("#,Category Name,Definition,Example\n4,Four,D,E\n", encoding="utf-8")
    return read_taxonomy(spark, str(full)), read_taxonomy(spark, str(first))


def test_prompts(spark, taxonomies):
    rows = [
        ("A$1", 0, "S", "text {section}", None, None, "first-time"),
        ("A$1", 1, "S", "{PAGE_NAME}", "", 17, "title"),
        ("A$1", 2, "{labels}", "new", "old {current}", 17, "both"),
        ("A$1", 3, "S", "t", "x", 3, "none"),
        ("A$1", 4, "S", "t", "", None, None),
        ("A$1", 5, "S", None, None, 5, "content"),
    ]
    df = spark.createDataFrame(rows, LINKED)
    found = build_prompts(df, *taxonomies, COMPARE, FIRST).orderBy("seq").collect()
    labels = (
        "2. Two: Line\nbreak\n\tExample: E\n"
        '10. Ten: Quoted, "doubled" of A$1\n\tExample: In {PAGE_NAME}'
    )
    first = "4. Four: D\n\tExample: E"
    assert [r.is_first_time for r in found] == [True, False, False, True, True, False]
    assert [r.prompt for r in found] == [
        f"F|S|A$1|text {{section}}|{first}",
        f"C|S|A$1||{{PAGE_NAME}}|{labels}|{{{{other}}}}",
        f"C|{{labels}}|A$1|old {{current}}|new|{labels}|{{{{other}}}}",
        f"F|S|A$1|t|{first}",
        f"F|S|A$1|t|{first}",
        f"C|S|A$1|||{labels}|{{{{other}}}}",
    ]
    assert [r.custom_id for r in found][:2] == ["A$1#0", "A$1#1"]


def test_bundled_data(spark):
    full = {r.label for r in bundled_taxonomy(spark).collect()}
    first = {r.label for r in bundled_taxonomy(spark, first_time=True).collect()}
    assert full == {*range(1, 11), 12, 13} and first == {1, 3, 4, 7, 8, 9}
    df = spark.createDataFrame([("A", 0, "S", "t", None, None, "none")], LINKED)
    prompt = build_prompts(df, bundled_taxonomy(spark), bundled_taxonomy(spark, True)).first().prompt
    assert "Section: S" in prompt and "\n9. Worked Example: " in prompt and "matters for A is" in prompt


def test_the_taxonomy_is_not_joined(spark, taxonomies, capsys):
    df = spark.createDataFrame([("A", 0, "S", "t", None, None, "none")], LINKED)
    build_prompts(df, *taxonomies).explain()
    assert "Join" not in capsys.readouterr().out.split("Subqueries")[0]
