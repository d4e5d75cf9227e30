import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.labels import label_names, parse_answers, taxonomy_names
from palimpsest.operators.report import failed_answers, parse_rate
from palimpsest.sources.taxonomy import bundled_taxonomy, one_per_label

CASES = [
    ('{"4": "x"}', {4: "x"}),
    ('{"3":"b","1":" a "}', {3: "b", 1: "a"}),
    ('t ```json\n{"2":"x"}\n``` t', {2: "x"}),
    ('{"1":"a","1":"b"}', {1: "a b"}),
    ('{"1":"a","01":"b"}', {1: "a b"}),
    ('{"1":"a","Event Reported":"b"}', {1: "a b"}),
    ('{" worked example ":"x"}', {9: "x"}),
    ('{"11":"x"}', {11: "x"}),
    ('{" +1 ":"x"}', {1: "x"}),
    ('{"1":"a \\"quoted\\" \\u00e9 \\n"}', {1: 'a "quoted" é'}),
    ('{"14":"x"}', None),
    ('{"1":"a","99":"b"}', None),
    ('{"-1":"x"}', None),
    ('{"1.0":"x"}', None),
    ("{}", None),
    ("No response", None),
    ('{"1":"a"} trailing', None),
    ("```\n{\"1\":\"a\"}\n```", None),
    ('```json {"1":"a"} ```', None),
    ("{'1':'a'}", None),
    ('{"1":"a",}', None),
    ('{"1":"line\nbreak"}', None),
    ("Explanation: foo\nLabels: 1, 5", {1: "foo", 5: "foo"}),
    ("Labels: 1\nExplanation: why", {1: "why"}),
    ("Labels: 3 4 6", {3: "", 4: "", 6: ""}),
    ("Labels: 3 and 4", {3: ""}),
    ("Labels: 1. Event Reported, 4. Terms.", {1: "", 4: ""}),
    ("labels:\n2", {2: ""}),
    ("Labels: 5, 5, 1;", {5: "", 1: ""}),
    ("Explanation: two\nlines \nLabel: 7;8", {7: "two\nlines", 8: "two\nlines"}),
    ("\n \n\u00a0labels :\u00a03\nEXPLANATION : x \n\n \nLabels: 4", {3: "x"}),
    ("Explanation:\n\nLabels: 1", {1: "Labels: 1"}),
    ("Labels: none", None),
    ("Labels: 14", None),
    ("Labels: ", None),
    ("**Labels:** 1", None),
    ("Labels: 99999999999999", None),
    ('```json\n{"1": oops}\n```\nLabels: 2', {2: ""}),
    ('{"1":["a"]}', None),
    ('{"1":null}', None),
    ('{"1":{"2":"x"}}', None),
    ("5", None),
    ("null", None),
    ("", None),
    (None, None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, response) for i, (response, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, response string")
    return parse_answers(df, bundled_taxonomy(spark)).orderBy("id").collect()


def test_answers(parsed):
    for row, (response, expected) in zip(parsed, CASES, strict=True):
        labels = sorted(expected) if expected else None
        assert (row.labels, row.explanations) == (labels, expected), response
        assert row.parse_status == ("ok" if expected else "invalid")


def test_explanations_keep_answer_order(spark):
    df = spark.createDataFrame([('{"3":"b","1":"a","3":"c"}',)], "response string")
    result = parse_answers(df, bundled_taxonomy(spark))
    assert result.select(F.map_keys("explanations")).first()[0] == [3, 1]


def test_long_answers(spark):
    many = "{" + ",".join(f'"{1 + i % 10}":"part {i}"' for i in range(3000)) + "}"
    escapes = json.dumps({"1": '"\\' * 20000})
    spaces = "Labels: 1" + " " * 50000 + "x"
    df = spark.createDataFrame(
        [
            (0, many),
            (1, escapes),
            (2, spaces),
            (3, "[" * 50000),
            (4, "Labels: " + "1 " * 50000),
            (5, "\n" * 100000 + "Labels 1" + "\n" * 100000),
            (6, "Labels: 4\nExplanation: a" + "\n" * 100000 + "Labels: 5"),
        ],
        "id int, response string",
    )
    rows = parse_answers(df, bundled_taxonomy(spark)).orderBy("id").collect()
    assert rows[0].labels == list(range(1, 11))
    assert rows[0].explanations[1].split(" part ")[1] == "10"
    assert rows[1].explanations == {1: '"\\' * 20000}
    assert rows[2].labels == [1]
    assert rows[3].labels is None
    assert rows[4].labels == [1]
    assert rows[5].labels is None
    assert rows[6].explanations == {4: "a"}


def test_rates_and_names(spark):
    df = spark.createDataFrame([(1, '{"1":"a"}'), (2, "no")], "id int, response string")
    result = parse_answers(df, bundled_taxonomy(spark))
    assert tuple(parse_rate(result).first()) == (1, 2)
    assert [r.id for r in failed_answers(result).collect()] == [2]
    names = {r.label: r.name for r in taxonomy_names(bundled_taxonomy(spark)).collect()}
    assert names[2] == "Date Corrected" and names[11] == "Non Scientific Edit"
    assert {r.label: r.name for r in label_names(spark).collect()}[2] == "Clarification Added"


def test_last_row_of_a_number_and_first_of_a_name_count(spark):
    rows = [(1, "old", "d", "e", 0), (2, "Same", "d", "e", 1), (3, "same ", "d", "e", 2), (1, "new", "d", "e", 3)]
    taxonomy = one_per_label(
        spark.createDataFrame(
            rows, "label int, category string, definition string, example string, position long"
        )
    )
    df = spark.createDataFrame(
        [('{"old":"x"}',), ('{"NEW":"x"}',), ('{" same":"x"}',)], "response string"
    )
    found = {r.response: r.labels for r in parse_answers(df, taxonomy).collect()}
    assert found == {'{"old":"x"}': None, '{"NEW":"x"}': [1], '{" same":"x"}': [2]}
