import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.changes import section_edits
from palimpsest.operators.embed import word_vector_embedding
from palimpsest.plans.chain import (
    label_edits,
    link_revisions,
    prompts_for_model,
    resumed_score,
    score,
)
from palimpsest.sources.api_pages import (
    ANONYMOUS,
    corrupt_pages,
    corrupt_revisions,
    read_api_pages,
    revisions_from_pages,
    scan_pages,
    write_api_pages,
)
from palimpsest.sources.batch import (
    NO_RESPONSE,
    failed_prompts,
    join_responses,
    ledger_answers,
    open_prompts,
    read_errors,
    read_ledger,
    read_requests,
    read_responses,
    record_answers,
    write_requests,
)
from palimpsest.sources.output import COLUMNS, CSV_HEADER, read_csv, write_csv, write_parquet
from palimpsest.sources.taxonomy import bundled_taxonomy, read_taxonomy


def response(page_id, title, *revisions):
    page = {"revisions": list(revisions)}
    if title:
        page["title"] = title
    return {"query": {"pages": {page_id: page}}, "continue": {"rvcontinue": "x"}}


def revision(rev_id, **fields):
    return {"revid": rev_id, "timestamp": f"2001-08-09T12:00:0{rev_id % 10}Z", **fields}


def slots(text):
    return {"slots": {"main": {"contentmodel": "wikitext", "*": text}}}


@pytest.fixture
def pages(tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    saved = [
        response("12", "Plasmid", revision(1, user="u", **slots("one")), revision(2, **slots("two"))),
        response("12", "Plasmid", revision(3, user="v"), revision(4, slots={}), revision(5, slots={"main": {}})),
        response("-1", "Nowhere", revision(9, **slots("lost"))),
        {**response("7", None, revision(6, **slots("untitled"))), "requested": "Asked"},
        {"query": {"pages": {"8": {"title": "Empty"}}}},
    ]
    for i, page in enumerate(saved):
        (folder / f"{i}.json").write_text(json.dumps(page, indent=1), encoding="utf-8")
    (folder / "broken.json").write_text('{"query": {"pages"', encoding="utf-8")
    return str(folder)


def test_api_pages(spark, pages):
    read = read_api_pages(spark, pages)
    rows = revisions_from_pages(read).withColumn("s", F.unix_seconds("ts")).orderBy("rev_id").collect()
    noon = 997358400
    assert [(r.article, r.rev_id, r.s, r.user, r.wikitext) for r in rows] == [
        ("Plasmid", 1, noon + 1, "u", "one"),
        ("Plasmid", 2, noon + 2, ANONYMOUS, "two"),
        ("Plasmid", 3, noon + 3, "v", None),
        ("Plasmid", 4, noon + 4, ANONYMOUS, None),
        ("Plasmid", 5, noon + 5, ANONYMOUS, None),
        ("Asked", 6, noon + 6, ANONYMOUS, "untitled"),
    ]
    corrupt = corrupt_pages(read).collect()
    assert len(corrupt) == 1 and corrupt[0].file.endswith("broken.json")


def test_api_pages_by_line(spark, pages, tmp_path):
    revisions = revisions_from_pages(read_api_pages(spark, pages)).drop("rev_seq")
    write_api_pages(revisions, str(tmp_path / "lines"))
    again = revisions_from_pages(read_api_pages(spark, str(tmp_path / "lines"), multi_line=False))
    again = again.drop("rev_seq")
    assert sorted(again.collect(), key=str) == sorted(revisions.collect(), key=str)


def test_partial_pages(spark, tmp_path):
    """A bad entry takes no good one with it."""
    good = [revision(i, user="u", **slots(f"t{i}")) for i in (1, 2, 3)]
    bad = [{**revision(4), "revid": "x"}, {**revision(5), "slots": "y"}, {**revision(6), "slots": {"main": 1}}, 7, None]
    saved = [response("1", "A", good[0], *bad, good[1]), response("2", "B", good[2])]
    saved[1]["query"]["pages"] |= {"3": "z", "4": {"title": "C", "revisions": 5}}
    lines = [*map(json.dumps, saved), '{"query": {"pages"']
    (tmp_path / "lines.json").write_text("\n".join(lines), encoding="utf-8")
    read = read_api_pages(spark, str(tmp_path / "lines.json"), multi_line=False)
    rows = revisions_from_pages(read).orderBy("rev_id").collect()
    assert [(r.article, r.rev_id, r.wikitext) for r in rows] == [("A", 1, "t1"), ("A", 2, "t2"), ("B", 3, "t3")]
    assert corrupt_revisions(read).count() == 7 and len(corrupt_pages(read).collect()) == 1


def test_overlapping_pages(spark, tmp_path):
    """Pages that share revisions, conflicting copies, ids that are missing or texts, and equal times."""
    same = {"timestamp": "2001-08-09T12:00:00Z"}
    saved = {
        "p1": [revision(1, **slots("one")), revision(2, **slots("two")), {"timestamp": "x", **slots("lost")}],
        "p2": [revision(2, **slots("two")), revision(3, **slots("old")), {**revision(4), "revid": "x"}],
        "p3": [revision(3, **slots("new")), {**revision(9, **slots("n")), **same}, {**revision(8, **slots("e")), **same}, {**revision(5), "revid": "7"}],
    }
    for name, entries in saved.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(response("1", "A", *entries)), encoding="utf-8")
    scan = scan_pages(read_api_pages(spark, str(tmp_path)))
    rows = scan.revisions.orderBy("rev_seq").collect()
    assert [(r.rev_id, r.wikitext) for r in rows] == [(1, "one"), (2, "two"), (3, "new"), (9, "n"), (8, "e"), (7, None)]
    assert [(r.rev_id, r.wikitext) for r in scan.conflicts.collect()] == [(3, "old")]
    assert sorted(json.loads(r.entry).get("revid", "") for r in scan.corrupt.collect()) == ["", "x"]
    edits = section_edits(scan.revisions.filter("rev_id > 7")).orderBy("seq").collect()
    assert [e.rev_id for e in edits] == [9, 8]


def test_requests(spark, tmp_path):
    prompts = spark.createDataFrame([("a#0", 'say "é"\nnow')], "custom_id string, prompt string")
    write_requests(prompts, str(tmp_path / "requests"), "m")
    lines = [
        json.loads(line)
        for file in (tmp_path / "requests").glob("part-*")
        for line in file.read_text("utf-8").splitlines()
    ]
    message = {"role": "user", "content": 'say "é"\nnow'}
    assert lines == [
        {
            "custom_id": "a#0",
            "method": "POST",
            "url": "/v1/chat/completions",
            "body": {"model": "m", "messages": [message]},
        }
    ]
    assert read_requests(spark, str(tmp_path / "requests")).first().custom_id == "a#0"


def answer(custom_id, content):
    body = {"choices": [{"message": {"role": "assistant", "content": content}}], "usage": {"n": 1}}
    return json.dumps({"id": "b", "custom_id": custom_id, "response": {"status_code": 200, "body": body}})


def test_responses(spark, tmp_path):
    file = tmp_path / "responses.jsonl"
    lines = [answer("a#1", "first"), answer("a#0", "zero"), answer("a#1", "last")]
    file.write_text("\n".join(lines), encoding="utf-8")
    prompts = spark.createDataFrame([("a#0",), ("a#1",), ("a#2",)], "custom_id string")
    joined = join_responses(prompts, read_responses(spark, str(file)))
    assert {r.custom_id: r.response for r in joined.collect()} == {
        "a#0": "zero",
        "a#1": "last",
        "a#2": NO_RESPONSE,
    }


def test_lines_of_several_files_keep_their_order(spark, tmp_path):
    """Large files are read first by Spark; the order of the names counts all the same."""
    for name, size in (("a", 3), ("b", 5000), ("c", 1)):
        lines = [answer(f"k{i % 3}", f"{name}{i} " + "x" * size) for i in range(6)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines), encoding="utf-8")
        rows = "".join(f'{i % 2},{name}{i},"d, ""{name}""\n{"y" * size}",e\n' for i in range(4))
        (tmp_path / f"{name}.csv").write_text("#,Category Name,Definition,Example\n" + rows, encoding="utf-8")
    found = read_responses(spark, [str(tmp_path / f"{n}.jsonl") for n in "cab"]).collect()
    assert {r.custom_id: r.response.strip("x ") for r in found} == {"k0": "c3", "k1": "c4", "k2": "c5"}
    rows = read_taxonomy(spark, [str(tmp_path / f"{n}.csv") for n in "bca"]).orderBy("position").collect()
    assert [(r.label, r.category, r.definition[:6]) for r in rows] == [(0, "c2", 'd, "c"'), (1, "c3", 'd, "c"')]


def test_resumed_exchange(spark, tmp_path):
    prompts = spark.createDataFrame([(f"a#{i}", f"p{i}") for i in range(10)], "custom_id string, prompt string")
    ledger = str(tmp_path / "ledger")
    asked = spark.sparkContext.accumulator(0)

    def model(answer):
        def run(texts):
            asked.add(len(texts))
            return texts.map(answer)

        return run

    first = resumed_score(prompts, model(lambda p: p.upper() if int(p[1:]) < 5 else None), ledger)
    assert sorted(r.response for r in first.collect()) == [f"P{i}" for i in range(5)] and asked.value == 10
    assert failed_prompts(read_ledger(spark, ledger)).agg(F.sum("n_failed")).first()[0] == 5
    second = resumed_score(prompts, model(str.upper), ledger)
    assert sorted(r.response for r in second.collect()) == [f"P{i}" for i in range(10)] and asked.value == 15
    assert resumed_score(prompts, model(str), ledger).count() == 10 and asked.value == 15
    assert failed_prompts(read_ledger(spark, ledger)).isEmpty()
    # A prompt that has changed under its id is open again.
    changed = prompts.withColumn("prompt", F.when(F.col("custom_id") == "a#3", "p33").otherwise(F.col("prompt")))
    assert [r.custom_id for r in open_prompts(changed, read_ledger(spark, ledger)).collect()] == ["a#3"]


def test_answers_and_errors_from_files_go_to_the_ledger(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    lines = [answer("a#1", "first"), answer("a#0", "zero"), answer("a#9", "stray")]
    (tmp_path / "good.jsonl").write_text("\n".join(lines), encoding="utf-8")
    error = [json.dumps({"custom_id": c, "error": {"code": "429"}}) for c in ("a#2", "a#2", "a#0")]
    (tmp_path / "bad.jsonl").write_text("\n".join(error), encoding="utf-8")
    prompts = spark.createDataFrame([(f"a#{i}", "p") for i in range(4)], "custom_id string, prompt string")
    responses = read_responses(spark, str(tmp_path / "good.jsonl"))
    record_answers(prompts, responses, ledger, read_errors(spark, str(tmp_path / "bad.jsonl")))
    kept = read_ledger(spark, ledger)
    assert sorted(r.custom_id for r in open_prompts(prompts, kept).collect()) == ["a#2", "a#3"]
    assert [tuple(r) for r in failed_prompts(kept).collect()] == [("a#2", 1)]
    answers = ledger_answers(prompts, kept)
    assert sorted(map(tuple, answers.collect())) == [("a#0", "zero"), ("a#1", "first")]


def test_errors(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text(answer("a#0", "x"), encoding="utf-8")
    bad.write_text(json.dumps({"custom_id": "a#1", "error": {"code": "429"}}), encoding="utf-8")
    assert read_errors(spark, str(good), strict=True).count() == 0
    failed = read_errors(spark, [str(good), str(bad)])
    assert [(r.custom_id, json.loads(r.error)) for r in failed.collect()] == [("a#1", {"code": "429"})]
    with pytest.raises(RuntimeError):
        read_errors(spark, str(bad), strict=True)


@pytest.fixture(scope="module")
def labelled(spark):
    texts = ["lead\n== A ==\n x \"y\"\nz, ", "lead\n== A ==\nxyzzy", "lead 2\n== A ==\nxyzzy"]
    rows = [("Art", i + 1, i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "article string, rev_id long, s int, wikitext string")
    revisions = df.select(
        "article", "rev_id", F.timestamp_seconds("s").alias("ts"), F.lit("u").alias("user"), "wikitext"
    )

    def embed(items):
        return items.withColumn("vec", F.array(F.lit(0.0)).cast("array<float>")).drop("content")

    def model(prompts):
        return prompts.map(lambda p: '{"1": "len"}' if "xyzzy" in p else "no idea")

    taxonomy = bundled_taxonomy(spark)
    linked = link_revisions(revisions, embed)
    prompts = prompts_for_model(linked, taxonomy, bundled_taxonomy(spark, True))
    return label_edits(prompts, score(prompts, model), taxonomy)


def test_nothing_in_nothing_out(spark):
    schema = "article string, rev_id long, ts timestamp, user string, wikitext string"
    words = spark.createDataFrame([], "token string, vec array<float>")
    linked = link_revisions(spark.createDataFrame([], schema), word_vector_embedding(words))
    taxonomy = bundled_taxonomy(spark)
    prompts = prompts_for_model(linked, taxonomy, taxonomy)
    answers = spark.createDataFrame([], "custom_id string, response string")
    result = label_edits(prompts, answers, taxonomy)
    assert result.columns == COLUMNS and result.isEmpty()


def test_chain(labelled):
    assert labelled.columns == COLUMNS
    rows = labelled.orderBy("rev_id", "section").collect()
    assert [(r.section, r.prev_content, r.content, r.labels, r.explanations) for r in rows] == [
        ("(Top)", "", "lead", None, None),
        ("A", "", 'x "y"\nz,', None, None),
        ("A", 'x "y"\nz,', "xyzzy", [1], {1: "len"}),
        ("(Top)", "lead", "lead 2", None, None),
    ]


def test_output(spark, labelled, tmp_path):
    write_csv(labelled, str(tmp_path / "csv"))
    write_parquet(labelled, str(tmp_path / "parquet"))
    header = next((tmp_path / "csv").glob("*.csv")).read_text("utf-8").splitlines()[0]
    assert [h.strip('"') for h in header.split(",")] == CSV_HEADER

    def plain(df):
        return sorted((tuple(r) for r in df.fillna("").select(*COLUMNS).collect()), key=str)

    assert plain(read_csv(spark, str(tmp_path / "csv"))) == plain(labelled)
    assert plain(spark.read.parquet(str(tmp_path / "parquet"))) == plain(labelled)
