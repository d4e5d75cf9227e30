import random
import re

import numpy as np
import pytest
from emulation import links_of, title_similarity
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.similarity import cosine
from palimpsest.functions.similarity import title_similarity as title_similarity_column
from palimpsest.operators import link as link_module
from palimpsest.operators.changes import section_edits
from palimpsest.operators.embed import (
    column_embedding,
    most_frequent,
    stored_embedding,
    word_vector_embedding,
)
from palimpsest.operators.link import (
    _encoded,
    link_edits,
    link_types,
    similar_contents,
    similar_titles,
)
from palimpsest.operators.prompts import is_first_time
from palimpsest.operators.report import linking_stats, match_distance_stats, match_type_stats

ITEMS = "article string, seq long, rev_id long, section string, content string, vec array<float>"


def given_vectors(df):
    """An embedding that looks the vectors up by text: 'x y' stands for the vector (x, y)."""
    numbers = F.transform(F.split("content", " "), lambda x: F.coalesce(x.try_cast("float"), F.lit(0.0)))
    padded = F.slice(F.concat(numbers, F.array(F.lit(0.0), F.lit(0.0))), 1, 2)
    return df.withColumn("vec", padded.cast("array<float>")).drop("content")


def linked(spark, items, **settings):
    schema = "article string, seq long, rev_id long, section string, content string"
    rows = [(i["article"], i["seq"], i["rev_id"], i["section"], i["content"]) for i in items]
    edits = spark.createDataFrame(rows, schema).repartition(3)
    return link_edits(edits, given_vectors, **settings)


def item(article, seq, rev_id, section, content):
    vec = [float(x) for x in content.split()] if content else [0.0, 0.0]
    return dict(article=article, seq=seq, rev_id=rev_id, section=section, content=content, vec=vec)


CASES = [
    (1, "(Top)", "1 0"),
    (1, "Methods", "0 1"),
    (2, "(Top)", "0 1"),
    (2, "Method", "0 2"),
    (3, "Uses", "2 0"),
    (4, "(Top)", "3 0"),
    (5, "", "0 0"),
    (6, "", "0 0"),
]
EXPECTED = [
    ("first-time", None, 0),
    ("none", None, 0),
    ("title", 0, 2),
    ("both", 1, 2),
    ("content", 0, 4),
    ("both", 0, 5),
    ("none", None, 0),
    ("content", 6, 1),
]


@pytest.mark.parametrize("lookback", [1000, 2])
def test_cases(spark, lookback):
    items = [item("a", seq, *case) for seq, case in enumerate(CASES)]
    rows = linked(spark, items, lookback=lookback).orderBy("seq").collect()
    expected = list(EXPECTED)
    if lookback == 2:
        expected[4] = expected[5] = ("none", None, 0)
    seqs = [r.seq - r.match_distance if r.match_distance else None for r in rows]
    assert [(r.match_type, s, r.match_distance) for r, s in zip(rows, seqs)] == expected
    for r, s in zip(rows, seqs):
        before = items[s] if s is not None else dict.fromkeys(("rev_id", "section", "content"))
        assert (r.prev_rev_id, r.prev_section, r.prev_content) == (
            before["rev_id"], before["section"], before["content"],
        )


@pytest.mark.parametrize(("lookback", "block"), [(15, 15), (4, 4), (15, 1000), (1000, 1000)])
def test_against_sequential_emulation(spark, monkeypatch, lookback, block):
    monkeypatch.setattr(link_module, "MIN_BLOCK", block)
    rng = random.Random(lookback)
    titles = ["(Top)", "Methods", "Method", "Uses", "Use", "", "History", "Histories", "12345", "12346"]
    items = []
    for a in range(12):
        # One article holds most of the edits, so that it spans many blocks.
        for seq in range(400 if a == 0 else rng.randint(1, 40)):
            vec = f"{rng.randint(0, 9)} {rng.randint(0, 9)}"
            items.append(item(f"a{a}", seq, seq // 3, rng.choice(titles), vec))
    rows = linked(spark, items, lookback=lookback).collect()
    found = {(r.article, r.seq): (r.match_type, r.match_distance) for r in rows}
    assert len(rows) == len(items) == len(found)
    for a in {i["article"] for i in items}:
        own = [i for i in items if i["article"] == a]
        for seq, (kind, previous) in enumerate(links_of(own, 0.8, 0.99, lookback)):
            distance = seq - previous if previous is not None else 0
            assert found[a, seq] == (kind, distance), (a, seq)


def test_batched_title_similarity():
    rng = random.Random(3)
    titles = ["", "a", "\U0001f600b", "é" * 300, "é" * 250 + "x" * 50]
    titles += ["".join(rng.choice("abcß") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    titles = list(dict.fromkeys(titles))
    i, j = (x.ravel() for x in np.meshgrid(range(len(titles)), range(len(titles))))
    for threshold in (0.0, 0.5, 0.8, 1.0):
        found = similar_titles(_encoded(titles), i, j, threshold)
        expected = [title_similarity(titles[x], titles[y]) >= threshold for x, y in zip(i, j)]
        assert found.tolist() == expected


def test_similarity_columns(spark):
    pairs = [("Methods", "Method"), ("12345", "12346"), ("", ""), ("é", "e"), ("", "x")]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", title_similarity_column(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in rows] == [title_similarity(r.a, r.b) for r in rows]
    vectors = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [1.0, 0.0])]
    df = spark.createDataFrame(vectors, "a array<float>, b array<float>")
    rows = df.select(cosine(F.col("a"), F.col("b")).alias("s")).collect()
    assert [round(r.s, 9) for r in rows] == [1.0, 0.0, round(0.5**0.5, 9)]


def test_all_ways_to_embed_agree(spark):
    """Broadcast, partly broadcast and joined; of a repeated token the greatest vector counts."""
    words = [("a", [1.0, 0.0], 5), ("a", [0.0, 9.0], 7), ("b", [0.0, 1.0], 9), (".", [4.0, 4.0], 1)]
    words += [(None, [1.0, 1.0], 3), ("nothing", None, 2)]
    vectors = spark.createDataFrame(words, "token string, vec array<float>, n long")
    texts = ["a b", "a a unknown.", "", None, "nothing known", "a" * 20, "b " * 6000]
    rows = [("x", i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "article string, seq long, content string")
    expected = [[0.5, 0.5], [1.5, 1.0], [0, 0], [0, 0], [0, 0], [0, 0], [0.0, 1.0]]
    for limit in (1 << 20, 20, 10, 0):
        embed = word_vector_embedding(vectors, table_limit=limit)
        found = embed(df).orderBy("seq").collect()
        assert [r.vec for r in found] == expected, limit


def test_frequent_tokens_are_chosen_without_a_sort(spark):
    """A limit would bring all of them to one task."""
    rows = [(f"t{i}", 1000 // (i + 1)) for i in range(2000)]
    vectors = spark.createDataFrame(rows, "token string, n long")
    for count in (0, 10, 300, 5000):
        found = vectors.filter(most_frequent(vectors, count))
        assert not re.search("Limit|TakeOrdered|Sort", found._jdf.queryExecution().toString())
        n = [r.n for r in found.collect()]
        assert abs(len(n) - min(count, 2000)) <= 100 and (count < 2000 or len(n) == 2000)
        least, most = min(n, default=1000), max((r[1] for r in rows if r[1] not in n), default=0)
        # Of frequencies as like as two bins are, tokens are drawn.
        assert most <= 1.02 * least
    assert vectors.drop("n").filter(most_frequent(vectors.drop("n"), 0)).isEmpty()
    assert 400 < vectors.drop("n").filter(most_frequent(vectors.drop("n"), 500)).count() < 600


def test_limits_do_not_touch_a_bit(spark):
    rng = np.random.default_rng(5)
    names = [f"t{i}" for i in range(300)]
    words = [(t, rng.normal(size=7).tolist(), i) for i, t in enumerate(names)]
    vectors = spark.createDataFrame(words, "token string, vec array<float>, n long")
    texts = [" ".join(rng.choice(names, rng.integers(0, 400))) for _ in range(40)]
    df = spark.createDataFrame([("x", i, t) for i, t in enumerate(texts)], "article string, seq long, content string")
    found = [
        [r.vec for r in word_vector_embedding(vectors, table_limit=limit)(df).orderBy("seq").collect()]
        for limit in (1 << 20, 3000, 0)
    ]
    assert found[0] == found[1] == found[2]
    by_token = {t: np.array(v, np.float32) for t, v, _ in words}
    means = [np.mean([by_token[t] for t in x.split()], axis=0, dtype=np.float64) if x else np.zeros(7) for x in texts]
    assert np.allclose(found[0], means, atol=1e-6)


def test_each_text_is_embedded_once(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def embed(df):
        @F.pandas_udf("array<float>")
        def length(texts):
            asked.add(len(texts))
            return texts.map(lambda t: [float(len(t))])

        return column_embedding(length)(df)

    stored = stored_embedding(embed, str(tmp_path / "vectors"))
    texts = ["a", "bb", "a", None, "", "ccc", "bb"] * 20
    df = spark.createDataFrame(
        [(i, t, "kept") for i, t in enumerate(texts)], "n int, content string, text_id string"
    )
    for rows in (df, df, df.union(df.limit(5))):
        found = stored(rows)
        assert found.columns == ["n", "text_id", "vec"]
        assert all(r.vec == [len(texts[r.n] or "")] and r.text_id == "kept" for r in found.collect())
        # The null counts as an empty text.
        assert asked.value == 4
    more = spark.createDataFrame([(0, "new", "x")], df.schema)
    stored(more).collect()
    assert asked.value == 5


def exchanges_of(df, column, capsys):
    """Shuffles of the plan that move a column."""
    df.explain("formatted")
    nodes = capsys.readouterr().out.split("\n\n")
    moved = [n for n in nodes if ") Exchange" in n.split("\n")[0] or ") Exchange" in n[:12]]
    return [n for n in moved if f"{column}#" in n]


def test_texts_are_shuffled_twice(spark, tmp_path, capsys):
    """Once to their changed sections, and once to meet their previous versions."""
    rows = [("a", i, i, None, f"lead {i}\n== A ==\n{i // 2}") for i in range(20)]
    schema = "article string, rev_id long, second int, user string, wikitext string"
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("second")).write.parquet(str(tmp_path / "revs"))
    edits = section_edits(spark.read.parquet(str(tmp_path / "revs")))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(exchanges_of(edits, "wikitext", capsys)) == 1
        edits.write.parquet(str(tmp_path / "edits"))
        edits = spark.read.parquet(str(tmp_path / "edits"))

        def embed(df):
            return df.withColumn("vec", F.array(F.lit(1.0)).cast("array<float>")).drop("content")

        linked = link_edits(edits, embed)
        assert len(exchanges_of(linked, "_edit", capsys)) == 1
        assert not exchanges_of(linked, "content", capsys)
        assert not exchanges_of(link_types(edits, embed), "content", capsys)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_types_without_texts(spark):
    rng = random.Random(11)
    rows = []
    for article in ("a", "b"):
        for seq in range(300):
            rev_id = None if rng.random() < 0.1 else seq // 2
            rows.append((article, seq, rev_id, rng.choice(["(Top)", "Uses", "Use", "Other"]), rng.choice(["", None, "1 0", "0 1", "2 1"])))
    edits = spark.createDataFrame(rows, "article string, seq long, rev_id long, section string, content string")
    edits = edits.fillna(-1, ["rev_id"])
    linked = link_edits(edits, given_vectors, lookback=40)
    narrow = link_types(edits, given_vectors, lookback=40)
    expected = linked.withColumn("is_first_time", is_first_time())
    key = ["article", "seq", "match_type", "match_distance", "is_first_time"]
    assert sorted(map(tuple, narrow.select(*key).collect())) == sorted(map(tuple, expected.select(*key).collect()))
    by_seq = {(r.article, r.seq): r for r in linked.collect()}
    for r in by_seq.values():
        if r.match_distance:
            previous = by_seq[r.article, r.seq - r.match_distance]
            assert (r.prev_content, r.prev_section, r.prev_rev_id) == (previous.content, previous.section, previous.rev_id)
        else:
            assert r.prev_section is None


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_bounds_spare_products(spread):
    rng = np.random.default_rng(0)
    base = rng.normal(size=100)
    vectors = base + spread * rng.normal(size=(400, 100))
    vectors[::7] = vectors[3]
    vectors[5] = 0
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
    allowed = rng.random((400, 400)) < 0.7
    same = rng.random((400, 400)) < 0.01
    similar, products = similar_contents(unit, unit, allowed, same, 0.99)
    assert (similar == allowed & (same | (unit @ unit.T >= 0.99))).all()
    if spread == 1.0:
        assert products < 0.1 * allowed.sum()
    assert not similar_contents(unit, unit, allowed, same, 2.0)[0].any()


def test_text_is_cut_before_embedding(spark):
    words = spark.createDataFrame([("a", [1.0]), ("b", [9.0])], "token string, vec array<float>")
    df = spark.createDataFrame([("x", 0, "a a b b")], "article string, seq long, content string")
    assert word_vector_embedding(words, max_chars=3)(df).first().vec == [1.0]


def test_without_word_vectors_only_titles_and_equal_texts_match(spark):
    rows = [("x", 0, 1, "A", "t"), ("x", 1, 2, "B", "t"), ("x", 2, 3, "C", "u"), ("x", 3, 4, "C", "v")]
    edits = spark.createDataFrame(
        rows, "article string, seq long, rev_id long, section string, content string"
    )
    empty = spark.createDataFrame([], "token string, vec array<float>")
    found = link_edits(edits, word_vector_embedding(empty)).orderBy("seq").collect()
    assert [r.match_type for r in found] == ["first-time", "content", "none", "title"]


def test_own_model_as_embedding(spark):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def lengths(texts):
        return texts.map(lambda t: [float(len(t)), 1.0])

    df = spark.createDataFrame([("x", 0, "abc"), ("x", 1, None)], "article string, seq long, content string")
    found = column_embedding(lengths)(df).orderBy("seq").collect()
    assert [r.vec for r in found] == [[3.0, 1.0], [0.0, 1.0]]


def test_statistics(spark):
    items = [item("a", seq, *case) for seq, case in enumerate(CASES)]
    result = linked(spark, items)
    types = {r.match_type: (r.n, r.percent) for r in match_type_stats(result).collect()}
    assert types["none"] == (2, 25.0) and types["both"] == (2, 25.0)
    stats = match_distance_stats(result).first()
    assert (stats.n_linked, stats.avg_distance, stats.max_distance) == (5, 14 / 5, 5)
    totals = linking_stats(result, 0.8, 0.99, 1000).first()
    assert (totals.n_edits, totals.n_embeddings, totals.lookback) == (8, 8, 1000)


def test_links_do_not_join_edits_by_article_alone(spark, capsys):
    items = [item("a", seq, *case) for seq, case in enumerate(CASES)]
    linked(spark, items).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
