"""How the registered queries make and read their inputs."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.embed import word_vector_embedding
from workload import queries


@pytest.fixture
def documents(spark, tmp_path):
    rows = spark.range(40).select(
        F.col("id").alias("doc_id"),
        F.format_string("text %s\nof two lines", F.col("id")).alias("text"),
        F.lit("web").alias("source"),
        F.lit("en").alias("lang"),
    )
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def moved(df, column, capsys):
    """Shuffles of the plan that move a column."""
    df.explain("formatted")
    nodes = capsys.readouterr().out.split("\n\n")
    return [n for n in nodes if ") Exchange" in n.split("\n")[0] and f"{column}#" in n]


def test_files_of_a_taxonomy_grow_with_the_partitions(spark, documents):
    """Cells hold line breaks, so a file is read by one task."""
    settings = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = queries.taxonomy_files(spark, documents)
        assert len(found.inputFiles()) > 4
        assert found.count() == 40
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_parts_of_a_history_do_not_make_it_again(spark, documents, capsys):
    assert not moved(queries.carried_state(spark, documents), "text", capsys)


def test_tokens_are_not_shuffled_to_meet_their_vectors(spark, capsys):
    words = [("a", [1.0], 9), ("b", [2.0], 1)]
    vectors = spark.createDataFrame(words, "token string, vec array<float>, n long")
    df = spark.createDataFrame([("x", 0, "a b"), ("x", 1, "b")], "article string, seq long, content string")
    embedded = word_vector_embedding(vectors, table_limit=0)(df)
    assert not moved(embedded, "_tokens", capsys)
    assert [r.vec for r in embedded.orderBy("seq").collect()] == [[1.5], [2.0]]
