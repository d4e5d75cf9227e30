"""What a Python worker holds at a time."""

import numpy as np
import pyarrow as pa

from palimpsest.operators import embed


def test_vectors_are_mapped_not_copied(spark):
    rows = [(f"t{i}", [float(i), 1.0]) for i in range(20_000)]
    vectors = spark.createDataFrame(rows, "token string, vec array<float>")
    name = embed._sent(vectors, 2)
    before = pa.total_allocated_bytes()
    tokens, matrix = embed._mapped(name, 2)
    assert pa.total_allocated_bytes() == before
    assert not matrix.flags.owndata and matrix.shape == (20_000, 2)
    words = pa.array(["t7", "none", "t19999", "t7", None])
    places = embed._places(words, tokens)
    assert (places >= 0).tolist() == [True, False, True, True, False]
    assert matrix[places[places >= 0], 0].tolist() == [7.0, 19999.0, 7.0]


def test_no_vectors(spark):
    vectors = spark.createDataFrame([], "token string, vec array<float>")
    tokens, matrix = embed._mapped(embed._sent(vectors, 0), 0)
    assert len(tokens) == 0 and matrix.shape == (0, 0)
    assert embed._places(pa.array(["a"]), tokens).tolist() == [-1]
    assert embed._places(pa.array([], pa.string()), tokens).tolist() == []


def test_words_are_taken_in_portions(monkeypatch):
    monkeypatch.setattr(embed, "WORDS", 5)
    lists = [["a"] * 3, None, ["a"] * 2, ["a"] * 9, [], ["a"]]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], ["_tokens"])
    parts = [part.column("_tokens").to_pylist() for part in embed._portions(batch)]
    assert parts == [lists[:3], lists[3:4], lists[4:]]


def test_portions_and_tables_change_no_mean(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = [(f"t{i}", [float(x) for x in rng.normal(size=3)]) for i in range(50)]
    texts = [("a", i, " ".join(f"t{j}" for j in rng.integers(0, 80, i % 7))) for i in range(200)]
    table = spark.createDataFrame(vectors, "token string, vec array<float>")
    edits = spark.createDataFrame(texts, "article string, seq long, content string")
    found = {r.seq: r.vec for r in embed.word_vector_embedding(table)(edits).collect()}
    known = {t: np.array(v, np.float32).astype(float) for t, v in vectors}
    for _, seq, text in texts:
        words = text.split()
        mean = sum((known.get(w, np.zeros(3)) for w in words), np.zeros(3)) / max(len(words), 1)
        assert np.allclose(found[seq], mean, atol=1e-6)
