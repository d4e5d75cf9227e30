"""Embedding of texts as the mean of their token vectors.

``word_vectors`` is a table ``(token, vec ARRAY<FLOAT>)`` and may tell by ``n`` how frequent a token is. Of
rows with the same token the one with the greatest vector counts; rows without token or vector don't. Tokens
without a vector count as zero vectors, so a text without any known token has a zero vector.

Vectors are added in the order of the text, whichever way they came to it, so the size of the table has no
influence on the result, not even by rounding.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.text import clip, tokens

TABLE_LIMIT = 256 * 1024 * 1024
# Numbers gathered at a time.
CELLS = 4_000_000
# Words of texts that are taken together, and tokens of the table looked at together.
WORDS = 500_000
TOKENS = 1 << 16
# Steps of frequency between a number and its double.
BINS = 64

Embed = Callable[[DataFrame], DataFrame]


def word_vector_embedding(
    word_vectors: DataFrame, max_chars: int | None = None, table_limit: int = TABLE_LIMIT
) -> Embed:
    """An embedding stage: takes rows with ``content``, returns them with ``vec`` in its place.

    Of the vectors about as many as ``table_limit`` bytes hold are sent to all executors, the most frequent
    tokens first, in one file that the Python workers of a machine map together.
    A text that has others gets them by a join on the token, for which rows need ``article`` and ``seq``.
    """
    vectors = one_per_token(word_vectors)
    size = vectors.agg(
        F.coalesce(F.sum(F.octet_length("token")), F.lit(0)).alias("chars"),
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("dim"),
    ).first()
    dim, total = size["dim"], size["chars"] + size["n"] * size["dim"] * 4
    shared = []

    def frequent() -> tuple[DataFrame, DataFrame | None]:
        if total <= table_limit:
            return vectors, None
        # Rows of average size; the limit is on what they hold together.
        chosen = most_frequent(vectors, int(table_limit * size["n"] // total))
        return vectors.filter(chosen), vectors.filter(~chosen)

    def embed(df: DataFrame) -> DataFrame:
        if not shared:
            first, rest = frequent()
            shared.append((_sent(first, dim), first.select("token"), rest))
        known, first, rest = shared[0]
        words = tokens(clip(F.col("content"), max_chars))
        # Texts are shuffled as they are: their tokens take three times the room.
        met = df if rest is None else _with_others(df, words, first, rest)
        return _means(met.withColumn("_tokens", words).drop("content"), known, dim)

    return embed


def one_per_token(word_vectors: DataFrame) -> DataFrame:
    kept = word_vectors.filter(F.col("token").isNotNull() & F.col("vec").isNotNull())
    kept = kept.withColumn("vec", F.col("vec").cast("array<float>"))
    counts = kept.groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    # Most tables have none, and need not be sorted by token then.
    if counts.filter("c > 1").isEmpty():
        return kept
    most = [F.max("n").alias("n")] if "n" in kept.columns else []
    return kept.groupBy("token").agg(F.max("vec").alias("vec"), *most)


def most_frequent(vectors: DataFrame, count: int) -> Column:
    """Whether a row is among about ``count`` of the most frequent tokens.

    Nothing is sorted: a histogram of frequencies, of a bounded number of bins, tells from where on tokens are
    taken, and of the bin at the edge a share drawn by the token.
    """
    level = F.lit(0).cast("long")
    if "n" in vectors.columns:
        n = F.greatest(F.coalesce(F.col("n").cast("double"), F.lit(0.0)), F.lit(0.0))
        level = F.floor(F.log2(n + 1) * BINS)
    bins = vectors.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("size")).collect()
    for level_, size in sorted(bins, reverse=True):
        if size > count:
            drawn = F.pmod(F.xxhash64("token"), F.lit(size)) < count
            return (level > level_) | ((level == level_) & drawn)
        count -= size
    return F.lit(True)


def _sent(vectors: DataFrame, dim: int) -> str:
    """The name of an Arrow file ``(token, vec)`` that every executor gets."""
    table = vectors.select("token", "vec").toArrow()
    token, vec = (table[c].combine_chunks() for c in ("token", "vec"))
    # Vectors of other lengths are an error.
    vec.flatten().to_numpy().reshape(len(table), dim)
    folder = tempfile.mkdtemp(prefix="palimpsest-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = f"vectors-{uuid.uuid4().hex}.arrow"
    batch = pa.RecordBatch.from_arrays([token, vec], ["token", "vec"])
    with pa.OSFile(f"{folder}/{name}", "wb") as file, pa.ipc.new_file(file, batch.schema) as writer:
        writer.write_batch(batch)
    vectors.sparkSession.sparkContext.addFile(f"{folder}/{name}")
    return name


def _mapped(name: str, dim: int) -> tuple[pa.Array, np.ndarray]:
    """Tokens and their vectors, as they lie in the file: no worker holds a copy."""
    with pa.memory_map(SparkFiles.get(name)) as file:
        batch = pa.ipc.open_file(file).get_batch(0)
    return batch.column("token"), batch.column("vec").flatten().to_numpy().reshape(len(batch), dim)


def _places(words: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """The row of each word in the vocabulary, or -1. Only the words are hashed, which are the fewer."""
    encoded = words.dictionary_encode()
    distinct = encoded.dictionary
    row = np.full(len(distinct) + 1, -1, np.int64)
    for at in range(0, len(vocabulary) if len(distinct) else 0, TOKENS):
        found = pc.index_in(vocabulary.slice(at, TOKENS), value_set=distinct)
        known = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        row[found.drop_null().to_numpy()] = at + known
    return row[pc.fill_null(encoded.indices, len(distinct)).to_numpy()]


def _with_others(df: DataFrame, words: Column, first: DataFrame, rest: DataFrame) -> DataFrame:
    """Adds ``_others``, the tokens and vectors of each text that aren't broadcast."""
    key = ["article", "seq"]
    # Frequent tokens are sorted out where they are, so the join has no hot key. The outer form of
    # explode adds no filter that would find the tokens a second time.
    found = df.select(*key, F.explode_outer(F.array_distinct(words)).alias("token"))
    rare = found.join(F.broadcast(first), "token", "left_anti")
    found = rare.join(rest.select("token", "vec"), "token")
    others = found.groupBy(*key).agg(F.collect_list(F.struct("token", "vec")).alias("_others"))
    return df.join(others, key, "left")


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Whole rows of about ``WORDS`` words together, or one that has more."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("_tokens")), 0).to_numpy())
    at = 0
    while at < len(batch):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + WORDS, "right")))
        yield batch.slice(at, to - at)
        at = to


def _means(df: DataFrame, known: str, dim: int) -> DataFrame:
    names = [c for c in df.columns if c not in ("_tokens", "_others")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, matrix = _mapped(known, dim)
        for batch in batches:
            for part in _portions(batch):
                yield means(part, vocabulary, matrix)

    def means(batch: pa.RecordBatch, vocabulary: pa.Array, matrix: np.ndarray) -> pa.RecordBatch:
        lists = batch.column("_tokens")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        owner = np.repeat(np.arange(len(lists)), sizes)
        words = lists.flatten()
        rows = _places(words, vocabulary)
        more = np.zeros((0, dim), np.float32)
        if "_others" in batch.schema.names:
            others = batch.column("_others")
            flat = others.flatten()
            if len(flat):
                more = flat.field("vec").flatten().to_numpy().reshape(-1, dim)
                # A token has one vector, whichever text it came with.
                at = pc.index_in(words, value_set=flat.field("token"))
                at = pc.fill_null(at, -1).to_numpy().astype(np.int64)
                rows = np.where((rows < 0) & (at >= 0), at + len(matrix), rows)
        owner, rows = owner[rows >= 0], rows[rows >= 0]
        sums = _sums(matrix, more, rows, owner, len(lists))
        found = (sums / np.maximum(sizes, 1)[:, None]).astype(np.float32)
        offsets = np.arange(len(lists) + 1, dtype=np.int32) * dim
        vec = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.reshape(-1)))
        kept = batch.select(names)
        return pa.RecordBatch.from_arrays([*kept.columns, vec], names=[*names, "vec"])

    schema = T.StructType(df.select(*names).schema.fields).add("vec", T.ArrayType(T.FloatType()))
    return df.mapInArrow(run, schema)


def _sums(matrix: np.ndarray, more: np.ndarray, rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each owner the sum of its rows, one after the other. ``owner`` ascends, and rows of ``more``
    are numbered after those of ``matrix``."""
    dim = matrix.shape[1]
    sums = np.zeros((n, dim))
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    ends = np.append(starts[1:], len(rows))
    step = max(1, CELLS // max(dim, 1))
    at = 0
    while at < len(starts):
        # Whole texts, as many as fit, or one that doesn't.
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + step, "right")))
        part = slice(starts[at], ends[to - 1])
        gathered = np.empty((part.stop - part.start, dim))
        common = rows[part] < len(matrix)
        gathered[common] = matrix[rows[part][common]]
        gathered[~common] = more[rows[part][~common] - len(matrix)]
        sums[owner[starts[at:to]]] = np.add.reduceat(gathered, starts[at:to] - starts[at], axis=0)
        at = to
    return sums


def column_embedding(embedder: Callable[[Column], Column], max_chars: int | None = None) -> Embed:
    """An embedding stage around a user's own model, given as a pandas UDF of the text."""

    def embed(df: DataFrame) -> DataFrame:
        vec = embedder(clip(F.col("content"), max_chars)).cast("array<float>")
        return df.withColumn("vec", vec).drop("content")

    return embed


def stored_embedding(embed: Embed, path: str) -> Embed:
    """An embedding stage that embeds each distinct text once, over all runs with the same ``path``.

    The folder holds ``(text_id, vec)``, by fingerprint of the text. Only texts that are not there are
    sent to ``embed``, one of each, and added; all rows get their vectors from the folder. It belongs to
    one model: another one, or another ``max_chars``, needs another folder.
    """

    def stored(df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        content = F.coalesce("content", F.lit(""))
        keyed = df.withColumn("_text_id", F.sha2(content, 256))
        texts = keyed.select(F.col("_text_id").alias("text_id"), content.alias("content"))
        try:
            texts = texts.join(spark.read.parquet(path).select("text_id"), "text_id", "left_anti")
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        distinct = texts.groupBy("text_id").agg(F.first("content").alias("content"))
        # As an article with one edit, for stages that ask for these.
        rows = distinct.select("text_id", F.col("text_id").alias("article"), F.lit(0).alias("seq"), "content")
        embed(rows).select("text_id", "vec").write.mode("append").parquet(path)
        # Runs at the same time may both add a text.
        key = F.col("text_id").alias("_text_id")
        vectors = spark.read.parquet(path).groupBy(key).agg(F.first("vec").alias("vec"))
        return keyed.drop("content", "vec").join(vectors, "_text_id", "left").drop("_text_id")

    return stored
