"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import TOP, tokens
from palimpsest.materialize import cut_lineage
from palimpsest.operators.embed import Embed, word_vector_embedding

EPOCH = 978307200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wiki-style revisions: eight documents make an article, each rewrites one of four sections.

    Some revisions are blank, some users are missing, sections get new titles late in the history,
    and some texts hold a title twice.
    """
    doc, turn = F.col("doc_id"), F.col("doc_id") % 8
    history = Window.partitionBy("art").orderBy("doc_id")

    def latest(place: int) -> Column:
        return F.last(F.when(turn % 4 == place, F.col("text")), ignorenulls=True).over(history)

    def section(heading: str | Column, body: str) -> Column:
        head = F.lit(heading) if isinstance(heading, str) else heading
        return F.concat(head, F.lit("\n"), F.col(body))

    method = F.when(turn >= 5, "=== Method/x ===").otherwise("=== Methods ===")
    uses = (
        F.when(doc % 13 == 4, "==History==")
        .when(turn >= 7, "==Applications==")
        .otherwise("==Uses== ")
    )
    text = F.concat_ws(
        "\n", "b0", section("== History ==", "b1"), section(method, "b2"), section(uses, "b3")
    )
    bodies = table(spark, sf_dir, "documents").withColumn("art", doc - turn)
    for place in range(4):
        bodies = bodies.withColumn(f"b{place}", latest(place))
    return bodies.select(
        F.concat(F.lit("a"), F.col("art").cast("string")).alias("article"),
        doc.alias("rev_id"),
        F.timestamp_seconds(F.lit(EPOCH) + doc * 3600).alias("ts"),
        F.when(doc % 7 == 0, F.lit(None)).otherwise(F.col("source")).alias("user"),
        F.when(doc % 11 == 5, "").otherwise(text).alias("wikitext"),
    )


def source_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a revision of its source's article, under headings that take turns."""
    doc = F.col("doc_id")
    heads = F.array(F.lit("== A ==\n"), F.lit("=== B ===\n"), F.lit("== A ==\nx\n== C/d ==\n"))
    text = F.concat("lang", F.lit("\n"), F.get(heads, (doc % 3).cast("int")), "text")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("article"),
        doc.alias("rev_id"),
        F.timestamp_seconds(F.lit(EPOCH) + F.floor(doc / 4) * 3600).alias("ts"),
        F.col("lang").alias("user"),
        F.when(doc % 11 == 5, "").otherwise(text).alias("wikitext"),
    )


def source_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an edit of its source's article; few articles with long histories."""
    lang = F.col("lang")
    title = F.when(F.col("doc_id") % 5 == 0, TOP).otherwise(F.concat(F.lit("Notes in "), lang))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("article"),
        F.col("doc_id").alias("rev_id"),
        # Many edits share a time, so the order falls back on the revision number.
        F.timestamp_seconds(F.lit(EPOCH) + F.floor(F.col("doc_id") / 4) * 3600).alias("ts"),
        title.alias("section"),
        F.col("text").alias("content"),
    )


def turn_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as section edits: the conversation is the article, the role the title."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("article"),
        F.col("turn").alias("rev_id"),
        F.col("turn").alias("seq"),
        F.col("role").alias("section"),
        F.col("text").alias("content"),
    )


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for each token, drawn from ``embeddings`` by its hash."""
    embeddings = table(spark, sf_dir, "embeddings")
    n = embeddings.agg(F.count(F.lit(1))).scalar()
    slot = F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long") % F.col("n")
    return (
        table(spark, sf_dir, "documents")
        .select(F.explode_outer(tokens(F.col("text"))).alias("token"))
        .filter(F.col("token").isNotNull())
        .groupBy("token")
        .count()
        .withColumn("n", n)
        .select("token", F.col("count").alias("n"), slot.alias("vec_id"))
        .join(embeddings, "vec_id")
        .select("token", "n", F.col("embedding").alias("vec"))
    )


_embeddings: dict[tuple[str, str], Embed] = {}


def embedding(spark: SparkSession, sf_dir: str) -> Embed:
    """The word vectors as a model, which a session loads once and uses for all its queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _embeddings:
        vectors = cut_lineage(word_vectors(spark, sf_dir), "vectors")
        _embeddings[key] = word_vector_embedding(vectors)
    return _embeddings[key]


# Forms of answer: {0} is the label, {1} a second one, {2} the document's source.
JSON_ANSWERS = [
    '{{"{0}": "from {2}"}}',
    'Here it is:\n```json\n{{"{0}": " from {2} ", "{1}": "also"}}\n```\nDone.',
    '{{"{0}": "from {2}", "0{0}": "again"}}',
    '{{" WORKED example ":"from {2}", "9": "again"}}',
]
TEXT_ANSWERS = [
    "Explanation: from {2}\nLabels: {0}, {1}.",
    "Labels: {0} {1}\nExplanation:  from {2}\n",
]
BAD_ANSWERS = [
    '{{"{0}": "from {2}", "99": "unknown"}}',
    '{{"11": "from {2}"}} trailing',
]
ANSWERS = JSON_ANSWERS + TEXT_ANSWERS + BAD_ANSWERS


def answers(spark: SparkSession, sf_dir: str, forms: list[str] = ANSWERS) -> DataFrame:
    """Model answers built from the quality labels, so that the labels they hold are known.

    The forms take turns by document number.
    """
    joined = table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id"
    )
    first = F.when(F.col("quality") == 1, "1").otherwise("11")
    second = F.when(F.col("toxic") == 1, "5").otherwise("2")
    filled = [
        F.format_string(text.format("%1$s", "%2$s", "%3$s"), first, second, F.col("source"))
        for text in forms
    ]
    form = (F.col("doc_id") % len(forms)).cast("int")
    return joined.select(
        F.col("doc_id").cast("string").alias("custom_id"),
        "doc_id",
        F.get(F.array(*filled), form).alias("response"),
    )
