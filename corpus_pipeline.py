"""The corpus pipeline: filter, deduplicate, decontaminate, mix and shard the table ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import contamination, mixing, sharding, toxicity
from palimpsest.llm.simhash import cluster_fingerprints, with_fingerprint
from palimpsest.materialize import cut_lineage


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under column names that no operator adds, and these names by the given ones."""
    names = {name: f"_c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that a model learned from ``labels`` doesn't take for toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain, names = numbered(docs)
    kept = toxicity.score(plain, model, names["text"]).filter(toxicity.predicted() == 0)
    return kept.select(*names.values()).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component the row with the smallest id, nulls last; of equal ids, one text.

    Null and empty texts have fingerprint zero and are one component. Without rows none come out.
    """
    plain, names = numbered(docs)
    doc_id, text = F.col(names["doc_id"]), F.col(names["text"])
    text_hash = F.xxhash64(text)
    keys = plain.select(doc_id.alias("doc_id"), text_hash.alias("text_hash"), text.alias("text"))
    clusters = cluster_fingerprints(with_fingerprint(keys))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    best = F.min_by(F.struct("doc_id", "text_hash"), order).alias("best")
    kept = clusters.groupBy("cluster").agg(best).select(
        F.col("best.doc_id").alias("_doc_id"), F.col("best.text_hash").alias("_text_hash")
    )
    same = doc_id.eqNullSafe(F.col("_doc_id")) & (text_hash == F.col("_text_hash"))
    found = plain.join(cut_lineage(kept, "kept"), same, "left_semi")
    # Rows that repeat both id and text are one document.
    one = found.withColumn("_text_hash", text_hash).dropDuplicates([names["doc_id"], "_text_hash"])
    return one.select(*names.values()).toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no item of ``benchmark``."""
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: rows appear as often as they are taken."""
    plain, names = numbered(docs)
    mixed = mixing.mix(plain, **{c: names[c] for c in ("doc_id", "text", "source")})
    return mixing.repeat_taken(mixed).select(*names.values()).toDF(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the slot and the shard of each row, in place of columns of these names."""
    kept = [c for c in docs.columns if c not in ("slot", "shard")]
    return sharding.place(docs).select(*kept, "slot", "shard")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The toxicity stage learns weights by an iterative method that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
