"""What stays on disk while a chain of stages runs."""

import glob
import os
import random

import pytest
from palimpsest.materialize import cut_lineage, drop_tables
from palimpsest.operators import changes
from palimpsest.operators.link import link_edits
from palimpsest.operators.prompts import build_prompts
from palimpsest.plans.chain import prompts_for_model
from palimpsest.sources.output import COLUMNS, write_parquet
from palimpsest.sources.taxonomy import bundled_taxonomy
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

EDITS = "article string, seq long, rev_id long, section string, content string"


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for folder in manager.localDirs() for f in glob.glob(f"{folder.getPath()}/**/shuffle_*", recursive=True)}


def embed(df):
    return df.withColumn("vec", F.array(F.lit(1.0)).cast("array<float>")).drop("content")


def test_a_written_table_leaves_no_shuffle(spark):
    before = shuffle_files(spark)
    counts = spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count()
    table = cut_lineage(counts)
    assert not shuffle_files(spark) - before
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, counts.collect()))


def test_links_are_written_before_texts_are_shuffled(spark):
    rows = [("x", i, i, "t", "same") for i in range(9)]
    edits = cut_lineage(spark.createDataFrame(rows, EDITS), "edits")
    before = shuffle_files(spark)
    linked = link_edits(edits, embed)
    assert not shuffle_files(spark) - before
    assert any("/links-" in f for f in linked.inputFiles())
    assert sorted((r.seq, r.match_distance) for r in linked.collect()) == [(i, min(i, 1)) for i in range(9)]


def test_texts_are_written_with_zstd(spark, tmp_path):
    rows = [("x", i, i, "t", "same") for i in range(9)]
    edits = spark.createDataFrame(rows, EDITS)
    prompts = prompts_for_model(link_edits(edits, embed), bundled_taxonomy(spark), bundled_taxonomy(spark, True))
    assert prompts.count() == 9 and all(f.endswith(".zstd.parquet") for f in prompts.inputFiles())
    assert {r.prompt for r in prompts.collect()} == {
        r.prompt for r in build_prompts(link_edits(edits, embed), bundled_taxonomy(spark), bundled_taxonomy(spark, True)).collect()
    }
    labelled = edits.select(*(F.col(c) if c in edits.columns else F.lit("x").alias(c) for c in COLUMNS))
    write_parquet(labelled, str(tmp_path / "out"), codec="zstd")
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == 9 and all(f.endswith(".zstd.parquet") for f in found.inputFiles())


def revisions_of(spark, n):
    """Each revision rewrites one of five sections; lines repeat, and some are empty."""
    rng = random.Random(n)
    bodies, rows = [f"first {i}" for i in range(5)], []
    for i in range(n):
        bodies[rng.randrange(5)] = "\n".join(rng.choice(["", "same", f"line {i}", "x" * 300]) for _ in range(rng.randrange(6)))
        text = bodies[0] + "".join(f"\n== S{k} ==\n{body}" for k, body in enumerate(bodies[1:]))
        rows.append(("ab"[i % 2], i, rng.choice([None, i]), None, text))
    schema = "article string, rev_id long, second int, user string, wikitext string"
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("second")).drop("second")


NAMES = ["article", "ts", "rev_id"]


def sets_of(revisions):
    return cut_lineage(changes._edit_sets(changes._outlines(revisions), NAMES[1:], None))


def from_whole_texts(sets, revisions):
    key = F.struct(*NAMES).alias("_key")
    found = sets.withColumn("_key", key).join(revisions.select(key, "wikitext"), "_key")
    bodies = changes.filled(F.col("wikitext"), F.col("sections"))
    return sorted(map(str, changes._rows(found.withColumn("sections", bodies).drop("wikitext", "_key")).collect()))


def test_lines_of_other_sections_are_not_sent(spark):
    revisions = revisions_of(spark, 200)
    sets = sets_of(revisions)
    sent = changes._asked_lines(revisions, NAMES, changes._line_bits(sets, NAMES, changes.MOST_BITS))
    size = F.sum(F.length("wikitext"))
    assert sent.agg(size).first()[0] < 0.6 * revisions.agg(size).first()[0]
    expected = from_whole_texts(sets, revisions)
    assert len(expected) > 200
    # Also where the bitmap is too small to leave out much.
    for most_bits in (changes.MOST_BITS, changes.WORD_BITS):
        assert sorted(map(str, changes._with_bodies(sets, revisions, most_bits).collect())) == expected


def test_revisions_with_the_same_key_get_the_same_lines(spark):
    """They are not told apart; each gives its own text to the changes of either."""
    revisions = revisions_of(spark, 60)
    other = F.concat(F.lit("more\n"), F.reverse("wikitext")).alias("wikitext")
    revisions = revisions.union(revisions).union(revisions.select("article", "rev_id", "user", other, "ts"))
    sets = sets_of(revisions)
    assert sorted(map(str, changes._with_bodies(sets, revisions).collect())) == from_whole_texts(sets, revisions)


def test_tables_are_dropped_by_name(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "kept"))
    own = spark.read.parquet(str(tmp_path / "kept"))
    table = cut_lineage(own.withColumn("x", F.lit(1)))
    folder = os.path.dirname(table.inputFiles()[0])
    drop_tables(table.join(own, "id"))
    assert own.count() == 5
    with pytest.raises(PySparkException):
        spark.read.parquet(folder)
