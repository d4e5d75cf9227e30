"""Mixing sources to target weights by hash-threshold histograms.

A document's size is its number of words. Sources, in code point order with null last, weigh ``weights``
by turns and share ``share`` times all words; no source gets more than ``cap`` times its own, and the
excess is shared again by weight until none is above.

A source takes all its documents as often as its target allows, and of the rest those whose hash lies
below a threshold. Words are summed by source and hash bucket, the bucket in which the budget ends is
found, and only that one is summed again by finer buckets, down to single hashes: no document is
sorted. The thresholds are nested, so a larger budget takes a superset. The hash comes from id and
text, so reruns agree; rows alike in both are taken or left together. At the boundary, the nearer of
the two totals is chosen, so a source misses its target by half a document at most.

Null and empty texts have size 0, and nothing is taken of them. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.text import WORD
from palimpsest.materialize import cut_lineage
from palimpsest.operators.ordering import number_rows

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
# Bits of the hash that thresholds may use, and how many of them one histogram resolves.
BITS = 60
STEP = 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column) -> Column:
    """A number from 0 to 2**60 - 1 by id and text."""
    word = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text))
    return F.conv(F.substring(F.md5(word), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """``(source, source_size, target)`` from rows with ``source`` and ``size``."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = totals.withColumn("_last", F.col("source").isNull()).withColumn("_all", F.lit(0))
    ranked = number_rows(cut_lineage(totals, "sources"), ["_all"], ["_last", "source"], "_rank")
    turn = (F.col("_rank") % len(weights)).cast("int")
    weight = F.get(F.array(*map(F.lit, weights)), turn)
    most = F.col("source_size") * cap
    table = cut_lineage(
        ranked.select("source", "source_size", most.alias("most"), weight.alias("weight")),
        "sources",
    )
    whole = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    # Sources that reach their cap leave the sharing, which can only raise the others.
    level, capped = 0.0, -1
    while True:
        full = F.col("most") <= F.col("weight") * level if capped >= 0 else F.lit(False)
        row = table.agg(
            F.count_if(full).alias("n"),
            F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0)).alias("used"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if row["n"] == capped or not row["weight"]:
            break
        capped, level = row["n"], (whole * share - row["used"]) / row["weight"]
    own = F.col("weight") * F.lit(level)
    target = F.when(F.col("most") <= own, F.col("most").cast("double")).otherwise(own)
    return table.select("source", "source_size", target.alias("target"))


def source_thresholds(sizes: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """``(source, source_size, target, copies, threshold)``: documents below it come once more.

    ``sizes`` has ``source, size, draw`` and is read once per histogram, so it should be a table.
    """
    whole = F.floor(F.col("target") / F.col("source_size"))
    copies = F.coalesce(F.least(whole, F.lit(cap)), F.lit(0)).cast("long")
    bounds = targets.withColumn("copies", copies).select(
        "*",
        (F.col("target") - F.col("copies") * F.col("source_size")).alias("rest"),
        F.lit(0).cast("long").alias("before"),
        F.lit(0).cast("long").alias("prefix"),
    )
    level = 1 << BITS
    bounds = bounds.withColumn("threshold", F.lit(level))
    for shift in range(BITS - STEP, -1, -STEP):
        # Sources whose budget is not used up within any bucket have no boundary to refine.
        open_ = bounds.select(
            F.col("source").alias("_source"), "rest", "before", "prefix"
        )
        near = F.shiftright("draw", shift + STEP) == F.col("prefix")
        inside = sizes.join(open_, F.col("source").eqNullSafe(F.col("_source")) & near)
        sums = inside.groupBy(
            "_source", "rest", "before", F.shiftright("draw", shift).alias("bucket")
        ).agg(F.sum("size").alias("sum"))
        upto = F.sum("sum").over(Window.partitionBy("_source").orderBy("bucket"))
        sums = sums.withColumn("upto", F.col("before") + upto)
        edge = (
            sums.filter("upto > rest")
            .groupBy("_source")
            .agg(F.min_by(F.struct("bucket", "sum", "upto"), "bucket").alias("edge"))
        )
        joined = bounds.drop("before", "prefix").join(
            edge, F.col("source").eqNullSafe(F.col("_source")), "left"
        )
        before = F.col("edge.upto") - F.col("edge.sum")
        nearer = before + F.col("edge.sum") / 2 <= F.col("rest")
        last = F.when(nearer, F.col("edge.bucket") + 1).otherwise(F.col("edge.bucket"))
        found = last if shift == 0 else F.shiftleft(F.col("edge.bucket"), shift)
        bounds = cut_lineage(
            joined.select(
                *targets.columns,
                "copies",
                "rest",
                before.alias("before"),
                F.col("edge.bucket").alias("prefix"),
                # Without an edge everything is taken, or what was found at a coarser level stands.
                F.coalesce(found, F.col("threshold")).alias("threshold"),
            ),
            "bounds",
        )
    return bounds.select(*targets.columns, "copies", "threshold")


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    share=SHARE,
    cap=CAP,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Adds ``size, source_size, target, taken`` to every row, replacing columns of these names."""
    added = ["size", "source_size", "target", "taken", "draw", "copies", "threshold"]
    kept = docs.select(*[c for c in docs.columns if c not in added or c in (doc_id, text, source)])
    size = n_words(F.col(text))
    hashed = draw(F.col(doc_id), F.col(text))
    narrow = docs.select(F.col(source).alias("source"), size.alias("size"), hashed.alias("draw"))
    narrow = cut_lineage(narrow, "sizes")
    table = source_thresholds(narrow, source_targets(narrow, weights, share, cap), cap)
    table = table.withColumnRenamed("source", "_source")
    joined = kept.withColumn("size", size).withColumn("draw", hashed)
    joined = joined.join(table, F.col(source).eqNullSafe(F.col("_source")))
    more = F.when(F.col("draw") < F.col("threshold"), 1).otherwise(0)
    times = F.least(F.col("copies") + more, F.lit(cap))
    return joined.select(
        *kept.columns, "size", "source_size", "target", (F.col("size") * times).alias("taken")
    )


def repeat_taken(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: each row as often as it is taken, without the columns that ``mix`` adds."""
    times = F.col("taken") / F.when(F.col("size") > 0, F.col("size"))
    copies = F.array_repeat(F.lit(0), F.coalesce(times, F.lit(0)).cast("int"))
    added = ["size", "source_size", "target", "taken"]
    return mixed.withColumn("_copy", F.explode(copies)).drop(*added, "_copy")
