"""Links and connected components as Spark joins.

Nodes are values of any type that can be ordered. Nothing about single nodes reaches the driver; it
only sees counts that say when to stop. Every round writes its edges to the shared scratch folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.materialize import cut_lineage

Verify = Callable[[DataFrame], DataFrame]


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``edges(a, b)``; the component is its least node.

    Large-star and small-star steps by turns, until the edges are stars around least nodes. No edges
    give no rows; loops and repeated edges do no harm.
    """
    edges = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = cut_lineage(edges.distinct(), "edges", drop_shuffles=True)
    while not _are_stars(edges):
        edges = cut_lineage(_small_star(_large_star(edges)), "edges", drop_shuffles=True)
    least = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(least)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge only and is no smaller end: nothing is left to move."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    counts = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counts.filter("up > 1 OR (up = 1 AND down = 1)").count() == 0


def _large_star(edges: DataFrame) -> DataFrame:
    """Ties every larger neighbour of a node to the least of its neighbours and itself."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    larger = both.filter("b > a").join(least, "a")
    return larger.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Ties a node and its smaller neighbours to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    smaller = edges.join(least, "a").filter("b <> least")
    moved = smaller.select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()


def shared_buckets(members: DataFrame) -> DataFrame:
    """The ``members(bucket, node)`` of buckets that hold two nodes or more.

    With a ``label``, the component that a node is known to belong to, those of buckets that hold two
    labels or more: buckets within one component have nothing left to find.
    """
    by = "label" if "label" in members.columns else "node"
    span = members.groupBy("bucket").agg(F.min(by).alias("lo"), F.max(by).alias("hi"))
    # Such buckets grow with the corpus, so they are never broadcast.
    several = span.filter("lo <> hi").select("bucket").hint("merge")
    return cut_lineage(members.join(several, "bucket", "left_semi"), "buckets", drop_shuffles=True)


def bucket_degrees(shared: DataFrame) -> DataFrame:
    """``(node, degree)``: how many members the buckets of each node hold together."""
    sizes = shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    return shared.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("degree"))


def pivot_links(
    shared: DataFrame, verify: Verify, rounds: int, stars: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Links found by holding each bucket against one pivot a round, and what that leaves open.

    A bucket of mutual near copies is tied together by as many checks as it has members. The first
    pivot is the node whose buckets hold most members, as the original of varied copies does; later ones
    are drawn. Nodes already in the pivot's component are not checked again, and
    buckets that lie in one component are done. Returned are edges ``(a, b)`` that tie each node linked
    so far to the least of its component and the rows ``(bucket, node, label)`` of buckets that spanned
    components before the last round: they need an exact check of the pairs across labels, and no others. ``stars``
    are the edges that an earlier call returned, which go with the labels of ``shared``. Where ``shared`` has a
    column ``degree``, that is what first pivots are chosen by, and no bucket row is joined for it.

    ``verify`` takes candidates ``(bucket, a, b)`` and returns those that link.
    """
    if "degree" not in shared.columns:
        shared = shared.join(bucket_degrees(shared), "node")
    open_ = shared.select(
        "bucket", "node", F.col("node" if stars is None else "label").alias("label"), "degree"
    )
    for turn in range(rounds):
        draw = F.xxhash64("node", "bucket", F.lit(turn))
        order = F.struct(-F.col("degree"), "node") if turn == 0 else draw
        pivots = open_.groupBy("bucket").agg(
            F.min_by(F.struct("node", "label"), order).alias("pivot"),
            F.min("label").alias("lo"),
            F.max("label").alias("hi"),
        )
        pivots = pivots.filter("lo <> hi").select("bucket", "pivot")
        held = cut_lineage(open_.join(pivots, "bucket"), "pivots", drop_shuffles=True)
        candidates = held.filter("label <> pivot.label").select(
            "bucket", F.col("pivot.node").alias("a"), F.col("node").alias("b")
        )
        found = verify(candidates).select("a", "b")
        # The stars so far say all that the earlier links do, in fewer rows.
        labels = connected_components(stars.union(found) if stars else found)
        stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        open_ = (
            held.select("bucket", "node")
            .join(labels, "node", "left")
            .select("bucket", "node", F.coalesce("component", "node").alias("label"))
        )
    return stars, open_


def unsettled(open_: DataFrame) -> DataFrame:
    """The rows ``(bucket, node, label)`` of buckets that span labels, written."""
    span = open_.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    several = span.filter("lo <> hi").select("bucket")
    return cut_lineage(open_.join(several, "bucket", "left_semi"), "unsettled", drop_shuffles=True)


def across_labels(open_: DataFrame, block: int) -> DataFrame:
    """Pairs ``(bucket, a, b)`` of nodes of one bucket with different labels, each in one row.

    Labels meet first, so that members of one component never meet each other, and a bucket of one label
    has no pairs; ``open_`` is read three times, so it should be written. The pairs of two large
    components are dealt out in blocks of at most about ``block`` members a side.
    """
    groups = open_.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    left = groups.select("bucket", F.col("label").alias("la"), F.col("n").alias("na"))
    right = groups.select("bucket", F.col("label").alias("lb"), F.col("n").alias("nb"))
    parts = F.explode(F.sequence(F.lit(0), F.floor(F.col("nb") / block).cast("int")))
    meet = left.join(right, "bucket").filter("la < lb").withColumn("part", parts)
    size = F.floor(F.col("nb") / block).cast("int") + 1
    a = open_.select("bucket", F.col("label").alias("la"), F.col("node").alias("a"))
    b = open_.select("bucket", F.col("label").alias("lb"), F.col("node").alias("b"))
    return (
        b.join(meet, ["bucket", "lb"])
        .filter(F.pmod(F.xxhash64("b"), size) == F.col("part"))
        .join(a, ["bucket", "la"])
        .select("bucket", "a", "b")
    )
