"""Ordered work on groups of any size.

A window over ``article`` alone puts a huge article into one task. Here rows are range-partitioned by
(group, order) instead, so a group spreads over as many slices as its size needs, and every window
runs per (group, slice). What a slice must know of the slices before it is one row per continued
group. Ranges are contiguous, so only the first and the last group of a slice can go on beyond it:
the tables about them have at most two rows per slice. How they are joined is left to Spark, as they
grow with the number of slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.materialize import cut_lineage

SLICE = "_slice"


def slice_by_order(
    df: DataFrame, by: list[str], order: list[str], slices: int | None = None
) -> DataFrame:
    """Add ``_slice``. Range bounds come from sampling, so the result is written before use.

    How many slices there are is left to Spark if not told.
    """
    count = [] if slices is None else [slices]
    ranged = df.repartitionByRange(*count, *by, *order).withColumn(SLICE, F.spark_partition_id())
    return cut_lineage(ranged, "slices")


def slice_window(by: list[str], order: list[str]):
    return Window.partitionBy(*by, SLICE).orderBy(*order)


def at_edges(sliced: DataFrame, by: list[str]) -> DataFrame:
    """The rows of the first and the last group of every slice. Groups must not be null."""
    group = F.struct(*by)
    groups = sliced.select(*by, SLICE).distinct()
    ends = groups.groupBy(SLICE).agg(F.array(F.min(group), F.max(group)).alias("_ends"))
    edges = ends.select(SLICE, F.inline("_ends"))
    return sliced.join(edges, [*by, SLICE], "left_semi")


def carried(per_slice: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """Values taken over the earlier slices of a group, for the slices that have any.

    ``per_slice`` holds one row per (group, slice) at the edges; ``values`` are aggregates such as
    ``F.sum("n")`` or ``F.last("tail")``, evaluated over all earlier slices in order.
    """
    earlier = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    rows = per_slice.withColumn("_earlier", F.count(F.lit(1)).over(earlier))
    for name, value in values.items():
        rows = rows.withColumn(name, value.over(earlier))
    return rows.filter("_earlier > 0").select(*by, SLICE, *values)


def number_rows(
    df: DataFrame, by: list[str], order: list[str], name: str = "seq", slices: int | None = None
) -> DataFrame:
    """Number the rows of each group from 0.

    ``order`` must be total within a group. ``df`` is read twice, so it should be a narrow table.
    """
    sliced = slice_by_order(df, by, order, slices)
    sizes = at_edges(sliced, by).groupBy(*by, SLICE).agg(F.count(F.lit(1)).alias("_size"))
    before = carried(sizes, by, _before=F.sum("_size"))
    local = F.row_number().over(slice_window(by, order)) - 1
    numbered = sliced.withColumn("_local", local).join(before, [*by, SLICE], "left")
    seq = F.col("_local") + F.coalesce("_before", F.lit(0))
    return numbered.withColumn(name, seq.cast("long")).drop("_local", "_before", SLICE)
