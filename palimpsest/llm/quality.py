"""Quality rules by robust multivariate outliers.

Texts become vectors of transformed statistics: log of the mean word length, and the square roots in
arc sine of four shares, which are symbols, ASCII capitals, repeated lines and words in repeated
three-word windows. For each language and source the minimum-covariance-determinant estimate is found:
the mean and covariance of the ``SHARE`` of rows that lie closest together. Rows far from it in
Mahalanobis distance are rejected.

An estimate is a table row. A concentration step computes all distances, sums rows, vectors and products
by group and distance bin, and takes the closest bins, the last one in part, as the next estimate: one
aggregation over narrow rows, whatever the size of a group. There are two starts (medians with median
deviations, means with covariance), of which the smaller determinant wins, and a reweighting step.

Groups of fewer than ``MIN_ROWS`` rows are judged by the estimate of all rows of their language, and
languages as small by that of all rows, however few these are. To every variance is added that of a
floor, which is what one count more (a character, a symbol, a capital, a line, a repeated word) changes
in a typical text, so that statistics that never vary in a group are no ground to reject a single count.
A row is rejected if a normal one lies as far out with a chance of ``REJECT``.

Null languages and sources are groups like others. Null and empty texts and all that fail the base rules
are not part of estimates, and are not kept. Texts of any length are read whole. Equal rows get equal
results, and an empty table gives an empty one. Columns may have any names; those named like an added one
(``COUNTS``, ``base_failed``, ``kept``, ``distance``) are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.text import WORD
from palimpsest.materialize import cut_lineage

SHARE = 0.75
MIN_ROWS = 100
STEPS = 8
SETTLED = 1e-4
# Chance that a row of a normal group is rejected.
REJECT = 1e-3
REWEIGHT = 0.025
# Bins for each doubling of the squared distance.
BINS = 16
MIN_WORDS = 50
# Added below the shares of repeated lines and words, which say little about short texts.
FEW_LINES, FEW_WORDS = 5, 100
DIMENSIONS = 5
WORDS = re.compile(WORD)
SEPARATORS = " \t\n\v\f\r"
# The symbols that are counted.
SYMBOLS = "#*$%&|<>"
CAPITALS = bytes(range(65, 91))

# Tables of so many rows of group names or estimates (some 12 MB) are broadcast, larger ones are not.
BROADCAST_ROWS = 40_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_statistics(text: str) -> tuple[list[int], list[float], list[float]]:
    """The counts of ``COUNTS``, the transformed vector, and what one count makes in each part of it."""
    words = WORDS.findall(text)
    chars = len(text) - sum(text.count(c) for c in SEPARATORS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip(SEPARATORS)]
    repeated_lines = len(lines) - len(set(lines))
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        counts, last = Counter(windows), -1
        for i, window in enumerate(windows):
            if counts[window] > 1:
                repeated += i + 2 - max(i - 1, last)
                last = i + 2
    raw = text.encode("utf-8", "replace")
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    sizes = [max(len(text), 1), max(len(text), 1), len(lines) + FEW_LINES, len(words) + FEW_WORDS]
    shares = [n / size for n, size in zip((symbols, capitals, repeated_lines, repeated), sizes)]
    vector = [math.log(max(chars, 1) / max(len(words), 1))]
    vector += [math.asin(math.sqrt(min(s, 1.0))) for s in shares]
    unit = [math.log1p(1 / max(chars, 1)), *(math.asin(math.sqrt(1 / size)) for size in sizes)]
    return [len(words), chars, symbols, repeated_lines, repeated], vector, unit


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The other columns, the counts, ``base_failed``, ``vector`` and ``unit``, in place of the text."""
    added = [*COUNTS, "base_failed", "vector", "unit"]
    kept = docs.select(*[c for c in docs.columns if c not in (text, *added)], text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_statistics(t.as_py() or "") for t in batch.column(text)]
            columns = [pa.array([f[0][i] for f in found], pa.int64()) for i in range(len(COUNTS))]
            columns += [pa.array([f[i] for f in found], pa.list_(pa.float64())) for i in (1, 2)]
            rest = batch.drop_columns([text])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, *columns], [*rest.schema.names, *COUNTS, "vector", "unit"]
            )

    schema = kept.drop(text).schema
    for name in COUNTS:
        schema = schema.add(name, "long")
    for name in ("vector", "unit"):
        schema = schema.add(name, T.ArrayType(T.DoubleType()))
    found = kept.mapInArrow(run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    )
    return found.withColumn("base_failed", failed)


def chi_square(x: float, freedom: int) -> float:
    """The distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = freedom / 2, x / 2
    term = total = 1 / a
    k = 0
    while term > total * 1e-15:
        k += 1
        term *= half / (a + k)
        total += term
    return min(1.0, total * math.exp(a * math.log(half) - half - math.lgamma(a)))


def chi_square_quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < p else (low, middle)
    return (low + high) / 2


def consistency(share: float) -> float:
    """What makes the covariance of the closest ``share`` of normal rows that of all."""
    return share / chi_square(chi_square_quantile(share, DIMENSIONS), DIMENSIONS + 2)


def _component(i: int) -> Column:
    return F.get("vector", F.lit(i))


def _distance() -> Column:
    """Squared Mahalanobis distance of ``vector`` from ``mean`` under ``inverse``."""
    gaps = [_component(i) - F.get("mean", F.lit(i)) for i in range(DIMENSIONS)]
    total = F.lit(0.0)
    for i, a in enumerate(gaps):
        for j, b in enumerate(gaps):
            total += a * b * F.get("inverse", F.lit(i * DIMENSIONS + j))
    return total


ESTIMATE = "grp long, start int, mean array<double>, inverse array<double>, spread double"
SUMS = [f"s{i}" for i in range(DIMENSIONS)]
PRODUCTS = [f"p{i}{j}" for i in range(DIMENSIONS) for j in range(i + 1)]


def _sums() -> list[Column]:
    products = [
        F.sum(_component(i) * _component(j)).alias(f"p{i}{j}")
        for i in range(DIMENSIONS)
        for j in range(i + 1)
    ]
    return [
        F.count(F.lit(1)).alias("n"),
        *(F.sum(_component(i)).alias(f"s{i}") for i in range(DIMENSIONS)),
        *products,
    ]


def _estimate(group: pd.DataFrame, share: float, factor: float, floor: list[float]) -> pd.DataFrame:
    """Mean and inverse covariance of the closest ``share``, from sums by bin."""
    group = group.sort_values("bin")
    n = group["n"].to_numpy(float)
    before = np.cumsum(n) - n
    part = np.clip((math.ceil(share * n.sum()) - before) / n, 0, 1)
    count = (part * n).sum()
    mean = (part @ group[SUMS].to_numpy()) / count
    covariance = np.zeros((DIMENSIONS, DIMENSIONS))
    covariance[np.tril_indices(DIMENSIONS)] = (part @ group[PRODUCTS].to_numpy()) / count
    covariance += np.tril(covariance, -1).T
    covariance -= np.outer(mean, mean)
    covariance = covariance * factor + np.diag(np.square(floor))
    return pd.DataFrame(
        {
            "grp": group["grp"].iloc[:1],
            "start": group["start"].iloc[:1],
            "mean": [mean],
            "inverse": [np.linalg.inv(covariance).ravel()],
            "spread": [np.linalg.slogdet(covariance)[1]],
        }
    )


def _bounded(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _from_bins(binned: DataFrame, share: float, factor: float, floor: list[float]) -> DataFrame:
    sums = binned.groupBy("grp", "start", "bin").agg(*_sums())
    estimates = sums.groupBy("grp", "start").applyInPandas(
        lambda group: _estimate(group, share, factor, floor), ESTIMATE
    )
    return cut_lineage(estimates, "estimates")


def _starts(rows: DataFrame, floor: list[float]) -> DataFrame:
    parts = range(DIMENSIONS)
    middle = rows.groupBy("grp").agg(
        F.array(*[F.percentile_approx(_component(i), 0.5) for i in parts]).alias("mean")
    )
    gaps = [F.abs(_component(i) - F.get("mean", F.lit(i))) for i in parts]
    spread = rows.join(_bounded(cut_lineage(middle, "medians")), "grp").groupBy("grp").agg(
        F.first("mean").alias("mean"),
        *[F.percentile_approx(gaps[i], 0.5).alias(f"d{i}") for i in parts],
    )
    # Deviations of a normal row are 1.4826 times the median one.
    width = [F.pow(1.4826 * F.col(f"d{i}"), 2) + floor[i] ** 2 for i in parts]
    inverse = F.array(*[1 / width[i] if i == j else F.lit(0.0) for i in parts for j in parts])
    robust = spread.select("grp", F.lit(0).alias("start"), "mean", inverse.alias("inverse"))
    all_ = rows.select("grp", "vector", F.lit(1).alias("start"), F.lit(0).alias("bin"))
    return robust.unionByName(_from_bins(all_, 1.0, 1.0, floor).drop("spread"))


def covariance_estimates(rows: DataFrame, floor: list[float]) -> DataFrame:
    """``(grp, mean, inverse)`` from rows with ``grp`` and ``vector``, which should be a table."""
    estimates = cut_lineage(_starts(rows, floor), "estimates")
    bin_ = F.floor(F.log2(F.greatest(_distance(), F.lit(1e-9))) * BINS)
    before = None
    for _ in range(STEPS):
        given = rows.join(_bounded(estimates), "grp")
        binned = given.select("grp", "start", "vector", bin_.alias("bin"))
        estimates = _from_bins(binned, SHARE, consistency(SHARE), floor)
        after = estimates.agg(F.sum("spread"), F.count(F.lit(1))).first()
        if before and abs(after[0] - before[0]) <= SETTLED * after[1]:
            break
        before = after if after[1] else None
        if before is None:
            break
    best = estimates.groupBy("grp").agg(
        F.min_by(F.struct("start", "mean", "inverse"), F.struct("spread", "start")).alias("best")
    )
    best = _bounded(cut_lineage(best.select("grp", "best.*"), "estimates"))
    near = rows.join(best, "grp").filter(_distance() <= chi_square_quantile(1 - REWEIGHT, DIMENSIONS))
    near = near.select("grp", "start", "vector", F.lit(0).alias("bin"))
    return _from_bins(near, 1.0, consistency(1 - REWEIGHT), floor).select("grp", "mean", "inverse")


def group_names(rows: DataFrame) -> DataFrame:
    """``(lang, source, grp, member)``: what judges a language and source, and the estimates it is in."""
    counts = rows.groupBy("lang", "source").agg(F.count_if(~F.col("base_failed")).alias("n"))
    counts = cut_lineage(counts, "groups").withColumn("small", F.col("n") < MIN_ROWS)
    by_lang = counts.groupBy(F.col("lang").alias("of")).agg(
        F.sum("n").alias("of_lang"), F.max("small").alias("asked")
    )
    # The estimate over all rows is needed if a small group is in a small language.
    last = by_lang.agg(F.max(F.col("asked") & (F.col("of_lang") < MIN_ROWS))).first()[0]
    own = F.xxhash64(F.lit(0), "lang", F.lit("/"), "source")
    lang, corpus = F.xxhash64(F.lit(1), "lang"), F.lit(0).cast("long")
    grp = F.when(~F.col("small"), own).when(F.col("of_lang") >= MIN_ROWS, lang).otherwise(corpus)
    member = F.array(
        F.when(~F.col("small"), own),
        F.when(F.col("asked") & (F.col("of_lang") >= MIN_ROWS), lang),
        F.when(F.lit(bool(last)), corpus),
    )
    joined = counts.join(_bounded(cut_lineage(by_lang, "groups")), F.col("lang").eqNullSafe(F.col("of")))
    return joined.select("lang", "source", grp.alias("grp"), F.array_compact(member).alias("member"))


def quality(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text"
) -> DataFrame:
    """The rows without their text, with the counts, ``base_failed``, ``distance`` and ``kept``.

    ``distance`` is the squared Mahalanobis distance, null only where no row passes the base rules.
    """
    added = [*COUNTS, "base_failed", "distance", "kept"]
    stay = [c for c in docs.columns if c not in (text, *added)]
    given = docs.select(
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(stay)],
        F.col(lang).alias("lang"),
        F.col(source).alias("source"),
        F.col(text).alias("text"),
    )
    found = cut_lineage(with_statistics(given), "statistics")
    names = cut_lineage(group_names(found), "groups")
    judged = found.filter(~F.col("base_failed"))
    typical = [F.percentile_approx(F.get("unit", F.lit(i)), 0.5) for i in range(DIMENSIONS)]
    floor = [value or 1.0 for value in judged.agg(*typical).first()]

    def named(rows: DataFrame, table: DataFrame) -> DataFrame:
        same = rows["lang"].eqNullSafe(table["lang"]) & rows["source"].eqNullSafe(table["source"])
        return rows.join(_bounded(table), same).drop(table["lang"], table["source"])

    rows = named(judged, names).select(F.explode("member").alias("grp"), "vector")
    estimates = covariance_estimates(cut_lineage(rows, "vectors"), floor)
    judges = names.drop("member").join(_bounded(estimates), "grp", "left").drop("grp")
    far = F.col("distance") > chi_square_quantile(1 - REJECT, DIMENSIONS)
    kept = ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))
    result = named(found, cut_lineage(judges, "judges")).withColumn("distance", _distance())
    return result.withColumn("kept", kept).select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(stay)], *added
    )
