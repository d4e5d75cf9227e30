"""Similarity of titles and of embeddings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title_similarity(a: Column, b: Column) -> Column:
    """``1 - edits / longer length`` in characters; two empty titles have similarity 0."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.coalesce(F.lit(1.0) - F.levenshtein(a, b) / F.nullif(longer, F.lit(0)), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 when either has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(dot(a, b) / F.nullif(norms, F.lit(0.0)), F.lit(0.0))
