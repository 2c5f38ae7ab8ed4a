"""Arithmetic of scores, quotas and set similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements, 0 for two empty arrays."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def item_score(n: Column) -> Column:
    """Up to 30 points: rising to 10 items, full to 200, falling beyond."""
    return (
        F.when(n < 10, 30.0 * n / 10)
        .when(n <= 200, F.lit(30.0))
        .otherwise(30.0 * F.greatest(F.lit(0.0), 1 - (n - 200) / 300.0))
    )


def field_score(title: Column, pdf: Column, abstract: Column) -> Column:
    """Up to 50 points from hit rates."""
    return 30.0 * title + 15.0 * pdf + 5.0 * abstract


def quality_score(duplicates: Column, empty: Column, title_length: Column) -> Column:
    """Up to 20 points, less for duplicate or empty titles and odd title lengths."""
    odd = ((title_length > 0) & (title_length < 5)) | (title_length > 200)
    points = 20.0 - F.least(F.lit(20.0), 20.0 * duplicates) - F.least(F.lit(20.0), 20.0 * empty) - F.when(odd, 5.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(20.0), points))


def total_score(*parts: Column) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


def quotas(n: Column, ratios: tuple[float, float, float] = (0.2, 0.3, 0.3)) -> tuple[Column, Column, Column, Column]:
    """Whole counts of three difficulties, cut off, and the remainder for the fourth."""
    first = [(n * r).cast("int") for r in ratios]
    return (*first, n - first[0] - first[1] - first[2])


def closeness(count: Column, n: Column) -> Column:
    return 1.0 - F.abs(count - n) / F.greatest(n, F.lit(1))
