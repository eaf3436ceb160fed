"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)))


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % Wilson interval, within [0, 1]; null where n is 0."""
    m = F.nullif(n.cast("double"), F.lit(0.0))
    p = hits.cast("double") / m
    z2 = Z95 * Z95
    centre = (p + z2 / (2 * m)) / (1 + z2 / m)
    half = Z95 * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m)) / (1 + z2 / m)
    return F.when(m.isNotNull(), F.greatest(F.lit(0.0), centre - half)), F.when(m.isNotNull(), F.least(F.lit(1.0), centre + half))


def logit(p: Column, clip: float = 1e-6) -> Column:
    q = F.least(F.lit(1 - clip), F.greatest(F.lit(clip), p))
    return F.log(q / (1 - q))


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    b2 = beta * beta
    return ratio((1 + b2) * precision * recall, b2 * precision + recall)
