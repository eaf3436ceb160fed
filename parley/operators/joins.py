"""Joins that keep rows whose keys are null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys where a null equals a null; the keys come from the left."""
    others = [c for c in right.columns if c not in keys]
    renamed = right.select(*(F.col(k).alias(f"__{k}") for k in keys), *others)
    return left.join(renamed, F.expr(" and ".join(f"`{k}` <=> `__{k}`" for k in keys)), how).drop(*(f"__{k}" for k in keys))
