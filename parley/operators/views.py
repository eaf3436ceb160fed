"""Eligibility and evaluation views over labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signals import RISK_WORDS
from ..functions.text import EDGE


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """The first rule that fails a row, or null."""
    out = None
    for failed, reason in rules:
        failed = F.coalesce(failed, F.lit(True))
        out = F.when(failed, reason) if out is None else out.when(failed, reason)
    return out


def provenance_weight(provenance: Column, weights: dict[str, float]) -> Column:
    """The weight of a provenance, 1 where the table has none."""
    table = F.create_map(*(F.lit(x) for p in weights.items() for x in p)) if weights else F.lit(None).cast("map<string,double>")
    return F.coalesce(F.try_element_at(table, provenance), F.lit(1.0))


def training_rows(df: DataFrame, splits: DataFrame, allowed: list[str], weights: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """(rows, counts by reason). Rows fail for the first of: no split, not eligible, provenance
    not allowed, no binary label, empty text. Weights come from the provenance, 1 by default.

    df: conversation_id, training_eligible, provenance, label, text. The split table is joined
    by AQE's choice, as it grows with the conversations."""
    rules = [
        (F.col("split").isNull(), "missing_split"), (~F.col("training_eligible"), "not_training_eligible"),
        (~F.col("provenance").isin(allowed), "disallowed_provenance"), (~F.col("label").isin(0, 1), "missing_binary_label"),
        (F.trim("text") == "", "empty_text"),
    ]
    marked = df.join(splits, "conversation_id", "left").withColumn("reason", first_reason(rules))
    rows = marked.where("reason is null").drop("reason").withColumn("sample_weight", provenance_weight(F.col("provenance"), weights))
    return rows, marked.groupBy("reason").agg(F.count("*").alias("n"))


def overlaps_risk(text: Column, words: str = RISK_WORDS) -> Column:
    return text.rlike(f"(?iU){EDGE}(?:{words}){EDGE}")


def ascii_overlap(text: Column, words: str) -> Column:
    """As overlaps_risk for ASCII words, without lookaround."""
    return text.rlike(f"(?i)(^|[^A-Za-z0-9_])(?:{words})([^A-Za-z0-9_]|$)")


def with_primary(df: DataFrame, hard: Column) -> DataFrame:
    return df.withColumn("hard_negative", (F.col("label") == 0) & hard).withColumn("is_primary", (F.col("label") == 1) | F.col("hard_negative"))


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))


def mixed_sources(df: DataFrame, floor: int = 1) -> DataFrame:
    return label_counts(df).where(F.least("n0", "n1") >= floor)


def unseen_sources(df: DataFrame) -> DataFrame:
    """Sources of negatives only."""
    return label_counts(df).where("n1 = 0 and n0 > 0").select("source", F.col("n0").alias("n"))


def held_out_folds(df: DataFrame, floor: int = 5) -> DataFrame:
    """For every mixed source: rows and positives to train on and to test on, from the counts."""
    counts = label_counts(df)
    total = counts.agg(F.sum(F.col("n0") + F.col("n1")).alias("rows"), F.sum("n1").alias("pos"))
    out = counts.where(F.least("n0", "n1") >= floor).crossJoin(F.broadcast(total))
    return out.select(
        F.col("source").alias("held_out"), (F.col("rows") - F.col("n0") - F.col("n1")).alias("train_rows"), (F.col("pos") - F.col("n1")).alias("train_pos"),
        (F.col("n0") + F.col("n1")).alias("test_rows"), F.col("n1").alias("test_pos"),
    )


def require_both_labels(df: DataFrame, by: str) -> DataFrame:
    """The groups that lack a label; there should be none before a fit."""
    return df.groupBy(by).agg(F.count_distinct("label").alias("labels")).where("labels < 2")
