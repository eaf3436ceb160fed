"""Detection of conversations in batch: format, score, optional fusion, decide, explain."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import entities, signals, text
from ..streaming.handoff import recommendation
from .loaders import request_faults

# fixed values: words that explain nothing
UNTELLING = ["role", "caller", "role caller", "aur", "hai", "ko", "mat", "se", "the", "a", "an", "to", "is", "are", "will"]


@dataclass(frozen=True)
class Policy:
    detector_status: str = "research_only"
    enable_handoff: bool = False
    allow_research_fusion: bool = False
    maximum_turns: int = 100
    maximum_characters: int = 50_000


Score = Callable[[DataFrame], DataFrame]


def detect(df: DataFrame, score: Score, threshold: float, policy: Policy = Policy(), fusion: tuple[Score, float, str] | None = None, raw_entities: bool = False) -> DataFrame:
    """conversation_id, turns(speaker_role, text) -> one response struct's columns per row.

    `score` adds a column score to (conversation_id, text); `fusion` is such a function over the
    30 risk features beside them, its threshold and its promotion status. Refused requests keep
    their row with the reason in `refused` and no decision."""
    rows = df.withColumn("refused", request_faults(F.col("turns"), policy.maximum_turns, policy.maximum_characters))
    joined = F.array_join(F.transform("turns", lambda t: text.format_turn(t["speaker_role"], F.trim(t["text"]))), "\n")
    rows = score(rows.withColumn("text", F.when(F.col("refused").isNull(), joined).otherwise("")))
    rows = rows.withColumn("found", entities.extract(F.col("text"))).withColumn("base_score", F.col("score"))
    used, limit, source = F.lit(False), F.lit(threshold), F.lit("base_detector")
    if fusion is not None:
        fuse, fused_threshold, status = fusion
        rows = rows.withColumns({f"_{k}": v for k, v in signals.lexical_hits(F.col("text")).items()})
        hits = {k: F.col(f"_{k}") for k in signals.LEXICAL_TACTICS}
        featured = rows.withColumns(signals.risk_features(F.col("text"), F.col("base_score"), F.col("found"), hits))
        rows = fuse(featured.drop("score")).withColumnRenamed("score", "fusion_score")
        if status == "eligible" or policy.allow_research_fusion:
            used, limit, source = F.lit(True), F.lit(fused_threshold), F.lit("risk_fusion")
        rows = rows.withColumn("score", F.when(used, F.col("fusion_score")).otherwise(F.col("base_score")))
    else:
        rows = rows.withColumn("fusion_score", F.lit(None).cast("double"))
    fine = F.col("refused").isNull()
    decision = F.col("score") >= limit
    eligible = F.lit(policy.detector_status == "eligible")
    hits = signals.lexical_hits(F.col("text"))
    advice = recommendation(decision, eligible, policy.enable_handoff)
    return rows.select(
        "conversation_id", "refused", F.when(fine, decision).alias("is_scam"), F.when(fine, F.col("score")).alias("scam_score"), limit.alias("threshold"),
        source.alias("decision_source"), F.lit(policy.detector_status).alias("detector_status"), eligible.alias("production_eligible"),
        F.struct(F.col("base_score").alias("score"), F.lit(threshold).alias("threshold")).alias("base_detector"),
        F.struct(F.col("fusion_score").alias("score"), used.alias("used")).alias("risk_fusion"),
        F.struct(F.struct(*(v.cast("int").alias(k) for k, v in hits.items())).alias("hits"), signals.stage_progress(hits).alias("stage_progress")).alias("auxiliary"),
        (F.col("found") if raw_entities else entities.public_view(F.col("found"))).alias("entities"), F.when(fine, advice).alias("handoff"),
    )


def top_patterns(contributions: DataFrame, key: str, most: int = 8) -> DataFrame:
    """key, pattern, contribution -> the patterns that speak most for a row, as an array."""
    told = contributions.where((F.col("contribution") > 0) & ~F.col("pattern").isin(UNTELLING) & (F.trim("pattern") != ""))
    best = told.groupBy(key, "pattern").agg(F.max("contribution").alias("contribution"))
    ranked = best.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("contribution"), "pattern"))).where(F.col("_r") <= most)
    rows = F.array_sort(F.collect_list(F.struct("_r", "pattern")))
    return ranked.groupBy(key).agg(F.transform(rows, lambda r: r["pattern"]).alias("patterns"))


def promoted(fpr: Column, recall: Column, base_recall: Column, gold: Column, cap: float) -> Column:
    """Struct of the checks and the status they give."""
    checks = {"fpr_within_cap": fpr <= cap, "recall_not_worse": recall >= base_recall, "gold_available": gold}
    every = F.lit(True)
    for c in checks.values():
        every = every & F.coalesce(c, F.lit(False))
    return F.struct(*(F.coalesce(v, F.lit(False)).alias(k) for k, v in checks.items()), F.when(every, "eligible").otherwise("research_only").alias("status"))
