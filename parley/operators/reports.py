"""Counts and summaries of corpora, pools and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import f_beta, ratio
from .metrics import average_precision


def build_counters(df: DataFrame) -> DataFrame:
    """Rows, kept rows and kept turns by source and label."""
    kept = F.col("training_eligible")
    return df.groupBy(F.col("source.dataset_id").alias("dataset_id"), F.col("conversation_label.is_scam").alias("label")).agg(
        F.count("*").alias("n"), F.count_if(kept).alias("kept"), F.sum(F.when(kept, F.size("turns")).otherwise(0)).alias("turns")
    )


def group_scalars(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """Groups, groups of several, the largest, and links."""
    g = groups.agg(F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("multi_member"), F.max("n").alias("largest"))
    return g.crossJoin(pairs.agg(F.count("*").alias("edges")))


def pool(df: DataFrame) -> DataFrame:
    """Rows, positives, negatives and the sources of a pool."""
    return df.agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
    )


def split_label_counts(df: DataFrame) -> DataFrame:
    """Rows of each of three splits and two labels, zeros included."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(s, y) for s in ("train", "validation", "test") for y in (0, 1)], "split string, label int")
    return grid.join(df.groupBy("split", "label").agg(F.count("*").alias("n")), ["split", "label"], "left").fillna(0, ["n"])


def generated_summary(df: DataFrame) -> DataFrame:
    """Conversations by type, distinct templates and mean turns."""
    return df.groupBy("scam_type").agg(F.count("*").alias("n"), F.count_distinct("template_sha256").alias("templates"), F.round(F.avg("n_turns"), 2).alias("mean_turns"))


def supported(df: DataFrame, tactic: str, least: int = 20) -> DataFrame:
    """Tactics with enough supervised positives to train on."""
    return df.groupBy(tactic).agg(F.count_if((F.col("label") == 1) & (F.col("mask") > 0)).alias("positives")).where(F.col("positives") >= least)


def supervised_metrics(df: DataFrame, key: str) -> DataFrame:
    """Per tactic, over rows with a full mask: average precision and F1 at one half."""
    rows = df.where("mask = 1")
    hit, pos = F.col("score") >= 0.5, F.col("label") == 1
    c = rows.groupBy(key).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(key, p.alias("precision"), r.alias("recall"), f_beta(p, r, 1).alias("f1")).join(average_precision(rows, [key]), key)


def suite_accuracy(df: DataFrame) -> DataFrame:
    """Cases right, by language and in all."""
    right = (F.col("expected") == F.col("predicted")).cast("double")
    return df.groupingSets([["language"], []], "language").agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"))


def archive_profile(df: DataFrame) -> DataFrame:
    """Dialogues, turns and distinct services by split; df: original_split, services, turns."""
    per = df.select("original_split", F.size("turns").alias("t"), F.explode_outer("services").alias("s"), F.col("dialogue_id"))
    turns = df.groupBy("original_split").agg(F.count("*").alias("dialogues"), F.sum(F.size("turns")).alias("turns"))
    return turns.join(per.groupBy("original_split").agg(F.count_distinct("s").alias("services")), "original_split")


def manifest_agreement(manifest: DataFrame, listed: DataFrame) -> DataFrame:
    """Ids whose split in the manifest and in the lists differ, or that one side lacks."""
    both = manifest.withColumnRenamed("split", "manifest_split").join(listed.withColumnRenamed("split", "listed_split"), "conversation_id", "full_outer")
    return both.where("not (manifest_split <=> listed_split)")


def best_by(df: DataFrame, order: list) -> DataFrame:
    """The best row by a composite key of columns or expressions, larger first."""
    keys = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(F.col(k) if isinstance(k, str) else k for k in order)))
    return df.agg(F.max_by(F.struct(*df.columns), keys).alias("x")).select("x.*")


def by_importance(df: DataFrame, most: int) -> DataFrame:
    """The features of the highest importance, names settling ties."""
    return df.orderBy(F.desc("importance"), "name").limit(most)


def latency_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Runs and the median latency, where a missing latency counts as infinite."""
    latency = F.coalesce(F.col("latency").cast("double"), F.lit(float("inf")))
    return df.groupBy(*by).agg(F.count("*").alias("n"), (F.max(latency) == float("inf")).alias("unbounded"), F.median(latency).alias("median_latency"))
