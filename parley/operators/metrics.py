"""Metrics of scored rows (label 0/1, score in [0, 1]). All are aggregates; ranks come from
counts per distinct score, summed in buckets, so no task sorts all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import f_beta, ratio, wilson
from .joins import null_safe

BUCKETS = 4096


def by_score(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Positives and negatives per distinct score (and group)."""
    keys = keys or []
    return df.groupBy(*keys, "score").agg(F.sum(F.col("label").cast("long")).alias("p"), F.sum((1 - F.col("label")).cast("long")).alias("n"))


def cumulative(counts: DataFrame, keys: list[str] | None = None, descending: bool = True) -> DataFrame:
    """counts with tp and fp: positives and negatives at this score or beyond it (above it if
    descending, below if not). Two levels: within a bucket of scores, and over the buckets."""
    keys = keys or []
    way = F.desc if descending else F.asc
    bucket = F.floor(F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)) * BUCKETS).cast("int")
    placed = counts.withColumn("_b", bucket)
    inner = W.partitionBy(*keys, "_b").orderBy(way("score")).rowsBetween(W.unboundedPreceding, 0)
    outer = W.partitionBy(*keys).orderBy(way("_b")).rowsBetween(W.unboundedPreceding, -1)
    base = placed.groupBy(*keys, "_b").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    base = base.select(*keys, "_b", F.coalesce(F.sum("_p").over(outer), F.lit(0)).alias("_p"), F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_n"))
    sums = placed.select("*", F.sum("p").over(inner).alias("tp"), F.sum("n").over(inner).alias("fp"))
    return null_safe(sums, base, [*keys, "_b"]).withColumn("tp", F.col("tp") + F.col("_p")).withColumn("fp", F.col("fp") + F.col("_n")).drop("_b", "_p", "_n")


def confusion(threshold: Column | float) -> list[Column]:
    hit = F.col("score") >= threshold
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0)).cast("long")
    pos = F.col("label") == 1
    return [count(pos & hit).alias("tp"), count(~pos & hit).alias("fp"), count(pos & ~hit).alias("fn"), count(~pos & ~hit).alias("tn")]


def rates() -> dict[str, Column]:
    """Metrics out of tp, fp, fn, tn. Ratios without a base are 0; balanced accuracy and MCC are
    null where only one class is there."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    f1, f1_neg = f_beta(precision, recall, 1), f_beta(ratio(tn, tn + fn), specificity, 1)
    both = (tp + fn > 0) & (tn + fp > 0)
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn), "balanced_accuracy": F.when(both, (recall + specificity) / 2), "precision": precision,
        "recall": recall, "specificity": specificity, "fpr": ratio(fp, fp + tn), "f1": f1, "macro_f1": (f1 + f1_neg) / 2,
        "f2": f_beta(precision, recall, 2), "mcc": F.when(both, ratio(tp * tn - fp * fn, spread)),
    }


def brier() -> Column:
    return F.avg((F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))).alias("brier")


def binary_metrics(df: DataFrame, threshold: float, keys: list[str] | None = None) -> DataFrame:
    out = df.groupBy(*(keys or [])).agg(F.count("*").alias("n"), *confusion(threshold), brier())
    return out.withColumns(rates())


def roc_auc(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mann-Whitney with ties counted half; null where only one class is there."""
    keys = keys or []
    c = cumulative(by_score(df, keys), keys, descending=False)
    below = F.col("fp") - F.col("n") + F.col("n") / 2
    out = c.groupBy(*keys).agg(F.sum(F.col("p") * below).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return out.select(*keys, (F.col("u") / F.nullif((F.col("p") * F.col("n")).cast("double"), F.lit(0.0))).alias("roc_auc"))


def average_precision(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sum of recall steps times precision over distinct scores; null without positives."""
    keys = keys or []
    c = cumulative(by_score(df, keys), keys)
    out = c.groupBy(*keys).agg(F.sum(F.col("p") * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("s"), F.sum("p").alias("p"))
    return out.select(*keys, (F.col("s") / F.nullif(F.col("p").cast("double"), F.lit(0.0))).alias("pr_auc"))


def grouped_metrics(df: DataFrame, threshold: float) -> DataFrame:
    """Confusion and rates by source, by language (a row with several counts in each), overall,
    and recall with the mean score by type (positives only)."""
    made = [F.count("*").alias("n"), *confusion(threshold), F.avg("score").alias("mean_score")]
    branch = lambda kind, key, rows: rows.groupBy(key.cast("string").alias("value")).agg(*made).withColumn("kind", F.lit(kind))
    one = branch("source", F.col("source"), df).unionByName(branch("language", F.col("language"), df.withColumn("language", F.explode("languages"))))
    one = one.unionByName(branch("all", F.lit("all"), df)).unionByName(branch("type", F.col("kind_of"), df.where("label = 1")))
    return one.withColumns(rates()).select("kind", "value", "n", "tp", "fp", "fn", "tn", "mean_score", "precision", "recall", "fpr", "f1")


def seed_summary(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"))


def fold_summary(df: DataFrame, least_negatives: int) -> DataFrame:
    """Over folds and seeds: mean and population spread of recall and FPR, the pooled FPR with
    its interval, and whether the negatives suffice."""
    out = df.groupBy("source").agg(
        F.avg("recall").alias("recall_mean"), F.stddev_pop("recall").alias("recall_sd"), F.avg("fpr").alias("fpr_mean"),
        F.stddev_pop("fpr").alias("fpr_sd"), F.sum("fp").alias("fp"), F.sum(F.col("fp") + F.col("tn")).alias("negatives"),
    )
    low, high = wilson(F.col("fp"), F.col("negatives"))
    return out.withColumns({"fpr_low": low, "fpr_high": high, "sufficient": F.col("negatives") >= least_negatives})


def source_macro(per_source: DataFrame) -> DataFrame:
    """By seed: means over sources and the worst source's FPR; then over seeds."""
    seeds = per_source.groupBy("seed").agg(F.avg("recall").alias("recall"), F.avg("fpr").alias("fpr"), F.max("fpr").alias("worst_fpr"))
    return seeds.agg(
        F.avg("recall").alias("recall_mean"), F.coalesce(F.stddev_samp("recall"), F.lit(0.0)).alias("recall_sd"),
        F.avg("fpr").alias("fpr_mean"), F.max("worst_fpr").alias("worst_fpr"),
    )


def score_quantiles(df: DataFrame, keys: list[str]) -> DataFrame:
    """Exact quantiles with linear interpolation; Spark sums equal scores before it sorts."""
    q = F.percentile("score", F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75))))
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("score").alias("low"), q.alias("q"), F.max("score").alias("high"))
    return out.select(*keys, "n", "low", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "high")


def multiclass_report(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Precision, recall and F1 of every class of the manifest, absent ones 0; df has truth and
    predicted. The confusion is aggregated first."""
    cells = df.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    real = cells.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    said = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("said"))
    out = classes.join(real, "class", "left").join(said, "class", "left").fillna(0, ["support", "tp", "said"])
    precision, recall = ratio(F.col("tp"), F.col("said")), ratio(F.col("tp"), F.col("support"))
    return out.select("class", "support", precision.alias("precision"), recall.alias("recall"), f_beta(precision, recall, 1).alias("f1"))


def multiclass_summary(report: DataFrame) -> DataFrame:
    f1, support = F.col("f1"), F.col("support")
    return report.agg(F.avg(f1).alias("macro_f1"), (F.sum(f1 * support) / F.nullif(F.sum(support).cast("double"), F.lit(0.0))).alias("weighted_f1"))


def edit_rates(df: DataFrame, reference: str, hypothesis: str) -> dict[str, Column]:
    """wer and cer. Words are numbered by first place in reference and hypothesis together and
    compared as one code point each; both empty is 0, an empty reference otherwise 1."""
    ref, hyp = F.split(F.trim(F.col(reference)), r"\s+"), F.split(F.trim(F.col(hypothesis)), r"\s+")
    words = F.array_distinct(F.concat(ref, hyp))
    spell = lambda xs: F.array_join(F.transform(xs, lambda w: F.decode(F.unhex(F.lpad(F.hex((F.array_position(words, w) + 0x10000).cast("long")), 8, "0")), "UTF-32")), "")
    empty_r, empty_h = F.trim(F.col(reference)) == "", F.trim(F.col(hypothesis)) == ""
    rate = lambda d, n: F.when(empty_r & empty_h, F.lit(0.0)).when(empty_r, F.lit(1.0)).otherwise(d / n)
    return {
        "wer": rate(F.levenshtein(spell(ref), spell(hyp)), F.size(ref)),
        "cer": rate(F.levenshtein(F.col(reference), F.col(hypothesis)), F.length(F.col(reference))),
    }


def transcript_summary(df: DataFrame) -> DataFrame:
    """Per backend: mean error rates, run times, shifts of the score and flips of the decision."""
    shift = F.col("score") - F.col("reference_score")
    flip = (F.col("score") >= F.col("threshold")) != (F.col("reference_score") >= F.col("threshold"))
    return df.groupBy("backend").agg(
        F.avg("wer").alias("wer"), F.avg("cer").alias("cer"), F.median("runtime").alias("runtime_median"), F.sum("runtime").alias("runtime_total"),
        F.avg(F.abs(shift)).alias("shift_abs"), F.avg(shift).alias("shift"), F.avg(flip.cast("int")).alias("flip_rate"),
    )
