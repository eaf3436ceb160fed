"""Operators along a conversation's turns: prefixes, stable and early detection, windows.

Every operator needs one exchange on the conversation's id; a conversation's turns are the
largest group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def conversation_texts(turns: DataFrame, line: Column) -> DataFrame:
    """(conv_id, n_turns, text): lines in turn order."""
    rows = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


def prefixes(turns: DataFrame, line: Column) -> DataFrame:
    """(conv_id, turn, role, size, prefix): the lines up to each turn."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return turns.select("conv_id", "turn", "role", F.count("*").over(w).alias("size"), F.array_join(F.collect_list(line).over(w), "\n").alias("prefix"))


def stable_turn(scored: DataFrame, entry: float, exit_: float) -> DataFrame:
    """Per conversation the first prefix that scores at least `entry` with all later ones at
    least `exit_`, or null; and how many of the caller's turns that prefix holds (the prefix's
    size if none). scored: conv_id, size, role, score."""
    later = W.partitionBy("conv_id").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("conv_id").orderBy("size").rowsBetween(W.unboundedPreceding, 0)
    calls = F.count_if(F.lower("role").isin("caller", "scammer", "fraudster", "user")).over(before)
    marked = scored.select("conv_id", "size", calls.alias("calls"), ((F.col("score") >= entry) & (F.min("score").over(later) >= exit_)).alias("stable"))
    first = F.min(F.when(F.col("stable"), F.struct("size", "calls")))
    out = marked.groupBy("conv_id").agg(F.count("*").alias("n_turns"), first.alias("x"))
    calls_at = F.when(F.col("x.calls") > 0, F.col("x.calls")).otherwise(F.col("x.size"))
    return out.select("conv_id", "n_turns", F.col("x.size").alias("stable_turn"), calls_at.alias("caller_turn"))


def detection_summary(found: DataFrame, turn: str = "stable_turn") -> DataFrame:
    t = F.col(turn)
    return found.agg(
        F.count("*").alias("n"), F.count(t).alias("detected"), F.avg(t.isNull().cast("double")).alias("undetected_rate"),
        F.median(t).alias("median_turn"), F.min(t).alias("min_turn"), F.max(t).alias("max_turn"),
    )


FRACTIONS = (0.1, 0.25, 0.5, 0.75, 1.0)


def early_detection(scored: DataFrame, threshold: float, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """At each fraction of a conversation (rounded up, at least one turn): the share that has
    fired by then, and the share whose score is high just then."""
    w = W.partitionBy("conv_id")
    hit = F.col("score") >= threshold
    rows = scored.select("conv_id", "size", hit.alias("hit"), F.count("*").over(w).alias("n"), F.min(F.when(hit, F.col("size"))).over(w).alias("first"))
    at = rows.withColumn("fraction", F.explode(F.array(*(F.lit(f) for f in fractions))))
    at = at.where(F.col("size") == F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("fraction"))))
    fired = F.coalesce(F.col("first") <= F.col("size"), F.lit(False))
    return at.groupBy("fraction").agg(F.count("*").alias("n"), F.avg(fired.cast("double")).alias("latched_rate"), F.avg(F.col("hit").cast("double")).alias("point_rate"))


def first_detection(scored: DataFrame, threshold: float) -> DataFrame:
    """Per conversation the first prefix that fires and the fraction of the turns it takes."""
    out = scored.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.min(F.when(F.col("score") >= threshold, F.col("size"))).alias("first_turn"))
    return out.withColumn("first_fraction", F.col("first_turn") / F.col("n_turns"))


def prefix_windows(turns: DataFrame, line: Column, fractions: tuple[float, ...] = (0.25, 0.5, 1.0), most: int | None = None) -> DataFrame:
    """(conv_id, size, text): prefixes at fractions of the turns, equal sizes once, the first
    `most` of them."""
    rows = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    held = turns.groupBy("conv_id").agg(F.transform(rows, lambda r: r["line"]).alias("lines"))
    sizes = F.array_distinct(F.transform(F.array(*(F.lit(f) for f in fractions)), lambda f: F.greatest(F.lit(1), F.ceil(F.size("lines") * f)).cast("int")))
    sizes = F.slice(sizes, 1, most) if most else sizes
    return held.select("conv_id", "lines", F.explode(sizes).alias("size")).select("conv_id", "size", F.array_join(F.slice("lines", 1, F.col("size")), "\n").alias("text"))


def prefix_labels(turns: DataFrame, tactics: list[str], stages: list[str]) -> DataFrame:
    """Labels that a prefix may know: per tactic the greatest value so far (null while unknown),
    and the most advanced stage so far. turns: conv_id, turn, one column per tactic, stage."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    rank = F.array_position(F.array(*(F.lit(s) for s in stages)), F.col("stage"))
    far = F.max(F.when(rank > 0, rank)).over(w)
    return turns.select(
        "conv_id", "turn", F.count("*").over(w).alias("size"), *(F.max(t).over(w).alias(t) for t in tactics),
        F.try_element_at(F.array(*(F.lit(s) for s in stages)), far.cast("int")).alias("stage"),
    )


def supervision(value: Column, is_positive: Column, weak_weight: float) -> tuple[Column, Column]:
    """Label and mask of a tactic: negatives are sure zeros, known values are sure, a zero from
    rules counts `weak_weight`, the unknown not at all."""
    label = F.when(is_positive == 0, 0.0).otherwise(F.coalesce(value, F.lit(0)).cast("double"))
    mask = F.when(is_positive == 0, 1.0).when(value.isNull(), 0.0).when(value == 1, 1.0).otherwise(weak_weight)
    return label, mask


def gaps(turns: DataFrame) -> DataFrame:
    """Turns whose number does not follow the one before (the first must be 0)."""
    w = W.partitionBy("conv_id").orderBy("turn")
    return turns.select("conv_id", "turn", (F.row_number().over(w) - 1).alias("place")).where("turn <> place")
