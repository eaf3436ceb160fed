"""Operating points. Candidates come from counts per distinct score; >= throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import f_beta, ratio
from .joins import null_safe
from .metrics import by_score, cumulative


def _points(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every distinct score as a threshold, and 0 and 1, with its counts and rates."""
    counts = by_score(df, keys)
    ends = counts.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    ends = ends.withColumn("score", F.explode(F.array(F.lit(0.0), F.lit(1.0)))).withColumns({"p": F.lit(0).cast("long"), "n": F.lit(0).cast("long")})
    merged = counts.unionByName(ends).groupBy(*keys, "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    c = cumulative(merged, keys)
    c = null_safe(c, totals, keys) if keys else c.crossJoin(F.broadcast(totals))
    tp, fp = F.col("tp"), F.col("fp")
    return c.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, F.col("all_p")), "fpr": ratio(fp, F.col("all_n"))})


def at_fpr(df: DataFrame, most: float, keys: list[str] | None = None) -> DataFrame:
    """The threshold of highest recall with an FPR of at most `most`; ties go to precision, then
    the lower FPR, then the lower threshold."""
    keys = keys or []
    order = F.struct("recall", "precision", (-F.col("fpr")).alias("a"), (-F.col("score")).alias("b"))
    best = F.max_by(F.struct("score", "tp", "fp", "precision", "recall", "fpr"), order)
    out = _points(df, keys).where(F.col("fpr") <= most).groupBy(*keys).agg(best.alias("x"))
    return out.select(*keys, F.col("x.score").alias("threshold"), "x.tp", "x.fp", "x.precision", "x.recall", "x.fpr")


def _on_grid(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Counts at each threshold of a small grid: rows fall between grid points once, and the
    grid's running sums do the rest."""
    points = grid.select("threshold").distinct()
    marks = sorted(r["threshold"] for r in points.collect())
    place = F.lit(0)
    scores = by_score(df)
    array = F.array(*(F.lit(x) for x in marks))
    place = F.size(F.filter(array, lambda x: x <= F.col("score")))
    tops = scores.withColumn("k", place).groupBy("k").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    ladder = df.sparkSession.createDataFrame([(i + 1, x) for i, x in enumerate(marks)], "i int, threshold double")
    at = ladder.join(tops, F.col("k") >= F.col("i"), "left").groupBy("threshold").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("fp"))
    totals = tops.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    out = at.crossJoin(F.broadcast(totals))
    return out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("all_p"))})


def by_f_beta(df: DataFrame, beta: float, least_precision: float, points: int = 197) -> DataFrame:
    """The grid threshold (0.01 to 0.99) of the highest F-beta among those of enough precision,
    or among all if there are none; ties go to recall, precision, the lower threshold."""
    step = 0.98 / (points - 1)
    grid = df.sparkSession.range(points).select(F.round(F.lit(0.01) + F.col("id") * step, 6).alias("threshold"))
    at = _on_grid(df, grid).withColumn("f", f_beta(F.col("precision"), F.col("recall"), beta)).withColumn("satisfied", F.col("precision") >= least_precision)
    order = F.struct("satisfied", F.round("f", 12).alias("f"), "recall", "precision", (-F.col("threshold")).alias("t"))
    return at.agg(F.max_by(F.struct("threshold", "tp", "fp", "precision", "recall", "f", "satisfied"), order).alias("x")).select("x.*")


def by_f1(df: DataFrame, quantiles: int = 201) -> DataFrame:
    """The threshold of the highest F1 among 0, 0.5, 1 and the scores' quantiles; ties go to
    precision, recall, the higher threshold."""
    q = F.array(*(F.lit(i / (quantiles - 1)) for i in range(quantiles)))
    grid = df.agg(F.concat(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)), F.percentile("score", q)).alias("t")).select(F.explode("t").alias("threshold"))
    at = _on_grid(df, grid).withColumn("f1", f_beta(F.col("precision"), F.col("recall"), 1))
    order = F.struct(F.round("f1", 12).alias("f"), "precision", "recall", "threshold")
    return at.agg(F.max_by(F.struct("threshold", "tp", "fp", "precision", "recall", "f1"), order).alias("x")).select("x.*")


def shared_bound(df: DataFrame, most: float, least_negatives: int, keys: list[str]) -> DataFrame:
    """The bound that a score must exceed so that no group of enough negatives passes its FPR:
    per group the (floor(most * n) + 1)-th largest negative score, then the largest of those.
    Scores strictly above the bound are positive."""
    neg = df.where("label = 0")
    totals = neg.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least_negatives)
    c = cumulative(by_score(neg, keys), keys).select(*keys, "score", F.col("fp").alias("above"))
    allowed = F.floor(F.lit(most) * F.col("n") + F.lit(1e-12)) + 1
    per_group = null_safe(c, totals, keys).where(F.col("above") >= allowed).groupBy(*keys).agg(F.max("score").alias("bound"))
    return per_group.agg(F.max("bound").alias("bound"), F.count("*").alias("groups"))
