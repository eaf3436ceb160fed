"""Deterministic samples and weights: hash ranks, never random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import null_safe


def hash_rank(key: Column, salt: str = "") -> Column:
    return F.sha2(F.concat(F.lit(salt), key.cast("string")), 256)


def with_rank(df: DataFrame, key: str, by: list[str], salt: str = "", rank: str = "rank") -> DataFrame:
    """df with each row's place by hash in its group, from 1. Rows are ranked within 4096 ranges
    of the hash and counts of the ranges before are added, so a group with a third of all rows
    is ranked by many tasks."""
    placed = df.withColumn("_r", hash_rank(F.col(key), salt)).withColumn("_b", F.substring("_r", 1, 3))
    counts = placed.groupBy(*by, "_b").agg(F.count("*").alias("_m"))
    below = F.sum("_m").over(W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    total = F.sum("_m").over(W.partitionBy(*by))
    bases = counts.select(*by, "_b", F.coalesce(below, F.lit(0)).alias("_base"), total.alias("_n"))
    inner = F.row_number().over(W.partitionBy(*by, "_b").orderBy("_r", key))
    return null_safe(placed.withColumn("_i", inner), bases, [*by, "_b"]).withColumn(rank, F.col("_base") + F.col("_i")).drop("_b", "_i", "_base")


def first_n(df: DataFrame, key: str, n: int, by: list[str]) -> DataFrame:
    """The n rows of the smallest hash in each group. A window of a row number limit sorts a
    group's ranks in parts first, so a large group is cut before it is gathered."""
    rank = hash_rank(F.col(key))
    return df.withColumn("_r", rank).withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("_r", key))).where(F.col("rank") <= n).drop("_r")


def halves(df: DataFrame, key: str, by: list[str], share: float = 0.5, salt: str = "calibration|") -> DataFrame:
    """df with `part`: in each group the first rows by hash calibrate, the rest set the
    threshold; the cut is the share rounded half to even, at least one and at most all but one.
    A group of one goes to calibration if its hash is even, which needs no order among groups."""
    at = with_rank(df, key, by, salt, "_k")
    cut = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.bround(F.col("_n") * share).cast("long")))
    even = F.conv(F.substring("_r", -1, 1), 16, 10).cast("int") % 2 == 0
    part = F.when(F.col("_n") == 1, F.when(even, "calibration").otherwise("threshold")).when(F.col("_k") <= cut, "calibration").otherwise("threshold")
    return at.withColumn("part", part).drop("_r", "_n", "_k")


def balanced_negatives(df: DataFrame, key: str, mixed_ratio: float, ratio: float) -> DataFrame:
    """All positives; of each mixed source the negatives of the smallest hash, up to its
    positives times `mixed_ratio` (rounded up); then sources without positives in turn, one row
    of each a round, up to `ratio` negatives per positive in all."""
    totals = df.groupBy("source").agg(F.count_if(F.col("label") == 1).alias("pos"))
    turn = null_safe(with_rank(df.where("label = 0"), key, ["source"], rank="_k"), totals, ["source"])
    mixed = turn.where(f"pos > 0 and _k <= ceil(pos * {mixed_ratio})")
    rest = turn.where("pos = 0")
    need = df.where("label = 1").agg((F.ceil(F.count("*") * ratio)).alias("want")).crossJoin(mixed.agg(F.count("*").alias("have"))).selectExpr("greatest(0, want - have) as need")
    # rounds before the last whole one are taken as they are; only the last one needs an order
    rounds = rest.groupBy("_k").agg(F.count("*").alias("m")).withColumn("_range", F.expr("_k div 10000"))
    ranges = rounds.groupBy("_range").agg(F.sum("m").alias("rows"))
    earlier = lambda c, *by: F.coalesce(F.sum(c).over(W.partitionBy(*by).orderBy("_range" if not by else "_k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("_range", earlier("rows").alias("below"))  # a row for 10,000 rounds
    upto = rounds.join(ranges, "_range").select("_k", (F.col("below") + earlier("m", "_range")).alias("before"))
    picked = rest.join(upto, "_k").crossJoin(F.broadcast(need)).where("before < need")
    last = picked.withColumn("_i", F.row_number().over(W.partitionBy("_k").orderBy("source"))).where("before + _i <= need")
    columns = df.columns
    return df.where("label = 1").select(columns).unionByName(mixed.select(columns)).unionByName(last.select(columns))


def positive_weight(df: DataFrame, by: list[str], cap: float) -> DataFrame:
    """weight: negatives per positive of each group that has positives; capped: at most `cap`."""
    counts = df.groupBy(*by).agg(F.count_if(F.col("label") == 0).alias("_n"), F.count_if(F.col("label") == 1).alias("_p")).where("_p > 0")
    weight = F.col("_n").cast("double") / F.col("_p")
    return counts.select(*by, weight.alias("weight"), F.least(F.lit(cap), weight).alias("capped"))


def class_weights(df: DataFrame, label: str, base: Column, cap: float, least: float = 0.5) -> DataFrame:
    """weight = base * sqrt(N / (classes * rows of the class)), the factor held to [least, cap]."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    factor = F.sqrt(F.col("_all") / (F.col("_k") * F.col("_n")))
    table = counts.crossJoin(F.broadcast(totals)).select(label, F.greatest(F.lit(least), F.least(F.lit(cap), factor)).alias("_f"))
    return df.join(F.broadcast(table), label).withColumn("weight", base * F.col("_f")).drop("_f")


def cell_weights(df: DataFrame) -> DataFrame:
    """Each source weighs the same within its label, each label a half, the mean is 1. The
    tables of cells are as small as sources times labels."""
    cells = df.groupBy("source", "label").agg(F.count("*").alias("cell"))
    labels = cells.groupBy("label").agg(F.count("*").alias("sources"))
    totals = cells.agg(F.sum("cell").alias("rows"), F.count_distinct("label").alias("labels"))
    table = cells.join(labels, "label").crossJoin(totals)
    table = table.select("source", "label", (F.col("rows") / (F.col("labels") * F.col("sources") * F.col("cell"))).alias("weight"))
    return null_safe(df, table, ["source", "label"])


def capped_halves(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, half of each label, the smallest hashes."""
    return first_n(df, key, most // 2, ["label"])


def request_grid(spark, scenarios: list[str], choices: list[str], n: int, salt: str = "grid") -> DataFrame:
    """n requests: scenarios in turn, a choice by hash, shuffled by hash."""
    pick = lambda xs, i: F.element_at(F.array(*(F.lit(x) for x in xs)), i)
    at = F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(choices))).cast("int") + 1
    made = spark.range(n).select("id", pick(scenarios, (F.col("id") % len(scenarios)).cast("int") + 1).alias("scenario"), pick(choices, at).alias("choice"))
    return made.withColumn("rank", F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256))


def sortish_batches(df: DataFrame, key: str, length: str, batch: int, batches: int, salt: str = "batch|") -> DataFrame:
    """df with `batch`, `slot` and `batch_rank`: rows shuffled by hash, cut into mega-batches of
    batch * batches rows, sorted by length within one, and cut into batches, which `batch_rank`
    shuffles. So a batch pads little and an epoch's order stays mixed."""
    placed = with_rank(df.withColumn("_all", F.lit(0)), key, ["_all"], salt, "_k")
    mega = F.expr(f"(_k - 1) div {batch * batches}")
    inner = F.row_number().over(W.partitionBy("_mega").orderBy(F.desc(length), "_r", key)) - 1
    made = placed.withColumn("_mega", mega).withColumn("_i", inner)
    made = made.withColumn("batch", F.col("_mega") * batches + F.expr(f"_i div {batch}")).withColumn("slot", F.col("_i") % batch)
    return made.withColumn("batch_rank", F.sha2(F.concat(F.lit("order|"), F.col("batch").cast("string")), 256)).drop("_all", "_r", "_n", "_k", "_mega", "_i")
