"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, tidy, unused, without_rows


def survivors(keys: DataFrame, bits: int) -> DataFrame:
    """A bitmap of the keys as rows (word, mask): at most 2**bits / 64 rows, whatever the input."""
    slot = F.pmod(F.xxhash64("n_bytes", "prefix_hash"), F.lit(1 << bits))
    return (
        keys.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(n_bytes, prefix_hash), {1 << bits}) & 63 as int))").alias("mask"))
        .groupBy("word")
        .agg(F.bit_or("mask").alias("mask"))
    )


@tidy
def exact_dedup(docs: DataFrame, prefix: int = 64, filter_bits: int = 20, digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, full_hash, keep_id, group_size, kept, copies, tie
    (XXH64 of the text, for rows that pass 2 reads).

    Texts are equal when identical; null counts as empty. Of equal texts the row with the
    largest doc_id is kept (null ids count as smallest). Rows that repeat a kept doc_id with
    the same text are all marked kept and `copies` tells how many there are.

    Pass 1 reads lengths and a hash of the first `prefix` characters, and keeps the
    (length, prefix) keys that several rows share, after dropping lengths held by one row.
    Pass 2 hashes the full text only of rows whose key survived; the surviving keys reach the
    scan as a bitmap of 2**filter_bits bits, so what is broadcast never exceeds
    2**filter_bits / 64 rows (16,384 by default); a false hit costs a hash, never a wrong
    answer. With digest_all every row gets its full hash, as a caller that reports digests
    needs. Texts are never shuffled. Groups are aggregated before the shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(
        F.col("doc_id"),
        text.alias("text"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(F.substring(text, 1, prefix)).alias("prefix_hash"),
    )
    by_length = keyed.groupBy("n_bytes", "prefix_hash").agg(F.count("*").alias("n"))
    lengths = by_length.groupBy("n_bytes").agg(F.sum("n").alias("rows"), F.max("n").alias("most")).where("rows > 1 and most > 1")
    shared = by_length.where("n > 1").join(lengths.select("n_bytes"), "n_bytes", "left_semi")
    bitmap = materialize(survivors(shared, filter_bits), "bitmap")

    slot = F.pmod(F.xxhash64("n_bytes", "prefix_hash"), F.lit(1 << filter_bits))
    bit = F.expr(f"shiftright(mask, cast(pmod(xxhash64(n_bytes, prefix_hash), {1 << filter_bits}) & 63 as int)) & 1L = 1L")
    hashed = keyed.withColumn("word", F.shiftright(slot, 6)).join(F.broadcast(bitmap), "word", "left")
    survives = F.coalesce(bit, F.lit(False))
    full = F.sha2(F.col("text"), 256)
    rows = materialize(
        hashed.select("doc_id", "n_bytes", "prefix_hash", F.when(survives, F.xxhash64("text")).alias("tie"), survives.alias("survives"), (full if digest_all else F.when(survives, full)).alias("full_hash")),
        "hashed",
    )
    groups = (
        rows.where("survives")
        .groupBy("n_bytes", "prefix_hash", "full_hash")
        .agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
        .where("group_size > 1")
    )
    own = rows.where("survives").groupBy("full_hash", "doc_id").agg(F.count("*").alias("copies")).where("copies > 1")
    # a stored table, so that the join shuffles both sides anew and a hot group can be split
    groups = materialize(groups, "groups")
    joined = rows.where("survives").join(groups, ["n_bytes", "prefix_hash", "full_hash"], "left")
    repeated = joined.join(
        own.withColumnsRenamed({"full_hash": "_h", "doc_id": "_d"}), F.expr("full_hash = _h and doc_id <=> _d"), "left"
    )
    alone: dict[str, Column] = {"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "copies": F.lit(1).cast("long")}
    out = ["doc_id", "n_bytes", "full_hash", "keep_id", "group_size", "copies", "tie"]
    multi = repeated.select(
        "doc_id", "n_bytes", "full_hash",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), "tie",
    )
    return (
        rows.where("not survives").withColumns(alone).select(*out).unionByName(multi).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    )


def drop_exact_copies(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs that stay, with all their columns; exactly one row per distinct text.

    Null and empty texts are one text; texts of any length are compared by their full hash; of
    rows that repeat both text and kept doc_id (null too) one stays; an empty table gives an
    empty result. Full hashes are computed for rows whose refined key several rows share; docs is
    filtered by the ids that go, and only rows with such an id are shuffled."""
    decided = exact_dedup(docs, **params)
    lost = materialize(decided.where("not kept").select("doc_id", "tie").distinct(), "lost")
    stay = without_rows(docs, lost)
    again = materialize(decided.where("kept and copies > 1").select("doc_id", "tie").distinct(), "again")
    if again.isEmpty():
        return stay
    tie = unused(docs, "tie")
    repeated = docs.withColumn(tie, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    names = again.select(F.col("doc_id").alias(unused(docs, "_id")), F.col("tie").alias(unused(docs, "_tie")))
    match = F.expr(f"doc_id <=> {names.columns[0]} and {tie} = {names.columns[1]}")
    once = repeated.join(names, match, "left_semi").dropDuplicates(["doc_id", tie]).select(*docs.columns)
    return without_rows(stay, again).unionByName(once)
