"""What the operators share with the rest of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..storage import discard, materialize, new_path, shared_dir, small_batches, tidy

__all__ = ["connected_components", "discard", "materialize", "new_path", "shared_dir", "small_batches", "tidy", "unused", "without_rows"]


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it while df has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_rows(docs: DataFrame, lost: DataFrame, bits: int = 22) -> DataFrame:
    """docs without the rows that `lost` names by doc_id and tie (the XXH64 of the text, null
    counting as empty).

    The ids lost reach the scan as a bitmap of 2**bits bits, at most 2**bits / 64 broadcast
    rows; only rows whose id hits it are shuffled and looked up."""
    word, mask, tie, name = (unused(docs, x) for x in ("word", "mask", "tie", "lost_id"))
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << bits))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(cast(doc_id as long)), {1 << bits}) & 63 as int))")
    bitmap = materialize(lost.select(F.shiftright(slot, 6).alias(word), bit.alias("m")).groupBy(word).agg(F.bit_or("m").alias(mask)), "bitmap")
    marked = docs.withColumn(word, F.shiftright(slot, 6)).join(F.broadcast(bitmap), word, "left")
    hit = F.coalesce(F.col(mask), F.lit(0).cast("long")).bitwiseAND(bit) != 0
    names = lost.select(F.col("doc_id").cast("long").alias(name), F.col("tie").alias(tie))
    same = F.expr(f"cast(doc_id as long) <=> {name} and xxhash64(coalesce(cast(text as string), '')) = {tie}")
    return marked.where(~hit).select(*docs.columns).unionByName(marked.where(hit).select(*docs.columns).join(names, same, "left_anti"))
