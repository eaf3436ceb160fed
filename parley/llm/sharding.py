"""Two-pass external shuffle: scatter into memory-sized buckets, then shuffle each bucket."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, new_path, unused


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation: swap each place, from the last down, with one at or below it."""
    order = np.arange(n)
    picks = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64)
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return order


def external_shuffle(docs: DataFrame, shards: int = 16, bucket_bytes: int = 16 << 20, seed: int = 7) -> str:
    """Write all rows of docs in a seeded random order, dealt to `shards` shards, and return
    the path of the Parquet files (partitioned by shard) in the shared folder.

    Columns written: those of docs (with _in behind the name where it is size, shard or slot in
    any case), then size (UTF-8 bytes of the text plus one; null counts as none), shard and
    slot. The law is `rows`: place p of the global order goes to shard p mod shards as slot p
    div shards, so counts differ by at most one and slots have no gap.

    Pass 1 scatters rows over ceil(bytes / bucket_bytes) buckets by a seeded hash of id and
    text, so copies of a text spread by their ids; only rows that repeat both share a bucket.
    Pass 2 sorts a bucket by its keys (a retried task must not depend on arrival order),
    shuffles it by Fisher-Yates with a generator seeded by the bucket, and writes it. Buckets
    travel as Arrow, so every value stays as it is. Null ids, empty texts and an empty table
    need no special case; one row longer than a bucket makes its bucket larger.
    """
    spark = docs.sparkSession
    for c in docs.columns:
        if c.lower() in ("size", "shard", "slot"):
            docs = docs.withColumnRenamed(c, unused(docs, f"{c}_in"))
    key, bucket, base = (unused(docs, x) for x in ("_key", "_bucket", "_base"))
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    hashed = F.xxhash64("doc_id", text)
    per_key = materialize(docs.select(hashed.alias("k"), size.alias("size")).groupBy("k").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "keys")
    total = per_key.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    of = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.col(k)), F.lit(buckets)).cast("int")
    counts = per_key.select(of("k").alias(bucket), "n").groupBy(bucket).agg(F.sum("n").alias("n")).withColumn("band", F.expr(f"{bucket} div 1000"))
    bands = counts.groupBy("band").agg(F.sum("n").alias("n")).selectExpr("band", "sum(n) over (order by band) - n as below")
    bases = materialize(counts.join(bands, "band").selectExpr(bucket, f"below + sum(n) over (partition by band order by {bucket}) - n as {base}"), "bases")
    out_schema = docs.withColumn("size", F.lit(0).cast("long")).withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long")).schema

    def shuffle(rows: pa.Table) -> pa.Table:
        n = rows.num_rows
        by_key = pc.sort_indices(rows, sort_keys=[(key, "ascending"), ("size", "ascending")]).to_numpy()
        order = by_key[fisher_yates(n, np.random.default_rng([seed, rows.column(bucket)[0].as_py()]))]
        place = rows.column(base)[0].as_py() + np.arange(n, dtype=np.int64)
        out = rows.drop_columns([key, bucket, base]).take(pa.array(order))
        return out.append_column("shard", pa.array((place % shards).astype(np.int32))).append_column("slot", pa.array(place // shards))

    scattered = docs.withColumn("size", size).withColumn(key, hashed).withColumn(bucket, of(key))
    out = new_path(spark, "shards")
    scattered.join(bases, bucket).groupBy(bucket).applyInArrow(shuffle, out_schema).write.partitionBy("shard").parquet(out)
    discard(per_key)
    discard(bases)
    return out


def read_shards(docs: DataFrame, path: str) -> DataFrame:
    return docs.sparkSession.read.parquet(path)
