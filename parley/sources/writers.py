"""Writers: fan-out, split lists, upserts, write-once tables."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ingest import flat_turns


def fan_out(df: DataFrame, out: str) -> None:
    """All conversations once; the kept ones and their turns are read back from what was
    written, so the plan above runs once."""
    df.write.mode("errorifexists").parquet(f"{out}/all")
    kept = df.sparkSession.read.parquet(f"{out}/all").where("training_eligible")
    kept.write.mode("errorifexists").parquet(f"{out}/kept")
    flat_turns(kept).write.mode("errorifexists").parquet(f"{out}/turns")


def split_lists(splits: DataFrame, out: str) -> None:
    """Sorted text files of ids, one folder for each split."""
    splits.select("split", F.col("conversation_id").alias("value")).repartition("split").sortWithinPartitions("split", "value").write.partitionBy("split").text(out)


def latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key, the new ones winning."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    return both.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("_age"))).where("_n = 1").drop("_n", "_age")


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of new whose key old lacks, once per key."""
    return new.dropDuplicates([key]).join(old.select(key), key, "left_anti")


def write_json(path: str, payload: dict) -> None:
    """A small report, whole or not at all."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    temp = target.with_suffix(target.suffix + ".part")
    temp.write_text(json.dumps(payload, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")
    os.replace(temp, target)
