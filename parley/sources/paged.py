"""A source over a rows service that answers pages (offset, length), read in parallel.

The page function is given, so nothing here reaches a network by itself."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Fetch = Callable[[int, int], list[dict]]


def read_pages(spark: SparkSession, fetch: Fetch, total: int, length: int, schema: str) -> DataFrame:
    """All rows of the service: one task takes some offsets, an empty page ends its part."""
    offsets = spark.range(0, total, length).select(F.col("id").alias("offset"))

    def pull(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in f["offset"]:
                page = fetch(int(at), min(length, total - int(at)))
                if page:
                    yield pd.DataFrame(page)

    return offsets.mapInPandas(pull, schema)


def with_retries(fetch: Fetch, tries: int = 3, wait: Callable[[int], None] = lambda n: None, fatal: tuple[type[BaseException], ...] = ()) -> Fetch:
    """fetch, tried again after a wait that grows; fatal errors end it at once."""

    def again(offset: int, length: int) -> list[dict]:
        for n in range(1, tries + 1):
            try:
                return fetch(offset, length)
            except fatal:
                raise
            except Exception:
                if n == tries:
                    raise
                wait(n)
        return []

    return again


def download(fetch: Callable[[], Iterator[bytes]], path: str, tries: int = 3, wait: Callable[[int], None] = lambda n: time.sleep(2**n), most_bytes: int | None = None) -> int:
    """Write what `fetch` yields to a file, whole or not at all: blocks go to a .part file that
    takes the name at the end. A failed try starts anew after a wait that doubles; a body beyond
    `most_bytes` is an error at once. Returns the bytes written."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    for n in range(1, tries + 1):
        try:
            size = 0
            with part.open("wb") as out:
                for block in fetch():
                    size += len(block)
                    if most_bytes is not None and size > most_bytes:
                        raise ValueError(f"the body exceeds {most_bytes} bytes")
                    out.write(block)
            os.replace(part, target)
            return size
        except OSError:
            part.unlink(missing_ok=True)
            if n == tries:
                raise
            wait(n)
        except ValueError:
            part.unlink(missing_ok=True)
            raise
    return 0
