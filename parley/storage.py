"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# shuffle files of a written table are of no more use once it is there
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from spark.checkpoint.dir. Where that setting is absent a local session
    (tests on one machine) gets a folder of its own; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="parley-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold for a block of code."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bound the bytes of an Arrow batch for the whole session, for results that are still to be
    computed when an operator returns; a smaller bound stays."""
    if bytes_of(spark.conf.get(BATCH_BYTES)) > most:
        spark.conf.set(BATCH_BYTES, str(most))


def bytes_of(text: str) -> int:
    number = text.lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(number[-1:], 0)
    return int(number.rstrip("kmg")) << unit


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives
    the loss of executors. The shuffle files that made it go as soon as it is written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with settings(spark, {CLEAN: "true", BATCH_BYTES: str(min(4 << 20, bytes_of(spark.conf.get(BATCH_BYTES))))}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._parley_path = path
    made = _made.get()
    if made is not None:
        made.append(out)
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table made by materialize()."""
    path = getattr(df, "_parley_path", None)
    if path:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is written to the shared folder, after which the tables it
    wrote on the way are deleted."""

    @functools.wraps(f)
    def run(*args, **params) -> DataFrame:
        outer = _made.get()
        token = _made.set([])
        try:
            out = materialize(f(*args, **params), f.__name__)
            for table in _made.get():
                if table is not out:
                    discard(table)
        finally:
            _made.reset(token)
        if outer is not None:
            outer.append(out)
        return out

    return run
