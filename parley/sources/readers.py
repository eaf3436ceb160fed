"""Readers and writers of the raw formats."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import SPLITS


def read_csv(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """A header CSV, all strings, with `row`: the rows' number within their file. A file with
    line breaks in its fields is read by one task, so its rows' ids follow each other and the
    number is the distance from the file's least id, which needs no sort."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding=encoding)
    first = df.columns[0]
    if first.startswith("\ufeff"):
        df = df.withColumnRenamed(first, first[1:])
    placed = df.select("*", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_at"))
    starts = placed.groupBy("_file").agg(F.min("_at").alias("_start"))
    return placed.join(starts, "_file").withColumn("row", F.col("_at") - F.col("_start")).drop("_file", "_at", "_start")


def read_csv_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """As read_csv; each file that is not UTF-8 is read as Latin-1, whatever the others are. The
    driver sees the files' names, as it does to list them."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    valid = raw.select("path", F.try_validate_utf8(F.col("content").cast("string")).isNotNull().alias("utf8"))
    by_encoding: dict[str, list[str]] = {}
    for r in valid.orderBy("path").collect():
        by_encoding.setdefault("UTF-8" if r["utf8"] else "ISO-8859-1", []).append(r["path"])
    out = None
    for encoding, paths in by_encoding.items():
        rows = read_csv(spark, paths, encoding)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a schema; a malformed line fails the read, blank ones are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_errors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The malformed lines of a file, instead of a failure. Lines are parsed one by one, so that
    the corrupt column can be asked for alone."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select(parsed.alias("x")).select("x.*").where("_corrupt_record is not null")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of data sets, one row each."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("datasets").alias("d")).select("d.*")


def read_split_map(spark: SparkSession, path: str) -> DataFrame:
    """(conversation_id, split) of a split manifest; names outside the three splits are an error."""
    df = spark.read.schema("conversation_to_split map<string,string>").option("multiLine", True).json(path)
    rows = df.select(F.explode("conversation_to_split").alias("conversation_id", "split"))
    bad = F.raise_error(F.concat(F.lit("unknown split "), F.col("split"))).cast("string")
    return rows.withColumn("split", F.when(F.col("split").isin(*SPLITS), F.col("split")).otherwise(bad))


def archives_at(spark: SparkSession, path: str) -> DataFrame:
    """path, content of archive files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def zip_members(archives: DataFrame, like: str) -> DataFrame:
    """(archive, member, content) of the members of ZIP archives (path, content) whose path
    matches; an archive is opened where its bytes are."""

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for f in frames:
            for archive, content in zip(f["path"], f["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if re.search(like, name) and not name.endswith("/"):
                            yield pd.DataFrame({"archive": [archive], "member": [name], "content": [z.read(name)]})

    return archives.select("path", "content").mapInPandas(members, "archive string, member string, content binary")


def read_zip_lines(archives: DataFrame, like: str = r"dialogues_[^/]*$") -> DataFrame:
    """Lines of the one matching member of each archive; another number of them is an error."""
    m = zip_members(archives, like).withColumn("n", F.count("*").over(W.partitionBy("archive")))
    one = F.when(F.col("n") == 1, F.decode("content", "UTF-8")).otherwise(F.raise_error(F.lit("an archive needs one member of that name")).cast("string"))
    lines = m.select("archive", F.posexplode(F.split(one, "\r?\n")).alias("row", "value"))
    return lines.where(F.trim("value") != "")


def read_zip_dialogues(archives: DataFrame, like: str = r"/dialogues_[^/]*\.json$") -> DataFrame:
    """Dialogues of the JSON arrays in an archive, with the split that their folder names."""
    schema = "array<struct<dialogue_id:string,services:array<string>,turns:array<struct<speaker:string,utterance:string>>>>"
    m = zip_members(archives, like).where(~F.col("member").rlike(r"/sgd_x/"))
    rows = m.select("member", F.explode(F.from_json(F.decode("content", "UTF-8"), schema)).alias("d"))
    return rows.select("d.*", F.element_at(F.split("member", "/"), -2).alias("original_split"))


def read_zip_csv(archives: DataFrame, like: str = r"\.csv$") -> DataFrame:
    """Rows of the CSV members of archives as maps from header to value, numbered."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for member, content in zip(f["member"], f["content"]):
                t = pd.read_csv(io.BytesIO(content), dtype=str, keep_default_na=False, encoding="utf-8-sig")
                yield pd.DataFrame({"member": member, "row": range(len(t)), "fields": t.to_dict("records")})

    return zip_members(archives, like).mapInPandas(rows, "member string, row long, fields map<string,string>")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_json(path: str) -> dict:
    """A small JSON file on the driver, with or without a byte-order mark."""
    return json.loads(Path(path).read_text(encoding="utf-8-sig"))
