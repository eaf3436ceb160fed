"""Validated loads: a manifest's rows, or a table of what is wrong with them.

Each loader marks every row with its first fault; `checked` turns faults into a failure that
names one, so nothing is dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.hashing import unit
from ..schema import SPLITS
from .views import first_reason


def blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def repeated(c: str) -> Column:
    """All rows of an id but one."""
    return F.row_number().over(W.partitionBy(c).orderBy(F.lit(0))) > 1


def with_faults(df: DataFrame, ident: str, rules: list[tuple[Column, str]]) -> DataFrame:
    marked = df.withColumn("_again", repeated(ident))
    return marked.withColumn("fault", first_reason([(blank(ident), f"{ident}_missing"), (F.col("_again"), f"duplicate_{ident}"), *rules])).drop("_again")


def checked(marked: DataFrame, need_rows: bool = True) -> DataFrame:
    """The rows, if none has a fault; else an error that tells the most frequent one."""
    worst = marked.where("fault is not null").groupBy("fault").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "fault").first()
    if worst:
        raise ValueError(f"{worst['n']} rows: {worst['fault']}")
    if need_rows and marked.isEmpty():
        raise ValueError("the manifest is empty")
    return marked.drop("fault")


def project_examples(df: DataFrame) -> DataFrame:
    """Columns id, text, label, split, language, weight -> training rows with a caller tag."""
    rules = [(blank("text"), "text_missing"), (~F.col("label").isin(0, 1), "bad_label"), (~F.col("split").isin(*SPLITS), "bad_split")]
    rows = checked(with_faults(df, "id", rules))
    tagged = F.concat(F.lit("[ROLE=caller] "), text.collapse(F.col("text")))
    return rows.select(
        F.concat(F.lit("project::"), "id").alias("conversation_id"), tagged.alias("text"), F.col("label").cast("int").alias("label"),
        F.when(F.col("label") == 1, "project_authored").otherwise("non_scam").alias("scam_type"), "split", F.lit("project_examples").alias("source"),
        F.array(F.coalesce("language", F.lit("unknown"))).alias("languages"), F.lit("project_authored_silver").alias("provenance"),
        F.array(tagged).alias("turn_texts"), F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("sample_weight"),
    )


EXTERNAL_FIELDS = ["conversation_id", "language", "source_group", "rights_basis"]


def external_records(df: DataFrame) -> DataFrame:
    """Rows of an external evaluation set: redacted, labelled, with full provenance."""
    rules = [
        (F.col("split") != "external_evaluation", "bad_split"), (blank("text"), "text_missing"), (~F.col("label").isin(0, 1), "bad_label"),
        (~F.col("pii_redacted"), "not_redacted"), *((blank(c), f"{c}_missing") for c in EXTERNAL_FIELDS),
    ]
    return checked(with_faults(df, "record_id", rules))


def external_as_examples(df: DataFrame, split: Column) -> DataFrame:
    tagged = text.format_turn(F.lit("caller"), F.col("text"))
    return df.select(
        F.concat(F.lit("external::"), "record_id").alias("conversation_id"), tagged.alias("text"), "label",
        F.when(F.col("label") == 1, "external").otherwise("non_scam").alias("scam_type"), split.alias("split"), F.col("source_group").alias("source"),
        F.array("language").alias("languages"), F.lit("external_human").alias("provenance"), F.array(tagged).alias("turn_texts"), F.lit(1.0).alias("sample_weight"),
    )


def partition_external(df: DataFrame, train: float = 0.70, validation: float = 0.15, salt: str = "content-v1") -> DataFrame:
    """A split for whole sources: all records of a URL (or of a conversation without one) go
    together, by the URL's hash."""
    if not (0 < train < 1 and 0 < validation < 1 and train + validation < 1):
        raise ValueError("train and validation must leave a test share")
    group = F.when(~blank("source_url"), F.trim("source_url")).otherwise(F.col("conversation_id"))
    at = unit(group, salt)
    return df.withColumn("split", F.when(at < train, "train").when(at < train + validation, "validation").otherwise("test"))


def audio_records(df: DataFrame) -> DataFrame:
    """Rows of an audio validation set; paths are relative and stay inside their root."""
    parts = F.split("audio_path", r"[/\\]")
    depth = F.aggregate(parts, F.array(F.lit(0), F.lit(0)), lambda a, p: F.array(
        a[0] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1), F.least(a[1], a[0] + F.when(p == "..", -1).otherwise(0))))
    rules = [
        (F.col("split") != "audio_validation", "bad_split"), (~F.col("label").isin(0, 1), "bad_label"), (blank("audio_path"), "audio_path_missing"),
        (F.col("audio_path").rlike(r"^([/\\]|[A-Za-z]:)"), "absolute_path"), (depth[1] < 0, "path_escapes"), (~F.col("pii_redacted"), "not_redacted"),
        *((blank(c), f"{c}_missing") for c in ["reference_text", *EXTERNAL_FIELDS]),
    ]
    rows = checked(with_faults(df, "record_id", rules))
    if rows.select("label").distinct().count() < 2:
        raise ValueError("both labels are needed")
    return rows


def audio_file_faults(files: DataFrame, extensions: list[str], most_bytes: int) -> DataFrame:
    """path, length of binaryFile rows -> the fault of each file, or null."""
    kind = F.lower(F.element_at(F.split("path", r"\."), -1))
    return files.select("path", "length", F.when(~kind.isin(extensions), "bad_extension").when(F.col("length") == 0, "empty_file").when(F.col("length") > most_bytes, "too_large").alias("fault"))


def train_only(df: DataFrame, allowed: list[str], weights: dict[str, float]) -> DataFrame:
    """Canonical rows that may only train: any other provenance or policy is an error."""
    provenance = F.col("conversation_label.provenance")
    rules = [(~provenance.isin(allowed), "disallowed_provenance"), (~F.array_contains("allowed_splits", "train") | (F.size("allowed_splits") != 1), "not_train_only")]
    rows = checked(with_faults(df, "conversation_id", rules), need_rows=False)
    table = F.create_map(*(F.lit(x) for p in weights.items() for x in p)) if weights else F.lit(None).cast("map<string,double>")
    return rows.withColumn("split", F.lit("train")).withColumn("sample_weight", F.coalesce(F.try_element_at(table, provenance), F.lit(1.0)))


def request_faults(turns: Column, most_turns: int = 100, most_chars: int = 50_000) -> Column:
    """Why a detection request is refused, or null."""
    body = F.format_string("%s", F.array_join(F.transform(turns, lambda t: text.format_turn(t["speaker_role"], t["text"])), "\n"))
    return (
        F.when(F.size(turns) < 1, "no_turns").when(F.size(turns) > most_turns, "too_many_turns")
        .when(F.exists(turns, lambda t: F.coalesce(F.trim(t["text"]), F.lit("")) == ""), "empty_turn").when(F.length(body) > most_chars, "too_long")
    )


def downloadable(registry: DataFrame, optional: list[str]) -> DataFrame:
    """Data sets that may be fetched: automatic ones, and optional ones asked for."""
    return registry.where((F.col("status") == "automatic") | (F.col("status").startswith("optional_") & F.col("id").isin(optional)))


def distinct_first(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of equal keys."""
    best = df.withColumn("_k", key).groupBy("_k").agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r"))
    return best.select("r.*")


def distinct_transcripts(df: DataFrame, order: list[str]) -> DataFrame:
    return distinct_first(df, F.sha2(text.casefold(text.collapse(F.col("text"))), 256), order)


def transcript(turns: Column) -> Column:
    """Lines role: text, casefolded, blank turns left out."""
    line = lambda t: F.concat(text.role_tag(t["speaker_role"]), F.lit(": "), F.lower(text.collapse(t["text"])))
    return F.array_join(F.transform(F.filter(turns, lambda t: F.coalesce(text.collapse(t["text"]), F.lit("")) != ""), line), "\n")


def within_cap(df: DataFrame, by: list[str], order: str, size: str, cap: int) -> DataFrame:
    """Chunks of an upload in order, as long as their sizes so far (`upto`) fit the cap."""
    upto = F.sum(size).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return df.withColumn("upto", upto).where(F.col("upto") <= cap)
