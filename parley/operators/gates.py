"""Gates and integrity checks, as tables of what is wrong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def errors(checks: list[tuple[Column, str]]) -> Column:
    """Codes of the checks that fail; an unknown outcome fails."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for ok, code in checks)))


def intake_errors(channels: list[str], least_turns: int) -> Column:
    spoken = F.filter("turns", lambda t: F.trim(t["text"]) != "")
    return errors([
        (F.col("consent_confirmed"), "consent_missing"), (F.col("pii_redacted"), "not_redacted"), (~F.col("llm_generated"), "machine_generated"),
        (F.col("collection_channel").isin(channels), "unknown_channel"), (F.size("language_profile") > 0, "no_language"),
        (F.size(spoken) >= least_turns, "too_few_turns"),
    ])


def annotation_errors(tactics: list[str]) -> Column:
    known = F.array(*(F.lit(t) for t in tactics))
    shown = F.transform("evidence_spans", lambda s: s["tactic"])
    return errors([
        (F.trim("annotator_id") != "", "no_annotator"), (F.col("is_scam").isin(0, 1), "bad_label"), (~F.col("llm_used"), "machine_label"),
        (F.size(F.array_except("tactics", known)) == 0, "unknown_tactic"), (F.size(F.array_except("tactics", shown)) == 0, "tactic_without_evidence"),
    ])


def consensus(annotations: DataFrame, adjudications: DataFrame, key: str, annotator: str, signature: list[str], least: int = 2) -> DataFrame:
    """Per item: annotators, distinct answers, and whether it is agreed, adjudicated, in need of
    annotators, or in need of adjudication."""
    per = annotations.groupBy(key).agg(F.count_distinct(annotator).alias("annotators"), F.count_distinct(F.to_json(F.struct(*signature))).alias("answers"))
    judged = adjudications.select(key, F.lit(True).alias("judged")).distinct()
    status = F.when(F.col("annotators") < least, "needs_annotators").when(F.col("answers") == 1, "agreed").when(F.col("judged"), "adjudicated").otherwise("needs_adjudication")
    return per.join(judged, key, "left").select(key, "annotators", "answers", status.alias("status"))


def quota_gaps(df: DataFrame, quotas: DataFrame, key: str) -> DataFrame:
    """Quotas (key, wanted) that the rows do not meet."""
    have = df.groupBy(key).agg(F.count("*").alias("have"))
    out = quotas.join(have, key, "left").fillna(0, ["have"])
    return out.where("have < wanted").withColumn("missing", F.col("wanted") - F.col("have"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key).distinct(), key, "left_anti")


def leaks(df: DataFrame, known: DataFrame, key: Column, known_key: Column) -> DataFrame:
    """Rows whose key the known table has too."""
    return df.withColumn("_k", key).join(known.select(known_key.alias("_k")).distinct(), "_k", "left_semi").drop("_k")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has and the other has not, with the side."""
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))


def json_checks(df: DataFrame) -> DataFrame:
    """payload, path ($.a.b), expected -> status and detail."""
    actual = F.expr("get_json_object(payload, path)")
    status = F.when(actual.isNull() | (actual != F.col("expected")), "failed").otherwise("passed")
    detail = F.when(actual.isNull(), F.lit("missing JSON path")).when(actual != F.col("expected"), F.concat(F.lit("got "), actual))
    return df.withColumns({"actual": actual, "status": status, "detail": detail})


def digest_checks(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files against expected digests: passed, failed, or skipped where there is no file."""
    out = expected.join(files.select("path", F.col("sha256").alias("actual")), "path", "left")
    status = F.when(F.col("actual").isNull(), "skipped").when(F.col("actual") == F.col("expected"), "passed").otherwise("failed")
    return out.withColumn("status", status)


def roll_up(checks: DataFrame) -> DataFrame:
    return checks.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("passed", "failed", "skipped")))


def all_pass(checks: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in checks.values()))


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: rows with a value and distinct values, in one pass."""
    made = df.agg(*(F.count(c).alias(f"{c}__n") for c in df.columns), *(F.count_distinct(c).alias(f"{c}__d") for c in df.columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__n").alias("n"), F.col(f"{c}__d").alias("n_distinct")) for c in df.columns))
    return made.select(F.explode(rows).alias("r")).select("r.*")


def value_counts(df: DataFrame, column: str, most: int = 30) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)


def frozen_set(intake: DataFrame, annotations: DataFrame, adjudications: DataFrame, known: DataFrame, channels: list[str], tactics: list[str], least_turns: int = 2) -> DataFrame:
    """Every intake record with all that keeps it out of a frozen set, in `errors`: its own
    faults, faults of its annotations, missing consensus, and transcripts that `known` (column
    transcript_sha256) has already."""
    from .loaders import transcript

    own = intake.select("*", intake_errors(channels, least_turns).alias("_own"), F.sha2(transcript(F.col("turns")), 256).alias("transcript_sha256"))
    bad = annotations.select("conversation_id", F.explode(annotation_errors(tactics)).alias("e")).groupBy("conversation_id").agg(F.array_sort(F.collect_set("e")).alias("_notes"))
    signed = annotations.withColumn("tactics", F.array_sort(F.array_distinct("tactics")))
    status = consensus(signed, adjudications, "conversation_id", "annotator_id", ["is_scam", "scam_type", "tactics", "stage"]).select("conversation_id", "status")
    leaked = known.select("transcript_sha256", F.lit("leaks").alias("_leak")).distinct()
    out = own.join(bad, "conversation_id", "left").join(status, "conversation_id", "left").join(leaked, "transcript_sha256", "left")
    missing = F.when(F.coalesce("status", F.lit("needs_annotators")).isin("agreed", "adjudicated"), None).otherwise(F.coalesce("status", F.lit("needs_annotators")))
    none = F.array().cast("array<string>")
    return out.withColumn("errors", F.concat("_own", F.coalesce("_notes", none), F.array_compact(F.array(missing, F.col("_leak"))))).drop("_own", "_notes", "_leak", "status")
