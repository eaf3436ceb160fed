"""From raw rows to canonical conversations: adapters, turns, fingerprints, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing, signals, text
from ..schema import SCAM_TYPES, STAGES, TACTICS, VERSION

TYPE_OF_LABELS = "map<string,int>"


def label_struct(is_scam: Column, scam_type: Column, tactics: Column, stage: Column, provenance: Column) -> Column:
    return F.struct(
        is_scam.cast("int").alias("is_scam"), scam_type.cast("string").alias("scam_type"), tactics.cast(TYPE_OF_LABELS).alias("tactics"),
        stage.cast("string").alias("stage"), provenance.cast("string").alias("provenance"),
    )


def negative_labels() -> Column:
    none = F.create_map(*(F.lit(x) for t in TACTICS for x in (t, 0)))
    return label_struct(F.lit(0), F.lit("non_scam"), none, F.lit("none_unknown"), F.lit("source_negative"))


def weak_labels(said: Column, turn: Column, scam_type: Column) -> Column:
    tactics = signals.weak_tactics(said)
    return label_struct(F.lit(1), scam_type, tactics, signals.weak_stage(tactics, turn), F.lit("weak_rule"))


def unlabeled() -> Column:
    none = F.create_map(*(c for t in TACTICS for c in (F.lit(t), F.lit(None).cast("int"))))
    return label_struct(F.lit(None), F.lit(None), none, F.lit(None), F.lit("unlabeled"))


def build_turns(said: Column, is_scam: Column, scam_type: Column, language: Column) -> Column:
    """Turns out of an array of (role, text): blank ones dropped, the rest numbered densely.
    Negatives get negative labels; of positives the caller's side gets weak labels, by the
    turn's place before blanks went."""
    placed = F.transform(said, lambda t, i: F.struct(t["role"].alias("role"), t["text"].alias("raw"), text.collapse(t["text"]).alias("plain"), i.alias("place")))
    spoken = F.filter(placed, lambda t: t["plain"] != "")
    labels = lambda t: (
        F.when(is_scam == 0, negative_labels())
        .when((is_scam == 1) & t["role"].isin("caller", "sender", "unknown"), weak_labels(t["plain"], t["place"], scam_type))
        .otherwise(unlabeled())
    )
    return F.transform(
        spoken,
        lambda t, i: F.struct(
            i.cast("int").alias("turn_id"), t["role"].alias("speaker_role"), t["raw"].alias("raw_text"), t["plain"].alias("normalized_text"),
            language.alias("language"), labels(t).alias("labels"),
        ),
    )


def canonical(df: DataFrame, dataset: str, said: Column, record: Column, is_scam: Column, scam_type: Column, language: str, provenance: str, source_type: str, rank: int = 0, **metadata: Column) -> DataFrame:
    """One source's rows as canonical conversations; `ordinal` keeps source and row order."""
    lang = F.lit(language)
    meta = F.create_map(*(c for k, v in metadata.items() for c in (F.lit(k), v.cast("string")))) if metadata else F.create_map().cast("map<string,string>")
    source = F.struct(
        F.lit(dataset).alias("dataset_id"), F.lit(None).cast("string").alias("repository"), F.lit(None).cast("string").alias("revision"),
        F.lit(None).cast("string").alias("license"), record.cast("string").alias("record_id"), F.lit(None).cast("string").alias("original_split"),
        F.lit(source_type).alias("source_type"),
    )
    # columns of their own, so that they are not worked out again for every turn
    df = df.withColumns({"_said": said, "_kind": scam_type})
    said, scam_type = F.col("_said"), F.col("_kind")
    return df.select(
        F.lit(VERSION).alias("schema_version"), hashing.stable_id(dataset, record.cast("string")).alias("conversation_id"), source.alias("source"),
        F.array(lang).alias("language_profile"),
        F.struct(is_scam.cast("int").alias("is_scam"), scam_type.alias("scam_type"), F.lit(provenance).alias("provenance")).alias("conversation_label"),
        build_turns(said, is_scam, scam_type, lang).alias("turns"), meta.alias("metadata"),
        F.struct(F.lit(rank).alias("source"), record.cast("string").alias("row")).alias("ordinal"),
    )


def from_labelled_calls(df: DataFrame) -> DataFrame:
    """Columns text, label, scam_category and free metadata: dialogues with role markers."""
    label = F.col("label").cast("int")
    kind = F.when(label == 1, signals.scam_type(F.col("text"), F.col("scam_category"))).otherwise("non_scam")
    return canonical(df, "labelled_calls", text.split_roles(F.col("text")), F.col("row"), label, kind, "hi-Latn", "source_label", "synthetic", 0, category=F.col("scam_category"))


def from_messages(df: DataFrame) -> DataFrame:
    """Columns message, label (scam or legit), language: single messages."""
    label = F.when(F.lower(F.trim("label")) == "scam", 1).otherwise(0)
    said = F.array(F.struct(F.lit("sender").alias("role"), F.col("message").alias("text")))
    kind = F.when(label == 1, signals.scam_type(F.col("message"))).otherwise("non_scam")
    return canonical(df, "messages", said, F.col("row"), label, kind, "mul", "source_label", "public", 1)


def from_dialogues(df: DataFrame, dataset: str = "synthetic_dialogue", rank: int = 2) -> DataFrame:
    """Columns dialogue, type, label: dialogues with role markers."""
    label = F.col("label").cast("int")
    kind = F.when(label == 1, signals.scam_type(F.concat_ws(" ", "type", "dialogue"))).otherwise("non_scam")
    return canonical(df, dataset, text.split_roles(F.col("dialogue")), F.col("row"), label, kind, "en", "source_label", "synthetic", rank, scenario=F.col("type"))


def from_intents(df: DataFrame) -> DataFrame:
    """Columns text, category: customer requests, all negative."""
    said = F.array(F.struct(F.lit("customer").alias("role"), F.col("text").alias("text")))
    return canonical(df, "intents", said, F.col("row"), F.lit(0), F.lit("non_scam"), "en", "source_negative", "public", 4, category=F.col("category"))


def from_utterances(df: DataFrame) -> DataFrame:
    """Column value: one dialogue a line, utterances between marks, all negative."""
    return canonical(df, "daily", text.split_utterances(F.col("value")), F.col("row"), F.lit(0), F.lit("non_scam"), "en", "source_negative", "public", 5)


def from_dialogue_arrays(df: DataFrame) -> DataFrame:
    """Columns dialogue_id, services, turns(speaker, utterance), all negative."""
    said = F.transform("turns", lambda t: F.struct(F.lower(t["speaker"]).alias("role"), t["utterance"].alias("text")))
    return canonical(df, "schema_guided", said, F.col("dialogue_id"), F.lit(0), F.lit("non_scam"), "en", "source_negative", "public", 6, services=F.array_join("services", ","))


def union_sources(sources: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), sources)


def fingerprinted(df: DataFrame) -> DataFrame:
    line = lambda t, masks: F.concat(t["speaker_role"], F.lit(":"), text.mask(F.lower(t["normalized_text"]), masks))
    whole = lambda masks: F.sha2(F.array_join(F.transform("turns", lambda t: line(t, masks)), "\n"), 256)
    return df.withColumn("exact_sha256", whole([])).withColumn("template_sha256", whole(text.MASKS))


def validation_errors() -> Column:
    """Codes of what is wrong with a canonical row; empty if nothing is."""
    turns = F.col("turns")
    numbers = F.transform(turns, lambda t: t["turn_id"])
    checks = [
        (F.col("schema_version") != VERSION, "bad_schema_version"),
        (F.length("conversation_id") < 8, "bad_conversation_id"),
        (F.size(turns) < 1, "no_turns"),
        ((F.size(turns) > 0) & (numbers != F.transform(turns, lambda t, i: i.cast("int"))), "noncontiguous_turns"),
        (F.exists(turns, lambda t: F.trim(t["normalized_text"]) == ""), "empty_turn"),
        (~F.coalesce(F.col("conversation_label.is_scam").isin(0, 1), F.lit(True)), "bad_label"),
        (~F.coalesce(F.col("conversation_label.scam_type").isin(SCAM_TYPES), F.lit(True)), "bad_scam_type"),
        (F.exists(turns, lambda t: ~F.coalesce(t["labels"]["stage"].isin(STAGES), F.lit(True))), "bad_stage"),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(code)) for c, code in checks)))


def with_quality(df: DataFrame) -> DataFrame:
    """duplicate_of, exclusion_reasons, training_eligible. The first row of equal fingerprints
    counts, valid or not, so a copy of an excluded row is excluded too."""
    first = F.first("conversation_id").over(W.partitionBy("exact_sha256").orderBy("ordinal", "conversation_id"))
    out = df.withColumn("first_id", first)
    copy = F.col("first_id") != F.col("conversation_id")
    reasons = F.concat(
        F.array_compact(F.array(F.when(F.col("conversation_label.is_scam").isNull(), "missing_label"), F.when(copy, "exact_duplicate"))),
        F.transform(validation_errors(), lambda e: F.concat(F.lit("validation:"), e)),
    )
    return (
        out.withColumn("duplicate_of", F.when(copy, F.col("first_id"))).withColumn("exclusion_reasons", reasons)
        .withColumn("training_eligible", F.size("exclusion_reasons") == 0).drop("first_id")
    )


def flat_turns(df: DataFrame) -> DataFrame:
    return df.select(
        "conversation_id", F.col("source.dataset_id").alias("dataset_id"), F.col("conversation_label.is_scam").alias("conversation_is_scam"),
        F.explode("turns").alias("t"),
    ).select("conversation_id", "dataset_id", "conversation_is_scam", "t.*")
