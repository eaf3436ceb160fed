"""Turn-level supervision for several heads, with what is unknown kept apart from what is not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text
from ..schema import SCAM_TYPES

# fixed values: newer names of tactics
RENAMED = {
    "fear_threat": "fear_intimidation", "urgency": "urgency_scarcity", "secrecy": "secrecy_instruction",
    "isolation": "isolation_instruction", "credential_otp_request": "credential_request",
}


def canonical_tactic(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for p in RENAMED.items() for x in p))
    return F.coalesce(F.try_element_at(table, name), name)


def known_type(is_scam: Column, scam_type: Column) -> Column:
    """A type of the closed list: none for negatives, other_scam for unknown ones of positives."""
    return F.when(is_scam == 0, "non_scam").when(scam_type.isin(SCAM_TYPES), scam_type).otherwise("other_scam")


def turn_records(turns: Column, tactics: list[str], stages: list[str]) -> Column:
    """Array of (text, tactics as 0/1 in the order given, stage) of the spoken turns."""
    body = lambda t: F.coalesce(F.nullif(F.trim(t["normalized_text"]), F.lit("")), t["raw_text"], F.lit(""))
    names = F.array(*(F.lit(x) for x in tactics))

    def record(t: Column) -> Column:
        held = F.coalesce(t["labels"]["tactics"], F.create_map().cast("map<string,int>"))
        on = F.transform(F.map_keys(F.map_filter(held, lambda k, v: v == 1)), canonical_tactic)
        stage = F.when(t["labels"]["stage"].isin(stages), t["labels"]["stage"]).otherwise("none_unknown")
        return F.struct(
            text.format_turn(t["speaker_role"], body(t)).alias("text"),
            F.transform(names, lambda n: F.array_contains(on, n).cast("double")).alias("tactics"), stage.alias("stage"),
        )

    return F.transform(F.filter(turns, lambda t: F.trim(body(t)) != ""), record)


def conversation_labels(records: Column, is_scam: Column, stages: list[str], unknown_weight: float) -> Column:
    """Struct tactic_labels, tactic_mask, stage, stage_mask. Negatives are sure of all; positives
    know what is marked, weigh what is not by `unknown_weight`, and nothing if none is marked."""
    width = F.size(F.try_element_at(records, F.lit(1))["tactics"])
    zeros = F.array_repeat(F.lit(0.0), F.coalesce(width, F.lit(0)))
    labels = F.aggregate(records, zeros, lambda a, r: F.zip_with(a, r["tactics"], lambda x, y: F.greatest(x, y)))
    order = F.array(*(F.lit(s) for s in stages))
    known = F.filter(F.transform(records, lambda r: r["stage"]), lambda s: s != "none_unknown")
    far = F.array_max(F.transform(known, lambda s: F.array_position(order, s)))
    annotated = F.exists(labels, lambda x: x > 0)
    mask = F.when(is_scam == 0, F.transform(labels, lambda x: F.lit(1.0))).otherwise(
        F.transform(labels, lambda x: F.when(x > 0, 1.0).when(annotated, unknown_weight).otherwise(0.0))
    )
    stage = F.when((is_scam == 1) & far.isNotNull(), F.element_at(order, far.cast("int"))).otherwise("none_unknown")
    stage_mask = F.when((is_scam == 0) | far.isNotNull(), 1.0).otherwise(0.0)
    return F.struct(labels.alias("tactic_labels"), mask.alias("tactic_mask"), stage.alias("stage"), stage_mask.alias("stage_mask"))


def generated_turns(turns: Column, is_scam: Column, scam_type: Column, stages: list[str], tactics: list[str], provenance: str) -> Column:
    """Turns of a model's reply as canonical turns: roles by parity where they are unknown,
    stages and tactics from the closed lists only, no labels on negatives."""
    placed = F.transform(turns, lambda t, i: F.struct(t.alias("t"), i.alias("i"), text.collapse(F.coalesce(t["text"], F.lit(""))).alias("body")))
    spoken = F.filter(placed, lambda p: p["body"] != "")
    names = F.array(*(F.lit(x) for x in tactics))

    def made(p: Column, n: Column) -> Column:
        role = F.lower(F.trim(F.coalesce(p["t"]["speaker_role"], F.lit(""))))
        role = F.when(role.isin("caller", "callee"), role).when(p["i"] % 2 == 0, "caller").otherwise("callee")
        stage = F.when(is_scam == 0, "none_unknown").when(p["t"]["stage"].isin(stages), p["t"]["stage"]).otherwise("contact")
        marked = F.array_intersect(F.coalesce(p["t"]["tactics"], F.array().cast("array<string>")), names)
        held = F.map_from_arrays(marked, F.transform(marked, lambda x: F.lit(1)))
        return F.struct(
            n.cast("int").alias("turn_id"), role.alias("speaker_role"), p["body"].alias("raw_text"), p["body"].alias("normalized_text"),
            F.lit("hinglish").alias("language"),
            F.struct(
                is_scam.cast("int").alias("is_scam"), scam_type.alias("scam_type"),
                F.when(is_scam == 1, held).otherwise(F.create_map().cast("map<string,int>")).alias("tactics"), stage.alias("stage"),
                F.lit(provenance).alias("provenance"),
            ).alias("labels"),
        )

    return F.transform(spoken, made)
