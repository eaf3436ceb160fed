"""Text expressions: normalising, formatting, masking, splitting. JVM-side unless noted."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# a word boundary that counts letters, digits and underscore, but not combining marks
WORD = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# fixed values: what is masked, in the order it is masked, and the mask
MASKS = [
    (rf"(?i){EDGE}(?:https?://|www\.)\S+", "[url]"),
    (rf"(?i){EDGE}[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}{EDGE}", "[email]"),
    (rf"(?<!{WORD})(?:\+?\d[\d\s().-]{{7,}}\d)(?!{WORD})", "[phone]"),
    (rf"(?i){EDGE}[a-z0-9._-]{{2,}}@[a-z]{{2,}}{EDGE}", "[upi]"),
    (rf"(?i){EDGE}(?:mr|mrs|ms|miss|officer|agent|doctor|dr)\.?\s+[a-z]+{EDGE}", "[person]"),
    (rf"{EDGE}\d+(?:[.,]\d+)*{EDGE}", "[number]"),
]
# the masks that a regex engine without lookaround also runs
PLAIN_MASKS = [
    (r"https?://[^ \n\t]+", "[url]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+", "[email]"),
    (r"[0-9]+(?:[.,][0-9]+)*", "[number]"),
]
ROLE_MARKER = r"(?i)(?:^|\s)(?:caller|receiver|innocent|suspect)\s*:\s*"


@pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no built-in for it."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@pandas_udf(StringType())
def casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t.casefold())


def collapse(text: Column) -> Column:
    """White-space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    """NFKC, zero-width marks gone, white space collapsed; null counts as empty."""
    return collapse(F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), "[​﻿]", ""))


def asr_normalize(text: Column) -> Column:
    """For transcripts: normalised and casefolded, letters, marks and digits only."""
    return collapse(F.regexp_replace(casefold(normalize(text)), r"[^\p{L}\p{M}\p{N}\s]", " "))


def role_tag(role: Column) -> Column:
    """A role as it appears in a tag: trimmed, lower case, spaces as underscores; none is unknown."""
    name = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    return F.regexp_replace(F.when(name == "", "unknown").otherwise(name), " ", "_")


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("[ROLE="), role_tag(role), F.lit("] "), collapse(text))


def format_conversation(turns: Column) -> Column:
    """Turns of (speaker_role, raw_text, normalized_text) as lines; blank turns are left out."""
    body = lambda t: F.coalesce(F.nullif(F.trim(t["normalized_text"]), F.lit("")), t["raw_text"], F.lit(""))
    spoken = F.filter(turns, lambda t: F.trim(body(t)) != "")
    return F.array_join(F.transform(spoken, lambda t: format_turn(t["speaker_role"], body(t))), "\n")


def mask(text: Column, masks: list[tuple[str, str]] = MASKS, pad: str = "") -> Column:
    for pattern, name in masks:
        text = F.regexp_replace(text, pattern, f"{pad}{name}{pad}")
    return text


def transcript_line(role: Column, text: Column) -> Column:
    return F.concat(role, F.lit(":"), text)


def split_roles(text: Column) -> Column:
    """Array of (role, text) from a dialogue with role markers; what stands before the first
    marker is dropped, markers without text too; no markers give one unknown turn."""
    marks = F.regexp_extract_all(text, F.lit(r"(?i)(?:^|\s)(caller|receiver|innocent|suspect)\s*:\s*"), F.lit(1))
    bodies = F.slice(F.split(text, ROLE_MARKER, -1), 2, F.greatest(F.size(marks), F.lit(1)))
    role = lambda r: F.when(F.lower(r).isin("caller", "suspect"), "caller").otherwise("recipient")
    made = F.zip_with(marks, bodies, lambda r, b: F.struct(role(r).alias("role"), collapse(b).alias("text")))
    kept = F.filter(made, lambda t: t["text"] != "")
    alone = F.array(F.struct(F.lit("unknown").alias("role"), collapse(text).alias("text")))
    return F.when(F.size(kept) > 0, kept).otherwise(alone)


def split_utterances(text: Column, mark: str = "__eou__") -> Column:
    """Array of (role, text): utterances between marks, speakers taking turns."""
    said = F.filter(F.transform(F.split(text, mark), collapse), lambda s: s != "")
    return F.transform(said, lambda s, i: F.struct(F.when(i % 2 == 0, "speaker_a").otherwise("speaker_b").alias("role"), s.alias("text")))


def ensure_caller_tag(text: Column) -> Column:
    """Collapsed text with a caller tag in front unless it has a role tag; empty text is an error."""
    plain = collapse(text)
    checked = F.when(plain == "", F.raise_error(F.lit("text must not be empty")).cast("string")).otherwise(plain)
    return F.when(checked.startswith("[ROLE="), checked).otherwise(F.concat(F.lit("[ROLE=caller] "), checked))


def reply_turns(reply: Column) -> Column:
    """Turns out of a model's reply that wraps a JSON object in prose or fences."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.from_json(body, "turns array<struct<speaker_role:string,text:string,stage:string,tactics:array<string>>>")["turns"]


def head_tail(ids: Column, budget: int, head_share: float, first: int, middle: int, last: int) -> Column:
    """Token ids cut to a budget that holds three marks: the head, a separator, the tail."""
    room = budget - 2
    head = int((room - 1) * head_share)
    tail = room - 1 - head
    mark = lambda v: F.array(F.lit(v))
    cut = F.concat(mark(first), F.slice(ids, 1, head), mark(middle), F.slice(ids, -tail, tail), mark(last)) if tail else F.concat(mark(first), F.slice(ids, 1, head), mark(middle), mark(last))
    return F.when(F.size(ids) <= room, F.concat(mark(first), ids, mark(last))).otherwise(cut)
