"""Entities of a text with offsets: rules as a table, overlaps settled by rank, redaction.

Offsets need the positions of matches, which no built-in gives, so extraction is one
Arrow-batched UDF; counts, redaction and features work on its result with expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

ENTITY = (
    T.StructType().add("entity_type", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType())
    .add("value", T.StringType()).add("normalized_value", T.StringType()).add("redacted_value", T.StringType())
    .add("confidence", T.DoubleType()).add("sensitive", T.BooleanType())
)
# fixed values: the types that are features, and the rank that settles overlaps
FEATURE_TYPES = [
    "upi_id", "phone_number", "bank_account_candidate", "otp_code", "aadhaar_number", "url", "email",
    "monetary_amount", "case_reference", "authority_organisation", "payment_app",
]
RANK = {
    "otp_code": 100, "aadhaar_number": 95, "phone_number": 90, "bank_account_candidate": 85, "upi_id": 80, "email": 75,
    "url": 70, "case_reference": 60, "monetary_amount": 55, "authority_organisation": 40, "payment_app": 35,
}
# fixed values: handles of payment addresses, and names with the patterns they go by
UPI_HANDLES = [
    "upi", "ybl", "ibl", "axl", "paytm", "okaxis", "okhdfcbank", "okicici", "oksbi", "apl", "ptyes", "pthdfc", "pingpay",
    "waaxis", "wahdfcbank", "waicici", "wasbi", "naviaxis", "navihdfc", "navisbi",
]
AUTHORITIES = {
    "CBI": r"\b(?:cbi|central bureau of investigation)\b",
    "RBI": r"\b(?:rbi|reserve bank of india)\b",
    "Police": r"\b(?:police|पुलिस)\b",
    "Cyber Crime": r"\b(?:cyber\s*crime|cyber\s*cell|साइबर\s*क्राइम)\b",
    "Customs": r"\b(?:customs?|custom department|कस्टम)\b",
    "Enforcement Directorate": r"\b(?:enforcement directorate|ईडी|ed officer)\b",
    "Narcotics Bureau": r"\b(?:narcotics?|ncb officer|नारकोटिक्स)\b",
    "Supreme Court": r"\b(?:supreme court|सुप्रीम कोर्ट)\b",
    "Income Tax": r"\b(?:income tax|आयकर)\b",
}
PAYMENT_APPS = {
    "PhonePe": r"\bphone\s*pe\b",
    "Google Pay": r"\b(?:google\s*pay|gpay)\b",
    "Paytm": r"\bpaytm\b",
    "BHIM": r"\bbhim\b",
    "WhatsApp Pay": r"\bwhatsapp\s*pay\b",
}
# fixed values: patterns of identifiers, the words that must stand near a number, and how near
URL = r"(?i)\b(?:https?://|www\.)[^\s<>\"']+"
EMAIL = r"(?i)(?<![\w.-])[\w.+-]{1,64}@[a-z0-9-]+(?:\.[a-z0-9-]+)+"
UPI = r"(?i)(?<![\w.-])[a-z0-9._-]{2,100}@([a-z][a-z0-9]{1,30})(?![\w-]|\.[a-z0-9])"
PHONE = r"(?<!\d)(?:\+?91[-\s]?)?[6-9](?:[-\s]?\d){9}(?!\d)"
DIGITS = r"(?<!\d)\d(?:[ -]?\d){3,17}(?!\d)"
AMOUNTS = [r"(?i)(?:₹|\brs\.?|\binr\b)\s*[0-9][0-9,]*(?:\.\d{1,2})?", r"(?i)\b[0-9][0-9,]*(?:\.\d{1,2})?\s*(?:rupees?|रुपये)\b"]
CASE = r"(?i)\b(?:case|fir|complaint|reference)\s*(?:no\.?|number|id|#)?\s*[:#-]?\s*([a-z0-9/-]{5,30})"
OTP_NEAR = r"\b(?:otp|pin|cvv|code|पासकोड|ओटीपी)\b"
AADHAAR_NEAR = r"\b(?:aadhaar|aadhar|आधार)\b"
ACCOUNT_NEAR = r"\b(?:account|acct|a/c|bank|खाता|अकाउंट)\b"
TRAILING, CLAUSE_ENDS, REACH = ".,;:!?)]}", ".!?;\n", 45


class Entity(NamedTuple):
    entity_type: str
    start: int
    end: int
    value: str
    normalized_value: str
    redacted_value: str
    confidence: float
    sensitive: bool


def digits_of(text: str) -> str:
    return re.sub(r"\D", "", text)


def tail(digits: str) -> str:
    return "***" + digits[-4:]


def clause(text: str, start: int, end: int) -> str:
    """What stands within reach of a span, in its own clause."""
    before, after = text[max(0, start - REACH) : start], text[end : end + REACH]
    before = re.split(f"[{CLAUSE_ENDS}]", before)[-1]
    after = re.split(f"[{CLAUSE_ENDS}]", after)[0]
    return (before + text[start:end] + after).casefold()


def _url(text: str, m: re.Match):
    value = m[0].rstrip(TRAILING)
    try:
        host = urlsplit(value if "://" in value else "https://" + value).hostname
    except ValueError:
        host = None
    return value, value, host or "unknown-host"


def _email(text: str, m: re.Match):
    local, domain = m[0].casefold().rsplit("@", 1)
    return m[0], f"{local}@{domain}", f"***@{domain}"


def _upi(text: str, m: re.Match):
    handle = m[1].casefold()
    return (m[0], m[0].casefold(), f"***@{handle}") if handle in UPI_HANDLES else None


def _phone(text: str, m: re.Match):
    number = digits_of(m[0])
    return m[0], "+91" + number[-10:], tail(number)


def _number(low: int, high: int, near: str, hide: Callable[[str], str], unless: Callable[[str, int], bool] = lambda c, n: False):
    def rule(text: str, m: re.Match):
        number, around = digits_of(m[0]), clause(text, m.start(), m.end())
        if low <= len(number) <= high and re.search(near, around) and not unless(around, len(number)):
            return m[0], number, hide(number)
        return None

    return rule


def _amount(text: str, m: re.Match):
    return m[0], re.sub("[^0-9.]", "", m[0]), m[0]


def _case(text: str, m: re.Match):
    return m[0], m[1].upper(), "[REDACTED CASE]"


def _named(name: str):
    return lambda text, m: (m[0], name, name)


# a text without any of these (lower case) has no match of the type, so its pattern is not run
HINTS = {
    "url": ("://", "www."), "email": ("@",), "upi_id": ("@",), "monetary_amount": ("₹", "rs", "inr", "rup", "रुप"),
    "case_reference": ("case", "fir", "complaint", "reference"),
}
NAME_HINTS = {
    "CBI": ("cbi", "central"), "RBI": ("rbi", "reserve"), "Police": ("police", "पुलिस"), "Cyber Crime": ("cyber", "साइबर"), "Customs": ("custom", "कस्टम"),
    "Enforcement Directorate": ("enforcement", "ईडी", "ed officer"), "Narcotics Bureau": ("narcotic", "ncb", "नारकोटिक्स"), "Supreme Court": ("supreme", "सुप्रीम"),
    "Income Tax": ("income", "आयकर"), "PhonePe": ("phone",), "Google Pay": ("google", "gpay"), "Paytm": ("paytm",), "BHIM": ("bhim",), "WhatsApp Pay": ("whatsapp",),
}
DIGIT = re.compile(r"\d")
# letters that a pattern without case takes for an ASCII one, though lower() does not give it
FOLDED = str.maketrans({"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"})
WITH_DIGITS = {"phone_number", "otp_code", "aadhaar_number", "bank_account_candidate", "monetary_amount"}


def _rules() -> list[tuple[str, re.Pattern, Callable, float, bool, tuple[str, ...]]]:
    aadhaar_first = lambda around, n: n == 12 and bool(re.search(AADHAAR_NEAR, around))
    table = [
        ("url", URL, _url, 0.98, True), ("email", EMAIL, _email, 0.99, True), ("upi_id", UPI, _upi, 0.99, True),
        ("phone_number", PHONE, _phone, 0.97, True),
        ("otp_code", DIGITS, _number(4, 8, OTP_NEAR, lambda d: "[REDACTED OTP]"), 0.96, True),
        ("aadhaar_number", DIGITS, _number(12, 12, AADHAAR_NEAR, tail), 0.97, True),
        ("bank_account_candidate", DIGITS, _number(9, 18, ACCOUNT_NEAR, tail, aadhaar_first), 0.82, True),
        *(("monetary_amount", p, _amount, 0.95, False) for p in AMOUNTS),
        ("case_reference", CASE, _case, 0.84, True),
    ]
    plain = [(kind, re.compile(p), rule, sure, secret, HINTS.get(kind, ())) for kind, p, rule, sure, secret in table]
    named = [("authority_organisation", n, p, 0.90) for n, p in AUTHORITIES.items()] + [("payment_app", n, p, 0.94) for n, p in PAYMENT_APPS.items()]
    return plain + [(kind, re.compile("(?i)" + p), _named(n), sure, False, NAME_HINTS[n]) for kind, n, p, sure in named]


RULES = _rules()


def found(text: str) -> Iterator[Entity]:
    low, digits = (text if text.isascii() else text.translate(FOLDED)).lower(), DIGIT.search(text) is not None
    for kind, pattern, rule, sure, secret, hints in RULES:
        if hints and not any(h in low for h in hints) or not digits and kind in WITH_DIGITS:
            continue
        for m in pattern.finditer(text):
            made = rule(text, m)
            if made:
                value, plain, shown = made
                yield Entity(kind, m.start(), m.start() + len(value), value, plain, shown, sure, secret)


def entities_of(text: str | None) -> list[Entity]:
    """Entities in text order; of overlapping ones the higher rank, then the surer, then the
    earlier stays. What stays is a list of intervals apart from each other in text order, so one
    that comes later has at most two neighbours to clear."""
    ranked: dict[tuple[int, float, int], list[Entity]] = {}
    for e in found(text or ""):
        ranked.setdefault((-RANK[e.entity_type], -e.confidence, e.start), []).append(e)
    starts: list[int] = []
    stay: list[Entity] = []
    for key in sorted(ranked):
        for e in ranked[key]:
            at = bisect_left(starts, e.start)
            before, after = stay[at - 1 : at] if at else [], stay[at : at + 1]
            if not any(o.end > e.start for o in before) and not any(o.start < e.end for o in after):
                starts.insert(at, e.start)
                stay.insert(at, e)
    return stay


@pandas_udf(T.ArrayType(ENTITY))
def extract(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [e._asdict() for e in entities_of(t)])


def public_view(entities: Column) -> Column:
    """Entities without raw values: sensitive ones show their redacted form only."""
    return F.transform(
        entities,
        lambda e: F.struct(
            e["entity_type"].alias("entity_type"), e["start"].alias("start"), e["end"].alias("end"),
            F.when(e["sensitive"], e["redacted_value"]).otherwise(e["value"]).alias("value"),
            F.when(e["sensitive"], e["redacted_value"]).otherwise(e["normalized_value"]).alias("normalized_value"),
            e["confidence"].alias("confidence"), e["sensitive"].alias("sensitive"),
        ),
    )


def type_counts(entities: Column) -> Column:
    kinds = F.transform(entities, lambda e: e["entity_type"])
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))


def exploded(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row per entity."""
    return df.select(*keys, F.explode(extract(F.col(text))).alias("e")).select(*keys, "e.*")


def masked_tail(text: Column, visible: int = 4) -> Column:
    digits = F.regexp_replace(text, r"(?U)\D", "")
    return F.when(digits == "", "[REDACTED]").otherwise(F.concat(F.lit("***"), F.right(digits, F.lit(visible))))
