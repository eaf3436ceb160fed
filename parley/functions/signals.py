"""Rule signals of a text: tactics, stage, scam type, risk features."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD

# fixed values: substrings that suggest a tactic
WEAK_TACTICS = {
    "authority_impersonation": ["officer", "police", "cbi", "rbi", "social security administration", "cyber cell", "customs officer", "bank manager"],
    "accusation": ["money laundering", "illegal transaction", "illegal activity", "narcotics", "fraudulent activity", "case against", "used in fraud"],
    "fear_threat": ["arrest", "warrant", "jail", "legal action", "blackmail", "severe consequence", "suspended", "account block", "account freeze", "penalty"],
    "urgency": ["urgent", "immediately", "right now", "act now", "24 hours", "2 ghante", "abhi", "turant", "jaldi", "time is of the essence", "every minute"],
    "secrecy": ["do not tell", "don't tell", "do not inform", "kisi ko mat", "secret", "confidential"],
    "isolation": ["stay on the line", "call disconnect mat", "do not disconnect", "don't hang up", "video call par raho"],
    "surveillance_control": ["screen share", "remote access", "download this app", "install app", "video call"],
    "financial_demand": ["transfer", "safe account", "pay ", "payment", "gift card", "security deposit", "processing fee", "₹", "rs."],
    "credential_otp_request": ["otp", "cvv", "password", "pin share", "social security number", "account details", "card number", "confirm your identity"],
}
# fixed values: word patterns that count towards a tactic
LEXICAL_TACTICS = {
    "authority_impersonation": [
        r"\b(?:cbi|rbi|police|customs?|narcotics?|court|officer|inspector|department)\b",
        "(?:पुलिस|अधिकारी|विभाग|अदालत|कस्टम|सीबीआई|आरबीआई)",
    ],
    "accusation": [
        r"\b(?:crime|criminal|money laundering|illegal|narcotics?|drugs?|arrest warrant|case against)\b",
        r"\b(?:jurm|apraadh|case hua|parcel.*drugs)\b",
        "(?:अपराध|गिरफ्तारी|मनी लॉन्ड्रिंग|नशीले पदार्थ)",
    ],
    "fear_threat": [
        r"\b(?:arrest|jail|freeze|block(?:ed)?|seize|punishment|legal action|warrant)\b",
        r"\b(?:giraftar|jail bhej|account band|nuksan)\b",
        "(?:गिरफ्तार|जेल|खाता बंद|कानूनी कार्रवाई)",
    ],
    "urgency": [
        r"\b(?:immediately|right now|urgent|within \d+|today only|last chance|without delay)\b",
        r"\b(?:abhi|turant|jaldi|der mat)\b",
        "(?:अभी|तुरंत|जल्दी|बिना देरी)",
    ],
    "secrecy": [
        r"\b(?:do not|don'?t|never)\s+(?:tell|inform|share|discuss)\b",
        r"\b(?:kisi ko mat|batana mat|secret rakh)\b",
        "(?:किसी को मत|मत बताना|गुप्त रख)",
    ],
    "isolation": [
        r"\b(?:stay alone|go to a room|lock the door|keep this call connected|do not disconnect)\b",
        r"\b(?:akele|kamre mein|call mat kat|phone mat rakh)\b",
        "(?:अकेले|कमरे में|कॉल मत काट|फोन मत रख)",
    ],
    "surveillance_control": [
        r"\b(?:screen share|share your screen|video call|camera on|remote access|anydesk|teamviewer)\b",
        r"\b(?:screen dikhao|camera on rakho)\b",
        "(?:स्क्रीन शेयर|कैमरा चालू)",
    ],
    "financial_demand": [
        r"\b(?:transfer|deposit|pay|payment|send money|safe account|security amount|processing fee|withdraw)\b",
        r"\b(?:paise bhej|paisa transfer|jama karo|payment karo)\b",
        "(?:पैसे भेज|ट्रांसफर|जमा करो|भुगतान)",
    ],
    "credential_otp_request": [
        r"\b(?:otp|one time password|pin|cvv|password|verification code|login code)\b",
        "(?:ओटीपी|पासवर्ड|पिन|सीवीवी)",
    ],
}
# fixed values: substrings that decide the scam type, the first rule that fits
TYPE_RULES = [
    (["digital arrest", "arrest warrant", "money laundering", "narcotics", "cbi", "cyber crime", "police station"], "digital_arrest"),
    (["kyc", "rbi", "bank account", "account block", "atm card", "debit card"], "fake_kyc_bank"),
    (["parcel", "courier", "customs", "fedex", "delivery charge", "amazon order"], "courier_customs"),
    (["investment", "trading", "guaranteed return", "double your money", "crypto profit"], "investment"),
    (["job offer", "registration fee", "instant loan", "loan approval"], "loan_job"),
    (["technical support", "remote access", "your computer", "microsoft support"], "tech_support"),
]
# fixed values: substrings that turn a bank story into an account takeover
TAKEOVER_WORDS = ["otp", "cvv", "pin share"]
# fixed values: scam types of source categories
CATEGORY_TYPES = {
    "police_digital_arrest": "digital_arrest", "police_blackmail": "digital_arrest", "aadhaar": "digital_arrest",
    "bank_kyc": "fake_kyc_bank", "amazon": "courier_customs", "relative": "impersonation_other",
}
# fixed values: words that a hard negative shares with scams
RISK_WORDS = (
    "bank|account|police|cbi|rbi|aadhaar|aadhar|courier|parcel|otp|pin|payment|transfer|money|fraud|card|kyc|loan|"
    "refund|security|verification|case|arrest|खाता|बैंक|पुलिस|पैसे|भुगतान|ओटीपी|आधार"
)


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def weak_tactics(text: Column) -> Column:
    """Map of tactic to 1, or null where nothing is known (which is not a no)."""
    low = F.lower(text)
    return F.create_map(*(c for k, words in WEAK_TACTICS.items() for c in (F.lit(k), F.when(has_any(low, words), F.lit(1)))))


def weak_stage(tactics: Column, turn: Column) -> Column:
    on = lambda *names: reduce(lambda a, b: a | b, (F.coalesce(tactics[n] == 1, F.lit(False)) for n in names))
    return (
        F.when(on("financial_demand", "credential_otp_request"), "payment_extraction")
        .when(on("isolation", "secrecy", "surveillance_control"), "isolation_control")
        .when(on("fear_threat"), "threat").when(on("accusation"), "accusation")
        .when(on("authority_impersonation"), "authority_claim")
        .when(turn == 0, "contact").otherwise("none_unknown")
    )


def scam_type(text: Column, category: Column | None = None) -> Column:
    low, out = F.lower(text), None
    for words, name in TYPE_RULES:
        value = F.when(has_any(low, TAKEOVER_WORDS), "otp_account_takeover").otherwise(name) if name == "fake_kyc_bank" else F.lit(name)
        out = F.when(has_any(low, words), value) if out is None else out.when(has_any(low, words), value)
    if category is not None:
        table = F.create_map(*(F.lit(x) for pair in CATEGORY_TYPES.items() for x in pair))
        return out.otherwise(F.coalesce(F.try_element_at(table, F.coalesce(category, F.lit(""))), F.lit("other_scam")))
    return out.otherwise("other_scam")


def bounded(pattern: str) -> str:
    """A pattern for lower-case text. Its boundaries stand before and after ASCII letters or
    digits, so each needs to look one way only; blanks and digits are those of any script."""
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b").replace(r"\s", r"[\s\x{85}\p{Z}]").replace(r"\d", r"\p{Nd}")
    if inner == pattern:
        return pattern
    assert r"\b" not in inner
    return f"(?<!{WORD}){inner}(?!{WORD})"


def openings(pattern: str) -> list[str]:
    """How a match of the pattern can begin: the literal start of each choice in its first group."""
    body, depth, choices = pattern.removeprefix(r"\b").removeprefix("(?:"), 0, [""]
    for c in body:
        if c == ")" and depth == 0:
            break
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            choices.append("")
        else:
            choices[-1] += c
    starts = [re.match(r"(?:[^\\.?*+()\[](?![?*]))*", c)[0] for c in choices]
    assert all(starts), pattern
    return starts


def lexical_hits(text: Column) -> dict[str, Column]:
    """Matches by tactic. A pattern runs only on texts that hold one of its openings, which is
    what most texts do not."""
    low = F.lower(text)

    def count(pattern: str) -> Column:
        return F.when(has_any(low, openings(pattern)), F.regexp_count(low, F.lit(bounded(pattern)))).otherwise(0)

    return {k: reduce(lambda a, b: a + b, map(count, ps)) for k, ps in LEXICAL_TACTICS.items()}


def stage_progress(hits: dict[str, Column]) -> Column:
    steps = [
        ("authority_impersonation",), ("accusation",), ("fear_threat", "urgency"),
        ("isolation", "secrecy", "surveillance_control"), ("financial_demand", "credential_otp_request"),
    ]
    return F.greatest(F.lit(0.0), *(F.when(reduce(lambda a, b: a | b, (hits[n] > 0 for n in names)), F.lit((i + 1) / 6)).otherwise(0.0) for i, names in enumerate(steps)))


def text_shape(text: Column) -> dict[str, Column]:
    """log counts of lines, tokens and characters, and the shares of digits and capitals."""
    solid = F.regexp_replace(text, r"(?U)\s+", "")
    letters = F.regexp_replace(solid, r"[^\p{L}]", "")
    tokens = F.regexp_count(text, F.lit(r"(?U)\S+"))
    lines = F.regexp_count(text, F.lit("\n")) + F.when(F.regexp_replace(text, r"(?U)\s+", "") != "", 1).otherwise(0)
    return {
        "log_lines": F.log1p(lines.cast("double")), "log_tokens": F.log1p(tokens.cast("double")), "log_chars": F.log1p(F.length(text).cast("double")),
        "digit_share": F.regexp_count(solid, F.lit(r"(?U)\d")) / F.greatest(F.lit(1), F.length(solid)),
        "capital_share": F.regexp_count(letters, F.lit(r"\p{Lu}")) / F.greatest(F.lit(1), F.length(letters)),
    }


def risk_features(text: Column, base_score: Column, entities: Column, hits: dict[str, Column] | None = None) -> dict[str, Column]:
    """The fixed row of 30 features; entities is the array that functions.entities extracts.
    hits, if they are columns already, are not counted again."""
    from .entities import FEATURE_TYPES

    hits = hits or lexical_hits(text)
    shares = {k: F.least(F.lit(5.0), v.cast("double")) / 5 for k, v in hits.items()}
    count = lambda test: F.size(F.filter(entities, test)).cast("double")
    out = {"base_score": base_score} | text_shape(text)
    out["entity_share"] = F.least(F.lit(10.0), F.size(entities).cast("double")) / 10
    out["sensitive_share"] = F.least(F.lit(10.0), count(lambda e: e["sensitive"])) / 10
    of_type = lambda t: count(lambda e: e["entity_type"] == t)
    out |= {f"entity_{t}": F.least(F.lit(3.0), of_type(t)) / 3 for t in FEATURE_TYPES}
    out |= {f"tactic_{k}": v for k, v in shares.items()}
    out["tactic_coverage"] = reduce(lambda a, b: a + b, (F.when(v > 0, 1.0).otherwise(0.0) for v in shares.values())) / len(shares)
    out["stage_progress"] = stage_progress(hits)
    return out
