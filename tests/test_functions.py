"""Literal cases of text, hash, entity and number functions."""

import hashlib
import hmac as pyhmac
import math
import re

import pytest
from pyspark.sql import functions as F

from parley.functions import entities, hashing, numeric, signals, text
from parley.operators import metrics


def one(spark, column, **values):
    row = [tuple(values.values())] if values else [(1,)]
    return spark.createDataFrame(row, list(values) or ["x"]).select(column.alias("v")).first().v


def test_normalize(spark):
    assert one(spark, text.normalize(F.col("t")), t="  A​  B  ") == "A B"
    assert one(spark, text.normalize(F.col("t")), t="ﬁne １２") == "fine 12"
    assert one(spark, text.asr_normalize(F.col("t")), t="  HELLO,   Duniya! ") == "hello duniya"
    assert one(spark, text.asr_normalize(F.col("t")), t="नमस्ते, दुनिया!") == "नमस्ते दुनिया"


def test_roles(spark):
    said = lambda s: [tuple(r) for r in one(spark, text.split_roles(F.col("t")), t=s)]
    assert said("caller: Hello receiver: Hi caller: Urgent") == [("caller", "Hello"), ("recipient", "Hi"), ("caller", "Urgent")]
    assert said("intro Suspect: a innocent: b suspect:") == [("caller", "a"), ("recipient", "b")]
    assert said("no markers here") == [("unknown", "no markers here")]
    assert [tuple(r) for r in one(spark, text.split_utterances(F.col("t")), t="a __eou__ b __eou__")] == [("speaker_a", "a"), ("speaker_b", "b")]


def test_turn_format(spark):
    assert one(spark, text.format_turn(F.col("r"), F.col("t")), r="Caller", t="  Main CBI  se bol raha hoon. ") == "[ROLE=caller] Main CBI se bol raha hoon."
    assert one(spark, text.format_turn(F.col("r"), F.col("t")), r=" Bank Agent ", t="x") == "[ROLE=bank_agent] x"
    assert one(spark, text.format_turn(F.col("r"), F.col("t")), r="", t="x") == "[ROLE=unknown] x"
    turns = F.array(F.struct(F.lit("victim").alias("speaker_role"), F.lit("क्या हुआ?").alias("raw_text"), F.lit("").alias("normalized_text")),
                    F.struct(F.lit("caller").alias("speaker_role"), F.lit(" ").alias("raw_text"), F.lit(" ").alias("normalized_text")))
    assert one(spark, text.format_conversation(turns)) == "[ROLE=victim] क्या हुआ?"
    assert one(spark, text.ensure_caller_tag(F.col("t")), t=" a  b") == "[ROLE=caller] a b"
    with pytest.raises(Exception, match="must not be empty"):
        one(spark, text.ensure_caller_tag(F.col("t")), t="  ")


def test_masks(spark):
    m = lambda s: one(spark, text.mask(F.lower(F.col("t"))), t=s)
    assert m("Pay 100 now") == m("Pay 500 now") == "pay [number] now"
    assert m("see https://a.b/c?d=1 or www.x.y") == "see [url] or [url]"
    assert m("mail A.b@c.org") == "mail [email]"
    assert m("call +1 (743) 555-3824 now") == "call [phone] now"
    assert m("upi bob@okaxis") == "upi [upi]"
    assert m("Dr. Who came") == "[person] came"


def test_word_edges_do_not_count_marks(spark):
    got = {w: one(spark, F.regexp_count(F.col("t"), F.lit(f"{text.EDGE}(?:{w}){text.EDGE}")), t=f"x {w} y") for w in ("police", "पुलिस", "खाता", "रुपये")}
    assert got == {"police": 1, "पुलिस": 1, "खाता": 0, "रुपये": 0} == {w: len(re.findall(rf"\b(?:{w})\b", f"x {w} y")) for w in got}


def test_head_tail(spark):
    ids = F.array(*(F.lit(i) for i in range(20)))
    assert one(spark, text.head_tail(ids, 12, 0.5, 101, 99, 102)) == [101, 0, 1, 2, 3, 99, 15, 16, 17, 18, 19, 102]
    assert one(spark, text.head_tail(F.slice(ids, 1, 3), 12, 0.5, 101, 99, 102)) == [101, 0, 1, 2, 102]


def test_hashes(spark):
    d = hashlib.sha256(b"salt|k").hexdigest()
    assert one(spark, hashing.unit(F.col("k"), "salt"), k="k") == int(d[:16], 16) / 2**64
    assert one(spark, hashing.unit32(F.col("k"), "salt"), k="k") == int(d[:8], 16) / 2**32
    assert one(spark, hashing.assign_split(F.col("k"), "s"), k="g") == one(spark, hashing.assign_split(F.col("k"), "s"), k="g")
    assert one(spark, hashing.hash64(F.col("k")), k="f") & (2**64 - 1) == int(hashlib.sha256(b"f").hexdigest()[:16], 16)
    assert one(spark, hashing.stable_id("ds", F.col("k")), k="7") == "ds:" + hashlib.sha256(b"ds|7").hexdigest()[:20]
    assert one(spark, hashing.hamming(F.lit(-1), F.lit(0).cast("long"))) == 64
    assert [one(spark, hashing.band(F.lit(-1).cast("long"), b)) for b in range(8)] == [255] * 8
    for secret in ("s", "x" * 80):
        assert one(spark, hashing.hmac_sha256(F.col("m"), secret), m="päyload") == pyhmac.new(secret.encode(), "päyload".encode(), hashlib.sha256).hexdigest()


def test_entities():
    t = "CBI officer: pay Rs 25,000 to xy@okaxis via PhonePe or call +91 98765 43210, OTP 482910, see https://example.org/pay)."
    found = entities.entities_of(t)
    assert sorted(e.entity_type for e in found) == sorted(["authority_organisation", "monetary_amount", "upi_id", "payment_app", "phone_number", "otp_code", "url"])
    by = {e.entity_type: e for e in found}
    assert by["url"].value == "https://example.org/pay" and by["upi_id"].redacted_value == "***@okaxis" and by["phone_number"].redacted_value == "***3210"
    assert by["phone_number"].normalized_value == "+919876543210" and by["monetary_amount"].normalized_value == "25000"
    assert all(t[e.start : e.end] == e.value for e in found)
    lone = entities.entities_of("123456789012 is a number. My account number is 1234 5678 9012")
    assert [(e.entity_type, e.normalized_value) for e in lone] == [("bank_account_candidate", "123456789012")]
    assert sorted(e.entity_type for e in entities.entities_of("help@example.org and shield@ybl")) == ["email", "upi_id"]
    assert entities.entities_of(None) == [] == entities.entities_of("")


def test_entity_views(spark):
    df = spark.createDataFrame([("otp 482910 and bob@example.org",)], "t string").select(entities.extract(F.col("t")).alias("e"))
    row = df.select(entities.public_view(F.col("e")).alias("v"), entities.type_counts(F.col("e")).alias("n")).first()
    assert "482910" not in str(row.v) and row.n == {"email": 1, "otp_code": 1}
    assert one(spark, entities.masked_tail(F.col("t")), t="+91 98765") == "***8765" and one(spark, entities.masked_tail(F.col("t")), t="x") == "[REDACTED]"


def test_tactics(spark):
    got = one(spark, signals.weak_tactics(F.col("t")), t="CBI officer: pay immediately")
    assert got["authority_impersonation"] == 1 and got["urgency"] == 1 and got["secrecy"] is None
    assert one(spark, signals.scam_type(F.col("t")), t="your KYC and CVV") == "otp_account_takeover"
    assert one(spark, signals.scam_type(F.col("t"), F.lit("amazon")), t="hello") == "courier_customs"
    hits = signals.lexical_hits(F.col("t"))
    t = "CBI police: do not tell anyone, transfer money with your OTP"
    assert one(spark, signals.stage_progress(hits), t=t) == pytest.approx(5 / 6)
    for k, patterns in signals.LEXICAL_TACTICS.items():
        assert one(spark, hits[k], t=t) == sum(len(re.findall(p, t, re.I)) for p in patterns)


def test_risk_row(spark):
    df = spark.createDataFrame([("CBI: send to ab@upi\nNow 12",)], "t string").select("t", entities.extract(F.col("t")).alias("e"))
    row = signals.risk_features(F.col("t"), F.lit(0.5), F.col("e"))
    assert len(row) == 30
    got = df.select(*(v.alias(k) for k, v in row.items())).first()
    assert got.log_lines == pytest.approx(math.log1p(2)) and got.log_tokens == pytest.approx(math.log1p(6)) and got.entity_upi_id == pytest.approx(1 / 3)
    assert got.digit_share == pytest.approx(2 / 21)


def test_numbers(spark):
    low, high = numeric.wilson(F.lit(5), F.lit(50))
    assert one(spark, low) == pytest.approx(0.0434749, abs=1e-6) and one(spark, high) == pytest.approx(0.2136022, abs=1e-6)
    assert one(spark, numeric.wilson(F.lit(0), F.lit(0))[0]) is None
    assert one(spark, numeric.ratio(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, numeric.logit(F.lit(0.0))) == pytest.approx(math.log(1e-6 / (1 - 1e-6)))


def test_edit_rates(spark):
    rows = [("one two three", "one too three"), ("cat", "cut"), ("", ""), ("", "x"), ("a b a", "b a a b")]
    df = spark.createDataFrame(rows, "r string, h string")
    got = [tuple(x) for x in df.select(*(v.alias(k) for k, v in metrics.edit_rates(df, "r", "h").items())).collect()]
    assert got[0][0] == pytest.approx(1 / 3) and got[1][1] == pytest.approx(1 / 3) and got[2] == (0.0, 0.0) and got[3] == (1.0, 1.0)
    assert got[4][0] == 1.0


def test_reply_turns(spark):
    reply = 'Sure:\n```json\n{"turns": [{"speaker_role": "caller", "text": "hi", "stage": "contact", "tactics": []}]}\n```'
    assert [r.text for r in one(spark, text.reply_turns(F.col("t")), t=reply)] == ["hi"]
