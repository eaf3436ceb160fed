"""Hand-off events and sessions, on tables and on streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parley.streaming import handoff

EVENT = "event_id string, conversation_id string, issued_at timestamp, scam_score double, threshold double, detector_status string, production_eligible boolean, decision_source string, is_scam boolean"
NOW = dt.datetime(2024, 1, 1, 12, 0, 0)


def events(spark, *ages):
    return spark.createDataFrame([(f"e{i}", "c", NOW - dt.timedelta(seconds=a), 0.9, 0.5, "eligible", True, "base", True) for i, a in enumerate(ages)], EVENT)


def test_verify(spark):
    now = F.lit(NOW).cast("timestamp")
    signed = handoff.sign(events(spark, 0, 600, -120), "secret")
    assert [r.rejected for r in handoff.verify(signed, "secret", now).orderBy("event_id").collect()] == [None, "stale", "future"]
    fresh = signed.where("event_id = 'e0'")
    reason = lambda df, key="secret": handoff.verify(df, key, now).first().rejected
    assert reason(fresh, "other") == "forged"
    assert reason(fresh.withColumn("scam_score", F.lit(0.1))) == "forged"
    assert reason(fresh.withColumn("is_scam", F.lit(False))) == "forged"
    assert reason(fresh.withColumn("signature", F.lit(None).cast("string"))) == "unsigned"
    with pytest.raises(ValueError):
        handoff.sign(fresh, "")


def test_gate(spark):
    row = events(spark, 0)
    mode = lambda df, **p: tuple(df.select(handoff.gate(handoff.Policy(**p)).alias("g")).first().g)
    research = row.withColumn("production_eligible", F.lit(False))
    assert mode(row.withColumn("is_scam", F.lit(False)), enabled=True) == (False, "blocked", "detector_did_not_flag_scam")
    assert mode(row, enabled=True, minimum_scam_score=0.95) == (False, "blocked", "scam_score_below_minimum")
    assert mode(row) == (False, "blocked", "honeypot_disabled_by_policy")
    assert mode(row, research_mode=True) == (True, "research_only", "operator_enabled_research_mode")
    assert mode(research, enabled=True) == (False, "blocked", "detector_is_research_only")
    assert mode(research, enabled=True, research_mode=True) == (True, "research_only", "detector_not_promoted_research_mode")
    assert mode(row, enabled=True) == (True, "live", None)


def test_recommendation(spark):
    df = spark.createDataFrame([(False, True), (True, False), (True, True)], "d boolean, e boolean")
    why = lambda on: [r.x.blocked_reason for r in df.select(handoff.recommendation(F.col("d"), F.col("e"), on).alias("x")).collect()]
    assert why(True) == ["detector_did_not_cross_threshold", "detector_is_research_only", None]
    assert why(False)[2] == "handoff_disabled_by_policy"


def drain(df, name, checkpoint, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_admitted_stream_drops_replays(spark, tmp_path):
    now = F.lit(NOW).cast("timestamp")
    signed = handoff.sign(events(spark, 0, 10, 600), "secret")
    signed.unionByName(signed.limit(2)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(signed.schema).parquet(str(tmp_path / "in"))
    out = drain(handoff.admitted(stream, "secret", handoff.Policy(enabled=True), now), "admitted", str(tmp_path / "cp"))
    assert sorted(r.event_id for r in out.collect()) == ["e0", "e1"]


def test_sessions(spark, tmp_path):
    at = lambda s: NOW + dt.timedelta(seconds=s)
    rows = [("a", at(0), False), ("a", at(1), False), ("a", at(2), False), ("b", at(0), True), ("b", at(1), False), ("c", at(0), False), ("c", at(4000), False)]
    df = spark.createDataFrame(rows, "conversation_id string, at timestamp, disengage boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = drain(handoff.sessions(stream, handoff.Policy(maximum_turns=2)), "answered", str(tmp_path / "cp"))
    got = sorted((r.conversation_id, r.answered, r.reason or "") for r in out.collect())
    assert got == [("a", False, "maximum_turns_reached"), ("a", True, ""), ("a", True, ""), ("b", False, "disengaged"), ("b", True, ""), ("c", False, "maximum_session_time_reached"), ("c", True, "")]


def test_latch(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.9), ("a", 2, 0.1)], "conversation_id string, turn int, score double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = drain(handoff.latched(stream, 0.5), "latched", str(tmp_path / "cp"))
    assert [r.latched for r in out.orderBy("turn").collect()] == [False, True, True]


def test_append_unseen(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    for _ in range(2):
        handoff.append_unseen(df, f"file://{tmp_path}/t", "k")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 2


def test_identity_and_redaction(spark):
    multiply, permute = handoff.dihedral_tables()
    check = handoff.identity_check(F.col("d"), multiply, permute)
    got = {r.d: r.c for r in spark.createDataFrame([("2363",), ("2364",)], "d string").select("d", check.alias("c")).collect()}
    assert got["2363"] == 0 and got["2364"] != 0
    df = spark.createDataFrame([("call +91 98765 43210 or +91 01234 56789, id me@invalid",)], "t string")
    assert df.select(handoff.redact_output(F.col("t"), ["+91 01234 56789"]).alias("x")).first().x == "call [REDACTED_PHONE] or +91 01234 56789, id me@invalid"
    made = spark.createDataFrame([("Asha Rao", "seed"), ("Asha Rao", "seed"), ("Asha Rao", "other")], "n string, s string").select(handoff.synthetic_identity(F.col("n"), F.col("s")).alias("i"))
    rows = [r.i for r in made.collect()]
    assert rows[0] == rows[1] != rows[2] and rows[0].upi.startswith("asha.") and rows[0].upi.endswith("@invalid") and rows[0].account.startswith("0000")
    sums = made.select(handoff.identity_check(F.replace("i.identity", F.lit(" "), F.lit("")), multiply, permute).alias("c")).collect()
    assert all(r.c != 0 for r in sums)
