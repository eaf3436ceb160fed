"""Validated loads, multi-task labels, batch detection and reports."""

import pytest
from pyspark.sql import functions as F

from parley import schema
from parley.operators import detect, loaders, multitask, reports
from parley.sources import paged

EXTERNAL = "record_id string, conversation_id string, text string, language string, source_group string, rights_basis string, label int, pii_redacted boolean, split string, source_url string"


def external(spark, n=100, **change):
    rows = [[f"r{i}", f"c{i}", "hello there", "en", "g", "consent", i % 2, True, "external_evaluation", f"url-{i // 2}"] for i in range(n)]
    names = [x.split()[0] for x in EXTERNAL.split(", ")]
    for k, v in change.items():
        rows[0][names.index(k)] = v
    return spark.createDataFrame(rows, EXTERNAL)


def test_external_records(spark):
    assert loaders.external_records(external(spark)).count() == 100
    for change, fault in (({"label": 2}, "bad_label"), ({"pii_redacted": False}, "not_redacted"), ({"text": " "}, "text_missing"), ({"record_id": "r1"}, "duplicate_record_id"), ({"rights_basis": ""}, "rights_basis_missing"), ({"split": "train"}, "bad_split")):
        with pytest.raises(ValueError, match=fault):
            loaders.external_records(external(spark, **change))
    with pytest.raises(ValueError, match="empty"):
        loaders.external_records(external(spark).limit(0))
    rows = loaders.external_as_examples(external(spark, 2), F.lit("test")).orderBy("label").collect()
    assert rows[0].text == "[ROLE=caller] hello there" and rows[1].scam_type == "external"


def test_partition_external(spark):
    parts = loaders.partition_external(external(spark))
    by_url = parts.groupBy("source_url").agg(F.count_distinct("split").alias("n"))
    assert by_url.where("n > 1").isEmpty() and parts.select("split").distinct().count() == 3
    again = loaders.partition_external(external(spark).orderBy(F.desc("record_id")))
    assert again.exceptAll(parts).isEmpty()
    with pytest.raises(ValueError):
        loaders.partition_external(parts, 0.9, 0.2)


def test_project_and_audio(spark):
    ok = spark.createDataFrame([("a", " pay  now", 1, "train", "en", None), ("b", "hi", 0, "validation", None, 2.0)], "id string, text string, label int, split string, language string, weight double")
    assert [(r.text, r.sample_weight, r.languages) for r in loaders.project_examples(ok).orderBy("conversation_id").collect()] == [("[ROLE=caller] pay now", 1.0, ["en"]), ("[ROLE=caller] hi", 2.0, ["unknown"])]
    audio = external(spark, 2, split="audio_validation").withColumn("split", F.lit("audio_validation")).withColumn("reference_text", F.lit("x"))
    assert loaders.audio_records(audio.withColumn("audio_path", F.lit("a/../b.wav"))).count() == 2
    for path, fault in (("/etc/x", "absolute_path"), ("a/../../x", "path_escapes"), ("", "audio_path_missing")):
        with pytest.raises(ValueError, match=fault):
            loaders.audio_records(audio.withColumn("audio_path", F.lit(path)))
    with pytest.raises(ValueError, match="both labels"):
        loaders.audio_records(audio.where("label = 1").withColumn("audio_path", F.lit("b.wav")))
    files = spark.createDataFrame([("a.wav", 10), ("b.exe", 10), ("c.wav", 0), ("d.wav", 99)], "path string, length long")
    assert [r.fault for r in loaders.audio_file_faults(files, ["wav"], 50).orderBy("path").collect()] == [None, "bad_extension", "empty_file", "too_large"]


def test_distinct_transcripts(spark):
    df = spark.createDataFrame([(2, "Hello  THERE"), (1, "hello there"), (3, "bye")], "row int, text string")
    assert sorted(r.row for r in loaders.distinct_transcripts(df, ["row"]).collect()) == [1, 3]


TURNS = "array<struct<speaker_role:string,raw_text:string,normalized_text:string,labels:struct<tactics:map<string,int>,stage:string>>>"


def test_multitask(spark):
    tactics = ["fear_intimidation", "urgency_scarcity"]
    said = [("caller", "a", "a", ({"fear_threat": 1, "urgency": 0}, "threat")), ("caller", " ", "", ({}, None)), ("victim", "b", "b", ({}, "odd"))]
    df = spark.createDataFrame([(said, 1), (said[2:], 1), ([], 0)], f"turns {TURNS}, y int").select("y", multitask.turn_records(F.col("turns"), tactics, schema.STAGES).alias("r"))
    got = [r.l for r in df.select(multitask.conversation_labels(F.col("r"), F.col("y"), schema.STAGES, 0.25).alias("l")).collect()]
    assert (got[0].tactic_labels, got[0].tactic_mask, got[0].stage, got[0].stage_mask) == ([1.0, 0.0], [1.0, 0.25], "threat", 1.0)
    assert (got[1].tactic_mask, got[1].stage_mask) == ([0.0, 0.0], 0.0)
    assert (got[2].stage, got[2].stage_mask) == ("none_unknown", 1.0)
    reply = spark.createDataFrame([([("Caller", "x", "threat", ["urgency", "odd"]), ("", " ", None, None), ("?", "y", "odd", None), (None, "z", None, None)],)], "t array<struct<speaker_role:string,text:string,stage:string,tactics:array<string>>>")
    made = reply.select(multitask.generated_turns(F.col("t"), F.lit(1), F.lit("other_scam"), schema.STAGES, schema.TACTICS, "generated").alias("x")).first().x
    assert [(t.turn_id, t.speaker_role, t.labels.stage) for t in made] == [(0, "caller", "threat"), (1, "caller", "contact"), (2, "callee", "contact")]
    assert made[0].labels.tactics == {"urgency": 1}


def test_detect(spark):
    rows = [("c1", [("caller", "CBI here pay now to ab@upi")]), ("c2", [("caller", " ")]), ("c3", [])]
    df = spark.createDataFrame(rows, "conversation_id string, turns array<struct<speaker_role:string,text:string>>")
    score = lambda d: d.withColumn("score", F.when(F.contains("text", F.lit("CBI")), 0.9).otherwise(0.1))
    got = {r.conversation_id: r for r in detect.detect(df, score, 0.5).collect()}
    assert got["c1"].is_scam and got["c1"].handoff.blocked_reason == "detector_is_research_only" and got["c1"].decision_source == "base_detector"
    assert {e.entity_type for e in got["c1"].entities} == {"authority_organisation", "upi_id"} and "ab@upi" not in str(got["c1"].entities)
    assert (got["c2"].refused, got["c3"].refused) == ("empty_turn", "no_turns") and got["c2"].is_scam is None
    fuse = lambda d: d.withColumn("score", F.lit(0.2))
    one = df.limit(1)
    off = detect.detect(one, score, 0.5, fusion=(fuse, 0.4, "research_only")).first()
    on = detect.detect(one, score, 0.5, detect.Policy(detector_status="eligible", enable_handoff=True, allow_research_fusion=True), (fuse, 0.4, "research_only")).first()
    assert off.decision_source == "base_detector" and off.is_scam and on.decision_source == "risk_fusion" and not on.is_scam
    live = detect.detect(one, score, 0.5, detect.Policy(detector_status="eligible", enable_handoff=True)).first()
    assert live.handoff.handoff and live.handoff.blocked_reason is None


def test_patterns_and_promotion(spark):
    df = spark.createDataFrame([(1, "pay", 2.0), (1, "the", 9.0), (1, "otp", 3.0), (1, "bye", -1.0), (1, "pay", 1.0)], "id long, pattern string, contribution double")
    assert detect.top_patterns(df, "id").first().patterns == ["otp", "pay"]
    got = spark.range(1).select(detect.promoted(F.lit(0.04), F.lit(0.9), F.lit(0.8), F.lit(None).cast("boolean"), 0.05).alias("p")).first().p
    assert got.fpr_within_cap and not got.gold_available and got.status == "research_only"


def test_reports(spark):
    m = spark.createDataFrame([("a", "train"), ("b", "test")], "conversation_id string, split string")
    bad = reports.manifest_agreement(m, spark.createDataFrame([("a", "test"), ("c", "test")], m.schema)).collect()
    assert {r.conversation_id for r in bad} == {"a", "b", "c"}
    backends = spark.createDataFrame([("x", 0.9, 5), ("y", 0.9, 3)], "name string, recall double, ms int")
    assert reports.best_by(backends, ["recall", -F.col("ms")]).first().name == "y"
    df = spark.createDataFrame([("1", "train", ["a", "b"], ["x", "y"]), ("2", "train", ["b"], ["x"])], "dialogue_id string, original_split string, services array<string>, turns array<string>")
    r = reports.archive_profile(df).first()
    assert (r.dialogues, r.turns, r.services) == (2, 3, 2)


def test_pages(spark):
    data = [{"i": i} for i in range(25)]
    fails = []

    def fetch(offset, length):
        if not fails:
            fails.append(1)
            raise OSError("again")
        return data[offset : offset + length]

    got = paged.read_pages(spark, paged.with_retries(fetch), 25, 10, "i long")
    assert sorted(r.i for r in got.collect()) == list(range(25))
    with pytest.raises(KeyError):
        paged.with_retries(lambda o, n: {}["x"], fatal=(KeyError,))(0, 1)
