"""Literal cases of dedup, metrics, thresholds, sequences, samples, views and gates."""

import pytest
from pyspark.sql import functions as F

from parley import schema
from parley.operators import dedup, gates, graph, ingest, metrics, ml, sampling, sequence, thresholds, views


def scored(spark, labels, scores, **more):
    rows = [(i, int(y), float(s), *(v[i] for v in more.values())) for i, (y, s) in enumerate(zip(labels, scores))]
    extra = "".join(f", {k} string" for k in more)
    return spark.createDataFrame(rows, "id long, label int, score double" + extra)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (102, 100)], "a long, b long")
    got = {r.node: r.root for r in graph.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    hub = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert graph.connected_components(hub).where("root = 0").count() == 3000
    assert graph.connected_components(edges.limit(0)).count() == 0


def test_near_pairs_broadcast_no_side(spark):
    df = spark.range(1000).select("id", F.lit("s").alias("source"), F.xxhash64("id").alias("fp"))
    plan = dedup.near_pairs(df, ["source"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_near_pairs_are_complete(spark):
    import random

    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 8))) for b in base for _ in range(20)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(i, None if i % 2 else "s", f) for i, f in enumerate(signed)], "id long, source string, fp long")
    reps = {}
    for i, f in enumerate(fps):
        reps.setdefault((i % 2, f), i)
    want = {(a, b) for (x, f), a in reps.items() for (y, g), b in reps.items() if x == y and a < b and (f ^ g).bit_count() <= 6}
    pairs = dedup.near_pairs(df, ["source"])
    assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) > 100
    groups = dedup.groups_of(df, pairs, ["source"])
    assert groups.count() == len(fps)
    assert dedup.group_hash(groups).agg(F.sum("n")).first()[0] == len(fps)


def test_simhash_groups_templates(spark):
    texts = ["please pay 100 immediately to the safe account of the court today", "please pay 500 immediately to the safe account of the court today"]
    a, b = (r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(dedup.simhash64(F.regexp_replace("t", "[0-9]+", "[number]")).alias("v")).collect())
    assert (a ^ b) == 0


def test_binary_metrics(spark):
    r = metrics.binary_metrics(scored(spark, [1], [0.9]), 0.5).first()
    assert r.recall == 1 and r.balanced_accuracy is None and r.mcc is None
    assert metrics.roc_auc(scored(spark, [1], [0.9])).first().roc_auc is None
    assert metrics.roc_auc(scored(spark, [0, 1, 0, 1], [0.5] * 4)).first().roc_auc == 0.5
    assert metrics.average_precision(scored(spark, [0, 1, 1], [0.2, 0.9, 0.1])).first().pr_auc == pytest.approx((1 + 2 / 3) / 2)


def test_seed_summary(spark):
    r = metrics.seed_summary(spark.createDataFrame([("a", 0.7), ("a", 0.8), ("a", 0.9), ("b", 0.5)], "k string, v double"), "v", ["k"]).orderBy("k").collect()
    assert r[0]["mean"] == pytest.approx(0.8) and r[0].sd == pytest.approx(0.1) and r[1].sd == 0


def test_thresholds(spark):
    r = thresholds.at_fpr(scored(spark, [0, 0, 0, 0, 1, 1], [0.1, 0.2, 0.3, 0.6, 0.7, 0.8]), 0.0).first()
    assert (r.threshold, r.fpr, r.recall) == (0.7, 0.0, 1.0)
    r = thresholds.by_f_beta(scored(spark, [0, 0, 1, 1], [0.1, 0.8, 0.7, 0.9]), 2, 0.6).first()
    assert r.satisfied and r.precision >= 0.6
    r = thresholds.by_f1(scored(spark, [0, 0, 1, 1], [0.1, 0.3, 0.7, 0.9])).first()
    assert r.f1 == 1.0 and 0.3 < r.threshold <= 0.7
    tied = thresholds.at_fpr(scored(spark, [0, 1, 0, 1], [0.5] * 4), 0.1).first()
    assert tied.recall == 0 and tied.threshold == 1.0
    rows = scored(spark, [0, 0, 0, 0, 1, 1], [0.1, 0.2, 0.3, 0.6, 0.7, 0.8], seed=["s"] * 6)
    assert thresholds.shared_bound(rows, 0.25, 4, ["seed"]).first().bound == 0.3


def prefix_rows(spark, scores, roles=None):
    roles = roles or ["caller"] * len(scores)
    return spark.createDataFrame([(1, i + 1, r, float(s)) for i, (s, r) in enumerate(zip(scores, roles))], "conv_id long, size long, role string, score double")


def test_stable_and_early_detection(spark):
    stable = lambda s, *x, **k: sequence.stable_turn(prefix_rows(spark, s, **k), *x).first()
    assert stable([0.2, 0.8, 0.3, 0.75, 0.7], 0.7, 0.5).stable_turn == 4
    assert stable([0.8, 0.2], 0.7, 0.5).stable_turn is None
    assert stable([0.1, 0.2, 0.9], 0.8, 0.6, roles=["caller", "victim", "caller"]).caller_turn == 2
    got = {r.fraction: r for r in sequence.early_detection(prefix_rows(spark, [0.1, 0.9]), 0.5, (0.5, 1.0)).collect()}
    assert (got[0.5].latched_rate, got[1.0].latched_rate) == (0, 1)
    got = {r.fraction: r for r in sequence.early_detection(prefix_rows(spark, [0.9, 0.1]), 0.5, (0.5, 1.0)).collect()}
    assert (got[0.5].latched_rate, got[1.0].latched_rate, got[1.0].point_rate) == (1, 1, 0)
    assert sequence.first_detection(prefix_rows(spark, [0.1, 0.9]), 0.5).first().first_fraction == 1.0
    s = sequence.detection_summary(spark.createDataFrame([(1,), (2,), (None,), (3,)], "stable_turn long")).first()
    assert s.median_turn == 2.0 and s.undetected_rate == 0.25


def test_windows(spark):
    turns = spark.createDataFrame([(1, i, f"t{i}") for i in range(4)] + [(2, 0, "x")], "conv_id long, turn long, t string")
    got = sorted((r.conv_id, r.size, r.text) for r in sequence.prefix_windows(turns, F.col("t")).collect())
    assert [(c, s) for c, s, _ in got] == [(1, 1), (1, 2), (1, 4), (2, 1)] and got[1][2] == "t0\nt1"
    labels = spark.createDataFrame([(1, 0, None, "contact"), (1, 1, 1, "authority_claim"), (1, 2, 0, "contact")], "conv_id long, turn long, urgency int, stage string")
    out = [(r.urgency, r.stage) for r in sequence.prefix_labels(labels, ["urgency"], schema.STAGES[:-1]).orderBy("size").collect()]
    assert out == [(None, "contact"), (1, "authority_claim"), (1, "authority_claim")]
    assert sequence.gaps(spark.createDataFrame([(1, 0), (1, 2)], "conv_id long, turn long")).count() == 1


def test_supervision(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (None, 1), (None, 0)], "v int, y int")
    label, mask = sequence.supervision(F.col("v"), F.col("y"), 0.25)
    assert [tuple(r) for r in df.select(label, mask).collect()] == [(1.0, 1.0), (0.0, 0.25), (0.0, 0.0), (0.0, 1.0)]


def test_samples(spark):
    df = spark.createDataFrame([(i, s, y) for i, (s, y) in enumerate([("a", 0)] * 4 + [("a", 1)] * 4 + [("b", 0)] * 5 + [("b", 1)] + [("c", 0)])], "id long, source string, label int")
    parts = sampling.halves(df, "id", ["source", "label"])
    got = {(r.source, r.label, r.part): r["count"] for r in parts.groupBy("source", "label", "part").count().collect()}
    assert got["a", 0, "calibration"] == got["a", 0, "threshold"] == 2 and got["b", 0, "calibration"] == 2
    assert parts.count() == df.count()
    mix = spark.createDataFrame([(i, "m", 1) for i in range(4)] + [(10 + i, "m", 0) for i in range(10)] + [(30 + i, f"n{i % 3}", 0) for i in range(20)], "id long, source string, label int")
    out = sampling.balanced_negatives(mix, "id", 1.0, 2.0).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in out} == {1: 4, 0: 8}
    assert sampling.first_n(df, "id", 2, ["source"]).count() == 5
    w = sampling.cell_weights(df.where("id in (0, 13)"))
    assert [r.weight for r in w.collect()] == [1.0, 1.0]
    y = spark.createDataFrame([(0, 1.0), (0, 0.75), (0, 1.0), (1, 0.75)], "label int, base double")
    weights = [r.weight for r in sampling.class_weights(y, "label", F.col("base"), 3.0).orderBy("label", "base").collect()]
    assert weights[3] > weights[0] and weights[3] <= 2.25


def test_training_rows(spark):
    df = spark.createDataFrame([("c1", True, "gold", 0, "x"), ("c2", True, "silver", 1, "x"), ("c3", False, "gold", 1, "x"), ("c4", True, "bad", 1, "x"), ("c5", True, "gold", None, "x"), ("c6", True, "gold", 1, " "), ("c7", True, "gold", 1, "x")], "conversation_id string, training_eligible boolean, provenance string, label int, text string")
    splits = spark.createDataFrame([(f"c{i}", "train") for i in range(1, 7)], "conversation_id string, split string")
    rows, counts = views.training_rows(df, splits, ["gold", "silver"], {"silver": 0.75})
    assert sorted((r.conversation_id, r.sample_weight) for r in rows.collect()) == [("c1", 1.0), ("c2", 0.75)]
    assert {r.reason: r.n for r in counts.collect()} == {None: 2, "missing_split": 1, "not_training_eligible": 1, "disallowed_provenance": 1, "missing_binary_label": 1, "empty_text": 1}
    assert spark.createDataFrame([("my bank OTP",), ("embankment",)], "t string").where(views.overlaps_risk(F.col("t"))).count() == 1


def test_ingest(spark):
    calls = spark.createDataFrame([(0, "caller: CBI here, pay now receiver: who?", "1", "bank_kyc"), (1, "caller: CBI here, pay now receiver: who?", "1", "bank_kyc"), (2, "caller: hello", "0", "x")], "row int, text string, label string, scam_category string")
    df = ingest.with_quality(ingest.fingerprinted(ingest.union_sources([ingest.from_labelled_calls(calls)])))
    rows = {r.ordinal.row: r for r in df.collect()}
    assert rows["0"].training_eligible and rows["0"].duplicate_of is None
    assert rows["1"].duplicate_of == rows["0"].conversation_id and rows["1"].exclusion_reasons == ["exact_duplicate"]
    t = rows["0"].turns
    assert [x.turn_id for x in t] == [0, 1] and t[0].labels.provenance == "weak_rule" and t[1].labels.provenance == "unlabeled"
    assert t[0].labels.tactics["authority_impersonation"] == 1 and t[0].labels.tactics["secrecy"] is None
    assert rows["2"].turns[0].labels.tactics["secrecy"] == 0 and rows["2"].conversation_label.scam_type == "non_scam"
    assert ingest.flat_turns(df).count() == 5
    broken = df.withColumn("turns", F.filter("turns", lambda x: x["turn_id"] > 0)).select(ingest.validation_errors().alias("e"))
    assert {tuple(r.e) for r in broken.collect()} == {("noncontiguous_turns",), ("no_turns",)}
    said = spark.createDataFrame([(0, "hi __eou__ yo __eou__")], "row int, value string")
    assert ingest.from_utterances(said).first().turns[1].speaker_role == "speaker_b"


def test_gates(spark):
    notes = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 1), (3, "a", 1), (3, "b", 0), (4, "a", 1), (4, "b", 0)], "id long, who string, v int")
    got = {r.id: r.status for r in gates.consensus(notes, spark.createDataFrame([(4,)], "id long"), "id", "who", ["v"]).collect()}
    assert got == {1: "agreed", 2: "needs_annotators", 3: "needs_adjudication", 4: "adjudicated"}
    checks = spark.createDataFrame([('{"a":{"b":1}}', "$.a.b", "1"), ('{"a":{"b":2}}', "$.a.b", "1"), ("{}", "$.a", "1")], "payload string, path string, expected string")
    got = [(r.status, r.detail) for r in gates.json_checks(checks).collect()]
    assert got == [("passed", None), ("failed", "got 2"), ("failed", "missing JSON path")]
    assert tuple(gates.roll_up(gates.json_checks(checks)).first()) == (1, 2, 0)
    a, b = (spark.createDataFrame([(x,) for x in xs], "v int") for xs in ([1, 2, 2], [2, 3]))
    assert sorted(tuple(r) for r in gates.set_difference(a, b).collect()) == [(1, "left"), (2, "left"), (3, "right")]
    note = spark.createDataFrame([("x", 1, False, ["urgency", "odd"], [("urgency", 0, "t")])], "annotator_id string, is_scam int, llm_used boolean, tactics array<string>, evidence_spans array<struct<tactic:string,turn_id:int,text:string>>")
    assert note.select(gates.annotation_errors(schema.TACTICS).alias("e")).first().e == ["unknown_tactic", "tactic_without_evidence"]
    intake = spark.createDataFrame([(True, False, False, "lab", ["en"], [("a", "x")])], "consent_confirmed boolean, pii_redacted boolean, llm_generated boolean, collection_channel string, language_profile array<string>, turns array<struct<speaker_role:string,text:string>>")
    assert intake.select(gates.intake_errors(["lab"], 2).alias("e")).first().e == ["not_redacted", "too_few_turns"]


def test_multiclass(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "truth int, predicted int")
    report = metrics.multiclass_report(df, spark.range(3).select(F.col("id").cast("int").alias("class")))
    assert {r["class"]: round(r.f1, 4) for r in report.collect()} == {0: 0.6667, 1: 0.6667, 2: 0.0}
    assert metrics.multiclass_summary(report).first().macro_f1 == pytest.approx(4 / 9)


def test_calibration(spark):
    df = scored(spark, [0, 0, 1, 1], [0.05, 0.2, 0.8, 0.95])
    p = [r.p for r in df.select(ml.platt(df)(F.col("score")).alias("p")).collect()]
    assert all(0 <= x <= 1 for x in p) and p == sorted(p)
    iso = [r.calibrated for r in ml.calibrated_isotonic(ml.isotonic(df), df).orderBy("id").collect()]
    assert iso == [0.0, 0.0, 1.0, 1.0]


def test_family_and_probabilities(spark):
    sgd = {"name": "sgd", "recall": 0.80, "recall_sd": 0.02, "latency": 3, "macro_f1": 0.9, "bytes": 1}
    xgb = {"name": "xgboost", "recall": 0.81, "recall_sd": 0.02, "latency": 2, "macro_f1": 0.9, "bytes": 2}
    assert ml.choose_family([sgd, xgb]) == "xgboost" and ml.choose_family([xgb, {**sgd, "recall": 0.9}]) == "sgd"
    df = spark.createDataFrame([([0.25, 0.75],)], "p array<double>")
    got = df.select(ml.class_probabilities(F.col("p"), [0, 2], 3).alias("a"), ml.class_probabilities(F.col("p"), [1, 3], 4).alias("b")).first()
    assert got.a == [0.25, 0.0, 0.75] and got.b == [0.0, 0.25, 0.0, 0.75]
    head = df.select(ml.head_outputs({"kind": (F.col("p"), ["x", "y"], None), "tags": (F.col("p"), ["u", "v"], 0.5), "none": (F.lit(None).cast("array<double>"), ["a", "b"], None)}).alias("h")).first().h
    assert head.kind.label == "y" and [t.label for t in head.tags] == ["v"] and head.none is None


def test_text_classifier(spark):
    rows = [(i, f"please pay now urgent {i % 7}" if i % 2 else f"lovely weather today friend {i % 5}", i % 2, "s" + str(i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, label int, source string")

    def fit(train):
        features = ml.fit_tfidf(train, 200)
        model = ml.linear().fit(features(train))
        return lambda rows: ml.positive_score(model.transform(features(rows))).select("id", "label", "score")

    out = ml.out_of_fold(df, "id", fit, 2)
    assert out.count() == 40 and metrics.roc_auc(out).first().roc_auc == 1.0
    vec = ml.fit_tfidf(df, 200)(df).first().features
    assert vec.norm(2) == pytest.approx(1.0)
    grams = df.limit(1).select(ml.char_ngrams(F.lit("ab cd"), (3,)).alias("g")).first().g
    assert grams == [" ab", "ab ", " cd", "cd "]


def test_detector_runs(spark, tmp_path):
    rows = [(i, f"please pay now urgent {i % 7}" if i % 2 else f"lovely weather today friend {i % 5}", i % 2, "s" + str(i % 2 + i % 4 // 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, label int, source string")
    fit = lambda rows: ml.fit_detector(rows, 100)
    scored_rows = fit(df)(df)
    assert set(scored_rows.columns) == {"id", "text", "label", "source", "score"}
    reduced = ml.truncated_svd(ml.fit_tfidf(df, 100)(df), 3)(ml.fit_tfidf(df, 100)(df)).first().reduced
    assert len(reduced) == 3
    assert ml.ablate(df, ["s1"], {"b": fit, "a": fit}) == "a"
    out = ml.calibrate_and_select(scored_rows, scored_rows, 0.05, 5, ["source"])
    assert out["method"] in ("none", "platt") and 0 <= out["bound"] <= 1
    ml.save_run(spark, str(tmp_path / "run"), None, {"scores": scored_rows}, {"threshold": 0.5})
    assert '"threshold": 0.5' in spark.read.text(str(tmp_path / "run" / "facts")).first().value


def test_frozen_set(spark):
    person = "conversation_id string, consent_confirmed boolean, pii_redacted boolean, llm_generated boolean, collection_channel string, language_profile array<string>, turns array<struct<speaker_role:string,text:string>>"
    said = lambda x: [("caller", f"Hello {x}"), ("victim", "yes")]
    intake = spark.createDataFrame([(c, True, True, False, "lab", ["en"], said(c)) for c in ("ok", "one", "split", "judged", "leak")], person)
    note = "conversation_id string, annotator_id string, is_scam int, scam_type string, tactics array<string>, stage string, llm_used boolean, evidence_spans array<struct<tactic:string,turn_id:int,text:string>>"
    notes = [(c, a, y, "x", ["urgency"], "threat", False, [("urgency", 0, "t")]) for c, a, y in (("ok", "a", 1), ("ok", "b", 1), ("one", "a", 1), ("split", "a", 1), ("split", "b", 0), ("judged", "a", 1), ("judged", "b", 0), ("leak", "a", 1), ("leak", "b", 1))]
    from parley.operators.loaders import transcript

    known = intake.where("conversation_id = 'leak'").select(F.sha2(transcript(F.col("turns")), 256).alias("transcript_sha256"))
    out = gates.frozen_set(intake, spark.createDataFrame(notes, note), spark.createDataFrame([("judged",)], "conversation_id string"), known, ["lab"], schema.TACTICS)
    assert {r.conversation_id: r.errors for r in out.collect()} == {"ok": [], "one": ["needs_annotators"], "split": ["needs_adjudication"], "judged": [], "leak": ["leaks"]}


def test_ranks_of_a_hot_group(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 50).cast("string"))).alias("source"))
    got = sampling.with_rank(df, "id", ["source"]).select("id", "source", "rank", "_r")
    want = got.withColumn("w", F.expr("row_number() over (partition by source order by _r, id)"))
    assert want.where("w <> rank").isEmpty() and want.count() == 3000


def test_a_hub_is_split(spark):
    """The join of a round, planned for small partitions, splits the hub's."""
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        pairs = spark.range(100_000).select((F.col("id") + 1).alias("u"), F.lit(0).cast("long").alias("v"))
        large = graph.least_of_neighbours(pairs).groupBy().count()
        assert large.collect()[0][0] == 100_000 and "skew=true" in large._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in small:
            spark.conf.unset(k)


def test_forests_connect_what_pairs_connect(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) for b in base for _ in range(40)]
    rows = [(i, x - (1 << 64) if x >> 63 else x, None if i % 3 == 0 else "s") for i, x in enumerate(f & (2**64 - 1) for f in fps)]
    df = spark.createDataFrame(rows, "id long, fp long, source string")
    pairs, links = dedup.near_pairs(df, ["source"]), dedup.near_links(df, ["source"])
    roots = lambda e: {(r.node, r.root) for r in graph.connected_components(e.select("a", "b")).collect()}
    assert roots(pairs) == roots(links) and links.distinct().count() <= pairs.count()
