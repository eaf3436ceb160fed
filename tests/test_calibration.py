"""Calibration is chosen over seeds, by the FPR gate, recall and the Brier score."""

import pytest

from parley.operators import ml


def rows_of(spark, rows):
    return spark.createDataFrame([(s, y, "s0") for s, y, n in rows for _ in range(n)], "score double, label int, source string")


def test_recall_goes_before_brier_and_isotonic_takes_part(spark):
    fitted = rows_of(spark, [(0.1, 0, 5), (0.4, 1, 1), (0.45, 0, 1), (0.9, 1, 5)])
    chosen = rows_of(spark, [(0.1, 0, 9), (0.4, 0, 1), (0.45, 1, 5), (0.9, 1, 5)])
    alone = ml.select_calibration([(fitted, chosen)] * 2, 0.05, 5, ["source"], ("isotonic",))
    none = ml.select_calibration([(fitted, chosen)] * 2, 0.05, 5, ["source"], ("none",))
    assert alone["brier"] < none["brier"] and (alone["recall"], none["recall"]) == (0.5, 1.0)
    out = ml.select_calibration([(fitted, chosen)] * 2, 0.05, 5, ["source"])
    assert out["method"] != "isotonic" and out["recall"] == out["least_recall"] == 1.0
    plain = rows_of(spark, [(0.4, 0, 6), (0.6, 1, 6)])
    assert ml.select_calibration([(plain, plain)] * 2, 0.05, 5, ["source"])["method"] == "isotonic"


def test_every_seed_must_pass_the_gate(spark):
    good, bad = rows_of(spark, [(0.4, 0, 6), (0.6, 1, 6)]), rows_of(spark, [(1.0, 0, 6), (0.6, 1, 6)])
    with pytest.raises(RuntimeError):
        ml.select_calibration([(good, good), (bad, bad)], 0.05, 5, ["source"], ("none",))
    with pytest.raises(ValueError):
        ml.select_calibration([(good, good)], 0.05, 50, ["source"])
