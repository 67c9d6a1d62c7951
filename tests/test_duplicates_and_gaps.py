"""Duplicated predictions are nobody's choice, and a fold without every target has no cumulative score."""

from quillspark.operators import joins as J
from quillspark.operators import metrics as M
from quillspark.targets import TARGETS


def test_a_cell_predicted_twice_is_null(spark):
    truth = spark.createDataFrame([("a",), ("b",)], "text_id string")
    rows = [("m", "a", t, 1.0) for t in TARGETS] + [("m", "a", TARGETS[0], 2.0), ("m", "b", TARGETS[1], 3.0)]
    out = J.merged_predictions(truth, spark.createDataFrame(rows, "model_id string, text_id string, target string, pred double"), ["m"])
    got = {r["text_id"]: r for r in out.collect()}
    assert out.columns == ["text_id", *[f"pred_{t}_m" for t in TARGETS]]
    assert got["a"][f"pred_{TARGETS[0]}_m"] is None and got["a"][f"pred_{TARGETS[1]}_m"] == 1.0
    assert got["b"][f"pred_{TARGETS[0]}_m"] is None and got["b"][f"pred_{TARGETS[1]}_m"] == 3.0


def test_cumulative_score_needs_every_target(spark):
    rows = [("m", f, t, 2.0, 1.0) for f in (0, 1) for t in TARGETS if not (f == 1 and t == TARGETS[3])]
    scored = spark.createDataFrame(rows, "model_id string, fold int, target string, pred double, y double")
    assert {r["fold"]: r["cv"] for r in M.cumulative_cv(scored, ["model_id"]).collect()} == {0: 1.0, 1: None}
