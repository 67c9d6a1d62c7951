"""Test inputs derived by Spark from the given tables (see FIXTURES.md).

Every frame here is a projection of ``documents``, ``labels``, ``embeddings`` or ``events``, so the work of
each registered query grows with those tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PLACEHOLDER_MARKERS
from ..operators.positions import attach_positions
from ..sources.tables import Tables
from ..targets import N_FOLDS, TARGETS

# Fixed values of the fixture definitions (FIXTURES.md §2).
TARGET_PQ = [(7, 3), (11, 5), (13, 7), (17, 11), (19, 13), (23, 17)]
FIXTURE_MODELS = [("model2", 37, 10), ("model17", 53, 8), ("model21", 71, 6), ("exp02_fb3", 89, 9)]
MODEL_IDS = [m for m, _, _ in FIXTURE_MODELS]
GAPPY_MODEL, GAP_MOD = "exp02_fb3", 97
MODEL_WEIGHTS = [0.4, 0.3, 0.2, 0.1]
DIRTY_MOJIBAKE = "Ã©"
DIRTY_PUNCT = "a,b!(c)-d  e"


def scale(c: int) -> float:
    """``c`` thousandths, parsed the way the SQL literal ``<c>e-3`` is."""
    return float(f"{c}e-3")


def text_id_of(doc_id) -> F.Column:
    return F.concat(F.lit("T"), F.lpad(doc_id.cast("string"), 11, "0"))


def essays(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    cols = [F.lit(1.0) + F.lit(0.5) * ((d * p + F.floor(d / q)) % 9) for p, q in TARGET_PQ]
    return t.documents.select(
        "doc_id", text_id_of(d).alias("text_id"), F.col("text").alias("full_text"),
        *[c.alias(name) for c, name in zip(cols, TARGETS)],
        (d % 5).cast("int").alias("fold"))


def known_ids(t: Tables) -> DataFrame:
    """Ids of the labelled (current) population."""
    return t.labels.select(text_id_of(F.col("doc_id")).alias("text_id"))


def current_population(t: Tables) -> DataFrame:
    return essays(t).join(t.labels.select("doc_id"), "doc_id", "left_semi")


def previous_population(t: Tables) -> DataFrame:
    return essays(t).select("doc_id", "text_id", "full_text")


def _model_array():
    return F.array(*[F.struct(F.lit(m).alias("model_id"), F.lit(a).cast("long").alias("a"),
                              F.lit(scale(c)).alias("c")) for m, a, c in FIXTURE_MODELS])


def _long_preds(base: DataFrame, fold_model_col: F.Column | None, models: list[str] | None) -> DataFrame:
    d = F.col("doc_id")
    rows = base.withColumn("_m", F.explode(_model_array()))
    if models is not None:
        rows = rows.filter(F.col("_m.model_id").isin(models))
    rows = rows.filter(~((F.col("_m.model_id") == GAPPY_MODEL) & (d % GAP_MOD == 0)))
    k_term = F.lit(0).cast("long") if fold_model_col is None else F.lit(7) * fold_model_col
    preds = [F.struct(F.lit(t).alias("target"),
                      (F.col(t) + ((d * F.col("_m.a") + F.lit(31 * j) + k_term) % 201 - 100) * F.col("_m.c"))
                      .alias("pred"))
             for j, t in enumerate(TARGETS)]
    return rows.withColumn("_p", F.explode(F.array(*preds)))


def oof_long(t: Tables, models: list[str] | None = None) -> DataFrame:
    """Out-of-fold predictions: each essay scored once, by the model of its own fold."""
    rows = _long_preds(essays(t), None, models)
    return rows.select(F.col("_m.model_id").alias("model_id"), "fold", "text_id",
                       F.col("_p.target").alias("target"), F.col("_p.pred").alias("pred"))


def oof_wide(t: Tables, model_id: str) -> DataFrame:
    """One model's OOF file as the reference wrote it: ids, fold, true targets and ``pred_<target>``."""
    e = essays(t)
    d = F.col("doc_id")
    _, a, c = next(m for m in FIXTURE_MODELS if m[0] == model_id)
    preds = [(F.col(tn) + ((d * a + 31 * j) % 201 - 100) * F.lit(scale(c))).alias(f"pred_{tn}")
             for j, tn in enumerate(TARGETS)]
    out = e.select("text_id", "full_text", "fold", *TARGETS, *preds, "doc_id")
    if model_id == GAPPY_MODEL:
        out = out.filter(d % GAP_MOD != 0)
    return out.drop("doc_id")


def pseudo_long(population: DataFrame, models: list[str] | None = None, n_folds: int = N_FOLDS) -> DataFrame:
    """Pseudo-label predictions of every fold model k for every row of ``population`` (needs doc_id, targets)."""
    base = population.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    rows = _long_preds(base, F.col("_k").cast("long"), models)
    return rows.select(F.col("_m.model_id").alias("model_id"), F.col("_k").cast("int").alias("fold"), "text_id",
                       F.col("_p.target").alias("target"), F.col("_p.pred").alias("pred"))


def modelwise_weights(spark: SparkSession, ensemble_id: str = "fixture_modelwise") -> DataFrame:
    rows = [(ensemble_id, m, t, w) for m, w in zip(MODEL_IDS, MODEL_WEIGHTS) for t in TARGETS]
    return spark.createDataFrame(rows, "ensemble_id string, model_id string, target string, w double")


def columnwise_weights(spark: SparkSession, ensemble_id: str = "fixture_columnwise") -> DataFrame:
    n = len(MODEL_IDS)
    rows = [(ensemble_id, m, t, MODEL_WEIGHTS[(i + j) % n]) for i, m in enumerate(MODEL_IDS)
            for j, t in enumerate(TARGETS)]
    return spark.createDataFrame(rows, "ensemble_id string, model_id string, target string, w double")


def dirty_text(t: Tables) -> DataFrame:
    """Essays with the placeholder literals, a mojibake pair and punctuation appended by doc id."""
    d = F.col("doc_id")
    ph = F.array(*[F.lit(k) for k, _ in PLACEHOLDER_MARKERS])
    extra = F.concat(
        F.lit(" "), F.element_at(ph, (d % 16 + 1).cast("int")),
        F.when(d % 11 == 0, F.lit(" " + DIRTY_MOJIBAKE)).otherwise(F.lit("")),
        F.when(d % 13 == 0, F.lit(" " + DIRTY_PUNCT)).otherwise(F.lit("")))
    return essays(t).select("doc_id", "text_id", F.concat(F.col("full_text"), extra).alias("full_text"))


def metric_log(t: Tables) -> DataFrame:
    """Training-metric rows: run = user, fold = event_id % 5, step = order of (ts, event_id) within the run."""
    ev = t.events.select(F.col("user_id").alias("run_id"), "event_id", "ts",
                         (F.col("event_id") % 5).cast("int").alias("fold"),
                         F.col("value").alias("loss"), (F.lit(1) + F.col("event_id") % 6).cast("int").alias("n"))
    ev = attach_positions(ev, ["ts", "event_id"], ["run_id"], pos_col="_p")
    return ev.withColumn("step", (F.col("_p") + 1).cast("long")).drop("_p")


def token_vectors(t: Tables, positions: bool = True) -> DataFrame:
    """tokens(doc_id, layer, mask, vec, and pos if asked for) from ``embeddings``."""
    e = t.embeddings.select(F.col("label").cast("long").alias("doc_id"), "vec_id",
                            (F.col("vec_id") % 13).cast("int").alias("layer"),
                            F.when(F.col("vec_id") % 7 != 0, 1).otherwise(0).cast("int").alias("mask"),
                            F.col("embedding").alias("vec"))
    if not positions:
        return e
    # the scan for positions carries keys only; the vectors are joined back by id
    pos = attach_positions(e.select("doc_id", "layer", "vec_id"), ["vec_id"], ["doc_id", "layer"], pos_col="pos")
    return e.join(pos.select("vec_id", F.col("pos").cast("int").alias("pos")), "vec_id")


def closed_form_score(text, fold, j: int):
    """The fixture scorer: 1 + ((length(text) + 13 fold + 7 j) % 41) / 10."""
    return F.lit(1.0) + ((F.length(text) + F.lit(13) * fold + F.lit(7 * j)) % 41) / F.lit(10.0)


class ClosedFormScorer:
    """Deterministic stand-in model: 1 + ((len(text) + 13·fold + 7·j + offset) % 41) / 10 for target j."""

    def __init__(self, offset: int = 0):
        self.offset = offset

    def __call__(self):
        offset = self.offset

        def score(pdf):
            n = pdf["text"].fillna("").str.len().to_numpy(dtype=np.int64)
            k = pdf["fold_model"].to_numpy(dtype=np.int64)
            j = np.arange(len(TARGETS), dtype=np.int64)
            return 1.0 + ((n[:, None] + 13 * k[:, None] + 7 * j[None, :] + offset) % 41) / 10.0
        return score
