"""Distributed batch scoring and fold-wise model fitting (K1–K5).

A *scorer factory* is a picklable callable returning ``score(pdf) -> ndarray[n, 6]`` for a pandas batch with
columns ``text`` and ``fold_model``. ``mapInPandas`` calls the factory once per task (load the model once),
then feeds Arrow batches; rows are sorted by length inside each partition first, so batches pad little,
without a global sort. Every text is sent to Python once: the fold models (and, for a registry, the models) are
looped over inside the batch, and fold means are taken there, so nothing is fanned out or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin
from ..targets import N_FOLDS, TARGETS
from . import ridge

ScorerFactory = Callable[[], Callable[[pd.DataFrame], np.ndarray]]
# Features in place of a text, see ``tokenized``.
TOKENS = "_places"
MODES = ("oofs", "prev_pseudolabels", "curr_pseudolabels", "submission")


def score_batch(rows: DataFrame, factory: ScorerFactory, id_col: str = "text_id", text_col: str = "full_text",
                fold_model_col: str = "fold_model", extra: list[str] | None = None,
                fold_models: list[int] | None = None, mean: bool = False) -> DataFrame:
    """K1: score each row with the fold model named in ``fold_model_col``, or with every one of ``fold_models``; wide
    output, one column per target; ``mean`` averages over the fold models."""
    return score_registry(rows, {"": factory}, id_col, text_col, fold_model_col, extra, fold_models, mean).drop("model_id")


def score_registry(rows: DataFrame, registry: dict[str, ScorerFactory], id_col: str = "text_id",
                   text_col: str = "full_text", fold_model_col: str = "fold_model", extra: list[str] | None = None,
                   fold_models: list[int] | None = None, mean: bool = False) -> DataFrame:
    """K3: every named factory scores every row (each with its fold models) while the row's batch is in memory.

    Models are loaded one at a time per batch order but kept for the task; rows come out as ``(model_id, id, fold_model,
    targets..., extra...)``, without ``fold_model`` when ``mean``.
    """
    extra = extra or []
    own = F.col(fold_model_col).cast("int") if fold_models is None else F.lit(0)
    src = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), own.alias("fold_model"), *extra)
    src = src.sortWithinPartitions(F.length("text"), "id")
    extra_fields = [f for f in src.schema.fields if f.name in extra]
    schema = "model_id string, id string, " + ("" if mean else "fold_model int, ") + ", ".join(f"{t} double" for t in TARGETS)
    for f in extra_fields:
        schema += f", {f.name} {f.dataType.simpleString()}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = {name: factory() for name, factory in registry.items()}

        def frame(name, pdf, preds, fold):
            out = pd.DataFrame(preds, columns=TARGETS)
            if not mean:
                out.insert(0, "fold_model", fold)
            out.insert(0, "id", pdf["id"].to_numpy())
            out.insert(0, "model_id", name)
            for f in extra_fields:
                out[f.name] = pdf[f.name].to_numpy()
            return out
        for pdf in batches:
            for name, score in models.items():
                if fold_models is None:
                    yield frame(name, pdf, np.asarray(score(pdf), dtype=np.float64), pdf["fold_model"].to_numpy())
                    continue
                total = 0.0
                for k in fold_models:
                    preds = np.asarray(score(pdf.assign(fold_model=np.int32(k))), dtype=np.float64)
                    if mean:
                        total = total + preds
                    else:
                        yield frame(name, pdf, preds, np.full(len(pdf), k, dtype="int32"))
                if mean:
                    yield frame(name, pdf, total / len(fold_models), None)

    return src.mapInPandas(run, schema).withColumnRenamed("id", id_col)


def score_mode(mode: str, labelled: DataFrame, factory: ScorerFactory, previous: DataFrame | None = None,
               test: DataFrame | None = None, id_col: str = "text_id", n_folds: int = N_FOLDS) -> DataFrame:
    """K2: the four inference modes.

    * ``oofs``: each labelled row by the model of its own (stored) fold;
    * ``prev_pseudolabels``: previous data minus labelled ids, by all K models;
    * ``curr_pseudolabels``: labelled data by all K models;
    * ``submission``: test rows by all K models, averaged over folds inside the batch.
    """
    folds = list(range(n_folds))
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; expected one of {MODES}")
    if mode == "oofs":
        return score_batch(labelled.withColumn("fold_model", F.col("fold")), factory, id_col)
    if mode == "prev_pseudolabels":
        if previous is None:
            raise ValueError("prev_pseudolabels needs the previous table")
        rows = previous.join(labelled.select(id_col), id_col, "left_anti")
        return score_batch(rows, factory, id_col, fold_models=folds)
    if mode == "curr_pseudolabels":
        return score_batch(labelled, factory, id_col, fold_models=folds)
    if test is None:
        raise ValueError("submission needs the test table")
    return score_batch(test, factory, id_col, fold_models=folds, mean=True)


def registry_scoring(population: DataFrame, registry: dict[str, ScorerFactory], id_col: str = "text_id",
                     n_folds: int = N_FOLDS) -> DataFrame:
    """K3: score a population with every registered model and all its fold models in one pass; fold means."""
    return score_registry(population, registry, id_col, fold_models=list(range(n_folds)), mean=True)


def training_rows(labelled: DataFrame, k: int, extra: DataFrame | None = None,
                  extra_fold_col: str | None = None) -> DataFrame:
    """Rows that the model of fold ``k`` may see: labelled rows of other folds, and extra rows (of its own fold model)."""
    train = labelled.filter(~F.col("fold").eqNullSafe(F.lit(k)))
    if extra is None:
        return train
    extra = extra if extra_fold_col is None else extra.filter(F.col(extra_fold_col) == k)
    cols = [c for c in train.columns if c in extra.columns]
    return train.select(*cols).unionByName(extra.select(*cols))


def tokenized(df: DataFrame, text_col: str = "full_text", num_features: int = 1024) -> DataFrame:
    """``df`` with the features of its text (column ``TOKENS``) instead of the text, written once: a table that several fits or
    scorings use need not be tokenized for each."""
    return pin(df.withColumn(TOKENS, ridge.term_places(F.col(text_col), num_features)).drop(text_col))


def fold_fit_oof(labelled: DataFrame, n_folds: int = N_FOLDS, id_col: str = "text_id", text_col: str = "full_text",
                 num_features: int = 1024, reg: float = 1.0, weight_col: str | None = None,
                 extra_train: DataFrame | None = None, extra_fold_col: str | None = None,
                 score_also: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """K4: the model of fold k is fitted on the labelled rows with fold ≠ k (plus the ``extra_train`` rows, those with
    ``extra_fold_col == k`` when given) and predicts the rows of fold k. One pass gives the moments of every fold; see ``ridge``.

    Returns (OOF predictions ``(id, fold, pred_<t>...)``, predictions of every fold model on ``score_also``
    as ``(id, fold_model, pred_<t>...)`` or None). Tables may come ``tokenized`` with the same ``num_features``.
    """
    def features(df: DataFrame, *more: Column) -> DataFrame:
        places = F.col(TOKENS) if TOKENS in df.columns else ridge.term_places(F.col(text_col), num_features)
        return df.select(F.col(id_col), places.alias("places"), *more)

    def training(df: DataFrame, grp: Column) -> list[Column]:
        w = F.col(weight_col).cast("double") if weight_col and weight_col in df.columns else F.lit(1.0)
        y = F.array(*[F.coalesce(F.col(t).cast("double"), F.lit(float("nan"))) for t in TARGETS])
        return [grp.alias("grp"), y.alias("y"), w.alias("w")]
    # tokens are found once: the moments and the predictions read the written places
    def numbered(name: str, col: str) -> Column:
        return F.concat(F.lit(name), F.coalesce(F.col(col).cast("int").cast("string"), F.lit(" none")))
    own = features(labelled, F.col("fold"), *training(labelled, numbered("fold", "fold")))
    own = own if TOKENS in labelled.columns else pin(own)
    rows = own.select("grp", "places", "y", "w")
    if extra_train is not None:
        grp = F.lit("extra") if extra_fold_col is None else numbered("extra", extra_fold_col)
        rows = rows.unionByName(features(extra_train, *training(extra_train, grp)).select("grp", "places", "y", "w"))
    found = ridge.moments(rows, num_features)
    names = set(found.docs)
    models = []
    for k in range(n_folds):
        train = [g for g in names if not g.startswith("extra") and g != f"fold{k}"] + [g for g in names if g in ("extra", f"extra{k}")]
        models.append(found.fit(sorted(train), reg))
    oof = ridge.predict(own, models, id_col, "fold")
    return oof, None if score_also is None else ridge.predict(features(score_also), models, id_col, shown="fold_model")
