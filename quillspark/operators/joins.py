"""Key joins of the training-data side (E1–E10, F1–F5): merges, membership filters, audits, assembly.

Membership tests are semi/anti joins (broadcast hash joins when the id side is small, shuffled otherwise —
AQE decides at run time); row alignment is never positional, always by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..targets import TARGETS, clip_score


def merged_predictions(truth: DataFrame, predictions: DataFrame, models: list[str], id_col: str = "text_id",
                       targets: list[str] | None = None) -> DataFrame:
    """The wide ``pred_<target>_<model>`` table, built with one pivot and one left join. A cell that a model predicted twice is
    NULL: neither prediction is preferred."""
    targets = targets or TARGETS
    names = [f"pred_{t}_{m}" for m in models for t in targets]
    keyed = predictions.withColumn("_k", F.concat(F.lit("pred_"), F.col("target"), F.lit("_"), F.col("model_id")))
    wide = keyed.groupBy(id_col).pivot("_k", names).agg(F.when(F.count("pred") == 1, F.max("pred")))
    return truth.join(wide, id_col, "left")


def drop_known_ids(df: DataFrame, known: DataFrame, id_col: str = "text_id") -> DataFrame:
    """Rows whose id is not in ``known`` (anti join)."""
    return df.join(known.select(id_col), id_col, "left_anti")


def flag_known_ids(df: DataFrame, known: DataFrame, id_col: str = "text_id", flag: str = "in_fb3") -> DataFrame:
    """E2 flag form: left join on the distinct known ids."""
    k = known.select(id_col).distinct().withColumn(flag, F.lit(True))
    return df.join(k, id_col, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def restrict_population(df: DataFrame, population: DataFrame, id_col: str = "text_id",
                        flag: str = "in_fb3") -> DataFrame:
    """Keep rows whose id is in the population and not flagged (ids absent from it drop out too)."""
    keep = population.filter(~F.col(flag)).select(id_col)
    return df.join(keep, id_col, "left_semi")


def alignment_audit(pred_ids: DataFrame, population: DataFrame, id_col: str = "text_id",
                    by: list[str] | None = None) -> DataFrame:
    """Per prediction file (``by``, default model), rows, distinct ids, population ids without a
    prediction, extra ids, duplicates. ``pred_ids`` has ``(by..., id)``; it replaces the first/last-id
    sentinels of positional alignment."""
    by = by or ["model_id"]
    pop = population.select(id_col).distinct()
    n_pop = pop.select(F.count(F.lit(1))).scalar()
    matched = pred_ids.join(pop, id_col, "left_semi").groupBy(*by).agg(
        F.count_distinct(id_col).alias("_matched"))
    per_model = pred_ids.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"),
                                         F.count_distinct(id_col).alias("n_ids"))
    out = per_model.join(matched, by, "left").fillna(0, ["_matched"])
    return out.select(*by, "n_rows", "n_ids",
                      (n_pop - F.col("_matched")).alias("n_missing"),
                      (F.col("n_ids") - F.col("_matched")).alias("n_extra"),
                      (F.col("n_rows") - F.col("n_ids")).alias("n_dup"))


def attach_text(df: DataFrame, texts: DataFrame, id_col: str = "text_id", text_col: str = "full_text") -> DataFrame:
    """E5: reattach the text by key (left join)."""
    return df.join(texts.select(id_col, text_col), id_col, "left")


def not_fold(fold_col: str, k: int) -> Column:
    """D4 training side: fold ≠ k where a missing fold counts as different (pandas NaN != k is True)."""
    return ~F.col(fold_col).eqNullSafe(F.lit(k))


def curr_pseudo_no_leak(pseudo_wide: DataFrame, train: DataFrame, k: int, id_col: str = "text_id") -> DataFrame:
    """Attach text and fold of the labelled table to current-data pseudo labels, drop validation fold k."""
    joined = pseudo_wide.join(train.select(id_col, "full_text", "fold"), id_col, "left")
    return joined.filter(not_fold("fold", k))


def submission(template: DataFrame, predictions_wide: DataFrame, id_col: str = "text_id",
               targets: list[str] | None = None) -> DataFrame:
    """Template keys win (left join); the template's own target columns are replaced."""
    targets = targets or TARGETS
    keys = template.select(id_col)
    return keys.join(predictions_wide.select(id_col, *targets), id_col, "left")


def average_labels(true_wide: DataFrame, pseudo_wide: DataFrame, id_col: str = "text_id",
                   targets: list[str] | None = None) -> DataFrame:
    """(true + pseudo) / 2 per target, by key; NULL where the pseudo label is missing."""
    targets = targets or TARGETS
    p = pseudo_wide.select(id_col, *[F.col(t).alias(f"_p_{t}") for t in targets])
    j = true_wide.select(id_col, *targets).join(p, id_col, "left")
    return j.select(id_col, *[((F.col(t) + F.col(f"_p_{t}")) / 2).alias(t) for t in targets])


def fold_splice(predictions: DataFrame, fold_source: dict[int, str]) -> DataFrame:
    """Per fold take the predictions of the chosen source model (broadcast map join)."""
    spark = predictions.sparkSession
    m = spark.createDataFrame([(int(k), v) for k, v in fold_source.items()], "fold int, model_id string")
    return predictions.join(F.broadcast(m), ["fold", "model_id"])


# --- set operations and training-set assembly ------------------------------------------------------------------

def union_widen(*frames: DataFrame) -> DataFrame:
    """union by name, missing columns become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def assemble_training_set(labelled: DataFrame, k: int, use_true: bool = True,
                          prev_pseudo: DataFrame | None = None, curr_pseudo: DataFrame | None = None,
                          id_col: str = "text_id", targets: list[str] | None = None) -> DataFrame:
    """training rows for validation fold ``k`` from up to three sources, labels clipped to [1, 5].

    * true rows: labelled essays with ``fold`` ≠ k (missing fold kept);
    * previous-data pseudo rows: ids present in the labelled table removed (anti join);
    * current-data pseudo rows: text and fold attached from the labelled table, fold ≠ k (NULL kept).
    A ``provenance`` column records the source of each row.
    """
    targets = targets or TARGETS
    cols = [id_col, "full_text", "fold", *targets, "provenance"]
    parts = []
    if use_true:
        parts.append(labelled.filter(not_fold("fold", k)).withColumn("provenance", F.lit("true")))
    if prev_pseudo is not None:
        p = drop_known_ids(prev_pseudo, labelled, id_col).drop("fold")
        parts.append(p.withColumn("provenance", F.lit("prev_pseudo")))
    if curr_pseudo is not None:
        cp = curr_pseudo.drop("full_text", "fold")
        parts.append(curr_pseudo_no_leak(cp, labelled, k, id_col).withColumn("provenance", F.lit("curr_pseudo")))
    if not parts:
        raise ValueError("no source selected")
    out = union_widen(*[p.select(*[c for c in cols if c in p.columns]) for p in parts])
    for c, typ in (("full_text", "string"), ("fold", "int")):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(typ))
    return out.select(*[clip_score(c).alias(c) if c in targets else F.col(c) for c in cols])


def assemble_track2(true_rows: DataFrame, pseudo_rows: DataFrame, k: int, mode: str) -> DataFrame:
    """``replace`` trains on the fold's pseudo rows only (pretraining), ``extend`` appends them."""
    if mode == "replace":
        return pseudo_rows.withColumn("provenance", F.lit("pseudo"))
    if mode == "extend":
        train = true_rows.filter(not_fold("fold", k)).withColumn("provenance", F.lit("true"))
        return union_widen(train, pseudo_rows.withColumn("provenance", F.lit("pseudo")))
    raise ValueError("mode must be 'replace' or 'extend'")


def leakage_report(train_rows: DataFrame, labelled: DataFrame, k: int, valid: str = "fold",
                   id_col: str = "text_id") -> DataFrame:
    """validation = fold k or the whole labelled table; flag ids that are in both train and valid."""
    if valid == "fold":
        v = labelled.filter(F.col("fold") == k)
    elif valid == "all":
        v = labelled
    else:
        raise ValueError("valid must be 'fold' or 'all'")
    tr = train_rows.select(id_col).distinct().withColumn("in_train", F.lit(True))
    va = v.select(id_col).distinct().withColumn("in_valid", F.lit(True))
    both = tr.join(va, id_col, "full_outer")
    return both.select(id_col, F.coalesce("in_train", F.lit(False)).alias("in_train"),
                       F.coalesce("in_valid", F.lit(False)).alias("in_valid"),
                       (F.coalesce("in_train", F.lit(False)) & F.coalesce("in_valid", F.lit(False))).alias("leak"))
