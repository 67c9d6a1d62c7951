"""Several rounds of self-training that can be resumed (K5).

Round 0 fits the fold models on the labelled rows. Every later round adds the pseudo labels of the round before: the model of
fold k is fitted on the labelled rows of the other folds and on what the model of fold k (which never saw fold k either)
predicted for the unlabelled rows, so no label of a fold reaches the model that is scored on it. Rounds go on until the
cross-validated score gains less than ``least_gain``; the best round is returned.

State is tables in one folder: ``round=r/oof``, ``round=r/pseudo`` and ``round=r/score``. A stage whose table is complete (Spark's
success marker) is read, not computed, and an incomplete one is written anew, so a run that was stopped anywhere goes on
where it stopped, and running a finished folder again computes nothing. The features of the texts do not change from round to
round: the first stage that has to be computed writes them once, and fits and scorings of all rounds read them.

Defined results: unlabelled rows whose id is labelled are left out; without unlabelled rows the rounds are all alike and the second
ends the run; null texts are empty; pseudo labels are clipped to the range of the scores.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..targets import N_FOLDS, TARGETS, clip_score
from . import scoring


@dataclass(frozen=True)
class Round:
    number: int
    mcrmse: float
    path: str

    def oof(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/oof")

    def pseudo(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/pseudo")


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def cross_validated(oof: DataFrame, labelled: DataFrame, id_col: str) -> DataFrame:
    """(mcrmse): mean over the targets of the RMSE of the out-of-fold predictions; rows without a label do not count for it."""
    rows = oof.join(labelled.select(id_col, *TARGETS), id_col)
    error = [F.sqrt(F.avg(F.pow(F.col(f"pred_{t}") - F.nanvl(F.col(t).cast("double"), F.lit(None).cast("double")), F.lit(2.0)))) for t in TARGETS]
    return rows.agg((sum(error[1:], error[0]) / len(TARGETS)).alias("mcrmse"))


def self_training(spark: SparkSession, labelled: DataFrame, unlabelled: DataFrame, root: str, most_rounds: int = 10,
                  least_gain: float = 1e-4, pseudo_weight: float = 0.5, id_col: str = "text_id", text_col: str = "full_text",
                  n_folds: int = N_FOLDS, num_features: int = 1024, reg: float = 1.0,
                  done: Callable[[int, str], None] = lambda number, stage: None) -> tuple[Round, list[Round], bool]:
    """(best round, all rounds, whether the gain ended the run rather than ``most_rounds``).

    ``labelled``: id, text, fold, targets; ``unlabelled``: id, text. ``done(round, stage)`` is called after each stage that was
    computed.
    """
    rest = unlabelled.select(id_col, text_col).join(labelled.select(id_col), id_col, "left_anti")
    own = labelled.select(id_col, text_col, "fold", *TARGETS).withColumn("_weight", F.lit(1.0))
    tokens: list[DataFrame] = []

    def tokenized() -> list[DataFrame]:
        """The labelled and the unlabelled rows with their features, found once for all rounds."""
        if not tokens:
            tokens.extend(scoring.tokenized(df, text_col, num_features) for df in (own, rest))
        return tokens
    rounds: list[Round] = []
    for number in range(most_rounds):
        path = f"{root.rstrip('/')}/round={number}"

        def stage(name: str, make: Callable[[], DataFrame], number=number, path=path) -> DataFrame:
            if not is_complete(spark, f"{path}/{name}"):
                make().write.mode("overwrite").parquet(f"{path}/{name}")
                done(number, name)
            return spark.read.parquet(f"{path}/{name}")

        before = rounds[-1] if rounds else None
        fitted: list = []

        def fit(before=before, fitted=fitted) -> tuple[DataFrame, DataFrame]:
            if not fitted:                                  # both tables of a round come from one fit
                mine, others = tokenized()
                extra = before and before.pseudo(spark).join(others, id_col).withColumn("_weight", F.lit(pseudo_weight))
                fitted.append(scoring.fold_fit_oof(mine, n_folds, id_col, text_col, num_features, reg, "_weight", extra,
                                                   "fold_model" if extra is not None else None, others))
            return fitted[0]
        oof = stage("oof", lambda: fit()[0])
        stage("pseudo", lambda: fit()[1].select(id_col, "fold_model", *[clip_score(F.col(f"pred_{t}")).alias(t) for t in TARGETS]))
        score = stage("score", lambda: cross_validated(oof, own, id_col)).first()["mcrmse"]
        if score is None:
            raise ValueError("no labelled row has a fold and a label of every target")
        rounds.append(Round(number, score, path))
        if number and rounds[-2].mcrmse - score < least_gain:
            return min(rounds, key=lambda r: (r.mcrmse, r.number)), rounds, True
    return min(rounds, key=lambda r: (r.mcrmse, r.number)), rounds, False
