"""Registered queries: scans, sinks and the prediction store (A keys, D7).

Each query writes what it needs under the shared checkpoint folder (never a machine-local temp dir), then
returns a DataFrame read back from it, so the write path and the read path are both exercised.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble as G
from ..operators import joins as J
from ..session import scratch_path
from ..sources import store as S
from ..sources.tables import ESSAY_SCHEMA, Tables, read_csv, read_prediction_dir, read_table, write_csv
from ..targets import TARGETS
from . import fixtures as fx
from .registry import register, rounded
from .sqlparts import essays_cte, long_oof_cte, long_pseudo_cte, current_cte

_T6 = ", ".join(f"round({t}, 6) AS {t}" for t in TARGETS)
OOF_SCHEMA = ("text_id string, full_text string, fold int, "
              + ", ".join(f"{t} double" for t in TARGETS) + ", "
              + ", ".join(f"pred_{t} double" for t in TARGETS))


@register("csv_roundtrip", sql=f"WITH {essays_cte()}\nSELECT text_id, full_text, {_T6} FROM essays")
def csv_roundtrip(spark, sf_dir):
    """A1: essays (multi-line texts, quotes) → CSV as pandas writes it → read back with an explicit schema."""
    e = fx.essays(Tables(spark, sf_dir)).select("text_id", "full_text", *TARGETS)
    path = scratch_path(spark, "essays-csv")
    write_csv(e, path)
    return rounded(read_csv(spark, path, ESSAY_SCHEMA))


@register("csv_mixed_headers", sql=f"WITH {essays_cte()}\nSELECT text_id, full_text, {_T6} FROM essays")
def csv_mixed_headers(spark, sf_dir):
    """A1: files of one folder with their own headers: as is, reversed behind an index column, and with forty more columns
    (some multi-line) in between; one read finds every field by the header of its file."""
    e = fx.essays(Tables(spark, sf_dir)).select("doc_id", "text_id", "full_text", *TARGETS)
    base = scratch_path(spark, "mixed-csv")
    own = ["text_id", "full_text", *TARGETS]
    more = [F.concat(F.lit(f"note {i}\n"), F.substring("full_text", 1, 5)).alias(f"note{i}") for i in range(40)]
    third = F.pmod(F.col("doc_id"), F.lit(3))
    write_csv(e.filter(third == 0).select(*own), f"{base}/plain.csv")
    write_csv(e.filter(third == 1).select(F.col("doc_id").alias(""), *reversed(own)), f"{base}/reversed.csv")
    write_csv(e.filter(third == 2).select("full_text", *more, *reversed(TARGETS), "text_id"), f"{base}/wide.csv")
    return rounded(read_csv(spark, f"{base}/*.csv", ESSAY_SCHEMA))


@register("format_dispatch", sql=f"WITH {essays_cte()}\nSELECT 'pq' AS fmt, text_id, round(cohesion, 6) AS cohesion "
          "FROM essays UNION ALL SELECT 'csv' AS fmt, text_id, round(cohesion, 6) AS cohesion FROM essays")
def format_dispatch(spark, sf_dir):
    """A2: the same table stored as ``.pq`` and as CSV, both read through ``read_table``."""
    e = fx.essays(Tables(spark, sf_dir)).select("text_id", "full_text", *TARGETS)
    base = scratch_path(spark, "dispatch")
    e.write.parquet(f"{base}/train.pq")
    write_csv(e, f"{base}/train.csv")
    pq = read_table(spark, f"{base}/train.pq").select(F.lit("pq").alias("fmt"), "text_id", "cohesion")
    csv = read_table(spark, f"{base}/train.csv", ESSAY_SCHEMA).select(F.lit("csv").alias("fmt"), "text_id",
                                                                      "cohesion")
    return rounded(pq.unionByName(csv))


def _oof_dir(spark, sf_dir) -> str:
    """One CSV per model, in the three kinds that occur in one folder: true targets plus ``pred_*``, the same with an
    unnamed index column, and target-named predictions in another column order."""
    t = Tables(spark, sf_dir)
    base = scratch_path(spark, "oofs")
    for i, m in enumerate(fx.MODEL_IDS):
        wide = fx.oof_wide(t, m)
        if i % 3 == 1:
            wide = wide.select(F.xxhash64("text_id").alias(""), *wide.columns)
        elif i % 3 == 2:
            wide = wide.select(*[F.col(f"pred_{c}").alias(c) for c in reversed(TARGETS)], "text_id", "full_text")
        write_csv(wide, f"{base}/{m}.csv")
    return base


_OOF_LONG_SQL = f"WITH {essays_cte()},\n{long_oof_cte()}\n"


@register("oof_dir_scan", sql=_OOF_LONG_SQL + "SELECT model_id, text_id, target, round(pred, 6) AS pred FROM oof")
def oof_dir_scan(spark, sf_dir):
    """A3 + E9: one glob scan of the folder; model id from the file name; normalised to the long layout."""
    wide = read_prediction_dir(spark, f"{_oof_dir(spark, sf_dir)}/*.csv")
    return rounded(S.to_long(wide, ["model_id", "text_id"]))


@register("ban_models", sql=_OOF_LONG_SQL + "SELECT model_id, text_id, target, round(pred, 6) AS pred FROM oof "
          "WHERE model_id NOT IN ('model17')")
def ban_models(spark, sf_dir):
    wide = read_prediction_dir(spark, f"{_oof_dir(spark, sf_dir)}/*.csv", banned_models=["model17"])
    return rounded(S.to_long(wide, ["model_id", "text_id"]))


@register("pseudo_store", sql=f"WITH {essays_cte()},\n{current_cte()},\n{long_pseudo_cte('pl', 'curr')}\n"
          "SELECT model_id, fold, text_id, target, round(pred, 6) AS pred FROM pl")
def pseudo_store(spark, sf_dir):
    """A5: pseudo labels of every (model, fold model) written as partitions, then one pruned scan."""
    t = Tables(spark, sf_dir)
    root = scratch_path(spark, "store")
    pl = fx.pseudo_long(fx.current_population(t).select("doc_id", "text_id", *TARGETS))
    S.write_predictions(pl, root, "curr")
    out = S.read_predictions(spark, root, split="curr")
    return rounded(out.select("model_id", "fold", "text_id", "target", "pred"))


def _oof_store(spark, sf_dir) -> str:
    root = scratch_path(spark, "store")
    S.write_predictions(fx.oof_long(Tables(spark, sf_dir)), root, "oof")
    return root


@register("oof_store", sql=_OOF_LONG_SQL + "SELECT model_id, fold, text_id, target, round(pred, 6) AS pred FROM oof")
def oof_store(spark, sf_dir):
    out = S.read_predictions(spark, _oof_store(spark, sf_dir), split="oof")
    return rounded(out.select("model_id", "fold", "text_id", "target", "pred"))


@register("fold_subset", sql=_OOF_LONG_SQL + "SELECT model_id, text_id, target, round(pred, 6) AS pred FROM oof "
          "WHERE fold = 2")
def fold_subset(spark, sf_dir):
    """Only fold 2 is read (partition pruning on the store's ``fold`` folder)."""
    out = S.read_predictions(spark, _oof_store(spark, sf_dir), split="oof", folds=[2])
    return rounded(out.select("model_id", "text_id", "target", "pred"))


@register("latest_run", sql=_OOF_LONG_SQL + "SELECT 'oof' AS split, 'model21' AS model_id, fold, text_id, target, "
          "round(pred, 6) AS pred, cast(2 AS bigint) AS run_ts FROM oof WHERE model_id = 'model2'")
def latest_run(spark, sf_dir):
    """Two runs of 'model21' kept side by side (run_ts 1 and 2); the latest view returns run 2."""
    t = Tables(spark, sf_dir)
    root = scratch_path(spark, "runs")
    oof = fx.oof_long(t)
    run1 = oof.filter(F.col("model_id") == "model21")
    run2 = oof.filter(F.col("model_id") == "model2").withColumn("model_id", F.lit("model21"))
    for run_ts, df in ((1, run1), (2, run2)):
        S.write_predictions(df, root, "oof", run_ts)
    out = S.latest_run(S.read_predictions(spark, root, split="oof"))
    return rounded(out.select("split", "model_id", "fold", "text_id", "target", "pred", "run_ts"))


@register("submission", sql=f"""WITH {essays_cte()},
test AS (SELECT * FROM essays WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
{long_pseudo_cte('pl', 'test', ['exp02_fb3'])},
fm AS (SELECT text_id, target, avg(pred) AS pred FROM pl GROUP BY text_id, target HAVING count(*) = 5)
SELECT t.text_id, """ + ", ".join(f"round(max(CASE WHEN fm.target = '{c}' THEN fm.pred END), 6) AS {c}"
                                  for c in TARGETS) + """
FROM test t LEFT JOIN fm ON fm.text_id = t.text_id GROUP BY t.text_id""")
def submission(spark, sf_dir):
    """A7 + E7 + G5: fold-mean predictions left-joined onto the template, written as one CSV, read back."""
    t = Tables(spark, sf_dir)
    template = J.drop_known_ids(fx.essays(t), fx.known_ids(t))
    pl = fx.pseudo_long(template.select("doc_id", "text_id", *TARGETS), ["exp02_fb3"])
    wide = G.fold_mean(pl, ["text_id"]).groupBy("text_id").pivot("target", TARGETS).agg(F.first("pred"))
    sub = J.submission(template, wide)
    path = scratch_path(spark, "submission")
    write_csv(sub, path)
    schema = "text_id string, " + ", ".join(f"{c} double" for c in TARGETS)
    return rounded(read_csv(spark, path, schema))
