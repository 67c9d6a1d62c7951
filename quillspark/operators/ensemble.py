"""Blending predictions of many models.

One plan for every variant: long predictions ``(keys..., model_id, target, pred)`` ⋈ broadcast weights
``(model_id, target, w)`` → one hash aggregate on the keys that emits the six targets as columns. No per-model
merges, no 6×M wide frame. A prediction missing for any weighted model makes that cell NULL (pandas NaN·w is
NaN even for w = 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..targets import TARGETS, clip_score

# Weight tables are parameters (models × targets); they are broadcast and read on the driver only below this.
MAX_WEIGHT_ROWS = 100_000


def collect_small(df: DataFrame, limit: int = MAX_WEIGHT_ROWS) -> list:
    """Collect a parameter-sized table, refusing anything that is not provably small."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"table has more than {limit} rows; it is not a parameter table")
    return rows


def weight_spec(weights: DataFrame, targets: list[str] | None = None) -> dict[str, tuple[int, float]]:
    """Per target: number of weighted models and the weight sum."""
    targets = targets or TARGETS
    rows = collect_small(weights.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("s")))
    spec = {r["target"]: (int(r["n"]), float(r["s"])) for r in rows}
    missing = [t for t in targets if t not in spec]
    if missing:
        raise ValueError(f"weights give no model for targets {missing}")
    return spec


def blend(predictions: DataFrame, weights: DataFrame, keys: list[str], targets: list[str] | None = None,
          normalise: bool = False, clip: bool = False, template: DataFrame | None = None) -> DataFrame:
    """Weighted sum per key and target, wide output ``(keys..., targets...)``.

    ``normalise`` divides by the weight sum of the target; ``clip`` applies the guarded [1, 5] clip;
    ``template`` (a frame with the key columns) fixes the output rows, as a left join.
    """
    targets = targets or TARGETS
    spec = weight_spec(weights, targets)
    w = F.broadcast(numbered(weights.select("model_id", "target", "w"), "target"))
    joined = predictions.join(w, ["model_id", "target"])
    aggs = []
    for t in targets:
        is_t = F.col("target") == t
        total = F.sum(F.when(is_t, F.col("w") * F.col("pred")))
        n_models, w_sum = spec[t]
        value = total / F.lit(w_sum) if normalise else total
        value = F.when(each_once(F.when(is_t & F.col("pred").isNotNull(), F.col("_no")), n_models), value)
        aggs.append((clip_score(value) if clip else value).alias(t))
    out = joined.groupBy(*keys).agg(*aggs)
    if template is not None:
        out = template.select(*keys).join(out, keys, "left")
    return out


def blend_stacked(predictions: DataFrame, weights: DataFrame, keys: list[str], targets: list[str] | None = None,
                  clip: bool = False) -> DataFrame:
    """Every (model, source column) may feed every target. Weights ``(target, model_id, source_target, w)``."""
    targets = targets or TARGETS
    n_terms = {r["target"]: int(r["n"]) for r in
               collect_small(weights.groupBy("target").agg(F.count(F.lit(1)).alias("n")))}
    w = F.broadcast(numbered(weights.select(F.col("model_id"), F.col("source_target").alias("_src"),
                                            F.col("target").alias("_dst"), "w"), "_dst"))
    joined = predictions.withColumnRenamed("target", "_src").join(w, ["model_id", "_src"])
    aggs = []
    for t in targets:
        is_t = F.col("_dst") == t
        value = F.when(each_once(F.when(is_t & F.col("pred").isNotNull(), F.col("_no")), n_terms.get(t, 0)),
                       F.sum(F.when(is_t, F.col("w") * F.col("pred"))))
        aggs.append((clip_score(value) if clip else value).alias(t))
    return joined.groupBy(*keys).agg(*aggs)


def numbered(weights: DataFrame, by: str) -> DataFrame:
    """The weight table (a parameter table, size-checked) with ``_no`` = 0, 1, ... per target."""
    rows = sorted(collect_small(weights), key=lambda r: [str(x) for x in r])
    seen: dict[str, int] = {}
    out = []
    for r in rows:
        out.append((*r, seen.get(r[by], 0)))
        seen[r[by]] = out[-1][-1] + 1
    return weights.sparkSession.createDataFrame(out, weights.schema.add("_no", "long"))


def each_once(number: Column, n: int) -> Column:
    """True if the non-null ``number`` values of a group are 0..n-1, each exactly once: n rows, and every number seen
    (one bit each in bitmaps of 63 numbers, which combine map-side)."""
    ok = F.count(number) == F.lit(n)
    for lo in range(0, n, 63):
        size = min(63, n - lo)
        inside = number.between(lo, lo + size - 1)
        bits = F.bit_or(F.when(inside, F.call_function("shiftleft", F.lit(1).cast("long"), (number - lo).cast("int"))))
        ok = ok & (F.coalesce(bits, F.lit(0)) == F.lit((1 << size) - 1))
    return ok


def fold_mean(predictions: DataFrame, keys: list[str], n_folds: int = 5, fold_col: str = "fold") -> DataFrame:
    """Mean over fold models; NULL unless each of the ``n_folds`` fold models scored the row exactly once."""
    scored = F.when(F.col("pred").isNotNull(), F.col(fold_col))
    return (predictions.groupBy(*keys, "target")
            .agg(F.when(each_once(scored, n_folds), F.avg("pred")).alias("pred")))


def clip_predictions(predictions: DataFrame, col: str = "pred") -> DataFrame:
    return predictions.withColumn(col, clip_score(col))


def inverse_error_weights(scores: DataFrame, score_col: str = "rmse") -> DataFrame:
    """weight = (1/score) / Σ_models (1/score), per target. Input is one row per (model, target)."""
    inv = F.lit(1.0) / F.col(score_col)
    return scores.select("model_id", "target", (inv / F.sum(inv).over(Window.partitionBy("target"))).alias("w"))


def weight_importance(weights: DataFrame) -> DataFrame:
    """Σ weight over targets per model, ascending (ties by model id)."""
    return (weights.groupBy("model_id").agg(F.sum("w").alias("importance"))
            .orderBy("importance", "model_id"))


def importance_over_runs(weights: DataFrame, run_col: str = "run") -> DataFrame:
    """Importance averaged over search runs: Σ_runs Σ_targets w / number of runs."""
    per_run = weights.groupBy(run_col, "model_id").agg(F.sum("w").alias("_imp"))
    n_runs = weights.select(F.count_distinct(run_col)).scalar()
    return (per_run.groupBy("model_id").agg((F.sum("_imp") / n_runs).alias("importance"))
            .orderBy("importance", "model_id"))


def weight_sums(weights: DataFrame) -> DataFrame:
    """Σw per target (audit: weights are not forced to sum to one)."""
    return weights.groupBy("target").agg(F.sum("w").alias("sum_w"))


CATALOG_COLUMNS = ["ensemble_id", "kind", "source", "destination", "fold_source", "model_id", "target", "w"]
KINDS = ("modelwise", "columnwise", "normalised")
FOLD_SOURCES = ("own", "zero")


def load_catalog(spark, path: str) -> DataFrame:
    """Named ensembles from a file (Parquet, or CSV with a header): weights are data, not code.

    Columns ``ensemble_id, kind, source, destination, fold_source, model_id, target, w``: the source population the
    ensemble reads, the name its output is stored under and where each fold's predictions come from. A row with a NULL
    target holds for every target (model-wise weights).
    """
    from ..sources.tables import read_table
    schema = "ensemble_id string, kind string, source string, destination string, fold_source string, model_id string, target string, w double"
    df = read_table(spark, path, schema)
    targets = F.when(F.col("target").isNull(), F.array(*[F.lit(t) for t in TARGETS])).otherwise(F.array("target"))
    return df.select(*CATALOG_COLUMNS).withColumn("target", F.explode(targets))


def run_catalog(catalog: DataFrame, ensemble_id: str, predictions: DataFrame, keys: list[str],
                template: DataFrame | None = None) -> DataFrame:
    """Dispatch a named ensemble. Catalogue rows ``(ensemble_id, kind, model_id, target, w)``.

    ``kind``: ``modelwise`` (plain weighted sum), ``columnwise`` (sum then clip), ``normalised`` (sum over the weight sum).
    Unknown ids are an error.
    """
    entry = catalog.filter(F.col("ensemble_id") == ensemble_id)
    kind = _single(entry, "kind", ensemble_id)
    if kind not in KINDS:
        raise ValueError(f"unknown ensemble kind {kind!r}")
    used = predictions.join(F.broadcast(entry.select("model_id").distinct()), "model_id", "left_semi")
    return blend(used, entry, keys, clip=(kind == "columnwise"), normalise=(kind == "normalised"), template=template)


def _single(entry: DataFrame, col: str, ensemble_id: str):
    found = [r[0] for r in collect_small(entry.select(col).distinct())]
    if not found:
        raise KeyError(f"unknown ensemble id {ensemble_id!r}")
    if len(found) > 1:
        raise ValueError(f"ensemble {ensemble_id!r} mixes {col} {found}")
    return found[0]


def route_catalog(catalog: DataFrame, ensemble_id: str, sources: dict[str, DataFrame], keys: list[str],
                  fold_col: str = "fold", n_folds: int = 5) -> DataFrame:
    """G9 with routing: blend the ensemble over the population its entry names; adds ``destination``.

    ``fold_source`` ``own`` blends every fold's predictions for that fold; ``zero`` feeds fold 0's to all folds (G3).
    """
    entry = catalog.filter(F.col("ensemble_id") == ensemble_id)
    source = _single(entry, "source", ensemble_id)
    if source not in sources:
        raise KeyError(f"ensemble {ensemble_id!r} reads unknown population {source!r}")
    preds = fold_source(sources[source], _single(entry, "fold_source", ensemble_id), fold_col, n_folds)
    return run_catalog(catalog, ensemble_id, preds, keys) \
        .withColumn("destination", F.lit(_single(entry, "destination", ensemble_id)))


def blend_catalog(catalog: DataFrame, sources: dict[str, DataFrame], keys: list[str], fold_col: str = "fold",
                  n_folds: int = 5) -> DataFrame:
    """All ensembles of a catalogue: ``(ensemble_id, destination, keys..., targets...)``.

    Every population is shuffled once, by the keys, whatever the number of ensembles: a prediction meets its model's weights
    in all ensembles in one broadcast row, each (key, target) group sums them side by side, and the sums are dealt out to
    ensembles and targets where they are. A single ensemble is a filter on the result. ``fold_col`` is one of the keys.
    The same rules hold as for one ensemble: each weighted model exactly once, else NULL; kinds; fold sources.
    """
    rows = [r.asDict() for r in collect_small(catalog)]
    spark = catalog.sparkSession
    entries: dict[str, dict] = {}
    for r in rows:
        facts = {c: r[c] for c in ("kind", "source", "destination", "fold_source")}
        e = entries.setdefault(r["ensemble_id"], facts | {"weights": {t: {} for t in TARGETS}})
        wrong = [c for c, v in facts.items() if e[c] != v]
        if wrong:
            raise ValueError(f"ensemble {r['ensemble_id']!r} mixes {wrong[0]} {sorted([str(e[wrong[0]]), str(facts[wrong[0]])])}")
        if r["model_id"] in e["weights"][r["target"]]:
            raise ValueError(f"ensemble {r['ensemble_id']!r} weighs {r['model_id']!r} twice for {r['target']!r}")
        e["weights"][r["target"]][r["model_id"]] = float(r["w"])
    out = None
    for source in sorted({e["source"] for e in entries.values()}):
        if source not in sources:
            raise KeyError(f"catalogue reads unknown population {source!r}")
        part = _blend_source(spark, {i: e for i, e in sorted(entries.items()) if e["source"] == source}, sources[source], keys, fold_col, n_folds)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("the catalogue is empty")
    return out


def _blend_source(spark, entries: dict[str, dict], predictions: DataFrame, keys: list[str], fold_col: str, n_folds: int) -> DataFrame:
    """Blends of the ensembles that read one population."""
    for i, e in entries.items():
        if e["kind"] not in KINDS:
            raise ValueError(f"unknown ensemble kind {e['kind']!r}")
        if e["fold_source"] not in FOLD_SOURCES:
            raise ValueError(f"unknown fold source {e['fold_source']!r}; expected one of {FOLD_SOURCES}")
        missing = [t for t in TARGETS if not e["weights"][t]]
        if missing:
            raise ValueError(f"weights give no model for targets {missing}")
    ids = list(entries)
    table: dict[tuple, list] = {}
    for n, i in enumerate(ids):
        for t in TARGETS:
            for no, (m, w) in enumerate(sorted(entries[i]["weights"][t].items())):
                table.setdefault((m, t), [None] * (2 * len(ids)))[2 * n:2 * n + 2] = [w, no]
    columns = ", ".join(f"_w{n} double, _no{n} long" for n in range(len(ids)))
    weights = spark.createDataFrame([(m, t, *v) for (m, t), v in table.items()], f"model_id string, target string, {columns}")
    # one exchange: the rows of a key meet once, all that follows is grouped by the key or finer
    met = predictions.join(F.broadcast(weights), ["model_id", "target"]).repartition(*keys)
    sums, checks = [], []
    for n, i in enumerate(ids):
        number = F.when(F.col("pred").isNotNull(), F.col(f"_no{n}"))
        sums.append(F.sum(F.col(f"_w{n}") * F.col("pred")).alias(f"_s{n}"))
        each = F.lit(False)
        for t in TARGETS:
            each = F.when(F.col("target") == t, each_once(number, len(entries[i]["weights"][t]))).otherwise(each)
        checks += [each.alias(f"_ok{n}"), F.count(f"_no{n}").alias(f"_c{n}")]
    per = met.groupBy(*keys, "target").agg(*sums, *checks)
    options = []
    for n, i in enumerate(ids):
        e = entries[i]
        total = F.lit(None).cast("double")
        for t in TARGETS:
            total = F.when(F.col("target") == t, F.lit(sum(e["weights"][t].values()))).otherwise(total)
        value = F.col(f"_s{n}") / total if e["kind"] == "normalised" else F.col(f"_s{n}")
        value = F.when(F.col(f"_ok{n}"), clip_score(value) if e["kind"] == "columnwise" else value)
        own = e["fold_source"] == "own"
        folds = F.array(F.col(fold_col).cast("int")) if own else F.sequence(F.lit(0), F.lit(n_folds - 1))
        options.append(F.struct(F.lit(i).alias("id"), F.lit(e["destination"]).alias("to"), value.alias("v"),
                                F.when((F.col(f"_c{n}") > 0) & (F.lit(own) | (F.col(fold_col) == 0)), folds).alias("folds")))
    blended = per.select(*keys, "target", F.explode(F.array(*options)).alias("e")).filter(F.col("e.folds").isNotNull())
    wide = blended.groupBy(*keys, F.col("e.id").alias("ensemble_id"), F.col("e.to").alias("destination"), F.col("e.folds").alias("_folds")).agg(
        *[F.max(F.when(F.col("target") == t, F.col("e.v"))).alias(t) for t in TARGETS])
    others = [k for k in keys if k != fold_col]
    return wide.select("ensemble_id", "destination", F.explode("_folds").alias(fold_col), *others, *TARGETS) \
               .select("ensemble_id", "destination", *keys, *TARGETS)


def fold_source(predictions: DataFrame, source: str, fold_col: str = "fold", n_folds: int = 5) -> DataFrame:
    """Which fold model's predictions stand in each output fold: its ``own``, or fold ``zero``'s in all of them."""
    if source not in FOLD_SOURCES:
        raise ValueError(f"unknown fold source {source!r}; expected one of {FOLD_SOURCES}")
    if source == "own":
        return predictions
    folds = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))
    return predictions.filter(F.col(fold_col) == 0).drop(fold_col).select("*", folds.alias(fold_col))
