"""DuckDB SQL for the fixtures, written independently of the Spark code path (wide joins where Spark goes long)."""

from __future__ import annotations

from ..functions.text import PLACEHOLDER_MARKERS
from ..targets import TARGETS
from .fixtures import FIXTURE_MODELS, GAP_MOD, GAPPY_MODEL, MODEL_IDS as FIXTURE_MODEL_IDS, MODEL_WEIGHTS, TARGET_PQ

def essays_cte() -> str:
    cols = ",\n    ".join(
        f"1e0 + 5e-1 * ((doc_id * {p} + cast(floor(doc_id / {q}) AS bigint)) % 9) AS {t}"
        for (p, q), t in zip(TARGET_PQ, TARGETS))
    return f"""essays AS (
  SELECT doc_id,
    concat('T', lpad(cast(doc_id AS varchar), 11, '0')) AS text_id,
    text AS full_text,
    {cols},
    cast(doc_id % 5 AS int) AS fold
  FROM documents)"""


def model_params(model: str) -> tuple[int, int]:
    _, a, c = next(m for m in FIXTURE_MODELS if m[0] == model)
    return a, c


def pred_cols(model: str, k: int | None = None, alias: str = "pred_{t}") -> str:
    a, c = model_params(model)
    kk = "" if k is None else f" + 7 * {k}"
    return ",\n    ".join(
        f"{t} + ((doc_id * {a} + 31 * {j}{kk}) % 201 - 100) * {c}e-3 AS {alias.format(t=t, m=model)}"
        for j, t in enumerate(TARGETS))


def gap_filter(model: str) -> str:
    return f"doc_id % {GAP_MOD} <> 0" if model == GAPPY_MODEL else "TRUE"


def wide_model_cte(name: str, model: str, source: str = "essays", k: int | None = None) -> str:
    """One model's wide predictions (ids, fold, ``pred_<t>``) over ``source``."""
    return f"""{name} AS (
  SELECT '{model}' AS model_id, doc_id, text_id, fold,
    {pred_cols(model, k)}
  FROM {source} WHERE {gap_filter(model)})"""


def long_oof_cte(name: str = "oof") -> str:
    """All models, long: model_id, fold, text_id, target, pred, y (truth)."""
    blocks = []
    for m, _, _ in FIXTURE_MODELS:
        a, c = model_params(m)
        for j, t in enumerate(TARGETS):
            blocks.append(
                f"SELECT '{m}' AS model_id, fold, text_id, '{t}' AS target, "
                f"{t} + ((doc_id * {a} + 31 * {j}) % 201 - 100) * {c}e-3 AS pred, {t} AS y "
                f"FROM essays WHERE {gap_filter(m)}")
    return f"{name} AS (\n  " + "\n  UNION ALL ".join(blocks) + ")"


def long_pseudo_cte(name: str, source: str, models: list[str] | None = None, folds=range(5)) -> str:
    """Pseudo predictions of each fold model k over ``source``: model_id, fold (=k), text_id, target, pred."""
    models = models or [m for m, _, _ in FIXTURE_MODELS]
    blocks = []
    for m in models:
        a, c = model_params(m)
        for k in folds:
            for j, t in enumerate(TARGETS):
                blocks.append(
                    f"SELECT '{m}' AS model_id, cast({k} AS int) AS fold, text_id, '{t}' AS target, "
                    f"{t} + ((doc_id * {a} + 31 * {j} + 7 * {k}) % 201 - 100) * {c}e-3 AS pred "
                    f"FROM {source} WHERE {gap_filter(m)}")
    return f"{name} AS (\n  " + "\n  UNION ALL ".join(blocks) + ")"


def current_cte(name: str = "curr") -> str:
    return f"{name} AS (SELECT * FROM essays WHERE doc_id IN (SELECT doc_id FROM labels))"


def known_cte(name: str = "known") -> str:
    return f"{name} AS (SELECT concat('T', lpad(cast(doc_id AS varchar), 11, '0')) AS text_id FROM labels)"


def modelwise_weight(model: str) -> float:
    i = [m for m, _, _ in FIXTURE_MODELS].index(model)
    return MODEL_WEIGHTS[i]


def columnwise_weight(model: str, target: str) -> float:
    i = [m for m, _, _ in FIXTURE_MODELS].index(model)
    j = TARGETS.index(target)
    return MODEL_WEIGHTS[(i + j) % len(MODEL_WEIGHTS)]


def placeholder_case(col: str = "doc_id") -> str:
    whens = " ".join(f"WHEN {i} THEN '{k}'" for i, (k, _) in enumerate(PLACEHOLDER_MARKERS))
    return f"CASE {col} % 16 {whens} END"


# --- wide per-model CTEs and blends (the SQL side is written wide on purpose) ----------------------------

def sql_float(x: float) -> str:
    return f"{x!r}e0"


def fold_model_cte(name: str, model: str, source: str, k_fixed: int | None = None) -> str:
    """SQL: one model's pseudo predictions per fold model k (all five, or one fixed k), wide."""
    a, c = model_params(model)
    cols = ", ".join(f"{t} + ((doc_id * {a} + 31 * {j} + 7 * k) % 201 - 100) * {c}e-3 AS {t}"
                     for j, t in enumerate(TARGETS))
    src = (f"(SELECT *, r.k AS k FROM {source}, range(5) r(k))" if k_fixed is None
           else f"(SELECT *, {k_fixed} AS k FROM {source})")
    return f"{name} AS (SELECT cast(k AS int) AS fold, text_id, doc_id, {cols} FROM {src} WHERE {gap_filter(model)})"


def oof_model_cte(name: str, model: str, source: str = "essays") -> str:
    a, c = model_params(model)
    cols = ", ".join(f"{t} + ((doc_id * {a} + 31 * {j}) % 201 - 100) * {c}e-3 AS {t}"
                     for j, t in enumerate(TARGETS))
    return f"{name} AS (SELECT fold, text_id, doc_id, {cols} FROM {source} WHERE {gap_filter(model)})"


def blend_sql(weight_of, keys: str, clip: bool, norm: float | None = None, from_alias: str = "m0") -> str:
    """Weighted sum over the model CTEs m0..m3 joined on ``keys`` (LEFT from m0 = model2, complete)."""
    cols = []
    for t in TARGETS:
        s = " + ".join(f"{sql_float(weight_of(m, t))} * m{i}.{t}" for i, m in enumerate(FIXTURE_MODEL_IDS))
        if norm is not None:
            s = f"({s}) / {sql_float(norm)}"
        if clip:
            s = sql_clip(s)
        cols.append(f"round({s}, 6) AS {t}")
    joins = " ".join(f"LEFT JOIN m{i} USING ({keys})" for i in range(1, len(FIXTURE_MODEL_IDS)))
    return ", ".join(cols), f"FROM m0 {joins}"


def sql_clip(expr: str) -> str:
    """Clip to [1, 5] keeping NULL and NaN (greatest/least alone would turn NULL into a bound)."""
    return f"CASE WHEN ({expr}) IS NULL OR isnan({expr}) THEN ({expr}) ELSE least(5e0, greatest(1e0, {expr})) END"


def modelwise_w(m, t):
    return modelwise_weight(m)


def columnwise_w(m, t):
    return columnwise_weight(m, t)
