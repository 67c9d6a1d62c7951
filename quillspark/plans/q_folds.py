"""Registered queries: folds, quantile bins, splits and samples (D keys)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as K
from ..operators import folds as D
from ..session import pin
from ..sources.tables import Tables
from ..targets import N_FOLDS, TARGETS
from . import fixtures as fx
from .registry import register
from .sqlparts import current_cte, essays_cte

_Q = 50
_PROBS = "[" + ", ".join(f"{i / _Q!r}e0" for i in range(_Q + 1)) + "]"


def _counts(spark, sf_dir):
    cur = fx.current_population(Tables(spark, sf_dir))
    toks = K.regex_tokens("full_text")
    return cur.select("text_id", *TARGETS, K.n_token(toks).alias("n_token"),
                      K.n_unique_token(toks).alias("nunique_token"))


@register("strat_folds")
def strat_folds(spark, sf_dir):
    """D1 (rows-only): stratified folds of the labelled essays; balance invariants are tested in tests/."""
    cur = fx.current_population(Tables(spark, sf_dir)).select("text_id", *TARGETS)
    return D.stratified_folds(cur, TARGETS, seed=42).select("text_id", "fold")


@register("balanced_folds")
def balanced_folds(spark, sf_dir):
    """D2 (rows-only): targets plus 50-quantile bins of the token counts as eight stratification labels."""
    c = pin(_counts(spark, sf_dir))  # read by the two edge aggregates, the histogram and the join: tokenise once
    c = D.qcut_bins(D.qcut_bins(c, "n_token", _Q, "n_token_bin"), "nunique_token", _Q, "nutoken_bin")
    out = D.stratified_folds(c, [*TARGETS, "n_token_bin", "nutoken_bin"], seed=42)
    return out.select("text_id", "n_token", "nunique_token", "n_token_bin", "nutoken_bin", "fold")


_TOK = (f"{essays_cte()},\n{current_cte()},\n"
        "c AS (SELECT text_id, cast(len(regexp_extract_all(full_text, '\\w+|[^\\w\\s]')) AS int) AS n_token, "
        "cast(len(list_distinct(regexp_extract_all(full_text, '\\w+|[^\\w\\s]'))) AS int) AS nunique_token FROM curr)")


def _sql_bin(col: str) -> str:
    edges = f"(SELECT list_sort(list_distinct(quantile_cont({col}, {_PROBS}))) FROM c)"
    return f"cast(len(list_filter(({edges})[2:len({edges}) - 1], lambda e: e < {col})) AS int)"


@register("qcut_bins", sql=f"WITH {_TOK}\nSELECT text_id, n_token, nunique_token, {_sql_bin('n_token')} AS n_token_bin, "
          f"{_sql_bin('nunique_token')} AS nutoken_bin FROM c")
def qcut_bins(spark, sf_dir):
    c = _counts(spark, sf_dir).select("text_id", "n_token", "nunique_token")
    c = D.qcut_bins(D.qcut_bins(c, "n_token", _Q, "n_token_bin"), "nunique_token", _Q, "nutoken_bin")
    return c


def _marginals(df, labels, most=1):
    """(label, value, n, within_one): rows of every label value, and whether each fold holds within ``most`` rows of a fifth in whole rows."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("value")) for c in labels]))
    per = df.select("fold", cells.alias("c")).groupBy("c.label", "c.value").agg(
        F.count("*").alias("n"), *[F.count(F.when(F.col("fold") == k, 1)).alias(f"f{k}") for k in range(N_FOLDS)])
    off = F.greatest(*[F.abs(F.col(f"f{k}") - F.round(F.col("n") / N_FOLDS)) for k in range(N_FOLDS)])
    return per.select("label", "value", "n", (off <= most).alias("within_one"))


@register("fold_marginals", sql=f"WITH {essays_cte()},\n{current_cte()}\n" + " UNION ALL ".join(
    f"SELECT '{t}' AS label, {t} AS value, count(*) AS n, TRUE AS within_one FROM curr GROUP BY {t}" for t in TARGETS))
def fold_marginals(spark, sf_dir):
    """Every score of every target is spread over the five folds to within one row."""
    cur = fx.current_population(Tables(spark, sf_dir)).select("text_id", *TARGETS)
    return _marginals(D.stratified_folds(cur, TARGETS, seed=42), TARGETS)


_BALANCED = [*TARGETS, "n_token_bin", "nutoken_bin"]


@register("balanced_marginals", sql=f"WITH {_TOK},\nb AS (SELECT curr.*, {_sql_bin('n_token')} AS n_token_bin, "
          f"{_sql_bin('nunique_token')} AS nutoken_bin FROM curr JOIN c USING (text_id))\n" + " UNION ALL ".join(
              f"SELECT '{t}' AS label, cast({t} AS double) AS value, count(*) AS n, TRUE AS within_two FROM b GROUP BY {t}" for t in _BALANCED))
def balanced_marginals(spark, sf_dir):
    """The same with the bins of the token counts as labels, to within two rows."""
    c = pin(_counts(spark, sf_dir))
    c = D.qcut_bins(D.qcut_bins(c, "n_token", _Q, "n_token_bin"), "nunique_token", _Q, "nutoken_bin")
    out = _marginals(D.stratified_folds(c, _BALANCED, seed=42), _BALANCED, 2)
    return out.withColumnRenamed("within_one", "within_two")


_VALUE_EDGES = f"(SELECT list_sort(list_distinct(quantile_cont(value, {_PROBS}))) FROM events)"


@register("qcut_doubles", sql=f"WITH e AS MATERIALIZED (SELECT {_VALUE_EDGES} AS edges)\n"
          "SELECT event_id, value, cast(len(list_filter(edges[2:len(edges) - 1], lambda x: x < value)) AS int) AS value_bin FROM events, e")
def qcut_doubles(spark, sf_dir):
    """D3 on a column of mostly different doubles."""
    return D.qcut_bins(Tables(spark, sf_dir).events.select("event_id", "value"), "value", _Q)


@register("fold_split", sql=f"WITH {essays_cte()}\nSELECT text_id, fold, "
          "CASE WHEN fold IS NOT DISTINCT FROM 2 THEN 'valid' ELSE 'train' END AS split FROM essays")
def fold_split(spark, sf_dir):
    e = fx.essays(Tables(spark, sf_dir))
    return e.select("text_id", "fold", D.split_label(2).alias("split"))


@register("sample_n", sql=f"WITH {essays_cte()}\nSELECT text_id, fold FROM essays "
          "ORDER BY md5(concat('42:', text_id)), text_id LIMIT 50")
def sample_n(spark, sf_dir):
    """Exactly 50 essays, the same for the same seed."""
    e = fx.essays(Tables(spark, sf_dir)).select("text_id", "fold")
    return D.sample_n(e, 50, seed=42)


@register("head_n", sql=f"WITH {essays_cte()}\nSELECT text_id, fold FROM essays ORDER BY text_id LIMIT 50")
def head_n(spark, sf_dir):
    e = fx.essays(Tables(spark, sf_dir)).select("text_id", "fold")
    return D.head_n(e, 50)
