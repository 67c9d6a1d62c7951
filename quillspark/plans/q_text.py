"""Registered queries: corpus cleaning (B keys) over the dirty-text fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import Tables
from . import fixtures as fx
from .registry import register
from .sqlparts import essays_cte, placeholder_case


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


DIRTY_CTE = (f"{essays_cte()},\ndirty AS (SELECT doc_id, text_id, full_text || ' ' || {placeholder_case()} "
             f"|| CASE WHEN doc_id % 11 = 0 THEN ' {fx.DIRTY_MOJIBAKE}' ELSE '' END "
             f"|| CASE WHEN doc_id % 13 = 0 THEN ' {fx.DIRTY_PUNCT}' ELSE '' END AS t FROM essays)")


def sql_fold(expr: str) -> str:
    for k, v in X._MULTI:
        expr = f"replace({expr}, {_q(k)}, {_q(v)})"
    return f"translate({expr}, {_q(X._SINGLE_FROM)}, {_q(X._SINGLE_TO)})"


def sql_placeholders(expr: str) -> str:
    for k, v in X.PLACEHOLDER_MARKERS:
        expr = f"replace({expr}, {_q(k)}, {_q(v)})"
    return expr


def sql_newlines(expr: str) -> str:
    return f"replace({expr}, chr(10), '[BR]')"


# On this corpus encoding repair only fixes the appended mojibake pair (see FIXTURES.md, dirty text).
SQL_REPAIR = f"replace(t, {_q(fx.DIRTY_MOJIBAKE)}, 'é')"


def _dirty(spark, sf_dir):
    return fx.dirty_text(Tables(spark, sf_dir))


def _text_query(name: str, col_fn, sql_expr: str, out: str = "text"):
    @register(name, sql=f"WITH {DIRTY_CTE}\nSELECT text_id, {sql_expr} AS {out} FROM dirty")
    def q(spark, sf_dir):
        return _dirty(spark, sf_dir).select("text_id", col_fn(F.col("full_text")).alias(out))
    q.__name__ = name
    return q


_text_query("repair_encoding", X.repair_encoding, SQL_REPAIR)
_text_query("ascii_fold", X.ascii_fold, sql_fold("t"))
_text_query("canon_placeholders", X.canon_placeholders, sql_placeholders("t"))
_text_query("mark_newlines", X.mark_newlines, sql_newlines("t"))
_text_query("pad_punct", X.pad_punctuation,
            f"regexp_replace(regexp_replace(t, '([.,!?()-])', ' \\1 ', 'g'), '{X.PY_SPACE}{{2,}}', ' ', 'g')")
_text_query("reverse_words", X.reverse_words,
            f"array_to_string(list_reverse(list_filter(regexp_split_to_array(t, '{X.PY_SPACE}+'), "
            f"lambda w: w <> '')), ' ')")
_text_query("clean_v1", lambda c: X.clean_text(c, 1), sql_placeholders(sql_newlines(sql_fold(SQL_REPAIR))))
_text_query("clean_v2", lambda c: X.clean_text(c, 2), sql_placeholders(sql_fold(SQL_REPAIR)))


_MARKERS = sorted(set(X.marker_vocabulary(1)))
_MARKER_LIST = "[" + ", ".join(_q(m) for m in _MARKERS) + "]"


@register("marker_counts", sql=f"""WITH {DIRTY_CTE},
c AS (SELECT {sql_placeholders(sql_newlines(sql_fold(SQL_REPAIR)))} AS t FROM dirty),
m AS (SELECT unnest({_MARKER_LIST}) AS marker),
x AS (SELECT marker, cast((length(t) - length(replace(t, marker, ''))) / length(marker) AS bigint) AS k FROM c, m)
SELECT marker, sum(k)::bigint AS occurrences, count(*) FILTER (WHERE k > 0) AS n_docs FROM x GROUP BY marker""")
def marker_counts(spark, sf_dir):
    """Distinct marker vocabulary, counted over the cleaned corpus (partial aggregate per marker)."""
    cleaned = _dirty(spark, sf_dir).select(X.clean_text(F.col("full_text"), 1).alias("t"))
    per_doc = cleaned.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("marker"), X.count_literal(F.col("t"), m).alias("k")) for m in _MARKERS])).alias("x"))
    return (per_doc.groupBy(F.col("x.marker").alias("marker"))
            .agg(F.sum("x.k").cast("long").alias("occurrences"),
                 F.count(F.when(F.col("x.k") > 0, 1)).alias("n_docs")))
