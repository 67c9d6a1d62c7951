"""The six scored targets and value rules shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Target names in their canonical order, and the score range.
TARGETS = ["cohesion", "syntax", "vocabulary", "phraseology", "grammar", "conventions"]
SCORE_MIN = 1.0
SCORE_MAX = 5.0
N_FOLDS = 5


def clip_score(c: Column | str, lo: float = SCORE_MIN, hi: float = SCORE_MAX) -> Column:
    """Clip to [lo, hi] keeping NULL and NaN as they are (pandas ``clip`` semantics)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull() | F.isnan(c), c).otherwise(F.least(F.lit(hi), F.greatest(F.lit(lo), c)))


def target_value(target_col: Column | str, targets: list[str] | None = None) -> Column:
    """Pick the wide column named by ``target_col`` (long → wide lookup without a join)."""
    target_col = F.col(target_col) if isinstance(target_col, str) else target_col
    targets = targets or TARGETS
    expr = None
    for t in targets:
        expr = F.when(target_col == t, F.col(t)) if expr is None else expr.when(target_col == t, F.col(t))
    return expr


def target_index(target_col: Column | str, targets: list[str] | None = None) -> Column:
    target_col = F.col(target_col) if isinstance(target_col, str) else target_col
    targets = targets or TARGETS
    return (F.array_position(F.array(*[F.lit(t) for t in targets]), target_col) - 1).cast("int")
