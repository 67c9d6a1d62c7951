"""Leave-one-fold-out ridge regressions of hashed TF-IDF features from sufficient statistics (K4).

A ridge fit needs its rows only through the moments of z = (1, term counts, targets): their weighted Gram matrix, and the document
frequencies. One pass gives the moments of every fold; the training set of the model of fold k is the sum of the other
folds' (and of its own extra rows'), so K models for six targets cost one pass over the rows instead of a pass per
fold and target. Inverse document frequencies depend on the training set, but only scale rows and columns of the Gram
matrix, so they are applied to the sums.

Tasks add up dense Gram matrices and emit them in blocks of ``BLOCK`` rows; blocks of one place are added in a streaming
pass, so no task holds more than one sum and one part. What reaches the driver is one matrix per group and pattern of
missing targets, (features + 7)² numbers each: bounded by the parameters and checked, whatever the number of rows.

Model of fold k and target t: minimise Σ w (y − a − xβ)² / Σ w + reg · Σ (σⱼ βⱼ)², with x = count · idf, idf = log((n + 1) /
(df + 1)) over the training rows and σⱼ the weighted standard deviation of feature j in them (features that do not vary get
β = 0). Rows without a target (null or NaN) do not train that target. The solution is exact (one linear system per fold
and pattern, six right-hand sides).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..targets import TARGETS
from .ensemble import collect_small

TOKEN = r"(\w+|[^\w\s])"
BLOCK = 64
# Gram matrices a task holds before it emits them, and rows it turns into dense counts at a time.
HELD = 12
ROWS = 1024
MOMENTS = "grp string, mask int, i int, raw binary"
# Largest size of all moments on the driver.
DRIVER_BYTES = 1 << 30


def term_places(text: Column, n_features: int) -> Column:
    """Feature number of every token of a text, lower-cased; repeats stay. Null text: no tokens."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)
    return F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(n_features)).cast("int"))


def _counts(places: pa.Array, n_features: int) -> np.ndarray:
    """Dense (row, feature) counts of a list column."""
    size = pc.list_value_length(places).to_numpy(zero_copy_only=False).astype(np.int64)
    cell = np.repeat(np.arange(len(size)), size) * n_features + pc.list_flatten(places).to_numpy()
    return np.bincount(cell, minlength=len(size) * n_features).reshape(len(size), n_features).astype(np.float64)


def _emit(held: dict, docs: dict) -> Iterator[pa.RecordBatch]:
    while held:
        (grp, mask), g = held.popitem()
        for i in range(0, len(g), BLOCK):
            yield _block((grp, mask, i), g[i:i + BLOCK, i:])
    while docs:
        grp, x = docs.popitem()
        yield _block((grp, -1, -1), x)


def _gram(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted Gram matrix; with one weight for all rows it is a symmetric product, half the work."""
    return w[0] * (z.T @ z) if (w == w[0]).all() else (z * w[:, None]).T @ z


def _partial_moments(n_features: int, n_targets: int):
    """Per group and pattern of known targets the Gram blocks; per group (mask and i of -1) n and document frequencies."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        docs: dict[str, np.ndarray] = {}
        # dense counts of some rows at a time, so that memory does not follow the size of the batches
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            x = _counts(batch.column("places"), n_features)
            y = pc.list_flatten(batch.column("y")).to_numpy(zero_copy_only=False).reshape(-1, n_targets).astype(np.float64)
            known = ~np.isnan(y)
            mask = known @ (1 << np.arange(n_targets))
            z = np.hstack([np.ones((len(x), 1)), x, np.where(known, y, 0.0)])
            w = batch.column("w").to_numpy(zero_copy_only=False)
            grp = np.array(batch.column("grp").to_pylist())
            for g in np.unique(grp).tolist():
                of_group = grp == g
                seen = np.concatenate(([of_group.sum()], (x[of_group] > 0).sum(axis=0))).astype(np.float64)
                docs[g] = docs.get(g, 0.0) + seen
                for m in np.unique(mask[of_group]).tolist():
                    own = of_group & (mask == m)
                    part = _gram(z[own], w[own])
                    if (g, m) in held:
                        held[g, m] += part
                    else:
                        held[g, m] = part
                    if len(held) > HELD:
                        yield from _emit(held, docs)
        yield from _emit(held, docs)
    return run


def _added(batches) -> Iterator[pa.RecordBatch]:
    """Sum of the blocks of each (grp, mask, i), which arrive together."""
    key = total = None
    for batch in batches:
        for grp, mask, i, raw in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
            part = np.frombuffer(raw.as_buffer())
            if (grp, mask, i) == key:
                total += part
                continue
            if key:
                yield _block(key, total)
            key, total = (grp, mask, i), part.copy()
    if key:
        yield _block(key, total)


def _block(key: tuple, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([key[2]], pa.int32()),
                                       pa.array([total.tobytes()], pa.binary())], names=["grp", "mask", "i", "raw"])


class Moments:
    """Sums per group: ``gram[grp, mask]`` and ``docs[grp]`` (n, then document frequencies)."""

    def __init__(self, n_features: int, n_targets: int, gram: dict, docs: dict):
        self.n_features, self.n_targets, self.gram, self.docs = n_features, n_targets, gram, docs

    def fit(self, groups: list[str], reg: float) -> np.ndarray:
        """Coefficients (1 + features, targets) on raw counts, trained on the rows of ``groups``; row 0 is the intercept."""
        f = self.n_features
        docs = sum((self.docs[g] for g in groups if g in self.docs), np.zeros(f + 1))
        idf = np.log((docs[0] + 1) / (docs[1:] + 1))
        out = np.zeros((f + 1, self.n_targets))
        masks = sorted({m for g, m in self.gram if g in groups})
        by_rows: dict[tuple, list[int]] = {}
        for t in range(self.n_targets):
            by_rows.setdefault(tuple(m for m in masks if m >> t & 1), []).append(t)
        for known, targets in by_rows.items():
            s = sum((g for (grp, m), g in self.gram.items() if grp in groups and m in known), np.zeros((f + 1 + self.n_targets,) * 2))
            w = s[0, 0]
            if not w > 0:
                raise ValueError(f"no training rows for {targets} in {groups}")
            y = [f + 1 + t for t in targets]
            mean, y_mean = s[0, 1:f + 1] * idf / w, s[0, y] / w
            cov = s[1:f + 1, 1:f + 1] * np.outer(idf, idf) / w - np.outer(mean, mean)
            cross = s[1:f + 1, y] * idf[:, None] / w - np.outer(mean, y_mean)
            var = np.diag(cov)
            live = np.flatnonzero(var > 1e-12 * np.maximum(mean ** 2, 1.0))
            sd = np.sqrt(var[live])
            beta = np.linalg.solve(cov[np.ix_(live, live)] / np.outer(sd, sd) + reg * np.eye(len(live)), cross[live] / sd[:, None]) / sd[:, None]
            out[np.ix_(live + 1, targets)] = beta * idf[live][:, None]
            out[0, targets] = y_mean - mean[live] @ beta
        return out


def moments(rows: DataFrame, n_features: int, n_targets: int = len(TARGETS)) -> Moments:
    """Moments of ``rows`` (grp, places, y array of targets, w), summed in Spark; more than ``DRIVER_BYTES`` are an error."""
    width = 1 + n_features + n_targets
    places = -(-width // BLOCK)
    groups = DRIVER_BYTES // (width * width * 4)
    parts = rows.select("grp", "places", "y", "w").mapInArrow(_partial_moments(n_features, n_targets), MOMENTS)
    order = ["grp", "mask", "i"]
    sums = parts.repartition(*order).sortWithinPartitions(*order).mapInArrow(_added, MOMENTS)
    gram: dict[tuple, np.ndarray] = {}
    docs = {}
    for grp, mask, i, raw in collect_small(sums, groups * places):
        part = np.frombuffer(raw)
        if i < 0:
            docs[grp] = part
            continue
        g = gram.setdefault((grp, mask), np.zeros((width, width)))
        part = part.reshape(-1, width - i)
        g[i:i + len(part), i:] = part
        g[i:, i:i + len(part)] = part.T
    return Moments(n_features, n_targets, gram, docs)


def predict(rows: DataFrame, models: list[np.ndarray], id_col: str, model_col: str | None = None,
            shown: str = "fold") -> DataFrame:
    """``(id, <shown>, pred_<t>...)``: each row of (id, places) by the model numbered in ``model_col``, or by all models."""
    shipped = rows.sparkSession.sparkContext.broadcast(models)
    names = [f"pred_{t}" for t in TARGETS]
    own = [] if model_col is None else [F.col(model_col).cast("int").alias("model")]
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        models = shipped.value
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            which = None if model_col is None else batch.column(2).to_numpy(zero_copy_only=False)
            for k, model in enumerate(models):
                at = np.arange(batch.num_rows) if which is None else np.flatnonzero(which == k)
                if not len(at):
                    continue
                places = batch.column(1) if which is None else batch.column(1).take(pa.array(at))
                size = pc.list_value_length(places).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = pc.list_flatten(places).to_numpy() + 1
                owner = np.repeat(np.arange(len(size)), size)
                pred = [model[0, t] + np.bincount(owner, model[flat, t], len(size)) for t in range(model.shape[1])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), k), pa.int32()), *[pa.array(x) for x in pred]],
                    names=[id_col, shown, *names])
    return rows.select(id_col, "places", *own).mapInArrow(
        run, f"`{id_col}` {id_type}, {shown} int, " + ", ".join(f"{n} double" for n in names))
