"""Stored models and registry scoring with bounded memory (K1, K3).

A model is a file in the shared folder: one coefficient matrix per fold on hashed features of the text. Two kinds exist, which read
the text differently: ``terms`` (lower-cased words and marks) and ``grams`` (character trigrams of the lower-cased text);
both are fitted by ``ridge`` from moments. Files are Parquet, written by Spark and shipped to the executors one by one by
``SparkContext.addFile`` (which takes a local folder as a whole in local mode only), so any file system Spark knows will do.

Scoring finds the features of a row once in the JVM, whatever the number of models, and sends them to Python in Arrow batches. A task
goes through its batches in blocks of at most ``BLOCK_BATCHES`` (fewer if they are large); for every block it takes the models one after the other, so a model is
read once a block and no more than ``cache_bytes`` of models (and always at least one) are in memory, however large the
registry is. With fold means, the K predictions of a row are averaged on the spot.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..targets import N_FOLDS, TARGETS
from . import ridge

MODEL_SCHEMA = "kind string, n_features int, fold int, rows int, data binary"
_SHIPPED: dict[str, set[str]] = {}
CACHE_BYTES = 256 << 20
BLOCK_BATCHES = 8
# ... or fewer, once they hold so many bytes; a batch is scored in runs of about SCORED features
BLOCK_BYTES = 64 << 20
SCORED = 1 << 21
# Cells of counts for a feature found, up to which dense counts are taken.
DENSE = 8


def gram_places(text: Column, n_features: int) -> Column:
    """Feature number of every character trigram of a text, lower-cased, with a space at both ends."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    # one pass over the text: each match is a character (a code point) with the two after it looked ahead; the padding of an
    # empty text is a gram of its own
    grams = F.when(F.length(padded) < 3, F.array(padded)).otherwise(F.regexp_extract_all(padded, F.lit("(?s)(?=(...))."), F.lit(1)))
    return F.transform(grams, lambda gram: F.pmod(F.xxhash64(gram), F.lit(n_features)).cast("int"))


FEATURES = {"terms": ridge.term_places, "grams": gram_places}


def fit_model(labelled: DataFrame, kind: str, n_features: int = 1024, reg: float = 1.0, n_folds: int = N_FOLDS,
              text_col: str = "full_text") -> list[np.ndarray]:
    """The coefficient matrices of the fold models: model k is trained on the rows with fold ≠ k."""
    y = F.array(*[F.coalesce(F.col(t).cast("double"), F.lit(float("nan"))) for t in TARGETS])
    grp = F.coalesce(F.col("fold").cast("int").cast("string"), F.lit("none"))
    rows = labelled.select(grp.alias("grp"), FEATURES[kind](F.col(text_col), n_features).alias("places"), y.alias("y"), F.lit(1.0).alias("w"))
    found = ridge.moments(rows, n_features)
    return [found.fit(sorted(g for g in found.docs if g != str(k)), reg) for k in range(n_folds)]


def save_model(spark: SparkSession, folds: list[np.ndarray], kind: str, path: str | None = None) -> str:
    """Write a model to the shared folder; returns its path."""
    if kind not in FEATURES:
        raise ValueError(f"unknown kind {kind!r}; expected one of {sorted(FEATURES)}")
    path = path or scratch_path(spark, f"model-{kind}")
    rows = [(kind, len(m) - 1, k, len(m), np.ascontiguousarray(m, "<f8").tobytes()) for k, m in enumerate(folds)]
    spark.createDataFrame(rows, MODEL_SCHEMA).coalesce(1).write.parquet(path)
    return path


class Models:
    """Models of a task, read on demand; those used longest ago are dropped beyond ``most`` bytes."""

    def __init__(self, files: dict[str, str | list[str]], most: int):
        self.files, self.most = files, most
        self.held: OrderedDict[str, list[np.ndarray]] = OrderedDict()
        self.reads = self.peak = 0

    def size(self) -> int:
        return sum(m.nbytes for folds in self.held.values() for m in folds)

    def get(self, name: str) -> list[np.ndarray]:
        if name in self.held:
            self.held.move_to_end(name)
            return self.held[name]
        table = pq.read_table(self.files[name]).sort_by("fold")
        folds = [np.frombuffer(data, "<f8").reshape(rows, -1) for data, rows in zip(table["data"].to_pylist(), table["rows"].to_pylist())]
        self.reads += 1
        need = sum(m.nbytes for m in folds)
        while self.held and self.size() + need > self.most:
            self.held.popitem(last=False)
        self.held[name] = folds
        self.peak = max(self.peak, self.size())
        return folds


def ship_files(spark: SparkSession, path: str) -> list[str]:
    """Send the files of a model to all executors; returns the names that ``SparkFiles`` knows them by. A file is sent once, and
    its name holds the number of the write that made it; Spark refuses another file of the same name."""
    sent = _SHIPPED.setdefault(spark.sparkContext.applicationId, set())
    files = sorted(spark.read.parquet(path).inputFiles())
    for file in files:
        if file not in sent:
            spark.sparkContext.addFile(file)
            sent.add(file)
    return [unquote(file.rsplit("/", 1)[-1]) for file in files]


def apply_model(model: np.ndarray, places: pa.Array) -> np.ndarray:
    """Predictions (row, target) of one coefficient matrix, or of several side by side."""
    size = pc.list_value_length(places).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.empty((len(size), model.shape[1]))
    ends = np.cumsum(size)
    width = len(model) - 1
    # counts of all features and one product where texts have many of them; a coefficient that is no number must meet its own rows only
    dense = len(size) > 0 and len(size) * width <= DENSE * ends[-1] and bool(np.isfinite(model).all())
    most = max(1, SCORED // width) if dense else len(size)
    low = done = 0
    while low < len(size):
        high = min(low + most, max(low + 1, int(np.searchsorted(ends, done + SCORED, "right"))))
        owner = np.repeat(np.arange(high - low), size[low:high])
        flat = pc.list_flatten(places.slice(low, high - low)).to_numpy()
        if dense:
            counts = np.bincount(owner * width + flat, minlength=(high - low) * width).reshape(-1, width)
            out[low:high] = model[0] + counts.astype(np.float64) @ model[1:]
        else:
            for t in range(model.shape[1]):
                out[low:high, t] = model[0, t] + np.bincount(owner, model[flat + 1, t], high - low)
        low, done = high, int(ends[high - 1])
    return out


def apply_models(models: list[np.ndarray], places: pa.Array) -> list[np.ndarray]:
    """Predictions of every model; features are counted once for all of them."""
    return np.split(apply_model(np.hstack(models), places), len(models), axis=1)


def score_stored(rows: DataFrame, registry: dict[str, str], id_col: str = "text_id", text_col: str = "full_text", mean: bool = True,
                 fold_col: str | None = None, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """K3: every stored model scores every row: ``(model_id, id, targets...)``, the mean of the fold models; with ``mean=False`` one
    row per fold model and a column ``fold_model``; with ``fold_col`` only the model of the row's own fold (rows without one
    are left out)."""
    spark = rows.sparkSession
    heads = {}
    for name, path in registry.items():
        head = spark.read.parquet(path).select("kind", "n_features").first()
        if head is None:
            raise ValueError(f"model {name!r} at {path} is empty")
        heads[name] = (head["kind"], head["n_features"])
    shapes = sorted(set(heads.values()))
    features = [FEATURES[kind](F.col(text_col), n).alias(f"p{i}") for i, (kind, n) in enumerate(shapes)]
    own = [] if fold_col is None else [F.col(fold_col).cast("int").alias("own")]
    src = rows.select(F.col(id_col).alias("id"), *own, *features)
    shipped = {name: ship_files(spark, path) for name, path in registry.items()}
    place = {name: src.columns.index(f"p{shapes.index(h)}") for name, h in heads.items()}
    one = mean or fold_col is not None
    id_type = src.schema["id"].dataType.simpleString()
    schema = f"model_id string, id {id_type}, " + ("" if mean and fold_col is None else "fold_model int, ") + ", ".join(f"{t} double" for t in TARGETS)
    names = [f.split()[0] for f in schema.split(", ")]

    def block_scores(models: Models, block: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in sorted(shipped):
            folds = models.get(name)
            for batch in block:
                places = batch.column(place[name])
                if fold_col is not None:
                    which = batch.column(1).to_numpy(zero_copy_only=False)
                    parts = [(np.flatnonzero(which == k), k) for k in range(len(folds))]
                    scored = [(at, k, apply_model(folds[k], places.take(pa.array(at)))) for at, k in parts if len(at)]
                elif one:
                    scored = [(np.arange(batch.num_rows), None, np.mean(apply_models(folds, places), axis=0))]
                else:
                    scored = [(np.arange(batch.num_rows), k, values) for k, values in enumerate(apply_models(folds, places))]
                for at, k, values in scored:
                    columns = [pa.array([name] * len(at), pa.string()), batch.column(0).take(pa.array(at))]
                    columns += [] if k is None else [pa.array(np.full(len(at), k), pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(values[:, t]) for t in range(len(TARGETS))], names=names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        models = Models({n: [SparkFiles.get(f) for f in files] for n, files in shipped.items()}, cache_bytes)
        block: list[pa.RecordBatch] = []
        for batch in batches:
            block.append(batch)
            if len(block) == BLOCK_BATCHES or sum(b.nbytes for b in block) >= BLOCK_BYTES:
                yield from block_scores(models, block)
                block = []
        yield from block_scores(models, block)
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)
