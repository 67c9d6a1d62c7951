"""Table scans and sinks: parquet/CSV dispatch, pandas-compatible CSV, run directories of prediction files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..targets import TARGETS
from .csvfiles import field, read_csv, read_records

ESSAY_SCHEMA = T.StructType(
    [T.StructField("text_id", T.StringType()), T.StructField("full_text", T.StringType())]
    + [T.StructField(t, T.DoubleType()) for t in TARGETS]
)


# Scaling runs only (set by bench.py): N shifted copies of every table, derived by Spark from the given tables.
REPLICATE_CONF = "spark.quillspark.bench.replicate"
# id columns shifted per copy so that copies never collide; other columns are kept
_ID_COLUMNS = {"documents": ["doc_id"], "labels": ["doc_id"], "events": ["event_id", "user_id"],
               "embeddings": ["vec_id"], "benchmark": ["item_id"], "pages": ["page_id"], "conversations": ["conv_id"]}
_COPY_OFFSET = 1_000_000_000


class Tables:
    """Lazy access to the parquet tables of one data folder: ``Tables(spark, dir).documents``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._cache: dict[str, DataFrame] = {}
        self.copies = int(spark.conf.get(REPLICATE_CONF, "1") or "1")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            df = self.spark.read.parquet(f"{self.root}/{name}.parquet")
            if self.copies > 1 and name in _ID_COLUMNS:
                df = replicate(df, _ID_COLUMNS[name], self.copies)
            self._cache[name] = df
        return self._cache[name]


def replicate(df: DataFrame, id_cols: list[str], copies: int) -> DataFrame:
    """``copies`` copies of a table with shifted ids (a bounded generator, for scaling measurements)."""
    out = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    for c in id_cols:
        out = out.withColumn(c, F.col(c) + F.col("_copy").cast("long") * F.lit(_COPY_OFFSET))
    return out.drop("_copy")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Format by suffix: ``.pq``/``.parquet`` → parquet, anything else → pandas-style CSV."""
    if path.endswith(".pq") or path.endswith(".parquet"):
        return spark.read.parquet(path)
    return read_csv(spark, path, schema)


def write_csv(df: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """CSV that pandas reads back: header, quotes doubled, newlines kept inside quotes; a folder of part files."""
    out = df.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"') \
        .option("quoteAll", "false")
    if rows_per_file:
        out = out.option("maxRecordsPerFile", rows_per_file)
    out.csv(path)


def read_prediction_dir(spark: SparkSession, pattern: str, banned_models: list[str] | None = None,
                        targets: list[str] = TARGETS) -> DataFrame:
    """One scan over a folder of per-model prediction files: ``model_id, text_id, fold, <targets>``.

    The files may differ: true targets plus ``pred_<target>`` columns or target-named predictions, with or without an
    unnamed index column, of any width and in any column order; each file's header says where its columns are. A
    file without ``text_id`` is an error, a target or fold that a file lacks is NULL.
    """
    has_pred = F.array_contains("h", f"pred_{targets[0]}")
    text_id = F.when(F.array_contains("h", "text_id"), field("text_id")) \
        .otherwise(F.raise_error(F.concat("file", F.lit(": no column text_id"))))
    df = read_records(spark, pattern).select(
        model_id_from_path(F.col("file")).alias("model_id"), text_id.alias("text_id"),
        field("fold").cast("double").cast("int").alias("fold"),
        *[F.when(has_pred, field(f"pred_{t}")).otherwise(field(t)).cast("double").alias(t) for t in targets])
    return ban_models(df, banned_models)


def model_id_from_path(path) -> "F.Column":
    """``.../model2.csv`` → ``model2``; Spark output folders (``.../model2.csv/part-0000.csv``) name the folder."""
    folder = F.regexp_replace(path, r"/part-[^/]*$", "")
    name = F.regexp_extract(folder, r"([^/]+)$", 1)
    return F.regexp_replace(name, r"\.(csv|pq|parquet)$", "")


def ban_models(df: DataFrame, banned_models: list[str] | None) -> DataFrame:
    """Drop rows of excluded models; no-op when nothing is banned."""
    if not banned_models:
        return df
    return df.filter(~F.col("model_id").isin(list(banned_models)))
