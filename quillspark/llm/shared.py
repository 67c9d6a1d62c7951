"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# ASCII white space as a Java regular-expression class, and the words it separates.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def fold_ascii(c):
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def pin(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""
    def run(batches):
        for batch in batches:
            yield from fn(batch)
    return df.mapInArrow(run, schema)


# Spark's own bound on the bytes of the batches that go to Python; its default (64 MB) lets 10,000 texts through at once.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of about 4 MB, so a worker's memory does not follow the length of the texts.

    Set for the session, as plans are run after they are built; a session that has a bound of its own keeps it.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def trimmed(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``fn`` for ``mapInArrow``; at the end of a task Arrow's unused memory goes back to the system, since the worker lives
    on beside the next steps."""
    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
    return run


# Largest Bloom filter that is broadcast; with more ids it lets more rows through, the join after it stays exact.
BLOOM_BITS = 1 << 26


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results are written.

    Its cleaner removes them once the driver has collected their plans, which an idle driver heap can put off for half an
    hour; large steps ask for the collection when they are done.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# Spark's own setting for what ``shuffles_dropped`` does.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that are built and run inside lose their shuffle files as soon as they end; for results that are written.

    ``release`` alone may come too late: until other queries have run, Spark's own threads can still hold the last plan.
    """
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def few_rows(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str, exact: bool = True,
             most_bits: int = BLOOM_BITS) -> DataFrame:
    """``rows`` whose ``key`` occurs in ``wanted``, all but a few false positives dropped before any shuffle.

    For wide rows (texts) of which few are wanted: the ids become a Bloom filter of at most ``most_bits`` bits, so what
    is broadcast is bounded whatever the data; an exact semi join follows (``exact=False``: the caller joins anyway).
    """
    ids = wanted.select(F.col(wanted_key).alias("_fr_id")).distinct()
    n = ids.count()
    bits = min(most_bits, 1 << max(10, (16 * n).bit_length()))
    at = [F.pmod(F.xxhash64(F.col("_fr_id"), F.lit(j)), F.lit(bits)) for j in range(3)]
    words = (ids.select(F.explode(F.array(*at)).alias("at"))
                .groupBy(F.shiftright("at", 6).alias("word"))
                .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")))
    table = np.zeros(bits // 64, np.uint64)
    found = words.toPandas()
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    shipped = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def likely(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        bloom = shipped.value
        out = np.ones(len(a), bool)
        for s in (a, b, c):
            x = s.to_numpy(np.int64)
            out &= (bloom[x >> 6] >> (x & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pd.Series(out)
    places = [F.pmod(F.xxhash64(F.col(key), F.lit(j)), F.lit(bits)) for j in range(3)]
    some = rows.filter(likely(*places))
    return some if not exact else some.join(ids, F.col(key).eqNullSafe(F.col("_fr_id")), "left_semi")
